"""Line dedup by a log-template tree (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, packed_row, quoted, table_mark, text_of, unpacked, written

#: Leading tokens of a line that are levels of the tree, below its token count; shorter lines are in no leaf.
LEADING, LEAST_TOKENS = 2, 3
#: A token is learned as part of a leaf's templates if this share of the leaf's lines has it at its place (and least_docs of them).
LEARNED = 0.02
#: A template has at least so many learned or leading tokens, and this share of all its tokens.
LEAST_FIXED, FIXED_SHARE = 4, 0.6
#: Up to so many kinds of lines (a hash each, and ids of their documents) go to every task; with more, texts are dealt out to them.
BROADCAST_KINDS = 500_000
#: Tokens over which a line, word for word, is a passage; share of the words of two documents from which they are copies.
PASSAGE, COPY = 50, 0.8

_WORDS = r"filter(split(l, '[\\x20\\x09-\\x0D]+', -1), w -> w <> '')"
_TOKENS = r"transform(ws, w -> if(w rlike '[0-9]', '<*>', w))"
_DOC = ["doc_id", "text_key"]


def _lines(fields: str) -> str:
    """SQL for an array with a struct of `fields` for each line of `text`, null for one that is in no leaf; fields may use the words ws and the tokens ts."""
    each = f"transform(array({_WORDS}), ws -> transform(array({_TOKENS}), ts -> if(size(ts) >= {LEAST_TOKENS}, named_struct({fields}), null))[0])[0]"
    return f"transform(split(text, '\\n', -1), l -> {each})"


_LEAF = f"'leaf', xxhash64(size(ts), slice(ts, 1, {LEADING}))"
_WHOLE = "'whole', xxhash64(ts)"
_EXACT = "'exact', xxhash64(ws, 1), 'words', size(ws)"
# The tokens after the leading ones, each with its place; those with a digit are variable anyway.
_PLACED = f"'placed', transform(slice(ts, {LEADING + 1}, size(ts)), (t, i) -> if(t = '<*>', null, xxhash64(i, t)))"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, text): a document is an id and a text, so rows without an id are told apart by their texts."""
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def _first() -> Column:
    """The order of documents: by id, null last, then by the text's hash."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")


def learned_templates(texts: DataFrame, lines: DataFrame, least_docs: int) -> DataFrame:
    """(whole, template): the template learned for every different line of leaves with at least least_docs lines.

    texts: from _keyed; lines: (doc_id, text_key, leaf, whole), different ones.
    In each leaf a token is counted at its place over all lines (one for each
    document and different line). Those that are common there (LEARNED,
    least_docs) are parts of templates; at all other places a line's template
    has a variable field, as for any token with a digit. Lines whose template would be too general
    (LEAST_FIXED, FIXED_SHARE) have none. A leaf has at most 1 / LEARNED learned
    tokens for each place, so the set that its lines are held against is bounded.
    """
    wholes = lines.groupBy("leaf", "whole").agg(F.count("*").alias("n"), F.min(_first()).alias("first"))
    leaves = wholes.groupBy("leaf").agg(F.sum("n").alias("of_leaf")).filter(F.col("of_leaf") >= least_docs)
    kinds = written(wholes.join(leaves, "leaf"), "template-leaves")
    # The tokens of a kind of line come from the first document that has it, so that few texts are read again and no token list of any other line is made.
    wanted = kinds.groupBy(F.col("first.doc_id").alias("of_id"), F.col("first.text_key").alias("of_key")).agg(F.collect_list("whole").alias("wanted"))
    wanted = written(wanted, "template-wanted")
    side = F.broadcast(wanted) if kinds.count() <= BROADCAST_KINDS else wanted
    once = texts.join(side, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")))
    placed = once.select("wanted", F.explode(F.expr(_lines(f"{_WHOLE}, {_PLACED}"))).alias("l")).filter("l is not null and array_contains(wanted, l.whole)").select("l.whole", "l.placed")
    tokens = written(placed.groupBy("whole").agg(F.first("placed").alias("placed")).join(kinds.drop("first"), "whole"), "template-kinds")
    counts = tokens.select("leaf", "of_leaf", "n", F.explode("placed").alias("token")).filter("token is not null").groupBy("leaf", "token").agg(F.sum("n").alias("n"), F.max("of_leaf").alias("of_leaf"))
    learned = counts.filter(F.col("n") >= F.greatest(F.lit(least_docs), F.ceil(LEARNED * F.col("of_leaf")))).groupBy("leaf").agg(F.collect_set("token").alias("learned"))
    fixed = tokens.join(learned, "leaf").select("leaf", "whole", F.size("placed").alias("n"), F.array_sort(F.array_intersect("placed", "learned")).alias("fixed"))
    enough = F.size("fixed") + LEADING >= F.greatest(F.lit(LEAST_FIXED), F.ceil(FIXED_SHARE * (F.col("n") + LEADING)))
    return fixed.filter(enough).select("whole", F.xxhash64("leaf", "fixed").alias("template"))


def recurring_lines(texts: DataFrame, lines: DataFrame, least_docs: int) -> DataFrame:
    """(doc_id, text_key, whole) of lines whose template, or they themselves, at least least_docs documents have; not of the first of these."""
    names = learned_templates(texts, lines, least_docs)
    own = lines.select(*_DOC, "whole", F.col("whole").alias("key"))
    keyed = written(own.unionByName(lines.join(names, "whole").select(*_DOC, "whole", F.col("template").alias("key"))), "template-keys")
    held = keyed.select("key", *_DOC).distinct()
    counts = held.groupBy("key").agg(F.count("*").alias("n_docs"), F.min(_first()).alias("first")).filter(F.col("n_docs") >= least_docs)
    recurring = written(counts.select("key", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key")), "templates")
    own = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    return keyed.join(recurring, "key").filter(~own).select(*_DOC, "whole")


def repeated_passages(exact: DataFrame, passage_docs: int) -> DataFrame:
    """(doc_id, text_key, exact) of passages that passage_docs or more documents have, from all documents but the first.

    exact: (doc_id, text_key, exact, words) of all lines, different ones. Not
    from a copy, which shares COPY of the words with the first document in
    whole lines: it is left whole for near-duplicate removal to find.
    """
    passages = exact.filter(F.col("words") > PASSAGE)
    firsts = passages.groupBy("exact").agg(F.count("*").alias("n_docs"), F.min(_first()).alias("first")).filter(F.col("n_docs") >= passage_docs)
    firsts = firsts.select("exact", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"))
    own = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    later = written(passages.join(firsts, "exact").filter(~own).select(*_DOC, "exact", "first_id", "first_key"), "passages")
    # A document is looked up by its text's hash and its id, which may be null.
    key, first = F.xxhash64("text_key", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.xxhash64("first_key", F.coalesce(F.col("first_id").cast("string"), F.lit("")))
    pairs = later.select(key.alias("doc"), first.alias("first")).distinct()
    held = exact.select(key.alias("doc"), "exact", "words")
    size = held.groupBy("doc").agg(F.sum("words").alias("size"))
    both = pairs.join(held, "doc").join(held.select(F.col("doc").alias("first"), "exact"), ["first", "exact"]).groupBy("doc", "first").agg(F.sum("words").alias("shared"))
    sized = both.join(size, "doc").join(size.select(F.col("doc").alias("first"), F.col("size").alias("first_size")), "first")
    copies = sized.filter(F.col("shared") >= COPY * F.greatest("size", "first_size")).select("doc", "first")
    return later.withColumns({"doc": key, "first": first}).join(copies, ["doc", "first"], "left_anti").select(*_DOC, "exact")


def without_recurring_lines(docs: DataFrame, least_docs: int = 10, id_col: str = "doc_id", text_col: str = "text", passage_docs: int | None = None, counts: bool = True) -> DataFrame:
    """Documents without lines whose template recurs in at least least_docs documents.

    The tree has a fixed depth: token count, then the leading tokens, where a
    token with a digit is the variable field <*>. Templates are learned in its
    leaves (learned_templates); a line as it is counts as a template too. With
    passage_docs, lines of over PASSAGE tokens that recur word for word in so
    many documents go as well (repeated_passages). The first document of a
    template (smallest id, null last, then smallest hash of the text) keeps its
    lines, so that nothing is lost from the whole; in all others they are
    dropped. Lines of fewer than LEAST_TOKENS tokens are never dropped; what is
    left keeps its order and line breaks. Texts without such lines stay as they
    are, null too.

    Returns the columns of docs, and with counts n_lines and n_dropped (columns
    of these names in docs are replaced). Rows with the same id and text are one
    document and keep or lose lines alike; rows that repeat an id with another
    text, and rows without an id, are documents of their own; an empty table
    gives no rows. A template that a third of all documents share is one key
    with many rows: it is counted by partial sums, and Spark may split its join.
    """
    mark = table_mark()
    texts, passages = _keyed(docs, id_col, text_col), passage_docs is not None
    fields = ["leaf", "whole", *(["exact", "words"] if passages else [])]
    # The hashes of all lines of a document in their order: lines are counted by them, and found again at the end.
    parsed = written(texts.select(*_DOC, F.expr(_lines(", ".join([_LEAF, _WHOLE, *([_EXACT] if passages else [])]))).alias("lines")), "template-lines")
    found = parsed.select(*_DOC, F.explode("lines").alias("l")).filter("l is not null").select(*_DOC, *[f"l.{c}" for c in fields]).distinct()
    found = written(found, "template-found")
    drops = recurring_lines(texts, found.select(*_DOC, "leaf", "whole").distinct() if passages else found, least_docs)
    if passages:
        drops = drops.union(repeated_passages(found.select(*_DOC, "exact", "words").distinct(), passage_docs))
    # Drops go back to the places of their lines, a row for each, so that very long texts cost no more than in proportion.
    hashes = F.array("l.whole", "l.exact") if passages else F.array("l.whole")
    places = parsed.select(*_DOC, F.posexplode("lines").alias("place", "l")).filter("l is not null").select(*_DOC, "place", F.explode(hashes).alias("hash"))
    gone = drops.distinct().select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), F.col("whole").alias("of_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    per_doc = places.join(gone, same & (F.col("hash") == F.col("of_hash"))).groupBy("of_id", "of_key").agg(F.collect_set("place").alias("lost"))
    per_doc = written(per_doc, "template-lost")
    drop_tables(docs.sparkSession, mark, (per_doc,))
    wide = docs.drop("n_lines", "n_dropped") if counts else docs
    # The text goes through the shuffle once, within the row.
    inner = wide.select(packed_row(wide), F.col(quoted(id_col)).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_key"))
    joined = inner.join(per_doc, same, "left").select("row", F.col(f"row.{quoted(text_col)}").cast("string").alias("text"), "lost")
    # Bound once in a lambda, lest Spark compute the lines anew for each use.
    kept = "transform(array(split(text, '\\n', -1)), ls -> named_struct('lines', if(lost is null, null, transform(array_except(sequence(0, size(ls) - 1), lost), i -> ls[i])), 'n', size(ls)))[0]"
    split = joined.select("row", "text", "lost", F.expr(kept).alias("kept"))
    whole = F.col("kept.n")
    values = dict(zip(wide.columns, unpacked(wide.columns), strict=True))
    values[text_col] = F.when(F.col("lost").isNull(), F.col("text")).otherwise(F.array_join("kept.lines", "\n")).alias(text_col)
    numbers = {"n_lines": whole, "n_dropped": F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost"))} if counts else {}
    return split.select(*values.values(), *[F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in numbers.items()])
