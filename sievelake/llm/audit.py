"""How filters overlap, from a sparse document-term matrix."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, shuffle_partitions, text_of, written

#: Bytes of texts that a shard of the matrix holds, unless one text has more.
SHARD = 16 << 20
#: Bytes of a shard's texts whose words are held at once, unless one word has more.
PIECE = 1 << 20
#: The filters, in the order of their bits.
FILTERS = "ABCDE"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = b"#$%&*|"
#: Whether a byte is one of the six ASCII blanks.
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BLANKS = re.compile(rb"[\t-\r ]")


# ---- document-term matrix --------------------------------------------------


def _shards_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list, list[bytes]]]:
    """Ids, parts and texts of about `size` bytes at most, or of one text."""
    ids, parts, texts, total = [], [], [], 0
    for batch in batches:
        column = batch.column(2).cast(pa.large_binary())
        for k in range(batch.num_rows):
            text = column[k].as_py()
            if ids and total + len(text) > size:
                yield ids, parts, texts
                ids, parts, texts, total = [], [], [], 0
            ids.append(batch.column(0)[k].as_py())
            parts.append(batch.column(1)[k].as_py())
            texts.append(text)
            total += len(text)
    if ids:
        yield ids, parts, texts


def words_of(data: np.ndarray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of bytes, what stands between the six ASCII blanks, and where each begins."""
    inside = ~BLANK[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), buffers), starts


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Stretches of the texts of about PIECE bytes together, and the places of the texts that they are from; long texts are cut before a blank."""
    docs, parts, total = [], [], 0
    for doc, text in enumerate(texts):
        at = 0
        while at is not None:
            blank = BLANKS.search(text, at + PIECE) if len(text) - at > PIECE else None
            part = text[at : blank.start()] if blank else text[at:]
            if parts and total + len(part) > PIECE:
                yield docs, parts
                docs, parts, total = [], [], 0
            docs.append(doc)
            parts.append(part)
            total += len(part) + 1
            at = blank.start() if blank else None
    if parts:
        yield docs, parts


def count_words(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Different words of the texts in order of their hashes, these hashes, and an entry for each text and word of it: (text, word's place) in order as upper and lower 32 bits, and counts.

    Words are found, encoded and counted piece by piece, so that besides the
    entries and the different words only those of one piece are in memory.
    """
    dictionaries, entries, counts = [], [], []
    for docs, parts in _pieces(texts):
        words, at = words_of(np.frombuffer(b"\n".join(parts), np.uint8))
        if not len(words):
            continue
        encoded = words.dictionary_encode()
        bounds = np.cumsum([len(p) + 1 for p in parts])
        doc = np.array(docs, np.int64)[np.searchsorted(bounds, at, side="right")]
        entry, n = np.unique((doc << 32) | encoded.indices.to_numpy(), return_counts=True)
        dictionaries.append(encoded.dictionary)
        entries.append(entry)
        counts.append(n.astype(np.int32))
    if not entries:
        return pa.array([], pa.large_binary()), *[np.zeros(0, np.int64)] * 3
    # Encoding the pieces' dictionaries as one column gives all of them the dictionary of the whole.
    places = pa.chunked_array(dictionaries).dictionary_encode()
    distinct = places.chunk(0).dictionary
    hashes = np.concatenate([np.fromiter(map(zlib.crc32, distinct.slice(k, 1 << 16).to_pylist()), np.int64) for k in range(0, len(distinct), 1 << 16)])
    order = np.argsort(hashes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    for k, chunk in enumerate(places.chunks):
        entry = (entries[k] >> 32 << 32) | place[chunk.indices.to_numpy()[entries[k] & 0xFFFFFFFF]]
        by = np.argsort(entry)
        entries[k], counts[k] = entry[by], counts[k][by]
    entry, n = np.concatenate(entries), np.concatenate(counts)
    del entries, counts
    if (entry[1:] <= entry[:-1]).any():
        # A text that was cut can have a word in several pieces.
        by = np.argsort(entry, kind="stable")
        entry, n = entry[by], n[by]
        first = np.flatnonzero(np.diff(entry, prepend=-1))
        entry, n = entry[first], np.add.reduceat(n, first)
    return distinct.take(pa.array(order)), hashes[order], entry, n


def _packed(values: np.ndarray) -> bytes:
    """32-bit numbers as compressed bytes."""
    return pa.Codec("zstd", 1).compress(values.astype(np.int32).tobytes(), asbytes=True)


def _numbers(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(packed, 4 * n, asbytes=True), np.int32) if n else np.zeros(0, np.int32)


def _local_shards(rows: DataFrame, size: int, ranges: int) -> DataFrame:
    """Two kinds of rows. With null `range` a shard whose column numbers count its own words, in order of these words' hashes: shard, docs, starts, entries, columns, counts (packed).

    With a range the shard's words whose hashes are in it, joined by blanks.
    docs has what else there is to know of each text: id, part, digest, whether
    it fails C and D.
    """

    def build(batches):
        task = TaskContext.get().partitionId()
        kind = pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("fails_c", pa.bool_()), ("fails_d", pa.bool_())])
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(kind), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
        for nth, (ids, parts, texts) in enumerate(_shards_of(batches, size)):
            digests, fails_c, fails_d = [], [], []
            for text in texts:
                capitals = len(text) - len(text.translate(None, CAPITALS))
                points = len(text.decode("utf-8", "replace"))
                digests.append(hashlib.sha256(text).digest())
                fails_c.append(100 * capitals > 5 * points)
                fails_d.append(len(text.translate(None, SIGNS)) < len(text))
            columns = [pa.array(c, f.type) for c, f in zip((ids, parts, digests, fails_c, fails_d), kind, strict=True)]
            docs = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))
            words, hashes, entry, counts = count_words(texts)
            starts = np.searchsorted(entry >> 32, np.arange(len(ids) + 1)).astype(np.int32)
            shard = (task << 32) | nth
            head = [[shard], [None], [None], docs, [starts], [len(entry)], [_packed(entry & 0xFFFFFFFF)], [_packed(counts)]]
            cuts = np.searchsorted(hashes * ranges >> 32, np.arange(ranges + 1))
            held = [r for r in range(ranges) if cuts[r] < cuts[r + 1]]
            rest = [[shard] * len(held), held, [b" ".join(words.slice(cuts[r], cuts[r + 1] - cuts[r]).to_pylist()) for r in held], *[[None] * len(held)] * 5]
            for row in (head, rest):
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(row, kinds, strict=True)], ["shard", "range", "words", "docs", "starts", "entries", "columns", "counts"])

    docs = "array<struct<doc_id:long,part:string,digest:binary,fails_c:boolean,fails_d:boolean>>"
    return rows.mapInArrow(build, f"shard long, range long, words binary, docs {docs}, starts array<int>, entries long, columns binary, counts binary")


def number_words(local: DataFrame) -> DataFrame:
    """(shard, range, words, n, numbers): for the words of a shard in a range of hashes their places (packed) among all different words of the range.

    A word's number in the dictionary of all shards is its range (upper 32
    bits) and this place, in order of first appearance by shard. A word is sent
    once for each shard, however often it stands in its texts, and no task
    holds more than the words of one range.
    """
    words = local.filter("range is not null").select("range", "shard", "words")
    dealt = words.repartition(shuffle_partitions(local.sparkSession), "range").sortWithinPartitions("range", "shard")

    def number(batches):
        def result(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            joined = rows.column(2).to_pylist()
            words, at = words_of(np.frombuffer(b" ".join(joined), np.uint8))
            places = words.dictionary_encode().indices.to_numpy()
            cuts = np.searchsorted(at, np.cumsum([0, *(len(j) + 1 for j in joined)]))
            n = np.diff(cuts)
            packed = [_packed(places[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            return pa.RecordBatch.from_arrays([rows.column(1).combine_chunks(), rows.column(0).combine_chunks(), rows.column(2).combine_chunks(), pa.array(n), pa.array(packed, pa.binary())], ["shard", "range", "words", "n", "numbers"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            range_ = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(range_)) + 1).tolist(), len(range_)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b and held and held[-1].column(0)[0].as_py() != range_[a]:
                    yield result(held)
                    held = []
                if a < b:
                    held.append(batch.slice(a, b - a))
        if held:
            yield result(held)

    return dealt.mapInArrow(number, "shard long, range long, words binary, n long, numbers binary")


def dictionary(local: DataFrame) -> DataFrame:
    """(word, number) of every different word of the shards."""

    def list_words(batches):
        for batch in batches:
            for shard, range_, words, n, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(words.split(b" ")), pa.array((range_ << 32) | _numbers(numbers, n).astype(np.int64))], ["word", "number"])

    return number_words(local).mapInArrow(list_words, "word binary, number long").distinct()


def _numbered_shards(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The shards as they are written, and the whole ones with their words' numbers beside them."""
    ranges = max(shuffle_partitions(rows.sparkSession), 4 * rows.rdd.getNumPartitions())
    local = written(_local_shards(rows, size, ranges), "term-shards")
    found = number_words(local).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("range", "n", "numbers"))).alias("found"))
    # A shard of empty texts has no words, and then no numbers.
    return local, local.filter("range is null").select("shard", "docs", "starts", "entries", "columns", "counts").join(found, "shard", "left")


def _csr(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Shards as compressed sparse rows: shard, docs, starts, columns (numbers of words in the dictionary of all texts), counts."""
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            n, found = one.column(3)[0].as_py(), one.column(6)[0].as_py() or []
            numbers = np.concatenate([(f["range"] << 32) | _numbers(f["numbers"], f["n"]).astype(np.int64) for f in found]) if found else np.zeros(0, np.int64)
            yield one.column(0), one.column(1), one.column(2).flatten().to_numpy(), numbers[_numbers(one.column(4)[0].as_py(), n)], _numbers(one.column(5)[0].as_py(), n)


def document_term_matrix(rows: DataFrame, size: int = SHARD) -> DataFrame:
    """Compressed sparse rows, a shard of the matrix in each row of the result: shard, docs, starts, columns, counts.

    rows: doc_id, part, text. Document d of a shard has the entries starts[d]
    to starts[d + 1] - 1 of columns (numbers of words in the dictionary of all
    texts) and counts. Shards are made once and written; the dictionary is made
    from each shard's own words and goes back to it by a join, so that texts
    are read once and no (document, word) pair is shuffled by itself.
    """
    local, numbered = _numbered_shards(rows, size)

    def shards(batches):
        for shard, docs, starts, columns, counts in _csr(batches):
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in (starts, columns, counts)]
            yield pa.RecordBatch.from_arrays([shard, docs, *lists], ["shard", "docs", "starts", "columns", "counts"])

    docs = local.schema["docs"].dataType.simpleString()
    return numbered.mapInArrow(shards, f"shard long, docs {docs}, starts array<int>, columns array<long>, counts array<int>")


def document_statistics(rows: DataFrame, size: int = SHARD) -> DataFrame:
    """A row for each document of the matrix: what docs has of it, n_words (the row's sum) and n_distinct (its entries that are not zero)."""

    def read_rows(batches):
        for _, docs, starts, columns, counts in _csr(batches):
            sums = np.diff(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[starts])
            # Within a row no column stands twice, so its entries are its different words.
            entries = np.diff(np.concatenate([[0], np.cumsum((counts != 0) & (columns >= 0))])[starts])
            yield pa.RecordBatch.from_arrays([*docs.flatten().flatten(), pa.array(sums), pa.array(entries.astype(np.int64))], ["doc_id", "part", "digest", "fails_c", "fails_d", "n_words", "n_distinct"])

    return _numbered_shards(rows, size)[1].mapInArrow(read_rows, "doc_id long, part string, digest binary, fails_c boolean, fails_d boolean, n_words long, n_distinct long")


# ---- audit -----------------------------------------------------------------


def failed_filters(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents by part and by the set of filters they fail (a bit for each of ABCDE), with how many are good and toxic by labels.

    Equal texts fail the same filters but E, so rows are counted by text, part,
    labels and id first, then without the id, which leaves a text as many rows
    as it has parts and labels, however often it stands in the table; only
    these meet by text.
    """
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    fails = {"A": F.col("n_words") < 50, "B": 100 * F.col("n_distinct") < 65 * F.col("n_words"), "C": F.col("fails_c"), "D": F.col("fails_d")}
    failed = sum((F.when(c, bit[f]).otherwise(0) for f, c in fails.items()), F.lit(0))
    counted = stats.groupBy("digest", "part", failed.alias("failed"), "doc_id").agg(F.count("*").alias("n"))
    of_id = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    with_id = counted.filter("doc_id is not null").join(of_id, "doc_id", "left").select("digest", "part", "failed", "doc_id", "n", "good", "toxic")
    zero = F.lit(None).cast("int")
    told = with_id.union(counted.filter("doc_id is null").select("digest", "part", "failed", "doc_id", "n", zero, zero)).fillna(0, ["good", "toxic"])
    # Null ids count as larger than any other: (true, null) comes after all (false, id).
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id")
    kinds = told.groupBy("digest", "part", "failed", "good", "toxic").agg(F.sum("n").alias("n"), F.min(order).alias("first"), F.min(F.struct(order.alias("first"), "n")).getField("n").alias("n_first"))
    kinds = written(kinds, "text-kinds")
    least = kinds.groupBy("digest").agg(F.min("first").alias("least"))
    split = kinds.join(least, "digest").withColumn("firsts", F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0))
    both = split.select("part", "good", "toxic", F.explode(F.array(F.struct("failed", F.col("firsts").alias("n")), F.struct((F.col("failed") + bit["E"]).alias("failed"), (F.col("n") - F.col("firsts")).alias("n")))).alias("x"))
    return both.groupBy("part", F.col("x.failed").alias("failed")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


def _steps() -> Column:
    """Every step of every order of the filters: filter_order, step, bit of the step's filter, and bits of those before it."""
    steps = []
    for order in itertools.permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        for step, k in enumerate(order):
            steps.append({"filter_order": name, "step": step + 1, "bit": 1 << k, "before": sum(1 << j for j in order[:step])})
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", size: int = SHARD) -> DataFrame:
    """What each of five filters removes within each part, in every order of them.

    A: under 50 words (row sums of the document-term matrix); B: under 65
    different words in 100 (its entries that are not zero); C: over 5 capitals
    A to Z in 100 characters; D: one of #$%&*|; E: the text of a smaller id,
    anywhere in the table. Returns for each part, order and step the counts
    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley
    (what the filter removes, over all orders: of a document that fails k
    filters, each is first in one order of k). Zeros are included.

    Null texts are empty, as is the name of a null part. Null ids count as
    larger than any other and have no labels; rows of one id and one text do
    not remove each other. Of several labels of an id one that says good
    (quality = 1) or toxic (1) is enough. Without documents there are no rows.
    Texts of any length: a shard holds one text at least.
    """
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(part_col)).cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    failed = failed_filters(document_statistics(rows, size), labels)
    at = F.array_sort(F.collect_list(F.struct("failed", "n", "good", "toxic")))
    parts = failed.groupBy("part").agg(at.alias("sets"))  # 32 sets at most
    out = parts.select("part", "sets", F.explode(_steps()).alias("s"))
    orders = 120

    def total(value: str, condition: str) -> Column:
        return F.expr(f"aggregate(sets, 0L, (a, x) -> a + if({condition}, x.{value}, 0L))").cast("long")

    fails, before = "(x.failed & s.bit) <> 0", "(x.failed & s.before) <> 0"
    return out.select(
        "part",
        "s.filter_order",
        "s.step",
        total("n", "(x.failed & (s.before | s.bit)) = 0").alias("kept"),
        total("n", f"{fails} and not {before}").alias("removed"),
        total("n", f"{fails} and {before}").alias("redundant"),
        total("n", "x.failed = s.bit").alias("unique_fails"),
        total("good", f"{fails} and not {before}").alias("good_lost"),
        total("toxic", f"{fails} and not {before}").alias("toxic_lost"),
        F.expr(f"aggregate(sets, 0L, (a, x) -> a + if({fails}, x.n * ({orders} div bit_count(x.failed)), 0L))").cast("long").alias("shapley"),
    )
