"""Removal of repeated passages by backward search in compressed FM-indexes over wavelet trees."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, shuffle_partitions, text_of, written

#: Words of the short sequences that mark windows.
GRAM = 8
#: Bytes of texts whose words are held at once.
LISTED = 4 << 20
#: Words that an index holds, about; kinds of runs with one mark that go into one index together.
INDEXED, TOGETHER = 1 << 20, 8192
#: Share of the documents in which a gram must be to be a mark only where there is no other.
COMMON = 0.01
#: Stands for a null id, which counts as larger than any other.
_LATE = (1 << 63) - 1
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)
_BELOW = np.array([(1 << k) - 1 for k in range(64)], np.uint64)


# ---- index -----------------------------------------------------------------


class WaveletTree:
    """A sequence of numbers, from the highest bit to the lowest one level of bits for each, those with a zero first in the level below.

    Bits are packed into words of 64; each word has the count of ones before it.
    """

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.bits = max(1, int(alphabet - 1).bit_length())
        here, starts = symbols.astype(np.int64), np.arange(alphabet, dtype=np.int64)
        for level in reversed(range(self.bits)):
            bit = (here >> level) & 1
            packed = np.packbits(bit.astype(bool), bitorder="little")
            words = np.zeros(len(here) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ahead = np.zeros(len(words), np.int32)
            ahead[1:] = np.cumsum(np.bitwise_count(words[:-1]))
            self.levels.append((words, ahead, int(len(here) - bit.sum())))
            here = np.concatenate([here[bit == 0], here[bit == 1]])
        # Where the occurrences of each symbol begin below the last level.
        self.first = self._down(starts, np.zeros(alphabet, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, (words, ahead, zeros) in zip(reversed(range(self.bits)), self.levels, strict=True):
            at = place >> 6
            ones = ahead[at] + np.bitwise_count(words[at] & _BELOW[place & 63])
            place = np.where((symbol >> level) & 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place."""
        return self._down(symbol, place) - self.first[symbol]


class FMIndex:
    """A compressed full-text index of sequences of numbers from 0 on.

    Every sequence ends in a mark of its own, so that matches never cross
    sequences. The suffixes' order comes from prefix doubling; kept are the
    number before each suffix as a wavelet tree, how much each suffix has in
    common with the one before, and where suffixes begin that differ from the
    one before in their first `depth` numbers.
    """

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, alphabet: int, depth: int):
        self.depth, m = depth, len(sizes)
        n = len(symbols) + m
        ends = np.cumsum(sizes + 1) - 1
        text = np.full(n, -1, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = symbols
        rank = np.where(inside, text + m, 0)
        rank[ends] = np.arange(m)
        ranks, width = [rank.astype(np.int32)], 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            key = rank * (n + alphabet + 2) + after
            order = np.argsort(key)
            new = np.diff(key[order]) != 0
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(new)])
            width *= 2
            if new.all():
                break
            ranks.append(rank.astype(np.int32))
        self.size, self.sequence = n, np.repeat(np.arange(m), sizes + 1)[order]
        self.common = self._common(order, ranks)
        before = np.where(inside[order - 1], text[order - 1] + 1, 0)
        self.tree = WaveletTree(before, alphabet + 1)
        self.ahead = m + np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=alphabet))])
        self.starts = np.flatnonzero(self.common < depth)
        self.group = np.cumsum(self.common < depth) - 1
        self._table: list[np.ndarray] | None = None

    @staticmethod
    def _common(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Numbers that each suffix in order has in common with the one before, 255 at most; equal ranks at a width are equal prefixes of it."""
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(order), np.int64)
        for k in reversed(range(len(ranks))):
            same = ranks[k][np.minimum(a, len(order) - 1)] == ranks[k][np.minimum(b, len(order) - 1)]
            step = same * (1 << k)
            common[1:] += step
            a += step
            b += step
        return np.minimum(common, 255).astype(np.uint8)

    def extended(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with the symbol and go on as those of the ranges: a step of backward search."""
        at = self.tree.rank(np.concatenate([symbol + 1, symbol + 1]), np.concatenate([low, high])).reshape(2, -1) + self.ahead[symbol]
        return at[0], at[1]

    def widened(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of all suffixes that agree with those of the ranges in their first `depth` numbers."""
        if self._table is None:
            # Least common prefix of 1, 2, 4, ... neighbours from each place on.
            self._table = [np.append(self.common, 0)]
            self._table[0][0] = 0
            while 2 << (len(self._table) - 1) <= self.size:
                last, step = self._table[-1], 1 << (len(self._table) - 1)
                self._table.append(np.minimum(last[:-step], last[step:]))
        low, high = low.copy(), high.copy()
        for k in reversed(range(len(self._table))):
            step, least = 1 << k, self._table[k]
            # `low` goes down while suffixes low - step + 1 to low have enough in common with those before them.
            at = low - step + 1
            go = (at > 0) & (least[np.clip(at, 0, len(least) - 1)] >= depth)
            low = np.where(go, low - step, low)
            go = (high + step <= self.size) & (least[np.clip(high, 0, len(least) - 1)] >= depth)
            high = np.where(go, high + step, high)
        return low, high

    def matching_statistics(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of each query the longest match that begins there, `depth` at most, and a suffix that has it.

        symbols: the queries one after another; -1 stands for what the index
        does not have. All queries are searched together, from their ends on:
        a match is extended by the number before it; where that fails, it is
        cut to what its suffixes have in common with their neighbours, and
        where it grows beyond `depth`, to `depth`.
        """
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        length, where = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes, starts = sizes[order], bounds[:-1][order]
        low, high, depth = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.size), np.zeros(len(sizes), np.int64)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            active = int(np.searchsorted(-sizes, -step, side="left"))  # queries longer than `step`
            place = starts[:active] + sizes[:active] - 1 - step
            symbol = symbols[place]
            todo = np.arange(active)
            unknown = symbol < 0
            if unknown.any():
                gone = np.flatnonzero(unknown)
                low[gone], high[gone], depth[gone] = 0, self.size, 0
                todo = todo[~unknown]
            while len(todo):
                a, b = self.extended(symbol[todo], low[todo], high[todo])
                found = a < b
                done = todo[found]
                low[done], high[done], depth[done] = a[found], b[found], depth[done] + 1
                todo = todo[~found]
                todo = todo[depth[todo] > 0]  # nothing is left to cut: no match begins there
                if len(todo):
                    ends = np.append(self.common, 0)
                    depth[todo] = np.maximum(np.where(low[todo] > 0, ends[low[todo]], 0), ends[high[todo]])
                    low[todo], high[todo] = self.widened(low[todo], high[todo], depth[todo])
            far = np.flatnonzero(depth[:active] > self.depth)
            group = self.group[low[far]]
            low[far], high[far], depth[far] = self.starts[group], np.append(self.starts, self.size)[group + 1], self.depth
            length[place], where[place] = depth[:active], low[:active]
        return length, where


def passages_found(contents: list[bytes], docs: np.ndarray, indexed: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(row, low, high, least): words low to high - 1 of the row's content lie in windows that indexed rows have too, the least of whose documents is `least`.

    contents: words joined by blanks; docs: a document for each; indexed:
    whether the row is part of the index. Every row is searched.
    """
    numbers: dict[bytes, int] = {}
    rows = [c.split(b" ") for c in contents]
    sizes = np.array([len(r) for r in rows])
    for k in np.flatnonzero(indexed):
        for w in rows[k]:
            numbers.setdefault(w, len(numbers))
    symbols = np.fromiter((numbers.get(w, -1) for r in rows for w in r), np.int64, int(sizes.sum()))
    of_index = np.repeat(indexed, sizes)
    index = FMIndex(symbols[of_index], sizes[indexed], len(numbers), window)
    least = np.minimum.reduceat(docs[indexed][index.sequence], index.starts)
    length, where = index.matching_statistics(symbols, sizes)
    row = np.repeat(np.arange(len(rows)), sizes)
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hit = np.flatnonzero(length >= window)
    row, place, doc = row[hit], place[hit], least[index.group[where[hit]]]
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(place) != 1) | (np.diff(doc) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1
    return row[first], place[first], place[last] + window, doc[first]


# ---- marks: which windows can have an equal elsewhere ----------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[list[bytes]]]]:
    """Ids, keys and words of texts of about LISTED bytes at most, or of one text."""
    ids, keys, words, total = [], [], [], 0
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        for k in range(batch.num_rows):
            text = texts[k].as_py()
            if ids and total + len(text) > LISTED:
                yield ids, keys, words
                ids, keys, words, total = [], [], [], 0
            ids.append(_LATE if batch.column(0)[k].as_py() is None else batch.column(0)[k].as_py())
            keys.append(batch.column(1)[k].as_py())
            words.append(text.split())  # bytes are cut at the six ASCII blanks alone
            total += len(text)
    if ids:
        yield ids, keys, words


def gram_codes(words: list[bytes]) -> np.ndarray:
    """A code for the GRAM words from each place on."""
    n = len(words) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    code = np.zeros(n, np.uint64)
    for k in range(GRAM):
        code += hashes[k : k + n] * _MIX[k]
        code ^= code >> np.uint64(31)
    code *= _MIX[4]
    code ^= code >> np.uint64(29)
    return code


def mark_runs(words: list[bytes], bounds: np.ndarray, window: int, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cuts the windows of each document into runs that have the same mark: mark, document, first start, number of starts.

    words: those of all documents, which are cut at bounds. The mark of a
    window is the place of the least code in it, the leftmost of equals, codes
    in `common` (sorted) behind all others; so equal windows have it at the
    same place.
    """
    code = gram_codes(words)
    starts = len(words) - window + 1
    if starts <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    late = np.uint64(1 << 63) if len(common) else np.uint64(0)
    place_in = np.minimum(np.searchsorted(common, code), max(len(common) - 1, 0))
    behind = (common[place_in] == code) * late if len(common) else late
    low = ((code >> np.uint64(1)) & np.uint64(0x7FFFFFFF00000000)) | behind | np.arange(len(code), dtype=np.uint64)
    width, size = window - GRAM + 1, 1
    while 2 * size <= width:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    mark = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    document = np.searchsorted(bounds, np.arange(starts), side="right") - 1
    inside = np.arange(starts) + window <= bounds[document + 1]
    new = np.ones(starts, bool)
    new[1:] = (np.diff(mark) != 0) | (np.diff(document) != 0) | (np.diff(inside) != 0)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, starts))
    first, count = first[inside[first]], count[inside[first]]
    return code[mark[first]].view(np.int64), document[first], first - bounds[document[first]], count


def common_grams(keyed: DataFrame, share: float = COMMON) -> np.ndarray:
    """Codes of grams that stand in the texts about as often as in `share` of the documents, sorted.

    They are bad marks, as windows that are otherwise unlike meet by them; any
    set gives the same result. A gram counts where it is that frequent in a
    block of texts, so there are at most (grams a document / share) of them.
    """

    def count(batches):
        for ids, _, words in _blocks(batches):
            codes, n = np.unique(gram_codes([w for one in words for w in one]), return_counts=True)
            often = n >= max(16, share * len(ids))
            yield pa.RecordBatch.from_arrays([pa.array([None, *codes[often].view(np.int64).tolist()], pa.int64()), pa.array([len(ids), *n[often].tolist()], pa.int64())], ["code", "n"])

    counted = keyed.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counted = written(counted, "grams", files=8)
    total = counted.filter("code is null").first()
    if total is None:
        return np.zeros(0, np.uint64)
    found = counted.filter(F.col("code").isNotNull() & (F.col("n") >= F.lit(max(16.0, share * total["n"])))).collect()
    return np.sort(np.array([r["code"] for r in found], np.int64).view(np.uint64))


# ---- the operator ----------------------------------------------------------


def _runs(keyed: DataFrame, window: int, common: np.ndarray) -> DataFrame:
    """(mark, kind, doc_id, text_key, run) of every run of every text; kind: a digest of the run's words; run: start and number of starts in one number."""

    def list_runs(batches):
        for ids, keys, words in _blocks(batches):
            every = [w for one in words for w in one]
            bounds = np.concatenate([[0], np.cumsum([len(one) for one in words])])
            mark, document, start, count = mark_runs(every, bounds, window, common)
            at = bounds[document] + start
            kinds = [hashlib.blake2b(b" ".join(every[a:b]), digest_size=16).digest() for a, b in zip(at.tolist(), (at + count + window - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(mark), pa.array(kinds, pa.binary()), pa.array(np.array(ids, np.int64)[document]), pa.array(np.array(keys, np.int64)[document]), pa.array((start << 8) | count)],
                ["mark", "kind", "doc_id", "text_key", "run"],
            )

    return keyed.mapInArrow(list_runs, "mark long, kind binary, doc_id long, text_key long, run long")


def _joined_to_texts(keyed: DataFrame, per_doc: DataFrame, how: str) -> DataFrame:
    """per_doc has __id and __key. The texts are dealt out alike for every such join, so that Spark shuffles them once."""
    return keyed.join(per_doc, (F.coalesce("doc_id", F.lit(_LATE)) == F.col("__id")) & (F.col("text_key") == F.col("__key")), how)


def repeated_passages(keyed: DataFrame, window: int = 50, indexed: int = INDEXED, together: int = TOGETHER) -> DataFrame:
    """Ranges of words [low, high) that windows cover which a document with a smaller id has too: doc_id (null as the largest), text_key, low, high.

    Runs of windows meet by their mark (mark_runs). Runs with the same words
    are one kind, which is indexed and searched once however many documents
    have it, with the least of their ids. Kinds whose marks only one id has
    are left out; the others are cut out of their texts and dealt by mark to
    shards of about `indexed` words. A shard has an FM-index; all its kinds
    are searched in it, and for each window found the index tells the least id.
    A mark with more than `together` kinds is spread over several shards; each
    of its kinds is indexed in one and searched in all.
    """
    spark = keyed.sparkSession
    runs = written(_runs(keyed, window, common_grams(keyed)), "runs")
    kinds = runs.groupBy("mark", "kind").agg(F.min(F.struct("doc_id", "text_key", "run")).alias("first"), F.max("doc_id").alias("last"))
    kinds = written(kinds, "kinds")
    marks = kinds.groupBy(F.col("mark").alias("__mark")).agg(F.count("*").alias("n"), F.min("first.doc_id").alias("least"), F.max("last").alias("most")).filter("least < most").drop("least", "most")
    asked = kinds.join(marks, F.col("mark") == F.col("__mark")).drop("__mark")
    wanted = asked.groupBy(F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__key")).agg(F.collect_list(F.struct("mark", "n", "kind", "last", "first.run")).alias("runs"))
    # Windows of a run and the words around them: (window - GRAM + 2) / 2 starts on average.
    shards = max(1, round(kinds.count() * (1.5 * window) / indexed))
    texts = _joined_to_texts(keyed, wanted, "inner").select(F.coalesce("doc_id", F.lit(_LATE)).alias("doc_id"), "text", "runs")

    def cut_out(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                words = one.column(1).cast(pa.large_binary())[0].as_py().split()
                mark, n, kind, last, run = one.column(2).flatten().flatten()
                starts, counts = run.to_numpy() >> 8, run.to_numpy() & 255
                content = [b" ".join(words[s : s + c + window - 1]) for s, c in zip(starts.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([mark, n, kind, last, one.column(0).take(pa.array(np.zeros(len(content), np.int64))), pa.array(content, pa.binary())], ["mark", "n", "kind", "last", "doc_id", "content"])

    contents = texts.mapInArrow(cut_out, "mark long, n long, kind binary, last long, doc_id long, content binary")
    dealt = F.ceil(F.col("n") / together).cast("int")
    own = F.expr("pmod(xxhash64(kind), dealt)")
    contents = contents.withColumn("dealt", dealt).withColumn("salt", F.explode(F.expr("sequence(0, dealt - 1)"))).withColumn("indexed", F.col("salt") == own)
    contents = contents.select(F.expr(f"pmod(xxhash64(mark, salt), {shards})").alias("shard"), "indexed", "kind", "last", "doc_id", "content")
    by_shard = contents.repartition(shuffle_partitions(spark), "shard").sortWithinPartitions("shard", "kind", F.desc("indexed"))

    def search(batches):
        def result(held: list[pa.RecordBatch]):
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            is_in = rows.column(1).to_numpy(zero_copy_only=False)
            if not is_in.any():
                return None
            row, low, high, least = passages_found(rows.column(5).to_pylist(), rows.column(4).to_numpy(), is_in, window)
            useful = least < rows.column(3).to_numpy()[row]
            row = pa.array(row[useful])
            return pa.RecordBatch.from_arrays([rows.column(2).take(row), pa.array(low[useful]), pa.array(high[useful]), pa.array(least[useful])], ["kind", "low", "high", "least"])

        held: list[pa.RecordBatch] = []
        before = None
        for batch in batches:
            # Rows that repeat an id and a text have the same kinds.
            kinds = batch.column(2).to_pylist()
            batch = batch.filter(pa.array([a != b for a, b in zip(kinds, [before, *kinds], strict=False)], pa.bool_()))
            before = kinds[-1] if kinds else before
            shard = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[-1].column(0)[0].as_py() != shard[a]:
                    if (out := result(held)) is not None:
                        yield out
                    held = []
                held.append(batch.slice(a, b - a))
        if held and (out := result(held)) is not None:
            yield out

    found = by_shard.mapInArrow(search, "kind binary, low long, high long, least long")
    hits = runs.select(F.col("kind").alias("__kind"), "doc_id", "text_key", F.expr("shiftright(run, 8)").alias("start")).join(found, F.col("kind") == F.col("__kind")).filter("least < doc_id")
    return hits.select("doc_id", "text_key", (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")).distinct()


def without_passages(docs: DataFrame, window: int = 50, indexed: int = INDEXED, together: int = TOGETHER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every word that a window of `window` words covers which also stands in a document with a smaller id.

    Words are what stands between the ASCII blanks; windows are judged on the
    texts as they are. Returns doc_id, n_words, n_removed, spans (removed
    ranges of words) and kept (the other words, joined by blanks): a row for
    every row of docs. Null texts have no words; null ids count as larger than
    any other; rows that share an id do not remove anything from each other;
    an empty table gives no rows. A task holds one text and its words at least,
    however long it is.
    """
    if not GRAM < window < 255:
        raise ValueError(f"window must be over {GRAM} and 254 at most")
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    ranges = repeated_passages(keyed, window, indexed, together)
    per_doc = ranges.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    both = _joined_to_texts(keyed, per_doc, "left").select("doc_id", "text", "spans")

    def remove(batches):
        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                sizes, removed, spans, kept = [], [], [], []
                texts = part.column(1).cast(pa.large_binary())
                for k in range(part.num_rows):
                    words = texts[k].as_py().split()
                    sizes.append(len(words))
                    found = part.column(2)[k]
                    gone: list[dict] = []
                    for span in sorted((s["low"], s["high"]) for s in found.as_py()) if found.is_valid else []:
                        if gone and span[0] <= gone[-1]["high"]:
                            gone[-1]["high"] = max(gone[-1]["high"], span[1])
                        else:
                            gone.append({"low": span[0], "high": span[1]})
                    edges = [0, *(e for g in gone for e in (g["low"], g["high"])), len(words)]
                    left = [w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y]]
                    removed.append(len(words) - len(left))
                    spans.append(gone)
                    kept.append(b" ".join(left))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    return both.mapInArrow(remove, "doc_id long, n_words long, n_removed long, spans array<struct<low:long,high:long>>, kept string")
