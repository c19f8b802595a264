"""Removal of repeated byte strings by deep-shallow suffix sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, shuffle_partitions, text_of, written

#: Length of the short strings that mark suffixes worth sorting.
MARK = 32
#: Bytes whose marks are found at once, and suffixes that are sorted at once.
SLAB, SORTED = 1 << 20, 20_000
#: Bytes of texts whose runs are held at once.
LISTED = 16 << 20
#: Suffixes that share a mark and go into one task together; more are dealt out and their results merged.
TOGETHER = 4096
#: Depth to which multikey quicksort orders suffixes before blind tries take over.
SHALLOW = 40
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_LATE = (1 << 63) - 1


# ---- deep-shallow sorting -------------------------------------------------


class BlindTrie:
    """Orders strings of one length whose first bytes are alike.

    Inner nodes have a depth and, by the byte there, their children; leaves
    have the places of equal strings. A search goes down by the bytes at the
    depths of the nodes alone, and one comparison with the leaf that it ends
    at tells where the string branches off.
    """

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None
        for k in range(len(strings)):
            self._add(k)

    def _add(self, k: int) -> None:
        s = self.strings[k]
        if self.root is None:
            self.root = [k]
            return
        node, path = self.root, []
        while type(node) is tuple:
            path.append(node)
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        t = self.strings[node[0]]
        if s == t:
            node.append(k)
            return
        apart = int.from_bytes(s, "big") ^ int.from_bytes(t, "big")
        depth = len(s) - (apart.bit_length() + 7) // 8
        while path and path[-1][0] > depth:
            path.pop()
        parent = path[-1] if path else None
        if parent is not None and parent[0] == depth:
            parent[1][s[depth]] = [k]
            return
        below = self.root if parent is None else parent[1][s[parent[0]]]
        made = (depth, {t[depth]: below, s[depth]: [k]})
        if parent is None:
            self.root = made
        else:
            parent[1][s[parent[0]]] = made

    def order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if type(node) is tuple:
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out += node
        return out


def multikey_quicksort(words: np.ndarray, group: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of `words` in order of group and of their first `levels` symbols, and where rows begin that differ from the one before in these.

    Three-way radix quicksort: a part is cut at the symbol of its middle row
    into rows below, alike and above; those alike go on with the next symbol.
    All parts are cut in the same pass, one numpy operation for each step.
    """
    order = np.argsort(group, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.diff(group[order]) != 0
    depth = np.zeros(len(order), np.int64)
    while True:
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(order)))
        part = np.cumsum(new) - 1
        place = np.flatnonzero((size[part] > 1) & (depth < levels))
        if not len(place):
            return order, new
        rows, part = order[place], part[place]
        symbol = words[rows, depth[place]]
        middle = starts + size // 2
        at = middle[part]
        pivot = words[order[at], depth[at]]
        side = np.where(symbol < pivot, 0, np.where(symbol == pivot, 1, 2))
        key = 3 * part + side
        rank = np.argsort(key, kind="stable")
        order[place], key, side = rows[rank], key[rank], side[rank]
        new[place[1:]] |= np.diff(key) != 0
        depth[place] += side == 1


def deep_shallow_order(strings: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Places of the rows of `strings` (uint8, as wide as a multiple of 8) in order of (group, string).

    Multikey quicksort on symbols of 8 bytes orders rows down to `shallow`
    bytes. Groups still alike there go to blind tries, unless all their rows
    are equal.
    """
    words = strings.view(">u8").astype(np.uint64)
    levels = min(shallow // 8, words.shape[1])
    order, new = multikey_quicksort(words, group, levels)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(order))
    rest = words[order][:, levels:]
    unlike = (rest != rest[np.repeat(starts, ends - starts)]).any(1)
    for a, b in zip(starts, ends, strict=True):
        if b - a > 1 and unlike[a:b].any():
            rows = order[a:b]
            trie = BlindTrie([strings[r, 8 * levels :].tobytes() for r in rows])
            order[a:b] = rows[trie.order()]
    return order


def common_prefixes(strings: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in order has in common with the one before it; -1 at the start of a group."""
    out = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        unlike = strings[order[1:]] != strings[order[:-1]]
        out[1:] = np.where(unlike.any(1), unlike.argmax(1), strings.shape[1])
        out[1:][group[order[1:]] != group[order[:-1]]] = -1
    return out


# ---- marks: which suffixes can have an equal string elsewhere --------------


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the MARK bytes from every place on."""
    raw = np.ascontiguousarray(data)
    words = np.empty(len(raw) - 7, np.uint64)
    for k in range(8):
        part = raw[k : k + (len(raw) - k) // 8 * 8].view(np.uint64)
        words[k::8] = part
    n = len(raw) - MARK + 1
    out = np.zeros(n, np.uint64)
    for k, factor in enumerate(_MIX):
        out += words[8 * k : 8 * k + n] * factor
    out ^= out >> np.uint64(32)
    out *= _MIX[0]
    out ^= out >> np.uint64(29)
    return out


def mark_runs(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Cuts the strings of `length` bytes that lie within a document into runs that have the same mark.

    data: the documents' bytes one after another, cut at bounds. The mark of a
    string is the place of the least hash of MARK bytes in it, the leftmost of
    equals, so equal strings have it at the same place. Yields, a slab at a
    time: hash of the mark, hash of all bytes of the run, document, first start
    in the document, number of starts, and distance of the mark from the first
    start.
    """
    width = length - MARK + 1
    for at in range(0, len(data) - length + 1, SLAB):
        part = data[at : at + SLAB + length - 1]
        starts = len(part) - length + 1
        code = _hashes(part)
        low = (code & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(code), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            low, size = np.minimum(low[:-size], low[size:]), 2 * size
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        mark = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)[:starts]
        first = np.searchsorted(bounds, at + np.arange(0, 1), side="right")[0] - 1
        last = np.searchsorted(bounds, at + starts, side="left")
        document = np.full(starts, -1, np.int64)
        for d in range(first, last):
            a, b = max(bounds[d] - at, 0), min(bounds[d + 1] - length + 1 - at, starts)
            if a < b:
                document[a:b] = d
        new = np.flatnonzero(np.concatenate([[True], (np.diff(mark) != 0) | (np.diff(document) != 0)]))
        count = np.diff(np.append(new, starts))
        held = document[new] >= 0
        new, count = new[held], count[held]
        # All bytes of a run lie under hashes from its front and from its back.
        whole = count.astype(np.uint64)
        for k in range(-(-(length + width) // (2 * MARK))):
            for place in (new + k * MARK, new + count + length - 1 - (k + 1) * MARK):
                whole = (whole ^ code[np.clip(place, new, new + count + length - 1 - MARK)]) * _MIX[1]
                whole ^= whole >> np.uint64(31)
        yield code[mark[new]], whole, document[new], new + at - bounds[document[new]], count, mark[new] - new


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings or binaries, and the bounds of its rows."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


# ---- duplicates among suffixes that share a mark ---------------------------


def repeated_starts(left: np.ndarray, right: np.ndarray, group: np.ndarray, occurrence: np.ndarray, first: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Which strings around the marks have an earlier equal; True at [row, distance of the mark from the start].

    right: the bytes from each mark on; left: those before it, backwards. A
    row's strings start `first` to first - count + 1 bytes before its mark, and
    rows are in order of occurrence (rows of equal occurrence are one). Both
    sides are put in suffix order; two strings that start d bytes before the
    mark are equal if their left sides agree in d bytes and their right sides
    in length - d, that is, if no neighbour between them in either order has
    less in common.
    """
    sides = []
    for strings in (left, right):
        order = deep_shallow_order(strings, group)
        sides.append((order, common_prefixes(strings, group, order)))
    found = np.zeros((len(group), left.shape[1] + 1), bool)
    for d in range(int((first - count + 1).min()), int(first.max()) + 1):
        rows = np.flatnonzero((first >= d) & (first - count < d))
        if len(rows) < 2:
            continue
        classes = []
        for (order, common), depth in zip(sides, (d, length - d), strict=True):
            cls = np.empty(len(group), np.int64)
            cls[order] = np.cumsum(common < depth)
            classes.append(cls[rows])
        key = classes[0] * (len(group) + 1) + classes[1]
        rank = np.argsort(key, kind="stable")
        new = np.concatenate([[True], np.diff(key[rank]) != 0])
        start = rank[np.flatnonzero(new)][np.cumsum(new) - 1]
        found[rows[rank], d] = occurrence[rows[rank]] != occurrence[rows[start]]
    return found


def _sorted_chunk(rows: dict[str, np.ndarray], length: int) -> tuple[list, list]:
    """Removed ranges (doc_id, text_key, low, high) and, for marks dealt out to several tasks, (digest, doc_id, text_key, start) of strings without an earlier equal here."""
    order = np.lexsort((rows["start"] + rows["first"], rows["text_key"], rows["doc_id"]))
    rows = {k: v[order] for k, v in rows.items()}
    m, wide = len(order), -(-length // 8) * 8
    left, right = np.zeros((m, -(-(length - MARK) // 8) * 8), np.uint8), np.zeros((m, wide), np.uint8)
    for k, (content, first) in enumerate(zip(rows["content"], rows["first"], strict=True)):
        text = np.frombuffer(content, np.uint8)
        left[k, :first] = text[:first][::-1]
        right[k, : len(text) - first] = text[first:]
    place = rows["start"] + rows["first"]
    occurrence = np.cumsum(np.concatenate([[0], (np.diff(rows["doc_id"]) != 0) | (np.diff(rows["text_key"]) != 0) | (np.diff(place) != 0)]))
    found = repeated_starts(left, right, rows["group"], occurrence, rows["first"], rows["count"], length)
    # Starts in order: distance d from the mark is start first - d of the row.
    starts = rows["first"][:, None] - np.arange(int(rows["count"].max()))[None, :]
    inside = np.arange(starts.shape[1])[None, :] < rows["count"][:, None]
    repeated = np.take_along_axis(found, np.maximum(starts, 0), 1) & inside
    edge = np.diff(np.pad(repeated.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    base = rows["start"][row]
    ranges = [rows["doc_id"][row], rows["text_key"][row], base + low, base + high - 1 + length]
    row, at = np.nonzero(inside & ~repeated & (rows["dealt"] > 1)[:, None])
    digests = [hashlib.blake2b(rows["content"][r][s : s + length], digest_size=16).digest() for r, s in zip(row, at, strict=True)]
    firsts = [digests, rows["doc_id"][row], rows["text_key"][row], rows["start"][row] + at]
    return ranges, firsts


# ---- the operator ----------------------------------------------------------


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a key of the text that tells apart rows that repeat an id."""
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def _packed(start: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A run's start, number of starts and distance of the mark in one number that sorts by start."""
    return (start << 16) | (count << 8) | first


def _unpacked(run: np.ndarray) -> tuple[np.ndarray, ...]:
    return run >> 16, (run >> 8) & 255, run & 255


def _by_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose texts (column 2) have about LISTED bytes at most, or are one text."""
    _, bounds = _bytes_of(batch.column(2))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + LISTED, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _runs(keyed: DataFrame, length: int) -> DataFrame:
    """(mark, whole, doc_id, text_key, run) of every run of every text; of equal runs in a batch of texts only the first.

    The others are covered by an earlier equal whatever else there is: they
    have null for `whole` and any mark, so that a passage that very many texts
    share is one row of a batch where it is compared.
    """

    def list_runs(batches):
        for batch in (part for whole in batches for part in _by_bytes(whole)):
            ids = batch.column(0).fill_null(_LATE).to_numpy()
            keys = batch.column(1).to_numpy()
            data, bounds = _bytes_of(batch.column(2))
            parts = [x for x in mark_runs(data, bounds, length) if len(x[0])]
            if not parts:
                continue
            mark, whole, document, start, count, first = (np.concatenate(x) for x in zip(*parts, strict=True))
            mark, whole, doc_id, key, run = mark.view(np.int64), whole.view(np.int64), ids[document], keys[document], _packed(start, count, first)
            order = np.lexsort((run, key, doc_id, whole, mark))
            mark, whole, doc_id, key, run = (x[order] for x in (mark, whole, doc_id, key, run))
            new = np.concatenate([[True], (np.diff(mark) != 0) | (np.diff(whole) != 0)])
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = (doc_id != doc_id[lead]) | (key != key[lead]) | (run != run[lead])
            mark = np.where(later, run * np.int64(-7046029254386353131) ^ doc_id ^ key, mark)
            yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(whole, mask=later), pa.array(doc_id, mask=doc_id == _LATE), pa.array(key), pa.array(run)], ["mark", "whole", "doc_id", "text_key", "run"])

    return keyed.mapInArrow(list_runs, "mark long, whole long, doc_id long, text_key long, run long")


def _settled(runs: DataFrame) -> DataFrame:
    """(mark, doc_id, text_key, run): with null mark, runs that an earlier equal run covers; else runs whose mark other runs have too, one of each kind.

    Runs come to a task by their mark and in order; nothing but the last run
    seen is held.
    """

    def settle(batches):
        held = None  # mark, whole, doc_id, text_key and run of the last kind's first run; whether it is out already; whether its mark has more kinds
        for batch in batches:
            mark, doc_id, key, run = batch.column(0).to_numpy(), batch.column(2).fill_null(_LATE).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy()
            covered = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            whole = batch.column(1).fill_null(0).to_numpy()
            done = [(doc_id[covered], key[covered], run[covered])]
            mark, whole, doc_id, key, run = (x[~covered] for x in (mark, whole, doc_id, key, run))
            out, many = False, False
            if held is not None:
                mark, whole, doc_id, key, run = (np.concatenate([[h], x]) for h, x in zip(held[:5], (mark, whole, doc_id, key, run), strict=True))
                out, many = held[5:]
            asked = np.zeros(0, np.int64)
            if len(mark):
                new_mark = np.concatenate([[True], np.diff(mark) != 0])
                new = new_mark | np.concatenate([[True], np.diff(whole) != 0])
                lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                later = (doc_id != doc_id[lead]) | (key != key[lead]) | (run != run[lead])
                done.append((doc_id[later], key[later], run[later]))
                group = np.cumsum(new_mark) - 1
                kinds = np.bincount(group, new)
                kinds[0] += many
                asked = np.flatnonzero(new & (kinds[group] > 1))
                more = bool(kinds[-1] > 1)
                if out and len(asked) and asked[0] == 0:
                    asked = asked[1:]
                at = int(lead[-1])
                held = (mark[at], whole[at], doc_id[at], key[at], run[at], more or (out and at == 0), more)
            ids, keys, rows = (np.concatenate([*(x[k] for x in done), last[asked]]) for k, last in enumerate((doc_id, key, run)))
            names = np.concatenate([np.zeros(len(ids) - len(asked), np.int64), mark[asked]])
            yield pa.RecordBatch.from_arrays([pa.array(names, mask=np.arange(len(ids)) < len(ids) - len(asked)), pa.array(ids, mask=ids == _LATE), pa.array(keys), pa.array(rows)], ["mark", "doc_id", "text_key", "run"])

    dealt = runs.repartition(shuffle_partitions(runs.sparkSession), "mark").sortWithinPartitions("mark", "whole", F.col("doc_id").asc_nulls_last(), "text_key", "run")
    return written(dealt.mapInArrow(settle, "mark long, doc_id long, text_key long, run long"), "settled-runs")


def _joined_to_texts(keyed: DataFrame, per_doc: DataFrame, how: str) -> DataFrame:
    """per_doc has __id and __key. The texts are dealt out alike for every such join, so that Spark shuffles them once."""
    return keyed.join(per_doc, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), how)


def repeated_ranges(keyed: DataFrame, length: int = 100, together: int = TOGETHER) -> DataFrame:
    """Byte ranges [low, high) that strings of `length` bytes with an earlier equal cover: doc_id, text_key, low, high.

    keyed: from _keyed. Every string has a mark (mark_runs), and equal strings
    have equal marks. Runs of strings meet by their mark; equal runs (by two
    64-bit hashes) are one kind, all but whose first are covered. Kinds that
    share a mark are cut out of their texts and go by mark to the tasks that
    sort their suffixes and find equal strings byte by byte (repeated_starts).
    A mark with very many kinds is dealt out to several tasks by place; each
    finds what repeats within it, and strings that are first in their task are
    compared by 128-bit digests over all tasks.
    """
    spark = keyed.sparkSession
    settled = _settled(_runs(keyed, length))
    asked = settled.filter("mark is not null")
    # Marks with more kinds than go together are few: at most one in `together` rows.
    many = written(asked.groupBy(F.col("mark").alias("__mark")).agg(F.count("*").alias("__n")).filter(F.col("__n") > together), "common-marks", files=8)
    kinds = asked.join(many, F.col("mark") == F.col("__mark"), "left").withColumn("n", F.coalesce("__n", F.lit(1)))
    wanted = kinds.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_list(F.struct("mark", "n", "run")).alias("runs"))
    texts = _joined_to_texts(keyed, wanted, "inner").select("doc_id", "text_key", "text", F.col("runs.mark").alias("mark"), F.col("runs.n").alias("n"), F.col("runs.run").alias("run"))

    def cut_out(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                text = one.column(2).cast(pa.large_binary())[0].as_py()
                mark, n, run = (one.column(c).flatten().to_numpy() for c in (3, 4, 5))
                start, count, first = _unpacked(run)
                dealt = -(-n // together)
                salt = (start * 2654435761 + one.column(1)[0].as_py() % 1000003 * 40503 + (one.column(0)[0].as_py() or 0) % 1000003) % 1000003 % dealt
                for a in range(0, len(run), 50_000):
                    part = slice(a, a + 50_000)
                    content = [text[s : s + c + length - 1] for s, c in zip(start[part].tolist(), count[part].tolist(), strict=True)]
                    same = pa.array(np.zeros(len(content), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(mark[part]), pa.array(salt[part]), pa.array(dealt[part]), one.column(0).take(same), one.column(1).take(same), pa.array(run[part]), pa.array(content, pa.binary())], ["mark", "salt", "dealt", "doc_id", "text_key", "run", "content"])

    suffixes = texts.mapInArrow(cut_out, "mark long, salt long, dealt long, doc_id long, text_key long, run long, content binary")
    dealt = suffixes.repartition(shuffle_partitions(spark), "mark", "salt").sortWithinPartitions("mark", "salt")

    def sort_out(batches):
        names = ("mark", "salt", "dealt", "doc_id", "text_key", "run", "content")
        held: dict[str, np.ndarray] | None = None

        def result(rows):
            group = np.concatenate([[0], np.cumsum((np.diff(rows["mark"]) != 0) | (np.diff(rows["salt"]) != 0))])
            size = np.bincount(group)[group]
            keep = (size > 1) | (rows["dealt"] > 1)
            if not keep.any():
                return None
            rows = {k: v[keep] for k, v in rows.items()} | {"group": group[keep]}
            rows["start"], rows["count"], rows["first"] = _unpacked(rows["run"])
            (a, b, c, d), (digest, e, f, g) = _sorted_chunk(rows, length)
            ids, keys = np.concatenate([a, e]), np.concatenate([b, f])
            return pa.RecordBatch.from_arrays(
                [pa.array([None] * len(a) + digest, pa.binary()), pa.array(np.where(ids == _LATE, 0, ids), mask=ids == _LATE), pa.array(keys), pa.array(np.concatenate([c, g])), pa.array(np.concatenate([d, g + length]))],
                ["digest", "doc_id", "text_key", "low", "high"],
            )

        for batch in batches:
            new = {}
            for k, name in enumerate(names):
                column = batch.column(k)
                if name == "content":
                    new[name] = np.empty(batch.num_rows, object)
                    new[name][:] = column.to_pylist()
                else:
                    new[name] = (column.fill_null(_LATE) if name == "doc_id" else column).to_numpy()
            held = new if held is None else {k: np.concatenate([held[k], new[k]]) for k in names}
            if len(held["mark"]) >= SORTED:
                whole = (held["mark"] != held["mark"][-1]) | (held["salt"] != held["salt"][-1])
                last = int(whole.sum())  # the last group may go on in the next batch
                if last:
                    out = result({k: v[:last] for k, v in held.items()})
                    held = {k: v[last:] for k, v in held.items()}
                    if out is not None:
                        yield out
        if held is not None and len(held["mark"]) and (out := result(held)) is not None:
            yield out

    found = dealt.mapInArrow(sort_out, "digest binary, doc_id long, text_key long, low long, high long")
    # Ranges pass with a key of their own beside the strings that are compared by digest.
    key = F.coalesce("digest", F.concat(F.lit("range"), F.coalesce("doc_id", F.lit(-1)).cast("string"), F.lit(":"), "text_key", F.lit(":"), "low").cast("binary"))
    order = Window.partitionBy("key").orderBy(F.col("doc_id").asc_nulls_last(), "text_key", "low")
    sorted_out = found.withColumn("key", key).withColumn("nth", F.rank().over(order)).filter("digest is null or nth > 1").select("doc_id", "text_key", "low", "high")
    start = F.expr("shiftright(run, 16)")
    covered = settled.filter("mark is null").select("doc_id", "text_key", start.alias("low"), (start + F.expr("shiftright(run, 8) & 255") + length - 1).alias("high"))
    return covered.union(sorted_out)


def without_repeats(docs: DataFrame, length: int = 100, together: int = TOGETHER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every byte that a string of `length` bytes covers which also starts earlier (smaller id, or same document and earlier start).

    Strings are judged on the texts as they are, never across documents.
    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), spans
    (their [low, high)), and kept, the remaining bytes: a row for every row of
    docs. Null texts are empty; null ids count as larger than any other; rows
    that repeat an id and a text are one document (neither removes from the
    other), rows that repeat an id with another text are documents of their
    own; an empty table gives no rows.
    """
    if not MARK < length <= 254 + MARK:  # a run has length - MARK + 1 starts at most, which are kept in 8 bits
        raise ValueError(f"length must be over {MARK} and {254 + MARK} at most")
    keyed = _keyed(docs, id_col, text_col)
    ranges = repeated_ranges(keyed, length, together)
    per_doc = ranges.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    rows = _joined_to_texts(keyed, per_doc, "left").select("doc_id", "text", F.col("spans.low").alias("low"), F.col("spans.high").alias("high"))

    def remove(batches):
        for batch in batches:
            spans, kept, size = [], [], []
            texts = batch.column(1).cast(pa.large_binary())
            for k in range(batch.num_rows):
                text, low = texts[k].as_py(), batch.column(2)[k]
                size.append(len(text))
                if not low.is_valid:
                    spans.append([])
                    kept.append(text)
                    continue
                low, high = low.values.to_numpy(), batch.column(3)[k].values.to_numpy()
                rank = np.argsort(low, kind="stable")
                low, high = low[rank], np.maximum.accumulate(high[rank])
                new = np.concatenate([[True], low[1:] > high[:-1]])
                low, high = low[new], high[np.append(np.flatnonzero(new)[1:] - 1, len(high) - 1)]
                spans.append([{"low": a, "high": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)])
                kept.append(b"".join(text[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(text)], strict=True)))
            removed = [n - len(x) for n, x in zip(size, kept, strict=True)]
            kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return rows.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<low:long,high:long>>, kept binary")
