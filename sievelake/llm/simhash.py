"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from .common import drop_tables, packed_row, quoted, shuffle_partitions, table_mark, text_of, unpacked, written
from .components import components

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Shingles whose bits are counted at once.
_COUNTED = 1 << 16
#: Seeded fingerprints of a text. Texts with a similarity of 0.8 share one of the 64 segments of 16 bits in 99 of 100 cases.
SEEDS = 16
#: Fingerprints compared at first and among classes not joined yet, and the bits in which those may differ. Texts with a
#: similarity of 0.8 differ in 39 of 256 bits and 154 of 1,024 with spreads of 6 and 11 (short ones in fewer), texts with one
#: of 0.63 in 220 of 1,024 with a spread of 13: most pairs of a large loose group are not held against their texts.
FIRST, SECOND = (4, 64), (16, 196)
#: Up to so many rows (two numbers each) whose texts are looked up go to every task; with more, texts are dealt out to them.
BROADCAST_ROWS = 500_000
_FACTORS = np.random.default_rng(42).integers(1 << 63, size=SEEDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(utf8: bytes, words: int = 3, seed: int = 42) -> int:
    """SimHash of a text: bit i is 1 if set in over half the XXH64 of its shingles."""
    parts = utf8.translate(_LOWER).split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= words:
        shingles = [line]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = [0, *(ends[: -words] + 1).tolist()]
        shingles = [line[a:b] for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(shingles), _COUNTED):
        codes = b"".join(map(xxh64_digest, shingles[k : k + _COUNTED], repeat(seed)))
        ones += np.unpackbits(np.frombuffer(codes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): the 64 bits as a signed long. Null and blank texts have 0."""

    def make(batches):
        for batch in batches:
            made = np.array([fingerprint(t, words, seed) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], ["doc_id", "fingerprint"])

    kind = docs.select(F.col(quoted(id_col)).alias("id")).dtypes[0][1]
    return docs.select(F.col(quoted(id_col)).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(make, f"doc_id {kind}, fingerprint long")


def _stars(prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (b, a) that join all of prints within reach of one another over steps of at most `most` bits.

    Grows one component at a time; a fingerprint is compared only with those
    that no component has yet, so a dense group costs a few passes.
    """
    links, rest = [], prints
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= most
            links += zip(rest[near].tolist(), repeat(int(x)))
            front += list(rest[near])
            rest = rest[~near]
    return links


def _without(value: str, low: int, high: int, width: int) -> str:
    """SQL for the bits of a value of `width` bits without those from low to high, moved together."""
    kept = f"({value} & {(1 << low) - 1}L)"
    return kept if high >= width else f"((shiftrightunsigned({value}, {high}) << {low}) | {kept})"


def met_under_values(prints: DataFrame, most: int = 3, segments: int = 2, hot: int = 256, least_bits: int = 14) -> DataFrame:
    """(key, entry, fingerprint): what is compared under each key. Any two fingerprints at `most` or fewer differing bits share a key.

    A fingerprint is an entry under each segment's value, and looks up all
    values in the Hamming ball of radius 1 around it. A value with over `hot`
    entries in its ball is split by the bits outside the segment: cut into
    most + 1 parts, two that near have some part alike, so each part's value
    makes a key of its own. A key that is still hot is split by the bits left,
    and so on while over least_bits are left: then so few different
    fingerprints can share it that one task holds them.
    """
    width, spark = 64 // segments, prints.sparkSession
    radius, mask = most // segments, (1 << width) - 1
    if radius > 1 or segments not in (2, 4, 8):
        raise ValueError("segments must be 2, 4 or 8, and over most / 2")
    # 3 bits of a key are the segment, the others its value.
    own = [f"(((shiftrightunsigned(fingerprint, {s * width}) & {mask}L) << 3) | {s}L)" for s in range(segments)]
    keys = [f"named_struct('key', {k}, 'entry', true)" for k in own]
    if radius:
        keys += [f"named_struct('key', {k} ^ {1 << (bit + 3)}L, 'entry', false)" for k in own for bit in range(width)]
    dealt = prints.repartition(shuffle_partitions(spark), "fingerprint")
    met = dealt.select("fingerprint", F.explode(F.expr(f"array({', '.join(keys)})")).alias("k")).select("k.key", "k.entry", "fingerprint")
    crowded = dealt.select(F.explode(F.expr(f"array({', '.join(own)})")).alias("key")).groupBy("key").count().filter(F.col("count") > hot)
    around = ", ".join(["key", *(f"key ^ {1 << (bit + 3)}L" for bit in range(width) if radius)])
    crowded = written(crowded.select(F.explode(F.expr(f"array({around})")).alias("key")).distinct(), "crowded", files=8)
    rest = "case key & 7L " + " ".join(f"when {s} then {_without('fingerprint', s * width, (s + 1) * width, 64)}" for s in range(segments)) + " end"
    met, left, parts = met.withColumn("rest", F.expr(rest)), 64 - width, []
    while left > least_bits and not crowded.isEmpty():
        parts.append(met.join(crowded, "key", "left_anti").select("key", "entry", "fingerprint"))
        edges = [left * j // (most + 1) for j in range(most + 2)]
        cuts = list(enumerate(zip(edges, edges[1:], strict=False)))
        finer = [f"named_struct('key', xxhash64(key, {j}, shiftrightunsigned(rest, {lo}) & {(1 << (hi - lo)) - 1}L), 'rest', {_without('rest', lo, hi, left)})" for j, (lo, hi) in cuts]
        left -= min(hi - lo for _, (lo, hi) in cuts)
        met = met.join(crowded, "key", "left_semi").select("entry", "fingerprint", F.explode(F.expr(f"array({', '.join(finer)})")).alias("k"))
        met = written(met.select("k.key", "entry", "fingerprint", "k.rest"), "split-values")
        crowded = written(met.groupBy("key").count().filter(F.col("count") > (width + 1) * hot).select("key"), "crowded", files=8)
    out = met.select("key", "entry", "fingerprint")
    for part in parts:
        out = out.union(part)
    return out


def near_links(prints: DataFrame, most: int = 3, segments: int = 2, hot: int = 256) -> DataFrame:
    """Links (a, b) with which fingerprints at `most` or fewer differing bits are connected as by all such pairs.

    prints: distinct (fingerprint), none null; an empty table gives no links.
    Multi-index hashing: of two fingerprints that near, some segment differs in
    at most most // segments bits, so they meet under a value of it
    (met_under_values) and are verified over all 64 bits. Instead of all pairs,
    which a dense group has too many of, only the links that connect them are
    returned. Every fingerprint met is compared, none is capped.
    """
    spark = prints.sparkSession
    dealt = met_under_values(prints, most, segments, hot).repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")

    def verify(key: np.ndarray, entry: np.ndarray, codes: np.ndarray):
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        ends = np.append(starts[1:], len(key))
        held = np.add.reduceat(entry.astype(np.int64), starts)
        out = []
        for k in np.flatnonzero((ends - starts > 1) & (held > 0)):
            out += _stars(np.unique(codes[starts[k] : ends[k]]).view(np.uint64), most)
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def link(batches):
        held: list[list[np.ndarray]] = []  # of the last key, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            last = int(np.searchsorted(new[0], new[0][-1]))
            if held and (last or held[-1][0][0] != new[0][0]):
                held.append([x[:last] for x in new])
                yield verify(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            elif last:
                yield verify(*(x[:last] for x in new))
            held.append([x[last:] for x in new])
        if held:
            yield verify(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return dealt.mapInArrow(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, most: int = 3, segments: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of near-duplicates: doc_id, fingerprint (signed long), component_id (the group's smallest id).

    Equal fingerprints are one node each, so that copies never meet in pairs;
    near_links joins different ones, components follows the links. Texts
    without words have fingerprint 0 and are linked like any other; repeated
    rows are kept; null ids are kept, and count as larger than any other; an
    empty table gives no rows.
    """
    mark = table_mark()
    coded = written(fingerprints(docs, words, seed, id_col, text_col), "fingerprints")
    distinct = written(coded.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    group = components(near_links(distinct.select("fingerprint"), most, segments))
    named = distinct.join(group, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "first_id", F.coalesce("component", "fingerprint").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    members = written(named.join(least, "component").select("fingerprint", "component_id"), "fingerprint-members")
    drop_tables(docs.sparkSession, mark, (coded, members))
    return coded.join(members, "fingerprint").select("doc_id", "fingerprint", "component_id")


# ---- near-duplicates whose texts are held against each other -----------------


def shingle_hashes(utf8: bytes, words: int = 5, seed: int = 42) -> np.ndarray:
    """XXH64 of the distinct shingles of a text, sorted; none for a text without words."""
    parts = utf8.translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        shingles = [line]
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = [0, *(ends[: -words] + 1).tolist()]
        shingles = [line[a:b] for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)]
    return np.unique(np.frombuffer(b"".join(map(xxh64_digest, shingles, repeat(seed))), ">u8").astype(np.uint64))


def seeded_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """SEEDS SimHashes of a set of shingles, each from the shingles' hashes mixed with another factor."""
    ones = np.zeros(64 * SEEDS, np.int64)
    for k in range(0, len(hashes), 255):  # a byte counts so many
        x = hashes[k : k + 255, None] * _FACTORS
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def _apart(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(-1, dtype=np.int64)


def _joining_pairs(codes: np.ndarray, part: np.ndarray | None, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of near codes: without parts, links that join all within reach; else all pairs of unlike parts."""
    if part is not None:
        found = [(b, a) for a in range(len(codes) - 1) for b in (a + 1 + np.flatnonzero((part[a + 1 :] != part[a]) & (_apart(codes[a + 1 :], codes[a]) <= most))).tolist()]
    else:
        found, rest = [], np.arange(len(codes))
        while len(rest) > 1:
            front, rest = [rest[0]], rest[1:]
            while front and len(rest):
                x = front.pop()
                near = _apart(codes[rest], codes[x]) <= most
                found += zip(rest[near].tolist(), repeat(int(x)))
                front += list(rest[near])
                rest = rest[~near]
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def near_pairs(classes: DataFrame, compared: int, most: int) -> DataFrame:
    """Candidate pairs (a, b) among classes (class, codes, and maybe part), a > b.

    Multi-index hashing over all seeded fingerprints: a class enters a table
    under each 16-bit segment of each, and classes that meet under a value are
    compared over the first `compared` fingerprints. Without parts, the links
    that connect near ones under a value are returned and not all pairs, which
    a dense group has too many of; with parts (their components so far), all
    near pairs of unlike parts are. None is capped.
    """
    with_part = "part" in classes.columns
    names = ["key", "class", *[f"c{k}" for k in range(compared)], *(["part"] if with_part else [])]
    kinds = ", ".join(f"`{n}` long" for n in names)

    def enter(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                codes = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint64).reshape(-1, SEEDS)
                tables = 4 * SEEDS
                keys = codes.view(np.uint16).astype(np.int64) + (np.arange(tables, dtype=np.int64) << 16)
                rest = [some.column(0).to_numpy(), *codes[:, :compared].view(np.int64).T, *([some.column(2).to_numpy()] if with_part else [])]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *[pa.array(np.repeat(x, tables)) for x in rest]], names)

    def compare(rows: np.ndarray):
        key, node, codes = rows[0], rows[1], rows[2 : 2 + compared].T.copy().view(np.uint64)
        edges = np.flatnonzero(np.diff(key, prepend=key[0] - 1, append=key[-1] + 1))
        starts, size = edges[:-1], np.diff(edges)
        # Values under which any two are near: small ones are compared at once, row with row at a distance d.
        hit = size > 64
        left = np.repeat(np.where(hit, 0, size), size) - (np.arange(len(key)) - np.repeat(starts, size))
        group = np.repeat(np.arange(len(size)), size)
        for d in range(1, 64):
            i = np.flatnonzero(left > d)
            if not len(i):
                break
            hit[group[i[_apart(codes[i], codes[i + d]) <= most]]] = True
        out = [np.zeros((2, 0), np.int64)]
        for k in np.flatnonzero(hit):
            at = slice(starts[k], starts[k] + size[k])
            a, b = _joining_pairs(codes[at], rows[-1][at] if with_part else None, most)
            out.append(np.array([np.maximum(node[at][a], node[at][b]), np.minimum(node[at][a], node[at][b])]))
        a, b = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def link(batches):
        held = np.zeros((len(names), 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.array([batch.column(c).to_numpy() for c in range(len(names))]).reshape(len(names), -1)], axis=1)
            last = int(np.searchsorted(held[0], held[0][-1])) if held.shape[1] else 0  # the last value may go on in the next batch
            if last:
                yield compare(held[:, :last])
                held = held[:, last:]
        if held.shape[1]:
            yield compare(held)

    met = classes.select("class", "codes", *(["part"] if with_part else [])).mapInArrow(enter, kinds)
    dealt = met.repartition(shuffle_partitions(classes.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(link, "a long, b long").distinct()


def close_pairs(pairs: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """The pairs (a, b) of classes (class, codes) whose seeded fingerprints, all of them, differ in `most` bits at most."""

    def near(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, SEEDS) for c in (2, 3))
            yield batch.filter(pa.array(np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= most)).select(["a", "b"])

    left = classes.select(F.col("class").alias("a"), F.col("codes").alias("x"))
    right = classes.select(F.col("class").alias("b"), F.col("codes").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(near, "a long, b long")


def similar(pairs: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """The pairs (a, b) whose sets (class, shingles) have a Jaccard similarity of `alike` or more."""
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return both.filter(F.col("shared") >= alike * (F.col("n") - F.col("shared")) - 1e-9).select("a", "b")


def first_of_similar(docs: DataFrame, words: int = 5, alike: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each group of near-duplicates; all columns as they are.

    Two texts are near-duplicates if their sets of `words`-word shingles have a
    Jaccard similarity of `alike` or more; groups are joined by such pairs.
    Texts with equal sets are one class, so that copies never meet in pairs.
    Candidates come from near_pairs: first links that connect dense groups,
    then, of classes that these have not joined, all near pairs. Those near in
    all fingerprints are held against the sets themselves, so no row goes
    without a partner. The first row has the smallest id, null last, and of
    equal ids the smallest hash of the text. Decisions go back by a key written
    with the rows, for ids may be null or repeated. Null and blank texts have
    no shingles and are one class; an empty table gives no rows.
    """
    kind = docs.select(F.col(quoted(id_col)).alias("id")).dtypes[0][1]
    mark = table_mark()
    keyed = written(docs.select(packed_row(docs), F.monotonically_increasing_id().alias("nth")), "near-rows")
    rows = keyed.select("nth", F.col(f"row.{quoted(id_col)}").alias("doc_id"), F.coalesce(F.col(f"row.{quoted(text_col)}").cast("string"), F.lit("")).alias("text"))

    def code(batches):
        for batch in batches:
            made = []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                hashes = shingle_hashes(text, words)
                made.append((xxh64_intdigest(text), xxh64_intdigest(hashes.tobytes()), seeded_fingerprints(hashes).tobytes()))
            numbers = np.array([x[:2] for x in made], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(numbers[:, 0]), pa.array(numbers[:, 1]), pa.array([x[2] for x in made], pa.binary())], ["row", "doc_id", "text_hash", "class", "codes"])

    def shingle(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                made = shingle_hashes(batch.column(1)[k].cast(pa.binary()).as_py(), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([made], pa.list_(pa.int64()))], ["class", "shingles"])

    coded = written(rows.mapInArrow(code, f"row long, doc_id {kind}, text_hash long, class long, codes binary"), "near-codes")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "row")
    classes = written(coded.groupBy("class").agg(F.min(order).alias("first"), F.min("codes").alias("codes")), "near-classes")
    drop_tables(docs.sparkSession, mark, (keyed, classes))

    def held_against_texts(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "near-pairs")
        asked = written(classes.join(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), "class").select("class", F.col("first.row").alias("nth")), "near-asked")
        side = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
        sets = written(rows.join(side, "nth").select("class", "text").mapInArrow(shingle, "class long, shingles array<long>"), "near-sets")
        return written(similar(pairs, sets, alike), "near-links")

    tried = written(near_pairs(classes, *FIRST), "near-tried")
    links = held_against_texts(close_pairs(tried, classes, SECOND[1]))
    group = components(links)
    met = tried.select(F.col("a").alias("class")).union(tried.select("b")).distinct()
    parts = written(classes.join(met, "class").join(group, F.col("class") == F.col("node"), "left").select("class", "codes", F.coalesce("component", "class").alias("part")), "near-parts")
    more = held_against_texts(near_pairs(parts, *SECOND).join(tried, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        group = components(links.union(more))
    named = classes.join(group, F.col("class") == F.col("node"), "left").select("first", F.coalesce("component", "class").alias("part"))
    firsts = written(named.groupBy("part").agg(F.min("first").alias("first")).select(F.col("first.row").alias("nth")), "near-firsts")
    drop_tables(docs.sparkSession, mark, (keyed, firsts))
    return keyed.join(firsts, "nth", "left_semi").select(*unpacked(docs.columns))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The first row of each near-duplicate group, that with the smallest id (null last); all columns as they are.

    Decisions go back by a key written with the rows, for ids may be null or repeated.
    """
    keyed = written(docs.select(packed_row(docs), F.monotonically_increasing_id().alias("nth")), "near-rows")
    own = keyed.select("nth", F.col(f"row.{quoted(id_col)}").alias("id"), F.col(f"row.{quoted(options.pop('text_col', 'text'))}").alias("text"))
    groups = near_duplicates(own, id_col="nth", **options).select(F.col("doc_id").alias("nth"), "component_id")
    order = F.struct(F.col("id").isNull(), "id", "nth")
    firsts = groups.join(own.select("nth", "id"), "nth").groupBy("component_id").agg(F.min(order).alias("first"))
    return keyed.join(firsts.select(F.col("first.nth").alias("nth")), "nth", "left_semi").select(*unpacked(docs.columns))
