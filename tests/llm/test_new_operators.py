"""The filter audit, passage removal and whitening against brute force over the same rows."""

import collections
import hashlib
import itertools
import math
import re
import tracemalloc
import zlib
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import prose

from sievelake.llm import audit, passages, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LATE = float("inf")


# ---- passages --------------------------------------------------------------


def brute_passages(rows, window):
    """(id, removed flags) of every row, in order of rows."""
    words = [WORD.findall(r[1] or "") for r in rows]
    ids = [LATE if r[0] is None else r[0] for r in rows]
    least = {}
    for i, ws in zip(ids, words, strict=True):
        for s in range(len(ws) - window + 1):
            key = tuple(ws[s : s + window])
            least[key] = min(least.get(key, LATE), i)
    out = []
    for i, ws in zip(ids, words, strict=True):
        gone = [False] * len(ws)
        for s in range(len(ws) - window + 1):
            if least[tuple(ws[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        out.append((ws, gone))
    return out


def passage_rows():
    """Rows with passages inside lines, wrapped otherwise, under and over the window, across copies, and within one document twice."""
    passage = prose(4242, 40).split()
    made = []
    for i in range(30):
        inside = passage[: 20 + 3 * (i % 15)]
        text = " ".join(prose(50 + i, 15).split() + inside) + "\n" + "\t ".join(prose(90 + i, 20).split())
        made.append((i, text))
    made += [(40, prose(8, 300)), (41, prose(8, 300)), (39, prose(8, 300) + " tail"), (38, prose(9, 80) + " " + prose(9, 80))]
    made += [(41, "the same id " + prose(8, 300)), (None, prose(8, 300)), (None, prose(8, 300)), (50, prose(4, 3000)), (51, "x " + prose(4, 3000)), (7, None), (60, ""), (61, "a " * 400), (62, "a " * 500)]
    return made


@pytest.mark.parametrize(("indexed", "together"), [(1 << 20, 8192), (500, 2)])
@pytest.mark.parametrize("window", [50, 12])
def test_passages(spark, indexed, together, window):
    rows = passage_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in passages.without_passages(docs, window, indexed, together).collect())
    want = collections.Counter((r[0], len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone, strict=True) if not g)) for r, (ws, gone) in zip(rows, brute_passages(rows, window), strict=True))
    assert got == want
    assert sum(k[2] for k in want.elements()) > 1000


def test_passages_of_samples(docs, doc_rows, no_docs):
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in passages.without_passages(docs).collect())
    assert got == collections.Counter((r[0], len(ws), sum(gone)) for r, (ws, gone) in zip(doc_rows, brute_passages(doc_rows, 50), strict=True))
    assert passages.without_passages(no_docs).count() == 0


def test_passage_spans(spark):
    docs = spark.createDataFrame([(1, prose(3, 100)), (2, "before " + prose(3, 100) + " after")], "doc_id long, text string")
    found = {r.doc_id: [(s.low, s.high) for s in r.spans] for r in passages.without_passages(docs).collect()}
    assert found == {1: [], 2: [(1, 1 + len(prose(3, 100).split()))]}


def test_common_grams_change_no_result(spark):
    """A line in every document is no mark where there is another, and windows around it are found all the same."""
    line = " ".join(f"line{k}" for k in range(30))
    rows = [(i, f"{prose(700 + i // 2, 40)} {line} {prose(800 + i // 2, 40)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    assert len(passages.common_grams(keyed.repartition(1), 0.5)) >= 23
    got = {r.doc_id: r.n_removed for r in passages.without_passages(docs.repartition(1)).collect()}
    assert got == {r[0]: sum(gone) for r, (_, gone) in zip(rows, brute_passages(rows, 50), strict=True)}


def test_window_is_bounded(docs):
    for window in (8, 255):
        with pytest.raises(ValueError, match="window"):
            passages.without_passages(docs, window)


def test_wavelet_tree_ranks():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 37, 1000)
    tree = passages.WaveletTree(symbols, 37)
    symbol, place = rng.integers(0, 37, 500), rng.integers(0, 1001, 500)
    assert [int(x) for x in tree.rank(symbol, place)] == [int((symbols[:p] == s).sum()) for s, p in zip(symbol, place, strict=True)]


def test_matching_statistics():
    """Queries that the index has in part, with words that it lacks; matches are cut and go on."""
    rng = np.random.default_rng(2)
    for _ in range(25):
        alphabet, depth = int(rng.integers(1, 5)), int(rng.integers(1, 9))
        sizes, asked = rng.integers(1, 25, rng.integers(1, 8)), rng.integers(1, 25, 5)
        symbols, queries = rng.integers(0, alphabet, sizes.sum()), rng.integers(-1, alphabet, asked.sum())
        index = passages.FMIndex(symbols, sizes, alphabet, depth)
        lengths, places = index.matching_statistics(queries, asked)
        held = np.split(symbols, np.cumsum(sizes)[:-1])
        of = collections.defaultdict(set)
        for n, seq in enumerate(held):
            for i, d in itertools.product(range(len(seq)), range(1, depth + 1)):
                if i + d <= len(seq):
                    of[tuple(seq[i : i + d])].add(n)
        start = 0
        for n in asked:
            for i in range(n):
                fits = [d for d in range(1, depth + 1) if i + d <= n and tuple(queries[start + i : start + i + d]) in of]
                assert lengths[start + i] == max(fits, default=0)
                if fits:
                    assert index.sequence[places[start + i]] in of[tuple(queries[start + i : start + i + max(fits)])]
            start += n


# ---- filter audit ----------------------------------------------------------


def brute_audit(rows, labels):
    """rows: doc_id, text, source; labels: doc_id, quality, toxic."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in rows:
        least[text or ""] = min(least.get(text or "", LATE), LATE if i is None else i)
    fails = []
    for i, text, _ in rows:
        text = text or ""
        ws = WORD.findall(text)
        a = {"A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": least[text] < (LATE if i is None else i)}
        fails.append({k for k, v in a.items() if v})
    out = {}
    for part in {r[2] or "" for r in rows}:
        own = [(r, f) for r, f in zip(rows, fails, strict=True) if (r[2] or "") == part]
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order):
                before = set(order[:step])
                removed = [r for r, f in own if letter in f and not f & before]
                shapley[letter] += len(removed)
                out[part, "".join(order), step + 1] = [
                    sum(not f & (before | {letter}) for _, f in own),
                    len(removed),
                    sum(letter in f and bool(f & before) for _, f in own),
                    sum(f == {letter} for _, f in own),
                    sum(r[0] in good for r in removed),
                    sum(r[0] in toxic for r in removed),
                    letter,
                ]
        for key, v in out.items():
            if key[0] == part and isinstance(v[-1], str):
                v[-1] = shapley[v[-1]]
    return out


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("size", [1 << 22, 300])
def test_audit(spark, docs, doc_rows, size):
    labels = [(i, int(i % 3 == 0), int(i % 4 == 0)) for i in range(0, 700, 2)] + [(0, 0, 1), (5, None, 1), (None, 1, 1), (9, 1, None), (9, 0, 0)]
    got = audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), size=size).collect()
    want = brute_audit([(r[0], r[1], r[3]) for r in doc_rows], labels)
    assert {(r.part, r.filter_order, r.step): [r[n] for n in NAMES] for r in got} == want
    assert len(got) == len(want) == 600 * 4


def test_audit_empty(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.filter_audit(no_docs, labels).count() == 0


def test_audit_signs(spark):
    """Each filter at its bound, and capitals beyond ASCII, which are none."""
    words = [f"w{k}" for k in range(65)]
    rows = [(1, " ".join(words[:50]), "a"), (2, " ".join(words[:49]), "a"), (3, " ".join(words + words[:35]), "b"), (4, " ".join(words[:64] + words[:36]), "b"), (5, "ABCDE" + "x" * 95, ""), (6, "ABCDEF" + "x" * 94, None), (7, "É" * 100, "a"), (8, "x|", "a"), (9, "x|", "b"), (9, "x|", "b"), (None, "x|", "c"), (None, "x|", "c")]
    got = audit.filter_audit(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame([(2, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): [r[n] for n in NAMES] for r in got} == brute_audit(rows, [(2, 1, 1)])


@pytest.mark.parametrize("ranges", [4, 50])
def test_document_term_matrix(spark, ranges):
    texts = ["b a b", "", "c d a", None, "b c " * 3]
    rows = spark.createDataFrame([(i, "p", t or "") for i, t in enumerate(texts)], "doc_id long, part string, text string").repartition(1)
    local = audit._local_shards(rows, 8, ranges)
    assert local.filter("range is null").count() > 2
    numbers = {bytes(r.word).decode(): r.number for r in audit.dictionary(local).collect()}
    assert len(set(numbers.values())) == len(numbers) == 4
    found = {}
    for shard in audit.document_term_matrix(rows, 8).collect():
        for k, doc in enumerate(shard.docs):
            a, b = shard.starts[k], shard.starts[k + 1]
            found[doc.doc_id] = dict(zip(shard.columns[a:b], shard.counts[a:b], strict=True))
    # The matrix has four ranges here, one for each shuffle partition; numbers of others differ.
    if ranges == 4:
        assert found == {i: {numbers[w]: n for w, n in collections.Counter(WORD.findall(t or "")).items()} for i, t in enumerate(texts)}


@pytest.mark.parametrize("piece", [1, 7, 40, 1 << 20])
def test_words_by_pieces(monkeypatch, piece):
    """Words and counts are the same wherever texts are cut, and texts without words have no entries."""
    monkeypatch.setattr(audit, "PIECE", piece)
    texts = ["b a b", "", " \t\n", "c d a " * 9, "é" * 30, "a", " b  c ", "", "aa\rb\x0bé b" * 5]
    words, hashes, entry, counts = audit.count_words([t.encode() for t in texts])
    words = [w.decode() for w in words.to_pylist()]
    assert hashes.tolist() == sorted(zlib.crc32(w.encode()) for w in words) and len(set(words)) == len(words)
    assert entry.tolist() == sorted(set(entry.tolist()))
    found = collections.defaultdict(dict)
    for e, n in zip(entry.tolist(), counts.tolist(), strict=True):
        found[e >> 32][words[e & 0xFFFFFFFF]] = n
    assert found == {k: c for k, t in enumerate(texts) if (c := collections.Counter(WORD.findall(t)))}
    assert [len(x) for x in audit.count_words([b"", b" "])] == [0] * 4


def test_shard_memory(monkeypatch):
    """A shard's making takes less than twelve times its texts, short ones here."""
    monkeypatch.setattr(audit, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    build = audit._local_shards(SimpleNamespace(mapInArrow=lambda f, _: f), 16 << 20, 211)
    rng = np.random.default_rng(1)
    words = np.array([f"{k * 7919 % 300_007:x}" for k in range(300_000)])
    texts = [" ".join(words[(300_000 * rng.random(200) ** 3).astype(int)]) for _ in range(8_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(["p"] * len(texts)), pa.array(texts)], ["doc_id", "part", "text"])
    size = sum(map(len, texts))
    del texts, words
    tracemalloc.start()  # Python's objects and numpy's
    try:
        made = [b.num_rows for b in build(iter([batch]))]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert made == [1, 211] and size > 8e6 and most < 12 * size, (made, size, most)


# ---- whitening -------------------------------------------------------------


def test_cross_products():
    rng = np.random.default_rng(5)
    for width in (1, 3, 20, 50):
        values = rng.integers(0, 1 << width, (130, 4))
        values[:, 2] = 0
        widths = np.array([int(v).bit_length() for v in values.max(0)])
        products, sums = whitening.cross_products(*whitening.bit_planes(values, widths), 4)
        exact = values.astype(object)
        assert [[int(v) for v in row] for row in np.triu(products)] == [[int(v) for v in row] for row in np.triu(exact.T @ exact)]
        assert [int(v) for v in sums] == [int(v) for v in exact.sum(0)]


def vectors():
    rng = np.random.default_rng(6)
    mix = rng.normal(size=(5, 5))
    made = [(i, (rng.normal(size=5) @ mix).tolist()) for i in range(300)]
    made += [made[0], made[1], (None, made[2][1]), (400, None), (401, [1.0, None, 0.0, 0.0, 0.0]), (402, [1.0, float("nan"), 0.0, 0.0, 0.0]), (403, [float("inf")] + [0.0] * 4), (404, []), (405, [1.0, 2.0]), (406, [1e30] + [0.0] * 4), (407, [0.0] * 5), (408, [-0.001] * 5)]
    return made


def brute_whitened(rows, size, k):
    """Deviations, eigenvalues and projections up to signs, from whole numbers of any size."""
    used = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) and abs(c) < 1e15 for c in v)]
    n, sums = len(used), [sum(x[d] for _, x in used) for d in range(size)]
    cov = np.array([[float(Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for _, x in used), n**3)) for a in range(size)] for b in range(size)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return used, n, sums, cov, values, axes


def test_whitening(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"n": F.lit(1), "vec": F.lit("v"), "a.b": F.lit(2)}).repartition(4)
    got = whitening.whitened(df, components=3).collect()
    used, n, sums, cov, values, axes = brute_whitened(rows, 5, 3)
    assert len(got) == 3 * len(used) and {r.n for r in got} == {n}
    deviation = collections.Counter((i, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))) for i, x in used)
    assert collections.Counter((r.vec_id, int(r.deviation)) for r in got) == collections.Counter({k: 3 * v for k, v in deviation.items()})
    by = collections.defaultdict(list)
    for r in got:
        by[r.component].append(r)
    for c in range(3):
        whole = {i: float(np.dot([float(Fraction(v * n - s, n)) for v, s in zip(x, sums, strict=True)], axes[:, c]) / math.sqrt(values[c])) for i, x in used}
        sign = np.sign(sum(r.whitened * whole[r.vec_id] for r in by[c + 1]))
        assert max(abs(r.whitened - sign * whole[r.vec_id]) for r in by[c + 1]) < 1e-9
        assert {round(r.explained, 12) for r in by[c + 1]} == {round(values[c] / np.trace(cov), 12)}
    assert {r.identity_error for r in got}.pop() < 1e-9 and len({r.identity_error for r in got}) == 1


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitening.whitened(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whitening.whitened(spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(5)], schema)).collect()
    assert len(flat) == 15 and [r.whitened is None for r in flat if r.vec_id == 1] == [False, True, True]
    assert max(r.identity_error for r in flat) < 1e-9
    far = whitening.whitened(spark.createDataFrame([(1, [3e16, 0.0]), (2, [-3e16, 1.0]), (3, [0.0, 5.0])], schema)).collect()
    xs = [[math.floor(64 * c) + 1000000 for c in v] for v in ([3e16, 0.0], [-3e16, 1.0], [0.0, 5.0])]
    sums = [sum(x[d] for x in xs) for d in range(2)]
    assert {r.vec_id: int(r.deviation) for r in far} == {i + 1: sum((3 * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in enumerate(xs)}


def test_whitening_of_table(spark):
    got = whitening.whitened(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")).toPandas()
    assert len(got) == 500 * 32
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(w.T @ w / len(w) - np.eye(32)).max() < 1e-9 and got.identity_error.max() < 1e-9
