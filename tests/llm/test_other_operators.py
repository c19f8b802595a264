"""Operators on vectors, URLs and pages, and the pipeline."""

import base64
import collections
import gzip
import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievelake.llm import neighbours, shards, urls, warc
from sievelake.llm.queries import URL_RULES

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors():
    rng = np.random.default_rng(1)
    made = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 8) + 3 * np.eye(8)[i % 4]], 0) for i in range(600)]
    made += [(1000 + i, made[7][1], 0) for i in range(40)]  # copies: ties go to smaller ids
    made += [(2000 + i, [2.0 * x for x in made[50][1]], 0) for i in range(3)]
    made += [(3000, None, 0), (3050, [0.0] * 8, 0), (3100, [float("nan")] + [1.0] * 7, 0), (3150, [float("inf")] + [1.0] * 7, 0), (3200, [None] + [1.0] * 7, 0), (3250, [], 0)]
    made += [(None, made[0][1], 0), (3300, [1.0, 2.0, 3.0], 0), (3301, [1.0, 2.0, 2.0], 0), made[100], made[100]]
    return made


def sequential_cosine(a, b):
    dot = aa = bb = 0.0
    for x, y in zip(a, b, strict=True):
        dot, aa, bb = dot + x * y, aa + x * x, bb + y * y
    return dot / (math.sqrt(aa) * math.sqrt(bb))


def brute_nearest(rows, every, k):
    ok = {i: v for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in ok.items():
        if q % every == 0:
            scores = sorted((-sequential_cosine(v, w), i) for i, w in ok.items() if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def test_exact_search(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTORS).withColumns({"rank": F.lit(1), "shard": F.lit(2), "dim": F.lit(3)})
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, every=50, k=5, shard_rows=100, block_rows=7).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    assert {q: v for q, v in brute_nearest(rows, 50, 5).items() if v} == dict(got)


def test_relaxed_search_recall(spark):
    rows = vectors()
    want = brute_nearest(rows, 10, 5)
    got = collections.defaultdict(set)
    for r in neighbours.nearest(spark.createDataFrame(rows, VECTORS), every=10, k=5, factor=2.0).collect():
        got[r.query_id].add(r.vec_id)
    found = sum(len(got[q] & {i for i, _ in v}) for q, v in want.items())
    assert found >= 0.9 * sum(map(len, want.values()))


def test_tree_prunes(spark):
    """In few dimensions factor 1 leaves most leaves out and is still exact."""
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(0, 0.02, (500, 3)) + np.eye(3)[k % 3] * (1 if k < 3 else -1) for k in range(6)])
    tree, seen = neighbours.VantageTree(np.arange(len(v)), v), []
    kept = neighbours.cosine
    try:
        neighbours.cosine = lambda a, b: seen.append(len(a)) or kept(a, b)
        ids, _ = tree.search(np.arange(0, 3000, 100), v[::100], 3, 1.0)
    finally:
        neighbours.cosine = kept
    units = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q, row in zip(range(0, 3000, 100), ids, strict=True):
        s = units @ units[q]
        s[q] = -9
        assert np.allclose(np.sort(s)[::-1][:3], s[row])
    assert sum(seen) < 30 * 3000 / 4


def test_regions_are_skipped(spark):
    """In few dimensions most regions are ruled out at factor 1, and the result is still exact."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (40, 4))
    rows = [(i, [float(x) for x in centres[i % 40] + rng.normal(0, 0.02, 4)], 0) for i in range(2000)]
    df = spark.createDataFrame(rows, VECTORS.replace("float", "double"))
    usable = neighbours.usable_vectors(df)
    parts = neighbours.partitions(usable, shard_rows=50)
    placed = neighbours.written(neighbours._placed(usable, parts), "placed-vectors")
    index = neighbours.vantage_index(placed, parts, 50)
    asked, got = placed.filter("vec_id % 20 = 0"), collections.defaultdict(list)
    for r in neighbours.search_index(index, asked, parts).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    trees = [(t.region, t.low, t.high, neighbours.VantageTree.load(t.tree)) for t in index.orderBy("region", "shard").collect()]
    queries = asked.orderBy("vec_id").toPandas()
    least = np.array([got[q][-1][1] for q in queries.vec_id])
    block = queries.vec_id.to_numpy(), np.array(queries.vector.tolist()), queries.region.to_numpy(), least
    sent = neighbours.search_trees(trees, parts[4].points, block, 5, 1.0, False)[2]
    assert len({t[0] for t in trees}) > 20 and asked.count() == 100
    assert sent < 0.2 * 100 * len(trees)
    got = {q: [i for i, _ in v] for q, v in got.items()}
    want = brute_nearest(rows, 20, 5)
    assert {q: [i for i, _ in v] for q, v in want.items()} == dict(got)


def test_large_region_is_parted(spark):
    """One region for all: bands of distance and, for a third of equal vectors, hashes keep shards small; several blocks and spans give the exact result."""
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(x) for x in rng.normal(0, 1, 3)], 0) for i in range(1500)]
    usable = neighbours.usable_vectors(spark.createDataFrame(rows, VECTORS.replace("float", "double")))
    parts = neighbours.partitions(usable, shard_rows=50, most=1)
    placed = neighbours.written(neighbours._placed(usable, parts), "placed-vectors")
    index = neighbours.vantage_index(placed, parts, 50)
    sizes = [r.n for r in index.collect()]
    assert sum(sizes) == 1500 and len(sizes) >= 30 and max(sizes) <= 100
    kept, got = neighbours.SPAN, collections.defaultdict(list)
    try:
        neighbours.SPAN = 2
        for r in neighbours.search_index(index, placed.filter("vec_id % 20 = 0"), parts, block_rows=15).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
    finally:
        neighbours.SPAN = kept
    want = brute_nearest(rows, 20, 5)
    assert {q: [i for i, _ in v] for q, v in want.items()} == {q: [i for i, _ in v] for q, v in got.items()}


def test_queries_are_shuffled_once(spark):
    """A query's vector goes to one file, however many shards there are; the search shuffles trees and no vectors of queries."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 16)], 0) for i in range(2000)]
    usable = neighbours.usable_vectors(spark.createDataFrame(rows, VECTORS.replace("float", "double")))
    parts = neighbours.partitions(usable, shard_rows=20)
    placed = neighbours.written(neighbours._placed(usable, parts), "placed-vectors")
    index = neighbours.vantage_index(placed, parts, 20)
    folder = neighbours.fresh_path(spark, "blocks")
    ranges = {16: index.groupBy("region").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()}
    made = neighbours.write_blocks(placed.filter("vec_id % 10 = 0").withColumn("least", F.lit(None).cast("double")), ranges, parts, folder, 4)
    assert made.agg(F.sum("n")).first()[0] == 200 and index.count() > 100
    held = [neighbours._read_block(folder, 16, b) for b in range(4)]
    assert sorted(i for h in held if h is not None for i in h[0]) == list(range(0, 2000, 10))
    assert neighbours._read_block(folder, 17, 0) is None
    plan = neighbours._searched(index, parts, folder, 4, 5, 1.0, True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "query-blocks" not in plan


def test_names_with_dots(spark):
    """Columns that the caller names may hold dots and backticks."""
    rows = [(1, "one two", "x"), (2, None, None), (3, "one two", "y")]
    odd = shards.interleaved_shards(spark.createDataFrame(rows, "`a.b` long, `c.d` string, `e``f` string"), 2, id_col="a.b", text_col="c.d", source_col="e`f")
    assert sorted(r.doc_id for r in odd.collect()) == [1, 2, 3]
    pages = spark.createDataFrame([(i, f"http://a/{i}", text) for i, text, _ in rows], "`a.b` long, `c.d` string, `e``f` string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archived_pages(pages, id_col="a.b", url_col="c.d", html_col="e`f").collect()}
    assert got == {1: ("revisit", 3), 2: ("response", None), 3: ("response", None)}


def test_search_empty(spark):
    assert neighbours.nearest(spark.createDataFrame([], VECTORS)).count() == 0


def brute_url(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    held = [(len(r), v, r) for v, r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(held)[1:] if held else (None, None)


URLS = ["http://A.Example.com/en/x?y=1#z", "https://www.example.com/en/", "https://example.com/en/a", "http://com/", "http://com", "http://x.net/es/1", "http://x.net/de/1", "ftp://Ünï.net/fr/?", "nothing", "", None, "a://b://c/d", "http://?x", "http://h#/x", "://", "http://a.com?u=http://b.net/es/", "http://notexample.com/en/", "HTTP://WWW.EXAMPLE.COM/en/\nx", "http://x.org/1-2-3?a=1&b=2&c=%20"]


def test_url_rules(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS * 30)] + [(1, None, "h"), (None, URLS[0], "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "rule": F.lit("y"), "features": F.lit("z"), "label": F.lit(5)})
    got = urls.url_verdicts(df, URL_RULES).collect()
    assert len(got) == len(rows)
    by_id = {i: u for i, u, _ in rows[: len(URLS) * 30]}
    for r in got:
        if r.page_id is None or r.page_id == 1:
            continue
        host, path = brute_url(by_id[r.page_id])
        verdict, rule = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), by_id[r.page_id]
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_url_one_label_or_none(spark):
    df = spark.createDataFrame([(1, "http://a.com/", ""), (2, "http://b.org/", "")], "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urls.url_verdicts(df, URL_RULES).collect()} == {1: "allow", 2: "allow"}
    assert {r.verdict for r in urls.url_verdicts(df, [("block", "com/")]).collect()} == {"block"}
    assert {r.verdict for r in urls.url_verdicts(df, []).collect()} == {"allow"}
    assert urls.url_verdicts(df.filter("page_id > 5"), URL_RULES).count() == 0


def test_url_trees_held_out(spark):
    """Trees learn lexical classes and hold on URLs they have not seen."""
    good = [(f"https://site{i}.example.org/articles/garden-{i % 7}", 0) for i in range(300)]
    bad = [(f"http://x{i * 7919}.biz{i % 3}/p?id={i}&s={i * 31}&t={i * 17}&u=1", 1) for i in range(300)]
    rows = good + bad
    train = spark.createDataFrame(rows[::2], "url string, label int")
    test = spark.createDataFrame([(k, u, y) for k, (u, y) in enumerate(rows[1::2])], "page_id long, url string, y int")
    got = urls.url_verdicts(test, [], labelled=train).join(test.select("page_id", "y"), "page_id").collect()
    assert sum((r.verdict == "block") == (r.y == 1) for r in got) >= 0.97 * len(got)


def brute_features(url, held):
    """The features of a URL in plain Python; held: suffix to (labelled, blocked) rows."""
    host, path = brute_url(url)
    shares = [url.count(c) / len(url) for c in set(url)]
    query = url.split("?", 1)[1].split("#")[0] if "?" in url else ""
    suffix = host.rsplit(".", 1)[-1]
    n, blocked = held.get(suffix, (0, 0))
    digits = sum(c in "0123456789" for c in url) / len(url)
    own = [len(url), len(host), host.count("."), len(path), path.count("/"), digits, host.count("-"), -sum(x * math.log2(x) for x in shares), len(query.split("&")) if query else 0, int("#" in url), int(url.startswith("https:")), len(suffix)]
    return [*own, math.log1p(n), (blocked + 1) / (n + 2)]


def tree_value(node, x):
    while node.subtreeDepth():
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


def test_url_tree_verdicts(spark):
    """Every verdict of the trees follows from features in plain Python and a walk down the trees; no label is among its own statistics."""
    rows = [(k, f"http://{'x' * (k % 7)}a{k}.{('biz', 'org', 'info')[k % 3]}/p{k % 5}/?q={k}{'&z=1' * (k % 4)}", "") for k in range(240)]
    labelled = spark.createDataFrame([(u, int(u.count("&") > 1 or ".biz" in u)) for _, u, _ in rows], "url string, label int")
    h, p = urls.url_parts(F.col("url"))
    known = labelled.select("url", h.alias("host"), p.alias("path"), "label")
    model, statistics = urls.fit_url_trees(known)
    held = {r.suffix: (sum(x.n for x in r.by_part), sum(x.blocked for x in r.by_part)) for r in statistics.collect()}
    assert held["biz"] == (80, 80)
    got = {r.page_id: r.verdict for r in urls.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), [], labelled=labelled).collect()}
    trees, weights = [t._call_java("rootNode") for t in model.trees], model.treeWeights
    for k, u, _ in rows:
        x = brute_features(u, held)
        margin = sum(w * tree_value(t, x) for t, w in zip(trees, weights, strict=True))
        if abs(margin) > 1e-9:
            assert got[k] == ("block" if margin > 0 else "allow"), u
    # Out of fold: a suffix that one host alone has tells the trees nothing of it.
    alone, names = urls._featured(known.limit(1).withColumns({"host": F.lit("only.one"), "label": F.lit(1)}), urls.suffix_statistics(known.limit(1).withColumns({"host": F.lit("only.one"), "label": F.lit(1)}), "host", "label"), True)
    assert alone.select("f_suffix_share", "f_suffix_rows").first() == (0.5, 0.0)


def pages():
    made = [(i, f"http://h{i}.org/{i}", f"<p>page {i} été {'x' * (i % 50)}</p>") for i in range(60)]
    made += [(100 + i, f"http://c.org/{i}", "<p>copy</p>") for i in range(25)]
    made += [(200, "u", None), (201, "u", ""), (202, None, "a\r\n\r\nWARC/1.1\r\n\r\n"), (203, "u\r\nX: y", "漢字" * 2000), (59, "again", made[59][2]), (59, "again", "other"), (None, "n", "<p>copy</p>"), (300, "long", "z" * 3_000_000)]
    return made


@pytest.mark.parametrize("smallest", [0, 20])
def test_warc_round_trip(spark, smallest):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha1": F.lit("x"), "payload": F.lit("y"), "archive": F.lit("z")}).repartition(3)
    got = warc.archived_pages(df, smallest=smallest).collect()
    largest = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if i is not None:
            largest[b] = max(i, largest.get(b, i))
    want = collections.Counter()
    for i, _, html in rows:
        b = (html or "").encode()
        revisit = len(b) >= smallest and i != largest[b]
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", largest[b] if revisit else None] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want


def test_warc_files(spark, tmp_path):
    """Archives start as one stream; after normalising, each index entry is a gzip member of its own with the right record."""
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(df, str(tmp_path))
    index = warc.normalise_archives(archives, str(tmp_path)).collect()
    assert sum(r.records for r in archives.collect()) == len(index) == len(pages())
    by_archive = collections.defaultdict(list)
    for r in index:
        by_archive[r.archive].append(r)
    for name, rows in by_archive.items():
        data = open(name, "rb").read()
        whole = open(name.replace("/members/", "/whole/"), "rb").read()
        assert gzip.decompress(data) == gzip.decompress(whole)
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            member = gzip.decompress(data[r.offset : r.offset + r.length])
            assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n") and r.record_id.encode() in member
            at += r.length
        assert at == len(data)
        side = [json.loads(x) for x in open(f"{name}.index")]
        assert [(x["offset"], x["length"]) for x in side] == sorted((r.offset, r.length) for r in rows)


def test_warc_empty(spark):
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark, docs, no_docs, tmp_path):
    sf = str(tmp_path / "sf")
    docs.write.parquet(f"{sf}/documents.parquet")
    stage, kept = docs, []
    for name, f in corpus_pipeline.STAGES:
        stage = f(spark, stage, sf)
        stage.write.parquet(f"{sf}/{name}")
        stage = spark.read.parquet(f"{sf}/{name}")
        kept.append(stage.count())
        if name != "packing":
            assert stage.columns == docs.columns, name
    assert kept[0] < docs.count() and kept[2] <= kept[1] <= kept[0]
    assert corpus_pipeline.run(spark, sf).count() == kept[-1]
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, no_docs, sf).count() == 0, name
