"""Small frames with exact answers."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelake.functions import align
from sievelake.functions.numbers import two_decimals
from sievelake.functions.similarity import hybrid_score, normal
from sievelake.operators import advise, dash, dedup, drift, evaluate, gold, history, infer, metrics, outliers, profile, profile_state, quantiles, relate, repair, search, semantic, sinks, validate, versions, zones
from sievelake.plans import queries_core
from sievelake.plans.quality_run import TableSpec, run
from sievelake.sources import read
from sievelake.sources.read import guarded_query, read_jdbc
from sievelake.streaming import stream


def test_names():
    assert align.clean_name(" a b;;c(d)=\n") == "a_b_c_d"


@given(st.text(alphabet=" ,;{}()\n\t=abcXYZ_1", max_size=30))
@settings(max_examples=200, deadline=None)
def test_clean_names_are_clean(name):
    out = align.clean_name(name)
    assert not set(out) & set(" ,;{}()\n\t=") and "__" not in out and out == out.strip("_") and align.clean_name(out) == out


def test_rename_keeps_taken_names(spark):
    df = spark.createDataFrame([(1, 2)], "`Order-ID` int, order_id int")
    assert align.rename_to_spec(df, ["order_id"]).columns == ["Order-ID", "order_id"]
    assert align.rename_to_spec(df.select("`Order-ID`"), ["order_id"]).columns == ["order_id"]


def test_timestamps(spark):
    texts = ["2024-03-05 01:02:03", "2024-03-05T01:02:03", "2024-03-05T01:02:03Z", "2024-03-05T01:02:03.000Z", "2024-03-05T01:02:03.000", "2024-03-05 01:02:03.000", "2024-03-05", "05/03/2024", "03/25/2024", "1709600523", "1709600523000", "x", "", None, "31/02/2024", "05-03-2024", "2024/03/05"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(align.parse_timestamp(F.col("t")).cast("string")).collect()]
    day = "2024-03-05 00:00:00"
    assert got == ["2024-03-05 01:02:03"] * 6 + [day] * 2 + ["2024-03-25 00:00:00"] + ["2024-03-05 01:02:03"] * 2 + [None] * 6


def test_numbers(spark):
    got = spark.createDataFrame([("$ 1,234.50",), ("-3",), ("x",), (None,)], "t string").select(align.parse_double(F.col("t")), align.parse_int(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(1234.5, 123450), (-3.0, -3), (None, None), (None, None)]


def test_dates(spark):
    texts = {"21 Jul 2569": "2026-07-21", "5/3/2567": "2024-03-05", "2567-3-5": "2024-03-05", "05-03-2024": "2024-03-05", "soon": "soon", "21 Xyz 2020": "2020-01-21"}
    texts |= {"2024/3/5": "2024-03-05", "2567/03/05": "2024-03-05", "on 1  August 2020 at": "2020-08-01", "a-b-c": "a-b-c", "1-2": "1-2", "": None, None: None, "2024-03-05 10:00": "2024-03-05 10:00"}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", repair.standardize_date(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in got} == texts


def test_type_checks_see_the_text(spark):
    df = align.align_types(spark.createDataFrame([("12",), ("abc",), ("",), (None,)], "n string"), {"n": "IntegerType"})
    assert [r[0] for r in df.select(validate.type_checks({"n": "IntegerType"})).collect()] == [None, "invalid_type_n", None, None]


def test_range_reasons_join(spark):
    df = spark.createDataFrame([(5.0, -1.0), (200.0, -1.0), (None, 3.0)], "a double, b double")
    got = [r[0] for r in df.select(validate.range_rules({"a": (0, 100), "b": (0, None)})).collect()]
    assert got == ["out_of_range_b", "out_of_range_a; out_of_range_b", None]


def test_keep_latest_with_null_keys(spark):
    df = spark.createDataFrame([(1, "2024-01-01", 1), (1, "2024-02-01", 2), (None, "2024-01-01", 3), (None, None, 4), (2, None, 5)], "k int, d string, r int")
    kept, resolved = dedup.keep_latest(df, ["k"], "d", ["r"])
    assert sorted(r.r for r in kept.collect()) == [2, 3, 4, 5]
    assert resolved.first()[0] == 1


def test_rejected_rows_hide_no_clean_row(spark):
    """A row without a price is newer than a sound row of its key: the sound one stays."""
    df = spark.createDataFrame([(1, "2024-01-01", 5.0, 1), (1, "2024-02-01", None, 2)], "k int, d string, price double, r int")
    tagged, row = run(df, TableSpec("t", ["k"], "d", ["price"], tie=["r"]), "r1")
    assert {r.r: r.zone for r in tagged.collect()} == {1: "clean", 2: "quarantine"}
    one = row.first()
    assert (one.total_records, one.clean_records, one.quarantine_breakdown) == (2, 1, {"null_value_in_price": 1})


def test_empty_run(spark):
    df = spark.createDataFrame([], "k int, d string, price double, r int")
    _, row = run(df, TableSpec("t", ["k"], "d", ["price"], {"price": (0, None)}, ["price"], tie=["r"]), "r1")
    assert (row.first().total_records, row.first().quality_score) == (0, 0.0)


def test_outlier_details(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 100]] + [(None,)], "v double")
    flagged = outliers.flag_iqr(df, outliers.iqr_bounds(df, ["v"]), ["v"]).filter(F.size("outliers") > 0).collect()
    assert [r.outliers for r in flagged] == [["v=100.00 (expected [-1.00, 7.00])"]]


def test_duplicate_masks(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (None, 4), (2, 5)], "k int, r int")
    marks = {k: sorted(r.r for r in zones.duplicate_mask(df, ["k"], k, ["r"]).filter("is_duplicate").collect()) for k in ("first", "last", "none")}
    assert marks == {"first": [2, 4], "last": [1, 3], "none": [1, 2, 3, 4]}


@pytest.mark.parametrize("bad", ["price; drop", "a -- b", "system('x')!", "a | b"])
def test_expressions_are_guarded(spark, bad):
    with pytest.raises(ValueError):
        repair.calculate(spark.range(1), "x", bad)


@pytest.mark.parametrize("bad", ["delete from t", "select 1; select 2", "/* x */ update t", "with a as (select 1) select 1"])
def test_queries_are_guarded(bad):
    with pytest.raises(ValueError):
        guarded_query(bad)


def test_guarded_query_passes():
    assert guarded_query("-- all\n SELECT 1 ;") == "SELECT 1"


def _hybrid(a: str, b: str) -> float:
    """The score in plain Python."""
    if a == b:
        return 1.0
    grams = [[s[k : k + 2] for k in range(len(s) - 1)] for s in (a, b)]
    share = lambda x, y: len(set(x) & set(y)) / min(len(set(x)), len(set(y))) if x and y else 0.0
    bags = [Counter(g) for g in grams]
    norms = [sum(v * v for v in bag.values()) ** 0.5 for bag in bags]
    cosine = sum(n * bags[1][g] for g, n in bags[0].items()) / (norms[0] * norms[1]) if all(norms) else 0.0
    score = 0.4 * (a in b or b in a) + 0.3 * (share(a.split(), b.split()) or share(*grams)) + 0.3 * cosine
    return 1.0 if score >= 0.95 else round(score, 6)


def test_hybrid_score(spark):
    texts = ["apple pie", "pie", "abc", "xyz", "night", "nacht", "a", "b", "high priority", "high", "5-lo", "5-low", "ข้าวผัด", "ข้าวผัดกุ้ง", "a x", "y a", "aaaa aa"]
    pairs = [(a, b) for a in texts for b in texts]
    got = {(r.a, r.b): r.s for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", hybrid_score(F.col("a"), F.col("b")).alias("s")).collect()}
    assert {k: pytest.approx(v, abs=2e-6) for k, v in got.items()} == {(a, b): _hybrid(a, b) for a, b in pairs}
    assert got["high priority", "high"] == pytest.approx(0.85, abs=0.02) and got["5-lo", "5-low"] == 1.0
    one = spark.createDataFrame([(" Data Warehouse\t",)], "a string").select(normal(F.col("a"))).first()[0]
    assert one == "data warehouse"


def test_best_matches(spark):
    """The best key of each value is that of all pairs; only a small part of the pairs that share a bigram is scored."""
    keys = [f"item {k * 7919 % 1000:03d} {w}" for k, w in enumerate(["alpha", "beta", "gamma", "delta"] * 60)] + ["a", "zz"]
    values = [k[:9] + k[10:] for k in keys[:80]] + [k[:-1] for k in keys[80:160]] + ["item", "999", "b", "a b", "quite another thing", "x"]
    frame = lambda texts: spark.createDataFrame([(t,) for t in sorted(set(texts))], "text string")
    got = {r.text: (r.key, r.score) for r in semantic.best_matches(frame(values), frame(keys)).collect()}
    want = {}
    for v in set(values):
        score, key = max(((_hybrid(v, k), k) for k in set(keys)), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        if score > 0:
            want[v] = (min(k for k in set(keys) if _hybrid(v, k) == score), score)
    assert {v: s for v, (_, s) in got.items()} == {v: pytest.approx(s, abs=2e-6) for v, (_, s) in want.items()}
    assert {v: k for v, (k, _) in got.items()} == {v: k for v, (k, _) in want.items()}
    x, y = semantic.ranked_texts(frame(values), frame(keys))
    whole = semantic.candidates(x, y, 0.0).count()
    assert semantic.candidates(x, y, 0.600001).count() < 0.05 * whole and semantic.candidates(x, y, 0.5).count() < 0.4 * whole


def test_safe_csv(spark):
    df = spark.createDataFrame([("=1+1", "-5", True, 1e9, "x"), ("@a", "+1.5", False, 0.25, "y"), ("-.5", "-1e5", None, None, "-x")], "a string, b string, c boolean, d double, e string")
    out = sinks.safe_csv(df, {"d": "n", "e": "n", "a": "=b"})
    assert out.columns == ["'=b", "b", "c", "n [d]", "n [e]"]
    assert [tuple(r) for r in out.collect()] == [("'=1+1", "-5", "TRUE", "1000000000", "x"), ("'@a", "+1.5", "FALSE", "0.25", "y"), ("-.5", "-1e5", None, None, "'-x")]
    assert sinks.header_labels(["a", "b", "c"], {"a": "b", "b": "b", "c": "a"}) == ["b [a]", "b", "a"]
    numbers = {1e16: "10000000000000000", 3.0: "3", 0.1: "0.1", -2.5e-7: "-0.00000025", 123456789.125: "123456789.125", 1.5e8: "150000000", -0.0: "0", float("inf"): "", float("nan"): "", 1.2345e10: "12345000000", 12345678901.25: "12345678901.25", 5e-324: "0." + "0" * 323 + "5"}
    got = spark.createDataFrame([(n,) for n in numbers], "n double").select(sinks.positional(F.col("n"))).collect()
    assert [r[0].rstrip("0") if n == 5e-324 else r[0] for n, r in zip(numbers, got, strict=True)][:-1] == list(numbers.values())[:-1]
    days = spark.createDataFrame([("2024-01-05", "2024-01-05"), ("2024-01-06", "2024-01-06 10:00:00.5"), (None, None)], "a string, b string").select(*[F.col(c).cast("timestamp").alias(c) for c in "ab"])
    assert [tuple(r) for r in sinks.safe_csv(days).collect()] == [("2024-01-05", "2024-01-05 00:00:00"), ("2024-01-06", "2024-01-06 10:00:00.500000"), (None, None)]


def test_tree_paths_negate_else_branches():
    text = "DecisionTreeClassificationModel\n  If (feature 0 <= 1.5)\n   Predict: 0.0\n  Else (feature 0 > 1.5)\n   If (feature 1 <= 2.0)\n    Predict: 1.0\n   Else (feature 1 > 2.0)\n    Predict: 0.0\n"
    assert advise._paths(text, ["a", "b"]) == ["a > 1.5 AND b <= 2.0"]


def test_ratio_metrics(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), (None, 3.0)], "g string, v double")
    m = {"numerator": {"agg": "count", "where": [["g", "eq", "(empty)"]]}, "denominator": {"agg": "count", "where": [["g", "eq", "zzz"]]}}
    assert df.agg(dash.metric(m)).first()[0] is None
    assert df.agg(dash.metric({"agg": "sum", "column": "v", "where": [["g", "eq", "b"]]})).first()[0] == 0


def test_class_balance(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), (" ",)], "c string")
    assert {r["class"]: r.n for r in profile.class_balance(df, "c").collect()} == {"a": 2, "NULL": 1, "SPACES": 1}


def test_failed_upsert_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.upsert(spark.createDataFrame([(1, "a")], "k int, v string"), path, ["k"])
    bad = spark.createDataFrame([(2, "x")], "k int, v string").withColumn("v", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        versions.upsert(bad, path, ["k"])
    assert [tuple(r) for r in versions.read(spark, path).collect()] == [(1, "a")]


def test_two_writers(spark, tmp_path, monkeypatch):
    """A writer that another overtakes between its reading and its publishing loses nothing: both rows are there."""
    path, publish, overtaken = str(tmp_path / "t"), versions._publish, []
    versions.upsert(spark.createDataFrame([(k, "old") for k in range(10)], "k int, v string"), path, ["k"])

    def late(s, p, version):
        if not overtaken:
            overtaken.append(version.number)
            versions.upsert(spark.createDataFrame([(3, "other"), (20, "other")], "k int, v string"), path, ["k"])
        publish(s, p, version)

    monkeypatch.setattr(versions, "_publish", late)
    assert versions.upsert(spark.createDataFrame([(3, "mine"), (30, "mine")], "k int, v string"), path, ["k"]).number == 2
    got = {r.k: r.v for r in versions.read(spark, path).collect()}
    assert overtaken == [1] and got == {k: "old" for k in range(10)} | {3: "mine", 20: "other", 30: "mine"}
    assert {r.k for r in versions.read(spark, path, number=0).collect()} == set(range(10))
    with pytest.raises(versions.Conflict):
        versions.replace(versions.read(spark, path), path, versions.at_version(spark, path, 1))


def test_upsert_writes_touched_files_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(10_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    versions.upsert(rows, path, ["k"], file_rows=200)
    before = {r.file for r in versions._file_list(spark, path, versions.latest(spark, path)).collect()}
    versions.upsert(rows.filter("k >= 5000 and k < 5100").withColumn("v", F.lit(-1)).withColumn("w", F.lit("new")), path, ["k"], file_rows=200)
    after = {r.file for r in versions._file_list(spark, path, versions.latest(spark, path)).collect()}
    assert len(before) >= 45 and len(before - after) <= 0.05 * len(before)
    got = versions.read(spark, path)
    assert got.columns == ["k", "v", "w"] and got.count() == 10_000 and got.filter("v = -1 and w = 'new'").count() == 100
    versions.upsert(spark.createDataFrame([(20_000, 1)], "k long, v long"), path, ["k"], file_rows=200)
    assert after < {r.file for r in versions._file_list(spark, path, versions.latest(spark, path)).collect()}
    assert set(versions.vacuum(spark, path, keep=1)) == before - after and versions.read(spark, path).count() == 10_001


def test_boxes_read_few_files(spark, tmp_path):
    """In Z order a box over either or both keys meets few files, and its rows are those of a scan; a reader of the version before goes on."""
    path = str(tmp_path / "t")
    rows = spark.range(20_000).select((F.col("id") % 200).alias("x"), F.format_string("n%03d", (F.col("id") * 7 % 250)).alias("y"), "id")
    versions.append(rows.repartition(4), path)
    before = versions.read(spark, path)
    versions.cluster(spark, path, ["x", "y"], file_rows=400)
    files = versions._file_list(spark, path, versions.latest(spark, path))
    total = files.count()
    for box, most in (({"x": (50, 60)}, 0.35), ({"y": ("n100", "n110")}, 0.35), ({"x": (50, 60), "y": ("n100", "n110")}, 0.12)):
        assert files.filter(versions.overlapping(box)).count() <= most * total
        want = rows
        for c, (a, b) in box.items():
            want = want.filter(F.col(c).between(a, b))
        assert sorted(versions.read(spark, path, box).collect()) == sorted(want.collect())
    assert total >= 45 and before.count() == versions.read(spark, path).count() == 20_000


def test_first_of_hot_keys(spark):
    """A third of the rows has a null key and a third one key: no window has more than a part of them, and firsts are those of one window."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, k * 37 % 1000, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, o int, r int").repartition(6)
    got = dedup.mark_first(df, ["k"], [F.col("o"), F.col("r")], "first")
    firsts = {}
    for k, o, r in rows:
        firsts[k] = min(firsts.get(k, (o, r)), (o, r))
    assert {(r.k, r.o, r.r) for r in got.filter("first").collect()} == {(k, *v) for k, v in firsts.items()} and got.count() == 3000
    twice = dedup.mark_first(df.select(F.lit(1).alias("k")), ["k"], [F.col("k")], "first")
    assert twice.filter("first").count() == 1


def test_zscores_come_after_the_other_rules(spark):
    """Means and deviations are those of rows without a reason: a row out of range does not hide an outlier."""
    rows = [(k, 10.0 + k % 3, k) for k in range(40)] + [(100, 60.0, 100), (101, 1e9, 101)]
    spec = TableSpec("t", ["k"], None, [], {"price": (0, 1e6)}, [], zscore=["price"], tie=["r"])
    tagged, _ = run(spark.createDataFrame(rows, "k int, price double, r int"), spec, "r1")
    assert {r.k: r.reject_reason for r in tagged.filter("zone = 'quarantine'").collect()} == {100: "price_zscore=6.21 (val=price deviates > 3.0\u03c3)", 101: "out_of_range_price"}


def test_tree_rules(spark):
    """Rows over 10 in a, or under 3 in b, are rejected: the tree finds both conditions and parts the rows without an error."""
    rows = [(float(a), float(b)) for a in range(20) for b in range(20)]
    df = spark.createDataFrame(rows, "a double, b double")
    bad = "a > 10 or b < 3"
    rules, auc = advise.tree_rules(df.filter(f"not ({bad})"), df.filter(bad), ["a", "b"])
    assert auc > 0.999
    held = df.select("a", "b", (F.expr(" or ".join(f"({r})" for r in rules)) == F.expr(bad)).alias("same"))
    assert held.filter("not same").count() == 0


def test_exact_quantiles(spark):
    """Quantiles and distinct counts of values dealt out over ranges are those of one sorted list; an empty column has none."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = [*map(float, rng.normal(0, 1, 500).round(2)), *[7.0] * 300, 1e12]
    df = spark.createDataFrame([(v, int(v) % 5, None) for v in x] + [(None, None, None)], "x double, y int, z double").repartition(7)
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = {r["column"]: r for r in quantiles.quantiles(df, {c: F.col(c) for c in ("x", "y", "z")}, shares).collect()}
    assert np.allclose(got["x"].q, np.quantile(x, shares)) and got["x"].n_distinct == len(set(x))
    assert np.allclose(got["y"].q, np.quantile([int(v) % 5 for v in x], shares)) and got["y"].n_distinct == 5
    assert got["z"].q == [None] * 6 and got["z"].n_distinct == 0
    plan = profile.distribution(df, ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "count(distinct" not in plan.lower()


def test_jdbc_rows(spark):
    """The guarded reader against the database that Spark itself brings along."""
    options = {"url": "jdbc:derby:memory:guarded;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.createDataFrame([(k, k * 2) for k in range(9)], "id int, twice int").write.format("jdbc").options(**options).option("dbtable", "pairs").save()
    assert {tuple(r) for r in read_jdbc(spark, options, 'SELECT "id", "twice" FROM pairs WHERE "id" > 5 -- the last', 10).collect()} == {(6, 12), (7, 14), (8, 16)}
    with pytest.raises(ValueError, match="over 4 rows"):
        read_jdbc(spark, options, 'SELECT "id" FROM pairs', 4)
    with pytest.raises(ValueError, match="single SELECT"):
        read_jdbc(spark, options, "SELECT 1 FROM pairs; DELETE FROM pairs", 4)


@pytest.mark.parametrize("t", [0.2, 0.35, 0.45, 0.6, 0.62, 0.85])
def test_similarity_join_loses_no_pair(spark, t):
    """All pairs whose score is high enough, held against the score of every pair; single characters too."""
    texts = ["copper", "copper wire", "wire copper", "copper wires", "a", "b", "ab", "xylophone", "5-low", "l", "low", "5-lo", "lowest", "the copper", "opper", "aaaa", "aa", "aaab"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    pairs = df.crossJoin(df.withColumnRenamed("x", "y")).withColumn("score", hybrid_score(F.col("x"), F.col("y"))).filter(F.col("score") >= t)
    want = {(r.x, r.y): r.score for r in pairs.collect()}
    assert {(r.a, r.b): r.score for r in semantic.similarity_join(df, df, "x", "x", t).collect()} == want


def test_detection_counts_dropped_rows(spark):
    """A row that is neither clean nor quarantined is a dropped one; of a repeated key the original is no error."""
    rows = spark.createDataFrame([(k, "k1" if k < 2 else f"k{k}") for k in range(7)] + [(7, None), (8, None)], "id int, key string")
    zoned = spark.createDataFrame([(0, "clean", None), (2, "quarantine", "r"), (3, "clean", None), (4, "quarantine", "q"), (6, "clean", None), (7, "clean", None), (8, "clean", None)], "id int, zone string, reject_reason string")
    truth = spark.createDataFrame([(0, None), (1, "duplicate"), (2, "bad"), (3, "bad"), (4, None), (5, None), (6, None), (7, None), (8, "duplicate")], "id int, error_type string")
    found = evaluate.outcomes(rows, zoned, truth, "id", ["key"])
    one = evaluate.detection(found).first()
    assert (one.rows, one.dropped, one.tp, one.fp, one.fn, one.tn) == (9, 2, 2, 2, 2, 3)
    assert {tuple(r) for r in evaluate.false_positives(found).collect()} == {("q", 1), ("dropped", 1)}


def test_upsert_keeps_one_row_of_a_key(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.upsert(spark.createDataFrame([(1, 5, "a"), (1, 4, "b"), (None, 1, "c")], "k int, o int, v string"), path, ["k"], ("o",))
    versions.upsert(spark.createDataFrame([(2, 1, "d"), (2, 2, "e"), (None, 2, "f")], "k int, o int, v string"), path, ["k"], ("o",))
    assert {tuple(r) for r in versions.read(spark, path).collect()} == {(1, 4, "b"), (None, 1, "c"), (2, 1, "d"), (None, 2, "f")}


def test_kafka_options():
    """What the reader asks Spark for, held without a broker: all topics from the earliest offset, and no failure on lost offsets."""

    class Reader:
        def __init__(self):
            self.asked = {}

        def format(self, name):
            self.asked["format"] = name
            return self

        def option(self, key, value):
            self.asked[key] = str(value).lower()
            return self

        def options(self, **pairs):
            self.asked |= {k: str(v).lower() for k, v in pairs.items()}
            return self

        def load(self):
            return self.asked

    class Session:
        readStream = Reader()

    asked = stream.kafka(Session(), "host:9092", "posts")
    assert asked["format"] == "kafka" and asked["kafka.bootstrap.servers"] == "host:9092" and asked["subscribe"] == "posts"
    assert asked["startingOffsets"] == "earliest" and asked["failOnDataLoss"] == "false"


def test_redaction(spark):
    names = ["uuid", "user_mobile", "tel", "Email", "first_name", "ssn_hash", "address_2", "order_id", "telephone", "hotel", "idea", "custkey", "key", "user", "region"]
    df = spark.createDataFrame([tuple("x" for _ in names), tuple(None for _ in names)], ", ".join(f"{n} string" for n in names))
    one, none = repair.redact(df, "region, unknown").collect()
    assert {n for n in names if one[n] == "<redacted>"} == {"uuid", "user_mobile", "tel", "Email", "first_name", "ssn_hash", "address_2", "order_id", "region"}
    assert set(none) == {None}


def test_reject_classes(spark):
    reasons = {"missing_date": "format_errors", "null_value_in_type": "null_values", "missing_primary_key": "null_values", "out_of_range_price": "unfixable", "outlier_price": "outliers", "unsupervised_anomaly": "outliers", "invalid_type_qty": "type_mismatch", "duplicate_records; null_value_in_x": "unfixable", None: "unfixable", "price=5 (expected [1, 2])": "unfixable"}
    got = {r: repair.categorize_rejects(spark.createDataFrame([(r,)], "reject_reason string")).first()["class"] for r in reasons}
    assert got == reasons


def test_falls_are_anomalies(spark):
    rows = [(f"r{k}", "t", k, 100, 50 + k % 2) for k in range(10)] + [("fall", "t", 10, 100, 1)]
    got = {r.run_id: (r.z, r.is_anomaly) for r in metrics.rate_anomaly(spark.createDataFrame(rows, "run_id string, table_name string, timestamp int, total_records int, quarantined_records int")).collect()}
    assert got["fall"] == (9.9, True) and not got["r9"][1]


def test_reasons_are_keys_without_values(spark):
    texts = {
        "a; b": ["a", "b"],
        "missing_date": ["missing_date"],
        "product_weight_g=40000 (expected [1.0, 9.0])": ["outlier_product_weight_g"],
        "score_zscore=4.2 (val=score deviates > 3.0)": ["zscore_score"],
        "a.b=5 | c.d": ["outlier_a_b", "c_d"],
        "price_zscore": ["price_zscore"],
        " ; |": ["unknown"],
        "": ["unknown"],
        None: ["unknown"],
    }
    df = spark.createDataFrame([(t,) for t in texts], "reject_reason string")
    assert {r.reject_reason: r.k for r in df.select("reject_reason", metrics.reasons_of(F.col("reject_reason")).alias("k")).collect()} == texts
    rows = spark.createDataFrame([("a; b",), ("a",), (None,)], "reject_reason string")
    assert {r.reason: r.n for r in metrics.reason_breakdown(rows).collect()} == {"a": 2, "b": 1, "unknown": 1}
    many = spark.createDataFrame([(f"r{k}",) for k in range(60) for _ in range(60 - k)], "reject_reason string")
    found = {r.reason: r.n for r in metrics.reason_breakdown(many).collect()}
    assert len(found) == 51 and found["other_reasons"] == sum(range(1, 11))


def test_operational_impact(spark):
    rows = [("missing_primary_key",), ("duplicate_records",), ("missing_date",), ("out_of_range_price",), ("out_of_range_qty; missing_date",), ("other",), ("",), (None,)]
    df = spark.createDataFrame(rows, "reject_reason string")
    percent = lambda *weights: round(100 * sum(weights) / 8, 4)
    assert metrics.operational_impact(df, {}).first()[0] == percent(1.0, 1.0, 0.5, 0.2, 0.5, 0.2)
    assert metrics.operational_impact(df, {"id": 0.6, "day": 0.3, "price": 0.8, "qty": 0.7}, ["id"], "day").first()[0] == percent(0.6, 0.6, 0.3, 0.8, 0.7, 0.2)


def test_financial_value(spark):
    df = spark.createDataFrame([("1.5", 2.0, 9.0), ("x", 3.0, 9.0)], "Sales string, price double, total_price double")
    assert metrics.financial_value(df).first()[0] == 1.5
    assert metrics.financial_value(df.select("price", "total_price")).first()[0] == 5.0
    assert metrics.financial_value(df.select("total_price")).first()[0] == 0.0


RUN = "run_id string, table_name string, timestamp string, total_records long, quarantined_records long, quarantined_financial_value double, quality_score double, quarantine_breakdown map<string,bigint>"


def _runs(spark, rows):
    return spark.createDataFrame(rows, RUN).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


def test_projection(spark):
    """A fall of two points a day through 100, 98, 96: under 90 on the fourth day, and the newest run misses no 95."""
    rows = [(f"r{k}", "t", f"2024-01-0{k + 1}", 10, 0, 0.0, 100.0 - 2 * k, {}) for k in range(3)] + [("x", "one", "2024-01-01", 10, 0, 0.0, 90.0, {})]
    rows += [(f"s{k}", "same", "2024-01-01", 10, 0, 0.0, s, {}) for k, s in enumerate((90.0, 94.0))]
    got = history.projection(_runs(spark, rows))
    falls = got.filter("table_name = 't'").orderBy("day").collect()
    assert [r.projected for r in falls] == [94.0, 92.0, 90.0, 88.0, 86.0, 84.0, 82.0]
    assert [(r.low, r.high) for r in falls][:2] == [(93.4, 94.6), (91.3, 92.7)]
    first = falls[0]
    assert (first.slope, first.stability, first.breach, first.days_until_crisis, first.impacted, first.severity) == (-2.0, 93.5, 99.9, 4, "Ingestion Pipeline Gateway", "WARNING")
    rises = got.filter("table_name = 'same'").orderBy("day").collect()
    assert (rises[0].projected, rises[0].low, rises[0].high, rises[0].slope, rises[0].breach, rises[0].severity) == (98.0, 96.3, 99.7, 4.0, 99.9, "LOW")
    assert got.filter("table_name = 'one'").count() == 0


def test_financial_impact(spark):
    rows = [("a", "t", "2024-01-01", 10, 5, 40.0, 50.0, {}), ("b", "u", "2024-01-01 05:00:00", 10, 2, 0.0, 80.0, {}), ("c", "u", "2024-01-02", 10, 3, None, 70.0, {}), ("d", "t", "2024-01-03", 10, 1, 7.0, 90.0, {}), ("e", "u", "2024-01-03 01:00:00", 10, 1, 900.0, 90.0, {})]
    got = [tuple(r) for r in gold.financial_impact(_runs(spark, rows)).orderBy("date").select("quarantined", "impact", "source", "cumulative", "most_impacted").collect()]
    assert got == [(7, 62.0, "mixed", 62.0, "t"), (3, 33.0, "flat_estimate", 95.0, "u"), (2, 907.0, "real_financial_value", 1002.0, "t")]


def test_cost_of_poor_data(spark):
    runs = _runs(spark, [("a", "t", "2024-01-01", 100, 8, 0.0, 92.0, {}), ("b", "t", "2024-01-02", 100, 12, 0.0, 88.0, {})])
    none = spark.createDataFrame([], "run_id string, timestamp string, severity int")
    one = history.cost_of_poor_data(runs, none).first()
    assert (one.correction, one.opportunity, one.risk, one.total, one.sales_impact_pct, one.inventory_impact_pct, one.sales_status, one.inventory_status) == (40, 50, 20, 110, 8.0, 4.0, "WARN", "OK")
    drifts = spark.createDataFrame([("a", "2024-01-01", 1), ("b", "2024-01-02", 5), ("b", "2024-01-02", 1)], "run_id string, timestamp string, severity int")
    one = history.cost_of_poor_data(runs.withColumn("quarantined_financial_value", F.lit(99.9)), drifts).first()
    assert (one.correction, one.opportunity, one.risk, one.inventory_impact_pct, one.inventory_status) == (40, 199, 120, 18.0, "CRITICAL")


def test_reason_clusters(spark):
    runs = _runs(spark, [("a", "t", "2024-01-01", 10, 9, 0.0, 1.0, {"old": 9}), ("b", "t", "2024-01-02", 10, 8, 0.0, 1.0, {"study=40_0 (expected [1, 2])": 2, "study=41_0": 1, "out_of_range_price": 4, "missing_date": 1}), ("c", "u", "2024-01-01", 10, 3, 0.0, 1.0, {}), ("d", "v", "2024-01-01", 10, 0, 0.0, 1.0, {})])
    got = [(r.table_name, r.place, r.reason, r.category, r.column, r.n, r.share) for r in history.clusters(runs).orderBy("table_name", "place").collect()]
    assert got == [
        ("t", 1, "out_of_range_price", "ค่านอกช่วงที่กำหนด", "price", 4, 50.0),
        ("t", 2, "outlier_study", "ค่าผิดปกติ (IQR)", "study", 3, 37.5),
        ("t", 3, "missing_date", "วันที่ว่าง", None, 1, 12.5),
        ("u", 1, "quarantined_u", "ถูกกักกัน (ไม่ระบุเหตุผล)", None, 3, 100.0),
    ]


def _roles(spark, values: dict):
    df = spark.createDataFrame([tuple(v) for v in zip(*values.values(), strict=True)], list(values))
    return {r["column"]: r for r in advise.column_roles(df).collect()}


def test_column_roles(spark):
    got = _roles(spark, {"message_count": [1, 200], "page_id": [1, 2], "passRate": [1.0, 99.0], "bigRate": [1.0, 101.0], "Sales": [1.5, 2.5], "age": [3, 200], "mins_open": [1, 2], "Hotel": ["a", "b"], "contact_name": ["x", "y"], "ชื่อลูกค้า": ["x", "y"], "country_code": ["a", "b"], "sku": [1, 2], "ยอดขาย": [1, 2], "storage": [1, 2], "e-mail": ["x", "y"]})
    told = {c: (r.role, r.unit, r.default_agg, r.is_personal) for c, r in got.items()}
    assert told == {
        "message_count": ("measure", "count", "sum", False),
        "page_id": ("identifier", None, None, False),
        "passRate": ("measure", "percent", "avg", False),
        "bigRate": ("measure", "number", "sum", False),
        "Sales": ("measure", "currency", "sum", False),
        "age": ("measure", "number", "avg", False),
        "mins_open": ("measure", "duration", "avg", False),
        "Hotel": ("dimension", None, None, False),
        "contact_name": ("dimension", None, None, True),
        "ชื่อลูกค้า": ("dimension", None, None, True),
        "country_code": ("dimension", None, None, False),
        "sku": ("identifier", None, None, False),
        "ยอดขาย": ("measure", "currency", "sum", False),
        "storage": ("measure", "number", "sum", False),
        "e-mail": ("dimension", None, None, True),
    }
    assert got["mins_open"].duration_unit == "minutes"


def test_health(spark):
    """Whole numbers and names are like keys, doubles are not; of many columns the first two keys, three gaps and two ranges."""
    rows = [(k, k + 0.5, f"n{k}", 123_456_789, k % 3, None if k % 2 else "a", None if k % 5 else "b", None if k % 10 else "c", "d" if k else None) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id int, amount double, name string, phone_no int, grade int, a string, b string, c string, d string")
    got = [(r["column"], r.check, r.value) for r in advise.health(df).collect()]
    assert [x for x in got if x[1] == "key_like"] == [("page_id", "key_like", 100.0), ("name", "key_like", 100.0)]
    assert [x for x in got if x[1] == "empty_pct"] == [("c", "empty_pct", 90.0), ("b", "empty_pct", 80.0), ("a", "empty_pct", 50.0)]
    assert {x[0] for x in got if x[1] == "range_min"} == {"amount", "grade"}


def test_health_of_all_columns(spark):
    """Without bounds every key, gap and number is there, ids too."""
    rows = [(k, k + 0.5, f"n{k}", f"m{k}", 123_456_789, k % 3, k % 4, *[None if k % n else "a" for n in (2, 4, 5, 10)]) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id int, amount double, name string, label string, phone_no int, grade int, level int, a string, b string, c string, d string")
    got = [(r["column"], r.check, r.value) for r in advise.health(df, keys=None, gaps=None, ranges=None, ids=True).collect()]
    assert [x[0] for x in got if x[1] == "key_like"] == ["page_id", "name", "label"]
    assert [(x[0], x[2]) for x in got if x[1] == "empty_pct"] == [("d", 90.0), ("c", 80.0), ("b", 75.0), ("a", 50.0)]
    assert {x[0]: x[2] for x in got if x[1] == "range_max"} == {"page_id": 19.0, "amount": 19.5, "phone_no": 123_456_789.0, "grade": 2.0, "level": 3.0}


def test_health_checks_query(spark):
    """The query gives the range of the id as well as those of other numbers."""
    got = {(r["column"], r.check) for r in queries_core.health_checks(spark, "/root/testdata/sf0.001").collect()}
    assert {(c, f"range_{k}") for c in ("c_custkey", "c_nationkey", "c_acctbal") for k in ("min", "max")} <= got


def test_column_kinds(spark):
    rows = [(k, k, float(k), f"t{k}", f"x{k % 3}", f"y{k % 30}", True, f"d{k % 40}", 1) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, n int, f double, t string, c string, s string, b boolean, created_at string, score_id int")
    kinds = {r["column"]: r.kind for r in profile.columns(df).collect()}
    assert kinds == {"id": "Identifier", "n": "Integer", "f": "Float", "t": "Identifier", "c": "Categorical", "s": "String", "b": "Boolean", "created_at": "Date", "score_id": "Identifier"}


def test_range_anomalies(spark):
    df = spark.createDataFrame([(-1.0, -1, 121, 130, -1.0, 101, -5.0)], "income double, bal int, storage int, average_cost int, exchange_rate double, humidity int, discount double")
    assert {r["column"]: r.issue for r in profile.range_anomalies(df).collect()} == {"income": "negative_money", "storage": "impossible_age", "average_cost": "impossible_age", "exchange_rate": "percentage_outside", "humidity": "percentage_outside"}


def test_class_column(spark):
    df = spark.createDataFrame([("a.b", "x", f"k{k}", k % 2) for k in range(30)], "Region string, Status string, key string, ROLE int")
    assert profile.class_column(df) == "ROLE" and profile.class_column(df.drop("ROLE")) == "Status"
    assert profile.class_column(df.select("key")) is None
    assert [tuple(r) for r in profile.class_balance(df, "Region").collect()] == [("a_b", 30)]


def test_recommended_rules(spark):
    rows = [("C-101", 28, "Female", 55000), ("C-102", 34, "Male", 62000), ("C-103", None, "Female", 48000), ("C-104", 145, "Male", 75000), ("C-105", 42, "Female", 3500000), ("C-106", 31, "Non-Binary", 58000), ("C-101", 28, "Female", 55000)]
    df = spark.createDataFrame(rows, "customer_id string, age int, gender string, income int")
    got = {(r.rule_type, r["column"]): (r.action, r.low, r.high) for r in advise.recommend_rules(df).collect()}
    assert got["composite_unique", "customer_id"] == ("Quarantine", None, None)
    assert got["null_check", "age"] == ("Quarantine", None, None) and got["range_check", "age"] == ("Quarantine", 0.0, 120.0)
    assert got["range_check", "income"] == ("Quarantine", 0.0, None) and got["auto_iqr", "income"][0] == "Review"
    assert got["category_consistency", "gender"][0] == "Review"
    asked = {(r.rule_type, r["column"]): (r.action, r.low, r.high) for r in advise.recommend_rules(df, optional=("age",), domains={"age": (18, 100)}).collect()}
    assert asked["null_check", "age"][0] == "Review" and asked["range_check", "age"] == ("Quarantine", 18.0, 100.0)


def test_primary_keys(spark):
    rows = [(k // 4, f"c{k % 4}", k % 2 == 0, k, k * 1.5) for k in range(40)]
    df = spark.createDataFrame(rows, "student_id int, course string, late boolean, n int, score double")
    assert infer.infer_primary_key(df, "scores") == ["student_id", "course"]
    assert infer.infer_primary_key(df.withColumnRenamed("n", "scores_id"), "scores") == ["scores_id"]
    assert infer.infer_primary_key(df.withColumn("width", F.col("n")), "scores") == ["width"]
    assert infer.infer_primary_key(df.select("course", "n"), "scores") == []
    assert infer.infer_primary_key(df.select("student_id", "late"), "scores") == []
    assert infer.infer_primary_key(df.limit(0), "scores") == ["student_id"]


def test_date_columns(spark):
    named = lambda *names: infer.infer_spec(spark.createDataFrame([tuple("x" for _ in names)], list(names)))[1]
    assert named("order_date", "time", "updated_at") == "time" and named("a", "lifetime", "order_date") == "lifetime" and named("a", "dt") is None


def test_names_of_keys(spark):
    a = spark.createDataFrame([(k % 5,) for k in range(20)], "studentId int")
    b = spark.createDataFrame([(k % 5,) for k in range(10)], "`student-ID` int")
    assert [(r.a_column, r.b_column, r.score) for r in relate.candidate_keys(a, b).collect()] == [("studentId", "student-ID", 1.5)]


def test_date_forms(spark):
    rows = [(None, f"0{k % 9 + 1}/02/2024", "1/2/2024") for k in range(300)] + [("2024-01-05 10:00", "x", None) for _ in range(100)]
    df = spark.createDataFrame(rows, "a string, b string, c string").coalesce(1)
    assert {r["column"]: r.form for r in relate.date_formats(df).collect()} == {"a": "YYYY-MM-DD", "b": "DD/MM/YYYY"}


def test_proposals(spark):
    new, changed = (spark.createDataFrame([("c", e)], "column string, error string") for e in ("new_column", "type_mismatch"))
    status = lambda d, **policy: drift.evaluate_proposal(d, **policy).first().status
    assert status(new) == "PENDING" and status(new, require_approval=False) == "APPROVED" and status(new, allow_new=False) == "REJECTED"
    assert status(new, n_columns=51, require_approval=False) == "REJECTED" and status(new, n_columns=50, require_approval=False) == "APPROVED"
    assert status(changed, require_approval=False) == "PENDING" and status(changed, allow_new=False) == "PENDING" and status(changed, n_columns=51) == "REJECTED"
    assert drift.evaluate_proposal(new.union(changed)).first().severity == 6 and status(new.limit(0)) is None


def test_streams_go_on_after_a_failure(spark, tmp_path):
    """The second of two sinks fails once: restarted from the checkpoint, every row is in both once, and the first sink has had each batch once."""
    source, mark, outs = str(tmp_path / "in"), str(tmp_path / "mark"), [str(tmp_path / n) for n in ("a", "b")]
    seen, broken = [], [True]
    sinks_ = [stream.batch_sink(o, "q") for o in outs]

    def first(batch, number):
        seen.append(number)
        sinks_[0](batch, number)

    def second(batch, number):
        sinks_[1](batch, number)
        if broken:
            broken.clear()
            raise RuntimeError("sink is gone")

    def go():
        stream.fan_out(stream.files(spark, source), {"first": first, "second": second}, mark, once=True).awaitTermination()

    spark.createDataFrame([(f"r{k}",) for k in range(20)], "value string").write.mode("append").text(source)
    with pytest.raises(Exception, match="sink is gone"):
        go()
    go()
    spark.createDataFrame([(f"s{k}",) for k in range(5)], "value string").write.mode("append").text(source)
    go()
    want = sorted([f"r{k}" for k in range(20)] + [f"s{k}" for k in range(5)])
    assert [sorted(r.value for r in spark.read.parquet(o).collect()) for o in outs] == [want, want] and seen == [0, 1]


def test_merged_states(spark, tmp_path):
    """States of batches add up to that of all rows: counts, moments and extremes exactly, ranks of quantiles within 2 in 100, distinct counts within 5; later rounds read their own batch alone."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, 4000), rng.exponential(5, 4000), np.full(1000, 7.0)]).round(3)
    rows = [(k // 3000, float(v), None if k % 9 else float(k)) for k, v in enumerate(x)] + [(2, None, None), (2, float("nan"), None)]
    df = spark.createDataFrame(rows, "b int, x double, y double").repartition(3)
    path = str(tmp_path / "s")
    for b in range(3):
        report = profile_state.cycle(df.filter(F.col("b") == b), path, ["x", "y"])
    assert {r["column"] for r in report.collect()} == {"x", "y"}
    got = {r["column"]: r for r in profile_state.described(versions.read(spark, path)).collect()}["x"]
    whole = {r["column"]: r for r in profile_state.described(profile_state.state(df, ["x", "y"])).collect()}["x"]
    d = x - x.mean()
    exact = {"mean": x.mean(), "sd": x.std(ddof=1), "min": x.min(), "max": x.max(), "skewness": (d**3).mean() / x.std() ** 3, "kurtosis": (d**4).mean() / x.std() ** 4 - 3, "null_rate": 2 / 9002}
    for k, v in exact.items():
        assert got[k] == pytest.approx(v, rel=1e-9) and whole[k] == pytest.approx(v, rel=1e-9)
    for k, share in (("p5", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95)):
        assert (x < got[k]).mean() - 0.02 <= share <= (x <= got[k]).mean() + 0.02
    assert abs(got.n_distinct - len(set(x)) - 1) <= 0.05 * len(set(x))
    empty = profile_state.merged(profile_state.state(df.limit(0), ["x"]), profile_state.state(df.select(F.lit(None).cast("double").alias("x")), ["x"]))
    assert profile_state.described(empty).first().mean is None


def test_one_pass_dashboard(spark):
    """Ten widgets come from one scan, and are what each gives by itself; missing labels, dates and values too."""
    rows = [(None if k % 11 == 0 else f"g{k % 4}", f"h{k % 3}", None if k % 13 == 0 else f"2024-0{k % 5 + 1}-10", None if k % 7 == 0 else k * 1.5) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, h string, d string, v double").withColumn("d", F.col("d").cast("timestamp"))
    total, ratio = {"agg": "sum", "column": "v"}, {"numerator": {"agg": "count", "where": [["g", "eq", "g1"]]}, "denominator": {"agg": "count"}, "percent": True}
    spec = [{"id": f"k{i}", "type": "kpi", "definition": m} for i, m in enumerate(({"agg": "count"}, total, ratio, {"agg": "count_distinct", "column": "h"}))]
    spec += [{"id": "change", "type": "kpi", "definition": total, "date": "d"}, {"id": "bg", "type": "bar", "by": "g", "definition": total}, {"id": "bh", "type": "bar", "by": "h", "definition": ratio, "sort": "x"}, {"id": "top", "type": "bar", "by": "g", "definition": {"agg": "count"}, "top": 2}]
    spec += [{"id": "t", "type": "time", "date": "d", "definition": total}, {"id": "ty", "type": "time", "date": "d", "definition": ratio, "grain": "year"}]
    got = dash.compute(df, spec, {"h": {"values": ["h0", "h1"]}}, {})
    shown, kind = dash.apply_filters(df, {"h": {"values": ["h0", "h1"]}}, {}), {"kpi": dash.kpi, "bar": dash.bar, "time": dash.time}
    for w in spec:
        alone = kind[w["type"]](shown, **{k: v for k, v in w.items() if k not in ("id", "type")})
        assert [tuple(r) for r in got[w["id"]].collect()] == [tuple(r) for r in alone.collect()], w["id"]
    path = "/root/testdata/sf0.001/orders.parquet"
    o = spark.read.parquet(path).withColumnRenamed("o_totalprice", "total_price")
    cells, _ = dash.one_pass(o, [w for w in dash.default_spec([r.asDict() for r in advise.column_roles(o).collect()]) if w["type"] != "table"])
    assert cells._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_pages(spark):
    """Pages one after the other are the table, with nulls and ties in the sorted columns; a later page's filter reaches the scan."""
    rows = [(None if k % 5 == 0 else k % 4, None if k % 7 == 0 else k % 3, k) for k in range(60)]
    df = spark.createDataFrame(rows, "a int, b int, id int")
    for ways in (("asc", "desc"), ("desc", "asc")):
        sort, last, seen = [("a", ways[0]), ("b", ways[1]), ("id", "asc")], None, []
        while part := history.seek(df, sort, 7, last).collect():
            seen += [tuple(r) for r in part]
            last = (part[-1].a, part[-1].b, part[-1].id)
        assert seen == [tuple(r) for r in history.page(df, sort, 0, 100).collect()] and len(seen) == 60
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey")
    assert "GreaterThanOrEqual(o_orderkey,700)" in history.seek(o, [("o_orderkey", "asc")], 5, (700,))._jdf.queryExecution().executedPlan().toString()


def test_digests_of_large_files(spark, tmp_path):
    """A file over the size of a row is read in pieces; names with blanks and signs are found."""
    import hashlib

    with open(tmp_path / "large file%.bin", "wb") as f:
        f.truncate(2_200_000_000)
    (tmp_path / "small").write_bytes(b"abc")
    got = {r.path.rsplit("/", 1)[-1]: (r.length, r.sha256) for r in read.file_digests(spark, str(tmp_path)).collect()}
    total, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(2_200_000_000 >> 20):
        total.update(zeros)
    total.update(bytes(2_200_000_000 & 0xFFFFF))
    assert sorted(got.values()) == [(3, hashlib.sha256(b"abc").hexdigest()), (2_200_000_000, total.hexdigest())]


def test_search_reads_few_files(spark, tmp_path):
    """A rare word is looked for in under a tenth of the files, with the rows of a scan; files that come later are read until they are signed."""
    path = str(tmp_path / "t")
    words = spark.range(6000).select("id", F.concat_ws(" ", *[F.substring(F.md5(F.concat("id", F.lit(f"x{k}"))), 1, 5) for k in range(3)]).alias("t"), F.when(F.col("id") == 4321, "A Quokka here").alias("note"))
    versions.upsert(words, path, ["id"], file_rows=150)
    assert search.index_files(spark, path) >= 30 and search.index_files(spark, path) == 0
    total = versions.file_list(spark, path).count()
    for text in ("quokka", "4321", words.filter("id = 77").first().t[:9], "zz", "\x1fa"):
        want = sorted(r.id for r in history.search_rows(words, text).collect())
        assert sorted(r.id for r in search.search(spark, path, text).collect()) == want
    assert len(search.files_with(spark, path, "quokka")) < 0.1 * total and len(search.files_with(spark, path, "zz")) == total
    versions.upsert(spark.createDataFrame([(9999, "late quokka", None)], "id long, t string, note string"), path, ["id"], file_rows=150)
    assert sorted(r.id for r in search.search(spark, path, "QUOKKA").collect()) == [4321, 9999]
    assert search.index_files(spark, path) == 1


def test_two_decimals(spark):
    """Exact values are rounded, half to even, as printf does; not their shortest texts."""
    texts = {-627169.065: "-627169.06", 0.125: "0.12", 0.375: "0.38", 1.005: "1.00", 2.675: "2.67", 0.005: "0.01", 0.995: "0.99", 99.996: "100.00", -0.001: "-0.00", 2.0**62: "4611686018427387904.00", float("inf"): "inf", float("nan"): "nan", None: None}
    df = spark.createDataFrame([(x,) for x in texts], "x double")
    assert [r[0] for r in df.select(two_decimals(F.col("x"))).collect()] == list(texts.values())
    assert all("%.2f" % x == t for x, t in texts.items() if x is not None)


@given(st.lists(st.one_of(st.floats(-1e17, 1e17), st.integers(-10**9, 10**9).map(lambda k: k / 200)), min_size=1, max_size=200))
@settings(max_examples=10, deadline=None)
def test_two_decimals_of_any_number(spark, xs):
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(two_decimals(F.col("x")))
    assert [r[0] for r in got.collect()] == ["%.2f" % x for x in xs]
