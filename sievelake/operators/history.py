"""Queries over the history of runs, and summaries of it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def _moment(value, now: str) -> Column:
    """A bound of a range; 'now-30d' counts back from now."""
    if isinstance(value, str) and (m := re.fullmatch(r"now(?:-(\d+)([dh]))?", value)):
        base = F.lit(now).cast("timestamp")
        return base if m[1] is None else base - F.expr(f"interval {int(m[1])} {'day' if m[2] == 'd' else 'hour'}")
    return F.lit(value)


def _clause(clause: dict, now: str) -> Column:
    kind, body = next(iter(clause.items()))
    if kind == "exists":
        return F.col(body["field"]).isNotNull()
    column, want = next(iter(body.items()))
    c = F.col(column)
    if kind == "term":
        if isinstance(want, dict) and want.get("case_insensitive"):
            return F.lower(c) == str(want["value"]).lower()
        return c == (want["value"] if isinstance(want, dict) else want)
    if kind == "terms":
        return c.isin(want)
    tests = {"gte": lambda v: c >= v, "gt": lambda v: c > v, "lte": lambda v: c <= v, "lt": lambda v: c < v}
    return reduce(lambda a, b: a & b, [tests[k](_moment(v, now)) for k, v in want.items()], F.lit(True))


def where(df: DataFrame, query: dict, now: str = "2030-01-01") -> DataFrame:
    """Rows that meet all of must and filter and none of must_not; clauses are term, terms, exists, range."""
    out = df
    for clause in (*query.get("must", ()), *query.get("filter", ())):
        out = out.filter(_clause(clause, now))
    for clause in query.get("must_not", ()):
        out = out.filter(~F.coalesce(_clause(clause, now), F.lit(False)))
    return out


def page(df: DataFrame, sort: list[tuple[str, str]], offset: int, limit: int) -> DataFrame:
    order = [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in sort]
    return df.orderBy(*order).offset(offset).limit(limit)


def seek(df: DataFrame, sort: list[tuple[str, str]], limit: int, after: tuple | None = None) -> DataFrame:
    """The page of `limit` rows that follow the row whose values of the sorted columns are `after` (from its start without one).

    In place of an offset, whose rows are sorted and thrown away, the rows
    before the page are filtered out, by the first column in the scan; page
    1,000 costs what the first one does. The columns together must tell rows
    apart; nulls are last. The last row's values are the next page's `after`.
    """
    order = [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in sort]
    if after is None:
        return df.orderBy(*order).limit(limit)
    beyond, same = F.lit(False), F.lit(True)
    for (c, way), v in zip(sort, after, strict=True):
        col = F.col(c)
        if v is not None:
            beyond = beyond | (same & (col.isNull() | ((col < F.lit(v)) if way == "desc" else (col > F.lit(v)))))
        same = same & (col.isNull() if v is None else F.coalesce(col == F.lit(v), F.lit(False)))
    first, way = sort[0]
    if after[0] is not None:  # what every row of the page meets, in a form that reaches the scan
        beyond = beyond & (F.col(first).isNull() | ((F.col(first) <= F.lit(after[0])) if way == "desc" else (F.col(first) >= F.lit(after[0]))))
    return df.filter(beyond).orderBy(*order).limit(limit)


def latest_per(df: DataFrame, key: str, ts: str = "timestamp", tie: str = "run_id") -> DataFrame:
    """The newest row of each key, as an aggregate, and how many rows the key has."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(ts, tie)).alias("d"), F.count("*").alias("n_rows"))
    return best.select(key, "d.*", "n_rows")


def search_rows(df: DataFrame, text: str, run_id: str | None = None) -> DataFrame:
    """Rows of which any column contains the text, in lower case."""
    found = df.filter(F.col("run_id") == run_id) if run_id is not None else df
    line = F.lower(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in df.columns]))
    return found.filter(line.contains(text.lower()))


def kpis(runs: DataFrame, pipelines: DataFrame, last: int = 20) -> DataFrame:
    """Totals and mean score of all quality runs, and mean minutes of the last pipeline runs that did not fail (of those with a duration)."""
    recent = pipelines.filter(F.coalesce(F.col("state") != "failed", F.lit(True))).orderBy(F.desc("timestamp"), F.desc("run_id")).limit(last)
    minutes = recent.agg(F.round(F.avg("duration_seconds") / 60, 2).alias("avg_minutes"))
    totals = runs.agg(F.sum("total_records").alias("records"), F.sum("quarantined_records").alias("quarantined"), F.round(F.avg("quality_score"), 4).alias("avg_score"))
    return totals.crossJoin(minutes)


def score_series(runs: DataFrame, tables: list[str]) -> DataFrame:
    """A row for each run time, a column of scores for each table."""
    return runs.groupBy("timestamp").pivot("table_name", tables).agg(F.first("quality_score"))


def _normal_cdf(x: Column) -> Column:
    """Standard normal distribution by a rational approximation of erf (Abramowitz and Stegun 7.1.26)."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def projection(runs: DataFrame, last: int = 10, ahead: int = 7, sla: float = 95.0, crisis: float = 90.0) -> DataFrame:
    """A line through the last scores of each table, over days, and what it says of each of the next days.

    Days are counted from the first of the scores with their fractions; scores
    of one moment are taken a day apart. The band is the regression's standard
    error (of n - 2; sqrt(2) for two scores; 0.5 at least), wider by a fifth
    a day. Stability falls by 4 for each point of the scores' deviation, to 5
    at least. The chance to miss `sla` is 99.9 where the newest score does, else
    the greatest of any day's, within 0.1 and 99.9. Days until a crisis count
    to the first forecast under `crisis` (`ahead` without one). Tables with one
    run have no line and no rows.
    """
    w = Window.partitionBy("table_name")
    newest = w.orderBy(F.desc("timestamp"), F.desc("run_id"))
    recent = runs.withColumn("nth", F.row_number().over(newest)).filter(F.col("nth") <= last)
    days = (F.unix_micros("timestamp") - F.min(F.unix_micros("timestamp")).over(w)) / 86_400e6
    spread = F.max(F.unix_micros("timestamp")).over(w) > F.min(F.unix_micros("timestamp")).over(w)
    placed = recent.withColumn("x", F.when(spread, days).otherwise((F.max("nth").over(w) - F.col("nth")).cast("double")))
    y = F.col("quality_score").cast("double")
    points = placed.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("x", "nth", y.alias("y")))).alias("p"), F.count("*").cast("double").alias("n"), F.max("x").alias("today"), F.min_by(y, "nth").alias("newest"))
    total = lambda term: F.aggregate("p", F.lit(0.0), lambda a, e: a + term(e))
    sums = points.filter("n >= 2").select("*", total(lambda e: e.x).alias("sx"), total(lambda e: e.y).alias("sy"), total(lambda e: e.x * e.x).alias("sxx"), total(lambda e: e.x * e.y).alias("sxy"))
    across = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    line = sums.withColumn("slope", F.when(across != 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / across).otherwise(-0.5))
    line = line.withColumn("at0", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).withColumn("mean", F.col("sy") / F.col("n"))
    sse = F.aggregate("p", F.lit(0.0), lambda a, e: a + F.pow(e.y - (F.col("slope") * e.x + F.col("at0")), F.lit(2.0)))
    sd = F.sqrt(F.aggregate("p", F.lit(0.0), lambda a, e: a + F.pow(e.y - F.col("mean"), F.lit(2.0))) / F.col("n"))
    error = F.greatest(F.sqrt(F.when(F.col("n") > 2, sse / (F.col("n") - 2)).otherwise(2.0)), F.lit(0.5))
    line = line.withColumn("error", error).withColumn("stability", F.greatest(F.lit(5.0), F.least(F.lit(100.0), 100 - 4 * sd)))
    each = line.select("*", F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("day"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("at0") + (F.col("today") + F.col("day")) * F.col("slope")))
    each = each.withColumn("value", value).withColumn("projected", F.round("value", 2)).withColumn("margin", F.col("error") * (1 + 0.2 * F.col("day")))
    chance = F.max(1 - _normal_cdf((F.col("projected") - sla) / F.col("error"))).over(w)
    breach = F.when(F.col("newest") < sla, 99.9).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(99.9), 100 * chance)))
    first = F.min(F.when(F.col("projected") < crisis, F.struct("day", "projected"))).over(w)
    severity = F.when(first.isNull(), "LOW").when(first["projected"] < 80, "CRITICAL").otherwise("WARNING")
    part = F.when(first.isNull(), "None").when(F.col("slope") < -1, "Ingestion Pipeline Gateway").otherwise("Data Quality Validation Layer")
    return each.select(
        "table_name", "day", "projected", F.round(F.greatest(F.lit(0.0), F.col("value") - F.col("margin")), 2).alias("low"), F.round(F.least(F.lit(100.0), F.col("value") + F.col("margin")), 2).alias("high"), F.round("slope", 3).alias("slope"),
        F.round("stability", 1).alias("stability"), F.round(breach, 1).alias("breach"), F.coalesce(first["day"], F.lit(ahead)).alias("days_until_crisis"), part.alias("impacted"), severity.alias("severity"),
    )


#: Categories of reasons by how they begin, by what they are, by a part of them, and all others.
PREFIXES = [
    ("outlier_", "ค่าผิดปกติ (IQR)"),
    ("zscore_", "ค่าผิดปกติ (Z-score)"),
    ("out_of_range_", "ค่านอกช่วงที่กำหนด"),
    ("null_value_in_", "ค่าว่าง"),
    ("invalid_type_", "ชนิดข้อมูลไม่ถูกต้อง"),
]
EXACT = [
    ("missing_primary_key", "คีย์หลักว่าง"),
    ("missing_date", "วันที่ว่าง"),
    ("induced_tree_rule_match", "ตรงกฎที่ระบบเรียนรู้"),
    ("other_reasons", "เหตุผลอื่น ๆ"),
]
DUPLICATE, DRIFTED, UNNAMED, OTHER = "ข้อมูลซ้ำ", "โครงสร้างข้อมูลเปลี่ยน", "ถูกกักกัน (ไม่ระบุเหตุผล)", "อื่น ๆ"


def clusters(runs: DataFrame) -> DataFrame:
    """Reasons of each table's newest run: category, the column they name, rows, per cent of the run's reasons and place.

    Reasons that hold a value (a = in them) are one for each column. A run that
    held rows back without a reason has the reason quarantined_<table>.
    """
    newest = latest_per(runs, "table_name")
    unnamed = F.create_map(F.concat(F.lit("quarantined_"), "table_name"), F.col("quarantined_records").cast("long"))
    parts = F.when(F.size("quarantine_breakdown") > 0, F.col("quarantine_breakdown").cast("map<string,bigint>")).when(F.col("quarantined_records") > 0, unnamed)
    name = F.trim(F.substring_index("raw", "=", 1))
    zscore = F.concat(F.lit("zscore_"), F.regexp_replace(name, "_zscore$", ""))
    reason = F.when(F.col("raw").contains("="), F.when(name.endswith("_zscore"), zscore).otherwise(F.concat(F.lit("outlier_"), name))).otherwise(F.trim("raw"))
    counts = newest.select("table_name", F.explode(parts).alias("raw", "k")).groupBy("table_name", reason.alias("reason")).agg(F.sum("k").alias("n"))
    r = F.col("reason")
    kinds = [F.when(r.startswith(p), F.struct(F.lit(c).alias("category"), F.substring(r, len(p) + 1, 1 << 20).alias("column"))) for p, c in PREFIXES]
    rest = F.coalesce(*[F.when(r == k, F.lit(c)) for k, c in EXACT], F.when(r.startswith("duplicate"), F.lit(DUPLICATE)), F.when(r.contains("drift"), F.lit(DRIFTED)), F.when(r.startswith("quarantined_"), F.lit(UNNAMED)), F.lit(OTHER))
    kind = F.coalesce(*kinds, F.struct(rest.alias("category"), F.lit(None).cast("string").alias("column")))
    w = Window.partitionBy("table_name")
    return counts.select("table_name", F.row_number().over(w.orderBy(F.desc("n"), "reason")).alias("place"), "reason", kind["category"].alias("category"), kind["column"].alias("column"), "n", F.round(100 * F.col("n") / F.sum("n").over(w), 1).alias("share"))


def cost_of_poor_data(runs: DataFrame, drifts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """What rows held back cost in all (or for each of `by`): correction (2 a row), lost opportunity, risk, and how far they bend two indicators.

    Opportunity is the value held back, or 50 for one row in twenty where there
    is none, both as whole numbers of the total. Risk is the rows times the
    severity of the newest run with a drift (drifts: run_id, timestamp,
    severity), 1 without one.
    """
    newest = drifts.groupBy("run_id").agg(F.max("timestamp").alias("at"), F.sum("severity").alias("severity")).agg(F.max_by("severity", F.struct("at", "run_id")).alias("drift"))
    q, v = F.coalesce(F.sum("quarantined_records"), F.lit(0)), F.coalesce(F.sum("quarantined_financial_value"), F.lit(0.0))
    total = F.coalesce(F.sum("total_records"), F.lit(0))
    sums = runs.groupBy(*by).agg(q.alias("rows"), v.alias("value"), F.when(total == 0, 1).otherwise(total).alias("total")).crossJoin(F.broadcast(newest))
    rate = 100 * F.col("rows") / F.col("total")
    opportunity = F.when(F.col("value") > 0, F.col("value").cast("long")).otherwise((F.col("rows") * 0.05 * 50).cast("long"))
    sales, stock = F.round(rate * 0.8, 2), F.round(F.when(F.col("drift").isNotNull(), F.col("drift") * rate * 0.3).otherwise(rate * 0.4), 2)
    costs = sums.select(*by, (F.col("rows") * 2).alias("correction"), opportunity.alias("opportunity"), (F.col("rows") * F.coalesce("drift", F.lit(1))).alias("risk"), sales.alias("sales_impact_pct"), stock.alias("inventory_impact_pct"))
    status = [F.when(F.col("sales_impact_pct") < 10, "WARN").otherwise("CRITICAL").alias("sales_status"), F.when(F.col("inventory_impact_pct") > 5, "CRITICAL").otherwise("OK").alias("inventory_status")]
    return costs.select("*", (F.col("correction") + F.col("opportunity") + F.col("risk")).alias("total"), *status)


def reconciliation(runs: DataFrame) -> DataFrame:
    """Rows in and delivered by run, and whether the gap is small."""
    share = 100 * F.col("clean_records") / F.greatest("total_records", F.lit(1))
    return runs.select("run_id", F.col("total_records").alias("inbound"), F.col("clean_records").alias("delivered"), (F.col("total_records") - F.col("clean_records")).alias("gap"), F.when(share >= 95, "OK").when(share >= 90, "WARNING").otherwise("CRITICAL").alias("status"), F.round(share, 4).alias("integrity_pct"))


#: What to do about rejects, by what their reason contains (tried in order).
ACTIONS = [("primary_key", "FIX_SOURCE_KEY"), ("outlier", "TUNE_OUTLIER_RULE"), ("zscore", "TUNE_OUTLIER_RULE"), ("null", "FIX_SOURCE_NULLS"), ("missing", "FIX_SOURCE_NULLS"), ("duplicate", "REVIEW_KEY"), ("range", "REVIEW_RANGE")]


def recommendations(runs: DataFrame, drifts: DataFrame, top: int = 3, restore_under: float = 70.0) -> DataFrame:
    """What to do about the newest run of each table: (table_name, kind, action, weight, status).

    A summary holds the score against its threshold. For tables under it come
    the foremost causes by rows (those with an action), and under
    restore_under the last good state to restore. Drifts are one item a table.
    """
    newest = latest_per(runs, "table_name")
    passed = F.col("quality_score") >= F.col("effective_quality_threshold")
    summary = newest.select("table_name", F.lit("summary").alias("kind"), F.lit("SUMMARY").alias("action"), F.col("quality_score").cast("double").alias("weight"), F.when(passed, "OK").otherwise("CRITICAL").alias("status"))
    low = newest.filter(~passed)
    action = F.coalesce(*[F.when(F.col("reason").contains(k), v) for k, v in ACTIONS])
    causes = low.select("table_name", F.explode("quarantine_breakdown").alias("reason", "n")).withColumn("action", action).filter("action is not null").groupBy("table_name", "action").agg(F.sum("n").cast("double").alias("weight"))
    nth = F.row_number().over(Window.partitionBy("table_name").orderBy(F.desc("weight"), "action"))
    first = causes.withColumn("nth", nth).filter(F.col("nth") <= top).select("table_name", F.lit("cause").alias("kind"), "action", "weight", F.lit("RECOMMENDED").alias("status"))
    restore = low.filter(F.col("quality_score") < restore_under).select("table_name", F.lit("restore").alias("kind"), F.lit("RESTORE_BACKUP").alias("action"), F.col("quality_score").cast("double").alias("weight"), F.lit("AVAILABLE").alias("status"))
    drifted = drifts.groupBy("table_name").agg(F.count("*").cast("double").alias("weight")).select("table_name", F.lit("drift").alias("kind"), F.lit("SETTLE_DRIFT").alias("action"), "weight", F.lit("RECOMMENDED").alias("status"))
    return summary.unionByName(first).unionByName(restore).unionByName(drifted)


def trust_check(runs: DataFrame, drifts: DataFrame) -> DataFrame:
    """SAFE if a table's newest score meets its threshold and no proposal is pending; one of them failing is suspect, both halt it."""
    pending = drifts.filter("status = 'PENDING'").groupBy("table_name").agg(F.count("*").alias("pending"))
    joined = latest_per(runs, "table_name").join(pending, "table_name", "left").withColumn("pending", F.coalesce("pending", F.lit(0)))
    low = F.col("quality_score") < F.col("effective_quality_threshold")
    verdict = F.when(low & (F.col("pending") > 0), "HALT_INGEST").when(low | (F.col("pending") > 0), "WARNING_SUSPECT").otherwise("SAFE")
    return joined.select("table_name", "quality_score", "pending", verdict.alias("verdict"))


def catalog(registry: DataFrame, runs: DataFrame, drifts: DataFrame) -> DataFrame:
    """Registered tables and tables with runs: newest run, score and pending proposals."""
    newest = latest_per(runs, "table_name").select("table_name", F.col("run_id").alias("last_run"), "quality_score")
    pending = drifts.filter("status = 'PENDING'").groupBy("table_name").agg(F.count("*").alias("pending"))
    return registry.join(newest, "table_name", "full_outer").join(pending, "table_name", "left").withColumn("pending", F.coalesce("pending", F.lit(0)))


def activity(pipelines: DataFrame, runs: DataFrame, drifts: DataFrame, limit: int = 50) -> DataFrame:
    """Pipeline runs, quality runs and drifts as one feed with levels, newest first."""
    state = F.col("state")
    level = F.when(state == "failed", "error").when(state.isin("quarantined", "warnings"), "warning").otherwise("info")
    a = pipelines.select("timestamp", F.lit("pipeline").alias("kind"), "table_name", F.concat_ws(":", "run_id", "state").alias("subject"), level.alias("level"))
    b = runs.select("timestamp", F.lit("quality_run").alias("kind"), "table_name", F.col("run_id").alias("subject"), F.when(F.col("quality_score") >= 90, "success").otherwise("warning").alias("level"))
    c = drifts.select("timestamp", F.lit("schema_drift").alias("kind"), "table_name", F.concat_ws(":", "run_id", "column_name").alias("subject"), F.lit("error").alias("level"))
    return a.unionByName(b).unionByName(c).orderBy(F.desc("timestamp"), "kind", "subject").limit(limit)


def run_performance(pipelines: DataFrame, last: int = 100, recent: int = 6) -> DataFrame:
    """Share of the last pipeline runs that did not fail, and mean seconds of the most recent ones (those with a duration, in whole seconds)."""
    newest = [F.desc("timestamp"), F.desc("run_id")]
    rate = pipelines.orderBy(*newest).limit(last).agg(F.round(100 * F.avg((~F.col("state").eqNullSafe("failed")).cast("int")), 1).alias("success_pct"))
    latency = pipelines.orderBy(*newest).limit(recent).agg(F.round(F.avg(F.floor("duration_seconds")), 1).alias("avg_seconds"))
    return rate.crossJoin(latency)


def executive(runs: DataFrame, drifts: DataFrame, pipelines: DataFrame) -> DataFrame:
    """One row: health label, share of pipeline runs that did not fail, fresh share, kinds of rejects in per cent, trend of the last two scores."""
    flat = runs.select(F.explode("quarantine_breakdown").alias("reason", "n"))
    kind = F.when(F.col("reason").rlike("null|missing"), "missing").when(F.col("reason").contains("duplicate"), "duplicate").when(F.col("reason").contains("drift"), "drift").otherwise("invalid")
    kinds = flat.agg(*[F.coalesce(F.sum(F.when(kind == k, F.col("n"))), F.lit(0)).alias(k) for k in ("missing", "duplicate", "invalid")])
    # The two newest runs as an aggregate: no task gets all runs.
    order = F.struct("timestamp", "run_id")
    last = runs.agg(F.max(F.struct(order.alias("at"), "quality_score")).alias("x"))
    before = runs.crossJoin(F.broadcast(last)).filter(order < F.col("x.at")).agg(F.max_by("quality_score", order).alias("before"))
    trend = last.crossJoin(before).select((F.col("x.quality_score") - F.col("before")).alias("trend"))
    one = runs.agg(F.avg("quality_score").alias("score"), F.sum("total_records").alias("total"), F.avg((F.col("freshness_lag_hours") <= 1).cast("int")).alias("fresh"))
    up = pipelines.agg(F.coalesce(F.avg((~F.col("state").eqNullSafe("failed")).cast("int")), F.lit(0.0)).alias("up"))
    wide = one.crossJoin(kinds).crossJoin(trend).crossJoin(up).crossJoin(drifts.agg(F.count("*").alias("n_drifts")))
    pct = lambda c: F.round(100 * F.col(c) / F.greatest("total", F.lit(1)), 4)
    health = F.when(F.col("score").isNull(), "No Data").when(F.col("score") >= 95, "Good").when(F.col("score") >= 88, "Warning").otherwise("Critical")
    return wide.select(health.alias("health"), F.round("score", 4).alias("score"), F.round(100 * F.col("up"), 1).alias("availability"), F.round(100 * F.col("fresh"), 1).alias("fresh_pct"), pct("missing").alias("missing_pct"), pct("duplicate").alias("duplicate_pct"), pct("invalid").alias("invalid_pct"), F.round("trend", 4).alias("trend"), "n_drifts")


#: Areas of the business, words in the names of their tables, and the points that their health loses when affected.
AREAS = [
    ("sales", ["sale", "order", "trans", "grocery", "bill", "invoice"], 2.0),
    ("customer", ["user", "cust", "student", "mbti", "member", "client"], 5.0),
    ("operations", ["prod", "item", "inventory", "stock", "supply", "course", "dirty"], 1.5),
]


def area_status(runs: DataFrame, drifts: DataFrame, pipelines: DataFrame) -> DataFrame:
    """(area, status, health_pct, tables): Warning where a table of the area has rows held back, for reporting where pipelines failed or drifts came.

    Tables of no area count for operations if no area is affected otherwise. Finance has no tables of its own and stays Normal.
    """
    names = F.lower("table_name")
    held = runs.groupBy("table_name").agg(F.sum("quarantined_records").alias("q")).filter("q > 0").select("table_name")
    flags = held.select("table_name", *[names.rlike("|".join(words)).alias(area) for area, words, _ in AREAS])
    found = flags.agg(F.count("*").alias("n"), *[F.coalesce(F.max(area), F.lit(False)).alias(area) for area, _, _ in AREAS], *[F.array_sort(F.collect_set(F.when(F.col(area), F.col("table_name")))).alias(f"{area}_tables") for area, _, _ in AREAS])
    rate = runs.agg(F.sum("quarantined_records").alias("q"), F.sum("total_records").alias("t")).select(F.when(F.col("t") > 0, F.round(100 - F.round(100 * F.col("q") / F.col("t"), 2), 1)).otherwise(0.0).alias("base"))
    pipes = pipelines.agg(F.count("*").alias("runs"), F.count(F.when(F.col("state") == "failed", 1)).alias("failed"))
    drifted = drifts.agg(F.count("*").alias("drifts"), F.array_sort(F.collect_set("table_name")).alias("drift_tables"))
    one = found.crossJoin(rate).crossJoin(pipes).crossJoin(drifted)
    none = ~F.col("sales") & ~F.col("customer") & ~F.col("operations")
    hit = {area: (F.col(area) | (none & (F.col("n") > 0)) if area == "operations" else F.col(area)) for area, _, _ in AREAS}
    available = F.when(F.col("runs") > 0, F.round(100 * (F.col("runs") - F.col("failed")) / F.col("runs"), 1)).otherwise(0.0)
    row = lambda area, warn, health, tables: F.struct(F.lit(area).alias("area"), F.when(warn, "Warning").otherwise("Normal").alias("status"), health.alias("health_pct"), F.array_join(tables, ",").alias("tables"))
    rows = [row(area, hit[area], F.when(hit[area], F.round(F.col("base") - points, 1)).otherwise(F.col("base")), F.col(f"{area}_tables")) for area, _, points in AREAS]
    rows.append(row("reporting", (F.col("failed") > 0) | (F.col("drifts") > 0), F.when(F.col("failed") > 0, F.round(available - 3.0, 1)).otherwise(available), F.col("drift_tables")))
    rows.append(row("finance", F.lit(False), F.col("base"), F.array().cast("array<string>")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def scorecard(runs: DataFrame, nulls: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rules tested and passed by run and dimension.

    nulls: (run_id, column, null_rate, tolerance); ranges: (run_id, column) of
    columns with a range. Completeness has a rule for each column of nulls: its
    rate is within its tolerance and no reason of the run names it and null.
    Validity: the table is not empty, and for each column of ranges no reason
    names it and outlier or range. Uniqueness: no reason names duplicates.
    """
    reasons = runs.select("run_id", F.explode("quarantine_breakdown").alias("reason", "n")).filter("n > 0").select("run_id", F.lower("reason").alias("reason"))

    def named(columns: DataFrame, words: str) -> DataFrame:
        """columns and hit: whether a reason of the run names the column and one of the words."""
        hits = columns.join(reasons, "run_id").filter(F.col("reason").rlike(words) & F.col("reason").contains(F.lower("column"))).select("run_id", "column").distinct().withColumn("hit", F.lit(True))
        return columns.join(hits, ["run_id", "column"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    complete = named(nulls, "null").select("run_id", F.lit("completeness").alias("dimension"), (~F.col("hit") & (F.col("null_rate") <= F.col("tolerance"))).alias("passed"))
    filled = runs.select("run_id", F.lit("validity").alias("dimension"), (F.col("total_records") > 0).alias("passed"))
    within = named(ranges, "outlier|range").select("run_id", F.lit("validity").alias("dimension"), (~F.col("hit")).alias("passed"))
    repeated = reasons.filter(F.col("reason").contains("duplicate")).select("run_id").distinct().withColumn("hit", F.lit(True))
    unique = runs.select("run_id").join(repeated, "run_id", "left").select("run_id", F.lit("uniqueness").alias("dimension"), F.col("hit").isNull().alias("passed"))
    rules = complete.unionByName(filled).unionByName(within).unionByName(unique)
    return rules.groupBy("run_id", "dimension").agg(F.count("*").alias("tested"), F.sum(F.col("passed").cast("int")).alias("passed"), F.round(100 * F.avg(F.col("passed").cast("int")), 4).alias("pass_pct"))


def compliance(runs: DataFrame) -> DataFrame:
    """(table_name, share, rows, pct): rows in order, at risk (under review) and held back of all runs of a table."""
    review = F.coalesce(F.sum("review_records"), F.lit(0)) if "review_records" in runs.columns else F.lit(0).cast("long")
    sums = runs.groupBy("table_name").agg(F.sum("total_records").alias("t"), F.sum("quarantined_records").alias("q"), review.alias("r"))
    rows = [F.struct(F.lit(k).alias("share"), c.alias("rows")) for k, c in (("compliant", F.greatest(F.col("t") - F.col("q") - F.col("r"), F.lit(0))), ("at_risk", F.col("r")), ("non_compliant", F.col("q")))]
    return sums.select("table_name", "t", F.explode(F.array(*rows)).alias("x")).select("table_name", "x.share", "x.rows", F.round(100 * F.col("x.rows") / F.greatest("t", F.lit(1)), 1).alias("pct"))
