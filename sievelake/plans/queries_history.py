"""Queries over the history of runs: metrics against the past, gold tables, analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import scratch
from ..operators import drift, gold, history, metrics, search, versions
from .fixtures import DRIFTS, PIPELINES, PROFILES, RUNS, drift_log, pipeline_runs, run_history, run_profiles, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


PAST = 'OVER (PARTITION BY table_name ORDER BY "timestamp", run_id ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)'
RATED = f"""{RUNS}, rated AS (SELECT *, quarantined_records / total_records AS rate FROM runs),
zz AS (SELECT run_id, table_name, "timestamp", rate, avg(rate) {PAST} AS mean, greatest(stddev_pop(rate) {PAST}, 0.05) AS sd, count(rate) {PAST} AS n FROM rated),
anomalies AS (SELECT run_id, table_name, "timestamp", rate, CASE WHEN n < 3 OR abs(rate - mean) < 0.02 THEN 0.0 ELSE abs(rate - mean) / sd END AS z FROM zz)"""
LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY "timestamp" DESC, run_id DESC) AS nth, count(*) OVER (PARTITION BY table_name)::BIGINT AS n_rows FROM runs) WHERE nth = 1)"""


@query(f'WITH {RATED} SELECT run_id, table_name, "timestamp", round(rate, 6) AS rate, round(z, 4) AS z, z > 3 AS is_anomaly FROM anomalies')
def rate_anomalies(spark, sf_dir):
    return metrics.rate_anomaly(run_history(spark, sf_dir))


@query(f"WITH {RUNS} SELECT run_id, table_name, round(CASE WHEN count(quality_score) {PAST} < 2 THEN 80.0 ELSE greatest(avg(quality_score) {PAST} - stddev_samp(quality_score) {PAST}, 70.0) END, 4)::DOUBLE AS threshold FROM runs")
def adaptive_thresholds(spark, sf_dir):
    return metrics.adaptive_threshold(run_history(spark, sf_dir))


@query(f"""WITH {RATED}, {DRIFTS} SELECT run_id, table_name, 'low_quality' AS alert, printf('%.4f', quality_score) AS detail FROM runs WHERE quality_score < 95
UNION ALL SELECT run_id, table_name, 'rate_anomaly', printf('%.4f', round(z, 4)) FROM anomalies WHERE z > 3
UNION ALL SELECT run_id, table_name, error_type, column_name FROM drifts WHERE error_type IN ('missing_column', 'type_mismatch')""")
def alert_rows(spark, sf_dir):
    return metrics.alerts(run_history(spark, sf_dir), drift_log(spark, sf_dir))


@query(f"""WITH {RATED}, {DRIFTS}, d AS (SELECT run_id, count(*) AS n FROM drifts GROUP BY 1), t AS (SELECT r.run_id, r.table_name, concat_ws(',', CASE WHEN a.z > 3 THEN 'rate_anomaly' END, CASE WHEN r.quality_score <= 80 THEN 'low_score' END, CASE WHEN d.n > 0 THEN 'schema_drift' END) AS why
FROM runs r JOIN anomalies a ON r.run_id = a.run_id LEFT JOIN d ON r.run_id = d.run_id) SELECT * FROM t WHERE why <> ''""")
def advisory_triggers(spark, sf_dir):
    return metrics.advisory_triggers(run_history(spark, sf_dir), drift_log(spark, sf_dir))


@query(f"""WITH {RUNS}, {DRIFTS} SELECT table_name, error_type || ':' || column_name AS signature, count(*)::BIGINT AS occurrences, min("timestamp") AS first_seen, max("timestamp") AS last_seen, string_agg(run_id, ',' ORDER BY run_id) AS run_ids FROM drifts GROUP BY 1, 2""")
def proposal_groups(spark, sf_dir):
    return drift.group_proposals(drift_log(spark, sf_dir))


# ---- gold -------------------------------------------------------------------


@query(f"""WITH {RUNS} SELECT "timestamp"::DATE AS date, table_name, round(avg(quality_score), 4) AS avg_score, min(quality_score) AS min_score, max(quality_score) AS max_score, sum(total_records)::BIGINT AS total, sum(quarantined_records)::BIGINT AS quarantined, round(100.0 * sum(quarantined_records) / sum(total_records), 4) AS quarantine_pct, round(avg(freshness_lag_hours), 4) AS avg_lag, count(*)::BIGINT AS n_runs FROM runs GROUP BY 1, 2""")
def gold_daily_quality(spark, sf_dir):
    return gold.daily_quality(run_history(spark, sf_dir))


@query(f"WITH {RUNS} SELECT month::DATE AS date, table_name, reason, n, round(100.0 * n / sum(n) OVER (PARTITION BY month), 4) AS pct_of_day FROM run_reasons")
def gold_error_patterns(spark, sf_dir):
    return gold.error_patterns(run_history(spark, sf_dir))


IMPACT = """i AS (SELECT "timestamp"::DATE AS date, table_name, sum(quarantined_records) AS held, min("timestamp") AS first, sum(CASE WHEN quarantined_financial_value <> 0 THEN quarantined_financial_value ELSE 0.0 END)::DOUBLE AS real, sum(CASE WHEN quarantined_financial_value <> 0 THEN 0.0 ELSE quarantined_records * 11.0 END)::DOUBLE AS estimated, max((quarantined_financial_value <> 0)::INT) AS stated FROM runs GROUP BY 1, 2),
d AS (SELECT date, sum(held)::BIGINT AS quarantined, round(sum(real) + sum(estimated), 2) AS impact, max(stated) AS stated, sum(estimated) AS estimated, min_by(table_name, (-held, first, table_name)) AS most_impacted FROM i GROUP BY 1)"""


@query(f"WITH {RUNS}, {IMPACT} SELECT date, quarantined, impact, CASE WHEN stated = 1 AND estimated = 0 THEN 'real_financial_value' WHEN stated = 1 THEN 'mixed' ELSE 'flat_estimate' END AS source, round(sum(impact) OVER (ORDER BY date), 2) AS cumulative, most_impacted FROM d")
def gold_financial_impact(spark, sf_dir):
    return gold.financial_impact(run_history(spark, sf_dir))


@query(f"""WITH {RUNS}, {DRIFTS} SELECT "timestamp"::DATE AS date, table_name, count(*)::BIGINT AS n_events, string_agg(DISTINCT column_name, ',' ORDER BY column_name) AS columns FROM drifts GROUP BY 1, 2""")
def gold_schema_drift(spark, sf_dir):
    return gold.schema_drift(drift_log(spark, sf_dir))


@query(f"WITH {RUNS} SELECT reason, sum(n)::BIGINT AS n FROM run_reasons GROUP BY 1 ORDER BY n DESC, reason LIMIT 5")
def gold_top_errors(spark, sf_dir):
    return gold.top_errors(gold.error_patterns(run_history(spark, sf_dir)))


@query(f"WITH {RUNS} SELECT sum(total_records)::BIGINT AS total, sum(quarantined_records)::BIGINT AS quarantined, count(*)::BIGINT AS n_runs, count(DISTINCT table_name)::BIGINT AS n_tables FROM runs")
def gold_totals(spark, sf_dir):
    return gold.totals(run_history(spark, sf_dir))


@query(f"WITH {RUNS} SELECT table_name, round(sum(quarantined_financial_value), 2) AS cost, sum(quarantined_records)::BIGINT AS quarantined FROM runs GROUP BY 1")
def gold_most_impacted(spark, sf_dir):
    return gold.most_impacted(run_history(spark, sf_dir))


@query(f"""WITH {RUNS} SELECT "timestamp"::DATE AS date, table_name, round(avg(quality_score), 4) AS avg_score FROM runs WHERE "timestamp"::DATE >= DATE '1998-01-01' - 400 GROUP BY 1, 2""")
def gold_last_days(spark, sf_dir):
    return gold.last_days(gold.daily_quality(run_history(spark, sf_dir)), 400, "1998-01-01").select("date", "table_name", "avg_score")


# ---- history ----------------------------------------------------------------


@query(f"WITH {RUNS} SELECT run_id, quality_score FROM runs WHERE lower(table_name) = 'orders' AND quality_score < 99 AND \"timestamp\" >= TIMESTAMP '1998-01-01' - INTERVAL 900 DAY AND NOT (quarantined_records > 100000)")
def history_filter(spark, sf_dir):
    q = {"must": [{"term": {"table_name": {"value": "ORDERS", "case_insensitive": True}}}], "filter": [{"range": {"quality_score": {"lt": 99}}}, {"range": {"timestamp": {"gte": "now-900d"}}}, {"exists": {"field": "run_id"}}], "must_not": [{"range": {"quarantined_records": {"gt": 100000}}}]}
    return history.where(run_history(spark, sf_dir), q, "1998-01-01").select("run_id", "quality_score")


@query(f"WITH {RUNS} SELECT run_id, quality_score FROM runs ORDER BY quality_score DESC NULLS LAST, run_id OFFSET 5 LIMIT 10")
def history_page(spark, sf_dir):
    return history.page(run_history(spark, sf_dir).select("run_id", "quality_score"), [("quality_score", "desc"), ("run_id", "asc")], 5, 10)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 300 LIMIT 100")
def order_pages(spark, sf_dir):
    """The fourth page of 100, reached from page to page."""
    o, sort, last = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", "desc"), ("o_orderkey", "asc")], None
    for _ in range(3):
        last = history.seek(o, sort, 100, last).agg(F.max_by(F.struct("o_totalprice", "o_orderkey"), F.struct(-F.col("o_totalprice"), "o_orderkey"))).first()[0]
    return history.seek(o, sort, 100, last)


@query(f"WITH {RUNS}, {LATEST} SELECT table_name, run_id, quality_score, n_rows FROM latest")
def history_latest(spark, sf_dir):
    return history.latest_per(run_history(spark, sf_dir), "table_name").select("table_name", "run_id", "quality_score", "n_rows")


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name), '#0000001') OR contains(lower(c_mktsegment), '#0000001')")
def indexed_search(spark, sf_dir):
    """Rows with a text, of a table whose files are signed; the scan's own answer is search_rows'."""
    path = scratch(spark, "searched")
    versions.upsert(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, ["c_custkey"], file_rows=100)
    search.index_files(spark, path)
    return search.search(spark, path, "#0000001").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE contains(lower(concat_ws(chr(31), c_custkey::VARCHAR, c_name, c_mktsegment)), '11') AND c_nationkey >= 0")
def search_rows(spark, sf_dir):
    return history.search_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "11").select("c_custkey")


@query(f"""WITH {RUNS}, {PIPELINES} SELECT sum(total_records)::BIGINT AS records, sum(quarantined_records)::BIGINT AS quarantined, round(avg(quality_score), 4) AS avg_score, (SELECT round(avg(duration_seconds) / 60, 2) FROM (SELECT * FROM pipes WHERE state <> 'failed' ORDER BY "timestamp" DESC, run_id DESC LIMIT 20)) AS avg_minutes FROM runs""")
def kpi_totals(spark, sf_dir):
    return history.kpis(run_history(spark, sf_dir), pipeline_runs(spark, sf_dir))


@query(f"""WITH {RUNS} SELECT "timestamp", max(quality_score) FILTER (table_name = 'orders') AS orders, max(quality_score) FILTER (table_name = 'lineitem') AS lineitem, max(quality_score) FILTER (table_name = 'events') AS events FROM runs GROUP BY 1""")
def score_series(spark, sf_dir):
    return history.score_series(run_history(spark, sf_dir), ["orders", "lineitem", "events"])


@query(f"""WITH {RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY "timestamp" DESC, run_id DESC) AS nth FROM runs QUALIFY nth <= 10),
t AS (SELECT *, (epoch_us("timestamp") - min(epoch_us("timestamp")) OVER w) / 86400000000.0::DOUBLE AS d, max("timestamp") OVER w > min("timestamp") OVER w AS spread, max(nth) OVER w AS most FROM r WINDOW w AS (PARTITION BY table_name)),
x AS (SELECT table_name, nth, quality_score AS y, CASE WHEN spread THEN d ELSE (most - nth)::DOUBLE END AS x FROM t),
a AS (SELECT table_name, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, max(x) AS today, min_by(y, nth) AS newest FROM x GROUP BY 1 HAVING count(*) >= 2),
l AS (SELECT *, CASE WHEN n * sxx - sx * sx <> 0 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE -0.5 END AS slope FROM a), m AS (SELECT *, (sy - slope * sx) / n AS at0, sy / n AS mean FROM l),
e AS (SELECT table_name, n, slope, at0, today, newest, greatest(5.0, least(100.0, 100 - 4 * sqrt(sum((y - mean) ** 2) / n))) AS stability, greatest(sqrt(CASE WHEN n > 2 THEN sum((y - slope * x - at0) ** 2) / (n - 2) ELSE 2.0 END), 0.5)::DOUBLE AS error FROM m JOIN x USING (table_name) GROUP BY table_name, n, slope, at0, today, newest),
v AS (SELECT *, greatest(0.0, least(100.0, at0 + (today + day) * slope)) AS value, error * (1 + 0.2::DOUBLE * day) AS margin FROM e, range(1, 8) d(day)),
z AS (SELECT *, round(value, 2) AS projected, abs(round(value, 2) - 95) / error / sqrt(2.0) AS z FROM v), u AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * z) AS t FROM z),
w AS (SELECT *, 1 - (((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t) + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-z * z) AS erf FROM u),
c AS (SELECT table_name, max(CASE WHEN projected >= 95 THEN 0.5 * (1 - erf) ELSE 0.5 * (1 + erf) END) AS chance, min(day) FILTER (projected < 90) AS crisis, min_by(projected, day) FILTER (projected < 90) AS low FROM w GROUP BY 1)
SELECT table_name, day::INTEGER AS day, projected, round(greatest(0.0, value - margin), 2) AS low, round(least(100.0, value + margin), 2) AS high, round(slope, 3) AS slope, round(stability, 1) AS stability, round(CASE WHEN newest < 95 THEN 99.9 ELSE greatest(0.1, least(99.9, 100 * chance)) END, 1)::DOUBLE AS breach, coalesce(crisis, 7)::INTEGER AS days_until_crisis,
  CASE WHEN crisis IS NULL THEN 'None' WHEN slope < -1 THEN 'Ingestion Pipeline Gateway' ELSE 'Data Quality Validation Layer' END AS impacted, CASE WHEN crisis IS NULL THEN 'LOW' WHEN c.low < 80 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM w JOIN c USING (table_name)""")
def quality_projection(spark, sf_dir):
    return history.projection(run_history(spark, sf_dir))


CLUSTERS = f"""newest AS (SELECT table_name, max("timestamp") AS month, max_by(quarantined_records, "timestamp") AS held FROM runs GROUP BY 1),
c AS (SELECT table_name, reason, n FROM run_reasons JOIN newest USING (table_name, month) UNION ALL SELECT table_name, 'quarantined_' || table_name, held FROM newest ANTI JOIN run_reasons USING (table_name, month) WHERE held > 0),
k AS (SELECT *, CASE {' '.join(f"WHEN starts_with(reason, '{p}') THEN '{c}'" for p, c in history.PREFIXES)} {' '.join(f"WHEN reason = '{p}' THEN '{c}'" for p, c in history.EXACT)} WHEN starts_with(reason, 'duplicate') THEN '{history.DUPLICATE}' WHEN contains(reason, 'drift') THEN '{history.DRIFTED}' WHEN starts_with(reason, 'quarantined_') THEN '{history.UNNAMED}' ELSE '{history.OTHER}' END AS category FROM c),
clusters AS (SELECT table_name, (row_number() OVER (PARTITION BY table_name ORDER BY n DESC, reason))::INTEGER AS place, reason, category, nullif(regexp_extract(reason, '^(outlier_|zscore_|out_of_range_|null_value_in_|invalid_type_)(.*)$', 2), '') AS "column", n, round(100.0 * n / sum(n) OVER (PARTITION BY table_name), 1) AS share FROM k)"""


@query(f"WITH {RUNS}, {CLUSTERS} SELECT * FROM clusters")
def reason_clusters(spark, sf_dir):
    return history.clusters(run_history(spark, sf_dir))


COSTS = """newest_drift AS (SELECT max_by(severity, (seen, run_id)) AS drift FROM (SELECT run_id, max("timestamp") AS seen, sum(severity)::BIGINT AS severity FROM drifts GROUP BY 1)),
sums AS (SELECT coalesce(sum(quarantined_records), 0)::BIGINT AS held, coalesce(sum(quarantined_financial_value), 0.0) AS value, coalesce(nullif(sum(total_records), 0), 1) AS total FROM runs),
costs AS (SELECT held * 2 AS correction, CASE WHEN value > 0 THEN trunc(value) ELSE trunc(held * 0.05 * 50) END::BIGINT AS opportunity, held * coalesce(drift, 1) AS risk, round(100.0 * held / total * 0.8, 2)::DOUBLE AS sales_impact_pct, round(CASE WHEN drift IS NOT NULL THEN drift * (100.0 * held / total) * 0.3 ELSE 100.0 * held / total * 0.4 END, 2)::DOUBLE AS inventory_impact_pct FROM sums, newest_drift)"""


@query(f"WITH {RUNS}, {DRIFTS}, {COSTS} SELECT *, correction + opportunity + risk AS total, CASE WHEN sales_impact_pct < 10 THEN 'WARN' ELSE 'CRITICAL' END AS sales_status, CASE WHEN inventory_impact_pct > 5 THEN 'CRITICAL' ELSE 'OK' END AS inventory_status FROM costs")
def cost_of_poor_data(spark, sf_dir):
    return history.cost_of_poor_data(run_history(spark, sf_dir), drift_log(spark, sf_dir))


@query(f"WITH {RUNS}, s AS (SELECT *, 100.0 * clean_records / total_records AS share FROM runs) SELECT run_id, total_records AS inbound, clean_records AS delivered, total_records - clean_records AS gap, CASE WHEN share >= 95 THEN 'OK' WHEN share >= 90 THEN 'WARNING' ELSE 'CRITICAL' END AS status, round(share, 4) AS integrity_pct FROM s")
def volume_reconciliation(spark, sf_dir):
    return history.reconciliation(run_history(spark, sf_dir))


ACTIONS = "CASE WHEN contains(reason, 'primary_key') THEN 'FIX_SOURCE_KEY' WHEN contains(reason, 'outlier') OR contains(reason, 'zscore') THEN 'TUNE_OUTLIER_RULE' WHEN contains(reason, 'null') OR contains(reason, 'missing') THEN 'FIX_SOURCE_NULLS' WHEN contains(reason, 'duplicate') THEN 'REVIEW_KEY' WHEN contains(reason, 'range') THEN 'REVIEW_RANGE' END"


@query(f"""WITH {RUNS}, {DRIFTS}, {LATEST}, low AS (SELECT * FROM latest WHERE quality_score < effective_quality_threshold),
c AS (SELECT l.table_name, {ACTIONS} AS action, sum(n)::DOUBLE AS weight FROM low l JOIN run_reasons q ON q.table_name = l.table_name AND q.month = l."timestamp" WHERE {ACTIONS} IS NOT NULL GROUP BY 1, 2)
SELECT table_name, 'summary' AS kind, 'SUMMARY' AS action, quality_score::DOUBLE AS weight, CASE WHEN quality_score >= effective_quality_threshold THEN 'OK' ELSE 'CRITICAL' END AS status FROM latest
UNION ALL (SELECT table_name, 'cause', action, weight, 'RECOMMENDED' FROM c QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY weight DESC, action) <= 3)
UNION ALL SELECT table_name, 'restore', 'RESTORE_BACKUP', quality_score, 'AVAILABLE' FROM low WHERE quality_score < 70
UNION ALL SELECT table_name, 'drift', 'SETTLE_DRIFT', count(*)::DOUBLE, 'RECOMMENDED' FROM drifts GROUP BY 1""")
def recommendations(spark, sf_dir):
    return history.recommendations(run_history(spark, sf_dir), drift_log(spark, sf_dir))


@query(f"""WITH {RUNS}, {DRIFTS}, x AS (SELECT *, 99.9::DOUBLE AS least FROM runs), low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY "timestamp" DESC, run_id DESC) AS nth FROM x) WHERE nth = 1 AND quality_score < least),
c AS (SELECT l.table_name, {ACTIONS} AS action, sum(n)::DOUBLE AS weight FROM low l JOIN run_reasons q ON q.table_name = l.table_name AND q.month = l."timestamp" WHERE {ACTIONS} IS NOT NULL GROUP BY 1, 2)
SELECT table_name, action, weight FROM c QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY weight DESC, action) <= 3 UNION ALL SELECT table_name, 'RESTORE_BACKUP', quality_score FROM low WHERE quality_score < 99.5""")
def recommended_causes(spark, sf_dir):
    strict = run_history(spark, sf_dir).withColumn("effective_quality_threshold", F.lit(99.9))
    found = history.recommendations(strict, drift_log(spark, sf_dir), restore_under=99.5)
    return found.filter("kind in ('cause', 'restore')").select("table_name", "action", "weight")


@query(f"""WITH {RUNS}, {DRIFTS}, {LATEST}, t AS (SELECT l.table_name, quality_score, (SELECT count(*) FROM drifts d WHERE d.table_name = l.table_name AND d.status = 'PENDING')::BIGINT AS pending FROM latest l) SELECT *, CASE WHEN quality_score < 95 AND pending > 0 THEN 'HALT_INGEST' WHEN quality_score < 95 OR pending > 0 THEN 'WARNING_SUSPECT' ELSE 'SAFE' END AS verdict FROM t""")
def trust_check(spark, sf_dir):
    return history.trust_check(run_history(spark, sf_dir), drift_log(spark, sf_dir))


@query(f"""WITH {RUNS}, {DRIFTS}, {LATEST}, g AS (SELECT * FROM (VALUES ('orders', 'order_key'), ('supplier', 's_suppkey')) t(table_name, primary_key)) SELECT coalesce(g.table_name, l.table_name) AS table_name, primary_key, run_id AS last_run, quality_score, (SELECT count(*) FROM drifts d WHERE d.table_name = coalesce(g.table_name, l.table_name) AND d.status = 'PENDING')::BIGINT AS pending FROM g FULL JOIN latest l ON g.table_name = l.table_name""")
def table_catalog(spark, sf_dir):
    registry = spark.createDataFrame([("orders", "order_key"), ("supplier", "s_suppkey")], "table_name string, primary_key string")
    return history.catalog(registry, run_history(spark, sf_dir), drift_log(spark, sf_dir))


@query(f"""WITH {RUNS}, {DRIFTS}, {PIPELINES} SELECT * FROM (SELECT "timestamp", 'pipeline' AS kind, table_name, run_id || ':' || state AS subject, CASE state WHEN 'failed' THEN 'error' WHEN 'warnings' THEN 'warning' ELSE 'info' END AS level FROM pipes UNION ALL SELECT "timestamp", 'quality_run', table_name, run_id, CASE WHEN quality_score >= 90 THEN 'success' ELSE 'warning' END FROM runs UNION ALL SELECT "timestamp", 'schema_drift', table_name, run_id || ':' || column_name, 'error' FROM drifts) ORDER BY "timestamp" DESC, kind, subject LIMIT 50""")
def activity_feed(spark, sf_dir):
    return history.activity(pipeline_runs(spark, sf_dir), run_history(spark, sf_dir), drift_log(spark, sf_dir))


@query(f"""WITH {RUNS}, {PIPELINES}, l AS (SELECT *, row_number() OVER (ORDER BY "timestamp" DESC, run_id DESC) AS nth FROM pipes QUALIFY nth <= 100) SELECT round(100.0 * avg((state <> 'failed')::INT), 1) AS success_pct, round(avg(floor(duration_seconds)) FILTER (nth <= 6), 1) AS avg_seconds FROM l""")
def run_performance(spark, sf_dir):
    return history.run_performance(pipeline_runs(spark, sf_dir))


@query(f"""WITH {RUNS}, {DRIFTS}, {PIPELINES}, k AS (SELECT coalesce(sum(n) FILTER (regexp_matches(reason, 'null|missing')), 0) AS missing, coalesce(sum(n) FILTER (contains(reason, 'duplicate')), 0) AS duplicate, coalesce(sum(n) FILTER (NOT regexp_matches(reason, 'null|missing|duplicate|drift')), 0) AS invalid FROM run_reasons),
t AS (SELECT quality_score - lag(quality_score) OVER (ORDER BY "timestamp", run_id) AS trend, row_number() OVER (ORDER BY "timestamp" DESC, run_id DESC) AS nth FROM runs),
o AS (SELECT avg(quality_score) AS score, sum(total_records) AS total, avg((freshness_lag_hours <= 1)::INT) AS fresh FROM runs)
SELECT CASE WHEN score >= 95 THEN 'Good' WHEN score >= 88 THEN 'Warning' ELSE 'Critical' END AS health, round(score, 4) AS score, (SELECT round(100 * avg((state <> 'failed')::INT), 1) FROM pipes) AS availability, round(100 * fresh, 1) AS fresh_pct, round(100.0 * missing / total, 4) AS missing_pct, round(100.0 * duplicate / total, 4) AS duplicate_pct, round(100.0 * invalid / total, 4) AS invalid_pct, (SELECT round(trend, 4) FROM t WHERE nth = 1) AS trend, (SELECT count(*)::BIGINT FROM drifts) AS n_drifts FROM o, k""")
def executive_overview(spark, sf_dir):
    return history.executive(run_history(spark, sf_dir), drift_log(spark, sf_dir), pipeline_runs(spark, sf_dir))


@query(f"""WITH {RUNS}, {DRIFTS}, {PIPELINES}, h AS (SELECT table_name FROM runs GROUP BY 1 HAVING sum(quarantined_records) > 0),
f AS (SELECT count(*) AS n, coalesce(bool_or(regexp_matches(table_name, 'sale|order|trans|grocery|bill|invoice')), false) AS sales, coalesce(bool_or(regexp_matches(table_name, 'user|cust|student|mbti|member|client')), false) AS customer, coalesce(bool_or(regexp_matches(table_name, 'prod|item|inventory|stock|supply|course|dirty')), false) AS ops,
  coalesce(string_agg(table_name, ',' ORDER BY table_name) FILTER (regexp_matches(table_name, 'sale|order|trans|grocery|bill|invoice')), '') AS st, coalesce(string_agg(table_name, ',' ORDER BY table_name) FILTER (regexp_matches(table_name, 'user|cust|student|mbti|member|client')), '') AS ct, coalesce(string_agg(table_name, ',' ORDER BY table_name) FILTER (regexp_matches(table_name, 'prod|item|inventory|stock|supply|course|dirty')), '') AS ot FROM h),
b AS (SELECT round(100 - round(100.0 * sum(quarantined_records) / sum(total_records), 2), 1) AS base FROM runs), p AS (SELECT count(*) FILTER (state = 'failed') AS failed, round(100.0 * count(*) FILTER (state <> 'failed') / count(*), 1) AS available FROM pipes), d AS (SELECT count(*) AS drifts, coalesce(string_agg(DISTINCT table_name, ',' ORDER BY table_name), '') AS dt FROM drifts),
a AS (SELECT *, ops OR (n > 0 AND NOT sales AND NOT customer) AS operations FROM f, b, p, d)
SELECT 'sales' AS area, CASE WHEN sales THEN 'Warning' ELSE 'Normal' END AS status, CASE WHEN sales THEN round(base - 2.0, 1) ELSE base END AS health_pct, st AS tables FROM a
UNION ALL SELECT 'customer', CASE WHEN customer THEN 'Warning' ELSE 'Normal' END, CASE WHEN customer THEN round(base - 5.0, 1) ELSE base END, ct FROM a
UNION ALL SELECT 'operations', CASE WHEN operations THEN 'Warning' ELSE 'Normal' END, CASE WHEN operations THEN round(base - 1.5, 1) ELSE base END, ot FROM a
UNION ALL SELECT 'reporting', CASE WHEN failed > 0 OR drifts > 0 THEN 'Warning' ELSE 'Normal' END, CASE WHEN failed > 0 THEN round(available - 3.0, 1) ELSE available END, dt FROM a
UNION ALL SELECT 'finance', 'Normal', base, '' FROM a""")
def executive_areas(spark, sf_dir):
    return history.area_status(run_history(spark, sf_dir), drift_log(spark, sf_dir), pipeline_runs(spark, sf_dir))


@query(f"""WITH {RUNS}, {PROFILES}, rules AS (
  SELECT n.run_id, 'completeness' AS dimension, null_rate <= tolerance AND NOT EXISTS (SELECT 1 FROM named m WHERE m.run_id = n.run_id AND contains(reason, 'null') AND contains(reason, col)) AS passed FROM nulls n
  UNION ALL SELECT run_id, 'validity', total_records > 0 FROM runs
  UNION ALL SELECT r.run_id, 'validity', NOT EXISTS (SELECT 1 FROM named m WHERE m.run_id = r.run_id AND regexp_matches(reason, 'outlier|range') AND contains(reason, col)) FROM ranges r
  UNION ALL SELECT run_id, 'uniqueness', NOT EXISTS (SELECT 1 FROM named m WHERE m.run_id = runs.run_id AND contains(reason, 'duplicate')) FROM runs)
SELECT run_id, dimension, count(*)::BIGINT AS tested, sum(passed::INT)::BIGINT AS passed, round(100.0 * avg(passed::INT), 4) AS pass_pct FROM rules GROUP BY 1, 2""")
def dimension_scorecard(spark, sf_dir):
    return history.scorecard(run_history(spark, sf_dir), *run_profiles(spark, sf_dir))


@query(f"""WITH {RUNS}, s AS (SELECT table_name, sum(total_records)::BIGINT AS t, sum(quarantined_records)::BIGINT AS q, sum(quarantined_records // 4)::BIGINT AS r FROM runs GROUP BY 1)
SELECT table_name, 'compliant' AS share, t - q - r AS rows, round(100.0 * (t - q - r) / t, 1) AS pct FROM s UNION ALL SELECT table_name, 'at_risk', r, round(100.0 * r / t, 1) FROM s UNION ALL SELECT table_name, 'non_compliant', q, round(100.0 * q / t, 1) FROM s""")
def compliance_shares(spark, sf_dir):
    return history.compliance(run_history(spark, sf_dir).withColumn("review_records", F.expr("quarantined_records div 4")))
