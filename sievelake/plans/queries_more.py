"""Queries over relations, fuzzy matching, advice, dashboards, evaluation, sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import align
from ..functions.tables import scratch
from ..operators import advise, dash, evaluate, infer, metrics, profile, profile_state, profile_store, relate, repair, semantic, sinks, versions, zones
from ..sources import read
from ..streaming import stream
from .fixtures import DIRTY, RUNS, dirty_orders, run_history, table
from .queries_core import PRIORITIES, TAGGED, ZONED, tagged_orders, zoned_orders

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- E: relations ------------------------------------------------------------


@query("""WITH x AS (SELECT unnest(['o_orderkey', 'o_custkey']) AS c, unnest([o_orderkey, o_custkey]) AS v FROM orders), y AS (SELECT unnest(['c_custkey', 'c_nationkey']) AS c, unnest([c_custkey, c_nationkey::BIGINT]) AS v FROM customer),
xs AS (SELECT c, v, count(*) AS n FROM x GROUP BY 1, 2), ys AS (SELECT c, v, count(*) AS n FROM y GROUP BY 1, 2), xd AS (SELECT c, count(*) AS d, max(n) = 1 AS u FROM xs GROUP BY 1), yd AS (SELECT c, count(*) AS d, max(n) = 1 AS u FROM ys GROUP BY 1),
s AS (SELECT xs.c AS a, ys.c AS b, count(*)::BIGINT AS shared FROM xs JOIN ys ON xs.v = ys.v GROUP BY 1, 2),
p AS (SELECT a, b, shared, round(shared / least(xd.d, yd.d), 6) AS rate, round(shared / least(xd.d, yd.d) + CASE WHEN xd.u OR yd.u THEN 0.25 ELSE 0 END, 6)::DOUBLE AS score, xd.u AS au, yd.u AS bu, xd.d AS ad, yd.d AS bd FROM s JOIN xd ON xd.c = a JOIN yd ON yd.c = b WHERE shared >= 2 AND shared / least(xd.d, yd.d) >= 0.5 AND (xd.u OR yd.u)),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, a, b)::INT AS place, CASE WHEN au AND bu THEN CASE WHEN (SELECT count(*) FROM orders) >= (SELECT count(*) FROM customer) THEN 'a' ELSE 'b' END WHEN NOT au AND bu THEN 'a' ELSE 'b' END AS base FROM p QUALIFY place <= 4),
m AS (SELECT *, round(100.0 * shared / CASE WHEN base = 'a' THEN ad ELSE bd END, 2) AS match_pct FROM r)
SELECT place, a AS a_column, b AS b_column, shared, rate, score, CASE WHEN au AND bu THEN '1:1' WHEN au OR bu THEN '1:N' ELSE 'N:M' END AS cardinality, base, match_pct, CASE WHEN match_pct >= 90 AND (au OR bu) THEN 'STRONG' ELSE 'POSSIBLE' END AS verdict FROM m""")
def relationship_report(spark, sf_dir):
    return relate.analyze(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))


@query("SELECT 'c_custKey' AS a_column, 'c_cust_key' AS b_column FROM customer UNION SELECT 'Nation Key', 'nation_key' FROM nation")
def column_name_mappings(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c_custKey"), F.col("c_nationkey").alias("Nation Key"), "c_name")
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c_cust_key"), F.col("c_nationkey").alias("nation_key"), "c_name")
    return relate.name_mappings(a, b)


@query("SELECT (SELECT count(DISTINCT o_custkey) = count(o_custkey) FROM orders) AS a_unique, true AS b_unique, 'N:1' AS cardinality, 'b' AS lookup")
def join_roles(spark, sf_dir):
    return relate.roles(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer"), "c_custkey")


@query("SELECT count(*)::BIGINT AS rows, count(o_custkey)::BIGINT AS matched, round(count(o_custkey) / count(*), 6) AS match_rate FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey")
def join_match_rate(spark, sf_dir):
    return relate.match_rate(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT c_custkey, c_name, o_orderkey, o_custkey IS NOT NULL AS matched FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) ON o_custkey = c_custkey")
def reconciled_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("o_custkey", F.col("o_custkey").cast("double"))
    return relate.join(table(spark, sf_dir, "customer"), o, "c_custkey", "o_custkey", order=("o_orderkey",)).select("c_custkey", "c_name", "o_orderkey", "matched")


@query("SELECT 'o_iso' AS \"column\", 'YYYY-MM-DD' AS form FROM orders HAVING avg((strftime(o_orderdate, '%Y-%m-%d') SIMILAR TO '[0-9]{4}-[0-9]{2}-[0-9]{2}')::INT) >= 0.9 UNION ALL SELECT 'o_dmy', 'DD/MM/YYYY' FROM orders HAVING avg((strftime(o_orderdate, '%d/%m/%Y') SIMILAR TO '[0-9]{2}/[0-9]{2}/[0-9]{4}')::INT) >= 0.9")
def date_forms(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return relate.date_formats(o.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_iso"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("o_dmy"), "o_orderstatus"))


# ---- C: fuzzy matching ---------------------------------------------------------


SCORE = """words AS (SELECT a, b, list_distinct(list_filter(regexp_split_to_array(a, '\\s+'), lambda w: w <> '')) AS ta, list_distinct(list_filter(regexp_split_to_array(b, '\\s+'), lambda w: w <> '')) AS tb,
  list_transform(range(1, length(a)), lambda i: substring(a, i, 2)) AS ga, list_transform(range(1, length(b)), lambda i: substring(b, i, 2)) AS gb FROM pairs),
parts AS (SELECT a, b, CASE WHEN contains(a, b) OR contains(b, a) THEN 1.0 ELSE 0.0 END::DOUBLE AS c, CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN len(list_intersect(ta, tb)) / least(len(ta), len(tb)) ELSE 0 END AS t, CASE WHEN len(ga) > 0 AND len(gb) > 0 THEN len(list_intersect(list_distinct(ga), list_distinct(gb))) / least(len(list_distinct(ga)), len(list_distinct(gb))) ELSE 0 END AS g,
  CASE WHEN len(ga) > 0 AND len(gb) > 0 THEN list_sum(list_transform(list_distinct(ga), lambda x: len(list_filter(ga, lambda y: y = x)) * len(list_filter(gb, lambda y: y = x)))) / (sqrt(list_sum(list_transform(list_distinct(ga), lambda x: len(list_filter(ga, lambda y: y = x)) ** 2))) * sqrt(list_sum(list_transform(list_distinct(gb), lambda x: len(list_filter(gb, lambda y: y = x)) ** 2)))) ELSE 0 END AS s FROM words),
raw AS (SELECT a, b, 0.4::DOUBLE * c + 0.3::DOUBLE * CASE WHEN t > 0 THEN t ELSE g END + 0.3::DOUBLE * s AS r FROM parts), scored AS (SELECT a, b, CASE WHEN a = b OR r >= 0.95 THEN 1.0::DOUBLE ELSE round(r, 6) END AS score FROM raw)"""


@query(f"WITH pairs AS (SELECT DISTINCT lower(trim(x.p_type)) AS a, lower(trim(y.p_type)) AS b FROM (SELECT DISTINCT p_type FROM part) x, (SELECT DISTINCT p_type FROM part) y), {SCORE} SELECT * FROM scored WHERE score >= 0.6")
def similarity_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return semantic.similarity_join(p, p, "p_type", "p_type", 0.6)


KEYS = "keys AS (SELECT * FROM (VALUES ('1-urgent', 'urgent'), ('2-high', 'high'), ('3-medium', 'medium'), ('4-not specified', 'none'), ('5-low', 'low')) t(key, target))"
BEST = f"""{DIRTY}, {KEYS}, vals AS (SELECT lower(trim(priority)) AS value, count(*)::BIGINT AS n FROM dirty GROUP BY 1), pairs AS (SELECT value AS a, key AS b FROM vals, keys WHERE value NOT IN (SELECT key FROM keys)), {SCORE},
best AS (SELECT a AS value, b AS key, score FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1),
found AS (SELECT v.value, v.n, v.value AS key, k.target, 1.0::DOUBLE AS score, 'exact' AS method FROM vals v JOIN keys k ON v.value = k.key UNION ALL SELECT v.value, v.n, b.key, k.target, coalesce(b.score, 0.0), 'fuzzy' FROM vals v LEFT JOIN best b ON v.value = b.value LEFT JOIN keys k ON k.key = b.key WHERE v.value NOT IN (SELECT key FROM keys))"""


@query(f"WITH {BEST} SELECT * FROM found")
def fuzzy_values(spark, sf_dir):
    return semantic.score_values(dirty_orders(spark, sf_dir), "priority", PRIORITIES)


@query(f"WITH {BEST} SELECT d.row_id, CASE WHEN f.score >= 0.85 THEN f.target ELSE 'unknown' END AS category, f.score AS confidence FROM dirty d JOIN found f ON lower(trim(d.priority)) = f.value")
def fuzzy_standardize(spark, sf_dir):
    out = semantic.standardize(dirty_orders(spark, sf_dir), "priority", PRIORITIES, 0.85, "unknown", "fallback")
    return out.select("row_id", "priority_semantic.category", "priority_semantic.confidence")


@query(f"WITH {BEST} SELECT row_id, CASE WHEN f.score >= 0.85 THEN f.target ELSE f.value END AS priority, d.priority AS _raw_priority FROM dirty d JOIN found f ON lower(trim(d.priority)) = f.value")
def semantic_overwrite(spark, sf_dir):
    out = semantic.standardize(dirty_orders(spark, sf_dir), "priority", PRIORITIES)
    return semantic.shape_output(out, "priority", "semantic_overwrite", evolving=True).select("row_id", "priority", "_raw_priority")


@query(f"WITH {BEST} SELECT round(sum(n) FILTER (score >= 0.85) / sum(n), 6) AS match_rate, round(coalesce(sum(n) FILTER (score < 0.85), 0) / sum(n), 6) AS fallback_rate, round(sum(score * n) / sum(n), 6) AS mean_confidence, round(coalesce(sum(n) FILTER (score < 0.85), 0) / sum(n), 6) AS drift_rate, count(*) FILTER (method <> 'exact')::BIGINT AS unseen FROM found")
def mapping_statistics(spark, sf_dir):
    return semantic.mapping_stats(semantic.score_values(dirty_orders(spark, sf_dir), "priority", PRIORITIES))


@query(f"WITH {BEST} SELECT value, n, key, score, CASE WHEN score > 0.90 THEN 'auto_learn' WHEN score > 0.60 THEN 'suggest' ELSE 'other' END AS decision, round(n * (1 - score), 6) AS priority FROM found WHERE method <> 'exact'")
def learning_queue(spark, sf_dir):
    return semantic.review_queue(semantic.score_values(dirty_orders(spark, sf_dir), "priority", PRIORITIES))


@query("SELECT lower(p_brand) AS key, CASE WHEN max(p_size) % 3 = 1 THEN 'own' ELSE max(p_brand) END AS target FROM part GROUP BY 1 HAVING max(p_size) % 3 <> 2")
def reviewed_mapping(spark, sf_dir):
    brands = table(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("key")).agg(F.max("p_brand").alias("target"), F.max("p_size").alias("s"))
    reviews = brands.select("key", F.when(F.col("s") % 3 == 0, "approve").when(F.col("s") % 3 == 1, "override").otherwise("reject").alias("decision"), F.when(F.col("s") % 3 == 1, "own").otherwise(F.col("target")).alias("target"))
    return semantic.apply_reviews(brands.select("key", "target"), reviews)[0]


# PSI of values `new` against the deciles of `old`.
PSI = """b AS (SELECT quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS b FROM old), k AS (SELECT len(list_filter(b[2:10], lambda x: v > x)) AS bucket FROM new, b),
c AS (SELECT bucket, count(*) AS n FROM k GROUP BY 1), s AS (SELECT greatest(coalesce(n, 0) / (SELECT count(*) FROM new), 1e-6) AS a, 0.1 AS e FROM range(10) r(i) LEFT JOIN c ON c.bucket = r.i), psi AS (SELECT round(abs(sum((a - e) * ln(a / e))), 6) AS psi FROM s)"""


# ---- F: advice -----------------------------------------------------------------


@query(f"""WITH {TAGGED}, reasons AS (SELECT order_date, CASE WHEN contains(p, '=') THEN 'outlier_price' ELSE p END AS reason FROM (SELECT order_date, trim(unnest(string_split(reject_reason, ';'))) AS p FROM tagged WHERE reject_reason IS NOT NULL)),
was AS (SELECT reason, count(*) * 3 AS was FROM reasons WHERE order_date < TIMESTAMP '1997-01-01' GROUP BY 1), top AS (SELECT reason, count(*)::BIGINT AS n FROM reasons GROUP BY 1 ORDER BY n DESC, reason LIMIT 3),
c AS (SELECT * FROM (VALUES ('missing_primary_key', 'keys lost at the source', 'null_check', 0.95), ('null_value_in_price', 'fields left empty at the source', 'fillna', 0.90), ('duplicate_records', 'the source sends records again', 'keep_latest', 0.92), ('outlier_price', 'unit or typing errors', 'auto_iqr', 0.80), ('out_of_range_price', 'values beyond what is possible', 'range_check', 0.88), ('missing_date', 'dates lost or in another form', 'parse_timestamp', 0.85)) c(r, cause, rule, base)),
s AS (SELECT 100.0 * count(*) FILTER (reject_reason IS NULL) / count(*) - 100.0 * count(*) FILTER (reject_reason IS NULL AND order_date < TIMESTAMP '1997-01-01') / count(*) FILTER (order_date < TIMESTAMP '1997-01-01') AS delta FROM tagged),
b AS (SELECT top.*, cause, rule, least(base + CASE WHEN n > coalesce(was, 0) THEN 0.03 ELSE 0.0 END, 0.98) AS base, delta FROM top JOIN c ON r = reason LEFT JOIN was USING (reason), s WHERE rule <> 'parse_timestamp')
SELECT reason, n, cause, rule, round(CASE WHEN delta < -10 THEN least(base + 0.05, 0.98) WHEN delta > 5 THEN greatest(base - 0.10, 0.50) ELSE base END, 4)::DOUBLE AS confidence, CASE WHEN delta < -10 THEN 'sharp decline' WHEN delta < -5 THEN 'decline' WHEN delta > 5 THEN 'improving' ELSE 'steady' END AS trend,
  CASE rule WHEN 'keep_latest' THEN 'Upstream Ingestion API / DB Exporter' WHEN 'auto_iqr' THEN 'Upstream Data Entry Client / CSV Producer' WHEN 'range_check' THEN 'Upstream Data Entry Client / CSV Producer' ELSE 'Upstream Source Database / API Schema Validator' END AS ticket_system, CASE WHEN rule IN ('null_check', 'fillna') THEN 'critical' ELSE 'warning' END AS severity FROM b""")
def root_causes(spark, sf_dir):
    t = tagged_orders(spark, sf_dir)
    rejected, early = t.filter("zone = 'quarantine'"), F.col("order_date") < F.lit("1997-01-01").cast("timestamp")
    history = rejected.filter(early).select(F.explode(metrics.reasons_of(F.col("reject_reason"))).alias("reason")).groupBy("reason").agg((3 * F.count("*")).alias("n"))
    share = lambda c: 100 * F.count(F.when(c & (F.col("zone") == "clean"), 1)) / F.count(F.when(c, 1))
    scores = t.agg(share(F.lit(True)).alias("current"), share(early).alias("average"))
    return advise.root_cause(rejected, history, spark.createDataFrame([("parse_timestamp",)], "rule string"), scores)


@query(f"""WITH {DIRTY}, q AS (SELECT count(*) AS n, count(*) FILTER (price IS NULL) AS nulls, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3, count(DISTINCT priority) AS prios, count(DISTINCT status) AS states FROM dirty),
f AS (SELECT *, (SELECT count(*) FROM dirty WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)) AS outliers, (SELECT n - count(DISTINCT order_id) FROM (SELECT coalesce(order_key, -1) AS order_id FROM dirty)) AS again FROM q)
SELECT 'composite_unique' AS rule_type, 'order_id' AS "column", 'Quarantine' AS action, NULL::DOUBLE AS low, NULL::DOUBLE AS high, again || ' repeated rows' AS rationale FROM f WHERE again > 0
UNION ALL SELECT 'null_check', 'price', 'Quarantine', NULL, NULL, nulls || ' nulls' FROM f WHERE nulls > 0 UNION ALL SELECT 'null_check', 'order_id', 'Quarantine', NULL, NULL, count(*) || ' nulls' FROM dirty WHERE order_key IS NULL HAVING count(*) > 0
UNION ALL SELECT 'range_check', 'price', 'Quarantine', 0.0, NULL, 'bounds of what the name says' FROM f
UNION ALL SELECT 'auto_iqr', 'price', 'Review', floor(round(q1, 4) - 3 * (round(q3, 4) - round(q1, 4))), floor(round(q3, 4) + 3 * (round(q3, 4) - round(q1, 4))), outliers || ' outliers' FROM f WHERE outliers > 0
UNION ALL SELECT 'category_consistency', 'status', 'Review', NULL, NULL, states || ' categories' FROM f WHERE states BETWEEN 2 AND 25 UNION ALL SELECT 'category_consistency', 'priority', 'Review', NULL, NULL, prios || ' categories' FROM f WHERE prios BETWEEN 2 AND 25
UNION ALL SELECT 'freshness', 'date_text', 'Warning', NULL, NULL, 'dated table' FROM f""")
def recommended_rules(spark, sf_dir):
    rules = advise.recommend_rules(dirty_orders(spark, sf_dir).select(F.col("order_key").alias("order_id"), "price", "status", "priority", "date_text"))
    # Fences fall on half cents, which engines round either way.
    return rules.withColumns({c: F.floor(c).cast("double") for c in ("low", "high")})


@query("""WITH s AS (SELECT min(l_discount) >= 0 AND max(l_discount) <= 100 AS d, min(l_extendedprice) >= 0 AND max(l_extendedprice) <= 100 AS p FROM lineitem)
SELECT * FROM (VALUES ('order_key', 'numeric', 'identifier', NULL, NULL, NULL, false), ('l_quantity', 'numeric', 'measure', 'count', NULL, 'sum', false), ('ShipDate', 'date', 'time', NULL, NULL, NULL, false), ('l_returnflag', 'categorical', 'dimension', NULL, NULL, NULL, false), ('message_count', 'numeric', 'measure', 'count', NULL, 'sum', false), ('lagDays', 'numeric', 'measure', 'duration', 'hours', 'avg', false), ('customerName', 'categorical', 'dimension', NULL, NULL, NULL, true)) t("column", kind, role, unit, duration_unit, default_agg, is_personal)
UNION ALL SELECT 'discount_rate', 'numeric', 'measure', CASE WHEN d THEN 'percent' ELSE 'number' END, NULL, CASE WHEN d THEN 'avg' ELSE 'sum' END, false FROM s UNION ALL SELECT 'price_score', 'numeric', 'measure', CASE WHEN p THEN 'percent' ELSE 'currency' END, NULL, CASE WHEN p THEN 'avg' ELSE 'sum' END, false FROM s""")
def column_roles(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    names = {"l_orderkey": "order_key", "l_quantity": "l_quantity", "l_shipdate": "ShipDate", "l_returnflag": "l_returnflag", "l_discount": "discount_rate", "l_extendedprice": "price_score", "l_linenumber": "message_count", "l_tax": "lagDays", "l_linestatus": "customerName"}
    return advise.column_roles(l.select(*[F.col(c).alias(n) for c, n in names.items()]))


@query("SELECT 'c_name' AS \"column\", count(*) FILTER (c_name IS NULL)::BIGINT AS missing, count(DISTINCT c_name)::BIGINT AS n_distinct, NULL::DOUBLE AS mean FROM customer UNION ALL SELECT 'c_acctbal', count(*) FILTER (c_acctbal IS NULL), count(DISTINCT c_acctbal), round(avg(c_acctbal), 4) FROM customer")
def dashboard_profile(spark, sf_dir):
    return profile.kinds(table(spark, sf_dir, "customer").select("c_name", "c_acctbal")).select("column", "missing", "n_distinct", "mean")


@query(f"WITH old AS (SELECT o_totalprice AS v FROM orders), new AS (SELECT o_totalprice * 3 AS v FROM orders), {PSI} SELECT 'o_totalprice' AS \"column\", 'iqr_multiplier' AS parameter, 2.5::DOUBLE AS value, 0.83::DOUBLE AS confidence FROM psi WHERE psi > 0.25")
def drift_advice(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_totalprice")
    stored = profile.distribution(o, ["o_totalprice"]).select("column", "boundaries", F.lit(0.0).alias("ema_null_rate"))
    return advise.from_drift(o.select((F.col("o_totalprice") * 3).alias("o_totalprice")), stored, ["o_totalprice"])


@query()
def tree_rules(spark, sf_dir):
    t = tagged_orders(spark, sf_dir).withColumn("month", F.month("order_date"))
    rules, auc = advise.tree_rules(t.filter("zone = 'clean'"), t.filter("zone = 'quarantine'"), ["price", "cust_key", "month"])
    return t.limit(1).select(F.lit(auc).alias("auc"), F.explode_outer(F.array(*map(F.lit, rules)) if rules else F.array().cast("array<string>")).alias("condition"))


@query("WITH a AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE o_orderkey % 2 = 1) SELECT 'o_totalprice' AS \"column\", round(0.3::DOUBLE * b.m + 0.7::DOUBLE * a.m, 6) AS mean, round(0.3::DOUBLE * b.s + 0.7::DOUBLE * a.s, 6) AS sd, least(a.lo, b.lo) AS min, greatest(a.hi, b.hi) AS max, 2 AS version, '0.0,0.0' AS null_history FROM a, b")
def profile_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")

    def one(odd: int, version: int, history: list[float]) -> DataFrame:
        p = profile.distribution(o.filter(F.col("o_orderkey") % 2 == odd), ["o_totalprice"])
        return p.select(F.lit("orders").alias("table_name"), "column", "mean", "sd", "min", "max", "null_rate", F.array(*map(F.lit, history)).cast("array<double>").alias("null_history"), F.lit(version).alias("version"))

    merged = profile.merge_ema(one(0, 1, [0.0]), one(1, 0, []))
    return merged.select("column", "mean", "sd", "min", "max", "version", F.array_join(F.col("null_history").cast("array<string>"), ",").alias("null_history"))


# ---- J: dashboards --------------------------------------------------------------


def _sales(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("o_orderkey", "o_orderdate", F.col("o_totalprice").alias("amount"), F.when(F.col("o_orderkey") % 13 != 0, F.col("r_name")).alias("region"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"))


SALES = "sales AS (SELECT o_orderkey, o_orderdate, o_totalprice AS amount, CASE WHEN o_orderkey % 13 <> 0 THEN r_name END AS region, c_mktsegment AS segment, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
TOTAL = {"agg": "sum", "column": "amount"}


@query(f"WITH {SALES} SELECT count(*)::BIGINT AS n, count(DISTINCT region)::BIGINT AS regions, count(*) FILTER (region IS NULL)::BIGINT AS missing, round(sum(amount), 4) AS total, round(avg(amount), 4) AS mean, round(100.0 * sum(amount) FILTER (segment = 'BUILDING') / sum(amount), 2)::DOUBLE AS building_pct FROM sales")
def dash_metrics(spark, sf_dir):
    m = {"n": {"agg": "count"}, "regions": {"agg": "count_distinct", "column": "region"}, "missing": {"agg": "count_missing", "column": "region"}, "total": TOTAL, "mean": {"agg": "avg", "column": "amount"}}
    ratio = {"numerator": {**TOTAL, "where": [["segment", "eq", "BUILDING"]]}, "denominator": TOTAL, "percent": True}
    return _sales(spark, sf_dir).agg(*[dash.metric(d).alias(k) for k, d in m.items()], F.round(dash.metric(ratio), 2).alias("building_pct"))


@query(f"WITH {SALES}, p AS (SELECT date_trunc('month', o_orderdate) AS x, round(sum(amount), 4) AS v FROM sales GROUP BY 1 ORDER BY x DESC LIMIT 2) SELECT (SELECT round(sum(amount), 4) FROM sales) AS value, max_by(v, x) AS latest, min_by(v, x) AS previous, round(100 * (max_by(v, x) - min_by(v, x)) / abs(min_by(v, x)), 4) AS change_pct FROM p")
def dash_kpi(spark, sf_dir):
    return dash.kpi(_sales(spark, sf_dir), TOTAL, "o_orderdate")


@query(f"WITH {SALES} SELECT coalesce(region, '(empty)') AS x, round(sum(amount), 4) AS value FROM sales GROUP BY 1 ORDER BY value DESC, x LIMIT 4")
def dash_bar(spark, sf_dir):
    return dash.bar(_sales(spark, sf_dir), "region", TOTAL, top=4)


@query(f"WITH {SALES}, b AS (SELECT nation FROM sales GROUP BY 1 ORDER BY round(avg(amount), 4) DESC, nation LIMIT 6) SELECT CASE WHEN nation IN (SELECT nation FROM b) THEN nation ELSE 'other' END AS label, round(avg(amount), 4) AS value FROM sales GROUP BY 1")
def dash_pie(spark, sf_dir):
    return dash.pie(_sales(spark, sf_dir), "nation", {"agg": "avg", "column": "amount"})


@query(f"WITH {SALES}, b AS (SELECT nation FROM sales GROUP BY 1 ORDER BY round(sum(amount), 4) DESC, nation LIMIT 8) SELECT segment AS x, CASE WHEN nation IN (SELECT nation FROM b) THEN nation ELSE 'other' END AS series, round(sum(amount), 4) AS value FROM sales GROUP BY 1, 2")
def dash_split(spark, sf_dir):
    return dash.split(_sales(spark, sf_dir), "segment", "nation", TOTAL)


@query(f"WITH {SALES} SELECT date_trunc('week', o_orderdate)::TIMESTAMP AS x, count(*)::BIGINT AS value FROM sales GROUP BY 1 ORDER BY x DESC LIMIT 500")
def dash_time(spark, sf_dir):
    return dash.time(_sales(spark, sf_dir), "o_orderdate", {"agg": "count"}, "week")


@query(f"WITH {SALES} SELECT o_orderkey, amount FROM sales WHERE coalesce(region, '(empty)') IN ('ASIA', '(empty)') AND o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' ORDER BY amount DESC NULLS LAST, o_orderkey LIMIT 25")
def dash_filtered_table(spark, sf_dir):
    chosen = dash.apply_filters(_sales(spark, sf_dir), {"region": {"values": ["ASIA", "(empty)"]}, "o_orderdate": {"from": "1995-01-01", "to": "1996-12-31"}, "absent": {"values": ["x"]}}, {"region": "text", "o_orderdate": "date"})
    return dash.table(chosen, ["o_orderkey", "amount"], [("amount", "desc"), ("o_orderkey", "asc")], 25)


@query(f"WITH {SALES} SELECT DISTINCT coalesce(region, '(empty)') AS value FROM sales")
def dash_filter_options(spark, sf_dir):
    return dash.filter_options(_sales(spark, sf_dir), "region", "text")


@query(f"WITH {SALES} SELECT 'ASIA' AS region, round(sum(amount), 4) AS value FROM sales WHERE region = 'ASIA' AND o_orderdate::DATE = DATE '1995-03-15'")
def dash_day_condition(spark, sf_dir):
    m = {**TOTAL, "where": [["region", "eq", "ASIA"], ["o_orderdate", "eq", "1995-03-15", "date"]]}
    return _sales(spark, sf_dir).agg(F.lit("ASIA").alias("region"), F.when(F.count(F.when(dash.where("region", "eq", "ASIA") & dash.where("o_orderdate", "eq", "1995-03-15", "date"), 1)) > 0, dash.metric(m)).alias("value"))


@query(f"WITH {RUNS} SELECT run_id, quality_score, CASE WHEN quality_score >= 95 THEN 'pass' ELSE 'fail' END AS gate_result FROM runs")
def dash_quality_runs(spark, sf_dir):
    return dash.quality_dataset(run_history(spark, sf_dir)).select("run_id", "quality_score", "gate_result")


@query("""SELECT 'rows' AS widget, NULL::VARCHAR AS x, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'total_total_price', NULL, round(sum(o_totalprice), 4) FROM orders UNION ALL SELECT 'by_o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'by_o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'trend', strftime(date_trunc('month', o_orderdate), '%Y-%m-%d'), round(sum(o_totalprice), 4) FROM orders GROUP BY 2""")
def default_dashboard(spark, sf_dir):
    """Row count, totals, bars and the line by month of a table, all from one pass over it."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_totalprice", "total_price")
    spec = dash.default_spec([r.asDict() for r in advise.column_roles(o).collect()])
    out = None
    for name, w in dash.compute(o, spec, {}, {}).items():
        x = F.lit(None).cast("string") if "x" not in w.columns else F.date_format("x", "yyyy-MM-dd") if name == "trend" else F.col("x")
        one = w.select(F.lit(name).alias("widget"), x.alias("x"), F.col("value").cast("double").alias("value"))
        out = one if out is None else out.union(one)
    return out


# ---- K: evaluation ---------------------------------------------------------------

TRUTH = f"{TAGGED}, truth AS (SELECT row_id, CASE WHEN order_key IS NULL THEN 'missing_key' WHEN price IS NULL THEN 'missing_price' WHEN price < 0 THEN 'negative' WHEN row_id % 2 = 1 THEN 'duplicate' END AS error_type FROM dirty)"


def _truth(d: DataFrame) -> DataFrame:
    return d.select("row_id", F.when(F.col("order_key").isNull(), "missing_key").when(F.col("price").isNull(), "missing_price").when(F.col("price") < 0, "negative").when(F.col("row_id") % 2 == 1, "duplicate").alias("error_type"))


# Of the run's rows, those that repeat a key are gone: dropped, not quarantined.
FOUND = f"""{TRUTH}, made AS (SELECT row_id, order_key, error_type, CASE WHEN reject_reason = 'duplicate_records' THEN 'dropped' WHEN reject_reason IS NULL THEN 'clean' ELSE 'quarantined' END AS outcome, reject_reason FROM tagged JOIN truth USING (row_id)),
w AS (SELECT *, count(*) OVER k > 1 AND count(*) FILTER (outcome = 'clean') OVER k <= 1 AS collapsed FROM made WINDOW k AS (PARTITION BY order_key)),
found AS (SELECT *, CASE WHEN error_type = 'duplicate' THEN collapsed WHEN error_type IS NULL AND collapsed THEN false ELSE outcome <> 'clean' END AS detected FROM w)"""


def _found(spark, sf_dir):
    t = tagged_orders(spark, sf_dir)
    return evaluate.outcomes(t.select("row_id", "order_key"), t.filter("reject_reason is null or reject_reason <> 'duplicate_records'"), _truth(t), "row_id", ["order_key"])


@query(f"""WITH {FOUND}, c AS (SELECT count(*)::BIGINT AS rows, count(*) FILTER (outcome = 'dropped')::BIGINT AS dropped, count(*) FILTER (error_type IS NOT NULL AND detected)::BIGINT AS tp, count(*) FILTER (error_type IS NULL AND detected)::BIGINT AS fp, count(*) FILTER (error_type IS NOT NULL AND NOT detected)::BIGINT AS fn, count(*) FILTER (error_type IS NULL AND NOT detected)::BIGINT AS tn FROM found)
SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round((tp + tn) / rows, 6) AS accuracy FROM c""")
def detection_quality(spark, sf_dir):
    return evaluate.detection(_found(spark, sf_dir))


@query(f"WITH {FOUND} SELECT error_type, count(*)::BIGINT AS actual, count(*) FILTER (detected)::BIGINT AS found, round(avg(detected::INT), 4) AS rate FROM found WHERE error_type IS NOT NULL GROUP BY 1")
def detection_rates(spark, sf_dir):
    return evaluate.detection_by_type(_found(spark, sf_dir))


@query(f"WITH {FOUND} SELECT CASE WHEN outcome = 'dropped' THEN 'dropped' ELSE reject_reason END AS reason, count(*)::BIGINT AS n FROM found WHERE error_type IS NULL AND detected GROUP BY 1 ORDER BY n DESC, reason LIMIT 10")
def false_positive_reasons(spark, sf_dir):
    return evaluate.false_positives(_found(spark, sf_dir))


@query(f"""WITH {ZONED}, p AS (SELECT row_id, coalesce(error_type, 'none') AS said, CASE WHEN price IS NULL THEN 'null_check' WHEN price < 0 THEN 'range_check' ELSE 'none' END AS "is" FROM zoned), c AS (SELECT DISTINCT unnest([said, "is"]) AS category FROM p)
SELECT category, count(*) FILTER (said = category AND "is" = category)::BIGINT AS tp, count(*) FILTER (said = category AND "is" <> category)::BIGINT AS fp, count(*) FILTER (said <> category AND "is" = category)::BIGINT AS fn, count(*) FILTER (said <> category AND "is" <> category)::BIGINT AS tn FROM p, c GROUP BY 1""")
def detection_by_category(spark, sf_dir):
    z = zoned_orders(spark, sf_dir)
    truth = z.select("row_id", F.when(F.col("price").isNull(), "null_check").when(F.col("price") < 0, "range_check").alias("error_type"))
    return evaluate.by_category(z, truth, "row_id").select("category", "tp", "fp", "fn", "tn")


@query(f"WITH {RUNS} SELECT run_id, 'clean_records' AS field, clean_records::VARCHAR AS was, (clean_records + 1)::VARCHAR AS \"is\" FROM runs WHERE table_name = 'orders'")
def golden_differences(spark, sf_dir):
    runs = run_history(spark, sf_dir)
    changed = runs.withColumn("clean_records", F.when(F.col("table_name") == "orders", F.col("clean_records") + 1).otherwise(F.col("clean_records")))
    return evaluate.diff_runs(runs, changed, "run_id", ["total_records", "clean_records", "quality_score"])


@query("SELECT s_suppkey + k * 1000000 AS s_suppkey, s_name FROM supplier, range(3) t(k)")
def scaled_table(spark, sf_dir):
    return evaluate.scale(table(spark, sf_dir, "supplier"), 3, ["s_suppkey"], 1_000_000).select("s_suppkey", "s_name")


@query("SELECT *, CASE WHEN mean >= 155000 THEN 'high' WHEN mean >= 145000 THEN 'middle' ELSE 'below' END AS band FROM (SELECT o_orderpriority, count(o_totalprice)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max, round(stddev_samp(o_totalprice), 4) AS sd, round(100.0 * avg((o_totalprice >= 100000)::INT), 4) AS pass_pct FROM orders GROUP BY 1)")
def group_performance(spark, sf_dir):
    return evaluate.performance(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", 100000, [("high", 155000), ("middle", 145000)])


@query("SELECT floor(l_quantity / 10) * 10 AS low, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def value_histogram(spark, sf_dir):
    return evaluate.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 10)


# ---- A, H, L: files and streams ----------------------------------------------------


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name || ' \"quoted\"' || chr(10) || 'line' AS p_name, p_size::VARCHAR AS p_size FROM part")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "csv")
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(' "quoted"\nline')).alias("p_name"), "p_size")
    p.write.option("header", "true").option("escape", '"').csv(path)
    return read.read_raw_csv(spark, path)


@query("SELECT p_partkey, p_name, to_json({'brand': p_brand, 'size': p_size})::VARCHAR AS shape FROM part")
def json_records(spark, sf_dir):
    path = scratch(spark, "json")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("shape"))
    # One document for each brand, as an interface that pages its records gives them.
    p.groupBy("shape.brand").agg(F.struct(F.collect_list(F.struct("p_partkey", "p_name", "shape")).alias("records")).alias("result")).select("result").write.option("maxRecordsPerFile", 1).json(path)
    return read.read_json_records(spark, path)


@query("SELECT p_partkey, p_size FROM part")
def xml_round_trip(spark, sf_dir):
    path = scratch(spark, "xml")
    table(spark, sf_dir, "part").select("p_partkey", "p_size").write.format("xml").option("rowTag", "row").save(path)
    return read.read_any(spark, path, "xml").select("p_partkey", F.col("p_size").cast("int").alias("p_size"))


@query("SELECT 2 * count(*)::BIGINT AS files, count(*) FILTER (first_id % 2 = 1)::BIGINT AS fresh FROM (SELECT min(event_id) AS first_id FROM events GROUP BY event_type)")
def duplicate_files(spark, sf_dir):
    """A file for each kind of event lands twice; of kinds whose first id is odd the second one has other values."""
    path = scratch(spark, "landed")
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    odd = e.groupBy(F.col("event_type").alias("kind")).agg(F.coalesce(F.min("event_id") % 2 == 1, F.lit(False)).alias("odd"))
    # A row a kind. A join that shuffles by kind would stand in for the repartition, and Spark may plan it anew and cut kinds up.
    both = e.join(F.broadcast(odd), F.col("event_type").eqNullSafe(F.col("kind")))
    other = F.when(F.col("odd"), F.coalesce(F.col("value") + 1, F.lit(1.0))).otherwise(F.col("value"))
    land = lambda df, name: df.repartition("event_type").sortWithinPartitions("event_type", "event_id", "value").write.partitionBy("event_type").json(f"{path}/{name}")
    land(e, "a")
    land(both.select("event_type", "event_id", other.alias("value")), "b")
    digests = read.file_digests(spark, path).filter("path like '%.json'")
    seen = digests.filter("path like '%/a/%'").select("sha256", F.lit("SUCCEEDED").alias("status"))
    return digests.agg(F.count("*").alias("files")).crossJoin(read.new_files(digests, seen).agg(F.count("*").alias("fresh")))


@query(f"WITH {RUNS} SELECT count(DISTINCT table_name)::BIGINT AS tables, count(*)::BIGINT AS runs, sum(total_records)::BIGINT AS records, max(total_records)::BIGINT AS largest_run FROM runs")
def quality_summary(spark, sf_dir):
    return read.summarize_quality(run_history(spark, sf_dir))


@query("SELECT event_type AS source, count(*)::BIGINT AS ingestions, count(*) FILTER (event_id % 3 = 0)::BIGINT AS succeeded, sum(length(props))::BIGINT AS bytes FROM events GROUP BY 1")
def ingestion_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.when(F.col("event_id") % 3 == 0, "SUCCEEDED").otherwise("FAILED").alias("status"), F.length("props").alias("bytes"))
    return read.summarize_runs(e)


@query("SELECT c_custkey, c_acctbal FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 1.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT max(c_custkey) + 1, 2.0 FROM customer)")
def key_upsert(spark, sf_dir):
    path = scratch(spark, "upsert")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    versions.upsert(c, path, ["c_custkey"])
    versions.upsert(c.filter("c_custkey % 4 = 0").withColumn("c_acctbal", F.lit(1.0)).unionByName(c.agg((F.max("c_custkey") + 1).alias("c_custkey"), F.lit(2.0).alias("c_acctbal"))), path, ["c_custkey"])
    return versions.read(spark, path)


@query("SELECT event_id, CASE WHEN event_type <> 'click' THEN 'r1' ELSE 'r2' END AS run_id, CASE WHEN event_type <> 'click' THEN 'i2' ELSE 'i1' END AS ingest_id FROM events")
def quarantine_rewrite(spark, sf_dir):
    path = scratch(spark, "quarantine")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    sinks.write_quarantine(e.withColumn("run_id", F.lit("r1")), path, "i1")
    sinks.write_quarantine(e.filter("event_type <> 'click'").withColumn("run_id", F.lit("r1")), path, "i2")
    sinks.write_quarantine(e.filter("event_type = 'click'").withColumn("run_id", F.lit("r2")), path, "i1")
    return read.read_table(spark, path).select("event_id", "run_id", "ingest_id")


@query("SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 2 = 0 THEN '''=' || c_name ELSE c_name END AS name FROM customer")
def spreadsheet_export(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("="), "c_name")).otherwise(F.col("c_name")).alias("c_name"))
    return sinks.safe_csv(c, {"c_custkey": "id", "c_name": "name"})


@query("SELECT event_id FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) FROM events) - INTERVAL 30 DAY")
def retained_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.date_trunc("day", F.max("ts")).cast("string")).first()[0]
    return sinks.retain(e, "ts", 30, now).select("event_id")


@query("SELECT p_partkey, p_size FROM part")
def compacted_table(spark, sf_dir):
    path, p = scratch(spark, "compact"), table(spark, sf_dir, "part").select("p_partkey", "p_size")
    for part in range(2):
        versions.append(p.filter(F.col("p_partkey") % 2 == part), path)
    versions.cluster(spark, path, ["p_partkey", "p_size"], file_rows=500)
    return versions.read(spark, path)


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_partkey <= (SELECT max(p_partkey) // 2 FROM part)")
def clustered_box(spark, sf_dir):
    path, p = scratch(spark, "clustered"), table(spark, sf_dir, "part").select("p_partkey", "p_size")
    versions.append(p, path)
    versions.cluster(spark, path, ["p_partkey", "p_size"], file_rows=500)
    return versions.read(spark, path, {"p_size": (10, 20), "p_partkey": (None, p.agg(F.max("p_partkey")).first()[0] // 2)})


@query(f"WITH {TAGGED} SELECT row_id, order_key, price FROM tagged WHERE reject_reason IS NOT NULL")
def exported_rows(spark, sf_dir):
    t = tagged_orders(spark, sf_dir).filter("zone = 'quarantine'").withColumn("run_id", F.lit("r"))
    return sinks.prepare_export(sinks.run_rows(t, "r"), ["row_id"]).select("row_id", "order_key", "price")


def _posts(spark, sf_dir) -> str:
    path = scratch(spark, "posts")
    e = table(spark, sf_dir, "events")
    post = F.struct(F.col("event_type").alias("subreddit"), F.concat(F.lit("p"), (F.col("event_id") - F.col("event_id") % 2).cast("string")).alias("id"), F.concat(F.lit("<b>Post</b> &amp; "), F.col("event_id").cast("string")).alias("title"), F.unix_timestamp("ts").cast("double").alias("created_utc"), F.col("user_id").cast("string").alias("author"), F.lit(1).alias("score"))
    e.select(F.to_json(post).alias("value")).write.text(path)
    return path


@query("SELECT event_type AS subreddit, 'p' || (event_id - event_id % 2)::VARCHAR AS id, 'Post & ' || event_id::VARCHAR AS title, date_trunc('second', ts)::TIMESTAMP AS event_time FROM events")
def stream_append(spark, sf_dir):
    source, out, mark = _posts(spark, sf_dir), scratch(spark, "stream"), scratch(spark, "mark")
    q = stream.write_partitioned(stream.clean_post(stream.parse(stream.files(spark, source))), out, "subreddit", mark, once=True)
    q.awaitTermination()
    return read.read_table(spark, out).select("subreddit", "id", "title", "event_time")


@query("SELECT 'p' || event_id::VARCHAR AS id FROM events UNION ALL SELECT 'new' || event_id::VARCHAR FROM events WHERE event_type = 'click'")
def stream_dedup(spark, sf_dir):
    """Every post comes again ten minutes later, which the watermark's hour covers; a second load brings new posts, and late ones that it leaves out."""
    source, out, mark = scratch(spark, "posts"), scratch(spark, "stream"), scratch(spark, "mark")
    e = table(spark, sf_dir, "events").withColumn("seconds", F.unix_timestamp("ts").cast("double"))
    newest = e.agg(F.max("seconds").alias("newest"))

    def load(df: DataFrame, prefix: str, seconds) -> DataFrame:
        post = F.struct(F.col("event_type").alias("subreddit"), F.concat(F.lit(prefix), F.col("event_id").cast("string")).alias("id"), F.lit("t").alias("title"), seconds.alias("created_utc"), F.col("user_id").cast("string").alias("author"), F.lit(1).alias("score"))
        return df.select(F.to_json(post).alias("value"))

    def arrive(loads: DataFrame) -> None:
        loads.write.mode("append").text(source)
        posts = stream.dedup_posts(stream.parse(stream.files(spark, source)), "1 hour")
        sink = stream.batch_sink(out, "posts")
        stream.fan_out(posts, {"ids": lambda b, k: sink(b.select("id"), k)}, mark, once=True).awaitTermination()

    arrive(load(e, "p", F.col("seconds")).union(load(e, "p", F.col("seconds") + 600)))
    click = e.filter("event_type = 'click'").crossJoin(F.broadcast(newest))
    arrive(load(click, "new", F.col("newest") + 3600).union(load(click, "late", F.col("seconds") - 86400)))
    return spark.read.parquet(out).select("id")


# ---- A, B, C, F, G, K: specs, keys, guards, programs --------------------------------


@query("""WITH s AS (SELECT max(o_orderkey) <= 2147483647 AS whole, count(*) FILTER (o_orderkey % 1000 < 100000) > 0 AS zeros, max(o_totalprice) IS NOT NULL AS priced FROM orders)
SELECT 'o_orderkey' AS "column", CASE WHEN whole THEN 'IntegerType' ELSE 'DoubleType' END AS kind, false AS is_date FROM s UNION ALL SELECT 'code', CASE WHEN zeros THEN 'StringType' ELSE 'IntegerType' END, false FROM s UNION ALL SELECT 'price', CASE WHEN priced THEN 'DoubleType' END, false FROM s UNION ALL SELECT 'o_orderdate', 'TimestampType', true FROM s UNION ALL SELECT 'o_orderstatus', 'StringType', false FROM s""")
def inferred_spec(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = o.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 6, "0").alias("code"), F.format_string("%.2f", "o_totalprice").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderstatus")
    spec, date = infer.infer_spec(raw)
    return spark.createDataFrame([(c, t, c == date) for c, t in spec.items()], "column string, kind string, is_date boolean")


@query("""WITH l AS (SELECT count(DISTINCT l_orderkey) >= 0.9 * count(*) AS one, count(DISTINCT (l_orderkey, l_linenumber::VARCHAR)) >= 0.9 * count(*) AS two FROM lineitem), o AS (SELECT count(DISTINCT o_orderkey) >= 0.9 * count(*) AS one FROM orders)
SELECT CASE WHEN l.one THEN 'line_id' WHEN l.two THEN 'line_id,line' ELSE '' END AS lineitem_key, CASE WHEN o.one THEN 'orders_id' ELSE '' END AS orders_key, '' AS customer_key FROM l, o""")
def inferred_keys(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line_id"), "l_quantity", F.col("l_linenumber").cast("string").alias("line"))
    o = table(spark, sf_dir, "orders").select("o_totalprice", F.col("o_custkey").alias("cust_id"), F.col("o_orderkey").alias("orders_id"))
    c = table(spark, sf_dir, "customer").select("c_name", "c_mktsegment")
    keys = [",".join(infer.infer_primary_key(d, name)) for d, name in ((l, "lineitem"), (o, "orders"), (c, "customer"))]
    return spark.createDataFrame([tuple(keys)], "lineitem_key string, orders_key string, customer_key string")


@query("SELECT 'missing_key' AS finding, 'doc_key' AS \"column\", 'fail' AS action UNION ALL SELECT 'long_text', 'text', 'warn' FROM (SELECT avg(length(text)) AS n FROM documents) WHERE n > 150")
def input_guards(spark, sf_dir):
    return infer.input_guards(table(spark, sf_dir, "documents"), ["doc_id", "doc_key"])


@query("SELECT 'whole' AS \"column\", 'IntegerType' AS kind UNION ALL SELECT 'price', 'DoubleType'")
def promoted_types(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".00")).alias("whole"), F.format_string("%.2f", "o_totalprice").alias("price"))
    spec = align.promote_integers(o, {"whole": "IntegerType", "price": "IntegerType"})
    return spark.createDataFrame(list(spec.items()), "column string, kind string")


@query(f"WITH {DIRTY} SELECT row_id, round(coalesce(price, 0.0), 2) AS price FROM dirty")
def auto_strategy(spark, sf_dir):
    d = dirty_orders(spark, sf_dir).withColumn("price", F.format_string("%.2f", "price")).withColumn("price", F.when(F.col("price") != "null", F.col("price")))
    return repair.auto_strategy(d, "price")[0].select("row_id", "price")


@query(f"WITH {TAGGED} SELECT 'run-1' AS run_id, 'orders' AS table_name, count(*)::BIGINT AS total_records, count(*) FILTER (reject_reason IS NULL)::BIGINT AS clean_records, count(reject_reason)::BIGINT AS quarantined_records, round(100.0 * count(*) FILTER (reject_reason IS NULL) / count(*), 4) AS quality_score FROM tagged")
def run_document(spark, sf_dir):
    return metrics.run_row(tagged_orders(spark, sf_dir), "orders", "run-1").drop("quarantine_breakdown")


@query(f"WITH {RUNS} SELECT run_id, table_name, 'raw/' || table_name AS source, 'active/' || table_name AS target, 'quarantine/' || table_name || '/run_id=' || run_id AS quarantine FROM runs")
def lineage_paths(spark, sf_dir):
    return metrics.lineage_rows(run_history(spark, sf_dir), "raw", "active", "quarantine").select("run_id", "table_name", "paths.*")


@query(f"WITH {TAGGED} SELECT row_id, reject_reason, 'run-1' AS run_id, CASE WHEN reject_reason = 'duplicate_records' THEN 'duplicates' WHEN contains(reject_reason, '=') THEN 'outliers' ELSE 'invalid' END AS part FROM tagged WHERE reject_reason IS NOT NULL")
def assembled_quarantine(spark, sf_dir):
    t = tagged_orders(spark, sf_dir).filter("zone = 'quarantine'")
    kind = F.when(F.col("reject_reason") == "duplicate_records", "duplicates").when(F.col("reject_reason").contains("="), "outliers").otherwise("invalid")
    parts = [t.filter(kind == k).select("row_id", "reject_reason", *extra) for k, extra in (("invalid", ["status"]), ("duplicates", ["order_key"]), ("outliers", ["price"]))]
    return zones.assemble_quarantine([p.withColumn("part", F.lit(k)) for p, k in zip(parts, ("invalid", "duplicates", "outliers"), strict=True)], "run-1", "2030-01-01").select("row_id", "reject_reason", "run_id", "part")


@query(f"WITH {DIRTY} SELECT row_id, price, priority AS priority_semantic FROM dirty")
def selected_columns(spark, sf_dir):
    d = dirty_orders(spark, sf_dir).withColumn("priority_semantic", F.col("priority"))
    return align.select_schema(d, {"row_id": "IntegerType", "price": "DoubleType", "not_there": "StringType"}, ("priority_semantic",))


@query(f"WITH {DIRTY}, m AS (SELECT * FROM (VALUES ('1-urgent', 'urgent'), ('2-high', 'high'), ('3-medium', 'medium'), ('4-not specified', 'none'), ('5-low', 'low')) t(key, value)) SELECT row_id, value AS target FROM dirty LEFT JOIN m ON lower(trim(priority)) = key")
def mapped_priorities(spark, sf_dir):
    mapping = spark.createDataFrame([(k.lower(), v) for k, v in PRIORITIES.items()], "key string, value string")
    return semantic.map_lookup(dirty_orders(spark, sf_dir), mapping, "priority", "target").select("row_id", "target")


@query("SELECT o_orderkey::DOUBLE AS o_orderkey, o_orderdate, o_orderstatus FROM orders")
def prepared_frame(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_orderstatus", F.lit("r").alias("run_id"))
    return profile.prepare(o, {"o_orderkey": "numeric", "o_orderdate": "date"})


@query(f"WITH old AS (SELECT o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0), new AS (SELECT o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 1), {PSI} SELECT 'o_totalprice' AS \"column\", psi, CASE WHEN psi > 0.25 THEN 'CRITICAL' WHEN psi > 0.1 THEN 'MODERATE' ELSE 'STABLE' END AS status, (SELECT count(*) FILTER (v IS NULL) / count(*) FROM new)::DOUBLE AS null_rate, 'STABLE' AS null_status FROM psi")
def profile_cycle(spark, sf_dir):
    path, o = scratch(spark, "profiles"), table(spark, sf_dir, "orders")
    profile_store.cycle(o.filter("o_orderkey % 2 = 0"), path, "orders", ["o_totalprice"])
    return profile_store.cycle(o.filter("o_orderkey % 2 = 1"), path, "orders", ["o_totalprice"])


@query("SELECT 'o_totalprice' AS \"column\", count(*)::BIGINT AS rows, (count(*) - count(o_totalprice))::BIGINT AS nulls, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, round(kurtosis_pop(o_totalprice), 4) AS kurtosis, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders")
def profile_batches(spark, sf_dir):
    """The profile of orders taken in by year, each batch read once."""
    path, o = scratch(spark, "states"), table(spark, sf_dir, "orders")
    for first, last in ((0, 1994), (1995, 1996), (1997, 9999)):
        profile_state.cycle(o.filter(F.year("o_orderdate").between(first, last)), path, ["o_totalprice"])
    states = versions.read(spark, path)
    shown = profile_state.described(states).join(states.select("column", "rows", "nulls"), "column")
    return shown.select("column", "rows", "nulls", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "kurtosis")], "min", "max")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice < 20000")
def follow_up_ids(spark, sf_dir):
    return evaluate.follow_up(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", 20000)


@query("SELECT s_suppkey, 'e1' AS execution, 'trim,cast' AS rules FROM supplier")
def contract_metadata(spark, sf_dir):
    s = repair.with_meta(table(spark, sf_dir, "supplier"), "e1", ["trim", "cast"], ["not_null"])
    return repair.with_meta(s, "e1", ["other"], []).select("s_suppkey", F.col("_meta.execution_id").alias("execution"), F.array_join("_meta.rules", ",").alias("rules"))
