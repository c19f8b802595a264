"""Queries over the operators of alignment, validation, repair, zones, profiles and drift, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import align
from ..operators import advise, dedup, drift, metrics, outliers, profile, repair, validate, zones
from .fixtures import DIRTY, dirty_orders, table
from .quality_run import TableSpec, tag

ORDERS = TableSpec("orders", ["order_key"], "order_date", ["price"], {"price": (0.0, 10_000_000.0)}, ["price"], 3.0, tie=["row_id"])
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# The stages of the quality run as SQL, each over the rows still clean.
TAGGED = f"""{DIRTY},
s1 AS (SELECT *, CASE WHEN order_key IS NULL THEN 'missing_primary_key' WHEN price IS NULL THEN 'null_value_in_price' END AS r1, CASE WHEN order_date IS NULL THEN 'missing_date' END AS r2 FROM dirty),
s2 AS (SELECT *, concat_ws('; ', r1, r2) AS r12, row_number() OVER (PARTITION BY order_key, (r1 IS NULL AND r2 IS NULL) ORDER BY order_date DESC NULLS LAST, row_id) AS nth FROM s1),
s3 AS (SELECT *, CASE WHEN r12 <> '' THEN r12 WHEN nth > 1 THEN 'duplicate_records' WHEN price < 0 OR price > 10000000 THEN 'out_of_range_price' ELSE '' END AS r3 FROM s2),
f AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM s3 WHERE r3 = ''),
g AS (SELECT q1 - 3.0 * (q3 - q1) AS lo, q3 + 3.0 * (q3 - q1) AS hi FROM f),
tagged AS (SELECT s3.* EXCLUDE (r1, r2, r12, nth, r3), CASE WHEN r3 <> '' THEN r3 WHEN price < lo OR price > hi THEN printf('price=%.2f (expected [%.2f, %.2f])', price, lo, hi) END AS reject_reason FROM s3, g)"""


def tagged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag(dirty_orders(spark, sf_dir), ORDERS)


BREAKDOWN = """parts AS (SELECT trim(unnest(regexp_split_to_array(reject_reason, '[;|]'))) AS p FROM tagged WHERE reject_reason IS NOT NULL),
named AS (SELECT replace(CASE WHEN contains(p, '=') THEN CASE WHEN split_part(p, '=', 1) LIKE '%\\_zscore' ESCAPE '\\' THEN 'zscore_' || regexp_replace(trim(split_part(p, '=', 1)), '_zscore$', '') ELSE 'outlier_' || trim(split_part(p, '=', 1)) END ELSE p END, '.', '_') AS reason FROM parts WHERE p <> '')"""


@query(f"WITH {TAGGED}, {BREAKDOWN} SELECT reason, count(*)::BIGINT AS n FROM named GROUP BY reason")
def quality_run_reasons(spark, sf_dir):
    return metrics.reason_breakdown(tagged_orders(spark, sf_dir).filter("zone = 'quarantine'"))


@query(f"WITH {TAGGED} SELECT row_id, order_key, round(price, 2) AS price, coalesce(reject_reason, '') AS reject_reason, CASE WHEN reject_reason IS NULL THEN 'clean' ELSE 'quarantine' END AS zone FROM tagged")
def quality_run_rows(spark, sf_dir):
    return tagged_orders(spark, sf_dir).select("row_id", "order_key", F.round("price", 2).alias("price"), F.coalesce("reject_reason", F.lit("")).alias("reject_reason"), "zone")


TYPED = TableSpec("events", ["event_id"], required=["amount"], types={"amount": "DoubleType"}, tie=["event_id"])


@query("""WITH d AS (SELECT event_id, CASE WHEN event_id % 13 = 4 THEN 'n/a' WHEN event_id % 17 = 5 THEN '' WHEN event_id % 19 = 6 THEN NULL ELSE printf('%.2f', value) END AS raw FROM events)
SELECT event_id, CASE WHEN raw = 'n/a' THEN 'invalid_type_amount' WHEN raw IS NULL OR raw = '' THEN 'null_value_in_amount' ELSE '' END AS reject_reason, CASE WHEN raw IS NULL OR raw IN ('n/a', '') THEN 'quarantine' ELSE 'clean' END AS zone FROM d""")
def typed_run_rows(spark, sf_dir):
    k = F.col("event_id")
    raw = F.when(k % 13 == 4, "n/a").when(k % 17 == 5, "").when(k % 19 == 6, F.lit(None)).otherwise(F.format_string("%.2f", "value"))
    d = table(spark, sf_dir, "events").select("event_id", raw.alias("raw_amount")).withColumn("amount", F.col("raw_amount").try_cast("double"))
    return tag(d, TYPED).select("event_id", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"), "zone")


@query(f"WITH {TAGGED} SELECT count(*)::BIGINT AS total, count(*) FILTER (reject_reason IS NULL)::BIGINT AS clean, round(100.0 * count(*) FILTER (reject_reason IS NULL) / count(*), 4) AS score, 100.0 * count(*) FILTER (reject_reason IS NULL) / count(*) >= 80 AS passed FROM tagged")
def quality_score(spark, sf_dir):
    return metrics.quality_score(tagged_orders(spark, sf_dir))


@query(f"WITH {TAGGED} SELECT round(coalesce(sum(price), 0.0), 2) AS financial_value FROM tagged WHERE reject_reason IS NOT NULL")
def quarantined_value(spark, sf_dir):
    return metrics.financial_value(tagged_orders(spark, sf_dir).filter("zone = 'quarantine'").select("price"))


@query(f"WITH {TAGGED}, w AS (SELECT CASE WHEN coalesce(reject_reason, '') = '' THEN 0.0 ELSE greatest(0.2, CASE WHEN contains(reject_reason, 'primary') OR contains(reject_reason, 'duplicate') THEN 0.9 ELSE 0 END, CASE WHEN contains(reject_reason, 'date') THEN 0.5 ELSE 0 END, CASE WHEN contains(reject_reason, 'price') THEN 0.4 ELSE 0 END) END::DOUBLE AS w FROM tagged) SELECT round(100 * sum(w) / count(*), 4) AS operational_impact FROM w")
def operational_impact(spark, sf_dir):
    return metrics.operational_impact(tagged_orders(spark, sf_dir), {"order_key": 0.9, "price": 0.4}, ORDERS.pk, ORDERS.date)


@query(f"WITH {DIRTY} SELECT max(order_date) AS newest, round(greatest(date_diff('second', max(order_date), TIMESTAMP '2030-01-01') / 3600.0, 0.0), 2) AS lag_hours FROM dirty")
def freshness(spark, sf_dir):
    return metrics.freshness(dirty_orders(spark, sf_dir), "order_date", "2030-01-01")


@query(f"WITH {TAGGED} SELECT CASE WHEN contains(reject_reason, 'duplicate_records') THEN 'unfixable' WHEN contains(reject_reason, 'invalid_type_') THEN 'type_mismatch' WHEN contains(reject_reason, 'null_value_in_') OR contains(reject_reason, 'missing_primary_key') THEN 'null_values' WHEN contains(reject_reason, 'missing_date') THEN 'format_errors' WHEN regexp_matches(reject_reason, 'outlier|anomaly|unsupervised') THEN 'outliers' ELSE 'unfixable' END AS class, count(*)::BIGINT AS n FROM tagged WHERE reject_reason IS NOT NULL GROUP BY 1")
def reject_classes(spark, sf_dir):
    return repair.categorize_rejects(tagged_orders(spark, sf_dir).filter("zone = 'quarantine'"))


# ---- B: alignment -----------------------------------------------------------


@query("SELECT md5(concat_ws('||', coalesce(c_acctbal::VARCHAR, ''), coalesce(c_custkey::VARCHAR, ''), coalesce(c_mktsegment, ''), coalesce(c_name, ''), coalesce(c_nationkey::VARCHAR, ''))) AS row_hash, c_custkey FROM (SELECT c_custkey, c_name, c_nationkey, c_mktsegment, (c_acctbal * 100)::BIGINT AS c_acctbal FROM customer)")
def row_hash(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("c_acctbal", F.round(F.col("c_acctbal") * 100).cast("long"))
    return align.row_hash(c).select("row_hash", "c_custkey")


@query("SELECT c_custkey AS \"cust_key\", c_name AS \"CustName\" FROM customer")
def clean_and_rename(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(" Cust  Key;"), F.col("c_name").alias("custname"))
    return align.rename_to_spec(align.clean_names(c), ["cust_key", "CustName"])


@query("SELECT o_orderkey, floor(o_totalprice)::BIGINT::INT AS whole, round(o_totalprice, 2) AS number, o_orderdate AS stamp FROM orders")
def parse_texts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    price = F.format_string("%.2f", "o_totalprice")
    forms = [F.date_format("o_orderdate", f) for f in ("dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd HH:mm:ss.SSS")] + [F.unix_timestamp("o_orderdate").cast("string")]
    stamp = F.element_at(F.array(*forms), (F.col("o_orderkey") % len(forms) + 1).cast("int"))
    return o.select("o_orderkey", align.parse_int(F.concat(F.lit("USD "), F.floor("o_totalprice").cast("string"))).alias("whole"), align.parse_double(F.concat(F.lit("$ "), price)).alias("number"), align.parse_timestamp(stamp).alias("stamp"))


@query("SELECT 'c_acctbal' AS column, 'type_mismatch' AS error, 'IntegerType' AS expected, 'DoubleType' AS actual, 'cast_to_string' AS action UNION ALL SELECT 'c_phone', 'missing_column', 'StringType', NULL, 'filled_with_null' UNION ALL SELECT 'c_nationkey', 'new_column', NULL, 'IntegerType', 'recorded' UNION ALL SELECT 'c_mktsegment', 'new_column', NULL, 'StringType', 'recorded'")
def schema_drift_rows(spark, sf_dir):
    return drift.apply_schema_drift(table(spark, sf_dir, "customer"), {"c_custkey": "DoubleType", "c_name": "StringType", "c_acctbal": "IntegerType", "c_phone": "StringType"})[1]


# Drifts of one run: columns of customers that came, went or changed, a set for each nation.
DRIFTED = """drifted AS (SELECT c_nationkey AS nation, e AS error FROM customer, unnest(CASE c_nationkey % 3 WHEN 0 THEN ['new_column'] WHEN 1 THEN ['new_column', 'missing_column'] ELSE ['type_mismatch'] END) t(e))"""


@query(f"WITH {DRIFTED}, s AS (SELECT nation, sum(CASE error WHEN 'new_column' THEN 1 ELSE 5 END)::BIGINT AS severity, count(*) FILTER (error = 'new_column')::BIGINT AS n_new, count(*) FILTER (error <> 'new_column') = 0 AS safe FROM drifted GROUP BY 1) SELECT nation, severity, n_new, CASE WHEN safe THEN 'APPROVED' ELSE 'PENDING' END AS status, CASE WHEN NOT safe THEN 'missing columns or changed types' END AS reason FROM s")
def schema_proposal(spark, sf_dir):
    k = F.col("c_nationkey") % 3
    errors = F.when(k == 0, F.array(F.lit("new_column"))).when(k == 1, F.array(F.lit("new_column"), F.lit("missing_column"))).otherwise(F.array(F.lit("type_mismatch")))
    drifted = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.explode(errors).alias("error"))
    return drift.evaluate_proposal(drifted, 8, require_approval=False, by=("nation",))


# ---- C: repairs -------------------------------------------------------------


@query(f"WITH {DIRTY} SELECT row_id, coalesce(price, 0.0) AS price, CASE WHEN price > 0 THEN round(price * 0.9, 4) END AS net, date_text FROM dirty WHERE status <> 'F'")
def repair_program(spark, sf_dir):
    rules = [
        {"kind": "calculate", "column": "net", "expression": "price * 0.9", "condition": "price > 0"},
        {"kind": "fillna", "column": "price", "value": 0.0},
        {"kind": "filter", "condition": "status <> 'F'"},
    ]
    return repair.apply_rules(dirty_orders(spark, sf_dir), rules).select("row_id", "price", F.round("net", 4).alias("net"), "date_text")


PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "none", "5-LOW": "low"}


@query(f"""WITH {DIRTY}, m AS (SELECT * FROM (VALUES (1, '1-urgent', 'urgent'), (2, '2-high', 'high'), (3, '3-medium', 'medium'), (4, '4-not specified', 'none'), (5, '5-low', 'low')) t(nth, k, v))
SELECT row_id, coalesce((SELECT v FROM m WHERE k = lower(trim(priority))), (SELECT min_by(v, nth) FROM m WHERE contains(lower(trim(priority)), k) OR (contains(k, lower(trim(priority))) AND length(lower(trim(priority))) >= 3)), priority) AS priority FROM dirty""")
def standardize_values(spark, sf_dir):
    return repair.standardize(dirty_orders(spark, sf_dir), "priority", PRIORITIES).select("row_id", "priority")


@query(f"WITH {DIRTY} SELECT row_id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM (SELECT d.row_id, o.o_orderdate FROM dirty d JOIN orders o ON d.row_id // 2 = o.o_orderkey)")
def standardize_dates(spark, sf_dir):
    d = dirty_orders(spark, sf_dir)
    day = F.when(F.col("row_id") % 4 == 0, F.concat_ws("-", F.substring("date_text", 9, 2), F.substring("date_text", 6, 2), (F.substring("date_text", 1, 4).try_cast("int") + 543).cast("string")))
    year_first = F.when(F.col("row_id") % 4 == 2, F.replace("date_text", F.lit("-"), F.lit("/")))
    text = F.when(F.col("date_text").contains("/"), F.col("date_text")).otherwise(F.coalesce(day, year_first, F.col("date_text")))
    return d.select("row_id", repair.standardize_date(text).alias("day"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'copper') THEN 'metal' WHEN contains(lower(p_type), 'small') THEN 'small' ELSE 'other' END AS category FROM part")
def keyword_categories(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", repair.keyword_category(F.col("p_type"), {"metal": ["STEEL", "COPPER"], "small": ["small"]}, "other").alias("category"))


@query("SELECT '<redacted>' AS c_custkey, CASE WHEN c_name IS NOT NULL THEN '<redacted>' END AS c_name, '<redacted>' AS contact_tel, c_nationkey AS hotel, c_mktsegment FROM customer")
def redact_personal(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_custkey").cast("string").alias("contact_tel"), F.col("c_nationkey").alias("hotel"), "c_mktsegment")
    return repair.redact(c, "c_custkey")


# ---- D: validation and zones -------------------------------------------------


@query("SELECT * FROM (SELECT 0 AS nth, 'o_totalprice' AS column, 'between' AS kind, 'critical' AS severity, count(*)::BIGINT AS tested, count(*) FILTER (NOT (o_totalprice BETWEEN 0 AND 200000))::BIGINT AS failed FROM orders UNION ALL SELECT 1, 'o_orderpriority', 'matches', 'warning', count(*), count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-4]-')) FROM orders UNION ALL SELECT 2, 'o_orderstatus', 'in_set', 'critical', count(*), count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders)")
def expectations(spark, sf_dir):
    tests = [{"column": "o_totalprice", "kind": "between", "min": 0, "max": 200000}, {"column": "o_orderpriority", "kind": "matches", "pattern": "^[1-4]-", "severity": "warning"}, {"column": "o_orderstatus", "kind": "in_set", "values": ["F", "O"]}]
    return validate.expect(table(spark, sf_dir, "orders"), tests)


@query(f"WITH {DIRTY} SELECT row_id, CASE WHEN coalesce(price > 400000, false) OR coalesce(status = 'P' AND price < 1000, false) THEN 'induced_tree_rule_match' END AS reason FROM dirty")
def induced_rules(spark, sf_dir):
    return dirty_orders(spark, sf_dir).select("row_id", validate.induced_rules(["price > 400000", "status = 'P' AND price < 1000"]).alias("reason"))


ZONE_RULES = [
    {"kind": "range_check", "column": "price", "min": 0.0, "label": "price >= 0", "action": "Quarantine"},
    {"kind": "composite_unique", "columns": ["order_key"], "keep": "first", "label": "order_key unique", "action": "Quarantine"},
    {"kind": "null_check", "column": "price", "label": "price present", "action": "Review"},
    {"kind": "auto_iqr", "column": "price", "low": 0.0, "high": 1_000_000.0, "label": "price fence", "action": "Review"},
    {"kind": "category_consistency", "column": "status", "allowed": ["F", "O"], "label": "status known", "action": "Review"},
]
ZONED = f"""{DIRTY}, z AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY order_key ORDER BY row_id) > 1 THEN 'order_key unique' WHEN price IS NULL THEN 'price present' WHEN price < 0 THEN 'price >= 0' WHEN price > 1000000 THEN 'price fence' WHEN status NOT IN ('F', 'O') THEN 'status known' END AS rule FROM dirty),
zoned AS (SELECT *, CASE WHEN rule IN ('order_key unique', 'price >= 0') THEN 'Quarantine' WHEN rule IS NULL THEN 'Valid' ELSE 'Review' END AS zone, CASE rule WHEN 'order_key unique' THEN 'composite_unique' WHEN 'price present' THEN 'null_check' WHEN 'price >= 0' THEN 'range_check' WHEN 'price fence' THEN 'auto_iqr' WHEN 'status known' THEN 'category_consistency' END AS error_type FROM z)"""


def zoned_orders(spark, sf_dir):
    return zones.segregate(dirty_orders(spark, sf_dir), ZONE_RULES, ["row_id"])


@query(f"WITH {ZONED} SELECT row_id, zone, error_type, rule FROM zoned")
def three_zones(spark, sf_dir):
    return zoned_orders(spark, sf_dir).select("row_id", "zone", "error_type", "rule")


@query(f"WITH {ZONED} SELECT zone, count(*)::BIGINT AS n FROM (SELECT CASE WHEN zone <> 'Review' THEN zone WHEN row_id % 10 = 0 THEN 'Quarantine' ELSE 'Valid' END AS zone FROM zoned) GROUP BY zone")
def reviewed_zones(spark, sf_dir):
    z = zoned_orders(spark, sf_dir)
    return zones.apply_decisions(z, "row_id", "approve", z.filter("row_id % 10 = 0").select("row_id", F.lit("reject").alias("decision"))).groupBy("zone").agg(F.count("*").alias("n"))


@query(f"WITH {ZONED} SELECT count(*)::BIGINT AS total, count(*) FILTER (zone = 'Valid')::BIGINT AS valid, count(*) FILTER (zone = 'Review')::BIGINT AS review, count(*) FILTER (zone = 'Quarantine')::BIGINT AS quarantine, 0::BIGINT AS unaccounted FROM zoned")
def zone_reconciliation(spark, sf_dir):
    return zones.reconcile(zoned_orders(spark, sf_dir))


@query(f"WITH {ZONED} SELECT r.rule, r.kind, count(zoned.row_id)::BIGINT AS n FROM (VALUES ('price >= 0', 'range_check'), ('order_key unique', 'composite_unique'), ('price present', 'null_check'), ('price fence', 'auto_iqr'), ('status known', 'category_consistency')) r(rule, kind) LEFT JOIN zoned ON zoned.rule = r.rule GROUP BY 1, 2")
def zone_rule_impact(spark, sf_dir):
    return zones.rule_impact(zoned_orders(spark, sf_dir), ZONE_RULES)


@query(f"WITH {ZONED}, f AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM zoned) SELECT s AS stage, 'price' AS column, count(*) FILTER (price IS NULL)::BIGINT AS nulls, round(avg(price), 4) AS mean, count(*) FILTER (price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1))::BIGINT AS outliers FROM (SELECT 'before' AS s, price FROM zoned UNION ALL SELECT 'after', price FROM zoned WHERE zone = 'Valid'), f GROUP BY s")
def zone_column_impact(spark, sf_dir):
    z = zoned_orders(spark, sf_dir)
    return zones.column_impact(z, z.filter("zone = 'Valid'"), ["price"])


@query(f"WITH {ZONED} SELECT count(*)::BIGINT AS total, count(*) FILTER (error_type <> 'composite_unique')::BIGINT AS gate1, count(*) FILTER (error_type = 'composite_unique')::BIGINT AS gate2, count(*) FILTER (error_type = 'null_check')::BIGINT AS missing, count(*) FILTER (error_type = 'range_check')::BIGINT AS out_of_range, count(*) FILTER (error_type = 'auto_iqr')::BIGINT AS outliers, round(100.0 * count(*) FILTER (zone = 'Valid') / count(*), 4) AS score FROM zoned")
def zone_gates(spark, sf_dir):
    return zones.gate_metrics(zoned_orders(spark, sf_dir))


# ---- E: duplicates ------------------------------------------------------------


@query(f"WITH {DIRTY}, n AS (SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY order_date DESC NULLS LAST, row_id) AS nth FROM dirty) SELECT row_id, order_key, order_date FROM n WHERE nth = 1 OR order_key IS NULL")
def keep_latest(spark, sf_dir):
    return dedup.keep_latest(dirty_orders(spark, sf_dir), ["order_key"], "order_date", ["row_id"])[0].select("row_id", "order_key", "order_date")


@query(f"WITH {DIRTY} SELECT row_id, row_number() OVER (PARTITION BY order_key ORDER BY order_date DESC NULLS LAST, row_id) > 1 AS is_duplicate FROM dirty")
def split_duplicates(spark, sf_dir):
    return dedup.split_duplicates(dirty_orders(spark, sf_dir), ["order_key"], "order_date", ["row_id"]).select("row_id", "is_duplicate")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(spark, sf_dir):
    return dedup.anti(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


# ---- F: profiles, outliers, drift ----------------------------------------------


@query(f"WITH {DIRTY} SELECT unnest(['row_id', 'order_key', 'price', 'order_date']) AS column, round(unnest([0.0, count(*) FILTER (order_key IS NULL) / count(*), count(*) FILTER (price IS NULL) / count(*), count(*) FILTER (order_date IS NULL) / count(*)]), 6)::DOUBLE AS null_rate, unnest([0.05, 0.0, 0.05, 0.05])::DOUBLE AS tolerance, unnest([false, true, false, false]) AS required FROM dirty")
def null_profile(spark, sf_dir):
    return profile.null_profile(dirty_orders(spark, sf_dir).select("row_id", "order_key", "price", "order_date"), ["order_key"])


@query(f"WITH {DIRTY}, r AS (SELECT count(*) FILTER (price IS NULL) / count(*) AS p FROM dirty), e AS (SELECT round(p, 6) AS null_rate, round(0.3 * round(p, 6) + 0.7 * 0.5, 6) AS ema FROM r) SELECT 'price' AS column, null_rate, ema, round(least(greatest(1.5 * ema, 0.01), 0.5), 6) AS tolerance, ema < 0.02 AS required FROM e")
def adaptive_nulls(spark, sf_dir):
    history = spark.range(1).select(F.lit("price").alias("column"), F.lit(0.5).alias("ema_null_rate"))
    return profile.adaptive_nulls(dirty_orders(spark, sf_dir).select("price"), history)


@query("SELECT c AS column, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, round(q1 - 1.5 * (q3 - q1), 6) AS low, round(q3 + 1.5 * (q3 - q1), 6) AS high FROM (SELECT 'l_quantity' AS c, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem UNION ALL SELECT 'l_extendedprice', quantile_cont(l_extendedprice, 0.25), quantile_cont(l_extendedprice, 0.75) FROM lineitem)")
def iqr_bounds(spark, sf_dir):
    b = outliers.iqr_bounds(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])
    return b.select("column", *[F.round(c, 6).alias(c) for c in ("q1", "q3", "iqr", "low", "high")])


@query(f"WITH {DIRTY}, f AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM dirty) SELECT row_id, printf('price=%.2f (expected [%.2f, %.2f])', price, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) AS detail FROM dirty, f WHERE price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)")
def iqr_outliers(spark, sf_dir):
    d = dirty_orders(spark, sf_dir)
    return outliers.flag_iqr(d, outliers.iqr_bounds(d, ["price"]), ["price"]).filter(F.size("outliers") > 0).select("row_id", F.array_join("outliers", "; ").alias("detail"))


@query(f"WITH {DIRTY}, m AS (SELECT avg(price) AS m, stddev_samp(price) AS s FROM dirty) SELECT row_id FROM dirty, m WHERE abs(price - m) > 3 * s")
def zscore_outliers(spark, sf_dir):
    return outliers.flag_zscore(dirty_orders(spark, sf_dir), ["price"]).filter(F.size("zscore_outliers") > 0).select("row_id")


@query("SELECT 'o_totalprice' AS column, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS min, max(o_totalprice) AS max, round(quantile_cont(o_totalprice, 0.05), 4) AS p5, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(kurtosis_pop(o_totalprice), 4) AS kurtosis, count(DISTINCT o_totalprice)::BIGINT AS n_distinct FROM orders")
def distribution_profile(spark, sf_dir):
    p = profile.distribution(table(spark, sf_dir, "orders"), ["o_totalprice"])
    return p.select("column", *[F.round(c, 4).alias(c) for c in ("mean", "sd")], "min", "max", *[F.round(c, 4).alias(c) for c in ("p5", "p50", "p95", "kurtosis")], "n_distinct")


@query("SELECT '<row>' AS key, (count(*) - count(DISTINCT (o_custkey, o_orderstatus, o_orderpriority)))::BIGINT AS duplicates FROM orders UNION ALL SELECT 'o_custkey', (count(*) - count(DISTINCT o_custkey))::BIGINT FROM orders UNION ALL SELECT 'o_orderpriority', (count(*) - count(DISTINCT o_orderpriority))::BIGINT FROM orders")
def duplicate_profile(spark, sf_dir):
    return profile.duplicates(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"), ["o_custkey", "o_orderpriority"])


@query(f"WITH {DIRTY} SELECT 'price' AS column, min(price) AS min, max(price) AS max, 'negative_money' AS issue FROM dirty HAVING min(price) < 0 UNION ALL SELECT 'row_age', min(row_id), max(row_id), 'impossible_age' FROM dirty HAVING max(row_id) > 120 UNION ALL SELECT 'cust_rate', min(cust_key), max(cust_key), 'percentage_outside' FROM dirty HAVING min(cust_key) < 0 OR max(cust_key) > 100")
def range_anomalies(spark, sf_dir):
    return profile.range_anomalies(dirty_orders(spark, sf_dir).select("price", F.col("row_id").alias("row_age"), F.col("cust_key").alias("cust_rate"), "order_key"))


@query("""SELECT "column", value, n, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS nth FROM (SELECT 'p_brand' AS "column", p_brand AS value, count(*)::BIGINT AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2) QUALIFY nth <= 10""")
def top_categories(spark, sf_dir):
    return profile.top_categories(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


def _column_profile(spark, sf_dir):
    return profile.columns(table(spark, sf_dir, "customer"))


@query("""WITH f AS (SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer)
SELECT 'c_acctbal' AS column, 'Float' AS kind, count(*) FILTER (c_acctbal IS NULL)::BIGINT AS nulls, count(DISTINCT c_acctbal)::BIGINT AS n_distinct, round(100.0 * count(DISTINCT c_acctbal) / count(*), 2) AS unique_pct, round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3, count(*) FILTER (c_acctbal < q1 - 1.5 * (q3 - q1) OR c_acctbal > q3 + 1.5 * (q3 - q1))::BIGINT AS outliers, array_to_string(list_sort(list(DISTINCT c_acctbal::VARCHAR))[1:5], ', ') AS samples FROM customer, f
UNION ALL SELECT 'c_mktsegment', 'Categorical', count(*) FILTER (c_mktsegment IS NULL), count(DISTINCT c_mktsegment), round(100.0 * count(DISTINCT c_mktsegment) / count(*), 2), NULL, NULL, NULL, array_to_string(list_sort(list(DISTINCT c_mktsegment))[1:5], ', ') FROM customer""")
def column_profile(spark, sf_dir):
    return _column_profile(spark, sf_dir).filter(F.col("column").isin("c_acctbal", "c_mktsegment")).withColumn("samples", F.array_join("samples", ", "))


@query("SELECT coalesce(CASE WHEN trim(c_mktsegment) = '' THEN 'SPACES' ELSE c_mktsegment END, 'NULL') AS class, count(*)::BIGINT AS n FROM customer GROUP BY 1 ORDER BY n DESC, class LIMIT 25")
def class_balance(spark, sf_dir):
    return profile.class_balance(table(spark, sf_dir, "customer"))


@query("""WITH old AS (SELECT o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0), new AS (SELECT o_totalprice * 1.2 AS v FROM orders WHERE o_orderkey % 2 = 1),
b AS (SELECT quantile_cont(v, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS b FROM old), k AS (SELECT len(list_filter(b[2:10], lambda x: v > x)) AS bucket FROM new, b),
c AS (SELECT bucket, count(*) AS n FROM k GROUP BY 1), s AS (SELECT greatest(coalesce(n, 0) / (SELECT count(*) FROM new), 1e-6) AS a, 0.1 AS e FROM range(10) r(i) LEFT JOIN c ON c.bucket = r.i)
SELECT 'o_totalprice' AS column, round(abs(sum((a - e) * ln(a / e))), 6) AS psi, CASE WHEN abs(sum((a - e) * ln(a / e))) > 0.25 THEN 'CRITICAL' WHEN abs(sum((a - e) * ln(a / e))) > 0.1 THEN 'MODERATE' ELSE 'STABLE' END AS status FROM s""")
def distribution_drift(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    stored = profile.distribution(o.filter("o_orderkey % 2 = 0"), ["o_totalprice"]).select("column", "boundaries")
    return drift.distribution(o.filter("o_orderkey % 2 = 1").select((F.col("o_totalprice") * 1.2).alias("o_totalprice")), stored, ["o_totalprice"])


@query(f"WITH {DIRTY}, r AS (SELECT round(count(*) FILTER (price IS NULL) / count(*), 6) AS p, round(count(*) FILTER (order_date IS NULL) / count(*), 6) AS d FROM dirty) SELECT 'price' AS column, p AS null_rate, 0.001::DOUBLE AS ema_null_rate, CASE WHEN p > 0.003 AND p > 0.05 THEN 'CRITICAL' WHEN p > 0.002 AND p > 0.03 THEN 'MODERATE' ELSE 'STABLE' END AS status FROM r UNION ALL SELECT 'order_date', d, 0.0, CASE WHEN d > 0.05 THEN 'NEW_NULLS' ELSE 'STABLE' END FROM r")
def null_rate_drift(spark, sf_dir):
    now = profile.null_profile(dirty_orders(spark, sf_dir).select("price", "order_date"), [])
    stored = now.select("column", F.when(F.col("column") == "price", 0.001).otherwise(0.0).alias("ema_null_rate"))
    return drift.null_rate(now, stored)


@query(f"WITH {DIRTY}, f AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM dirty) SELECT count(*)::BIGINT AS rows, count(*) FILTER (price IS NULL)::BIGINT AS missing, count(*) FILTER (price < 0 OR price > 500000)::BIGINT AS invalid, count(*) FILTER (price < q1 - 3.0 * (q3 - q1) OR price > q3 + 3.0 * (q3 - q1))::BIGINT AS outliers, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM dirty GROUP BY order_key)) AS duplicates FROM dirty, f")
def profile_before(spark, sf_dir):
    return profile.before(dirty_orders(spark, sf_dir), ["order_key"], "price", 0, 500000, "price")


@query("SELECT 'c_custkey' AS column, 'key_like' AS check, 100.0::DOUBLE AS value FROM (SELECT count(*) c FROM customer) WHERE c > 0 UNION ALL SELECT 'c_name', 'key_like', round(100.0 * count(DISTINCT c_name) / count(*), 4) FROM customer HAVING count(DISTINCT c_name) >= 0.9 * count(*) UNION ALL SELECT 'c_custkey', 'range_min', min(c_custkey) FROM customer UNION ALL SELECT 'c_custkey', 'range_max', max(c_custkey) FROM customer UNION ALL SELECT 'c_nationkey', 'range_min', min(c_nationkey) FROM customer UNION ALL SELECT 'c_nationkey', 'range_max', max(c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', 'range_min', round(min(c_acctbal), 4) FROM customer UNION ALL SELECT 'c_acctbal', 'range_max', round(max(c_acctbal), 4) FROM customer")
def health_checks(spark, sf_dir):
    return advise.health(table(spark, sf_dir, "customer"), keys=None, gaps=None, ranges=None, ids=True)
