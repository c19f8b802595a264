"""Three zones: Valid, Review and Quarantine, by recommended rules and reviewers' decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dedup
from .quantiles import quantiles, wide

#: Fixed value: the order in which kinds of rules are tried.
ORDER = ["composite_unique", "null_check", "range_check", "auto_iqr", "category_consistency"]


def duplicate_mask(df: DataFrame, columns: list[str], keep: str = "first", order: list[str] = (), name: str = "is_duplicate") -> DataFrame:
    """Marks rows that repeat a key: all but the first, all but the last, or all (keep='none'). Null keys are equal to one another.

    Neither form gathers the rows of a key: firsts come from dedup.mark_first,
    counts are made before the shuffle, and keys that repeat come back by a
    join, which Spark can split.
    """
    if keep == "none":
        keys = [F.col(f"`{c}`") for c in columns]
        repeated = df.groupBy(*[k.alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("__n")).filter("__n > 1")
        same = reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
        return df.join(repeated, same, "left").withColumn(name, F.col("__n").isNotNull()).drop("__n", *[f"__k{i}" for i in range(len(keys))])
    by = [F.col(c).asc() if keep == "first" else F.col(c).desc() for c in order]
    return dedup.mark_first(df, columns, by, name).withColumn(name, ~F.col(name))


def category_mask(column: str, allowed: list[str]) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).cast("string").isin(allowed)


def segregate(df: DataFrame, rules: list[dict], order: list[str]) -> DataFrame:
    """Adds zone, error_type and rule: those of the first rule that hits, Valid without one.

    Rules: {'kind', 'label', 'action': Quarantine or Review, ...} with columns
    and keep (composite_unique), column (others), min and max (range_check),
    low and high (auto_iqr), allowed (category_consistency). Kinds are tried in
    ORDER. Only uniqueness needs a window; the rest is one expression a row.
    """
    ranked = sorted(rules, key=lambda r: ORDER.index(r["kind"]))
    hits = []
    for k, rule in enumerate(ranked):
        if rule["kind"] == "composite_unique":
            df = duplicate_mask(df, rule["columns"], rule.get("keep", "first"), order, f"__dup_{k}")
            hit: Column = F.col(f"__dup_{k}")
        else:
            c = F.col(rule["column"])
            if rule["kind"] == "null_check":
                hit = c.isNull()
            elif rule["kind"] == "category_consistency":
                hit = category_mask(rule["column"], rule["allowed"])
            else:
                low, high = (rule.get("min"), rule.get("max")) if rule["kind"] == "range_check" else (rule.get("low"), rule.get("high"))
                outside = [x for x in ((c < low) if low is not None else None, (c > high) if high is not None else None) if x is not None]
                hit = F.coalesce(reduce(lambda a, b: a | b, outside, F.lit(False)), F.lit(False))
        hits.append(F.when(hit, F.struct(F.lit(rule["action"]).alias("zone"), F.lit(rule["kind"]).alias("error_type"), F.lit(rule["label"]).alias("rule"))))
    none = F.struct(F.lit("Valid").alias("zone"), F.lit(None).cast("string").alias("error_type"), F.lit(None).cast("string").alias("rule"))
    tagged = df.withColumn("__z", F.coalesce(*hits, none))
    return tagged.select(*[c for c in df.columns if not c.startswith("__dup_")], "__z.*")


def apply_decisions(zoned: DataFrame, row_id: str, bulk: str | None, decisions: DataFrame) -> DataFrame:
    """Review rows go where reviewers sent them: by row (row_id, decision), else by the bulk decision ('approve' or 'reject')."""
    own = decisions.select(F.col(row_id), F.col("decision").alias("__decision"))
    joined = zoned.join(own, row_id, "left")
    decided = F.coalesce("__decision", F.lit(bulk))
    zone = F.when(F.col("zone") != "Review", F.col("zone")).when(decided == "approve", "Valid").when(decided == "reject", "Quarantine").otherwise(F.col("zone"))
    return joined.withColumn("zone", zone).drop("__decision")


def reconcile(zoned: DataFrame) -> DataFrame:
    """Rows of each zone, and how many of the total no zone has."""
    counts = {z: F.count(F.when(F.col("zone") == z, 1)) for z in ("Valid", "Review", "Quarantine")}
    return zoned.agg(F.count("*").alias("total"), *[c.alias(z.lower()) for z, c in counts.items()], (F.count("*") - reduce(lambda a, b: a + b, counts.values())).alias("unaccounted"))


def rule_impact(zoned: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows that each rule moved; rules that moved none are listed with 0."""
    listed = reduce(DataFrame.union, [zoned.sparkSession.range(1).select(F.lit(r["label"]).alias("rule"), F.lit(r["kind"]).alias("kind")) for r in rules])
    return listed.join(zoned.groupBy("rule").agg(F.count("*").alias("n")), "rule", "left").select("rule", "kind", F.coalesce("n", F.lit(0)).alias("n"))


def column_impact(raw: DataFrame, clean: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    """Nulls, mean and outliers of every column before and after, by fences of the raw data."""
    fences = wide(quantiles(raw, {c: F.col(c) for c in columns}, [0.25, 0.75]), columns, F.col("q"), "__q_")
    out = None
    for stage, df in (("before", raw), ("after", clean)):
        joined = df.select(*columns).crossJoin(F.broadcast(fences))
        rows = []
        for c in columns:
            q1, q3 = F.col(f"__q_{c}")[0], F.col(f"__q_{c}")[1]
            outside = (F.col(c) < q1 - k * (q3 - q1)) | (F.col(c) > q3 + k * (q3 - q1))
            rows.append(F.struct(F.lit(stage).alias("stage"), F.lit(c).alias("column"), F.count(F.when(F.col(c).isNull(), 1)).alias("nulls"), F.round(F.avg(c), 4).alias("mean"), F.count(F.when(outside, 1)).alias("outliers")))
        part = joined.agg(F.array(*rows).alias("r")).select(F.inline("r"))
        out = part if out is None else out.union(part)
    return out


def gate_metrics(zoned: DataFrame) -> DataFrame:
    """Rows stopped at gate 1 (values) and gate 2 (duplicates), by kind, and the share of valid rows."""
    def n(kind: str) -> Column:
        return F.count(F.when(F.col("error_type") == kind, 1))

    gate1 = n("null_check") + n("range_check") + n("auto_iqr") + n("category_consistency")
    return zoned.agg(
        F.count("*").alias("total"), gate1.alias("gate1"), n("composite_unique").alias("gate2"), n("null_check").alias("missing"), n("range_check").alias("out_of_range"), n("auto_iqr").alias("outliers"),
        F.round(100 * F.count(F.when(F.col("zone") == "Valid", 1)) / F.greatest(F.count("*"), F.lit(1)), 4).alias("score"),
    )


def assemble_quarantine(parts: list[DataFrame], run_id: str, rejected_at: str) -> DataFrame:
    """All reject sets as one table, by name of column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumns({"run_id": F.lit(run_id), "rejected_at": F.lit(rejected_at).cast("timestamp")})
