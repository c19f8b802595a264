"""Row validation: reasons for which a row cannot be clean, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _none() -> Column:
    return F.lit(None).cast("string")


def missing_key(pk: list[str]) -> Column:
    """'missing_primary_key' where any key column is null."""
    missing = F.lit(False)
    for c in pk:
        missing = missing | F.col(c).isNull()
    return F.when(missing, F.lit("missing_primary_key"))


def null_checks(columns: list[str]) -> Column:
    """'null_value_in_<c>' for the first column that is null."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"null_value_in_{c}")) for c in columns]
    return F.coalesce(*checks) if checks else _none()


def type_checks(spec: dict[str, str]) -> Column:
    """'invalid_type_<c>' for the first column whose text (raw_<c>, see functions.align) is there and its value is not."""
    checks = [F.when(F.col(f"raw_{c}").isNotNull() & (F.trim(F.col(f"raw_{c}")) != "") & F.col(c).isNull(), F.lit(f"invalid_type_{c}")) for c in spec]
    return F.coalesce(*checks) if checks else _none()


def missing_date(column: str) -> Column:
    return F.when(F.col(column).isNull(), F.lit("missing_date"))


def range_rules(checks: dict[str, tuple[float | None, float | None]]) -> Column:
    """'out_of_range_<c>' for all columns outside their inclusive bounds, joined by '; '; null passes."""
    parts = []
    for c, (low, high) in checks.items():
        outside = F.lit(False)
        if low is not None:
            outside = outside | (F.col(c) < low)
        if high is not None:
            outside = outside | (F.col(c) > high)
        parts.append(F.when(outside, F.lit(f"out_of_range_{c}")))
    joined = F.concat_ws("; ", *parts)
    return F.when(joined != "", joined)


def induced_rules(conditions: list[str]) -> Column:
    """'induced_tree_rule_match' where any SQL condition holds; unknown is clean."""
    hit = F.lit(False)
    for c in conditions:
        hit = hit | F.coalesce(F.expr(c), F.lit(False))
    return F.when(hit, F.lit("induced_tree_rule_match"))


def expect(df: DataFrame, expectations: list[dict]) -> DataFrame:
    """Tests expectations {column, kind: not_null | between | matches | in_set, severity, ...}: one row for each, with tested and failed rows."""
    rows = []
    for k, e in enumerate(expectations):
        c = F.col(e["column"])
        holds = {
            "not_null": lambda c=c: c.isNotNull(),
            "between": lambda c=c, e=e: c.isNull() | c.between(e["min"], e["max"]),
            "matches": lambda c=c, e=e: c.isNull() | c.rlike(e["pattern"]),
            "in_set": lambda c=c, e=e: c.isNull() | c.isin(e["values"]),
        }[e["kind"]]()
        rows.append(F.struct(F.lit(k).alias("nth"), F.lit(e["column"]).alias("column"), F.lit(e["kind"]).alias("kind"), F.lit(e.get("severity", "critical")).alias("severity"), F.count("*").alias("tested"), F.count(F.when(~holds, 1)).alias("failed")))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def with_reasons(df: DataFrame, first: list[Column], more: tuple[Column, ...] = ()) -> DataFrame:
    """Adds reasons: the first that hits of `first`, then each of `more` that hits; no reason, an empty array."""
    return df.withColumn("reasons", F.filter(F.array(F.coalesce(*first, _none()), *more), lambda r: r.isNotNull()))


def reject_reason() -> Column:
    return F.when(F.size("reasons") > 0, F.array_join("reasons", "; "))
