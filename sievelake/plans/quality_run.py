"""The batch quality run: one tagged table and one row of metrics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from ..operators import dedup, metrics, outliers, repair, validate


@dataclass(frozen=True)
class TableSpec:
    """A registered table: key, date, and the rules of its run."""

    name: str
    pk: list[str]
    date: str | None = None
    required: list[str] = field(default_factory=list)
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    iqr: list[str] = field(default_factory=list)
    iqr_k: float = 3.0
    zscore: list[str] = field(default_factory=list)
    tie: list[str] = field(default_factory=list)
    types: dict[str, str] = field(default_factory=dict)


def tag(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Adds reasons, reject_reason and zone (clean or quarantine) to every row; no row is lost.

    Stages in order, each over the rows still clean: key, nulls, types (of
    spec.types: a text raw_<c> with a value that could not be read), date,
    duplicates of a key (all but the newest), ranges, fences, z-scores. What
    the first stages find is written once where fences or z-scores follow.
    """
    # A text that could not be read is a null too; it is named for what it is.
    types = validate.type_checks(spec.types)
    nulls = F.when(types.isNull(), validate.null_checks(spec.required)) if spec.types else validate.null_checks(spec.required)
    checks = validate.with_reasons(df, [validate.missing_key(spec.pk), nulls, types], (validate.missing_date(spec.date),) if spec.date else ())
    # Rows without a reason are ranked by themselves, so that a rejected row never hides a clean one of its key. Null
    # keys, which are all rejected, are dealt out (dedup.mark_first).
    whole = F.size("reasons") == 0
    marked = dedup.split_duplicates(checks.withColumn("__whole", whole), [*spec.pk, "__whole"], spec.date, spec.tie)
    reasons: Column = F.when(~F.col("__whole"), F.col("reasons")).when(F.col("is_duplicate"), F.array(F.lit("duplicate_records"))).otherwise(F.array_compact(F.array(validate.range_rules(spec.ranges))) if spec.ranges else F.array().cast("array<string>"))
    tagged = marked.withColumn("reasons", reasons).drop("is_duplicate", "__whole")
    if spec.iqr or spec.zscore:
        tagged = written(tagged, "tagged")
    if spec.iqr:
        bounds = outliers.iqr_bounds(tagged.filter(F.size("reasons") == 0), spec.iqr, spec.iqr_k)
        tagged = _added(outliers.flag_iqr(tagged, bounds, spec.iqr), "outliers")
    if spec.zscore:
        tagged = _added(outliers.flag_zscore(tagged, spec.zscore, of=tagged.filter(F.size("reasons") == 0)), "zscore_outliers")
    return tagged.withColumn("reject_reason", validate.reject_reason()).withColumn("zone", F.when(F.size("reasons") == 0, "clean").otherwise("quarantine"))


def _added(flagged: DataFrame, name: str) -> DataFrame:
    """Outliers become the reasons of rows that had none."""
    return flagged.withColumn("reasons", F.when(F.size("reasons") == 0, F.col(name)).otherwise(F.col("reasons"))).drop(name)


def run(df: DataFrame, spec: TableSpec, run_id: str, rules: list[dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """The tagged table and its row of metrics; rules are repairs applied first (operators.repair)."""
    tagged = tag(repair.apply_rules(df, rules or []), spec).withColumn("run_id", F.lit(run_id))
    return tagged, metrics.run_row(tagged, spec.name, run_id)
