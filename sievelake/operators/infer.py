"""Specs, keys and guards inferred from a table."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.align import engine_type
from .quantiles import value_counts

# Names that a date column has, and parts of one.
DATE_NAMES = ["updated_at", "created_at", "timestamp", "date", "time"]
DATE_PARTS = ["date", "time", "timestamp"]


def infer_spec(df: DataFrame) -> tuple[dict[str, str], str | None]:
    """Engine type of every column and the date column. Text stays text where any value has a leading zero, else it may be a number or a time."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    spec = {f.name: engine_type(f.dataType) for f in df.schema.fields}
    if texts:
        checks = []
        for c in texts:
            t = F.trim(F.col(c))
            filled = F.col(c).isNotNull() & (t != "")
            checks += [
                F.coalesce(F.max(t.rlike("^0[0-9]+$")), F.lit(False)).alias(f"{c}:zero"),
                F.coalesce(F.min(F.when(filled, t.try_cast("double").isNotNull())), F.lit(False)).alias(f"{c}:number"),
                F.coalesce(F.min(F.when(filled, t.try_cast("int").isNotNull())), F.lit(False)).alias(f"{c}:whole"),
                F.coalesce(F.min(F.when(filled, F.try_to_timestamp(t).isNotNull())), F.lit(False)).alias(f"{c}:time"),
            ]
        found = df.agg(*checks).first()
        for c in texts:
            if not found[f"{c}:zero"]:
                spec[c] = "IntegerType" if found[f"{c}:whole"] else "DoubleType" if found[f"{c}:number"] else "TimestampType" if found[f"{c}:time"] else "StringType"
    date = next((c for c in spec if c.lower() in DATE_NAMES), None) or next((c for c in spec if any(p in c.lower() for p in DATE_PARTS)), None)
    return spec, date


def id_candidates(columns: list[str], table_name: str = "") -> list[str]:
    """Columns that may be ids, best first: one that is named for the table's id, then all that have id in their names."""
    exact = [c for c in columns if c.lower() in ("id", f"{table_name}_id", f"{table_name}id")][:1]
    return exact + [c for c in columns if "id" in c.lower() and c not in exact]


def infer_primary_key(df: DataFrame, table_name: str = "", least: float = 0.9, extras: int = 5, most: int = 3) -> list[str]:
    """The columns that tell rows apart: the first id whose different values are 90 in 100 rows; else the smallest set of the first id and up to two text, date or boolean columns (of the first five) that is, of equals the densest; else none.

    Rows with a null in a key do not count for it. Without an id there is no
    key; without rows the first id is taken.
    """
    ids = id_candidates(df.columns, table_name)
    if not ids:
        return []
    total = df.count()
    if not total:
        return ids[:1]
    texts = [f.name for f in df.schema.fields if f.name != ids[0] and isinstance(f.dataType, (T.StringType, T.DateType, T.BooleanType))][:extras]
    keys = [(c,) for c in ids] + [(ids[0], *more) for size in range(1, most) for more in combinations(texts, size)]
    # Sets are stacked as columns are, so that their values are dealt out.
    whole = {str(k): F.when(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in s]), F.to_json(F.struct(*[F.col(f"`{c}`") for c in s]))) for k, s in enumerate(keys)}
    found = {int(r["column"]): r["n"] for r in value_counts(df, whole).groupBy("column").agg(F.count("*").alias("n")).collect()}  # a row a key
    fit = [(len(key), k if len(key) == 1 else -found.get(k, 0), k, key) for k, key in enumerate(keys) if found.get(k, 0) >= least * total]
    return list(min(fit)[3]) if fit else []


def input_guards(df: DataFrame, pk: list[str], strict: bool = False, sample: int = 100, longest: int = 150) -> DataFrame:
    """A row for every finding: empty input, missing key columns, columns of long text (by the first rows, which is the feature)."""
    spark = df.sparkSession
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    n, *means = df.limit(sample).agg(F.count("*"), *[F.avg(F.length(c)) for c in texts]).first()
    found = [("empty_input", None, "fail")] if not n else []
    found += [("missing_key", c, "fail") for c in pk if c not in df.columns]
    found += [("long_text", c, "fail" if strict else "warn") for c, m in zip(texts, means, strict=True) if (m or 0) > longest]
    return spark.createDataFrame(found, "finding string, column string, action string")
