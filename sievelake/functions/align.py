"""Names, types and values: bringing a table to its registered schema."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The engine's types, the nine date forms in the order tried, and what counts as epoch milliseconds.
ENGINE_TYPES = {"IntegerType": "int", "DoubleType": "double", "TimestampType": "timestamp", "StringType": "string"}
TIMESTAMP_FORMS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd",
    "dd/MM/yyyy",
    "MM/dd/yyyy",
]
EPOCH_MS = 100_000_000_000


def engine_type(kind: T.DataType) -> str:
    """Engine type of a Spark type: whole numbers that fit stay, other numbers are doubles, dates are timestamps, the rest is text."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return "IntegerType"
    if isinstance(kind, T.NumericType):
        return "DoubleType"
    return "TimestampType" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "StringType"


def clean_name(name: str) -> str:
    """Blanks, commas, semicolons, brackets, = and breaks become one underscore; none at the ends."""
    return re.sub("_+", "_", re.sub(r"[ ,;{}()\n\t=]", "_", name)).strip("_")


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_name(c) for c in df.columns])


def _loose(name: str) -> str:
    return re.sub(r"[\s_-]", "", name).lower()


def rename_to_spec(df: DataFrame, columns: list[str]) -> DataFrame:
    """Renames columns that differ from a registered name in case, blanks, - or _ alone."""
    known = {_loose(c): c for c in columns}
    return df.withColumnsRenamed({c: known[_loose(c)] for c in df.columns if c not in columns and _loose(c) in known and known[_loose(c)] not in df.columns})


def row_hash(df: DataFrame, exclude: tuple[str, ...] = (), name: str = "row_hash") -> DataFrame:
    """MD5 of the values as text, of columns in order of name, joined by ||; null is empty."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(df.columns) if c not in exclude]
    return df.withColumn(name, F.md5(F.concat_ws("||", *parts)))


def promote_integers(df: DataFrame, spec: dict[str, str]) -> dict[str, str]:
    """spec with DoubleType for integer columns whose text has a fraction other than zero; one pass."""
    whole = [c for c, t in spec.items() if t == "IntegerType" and c in df.columns]
    if not whole:
        return dict(spec)
    found = df.agg(*[F.max(F.col(c).cast("string").rlike(r"\.[0-9]*[1-9]")).alias(c) for c in whole]).first()
    return {c: "DoubleType" if c in whole and found[c] else t for c, t in spec.items()}


def parse_double(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def parse_int(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"[^0-9\-]", "").try_cast("double").try_cast("int")


def parse_timestamp(c: Column) -> Column:
    """The first date form that fits, then epoch milliseconds, then epoch seconds; null where none does."""
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    forms = [F.try_to_timestamp(text, F.lit(f)) for f in TIMESTAMP_FORMS]
    return F.coalesce(*forms, F.when(F.abs(number) >= EPOCH_MS, F.timestamp_millis(number.try_cast("long"))).when(number.isNotNull(), F.timestamp_seconds(number.try_cast("long"))))


def cast_to(c: Column, kind: str) -> Column:
    """Text brought to an engine type; what does not fit is null."""
    if kind == "IntegerType":
        return parse_int(c)
    if kind == "DoubleType":
        return parse_double(c)
    return parse_timestamp(c) if kind == "TimestampType" else c.cast("string")


def align_types(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Every registered column in its engine type, beside the text it had (raw_<c>) where it was text."""
    texts = [c for c in spec if c in df.columns and dict(df.dtypes)[c] == "string" and spec[c] != "StringType"]
    return df.withColumns({f"raw_{c}": F.col(c) for c in texts}).withColumns({c: cast_to(F.col(c), spec[c]) for c in texts})


def select_schema(df: DataFrame, spec: dict[str, str], extra: tuple[str, ...] = ()) -> DataFrame:
    """Registered columns and those wanted besides, in that order; nothing else."""
    return df.select(*[c for c in (*spec, *extra) if c in df.columns])
