"""Sinks and the upkeep of tables."""

from __future__ import annotations

import re
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = ("run_id", "ingest_id", "rejected_at", "reject_reason", "reasons", "zone", "_meta")


def write_quarantine(df: DataFrame, path: str, ingest_id: str) -> None:
    """Writes the rejected rows of a run (run_id) into a table by ingest and run; all earlier rows of the same ingest are replaced.

    An ingest is one folder, overwritten as a whole: other ingests are neither
    read nor touched, rows never stand twice, and a write that failed is
    repaired by writing again.
    """
    df.drop("ingest_id").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("run_id").parquet(f"{path}/ingest_id={ingest_id}")


def run_rows(df: DataFrame, run_id: str) -> DataFrame:
    return df.filter(F.col("run_id") == run_id).drop(*META)


def prepare_export(df: DataFrame, order: list[str]) -> DataFrame:
    """Without internal columns, in order (nulls last)."""
    return df.drop(*META).orderBy(*[F.col(c).asc_nulls_last() for c in order if c in df.columns])


#: Text that begins so is run by a spreadsheet, unless it is a plain number.
_FORMULA, _PLAIN = r"^[=+\-@\t\r]", r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def positional(c: Column) -> Column:
    """A double's shortest digits without an exponent or a fraction of zero; not finite ones are empty."""
    text = F.abs(c).cast("string")
    mantissa, power = F.substring_index(text, "E", 1), F.substring_index(text, "E", -1).try_cast("int")
    digits = F.replace(mantissa, F.lit("."), F.lit(""))
    large = F.when(F.length(digits) <= power + 1, F.rpad(digits, power + 1, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    plain = F.when(~text.contains("E"), text).when(power >= 0, large).otherwise(small)
    short = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit("")).when(c.isNotNull(), F.concat(F.when((c < 0) & (short != "0"), F.lit("-")).otherwise(F.lit("")), short))


def _safe_text(text: Column) -> Column:
    return F.when(text.rlike(_FORMULA) & ~text.rlike(_PLAIN), F.concat(F.lit("'"), text)).otherwise(text)


def _safe(f: T.StructField, days: bool) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.BooleanType):
        return F.upper(c.cast("string"))
    if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        return positional(c.cast("double"))
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd") if days else F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return _safe_text(c.cast("string"))


def header_labels(names: list[str], labels: dict[str, str]) -> list[str]:
    """A header for each column: its label, else its name; labels that columns share have the name in brackets, names that are still taken a number."""
    given = [labels.get(n) or n for n in names]
    safe = [f"'{g}" if re.match(_FORMULA, g) and not re.match(_PLAIN, g) else g for g in given]
    out: list[str] = []
    for name, label, own in zip(names, safe, given, strict=True):
        text = f"{label} [{name}]" if safe.count(label) > 1 and own != name else label
        out.append(text if text not in out else next(f"{text} ({k})" for k in count(2) if f"{text} ({k})" not in out))
    return out


def safe_csv(df: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Text columns as a spreadsheet can open them: no formulas, no exponents, headers unique.

    A column of times that all fall on midnight is written as days, for which
    the columns of times are read once more.
    """
    times = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
    days = {}
    if times:
        found = df.agg(*[F.min(F.coalesce(F.col(f"`{c}`") == F.date_trunc("day", F.col(f"`{c}`")), F.lit(True))).alias(f"t{k}") for k, c in enumerate(times)]).first()
        days = {c: found[k] is not False for k, c in enumerate(times)}
    return df.select(*[_safe(f, days.get(f.name, False)).alias(n) for f, n in zip(df.schema.fields, header_labels(df.columns, labels or {}), strict=True)])


def retain(df: DataFrame, ts: str, days: int, now: str) -> DataFrame:
    return df.filter(F.col(ts) >= F.lit(now).cast("timestamp") - F.expr(f"interval {int(days)} day"))
