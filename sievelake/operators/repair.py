"""Repairs: the rules that a table is mended by before it is validated."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.align import parse_double

#: What arithmetic and conditions may be written with.
_ARITHMETIC = re.compile(r"[\w\s+\-*/().,]+")
_CONDITION = re.compile(r"[\w\s+\-*/().,<>=!'%]+")
# Months by their English short names.
MONTHS = {"jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06", "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12"}


def _allowed(pattern: re.Pattern, text: str) -> str:
    if not pattern.fullmatch(text) or "--" in text or ";" in text:
        raise ValueError(f"not an allowed expression: {text!r}")
    return text


def fillna(df: DataFrame, column: str, value) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value).cast(dict(df.dtypes)[column])))


def calculate(df: DataFrame, column: str, expression: str, condition: str | None = None) -> DataFrame:
    value = F.expr(_allowed(_ARITHMETIC, expression))
    if condition and column in df.columns:
        value = F.when(F.expr(_allowed(_CONDITION, condition)), value).otherwise(F.col(column))
    elif condition:
        value = F.when(F.expr(_allowed(_CONDITION, condition)), value)
    return df.withColumn(column, value)


def cast(df: DataFrame, column: str, to: str) -> DataFrame:
    return df.withColumn(column, F.col(column).try_cast({"int": "int", "double": "double", "string": "string", "timestamp": "timestamp"}[to]))


def keep(df: DataFrame, condition: str) -> DataFrame:
    return df.filter(F.expr(_allowed(_CONDITION, condition)))


def standardize(df: DataFrame, column: str, mapping: dict[str, str], fallback: str | None = None) -> DataFrame:
    """Values by a mapping: exact after lower-casing and trimming, else the first key (of 3 letters or more) that contains or is contained; else fallback, else as it was."""
    value = F.lower(F.trim(F.col(column).cast("string")))
    exact = F.element_at(F.create_map(*chain.from_iterable((F.lit(k.strip().lower()), F.lit(v)) for k, v in mapping.items())), value) if mapping else F.lit(None).cast("string")
    parts = [F.when(value.contains(k.strip().lower()) | (F.lit(k.strip().lower()).contains(value) & (F.length(value) >= 3)), F.lit(v)) for k, v in mapping.items() if len(k.strip()) >= 3]
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce(exact, *parts, F.lit(fallback) if fallback is not None else F.col(column))))


def keyword_category(column: Column, categories: dict[str, list[str]], fallback: str | None = None) -> Column:
    """The first category of which any keyword is in the text."""
    text, out = F.lower(column), None
    for name, words in categories.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w.lower())
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    other = F.lit(fallback) if fallback is not None else column
    return other if out is None else out.otherwise(other)


def standardize_date(column: Column) -> Column:
    """yyyy-MM-dd from '21 Jul 2569' (anywhere in the text) or three numbers with - or / between them; a year over 2500 is Buddhist.

    A first number over 1000 is the year, else the day; a month name that is
    none is January; empty text is null, anything else stays but for its blanks.
    """
    text = F.trim(F.regexp_replace(F.trim(column.cast("string")), r"\s+", " "))
    number = lambda c: c.try_cast("int")
    by_name = r"([0-9]+)\s+([A-Za-z]+)\s+([0-9]+)"
    day, name, year = (F.regexp_extract(text, by_name, k) for k in (1, 2, 3))
    months = F.create_map(*chain.from_iterable((F.lit(k), F.lit(int(v))) for k, v in MONTHS.items()))
    month = F.coalesce(F.try_element_at(months, F.lower(F.substring(name, 1, 3))), F.lit(1))
    parts = F.split(text, "[-/]")
    one, two, three = (number(F.trim(F.get(parts, F.lit(k)))) for k in range(3))
    numbered = (F.size(parts) == 3) & one.isNotNull() & two.isNotNull() & three.isNotNull()

    def form(y: Column, m: Column, d: Column) -> Column:
        return F.format_string("%04d-%02d-%02d", F.when(y > 2500, y - 543).otherwise(y), m, d)

    return (
        F.when(column.isNull() | (column.cast("string") == ""), F.lit(None).cast("string"))
        .when((day != "") & number(day).isNotNull() & number(year).isNotNull(), form(number(year), month, number(day)))
        .when(numbered & (one > 1000), form(one, two, three))
        .when(numbered, form(three, two, one))
        .otherwise(text)
    )


# Classes of rejected rows by what their reason contains, in the order tried.
REJECT_CLASSES = [
    ("duplicate_records", "unfixable"),
    ("invalid_type_", "type_mismatch"),
    ("null_value_in_", "null_values"),
    ("missing_primary_key", "null_values"),
    ("missing_date", "format_errors"),
    ("outlier", "outliers"),
    ("anomaly", "outliers"),
    ("unsupervised", "outliers"),
]


def categorize_rejects(quarantine: DataFrame) -> DataFrame:
    """Rows held back, by what could mend them; a row with several reasons goes by the first class that fits."""
    r = F.coalesce("reject_reason", F.lit(""))
    kind = F.coalesce(*[F.when(r.contains(part), F.lit(name)) for part, name in REJECT_CLASSES], F.lit("unfixable"))
    return quarantine.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def with_meta(df: DataFrame, execution_id: str, rules: list[str], quality: list[str]) -> DataFrame:
    """Adds _meta with the contract of the run; a table that has it from the same execution stays as it is."""
    if "_meta" in df.columns:
        first = df.select("_meta.execution_id").first()
        if first is not None and first[0] == execution_id:
            return df
    return df.withColumn("_meta", F.struct(F.lit(execution_id).alias("execution_id"), F.array(*map(F.lit, rules)).alias("rules"), F.array(*map(F.lit, quality)).alias("quality")))


def auto_strategy(df: DataFrame, column: str, mapping: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """Mends a column by what it holds: numbers are parsed (0.0 where that fails), few short values are mapped, the rest is left to fuzzy matching."""
    if dict(df.dtypes)[column] not in ("string",):
        return df.withColumn(column, F.coalesce(parse_double(F.col(column)), F.lit(0.0))), "numeric"
    distinct, length, numeric = df.agg(F.approx_count_distinct(column), F.coalesce(F.avg(F.length(column)), F.lit(0.0)), F.coalesce(F.avg(F.col(column).try_cast("double").isNotNull().cast("int")), F.lit(0.0))).first()
    if numeric >= 0.9:
        return df.withColumn(column, F.coalesce(parse_double(F.col(column)), F.lit(0.0))), "numeric"
    if distinct < 50 and length < 12:
        return standardize(df, column, mapping or {}), "categorical"
    return df, "semantic"


def apply_rules(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Repairs in order; a rule is {'kind': name, ...arguments}."""
    kinds = {"fillna": fillna, "calculate": calculate, "cast": cast, "filter": keep, "standardize": standardize}
    for rule in rules:
        df = kinds[rule["kind"]](df, **{k: v for k, v in rule.items() if k != "kind"})
    return df


# Fixed value: words in a column's name that tell of a person or a thing.
IDENTIFYING = re.compile(r"(^|_)(id|uuid|name|email|phone|mobile|tel|address|ssn)(_|$)", re.I)


def redact(df: DataFrame, pk: list[str] | str = ()) -> DataFrame:
    """'<redacted>' for every value of columns that are keys or have an identifying word in their name; null stays.

    pk: names, or a text that joins them by commas; 'unknown' and blanks are no names.
    """
    keys = {k.strip() for k in (pk.split(",") if isinstance(pk, str) else pk)} - {"", "unknown"}
    return df.withColumns({c: F.when(F.col(f"`{c}`").isNotNull(), F.lit("<redacted>")) for c in df.columns if c in keys or IDENTIFYING.search(c)})
