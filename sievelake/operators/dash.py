"""Dashboard queries: metrics, filters and widgets over one table."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written

EMPTY, OTHER = "(empty)", "other"


def value_of(agg: str, column: str | None, condition: Column | None = None) -> Column:
    """An aggregate over the rows that meet the condition, in one pass; an empty sum is 0; rounded to 4, endless is null."""
    held = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
    if agg == "count":
        return F.count(F.when(held, 1))
    c = F.col(column)
    x = F.when(held, c)
    if agg == "count_distinct":
        return F.count_distinct(x)
    if agg == "count_missing":
        return F.count(F.when(held & c.isNull(), 1))
    out = {"sum": lambda: F.coalesce(F.sum(x), F.lit(0)), "avg": lambda: F.avg(x), "min": lambda: F.min(x), "max": lambda: F.max(x)}[agg]().cast("double")
    return F.round(F.when(F.abs(out) < F.lit(float("inf")), out), 4)


def where(column: str, op: str, value, kind: str = "text") -> Column:
    """A condition of a metric; null is false. A date without a time is the whole day; text '(empty)' is null."""
    c = F.col(column)
    if kind == "date" and isinstance(value, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
        c, value = F.to_date(c), F.lit(value).cast("date")
    elif kind == "date":
        value = F.lit(value).cast("timestamp")
    elif kind == "text":
        c = F.coalesce(c.cast("string"), F.lit(EMPTY))
    test = {"eq": lambda: c == value, "ne": lambda: c != value, "in": lambda: c.isin(value), "gt": lambda: c > value, "gte": lambda: c >= value, "lt": lambda: c < value, "lte": lambda: c <= value}[op]()
    return F.coalesce(test, F.lit(False))


def metric(definition: dict) -> Column:
    """simple {agg, column, where: [[column, op, value, kind]]} or ratio {numerator, denominator, percent}."""
    if "numerator" in definition:
        n, d = metric(definition["numerator"]), metric(definition["denominator"])
        return F.round(F.when(d != 0, (100 if definition.get("percent") else 1) * n / d), 4)
    tests = [where(*w) for w in definition.get("where", ())]
    return value_of(definition["agg"], definition.get("column"), reduce(lambda a, b: a & b, tests) if tests else None)


def label(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(EMPTY))


def grouped(df: DataFrame, by: str, definition: dict) -> DataFrame:
    return df.groupBy(label(by).alias("x")).agg(metric(definition).alias("value"))


def bucket(column: str, grain: str) -> Column:
    return F.date_trunc(grain, column)


def kpi(df: DataFrame, definition: dict, date: str | None = None, grain: str = "month") -> DataFrame:
    """The metric over all rows, and over the last two periods with their change in per cent."""
    if date is None:
        return df.agg(metric(definition).alias("value"))
    periods = df.filter(F.col(date).isNotNull()).groupBy(bucket(date, grain).alias("x")).agg(metric(definition).alias("value"))
    return _with_change(df.agg(metric(definition).alias("value")), periods)


def _with_change(whole: DataFrame, periods: DataFrame) -> DataFrame:
    """A value with that of the last two periods (x, value) and their change in per cent."""
    last = periods.orderBy(F.desc("x")).limit(2).agg(F.max_by("value", "x").alias("latest"), F.when(F.count("*") > 1, F.min_by("value", "x")).alias("previous"))
    change = F.round(F.when(F.col("previous") != 0, 100 * (F.col("latest") - F.col("previous")) / F.abs("previous")), 4)
    return whole.crossJoin(last).withColumn("change_pct", change)


def bar(df: DataFrame, by: str, definition: dict, sort: str = "desc", top: int = 20) -> DataFrame:
    return _ordered(grouped(df, by, definition), sort).limit(top)


def _ordered(points: DataFrame, sort: str) -> DataFrame:
    return points.orderBy(*{"desc": [F.desc_nulls_last("value"), "x"], "asc": [F.asc_nulls_last("value"), "x"], "x": ["x"]}[sort])


def folded(df: DataFrame, by: str, definition: dict, top: int) -> DataFrame:
    """df and `label`: the top labels by the metric as they are, all others 'other', so that metrics can be computed anew from rows."""
    best = grouped(df, by, definition).orderBy(F.desc_nulls_last("value"), "x").limit(top).select(F.col("x").alias("__x"))
    return df.withColumn("__l", label(by)).join(F.broadcast(best), F.col("__l") == F.col("__x"), "left").withColumn("label", F.coalesce("__x", F.lit(OTHER))).drop("__l", "__x")


def pie(df: DataFrame, by: str, definition: dict, top: int = 6) -> DataFrame:
    return folded(df, by, definition, top).groupBy("label").agg(metric(definition).alias("value"))


def split(df: DataFrame, x: str, by: str, definition: dict, top: int = 8) -> DataFrame:
    """The metric by x and series; all but the top series are one."""
    return folded(df, by, definition, top).groupBy(label(x).alias("x"), F.col("label").alias("series")).agg(metric(definition).alias("value"))


def time(df: DataFrame, date: str, definition: dict, grain: str = "month", last: int = 500) -> DataFrame:
    points = df.filter(F.col(date).isNotNull()).groupBy(bucket(date, grain).alias("x")).agg(metric(definition).alias("value"))
    return points.orderBy(F.desc("x")).limit(last)


def table(df: DataFrame, columns: list[str], sort: list[tuple[str, str]], limit: int) -> DataFrame:
    order = [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in sort]
    return df.select(*columns).orderBy(*order).limit(limit)


def apply_filters(df: DataFrame, selections: dict[str, dict], kinds: dict[str, str], grains: dict[str, str] | None = None) -> DataFrame:
    """Viewers' choices: {'column': {'values': [labels]} or {'from': day, 'to': day}}; columns that the table lacks are passed over."""
    for c, choice in selections.items():
        if c not in df.columns:
            continue
        if "values" in choice:
            shown = F.date_format(bucket(c, (grains or {}).get(c, "day")), "yyyy-MM-dd") if kinds.get(c) == "date" else label(c)
            df = df.filter(shown.isin(choice["values"]))
        if choice.get("from"):
            df = df.filter(F.to_date(c) >= F.lit(choice["from"]).cast("date"))
        if choice.get("to"):
            df = df.filter(F.to_date(c) <= F.lit(choice["to"]).cast("date"))
    return df


def filter_options(df: DataFrame, column: str, kind: str, most: int = 100) -> DataFrame:
    if kind == "date":
        return df.agg(F.to_date(F.min(column)).alias("from"), F.to_date(F.max(column)).alias("to"))
    return df.select(label(column).alias("value")).distinct().orderBy("value").limit(most)


def compute(df: DataFrame, spec: list[dict], selections: dict[str, dict], kinds: dict[str, str], personal: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """All widgets of a dashboard over one filtered table, personal columns hidden; by the widget's id.

    KPIs, bars and lines come from one pass (one_pass), whose rows, one for
    each label and period, are written; their widgets read those. Widgets that
    fold labels (pie, split) and tables read the filtered rows themselves.
    """
    shown = apply_filters(df, selections, kinds).drop(*personal)
    together = [w for w in spec if w["type"] in ("kpi", "bar", "time")]
    out = {}
    if together:
        cells, read = one_pass(shown, together)
        cells = written(cells, "widgets")
        out = {w["id"]: read(cells, w) for w in together}
    kind = {"pie": pie, "split": split, "table": table}
    rest = {w["id"]: kind[w["type"]](shown, **{k: v for k, v in w.items() if k not in ("id", "type")}) for w in spec if w["type"] in kind}
    return {w["id"]: {**out, **rest}[w["id"]] for w in spec}


def _dimension(w: dict) -> tuple[str, ...] | None:
    if w["type"] == "bar":
        return ("label", w["by"])
    return ("bucket", w["date"], w.get("grain", "month")) if w.get("date") else None


def one_pass(df: DataFrame, spec: list[dict]) -> tuple[DataFrame, Callable[[DataFrame, dict], DataFrame]]:
    """All metrics of KPIs, bars and lines as one aggregation with a grouping set for each dimension and one for all rows, and how a widget is read from it."""
    dims = list(dict.fromkeys(d for d in map(_dimension, spec) if d))
    metrics = list(dict.fromkeys(json.dumps(w["definition"], sort_keys=True, default=str) for w in spec))
    definitions = {json.dumps(w["definition"], sort_keys=True, default=str): w["definition"] for w in spec}
    columns = {d: f"__d{k}" for k, d in enumerate(dims)}
    based = df.withColumns({columns[d]: label(d[1]) if d[0] == "label" else bucket(d[1], d[2]) for d in dims}) if dims else df
    values = [metric(definitions[m]).alias(f"__m{k}") for k, m in enumerate(metrics)]
    if dims:
        cells = based.groupingSets([*[[F.col(columns[d])] for d in dims], []], *[F.col(columns[d]) for d in dims]).agg(F.grouping_id().alias("__set"), *values)
    else:
        cells = based.agg(*values).withColumn("__set", F.lit(0).cast("long"))
    every = (1 << len(dims)) - 1

    def read(cells: DataFrame, w: dict) -> DataFrame:
        value = F.col(f"__m{metrics.index(json.dumps(w['definition'], sort_keys=True, default=str))}").alias("value")
        d = _dimension(w)
        whole = cells.filter(F.col("__set") == every).select(value)
        if d is None:
            return whole
        points = cells.filter(F.col("__set") == every - (1 << (len(dims) - 1 - dims.index(d)))).select(F.col(columns[d]).alias("x"), value)
        if w["type"] == "bar":
            return _ordered(points, w.get("sort", "desc")).limit(w.get("top", 20))
        periods = points.filter("x is not null")
        return periods.orderBy(F.desc("x")).limit(w.get("last", 500)) if w["type"] == "time" else _with_change(whole, periods)

    return cells, read


def quality_dataset(runs: DataFrame) -> DataFrame:
    """Runs as flat columns, with gate_result: pass or fail, null when unknown."""
    score, level = F.col("quality_score"), F.col("effective_quality_threshold")
    gate = F.when(score.isNull() | level.isNull(), None).when(score >= level, "pass").otherwise("fail")
    return runs.select("run_id", "table_name", "timestamp", "total_records", "clean_records", "quarantined_records", "quality_score", "freshness_lag_hours", "quarantined_financial_value", "effective_quality_threshold", gate.alias("gate_result"))


def default_spec(roles: list[dict], audience: str = "overview") -> list[dict]:
    """Widgets for a table from the roles of its columns (operators.advise.column_roles): a row count, totals of money, bars, a line, a table."""
    measures = [r["column"] for r in roles if r["role"] == "measure"]
    money = [r["column"] for r in roles if r["role"] == "measure" and r["unit"] == "currency"][:5]
    dims = [r["column"] for r in roles if r["role"] == "dimension" and not r["is_personal"]]
    dates = [r["column"] for r in roles if r["role"] == "time"]
    count = {"agg": "count"}
    spec = [{"id": "rows", "type": "kpi", "definition": count}]
    spec += [{"id": f"total_{m}", "type": "kpi", "definition": {"agg": "sum", "column": m}} for m in money]
    spec += [{"id": f"by_{d}", "type": "bar", "by": d, "definition": count} for d in dims[:3]]
    if dates:
        spec.append({"id": "trend", "type": "time", "date": dates[0], "definition": {"agg": "sum", "column": money[0]} if money else count})
    if audience == "steward":
        spec += [{"id": f"missing_{r['column']}", "type": "kpi", "definition": {"agg": "count_missing", "column": r["column"]}} for r in roles]
    elif audience == "management" and measures:
        spec = spec[: 1 + len(money)] + spec[-1:]
    return spec
