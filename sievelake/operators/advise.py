"""Rules and advice from profiles, rejects and drift."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from . import drift, profile
from .metrics import reasons_of

#: Parts of names whose values have bounds, in the order tried: parts, least and greatest value.
DOMAINS = [
    (["age"], 0.0, 120.0),
    (["score", "humidity", "percent", "rate", "ratio"], 0.0, 100.0),
    (["price", "salary", "income", "stock", "cost", "revenue", "amount", "fee", "balance"], 0.0, None),
]
#: Parts of names that are held to be times.
TIMES = ["date", "timestamp", "time"]


def recommend_rules(df: DataFrame, optional: tuple[str, ...] = (), domains: dict[str, tuple[float, float]] | None = None, k: float = 3.0) -> DataFrame:
    """Rules that a table's profile calls for: rule_type, column, action, low, high, rationale.

    Uniqueness where rows repeat: of the columns named for ids together, or of
    whole rows; completeness of columns with nulls (optional ones are only
    reviewed); ranges of numbers by `domains` or by parts of their names; fences
    of numbers that have values outside Tukey's; categories; freshness.
    """
    p = written(profile.columns(df), "profile")
    ids = [c for c in df.columns if c.lower().endswith("_id") or c.lower() == "id"]
    keys = ids or df.columns
    repeated = profile.duplicates(df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in keys]), {"ignoreNullFields": "false"}).alias("key")), []).filter("duplicates > 0")
    none = F.lit(None).cast("double")

    def of(where: Column, kind: str, action: Column, why: Column, low: Column = none, high: Column = none) -> DataFrame:
        return p.filter(where).select(F.lit(kind).alias("rule_type"), "column", action.alias("action"), low.alias("low"), high.alias("high"), why.alias("rationale"))

    name, number = F.lower("column"), F.col("kind").isin("Integer", "Float")
    needed = ~F.col("column").isin(*optional) | name.endswith("_id") | (name == "id") if optional else F.lit(True)
    known = domains or {}
    bounds = [F.when(F.col("column") == c, F.struct(F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high"))) for c, (a, b) in known.items()]
    bounds += [F.when(name.rlike("|".join(parts)), F.struct(F.lit(a).cast("double").alias("low"), F.lit(b).cast("double").alias("high"))) for parts, a, b in DOMAINS]
    domain = F.coalesce(*bounds)
    fence = [F.round(F.col("q1") - k * (F.col("q3") - F.col("q1")), 2), F.round(F.col("q3") + k * (F.col("q3") - F.col("q1")), 2)]
    parts = [
        repeated.select(F.lit("composite_unique").alias("rule_type"), F.lit(" + ".join(keys)).alias("column"), F.lit("Quarantine").alias("action"), none.alias("low"), none.alias("high"), F.concat(F.col("duplicates").cast("string"), F.lit(" repeated rows")).alias("rationale")),
        of(F.col("nulls") > 0, "null_check", F.when(needed, "Quarantine").otherwise("Review"), F.concat(F.col("nulls").cast("string"), F.lit(" nulls"))),
        of(number & domain.isNotNull(), "range_check", F.lit("Quarantine"), F.lit("bounds of what the name says"), domain["low"], domain["high"]),
        of(number & (F.col("outliers") > 0), "auto_iqr", F.lit("Review"), F.concat(F.col("outliers").cast("string"), F.lit(" outliers")), *fence),
        of((F.col("kind") == "Categorical") & (F.col("n_distinct") >= 2), "category_consistency", F.lit("Review"), F.concat(F.col("n_distinct").cast("string"), F.lit(" categories"))),
        of((F.col("kind") == "Date") | name.rlike("|".join(TIMES)), "freshness", F.lit("Warning"), F.lit("dated table")),
    ]
    return reduce(DataFrame.unionByName, parts)


# Words of a column's name, and parts of names, that tell what it is for.
PERSONAL_WORDS = ["email", "phone", "mobile", "tel", "telephone", "address", "passport", "ssn", "birth", "birthday", "birthdate", "dob"]
PERSONAL_PARTS = ["email", "idcard", "citizen", "nationalid", "dateofbirth"]
PERSONS = ["customer", "first", "last", "full", "user", "contact", "person", "employee", "owner", "member", "client", "patient", "student", "given", "family", "middle", "sender", "receiver", "recipient"]
PERSON_NAMES = ["name", "username", "fullname", "firstname", "lastname", "customername", "surname"]
PERSONAL_THAI = ["ชื่อลูกค้า", "ชื่อผู้", "ชื่อจริง", "นามสกุล", "ชื่อ-สกุล", "อีเมล", "เบอร์โทร", "ที่อยู่", "บัตรประชาชน", "เลขบัตร"]
IDENTIFIERS = ["id", "uuid"]
CODES = ["code", "no", "sku", "key"]
PERCENTS = ["pct", "percent", "percentage", "rate", "ratio", "score", "margin"]
MONEY = ["sales", "revenue", "amount", "price", "cost", "profit", "income", "value", "spend"]
AGES = ["age"]
COUNTS = ["qty", "quantity", "count", "records", "rows", "units", "items"]
DURATIONS = {"seconds": "seconds", "secs": "seconds", "sec": "seconds", "duration": "seconds", "minutes": "minutes", "mins": "minutes", "hours": "hours", "hrs": "hours", "lag": "hours", "days": "days"}
MONEY_THAI = ["ยอด", "ราคา", "ต้นทุน", "กำไร"]
AGES_THAI = ["อายุ"]
COUNTS_THAI = ["จำนวน"]


def name_words(c: Column) -> Column:
    """Words of a name in lower case: cut where a capital follows, and at all but Latin and Thai letters and digits."""
    spaced = F.lower(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"))
    return F.filter(F.split(spaced, "[^a-z0-9\u0e00-\u0e7f]+"), lambda w: w != "")


def is_personal(c: Column) -> Column:
    """Whether a column's name tells of a person."""
    words, any_part = name_words(c), lambda text, parts: reduce(lambda a, b: a | b, [text.contains(p) for p in parts])
    joined = F.array_join(words, "")
    before = F.try_element_at(words, (F.array_position(words, "name") - 1).cast("int"))
    of_person = (F.array_position(words, "name") > 1) & F.coalesce(before.isin(PERSONS), F.lit(False))
    return F.arrays_overlap(words, F.array(*map(F.lit, PERSONAL_WORDS))) | any_part(joined, PERSONAL_PARTS) | joined.isin(PERSON_NAMES) | of_person | any_part(c, PERSONAL_THAI)


def name_roles(k: DataFrame) -> DataFrame:
    """k (column, kind, min, max of profile.kinds) with role, unit, duration_unit, default_agg and is_personal: see column_roles."""
    c, kind, words = F.col("column"), F.col("kind"), name_words(F.col("column"))

    def has(english: list[str], thai: list[str] = ()) -> Column:
        return reduce(lambda a, b: a | b, [c.contains(t) for t in thai], F.arrays_overlap(words, F.array(*map(F.lit, english))))

    last = F.try_element_at(words, F.lit(-1))
    identifier = F.coalesce(last.isin(IDENTIFIERS) | (F.try_element_at(words, F.lit(1)) == "id") | (last.isin(CODES) & (kind != "categorical")), F.lit(False))
    role = F.when(identifier, "identifier").when(kind == "date", "time").when(kind == "numeric", "measure").when(kind == "categorical", "dimension").otherwise("text")
    first = F.get(F.filter(words, lambda w: w.isin(*DURATIONS)), F.lit(0))
    seconds = F.create_map(*[F.lit(x) for pair in DURATIONS.items() for x in pair])[first]
    percent = has(PERCENTS) & F.coalesce((F.col("min") >= 0) & (F.col("max") <= 100), F.lit(False))
    unit = F.when(percent, "percent").when(has(MONEY, MONEY_THAI), "currency").when(has(AGES, AGES_THAI), "number").when(has(COUNTS, COUNTS_THAI), "count").when(first.isNotNull(), "duration").otherwise("number")
    mean = (unit == "percent") | (unit == "duration") | ((unit == "number") & has(AGES, AGES_THAI))
    out = k.withColumn("role", role)
    measure = F.col("role") == "measure"
    return out.withColumns({"unit": F.when(measure, unit), "duration_unit": F.when(measure & (unit == "duration"), seconds), "default_agg": F.when(measure, F.when(mean, "avg").otherwise("sum")), "is_personal": is_personal(c)})


def column_roles(df: DataFrame) -> DataFrame:
    """What a column is for, by the words of its name and its kind: identifier, time, measure (unit, how it adds up by default), dimension or text, and whether it is personal.

    Words of percentages count only where all values are within 0 and 100.
    """
    return name_roles(profile.kinds(df)).select("column", "kind", "role", "unit", "duration_unit", "default_agg", "is_personal")


def health(df: DataFrame, keys: int | None = 2, gaps: int | None = 3, ranges: int | None = 2, ids: bool = False) -> DataFrame:
    """What a steward looks at first: the first few columns like keys, the emptiest ones, and extremes of the first few numbers that are no ids.

    None instead of a number takes every such column; with ids the extremes of
    numbers that are ids are given too.

    A column is like a key with 90 different values in 100 rows, unless it is a
    date or a number that is no id. A number is an id by its role
    (column_roles), or where its extremes are whole and have nine digits
    or more, or 90 in 100 of its values are different.
    """
    place = F.array_position(F.array(*map(F.lit, df.columns)), F.col("column"))
    p = written(name_roles(profile.kinds(df)).crossJoin(F.broadcast(df.agg(F.count("*").alias("rows")))).withColumn("place", place), "health")
    dense = (F.col("rows") > 0) & (F.col("n_distinct") >= 0.9 * F.col("rows"))
    whole = F.coalesce((F.col("min") == F.floor("min")) & (F.col("max") == F.floor("max")), F.lit(False))
    long = F.greatest(F.abs("min"), F.abs("max")) >= 1e8
    is_id = (F.col("role") == "identifier") | (whole & (long | dense))
    number = F.col("kind") == "numeric"

    def firsts(rows: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
        ordered = rows.orderBy(*order)
        return ordered if n is None else ordered.limit(n)

    key_like = firsts(p.filter((F.col("kind") != "date") & dense & (~number | is_id)), keys, "place").select("column", F.lit("key_like").alias("check"), (100.0 * F.col("n_distinct") / F.col("rows")).alias("value"))
    share = 100.0 * F.col("missing") / F.col("rows")
    empty = firsts(p.filter("missing > 0"), gaps, share.desc(), "place").select("column", F.lit("empty_pct").alias("check"), share.alias("value"))
    extremes = firsts(p.filter(number if ids else number & ~is_id), ranges, "place").select("column", F.explode(F.array(*[F.struct(F.lit(f"range_{k}").alias("check"), F.col(k).alias("value")) for k in ("min", "max")])).alias("r")).select("column", "r.check", "r.value")
    return key_like.union(empty).union(extremes).withColumn("value", F.round("value", 4))


#: What a reason points to, by what it contains: cause, suggested rule, confidence.
CAUSES = [
    ("missing_primary_key", "keys lost at the source", "null_check", 0.95),
    ("null_value", "fields left empty at the source", "fillna", 0.90),
    ("duplicate", "the source sends records again", "keep_latest", 0.92),
    ("outlier", "unit or typing errors", "auto_iqr", 0.80),
    ("zscore", "unit or typing errors", "zscore", 0.75),
    ("range", "values beyond what is possible", "range_check", 0.88),
    ("missing_date", "dates lost or in another form", "parse_timestamp", 0.85),
    ("type", "a column changed its type", "cast", 0.86),
]


#: Whom a ticket goes to and how pressing it is, by the rule that a cause calls for.
TICKETS = [
    (["keep_latest"], "Upstream Ingestion API / DB Exporter", "warning"),
    (["null_check", "fillna", "parse_timestamp"], "Upstream Source Database / API Schema Validator", "critical"),
    (["auto_iqr", "zscore", "range_check"], "Upstream Data Entry Client / CSV Producer", "warning"),
]


def root_cause(quarantine: DataFrame, history: DataFrame, settled: DataFrame, scores: DataFrame | None = None, top: int = 3) -> DataFrame:
    """The most frequent reasons of all rejected rows, their likely cause, the rule to add and the ticket to write.

    history (reason, n) of earlier runs raises the confidence of growing ones
    by 0.03. scores (current, average), a row of quality scores: a fall by over
    10 raises it by 0.05, a rise by over 5 lowers it by 0.10, to 0.98 at most
    and 0.50 at least. Rules that were decided on before (settled: rule) are
    left out.
    """
    counts = quarantine.select(F.explode(reasons_of(F.col("reject_reason"))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.orderBy(F.desc("n"), "reason"))  # over distinct reasons
    first = counts.withColumn("nth", nth).filter(F.col("nth") <= top).join(history.select("reason", F.col("n").alias("was")), "reason", "left")
    entry = F.coalesce(*[F.when(F.col("reason").contains(k), F.struct(F.lit(c).alias("cause"), F.lit(r).alias("rule"), F.lit(p).alias("base"))) for k, c, r, p in CAUSES], F.struct(F.lit("unknown").alias("cause"), F.lit("review").alias("rule"), F.lit(0.5).alias("base")))
    growing = F.when(F.col("n") > F.coalesce("was", F.lit(0)), 0.03).otherwise(0.0)
    moved = quarantine.sparkSession.range(1).select(F.lit(0.0).alias("delta")) if scores is None else scores.select((F.col("current") - F.col("average")).alias("delta"))
    base = F.least(F.col("e.base") + growing, F.lit(0.98))
    confidence = F.when(F.col("delta") < -10, F.least(base + 0.05, F.lit(0.98))).when(F.col("delta") > 5, F.greatest(base - 0.10, F.lit(0.50))).otherwise(base)
    trend = F.when(F.col("delta") < -10, "sharp decline").when(F.col("delta") < -5, "decline").when(F.col("delta") > 5, "improving").otherwise("steady")
    ticket = F.coalesce(*[F.when(F.col("e.rule").isin(rules), F.struct(F.lit(system).alias("system"), F.lit(severity).alias("severity"))) for rules, system, severity in TICKETS], F.struct(F.lit("Upstream Data Provider Exporter").alias("system"), F.lit("warning").alias("severity")))
    advised = first.withColumn("e", entry).crossJoin(F.broadcast(moved)).withColumn("t", ticket)
    return advised.select("reason", "n", "e.cause", "e.rule", F.round(confidence, 4).alias("confidence"), trend.alias("trend"), F.col("t.system").alias("ticket_system"), F.col("t.severity").alias("severity")).join(settled.select("rule").distinct(), "rule", "left_anti")


def from_drift(df: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    """Changes of rules that drift calls for: a wider fence where the distribution moved, a higher tolerance where nulls did.

    stored: column, boundaries, ema_null_rate. Confidence rises by 0.03 for
    each drift, by 0.10 and to 0.98 at most.
    """
    moved = drift.distribution(df, stored, columns).filter("status = 'CRITICAL'").select("column", F.lit("iqr_multiplier").alias("parameter"), F.lit(2.5).alias("value"))
    now = profile.null_profile(df.select(*columns), [])
    nulls = drift.null_rate(now, stored).filter("status in ('CRITICAL', 'NEW_NULLS')").select("column", F.lit("null_tolerance").alias("parameter"), F.round(F.least(1.5 * F.col("null_rate"), F.lit(0.30)), 6).alias("value"))
    both = moved.unionByName(nulls)
    n = both.agg(F.count("*").alias("n"))
    return both.crossJoin(F.broadcast(n)).select("column", "parameter", "value", F.round(F.least(F.lit(0.8) + F.least(0.03 * F.col("n"), F.lit(0.10)), F.lit(0.98)), 4).alias("confidence"))


def tree_rules(clean: DataFrame, quarantine: DataFrame, features: list[str], rows: int = 5000, depth: int = 4, leaf: int = 20, top: int = 5, seed: int = 7) -> tuple[list[str], float]:
    """SQL conditions of the paths of a decision tree that end in quarantine, shortest first, and the tree's AUC.

    The tree is fitted on up to `rows` rows of each class, those of the lowest
    hash, which bounds what it sees; paths come from the tree as Spark states it.
    """
    hashed = lambda d, y: d.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features], F.lit(y).alias("label")).orderBy(F.xxhash64(*features, F.lit(seed)), *features).limit(rows)
    data = VectorAssembler(inputCols=features, outputCol="v").transform(hashed(clean, 0.0).unionByName(hashed(quarantine, 1.0)))
    model = DecisionTreeClassifier(featuresCol="v", maxDepth=depth, minInstancesPerNode=leaf, seed=seed).fit(data)
    auc = BinaryClassificationEvaluator(rawPredictionCol="rawPrediction").evaluate(model.transform(data))
    return sorted(_paths(model.toDebugString, features), key=lambda p: (len(p), p))[:top], auc


def _paths(text: str, features: list[str]) -> list[str]:
    """Conditions of every path to a leaf that predicts 1, an else branch with its own negated test."""
    found, stack = [], []
    for line in text.splitlines()[1:]:
        level = len(line) - len(line.lstrip())
        stack = [s for s in stack if s[0] < level]
        body = line.strip()
        if body.startswith(("If (", "Else (")):
            _, name, sign, value = body[body.index("(") + 1 : -1].split()
            column = features[int(name)] if name.isdigit() else name
            stack.append((level, f"{column} {sign} {value}"))
        elif body.startswith("Predict: 1.0"):
            found.append(" AND ".join(s[1] for s in stack))
    return found
