"""URL filters: host rules, then gradient-boosted trees on lexical features (native)."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, quoted, seeded_key, written

#: Parts of the labelled rows by host: a row's suffix statistics come from the other parts, so that no label describes itself.
FOLDS = 5
#: Labelled rows that the trees are fitted on, at most: those of the lowest seeded keys.
FIT_ROWS = 200_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no '://'."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(u, r"://([^/?#]*)", 1)), F.regexp_extract(u, r"://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null.

    A rule ('block', 'example.com/en/') fits its host and all subdomains where
    the path starts with the rule's. Of rules of one length the first holds.
    """
    held = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        out = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        held = F.when(fits, out) if held is None else held.when(fits, out)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if held is None else held


def lexical_features(url: str, host: str, path: str) -> dict[str, Column]:
    """Numbers that describe how a URL is written."""
    u, h, p = F.coalesce(F.col(url).cast("string"), F.lit("")), F.col(host), F.col(path)
    n = F.greatest(F.length(u), F.lit(1))
    letters = F.split(u, "")
    shares = F.transform(F.array_distinct(letters), lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))) / n)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    suffix = F.substring_index(h, ".", -1)
    return {
        "length": F.length(u),
        "host_length": F.length(h),
        "host_depth": F.length(h) - F.length(F.replace(h, F.lit("."), F.lit(""))),
        "path_length": F.length(p),
        "path_depth": F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))),
        "digit_ratio": (F.length(u) - F.length(F.translate(u, "0123456789", ""))) / n,
        "hyphens": F.length(h) - F.length(F.replace(h, F.lit("-"), F.lit(""))),
        "entropy": F.aggregate(shares, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.log2(x)).otherwise(0.0)),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "fragment": u.contains("#").cast("int"),
        "secure": u.startswith("https:").cast("int"),
        "suffix_length": F.length(suffix),
    }


def _suffix(host: str) -> Column:
    return F.substring_index(host, ".", -1)


def _fold(host: str) -> Column:
    return F.pmod(F.xxhash64(host, F.lit(11)), F.lit(FOLDS)).cast("int")


def suffix_statistics(labelled: DataFrame, host: str, label: str) -> DataFrame:
    """(suffix, by_part): for every last label of a host the labelled rows, and the blocked ones, in each of the FOLDS parts."""
    parts = [F.struct(F.count(F.when(F.col("fold") == k, 1)).alias("n"), F.coalesce(F.sum(F.when(F.col("fold") == k, F.col(label))), F.lit(0)).alias("blocked")) for k in range(FOLDS)]
    return labelled.withColumn("fold", _fold(host)).groupBy(_suffix(host).alias("suffix")).agg(F.array(*parts).alias("by_part"))


def _featured(urls: DataFrame, statistics: DataFrame, out_of_fold: bool, leave_out: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """urls and their features f_..; out_of_fold: statistics of a row's suffix without the part that its host is in, as for labelled rows."""
    own = lexical_features("url", "host", "path")
    joined = urls.withColumns({"suffix": _suffix("host"), "fold": _fold("host") if out_of_fold else F.lit(-1)}).join(statistics, "suffix", "left")
    sums = {k: F.expr(f"aggregate(transform(by_part, (x, k) -> if(k = fold, 0L, x.{k})), 0L, (s, x) -> s + x)") for k in ("n", "blocked")}
    n, blocked = (F.coalesce(c, F.lit(0)) for c in sums.values())
    columns = {**own, "suffix_rows": F.log1p(n), "suffix_share": (blocked + 1) / (n + 2)}
    kept = {k: c for k, c in columns.items() if k not in leave_out}
    return joined.select(*urls.columns, *[c.cast("double").alias(f"f_{k}") for k, c in kept.items()]), [f"f_{k}" for k in kept]


def fit_url_trees(labelled: DataFrame, fit_rows: int = FIT_ROWS, trees: int = 10, depth: int = 3, seed: int = 5, leave_out: tuple[str, ...] = ()) -> tuple[GBTClassificationModel | None, DataFrame]:
    """Boosted trees and suffix statistics from (url, host, path, label), label 1 for blocked.

    The trees see at most fit_rows rows, both labels with equal weight in all;
    suffix statistics come from all rows, and for a row that the trees see from
    the rows of other hosts. leave_out: features to do without. With one label
    alone there is nothing to part and the model is None.
    """
    statistics = written(suffix_statistics(labelled, "host", "label"), "suffix-statistics", files=8)
    n, blocked = statistics.select(F.inline("by_part")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("blocked"), F.lit(0))).first()
    if blocked in (0, n):
        return None, statistics
    if n > fit_rows:
        labelled = labelled.orderBy(seeded_key(seed, F.col("url")), "url").limit(fit_rows)
    rows, names = _featured(labelled, statistics, True, leave_out)
    weight = F.when(F.col("label") == 1, 1 / blocked).otherwise(1 / (n - blocked)) * n
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", weight.alias("weight"), F.col("label").cast("double").alias("label"))
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.2, weightCol="weight", minWeightFractionPerNode=0.005).fit(vectors), statistics


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url", **fit) -> DataFrame:
    """Allows or blocks every URL: by the longest rule that fits, else by the boosted trees.

    labelled: rows (url, label) with label 1 for URLs to block; by default the
    URLs that a rule decides are the labelled ones. Where these have one label
    alone, all other URLs get that verdict; where there are none, 'allow'. Null
    URLs count as empty. Returns id, host, path, rule, verdict, score (the
    trees' chance that a URL is to be blocked; null where a rule decides or
    there are no trees), a row for every row of pages; an empty table gives
    none.
    """
    host, path = url_parts(F.col(quoted(url_col)))
    rows = pages.select(F.col(quoted(id_col)).alias("page_id"), F.coalesce(F.col(quoted(url_col)).cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    ruled = rows.withColumn("held", fitting_rule(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = ruled.filter("held is not null").select("url", "host", "path", (F.col("held.verdict") == "block").cast("int").alias("label"))
    else:
        h, p = url_parts(F.col("url"))
        known = labelled.filter("label is not null").select(F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), h.alias("host"), p.alias("path"), F.col("label").cast("int").alias("label"))
    model, statistics = fit_url_trees(known, **fit)
    if model is None:
        only = F.lit((known.agg(F.max("label")).first()[0] or 0) == 1)
        scored = ruled.withColumn("score", F.lit(None).cast("double"))
    else:
        only = F.col("score") >= threshold
        featured, names = _featured(ruled, F.broadcast(statistics) if statistics.count() <= 10_000 else statistics, False, fit.get("leave_out", ()))
        vectors = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(featured)
        scored = model.transform(vectors).withColumn("score", F.when(F.col("held").isNull(), vector_to_array("probability")[1]))
    return scored.select("page_id", "host", "path", F.col("held.rule").alias("rule"), F.coalesce("held.verdict", F.when(only, "block").otherwise("allow")).alias("verdict"), "score")
