"""Quality rules: robust multivariate outliers by minimum covariance determinant (native)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_tables, packed_row, quoted, source_key, table_mark, text_of, unpacked, written

SYMBOLS = "#*$%&|<>"
BLANK_LETTERS = " \t\n\x0b\x0c\r"
#: The transformed statistics that a text is judged by, and the least spread that each is taken to have.
FEATURES = {"word_length": 0.03, "symbols": 0.5, "dup_lines": 0.15, "repeats": 0.12}
#: Features are whole numbers of 1 / UNIT, so that their sums are exact and reruns agree.
UNIT = 1_000
#: Bins for each doubling of a squared distance, and the least and greatest bin.
BINS, LOWEST, HIGHEST = 64, -1280, 2560

_WORDS = r"filter(split(text, '[\\x20\\x09-\\x0D]+', -1), w -> w <> '')"
# Hashes of all windows of 8 words: of pairs of words, of pairs of these two places on, of pairs of those four places on.
_WINDOWS = """if(size(ws) < 8, array(), transform(array(transform(ws, w -> xxhash64(w))),
    h1 -> transform(array(zip_with(h1, slice(h1, 2, size(h1)), (a, b) -> xxhash64(a, b))),
    h2 -> transform(array(zip_with(h2, slice(h2, 3, size(h2)), (a, b) -> xxhash64(a, b))),
    h4 -> slice(zip_with(h4, slice(h4, 5, size(h4)), (a, b) -> xxhash64(a, b)), 1, size(ws) - 7))[0])[0])[0])"""
# Positions of windows whose hash another window has too: neighbours in sorted order.
_TWICE = """transform(array(sort_array(transform(hs, (h, i) -> named_struct('h', h, 'i', i)))), s -> sort_array(transform(
    filter(s, (x, k) -> coalesce(get(s, k - 1).h = x.h, false) or coalesce(get(s, k + 1).h = x.h, false)), x -> x.i)))[0]"""
_COVERED = f"aggregate({_TWICE}, named_struct('last', -8, 'sum', 0), (a, x) -> named_struct('last', x, 'sum', a.sum + least(8, x - a.last)), a -> a.sum)"
_WORD_STATISTICS = f"""transform(array({_WORDS}), ws -> named_struct('n_words', size(ws), 'n_repeat_words',
    transform(array({_WINDOWS}), hs -> if(size(array_distinct(hs)) = size(hs), 0, {_COVERED}))[0]))[0]"""
_LINE_STATISTICS = r"""transform(array(filter(split(text, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')),
    ls -> named_struct('n_lines', size(ls), 'n_dup_lines', size(ls) - size(array_distinct(ls))))[0]"""


def text_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row, stats): every row of docs (or its columns in keep) as a struct, and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, all long.

    Null texts count as empty. One pass over whole texts, without a shuffle.
    """
    inner = docs.select(packed_row(docs, columns=keep), text_of(text_col).alias("text"))
    counted = inner.select("row", "text", F.expr(_WORD_STATISTICS).alias("of_words"), F.expr(_LINE_STATISTICS).alias("of_lines"))
    numbers = {
        "n_words": F.col("of_words.n_words"),
        "word_chars": F.char_length(F.translate("text", BLANK_LETTERS, "")),
        "n_symbols": F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, "")),
        "n_lines": F.col("of_lines.n_lines"),
        "n_dup_lines": F.col("of_lines.n_dup_lines"),
        "n_repeat_words": F.col("of_words.n_repeat_words"),
    }
    return counted.select("row", F.struct(*[c.cast("long").alias(k) for k, c in numbers.items()]).alias("stats"))


def base_failed(stats: str = "stats") -> Column:
    """Too few words, or too many of them in repeated windows."""
    n, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < 20) | (100 * repeated > 30 * n)


def feature_vector(stats: str = "stats") -> dict[str, Column]:
    """The features as whole numbers of 1 / UNIT: log mean word length, log symbols per 100 words, shares of repeated lines and words."""
    n = F.greatest(F.col(f"{stats}.n_words"), F.lit(1))
    lines = F.greatest(F.col(f"{stats}.n_lines"), F.lit(1))
    values = {
        "word_length": F.log(F.greatest(F.col(f"{stats}.word_chars"), F.lit(1)) / n),
        "symbols": F.log1p(100 * F.col(f"{stats}.n_symbols") / n),
        "dup_lines": F.col(f"{stats}.n_dup_lines") / lines,
        "repeats": F.col(f"{stats}.n_repeat_words") / n,
    }
    return {k: F.floor(c * UNIT + 0.5).cast("long") for k, c in values.items()}


def _chi_square_tail(p: int, x: float) -> float:
    """Chance that a chi-square number of p (even) degrees is over x."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi_square_cut(p: int, tail: float) -> float:
    """What a chi-square number of p (even) degrees is over with chance `tail`."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square_tail(p, mid) > tail else (low, mid)
    return low


def chi_square_consistency(p: int, share: float) -> float:
    """What the scatter of the nearest `share` of normal data must be multiplied by."""
    return share / (1 - _chi_square_tail(p + 2, chi_square_cut(p, 1 - share)))


def squared_distance(features: list[Column], centre: list[Column], root: dict[tuple[int, int], Column]) -> Column:
    """Mahalanobis distance squared by forward substitution with a Cholesky root; features in units of 1 / UNIT."""
    y: list[Column] = []
    for i, (x, m) in enumerate(zip(features, centre, strict=True)):
        left = x / UNIT - m
        for k in range(i):
            left = left - root[i, k] * y[k]
        y.append(left / root[i, i])
    total = F.lit(0.0)
    for c in y:
        total = total + c * c
    return total


def feature_counts(rows: DataFrame) -> DataFrame:
    """(group, features, n): how many texts of each group have a vector of features, from (lang_key, source_key, features).

    A text counts in three groups: its language and source, its language, all.
    Everything that follows works on these counts, which partial sums make
    before any shuffle: different vectors are far fewer than texts.
    """
    names = list(FEATURES)
    own = rows.groupBy("lang_key", "source_key", *names).agg(F.count("*").alias("n"))
    groups = F.array(F.concat_ws("\x1f", F.lit("2"), "lang_key", "source_key"), F.concat_ws("\x1f", F.lit("1"), "lang_key"), F.lit("0"))
    return own.select(F.explode(groups).alias("group"), *names, "n").groupBy("group", *names).agg(F.sum("n").alias("n"))


def _middle(counts: DataFrame, names: list[str]) -> DataFrame:
    """Exact medians (the lower of two) of every group and feature.

    The window's rows are the different values of one feature, which its range
    bounds: features are whole numbers of 1 / UNIT.
    """
    across = Window.partitionBy("group", "feature")
    values = counts.select("group", "n", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("feature", "value"))
    per = values.groupBy("group", "feature", "value").agg(F.sum("n").alias("n"))
    marked = per.withColumn("upto", F.sum("n").over(across.orderBy("value"))).withColumn("all", F.sum("n").over(across))
    found = marked.filter(2 * F.col("upto") >= F.col("all")).groupBy("group", "feature").agg(F.min("value").alias("middle"))
    return found.groupBy("group").pivot("feature", names).agg(F.first("middle"))


def _with_root(scatter: DataFrame) -> DataFrame:
    """Adds the Cholesky root r00, r10, r11.. of the scatter v00.., and the root of its determinant."""
    floors = list(FEATURES.values())
    p = len(floors)
    for i in range(p):
        for k in range(i + 1):
            left = F.col(f"v{i}{k}")
            for j in range(k):
                left = left - F.col(f"r{i}{j}") * F.col(f"r{k}{j}")
            scatter = scatter.withColumn(f"r{i}{k}", F.sqrt(F.greatest(left, F.lit(floors[i] ** 2))) if i == k else left / F.col(f"r{k}{k}"))
    root = F.col("r00")
    for i in range(1, p):
        root = root * F.col(f"r{i}{i}")
    return scatter.select("group", "start", "n", *[f"m{i}" for i in range(p)], *[f"r{i}{k}" for i in range(p) for k in range(i + 1)], root.alias("volume"))


def first_estimates(counts: DataFrame) -> DataFrame:
    """Deterministic starts of every group: (group, start, n, centre m0.., scatter v00..).

    All have the medians as centre and median absolute deviations as spreads.
    They differ in the correlations, which stem from: 0 none; 1 deviations z
    in spreads, bounded by z / sqrt(1 + z^2); 2 directions z / |z|; 3 signs.
    Sums are of millionths as whole numbers, so that no order of rows changes them.
    """
    names = list(FEATURES)
    p = len(names)
    pairs = [(i, k) for i in range(p) for k in range(i + 1)]
    medians = written(_middle(counts, names), "mcd-medians", files=8)
    centred = medians.select("group", *[F.col(n).alias(f"c{i}") for i, n in enumerate(names)])
    away = counts.join(centred, "group").select("group", "n", *[F.abs(F.col(n) - F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])
    spreads = _middle(away, names).select("group", *[F.greatest(1.4826 * F.col(n) / UNIT, F.lit(FEATURES[n])).alias(f"s{i}") for i, n in enumerate(names)])
    frame = written(centred.join(spreads, "group"), "mcd-spreads", files=8)
    z = counts.join(frame, "group").select("group", "n", *[((F.col(n) - F.col(f"c{i}")) / UNIT / F.col(f"s{i}")).alias(f"z{i}") for i, n in enumerate(names)])
    square = F.col("z0") * F.col("z0")
    for i in range(1, p):
        square = square + F.col(f"z{i}") * F.col(f"z{i}")
    z = z.withColumn("far", F.sqrt(square))
    forms = {
        1: lambda i: F.col(f"z{i}") / F.sqrt(1 + F.col(f"z{i}") * F.col(f"z{i}")),
        2: lambda i: F.when(F.col("far") > 0, F.col(f"z{i}") / F.col("far")).otherwise(0.0),
        3: lambda i: F.signum(f"z{i}"),
    }
    bounded = z.select("group", "n", *[f(i).alias(f"b{t}{i}") for t, f in forms.items() for i in range(p)])
    sums = bounded.groupBy("group").agg(*[F.sum(F.col("n") * F.floor(F.col(f"b{t}{i}") * F.col(f"b{t}{k}") * 1e6 + 0.5)).cast("double").alias(f"p{t}{i}{k}") for t in forms for i, k in pairs])
    both = frame.join(sums, "group")

    def scatter(t: int, i: int, k: int) -> Column:
        if i == k:
            return F.col(f"s{i}") * F.col(f"s{i}")
        if t == 0:
            return F.lit(0.0)
        size = F.sqrt(F.col(f"p{t}{i}{i}") * F.col(f"p{t}{k}{k}"))
        return F.when(size > 0, F.col(f"p{t}{i}{k}") / size).otherwise(0.0) * F.col(f"s{i}") * F.col(f"s{k}")

    starts = F.array(*[F.struct(F.lit(t).alias("start"), *[scatter(t, i, k).alias(f"v{i}{k}") for i, k in pairs]) for t in (0, *forms)])
    return both.select("group", F.lit(0).cast("long").alias("n"), *[(F.col(f"c{i}") / UNIT).alias(f"m{i}") for i in range(p)], F.explode(starts).alias("x")).select("group", "x.start", "n", *[f"m{i}" for i in range(p)], *[f"x.v{i}{k}" for i, k in pairs])


def robust_scatter(rows: DataFrame, share: float = 0.75, steps: int = 10) -> DataFrame:
    """Minimum-covariance-determinant estimates of each group from (lang_key, source_key, features).

    Five deterministic starts: the four of first_estimates, and the mean and
    scatter of the half that is nearest under the first of them. From each,
    concentration steps: take the `share` of a group that is nearest under the
    present estimate and estimate anew from it, until no determinant changes,
    or `steps` times. Of the five the estimate with the least determinant is
    kept, of equals that of the first start.

    Nearest rows come from exact counts over bins of the distance (whole bins,
    64 to a doubling, so that `share` is met from above and a step can raise a
    determinant by a bin's worth), in one aggregation that also has the sums of
    every bin; sums are of whole numbers, so that no order of rows changes
    them. A scatter gets the factor that makes it consistent for normal data,
    and the squares of the least spreads on its diagonal.

    Returns group, n, m0.. (centre) and r00, r10, r11.. (Cholesky root).
    """
    counts = written(feature_counts(rows), "mcd-counts")
    first = written(_with_root(first_estimates(counts)), "mcd-start", files=8)
    half = _concentrated(counts, first.filter("start = 0"), 0.5).withColumn("start", F.lit(len(FEATURES)))
    model = written(first.unionByName(half), "mcd-start", files=8)
    for step in range(steps):
        last, model = model, written(_concentrated(counts, model, share), f"mcd-{step}", files=8)
        if step % 2 == 0:  # an estimate that has settled stays as it is
            continue
        moved = model.join(last.select("group", "start", F.col("volume").alias("before")), ["group", "start"]).filter(F.col("volume") != F.col("before"))
        if moved.isEmpty():
            break
    columns = [c for c in model.columns if c not in ("group", "start", "volume")]
    return written(model.groupBy("group").agg(F.min_by(F.struct(*columns), F.struct("volume", "start")).alias("best")).select("group", "best.*"), "mcd-best", files=8)


def _concentrated(counts: DataFrame, model: DataFrame, share: float) -> DataFrame:
    """One concentration step of every group and start."""
    names = list(FEATURES)
    p = len(names)
    pairs = [(i, k) for i in range(p) for k in range(i + 1)]
    factor = chi_square_consistency(p, share)
    distance = squared_distance([F.col(n) for n in names], [F.col(f"m{i}") for i in range(p)], {(i, k): F.col(f"r{i}{k}") for i, k in pairs})
    near = F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.floor(BINS * F.log2(distance + 1e-6)))).cast("int")
    # A product fits in 40 bits; its two halves are summed apart, so that longs hold the sums of any number of texts.
    products = {f"q{i}{k}": F.col(names[i]) * F.col(names[k]) for i, k in pairs}
    sums = {f"s{i}": F.col("n") * F.col(n) for i, n in enumerate(names)}
    sums |= {f"{k}h": F.col("n") * F.shiftright(c, 20) for k, c in products.items()} | {f"{k}l": F.col("n") * c.bitwiseAND(F.lit((1 << 20) - 1)) for k, c in products.items()}
    binned = counts.join(model.drop("n", "volume"), "group").groupBy("group", "start", near.alias("bin")).agg(F.sum("n").alias("n"), *[F.sum(c).alias(k) for k, c in sums.items()])
    across = Window.partitionBy("group", "start")
    kept = binned.withColumn("before", F.sum("n").over(across.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(across)).filter(F.col("before") < share * F.col("all"))
    total = kept.groupBy("group", "start").agg(F.max("all").alias("n"), F.sum("n").cast("double").alias("h"), *[F.sum(k).alias(k) for k in sums])
    whole = {f"s{i}": F.col(f"s{i}").cast("double") for i in range(p)} | {k: (F.col(f"{k}h").cast("decimal(38,0)") * (1 << 20) + F.col(f"{k}l")).cast("double") for k in products}
    centred = total.select("group", "start", "n", "h", *[(whole[f"s{i}"] / F.col("h") / UNIT).alias(f"m{i}") for i in range(p)], *[c.alias(k) for k, c in whole.items() if k[0] == "q"])
    scatter = centred.select(
        "group", "start", "n", *[f"m{i}" for i in range(p)],
        *[((F.col(f"q{i}{k}") / F.col("h") / UNIT**2 - F.col(f"m{i}") * F.col(f"m{k}")) * factor + (FEATURES[names[i]] ** 2 if i == k else 0.0)).alias(f"v{i}{k}") for i, k in pairs],
    )
    return _with_root(scatter)


def group_models(rows: DataFrame, least_rows: int = 100, **fit) -> DataFrame:
    """The estimates for every pair of language and source: those of the pair if it has least_rows texts, else of the language, else of all."""
    model = robust_scatter(rows, **fit)
    columns = [c for c in model.columns if c not in ("group", "n")]
    pairs = rows.select("lang_key", "source_key").distinct()
    own = pairs.select("*", F.posexplode(F.array(F.concat_ws("\x1f", F.lit("2"), "lang_key", "source_key"), F.concat_ws("\x1f", F.lit("1"), "lang_key"), F.lit("0"))).alias("rank", "group"))
    fitting = own.join(model, "group").filter((F.col("n") >= least_rows) | (F.col("rank") == 2))
    best = fitting.groupBy("lang_key", "source_key").agg(F.min_by(F.struct(*columns), "rank").alias("b"))
    return written(best.select("lang_key", "source_key", "b.*"), "mcd-models", files=8)


def _judged(docs: DataFrame, keep: list[str], tail: float, least_rows: int, text_col: str, lang_col: str, source_col: str, **fit) -> DataFrame:
    """(row, stats, base_failed, distance, kept) of every row of docs, row with the columns in keep; statistics are written, and read again for the verdicts."""
    names, p = list(FEATURES), len(FEATURES)
    mark = table_mark()
    counted = text_statistics(docs, text_col, keep)
    keys = [source_key(f"row.{quoted(c)}", parsed=True).alias(k) for c, k in ((lang_col, "lang_key"), (source_col, "source_key"))]
    rows = written(counted.select("row", "stats", *keys, base_failed().alias("base_failed"), *[c.alias(k) for k, c in feature_vector().items()]), "quality-rows")
    models = group_models(rows.filter(~F.col("base_failed")), least_rows, **fit)
    drop_tables(docs.sparkSession, mark, (rows, models))
    distance = squared_distance([F.col(n) for n in names], [F.col(f"m{i}") for i in range(p)], {(i, k): F.col(f"r{i}{k}") for i in range(p) for k in range(i + 1)})
    judged = rows.join(models, ["lang_key", "source_key"], "left").withColumn("distance", distance)
    # One expression, so that no part of it is moved below and computed again there.
    return judged.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(F.col("distance") <= chi_square_cut(p, tail), F.lit(True))))


def quality_rules(docs: DataFrame, tail: float = 1e-5, least_rows: int = 100, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **fit) -> DataFrame:
    """Judges every text by counts and by its distance from texts of its language and source.

    Texts that fail the base rules are rejected and take no part in the
    estimates. Any other is rejected if its squared Mahalanobis distance from
    the estimate of its group (group_models) is one that a normal text exceeds
    with chance `tail`. Returns doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, distance, kept: a row for every
    row. Null texts are empty and fail; null languages and sources are groups
    of their own; an empty table gives no rows; repeated rows are judged alike.
    """
    judged = _judged(docs, [id_col, lang_col, source_col], tail, least_rows, text_col, lang_col, source_col, **fit)
    return judged.select(F.col(f"row.{quoted(id_col)}").alias("doc_id"), *[f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "distance", "kept")


def kept_documents(docs: DataFrame, tail: float = 1e-5, least_rows: int = 100, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **fit) -> DataFrame:
    """The rows of docs that quality_rules keeps, columns as they are, whatever their names.

    Null and empty texts, and any of under 20 words, go; rows alike in text,
    language and source share a verdict; ids are not looked at; an empty table
    gives none. Rows are written once with their statistics, so that these are
    computed once, and no text is shuffled.
    """
    return _judged(docs, docs.columns, tail, least_rows, text_col, lang_col, source_col, **fit).filter("kept").select(*unpacked(docs.columns))
