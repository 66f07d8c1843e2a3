"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Every text gets counts, and base rules on them. Texts that pass are judged by a vector of transformed statistics
(log words, log mean word length, logs of symbols, repeated lines and repeated words per 100 words) against a
minimum-covariance-determinant estimate of their language and source. Three deterministic starts are taken (coordinate-wise medians
with quartile scales; the correlations of tanh of the standardised rows; those of their spatial signs), each is improved by C_STEPS concentration
steps, which refit centre and covariance on the SUBSET share of the rows nearest under the last fit and never raise the determinant, and the start
with the smallest determinant wins. A row is rejected when its squared Mahalanobis distance under that fit is over CUTOFF.

The covariance is regularised by a diagonal target (FLOORS squared is added to the variances): most texts have no symbol at all, and a
determinant of zero would make a single one an outlier. Determinants are compared with it. Groups of fewer than LEAST_ROWS
passing rows share one pooled estimate.

All group statistics are partial aggregates (sums and mergeable quantile sketches), so a group with a third of all rows
is reduced before the shuffle. The estimates, one row a language and source, are broadcast only if they are at
most BROADCAST_GROUPS, else joined by shuffle.

Results for special input: a null or empty text has no words and fails the base rule; null language or source is
a group of its own; equal rows get equal verdicts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textkit import discard, workspace, written

LEAST_WORDS, REPEAT_PERCENT = 10, 20
SUBSET, C_STEPS = 0.75, 3
#: Makes the covariance of the nearest 75 % of a 5-dimensional normal sample consistent.
CONSISTENCY = 1.41
#: Upper 2e-8 quantile of chi-square with 5 degrees of freedom.
CUTOFF = 44.0
FLOORS = (0.6, 0.25, 0.5, 0.6, 0.6)
LEAST_ROWS, BROADCAST_GROUPS = 50, 20_000
DIMENSIONS = len(FLOORS)
_WINDOW = 5


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words within a window of 5 that occurs twice or more in the array."""

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(_WINDOW), F.coalesce(F.get(places, i + 1), p + _WINDOW) - p))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)

    def repeated(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))
            return _let(F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"])), covered)

        return F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0).cast("long")).otherwise(_let(ranked, twice))

    def windows(hashes: Column) -> Column:
        heads = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (_WINDOW - 1), F.lit(0)))
        return F.transform(heads, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, _WINDOW)]))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _let(hashes, lambda h: _let(windows(h), repeated))


def text_statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of every whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, "[ \\t-\\r]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    counts = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    dup = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    out = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), counts.alias("c"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), dup.alias("n_dup_lines"))
    out = out.select("doc_id", "lang", "source", "c.n_words", "c.word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")
    return out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    rates = [F.log1p(100 * F.col(c) / n) for c in ("n_symbols", "n_dup_lines", "n_repeat_words")]
    return [F.log1p(F.col("n_words").cast("double")), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), *rates]


def _inverse(matrix: Column) -> Column:
    """(p, ld) of a positive definite matrix as a flat array: its inverse, by Gauss-Jordan steps, and the logarithm of its determinant."""
    n = DIMENSIONS

    def step(s: Column, k: Column) -> Column:
        a = s["p"]
        at = lambda i, j: F.get(a, (i * n + j).cast("int"))
        pivot = F.greatest(at(k, k), F.lit(1e-12))

        def entry(e: Column) -> Column:
            i, j = F.floor(e / n).cast("int"), e % n
            return F.when((i == k) & (j == k), 1 / pivot).when(i == k, at(k, j) / pivot).when(j == k, -at(i, k) / pivot).otherwise(at(i, j) - at(i, k) * at(k, j) / pivot)

        return F.struct(F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), entry).alias("p"), (s["ld"] + F.log(pivot)).alias("ld"))

    start = F.struct(matrix.alias("p"), F.lit(0.0).alias("ld"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, step)


def _fit(groups: DataFrame, centre: list[Column], cov) -> DataFrame:
    """(gl, gs, start, m, p, ld) from columns of ``groups``; ``cov(i, j)`` for i >= j."""
    flat = F.array(*[cov(max(i, j), min(i, j)) for i in range(DIMENSIONS) for j in range(DIMENSIONS)])
    out = groups.select("gl", "gs", "start", F.array(*centre).alias("m"), flat.alias("c")).withColumn("i", _inverse(F.col("c")))
    return out.select("gl", "gs", "start", "m", F.col("i.p").alias("p"), F.col("i.ld").alias("ld"))


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from the centre m with the inverse p."""
    y = [F.col(f"x{i}") - F.get("m", F.lit(i)) for i in range(DIMENSIONS)]
    total = F.lit(0.0)
    for i in range(DIMENSIONS):
        row = F.get("p", F.lit(i * DIMENSIONS + i)) * y[i]
        for j in range(i):
            row = row + 2 * F.get("p", F.lit(i * DIMENSIONS + j)) * y[j]
        total = total + row * y[i]
    return total


def _with_fit(rows: DataFrame, fit: DataFrame, groups: int, *also: str, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(fit) if groups <= BROADCAST_GROUPS else fit, ["gl", "gs", *also], how)


def _starts(rows: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """The three first fits of each group, and the number of groups."""
    xs, dims = [f"x{i}" for i in range(DIMENSIONS)], range(DIMENSIONS)
    told = rows.groupBy("gl", "gs").agg(*[F.percentile_approx(x, [0.25, 0.5, 0.75], 2000).alias(x) for x in xs])
    scale = lambda x, i: F.sqrt(F.pow((F.get(x, F.lit(2)) - F.get(x, F.lit(0))) / 1.349, 2) + FLOORS[i] ** 2)
    told = written(told.select("gl", "gs", F.array(*[F.get(x, F.lit(1)) for x in xs]).alias("m"), F.array(*[scale(x, i) for i, x in enumerate(xs)]).alias("d")), folder, "medians")
    groups = told.count()
    z = _with_fit(rows, told, groups).select("gl", "gs", *[((F.col(x) - F.get("m", F.lit(i))) / F.get("d", F.lit(i))).alias(f"z{i}") for i, x in enumerate(xs)])
    norm = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in dims[1:]), F.col("z0") * F.col("z0"))
    z = z.withColumn("r", F.greatest(norm, F.lit(1e-12))).withColumns({f"t{i}": F.tanh(f"z{i}") for i in dims})
    tanh = [F.avg(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"t{i}{j}") for i in dims for j in range(i + 1)]
    sign = [F.avg(F.col(f"z{i}") * F.col(f"z{j}") / F.col("r")).alias(f"s{i}{j}") for i in dims for j in range(i + 1)]
    both = _with_fit(z.groupBy("gl", "gs").agg(*tanh, *sign), told, groups)
    centre, out = [F.get("m", F.lit(i)) for i in dims], None
    for k, name in enumerate(("", "t", "s")):

        def cov(i: int, j: int, name=name) -> Column:
            scales = F.get("d", F.lit(i)) * F.get("d", F.lit(j))
            if i == j:
                return scales
            if not name:
                return F.lit(0.0)
            own = F.sqrt(F.greatest(F.col(f"{name}{i}{i}") * F.col(f"{name}{j}{j}"), F.lit(1e-12)))
            return scales * 0.95 * F.col(f"{name}{i}{j}") / own  # correlations a little under their bound

        one = _fit(both.withColumn("start", F.lit(k)), centre, cov)
        out = one if out is None else out.union(one)
    return written(out, folder, "fit-0"), groups


def fit_groups(rows: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """MCD fit (gl, gs, m, p, ld) of each group of ``rows`` (gl, gs, x0..), and the number of groups."""
    dims = range(DIMENSIONS)
    fit, groups = _starts(rows, folder)
    for step in range(1, C_STEPS + 1):
        far = _with_fit(rows, fit, groups).withColumn("d", _distance())
        border = written(far.groupBy("gl", "gs", "start").agg(F.percentile_approx("d", SUBSET, 5000).alias("q")), folder, f"border-{step}")
        near = _with_fit(far, border, groups, "start").where("d <= q")
        y = [F.col(f"x{i}") - F.get("m", F.lit(i)) for i in dims]  # about the last centre, for exact sums
        sums = [F.avg(y[i]).alias(f"s{i}") for i in dims] + [F.avg(y[i] * y[j]).alias(f"p{i}{j}") for i in dims for j in range(i + 1)]
        moments = near.groupBy("gl", "gs", "start").agg(F.first("m").alias("m"), *sums)
        cov = lambda i, j: CONSISTENCY * (F.col(f"p{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}")) + (FLOORS[i] ** 2 if i == j else 0.0)
        fit = written(_fit(moments, [F.get("m", F.lit(i)) + F.col(f"s{i}") for i in dims], cov), folder, f"fit-{step}")
    best = fit.groupBy("gl", "gs").agg(F.min_by(F.struct("m", "p", "ld"), F.struct("ld", "start")).alias("b"))
    best = written(best.select("gl", "gs", "b.*"), folder, "fit")
    discard(rows.sparkSession, f"{folder}/medians", *[f"{folder}/{x}-{k}" for k in range(C_STEPS + 1) for x in ("border", "fit")])
    return best, groups


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", folder: str | None = None) -> DataFrame:
    """The statistics of every row with ``distance`` (null where the base rules fail) and ``kept``."""
    folder = folder or workspace(df.sparkSession)
    # texts are read once; what follows works on the numbers
    stats = written(text_statistics(df, id_col, text_col, lang_col, source_col), folder, "statistics")
    passing = stats.where("not base_failed")
    large = written(passing.groupBy("lang", "source").count().where(F.col("count") >= LEAST_ROWS).select(F.col("lang").alias("ll"), F.col("source").alias("ls"), F.lit(True).alias("own")), folder, "groups")
    groups = large.count()
    same = F.col("lang").eqNullSafe(F.col("ll")) & F.col("source").eqNullSafe(F.col("ls"))
    placed = stats.join(F.broadcast(large) if groups <= BROADCAST_GROUPS else large, same, "left")
    own = F.coalesce("own", F.lit(False))
    name = lambda c: F.when(own, F.concat(F.lit("="), F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")))).otherwise("*")
    placed = placed.withColumns({"gl": name("lang"), "gs": name("source"), **{f"x{i}": v for i, v in enumerate(_vector())}})
    fit, groups = fit_groups(placed.where("not base_failed").select("gl", "gs", *[f"x{i}" for i in range(DIMENSIONS)]), folder)
    told = _with_fit(placed, fit, groups, how="left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return told.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
