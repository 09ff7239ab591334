"""Quality rules: base statistics of each text, and robust multivariate outliers by minimum-covariance-determinant estimates.

DataFrame functions only. The statistic vector of a text (see PARTS) is kept as scaled integers, so that sums, and with them every
decision, are the same in whatever order rows arrive. Vectors alike are counted once, and estimates are found from these cells:

1. For each language and source, each language, and the whole corpus, three starts take the half of the rows nearest a centre: by
   the sum of squares and by the greatest of the parts' distances from their medians in quartile ranges, and by classical covariance.
2. Concentration steps take the half of the rows nearest the last estimate, as long as the determinant falls. The start that ends with the
   least determinant counts; its estimate is reweighed once.
3. A group's estimate is drawn towards its language's, and that towards the corpus's, as if PRIOR_ROWS rows came from there.
4. A text is judged by its Mahalanobis distance. To the covariance its own uncertainty is added: a share of few words or lines is
   known less well than one of many (the variance of a count is the count).

A covariance is floored at the variance of rounding only.

Defined results: a null or empty text has no words and fails the base rule; languages and sources may be null, and a null is a
group of its own; a group of few rows, or of rows all alike, is judged by its language's and the corpus's estimates too; repeated rows
stand as rows of their own and are judged alike; a very long text is one row of words and windows, in memory some fifty times its
size; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, row_keys, stored

#: Parts of the vector: logarithm of the mean word length, and square roots of the shares of symbols, repeated words and duplicate lines.
PARTS = ("length", "symbols", "repeats", "lines")
DIM = len(PARTS)
#: Words that a repeat counts at least: a window of five, twice.
REPEAT = 10
SCALE = 1024
#: Part of a group's rows that the concentration steps keep, and the share of Gaussian data under which rows weigh in the last estimate.
CORE, WEIGHED = 0.5, 0.975
#: Steps of a distance's logarithm in which rows are counted.
BINS = 64
#: Rows of a larger group that an estimate is drawn towards.
PRIOR_ROWS = 20
#: Groups whose estimates (some 200 bytes each, from three starts) go to the tasks whole.
FEW_GROUPS = 50_000
#: Chance with which Gaussian data pass the final cut.
REJECT = 1e-5
#: Variance of rounding to whole numbers.
ROUNDING = 1 / 12


def chi2_cdf(x: float, dof: int) -> float:
    """For even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return low


def consistency(share: float) -> float:
    """What the covariance of the share of Gaussian rows nearest the centre is short of by trimming."""
    return share / chi2_cdf(chi2_quantile(share, DIM), DIM + 2)


def base_statistics(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*keep, F.col(text_col).alias("text"))
    spaces = F.regexp_count(text, F.lit(f"[{SPACE}]"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    df = df.select(
        *keep,
        (F.length(text) - spaces).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        lines.alias("lines"),
    )
    n = F.size("words")
    window = F.transform(F.slice("words", F.lit(1), n - 4), lambda w, i: F.xxhash64(w, *[F.get("words", i + k) for k in range(1, 5)]))
    df = df.select(
        *keep,
        "word_chars",
        "n_symbols",
        n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 5, window).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    own = [*keep, "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines"]
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.select(*own, F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ranked"))
    same = lambda x, j: F.coalesce(F.get("ranked", j)["h"] == x["h"], F.lit(False))
    twice = F.filter("ranked", lambda x, i: F.when(i > 0, same(x, i - 1)).otherwise(False) | same(x, i + 1))
    df = df.select(*own, F.array_sort(F.transform(twice, lambda x: x["i"])).alias("at"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-5).alias("last"))
    covered = F.aggregate("at", start, lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(5), p - acc["last"])).alias("sum"), p.alias("last")), lambda acc: acc["sum"])
    df = df.select(*own, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def vector() -> list[Column]:
    """The transformed statistics as scaled integers (x0..), and the variance with which each is known (v0..), in the order of PARTS."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    one_in = lambda c: 1 / F.greatest(F.col(c), F.lit(1))
    parts = [F.log(F.greatest("word_chars", F.lit(1)) / F.greatest("n_words", F.lit(1))), share("n_symbols", "word_chars"), share("n_repeat_words", "n_words"), share("n_dup_lines", "n_lines")]
    # The logarithm of a count has the variance 1 / count; the square root of a count has 1 / 4, and REPEAT words come at a time.
    known = [one_in("word_chars"), one_in("word_chars") / 4, REPEAT * one_in("n_words") / 4, one_in("n_lines") / 4]
    return [F.round(p * SCALE).cast("long").alias(f"x{i}") for i, p in enumerate(parts)] + [(v * SCALE * SCALE).alias(f"v{i}") for i, v in enumerate(known)]


X = [f"x{i}" for i in range(DIM)]
PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]


def with_levels(rows: DataFrame, by: list[str]) -> DataFrame:
    """A row for each group that a row is in, from the whole table (level 0) to all columns of by: level, gid, and the next larger group's gid (parent)."""

    def gid(level: int) -> Column:
        parts = [F.lit(level)]
        for b in by[:level]:
            parts += [F.col(b).isNull(), F.coalesce(b, F.lit(""))]
        return F.xxhash64(*parts)

    levels = [F.struct(F.lit(k).alias("level"), gid(k).alias("gid"), (gid(k - 1) if k else F.lit(0).cast("long")).alias("parent")) for k in range(len(by) + 1)]
    return rows.withColumn("g", F.explode(F.array(*levels))).select("*", "g.*").drop("g")


def sums(weight: Column) -> list[Column]:
    return [F.sum(weight).alias("n")] + [F.sum(weight * F.col(x)).alias(f"s{i}") for i, x in enumerate(X)] + [F.sum(weight * F.col(X[i]) * F.col(X[j])).alias(f"s{i}_{j}") for i, j in PAIRS]


def moments(summed: DataFrame, factor: float) -> DataFrame:
    """Adds mean (m0..) and covariance (c0_0..) of rows summed up: times factor, floored at the variance of rounding."""
    df = summed.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(DIM)})
    own = lambda i, j: F.col(f"s{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
    df = df.withColumns({f"c{i}_{j}": factor * (F.greatest(own(i, j), F.lit(0.0)) + ROUNDING if i == j else own(i, j)) for i, j in PAIRS})
    return df.drop(*[f"s{i}" for i in range(DIM)], *[f"s{i}_{j}" for i, j in PAIRS])


def with_distance(rows: DataFrame, name: str, uncertain: bool = False, det: bool = False) -> DataFrame:
    """Adds the squared Mahalanobis distance of x0.. to m0.. under c0_0.. (uncertain: with v0.. on the diagonal), by Cholesky's steps; det: the logarithm of the determinant instead."""
    made: list[str] = []
    for j in range(DIM):
        rest = F.col(f"c{j}_{j}") + (F.col(f"v{j}") if uncertain else F.lit(0.0))
        for k in range(j):
            rest = rest - F.col(f"l{j}_{k}") * F.col(f"l{j}_{k}")
        rows = rows.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(rest, F.lit(ROUNDING / 1024))))
        more = {}
        for i in range(j + 1, DIM):
            own = F.col(f"c{i}_{j}")
            for k in range(j):
                own = own - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            more[f"l{i}_{j}"] = own / F.col(f"l{j}_{j}")
        if not det:
            off = F.col(f"x{j}") - F.col(f"m{j}")
            for k in range(j):
                off = off - F.col(f"l{j}_{k}") * F.col(f"y{k}")
            more[f"y{j}"] = off / F.col(f"l{j}_{j}")
        rows = rows.withColumns(more) if more else rows
        made += [f"l{j}_{j}", *more]
    ends = [2 * F.log(f"l{j}_{j}") if det else F.col(f"y{j}") * F.col(f"y{j}") for j in range(DIM)]
    return rows.withColumn(name, sum(ends[1:], ends[0])).drop(*made)


ESTIMATE = [f"m{i}" for i in range(DIM)] + [f"c{i}_{j}" for i, j in PAIRS]


def nearest_half(cells: DataFrame) -> DataFrame:
    """(gid, start, logdet, estimate) of the CORE part of each group's rows of least measure. Rows are summed by the measure's steps: a group's never meet."""
    binned = cells.groupBy("gid", "start", F.round(F.log1p("measure") * BINS).cast("long").alias("bin")).agg(*sums(F.col("c")))
    every = Window.partitionBy("gid", "start")
    before = F.coalesce(F.sum("n").over(every.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = binned.withColumn("before", before).withColumn("all", F.sum("n").over(every)).where(F.col("before") < F.ceil(F.col("all") * CORE))
    names = ["n", *[f"s{i}" for i in range(DIM)], *[f"s{i}_{j}" for i, j in PAIRS]]
    summed = kept.groupBy("gid", "start").agg(*[F.sum(c).alias(c) for c in names])
    return with_distance(moments(summed, consistency(CORE)), "logdet", det=True).select("gid", "start", "logdet", *ESTIMATE)


def first_estimates(cells: DataFrame) -> DataFrame:
    """The three starts of each group."""
    values = cells.select("gid", "c", F.posexplode(F.array(*X)).alias("part", "x")).groupBy("gid", "part", "x").agg(F.sum("c").alias("k"))
    every = Window.partitionBy("gid", "part")
    upto = F.sum("k").over(every.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    values = values.withColumn("upto", upto).withColumn("all", F.sum("k").over(every))
    quartile = lambda i, q: F.min(F.when((F.col("part") == i) & (F.col("upto") * 4 >= F.col("all") * q), F.col("x")))
    quartiles = values.groupBy("gid").agg(*[quartile(i, q).alias(f"q{i}_{q}") for i in range(DIM) for q in (1, 2, 3)])
    classical = moments(cells.groupBy("gid").agg(*sums(F.col("c"))), 1.0).select("gid", *ESTIMATE)
    rows = with_distance(cells.join(quartiles, "gid").join(classical, "gid"), "far")
    z = [(F.col(f"x{i}") - F.col(f"q{i}_2")) / F.sqrt(F.pow((F.col(f"q{i}_3") - F.col(f"q{i}_1")) / 1.349, 2) + ROUNDING) for i in range(DIM)]
    square = [x * x for x in z]
    measures = F.array(sum(square[1:], square[0]), F.greatest(*square), F.col("far"))
    return nearest_half(rows.select("gid", "c", *X, F.posexplode(measures).alias("start", "measure")))


def least_determinants(cells: DataFrame, few: bool) -> DataFrame:
    """(gid, estimate): concentration steps from every start until no determinant falls, and the least of each group."""
    sent = F.broadcast if few else lambda df: df
    best = stored(first_estimates(cells), "estimates").withColumn("falls", F.lit(True))
    while True:
        near = with_distance(cells.join(sent(best.where("falls").select("gid", "start", *ESTIMATE)), "gid"), "measure")
        new = nearest_half(near.select("gid", "start", "c", *X, "measure")).withColumnsRenamed({c: f"new_{c}" for c in ["logdet", *ESTIMATE]})
        both = best.join(new, ["gid", "start"], "left")
        falls = F.coalesce(F.col("new_logdet") < F.col("logdet") - 1e-9, F.lit(False))
        best = stored(both.select("gid", "start", falls.alias("falls"), *[F.when(falls, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ["logdet", *ESTIMATE]]), "estimates")
        if best.where("falls").isEmpty():
            return best.groupBy("gid").agg(F.min_by(F.struct(*ESTIMATE), F.struct("logdet", "start")).alias("e")).select("gid", "e.*")


def covariance_estimates(rows: DataFrame, by: list[str]) -> DataFrame:
    """(gid, estimate) of the groups of all columns of by, from rows with by, x0.. and v0..."""
    cells = rows.groupBy(*by, *X).agg(F.count("*").alias("c"))
    cells = stored(with_levels(cells, by).groupBy("gid", "level", "parent", *X).agg(F.sum("c").alias("c")), "cells")
    # The whole corpus is one key of the joins below: estimates go to the tasks, where a count shows that they are few.
    few = cells.select("gid").distinct().count() <= FEW_GROUPS
    raw = least_determinants(cells.select("gid", "c", *X), few)
    near = with_distance(with_levels(rows, by).select("gid", *X, *[f"v{i}" for i in range(DIM)]).join(F.broadcast(raw) if few else raw, "gid"), "distance", uncertain=True)
    # Counted, not filtered: a filter on the distance would be pushed below its steps, which spells them out into one expression of thousands of terms.
    near = near.groupBy("gid", *X).agg(F.count_if(F.col("distance") <= chi2_quantile(WEIGHED, DIM)).alias("c")).where("c > 0")
    weighed = moments(near.groupBy("gid").agg(*sums(F.col("c"))), consistency(WEIGHED))
    groups = cells.select("gid", "level", "parent").distinct()
    found = stored(groups.join(weighed, "gid", "left"), "weighed")
    out = found.where("level = 0").select("gid", *ESTIMATE)
    for level in range(1, len(by) + 1):
        above = out.withColumnsRenamed({c: f"p_{c}" for c in ESTIMATE} | {"gid": "parent"})
        n = F.coalesce("n", F.lit(0))
        drawn = [((n * F.coalesce(c, F.lit(0.0)) + PRIOR_ROWS * F.col(f"p_{c}")) / (n + PRIOR_ROWS)).alias(c) for c in ESTIMATE]
        out = found.where(F.col("level") == level).join(above, "parent").select("gid", *drawn)
    return stored(out, "estimate")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", by: tuple[str, ...] = ("lang", "source"), reject: float = REJECT, keys: bool = False) -> DataFrame:
    """The base statistics of every row, base_failed, distance (squared, null if base_failed) and kept.

    Rows are kept that pass the base rule and whose distance to their group's estimate stays under the chi-square
    quantile of 1 - reject. With keys, the row keys k1 and k2 come along, to join the verdicts to texts.
    The verdicts are stored, so that a filter on them stays above the steps of the distance and the caller's plan is its own.
    """
    groups = [f"g{i}" for i in range(len(by))]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(b).cast("string").alias(g) for b, g in zip(by, groups)])
    names = ["id", *groups]
    if keys:
        source = source.select("*", *row_keys("id"))
        names += ["k1", "k2"]
    stats = base_statistics(source, "text", tuple(names))
    stats = stored(stats.select("*", *vector()), "statistics")
    estimate = covariance_estimates(stats.where("NOT base_failed"), groups)
    own = with_levels(stats, groups).where(F.col("level") == len(groups))
    judged = with_distance(own.join(estimate, "gid", "left"), "distance", uncertain=True)
    distance = F.when(~F.col("base_failed"), F.col("distance"))
    kept = ~F.col("base_failed") & (F.col("distance") <= chi2_quantile(1 - reject, DIM))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return stored(judged.select(F.col("id").alias(id_col), *columns, distance.alias("distance"), F.coalesce(kept, F.lit(False)).alias("kept"), *(["k1", "k2"] if keys else [])), "verdicts")
