"""Operator 2. Robust multivariate outliers among quality statistics, in DataFrame operations alone.

Base statistics of a text fail it first. The rest are judged by language and source: five
transformed statistics (log length, log word length, symbols, repeated words and repeated lines per
hundred, logged) get a minimum-covariance-determinant estimate of centre and scatter, and a document
goes if its squared Mahalanobis distance passes the CUT quantile of chi-squared.

The estimate starts from coordinate medians and median deviations and takes concentration steps:
distances are put on a fixed logarithmic scale, a group's rows are summed per step of that scale,
and the least steps that hold SHARE of the rows give the next centre and scatter. So each step is one
aggregation over all rows, a group with a third of them included, and no order statistic is
gathered. A last step re-estimates from rows within the 0.975 quantile. Statistics are whole
multiples of 1/SCALE and sums are exact integers, so results don't depend on the order of rows.
Statistics that are the same for most of a group would make the scatter singular; FLOOR, a variance
per coordinate, is added to it (as in regularized MCD).

Every group's medians, deviations and moments are shrunk: PRIOR rows like the mean of its language's
groups are added to its own, and PRIOR rows like the mean of all languages to the language's. So a
group of thousands stands for itself, one of a few rows is judged by its language's estimate, and
nothing changes all at once at some size. Repetition below the base rule's bound can't reject a
document by itself: FLOOR keeps its share of the squared distance under the cut.

Cases: null text has no words and fails; null language or source is a group of its own; repeated rows
count and are judged each; rows in ties have equal distances and verdicts; an empty table gives no
rows; a very long text is one row, whose words one task holds. Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickspark.llm.common import SPACE, text_of, work_dir, written

NAMES = ("length", "word_length", "symbols", "repeats", "lines")
P = len(NAMES)
SCALE, STEPS, SHARE = 256, 6, 0.75
#: Rows of the language that each group gets in addition.
PRIOR = 60
#: Variance added to each coordinate, in squared units of the transformed statistic.
FLOOR = (0.05, 0.01, 0.10, 0.60, 0.40)
CUT = 0.9999
#: Steps of the distance scale per doubling.
FINE = 32
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8


def chi2_cdf(x: float, k: int) -> float:
    """The regularized incomplete gamma function, by its series."""
    a, t = k / 2, x / 2
    term = total = math.exp(a * math.log(t) - t - math.lgamma(a + 1)) if t > 0 else 0.0
    n = 1
    while term > 1e-17 * total and n < 10_000:
        term *= t / (a + n)
        total += term
        n += 1
    return total


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return lo


def let(value: Column, body) -> Column:
    """body of value, with value evaluated once: a lambda's variable isn't inlined again by the optimizer."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that the text holds twice or more."""

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    def covered(w: Column) -> Column:
        ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False))))
        at = F.array_sort(F.transform(twice, lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(at, start, lambda a, i: F.struct((a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"])

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    found = let(hashed, lambda h: F.when(F.size(h) > WINDOW, let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))).otherwise(0))
    return F.coalesce(found, F.lit(0)).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the base statistics of every row."""
    text = text_of(text_col)
    bare = F.btrim(text, F.lit(BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    measured = let(
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")),
    )
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), measured.alias("m"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    return rows.select("doc_id", "lang", "source", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words")


def _failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _vector() -> list[Column]:
    """The transformed statistics in whole multiples of 1/SCALE."""
    words = F.greatest("n_words", F.lit(1))
    raw = (F.log1p("n_words"), F.log1p(F.col("word_chars") / words), F.log1p(100 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))), F.log1p(100 * F.col("n_repeat_words") / words), F.log1p(100 * F.col("n_dup_lines") / words))
    return [F.round(SCALE * x).cast("long") for x in raw]


def _distance() -> Column:
    """Squared distance of x0.. from centre c0.. by forward substitution in the factors l_ij and d_j."""
    y: list[Column] = []
    for i in range(P):
        v = F.col(f"x{i}") - F.col(f"c{i}")
        for j in range(i):
            v = v - F.col(f"l{i}_{j}") * y[j]
        y.append(v)
    total = F.lit(0.0)
    for j in range(P):
        total = total + y[j] * y[j] / F.col(f"d{j}")
    return total


def _factored(moments: DataFrame, widen: float) -> DataFrame:
    """g and the factors of each group's scatter, from n, s_i and s_ij: floors added, consistent by widen."""
    out = moments.select("g", *((F.col(f"s{i}") / F.col("n")).alias(f"c{i}") for i in range(P)), "n", *(f"s{i}_{j}" for i in range(P) for j in range(i + 1)))
    out = out.select("g", *(f"c{i}" for i in range(P)), *((widen * (F.col(f"s{i}_{j}") / F.col("n") - F.col(f"c{i}") * F.col(f"c{j}")) + (FLOOR[i] * SCALE**2 if i == j else 0.0)).alias(f"v{i}_{j}") for i in range(P) for j in range(i + 1)))
    for j in range(P):  # column j of the LDL' factors, from those before it
        d = F.col(f"v{j}_{j}")
        for k in range(j):
            d = d - F.col(f"l{j}_{k}") * F.col(f"l{j}_{k}") * F.col(f"d{k}")
        out = out.withColumn(f"d{j}", F.greatest(d, F.lit(FLOOR[j] * SCALE**2 * 0.01)))
        below = {}
        for i in range(j + 1, P):
            v = F.col(f"v{i}_{j}")
            for k in range(j):
                v = v - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") * F.col(f"d{k}")
            below[f"l{i}_{j}"] = v / F.col(f"d{j}")
        out = out.withColumns(below) if below else out
    return out.select("g", *(f"c{i}" for i in range(P)), *(f"d{i}" for i in range(P)), *(f"l{i}_{j}" for i in range(P) for j in range(i)))


def _shrunk(sums: DataFrame, columns: list[str]) -> DataFrame:
    """g, lang, n and the columns, which come as sums over a group's n rows and leave as means, drawn toward the language's and those toward the mean of all languages; a row per group goes in.

    Sums go in as whole multiples of a power of two, so theirs are exact in any order.
    """
    total = sums.groupBy("lang").agg(F.sum("n").alias("ln"), *(F.sum(c).alias(f"ls_{c}") for c in columns))
    whole = Window.partitionBy()  # a row per language
    total = total.select("lang", "ln", *(f"ls_{c}" for c in columns), F.greatest(F.sum("ln").over(whole), F.lit(1)).alias("an"), *(F.sum(f"ls_{c}").over(whole).alias(f"as_{c}") for c in columns))
    total = total.select(F.col("lang").alias("of"), *(((F.col(f"ls_{c}") + PRIOR * F.col(f"as_{c}") / F.col("an")) / (F.col("ln") + PRIOR)).alias(f"p_{c}") for c in columns))
    both = sums.join(F.broadcast(total), F.col("lang").eqNullSafe(F.col("of")))  # a row per language
    return both.select("g", "lang", "n", *(((F.col(c) + PRIOR * F.col(f"p_{c}")) / (F.col("n") + PRIOR)).alias(c) for c in columns))


def estimates(rows: DataFrame, path: str) -> DataFrame:
    """The estimate of every group g of rows with g, lang, x0..: centre c_i and factors d_i, l_ij."""
    centres, deviations = [f"c{i}" for i in range(P)], [f"m{i}" for i in range(P)]
    summed = lambda value: (F.count("*") * F.percentile(value, 0.5))  # noqa: E731  values on a bounded scale: exact, and small
    middle = rows.groupBy("g").agg(F.first("lang").alias("lang"), F.count("*").alias("n"), *(summed(F.col(f"x{i}")).alias(f"c{i}") for i in range(P)))
    middle = _shrunk(middle, centres)
    middle = written(middle.select("g", "lang", *((F.round(1024 * F.col(c)) / 1024).alias(c) for c in centres)), f"{path}/median")
    named, middle = middle.select("g", "lang"), middle.drop("lang")
    spread = rows.join(middle, "g").groupBy("g").agg(F.first("lang").alias("lang"), F.count("*").alias("n"), *(summed(F.abs(F.col(f"x{i}") - F.col(f"c{i}"))).alias(f"m{i}") for i in range(P)))
    spread = middle.join(_shrunk(spread, deviations), "g")
    fit = spread.select("g", *centres, *((F.pow(1.4826 * F.col(f"m{i}"), 2) + FLOOR[i] * SCALE**2).alias(f"d{i}") for i in range(P)), *(F.lit(0.0).alias(f"l{i}_{j}") for i in range(P) for j in range(i)))
    fit = written(fit, f"{path}/0")
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    names = [*(f"s{i}" for i in range(P)), *(f"s{i}_{j}" for i, j in pairs)]
    sums = [F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs)]
    again = [F.sum(x).alias(x) for x in ("n", *names)]
    for step in range(1, STEPS + 2):
        measured = rows.drop("lang").join(fit, "g").withColumn("q", _distance())
        if step <= STEPS:
            steps = measured.groupBy("g", F.floor(FINE * F.log2(1 + F.col("q"))).cast("int").alias("at")).agg(*sums)
            w = Window.partitionBy("g").orderBy("at")  # as many rows as the scale has steps
            steps = steps.withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("g")))
            moments = steps.where(F.col("before") < F.ceil(SHARE * F.col("all"))).groupBy("g").agg(*again)
            widen = SHARE / chi2_cdf(chi2_quantile(SHARE, P), P + 2)
        else:
            # a group none of whose rows is near keeps its language's
            near = F.when(F.col("q") <= chi2_quantile(0.975, P), 1).otherwise(0)
            counted = [F.sum(near).alias("n"), *(F.sum(near * F.col(f"x{i}")).alias(f"s{i}") for i in range(P)), *(F.sum(near * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in pairs)]
            moments = measured.groupBy("g").agg(*counted)
            widen = 0.975 / chi2_cdf(chi2_quantile(0.975, P), P + 2)
        fit = written(_factored(_shrunk(moments.join(named, "g"), names).withColumn("n", F.lit(1)), widen), f"{path}/{step}")
    return fit


def judge(docs: DataFrame, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, and the squared distance (null where the base statistics fail)."""
    path = work_dir(docs.sparkSession, "outliers")
    stats = written(statistics(docs, id_col, text_col, lang_col, source_col), f"{path}/statistics")
    named = stats.select("*", F.xxhash64(F.struct("lang", "source"), F.col("lang").isNull(), F.col("source").isNull()).alias("g"), _failed().alias("base_failed"), *(x.alias(f"x{i}") for i, x in enumerate(_vector())))
    named = written(named, f"{path}/rows")
    fit = estimates(named.where(~F.col("base_failed")).select("g", "lang", *(f"x{i}" for i in range(P))), path)
    judged = named.join(fit, "g", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.col("distance") <= chi2_quantile(cut, P))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), "distance")
