"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Every text becomes a vector of transformed statistics. Per language and source a minimum-covariance-determinant
estimate of location and scatter is made from the half of the rows that lies closest together, and texts far from it
by Mahalanobis distance are rejected. Groups of too few rows join the rest of their language, and those again the
rest of all; so every row has an estimate and is judged by the same rule.

The estimate needs one narrow pass per step: the current centre and scatter give each row a distance, rows are summed
per (group, distance bin) on the map side, and the nearest bins up to half of the group give the next centre and
scatter. A group with a third of all rows is thus summed by all tasks; what is joined back is a row per group.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.llm.common import SPACE, fresh, table, text_of
from formloom.session import kept

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Rows that a group needs for an estimate of its own.
MIN_ROWS = 60
STEPS = 4
#: Share of a group's rows that the estimate is made from.
HALF = 0.5
#: Squared distance beyond which a text is rejected: the 99.9 % quantile of chi-square with five degrees of freedom.
CUT = 20.515
BINS_PER_UNIT = 8
#: Least standard deviation of each statistic. Word length and words per line always scatter; theirs guard rounding. More
#: than half of all texts have no symbols, copies or repeats at all, so their scatter is 0 and the least one decides: the
#: cut then lies at 0.029 symbols a word, 21 % copied lines, 13 % repeated words, just above one symbol or one repeated
#: window in a text of MIN_WORDS and one copy in five lines.
FLOORS = (0.01, 0.1, 0.1, 0.08, 0.01)
DIMS = len(FLOORS)
NAMES = ("word_length", "symbol_rate", "line_copies", "repeats", "line_words")


def base_statistics(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines; also their names.

    Three-word windows are compared by a 64-bit hash within their text. A text whose windows all differ is done after
    one hash set; else windows are sorted by hash to find the repeated ones, and the gaps between their places give
    the words that they cover.
    """
    wanted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
    *names, text, words, lines, ids, grams, pairs, places = fresh(
        docs, *wanted, "text_", "words_", "lines_", "ids_", "grams_", "pairs_", "places_"
    )
    n = dict(zip(wanted, names, strict=True))
    df = docs.withColumn(text, text_of(docs["text"]))
    df = df.withColumn(words, F.filter(F.split(text, SPACE), lambda w: w != ""))
    df = df.withColumn(lines, F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn(n["n_words"], F.size(words).cast("long"))
    df = df.withColumn(n["word_chars"], F.length(F.array_join(words, "")).cast("long"))
    df = df.withColumn(n["n_symbols"], (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long"))
    df = df.withColumn(n["n_lines"], F.size(lines).cast("long"))
    df = df.withColumn(n["n_dup_lines"], (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
    # Columns, not nested expressions: what a lambda looks up by place must have been made once per row.
    df = df.withColumn(ids, F.transform(words, lambda w: F.xxhash64(w)))
    gram = lambda x, i: F.xxhash64(x, F.get(F.col(ids), i + 1), F.get(F.col(ids), i + 2))
    df = df.withColumn(grams, F.transform(F.slice(ids, 1, F.greatest(F.size(ids) - 2, F.lit(0))), gram))
    sort = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn(pairs, F.when(F.size(F.array_distinct(grams)) < F.size(grams), sort))
    again = lambda p, k: F.get(F.col(pairs), k)["g"] == p["g"]
    twice = lambda p, k: F.coalesce(again(p, k - 1), F.lit(False)) | F.coalesce(again(p, k + 1), F.lit(False))
    df = df.withColumn(places, F.sort_array(F.transform(F.filter(pairs, twice), lambda p: p["i"])))
    gaps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col(places), i + 1), p + 3) - p))
    total = F.aggregate(gaps, F.lit(0), lambda a, g: a + g)
    df = df.withColumn(n["n_repeat_words"], F.coalesce(total, F.lit(0)).cast("long"))
    return df.drop(text, words, lines, ids, grams, pairs, places), n


def vector(n: dict[str, str]) -> list[Column]:
    """Transformed statistics: logarithms of rates, roots of shares; each is near zero or stable in plain prose."""
    words = F.greatest(F.col(n["n_words"]), F.lit(1))
    lines = F.greatest(F.col(n["n_lines"]), F.lit(1))
    return [
        F.log((F.col(n["word_chars"]) + 1.0) / words),
        F.log1p(F.lit(20.0) * F.col(n["n_symbols"]) / words),
        F.sqrt(F.col(n["n_dup_lines"]) / lines),
        F.sqrt(F.col(n["n_repeat_words"]) / words),
        F.log((words + 5.0) / lines) / 4,
    ]


def grouped(stats: DataFrame, min_rows: int) -> DataFrame:
    """``stats`` (lang, source, x) with ``g``: its language and source, or the rest of its language, or the rest of all."""
    lang, source = F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")), F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0"))
    counts = stats.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    counts = counts.withColumn("own", F.col("rows") >= min_rows)
    by_lang = Window.partitionBy("lang")
    counts = counts.withColumn("rest", F.sum(F.when(F.col("own"), 0).otherwise(F.col("rows"))).over(by_lang))
    g = F.when(F.col("own"), F.to_json(F.array(lang, source))).when(F.col("rest") >= min_rows, F.to_json(F.array(lang))).otherwise(F.lit("[]"))
    groups = counts.select(F.col("lang").alias("l_"), F.col("source").alias("s_"), g.alias("g"))
    return stats.join(groups, stats["lang"].eqNullSafe(F.col("l_")) & stats["source"].eqNullSafe(F.col("s_"))).drop("l_", "s_")


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _moments(x: list[Column]) -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(x[i]).alias(f"m{i}") for i in range(DIMS)], *[F.sum(x[i] * x[j]).alias(f"m{i}_{j}") for i, j in _pairs()]]


def _summed(window) -> list[Column]:
    return [F.sum(c).over(window).alias(c) for c in ["n", *[f"m{i}" for i in range(DIMS)], *[f"m{i}_{j}" for i, j in _pairs()]]]


def factored(moments: DataFrame, scale: float) -> DataFrame:
    """Centre c0.. and the Cholesky factor l0_0.. of the scatter times ``scale``, floors added; a row per group."""
    df = moments
    df = df.select("g", *[(F.col(f"m{i}") / F.col("n")).alias(f"c{i}") for i in range(DIMS)], "n", *[f"m{i}_{j}" for i, j in _pairs()])
    for i, j in _pairs():
        cov = F.lit(scale) * (F.col(f"m{i}_{j}") / F.col("n") - F.col(f"c{i}") * F.col(f"c{j}"))
        cov = F.greatest(cov, F.lit(0.0)) + F.lit(FLOORS[i] ** 2) if i == j else cov
        for k in range(j):
            cov = cov - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
        # A scatter is at least its floors, so a pivot below a hundredth of them can only be rounding.
        pivot = F.sqrt(F.greatest(cov, F.lit((0.1 * FLOORS[i]) ** 2)))
        df = df.withColumn(f"l{i}_{j}", pivot if i == j else cov / F.col(f"l{j}_{j}"))
    return df.select("g", *[f"c{i}" for i in range(DIMS)], *[f"l{i}_{j}" for i, j in _pairs()])


def distance(stats: DataFrame, estimate: DataFrame, out: str) -> DataFrame:
    """``stats`` with the squared Mahalanobis distance of x0.. to the estimate of its group, null without one.

    The estimate has a row per language and source; whether it is broadcast is left to Spark's measured sizes.
    """
    df = stats.join(estimate, "g", "left")
    for i in range(DIMS):
        rest = reduce(lambda a, k: a - F.col(f"l{i}_{k}") * F.col(f"y{k}"), range(i), F.col(f"x{i}") - F.col(f"c{i}"))
        df = df.withColumn(f"y{i}", rest / F.col(f"l{i}_{i}"))
    return df.select(*stats.columns, reduce(add, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(DIMS)]).alias(out))


def concentrated(stats: DataFrame, estimate: DataFrame, half: float) -> DataFrame:
    """One concentration step: moments of the nearest ``half`` of each group, up to whole distance bins."""
    binned = distance(stats, estimate, "d2").withColumn("bin", F.floor(F.log1p("d2") * BINS_PER_UNIT * 4).cast("int"))
    sums = binned.groupBy("g", "bin").agg(*_moments([F.col(f"x{i}") for i in range(DIMS)]))
    upto, whole = Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("g")
    ranked = sums.withColumn("rows", F.sum("n").over(whole)).select("g", "bin", "rows", *_summed(upto))
    enough = ranked.filter(F.col("n") >= F.ceil(F.lit(half) * F.col("rows")))
    return enough.groupBy("g").agg(*[F.min_by(c, "bin").alias(c) for c in ranked.columns if c not in ("g", "bin", "rows")])


def estimates(stats: DataFrame, steps: int = STEPS, half: float = HALF) -> DataFrame:
    """Centre and scatter per group, from a deterministic start: medians and median deviations in fine bins."""
    spread = [F.col(f"x{i}") for i in range(DIMS)]
    medians = None
    for i in range(DIMS):
        cells = stats.groupBy("g", F.floor(spread[i] * 64).alias("v")).agg(F.count("*").alias("k"))
        whole = Window.partitionBy("g")
        cells = cells.withColumn("upto", F.sum("k").over(whole.orderBy("v"))).withColumn("rows", F.sum("k").over(whole))
        one = cells.filter(F.col("upto") * 2 >= F.col("rows")).groupBy("g").agg(((F.min("v") + 0.5) / 64).alias(f"c{i}"))
        medians = one if medians is None else medians.join(one, "g")
    flat = medians.select("g", *[f"c{i}" for i in range(DIMS)], *[F.lit(2 * FLOORS[i] if i == j else 0.0).alias(f"l{i}_{j}") for i, j in _pairs()])
    now = kept(flat)
    for _ in range(steps):
        # 1 / P(chi2_7 <= median of chi2_5): the half nearest to the centre scatters by so much less than all rows do.
        now = kept(factored(concentrated(stats, now, half), 2.08))
    return now


def judge(docs: DataFrame, min_rows: int = MIN_ROWS, cut: float = CUT, steps: int = STEPS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` without text, with base statistics, base_failed, distance and kept; also the names of these columns.

    Null texts and texts without words have zero counts and fail the base rule. Null languages and sources are groups
    of their own. Equal rows get equal verdicts. An empty table gives an empty result. A text is rejected by the method
    only for lying beyond the cut; texts that fail the base rule aren't used for the estimates.
    """
    measured, n = base_statistics(docs)
    failed, far, verdict = fresh(measured, "base_failed", "distance", "kept")
    base = (F.col(n["n_words"]) < MIN_WORDS) | (F.lit(100) * F.col(n["n_repeat_words"]) > F.lit(MAX_REPEATED_PERCENT) * F.col(n["n_words"]))
    x = [f"x{i}" for i in range(DIMS)]
    held = F.struct(*[F.col(c) for c in measured.columns if c != "text"], base.alias(failed)).alias("row")
    rows = kept(measured.select(held, *[c.alias(k) for k, c in zip(x, vector(n), strict=True)]))
    rows = grouped(rows.withColumns({"lang": F.col("row.lang"), "source": F.col("row.source")}), min_rows)
    sound = kept(rows.filter(~F.col(f"row.{failed}")).select("g", *x))
    judged = distance(rows.select("row", "g", *x), estimates(sound, steps), "d2")
    judged = judged.select("row.*", F.col("d2").alias(far), (~F.col(f"row.{failed}") & F.coalesce(F.col("d2") <= cut, F.lit(True))).alias(verdict))
    names = n | {"base_failed": failed, "distance": far, "kept": verdict}
    return judged.select(*[c for c in docs.columns if c != "text"], *names.values()), names


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 3).alias("distance"))
