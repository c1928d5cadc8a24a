"""Quality rules: fixed limits, and robust multivariate outliers by minimum covariance determinant.

Each document gives counts and a vector of transformed statistics, rounded to whole thousandths. For each language and
source, estimates start from medians and median deviations and from small subsets drawn by hash. Each start takes
concentration steps: mean and covariance of the COVER of the documents nearest by Mahalanobis distance, again and
again. After FIRST_STEPS the start with the least determinant goes on, until its determinant falls no more. Every step
covers all documents of the group, in partial aggregates of whole numbers (so results don't depend on their order);
nearness is ranked in a histogram of distances. Documents that pass the limits but lie beyond the cut-off are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, documents, drop_shared, hot_safe_lookup, small_batches, write_shared

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
#: Dimensions: log of the mean word length; square roots of symbols a character, capitals a letter, repeated lines a line, other marks a character.
DIMS = 5
#: Share of a group that an estimate covers, chance of a normal document beyond the cut-off.
COVER, TAIL = 0.75, 1e-7
#: Starts by hash besides that from medians, rows of each (about), steps before the best start is chosen. A run that
#: has not settled after ROUNDS steps fails; steps in which the log of the determinant falls by less than SETTLED end it.
DRAWN, DRAWN_ROWS, FIRST_STEPS, ROUNDS, SETTLED = 2, 4 * (DIMS + 1), 2, 100, 1e-6
#: Least standard deviation of a dimension (in thousandths), for those in which most documents agree.
FLOOR = np.array([60.0, 30.0, 60.0, 100.0, 40.0])
#: Smaller groups, with fewer than five documents a parameter, are judged by an estimate over all documents of their
#: language, large groups included; if those are too few, by one over all documents, however few (FLOOR regularises it).
LEAST = 5 * (DIMS + DIMS * (DIMS + 1) // 2)
GROUP = ("_lang", "_source")
ALL = "\0all"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = T.StructType([*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("z", T.ArrayType(T.DoubleType()))])


def counts(text: str) -> tuple[list[int], list[float]]:
    """The five base counts and the statistic vector of a text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, chars = len(words), len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen, lines, repeated = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            repeated += line in seen
            seen.add(line)
    again, met, covered = set(), set(), 0
    grams = list(zip(words, words[1:], words[2:], strict=False))
    for g in grams:
        (again if g in met else met).add(g)
    if again:
        past = 0
        for i, g in enumerate(grams):
            if g in again:
                covered += i + 3 - max(i, past)
                past = i + 3
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper = int(byte[65:91].sum())
    letters, marks = upper + int(byte[97:123].sum()), int(byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum()) - symbols
    z = [math.log(chars / n) if n else 0.0, math.sqrt(symbols / max(chars, 1)), math.sqrt(upper / max(letters, 1)), math.sqrt(repeated / max(lines, 1)), math.sqrt(marks / max(chars, 1))]
    return [n, chars, symbols, repeated, covered], [float(round(1000 * v)) for v in z]


@F.arrow_udf(STATS)
def text_stats(texts: pa.Array) -> pa.Array:
    found = [counts(t or "") for t in texts.to_pylist()]
    columns = [pa.array([f[0][k] for f in found], pa.int64()) for k in range(len(COUNTS))]
    return pa.StructArray.from_arrays([*columns, pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=[*COUNTS, "z"])


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def group_columns(lang: Column, source: Column) -> dict[str, Column]:
    """Null languages and sources are a group's like any other, as the empty name."""
    return {"_lang": F.coalesce(lang.cast("string"), F.lit("")), "_source": F.coalesce(source.cast("string"), F.lit(""))}


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, dims: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(dims / 2, mid / 2) < p else (low, mid)
    return low


@lru_cache(1)
def consistency() -> float:
    """What a covariance of the nearest COVER of normal rows is multiplied by."""
    return COVER / gamma_p(DIMS / 2 + 1, chi2_quantile(COVER, DIMS) / 2)


PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def distance2(z: Column, mean: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance; inverse holds the upper triangle, those off the diagonal doubled."""
    d = [z[i] - mean[i] for i in range(DIMS)]
    return sum((inverse[k] * d[i] * d[j] for k, (i, j) in enumerate(PAIRS)), F.lit(0.0))


def bin_of(squared: Column) -> Column:
    """The place of a squared distance in the histogram: steps of 1/256, and of 1/4096 of itself beyond 4096."""
    far = (1 << 20) + F.floor(F.log(squared / 4096) * 4096)
    return F.when(squared < 4096, F.floor(squared * 256)).otherwise(far)


def estimate(m: int, sums: list[float], products: list[float]) -> tuple[list[float], list[float], float]:
    """Mean, inverse covariance and log of the determinant of the rows with these sums."""
    mean = np.array(sums) / m
    cov = np.zeros((DIMS, DIMS))
    for k, (i, j) in enumerate(PAIRS):
        cov[i, j] = cov[j, i] = (products[k] / m - mean[i] * mean[j]) * consistency()
    cov += np.diag(FLOOR**2)
    inv = np.linalg.inv(cov)
    return mean.tolist(), [inv[i, j] * (1 + (i != j)) for i, j in PAIRS], float(np.linalg.slogdet(cov)[1])


PARAMS = "_lang string, _source string, n bigint, _start int, mean array<double>, inverse array<double>, logdet double"


def estimated(sums: DataFrame) -> DataFrame:
    """PARAMS of rows (GROUP, n, _start, m, sums, products): those of a group's rows that an estimate covers."""
    types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
    names = [c.split()[0] for c in PARAMS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*r[:4], *estimate(*r[4:])) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return sums.select(*GROUP, "n", "_start", "m", "sums", "products").mapInArrow(run, PARAMS)


def moments() -> list[Column]:
    """Sums and products of the columns of z."""
    z = F.col("z")
    return [*(F.sum(z[i]).alias(f"_s{i}") for i in range(DIMS)), *(F.sum(z[i] * z[j]).alias(f"_p{k}") for k, (i, j) in enumerate(PAIRS))]


def summed(rows: DataFrame) -> DataFrame:
    """Counts and moments of parts as those of the whole."""
    sums, products = F.array(*(F.sum(f"_s{i}") for i in range(DIMS))), F.array(*(F.sum(f"_p{k}") for k in range(len(PAIRS))))
    return rows.groupBy(*GROUP, "n", "_start").agg(F.sum("_k").alias("m"), sums.alias("sums"), products.alias("products"))


def medians(rows: DataFrame) -> DataFrame:
    """(GROUP, _d, _v): exact medians from counts of each whole-number value of rows (GROUP, _d, _v)."""
    by = Window.partitionBy(*GROUP, "_d")
    # Written before the window: else one exchange by group would serve both, with a hot group's partial counts in one task.
    tally = cut(rows.groupBy(*GROUP, "_d", "_v").agg(F.count(F.lit(1)).alias("_k")))
    tally = tally.withColumns({"_upto": F.sum("_k").over(by.orderBy("_v")), "_all": F.sum("_k").over(by)})
    return tally.filter("2 * _upto >= _all").groupBy(*GROUP, "_d").agg(F.min("_v").alias("_v"))


def as_vector(values: DataFrame, name: str) -> DataFrame:
    """One row a group with its DIMS values in order."""
    return values.groupBy(*GROUP).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_v"))), lambda s: s["_v"]).alias(name))


def drawn_starts(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """PARAMS of DRAWN small subsets of each group; a group from which a hash draws nothing lacks that start."""
    found = hot_safe_lookup(rows, sizes, GROUP, "n", F.xxhash64("z")).withColumn("_start", F.explode(F.array(*(F.lit(k + 1) for k in range(DRAWN)))))
    found = found.filter(F.pmod(F.xxhash64("z", "_start"), F.greatest(F.lit(1), F.expr(f"n div {DRAWN_ROWS}"))) == 0)
    return estimated(summed(found.groupBy(*GROUP, "n", "_start").agg(F.count(F.lit(1)).alias("_k"), *moments())))


def median_start(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """PARAMS (start 0) of medians and median deviations."""
    centre = cut(sizes.join(as_vector(medians(rows.select(*GROUP, F.posexplode("z").alias("_d", "_v"))), "mean"), list(GROUP)))
    spread = hot_safe_lookup(rows, centre, GROUP, "n", F.xxhash64("z")).select(*GROUP, F.posexplode(F.zip_with("z", "mean", lambda a, b: F.abs(a - b))).alias("_d", "_v"))
    first = centre.join(as_vector(medians(spread), "_mad"), list(GROUP))
    diagonal = [1 / (F.pow(F.col("_mad")[i] * 1.4826, 2) + float(FLOOR[i] ** 2)) if i == j else F.lit(0.0) for i, j in PAIRS]
    return first.select(*GROUP, "n", F.lit(0).alias("_start"), "mean", F.array(*diagonal).alias("inverse"), F.lit(0.0).alias("logdet"))


def concentrated(rows: DataFrame, params: DataFrame) -> DataFrame:
    """PARAMS of the rows nearest to each of params."""
    starts = params.groupBy(*GROUP, "n").agg(F.collect_list(F.struct("_start", "mean", "inverse")).alias("_to"))
    far = hot_safe_lookup(rows, starts, GROUP, "n", F.xxhash64("z")).select(*GROUP, "z", "n", F.inline("_to"))
    far = far.withColumn("_bin", bin_of(distance2(F.col("z"), F.col("mean"), F.col("inverse"))))
    by = Window.partitionBy(*GROUP, "_start").orderBy("_bin")  # bounded by the number of bins
    bins = far.groupBy(*GROUP, "n", "_start", "_bin").agg(F.count(F.lit(1)).alias("_k"), *moments())
    near = cut(bins).withColumn("_before", F.sum("_k").over(by) - F.col("_k")).filter(F.col("_before") < F.ceil(F.col("n") * COVER))
    return estimated(summed(near))


def estimates(stats: DataFrame) -> DataFrame:
    """(GROUP, n, mean, inverse, logdet) of every group of stats (GROUP, z): the least determinant that was found."""
    sizes = cut(stats.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")))
    rows = stats.select(*GROUP, "z")
    keys, fields = [*GROUP, "n", "_start"], ("mean", "inverse", "logdet")
    # The first values are no estimates that cover COVER, so their determinants don't count.
    state = median_start(rows, sizes).unionByName(drawn_starts(rows, sizes)).withColumns({"logdet": F.lit(float("inf")), "_open": F.lit(True)})
    state, path = write_shared(state, "estimates")
    for step in range(1, ROUNDS + 1):
        new = concentrated(rows, state.filter("_open")).select(*keys, F.struct(*fields).alias("_new"))
        better = F.col("_new.logdet") < F.col("logdet")
        fell = F.col("_new.logdet") < F.col("logdet") - SETTLED
        state = state.join(new, keys, "left").withColumns({"_better": F.coalesce(better, F.lit(False)), "_open": F.coalesce(fell, F.lit(False))})
        state = state.select(*keys, *(F.when(F.col("_better"), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in fields), "_open")
        if step == FIRST_STEPS:
            best = Window.partitionBy(*GROUP).orderBy("logdet", "_start")  # DRAWN + 1 rows
            state = state.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")
        state, new = write_shared(state, "estimates")
        drop_shared(stats.sparkSession, path)
        path = new
        if step >= FIRST_STEPS and state.filter("_open").isEmpty():
            out = cut(state.select(*GROUP, "n", *fields))
            drop_shared(stats.sparkSession, path)
            return out
    raise RuntimeError(f"determinants did not settle in {ROUNDS} steps")


def is_outlier(z: Column, mean: Column, inverse: Column) -> Column:
    """Beyond the cut-off in Mahalanobis distance; false for rows of no group, which fail the limits."""
    return F.coalesce(distance2(z, mean, inverse) > chi2_quantile(1 - TAIL, DIMS), F.lit(False))


def pools(passed: DataFrame) -> tuple[DataFrame, bool]:
    """(GROUP, _size, _by_lang, _by_source: the group whose estimate judges it, _lang_pool: whether a language's rows make one), and whether all rows make one."""
    sizes = cut(passed.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_size")))
    langs = cut(sizes.groupBy("_lang").agg(F.sum("_size").alias("_all"), F.min("_size").alias("_min"), F.count(F.lit(1)).alias("_groups")))
    found = hot_safe_lookup(sizes, langs, ["_lang"], "_groups", F.xxhash64("_source"))
    large, pooled = F.col("_size") >= LEAST, F.col("_all") >= LEAST
    by = {"_by_lang": F.when(large | pooled, F.col("_lang")).otherwise(ALL), "_by_source": F.when(large, F.col("_source")).otherwise(ALL)}
    out = cut(found.withColumns(by).withColumn("_lang_pool", (F.col("_min") < LEAST) & pooled).select(*GROUP, "_size", *by, "_lang_pool"))
    return out, not langs.filter(~pooled).isEmpty()


def regrouped(rows: DataFrame, sizes: DataFrame, spread: Column) -> DataFrame:
    """rows with the group whose estimate judges them; that of rows without a size is null."""
    found = hot_safe_lookup(rows, sizes.select(*GROUP, "_size", "_by_lang", "_by_source"), GROUP, "_size", spread)
    return found.withColumns({"_lang": F.col("_by_lang"), "_source": F.col("_by_source")}).drop("_size", "_by_lang", "_by_source")


def pooled_stats(passed: DataFrame, sizes: DataFrame, whole: bool) -> DataFrame:
    """(GROUP, z) of passed rows, once for each estimate that they are part of."""
    found = hot_safe_lookup(passed, sizes.select(*GROUP, "_size", "_lang_pool"), GROUP, "_size", F.col("_id"))
    own = F.when(F.col("_size") >= LEAST, F.struct(*GROUP))
    lang = F.when(F.col("_lang_pool"), F.struct("_lang", F.lit(ALL).alias("_source")))
    everything = [F.struct(F.lit(ALL).alias("_lang"), F.lit(ALL).alias("_source"))] if whole else []
    to = F.explode(F.filter(F.array(own, lang, *everything), lambda g: g.isNotNull())).alias("_to")
    return found.select(to, F.col("_s.z").alias("z")).select("_to.*", "z")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, group, counts and vector of each row, from a checkpoint), groups with their sizes and pools, estimates of the rows that pass the limits."""
    small_batches(docs.sparkSession)
    rows = cut(docs.select(F.col(id_col).alias("_id"), *(c.alias(k) for k, c in group_columns(F.col("lang"), F.col("source")).items()), text_stats(F.col(text_col).cast("string")).alias("_s")))
    passed = rows.filter(~base_failed(F.col("_s")))
    sizes, whole = pools(passed)
    return rows, sizes, estimates(pooled_stats(passed, sizes, whole))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the five counts, base_failed, kept; one row for each input row.

    A null text has no words and fails the limits. Groups are (lang, source), nulls as empty names; small ones
    are judged by their language or by all documents. Repeated rows count
    and come back each; ties in distance are covered together. An empty table gives no rows. Other columns are ignored.
    """
    rows, sizes, params = judged(docs, id_col, text_col)
    out = hot_safe_lookup(regrouped(rows, sizes, F.col("_id")), params, GROUP, "n", F.col("_id"))
    out = out.select(F.col("_id").alias(id_col), *(F.col("_s")[c].alias(c) for c in COUNTS), base_failed(F.col("_s")).alias("base_failed"), is_outlier(F.col("_s.z"), F.col("mean"), F.col("inverse")).alias("_odd"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("_odd")).drop("_odd")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with their columns as they are. Texts are read again rather than shuffled."""
    _, sizes, params = judged(docs, id_col, text_col)
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), *(c.alias(k) for k, c in group_columns(F.col("lang"), F.col("source")).items()), text_stats(F.col(text_col).cast("string")).alias("_s"))
    out = hot_safe_lookup(regrouped(rows.filter(~base_failed(F.col("_s"))), sizes, F.col("_id")), params, GROUP, "n", F.col("_id"))
    return out.filter(~is_outlier(F.col("_s.z"), F.col("mean"), F.col("inverse"))).select("_row.*")


def op7_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir))


QUERIES = {"op7_quality_mcd": op7_quality_mcd}
SQL: dict[str, str] = {}
