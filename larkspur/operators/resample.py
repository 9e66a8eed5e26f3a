"""Bootstrap of metrics as joins and aggregations: one pass computes all resamples.

Instead of drawing indices, every row draws how often it is in each resample. With weights from
the Poisson distribution of mean 1 resamples are independent across rows, so they need no shuffle of rows,
no row numbers and no shared index table: each task adds up its rows' weights. Where a resample must
have exactly n rows, ``counted_bootstrap`` splits the n draws down a tree of the rows' places, so that a
task finds its own rows' counts without any other's; ``index_bootstrap`` joins drawn indices, a row each,
with the numbered rows, which any engine can repeat but shuffles resamples * n rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType, StructField, StructType

from ..functions.scalars import draw
from ..functions.special import normal_cdf, normal_quantile
from ..sources.session import ship_package, written

SPACE = 1 << 30
#: Cumulative probabilities of a Poisson count of mean 1.
_POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


def poisson_weight(id_: Column, resample: Column, seed: int) -> Column:
    """How often a subject is in a resample; all rows of the subject, whatever model or seed, agree."""
    u = draw(id_ * 1021 + resample * 7919, seed, SPACE) / F.lit(float(SPACE))
    return sum((F.when(u >= p, 1).otherwise(0) for p in _POISSON[1:]), F.when(u >= _POISSON[0], 1).otherwise(0))


def bootstrap(df: DataFrame, id_col: str, statistics: dict[str, Callable[[Column], Column]], resamples: int, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, b, statistics): each statistic, an aggregate built from the weight column, on each resample.

    A resample on which a statistic is undefined (one class only, say) has null there.
    """
    rows = df.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    rows = rows.withColumn("__w", poisson_weight(F.col(id_col), F.col("b"), seed)).where("__w > 0")
    return rows.groupBy(*by, "b").agg(*(f(F.col("__w")).alias(n) for n, f in statistics.items()))


def bayesian_weight(id_: Column, resample: Column, seed: int) -> Column:
    """An exponential weight; over a resample's sum these are Dirichlet weights."""
    u = (draw(id_ * 1021 + resample * 7919, seed, SPACE) + 0.5) / F.lit(float(SPACE))
    return -F.ln(u)


def index_bootstrap(df: DataFrame, place: str, n: int, resamples: int, seed: int) -> DataFrame:
    """(b, k, columns of df): n draws with replacement for each resample; place numbers rows from 0.

    The same draws apply to all rows of a place, so paired models and repeated seeds stay aligned.
    """
    every = df.sparkSession.range(resamples * n)
    drawn = every.select(F.expr(f"id div {max(1, n)}").alias("b"), F.pmod("id", F.lit(max(1, n))).alias("k"), draw(F.col("id"), seed, n).alias("__at"))
    return df.join(drawn, F.col(place) == F.col("__at")).drop("__at")


#: Places whose counts are drawn together.
CHUNK = 4096
#: Places of a task, up to TASKS tasks.
TASK_PLACES, TASKS = 16_384, 20_000


def chunk_draws(chunk: int, n: int, resamples: int, seed: int, size: int = CHUNK) -> np.ndarray:
    """How many of each resample's n draws fall into a chunk of ``size`` of n places.

    All draws are halved down a tree over the chunks: how many go left is binomial by the places on
    either side, and a node's generator is keyed by the node, so whoever walks down to a chunk finds the same.
    """
    low, high, draws = 0, -(-n // size), np.full(resamples, n, np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left, all_ = (middle - low) * size, min(high * size, n) - low * size
        down = np.random.default_rng([seed, low, high]).binomial(draws, left / all_)
        low, high, draws = (low, middle, down) if chunk < middle else (middle, high, draws - down)
    return draws


def chunk_counts(chunk: int, n: int, resamples: int, seed: int, size: int = CHUNK) -> np.ndarray:
    """(places of the chunk, resamples): how often each place is drawn; a resample's counts over all chunks add up to n."""
    places = min(size, n - chunk * size)
    rng = np.random.default_rng([seed, chunk, chunk + 1, 1])
    counts = [np.bincount(rng.integers(0, places, t), minlength=places) for t in chunk_draws(chunk, n, resamples, seed, size)]
    return np.array(counts, np.int16).T.reshape(places, resamples)


def counted_bootstrap(
    df: DataFrame, place: str, n: int, statistics: dict[str, Callable[[Column], Column]], resamples: int, seed: int, by: Sequence[str] = (), size: int = CHUNK
) -> DataFrame:
    """(by, b, statistics): as ``bootstrap``, but each resample has exactly n draws with replacement of the places 0 to n - 1.

    All rows of a place share its counts; a row whose place is null or isn't one of these is never drawn.
    The rows are dealt once, by ranges of chunks and a hash within them (a chunk of very many rows is split, its tasks
    draw alike), and get an array of their counts, so what is shuffled doesn't grow with the resamples but for a
    partial sum a task. A task takes TASK_PLACES places, as each row becomes up to ``resamples`` of them.
    """
    ship_package(df.sparkSession)
    schema = StructType([*df.schema.fields, StructField("__counts", ArrayType(ShortType()))])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, counts = -1, np.zeros((0, resamples), np.int16)
        for batch in batches:
            at = batch.column(batch.schema.get_field_index(place)).to_numpy(zero_copy_only=False).astype(np.int64)
            drawn = np.empty((len(at), resamples), np.int16)
            chunks = at // size
            for chunk in np.unique(chunks):
                if chunk != last:
                    last, counts = chunk, chunk_counts(int(chunk), n, resamples, seed, size)
                mine = chunks == chunk
                drawn[mine] = counts[at[mine] - chunk * size]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * resamples), pa.array(drawn.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "__counts"])

    known = df.where(F.col(place).between(0, n - 1))
    tasks = min(TASKS, max(1, -(-n // TASK_PLACES)))
    dealt = known.withColumns({"__chunk": F.expr(f"`{place}` div {size}"), "__salt": F.xxhash64(*known.columns)}).repartitionByRange(tasks, "__chunk", "__salt")
    dealt = dealt.sortWithinPartitions("__chunk").drop("__chunk", "__salt")
    rows = dealt.mapInArrow(counted, schema).select("*", F.posexplode("__counts").alias("b", "__w")).where("__w > 0")
    return rows.groupBy(*by, "b").agg(*(f(F.col("__w")).alias(name) for name, f in statistics.items()))


#: Times that a resample is drawn until it has all classes.
ATTEMPTS = 20


def redrawn_bootstrap(df: DataFrame, place: str, label: str, n: int, resamples: int, seed: int, attempts: int = ATTEMPTS) -> DataFrame:
    """(b, attempt, k, columns of df): as ``index_bootstrap``, a resample without a row of each class being drawn again.

    Draws are keyed by resample and attempt, and only the resamples that failed are drawn again, so
    a round's work shrinks with the failures; one that fails every time is left out.
    """
    df = written(df)  # every attempt reads it twice
    spark, classes = df.sparkSession, df.where(F.col(label).isNotNull()).select(label).distinct().count()
    left, parts = spark.range(resamples).select(F.col("id").alias("b")), []
    for attempt in range(attempts if n > 0 else 0):
        # places come from a range, not from an array of n numbers, which the driver would make and keep in every plan
        drawn = spark.range(n).withColumnRenamed("id", "k").crossJoin(F.broadcast(left)).select("b", F.lit(attempt).alias("attempt"), "k")
        drawn = drawn.withColumn("__at", draw((F.col("b") * attempts + attempt) * n + F.col("k"), seed, n))
        rows = df.join(drawn, F.col(place) == F.col("__at")).drop("__at")
        good = written(rows.groupBy("b").agg(F.count_distinct(label).alias("c")).where(F.col("c") == classes).select("b"))
        parts.append(rows.join(good, "b", "left_semi"))
        left = written(left.join(good, "b", "left_anti"))
        if not left.limit(1).count():
            break
    return reduce(DataFrame.unionByName, parts) if parts else df.limit(0).select(F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("attempt"), F.lit(0).cast("bigint").alias("k"), *df.columns)


def bca(df: DataFrame, id_col: str, statistic: Callable[[Column], Column], resamples: int, seed: int, level: float = 0.95, blocks: int = 200) -> DataFrame:
    """(est, lo, hi): bias-corrected and accelerated interval of any statistic that is an aggregate of a weight column.

    The acceleration is from a jackknife that leaves out one of ``blocks`` blocks of subjects at a time,
    weights of 0 and 1 in the same single pass as a bootstrap; where the correction is undefined it is the percentile interval.
    """
    weighed = df.withColumns({"__w": F.lit(1), "__block": F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(blocks)).cast("int")})
    base = weighed.agg(statistic(F.col("__w")).alias("est"))
    left_out = weighed.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("__w", (F.col("j") != F.col("__block")).cast("int"))
    jack = left_out.groupBy("j").agg(statistic(F.col("__w")).alias("x")).where("x is not null")
    mean = jack.agg(F.avg("x").alias("m"))
    d = F.col("m") - F.col("x")
    accel = jack.crossJoin(F.broadcast(mean)).agg(F.coalesce(F.try_divide(F.sum(d * d * d), 6 * F.pow(F.sum(d * d), 1.5)), F.lit(0.0)).alias("accel"))
    samples = bootstrap(df, id_col, {"x": statistic}, resamples, seed)
    return _corrected(samples, base.crossJoin(F.broadcast(accel)), level)


def distribution(samples: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, b, metric, value): the resampled values of each metric as rows, as violin plots take them; undefined ones are left out."""
    long = samples.select(*by, "b", *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot([*by, "b"], list(metrics), "metric", "value")
    return long.where("value is not null")


def percentile_interval(samples: DataFrame, value: str, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """(by, n, mean, lo, hi) of the resamples where the statistic is defined."""
    tail = (1 - level) / 2
    return samples.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, tail).alias("lo"), F.percentile(value, 1 - tail).alias("hi"))


def basic_interval(samples: DataFrame, estimate: float, value: str, level: float = 0.95) -> DataFrame:
    """(est, lo, hi): the percentile interval mirrored at the estimate."""
    s = percentile_interval(samples, value, (), level)
    return s.select(F.lit(estimate).alias("est"), (2 * estimate - F.col("hi")).alias("lo"), (2 * estimate - F.col("lo")).alias("hi"))


def bca_mean(df: DataFrame, id_col: str, value: str, resamples: int, seed: int, level: float = 0.95) -> DataFrame:
    """(est, lo, hi): bias-corrected and accelerated interval of a mean, such as accuracy or mean error.

    Leave-one-out means of n values have the acceleration sum(d^3) / (6 sum(d^2)^1.5) with d the
    values' own deviations over n - 1, so the jackknife is one aggregation. If the correction is
    undefined the percentile interval is given.
    """
    x, w = F.col(value).cast("double"), lambda weight: F.try_divide(F.sum(weight * F.col(value)), F.sum(weight))
    known = df.where(x.isNotNull())
    base = known.agg(F.avg(x).alias("est"), F.count(x).alias("n"), F.var_pop(x).alias("v"), F.skewness(x).alias("s"))
    base = base.withColumn("accel", F.coalesce(F.col("s") / (6 * F.sqrt("n")), F.lit(0.0)))
    samples = bootstrap(known, id_col, {"x": w}, resamples, seed)
    return _corrected(samples, base, level)


def _corrected(samples: DataFrame, base: DataFrame, level: float) -> DataFrame:
    """(est, lo, hi) from resampled values x and the estimate and acceleration, a row (est, accel)."""
    lower = F.avg(F.when(F.col("x") < F.col("est"), 1.0).when(F.col("x") == F.col("est"), 0.5).otherwise(0.0))
    s = samples.crossJoin(F.broadcast(base)).where("x is not null").groupBy("est", "accel").agg(lower.alias("below"), F.sort_array(F.collect_list("x")).alias("xs"))
    z0 = normal_quantile("below")
    tails = [(1 - level) / 2, 1 - (1 - level) / 2]
    from statistics import NormalDist

    s = s.withColumn("z0", z0)
    for name, tail in zip(("p_lo", "p_hi"), tails):
        z = F.col("z0") + NormalDist().inv_cdf(tail)
        adjusted = normal_cdf(F.col("z0") + z / (1 - F.col("accel") * z))
        s = s.withColumn(name, F.when(F.abs("z0") == float("inf"), tail).otherwise(adjusted))

    def quantile(p: str) -> Column:
        at = F.col(p) * (F.size("xs") - 1)
        i = F.floor(at).cast("int")
        low, high = F.get("xs", i), F.get("xs", F.least(i + 1, F.size("xs") - 1))
        return low + (high - low) * (at - i)

    return s.select("est", quantile("p_lo").alias("lo"), quantile("p_hi").alias("hi"))


def resampling_p(difference: Column, doubled: bool = False) -> Column:
    """Share of resampled differences on the wrong side of 0, ties half; doubled for two sides."""
    below = F.avg(F.when(difference < 0, 1.0).when(difference == 0, 0.5).when(difference > 0, 0.0))
    return F.least(F.lit(1.0), 2 * F.least(below, 1 - below)) if doubled else below
