"""Models from sufficient statistics, nearest neighbours, and the registry of Spark's own estimators.

Linear and Gaussian models need only sums of products of the features, so one aggregation over the
data gives all that is fitted from: for each fold, if asked. What the driver solves is of the size
of the features, never of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.session import written

#: Queries of a nearest-neighbour search that are broadcast; more meet the rows in blocks of about so many queries and rows.
MOST_QUERIES, MOST_ROWS = 20_000, 50_000
NEAR = "query_id long, id long, distance double"
#: Differences of coordinates, and distances, that a task holds at once.
CELLS = 1_000_000


# --- scaling, filling, regressing out: fitted on training rows, applied to all


def standardised(df: DataFrame, columns: Sequence[str], train: Column | None = None) -> DataFrame:
    """The columns less their training mean over their training population SD (1 if that is 0)."""
    use = F.lit(True) if train is None else train
    stats = df.agg(*(f(F.when(use, F.col(c))).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    scaled = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") == 0, 1.0).otherwise(F.col(f"__s_{c}")) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).select(*df.columns)


def standardised_alike(df: DataFrame, columns: Sequence[str], train: Column, count: Column) -> DataFrame:
    """``standardised`` over rows that stand for so many each; nothing but a mean and an SD a column reaches the driver."""
    rows = df.where(train).select(*(F.col(c).cast("double").alias(c) for c in columns), count.alias("__n"))
    mean = lambda x, c: F.sum(F.col("__n") * x) / F.sum(F.when(F.col(c).isNotNull(), F.col("__n")))
    m = [x or 0.0 for x in rows.agg(*(mean(F.col(c), c) for c in columns)).first()]
    s = rows.agg(*(F.sqrt(mean((F.col(c) - x) * (F.col(c) - x), c)) for c, x in zip(columns, m))).first()
    return df.withColumns({c: (F.col(c) - x) / (y or 1.0) for c, x, y in zip(columns, m, s)})


def min_max_scaled(df: DataFrame, columns: Sequence[str], train: Column | None = None) -> DataFrame:
    """The columns from 0 to 1 on training rows; a constant column becomes 0."""
    use = F.lit(True) if train is None else train
    stats = df.agg(*(f(F.when(use, F.col(c))).alias(f"__{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))))
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__a_{c}"), F.col(f"__b_{c}") - F.col(f"__a_{c}")), F.when(F.col(c).isNotNull(), 0.0)) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).select(*df.columns)


@dataclass(frozen=True)
class Moments:
    """Sums over rows with every feature and the target known: of products of 1, the features and the target.

    The columns are less a centre and over a scale, those of all rows, so the sums of large values with
    small spreads keep their digits, and those of parts of the rows can be added and subtracted.
    """

    features: tuple[str, ...]
    matrix: np.ndarray  # of (1, features..., target), centred and scaled, so matrix[0, 0] is the number of rows
    centre: np.ndarray  # of features and target
    scale: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.features, self.matrix + other.matrix, self.centre, self.scale)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.features, self.matrix - other.matrix, self.centre, self.scale)

    @property
    def n(self) -> float:
        return float(self.matrix[0, 0])

    @property
    def mean(self) -> np.ndarray:
        return self.centre + self.scale * self.matrix[0, 1:] / self.n

    @property
    def scatter(self) -> np.ndarray:
        """Sums of products of deviations from the means."""
        m = self.matrix[0, 1:]
        return (self.matrix[1:, 1:] - np.outer(m, m) / self.n) * np.outer(self.scale, self.scale)


#: Columns of which every product is an aggregate of its own; more are multiplied as matrices in Arrow batches.
MOST_AGGREGATES = 16


def moments(df: DataFrame, features: Sequence[str], target: str, by: str | None = None) -> dict[object, Moments]:
    """Moments of each value of by (None if not given): a pass for centre and scale, one for the sums, partial in every task."""
    names = [*features, target]
    cols = [f"c{i}" for i in range(len(names))]
    rows = df.select(*([F.col(by).alias("__by")] if by else [F.lit(None).cast("int").alias("__by")]), *(F.col(n).cast("double").alias(c) for c, n in zip(cols, names)))
    rows = rows.dropna(subset=cols)
    found = rows.agg(*(f(c) for c in cols for f in (F.avg, F.stddev_pop))).first()
    if found[0] is None:
        return {}
    centre, scale = np.array(found[::2], float), np.array([s or 1.0 for s in found[1::2]], float)
    rows = rows.select("__by", *(((F.col(c) - float(m)) / float(s)).alias(c) for c, m, s in zip(cols, centre, scale)))
    k = len(cols) + 1
    if k <= MOST_AGGREGATES:
        rows, every = rows.withColumn("one", F.lit(1.0)), ["one", *cols]
        pairs = [(i, j) for i in range(k) for j in range(i + 1)]
        sums = rows.groupBy("__by").agg(*(F.sum(F.col(every[i]) * F.col(every[j])).alias(f"s{i}_{j}") for i, j in pairs)).collect()  # a row a group
        parts = [(r["__by"], i, j, r[f"s{i}_{j}"]) for r in sums for i, j in pairs]
    else:
        parts = _products(rows, cols).collect()  # k * k rows a group
    out = {}
    for key, i, j, total in parts:
        m = out.setdefault(key, Moments(tuple(features), np.zeros((k, k)), centre, scale)).matrix
        m[i, j] = m[j, i] = total
    return out


def _products(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(by, i, j, total): sums of products of (1, columns), as a matrix a task and group, added up by Spark."""
    k = len(cols) + 1

    def run(batches):
        total: dict = {}
        for batch in batches:
            for key, part in batch.groupby("__by", dropna=False, sort=False):
                x = np.hstack((np.ones((len(part), 1)), part[cols].to_numpy(float)))
                total[None if pd.isna(key) else key] = total.get(None if pd.isna(key) else key, 0) + x.T @ x
        i, j = np.tril_indices(k)
        for key, m in total.items():
            yield pd.DataFrame({"__by": pd.Series([key] * len(i), dtype=object), "i": i, "j": j, "total": m[i, j]})

    kind = rows.schema["__by"].dataType.simpleString()
    return rows.mapInPandas(run, f"__by {kind}, i int, j int, total double").groupBy("__by", "i", "j").agg(F.sum("total").alias("total"))


def ridge(m: Moments, penalty: float = 0.0, use: Sequence[int] | None = None) -> np.ndarray:
    """Intercept and coefficients (0 for unused features) of least squares with an L2 penalty per row."""
    k = len(m.features)
    used = list(range(k) if use is None else use)
    at = [0, *(1 + i for i in used)]
    a = m.matrix[np.ix_(at, at)].copy()
    a[range(1, len(at)), range(1, len(at))] += penalty * m.n / m.scale[used] ** 2
    found = np.linalg.lstsq(a, m.matrix[at, k + 1], rcond=None)[0]
    out = np.zeros(k + 1)
    out[at[1:]] = found[1:] * m.scale[k] / m.scale[used]
    out[0] = m.centre[k] + m.scale[k] * found[0] - out[1:] @ m.centre[:k]
    return out


def elastic_net(m: Moments, penalty: float, l1_share: float = 1.0, rounds: int = 1000) -> np.ndarray:
    """Intercept and coefficients of half the mean squared error plus an elastic penalty (lasso at share 1)."""
    k = len(m.features)
    mean, cov = m.mean, m.scatter / m.n
    xx, xy, b = cov[:k, :k], cov[:k, k], np.zeros(k)
    for _ in range(rounds):
        before = b.copy()
        for j in range(k):
            rho = xy[j] - xx[j] @ b + xx[j, j] * b[j]
            b[j] = np.sign(rho) * max(abs(rho) - penalty * l1_share, 0) / (xx[j, j] + penalty * (1 - l1_share) or 1.0)
        if (np.abs(b - before) * m.scale[:k]).max(initial=0) < 1e-10 * m.scale[k]:
            break
    return np.append(mean[k] - mean[:k] @ b, b)


def mean_squared_error(m: Moments, coefficients: np.ndarray) -> float:
    c = np.asarray(coefficients, float)
    b = np.concatenate(([c[0] + c[1:] @ m.centre[:-1] - m.centre[-1]], c[1:] * m.scale[:-1], [-m.scale[-1]]))
    return float(b @ m.matrix @ b) / m.n if m.n else float("nan")


def linear(features: Sequence[str], coefficients: Sequence[float]) -> Column:
    """The prediction as an expression."""
    return sum((F.col(c) * float(b) for c, b in zip(features, coefficients[1:])), F.lit(float(coefficients[0])))


def regressed_out(df: DataFrame, columns: Sequence[str], covariates: Sequence[str], train: Column | None = None) -> DataFrame:
    """The columns as residuals of a linear model of the covariates, fitted on training rows; a missing covariate gives null."""
    rows = df if train is None else df.where(train)
    out = {}
    for c in columns:
        found = moments(rows, covariates, c)
        out[c] = F.col(c) - linear(covariates, ridge(found[None])) if found else F.col(c)
    return df.withColumns(out)


def attributions(df: DataFrame, features: Sequence[str], coefficients: Sequence[float]) -> DataFrame:
    """df with phi_<feature>: coefficient times the distance from the mean, a linear model's exact Shapley values."""
    means = df.agg(*(F.avg(c).alias(f"__m_{c}") for c in features))
    phi = {f"phi_{c}": (F.col(c) - F.col(f"__m_{c}")) * float(b) for c, b in zip(features, coefficients[1:])}
    return df.crossJoin(F.broadcast(means)).select(*df.columns, *(e.alias(n) for n, e in phi.items()))


def importances(features: Sequence[str], coefficients: Sequence[float], spark) -> DataFrame:
    """(feature, importance): shares of the absolute coefficients; NaN, as in SQL, if all are 0 and there is nothing to share."""
    size = np.abs(np.asarray(coefficients, float)[1:])
    return spark.createDataFrame([(f, float(s / (size.sum() or np.nan))) for f, s in zip(features, size)], "feature string, importance double")


# --- Gaussian models


def gaussian_model(df: DataFrame, features: Sequence[str], label: str, kind: str = "lda", smoothing: float = 1e-9) -> dict[object, tuple[float, np.ndarray, np.ndarray]]:
    """Log prior, mean and covariance of each class: shared (lda), own (qda), or own and diagonal (nb).

    smoothing: that share of the widest variance is added to all of them.
    """
    per = moments(df.where(F.col(label).isNotNull()), features, features[0], label)
    k, total = len(features), sum(m.n for m in per.values())
    out, shared = {}, np.zeros((k, k))
    for c, m in per.items():
        scatter = m.scatter[:k, :k]
        shared += scatter
        cov = scatter / (m.n if kind == "nb" else max(1.0, m.n - 1))
        out[c] = (float(np.log(m.n / total)), m.mean[:k], np.diag(np.diag(cov)) if kind == "nb" else cov)
    widest = max((np.diag(s).max() for _, _, s in out.values()), default=1.0)
    cov = shared / max(1.0, total - len(out))
    return {c: (p, m, (cov if kind == "lda" else s) + smoothing * widest * np.eye(k)) for c, (p, m, s) in out.items()}


def gaussian_scores(features: Sequence[str], model: dict[object, tuple[float, np.ndarray, np.ndarray]]) -> dict[object, Column]:
    """Per class the log of prior and density, but for a constant, as an expression; for few features or diagonal covariances."""
    out = {}
    for c, (prior, mean, cov) in model.items():
        inverse, (_, logdet) = np.linalg.inv(cov), np.linalg.slogdet(cov)
        d = [F.col(f) - float(m) for f, m in zip(features, mean)]
        terms = [float(inverse[i, i]) * d[i] * d[i] for i in range(len(d))]
        terms += [float(2 * inverse[i, j]) * d[i] * d[j] for i in range(len(d)) for j in range(i) if inverse[i, j]]
        out[c] = F.lit(prior - 0.5 * float(logdet)) - 0.5 * sum(terms[1:], terms[0])
    return out


def gaussian_posteriors(vector: Column, model: dict[object, tuple[float, np.ndarray, np.ndarray]]) -> Column:
    """The posterior of every class, in the classes' order, of an array of features, a matrix product a batch; null if a feature is missing."""
    classes = sorted(model)
    factors = [np.linalg.cholesky(np.linalg.inv(model[c][2])) for c in classes]
    constants = [model[c][0] - 0.5 * float(np.linalg.slogdet(model[c][2])[1]) for c in classes]
    means = [model[c][1] for c in classes]

    @F.pandas_udf("array<double>")
    def posteriors(rows: pd.Series) -> pd.Series:
        x = np.array([v if v is not None else [np.nan] * len(means[0]) for v in rows], float).reshape(len(rows), -1)
        logs = np.stack([c - 0.5 * (((x - m) @ f) ** 2).sum(1) for c, m, f in zip(constants, means, factors)], axis=1)
        p = np.exp(logs - logs.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return pd.Series([None if np.isnan(r).any() else r.tolist() for r in p], dtype=object)

    return posteriors(vector)


def likeliest(posteriors: Column, classes: Sequence[object]) -> Column:
    """The class of the largest posterior; ties to the one that sorts first."""
    return F.get(F.array(*map(F.lit, sorted(classes))), F.array_position(posteriors, F.array_max(posteriors)).cast("int") - 1)


def most_likely(scores: dict[object, Column]) -> Column:
    """The class of the largest score; ties to the one that sorts first."""
    pairs = [F.struct((-s).alias("s"), F.lit(c).alias("c")) for c, s in sorted(scores.items())]
    return F.array_min(F.array(*pairs))["c"]


# --- nearest neighbours: a query set against all rows, in numpy blocks


def nearest(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, k: int, most_queries: int = MOST_QUERIES, most_rows: int = MOST_ROWS, digits: int | None = None) -> DataFrame:
    """(query_id, id, distance, place): each query's k nearest rows other than itself, ties by id.

    digits: distances are rounded to so many before they are compared, so what differs by less is a tie. A null coordinate is left out of the distances (see ``_distances``). Up to ``most_queries`` counted
    queries are broadcast, and every task compares its rows with them. Of more, those of equal vectors ask once, and
    of rows of equal vectors only the smallest ids are looked at, as no others can be among the nearest; they meet the rows of their ranges of
    one coordinate, and if that settles them not, they are dealt by a hash into
    blocks of about so many, and the rows into chunks of about ``most_rows``; each block meets each
    chunk in a task of its own, and the queries never reach the driver. Either way k rows a query
    and task are shuffled for the last choice.
    """
    vectors, others = (df.select(F.col(id_col).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v")).where("v is not null") for df in (queries, rows))
    asked = vectors.count()
    # one more is looked for, as a query may itself be among the rows
    found = _nearest_of(vectors, others, k + 1, digits) if asked <= most_queries else _nearest_of_alike(vectors, others, k + 1, most_queries, most_rows, digits)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.where("query_id <> id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _nearest_of_alike(vectors: DataFrame, others: DataFrame, k: int, most_queries: int, most_rows: int, digits: int | None = None) -> DataFrame:
    """Each different vector's k nearest rows, for all queries that have it; of each different vector's rows the k smallest ids are candidates."""
    vectors = written(vectors)
    different = written(vectors.groupBy("v").agg(F.min("i").alias("i")))
    first = F.row_number().over(Window.partitionBy("v").orderBy("i"))  # a task passes on no more than k a vector
    few = others.withColumn("n", first).where(F.col("n") <= k).select("i", "v")
    found = _nearest_by_ranges(different, few, k, most_queries, most_rows, digits)
    asking = vectors.withColumnRenamed("i", "asking").join(different, "v").select("asking", F.col("i").alias("query_id"))
    return asking.join(found, "query_id").select(F.col("asking").alias("query_id"), "id", "distance")


def _nearest_in_blocks(vectors: DataFrame, others: DataFrame, k: int, asked: int, most_queries: int, most_rows: int, digits: int | None = None) -> DataFrame:
    """Every block of queries meets every chunk of rows."""
    blocks, chunks = -(-asked // most_queries), max(1, -(-others.count() // most_rows))
    part = lambda n: F.pmod(F.xxhash64("i"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = vectors.withColumn("block", part(blocks)).withColumn("chunk", every(chunks))
    b = others.withColumn("chunk", part(chunks)).withColumn("block", every(blocks))
    meet = lambda q, x: _closest(*_vectors(q), [x], k, digits)
    return a.groupBy("block", "chunk").cogroup(b.groupBy("block", "chunk")).applyInPandas(meet, NEAR)


def _nearest_by_ranges(vectors: DataFrame, others: DataFrame, k: int, most_queries: int, most_rows: int, digits: int | None = None) -> DataFrame:
    """Queries meet the rows of their own and both neighbouring ranges of one coordinate, which every row has.

    No other row is within a range's width, so a query whose k-th neighbour is that near is done; the rest look
    eight times as far (rounding brings a row nearer by less than a unit of the last digit). When ranges would hold over ``most_rows`` rows, or no coordinate is always there, what is left meets all rows in blocks.
    """
    rest, others, parts = written(vectors), written(others), []
    width = others.select(F.size("v")).first()
    x = lambda j: F.get("v", F.lit(j))
    both = rest.select("v", F.lit(0).alias("o")).unionByName(others.select("v", F.lit(1).alias("o")))
    found = both.agg(*(f for j in range(width[0] if width else 0) for f in (F.count_if(x(j).isNull() | F.isnan(x(j)) | (F.abs(x(j)) == float("inf"))), F.max(x(j)) - F.min(x(j)), F.approx_count_distinct(x(j))))).first() if width and width[0] else ()
    known = [(found[3 * j + 2], j, found[3 * j + 1]) for j in range(len(found) // 3) if not found[3 * j] and found[3 * j + 1]]
    left, unit = rest.count(), 0.0 if digits is None else 10.0**-digits
    if known:
        _, axis, span = max(known)
        step = span * min(1.0, 32 * k / max(1, others.count()))
        while left:
            ranges = F.floor(x(axis) / step)
            b = others.withColumn("r", F.explode(F.array(ranges - 1, ranges, ranges + 1)))
            if (b.groupBy("r").count().agg(F.max("count")).first()[0] or 0) > most_rows:
                break
            meet = lambda q, y: _closest(*_vectors(q), [y], k, digits)
            near = written(rest.withColumn("r", ranges).groupBy("r").cogroup(b.groupBy("r")).applyInPandas(meet, NEAR))
            done = near.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far")).where((F.col("n") >= k) & (F.col("far") < step * (1 - 1e-9) - unit) if step <= span else F.lit(True)).select("query_id")
            if step > span:  # all rows were met
                return reduce(DataFrame.unionByName, [*parts, near])
            parts.append(near.join(done, "query_id", "left_semi"))
            rest = written(rest.join(done.withColumnRenamed("query_id", "i"), "i", "left_anti").select("i", "v"))
            left, step = rest.count(), 8 * step
    if left:
        parts.append(_nearest_of(rest, others, k, digits) if left <= most_queries else _nearest_in_blocks(rest, others, k, left, most_queries, most_rows, digits))
    return reduce(DataFrame.unionByName, parts) if parts else _nearest_of(rest, others, k, digits)


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances; where coordinates are missing, of those present in both, scaled up to all of them."""
    squares = (q[:, None, :] - x[None, :, :]) ** 2
    missing = np.isnan(squares)
    if not missing.any():
        return np.sqrt(squares.sum(axis=2))
    present = (~missing).sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.sqrt(np.where(missing, 0.0, squares).sum(axis=2) * squares.shape[2] / present)
    return np.where(present > 0, d, np.inf)


def _least(d: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest distances of each row and their ids, ties by id; only what is no further than the k-th is sorted."""
    row, at = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
    order = np.lexsort((i[row, at], d[row, at], row))
    row, at = row[order], at[order]
    first = np.arange(len(row)) - np.searchsorted(row, np.arange(len(d)))[row] < k
    row, at = row[first], at[first]
    return d[row, at].reshape(-1, k), i[row, at].reshape(-1, k)


def _half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """x, not negative, rounded, halves up; what isn't finite stays."""
    with np.errstate(invalid="ignore"):
        many = x * 10.0**digits
        whole = np.floor(many)
        return np.where(np.isfinite(x), (whole + (many - whole >= 0.5)) / 10.0**digits, x)


def _vectors(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = df["i"].to_numpy(np.int64)
    return ids, np.array(df["v"].tolist(), float).reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))


def _closest(q_ids: np.ndarray, q: np.ndarray, batches: Iterable[pd.DataFrame], k: int, digits: int | None = None) -> pd.DataFrame:
    """The k nearest of all batches' rows to each query, some rows at a time."""
    best_d, best_i = np.full((len(q_ids), k), np.inf), np.full((len(q_ids), k), np.iinfo(np.int64).max)
    at_once = max(1, CELLS // max(1, len(q_ids)))
    for batch in batches if len(q_ids) else ():
        for a in range(0, len(batch), at_once):
            i, x = _vectors(batch.iloc[a : a + at_once])
            some = max(1, CELLS // max(1, x.size))
            d = np.concatenate([_distances(q[j : j + some], x) for j in range(0, len(q), some)])
            if digits is not None:
                d = _half_up(d, digits)
            best_d, best_i = _least(np.hstack((best_d, d)), np.hstack((best_i, np.broadcast_to(i, d.shape))), k)
    at = np.isfinite(best_d)
    return pd.DataFrame({"query_id": np.repeat(q_ids, at.sum(axis=1)), "id": best_i[at], "distance": best_d[at]})


def _nearest_of(queries: DataFrame, rows: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The search of few queries, counted before, that are broadcast."""
    sent = rows.sparkSession.sparkContext.broadcast(_vectors(queries.toPandas()))

    def run(batches):
        yield _closest(*sent.value, batches, k, digits)

    return rows.mapInPandas(run, NEAR)


def knn_classify(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, label: str, k: int = 5, digits: int | None = None) -> DataFrame:
    """(query_id, pred): the most frequent label of the k nearest rows, ties to the smallest."""
    near = nearest(queries, rows, id_col, vector, k, digits=digits).join(rows.select(F.col(id_col).alias("id"), F.col(label).alias("__label")), "id")
    votes = near.groupBy("query_id", "__label").agg(F.count("*").alias("n"))
    return votes.groupBy("query_id").agg(F.max(F.struct("n", (-F.col("__label")).alias("c"))).alias("x")).select("query_id", (-F.col("x.c")).alias("pred"))


def knn_regress(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, target: str, k: int = 5) -> DataFrame:
    near = nearest(queries, rows, id_col, vector, k).join(rows.select(F.col(id_col).alias("id"), F.col(target).alias("__y")), "id")
    return near.groupBy("query_id").agg(F.avg("__y").alias("pred"))


def knn_impute(df: DataFrame, id_col: str, column: str, others: Sequence[str], k: int = 5, train: Column | None = None) -> DataFrame:
    """df with the column's nulls as the mean of the k nearest (training) rows where it is known, by the other columns.

    Distances are over the coordinates that both rows have, scaled up to all; a row with none stays null.
    """
    use = F.lit(True) if train is None else train
    rows = df.withColumn("__v", F.array(*(F.col(c).cast("double") for c in others)))
    missing = rows.where(F.col(column).isNull())
    pred = knn_regress(missing, rows.where(F.col(column).isNotNull() & use), id_col, "__v", column, k)
    out = df.join(pred.withColumnRenamed("query_id", id_col), id_col, "left")
    return out.withColumn(column, F.coalesce(column, "pred")).select(*df.columns)


# --- Spark's estimators by name


def _logistic(**p):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(regParam=p.get("penalty", 0.0), standardization=False, maxIter=p.get("rounds", 100))


def _forest(**p):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(numTrees=p.get("trees", 100), maxDepth=p.get("depth", 5), seed=p.get("seed", 42))


def _forest_regression(**p):
    from pyspark.ml.regression import RandomForestRegressor

    return RandomForestRegressor(numTrees=p.get("trees", 100), maxDepth=p.get("depth", 5), seed=p.get("seed", 42))


def _boosted(**p):
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(maxIter=p.get("trees", 50), maxDepth=p.get("depth", 5), stepSize=p.get("step", 0.1), seed=p.get("seed", 42))


def _boosted_regression(**p):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(maxIter=p.get("trees", 50), maxDepth=p.get("depth", 5), stepSize=p.get("step", 0.1), seed=p.get("seed", 42))


def _second_order(regression: bool):
    def make(**p):
        from .boosting import Boosting

        return Boosting(regression=regression, **p)

    return make


def _kernel_machine(regression: bool):
    def make(**p):
        from .kernels import KernelMachine

        return KernelMachine(regression=regression, **p)

    return make


def _support_vectors(**p):
    from pyspark.ml.classification import LinearSVC

    return LinearSVC(regParam=p.get("penalty", 0.0), maxIter=p.get("rounds", 100))


def _linear(l1: float):
    def make(**p):
        from pyspark.ml.regression import LinearRegression

        return LinearRegression(regParam=p.get("penalty", 0.1), elasticNetParam=p.get("l1_share", l1), standardization=False)

    return make


#: The number of a row of a fit, by which neighbours' search knows rows.
ROW = "__row"


class Gaussian:
    """lda, qda or nb as an estimator of (features, label), the labels being 0, 1, ...; ``transform`` adds posterior and prediction."""

    def __init__(self, kind: str, smoothing: float):
        self.kind, self.smoothing = kind, smoothing

    def fit(self, rows: DataFrame) -> Gaussian:
        from pyspark.ml.functions import vector_to_array

        plain = rows.select("label", vector_to_array("features").alias("v"))
        width = plain.select(F.size("v")).first()[0]
        names = [f"x{i}" for i in range(width)]
        self.model = gaussian_model(plain.select("label", *(F.col("v")[i].alias(n) for i, n in enumerate(names))), names, "label", self.kind, self.smoothing)
        self.numClasses = int(max(self.model)) + 1
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        classes = sorted(self.model)
        found = gaussian_posteriors(vector_to_array("features"), self.model)
        of = {int(c): i for i, c in enumerate(classes)}
        every = F.array(*(F.get("__p", F.lit(of[c])) if c in of else F.lit(0.0) for c in range(self.numClasses)))
        out = rows.withColumn("__p", found).withColumn("prediction", likeliest(F.col("__p"), classes))
        return out.withColumn("posterior", every).drop("__p")


class Neighbours:
    """The k nearest rows as an estimator: their shares of the classes, or with regression their mean. Rows have a number, ROW."""

    def __init__(self, k: int, regression: bool):
        self.k, self.regression = k, regression

    def fit(self, rows: DataFrame) -> Neighbours:
        self.rows = self._plain(rows).withColumn("label", F.col("label"))
        if not self.regression:
            self.numClasses = int(rows.agg(F.max("label")).first()[0] or 0) + 1
        return self

    @staticmethod
    def _plain(rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        return rows.select(F.col(ROW).alias("i"), vector_to_array("features").alias("v"), "label")

    def transform(self, rows: DataFrame) -> DataFrame:
        near = nearest(self._plain(rows), self.rows, "i", "v", self.k).join(self.rows.select(F.col("i").alias("id"), "label"), "id").groupBy("query_id")
        if self.regression:
            found = near.agg(F.avg("label").alias("prediction"))
        else:
            share = lambda c: F.avg((F.col("label") == c).cast("double"))
            found = near.agg(F.array(*(share(c) for c in range(self.numClasses))).alias("posterior"))
            found = found.withColumn("prediction", (F.array_position("posterior", F.array_max("posterior")) - 1).cast("double"))
        return rows.join(found, F.col(ROW) == F.col("query_id"), "left").drop("query_id")


#: Estimators that run distributed; their features column is a vector, see VectorAssembler.
ESTIMATORS: dict[str, Callable[..., object]] = {
    "lr": _logistic, "rf": _forest, "gbt": _boosted, "svc": _support_vectors, "rf_regression": _forest_regression, "gbt_regression": _boosted_regression,
    "lasso": _linear(1.0), "ridge": _linear(0.0), "elastic": _linear(0.5),
    "svc_rbf": _kernel_machine(False), "svr": _kernel_machine(True), "xgb": _second_order(False), "xgb_regression": _second_order(True),
    "knn": lambda **p: Neighbours(p.get("k", 5), False), "knn_regression": lambda **p: Neighbours(p.get("k", 5), True),
    "lda": lambda **p: Gaussian("lda", p.get("smoothing", 1e-9)), "qda": lambda **p: Gaussian("qda", p.get("smoothing", 1e-9)), "nb": lambda **p: Gaussian("nb", p.get("smoothing", 1e-9)),
}


def estimator(name: str, **parameters):
    if name not in ESTIMATORS:
        raise KeyError(f"no estimator {name!r}; there are {sorted(ESTIMATORS)}")
    return ESTIMATORS[name](**parameters)


def rbf_features(df: DataFrame, features: Sequence[str], out: str, width: float, components: int = 128, seed: int = 42) -> DataFrame:
    """df with random Fourier features of a Gaussian kernel, which give a linear model an RBF one's shape."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, 1 / width, (components, len(features))), rng.uniform(0, 2 * np.pi, components)
    scale = float(np.sqrt(2 / components))
    x = F.array(*(F.col(c).cast("double") for c in features))
    weights = F.array(*(F.struct(F.array(*map(F.lit, map(float, row))).alias("w"), F.lit(float(c)).alias("b")) for row, c in zip(w, b)))
    dot = lambda r: F.aggregate(F.zip_with(r["w"], x, lambda p, q: p * q), F.lit(0.0), lambda a, v: a + v)
    return df.withColumn(out, F.transform(weights, lambda r: scale * F.cos(dot(r) + r["b"])))
