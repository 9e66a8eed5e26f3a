"""Evaluation of scores: labels joined with documents, a score from the text's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions.scalars import draw_sql, rounded
from ..operators import describe, prepare, resample, select, split
from ..sources.session import table
from .registry import query

COSTS = ((0.0, 1.0), (2.0, 0.0))
SCORED = "SELECT d.doc_id, d.lang, d.source, l.quality AS y, l.toxic, d.n_chars, CAST(d.n_chars AS DOUBLE) AS score, d.n_chars / (d.n_chars + 1000.0::DOUBLE) AS p FROM labels l JOIN documents d USING (doc_id)"
#: A rank that ties share, and the area it gives.
AUC = "(sum(CASE WHEN y = 1 THEN r END) - n1 * (n1 + 1) / 2.0) / (n1 * n0)"
CURVE = f"""c AS (SELECT score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS neg FROM ({SCORED}) GROUP BY score),
  k AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM c WINDOW w AS (ORDER BY score DESC)),
  curve AS (SELECT score, CAST(fp AS DOUBLE) / n AS fpr, CAST(tp AS DOUBLE) / p AS tpr FROM k)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: y (quality), toxic, and two scores of the length; the texts aren't read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, sf_dir, "labels").withColumnRenamed("quality", "y").join(docs, "doc_id")
    n = F.col("n_chars").cast("double")
    return rows.withColumns({"score": n, "p": n / (n + 1000.0)})


@query(f"""WITH s AS ({SCORED}), g AS (SELECT lang AS slice, y, score FROM s UNION ALL SELECT 'all', y, score FROM s),
  r AS (SELECT slice, y, rank() OVER (PARTITION BY slice ORDER BY score) + (count(*) OVER (PARTITION BY slice, score) - 1) / 2.0::DOUBLE AS r,
        CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY slice) AS DOUBLE) AS n1, CAST(sum(CASE WHEN y <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY slice) AS DOUBLE) AS n0 FROM g),
  a AS (SELECT slice, round({AUC}, 6) AS auc FROM r WHERE n0 > 0 AND n1 > 0 GROUP BY slice, n1, n0)
  SELECT slice, auc, CAST(rank() OVER (ORDER BY auc DESC, slice) AS INTEGER) AS place FROM a""")
def auc_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the ROC curve per language and over all, ranked."""
    from pyspark.sql.window import Window

    rows = scored(spark, sf_dir).select("lang", "y", "score")
    slices = rows.select(F.explode(F.array("lang", F.lit("all"))).alias("slice"), "y", "score")
    areas = M.roc_auc(slices, "y", "score", ["slice"]).select("slice", rounded(F.col("auc")).alias("auc")).where("auc is not null")
    return areas.withColumn("place", F.rank().over(Window.orderBy(F.desc("auc"), "slice")))  # a row a language


@query(f"WITH {CURVE} SELECT score, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM curve")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = M.roc_curve(scored(spark, sf_dir), "y", "score")
    return curve.select("score", rounded(F.col("fpr")).alias("fpr"), rounded(F.col("tpr")).alias("tpr"))


@query(f"""WITH {CURVE}, g AS (SELECT CAST(i AS INTEGER) AS step, i / 99.0::DOUBLE AS x FROM range(100) t(i)),
  l AS (SELECT step, max(struct_pack(f := fpr, t := tpr)) AS l FROM g JOIN curve ON CAST(ceil(fpr * 99) AS INTEGER) <= step GROUP BY step),
  r AS (SELECT step, min(struct_pack(f := fpr, t := tpr)) AS r FROM g JOIN curve ON CAST(floor(fpr * 99) AS INTEGER) >= step GROUP BY step)
  SELECT round(x, 6) AS grid, round(CASE WHEN step = 0 THEN 0 WHEN step = 99 THEN 1 WHEN l IS NULL THEN r.t * x / r.f WHEN r.f - l.f <= 0 THEN l.t
    ELSE l.t + (r.t - l.t) * (x - l.f) / (r.f - l.f) END, 6) AS tpr FROM g LEFT JOIN l USING (step) LEFT JOIN r USING (step)""")
def roc_grid_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = M.on_grid(M.roc_curve(scored(spark, sf_dir), "y", "score"))
    return grid.select(rounded(F.col("grid")).alias("grid"), rounded(F.col("tpr")).alias("tpr"))


@query(f"""WITH s AS (SELECT lang, y, CASE WHEN p >= 0.6 THEN 1 ELSE 0 END AS d FROM ({SCORED})),
  c AS (SELECT lang, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN y = d THEN 1 ELSE 0 END) AS DOUBLE) AS hit, CAST(sum(y * d) AS DOUBLE) AS tp, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(d) AS DOUBLE) AS dpos,
        CAST(sum((1 - y) * (1 - d)) AS DOUBLE) AS tn FROM s GROUP BY lang)
  SELECT lang, round(hit / n, 6) AS accuracy, round(tp / nullif(pos, 0), 6) AS recall, round(tp / nullif(dpos, 0), 6) AS "precision", round(2 * tp / nullif(pos + dpos, 0), 6) AS f1,
    round(CASE WHEN pos = 0 THEN tn / n WHEN pos = n THEN tp / n ELSE (tp / pos + tn / (n - pos)) / 2 END, 6) AS balanced_accuracy FROM c""")
def clf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("d", M.threshold_decision(F.col("p"), 0.6))
    return rows.groupBy("lang").agg(*(rounded(f(F.col("y"), F.col("d"))).alias(n) for n, f in M.CLASSIFICATION.items()))


@query(f"""WITH s AS (SELECT y, CASE WHEN p >= 0.6 THEN 1 ELSE 0 END AS d FROM ({SCORED})), c AS (SELECT y, d, count(*) AS n FROM s GROUP BY y, d)
  SELECT y, d, n, round(n / sum(n) OVER (PARTITION BY y), 6) AS share FROM c""")
def confusion_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("d", M.threshold_decision(F.col("p"), 0.6))
    return describe.confusion(rows, "y", "d").withColumn("share", rounded(F.col("share")))


CLIPPED = "greatest(least(p, 0.99::DOUBLE), 0.01::DOUBLE) AS q1, greatest(least(1 - p, 0.99::DOUBLE), 0.01::DOUBLE) AS q0"


@query(f"SELECT doc_id, CASE WHEN 1.0 * q0 >= 2.0 * q1 THEN 0 ELSE 1 END AS decision FROM (SELECT doc_id, {CLIPPED} FROM ({SCORED}))")
def bayes_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = M.log_posteriors(F.array(1 - F.col("p"), F.col("p")))
    return scored(spark, sf_dir).select("doc_id", M.bayes_decision(logs, COSTS).alias("decision"))


@query(f"""WITH s AS (SELECT lang, y, CASE WHEN 1.0 * q0 >= 2.0 * q1 THEN 0 ELSE 1 END AS d FROM (SELECT lang, y, {CLIPPED} FROM ({SCORED})))
  SELECT lang, round(avg(CASE WHEN y = 0 AND d = 1 THEN 1.0 WHEN y = 1 AND d = 0 THEN 2.0 ELSE 0.0 END) / nullif(least(avg(CASE WHEN y = 1 THEN 2.0 ELSE 0.0 END), avg(CASE WHEN y = 0 THEN 1.0 ELSE 0.0 END)), 0), 6) AS norm_expected_cost
  FROM s GROUP BY lang""")
def expected_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = M.log_posteriors(F.array(1 - F.col("p"), F.col("p")))
    rows = scored(spark, sf_dir).withColumn("d", M.bayes_decision(logs, COSTS))
    return rows.groupBy("lang").agg(rounded(M.norm_expected_cost(F.col("y"), F.col("d"), COSTS)).alias("norm_expected_cost"))


@query(f"""WITH s AS (SELECT lang, y, ln(CASE WHEN y = 1 THEN q1 ELSE q0 END) AS l FROM (SELECT lang, y, {CLIPPED} FROM ({SCORED}))), g AS (SELECT lang, -avg(l) AS h, avg(y) AS p1 FROM s GROUP BY lang)
  SELECT lang, round(h, 6) AS cross_entropy, round(h / nullif((CASE WHEN p1 > 0 THEN -p1 * ln(p1) ELSE 0 END) + (CASE WHEN p1 < 1 THEN -(1 - p1) * ln(1 - p1) ELSE 0 END), 0), 6) AS norm_cross_entropy FROM g""")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("logs", M.log_posteriors(F.array(1 - F.col("p"), F.col("p"))))
    y, logs = F.col("y"), F.col("logs")
    return rows.groupBy("lang").agg(rounded(M.cross_entropy(y, logs)).alias("cross_entropy"), rounded(M.norm_cross_entropy(y, logs)).alias("norm_cross_entropy"))


@query("""WITH s AS (SELECT l_returnflag, l_extendedprice AS y, l_quantity * 1500.0::DOUBLE AS p FROM lineitem)
  SELECT l_returnflag, round(avg(abs(y - p)), 4) AS mae, round(avg((y - p) * (y - p)), 2) AS mse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2 FROM s GROUP BY l_returnflag""")
def reg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500.0).alias("p"))
    digits = {"mae": 4, "mse": 2, "r2": 6}
    return rows.groupBy("l_returnflag").agg(*(rounded(f(F.col("y"), F.col("p")), digits[n]).alias(n) for n, f in M.REGRESSION.items()))


#: Resamples of a statistic that is one sum, and of curves, which cost a ranking each.
RESAMPLES, CURVES, SEED = 1000, 1000, 3
NUMBERED = f"(SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM ({SCORED}))"
DRAWN = f"(SELECT b, k, n, {draw_sql('b * n + k', SEED, 'n')} AS at FROM (SELECT count(*) AS n FROM ({SCORED})), range({RESAMPLES}) t(b), range(100000) u(k) WHERE k < n)"


def _numbered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    from ..operators.prepare import row_ids

    rows = row_ids(scored(spark, sf_dir), ["doc_id"], "place")
    return rows, rows.count()


@query(f"""WITH d AS {DRAWN}, s AS {NUMBERED}, a AS (SELECT b, avg(CASE WHEN (p >= 0.6) = (y = 1) THEN 1.0 ELSE 0.0 END) AS acc FROM d JOIN s ON d.at = s.place GROUP BY b)
  SELECT count(acc) AS n, round(avg(acc), 6) AS mean, round(quantile_cont(acc, 0.025), 6) AS lo, round(quantile_cont(acc, 0.975), 6) AS hi FROM a""")
def bootstrap_percentile_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy's interval by an index bootstrap that any engine can repeat."""
    rows, n = _numbered(spark, sf_dir)
    drawn = resample.index_bootstrap(rows, "place", n, RESAMPLES, SEED)
    each = drawn.groupBy("b").agg(M.accuracy(F.col("y"), M.threshold_decision(F.col("p"), 0.6)).alias("acc"))
    s = resample.percentile_interval(each, "acc")
    return s.select("n", *(rounded(F.col(c)).alias(c) for c in ("mean", "lo", "hi")))


@query(f"""WITH d AS {DRAWN}, s AS {NUMBERED}, a AS (SELECT b, avg(CASE WHEN (p >= 0.6) = (y = 1) THEN 1.0 ELSE 0.0 END) AS lenient, avg(CASE WHEN (p >= 0.8) = (y = 1) THEN 1.0 ELSE 0.0 END) AS strict FROM d JOIN s ON d.at = s.place GROUP BY b)
  SELECT CAST(b AS BIGINT) AS b, 'lenient' AS metric, round(lenient, 6) AS value FROM a UNION ALL SELECT b, 'strict', round(strict, 6) FROM a""")
def bootstrap_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' accuracies on each resample, a row each: what a violin plot shows."""
    rows, n = _numbered(spark, sf_dir)
    accuracies = [M.accuracy(F.col("y"), M.threshold_decision(F.col("p"), t)).alias(m) for m, t in (("lenient", 0.6), ("strict", 0.8))]
    each = resample.index_bootstrap(rows, "place", n, RESAMPLES, SEED).groupBy("b").agg(*accuracies)
    return resample.distribution(each, ["lenient", "strict"]).withColumn("value", rounded(F.col("value")))


def _hits(of: str) -> Callable[[Column], Column]:
    """The weight of rows of a kind whose decision d is their truth y, over that of all rows of the kind."""
    return lambda w: F.try_divide(F.sum(F.when(F.expr(of), F.when(F.expr("d = y"), w).otherwise(0))), F.sum(F.when(F.expr(of), w)))


WEIGHTED = {"accuracy": _hits("true"), "recall": _hits("y = 1")}


@query()
def counted_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, metric, n, mean, lo, hi): accuracy and recall of each language over resamples of exactly as many documents as there are."""
    rows, n = _numbered(spark, sf_dir)
    hit = rows.select("place", "lang", "y", M.threshold_decision(F.col("p"), 0.6).alias("d"))
    each = resample.counted_bootstrap(hit, "place", n, WEIGHTED, RESAMPLES, SEED, ["lang"])
    return resample.percentile_interval(resample.distribution(each, ["accuracy", "recall"], ["lang"]), "value", ["lang", "metric"])


PAIRED = f"""d AS {DRAWN}, s AS {NUMBERED},
  a AS (SELECT b, avg(CASE WHEN (p >= 0.6) = (y = 1) THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN (p >= 0.8) = (y = 1) THEN 1.0 ELSE 0.0 END) AS diff FROM d JOIN s ON d.at = s.place GROUP BY b)"""


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = _numbered(spark, sf_dir)
    drawn = resample.index_bootstrap(rows, "place", n, RESAMPLES, SEED)
    a, b = (M.accuracy(F.col("y"), M.threshold_decision(F.col("p"), t)) for t in (0.6, 0.8))
    return drawn.groupBy("b").agg((a - b).alias("diff"))


@query(f"WITH {PAIRED} SELECT round(avg(diff), 6) AS mean, round(quantile_cont(diff, 0.025), 6) AS lo, round(quantile_cont(diff, 0.975), 6) AS hi FROM a")
def paired_diff_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two models' accuracies on the same resamples."""
    s = resample.percentile_interval(_differences(spark, sf_dir), "diff")
    return s.select(*(rounded(F.col(c)).alias(c) for c in ("mean", "lo", "hi")))


@query(f"WITH {PAIRED}, s2 AS (SELECT avg(CASE WHEN diff < 0 THEN 1.0 WHEN diff = 0 THEN 0.5 ELSE 0.0 END) AS below FROM a) SELECT round(below, 6) AS p_one, round(least(1.0, 2 * least(below, 1 - below)), 6) AS p_two FROM s2")
def bootstrap_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("diff")
    return _differences(spark, sf_dir).agg(rounded(resample.resampling_p(d)).alias("p_one"), rounded(resample.resampling_p(d, True)).alias("p_two"))


POISSON = " + ".join(f"CASE WHEN u >= {p!r}::DOUBLE THEN 1 ELSE 0 END" for p in resample._POISSON)
#: Labelled documents in each resample, w times.
WEIGHED = f"""u AS (SELECT b, lang, y, score, {draw_sql('doc_id * 1021 + b * 7919', SEED, resample.SPACE)} / {float(resample.SPACE)}::DOUBLE AS u FROM ({SCORED}), range({CURVES}) t(b)),
  w AS (SELECT b, lang, y, score, {POISSON} AS w FROM u)"""


@query(f"""WITH {WEIGHED}, c AS (SELECT lang, b, score, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y <> 1 THEN w ELSE 0 END) AS neg FROM w WHERE w > 0 GROUP BY 1, 2, 3),
  k AS (SELECT *, sum(neg) OVER (PARTITION BY lang, b ORDER BY score) AS below FROM c), a AS (SELECT lang, b, CAST(sum(pos * (below - neg / 2.0::DOUBLE)) AS DOUBLE) / nullif(sum(pos) * sum(neg), 0) AS auc FROM k GROUP BY 1, 2)
  SELECT lang, count(auc) AS n, round(avg(auc), 6) AS mean, round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi FROM a GROUP BY lang""")
def bootstrap_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language the interval of the AUC over resamples by Poisson weights."""
    rows = scored(spark, sf_dir).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(CURVES - 1))))
    rows = rows.withColumn("w", resample.poisson_weight(F.col("doc_id"), F.col("b"), SEED)).where("w > 0")
    areas = M.roc_auc(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("w")))), "y", "score", ["lang", "b"])
    s = resample.percentile_interval(areas, "auc", ["lang"])
    return s.select("lang", "n", *(rounded(F.col(c)).alias(c) for c in ("mean", "lo", "hi")))


REPORTED = f"""r AS (SELECT b, lang, CASE WHEN doc_id % 4 = 0 THEN 'holdout' ELSE 'dev' END AS s, y, CASE WHEN p >= 0.6 THEN 1 ELSE 0 END AS d, {draw_sql('doc_id * 1021 + b * 7919', SEED, resample.SPACE)} / {float(resample.SPACE)}::DOUBLE AS u
    FROM ({SCORED}), range({RESAMPLES}) t(b)), w AS (SELECT *, {POISSON} AS w FROM r),
  a AS (SELECT lang, s, b, CAST(sum(CASE WHEN y = d THEN w ELSE 0 END) AS DOUBLE) / sum(w) AS accuracy, CAST(sum(CASE WHEN y = 1 AND d = 1 THEN w ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN y = 1 THEN w END), 0) AS recall FROM w WHERE w > 0 GROUP BY 1, 2, 3),
  i AS (SELECT lang, s, round(avg(accuracy), 2) AS am, round(quantile_cont(accuracy, 0.025), 2) AS al, round(quantile_cont(accuracy, 0.975), 2) AS ah, round(avg(recall), 2) AS rm, round(quantile_cont(recall, 0.025), 2) AS rl, round(quantile_cont(recall, 0.975), 2) AS rh FROM a GROUP BY 1, 2)"""


@query(f"WITH {REPORTED} SELECT lang, " + ", ".join(f"max(CASE WHEN s = '{s}' THEN {m[0]}m END) AS {m}_mean_{s}, max(CASE WHEN s = '{s}' AND {m[0]}m IS NOT NULL THEN printf('[%.2f, %.2f]', {m[0]}l, {m[0]}h) END) AS {m}_ic_{s}" for m in ("accuracy", "recall") for s in ("dev", "holdout")) + " FROM i GROUP BY lang")
def wide_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a language: accuracy and recall on development and holdout documents, each with its interval as text."""
    rows = scored(spark, sf_dir).withColumns({"set": F.when(F.col("doc_id") % 4 == 0, "holdout").otherwise("dev"), "d": M.threshold_decision(F.col("p"), 0.6)})
    samples = resample.bootstrap(rows.select("doc_id", "lang", "set", "y", "d"), "doc_id", WEIGHTED, RESAMPLES, SEED, ["lang", "set"])
    intervals = resample.percentile_interval(resample.distribution(samples, ["accuracy", "recall"], ["lang", "set"]), "value", ["lang", "set", "metric"])
    return select.wide_report(intervals, ["lang"], ["accuracy", "recall"], ["dev", "holdout"])


ATTEMPTS = 6
FEW = "SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT * FROM (" + SCORED + ") WHERE lang = 'es')"


@query(f"""WITH s AS ({FEW}), d AS (SELECT b, t, k, {draw_sql(f'(b * {ATTEMPTS} + t) * n + k', SEED, 'n')} AS at FROM (SELECT DISTINCT n FROM s), range({RESAMPLES}) x(b), range({ATTEMPTS}) y(t), range(100000) z(k) WHERE k < n),
  a AS (SELECT b, t, avg(CASE WHEN (p >= 0.6) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS acc FROM d JOIN s ON d.at = s.place GROUP BY b, t HAVING count(DISTINCT y) = (SELECT count(DISTINCT y) FROM s)),
  f AS (SELECT b, min(t) AS t FROM a GROUP BY b) SELECT count(*) AS n, sum(CASE WHEN t > 0 THEN 1 ELSE 0 END)::BIGINT AS redrawn, round(avg(acc), 6) AS mean, round(quantile_cont(acc, 0.025), 6) AS lo, round(quantile_cont(acc, 0.975), 6) AS hi FROM a JOIN f USING (b, t)""")
def redrawn_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy's interval on the documents of one language, of which some resamples have one class only and are drawn again."""
    from ..operators.prepare import row_ids

    rows = row_ids(scored(spark, sf_dir).where("lang = 'es'"), ["doc_id"], "place")
    drawn = resample.redrawn_bootstrap(rows, "place", "y", rows.count(), RESAMPLES, SEED, ATTEMPTS)
    each = drawn.groupBy("b").agg(M.accuracy(F.col("y"), M.threshold_decision(F.col("p"), 0.6)).alias("acc"), F.max("attempt").alias("attempt"))
    again = each.agg(F.count_if(F.col("attempt") > 0).alias("redrawn"))
    s = resample.percentile_interval(each, "acc").crossJoin(F.broadcast(again))
    return s.select("n", "redrawn", *(rounded(F.col(c)).alias(c) for c in ("mean", "lo", "hi")))


@query()
def bca_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("hit", (M.threshold_decision(F.col("p"), 0.6) == F.col("y")).cast("double"))
    return resample.bca_mean(rows, "doc_id", "hit", RESAMPLES, SEED)


@query(f"""WITH s AS (SELECT doc_id, CASE WHEN (p >= 0.6) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM ({SCORED})),
  w AS (SELECT b, hit, -ln(({draw_sql('doc_id * 1021 + b * 7919', SEED, resample.SPACE)} + 0.5::DOUBLE) / {float(resample.SPACE)}::DOUBLE) AS w FROM s, range({RESAMPLES}) t(b)),
  a AS (SELECT b, sum(w * hit) / sum(w) AS acc FROM w GROUP BY b)
  SELECT count(acc) AS n, round(avg(acc), 6) AS mean, round(quantile_cont(acc, 0.025), 6) AS lo, round(quantile_cont(acc, 0.975), 6) AS hi FROM a""")
def bayesian_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy under Dirichlet weights."""
    rows = scored(spark, sf_dir).withColumn("hit", (M.threshold_decision(F.col("p"), 0.6) == F.col("y")).cast("double"))
    rows = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(RESAMPLES - 1)))).withColumn("w", resample.bayesian_weight(F.col("doc_id"), F.col("b"), SEED))
    s = resample.percentile_interval(rows.groupBy("b").agg((F.sum(F.col("w") * F.col("hit")) / F.sum("w")).alias("acc")), "acc")
    return s.select("n", *(rounded(F.col(c)).alias(c) for c in ("mean", "lo", "hi")))


FOLDED = "SELECT doc_id, quality, CAST((row_number() OVER (ORDER BY quality, {d}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels"


@query(FOLDED.format(d=draw_sql("doc_id", SEED, split.SPACE)))
def kfold_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.k_fold(table(spark, sf_dir, "labels").select("doc_id", "quality"), 5, "doc_id", SEED, ["quality"])


@query(f"""WITH g AS (SELECT user_id, CAST((row_number() OVER (ORDER BY {draw_sql('user_id', SEED, split.SPACE)}, user_id) - 1) % 4 AS INTEGER) AS fold FROM (SELECT DISTINCT user_id FROM events))
  SELECT fold, count(*) AS n, count(DISTINCT user_id) AS users FROM events JOIN g USING (user_id) GROUP BY fold""")
def group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.group_k_fold(table(spark, sf_dir, "events").select("user_id"), 4, "user_id", SEED)
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


#: The users' rows of each type; kinds of users dealt evenly but for a rest, which is dealt one after another, t.held being the folds' rows.
STRATIFIED_GROUPS = f"""WITH RECURSIVE c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), w AS (SELECT list(1.0::DOUBLE / (n * n) ORDER BY event_type) AS w FROM c),
  g AS (SELECT user_id, list(k ORDER BY event_type) AS v FROM (SELECT u.user_id, c.event_type, count(e.user_id) AS k FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN c LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = c.event_type GROUP BY 1, 2) GROUP BY 1),
  m AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY {draw_sql('user_id', SEED, split.SPACE)}, user_id) - 1 AS place, count(*) OVER (PARTITION BY v) AS size FROM g),
  r AS (SELECT *, row_number() OVER (ORDER BY list_sum(v) DESC, v DESC, place) AS r FROM m WHERE place >= size - size % 4),
  t AS (SELECT 0::BIGINT AS r, -1::BIGINT AS user_id, list_transform(range(4), lambda f: list_transform(w, lambda x: 0::BIGINT)) AS held, -1::BIGINT AS fold, w FROM w
    UNION ALL SELECT r, user_id, list_transform(held, lambda h, f: CASE WHEN f = fold + 1 THEN list_transform(list_zip(h, v), lambda z: z[1] + z[2]) ELSE h END), fold, w FROM
      (SELECT r.r, r.user_id, r.v, t.held, t.w, list_sort(list_transform(range(4), lambda f: {{'cost': list_reduce([0.0::DOUBLE] || list_transform(list_zip(t.held[f + 1], r.v, t.w), lambda z: z[1]::DOUBLE * z[2] * z[3]), lambda a, b: a + b), 'size': list_sum(t.held[f + 1]), 'fold': f}}))[1].fold AS fold FROM t JOIN r ON r.r = t.r + 1)),
  f AS (SELECT user_id, place % 4 AS fold FROM m WHERE place < size - size % 4 UNION ALL SELECT user_id, fold FROM t WHERE r > 0)"""


@query(f"{STRATIFIED_GROUPS} SELECT CAST(fold AS INTEGER) AS fold, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events JOIN f USING (user_id) GROUP BY 1, 2")
def stratified_group_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of whole users with about equal numbers of each type of event."""
    rows = split.group_k_fold(table(spark, sf_dir, "events").select("user_id", "event_type"), 4, "user_id", SEED, "event_type")
    return rows.groupBy("fold", "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT e.user_id, CAST(g.fold AS INTEGER) AS fold, count(*) AS n FROM events e JOIN (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS fold FROM (SELECT DISTINCT user_id FROM events)) g USING (user_id) GROUP BY 1, 2")
def leave_one_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split.leave_one_group_out(table(spark, sf_dir, "events").select("user_id"), "user_id")
    return rows.groupBy("user_id", "fold").agg(F.count("*").alias("n"))


@query("SELECT l.doc_id, l.doc_id IN (SELECT item_id FROM benchmark) AS is_test FROM labels l")
def external_test_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test set that comes as a table of ids."""
    ids = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("doc_id"))
    return split.with_test_set(table(spark, sf_dir, "labels").select("doc_id"), ids, "doc_id")


@query("SELECT doc_id, CAST(lang = 'de' AS INTEGER) AS lang_de, CAST(lang = 'en' AS INTEGER) AS lang_en, CAST(lang = 'fr' AS INTEGER) AS lang_fr FROM documents")
def label_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.one_hot(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["de", "en", "fr"], "lang_").drop("lang")


@query(f"""WITH s AS (SELECT user_id, event_id % 3 AS seed, least(greatest(value / (value + 50.0::DOUBLE), 0), 1) AS p FROM events), m AS (SELECT user_id, avg(1 - p) AS p0, avg(p) AS p1, count(*) AS n FROM s GROUP BY user_id)
  SELECT user_id, round(p0, 6) AS p0, round(p1, 6) AS p1, n FROM m""")
def seed_averaged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score vectors of several seeds averaged class by class."""
    p = F.least(F.greatest(F.col("value") / (F.col("value") + 50.0), F.lit(0.0)), F.lit(1.0))
    rows = table(spark, sf_dir, "events").select("user_id", F.array(1 - p, p).alias("scores"))
    means = prepare.mean_over_seeds(rows, ["user_id"], "scores")
    return means.select("user_id", rounded(F.col("scores")[0]).alias("p0"), rounded(F.col("scores")[1]).alias("p1"), "n")


@query(f"SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {draw_sql('doc_id', SEED, split.SPACE)}, doc_id) <= ceil(count(*) OVER (PARTITION BY quality) * 0.2::DOUBLE) AS is_test FROM labels")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.holdout(table(spark, sf_dir, "labels").select("doc_id", "quality"), 0.2, "doc_id", SEED, ["quality"])


@query(f"SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {draw_sql('doc_id', SEED, split.SPACE)}, doc_id) <= floor(count(*) OVER (PARTITION BY quality) / 2.0) THEN 1 - quality ELSE quality END AS flipped FROM labels")
def label_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.flip_labels(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", SEED)


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS fold FROM labels")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.leave_one_out(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select("doc_id", "fold")


@query(f"""WITH a AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) AS k FROM labels), b AS (SELECT quality AS permuted, row_number() OVER (ORDER BY {draw_sql('doc_id', SEED, split.SPACE)}, doc_id) AS k FROM labels)
  SELECT doc_id, quality, permuted FROM a JOIN b USING (k)""")
def label_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.permute_labels(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", SEED).select("doc_id", "quality", "permuted")


@query(f"SELECT CAST(y AS INTEGER) AS y, CAST(least(floor(p / 0.02::DOUBLE), 49) AS INTEGER) AS bin, count(*) AS n FROM ({SCORED}) WHERE p BETWEEN 0 AND 1 GROUP BY 1, 2")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.histogram(scored(spark, sf_dir).select(F.col("y").cast("int").alias("y"), "p"), "p", 50, 0.0, 1.0, ["y"])


@query(f"""WITH {WEIGHED}, c AS (SELECT b, score, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS pos, sum(CASE WHEN y <> 1 THEN w ELSE 0 END) AS neg FROM w WHERE w > 0 GROUP BY 1, 2),
  k AS (SELECT b, sum(pos) OVER v AS tp, sum(neg) OVER v AS fp, sum(pos) OVER (PARTITION BY b) AS p, sum(neg) OVER (PARTITION BY b) AS n FROM c WINDOW v AS (PARTITION BY b ORDER BY score DESC)),
  curve AS (SELECT b, CAST(fp AS DOUBLE) / n AS fpr, CAST(tp AS DOUBLE) / p AS tpr FROM k),
  g AS (SELECT b, CAST(i AS INTEGER) AS step, i / 99.0::DOUBLE AS x FROM range(100) t(i), (SELECT DISTINCT b FROM curve)),
  l AS (SELECT b, step, max(struct_pack(f := fpr, t := tpr)) AS l FROM g JOIN curve USING (b) WHERE CAST(ceil(fpr * 99) AS INTEGER) <= step GROUP BY 1, 2),
  r AS (SELECT b, step, min(struct_pack(f := fpr, t := tpr)) AS r FROM g JOIN curve USING (b) WHERE CAST(floor(fpr * 99) AS INTEGER) >= step GROUP BY 1, 2),
  t AS (SELECT x, CASE WHEN step = 0 THEN 0 WHEN step = 99 THEN 1 WHEN l IS NULL THEN r.t * x / r.f WHEN r.f - l.f <= 0 THEN l.t ELSE l.t + (r.t - l.t) * (x - l.f) / (r.f - l.f) END AS tpr
    FROM g LEFT JOIN l USING (b, step) LEFT JOIN r USING (b, step))
  SELECT round(x, 6) AS grid, count(tpr) AS n, round(avg(tpr), 6) AS mean, round(quantile_cont(tpr, 0.025), 6) AS lo, round(quantile_cont(tpr, 0.975), 6) AS hi FROM t GROUP BY x""")
def roc_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grid, mean, lo, hi) of the ROC curve over resamples, at the points of a grid."""
    rows = scored(spark, sf_dir).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(CURVES - 1))))
    rows = rows.withColumn("w", resample.poisson_weight(F.col("doc_id"), F.col("b"), SEED)).where("w > 0")
    curves = M.on_grid(M.roc_curve(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("w")))), "y", "score", ["b"]), 100, ["b"])
    s = resample.percentile_interval(curves, "tpr", ["grid"])
    return s.select(rounded(F.col("grid")).alias("grid"), "n", *(rounded(F.col(c)).alias(c) for c in ("mean", "lo", "hi")))


@query(f"""WITH f AS (SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY {draw_sql('doc_id', SEED, split.SPACE)}, doc_id) <= floor(count(*) OVER (PARTITION BY quality) / 2.0) THEN 1 - quality ELSE quality END AS flipped FROM labels),
  s AS (SELECT f.flipped, s.* FROM ({SCORED}) s JOIN f USING (doc_id)), g AS (SELECT 'labels' AS target, y, score FROM s UNION ALL SELECT 'control', flipped, score FROM s),
  r AS (SELECT target, y, rank() OVER (PARTITION BY target ORDER BY score) + (count(*) OVER (PARTITION BY target, score) - 1) / 2.0::DOUBLE AS r, CAST(sum(y) OVER (PARTITION BY target) AS DOUBLE) AS n1, CAST(sum(1 - y) OVER (PARTITION BY target) AS DOUBLE) AS n0 FROM g)
  SELECT target, round({AUC}, 6) AS auc FROM r GROUP BY target, n1, n0""")
def shuffle_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score's AUC on the labels and on labels half of which are flipped."""
    flipped = split.flip_labels(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", SEED).select("doc_id", "flipped")
    rows = scored(spark, sf_dir).join(flipped, "doc_id")
    pair = lambda name, y: F.struct(F.lit(name).alias("target"), F.col(y).cast("int").alias("y"))
    both = rows.select(F.explode(F.array(pair("labels", "y"), pair("control", "flipped"))).alias("x"), "score")
    return M.roc_auc(both.select("x.*", "score"), "y", "score", ["target"]).select("target", rounded(F.col("auc")).alias("auc"))


@query(f"""WITH m AS (SELECT unnest([0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]) AS threshold), s AS ({SCORED})
  SELECT threshold, count(*) AS n, round(avg(CASE WHEN (p >= threshold) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM s, m GROUP BY threshold""")
def holdout_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of a small broadcast table scored on the same rows in one pass."""
    candidates = spark.createDataFrame([(0.4,), (0.6,), (0.8,)], "threshold double")
    rows = scored(spark, sf_dir).select("y", "p").crossJoin(F.broadcast(candidates))
    pred = F.when(F.col("p") >= F.col("threshold"), 1).otherwise(0)
    return rows.groupBy("threshold").agg(F.count("*").alias("n"), rounded(M.accuracy(F.col("y"), pred)).alias("accuracy"))
