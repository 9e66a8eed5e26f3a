"""Descriptive statistics, balance between groups, hypothesis tests and association."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hypothesis_tests as T
from ..functions.scalars import rounded
from ..operators import describe
from ..operators.cumulative import percentiles
from ..sources.session import table
from .registry import query

#: Two market segments as groups 1 and 0.
GROUPED = "SELECT *, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS g FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"
EVENTS2 = "SELECT *, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS g FROM events WHERE event_type IN ('click', 'view')"


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return rows.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).withColumn("g", F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0))


def two_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "user_id").where(F.col("event_type").isin("click", "view"))
    return rows.withColumn("g", F.when(F.col("event_type") == "click", 1).otherwise(0))


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), digits) for c in columns})


@query("""WITH m AS (SELECT event_type, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type),
  k AS (SELECT event_type, avg((value - mean) * (value - mean) * (value - mean)) AS m3, avg((value - mean) * (value - mean) * (value - mean) * (value - mean)) AS m4 FROM events JOIN m USING (event_type) GROUP BY event_type)
  SELECT event_type, n, round(mean, 6) AS mean, round(sd, 6) AS std, lo AS min, hi AS max, round(m3 / (sd * sd * sd), 6) AS skew, round(m4 / (sd * sd * sd * sd) - 3, 6) AS kurt FROM m JOIN k USING (event_type)""")
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = describe.feature_stats(table(spark, sf_dir, "events").select("event_type", "value"), "value", ["event_type"])
    return _round(rows, "mean", "std", "skew", "kurt")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS lo, round(quantile_cont(value, 0.975), 6) AS hi, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "user_id", "value")
    middle = percentiles(events, "value", (0.5, 0.025, 0.975), ("median", "lo", "hi"), ["event_type"])
    rows = events.groupBy("event_type").agg(F.avg("value").alias("mean"), F.count_distinct("user_id").alias("users")).join(middle, "event_type")
    return _round(rows, "median", "mean", "lo", "hi")


@query("""WITH x AS (SELECT label, unnest(range(64)) AS pos, unnest(embedding) AS v FROM embeddings), m AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY label, pos)
  SELECT label, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std, round(min(m), 6) AS min, round(max(m), 6) AS max FROM m GROUP BY label""")
def embedding_mean_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = describe.vector_means(table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v")), "v", ["label"])
    stats = means.groupBy("label").agg(F.avg("mean").alias("m"), F.stddev_pop("mean").alias("std"), F.min("mean").alias("min"), F.max("mean").alias("max"))
    return _round(stats.withColumnRenamed("m", "mean"), "mean", "std", "min", "max")


@query(f"""WITH g AS ({GROUPED}), l AS (SELECT g, 'c_acctbal' AS feature, c_acctbal AS v FROM g UNION ALL SELECT g, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM g),
  s AS (SELECT feature, avg(CASE WHEN g = 0 THEN v END) - avg(CASE WHEN g = 1 THEN v END) AS d, sqrt((var_pop(CASE WHEN g = 0 THEN v END) + var_pop(CASE WHEN g = 1 THEN v END)) / 2) AS p FROM l GROUP BY feature)
  SELECT feature, round(CASE WHEN p = 0 THEN 0 ELSE abs(d) / p END, 6) AS smd FROM s""")
def smd_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(describe.smd(grouped(spark, sf_dir), "g", ["c_acctbal", "c_nationkey"]), "smd")


GAP = """c AS (SELECT g, c_nationkey, count(*) AS n FROM g GROUP BY 1, 2), f AS (SELECT a.g, b.c_nationkey, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT g FROM g) a CROSS JOIN (SELECT DISTINCT c_nationkey FROM g) b LEFT JOIN c ON c.g = a.g AND c.c_nationkey = b.c_nationkey),
  s AS (SELECT g, c_nationkey, n, n / sum(n) OVER (PARTITION BY g) AS share FROM f)"""


@query(f"WITH g AS ({GROUPED}), {GAP} SELECT round(max(abs(a.share - b.share)), 6) AS gap FROM s a JOIN s b USING (c_nationkey) WHERE a.g = 0 AND b.g = 1")
def category_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(describe.category_gap(grouped(spark, sf_dir), "g", "c_nationkey"), "gap")


@query(f"WITH g AS ({GROUPED}), {GAP} SELECT g, c_nationkey, CAST(n AS BIGINT) AS n, round(share, 6) AS share FROM s")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(describe.category_shares(grouped(spark, sf_dir), "g", "c_nationkey"), "share")


@query(f"""WITH g AS ({GROUPED}), {GAP}, l AS (SELECT g, c_acctbal AS v FROM g)
  SELECT 'c_nationkey' AS feature, 'share' AS kind, round(max(abs(a.share - b.share)), 6) AS gap FROM s a JOIN s b USING (c_nationkey) WHERE a.g = 0 AND b.g = 1
  UNION ALL SELECT 'c_acctbal', 'smd', round(abs(avg(CASE WHEN g = 0 THEN v END) - avg(CASE WHEN g = 1 THEN v END)) / sqrt((var_pop(CASE WHEN g = 0 THEN v END) + var_pop(CASE WHEN g = 1 THEN v END)) / 2), 6) FROM l""")
def balance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(describe.balance(grouped(spark, sf_dir), "g", ["c_acctbal"], ["c_nationkey"]), "gap")


@query(f"""WITH g AS (SELECT *, c_custkey % 4 = 0 AS t FROM ({GROUPED})), l AS (SELECT g, t, 'c_acctbal' AS feature, c_acctbal AS v FROM g UNION ALL SELECT g, t, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM g)
  SELECT g, feature, round(abs(avg(CASE WHEN NOT t THEN v END) - avg(CASE WHEN t THEN v END)) / CASE WHEN stddev_pop(v) = 0 THEN 1 ELSE stddev_pop(v) END, 6) AS gap FROM l GROUP BY g, feature""")
def between_set_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(describe.between_sets(grouped(spark, sf_dir), "g", F.col("c_custkey") % 4 == 0, ["c_acctbal", "c_nationkey"]), "gap")


@query("SELECT o_orderstatus, " + ", ".join(f"count(CASE WHEN o_orderpriority = '{p}' THEN 1 END) AS \"{p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders GROUP BY o_orderstatus")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.contingency(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query("""WITH g AS (SELECT event_type, count(*) AS n, round(avg(value), 3) AS m, round(stddev_samp(value), 3) AS s FROM events GROUP BY 1)
  SELECT event_type, n, round(n / sum(n) OVER (), 6) AS share, printf('%.3f (%.3f)', m, s) AS mean_sd FROM g""")
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("m"), F.round(F.stddev_samp("value"), 3).alias("s"))
    share = rounded(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row an event type
    return g.select("event_type", "n", share.alias("share"), F.format_string("%.3f (%.3f)", "m", "s").alias("mean_sd"))


WELCH = f"""a AS (SELECT avg(CASE WHEN g = 0 THEN value END) - avg(CASE WHEN g = 1 THEN value END) AS d, var_samp(CASE WHEN g = 0 THEN value END) AS va, var_samp(CASE WHEN g = 1 THEN value END) AS vb,
  CAST(sum(1 - g) AS DOUBLE) AS na, CAST(sum(g) AS DOUBLE) AS nb FROM ({EVENTS2}))"""


@query(f"WITH {WELCH} SELECT round(d / sqrt(va / na + vb / nb), 6) AS t, round((va / na + vb / nb) * (va / na + vb / nb) / ((va / na) * (va / na) / (na - 1) + (vb / nb) * (vb / nb) / (nb - 1)), 4) AS df FROM a")
def welch_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.welch(two_types(spark, sf_dir), "g", "value")
    return s.select(rounded(F.col("t")).alias("t"), rounded(F.col("df"), 4).alias("df"))


@query(f"WITH {WELCH} SELECT round(d / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 6) AS t, na + nb - 2 AS df FROM a")
def student_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.student(two_types(spark, sf_dir), "g", "value").select("t", "df"), "t")


@query("SELECT l_returnflag, round(avg(l_discount - l_tax) * sqrt(count(*)) / stddev_samp(l_discount - l_tax), 4) AS t, CAST(count(*) - 1 AS DOUBLE) AS df FROM lineitem GROUP BY l_returnflag")
def paired_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.paired(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", ["l_returnflag"]).select("l_returnflag", "t", "df"), "t", digits=4)


@query(f"""WITH r AS (SELECT g, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS r FROM ({EVENTS2})), t AS (SELECT sum(k * k * k - k) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM r GROUP BY value)),
  a AS (SELECT sum(CASE WHEN g = 0 THEN r END) AS r, CAST(sum(1 - g) AS DOUBLE) AS na, CAST(sum(g) AS DOUBLE) AS nb, CAST(count(*) AS DOUBLE) AS n FROM r), u AS (SELECT *, r - na * (na + 1) / 2 AS u FROM a, t)
  SELECT u, round(greatest(abs(u - na * nb / 2) - 0.5, 0) / sqrt(na * nb / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM u""")
def mwu_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.mann_whitney(two_types(spark, sf_dir), "g", "value").select("u", "z"), "z")


@query("""WITH d AS (SELECT l_discount - l_tax AS d FROM lineitem WHERE l_discount - l_tax <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM d),
  t AS (SELECT sum(k * k * k - k) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS k FROM d GROUP BY abs(d))), a AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS plus FROM r), w AS (SELECT *, least(plus, n * (n + 1) / 2 - plus) AS w FROM a, t)
  SELECT w, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM w""")
def wilcoxon_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.wilcoxon(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax").select("w", "z"), "z")


@query(f"""WITH RECURSIVE e AS (SELECT user_id, g, value, rank() OVER w + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY user_id, value) AS k FROM ({EVENTS2}) WINDOW w AS (PARTITION BY user_id ORDER BY value)),
  a AS (SELECT user_id, sum(CASE WHEN g = 0 THEN r ELSE 0 END) AS r, CAST(sum(1 - g) AS DOUBLE) AS na, CAST(sum(g) AS DOUBLE) AS nb, count(*) AS n, sum(CAST(k AS DOUBLE) * k - 1) AS ties FROM e GROUP BY user_id),
  s AS (SELECT *, r - na * (na + 1) / 2 AS u, ties = 0 AND least(na, nb) BETWEEN 1 AND 8 AND n <= 200 AS exact, na * nb AS most FROM a),
  law(i, c, x, ways) AS (SELECT 0, 0, 0, 1.0::DOUBLE UNION ALL SELECT i + 1, c + t, x + t * (i - c), sum(ways) FROM law, (VALUES (0), (1)) v(t) WHERE i < (SELECT max(n) FROM s WHERE exact) AND c + t <= 8 GROUP BY 1, 2, 3),
  p AS (SELECT user_id, least(1.0, 2 * sum(CASE WHEN x <= least(u, most - u) THEN ways ELSE 0 END) / sum(ways)) AS p FROM s JOIN law ON exact AND i = n AND c = least(na, nb) GROUP BY user_id)
  SELECT user_id, u, exact, round(p, 8) AS p_exact FROM s LEFT JOIN p USING (user_id)""")
def mann_whitney_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks' and views' values of each user: U, and p by the null law where a user has few rows and no ties."""
    s = T.mann_whitney(two_types(spark, sf_dir), "g", "value", by=["user_id"])
    return s.select("user_id", "u", "exact", F.when(F.col("exact"), rounded(F.col("p"), 8)).alias("p_exact"))


@query("""WITH RECURSIVE d AS (SELECT l_orderkey, l_discount - l_tax AS d FROM lineitem WHERE l_discount - l_tax IS NOT NULL), r AS (SELECT l_orderkey, d, rank() OVER (PARTITION BY l_orderkey ORDER BY abs(d)) + (count(*) OVER (PARTITION BY l_orderkey, abs(d)) - 1) / 2.0::DOUBLE AS r,
    count(*) OVER (PARTITION BY l_orderkey, abs(d)) AS k FROM d WHERE d <> 0), z AS (SELECT l_orderkey, count(CASE WHEN d = 0 THEN 1 END) AS same FROM d GROUP BY l_orderkey),
  a AS (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS plus, max(k) AS k FROM r GROUP BY l_orderkey), s AS (SELECT l_orderkey, n, least(plus, n * (n + 1) / 2 - plus) AS w, k = 1 AND same = 0 AND n <= 50 AS exact FROM a JOIN z USING (l_orderkey)),
  law(i, x, ways) AS (SELECT 0, 0, 1.0::DOUBLE UNION ALL SELECT i + 1, x + t * (i + 1), sum(ways) FROM law, (VALUES (0), (1)) v(t) WHERE i < (SELECT max(n) FROM s WHERE exact) GROUP BY 1, 2),
  p AS (SELECT l_orderkey, least(1.0, 2 * sum(CASE WHEN x <= w THEN ways ELSE 0 END) / sum(ways)) AS p FROM s JOIN law ON exact AND i = n GROUP BY l_orderkey)
  SELECT l_orderkey, w, exact, round(p, 8) AS p_exact FROM s LEFT JOIN p USING (l_orderkey)""")
def wilcoxon_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts and taxes of each order's lines: the smaller signed rank sum, and p by the null law where no difference is 0 or tied."""
    s = T.wilcoxon(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_discount", "l_tax"), "l_discount", "l_tax", ["l_orderkey"])
    return s.select("l_orderkey", "w", "exact", F.when(F.col("exact"), rounded(F.col("p"), 8)).alias("p_exact"))


@query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), f AS (SELECT x.a, y.b, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT a FROM c) x CROSS JOIN (SELECT DISTINCT b FROM c) y LEFT JOIN c ON c.a = x.a AND c.b = y.b),
  e AS (SELECT a, b, n, CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e FROM f)
  SELECT round(sum((n - e) * (n - e) / e), 6) AS stat, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS DOUBLE) AS df FROM e""")
def chi2_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.chi2(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority").select("stat", "df"), "stat")


@query("SELECT event_type, count(*) AS n, round(corr(value, user_id), 6) AS r FROM events GROUP BY event_type")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.pearson(table(spark, sf_dir, "events"), "value", "user_id", ["event_type"]).select("event_type", "n", "r"), "r")


@query("""WITH r AS (SELECT rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY user_id) + (count(*) OVER (PARTITION BY user_id) - 1) / 2.0::DOUBLE AS y FROM events)
  SELECT count(*) AS n, round(corr(x, y), 6) AS r FROM r""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.spearman(table(spark, sf_dir, "events"), "value", "user_id").select("n", "r"), "r")


@query("""WITH c AS (SELECT count(*) AS n, corr(l_extendedprice, l_discount) AS xy, corr(l_extendedprice, l_quantity) AS xz, corr(l_discount, l_quantity) AS yz FROM lineitem)
  SELECT n, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS r FROM c""")
def partial_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(T.partial_corr(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_discount", ["l_quantity"]).select("n", "r"), "r")


PVALUES = "SELECT l_suppkey, round(avg(l_discount) * 10, 6) AS p FROM lineitem GROUP BY l_suppkey"


def pvalues(lines: DataFrame) -> DataFrame:
    """(l_suppkey, p). Discounts of up to ten digits are summed as decimals: halfway between two values of p, the order of a sum of doubles would choose."""
    x = F.col("l_discount")
    digits = x.try_cast("decimal(24,10)")
    exact = F.try_divide(F.sum(digits).try_cast("decimal(24,10)"), F.count(x).cast("decimal(18,0)"))
    exact = (F.round(exact, 7).try_cast("decimal(20,7)") * 10).cast("double") + F.lit(0.0)
    kept = F.bool_and(F.coalesce(digits.cast("double") == x, x.isNull()))
    return lines.groupBy("l_suppkey").agg(F.when(kept, exact).otherwise(rounded(F.avg(x) * 10)).alias("p"))



@query(f"""WITH p AS ({PVALUES}), r AS (SELECT l_suppkey, p, p * count(*) OVER () / (rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) AS q FROM p)
  SELECT l_suppkey, p, round(least(1.0, min(q) OVER (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_adj FROM r""")
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pvalues(table(spark, sf_dir, "lineitem"))
    return _round(T.benjamini_hochberg(p, "p"), "p_adj").select("l_suppkey", "p", "p_adj")


@query(f"WITH p AS ({PVALUES}) SELECT count(p) > 0 AND bool_and(p >= 0.05) AS all_fine FROM p")
def all_nonsignificant(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pvalues(table(spark, sf_dir, "lineitem"))
    return p.agg(T.all_above(F.col("p")).alias("all_fine"))


@query(f"""WITH g AS ({GROUPED}), s AS (SELECT count(CASE WHEN g = 0 THEN 1 END) AS na, count(CASE WHEN g = 1 THEN 1 END) AS nb, avg(CASE WHEN g = 0 THEN c_acctbal END) AS ma, avg(CASE WHEN g = 1 THEN c_acctbal END) AS mb,
    var_samp(CASE WHEN g = 0 THEN c_acctbal END) AS va, var_samp(CASE WHEN g = 1 THEN c_acctbal END) AS vb FROM g),
  n AS (SELECT g, c_nationkey, count(*) AS n FROM g GROUP BY 1, 2), f AS (SELECT a.g, b.c_nationkey, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT g FROM g) a CROSS JOIN (SELECT DISTINCT c_nationkey FROM g) b LEFT JOIN n ON n.g = a.g AND n.c_nationkey = b.c_nationkey),
  e AS (SELECT n, sum(n) OVER (PARTITION BY g) * sum(n) OVER (PARTITION BY c_nationkey) / (sum(n) OVER ())::DOUBLE AS e FROM f)
  SELECT 'c_acctbal' AS feature, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS stat, round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 4) AS df FROM s
  UNION ALL SELECT 'c_nationkey', round((SELECT sum((n - e) * (n - e) / e) FROM e), 6), CAST((SELECT count(DISTINCT c_nationkey) - 1 FROM g) AS DOUBLE)""")
def group_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test of each covariate between two groups."""
    found = T.between_groups(grouped(spark, sf_dir), "g", ["c_acctbal"], ["c_nationkey"])
    return found.select("feature", rounded(F.col("stat")).alias("stat"), rounded(F.col("df"), 4).alias("df"))


@query("""WITH e AS (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN value END) AS a, avg(CASE WHEN event_type = 'view' THEN value END) AS b FROM events GROUP BY user_id),
  d AS (SELECT a - b AS d FROM e WHERE a - b <> 0), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM d)
  SELECT 'wilcoxon' AS test, round(least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)), 4) AS stat FROM r""")
def chosen_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test that suits the values: they aren't normal, and users repeat."""
    return T.compared(two_types(spark, sf_dir), "g", "value", "user_id").select("test", rounded(F.col("stat"), 4).alias("stat"))


@query()
def test_pvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(test, p) of every two-sample test and association, p to ten decimals."""
    e, o, li = two_types(spark, sf_dir), table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    found = {
        "welch": T.welch(e, "g", "value"), "student": T.student(e, "g", "value"), "mann_whitney": T.mann_whitney(e, "g", "value"), "paired": T.paired(li, "l_discount", "l_tax"),
        "wilcoxon": T.wilcoxon(li, "l_discount", "l_tax"), "chi2": T.chi2(o, "o_orderstatus", "o_orderpriority"), "fisher": T.chi2(table(spark, sf_dir, "labels"), "quality", "toxic"),
        "pearson": T.pearson(e, "value", "user_id"), "spearman": T.spearman(e, "value", "user_id"), "partial": T.partial_corr(li, "l_extendedprice", "l_discount", ["l_quantity", "l_tax"]),
    }
    rows = None
    for name, df in found.items():
        one = df.select(F.lit(name).alias("test"), F.round("p", 10).alias("p"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query()
def shapiro_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.shapiro(table(spark, sf_dir, "events").select("event_type", "value"), "value", ["event_type"])
