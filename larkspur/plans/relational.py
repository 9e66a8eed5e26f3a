"""Shaping, joining, ranking and cleaning of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import describe, prepare, select
from ..operators.cumulative import percentiles
from ..sources import files
from ..sources.session import table
from .registry import query


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) WHERE k = 1")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return select.best_per_group(rows, ["p_brand"], [-F.col("p_retailprice"), F.col("p_partkey")])


@query("""WITH k AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
  SELECT p_brand, p_partkey, p_retailprice FROM k WHERE k <= greatest(1, floor(n * 0.1::DOUBLE))""")
def top_n_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice")
    return select.top_within(rows, ["p_brand"], "p_retailprice", "p_partkey", 0.1)


@query("""WITH n AS (SELECT l_suppkey, sum(l_quantity) AS v FROM lineitem GROUP BY l_suppkey), t AS (SELECT * FROM n ORDER BY v DESC, l_suppkey LIMIT 10)
  SELECT l_suppkey, v, round(v / sum(v) OVER (), 6) AS share FROM t""")
def top_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest, a report of a fixed length, with shares of their sum."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("v"))
    return select.top_shares(sums, "l_suppkey", "v", 10).withColumn("share", S.rounded(F.col("share")))


INTERVALS = """SELECT l_returnflag, l_linestatus, round(avg(l_discount), 5) AS e, round(quantile_cont(l_discount, 0.025), 5) AS lo, round(quantile_cont(l_discount, 0.975), 5) AS hi FROM lineitem GROUP BY 1, 2"""


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, keys = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_discount"), ["l_returnflag", "l_linestatus"]
    grouped = rows.groupBy(*keys).agg(F.avg("l_discount").alias("mean")).join(percentiles(rows, "l_discount", (0.025, 0.975), ("lo", "hi"), keys), keys)
    return grouped.select("l_returnflag", "l_linestatus", *(S.rounded(F.col(c), 5).alias(n) for c, n in (("mean", "e"), ("lo", "lo"), ("hi", "hi"))))


@query(f"WITH i AS ({INTERVALS}) SELECT l_returnflag, l_linestatus, printf('%.5f, (%.5f, %.5f)', e, lo, hi) AS packed, e AS est, lo, hi FROM i")
def ci_pack_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _intervals(spark, sf_dir).select("l_returnflag", "l_linestatus", S.packed(F.col("e"), F.col("lo"), F.col("hi")).alias("packed"))
    return rows.withColumn("__u", S.unpacked(F.col("packed"))).select("l_returnflag", "l_linestatus", "packed", "__u.*")


@query(f"""WITH i AS ({INTERVALS}), m AS (SELECT *, unnest(['norm_cost', 'accuracy']) AS metric FROM i),
  k AS (SELECT *, row_number() OVER (PARTITION BY metric, l_linestatus ORDER BY CASE WHEN metric LIKE '%norm%' OR metric LIKE '%error%' THEN hi ELSE -lo END, l_returnflag) AS k FROM m)
  SELECT metric, l_linestatus, l_returnflag, lo, hi FROM k WHERE k = 1""")
def direction_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _intervals(spark, sf_dir).withColumn("metric", F.explode(F.array(F.lit("norm_cost"), F.lit("accuracy"))))
    return select.best_by_interval(rows, ["metric", "l_linestatus"], "metric", "lo", "hi", "l_returnflag").select("metric", "l_linestatus", "l_returnflag", "lo", "hi")


@query("SELECT o_orderkey, o_totalprice FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) WHERE abs(o_totalprice - m) <= 1.5 * s")
def outlier_sd_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.within_sd(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 1.5)


@query("SELECT o_orderkey, o_totalprice FROM orders, (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) WHERE abs(o_totalprice - m) <= 3 * s")
def outlier_3sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.within_sd(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 3.0)


@query("SELECT event_id, event_type, value FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY event_type) USING (event_type) WHERE abs(value - m) < 2 * s")
def outlier_z2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.within_sd(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "value", 2.0, False, ["event_type"])


@query("""SELECT event_id, event_type, value FROM events JOIN (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events GROUP BY event_type) USING (event_type)
  WHERE abs(value - m) < 1.5 * (b - a)""")
def outlier_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.within_iqr(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "value", 1.5, ["event_type"])


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem) WHERE abs(l_quantity - m) < 1.5 * s),
  b AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM a)
  SELECT l_linenumber, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM a, b WHERE abs(l_extendedprice - m) < 1.5 * s GROUP BY l_linenumber""")
def outlier_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second column's bounds come from the rows that the first one left."""
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", "l_extendedprice")
    left = prepare.within_sd_in_turn(rows, ["l_quantity", "l_extendedprice"], 1.5)
    return left.groupBy("l_linenumber").agg(F.count("*").alias("n"), S.rounded(F.sum("l_extendedprice"), 2).alias("total"))


@query("""WITH q AS (SELECT quantile_cont(s_acctbal, 0.25) AS a, quantile_cont(s_acctbal, 0.5) AS m, quantile_cont(s_acctbal, 0.75) AS b FROM supplier) SELECT s_suppkey FROM supplier, q WHERE NOT abs(s_acctbal - m) < 0.75 * (b - a)""")
def outlier_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the rows that a filter by median and quartiles drops."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return prepare.outside(rows, prepare.within_iqr(rows, "s_acctbal", 0.75), ["s_suppkey"]).select("s_suppkey")


@query("SELECT event_id, value FROM events WHERE value <= 50")
def cut_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "value").where("value <= 50")


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"count(CASE WHEN event_type = '{t}' THEN 1 END) AS n_{t}, round(avg(CASE WHEN event_type = '{t}' THEN value END), 6) AS mean_{t}" for t in TYPES) + " FROM events GROUP BY user_id")
def pivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    w = prepare.wide(rows, "user_id", "event_type", TYPES, {"n": F.count("value"), "mean": F.avg("value")})
    return w.select("user_id", *(x for t in TYPES for x in (F.coalesce(f"{t}_n", F.lit(0)).alias(f"n_{t}"), S.rounded(F.col(f"{t}_mean")).alias(f"mean_{t}"))))


@query("""WITH a AS (SELECT o_custkey AS id, count(*) AS n_orders FROM orders GROUP BY 1), b AS (SELECT user_id AS id, count(*) AS n_events FROM events GROUP BY 1), c AS (SELECT c_custkey AS id, c_nationkey FROM customer WHERE c_acctbal > 0)
  SELECT id, n_orders, n_events, c_nationkey FROM a FULL JOIN b USING (id) FULL JOIN c USING (id)""")
def outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"))
    b = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n_events"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), "c_nationkey")
    return prepare.full_merge([a, b, c])


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1")
def left_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(nations, "c_nationkey", "left").select("c_custkey", "n_name")


@query("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def natural_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.natural_join(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(rich, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return files.pending(table(spark, sf_dir, "customer").select("c_custkey"), rich, ["c_custkey"])


@query("SELECT a.s_nationkey, a.s_suppkey AS a_s_suppkey, b.s_suppkey AS b_s_suppkey FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND a.s_acctbal <> b.s_acctbal")
def theta_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    return prepare.unordered_pairs(rows, "s_suppkey", "s_acctbal", ["s_nationkey"], []).select("s_nationkey", "a_s_suppkey", "b_s_suppkey")


@query("SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL, s_acctbal FROM supplier")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return prepare.union_all([a, b])


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return a.subtract(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    return a.intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT doc_id, lang, CAST(coalesce(CASE WHEN lang <> 'es' THEN dense_rank() OVER (PARTITION BY lang <> 'es' ORDER BY lang) - 1 END, -1) AS INTEGER) AS code FROM documents")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.nullif("lang", F.lit("es")).alias("known"))
    return prepare.label_codes(rows, "known", "code").select("doc_id", "lang", "code")


@query("""WITH e AS (SELECT event_id, nullif(event_type, 'view') AS t, CASE WHEN value >= 90 THEN NULL ELSE value END AS v FROM events), r AS (SELECT avg(CASE WHEN t IS NULL THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS b FROM e)
  SELECT event_id, t, v FROM e, r WHERE greatest(a, b) <= 0.15 OR (t IS NOT NULL AND v IS NOT NULL)""")
def missingness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("t"), F.when(F.col("value") < 90, F.col("value")).alias("v"))
    return prepare.listwise_if_sparse(rows, ["t", "v"], 0.15)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_quantity > 25 AND l_discount > 0.05 THEN l_tax WHEN l_quantity > 25 THEN (l_discount + l_tax) / 2 WHEN l_discount > 0.05 THEN (l_quantity + l_tax) / 2
  ELSE (l_quantity + l_discount + l_tax) / 3 END, 6) AS mean FROM lineitem""")
def rowwise_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.when(F.col("l_quantity") <= 25, F.col("l_quantity")), F.when(F.col("l_discount") <= 0.05, F.col("l_discount")), F.col("l_tax")]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.rounded(S.row_mean(parts)).alias("mean"))


@query("SELECT o_orderkey, round(o_totalprice / nullif(sum(o_totalprice) OVER (PARTITION BY o_custkey), 0), 6) AS share FROM orders")
def share_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", S.rounded(S.share_within(F.col("o_totalprice"), "o_custkey")).alias("share"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return prepare.first_of_each(rows, ["user_id"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()


@query("SELECT user_id, array_to_string(list(event_type ORDER BY ts, event_id), ',') AS types FROM events GROUP BY user_id")
def ordered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type")
    return describe.ordered_list(rows, ["user_id"], "at", "event_type").select("user_id", F.array_join("values", ",").alias("types"))


@query("SELECT p_partkey, split_part(p_name, ' ', 2) AS second, CASE WHEN lower(p_brand) IN ('brand#1', 'brand#12') THEN 1 ELSE 0 END AS coded, instr(p_name, 'a') > 0 AS has_a, replace(replace(p_name, 'a', 'A'), 'A ', '_') AS renamed FROM part")
def text_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.coalesce(S.key_part(F.col("p_name"), " ", 2), F.lit("")).alias("second"), S.binary(F.col("p_brand"), ["Brand#1", "BRAND#12"]).alias("coded"),
        F.col("p_name").contains("a").alias("has_a"), S.replaced(F.col("p_name"), [("a", "A"), ("A ", "_")]).alias("renamed"),
    )


@query("SELECT event_id, CASE WHEN TRY_CAST(t AS DOUBLE) IN (0, 1) THEN CAST(TRY_CAST(t AS DOUBLE) AS INTEGER) END AS flag, round(ln(greatest(value, 0.01::DOUBLE)), 6) AS logged, round(least(greatest(value, 10::DOUBLE), 90::DOUBLE), 6) AS clipped FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(event_id % 3 - 1 AS VARCHAR) END AS t FROM events)")
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, "x").otherwise((F.col("event_id") % 3 - 1).cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", S.zero_or_one(text).alias("flag"), S.rounded(F.ln(F.greatest("value", F.lit(0.01)))).alias("logged"), S.rounded(S.clipped(F.col("value"), 10.0, 90.0)).alias("clipped")
    )


@query("""WITH e AS (SELECT event_type, CASE WHEN value < 50 THEN value END AS v, CASE WHEN user_id % 2 = 0 THEN user_id END AS u FROM events)
  SELECT 'v' AS "column", sum(CASE WHEN v IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_null, count(*) AS n FROM e UNION ALL SELECT 'u', sum(CASE WHEN u IS NULL THEN 1 ELSE 0 END)::BIGINT, count(*) FROM e""")
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.when(F.col("value") < 50, F.col("value")).alias("v"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("u"))
    return describe.null_counts(rows, ["v", "u"])


@query("""WITH e AS (SELECT event_type, CASE WHEN value < 50 THEN value END AS v, CASE WHEN user_id % 2 = 0 THEN user_id END AS u FROM events)
  SELECT event_type, 'both' AS part, sum(CASE WHEN v IS NOT NULL OR u IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS n FROM e GROUP BY 1 UNION ALL SELECT event_type, 'v', count(v) FROM e GROUP BY 1""")
def present_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.when(F.col("value") < 50, F.col("value")).alias("v"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("u"))
    return prepare.present_by_group(rows, "event_type", {"both": ["v", "u"], "v": ["v"]})


@query("SELECT doc_id, coalesce(quality, -10) AS filled, 1 - coalesce(toxic, 0) AS clean FROM documents LEFT JOIN labels USING (doc_id)")
def constant_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", S.filled(F.col("quality"), -10).alias("filled"), (1 - F.coalesce("toxic", F.lit(0))).alias("clean"))


@query("""WITH r AS (SELECT o_orderstatus AS k, o_orderpriority AS data_file, CAST(1 + o_orderkey % 4 AS INTEGER) AS version FROM orders)
  SELECT k, coalesce(max(CASE WHEN data_file = '1-URGENT' THEN version END), max(version) + 1) AS version FROM r GROUP BY k""")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("k"), F.col("o_orderpriority").alias("data_file"), (1 + F.col("o_orderkey") % 4).cast("int").alias("version"))
    return files.next_version(rows, ["k"], "1-URGENT")


@query("""WITH u AS (SELECT o_custkey AS id, o_orderkey AS ref, 0 AS s FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders), m AS (SELECT id, min(s) AS s FROM u GROUP BY id)
  SELECT id, ref FROM u JOIN m USING (id, s)""")
def source_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ref"), "o_totalprice")
    return files.by_precedence([rows.where("o_totalprice > 300000").drop("o_totalprice"), rows.drop("o_totalprice")], ["id"])


@query("SELECT b, m, CAST(b AS INTEGER) * 10 + m AS cell FROM (SELECT unnest([1, 2, 3]) AS b) , (SELECT unnest([4, 5]) AS m)")
def parameter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = spark.createDataFrame([(1,), (2,), (3,)], "b int"), spark.createDataFrame([(4,), (5,)], "m int")
    return a.crossJoin(F.broadcast(b)).withColumn("cell", F.col("b") * 10 + F.col("m"))


@query("""WITH d AS (SELECT l_shipmode AS k, e FROM (SELECT l_returnflag AS l_shipmode, avg(l_tax) AS e FROM lineitem GROUP BY 1)), h AS (SELECT l_returnflag AS k, avg(l_discount) AS e FROM lineitem GROUP BY 1), b AS (SELECT k, d.e AS a, h.e AS c FROM d JOIN h USING (k))
  SELECT k, round(a, 6) AS development, round(c, 6) AS holdout, round(min(least(a, c)) OVER (), 6) AS axis_low, round(max(greatest(a, c)) OVER (), 6) AS axis_high FROM b""")
def development_vs_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("k"))
    both = select.development_and_holdout(rows.agg(F.avg("l_tax").alias("e")), rows.agg(F.avg("l_discount").alias("e")), ["k"], "e")
    return both.select("k", *(S.rounded(F.col(c)).alias(c) for c in ("development", "holdout", "axis_low", "axis_high")))


