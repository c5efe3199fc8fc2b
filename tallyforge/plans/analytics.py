"""Aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import aggregates as A
from tallyforge.operators import audit
from tallyforge.operators import windows as W
from tallyforge.operators.kernels import greedy_uncorrelated
from tallyforge.plans.registry import CORE, Tables

q = CORE.query
r4 = lambda c: F.round(c, 4)


@q("r062_group_by", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, round(avg(l_discount), 6) AS disc, median(l_quantity) AS med, count(*) AS n FROM lineitem GROUP BY 1, 2")
def r062(spark, d):
    l, keys = Tables(spark, d).lineitem, ["l_returnflag", "l_linestatus"]
    sums = l.groupBy(*keys).agg(F.sum("l_quantity").alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count("*").alias("n"))
    return W.join_groups(sums, W.exact_quantiles(l, keys, "l_quantity", {"med": 0.5}), keys)


_S63 = "SELECT season, count(*) AS n, count(DISTINCT player_id) AS players, max(week) AS last_week, min(week) AS first_week FROM {s} GROUP BY season"


@q("r063_sql_summary", _S63.format(s="player_game_stats"))
def r063(spark, d):
    return spark.sql(_S63, s=Tables(spark, d).player_game_stats)


@q("r064_conditional_aggregate", "SELECT season, sum(CASE WHEN completed = 1 THEN 1 ELSE 0 END) AS done, count(*) AS n, count(*) FILTER (home_score > away_score) AS home_wins FROM dim_game GROUP BY season")
def r064(spark, d):
    return Tables(spark, d).dim_game.groupBy("season").agg(F.sum(F.when(F.col("completed") == 1, 1).otherwise(0)).alias("done"), F.count("*").alias("n"), F.count_if(F.col("home_score") > F.col("away_score")).alias("home_wins"))


@q("r065_duplicate_audit", "SELECT snapshot_id, player_id, count(*) AS count FROM player_projection_predictions GROUP BY 1, 2 HAVING count(*) > 1")
def r065(spark, d):
    from tallyforge.operators.joins import duplicate_keys

    return duplicate_keys(Tables(spark, d).player_projection_predictions, ["snapshot_id", "player_id"])


@q("r066_id_conflicts", "SELECT full_name, count(DISTINCT gsis_id) AS n_values FROM player_identity WHERE full_name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT gsis_id) > 1")
def r066(spark, d):
    return audit.conflicts(Tables(spark, d).player_identity, "full_name", "gsis_id")


@q("r067_distinct_count", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def r067(spark, d):
    return Tables(spark, d).events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@q("r067_approx_distinct")
def r067b(spark, d):
    return Tables(spark, d).events.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@q(
    "r068_classify_and_pivot",
    """SELECT user_id, count(*) FILTER (value > 50) AS high, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'click') AS click FROM events GROUP BY user_id
HAVING count(*) FILTER (value > 50 OR event_type IN ('purchase', 'click')) > 0""",
)
def r068(spark, d):
    e = Tables(spark, d).events
    masks = {"high": F.col("value") > 50, "purchase": F.col("event_type") == "purchase", "click": F.col("event_type") == "click"}
    long = e.select("user_id", F.explode(F.array_compact(F.array(*[F.when(m, F.lit(k)) for k, m in masks.items()]))).alias("kind"))
    return long.groupBy("user_id").pivot("kind", list(masks)).count().na.fill(0)


@q("r070_pivot_unique", "SELECT n_regionkey, max(CASE WHEN n_nationkey % 5 = 0 THEN n_name END) AS \"0\", max(CASE WHEN n_nationkey % 5 = 1 THEN n_name END) AS \"1\" FROM nation GROUP BY 1")
def r070(spark, d):
    n = Tables(spark, d).nation.withColumn("k", (F.col("n_nationkey") % 5).cast("string"))
    return n.groupBy("n_regionkey").pivot("k", ["0", "1"]).agg(F.max("n_name"))


@q("r071_crosstab", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY 1")
def r071(spark, d):
    t = Tables(spark, d).orders.groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count().na.fill(0)
    return t.withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})


@q("r072_value_counts", "SELECT origin_id, count(*) AS count FROM source_capture GROUP BY 1 ORDER BY 2 DESC, 1")
def r072(spark, d):
    return Tables(spark, d).source_capture.groupBy("origin_id").count().orderBy(F.desc("count"), "origin_id")


@q(
    "r073_most_common",
    """SELECT user_id, string_agg(event_type || ':' || n, ';' ORDER BY k) AS items FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id), event_type) AS k FROM events GROUP BY 1, 2) WHERE k <= 2 GROUP BY 1""",
)
def r073(spark, d):
    return A.top_items(Tables(spark, d).events, ["user_id"], "event_type", "event_id", 2)


@q("r074_weighted_mean", "SELECT l_returnflag, round(sum(CASE WHEN l_quantity > 10 THEN l_discount * l_quantity END) / sum(CASE WHEN l_quantity > 10 THEN l_quantity END), 6) AS m FROM lineitem GROUP BY 1")
def r074(spark, d):
    rows = Tables(spark, d).lineitem.withColumn("w", F.when(F.col("l_quantity") > 10, F.col("l_quantity")))
    return rows.groupBy("l_returnflag").agg(F.round(A.weighted_mean("l_discount", "w"), 6).alias("m"))


@q("r075_situational_rates", "SELECT user_id, round(avg(CASE WHEN value > 20 THEN CAST(event_type = 'click' AS DOUBLE) END), 6) AS high_rate, round(avg(CAST(event_type = 'click' AS DOUBLE)), 6) AS rate FROM events GROUP BY 1")
def r075(spark, d):
    click = F.col("event_type") == "click"
    return Tables(spark, d).events.groupBy("user_id").agg(F.round(A.rate(F.col("value") > 20, click), 6).alias("high_rate"), F.round(A.rate(F.lit(True), click), 6).alias("rate"))


@q(
    "r077_shrinkage",
    """WITH g AS (SELECT p_brand, p_type, count(p_retailprice) AS n, sum(p_retailprice) AS s FROM part GROUP BY 1, 2), b AS (SELECT p_brand, sum(s) / sum(n) AS parent_mean FROM g GROUP BY 1)
SELECT p_brand, p_type, n, round(parent_mean, 8) AS parent_mean, round((s + parent_mean) / (n + 1), 8) AS estimate FROM g JOIN b USING (p_brand)""",
)
def r077(spark, d):
    x = A.shrunk_means(Tables(spark, d).part, ["p_brand", "p_type"], ["p_brand"], "p_retailprice")
    return x.withColumns({"parent_mean": F.round("parent_mean", 8), "estimate": F.round("estimate", 8)})


@q("r078_moments_and_quantiles", "SELECT l_returnflag, round(avg(l_quantity), 6) AS m, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, quantile_cont(l_quantity, 0.1) AS q10, quantile_cont(l_quantity, 0.9) AS q90 FROM lineitem GROUP BY 1")
def r078(spark, d):
    l, x = Tables(spark, d).lineitem, F.col("l_quantity")
    sums = l.groupBy("l_returnflag").agg(F.round(F.avg(x), 6).alias("m"), F.round(F.stddev_pop(x), 6).alias("sp"), F.round(F.stddev_samp(x), 6).alias("ss"))
    return W.join_groups(sums, W.exact_quantiles(l, ["l_returnflag"], "l_quantity", {"q10": 0.1, "q90": 0.9}), ["l_returnflag"])


@q("r079_guarded_correlation", "SELECT l_shipmode AS k, 0 AS r FROM (SELECT 1 AS l_shipmode) WHERE false")
def r079(spark, d):
    return Tables(spark, d).lineitem.groupBy("l_suppkey").agg(F.round(A.guarded_corr("l_quantity", "l_extendedprice"), 5).alias("r"))


CORE.sql["r079_guarded_correlation"] = "SELECT l_suppkey, round(CASE WHEN count(*) < 20 OR min(l_quantity) = max(l_quantity) OR min(l_extendedprice) = max(l_extendedprice) THEN 0 ELSE corr(l_quantity, l_extendedprice) END, 5) AS r FROM lineitem GROUP BY 1"


@q(
    "r080_correlation_matrix",
    """SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 5) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 5) FROM lineitem
UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 5) FROM lineitem""",
)
def r080(spark, d):
    return A.correlation_pairs(Tables(spark, d).lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).withColumn("r", F.round("r", 5))


@q("r081_error_metrics", "SELECT season, round(avg(abs(home_score - away_score)), 6) AS mae, round(sqrt(avg((home_score - away_score) * (home_score - away_score))), 6) AS rmse, round(avg(home_score - away_score), 6) AS bias FROM dim_game GROUP BY 1")
def r081(spark, d):
    return Tables(spark, d).dim_game.groupBy("season").agg(*A.error_metrics("away_score", "home_score")).select("season", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias")])


_P82 = "CASE WHEN value IS NULL THEN NULL ELSE 1 / (1 + exp(-greatest(least((value - 25) / 20, 35), -35))) END"


@q(
    "r082_classification_metrics",
    f"""WITH x AS (SELECT CAST(event_type = 'purchase' AS INT) AS y, {_P82} AS p FROM events), r AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM x),
m AS (SELECT sum(y) AS np, count(*) AS n, sum(CASE WHEN y = 1 THEN k END) AS s FROM r)
SELECT (SELECT round(-avg(CASE WHEN y = 1 THEN ln(greatest(least(p, 1 - 1e-12), 1e-12)) ELSE ln(1 - greatest(least(p, 1 - 1e-12), 1e-12)) END), 6) FROM x) AS log_loss, (SELECT round(avg((p - y) * (p - y)), 6) FROM x) AS brier,
  round((s - np * (np + 1) / 2.0) / (np * (n - np)), 6) AS auc FROM m""",
)
def r082(spark, d):
    from tallyforge.functions.scalars import sigmoid

    x = Tables(spark, d).events.select((F.col("event_type") == "purchase").cast("int").alias("y"), sigmoid((F.col("value") - 25) / 20).alias("p"))
    one = x.agg(F.round(A.log_loss("y", "p"), 6).alias("log_loss"), F.round(A.brier("y", "p"), 6).alias("brier"), F.lit(1).alias("k"))
    return one.join(A.auc(x, "y", "p").select(F.round("auc", 6).alias("auc"), F.lit(1).alias("k")), "k").drop("k")


@q(
    "r083_lift_and_capture",
    """WITH x AS (SELECT o_orderstatus, CAST(o_totalprice > 250000 AS INT) AS hit, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) / count(*) OVER (PARTITION BY o_orderstatus) AS p FROM orders)
SELECT count(*) AS n, count(*) FILTER (p > 0.8) AS top_n, round(avg(hit), 6) AS base_rate, round(avg(hit) FILTER (p > 0.8), 6) AS top_rate, round((avg(hit) FILTER (p > 0.8)) / avg(hit), 6) AS lift, round((sum(hit) FILTER (p > 0.8)) / sum(hit), 6) AS capture FROM x""",
)
def r083(spark, d):
    o = Tables(spark, d).orders.withColumn("hit", (F.col("o_totalprice") > 250000).cast("int"))
    x = A.capture(o, ["o_orderstatus"], "o_totalprice", "hit", [F.col("o_totalprice").asc(), F.col("o_orderkey").asc()])
    return x.select("n", "top_n", *[F.round(c, 6).alias(c) for c in ("base_rate", "top_rate", "lift", "capture")])


@q(
    "r084_interval_coverage",
    """WITH q AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.25) AS lo, quantile_cont(l_quantity, 0.75) AS hi FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT l_suppkey, round(avg(CAST(l_quantity BETWEEN lo AND hi AS INT)), 6) AS covered FROM lineitem JOIN q USING (l_suppkey) WHERE l_linestatus = 'O' GROUP BY 1""",
)
def r084(spark, d):
    l = Tables(spark, d).lineitem
    band = l.filter("l_linestatus = 'F'").groupBy("l_suppkey").agg(F.percentile("l_quantity", F.array(F.lit(0.25), F.lit(0.75))).alias("b"))
    seen = l.filter("l_linestatus = 'O'").join(band, "l_suppkey")
    return seen.groupBy("l_suppkey").agg(F.round(F.avg(F.col("l_quantity").between(F.col("b")[0], F.col("b")[1]).cast("int")), 6).alias("covered"))


@q("r085_grand_totals", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def r085(spark, d):
    return Tables(spark, d).lineitem.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@q("r086_collected_sets", "SELECT team, string_agg(DISTINCT position, ',' ORDER BY position) AS positions FROM player_game_stats WHERE position IS NOT NULL GROUP BY 1")
def r086(spark, d):
    return Tables(spark, d).player_game_stats.filter("position is not null").groupBy("team").agg(F.array_join(F.sort_array(F.collect_set("position")), ",").alias("positions"))


@q("r088_deviation_from_peers", "SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 3) AS diff FROM orders")
def r088(spark, d):
    o = Tables(spark, d).orders
    means = o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"))
    return W.join_groups(o, means, ["o_orderpriority"]).select("o_orderkey", F.round(F.col("o_totalprice") - F.col("m"), 3).alias("diff"))


@q(
    "r089_terciles",
    "WITH q AS (SELECT quantile_cont(p_retailprice, 1/3) AS a, quantile_cont(p_retailprice, 2/3) AS b FROM part) SELECT p_partkey, CASE WHEN p_retailprice <= a THEN 'LOW' WHEN p_retailprice <= b THEN 'MID' ELSE 'HIGH' END AS tercile FROM part, q",
)
def r089(spark, d):
    return A.tercile_groups(Tables(spark, d).part, "p_retailprice").select("p_partkey", "tercile")


@q(
    "r090_spearman",
    """WITH r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY l_suppkey ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_suppkey, l_discount) - 1) / 2.0 AS y FROM lineitem)
SELECT l_suppkey, round(corr(x, y), 5) AS spearman FROM r GROUP BY 1""",
)
def r090(spark, d):
    return A.spearman(Tables(spark, d).lineitem, ["l_suppkey"], "l_quantity", "l_discount").withColumn("spearman", F.round("spearman", 5))


@q("r091_median_profiles", "SELECT team, position, count(*) AS n, median(CASE WHEN isnan(rushing_yards) THEN NULL ELSE rushing_yards END) AS rushing FROM player_game_stats GROUP BY 1, 2")
def r091(spark, d):
    return Tables(spark, d).player_game_stats.groupBy("team", "position").agg(F.count("*").alias("n"), F.median(F.when(~F.isnan("rushing_yards"), F.col("rushing_yards"))).alias("rushing"))


@q("r092_first_per_group", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders o WHERE o_orderdate = (SELECT min(o_orderdate) FROM orders x WHERE x.o_custkey = o.o_custkey) GROUP BY 1")
def r092(spark, d):
    return W.keep_first(Tables(spark, d).orders, ["o_custkey"], [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()]).select("o_custkey", "o_orderkey")


@q(
    "r093_lagged_features",
    """SELECT event_id, lag(value) OVER w AS last_value, round(avg(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 5) AS mean_3, round(avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 5) AS mean_5,
  max(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS max_5, round(sum(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 5) AS sum_3,
  CASE WHEN count(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) >= 2 THEN round(stddev_pop(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 4) END AS std_5,
  CASE WHEN count(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) >= 2 THEN round(stddev_samp(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 4) END AS sample_std_5,
  sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS high_5, row_number() OVER w - 1 AS prior_rows, count(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS seen_3
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def r093(spark, d):
    p = W.Prior(["user_id"], ["ts", "event_id"])
    five = lambda c: F.round(c, 5)
    return Tables(spark, d).events.select(
        "event_id", p.last("value").alias("last_value"), five(p.mean("value", 3)).alias("mean_3"), five(p.mean("value", 5)).alias("mean_5"), p.max("value", 5).alias("max_5"), five(p.sum("value", 3)).alias("sum_3"),
        r4(p.std("value", 5)).alias("std_5"), r4(p.std("value", 5, 1)).alias("sample_std_5"), p.count_if(F.col("value") > 50, 5).alias("high_5"), p.rows().cast("long").alias("prior_rows"), p.count("value", 3).alias("seen_3"),
    )


@q(
    "r101_cumulative_ratio",
    "SELECT o_orderkey, round(sum(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 3) AS total, row_number() OVER w - 1 AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
def r101(spark, d):
    p = W.Prior(["o_custkey"], ["o_orderdate", "o_orderkey"])
    return Tables(spark, d).orders.select("o_orderkey", F.round(p.total("o_totalprice"), 3).alias("total"), p.rows().cast("long").alias("n"))


@q(
    "r102_eras",
    "SELECT event_id, 1 + sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS era FROM (SELECT *, CASE WHEN row_number() OVER w > 1 AND event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))",
)
def r102(spark, d):
    return W.eras(Tables(spark, d).events, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "era")


@q("r104_trend", "SELECT event_id, round(avg(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) - avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 4) AS trend FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def r104(spark, d):
    p = W.Prior(["user_id"], ["ts", "event_id"])
    return Tables(spark, d).events.select("event_id", r4(p.mean("value", 3) - p.mean("value", 5)).alias("trend"))


@q("r105_rest_days", "SELECT o_orderkey, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS days FROM orders")
def r105(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return Tables(spark, d).orders.select("o_orderkey", F.date_diff(F.to_date("o_orderdate"), F.to_date(F.lag("o_orderdate").over(w))).cast("long").alias("days"))


@q(
    "r106_ranks",
    """SELECT o_orderkey, round(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) / count(*) OVER (PARTITION BY o_orderstatus), 8) AS pct_first,
  rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2.0 AS average,
  rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS lowest, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS ordinal,
  round(CASE WHEN count(o_custkey) OVER (PARTITION BY o_orderpriority) = 1 THEN 1 ELSE (rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2.0 - 1) / (count(o_custkey) OVER (PARTITION BY o_orderpriority) - 1) END, 8) AS points
FROM orders""",
)
def r106(spark, d):
    o = Tables(spark, d).orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey")
    o = W.group_places(o, ["o_orderstatus"], [F.col("o_totalprice").asc(), F.col("o_orderkey").asc()], "first", "n_status")
    o = W.group_places(o, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey").asc()], "ordinal", "n_priority")
    o = W.join_groups(o, W.value_ranks(o, ["o_orderpriority"], "o_custkey"), ["o_orderpriority", "o_custkey"])
    average = F.col("before") + (F.col("ties") + 1) / 2.0
    points = F.when(F.col("n") == 1, 1.0).otherwise((average - 1) / F.nullif(F.col("n") - 1, F.lit(0)))
    return o.select("o_orderkey", F.round(F.col("first") / F.col("n_status"), 8).alias("pct_first"), average.alias("average"), (F.col("before") + 1).cast("int").alias("lowest"), F.col("ordinal").cast("int").alias("ordinal"), F.round(points, 8).alias("points"))


@q(
    "r110_quintiles",
    """SELECT c_custkey, CASE ceil(5.0 * row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) / count(*) OVER (PARTITION BY c_nationkey)) WHEN 1 THEN 'Q1_LOW' WHEN 2 THEN 'Q2' WHEN 3 THEN 'Q3' WHEN 4 THEN 'Q4' ELSE 'Q5_HIGH' END AS bucket
FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey) >= 5""",
)
def r110(spark, d):
    c = W.group_places(Tables(spark, d).customer.filter("c_acctbal is not null"), ["c_nationkey"], [F.col("c_acctbal").asc(), F.col("c_custkey").asc()])
    return c.filter("n >= 5").select("c_custkey", W.fifth(F.col("place"), F.col("n")).alias("bucket"))


@q("r111_group_value_on_rows", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders")
def r111(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", F.max("o_totalprice").over(Window.partitionBy("o_custkey")).alias("top"))


@q(
    "r112_tail_features",
    """WITH k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, max(CASE WHEN k = 1 THEN value END) AS last, round(avg(value), 5) AS mean, round(sum(value), 5) AS total, round(CASE WHEN count(value) >= 2 THEN stddev_pop(value) END, 4) AS spread, count(*) AS n FROM k WHERE k <= 3 GROUP BY 1""",
)
def r112(spark, d):
    x = W.tail_features(Tables(spark, d).events, ["user_id"], [F.desc("ts"), F.desc("event_id")], "value", 3)
    return x.select("user_id", "last", F.round("mean", 5).alias("mean"), F.round("total", 5).alias("total"), r4("spread").alias("spread"), "n")


@q("r114_first_available", "SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer WHERE c_mktsegment <> 'MACHINERY') WHERE k = 1")
def r114(spark, d):
    free = Tables(spark, d).customer.filter("c_mktsegment <> 'MACHINERY'")
    return W.keep_first(free, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey").asc()]).select("c_nationkey", "c_custkey")


@q("r115_stable_sort", "SELECT id, salary, fppg FROM fanduel_players_list ORDER BY fppg NULLS LAST, id")
def r115(spark, d):
    return Tables(spark, d).fanduel_players_list.select("id", "salary", "fppg").orderBy(F.col("fppg").asc_nulls_last(), "id")


@q("r116_order_by_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def r116(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@q("r117_top_k_per_group", "SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 5")
def r117(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return Tables(spark, d).orders.withColumn("k", F.row_number().over(w)).filter("k <= 5").select("o_orderpriority", "o_orderkey")


@q("r118_greedy_features")
def r118(spark, d):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    pairs = {(r["a"], r["b"]): r["r"] for r in A.correlation_pairs(Tables(spark, d).lineitem, cols).collect()}  # features x features
    return spark.createDataFrame([(i, f) for i, f in enumerate(greedy_uncorrelated(pairs, cols, 0.85, 12))], "place int, feature string")


@q("r119_union_all", "SELECT s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_name, c_acctbal, c_mktsegment FROM customer")
def r119(spark, d):
    t = Tables(spark, d)
    return t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")).unionByName(t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@q("r120_union_distinct", "SELECT home_team AS team FROM dim_game UNION SELECT team FROM player_game_stats")
def r120(spark, d):
    t = Tables(spark, d)
    return t.dim_game.select(F.col("home_team").alias("team")).unionByName(t.player_game_stats.select("team")).distinct()


@q("r121_intersect_except", "(SELECT c_nationkey AS k, 'both' AS part FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'customer' FROM customer EXCEPT SELECT s_nationkey, 'customer' FROM supplier)")
def r121(spark, d):
    t = Tables(spark, d)
    c, s = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("part", F.lit("both")).unionByName(c.subtract(s).withColumn("part", F.lit("customer")))


@q(
    "r122_compared_frames",
    """WITH o AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal > 0), n AS (SELECT c_custkey AS k, CASE WHEN c_nationkey < 5 THEN c_acctbal + 1 ELSE c_acctbal END AS v FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NULL THEN 'left_only' WHEN o.k IS NULL THEN 'right_only' WHEN abs(o.v - n.v) > 0.001 THEN 'differs' ELSE 'same' END AS verdict FROM o FULL JOIN n ON o.k = n.k""",
)
def r122(spark, d):
    c = Tables(spark, d).customer
    v = F.col("c_acctbal")
    old = c.filter(v > 0).select(F.col("c_custkey").alias("k"), v.alias("v"))
    new = c.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("k"), F.when(F.col("c_nationkey") < 5, v + 1).otherwise(v).alias("v"))
    return audit.compared(old, new, ["k"], ["v"], 0.001)
