
from __future__ import annotations

import base64

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import aggregates as A
from tallyforge.operators import joins as J
from tallyforge.operators import kernels as K
from tallyforge.operators import windows as W
from tallyforge.operators.audit import hash_chains
from tallyforge.plans.pipelines import BOX, KEY, ORDER, PW, box
from tallyforge.plans.registry import CORE, Tables
from tallyforge.session import scratch_path, shared_dir
from tallyforge.sources import csv_table, discovered_files, html_fields, rss_items
from tallyforge.sources.sinks import Artifacts, Ledger, mirror, publish, published, replace_partitions

q = CORE.query


@q("r005_csv_scan", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def r005(spark, d):
    path = scratch_path(spark, "csv")
    Tables(spark, d).supplier.select("s_suppkey", "s_name", "s_acctbal").write.option("header", True).csv(path)
    return csv_table(spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@q("r006_directory_discovery", "SELECT 'o_orderpriority=' || o_orderpriority AS folder, count(*) AS n_rows FROM orders GROUP BY 1")
def r006(spark, d):
    """Files found under a folder by pattern and read as they are found: rows by the folder they lie in."""
    path = scratch_path(spark, "files")
    Tables(spark, d).orders.select("o_orderkey", "o_orderpriority").repartition("o_orderpriority").write.partitionBy("o_orderpriority").csv(path)
    found = discovered_files(spark, path, "*.csv").select(F.regexp_extract("path", r"(o_orderpriority=[^/]+)/", 1).alias("folder"), "path")
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.url_decode(F.regexp_extract(F.input_file_name(), r"(o_orderpriority=[^/]+)/", 1)).alias("folder"))
    return lines.join(found.select(F.url_decode("folder").alias("folder")).distinct(), "folder").groupBy("folder").agg(F.count("*").alias("n_rows"))


@q("r008_json_pages", "SELECT 200 AS status, r_regionkey, r_name FROM region")
def r008(spark, d):
    """JSON documents fetched by URL, one each in a partition of its own; here the documents are in the URLs themselves."""
    from tallyforge.sources import JsonPages

    spark.dataSource.register(JsonPages)
    bodies = Tables(spark, d).region.select(F.to_json(F.struct("r_regionkey", "r_name")).alias("j")).collect()  # five regions, a URL each
    urls = ["data:application/json;base64," + base64.b64encode(b["j"].encode()).decode() for b in bodies]
    pages = spark.read.format("json_pages").option("urls", " ".join(urls)).load()
    fields = F.from_json("body", "r_regionkey int, r_name string")
    return pages.select("status", fields["r_regionkey"].alias("r_regionkey"), fields["r_name"].alias("r_name"))


@q(
    "r009_rss_items",
    "SELECT capture_id AS id, trim(headline) AS title, json_extract_string(raw_feed_fields, '$.pubDate') AS pub_date FROM source_capture WHERE headline IS NOT NULL",
)
def r009(spark, d):
    """Feeds with all items of a batch and source, read back item by item."""
    mark = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>")), F.lit(""))
    item = F.concat(F.lit("<item>"), tag("guid", F.col("capture_id").cast("string")), tag("title", mark(F.trim("headline"))), tag("pubDate", mark(F.get_json_object("raw_feed_fields", "$.pubDate"))), F.lit("</item>"))
    rows = Tables(spark, d).source_capture.filter("headline is not null").select("batch_id", "source", item.alias("item"))
    feed = rows.groupBy("batch_id", "source").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list("item"), ""), F.lit("</channel></rss>")).alias("xml"))
    return rss_items(feed, "xml").select(F.col("guid").cast("bigint").alias("id"), "title", "pub_date")


@q("r010_html_fields", r"SELECT doc_id, split_part(part, '</p>', 1) AS paragraph FROM (SELECT doc_id, unnest(string_split(text, '<p>')[2:]) AS part FROM documents WHERE text IS NOT NULL)")
def r010(spark, d):
    """Whole paragraphs; one that is not closed ends at the next or with the text."""
    return html_fields(Tables(spark, d).documents.filter("text is not null"), ["doc_id"], "text", r"(?s)<p>(.*?)(?=</p>|<p>|\z)", ["paragraph"])


@q("r014_full_replace", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def r014(spark, d):
    path, o = scratch_path(spark, "table"), Tables(spark, d).orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    publish(o, path)
    publish(o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), path)
    return published(spark, path)


@q("r016_partition_replace", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '2%' THEN 'new' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders")
def r016(spark, d):
    path, o = scratch_path(spark, "parts"), Tables(spark, d).orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    replace_partitions(o, path, ["o_orderpriority"])
    replace_partitions(o.filter("o_orderpriority like '2%'").withColumn("o_orderstatus", F.lit("new")), path, ["o_orderpriority"])
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@q(
    "r019_ledger",
    """WITH p AS (SELECT season, count(*) AS n FROM player_game_stats GROUP BY 1) SELECT 'first' AS snapshot_id, sum(n) AS n FROM p UNION ALL SELECT 'all but the last season', sum(n) FROM p WHERE season < (SELECT max(season) FROM p)
UNION ALL SELECT 'turned', sum(n) FROM p""",
)
def r019(spark, d):
    """Snapshots of box scores: the same rows in another order are refused, other rows and moved NULLs are not."""
    rows, ledger = Tables(spark, d).player_game_stats, Ledger(spark, scratch_path(spark, "ledger"))
    last = rows.agg(F.max("season")).first()[0]
    turned = rows.withColumns({"player_name": F.col("player_display_name"), "player_display_name": F.col("player_name")})
    for name, df in {"first": rows, "again": rows.orderBy("player_id"), "all but the last season": rows.filter(F.col("season") < last), "turned": turned}.items():
        ledger.append(name, "2024-01-01T00:00:00Z", df)
    return ledger.rows().groupBy("snapshot_id").agg(F.count("*").alias("n"))


@q("r020_mirror", "SELECT count(*) AS parquet, count(*) AS csv FROM customer")
def r020(spark, d):
    return spark.createDataFrame([mirror(Tables(spark, d).customer, scratch_path(spark, "mirror"))], "parquet bigint, csv bigint")


@q(
    "r023_artifacts",
    "WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders) SELECT 'whole' AS name, n, true AS first_put FROM o UNION ALL SELECT 'again', n, false FROM o UNION ALL SELECT 'part', f, true FROM o",
)
def r023(spark, d):
    """Tables kept under the hash of their content: the same rows in another order are there already."""
    o, store = Tables(spark, d).orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), Artifacts(spark, scratch_path(spark, "artifacts"))
    put = {"whole": store.put(o), "again": store.put(o.orderBy("o_totalprice")), "part": store.put(o.filter("o_orderstatus = 'F'"))}
    return spark.createDataFrame([(name, store.get(digest).count(), new) for name, (digest, new) in put.items()], "name string, n bigint, first_put boolean")


@q("r033_component_scores", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS a, CAST(l_returnflag = 'R' AS INT) * 6 AS b, round(l_quantity * 2 + CAST(l_returnflag = 'R' AS INT) * 6 + l_discount, 4) AS total FROM lineitem")
def r033(spark, d):
    parts = Tables(spark, d).lineitem.withColumns({"a": F.col("l_quantity") * 2, "b": (F.col("l_returnflag") == "R").cast("int") * 6})
    return parts.select("l_orderkey", "l_linenumber", "a", "b", F.round(F.col("a") + F.col("b") + F.col("l_discount"), 4).alias("total"))


@q("r050_not_in_set", "SELECT DISTINCT gsis_id FROM injury_consensus_current WHERE gsis_id NOT IN (SELECT player_id FROM player_game_stats WHERE player_id IS NOT NULL)")
def r050(spark, d):
    t = Tables(spark, d)
    return t.injury_consensus_current.select("gsis_id").distinct().join(t.player_game_stats.select(F.col("player_id").alias("gsis_id")), "gsis_id", "left_anti")


@q(
    "r054_history_before_each_row",
    """SELECT o_orderkey, count(*) OVER w AS n_before, round(sum(o_totalprice) OVER w, 3) AS spent_before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def r054(spark, d):
    # strictly earlier times, whatever the ties: a range frame instead of a join of each row with its history
    o = Tables(spark, d).orders.withColumn("at", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    w = Window.partitionBy("o_custkey").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    return o.select("o_orderkey", F.count("*").over(w).alias("n_before"), F.round(F.sum("o_totalprice").over(w), 3).alias("spent_before"))


@q(
    "r069_allowed_by_kind",
    """SELECT season, home_team AS team, sum(away_score) FILTER (game_type = 'REG') AS reg, sum(away_score) FILTER (game_type <> 'REG') AS post FROM dim_game GROUP BY ALL""",
)
def r069(spark, d):
    g = Tables(spark, d).dim_game.withColumn("kind", F.when(F.col("game_type") == "REG", "reg").otherwise("post"))
    return g.groupBy("season", F.col("home_team").alias("team")).pivot("kind", ["reg", "post"]).agg(F.sum("away_score"))


@q(
    "r076_regime_profile",
    f"""WITH {BOX}, g AS (SELECT team, season, week, season_type, sum(carries) AS runs, sum(targets) AS passes FROM box GROUP BY ALL)
SELECT team, count(*) AS games, sum(runs + passes) AS plays, round(CASE WHEN sum(runs + passes) > 0 THEN sum(passes) / sum(runs + passes) END, 6) AS pass_rate,
  CASE WHEN count(*) >= 6 AND sum(runs + passes) >= 300 THEN 'HIGH' WHEN count(*) >= 3 AND sum(runs + passes) >= 140 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM g GROUP BY 1""",
)
def r076(spark, d):
    g = box(spark, d).groupBy("team", "season", "week", "season_type").agg(F.sum("carries").alias("runs"), F.sum("targets").alias("passes"))
    p = g.groupBy("team").agg(F.count("*").alias("games"), F.sum(F.col("runs") + F.col("passes")).alias("plays"), F.sum("passes").alias("passes"))
    sure = F.when((F.col("games") >= 6) & (F.col("plays") >= 300), "HIGH").when((F.col("games") >= 3) & (F.col("plays") >= 140), "MEDIUM").otherwise("LOW")
    return p.select("team", "games", "plays", F.round(F.try_divide("passes", F.nullif("plays", F.lit(0.0))), 6).alias("pass_rate"), sure.alias("confidence"))


@q(
    "r087_expected_value_tiers",
    """SELECT team, CASE WHEN m < 0.5 THEN 10.0 WHEN m < 6.5 THEN 7.0 WHEN m < 13.5 THEN 4.0 WHEN m < 20.5 THEN 1.0 WHEN m < 27.5 THEN 0.0 WHEN m < 34.5 THEN -1.0 ELSE -4.0 END AS points FROM (SELECT home_team AS team, avg(away_score) AS m FROM dim_game GROUP BY 1)""",
)
def r087(spark, d):
    m = Tables(spark, d).dim_game.groupBy(F.col("home_team").alias("team")).agg(F.avg("away_score").alias("m"))
    steps = [(0.5, "10"), (6.5, "7"), (13.5, "4"), (20.5, "1"), (27.5, "0"), (34.5, "-1")]
    return m.select("team", S.band("m", steps, "-4").cast("double").alias("points"))


@q(
    "r148_blend_tuning",
    """WITH r AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) / count(*) OVER () AS a, row_number() OVER (ORDER BY c_name, c_custkey) / count(*) OVER () AS b FROM customer)
SELECT w * 0.1 AS w, round(avg(abs((w * 0.1) * a + (1 - w * 0.1) * b - a)), 6) AS mae FROM r, (SELECT unnest(generate_series(0, 10)) AS w) GROUP BY ALL""",
)
def r148(spark, d):
    # ranks over the whole table come from range partitions, and all weights are tried in one pass over the rows
    c = Tables(spark, d).customer.select("c_custkey", "c_acctbal", "c_name", F.lit(1).alias("one"))
    n = c.count()
    a = W.global_order_sums(c, ["c_acctbal", "c_custkey"], "one", "ra")
    b = W.global_order_sums(a, ["c_name", "c_custkey"], "one", "rb")
    ra, rb = (F.col("ra") + 1) / n, (F.col("rb") + 1) / n
    one = b.agg(*[F.avg(F.abs(F.lit(w * 0.1) * ra + F.lit(1 - w * 0.1) * rb - ra)).alias(f"m{w}") for w in range(11)])
    return one.select(F.inline(F.array(*[F.struct((F.lit(w) * F.lit(0.1)).alias("w"), F.round(F.col(f"m{w}"), 6).alias("mae")) for w in range(11)])))


@q("r151_gradient_boosting")
def r151(spark, d):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    l = Tables(spark, d).lineitem.select("l_quantity", "l_discount", "l_tax", F.col("l_extendedprice").alias("label"), "l_linestatus")
    rows = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(l)
    # rounds, rate, leaves (16 for 15) and least rows of a leaf as in the reference
    shared_dir(spark)  # trees are checkpointed there, so that lineage does not grow with the rounds
    model = GBTRegressor(maxIter=200, stepSize=0.05, maxDepth=4, minInstancesPerNode=30, seed=1).fit(rows.filter("l_linestatus = 'F'"))
    return model.transform(rows.filter("l_linestatus = 'O'")).agg(F.count("*").alias("n"), *A.error_metrics("label", "prediction"))


@q(
    "r156_recency_blend",
    f"""WITH {BOX} SELECT {", ".join(KEY)}, round(0.5 * coalesce(lag(fantasy_points) OVER {PW}), 0) + 0.3 * coalesce(avg(fantasy_points) OVER {PW} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) + 0.2 * coalesce(avg(fantasy_points) OVER {PW} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0), 5) AS blend FROM box""",
)
def r156(spark, d):
    p = W.Prior(["player_id"], ORDER)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return box(spark, d).select(*KEY, F.round(0.5 * z(p.last("fantasy_points")) + 0.3 * z(p.mean("fantasy_points", 3)) + 0.2 * z(p.mean("fantasy_points", 5)), 5).alias("blend"))


@q(
    "r159_opportunity_transfer",
    f"""WITH {BOX}, o AS (SELECT DISTINCT season, week, gsis_id AS player_id FROM injury_consensus_current WHERE upper(trim(report_status)) = 'OUT'),
x AS (SELECT b.*, o.player_id IS NOT NULL AS gone, sum(CASE WHEN o.player_id IS NOT NULL THEN carries ELSE 0 END) OVER w AS freed, sum(CASE WHEN o.player_id IS NULL THEN carries ELSE 0 END) OVER w AS kept FROM box b LEFT JOIN o USING (season, week, player_id) WINDOW w AS (PARTITION BY season, week, season_type, team))
SELECT {", ".join(KEY)}, round(CASE WHEN kept = 0 THEN carries WHEN gone THEN 0 ELSE carries + freed * carries / kept END, 5) AS carries FROM x""",
)
def r159(spark, d):
    """Carries of players who are out go to the team's others by their carries; the team's total stays the same."""
    out = Tables(spark, d).injury_consensus_current.filter(F.upper(F.trim("report_status")) == "OUT").select("season", "week", F.col("gsis_id").alias("player_id"), F.lit(True).alias("gone")).distinct()
    w = Window.partitionBy("season", "week", "season_type", "team")
    rows = box(spark, d).join(out, ["season", "week", "player_id"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    rows = rows.withColumns({"freed": F.sum(F.when(F.col("gone"), F.col("carries")).otherwise(0.0)).over(w), "kept": F.sum(F.when(~F.col("gone"), F.col("carries")).otherwise(0.0)).over(w)})
    carries = F.when(F.col("kept") == 0, F.col("carries")).when(F.col("gone"), 0.0).otherwise(F.col("carries") + F.col("freed") * F.col("carries") / F.nullif("kept", F.lit(0.0)))
    return rows.select(*KEY, F.round(carries, 5).alias("carries"))


@q(
    "r172_availability_gate",
    f"""WITH {BOX}, b AS (SELECT DISTINCT season, week, gsis_id AS player_id FROM injury_consensus_current WHERE upper(trim(report_status)) IN ('OUT', 'DOUBTFUL', 'INACTIVE'))
SELECT season, count(*) AS n, count(*) FILTER (b.player_id IS NOT NULL) AS blocked, count(*) FILTER (b.player_id IS NOT NULL AND fantasy_points > 0) AS escaped FROM box LEFT JOIN b USING (season, week, player_id) GROUP BY 1""",
)
def r172(spark, d):
    from tallyforge.plans.pipelines import BLOCK

    b = Tables(spark, d).injury_consensus_current.filter(F.upper(F.trim("report_status")).isin(BLOCK)).select("season", "week", F.col("gsis_id").alias("player_id")).distinct().withColumn("b", F.lit(True))
    rows = box(spark, d).join(b, ["season", "week", "player_id"], "left")
    return rows.groupBy("season").agg(F.count("*").alias("n"), F.count_if(F.col("b")).alias("blocked"), F.count_if(F.col("b") & (F.col("fantasy_points") > 0)).alias("escaped"))


@q(
    "r176_outcome_evaluation",
    f"""WITH {BOX}, c AS (SELECT DISTINCT season, week, gsis_id AS player_id, upper(trim(report_status)) AS claim FROM injury_consensus_current WHERE trim(report_status) <> '')
SELECT claim, CASE WHEN b.player_id IS NULL THEN 'NOT_EVALUABLE' WHEN (claim = 'OUT') = (touches = 0) THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS verdict, count(*) AS n
FROM c LEFT JOIN (SELECT season, week, player_id, sum(carries + targets) AS touches FROM box GROUP BY ALL) b USING (season, week, player_id) GROUP BY 1, 2""",
)
def r176(spark, d):
    claim = F.upper(F.trim("report_status"))
    c = Tables(spark, d).injury_consensus_current.filter("trim(report_status) <> ''").select("season", "week", F.col("gsis_id").alias("player_id"), claim.alias("claim")).distinct()
    b = box(spark, d).groupBy("season", "week", "player_id").agg(F.sum(F.col("carries") + F.col("targets")).alias("touches"))
    verdict = F.when(F.col("touches").isNull(), "NOT_EVALUABLE").when((F.col("claim") == "OUT") == (F.col("touches") == 0), "SUPPORTED").otherwise("NOT_SUPPORTED")
    return c.join(b, ["season", "week", "player_id"], "left").groupBy("claim", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@q("r182_child_replacement", "SELECT o_orderkey, l_linenumber, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS batch FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' OR l_returnflag = 'R'")
def r182(spark, d):
    # all children of a parent in the new batch are replaced by the batch's: one join, which tells the two apart
    t = Tables(spark, d)
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_returnflag").join(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey")
    renewed = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    return lines.filter(~renewed | (F.col("l_returnflag") == "R")).select("o_orderkey", "l_linenumber", F.when(renewed, "new").otherwise("old").alias("batch"))


@q(
    "r186_state_chain",
    """SELECT user_id, count(*) AS n, list_reduce(list_prepend('', list(event_id || '|' || event_type ORDER BY ts, event_id)), lambda h, e: sha256(h || '|' || e)) AS state FROM events GROUP BY 1""",
)
def r186(spark, d):
    """A hash chain over each user's events: each state's hash is of the one before and the event."""
    return hash_chains(Tables(spark, d).events, "user_id", ["ts", "event_id"], F.concat_ws("|", F.col("event_id").cast("string"), "event_type"))


@q(
    "r198_defence_chain",
    """WITH g AS (SELECT season, week, game_id, home_team AS team, away_score AS allowed FROM dim_game UNION ALL SELECT season, week, game_id, away_team, home_score FROM dim_game),
s AS (SELECT *, CASE WHEN allowed <= 0 THEN 10.0 WHEN allowed <= 6 THEN 7.0 WHEN allowed <= 13 THEN 4.0 WHEN allowed <= 20 THEN 1.0 WHEN allowed <= 27 THEN 0.0 WHEN allowed <= 34 THEN -1.0 WHEN allowed > 34 THEN -4.0 END AS points FROM g)
SELECT game_id, team, points, round(avg(points) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 5) AS form_5, CASE WHEN count(points) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) >= 2 THEN round(stddev_samp(points) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 5) END AS spread_5,
  sum(CASE WHEN points > 0 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS positive_5 FROM s WINDOW w AS (PARTITION BY team ORDER BY season, week, game_id)""",
)
def r198(spark, d):
    from tallyforge.plans.joins import ALLOWED

    c = F.col
    g = J.two_sided(Tables(spark, d).dim_game, ["season", "week", "game_id"], {"home": (c("home_team"), c("away_score")), "away": (c("away_team"), c("home_score"))}, ["team", "allowed"])
    s = g.withColumn("points", S.tiers("allowed", ALLOWED, -4))
    p = W.Prior(["team"], ["season", "week", "game_id"])
    return s.select("game_id", "team", "points", F.round(p.mean("points", 5), 5).alias("form_5"), F.round(p.std("points", 5, 1), 5).alias("spread_5"), p.count_if(c("points") > 0, 5).alias("positive_5"))


@q(
    "r206_live_rows_in_history",
    f"""WITH {BOX}, h AS (SELECT team, season, week, sum(fantasy_points) AS p FROM box GROUP BY ALL), s AS (SELECT team, max(season) AS season, 99 AS week, NULL AS p FROM h GROUP BY 1), u AS (SELECT * FROM h UNION ALL SELECT * FROM s)
SELECT team, form FROM (SELECT team, week, round(avg(p) OVER (PARTITION BY team ORDER BY season, week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS form FROM u) WHERE week = 99""",
)
def r206(spark, d):
    """Rows of games to come are appended to the history, so one window serves both."""
    h = box(spark, d).groupBy("team", "season", "week").agg(F.sum("fantasy_points").alias("p"))
    shell = h.groupBy("team").agg(F.max("season").alias("season"), F.lit(99).cast("long").alias("week"), F.lit(None).cast("double").alias("p"))
    p = W.Prior(["team"], ["season", "week"])
    return h.unionByName(shell).select("team", "week", F.round(p.mean("p", 3), 4).alias("form")).filter("week = 99").select("team", "form")


@q(
    "r213_role_verification",
    f"""WITH {BOX}, l AS (SELECT gsis_id AS player_id, arg_max(upper(trim(position)), (updated_at::TIMESTAMPTZ, upper(trim(position)))) AS listed FROM player_identity WHERE gsis_id IS NOT NULL AND trim(position) <> '' GROUP BY 1), u AS (SELECT player_id, max(position) AS used, sum(carries + targets) AS touches FROM box GROUP BY 1)
SELECT CASE WHEN u.player_id IS NULL THEN 'NO_USAGE' WHEN l.player_id IS NULL THEN 'NOT_LISTED' WHEN used IS NULL THEN 'UNKNOWN' WHEN upper(trim(used)) = listed THEN 'CONFIRMED' ELSE 'CONFLICT' END AS result, count(*) AS n FROM l FULL JOIN u USING (player_id) GROUP BY 1""",
)
def r213(spark, d):
    from tallyforge.functions.times import iso_micros

    t = Tables(spark, d)
    position = F.upper(F.trim("position"))
    l = t.player_identity.filter("gsis_id is not null and trim(position) <> ''").groupBy(F.col("gsis_id").alias("player_id")).agg(F.max(F.struct(iso_micros(F.col("updated_at")).alias("at"), position.alias("p")))["p"].alias("listed"))
    u = box(spark, d).groupBy("player_id").agg(F.max("position").alias("used"), F.sum(F.col("carries") + F.col("targets")).alias("touches"))
    result = F.when(F.col("touches").isNull(), "NO_USAGE").when(F.col("listed").isNull(), "NOT_LISTED").when(F.col("used").isNull(), "UNKNOWN").when(F.upper(F.trim("used")) == F.col("listed"), "CONFIRMED").otherwise("CONFLICT")
    return l.join(u, "player_id", "full_outer").groupBy(result.alias("result")).agg(F.count("*").alias("n"))
