"""Scans, projections and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import scalars as S
from tallyforge.operators import joins as J
from tallyforge.operators.windows import keep_first
from tallyforge.plans.registry import CORE, Tables
from tallyforge.sources import parquet_or_csv, resolved_columns
from tallyforge.sources.sinks import merged, newest, only_new

q = CORE.query


@q("r001_table_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def r001(spark, d):
    return Tables(spark, d).nation.select("n_nationkey", "n_name", "n_regionkey")


@q("r002_sql_scan", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority")
def r002(spark, d):
    return spark.sql("SELECT o_orderpriority, count(*) AS n FROM {o} WHERE o_totalprice > :least GROUP BY o_orderpriority", args={"least": 100000}, o=Tables(spark, d).orders)


@q("r003_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def r003(spark, d):
    return Tables(spark, d).lineitem.filter("l_quantity >= 45 and l_returnflag = 'R'").select("l_orderkey", "l_quantity")


@q("r004_parquet_or_csv", "SELECT r_regionkey, r_name FROM region")
def r004(spark, d):
    return parquet_or_csv(spark, f"{d}/region.parquet", f"{d}/region.csv", "r_regionkey int, r_name string", ["r_regionkey", "r_name"])


@q("r011_json_walk", "SELECT capture_id, unnest(from_json(json_extract(raw_feed_fields, '$.categories'), '[\"VARCHAR\"]')) AS category FROM source_capture")
def r011(spark, d):
    fields = F.from_json("raw_feed_fields", "categories array<string>")
    return Tables(spark, d).source_capture.select("capture_id", F.explode(fields["categories"]).alias("category"))


@q("r013_resolved_columns", "SELECT s_suppkey AS supplier_id, s_name AS name, s_acctbal AS balance, 0.0 AS discount FROM supplier")
def r013(spark, d):
    return resolved_columns(Tables(spark, d).supplier, {"supplier_id": ["supplier_id", "S_SUPPKEY"], "name": ["full_name", "s_name"], "balance": ["s_acctbal"], "discount": ["s_discount"]}, {"discount": 0.0})


@q(
    "r017_upsert",
    """WITH n AS (SELECT user_id, arg_max(event_type, event_id) AS last_type, CASE WHEN bool_or(event_type = 'purchase') THEN 1 END AS bought, count(*) AS n FROM events GROUP BY user_id),
o AS (SELECT user_id, min(event_type) AS last_type, 0 AS bought, 0 AS n FROM events WHERE value < 20 GROUP BY user_id)
SELECT coalesce(n.user_id, o.user_id) AS user_id, CASE WHEN n.user_id IS NOT NULL THEN n.last_type ELSE o.last_type END AS last_type,
  coalesce(n.bought, o.bought) AS bought, CASE WHEN n.user_id IS NOT NULL THEN n.n ELSE o.n END AS n FROM n FULL JOIN o USING (user_id)""",
)
def r017(spark, d):
    e = Tables(spark, d).events
    new = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.when(F.bool_or(F.col("event_type") == "purchase"), 1).alias("bought"), F.count("*").alias("n"))
    old = e.filter("value < 20").groupBy("user_id").agg(F.min("event_type").alias("last_type"), F.lit(0).alias("bought"), F.lit(0).cast("long").alias("n"))
    return merged(old, new, ["user_id"], keep_old=["bought"])


@q("r018_insert_or_ignore", "SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def r018(spark, d):
    t = Tables(spark, d)
    return only_new(t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), F.lit(1).alias("x")), t.orders.select(F.col("o_custkey").alias("k"), F.lit(1).alias("x")), ["k"]).select("k")


@q("r022_reject_table", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def r022(spark, d):
    t = Tables(spark, d)
    return J.unmatched(t.customer.select("c_custkey", "c_name"), t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@q(
    "r027_derived_columns",
    """SELECT season, week, player_id, team, season_type, carries + targets AS opportunities, carries + receptions AS touches, rushing_yards + receiving_yards AS scrimmage_yards
FROM player_game_stats WHERE player_id IS NOT NULL AND carries IS NOT NULL AND NOT isnan(carries) AND NOT isnan(targets) AND NOT isnan(receptions) AND NOT isnan(rushing_yards) AND NOT isnan(receiving_yards)""",
)
def r027(spark, d):
    s = Tables(spark, d).player_game_stats
    clean = s.filter("player_id is not null and carries is not null and not isnan(carries) and not isnan(targets) and not isnan(receptions) and not isnan(rushing_yards) and not isnan(receiving_yards) and targets is not null and receptions is not null and rushing_yards is not null and receiving_yards is not null")
    return clean.select("season", "week", "player_id", "team", "season_type", (F.col("carries") + F.col("targets")).alias("opportunities"), (F.col("carries") + F.col("receptions")).alias("touches"), (F.col("rushing_yards") + F.col("receiving_yards")).alias("scrimmage_yards"))


CORE.sql["r027_derived_columns"] += " AND targets IS NOT NULL AND receptions IS NOT NULL AND rushing_yards IS NOT NULL AND receiving_yards IS NOT NULL"


@q(
    "r028_safe_divide",
    """SELECT season, week, player_id, team, season_type, updated_at,
  round(coalesce(CASE WHEN attempts = 0 OR isnan(attempts) OR isnan(completions) THEN NULL ELSE completions / attempts END, 0), 6) AS completion_rate FROM player_game_stats""",
)
def r028(spark, d):
    return Tables(spark, d).player_game_stats.select("season", "week", "player_id", "team", "season_type", "updated_at", F.round(S.safe_divide("completions", "attempts"), 6).alias("completion_rate"))


@q("r029_numeric_coercion", "SELECT id, coalesce(try_cast(replace(replace(salary, ',', ''), '$', '') AS DOUBLE), 0) AS salary, CASE WHEN fppg IS NULL OR isnan(fppg) THEN 0 ELSE fppg END AS fppg FROM fanduel_players_list")
def r029(spark, d):
    return Tables(spark, d).fanduel_players_list.select("id", F.coalesce(S.money("salary"), F.lit(0.0)).alias("salary"), S.numeric("fppg", 0).alias("fppg"))


@q("r030_row_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_returnflag IN ('A', 'N') AND l_linestatus NOT IN ('F')")
def r030(spark, d):
    c = F.col
    return Tables(spark, d).lineitem.filter(c("l_quantity").between(10, 12) & c("l_returnflag").isin("A", "N") & ~c("l_linestatus").isin("F")).select("l_orderkey", "l_linenumber")


#: Points per unit of each statistic.
OFFENCE = {"passing_yards": 0.04, "passing_tds": 4, "interceptions": -1, "rushing_yards": 0.1, "rushing_tds": 6, "receptions": 0.5, "receiving_yards": 0.1, "receiving_tds": 6, "passing_2pt_conversions": 2, "rushing_2pt_conversions": 2, "receiving_2pt_conversions": 2, "special_teams_tds": 6, "rushing_fumbles_lost": -2, "receiving_fumbles_lost": -2}
_terms = " + ".join(f"coalesce(CASE WHEN isnan({c}) THEN 0 ELSE {c} END, 0) * {w}" for c, w in OFFENCE.items())


@q("r031_weighted_score", f"SELECT player_id, season, week, updated_at, round({_terms}, 1) AS points FROM player_game_stats WHERE player_id IS NOT NULL")
def r031(spark, d):
    score = sum((S.numeric(c, 0) * w for c, w in OFFENCE.items()), F.lit(0.0))
    return Tables(spark, d).player_game_stats.filter("player_id is not null").select("player_id", "season", "week", "updated_at", F.round(score, 1).alias("points"))


CORE.sql["r031_weighted_score"] = CORE.sql["r031_weighted_score"].replace(", 1) AS", " + 0.0, 1) AS")

#: Points for points allowed, by upper bound.
ALLOWED = [(0, 10), (6, 7), (13, 4), (20, 1), (27, 0), (34, -1)]


@q(
    "r032_tiered_score",
    """SELECT game_id, away_score AS allowed, CASE WHEN away_score <= 0 THEN 10.0 WHEN away_score <= 6 THEN 7.0 WHEN away_score <= 13 THEN 4.0 WHEN away_score <= 20 THEN 1.0
  WHEN away_score <= 27 THEN 0.0 WHEN away_score <= 34 THEN -1.0 WHEN away_score > 34 THEN -4.0 END AS points FROM dim_game""",
)
def r032(spark, d):
    return Tables(spark, d).dim_game.select("game_id", F.col("away_score").alias("allowed"), S.tiers("away_score", ALLOWED, -4).alias("points"))


@q("r034_flags", "SELECT event_id, CAST(coalesce(value > 50 OR event_type = 'purchase', false) AS INT) AS flag FROM events")
def r034(spark, d):
    return Tables(spark, d).events.select("event_id", F.coalesce((F.col("value") > 50) | (F.col("event_type") == "purchase"), F.lit(False)).cast("int").alias("flag"))


@q(
    "r035_rule_cascade",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 'LARGE_DONE' WHEN o_orderstatus = 'F' THEN 'DONE' WHEN o_orderpriority LIKE '1-%' THEN 'URGENT' ELSE 'OPEN' END AS label,
  CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 THEN 1 WHEN o_orderstatus = 'F' THEN 2 WHEN o_orderpriority LIKE '1-%' THEN 3 ELSE 4 END AS rule FROM orders""",
)
def r035(spark, d):
    s = F.col("o_orderstatus") == "F"
    label = lambda a, b: F.struct(F.lit(a).alias("label"), F.lit(b).alias("rule"))
    hit = F.when(s & (F.col("o_totalprice") > 200000), label("LARGE_DONE", 1)).when(s, label("DONE", 2)).when(F.col("o_orderpriority").like("1-%"), label("URGENT", 3)).otherwise(label("OPEN", 4))
    return Tables(spark, d).orders.withColumn("h", hit).select("o_orderkey", "h.label", "h.rule")


@q("r036_code_mapping", "SELECT capture_id, CASE origin_id WHEN 'GRIDWIRE' THEN 'GW' WHEN 'HUDDLE' THEN 'HD' ELSE origin_id END AS origin FROM source_capture")
def r036(spark, d):
    return Tables(spark, d).source_capture.select("capture_id", S.mapped("origin_id", {"GRIDWIRE": "GW", "HUDDLE": "HD"}).alias("origin"))


@q("r037_banding", "SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value < 5 THEN '0-4' WHEN value < 10 THEN '5-9' WHEN value < 15 THEN '10-14' WHEN value < 20 THEN '15-19' ELSE '20+' END AS band FROM events")
def r037(spark, d):
    return Tables(spark, d).events.select("event_id", S.band("value", [(5, "0-4"), (10, "5-9"), (15, "10-14"), (20, "15-19")], "20+").alias("band"))


@q("r039_row_coalesce", "SELECT record_id, coalesce(game_id, event_key, 'none') AS anchor FROM source_events")
def r039(spark, d):
    return Tables(spark, d).source_events.select("record_id", F.coalesce("game_id", "event_key", F.lit("none")).alias("anchor"))


@q("r040_clamp", "SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN NULL ELSE greatest(least(c_acctbal, 5000.0), 0.0) END AS balance FROM customer")
def r040(spark, d):
    return Tables(spark, d).customer.select("c_custkey", S.clamp("c_acctbal", 0, 5000).alias("balance"))


@q("r041_null_text", "SELECT doc_id, CASE WHEN lower(trim(coalesce(lang, ''))) IN ('nan', 'none', 'null', '<na>', 'n/a', '') THEN '' ELSE trim(lang) END AS lang FROM documents")
def r041(spark, d):
    return Tables(spark, d).documents.select("doc_id", S.null_text("lang").alias("lang"))


@q("r042_many_to_one_join", "SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def r042(spark, d):
    t = Tables(spark, d)
    right = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return J.contract_join(t.orders.select("o_orderkey", "o_custkey"), right, ["o_custkey"], validate="m:1")


@q("r043_one_to_one_join", "SELECT o_orderkey, o_totalprice, n_lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def r043(spark, d):
    t = Tables(spark, d)
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    return J.contract_join(t.orders.select("o_orderkey", "o_totalprice"), lines, ["o_orderkey"], validate="1:1")


@q("r044_composite_key_join", "SELECT p.season, p.week, p.player_id, p.team, p.season_type, p.updated_at, i.n_reports FROM player_game_stats p LEFT JOIN (SELECT season, week, gsis_id, count(*) AS n_reports FROM injury_consensus_current GROUP BY ALL) i ON p.season = i.season AND p.week = i.week AND p.player_id = i.gsis_id")
def r044(spark, d):
    t = Tables(spark, d)
    i = t.injury_consensus_current.groupBy("season", "week", F.col("gsis_id").alias("player_id")).agg(F.count("*").alias("n_reports"))
    return t.player_game_stats.select("season", "week", "player_id", "team", "season_type", "updated_at").join(i, ["season", "week", "player_id"], "left")


@q("r045_inner_join", "SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def r045(spark, d):
    t = Tables(spark, d)
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@q(
    "r046_outer_indicator",
    """SELECT coalesce(a.k, b.k) AS k, n_orders, balance, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS _merge
FROM (SELECT o_custkey AS k, count(*) AS n_orders FROM orders WHERE o_totalprice > 150000 GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, c_acctbal AS balance FROM customer WHERE c_acctbal > 0) b ON a.k = b.k""",
)
def r046(spark, d):
    t = Tables(spark, d)
    a = t.orders.filter("o_totalprice > 150000").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n_orders"))
    return J.outer_indicator(a, t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance")), ["k"])


@q("r047_orphan_rows", "SELECT record_id, game_id FROM source_events e WHERE NOT EXISTS (SELECT 1 FROM dim_game g WHERE g.game_id = e.game_id)")
def r047(spark, d):
    t = Tables(spark, d)
    return t.source_events.join(t.dim_game.select("game_id"), "game_id", "left_anti").select("record_id", "game_id")


@q(
    "r048_anti_join_either_key",
    "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p_size > 10)",
)
def r048(spark, d):
    t = Tables(spark, d)
    right = t.supplier.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(None).cast("long").alias("l_partkey"))
    right = right.unionByName(t.part.filter("p_size > 10").select(F.lit(None).cast("long").alias("l_suppkey"), F.col("p_partkey").alias("l_partkey")))
    return J.anti_either(t.lineitem, right, "l_suppkey", "l_partkey").select("l_orderkey", "l_linenumber")


@q("r049_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def r049(spark, d):
    t = Tables(spark, d)
    return t.customer.join(t.orders.filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@q("r051_self_join", "SELECT a.season, a.week, a.game_id, b.game_id AS rematch FROM dim_game a JOIN dim_game b ON a.season = b.season AND a.home_team = b.away_team AND a.away_team = b.home_team AND a.week < b.week")
def r051(spark, d):
    g = Tables(spark, d).dim_game
    b = g.select("season", F.col("away_team").alias("home_team"), F.col("home_team").alias("away_team"), F.col("week").alias("later"), F.col("game_id").alias("rematch"))
    return g.join(b, ["season", "home_team", "away_team"]).filter("week < later").select("season", "week", "game_id", "rematch")


_ASOF = """SELECT e.event_id, e.user_id, e.value, arg_max(p.value, (p.ts, p.value)) AS last_value, max(p.ts) IS NOT NULL AS found
FROM (SELECT * FROM events WHERE event_type = 'click') e LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON p.user_id = e.user_id AND p.ts < e.ts GROUP BY ALL"""
_ASOF_SQL = """SELECT e.event_id, e.user_id, e.ts, p.v AS last_value FROM (SELECT * FROM events WHERE event_type = 'click') e
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts > p.ts"""


@q("r052_asof_join", "SELECT event_id, user_id, last_value FROM (" + _ASOF_SQL + ")")
def r052(spark, d):
    e = Tables(spark, d).events
    right = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("last_value"))
    return J.asof_join(e.filter("event_type = 'click'").select("event_id", "user_id", "ts"), right, ["user_id"], "ts", "at", ["last_value"]).select("event_id", "user_id", "last_value")


@q("r052_asof_join_hot_key", "SELECT event_id, last_value FROM (SELECT e.event_id, p.v AS last_value FROM (SELECT * FROM events WHERE event_type = 'click') e ASOF LEFT JOIN (SELECT ts, max(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY ts) p ON e.ts > p.ts)")
def r052b(spark, d):
    e = Tables(spark, d).events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("k", F.lit(1))
    right = e.filter("event_type = 'purchase'").select("k", F.col("at").alias("t"), F.col("value").alias("last_value"))
    return J.asof_join_bucketed(e.filter("event_type = 'click'").select("event_id", "k", "at"), right, ["k"], "at", "t", ["last_value"], 86400).select("event_id", "last_value")


@q(
    "r053_latest_snapshot_before",
    """WITH s AS (SELECT DISTINCT snapshot_id, slate_slug FROM player_projection_predictions), c AS (SELECT s.slate_slug, s.snapshot_id, epoch_us(captured_at_utc::TIMESTAMPTZ) AS at_us FROM s JOIN player_projection_snapshots USING (snapshot_id)),
l AS (SELECT slate_slug, max(at_us) AS cutoff FROM c GROUP BY 1), b AS (SELECT l.slate_slug, l.cutoff, max(at_us) AS at_us FROM l JOIN c ON c.slate_slug = l.slate_slug AND at_us < cutoff GROUP BY ALL)
SELECT b.slate_slug, b.cutoff, b.at_us, min(c.snapshot_id) AS snapshot_id, count(*) AS n_tied FROM b JOIN c ON c.slate_slug = b.slate_slug AND c.at_us = b.at_us GROUP BY ALL""",
)
def r053(spark, d):
    from tallyforge.functions.times import iso_micros

    t = Tables(spark, d)
    c = t.player_projection_predictions.select("snapshot_id", "slate_slug").distinct().join(t.player_projection_snapshots.select("snapshot_id", iso_micros(F.col("captured_at_utc")).alias("at_us")), "snapshot_id")
    cut = c.groupBy("slate_slug").agg(F.max("at_us").alias("cutoff"))
    return J.latest_before(cut, c, ["slate_slug"], "cutoff", "at_us", "snapshot_id").withColumn("n_tied", F.col("n_tied").cast("long"))


@q("r055_latest_per_group", "SELECT o_custkey, o_orderkey FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders x WHERE x.o_custkey = o.o_custkey)")
def r055(spark, d):
    return J.latest_per_group(Tables(spark, d).orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey")


@q("r056_cte_latest", "WITH latest AS (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id) SELECT e.user_id, e.event_id, e.event_type FROM events e JOIN latest USING (user_id, event_id)")
def r056(spark, d):
    return spark.sql("WITH latest AS (SELECT user_id, max(event_id) AS event_id FROM {e} GROUP BY user_id) SELECT e.user_id, e.event_id, e.event_type FROM {e} e JOIN latest USING (user_id, event_id)", e=Tables(spark, d).events)


@q(
    "r057_unique_exact_join",
    """WITH u AS (SELECT upper(trim(last_name)) AS name, min(id) AS id FROM fanduel_players_list WHERE last_name IS NOT NULL GROUP BY 1 HAVING count(*) = 1)
SELECT p.gsis_id, p.name, u.id FROM (SELECT DISTINCT gsis_id, upper(regexp_extract(trim(full_name), '\\S+$')) AS name FROM player_identity WHERE gsis_id IS NOT NULL) p LEFT JOIN u USING (name)""",
)
def r057(spark, d):
    t = Tables(spark, d)
    u = J.unique_exact(t.fanduel_players_list.select(F.upper(F.trim("last_name")).alias("name"), "id"), ["name"])
    p = t.player_identity.filter("gsis_id is not null").select("gsis_id", F.upper(F.regexp_extract(F.trim("full_name"), r"\S+$", 0)).alias("name")).distinct()
    return p.join(u, "name", "left").select("gsis_id", "name", "id")


CORE.sql["r057_unique_exact_join"] = CORE.sql["r057_unique_exact_join"].replace("\\\\S", "\\S")


_KEY = "nullif(upper(trim({c})), '')"


@q(
    "r058_cascade_join",
    f"""WITH l AS (SELECT DISTINCT id, {_KEY.format(c="nickname")} AS name, {_KEY.format(c="team")} AS team, {_KEY.format(c="position")} AS position FROM fanduel_players_list WHERE position <> 'D'),
r AS (SELECT DISTINCT {_KEY.format(c="full_name")} AS name, {_KEY.format(c="latest_team")} AS team, {_KEY.format(c="position")} AS position, gsis_id FROM player_identity WHERE gsis_id IS NOT NULL),
a AS (SELECT name, team, position, min(gsis_id) AS g FROM r GROUP BY ALL HAVING count(DISTINCT gsis_id) = 1), b AS (SELECT name, position, min(gsis_id) AS g FROM r GROUP BY ALL HAVING count(DISTINCT gsis_id) = 1),
c AS (SELECT name, min(gsis_id) AS g FROM r GROUP BY ALL HAVING count(DISTINCT gsis_id) = 1)
SELECT l.id, l.name, l.team, l.position, coalesce(a.g, b.g, c.g) AS gsis_id, CASE WHEN a.g IS NOT NULL THEN 'NAME_TEAM_POSITION' WHEN b.g IS NOT NULL THEN 'NAME_POSITION' WHEN c.g IS NOT NULL THEN 'NAME' ELSE 'UNMATCHED' END AS match_method
FROM l LEFT JOIN a ON a.name = l.name AND a.team = l.team AND a.position = l.position LEFT JOIN b ON b.name = l.name AND b.position = l.position LEFT JOIN c ON c.name = l.name""",
)
def r058(spark, d):
    """Players of the lists by name, team and position, then by less; each pass through keys of one player only."""
    t, key = Tables(spark, d), lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    left = t.fanduel_players_list.filter("position <> 'D'").select("id", key("nickname").alias("name"), key("team").alias("team"), key("position").alias("position")).distinct()
    right = t.player_identity.filter("gsis_id is not null").select(key("full_name").alias("name"), key("latest_team").alias("team"), key("position").alias("position"), "gsis_id").distinct()
    passes = [("NAME_TEAM_POSITION", ["name", "team", "position"]), ("NAME_POSITION", ["name", "position"]), ("NAME", ["name"])]
    return J.cascade_join(left, right, passes, "gsis_id").select("id", "name", "team", "position", "gsis_id", "match_method")


@q("r059_parameter_grid", "SELECT a * 0.1 AS w, b AS penalty FROM (SELECT unnest(generate_series(0, 10)) AS a), (SELECT unnest([0.0, 0.01, 0.1, 1.0, 10.0, 100.0]) AS b)")
def r059(spark, d):
    # two constants of a fixed size, so the product is a sequence of sequences and no join
    grid = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(10))).alias("a"))
    return grid.select((F.col("a") * F.lit(0.1)).alias("w"), F.explode(F.array(*[F.lit(x) for x in (0.0, 0.01, 0.1, 1.0, 10.0, 100.0)])).alias("penalty"))


@q("r060_two_sides", "SELECT game_id, 'home' AS side, home_team AS team, away_team AS opponent, home_score AS scored, away_score AS allowed FROM dim_game UNION ALL SELECT game_id, 'away', away_team, home_team, away_score, home_score FROM dim_game")
def r060(spark, d):
    c = F.col
    sides = {"home": (c("home_team"), c("away_team"), c("home_score"), c("away_score")), "away": (c("away_team"), c("home_team"), c("away_score"), c("home_score"))}
    return J.two_sided(Tables(spark, d).dim_game, ["game_id"], sides, ["team", "opponent", "scored", "allowed"])


@q("r061_checked_broadcast", "SELECT l_returnflag, n_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def r061(spark, d):
    t = Tables(spark, d)
    s = t.supplier.join(J.broadcast_if_small(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return t.lineitem.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_returnflag", "n_name").agg(F.count("*").alias("n"))


@q("r113_keep_last", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def r113(spark, d):
    return keep_first(Tables(spark, d).events, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


@q("r017_newest_row", "SELECT record_id, game_id, source_phase FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY retrieved_at_utc DESC) AS k FROM source_events) WHERE k = 1")
def r017b(spark, d):
    e = Tables(spark, d).source_events.select("record_id", "retrieved_at_utc", "game_id", "source_phase")
    return newest(e, ["record_id"], "retrieved_at_utc").select("record_id", "game_id", "source_phase")
