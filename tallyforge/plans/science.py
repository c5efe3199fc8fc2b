"""Scalar functions, kernels, audits, streams and functions of the user."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge import streaming
from tallyforge.functions import scalars as S
from tallyforge.functions.times import iso_micros, local_to_utc_micros
from tallyforge.operators import audit
from tallyforge.operators import kernels as K
from tallyforge.operators import timestamps
from tallyforge.operators import windows as W
from tallyforge.operators.windows import global_order_sums
from tallyforge.plans.registry import CORE, Tables
from tallyforge.session import scratch_path

q = CORE.query


@q("r123_accent_fold", "SELECT id, regexp_replace(lower(strip_accents(nickname)), '[^a-z0-9]', '', 'g') AS k FROM fanduel_players_list")
def r123(spark, d):
    return Tables(spark, d).fanduel_players_list.select("id", S.alnum_key("nickname").alias("k"))


@q("r124_suffix_strip", r"SELECT id, regexp_replace(trim(last_name), '(?i)[\s,]+(jr|sr|ii|iii|iv|v)\.?$', '') AS last_name FROM fanduel_players_list")
def r124(spark, d):
    return Tables(spark, d).fanduel_players_list.select("id", S.strip_suffix("last_name").alias("last_name"))


@q(
    "r125_initial_key",
    r"""SELECT player_id, season, week, updated_at, CASE WHEN len(w) > 1 THEN w[1][1] || '.' || regexp_replace(w[len(w)], '[^a-z0-9]', '', 'g') END AS k
FROM (SELECT *, regexp_split_to_array(lower(regexp_replace(trim(player_display_name), '(?i)[\s,]+(jr|sr|ii|iii|iv|v)\.?$', '')), '\s+') AS w FROM player_game_stats)""",
)
def r125(spark, d):
    return Tables(spark, d).player_game_stats.select("player_id", "season", "week", "updated_at", S.initial_key("player_display_name").alias("k"))


@q("r126_token_extraction", r"SELECT capture_id, array_to_string(regexp_extract_all(headline, '[A-Z]\.[A-Z]\.? [A-Z][a-z]+'), ';') AS tokens FROM source_capture")
def r126(spark, d):
    return Tables(spark, d).source_capture.select("capture_id", F.array_join(F.regexp_extract_all("headline", F.lit(r"[A-Z]\.[A-Z]\.? [A-Z][a-z]+"), 0), ";").alias("tokens"))


@q("r127_name_from_text", r"SELECT capture_id, regexp_extract(regexp_replace(headline, '^Report: ', ''), '^(\w+ \w+) expected to', 1) AS name FROM source_capture")
def r127(spark, d):
    return Tables(spark, d).source_capture.select("capture_id", F.regexp_extract(F.regexp_replace("headline", "^Report: ", ""), r"^(\w+ \w+) expected to", 1).alias("name"))


@q("r128_game_parse", "SELECT id, CASE WHEN regexp_matches(upper(trim(game)), '^[A-Z]{2,3}@[A-Z]{2,3}$') THEN split_part(upper(trim(game)), '@', 1) END AS away, CASE WHEN regexp_matches(upper(trim(game)), '^[A-Z]{2,3}@[A-Z]{2,3}$') THEN split_part(upper(trim(game)), '@', 2) END AS home FROM fanduel_players_list")
def r128(spark, d):
    return Tables(spark, d).fanduel_players_list.withColumn("g", S.away_home("game")).select("id", "g.away", "g.home")


@q("r129_money_parse", r"SELECT id, try_cast(regexp_replace(salary, '[$,\s]', '', 'g') AS DOUBLE) AS salary FROM fanduel_players_list")
def r129(spark, d):
    return Tables(spark, d).fanduel_players_list.select("id", S.money("salary").alias("salary"))


@q("r130_slug", "SELECT record_id, trim(regexp_replace(lower(headline), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM source_events")
def r130(spark, d):
    return Tables(spark, d).source_events.select("record_id", S.slug("headline").alias("slug"))


@q("r131_text_predicates", "SELECT capture_id, headline LIKE '%expected%' AS a, starts_with(headline, 'Report') AS b, contains(upper(headline), 'TRADE') AS c FROM source_capture")
def r131(spark, d):
    h = F.col("headline")
    return Tables(spark, d).source_capture.select("capture_id", h.like("%expected%").alias("a"), h.startswith("Report").alias("b"), F.upper(h).contains("TRADE").alias("c"))


@q("r132_content_hash", "SELECT record_id, sha256(CAST(to_json({'record_id': record_id, 'event_key': event_key, 'game_id': game_id, 'source': source, 'headline': headline}) AS VARCHAR)) AS digest FROM source_events")
def r132(spark, d):
    return Tables(spark, d).source_events.select("record_id", S.fingerprint("record_id", "event_key", "game_id", "source", "headline").alias("digest"))


@q(
    "r133_signal_classifier",
    "SELECT capture_id, CASE WHEN regexp_matches(headline, '(?i)\\b(trade|sign|waive|release)') THEN 'TRANSACTION' WHEN regexp_matches(headline, '(?i)practice') THEN 'PRACTICE' WHEN regexp_matches(headline, '(?i)expected to (sit|start|split)') THEN 'AVAILABILITY' ELSE 'OTHER' END AS signal FROM source_capture".replace("\\\\", "\\"),
)
def r133(spark, d):
    h = F.col("headline")
    kind = F.when(h.rlike(r"(?i)\b(trade|sign|waive|release)"), "TRANSACTION").when(h.rlike("(?i)practice"), "PRACTICE").when(h.rlike("(?i)expected to (sit|start|split)"), "AVAILABILITY").otherwise("OTHER")
    return Tables(spark, d).source_capture.select("capture_id", kind.alias("signal"))


@q("r134_kickoff_to_utc", "SELECT game_id, CASE WHEN regexp_matches(kickoff_local_time, '^[0-9]{2}:[0-5][0-9]$') AND kickoff_local_time < '24' THEN epoch_us(try_cast(game_date || ' ' || kickoff_local_time || ':00' AS TIMESTAMP) AT TIME ZONE 'America/New_York') END AS at_us FROM dim_game")
def r134(spark, d):
    return Tables(spark, d).dim_game.select("game_id", local_to_utc_micros(F.col("game_date"), F.col("kickoff_local_time")).alias("at_us"))


@q("r135_season_from_date", "SELECT o_orderkey, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) >= 3 THEN 0 ELSE 1 END AS BIGINT) AS season FROM orders")
def r135(spark, d):
    return Tables(spark, d).orders.select("o_orderkey", S.season_of("o_orderdate").cast("long").alias("season"))


@q("r136_week_context", "SELECT season, week, min(game_date) AS first_date, max(game_date) AS last_date, count(*) AS games, CASE WHEN sum(completed) = count(*) THEN 'DONE' WHEN sum(completed) > 0 THEN 'ACTIVE' ELSE 'AHEAD' END AS state FROM dim_game GROUP BY 1, 2")
def r136(spark, d):
    done = F.sum("completed")
    return Tables(spark, d).dim_game.groupBy("season", "week").agg(F.min("game_date").alias("first_date"), F.max("game_date").alias("last_date"), F.count("*").alias("games"), F.when(done == F.count("*"), "DONE").when(done > 0, "ACTIVE").otherwise("AHEAD").alias("state"))


@q("r137_checkpoint_slots", "SELECT game_id, unnest([48, 24, 6, 1]) AS hours_before, epoch(game_date::TIMESTAMP) - unnest([48, 24, 6, 1]) * 3600 AS at_s FROM dim_game")
def r137(spark, d):
    day = F.unix_timestamp(F.to_date("game_date").cast("timestamp"))
    g = Tables(spark, d).dim_game.select("game_id", day.alias("day"), F.explode(F.array(*map(F.lit, [48, 24, 6, 1]))).alias("hours_before"))
    return g.select("game_id", "hours_before", (F.col("day") - F.col("hours_before") * 3600).cast("double").alias("at_s"))


@q("r138_sigmoid", "SELECT event_id, round(1 / (1 + exp(-greatest(least(value, 35), -35))), 8) AS p FROM events WHERE value IS NOT NULL")
def r138(spark, d):
    return Tables(spark, d).events.filter("value is not null").select("event_id", F.round(S.sigmoid("value"), 8).alias("p"))


@q("r139_rounding", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS DOUBLE) AS even, CAST(floor(l_quantity / 2 + 0.5) AS BIGINT) AS half_up FROM lineitem")
def r139(spark, d):
    x = F.col("l_quantity") / 2
    return Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", F.rint(x).alias("even"), S.round_half_up(x).alias("half_up"))


@q("r140_standardise", "SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_pop(p_size) FROM part), 6) AS z FROM part")
def r140(spark, d):
    p = Tables(spark, d).part
    return p.select("p_partkey", F.round(K.standardised(["p_size"], K.moments(p, ["p_size"]))[0], 6).alias("z"))


@q("r141_median_impute", "SELECT event_id, coalesce(value, (SELECT median(value) FROM events)) AS value FROM events")
def r141(spark, d):
    e = Tables(spark, d).events
    return e.select("event_id", F.coalesce("value", F.lit(K.medians(e, ["value"])[0])).alias("value"))


@q("r142_joined_sets", "SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def r142(spark, d):
    return Tables(spark, d).events.groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ";").alias("kinds"))


@q("r143_json_extract", "SELECT capture_id, json_extract_string(raw_feed_fields, '$.title') AS title, json_array_length(raw_feed_fields, '$.categories') AS n_categories, json_valid(raw_feed_fields) AS ok FROM source_capture")
def r143(spark, d):
    raw = "raw_feed_fields"
    return Tables(spark, d).source_capture.select("capture_id", F.get_json_object(raw, "$.title").alias("title"), F.json_array_length(F.get_json_object(raw, "$.categories")).alias("n_categories"), F.try_parse_json(raw).isNotNull().alias("ok"))


_RIDGE = ["l_quantity", "l_discount", "l_tax"]


@q(
    "r144_ridge_one_feature",
    """WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS sd, avg(l_extendedprice) AS ybar FROM lineitem),
b AS (SELECT sum((l_quantity - m) / sd * (l_extendedprice - ybar)) / (sum(((l_quantity - m) / sd) * ((l_quantity - m) / sd)) + 10) AS beta FROM lineitem, s)
SELECT l_orderkey, l_linenumber, round(ybar + beta * (l_quantity - m) / sd, 2) AS fitted FROM lineitem, s, b""",
)
def r144(spark, d):
    l = Tables(spark, d).lineitem
    return l.select("l_orderkey", "l_linenumber", F.round(K.ridge_score(K.fit_ridge(l, ["l_quantity"], "l_extendedprice", 10.0)), 2).alias("fitted"))


@q("r144_tuned_ridge")
def r144b(spark, d):
    l = Tables(spark, d).lineitem
    tuned = K.tune_ridge(l.filter("l_linestatus = 'F'"), l.filter("l_linestatus = 'O'"), _RIDGE, "l_extendedprice", [0.0, 0.01, 0.1, 1.0, 10.0, 100.0])
    return spark.createDataFrame([(i, p, float(m)) for i, (m, p) in enumerate(tuned)], "place int, penalty double, mae double")


@q("r146_logistic")
def r146(spark, d):
    l = Tables(spark, d).lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    m = K.fit_logistic(l, ["l_quantity", "l_discount"], "y", 0.1)
    return spark.createDataFrame([("intercept", float(m["intercept"])), *m["beta"].items()], "feature string, weight double")


@q("r149_policy_table", "SELECT o_orderkey, round(o_totalprice * CASE o_orderpriority WHEN '1-URGENT' THEN 0.9 WHEN '2-HIGH' THEN 0.8 ELSE 0.5 END, 3) AS blended FROM orders")
def r149(spark, d):
    policy = spark.createDataFrame([("1-URGENT", 0.9), ("2-HIGH", 0.8)], "o_orderpriority string, w double")
    o = Tables(spark, d).orders.join(F.broadcast(policy), "o_orderpriority", "left")
    return o.select("o_orderkey", F.round(F.col("o_totalprice") * F.coalesce("w", F.lit(0.5)), 3).alias("blended"))


@q(
    "r150_feature_screen",
    """SELECT feature, CASE WHEN count(*) < 20 THEN 0 ELSE round(corr(x, l_extendedprice), 5) END AS r, count(*) AS n FROM (UNPIVOT (SELECT l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME feature VALUE x) GROUP BY 1""",
)
def r150(spark, d):
    from tallyforge.operators.aggregates import guarded_corr

    long = Tables(spark, d).lineitem.select("l_extendedprice", *_RIDGE).unpivot(["l_extendedprice"], _RIDGE, "feature", "x")
    return long.groupBy("feature").agg(F.round(guarded_corr("x", "l_extendedprice"), 5).alias("r"), F.count("*").alias("n"))


@q(
    "r152_walk_forward",
    """WITH f AS (SELECT unnest([1995, 1996, 1997]) AS y) SELECT y AS fold, round(avg(abs(o.o_totalprice - t.m)), 3) AS mae FROM f JOIN orders o ON year(o.o_orderdate) = y
JOIN (SELECT y AS fold, avg(o_totalprice) AS m FROM f JOIN orders ON year(o_orderdate) < y GROUP BY 1) t ON t.fold = y GROUP BY 1""",
)
def r152(spark, d):
    # a row's folds are an array of at most three, so there is no join on inequality
    o = Tables(spark, d).orders.select("o_totalprice", F.year("o_orderdate").alias("year"))
    folds = F.array(*map(F.lit, [1995, 1996, 1997]))
    train = o.select("o_totalprice", F.explode(F.filter(folds, lambda y: y > F.col("year"))).alias("fold")).groupBy("fold").agg(F.avg("o_totalprice").alias("m"))
    test = o.filter(F.col("year").isin(1995, 1996, 1997)).select("o_totalprice", F.col("year").alias("fold"))
    return test.join(train, "fold").groupBy("fold").agg(F.round(F.avg(F.abs(F.col("o_totalprice") - F.col("m"))), 3).alias("mae"))


@q("r153_leave_one_out", "SELECT c_custkey, round((sum(c_acctbal) OVER w - c_acctbal) / nullif(count(*) OVER w - 1, 0), 4) AS others FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def r153(spark, d):
    # the mean without a row follows from the group's sum: no fold is built, and no group meets in one task
    c = Tables(spark, d).customer
    sums = c.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("s"), F.count("*").alias("k"))
    return W.join_groups(c, sums, ["c_nationkey"]).select("c_custkey", F.round(F.try_divide(F.col("s") - F.col("c_acctbal"), F.nullif(F.col("k") - 1, F.lit(0))), 4).alias("others"))


@q("r154_proportional", "SELECT l_orderkey, l_linenumber, round(CASE WHEN sum(greatest(l_tax, 0)) OVER w > 0 THEN 100 * greatest(l_tax, 0) / sum(greatest(l_tax, 0)) OVER w ELSE 100.0 / count(*) OVER w END, 6) AS share FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def r154(spark, d):
    l = Tables(spark, d).lineitem.withColumn("total", F.lit(100.0))
    return l.select("l_orderkey", "l_linenumber", F.round(K.proportional("total", "l_tax", ["l_orderkey"]), 6).alias("share"))


@q(
    "r155_water_filling",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_tax + 0.01 AS w, l_quantity AS c, row_number() OVER () AS id FROM lineitem),
k AS (SELECT l_orderkey, b.c / b.w AS ratio, (60.0 - sum(CASE WHEN a.c / a.w < b.c / b.w THEN a.c ELSE 0 END)) / sum(CASE WHEN a.c / a.w < b.c / b.w THEN 0 ELSE a.w END) AS level FROM l b JOIN l a USING (l_orderkey) GROUP BY l_orderkey, b.id, b.c, b.w),
v AS (SELECT l_orderkey, max(CASE WHEN level <= ratio THEN level END) AS level FROM k GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(CASE WHEN level IS NULL THEN c ELSE least(c, greatest(level, 0) * w) END, 6) AS share FROM l JOIN v USING (l_orderkey)""",
)
def r155(spark, d):
    l = Tables(spark, d).lineitem.withColumn("total", F.lit(60.0)).withColumn("w", F.col("l_tax") + 0.01)
    return K.water_filled(l, ["l_orderkey"], "total", "w", "l_quantity", "l_linenumber").select("l_orderkey", "l_linenumber", F.round("share", 6).alias("share"))


@q("r157_fallback_tiers", "SELECT user_id, CASE WHEN n >= 3 THEN round(tail, 5) WHEN n >= 1 THEN round(own, 5) ELSE 0 END AS estimate FROM (SELECT user_id, count(value) AS n, avg(value) AS own, avg(value) FILTER (k <= 3) AS tail FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) GROUP BY 1)")
def r157(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    x = Tables(spark, d).events.withColumn("k", F.row_number().over(w)).groupBy("user_id").agg(F.count("value").alias("n"), F.avg("value").alias("own"), F.avg(F.when(F.col("k") <= 3, F.col("value"))).alias("tail"))
    return x.select("user_id", F.when(F.col("n") >= 3, F.round("tail", 5)).when(F.col("n") >= 1, F.round("own", 5)).otherwise(0.0).alias("estimate"))


@q(
    "r158_largest_remainder",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS w, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS s FROM lineitem), y AS (SELECT *, 10 * w / s AS quota, floor(10 * w / s) AS f FROM x),
z AS (SELECT *, 10 - sum(f) OVER (PARTITION BY l_orderkey) AS rest, row_number() OVER (PARTITION BY l_orderkey ORDER BY quota - f DESC, w DESC, l_linenumber DESC) AS k FROM y)
SELECT l_orderkey, l_linenumber, CAST(f + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS units FROM z""",
)
def r158(spark, d):
    l = Tables(spark, d).lineitem.withColumn("total", F.lit(10.0))
    return K.largest_remainder(l, ["l_orderkey"], "total", "l_quantity", "l_linenumber").select("l_orderkey", "l_linenumber", "units")


def kickoff_spans(games):
    """(game_id, lo, hi): the first and last microsecond at which a game may begin; equal where the kickoff is known.

    Without a zone it is one of the readings in the assumed zones, without a readable clock anywhere in game_date's
    day, whatever the zone (UTC+14 to UTC-12). Games without a usable date either have NULL.
    """
    day = F.unix_date(F.trim("game_date").try_cast("date")).cast("long") * 24 * timestamps.HOUR
    value = timestamps.kickoff_text()
    read = timestamps.with_readings(games.select("game_id", day.alias("day"), value.alias("value")), F.col("value"))
    known = F.size("_us") > 0
    lo = F.when(known, F.array_min("_us")).otherwise(F.col("day") - 14 * timestamps.HOUR)
    hi = F.when(known, F.array_max("_us")).otherwise(F.col("day") + 36 * timestamps.HOUR)
    return read.select("game_id", lo.alias("lo"), hi.alias("hi"))


@q("r160_seeded_draw")
def r160(spark, d):
    """For each game one of all games that began before it, whatever the season; the first ones have none."""
    games = Tables(spark, d).dim_game
    spans = kickoff_spans(games)
    # in the order of time, a game asks at its earliest kickoff and may be drawn from its latest on; at one time asking is first
    ends = spans.select("game_id", F.inline(F.array(F.struct(F.col("lo").alias("at"), F.lit(0).alias("is_past")), F.struct(F.col("hi").alias("at"), F.lit(1).alias("is_past"))))).filter("at is not null")
    placed = global_order_sums(ends, ["at", "is_past", "game_id"], "is_past", "i")
    asked = placed.filter("is_past = 0").select("game_id", K.seeded_index(F.col("game_id"), F.col("i")).alias("i"))
    pool = placed.filter("is_past = 1").select("i", F.col("game_id").alias("drawn")).join(games.select(F.col("game_id").alias("drawn"), "home_score"), "drawn")
    return asked.join(pool, "i").select("game_id", "drawn", "home_score")


@q("r161_state_replay", "SELECT user_id, count(*) AS n, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS purchases, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1")
def r161(spark, d):
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("purchases"), F.lit(None).cast("string").alias("last_type"))
    step = lambda s, e: F.struct((s["n"] + 1).alias("n"), (s["purchases"] + (e["event_type"] == "purchase").cast("long")).alias("purchases"), e["event_type"].alias("last_type"))
    merge = lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), (a["purchases"] + b["purchases"]).alias("purchases"), F.when(b["n"] > 0, b["last_type"]).otherwise(a["last_type"]).alias("last_type"))
    return W.replayed(Tables(spark, d).events, "user_id", ["ts", "event_id"], ["event_type"], start, step, merge).select("user_id", "state.*")


@q("r166_unique_key_audit", "SELECT o_orderkey, count(*) AS count FROM orders GROUP BY 1 HAVING count(*) > 1")
def r166(spark, d):
    from tallyforge.operators.joins import duplicate_keys

    return duplicate_keys(Tables(spark, d).orders, ["o_orderkey"])


@q(
    "r167_leakage_audit",
    "WITH f AS (SELECT value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT 'mean_3' AS feature, 0 AS leaks UNION ALL SELECT 'max_5', 0 UNION ALL SELECT 'with_own_row', count(*) FILTER (k = 1 AND value <> 0) FROM f",
)
def r167(spark, d):
    """Two look-back features, and one that has the row's own value in it and so leaks at each user's first row."""
    from tallyforge.operators.windows import Prior

    p = Prior(["user_id"], ["ts", "event_id"])
    rows = Tables(spark, d).events.select(p.rows().alias("prior"), p.mean("value", 3).alias("mean_3"), p.max("value", 5).alias("max_5"), F.avg("value").over(p.w.rowsBetween(-2, 0)).alias("with_own_row"))
    return audit.first_row_leaks(rows, "prior", ["mean_3", "max_5", "with_own_row"])


@q(
    "r168_audit_table",
    "SELECT 'rows' AS item, CAST(count(*) AS DOUBLE) AS value, 1710.0 AS expected, CASE WHEN count(*) = 1710 THEN 'PASS' ELSE 'FAIL' END AS status FROM dim_game UNION ALL SELECT 'games without score', CAST(count(*) FILTER (home_score IS NULL) AS DOUBLE), 0, CASE WHEN count(*) FILTER (home_score IS NULL) = 0 THEN 'PASS' ELSE 'FAIL' END FROM dim_game",
)
def r168(spark, d):
    return audit.expectations(Tables(spark, d).dim_game, {"rows": (F.count("*"), 1710), "games without score": (F.count_if(F.col("home_score").isNull()), 0)})


@q("r169_readiness", "SELECT g.season, CASE WHEN n IS NULL THEN 'NO_PLAYER_ROWS' WHEN completed = 0 THEN 'NOT_COMPLETED' ELSE 'READY' END AS reason_code, count(*) AS games FROM dim_game g LEFT JOIN (SELECT season, week, team, count(*) AS n FROM player_game_stats GROUP BY ALL) p ON p.season = g.season AND p.week = g.week AND p.team = g.home_team GROUP BY ALL")
def r169(spark, d):
    t = Tables(spark, d)
    p = t.player_game_stats.groupBy("season", "week", F.col("team").alias("home_team")).agg(F.count("*").alias("n"))
    code = F.when(F.col("n").isNull(), "NO_PLAYER_ROWS").when(F.col("completed") == 0, "NOT_COMPLETED").otherwise("READY")
    return t.dim_game.join(p, ["season", "week", "home_team"], "left").groupBy("season", code.alias("reason_code")).agg(F.count("*").alias("games"))


@q("r170_duplicate_sources", "SELECT snapshot_id, CASE WHEN row_number() OVER w > 1 THEN 'DUPLICATE_SOURCE' ELSE 'STAGED' END AS status, CASE WHEN row_number() OVER w > 1 THEN first_value(snapshot_id) OVER w END AS duplicate_of FROM player_projection_snapshots WINDOW w AS (PARTITION BY source_pool_sha256 ORDER BY snapshot_id)")
def r170(spark, d):
    s = Tables(spark, d).player_projection_snapshots.select("snapshot_id", "source_pool_sha256")
    return audit.duplicate_sources(s, "snapshot_id", "source_pool_sha256").select("snapshot_id", "status", "duplicate_of")


@q(
    "r171_lifecycle",
    """SELECT season, week, CASE WHEN TIMESTAMP '2023-10-08 12:00:00' > max(game_date::TIMESTAMP) + INTERVAL 4 HOUR THEN 'COMPLETED' WHEN TIMESTAMP '2023-10-08 12:00:00' >= max(game_date::TIMESTAMP) THEN 'LOCKED'
  WHEN TIMESTAMP '2023-10-08 12:00:00' >= min(game_date::TIMESTAMP) THEN 'LATE_SWAP_ACTIVE' ELSE 'OPEN' END AS state FROM dim_game GROUP BY 1, 2""",
)
def r171(spark, d):
    at = F.to_date("game_date").cast("timestamp")
    spans = Tables(spark, d).dim_game.groupBy("season", "week").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    return spans.select("season", "week", audit.lifecycle(F.col("a"), F.col("b"), F.lit("2023-10-08 12:00:00").cast("timestamp")).alias("state"))


@q("r173_corroboration", "SELECT event_key, count(*) AS n_claims, count(DISTINCT origin_id) AS n_origins, count(DISTINCT source_phase) AS n_values, CASE WHEN count(DISTINCT source_phase) > 1 THEN 'QUARANTINED' WHEN count(DISTINCT origin_id) > 1 THEN 'CORROBORATED' ELSE 'SINGLE_ORIGIN' END AS status FROM (SELECT DISTINCT event_key, source_phase, origin_id FROM source_events) GROUP BY 1")
def r173(spark, d):
    return audit.corroborated(Tables(spark, d).source_events, ["event_key"], "source_phase", "origin_id")


@q(
    "r174_current_revision",
    """WITH s AS (SELECT source_event_id AS k, epoch_us(first_seen_at_utc::TIMESTAMPTZ) AS at_us, content_hash AS h FROM source_capture WHERE source_event_id IS NOT NULL AND content_hash IS NOT NULL), l AS (SELECT k, max(at_us) AS at_us FROM s WHERE at_us <= 1704067200000000 GROUP BY 1)
SELECT k AS source_event_id, CASE WHEN min(h) = max(h) THEN min(h) END AS content_hash, CASE WHEN min(h) = max(h) THEN 'CURRENT' ELSE 'UNRESOLVED' END AS status FROM s JOIN l USING (k, at_us) GROUP BY 1""",
)
def r174(spark, d):
    s = Tables(spark, d).source_capture.filter("source_event_id is not null and content_hash is not null").select("source_event_id", "content_hash", iso_micros(F.col("first_seen_at_utc")).alias("at"))
    return audit.current_revision(s, ["source_event_id"], "at", "content_hash", F.lit(1704067200000000))


@q("r175_grading", "SELECT game_id, home_score - away_score AS margin, abs(home_score - away_score - 3) AS error, CASE WHEN home_score = away_score THEN NULL ELSE CAST(home_score > away_score AS INT) END AS correct FROM dim_game")
def r175(spark, d):
    m = F.col("home_score") - F.col("away_score")
    return Tables(spark, d).dim_game.select("game_id", m.alias("margin"), F.abs(m - 3).alias("error"), F.when(m != 0, (m > 0).cast("int")).alias("correct"))


@q("r178_cross_stage", "SELECT coalesce(a.snapshot_id, b.snapshot_id) AS snapshot_id, CASE WHEN b.snapshot_id IS NULL THEN 'left_only' WHEN a.snapshot_id IS NULL THEN 'right_only' ELSE 'both' END AS _merge FROM (SELECT DISTINCT snapshot_id FROM player_projection_snapshots) a FULL JOIN (SELECT DISTINCT snapshot_id FROM player_projection_predictions) b USING (snapshot_id)")
def r178(spark, d):
    from tallyforge.operators.joins import outer_indicator

    t = Tables(spark, d)
    return outer_indicator(t.player_projection_snapshots.select("snapshot_id").distinct(), t.player_projection_predictions.select("snapshot_id").distinct(), ["snapshot_id"])


@q("r180_upsert_stream", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def r180(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "event_type").schema
    table = streaming.KeyedTable(spark, scratch_path(spark, "keyed"), ["user_id"], "event_id", schema)
    full = spark.read.parquet(f"{d}/events.parquet").schema
    streaming.run_to_end(streaming.upsert_stream(streaming.files_stream(spark, f"{d}/events.parquet", full), table))
    return table.read().select("user_id", "event_id")


@q("r181_stream_dedupe", "SELECT event_type, count(*) AS n FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY 1")
def r181(spark, d):
    full = spark.read.parquet(f"{d}/events.parquet").schema
    out = scratch_path(spark, "dedupe")
    stream = streaming.files_stream(spark, f"{d}/events.parquet", full).withColumn("at", F.col("ts").cast("timestamp"))
    stream = streaming.deduplicated(stream, ["event_id"], "at", "400 days").select("event_id", "event_type")
    w = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True)
    streaming.run_to_end(w.start())
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@q(
    "r177_incidents",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS at_us, event_id, event_type = 'purchase' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_type = 'purchase') AS k FROM events WHERE event_type IS NOT NULL),
g AS (SELECT *, coalesce(sum(CASE WHEN NOT bad THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run, lag(bad) OVER (PARTITION BY key ORDER BY k) AS before FROM e),
x AS (SELECT *, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY key, run ORDER BY k) AS n, min(CASE WHEN bad THEN at_us END) OVER (PARTITION BY key, run) AS opened FROM g)
SELECT key, CASE WHEN NOT bad THEN 'RESOLVED' WHEN n = 1 THEN 'OPEN' ELSE 'UPDATE' END AS state, CAST(n AS INT) AS n, opened FROM x WHERE bad OR before""",
)
def r177(spark, d):
    """A purchase opens an incident of its user, further ones update it, any other event resolves it."""
    full = spark.read.parquet(f"{d}/events.parquet").schema
    stream = streaming.files_stream(spark, f"{d}/events.parquet", full)
    stream = stream.filter("event_type is not null").select(F.col("user_id").cast("string").alias("user"), (F.col("event_type") == "purchase").alias("bad"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = scratch_path(spark, "incidents")
    w = streaming.incidents(stream, "user", "bad", "at").writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/_stream").outputMode("append").trigger(availableNow=True)
    streaming.run_to_end(w.start())
    return spark.read.schema("key string, state string, n int, opened bigint").parquet(f"{out}/rows")


@q(
    "r183_late_correction",
    """WITH b AS (SELECT record_id, upper(headline) AS headline, 1 AS revision FROM source_events WHERE headline IS NOT NULL) SELECT s.record_id, coalesce(b.headline, s.headline) AS headline, coalesce(b.revision, 0) AS revision FROM source_events s LEFT JOIN b USING (record_id)""",
)
def r183(spark, d):
    """Corrections come after everything else, and once more as older duplicates: rows are replaced, duplicates are not."""
    rows = Tables(spark, d).source_events.select("record_id", "headline", F.lit(0).alias("revision"))
    late = rows.filter("headline is not null").select("record_id", F.upper("headline").alias("headline"), F.lit(1).alias("revision"))
    table = streaming.KeyedTable(spark, scratch_path(spark, "corrected"), ["record_id"], "revision", rows.schema)
    for number, batch in enumerate((rows, late, rows)):
        table.upsert(batch, number)
    return table.read()


@q(
    "r187_schedule",
    """WITH g AS (SELECT game_id, min(epoch_us(strptime(trim(game_date), '%Y-%m-%d'))) AS begins FROM dim_game GROUP BY 1), e AS (SELECT DISTINCT game_id FROM source_events WHERE game_id IS NOT NULL), t AS (SELECT quantile_disc(begins, 0.5) AS now_us FROM g)
SELECT coalesce(g.game_id, e.game_id) AS game_id, CASE WHEN g.game_id IS NULL THEN 'UNPLANNED' WHEN begins IS NULL THEN 'UNTIMED' WHEN begins - 1209600000000 <= now_us AND now_us <= begins + 1209600000000 THEN CASE WHEN e.game_id IS NULL THEN 'MISSING' ELSE 'ACTIVE' END
  WHEN now_us < begins THEN 'WAITING' ELSE 'ENDED' END AS state FROM g FULL JOIN e ON g.game_id = e.game_id, t""",
)
def r187(spark, d):
    """Events discovered against the schedule, at the middle of its dates: two weeks before and after are active."""
    t = Tables(spark, d)
    plan = t.dim_game.select("game_id", F.unix_micros(F.try_to_timestamp(F.trim("game_date"), F.lit("yyyy-MM-dd"))).alias("begins"))
    times = W.value_ranks(plan.groupBy("game_id").agg(F.min("begins").alias("begins")).select(F.lit(0).alias("_all"), "begins"), ["_all"], "begins")
    now = times.filter("before < 0.5 * n and 0.5 * n <= before + ties").first()["begins"]
    return streaming.scheduled(t.source_events, plan, "game_id", "begins", int(now), 14 * 86400, 14 * 86400)


@q("r184_tumbling_windows", "SELECT epoch(time_bucket(INTERVAL 1 DAY, ts)) AS start_s, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def r184(spark, d):
    x = streaming.tumbling(Tables(spark, d).events.withColumn("at", F.col("ts").cast("timestamp")), "at", "1 day", ["event_type"])
    return x.select(F.unix_timestamp("window.start").cast("double").alias("start_s"), "event_type", "n", F.round("total", 3).alias("total"))


@q("r184_sliding_windows", "SELECT epoch(time_bucket(INTERVAL 6 HOUR, ts)) - o * 21600 AS start_s, count(*) AS n FROM events, (SELECT unnest([0, 1, 2, 3]) AS o) GROUP BY 1")
def r184b(spark, d):
    x = streaming.sliding(Tables(spark, d).events.withColumn("at", F.col("ts").cast("timestamp")), "at", "24 hours", "6 hours", [])
    return x.select(F.unix_timestamp("window.start").cast("double").alias("start_s"), "n")


@q("r184_sessions", "SELECT user_id, epoch(min(ts)) AS start_s, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, s")
def r184c(spark, d):
    x = streaming.sessions(Tables(spark, d).events.withColumn("at", F.col("ts").cast("timestamp")), "at", "1 day", ["user_id"])
    return x.select("user_id", (F.unix_micros("session_window.start") / 1e6).alias("start_s"), "n")


@q("r185_staleness", "SELECT event_type, CAST(floor(epoch(TIMESTAMP '2030-01-01 00:00:00')) - floor(epoch(max(ts))) AS BIGINT) AS age_seconds, 'FAIL' AS status FROM events GROUP BY 1")
def r185(spark, d):
    return streaming.stale(Tables(spark, d).events, ["event_type"], "ts", F.lit("2030-01-01 00:00:00").cast("timestamp"), 180, 300)


@q("r215_row_function", "SELECT o_orderkey, o_totalprice * 2 AS y FROM orders")
def r215(spark, d):
    @F.pandas_udf("double")
    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    return Tables(spark, d).orders.select("o_orderkey", twice("o_totalprice").alias("y"))


@q("r216_grouped_function", "SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS diff FROM customer")
def r216(spark, d):
    def centred(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c_custkey": pdf["c_custkey"], "diff": pdf["c_acctbal"] - pdf["c_acctbal"].mean()})

    out = Tables(spark, d).customer.select("c_custkey", "c_nationkey", "c_acctbal").groupBy("c_nationkey").applyInPandas(centred, "c_custkey bigint, diff double")
    return out.select("c_custkey", F.round("diff", 4).alias("diff"))


@q("r218_table_function", "SELECT capture_id, unnest(regexp_split_to_array(trim(headline), ' +')) AS word FROM source_capture")
def r218(spark, d):
    return Tables(spark, d).source_capture.select("capture_id", F.explode(F.split(F.trim("headline"), " +")).alias("word"))


@q("r219_sql_function", "SELECT s_suppkey, round(s_acctbal / 100, 4) AS y FROM supplier")
def r219(spark, d):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hundredth(x DOUBLE) RETURNS DOUBLE RETURN round(x / 100, 4)")
    return spark.sql("SELECT s_suppkey, hundredth(s_acctbal) AS y FROM {s}", s=Tables(spark, d).supplier)
