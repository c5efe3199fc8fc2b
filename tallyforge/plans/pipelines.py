"""Compositions of operators over the project's tables."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.times import iso_micros
from tallyforge.operators import aggregates as A
from tallyforge.operators import joins as J
from tallyforge.operators import kernels as K
from tallyforge.operators import windows as W
from tallyforge.operators.selection import Rules, best_selections, constrained_selections
from tallyforge.plans.registry import CORE, Tables
from tallyforge.session import materialise

q = CORE.query
STATS = ["passing_yards", "carries", "rushing_yards", "targets", "receptions", "receiving_yards", "fantasy_points"]
KEY = ["season", "week", "season_type", "player_id", "team"]
ORDER = ["season", "week", "season_type", "team"]


def box_scores(stats: DataFrame) -> DataFrame:
    """One row per KEY, the one updated last; NULL and NaN figures are 0, rows without player_id are left out."""
    clean = [F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias(c) for c in STATS]
    best = F.max(F.struct(iso_micros(F.col("updated_at")).alias("at"), "position", "opponent_team", *clean)).alias("b")
    return stats.filter("trim(player_id) != ''").groupBy(*KEY).agg(best).select(*KEY, "b.position", "b.opponent_team", *[f"b.{c}" for c in STATS])


BOX = f"""box AS (SELECT {", ".join(KEY)}, position, opponent_team, {", ".join(f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 0 ELSE {c} END AS {c}" for c in STATS)} FROM player_game_stats
  WHERE trim(player_id) <> '' QUALIFY row_number() OVER (PARTITION BY {", ".join(KEY)} ORDER BY updated_at::TIMESTAMPTZ DESC) = 1)"""
PW = "(PARTITION BY player_id ORDER BY season, week, season_type, team"


def box(spark, d) -> DataFrame:
    return box_scores(Tables(spark, d).player_game_stats)


@q("r188_box_score_etl", f"WITH {BOX} SELECT season, season_type, count(*) AS n, count(DISTINCT player_id) AS players, sum(passing_yards) AS yards FROM box GROUP BY 1, 2")
def r188(spark, d):
    return box(spark, d).groupBy("season", "season_type").agg(F.count("*").alias("n"), F.count_distinct("player_id").alias("players"), F.sum("passing_yards").alias("yards"))


@q(
    "r189_identity_master",
    """WITH l AS (SELECT gsis_id, pfr_id, espn_id, full_name, row_number() OVER (PARTITION BY gsis_id ORDER BY updated_at::TIMESTAMPTZ DESC, identity_key) AS k FROM player_identity WHERE gsis_id IS NOT NULL),
c AS (SELECT pfr_id FROM player_identity WHERE pfr_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT gsis_id) > 1)
SELECT gsis_id, CASE WHEN pfr_id IN (SELECT pfr_id FROM c) THEN NULL ELSE pfr_id END AS pfr_id, upper(trim(full_name)) AS name FROM l WHERE k = 1""",
)
def r189(spark, d):
    from tallyforge.operators.audit import conflicts

    i = Tables(spark, d).player_identity
    last = W.keep_first(i.filter("gsis_id is not null").withColumn("at", iso_micros(F.col("updated_at"))), ["gsis_id"], [F.desc("at"), F.col("identity_key").asc()])
    bad = conflicts(i, "pfr_id", "gsis_id").select("pfr_id", F.lit(True).alias("bad"))
    return last.join(bad, "pfr_id", "left").select("gsis_id", F.when(F.col("bad").isNull(), F.col("pfr_id")).alias("pfr_id"), F.upper(F.trim("full_name")).alias("name"))


@q(
    "r190_usage_table",
    f"""WITH {BOX}, t AS (SELECT season, week, season_type, team, sum(targets) AS team_targets, sum(carries) AS team_carries FROM box GROUP BY ALL)
SELECT player_id, season, week, season_type, team, carries + targets AS opportunities, round(CASE WHEN team_targets = 0 THEN 0 ELSE targets / team_targets END, 6) AS target_share,
  round(CASE WHEN team_carries = 0 THEN 0 ELSE carries / team_carries END, 6) AS carry_share, round(avg(carries + targets) OVER {PW} ROWS 2 PRECEDING), 5) AS opportunities_avg_3 FROM box JOIN t USING (season, week, season_type, team)""",
)
def r190(spark, d):
    from tallyforge.functions.scalars import safe_divide

    b = box(spark, d)
    team = b.groupBy("season", "week", "season_type", "team").agg(F.sum("targets").alias("team_targets"), F.sum("carries").alias("team_carries"))
    rows = b.join(team, ["season", "week", "season_type", "team"]).withColumn("opportunities", F.col("carries") + F.col("targets"))
    w = Window.partitionBy("player_id").orderBy(*ORDER).rowsBetween(-2, 0)
    return rows.select(*KEY, "opportunities", F.round(safe_divide("targets", "team_targets"), 6).alias("target_share"), F.round(safe_divide("carries", "team_carries"), 6).alias("carry_share"), F.round(F.avg("opportunities").over(w), 5).alias("opportunities_avg_3"))


_PRIOR = "ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _features_sql() -> str:
    out = []
    for c in STATS:
        out += [f"lag({c}) OVER {PW}) AS {c}_last"]
        for n in (3, 5):
            out += [f"round(avg({c}) OVER {PW} {_PRIOR.format(n=n)}, 5) AS {c}_avg_{n}"]
        out += [f"max({c}) OVER {PW} {_PRIOR.format(n=5)} AS {c}_max_5"]
    return ", ".join(out)


def pregame(b: DataFrame) -> DataFrame:
    """KEY, history_games and, for each statistic, last value, means of 3 and 5 and the maximum of 5 prior games."""
    p = W.Prior(["player_id"], ORDER)
    cols = [p.rows().cast("long").alias("history_games")]
    for c in STATS:
        cols += [p.last(c).alias(f"{c}_last"), *[F.round(p.mean(c, n), 5).alias(f"{c}_avg_{n}") for n in (3, 5)], p.max(c, 5).alias(f"{c}_max_5")]
    return b.select(*KEY, "position", "opponent_team", *cols)


@q("r191_pregame_features", f"WITH {BOX} SELECT {', '.join(KEY)}, row_number() OVER {PW}) - 1 AS history_games, {_features_sql()} FROM box")
def r191(spark, d):
    return pregame(box(spark, d)).drop("position", "opponent_team")


def defence_by_position(b: DataFrame) -> DataFrame:
    """Mean points that a team allowed to a position in its 3 games before each week."""
    per = b.groupBy("season", "week", "season_type", F.col("opponent_team").alias("defence"), "position").agg(F.sum("fantasy_points").alias("allowed"))
    p = W.Prior(["defence", "position"], ["season", "week", "season_type"])
    return per.select("season", "week", "season_type", "defence", "position", F.round(p.mean("allowed", 3), 4).alias("allowed_avg_3"), p.rows().cast("long").alias("games"))


_DVP = f"""per AS (SELECT season, week, season_type, opponent_team AS defence, position, sum(fantasy_points) AS allowed FROM box GROUP BY ALL),
dvp AS (SELECT season, week, season_type, defence, position, round(avg(allowed) OVER w3, 4) AS allowed_avg_3, row_number() OVER (PARTITION BY defence, position ORDER BY season, week, season_type) - 1 AS games
  FROM per WINDOW w3 AS (PARTITION BY defence, position ORDER BY season, week, season_type ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"""


@q("r192_defence_by_position", f"WITH {BOX}, {_DVP} SELECT * FROM dvp")
def r192(spark, d):
    return defence_by_position(box(spark, d))


@q(
    "r192_team_environment",
    """WITH g AS (SELECT season, week, game_id, home_team AS team, home_score AS scored, away_score AS allowed FROM dim_game UNION ALL SELECT season, week, game_id, away_team, away_score, home_score FROM dim_game)
SELECT game_id, team, round(avg(scored) OVER w, 4) AS scored_avg_3, round(avg(allowed) OVER w, 4) AS allowed_avg_3 FROM g WINDOW w AS (PARTITION BY team ORDER BY season, week, game_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
)
def r192b(spark, d):
    c = F.col
    g = J.two_sided(Tables(spark, d).dim_game, ["season", "week", "game_id"], {"home": (c("home_team"), c("home_score"), c("away_score")), "away": (c("away_team"), c("away_score"), c("home_score"))}, ["team", "scored", "allowed"])
    p = W.Prior(["team"], ["season", "week", "game_id"])
    return g.select("game_id", "team", F.round(p.mean("scored", 3), 4).alias("scored_avg_3"), F.round(p.mean("allowed", 3), 4).alias("allowed_avg_3"))


@q(
    "r193_feature_matrix",
    f"""WITH {BOX}, {_DVP} SELECT b.player_id, b.season, b.week, b.season_type, b.team, b.fantasy_points AS target, round(avg(b.fantasy_points) OVER (PARTITION BY b.player_id ORDER BY b.season, b.week, b.season_type, b.team ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS form_3,
  dvp.allowed_avg_3, dvp.games FROM box b LEFT JOIN dvp ON dvp.season = b.season AND dvp.week = b.week AND dvp.season_type = b.season_type AND dvp.defence = b.opponent_team AND dvp.position IS NOT DISTINCT FROM b.position AND b.position IS NOT NULL""",
)
def r193(spark, d):
    b = box(spark, d)
    p = W.Prior(["player_id"], ORDER)
    rows = b.select(*KEY, "position", F.col("opponent_team").alias("defence"), F.col("fantasy_points").alias("target"), F.round(p.mean("fantasy_points", 3), 4).alias("form_3"))
    return J.contract_join(rows, defence_by_position(b), ["season", "week", "season_type", "defence", "position"]).drop("defence", "position")


@q("r194_feature_research")
def r194(spark, d):
    """Look-back features by position, in the order of |r| with the points of the game: at most 12, none at 0.85 with one before.

    place counts all features, so gaps are those left out. Positions and features are few: their pairs go to the driver.
    """
    b = box(spark, d)
    feats = [f"{c}_avg_{n}" for c in STATS for n in (3, 5)]
    rows = materialise(spark, pregame(b).join(b.select(*KEY, "fantasy_points"), KEY).select("position", "fantasy_points", *feats), "features")
    long = rows.select("position", "fantasy_points", *feats).unpivot(["position", "fantasy_points"], feats, "feature", "x")
    out = long.groupBy("position", "feature").agg(F.round(A.guarded_corr("x", "fantasy_points"), 4).alias("r"), F.count("x").alias("n"))
    ranked = out.withColumn("place", F.row_number().over(Window.partitionBy("position").orderBy(F.abs("r").desc(), "feature")))
    places, pairs = defaultdict(list), defaultdict(dict)
    for x in ranked.collect():
        places[x.position].append(x)
    for x in A.correlation_pairs_by(rows, ["position"], feats, 20).collect():
        pairs[x.position][x.a, x.b] = x.r
    kept = {p: set(K.greedy_uncorrelated(pairs[p], [x.feature for x in sorted(xs, key=lambda x: x.place)], 0.85, 12)) for p, xs in places.items()}
    return spark.createDataFrame([x for p, xs in places.items() for x in xs if x.feature in kept[p]], ranked.schema)


@q("r195_projection_benchmark")
def r195(spark, d):
    """Ridge on look-back features, fitted on the seasons before the last, tuned on the one before, tested on the last."""
    b = box(spark, d)
    rows = pregame(b).join(b.select(*KEY, "fantasy_points"), KEY).filter("history_games > 0")
    last = rows.agg(F.max("season")).first()[0]
    feats = [f"{c}_avg_3" for c in STATS]
    train, valid = rows.filter(F.col("season") < last - 1), rows.filter(F.col("season") == last - 1)
    _, penalty = K.tune_ridge(train, valid, feats, "fantasy_points", [0.01, 0.1, 1.0, 10.0, 100.0])[0]
    model = K.fit_ridge(rows.filter(F.col("season") < last), feats, "fantasy_points", penalty)
    test = rows.filter(F.col("season") == last).withColumn("predicted", K.ridge_score(model))
    return test.groupBy("position").agg(F.count("*").alias("n"), *A.error_metrics("fantasy_points", "predicted"))


@q(
    "r196_weekly_ranks",
    f"WITH {BOX} SELECT {', '.join(KEY)}, round(row_number() OVER (PARTITION BY season, week, position ORDER BY fantasy_points, player_id, season_type, team) / count(*) OVER (PARTITION BY season, week, position), 6) AS pct FROM box",
)
def r196(spark, d):
    order = [F.col(c).asc() for c in ("fantasy_points", "player_id", "season_type", "team")]
    return box(spark, d).select(*KEY, F.round(W.rank_first_pct(["season", "week", "position"], order), 6).alias("pct"))


@q(
    "r197_current_features",
    f"""WITH {BOX}, k AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC, week DESC, season_type DESC, team) AS k FROM box)
SELECT player_id, max(CASE WHEN k = 1 THEN fantasy_points END) AS last, round(avg(fantasy_points), 4) AS mean, round(sum(fantasy_points), 4) AS total, count(*) AS n FROM k WHERE k <= 5 GROUP BY 1""",
)
def r197(spark, d):
    x = W.tail_features(box(spark, d), ["player_id"], [F.desc("season"), F.desc("week"), F.desc("season_type"), F.col("team").asc()], "fantasy_points", 5)
    return x.select("player_id", "last", F.round("mean", 4).alias("mean"), F.round("total", 4).alias("total"), "n")


@q(
    "r200_unified_rows",
    """SELECT season, week, team AS entity, 'TEAM' AS kind, CAST(sum(p) AS DOUBLE) AS points FROM (SELECT season, week, home_team AS team, home_score AS p FROM dim_game UNION ALL SELECT season, week, away_team, away_score FROM dim_game) GROUP BY ALL
UNION ALL SELECT season, week, player_id, 'PLAYER', round(sum(fantasy_points), 3) FROM (WITH """
    + BOX
    + """ SELECT * FROM box) GROUP BY season, week, player_id""",
)
def r200(spark, d):
    c = F.col
    g = J.two_sided(Tables(spark, d).dim_game, ["season", "week"], {"home": (c("home_team"), c("home_score")), "away": (c("away_team"), c("away_score"))}, ["team", "p"])
    teams = g.groupBy("season", "week", F.col("team").alias("entity")).agg(F.lit("TEAM").alias("kind"), F.sum("p").cast("double").alias("points"))
    players = box(spark, d).groupBy("season", "week", F.col("player_id").alias("entity")).agg(F.lit("PLAYER").alias("kind"), F.round(F.sum("fantasy_points"), 3).alias("points"))
    return teams.unionByName(players)


@q(
    "r201_team_reconciliation",
    f"""WITH {BOX}, x AS (SELECT {", ".join(KEY)}, sum(carries) OVER (PARTITION BY season, week, season_type, team) AS total, greatest(coalesce(avg(carries) OVER {PW} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0), 0) AS w,
  greatest(coalesce(max(carries) OVER {PW} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0), 0) AS c, row_number() OVER () AS id FROM box),
k AS (SELECT b.season, b.week, b.season_type, b.team, b.c / b.w AS ratio, (b.total - sum(CASE WHEN a.w > 0 AND a.c / a.w < b.c / b.w THEN a.c ELSE 0 END)) / sum(CASE WHEN a.w > 0 AND a.c / a.w >= b.c / b.w THEN a.w ELSE 0 END) AS level
  FROM x b JOIN x a ON a.season = b.season AND a.week = b.week AND a.season_type = b.season_type AND a.team = b.team WHERE b.w > 0 GROUP BY b.season, b.week, b.season_type, b.team, b.id, b.c, b.w, b.total),
v AS (SELECT season, week, season_type, team, max(CASE WHEN level <= ratio THEN level END) AS level FROM k GROUP BY ALL)
SELECT {", ".join(f"x.{c}" for c in KEY)}, round(CASE WHEN w <= 0 THEN 0 WHEN level IS NULL THEN c ELSE least(c, greatest(level, 0) * w) END, 8) AS carries
FROM x LEFT JOIN v ON v.season = x.season AND v.week = x.week AND v.season_type = x.season_type AND v.team = x.team""",
)
def r201(spark, d):
    """A team's rushing attempts of a week handed out again by the players' form, none above his best of five games."""
    b = box(spark, d)
    p = W.Prior(["player_id"], ORDER)
    rows = b.select(*KEY, F.sum("carries").over(Window.partitionBy("season", "week", "season_type", "team")).alias("total"), p.mean("carries", 3).alias("w"), p.max("carries", 5).alias("cap"))
    return K.water_filled(rows, ["season", "week", "season_type", "team"], "total", "w", "cap", "player_id").select(*KEY, F.round("share", 8).alias("carries"))


#: Statuses that keep a player out, and those that are watched.
BLOCK, WATCH = ["OUT", "DOUBTFUL", "INACTIVE"], ["QUESTIONABLE"]


@q(
    "r203_consensus_gate",
    """WITH l AS (SELECT season, week, gsis_id, upper(trim(report_status)) AS a, upper(trim(secondary_availability_status)) AS b, row_number() OVER (PARTITION BY season, week, gsis_id ORDER BY updated_at::TIMESTAMPTZ DESC, team, report_status, secondary_availability_status) AS k FROM injury_consensus_current)
SELECT season, week, gsis_id, CASE WHEN a IN ('OUT', 'DOUBTFUL', 'INACTIVE') OR b IN ('OUT', 'DOUBTFUL', 'INACTIVE') THEN 'BLOCK' WHEN a = 'QUESTIONABLE' OR b = 'QUESTIONABLE' THEN 'WATCH' ELSE 'OPEN' END AS gate,
  CASE WHEN nullif(a, '') IS NULL AND nullif(b, '') IS NULL THEN 'NO_REPORT' WHEN nullif(a, '') IS NULL THEN 'SECONDARY' WHEN nullif(b, '') IS NULL THEN 'STRUCTURED' WHEN a = b THEN 'AGREED' ELSE 'CONFLICT' END AS evidence FROM l WHERE k = 1""",
)
def r203(spark, d):
    i = Tables(spark, d).injury_consensus_current.withColumn("at", iso_micros(F.col("updated_at")))
    last = W.keep_first(i, ["season", "week", "gsis_id"], [F.desc("at"), F.col("team").asc_nulls_last(), F.col("report_status").asc_nulls_last(), F.col("secondary_availability_status").asc_nulls_last()])
    known = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    a, b = known("report_status"), known("secondary_availability_status")
    is_in = lambda xs: F.coalesce(a.isin(xs), F.lit(False)) | F.coalesce(b.isin(xs), F.lit(False))
    gate = F.when(is_in(BLOCK), "BLOCK").when(is_in(WATCH), "WATCH").otherwise("OPEN")
    evidence = F.when(a.isNull() & b.isNull(), "NO_REPORT").when(a.isNull(), "SECONDARY").when(b.isNull(), "STRUCTURED").when(a == b, "AGREED").otherwise("CONFLICT")
    return last.select("season", "week", "gsis_id", gate.alias("gate"), evidence.alias("evidence"))


@q(
    "r205_team_impact",
    f"""WITH {BOX}, f AS (SELECT player_id, season * 100 + week AS at_week, sum(fantasy_points) AS p FROM box GROUP BY ALL), r AS (SELECT DISTINCT season, week, season * 100 + week AS at_week, gsis_id AS player_id FROM injury_consensus_current WHERE upper(trim(report_status)) = 'OUT')
SELECT r.season, r.week, count(*) AS n_out, round(sum(coalesce(x.p, 0)), 3) AS lost FROM r ASOF LEFT JOIN f x ON x.player_id = r.player_id AND r.at_week > x.at_week GROUP BY ALL""",
)
def r205(spark, d):
    at = (F.col("season") * 100 + F.col("week")).alias("at_week")
    form = box(spark, d).groupBy("player_id", at).agg(F.sum("fantasy_points").alias("p")).withColumnRenamed("at_week", "then")
    out = Tables(spark, d).injury_consensus_current.filter(F.upper(F.trim("report_status")) == "OUT").select("season", "week", at, F.col("gsis_id").alias("player_id")).distinct()
    seen = J.asof_join(out, form, ["player_id"], "at_week", "then", ["p"])
    return seen.groupBy("season", "week").agg(F.count("*").alias("n_out"), F.round(F.sum(F.coalesce("p", F.lit(0.0))), 3).alias("lost"))


@q(
    "r207_regime_priors",
    f"""WITH {BOX}, g AS (SELECT team, season, week, season_type, sum(carries) AS runs, sum(targets) AS passes FROM box GROUP BY ALL), p AS (SELECT *, sum(runs) OVER w AS r, sum(passes) OVER w AS t FROM g WINDOW w AS (PARTITION BY team, season ORDER BY week, season_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT team, season, week, season_type, round(CASE WHEN r + t > 0 THEN t / (r + t) END, 6) AS pass_rate_prior FROM p""",
)
def r207(spark, d):
    g = box(spark, d).groupBy("team", "season", "week", "season_type").agg(F.sum("carries").alias("runs"), F.sum("targets").alias("passes"))
    g = g.withColumn("plays", F.col("runs") + F.col("passes"))
    p = W.Prior(["team", "season"], ["week", "season_type"])
    return g.select("team", "season", "week", "season_type", F.round(p.ratio("passes", "plays"), 6).alias("pass_rate_prior"))


@q(
    "r208_formula_learning",
    f"""WITH {BOX}, g AS (SELECT team, season, week, sum(receiving_yards) AS y FROM box GROUP BY ALL), p AS (SELECT *, avg(y) OVER (PARTITION BY team ORDER BY season, week ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prior FROM g)
SELECT team, season, week, round(prior - avg(prior) OVER (PARTITION BY season, week), 3) AS edge FROM p""",
)
def r208(spark, d):
    g = box(spark, d).groupBy("team", "season", "week").agg(F.sum("receiving_yards").alias("y"))
    rows = g.withColumn("prior", W.Prior(["team"], ["season", "week"]).mean("y", 3))
    return rows.select("team", "season", "week", F.round(F.col("prior") - F.avg("prior").over(Window.partitionBy("season", "week")), 3).alias("edge"))


@q(
    "r210_slate_attach",
    r"""WITH l AS (SELECT DISTINCT id, upper(trim(nickname)) AS name, regexp_replace(salary, '[$,\s]', '', 'g') AS s, upper(trim(game)) AS game FROM fanduel_players_list WHERE position <> 'D'),
n AS (SELECT upper(trim(full_name)) AS name, min(gsis_id) AS gsis_id FROM player_identity WHERE gsis_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT gsis_id) = 1)
SELECT l.id, l.name, try_cast(s AS DOUBLE) AS salary, split_part(game, '@', 1) AS away, split_part(game, '@', 2) AS home, gsis_id, CASE WHEN gsis_id IS NULL THEN 'UNMATCHED' ELSE 'BY_NAME' END AS match_method FROM l LEFT JOIN n USING (name)""",
)
def r210(spark, d):
    from tallyforge.functions.scalars import money

    t = Tables(spark, d)
    l = t.fanduel_players_list.filter("position <> 'D'").select("id", F.upper(F.trim("nickname")).alias("name"), F.regexp_replace("salary", r"[$,\s]", "").alias("s"), F.upper(F.trim("game")).alias("game")).distinct()
    names = t.player_identity.filter("gsis_id is not null").select(F.upper(F.trim("full_name")).alias("name"), "gsis_id").distinct()
    out = J.cascade_join(l, names, [("BY_NAME", ["name"])], "gsis_id")
    return out.select("id", "name", money("s").alias("salary"), F.split_part("game", F.lit("@"), F.lit(1)).alias("away"), F.split_part("game", F.lit("@"), F.lit(2)).alias("home"), "gsis_id", "match_method")


@q(
    "r211_cold_start",
    f"""WITH {BOX}, k AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season, week, season_type, team) AS k FROM box), g AS (SELECT position, team, count(fantasy_points) AS n, sum(fantasy_points) AS s FROM k WHERE k <= 3 AND position IS NOT NULL GROUP BY 1, 2),
p AS (SELECT position, sum(s) / sum(n) AS parent FROM g GROUP BY 1) SELECT position, team, n, round((s + parent) / (n + 1), 8) AS estimate FROM g JOIN p USING (position)""",
)
def r211(spark, d):
    first = box(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("player_id").orderBy(*ORDER))).filter("k <= 3 and position is not null")
    return A.shrunk_means(first, ["position", "team"], ["position"], "fantasy_points").select("position", "team", "n", F.round("estimate", 8).alias("estimate"))


@q(
    "r212_roles_forward",
    f"""WITH {BOX}, r AS (SELECT *, CASE WHEN carries >= 12 THEN 'LEAD' WHEN targets >= 8 THEN 'FEATURED' WHEN carries + targets >= 5 THEN 'ROTATION' ELSE 'DEPTH' END AS role, lead(fantasy_points) OVER (PARTITION BY player_id, season ORDER BY week, season_type, team) AS next FROM box)
SELECT role, count(*) AS n, round(avg(next), 4) AS next_points FROM r WHERE next IS NOT NULL GROUP BY 1""",
)
def r212(spark, d):
    role = F.when(F.col("carries") >= 12, "LEAD").when(F.col("targets") >= 8, "FEATURED").when(F.col("carries") + F.col("targets") >= 5, "ROTATION").otherwise("DEPTH")
    w = Window.partitionBy("player_id", "season").orderBy("week", "season_type", "team")
    rows = box(spark, d).select(role.alias("role"), F.lead("fantasy_points").over(w).alias("next")).filter("next is not null")
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg("next"), 4).alias("next_points"))


@q(
    "r214_graded_snapshots",
    """WITH c AS (SELECT snapshot_id, epoch_us(captured_at_utc::TIMESTAMPTZ) AS at_us FROM player_projection_snapshots), p AS (SELECT DISTINCT slate_slug, snapshot_id FROM player_projection_predictions), l AS (SELECT slate_slug, arg_max(snapshot_id, (at_us, snapshot_id)) AS snapshot_id FROM p JOIN c USING (snapshot_id) GROUP BY 1),
x AS (SELECT DISTINCT l.snapshot_id, player_id, CASE WHEN isnan(projection) THEN NULL ELSE round(projection, 3) END AS projection FROM l JOIN player_projection_predictions USING (snapshot_id) WHERE is_dst = 0)
SELECT snapshot_id, count(*) AS n, count(projection) AS n_known, round(avg(projection), 3) AS mean FROM x GROUP BY 1""",
)
def r214(spark, d):
    t = Tables(spark, d)
    times = t.player_projection_snapshots.select("snapshot_id", iso_micros(F.col("captured_at_utc")).alias("at"))
    last = t.player_projection_predictions.select("slate_slug", "snapshot_id").distinct().join(times, "snapshot_id").groupBy("slate_slug").agg(F.max_by("snapshot_id", F.struct("at", "snapshot_id")).alias("snapshot_id"))
    rows = t.player_projection_predictions.filter("is_dst = 0").join(last.select("snapshot_id"), "snapshot_id", "left_semi")
    rows = rows.select("snapshot_id", "player_id", F.when(~F.isnan("projection"), F.round("projection", 3)).alias("projection")).distinct()
    return rows.groupBy("snapshot_id").agg(F.count("*").alias("n"), F.count("projection").alias("n_known"), F.round(F.avg("projection"), 3).alias("mean"))


def _pool(spark, d) -> DataFrame:
    t = Tables(spark, d)
    times = t.player_projection_snapshots.select("snapshot_id", iso_micros(F.col("captured_at_utc")).alias("at"))
    last = t.player_projection_predictions.select("slate_slug", "snapshot_id").distinct().join(times, "snapshot_id").groupBy("slate_slug").agg(F.max_by("snapshot_id", F.struct("at", "snapshot_id")).alias("snapshot_id"))
    rows = t.player_projection_predictions.join(last, ["slate_slug", "snapshot_id"], "left_semi")
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    return rows.groupBy("slate_slug", "player_id").agg(F.max(number("projection")).alias("projection"), F.max(number("salary")).alias("salary"))


@q("r162_best_nine")
def r162(spark, d):
    return best_selections(_pool(spark, d), "slate_slug", "player_id", "projection", "salary", 9, 60000, 100)


@q("r163_best_six_with_lead")
def r163(spark, d):
    # the lead scores and costs one and a half times as much: salaries are in hundreds, the lead's in fifties
    return best_selections(_pool(spark, d), "slate_slug", "player_id", "projection", "salary", 6, 60000, 50, lead=1.5)


@q("r164_best_with_locks")
def r164(spark, d):
    w = Window.partitionBy("slate_slug").orderBy("salary", "player_id")
    pool = _pool(spark, d).filter("projection is not null and salary is not null").withColumn("locked", F.row_number().over(w) <= 2)
    return best_selections(pool, "slate_slug", "player_id", "projection", "salary", 9, 60000, 100, locked="locked")


#: One quarterback, two runners, three receivers, a tight end, one more of these three and a defence.
NINE = tuple(frozenset(x.split("/")) for x in ("QB", "RB", "RB", "WR", "WR", "WR", "TE", "RB/WR/TE", "D"))
CLASSIC = Rules(NINE, 600, per_team=4, leader="QB", followers=frozenset(["WR", "TE"]), same=1, opposed=1, overlap=7, share=0.6)


def _kinds(spark, d) -> DataFrame:
    """Each player's last known position."""
    i = Tables(spark, d).player_identity.filter("gsis_id is not null and trim(position) <> ''")
    at = F.max_by(F.upper(F.trim("position")), F.struct(iso_micros(F.col("updated_at")), F.upper(F.trim("position"))))
    return i.groupBy(F.col("gsis_id").alias("player_id")).agg(at.alias("kind"))


def _kinded_pool(spark, d) -> DataFrame:
    """The last pool of each slate with kind, team and opponent; defences are of kind D."""
    p = Tables(spark, d).player_projection_predictions
    who = p.groupBy("slate_slug", "player_id").agg(F.max("team").alias("team"), F.max("opponent_team").alias("opponent_team"), F.max("is_dst").alias("is_dst"))
    rows = _pool(spark, d).join(who, ["slate_slug", "player_id"]).join(_kinds(spark, d), "player_id", "left")
    return rows.withColumn("kind", F.when(F.col("is_dst") == 1, "D").when(F.col("kind") == "FB", "RB").otherwise(F.col("kind")))


@q("r162_portfolio")
def r162b(spark, d):
    """Three selections of each slate by slots, at most four of a team, a receiver with the quarterback and one against him."""
    return constrained_selections(_kinded_pool(spark, d), "slate_slug", "player_id", "projection", "salary", "kind", "team", "opponent_team", CLASSIC, 100, n=3)


@q("r164_slots_kept")
def r164b(spark, d):
    """The best nine by slots in which the dearest quarterback and the cheapest defence are fixed already."""
    w = Window.partitionBy("slate_slug", "kind")
    pool = _kinded_pool(spark, d).filter("projection is not null and salary is not null")
    first = F.row_number().over(w.orderBy(F.desc("salary"), "player_id")) == 1
    last = F.row_number().over(w.orderBy("salary", "player_id")) == 1
    pool = pool.withColumn("locked", ((F.col("kind") == "QB") & first) | ((F.col("kind") == "D") & last))
    return constrained_selections(pool, "slate_slug", "player_id", "projection", "salary", "kind", "team", "opponent_team", Rules(NINE, 600, per_team=4), 100, locked="locked")


@q("r165_hindsight_ties")
def r165(spark, d):
    """What would have been best in each slate: one lead and five, by the points made that week; all tied selections.

    Points are whole: of equal sums there are many, and none is left out.
    """
    t = Tables(spark, d)
    week = t.player_projection_predictions.join(t.player_projection_snapshots.select("snapshot_id", "season", "week").distinct(), "snapshot_id").groupBy("slate_slug").agg(F.max("season").alias("season"), F.max("week").alias("week"))
    made = box(spark, d).groupBy("season", "week", "player_id").agg(F.sum("fantasy_points").alias("points"))
    rows = _kinded_pool(spark, d).join(week, "slate_slug").join(made, ["season", "week", "player_id"]).withColumn("points", F.round("points")).withColumn("kind", F.lit("any"))
    return constrained_selections(rows, "slate_slug", "player_id", "points", "salary", "kind", "team", "opponent_team", Rules((frozenset(["any"]),) * 6, 1200, lead=1.5), 50, ties=True)
