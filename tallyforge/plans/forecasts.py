"""Forecasts from fitted and frozen models, their reconciliation and adjustment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import joins as J
from tallyforge.operators import kernels as K
from tallyforge.operators import windows as W
from tallyforge.plans.pipelines import BOX, KEY, ORDER, PW, box
from tallyforge.plans.registry import CORE, Tables
from tallyforge.session import materialise, scratch_path
from tallyforge.sources.sinks import publish, published

q = CORE.query


@q(
    "r145_imputed_ridge",
    """WITH r AS (SELECT CASE WHEN NOT isnan(carries) THEN carries END AS a, CASE WHEN NOT isnan(targets) THEN targets END AS b, CASE WHEN NOT isnan(fantasy_points) THEN fantasy_points END AS y FROM player_game_stats),
k AS (SELECT * FROM r WHERE y IS NOT NULL), m AS (SELECT median(a) AS ma, median(b) AS mb FROM k), x AS (SELECT coalesce(a, ma) AS a, coalesce(b, mb) AS b, y FROM k, m),
s AS (SELECT avg(a) AS aa, stddev_pop(a) AS sa, avg(b) AS ab, stddev_pop(b) AS sb, avg(y) AS ay FROM x), z AS (SELECT (a - aa) / sa AS u, (b - ab) / sb AS v, y - ay AS y FROM x, s),
n AS (SELECT sum(u * u) + 10 AS uu, sum(u * v) AS uv, sum(v * v) + 10 AS vv, sum(u * y) AS uy, sum(v * y) AS vy FROM z)
SELECT 'carries' AS feature, round((uy * vv - vy * uv) / (uu * vv - uv * uv), 6) AS weight, ma AS fill FROM n, m UNION ALL SELECT 'targets', round((vy * uu - uy * uv) / (uu * vv - uv * uv), 6), mb FROM n, m UNION ALL SELECT '(intercept)', round(ay, 6), NULL FROM s""",
)
def r145(spark, d):
    """Ridge of points on carries and targets; a third feature is the same in all rows and drops out."""
    rows = Tables(spark, d).player_game_stats.withColumn("same", F.lit(7.0))
    model = K.fit_imputed_ridge(rows, ["carries", "targets", "same"], "fantasy_points", 10.0)
    out = [(c, round(w, 6), model["fill"][c]) for c, w in model["beta"].items()] + [("(intercept)", round(model["intercept"], 6), None)]
    return spark.createDataFrame(out, "feature string, weight double, fill double")


#: A frozen model: for each statistic an intercept and the weights of a player's means of his last three and five games.
FROZEN = [
    ("rushing_yards", 0.4, {"rushing_yards_3": 0.45, "rushing_yards_5": 0.3, "carries_3": 0.9}),
    ("receiving_yards", 0.6, {"receiving_yards_3": 0.4, "receiving_yards_5": 0.35, "targets_3": 1.1}),
]
LEAST_GAMES = 3  # players with fewer games have their position's mean
_INPUTS = ["rushing_yards", "receiving_yards", "carries", "targets"]


def _frozen_sql(stat: str) -> str:
    _, base, weights = next(x for x in FROZEN if x[0] == stat)
    return " + ".join([str(base), *[f"{w} * {c}" for c, w in weights.items()]])


@q(
    "r199_current_forecast",
    f"""WITH {BOX}, k AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season DESC, week DESC, season_type DESC, team DESC) AS k FROM box),
f AS (SELECT player_id, arg_min(position, k) AS position, count(*) AS games, {", ".join(f"avg({c}) FILTER (k <= {n}) AS {c}_{n}" for c in _INPUTS for n in (3, 5))} FROM k WHERE k <= 5 GROUP BY 1),
p AS (SELECT position, avg(rushing_yards) AS rush, avg(receiving_yards) AS rec FROM box GROUP BY 1)
SELECT player_id, CASE WHEN games >= {LEAST_GAMES} THEN 'MODEL' ELSE 'POSITION' END AS source, round(CASE WHEN games >= {LEAST_GAMES} THEN {_frozen_sql("rushing_yards")} ELSE rush END, 5) AS rushing_yards,
  round(CASE WHEN games >= {LEAST_GAMES} THEN {_frozen_sql("receiving_yards")} ELSE rec END, 5) AS receiving_yards FROM f JOIN p ON f.position IS NOT DISTINCT FROM p.position""",
)
def r199(spark, d):
    """Next game's yards of every player: frozen weights on his form, or his position's mean where he has too few games."""
    path = scratch_path(spark, "frozen")
    publish(spark.createDataFrame(FROZEN, "stat string, base double, weights map<string, double>"), path)
    models = {r["stat"]: r for r in published(spark, path).collect()}  # a row per statistic
    b = box(spark, d)
    last = b.withColumn("k", F.row_number().over(Window.partitionBy("player_id").orderBy(*[F.desc(c) for c in ORDER]))).filter("k <= 5")
    means = [F.avg(F.when(F.col("k") <= n, F.col(c))).alias(f"{c}_{n}") for c in _INPUTS for n in (3, 5)]
    form = last.groupBy("player_id").agg(F.max(F.when(F.col("k") == 1, F.col("position"))).alias("position"), F.count("*").alias("games"), *means)
    stats = list(models)
    position = b.groupBy("position").agg(*[F.avg(s).alias(f"mean_{s}") for s in stats])
    rows = W.join_groups(form, position, ["position"])
    known = F.col("games") >= LEAST_GAMES
    score = lambda m: reduce(lambda a, x: a + F.lit(x[1]) * F.col(x[0]), m["weights"].items(), F.lit(m["base"]))
    return rows.select("player_id", F.when(known, "MODEL").otherwise("POSITION").alias("source"), *[F.round(F.when(known, score(models[s])).otherwise(F.col(f"mean_{s}")), 5).alias(s) for s in stats])


GRID = [0.0, 0.25, 0.5, 0.75, 1.0]


@q(
    "r202_walk_forward",
    f"""WITH {BOX}, t AS (SELECT team, season, week, season_type, sum(carries) AS total FROM box GROUP BY ALL),
tp AS (SELECT *, avg(total) OVER (PARTITION BY team ORDER BY season, week, season_type ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS expected FROM t),
f AS (SELECT {", ".join(KEY)}, carries, avg(carries) OVER {PW} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS form FROM box),
x AS (SELECT f.*, expected, sum(form) OVER (PARTITION BY f.team, f.season, f.week, f.season_type) AS forms FROM f JOIN tp ON tp.team = f.team AND tp.season = f.season AND tp.week = f.week AND tp.season_type = f.season_type),
e AS (SELECT season, g.w, sum(abs(g.w * CASE WHEN forms > 0 THEN form * expected / forms ELSE 0 END + (1 - g.w) * form - carries)) AS e, count(*) AS n FROM x, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS w) g WHERE form IS NOT NULL AND expected IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, sum(e) OVER o / sum(n) OVER o AS before FROM e WINDOW o AS (PARTITION BY w ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT season, w AS weight, round(e / n, 5) AS mae, n FROM c WHERE before IS NOT NULL QUALIFY row_number() OVER (PARTITION BY season ORDER BY round(before, 9), w) = 1""",
)
def r202(spark, d):
    """Carries handed down from the team's expected total and blended with form; each season has the weight that was best before it."""
    b = box(spark, d)
    team = ["team", "season", "week", "season_type"]
    totals = b.groupBy(*team).agg(F.sum("carries").alias("total"))
    expected = totals.select(*team, W.Prior(["team"], ["season", "week", "season_type"]).mean("total", 3).alias("expected"))
    rows = b.select(*KEY, "carries", W.Prior(["player_id"], ORDER).mean("carries", 3).alias("form")).join(expected, team)
    rows = rows.withColumn("forms", F.sum("form").over(Window.partitionBy(*team))).filter("form is not null and expected is not null")
    shared = F.when(F.col("forms") > 0, F.col("form") * F.col("expected") / F.col("forms")).otherwise(0.0)
    each = rows.select("season", "form", "carries", shared.alias("shared")).groupBy("season").agg(F.count("*").alias("n"), *[F.sum(F.abs(w * F.col("shared") + (1 - w) * F.col("form") - F.col("carries"))).alias(f"e{i}") for i, w in enumerate(GRID)])
    long = each.select("season", "n", F.inline(F.array(*[F.struct(F.lit(w).alias("weight"), F.col(f"e{i}").alias("e")) for i, w in enumerate(GRID)])))  # a row per season and weight
    o = Window.partitionBy("weight").orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("before", F.sum("e").over(o) / F.sum("n").over(o)).filter("before is not null")
    best = F.row_number().over(Window.partitionBy("season").orderBy(F.round("before", 9), "weight"))
    return long.withColumn("k", best).filter("k = 1").select("season", "weight", F.round(F.col("e") / F.col("n"), 5).alias("mae"), "n")


LOSS = 5.0  # carries and targets a game from which a lost role counts


@q(
    "r204_reforecast",
    f"""WITH {BOX}, o AS (SELECT {", ".join(KEY)}, position, season * 100 + week AS at_week, carries + targets AS used FROM box),
f AS (SELECT *, avg(used) OVER (PARTITION BY player_id ORDER BY season, week, season_type, team ROWS 2 PRECEDING) AS form, avg(used) OVER (PARTITION BY player_id ORDER BY season, week, season_type, team ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prior FROM o),
h AS (SELECT player_id, at_week, max(struct_pack(season_type, team, position, form)) AS s FROM f GROUP BY 1, 2),
i AS (SELECT DISTINCT season, week, season * 100 + week AS at_week, gsis_id AS player_id FROM injury_consensus_current WHERE upper(trim(report_status)) = 'OUT' AND gsis_id IS NOT NULL),
g AS (SELECT i.season, i.week, i.player_id, h.s.team AS team, h.s.position AS position, h.s.form AS lost FROM i ASOF LEFT JOIN h ON h.player_id = i.player_id AND i.at_week > h.at_week),
c AS (SELECT f.season, f.week, f.team, f.position, arg_max(f.player_id, (f.prior, f.player_id)) AS replacement, max(f.prior) AS base FROM f ANTI JOIN i ON i.season = f.season AND i.week = f.week AND i.player_id = f.player_id WHERE f.prior IS NOT NULL AND f.position IS NOT NULL GROUP BY ALL)
SELECT g.season, g.week, g.player_id, replacement, CASE WHEN lost IS NULL THEN 'NO_HISTORY' WHEN g.position = 'QB' THEN 'PASSER' WHEN lost < 5 THEN 'SMALL_ROLE' WHEN replacement IS NULL THEN 'NO_REPLACEMENT' ELSE 'ROLE_LOST' END AS reason,
  round(CASE WHEN lost IS NULL OR g.position = 'QB' OR lost < 5 THEN base ELSE base + lost / 2 END, 5) AS projection
FROM g LEFT JOIN c ON c.season = g.season AND c.week = g.week AND c.team = g.team AND c.position = g.position""",
)
def r204(spark, d):
    """For each player who is out, who takes the role and what that one is then expected to do, with the reason."""
    b = box(spark, d).withColumn("used", F.col("carries") + F.col("targets")).withColumn("then", F.col("season") * 100 + F.col("week"))
    w = Window.partitionBy("player_id").orderBy(*ORDER)
    f = b.select(*KEY, "position", "then", F.avg("used").over(w.rowsBetween(-2, 0)).alias("form"), F.avg("used").over(w.rowsBetween(-3, -1)).alias("prior"))
    f = materialise(spark, f, "forms")
    last = f.groupBy("player_id", "then").agg(F.max(F.struct("season_type", "team", "position", "form")).alias("s"))
    out = Tables(spark, d).injury_consensus_current.filter((F.upper(F.trim("report_status")) == "OUT") & F.col("gsis_id").isNotNull())
    out = out.select("season", "week", (F.col("season") * 100 + F.col("week")).alias("at_week"), F.col("gsis_id").alias("player_id")).distinct()
    gone = J.asof_join(out, last, ["player_id"], "at_week", "then", ["s"]).select("season", "week", "player_id", "s.team", "s.position", F.col("s.form").alias("lost"))
    there = f.join(out.select("season", "week", "player_id"), ["season", "week", "player_id"], "left_anti").filter("prior is not null and position is not null")
    best = there.groupBy("season", "week", "team", "position").agg(F.max(F.struct("prior", "player_id")).alias("b")).select("season", "week", "team", "position", F.col("b.player_id").alias("replacement"), F.col("b.prior").alias("base"))
    rows = gone.join(best, ["season", "week", "team", "position"], "left")
    small = F.col("lost").isNull() | F.coalesce(F.col("position") == "QB", F.lit(False)) | (F.col("lost") < LOSS)
    reason = F.when(F.col("lost").isNull(), "NO_HISTORY").when(F.col("position") == "QB", "PASSER").when(F.col("lost") < LOSS, "SMALL_ROLE").when(F.col("replacement").isNull(), "NO_REPLACEMENT").otherwise("ROLE_LOST")
    return rows.select("season", "week", "player_id", "replacement", reason.alias("reason"), F.round(F.when(small, F.col("base")).otherwise(F.col("base") + F.col("lost") / 2), 5).alias("projection"))


@q(
    "r209_weather_texts",
    r"""WITH m AS (SELECT game_id, regexp_matches(text, '(?i)\bwind') AS wind, regexp_matches(text, '(?i)\b(rain|snow)') AS wet, try_cast(regexp_extract(text, 'beyond (\d{1,3}) yards', 1) AS INT) AS yards FROM documents WHERE text IS NOT NULL AND game_id IS NOT NULL),
g AS (SELECT game_id, count(*) AS texts, count(*) FILTER (wind) AS wind, count(*) FILTER (wet) AS wet, max(yards) FILTER (wind) AS yards FROM m GROUP BY 1)
SELECT game_id, season, week, texts, g.wind, wet, yards, CASE WHEN g.wind = 0 AND wet = 0 THEN 'CALM' WHEN g.wind + wet < 0.1 * texts THEN 'LIGHT' WHEN yards < 20 THEN 'STRONG' ELSE 'MODERATE' END AS band FROM g JOIN dim_game USING (game_id)""",
)
def r209(spark, d):
    """Weather from texts: mentions of wind, rain and snow per game, the length that kickers could not reach, and a band."""
    t = Tables(spark, d)
    has = lambda p: F.col("text").rlike(p)
    m = t.documents.filter("text is not null and game_id is not null").select("game_id", has(r"(?i)\bwind").alias("wind"), has(r"(?i)\b(rain|snow)").alias("wet"), F.regexp_extract("text", r"beyond (\d{1,3}) yards", 1).try_cast("int").alias("yards"))
    g = m.groupBy("game_id").agg(F.count("*").alias("texts"), F.count_if("wind").alias("wind"), F.count_if("wet").alias("wet"), F.max(F.when(F.col("wind"), F.col("yards"))).alias("yards"))
    band = F.when((F.col("wind") == 0) & (F.col("wet") == 0), "CALM").when(F.col("wind") + F.col("wet") < 0.1 * F.col("texts"), "LIGHT").when(F.col("yards") < 20, "STRONG").otherwise("MODERATE")
    return g.join(t.dim_game.select("game_id", "season", "week"), "game_id").select("game_id", "season", "week", "texts", "wind", "wet", "yards", band.alias("band"))
