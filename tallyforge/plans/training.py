"""Queries of the general training-data problems (p1 to p5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions.times import micros_text
from tallyforge.operators import delivery, history, snapshot_diff, timestamps, trailing
from tallyforge.plans.registry import CORE, Tables

P1 = r"""
WITH a AS (
  SELECT capture_id, lower(regexp_replace(source_event_id, '^\s+|\s+$', '', 'g')) AS id, nullif(lower(trim(content_hash)), '') AS h,
    concat_ws(chr(1), coalesce(json_extract_string(raw_feed_fields, '$.title'), chr(2)), coalesce(json_extract_string(raw_feed_fields, '$.description'), chr(2)),
      coalesce(json_extract_string(raw_feed_fields, '$.link'), chr(2)), coalesce(json_extract_string(raw_feed_fields, '$.guid'), chr(2)),
      coalesce(json_extract_string(raw_feed_fields, '$.pubDate'), chr(2)), coalesce(json_extract(raw_feed_fields, '$.categories')::VARCHAR, chr(2))) AS body,
    epoch_us(first_seen_at_utc::TIMESTAMPTZ) AS seen
  FROM source_capture WHERE source_event_id IS NOT NULL),
b AS (SELECT *, coalesce(h, min(h) OVER (PARTITION BY id, body)) AS h2 FROM a WHERE id <> ''),
c AS (SELECT capture_id, row_number() OVER (PARTITION BY id, coalesce('d' || h2, 'b' || body) ORDER BY seen NULLS LAST, capture_id) AS n FROM b)
SELECT capture_id FROM c WHERE n > 1"""


@CORE.query("p1_found", P1)
def p1_found(spark, d):
    return delivery.dropped_deliveries(Tables(spark, d).source_capture)


P2 = r"""
WITH a AS (
  SELECT 'player_identity' AS entity_table, identity_key AS k, epoch_us(updated_at::TIMESTAMPTZ) AS u, nullif(upper(trim(latest_team)), '') AS x, nullif(upper(trim(position)), '') AS y
  FROM player_identity WHERE identity_key IS NOT NULL
  UNION ALL
  SELECT 'injury_consensus_current', gsis_id, epoch_us(updated_at::TIMESTAMPTZ), nullif(upper(trim(report_status)), ''), NULL
  FROM injury_consensus_current WHERE gsis_id IS NOT NULL),
b AS (SELECT entity_table, k, u, x, y,
    last_value(x IGNORE NULLS) OVER w AS fx, last_value(y IGNORE NULLS) OVER w AS fy
  FROM a WHERE u IS NOT NULL WINDOW w AS (PARTITION BY entity_table, k ORDER BY u, x, y ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, lag(fx) OVER w AS px, lag(fy) OVER w AS py, row_number() OVER w AS n FROM b WINDOW w AS (PARTITION BY entity_table, k ORDER BY u, x, y))
SELECT entity_table, k AS entity_key, strftime(make_timestamp(u), '%Y-%m-%dT%H:%M:%SZ') AS valid_from
FROM c WHERE n = 1 OR fx IS DISTINCT FROM px OR fy IS DISTINCT FROM py"""


@CORE.query("p2_found", P2)
def p2_found(spark, d):
    t = Tables(spark, d)
    shown = lambda name, h: h.select(F.lit(name).alias("entity_table"), F.col("entity").alias("entity_key"), micros_text(F.col("valid_from")).alias("valid_from"))
    return shown("player_identity", history.identity_history(t.player_identity)).unionByName(shown("injury_consensus_current", history.report_history(t.injury_consensus_current)))


@CORE.query(
    "p2_identity_versions",
    r"""
WITH a AS (SELECT identity_key AS k, epoch_us(updated_at::TIMESTAMPTZ) AS u, nullif(upper(trim(latest_team)), '') AS x, nullif(upper(trim(position)), '') AS y
  FROM player_identity WHERE identity_key IS NOT NULL),
b AS (SELECT k, u, x, y, last_value(x IGNORE NULLS) OVER w AS fx, last_value(y IGNORE NULLS) OVER w AS fy
  FROM a WHERE u IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY u, x, y ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, lag(fx) OVER w AS px, lag(fy) OVER w AS py, row_number() OVER w AS n FROM b WINDOW w AS (PARTITION BY k ORDER BY u, x, y)),
v AS (SELECT k, fx, fy, u FROM c WHERE n = 1 OR fx IS DISTINCT FROM px OR fy IS DISTINCT FROM py)
SELECT k AS identity_key, fx AS team, fy AS position, u AS valid_from, lead(u) OVER (PARTITION BY k ORDER BY u) AS valid_to FROM v""",
)
def p2_identity_versions(spark, d):
    return history.identity_history(Tables(spark, d).player_identity).withColumnRenamed("entity", "identity_key")


P3 = r"""
WITH a AS (SELECT season, week, season_type, player_id, team,
    arg_max(CASE WHEN passing_yards IS NULL OR isnan(passing_yards) THEN 0 ELSE passing_yards END, epoch_us(updated_at::TIMESTAMPTZ)) AS y
  FROM player_game_stats WHERE trim(player_id) <> '' AND season IS NOT NULL AND week IS NOT NULL GROUP BY ALL),
w AS (SELECT player_id, season, week, sum(y) AS y, count(*) AS n FROM a GROUP BY ALL),
s AS (SELECT player_id, season, unnest(generate_series(lo, hi)) AS week FROM (SELECT player_id, season, min(week) AS lo, max(week) AS hi FROM w GROUP BY ALL)),
g AS (SELECT s.player_id, s.season, s.week, coalesce(w.y, 0) AS passing_yards, coalesce(w.n, 0) AS n_rows FROM s LEFT JOIN w USING (player_id, season, week)),
t AS (SELECT *, sum(passing_yards) OVER (PARTITION BY player_id, season ORDER BY week ROWS 3 PRECEDING) AS passing_yards_sum_4 FROM g)
"""


@CORE.query("p3_found", P3 + "SELECT player_id, season, week FROM t WHERE passing_yards_sum_4 >= 800")
def p3_found(spark, d):
    return trailing.passing_form(Tables(spark, d).player_game_stats).filter("passing_yards_sum_4 >= 800").select("player_id", "season", "week")


@CORE.query(
    "p3_totals",
    P3
    + """SELECT player_id, season, week, passing_yards, n_rows, passing_yards AS passing_yards_sum_1, passing_yards / 1.0 AS passing_yards_avg_1,
  passing_yards_sum_4, passing_yards_sum_4 / 4.0 AS passing_yards_avg_4 FROM t""",
)
def p3_totals(spark, d):
    return trailing.passing_form(Tables(spark, d).player_game_stats)


P4 = r"""
WITH r AS (SELECT slate_slug, snapshot_id, player_id, min(CASE WHEN isnan(projection) THEN NULL ELSE projection END) AS projection,
    min(CASE WHEN isnan(salary) THEN NULL ELSE salary END) AS salary
  FROM player_projection_predictions WHERE snapshot_id IS NOT NULL AND slate_slug IS NOT NULL AND player_id IS NOT NULL GROUP BY ALL),
s AS (SELECT snapshot_id, min(epoch_us(captured_at_utc::TIMESTAMPTZ)) AS taken FROM player_projection_snapshots GROUP BY ALL),
c AS (SELECT slate_slug, snapshot_id, lag(snapshot_id) OVER (PARTITION BY slate_slug ORDER BY taken, snapshot_id) AS before
  FROM (SELECT DISTINCT slate_slug, snapshot_id FROM r) JOIN s USING (snapshot_id) WHERE taken IS NOT NULL),
n AS (SELECT c.slate_slug, c.snapshot_id, player_id, projection, salary FROM c JOIN r USING (slate_slug, snapshot_id) WHERE before IS NOT NULL),
o AS (SELECT c.slate_slug, c.snapshot_id, player_id, projection, salary FROM c JOIN r ON r.slate_slug = c.slate_slug AND r.snapshot_id = c.before),
j AS (SELECT coalesce(n.snapshot_id, o.snapshot_id) AS snapshot_id, coalesce(n.player_id, o.player_id) AS player_id,
    CASE WHEN o.player_id IS NULL THEN 'added' WHEN n.player_id IS NULL THEN 'removed'
      WHEN (o.projection IS NULL) <> (n.projection IS NULL) OR (o.salary IS NULL) <> (n.salary IS NULL)
        OR abs(o.projection - n.projection) > 0.000001 OR abs(o.salary - n.salary) > 0.000001 THEN 'changed' END AS change_kind,
    o.projection AS old_projection, n.projection AS new_projection, o.salary AS old_salary, n.salary AS new_salary
  FROM n FULL JOIN o ON n.slate_slug = o.slate_slug AND n.snapshot_id = o.snapshot_id AND n.player_id = o.player_id)
"""


@CORE.query("p4_found", P4 + "SELECT snapshot_id, player_id, change_kind FROM j WHERE change_kind IS NOT NULL")
def p4_found(spark, d):
    t = Tables(spark, d)
    return snapshot_diff.projection_changes(t.player_projection_snapshots, t.player_projection_predictions).select("snapshot_id", "player_id", "change_kind")


@CORE.query("p4_changes", P4 + "SELECT * FROM j WHERE change_kind IS NOT NULL")
def p4_changes(spark, d):
    t = Tables(spark, d)
    return snapshot_diff.projection_changes(t.player_projection_snapshots, t.player_projection_predictions).drop("slate_slug")


def _readings(spark, d):
    t = Tables(spark, d)
    return timestamps.likeliest_readings(timestamps.record_times(t.source_capture, t.source_events, t.dim_game))


@CORE.query("p5_found")
def p5_found(spark, d):
    return _readings(spark, d).filter("determined").select("source_table", "record_key", "utc_micros")


@CORE.query("p5_readings")
def p5_readings(spark, d):
    return _readings(spark, d)
