"""Rolling totals over trailing periods, periods without activity included."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.times import iso_micros


def trailing_totals(daily: DataFrame, entity: list[str], period: str, values: list[str], lengths: list[int]) -> DataFrame:
    """Sums and averages of `values` over the last n periods, for each n in lengths, for every period of an entity.

    `daily` may hold several rows per entity and period; they are summed first, with partial sums before the
    shuffle. The entity's calendar from its first to its last period is a sequence, so an entity meets only its
    own periods; a missing period counts as 0 and an average divides by n whatever the entity's age. Rows with a
    NULL entity column or period are left out; NULL and NaN values are 0.
    """
    clean = [F.sum(F.coalesce(F.nanvl(F.col(v).cast("double"), F.lit(0.0)), F.lit(0.0))).alias(v) for v in values]
    rows = daily.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*entity, period]]))
    sums = rows.groupBy(*entity, period).agg(*clean, F.count("*").alias("n_rows"))
    spans = sums.groupBy(*entity).agg(F.min(period).alias("_lo"), F.max(period).alias("_hi"))
    calendar = spans.select(*entity, F.explode(F.sequence("_lo", "_hi")).alias(period))
    dense = calendar.join(sums, [*entity, period], "left").na.fill(0, [*values, "n_rows"])
    out = dense
    for n in lengths:
        last = Window.partitionBy(*entity).orderBy(period).rowsBetween(1 - n, 0)
        for v in values:
            total = F.sum(v).over(last)
            out = out.withColumn(f"{v}_sum_{n}", total).withColumn(f"{v}_avg_{n}", total / F.lit(float(n)))
    return out


def latest_box_scores(stats: DataFrame) -> DataFrame:
    """One row per season, week, season_type, player_id and team: the one updated last.

    Rows updated at the same time are decided by the larger passing_yards. Rows without player_id (NULL or
    blank), season or week are left out.
    """
    rows = stats.filter("trim(player_id) != '' and season is not null and week is not null")
    yards = F.coalesce(F.nanvl("passing_yards", F.lit(0.0)), F.lit(0.0))
    best = F.max(F.struct(F.coalesce(iso_micros(F.col("updated_at")), F.lit(-(2**62))).alias("at"), yards.alias("passing_yards")))
    return rows.groupBy("season", "week", "season_type", "player_id", "team").agg(best.alias("b")).select("season", "week", "season_type", "player_id", "team", F.col("b.passing_yards").alias("passing_yards"))


def passing_form(stats: DataFrame) -> DataFrame:
    """Totals and averages of passing_yards for the latest week and the latest four, REG and POST together."""
    return trailing_totals(latest_box_scores(stats), ["player_id", "season"], "week", ["passing_yards"], [1, 4])
