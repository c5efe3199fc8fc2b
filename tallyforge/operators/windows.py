"""Leakage-safe window features: only rows before the current one are looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


class Prior:
    """Features of the rows before each row of an entity, all from one WindowSpec: one shuffle and one sort."""

    def __init__(self, entity: list[str], order: list[str]):
        self.w: WindowSpec = Window.partitionBy(*entity).orderBy(*order)

    def back(self, n: int) -> WindowSpec:
        return self.w.rowsBetween(-n, -1)

    def last(self, c: str, n: int = 1) -> Column:
        return F.lag(c, n).over(self.w)

    def mean(self, c: str, n: int) -> Column:
        return F.avg(c).over(self.back(n))

    def max(self, c: str, n: int) -> Column:
        return F.max(c).over(self.back(n))

    def sum(self, c: str, n: int) -> Column:
        return F.sum(c).over(self.back(n))

    def count(self, c: str, n: int) -> Column:
        return F.count(c).over(self.back(n))

    def std(self, c: str, n: int, ddof: int = 0) -> Column:
        """Population (ddof 0) or sample (1) deviation, NULL under two values."""
        f = F.stddev_pop if ddof == 0 else F.stddev_samp
        return F.when(self.count(c, n) >= 2, f(c).over(self.back(n)))

    def count_if(self, cond: Column, n: int) -> Column:
        """How many of the last n rows fulfil cond; NULL without prior rows."""
        return F.sum(F.when(cond, 1).otherwise(0)).over(self.back(n))

    def rows(self) -> Column:
        return F.row_number().over(self.w) - 1

    def total(self, c: str) -> Column:
        return F.sum(c).over(self.w.rowsBetween(Window.unboundedPreceding, -1))

    def ratio(self, a: str, b: str) -> Column:
        return F.try_divide(self.total(a), F.nullif(self.total(b), F.lit(0.0)))


def eras(df: DataFrame, entity: list[str], order: list[str], value: str) -> DataFrame:
    """df with `era`: 1 for an entity's first run of equal values, one more at each change. NULL is a value."""
    w = Window.partitionBy(*entity).orderBy(*order)
    changed = (F.row_number().over(w) > 1) & ~F.col(value).eqNullSafe(F.lag(value).over(w))
    return df.withColumn("_c", changed.cast("int")).withColumn("era", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_c")


def rank_first_pct(partition: list[str], order: list[Column]) -> Column:
    """row_number / count: ties broken by the order given."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) / F.count("*").over(Window.partitionBy(*partition))


def rank_average(partition: list[str], value: str) -> Column:
    """Rank with ties averaged; NULL values have none."""
    w = Window.partitionBy(*partition).orderBy(F.col(value).asc_nulls_last())
    ties = F.count("*").over(Window.partitionBy(*partition, value))
    return F.when(F.col(value).isNotNull(), F.rank().over(w) + (ties - 1) / 2.0)


def percentile_points(partition: list[str], value: str) -> Column:
    """(average rank - 1) / (n - 1), 1.0 for the only row."""
    n = F.count(value).over(Window.partitionBy(*partition))
    return F.when(n == 1, 1.0).otherwise((rank_average(partition, value) - 1) / F.nullif(n - 1, F.lit(0)))


def quintile(partition: list[str], order: list[Column], value: str) -> Column:
    """Q1_LOW to Q5_HIGH of rank/count over valid rows, NULL under five of them."""
    valid = F.col(value).isNotNull()
    w = Window.partitionBy(*partition, valid)
    n = F.count(value).over(Window.partitionBy(*partition))
    return F.when(valid & (n >= 5), fifth(F.row_number().over(w.orderBy(*order)), n))


def fifth(place: Column, n: Column) -> Column:
    """Q1_LOW to Q5_HIGH of a place among n."""
    return F.element_at(F.array(*map(F.lit, ["Q1_LOW", "Q2", "Q3", "Q4", "Q5_HIGH"])), F.ceil(5 * place / F.nullif(n, F.lit(0))).cast("int"))


def tail_features(df: DataFrame, entity: list[str], order: list[Column], c: str, n: int) -> DataFrame:
    """Per entity: last value, and mean, sum and population deviation of the last n rows. `order`: newest first.

    The rank is cut to n rows per entity before the shuffle (window group limit), so an entity's history is not moved.
    """
    last = df.withColumn("_k", F.row_number().over(Window.partitionBy(*entity).orderBy(*order))).filter(F.col("_k") <= n)
    return last.groupBy(*entity).agg(F.max(F.when(F.col("_k") == 1, F.col(c))).alias("last"), F.avg(c).alias("mean"), F.sum(c).alias("total"), F.when(F.count(c) >= 2, F.stddev_pop(c)).alias("spread"), F.count("*").alias("n"))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in an explicit order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def global_order_sums(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of `value` over all rows before each in a total order, without one task that sees all.

    Rows are range-partitioned and sorted; sums of whole partitions (one number each) are added up on the driver.
    df should be aggregated to distinct `order` values first. The numbering must stay the same for both uses, so
    it is written to the shared folder.
    """
    from tallyforge.session import materialise

    spark = df.sparkSession
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33))
    rows = materialise(spark, rows, "ordered")
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_s")).withColumn("_base", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, "_part").withColumn(name, F.col("_base") + F.col("_in")).drop("_id", "_part", "_in", "_base")


def join_groups(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of its group's row; NULL keys are groups like any other. `groups` has a row per group."""
    other = groups.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    return df.join(other, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]).drop(*[f"_g_{k}" for k in keys])


def group_places(df: DataFrame, group: list[str], order: list[Column], place: str = "place", n: str = "n") -> DataFrame:
    """df with each row's place (from 1) in its group by `order`, and the group's number of rows.

    What row_number and count do over a window, for groups of any size: rows are range-partitioned by group and order,
    places follow from the rows of whole partitions and the first place of a group. `order` should be total.
    """
    from tallyforge.session import materialise

    spark = df.sparkSession
    by = [*[F.col(g).asc_nulls_first() for g in group], *order]
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    rows = materialise(spark, rows, "places").withColumn("_part", F.shiftright("_id", 33))
    parts = rows.groupBy("_part").agg(F.count("*").alias("_c"))  # a row per partition
    parts = parts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    rows = rows.join(parts, "_part").withColumn("_at", F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_part", "_base", "_id")
    groups = rows.groupBy(*group).agg(F.min("_at").alias("_first"), F.count("*").alias(n))
    return join_groups(rows, groups, group).withColumn(place, F.col("_at") - F.col("_first") + 1).drop("_at", "_first")


def value_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, before, ties, n): of each known value how many rows of its group are less, equal, and in all.

    Rows are counted per value first, so a value that a third of all rows have is one row.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("ties"))
    sums = global_order_sums(per, [*group, value], "ties", "_at")
    groups = sums.groupBy(*group).agg(F.min("_at").alias("_first"), F.sum("ties").alias("n"))
    return join_groups(sums, groups, group).withColumn("before", F.col("_at") - F.col("_first")).select(*group, value, "before", "ties", "n")


def exact_quantiles(df: DataFrame, group: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(group, names of `wanted`): quantiles with linear interpolation, exact for groups of any size; NULL without values.

    Groups without any value have no row.
    """
    ranks = value_ranks(df, group, value)
    aggs = []
    for name, q in wanted.items():
        at = F.col("n").cast("double") - 1
        for side, k in (("lo", F.floor(at * q)), ("hi", F.ceil(at * q))):
            aggs.append(F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("ties")), F.col(value))).alias(f"{name}_{side}"))
    out = ranks.groupBy(*group).agg(F.max("n").alias("n"), *aggs)
    part = lambda q: (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    return out.select(*group, *[((F.col(f"{k}_hi") - F.col(f"{k}_lo")) * part(q) + F.col(f"{k}_lo")).alias(k) for k, q in wanted.items()])


def replayed(df: DataFrame, entity: str, order: list[str], event: list[str], start: Column, step, merge, bits: int = 8) -> DataFrame:
    """(entity, state): each entity's events folded in order, in blocks and then in blocks of blocks.

    `step` takes a state and an event (a struct of `event`), `merge` two states of runs that follow each other; folding
    a run from `start` and merging must be folding on. No row holds more than 2 ** bits events or states, but for the
    last of four levels.
    """
    rows = df.filter(F.col(entity).isNotNull()).repartitionByRange(entity, *order).sortWithinPartitions(entity, *order)
    rows = rows.withColumn("_b", F.shiftright(F.monotonically_increasing_id(), bits))
    rows = rows.groupBy(entity, "_b").agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in event if c not in order]))).alias("_e"))
    rows = rows.select(entity, "_b", F.aggregate("_e", start, step).alias("state"))
    for level in range(3):
        above = F.shiftright("_b", bits) if level < 2 else F.lit(0)
        rows = rows.groupBy(entity, above.alias("_a")).agg(F.array_sort(F.collect_list(F.struct("_b", "state"))).alias("_e"))
        rows = rows.select(entity, F.col("_a").alias("_b"), F.aggregate("_e", start, lambda s, x: merge(s, x["state"])).alias("state"))
    return rows.select(entity, "state")
