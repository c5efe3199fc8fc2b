"""Joins with contracts, point-in-time joins and cascades of exact keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A side of a join has a key more than once."""


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, count) of keys that occur more than once; rows with a NULL key count as one key like any other."""
    return df.groupBy(*keys).count().filter("count > 1")


def contract_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", validate: str = "m:1") -> DataFrame:
    """An equi-join that fails at run time where a side that is to be unique is not.

    validate: 'm:1' (right unique), '1:1' (both) or 'm:m'. The check is part of the plan: the unique side's keys
    are counted in the aggregation that the join's shuffle needs anyway. Rows with a NULL key match nothing.
    Columns of both sides other than the keys must differ in name; clashes on the right get the suffix `_right`.
    """

    def once(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        whole = df.filter(" and ".join(f"`{k}` is not null" for k in keys))
        one = whole.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_r") if rest else F.lit(None).alias("_r"))
        told = F.concat(F.lit("the key is not unique: "), F.to_json(F.struct(*keys)))
        # part of the key itself, so that no later projection can prune the check away
        checked = F.when(F.col("_n") > 1, F.raise_error(told).cast(dict(df.dtypes)[keys[0]])).otherwise(F.col(keys[0]))
        return one.select(checked.alias(keys[0]), *keys[1:], *[F.col(f"_r.{c}").alias(c) for c in rest])

    clash = [c for c in right.columns if c in left.columns and c not in keys]
    right = right.withColumnsRenamed({c: f"{c}_right" for c in clash})
    right = once(right) if validate.endswith(":1") else right
    if validate.startswith("1"):
        nulls = left.filter(" or ".join(f"`{k}` is null" for k in keys))
        left = once(left).select(left.columns).unionByName(nulls)
    return left.join(right, keys, how)


def outer_indicator(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with `_merge`: left_only, right_only or both. NULL keys match nothing."""
    l, r = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    side = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return l.join(r, keys, "full_outer").withColumn("_merge", side).drop("_l", "_r")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left without a partner: the reject table of a join."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def anti_either(left: DataFrame, right: DataFrame, first: str, second: str) -> DataFrame:
    """Rows of left that match right neither on `first` nor on `second`: two equi anti-joins instead of an OR."""
    a = right.select(first).filter(F.col(first).isNotNull()).distinct()
    b = right.select(second).filter(F.col(second).isNotNull()).distinct()
    return left.join(a, first, "left_anti").join(b, second, "left_anti")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], strict: bool = True) -> DataFrame:
    """Each left row with the values of right's last row before it (strict) or up to it, per key.

    Both sides are put in one order and the last known values carried along: one shuffle, no range join. Rows
    of right with the same time are decided by the greatest values. A key with very many rows is sorted by one
    task, which spills; use `asof_join_bucketed` where one key holds much of the data.
    """
    tag = 0 if strict else 1  # at equal times: left rows come before right ones if strict
    l = left.withColumn("_at", F.col(left_at)).withColumn("_tag", F.lit(tag)).withColumn("_v", F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType))
    r = right.select(*keys, F.col(right_at).alias("_at"), F.lit(1 - tag).alias("_tag"), F.struct(*values).alias("_v"))
    both = l.withColumn("_left", F.lit(True)).unionByName(r.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_tag", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_left")
    return out.select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


def asof_join_bucketed(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], seconds: int, strict: bool = True) -> DataFrame:
    """As `asof_join` for numeric times (seconds), in time buckets, so that one hot key is many groups.

    Every bucket gets, as a first row, the last values of the buckets before it; there is one such row per key
    and bucket.
    """
    bucket = lambda c: F.floor(F.col(c) / seconds)
    r = right.withColumn("_b", bucket(right_at))
    last = r.groupBy(*keys, "_b").agg(F.max(F.struct(F.col(right_at).alias("_t"), *values)).alias("_s"))
    l = left.withColumn("_b", bucket(left_at))
    marks = l.select(*keys, "_b").distinct().join(last, [*keys, "_b"], "full_outer")
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    seeds = marks.withColumn("_s", F.last("_s", ignorenulls=True).over(w)).filter("_s is not null")
    seeds = seeds.select(*keys, "_b", F.col("_s._t").alias(right_at), *[F.col(f"_s.{v}").alias(v) for v in values])
    rows = r.select(*keys, "_b", right_at, *values).unionByName(seeds)
    return asof_join(l, rows, [*keys, "_b"], left_at, right_at, values, strict).drop("_b")


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, id_col: str) -> DataFrame:
    """For each left row the latest right row strictly before it, with `n_tied`: how many share that time."""
    seen = right.groupBy(*keys, right_at).agg(F.min(id_col).alias(id_col), F.count("*").cast("int").alias("n_tied"))
    return asof_join(left, seen, keys, left_at, right_at, [right_at, id_col, "n_tied"]).filter("n_tied is not null")


def latest_per_group(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """All rows at the latest time of their group."""
    last = df.groupBy(*keys).agg(F.max(at).alias(at))
    return df.join(last, [*keys, at], "left_semi")


def unique_exact(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once; the others are ambiguous and left out. Rows with a NULL key too."""
    whole = df.filter(" and ".join(f"`{k}` is not null" for k in keys))
    rest = [c for c in df.columns if c not in keys]
    one = whole.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_r")).filter("_n = 1")
    return one.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(df.columns)


def cascade_join(left: DataFrame, right: DataFrame, passes: list[tuple[str, list[str]]], value: str) -> DataFrame:
    """Left rows with right's `value` by the first pass (label, keys) that finds it through a unique key."""
    out = left.withColumn("_value", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("match_method", F.lit(None).cast("string"))
    for label, keys in passes:
        once = unique_exact(right.select(*keys, F.col(value).alias("_hit")).distinct(), keys)
        out = out.join(once, keys, "left")
        out = out.withColumn("match_method", F.when(F.col("_value").isNull() & F.col("_hit").isNotNull(), label).otherwise(F.col("match_method"))).withColumn("_value", F.coalesce("_value", "_hit")).drop("_hit")
    return out.withColumn("match_method", F.coalesce("match_method", F.lit("UNMATCHED"))).withColumnRenamed("_value", value)


def two_sided(df: DataFrame, keep: list[str], sides: dict[str, tuple[Column, ...]], names: list[str]) -> DataFrame:
    """One row per side of each row: `sides` maps a label to the columns that become `names` (one pass, no union)."""
    rows = [F.struct(F.lit(label).alias("side"), *[c.alias(n) for c, n in zip(cols, names)]) for label, cols in sides.items()]
    return df.select(*keep, F.inline(F.array(*rows)))


def broadcast_if_small(df: DataFrame, rows: int = 100_000, size: int = 32_000_000) -> DataFrame:
    """A broadcast hint if the table is found to have at most `rows` rows and `size` bytes as text; else the planner decides."""
    text = F.octet_length(F.to_json(F.struct(*df.columns)))
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(text).alias("bytes")).first()
    return F.broadcast(df) if found["n"] <= rows and (found["bytes"] or 0) <= size else df
