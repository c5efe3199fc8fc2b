"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.times import iso_micros
from tallyforge.operators.joins import broadcast_if_small
from tallyforge.operators.windows import global_order_sums
from tallyforge.session import materialise


def residues(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old EXCEPT ALL new, new EXCEPT ALL old) with one shuffle for both.

    Each row counts +1 in the new set and -1 in the old one; counts are summed per distinct row before and after
    the shuffle, and what does not cancel out is the residue of one side. This is how EXCEPT ALL itself is
    planned, done once for both directions. NULLs are equal to each other.
    """
    columns = new.columns
    both = new.withColumn("_n", F.lit(1)).unionByName(old.select(columns).withColumn("_n", F.lit(-1)))
    left = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n != 0")
    side = lambda sign: left.filter(F.col("_n") * sign > 0).select(*columns, F.explode(F.array_repeat(F.lit(0), F.abs("_n").cast("int"))).alias("_i")).drop("_i")
    return side(-1), side(1)


def signed_diff(signed: DataFrame, keys: list[str], values: list[str], tolerance: float = 0.0) -> DataFrame:
    """diff_by_key of one frame of rows with `_sign`: 1 for the new set, -1 for the old one.

    EXCEPT ALL counts signs per distinct row and the full join of its residues is by key. Where a key has one row on
    each side, both are one aggregation by key: the two rows of a key meet there, equal ones cancel out, and what is
    left is labelled. So the rows are shuffled once, summed up before that, and not again for the join.
    """
    new, old = F.col("_sign") > 0, F.col("_sign") < 0
    sides = [F.min(F.when(side, F.col(v))).alias(f"{s}_{v}") for v in values for s, side in (("old", old), ("new", new))]
    both = signed.groupBy(*keys).agg(F.count_if(old).alias("_n_old"), F.count_if(new).alias("_n_new"), *sides)
    moved = F.lit(False)
    for v in values:
        a, b = F.col(f"old_{v}"), F.col(f"new_{v}")
        moved = moved | (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > tolerance, F.lit(False))
    kind = F.when(F.col("_n_old") == 0, "added").when(F.col("_n_new") == 0, "removed").when(moved, "changed")
    shown = [f"{s}_{v}" for v in values for s in ("old", "new")]
    return both.select(*keys, kind.alias("change_kind"), *shown).filter("change_kind is not null")


def diff_by_key(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], tolerance: float = 0.0) -> DataFrame:
    """(keys, change_kind, old_*, new_*): keys added, removed, or changed by more than `tolerance` in a value.

    Keys are to be unique on each side (else the smallest known value of each column counts); NULL keys are equal to
    each other. Values are numbers; NaN is to be NULL already. A value missing on one side only is a change.
    """
    side = lambda df, sign: df.select(*keys, *values, F.lit(sign).alias("_sign"))
    return signed_diff(side(new, 1).unionByName(side(old, -1)), keys, values, tolerance)


def snapshot_order(snapshots: DataFrame, pools: DataFrame) -> DataFrame:
    """(slate_slug, snapshot_id, place, has_before, has_after): snapshots in one order, a slate's on successive places.

    A slate may hold any share of the snapshots: places come from partition sums, neighbours from a join on them.
    """
    times = snapshots.groupBy("snapshot_id").agg(F.min(iso_micros(F.col("captured_at_utc"))).alias("at")).filter("at is not null")
    chain = pools.select("slate_slug", "snapshot_id").distinct().join(times, "snapshot_id").withColumn("_one", F.lit(1))
    chain = global_order_sums(chain, ["slate_slug", "at", "snapshot_id"], "_one", "place").select("slate_slug", "snapshot_id", "place")
    chain = materialise(snapshots.sparkSession, chain, "chain")
    beside = lambda step, name: chain.select("slate_slug", (F.col("place") + step).alias("place"), F.lit(True).alias(name))
    out = chain.join(beside(1, "has_before"), ["slate_slug", "place"], "left").join(beside(-1, "has_after"), ["slate_slug", "place"], "left")
    return materialise(snapshots.sparkSession, out.na.fill(False, ["has_before", "has_after"]), "links")


def projection_changes(snapshots: DataFrame, predictions: DataFrame) -> DataFrame:
    """(slate_slug, snapshot_id, player_id, change_kind, old_/new_ projection and salary) between snapshots of a slate.

    A slate's snapshots are ordered by captured_at_utc, then snapshot_id; the first has no changes. A row
    repeated within a snapshot counts once (if its figures differ, the smallest known ones). Rows without
    snapshot_id, slate_slug or player_id, and snapshots without capture time, are left out; NULL and NaN are both
    missing.

    A row takes part as new at its snapshot's place and as old at the next one.
    """
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    rows = predictions.filter("snapshot_id is not null and slate_slug is not null and player_id is not null")
    links = broadcast_if_small(snapshot_order(snapshots, rows), 400_000)
    linked = rows.join(links, ["slate_slug", "snapshot_id"]).select("place", "has_before", "has_after", "player_id", number("projection"), number("salary"))
    turns = F.concat(F.when(F.col("has_before"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")), F.when(F.col("has_after"), F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))
    signed = linked.withColumn("_sign", F.explode(turns)).withColumn("place", F.when(F.col("_sign") > 0, F.col("place")).otherwise(F.col("place") + 1))
    changes = signed_diff(signed, ["place", "player_id"], ["projection", "salary"], 0.000001)
    return changes.join(links.select("place", "slate_slug", "snapshot_id"), "place").select("slate_slug", "snapshot_id", *changes.columns[1:])
