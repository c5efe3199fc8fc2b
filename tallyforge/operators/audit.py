"""Data quality: expectations, comparisons, leakage checks and state labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.scalars import fingerprint


def expectations(df: DataFrame, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """(item, value, expected, status): aggregates against expected values, all from one pass over df."""
    one = df.agg(*[c.cast("double").alias(f"v{i}") for i, (c, _) in enumerate(checks.values())])
    rows = [F.struct(F.lit(item).alias("item"), F.col(f"v{i}").alias("value"), F.lit(float(want)).alias("expected")) for i, (item, (_, want)) in enumerate(checks.items())]
    out = one.select(F.inline(F.array(*rows)))
    return out.withColumn("status", F.when(F.abs(F.col("value") - F.col("expected")) <= 1e-9, "PASS").otherwise("FAIL"))


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one known value: (key, n_values)."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")


def compared(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], tolerance: float) -> DataFrame:
    """(keys, verdict): left_only, right_only, differs or same; numbers may differ by `tolerance`, NULL equals NULL."""
    o = old.select(*keys, F.struct(*values).alias("_o"))
    n = new.select(*keys, F.struct(*values).alias("_n"))
    bad = reduce(lambda a, b: a | b, [~F.coalesce(F.abs(F.col(f"_o.{v}") - F.col(f"_n.{v}")) <= tolerance, F.col(f"_o.{v}").isNull() & F.col(f"_n.{v}").isNull()) for v in values])
    verdict = F.when(F.col("_n").isNull(), "left_only").when(F.col("_o").isNull(), "right_only").when(bad, "differs").otherwise("same")
    return o.join(n, keys, "full_outer").select(*keys, verdict.alias("verdict"))


def table_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n_rows, digest) of a table, whatever its order: SHA-256 of sums of rows' SHA-256, so nothing is collected.

    A row counts with the names of its columns and its NULLs; of its hash, all 256 bits are summed, in five parts.
    """
    rows = df.select(fingerprint(*columns).alias("h"))
    sums = [F.sum(F.conv(F.substring("h", 1 + 13 * i, 13), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)]
    return rows.agg(F.count("*").alias("n_rows"), *sums).select("n_rows", F.sha2(F.concat_ws("|", F.lit(",".join(columns)), "n_rows", *[f"s{i}" for i in range(5)]), 256).alias("digest"))


def duplicate_sources(sources: DataFrame, name: str, digest: str) -> DataFrame:
    """sources with `status` and `duplicate_of`: later names with a digest that an earlier one has."""
    w = Window.partitionBy(digest).orderBy(name)
    later = F.row_number().over(w) > 1
    return sources.withColumn("status", F.when(later, "DUPLICATE_SOURCE").otherwise("STAGED")).withColumn("duplicate_of", F.when(later, F.first(name).over(w)))


def lifecycle(first: Column, last: Column, now: Column) -> Column:
    """State of a set of games at `now`: COMPLETED, LOCKED, LATE_SWAP_ACTIVE or OPEN."""
    return F.when(first.isNull(), "FAIL").when(now > last + F.expr("interval 4 hours"), "COMPLETED").when(now >= last, "LOCKED").when(now >= first, "LATE_SWAP_ACTIVE").otherwise("OPEN")


def corroborated(claims: DataFrame, key: list[str], value: str, origin: str) -> DataFrame:
    """(key, n_claims, n_origins, n_values, status): contradictions are quarantined, else independent origins count."""
    once = claims.select(*key, value, origin).distinct()
    out = once.groupBy(*key).agg(F.count("*").alias("n_claims"), F.count_distinct(origin).alias("n_origins"), F.count_distinct(value).alias("n_values"))
    return out.withColumn("status", F.when(F.col("n_values") > 1, "QUARANTINED").when(F.col("n_origins") > 1, "CORROBORATED").otherwise("SINGLE_ORIGIN"))


def current_revision(df: DataFrame, key: list[str], known_at: str, value: str, cutoff: Column) -> DataFrame:
    """(key, value, status): the latest revision known at the cutoff, UNRESOLVED where equal times disagree."""
    seen = df.filter(F.col(known_at) <= cutoff)
    last = seen.groupBy(*key).agg(F.max(known_at).alias(known_at))
    tied = seen.join(last, [*key, known_at], "left_semi")
    out = tied.groupBy(*key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    same = F.col("_lo").eqNullSafe(F.col("_hi"))
    return out.select(*key, F.when(same, F.col("_lo")).alias(value), F.when(same, "CURRENT").otherwise("UNRESOLVED").alias("status"))


def first_row_leaks(df: DataFrame, order_rank: str, features: list[str]) -> DataFrame:
    """(feature, leaks): rows that are an entity's first but whose look-back feature is neither NULL nor 0."""
    first = df.filter(F.col(order_rank) == 0)
    one = first.agg(*[F.count_if(F.coalesce(F.col(f), F.lit(0)) != 0).alias(f) for f in features])
    return one.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("leaks")) for f in features])))


def hash_chains(df: DataFrame, key: str, order: list[str], event: Column) -> DataFrame:
    """(key, n, state): the last link of each key's chain, in which a state is SHA-256 of `the state before|event`.

    A link needs the one before, so a key's events go through one task; they pass as a stream of sorted batches and
    are never held together. Rows without key or event are left out.
    """
    import hashlib

    import pyarrow as pa

    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key).alias("key"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], event.alias("event")).filter("key is not null and event is not null")
    rows = rows.repartition("key").sortWithinPartitions("key", *[f"o{i}" for i in range(len(order))]).select("key", "event")

    def linked(batches):
        last, state, n, names = None, "", 0, []
        for batch in batches:
            names, out = batch.schema, []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("event").to_pylist()):
                if key != last or not n:
                    out += [(last, n, state)] if n else []
                    last, state, n = key, "", 0
                state, n = hashlib.sha256(f"{state}|{text}".encode()).hexdigest(), n + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], names.field("key").type), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out])], [key_name, "n", "state"])
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([last], names.field("key").type), pa.array([n], pa.int64()), pa.array([state])], [key_name, "n", "state"])

    key_name = key
    return rows.mapInArrow(linked, f"`{key}` {kind}, n bigint, state string")
