"""History of changing attributes: bounded folds of sorted struct arrays, joined at their borders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.times import iso_micros
from tallyforge.session import materialise

BLOCK = 256  # rows of one entity folded at once, whatever the size of the entity
RUN_BITS = 12  # blocks whose borders are joined at once, as a power of two


def _fold(rows, start, names):
    """The versions in an array of (at, *names) structs, given the state before it.

    A NULL attribute says nothing; a version is appended only if a known value differs from the last one.
    """

    def step(acc, row):
        state = F.struct(*[F.coalesce(row[n], acc["state"][n]).alias(n) for n in names])
        changed = F.lit(False)
        for n in names:
            changed = changed | (row[n].isNotNull() & ~row[n].eqNullSafe(acc["state"][n]))
        version = F.struct(row["at"].alias("at"), *[state[n].alias(n) for n in names])
        return F.struct(state.alias("state"), F.when(changed, F.concat(acc["versions"], F.array(version))).otherwise(acc["versions"]).alias("versions"))

    return F.aggregate(rows, F.struct(start.alias("state"), F.filter(rows, lambda r: F.lit(False)).alias("versions")), step)


def _borders(blocks: DataFrame, names: list[str]) -> DataFrame:
    """(entity, block, start, opens, next) of the blocks of entities that have several.

    start: the attributes' last known values before the block; opens: it is the entity's first; next: when the first
    version of a later block begins. Windows run within runs of 2 ** RUN_BITS blocks and over one row per run, so a
    task meets neither the rows nor the versions of a hot entity, only their summaries.
    """
    several = blocks.groupBy("entity").agg(F.count("*").alias("n")).filter("n > 1").select("entity")
    # of each attribute: the first known value, its time, and the time of the first value that differs from it
    def first(n: str) -> F.Column:
        return F.get(F.filter("own.versions", lambda v: v[n].isNotNull()), F.lit(0))

    def other(n: str) -> F.Column:
        return F.get(F.filter("own.versions", lambda v: v[n].isNotNull() & (v[n] != F.col(f"first_{n}")[n])), F.lit(0))

    rows = blocks.select("entity", "block", "begin", "own", *[first(n).alias(f"first_{n}") for n in names]).join(several, "entity", "left_semi")
    rows = rows.select("entity", "block", F.shiftright("block", RUN_BITS).alias("run"), "begin", F.col("own.state").alias("state"), *[f"first_{n}" for n in names], *[other(n)["at"].alias(f"then_{n}") for n in names])

    before = Window.partitionBy("entity", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"in_{n}": F.last(F.col("state")[n], ignorenulls=True).over(before) for n in names} | {"_k": F.count("*").over(before)})
    last = [F.max(F.when(F.col("state")[n].isNotNull(), F.struct("block", F.col("state")[n].alias("x"))))["x"].alias(f"x_{n}") for n in names]
    runs = rows.groupBy("entity", "run").agg(*last)
    earlier = Window.partitionBy("entity").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("entity", "run", *[F.last(f"x_{n}", ignorenulls=True).over(earlier).alias(f"out_{n}") for n in names], F.count("*").over(earlier).alias("_r"))
    rows = rows.join(runs, ["entity", "run"])
    start = {n: F.coalesce(f"in_{n}", f"out_{n}") for n in names}
    rows = rows.withColumns({"start": F.struct(*[start[n].alias(n) for n in names]), "opens": (F.col("_k") == 0) & (F.col("_r") == 0)})
    change = [F.when(F.col(f"first_{n}")[n].eqNullSafe(F.col("start")[n]), F.col(f"then_{n}")).otherwise(F.col(f"first_{n}")["at"]) for n in names]
    change = F.least(*change) if len(change) > 1 else change[0]
    rows = rows.select("entity", "block", "run", "start", "opens", F.when(F.col("opens"), F.col("begin")).otherwise(change).alias("change"))

    # times rise with the blocks, so the next change is the least of those that follow
    after = Window.partitionBy("entity", "run").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = Window.partitionBy("entity").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("entity", "run").agg(F.min("change").alias("change"))
    ends = ends.select("entity", "run", F.min("change").over(beyond).alias("_far"))
    rows = rows.withColumn("_near", F.min("change").over(after)).join(ends, ["entity", "run"])
    return rows.select("entity", "block", "start", "opens", F.coalesce("_near", "_far").alias("next"))


def attribute_history(df: DataFrame, entity: str, at: str, attributes: dict[str, F.Column]) -> DataFrame:
    """(entity, *attributes, valid_from, valid_to): each version an entity had, in microseconds as `at` is.

    `attributes` maps names to comparable values, NULL where the row says nothing. The first version begins with the
    entity's first row, whether that says anything or not, so an entity whose rows are all blank has one version. A
    further one begins when a known value differs from the last one, or was not known before. Rows with a NULL entity
    or time are left out. Rows of one entity and time are taken in the order of their values. valid_to is the next
    version's valid_from, NULL for the version that holds.

    Rows are range-partitioned by entity and time and numbered in that order, and each run of up to BLOCK rows of an
    entity is folded alone. A block's versions are folded again from the state that the blocks before it left, which
    comes from the blocks' summaries; so no entity, however large, meets in one task.
    """
    names = list(attributes)
    kinds = dict(df.select(*[c.alias(n) for n, c in attributes.items()]).dtypes)
    unknown = F.struct(*[F.lit(None).cast(kinds[n]).alias(n) for n in names])
    rows = df.select(F.col(entity).alias("entity"), F.col(at).alias("at"), *[c.alias(n) for n, c in attributes.items()])
    rows = rows.filter(F.col("entity").isNotNull() & F.col("at").isNotNull()).distinct()
    order = ["entity", "at", *names]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1))
    blocks = rows.groupBy("entity", "block").agg(F.array_sort(F.collect_list(F.struct("at", *names))).alias("rows"))
    blocks = blocks.select("entity", "block", F.col("rows")[0]["at"].alias("begin"), _fold(F.col("rows"), unknown, names).alias("own"))
    # read three times; the numbering must be one and the same
    blocks = materialise(df.sparkSession, blocks, "blocks")
    rows = blocks.join(_borders(blocks, names), ["entity", "block"], "left")
    start = F.coalesce("start", unknown)
    # a block that no other change precedes keeps its versions as they are
    versions = F.when(F.col("start").isNull(), F.col("own.versions")).otherwise(_fold(F.col("own.versions"), start, names)["versions"])
    rows = rows.select("entity", "begin", F.coalesce("opens", F.lit(True)).alias("opens"), versions.alias("versions"), "next")
    blank = F.struct(F.col("begin").alias("at"), *[unknown[n].alias(n) for n in names])
    silent = F.col("opens") & ((F.size("versions") == 0) | (F.get("versions", F.lit(0))["at"] > F.col("begin")))
    rows = rows.withColumn("versions", F.when(silent, F.concat(F.array(blank), "versions")).otherwise(F.col("versions"))).filter(F.size("versions") > 0)
    ends = F.zip_with("versions", F.concat(F.slice(F.transform("versions", lambda v: v["at"]), 2, BLOCK), F.array("next")), lambda v, e: F.struct(v.alias("v"), e.alias("valid_to")))
    out = rows.select("entity", F.explode(ends).alias("x"))
    return out.select("entity", *[F.col(f"x.v.{n}").alias(n) for n in names], F.col("x.v.at").alias("valid_from"), F.col("x.valid_to").alias("valid_to"))


def comparable(col: F.Column) -> F.Column:
    """Text without regard to letter case and blanks around it; blank text is NULL."""
    text = F.upper(F.regexp_replace(col, r"^\s+|\s+$", ""))
    return F.when(text != "", text)


def identity_history(identity: DataFrame) -> DataFrame:
    """Versions of latest_team with position by identity_key."""
    rows = identity.withColumn("_at", iso_micros(F.col("updated_at")))
    return attribute_history(rows, "identity_key", "_at", {"team": comparable(F.col("latest_team")), "position": comparable(F.col("position"))})


def report_history(injuries: DataFrame) -> DataFrame:
    """Versions of report_status by gsis_id over all seasons."""
    rows = injuries.withColumn("_at", iso_micros(F.col("updated_at")))
    return attribute_history(rows, "gsis_id", "_at", {"status": comparable(F.col("report_status"))})
