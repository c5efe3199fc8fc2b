"""Mixing sources to target shares of the total size, by pivotal dependent rounding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.encoding import RANKS, token_counts
from tallyforge.session import materialise

BLOCK = 20_000  # records rounded together; one residual of each block goes on to the next level
FAN = 1_000  # blocks whose residuals meet at the next level; the root has one residual per BLOCK * FAN records


def pivot_round(sizes: np.ndarray, shares: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Round fractions to 0 or 1 in pairs; returns them and the place of the one left fractional, or -1.

    Of a pair, size is moved from one to the other until one fraction is integral. Which way is drawn such that
    each fraction keeps its expectation; the sum of size x fraction stays as it is at every step.
    """
    out = shares.astype(float).copy()
    left = -1
    for i in range(len(out)):
        if not 1e-12 < out[i] < 1 - 1e-12:
            out[i] = round(out[i])
            continue
        if left < 0:
            left = i
            continue
        a, b, wa, wb = out[left], out[i], sizes[left], sizes[i]
        up, down = min(wa * (1 - a), wb * b), min(wa * a, wb * (1 - b))
        if draws[i] * (up + down) < down:  # moves `up` with the chance down / (up + down)
            a, b = a + up / wa, b - up / wb
        else:
            a, b = a - down / wa, b + down / wb
        out[left], out[i] = a, b
        done_a, done_b = (min(x, 1 - x) < 1e-9 for x in (a, b))
        if done_a:
            out[left] = round(a)
        if done_b:
            out[i] = round(b)
        left = -1 if done_a and done_b else i if done_a else left
    return out, left


_PLAN = ["source", "target_share", "max_repeats", "available", "n", "rate"]
_COLUMNS = ["source", "record", "size", "share", "draw", "coin", "block", "done"]
_FIELDS = "source string, record bigint, size double, share double, draw double, coin double, block bigint, done boolean"


def _round_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's records with their fractions rounded; the residual keeps its fraction and is not done."""
    pdf = pdf.sort_values(["draw", "record"]).reset_index(drop=True)
    out, left = pivot_round(pdf["size"].to_numpy(), pdf["share"].to_numpy(), pdf["coin"].to_numpy())
    done = np.ones(len(pdf), bool)
    if left >= 0:
        done[left] = False
    return pdf.assign(share=out, done=done)[_COLUMNS]


def _round_root(pdf: pd.DataFrame) -> pd.DataFrame:
    """The last group of a source: what stays fractional is drawn by its own chance."""
    pdf = _round_block(pdf)
    last = ~pdf["done"]
    pdf.loc[last, "share"] = (pdf.loc[last, "draw"] < pdf.loc[last, "share"]).astype(float)
    return pdf.assign(done=True)


def mixed(sized: DataFrame, targets: DataFrame, seed: int = 17, total: float | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(copies, shares) for rows (record, source, size) and targets (source, target_share, max_repeats).

    copies: (record, source, size, copies) of every record used at least once; shares: (source, target_share,
    max_repeats, available, used, copies, actual_share), a row per target. `total` is the size of the mix; by
    default, and at most, the largest at which every source can give its share within its repeats.

    Every record of a source gets the same expected number of copies, its whole part for certain and one more by
    pivotal rounding in which sizes weigh, so a source misses its share by less than one of its records.
    Records without size or source, or of a source without a target, are not used; targets whose share is NULL
    or 0 get none. A source with a target but no records gives nothing, and the others keep their proportions to each
    other; with `strict` no mix is possible then and no record is used. The choice depends on the seed and the records,
    not on how they are partitioned.
    """
    spark = sized.sparkSession
    aims = targets.filter("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").cast("int").alias("max_repeats"))
    rows = sized.filter("size > 0 and source is not null").select("record", "source", F.col("size").cast("double").alias("size"))
    stock = rows.groupBy("source").agg(F.sum("size").alias("available"), F.count("*").alias("n"))
    # a row per target, whatever the number of records
    plan = [r.asDict() for r in aims.join(stock, "source", "left").na.fill(0, ["available", "n"]).orderBy("source").collect()]
    giving = [r for r in plan if r["available"] or strict]
    unit = min((r["available"] * r["max_repeats"] / r["target_share"] for r in giving), default=0.0)
    if total is not None:
        unit = min(unit, total / sum(r["target_share"] for r in giving)) if giving else 0.0
    for r in plan:
        r["rate"] = min(unit * r["target_share"] / r["available"], float(r["max_repeats"])) if r["available"] else 0.0
    plan = spark.createDataFrame([tuple(r[c] for c in _PLAN) for r in plan], "source string, target_share double, max_repeats int, available double, n bigint, rate double")
    uniform = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "source", "record"), F.lit(1 << 52)) / float(1 << 52)
    used = rows.join(plan.select("source", "rate", "n"), "source").withColumn("draw", uniform(1)).withColumn("coin", uniform(2))
    used = used.withColumn("sure", F.floor("rate")).withColumn("share", F.col("rate") - F.col("sure"))
    used = used.withColumn("block", F.floor(F.col("draw") * F.ceil(F.col("n") / BLOCK)))
    used = materialise(spark, used, "rates")
    level = used.filter("share > 1e-12").groupBy("source", "block").applyInPandas(_round_block, _FIELDS)
    level = materialise(spark, level, "level")
    done = level.filter("done")
    level = level.filter("not done").withColumn("block", F.floor(F.col("block") / FAN))
    level = materialise(spark, level.groupBy("source", "block").applyInPandas(_round_block, _FIELDS), "level")
    root = level.filter("not done").groupBy("source").applyInPandas(_round_root, _FIELDS)
    extra = done.unionByName(level.filter("done")).unionByName(root).filter("share > 0.5").select("source", "record", F.lit(1).alias("extra"))
    copies = used.select("record", "source", "size", "sure").join(extra, ["source", "record"], "left")
    copies = copies.select("record", "source", "size", (F.col("sure") + F.coalesce("extra", F.lit(0))).cast("int").alias("copies")).filter("copies > 0")
    copies = materialise(spark, copies, "copies")
    sums = copies.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("used"), F.sum("copies").alias("copies"))
    shares = plan.select("source", "target_share", "max_repeats", "available").join(sums, "source", "left").na.fill(0, ["used", "copies"])
    grand = copies.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0.0
    shares = shares.withColumn("actual_share", F.col("used") / grand if grand else F.lit(0.0))
    return copies, shares


def sized_documents(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(record, source, size) of documents, sizes in tokens. Of equal doc_ids the one with the most tokens counts.

    At equal sizes that is the one whose source comes last; rows without doc_id are one record without id.
    """
    counts = token_counts(documents.select(F.struct("doc_id", "source").alias("key"), "text"), "key", "text", ranks)
    sized = counts.groupBy(F.col("key.doc_id").alias("record")).agg(F.max(F.struct("n_tokens", "key.source")).alias("v"))
    return materialise(documents.sparkSession, sized.select("record", "v.source", F.col("v.n_tokens").alias("size")), "sizes")


def mixed_documents(documents: DataFrame, targets: DataFrame, ranks: str = RANKS, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """`mixed` over documents, sizes in tokens. Documents without doc_id are not used."""
    return mixed(sized_documents(documents, ranks).filter("record is not null"), targets, seed)


def left_out(documents: DataFrame, targets: DataFrame, ranks: str = RANKS, seed: int = 17) -> DataFrame:
    """(reason, documents, tokens): how many documents a mix does not use, and why."""
    sized = sized_documents(documents, ranks)
    copies = mixed(sized.filter("record is not null"), targets, seed)[0].select("record", F.lit(True).alias("_used"))
    aimed = targets.filter("source is not null and target_share > 0 and max_repeats > 0").select("source", F.lit(True).alias("_aimed")).distinct()
    rows = sized.join(copies, "record", "left").join(aimed, "source", "left").filter("_used is null")
    reason = F.when(F.col("record").isNull(), "no doc_id").when(F.col("source").isNull(), "no source").when(F.col("_aimed").isNull(), "no target").when(F.coalesce("size", F.lit(0)) == 0, "no tokens").otherwise("not drawn")
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("documents"), F.sum("size").alias("tokens"))
