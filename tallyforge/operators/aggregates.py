"""Aggregates beyond the built-in ones; all are sums that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.scalars import clamp
from tallyforge.operators.windows import exact_quantiles, global_order_sums, group_places, rank_average


def weighted_mean(v: str, w: str) -> Column:
    """Sum of w*v / sum of w over rows with both and w > 0; NULL without any."""
    ok = F.col(v).isNotNull() & (F.col(w) > 0)
    return F.try_divide(F.sum(F.when(ok, F.col(v) * F.col(w))), F.sum(F.when(ok, F.col(w))))


def rate(cond: Column, of: Column) -> Column:
    """Share of the rows where cond holds that fulfil `of`; NULL without such rows."""
    return F.avg(F.when(cond, of.cast("double")))


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation, NULL (never an error) where a side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def guarded_corr(x: str, y: str, least: int = 20) -> Column:
    """Pearson over complete pairs; 0.0 under `least` pairs or where a side is constant."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return F.when((F.count(a) < least) | flat, 0.0).otherwise(pearson(a, b))


def correlation_pairs(df: DataFrame, columns: list[str], least: int = 2) -> DataFrame:
    """(a, b, r) for every pair of columns over complete pairs, in one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[guarded_corr(a, b, least).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])))


def correlation_pairs_by(df: DataFrame, keys: list[str], columns: list[str], least: int = 2) -> DataFrame:
    """correlation_pairs in each group: a row for each pair of columns, added up before the shuffle, instead of a wide aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    long = df.select(*keys, F.posexplode(F.array(*[F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])).alias("k", "p"))
    one = long.select(*keys, "k", "p.x", "p.y").groupBy(*keys, "k").agg(guarded_corr("x", "y", least).alias("r"))
    name = lambda side: F.element_at(F.array(*[F.lit(p[side]) for p in pairs]), F.col("k") + 1)
    return one.select(*keys, name(0).alias("a"), name(1).alias("b"), "r")


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, spearman): Pearson of average ranks within each group; NULL under three pairs or a constant side."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumns({"_x": rank_average(keys, x), "_y": rank_average(keys, y)})
    flat = (F.min("_x") == F.max("_x")) | (F.min("_y") == F.max("_y"))
    return rows.groupBy(*keys).agg(F.when((F.count("*") >= 3) & ~flat, pearson(F.col("_x"), F.col("_y"))).alias("spearman"))


def error_metrics(actual: str, predicted: str) -> list[Column]:
    e = F.col(predicted) - F.col(actual)
    return [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias")]


def log_loss(actual: str, p: str) -> Column:
    q = clamp(p, 1e-12, 1 - 1e-12)
    return -F.avg(F.when(F.col(actual) == 1, F.log(q)).otherwise(F.log(1 - q)))


def brier(actual: str, p: str) -> Column:
    return F.avg(F.pow(F.col(p) - F.col(actual), 2))


def auc(df: DataFrame, actual: str, score: str) -> DataFrame:
    """(auc, n): rank AUC with averaged ties, 0.5 if only one class is there. Rows with a NULL are left out.

    Rows are counted per score first; ranks over all scores come from partition sums, so no task sees them all.
    """
    rows = df.filter(F.col(actual).isNotNull() & F.col(score).isNotNull())
    per = rows.groupBy(F.col(score).alias("_score")).agg(F.count("*").alias("_all"), F.sum(F.col(actual)).cast("long").alias("_pos"))
    ranked = global_order_sums(per, ["_score"], "_all", "_before")
    total = ranked.agg(F.sum("_pos").alias("p"), F.sum("_all").alias("n"), F.sum(F.col("_pos") * (F.col("_before") + (F.col("_all") + 1) / 2.0)).alias("r"))
    neg = F.col("n") - F.col("p")
    return total.select(F.when((F.col("p") == 0) | (neg == 0), 0.5).otherwise((F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * neg)).alias("auc"), "n")


def capture(df: DataFrame, partition: list[str], score: str, hit: str, order: list[Column], top: float = 0.8) -> DataFrame:
    """(n, top_n, base_rate, top_rate, lift, capture) of the rows ranked above `top` in their partition."""
    rows = group_places(df, partition, order, "_k", "_n").withColumn("_p", F.col("_k") / F.col("_n"))
    best = F.col("_p") > top
    out = rows.agg(F.count("*").alias("n"), F.count_if(best).alias("top_n"), F.avg(hit).alias("base_rate"), F.avg(F.when(best, F.col(hit))).alias("top_rate"), F.sum(F.when(best, F.col(hit)).otherwise(0)).alias("_h"), F.sum(hit).alias("_a"))
    return out.withColumn("lift", F.try_divide("top_rate", F.nullif("base_rate", F.lit(0.0)))).withColumn("capture", F.try_divide("_h", F.nullif("_a", F.lit(0)))).drop("_h", "_a")


def shrunk_means(df: DataFrame, group: list[str], parent: list[str], value: str, k: float = 1.0) -> DataFrame:
    """(n * mean + k * parent mean) / (n + k) per group; `parent` is a subset of `group`. One shuffle of rows.

    The parent's mean comes from the groups' sums, not from the rows again.
    """
    sums = df.groupBy(*group).agg(F.count(value).alias("n"), F.sum(value).alias("_s"))
    up = sums.groupBy(*parent).agg(F.try_divide(F.sum("_s"), F.nullif(F.sum("n"), F.lit(0))).alias("parent_mean"))
    out = sums.join(up, parent)
    return out.withColumn("estimate", (F.coalesce("_s", F.lit(0.0)) + k * F.col("parent_mean")) / (F.col("n") + k)).drop("_s")


def top_items(df: DataFrame, keys: list[str], item: str, first_seen: str, n: int) -> DataFrame:
    """(keys, items): the n most frequent items of a group, ties by first appearance, as one text `item:count;...`."""
    counts = df.groupBy(*keys, item).agg(F.count("*").alias("_n"), F.min(first_seen).alias("_f"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_n").desc(), "_f", item))
    best = counts.withColumn("_k", rank).filter(F.col("_k") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_k", F.concat_ws(":", F.col(item).cast("string"), F.col("_n").cast("string")).alias("t"))))
    return best.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["t"]), ";").alias("items"))


def tercile_groups(df: DataFrame, value: str) -> DataFrame:
    """df with `tercile` LOW, MID or HIGH by exact thirds; NULL where there are under two distinct values."""
    span = df.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
    if span["a"] is None or span["a"] == span["b"]:
        return df.withColumn("tercile", F.lit(None).cast("string"))
    low, high = exact_quantiles(df.select(F.lit(0).alias("_all"), value), ["_all"], value, {"low": 1 / 3, "high": 2 / 3}).select("low", "high").first()
    return df.withColumn("tercile", F.when(F.col(value) <= low, "LOW").when(F.col(value) <= high, "MID").when(F.col(value).isNotNull(), "HIGH"))
