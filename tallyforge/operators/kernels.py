"""Statistical and allocation kernels: sums in Spark, small solves on the driver, allocation by windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(df: DataFrame, features: list[str]) -> list[tuple[float, float]]:
    """(mean, population deviation) of each feature; a deviation under 1e-12 counts as 1."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
    return [(row[f"m{i}"] or 0.0, row[f"s{i}"] if (row[f"s{i}"] or 0.0) >= 1e-12 else 1.0) for i in range(len(features))]


def medians(df: DataFrame, features: list[str]) -> list[float]:
    """Exact medians (0.0 for a column without values), from counts per value, so that no task holds all values."""
    from tallyforge.operators.windows import exact_quantiles

    rows = [exact_quantiles(df.select(F.lit(0).alias("_all"), c), ["_all"], c, {"q": 0.5}).first() for c in features]
    return [float(r["q"]) if r else 0.0 for r in rows]


def standardised(features: list[str], stats: list[tuple[float, float]]) -> list[Column]:
    return [(F.coalesce(F.col(c), F.lit(m)) - m) / s for c, (m, s) in zip(features, stats)]


def fit_ridge(df: DataFrame, features: list[str], target: str, penalty: float) -> dict:
    """Closed form on standardised features and a centred target: one pass for moments, one for the products.

    What reaches the driver is the matrix of products, features x features, whatever the number of rows. Rows
    without target are left out; missing features take the mean. {'intercept', 'beta': {feature: ...}, 'stats'}.
    """
    rows = df.filter(F.col(target).isNotNull())
    stats = moments(rows, features)
    z = standardised(features, stats)
    k = len(features)
    x = rows.select(*[c.alias(f"x{i}") for i, c in enumerate(z)], F.col(target).cast("double").alias("y"))
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(F.col(f"x{i}") * F.col("y")).alias(f"b{i}") for i in range(k)] + [F.sum(f"x{i}").alias(f"c{i}") for i in range(k)]
    row = x.agg(*sums, F.avg("y").alias("ybar")).first()
    ybar = row["ybar"] or 0.0
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)]) + penalty * np.eye(k)
    b = np.array([(row[f"b{i}"] or 0.0) - ybar * (row[f"c{i}"] or 0.0) for i in range(k)])
    beta = np.linalg.pinv(a) @ b
    return {"intercept": float(ybar), "beta": dict(zip(features, map(float, beta))), "stats": dict(zip(features, stats))}


def ridge_score(model: dict) -> Column:
    """The model's value for a row, as one expression."""
    out = F.lit(model["intercept"])
    for c, beta in model["beta"].items():
        m, s = model["stats"][c]
        fill = model.get("fill", {}).get(c, m)
        out = out + F.lit(beta) * ((F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(fill)), F.lit(fill)) - m) / s)
    return out


def fit_imputed_ridge(df: DataFrame, features: list[str], target: str, penalty: float) -> dict:
    """fit_ridge with missing features (NULL, NaN) filled by their medians and constant features left out.

    Medians and moments are those of the rows with a target; `fill` keeps the medians for scoring. The intercept carries
    no penalty. A model without a feature that varies is an error.
    """
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = df.select(*[known(c).alias(c) for c in features], known(target).alias(target)).filter(F.col(target).isNotNull())
    fill = dict(zip(features, medians(rows, features)))
    rows = rows.na.fill(fill)
    row = rows.agg(*[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
    usable = [c for i, c in enumerate(features) if (row[f"s{i}"] or 0.0) > 1e-12]
    if not usable:
        raise ValueError(f"none of {features} varies")
    return fit_ridge(rows, usable, target, penalty) | {"fill": {c: fill[c] for c in usable}}


def tune_ridge(train: DataFrame, valid: DataFrame, features: list[str], target: str, grid: list[float]) -> list[tuple[float, float]]:
    """[(mae, penalty)] on the validation rows for each penalty, best first."""
    models = [(p, fit_ridge(train, features, target, p)) for p in grid]
    row = valid.filter(F.col(target).isNotNull()).agg(*[F.avg(F.abs(ridge_score(m) - F.col(target))).alias(f"m{i}") for i, (_, m) in enumerate(models)]).first()
    return sorted((row[f"m{i}"], p) for i, (p, _) in enumerate(models))


def fit_logistic(df: DataFrame, features: list[str], target: str, l2: float = 0.1, steps: int = 30, tol: float = 1e-8) -> dict:
    """Minimum of the mean log loss + l2 / 2n * |weights|^2 by Newton steps from the logit of the base rate.

    A step is one aggregate of the rows: loss, gradient and second derivatives, features x features. Steps that do
    not lower the loss are halved. It fails if no gradient under `tol` is reached in `steps` passes. A target of one
    class has no minimum: the result is the base rate, cut at 1e-6, with weights 0.
    """
    rows = df.filter(F.col(target).isNotNull())
    stats = moments(rows, features)
    k = len(features) + 1
    x = rows.select(F.lit(1.0).alias("x0"), *[c.alias(f"x{i + 1}") for i, c in enumerate(standardised(features, stats))], F.col(target).cast("double").alias("y"))
    first = x.agg(F.avg("y").alias("p"), F.count("*").alias("n")).first()
    n, p = first["n"], min(max(0.5 if first["p"] is None else first["p"], 1e-6), 1 - 1e-6)
    ridge = np.diag([0.0] + [l2 / n if n else 0.0] * (k - 1))

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = sum((F.lit(float(v)) * F.col(f"x{i}") for i, v in enumerate(w)), F.lit(0.0))
        s = x.select("*", z.alias("z")).withColumn("q", 1 / (1 + F.exp(-F.greatest(F.least(F.col("z"), F.lit(35.0)), F.lit(-35.0)))))
        loss = F.avg(F.greatest("z", F.lit(0.0)) - F.col("y") * F.col("z") + F.log1p(F.exp(-F.abs("z"))))
        e, c = F.col("q") - F.col("y"), F.col("q") * (1 - F.col("q"))
        second = [F.avg(c * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]
        r = s.agg(loss.alias("loss"), *[F.avg(e * F.col(f"x{i}")).alias(f"g{i}") for i in range(k)], *second).first()
        h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        return r["loss"] + w @ ridge @ w / 2, np.array([r[f"g{i}"] for i in range(k)]) + ridge @ w, h + ridge

    w = np.array([float(np.log(p / (1 - p)))] + [0.0] * (k - 1))
    if n and 0 < first["p"] < 1:
        loss, gradient, second = at(w)
        for _ in range(steps):
            if not np.abs(gradient).max() >= tol:
                break
            step = np.linalg.pinv(second) @ gradient
            for half in range(20):
                tried = at(w - step / 2**half)
                if tried[0] <= loss + 1e-12 * abs(loss):
                    break
            w, (loss, gradient, second) = w - step / 2**half, tried
        if not np.abs(gradient).max() < tol:
            raise ArithmeticError(f"no gradient under {tol} after {steps} steps: {np.abs(gradient).max()}")
    return {"intercept": float(w[0]), "beta": dict(zip(features, map(float, w[1:]))), "stats": dict(zip(features, stats))}


def proportional(total: str, weight: str, keys: list[str]) -> Column:
    """total * w / sum(w) in a group, equal parts where no weight is positive; negative and NULL weights are 0."""
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    g = Window.partitionBy(*keys)
    s = F.sum(w).over(g)
    return F.when(s > 0, F.col(total) * w / s).otherwise(F.col(total) / F.count("*").over(g))


def water_filled(df: DataFrame, keys: list[str], total: str, weight: str, cap: str, tie: str) -> DataFrame:
    """df with `share`: total by weight within caps, what a capped row cannot take going to the others by weight.

    Closed form: in the order of cap/weight the capped rows come first; the level at each row follows from
    running sums, and the first one within its row's cap/weight, which is the highest such, is the answer. Rows without positive
    weight get 0; if all caps are reached the rest of the total is not given.
    """
    w, c = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce(F.col(cap), F.lit(0.0)), F.lit(0.0))
    rows = df.withColumns({"_w": w, "_c": c}).withColumn("_ratio", F.when(F.col("_w") > 0, F.col("_c") / F.col("_w")))
    g = Window.partitionBy(*keys)
    o = g.orderBy(F.col("_ratio").asc_nulls_last(), tie)
    rows = rows.withColumn("_before", F.coalesce(F.sum(F.when(F.col("_ratio").isNotNull(), F.col("_c"))).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("_rest", F.sum("_w").over(o.rowsBetween(0, Window.unboundedFollowing)))
    level = F.when(F.col("_ratio").isNotNull(), (F.col(total) - F.col("_before")) / F.nullif("_rest", F.lit(0.0)))
    rows = rows.withColumn("_level", level)
    fits = F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))
    rows = rows.withColumn("_l", F.max(fits).over(g))
    share = F.when(F.col("_ratio").isNull(), 0.0).when(F.col("_l").isNull(), F.col("_c")).otherwise(F.least(F.col("_c"), F.greatest(F.col("_l"), F.lit(0.0)) * F.col("_w")))
    return rows.withColumn("share", share).drop("_w", "_c", "_ratio", "_before", "_rest", "_level", "_l")


def largest_remainder(df: DataFrame, keys: list[str], total: str, weight: str, tie: str) -> DataFrame:
    """df with integer `units`: floor of each quota, leftover units by remainder, weight and tie, descending.

    total is rounded half up first; without positive weights all get 0.
    """
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    g = Window.partitionBy(*keys)
    rows = df.withColumn("_w", w).withColumn("_t", F.floor(F.col(total) + 0.5)).withColumn("_s", F.sum("_w").over(g))
    rows = rows.withColumn("_q", F.when(F.col("_s") > 0, F.col("_t") * F.col("_w") / F.col("_s")).otherwise(0.0)).withColumn("_f", F.floor("_q"))
    left = F.when(F.col("_s") > 0, F.max("_t").over(g) - F.sum("_f").over(g)).otherwise(0)
    place = F.row_number().over(g.orderBy((F.col("_q") - F.col("_f")).desc(), F.col("_w").desc(), F.col(tie).desc()))
    return rows.withColumn("_left", left).withColumn("_p", place).withColumn("units", F.col("_f") + (F.col("_p") <= F.col("_left")).cast("long")).drop("_w", "_t", "_s", "_q", "_f", "_left", "_p")


def seeded_index(seed: Column, n: Column) -> Column:
    """A reproducible index in [0, n) from a seed column: the leading 15 hex digits of its SHA-256."""
    return F.when(n > 0, F.pmod(F.conv(F.substring(F.sha2(seed.cast("string"), 256), 1, 15), 16, 10).cast("long"), n))


def greedy_uncorrelated(pairs: dict[tuple[str, str], float], ranked: list[str], limit: float, most: int) -> list[str]:
    """Features in order of rank whose |r| with all kept ones is under `limit`, up to `most` (a feature list is small)."""
    kept: list[str] = []
    for f in ranked:
        if len(kept) < most and all(abs(pairs.get((f, g), pairs.get((g, f), 0.0))) < limit for g in kept):
            kept.append(f)
    return kept


def folded_state(events: Column, start: Column, step) -> Column:
    """State replay: a left fold of an array of events, ordered by its caller."""
    return F.aggregate(events, start, step)
