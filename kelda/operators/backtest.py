"""Backtests: yearly panels of what was known, fits that leave a year out, and controls by chance."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from kelda.functions.stats import wilson
from kelda.session import cut_lineage

FEATURES = ["n_prior", "n_last", "most", "most_24", "latest_most", "hhi", "lag", "idle_years"]


def yearly_panel(events: DataFrame, entity: str, year: str, value: str, kind: str, years: list[int]) -> DataFrame:
    """entity, year, the eight FEATURES as known before it begins, and ``after``, the events of the year itself.

    Events are reduced to one row per entity, year and kind; such a row then adds itself to
    the panel years that it matters to, so no event meets every year. hhi: concentration
    over kinds. idle_years: since the latest event. Entities without earlier events have
    zeros and NULLs; NULL entities and years are left out, NULL kinds are a kind.
    """
    known = events.where(F.col(entity).isNotNull() & F.col(year).isNotNull())
    small = known.groupBy(F.col(entity).alias("e"), F.col(year).cast("int").alias("y"), F.col(kind).alias("k")).agg(F.count("*").alias("n"), F.max(value).alias("v"))
    spread = small.withColumn("t", F.explode(F.filter(F.array(*[F.lit(t) for t in years]), lambda t: t >= F.col("y"))))
    per_kind = spread.groupBy("e", "t", "k").agg(
        F.sum(F.when(F.col("y") < F.col("t"), F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("y") == F.col("t") - 1, F.col("n")).otherwise(0)).alias("last"),
        F.sum(F.when(F.col("y") == F.col("t"), F.col("n")).otherwise(0)).alias("after"),
        F.max(F.when(F.col("y") < F.col("t"), F.col("v"))).alias("most"),
        F.max(F.when((F.col("y") < F.col("t")) & (F.col("y") >= F.col("t") - 2), F.col("v"))).alias("most_24"),
        F.max(F.when(F.col("y") < F.col("t"), F.struct("y", "v"))).alias("latest"),
    )
    whole = per_kind.groupBy("e", "t").agg(
        F.sum("n").alias("n_prior"), F.sum("last").alias("n_last"), F.max("most").alias("most"), F.max("most_24").alias("most_24"), F.max("latest").alias("latest"),
        F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("after").alias("after"),
    )
    every = small.select("e").distinct().withColumn("t", F.explode(F.array(*[F.lit(t) for t in years])))
    out = every.join(whole, ["e", "t"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        F.col("e").alias(entity), F.col("t").alias("year"), zero("n_prior").alias("n_prior"), zero("n_last").alias("n_last"), "most", "most_24", F.col("latest.v").alias("latest_most"),
        F.round(F.try_divide("squares", F.col("n_prior") * F.col("n_prior")), 6).alias("hhi"), F.coalesce((F.col("n_last") > 0).cast("int"), F.lit(0)).alias("lag"),
        (F.col("t") - F.col("latest.y")).alias("idle_years"), zero("after").alias("after"),
    )


def lift_in_strata(rows: DataFrame, stratum: str, signals: list[str], hit: str) -> DataFrame:
    """Per stratum and signal: rows, hits, rate with Wilson bounds, base rate, lift, and whether the bounds leave the base out."""
    named = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("on")) for s in signals])
    flat = rows.select(stratum, F.col(hit).alias("__h"), F.explode(named).alias("s"))
    n = flat.groupBy(stratum, "s.signal").agg(
        F.count_if("s.on").alias("n_signal"), F.count_if(F.col("s.on") & F.col("__h")).alias("n_hits"), F.count("*").alias("__n"), F.count_if("__h").alias("__b")
    )
    low, high = wilson(F.col("n_hits"), F.col("n_signal"))
    rate, base = F.try_divide("n_hits", "n_signal"), F.try_divide("__b", "__n")
    return n.select(
        stratum, "signal", "n_signal", "n_hits", F.round(rate, 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(base, 6).alias("base"),
        F.round(F.try_divide(rate, base), 6).alias("lift"), ((low > base) | (high < base)).alias("significant"),
    )


def verdict(lifts: DataFrame) -> DataFrame:
    """One row: comparisons, those with a lift above one, and those of them whose bounds leave the base out."""
    above = F.coalesce(F.col("lift") > 1, F.lit(False))
    return lifts.agg(F.count("*").alias("comparisons"), F.count_if(above).alias("above"), F.count_if(above & F.col("significant")).alias("significant"))


def _by_group(column: str, values: dict[object, float]) -> Column:
    """A number for each group; groups are few."""
    return F.coalesce(*[F.when(F.col(column) == F.lit(g), F.lit(float(v))) for g, v in values.items()], F.lit(0.0))


def fit_logits(rows: DataFrame, group: str, features: list[str], label: str, ridge: float = 1.0, rounds: int = 25, tolerance: float = 1e-8) -> dict[object, np.ndarray]:
    """Per group the weights (intercept first) of a logistic regression with a ridge on all but the intercept.

    Newton's method: a round is one aggregation of gradient and curvature for all groups at
    once, (d + 1)(d + 4) / 2 sums however many rows there are. Rows with a NULL feature or
    label are left out. A group whose labels are all alike still has weights, for the ridge.
    """
    d = len(features) + 1
    clean = rows.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [group, label, *features]]))
    cells = cut_lineage(clean.groupBy(group, *features, F.col(label).cast("int").alias("__y")).agg(F.count("*").alias("__c")))
    groups = sorted(r[0] for r in cells.select(group).distinct().collect())
    weights = {g: np.zeros(d) for g in groups}
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    for _ in range(rounds):
        eta = reduce(lambda a, b: a + b, [_by_group(group, {g: weights[g][j] for g in groups}) * x[j] for j in range(d)])
        held = cells.select(group, "__y", "__c", *[x[j].alias(f"__x{j}") for j in range(d)], (1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), eta))))).alias("__p"))
        slope = [F.sum(F.col("__c") * (F.col("__y") - F.col("__p")) * F.col(f"__x{j}")).alias(f"g{j}") for j in range(d)]
        bend = [F.sum(F.col("__c") * F.col("__p") * (1 - F.col("__p")) * F.col(f"__x{j}") * F.col(f"__x{k}")).alias(f"h{j}_{k}") for j in range(d) for k in range(j, d)]
        moved = 0.0
        for r in held.groupBy(group).agg(*slope, *bend).collect():
            w = weights[r[group]]
            hess = np.array([[r[f"h{min(j, k)}_{max(j, k)}"] for k in range(d)] for j in range(d)])
            grad = np.array([r[f"g{j}"] for j in range(d)])
            penalty = np.full(d, ridge)
            penalty[0] = 1e-9
            step = np.linalg.solve(hess + np.diag(penalty), grad - penalty * w)
            weights[r[group]] = w + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < tolerance:
            break
    return weights


def leave_one_out(panel: DataFrame, entity: str, year: str, features: list[str], label: str, size: str, top: int = 10, ridge: float = 1.0) -> DataFrame:
    """Per year: n, base rate, and the share of hits among the ``top`` by a fit on all other years and by ``size`` alone.

    Features are standardised by mean and deviation of the years fitted on, NULLs counting
    as zero; all years are fitted at once, a row taking part in the fits of the other years.
    Ties go to the smaller entity. A single year has nothing to be fitted on, so its rows
    are ranked by entity.
    """
    rows = cut_lineage(panel.select(entity, F.col(year).alias("__year"), F.col(size).alias("__size"), F.col(label).cast("int").alias("__hit"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]))
    years = sorted(r[0] for r in rows.select("__year").distinct().collect())
    others = rows.withColumn("__held", F.explode(F.array(*[F.lit(y) for y in years]))).where(F.col("__held") != F.col("__year"))
    spread = others.groupBy("__held").agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_samp(f).alias(f"s_{f}") for f in features]).collect()
    mean = {f: {r["__held"]: r[f"m_{f}"] for r in spread} for f in features}
    dev = {f: {r["__held"]: r[f"s_{f}"] or 1.0 for r in spread} for f in features}
    scaled = lambda f, by: (F.col(f) - _by_group(by, mean[f])) / F.greatest(_by_group(by, dev[f]), F.lit(1e-12)) if mean[f] else F.lit(0.0)
    weights = fit_logits(others.select("__held", "__hit", *[scaled(f, "__held").alias(f) for f in features]), "__held", features, "__hit", ridge) if spread else {}
    score = reduce(lambda a, b: a + b, [_by_group("__year", {g: w[j + 1] for g, w in weights.items()}) * scaled(f, "__year") for j, f in enumerate(features)], F.lit(0.0))
    ranked = rows.select("__year", entity, "__hit", "__size", F.round(score, 9).alias("__score"))
    total = ranked.groupBy("__year").agg(F.count("*").alias("n_rows"), F.round(F.avg("__hit"), 6).alias("base_rate"))
    out = total
    for name, by in (("by_fit", "__score"), ("by_size", "__size")):
        w = Window.partitionBy("__year").orderBy(F.col(by).desc_nulls_last(), entity)
        best = ranked.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= top)
        out = out.join(best.groupBy("__year").agg(F.round(F.avg("__hit"), 6).alias(name)), "__year", "left")
    return out.withColumnRenamed("__year", year)


def shuffle_control(rows: DataFrame, decided: str, truth: str, shuffles: int = 2000, seed: int = 1) -> DataFrame:
    """One row: n, accuracy, the mean accuracy under shuffled truths, and the share of shuffles that do as well.

    A shuffle matters only by how many of the truths fall to the rows decided for, so the
    rows are reduced to three counts and that number is drawn, ``shuffles`` times. Rows with
    a NULL are left out; no rows give NULLs.
    """
    n, yes, true, right = rows.where(F.col(decided).isNotNull() & F.col(truth).isNotNull()).agg(
        F.count("*"), F.count_if(F.col(decided)), F.count_if(F.col(truth)), F.count_if(F.col(decided) == F.col(truth))
    ).first()
    spark, shape = rows.sparkSession, "n long, accuracy double, mean_shuffled double, share_as_good double"
    if not n:
        return spark.createDataFrame([(0, None, None, None)], shape)
    # numpy draws from at most 10^9; counts beyond are as good as continuous.
    if n < 10**9:
        both = np.random.default_rng(seed).hypergeometric(true, n - true, yes, shuffles).astype(float)
    else:
        spread = np.sqrt(yes * (true / n) * (1 - true / n) * (n - yes) / (n - 1))
        both = np.round(np.random.default_rng(seed).normal(yes * true / n, spread, shuffles))
    accuracy = (n - yes - true + 2 * both) / n
    return spark.createDataFrame([(n, round(right / n, 6), round(float(accuracy.mean()), 6), round(float((accuracy >= right / n).mean()), 6))], shape)
