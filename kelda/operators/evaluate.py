"""Evaluation: confusion, thresholds, comparisons of versions, lift, panels and frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from kelda.functions.stats import wilson
from kelda.operators.ranking import global_rank


def confusion(rows: DataFrame, expected: str, decided: str, group: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn, precision and recall with Wilson bounds; rows without an expectation are left out and counted."""
    e, d = F.col(expected), F.col(decided)
    n = rows.groupBy(*(group or [])).agg(
        F.count_if(e & d).alias("tp"), F.count_if(~e & d).alias("fp"), F.count_if(~e & ~d).alias("tn"), F.count_if(e & ~d).alias("fn"), F.count_if(e.isNull()).alias("unscored")
    )
    out = n
    for name, k, total in (("precision", F.col("tp"), F.col("tp") + F.col("fp")), ("recall", F.col("tp"), F.col("tp") + F.col("fn"))):
        low, high = wilson(k, total)
        out = out.withColumn(name, F.round(F.try_divide(k, total), 6)).withColumn(f"{name}_low", F.round(low, 6)).withColumn(f"{name}_high", F.round(high, 6))
    return out


def threshold_curve(rows: DataFrame, mass: str, truth: str, thresholds: list[float]) -> DataFrame:
    """Per threshold what is admitted, and precision and recall; one pass for all thresholds."""
    m, t = F.bround(F.col(mass), 2), F.col(truth)
    sums = [x for i, th in enumerate(thresholds) for x in (F.count_if(m >= th).alias(f"a{i}"), F.count_if((m >= th) & t).alias(f"h{i}"))]
    total = rows.agg(F.count_if(t).alias("p"), *sums)
    points = [F.struct(F.lit(float(th)).alias("threshold"), F.col(f"a{i}").alias("admitted"), F.col(f"h{i}").alias("hits"), F.round(F.try_divide(f"h{i}", "p"), 6).alias("recall"), F.round(F.try_divide(f"h{i}", f"a{i}"), 6).alias("precision")) for i, th in enumerate(thresholds)]
    return total.select(F.inline(F.array(*points)))


def histogram(rows: DataFrame, c: str, bins: int = 10) -> DataFrame:
    """Half-open bins of [0, 1], the last one closed; empty bins shown."""
    b = F.least(F.floor(F.col(c) * bins), F.lit(bins - 1)).cast("int")
    counted = rows.where(F.col(c).between(0, 1)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n_rows"))


def compare_versions(base: DataFrame, other: DataFrame, key: str, decided: str, expected: str) -> DataFrame:
    """Per kind of change how many rows: regression, recovered, newly admitted, newly rejected, unchanged."""
    b = base.select(key, F.col(decided).alias("__b"), F.col(expected).alias("__e"))
    both = b.join(other.select(key, F.col(decided).alias("__o")), key)
    e, x, y = F.col("__e"), F.col("__b"), F.col("__o")
    kind = (
        F.when(x == y, "unchanged").when(e.isNotNull() & (x == e) & (y != e), "regression").when(e.isNotNull() & (x != e) & (y == e), "recovered").when(y, "newly_admitted").otherwise("newly_rejected")
    )
    return both.groupBy(kind.alias("change")).agg(F.count("*").alias("n_rows"))


def discordant(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """The four counts of two yes-or-no answers, of which McNemar's test takes the discordant ones."""
    return rows.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))


def lift(rows: DataFrame, signals: list[str], hit: str) -> DataFrame:
    """Per signal how often a hit follows it, and over the base rate; a zero base gives NULL."""
    sums = [F.count("*").alias("n"), F.count_if(F.col(hit)).alias("h")]
    sums += [x for i, s in enumerate(signals) for x in (F.count_if(F.col(s)).alias(f"s{i}"), F.count_if(F.col(s) & F.col(hit)).alias(f"b{i}"))]
    total = rows.agg(*sums)
    rate = lambda a, b: F.try_divide(F.col(a), F.col(b))
    parts = [F.struct(F.lit(s).alias("signal"), F.col(f"s{i}").alias("n_signal"), F.col(f"b{i}").alias("n_hits"), F.round(rate(f"b{i}", f"s{i}"), 6).alias("rate"), F.round(F.try_divide(rate(f"b{i}", f"s{i}"), rate("h", "n")), 6).alias("lift")) for i, s in enumerate(signals)]
    return total.select(F.inline(F.array(*parts)))


def size_strata(rows: DataFrame, size: str, key: str, n: int = 3) -> DataFrame:
    """rows with ``stratum`` 0 to n - 1 by size, then key; remainders in the last."""
    ranked = global_rank(rows, [size, key], "__r")
    total = ranked.agg(F.count("*").alias("__n"))
    ranked = ranked.join(F.broadcast(total))
    return ranked.withColumn("stratum", F.least(F.floor((F.col("__r") - 1) / F.greatest(F.floor(F.col("__n") / n), F.lit(1))), F.lit(n - 1)).cast("int")).drop("__n", "__r")


def frame_cells(events: DataFrame, dims: list[str], day: str, first: str, last: str, ahead: int = 12) -> DataFrame:
    """Per cell (dims, month t0): events until t0, events after it within ``ahead`` months, and within as many before.

    Events are counted per cell and month of effect, each adding itself to the grid months
    it matters to by running sums; no event is compared with every month.
    """
    f, t = F.lit(first).cast("date"), F.lit(last).cast("date")
    cells = events.select(*dims).distinct().withColumn("t0", F.explode(F.sequence(f, t, F.expr("INTERVAL 1 MONTH"))))
    # The first grid month on or after an event's day: from there on the event is in the past.
    d = F.col(day)
    since = F.when(F.dayofmonth(d) == 1, d).otherwise(F.add_months(F.trunc(d, "month"), 1))
    daily = events.where(d.isNotNull()).groupBy(*dims, since.alias("m"), (F.dayofmonth(d) == 1).alias("on_first")).agg(F.count("*").alias("n"))
    # prior: d <= t0; after: t0 < d <= t0 + ahead; activity: t0 - ahead <= d < t0.
    steps = daily.select(
        *dims, "n",
        F.explode(F.array(
            F.struct(F.col("m").alias("t0"), F.lit("prior").alias("k"), F.lit(1).alias("s")),
            F.struct(F.add_months("m", -ahead).alias("t0"), F.lit("after").alias("k"), F.lit(1).alias("s")),
            F.struct(F.col("m").alias("t0"), F.lit("after").alias("k"), F.lit(-1).alias("s")),
            F.struct(F.when(F.col("on_first"), F.add_months("m", 1)).otherwise(F.col("m")).alias("t0"), F.lit("activity").alias("k"), F.lit(1).alias("s")),
            F.struct(F.when(F.col("on_first"), F.add_months("m", ahead + 1)).otherwise(F.add_months("m", ahead)).alias("t0"), F.lit("activity").alias("k"), F.lit(-1).alias("s")),
        )).alias("e"),
    )
    moved = steps.select(*dims, F.greatest("e.t0", f).alias("t0"), F.col("e.k").alias("k"), (F.col("n") * F.col("e.s")).alias("x")).where(F.col("t0") <= t)
    change = moved.groupBy(*dims, "t0").agg(*[F.sum(F.when(F.col("k") == k, F.col("x")).otherwise(0)).alias(k) for k in ("prior", "after", "activity")])
    w = Window.partitionBy(*dims).orderBy("t0").rowsBetween(Window.unboundedPreceding, 0)
    on = cells.join(change, [*dims, "t0"], "left")
    return on.select(*dims, "t0", *[F.coalesce(F.sum(k).over(w), F.lit(0)).alias(k) for k in ("prior", "after", "activity")])


def availability_mask(rows: DataFrame, groups: list[tuple[Column, list[str]]], at: Column) -> DataFrame:
    """rows with columns that weren't yet available at a date set to NULL; rows of which no group was are dropped.

    groups: (day from which they are available, their columns).
    """
    tests = [F.coalesce(day <= at, F.lit(False)) for day, _ in groups]
    out = rows.where(reduce(lambda a, b: a | b, tests))
    return out.withColumns({c: F.when(t, F.col(c)) for t, (_, cs) in zip(tests, groups) for c in cs})


def split_half(rows: DataFrame, key: str, mass: str, truth: str, threshold: float, splits: int = 50, seed: int = 1) -> DataFrame:
    """Per random half: split, recall and precision on it. Halves are told by a digest of key and split.

    One pass: a row adds itself to the half it is in, once a split, and counts are combined
    before the shuffle.
    """
    at = F.col(mass) >= threshold
    flags = rows.select(key, at.alias("__a"), F.col(truth).alias("__t"))
    half = flags.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    side = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("split").cast("string"), F.lit(str(seed)))), 1, 1), 16, 10).cast("int") < 8
    n = half.where(side).groupBy("split").agg(F.count_if("__a").alias("a"), F.count_if("__t").alias("t"), F.count_if(F.col("__a") & F.col("__t")).alias("h"))
    return n.select("split", F.round(F.try_divide("h", "t"), 6).alias("recall"), F.round(F.try_divide("h", "a"), 6).alias("precision"))
