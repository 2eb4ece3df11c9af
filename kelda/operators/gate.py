"""A score against a plain method at many thresholds, what it misses, what it costs; options and evidence around it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Thresholds at which a curve is drawn, and edges of the bins of masses.
THRESHOLDS = (0.005, 0.01, 0.02, 0.03, 0.04, *(round(0.05 * i, 2) for i in range(1, 20)))
MASS_BINS = (0.0, 0.001, 0.005, 0.01, 0.02, 0.05, 0.10, 0.25, 0.50, 1.0001)


def method_curve(rows: DataFrame, mass: str, truth: str, plain: str, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Per threshold: admitted, hits, recall, precision, and how the admitted meet those of a plain method: both, only_mass, only_plain, neither.

    One pass of conditional sums for all thresholds. A NULL mass admits nowhere; rows with a NULL truth count but hit nothing.
    """
    m, t, k = F.col(mass), F.coalesce(F.col(truth), F.lit(False)), F.coalesce(F.col(plain), F.lit(False))
    sums = [F.count_if(t).alias("p"), F.count("*").alias("n"), F.count_if(k).alias("k")]
    for i, th in enumerate(thresholds):
        on = F.coalesce(m >= th, F.lit(False))
        sums += [F.count_if(on).alias(f"a{i}"), F.count_if(on & t).alias(f"h{i}"), F.count_if(on & k).alias(f"b{i}")]
    total = rows.agg(*sums)
    c = F.col
    points = [
        F.struct(
            F.lit(float(th)).alias("threshold"), c(f"a{i}").alias("admitted"), c(f"h{i}").alias("hits"), F.round(F.try_divide(f"h{i}", "p"), 6).alias("recall"), F.round(F.try_divide(f"h{i}", f"a{i}"), 6).alias("precision"),
            c(f"b{i}").alias("both"), (c(f"a{i}") - c(f"b{i}")).alias("only_mass"), (c("k") - c(f"b{i}")).alias("only_plain"), (c("n") - c(f"a{i}") - c("k") + c(f"b{i}")).alias("neither"),
        )
        for i, th in enumerate(thresholds)
    ]
    return total.select(F.inline(F.array(*points)))


def mass_bin(mass: Column, edges: tuple[float, ...] = MASS_BINS) -> Column:
    """Lower edge of the half-open bin of a mass; NULL outside all of them."""
    return F.coalesce(*[F.when((mass >= a) & (mass < b), F.lit(float(a))) for a, b in zip(edges, edges[1:])])


def misses(rows: DataFrame, mass: str, truth: str, plain: str, threshold: float) -> DataFrame:
    """bin, missed, missed_by_both: true rows below the threshold by the bin of their mass, and those the plain method misses too."""
    lost = rows.where(F.coalesce(F.col(truth), F.lit(False)) & (F.col(mass) < threshold))
    return lost.groupBy(mass_bin(F.col(mass)).alias("bin")).agg(F.count("*").alias("missed"), F.count_if(~F.coalesce(F.col(plain), F.lit(False))).alias("missed_by_both"))


def corpus_budget(rows: DataFrame, passes: Column, mass: str, cost: str, population: int, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Per threshold the share of rows admitted among those that pass the other stages, what that makes of a population, and the cost in cents of the admitted."""
    ok = F.coalesce(passes, F.lit(False))
    sums = [F.count_if(ok).alias("n")]
    for i, th in enumerate(thresholds):
        on = ok & F.coalesce(F.col(mass) >= th, F.lit(False))
        sums += [F.count_if(on).alias(f"a{i}"), F.coalesce(F.sum(F.when(on, F.col(cost))), F.lit(0)).cast("bigint").alias(f"c{i}")]
    total = rows.agg(*sums)
    points = [F.struct(F.lit(float(th)).alias("threshold"), F.col(f"a{i}").alias("admitted"), F.round(F.try_divide(f"a{i}", "n"), 6).alias("rate"), F.round(F.try_divide(f"a{i}", "n") * population, 2).alias("expected"), F.col(f"c{i}").alias("cost")) for i, th in enumerate(thresholds)]
    return total.select(F.inline(F.array(*points)))


def option_list(codes: DataFrame, code: str, profile: list[str], carved: list[str], family: int = 4, segment: int = 2) -> DataFrame:
    """place, kind, option: what may be chosen, in a fixed order: the profile's entries, other families of their segments
    that occur among the codes and aren't carved out, the other segments, and 'none'."""
    segments = sorted({p[:segment] for p in profile})
    seen = codes.select(F.left(code, F.lit(family)).alias("f")).where(F.length("f") == family).distinct()
    taken = reduce(lambda a, b: a | b, [F.col("f").startswith(p[:family]) for p in [*profile, *carved]], F.lit(False))
    inside = F.left("f", F.lit(segment)).isin(segments) if segments else F.lit(False)
    siblings = seen.where(inside & ~taken).select(F.lit(2).alias("k"), F.lit("sibling").alias("kind"), F.col("f").alias("option"))
    others = seen.where(~inside).select(F.lit(3).alias("k"), F.lit("segment").alias("kind"), F.left("f", F.lit(segment)).alias("option")).distinct()
    fixed = codes.sparkSession.createDataFrame([*[(1, "profile", p) for p in sorted(profile)], (4, "none", "")], "k int, kind string, option string")
    return fixed.unionByName(siblings).unionByName(others).select(F.format_string("%d:%s", "k", "option").alias("place"), "kind", "option")


def nested_evidence(case: str, sources: list[tuple[str, DataFrame, str]], at: Column) -> DataFrame:
    """case, condition, source, n: evidence of every case by growing conditions, each with one source more than the one before.

    sources: (name, rows with the case's key, their day of availability). Only what was
    available by ``at`` counts; the rows are counted once a source and the counts are spread.
    """
    parts = []
    for i, (name, rows, day) in enumerate(sources):
        n = rows.where(F.col(case).isNotNull() & (F.col(day) <= at)).groupBy(case).agg(F.count("*").alias("n"))
        parts.append(n.withColumn("source", F.lit(name)).withColumn("condition", F.explode(F.array(*[F.lit(chr(65 + j)) for j in range(i, len(sources))]))))
    return reduce(DataFrame.unionByName, parts).select(case, "condition", "source", "n")


def leak_audit(rows: DataFrame, days: list[str], at: Column, absent: list[str]) -> DataFrame:
    """One row: rows, those with a day of availability after ``at`` (late), and suppressed columns that are there all the same."""
    late = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) > at, F.lit(False)) for c in days], F.lit(False))
    there = [c for c in absent if c in rows.columns]
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(late).alias("late")).withColumn("suppressed", F.lit(",".join(sorted(there))))
