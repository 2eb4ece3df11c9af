"""Ranks over all rows, or within few large classes, without one task that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kelda.session import cut_lineage, shuffle_partitions


def global_rank(rows: DataFrame, order: list[str | Column], rank: str = "rank", partitions: int | None = None) -> DataFrame:
    """rows with ``rank`` from 1 by ``order``, which must end in something unique.

    Rows are cut into ranges of the order and sorted inside them; a row's rank is its place
    in its range behind the sizes of the ranges before, of which there is one a partition.
    The ranges are written, as another run might cut them elsewhere. No range grows with a
    class of equal values, as the order tells all rows apart. Empty rows stay empty.
    """
    n = partitions or shuffle_partitions(rows.sparkSession)
    cut = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # The id of a row is its partition in the upper bits and its place in it below.
    placed = cut_lineage(cut.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count("*").alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    out = placed.withColumn("__p", part).join(F.broadcast(offsets), "__p")
    return out.withColumn(rank, F.col("__o") + (F.col("__id") - F.shiftleft("__p", 33)) + 1).drop("__p", "__o", "__id")


def rank_within(rows: DataFrame, classes: list[str], order: list[str | Column], rank: str = "rank") -> DataFrame:
    """rows with ``rank`` from 1 within their class and ``class_size``, for few classes that may be large."""
    every = global_rank(rows, [*classes, *order], "__g")
    first = every.groupBy(*classes).agg(F.min("__g").alias("__f"), F.count("*").alias("class_size"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in classes]
    cond = same[0]
    for x in same[1:]:
        cond = cond & x
    kept = [F.col(f"a.{c}") for c in rows.columns]
    return every.alias("a").join(F.broadcast(first.alias("b")), cond).select(*kept, (F.col("a.__g") - F.col("b.__f") + 1).alias(rank), F.col("b.class_size"))


def upper_medians(rows: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """keys, ``out``: the value at position n // 2 of each group's sorted values, NULLs and NaNs left out; groups of none have no row.

    Equal values are counted before the shuffle. Of the different ones a group's bands, each
    a 64th of an octave, tell in which the median lies, and only the values of that band are
    put in order: a group that holds a third of all rows brings some thousand bands and one
    of them to a task. NULL keys have no row.
    """
    v = F.col(value).cast("double")
    names = keys or ["__all"]
    held = rows.where(F.col(value).isNotNull() & ~F.isnan(v)).withColumns({"__all": F.lit(0), "__band": F.signum(v) * F.floor(F.log2(1 + F.abs(v)) * 64)})
    counts = cut_lineage(held.groupBy(*names, "__band", value).agg(F.count("*").alias("__n")))
    whole = Window.partitionBy(*names)
    bands = counts.groupBy(*names, "__band").agg(F.sum("__n").alias("__c"))
    placed = bands.withColumns({"__upto": F.sum("__c").over(whole.orderBy("__band")), "__at": F.floor(F.sum("__c").over(whole) / 2)})
    hit = placed.where((F.col("__upto") > F.col("__at")) & (F.col("__upto") - F.col("__c") <= F.col("__at")))
    hit = hit.select(*names, "__band", (F.col("__at") - F.col("__upto") + F.col("__c")).alias("__skip"))
    inside = counts.join(hit, [*names, "__band"]).withColumn("__upto", F.sum("__n").over(whole.orderBy(value)))
    return inside.where((F.col("__upto") > F.col("__skip")) & (F.col("__upto") - F.col("__n") <= F.col("__skip"))).select(*keys, F.col(value).alias(out))
