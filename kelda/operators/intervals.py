"""Continuous periods and gaps out of overlapping day intervals.

The rows of an entity are first reduced to one per start day (the latest end wins), in
the map-side combine of that aggregation. A period depends on nothing else, so this is
exact, and it bounds the rows any entity brings to the sort by the number of calendar
days its starts span: an entity that holds a third of all rows no longer makes a large task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Periods and gaps per entity: ``keys``, kind, first_day, last_day (DATE, both included).

    ``start`` and ``end`` are DATE columns; both days belong to an interval, and intervals
    on adjoining days make one period. kind 'period' is a longest run of covered days, kind
    'gap' a run of uncovered days between two periods of one entity.

    Defined cases: rows with a NULL key, start or end, and reversed ones, cover nothing;
    an empty string is a key like any other; repeated and tied rows change nothing; an
    empty input gives no rows; other columns, whatever their names, are ignored.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    spans = df.select(
        *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.col(f"`{start}`").alias("__s"), F.col(f"`{end}`").alias("__e")
    ).where(F.col("__s") <= F.col("__e"))
    for n in names:
        spans = spans.where(F.col(n).isNotNull())
    starts = spans.groupBy(*names, "__s").agg(F.max("__e").alias("__e"))
    by_start = Window.partitionBy(*names).orderBy("__s")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    reach = starts.withColumn("__reach", F.max("__e").over(before))
    opens = F.col("__reach").isNull() | (F.col("__s") > F.date_add("__reach", 1))
    islands = reach.withColumn("__island", F.sum(F.when(opens, 1).otherwise(0)).over(by_start))
    # The reach before an island's first row is the smallest in it, as the reach never falls.
    merged = islands.groupBy(*names, "__island").agg(
        F.min("__s").alias("__s"), F.max("__e").alias("__e"), F.min("__reach").alias("__reach")
    )
    period = F.struct(F.lit("period").alias("kind"), F.col("__s").alias("a"), F.col("__e").alias("b"))
    gap = F.struct(F.lit("gap").alias("kind"), F.date_add("__reach", 1).alias("a"), F.date_sub("__s", 1).alias("b"))
    out = merged.select(
        *names, F.explode(F.when(F.col("__island") > 1, F.array(period, gap)).otherwise(F.array(period))).alias("__r")
    )
    return out.select(
        *[F.col(n).alias(k) for k, n in zip(keys, names)],
        F.col("__r.kind").alias("kind"),
        F.col("__r.a").alias("first_day"),
        F.col("__r.b").alias("last_day"),
    )
