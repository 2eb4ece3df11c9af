"""Version histories as a per-attribute change log.

1. ``version_order`` places every version of an entity.
2. ``in_force`` turns placed versions into periods in which each was in force.
3. ``change_log`` writes, per attribute, the intervals in which its value stood.
4. ``combine`` splits at the union of the attributes' boundary days and coalesces.

Before anything is sorted per entity its rows are reduced to one per calendar day, in a
combinable aggregation, so that an entity holding a third of all rows stays a small group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from kelda.session import cut_lineage


def _greatest_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key that is greatest by ``order``, then by all its columns."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    picked = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order, row)).alias("__row"))
    return picked.select(*keys, *[F.col("__row").getField(c).alias(c) for c in rest])


def latest_delivery(df: DataFrame, key: str, delivered: str) -> DataFrame:
    """One row per ``key``: the latest by ``delivered`` (NULL first), ties by all columns.

    Rows without a key are dropped, as nothing can be said of which version they are.
    """
    return _greatest_row(df.where(F.col(key).isNotNull()), [key], [F.col(delivered)])


def version_order(df: DataFrame, id_col: str, seq: str, prev: str) -> DataFrame:
    """df with ``__pos`` (double), the place of each version among those of its entity.

    That is ``seq``; where it is NULL, right after the version that ``prev`` names (through
    any number of versions that lack a number too); where that one is unknown, right before
    the version that names this one as its predecessor; else before all others. Chains of
    unnumbered versions are followed by pointer doubling over those versions alone, which
    ends after log2(longest chain) rounds; versions in a circle come before all others.
    """
    numbered = df.where(F.col(seq).isNotNull()).withColumn("__pos", F.col(seq).cast("double"))
    blank = df.where(F.col(seq).isNull())
    link = blank.select(F.col(id_col).alias("__id"), F.col(prev).alias("__to"), F.lit(1).alias("__n"))
    chained = blank.select(F.col(prev).alias(id_col)).join(blank.select(id_col), id_col, "left_semi")
    if not chained.isEmpty():
        rounds, most = 0, max(1, blank.count()).bit_length() + 1
        link = cut_lineage(link)
        while rounds < most:
            on = link.select(F.col("__id").alias("__to"), F.col("__to").alias("__to2"), F.col("__n").alias("__n2"))
            moved = cut_lineage(link.join(on, "__to", "left"))
            if moved.where(F.col("__n2").isNotNull()).isEmpty():
                break
            link = moved.select("__id", F.when(F.col("__n2").isNotNull(), F.col("__to2")).otherwise(F.col("__to")).alias("__to"), (F.col("__n") + F.coalesce("__n2", F.lit(0))).alias("__n"))
            rounds += 1
    places = numbered.select(F.col(id_col).alias("__to"), F.col("__pos").alias("__at"))
    after = link.join(places, "__to", "inner").select(F.col("__id").alias(id_col), (F.col("__at") + 1 - F.pow(F.lit(2.0), -F.col("__n"))).alias("__after"))
    before = (
        numbered.where(F.col(prev).isNotNull())
        .select(F.col(prev).alias(id_col), "__pos")
        .join(blank.select(id_col), id_col, "left_semi")
        .groupBy(id_col)
        .agg((F.min("__pos") - 0.5).alias("__before"))
    )
    placed = blank.join(after, id_col, "left").join(before, id_col, "left")
    placed = placed.withColumn("__pos", F.coalesce("__after", "__before", F.lit(float("-inf")))).drop("__after", "__before")
    return numbered.unionByName(placed)


def in_force(df: DataFrame, entity: list[str], pos: str, start: str, end: str) -> DataFrame:
    """Rows of df in force at some time, with ``__from`` and ``__to`` (DATE, ``__to`` excluded, NULL: open).

    From its ``start`` on a version replaces all of lower ``pos``. It stands until its
    ``end`` (ignored if before ``start`` or NULL) or the earliest start of a later version.
    Of the versions with one start only the last can stand, so the others are dropped in a
    combinable aggregation first; that leaves at most one row per entity and day.
    Versions without a start or entity are never in force.
    """
    known = df.where(F.col(start).isNotNull())
    known = reduce(lambda d, k: d.where(F.col(k).isNotNull()), entity, known)
    daily = _greatest_row(known, [*entity, start], [F.col(pos)])
    later = Window.partitionBy(*entity).orderBy(F.col(pos).desc(), F.col(start).desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = daily.withColumn("__next", F.min(start).over(later))
    own = F.when(F.col(end) >= F.col(start), F.col(end))
    out = out.withColumn("__from", F.col(start)).withColumn("__to", F.least(own, F.col("__next")))
    return out.where(F.col("__to").isNull() | (F.col("__from") < F.col("__to"))).drop("__next")


def change_log(periods: DataFrame, entity: list[str], attributes: list[str]) -> DataFrame:
    """Per attribute the intervals in which its value stood: entity, attribute, value, valid_from, valid_to.

    ``periods`` has disjoint ``__from``/``__to`` per entity. Values are compared and given
    as strings, NULL being a value; a period after a break starts a new interval.
    """
    order = Window.partitionBy(*entity).orderBy("__from")
    flagged = periods.select(
        *entity,
        "__from",
        "__to",
        F.coalesce(F.lag("__to").over(order) != F.col("__from"), F.lit(True)).alias("__broken"),
        *[F.col(a).cast("string").alias(a) for a in attributes],
        *[F.lag(F.struct(F.col(a).cast("string").alias("v"))).over(order).alias(f"__was_{i}") for i, a in enumerate(attributes)],
    )
    entries = [
        F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value"), (F.col("__broken") | ~F.col(a).eqNullSafe(F.col(f"__was_{i}.v"))).alias("starts"))
        for i, a in enumerate(attributes)
    ]
    rows = flagged.select(*entity, "__from", "__to", F.explode(F.array(*entries)).alias("__x"))
    run = Window.partitionBy(*entity, "attribute").orderBy("__from")
    marked = rows.select(*entity, "__from", "__to", F.col("__x.attribute").alias("attribute"), F.col("__x.value").alias("value"), F.col("__x.starts").alias("__starts"))
    marked = marked.withColumn("__since", F.max(F.when(F.col("__starts"), F.col("__from"))).over(run))
    return marked.groupBy(*entity, "attribute", F.col("__since").alias("valid_from")).agg(
        F.max_by("value", F.col("__from")).alias("value"), F.max_by("__to", F.col("__from")).alias("valid_to")
    )


def combine(log: DataFrame, entity: list[str], attributes: list[str]) -> DataFrame:
    """The wide history of a change log: entity, attributes, valid_from, valid_to (NULL: open).

    Each interval is an event that sets its attribute on its first day and one that clears
    it on the day it ends. Events of a day are put together (a set beats a clear), every
    attribute's last event is carried forward over the union of boundary days, and
    neighbouring segments with equal values become one.
    """
    sets = F.struct(F.col("valid_from").alias("day"), F.lit(1).alias("on"), F.col("value").alias("v"))
    clears = F.struct(F.col("valid_to").alias("day"), F.lit(0).alias("on"), F.lit(None).cast("string").alias("v"))
    events = log.select(*entity, "attribute", F.explode(F.when(F.col("valid_to").isNull(), F.array(sets)).otherwise(F.array(sets, clears))).alias("__e"))
    names = [f"__a{i}" for i in range(len(attributes))]
    event = F.struct(F.col("__e.on").alias("on"), F.col("__e.v").alias("v"))
    days = events.groupBy(*entity, F.col("__e.day").alias("__day")).agg(
        *[F.max(F.when(F.col("attribute") == a, event)).alias(n) for a, n in zip(attributes, names)]
    )
    order = Window.partitionBy(*entity).orderBy("__day")
    state = days.select(*entity, "__day", F.struct(*[F.last(n, ignorenulls=True).over(order).alias(n) for n in names]).alias("__state"))
    # A boundary at which no attribute's state changes is no boundary of the combined history.
    changed = state.withColumn("__was", F.lag("__state").over(order)).where(~F.col("__state").eqNullSafe(F.col("__was")))
    spans = changed.withColumn("__end", F.lead("__day").over(order))
    alive = reduce(lambda a, b: a | b, [F.col(f"__state.{n}.on") == 1 for n in names])
    return spans.where(alive).select(
        *entity, *[F.col(f"__state.{n}.v").alias(a) for a, n in zip(attributes, names)], F.col("__day").alias("valid_from"), F.col("__end").alias("valid_to")
    )


def version_history(df: DataFrame, entity: list[str], id_col: str, pos: str, start: str, end: str, attributes: list[str]) -> DataFrame:
    """History of the attributes with the first version of each stretch: entity, id, attributes, valid_from, valid_to.

    Defined cases: NULL attribute values are values; ties of ``pos`` on one day go to the
    row greatest by all its columns, else to the later start; an empty input gives no rows.
    """
    # Read by the change log and for the first version of each stretch.
    periods = cut_lineage(in_force(df, entity, pos, start, end))
    wide = combine(change_log(periods, entity, attributes), entity, attributes)
    first = periods.select(*entity, F.col("__from").alias("valid_from"), id_col)
    return wide.join(first, [*entity, "valid_from"], "inner")
