"""Facts with children: semi-joins, nesting, coverage, versions as of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def having(facts: DataFrame, children: DataFrame, key: str, *tests: Column) -> DataFrame:
    """Facts for which, per test, some child passes it: one left-semi join a test, so facts are never multiplied."""
    out = facts
    for t in tests:
        out = out.join(children.where(t).select(key), key, "left_semi")
    return out


def nest(facts: DataFrame, children: DataFrame, key: str, name: str, fields: list[str]) -> DataFrame:
    """facts with ``name``: the sorted array of their children's fields, empty without any.

    Meant for a page of facts: children are cut to the page's keys before they are
    collected, so an array holds one fact's children.
    """
    page = children.join(facts.select(key).distinct(), key, "left_semi")
    packed = page.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    empty = F.array().cast(packed.schema[name].dataType)
    return facts.join(packed, key, "left").withColumn(name, F.coalesce(name, empty))


def in_force_at(versions: DataFrame, start: str, end: str, at: Column) -> DataFrame:
    """Versions with start <= at < end; a NULL end is open, a NULL start is never in force."""
    return versions.where((F.col(start) <= at) & (F.col(end).isNull() | (at < F.col(end))))


def in_force_grid(versions: DataFrame, start: str, end: str, first: str, last: str, months: int = 1) -> DataFrame:
    """Per date of a monthly grid the versions in force, as ``as_of`` beside their columns.

    A version is exploded over the grid dates it covers: no theta join, and rows in
    proportion to what is in force.
    """
    f, t = F.lit(first).cast("date"), F.lit(last).cast("date")
    from_ = F.greatest(F.col(start), f)
    to = F.least(F.coalesce(F.date_sub(F.col(end), 1), t), t)
    skip = F.ceil(F.months_between(from_, f) / months).cast("int") * months
    begin = F.add_months(f, skip)
    begin = F.when(begin < from_, F.add_months(f, skip + months)).otherwise(begin)
    covered = versions.where(F.col(start).isNotNull()).withColumn("__b", begin).withColumn("__e", to).where("__b <= __e")
    return covered.withColumn("as_of", F.explode(F.sequence("__b", "__e", F.expr(f"INTERVAL {months} MONTH")))).drop("__b", "__e")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children without a parent."""
    return children.join(parents.select(key), key, "left_anti")
