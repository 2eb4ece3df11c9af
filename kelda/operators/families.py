"""Contract families: rows of one procurement seen as one contract, and what is asked of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kelda.operators.ranking import upper_medians
from kelda.session import cut_lineage


def families(rows: DataFrame, key: list[str], value: str, maxima: list[str], show: list[str], order: list[str]) -> DataFrame:
    """One row per family: greatest ``value``, greatest of each of ``maxima``, and ``show`` of its greatest row.

    The row shown is the greatest by value, then by ``order``, NULLs lowest, so it doesn't
    depend on how rows are spread. Combinable: hot families are reduced before the shuffle.
    """
    rank = F.struct(F.col(value), *[F.col(c) for c in order], *[F.col(c) for c in show])
    picked = rows.groupBy(*key).agg(
        F.max(value).alias(value),
        *[F.max(c).alias(f"max_{c}") for c in maxima],
        F.max_by(F.struct(*show), rank).alias("__shown"),
        F.count("*").alias("n_rows"),
    )
    return picked.select(*key, value, *[f"max_{c}" for c in maxima], "n_rows", *[F.col(f"__shown.{c}").alias(c) for c in show])


def expiring(rows: DataFrame, key: str, value: str, ends: str, first: str, last: str, least: float, most: int = 40) -> DataFrame:
    """Families whose latest end lies in [first, last] and whose greatest value is at least ``least``, soonest first."""
    agg = rows.groupBy(key).agg(F.max(ends).alias("expiry"), F.max(value).alias("max_value"), F.count("*").alias("n_rows"))
    kept = agg.where(F.col("expiry").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & (F.col("max_value") >= least))
    return kept.orderBy("expiry", F.col("max_value").desc(), key).limit(most)


def nested_totals(rows: DataFrame, group: str, family: str, value: str, most: int) -> DataFrame:
    """Per group the number and total of its families, each counted at its greatest value; greatest totals first."""
    per_family = rows.groupBy(group, family).agg(F.max(value).alias("v"))
    return (
        per_family.groupBy(group).agg(F.count("*").alias("n_families"), F.round(F.sum("v"), 2).alias("total"))
        .orderBy(F.col("total").desc(), group).limit(most)
    )


def share_floor(rows: DataFrame, bucket: str, family: str, value: str, least_share: float) -> DataFrame:
    """Buckets that hold at least a share of all families, with totals and upper medians.

    The grand total is one row, joined to the buckets.
    """
    per_family = cut_lineage(rows.where(F.col(bucket).isNotNull()).groupBy(bucket, family).agg(F.max(value).alias("v")))
    buckets = per_family.groupBy(bucket).agg(F.count("*").alias("n_families"), F.round(F.sum("v"), 2).alias("total")).join(upper_medians(per_family, [bucket], "v", "median_value"), bucket, "left")
    whole = buckets.agg(F.sum("n_families").alias("all_families"))
    return buckets.join(F.broadcast(whole)).where(F.col("n_families") >= least_share * F.col("all_families")).drop("all_families")


def counts_with_zeros(asked: DataFrame, rows: DataFrame, key: str, name: str = "n_rows") -> DataFrame:
    """Every asked key with the number of its rows, zeros included; repeated keys come out once."""
    counted = rows.groupBy(key).agg(F.count("*").alias("__n"))
    return asked.select(key).distinct().join(counted, key, "left").select(key, F.coalesce("__n", F.lit(0)).alias(name))


def mix(rows: DataFrame, group: list[str], tests: dict[str, Column]) -> DataFrame:
    """Per group how many rows pass each test; NULL passes none, and zeros are shown."""
    return rows.groupBy(*group).agg(*[F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()], F.count("*").alias("n_rows"))
