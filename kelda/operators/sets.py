"""Sets of keys and append-only merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def new_since(now: DataFrame, before: DataFrame | None, key: str) -> DataFrame | None:
    """Keys of ``now`` that ``before`` lacks. Without a snapshot there is no answer (None), which differs from an empty one."""
    return None if before is None else now.select(key).distinct().join(before.select(key), key, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with which; one aggregation instead of two joins."""
    both = a.select(key, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(key, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    sides = both.groupBy(key).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b")).where("__a + __b = 1")
    return sides.select(key, F.when(F.col("__a") == 1, "left").otherwise("right").alias("side"))


def insert_absent(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of the batch to append: the first by ``order`` of each key that ``existing`` lacks. Nothing is updated.

    Rows with a NULL key are dropped, as they could never be found again.
    """
    whole = batch
    for k in keys:
        whole = whole.where(F.col(k).isNotNull())
    fresh = whole.join(existing.select(*keys), keys, "left_anti")
    w = Window.partitionBy(*keys).orderBy(*order)
    return fresh.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def nested(sets: DataFrame, group: str, level: str, item: str, levels: list[str]) -> DataFrame:
    """Per group whether each level's items are among the next one's: group, inner, outer, missing.

    Levels are flags of an item's one row, so nothing is compared pairwise.
    """
    flags = sets.groupBy(group, item).agg(*[F.max(F.when(F.col(level) == x, 1).otherwise(0)).alias(f"__{i}") for i, x in enumerate(levels)])
    pairs = list(zip(range(len(levels)), range(1, len(levels))))
    out = flags.groupBy(group).agg(*[F.count_if((F.col(f"__{a}") == 1) & (F.col(f"__{b}") == 0)).alias(f"m{a}") for a, b in pairs])
    return out.select(group, F.inline(F.array(*[F.struct(F.lit(levels[a]).alias("inner"), F.lit(levels[b]).alias("outer"), F.col(f"m{a}").alias("missing")) for a, b in pairs])))


def key_changes(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change of a full outer comparison: added, removed, changed or same."""
    both = old.select(key, F.col(digest).alias("__o")).join(new.select(key, F.col(digest).alias("__n")), key, "full_outer")
    change = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(F.col("__o") != F.col("__n"), "changed").otherwise("same")
    return both.select(key, change.alias("change"))


def fingerprint(rows: DataFrame, key: str) -> DataFrame:
    """n_rows and an order-free digest of the keys, by sums of hash halves: combinable, nothing is sorted or collected."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return rows.agg(F.count("*").alias("n_rows"), F.sum(h).alias("digest"))
