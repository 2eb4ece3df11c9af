"""Deterministic samples: what is drawn depends on ids and a seed, not on how rows are spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def draw_key(key: str, seed: int) -> Column:
    """A text by which rows are in random order for a seed; the same in other engines."""
    return F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")), 256)


def hash_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in random order; a bounded top-n, never a full sort."""
    return rows.withColumn("__d", draw_key(key, seed)).orderBy("__d", key).limit(n).drop("__d")


def bernoulli(rows: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Each row with the given chance, by its hash."""
    return rows.where(F.conv(F.substring(draw_key(key, seed), 1, 8), 16, 10).cast("bigint") < int(share * 2**32))


def round_robin(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows, one per stratum and pass, strata and rows in random order: with ``turn``, the pass."""
    w = Window.partitionBy(stratum).orderBy(draw_key(key, seed), key)
    few = rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)
    return few.withColumn("__s", draw_key(stratum, seed)).orderBy("turn", "__s", stratum).limit(n).drop("__s")


def per_outcome(rows: DataFrame, outcome: str, key: str, n: int, seed: int) -> DataFrame:
    """The first ``n`` rows of each outcome in random order."""
    w = Window.partitionBy(outcome).orderBy(draw_key(key, seed), key)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def matched_pairs(candidates: list[dict], caps: dict[str, int], n: int) -> list[dict]:
    """Greedy choice from candidates in their order: no unit twice, no value of a capped field too often.

    For the few thousand candidates that a query has prepared. A candidate has 'a' and
    'b', the units, and the capped fields.
    """
    used: set = set()
    seen: dict[tuple[str, object], int] = {}
    out = []
    for c in candidates:
        if len(out) == n:
            break
        if c["a"] in used or c["b"] in used or any(seen.get((f, c[f]), 0) >= most for f, most in caps.items()):
            continue
        used |= {c["a"], c["b"]}
        for f in caps:
            seen[f, c[f]] = seen.get((f, c[f]), 0) + 1
        out.append(c)
    return out
