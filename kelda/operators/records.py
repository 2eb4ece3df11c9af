"""Operators on records with parents, reviewers, attestations and queues."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kelda.operators.sampling import draw_key


def suggestions(names: DataFrame, name: str, known: list[str], n: int = 3, cutoff: float = 0.5) -> DataFrame:
    """name, rank, suggestion: the nearest of a list for every different name, by edit distance over the longer length.

    The list is an array in the expression, so nothing is joined; it must be short (10,000
    at most). Names like none to ``cutoff`` have no row; NULL names none at all.
    """
    if len(known) > 10_000:
        raise ValueError("the list is too long to hold in an expression")
    every = F.array(*[F.lit(k) for k in sorted(set(known))]) if known else F.array().cast("array<string>")
    distinct = names.select(name).where(F.col(name).isNotNull()).distinct()

    def score(k: Column) -> Column:
        longest = F.greatest(F.length(k), F.length(F.col(name)), F.lit(1))
        return F.struct((-F.round(1 - F.levenshtein(F.lower(F.col(name)), F.lower(k)) / longest, 6)).alias("s"), k.alias("k"))

    best = F.slice(F.array_sort(F.filter(F.transform(every, score), lambda x: -x["s"] >= cutoff)), 1, n)
    return distinct.select(name, F.posexplode(best).alias("rank", "x")).select(name, (F.col("rank") + 1).alias("rank"), F.col("x.k").alias("suggestion"))


def merge_attestations(stored: DataFrame, observed: DataFrame, keys: list[str], count: str, today: str) -> DataFrame:
    """keys, count, first_seen, last_seen, live: an observed row refreshes its count and last day, a stored one that
    wasn't observed is carried on, and none is dropped; the first day stays."""
    a = stored.select(*keys, F.col(count).alias("__c"), "first_seen", "last_seen")
    b = observed.groupBy(*keys).agg(F.sum(count).alias("__n"))
    out = a.join(b, keys, "full_outer")
    live = F.col("__n").isNotNull()
    return out.select(
        *keys, F.coalesce("__n", "__c").alias(count), F.coalesce("first_seen", F.lit(today)).alias("first_seen"), F.when(live, F.lit(today)).otherwise(F.col("last_seen")).alias("last_seen"), live.alias("live")
    )


def inherit(children: DataFrame, child: str, parents: DataFrame, parent: str, tiers: list[tuple[str, str, str]], value: str) -> DataFrame:
    """child, parent, method, n_parents, value: what children have from the parents that they share a key with.

    A tier is (method, array column of the children, column of the parents); the first tier
    that finds any parent counts. ``value`` is the parent's, and NULL where there are several.
    """
    left, found = children, []
    for method, many, one in tiers:
        keyed = left.select(child, F.explode(F.array_distinct(many)).alias("__k")).where(F.col("__k").isNotNull())
        hit = keyed.join(parents.where(F.col(one).isNotNull()).select(F.col(one).alias("__k"), parent, value), "__k").select(child, parent, value).distinct()
        found.append(hit.withColumn("method", F.lit(method)))
        left = left.join(hit.select(child).distinct(), child, "left_anti")
    edges = reduce(DataFrame.unionByName, found)
    n = edges.groupBy(child).agg(F.countDistinct(parent).alias("n_parents"))
    return edges.join(n, child).select(child, parent, "method", "n_parents", F.when(F.col("n_parents") == 1, F.col(value)).alias(value))


def first_reviews(reviews: DataFrame, item: str, reviewer: str, order: list[str], verdict: str, spoiled: DataFrame | None = None) -> DataFrame:
    """item, reviewer, verdict: the first verdict of each reviewer on each item, spoiled items left out."""
    kept = reviews if spoiled is None else reviews.join(spoiled.select(item).distinct(), item, "left_anti")
    return kept.groupBy(item, reviewer).agg(F.min_by(verdict, F.struct(*order)).alias(verdict))


def agreement(first: DataFrame, item: str, reviewer: str, verdict: str, stratum: DataFrame, by: str) -> DataFrame:
    """reviewer, stratum: items judged, and how many of them as most of all reviewers did (a tie agrees with none).

    Verdicts are counted per item and joined back, so that reviewers are never paired."""
    votes = first.groupBy(item, verdict).agg(F.count("*").alias("__v"))
    top = votes.groupBy(item).agg(F.max(F.struct("__v", verdict)).alias("__t"), F.max("__v").alias("__m"), F.sum("__v").alias("__n"))
    tied = votes.join(top, item).groupBy(item).agg(F.count_if(F.col("__v") == F.col("__m")).alias("__ties"), F.first("__t").alias("__t"))
    whole = first.join(tied, item).join(stratum.select(item, by).distinct(), item)
    agrees = (F.col("__ties") == 1) & (F.col(f"__t.{verdict}") == F.col(verdict))
    return whole.groupBy(reviewer, by).agg(F.count("*").alias("n_items"), F.count_if(agrees).alias("n_agree"))


def flag_queue(flags: DataFrame, pool: DataFrame, done: DataFrame, key: str, day: str, n: int, seed: int) -> DataFrame:
    """key, is_flag, place: the ``n`` oldest flags not yet judged and as many controls, shuffled by a digest.

    Where there are fewer flags or controls than ``n``, as many of both as the scarcer has,
    so that a queue never tells by its mix.
    """
    open_flags = flags.join(done.select(key), key, "left_anti").orderBy(day, key).limit(n).select(key)
    controls = pool.join(flags.select(key), key, "left_anti").join(done.select(key), key, "left_anti").withColumn("__d", draw_key(key, seed)).orderBy("__d", key).limit(n).select(key)
    both = min(open_flags.count(), controls.count())
    mixed = open_flags.limit(both).withColumn("is_flag", F.lit(True)).unionByName(controls.limit(both).withColumn("is_flag", F.lit(False)))
    return mixed.select(key, "is_flag", F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}:place")), 256).alias("place"))


def frozen_digest(values: object) -> str:
    """A digest of rules, lists or questions that must not change unseen."""
    return hashlib.sha256(json.dumps(values, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def check_frozen(name: str, values: object, digest: str) -> None:
    """Raises where frozen values are no longer those that a digest was taken of."""
    if frozen_digest(values) != digest:
        raise ValueError(f"{name} has changed since it was frozen")
