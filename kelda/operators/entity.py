"""Names resolved without guessing: exact after normalisation, ambiguity refused."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def resolve_exact(names: DataFrame, name: str, registry: DataFrame, key: str, spelling: str) -> DataFrame:
    """Distinct ``name`` with ``key`` and ``state``: resolved, ambiguous (several keys; NULL key) or unresolved.

    Both sides are given normalised. The registry is reduced to one row per spelling first,
    so a name is never multiplied.
    """
    known = registry.where(F.col(spelling) != "").groupBy(F.col(spelling).alias("__s")).agg(F.min(key).alias("__k"), F.countDistinct(key).alias("__n"))
    out = names.select(name).distinct().join(known, F.col(name) == F.col("__s"), "left")
    state = F.when(F.col("__n").isNull(), "unresolved").when(F.col("__n") > 1, "ambiguous").otherwise("resolved")
    return out.select(name, F.when(F.col("__n") == 1, F.col("__k")).alias(key), state.alias("state"))


def crosswalk(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tiers: list[tuple[str, str]]) -> DataFrame:
    """left_id, right_id, tier of a staged one-to-one match, then both unmatched sides (tier NULL).

    A tier pairs rows whose keys are equal where exactly one unclaimed row of each side has
    the key; claimed rows leave the later tiers. Rows with a NULL or empty key wait.
    """
    l, r, found = left, right, []
    for n, (a, b) in enumerate(tiers, 1):
        one = lambda df, i, k: df.where(F.col(k) != "").groupBy(F.col(k).alias("__k")).agg(F.min(i).alias(i), F.countDistinct(i).alias("__n")).where("__n = 1").drop("__n")
        pairs = one(l, left_id, a).join(one(r, right_id, b), "__k").select(left_id, right_id, F.lit(n).alias("tier"))
        # A row with several keys of one tier may pair once only: the smallest partner stays.
        pairs = pairs.groupBy(left_id).agg(F.min(right_id).alias(right_id), F.min("tier").alias("tier"))
        pairs = pairs.groupBy(right_id).agg(F.min(left_id).alias(left_id), F.min("tier").alias("tier")).select(left_id, right_id, "tier")
        found.append(pairs)
        l, r = l.join(pairs.select(left_id), left_id, "left_anti"), r.join(pairs.select(right_id), right_id, "left_anti")
    none = F.lit(None)
    types = dict(left.dtypes) | dict(right.dtypes)
    found.append(l.select(left_id).distinct().select(left_id, none.cast(types[right_id]).alias(right_id), none.cast("int").alias("tier")))
    found.append(r.select(right_id).distinct().select(none.cast(types[left_id]).alias(left_id), right_id, none.cast("int").alias("tier")))
    return reduce(DataFrame.unionByName, found)


def longest_prefix(codes: DataFrame, code: str, options: DataFrame, option: str, lengths: list[int]) -> DataFrame:
    """codes with ``option``: the longest option that the code starts with, by one equi-join a length."""
    out = codes
    for n in lengths:
        part = options.where(F.length(option) == n).select(F.col(option).alias(f"__o{n}")).distinct()
        out = out.join(part, F.left(code, F.lit(n)) == F.col(f"__o{n}"), "left")
    best = F.coalesce(*[F.col(f"__o{n}") for n in sorted(lengths, reverse=True)])
    return out.select(*codes.columns, best.alias(option))


def prefix_collisions(names: DataFrame, name: str, least: int = 1) -> DataFrame:
    """Pairs of different names that share at least ``least`` leading words: name_a, name_b, shared.

    Joined on the leading words themselves; for short lists of names, as the pairs are the result.
    """
    words = names.select(name).distinct().withColumn("__w", F.split(F.lower(name), " "))
    keyed = words.withColumn("__k", F.array_join(F.slice("__w", 1, least), " ")).where(F.size("__w") >= least)
    a = keyed.select(F.col(name).alias("name_a"), F.col("__w").alias("__a"), "__k")
    b = keyed.select(F.col(name).alias("name_b"), F.col("__w").alias("__b"), "__k")
    same = F.aggregate(F.arrays_zip("__a", "__b"), F.lit(0), lambda n, p: F.when((n >= 0) & p["__a"].eqNullSafe(p["__b"]), n + 1).when(n >= 0, -n - 1).otherwise(n))
    shared = F.when(same >= 0, same).otherwise(-same - 1)
    return a.join(b, "__k").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b", shared.alias("shared"))


def prefix_classes(names: DataFrame, name: str, least: int = 1) -> DataFrame:
    """name, prefix, n_names, first: each different name with the leading words it shares and how many names do.

    A row per name, so that names of one common word don't make all their pairs; counts are
    combined before the shuffle. Shorter and NULL names have no class."""
    words = names.select(name).where(F.col(name).isNotNull()).distinct().withColumn("__w", F.split(F.lower(name), " ")).where(F.size("__w") >= least)
    keyed = words.select(name, F.array_join(F.slice("__w", 1, least), " ").alias("prefix"))
    return keyed.join(keyed.groupBy("prefix").agg(F.count("*").alias("n_names"), F.min(name).alias("first")).where("n_names > 1"), "prefix")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key by ``order``, which must end in something unique."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def attribute(primary: DataFrame, secondary: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, value, source: values of the primary field, and those of the secondary that it doesn't have."""
    first = primary.select(*key, value, F.lit("primary").alias("source")).distinct()
    more = secondary.select(*key, value).distinct().join(first.select(*key, value), [*key, value], "left_anti").withColumn("source", F.lit("secondary"))
    return first.unionByName(more)


def unmatched_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: key, side."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    return left.unionByName(b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("right")))
