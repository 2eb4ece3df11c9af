"""Code hierarchies, lookups with reasons, and rankings inside a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def hierarchy(rows: DataFrame, code: str, description: str) -> DataFrame:
    """code, level (1 to 4), prefix, description of eight-digit codes; the smallest description of a code repeated.

    The level is that of the digits before trailing zeros: two a level.
    """
    c = F.regexp_replace(F.trim(F.col(code)), r"\*", "")
    kept = rows.where(c.rlike(r"^[0-9]{8}$")).groupBy(c.alias("code")).agg(F.min(description).alias("description"))
    used = F.length(F.regexp_replace("code", "0+$", ""))
    level = F.greatest(F.lit(1), F.ceil(used / 2)).cast("int")
    return kept.select("code", level.alias("level"), F.left("code", level * 2).alias("prefix"), "description")


def roll_up(code: Column, level: int) -> Column:
    """The code's ancestor at a level, padded to eight digits."""
    return F.rpad(F.left(code, F.lit(2 * level)), 8, "0")


def describe(codes: DataFrame, code: str, tree: DataFrame) -> DataFrame:
    """codes with ``description``: the code's own, else that of the ancestor it stands for.

    Only trailing zeros are walked over: a code of a level that the tree lacks has none,
    however well its ancestors are described.
    """
    named = tree.select(F.col("code").alias("__c"), F.col("description").alias("__d"))
    out = codes.join(named, F.col(code) == F.col("__c"), "left").withColumnRenamed("__d", "__d0").drop("__c")
    for n, width in enumerate((6, 4, 2), 1):
        up = F.when(F.col(code).rlike(rf"^[0-9]{{{width}}}0+$"), F.rpad(F.left(code, F.lit(width)), 8, "0"))
        short = tree.where(F.length("prefix") <= width).select(F.rpad("prefix", 8, "0").alias("__c"), F.col("description").alias(f"__d{n}"))
        out = out.join(short, up == F.col("__c"), "left").drop("__c")
    return out.withColumn("description", F.coalesce(*[f"__d{n}" for n in range(4)])).drop(*[f"__d{n}" for n in range(4)])


def with_reasons(rows: DataFrame, tests: list[tuple[str, Column]]) -> DataFrame:
    """rows with ``reason``: the first test that holds, or 'kept'. For counting what a lookup loses."""
    out: Column | None = None
    for name, test in tests:
        t = F.coalesce(test, F.lit(False))
        out = F.when(t, name) if out is None else out.when(t, name)
    return rows.withColumn("reason", F.lit("kept") if out is None else out.otherwise("kept"))


def best_by_rank(items: Column, rank) -> Column:
    """The item of an array with the least rank, the first of equals; NULL of an empty one."""
    ranked = F.transform(items, lambda x, i: F.struct(rank(x).alias("rank"), i.alias("i"), x.alias("item")))
    return F.try_element_at(F.array_sort(ranked), F.lit(1))["item"]


def evidence_id(source: str, key: Column) -> Column:
    """A short id of a source's row: three letters and twelve digits of a digest."""
    return F.concat(F.lit(f"{source[:3]}-"), F.left(F.sha2(F.concat(F.lit(f"{source}|"), key.cast("string")), 256), F.lit(12)))
