"""Code trees, reasons, and callables from outside."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kelda.operators import codes, injected


def test_tree_and_descriptions(spark):
    rows = spark.createDataFrame([("*43000000", "it"), ("43210000", "computers"), ("43211500", "kinds"), ("43211500", "other"), ("12", "no"), (None, None)], "code string, d string")
    tree = codes.hierarchy(rows, "code", "d")
    assert {(r.code, r.level, r.prefix, r.description) for r in tree.collect()} == {("43000000", 1, "43", "it"), ("43210000", 2, "4321", "computers"), ("43211500", 3, "432115", "kinds")}
    asked = spark.createDataFrame([("43211500",), ("43210000",), ("43219999",), ("77000000",), (None,)], "c string")
    assert {r.c: r.description for r in codes.describe(asked, "c", tree).collect()} == {"43211500": "kinds", "43210000": "computers", "43219999": None, "77000000": None, None: None}
    assert spark.range(1).select(codes.roll_up(F.lit("43211507"), 3).alias("x")).first().x == "43211500"


def test_reasons_and_ranks(spark):
    rows = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id int, v string")
    assert {r.id: r.reason for r in codes.with_reasons(rows, [("none", F.col("v").isNull()), ("is a", F.col("v") == "a")]).collect()} == {1: "none", 2: "is a", 3: "kept"}
    urls = F.array(F.lit("fr/a"), F.lit("en/b"), F.lit("en/c"))
    best = codes.best_by_rank(urls, lambda x: F.when(x.startswith("fr"), 3).otherwise(0))
    assert spark.range(1).select(best.alias("x")).first().x == "en/b"
    empty = codes.best_by_rank(F.array().cast("array<string>"), lambda x: F.length(x))
    assert spark.range(1).select(empty.alias("x")).first().x is None


def test_injected_callables(spark):
    rows = spark.createDataFrame([(i, "x" * i) for i in range(1, 7)], "id int, t string").coalesce(1)

    def size(s: pd.Series) -> pd.Series:
        if (s.str.len() > 4).any():
            raise RuntimeError("too long")
        return s.str.len()

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        out = {r.id: (r.n, r.n_reason) for r in injected.with_injected(rows, "t", size, "n", "int").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out == {1: (1, None), 2: (2, None), 3: (3, None), 4: (4, None), 5: (None, "RuntimeError: too long"), 6: (None, "RuntimeError: too long")}
    v = injected.hashed_encoder(16)(pd.Series(["a text", None, "a text"]))
    assert v[0] == v[2] and sum(x * x for x in v[0]) == pytest.approx(1)


def test_cache(spark):
    items = spark.createDataFrame([(1,), (2,)], "k int")
    cache = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    hit, miss = injected.with_cache(items, cache, ["k"], "v")
    assert [tuple(r) for r in hit.collect()] == [(1, "a")] and [r.k for r in miss.collect()] == [2]
