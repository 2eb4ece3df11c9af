"""Records: suggestions, merges, inheritance, reviews, queues, answers; nulls, ties, empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kelda.functions import records as R
from kelda.operators import records


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def test_text(spark):
    x = F.col("x")
    assert one(spark, R.strip_committees(x), "Report to the Standing Committee on Fisheries and Oceans. Fisheries") == "Report to the  . Fisheries"
    assert one(spark, R.year_in_title(x), "Plan 2017-2018") == 2017 and one(spark, R.year_in_title(x), None) is None
    assert one(spark, R.published_day(x), "2020-01-02T10:00") == "2020-01-02" and one(spark, R.published_day(x), "2 Jan") == ""
    assert one(spark, R.document_kind(x), "Special Examination of X") == "special_examination" and one(spark, R.document_kind(x), None) == "other"
    assert one(spark, R.numbers_in_links(x), "see https://a.b/doc_1234.html and https://a.b/99 http://c/d_1234") == ["1234"]
    assert one(spark, R.firm_in_relation(x), "a contract awarded to Grakin Trugil Inc, in 2010") == "Grakin Trugil Inc" and one(spark, R.firm_in_relation(x), "nobody") == ""
    assert one(spark, R.first_named(x, [("a", "one"), ("b", "two")]), "two and one") == "a"
    long = spark.createDataFrame([("t", "d" * 70_000), ("t", "d" * 59_999)], "t string, d string").select(R.state_hash(F.col("t"), F.col("d")).alias("h")).collect()
    assert long[0].h == long[1].h
    got = [tuple(one(spark, R.parsed_answer(x, ["a"]), v)) for v in ('{"choice": "a", "mass": 0.5}', '```json\n{"choice": "a", "mass": 1}\n```', '{"choice": "b", "mass": 1}', '{"choice": "a", "mass": 2}', "no", None)]
    assert got[:2] == [("a", 0.5, None), ("a", 1.0, None)] and [g[2] for g in got[2:]] == ["unknown choice", "mass out of range", "no answer", "no answer"]
    with pytest.raises(ValueError):
        R.blinded(spark.range(1).selectExpr("id", "id AS Label"), ["id", "Label"], ["label"])


def test_suggestions(spark):
    names = spark.createDataFrame([("fisherys",), ("fisherys",), (None,), ("",), ("zzzz",)], "n string")
    got = [tuple(r) for r in records.suggestions(names, "n", ["fisheries", "fishers", "energy"], 2).orderBy("rank").collect()]
    assert got == [("fisherys", 1, "fishers"), ("fisherys", 2, "fisheries")]
    assert records.suggestions(names, "n", []).count() == 0 and records.suggestions(names.limit(0), "n", ["a"]).count() == 0


def test_merge_and_inherit(spark):
    stored = spark.createDataFrame([("a", 5, "2020-01-01", "2020-02-01"), ("b", 1, "2020-01-01", "2020-02-01")], "k string, n long, first_seen string, last_seen string")
    seen = spark.createDataFrame([("a", 2), ("a", 3), ("c", 1)], "k string, n long")
    out = {r.k: (r.n, r.first_seen, r.last_seen, r.live) for r in records.merge_attestations(stored, seen, ["k"], "n", "2021").collect()}
    assert out == {"a": (5, "2020-01-01", "2021", True), "b": (1, "2020-01-01", "2020-02-01", False), "c": (1, "2021", "2021", True)}
    children = spark.createDataFrame([(1, ["x"], ["p"]), (2, ["none"], ["p"]), (3, None, None), (4, [], ["q"])], "c int, ids array<string>, nums array<string>")
    parents = spark.createDataFrame([("P1", "x", "q", "v1"), ("P2", "y", "p", "v2"), ("P3", None, "p", "v3")], "p string, id string, num string, v string")
    got = {(r.c, r.p): (r.method, r.n_parents, r.v) for r in records.inherit(children, "c", parents, "p", [("id", "ids", "id"), ("num", "nums", "num")], "v").collect()}
    assert got == {(1, "P1"): ("id", 1, "v1"), (2, "P2"): ("num", 2, None), (2, "P3"): ("num", 2, None), (4, "P1"): ("num", 1, "v1")}
    assert records.inherit(children.limit(0), "c", parents, "p", [("id", "ids", "id")], "v").count() == 0


def test_reviews_and_queue(spark):
    rows = spark.createDataFrame([(1, "r", 2, "yes"), (1, "r", 1, "no"), (1, "s", 1, "no"), (1, "t", 1, "yes"), (2, "r", 1, "no"), (2, "s", 1, "yes"), (3, "r", 1, "no")], "i int, w string, at int, v string")
    first = records.first_reviews(rows, "i", "w", ["at"], "v", spark.createDataFrame([(3,)], "i int"))
    got = {(r.w, r.s): (r.n_items, r.n_agree) for r in records.agreement(first, "i", "w", "v", first.select("i", F.lit("z").alias("s")), "s").collect()}
    assert got == {("r", "z"): (2, 1), ("s", "z"): (2, 1), ("t", "z"): (1, 0)}
    pool = spark.createDataFrame([(i, str(i % 4)) for i in range(40)], "k int, day string")
    flags, done = pool.where("k < 9"), pool.where("k = 3")
    q = records.flag_queue(flags, pool, done, "k", "day", 20, 1).collect()
    assert sum(r.is_flag for r in q) == 8 == sum(not r.is_flag for r in q) and {r.k for r in q if r.is_flag} == set(range(9)) - {3}
    assert records.flag_queue(flags.limit(0), pool, done, "k", "day", 20, 1).count() == 0
    records.check_frozen("list", ["a"], records.frozen_digest(["a"]))
    with pytest.raises(ValueError):
        records.check_frozen("list", ["b"], records.frozen_digest(["a"]))
