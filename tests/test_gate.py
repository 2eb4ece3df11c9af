"""Curves, misses, budgets, options and evidence: nulls, ties and empty tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelda.operators import gate


def test_curves(spark):
    rows = spark.createDataFrame([(0.004, True, True), (0.3, True, False), (0.3, False, True), (0.96, True, None), (None, True, True), (0.5, None, False)], "m double, t boolean, k boolean")
    out = {r.threshold: r for r in gate.method_curve(rows, "m", "t", "k").collect()}
    assert len(out) == 24
    r = out[0.3]
    assert (r.admitted, r.hits, r.recall, r.precision, r.both, r.only_mass, r.only_plain, r.neither) == (4, 2, 0.5, 0.5, 1, 3, 2, 0)
    assert out[0.005].admitted == 4 and gate.method_curve(rows.limit(0), "m", "t", "k").first().recall is None
    lost = {r.bin: (r.missed, r.missed_by_both) for r in gate.misses(rows, "m", "t", "k", 0.5).collect()}
    assert lost == {0.001: (1, 0), 0.25: (1, 1)} and gate.misses(rows.limit(0), "m", "t", "k", 0.5).count() == 0
    b = {r.threshold: r for r in gate.corpus_budget(rows.withColumn("c", F.lit(7)), ~F.col("k"), "m", "c", 10).collect()}
    assert (b[0.3].admitted, b[0.3].rate, b[0.3].expected, b[0.3].cost) == (2, 1.0, 10.0, 14) and (b[0.95].admitted, b[0.95].cost) == (0, 0)


def test_options_and_evidence(spark):
    codes = spark.createDataFrame([("43210000",), ("43220000",), ("43330000",), ("77",), (None,), ("10110000",), ("10120000",)], "c string")
    got = [(r.kind, r.option) for r in gate.option_list(codes, "c", ["4321", "80"], ["4333"]).orderBy("place").collect()]
    assert got == [("profile", "4321"), ("profile", "80"), ("sibling", "4322"), ("segment", "10"), ("none", "")]
    a = spark.createDataFrame([("x", "2020-01-01"), ("x", "2021-01-01"), (None, "2020-01-01"), ("y", None)], "k string, d string").withColumn("d", F.col("d").cast("date"))
    at = F.lit("2020-06-01").cast("date")
    found = {(r.k, r.condition, r.source): r.n for r in gate.nested_evidence("k", [("one", a, "d"), ("two", a.where("k = 'x'"), "d")], at).collect()}
    assert found == {("x", "A", "one"): 1, ("x", "B", "one"): 1, ("x", "B", "two"): 1}
    r = gate.leak_audit(a, ["d"], at, ["k", "other"]).first()
    assert (r.n_rows, r.late, r.suppressed) == (4, 1, "k") and gate.leak_audit(a.limit(0), ["d"], at, []).first().n_rows == 0
