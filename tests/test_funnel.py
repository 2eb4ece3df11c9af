"""Jurisdiction, ranges, relevance, variants and equivalence on rows with every case."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelda.operators import funnel
from kelda.operators.notices import Stage


def test_jurisdictions(spark):
    registry = spark.createDataFrame([("energy", "k"), ("", "x"), (None, "y")], "s string, key string")
    rows = [("Department of Energy", None), ("City of Teser", "Department of Energy"), ("Ville de Teser / Energy (DEN)", ""), ("Town of Kelm", None), ("Nobody", "Nowhere"), (None, None), (None, None), ("x" * 5000, "")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("jurisdiction", F.lit("clash"))
    got = {(r.a, r.b): (r.jurisdiction, r.basis) for r in funnel.jurisdictions(df, ["a", "b"], registry, "s").collect()}
    assert got[rows[0]] == ("federal", "a") and got[rows[1]] == ("federal", "b") and got[rows[2]] == ("federal", "a")
    assert got[rows[3]] == ("non_federal", "town of") and got[rows[4]] == got[rows[5]] == got[rows[7]] == ("unrecognised", None) and len(got) == 7
    assert funnel.with_jurisdiction(df.drop("jurisdiction"), ["a", "b"], registry, "s").groupBy("jurisdiction").count().count() == 3
    assert funnel.jurisdictions(df.limit(0), ["a", "b"], registry, "s").count() == 0


def test_range_relevance_variants(spark):
    rows = spark.createDataFrame([(1, 5.0, True, False, None, False), (2, 50.0, True, False, 0.7, False), (3, None, False, False, 0.1, True), (4, 50.0, False, False, None, True), (4, 50.0, False, False, None, True)], "id int, v double, coded boolean, family boolean, mass double, term boolean")
    keep, basis = funnel.relevance(F.col("coded"), F.col("family"), F.col("mass"), F.col("term"))
    assert [(r.k, r.b) for r in rows.select(keep.alias("k"), basis.alias("b")).collect()] == [(False, "code"), (True, "override"), (False, "mass"), (True, "term"), (True, "term")]
    stages = [funnel.outside(F.col("v"), 10, None), Stage("relevance", ~keep)]
    out = {r.variant: (r.admitted, r.added, r.lost) for r in funnel.compare_variants(rows, stages, {"all": lambda s: [], "high": lambda s: funnel.replaced(s, "value", F.col("v") < 100)}).collect()}
    assert out == {"base": (3, 0, 0), "all": (5, 2, 0), "high": (0, 0, 3)}
    assert not funnel.outside(F.col("v"), None, None).active
    same = funnel.equivalence(rows, ["id"], stages, (F.col("v") >= 10) & keep).first()
    assert (same.production, same.audited, same.only_production, same.only_audited, same.vacuous) == (2, 2, 0, 0, False)
    slip = funnel.equivalence(rows, ["id"], stages, F.col("id") == 3).first()
    assert (slip.only_production, slip.only_audited) == (1, 2)
    assert funnel.equivalence(rows.limit(0), ["id"], stages, keep).first().vacuous
