"""Ranks, panels, fits and controls against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelda.operators import backtest
from kelda.operators.ranking import global_rank, rank_within, upper_medians


def test_ranks(spark):
    """A third of all rows share a value, and ranks are still those of one sorted list."""
    rng = random.Random(1)
    rows = [(i, rng.choice("ab"), 0 if i % 3 == 0 else rng.randrange(50)) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, k string, v int").repartition(5)
    want = {r[0]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1)}
    assert {r.id: r["rank"] for r in global_rank(df, ["v", "id"]).collect()} == want
    got = {r.id: (r["rank"], r.class_size) for r in rank_within(df, ["k"], ["v", "id"]).collect()}
    for k in "ab":
        mine = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))
        assert all(got[r[0]] == (n, len(mine)) for n, r in enumerate(mine, 1))
    assert global_rank(df.limit(0), ["v", "id"]).count() == 0 and rank_within(df.limit(0), ["k"], ["v", "id"]).count() == 0


def test_upper_medians(spark):
    rng = random.Random(4)
    rows = [(k, v) for k in "abc" for v in [round(rng.lognormvariate(8, 3) * rng.choice([1, 1, 1, -1]), 2) for _ in range(rng.randrange(1, 400))]] + [("a", 5.0)] * 150 + [("d", None), (None, None), ("e", 0.0), ("e", -0.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {}
    for k in "abce":
        mine = sorted(v for x, v in rows if x == k and v is not None)
        want[k] = mine[len(mine) // 2]
    assert {r.k: r.m for r in upper_medians(df, ["k"], "v", "m").collect()} == want
    every = sorted(v for _, v in rows if v is not None)
    assert [r.m for r in upper_medians(df, [], "v", "m").collect()] == [every[len(every) // 2]]
    assert upper_medians(df.limit(0), ["k"], "v").count() == 0 and upper_medians(df.limit(0), [], "v").count() == 0


def newton(x, y, ridge):
    a = np.column_stack([np.ones(len(x)), x])
    w, pen = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    pen[0] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w = w + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pen), a.T @ (y - p) - pen * w)
    return w


def test_fits(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(600, 2)), 2)
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(int)
    rows = [("g" if i % 2 else "h", float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y))] + [("g", None, 1.0, 1), (None, 1.0, 1.0, 1)]
    fit = backtest.fit_logits(spark.createDataFrame(rows, "k string, a double, b double, y int"), "k", ["a", "b"], "y")
    assert set(fit) == {"g", "h"}
    assert fit["g"] == pytest.approx(newton(x[1::2], y[1::2], 1.0), abs=1e-5) and fit["h"] == pytest.approx(newton(x[::2], y[::2], 1.0), abs=1e-5)


def test_leave_one_out(spark):
    """Hits follow one feature and not size: the fit finds them in the year it has not seen."""
    rng = random.Random(3)
    rows = []
    for y in (1, 2, 3):
        for e in range(60):
            f = rng.random()
            rows.append((e, y, f if e % 7 else None, rng.randrange(9), (f if e % 7 else 0.0) > 0.7))
    panel = spark.createDataFrame(rows, "e int, y int, f double, size int, hit boolean")
    out = {r.y: r for r in backtest.leave_one_out(panel, "e", "y", ["f", "size"], "hit", "size").collect()}
    assert set(out) == {1, 2, 3} and all(r.n_rows == 60 and r.by_fit >= 0.9 and r.by_size < r.by_fit for r in out.values())
    assert backtest.leave_one_out(panel.limit(0), "e", "y", ["f"], "hit", "size").count() == 0
    assert backtest.leave_one_out(panel.where("y = 1"), "e", "y", ["f"], "hit", "size").first().n_rows == 60


def test_panel_and_control(spark):
    rows = [("a", 2000, 5.0, "x"), ("a", 2000, 7.0, "y"), ("a", 2001, 3.0, "x"), ("a", 2002, 9.0, None), ("b", 2002, 1.0, "x"), (None, 2000, 1.0, "x"), ("c", None, 1.0, "x")]
    df = spark.createDataFrame(rows, "e string, y int, v double, k string")
    got = {(r.e, r.year): r for r in backtest.yearly_panel(df, "e", "y", "v", "k", [2001, 2002]).collect()}
    a = got["a", 2002]
    assert (a.n_prior, a.n_last, a.most, a.most_24, a.latest_most, a.hhi, a.lag, a.idle_years, a.after) == (3, 1, 7.0, 7.0, 3.0, round(5 / 9, 6), 1, 1, 1)
    b = got["b", 2001]
    assert (b.n_prior, b.most, b.hhi, b.lag, b.after) == (0, None, None, 0, 0) and len(got) == 4
    rows = spark.createDataFrame([(i % 3 == 0, i % 2 == 0) for i in range(300)] + [(None, True)], "d boolean, t boolean")
    r = backtest.shuffle_control(rows, "d", "t").first()
    assert r.n == 300 and r.mean_shuffled == pytest.approx(1 / 3 * 0.5 + 2 / 3 * 0.5, abs=0.01) and 0.3 < r.share_as_good <= 1
    sharp = backtest.shuffle_control(rows.withColumn("d", F.col("t")), "d", "t").first()
    assert sharp.accuracy == 1.0 and sharp.share_as_good == 0.0 and backtest.shuffle_control(rows.limit(0), "d", "t").first().accuracy is None
