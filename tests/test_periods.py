"""Days, intervals, histories and as-of joins against plain loops."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kelda.functions.dates import iso, readable_day
from kelda.operators.asof import asof_join
from kelda.operators.history import change_log, combine, in_force, latest_delivery, version_history, version_order
from kelda.operators.intervals import merge_intervals

D = dt.date


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2020-02-29", "2020-02-29"), ("2021-02-29", None), (" 2020/1/5 ", "2020-01-05"), ("20200105", "2020-01-05"), ("2020.01.05", "2020-01-05"),
        ("2020-01-05T10:00:00", "2020-01-05"), ("2020-01-05 23:59", "2020-01-05"), ("2020-01-05T10:00:00Z", "2020-01-05"), ("2020-01-05T10:00:00.123+02:00", "2020-01-05"),
        ("2020/01/05 9:30 pm", "2020-01-05"), ("20200105T101500", "2020-01-05"), ("2020 Jan 5", "2020-01-05"), ("2020-févr-5", "2020-02-05"), ("2020", None), ("", None), (None, None),
        ("TBD", None), ("n/a", None), ("2020-13-01", None), ("05-01-2020", None), ("2020-01-05 or later", None), ("2020-1", None),
    ],
)
def test_readable_day(spark, text, day):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(iso(readable_day("s"))).first()[0] == day


def merged(spans):
    days = defaultdict(set)
    for k, a, b in spans:
        if k is not None and a and b and a <= b:
            days[k] |= {a + dt.timedelta(i) for i in range((b - a).days + 1)}
    out = set()
    for k, ds in days.items():
        runs = []
        for x in sorted(ds):
            if runs and (x - runs[-1][1]).days == 1:
                runs[-1][1] = x
            else:
                runs.append([x, x])
        out |= {(k, "period", a, b) for a, b in runs}
        out |= {(k, "gap", p[1] + dt.timedelta(1), q[0] - dt.timedelta(1)) for p, q in zip(runs, runs[1:])}
    return out


def test_merge_intervals_against_days(spark):
    rng = random.Random(1)
    spans = []
    for _ in range(400):
        a = D(2020, 1, 1) + dt.timedelta(rng.randrange(200))
        spans.append((rng.choice(["a", "b", "", None, "hot", "hot"]), rng.choice([a, a, a, None]), a + dt.timedelta(rng.randrange(-2, 8))))
    spans += spans[:50]
    # extra columns with the names that the operator gives and uses
    df = spark.createDataFrame([(*s, "x", 1) for s in spans], "k string, s date, e date, kind string, __s int")
    got = [tuple(r) for r in merge_intervals(df, ["k"], "s", "e").collect()]
    assert len(got) == len(set(got)) and set(got) == merged(spans)


def test_merge_intervals_empty(spark):
    assert merge_intervals(spark.createDataFrame([], "k string, s date, e date"), ["k"], "s", "e").count() == 0


def history_by_hand(rows):
    """rows: (base, pos, id, start, end, attribute)"""
    out = set()
    by = defaultdict(list)
    for r in rows:
        if r[0] is not None and r[3] is not None:
            by[r[0]].append(r)
    for base, vs in by.items():
        vs.sort(key=lambda r: (r[1], r[3], r[2]))
        live = []
        for i, (_, _, vid, a, b, x) in enumerate(vs):
            ends = [v[3] for v in vs[i + 1 :]] + ([b] if b and b >= a else [])
            to = min(ends) if ends else None
            if to is None or a < to:
                live.append([vid, a, to, x])
        runs = []
        for vid, a, to, x in live:
            if runs and runs[-1][2] == a and runs[-1][3] == x:
                runs[-1][2] = to
            else:
                runs.append([vid, a, to, x])
        out |= {(base, vid, a, to) for vid, a, to, _ in runs}
    return out


def test_version_history_against_a_loop(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        a = D(2020, 1, 1) + dt.timedelta(rng.randrange(60))
        rows.append((rng.choice(["a", "b", "c", "hot", "hot", None]), float(i), i, rng.choice([a] * 9 + [None]), rng.choice([None, a + dt.timedelta(rng.randrange(-3, 30))]), rng.choice(["x", "y", None])))
    df = spark.createDataFrame(rows, "base string, pos double, id int, starts date, ends date, name string")
    got = [tuple(r) for r in version_history(df, ["base"], "id", "pos", "starts", "ends", ["name"]).select("base", "id", "valid_from", "valid_to").collect()]
    assert len(got) == len(set(got)) and set(got) == history_by_hand(rows)


def test_change_log_and_combine(spark):
    rows = [("a", D(2020, 1, 1), D(2020, 2, 1), "x", 1), ("a", D(2020, 2, 1), D(2020, 3, 1), "x", 2), ("a", D(2020, 4, 1), None, "x", 2)]
    periods = spark.createDataFrame(rows, "k string, __from date, __to date, name string, num int")
    log = change_log(periods, ["k"], ["name", "num"])
    assert {(r.attribute, r.value, r.valid_from, r.valid_to) for r in log.collect()} == {
        ("name", "x", D(2020, 1, 1), D(2020, 3, 1)), ("name", "x", D(2020, 4, 1), None),
        ("num", "1", D(2020, 1, 1), D(2020, 2, 1)), ("num", "2", D(2020, 2, 1), D(2020, 3, 1)), ("num", "2", D(2020, 4, 1), None),
    }
    assert {(r.name, r.num, r.valid_from, r.valid_to) for r in combine(log, ["k"], ["name", "num"]).collect()} == {
        ("x", "1", D(2020, 1, 1), D(2020, 2, 1)), ("x", "2", D(2020, 2, 1), D(2020, 3, 1)), ("x", "2", D(2020, 4, 1), None),
    }


def test_version_order_follows_chains(spark):
    rows = [(1, 1, None), (2, None, 1), (3, None, 2), (4, None, 3), (5, 2, 4), (6, None, None), (7, None, 99), (8, 3, 7), (9, None, 10), (10, None, 9)]
    df = spark.createDataFrame(rows, "id int, seq int, prev int")
    pos = {r.id: r["__pos"] for r in version_order(df, "id", "seq", "prev").collect()}
    assert pos[1] < pos[2] < pos[3] < pos[4] < pos[5] < pos[7] < pos[8]
    assert pos[6] == pos[9] == pos[10] == float("-inf") and len(pos) == len(rows)


def test_latest_delivery_and_force_of_nothing(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 1), "a"), (1, D(2020, 2, 1), "b"), (1, None, "c"), (None, D(2020, 1, 1), "d"), (2, None, None)], "id int, posted date, v string")
    assert {(r.id, r.v) for r in latest_delivery(df, "id", "posted").collect()} == {(1, "b"), (2, None)}
    none = spark.createDataFrame([], "base string, pos double, s date, e date")
    assert in_force(none, ["base"], "pos", "s", "e").count() == 0


def test_asof_against_a_loop(spark):
    rng = random.Random(3)
    day = lambda: D(2020, 1, 1) + dt.timedelta(rng.randrange(50))
    versions = [(rng.choice(["a", "b", None, "hot", "hot"]), rng.choice([day(), None]), rng.choice([1, 2, None]), rng.choice(["p", "q", "r"])) for _ in range(300)]
    versions += versions[:20]
    events = [(i, rng.choice(["a", "b", "z", None, "hot"]), rng.choice([day(), None]), "mine") for i in range(200)]
    events.append(events[0])
    v = spark.createDataFrame(versions, "k string, known date, tie int, what string").withColumn("entity", F.lit("clash"))
    e = spark.createDataFrame(events, "id int, k string, at date, what string")
    got = sorted((r.id, r.known, r.what) for r in asof_join(e, v, ["k"], "at", "known", ["what"], [F.col("tie")], buckets=5).collect() if r.known)
    want = []
    for i, k, at, _ in events:
        best = max(((w[1], w[2] or 0, w[3]) for w in versions if k and at and w[0] == k and w[1] and w[1] <= at), default=None)
        if best:
            want.append((i, best[0], best[2]))
    assert got == sorted(want)
    assert asof_join(e, v.limit(0), ["k"], "at", "known", ["what"], [F.col("tie")]).count() == len(events)
    assert asof_join(e.limit(0), v, ["k"], "at", "known", ["what"], [F.col("tie")]).count() == 0
