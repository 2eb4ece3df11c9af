"""Prose and notes on small rows with known answers."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from kelda.functions.text import words_only
from kelda.operators import notes, prose


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first().y


def test_scan_consumes_the_longest(spark):
    phrases = {"fisheries research council": "council", "fisheries research": "research", "port": "port"}
    docs = spark.createDataFrame([(1, "The Fisheries Research Council met."), (2, "Fisheries research, and the port."), (3, None), (4, "committee on fisheries research")], "id int, t string")
    got = {tuple(r) for r in prose.scan_phrases(docs, "id", "t", phrases, decoys=["committee on fisheries research"]).collect()}
    assert got == {(1, "council"), (2, "research")}
    assert prose.scan_phrases(docs, "id", "t", {}).count() == 0


def test_scan_against_a_plain_loop(spark, data):
    import __spark_entry__ as e

    listed = spark.read.parquet(f"{data}/institution_list.parquet").select("dept_key", words_only("name_en").alias("en"), words_only("name_fr").alias("fr")).collect()
    names = sorted(((p, r.dept_key) for r in listed for p in (r.en, r.fr) if p), key=lambda x: -len(x[0]))
    want = set()
    for r in spark.read.parquet(f"{data}/notices.parquet").select("reference_number", words_only("contracting_entity").alias("t")).collect():
        t = f" {r.t or ''} "
        for p, k in names:
            if f" {p} " in t:
                want.add((r.reference_number, k))
                t = t.replace(f" {p} ", " # ")
    assert {tuple(r) for r in e.queries()["phrase_scan"](spark, data).collect()} == want


def test_mentions_and_attestation(spark):
    assert one(spark, prose.mentions(prose.padded("x"), "a b"), "a b a b, A-B c") == 3
    docs = spark.createDataFrame([("national bank of arvandia",), ("bank of arvandia and the national bank of arvandia",), (None,)], "t string")
    r = prose.attested(docs.where("t IS NOT NULL"), "t", {"bank of arvandia": ["national bank of arvandia"]}).first()
    assert (r.n_documents, r.n_mentions) == (1, 1)


def test_quotes_and_flags(spark):
    docs = spark.createDataFrame([(1, "Travel is paid. Nothing else. TRAVEL again.\nTravel is paid."), (2, None), (3, "")], "id int, t string")
    r = prose.quotes(docs, "id", "t", {"p": ["travel"], "q": ["absent"]}).collect()
    assert [(x.id, x.probe, x.n_quotes, x.quotes) for x in r] == [(1, "p", 2, ["Travel is paid.", "TRAVEL again."])]
    flags = lambda t: tuple(one(spark, prose.ceiling_flags(F.col("x"), ["see attached"]), t))
    assert flags("See attached.") == (True, True) and flags("") == (True, False) and flags(None) == (True, False) and flags("Word " * 60 + ".") == (False, False)


def test_supplier_lists(spark):
    strip = lambda t: one(spark, prose.without_supplier_lists(F.col("x")), t)
    run = "\n".join(f"{i}. Vendor Number {i} Inc." for i in range(15))
    assert strip(f"Before this, prose.\n{run}\nAfter this, prose.") == "Before this, prose.\n[list of suppliers]\nAfter this, prose."
    nine = "\n".join(f"{i}. Vendor Number {i} Inc." for i in range(9))
    plain = "\n".join(f"- point {i}" for i in range(15))
    assert strip(nine) == nine and strip(plain) == plain
    assert strip("") == "" and strip(None) is None and len(strip("x\n" * 50_000)) == 100_000
    mixed = "\n".join(f"- Vendor {i} Ltd" + "\n\nsome item" * (i % 9 == 8) for i in range(18))
    assert strip(f"head\n{mixed}\ntail") == "head\n[list of suppliers]\n\nsome item\ntail"
    loose = "\n".join(f"- Vendor {i} Ltd\nsome item" for i in range(18))
    assert strip(loose) == loose


def test_front_matter_and_lists(spark):
    got = one(spark, prose.front_matter(F.col("x")), "---\nstate: watching\nnote: ~\nempty:\n# no\nurl: 'http://a.b'\n---\nbody: text")
    assert got == {"state": "watching", "note": None, "empty": None, "url": "http://a.b"}
    assert one(spark, prose.front_matter(F.col("x")), "no block") == {}
    assert one(spark, prose.inline_list(F.col("x")), "[a, 'b', ]") == ["a", "b"] and one(spark, prose.inline_list(F.col("x")), None) == []
    assert one(spark, prose.cited_reports(F.col("x")), "see Report 3, and Reports 5 to 7 and 9; report 1-40") == [3, 5, 6, 7, 9]


def test_lines_page(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, None)], "id int, t string")
    assert [(r.id, r.line_no, r.line, r.total) for r in prose.lines_page(docs, "id", "t", 1, 2).collect()] == [(1, 1, "b", 4), (1, 2, "c", 4)]


def test_notes(spark):
    log = spark.createDataFrame([("t1", 1, "watch"), ("t1", 2, "park"), ("t2", 1, "watch")], "k string, at int, event string")
    assert {(r.k, r.event, r.n_events) for r in notes.current_state(log, "k", "at", "event").collect()} == {("t1", "park", 2), ("t2", "watch", 1)}
    asked = spark.createDataFrame([("t1", "park"), ("t2", "park"), ("t3", "park"), ("t3", "watch"), ("t1", "archive")], "k string, event string")
    moves = {"watch": [""], "park": ["watch"], "archive": ["watch", "park"]}
    out = {(r.k, r.event): r.refusal for r in notes.allowed(log, asked, "k", "at", "event", moves).collect()}
    assert out == {("t1", "park"): "not from park", ("t2", "park"): None, ("t3", "park"): "not from nothing", ("t3", "watch"): None, ("t1", "archive"): None}


@pytest.mark.parametrize("name", ["entry", "queries", "oracle_sql"])
def test_nothing_else_imports_the_subpackage(name):
    """The rest of the library must run without kelda.llm."""
    import os

    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "kelda")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as source:
                    assert not re.search(r"kelda\.llm|from \.+llm", source.read()), f
    import __spark_entry__ as e

    assert callable(getattr(e, name))
