"""Operators on small rows with known answers."""

from __future__ import annotations

import datetime as dt
import math
from fractions import Fraction
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from kelda.functions import stats as S, text as T
from kelda.operators import entity, evaluate, families, notices, retrieval, sampling, sets, signals


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize(
    ("build", "value", "want"),
    [
        (T.normalize_org, "Department of Fisheries | Ministère des Pêches", "fisheries"), (T.normalize_org, None, ""), (T.normalize_org, "The Government of Arvandia R&D Office", "r and d office"),
        (T.normalize_vendor, "Acme, Co. Ltd. / Acme Ltée", "ACME"), (T.normalize_vendor, "Inc.", "INC"), (T.normalize_vendor, None, None),
        (T.split_entities, "A (X) (Y) / B - / ", ["A", "B"]), (T.split_entities, None, []), (T.parse_codes, "*12345678\n*123\n*12345678", ["12345678"]), (T.parse_money, "$1,234.50", 1234.5),
        (T.parse_money, "unknown", None), (T.parse_count, "3.0", 3), (T.parse_count, "", None), (T.registration_base, "A-B-10", "A-B"), (T.registration_sequence, "A-B-x", None),
        (T.source_prefix, "PW-12", "PW"), (T.source_prefix, "12", "?"), (T.slug, "Déjà vu! 2", "deja-vu-2"), (T.tokens, "Über straße x_1", ["über", "straße", "x_1"]),
        (T.sentences, "One. Two!\n\nThree", ["One.", "Two!", "Three"]), (T.strip_urls, "see https://a.b/c now", "see   now"), (T.strip_brackets, "Name (A) (B)", "Name"),
        (T.blank_to_null, " NaN ", None), (T.strip_markdown, "**a**\n- b", "a b"), (T.count_tokens, "a b_c d", 3), (T.split_keys, "a, b,,a", ["a", "b"]),
    ],
)
def test_text(spark, build, value, want):
    assert one(spark, build("x"), value) == want


def test_words_and_windows(spark):
    assert one(spark, T.contains_word("x", "data"), "Metadata store") is False
    assert one(spark, T.contains_word("x", "c++"), "uses C++, yes") is True
    assert one(spark, T.matched_terms("x", ["b", "a"]), "a and b") == ["b", "a"]
    assert one(spark, T.term_window("x", "needle", 3), "hay hay needle hay") == "ay needle ha"
    assert one(spark, T.count_token("x", "net"), "net netting Net, inter-net") == 3
    assert one(spark, T.matched_prefixes(T.parse_codes("x"), ["43", "4321", "9"]), "*43211500") == ["43", "4321"]


def test_closing_window(spark):
    today = F.lit("2026-08-09").cast("date")
    want = {"2026-08-12": ("imminent", 3), "2026-08-19": ("open", 10), "2026-10-01": ("open", 53), "2026-08-01": ("closed", -8), "2076-12-31": ("standing", None), "2036-01-01": ("open", 3432), None: ("unknown", None)}
    for day, answer in want.items():
        got = one(spark, notices.closing_window(F.col("x").cast("date"), today), day)
        assert (got.window, got.days) == answer


def test_figures_and_conflicts(spark):
    assert one(spark, notices.first_figure(F.col("x")), "about $2.5 M or $3") == 2.5e6
    assert one(spark, notices.first_figure(F.col("x")), "no money") is None
    closing = F.lit("2026-08-21").cast("date")
    assert one(spark, notices.date_conflict(F.col("x"), closing), "must be submitted on 2026-08-07.") == dt.date(2026, 8, 7)
    assert one(spark, notices.date_conflict(F.col("x"), closing), "must be submitted on 2026-08-20.") is None
    assert one(spark, notices.date_conflict(F.col("x"), closing), "signed 2026-08-07") is None


def test_funnel_adds_up(spark):
    rows = spark.createDataFrame([(1, True, True), (2, False, True), (3, None, False), (4, False, False)], "id int, a boolean, b boolean")
    stages = [notices.Stage("a", F.col("a")), notices.Stage("idle", F.lit(True), active=False), notices.Stage("b", F.col("b"))]
    staged = notices.with_stages(rows, stages)
    assert {r.id: r.first_drop for r in staged.collect()} == {1: "a", 2: "b", 3: None, 4: None}
    assert {r.id: len(r.s) for r in staged.select("id", notices.reached().alias("s")).collect()} == {1: 1, 2: 3, 3: 3, 4: 3}
    counts = {r.stage: (r.first_drops, r.fires, r.alone) for r in notices.funnel_counts(staged, stages).collect()}
    assert counts == {"a": (1, 1, 0), "idle": (0, 0, 0), "b": (1, 2, 1)}
    total = notices.funnel_counts(staged, stages).first()
    assert total.n_in == 4 and total.admitted + sum(c[0] for c in counts.values()) == 4


def test_medians_and_intervals(spark):
    df = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4)] + [("b", v) for v in (1, 2, 9)] + [("c", None)], "k string, v int")
    assert {r.k: r.m for r in df.groupBy("k").agg(S.upper_median("v").alias("m")).collect()} == {"a": 3, "b": 2, "c": None}
    for k, n in ((0, 10), (1, 10), (5, 10), (10, 10), (0, 0)):
        low, high = S.wilson(F.lit(k), F.lit(n))
        r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
        p, z2 = (k / n, 1.96**2) if n else (0, 0)
        roots = [(p + z2 / (2 * n) + sign * 1.96 * math.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n) for sign in (-1, 1)] if n else [0, 1]
        assert (r.a, r.b) == pytest.approx((max(0, roots[0]), min(1, roots[1])), abs=1e-9)
        assert n == 0 or r.a <= k / n <= r.b
    pairs = [(0, 0), (0, 5), (5, 5), (3, 9), (400, 500), (30_000, 31_000)]
    by_hand = [1.0, 0.0625, 1.0, *(min(1.0, float(2 * Fraction(sum(math.comb(b + c, i) for i in range(min(b, c) + 1)), 2 ** (b + c)))) for b, c in pairs[3:5])]
    got = [r.p for r in spark.createDataFrame([*pairs, (None, 1)], "b long, c long").select(S.binomial_two_sided(F.col("b"), F.col("c")).alias("p")).collect()]
    assert got[:5] == pytest.approx(by_hand, rel=1e-6) and 0 < got[5] < 0.01 and got[6] is None
    assert {r.l for r in spark.createDataFrame([("2024-03-31",), ("2024-04-01",), (None,)], "d string").select(S.fiscal_label(F.col("d").cast("date")).alias("l")).collect()} == {"2023-2024", "2024-2025", ""}


def test_families(spark):
    rows = spark.createDataFrame([("f", 5.0, "2020", "v1"), ("f", 5.0, "2021", "v2"), ("f", None, "2022", "v3"), ("g", None, None, None)], "f string, value double, day string, vendor string")
    out = {r.f: (r.value, r.max_day, r.vendor, r.n_rows) for r in families.families(rows, ["f"], "value", ["day"], ["vendor"], ["day"]).collect()}
    assert out == {"f": (5.0, "2022", "v2", 3), "g": (None, None, None, 1)}
    asked = spark.createDataFrame([("f",), ("z",), ("f",)], "f string")
    assert {(r.f, r.n_rows) for r in families.counts_with_zeros(asked, rows, "f").collect()} == {("f", 3), ("z", 0)}


def test_signals(spark):
    facts = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    kids = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (9, "a")], "k int, v string")
    assert [r.k for r in signals.having(facts, kids, "k", F.col("v") == "a", F.col("v") == "b").collect()] == [1]
    assert {r.k: [x.v for x in r.vs] for r in signals.nest(facts, kids, "k", "vs", ["v"]).collect()} == {1: ["a", "b"], 2: ["a"], 3: []}
    assert [r.k for r in signals.orphans(kids, facts, "k").collect()] == [9]
    v = spark.createDataFrame([(1, "2020-01-01", "2020-03-01"), (2, "2020-03-01", None), (3, None, None)], "id int, s string, e string").select("id", F.col("s").cast("date").alias("s"), F.col("e").cast("date").alias("e"))
    at = lambda x: [r.id for r in signals.in_force_at(v, "s", "e", F.lit(x).cast("date")).collect()]
    assert at("2020-03-01") == [2] and at("2020-02-29") == [1] and at("2019-12-31") == []
    grid = {(str(r.as_of), r.id) for r in signals.in_force_grid(v, "s", "e", "2020-01-01", "2020-04-01").collect()}
    assert grid == {("2020-01-01", 1), ("2020-02-01", 1), ("2020-03-01", 2), ("2020-04-01", 2)}


def test_entities(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "n string")
    registry = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "b"), ("k3", "b")], "key string, s string")
    assert {(r.n, r.key, r.state) for r in entity.resolve_exact(names, "n", registry, "key", "s").collect()} == {("a", "k1", "resolved"), ("b", None, "ambiguous"), ("c", None, "unresolved")}
    left = spark.createDataFrame([("l1", "x", "p"), ("l2", "y", "q"), ("l3", "y", ""), ("l4", None, None)], "l string, a string, b string")
    right = spark.createDataFrame([(1, "x", ""), (2, "z", "q"), (3, "w", "")], "r int, c string, d string")
    assert {tuple(x) for x in entity.crosswalk(left, right, "l", "r", [("a", "c"), ("b", "d")]).collect()} == {("l1", 1, 1), ("l2", 2, 2), ("l3", None, None), ("l4", None, None), (None, 3, None)}
    codes = spark.createDataFrame([("801015",), ("809999",), ("77",)], "code string")
    options = spark.createDataFrame([("80",), ("8010",)], "option string")
    assert {tuple(r) for r in entity.longest_prefix(codes, "code", options, "option", [2, 4]).collect()} == {("801015", "8010"), ("809999", "80"), ("77", None)}
    pairs = entity.prefix_collisions(spark.createDataFrame([("Bank of A",), ("Bank of B",), ("Other",)], "n string"), "n", 2).collect()
    assert [(p.name_a, p.name_b, p.shared) for p in pairs] == [("Bank of A", "Bank of B", 2)]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "blue"), (3, ""), (4, None)], "id int, t string")
    got = {r.id: r.score for r in retrieval.bm25(docs, "id", "t", "red Red", 5).collect()}
    idf = math.log((4 - 1 + 0.5) / (1 + 0.5) + 1)
    assert got == {1: pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 1)), abs=1e-6)}
    assert retrieval.bm25(docs, "id", "t", "", 5).count() == 0


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.6, 0.8], 0), (3, [0.0, 0.0], 1)], "id int, v array<double>, p int")
    near = retrieval.nearest(v, "id", "v", F.array(F.lit(1.0), F.lit(0.0)), 5).collect()
    assert [(r.id, r.similarity, r.score) for r in near] == [(1, 1.0, 1.0), (2, 0.6, round(1 / 1.4, 6))]
    assert retrieval.theme(v.where("id < 3"), "v").first().theme == pytest.approx([1.6 / math.sqrt(3.2), 0.8 / math.sqrt(3.2)])
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, rank int")
    assert {r.k: r.fused for r in retrieval.fuse([a, a.where("rank = 2")], "k").collect()} == {"x": round(1 / 61, 8), "y": round(2 / 62, 8)}


def test_query_sets(spark, monkeypatch):
    """Every query against all rows, over several passes and blocks, as one query at a time finds them."""
    rows = [(i, [math.sin(i * j + 1.0) for j in range(1, 5)], i % 3) for i in range(60)] + [(60, [0.0] * 4, 1), (61, None, 1), (62, [1.0], 2), (63, [math.sin(j + 1.0) for j in range(1, 5)], None)]
    v = spark.createDataFrame(rows, "id bigint, v array<double>, p int").repartition(3)
    q = v.where("id % 20 = 0")
    want = {i: [(r.id, r.similarity) for r in retrieval.nearest(v, "id", "v", F.array(*map(F.lit, rows[i][1])), 5).collect()] for i in (0, 20, 40)}
    for passes, scores in ((20_000, 2_000_000), (1, 7)):
        monkeypatch.setattr(retrieval, "QUERIES", passes)
        monkeypatch.setattr(retrieval, "SCORES", scores)
        got = {i: [] for i in want}
        for r in retrieval.nearest_each(v, "id", "v", q, "id", "v", 5).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.id, r.similarity))
        assert got == want
        assert all(r.id != r.query_id for r in retrieval.nearest_each(v, "id", "v", q, "id", "v", 5, exclude_self=True).collect())
        pools = {(r.query_id, r.p) for r in retrieval.max_pool_each(v, "p", "v", q, "id", "v", "p").collect()}
        assert pools == {(i, p) for i in want for p in range(3) if p != i % 3}
        docs = spark.createDataFrame([(1, "red red fox"), (2, "blue fox"), (3, ""), (4, None), (5, "fox red")], "id bigint, t string").repartition(2)
        asked = spark.createDataFrame([(7, "red Red"), (8, "fox blue"), (9, ""), (10, None)], "n bigint, t string")
        got = {(r.query_id, r.id, r.score) for r in retrieval.bm25_each(docs, "id", "t", asked, "n", "t", 2).collect()}
        assert got == {(n, r.id, r.score) for n, t in ((7, "red Red"), (8, "fox blue")) for r in retrieval.bm25(docs, "id", "t", t, 2).collect()}
    assert retrieval.nearest_each(v, "id", "v", q.limit(0), "id", "v", 5).count() == 0


def test_chunks():
    assert retrieval.chunk_texts("", "") == [] and retrieval.chunk_texts("T", None) == ["T"]
    text = "\n\n".join(f"Paragraph {i} says this and that." * 8 for i in range(30))
    parts = retrieval.chunk_texts("Title", text)
    assert all(p.startswith("Title") and len(p) <= 988 + 2 for p in parts) and len(parts) > 5
    assert len(retrieval.chunk_texts("", "x" * 5000)) == math.ceil(5000 / (988 - 197 - 2))


def test_evaluation(spark):
    rows = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, True), (4, False, False), (5, None, True)], "id int, e boolean, d boolean")
    c = evaluate.confusion(rows, "e", "d").first()
    assert (c.tp, c.fp, c.tn, c.fn, c.unscored, c.precision, c.recall) == (1, 1, 1, 1, 1, 0.5, 0.5)
    m = spark.createDataFrame([(0.1,), (0.95,), (1.0,), (None,)], "m double")
    assert [r.n_rows for r in evaluate.histogram(m, "m").orderBy("bin").collect()] == [0, 1, 0, 0, 0, 0, 0, 0, 0, 2]
    assert evaluate.lift(rows.withColumn("s", F.col("id") < 3), ["s"], "d").first().rate == 0.5
    mask = spark.createDataFrame([(1, "2020-01-01", "2021-01-01", "a", "b"), (2, "2022-01-01", "2022-01-01", "a", "b")], "id int, x string, y string, p string, q string")
    out = evaluate.availability_mask(mask, [(F.col("x").cast("date"), ["p"]), (F.col("y").cast("date"), ["q"])], F.lit("2020-06-01").cast("date")).collect()
    assert [(r.id, r.p, r.q) for r in out] == [(1, "a", None)]


def test_samples(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(300)], "id int, s string")
    first = [r.id for r in sampling.hash_sample(rows, "id", 20, 1).collect()]
    assert first == [r.id for r in sampling.hash_sample(rows.repartition(7), "id", 20, 1).collect()] and len(set(first)) == 20
    assert first != [r.id for r in sampling.hash_sample(rows, "id", 20, 2).collect()]
    drawn = sampling.round_robin(rows, "s", "id", 7, 1).collect()
    assert sorted(r.turn for r in drawn) == [1, 1, 1, 2, 2, 2, 3]
    assert 10 < sampling.bernoulli(rows, "id", 0.1, 1).count() < 60
    assert {r.s: r["count"] for r in sampling.per_outcome(rows, "s", "id", 5, 1).groupBy("s").count().collect()} == {"a": 5, "b": 5, "c": 5}
    pairs = sampling.matched_pairs([{"a": 1, "b": 2, "d": "x"}, {"a": 1, "b": 3, "d": "x"}, {"a": 4, "b": 5, "d": "x"}, {"a": 6, "b": 7, "d": "y"}], {"d": 1}, 5)
    assert [(p["a"], p["b"]) for p in pairs] == [(1, 2), (6, 7)]


def test_sets(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    assert sets.new_since(a, None, "k") is None and [r.k for r in sets.new_since(a, b, "k").collect()] == [1]
    assert {(r.k, r.side) for r in sets.symmetric_difference(a, b, "k").collect()} == {(1, "left"), (3, "right")}
    batch = spark.createDataFrame([(2, 1), (4, 2), (4, 1), (None, 1)], "k int, n int")
    assert [(r.k, r.n) for r in sets.insert_absent(b, batch, ["k"], ["n"]).collect()] == [(4, 1)]
    assert sets.fingerprint(a, "k").first() == sets.fingerprint(a.repartition(3), "k").first()


def test_files_and_sinks(spark, tmp_path):
    from kelda.sources import files, sinks

    assert files.resolve_columns(["﻿Ref  No", "Title"], {"id": ["ref no"], "x": ["nope"]}, {"id"}, "f") == {"id": "﻿Ref  No", "x": None}
    with pytest.raises(files.SchemaMismatch):
        files.resolve_columns(["A"], {"id": ["b"]}, {"id"}, "f")
    feed = tmp_path / "feed.csv"
    feed.write_text('Id,Text\n1,"two\nlines"\n2,plain\n', encoding="utf-8")
    rows = files.read_feed(spark, str(feed), {"id": ["id"], "text": ["TEXT"], "other": ["x"]}, {"id"})
    assert {tuple(r) for r in rows.collect()} == {("1", "two\nlines", None), ("2", "plain", None)}
    assert files.decide_encoding("é".encode("cp1252"))[0] == "cp1252"
    root = str(tmp_path / "built")
    os.makedirs(root)
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, root)
    builds = [sinks.publish(rows, root, {"source": i}, key="id") for i in range(3)]
    assert sinks.current(spark, root).count() == 2 and sinks.current_meta(root)["source"] == 2 and sinks.current_meta(root)["row_count"] == 2
    assert sorted(x for x in os.listdir(root) if x.startswith("build")) == sorted(builds[1:])
    log = str(tmp_path / "log")
    assert [sinks.append_once(rows, log, ["id"], ["text"]) for _ in range(2)] == [2, 0]
    named = f"file://{tmp_path}/named"
    assert [sinks.append_once(rows, named, ["id"], ["text"]) for _ in range(2)] == [2, 0]
    sinks.publish(rows, f"{named}-built", {"source": 9})
    assert sinks.current(spark, f"{named}-built").count() == 2 and sinks.current_meta(f"{named}-built", spark)["source"] == 9
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("late.csv", b"x" * 2_000_000 + "é".encode("cp1252"))
        z.writestr("tiny.csv", "é".encode("cp1252"))
        z.writestr("marked.csv", "\ufeffé".encode())
    out = files.unpack_members(str(tmp_path / "a.zip"), ["late.csv", "tiny.csv", "marked.csv"], str(tmp_path / "landing"))
    assert all(open(p, encoding="utf-8").read().lstrip("x") == "é" for p in out.values())
    assert sinks.compare_provenance({"sha256": "a"}, {"sha256": "a"}) == {"state": "same", "basis": "sha256"}
    assert sinks.compare_provenance({}, {}) == {"state": "unknown", "basis": "none"}
    assert sinks.output_path("x", None, "few") == "x.sample"
    assert list(files.pages(lambda s, n: (5, list(range(s, min(5, s + n)))), 2, 4)) == [0, 1, 2, 3]


def test_downloads_outputs_and_bundles(spark, tmp_path):
    from kelda.sources import files, sinks

    data, path = bytes(range(256)) * 40, str(tmp_path / "big")
    calls = []

    def read(at, n):
        calls.append(at)
        if len(calls) == 3:
            raise ConnectionError
        return data[at : at + n]

    with pytest.raises(ConnectionError):
        files.resume_download(read, path, len(data), 1000)
    assert files.resume_download(read, path, len(data), 1000) == len(data) - 2000 and open(path, "rb").read() == data
    assert files.resume_download(read, path, len(data)) == 0
    with pytest.raises(OSError):
        files.resume_download(lambda a, n: b"", str(tmp_path / "none"), 5)
    rows = spark.createDataFrame([("c", 2, "x"), ("c", 1, None), ("c", 3, "z"), ("d", 1, "y")], "k string, n int, v string")
    root = f"file://{tmp_path}/out"
    assert sinks.write_outputs({"all_rows": rows}, root, {"run": 1})["rows"] == {"all_rows": 4}
    assert sinks.read_manifest(f"{root}/manifest.json")["run"] == 1 and sinks.read_manifest(f"{root}/none.json") == {}
    with pytest.raises(ValueError):
        sinks.write_outputs({"a/b": rows}, root, {})
    cases = spark.createDataFrame([("c",), ("c",), ("e",)], "k string")
    got = {r.k: r.bundle for r in sinks.case_bundles(cases, "k", {"rows": (rows, ["n"])}, most=2).collect()}
    assert got == {"c": '{"k":"c","rows":{"rows":[{"n":1},{"n":2,"v":"x"}],"others":1}}', "e": '{"k":"e"}'}


def test_semantic_search(spark):
    """The best chunk of a document counts, as brute force over all chunks has it."""
    docs = [(i, f"alpha beta word{i} " * 30 + f"\n\ngamma delta{i} " * 40) for i in range(30)] + [(90, None), (91, "")]
    d = spark.createDataFrame(docs, "id long, t string")
    queries = spark.createDataFrame([(1, "gamma delta7"), (2, "word3"), (3, None)], "q long, w string")
    embed = retrieval.HashedWords(64)
    got = {(r.query_id, r["rank"]): (r.id, r.similarity) for r in retrieval.semantic_each(d, "id", F.lit("T"), F.col("t"), queries, "q", "w", embed, 4).collect()}
    for q, w in ((1, "gamma delta7"), (2, "word3")):
        scores = sorted((-round(float((embed(retrieval.chunk_texts("T", t)) @ embed([w])[0]).max()), 6), i) for i, t in docs[:30])
        want = [(i, -s) for s, i in scores[:4]]
        mine = [got[q, k] for k in range(1, 5)]
        assert [i for i, _ in mine[:4]] == [i for i, _ in want] or [s for _, s in mine] == pytest.approx([s for _, s in want])
    assert not any(q == 3 for q, _ in got)


def test_streams(spark, tmp_path):
    from kelda.streaming import feeds

    rows = spark.createDataFrame([(1, 5), (1, 4), (2, 6), (None, 1)], "k int, n int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        feeds.insert_first(feeds.file_stream(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), ["k"], ["n"], str(tmp_path / "ckpt")).awaitTermination()
        rows.withColumn("n", F.col("n") - 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert {(r.k, r.n) for r in feeds.stored(spark, str(tmp_path / "out"), rows.schema).collect()} == {(1, 4), (2, 6)}
    days = spark.createDataFrame([("a", "2020-01-02"), ("a", "2020-01-05")], "name string, day string")
    first = feeds.seen_between(None, days, "name", "day")
    assert [tuple(r) for r in feeds.seen_between(first, days.limit(1), "name", "day").collect()] == [("a", "2020-01-02", "2020-01-05")]


def test_checkpoint_folder_of_the_session(spark):
    from kelda.session import cut_lineage

    assert cut_lineage(spark.range(3)).count() == 3
