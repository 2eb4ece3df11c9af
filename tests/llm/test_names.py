"""Canonical lists, variant spellings and record linkage."""

from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kelda.llm.bodies import BodyParser, near_keys
from kelda.llm.canonical import DeleteDictionary, MatchRules, NameMatcher, deletes, edits, map_to_list, weighted_distance
from kelda.llm.linkage import BODY_PASSES, Comparison, LinkModel, LinkRules, body_comparisons, body_records, candidates, link
from kelda.llm.plans import ELSEWHERE
from kelda.llm.variants import Rewriter, VariantRules, _forms, link_variants, readings, variant_pairs

ENTRIES = [
    ("fish", ["Department of Fisheries", "Ministère des Pêches", "Secretariat of Fisheries and Colonies"], ["DFI"]),
    ("fish-council", ["Fisheries Research Council of Arvandia", "Conseil de recherches des Pêches d'Arvandie"], ["FIRCA"]),
    ("rail-agency", ["Arvandian Rail Safety Inspection Agency", "Agence arvandienne d'inspection de la Sécurité ferroviaire"], ["RSIA"]),
    ("energy", ["Department of Energy", "Ministère de l'Énergie"], ["DEN"]),
    ("other", ["Bureau of Everything Else Whatsoever"], ["DEN"]),
]


@pytest.fixture(scope="module")
def matcher():
    return NameMatcher(ENTRIES, MatchRules(), {"energy": 5, "other": 1}, ELSEWHERE)


@pytest.mark.parametrize(
    ("value", "key"),
    [
        ("DEPARTMENT OF FISHERIES", "fish"), ("departmnet of fishreies", "fish"), ("Ministere-des-Peches", "fish"), ("MINISTÈRE_DES_PÊCHES", "fish"), ("MinistÃ¨re des PÃªches", "fish"),
        ("Fisheries, Department of", "fish"), ("Dpt Fisheries", "fish"), ("Dep't of Fisheries", "fish"), ("  Department 0f Fisheries;", "fish"), ("The Department of Fisheries", "fish"),
        ("Department of Fisheries - Regional Office, Teser", "fish"), ("Minister's Office, Department of Fisheries", "fish"), ("Department of Fisheries | Ministère des Pêches", "fish"), ("D.F.I.", "fish"),
        ("DFI (Arvandia)", "fish"), ("secretariat of fisheries and coloneis", "fish"), ("Rail Safety - Arvandian  Inspection Agency", "rail-agency"), ("FIRCA/Fisheries Research Council of Arvandia", "fish-council"),
        ("Fisheries Appeals Tribunal", None), ("Provincial Department of Fisheries (Teser)", None), ("Friends of Fisheries Society", None), ("Province of Teser - Ministry of Fisheries", None), ("Provicne of Teser, Department of Fisheries", None), ("n/a", None), ("City of Teser", None), ("x" * 50_000, None), ("!!!", None),
    ],
)
def test_match(matcher, value, key):
    got = matcher.match(value)
    assert (got[0] if got else None) == key


def test_hint_and_frequency_decide_ties(matcher):
    assert matcher.match("DEN")[0] == "energy" and matcher.match("DEN", "other")[0] == "other"


def test_delete_dictionary_is_complete():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(10, 14))) for _ in range(60)]
    d = DeleteDictionary(MatchRules(k2=10, k1=5))
    for w in words:
        d.add(w, w)
    for _ in range(60):
        v = list(rng.choice(words))
        for _ in range(rng.randrange(3)):
            v[rng.randrange(len(v))] = rng.choice("abcd")
        v = "".join(v)
        near = {w for w in words if edits(v, w, 2) <= 2}
        assert near <= {e for _, e in d.lookup(v)}
    assert deletes("abc", 2) == {"abc", "ab", "ac", "bc", "a", "b", "c"}
    assert weighted_distance("ab", "ba") < weighted_distance("ab", "ax") and weighted_distance("boook", "book") == 0.5
    assert weighted_distance("xab", "ab") == pytest.approx(1.3) and weighted_distance("same", "same") == 0
    with pytest.raises(ValueError):
        small = DeleteDictionary(MatchRules(dictionary=10))
        for w in words:
            small.add(w, w)


def test_map_to_list_cases(spark, matcher):
    rows = spark.createDataFrame([(1, "DFI", None), (2, None, "fish"), (3, " ", None), (4, "nowhere", "fish"), (4, "nowhere", "fish")], "id int, v string, hint string").withColumn("list_key", F.lit("old"))
    got = map_to_list(rows, "v", "hint", matcher)
    assert sorted((r.id, r.list_key) for r in got.collect()) == [(1, "fish"), (2, None), (3, None), (4, "unmatched"), (4, "unmatched")]
    assert map_to_list(rows.limit(0), "v", None, matcher).count() == 0


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Grakin Trugil Industries Inc.", ("firm", "grakin trugil", ["industries"], True)), ("TRUGIL GRAKIN INDUSTRIES", ("firm", "grakin trugil", ["industries"], True)),
        ("The Grakin-Trugil Ind. & Co. - Head Office", ("firm", "grakin trugil", ["industries"], True)), ("Grakin Trugil L.L.P.", ("firm", "grakin trugil", [], False)),
        ("Zarérd & Gikult Env. Svcs", ("firm", "gikult zarerd", ["environmental services"], True)), ("Gikult Zarerd E.S. Co.", ("firm", "gikult zarerd", ["environmental services"], True)),
        ("Grakin Trugil C. Inc.", ("firm", "grakin trugil", ["communications", "construction", "consulting"], False)), ("Chris Drom-Brev", ("person", "brev drom", ["christopher"], True)),
        ("Drom-Brev, Kit", ("person", "brev drom", ["catherine", "christopher"], False)), ("Dr. Christopher R. Drom Brev, P.Eng.", ("person", "brev drom", ["christopher"], True)),
        ("chirstopher drom-brev", ("person", "brev drom", ["christopher"], True)), ("Christopher Drom-Brev & Assoc.", ("person", "brev drom", ["christopher"], True)),
    ],
)
def test_readings(name, want):
    assert readings(name)[0] == want


def test_readings_of_nothing():
    assert readings("") == [] and readings("Inc.") == [] and readings("Consulting Ltd.") == []
    assert len(readings("Conseil Dobem Jogiwick / Dobem Jogiwick Consulting")) == 2


GROUPS = [
    ["Grakinford Trugilund Industries Inc.", "GRAKINFORD TRUGILUND INDUSTRIES", "Trugilund Grakinford Ind. Inc.", "Grakinfrod Trugilund Industries Inc.", "Grakinfordtrugilund Industries"],
    ["Memexesudale Construction", "The Memexesudale Constr. Ltd.", "Memexsudale Construction"],
    ["Memexesudale Translation Bureau Ltd.", "memexesudale translation bureau ltée"],
    ["Solomarvik Power Corp.", "Solomarvik Corp.", "Solomarvik P.", "Énergie Solomarvik"],
    ["Christopher Dromiwick-Brevock", "Chris Dromiwick-Brevock", "Dromiwick-Brevock, C", "CHRISTOPHER R. DROMIWICK-BREVOCK"],
    ["Victoria Dromiwick-Brevock", "Tori Dromiwick Brevock"],
]
NOBODY = ["Memexesudale Ltd.", "Memexesudale C.", "Inc.", "Kesilt Fellowick Associates", None, "", " ", "y" * 3000]


def test_variant_pairs(spark):
    names = [n for g in GROUPS for n in g] + NOBODY
    df = spark.createDataFrame([(n, "clash") for n in names * 2], "name string, entity string")
    linked = link_variants(df, "name")
    got = {tuple(r) for r in variant_pairs(linked).collect()}
    want = {tuple(sorted(p)) for g in GROUPS for p in combinations(g, 2)}
    # 'C.' fits the one Memexesudale firm with such a trade
    want |= {tuple(sorted(("Memexesudale C.", n))) for n in GROUPS[1]}
    assert got == want
    assert link_variants(df.limit(0), "name").count() == 0


def test_given_names_and_long_leads(spark):
    """Nicknames in any order; two slips in a name of any length; another table of nicknames."""
    long = "".join(chr(97 + i * 7 % 26) for i in range(70))
    swapped = long[:13] + long[14] + long[13] + long[15:41] + long[42] + long[41] + long[43:]
    names = ["Smith, Michael", "Mike Smith", "MICHAEL SMITH", "Bob Grakinford", "Grakinford, Robert", long, swapped, long[:20] + "0" + long[21:50] + long[51:], "Zaphod Trugilund", "Zap Trugilund"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {tuple(r) for r in variant_pairs(link_variants(df, "name")).collect()}
    want = {tuple(sorted(p)) for g in (names[:3], names[3:5], names[5:8]) for p in combinations(g, 2)}
    assert got == want
    own = link_variants(df, "name", Rewriter(given={"zaphod": "zap"}))
    assert tuple(sorted(names[8:])) in {tuple(r) for r in variant_pairs(own).collect()}


def test_rarity(spark):
    """What a name says and how many entities have it: rarity is one over their number and decides."""
    names = ["Christopher Drombrevock", "Catherine Drombrevock", "Kit Drombrevock", "Chris Drombrevock", "Drombrevock, C.", "Victoria Vanterkolt", "Vanterkolt, V."]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    linked = {r.name: (r.entity, r.rarity) for r in link_variants(df, "name").collect()}
    assert "Kit Drombrevock" not in linked and linked["Drombrevock, C."][0] not in {linked[n][0] for n in names[:2]}
    assert linked["Vanterkolt, V."] == (linked["Victoria Vanterkolt"][0], 1.0) and linked["Chris Drombrevock"][0] == linked["Christopher Drombrevock"][0]
    loose = {r.name: r.rarity for r in link_variants(df, "name", rules=VariantRules(rarity=0.4)).collect()}
    assert loose["Kit Drombrevock"] == loose["Drombrevock, C."] == 0.5 and linked["Drombrevock, C."][1] == 1.0


def test_forms_meet():
    """Leads within two slips share a form, whatever their length, swaps included."""
    rng = random.Random(15)
    for n in (9, 12, 30, 63, 64, 65, 66, 67, 90):
        for _ in range(30):
            a = [rng.choice("abcdefgh") for _ in range(n)]
            b = list(a)
            for _ in range(2):
                i, how = rng.randrange(len(b) - 1), rng.randrange(4)
                b[i : i + 2] = [b[i + 1], b[i]] if how == 0 else [b[i]] if how == 1 else ["x", b[i + 1]] if how == 2 else [b[i], "y", b[i + 1]]
            a, b = "".join(a), "".join(b)
            if min(len(a), len(b)) >= 9 and edits(a, b, 2) <= 2:
                assert set(_forms("firm", a)) & set(_forms("firm", b)), (a, b)


MANDATES = [("Fisheries", "Pêches"), ("Rail Safety", "Sécurité ferroviaire"), ("Heritage", "Patrimoine")]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Port Dalmar Office for Rail Safety", ("dalmar", "port", "rail safety", "O", [])), ("Bureau de la Sécurité ferroviaire de Port Dalmar", ("dalmar", "port", "rail safety", "O", [])),
        ("Board, North Kellin Fishreies", ("kellin", "north", "fisheries", "B", [])), ("DAHC - Dalmar", ("dalmar", "", "", "", ["DAHC"])), ("Former Heritage Commission of Dalmar (to 2015)", ("dalmar", "", "heritage", "C", [])),
        ("Dalmar Agency for Fisheries and Heritage", ("dalmar", "", "fisheries+heritage", "G", [])), ("", ("", "", "", "", [])),
    ],
)
def test_body_parser(name, want):
    assert BodyParser(MANDATES).read(name) == want


def test_em_recovers_planted_rates():
    import numpy as np

    rng = np.random.default_rng(1)
    match = rng.random(20_000) < 0.3
    m, u = np.array([0.9, 0.8, 0.85]), np.array([0.1, 0.3, 0.05])
    x = (rng.random((20_000, 3)) < np.where(match[:, None], m, u)).astype(int)
    patterns, counts = np.unique(x, axis=0, return_counts=True)
    model = LinkModel([2, 2, 2], [None] * 3, LinkRules()).fit(patterns, counts.astype(float), np.zeros(len(counts)))
    assert abs(model.share - 0.3) < 0.03
    assert all(abs(model.m[k][1] - m[k]) < 0.05 and abs(model.u[k][1] - u[k]) < 0.05 for k in range(3))
    assert LinkModel([2], [None], LinkRules()).fit(patterns[:0, :1], counts[:0].astype(float), counts[:0].astype(float)).share == 0.5


def test_linkage_of_bodies(spark):
    parser = BodyParser(MANDATES)
    places = [a + b for a in ("Dal", "Kel", "Mor", "Ven", "Tas", "Lur") for b in ("mar", "linford", "gavik", "odale", "untwick")]
    left = [(f"c{i}", f"{p} Office for {m[0]} | Bureau de {m[1]} de {p}", None) for i, (p, m) in enumerate((p, m) for p in places for m in MANDATES[:2])]
    right = [(i, f"{p} Ofice for {m[0]}", None) for i, (p, m) in enumerate((p, m) for p in places for m in MANDATES[:2])]
    left += [("cx", "North Dalmar Office for Heritage", ""), ("cy", None, None), ("cz", "DAHO - Dalmar", "Dalmar Office for Heritage"), left[0]]
    right += [(900, "Dalmar Office for Heritage", ""), (901, "South Dalmar Office for Heritage", None), (902, None, None)]
    c = body_records(spark.createDataFrame(left, "cid string, n1 string, n2 string"), "cid", ["n1", "n2"], parser, "c_")
    p = body_records(spark.createDataFrame(right, "pid int, n1 string, n2 string"), "pid", ["n1", "n2"], parser, "p_")
    out = link(c, p, "cid", "pid", BODY_PASSES, body_comparisons())
    found = {(r.cid, r.pid) for r in out.where("confidence >= 0.5").collect()}
    assert found == {(f"c{i}", i) for i in range(60)} | {("cz", 900)}
    assert link(c.limit(0), p, "cid", "pid", BODY_PASSES, body_comparisons()).count() == 0
    assert candidates(c, p, [("c_exact", "p_exact")], "cid", "pid").count() >= 60
    with pytest.raises(ValueError):
        link(c, p, "cid", "pid", BODY_PASSES, [Comparison(str(i), F.lit(0), 10) for i in range(6)])


def test_near_places_share_a_key():
    rng = random.Random(9)
    assert near_keys("zidekist") & near_keys("zofekist") and near_keys("a") & near_keys("b")
    for n in [1, 2, 6, 7, 8, 9, 11, 12, 40, *range(61, 69), 90]:
        for _ in range(40):
            a = "".join(rng.choice("abc") if i % 7 else rng.choice("abc ") for i in range(n)).strip().ljust(n, "d")
            b = list(a)
            for _ in range(2 if n >= 8 else 1):
                i, how = rng.randrange(len(b)), rng.randrange(3)
                b[i : i + 1] = [rng.choice("xyz ")] if how == 0 else [b[i], "x"] if how == 1 else [] if len(b) > 1 else b
            b = " ".join("".join(b).split())
            if b:
                assert near_keys(a) & near_keys(b), (a, b)
    assert all(len(near_keys("".join(rng.choice("abcdefgh") for _ in range(n)))) <= 2200 for n in (64, 70, 5000))


def test_two_edits_make_a_candidate(spark):
    parser = BodyParser(MANDATES)
    long = "".join(chr(97 + i * 7 % 26) for i in range(80))
    rows = [("a", "Zidekistor Office for Fisheries", 1), ("b", "Merovandia Office for Fisheries", 2), ("c", f"{long} Office for Fisheries", 3)]
    other = [(1, "Zofekistor Office for Fisheries"), (2, "Merowandya Office for Fisheries"), (3, f"{long[:30]}q{long[31:60]}q{long[61:]} Office for Fisheries")]
    c = body_records(spark.createDataFrame([r[:2] for r in rows], "cid string, n string"), "cid", ["n"], parser, "c_")
    p = body_records(spark.createDataFrame(other, "pid int, n string"), "pid", ["n"], parser, "p_")
    out = link(c, p, "cid", "pid", BODY_PASSES, body_comparisons())
    assert {(r.cid, r.pid, r.level_place) for r in out.collect()} == {("a", 1, 2), ("b", 2, 2), ("c", 3, 2)}


def test_hot_keys_keep_all_their_pairs(spark):
    """A place of more pairs than one part takes: bodies that share nothing else are candidates all the same."""
    left = spark.range(300).selectExpr("concat('l', id) AS l", "array('hot', concat('k', id % 50), '') AS lk", "id % 7 AS lx")
    right = spark.range(400).selectExpr("id AS r", "array('hot', concat('k', id % 40)) AS rk", "id % 7 AS rx")
    for hot in (1, 1000, LinkRules.hot, 10**9):
        got = candidates(left, right, [("lk", "rk", "loose")], "l", "r", hot)
        assert got.count() == 300 * 400 == got.distinct().count()
    out = link(left.limit(120), right.limit(120), "l", "r", [("lk", "rk", "loose")], [Comparison("x", F.when(F.col("lx") == F.col("rx"), 1).otherwise(0), 2)])
    assert out.count() == 120 * 120
    one = candidates(left.withColumn("lk", F.array(F.lit("a"))), right.where("r < 1").withColumn("rk", F.array(F.lit("a"))), [("lk", "rk", "loose")], "l", "r", 1)
    assert one.count() == 300 and candidates(left.limit(0), right, [("lk", "rk", "loose")], "l", "r", 1).count() == 0


def test_confidence_does_not_depend_on_size(spark, monkeypatch):
    """All records are others by chance, and together they count as much in a large table as in a small one."""
    ratios = []
    fit = LinkModel.fit
    monkeypatch.setattr(LinkModel, "fit", lambda self, patterns, counts, others: (ratios.append((others.sum() - 0.0) / counts.sum()), fit(self, patterns, counts, others))[1])
    for n in (400, 6000):
        left = spark.range(n).selectExpr("id AS l", "array(string(id)) AS lk", "id % 7 AS lx")
        right = spark.range(n).selectExpr("id AS r", "array(string(id)) AS rk", "id % 7 AS rx")
        out = link(left, right, "l", "r", [("lk", "rk")], [Comparison("x", F.when(F.col("lx") == F.col("rx"), 1).otherwise(0), 2)])
        assert out.count() == n
    assert ratios == pytest.approx([4.0, 4.0])
