"""Probabilistic record linkage between two tables without a common key.

Several blocking passes give candidate pairs; each pair becomes a pattern of agreement
levels; expectation-maximisation over the counted patterns estimates how often each level
occurs among matches and among others (conditionally independent, as Fellegi and Sunter
have it); the posterior of a pattern is the confidence of its pairs.

The model sees only pattern counts, of which there are no more than the product of the
numbers of levels, so the driver's share doesn't grow with the data.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kelda.llm.bodies import RECORD, TWO_EDITS
from kelda.session import cut_lineage


@dataclass(frozen=True)
class Comparison:
    """An agreement between the columns of both records: ``level`` gives 0 (disagree) up to levels - 1.

    ``unknown`` is the level that says nothing because one side lacks the attribute; it
    gets the same chance on both sides. ``like`` is a level of mere likeness: where the left
    record has another pair that is at the top level and disagrees in nothing, its own value
    is known on the right, and that a pair is at this level all the same is an agreement of
    its own, ``name``_alone, which EM weighs for itself. ``disagree`` is the largest share of
    matches that EM may take to be at level 0 of either: small for what makes records the
    same, which only damage can change.
    """

    name: str
    level: Column
    levels: int
    unknown: int | None = None
    like: int | None = None
    disagree: float = 1.0


@dataclass(frozen=True)
class LinkRules:
    """rounds and tolerance of EM; floor: least chance of a level; prior: first share of
    matches among candidates; patterns: most patterns the driver may take; per: a record is
    paired at random, as others, with at most about so many of the smaller side; weight: what
    the random pairs count together, in candidates, whatever the size of the tables, and ``beside`` where loose passes bring
    others of their own, which then show how others agree; hot:
    pairs of one key of a loose pass that are made at one place; a hotter key is spread over as
    many places as it needs."""

    rounds: int = 200
    tolerance: float = 1e-7
    floor: float = 1e-4
    prior: float = 0.5
    patterns: int = 100_000
    per: int = 10
    weight: float = 4.0
    beside: float = 0.5
    hot: int = 10_000


class LinkModel:
    """Chances of each level among matches (m) and others (u), and the share of matches."""

    def __init__(self, sizes: list[int], unknown: list[int | None], rules: LinkRules, most: list[dict[int, float]] | None = None) -> None:
        """most: per attribute, the largest share of matches at some levels."""
        self.sizes, self.unknown, self.rules = sizes, unknown, rules
        self.most = most or [{} for _ in sizes]
        self.m, self.u, self.share = [], [], rules.prior
        for n in sizes:
            # Matches mostly agree, others mostly don't; each attribute says as much at first, whatever its levels.
            up = np.exp2(np.linspace(0, 6, n))
            self.m.append(up / up.sum())
            self.u.append(up[::-1] / up.sum())

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        a, b = np.log(self.share), np.log1p(-self.share)
        for k in range(len(self.sizes)):
            a = a + np.log(self.m[k][patterns[:, k]])
            b = b + np.log(self.u[k][patterns[:, k]])
        return 1 / (1 + np.exp(np.clip(b - a, -50, 50)))

    def fit(self, patterns: np.ndarray, counts: np.ndarray, others: np.ndarray) -> LinkModel:
        """``others``: how often each pattern occurs among random pairs, which are taken for no matches."""
        if not counts.sum():
            return self
        total = counts.sum()
        for _ in range(self.rules.rounds):
            p = self.posterior(patterns) * counts
            q = counts - p + others
            moved = abs(p.sum() / total - self.share)
            self.share = float(np.clip(p.sum() / total, 1e-6, 1 - 1e-6))
            for k, n in enumerate(self.sizes):
                for side, w in ((self.m, p), (self.u, q)):
                    freq = np.bincount(patterns[:, k], w, n) + self.rules.floor * w.sum() / n
                    side[k] = freq / freq.sum()
                for level, most in self.most[k].items():
                    if self.m[k][level] > most:
                        self.m[k] *= (1 - most) / max(1e-12, 1 - self.m[k][level])
                        self.m[k][level] = most
                if (x := self.unknown[k]) is not None:
                    both = (self.m[k][x] * p.sum() + self.u[k][x] * q.sum()) / (p.sum() + q.sum())
                    for side in (self.m, self.u):
                        rest = 1 - side[k][x]
                        side[k] = side[k] * ((1 - both) / rest)
                        side[k][x] = both
            if moved < self.rules.tolerance:
                break
        return self


def candidates(left: DataFrame, right: DataFrame, passes: list[tuple], left_id: str, right_id: str, hot: int = LinkRules.hot) -> DataFrame:
    """Distinct (left_id, right_id) that share a key of some pass; a pass names an array column of keys on each side.

    A pass that has a third part, "loose", may have keys of very many pairs: one of more than
    ``hot`` is cut into parts of the left side, each with a copy of the right one, so that all
    pairs are made and none of its parts is a large task."""
    found = []
    for a, b, *loose in passes:
        x = left.select(left_id, F.explode(F.array_distinct(a)).alias("__key")).where(F.col("__key") != "")
        y = right.select(right_id, F.explode(F.array_distinct(b)).alias("__key")).where(F.col("__key") != "")
        on = ["__key"]
        if loose:
            many = x.groupBy("__key").agg(F.count("*").alias("n")).hint("merge").join(y.groupBy("__key").agg(F.count("*").alias("m")), "__key")
            # No more parts than rows on the left, so no more copies on the right than there are pairs.
            parts = many.select("__key", F.least("n", F.ceil(F.col("n") / hot * F.col("m"))).alias("__parts"))
            x = x.hint("merge").join(parts, "__key").withColumn("__part", F.pmod(F.xxhash64(F.lit("part"), left_id), "__parts"))
            y = y.hint("merge").join(parts, "__key").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))
            on.append("__part")
        # Sizes guessed before the explosion must not make it a broadcast.
        found.append(x.hint("merge").join(y.select(right_id, *on), on).select(left_id, right_id))
    return reduce(DataFrame.unionByName, found).distinct()


def link(left: DataFrame, right: DataFrame, left_id: str, right_id: str, passes: list[tuple], comparisons: list[Comparison], rules: LinkRules = LinkRules()) -> DataFrame:
    """Candidate pairs with their level columns and ``confidence``, the posterior of a match.

    ``left_id`` and ``right_id`` tell the rows of each side apart, and the sides share no
    column name. Records without any blocking key have no candidates; no pass means no pair.
    Empty sides give no pairs. Repeated records must be reduced to one before.
    """
    if prod(c.levels for c in comparisons) > rules.patterns:
        raise ValueError("too many agreement patterns for the driver")
    # Records are read by every pass, and pairs by the model and by the result.
    left, right = cut_lineage(left), cut_lineage(right)
    pairs = candidates(left, right, passes, left_id, right_id, rules.hot)
    names = [f"level_{c.name}" for c in comparisons]
    levels = [c.level.cast("int").alias(n) for c, n in zip(comparisons, names)]
    compared = pairs.join(left, left_id).join(right, right_id).select(left_id, right_id, *levels)
    agrees = reduce(lambda x, y: x & y, [F.col(n) > 0 for n in names], F.lit(True))
    for c, n in zip(comparisons, names):
        if c.like is not None:
            known = F.max((F.col(n) == c.levels - 1) & agrees).over(Window.partitionBy(left_id))
            compared = compared.withColumn(f"{n}_alone", F.when((F.col(n) == c.like) & known, 0).otherwise(1))
    compared = cut_lineage(compared)
    told = [c for c in comparisons if c.like is not None]
    every = [*names, *[f"level_{c.name}_alone" for c in told]]
    sizes, unknown = [*[c.levels for c in comparisons], *[2] * len(told)], [*[c.unknown for c in comparisons], *[None] * len(told)]
    most = [{0: c.disagree} for c in [*comparisons, *told]]

    # All records take part, in buckets whose number grows with the tables.
    buckets = max(1, min(left.count(), right.count()) // rules.per)
    at = lambda df, key: df.withColumn("__b", F.pmod(F.xxhash64(F.lit("random"), key), F.lit(buckets)))
    chance = at(left, left_id).hint("merge").join(at(right, right_id), "__b").select(*levels, *[F.lit(1).alias(n) for n in every[len(names) :]])
    # One row per pattern: at most the product of the levels, for each kind of pairs.
    both = compared.select(*every, F.lit(1).alias("c"), F.lit(0).alias("o")).unionByName(chance.select(*every, F.lit(0).alias("c"), F.lit(1).alias("o")))
    rows = both.groupBy(*every).agg(F.sum("c").alias("c"), F.sum("o").alias("o")).collect()
    patterns = np.array([[r[n] for n in every] for r in rows], dtype=np.int64).reshape(-1, len(every))
    counts, others = (np.array([r[x] for r in rows], dtype=float) for x in "co")
    others *= (rules.beside if any(len(p) > 2 for p in passes) else rules.weight) * counts.sum() / max(1.0, others.sum())
    model = LinkModel(sizes, unknown, rules, most)
    model.fit(patterns, counts, others)
    scores = model.posterior(patterns) if len(patterns) else np.zeros(0)
    table = [(*map(int, p), float(s)) for p, s in zip(patterns, scores)]
    known = left.sparkSession.createDataFrame(table, ", ".join(f"{n} int" for n in every) + ", confidence double")
    return compared.join(F.broadcast(known), every)


def body_records(rows: DataFrame, key: str, names: list[str], parser, prefix: str) -> DataFrame:
    """One record per key with all its names taken apart: ``prefix`` + places, mandates, kinds, bodies, acronyms and keys.

    Rows of one key are put together, so repeated rows change nothing; rows without a key
    are dropped; NULL and empty names say nothing.
    """
    shared = rows.sparkSession.sparkContext.broadcast(parser)
    parts = RECORD

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.record(t) for t in texts], columns=list(parts))

    read = F.pandas_udf(run, ", ".join(f"{p} array<string>" for p in parts))
    said = rows.where(F.col(key).isNotNull()).select(key, F.explode(F.array_compact(F.array(*names))).alias("n")).distinct()
    whole = said.groupBy(key).agg(F.sort_array(F.collect_list("n")).alias("n"))
    return whole.select(key, read("n").alias("r")).select(key, *[F.col(f"r.{p}").alias(f"{prefix}{p}") for p in parts])


#: Blocking passes: the same words, words a letter or two apart, letters where one side has no
#: more, and, loosely, places alone, so that bodies of one place that differ are seen too.
BODY_PASSES = [("c_cores", "p_cores", "loose"), ("c_like", "p_like", "loose"), ("c_exact", "p_exact"), ("c_near", "p_near")] + [
    (f"c_{a}{k}", f"p_{b}{k}") for k in ("lettered", "acronyms") for a, b in (("bare_", ""), ("", "bare_"))
]


def body_comparisons() -> list[Comparison]:
    """Agreement of two bodies' places, mandates, kinds and acronyms; what each is worth is for EM to find."""
    c, p = (lambda k: F.col(f"c_{k}")), (lambda k: F.col(f"p_{k}"))
    either = lambda k: (F.size(c(k)) == 0) | (F.size(p(k)) == 0)
    core = lambda x: F.split_part(x, F.lit("|"), F.lit(1))
    sides = lambda x: F.split_part(x, F.lit("|"), F.lit(2))
    # A typed place is like another within one edit, or two where it is long, if its side words are the same.
    alike = lambda x, y: (sides(x) == sides(y)) & (F.levenshtein(core(x), core(y)) <= F.when(F.length(core(x)) >= TWO_EDITS, 2).otherwise(1))
    near = F.exists(c("places"), lambda x: F.exists(p("places"), lambda y: alike(x, y)))
    place = F.when(F.arrays_overlap(c("places"), p("places")), 3).when(near, 2).when(either("places"), 1).otherwise(0)
    three = lambda k: F.when(F.arrays_overlap(c(k), p(k)), 2).when(either(k), 1).otherwise(0)
    # An acronym is made of the rest, so it is evidence only where one side has no full name.
    bare = (F.size(c("bodies")) == 0) | (F.size(p("bodies")) == 0)
    acronym = F.when(bare, three("acronyms")).otherwise(1)
    return [
        Comparison("place", place, 4, 1, like=2, disagree=0.02),
        Comparison("mandate", three("mandates"), 3, 1, disagree=0.02),
        Comparison("kind", three("kinds"), 3, 1),
        Comparison("acronym", acronym, 3, 1),
    ]
