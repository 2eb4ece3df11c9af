"""Notices: classification, closing windows, figures in prose, and the counted filter funnel.

The funnel is one array of stage results per row. Which stage drops a row first, which
stages would drop it at all, and every counter of a run are expressions over that array,
so a run is one pass however many stages it has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


def closing_window(closing: Column, today: Column, soon: int = 10, horizon: int = 10) -> Column:
    """STRUCT<window, days>: closed, imminent, open, standing (a year more than ``horizon`` away) or unknown."""
    days = F.date_diff(closing, today)
    far = F.year(closing) - F.year(today) > horizon
    window = F.when(closing.isNull(), "unknown").when(far, "standing").when(days < 0, "closed").when(days < soon, "imminent").otherwise("open")
    return F.struct(window.alias("window"), F.when(closing.isNotNull() & ~far, days).alias("days"))


def first_figure(text: Column) -> Column:
    """DOUBLE of the first dollar figure of a text, with thousands separators and a K, M or B behind it."""
    pattern = r"\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s?([KkMmBb]?)"
    number = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "").try_cast("double")
    unit = F.upper(F.regexp_extract(text, pattern, 2))
    return number * F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)


def date_conflict(text: Column, closing: Column) -> Column:
    """The first date that the prose gives for submission, if it is more than a day before the field's."""
    found = F.regexp_extract_all(text, F.lit(r"(?:submitted|received|close[sd]?|closing)[^.0-9]{0,40}([0-9]{4}-[0-9]{2}-[0-9]{2})"), F.lit(1))
    day = F.try_to_date(F.try_element_at(found, F.lit(1)), "yyyy-MM-dd")
    return F.when(F.date_diff(closing, day) > 1, day)


@dataclass(frozen=True)
class Stage:
    """A test of the funnel: ``drops`` is TRUE where a row goes; NULL means it stays. An inactive one never drops."""

    name: str
    drops: Column
    basis: Column | None = None
    active: bool = True


def with_stages(rows: DataFrame, stages: list[Stage]) -> DataFrame:
    """rows with ``stages`` (order, stage, outcome, basis), ``drops`` and ``first_drop`` (NULL: admitted)."""
    results = []
    for i, s in enumerate(stages):
        outcome = F.when(F.lit(not s.active), "inactive").when(F.coalesce(s.drops, F.lit(False)), "drop").otherwise("pass")
        basis = (s.basis if s.basis is not None else F.lit(None)).cast("string")
        results.append(F.struct(F.lit(i + 1).alias("order"), F.lit(s.name).alias("stage"), outcome.alias("outcome"), basis.alias("basis")))
    out = rows.withColumn("stages", F.array(*results))
    out = out.withColumn("drops", F.transform(F.filter("stages", lambda s: s["outcome"] == "drop"), lambda s: s["stage"]))
    return out.withColumn("first_drop", F.try_element_at("drops", F.lit(1)))


def reached(stages: Column = None) -> Column:
    """The stages that a run which stops at the first drop gets to see."""
    s = F.col("stages") if stages is None else stages
    first = F.try_element_at(F.transform(F.filter(s, lambda x: x["outcome"] == "drop"), lambda x: x["order"]), F.lit(1))
    return F.filter(s, lambda x: first.isNull() | (x["order"] <= first))


def funnel_counts(staged: DataFrame, stages: list[Stage]) -> DataFrame:
    """Per stage: rows it drops first, rows it would drop, rows it alone would drop; zeros shown.

    One pass of conditional sums; ``n_in`` is the same for all, and first drops and
    admitted rows add up to it.
    """
    sums = [F.count("*").alias("n_in"), F.count_if(F.col("first_drop").isNull()).alias("admitted")]
    for i, s in enumerate(stages):
        fires = F.array_contains("drops", s.name)
        sums += [F.count_if(F.coalesce(F.col("first_drop") == s.name, F.lit(False))).alias(f"f{i}"), F.count_if(fires).alias(f"a{i}"), F.count_if(fires & (F.size("drops") == 1)).alias(f"u{i}")]
    total = staged.agg(*sums)
    rows = [F.struct(F.lit(i + 1).alias("order"), F.lit(s.name).alias("stage"), F.col(f"f{i}").alias("first_drops"), F.col(f"a{i}").alias("fires"), F.col(f"u{i}").alias("alone")) for i, s in enumerate(stages)]
    return total.select("n_in", "admitted", F.inline(F.array(*rows)))


def classify(rules: list[tuple[str, str, Column]], otherwise: tuple[str, str] = ("unknown", "none")) -> Column:
    """STRUCT<kind, basis> by the first rule whose test holds: (kind, basis, test)."""
    out: Column | None = None
    for kind, basis, test in rules:
        answer = F.struct(F.lit(kind).alias("kind"), F.lit(basis).alias("basis"))
        out = F.when(test, answer) if out is None else out.when(test, answer)
    last = F.struct(F.lit(otherwise[0]).alias("kind"), F.lit(otherwise[1]).alias("basis"))
    return last if out is None else out.otherwise(last)
