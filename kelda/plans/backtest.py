"""Backtests over customers and years: what was known before a year against what came in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kelda.functions.stats import binomial_two_sided
from kelda.operators.backtest import FEATURES, leave_one_out, lift_in_strata, shuffle_control, verdict, yearly_panel
from kelda.operators.evaluate import discordant, size_strata
from kelda.plans.evaluation import SCORED, scored
from kelda.plans.registry import Catalog
from kelda.sources.tables import table

catalog = Catalog()

YEARS = [1998, 1999, 2000]
_PANEL = f"""WITH o AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS y, o_orderpriority AS k, o_totalprice AS v FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL),
  every AS (SELECT DISTINCT o_custkey, CAST(unnest({YEARS}) AS INT) AS year FROM o),
  kinds AS (SELECT o_custkey, year, sum(n * n) AS squares FROM (SELECT e.o_custkey, e.year, k, count(*) AS n FROM every e JOIN o USING (o_custkey) WHERE y < year GROUP BY ALL) GROUP BY ALL),
  p AS (SELECT e.o_custkey, e.year, count(v) FILTER (WHERE y < year) AS n_prior, count(v) FILTER (WHERE y = year - 1) AS n_last, max(v) FILTER (WHERE y < year) AS most,
    max(v) FILTER (WHERE y < year AND y >= year - 2) AS most_24, max(y) FILTER (WHERE y < year) AS latest, count(v) FILTER (WHERE y = year) AS after FROM every e JOIN o USING (o_custkey) GROUP BY ALL),
  panel AS (SELECT o_custkey, year, n_prior, n_last, most, most_24, (SELECT max(v) FROM o WHERE o.o_custkey = p.o_custkey AND o.y = p.latest) AS latest_most, round(squares / nullif(n_prior * n_prior, 0), 6) AS hhi,
    CAST(n_last > 0 AS INT) AS lag, year - latest AS idle_years, after FROM p LEFT JOIN kinds USING (o_custkey, year))"""
_SIGNALS = {"frequent": "n_last >= 2", "large": "coalesce(most_24 >= 250000, FALSE)", "focused": "coalesce(hhi >= 0.5, FALSE)", "idle": "coalesce(idle_years > 1, TRUE)"}


def _panel(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority").withColumn("y", F.year("o_orderdate"))
    return yearly_panel(o, "o_custkey", "y", "o_totalprice", "o_orderpriority", YEARS)


@catalog.query("backtest_panel", f"{_PANEL} SELECT * FROM panel")
def backtest_panel(spark: SparkSession, d: str) -> DataFrame:
    """Eight features of every customer before each year, and the orders of the year."""
    return _panel(spark, d)


_STRATA = f"""{_PANEL}, pooled AS (SELECT *, n_prior * 1.0 AS size FROM panel WHERE year = {YEARS[-1]}),
  ranked AS (SELECT *, row_number() OVER (ORDER BY n_prior, o_custkey) - 1 AS k, count(*) OVER () AS total FROM pooled),
  s AS (SELECT CAST(least(k // greatest(total // 3, 1), 2) AS INT) AS stratum, after > 1 AS hit, {', '.join(f'{t} AS {n}' for n, t in _SIGNALS.items())} FROM ranked),
  f AS ({' UNION ALL '.join(f"SELECT stratum, hit, '{n}' AS signal, {n} AS on_ FROM s" for n in _SIGNALS)}),
  c AS (SELECT stratum, signal, count(*) FILTER (WHERE on_) AS n_signal, count(*) FILTER (WHERE on_ AND hit) AS n_hits, count(*) AS n, count(*) FILTER (WHERE hit) AS b FROM f GROUP BY 1, 2),
  w AS (SELECT *, n_hits / nullif(n_signal, 0) AS p, b / n AS base FROM c),
  l AS (SELECT *, CASE WHEN n_signal = 0 THEN 0.0 ELSE greatest(0.0, (p + 3.8416 / (2 * n_signal)) / (1 + 3.8416 / n_signal) - 1.96 * sqrt(p * (1 - p) / n_signal + 3.8416 / (4.0 * n_signal * n_signal)) / (1 + 3.8416 / n_signal)) END AS low_,
    CASE WHEN n_signal = 0 THEN 1.0 ELSE least(1.0, (p + 3.8416 / (2 * n_signal)) / (1 + 3.8416 / n_signal) + 1.96 * sqrt(p * (1 - p) / n_signal + 3.8416 / (4.0 * n_signal * n_signal)) / (1 + 3.8416 / n_signal)) END AS high_ FROM w),
  lifts AS (SELECT stratum, signal, n_signal, n_hits, round(p, 6) AS rate, round(low_, 6) AS low, round(high_, 6) AS high, round(base, 6) AS base, round(p / nullif(base, 0), 6) AS lift, low_ > base OR high_ < base AS significant FROM l)"""


def _lifts(spark: SparkSession, d: str) -> DataFrame:
    rows = size_strata(_panel(spark, d).where(F.col("year") == YEARS[-1]), "n_prior", "o_custkey")
    return lift_in_strata(rows.select("stratum", (F.col("after") > 1).alias("hit"), *[F.expr(t).alias(n) for n, t in _SIGNALS.items()]), "stratum", list(_SIGNALS), "hit")


@catalog.query("stratified_lift", f"{_STRATA} SELECT * FROM lifts")
def stratified_lift(spark: SparkSession, d: str) -> DataFrame:
    """Lift of each signal within thirds of customers by size, with bounds."""
    return _lifts(spark, d)


@catalog.query("lift_verdict", f"{_STRATA} SELECT count(*) AS comparisons, count(*) FILTER (WHERE lift > 1) AS above, count(*) FILTER (WHERE lift > 1 AND significant) AS significant FROM lifts")
def lift_verdict(spark: SparkSession, d: str) -> DataFrame:
    return verdict(_lifts(spark, d))


@catalog.query("leave_one_year_out")
def leave_one_year_out(spark: SparkSession, d: str) -> DataFrame:
    """Precision among the ten best customers of each year by a fit on the other years, and by size; tested against numpy."""
    return leave_one_out(_panel(spark, d).withColumn("hit", F.col("after") > 1), "o_custkey", "year", FEATURES, "hit", "n_prior")


@catalog.query(
    "mcnemar",
    f"""WITH c AS (SELECT count(*) FILTER (WHERE a AND b) AS "both", count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS neither
      FROM (SELECT (mass >= 0.31) = truth AS a, (mass >= 0.3) = truth AS b FROM {SCORED}))
    SELECT "both", only_a, only_b, neither, round((SELECT least(1.0, 2 * sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2)))) FROM range(0, least(only_a, only_b) + 1) t(i)), 6) AS p_value FROM c""",
)
def mcnemar(spark: SparkSession, d: str) -> DataFrame:
    """Two thresholds compared on the same rows: the discordant counts and their exact p-value."""
    n = discordant(scored(spark, d), (F.col("mass") >= 0.31) == F.col("truth"), (F.col("mass") >= 0.3) == F.col("truth"))
    return n.withColumn("p_value", F.round(binomial_two_sided(F.col("only_a"), F.col("only_b")), 6))


@catalog.query("shuffle_control")
def shuffled(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of a threshold against 2,000 shuffles of the truth; tested against the expectation."""
    return shuffle_control(scored(spark, d).withColumn("decided", F.col("mass") >= 0.6), "decided", "truth")
