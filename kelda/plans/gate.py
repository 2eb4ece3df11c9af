"""Curves, misses, budgets, options and evidence around a score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kelda.functions import text as T
from kelda.functions.dates import day_sql, readable_day
from kelda.operators.gate import MASS_BINS, THRESHOLDS, corpus_budget, leak_audit, method_curve, misses, nested_evidence, option_list
from kelda.operators.sampling import per_outcome
from kelda.plans.evaluation import SCORED, scored
from kelda.plans.notices import CODES, KEY, PREFIXES
from kelda.plans.registry import Catalog
from kelda.sources.tables import table

catalog = Catalog()

_ROWS = f"(SELECT *, o_custkey % 3 = 0 AS plain FROM {SCORED})"
_DAY = "DATE '2020-01-01'"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).withColumn("plain", F.col("o_custkey") % 3 == 0)


@catalog.query(
    "method_curve",
    " UNION ALL ".join(
        f"""SELECT CAST({t} AS DOUBLE) AS threshold, count(*) FILTER (WHERE mass >= {t}) AS admitted, count(*) FILTER (WHERE mass >= {t} AND truth) AS hits, round(count(*) FILTER (WHERE mass >= {t} AND truth) / nullif(count(*) FILTER (WHERE truth), 0), 6) AS recall,
      round(count(*) FILTER (WHERE mass >= {t} AND truth) / nullif(count(*) FILTER (WHERE mass >= {t}), 0), 6) AS precision, count(*) FILTER (WHERE mass >= {t} AND plain) AS "both", count(*) FILTER (WHERE mass >= {t} AND NOT plain) AS only_mass,
      count(*) FILTER (WHERE mass < {t} AND plain) AS only_plain, count(*) FILTER (WHERE mass < {t} AND NOT plain) AS neither FROM {_ROWS}"""
        for t in THRESHOLDS
    ),
)
def curve(spark: SparkSession, d: str) -> DataFrame:
    """All 24 thresholds: recall, precision, and the overlap with a plain method."""
    return method_curve(_scored(spark, d), "mass", "truth", "plain")


_BIN = "CASE " + " ".join(f"WHEN mass >= {a} AND mass < {b} THEN CAST({a} AS DOUBLE)" for a, b in zip(MASS_BINS, MASS_BINS[1:])) + " END"


@catalog.query("mass_misses", f"SELECT {_BIN} AS bin, count(*) AS missed, count(*) FILTER (WHERE NOT plain) AS missed_by_both FROM {_ROWS} WHERE truth AND mass < 0.6 GROUP BY 1")
def mass_misses(spark: SparkSession, d: str) -> DataFrame:
    return misses(_scored(spark, d), "mass", "truth", "plain", 0.6)


@catalog.query(
    "corpus_budget",
    " UNION ALL ".join(
        f"""SELECT CAST({t} AS DOUBLE) AS threshold, count(*) FILTER (WHERE mass >= {t}) AS admitted, round(count(*) FILTER (WHERE mass >= {t}) / nullif(count(*), 0), 6) AS rate, round(count(*) FILTER (WHERE mass >= {t}) / nullif(count(*), 0) * 900, 2) AS expected,
      CAST(coalesce(sum(o_custkey) FILTER (WHERE mass >= {t}), 0) AS BIGINT) AS cost FROM {_ROWS} WHERE NOT plain"""
        for t in THRESHOLDS
    ),
)
def budget(spark: SparkSession, d: str) -> DataFrame:
    """What each threshold would make of a feed of 900 rows, and what it would cost."""
    return corpus_budget(_scored(spark, d), ~F.col("plain"), "mass", "o_custkey", 900)


_SEGMENTS = sorted({p[:2] for p in PREFIXES})


@catalog.query(
    "profile_gap",
    f"""WITH n AS (SELECT DISTINCT reference_number, amendment_number, {CODES} AS codes FROM notices),
    r AS (SELECT reference_number, amendment_number, unnest(codes) AS code FROM n WHERE len(codes) > 0 AND NOT ({' OR '.join(f"len(list_filter(codes, lambda c: starts_with(c, '{p}'))) > 0" for p in PREFIXES)}))
    SELECT code, count(*) AS n_notices FROM r WHERE left(code, 2) IN ({', '.join(f"'{s}'" for s in _SEGMENTS)}) GROUP BY 1""",
)
def profile_gap(spark: SparkSession, d: str) -> DataFrame:
    """Codes near the profile that rejected notices carry: in its segments, but of none of its families."""
    codes = T.parse_codes("unspsc")
    n = table(spark, d, "notices", *KEY, "unspsc").select(*KEY, codes.alias("codes")).distinct()
    rejected = n.where((F.size("codes") > 0) & (F.size(T.matched_prefixes(F.col("codes"), PREFIXES)) == 0))
    return rejected.select(F.explode("codes").alias("code")).where(F.left("code", F.lit(2)).isin(_SEGMENTS)).groupBy("code").agg(F.count("*").alias("n_notices"))


@catalog.query(
    "option_list",
    """WITH f AS (SELECT DISTINCT left(commodity_code, 4) AS f FROM contracts WHERE length(left(commodity_code, 4)) = 4)
    SELECT '1:' || p AS place, 'profile' AS kind, p AS option FROM (SELECT unnest(['4321', '7710', '80']) AS p) UNION ALL SELECT '2:' || f, 'sibling', f FROM f WHERE left(f, 2) IN ('43', '77', '80') AND NOT starts_with(f, '4321') AND NOT starts_with(f, '7710') AND NOT starts_with(f, '80') AND NOT starts_with(f, '4320')
    UNION ALL SELECT DISTINCT '3:' || left(f, 2), 'segment', left(f, 2) FROM f WHERE left(f, 2) NOT IN ('43', '77', '80') UNION ALL SELECT '4:', 'none', ''""",
)
def options(spark: SparkSession, d: str) -> DataFrame:
    """Families that an imputer may choose from."""
    return option_list(table(spark, d, "contracts", "commodity_code"), "commodity_code", ["4321", "7710", "80"], ["4320"])


_SOURCES = {
    "notices": ("SELECT trim(unnest(string_split(org_keys, ','))) AS dept_key, publication_date AS day FROM notices", "publication_date"),
    "contracts": ("SELECT dept_key, disclosure_date AS day FROM contracts_disclosed", "disclosure_date"),
}


@catalog.query(
    "evidence_conditions",
    f"""WITH a AS (SELECT dept_key, count(*) AS n FROM (SELECT dept_key, {day_sql('day')} AS day FROM ({_SOURCES['notices'][0]})) WHERE dept_key <> '' AND day <= {_DAY} GROUP BY 1),
    b AS (SELECT dept_key, count(*) AS n FROM (SELECT dept_key, {day_sql('day')} AS day FROM ({_SOURCES['contracts'][0]})) WHERE dept_key IS NOT NULL AND day <= {_DAY} GROUP BY 1)
    SELECT dept_key, unnest(['A', 'B']) AS condition, 'notices' AS source, n FROM a UNION ALL SELECT dept_key, 'B', 'contracts', n FROM b""",
)
def evidence_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Notices, then notices and contracts, that were known of each body by a day."""
    n = table(spark, d, "notices", "org_keys", "publication_date").select(F.explode(T.split_keys("org_keys")).alias("dept_key"), readable_day("publication_date").alias("day"))
    c = table(spark, d, "contracts_disclosed", "dept_key", "disclosure_date").select("dept_key", readable_day("disclosure_date").alias("day"))
    return nested_evidence("dept_key", [("notices", n, "day"), ("contracts", c, "day")], F.lit("2020-01-01").cast("date"))


@catalog.query("leak_audit", f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE {day_sql('disclosure_date')} > {_DAY}) AS late, 'value' AS suppressed FROM contracts_disclosed")
def audit_of_leaks(spark: SparkSession, d: str) -> DataFrame:
    """What a set of contracts would give away if it were used for cases of a day."""
    rows = table(spark, d, "contracts_disclosed", "disclosure_date", "value").withColumn("day", readable_day("disclosure_date"))
    return leak_audit(rows, ["day"], F.lit("2020-01-01").cast("date"), ["value", "vendor"])


@catalog.query(
    "identity_section",
    "SELECT dept_key, kind, count(c.family_id) AS n_contracts FROM institution_list LEFT JOIN (SELECT dept_key AS k, family_id FROM contracts_disclosed WHERE family_id IS NOT NULL) c ON c.k = dept_key GROUP BY 1, 2",
)
def identity_section(spark: SparkSession, d: str) -> DataFrame:
    """Every listed body with the rows it contributes, zeros shown; contracts are counted before they are joined."""
    n = table(spark, d, "contracts_disclosed", "dept_key", "family_id").where("family_id IS NOT NULL").groupBy("dept_key").agg(F.count("*").alias("n"))
    return table(spark, d, "institution_list", "dept_key", "kind").join(n, "dept_key", "left").select("dept_key", "kind", F.coalesce("n", F.lit(0)).alias("n_contracts"))


@catalog.query(
    "golden_seed",
    f"""WITH r AS (SELECT o_orderkey, mass >= 0.6 AS admitted, row_number() OVER (PARTITION BY mass >= 0.6 ORDER BY sha256(CAST(o_orderkey AS VARCHAR) || ':7'), o_orderkey) AS k FROM {SCORED})
    SELECT o_orderkey, admitted, sha256(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(admitted AS VARCHAR))) AS row_hash FROM r WHERE k <= 25""",
)
def golden_seed(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 admitted and rejected rows in random order, with a hash by which a change of a row is seen."""
    few = per_outcome(scored(spark, d).withColumn("admitted", F.col("mass") >= 0.6), "admitted", "o_orderkey", 25, 7)
    return few.select("o_orderkey", "admitted", F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("admitted").cast("string")), 256).alias("row_hash"))


@catalog.query(
    "parked_summary",
    """WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) FILTER (WHERE event_type = 'click') AS last_trigger FROM events GROUP BY 1)
    SELECT CASE WHEN state = 'purchase' THEN 'closed' ELSE 'open' END AS list, count(*) AS n_users, count(last_trigger) AS with_trigger, max(last_trigger) AS last_trigger FROM l GROUP BY 1""",
)
def parked_summary(spark: SparkSession, d: str) -> DataFrame:
    """Open and closed cases by their latest event, with the last one that could reopen them."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max(F.when(F.col("event_type") == "click", F.col("ts"))).alias("t"))
    return last.groupBy(F.when(F.col("state") == "purchase", "closed").otherwise("open").alias("list")).agg(F.count("*").alias("n_users"), F.count("t").alias("with_trigger"), F.max("t").alias("last_trigger"))
