"""p3, p6 and p7: periods, histories and facts as known at event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kelda.functions.dates import day_sql, iso, readable_day
from kelda.operators.asof import asof_join
from kelda.operators.history import latest_delivery, version_history, version_order
from kelda.operators.intervals import merge_intervals
from kelda.plans.registry import Catalog
from kelda.session import cut_lineage
from kelda.sources.tables import table

catalog = Catalog()

_P3 = f"""
WITH spans AS (
  SELECT DISTINCT vendor_norm, org, {day_sql("period_start")} AS s, {day_sql('period_end')} AS e FROM contracts
  WHERE vendor_norm IS NOT NULL AND org IS NOT NULL),
reach AS (
  SELECT *, max(e) OVER (PARTITION BY vendor_norm, org ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r
  FROM spans WHERE s <= e),
islands AS (
  SELECT *, sum(CASE WHEN r IS NULL OR s > r + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY vendor_norm, org ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM reach),
periods AS (SELECT vendor_norm, org, i, min(s) AS s, max(e) AS e FROM islands GROUP BY vendor_norm, org, i),
gaps AS (SELECT vendor_norm, org, e + 1 AS s, lead(s) OVER (PARTITION BY vendor_norm, org ORDER BY s) - 1 AS e FROM periods)
SELECT vendor_norm, org, 'period' AS kind, strftime(s, '%Y-%m-%d') AS date_from, strftime(e, '%Y-%m-%d') AS date_to FROM periods
UNION ALL
SELECT vendor_norm, org, 'gap', strftime(s, '%Y-%m-%d'), strftime(e, '%Y-%m-%d') FROM gaps WHERE e IS NOT NULL
"""


@catalog.query("p3_found", _P3)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous contract periods and gaps per vendor_norm and org."""
    rows = table(spark, d, "contracts", "vendor_norm", "org", "period_start", "period_end")
    spans = rows.select("vendor_norm", "org", readable_day("period_start").alias("first"), readable_day("period_end").alias("last"))
    out = merge_intervals(spans, ["vendor_norm", "org"], "first", "last")
    return out.select("vendor_norm", "org", "kind", iso("first_day").alias("date_from"), iso("last_day").alias("date_to"))


_P6 = f"""
WITH RECURSIVE given AS (
  SELECT reg_id, coalesce(reg_base, regexp_replace(reg_num, '-[^-]*$', '')) AS reg_base, version_seq, prev_reg_id,
    {day_sql('effective_date')} AS eff, {day_sql('end_date')} AS fin, {day_sql('posted_date')} AS posted, client_num, registrant_num, firm_name
  FROM registration_versions),
v AS (SELECT * FROM given WHERE reg_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY reg_id ORDER BY posted DESC NULLS LAST, reg_base DESC NULLS LAST, eff DESC NULLS LAST, fin DESC NULLS LAST) = 1),
placed(reg_id, pos, n) AS (
  SELECT reg_id, CAST(version_seq AS DOUBLE), 0 FROM v WHERE version_seq IS NOT NULL
  UNION ALL
  SELECT b.reg_id, p.pos + power(0.5, p.n + 1), p.n + 1 FROM v b JOIN placed p ON b.prev_reg_id = p.reg_id WHERE b.version_seq IS NULL),
ahead AS (SELECT prev_reg_id AS reg_id, min(version_seq) - 0.5 AS pos FROM v WHERE version_seq IS NOT NULL AND prev_reg_id IS NOT NULL GROUP BY 1),
p AS (SELECT v.*, coalesce(placed.pos, ahead.pos, CAST('-inf' AS DOUBLE)) AS pos FROM v LEFT JOIN placed USING (reg_id) LEFT JOIN ahead USING (reg_id)
  WHERE reg_base IS NOT NULL AND eff IS NOT NULL),
q AS (SELECT *, min(eff) OVER (PARTITION BY reg_base ORDER BY pos DESC, eff DESC, reg_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nxt FROM p),
f AS (SELECT *, least(CASE WHEN fin >= eff THEN fin END, nxt) AS til FROM q),
g AS (SELECT * FROM f WHERE til IS NULL OR eff < til),
h AS (SELECT *, CASE WHEN lag(til) OVER w IS NOT DISTINCT FROM eff AND lag(client_num) OVER w IS NOT DISTINCT FROM client_num
    AND lag(registrant_num) OVER w IS NOT DISTINCT FROM registrant_num AND lag(firm_name) OVER w IS NOT DISTINCT FROM firm_name THEN 0 ELSE 1 END AS starts
  FROM g WINDOW w AS (PARTITION BY reg_base ORDER BY eff)),
k AS (SELECT *, sum(starts) OVER (PARTITION BY reg_base ORDER BY eff) AS run FROM h)
SELECT reg_base, arg_min(reg_id, eff) AS reg_id, strftime(min(eff), '%Y-%m-%d') AS valid_from,
  CASE WHEN bool_or(til IS NULL) THEN '' ELSE strftime(max(til), '%Y-%m-%d') END AS valid_to
FROM k GROUP BY reg_base, run
"""


@catalog.query("p6_found", _P6)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Per reg_base the periods in which its versions were in force."""
    attributes = ["client_num", "registrant_num", "firm_name"]
    rows = table(
        spark, d, "registration_versions", "reg_id", "reg_num", "reg_base", "version_seq", "effective_date", "end_date", "prev_reg_id", "posted_date", *attributes
    ).select(
        "reg_id",
        F.coalesce("reg_base", F.regexp_replace("reg_num", "-[^-]*$", "")).alias("reg_base"),
        "version_seq",
        "prev_reg_id",
        readable_day("posted_date").alias("posted"),
        readable_day("effective_date").alias("starts"),
        readable_day("end_date").alias("ends"),
        *attributes,
    )
    # Placing versions reads them several times, so they are reduced once.
    placed = version_order(cut_lineage(latest_delivery(rows, "reg_id", "posted")), "reg_id", "version_seq", "prev_reg_id")
    out = version_history(placed, ["reg_base"], "reg_id", "__pos", "starts", "ends", attributes)
    return out.select("reg_base", "reg_id", iso("valid_from").alias("valid_from"), F.coalesce(iso("valid_to"), F.lit("")).alias("valid_to"))


_P7 = f"""
WITH seen AS (
  SELECT reference_number, amendment_number, solicitation_number, org_keys, {day_sql('first_seen')} AS day, first_seen FROM notices),
n AS (SELECT * FROM seen WHERE day IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY reference_number, amendment_number ORDER BY day, first_seen, solicitation_number DESC NULLS LAST, org_keys DESC NULLS LAST) = 1),
k AS (SELECT reference_number, amendment_number, solicitation_number, day, trim(unnest(string_split(org_keys, ','))) AS dept_key FROM n),
c AS (SELECT substr(family_id, strpos(family_id, ':') + 1) AS number, dept_key, reference, {day_sql('disclosure_date')} AS disclosed, {day_sql('contract_date')} AS signed
  FROM contracts_disclosed WHERE strpos(family_id, ':') > 0)
SELECT k.reference_number, k.amendment_number, c.reference, strftime(c.disclosed, '%Y-%m-%d') AS disclosure_date
FROM k JOIN c ON c.number = k.solicitation_number AND c.dept_key = k.dept_key AND c.disclosed <= k.day
QUALIFY row_number() OVER (PARTITION BY k.reference_number, k.amendment_number ORDER BY c.disclosed DESC, c.signed DESC NULLS LAST, c.reference DESC NULLS LAST) = 1
"""


@catalog.query("p7_found", _P7)
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """For each notice the contract of its procurement as disclosed by the day it was first seen."""
    key = ["reference_number", "amendment_number"]
    seen = table(spark, d, "notices", *key, "solicitation_number", "org_keys", "first_seen").select(
        *key, "solicitation_number", "org_keys", "first_seen", readable_day("first_seen").alias("day")
    )
    first = F.min(F.struct("day", "first_seen", F.struct("solicitation_number", "org_keys").alias("rest"))).alias("f")
    notices = seen.where(F.col("day").isNotNull()).groupBy(*key).agg(first)
    events = notices.select(
        *key,
        F.col("f.day").alias("day"),
        F.col("f.rest.solicitation_number").alias("number"),
        F.explode(F.array_distinct(F.transform(F.split("f.rest.org_keys", ","), lambda k: F.trim(k)))).alias("dept_key"),
    )
    disclosed = table(spark, d, "contracts_disclosed", "family_id", "reference", "contract_date", "disclosure_date", "dept_key")
    versions = disclosed.where(F.instr("family_id", ":") > 0).select(
        F.expr("substring(family_id, instr(family_id, ':') + 1)").alias("number"),
        "dept_key",
        "reference",
        readable_day("contract_date").alias("signed"),
        readable_day("disclosure_date").alias("disclosed"),
    )
    joined = asof_join(events, versions, ["number", "dept_key"], "day", "disclosed", ["signed", "reference"], [F.col("signed"), F.col("reference")])
    best = joined.where(F.col("disclosed").isNotNull()).groupBy(*key).agg(F.max(F.struct("disclosed", "signed", "reference")).alias("b"))
    return best.select(*key, F.col("b.reference").alias("reference"), iso("b.disclosed").alias("disclosure_date"))
