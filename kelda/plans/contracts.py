"""Contract families, totals and mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kelda.functions.dates import day_sql, iso, readable_day
from kelda.functions.stats import upper_median
from kelda.operators.families import counts_with_zeros, expiring, families, mix, nested_totals, share_floor
from kelda.operators.ranking import upper_medians
from kelda.plans.registry import Catalog
from kelda.session import cut_lineage
from kelda.sources.tables import table

catalog = Catalog()


@catalog.query(
    "expiring_families",
    """SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS expiry, max(l_extendedprice) AS max_value, count(*) AS n_rows FROM lineitem
    GROUP BY l_orderkey HAVING CAST(max(l_shipdate) AS DATE) BETWEEN DATE '1998-06-01' AND DATE '1999-11-30' AND max(l_extendedprice) >= 5000
    ORDER BY expiry, max_value DESC, l_orderkey LIMIT 40""",
)
def expiring_families(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_orderkey", "l_shipdate", "l_extendedprice")
    return expiring(rows.withColumn("ends", F.col("l_shipdate").cast("date")), "l_orderkey", "l_extendedprice", "ends", "1998-06-01", "1999-11-30", 5000.0)


@catalog.query(
    "contract_families",
    f"""SELECT family_id, max(value) AS value, strftime(max({day_sql('contract_date')}), '%Y-%m-%d') AS last_signed,
      strftime(max({day_sql('period_end')}), '%Y-%m-%d') AS last_day, count(*) AS n_rows,
      arg_max(coalesce(vendor, ''), (coalesce(value, -1e300), coalesce({day_sql('contract_date')}, DATE '0001-01-01'), coalesce(reference, ''), coalesce(vendor, ''), coalesce(org, ''))) AS vendor,
      arg_max(coalesce(org, ''), (coalesce(value, -1e300), coalesce({day_sql('contract_date')}, DATE '0001-01-01'), coalesce(reference, ''), coalesce(vendor, ''), coalesce(org, ''))) AS org
    FROM contracts WHERE family_id IS NOT NULL GROUP BY family_id""",
)
def contract_families(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "contracts", "family_id", "reference", "vendor", "org", "value", "contract_date", "period_end").where("family_id IS NOT NULL")
    rows = rows.select(
        "family_id", "value", readable_day("contract_date").alias("signed"), readable_day("period_end").alias("ends"),
        F.coalesce("reference", F.lit("")).alias("reference"), F.coalesce("vendor", F.lit("")).alias("vendor"), F.coalesce("org", F.lit("")).alias("org"),
    )
    out = families(rows, ["family_id"], "value", ["signed", "ends"], ["vendor", "org"], ["signed", "reference"])
    return out.select("family_id", "value", iso("max_signed").alias("last_signed"), iso("max_ends").alias("last_day"), "n_rows", "vendor", "org")


@catalog.query(
    "family_summary",
    """WITH f AS (SELECT family_id, max(value) AS v FROM contracts WHERE family_id IS NOT NULL GROUP BY family_id)
    SELECT count(*) AS n_families, count(v) AS n_valued, round(sum(v), 0) AS total, percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN v > 0 THEN v END DESC) AS median_value FROM f""",
)
def family_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = cut_lineage(table(spark, d, "contracts", "family_id", "value").where("family_id IS NOT NULL").groupBy("family_id").agg(F.max("value").alias("v")))
    total = rows.agg(F.count("*").alias("n_families"), F.count("v").alias("n_valued"), F.round(F.sum("v"), 0).alias("total"))
    # Both sides are one row.
    return total.join(F.broadcast(upper_medians(rows.where("v > 0"), [], "v", "median_value")), F.lit(True), "left")


@catalog.query(
    "vendor_totals_nested",
    """WITH f AS (SELECT vendor_norm, family_id, max(value) AS v FROM contracts WHERE vendor_norm IS NOT NULL GROUP BY vendor_norm, family_id)
    SELECT vendor_norm, count(*) AS n_families, round(sum(v), 2) AS total FROM f GROUP BY vendor_norm ORDER BY total DESC NULLS LAST, vendor_norm LIMIT 25""",
)
def vendor_totals_nested(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "contracts", "vendor_norm", "family_id", "value").where("vendor_norm IS NOT NULL")
    return nested_totals(rows, "vendor_norm", "family_id", "value", 25)


@catalog.query(
    "agency_share_floor",
    """WITH f AS (SELECT owner_org, family_id, max(value) AS v FROM contracts WHERE owner_org IS NOT NULL GROUP BY owner_org, family_id),
    b AS (SELECT owner_org, count(*) AS n_families, round(sum(v), 2) AS total, percentile_disc(0.5) WITHIN GROUP (ORDER BY v DESC) AS median_value FROM f GROUP BY owner_org)
    SELECT * FROM b WHERE n_families >= 0.005 * (SELECT sum(n_families) FROM b)""",
)
def agency_share_floor(spark: SparkSession, d: str) -> DataFrame:
    return share_floor(table(spark, d, "contracts", "owner_org", "family_id", "value"), "owner_org", "family_id", "value", 0.005)


@catalog.query(
    "rows_by_slug_zeros",
    """SELECT i.owner_org, count(c.owner_org) AS n_rows FROM (SELECT DISTINCT owner_org FROM institution_list) i LEFT JOIN contracts c USING (owner_org) GROUP BY i.owner_org""",
)
def rows_by_slug_zeros(spark: SparkSession, d: str) -> DataFrame:
    return counts_with_zeros(table(spark, d, "institution_list", "owner_org"), table(spark, d, "contracts", "owner_org"), "owner_org")


@catalog.query(
    "incumbency",
    """SELECT owner_org, count(*) FILTER (WHERE solicitation_procedure IN ('TC', 'TN', 'OB')) AS competed, count(*) FILTER (WHERE solicitation_procedure IN ('ST', 'AC')) AS directed,
      count(*) FILTER (WHERE solicitation_procedure IS NULL OR solicitation_procedure = '') AS not_stated, count(*) AS n_rows,
      percentile_disc(0.5) WITHIN GROUP (ORDER BY number_of_bids DESC) AS median_bids, max(number_of_bids) AS most_bids, count(number_of_bids) AS reporting
    FROM contracts WHERE owner_org IS NOT NULL GROUP BY owner_org""",
)
def incumbency(spark: SparkSession, d: str) -> DataFrame:
    """How contracts were let, and bids among those that report them: missing is neither zero nor directed."""
    rows = table(spark, d, "contracts", "owner_org", "solicitation_procedure", "number_of_bids").where("owner_org IS NOT NULL")
    p = F.col("solicitation_procedure")
    tests = {"competed": p.isin("TC", "TN", "OB"), "directed": p.isin("ST", "AC"), "not_stated": p.isNull() | (p == "")}
    bids = rows.groupBy("owner_org").agg(upper_median("number_of_bids").cast("bigint").alias("median_bids"), F.max("number_of_bids").alias("most_bids"), F.count("number_of_bids").alias("reporting"))
    return mix(rows, ["owner_org"], tests).join(bids, "owner_org")


@catalog.query(
    "hhi_concentration",
    """WITH v AS (SELECT owner_org, vendor_norm, count(*) AS n FROM contracts WHERE owner_org IS NOT NULL AND vendor_norm IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT *, sum(n) OVER (PARTITION BY owner_org) AS total FROM v)
    SELECT owner_org, round(sum(power(n / total, 2)), 6) AS hhi, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_vendors FROM t GROUP BY owner_org""",
)
def hhi_concentration(spark: SparkSession, d: str) -> DataFrame:
    """Herfindahl index of vendors per body: sum of squares over the square of the sum, without a window."""
    rows = table(spark, d, "contracts", "owner_org", "vendor_norm").where("owner_org IS NOT NULL AND vendor_norm IS NOT NULL")
    n = rows.groupBy("owner_org", "vendor_norm").agg(F.count("*").alias("n"))
    return n.groupBy("owner_org").agg(
        F.round(F.sum(F.col("n").cast("double") * F.col("n")) / F.pow(F.sum("n").cast("double"), 2), 6).alias("hhi"), F.sum("n").alias("n_rows"), F.count("*").alias("n_vendors")
    )


@catalog.query(
    "procedure_pivot",
    """SELECT owner_org, count(*) FILTER (WHERE solicitation_procedure = 'TC') AS tc, count(*) FILTER (WHERE solicitation_procedure = 'TN') AS tn,
      count(*) FILTER (WHERE solicitation_procedure = 'OB') AS ob, count(*) FILTER (WHERE solicitation_procedure = 'AC') AS ac FROM contracts WHERE owner_org IS NOT NULL GROUP BY owner_org""",
)
def procedure_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Labels by body as columns; the labels are given, so no extra pass looks for them."""
    rows = table(spark, d, "contracts", "owner_org", "solicitation_procedure").where("owner_org IS NOT NULL")
    p = rows.groupBy("owner_org").pivot("solicitation_procedure", ["TC", "TN", "OB", "AC"]).count()
    return p.select("owner_org", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c.lower()) for c in ("TC", "TN", "OB", "AC")])


@catalog.query(
    "recency_filter",
    f"""SELECT family_id, reference, strftime(greatest({day_sql('contract_date')}, {day_sql('period_end')}), '%Y-%m-%d') AS latest FROM contracts
    WHERE greatest({day_sql('contract_date')}, {day_sql('period_end')}) >= DATE '2024-01-01' AND (contains(lower(description), 'cloud') OR contains(lower(description), 'network'))""",
)
def recency_filter(spark: SparkSession, d: str) -> DataFrame:
    """Contracts with a term in their description whose later known date is recent; rows without a date are left out."""
    rows = table(spark, d, "contracts", "family_id", "reference", "description", "contract_date", "period_end")
    low = F.lower("description")
    kept = rows.where((F.instr(low, "cloud") > 0) | (F.instr(low, "network") > 0))
    kept = kept.withColumn("latest", F.greatest(readable_day("contract_date"), readable_day("period_end")))
    return kept.where(F.col("latest") >= F.lit("2024-01-01").cast("date")).select("family_id", "reference", iso("latest").alias("latest"))


@catalog.query(
    "disclosure_quarters",
    r"""WITH q AS (SELECT reference, reporting_period, regexp_extract(reporting_period, '([0-9]{4})-[0-9]{4}-Q([1-4])', 1) AS y1, regexp_extract(reporting_period, '([0-9]{4})-[0-9]{4}-Q([1-4])', 2) AS q1,
      regexp_extract(reference, '([0-9]{4})-[0-9]{4}-Q([1-4])', 1) AS y2, regexp_extract(reference, '([0-9]{4})-[0-9]{4}-Q([1-4])', 2) AS q2 FROM contracts),
    m AS (SELECT *, greatest(CASE WHEN y1 <> '' THEN CAST(y1 AS INT) * 4 + CAST(q1 AS INT) END, CASE WHEN y2 <> '' THEN CAST(y2 AS INT) * 4 + CAST(q2 AS INT) END) AS k FROM q)
    SELECT reference, reporting_period, CASE WHEN k IS NOT NULL THEN strftime(CAST(make_date((k - 1) // 4, 4, 1) + to_months(CAST(3 * ((k - 1) % 4 + 1) AS INT)) AS DATE) - 1 + 30, '%Y-%m-%d') END AS public_by FROM m""",
)
def disclosure_quarters(spark: SparkSession, d: str) -> DataFrame:
    """Day by which a row is public: 30 days after the later of the quarters that its period and its reference name."""
    rows = table(spark, d, "contracts", "reference", "reporting_period")

    def quarter(c: str):
        pattern = r"([0-9]{4})-[0-9]{4}-Q([1-4])"
        return F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 1).try_cast("int") * 4 + F.regexp_extract(F.coalesce(c, F.lit("")), pattern, 2).try_cast("int")

    k = F.greatest(quarter("reporting_period"), quarter("reference"))
    start = F.make_date(F.floor((k - 1) / 4).cast("int"), F.lit(4), F.lit(1))
    public = F.date_add(F.add_months(start, 3 * ((k - 1) % 4 + 1)), 29)
    return rows.select("reference", "reporting_period", iso(F.when(k.isNotNull(), public)).alias("public_by"))
