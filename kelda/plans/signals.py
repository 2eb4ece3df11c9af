"""Lobbying records: communications, office holders, registrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kelda.functions.dates import day_sql, iso, readable_day
from kelda.functions.text import registration_base, registration_sequence
from kelda.operators.signals import having, in_force_at, in_force_grid, nest, orphans
from kelda.plans.registry import Catalog
from kelda.sources.tables import table

catalog = Catalog()
_COMM = "(SELECT DISTINCT * FROM communications)"


def _communications(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "communications").distinct()


@catalog.query(
    "semi_department",
    f"""SELECT c.reg_type_label, count(*) AS n_rows, count(DISTINCT c.comlog_id) AS n_communications FROM {_COMM} c
    WHERE EXISTS (SELECT 1 FROM communication_dpohs x WHERE x.comlog_id = c.comlog_id AND x.institution_kind = 'department')
      AND EXISTS (SELECT 1 FROM communication_dpohs x WHERE x.comlog_id = c.comlog_id AND lower(x.dpoh_title) LIKE '%director%') GROUP BY 1""",
)
def semi_department(spark: SparkSession, d: str) -> DataFrame:
    """Communications with some office holder of a department and some director."""
    people = table(spark, d, "communication_dpohs", "comlog_id", "institution_kind", "dpoh_title")
    kept = having(_communications(spark, d), people, "comlog_id", F.col("institution_kind") == "department", F.lower("dpoh_title").contains("director"))
    return kept.groupBy("reg_type_label").agg(F.count("*").alias("n_rows"), F.countDistinct("comlog_id").alias("n_communications"))


@catalog.query(
    "nest_children",
    f"""WITH p AS (SELECT DISTINCT comlog_id, comm_date FROM {_COMM} WHERE comm_date IS NOT NULL AND comlog_id IS NOT NULL ORDER BY comm_date DESC, comlog_id LIMIT 100)
    SELECT p.comlog_id, p.comm_date, count(x.dpoh_id) AS n_people, coalesce(string_agg(CAST(x.dpoh_id AS VARCHAR), ',' ORDER BY x.dpoh_id), '') AS people
    FROM p LEFT JOIN (SELECT DISTINCT comlog_id, dpoh_id FROM communication_dpohs) x USING (comlog_id) GROUP BY 1, 2""",
)
def nest_children(spark: SparkSession, d: str) -> DataFrame:
    """The latest hundred communications with their office holders nested."""
    page = _communications(spark, d).where("comm_date IS NOT NULL AND comlog_id IS NOT NULL").select("comlog_id", "comm_date").distinct().orderBy(F.col("comm_date").desc(), "comlog_id").limit(100)
    people = table(spark, d, "communication_dpohs", "comlog_id", "dpoh_id").distinct()
    out = nest(page, people, "comlog_id", "people", ["dpoh_id"])
    ids = F.array_join(F.transform("people", lambda x: x["dpoh_id"].cast("string")), ",")
    return out.select("comlog_id", "comm_date", F.size("people").cast("bigint").alias("n_people"), ids.alias("people"))


@catalog.query(
    "top_clients",
    f"""SELECT client_norm, count(DISTINCT c.comlog_id) AS n_communications, count(DISTINCT x.dept_key) AS n_departments, min(client_name) AS display FROM {_COMM} c
    LEFT JOIN communication_dpohs x ON x.comlog_id = c.comlog_id WHERE client_norm IS NOT NULL GROUP BY client_norm ORDER BY n_communications DESC, client_norm LIMIT 15""",
)
def top_clients(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "communication_dpohs", "comlog_id", "dept_key")
    joined = _communications(spark, d).where("client_norm IS NOT NULL").select("comlog_id", "client_norm", "client_name").join(people, "comlog_id", "left")
    out = joined.groupBy("client_norm").agg(F.countDistinct("comlog_id").alias("n_communications"), F.countDistinct("dept_key").alias("n_departments"), F.min("client_name").alias("display"))
    return out.orderBy(F.col("n_communications").desc(), "client_norm").limit(15)


@catalog.query(
    "top_departments",
    """SELECT dept_key, count(DISTINCT comlog_id) AS n_communications, count(*) AS n_rows FROM communication_dpohs WHERE dept_key IS NOT NULL GROUP BY dept_key ORDER BY n_communications DESC, dept_key LIMIT 15""",
)
def top_departments(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "communication_dpohs", "comlog_id", "dept_key").where("dept_key IS NOT NULL")
    out = people.groupBy("dept_key").agg(F.countDistinct("comlog_id").alias("n_communications"), F.count("*").alias("n_rows"))
    return out.orderBy(F.col("n_communications").desc(), "dept_key").limit(15)


@catalog.query(
    "coverage",
    f"""SELECT 'all' AS part, min(comm_date) AS first_day, max(comm_date) AS last_day, count(*) AS n_rows FROM {_COMM}
    UNION ALL SELECT 'amending', min(comm_date), max(comm_date), count(*) FROM {_COMM} WHERE amends_comlog_id IS NOT NULL
    UNION ALL SELECT 'numbered', min(comm_date), max(comm_date), count(*) FROM {_COMM} WHERE client_num IS NOT NULL""",
)
def coverage(spark: SparkSession, d: str) -> DataFrame:
    """Span and size of all rows and of two parts, from one pass."""
    rows = _communications(spark, d)
    tests = {"all": F.lit(True), "amending": F.col("amends_comlog_id").isNotNull(), "numbered": F.col("client_num").isNotNull()}
    sums = [x for i, t in enumerate(tests.values()) for x in (F.min(F.when(t, F.col("comm_date"))).alias(f"a{i}"), F.max(F.when(t, F.col("comm_date"))).alias(f"b{i}"), F.count_if(t).alias(f"n{i}"))]
    parts = [F.struct(F.lit(n).alias("part"), F.col(f"a{i}").alias("first_day"), F.col(f"b{i}").alias("last_day"), F.col(f"n{i}").alias("n_rows")) for i, n in enumerate(tests)]
    return rows.agg(*sums).select(F.inline(F.array(*parts)))


@catalog.query(
    "lagging_posts",
    f"""WITH c AS (SELECT comlog_id, CAST({day_sql('posted_date')} - {day_sql('comm_date')} AS INT) AS lag FROM {_COMM})
    SELECT CASE WHEN lag IS NULL THEN 'unknown' WHEN lag > 45 THEN 'lagging' ELSE 'current' END AS state, count(*) AS n_rows, max(lag) AS most_days FROM c GROUP BY 1""",
)
def lagging_posts(spark: SparkSession, d: str) -> DataFrame:
    lag = F.date_diff(readable_day("posted_date"), readable_day("comm_date"))
    rows = _communications(spark, d).select(lag.alias("lag"))
    state = F.when(F.col("lag").isNull(), "unknown").when(F.col("lag") > 45, "lagging").otherwise("current")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n_rows"), F.max("lag").alias("most_days"))


@catalog.query(
    "institution_population",
    """SELECT coalesce(institution_kind, 'none') AS kind, CASE WHEN institution IS NULL OR trim(institution) = '' THEN 'blank' WHEN lower(institution) LIKE '%parliament%' OR lower(institution) LIKE '%deputies%' THEN 'parliament'
      WHEN lower(institution) LIKE '%minister%s office%' OR lower(institution) LIKE '%cabinet of the minister%' THEN 'minister' ELSE 'other' END AS population, count(*) AS n_rows, count(dept_key) AS n_keyed FROM communication_dpohs GROUP BY 1, 2""",
)
def institution_population(spark: SparkSession, d: str) -> DataFrame:
    """Populations of institutions as typed, classified once per different value."""
    counted = table(spark, d, "communication_dpohs", "institution", "institution_kind", "dept_key").groupBy("institution", "institution_kind").agg(F.count("*").alias("n"), F.count("dept_key").alias("k"))
    low = F.lower("institution")
    population = (
        F.when(F.col("institution").isNull() | (F.trim("institution") == ""), "blank").when(low.contains("parliament") | low.contains("deputies"), "parliament")
        .when(low.like("%minister%s office%") | low.contains("cabinet of the minister"), "minister").otherwise("other")
    )
    return counted.groupBy(F.coalesce("institution_kind", F.lit("none")).alias("kind"), population.alias("population")).agg(F.sum("n").alias("n_rows"), F.sum("k").alias("n_keyed"))


@catalog.query(
    "orphan_institutions",
    """SELECT dept_key, count(*) AS n_rows FROM registration_institutions r WHERE dept_key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM registration_versions v WHERE v.reg_id = r.reg_id AND v.effective_date >= '2018') GROUP BY dept_key""",
)
def orphan_institutions(spark: SparkSession, d: str) -> DataFrame:
    """Institutions of registrations whose version isn't among those since 2018, counted."""
    versions = table(spark, d, "registration_versions", "reg_id", "effective_date").where("effective_date >= '2018'")
    return orphans(table(spark, d, "registration_institutions", "reg_id", "dept_key").where("dept_key IS NOT NULL"), versions, "reg_id").groupBy("dept_key").agg(F.count("*").alias("n_rows"))


_VERSIONS = f"""(SELECT DISTINCT reg_id, coalesce(reg_base, regexp_replace(reg_num, '-[^-]*$', '')) AS base, client_norm, {day_sql('effective_date')} AS s, {day_sql('end_date')} AS e FROM registration_versions)"""


def _versions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "registration_versions", "reg_id", "reg_num", "reg_base", "client_norm", "effective_date", "end_date")
    return rows.select(
        "reg_id", F.coalesce("reg_base", registration_base("reg_num")).alias("base"), "client_norm", readable_day("effective_date").alias("s"), readable_day("end_date").alias("e")
    ).distinct()


@catalog.query(
    "asof_versions",
    f"SELECT reg_id, base, strftime(s, '%Y-%m-%d') AS since FROM {_VERSIONS} WHERE s <= DATE '2018-06-30' AND (e IS NULL OR DATE '2018-06-30' < e)",
)
def asof_versions(spark: SparkSession, d: str) -> DataFrame:
    return in_force_at(_versions(spark, d), "s", "e", F.lit("2018-06-30").cast("date")).select("reg_id", "base", iso("s").alias("since"))


@catalog.query(
    "asof_grid",
    f"""WITH g AS (SELECT CAST(unnest(generate_series(DATE '2015-01-01', DATE '2020-12-01', INTERVAL 1 MONTH)) AS DATE) AS t)
    SELECT strftime(t, '%Y-%m-%d') AS as_of, count(*) AS n_versions, count(DISTINCT base) AS n_registrations FROM g JOIN {_VERSIONS} v ON v.s <= t AND (v.e IS NULL OR t < v.e) GROUP BY t""",
)
def asof_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = in_force_grid(_versions(spark, d), "s", "e", "2015-01-01", "2020-12-01")
    return grid.groupBy("as_of").agg(F.count("*").alias("n_versions"), F.countDistinct("base").alias("n_registrations")).select(iso("as_of").alias("as_of"), "n_versions", "n_registrations")


@catalog.query(
    "version_chains",
    """WITH v AS (SELECT DISTINCT reg_id, coalesce(reg_base, regexp_replace(reg_num, '-[^-]*$', '')) AS base, version_seq, prev_reg_id, effective_date FROM registration_versions WHERE version_seq IS NOT NULL),
    o AS (SELECT *, row_number() OVER w AS n, lag(reg_id) OVER w AS before, lag(effective_date) OVER w AS day_before FROM v WINDOW w AS (PARTITION BY base ORDER BY version_seq, reg_id, effective_date, prev_reg_id))
    SELECT base, count(*) AS n_versions, count(*) FILTER (WHERE n > 1 AND prev_reg_id IS NULL) AS missing_pointers, count(*) FILTER (WHERE n > 1 AND prev_reg_id <> before) AS wrong_pointers,
      count(*) FILTER (WHERE effective_date < day_before) AS out_of_order FROM o GROUP BY base""",
)
def version_chains(spark: SparkSession, d: str) -> DataFrame:
    """Per registration: versions, missing and wrong predecessors, and starts that go back."""
    rows = table(spark, d, "registration_versions", "reg_id", "reg_num", "reg_base", "version_seq", "prev_reg_id", "effective_date").where("version_seq IS NOT NULL")
    v = rows.select("reg_id", F.coalesce("reg_base", registration_base("reg_num")).alias("base"), "version_seq", "prev_reg_id", "effective_date").distinct()
    w = Window.partitionBy("base").orderBy("version_seq", "reg_id", F.asc_nulls_last("effective_date"), F.asc_nulls_last("prev_reg_id"))
    o = v.select("*", F.row_number().over(w).alias("n"), F.lag("reg_id").over(w).alias("before"), F.lag("effective_date").over(w).alias("day_before"))
    later = F.col("n") > 1
    return o.groupBy("base").agg(
        F.count("*").alias("n_versions"),
        F.count_if(later & F.col("prev_reg_id").isNull()).alias("missing_pointers"),
        F.count_if(F.coalesce(later & (F.col("prev_reg_id") != F.col("before")), F.lit(False))).alias("wrong_pointers"),
        F.count_if(F.coalesce(F.col("effective_date") < F.col("day_before"), F.lit(False))).alias("out_of_order"),
    )


@catalog.query(
    "registration_parts",
    r"""SELECT DISTINCT reg_num, regexp_replace(reg_num, '-[^-]*$', '') AS base, try_cast(regexp_extract(reg_num, '-([^-]*)$', 1) AS BIGINT) AS seq FROM registration_versions WHERE reg_num IS NOT NULL""",
)
def registration_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "registration_versions", "reg_num").where("reg_num IS NOT NULL").distinct()
    return rows.select("reg_num", registration_base("reg_num").alias("base"), registration_sequence("reg_num").alias("seq"))


@catalog.query(
    "code_labels",
    """WITH l AS (SELECT reg_type, max(reg_type_label) AS label FROM registration_versions GROUP BY reg_type)
    SELECT c.reg_type, l.label, count(*) AS n_rows, count(*) FILTER (WHERE c.reg_type_label IS DISTINCT FROM l.label) AS n_other FROM communications c LEFT JOIN l USING (reg_type) GROUP BY 1, 2""",
)
def code_labels(spark: SparkSession, d: str) -> DataFrame:
    """Codes of one file labelled by another's code table; codes it doesn't know keep a NULL label."""
    labels = table(spark, d, "registration_versions", "reg_type", "reg_type_label").groupBy("reg_type").agg(F.max("reg_type_label").alias("label"))
    rows = table(spark, d, "communications", "reg_type", "reg_type_label").join(labels, "reg_type", "left")
    return rows.groupBy("reg_type", "label").agg(F.count("*").alias("n_rows"), F.count_if(~F.col("reg_type_label").eqNullSafe(F.col("label"))).alias("n_other"))
