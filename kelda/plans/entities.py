"""Names, crosswalks and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kelda.functions import text as T
from kelda.operators.codes import evidence_id, hierarchy, roll_up, with_reasons
from kelda.operators.entity import attribute, crosswalk, latest_per_key, longest_prefix, prefix_classes, prefix_collisions, resolve_exact, unmatched_both
from kelda.plans.registry import Catalog
from kelda.sources.tables import table

catalog = Catalog()


def words_sql(e: str) -> str:
    return rf"trim(regexp_replace(replace(lower(strip_accents({e})), '&', ' and '), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def org_sql(e: str) -> str:
    s = words_sql(f"split_part(coalesce({e}, ''), '|', 1)")
    return f"trim(regexp_replace(regexp_replace({s}, '^(?:(?:{'|'.join(T.ORG_PREFIXES)}) )+', ''), '(?: (?:{'|'.join(T.ORG_SUFFIXES)}))+$', ''))"


@catalog.query("normalize_org", f"SELECT org, {org_sql('org')} AS norm, count(*) AS n_rows FROM contracts GROUP BY org")
def normalize_org(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contracts", "org").groupBy("org").agg(F.count("*").alias("n_rows")).select("org", T.normalize_org("org").alias("norm"), "n_rows")


_VENDOR = r"""trim(regexp_replace(regexp_replace(split_part(upper(vendor), '/', 1), '[.,''"()]', '', 'g'), '\s+', ' ', 'g'))"""
_VENDOR_SHORT = f"regexp_replace({_VENDOR}, '(?: (?:{'|'.join(T.VENDOR_SUFFIXES)}))+$', '')"


@catalog.query("normalize_vendor", f"SELECT DISTINCT vendor, CASE WHEN {_VENDOR_SHORT} = '' THEN {_VENDOR} ELSE {_VENDOR_SHORT} END AS norm FROM contracts WHERE vendor IS NOT NULL")
def normalize_vendor(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contracts", "vendor").where("vendor IS NOT NULL").distinct().select("vendor", T.normalize_vendor("vendor").alias("norm"))


SPELLINGS = f"""(SELECT dept_key, {org_sql('name_en')} AS s FROM institution_list UNION SELECT dept_key, {words_sql('name_fr')} FROM institution_list
  UNION SELECT dept_key, lower(acronym) FROM institution_list WHERE acronym IS NOT NULL)"""


def spellings(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "institution_list")
    forms = F.explode(F.array_compact(F.array(T.normalize_org("name_en"), T.words_only("name_fr"), F.lower("acronym")))).alias("s")
    return listed.select("dept_key", forms).distinct()


@catalog.query(
    "resolve_exact",
    f"""WITH n AS (SELECT DISTINCT {org_sql('institution')} AS name FROM communication_dpohs WHERE institution IS NOT NULL),
    r AS (SELECT s, min(dept_key) AS k, count(DISTINCT dept_key) AS c FROM {SPELLINGS} WHERE s <> '' GROUP BY s)
    SELECT name, CASE WHEN c = 1 THEN k END AS dept_key, CASE WHEN c IS NULL THEN 'unresolved' WHEN c > 1 THEN 'ambiguous' ELSE 'resolved' END AS state FROM n LEFT JOIN r ON n.name = r.s""",
)
def resolve_exact_names(spark: SparkSession, d: str) -> DataFrame:
    """Typed institutions that equal a listed spelling after normalisation, never by likeness."""
    names = table(spark, d, "communication_dpohs", "institution").where("institution IS NOT NULL").select(T.normalize_org("institution").alias("name"))
    return resolve_exact(names, "name", spellings(spark, d), "dept_key", "s")


_SIDES = f"""c AS (SELECT DISTINCT contract_owner_org AS cid, {words_sql("coalesce(contract_org_en, '')")} AS c1, {words_sql("coalesce(split_part(contract_org_title, '|', 1), '')")} AS c2 FROM org_crosswalk WHERE contract_owner_org IS NOT NULL),
  p AS (SELECT DISTINCT plan_organization_id AS pid, {words_sql("coalesce(plan_organization, '')")} AS p1, {words_sql("coalesce(plan_organization_former, '')")} AS p2 FROM org_crosswalk WHERE plan_organization_id IS NOT NULL)"""


def _tier_sql(n: int, a: str, b: str, l: str, r: str) -> str:
    return f"""k{n} AS (SELECT x.cid, y.pid FROM (SELECT {a} AS k, min(cid) AS cid FROM {l} WHERE {a} <> '' GROUP BY {a} HAVING count(DISTINCT cid) = 1) x
      JOIN (SELECT {b} AS k, min(pid) AS pid FROM {r} WHERE {b} <> '' GROUP BY {b} HAVING count(DISTINCT pid) = 1) y ON x.k = y.k),
    g{n} AS (SELECT cid, min(pid) AS pid FROM k{n} GROUP BY cid), t{n} AS (SELECT min(cid) AS cid, pid FROM g{n} GROUP BY pid)"""


@catalog.query(
    "crosswalk_two_tier",
    f"""WITH {_SIDES}, {_tier_sql(1, 'c1', 'p1', 'c', 'p')},
    cl AS (SELECT * FROM c WHERE cid NOT IN (SELECT cid FROM t1)), pl AS (SELECT * FROM p WHERE pid NOT IN (SELECT pid FROM t1)), {_tier_sql(2, 'c2', 'p2', 'cl', 'pl')}
    SELECT cid, pid, CAST(1 AS INT) AS tier FROM t1 UNION ALL SELECT cid, pid, 2 FROM t2
    UNION ALL SELECT DISTINCT cid, NULL, NULL FROM cl WHERE cid NOT IN (SELECT cid FROM t2) UNION ALL SELECT DISTINCT NULL, pid, NULL FROM pl WHERE pid NOT IN (SELECT pid FROM t2)""",
)
def crosswalk_two_tier(spark: SparkSession, d: str) -> DataFrame:
    """Contract bodies against plan bodies: equal English names first, then titles against former names."""
    rows = table(spark, d, "org_crosswalk")
    blank = lambda c: F.coalesce(c, F.lit(""))
    c = rows.where("contract_owner_org IS NOT NULL").select(
        F.col("contract_owner_org").alias("cid"), T.words_only(blank(F.col("contract_org_en"))).alias("c1"), T.words_only(blank(F.split_part("contract_org_title", F.lit("|"), F.lit(1)))).alias("c2")
    ).distinct()
    p = rows.where("plan_organization_id IS NOT NULL").select(
        F.col("plan_organization_id").alias("pid"), T.words_only(blank(F.col("plan_organization"))).alias("p1"), T.words_only(blank(F.col("plan_organization_former"))).alias("p2")
    ).distinct()
    return crosswalk(c, p, "cid", "pid", [("c1", "p1"), ("c2", "p2")])


@catalog.query("crosswalk_report", "SELECT match_method, coalesce(relation, '') AS relation, count(*) AS n_rows, CAST(sum(contract_rows) AS BIGINT) AS contract_rows, CAST(sum(plan_rows) AS BIGINT) AS plan_rows FROM org_crosswalk GROUP BY 1, 2")
def crosswalk_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "org_crosswalk", "match_method", "relation", "contract_rows", "plan_rows")
    return rows.groupBy("match_method", F.coalesce("relation", F.lit("")).alias("relation")).agg(F.count("*").alias("n_rows"), F.sum("contract_rows").alias("contract_rows"), F.sum("plan_rows").alias("plan_rows"))


@catalog.query(
    "prefix_collisions",
    """WITH n AS (SELECT DISTINCT name_en AS n, string_split(lower(name_en), ' ') AS w FROM institution_list),
    p AS (SELECT a.n AS name_a, b.n AS name_b, a.w AS x, b.w AS y FROM n a JOIN n b ON a.n < b.n AND len(a.w) >= 2 AND len(b.w) >= 2 AND a.w[1] = b.w[1] AND a.w[2] = b.w[2])
    SELECT name_a, name_b, CAST(CASE WHEN x[3] IS NOT DISTINCT FROM y[3] THEN CASE WHEN x[4] IS NOT DISTINCT FROM y[4] THEN CASE WHEN x[5] IS NOT DISTINCT FROM y[5] THEN CASE WHEN x[6] IS NOT DISTINCT FROM y[6] THEN 6 ELSE 5 END ELSE 4 END ELSE 3 END ELSE 2 END AS INT) AS shared FROM p""",
)
def prefix_collision_pairs(spark: SparkSession, d: str) -> DataFrame:
    return prefix_collisions(table(spark, d, "institution_list", "name_en"), "name_en", 2)


@catalog.query(
    "prefix_classes",
    """WITH n AS (SELECT vendor, string_split(lower(vendor), ' ')[1] || ' ' || string_split(lower(vendor), ' ')[2] AS prefix FROM (SELECT DISTINCT vendor FROM contracts WHERE vendor IS NOT NULL) WHERE len(string_split(lower(vendor), ' ')) >= 2)
    SELECT vendor, prefix, n_names, first FROM n JOIN (SELECT prefix, count(*) AS n_names, min(vendor) AS first FROM n GROUP BY 1 HAVING count(*) > 1) USING (prefix)""",
)
def vendor_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Vendors that share their first two words, each with its class."""
    return prefix_classes(table(spark, d, "contracts", "vendor"), "vendor", 2)


_OPTIONS = ["11", "1101", "43", "4321", "432115", "77", "7710", "8", "80", "8010", "801015"]


@catalog.query(
    "longest_prefix_map",
    f"""WITH o AS (SELECT unnest({_OPTIONS}) AS option), c AS (SELECT DISTINCT commodity_code AS code FROM contracts WHERE commodity_code IS NOT NULL)
    SELECT code, arg_max(option, length(option)) AS option FROM c LEFT JOIN o ON starts_with(code, option) AND length(option) IN (2, 4, 6) GROUP BY code""",
)
def longest_prefix_map(spark: SparkSession, d: str) -> DataFrame:
    codes = table(spark, d, "contracts", "commodity_code").where("commodity_code IS NOT NULL").select(F.col("commodity_code").alias("code")).distinct()
    return longest_prefix(codes, "code", spark.createDataFrame([(o,) for o in _OPTIONS], "option string"), "option", [2, 4, 6])


@catalog.query(
    "latest_per_key",
    """SELECT comlog_id, dpoh_id, dept_key FROM (SELECT DISTINCT comlog_id, dpoh_id, dept_key FROM communication_dpohs WHERE comlog_id IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY comlog_id ORDER BY dpoh_id DESC, dept_key DESC NULLS LAST) = 1""",
)
def latest_child(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "communication_dpohs", "comlog_id", "dpoh_id", "dept_key").where("comlog_id IS NOT NULL").distinct()
    return latest_per_key(rows, ["comlog_id"], [F.col("dpoh_id").desc(), F.col("dept_key").desc_nulls_last()])


_ENT = r"list_filter(list_transform(string_split(coalesce(%s, ''), '/'), lambda x: trim(regexp_replace(regexp_replace(x, '(?:\s*\([^()]*\)\s*)+$', ''), '[\s,;–—-]+$', ''))), lambda x: x <> '')"


@catalog.query(
    "entity_attribution",
    f"""WITH a AS (SELECT DISTINCT reference_number, unnest({_ENT % 'end_user'}) AS name FROM notices), b AS (SELECT DISTINCT reference_number, unnest({_ENT % 'contracting_entity'}) AS name FROM notices),
    u AS (SELECT name, 'primary' AS source FROM a UNION ALL SELECT b.name, 'secondary' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.reference_number IS NOT DISTINCT FROM b.reference_number AND a.name = b.name))
    SELECT name, source, count(*) AS n_notices FROM u GROUP BY 1, 2""",
)
def entity_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of a notice: the end users, then what the contracting field adds."""
    rows = table(spark, d, "notices", "reference_number", "end_user", "contracting_entity").where("reference_number IS NOT NULL")
    part = lambda c: rows.select("reference_number", F.explode(T.split_entities(c)).alias("name"))
    return attribute(part("end_user"), part("contracting_entity"), ["reference_number"], "name").groupBy("name", "source").agg(F.count("*").alias("n_notices"))


@catalog.query(
    "observed_names",
    """WITH o AS (SELECT coalesce(canonical_key, '') AS k, trim(unnest(string_split(observed_names, ';'))) AS name FROM org_crosswalk WHERE observed_names IS NOT NULL)
    SELECT name, count(*) AS n_rows, count(DISTINCT k) AS n_keys FROM o WHERE name <> '' GROUP BY name""",
)
def observed_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "org_crosswalk", "canonical_key", "observed_names").where("observed_names IS NOT NULL")
    names = rows.select(F.coalesce("canonical_key", F.lit("")).alias("k"), F.explode(F.split("observed_names", ";")).alias("name")).withColumn("name", F.trim("name"))
    return names.where("name <> ''").groupBy("name").agg(F.count("*").alias("n_rows"), F.countDistinct("k").alias("n_keys"))


@catalog.query(
    "unmatched_both",
    """SELECT owner_org, 'left' AS side FROM (SELECT DISTINCT owner_org FROM contracts WHERE owner_org IS NOT NULL) WHERE owner_org NOT IN (SELECT owner_org FROM institution_list WHERE owner_org IS NOT NULL)
    UNION ALL SELECT owner_org, 'right' FROM (SELECT DISTINCT owner_org FROM institution_list WHERE owner_org IS NOT NULL) WHERE owner_org NOT IN (SELECT owner_org FROM contracts WHERE owner_org IS NOT NULL)""",
)
def unmatched_sides(spark: SparkSession, d: str) -> DataFrame:
    known = lambda t: table(spark, d, t, "owner_org").where("owner_org IS NOT NULL")
    return unmatched_both(known("contracts"), known("institution_list"), "owner_org")


@catalog.query("slugs", r"SELECT DISTINCT org, left(regexp_replace(regexp_replace(lower(strip_accents(org)), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug FROM contracts WHERE org IS NOT NULL")
def slugs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contracts", "org").where("org IS NOT NULL").distinct().select("org", T.slug("org", 60).alias("slug"))


@catalog.query(
    "lookup_reasons",
    """SELECT CASE WHEN c.contract_date IS NULL THEN 'no date' WHEN c.vendor_norm IS NULL THEN 'no vendor' WHEN i.dept_key IS NULL THEN 'no department' ELSE 'kept' END AS reason, count(*) AS n_rows
    FROM contracts c LEFT JOIN (SELECT owner_org, min(dept_key) AS dept_key FROM institution_list GROUP BY 1) i USING (owner_org) GROUP BY 1""",
)
def lookup_reasons(spark: SparkSession, d: str) -> DataFrame:
    """What is lost between contracts and departments, and why."""
    listed = table(spark, d, "institution_list", "owner_org", "dept_key").groupBy("owner_org").agg(F.min("dept_key").alias("dept_key"))
    rows = table(spark, d, "contracts", "owner_org", "contract_date", "vendor_norm").join(listed, "owner_org", "left")
    tests = [("no date", F.col("contract_date").isNull()), ("no vendor", F.col("vendor_norm").isNull()), ("no department", F.col("dept_key").isNull())]
    return with_reasons(rows, tests).groupBy("reason").agg(F.count("*").alias("n_rows"))


@catalog.query(
    "code_tree",
    r"""WITH c AS (SELECT commodity_code AS code, min(description) AS description FROM contracts WHERE regexp_matches(commodity_code, '^[0-9]{8}$') GROUP BY 1), l AS (SELECT *, CAST(greatest(1, ceil(length(regexp_replace(code, '0+$', '')) / 2)) AS INT) AS level FROM c)
    SELECT code, level, left(code, 2 * level) AS prefix, rpad(left(code, 4), 8, '0') AS family, 'con-' || left(sha256('contracts|' || code), 12) AS evidence FROM l""",
)
def code_tree(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy(table(spark, d, "contracts", "commodity_code", "description"), "commodity_code", "description")
    return tree.select("code", "level", "prefix", roll_up(F.col("code"), 2).alias("family"), evidence_id("contracts", F.col("code")).alias("evidence"))
