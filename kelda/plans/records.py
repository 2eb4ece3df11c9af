"""Titles, links, reviews, attestations, queues and totals of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kelda.functions import records as R, text as T
from kelda.functions.dates import day_sql, iso, readable_day
from kelda.operators.notices import closing_window
from kelda.operators.records import agreement, first_reviews, flag_queue, inherit, merge_attestations, suggestions
from kelda.plans.entities import org_sql
from kelda.plans.notices import BODY, CODES, KEY, PREFIXES, TERMS, WORD, body
from kelda.plans.registry import Catalog
from kelda.sources.tables import table

catalog = Catalog()


_ISSUERS = [("water", r"\bwater\b"), ("audit", r"\baudit"), ("board", r"\bboard\b")]


@catalog.query(
    "title_years",
    "SELECT DISTINCT reference_number, amendment_number, try_cast(nullif(regexp_extract(coalesce(title, ''), '(20[0-9]{2})', 1), '') AS INT) AS year,"
    " CASE WHEN regexp_matches(left(coalesce(publication_date, ''), 10), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN left(publication_date, 10) ELSE '' END AS published,"
    " coalesce(nullif(trim(end_user), ''), nullif(trim(contracting_entity), ''), '') AS agency FROM notices",
)
def title_years(spark: SparkSession, d: str) -> DataFrame:
    """Year in the title, day of publication and the agency shown, of every notice."""
    n = table(spark, d, "notices", *KEY, "title", "publication_date", "end_user", "contracting_entity")
    return n.select(*KEY, R.year_in_title(F.col("title")).alias("year"), R.published_day(F.col("publication_date")).alias("published"), R.display_agency(F.col("end_user"), F.col("contracting_entity")).alias("agency")).distinct()


@catalog.query(
    "document_kinds",
    "SELECT kind, issuer, count(*) AS n_rows FROM (SELECT CASE "
    + " ".join(f"WHEN {' OR '.join(f"contains(lower(coalesce(text, '')), '{x}')" for x in held)} THEN '{k}'" for k, held in R.DOCUMENT_KINDS)
    + f" ELSE 'other' END AS kind, CASE {' '.join(f"WHEN regexp_matches(lower(coalesce(text, '')), '{p}') THEN '{n}'" for n, p in _ISSUERS)} END AS issuer FROM documents) GROUP BY 1, 2",
)
def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of documents and who is named in them, by whole texts."""
    t = table(spark, d, "documents", "text")
    return t.groupBy(R.document_kind(F.col("text")).alias("kind"), R.first_named(F.col("text"), _ISSUERS).alias("issuer")).agg(F.count("*").alias("n_rows"))


@catalog.query(
    "stripped_committees",
    rf"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '{R.COMMITTEE}', ' ', 'g')) AS n_left, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), 'https?://[^\s]*?([0-9]{{3,}})', 1))), ',') AS link_ids FROM documents",
)
def stripped_committees(spark: SparkSession, d: str) -> DataFrame:
    """What stripping committees leaves of every document, and the numbers in its links."""
    t = table(spark, d, "documents", "doc_id", "text")
    return t.select("doc_id", F.length(R.strip_committees(F.col("text"))).cast("bigint").alias("n_left"), F.array_join(R.numbers_in_links(F.col("text")), ",").alias("link_ids"))


@catalog.query(
    "state_hashes",
    "SELECT DISTINCT reference_number, amendment_number, sha256(CAST(to_json({'description': left(coalesce(description, ''), greatest(0, 60000 - length(coalesce(title, '')))), 'title': coalesce(title, '')}) AS VARCHAR)) AS digest FROM notices",
)
def state_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Digest of every notice's prepared state, by which an answer of before is found again."""
    return table(spark, d, "notices", *KEY, "title", "description").select(*KEY, R.state_hash(F.col("title"), F.col("description")).alias("digest")).distinct()


@catalog.query("blinded_notices", "SELECT DISTINCT reference_number, title, closing_date FROM notices")
def blinded_notices(spark: SparkSession, d: str) -> DataFrame:
    return R.blinded(table(spark, d, "notices"), ["reference_number", "title", "closing_date"], ["opportunity_kind", "kind_basis", "org_keys"]).distinct()


@catalog.query(
    "answers",
    """SELECT doc_id, CASE WHEN ok THEN c END AS choice, CASE WHEN ok THEN m END AS mass, CASE WHEN c IS NULL AND m IS NULL THEN 'no answer' WHEN NOT coalesce(c IN ('en', 'fr'), FALSE) THEN 'unknown choice' WHEN NOT coalesce(m BETWEEN 0 AND 1, FALSE) THEN 'mass out of range' END AS problem
    FROM (SELECT doc_id, lang AS c, round(n_chars / 5000, 3) AS m, coalesce(lang IN ('en', 'fr') AND n_chars / 5000 BETWEEN 0 AND 1 AND round(n_chars / 5000, 3) BETWEEN 0 AND 1, FALSE) AS ok FROM documents)""",
)
def answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers in JSON, here made of each document's label and length, parsed and judged."""
    t = table(spark, d, "documents", "doc_id", "lang", "n_chars")
    said = F.to_json(F.struct(F.col("lang").alias("choice"), F.round(F.col("n_chars") / 5000, 3).alias("mass")))
    a = t.select("doc_id", R.parsed_answer(said, ["en", "fr"]).alias("a"))
    return a.select("doc_id", "a.choice", "a.mass", "a.problem")


@catalog.query(
    "suggestions",
    f"""WITH n AS (SELECT DISTINCT {org_sql('institution')} AS name FROM registration_institutions WHERE institution IS NOT NULL), l AS (SELECT DISTINCT {org_sql('name_en')} AS k FROM institution_list),
    s AS (SELECT name, k, round(1 - levenshtein(name, k) / greatest(length(k), length(name), 1), 6) AS s FROM n, l)
    SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY s DESC, k) AS INT) AS rank, k AS suggestion FROM s WHERE s >= 0.5 QUALIFY row_number() OVER (PARTITION BY name ORDER BY s DESC, k) <= 3""",
)
def suggest(spark: SparkSession, d: str) -> DataFrame:
    """Up to three listed names like each typed one; for people to choose from, never to resolve by."""
    known = [r.k for r in table(spark, d, "institution_list").select(T.normalize_org("name_en").alias("k")).distinct().limit(10_001).collect()]
    names = table(spark, d, "registration_institutions", "institution").where("institution IS NOT NULL").select(T.normalize_org("institution").alias("name"))
    return suggestions(names, "name", known)


@catalog.query(
    "attestation_merge",
    """WITH a AS (SELECT owner_org, count(*) AS n FROM contracts WHERE contract_date < '2020-01-01' AND owner_org IS NOT NULL GROUP BY 1), b AS (SELECT owner_org, count(*) AS n FROM contracts WHERE contract_date >= '2022-01-01' AND owner_org IS NOT NULL GROUP BY 1)
    SELECT coalesce(a.owner_org, b.owner_org) AS owner_org, coalesce(b.n, a.n) AS n, CASE WHEN a.n IS NULL THEN '2024-01-01' ELSE '2020-01-01' END AS first_seen, CASE WHEN b.n IS NULL THEN '2020-01-01' ELSE '2024-01-01' END AS last_seen, b.n IS NOT NULL AS live FROM a FULL JOIN b ON a.owner_org = b.owner_org""",
)
def attestation_merge(spark: SparkSession, d: str) -> DataFrame:
    """Bodies attested before 2020 merged with those attested since 2022."""
    c = table(spark, d, "contracts", "owner_org", "contract_date").where("owner_org IS NOT NULL")
    count = lambda test: c.where(test).groupBy("owner_org").agg(F.count("*").alias("n"))
    stored = count("contract_date < '2020-01-01'").withColumns({x: F.lit("2020-01-01") for x in ("first_seen", "last_seen")})
    return merge_attestations(stored, count("contract_date >= '2022-01-01'"), ["owner_org"], "n", "2024-01-01")


@catalog.query(
    "inherited_awards",
    """WITH p AS (SELECT DISTINCT reference, split_part(family_id, ':', 2) AS proc, family_id, org FROM contracts_disclosed WHERE reference IS NOT NULL AND family_id IS NOT NULL),
    c AS (SELECT DISTINCT reference_number, solicitation_number FROM notices WHERE reference_number IS NOT NULL),
    a AS (SELECT DISTINCT c.reference_number, p.family_id, p.org, 'reference' AS method FROM c JOIN p ON c.reference_number = p.reference),
    b AS (SELECT DISTINCT c.reference_number, p.family_id, p.org, 'procurement' AS method FROM c JOIN p ON c.solicitation_number = p.proc WHERE c.reference_number NOT IN (SELECT reference_number FROM a)),
    e AS (SELECT * FROM a UNION ALL SELECT * FROM b), n AS (SELECT reference_number, count(DISTINCT family_id) AS n_parents FROM e GROUP BY 1)
    SELECT reference_number, family_id, method, n_parents, CASE WHEN n_parents = 1 THEN org END AS org FROM e JOIN n USING (reference_number)""",
)
def inherited_awards(spark: SparkSession, d: str) -> DataFrame:
    """Procurement families that notices belong to: by reference, else by procurement number; the body of a single one."""
    parents = table(spark, d, "contracts_disclosed", "reference", "family_id", "org").where("reference IS NOT NULL AND family_id IS NOT NULL").select("reference", F.split_part("family_id", F.lit(":"), F.lit(2)).alias("proc"), "family_id", "org").distinct()
    notices = table(spark, d, "notices", "reference_number", "solicitation_number").where("reference_number IS NOT NULL")
    children = notices.groupBy("reference_number").agg(F.collect_set("solicitation_number").alias("procs")).withColumn("refs", F.array("reference_number"))
    return inherit(children, "reference_number", parents, "family_id", [("reference", "refs", "reference"), ("procurement", "procs", "proc")], "org").distinct()


_CLOSE = "try_cast(try_strptime(left(closing_date, 10), '%Y-%m-%d') AS DATE)"


@catalog.query(
    "department_sections",
    f"""WITH n AS (SELECT DISTINCT trim(unnest(string_split(org_keys, ','))) AS dept_key, reference_number, amendment_number, {_CLOSE} AS day FROM notices WHERE org_keys IS NOT NULL),
    w AS (SELECT *, CASE WHEN year(day) - 2024 > 10 THEN NULL ELSE day END AS shown FROM n WHERE dept_key <> '' AND (day IS NULL OR day >= DATE '2024-03-01'))
    SELECT dept_key, reference_number, amendment_number, strftime(shown, '%Y-%m-%d') AS closes, CAST(row_number() OVER (PARTITION BY dept_key ORDER BY shown NULLS LAST, reference_number, amendment_number) AS INT) AS place FROM w
    QUALIFY row_number() OVER (PARTITION BY dept_key ORDER BY shown NULLS LAST, reference_number, amendment_number) <= 25""",
)
def department_sections(spark: SparkSession, d: str) -> DataFrame:
    """The 25 notices of each department that close next: closed ones left out, standing ones without a day at the end."""
    from kelda.operators.entity import latest_per_key

    day = F.try_to_date(F.left("closing_date", F.lit(10)), "yyyy-MM-dd")
    rows = table(spark, d, "notices", *KEY, "org_keys", "closing_date").select(F.explode(T.split_keys("org_keys")).alias("dept_key"), *KEY, day.alias("day")).distinct()
    rows = rows.withColumn("w", closing_window(F.col("day"), F.lit("2024-03-01").cast("date"))["window"]).where("w <> 'closed'")
    rows = rows.withColumn("shown", F.when(F.col("w") != "standing", F.col("day")))
    order = [F.col("shown").asc_nulls_last(), F.col("reference_number").asc_nulls_last(), F.col("amendment_number").asc_nulls_last()]
    few = latest_per_key(rows, ["dept_key"], order, 25)
    place = F.row_number().over(Window.partitionBy("dept_key").orderBy(*order))
    return few.select("dept_key", *KEY, iso("shown").alias("closes"), place.alias("place"))


@catalog.query(
    "plan_totals",
    f"""WITH c AS (SELECT org, value, number_of_bids, description, year({day_sql('contract_date')}) AS y FROM contracts WHERE org IS NOT NULL), l AS (SELECT org, max(y) AS latest FROM c GROUP BY 1)
    SELECT c.org, count(*) AS n_rows, count(*) FILTER (WHERE number_of_bids = 1) AS single_bid, count(*) FILTER (WHERE value < 0) AS negative, min(y) AS first_year, max(y) AS last_year,
      count(*) FILTER (WHERE y = latest) AS latest_rows, count(DISTINCT description) AS descriptions FROM c JOIN l ON c.org = l.org GROUP BY 1""",
)
def plan_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of every body: rows, flags, its years, the rows of its latest year, and its different texts.

    The latest year comes from counts per body and year, so rows are aggregated once."""
    c = table(spark, d, "contracts", "org", "value", "number_of_bids", "description", "contract_date").where("org IS NOT NULL")
    y = c.groupBy("org", F.year(readable_day("contract_date")).alias("y")).agg(F.count("*").alias("n"), F.count_if(F.col("number_of_bids") == 1).alias("s"), F.count_if(F.col("value") < 0).alias("g"))
    total = y.groupBy("org").agg(
        F.sum("n").alias("n_rows"), F.sum("s").alias("single_bid"), F.sum("g").alias("negative"), F.min("y").alias("first_year"), F.max("y").alias("last_year"),
        F.coalesce(F.max(F.when(F.col("y").isNotNull(), F.struct("y", "n")))["n"], F.lit(0)).alias("latest_rows"),
    )
    texts = c.select("org", "description").distinct().groupBy("org").agg(F.count("description").alias("descriptions"))
    return total.join(texts, "org")


@catalog.query(
    "subject_counts",
    "SELECT institution AS subject, count(DISTINCT comlog_id) AS n_reports FROM communication_dpohs WHERE institution IS NOT NULL GROUP BY 1",
)
def subject_counts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct reports of each institution, reduced to pairs before they are counted."""
    return table(spark, d, "communication_dpohs", "institution", "comlog_id").where("institution IS NOT NULL").distinct().groupBy(F.col("institution").alias("subject")).agg(F.count("comlog_id").alias("n_reports"))


@catalog.query(
    "subject_union",
    "SELECT DISTINCT trim(institution) AS subject FROM (SELECT institution FROM communication_dpohs UNION ALL SELECT institution FROM registration_institutions) WHERE trim(institution) <> ''",
)
def subject_union(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of both sources, each once."""
    both = table(spark, d, "communication_dpohs", "institution").unionByName(table(spark, d, "registration_institutions", "institution"))
    return both.select(F.trim("institution").alias("subject")).where("subject <> ''").distinct()


@catalog.query(
    "attribution_report",
    "SELECT coalesce(org_key_source, 'none') AS population, count(*) AS total, count(*) FILTER (WHERE trim(coalesce(org_keys, '')) <> '') AS resolved, count(*) FILTER (WHERE contains(coalesce(org_keys, ''), ',')) AS several FROM notices GROUP BY 1",
)
def attribution_report(spark: SparkSession, d: str) -> DataFrame:
    """Resolved and total rows of each population, never blended."""
    n = table(spark, d, "notices", "org_key_source", "org_keys")
    held = F.coalesce("org_keys", F.lit(""))
    return n.groupBy(F.coalesce("org_key_source", F.lit("none")).alias("population")).agg(F.count("*").alias("total"), F.count_if(F.trim(held) != "").alias("resolved"), F.count_if(held.contains(",")).alias("several"))


@catalog.query(
    "family_discovery",
    f"""WITH c AS (SELECT DISTINCT reference_number, title, rpad(left(unnest({CODES}), 4), 8, '0') AS family FROM notices WHERE reference_number IS NOT NULL),
    t AS (SELECT family, title, row_number() OVER (PARTITION BY family ORDER BY title) AS k FROM (SELECT DISTINCT family, title FROM c WHERE title IS NOT NULL))
    SELECT c.family, count(DISTINCT reference_number) AS n_notices, (SELECT string_agg(title, ' | ' ORDER BY title) FROM t WHERE t.family = c.family AND k <= 3) AS samples FROM c GROUP BY 1 HAVING count(DISTINCT reference_number) >= 3""",
)
def family_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Families that notices are filed under: how many notices, and the first three titles of each."""
    from kelda.operators.entity import latest_per_key

    codes = table(spark, d, "notices", "reference_number", "title", "unspsc").where("reference_number IS NOT NULL")
    c = codes.select("reference_number", "title", F.explode(T.parse_codes("unspsc")).alias("code")).select("reference_number", "title", F.rpad(F.left("code", F.lit(4)), 8, "0").alias("family")).distinct()
    counts = c.groupBy("family").agg(F.countDistinct("reference_number").alias("n_notices")).where("n_notices >= 3")
    few = latest_per_key(c.select("family", "title").where("title IS NOT NULL").distinct(), ["family"], [F.col("title")], 3)
    samples = few.groupBy("family").agg(F.array_join(F.array_sort(F.collect_list("title")), " | ").alias("samples"))
    return counts.join(samples, "family", "left")


@catalog.query(
    "extremes",
    """WITH s AS (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS b FROM orders)
    SELECT o_orderpriority, 'top' AS side, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY a) AS keys FROM s WHERE a <= 5 GROUP BY 1 UNION ALL SELECT o_orderpriority, 'bottom', string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY b) FROM s WHERE b <= 5 GROUP BY 1""",
)
def extremes(spark: SparkSession, d: str) -> DataFrame:
    """The five dearest and cheapest orders of each class; tasks hand on five of each."""
    from kelda.operators.entity import latest_per_key

    o = table(spark, d, "orders", "o_orderpriority", "o_orderkey", "o_totalprice")
    sides = []
    for side, by in (("top", -F.col("o_totalprice")), ("bottom", F.col("o_totalprice"))):
        few = latest_per_key(o.withColumn("s", by), ["o_orderpriority"], [F.col("s"), F.col("o_orderkey")], 5)
        listed = few.groupBy("o_orderpriority").agg(F.array_sort(F.collect_list(F.struct("s", "o_orderkey"))).alias("k"))
        sides.append(listed.select("o_orderpriority", F.lit(side).alias("side"), F.array_join(F.transform("k", lambda x: x["o_orderkey"].cast("string")), ",").alias("keys")))
    return sides[0].unionByName(sides[1])


@catalog.query(
    "reviewer_agreement",
    """WITH f AS (SELECT user_id % 97 AS item, user_id % 5 AS reviewer, arg_min(event_type, (ts, event_id)) AS verdict FROM events WHERE user_id % 97 NOT IN (SELECT user_id % 97 FROM events WHERE value < 0) GROUP BY 1, 2),
    v AS (SELECT item, verdict, count(*) AS v FROM f GROUP BY 1, 2), m AS (SELECT item, max(v) AS m FROM v GROUP BY 1), t AS (SELECT v.item, max(verdict) AS top, count(*) AS ties FROM v JOIN m ON v.item = m.item AND v.v = m.m GROUP BY 1)
    SELECT reviewer, item % 3 AS stratum, count(*) AS n_items, count(*) FILTER (WHERE ties = 1 AND top = verdict) AS n_agree FROM f JOIN t USING (item) GROUP BY 1, 2""",
)
def reviewer_agreement(spark: SparkSession, d: str) -> DataFrame:
    """First verdicts on items that nothing spoiled, by reviewer and stratum; here events stand for verdicts."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value").withColumns({"item": F.col("user_id") % 97, "reviewer": F.col("user_id") % 5})
    first = first_reviews(e, "item", "reviewer", ["ts", "event_id"], "event_type", e.where("value < 0"))
    return agreement(first, "item", "reviewer", "event_type", first.select("item", (F.col("item") % 3).alias("stratum")), "stratum")


@catalog.query(
    "capabilities",
    f"""WITH n AS (SELECT DISTINCT left(unnest({CODES}), 2) AS segment, reference_number, org_keys FROM notices WHERE reference_number IS NOT NULL),
    k AS (SELECT segment, trim(unnest(string_split(org_keys, ','))) AS dept_key FROM n),
    a AS (SELECT segment, count(DISTINCT reference_number) AS notices, (SELECT count(DISTINCT dept_key) FROM k WHERE k.segment = n.segment AND dept_key <> '') AS departments FROM n GROUP BY 1),
    c AS (SELECT left(commodity_code, 2) AS segment, count(*) AS contracts FROM contracts WHERE regexp_matches(commodity_code, '^[0-9]{{8}}$') GROUP BY 1)
    SELECT a.segment, notices, departments, coalesce(contracts, 0) AS contracts FROM a LEFT JOIN c ON a.segment = c.segment WHERE notices >= 5 AND departments >= 3""",
)
def capabilities(spark: SparkSession, d: str) -> DataFrame:
    """Segments with enough notices and departments, and their contracts by commodity code."""
    n = table(spark, d, "notices", "reference_number", "unspsc", "org_keys").where("reference_number IS NOT NULL")
    codes = n.select("reference_number", F.explode(T.parse_codes("unspsc")).alias("code"), "org_keys").select("reference_number", F.left("code", F.lit(2)).alias("segment"), "org_keys").distinct()
    notices = codes.groupBy("segment").agg(F.countDistinct("reference_number").alias("notices"))
    depts = codes.select("segment", F.explode(T.split_keys("org_keys")).alias("dept_key")).distinct().groupBy("segment").agg(F.count("*").alias("departments"))
    c = table(spark, d, "contracts", "commodity_code").where(F.col("commodity_code").rlike("^[0-9]{8}$")).groupBy(F.left("commodity_code", F.lit(2)).alias("segment")).agg(F.count("*").alias("contracts"))
    return notices.join(depts, "segment").join(c, "segment", "left").select("segment", "notices", "departments", F.coalesce("contracts", F.lit(0)).alias("contracts")).where("notices >= 5 AND departments >= 3")


@catalog.query("get_by_id", "SELECT doc_id, source, doc_kind, length(text) AS n_text, md5(text) AS digest FROM documents WHERE doc_id % 100 = 0")
def get_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Documents by id, here every id divisible by 100, with what is stored of them; the filter reaches the scan."""
    t = table(spark, d, "documents", "doc_id", "source", "doc_kind", "text")
    return t.where(F.col("doc_id") % 100 == 0).select("doc_id", "source", "doc_kind", F.length("text").cast("bigint").alias("n_text"), F.md5("text").alias("digest"))


@catalog.query(
    "target_notices",
    f"""SELECT DISTINCT reference_number, amendment_number FROM notices WHERE coalesce(opportunity_kind, '') NOT IN ('call_up', 'qualification', 'information', 'award', 'construction') AND (CASE WHEN len({CODES}) > 0 THEN {' OR '.join(f"len(list_filter({CODES}, lambda c: starts_with(c, '{p}'))) > 0" for p in PREFIXES)}
    ELSE {' OR '.join(f"regexp_matches({BODY}, '{WORD % t}')" for t in TERMS)} END)""",
)
def target_notices(spark: SparkSession, d: str) -> DataFrame:
    """Notices that a backtest counts: of no excluded kind, and relevant by codes or, without codes, by terms."""
    n = table(spark, d, "notices", *KEY, "title", "description", "unspsc", "opportunity_kind")
    codes = T.parse_codes("unspsc")
    relevant = F.when(F.size(codes) > 0, F.size(T.matched_prefixes(codes, PREFIXES)) > 0).otherwise(F.size(T.matched_terms(body(), TERMS)) > 0)
    kept = ~F.coalesce("opportunity_kind", F.lit("")).isin("call_up", "qualification", "information", "award", "construction")
    return n.where(kept & relevant).select(*KEY).distinct()


@catalog.query(
    "flag_queue",
    """WITH f AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderkey % 7 <> 0 ORDER BY o_orderdate, o_orderkey LIMIT 20),
    c AS (SELECT o_orderkey FROM orders WHERE o_totalprice <= 300000 AND o_orderkey % 7 <> 0 ORDER BY sha256(CAST(o_orderkey AS VARCHAR) || ':3'), o_orderkey LIMIT 20)
    SELECT o_orderkey, is_flag, sha256(CAST(o_orderkey AS VARCHAR) || ':3:place') AS place FROM (SELECT o_orderkey, TRUE AS is_flag FROM f UNION ALL SELECT o_orderkey, FALSE FROM c)""",
)
def queue(spark: SparkSession, d: str) -> DataFrame:
    """Twenty flags and twenty controls in an order that tells nothing."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    return flag_queue(o.where("o_totalprice > 300000"), o, o.where("o_orderkey % 7 = 0"), "o_orderkey", "o_orderdate", 20, 3)
