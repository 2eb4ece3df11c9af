"""Notices: normalisation, matching, classification and the funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kelda.functions import text as T
from kelda.functions.dates import day_sql, iso, readable_day
from kelda.functions.stats import fiscal_label
from kelda.operators.notices import Stage, classify, closing_window, date_conflict, first_figure, funnel_counts, reached, with_stages
from kelda.plans.registry import Catalog
from kelda.sources.tables import table

catalog = Catalog()

TERMS = ["cloud hosting", "network security audit", "data entry", "payroll software", "server racks", "sécurité des réseaux"]
EXCLUDED = ["catering", "snow removal", "déneigement"]
PREFIXES = ["11", "43", "4321", "77", "88"]
KEY = ["reference_number", "amendment_number"]
WORD = r"(^|[^\p{L}\p{N}_])%s($|[^\p{L}\p{N}_])"
BODY = "lower(coalesce(title, '') || ' ' || coalesce(description, ''))"


def body():
    """Title and description of a notice."""
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))


def _notices(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "notices", *KEY, *columns)


@catalog.query(
    "keyword_match",
    "SELECT DISTINCT * FROM (SELECT reference_number, amendment_number, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches({BODY}, '{WORD % t}') THEN '{t}' END" for t in TERMS)
    + "], lambda x: x IS NOT NULL), ';') AS terms FROM notices) WHERE terms <> ''",
)
def keyword_match(spark: SparkSession, d: str) -> DataFrame:
    rows = _notices(spark, d, "title", "description")
    return rows.select(*KEY, F.array_join(T.matched_terms(body(), TERMS), ";").alias("terms")).where("terms <> ''").distinct()


@catalog.query(
    "exclusion_match",
    "SELECT DISTINCT * FROM (SELECT reference_number, amendment_number, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN contains({BODY}, '{t}') THEN '{t}' END" for t in EXCLUDED)
    + "], lambda x: x IS NOT NULL), ';') AS excluded FROM notices) WHERE excluded <> ''",
)
def exclusion_match(spark: SparkSession, d: str) -> DataFrame:
    rows = _notices(spark, d, "title", "description")
    return rows.select(*KEY, F.array_join(T.matched_substrings(body(), EXCLUDED), ";").alias("excluded")).where("excluded <> ''").distinct()


CODES = r"list_sort(list_distinct(list_filter(list_transform(string_split(coalesce(unspsc, ''), chr(10)), lambda x: trim(replace(x, '*', ''))), lambda x: regexp_matches(x, '^[0-9]{8}$'))))"


@catalog.query(
    "code_families",
    f"SELECT DISTINCT * FROM (SELECT reference_number, amendment_number, array_to_string({CODES}, ',') AS codes, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN len(list_filter({CODES}, lambda c: starts_with(c, '{p}'))) > 0 THEN '{p}' END" for p in sorted(PREFIXES))
    + "], lambda x: x IS NOT NULL), ',') AS families FROM notices) WHERE codes <> ''",
)
def code_families(spark: SparkSession, d: str) -> DataFrame:
    codes = T.parse_codes("unspsc")
    rows = _notices(spark, d, "unspsc").select(*KEY, F.array_join(codes, ",").alias("codes"), F.array_join(T.matched_prefixes(codes, PREFIXES), ",").alias("families"))
    return rows.where("codes <> ''").distinct()


@catalog.query(
    "code_rollup",
    f"""WITH c AS (SELECT DISTINCT reference_number, amendment_number, unnest({CODES}) AS code FROM notices)
    SELECT rpad(left(code, 4), 8, '0') AS family, count(*) AS n_rows, count(DISTINCT (reference_number, amendment_number)) AS n_notices FROM c GROUP BY 1""",
)
def code_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Codes rolled up to their four-digit family: distinct notices per family."""
    codes = _notices(spark, d, "unspsc").select(*KEY, F.explode(T.parse_codes("unspsc")).alias("code")).distinct()
    return codes.groupBy(F.rpad(F.left("code", F.lit(4)), 8, "0").alias("family")).agg(F.count("*").alias("n_rows"), F.countDistinct(F.struct(*KEY)).alias("n_notices"))


@catalog.query(
    "entity_split",
    r"""WITH p AS (SELECT DISTINCT contracting_entity, unnest(list_filter(list_transform(string_split(contracting_entity, '/'),
      lambda x: trim(regexp_replace(regexp_replace(x, '(?:\s*\([^()]*\)\s*)+$', ''), '[\s,;–—-]+$', ''))), lambda x: x <> '')) AS name FROM notices WHERE contracting_entity IS NOT NULL)
    SELECT name, count(*) AS n_fields FROM p GROUP BY name""",
)
def entity_split(spark: SparkSession, d: str) -> DataFrame:
    """Names in the contracting field, with the number of different fields that hold them."""
    fields = table(spark, d, "notices", "contracting_entity").where("contracting_entity IS NOT NULL").distinct()
    return fields.select("contracting_entity", F.explode(T.split_entities("contracting_entity")).alias("name")).distinct().groupBy("name").agg(F.count("*").alias("n_fields"))


_CLOSE = "try_cast(try_strptime(left(closing_date, 10), '%Y-%m-%d') AS DATE)"


@catalog.query(
    "closing_windows",
    f"""WITH c AS (SELECT DISTINCT reference_number, amendment_number, {_CLOSE} AS day FROM notices)
    SELECT CASE WHEN day IS NULL THEN 'unknown' WHEN year(day) - 2024 > 10 THEN 'standing' WHEN day < DATE '2024-03-01' THEN 'closed' WHEN day < DATE '2024-03-11' THEN 'imminent' ELSE 'open' END AS "window",
      count(*) AS n_rows, min(CASE WHEN year(day) - 2024 <= 10 THEN CAST(day - DATE '2024-03-01' AS INT) END) AS least_days FROM c GROUP BY 1""",
)
def closing_windows(spark: SparkSession, d: str) -> DataFrame:
    day = F.try_to_date(F.left("closing_date", F.lit(10)), "yyyy-MM-dd")
    rows = _notices(spark, d, "closing_date").select(*KEY, day.alias("day")).distinct()
    w = rows.select(closing_window(F.col("day"), F.lit("2024-03-01").cast("date")).alias("w"))
    return w.groupBy(F.col("w.window").alias("window")).agg(F.count("*").alias("n_rows"), F.min("w.days").alias("least_days"))


@catalog.query(
    "closing_shapes",
    "SELECT CASE WHEN closing_date IS NULL THEN NULL ELSE regexp_replace(closing_date, '[0-9]', '9', 'g') END AS shape, count(*) AS n_rows FROM notices GROUP BY 1",
)
def closing_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Notations of the closing date with digits masked; NULL has a row of its own."""
    return table(spark, d, "notices", "closing_date").groupBy(F.regexp_replace("closing_date", "[0-9]", "9").alias("shape")).agg(F.count("*").alias("n_rows"))


@catalog.query(
    "fiscal_years",
    f"""WITH n AS (SELECT DISTINCT reference_number, amendment_number, {day_sql('publication_date')} AS day FROM notices)
    SELECT CASE WHEN day IS NULL THEN '' ELSE CAST(year(day - INTERVAL 3 MONTH) AS VARCHAR) || '-' || CAST(year(day - INTERVAL 3 MONTH) + 1 AS VARCHAR) END AS label, count(*) AS n_rows FROM n GROUP BY 1""",
)
def fiscal_years(spark: SparkSession, d: str) -> DataFrame:
    rows = _notices(spark, d, "publication_date").select(*KEY, readable_day("publication_date").alias("day")).distinct()
    return rows.groupBy(fiscal_label("day").alias("label")).agg(F.count("*").alias("n_rows"))


def _kind():
    kind, category, low = F.coalesce("notice_type", F.lit("")), T.parse_categories("procurement_category"), F.lower(body())
    construction = (F.size(category) > 0) & (F.size(F.filter(category, lambda c: c != "*CNST")) == 0)
    return classify(
        [
            ("call_up", "notice_type", kind == "RFP against Supply Arrangement"),
            ("qualification", "notice_type", kind == "Invitation to Qualify"),
            ("information", "notice_type", kind == "Request for Information"),
            ("award", "notice_type", kind == "Advance Contract Award Notice"),
            ("construction", "category", construction),
            ("standing_offer", "prose", F.instr(low, "standing offer") > 0),
            ("standalone", "notice_type", kind == "Request for Proposal"),
        ]
    )


_CATS = "list_filter(list_transform(string_split(coalesce(procurement_category, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_KIND_SQL = f"""CASE WHEN notice_type = 'RFP against Supply Arrangement' THEN 'call_up/notice_type' WHEN notice_type = 'Invitation to Qualify' THEN 'qualification/notice_type'
  WHEN notice_type = 'Request for Information' THEN 'information/notice_type' WHEN notice_type = 'Advance Contract Award Notice' THEN 'award/notice_type'
  WHEN len({_CATS}) > 0 AND len(list_filter({_CATS}, lambda c: c <> '*CNST')) = 0 THEN 'construction/category' WHEN contains({BODY}, 'standing offer') THEN 'standing_offer/prose'
  WHEN notice_type = 'Request for Proposal' THEN 'standalone/notice_type' ELSE 'unknown/none' END"""


@catalog.query("notice_kinds", f"SELECT split_part(k, '/', 1) AS kind, split_part(k, '/', 2) AS basis, count(*) AS n_rows FROM (SELECT {_KIND_SQL} AS k FROM notices) GROUP BY 1, 2")
def notice_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "notices", "notice_type", "procurement_category", "title", "description")
    return rows.select(_kind().alias("k")).groupBy("k.kind", "k.basis").agg(F.count("*").alias("n_rows"))


@catalog.query(
    "first_figures",
    r"""SELECT DISTINCT reference_number, amendment_number, try_cast(replace(regexp_extract(description, '\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s?([KkMmBb]?)', 1), ',', '') AS DOUBLE) AS figure FROM notices
    WHERE regexp_matches(description, '\$\s?[0-9]')""",
)
def first_figures(spark: SparkSession, d: str) -> DataFrame:
    rows = _notices(spark, d, "description").select(*KEY, first_figure(F.col("description")).alias("figure"))
    return rows.where("figure IS NOT NULL").distinct()


@catalog.query(
    "date_conflicts",
    rf"""WITH f AS (SELECT reference_number, amendment_number, {_CLOSE} AS closing,
      try_cast(try_strptime(regexp_extract(description, '(?:submitted|received|close[sd]?|closing)[^.0-9]{{0,40}}([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), '%Y-%m-%d') AS DATE) AS said FROM notices)
    SELECT DISTINCT reference_number, amendment_number, strftime(said, '%Y-%m-%d') AS said FROM f WHERE closing - said > 1""",
)
def date_conflicts(spark: SparkSession, d: str) -> DataFrame:
    day = F.try_to_date(F.left("closing_date", F.lit(10)), "yyyy-MM-dd")
    rows = _notices(spark, d, "description", "closing_date").select(*KEY, iso(date_conflict(F.col("description"), day)).alias("said"))
    return rows.where("said IS NOT NULL").distinct()


@catalog.query(
    "term_windows",
    r"""WITH t AS (SELECT reference_number, amendment_number, regexp_replace(description, '\s+', ' ', 'g') AS t FROM notices WHERE contains(lower(description), 'cloud hosting'))
    SELECT DISTINCT reference_number, amendment_number, substr(t, greatest(1, strpos(lower(t), 'cloud hosting') - 40), strpos(lower(t), 'cloud hosting') + 53 - greatest(1, strpos(lower(t), 'cloud hosting') - 40)) AS seen FROM t WHERE strpos(lower(t), 'cloud hosting') > 0""",
)
def term_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = _notices(spark, d, "description").select(*KEY, T.term_window("description", "cloud hosting").alias("seen"))
    return rows.where("seen IS NOT NULL").distinct()


def funnel_stages() -> list[Stage]:
    """Stages over the columns of a notice, with 1 March 2024 as the day of the run."""
    closing = F.try_to_date(F.left("closing_date", F.lit(10)), "yyyy-MM-dd")
    codes, terms = T.parse_codes("unspsc"), T.matched_terms(body(), TERMS)
    coded = F.size(codes) > 0
    relevant = F.when(coded, F.size(T.matched_prefixes(codes, PREFIXES)) > 0).otherwise(F.size(terms) > 0)
    excluded = T.matched_substrings(body(), EXCLUDED)
    return [
        Stage("closed", closing < F.lit("2024-03-01").cast("date")),
        Stage("exclusion", F.size(excluded) > 0, F.array_join(excluded, ";")),
        Stage("construction", _kind()["kind"] == "construction"),
        Stage("relevance", ~relevant, F.when(coded, "codes").otherwise("terms")),
        Stage("value", F.lit(True), active=False),
        Stage("identifiable", F.lower(F.trim(F.coalesce("reference_number", F.lit("")))).isin("", "nan")),
    ]



def staged_sql(source: str = "notices", keep: str = "reference_number, amendment_number") -> str:
    """The stages of the funnel as SQL over the columns of a notice."""
    return f"""SELECT {keep}, coalesce({_CLOSE} < DATE '2024-03-01', FALSE) AS closed,
  {' OR '.join(f"contains({BODY}, '{t}')" for t in EXCLUDED)} AS exclusion, {_KIND_SQL} = 'construction/category' AS construction,
  NOT (CASE WHEN len({CODES}) > 0 THEN {' OR '.join(f"len(list_filter({CODES}, lambda c: starts_with(c, '{p}'))) > 0" for p in PREFIXES)}
    ELSE {' OR '.join(f"regexp_matches({BODY}, '{WORD % t}')" for t in TERMS)} END) AS relevance,
  lower(trim(coalesce(reference_number, ''))) IN ('', 'nan') AS identifiable FROM {source}"""


_STAGED = staged_sql()
_FUNNEL_COLUMNS = ("title", "description", "closing_date", "notice_type", "procurement_category", "unspsc")
_ACTIVE = ("closed", "exclusion", "construction", "relevance", "identifiable")


@catalog.query(
    "funnel_production",
    f"""SELECT coalesce(CASE {' '.join(f"WHEN {s} THEN '{s}'" for s in _ACTIVE)} END, 'admitted') AS outcome, count(*) AS n_rows FROM ({_STAGED}) GROUP BY 1""",
)
def funnel_production(spark: SparkSession, d: str) -> DataFrame:
    """Where each notice leaves the funnel."""
    staged = with_stages(_notices(spark, d, *_FUNNEL_COLUMNS), funnel_stages())
    return staged.groupBy(F.coalesce("first_drop", F.lit("admitted")).alias("outcome")).agg(F.count("*").alias("n_rows"))


@catalog.query(
    "funnel_audit",
    f"""SELECT concat_ws('+', {', '.join(f"CASE WHEN {s} THEN '{s}' END" for s in _ACTIVE)}) AS drop_set, count(*) AS n_rows FROM ({_STAGED}) GROUP BY 1""",
)
def funnel_audit(spark: SparkSession, d: str) -> DataFrame:
    """Every stage that would drop a notice, without stopping at the first."""
    staged = with_stages(_notices(spark, d, *_FUNNEL_COLUMNS), funnel_stages())
    return staged.groupBy(F.array_join("drops", "+").alias("drop_set")).agg(F.count("*").alias("n_rows"))


@catalog.query(
    "funnel_counters",
    f"""WITH s AS ({_STAGED}), f AS (SELECT *, CASE {' '.join(f"WHEN {s} THEN '{s}'" for s in _ACTIVE)} END AS first_drop, {' + '.join(f"CAST({s} AS INT)" for s in _ACTIVE)} AS k FROM s)
    """
    + " UNION ALL ".join(
        f"""SELECT count(*) AS n_in, count(*) FILTER (WHERE k = 0) AS admitted, CAST({i} AS INT) AS "order", '{s}' AS stage, count(*) FILTER (WHERE first_drop = '{s}') AS first_drops,
        {f"count(*) FILTER (WHERE {s})" if s != "value" else "CAST(0 AS BIGINT)"} AS fires, {f"count(*) FILTER (WHERE {s} AND k = 1)" if s != "value" else "CAST(0 AS BIGINT)"} AS alone FROM f"""
        for i, s in enumerate(("closed", "exclusion", "construction", "relevance", "value", "identifiable"), 1)
    ),
)
def funnel_counters(spark: SparkSession, d: str) -> DataFrame:
    """All counters of a run in one pass, the inactive stage included."""
    stages = funnel_stages()
    return funnel_counts(with_stages(_notices(spark, d, *_FUNNEL_COLUMNS), stages), stages)


@catalog.query(
    "funnel_reached",
    f"""SELECT reached, count(*) AS n_rows FROM (SELECT CASE WHEN closed THEN 1 WHEN exclusion THEN 2 WHEN construction THEN 3 WHEN relevance THEN 4 ELSE 6 END AS reached FROM ({_STAGED})) GROUP BY 1""",
)
def funnel_reached(spark: SparkSession, d: str) -> DataFrame:
    """How many stages a run that stops at the first drop gets to see."""
    staged = with_stages(_notices(spark, d, *_FUNNEL_COLUMNS), funnel_stages())
    return staged.groupBy(F.size(reached()).alias("reached")).agg(F.count("*").alias("n_rows"))


@catalog.query(
    "earliest_per_event",
    f"""WITH n AS (SELECT *, {day_sql('publication_date')} AS day, CASE WHEN lower(trim(coalesce(solicitation_number, ''))) IN ('', '-', 'nan') THEN 'r:' || reference_number ELSE 's:' || trim(solicitation_number) END AS event FROM notices)
    SELECT event, strftime(min(day), '%Y-%m-%d') AS first_day, min(reference_number) FILTER (WHERE day = m) AS reference_number, count(*) AS n_rows
    FROM (SELECT *, min(day) OVER (PARTITION BY event) AS m FROM n WHERE event IS NOT NULL AND day IS NOT NULL) GROUP BY event""",
)
def earliest_per_event(spark: SparkSession, d: str) -> DataFrame:
    """First publication of each procurement and the row it has; a combinable minimum, no window."""
    rows = _notices(spark, d, "solicitation_number", "publication_date")
    rows = rows.select(T.event_identity("solicitation_number", "reference_number").alias("event"), readable_day("publication_date").alias("day"), "reference_number")
    first = rows.where("event IS NOT NULL AND day IS NOT NULL").groupBy("event").agg(F.min(F.struct("day", "reference_number")).alias("f"), F.count("*").alias("n_rows"))
    return first.select("event", iso("f.day").alias("first_day"), "f.reference_number", "n_rows")


@catalog.query(
    "org_attribution",
    """WITH k AS (SELECT reference_number, amendment_number, org_key_source, trim(unnest(string_split(org_keys, ','))) AS dept_key FROM notices)
    SELECT dept_key, coalesce(org_key_source, '') AS source, count(DISTINCT (reference_number, amendment_number)) AS n_notices FROM k WHERE dept_key <> '' GROUP BY 1, 2""",
)
def org_attribution(spark: SparkSession, d: str) -> DataFrame:
    rows = _notices(spark, d, "org_keys", "org_key_source").select(*KEY, F.coalesce("org_key_source", F.lit("")).alias("source"), F.explode(T.split_keys("org_keys")).alias("dept_key"))
    return rows.groupBy("dept_key", "source").agg(F.countDistinct(F.struct(*KEY)).alias("n_notices"))


@catalog.query(
    "source_systems",
    "SELECT coalesce(nullif(regexp_extract(reference_number, '^([A-Za-z]+)', 1), ''), '?') AS system, count(*) AS n_rows FROM notices GROUP BY 1",
)
def source_systems(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "notices", "reference_number").groupBy(T.source_prefix("reference_number").alias("system")).agg(F.count("*").alias("n_rows"))
