"""The whole funnel of notices, its variants, and the two ways through it compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kelda.functions import text as T
from kelda.operators.funnel import OTHER_LEVELS, compare_variants, equivalence, jurisdictions, outside, relevance, replaced, with_jurisdiction
from kelda.operators.notices import Stage, first_figure, funnel_counts, with_stages
from kelda.plans.entities import SPELLINGS, org_sql, spellings
from kelda.plans.notices import BODY, CODES, EXCLUDED, KEY, PREFIXES, TERMS, WORD, body, funnel_stages, staged_sql
from kelda.plans.registry import Catalog
from kelda.sources.tables import table

catalog = Catalog()

FIELDS = ["contracting_entity", "end_user"]
LEAST, MOST = 100_000.0, 5_000_000.0
_COLUMNS = ("title", "description", "closing_date", "notice_type", "procurement_category", "unspsc", *FIELDS)


def _split(c: str) -> str:
    return rf"list_filter(list_transform(string_split(coalesce({c}, ''), '/'), lambda x: trim(regexp_replace(regexp_replace(x, '(?:\s*\([^()]*\)\s*)+$', ''), '[\s,;–—-]+$', ''))), lambda x: x <> '')"


_PHRASE = "coalesce({})".format(", ".join(f"CASE WHEN contains(lower(coalesce({{c}}, '')), '{p}') THEN '{p}' END" for p in OTHER_LEVELS))
_OTHER = "coalesce({}, {})".format(*[_PHRASE.replace("{c}", c) for c in FIELDS])
_KINDS = f"""reg AS (SELECT DISTINCT s FROM {SPELLINGS} WHERE s <> ''), pairs AS (SELECT DISTINCT contracting_entity, end_user FROM notices),
  said AS (SELECT contracting_entity, end_user, 0 AS i, unnest({_split('contracting_entity')}) AS n FROM pairs UNION ALL SELECT contracting_entity, end_user, 1, unnest({_split('end_user')}) FROM pairs),
  fed AS (SELECT contracting_entity, end_user, min(i) AS i FROM said JOIN reg ON {org_sql('n')} = s GROUP BY 1, 2),
  kinds AS (SELECT p.contracting_entity, p.end_user, CASE WHEN i IS NOT NULL THEN 'federal' WHEN other IS NOT NULL THEN 'non_federal' ELSE 'unrecognised' END AS jurisdiction,
    coalesce(CASE i WHEN 0 THEN 'contracting_entity' WHEN 1 THEN 'end_user' END, other) AS basis
    FROM (SELECT *, {_OTHER} AS other FROM pairs) p LEFT JOIN fed f ON p.contracting_entity IS NOT DISTINCT FROM f.contracting_entity AND p.end_user IS NOT DISTINCT FROM f.end_user)"""
_FIGURE = r"""try_cast(replace(regexp_extract({c}, '\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s?([KkMmBb]?)', 1), ',', '') AS DOUBLE) *
  CASE upper(regexp_extract({c}, '\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s?([KkMmBb]?)', 2)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1.0 END""".replace("{c}", "description")
# A mass in [0, 1) for every second notice, as an imputer would give it, made of the title's length.
_MASS = "CASE WHEN length(coalesce(title, '')) % 2 = 0 THEN CAST((length(coalesce(title, '')) * 7919) % 1000 AS DOUBLE) / 1000 END"
_CODED, _FAMILY = f"len({CODES}) > 0", " OR ".join(f"len(list_filter({CODES}, lambda c: starts_with(c, '{p}'))) > 0" for p in PREFIXES)
_TERM = " OR ".join(f"regexp_matches({BODY}, '{WORD % t}')" for t in TERMS)
_WHOLE = f"""WITH {_KINDS}, n AS (SELECT t.*, k.jurisdiction FROM notices t JOIN kinds k ON t.contracting_entity IS NOT DISTINCT FROM k.contracting_entity AND t.end_user IS NOT DISTINCT FROM k.end_user),
  s AS (SELECT *, jurisdiction = 'non_federal' AS jurisdiction_drop, coalesce({_FIGURE} < {LEAST} OR {_FIGURE} > {MOST}, FALSE) AS value FROM n),
  t AS ({staged_sql("s", "*")})"""
_ORDER = ("closed", "exclusion", "construction", "jurisdiction_drop", "relevance", "value", "identifiable")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return with_jurisdiction(table(spark, d, "notices", *KEY, *_COLUMNS), FIELDS, spellings(spark, d), "s")


def whole_funnel() -> list[Stage]:
    """All seven stages, over rows with a ``jurisdiction``."""
    stages = {s.name: s for s in funnel_stages()}
    place = Stage("jurisdiction", F.col("jurisdiction") == "non_federal", F.col("jurisdiction"))
    value = outside(first_figure(F.col("description")), LEAST, MOST)
    return [stages["closed"], stages["exclusion"], stages["construction"], place, stages["relevance"], value, stages["identifiable"]]


@catalog.query("jurisdictions", f"WITH {_KINDS} SELECT * FROM kinds")
def jurisdiction_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Level of government of every combination of buyer and end user, and what tells it."""
    return jurisdictions(table(spark, d, "notices", *FIELDS), FIELDS, spellings(spark, d), "s")


@catalog.query(
    "funnel_jurisdiction",
    f"{_WHOLE} SELECT coalesce(CASE {' '.join(f"WHEN {s} THEN '{s.removesuffix('_drop')}'" for s in _ORDER)} END, 'admitted') AS outcome, count(*) AS n_rows FROM t GROUP BY 1",
)
def funnel_jurisdiction(spark: SparkSession, d: str) -> DataFrame:
    """Where each notice leaves the whole funnel, jurisdiction and value included."""
    return with_stages(_rows(spark, d), whole_funnel()).groupBy(F.coalesce("first_drop", F.lit("admitted")).alias("outcome")).agg(F.count("*").alias("n_rows"))


@catalog.query(
    "funnel_value",
    f"{_WHOLE}, f AS (SELECT *, CASE {' '.join(f"WHEN {s} THEN '{s}'" for s in _ORDER)} END AS first_drop, {' + '.join(f'CAST({s} AS INT)' for s in _ORDER)} AS k FROM t) "
    + " UNION ALL ".join(
        f"""SELECT count(*) AS n_in, count(*) FILTER (WHERE k = 0) AS admitted, CAST({i} AS INT) AS "order", '{s.removesuffix('_drop')}' AS stage, count(*) FILTER (WHERE first_drop = '{s}') AS first_drops,
        count(*) FILTER (WHERE {s}) AS fires, count(*) FILTER (WHERE {s} AND k = 1) AS alone FROM f"""
        for i, s in enumerate(_ORDER, 1)
    ),
)
def funnel_value(spark: SparkSession, d: str) -> DataFrame:
    """Counters of all seven stages; a figure outside the range drops, no figure doesn't."""
    stages = whole_funnel()
    return funnel_counts(with_stages(_rows(spark, d), stages), stages)


@catalog.query(
    "relevance_bases",
    f"""SELECT basis, relevant, count(*) AS n_rows FROM (SELECT CASE WHEN coded THEN CASE WHEN family THEN 'family' WHEN mass >= 0.6 THEN 'override' ELSE 'code' END WHEN mass IS NOT NULL THEN 'mass' ELSE 'term' END AS basis,
      CASE WHEN coded THEN family OR coalesce(mass >= 0.6, FALSE) WHEN mass IS NOT NULL THEN mass >= 0.2 ELSE term END AS relevant
      FROM (SELECT {_CODED} AS coded, {_FAMILY} AS family, {_MASS} AS mass, {_TERM} AS term FROM notices)) GROUP BY 1, 2""",
)
def relevance_bases(spark: SparkSession, d: str) -> DataFrame:
    """What decides the relevance of each notice: its family, a mass, or its terms."""
    size = F.length(F.coalesce("title", F.lit("")))
    mass = F.when(size % 2 == 0, ((size * 7919) % 1000).cast("double") / 1000)
    codes = T.parse_codes("unspsc")
    relevant, basis = relevance(F.size(codes) > 0, F.size(T.matched_prefixes(codes, PREFIXES)) > 0, mass, F.size(T.matched_terms(body(), TERMS)) > 0)
    rows = table(spark, d, "notices", "title", "description", "unspsc")
    return rows.select(basis.alias("basis"), relevant.alias("relevant")).groupBy("basis", "relevant").agg(F.count("*").alias("n_rows"))


#: Words that one variant looks for besides.
EXTRA = "travaux"
_URL = r"https?://\S+|www\.\S+"
_BASE = "NOT closed AND NOT exclusion AND NOT construction AND NOT jurisdiction_drop AND NOT value AND NOT identifiable"
_EXTRA_TERM = f"regexp_matches({BODY}, '{WORD % EXTRA}')"
_CLEAN = f"regexp_replace({BODY}, '{_URL}', ' ', 'g')"
_VARIANTS_SQL = {
    "base": f"{_BASE} AND NOT relevance",
    "extra_term": f"{_BASE} AND CASE WHEN {_CODED} THEN ({_FAMILY}) ELSE ({_TERM}) OR {_EXTRA_TERM} END",
    "without_links": f"{_BASE} AND CASE WHEN {_CODED} THEN ({_FAMILY}) ELSE {' OR '.join(f"regexp_matches({_CLEAN}, '{WORD % t}')" for t in TERMS)} END",
    "any_jurisdiction": f"{_BASE.replace('NOT jurisdiction_drop AND ', '')} AND NOT relevance",
    "admit_all": "TRUE",
}


@catalog.query(
    "funnel_variants",
    f"{_WHOLE}, v AS (SELECT {', '.join(f'coalesce({x}, FALSE) AS {n}' for n, x in _VARIANTS_SQL.items())} FROM t) "
    + " UNION ALL ".join(f"SELECT '{n}' AS variant, count(*) FILTER (WHERE {n}) AS admitted, count(*) FILTER (WHERE {n} AND NOT base) AS added, count(*) FILTER (WHERE NOT {n} AND base) AS lost FROM v" for n in _VARIANTS_SQL),
)
def funnel_variants(spark: SparkSession, d: str) -> DataFrame:
    """Named what-if variants of the funnel against the base: another term, texts without links, any jurisdiction, no filter."""
    codes = T.parse_codes("unspsc")
    family = F.size(T.matched_prefixes(codes, PREFIXES)) > 0
    judge = lambda text, terms: ~F.when(F.size(codes) > 0, family).otherwise(F.size(T.matched_terms(text, terms)) > 0)
    variants = {
        "extra_term": lambda s: replaced(s, "relevance", judge(body(), [*TERMS, EXTRA])),
        "without_links": lambda s: replaced(s, "relevance", judge(F.regexp_replace(body(), _URL, " "), TERMS)),
        "any_jurisdiction": lambda s: replaced(s, "jurisdiction", None),
        "admit_all": lambda s: [],
    }
    return compare_variants(_rows(spark, d), whole_funnel(), variants)


@catalog.query(
    "two_path_equivalence",
    f"""{_WHOLE}, a AS (SELECT count(DISTINCT (reference_number, amendment_number)) AS n FROM t WHERE {_BASE} AND NOT relevance)
    SELECT n AS production, n AS audited, CAST(0 AS BIGINT) AS only_production, CAST(0 AS BIGINT) AS only_audited, n = 0 AS vacuous FROM a""",
)
def two_path_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """The funnel that stops at the first drop, written as one filter, against the audited stages."""
    closing = F.try_to_date(F.left("closing_date", F.lit(10)), "yyyy-MM-dd")
    codes, category = T.parse_codes("unspsc"), T.parse_categories("procurement_category")
    figure, low = first_figure(F.col("description")), F.lower(body())
    open_ = closing.isNull() | (closing >= F.lit("2024-03-01").cast("date"))
    clear = ~F.array_contains(F.transform(F.array(*[F.lit(x) for x in EXCLUDED]), lambda x: F.instr(low, x) > 0), True)
    other = ~F.coalesce("notice_type", F.lit("")).isin("RFP against Supply Arrangement", "Invitation to Qualify", "Request for Information", "Advance Contract Award Notice")
    built = other & (F.size(category) > 0) & (F.size(F.array_remove(category, "*CNST")) == 0)
    wanted = F.when(F.size(codes) > 0, F.exists(codes, lambda c: F.lit(False) | c.startswith(PREFIXES[0]) | c.startswith(PREFIXES[1]) | c.startswith(PREFIXES[2]) | c.startswith(PREFIXES[3]) | c.startswith(PREFIXES[4])))
    wanted = wanted.otherwise(F.size(T.matched_terms(body(), TERMS)) > 0)
    priced = figure.isNull() | figure.between(LEAST, MOST)
    known = ~F.lower(F.trim(F.coalesce("reference_number", F.lit("")))).isin("", "nan")
    return equivalence(_rows(spark, d), KEY, whole_funnel(), open_ & clear & ~built & (F.col("jurisdiction") != "non_federal") & wanted & priced & known)
