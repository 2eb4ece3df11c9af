"""Names, quotes and boilerplate in the documents, and logs of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kelda.functions.text import sentences, words_only
from kelda.operators.notes import current_state, first_and_last
from kelda.operators.prose import FIRM_ENDINGS, attested, ceiling_flags, lines_page, name_runs, quotes, scan_phrases, without_supplier_lists
from kelda.plans.registry import Catalog
from kelda.sources.tables import table

catalog = Catalog()

#: Most entries of a list of names that is scanned for in one expression.
MAX_LIST = 10_000

PROBES = {"security": ["security clearance", "cote de s[ée]curit[ée]"], "travel": ["travel or living expenses", "frais de d[ée]placement"], "deadline": ["ahead of the deadline", "avant l'[ée]ch[ée]ance"]}
BOILERPLATE = ["extends the closing date", "reporte la date de cl[oô]ture"]
NAMES = {"records centre": [], "northern district": [], "finance branch": [], "list of vendors": ["the list of vendors", "revised list of vendors"]}
_SENT = r"list_filter(list_transform(string_split_regex(regexp_replace(coalesce(%s, ''), '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '')"
_PAD = r"(' ' || trim(regexp_replace(replace(lower(strip_accents(text)), '&', ' and '), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ')"


def _mentions_sql(p: str) -> str:
    wide = f" {p.replace(' ', '  ')} "
    return f"CAST((length(w) - length(replace(w, '{wide}', ''))) / {len(wide)} AS INT)"


@catalog.query(
    "attestation_counts",
    f"WITH d AS (SELECT replace({_PAD}, ' ', '  ') AS w FROM documents WHERE text IS NOT NULL) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS name, count(*) FILTER (WHERE own > 0) AS n_documents, CAST(coalesce(sum(own), 0) AS BIGINT) AS n_mentions FROM (SELECT greatest({_mentions_sql(n)}{''.join(' - ' + _mentions_sql(x) for x in longer)}, 0) AS own FROM d)"
        for n, longer in NAMES.items()
    ),
)
def attestation_counts(spark: SparkSession, d: str) -> DataFrame:
    return attested(table(spark, d, "documents", "text").where("text IS NOT NULL"), "text", NAMES)


@catalog.query(
    "probe_quotes",
    " UNION ALL ".join(
        f"""SELECT doc_id, '{n}' AS probe, CAST(least(len(q), 6) AS INT) AS n_quotes FROM (SELECT doc_id, list_distinct(list_transform(list_filter({_SENT % 'text'}, lambda x: regexp_matches(x, '(?i){'|'.join(p).replace("'", "''")}')), lambda x: left(x, 400))) AS q FROM documents) WHERE len(q) > 0"""
        for n, p in PROBES.items()
    ),
)
def probe_quotes(spark: SparkSession, d: str) -> DataFrame:
    return quotes(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", PROBES).select("doc_id", "probe", "n_quotes")


@catalog.query(
    "ceiling_flags",
    f"""SELECT short, boilerplate_only, count(*) AS n_rows FROM (SELECT length(trim(coalesce(description, ''))) < 200 AS short,
      trim(coalesce(description, '')) <> '' AND len(list_filter({_SENT % "trim(coalesce(description, ''))"}, lambda x: NOT regexp_matches(x, '(?i){'|'.join(BOILERPLATE)}'))) = 0 AS boilerplate_only FROM notices) GROUP BY 1, 2""",
)
def ceiling(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "notices", "description").select(ceiling_flags(F.col("description"), BOILERPLATE).alias("f"))
    return rows.groupBy("f.short", "f.boilerplate_only").agg(F.count("*").alias("n_rows"))


@catalog.query("sentence_counts", f"SELECT doc_id, len({_SENT % 'text'}) AS n_sentences FROM documents")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(sentences("text")).cast("bigint").alias("n_sentences"))


@catalog.query(
    "name_runs",
    r"""WITH r AS (SELECT unnest(regexp_extract_all(contracting_entity, '((?:\p{Lu}[\p{L}''’-]+ (?:of |for |the |and )?){1,6}(?:Agency|Tribunal|Council))\b', 1)) AS run FROM notices WHERE contracting_entity IS NOT NULL)
    SELECT run, count(*) AS n_rows FROM r GROUP BY run""",
)
def runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of capitalised words that look like bodies, counted."""
    rows = table(spark, d, "notices", "contracting_entity").where("contracting_entity IS NOT NULL")
    return rows.select(F.explode(name_runs(F.col("contracting_entity"), ["Agency", "Tribunal", "Council"])).alias("run")).groupBy("run").agg(F.count("*").alias("n_rows"))


@catalog.query(
    "lines_page",
    """SELECT doc_id, CAST(i - 1 AS INT) AS line_no, md5(l[i]) AS digest, CAST(len(l) AS INT) AS total FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), LATERAL (SELECT unnest(range(3, least(len(l), 12) + 1)) AS i)""",
)
def page(spark: SparkSession, d: str) -> DataFrame:
    """Lines 2 to 11 of every document."""
    rows = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL")
    return lines_page(rows, "doc_id", "text", 2, 10).select("doc_id", "line_no", F.md5("line").alias("digest"), "total")


@catalog.query("phrase_scan")
def phrase_scan(spark: SparkSession, d: str) -> DataFrame:
    """Listed bodies named in the notices' entity fields, longer names first; tested against a plain scan."""
    listed = table(spark, d, "institution_list").select("dept_key", words_only("name_en").alias("en"), words_only("name_fr").alias("fr")).limit(MAX_LIST + 1).collect()
    if len(listed) > MAX_LIST:
        raise ValueError(f"the list has more than {MAX_LIST} entries")
    phrases = {p: r.dept_key for r in listed for p in (r.en, r.fr) if p}
    return scan_phrases(table(spark, d, "notices", "reference_number", "contracting_entity"), "reference_number", "contracting_entity", phrases).distinct()


_LINE = r"trim(regexp_replace(l, '^\s*(?:[-*•]|[0-9]{1,3}[.)])\s*', ''))"
_MARKED = rf"""array_to_string(list_transform(string_split(description, chr(10)), lambda l: CASE WHEN {_LINE} = '' THEN chr(3)
  WHEN len(string_split_regex({_LINE}, '\s+')) <= 10 AND length({_LINE}) <= 200 AND regexp_matches({_LINE}, '(?i)\b(?:{FIRM_ENDINGS})\.?\s*$') THEN chr(1)
  WHEN len(string_split_regex({_LINE}, '\s+')) <= 10 AND NOT regexp_matches({_LINE}, '[.:;]$') THEN chr(2) ELSE chr(4) END || l), chr(10))"""


@catalog.query(
    "supplier_lists",
    rf"""WITH m AS (SELECT reference_number, amendment_number, {_MARKED} AS t FROM notices WHERE description IS NOT NULL),
      r AS (SELECT reference_number, amendment_number, t, regexp_extract_all(t, '\x01[^\x04]*\x01[^\n]*|\x01[^\n]*') AS runs FROM m),
      c AS (SELECT reference_number, amendment_number, list_filter(runs, lambda x: length(x) - length(replace(x, chr(1), '')) >= 10
        AND length(x) - length(replace(x, chr(1), '')) >= 0.8 * (2 * length(x) - length(replace(x, chr(1), '')) - length(replace(x, chr(2), '')))) AS runs FROM r)
    SELECT reference_number, amendment_number, CAST(coalesce(list_sum(list_transform(runs, lambda x: length(regexp_replace(x, '[\x01-\x04]', '', 'g')) - 19)), 0) AS INT) AS taken FROM c""",
)
def supplier_lists(spark: SparkSession, d: str) -> DataFrame:
    """Characters that stripping lists of suppliers takes from each description."""
    rows = table(spark, d, "notices", "reference_number", "amendment_number", "description").where("description IS NOT NULL")
    return rows.select("reference_number", "amendment_number", (F.length("description") - F.length(without_supplier_lists(F.col("description")))).alias("taken"))


@catalog.query("event_states", "SELECT user_id, arg_max(event_type, (ts, event_type)) AS event_type, max(ts) AS ts, count(*) AS n_events FROM events GROUP BY user_id")
def event_states(spark: SparkSession, d: str) -> DataFrame:
    return current_state(table(spark, d, "events", "user_id", "ts", "event_type"), "user_id", "ts", "event_type")


@catalog.query("first_and_last_events", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS \"first\", arg_max(event_id, (ts, event_id)) AS \"last\", count(*) AS n FROM events GROUP BY 1, 2")
def first_last(spark: SparkSession, d: str) -> DataFrame:
    return first_and_last(table(spark, d, "events", "user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], "ts", "event_id")
