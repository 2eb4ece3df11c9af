"""Queries of the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kelda.llm.bodies import BodyParser
from kelda.llm.canonical import MatchRules, NameMatcher, map_to_list
from kelda.llm.langid import NOTATIONS, LangRules, fit_language_model, label_languages, label_segments
from kelda.llm.leakage import find_leaks
from kelda.llm.level import reading_levels
from kelda.llm.linkage import BODY_PASSES, body_comparisons, body_records, link
from kelda.llm.packing import pack
from kelda.llm.tokenizer import count_tokens
from kelda.llm.variants import link_variants, variant_pairs
from kelda.plans.registry import Catalog
from kelda.sources.tables import table

catalog = Catalog()

# Words that make a body one of another level of government, or no public body, in English and French.
ELSEWHERE = (
    "province provincial provinciale municipal municipale municipality municipalite city ville mayor mairie university universite school ecole chamber"
    " embassy ambassade consulate union society association friends parliament parlement deputies senate"
).split()
#: Most entries of a canonical list that is broadcast.
MAX_LIST = 10_000


@catalog.query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a passage of a held-out item, and the item."""
    return find_leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


@catalog.query("p5_segments")
def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of every notice field with its language and confidence, numbered from 1."""
    rows = table(spark, d, "notices", "reference_number", "amendment_number", "title", "description", "lang_label")
    model = fit_language_model(rows, ["title", "description"], "lang_label", ["reference_number", "amendment_number"])
    fields = label_segments(rows, ["title", "description"], model).select(
        "reference_number",
        "amendment_number",
        F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_segments").alias("segments")) for c in ("title", "description")])).alias("f"),
    )
    each = fields.select("reference_number", "amendment_number", "f.field", F.posexplode("f.segments").alias("n", "s"))
    return each.select("reference_number", "amendment_number", "field", (F.col("n") + 1).alias("segment"), "s.lang", "s.text", "s.confidence").distinct()


@catalog.query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of the notice fields that are not wholly in the language of their label."""
    rows = table(spark, d, "notices", "reference_number", "amendment_number", "title", "description", "lang_label")
    model = fit_language_model(rows, ["title", "description"], "lang_label", ["reference_number", "amendment_number"])
    named = F.create_map(*[F.lit(x) for code, names in NOTATIONS.items() for n in names for x in (n, code)])
    label = F.try_element_at(named, F.trim(F.split(F.lower(F.trim("lang_label")), "[-_(]").getItem(0)))
    fields = label_languages(rows, ["title", "description"], model).select(
        "reference_number",
        "amendment_number",
        label.alias("named"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"{c}_langs").alias("langs")) for c in ("title", "description")])).alias("f"),
    )
    wrong = fields.where(F.col("named").isNull() | (F.col("f.langs") != F.array("named")))
    return wrong.select("reference_number", "amendment_number", "f.field", F.explode("f.langs").alias("lang")).distinct()


def _levels(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents", "doc_id", "text", "lang")
    model = fit_language_model(documents, ["text"], "lang", ["doc_id"], LangRules(sample=1500))
    return reading_levels(documents, table(spark, d, "level_labels", "doc_id", "level"), model)


@catalog.query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents wholly in English or French that read plainly (level 1) or need an expert (level 5)."""
    known = _levels(spark, d).where(F.col("wholly") & F.col("lang").isin("en", "fr"))
    band = F.when(F.col("level") == 1, "plain").when(F.col("level") == 5, "expert")
    return known.select("doc_id", band.alias("band")).where(F.col("band").isNotNull()).distinct()


@catalog.query("p10_levels")
def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """Language, coverage rank, level and its probability of every document."""
    return _levels(spark, d)


@catalog.query("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container of 2,048 tokens of every document, or of each piece of a longer one."""
    documents = table(spark, d, "documents", "doc_id", "text")
    packed = pack(documents.select("doc_id", count_tokens(F.col("text")).alias("tokens")), "doc_id", "tokens")
    return packed.select("container", F.col("item").alias("doc_id"), "piece", F.col("size").alias("tokens"), "fill")


@catalog.query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The listed body that every freely typed institution names, or 'unmatched'."""
    listed = table(spark, d, "institution_list").limit(MAX_LIST + 1).collect()
    if len(listed) > MAX_LIST:
        raise ValueError(f"the list has more than {MAX_LIST} entries")
    official = {n: r.dept_key for r in listed for n in (r.name_en, r.name_fr) if n}
    columns = ["institution", "dept_key"]
    rows = table(spark, d, "communication_dpohs", "dpoh_id", *columns).select(F.lit("communication_dpohs").alias("src"), F.col("dpoh_id").alias("row_id"), *columns)
    rows = rows.unionByName(
        table(spark, d, "registration_institutions", "reg_inst_id", *columns).select(F.lit("registration_institutions").alias("src"), F.col("reg_inst_id").alias("row_id"), *columns)
    )
    written = rows.where(F.col("institution").isin(list(official))).groupBy("institution").count().collect()
    frequency: dict[str, int] = {}
    for r in written:
        frequency[official[r["institution"]]] = frequency.get(official[r["institution"]], 0) + r["count"]
    entries = [(r.dept_key, [n for n in (r.name_en, r.name_fr, r.former_name) if n], [r.acronym] if r.acronym else []) for r in listed]
    typed = rows.where(~F.col("institution").isin(list(official)) & (F.trim(F.regexp_replace("institution", r"\s", " ")) != ""))
    mapped = map_to_list(typed, "institution", "dept_key", NameMatcher(entries, MatchRules(), frequency, ELSEWHERE))
    return mapped.select("src", "row_id", "list_key").distinct()


@catalog.query("p2_links")
def p2_links(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate pair of unpaired contract and plan bodies with its agreement levels and confidence."""
    listed = table(spark, d, "institution_list", "name_en", "name_fr", "kind").where("kind = 'department'").limit(MAX_LIST + 1).collect()
    if len(listed) > MAX_LIST:
        raise ValueError(f"the list has more than {MAX_LIST} entries")
    # What stands before the mandate in a department's official names.
    mandates = [(re.sub(r"^Department of ", "", r.name_en), re.sub(r"^Ministère (?:de la |de l'|du |des |de )", "", r.name_fr)) for r in listed]
    parser = BodyParser(mandates)
    rows = table(spark, d, "org_crosswalk")
    contracts = rows.where("contract_owner_org IS NOT NULL AND plan_organization_id IS NULL")
    plans = rows.where("contract_owner_org IS NULL AND plan_organization_id IS NOT NULL")
    left = body_records(contracts, "contract_owner_org", ["contract_org_title", "contract_org_en", "observed_names"], parser, "c_")
    right = body_records(plans, "plan_organization_id", ["plan_organization", "plan_organization_former", "observed_names"], parser, "p_")
    return link(left, right, "contract_owner_org", "plan_organization_id", BODY_PASSES, body_comparisons())


@catalog.query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of unpaired contract and plan bodies that are the same body."""
    links = p2_links(spark, d).where(F.col("confidence") >= 0.5)
    best = Window.partitionBy("contract_owner_org").orderBy(F.col("confidence").desc(), "plan_organization_id")
    return links.withColumn("n", F.row_number().over(best)).where("n = 1").select("contract_owner_org", "plan_organization_id").distinct()


@catalog.query("p4_entities")
def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entity of every vendor and client spelling that has one, with the rule and its rarity."""
    names = table(spark, d, "contracts").select(F.col("vendor").alias("name")).unionByName(table(spark, d, "communications").select(F.col("client_name").alias("name")))
    return link_variants(names, "name")


@catalog.query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different spellings of one firm or person, across contracts and communications."""
    return variant_pairs(p4_entities(spark, d))
