"""Column builders for titles, links, citations and answers of records. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# How a committee's name begins; what is named after it is who heard a report, not who it is about.
COMMITTEE = r"(?i)\b(?:standing|special|joint) committee on (?:the )?[\p{L}-]+(?:(?:, | and |, and )[\p{L}-]+)*"
# Kinds of documents by what their titles hold, in order.
DOCUMENT_KINDS = [
    ("committee_hearing", ("briefing package", "hearing before")), ("performance_audit", ("reports of the auditor general", "report of the commissioner")),
    ("special_examination", ("special examination",)), ("financial_audit", ("financial audit", "financial statements")),
]


def strip_committees(c: Column) -> Column:
    """Text without names of committees; '' for NULL."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), COMMITTEE, " ")


def year_in_title(c: Column) -> Column:
    """INT of the first year from 2000 to 2099; NULL without one."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), "(20[0-9]{2})", 1).try_cast("int")


def published_day(c: Column) -> Column:
    """The first ten characters where they are a day in ISO form, else ''."""
    ten = F.left(F.coalesce(c, F.lit("")), F.lit(10))
    return F.when(ten.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), ten).otherwise("")


def document_kind(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    tests = [F.when(F.exists(F.array(*[F.lit(x) for x in held]), lambda x: F.instr(low, x) > 0), F.lit(kind)) for kind, held in DOCUMENT_KINDS]
    return F.coalesce(*tests, F.lit("other"))


def numbers_in_links(c: Column, pattern: str = r"https?://[^\s]*?([0-9]{3,})") -> Column:
    """ARRAY of the different numbers that a text's links hold, sorted; empty for NULL."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(1))))


def first_named(c: Column, issuers: list[tuple[str, str]]) -> Column:
    """The first issuer, in the given order, whose pattern a text holds; NULL for none."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(*[F.when(low.rlike(p), F.lit(n)) for n, p in issuers])


def firm_in_relation(c: Column) -> Column:
    """The firm that a text names as party to a contract ('contract awarded to X Inc.'), '' for none."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?:awarded to|contracts? with|supplied by) ((?:\p{Lu}[\p{L}'-]*\s){1,5}(?:Inc|Ltd|Corp|LLP))\b", 1)
    return F.trim(found)


def display_agency(end_user: Column, contracting: Column) -> Column:
    """Whom a notice is for: the end user, else the contracting entity, else ''."""
    known = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(known(end_user), known(contracting), F.lit(""))


def state_hash(title: Column, description: Column, budget: int = 60_000) -> Column:
    """SHA-256 of a record's prepared state: its title and the description cut to the budget the title leaves."""
    t = F.coalesce(title, F.lit(""))
    d = F.left(F.coalesce(description, F.lit("")), F.greatest(F.lit(0), F.lit(budget) - F.length(t)))
    return F.sha2(F.to_json(F.struct(d.alias("description"), t.alias("title"))), 256)


def blinded(rows: DataFrame, shown: list[str], withheld: list[str]) -> DataFrame:
    """Only the columns that a reviewer may see. Raises if one of them is withheld, in any case, or is missing."""
    hidden = {w.lower() for w in withheld}
    leaked = [c for c in shown if c.lower() in hidden]
    if leaked:
        raise ValueError(f"withheld columns would be shown: {', '.join(leaked)}")
    return rows.select(*[F.col(f"`{c}`") for c in shown])


def parsed_answer(c: Column, choices: list[str]) -> Column:
    """STRUCT<choice, mass, problem> of a JSON answer {"choice": .., "mass": ..}.

    problem says why an answer can't be used: no JSON, an unknown choice, a mass outside
    [0, 1]; it is NULL for a good one, and choice and mass are NULL for a bad one.
    """
    a = F.from_json(F.trim(F.regexp_replace(c, r"(?s)^\s*```(?:json)?|```\s*$", "")), "choice string, mass double")
    problem = F.when(a.isNull() | (a["choice"].isNull() & a["mass"].isNull()), "no answer").when(~F.coalesce(a["choice"].isin(choices), F.lit(False)), "unknown choice").when(~F.coalesce(a["mass"].between(0, 1), F.lit(False)), "mass out of range")
    return F.struct(F.when(problem.isNull(), a["choice"]).alias("choice"), F.when(problem.isNull(), a["mass"]).alias("mass"), problem.alias("problem"))
