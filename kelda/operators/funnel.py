"""Pieces of the notices' funnel that need more than a row's own columns: jurisdiction, value ranges, variants, equivalence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from kelda.functions import text as T
from kelda.operators.notices import Stage, with_stages

# Phrases that make a buyer one of another level of government.
OTHER_LEVELS = ("province of", "provincial government", "municipality of", "city of", "town of", "ville de", "municipalité", "university", "université", "school board", "commission scolaire", "hospital", "hôpital")


def other_level(text: Column, phrases: tuple[str, ...] = OTHER_LEVELS) -> Column:
    """The first of the phrases, in their order, that a text holds; NULL for none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(F.instr(low, p) > 0, F.lit(p)) for p in phrases])


def jurisdictions(rows: DataFrame, fields: list[str], registry: DataFrame, spelling: str, phrases: tuple[str, ...] = OTHER_LEVELS) -> DataFrame:
    """Distinct ``fields`` with ``jurisdiction`` and ``basis``.

    'federal' where a name of some field is a spelling of the registry (basis: that field,
    the first one that has it), 'non_federal' only where a phrase says so (basis: the
    phrase), else 'unrecognised'. Names are split and normalised as the registry is; only
    distinct combinations are resolved, however many rows have them. NULL fields name nothing.
    """
    known = registry.where(F.col(spelling) != "").select(F.col(spelling).alias("__s")).distinct()
    # NULLs don't join, so a combination goes by its position-true text.
    pairs = rows.select(*fields).distinct().withColumn("__id", F.to_json(F.array(*fields)))

    def named(i: int) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(i).alias("i"), T.normalize_org(x).alias("s"))

    names = [F.transform(T.split_entities(F.coalesce(f, F.lit(""))), named(i)) for i, f in enumerate(fields)]
    said = pairs.select("__id", F.explode(F.concat(*names)).alias("n")).select("__id", "n.i", F.col("n.s").alias("__s"))
    found = said.join(known, "__s").groupBy("__id").agg(F.min("i").alias("__i"))
    other = F.coalesce(*[other_level(F.col(f), phrases) for f in fields])
    field = F.coalesce(*[F.when(F.col("__i") == i, F.lit(f)) for i, f in enumerate(fields)])
    kind = F.when(F.col("__i").isNotNull(), "federal").when(other.isNotNull(), "non_federal").otherwise("unrecognised")
    return pairs.join(found, "__id", "left").select(*fields, kind.alias("jurisdiction"), F.coalesce(field, other).alias("basis"))


def with_jurisdiction(rows: DataFrame, fields: list[str], registry: DataFrame, spelling: str) -> DataFrame:
    """rows with ``jurisdiction``; combinations are resolved once and joined back, NULLs with NULLs."""
    kinds = jurisdictions(rows, fields, registry, spelling).select(F.to_json(F.array(*fields)).alias("__id"), "jurisdiction")
    return rows.withColumn("__id", F.to_json(F.array(*fields))).join(kinds, "__id", "left").drop("__id")


def outside(value: Column, least: float | None, most: float | None) -> Stage:
    """A stage that drops a value outside [least, most]; NULL stays, and without a bound it is inactive."""
    low = F.lit(False) if least is None else value < least
    high = F.lit(False) if most is None else value > most
    return Stage("value", low | high, value, active=least is not None or most is not None)


def relevance(coded: Column, family: Column, mass: Column, term: Column, override: float = 0.60, gate: float = 0.20) -> tuple[Column, Column]:
    """(relevant, basis): a coded notice by its family, or by a mass of ``override``; another by a mass of
    ``gate`` where one was imputed, else by its terms. NULL masses were not imputed."""
    by_code = family | F.coalesce(mass >= override, F.lit(False))
    basis = F.when(coded, F.when(family, "family").when(mass >= override, "override").otherwise("code")).when(mass.isNotNull(), "mass").otherwise("term")
    return F.when(coded, by_code).when(mass.isNotNull(), mass >= gate).otherwise(term), basis


def compare_variants(rows: DataFrame, base: list[Stage], variants: dict[str, Callable[[list[Stage]], list[Stage]]]) -> DataFrame:
    """variant, admitted, added, lost: what each variant of a funnel admits, against the base's.

    A variant makes its stages out of the base's; all are judged in one pass over the rows.
    """
    def admits(stages: list[Stage]) -> Column:
        kept = F.lit(True)
        for s in stages:
            if s.active:
                kept = kept & ~F.coalesce(s.drops, F.lit(False))
        return kept

    named = {"base": lambda x: x} | variants
    judged = rows.select(*[admits(make(base)).alias(f"v{i}") for i, make in enumerate(named.values())])
    sums = [x for i in range(len(named)) for x in (F.count_if(f"v{i}").alias(f"a{i}"), F.count_if(F.col(f"v{i}") & ~F.col("v0")).alias(f"p{i}"), F.count_if(~F.col(f"v{i}") & F.col("v0")).alias(f"m{i}"))]
    parts = [F.struct(F.lit(n).alias("variant"), F.col(f"a{i}").alias("admitted"), F.col(f"p{i}").alias("added"), F.col(f"m{i}").alias("lost")) for i, n in enumerate(named)]
    return judged.agg(*sums).select(F.inline(F.array(*parts)))


def replaced(stages: list[Stage], name: str, drops: Column | None) -> list[Stage]:
    """stages with another test for ``name``, or without it."""
    return [Stage(name, drops) if s.name == name and drops is not None else s for s in stages if s.name != name or drops is not None]


def equivalence(rows: DataFrame, key: list[str], stages: list[Stage], production: Column) -> DataFrame:
    """One row: how many keys a production filter and the audited stages admit, and how many only one of them does.

    The two are counted apart and their keys compared, so that a slip in either shows;
    ``vacuous`` where neither admits any. Repeated keys count once.
    """
    audited = with_stages(rows, stages).where(F.size("drops") == 0).select(*key, F.lit(1).alias("__a"))
    made = rows.where(F.coalesce(production, F.lit(False))).select(*key, F.lit(1).alias("__p"))
    both = audited.select(*key, "__a", F.lit(None).cast("int").alias("__p")).unionByName(made.select(*key, F.lit(None).cast("int").alias("__a"), "__p"))
    per = both.groupBy(*key).agg(F.max("__a").alias("a"), F.max("__p").alias("p"))
    a, p = F.col("a").isNotNull(), F.col("p").isNotNull()
    return per.agg(F.count_if(p).alias("production"), F.count_if(a).alias("audited"), F.count_if(p & ~a).alias("only_production"), F.count_if(a & ~p).alias("only_audited")).withColumn(
        "vacuous", (F.col("production") == 0) & (F.col("audited") == 0)
    )
