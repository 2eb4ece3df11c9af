"""Spellings of one person or organisation, linked.

Every name is rewritten into canonical readings: nicknames and initials stand for given
names, legal forms and trimmings fall away, abbreviated and translated trades become the
trade, tokens are put in order. A reading is a lead (the distinctive words) and what tells
entities of one lead apart (the trade of a firm, the given name of a person). Leads also
come with every form that lacks a letter or two, so that slips meet in an equi-join.

Rewritings are exploded and joined with those of the entities; one links by its rarity, one
over the number of entities that share it. A name without a trade is a firm's only if one
firm has its lead; an initial is a person's only if one person of that surname has it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from kelda.llm.canonical import DeleteDictionary, MatchRules, deletes, edits, piece_keys
from kelda.llm.codes import fold, repair
from kelda.session import cut_lineage

# Legal forms, after folding, without dots.
LEGAL = frozenset("inc incorporated incorporee ltd limited ltee limitee corp corporation co company cie compagnie llp lp llc plc sa sarl gmbh ag reg enr senc".split())
# Trades of firms; usual abbreviations and French names.
TRADES = {
    "aerospace": ("aerospace", "aero", "aerospatiale"), "associates": ("associates", "assoc", "associes", "assocs"),
    "communications": ("communications", "comm", "comms", "communication"), "construction": ("construction", "constr", "const"),
    "consulting": ("consulting", "consltg", "conseil", "conseils", "consult"), "engineering": ("engineering", "engg", "eng", "engr", "ingenierie", "genie"),
    "environmental services": ("environmental services", "env svcs", "env serv", "services environnementaux", "environmental svcs", "env services"),
    "industries": ("industries", "ind", "inds"), "laboratories": ("laboratories", "labs", "lab", "laboratoires"),
    "logistics": ("logistics", "log", "logistique"), "management group": ("management group", "mgmt grp", "mgmt group", "management grp", "groupe gestion", "groupe de gestion"),
    "marine": ("marine", "mar", "maritime"), "medical supply": ("medical supply", "med supply", "medical sup", "fournitures medicales"),
    "power": ("power", "pwr", "energie"), "security services": ("security services", "sec serv", "sec svcs", "security svcs", "services securite", "services de securite"),
    "systems": ("systems", "sys", "systemes"), "technologies": ("technologies", "tech", "techs", "technology"),
    "translation bureau": ("translation bureau", "transl bur", "bureau traduction", "bureau de traduction", "translation bur"),
}
# Given names with their usual short and variant forms.
GIVEN = {
    "abigail": "abby abbie gail", "albert": "al bert bertie", "alexander": "alex sandy xander alec alexandre", "alfred": "alf alfie", "alice": "ali", "amanda": "mandy", "andrew": "andy drew andre", "ann": "anne anna annie",
    "anthony": "tony antoine antony", "arthur": "art artie", "barbara": "barb babs barbie", "benjamin": "ben benny benji", "bernard": "bernie", "bradley": "brad", "caroline": "carrie carolyn",
    "catherine": "cathy kate kit catharine katherine katharine katie cate", "charles": "charlie chuck chas", "christine": "chrissy tina kristine", "christopher": "chris kit topher kester", "clifford": "cliff", "cynthia": "cindy",
    "daniel": "dan danny", "david": "dave davey", "deborah": "deb debbie debra", "dennis": "denny denis", "diane": "di diana", "donald": "don donnie", "dorothy": "dot dolly dottie dora", "douglas": "doug",
    "edward": "ed eddie ned ted teddy", "eleanor": "nell nellie ellie", "elizabeth": "liz beth elisabeth lizzie betty eliza", "emily": "em emmy emilie", "eugene": "gene", "florence": "flo flossie", "frances": "fran francie",
    "francis": "frank francois", "frederick": "fred freddie freddy frederic", "gabriel": "gabe", "gabrielle": "gaby gabby gabi", "geoffrey": "geoff jeff jeffrey", "george": "georgie georges", "gerald": "gerry jerry", "gregory": "greg gregg",
    "harold": "hal harry", "helen": "nell helene", "henry": "hank harry henri", "isabella": "bella izzy isabelle isabel", "jacob": "jake jacques", "james": "jim jimmy jamie", "jane": "janie jeanne", "janet": "jan", "jennifer": "jen jenny",
    "jessica": "jess jessie", "john": "jack johnny jean", "jonathan": "jon jonny johnathan johnny", "joseph": "joe joey josef", "joshua": "josh", "judith": "judy jude", "julia": "julie jules", "kenneth": "ken kenny", "kimberly": "kim", "lawrence": "larry laurie laurent laurence",
    "leonard": "len lenny leo", "louis": "lou louie lewis", "lucy": "lucie lou", "margaret": "maggie peggy meg marge margie marguerite", "martin": "marty", "mary": "molly polly marie mae", "matthew": "matt matty mathieu", "maurice": "moe morris", "megan": "meg",
    "michael": "mike mick mickey mikey michel", "mitchell": "mitch", "nancy": "nan", "natalie": "nat nathalie", "nathaniel": "nate nat nathan", "nicholas": "nick nicky nicolas nico", "oliver": "ollie olivier", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "pat paddy",
    "peter": "pete pierre", "philip": "phil philippe phillip", "philippa": "pippa pip phillipa", "rachel": "rach", "raymond": "ray", "rebecca": "becky becca rebekah", "richard": "rick dick rich ricky", "robert": "bob rob bobby robbie", "roger": "rodge", "ronald": "ron ronnie",
    "russell": "russ", "samantha": "sam sammie", "samuel": "sam sammy", "sandra": "sandy", "sarah": "sally sadie sara", "sebastian": "seb", "sophia": "sophie", "stanley": "stan", "stephanie": "steph", "stephen": "steve steven stevie stephane", "susan": "sue susie suzanne", "sylvia": "syl sylvie",
    "teresa": "terry tess theresa therese", "terrence": "terry terence", "theodore": "ted teddy theo", "thomas": "tom tommy", "timothy": "tim timmy", "valerie": "val", "vanessa": "nessa", "victor": "vic", "victoria": "vicky tori vickie vicki", "vincent": "vince vinny", "virginia": "ginny",
    "walter": "walt wally", "wendy": "wen", "william": "will bill billy willie liam guillaume", "zachary": "zach zack zac",
}
# Titles and trimmings round a person's name.
TITLES = frozenset("dr prof mr mrs ms miss attn me mme mlle sir".split())
_TRIM = re.compile(r"\bp\.?\s*eng\b\.?|\bph\.?d\b\.?|\bsole proprietor\b|\besq\b\.?")
_ALIAS = re.compile(r"\s+(?:o/a|d/b/a|dba|c/o|a/s)\s+.*$")
_OFFICE = re.compile(r"\s+[-–—]\s+.*$")
_BRACKETS = re.compile(r"\([^()]*\)")
_DOTTED = re.compile(r"\b(?:[a-z]\.){2,}")
_LONE = re.compile(r"(?<![\w'])([a-z])\.(?![a-z]\.)|(?<![\w'])([a-z])(?![\w'.])")
_LINKING = frozenset("the and et de des du la le les of arvandia".split())



def _spellings(words: set[str], least: int) -> DeleteDictionary:
    d = DeleteDictionary(MatchRules(k2=99, k1=least))
    for w in sorted(words):
        if len(w) >= least:
            d.add(w, w)
    return d


class Rewriter:
    """The rules by which names are rewritten: legal forms, trades and given names with their other forms.

    The tables are parameters; the defaults are common English and French ones."""

    def __init__(self, legal: Iterable[str] = LEGAL, trades: Mapping[str, Iterable[str]] = TRADES, given: Mapping[str, str] = GIVEN) -> None:
        self.legal, self.given = frozenset(legal), tuple(given)
        self.trade_of = {tuple(p.split()): t for t, phrases in trades.items() for p in phrases}
        self.longest = max(map(len, self.trade_of), default=0)
        self.trade_initials: dict[str, set[str]] = {}
        for t in trades:
            self.trade_initials.setdefault("".join(w[0] for w in t.split()), set()).add(t)
        self.given_of: dict[str, set[str]] = {g: {g} for g in given}
        for g, short in given.items():
            for s in short.split():
                self.given_of.setdefault(s, set()).add(g)
        self.trade_words = {w for p in self.trade_of for w in p}
        self._near_trade = _spellings(self.trade_words, 6)
        self._near_given = _spellings(set(self.given_of), 5)
        self._words: dict[str, str] = {}
        self._names: dict[str, frozenset[str]] = {}

    def trade_word(self, w: str) -> str:
        """w, or the word of a trade that it is a slip of."""
        if w in self.trade_words or len(w) < 6:
            return w
        if w not in self._words:
            if len(self._words) > 100_000:
                self._words.clear()
            got = self._near_trade.lookup(w)
            self._words[w] = got[0][1] if got else w
        return self._words[w]

    def givens(self, w: str) -> frozenset[str]:
        """The given names that w may stand for, a slip allowed."""
        if w in self.given_of:
            return frozenset(self.given_of[w])
        # A trade's word is no slip of a name.
        if len(w) < 5 or w in self.trade_words:
            return frozenset()
        if w not in self._names:
            if len(self._names) > 100_000:
                self._names.clear()
            got = self._near_given.lookup(w)
            self._names[w] = frozenset(self.given_of[got[0][1]]) if got else frozenset()
        return self._names[w]


DEFAULT = Rewriter()


def _tokens(part: str, legal: frozenset[str]) -> tuple[list[str], list[str]]:
    """Words and stated initials ('c', 'es') of a folded part, in order; initials come as '~c' among the words too."""
    part = part.replace("eng'g", "engg").replace("’", "'")
    part = _DOTTED.sub(lambda m: " " + (m[0].replace(".", "") if m[0].replace(".", "") in legal else "~" + m[0].replace(".", "")) + " ", part)
    part = _LONE.sub(lambda m: f" ~{m[1] or m[2]} ", part)
    words = re.findall(r"~?[a-z0-9]+", part)
    return [w for w in words if w not in _LINKING], [w[1:] for w in words if w[0] == "~"]


Reading = tuple[str, str, list[str], bool]


def readings(name: str, rules: Rewriter = DEFAULT) -> list[Reading]:
    """(kind, lead, entities, certain): what a name may stand for.

    entities: the trades or given names it may mean ([] if it says none); certain if it
    spells the one it means. The lead's words are sorted.
    """
    text = fold(repair(name)).replace("&", " and ")
    text = _BRACKETS.sub(" ", _OFFICE.sub("", _ALIAS.sub("", text)))
    text = _TRIM.sub(" ", text)
    out: list[Reading] = []
    for part in re.split(r"\s+/\s+", text):
        words, initials = _tokens(part, rules.legal)
        words = [w for w in words if w not in TITLES] if len(words) > 2 else words
        person = _person(words, rules)
        if person:
            out.append(person)
            continue
        legal = any(w in rules.legal for w in words)
        plain = [w for w in words if w[0] != "~" and w not in rules.legal]
        trades, lead, i = [], [], 0
        spelled = [rules.trade_word(w) for w in plain]
        while i < len(plain):
            for n in range(min(rules.longest, len(plain) - i), 0, -1):
                t = rules.trade_of.get(tuple(spelled[i : i + n]))
                if t:
                    trades.append(t)
                    i += n
                    break
            else:
                lead.append(plain[i])
                i += 1
        if not lead:
            continue
        key = " ".join(sorted(lead))
        if trades:
            out.append(("firm", key, sorted(set(trades))[:1] if len(set(trades)) == 1 else sorted(set(trades)), len(set(trades)) == 1))
        elif initials:
            meant = sorted({t for x in initials for t in rules.trade_initials.get(x, ())})
            out.append(("firm", key, meant or [f"~{initials[0]}"], len(meant) == 1))
            if not legal and len(initials) == 1 and len(initials[0]) == 1:
                out.append(("person", key, sorted(g for g in rules.given if g[0] == initials[0]), False))
        else:
            out.append(("firm", key, [], False))
    return out


def _person(words: list[str], rules: Rewriter) -> Reading | None:
    """The person a name's words stand for, if a given name is among them."""
    plain = [w for w in words if w[0] != "~" and w not in rules.legal]
    if len(plain) < 2:
        return None
    for at in (0, len(plain) - 1):
        exact = plain[at] in rules.given_of
        meant = rules.givens(plain[at])
        if not meant:
            continue
        rest = plain[:at] + plain[at + 1 :]
        # Trimmings of a one-person firm.
        surname = [w for w in rest if rules.trade_of.get((rules.trade_word(w),)) not in ("consulting", "associates")]
        if not surname or (not exact and (len(surname) > 2 or any(w in rules.legal for w in words) or any((rules.trade_word(w),) in rules.trade_of for w in rest))):
            continue
        return ("person", " ".join(sorted(surname)), sorted(meant), len(meant) == 1)
    return None


#: The form of a name that leaves open which entity of its lead it means.
OPEN = "*"
#: Letters from which a lead may have two slips; shorter ones have one, and very short ones none.
TWO_SLIPS, ONE_SLIP = 9, 6
#: Letters up to which slips meet in left-out letters; longer leads, where these would be thousands, meet in pieces.
DROPPED = 64


def _forms(kind: str, lead: str) -> list[int]:
    """Hashes such that two leads within the slips that ``_slips`` allows share one, in either order of their words.

    What is left of a lead without up to two letters, or, of a long one, a piece of it: a
    swap at a joint spoils two pieces, so of five two slips leave one."""
    words = lead.split(" ")
    whole = {"".join(words), "".join(reversed(words))}
    n = len("".join(words))
    forms: set[str] = set()
    if n <= DROPPED:
        k = 2 if n >= TWO_SLIPS else 1 if n >= ONE_SLIP else 0
        forms |= {d for w in whole for d in deletes(w, k)}
    # A lead of 65 or 66 letters must meet one of 63 or 64, so both ways overlap.
    if n > DROPPED - 2:
        forms |= {d for w in whole for d in piece_keys(w, 2, 5)}
    return [xxhash.xxh3_64_intdigest(f"{kind}|{d}") - (1 << 63) for d in forms]


def _slips(a: str, b: str) -> bool:
    """Whether two leads, written together in either order of their words, are as few slips apart as their letters allow."""
    x, y = a.split(" "), b.split(" ")
    p, q = "".join(x), "".join(y)
    most = 2 if len(p) >= TWO_SLIPS else 1 if len(p) >= ONE_SLIP else 0
    return edits(p, q, most) <= most or edits(p, "".join(reversed(y)), most) <= most


@dataclass(frozen=True)
class VariantRules:
    """rarity: a rewriting links where it is rarer than this, that is one over the number of
    entities that share it; above one half it is one entity's alone."""

    rarity: float = 0.5


def near_leads(leads: DataFrame) -> DataFrame:
    """kind, lead, to: pairs of leads that share a form, either way.

    Forms are shuffled once, as a pair of longs. Those of a single lead, nearly all, end in
    a hash aggregation; only the others are joined. A form is one lead's but for slips and
    chance, as no more leads can share it than there are ways to put two letters back."""

    def forms_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for kinds, names in batches:
            yield pd.Series([_forms(k, n) for k, n in zip(kinds, names)], dtype=object)

    known = leads.select("kind", "lead", F.xxhash64("kind", "lead").alias("id"))
    forms = known.select("id", F.explode(F.pandas_udf(forms_of, "array<long>")("kind", "lead")).alias("form")).repartition("form")
    held = forms.groupBy("form").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("form")
    several = cut_lineage(forms.join(held.hint("shuffle_hash"), "form"))
    x, y = several.select("form", F.col("id").alias("a")), several.select("form", F.col("id").alias("b"))
    pairs = cut_lineage(x.hint("merge").join(y, "form").where("a < b").select("a", "b").distinct())
    first, second = known.select(F.col("id").alias("a"), "kind", "lead"), known.select(F.col("id").alias("b"), F.col("lead").alias("to"))
    near = pairs.join(first, "a").join(second, "b").select("kind", "lead", "to")
    return near.unionByName(near.select("kind", F.col("to").alias("lead"), F.col("lead").alias("to")))


def roots_of(said: DataFrame) -> DataFrame:
    """kind, lead, root: each lead that is a slip or a translation of a better-supported one, and the last of these."""
    leads = said.groupBy("kind", "lead").agg(F.count("*").alias("support"), F.array_distinct(F.flatten(F.collect_set(F.when(F.col("certain"), F.col("entities"))))).alias("known"))
    leads = cut_lineage(leads)
    about = leads.select("kind", F.col("lead").alias("to"), F.col("support").alias("to_support"), F.col("known").alias("to_known"))

    def check(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([_slips(x, y) for x, y in zip(a, b)], dtype=bool)

    slip = F.pandas_udf(check, "boolean")("lead", "to")
    greater = (F.col("to_support") > F.col("support")) | ((F.col("to_support") == F.col("support")) & (F.col("to") > F.col("lead")))
    fits = (F.size("known") <= 0) | (F.size("to_known") <= 0) | F.arrays_overlap("known", "to_known")
    met = near_leads(leads).join(leads, ["kind", "lead"]).join(about, ["kind", "to"]).where(greater & fits).where(slip)
    # A name that gives its lead twice, in two languages, spells both leads.
    twice = said.groupBy("name", "kind").agg(F.array_sort(F.collect_set("lead")).alias("both")).where(F.size("both") > 1)
    twin = twice.select("kind", F.explode("both").alias("lead"), "both").select("kind", "lead", F.explode("both").alias("to")).where(F.col("lead") != F.col("to"))
    twin = twin.join(leads, ["kind", "lead"]).join(about, ["kind", "to"]).where(greater)
    edges = met.select("kind", "lead", "to", "to_support").unionByName(twin.select("kind", "lead", "to", "to_support"))
    # Each lead points at its best-supported neighbour above it; pointers only go up, so they end.
    up = edges.groupBy("kind", "lead").agg(F.max(F.struct("to_support", "to")).alias("b")).select("kind", "lead", F.col("b.to").alias("root"))
    up = cut_lineage(up)
    while True:
        on = up.select("kind", F.col("lead").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(up.join(on, ["kind", "root"], "left"))
        if moved.where("next IS NOT NULL").isEmpty():
            return up
        up = moved.select("kind", "lead", F.coalesce("next", "root").alias("root"))


def link_variants(names: DataFrame, name: str, rewriter: Rewriter = DEFAULT, rules: VariantRules = VariantRules()) -> DataFrame:
    """name, entity, rule, rarity: every distinct name that one entity's rewritings lead to.

    A reading spells a lead and an entity of it (a trade, a given name), or may mean several,
    or leaves it open. Entities are those that some name spells. Every rewriting of a name,
    one for each entity it may mean, or the open form, meets the entities' forms in an
    equi-join; its rarity is one over the number of entities so met, and decides. rule tells
    whether the name spells its entity or only fits it.

    Defined cases: NULL and blank names, and those of legal forms and trades only, are left
    out; equal names count once; names whose rewritings are not rare enough are left out,
    being none's; very long names are read whole.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(n, k, lead, ents, sure) for n in pdf["name"] for k, lead, ents, sure in readings(n, rewriter)]
            yield pd.DataFrame(rows, columns=["name", "kind", "lead", "entities", "certain"])

    distinct = names.select(F.col(f"`{name}`").alias("name")).where(F.trim("name") != "").distinct()
    said = cut_lineage(distinct.mapInPandas(read, "name string, kind string, lead string, entities array<string>, certain boolean"))
    rooted = said.join(roots_of(said), ["kind", "lead"], "left").select("name", "kind", F.coalesce("root", "lead").alias("root"), "entities", "certain")
    rooted = cut_lineage(rooted)

    entities = rooted.where("certain").select("kind", "root", F.col("entities")[0].alias("one")).distinct()
    # An entity's own form, and the open form, which it shares with all of its lead.
    owned = entities.select("kind", "root", "one", F.explode(F.array("one", F.lit(OPEN))).alias("form"))
    owned = owned.groupBy("kind", "root", "form").agg(F.count("*").alias("n"), F.min("one").alias("one"))
    fits = rooted.where("NOT certain")
    # A lead of which nobody spells the entity has one entity; so has what none of its known ones fits.
    written = fits.select("name", "kind", "root", "entities", F.explode(F.concat(F.when(F.size("entities") > 0, F.col("entities")).otherwise(F.array().cast("array<string>")), F.array(F.lit(OPEN)))).alias("form"))
    met = written.join(owned, ["kind", "root", "form"], "left").groupBy("name", "kind", "root", "entities").agg(
        F.coalesce(F.sum(F.when((F.col("form") != OPEN) | (F.size("entities") <= 0), F.col("n"))), F.lit(0)).alias("n"),
        F.min(F.when((F.col("form") != OPEN) | (F.size("entities") <= 0), F.col("one"))).alias("one"),
        F.coalesce(F.max(F.when(F.col("form") == OPEN, F.col("n"))), F.lit(0)).alias("known"),
    )
    alone = F.when(F.col("known") == 0, F.lit("")).when(F.col("n") == 0, F.concat(F.lit("?"), F.array_join("entities", "+")))
    odd = (F.col("n") == 0) & (F.col("known") > 0)
    rank = F.when(F.col("known") == 0, 3).when(F.size("entities") > 0, 1).otherwise(2)
    guessed = met.select("name", "kind", "root", F.when(F.col("n") > 0, F.col("one")).otherwise(alone).alias("one"), rank.alias("rank"), odd.cast("int").alias("odd"), (1 / F.greatest("n", F.lit(1))).alias("rarity"))
    spelled = rooted.where("certain").select("name", "kind", "root", F.col("entities")[0].alias("one"), F.lit(0).alias("rank"), F.lit(0).alias("odd"), F.lit(1.0).alias("rarity"))
    fit = spelled.unionByName(guessed.where(F.col("rarity") > rules.rarity))
    best = fit.groupBy("name").agg(F.min(F.struct("rank", "odd", "kind", "root", "one", "rarity")).alias("b"))
    return best.select("name", F.concat_ws("|", "b.kind", "b.root", "b.one").alias("entity"), F.when(F.col("b.rank") == 0, "spelled").otherwise("fits").alias("rule"), "b.rarity")


def variant_pairs(linked: DataFrame) -> DataFrame:
    """name_a, name_b: pairs of different names of one entity, the smaller in byte order first."""
    other = linked.select(F.col("name").alias("name_b"), "entity")
    return linked.select(F.col("name").alias("name_a"), "entity").join(other, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b").distinct()
