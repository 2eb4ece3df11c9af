"""Names of public bodies taken apart: place, mandate, kind and acronym, in English and French."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from kelda.llm.canonical import JOINING, DeleteDictionary, MatchRules, deletes, piece_keys
from kelda.llm.codes import fold, repair

# Kinds of bodies with usual short forms, and the letter that stands for each in acronyms.
KINDS = {
    "O": ("office", "bureau", "off", "ofc", "bur"), "A": ("authority", "administration", "auth", "admin"), "B": ("board", "regie", "bd", "brd"),
    "K": ("council", "conseil", "cncl", "coun"), "C": ("commission", "comm", "commn"), "D": ("department", "ministere", "dept", "dep", "dpt", "min"),
    "G": ("agency", "agence", "agcy"), "S": ("service", "svc", "serv"),
}
# Words that tell neighbouring places apart.
SIDES = frozenset("upper lower north south east west new old port lake saint st bay valley sea falls ridge harbour crossing".split())
# Words of a name that name neither place, mandate nor kind.
EMPTY = JOINING | frozenset("former formerly to since until from ex anciennement ancien ancienne arvandia arvandie government govt gouvernement regional".split())


@dataclass(frozen=True)
class BodyRules:
    """The words of the names: kinds (letter of acronyms: words), sides (words that tell
    neighbouring places apart), empty (words that say nothing). prefixes: how many letters of
    the place an acronym may begin with; initials of the mandate and, perhaps, the kind's letter follow."""

    kinds: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: KINDS)
    sides: frozenset[str] = SIDES
    empty: frozenset[str] = EMPTY
    prefixes: tuple[int, ...] = (1, 2, 3)


_ACRONYM = re.compile(r"\b[A-Z]{3,7}\b")
_PARTS = re.compile(r"\s*[;|]\s*")
#: Lengths of a place from which two edits are allowed, and up to which its keys are made by dropping letters.
TWO_EDITS, DROPPED = 8, 64


def near_keys(core: str) -> set[str]:
    """Keys such that two places within the edits that ``linkage.body_comparisons`` allows share one.

    Up to 64 letters: what is left without one letter, or two where two edits are allowed.
    Longer ones, where that would be thousands of keys: of three pieces two edits leave one
    whole, at most two letters away from where it stood.
    """
    text = core.replace(" ", "")
    out: set[str] = set()
    if len(text) <= DROPPED:
        out |= deletes(text, 2 if len(core) >= TWO_EDITS else 1)
        if len(text) == 1:
            out.add("")
    # A place of 65 or 66 letters must meet one of 63 or 64, so both ways overlap.
    if len(text) > DROPPED - 2:
        out |= piece_keys(text, 2, 3)
    return out


#: What a record says, and its blocking keys.
RECORD = ("places", "mandates", "kinds", "bodies", "cores", "like", "exact", "near", "lettered", "acronyms", "bare_lettered", "bare_acronyms")


class BodyParser:
    """Takes names apart with a list of mandates in several languages."""

    def __init__(self, mandates: Iterable[tuple[str, ...]], rules: BodyRules = BodyRules()) -> None:
        """mandates: spellings of each mandate, the first of which stands for it."""
        self.rules = rules
        self.kind = {w: k for k, words in rules.kinds.items() for w in words}
        self.phrases: dict[tuple[str, ...], str] = {}
        self.initials: dict[str, str] = {}
        words: set[str] = set()
        for spellings in mandates:
            key = " ".join(self._split(spellings[0]))
            self.initials[key] = "".join(w[0] for w in self._split(spellings[0]))
            for s in spellings:
                w = tuple(self._split(s))
                self.phrases[w] = key
                words |= set(w)
        self.longest = max((len(p) for p in self.phrases), default=0)
        self.words = words | {w for w in (*rules.sides, *self.kind) if len(w) > 4}
        self.fuzzy = DeleteDictionary(MatchRules(k2=8, k1=4))
        for w in sorted(self.words):
            if len(w) >= 4:
                self.fuzzy.add(w, w)

    @staticmethod
    def _split(text: str) -> list[str]:
        return [w for w in re.findall(r"[a-z0-9]+", fold(text)) if w not in JOINING]

    def _correct(self, w: str) -> str:
        if w in self.words or w in self.kind or w in self.rules.sides or w in self.rules.empty or len(w) < 4:
            return w
        got = self.fuzzy.lookup(w)
        return got[0][1] if got and got[0][0] <= (1.0 if len(w) < 7 else 2.2) else w

    def read(self, name: str) -> tuple[str, str, str, str, list[str]]:
        """(core of the place, side words, mandates, kind, acronyms) of one name; '' where it has none."""
        name = repair(name)
        # In a name that is mostly in capitals no word is an acronym for being so.
        capitals = sum(c.isupper() for c in name) > 0.6 * sum(c.isalpha() for c in name) and len(name.split()) > 2
        stated = [] if capitals else _ACRONYM.findall(name)
        left = re.sub(r"\((?:[^()]*\d{4}[^()]*)\)", " ", name)
        for a in stated:
            left = re.sub(rf"\b{a}\b", " ", left)
        words = [self._correct(w) for w in re.findall(r"[a-z0-9]+", fold(left)) if w not in self.rules.empty]
        mandates, rest, i = [], [], 0
        while i < len(words):
            for n in range(min(self.longest, len(words) - i), 0, -1):
                key = self.phrases.get(tuple(words[i : i + n]))
                if key:
                    mandates.append(key)
                    i += n
                    break
            else:
                rest.append(words[i])
                i += 1
        kinds = [self.kind[w] for w in rest if w in self.kind]
        place = [w for w in rest if w not in self.kind and not w.isdigit()]
        core = " ".join(w for w in place if w not in self.rules.sides)
        sides = " ".join(sorted(w for w in place if w in self.rules.sides))
        return core, sides, "+".join(sorted(set(mandates))), kinds[0] if len(kinds) == 1 else "", stated

    def record(self, names: Iterable[str | None]) -> dict[str, list[str]]:
        """What all names of a record say: places, mandates, bodies, kinds, acronyms and blocking keys."""
        out: dict[str, set[str]] = defaultdict(set)
        read = [self.read(n) for text in names if text for n in _PARTS.split(text) if n.strip()]
        for core, sides, mandates, kind, stated in read:
            if core:
                out["places"].add(f"{core}|{sides}")
                out["cores"].add(core)
                out["like"] |= near_keys(core)
            if mandates:
                out["mandates"].add(mandates)
            if kind:
                out["kinds"].add(kind)
            if core and mandates:
                out["bodies"].add(f"{core}|{sides}|{mandates}")
                out["exact"].add(f"{core}|{mandates}")
                out["near"] |= {f"{d}|{mandates}" for d in near_keys(core)}
                initials = self.initials.get(mandates, "".join(self.initials[m] for m in mandates.split("+")))
                for n in self.rules.prefixes:
                    short = core[:n] + initials
                    out["lettered"] |= {f"{core}|{short}", f"{core}|{short}{kind.lower()}"}
                    out["acronyms"].add((short + kind).upper())
            for a in stated:
                out["acronyms"].add(a)
                if core:
                    out["lettered"] |= {f"{core}|{a.lower()}", f"{core}|{a[:-1].lower()}"}
        # Letters find what is known by letters alone; full names find each other by their words.
        if not out["bodies"]:
            out["bare_lettered"], out["bare_acronyms"] = out["lettered"], out["acronyms"]
        return {k: sorted(out[k]) for k in RECORD}
