"""Free-entered values mapped to a canonical list.

The list's names, in every spelling rule-made from them, go into a symmetric-delete
dictionary: each spelling under every string that is left when up to k characters are
removed. A value meets a spelling within k edits if and only if they share such a string.
The dictionary's size follows from the list and k, is checked, and is broadcast; values
are looked up where they are, so nothing is shuffled. Spellings that meet are ranked by
weighted Damerau-Levenshtein distance, then by how often the list entry is written in
full. Values that meet none are reported under the miss label.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kelda.llm.codes import fold, repair
from kelda.session import shuffle_partitions

# Keys that lie side by side on a QWERTY keyboard.
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
_NEAR = {frozenset(p) for row in _ROWS for p in zip(row, row[1:])} | {
    frozenset((a, b)) for up, low in zip(_ROWS, _ROWS[1:]) for i, b in enumerate(low) for a in up[i : i + 2]
}


@dataclass(frozen=True)
class MatchRules:
    """k2, k1: lengths from which two edits, or one, are allowed. dictionary: most entries the
    broadcast dictionary may have. gap: how much dearer the second-best entry must be, else
    the more frequent of the two is taken."""

    k2: int = 10
    k1: int = 5
    dictionary: int = 5_000_000
    gap: float = 0.2

    def edits(self, length: int) -> int:
        return 2 if length >= self.k2 else 1 if length >= self.k1 else 0


def deletes(text: str, k: int) -> set[str]:
    """text without any up to k of its characters."""
    n = len(text)
    out = {text}
    if n < 2 or k < 1:
        return out
    one = [text[:i] + text[i + 1 :] for i in range(n)]
    out.update(one)
    layer = list(enumerate(one))
    for depth in range(2, min(k, n - 1) + 1):
        # The next character goes at or after the place of the last, so that no set is made twice.
        last = depth == min(k, n - 1)
        for i, t in layer:
            head = t[:i]
            tail = t[i:]
            out.update([head + tail[:j] + tail[j + 1 :] for j in range(len(tail))])
        if not last:
            layer = [(j, t[:j] + t[j + 1 :]) for i, t in layer for j in range(i, len(t))]
    return out


def piece_keys(text: str, k: int, parts: int) -> set[str]:
    """Pieces of text such that two texts within k edits share one, whatever their length, if no k edits touch all of ``parts``.

    The text is cut as one of any length up to k away would be, and a piece may stand up to
    k letters from where it stood: some hundred keys, where left-out letters would be thousands."""
    out = set()
    for n in range(max(0, len(text) - k), len(text) + k + 1):
        ends = [i * n // parts for i in range(parts + 1)]
        for i, (a, b) in enumerate(zip(ends, ends[1:])):
            out |= {f"{n}:{i}:{text[a + s : b + s]}" for s in range(-k, k + 1) if 0 <= a + s and b + s <= len(text)}
    return out


def weighted_distance(a: str, b: str, most: float = 9.0) -> float:
    """Damerau-Levenshtein distance with cheap slips: neighbouring keys 0.7, swapped letters
    0.7, a letter doubled or undoubled 0.5; an edit of the first letter costs 0.3 more."""
    # Equal ends cost nothing; a letter of each stays, as the costs look at neighbours.
    n = min(len(a), len(b))
    p = next((i for i in range(n) if a[i] != b[i]), n)
    q = next((i for i in range(n - p) if a[-1 - i] != b[-1 - i]), n - p)
    p, q = max(0, p - 1), max(0, q - 1)
    start = 0.3 if p == 0 else 0.0
    a, b = a[p : len(a) - q], b[p : len(b) - q]
    two: list[float] = []
    one = [0.0]
    for j in range(1, len(b) + 1):
        one.append(one[-1] + (0.5 if j > 1 and b[j - 1] == b[j - 2] else 1.0) + start * (j == 1))
    for i in range(1, len(a) + 1):
        twice = 0.5 if i > 1 and a[i - 1] == a[i - 2] else 1.0
        now = [one[0] + twice + start * (i == 1)]
        for j in range(1, len(b) + 1):
            x, y = a[i - 1], b[j - 1]
            first = start if i == 1 and j == 1 else 0.0
            swap = one[j - 1] if x == y else one[j - 1] + (0.7 if frozenset((x, y)) in _NEAR else 1.0) + first
            best = min(swap, one[j] + twice, now[j - 1] + (0.5 if j > 1 and y == b[j - 2] else 1.0))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, two[j - 2] + 0.7)
            now.append(best)
        if min(now) > most:
            return most + 1
        two, one = one, now
    return one[-1]


@dataclass
class DeleteDictionary:
    """Spellings by what is left of them; each spelling has its entry and its allowance."""

    rules: MatchRules
    spellings: list[tuple[str, str, float]] = field(default_factory=list)
    table: dict[str, list[int]] = field(default_factory=lambda: defaultdict(list))
    shortest: int = 1 << 30
    longest: int = 0

    def add(self, spelling: str, entry: str, penalty: float = 0.0) -> None:
        if not spelling:
            return
        if len(self.table) > self.rules.dictionary:
            raise ValueError(f"the dictionary has more than {self.rules.dictionary} entries; it is too large to broadcast")
        self.spellings.append((spelling, entry, penalty))
        self.shortest, self.longest = min(self.shortest, len(spelling)), max(self.longest, len(spelling))
        for d in deletes(spelling, self.rules.edits(len(spelling))):
            self.table[d].append(len(self.spellings) - 1)

    def lookup(self, value: str) -> list[tuple[float, str]]:
        """(cost, entry) of the spellings within the allowed edits of value, cheapest first."""
        k = self.rules.edits(len(value))
        if not self.shortest - k <= len(value) <= self.longest + k:
            return []
        met: set[int] = set()
        table = self.table
        for d in table.keys() & deletes(value, k):
            met.update(table[d])
        best: dict[str, float] = {}
        for i in met:
            spelling, entry, penalty = self.spellings[i]
            allowed = min(k, self.rules.edits(len(spelling)))
            if spelling == value:
                cost = penalty
            elif abs(len(spelling) - len(value)) <= allowed and edits(spelling, value, allowed + (allowed > 1)) <= allowed + (allowed > 1):
                # Two deletions each also meet a swap around a lost letter, which counts as three.
                cost = penalty + weighted_distance(spelling, value)
                if cost > penalty + allowed + 1.0:
                    continue
            else:
                continue
            best[entry] = min(cost, best.get(entry, 99.0))
        return sorted((c, e) for e, c in best.items())


def edits(a: str, b: str, most: int) -> int:
    """Unweighted distance with swaps, or more than ``most``."""
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        now = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            best = min(one[j - 1] + (a[i - 1] != b[j - 1]), one[j] + 1, now[j - 1] + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, two[j - 2] + 1)
            now[j] = best
        if min(now) > most:
            return most + 1
        two, one = one, now
    return one[-1]


# Words that join names without telling them apart, in English and French.
JOINING = frozenset("of for the a an and de des du la le les d l et aux au pour on".split())
# Usual short forms in names of public bodies, after folding.
SHORT = {
    "dept": "department", "dep": "department", "dpt": "department", "depart": "department", "deptt": "department",
    "commr": "commissioner", "comm": "commissioner", "cmmr": "commissioner", "commn": "commission",
    "agcy": "agency", "agy": "agency", "off": "office", "ofc": "office", "trib": "tribunal", "cncl": "council", "insp": "inspection",
    "min": "ministere", "res": "research", "natl": "national", "gen": "general", "dir": "directorate", "bur": "bureau", "govt": "government",
}
_SPLIT = re.compile(r"\s+[|/–—-]+\s+|\s*[|/;:]\s*|\s*,\s*|\s*[()\[\]]\s*")
_APOSTROPHE = re.compile(r"\b(dep|gov|dir|comm|min|trib)['’]([a-z])")
_DOTTED = re.compile(r"^(?:\w\s*\.\s*){2,}\w?\.?$")


def name_words(text: str) -> list[str]:
    """Folded words of a name, short forms written out, digits inside words read as letters."""
    t = _APOSTROPHE.sub(r"\1\2", fold(text))
    out = []
    for w in re.findall(r"[a-z0-9]+", t):
        if any(c.isalpha() for c in w) and any(c.isdigit() for c in w):
            w = w.translate(str.maketrans("01358", "olesb"))
        out.append(SHORT.get(w, w))
    return out


def squeeze(words: Iterable[str]) -> str:
    return "".join(w for w in words if w not in JOINING)


def name_forms(value: str) -> list[list[str]]:
    """The readings of a value, best first: all of it, its parts between separators, an inverted part put right."""
    value = repair(value)
    if _DOTTED.match(value.strip()):
        value = re.sub(r"[\s.]", "", value)
    value = value.replace("_", " ")
    if " " not in value.strip() and value.count("-") >= 1:
        value = value.replace("-", " ")
    parts = [p for p in _SPLIT.split(value) if p and p.strip()]
    readings = [value, *parts]
    if len(parts) >= 2:
        readings += [f"{parts[i + 1]} {parts[i]}" for i in range(len(parts) - 1)]
    return [w for r in dict.fromkeys(readings) if (w := name_words(r))]


class NameMatcher:
    """Finds the list entry that a free-entered name means."""

    def __init__(self, entries: list[tuple[str, list[str], list[str]]], rules: MatchRules, frequency: dict[str, int] | None = None, elsewhere: Iterable[str] = ()) -> None:
        """entries: key, names, short names (matched whole and letter by letter). elsewhere: words
        of bodies that are none of the list's, whatever else a value says; those of the list's own names don't count."""
        self.names, self.sorted, self.short = DeleteDictionary(rules), DeleteDictionary(rules), {}
        self.rules, self.frequency = rules, frequency or {}
        shared = defaultdict(set)
        for key, names, short in entries:
            for n in names:
                words = name_words(n)
                self.names.add(squeeze(words), key)
                self.sorted.add("".join(sorted(w for w in words if w not in JOINING)), key)
            for s in short:
                shared[squeeze(name_words(s)) or fold(s)].add(key)
        self.short = dict(shared)
        own = {w for _, names, _ in entries for n in names for w in name_words(n)}
        self.elsewhere = DeleteDictionary(MatchRules(k2=99, k1=6))
        for w in elsewhere:
            if w not in own:
                self.elsewhere.add(w, w)
        self.own = own
        self._words: dict[str, bool] = {}
        self.exact = defaultdict(set)
        for spelling, key, _ in self.names.spellings:
            self.exact[spelling].add(key)

    def match(self, value: str, hint: str | None = None) -> tuple[str, float] | None:
        """(entry, cost), or None. ``hint``, an unreliable key, decides between entries that are equally near."""
        return self.choose(self.near(value), hint)

    def choose(self, near: list[tuple[str, float]], hint: str | None) -> tuple[str, float] | None:
        return min(near, key=lambda x: (x[0] != hint, x[1], -self.frequency.get(x[0], 0), x[0]), default=None)

    def _is_elsewhere(self, word: str) -> bool:
        """Whether a word says that a body is none of the list's; words recur, so answers are kept."""
        if word in self.own or not self.elsewhere.spellings:
            return False
        if word not in self._words:
            if len(self._words) > 100_000:
                self._words.clear()
            self._words[word] = bool(self.elsewhere.lookup(word))
        return self._words[word]

    def near(self, value: str) -> list[tuple[str, float]]:
        """(entry, cost) of the entries that the value may mean, those that are about as near as the nearest."""
        if any(map(self._is_elsewhere, name_words(repair(value).replace("_", " ")))):
            return []
        found: list[tuple[float, str]] = []
        forms = list(dict.fromkeys(squeeze(words) for words in name_forms(value)))
        for form in forms:
            if form in self.exact:
                found = [(0.0, k) for k in self.exact[form]]
                break
        for form in forms if not found else ():
            found += self.names.lookup(form)
        if not found:
            # Parts in another order: the words alone, sorted, against the sorted words of the names.
            words = sorted(w for w in name_words(_SPLIT.sub(" ", repair(value))) if w not in JOINING)
            found = self.sorted.lookup("".join(words))
        if not found:
            for words in name_forms(value):
                keys = self.short.get("".join(words))
                if keys:
                    found += [(0.0 if len(keys) == 1 else 0.5, k) for k in keys]
                    break
        best = min((c for c, _ in found), default=0.0)
        return sorted({(e, c) for c, e in found if c <= best + self.rules.gap})


def map_to_list(rows: DataFrame, value: str, hint: str | None, matcher: NameMatcher, out: str = "list_key", miss: str = "unmatched") -> DataFrame:
    """rows with ``out``: the key of the entry that ``value`` names, or ``miss``.

    Each different value is looked up once and joined back; a value that a third of all rows have is one row of that side, and the
    other side of such a key is split by adaptive execution.

    Defined cases: NULL and blank values give NULL, as they name nothing; equal values with
    equal hints get equal keys; very long values are looked up whole; other columns are
    kept; one that is named as ``out`` is replaced; empty rows stay empty.
    """
    shared = rows.sparkSession.sparkContext.broadcast(matcher)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for values in batches:
            yield pd.Series([[{"cost": c, "rare": -m.frequency.get(e, 0), "key": e} for e, c in m.near(v)] if v.strip() else None for v in values], dtype=object)

    near = F.pandas_udf(run, "array<struct<cost:double,rare:long,key:string>>")
    v = F.col(f"`{value}`")
    # Looking up takes far longer than its rows are large, so these keep all partitions.
    different = rows.select(v.alias("__value")).where(v.isNotNull()).distinct().repartition(shuffle_partitions(rows.sparkSession))
    known = different.select("__value", near("__value").alias("__near"))
    h = F.col(f"`{hint}`").cast("string") if hint else F.lit(None).cast("string")
    # As NameMatcher.choose has it; without a hint none is nearer for it.
    order = F.transform("__near", lambda x: F.struct((~x["key"].eqNullSafe(h)).alias("other"), x["cost"], x["rare"], x["key"]))
    best = F.array_min(order)["key"]
    joined = rows.join(known, v == F.col("__value"), "left")
    return joined.withColumn(out, F.when(F.col("__near").isNotNull(), F.coalesce(best, F.lit(miss)))).drop("__value", "__near")
