"""Passages of held-out items inside a corpus.

Words are the symbols. The CGK random walk embeds a word sequence so that edit distance
becomes Hamming distance: at step j the walk writes the word it stands on and moves on if
that word's j-th random bit says so. A repetition samples a few steps of the walk as a
key; windows of items and of documents that share a key of some repetition become
candidates, and a banded alignment of the whole item against the place decides exactly.

What counts as evidence are an item's own phrases, three words in a row that few different
items hold. Items are counted as different by how little they share: of d items that hold a
phrase, with unit vectors v of their weighted phrases, d^2 / |sum v|^2 are different, so
that copies and variants of one item count as one, however many there are. Counts are taken
over all items before any is searched. A line without own phrases is an instruction.
A place where no own phrase of an item is met cannot hold that item, so only places near
one are embedded, which loses nothing and makes keys of common words harmless.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kelda.llm.codes import code_points, codes_of, mix, pieces, plain, word_hashes
from kelda.session import cut_lineage

#: Words of a phrase.
PHRASE = 3
#: Bits of a phrase's hash that serve as its random signs.
SIGNS = 32
#: Words by which a passage may drift from its item.
BAND = 8


@dataclass(frozen=True)
class LeakRules:
    """What counts as a leak, and how it is searched.

    min_words: item words in a row that a document must hold. damage: share of those words
    that may be changed, missing or added. shared_by: a phrase of more different items than
    this is none's own. own: share of a stretch's own phrases that must be equal, else it is
    another passage of the same manner. steps: sampled steps per key. recall: share wanted of
    windows with ``typical`` damage that meet their item's window in some repetition; the
    number of repetitions is what reaches it on simulated windows. items_per_pass: items
    searched in one pass over the corpus; more items take more passes. piece/overlap:
    characters of a document in memory at once, and shared by neighbouring pieces.
    """

    min_words: int = 20
    damage: float = 0.25
    shared_by: int = 3
    own: float = 0.4
    steps: int = 3
    recall: float = 0.99
    typical: float = 0.125
    items_per_pass: int = 10_000
    piece: int = 1_000_000
    overlap: int = 6_000
    seed: int = 11

    @property
    def repetitions(self) -> int:
        return _repetitions(self.min_words, self.steps, self.recall, self.typical, self.seed)


class Walks:
    """Random bits and sampled steps of the repetitions."""

    def __init__(self, min_words: int, steps: int, repetitions: int, seed: int) -> None:
        rng = random.Random(seed)
        self.window = min_words
        # Past 1.6 steps a word the walk has mostly left the window.
        self.samples = [sorted(rng.sample(range(int(1.6 * min_words)), steps)) for _ in range(repetitions)]
        self.salts = [np.uint64(rng.getrandbits(64)) for _ in self.samples]

    def embed(self, bits: np.ndarray, symbols: np.ndarray, words: np.ndarray, at: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Key of repetition r for the windows that start at ``at``, and which of them have no unknown word in it.

        ``words`` are positions in ``bits`` and ``symbols``, whose last entry stands for the unknown."""
        w, v = self.window, len(bits) - 1
        sample = set(self.samples[r])
        shift = np.zeros(len(at), np.int64)
        key = np.full(len(at), np.uint64(r + 1), np.uint64)
        known = np.ones(len(at), bool)
        for j in range(max(sample, default=-1) + 1):
            here = np.where(shift < w, words[at + np.minimum(shift, w)], v)
            if j in sample:
                key = mix(key ^ symbols[here])
                known &= here < v
            shift += ((bits[here] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
        return key, known


@lru_cache(maxsize=16)
def _repetitions(min_words: int, steps: int, recall: float, typical: float, seed: int, trials: int = 1000, most: int = 128) -> int:
    """Repetitions in which the wanted share of damaged windows met the whole one, simulated on words that occur once."""
    rng = random.Random(seed + 1)
    walks = Walks(min_words, steps, most, seed)
    n = min_words + 8
    texts, at = [], []
    for _ in range(trials):
        whole = [rng.randrange(1 << 40) for _ in range(n)]
        hurt: list[int] = []
        for x in whole:
            hurt += rng.choice([[], [x, rng.randrange(1 << 40)], [rng.randrange(1 << 40)]]) if rng.random() < typical else [x]
        for t in (whole, hurt):
            at.append(sum(map(len, texts)))
            texts.append(t + [0] * min_words)
    flat = np.array([x for t in texts for x in t], np.uint64)
    vocabulary, words = np.unique(flat, return_inverse=True)
    marks = np.append(vocabulary, np.uint64(0))
    met = np.zeros(trials, bool)
    with np.errstate(over="ignore"):
        symbols = mix(marks + np.uint64(1))
        for r in range(most):
            key, _ = walks.embed(mix(marks ^ walks.salts[r]), symbols, words.astype(np.int64), np.array(at), r)
            met |= key[::2] == key[1::2]
            if met.mean() >= recall:
                return r + 1
    return most


def words_of(text: str) -> np.ndarray:
    points, _ = code_points([plain(text)])
    return word_hashes(codes_of(points))[0]


def phrases(words: np.ndarray) -> np.ndarray:
    """Hash of every PHRASE words in a row."""
    n = len(words) - PHRASE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(PHRASE):
            h = mix(h + words[i : i + n])
    return h


def line_phrases(words: np.ndarray) -> np.ndarray:
    """The phrases of a line; a shorter line is a phrase of its own."""
    return phrases(words if len(words) >= PHRASE or not len(words) else np.append(words, np.zeros(PHRASE - len(words), np.uint64)))


def shared_phrases(items: DataFrame, rules: LeakRules) -> tuple[DataFrame, DataFrame]:
    """Of items (k long, t string): (k, h), each phrase of each, and (h), the phrases of more than ``shared_by`` different ones."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.concatenate([line_phrases(words_of(x)) for x in t.split("\n")])).view(np.int64) for t in batch.column(1).to_pylist()]
            many = [len(f) for f in found]
            ids = np.repeat(batch.column(0).to_numpy(), many)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(found), pa.int64())], names=["k", "h"])

    said = cut_lineage(items.select("k", "t").mapInArrow(read, "k long, h long"))
    common = cut_lineage(said.groupBy("h").agg(F.count("*").alias("d")).where(F.col("d") > rules.shared_by))
    n = items.count()
    sign = lambda j: 1 - 2 * F.shiftrightunsigned("h", j).bitwiseAND(F.lit(1))
    weight = F.log(F.lit(1.0 + n) / F.coalesce("d", F.lit(1)))
    sums = said.join(common, "h", "left").withColumn("w", weight).groupBy("k").agg(*[F.sum(F.col("w") * sign(j)).alias(f"v{j}") for j in range(SIGNS)])
    length = F.sqrt(sum((F.col(f"v{j}") * F.col(f"v{j}") for j in range(SIGNS)), F.lit(0.0)))
    unit = sums.select("k", *[F.coalesce(F.try_divide(F.col(f"v{j}"), length), F.lit(0.0)).alias(f"v{j}") for j in range(SIGNS)])
    held = said.join(common, "h").join(unit, "k").groupBy("h", "d").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(SIGNS)])
    square = sum((F.col(f"v{j}") * F.col(f"v{j}") for j in range(SIGNS)), F.lit(0.0))
    different = F.col("d") * F.col("d") / F.greatest(square, F.lit(1e-9))
    return said, held.where(different > rules.shared_by).select("h")


class ItemIndex:
    """The items' words, own phrases and keys; what a task needs to search its documents."""

    def __init__(self, items: list[tuple[int, str]], rules: LeakRules, shared: np.ndarray) -> None:
        """shared: hashes of the phrases that are none's own, as far as these items have them."""
        self.rules, w = rules, rules.min_words
        self.ids = [item for item, _ in items]
        texts, owned = [], []
        for _, text in items:
            words, own = self._cut([words_of(x) for x in text.split("\n")], shared)
            texts.append(words)
            owned.append(own)
        self.vocabulary = np.unique(np.concatenate([*texts, np.zeros(0, np.uint64)]))
        v = len(self.vocabulary)
        self.items = [np.searchsorted(self.vocabulary, t).astype(np.int32) for t in texts]
        self.own = owned
        # Equal own phrases without which no stretch of the item can be enough.
        self.least = np.array([self._least(o) for o in owned], np.int64)
        # Own phrases and who holds them.
        pairs = [(h, k) for k, (t, o) in enumerate(zip(texts, owned)) for h in np.unique(phrases(t)[o[PHRASE - 1 :]]).tolist()]
        pairs.sort()
        held = np.array([h for h, _ in pairs], np.uint64)
        self.phrases, self.first, self.many = np.unique(held, return_index=True, return_counts=True)
        self.holder = np.array([k for _, k in pairs], np.int32)
        self.walks = Walks(w, rules.steps, rules.repetitions, rules.seed)
        marks = np.concatenate([self.vocabulary, np.zeros(1, np.uint64)])
        with np.errstate(over="ignore"):
            self.bits = [mix(marks ^ s) for s in self.walks.salts]
            self.symbols = mix(marks + np.uint64(1))
            self.named = mix(np.arange(len(items), dtype=np.uint64) + np.uint64(7))
        owner = [(k, q) for k, t in enumerate(self.items) for q in range(len(t) - w + 1)]
        self.owner = np.array(owner, dtype=np.int32).reshape(-1, 2)
        flat = np.concatenate([*self.items, np.full(w + 1, v, np.int32)]).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum([len(t) for t in self.items])])[:-1] if self.items else np.zeros(0, np.int64)
        at = begin[self.owner[:, 0]] + self.owner[:, 1] if len(self.owner) else np.zeros(0, np.int64)
        self.keys = []
        for r in range(len(self.walks.samples)):
            key, _ = self.walks.embed(self.bits[r], self.symbols, flat, at, r)
            key = mix(key ^ self.named[self.owner[:, 0]])
            order = np.argsort(key, kind="stable").astype(np.int32)
            self.keys.append((key[order], order))

    def _cut(self, lines: list[np.ndarray], shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of an item without its instructions, and at which of them an own phrase ends.

        An instruction is a line, or ``min_words`` in a row, that no own phrase touches."""
        words, own = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for line in lines:
            mine = ~np.isin(line_phrases(line), shared)
            if not mine.any():
                continue
            if len(line) < PHRASE:
                words.append(line)
                own.append(np.zeros(len(line), bool))
                continue
            ends = np.concatenate([np.zeros(PHRASE - 1, bool), mine])
            touched = np.convolve(mine, np.ones(PHRASE, bool)) > 0
            edges = np.diff(np.concatenate([[False], ~touched, [False]]).astype(np.int8))
            keep = np.ones(len(line), bool)
            for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
                if b - a >= self.rules.min_words:
                    keep[a:b] = False
            words.append(line[keep])
            own.append(ends[keep])
        w, o = np.concatenate(words), np.concatenate(own)
        o[: PHRASE - 1] = False
        return w, o

    def _least(self, own: np.ndarray) -> int:
        n = self.rules.min_words - 2
        total = np.concatenate([[0], np.cumsum(own)])
        inside = total[n:] - total[np.minimum(np.arange(len(total) - n) + PHRASE - 1, len(own))] if len(own) >= n else np.ones(1)
        return max(1, math.ceil(self.rules.own * inside.min() - 1e-9))

    def search(self, hashes: np.ndarray, text_of: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs of leaks; ``text_of`` names the text of each word and ascends."""
        rules, v, w = self.rules, len(self.vocabulary), self.rules.min_words
        if not v or len(hashes) < PHRASE or not len(self.owner) or not len(self.phrases):
            return set()
        said = phrases(hashes)
        place = np.minimum(np.searchsorted(self.phrases, said), len(self.phrases) - 1)
        hit = np.flatnonzero((self.phrases[place] == said) & (text_of[PHRASE - 1 :] == text_of[: 1 - PHRASE]))
        if not len(hit):
            return set()
        ix = np.minimum(np.searchsorted(self.vocabulary, hashes), v - 1)
        known = self.vocabulary[ix] == hashes
        words = np.where(known, ix, v).astype(np.int64)
        words = np.concatenate([words, np.full(w + 1, v, np.int64)])
        most = math.ceil(rules.damage * w)
        total = np.concatenate([[0], np.cumsum(known)])
        n = len(hashes)
        dense = total[np.minimum(np.arange(n) + w + most, n)] - total[:-1] >= w - most
        # Windows that reach an own phrase, each with the items whose phrase it is.
        many = self.many[place[hit]]
        near = np.repeat(hit, many)
        holder = self.holder[np.repeat(self.first[place[hit]] - np.cumsum(many) + many, many) + np.arange(many.sum())].astype(np.int64)
        asked = []
        for back in range(w + most):
            p = near - back
            ok = p >= 0
            ok[ok] = known[p[ok]] & dense[p[ok]]
            asked.append(p[ok] * len(self.items) + holder[ok])
        asked = np.unique(np.concatenate(asked))
        at, which = np.unique(asked // len(self.items), return_inverse=True)
        item = asked % len(self.items)
        met = []
        for r, (keys, window) in enumerate(self.keys):
            if not len(at):
                break
            key, good = self.walks.embed(self.bits[r], self.symbols, words, at, r)
            ok = good[which]
            mine = mix(key[which[ok]] ^ self.named[item[ok]])
            lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            found = hi - lo
            p = np.repeat(at[which[ok]], found)
            x = window[np.repeat(lo - np.cumsum(found) + found, found) + np.arange(found.sum())]
            met.append(np.stack([text_of[p], self.owner[x, 0], p - self.owner[x, 1]], 1))
        if met:
            every = np.unique(np.concatenate(met), axis=0)
            # Own phrases of the item that lie where the item would.
            spots = np.sort(holder * (n + 1) + near)
            size = np.array([len(t) for t in self.items])[every[:, 1]]
            start = every[:, 1] * (n + 1)
            lo = np.searchsorted(spots, start + np.clip(every[:, 2] - BAND, 0, n), "left")
            hi = np.searchsorted(spots, start + np.clip(every[:, 2] + size + BAND, 0, n), "right")
            met = [every[hi - lo >= self.least[every[:, 1]]]]
        pairs: dict[tuple[int, int], list[int]] = defaultdict(list)
        if met:
            for text, k, diagonal in met[0].tolist():
                pairs[text, k].append(diagonal)
        found = set()
        for (text, k), diagonals in pairs.items():
            first, last = np.searchsorted(text_of, text, "left"), np.searchsorted(text_of, text, "right")
            done = None
            for d in diagonals:
                if done is not None and d - done <= 4:
                    continue
                if self.verify(k, words, d, int(first), int(last)):
                    found.add((text, k))
                    break
                done = d
        return found

    def _may_hold(self, item: int, words: np.ndarray, diagonal: int, first: int, last: int, band: int) -> bool:
        """Whether enough words of some stretch of the item occur within the band at all, which any alignment needs."""
        t, least = self.items[item], self.rules.min_words - 2
        n = len(t)
        if n < least:
            return False
        near = np.full(n + 2 * band, -1, np.int64)
        a, b = max(first, diagonal - band), min(last, diagonal + n + band)
        if a >= b:
            return False
        near[a - diagonal + band : b - diagonal + band] = words[a:b]
        there = (np.lib.stride_tricks.sliding_window_view(near, 2 * band + 1)[:n] == t[:, None]).any(axis=1)
        # A stretch with no more than the allowed share of others has a sum of at least nought.
        run = np.concatenate([[0.0], np.cumsum(there - (1 - self.rules.damage))])
        return bool((run[least:] - np.minimum.accumulate(run)[: n + 1 - least] >= -1e-9).any())

    def verify(self, item: int, words: np.ndarray, diagonal: int, first: int, last: int, band: int = BAND) -> bool:
        """Whether the item, laid along the diagonal, holds a stretch of ``min_words`` with no more than ``damage`` edits.

        Local alignment within the band; a stretch runs from its first to its last equal
        word. A changed word at either end looks like its neighbourhood, so one word at
        each end is given. At least the share ``own`` of its own phrases must be equal.
        """
        rules = self.rules
        if not self._may_hold(item, words, diagonal, first, last, band):
            return False
        t = self.items[item].tolist()
        lo, hi = max(first, diagonal - band), min(last, diagonal + len(t) + band)
        text = words[lo:hi].tolist()
        off = diagonal - lo
        n = len(text)
        cost = 1.5
        own = self.own[item].tolist()
        owned = [0]
        for x in own:
            owned.append(owned[-1] + x)
        # score, item start, equal own phrases, edits, equal words in a row: of the best stretch that ends here
        above: dict[int, tuple[float, int, int, int, int]] = {}
        for i, x in enumerate(t):
            now: dict[int, tuple[float, int, int, int, int]] = {}
            for j in range(max(0, i + off - band), min(n, i + off + band + 1)):
                best = (0.0, i, 0, 0, 0)
                if text[j] == x:
                    s, b, e, c, run = above.get(j - 1, best)
                    if s <= 0:
                        s, b, e, c, run = best
                    best = (s + 1, b, e + (own[i] and run >= PHRASE - 1), c, run + 1)
                    if i + 1 - b >= rules.min_words - 2 and c <= rules.damage * (i + 1 - b):
                        inside = owned[i + 1] - owned[min(i + 1, b + PHRASE - 1)]
                        if best[2] >= rules.own * inside and best[2] > 0:
                            return True
                else:
                    for s, b, e, c, _ in (above.get(j - 1, best), above.get(j, best), now.get(j - 1, best)):
                        if s - cost > best[0]:
                            best = (s - cost, b, e, c + 1, 0)
                if best[0] > 0:
                    now[j] = best
            above = now
        return False


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rules: LeakRules = LeakRules()) -> DataFrame:
    """doc_id, item_id of every document that holds a passage of an item, once each.

    Items are searched in passes of ``rules.items_per_pass``: that many items and their
    keys are what is sent to the executors, however many there are. Documents are read
    once a pass and never shuffled; only the found pairs are.

    Defined cases: NULL and empty texts hold nothing; items of fewer than ``min_words``
    words (shared lines aside) are never found; NULL ids come out as NULL; repeated rows
    and repeated items give one pair; a document is searched whole, in overlapping pieces.
    """
    spark = documents.sparkSession
    known = items.select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t")).where("t IS NOT NULL").distinct()
    known = cut_lineage(known.withColumn("k", F.xxhash64("i", "t")))
    kind = dict(documents.dtypes)[doc_id]
    kind_item = dict(items.dtypes)[item_id]
    rows = documents.select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL")
    found = spark.createDataFrame([], f"d {kind}, k int, i {kind_item}")
    passes = max(1, math.ceil(known.count() / rules.items_per_pass))
    said, common = shared_phrases(known, rules)
    shared = cut_lineage(said.join(common, "h"))
    for k in range(passes):
        mine = F.pmod("k", F.lit(passes)) == k
        bounded = [(r.i, r.t) for r in known.where(mine).toLocalIterator()]
        bounded.sort(key=lambda x: (str(x[0]), x[1]))
        # No more than the phrases of the items of this pass.
        none = np.array([r.h for r in shared.where(mine).select("h").distinct().toLocalIterator()], np.int64).view(np.uint64)
        index = spark.sparkContext.broadcast(ItemIndex(bounded, rules, none))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                hits: set[tuple[int, int]] = set()
                for which, held in pieces(texts, rules.piece, rules.overlap):
                    points, begin = code_points(held := [plain(t) for t in held])
                    hashes, starts, _ = word_hashes(codes_of(points))
                    text_of = np.searchsorted(begin, starts, "right") - 1
                    hits |= {(which[a], item) for a, item in index.value.search(hashes, text_of)}
                pairs = sorted(hits)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([a for a, _ in pairs], pa.int64())), pa.array([b for _, b in pairs], pa.int32())], names=["d", "k"])

        hit = rows.mapInArrow(search, f"d {kind}, k int")
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(bounded)], f"k int, i {kind_item}")
        found = found.unionByName(hit.join(F.broadcast(names), "k"))
    return found.select(F.col("d").alias(doc_id), F.col("i").alias(item_id)).distinct()
