"""Languages of documents and of the segments in them.

A multinomial logistic regression on hashed character n-grams, weighted by TF-IDF, fitted
with follow-the-regularised-leader (FTRL-proximal) under an elastic-net penalty and
calibrated with a temperature and a share of noise on held-out rows with the labels they came with. Labels may
be wrong: after a first fit every training sentence is given the language that its rows, of all
their sentences together, seem to be in, since a wrong label is wrong for a whole row; after
the next one every sentence whose label the model contradicts with confidence is relabelled,
and the model is fitted again. Where confidences are calibrated labels stay as given, so a
confidence says how often a label as given agrees.

A text is cut at sentence ends, line ends and separators; each cut gets a distribution
over languages, and a Viterbi pass joins cuts into segments.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kelda.llm.codes import code_points, fold, plain

#: Usual notations of the languages, lower case; a region after '-' or '_' is dropped first.
NOTATIONS = {
    "en": ("en", "eng", "english", "anglais", "englisch", "inglés", "ingles"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "frances"),
    "es": ("es", "spa", "esp", "spanish", "español", "espanol", "espagnol", "castellano", "spanisch"),
    "de": ("de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "aleman"),
}
LANGUAGES = tuple(NOTATIONS)
_CODE = {n: k for k, names in NOTATIONS.items() for n in names}
_CUT = re.compile(r"(?<=[.!?…])[\"'»”)]*\s+(?=[\"'«“(¿¡]*[^\W\d_a-zà-ÿ])|\n+|\s+[/|–—-]\s+|\s*(?:\*{2,}|={3,}|-{3,}|_{3,}|~{2,}|#{2,})\s*|\t+|[•;]\s+")
_CODED = re.compile(r"\S*\d\S*")
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"[^\W\d_]{2,}")


def language_of_label(label: str | None) -> str | None:
    """'en', 'fr', 'es' or 'de' for any usual notation, else None."""
    if not isinstance(label, str):
        return None
    return _CODE.get(re.split(r"[-_(]", label.strip().lower())[0].strip())


def cuts(text: str) -> list[str]:
    """The sentences and phrases of a text without its markup; one needs two words that hold no digit."""
    return [c.strip() for c in _CUT.split(plain(text)) if c and len(_WORD.findall(_CODED.sub(" ", c) if _DIGIT.search(c) else c)) >= 2]


@dataclass(frozen=True)
class LangRules:
    """sample: labelled rows to fit on, at most. sentences: of their cuts, at most. buckets: hashed features. orders: lengths of n-grams.
    alpha, beta, l1, l2: FTRL-proximal. rounds: passes over the sample in each of ``fits`` fits.
    bare: share of the sentences that are given a second time without accents. least:
    share of the sentences in which an n-gram must occur, which keeps names out.
    relabel: confidence from which the answer of a fit but the last, or the first where rows are known, replaces a label. switch: cost, in
    nats, of a change of language between cuts. full: letters from which a cut counts fully."""

    sample: int = 3000
    sentences: int = 15_000
    buckets: int = 1 << 15
    orders: tuple[int, ...] = (1, 2, 3)
    alpha: float = 0.05
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.5
    rounds: int = 1
    fits: int = 3
    bare: float = 0.2
    least: float = 0.004
    batch: int = 256
    relabel: float = 0.6
    switch: float = 1.0
    full: int = 18
    seed: int = 5


_LOWER: np.ndarray | None = None


def _lower() -> np.ndarray:
    global _LOWER
    if _LOWER is None:
        _LOWER = np.array([ord(chr(i).lower()) if chr(i).isalpha() and len(chr(i).lower()) == 1 else 32 for i in range(0x3000)], dtype=np.uint32)
    return _LOWER


def lower_points(points: np.ndarray) -> np.ndarray:
    """Lower case of letters, 32 for what is none or lies beyond U+3000."""
    return _lower()[np.where(points < 0x3000, points, 32)]


def ngrams(texts: list[str], rules: LangRules) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every character n-gram of the texts, and the text it is of, text by text."""
    joined = " " + "  ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = lower_points(points)
    ends = np.cumsum(np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts)))
    of = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[: len(c)]
    c = c[: len(of)].astype(np.uint32)
    letter = c != 32
    out, owner = [], []
    h = np.zeros(len(c), np.uint32)
    filled = np.zeros(len(c), bool)
    for n in range(1, max(rules.orders) + 1):
        k = len(c) - n + 1
        if k <= 0:
            break
        h = h[:k] * np.uint32(2654435761) + c[n - 1 :] + np.uint32(1)
        filled = filled[:k] | letter[n - 1 :]
        if n in rules.orders:
            ok = filled if n == 1 else filled & ~((~letter[:k]) & (~letter[1 : k + 1]))
            x = h[ok] ^ (h[ok] >> np.uint32(15))
            x = (x * np.uint32(2246822519)) ^ np.uint32(n * 40503)
            out.append((x >> np.uint32(7)) & np.uint32(rules.buckets - 1))
            owner.append(of[:k][ok])
    x, o = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(o, kind="stable")
    return x[order].astype(np.int64), o[order]


class LangModel:
    """Weights (idf folded in), bias and two temperatures: ``temperature`` of confidences and
    ``noise``, the share of labels that say nothing, fitted to labels as given; ``sharpness``
    of the evidence by which cuts are joined, fitted to labels put right."""

    def __init__(self, rules: LangRules, languages: tuple[str, ...] = LANGUAGES) -> None:
        self.rules, self.languages = rules, languages
        self.weights = np.zeros((rules.buckets, len(languages)), np.float32)
        self.bias = np.zeros(len(languages), np.float32)
        self.temperature = self.sharpness = 1.0
        self.noise = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(self.languages)), np.float32)
        x, o = ngrams(texts, self.rules)
        if not len(x):
            return np.tile(self.bias, (len(texts), 1))
        total = np.zeros((len(texts), len(self.languages)), np.float32)
        present, first, many = np.unique(o, return_index=True, return_counts=True)
        total[present] = np.add.reduceat(self.weights[x], first, axis=0) / np.sqrt(many)[:, None]
        return total + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return self._calibrated(self.logits(texts))

    def _calibrated(self, raw: np.ndarray) -> np.ndarray:
        return (1 - self.noise) * softmax(raw / self.temperature) + self.noise / len(self.languages)

    def fit(self, texts: list[str], y: np.ndarray, rows: np.ndarray | None = None, times: np.ndarray | None = None, within: tuple[np.ndarray, np.ndarray] | None = None) -> LangModel:
        """``rows``: the row each text is of; a row is held out whole, with its copies without accents.
        ``times``: how often a text occurs with its label, which counts where confidences are calibrated.
        ``within``: every text and row that holds it with this label, by which labels of whole rows are put right."""
        rules, k = self.rules, len(self.languages)
        own = len(texts)
        rng = np.random.default_rng(rules.seed)
        of = np.unique(rows if rows is not None else np.arange(len(texts)), return_inverse=True)[1]
        out = rng.permutation(of.max() + 1)[: (of.max() + 1) // 10] if len(texts) else of
        bare = np.flatnonzero(rng.random(len(texts)) < rules.bare)
        texts, y, of = [*texts, *(fold(texts[i]) for i in bare)], np.concatenate([y, y[bare]]), np.concatenate([of, of[bare]])
        given, aside = y, np.isin(of, out)
        times = np.ones(len(texts)) if times is None else np.concatenate([times, times[bare]]).astype(float)
        held_x, sizes, df = [], [], np.zeros(rules.buckets, np.int64)
        for at in range(0, len(texts), 1000):
            part = texts[at : at + 1000]
            x, o = ngrams(part, rules)
            held_x.append(x.astype(np.int32))
            sizes.append(np.bincount(o, minlength=len(part)))
            df += np.bincount(np.unique(o * rules.buckets + x) % rules.buckets, minlength=rules.buckets)
        x = np.concatenate(held_x)
        begin = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        idf = np.where(df >= rules.least * len(texts), np.log((1 + len(texts)) / (1 + df)) + 1, 0.0)
        held, rest = np.flatnonzero(aside), rng.permutation(np.flatnonzero(~aside))
        heed = np.ones(own) if within is None else self._heed(own, *within)
        heed = np.concatenate([heed, heed[bare]])
        for again in range(rules.fits):
            z, n = np.zeros((rules.buckets + 1, k)), np.zeros((rules.buckets + 1, k))
            for _ in range(rules.rounds):
                for at in range(0, len(rest), rules.batch):
                    rows = rest[at : at + rules.batch]
                    idx = np.concatenate([x[begin[r] : begin[r + 1]] for r in rows])
                    row = np.repeat(np.arange(len(rows)), begin[rows + 1] - begin[rows])
                    value = idf[idx] / np.sqrt(np.maximum(1, begin[rows + 1] - begin[rows]))[row]
                    w = self._ftrl(z, n)
                    score = np.stack([np.bincount(row, value * w[idx, c], len(rows)) for c in range(k)], 1) + w[-1]
                    error = softmax(score)
                    error[np.arange(len(rows)), y[rows]] -= 1
                    # Until labels of rows are put right, one long row of a wrong label must not outweigh many.
                    if again == 0:
                        error *= heed[rows][:, None]
                    g = np.stack([np.bincount(idx, value * error[row, c], rules.buckets + 1) for c in range(k)], 1)
                    g[-1] = error.sum(0)
                    step = (np.sqrt(n + g * g) - np.sqrt(n)) / rules.alpha
                    z += g - step * w
                    n += g * g
            w = self._ftrl(z, n)
            self.weights = (w[:-1] * idf[:, None]).astype(np.float32)
            self.bias = w[-1].astype(np.float32)
            p = np.concatenate([softmax(self.logits(texts[at : at + 1000])) for at in range(0, len(texts), 1000)])
            if again == 0 and within is not None:
                # A wrong label is wrong for all of its row, so the row's other sentences tell.
                y = self._of_rows(p[:own], y[:own], *within)
                y = np.concatenate([y, y[bare]])
            elif again < rules.fits - 1:
                y = np.where(p.max(1) >= rules.relabel, p.argmax(1), y)
        if len(held):
            raw = np.concatenate([self.logits([texts[i] for i in held[at : at + 1000]]) for at in range(0, len(held), 1000)])
            self.temperature, self.noise = self._temper(raw, given[held], times[held], np.linspace(0, 0.6, 31))
            self.sharpness, _ = self._temper(raw, y[held], np.ones(len(held)), np.zeros(1))
        return self

    @staticmethod
    def _heed(n: int, text: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How much each text counts so that no row counts more than a middling one."""
        row, size = np.unique(row, return_inverse=True, return_counts=True)[1:]
        return np.minimum(1.0, np.bincount(text, np.median(size) / size[row], n))

    @staticmethod
    def _of_rows(p: np.ndarray, y: np.ndarray, text: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The language of most rows that hold each text, which is what all texts of a row say together."""
        k = p.shape[1]
        row = np.unique(row, return_inverse=True)[1]
        main = np.stack([np.bincount(row, p[text, c]) for c in range(k)], 1).argmax(1)
        votes = np.bincount(text * k + main[row], minlength=len(p) * k).reshape(len(p), k)
        return np.where(votes.any(1), votes.argmax(1), y)

    @staticmethod
    def _temper(raw: np.ndarray, truth: np.ndarray, times: np.ndarray, noises: np.ndarray) -> tuple[float, float]:
        """Temperature and noise under which the labels are likeliest."""
        best = (np.inf, 1.0, 0.0)
        for t in np.exp(np.linspace(np.log(0.3), np.log(10), 60)):
            p = softmax(raw / t)[np.arange(len(raw)), truth]
            for e in noises:
                best = min(best, (float(-(times * np.log((1 - e) * p + e / raw.shape[1] + 1e-12)).sum()), float(t), float(e)))
        return best[1:]

    def _ftrl(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        r = self.rules
        l1 = np.full((len(z), 1), r.l1)
        l1[-1] = 0
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((r.beta + np.sqrt(n)) / r.alpha + r.l2))

    def segments(self, texts: list[str | None]) -> list[list[tuple[str, str, float]]]:
        """Per text its segments: language, text, confidence (the mean over its cuts, by length)."""
        parts = [cuts(t) if isinstance(t, str) else [] for t in texts]
        flat = [c for p in parts for c in p]
        if not flat:
            return [[] for _ in parts]
        raw = self.logits(flat)
        sharp, probs = softmax(raw / self.sharpness), self._calibrated(raw)
        points, begin = code_points(flat)
        size = np.add.reduceat(lower_points(points) != 32, begin[:-1]).astype(np.float64)
        told = sharp.argmax(1)
        out, at = [], 0
        for p in parts:
            if not p:
                out.append([])
                continue
            to = at + len(p)
            # Cuts that agree are one segment whatever a change costs.
            path = told[at:to] if (told[at:to] == told[at]).all() else self._path(sharp[at:to], size[at:to])
            edges = [0, *(np.flatnonzero(np.diff(path)) + 1), len(p)]
            mine = []
            for i, j in zip(edges, edges[1:]):
                k = int(path[i])
                weight = size[at + i : at + j]
                mine.append((self.languages[k], " ".join(p[i:j]), float((probs[at + i : at + j, k] * weight).sum() / max(1.0, weight.sum()))))
            out.append(mine)
            at = to
        return out

    def _path(self, sharp: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The likeliest language of each cut, where a change costs ``switch``."""
        evidence = np.log(np.maximum(sharp, 1e-6)) * np.minimum(1.0, size / self.rules.full)[:, None]
        k = len(self.languages)
        best, back = evidence[0], []
        for e in evidence[1:]:
            move = best.max() - self.rules.switch
            back.append(np.where(best >= move, np.arange(k), best.argmax()))
            best = np.maximum(best, move) + e
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return np.array(path[::-1])


def softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_language_model(rows: DataFrame, text: list[str], label: str, key: list[str], rules: LangRules = LangRules()) -> LangModel:
    """A model fitted on at most ``rules.sample`` rows with a label, drawn by hash of their keys.

    Keys, not texts, decide the draw, so that no group of copies fills it; a sentence with
    its label counts once. Each cut of a row's texts is a training sentence with the row's label; of more than
    ``rules.sentences`` an even draw is used.
    """
    columns = [F.col(f"`{c}`") for c in text]
    drawn = F.xxhash64(*[F.col(f"`{k}`") for k in key])
    labelled = rows.select(*[c.alias(f"t{i}") for i, c in enumerate(columns)], F.col(f"`{label}`").alias("l"), drawn.alias("h"))
    labelled = labelled.where("l IS NOT NULL AND trim(l) NOT IN ('', 'und')").orderBy("h").limit(rules.sample)
    said: dict[tuple[str, int], dict[int, None]] = {}
    times: Counter = Counter()
    for n, r in enumerate(labelled.toLocalIterator()):
        code = language_of_label(r["l"])
        if code is None:
            continue
        for i in range(len(text)):
            if r[f"t{i}"]:
                for c in cuts(r[f"t{i}"]):
                    said.setdefault((c, LANGUAGES.index(code)), {})[n] = None
                    times[c, LANGUAGES.index(code)] += 1
    sentences, y, of, many = [s for s, _ in said], [c for _, c in said], [*said.values()], [times[x] for x in said]
    model = LangModel(rules)
    if not sentences:
        return model
    if len(sentences) > rules.sentences:
        drawn = np.random.default_rng(rules.seed).choice(len(sentences), rules.sentences, replace=False)
        sentences, y, of, many = ([x[i] for i in drawn] for x in (sentences, y, of, many))
    within = np.repeat(np.arange(len(of)), [len(x) for x in of]), np.array([n for x in of for n in x])
    return model.fit(sentences, np.array(y), np.array([next(iter(x)) for x in of]), np.array(many), within)


def label_segments(rows: DataFrame, columns: list[str], model: LangModel) -> DataFrame:
    """rows with, per text column c, ``c_segments``: array of (lang, text, confidence).

    Defined cases: NULL, empty and letterless texts get an empty array; a text is read
    whole; repeated rows are labelled alike; other columns are kept.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(texts), 512):
            out += shared.value.segments(list(texts.iloc[at : at + 512]))
        return pd.Series([[{"lang": a, "text": b, "confidence": c} for a, b, c in s] for s in out], index=texts.index, dtype=object)

    label = F.pandas_udf(run, "array<struct<lang string, text string, confidence double>>")
    return rows.withColumns({f"{c}_segments": label(F.col(f"`{c}`")) for c in columns})


def label_languages(rows: DataFrame, columns: list[str], model: LangModel) -> DataFrame:
    """rows with, per text column c, ``c_langs``: the set of languages of its segments."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for at in range(0, len(texts), 512):
                out += [sorted({x[0] for x in s}) for s in shared.value.segments(list(texts.iloc[at : at + 512]))]
            yield pd.Series(out, index=texts.index, dtype=object)

    label = F.pandas_udf(run, "array<string>")
    return rows.withColumns({f"{c}_langs": label(F.col(f"`{c}`")) for c in columns})
