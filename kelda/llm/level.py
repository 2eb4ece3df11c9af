"""Reading level of documents.

1. Words are counted over the whole corpus and ranked by frequency (ties share a rank).
2. Per document: the coverage rank, that is the size of the smallest frequency-ranked
   vocabulary that covers a fixed share of its tokens; and per sentence its length in words
   and mean word length, as a cell of a fixed grid. Lines that end without a full stop
   (headers, code tables, list rows) are no sentences.
3. In SQL, rated documents give the chance of each cell and of each band of coverage ranks
   at each level and language; the level of a document is the likeliest given its
   sentences and coverage rank.

Languages come from the character model of ``langid``, whose score is a sum over n-grams
and so is computed once per different word of the texts at hand, however rare the word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kelda.llm.codes import code_points, codes_of, pieces, plain, word_hashes
from kelda.llm.langid import LANGUAGES, LangModel, lower_points, ngrams
from kelda.session import cut_lineage


@dataclass(frozen=True)
class LevelRules:
    """share: of a document's tokens that the vocabulary must cover. vocabulary: words whose
    rank is sent to the executors (12 bytes a word); documents that
    need more are ranked by a join, exactly. lengths, word_lengths: edges of the sentence
    grid. smooth: rated sentences added to each cell. foreign: probability from which a
    sentence of ``foreign_words`` words is in another language than its document.
    group: characters of text in memory at once. histogram: most different word counts that are
    broadcast; more are joined by a shuffle."""

    share: float = 0.8
    vocabulary: int = 1 << 16
    lengths: tuple[float, ...] = (4, 5, 6, 7, 8, 10, 12, 14, 17, 20, 24, 29, 35, 42)
    word_lengths: tuple[float, ...] = (3, 3.4, 3.8, 4.2, 4.6, 5, 5.4, 5.8, 6.2, 6.8, 7.5, 8.5)
    levels: int = 5
    smooth: float = 0.5
    foreign: float = 0.9
    foreign_words: int = 4
    group: int = 2_000_000
    histogram: int = 2_000_000


def _texts(texts: list[str | None]) -> list[str]:
    return [plain(t) if t else "" for t in texts]


@dataclass
class Tokens:
    """The words of some texts: text, hash, length; and the run of each, with whether a full stop ends it.

    ``spelling`` is a hash that tells accents apart; ``source`` holds what ``spell`` reads."""

    text: np.ndarray
    hash: np.ndarray
    length: np.ndarray
    run: np.ndarray
    ended: np.ndarray
    spelling: np.ndarray
    source: list[tuple[str, np.ndarray, np.ndarray]]

    def spell(self, which: np.ndarray) -> list[str]:
        """The words at the given places, lower case and whole."""
        offsets = np.cumsum([0] + [len(s) for _, s, _ in self.source])
        out = []
        for i, k in zip(which.tolist(), (np.searchsorted(offsets, which, "right") - 1).tolist()):
            joined, s, n = self.source[k]
            i -= int(offsets[k])
            out.append(joined[s[i] : s[i] + n[i]].lower())
        return out


def tokens(texts: list[str], rules: LevelRules, spelled: bool = False) -> Iterator[tuple[int, int, Tokens]]:
    """Tokens of consecutive texts, a group at a time: first text, one past the last, their tokens.

    A text longer than a group is read in pieces; only its tokens are held together.
    """
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= rules.group):
            size += len(texts[to])
            to += 1
        parts, source, runs = [], [], 0
        for which, held in pieces(texts[at:to], max(rules.group, 1)):
            points, begin = code_points(held)
            codes = codes_of(points)
            h, s, n = word_hashes(codes)
            letters = (codes[s] <= 26) | (codes[s] > 36) if len(s) else np.zeros(0, bool)
            spelling = word_hashes(np.where(codes > 0, lower_points(points) + 1, 0))[0][letters] if spelled else np.zeros(0, np.uint64)
            h, s, n = h[letters], s[letters], n[letters]
            stop = (points == 46) | (points == 33) | (points == 63) | (points == 0x2026)
            space = (points == 32) | (points == 10) | (points == 9) | (points == 13)
            ends = np.flatnonzero(stop & np.append(space[1:], True))
            lines = np.flatnonzero(points == 10)
            edges = np.concatenate([ends, lines])
            order = np.argsort(edges, kind="stable")
            final = np.concatenate([np.ones(len(ends), bool), np.zeros(len(lines), bool)])[order]
            run = np.searchsorted(edges[order], s)
            piece = np.searchsorted(begin, s, "right") - 1
            parts.append((np.array(which)[piece] if len(piece) else piece, h, n, run + runs, final[run] if len(run) else np.zeros(0, bool), spelling))
            if spelled:
                source.append(("\n".join(held), s, n))
            runs += len(edges) + 1
        kinds = (np.int64, np.uint64, np.int64, np.int64, bool, np.uint64)
        yield at, to, Tokens(*[np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kinds[i]) for i in range(6)], source)
        at = to


def word_ranks(documents: DataFrame, text: str, rules: LevelRules, spelled: bool = True) -> DataFrame:
    """h, word, n, rank, last: every word of the corpus, by frequency; rank and last bound the words of one count.

    Tasks count their own words first and send each once; ranks come from the histogram of
    counts, of which there are no more than the square root of twice the tokens. Unless
    ``spelled``, there is no column ``word``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(h: np.ndarray, n: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
            columns = {"h": pa.array(h.view(np.int64)), "n": pa.array(n, pa.int64())} | ({"word": pa.array(list(w), pa.string())} if spelled else {})
            return pa.RecordBatch.from_pydict(columns)

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for _, _, t in tokens(_texts(batch.column(0).to_pylist()), rules, spelled):
                h, first, n = np.unique(t.hash, return_index=True, return_counts=True)
                held.append((h, n, np.array(t.spell(first) if spelled else [None] * len(h), dtype=object)))
                size += len(h)
                if size > 500_000:
                    held = [_merge(held)]
                    size = len(held[0][0])
                    if size > 250_000:
                        yield out(*held[0])
                        held, size = [], 0
        if held:
            yield out(*_merge(held))

    counts = documents.select(F.col(f"`{text}`")).where(F.col(f"`{text}`").isNotNull()).mapInArrow(count, "h long, n long" + (", word string" if spelled else ""))
    word = [F.min("word").alias("word")] if spelled else []
    words = cut_lineage(counts.groupBy("h").agg(F.sum("n").alias("n"), *word))
    steps = words.groupBy("n").agg(F.count("*").alias("k"))
    steps = cut_lineage(steps.withColumn("last", F.sum("k").over(Window.orderBy(F.col("n").desc()))).select("n", "last", (F.col("last") - F.col("k") + 1).alias("rank")))
    # A count may be that of half of all words, so the small side goes to them.
    small = F.broadcast(steps) if steps.count() <= rules.histogram else steps
    return words.join(small, "n").select("h", *(["word"] if spelled else []), "n", "rank", "last")


def _merge(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = np.concatenate([x[0] for x in held])
    u, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    n = np.bincount(inverse, np.concatenate([x[1] for x in held]), len(u)).astype(np.int64)
    return u, n, np.concatenate([x[2] for x in held])[first]


class Vocabulary:
    """Hashes and ranks of the most frequent words, and the language model."""

    def __init__(self, ranked: DataFrame, model: LangModel, rules: LevelRules) -> None:
        rows = ranked.where(F.col("last") <= rules.vocabulary).select("h", "rank").toPandas()
        h = rows["h"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(h)
        self.hashes = h[order]
        self.ranks = rows["rank"].to_numpy()[order].astype(np.int32)
        self.beyond = np.int32(np.iinfo(np.int32).max)
        self.model = model

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each word, the last one for words beyond the vocabulary."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, len(self.hashes))

    def language(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which different spelling each token is, and what each adds to a score and to its n-grams."""
        _, first, which = np.unique(t.spelling, return_index=True, return_inverse=True)
        words = t.spell(first)
        scores = np.zeros((len(words), len(self.model.languages)), np.float32)
        if not words:
            return which, scores, np.zeros(0, np.float32)
        x, o = ngrams(words, self.model.rules)
        for c in range(scores.shape[1]):
            scores[:, c] = np.bincount(o, self.model.weights[x, c], len(words))
        return which, scores, np.bincount(o, minlength=len(words)).astype(np.float32)


_FEATURES = "id {kind}, lang string, wholly boolean, tokens long, sentences long, coverage long, need long, cells array<struct<cell:int,n:int>>, tail array<struct<h:long,n:int>>"


def features(documents: DataFrame, doc_id: str, text: str, vocabulary: Vocabulary, rules: LevelRules) -> DataFrame:
    """Per document its language, whether it is wholly in it, its sentence cells and coverage rank.

    Where the vocabulary covers too little, ``coverage`` is NULL, ``tail`` has the words
    beyond it and ``need`` how many of their tokens must still be covered.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(documents.dtypes)[doc_id]
    struct_cell = pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int32())]))
    struct_tail = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        names = np.array([*LANGUAGES], dtype=object)
        for batch in batches:
            ids, texts = batch.column(0), _texts(batch.column(1).to_pylist())
            for a, b, t in tokens(texts, rules, spelled=True):
                k = b - a
                word, scores, size = v.language(t)
                at = v.find(t.hash)
                n = np.bincount(t.text, minlength=k)
                begin = np.concatenate([[0], np.cumsum(n)])
                # coverage: tokens of each text in order of rank
                ranks = np.append(v.ranks, v.beyond)[at]
                order = np.argsort(t.text.astype(np.int64) << 32 | ranks, kind="stable")
                want = np.maximum(1, np.ceil(rules.share * n - 1e-9).astype(np.int64))
                coverage = np.where(n > 0, np.append(ranks[order], 0)[np.minimum(begin[:-1] + want - 1, len(ranks))], 0).astype(np.int64)
                inside = np.bincount(t.text, at < len(v.hashes), k).astype(np.int64)
                over = (coverage == v.beyond) & (n > 0)
                # sentences
                if len(t.run):
                    first = np.flatnonzero(np.diff(t.run, prepend=-1) != 0)
                    words = np.diff(np.append(first, len(t.run)))
                    mean = np.add.reduceat(t.length, first) / words
                    score = np.add.reduceat(scores[word], first, axis=0)
                    grams = np.add.reduceat(size[word], first)
                    of, ended = t.text[first], t.ended[first]
                else:
                    words = mean = grams = of = np.zeros(0, np.int64)
                    score, ended = np.zeros((0, len(names))), np.zeros(0, bool)
                logit = score / np.sqrt(np.maximum(grams, 1))[:, None] + v.model.bias
                e = np.exp((logit - logit.max(1, keepdims=True)) / v.model.sharpness) if len(logit) else logit
                p = e / np.maximum(e.sum(1, keepdims=True), 1e-30)
                weight = np.where(ended, words, 0)
                share = np.stack([np.bincount(of, p[:, c] * weight, k) for c in range(len(names))], 1) if len(of) else np.zeros((k, len(names)))
                main = share.argmax(1)
                clear = share.max(1) > 0
                foreign = ended & (words >= rules.foreign_words) & (p.max(1) >= rules.foreign) & (p.argmax(1) != main[of]) if len(of) else np.zeros(0, bool)
                wholly = clear & (np.bincount(of, foreign, k) == 0)
                x = np.searchsorted(rules.lengths, words[ended]) * (len(rules.word_lengths) + 1) + np.searchsorted(rules.word_lengths, mean[ended])
                key, many = np.unique(of[ended].astype(np.int64) << 16 | x.astype(np.int64), return_counts=True)
                cell_of, cell = key >> 16, key & 0xFFFF
                sentences = np.bincount(of[ended], minlength=k)
                hard = over[t.text] & (at == len(v.hashes)) if len(at) else np.zeros(0, bool)
                pair = np.stack([t.text[hard].astype(np.uint64), t.hash[hard]], 1)
                tails, tail_n = np.unique(pair, axis=0, return_counts=True) if len(pair) else (pair, np.zeros(0, np.int64))
                tail_at = np.searchsorted(tails[:, 0], np.arange(k + 1).astype(np.uint64)) if len(tails) else np.zeros(k + 1, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, k),
                        pa.array(np.where(clear, names[main], None), pa.string()),
                        pa.array(wholly),
                        pa.array(n, pa.int64()),
                        pa.array(sentences, pa.int64()),
                        pa.array(coverage, pa.int64(), mask=over | (n == 0)),
                        pa.array(np.where(over, want - inside, 0), pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array(np.searchsorted(cell_of, np.arange(k + 1)), pa.int32()),
                            pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(many, pa.int32())], names=["cell", "n"]),
                        ).cast(struct_cell),
                        pa.ListArray.from_arrays(
                            pa.array(tail_at, pa.int32()),
                            pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(tails[:, 1]).view(np.int64) if len(tails) else [], pa.int64()), pa.array(tail_n, pa.int32())], names=["h", "n"]),
                        ).cast(struct_tail),
                    ],
                    names=["id", "lang", "wholly", "tokens", "sentences", "coverage", "need", "cells", "tail"],
                )

    return documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")).mapInArrow(run, _FEATURES.format(kind=kind))


def _exact_coverage(measured: DataFrame, ranked: DataFrame) -> DataFrame:
    """``measured`` with the coverage rank of documents that need words beyond the vocabulary."""
    tails = measured.where(F.size("tail") > 0).select("row", "need", F.explode("tail").alias("x")).select("row", "need", "x.h", "x.n")
    steps = tails.join(ranked.select("h", "rank"), "h")
    run = Window.partitionBy("row").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0)
    far = steps.withColumn("sum", F.sum("n").over(run)).where(F.col("sum") >= F.col("need")).groupBy("row").agg(F.min("rank").alias("far"))
    return measured.join(far, "row", "left").withColumn("coverage", F.coalesce("coverage", "far")).drop("far", "tail", "need")


def measure(documents: DataFrame, doc_id: str, text: str, model: LangModel, rules: LevelRules = LevelRules()) -> DataFrame:
    """id, lang, wholly, tokens, sentences, coverage, cells and a row number, one row per row of documents."""
    ranked = word_ranks(documents, text, rules, spelled=False)
    vocabulary = Vocabulary(ranked, model, rules)
    measured = features(documents, doc_id, text, vocabulary, rules).withColumn("row", F.monotonically_increasing_id())
    return _exact_coverage(cut_lineage(measured), ranked)


def reading_levels(documents: DataFrame, ratings: DataFrame, model: LangModel, doc_id: str = "doc_id", text: str = "text", level: str = "level", rules: LevelRules = LevelRules()) -> DataFrame:
    """doc_id, lang, wholly, tokens, sentences, coverage_rank, level (1 to ``levels``), probability.

    Defined cases: texts that are NULL, empty or without a full sentence have a NULL level
    unless their coverage rank tells it; ratings outside 1 to ``levels``, NULL ones and
    those of unknown documents are not used; a document rated several times counts each
    time; repeated documents come out as often as they came in; without ratings levels
    are NULL; clashing names of other columns don't matter, as none is kept.
    """
    measured = measure(documents, doc_id, text, model, rules)
    band = F.floor(F.log2(F.coalesce("coverage", F.lit(1))) * 2).cast("int")
    measured = measured.withColumn("band", F.when(F.col("coverage").isNotNull(), band))
    rated = ratings.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{level}`").cast("int").alias("level")).where(F.col("level").between(1, rules.levels))
    known = measured.select("id", "lang", "band", "cells").where(F.col("lang").isNotNull()).join(rated, "id")
    # One event per sentence cell, and one per document for its band of coverage ranks.
    event = F.concat(F.transform("cells", lambda c: F.struct(c["cell"].alias("cell"), c["n"].cast("long").alias("n"))), F.when(F.col("band").isNotNull(), F.array(F.struct((-1 - F.col("band")).cast("int").alias("cell"), F.lit(1).cast("long").alias("n")))).otherwise(F.array().cast("array<struct<cell:int,n:bigint>>")))
    events = known.select("lang", "level", F.explode(event).alias("e")).select("lang", "level", "e.cell", "e.n")
    levels = range(1, rules.levels + 1)
    kind = F.when(F.col("cell") < 0, "band").otherwise("cell")
    table = events.groupBy("lang", "cell").agg(*[F.sum(F.when(F.col("level") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in levels])
    totals = table.groupBy("lang", kind.alias("kind")).agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in levels], F.count("*").alias("cells"))
    chance = table.withColumn("kind", kind).join(totals, ["lang", "kind"])
    chance = chance.select("lang", "cell", *[F.log((F.col(f"n{i}") + rules.smooth) / (F.col(f"t{i}") + rules.smooth * F.col("cells"))).alias(f"l{i}") for i in levels])
    prior = known.groupBy("lang").agg(*[F.log((F.count(F.when(F.col("level") == i, 1)) + 1) / (F.count("*") + rules.levels)).alias(f"p{i}") for i in levels])
    # Both tables have at most (grid cells + bands) rows per language, however large the corpus.
    scored = (
        measured.select("row", "lang", F.explode(event).alias("e"))
        .select("row", "lang", "e.cell", "e.n")
        .join(F.broadcast(chance), ["lang", "cell"])
        .groupBy("row", "lang")
        .agg(*[F.sum(F.col("n") * F.col(f"l{i}")).alias(f"s{i}") for i in levels])
        .join(F.broadcast(prior), "lang")
        .select("row", *[(F.col(f"s{i}") + F.col(f"p{i}")).alias(f"s{i}") for i in levels])
    )
    top = F.greatest(*[F.col(f"s{i}") for i in levels])
    mass = reduce(lambda a, b: a + b, [F.exp(F.col(f"s{i}") - top) for i in levels])
    likeliest = F.coalesce(*[F.when(F.col(f"s{i}") == top, F.lit(i)) for i in levels])
    answer = scored.select("row", likeliest.alias("level"), (1 / mass).alias("probability"))
    out = measured.join(answer, "row", "left")
    return out.select(F.col("id").alias(doc_id), "lang", "wholly", "tokens", "sentences", F.col("coverage").alias("coverage_rank"), "level", "probability")
