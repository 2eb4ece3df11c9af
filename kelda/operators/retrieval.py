"""Retrieval: BM25, vectors, pooling and rank fusion, and chunks of documents."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from kelda.functions.text import count_token, count_tokens, tokens
from kelda.session import cut_lineage


def postings(documents: DataFrame, doc_id: str, text: str, only: list[str] | None = None) -> DataFrame:
    """doc_id, term, tf; of the given terms alone where those are named, so that others never leave the scan's stage."""
    words = documents.select(doc_id, F.explode(tokens(text)).alias("term"))
    if only is not None:
        words = words.where(F.col("term").isin(only))
    return words.groupBy(doc_id, "term").agg(F.count("*").alias("tf"))


def bm25_lists(documents: DataFrame, doc_id: str, text: str, queries: list[str], k: int, k1: float = 1.5, b: float = 0.75) -> list[DataFrame]:
    """For each query the ``k`` best documents: doc_id, score. A query term counts as often as it is repeated.

    Texts are read once, for all queries: lengths and counts of the queries' terms, a few
    numbers a document, are written, and statistics and scores come from them. Empty
    documents count in the number and the mean length. Ties go to the smaller id; a query
    without words finds nothing.
    """
    weights = [Counter(re.findall(r"\w+", q.lower())) for q in queries]
    names = list(dict.fromkeys(t for w in weights for t in w))
    if not names:
        return [documents.select(doc_id, F.lit(0.0).alias("score")).limit(0) for _ in queries]
    counted = cut_lineage(documents.select(doc_id, count_tokens(text).alias("len"), *[count_token(text, t).alias(f"tf{i}") for i, t in enumerate(names)]))
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(names))])
    out = []
    for weight in weights:
        if not weight:
            out.append(documents.select(doc_id, F.lit(0.0).alias("score")).limit(0))
            continue
        at = [names.index(t) for t in weight]
        both = counted.where(reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in at])).join(F.broadcast(stats))
        parts = []
        for i, t in zip(at, weight):
            idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
            tf = F.col(f"tf{i}")
            parts.append(weight[t] * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avgdl"))))
        score = F.round(reduce(lambda x, y: x + y, parts), 6)
        out.append(both.select(doc_id, score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), doc_id).limit(k))
    return out


def bm25(documents: DataFrame, doc_id: str, text: str, query: str, k: int) -> DataFrame:
    """``bm25_lists`` of one query."""
    return bm25_lists(documents, doc_id, text, [query], k)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, vec_id: str, vector: str, query: Column, k: int, exclude: Column | None = None) -> DataFrame:
    """vec_id, similarity, score = 1 / (1 + distance) of the ``k`` nearest; exact, one pass. Ties go to the smaller id."""
    rows = vectors if exclude is None else vectors.where(~exclude)
    s = F.round(cosine(F.col(vector), query), 6)
    return rows.select(vec_id, s.alias("similarity")).where("similarity IS NOT NULL").withColumn("score", F.round(1 / (2 - F.col("similarity")), 6)).orderBy(F.col("similarity").desc(), vec_id).limit(k)


def max_pool(chunks: DataFrame, parent: str, score: str, exclude: Column | None = None) -> DataFrame:
    """Best score of each parent; an excluded parent goes with all its chunks."""
    rows = chunks if exclude is None else chunks.where(~exclude)
    return rows.groupBy(parent).agg(F.max(score).alias(score))


def fuse(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of short ranked lists (key, rank from 1): key, fused, n_lists; absent means nothing."""
    every = reduce(DataFrame.unionByName, [x.select(key, "rank") for x in lists])
    return every.groupBy(key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 8).alias("fused"), F.count("*").alias("n_lists"))


def ranked(short: DataFrame, order: list[Column]) -> DataFrame:
    """``rank`` from 1 on a list that a limit has made short."""
    return short.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def theme(vectors: DataFrame, vector: str) -> DataFrame:
    """One row: the mean of unit vectors, itself of unit length, as ``theme``.

    Summed by position, so the driver or a task never holds the vectors.
    """
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    parts = vectors.select(F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("pos", "x"), norm.alias("n")).where("n > 0")
    mean = parts.groupBy("pos").agg(F.avg(F.col("x") / F.col("n")).alias("m"))
    packed = mean.agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("v")).select(F.transform("v", lambda s: s["m"]).alias("v"))
    return packed.select(F.transform("v", lambda x: x / F.sqrt(dot(F.col("v"), F.col("v")))).alias("theme"))


def two_pole(vectors: DataFrame, vector: str, positive: DataFrame, negative: DataFrame, name: str = "pole") -> DataFrame:
    """vectors with nearness to one theme less nearness to the other, to four places."""
    poles = positive.select(F.col("theme").alias("__p")).join(negative.select(F.col("theme").alias("__n")))
    both = vectors.join(F.broadcast(poles))
    return both.withColumn(name, F.round(cosine(F.col(vector), F.col("__p")) - cosine(F.col(vector), F.col("__n")), 4) + 0.0).drop("__p", "__n")


def hybrid(documents: DataFrame, doc_id: str, text: str, vectors: DataFrame, vec_id: str, vector: str, query_text: str, query_vector: Column, n: int) -> DataFrame:
    """doc_id, fused, n_lists of the ``n`` best by words and by vector: each list has max(3n, 30), fused by reciprocal ranks."""
    pool = max(3 * n, 30)
    words = ranked(bm25(documents, doc_id, text, query_text, pool), [F.col("score").desc(), F.col(doc_id)])
    near = ranked(nearest(vectors, vec_id, vector, query_vector, pool), [F.col("similarity").desc(), F.col(vec_id)])
    return fuse([words, near.withColumnRenamed(vec_id, doc_id)], doc_id).orderBy(F.col("fused").desc(), doc_id).limit(n)


#: Queries of one pass, which are broadcast, and scores that are held at once.
QUERIES, SCORES = 20_000, 2_000_000


def _passes(queries: DataFrame, query_id: str) -> Iterator[list]:
    """The rows of a set of queries, by hash of their id in passes that a broadcast can hold."""
    n = max(1, -(-queries.count() // QUERIES))
    for i in range(n):
        yield queries.where(F.pmod(F.xxhash64(query_id), F.lit(n)) == i).collect()


def _best(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, score) the k best of each query; ties go to the smaller id."""
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], ids[keep], s[keep]


def _top(k: int, n: int, blocks: Iterator[tuple[np.ndarray, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of n queries over blocks (ids, first query, scores by row and query); -inf is no score."""
    state, floor = None, np.full(n, -np.inf)
    for ids, at, s in blocks:
        least = floor[at : at + s.shape[1]]
        if len(s) > k:
            least = np.maximum(least, np.partition(s, len(s) - k, axis=0)[len(s) - k])
        row, col = np.nonzero((s >= least) & (s > -np.inf))
        new = (col + at, ids[row], s[row, col])
        state = _best(*(new if state is None else [np.concatenate(x) for x in zip(state, new)]), k)
        full = np.flatnonzero(np.bincount(state[0], minlength=n) == k)
        floor[full] = state[2][np.searchsorted(state[0], full, "right") - 1]
    return state if state is not None else (np.zeros(0, int),) * 3


def _cosines(vectors: list, dims: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, queries, cosines to six places) in blocks; -inf where a vector is missing, damaged or zero."""
    lengths = np.array([-1 if v is None else len(v) for v in vectors])
    for dim, (which, unit) in dims.items():
        rows = np.flatnonzero(lengths == dim)
        if not len(rows):
            continue
        m = np.array([vectors[i] for i in rows], dtype=np.float64)
        with np.errstate(all="ignore"):
            m = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
        step = max(1, SCORES // len(rows))
        for a in range(0, len(which), step):
            s = np.round(m @ unit[a : a + step].T, 6) + 0.0
            yield rows, which[a : a + step], np.where(np.isnan(s), -np.inf, s)


def _by_length(vectors: list) -> tuple[list[int], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Places of the vectors that have a direction, ordered by length, and per length (their new numbers, unit vectors)."""
    fit = [(len(v), i) for i, v in enumerate(vectors) if v and None not in v and any(v)]
    order = [i for _, i in sorted(fit)]
    out = {}
    for dim in sorted({n for n, _ in fit}):
        which = np.array([at for at, i in enumerate(order) if len(vectors[i]) == dim])
        m = np.array([vectors[order[at]] for at in which], dtype=np.float64)
        out[dim] = (which, m / np.sqrt((m * m).sum(axis=1, keepdims=True)))
    return order, out


def _types(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def _first(found: DataFrame, k: int, score: str, key: str) -> DataFrame:
    """``rank`` within each query from 1 to k."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_each(vectors: DataFrame, vec_id: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int, exclude_self: bool = False) -> DataFrame:
    """query_id, vec_id, similarity, score, rank: ``nearest`` for every query, each against all rows.

    Rows are scored where they are, in blocks against the broadcast queries, and a task
    hands on ``k`` rows a query. Ids are numbers, those of queries distinct. Vectors that
    are missing, zero or of another length have no similarity. ``exclude_self`` leaves out
    the row of the query's own id.
    """
    spark, found = vectors.sparkSession, []
    for part in _passes(queries.select(query_id, query_vector), query_id):
        order, dims = _by_length([r[1] for r in part])
        shared = spark.sparkContext.broadcast((np.array([part[i][0] for i in order]), dims))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own, dims = shared.value

            def blocks():
                for b in batches:
                    ids = b[vec_id].to_numpy()
                    for rows, which, s in _cosines(b[vector].tolist(), dims):
                        if exclude_self:
                            s[ids[rows][:, None] == own[which][None, :]] = -np.inf
                        yield ids[rows], which[0], s

            q, ids, s = _top(k, len(own), blocks())
            yield pd.DataFrame({"query_id": own[q] if len(q) else [], vec_id: ids, "similarity": s})

        found.append(vectors.select(vec_id, vector).where(F.col(vec_id).isNotNull()).mapInPandas(run, f"query_id {_types(queries, query_id)}, {vec_id} {_types(vectors, vec_id)}, similarity double"))
    best = _first(reduce(DataFrame.unionByName, found), k, "similarity", vec_id)
    return best.select("query_id", vec_id, "similarity", F.round(1 / (2 - F.col("similarity")), 6).alias("score"), "rank")


def max_pool_each(vectors: DataFrame, parent: str, vector: str, queries: DataFrame, query_id: str, query_vector: str, query_parent: str) -> DataFrame:
    """query_id, parent, score: the best chunk of each parent for every query, the query's own parent left out whole.

    A batch hands on one row per query and parent. Rows and queries without a parent are left out.
    """
    spark, found = vectors.sparkSession, []
    for part in _passes(queries.select(query_id, query_vector, query_parent).where(F.col(query_parent).isNotNull()), query_id):
        order, dims = _by_length([r[1] for r in part])
        shared = spark.sparkContext.broadcast((np.array([part[i][0] for i in order]), np.array([part[i][2] for i in order]), dims))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, own, dims = shared.value
            for b in batches:
                parents = b[parent].to_numpy()
                for rows, which, s in _cosines(b[vector].tolist(), dims):
                    order = np.argsort(parents[rows], kind="stable")
                    kinds, starts = np.unique(parents[rows][order], return_index=True)
                    s = np.maximum.reduceat(s[order], starts, axis=0)
                    s[kinds[:, None] == own[which][None, :]] = -np.inf
                    row, col = np.nonzero(s > -np.inf)
                    yield pd.DataFrame({"query_id": ids[which[col]], parent: kinds[row], "s": s[row, col]})

        found.append(vectors.select(parent, vector).where(F.col(parent).isNotNull()).mapInPandas(run, f"query_id {_types(queries, query_id)}, {parent} {_types(vectors, parent)}, s double"))
    pooled = reduce(DataFrame.unionByName, found).groupBy("query_id", parent).agg(F.max("s").alias("s"))
    return pooled.select("query_id", parent, F.round(1 / (2 - F.col("s")), 6).alias("score"))


def bm25_each(documents: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query_text: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score, rank: ``bm25`` for every query, each against all documents.

    One pass counts lengths and the documents of each term of the queries, another scores
    documents where they are and hands on ``k`` a query and task. Ids are numbers.
    """
    spark, found = documents.sparkSession, []
    n, mean = documents.agg(F.count("*"), F.avg(count_tokens(text))).first()
    for part in _passes(queries.select(query_id, tokens(query_text).alias("t")), query_id):
        own = np.array([r[0] for r in part])
        said = Counter((t, i) for i, r in enumerate(part) for t in r["t"] or [])
        terms: dict[str, list[tuple[int, int]]] = {}
        for (t, i), m in said.items():
            terms.setdefault(t, []).append((i, m))
        if not terms:
            continue
        known = F.broadcast(spark.createDataFrame([(t,) for t in terms], "term string"))
        held = documents.select(F.explode(F.array_distinct(tokens(text))).alias("term")).join(known, "term").groupBy("term").agg(F.count("*").alias("df")).collect()
        weighed = {t: (np.array([i for i, _ in terms[t]]), log((n - df + 0.5) / (df + 0.5) + 1) * np.array([m for _, m in terms[t]], dtype=float)) for t, df in held}
        shared = spark.sparkContext.broadcast((own, weighed))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own, weighed = shared.value

            def blocks():
                step = max(1, SCORES // len(own))
                for batch in batches:
                    for at in range(0, len(batch), step):
                        some = batch.iloc[at : at + step]
                        s = np.zeros((len(some), len(own)))
                        for row, words in zip(s, some["t"]):
                            if words is None:
                                continue
                            for t, tf in Counter(w for w in words if w in weighed).items():
                                which, weight = weighed[t]
                                row[which] += weight * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / mean)))
                        s = np.round(s, 6)
                        yield some[doc_id].to_numpy(), 0, np.where(s > 0, s, -np.inf)

            q, ids, s = _top(k, len(own), blocks())
            yield pd.DataFrame({"query_id": own[q] if len(q) else [], doc_id: ids, "score": s})

        found.append(documents.select(doc_id, tokens(text).alias("t")).mapInPandas(run, f"query_id {_types(queries, query_id)}, {doc_id} {_types(documents, doc_id)}, score double"))
    if not found:
        return spark.createDataFrame([], f"query_id {_types(queries, query_id)}, {doc_id} {_types(documents, doc_id)}, score double, rank int")
    return _first(reduce(DataFrame.unionByName, found), k, "score", doc_id)


def hybrid_each(words: DataFrame, near: DataFrame, key: str, n: int) -> DataFrame:
    """query_id, key, fused, n_lists of the ``n`` best of every query, out of two ranked lists (query_id, key, rank) by reciprocal ranks."""
    every = words.select("query_id", key, "rank").unionByName(near.select("query_id", key, "rank"))
    fused = every.groupBy("query_id", key).agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 8).alias("fused"), F.count("*").alias("n_lists"))
    return _first(fused, n, "fused", key).drop("rank")


# Characters of a chunk, of its overlap with the one before, and of its text at least.
CHUNK, OVERLAP, LEAST = 988, 197, 200
_BREAK = re.compile(r"\n\s*\n")
_STOP = re.compile(r"(?<=[.!?])\s+")


def chunk_spans(body: str, room: int) -> list[list[tuple[int, int]]]:
    """Spans (start, end) of a text by chunk: paragraphs, of long ones the sentences, of longer ones even parts.

    Boundaries are found once; a chunk is a range of spans whose lengths, with two characters
    between each, are at most ``room``.
    """
    def between(pattern: re.Pattern, a: int, b: int) -> list[tuple[int, int]]:
        cuts = [(m.start(), m.end()) for m in pattern.finditer(body, a, b)]
        return list(zip([a, *(e for _, e in cuts)], [*(s for s, _ in cuts), b]))

    spans = []
    for a, b in between(_BREAK, 0, len(body)):
        for x, y in [(a, b)] if b - a <= room else between(_STOP, a, b):
            held = body[x:y]
            x, y = x + len(held) - len(held.lstrip()), y - len(held) + len(held.rstrip())
            spans += [(i, min(i + room, y)) for i in range(x, y, room)]
    # Where each chunk begins: the first span that doesn't fit behind those before it.
    reach, firsts = room + 1, []
    for k, (x, y) in enumerate(spans):
        reach += 2 + y - x
        if reach > room:
            firsts.append(k)
            reach = y - x
    return [spans[i:j] for i, j in zip(firsts, [*firsts[1:], len(spans)])]


def chunk_texts(title: str | None, text: str | None, size: int = CHUNK, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Chunks of a document, each under its title; from the second on each begins with the whole words that end the one before.

    A title alone is one chunk; nothing at all is none.
    """
    head, body = (title or "").strip(), (text or "").strip()
    plain = ["\n\n".join(body[a:b] for a, b in spans) for spans in chunk_spans(body, max(least, size - len(head) - overlap - 2))]
    ends = ["", *(p if len(p) <= overlap else p[-overlap:].partition(" ")[2] or p[-overlap:] for p in plain[:-1])]
    bodies = [f"{e} {p}".strip() for e, p in zip(ends, plain)] or [""]
    return [c for b in bodies if (c := "\n\n".join(x for x in (head, b) if x))]


def chunk(documents: DataFrame, doc_id: str, title: Column, text: Column) -> DataFrame:
    """doc_id, chunk_id ('id#n'), position, chunk."""

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, b in batches:
            yield pd.Series([chunk_texts(x, y) for x, y in zip(t, b)], dtype=object)

    chunks = F.pandas_udf(cut, "array<string>")(title, text)
    out = documents.select(F.col(doc_id), F.posexplode(chunks).alias("position", "chunk"))
    return out.select(doc_id, F.concat_ws("#", F.col(doc_id).cast("string"), F.col("position").cast("string")).alias("chunk_id"), "position", "chunk")


class HashedWords:
    """An embedder without a model: words hashed to signed dimensions, weighted by the root of their counts, unit length.

    Stands where a trained encoder would; any callable from texts to a matrix can take its place."""

    def __init__(self, dims: int = 256) -> None:
        self.dims = dims

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            for w, n in Counter(re.findall(r"\w+", t.lower())).items():
                h = zlib.crc32(w.encode())
                out[i, (h >> 1) % self.dims] += (1 if h & 1 else -1) * n**0.5
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def semantic_each(documents: DataFrame, doc_id: str, title: Column, text: Column, queries: DataFrame, query_id: str, query_text: str, embed: Callable[[list[str]], np.ndarray], n: int) -> DataFrame:
    """query_id, doc_id, similarity, rank: the ``n`` best documents of every query by their best chunk.

    Chunks are made, embedded and pooled in their document's row, so nothing is over-fetched
    and no chunk is shuffled; a task hands on ``n`` documents a query. Similarities have six
    places; ties go to the smaller id. Documents without text have no chunk; NULL queries
    find nothing.
    """
    spark, found = documents.sparkSession, []
    rows = documents.select(F.col(doc_id), title.alias("__t"), text.alias("__x"))
    shape = f"query_id {_types(queries, query_id)}, {doc_id} {_types(documents, doc_id)}, similarity double"
    for part in _passes(queries.where(F.col(query_text).isNotNull()).select(query_id, query_text), query_id):
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in part]), embed([r[1] for r in part])))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, q = shared.value

            def blocks() -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
                for b in batches:
                    for at in range(0, len(b), 200):
                        held = b.iloc[at : at + 200]
                        chunks = [chunk_texts(t, x) for t, x in zip(held["__t"], held["__x"])]
                        many = np.array([len(c) for c in chunks])
                        if not many.sum() or not len(q):
                            continue
                        made, begin = embed([c for cs in chunks for c in cs]), np.concatenate([[0], np.cumsum(many)[:-1]])[many > 0]
                        step = max(1, SCORES // len(made))
                        for first in range(0, len(q), step):
                            s = np.round(made @ q[first : first + step].T, 6) + 0.0
                            yield held[doc_id].to_numpy()[many > 0], first, np.maximum.reduceat(s, begin, axis=0)

            which, ids, s = _top(n, len(names), blocks())
            yield pd.DataFrame({"query_id": names[which] if len(names) else [], doc_id: ids, "similarity": np.asarray(s, float)})

        found.append(rows.mapInPandas(run, shape))
    return _first(reduce(DataFrame.unionByName, found), n, "similarity", doc_id)
