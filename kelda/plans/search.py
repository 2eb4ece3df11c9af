"""Search over documents and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kelda.functions.text import count_tokens, matched_terms
from kelda.operators.retrieval import HashedWords, bm25, bm25_lists, bm25_each, chunk, cosine, fuse, hybrid, hybrid_each, max_pool, max_pool_each, nearest, nearest_each, postings, ranked, semantic_each, theme, two_pole
from kelda.plans.notices import TERMS, WORD
from kelda.plans.registry import Catalog
from kelda.sources.tables import table

catalog = Catalog()

QUERY = "network security audit network"
_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


def bm25_sql(query: str, k: int) -> str:
    terms = {t: query.split().count(t) for t in dict.fromkeys(query.split())}
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"{n} * ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.5 / (tf{i} + 1.5 * (0.25 + 0.75 * len / avgdl))" for i, n in enumerate(terms.values()))
    return f"""SELECT doc_id, score FROM (SELECT doc_id, round({score}, 6) AS score FROM
      (SELECT doc_id, len(w) AS len, {tf} FROM (SELECT doc_id, {_TOKENS} AS w FROM documents)) c,
      (SELECT count(*) AS n, avg(len) AS avgdl, {df} FROM (SELECT len(w) AS len, {tf} FROM (SELECT {_TOKENS} AS w FROM documents))) s)
    WHERE score > 0 ORDER BY score DESC, doc_id LIMIT {k}"""


_DOT = "list_dot_product(CAST(%s AS DOUBLE[]), CAST(%s AS DOUBLE[]))"
_COS = f"round({_DOT % ('v.embedding', 'q.embedding')} / (sqrt({_DOT % ('v.embedding', 'v.embedding')}) * sqrt({_DOT % ('q.embedding', 'q.embedding')})), 6)"
_QUERY_ID = 7


def _query_vector(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where(F.col("vec_id") == _QUERY_ID)


def _with_query(spark: SparkSession, d: str) -> DataFrame:
    """Vectors beside the query's one row."""
    q = _query_vector(spark, d).limit(1).select(F.col("embedding").alias("q"))
    return table(spark, d, "embeddings").join(F.broadcast(q))


@catalog.query("term_counts", f"SELECT term, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_documents FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term ORDER BY n_tokens DESC, term LIMIT 50")
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    """The commonest words: counted per document first, so the shuffle carries counts."""
    p = postings(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return p.groupBy("term").agg(F.sum("tf").alias("n_tokens"), F.count("*").alias("n_documents")).orderBy(F.col("n_tokens").desc(), "term").limit(50)


@catalog.query("bm25_topk", bm25_sql(QUERY, 20))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", QUERY, 20)


@catalog.query(
    "cosine_topk",
    f"""SELECT vec_id, similarity, round(1 / (2 - similarity), 6) AS score FROM (SELECT v.vec_id, {_COS} AS similarity FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = {_QUERY_ID}) q) ORDER BY similarity DESC, vec_id LIMIT 20""",
)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return nearest(_with_query(spark, d), "vec_id", "embedding", F.col("q"), 20)


@catalog.query(
    "similar_excluding_self",
    f"""SELECT vec_id, similarity, round(1 / (2 - similarity), 6) AS score FROM (SELECT v.vec_id, {_COS} AS similarity FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = {_QUERY_ID}) q WHERE v.vec_id <> {_QUERY_ID}) ORDER BY similarity DESC, vec_id LIMIT 10""",
)
def similar_excluding_self(spark: SparkSession, d: str) -> DataFrame:
    return nearest(_with_query(spark, d), "vec_id", "embedding", F.col("q"), 10, exclude=F.col("vec_id") == _QUERY_ID)


@catalog.query(
    "chunk_max_pool",
    f"""SELECT label, max(score) AS score FROM (SELECT v.label, round(1 / (2 - {_COS}), 6) AS score FROM embeddings v, (SELECT embedding, label FROM embeddings WHERE vec_id = {_QUERY_ID}) q WHERE v.label <> q.label) GROUP BY label""",
)
def chunk_max_pool(spark: SparkSession, d: str) -> DataFrame:
    """Best chunk of each parent, the query's parent left out whole."""
    q = _query_vector(spark, d).limit(1).select(F.col("embedding").alias("q"), F.col("label").alias("own"))
    rows = table(spark, d, "embeddings").join(F.broadcast(q))
    scored = rows.withColumn("score", F.round(1 / (2 - F.round(cosine(F.col("embedding"), F.col("q")), 6)), 6))
    return max_pool(scored, "label", "score", exclude=F.col("label") == F.col("own"))


@catalog.query(
    "rank_fusion",
    f"""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({bm25_sql(QUERY, 30)})), b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({bm25_sql('cloud hosting', 30)}))
    SELECT doc_id, round(sum(1.0 / (60 + r)), 8) AS fused, count(*) AS n_lists FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id ORDER BY fused DESC, doc_id LIMIT 20""",
)
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two ranked lists of thirty, out of one scan, fused by reciprocal ranks."""
    documents = table(spark, d, "documents", "doc_id", "text")
    lists = [ranked(x, [F.col("score").desc(), F.col("doc_id")]) for x in bm25_lists(documents, "doc_id", "text", [QUERY, "cloud hosting"], 30)]
    return fuse(lists, "doc_id").orderBy(F.col("fused").desc(), "doc_id").limit(20)


_THEME = """(SELECT list(m ORDER BY p) AS t FROM (SELECT p, avg(x / n) AS m FROM (SELECT unnest(range(1, 65)) AS p, unnest(CAST(embedding AS DOUBLE[])) AS x, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings WHERE %s) GROUP BY p))"""
_C = "list_dot_product(CAST(v.embedding AS DOUBLE[]), {0}.t) / (sqrt(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_dot_product({0}.t, {0}.t)))"


@catalog.query("two_pole_scores", f"SELECT v.vec_id, round({_C.format('a')} - {_C.format('b')}, 4) + 0.0 AS pole FROM embeddings v, {_THEME % 'label < 3'} a, {_THEME % 'label > 6'} b")
def two_pole_scores(spark: SparkSession, d: str) -> DataFrame:
    """Nearness to one theme less nearness to another, a theme being the mean direction of examples."""
    v = table(spark, d, "embeddings")
    return two_pole(v, "embedding", theme(v.where("label < 3"), "embedding"), theme(v.where("label > 6"), "embedding")).select("vec_id", "pole")


@catalog.query("snippets", r"SELECT doc_id, trim(replace(left(text, 300), chr(10), ' ')) || '...' AS snippet FROM documents WHERE text IS NOT NULL AND text <> ''")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL AND text <> ''")
    return rows.select("doc_id", F.concat(F.trim(F.translate(F.left("text", F.lit(300)), "\n", " ")), F.lit("...")).alias("snippet"))


@catalog.query("document_lengths", f"SELECT doc_id, len({_TOKENS}) AS n_tokens FROM documents")
def document_lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", count_tokens("text").cast("bigint").alias("n_tokens"))


@catalog.query("document_chunks")
def document_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every document with their kind and source as title; tested against a plain loop."""
    rows = table(spark, d, "documents", "doc_id", "text", "doc_kind", "source")
    return chunk(rows, "doc_id", F.concat_ws(" ", "doc_kind", "source"), F.col("text"))


@catalog.query("semantic_search_each")
def semantic_search_each(spark: SparkSession, d: str) -> DataFrame:
    """For the first 100 characters of every document whose id is divisible by 100 the ten best documents by their best chunk; tested against brute force."""
    rows = table(spark, d, "documents", "doc_id", "text", "doc_kind", "source")
    queries = rows.where((F.col("doc_id") % 100 == 0) & (F.trim("text") != "")).groupBy(F.col("doc_id").alias("asked")).agg(F.min(F.left("text", F.lit(100))).alias("words"))
    return semantic_each(rows, "doc_id", F.concat_ws(" ", "doc_kind", "source"), F.col("text"), queries, "asked", "words", HashedWords(), 10)


@catalog.query(
    "keyword_documents",
    "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(coalesce(text, '')), '{WORD % t}') THEN '{t}' END" for t in TERMS) + "], lambda x: x IS NOT NULL), ';') AS terms FROM documents",
)
def keyword_documents(spark: SparkSession, d: str) -> DataFrame:
    """Terms that every whole document holds as words."""
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.array_join(matched_terms("text", TERMS), ";").alias("terms"))


@catalog.query(
    "boilerplate_spread",
    """SELECT md5(text) AS digest, count(*) AS n_documents, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY text HAVING count(*) > 1""",
)
def boilerplate_spread(spark: SparkSession, d: str) -> DataFrame:
    """Texts that several documents share: grouped by digest, so that texts aren't shuffled."""
    rows = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL AND text <> ''")
    return rows.select("doc_id", F.md5("text").alias("digest")).groupBy("digest").agg(F.count("*").alias("n_documents"), F.min("doc_id").alias("first_doc")).where("n_documents > 1")


@catalog.query(
    "hybrid_search",
    f"""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({bm25_sql('cloud hosting', 30)})),
    n AS (SELECT vec_id, similarity FROM (SELECT v.vec_id, {_COS} AS similarity FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = {_QUERY_ID}) q) ORDER BY similarity DESC, vec_id LIMIT 30),
    b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY similarity DESC, vec_id) AS r FROM n)
    SELECT doc_id, round(sum(1.0 / (60 + r)), 8) AS fused, count(*) AS n_lists FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id ORDER BY fused DESC, doc_id LIMIT 10""",
)
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return hybrid(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", _with_query(spark, d), "vec_id", "embedding", "cloud hosting", F.col("q"), 10)


# Sets of queries: the ids divisible by a hundred; a document asks with its opening.
_ASKING = "SELECT vec_id, embedding, label FROM embeddings WHERE mod(vec_id, 100) = 0"
_PAIRS = f"(SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS similarity FROM embeddings v, ({_ASKING}) q %s)"


def nearest_each_sql(k: int, where: str = "") -> str:
    return f"SELECT query_id, vec_id, similarity, round(1 / (2 - similarity), 6) AS score FROM {_PAIRS % where} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) <= {k}"


def bm25_each_sql(k: int) -> str:
    asked = _TOKENS.replace("coalesce(text, '')", "left(coalesce(text, ''), 100)")
    return f"""WITH w AS (SELECT doc_id, {_TOKENS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w),
    q AS (SELECT query_id, term, count(*) AS m FROM (SELECT doc_id AS query_id, unnest({asked}) AS term FROM documents WHERE doc_id % 100 = 0) GROUP BY ALL),
    p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM w) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    r AS (SELECT query_id, doc_id, round(sum(m * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN w USING (doc_id), s GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, score FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= {k}"""


def _nearest_each(spark: SparkSession, d: str, k: int, exclude_self: bool = False) -> DataFrame:
    v = table(spark, d, "embeddings")
    return nearest_each(v, "vec_id", "embedding", v.where("vec_id % 100 = 0"), "vec_id", "embedding", k, exclude_self)


def _bm25_each(spark: SparkSession, d: str, k: int) -> DataFrame:
    rows = table(spark, d, "documents", "doc_id", "text")
    return bm25_each(rows, "doc_id", "text", rows.where("doc_id % 100 = 0").select("doc_id", F.left("text", F.lit(100)).alias("asked")), "doc_id", "asked", k)


@catalog.query("cosine_topk_each", nearest_each_sql(20))
def cosine_topk_each(spark: SparkSession, d: str) -> DataFrame:
    return _nearest_each(spark, d, 20).drop("rank")


@catalog.query("similar_excluding_self_each", nearest_each_sql(10, "WHERE v.vec_id <> q.vec_id"))
def similar_excluding_self_each(spark: SparkSession, d: str) -> DataFrame:
    return _nearest_each(spark, d, 10, exclude_self=True).drop("rank")


@catalog.query("chunk_max_pool_each", f"SELECT query_id, label, max(round(1 / (2 - similarity), 6)) AS score FROM (SELECT q.vec_id AS query_id, v.label, {_COS} AS similarity FROM embeddings v, ({_ASKING}) q WHERE v.label <> q.label) GROUP BY query_id, label")
def chunk_max_pool_each(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return max_pool_each(v, "label", "embedding", v.where("vec_id % 100 = 0"), "vec_id", "embedding", "label")


@catalog.query("bm25_topk_each", bm25_each_sql(20))
def bm25_topk_each(spark: SparkSession, d: str) -> DataFrame:
    return _bm25_each(spark, d, 20).drop("rank")


@catalog.query(
    "hybrid_search_each",
    f"""WITH a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM ({bm25_each_sql(30)})),
    b AS (SELECT query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM ({nearest_each_sql(30)})),
    f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + r)), 8) AS fused, count(*) AS n_lists FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY query_id, doc_id)
    SELECT query_id, doc_id, fused, n_lists FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) <= 10""",
)
def hybrid_search_each(spark: SparkSession, d: str) -> DataFrame:
    near = _nearest_each(spark, d, 30).withColumnRenamed("vec_id", "doc_id")
    return hybrid_each(_bm25_each(spark, d, 30), near, "doc_id", 10)
