"""Queries of indexing and retrieval: documents as chunks, benchmark items as queries, embeddings as dense vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import retrieval as R
from quillon.operators import stemming as N
from quillon.operators import weights as W
from quillon.plans import sql as S
from quillon.sources import files
from quillon.sources.tables import table

SWEEP = (1, 5, 10, 20, 40, 60)


def _chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("work_id"), "text")


def _corpus(spark, d):
    """The index of the documents, which the first query builds and the others read."""
    return R.Corpus(_chunks(spark, d), lambda name, build: files.kept(spark, name, [f"{d}/documents.parquet"], build))


def _items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def stem(spark, d):
    """Stems of the distinct tokens, worked out once each."""
    words = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return N.stems(words)


def _lexicon(spark, d):
    forms = table(spark, d, "part").select(F.explode(T.tokens(F.col("p_name"))).alias("form")).distinct()
    return N.stems(forms, "form", "lemma").withColumn("pos", F.lit("NOUN"))


def lemmatize(spark, d):
    """Lemma and part of speech from a lexicon table (part names stand for it); unknown forms are their own lemma."""
    lexicon = _lexicon(spark, d)
    forms = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    return forms.join(R.checked(lexicon), "form", "left").select("form", F.coalesce("lemma", "form").alias("lemma"), F.coalesce("pos", F.lit("X")).alias("pos"), "n")


def _stemmed(spark, d):
    return N.stem_lists(table(spark, d, "documents").select("doc_id", "text"), T.tokens(F.col("text")), "doc_id")


def normalize(spark, d):
    return _stemmed(spark, d).select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.md5(F.array_join("tokens.stem", " ")).alias("stems_md5"))


def bm25_text(spark, d):
    out = _stemmed(spark, d).select("doc_id", F.array_join("tokens.stem", " ").alias("s"))
    return out.select("doc_id", F.length("s").cast("bigint").alias("n_chars"), F.substring("s", 1, 80).alias("head"), F.md5("s").alias("md5"))


def bm25_doc_weights(spark, d):
    return _corpus(spark, d).posts.select("chunk_id", "term", *_r6("weight"))


def bm25_query_terms(spark, d):
    return W.query_terms(_items(spark, d))


def bm25_idf(spark, d):
    return _corpus(spark, d).idf.select("term", "df", *_r6("idf"))


def embed_dense(spark, d):
    return W.hashed_vectors(_chunks(spark, d), "chunk_id").select("chunk_id", "dim", *_r6("value"))


def point_id(spark, d):
    return table(spark, d, "documents").select("doc_id", T.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.concat(F.lit("chunk/"), F.col("doc_id").cast("string"))).alias("point_id"))


def sparse_topk(spark, d):
    return _corpus(spark, d).sparse(_items(spark, d), 10).select("query_id", "chunk_id", "rank", *_r6("score"))


def dense_topk(spark, d):
    """The vectors whose id is divisible by 100, against all."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    v = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return R.dense_topk(q, v, 10).select("query_id", "chunk_id", "rank", *_r6("score"))


def index_filter(spark, d):
    """Search restricted to one work: the vectors with the label of the query's own vector."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("v").alias("q"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z)
    cosine = F.coalesce(F.try_divide(dot("q", "v"), F.sqrt(dot("q", "q") * dot("v", "v"))), F.lit(0.0))  # 0 for a vector of zeros
    pairs = e.join(R.checked(q), "label").withColumn("score", cosine).withColumnRenamed("vec_id", "chunk_id")
    return R.top(pairs, 10).select("query_id", "chunk_id", "label", "rank", *_r6("score"))


def hits_payload(spark, d):
    hits = files.staged(_corpus(spark, d).sparse(_items(spark, d), 10), "hits")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "lang", "n_chars")
    return R.payload(hits, docs).select("query_id", "chunk_id", "rank", "source", "lang", "n_chars")


def rrf_fuse(spark, d):
    c, q = _corpus(spark, d), _items(spark, d)
    return R.rrf_fuse(c.sparse(q), c.hashed(q)).select("query_id", "chunk_id", "rank", *_r6("score"))


def topk_tiebreak(spark, d):
    """Ties decided by id: orders by customer at equal priority."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), F.substring("o_orderpriority", 1, 1).cast("double").alias("score"))
    return R.top(o, 3).select("query_id", "chunk_id", "rank", "score")


def fusion_bound(spark, d):
    """Chunks of both channels with their best channel rank and fused rank; ``worse`` where fusion ranks them lower."""
    c, q = _corpus(spark, d), _items(spark, d)
    s, h = c.sparse(q), c.hashed(q)
    s, h = files.staged(s, "sparse"), files.staged(h, "dense")
    best = s.select("query_id", "chunk_id", F.col("rank").alias("s")).join(h.select("query_id", "chunk_id", F.col("rank").alias("h")), ["query_id", "chunk_id"])
    f = R.rrf_fuse(s, h, limit=100).select("query_id", "chunk_id", "rank")
    return best.join(f.hint("merge"), ["query_id", "chunk_id"]).select("query_id", "chunk_id", F.least("s", "h").alias("best_rank"), "rank", (F.col("rank") > F.least("s", "h")).alias("worse"))


def rerank(spark, d):
    return _corpus(spark, d).retrieve(_items(spark, d), 5).select("query_id", "chunk_id", "rank", *_r6("rrf_score", "rerank_score"))


def retrieve(spark, d):
    hits = files.staged(_corpus(spark, d).retrieve(_items(spark, d), 3), "hits")
    return R.payload(hits, _chunks(spark, d).select("chunk_id", "work_id")).select("query_id", "chunk_id", "work_id", "rank", *_r6("rerank_score"))


def retrieve_batch(spark, d):
    q = R.keyword_and_full(table(spark, d, "benchmark"))
    hits = files.staged(_corpus(spark, d).retrieve(q.select("query_id", "text"), 10), "hits")
    return hits.join(q.select("query_id", "item_id", "style"), "query_id").select("item_id", "style", "rank", "chunk_id")


def retrieve_no_rerank(spark, d):
    return _corpus(spark, d).retrieve(_items(spark, d), 5, reranked=False).select("query_id", "chunk_id", "rank", *_r6("score"))


def retrieve_end_to_end(spark, d):
    hits = _corpus(spark, d).retrieve(_items(spark, d), 5)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"])
    return hits.groupBy("query_id").agg(F.array_join(ids, ",").alias("chunk_ids"), F.count("*").alias("n"))


def sweep_hits(spark, d, queries=None, limit=10):
    """``config, query_id, chunk_id, rank`` of the eight configurations; both channels are worked out once."""
    c = _corpus(spark, d)
    q = _items(spark, d) if queries is None else queries
    depth = max(50, 4 * limit)
    s, h = files.staged(c.sparse(q, depth), "sparse"), files.staged(c.hashed(q, depth), "dense")
    cols = ["query_id", "chunk_id", "rank"]
    out = h.where(F.col("rank") <= limit).select(F.lit("dense").alias("config"), *cols).unionByName(s.where(F.col("rank") <= limit).select(F.lit("sparse").alias("config"), *cols))
    for k in SWEEP:
        out = out.unionByName(R.rrf_fuse(s, h, k=k, limit=limit, prefetch=depth).select(F.lit(f"hybrid_k{k}").alias("config"), *cols))
    return out


def config_sweep(spark, d):
    return sweep_hits(spark, d)


def rerank_compare(spark, d):
    c, q = _corpus(spark, d), _items(spark, d)
    cols = ["query_id", "chunk_id", "rank"]
    return c.retrieve(q, 10, reranked=False).select(F.lit("hybrid").alias("config"), *cols).unionByName(c.retrieve(q, 10).select(F.lit("reranked").alias("config"), *cols))


def index_count_check(spark, d):
    """Works whose number of indexed chunks differs from their number of chunks; none should."""
    c = _chunks(spark, d)
    known = _corpus(spark, d).lists.select("chunk_id")
    indexed = c.select("chunk_id", "work_id").join(known.hint("merge"), "chunk_id").groupBy("work_id").agg(F.count("*").alias("n_indexed"))
    return c.groupBy("work_id").agg(F.count("*").alias("n_chunks")).join(indexed.hint("merge"), "work_id", "full").select("work_id", "n_chunks", F.coalesce("n_indexed", F.lit(0)).alias("n_indexed"))


QUERIES = {f.__name__: f for f in (tokenize, stem, lemmatize, normalize, bm25_text, bm25_doc_weights, bm25_query_terms, bm25_idf, embed_dense, point_id, sparse_topk, dense_topk, index_filter, hits_payload, rrf_fuse, topk_tiebreak, fusion_bound, rerank, retrieve, retrieve_batch, retrieve_no_rerank, retrieve_end_to_end, config_sweep, rerank_compare, index_count_check)}

_CH = S.channels(S.ITEMS)
_TOK = S.tokens("text")
_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_DENSE = f"SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0"


def _retrieved(limit: int, queries: str = S.ITEMS) -> str:
    return f"WITH {S.channels(queries)}, pool AS ({S.ranked(S.fused(), max(limit, 15))}), {S.RERANK}, out AS ({S.ranked('scored', limit, 'rerank_score')})"


ORACLES = {
    "tokenize": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_TOK} AS t FROM documents)",
    "stem": f"WITH w AS (SELECT unnest({_TOK}) AS token FROM documents) SELECT token, stem, count(*) AS n FROM w JOIN {S.stems('w')} USING (token) GROUP BY ALL",
    "lemmatize": f"WITH w AS (SELECT unnest({S.tokens('p_name')}) AS token FROM part), lex AS {S.stems('w')}, f AS (SELECT form, count(*) AS n FROM (SELECT unnest({_TOK}) AS form FROM documents) GROUP BY form) SELECT f.form, coalesce(stem, f.form) AS lemma, CASE WHEN token IS NULL THEN 'X' ELSE 'NOUN' END AS pos, n FROM f LEFT JOIN lex ON f.form = token",
    "normalize": f"WITH {S.stem_lists()} SELECT doc_id, n, md5(s) AS stems_md5 FROM lists",
    "bm25_text": f"WITH {S.stem_lists()} SELECT doc_id, length(s) AS n_chars, substr(s, 1, 80) AS head, md5(s) AS md5 FROM lists",
    "bm25_doc_weights": f"WITH {S.POSTINGS} SELECT chunk_id, term, round(weight, 6) AS weight FROM posts",
    "bm25_query_terms": f"WITH w AS (SELECT query_id, unnest({_TOK}) AS token FROM {S.ITEMS}) SELECT DISTINCT query_id, stem AS term, CAST(1.0 AS DOUBLE) AS weight FROM w JOIN {S.stems('w')} USING (token)",
    "bm25_idf": f"WITH {S.POSTINGS} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "embed_dense": f"WITH {_CH} SELECT chunk_id, dim, round(v, 6) AS value FROM hvn",
    "point_id": "SELECT doc_id, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || ['8', '9', 'a', 'b'][('0x' || substr(x, 17, 1))::BIGINT % 4 + 1] || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS point_id FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk/' || CAST(doc_id AS VARCHAR))) AS x FROM documents)",
    "sparse_topk": f"WITH {_CH} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM sparse WHERE rank <= 10",
    "dense_topk": f"WITH s AS ({_DENSE}) SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ({S.ranked('s', 10)})",
    "index_filter": f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, b.label, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0) SELECT query_id, chunk_id, label, rank, round(score, 6) AS score FROM ({S.ranked('s', 10)})",
    "hits_payload": f"WITH {_CH} SELECT query_id, chunk_id, rank, source, lang, n_chars FROM sparse JOIN documents ON doc_id = chunk_id WHERE rank <= 10",
    "rrf_fuse": f"WITH {_CH} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ({S.ranked(S.fused(), 10)})",
    "topk_tiebreak": f"WITH s AS (SELECT o_custkey AS query_id, o_orderkey AS chunk_id, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS score FROM orders) {S.ranked('s', 3)}",
    "fusion_bound": f"WITH {_CH}, f AS ({S.ranked(S.fused(), 100)}) SELECT f.query_id, f.chunk_id, least(sparse.rank, dense.rank) AS best_rank, f.rank, f.rank > least(sparse.rank, dense.rank) AS worse FROM f JOIN sparse USING (query_id, chunk_id) JOIN dense USING (query_id, chunk_id)",
    "rerank": f"{_retrieved(5)} SELECT query_id, chunk_id, rank, round(rrf_score, 6) AS rrf_score, round(rerank_score, 6) AS rerank_score FROM out",
    "retrieve": f"{_retrieved(3)} SELECT query_id, chunk_id, source AS work_id, rank, round(rerank_score, 6) AS rerank_score FROM out JOIN documents ON doc_id = chunk_id",
    "retrieve_batch": f"{_retrieved(10, S.STYLED)} SELECT item_id, style, rank, chunk_id FROM out JOIN {S.STYLED} q USING (query_id)",
    "retrieve_no_rerank": f"WITH {_CH} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM ({S.ranked(S.fused(), 5)})",
    "retrieve_end_to_end": f"{_retrieved(5)} SELECT query_id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank) AS chunk_ids, count(*) AS n FROM out GROUP BY query_id",
    "config_sweep": f"WITH {_CH} SELECT 'dense' AS config, query_id, chunk_id, rank FROM dense WHERE rank <= 10 UNION ALL SELECT 'sparse', query_id, chunk_id, rank FROM sparse WHERE rank <= 10" + "".join(f" UNION ALL SELECT 'hybrid_k{k}', query_id, chunk_id, rank FROM ({S.ranked(S.fused(k), 10)})" for k in SWEEP),
    "rerank_compare": f"{_retrieved(10)}, plain AS ({S.ranked(S.fused(), 10)}) SELECT 'hybrid' AS config, query_id, chunk_id, rank FROM plain UNION ALL SELECT 'reranked', query_id, chunk_id, rank FROM out",
    "index_count_check": f"SELECT source AS work_id, count(*) AS n_chunks, CAST(sum(CASE WHEN len({_TOK}) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_indexed FROM documents GROUP BY source",
}
