"""Queries of evidence signals and prompts: orders stand for evidence sets, their lines for retrieved chunks, suppliers for works."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import signals as G
from quillon.operators.history import tier_of
from quillon.sources.tables import table


def _evidence(spark, d):
    """Every third line wasn't reranked; every fourth was judged; vectors are missing for some parts: two ids in seven lie past them."""
    l = table(spark, d, "lineitem")
    n_ids = max(table(spark, d, "embeddings").count() * 7 // 5, 1)
    return l.select(
        F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % n_ids).alias("chunk_id"),
        F.concat(F.lit("w"), (F.col("l_suppkey") % 4).cast("string")).alias("work_id"),
        F.when(F.col("l_partkey") % 3 != 0, F.round(F.col("l_discount") * 8, 6)).alias("rerank_score"),
        F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("avis "), F.col("l_linenumber").cast("string"))).alias("judgment"),
        F.col("l_partkey"), F.col("l_returnflag").alias("path"), F.col("l_linenumber").cast("string").alias("pages"),
    )


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def distinct_works(spark, d):
    return G.works_of(_evidence(spark, d)).withColumn("works", F.array_join("works", ","))


def convergence(spark, d):
    return G.convergence(_evidence(spark, d), _vectors(spark, d)).select("set_id", F.round("convergence", 6).alias("convergence"))


def is_convergent(spark, d):
    c = _evidence(spark, d).select("set_id").distinct().join(G.convergence(_evidence(spark, d), _vectors(spark, d)).hint("merge"), "set_id", "left")
    return c.select("set_id", G.is_convergent(F.col("convergence")).alias("is_convergent"))


def max_rerank(spark, d):
    return _evidence(spark, d).groupBy("set_id").agg(F.max("rerank_score").alias("max_rerank"))


def confidence_tier(spark, d):
    return max_rerank(spark, d).select("set_id", tier_of(F.col("max_rerank")).alias("tier"))


def is_confident(spark, d):
    return confidence_tier(spark, d).select("set_id", F.col("tier").isin(*G.CONFIDENT).alias("is_confident"))


def gauge_level(spark, d):
    return confidence_tier(spark, d).select("set_id", G.gauge(F.col("tier")).cast("bigint").alias("level"))


def evidence_signals(spark, d):
    return G.signals(_evidence(spark, d), _vectors(spark, d)).withColumns({"works": F.array_join("works", ","), "convergence": F.round("convergence", 6)})


def _toggles(spark, d):
    return table(spark, d, "events").where("event_type in ('click', 'view')").select((F.col("user_id") * 5).alias("set_id"), (F.regexp_extract("props", "[0-9]+", 0).cast("int") % 4 + 1).alias("pos"))


def include_filter(spark, d):
    e = _evidence(spark, d).select("set_id", "pos").join(G.included(_toggles(spark, d), ["set_id", "pos"]), ["set_id", "pos"], "left")
    return e.select("set_id", "pos", F.coalesce("included", F.lit(True)).alias("included"))


def confidence_preview(spark, d):
    """Tiers over the entries that are still in."""
    e = _evidence(spark, d).join(include_filter(spark, d), ["set_id", "pos"]).where("included")
    return e.groupBy("set_id").agg(F.max("rerank_score").alias("m")).select("set_id", tier_of(F.col("m")).alias("tier"))


def _blocks(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("text"))
    e = _evidence(spark, d).join(parts, "l_partkey")
    return e.select("set_id", "pos", "work_id", G.evidence_block(F.col("chunk_id").cast("string"), F.col("work_id"), F.col("path"), F.col("pages"), F.col("text"), F.col("judgment")).alias("block"))


def evidence_block(spark, d):
    return _blocks(spark, d)


def evidence_group(spark, d):
    return G.evidence_text(_blocks(spark, d))


def _instructed(spark, d):
    judged = _evidence(spark, d).groupBy("set_id").agg((F.count("judgment") > 0).alias("judged"))
    s = G.signals(_evidence(spark, d), _vectors(spark, d)).join(judged.hint("merge"), "set_id")
    return s.select("set_id", G.instructions(F.col("is_multi_work"), F.col("is_convergent"), F.col("is_confident"), F.col("judged")).alias("instructions"))


def instruction_select(spark, d):
    return _instructed(spark, d)


def build_prompt(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("set_id"), F.concat(F.lit("Que dit "), F.col("o_orderpriority"), F.lit(" ?")).alias("question"))
    p = _instructed(spark, d).join(evidence_group(spark, d).hint("merge"), "set_id").join(o.hint("merge"), "set_id")
    return p.select("set_id", G.prompt(F.col("instructions"), F.col("evidence"), F.col("question")).alias("prompt"))


def judge_prompt(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    n_items = max(b.count(), 1)
    docs = table(spark, d, "documents").select("doc_id", F.pmod("doc_id", F.lit(n_items)).alias("item_id"), F.col("text").alias("passage"))
    return docs.join(b, "item_id").select("doc_id", "item_id", G.judge_prompt(F.col("question"), F.col("passage")).alias("prompt"))


QUERIES = {f.__name__: f for f in (distinct_works, convergence, is_convergent, max_rerank, confidence_tier, is_confident, gauge_level, evidence_signals, include_filter, confidence_preview, evidence_block, evidence_group, instruction_select, build_prompt, judge_prompt)}

_T = {k: v.replace("'", "''") for k, v in G.TEMPLATES.items()}
_TIER = "CASE WHEN {0} IS NULL THEN 'moyenne' WHEN {0} < 0.28 THEN 'très faible' WHEN {0} < 0.42 THEN 'faible' WHEN {0} < 0.55 THEN 'moyenne' ELSE 'élevée' END"
_E = f"""ev AS (SELECT l_orderkey AS set_id, l_linenumber AS pos, l_partkey % (SELECT greatest(count(*) * 7 // 5, 1) FROM embeddings) AS chunk_id, 'w' || CAST(l_suppkey % 4 AS VARCHAR) AS work_id, CASE WHEN l_partkey % 3 <> 0 THEN round(l_discount * 8, 6) END AS rerank_score,
 CASE WHEN l_partkey % 4 = 0 THEN 'avis ' || CAST(l_linenumber AS VARCHAR) END AS judgment, l_partkey, l_returnflag AS path, CAST(l_linenumber AS VARCHAR) AS pages, row_number() OVER () AS rid FROM lineitem),
vx AS (SELECT ev.*, CAST(embedding AS DOUBLE[]) AS v FROM ev JOIN embeddings ON vec_id = chunk_id),
cv AS (SELECT a.set_id, avg(list_cosine_similarity(a.v, b.v)) AS convergence FROM vx a JOIN vx b ON a.set_id = b.set_id AND a.rid < b.rid GROUP BY a.set_id),
s AS (SELECT set_id, string_agg(DISTINCT work_id, ',' ORDER BY work_id) AS works, count(DISTINCT work_id) AS num_works, count(DISTINCT work_id) > 1 AS is_multi_work, max(rerank_score) AS max_rerank, count(judgment) > 0 AS judged FROM ev GROUP BY set_id),
sg AS (SELECT s.*, round(convergence, 6) AS convergence, coalesce(round(convergence, 9) >= 0.55, true) AS is_convergent, {_TIER.format('max_rerank')} AS tier FROM s LEFT JOIN cv ON cv.set_id = s.set_id),
tg AS (SELECT user_id * 5 AS set_id, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 4 + 1 AS pos, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL),
inc AS (SELECT ev.set_id, ev.pos, coalesce(n % 2 = 0, true) AS included, rerank_score FROM ev LEFT JOIN tg ON tg.set_id = ev.set_id AND tg.pos = ev.pos),
bl AS (SELECT set_id, pos, work_id, '[' || CAST(chunk_id AS VARCHAR) || '] (' || work_id || ', ' || path || ', p. ' || pages || ')' || chr(10) || p_name || CASE WHEN judgment IS NULL THEN '' ELSE chr(10) || '(avis: ' || judgment || ')' END AS block FROM ev JOIN part ON p_partkey = l_partkey),
bw AS (SELECT set_id, work_id, string_agg(block, chr(10) || chr(10) ORDER BY pos, block) AS body FROM bl GROUP BY ALL),
eg AS (SELECT set_id, CASE WHEN count(*) > 1 THEN string_agg('=== ' || work_id || ' ===' || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY work_id) ELSE min(body) END AS evidence FROM bw GROUP BY set_id),
ins AS (SELECT set_id, '{_T['cite']}' || chr(10) || '{_T['frame']}' || chr(10) || CASE WHEN NOT is_multi_work THEN '{_T['one_work']}' WHEN is_convergent THEN '{_T['converging']}' ELSE '{_T['diverging']}' END
 || CASE WHEN tier IN ('moyenne', 'élevée') THEN '' ELSE chr(10) || '{_T['caution']}' END || CASE WHEN judged THEN chr(10) || '{_T['judged']}' ELSE '' END AS instructions FROM sg)"""
_NN = "chr(10) || chr(10)"
ORACLES = {
    "distinct_works": f"WITH {_E} SELECT set_id, works, num_works, is_multi_work FROM s",
    "convergence": f"WITH {_E} SELECT set_id, round(convergence, 6) AS convergence FROM cv",
    "is_convergent": f"WITH {_E} SELECT set_id, is_convergent FROM sg",
    "max_rerank": f"WITH {_E} SELECT set_id, max_rerank FROM s",
    "confidence_tier": f"WITH {_E} SELECT set_id, tier FROM sg",
    "is_confident": f"WITH {_E} SELECT set_id, tier IN ('moyenne', 'élevée') AS is_confident FROM sg",
    "gauge_level": f"WITH {_E} SELECT set_id, CAST(list_position(['très faible', 'faible', 'moyenne', 'élevée'], tier) AS BIGINT) AS level FROM sg",
    "evidence_signals": f"WITH {_E} SELECT set_id, works, num_works, is_multi_work, max_rerank, convergence, tier, is_convergent, tier IN ('moyenne', 'élevée') AS is_confident FROM sg",
    "include_filter": f"WITH {_E} SELECT set_id, pos, included FROM inc",
    "confidence_preview": f"WITH {_E} SELECT set_id, {_TIER.format('max(rerank_score)')} AS tier FROM inc WHERE included GROUP BY set_id",
    "evidence_block": f"WITH {_E} SELECT * FROM bl",
    "evidence_group": f"WITH {_E} SELECT * FROM eg",
    "instruction_select": f"WITH {_E} SELECT * FROM ins",
    "build_prompt": f"WITH {_E} SELECT set_id, '{_T['instructions']}' || {_NN} || instructions || {_NN} || '{_T['evidence']}' || {_NN} || evidence || {_NN} || '{_T['question']}' || {_NN} || 'Que dit ' || o_orderpriority || ' ?' AS prompt FROM ins JOIN eg USING (set_id) JOIN orders ON o_orderkey = set_id",
    "judge_prompt": f"SELECT doc_id, item_id, 'L''extrait répond-il à la question ? Réponds en JSON: label, justification.' || {_NN} || 'Question: ' || b.text || {_NN} || 'Extrait: ' || d.text AS prompt FROM documents d JOIN benchmark b ON item_id = doc_id % (SELECT greatest(count(*), 1) FROM benchmark)",
}
