"""Queries of conversation history: conversations and turns as they are, events as logs of updates, orders as children of customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import history as H
from quillon.operators.ranks import ranked
from quillon.sources import files
from quillon.sources.keyed import KeyedTable
from quillon.sources.tables import table


def _conv(spark, d):
    return table(spark, d, "conversations")


def _turns(spark, d):
    return _conv(spark, d).where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("turn_id"), F.col("conv_id").alias("conversation_id"), F.col("text").alias("query"))


def _conversations(spark, d):
    return _conv(spark, d).select(F.col("conv_id").alias("conversation_id")).distinct()


def _generations(spark, d):
    return _conv(spark, d).where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("generation_id"), (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("turn_id"), F.col("text").alias("answer"))


def _events(spark, d):
    return table(spark, d, "events").withColumn("k", F.regexp_extract("props", r"[0-9]+", 0).cast("bigint"))


def _judgments(spark, d):
    return _events(spark, d).select("event_id", F.col("user_id").alias("turn_id"), F.col("k").alias("chunk_id"), F.col("event_type").alias("label"), "value")


def turn_resolve(spark, d):
    e = _events(spark, d)
    turn = F.when(F.col("event_type") == "click", F.col("user_id") * 1000 + F.col("k") % 4)
    conv = F.when(F.col("event_type") == "view", F.col("user_id"))
    return H.resolve_turns(e.select(F.col("event_id").alias("request_id"), turn.alias("turn_id"), conv.alias("conversation_id")), _turns(spark, d), _conversations(spark, d))


def retrieved_replace(spark, d):
    """Views are the old sets of evidence, signups the new ones, ranks from 0, null scores 0.0."""
    e = _events(spark, d).select(F.col("user_id").alias("turn_id"), "event_id", "event_type", F.when(F.col("k") % 10 != 0, F.col("value")).alias("score"))
    sets = files.in_order(e.where(F.col("event_type").isin("view", "signup")), ["turn_id", "event_type"], ["event_id"])
    sets = sets.select("turn_id", F.col("event_id").alias("chunk_id"), "event_type", (F.col("rank") - 1).alias("rank0"), F.coalesce("score", F.lit(0.0)).alias("score"))
    part = lambda kind: sets.where(F.col("event_type") == kind).drop("event_type")
    return H.replaced(part("view"), part("signup"), "turn_id")


def _in_two_parts(spark, name, rows, keys, order):
    """A keyed table that got its rows in two upserts, the later half of the events after the earlier one."""
    rows = files.staged(rows, name)
    half = rows.agg(F.floor(F.avg(order))).first()[0] or 0
    kept = KeyedTable.create(spark, files.scratch(spark, f"{name}-table"), rows.schema, keys)
    kept.upsert(rows.where(F.col(order) <= half), order)
    kept.upsert(rows.where(F.col(order) > half), order)
    return kept.read()


def judgment_upsert(spark, d):
    return _in_two_parts(spark, "judgments", _judgments(spark, d).select("turn_id", "chunk_id", "label", "event_id"), ["turn_id", "chunk_id"], "event_id")


def _latest_judgments(spark, d):
    return files.latest(_judgments(spark, d), ["turn_id", "chunk_id"], "event_id").select("turn_id", "chunk_id", "label", "event_id")


def judgment_load(spark, d):
    j = _latest_judgments(spark, d).groupBy("turn_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_id", "label")))).alias("judgments"))
    shown = F.array_join(F.transform(F.array_sort(F.map_keys("judgments")), lambda c: F.concat(c.cast("string"), F.lit("="), F.col("judgments")[c])), ",")
    return j.select("turn_id", F.size("judgments").cast("bigint").alias("n"), shown.alias("judgments"))


def judgment_default(spark, d):
    """Whose judgments a request uses: its own map, even empty; else the turn's stored ones, null if there are none."""
    stored = _latest_judgments(spark, d).groupBy("turn_id").agg(F.count("*").alias("n_stored"))
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 2).alias("n_given"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("turn_id"))
    j = o.join(stored, "turn_id", "left")
    return j.select("o_orderkey", F.when(F.col("n_given").isNotNull(), "given").when(F.col("n_stored").isNotNull(), "stored").otherwise("none").alias("used"), F.coalesce("n_given", "n_stored").alias("n"))


def generation_append(spark, d):
    """Orders as generations of customers that exist; the tier follows from the best score among the parts used."""
    best = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.col("l_discount") * 8).alias("best"))
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("c_custkey"))
    kept = H.with_parent(o, table(spark, d, "customer"), "c_custkey")
    return kept.join(best, "o_orderkey", "left").select("o_orderkey", "c_custkey", H.tier_of(F.round("best", 6)).alias("tier"))


def evaluation_upsert(spark, d):
    rows = _events(spark, d).select((F.col("user_id") * 11).alias("c_custkey"), "event_id", "value")
    return _in_two_parts(spark, "evaluations", H.with_parent(rows, table(spark, d, "customer"), "c_custkey"), ["c_custkey"], "event_id")


def evaluate_pending(spark, d):
    """Orders none of whose lines came back yet: the ones still to be looked at."""
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(done, "o_orderkey", "left_anti")


def _stored(spark, d):
    """Orders' parts in line order with a score, some scores missing, some parts unknown."""
    l = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), (F.col("l_partkey") * 2).alias("chunk_id"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")).alias("score"))
    return l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("line", "chunk_id", "score"))).alias("stored"))


def generation_evidence(spark, d):
    rows = _stored(spark, d).select("l_orderkey", F.posexplode("stored").alias("pos", "s")).select("l_orderkey", F.col("pos").cast("bigint").alias("pos"), F.col("s.chunk_id").alias("chunk_id"), F.col("s.score").alias("score"))
    return rows.join(table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("text")).hint("merge"), "chunk_id", "left")


def chunk_rehydrate(spark, d):
    """The same with missing payloads dropped, and null scores as 0.0."""
    return generation_evidence(spark, d).where("text is not null").withColumn("score", F.coalesce("score", F.lit(0.0)))


def point_lookup(spark, d):
    """Payloads in the order that ids were given, missing ids dropped."""
    return files.in_order(generation_evidence(spark, d).where("text is not null"), ["l_orderkey"], ["pos"], "place").select("l_orderkey", "place", "chunk_id", "text")


def vector_lookup(spark, d):
    """Vectors of the ids that are asked for, whole, a row for each component."""
    wanted = table(spark, d, "events").select(F.col("user_id").alias("vec_id")).distinct()
    found = table(spark, d, "embeddings").select("vec_id", "embedding").join(wanted, "vec_id", "left_semi")
    return found.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.col("x").cast("double").alias("x"))


def turn_generations(spark, d):
    g = _generations(spark, d)
    return files.in_order(g, ["turn_id"], ["generation_id"], "place").select("turn_id", "generation_id", "place")


def turn_retrieved(spark, d):
    return files.in_order(retrieved_replace(spark, d), ["turn_id"], ["rank0"], "place").select("turn_id", "chunk_id", "place")


def conversation_turns(spark, d):
    return files.in_order(_turns(spark, d), ["conversation_id"], ["turn_id"], "place")


def lookup_or_reject(spark, d):
    ids = _events(spark, d).select("event_id", (F.col("user_id") * 1000).alias("turn_id"))
    return H.found_or_rejected(ids, _turns(spark, d), "turn_id").select("event_id", "turn_id", "found")


def first_query(spark, d):
    return H.first_of(_turns(spark, d), "conversation_id", "query", "turn_id", "first_query")


def conversation_list(spark, d):
    """Conversations, newest first, with the query they began with."""
    c = _conversations(spark, d).join(first_query(spark, d), "conversation_id", "left")
    return ranked(c.withColumn("newest", -F.col("conversation_id")), ["newest"], name="place").select("conversation_id", "first_query", "place")


def conversation_rename(spark, d):
    titles = files.latest(_events(spark, d).where("event_type = 'purchase'").select(F.col("user_id").alias("conversation_id"), "event_id", F.concat(F.lit("t"), F.col("k").cast("string")).alias("title")), ["conversation_id"], "event_id")
    return H.renamed(_conversations(spark, d).withColumn("title", F.lit(None).cast("string")), titles, "conversation_id", "title")


def conversation_delete(spark, d):
    """Conversations that an error event names go, with their turns and generations."""
    gone = _events(spark, d).where("event_type = 'error' and k % 10 = 0").select(F.col("user_id").alias("conversation_id"))
    g = _generations(spark, d).withColumn("conversation_id", F.floor(F.col("turn_id") / 1000))
    left = H.cascade({"conversations": _conversations(spark, d), "turns": _turns(spark, d), "generations": g}, [(t, "conversation_id") for t in ("conversations", "turns", "generations")], gone)
    return left["conversations"].select(F.lit("conversations").alias("of"), F.col("conversation_id").alias("id")).unionByName(left["turns"].select(F.lit("turns").alias("of"), F.col("turn_id").alias("id"))).unionByName(left["generations"].select(F.lit("generations").alias("of"), F.col("generation_id").alias("id")))


def turn_detail(spark, d):
    """A turn with its evidence in rank order, generations by id and judgments, each nested."""
    t = _turns(spark, d).select("turn_id", "query").withColumn("user", F.floor(F.col("turn_id") / 1000).cast("bigint"))
    g = _generations(spark, d).groupBy("turn_id").agg(F.array_sort(F.collect_list("generation_id")).alias("generations"))
    r = retrieved_replace(spark, d).withColumnRenamed("turn_id", "user").groupBy("user").agg(F.array_sort(F.collect_list(F.struct("rank0", "chunk_id"))).alias("evidence"))
    j = judgment_load(spark, d).select(F.col("turn_id").alias("user"), "judgments")
    out = t.join(g, "turn_id", "left").join(r, "user", "left").join(j, "user", "left")
    listed = lambda c: F.array_join(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.cast("string")), ",")
    return out.select("turn_id", "query", listed(F.col("generations").cast("array<string>")).alias("generations"), listed(F.transform("evidence", lambda x: x["chunk_id"].cast("string"))).alias("evidence"), "judgments")


def schema_backfill(spark, d):
    """Orders without a tier get their customer's segment, or ``unknown`` where the customer has a negative balance."""
    children = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("tier"))
    return H.backfilled(table(spark, d, "orders").select("o_orderkey", "o_custkey"), children, "o_custkey", "tier")


def index_upsert(spark, d):
    """Points keyed by id: documents of even id are in the index, then all are upserted with a new mark; the second time adds nothing."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("point_id"), "source")
    old, new = docs.where("point_id % 2 = 0").withColumn("mark", F.lit("old")), docs.withColumn("mark", F.lit("new"))
    index = KeyedTable.create(spark, files.scratch(spark, "points"), new.schema, ["point_id"])
    for rows in (old, new, new):
        index.upsert(rows)
    return index.read()


QUERIES = {f.__name__: f for f in (turn_resolve, retrieved_replace, judgment_upsert, judgment_load, judgment_default, generation_append, evaluation_upsert, evaluate_pending, generation_evidence, chunk_rehydrate, point_lookup, vector_lookup, turn_generations, turn_retrieved, conversation_turns, lookup_or_reject, first_query, conversation_list, conversation_rename, conversation_delete, turn_detail, schema_backfill, index_upsert)}

_B = """t AS (SELECT conv_id * 1000 + turn AS turn_id, conv_id AS conversation_id, text AS query FROM conversations WHERE role = 'user'),
c AS (SELECT DISTINCT conv_id AS conversation_id FROM conversations),
g AS (SELECT conv_id * 1000 + turn AS generation_id, conv_id * 1000 + turn - 1 AS turn_id, conv_id AS conversation_id FROM conversations WHERE role = 'assistant'),
e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
sets AS (SELECT user_id AS turn_id, event_id AS chunk_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS rank0, CASE WHEN k % 10 <> 0 THEN value ELSE 0.0 END AS score FROM e WHERE event_type IN ('view', 'signup')),
retrieved AS (SELECT turn_id, chunk_id, rank0, score FROM sets WHERE event_type = 'signup' OR turn_id NOT IN (SELECT turn_id FROM sets WHERE event_type = 'signup')),
j AS (SELECT user_id AS turn_id, k AS chunk_id, event_type AS label, event_id FROM e QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY event_id DESC) = 1),
jl AS (SELECT turn_id, count(*) AS n, string_agg(CAST(chunk_id AS VARCHAR) || '=' || label, ',' ORDER BY chunk_id) AS judgments FROM j GROUP BY turn_id),
ev AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey * 2, CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END) - 1 AS pos, l_partkey * 2 AS chunk_id, CASE WHEN l_linenumber % 3 <> 0 THEN l_discount END AS score FROM lineitem),
evt AS (SELECT ev.*, p_name AS text FROM ev LEFT JOIN part ON p_partkey = chunk_id)"""
_TIER = "CASE WHEN b IS NULL THEN 'moyenne' WHEN b < 0.28 THEN 'très faible' WHEN b < 0.42 THEN 'faible' WHEN b < 0.55 THEN 'moyenne' ELSE 'élevée' END"
ORACLES = {
    "turn_resolve": f"""WITH {_B}, r AS (SELECT event_id AS request_id, CASE WHEN event_type = 'click' THEN user_id * 1000 + k % 4 END AS gt, CASE WHEN event_type = 'view' THEN user_id END AS gc FROM e),
 s AS (SELECT request_id, t.turn_id, coalesce(t.conversation_id, c.conversation_id) AS conversation_id, CASE WHEN gt IS NOT NULL AND t.turn_id IS NULL THEN 'rejected' WHEN gt IS NOT NULL THEN 'existing' WHEN gc IS NOT NULL AND c.conversation_id IS NULL THEN 'rejected' WHEN gc IS NOT NULL THEN 'new_turn' ELSE 'new_conversation' END AS status FROM r LEFT JOIN t ON t.turn_id = gt LEFT JOIN c ON c.conversation_id = gc),
 n AS (SELECT *, sum(CASE WHEN status LIKE 'new%' THEN 1 ELSE 0 END) OVER (ORDER BY request_id) AS tn, sum(CASE WHEN status = 'new_conversation' THEN 1 ELSE 0 END) OVER (ORDER BY request_id) AS cn FROM s)
 SELECT request_id, status, CASE WHEN status <> 'rejected' THEN coalesce(conversation_id, CAST((SELECT max(conversation_id) FROM c) + cn AS BIGINT)) END AS conversation_id, CASE WHEN status <> 'rejected' THEN coalesce(turn_id, CAST((SELECT max(turn_id) FROM t) + tn AS BIGINT)) END AS turn_id FROM n""",
    "retrieved_replace": f"WITH {_B} SELECT * FROM retrieved",
    "judgment_upsert": f"WITH {_B} SELECT * FROM j",
    "judgment_load": f"WITH {_B} SELECT * FROM jl",
    "judgment_default": f"WITH {_B}, o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 END AS n_given, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS turn_id FROM orders) SELECT o_orderkey, CASE WHEN n_given IS NOT NULL THEN 'given' WHEN jl.n IS NOT NULL THEN 'stored' ELSE 'none' END AS used, coalesce(n_given, jl.n) AS n FROM o LEFT JOIN jl ON jl.turn_id = o.turn_id",
    "generation_append": f"SELECT o_orderkey, c_custkey, {_TIER} AS tier FROM (SELECT o_orderkey, o_custkey * 2 AS c_custkey, (SELECT round(max(l_discount * 8), 6) FROM lineitem WHERE l_orderkey = o_orderkey) AS b FROM orders WHERE o_custkey * 2 IN (SELECT c_custkey FROM customer))",
    "evaluation_upsert": "SELECT user_id * 11 AS c_custkey, event_id, value FROM events WHERE user_id * 11 IN (SELECT c_custkey FROM customer) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "evaluate_pending": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "generation_evidence": f"WITH {_B} SELECT * FROM evt",
    "chunk_rehydrate": f"WITH {_B} SELECT l_orderkey, pos, chunk_id, coalesce(score, 0.0) AS score, text FROM evt WHERE text IS NOT NULL",
    "point_lookup": f"WITH {_B} SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS place, chunk_id, text FROM evt WHERE text IS NOT NULL",
    "vector_lookup": "SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id IN (SELECT user_id FROM events))",
    "turn_generations": f"WITH {_B} SELECT turn_id, generation_id, row_number() OVER (PARTITION BY turn_id ORDER BY generation_id) AS place FROM g",
    "turn_retrieved": f"WITH {_B} SELECT turn_id, chunk_id, row_number() OVER (PARTITION BY turn_id ORDER BY rank0) AS place FROM retrieved",
    "conversation_turns": f"WITH {_B} SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_id) AS place FROM t",
    "lookup_or_reject": f"WITH {_B} SELECT event_id, user_id * 1000 AS turn_id, user_id * 1000 IN (SELECT turn_id FROM t) AS found FROM e",
    "first_query": f"WITH {_B} SELECT conversation_id, arg_min(query, turn_id) AS first_query FROM t GROUP BY conversation_id",
    "conversation_list": f"WITH {_B}, f AS (SELECT conversation_id, arg_min(query, turn_id) AS first_query FROM t GROUP BY conversation_id) SELECT c.conversation_id, first_query, row_number() OVER (ORDER BY c.conversation_id DESC) AS place FROM c LEFT JOIN f ON f.conversation_id = c.conversation_id",
    "conversation_rename": f"WITH {_B}, n AS (SELECT user_id AS conversation_id, 't' || CAST(k AS VARCHAR) AS title FROM e WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) SELECT c.conversation_id, title FROM c LEFT JOIN n ON n.conversation_id = c.conversation_id",
    "conversation_delete": f"WITH {_B}, x AS (SELECT user_id FROM e WHERE event_type = 'error' AND k % 10 = 0) SELECT 'conversations' AS of, conversation_id AS id FROM c WHERE conversation_id NOT IN (SELECT user_id FROM x) UNION ALL SELECT 'turns', turn_id FROM t WHERE conversation_id NOT IN (SELECT user_id FROM x) UNION ALL SELECT 'generations', generation_id FROM g WHERE conversation_id NOT IN (SELECT user_id FROM x)",
    "turn_detail": f"WITH {_B}, gg AS (SELECT turn_id, string_agg(CAST(generation_id AS VARCHAR), ',' ORDER BY generation_id) AS generations FROM g GROUP BY turn_id), rr AS (SELECT turn_id AS u, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY rank0) AS evidence FROM retrieved GROUP BY turn_id) SELECT t.turn_id, query, coalesce(generations, '') AS generations, coalesce(evidence, '') AS evidence, judgments FROM t LEFT JOIN gg ON gg.turn_id = t.turn_id LEFT JOIN rr ON rr.u = t.conversation_id LEFT JOIN jl ON jl.turn_id = t.conversation_id",
    "schema_backfill": "SELECT o_orderkey, o_custkey, coalesce(c_mktsegment, 'unknown') AS tier FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal >= 0",
    "index_upsert": "SELECT doc_id AS point_id, source, 'new' AS mark FROM documents",
}
