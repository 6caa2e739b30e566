"""Queries of evaluation: benchmark items with their documents as gold; events stand for scored outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import evaluation as E
from quillon.operators import retrieval as R
from quillon.plans import retrieval as RQ
from quillon.plans import sql as S
from quillon.sources import files
from quillon.sources.tables import table

LIMIT = 10
CONFIGS = ["dense", "sparse", *(f"hybrid_k{k}" for k in RQ.SWEEP)]


def _gold(spark, d):
    found = lambda: E.passages_in(RQ._chunks(spark, d), table(spark, d, "benchmark").select("item_id", "text"))
    return files.kept(spark, "gold", [f"{d}/documents.parquet", f"{d}/benchmark.parquet"], found)


def _results(spark, d):
    """Both styles of each item that has gold, with its hit rank and attributes."""
    gold = _gold(spark, d)
    q = R.keyword_and_full(table(spark, d, "benchmark"))
    hits = RQ._corpus(spark, d).retrieve(q.select("query_id", "text"), LIMIT)
    hits = files.staged(hits, "hits").join(q.select("query_id", "item_id", "style"), "query_id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "source")
    about = gold.join(docs, "chunk_id").groupBy("item_id").agg(F.min_by("lang", "chunk_id").alias("lang"), F.min_by("source", "chunk_id").alias("source"))
    items = q.select("item_id", "style").join(about.hint("merge"), "item_id")
    return E.hit_ranks(items, hits.select("item_id", "style", "chunk_id", "rank"), gold, ["item_id", "style"])


def _sweep_results(spark, d):
    gold = _gold(spark, d)
    hits = RQ.sweep_hits(spark, d).withColumnRenamed("query_id", "item_id")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang")
    about = gold.join(docs, "chunk_id").groupBy("item_id").agg(F.min_by("lang", "chunk_id").alias("lang"))
    items = about.withColumn("config", F.explode(F.array(*map(F.lit, CONFIGS))))
    return E.hit_ranks(items, hits, gold, ["item_id", "config"])


def _outcomes(spark, d):
    """Events as scored outcomes: mode, item, answer and three metrics, some of them NaN."""
    e = table(spark, d, "events")
    nan = F.lit(float("nan"))
    v = F.least("value", F.lit(100.0)) / 100
    return e.select(
        F.col("event_id").alias("batch"), F.col("event_type").alias("mode"), F.col("user_id").alias("item_id"), F.col("props").alias("answer"),
        F.when(F.col("event_id") % 7 == 0, nan).otherwise(v).alias("faithfulness"), F.when(F.col("event_id") % 11 == 0, nan).otherwise(1 - v).alias("precision"), (v * v).alias("recall"),
    )


def scan_gold(spark, d):
    path = files.scratch(spark, "gold")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("chunk_id")), lambda x: x.cast("string")), ", ")
    held = _gold(spark, d).groupBy("item_id").agg(ids.alias("chunk_ids"))
    items = table(spark, d, "benchmark").select("item_id", "text").join(held.hint("merge"), "item_id", "left")
    files.write_csv(items.select("item_id", F.col("text").alias("query"), "chunk_ids"), path, sep=";")
    out = files.read_gold(spark, path, "item_id bigint, query string, chunk_ids string")
    return out.select("item_id", "query", F.array_join("chunk_ids", "|").alias("chunk_ids"), F.size("chunk_ids").cast("bigint").alias("n_chunks"))


def hit_rank(spark, d):
    return _results(spark, d)


def recall_at_k(spark, d):
    return _results(spark, d).groupBy("style").agg(*(E.recall(k, F.col("hit_rank")).alias(f"recall_at_{k}") for k in E.CUTS))


def mrr(spark, d):
    return _results(spark, d).groupBy("style").agg(F.avg(F.coalesce(1 / F.col("hit_rank"), F.lit(0.0))).alias("mrr"))


def metrics_overall(spark, d):
    return _results(spark, d).agg(*E.measures())


def metrics_breakdown(spark, d):
    return E.report(_results(spark, d), ["style", "lang", "source"], overall=False)


def metrics_report(spark, d):
    return E.report(_results(spark, d), ["style", "lang", "source"])


def rank_matrix(spark, d):
    m = E.rank_matrix(_sweep_results(spark, d), "item_id", "config", CONFIGS)
    return m.select("*", T.rank_change(F.col("dense"), F.col("hybrid_k1"), LIMIT).alias("delta"))


def sweep_table(spark, d):
    return _sweep_results(spark, d).groupBy("config").agg(*E.measures())


def config_breakdown(spark, d):
    return E.report(_sweep_results(spark, d), ["lang"], always=["config"], overall=False)


def determinism_check(spark, d):
    """Two runs of the sweep, compared row by row: hits of each configuration, and how many differ."""
    one, two = files.staged(RQ.sweep_hits(spark, d), "first"), files.staged(RQ.sweep_hits(spark, d), "second")
    other = E.differences(one, two).groupBy("config").agg(F.count("*").alias("n_different"))
    hits = one.groupBy("config").agg(F.count("*").alias("n_hits"))
    return hits.join(other.hint("merge"), "config", "left").select("config", "n_hits", F.coalesce("n_different", F.lit(0)).alias("n_different"))


def outcome_match(spark, d):
    """The latest outcome of each pair against its first: same answer and metrics, NaN equal to NaN."""
    o = _outcomes(spark, d)
    keys = ["mode", "item_id"]
    a = files.latest(o.withColumn("order", -F.col("batch")), keys, "order")
    b = files.latest(o, keys, "batch").select(*keys, *[F.col(c).alias(f"re_{c}") for c in ("answer", "faithfulness", "precision", "recall")])
    j = a.join(b, keys, "left")
    same = F.col("answer") == F.col("re_answer")
    for m in ("faithfulness", "precision", "recall"):
        same = same & E.same_metric(F.col(m), F.col(f"re_{m}"))
    return j.select(*keys, F.coalesce(same, F.lit(False)).alias("matched"))


def checkpoint_read(spark, d):
    path = files.scratch(spark, "checkpoint")
    o = _outcomes(spark, d).select("batch", F.lit(None).cast("string").alias("key"), "mode", "item_id", "answer", "recall")
    files.append_checkpoint(o.where("batch % 2 = 0"), path)
    files.append_checkpoint(o.where("batch % 2 = 1"), path)
    out = files.read_checkpoint(spark, path, "batch bigint, key string, mode string, item_id bigint, answer string, recall double")
    return out.select("key", "mode", "item_id", "batch", "answer", F.round("recall", 6).alias("recall"))


def checkpoint_append(spark, d):
    path = files.scratch(spark, "appended")
    o = _outcomes(spark, d).select("batch", "mode", "item_id", "answer")
    for part in (0, 1, 2):
        files.append_checkpoint(o.where(F.col("batch") % 3 == part), path)
    return files.read_json(spark, path, "batch bigint, mode string, item_id bigint, answer string").groupBy("mode").agg(F.count("*").alias("n"), F.max("batch").alias("last"))


def resume_pending(spark, d):
    """Pairs of mode and user that were planned (any event type, any user) and aren't checkpointed."""
    e = table(spark, d, "events")
    done = e.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key")).distinct()
    modes = e.agg(F.collect_set("event_type").alias("modes"))  # one row
    planned = table(spark, d, "customer").select(F.col("c_custkey").alias("item_id")).crossJoin(F.broadcast(modes)).select("item_id", F.explode("modes").alias("mode"))
    return planned.withColumn("key", F.concat_ws(":", "mode", F.col("item_id").cast("string"))).join(done.hint("merge"), "key", "left_anti")


def _round(df, names):
    return df.withColumns({c: T.nan_to_null(F.round(c, 6)) for c in names})


def mean_ignore_nan(spark, d):
    return _round(_outcomes(spark, d).groupBy("item_id").agg(E.mean_ignoring_nan(F.col("faithfulness")).alias("faithfulness")), ["faithfulness"])


_MEANS = [("faithfulness", "faithfulness"), ("precision", "precision"), ("recall", "recall")]


def quality_aggregate(spark, d):
    return _round(_outcomes(spark, d).groupBy("mode").agg(*(E.mean_ignoring_nan(F.col(c)).alias(c) for c, _ in _MEANS), F.count("*").alias("n")), [c for c, _ in _MEANS])


def quality_breakdown(spark, d):
    o = _outcomes(spark, d).withColumn("parity", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd")).withColumn("hour", F.lpad((F.col("batch") % 24).cast("string"), 2, "0"))
    out = E.report(o, ["parity", "hour"], always=["mode"], overall=False, aggregates=[*(E.mean_ignoring_nan(F.col(c)).alias(c) for c, _ in _MEANS), F.count("*").alias("n")])
    return _round(out, [c for c, _ in _MEANS])


def per_item_table(spark, d):
    o = _outcomes(spark, d)
    return o.select("batch", "mode", T.preview(F.col("answer"), 6).alias("preview"), T.three_decimals(F.col("faithfulness")).alias("faithfulness"))


def gold_coverage(spark, d):
    """Warnings of a gold set: too few items, works without one, too few keyword items."""
    r = _results(spark, d)
    n = r.agg(F.count("*").alias("n"), F.count_if(F.col("style") == "keyword").alias("k"))
    few = n.where("n < 50").select(F.lit("few_items").alias("warning"), F.col("n").cast("string").alias("detail"))
    key = n.where("k < 8").select(F.lit("few_keyword").alias("warning"), F.col("k").cast("string").alias("detail"))
    works = table(spark, d, "documents").select("source").distinct().join(r.select("source").distinct(), "source", "left_anti").select(F.lit("work_without_gold").alias("warning"), F.col("source").alias("detail"))
    return few.unionByName(key).unionByName(works)


QUERIES = {f.__name__: f for f in (scan_gold, hit_rank, recall_at_k, mrr, metrics_overall, metrics_breakdown, metrics_report, rank_matrix, sweep_table, config_breakdown, determinism_check, outcome_match, checkpoint_read, checkpoint_append, resume_pending, mean_ignore_nan, quality_aggregate, quality_breakdown, per_item_table, gold_coverage)}

_GOLD = "gold AS (SELECT item_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_RES = f"""{RQ._retrieved(10, S.STYLED)}, {_GOLD},
about AS (SELECT item_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source FROM gold JOIN documents ON doc_id = chunk_id GROUP BY item_id),
firsts AS (SELECT q.item_id, q.style, min(out.rank) AS hit_rank FROM out JOIN {S.STYLED} q USING (query_id) JOIN gold g ON g.item_id = q.item_id AND g.chunk_id = out.chunk_id GROUP BY ALL),
results AS (SELECT q.item_id, q.style, lang, source, hit_rank FROM {S.STYLED} q JOIN about USING (item_id) LEFT JOIN firsts f ON f.item_id = q.item_id AND f.style = q.style)"""
_M = ", ".join(f"coalesce(avg(CASE WHEN hit_rank <= {k} THEN 1.0 ELSE 0.0 END), 0.0) AS recall_at_{k}" for k in E.CUTS)
_MRR = "coalesce(avg(coalesce(1 / hit_rank, 0.0)), 0.0) AS mrr"
_SW = f"""WITH sweep AS ({{sweep}}), {_GOLD},
about AS (SELECT item_id, arg_min(lang, doc_id) AS lang FROM gold JOIN documents ON doc_id = chunk_id GROUP BY item_id),
configs AS (SELECT unnest([{', '.join(repr(c) for c in CONFIGS)}]) AS config),
firsts AS (SELECT config, g.item_id, min(rank) AS hit_rank FROM sweep s JOIN gold g ON g.item_id = s.query_id AND g.chunk_id = s.chunk_id GROUP BY ALL),
results AS (SELECT about.item_id, configs.config, lang, hit_rank FROM about CROSS JOIN configs LEFT JOIN firsts f ON f.item_id = about.item_id AND f.config = configs.config)""".replace("{sweep}", RQ.ORACLES["config_sweep"])
_OUT = """o AS (SELECT event_id AS batch, event_type AS mode, user_id AS item_id, props AS answer,
 CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE ELSE least(value, 100.0) / 100 END AS faithfulness,
 CASE WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE ELSE 1 - least(value, 100.0) / 100 END AS precision,
 (least(value, 100.0) / 100) * (least(value, 100.0) / 100) AS recall FROM events)"""
_NN = ", ".join(f"round(avg(CASE WHEN NOT isnan({c}) THEN {c} END), 6) AS {c}" for c in ("faithfulness", "precision", "recall"))


def _sets(attributes, cols=f"{_M}, {_MRR}, count(*) AS n", of="results", head=""):
    by = "" if not head else head + ", "
    return " UNION ALL ".join(f"SELECT {by}'{a}' AS attribute, CAST({a} AS VARCHAR) AS value, {cols} FROM {of} GROUP BY {by}{a}" for a in attributes)


_SAME = " AND ".join(f"((isnan(a.{m}) AND isnan(b.{m})) OR (NOT isnan(a.{m}) AND NOT isnan(b.{m}) AND abs(a.{m} - b.{m}) <= 1e-9))" for m in ("faithfulness", "precision", "recall"))
ORACLES = {
    "scan_gold": f"WITH {_GOLD}, g AS (SELECT item_id, string_agg(CAST(chunk_id AS VARCHAR), '|' ORDER BY chunk_id) AS chunk_ids, count(*) AS n FROM gold GROUP BY item_id) SELECT item_id, text AS query, coalesce(chunk_ids, '') AS chunk_ids, coalesce(n, 0) AS n_chunks FROM benchmark LEFT JOIN g USING (item_id)",
    "hit_rank": f"{_RES} SELECT * FROM results",
    "recall_at_k": f"{_RES} SELECT style, {_M} FROM results GROUP BY style",
    "mrr": f"{_RES} SELECT style, {_MRR} FROM results GROUP BY style",
    "metrics_overall": f"{_RES} SELECT {_M}, {_MRR}, count(*) AS n FROM results",
    "metrics_breakdown": f"{_RES} {_sets(['style', 'lang', 'source'])}",
    "metrics_report": f"{_RES} {_sets(['style', 'lang', 'source'])} UNION ALL SELECT 'overall', NULL, {_M}, {_MRR}, count(*) AS n FROM results",
    "rank_matrix": f"{_SW}, m AS (SELECT item_id, {', '.join(f'min(CASE WHEN config = {c!r} THEN hit_rank END) AS {c}' for c in CONFIGS)} FROM results GROUP BY item_id) SELECT *, CASE WHEN coalesce(dense, 11) = coalesce(hybrid_k1, 11) THEN '=' WHEN coalesce(dense, 11) > coalesce(hybrid_k1, 11) THEN '+' || CAST(coalesce(dense, 11) - coalesce(hybrid_k1, 11) AS VARCHAR) ELSE CAST(coalesce(dense, 11) - coalesce(hybrid_k1, 11) AS VARCHAR) END AS delta FROM m",
    "sweep_table": f"{_SW} SELECT config, {_M}, {_MRR}, count(*) AS n FROM results GROUP BY config",
    "config_breakdown": f"{_SW} {_sets(['lang'], head='config')}",
    "determinism_check": f"SELECT config, count(*) AS n_hits, CAST(0 AS BIGINT) AS n_different FROM ({RQ.ORACLES['config_sweep']}) GROUP BY config",
    "outcome_match": f"WITH {_OUT}, a AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY mode, item_id ORDER BY batch) = 1), b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY mode, item_id ORDER BY batch DESC) = 1) SELECT a.mode, a.item_id, coalesce(a.answer = b.answer AND {_SAME}, false) AS matched FROM a LEFT JOIN b ON a.mode = b.mode AND a.item_id = b.item_id",
    "checkpoint_read": f"WITH {_OUT} SELECT mode || ':' || CAST(item_id AS VARCHAR) AS key, mode, item_id, batch, answer, round(recall, 6) AS recall FROM o QUALIFY row_number() OVER (PARTITION BY mode, item_id ORDER BY batch DESC) = 1",
    "checkpoint_append": "SELECT event_type AS mode, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type",
    "resume_pending": "SELECT c_custkey AS item_id, mode, mode || ':' || CAST(c_custkey AS VARCHAR) AS key FROM customer CROSS JOIN (SELECT DISTINCT event_type AS mode FROM events) WHERE mode || ':' || CAST(c_custkey AS VARCHAR) NOT IN (SELECT event_type || ':' || CAST(user_id AS VARCHAR) FROM events)",
    "mean_ignore_nan": f"WITH {_OUT} SELECT item_id, round(avg(CASE WHEN NOT isnan(faithfulness) THEN faithfulness END), 6) AS faithfulness FROM o GROUP BY item_id",
    "quality_aggregate": f"WITH {_OUT} SELECT mode, {_NN}, count(*) AS n FROM o GROUP BY mode",
    "quality_breakdown": f"WITH {_OUT}, p AS (SELECT *, CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, lpad(CAST(batch % 24 AS VARCHAR), 2, '0') AS hour FROM o) {_sets(['parity', 'hour'], _NN + ', count(*) AS n', 'p', 'mode')}",
    "per_item_table": f"WITH {_OUT} SELECT batch, mode, replace(replace(CASE WHEN length(answer) > 6 THEN substr(answer, 1, 6) || '…' ELSE answer END, chr(10), ' '), '|', '\\|') AS preview, CASE WHEN isnan(faithfulness) THEN 'nan' ELSE printf('%.3f', faithfulness) END AS faithfulness FROM o",
    "gold_coverage": f"{_RES}, n AS (SELECT count(*) AS n, count(CASE WHEN style = 'keyword' THEN 1 END) AS k FROM results) SELECT 'few_items' AS warning, CAST(n AS VARCHAR) AS detail FROM n WHERE n < 50 UNION ALL SELECT 'few_keyword', CAST(k AS VARCHAR) FROM n WHERE k < 8 UNION ALL SELECT 'work_without_gold', source FROM (SELECT DISTINCT source FROM documents EXCEPT SELECT source FROM results)",
}
