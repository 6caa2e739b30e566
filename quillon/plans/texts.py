"""Queries of text functions, answer checks and formats.  Conversations stand for turns and answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import checks as C
from quillon.operators.ranks import ranked
from quillon.plans import sql as S
from quillon.sources.tables import table


def _docs(spark, d):
    return table(spark, d, "documents")


def clean_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("md5"), F.length(T.clean_text(F.col("text"))).cast("bigint").alias("n"))


def word_count(spark, d):
    return _docs(spark, d).select("doc_id", T.word_count(F.col("text")).alias("word_count"))


def snippet(spark, d):
    return _docs(spark, d).select("doc_id", T.snippet(F.col("text")).alias("snippet"))


def preview(spark, d):
    return _docs(spark, d).select("doc_id", T.preview(F.col("text"), 60).alias("short"), T.preview(F.col("text"), 80).alias("long"))


def derive_title(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.derive_title(F.col("text")).alias("title"))


def strip_accents(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.strip_accents(F.col("text"))).alias("md5"))


def page_range(spark, d):
    o = table(spark, d, "lineitem")
    return o.select("l_orderkey", "l_linenumber", T.page_range(F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")).alias("pages"))


def score_project(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.coalesce(F.when(F.col("p_size") > 25, F.col("p_size") / 50), F.col("p_retailprice") / 10000).alias("score"))


def chunk_input_project(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("score"))
    return e.select("event_id", F.col("score").alias("rerank_score"), F.coalesce("score", F.lit(0.0)).alias("rrf_score"))


def confidence_input_project(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("score"))
    return e.select("event_id", F.col("score").alias("rerank_score"))


def _raw_judgments(spark, d):
    """Model outputs made from turns: every fifth is broken in one of the ways that a model breaks them."""
    c = table(spark, d, "conversations")
    label = F.element_at(F.array(*map(F.lit, ("pertinent", "partiellement pertinent", "non pertinent", "autre"))), (F.col("turn") % 4 + 1).cast("int"))
    why = F.when(F.col("conv_id") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit("mot "), F.col("turn").cast("string")))
    body = F.concat(F.lit('Voici: {"label": "'), label, F.lit('",\n "justification": "'), why, F.lit('"}\nfin'))
    return c.select("conv_id", "turn", F.when(F.col("conv_id") % 7 == 0, F.lit("rien")).otherwise(body).alias("raw"))


def judgment_parse(spark, d):
    return _raw_judgments(spark, d).select("conv_id", "turn", C.parse_judgment(F.col("raw")).alias("j")).select("conv_id", "turn", "j.*")


def _answers(spark, d):
    """Assistant turns as answers, with citations of the conversation's turns put after each line."""
    c = table(spark, d, "conversations").where("role = 'assistant'")
    cited = F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit(" ["), F.col("conv_id").cast("string"), F.lit("_c"), (F.col("turn") - 1).cast("string"), F.lit("; "), F.col("conv_id").cast("string"), F.lit("_c"), (F.col("turn") % 3).cast("string"), F.lit("]\n")))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", "turn", cited.alias("answer"))


def _evidence(spark, d):
    """The conversation's user turns are its evidence."""
    u = table(spark, d, "conversations").where("role = 'user'")
    return u.select("conv_id", F.concat(F.col("conv_id").cast("string"), F.lit("_c"), F.col("turn").cast("string")).alias("chunk_id"), "text", F.col("turn").alias("pos"))


def citations(spark, d):
    return _answers(spark, d).select("answer_id", F.array_join(C.citations(F.col("answer")), "|").alias("cited"))


def structure_check(spark, d):
    ids = _evidence(spark, d).groupBy("conv_id").agg(F.collect_list("chunk_id").alias("ids"))
    a = _answers(spark, d).select("answer_id", "conv_id", C.citations(F.col("answer")).alias("cited")).join(ids.hint("merge"), "conv_id", "left")
    parts = C.structure(F.col("cited"), F.coalesce("ids", F.array().cast("array<string>")))
    return a.select("answer_id", F.array_join(parts["unknown"], "|").alias("unknown"), parts["has_citation"].alias("has_citation"), parts["passed"].alias("passed"))


def quote_ground(spark, d):
    """Quotes of an answer's own words, some in other casing, some from elsewhere."""
    a = _answers(spark, d)
    q = F.when(F.col("answer_id") % 3 == 0, F.lower(F.substring("answer", 5, 12))).when(F.col("answer_id") % 3 == 1, F.substring("answer", 9, 15)).when(F.col("answer_id") % 2 == 0, F.lit("absent ici")).otherwise(F.lit("  "))
    return a.select("answer_id", C.ground_quote(q, F.col("answer")).alias("quote"))


def _claims(spark, d):
    a = _answers(spark, d)
    return a.select("answer_id", "conv_id", F.posexplode(C.sentences(F.regexp_replace("answer", r"\[[^\[\]]*\]", ""))).alias("pos", "statement"))


def claim_extract(spark, d):
    return _claims(spark, d).select("answer_id", F.col("pos").cast("bigint").alias("pos"), "statement")


def _verdicts(spark, d):
    claims = _claims(spark, d)
    seen = _evidence(spark, d).select("conv_id", F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    evidence = claims.select("answer_id", "conv_id").distinct().join(seen.hint("merge"), "conv_id").select("answer_id", "token")
    return C.claim_verdicts(claims.select("answer_id", "pos", F.array_distinct(T.tokens(F.col("statement"))).alias("tokens")), evidence)


def claim_verify(spark, d):
    return _verdicts(spark, d).select("answer_id", F.col("pos").cast("bigint").alias("pos"), F.round("share", 6).alias("share"), "supported")


def claim_join(spark, d):
    """Verdicts meet quotes by the statement's text; of a repeated statement the last quote counts."""
    claims = _claims(spark, d)
    quotes = claims.where("pos % 4 <> 1").groupBy("answer_id", "statement").agg(F.max_by(F.concat(F.lit("q"), F.col("pos").cast("string")), "pos").alias("quote"))
    return claims.select("answer_id", F.col("pos").cast("bigint").alias("pos"), "statement").join(quotes.hint("merge"), ["answer_id", "statement"], "left")


def faithfulness(spark, d):
    out = C.faithfulness(_verdicts(spark, d), _answers(spark, d).select("answer_id"))
    return out.select("answer_id", T.nan_to_null(F.round("score", 6)).alias("score"), "n_claims", "n_unsupported")


def unsupported_claims(spark, d):
    return _verdicts(spark, d).where("not supported").select("answer_id", F.col("pos").cast("bigint").alias("pos"))


def _evaluated(spark, d):
    tiers = F.element_at(F.array(*map(F.lit, C.TIERS)), (F.col("answer_id") % 4 + 1).cast("int"))
    f = C.faithfulness(_verdicts(spark, d), _answers(spark, d).select("answer_id")).withColumn("tier", tiers)
    return f.join(structure_check(spark, d).hint("merge"), "answer_id")


def auto_expand(spark, d):
    return _evaluated(spark, d).select("answer_id", C.auto_expand(F.col("tier"), F.col("n_unsupported")).alias("should_auto_expand"))


def evaluate_answers(spark, d):
    return _evaluated(spark, d).select("answer_id", "tier", "has_citation", "passed", T.nan_to_null(F.round("score", 6)).alias("score"), "n_unsupported", C.auto_expand(F.col("tier"), F.col("n_unsupported")).alias("should_auto_expand"))


def fully_endorsed(spark, d):
    return _evaluated(spark, d).select("answer_id", ((F.col("n_claims") > 0) & (F.col("n_unsupported") == 0)).alias("fully_endorsed"))


def highlight_spans(spark, d):
    """Marked spans and the plain stretches between them, in order."""
    bad = _claims(spark, d).join(_verdicts(spark, d).where("not supported").hint("merge"), ["answer_id", "pos"])
    a = _answers(spark, d).select("answer_id", "answer")
    spans = C.highlight(bad.select("answer_id", F.col("statement").alias("quote")).join(a.hint("merge"), "answer_id"))
    w = Window.partitionBy("answer_id").orderBy("start")
    marked = spans.select("answer_id", "start", "end", F.lit(True).alias("marked"))
    gaps = spans.select("answer_id", F.col("end").alias("start"), F.lead("start").over(w).alias("end"), F.lit(False).alias("marked"))
    ends = gaps.join(a.hint("merge"), "answer_id").select("answer_id", "start", F.coalesce("end", F.length("answer")).alias("end"), "marked")
    heads = spans.groupBy("answer_id").agg(F.min("start").alias("end")).select("answer_id", F.lit(0).alias("start"), "end", F.lit(False).alias("marked"))
    return marked.unionByName(ends).unionByName(heads).where("start < end").join(a.hint("merge"), "answer_id").select("answer_id", "start", "end", "marked", F.substr("answer", F.col("start") + 1, F.col("end") - F.col("start")).alias("segment"))


def metric_format(spark, d):
    v = F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", T.three_decimals(v).alias("shown"))


def nan_to_null(spark, d):
    v = F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", T.nan_to_null(v).alias("value"))


def rank_format(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.rank_text(F.when(F.col("l_quantity") <= 10, F.col("l_quantity").cast("int")), 10).alias("shown"))


def rank_delta(spark, d):
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.rank_change(F.when(q <= 10, q), F.when(n <= 5, n), 10).alias("delta"))


def pct(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count("*").alias("n"))
    c = table(spark, d, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", T.share_text(F.coalesce("f", F.lit(0)), F.coalesce("n", F.lit(0))).alias("share"))


def context_precision(spark, d):
    """Rank-weighted average precision of judged evidence: labels of documents, ranked by id within a source."""
    docs = _docs(spark, d).select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    # a source may hold any share of the rows: its ranks, and the number of hits up to each hit, come from sorts by range
    r = ranked(docs, ["doc_id"], "source", "rank")
    hits = ranked(r.where("quality > 0"), ["rank"], "source", "hits").groupBy("source").agg(F.avg(F.col("hits") / F.col("rank")).alias("p"))
    return docs.select("source").distinct().join(hits.hint("merge"), "source", "left").select("source", F.round(F.coalesce("p", F.lit(0.0)), 6).alias("precision"))


def context_recall(spark, d):
    """Share of a reference answer's claims that the evidence holds, by the offline verifier."""
    return _verdicts(spark, d).groupBy("answer_id").agg(F.round(F.avg(F.col("supported").cast("int")), 6).alias("recall"))


def safe_score(spark, d):
    """Scores with failures as NaN and a note: broken judgments fail."""
    p = _raw_judgments(spark, d).select("conv_id", "turn", C.parse_judgment(F.col("raw")).alias("j"))
    return p.select("conv_id", "turn", T.nan_to_null(F.when(F.col("j.valid"), F.length("j.justification").cast("double")).otherwise(F.lit(float("nan")))).alias("score"), F.when(~F.col("j.valid"), F.lit("judge failed")).alias("note"))


QUERIES = {f.__name__: f for f in (clean_text, word_count, snippet, preview, derive_title, strip_accents, page_range, score_project, chunk_input_project, confidence_input_project, judgment_parse, citations, structure_check, quote_ground, claim_extract, claim_verify, claim_join, faithfulness, unsupported_claims, auto_expand, evaluate_answers, fully_endorsed, highlight_spans, metric_format, nan_to_null, rank_format, rank_delta, pct, context_precision, context_recall, safe_score)}

_C = S.clean("text")
_RAW = """raw AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN NULL WHEN conv_id % 5 = 0 THEN NULL WHEN turn % 4 = 3 THEN NULL
 ELSE ['pertinent', 'partiellement pertinent', 'non pertinent'][turn % 4 + 1] END AS label, 'mot ' || CAST(turn AS VARCHAR) AS why FROM conversations)"""
_A = """answers AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id, turn, replace(text, chr(10), ' [' || CAST(conv_id AS VARCHAR) || '_c' || CAST(turn - 1 AS VARCHAR) || '; ' || CAST(conv_id AS VARCHAR) || '_c' || CAST(turn % 3 AS VARCHAR) || ']' || chr(10)) AS answer FROM conversations WHERE role = 'assistant'),
cites AS (SELECT answer_id, conv_id, list_filter(list_transform(flatten(list_transform(regexp_extract_all(answer, '\\[([^\\[\\]]+)\\]', 1), lambda b: string_split_regex(b, '[,;]'))), lambda p: trim(p)), lambda p: p <> '') AS parts FROM answers),
cited AS (SELECT answer_id, conv_id, list_filter(parts, lambda p, i: list_position(parts, p) = i) AS cited FROM cites)"""
_CL = rf"""{_A},
sent AS (SELECT answer_id, conv_id, list_filter(list_transform(string_split_regex(regexp_replace(answer, '\[[^\[\]]*\]', '', 'g'), '[.!?\n]+'), lambda s: trim(s)), lambda s: s <> '') AS s FROM answers),
claims AS (SELECT answer_id, conv_id, i - 1 AS pos, s[i] AS statement FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM sent)),
ev AS (SELECT DISTINCT conv_id, unnest({S.tokens("text")}) AS token FROM conversations WHERE role = 'user'),
ct AS (SELECT answer_id, conv_id, pos, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS token FROM (SELECT answer_id, conv_id, pos, list_distinct({S.tokens("statement")}) AS t FROM claims)),
verdicts AS (SELECT answer_id, pos, count(ev.token) / greatest(count(ct.token), 1) AS share, count(ev.token) / greatest(count(ct.token), 1) >= 0.5 AS supported FROM ct LEFT JOIN ev ON ev.conv_id = ct.conv_id AND ev.token = ct.token GROUP BY answer_id, pos),
faith AS (SELECT answers.answer_id, round(avg(CAST(supported AS INTEGER)), 6) AS score, count(supported) AS n_claims, count(CASE WHEN NOT supported THEN 1 END) AS n_unsupported FROM answers LEFT JOIN verdicts USING (answer_id) GROUP BY answers.answer_id),
ids AS (SELECT conv_id, list(CAST(conv_id AS VARCHAR) || '_c' || CAST(turn AS VARCHAR)) AS ids FROM conversations WHERE role = 'user' GROUP BY conv_id),
struct AS (SELECT answer_id, array_to_string(list_filter(cited, lambda x: NOT list_contains(coalesce(ids, []), x)), '|') AS unknown, len(cited) > 0 AS has_citation,
  len(cited) > 0 AND len(list_filter(cited, lambda x: NOT list_contains(coalesce(ids, []), x))) = 0 AS passed FROM cited LEFT JOIN ids USING (conv_id)),
evald AS (SELECT faith.*, ['très faible', 'faible', 'moyenne', 'élevée'][answer_id % 4 + 1] AS tier, has_citation, passed FROM faith JOIN struct USING (answer_id))"""
_GATE = "tier IN ('moyenne', 'élevée') AND n_unsupported = 0"
_NAN = "CASE WHEN event_id % 9 = 0 THEN 'NaN'::DOUBLE ELSE value END"
ORACLES = {
    "clean_text": f"SELECT doc_id, md5({_C}) AS md5, length({_C}) AS n FROM documents",
    "word_count": f"SELECT doc_id, {S.words('text')} AS word_count FROM documents",
    "snippet": f"SELECT doc_id, CASE WHEN length({_C}) > 300 THEN rtrim(substr({_C}, 1, 300)) || '...' ELSE {_C} END AS snippet FROM documents",
    "preview": "SELECT doc_id, " + ", ".join(f"replace(replace(CASE WHEN length(text) > {n} THEN substr(text, 1, {n}) || '…' ELSE text END, chr(10), ' '), '|', '\\|') AS {c}" for n, c in ((60, "short"), (80, "long"))) + " FROM documents",
    "derive_title": r"SELECT conv_id, turn, CASE WHEN length(t) <= 42 THEN t ELSE rtrim(CASE WHEN contains(h, ' ') AND length(regexp_extract(h, '(?s)^(.*) ', 1)) > 42 * 0.4 THEN regexp_extract(h, '(?s)^(.*) ', 1) ELSE h END) || '…' END AS title FROM (SELECT conv_id, turn, trim(text) AS t, substr(trim(text), 1, 42) AS h FROM conversations)",
    "strip_accents": f"SELECT doc_id, md5({S.plain('text')}) AS md5 FROM documents",
    "page_range": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = CAST(l_quantity AS INTEGER) THEN CAST(l_linenumber AS VARCHAR) ELSE CAST(l_linenumber AS VARCHAR) || '-' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS pages FROM lineitem",
    "score_project": "SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_size / 50 END, p_retailprice / 10000) AS score FROM part",
    "chunk_input_project": "SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS rerank_score, CASE WHEN event_type <> 'error' THEN value ELSE 0.0 END AS rrf_score FROM events",
    "confidence_input_project": "SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS rerank_score FROM events",
    "judgment_parse": f"WITH {_RAW} SELECT conv_id, turn, label, CASE WHEN label IS NOT NULL THEN why END AS justification, label IS NOT NULL AS valid FROM raw",
    "citations": f"WITH {_A} SELECT answer_id, array_to_string(cited, '|') AS cited FROM cited",
    "structure_check": f"WITH {_CL} SELECT * FROM struct",
    "quote_ground": f"WITH {_A}, q AS (SELECT answer_id, answer, trim(CASE WHEN answer_id % 3 = 0 THEN lower(substr(answer, 5, 12)) WHEN answer_id % 3 = 1 THEN substr(answer, 9, 15) WHEN answer_id % 2 = 0 THEN 'absent ici' ELSE '  ' END) AS q FROM answers) SELECT answer_id, CASE WHEN q = '' THEN NULL WHEN contains(answer, q) THEN q WHEN instr(lower(answer), lower(q)) > 0 THEN substr(answer, instr(lower(answer), lower(q)), length(q)) END AS quote FROM q",
    "claim_extract": f"WITH {_CL} SELECT answer_id, pos, statement FROM claims",
    "claim_verify": f"WITH {_CL} SELECT answer_id, pos, round(share, 6) AS share, supported FROM verdicts",
    "claim_join": f"WITH {_CL}, q AS (SELECT answer_id, statement, 'q' || CAST(max(pos) AS VARCHAR) AS quote FROM claims WHERE pos % 4 <> 1 GROUP BY ALL) SELECT answer_id, pos, statement, quote FROM claims LEFT JOIN q USING (answer_id, statement)",
    "faithfulness": f"WITH {_CL} SELECT * FROM faith",
    "unsupported_claims": f"WITH {_CL} SELECT answer_id, pos FROM verdicts WHERE NOT supported",
    "auto_expand": f"WITH {_CL} SELECT answer_id, {_GATE} AS should_auto_expand FROM evald",
    "evaluate_answers": f"WITH {_CL} SELECT answer_id, tier, has_citation, passed, score, n_unsupported, {_GATE} AS should_auto_expand FROM evald",
    "fully_endorsed": f"WITH {_CL} SELECT answer_id, n_claims > 0 AND n_unsupported = 0 AS fully_endorsed FROM evald",
    "highlight_spans": f"""WITH RECURSIVE {_CL}, found AS (SELECT answer_id, instr(lower(answer), lower(statement)) - 1 AS st, length(statement) AS size FROM claims JOIN verdicts USING (answer_id, pos) JOIN answers USING (answer_id) WHERE NOT supported AND instr(lower(answer), lower(statement)) > 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY size DESC, st) AS rn FROM found),
 walk AS (SELECT answer_id, rn, [struct_pack(s := st, e := st + size)] AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.answer_id, o.rn, CASE WHEN len(list_filter(w.kept, lambda k: o.st < k.e AND k.s < o.st + o.size)) > 0 THEN w.kept ELSE list_append(w.kept, struct_pack(s := o.st, e := o.st + o.size)) END FROM walk w JOIN o ON o.answer_id = w.answer_id AND o.rn = w.rn + 1),
 sp AS (SELECT answer_id, k.s AS st, k.e AS en FROM (SELECT answer_id, unnest(kept) AS k FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY answer_id ORDER BY rn DESC) = 1))),
 parts AS (SELECT answer_id, st, en, true AS marked FROM sp UNION ALL SELECT answer_id, en, coalesce(lead(st) OVER (PARTITION BY answer_id ORDER BY st), length(answer)), false FROM sp JOIN answers USING (answer_id) UNION ALL SELECT answer_id, 0, min(st), false FROM sp GROUP BY answer_id)
 SELECT answer_id, CAST(st AS INTEGER) AS start, CAST(en AS INTEGER) AS "end", marked, substr(answer, st + 1, en - st) AS segment FROM parts JOIN answers USING (answer_id) WHERE st < en""",
    "metric_format": f"SELECT event_id, CASE WHEN isnan({_NAN}) THEN 'nan' ELSE printf('%.3f', {_NAN}) END AS shown FROM events",
    "nan_to_null": f"SELECT event_id, CASE WHEN NOT isnan({_NAN}) THEN {_NAN} END AS value FROM events",
    "rank_format": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 10 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ELSE '>10' END AS shown FROM lineitem",
    "rank_delta": "SELECT l_orderkey, l_linenumber, CASE WHEN g = 0 THEN '=' WHEN g > 0 THEN '+' || CAST(g AS VARCHAR) ELSE CAST(g AS VARCHAR) END AS delta FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 10 THEN CAST(l_quantity AS INTEGER) ELSE 11 END - CASE WHEN l_linenumber <= 5 THEN l_linenumber ELSE 11 END AS g FROM lineitem)",
    "pct": "SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'n/a' ELSE printf('%.1f', 100.0 * CAST(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS DOUBLE) / count(o_orderkey)) || '%' END AS share FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "context_precision": "WITH r AS (SELECT source, quality, row_number() OVER w AS rank, sum(quality) OVER w AS hits FROM documents JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY source ORDER BY doc_id)) SELECT source, round(CASE WHEN sum(quality) > 0 THEN sum(CAST(quality * hits AS DOUBLE) / rank) / sum(quality) ELSE 0.0 END, 6) AS precision FROM r GROUP BY source",
    "context_recall": f"WITH {_CL} SELECT answer_id, round(avg(CAST(supported AS INTEGER)), 6) AS recall FROM verdicts GROUP BY answer_id",
    "safe_score": f"WITH {_RAW} SELECT conv_id, turn, CASE WHEN label IS NOT NULL THEN CAST(length(why) AS DOUBLE) END AS score, CASE WHEN label IS NULL THEN 'judge failed' END AS note FROM raw",
}
