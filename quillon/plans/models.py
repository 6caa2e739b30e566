"""Queries of batch inference, the index job and the file sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import checks as C
from quillon.operators import history as H
from quillon.operators import models as I
from quillon.operators import signals as G
from quillon.operators import stemming as N
from quillon.operators import weights as W
from quillon.plans import markup as MP
from quillon.plans import retrieval as RQ
from quillon.plans import sql as S
from quillon.sources import files
from quillon.sources.keyed import KeyedTable
from quillon.sources.tables import table


def _evidence(spark, d):
    """User turns are evidence for the assistant turn that follows; the turn's own text is the question."""
    c = table(spark, d, "conversations")
    u = c.where("role = 'user'").select("conv_id", F.col("turn").alias("rank"), F.concat(F.col("conv_id").cast("string"), F.lit("_c"), F.col("turn").cast("string")).alias("chunk_id"), "text")
    a = c.where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "conv_id", F.col("text").alias("question"))
    return a.join(u.hint("merge"), "conv_id")


def generate_answers(spark, d):
    return I.written(_evidence(spark, d))


def generate_with_fallback(spark, d):
    """Long prompts fail on the first model and go to the second; the table says which answered."""
    prompts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("prompt"))

    def first():
        return lambda ps: [ValueError("too long") if len(p) > 2000 else p[:20] for p in ps]

    def second():
        return lambda ps: [p[-20:] for p in ps]

    return I.with_fallback(prompts, first, second).groupBy("model").agg(F.count("*").alias("n"), F.sum(F.length("answer")).cast("bigint").alias("chars"))


def _wavering_judge():
    """The offline judge, which gives no JSON at first to a prompt of a length divisible by nine."""
    call = I.overlap_judge()
    return lambda prompts: ["je ne sais pas" if len(p) % 9 == 0 and not p.endswith("JSON.") else x for p, x in zip(prompts, call(prompts))]


def judge_chunks(spark, d):
    hits = files.staged(RQ._corpus(spark, d).sparse(RQ._items(spark, d), 5).select("query_id", "chunk_id"), "hits")
    hits = hits.join(RQ._items(spark, d).withColumnRenamed("text", "question"), "query_id").join(RQ._chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    pairs = hits.select(F.concat_ws(":", F.col("query_id").cast("string"), F.col("chunk_id").cast("string")).alias("id"), G.judge_prompt(F.col("question"), F.col("text")).alias("prompt"))
    return I.judged(pairs, _wavering_judge)


def score_outcome(spark, d):
    """Generation and answer check in two modes: all evidence, and its first part only; sets without evidence are skipped."""
    e = _evidence(spark, d)
    both = e.withColumn("mode", F.lit("given")).unionByName(e.where("rank < 2").withColumn("mode", F.lit("end_to_end")))
    keyed = both.withColumn("key", F.concat_ws(":", "mode", F.col("query_id").cast("string")))
    answers = I.extractive_answers(keyed, "key").withColumnRenamed("key", "answer_id")
    claims = answers.select("answer_id", F.posexplode(C.sentences(F.regexp_replace("answer", r"\[[^\[\]]*\]", ""))).alias("pos", "s")).select("answer_id", "pos", F.array_distinct(T.tokens(F.col("s"))).alias("tokens"))
    terms = keyed.select(F.col("key").alias("answer_id"), F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    scored = C.faithfulness(C.claim_verdicts(claims, terms), answers.select("answer_id"))
    return scored.select("answer_id", T.nan_to_null(F.round("score", 6)).alias("faithfulness"), "n_claims")


TERMS, VECTOR = "array<struct<term:string,weight:double>>", "array<double>"


def _points(spark, d):
    """Rows from which points of the documents are made, and their columns: id, payload, BM25 weights and dense vector.

    The rows are as small as the texts; terms and vectors are unfolded where a point is used.
    """
    chunks = RQ._chunks(spark, d)
    name = T.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.concat(F.lit("chunk/"), F.col("chunk_id").cast("string"))).alias("point_id")
    columns = "point_id", "chunk_id", "work_id"
    if W.repeated(chunks.select("chunk_id"), "chunk_id"):
        # a chunk that comes in several rows has the terms of all of them
        corpus = RQ._corpus(spark, d)
        weighted = F.transform("terms", lambda x: F.struct(x["term"].alias("term"), W.weight_of(x["tf"], F.col("size"), corpus.mean).alias("weight")))
        sparse = corpus.lists.select("chunk_id", F.array_sort(weighted).alias("terms"))
        both = chunks.select("chunk_id", "work_id").join(sparse.hint("merge"), "chunk_id", "left").join(corpus.vectors().hint("merge"), "chunk_id", "left")
        rows, terms, vector = both.select(name, *both.columns), F.col("terms"), F.col("vector")
    else:
        rows = files.kept(spark, "packed", [f"{d}/documents.parquet"], lambda: W.packed(chunks))
        mean = W.mean_size(rows.where("size > 0"))
        # once for a row; in the function it would be worked out for each term
        rows = rows.withColumn("part", W.length_part(F.col("size"), mean))
        weighted = F.arrays_zip(F.col("words").alias("term"), F.transform("counts", lambda n: W.weight(n, F.col("part"))).alias("weight"))
        some = F.col("chunk_id").isNotNull() & (F.col("size") > 0)
        rows, terms, vector = rows.select(name, *rows.columns), F.when(some, weighted), F.when(some, F.transform("tf", lambda x: x / F.col("norm")))
    return rows, [*map(F.col, columns), F.coalesce(terms, F.array().cast(TERMS)).alias("terms"), F.coalesce(vector, F.array().cast(VECTOR)).alias("vector")]


def index_create(spark, d):
    """The index is created once: where there is one, creating it again leaves its points alone."""
    path = files.scratch(spark, "index")
    n_before = W.ensure_index(spark, path, "chunk_id bigint, work_id string").count()
    RQ._chunks(spark, d).select("chunk_id", "work_id").write.mode("append").parquet(path)
    again = W.ensure_index(spark, path, "chunk_id bigint, work_id string")
    return again.groupBy("work_id").agg(F.count("*").alias("n_chunks")).withColumn("n_before", F.lit(n_before).cast("bigint"))


def index_job(spark, d):
    """Load, normalise, weigh, embed and upsert by point id, twice over; what the index then holds, by work."""
    points, columns = _points(spark, d)
    index = KeyedTable.create(spark, files.scratch(spark, "index"), points.select(*columns).schema, ["point_id"])
    for rows in (points.where("chunk_id % 2 = 0"), points, points):
        index.upsert(rows, made=columns)
        # no one reads the index yet
        index.vacuum()
    back = index.read()
    return back.groupBy("work_id").agg(F.count("*").alias("n_points"), F.count_distinct("point_id").alias("n_ids"), F.sum(F.size("terms")).cast("bigint").alias("n_postings"), F.sum(F.size(F.filter("vector", lambda x: x != 0))).cast("bigint").alias("n_entries"))


def batch_index(spark, d):
    """Dense and sparse parts of each point, side by side."""
    points, columns = _points(spark, d)
    return points.select(*columns).select("chunk_id", F.size("terms").cast("bigint").alias("n_terms"), F.size(F.filter("vector", lambda x: x != 0)).cast("bigint").alias("n_dims"))


def sink_paragraph_map(spark, d):
    path = files.scratch(spark, "map")
    files.write_json(MP._lines(spark, d).select("work_id", "paragraph_id", "text"), path)
    return files.read_json(spark, path, "paragraph_id string, text string, work_id string")


def sink_works(spark, d):
    path = files.scratch(spark, "works")
    files.write_json(MP.corpus_parse(spark, d), path)
    return files.read_json(spark, path, "work_id bigint, n_paragraphs bigint, n_words bigint, n_sections bigint")


def sink_chunks(spark, d):
    path = files.scratch(spark, "chunks")
    files.write_json(MP._chunks(spark, d).select("work_id", "section", "chunk_id", "text", "word_count"), path)
    return files.read_json(spark, path, "work_id string, section bigint, chunk_id string, text string, word_count bigint").select("work_id", "section", "chunk_id", "word_count", F.md5("text").alias("md5"))


def scan_chunks(spark, d):
    """Chunks from JSON files, counted by work."""
    path = files.scratch(spark, "scanned")
    files.write_json(MP._chunks(spark, d).select("work_id", "chunk_id", "paragraph_ids", "word_count"), path)
    back = files.read_json(spark, path, "work_id string, chunk_id string, paragraph_ids array<string>, word_count bigint")
    return back.groupBy("work_id").agg(F.count("*").alias("n_chunks"), F.sum(F.size("paragraph_ids")).cast("bigint").alias("n_paragraphs"), F.sum("word_count").alias("n_words"))


def sink_stems(spark, d):
    path = files.scratch(spark, "stems")
    chunks = RQ._chunks(spark, d)
    lists = N.stem_lists(chunks, T.tokens(F.col("text")))
    files.write_json(chunks.select("work_id", "chunk_id").join(lists.hint("merge"), "chunk_id").select("work_id", "chunk_id", "tokens"), path)
    back = files.read_json(spark, path, "work_id string, chunk_id bigint, tokens array<struct<text:string,stem:string>>")
    return back.select("chunk_id", F.size("tokens").cast("bigint").alias("n"), F.md5(F.array_join(F.transform("tokens", lambda t: t["stem"]), " ")).alias("md5"))


def sink_lemmas(spark, d):
    """Tokens of each chunk with lemma and part of speech from the lexicon; unknown forms are their own lemma."""
    path = files.scratch(spark, "lemmas")
    chunks = RQ._chunks(spark, d).select(F.struct("work_id", "chunk_id").alias("of"), "text")
    files.write_json(N.lemma_lists(chunks, RQ._lexicon(spark, d), "of").select("of.*", "tokens"), path)
    back = files.read_json(spark, path, "work_id string, chunk_id bigint, tokens array<struct<text:string,lemma:string,pos:string>>")
    joined = lambda f: F.md5(F.array_join(F.transform("tokens", lambda t: t[f]), " "))
    return back.select("chunk_id", F.size("tokens").cast("bigint").alias("n"), joined("lemma").alias("md5"), joined("pos").alias("pos_md5"))


QUERIES = {f.__name__: f for f in (generate_answers, generate_with_fallback, judge_chunks, score_outcome, index_create, index_job, batch_index, sink_paragraph_map, sink_works, sink_chunks, scan_chunks, sink_stems, sink_lemmas)}

_HEAD = "'L''extrait répond-il à la question ? Réponds en JSON: label, justification.'"
_SPLIT = lambda x: f"list_distinct(list_filter(string_split_regex(lower({x}), '{S.BLANK}'), lambda x: x <> ''))"
_EV = f"""ev AS (SELECT a.conv_id * 1000 + a.turn AS query_id, u.turn AS rank, CAST(u.conv_id AS VARCHAR) || '_c' || CAST(u.turn AS VARCHAR) AS chunk_id, a.text AS question, u.text AS text FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id WHERE a.role = 'assistant' AND u.role = 'user'),
se AS (SELECT query_id, rank, chunk_id, question, unnest(CASE WHEN len(s) = 0 THEN [NULL] ELSE s END) AS s, unnest(range(0, greatest(len(s), 1))) AS i FROM (SELECT *, list_filter(list_transform(string_split_regex(text, '[.!?\\n]+'), lambda s: trim(s)), lambda s: s <> '') AS s FROM ev)),
bs AS (SELECT query_id, rank, chunk_id, s, i, len(list_intersect(list_distinct({S.tokens('s')}), list_distinct({S.tokens('question')}))) AS n FROM se),
top AS (SELECT * FROM bs QUALIFY row_number() OVER (PARTITION BY query_id, rank ORDER BY n DESC, i) = 1)"""
ORACLES = {
    "generate_answers": f"WITH {_EV} SELECT query_id, string_agg(coalesce(s, '') || ' [' || chunk_id || ']', chr(10) ORDER BY rank) AS answer FROM top GROUP BY query_id",
    "generate_with_fallback": "SELECT CASE WHEN length(coalesce(text, '')) > 2000 THEN 'fallback' ELSE 'primary' END AS model, count(*) AS n, CAST(sum(least(length(coalesce(text, '')), 20)) AS BIGINT) AS chars FROM documents GROUP BY 1",
    "judge_chunks": f"""WITH {RQ._CH}, h AS (SELECT query_id, chunk_id, {_HEAD} || chr(10) || chr(10) || 'Question: ' || q.text AS asked, d.text AS there FROM sparse JOIN {S.ITEMS} q USING (query_id) JOIN documents d ON doc_id = chunk_id WHERE rank <= 5),
 p AS (SELECT *, length(asked || chr(10) || chr(10) || 'Extrait: ' || there) % 9 = 0 AS again FROM h),
 w AS (SELECT query_id, chunk_id, again, {_SPLIT('asked')} AS a, {_SPLIT("CASE WHEN again THEN there || chr(10) || 'Réponds seulement en JSON.' ELSE there END")} AS t FROM p),
 s AS (SELECT *, CAST(len(list_intersect(a, t)) AS DOUBLE) / greatest(len(a), 1) AS share FROM w)
 SELECT CAST(query_id AS VARCHAR) || ':' || CAST(chunk_id AS VARCHAR) AS id, CASE WHEN share > 0.5 THEN 'pertinent' WHEN share > 0.2 THEN 'partiellement pertinent' ELSE 'non pertinent' END AS label, 'part commune ' || printf('%.2f', share) AS justification, true AS valid, CASE WHEN again THEN 2 ELSE 1 END AS attempts FROM s""",
    "score_outcome": f"""WITH {_EV}, both_modes AS (SELECT 'given' AS mode, * FROM top UNION ALL SELECT 'end_to_end', * FROM top WHERE rank < 2),
 ans AS (SELECT mode || ':' || CAST(query_id AS VARCHAR) AS answer_id, string_agg(coalesce(s, '') || ' [' || chunk_id || ']', chr(10) ORDER BY rank) AS answer FROM both_modes GROUP BY ALL),
 st AS (SELECT answer_id, list_filter(list_transform(string_split_regex(regexp_replace(answer, '\\[[^\\[\\]]*\\]', '', 'g'), '[.!?\\n]+'), lambda s: trim(s)), lambda s: s <> '') AS s FROM ans),
 cl AS (SELECT answer_id, i, list_distinct({S.tokens('s[i]')}) AS t FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM st)),
 ct AS (SELECT answer_id, i, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS token FROM cl),
 tm AS (SELECT DISTINCT mode || ':' || CAST(query_id AS VARCHAR) AS answer_id, unnest({S.tokens('text')}) AS token FROM (SELECT 'given' AS mode, * FROM ev UNION ALL SELECT 'end_to_end', * FROM ev WHERE rank < 2)),
 vd AS (SELECT ct.answer_id, i, count(tm.token) / greatest(count(ct.token), 1) >= 0.5 AS supported FROM ct LEFT JOIN tm ON tm.answer_id = ct.answer_id AND tm.token = ct.token GROUP BY ct.answer_id, i)
 SELECT ans.answer_id, round(avg(CAST(supported AS INTEGER)), 6) AS faithfulness, count(supported) AS n_claims FROM ans LEFT JOIN vd USING (answer_id) GROUP BY ans.answer_id""",
    "index_create": "SELECT source AS work_id, count(*) AS n_chunks, CAST(0 AS BIGINT) AS n_before FROM documents GROUP BY source",
    "index_job": f"WITH {RQ._CH}, a AS (SELECT chunk_id, count(*) AS n FROM posts GROUP BY chunk_id), b AS (SELECT chunk_id, count(*) AS n FROM hvn GROUP BY chunk_id) SELECT source AS work_id, count(*) AS n_points, count(*) AS n_ids, CAST(sum(coalesce(a.n, 0)) AS BIGINT) AS n_postings, CAST(sum(coalesce(b.n, 0)) AS BIGINT) AS n_entries FROM documents LEFT JOIN a ON a.chunk_id = doc_id LEFT JOIN b ON b.chunk_id = doc_id GROUP BY source",
    "batch_index": f"WITH {RQ._CH}, a AS (SELECT chunk_id, count(*) AS n FROM posts GROUP BY chunk_id), b AS (SELECT chunk_id, count(*) AS n FROM hvn GROUP BY chunk_id) SELECT doc_id AS chunk_id, coalesce(a.n, 0) AS n_terms, coalesce(b.n, 0) AS n_dims FROM documents LEFT JOIN a ON a.chunk_id = doc_id LEFT JOIN b ON b.chunk_id = doc_id",
    "sink_paragraph_map": f"WITH {MP._LN} SELECT CAST(section AS VARCHAR) || '_p' || CAST(index AS VARCHAR) AS paragraph_id, text, work_id FROM lines",
    "sink_works": MP.ORACLES["corpus_parse"],
    "sink_chunks": f"{MP._CK} SELECT work_id, section, work_id || '_c' || CAST(row_number() OVER (PARTITION BY work_id ORDER BY section, g) AS VARCHAR) AS chunk_id, word_count, md5(text) AS md5 FROM ck",
    "scan_chunks": f"{MP._FM} SELECT work_id, count(DISTINCT section * 1000000 + g) AS n_chunks, count(*) AS n_paragraphs, CAST(sum(words) AS BIGINT) AS n_words FROM merged GROUP BY work_id",
    "sink_stems": f"WITH {S.stem_lists()} SELECT doc_id AS chunk_id, n, md5(s) AS md5 FROM lists",
    "sink_lemmas": f"WITH p AS (SELECT unnest({S.tokens('p_name')}) AS token FROM part), lex AS {S.stems('p')}, t AS (SELECT doc_id, {S.tokens('text')} AS t FROM documents), w AS (SELECT doc_id, t[i] AS form, i FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM t)), l AS (SELECT doc_id, string_agg(coalesce(stem, form), ' ' ORDER BY i) AS lemmas, string_agg(CASE WHEN token IS NULL THEN 'X' ELSE 'NOUN' END, ' ' ORDER BY i) AS pos FROM w LEFT JOIN lex ON token = form GROUP BY doc_id) SELECT t.doc_id AS chunk_id, CAST(len(t) AS BIGINT) AS n, md5(coalesce(lemmas, '')) AS md5, md5(coalesce(pos, '')) AS pos_md5 FROM t LEFT JOIN l ON l.doc_id = t.doc_id",
}
