"""Small exact cases: ranks and metrics, markup and pages, chunks, fusion, checks, history."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import checks, chunking, evaluation, history, markup, models, retrieval, signals
from quillon.plans import signals as signal_plans
from quillon.sources import files

NONE = "page non numérotée"
SAMPLE = (
    '<text><front><pb/><pb n="1"/><head>T<pb n="2"/></head><p>alpha</p><head>U</head><p>be<pb n="3"/>ta <i>x</i></p></front>'
    '<body><div type="chapter"><p> </p></div><div type="chapter"><p>gam<pb/>ma</p><lg><l>v1</l><l>v2</l></lg><pb n="5"/></div><div type="chapter"><head>Z</head><p>delta</p></div></body></text>'
)


@pytest.fixture(scope="module")
def sample(spark):
    marked = markup.annotated(markup.token_stream(spark.createDataFrame([("m", SAMPLE)], "work_id string, markup string"))).cache()
    return marked, markup.paragraphs(marked)


def test_pages_carry_over(sample):
    rows = sample[1].orderBy("index").collect()
    assert [(r.text, r.page_start, r.page_end) for r in rows] == [
        ("alpha", "1", "1"), ("beta x", "1", "3"), ("gamma", "3", "entre les p. 3 et 5"), ("v1v2", "entre les p. 3 et 5", "entre les p. 3 et 5"), ("delta", "5", "5"),
    ]
    assert [r.paragraph_id for r in rows] == [f"m_p{k}" for k in range(1, 6)]


def test_sections_keep_their_numbers(sample):
    got = [(r.section, r.region, r.label) for r in markup.sections(*sample).orderBy("section").collect()]
    assert got == [(1, "front", "T"), (2, "front", "U"), (4, "body", "Chapitre 2"), (5, "body", "Z")]
    assert markup.sections(*sample, keep_empty=True).where("section = 3").first().label == "Chapitre 1"


def test_unnumbered_page_before_the_first(spark):
    w = spark.createDataFrame([("a", '<text><body><pb/><pb/><p>x</p><pb n="1"/></body></text>'), ("b", "<text><body><pb/><p>x</p></body></text>")], "work_id string, markup string")
    m = markup.annotated(markup.token_stream(w)).where("is_pb and page_no is null")
    assert {(r.work_id, r.label) for r in m.collect()} == {("a", "avant la p. 1"), ("b", "page non numérotée")}


def test_header_and_missing_text(spark):
    w = spark.createDataFrame([("a", "<TEI><teiHeader><titleStmt><title>A  &amp; <hi>b</hi></title><title>C</title></titleStmt></teiHeader></TEI>")], "work_id string, markup string")
    r = markup.header(w).first()
    assert (r.title, r.alt_titles, r.has_text, r.source_desc) == ("A & b", ["C"], False, "")


def chunks(spark, sizes):
    p = spark.createDataFrame([("w", 1, k, n, f"p{k}", "t") for k, n in enumerate(sizes)], "work_id string, section int, index bigint, words bigint, paragraph_id string, text string")
    return [r.g for r in chunking.grouped(p).orderBy("index").collect()]


def test_chunks(spark):
    assert chunks(spark, [200, 200, 200, 100]) == [0, 0, 0, 1]
    assert chunks(spark, [100, 751, 100]) == [0, 1, 2]
    assert chunks(spark, [500, 79]) == [0, 0] and chunks(spark, [500, 80]) == [0, 1] and chunks(spark, [10]) == [0]
    assert chunks(spark, [750, 751, 79]) == [0, 1, 1]


def test_chunks_of_a_long_section_in_blocks(spark):
    """One section of 200,000 paragraphs beside short ones, folded in blocks, against the plain fold."""
    n = 200_000
    size = F.pmod(F.xxhash64("index"), F.lit(1000))
    words = F.when(size < 5, 751 + size).when(size < 60, 400).otherwise(size % 90)
    long = spark.range(n).select(F.lit("w").alias("work_id"), F.lit(1).alias("section"), (F.col("id") * 3).alias("index")).withColumn("words", words)
    short = spark.createDataFrame([("w", 2, k, 90) for k in range(20)] + [("v", 1, 10_000 * k, 300) for k in range(7)], "work_id string, section int, index bigint, words bigint")
    every = long.unionByName(short)
    want = {}
    for r in sorted(every.collect()):
        want.setdefault((r.work_id, r.section), []).append(r)
    got = {(r.work_id, r.section, r["index"]): r.g for r in chunking.grouped(every, merge=False).collect()}
    assert len(got) == n + 27
    for (w, s), rows in want.items():
        g, total = 0, 0
        for r in rows:
            if r.words > 750:
                g += total > 0
            assert got[w, s, r["index"]] == g
            total += r.words
            if r.words > 750 or total >= 500:
                g, total = g + 1, 0
    small = {(r.work_id, r.section, r["index"]): r.g for r in chunking.grouped(short, block=3, trailing=100).collect()}
    assert small == {(r.work_id, r.section, r["index"]): r.g for r in chunking.grouped(short, trailing=100).collect()}
    assert chunking.grouped(short.limit(0)).count() == 0


def ranks(spark, hits, gold):
    h = spark.createDataFrame([("i", c, k + 1) for k, c in enumerate(hits)], "item_id string, chunk_id string, rank int")
    g = spark.createDataFrame([("i", c) for c in gold], "item_id string, chunk_id string")
    return evaluation.hit_ranks(spark.createDataFrame([("i",)], "item_id string"), h, g, ["item_id"]).first().hit_rank


def test_hit_rank(spark):
    assert ranks(spark, ["x", "y", "a_c1", "z"], ["a_c1"]) == 3 and ranks(spark, ["x", "y"], ["a_c1"]) is None
    assert ranks(spark, ["x", "b_c2"], ["b_c1", "b_c2"]) == 2 and ranks(spark, ["b_c1", "x"], ["b_c1", "b_c2"]) == 1


def test_metrics_and_breakdown(spark):
    r = spark.createDataFrame([("factuel", 1), ("définitionnel", None)], "category string, hit_rank bigint")
    m = r.agg(*evaluation.measures()).first()
    assert (m.n, m.recall_at_1, m.recall_at_10, m.mrr) == (2, 0.5, 0.5, 0.5)
    by = {x.value: x.recall_at_1 for x in evaluation.report(r, ["category"], overall=False).collect()}
    assert by == {"factuel": 1.0, "définitionnel": 0.0}
    none = r.limit(0).agg(*evaluation.measures()).first()
    assert (none.n, none.recall_at_1, none.mrr) == (0, 0.0, 0.0)


def test_runs_are_compared_by_fingerprints(spark):
    rows = [(k % 50, f"t{k}" if k % 7 else None, None if k % 5 else k) for k in range(3000)] + [(1, "x", 2)] * 3
    schema = "a int, b string, c int"
    one = spark.createDataFrame(rows, schema).repartition(3)
    assert evaluation.differences(one, spark.createDataFrame(rows[::-1], schema).repartition(5)).count() == 0
    other = [*rows[:10], (rows[10][0], None, 99), *rows[11:-1], (4, None, None), (None, None, 4)]
    got = evaluation.differences(one, spark.createDataFrame(other, schema).select("c", "b", "a")).collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(a=r[0], b=r[1], c=r[2], run=run)) for r, run in [(rows[10], "first"), (rows[-1], "first"), (other[10], "second"), ((4, None, None), "second"), ((None, None, 4), "second")])
    assert evaluation.differences(one.limit(0), one.limit(0)).count() == 0 and evaluation.differences(one, one.limit(0)).count() == len(rows)


def test_fusion_ranks_from_zero_and_ties_go_to_smaller_ids(spark):
    one = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, chunk_id string, rank int")
    assert abs(retrieval.rrf_fuse(one, k=60).where("chunk_id = 'a'").first().score - 1 / 60) < 1e-12
    tied = spark.createDataFrame([("q", "c", 0.5), ("q", "b", 0.5), ("q", "a", 0.1)], "query_id string, chunk_id string, score double")
    assert [r.chunk_id for r in retrieval.top(tied, 1).collect()] == ["b"]


def test_rerank_keeps_the_fused_score(spark):
    s = spark.createDataFrame([("q", "a", 1, 0.5, 0.1), ("q", "b", 2, 0.01, 0.9)], "query_id string, chunk_id string, rank int, score double, rerank_score double")
    assert [(r.chunk_id, r.rrf_score) for r in retrieval.rerank(s, 5).orderBy("rank").collect()] == [("b", 0.01), ("a", 0.5)]
    assert retrieval.rerank(s.limit(0), 5).count() == 0


def test_dense_search_equals_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(300, 8))
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "chunk_id long, vector array<double>")
    q = v.where("chunk_id < 7").select(F.col("chunk_id").alias("query_id"), "vector")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, int(c), k + 1) for i in range(7) for k, c in enumerate(np.argsort(-(u @ u[i]))[:5])}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in retrieval.dense_topk(q, v, 5).collect()} == want


def test_dense_search_skips_cells_and_loses_nothing(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    heads = rng.normal(size=(12, 6)) * 4
    x = np.concatenate([heads[k] + rng.normal(size=(80, 6)) * 0.1 for k in range(12)])
    x = np.concatenate([x, x[:3], np.zeros((1, 6))])
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0] * 6), (5000, None), (5001, []), (5002, [1.0, None] * 3), (5003, [nan] * 6), (5004, [inf] * 6), (5005, [1.0, 2.0]), (5006, [2.0, 1.0]), (5007, [1.0])]
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)] + odd, "chunk_id long, vector array<double>").repartition(3)
    asked = {0: x[5], 1: x[500] + 0.05, 2: np.zeros(6), 3: rng.normal(size=6)}
    rows = [(k, q.tolist()) for k, q in asked.items()] + [(None, [1.0] * 6), (9, None), (10, [1.0, 1.0]), (11, [1.0] * 4)]
    q = spark.createDataFrame(rows, "query_id long, vector array<double>")

    def unit(a):
        n = np.linalg.norm(a, axis=-1, keepdims=True)
        return a / np.where(n > 0, n, 1)

    want = set()
    for k, a in asked.items():
        cos = np.round(unit(x) @ unit(a), 9)
        want |= {(k, int(c), r + 1) for r, c in enumerate(np.lexsort((np.arange(len(x)), -cos))[:7])}
    want |= {(10, 5005, 1), (10, 5006, 2)}
    cells = retrieval.Cells(v)
    got = {(r.query_id, r.chunk_id, r["rank"]) for r in retrieval.dense_topk(q, v, 7, cells).collect()}
    assert got == want
    units = retrieval.units(q.where("query_id = 0"), "query_id")
    near = cells.near(units, 7, False).count() + cells.near(units.withColumn("reach", F.lit(0.2)), 7, True).count()
    assert near < len(cells.sizes) / 2
    assert retrieval.dense_topk(q.limit(0), v, 3).count() == 0 and retrieval.dense_topk(q, v.limit(0), 3).count() == 0


def test_sparse_search_passes_over_frequent_terms(spark):
    """The same hits as by all postings; postings of a term that every chunk has aren't joined."""
    import random

    rng = random.Random(3)
    posts = [(c, "the", round(0.5 + rng.random(), 3)) for c in range(3000)]
    posts += [(c, f"mid{rng.randrange(40)}", round(0.5 + rng.random(), 3)) for c in range(3000)]
    posts += [(rng.randrange(3000), f"rare{k % 30}", round(1 + rng.random(), 3)) for k in range(600)]
    posts = spark.createDataFrame(sorted({(c, t): w for c, t, w in posts}.items()), "k struct<c:long,t:string>, weight double").selectExpr("k.c AS chunk_id", "k.t AS term", "weight")
    df = posts.groupBy("term").count().collect()
    idf = spark.createDataFrame([(r.term, math.log(1 + (3000 - r["count"] + 0.5) / (r["count"] + 0.5))) for r in df], "term string, idf double")
    asked = [(1, "the"), (1, "rare3"), (1, "mid5"), (2, "the"), (3, "rare7"), (3, "rare8"), (3, "the"), (4, "absent"), (5, "mid1"), (5, "mid2"), (5, "the"), (3, "the")]
    queries = spark.createDataFrame(asked, "query_id long, term string")
    every = queries.join(posts, "term").join(idf, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("weight") * F.col("idf")).alias("score"))
    for limit in (1, 5, 12):
        rows = lambda d: {(r.query_id, r.chunk_id, r["rank"], round(r.score, 6)) for r in d.collect()}
        assert rows(retrieval.sparse_topk(queries, posts, idf, limit)) == rows(retrieval.top(every, limit))
    wanted, chosen = retrieval.bounded_blocks(queries, posts, idf, retrieval.term_blocks(posts), 5)
    assert chosen.where("term = 'the' and query_id in (1, 3)").count() == 0 and chosen.where("term = 'the' and query_id = 2").count() > 0
    joined = posts.withColumn("block", retrieval.block_of(F.col("weight"))).join(chosen, ["term", "block"]).count()
    assert joined < 0.5 * posts.join(wanted, "term").count()


def test_citations(spark):
    df = spark.createDataFrame([("Oui [9999_XX_c1; a , b] et [a].",), ("rien",), (None,)], "answer string").select(checks.citations(F.col("answer")).alias("c"))
    cited = [r.c for r in df.collect()]
    assert cited == [["9999_XX_c1", "a", "b"], [], []]
    s = checks.structure(F.col("c"), F.array(F.lit("a"), F.lit("b")))
    rows = df.select(s["unknown"].alias("u"), s["has_citation"].alias("h"), s["passed"].alias("p")).collect()
    assert rows[0].u == ["9999_XX_c1"] and not rows[0].p and not rows[1].h and not rows[1].p


def test_judgments_and_quotes(spark):
    raw = ['x {"label": "pertinent",\n"justification": " oui "} y', '{"label": "autre", "justification": "a"}', '{"label": "pertinent", "justification": " "}', "rien", None]
    got = [r.j for r in spark.createDataFrame([(x,) for x in raw], "raw string").select(checks.parse_judgment(F.col("raw")).alias("j")).collect()]
    assert [g.valid for g in got] == [True, False, False, False, False] and got[0].justification == "oui"
    q = spark.createDataFrame([("un Mot ici", " mot "), ("un Mot ici", "Mot"), ("un", "  "), ("un", "deux"), ("un", None)], "a string, q string")
    assert [r[0] for r in q.select(checks.ground_quote(F.col("q"), F.col("a"))).collect()] == ["Mot", "Mot", None, None, None]


def test_highlights_prefer_longer_quotes(spark):
    q = spark.createDataFrame([("a", "Un deux trois quatre", x) for x in ("DEUX trois", "trois quatre!", "trois quatre", "un", "absent", None)], "answer_id string, answer string, quote string")
    assert sorted((r.start, r.end) for r in checks.highlight(q).collect()) == [(0, 2), (8, 20)]


def test_signals(spark):
    e = spark.createDataFrame([("s", 1, "a", "w2", 0.6), ("s", 2, "b", "w1", 0.1), ("one", 1, "a", "w1", None)], "set_id string, pos int, chunk_id string, work_id string, rerank_score double")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "chunk_id string, vector array<double>")
    r = {x.set_id: x for x in signals.signals(e, v).collect()}
    assert abs(r["s"].convergence - math.sqrt(0.5)) < 1e-9 and r["s"].works == ["w1", "w2"] and r["s"].tier == "élevée" and r["s"].is_convergent
    assert r["one"].convergence is None and r["one"].is_convergent and r["one"].tier == "moyenne" and not r["one"].is_multi_work


def test_history(spark):
    turns = spark.createDataFrame([(10, 1), (20, 2)], "turn_id long, conversation_id long")
    conv = spark.createDataFrame([(1,), (2,)], "conversation_id long")
    req = spark.createDataFrame([(1, 10, None), (2, 99, None), (3, None, 2), (4, None, None), (5, None, 7), (6, None, None)], "request_id long, turn_id long, conversation_id long")
    got = {r.request_id: (r.status, r.conversation_id, r.turn_id) for r in history.resolve_turns(req, turns, conv).collect()}
    assert got == {1: ("existing", 1, 10), 2: ("rejected", None, None), 3: ("new_turn", 2, 21), 4: ("new_conversation", 3, 22), 5: ("rejected", None, None), 6: ("new_conversation", 4, 23)}
    old = spark.createDataFrame([(1, "A"), (1, "B"), (2, "C")], "turn_id long, chunk string")
    new = spark.createDataFrame([(1, "D")], "turn_id long, chunk string")
    assert {tuple(r) for r in history.replaced(old, new, "turn_id").collect()} == {(1, "D"), (2, "C")}
    once = history.upserted(old, new, ["turn_id"])
    assert {tuple(r) for r in history.upserted(once, new, ["turn_id"]).collect()} == {tuple(r) for r in once.collect()}


def test_upserts_touch_their_buckets_alone(spark, tmp_path, monkeypatch):
    import os

    from quillon.sources.keyed import KeyedTable

    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(k if k else None, f"a{k}", [k]) for k in range(100)], "id long, text string, parts array<int>")
    t = KeyedTable.create(spark, path, rows.schema, ["id"], buckets=8)
    assert t.read().count() == 0 and len(t.upsert(rows)) == 8
    files_of = lambda: {os.path.join(at, f): os.path.getmtime(os.path.join(at, f)) for at, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")}
    before = files_of()
    change = spark.createDataFrame([(7, "new", [1]), (7, "newer", [0]), (None, "null", None), (200, "more", [2])], "id long, text string, parts array<int>")
    touched = t.upsert(change)
    assert 1 <= len(touched) <= 3 and before.items() <= files_of().items()
    want = {k: f"a{k}" for k in range(1, 100)} | {7: "newer", None: "null", 200: "more"}
    assert {r.id: r.text for r in t.read().collect()} == want == {r.id: r.text for r in KeyedTable(spark, path).read().collect()}
    assert t.read().count() == 101
    t.upsert(change)
    assert {r.id: r.text for r in t.read().collect()} == want
    # a run that is lost before its manifest leaves the table as it was, and can be made again
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            KeyedTable(spark, path).upsert(rows)
    again = KeyedTable.create(spark, path, rows.schema, ["id"])
    assert {r.id: r.text for r in again.read().collect()} == want
    # of two writers the later one fails
    again.delete(change.where("id = 7"))
    with pytest.raises(RuntimeError, match="another writer"):
        t.upsert(rows)
    again.vacuum()
    assert {r.id: r.text for r in KeyedTable(spark, path).read().collect()} == {k: v for k, v in want.items() if k != 7}
    ordered = KeyedTable.create(spark, f"file://{tmp_path}/o", spark.range(0).selectExpr("id", "1L AS at").schema, ["id"])
    ordered.upsert(spark.createDataFrame([(1, 5), (1, 9), (2, 3)], "id long, at long"), "at")
    assert {tuple(r) for r in ordered.read().collect()} == {(1, 9), (2, 3)}


def test_text_functions(spark):
    df = spark.createDataFrame([("  a   b\n c ",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(T.clean_text(F.col("x"))).collect()] == ["a b c", "", None]
    assert [r[0] for r in df.select(T.word_count(F.col("x"))).collect()] == [3, 0, 0]
    one = spark.range(1)
    assert one.select(T.uuid5(uuid.NAMESPACE_URL.hex, F.lit("chunk/1"))).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk/1"))
    assert one.select(T.three_decimals(F.lit(float("nan"))), T.nan_to_null(F.lit(float("nan"))), T.share_text(F.lit(1), F.lit(0)), T.rank_change(F.lit(None).cast("int"), F.lit(3), 10)).first()[:] == ("nan", None, "n/a", "+8")
    assert one.select(T.derive_title(F.lit("mot " * 20))).first()[0] == "mot mot mot mot mot mot mot mot mot mot…"


def test_checkpoints_keep_the_latest_line(spark):
    path = files.scratch(spark, "ck")
    rows = spark.createDataFrame([(1, None, "m", 1, 0.5), (2, "k", "m", 2, float("nan"))], "batch long, key string, mode string, item_id long, score double")
    files.append_checkpoint(rows, path)
    files.append_checkpoint(rows.where("batch = 1").withColumn("batch", F.lit(3)).withColumn("score", F.lit(0.9)), path)
    got = {r.key: r.score for r in files.read_checkpoint(spark, path, "batch long, key string, mode string, item_id long, score double").collect()}
    assert got["m:1"] == 0.9 and math.isnan(got["k"])


def test_failed_prompts_go_to_the_second_model(spark):
    p = spark.createDataFrame([(1, "a"), (2, "bb")], "id long, prompt string")
    out = models.with_fallback(p, lambda: lambda ps: [ValueError("no") if len(x) > 1 else x for x in ps], lambda: lambda ps: [x.upper() for x in ps])
    assert {(r.id, r.answer, r.model) for r in out.collect()} == {(1, "a", "primary"), (2, "BB", "fallback")}


def test_judge_prompt_reaches_every_item(spark, tmp_path):
    spark.createDataFrame([(k, f"question {k}") for k in range(90)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, f"passage {k}") for k in range(200)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = signal_plans.judge_prompt(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(200)) and {r.item_id for r in rows} == set(range(90))
    assert all(f"question {r.item_id}" in r.prompt and f"passage {r.doc_id}" in r.prompt for r in rows)


def test_convergence_reads_every_vector(spark, tmp_path):
    n = 2000
    spark.createDataFrame([(k, [1.0, float(k)]) for k in range(n)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    lines = [(k // 2, k % 2 + 1, k, 1, 0.1, "N") for k in range(2800)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.set_id: r.convergence for r in signal_plans.convergence(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(n // 2))
    for s, c in got.items():
        a, b = 2 * s, 2 * s + 1
        assert abs(c - (1 + a * b) / math.sqrt((1 + a * a) * (1 + b * b))) < 2e-6


def test_decimals_of_the_exact_value(spark):
    xs = [0.5005, 0.058499999999999996, 0.0625, 0.1875, 1e9 + 0.0005, 0.9995, 99.95, 0.0, -1.2345, -0.0004, float("nan"), *(k / 2000 for k in range(300)), *(k / 64 for k in range(200))]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", T.fixed(F.col("x"), 3).alias("a"), T.fixed(F.col("x"), 1).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(f"{r.x:.3f}", f"{r.x:.1f}") for r in rows]


def test_ranks_by_range(spark):
    rows = spark.createDataFrame([(k % 3 if k % 5 else None, (k * 37) % 101, "x", "y") for k in range(100)], "g int, o int, part string, at string").repartition(7)
    from quillon.operators.ranks import ranked

    got = ranked(rows, ["o"], "g", "n").collect()
    for g in (None, 0, 1, 2):
        assert [r.n for r in sorted((r for r in got if r.g == g), key=lambda r: r.o)] == list(range(1, sum(r.g == g for r in got) + 1))
    assert [r.n for r in sorted(ranked(rows, ["o"], name="n").collect(), key=lambda r: r.o)] == list(range(1, 101)) and got[0].part == "x"
    assert ranked(rows.limit(0), ["o"]).count() == 0


def test_short_passages_are_found(spark):
    docs = spark.createDataFrame([(1, "le chat dort ici ce soir"), (2, "un achat dortoir"), (3, "rien"), (4, None), (5, "chat dort encore")], "chunk_id long, text string")
    items = spark.createDataFrame([(1, "chat dort"), (2, "chat"), (3, "le chat dort ici ce soir"), (4, "chat dort encore"), (5, ""), (6, None), (7, "hat dort ici c")], "item_id long, text string")
    want = {(i, d) for i, t in items.collect() for d, x in docs.collect() if t and x and t in x}
    assert {tuple(r) for r in evaluation.passages_in(docs, items).collect()} == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert evaluation.passages_in(docs, none).count() == 0 and evaluation.passages_in(docs.limit(0), items).count() == 0


def test_passages_by_their_rarest_window(spark):
    """A window of every document is joined with no item; no plan explodes beside a text."""
    common = "the same five words again "
    docs = spark.createDataFrame([(k, common + f"start{k} of number{k} here") for k in range(50)] + [(60, common + "start7 of number7 hereafter"), (61, "x" + common + "start7 of number7 here")], "chunk_id long, text string")
    items = spark.createDataFrame([(1, common + "start7 of number7 here"), (2, common + "start99 of number7 here"), (3, "same five words again start8 of"), (4, "ar"), (5, "t7 of")], "item_id long, text string")
    want = {(i, d) for i, t in items.collect() for d, x in docs.collect() if t in x}
    assert {tuple(r) for r in evaluation.passages_in(docs, items).collect()} == want and len(want) > 55
    met = evaluation._by_windows(docs, items.where("item_id < 4").select("item_id", T.tokens(F.col("text")).alias("t")), 5)
    assert met.where("item_id = 1").count() == 3 and met.where("item_id = 2").count() == 0 and met.where("item_id = 3").count() == 1


def test_regions_references_and_prefixes(spark):
    w = spark.createDataFrame([("a", '<TEI><teiHeader/><text><back><p>c &#xE9;</p></back><tei:body><pb n="2"/><p>b &amp;#233; &#233;</p></tei:body><front><pb n="1"/><p>a &lt; &#55296;</p></front></text></TEI>'), ("b", "<TEI/>"), ("c", None)], "work_id string, markup string")
    rows = markup.paragraphs(markup.annotated(markup.token_stream(w.where("work_id = 'a'")))).orderBy("index").collect()
    assert [(r.text, r.page_start) for r in rows] == [("a < &#55296;", "1"), ("b &#233; é", "2"), ("c é", "2")]
    taken, rejected = markup.with_text(w)
    assert [r.work_id for r in taken.collect()] == ["a"] and sorted(r.work_id for r in rejected.collect()) == ["b", "c"]
    assert [r.n for r in spark.createDataFrame([("<tei:p n='1'>",), ("</p>",), ("<lg/>",)], "t string").select(markup.local_name(F.col("t")).alias("n")).collect()] == ["p", "p", "lg"]


def test_markup_as_a_parser_reads_it(spark):
    """CDATA, both quotes, signs of markup in values, prefixes by namespace, comments in texts."""
    books = {
        "a": '<text><body><p a="x>y">un</p><p b=\'<q n="7"/>\'>deux</p></body></text>',
        "b": "<text><body><p><![CDATA[a<b &amp; </p>]]> c</p><p>x<![CDATA[]]>y<!-- > ' -->z</p></body></text>",
        "c": """<text><body><pb ed="n='9'" n='7'/><p>x</p><pb n = "8" /><p>y</p><pb xml:n="3"/><p>z</p></body></text>""",
        "d": """<!DOCTYPE TEI [<!ENTITY a "x>y">]><?xml-model href=">"?><tei:TEI xmlns:tei="http://www.tei-c.org/ns/1.0" xmlns:x='urn:other'><tei:teiHeader><tei:titleStmt><tei:title n="a>b">Un <tei:hi>deux</tei:hi></tei:title><tei:title/></tei:titleStmt><tei:publicationStmt><tei:date when='1900'> 1900 <tei:note>n</tei:note></tei:date></tei:publicationStmt><tei:sourceDesc><tei:p><![CDATA[A & B]]></tei:p></tei:sourceDesc></tei:teiHeader><tei:text><tei:body><tei:p>un</tei:p><x:p>deux</x:p><tei:p>trois</tei:p></tei:body></tei:text></tei:TEI>""",
        "e": "<TEI><teiHeader><titleStmt/></teiHeader><text/></TEI>", "f": "<TEI><!-- <text/> --></TEI>",
    }
    w = spark.createDataFrame(list(books.items()), "work_id string, markup string")
    rows = markup.paragraphs(markup.annotated(markup.token_stream(w))).orderBy("work_id", "index").collect()
    assert [(r.work_id, r.text, r.page_start) for r in rows if r.work_id != "c"] == [("a", "un", NONE), ("a", "deux", NONE), ("b", "a<b &amp; </p> c", NONE), ("b", "xyz", NONE), ("d", "un", NONE), ("d", "trois", NONE)]
    assert [(r.text, r.page_start) for r in rows if r.work_id == "c"] == [("x", "7"), ("y", "8"), ("z", "après la p. 8")]
    heads = {r.work_id: r for r in markup.header(w, spark.createDataFrame([("e", "Du catalogue"), ("d", "autre")], "work_id string, title string")).collect()}
    assert heads["d"][1:] == (True, "Un deux", [""], "1900", "A & B")
    assert heads["e"][1:] == (True, "Du catalogue", [], "", "") and heads["f"][1:] == (False, "", [], "", "")
    assert sorted(r.work_id for r in markup.with_text(w)[0].collect()) == ["a", "b", "c", "d", "e"]


def test_descriptions_are_cut_before_they_are_folded(spark):
    from quillon.operators import audit

    rows = spark.createDataFrame([("Matin", "HTTP://x matin"), ("Matin", "http://x matin"), ("Matin", "MATIN http://x"), ("le", None), ("Éveil", "l'éveil")], "t string, d string")
    assert [r[0] for r in rows.select(audit.title_matches(F.col("t"), F.col("d"))).collect()] == [True, False, True, True, True]


def test_works_are_read_whole(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<TEI>\n<text/>\n</TEI>")
    (tmp_path / "b.xml").write_text("<TEI/>")
    assert sorted(r.markup for r in markup.read_works(spark, f"file://{tmp_path}").collect()) == ["<TEI/>", "<TEI>\n<text/>\n</TEI>"]


def test_convergence_with_a_vector_of_zeros(spark):
    e = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 1, 3), (2, 2, 4)], "set_id int, pos int, chunk_id int")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "chunk_id int, vector array<double>")
    got = {r.set_id: r.convergence for r in signals.convergence(e, v).collect()}
    assert set(got) == {1} and abs(got[1] - math.sqrt(0.5) / 3) < 1e-9


def test_kept_tables_follow_their_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    build = lambda: spark.read.parquet(path)
    assert files.kept(spark, "k", [path], build).count() == 3
    first = files.kept(spark, "k", [path], lambda: 1 / 0)
    assert first.count() == 3
    spark.range(2).write.mode("append").parquet(path)
    assert files.kept(spark, "k", [path], build).count() == 5
