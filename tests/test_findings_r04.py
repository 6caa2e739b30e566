"""Cases that a reviewer's findings of the fourth round asked for."""

import os

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import retrieval, stemming
from quillon.plans import models, registry
from quillon.sources import files, keyed

from .oracle import assert_same

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_sizes_of_odd_books_are_those_of_the_sql(spark, tmp_path):
    texts = ["", None, "\n", "\n\n", " ", " \n \n ", "a", "a b\n\nc d e f g h i j k l", "é x y z w\n\t\tb", "a ]]> x\nb]]>c\n]]>\nd ]]>", "<script> a b </script> c\n<!-- no --> d\n<style>&amp; &#233;</style>"]
    rows = [(8 * k + r, t, f"s{k % 3}", "fr") for k, t in enumerate(texts) for r in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("size_profile", "audit_row", "div_profile", "paragraphs", "schema_drift"):
        assert_same(QUERIES[name](spark, str(tmp_path)), ORACLES[name], str(tmp_path))


def test_lemmas_are_found_without_moving_tokens(spark, monkeypatch):
    texts = ["Le chat du chat", "", None, "mots çà et là — mots 7 _x", "٣ 一二 chat", "x"]
    chunks = spark.createDataFrame([(f"w{k % 2}", k, t) for k, t in enumerate(texts)] + [(None, None, "chat perdu")], "work_id string, chunk_id long, text string")
    lexicon = spark.createDataFrame([("chat", "CHAT", "NOUN"), ("mots", None, "NOUN"), ("là", "ici", None), ("absent", "x", "y")], "form string, lemma string, pos string")
    entries = {r.form: (r.lemma, r.pos) for r in lexicon.collect()}
    rows = chunks.select("work_id", "chunk_id", T.tokens(F.col("text")).alias("t")).collect()
    want = {r.chunk_id: [(w, entries.get(w, (w, ""))[0] or w, entries.get(w, ("", "X"))[1] or "X") for w in r.t] for r in rows}
    # a lexicon that goes to all tasks, and one that is too large for that
    for small, moved in ((True, 0), (False, 6)):
        monkeypatch.setattr(stemming, "small", lambda df, small=small: small)
        out = stemming.lemma_lists(chunks.select(F.struct("work_id", "chunk_id").alias("of"), "text"), lexicon, "of")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= moved
        assert {r.of.chunk_id: [tuple(x) for x in r.tokens] for r in out.collect()} == want


def test_json_by_work_is_compressed_and_not_sorted(spark, tmp_path):
    works = spark.range(3000).selectExpr("id % 50 as work_id", "repeat('même texte ', 50) as text")
    files.write_json(works, f"file://{tmp_path}/works")
    found = [f"{d}/{x}" for d, _, names in os.walk(tmp_path / "works") for x in names if x.startswith("part-")]
    assert found and all(x.endswith(".json.gz") for x in found) and sum(map(os.path.getsize, found)) < 400_000
    back = files.read_json(spark, f"file://{tmp_path}/works", "work_id bigint, text string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, works.collect()))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_points_are_written_to_their_buckets_once(spark, tmp_path, monkeypatch):
    texts = ["maison maisons 7 _x", "", None, "maison", "٣ 一二 chat chats", "le mot perdu le"] * 9
    docs = spark.createDataFrame([(k if k != 50 else None, t, f"s{k % 3}", "fr") for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    # terms, weights and vectors are those of the corpus
    rows, columns = models._points(spark, str(tmp_path))
    assert exchanges(rows.select(*columns)) == 0
    corpus = retrieval.Corpus(docs.select(F.col("doc_id").alias("chunk_id"), "text"))
    lists = {r.chunk_id: sorted((t.term, t.tf, r.size) for t in r.terms) for r in corpus.lists.collect()}
    vectors = {r.chunk_id: r.vector for r in corpus.vectors().collect()}
    weight = lambda tf, size: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / rows.where("size > 0").agg(F.avg("size")).first()[0]))
    found = rows.select(*columns).collect()
    assert len(found) == len(texts) and all(r.terms == [] and r.vector == [] for r in found if r.chunk_id not in lists or r.chunk_id is None)
    for r in found:
        if r.chunk_id is not None and r.chunk_id in lists:
            assert [(t.term, round(t.weight, 12)) for t in r.terms] == [(t, round(weight(tf, size), 12)) for t, tf, size in lists[r.chunk_id]]
            assert r.vector == vectors[r.chunk_id]
    # whole rows are neither shuffled nor kept beside the index: each upsert writes them once, sorted before they are unfolded
    plans, deal = [], keyed.KeyedTable._deal
    monkeypatch.setattr(keyed.KeyedTable, "_deal", lambda self, rows, made, folder: (plans.append(rows.select(*made)), deal(self, rows, made, folder)))
    moved, staged = [], files.staged
    monkeypatch.setattr(files, "staged", lambda df, name: (moved.append(df.columns), staged(df, name))[1])
    out = models.index_job(spark, str(tmp_path))
    assert len(plans) == 3 and all(exchanges(p) == 0 for p in plans) and all(len(c) == 1 for c in moved)
    assert_same(out, ORACLES["index_job"], str(tmp_path))


def test_a_document_in_two_rows_is_one_point(spark, tmp_path):
    docs = spark.createDataFrame([(1, "maison", "a"), (1, "maisons 7", "a"), (2, "mot", "a")], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in models.index_job(spark, str(tmp_path)).collect()] == [("a", 2, 2, 3, 4)]


def test_rows_are_made_when_they_are_written(spark, tmp_path):
    rows = spark.range(300).selectExpr("id % 250 as k", "id", "repeat('x', cast(id % 5 as int)) as small")
    made = [F.col("k"), F.repeat("small", F.lit(3)).alias("large"), F.col("id").alias("v")]
    t = keyed.KeyedTable.create(spark, f"file://{tmp_path}/t", rows.select(*made).schema, ["k"], buckets=4)
    t.upsert(rows, made=made)
    t.upsert(rows.where("k < 9"), made=made)
    t.delete(spark.range(3).withColumnRenamed("id", "k"))
    last = {k: k + 250 if k < 50 else k for k in range(3, 250)}
    assert {(r.k, r.v, len(r.large)) for r in t.read().collect()} == {(k, v, max(3 * (x % 5) for x in (k, v))) for k, v in last.items()}
