"""The pipeline's stages, each against a plain version of what it decides."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm.common import documents

from .test_operators import library_ids, repeats, shingles, words


def copies(rows, alike=0.8):
    """Ids that stay of rows: the smallest of each group of texts whose five-word shingle sets are alike, by all pairs."""
    sets = [shingles(r.text) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and both >= alike * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    least = {}
    for r, x in zip(rows, label):
        least[x] = min(least.get(x, r.doc_id), r.doc_id)
    return set(least.values())


def test_stages(spark, small):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "packing"]
    extra = spark.createDataFrame([(10_001, None, "en", "src1", 0), (10_002, "123 !!", "en", "src1", 6), (10_002, "123 !!", "en", "src1", 6)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = documents(spark, small).unionByName(extra)
    first = stages["language_id"](spark, docs, small).cache()
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} >= {r.doc_id for r in documents(spark, small).where("n_chars > 200").collect()}
    assert not {10_001, 10_002} & {r.doc_id for r in first.collect()}
    rows = sorted(first.collect(), key=lambda r: r.doc_id)
    second = stages["simhash_near_dedup"](spark, first, small).cache()
    want = copies(rows)
    assert sorted(r.doc_id for r in second.collect()) == sorted(want)
    rows = second.collect()
    third = stages["substring_dedup"](spark, second, small).cache()
    cut = repeats([r.text for r in rows])
    assert {r.doc_id: len(words(r.text)) for r in third.collect()} == {r.doc_id: n - gone for r, (n, gone, _) in zip(rows, cut) if gone < n or not n}
    assert all(r.n_chars == len(r.text) for r in third.collect() if r.doc_id in {x.doc_id for x, c in zip(rows, cut) if c[1]})
    items = [shingles(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    fourth = stages["benchmark_decontamination"](spark, third, small).cache()
    dirty = lambda t: any(len(s & shingles(t)) >= 0.8 * len(s) for s in items if s)
    assert {r.doc_id for r in fourth.collect()} == {r.doc_id for r in third.collect() if not dirty(r.text)}
    last = stages["packing"](spark, fourth, small).collect()
    rows = fourth.collect()
    ids = {r.doc_id: [*i, 1] for r, i in zip(rows, library_ids([r.text for r in rows]))}
    assert Counter(sum((np.frombuffer(r.ids, "<u4").tolist() for r in last), [])) == Counter(sum(ids.values(), []))
    ran = corpus_pipeline.run(spark, small)
    assert ran.select(F.sum("length")).first()[0] == corpus_pipeline.pack(spark, _chain(spark, small), small).select(F.sum("length")).first()[0]


def _chain(spark, small):
    docs = documents(spark, small)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
    return docs


def test_stages_on_odd_tables(spark, small):
    long = " ".join(f"parole{k % 9973} mot{k}" for k in range(60_000))  # about a megabyte
    word = "x" * 1_000_000
    text = "Ceci est un texte assez ordinaire, avec quelques mots de plus que le minimum."
    rows = [(1, None), (2, ""), (3, text), (3, text), (None, text), (4, long), (5, word), (6, "12 34 !!")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for c in ("row", "root", "sketch", "of_key", "block", "language", "fp", "n_words", "kept_text", "text_key", "bad_doc", "hash", "lot", "key"):
        odd = odd.withColumn(c, F.lit(f"mine {c}"))
    kept = {"language_id": None, "simhash_near_dedup": 5, "substring_dedup": 8, "benchmark_decontamination": 8}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame([(100 + k, text + f" {k}") for k in range(40)], "doc_id long, text string").withColumns({c: F.lit("x") for c in odd.columns[2:]}).unionByName(odd) if name == "language_id" else odd
        docs = docs.withColumn("lang", F.lit("fr"))
        out = stage(spark, docs, small)
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {1, 2, 3, 4, 5, 6, None}
        else:
            assert out.columns == docs.columns
            found = out.collect()
            assert all(r["kept_text"] == "mine kept_text" and r["row"] == "mine row" for r in found if r.doc_id in (4, 5)), name
            if kept[name]:
                assert len(found) == kept[name], (name, sorted(str(r.doc_id) for r in found))
            assert {4, 5} <= {r.doc_id for r in found}
        assert stage(spark, docs.limit(0), small).count() == 0


def test_near_copies_are_found_by_jaccard(spark):
    rng = np.random.default_rng(5)
    stage, rows, want = dict(corpus_pipeline.STAGES)["simhash_near_dedup"], [], set()

    def add(ws, stays):
        rows.append((len(rows), " ".join(ws)))
        if stays:
            want.add(rows[-1][0])

    def five(ws):
        return {tuple(ws[k : k + 5]) for k in range(max(len(ws) - 4, 1))}

    alike = lambda a, b: len(five(a) & five(b)) / len(five(a) | five(b))
    for n in (9, 30, 60, 200, 600) * 6:
        base = [f"w{x}" for x in rng.integers(0, 5000, n)]
        add(base, True)
        for _ in range(4):
            copy = list(base)
            while alike(base, copy) == 1 or rng.random() < 0.7 and n > 9:
                before = list(copy)
                copy[rng.integers(0, n) if n > 30 else -1] = f"x{rng.integers(0, 5000)}"
                if alike(base, copy) < 0.8:
                    copy = before if before != base else base[:-1]
                    break
            if alike(base, copy) >= 0.8:
                add(copy, False)
        far = [f"y{x}" if k % 10 == 0 else w for k, (w, x) in enumerate(zip(base, rng.integers(0, 5000, n)))]
        assert alike(base, far) < 0.7
        add(far, True)
    add([], True)
    add([], False)
    assert len(rows) - len(want) > 60
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in stage(spark, docs, None).collect()} == want
    assert stage(spark, docs.limit(0), None).count() == 0
