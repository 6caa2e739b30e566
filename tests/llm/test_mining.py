"""Clustering, phrases and mixtures against plain versions and SQL, and on rows with nulls, repeats and extra columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import clustering, mixing, phrases
from quillon.llm.queries import ORACLES, QUERIES

from ..oracle import assert_same
from .test_operators import ODD, SCHEMA, words


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_clusters(rows, dimensions, clusters, rounds, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        centroids = [[sum(x) // len(of[k]) for x in zip(*of[k])] if of[k] else c for k, c in enumerate(centroids)]
    placed = [(i, *near(v)) for i, v in kept]
    within = Counter()
    for _, d, k in placed:
        within[k] += d
    return Counter((i, k, d, within[k], sum(within.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in placed)


def test_op11_against_plain_rounds(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op11_clustering"](spark, small).collect())) == plain_clusters(rows, 64, 16, 3)
    assert_same(QUERIES["op11_clustering"](spark, small), ORACLES["op11_clustering"], small)


def test_op11_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.01]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, -inf]), (7, []), (None, [3.0, 3.0]), (8, [3.0, 3.01]), (8, [3.0, 3.01]), (9, [-2.0, 2.0]), (10, [0.0, 0.0]), (11, [0.01, 0.02])]
    # repeated rows may start two equal centroids, of which one stays empty
    df = spark.createDataFrame([(i, v, "mine", 1, 2, "c") for i, v in rows], "vec_id long, embedding array<double>, near string, cluster int, distance int, v string").repartition(3)
    for clusters in (1, 3, 6, 20):
        got = clustering.clustered(df, dimensions=2, clusters=clusters)
        assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
        assert Counter(map(tuple, got.collect())) == plain_clusters(rows, 2, clusters, 3)
    assert clustering.clustered(df.where("vec_id = 2"), dimensions=2).collect() == []
    assert clustering.clustered(df.limit(0)).dtypes == clustering.clustered(df, dimensions=2).dtypes
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        clustering.clustered(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 0.0])], "vec_id long, embedding array<double>"), dimensions=2, clusters=1).collect()


def plain_phrases(rows, least=30, share=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n["und" if lang is None else lang] += len(ws)
            for size in range(1, 5):
                for k in range(len(ws) - size + 1):
                    f["und" if lang is None else lang][tuple(ws[k : k + size])] += 1
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        outer = Counter()
        for p, a in found.items():
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    outer[p[k : k + size]] = max(outer[p[k : k + size]], a)
        scored = []
        for p, a in found.items():
            if 100 * outer[p] >= share * a and outer[p]:
                continue
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def test_op12_against_plain_counts(spark, small):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op12_phrases"](spark, small).collect())) == plain_phrases(rows)
    assert_same(QUERIES["op12_phrases"](spark, small), ORACLES["op12_phrases"], small)


@pytest.mark.parametrize("places", [1, 4_000_000])
def test_op12_odd_texts(spark, odd, empty, places):
    rows = [(r[1], r[2]) for r in ODD]
    extra = [("New York, new YORK! new\tyork a b c d \x1f a b c d; Éa b c d.", "und"), ("new york new york new york a b c d a b c d", None), ("x " * 5000, "en"), ("w\x00 q w\x00 q", "en"), ("", ""), ("ab cd ab cd", "")]
    df = odd.select("text", "lang").unionByName(spark.createDataFrame(extra, "text string, lang string")).withColumn("w1", F.lit("mine")).withColumn("n", F.lit(1))
    for least, share, top in ((2, 80, 2000), (1, 50, 7), (3, 101, 3)):
        got = phrases.collocations(df, least=least, share=share, top=top, limit=places)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == plain_phrases(rows + extra, least, share, top)
    assert phrases.collocations(empty).collect() == []


def test_op12_full_buckets_lose_nothing(spark, small):
    """With so few buckets that all of them are frequent, nothing is cut and the rows are the same."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = sorted(map(tuple, phrases.collocations(docs).collect()))
    assert sorted(map(tuple, phrases.collocations(docs, bucket_bits=4).collect())) == want


@pytest.fixture(scope="module")
def weak_and_strong(spark):
    """Nearly 3,600 pairs of common words that are frequent but weak, and 40 pairs of words that only occur together."""
    draw = random.Random(12)
    rows = [(" ".join(f"w{draw.randrange(60)}" for _ in range(200)), "en") for _ in range(100)]
    rows += [(". ".join(f"p{k} q{k}" for k in range(40)), "en")] * 3 + [("a b. a b. a c", "de")]
    return rows, spark.createDataFrame(rows, "text string, lang string")


def windows_of(monkeypatch):
    """Rows of each table of windows that is written from now on."""
    found, staged = [], phrases.staged

    def counting(df, name="stage"):
        out = staged(df, name)
        if name == "windows":
            found.append(out.count())
        return out

    monkeypatch.setattr(phrases, "staged", counting)
    return found


def test_op12_weak_phrases_are_not_handed_on(monkeypatch, weak_and_strong):
    """Phrases that are frequent but can't be among the best are not counted: their number grows faster than the input."""
    rows, df = weak_and_strong
    found = windows_of(monkeypatch)
    got = phrases.collocations(df, least=2, top=5, sampled=2)
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, 2, 80, 5)
    assert found[-1] < 100


@pytest.mark.parametrize("goal", [{"en": 1_000_001}, {"en": 1_000_000, "de": 900_000}, {"en": 20_000}])
def test_op12_goals_decide_nothing(monkeypatch, weak_and_strong, goal):
    """A language that doesn't reach its goal is counted anew without one."""
    rows, df = weak_and_strong
    monkeypatch.setattr(phrases, "goals", lambda *_: goal)
    assert sorted(map(tuple, phrases.collocations(df, least=2, top=50, bucket_bits=16).collect())) == plain_phrases(rows, 2, 80, 50)


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        left = total - sum(most * sizes[s] for s in full)
        shares = sum(weight[s] for s in sizes if s not in full)
        target = {s: Fraction(most * sizes[s]) if s in full else Fraction(left * weight[s], shares) for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def check_mix(got, docs, most=3):
    """``got`` rows of a mixture of ``docs`` (id, text, source): sizes, targets, whole copies, and what is taken."""
    sizes, taken = Counter(), Counter()
    for _, t, s in docs:
        sizes[s] += len(words(t))
    target = plain_targets(sizes, most=most)
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((i, len(words(t)), s) for i, t, s in docs)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert 0 <= r.taken <= most * r.size and (r.taken % r.size == 0 if r.size else r.taken == 0)
        if r.size:
            assert abs(r.taken / r.size - target[r.source] / sizes[r.source]) < 1
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(len(words(x)) for _, x, y in docs if y == s)
    return taken, target


def test_op13_meets_targets(spark, small, odd, empty):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = QUERIES["op13_mixing"](spark, small).collect()
    check_mix(got, docs)
    assert sorted(map(tuple, QUERIES["op13_mixing"](spark, small).repartition(7).collect())) == sorted(map(tuple, got))
    mixed = mixing.mixed(odd.withColumn("lot", F.lit("mine")).withColumn("of", F.lit(1)))
    check_mix(mixed.collect(), [(r[0], r[1], r[3]) for r in ODD])
    assert mixing.mixed(empty).collect() == []


def test_op13_tree_keeps_every_word(spark):
    """One hot source in many lots and levels, a small one that is full, one without words, and none at all."""
    rng = np.random.default_rng(4)
    docs = [(k, "w " * int(rng.integers(0, 60)), "hot") for k in range(3000)] + [(10_000 + k, "w w w", s) for k in range(40) for s in ("a", "z", None)] + [(20_000, " ", "none")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    got = mixing.mixed(df, lot=16, fan_in=4).collect()
    taken, target = check_mix(got, docs)
    assert taken["a"] == target["a"] == 360 and taken["none"] == 0
    assert abs(taken["hot"] - target["hot"]) < 60


def test_roundings_are_fair():
    rng = np.random.default_rng(5)
    sizes, n = [40, 9, 7, 5, 3, 2, 1], 4000
    draw = lambda: int(rng.integers(0, 1 << 63))
    total = np.zeros(len(sizes))
    for _ in range(n):
        mass = round(0.3 * sum(sizes) * mixing.PARTS)
        out, at, left = mixing.with_pool([(s, draw()) for s in sizes], mass)
        assert sum(x * s for x, s in zip(out, sizes)) * mixing.PARTS + left == mass and (at is None or out[at] == 0)
        share = np.array(out, float)
        if at is not None:
            share[at] = left / (sizes[at] * mixing.PARTS)
        total += share
    assert np.abs(total / n - 0.3).max() < 0.03
    masses, total = [int(m * s * mixing.PARTS) for m, s in zip((0.2, 0.5, 0.9, 0.4, 0.1, 0.7, 0.6), sizes)], np.zeros(len(sizes))
    for _ in range(n):
        out, at, left = mixing.in_pairs([(s, draw(), m) for s, m in zip(sizes, masses)])
        assert sum(x * s for x, s in zip(out, sizes)) * mixing.PARTS + left == sum(masses)
        share = np.array(out, float)
        if at is not None:
            share[at] = left / (sizes[at] * mixing.PARTS)
        total += share
    assert np.abs(total / n - [m / (s * mixing.PARTS) for m, s in zip(masses, sizes)]).max() < 0.03
