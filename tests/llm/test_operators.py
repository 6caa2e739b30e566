"""The ten operators against brute force on the smallest tables, and on rows with nulls, repeats and extra columns."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillon.llm import context_tree, decontamination, language, packing, quality, sharding, simhash, substrings, tokens, toxicity
from quillon.llm.common import components, documents, vocabulary
from quillon.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, fp string, row bigint, block string, language string"
LONG = " ".join(f"mot{k % 97}x{k}" for k in range(3000))
ODD = [
    (1, None, "en", "a", "x", 1, "b", "l"), (2, "", None, None, None, None, None, None), (3, " \t\n ", "fr", "a", "x", 2, "b", "l"),
    (4, "Hello world, this is one.", "en", "a", "x", 3, "b", "l"), (4, "Hello world, this is one.", "en", "a", "x", 3, "b", "l"),
    (None, "Hello world, this is one.", "en", "a", "x", 3, "b", "l"), (5, LONG, "fr", "b", None, 5, None, None), (6, LONG + " fin", "fr", "b", None, 5, None, None),
    (7, "aaa aaa aaa aaa aaa aaa aaa aaa aaa aaa aaa aaa", "de", None, "y", 6, "c", "m"), (8, "é ß Σ 中文 1234 <|endoftext|> !!", "de", "c", "y", 7, "c", "m"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return {r.doc_id: r for r in documents(spark, small).collect()}


def words(t):
    return (t or "").encode().split()


def fp(text):
    ws = words((text or "").encode().lower().decode())
    if not ws:
        return 0
    sh = [b" ".join(ws[k : k + 3]) for k in range(max(len(ws) - 2, 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(ids, prints, radius=2):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for i, x in zip(ids, label):
        if i is not None:
            least[x] = min(least.get(x, i), i)
    return [least.get(x) for x in label]


def test_op2_against_all_pairs(spark, small, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, small).collect()}
    ids = sorted(docs)
    prints = [fp(docs[i].text) for i in ids]
    assert got == {i: (f"{p:016x}", g) for i, p, g in zip(ids, prints, groups(ids, prints))}


def test_op2_links_chains_and_odd_rows(spark, odd, empty):
    base = 0x0123456789ABCDEF
    nodes = [base, base ^ 3, base ^ 15, base ^ 0xFF00, base ^ (1 << 63), (1 << 64) - 1]
    signed = [x - (1 << 64) if x >> 63 else x for x in nodes]
    roots = {r.node: r.component for r in components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"))).collect()}
    assert len({roots[signed[k]] for k in (0, 1, 2, 4)}) == 1 and signed[3] not in roots and signed[5] not in roots
    rng = np.random.default_rng(1)
    many = np.unique(np.concatenate([base ^ (1 << rng.integers(0, 64, 400).astype(np.uint64)), rng.integers(0, 1 << 63, 300).astype(np.uint64)]).astype(np.uint64))
    edges = simhash.links(spark.createDataFrame([(int(x),) for x in many.view(np.int64)], "fp bigint"), slice_rows=64)
    assert edges.count() < 20 * len(many)
    found = {r.node: r.component for r in components(edges).collect()}
    want = groups(list(range(len(many))), [int(x) for x in many])
    by = defaultdict(set)
    for k, x in enumerate(many.view(np.int64)):
        by[want[k]].add(found.get(int(x), int(x)))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and rows[0].__fields__ == [*odd.columns, "fingerprint", "component_id"]
    assert {r.component_id for r in rows if r.text == ODD[3][1]} == {4} and {r.component_id for r in rows if not words(r.text)} == {1}
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.component_id for r in rows})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.first_of_each(empty).count() == 0


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_op3_holds_every_id_once(spark, small, docs, odd, empty):
    want = {i: ids + [1] for i, ids in zip(docs, library_ids([d.text for d in docs.values()]))}
    rows = packing.packed(documents(spark, small), vocabulary("word_bpe_49k.json"), chunk_tokens=50_000).collect()
    parts, seqs = defaultdict(dict), defaultdict(list)
    for r in rows:
        assert r.doc_tokens == len(want[r.doc_id])
        parts[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
        seqs[r.sequence_id].append((r.offset, r.length))
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in parts.items()} == want
    for s in seqs.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(map(len, want.values()))
    assert len(seqs) * 2048 <= total + 2048 * (total // 50_000 + 2)
    digests = QUERIES["op3_packing"](spark, small).collect()
    assert all(r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in digests)
    assert sum(r.length for r in digests) == total
    got = Counter((r.doc_id, r.doc_tokens) for r in packing.packed(odd, vocabulary("word_bpe_49k.json")).collect() if r.start == 0)
    assert got == Counter((r[0], len(i) + 1) for r, i in zip(ODD, library_ids([r[1] for r in ODD])))
    assert packing.packed(empty, vocabulary("word_bpe_49k.json")).count() == 0


def test_packing_balances_cost():
    rng = np.random.default_rng(0)
    lengths = rng.integers(0, 700, 500)
    pieces = packing.pack(lengths, 2048)

    def spread(pieces):
        cost = defaultdict(float)
        for _, _, n, s, _ in pieces:
            cost[s] += n + n * n / 2048
        return np.std(list(cost.values())) / np.mean(list(cost.values()))

    # the same sequences filled first-fit, by descending length
    fill, room = [], []
    for d, n in sorted(enumerate(lengths.tolist()), key=lambda x: -x[1]):
        s = next((k for k, r in enumerate(room) if r >= n), len(room))
        room[s:] = room[s:] or [2048]
        fill.append((d, 0, n, s, 2048 - room[s]))
        room[s] -= n
    assert spread(pieces) < 0.5 * spread(fill)
    # each piece went to the sequence that was cheapest of those with room, as long as one had room
    whole = sorted((p for p in pieces if p[2] == lengths[p[0]]), key=lambda p: (-p[2], p[0]))
    left, cost = [2048] * (max(p[3] for p in pieces) + 1), [0.0] * (max(p[3] for p in pieces) + 1)
    for _, _, n, s, _ in whole[:200]:
        assert cost[s] == min(c for c, r in zip(cost, left) if r >= n)
        left[s], cost[s] = left[s] - n, cost[s] + n + n * n / 2048
    room = Counter()
    for d, start, n, s, offset in pieces:
        assert n > 0
        room[s] += n
    assert max(room.values()) <= 2048 and len(room) == -(-sum(room.values()) // 2048)


def coded_steps(text, depth):
    """Context, path and bit of each binary decision that codes a text."""
    x = bytes([10]) * depth + context_tree.stream((text or "").encode())
    for i in range(depth, len(x)):
        for k in range(8):
            yield x[i - depth : i], (1 << k) | (x[i] >> (8 - k)), (x[i] >> (7 - k)) & 1


def context_tree_scores(texts, learned, depth=context_tree.DEPTH):
    """log10 probabilities by a context tree in plain dictionaries, node by node."""
    counts, kids = defaultdict(lambda: [0, 0]), defaultdict(list)
    for t, known in zip(texts, learned):
        for c, p, b in coded_steps(t, depth) if known else ():
            for d in range(depth + 1):
                counts[c[depth - d :], p][b] += 1
    for c, p in counts:
        if c:
            kids[c[1:], p].append((c, p))
    weights = {}

    def weighted(node):
        z, o = counts[node]
        own = math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.log(math.pi) - math.lgamma(z + o + 1)
        if len(node[0]) == depth:
            weights[node] = 1.0
            return own
        below = math.fsum(map(weighted, kids[node]))
        most = max(own, below)
        both = most + math.log(math.exp(own - most) + math.exp(below - most))
        # not exp(own - both): for counts of 100,000 that would leave eleven digits of one minus the weight
        weights[node] = 1 / (1 + math.exp(min(below - own, 700)))
        return both - math.log(2)

    for node in [n for n in counts if not n[0]]:
        weighted(node)
    out = []
    for t in texts:
        total = 0.0
        for c, p, b in coded_steps(t, depth):
            done, left, last = 0.0, 1.0, 0.5
            for d in range(depth + 1):
                node = (c[depth - d :], p)
                if node not in counts:
                    break
                z, o = counts[node]
                last = (o + 0.5) / (z + o + 1)
                done, left = done + left * weights[node] * last, left * (1 - weights[node])
            one = done + left * last
            total += math.log10(one if b else 1 - one)
        out.append(total)
    return out


def test_op4_equals_a_plain_context_tree(spark, docs, empty):
    texts = ["the cat sat on the mat", "The DOG sat on the log  and the cat", "", None, "un deux trois the cat", "zzz é the mat", "the cat sat on the mat", "abcabcabc " * 30]
    texts += [docs[i].text[:1500] for i in sorted(docs)[:6]]
    learned = [k % 4 != 1 for k in range(len(texts))]
    rows = [(k, t, y) for k, (t, y) in enumerate(zip(texts, learned))]
    got = {r.doc_id: r for r in context_tree.model_scores(spark.createDataFrame(rows, "doc_id long, text string, learned boolean").repartition(3)).collect()}
    for k, want in enumerate(context_tree_scores(texts, learned)):
        assert abs(got[k].score - want) < 1e-9 * max(1, abs(want))
        assert got[k].n_coded == len(context_tree.stream((texts[k] or "").encode()))
    # nothing learned: each decision is even
    none = context_tree.model_scores(spark.createDataFrame([(1, "abc", None), (2, None, False)], "doc_id long, text string, learned boolean")).collect()
    assert {r.doc_id: round(r.score, 9) for r in none} == {1: round(-32 * math.log10(2), 9), 2: round(-8 * math.log10(2), 9)}
    clash = spark.createDataFrame([(1, "a b", True, 1, "x", 2.0)], "doc_id long, text string, learned boolean, block long, lot string, node double")
    assert context_tree.model_scores(clash).count() == 1
    assert context_tree.model_scores(empty.withColumn("learned", F.lit(True))).count() == 0


def test_op4_counts_beyond_one_and_two_bytes(spark, monkeypatch):
    # two blocks, each with grams above 2**16 of its own, and grams between 2**8 and 2**16
    texts = ["ab" * 70_000, "ab" * 40_000 + " " + "c" * 66_000, "the cat " * 300, "the dog " * 300, "a cat", "ab", "cccc", None]
    learned = [True] * 4 + [False] * 4
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", 140_000)
    rows = spark.createDataFrame([(k, t, y) for k, (t, y) in enumerate(zip(texts, learned))], "doc_id long, text string, learned boolean")
    assert context_tree.blocks_for(rows, "text", 140_000) > 2
    got = {r.doc_id: r.score for r in context_tree.model_scores(rows).collect()}
    for k, want in enumerate(context_tree_scores(texts, learned)):
        # each byte's code length is rounded to a multiple of UNIT
        assert abs(got[k] - want) < 1e-8 * max(1, abs(want)) + context_tree.UNIT * (len(texts[k] or "") + 1)
    key, n = context_tree.distinct([b"x" * 1_000_000])
    assert n.max() == 999_994 and n.sum() == 1_000_001
    with pytest.raises(ValueError):
        context_tree.same_size(key, np.zeros(len(key) * 2))


def test_op4_base_is_exact_and_the_model_beats_it(spark, small, docs, odd):
    rows = QUERIES["op4_lm_scoring"](spark, small).collect()
    toks = {i: [*((d.text or "").encode().lower().split()), b"\n"] for i, d in docs.items()}
    train = [i for i in docs if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(t for i in train for t in toks[i])
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(docs)
    for r in rows:
        t = toks[r.doc_id]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(x in c for x in t), n, r.doc_id not in train)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
        assert abs(r.bits_per_byte + r.score * math.log2(10) / len(context_tree.stream((docs[r.doc_id].text or "").encode()))) < 1e-9
    got = context_tree.model_scores(odd.withColumn("learned", F.lit(True)))
    assert sorted(r.n_tokens for r in got.collect()) == sorted(len(words(r[1])) + 1 for r in ODD)
    total = QUERIES["op4_lm_scoring"](spark, "/root/testdata/sf0.01").groupBy("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).collect()
    assert len(total) == 2 and all(r.score > r.base for r in total)


def test_kt_weights_match_sequential_coding():
    bits = [1, 1, 0, 1, 0, 0, 0, 1, 1, 1]
    p = zeros = ones = 0
    for b in bits:
        p += math.log(((ones if b else zeros) + 0.5) / (zeros + ones + 1))
        zeros, ones = zeros + 1 - b, ones + b
    assert abs(context_tree.log_kt(np.array([zeros]), np.array([ones]))[0] - p) < 1e-9


def test_very_long_texts(spark):
    long, word = " ".join(f"parole{k % 9973} mot{k}" for k in range(60_000)), "x" * 1_000_000
    docs = spark.createDataFrame([(1, long, "a"), (2, word, "a"), (3, "court", "b")], "doc_id long, text string, source string")
    sizes = {1: 120_000, 2: 1, 3: 1}
    assert {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()} == {1: f"{fp(long):016x}", 2: f"{fp(word):016x}", 3: f"{fp('court'):016x}"}
    assert {r.doc_id: r.n_words for r in quality.judged(docs).collect()} == sizes
    assert {r.doc_id: r.size for r in sharding.interleaved(docs, shards=2).collect()} == {1: len(long) + 8, 2: 1_000_008, 3: 13}
    scores = {r.doc_id: r for r in context_tree.model_scores(docs.withColumn("learned", F.col("doc_id") < 3)).collect()}
    assert {k: r.n_tokens - 1 for k, r in scores.items()} == sizes and scores[2].n_coded == 1_000_001 and scores[2].score > -100


def repeats(texts, length=35):
    ws = [words(t) for t in texts]
    seen = Counter(tuple(w[k : k + length]) for w in ws for k in range(len(w) - length + 1))
    out = []
    for w in ws:
        gone = set()
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone.update(range(k, k + length))
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def test_op5_against_brute_force(spark, small, docs, odd, empty):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op5_substring_dedup"](spark, small).collect()}
    assert got == dict(zip(docs, repeats([d.text for d in docs.values()])))
    rows = substrings.without_repeats(odd).select("text", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    want = Counter(zip([r[1] for r in ODD], repeats([r[1] for r in ODD])))
    assert Counter((r[0], tuple(r[1:])) for r in rows) == want
    for length in (1, 2, 3, 7, 12):
        rows = substrings.without_repeats(odd, length).select("text", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
        assert Counter((r[0], tuple(r[1:])) for r in rows) == Counter(zip([r[1] for r in ODD], repeats([r[1] for r in ODD], length)))
    assert substrings.without_repeats(empty).count() == 0


def test_op6_mixes_sources_evenly(spark, small, docs, odd, empty):
    rows = QUERIES["op6_sharding"](spark, small).collect()
    order = []
    by = defaultdict(list)
    for d in docs.values():
        by[d.source].append((hashlib.md5(f"17:{d.doc_id}".encode()).hexdigest(), d.doc_id))
    for s, v in by.items():
        order += [((k + 0.5) / len(v), "=" + s, x) for k, x in enumerate(sorted(v))]
    n = len(order)
    want = {}
    for place, (_, _, (_, i)) in enumerate(sorted(order)):
        shard = place * 24 // n
        want[i] = (shard, place - -(-shard * n // 24))
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == want
    for r in rows:
        text = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "rows", None)
    some = sharding.interleaved(odd, shards=4).collect()
    assert sorted(Counter(r.shard for r in some).values()) == [2, 2, 3, 3] and sorted(r.slot for r in some if r.shard == 0) == list(range(sum(r.shard == 0 for r in some)))
    assert sharding.interleaved(empty).count() == 0


def test_op7_equals_the_library(spark, small, docs, odd, empty):
    rows = {r.doc_id: r for r in QUERIES["op7_token_counts"](spark, small).collect()}
    for (i, d), ids in zip(docs.items(), library_ids([d.text for d in docs.values()])):
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (len(ids), len((d.text or "").encode()), len(ids) > 2048)
    table = tokens.merge_table(vocabulary("word_bpe_49k.json"))
    rng = np.random.default_rng(2)
    long = ["".join(rng.choice(list(a), n)) for a in ("ab", "etaoin", "aaab", "é中a") for n in (255, 256, 257, 3000)]
    assert tokens.count_texts([h.encode() for h in long], table, {}) == [len(i) for i in library_ids(long)]
    import time

    began, huge = time.time(), "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz+/"), 1_000_000))
    assert tokens.count_texts([huge.encode()], table, {}) == [len(library_ids([huge])[0])] and time.time() - began < 30
    hard = ["", "aaaa aaaaaaaaa", "it's I'M don't", "12345 a1b2", "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>", "ΣΑΣ İstanbul straße", "中文字 \U0001f600\U0001f600", "a b c", "école école", "x!!!??? ---"]
    assert tokens.count_texts([h.encode() for h in hard], table, {}) == [len(i) for i in library_ids(hard)]
    got = Counter((r.doc_id, r.n_tokens) for r in tokens.token_counts(odd, vocabulary("word_bpe_49k.json")).collect())
    assert got == Counter((r[0], len(i)) for r, i in zip(ODD, library_ids([r[1] for r in ODD])))
    assert tokens.token_counts(empty, vocabulary("word_bpe_49k.json")).count() == 0


def shingles(t):
    ws = [w.lower() for w in words(t)]
    return {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def test_op8_against_brute_force(spark, small, docs, odd, empty):
    items = {r.item_id: shingles(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    want = set()
    for d in docs.values():
        own = shingles(d.text)
        want |= {(d.doc_id, i, len(s), len(s & own)) for i, s in items.items() if s and len(s & own) >= 0.8 * len(s)}
    rows = QUERIES["op8_decontamination"](spark, small).collect()
    assert {(r.doc_id, r.item_id, r.n_item, r.n_shared) for r in rows} == want and want and len(rows) == len(want)
    bench = spark.createDataFrame([(1, "HELLO world, this is one."), (2, None), (3, ""), (4, "only three words"), (5, " ".join(LONG.split()[100:130])), (5, " ".join(LONG.split()[100:130]))], "item_id int, text string")
    got = decontamination.contained_items(odd, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 1), (4, 1), (5, 5), (6, 5)]
    left = decontamination.clean(odd, bench)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 7, 8]
    assert decontamination.contained_items(empty, bench).count() == 0 and decontamination.clean(odd, bench.limit(0)).count() == len(ODD)


def test_ids_of_any_type(spark):
    from quillon.llm import packing as P

    rows = [("b", "un deux trois quatre cinq six sept huit neuf dix", "s"), ("a", "un deux trois quatre cinq six sept huit neuf dix", "s"), (None, "un deux trois quatre cinq six sept huit neuf dix", "s"), ("c", "autre texte", "s"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string")
    assert sorted((r.doc_id or "") for r in P.packed(df, vocabulary("word_bpe_49k.json")).collect()) == ["", "", "a", "b", "c"]
    assert sorted((r.doc_id or "") for r in simhash.first_of_each(df).collect()) == ["", "a", "c"]
    assert sorted((r.doc_id or "") for r in simhash.without_near_copies(df).collect()) == ["", "a", "c"]
    items = spark.createDataFrame([("x", "un deux trois quatre cinq six"), ("x", "deux trois quatre cinq six sept"), ("x", "deux trois quatre cinq six sept sept six"), ("y", "un un un un un un un"), ("z", "un un un un un un")], "item_id string, text string")
    found = Counter((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontamination.contained_items(df.unionByName(spark.createDataFrame([("d", "un un un un un un un un", "s")] * 2, df.schema)), items).collect())
    assert found == Counter([(d, "x", 2, 2) for d in ("a", "b", None)] + [("d", "y", 1, 1), ("d", "z", 1, 1)])


def test_op9_learns_languages(spark, odd, empty):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op9_language"](spark, folder).join(documents(spark, folder).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    model = language.learn(documents(spark, folder))
    two = [t for _, t in sorted((r.lang, r.text) for r in documents(spark, folder).where("n_chars between 1500 and 1600").dropDuplicates(["lang"]).collect())][:2]
    mixed = spark.createDataFrame([(" ".join(two),), (two[0],), (None,), ("12 !!",), ("",)], "text string")
    a, b, *rest = [r.language for r in language.identified(mixed, model).collect()]
    assert len(a.proportions) == 2 and 0.3 < a.score < 0.7 and b.score > 0.95 and [r.lang_pred for r in rest] == ["und"] * 3
    # every language once: all that hold a fair share are found, none is capped away
    one = {r.lang: r.text for r in documents(spark, folder).where("n_chars between 1500 and 1600").dropDuplicates(["lang"]).collect()}
    every = language.identified(spark.createDataFrame([(" ".join(one.values()),)], "text string"), model).first().language
    assert len(one) == 4 and set(every.proportions) == set(one) and all(0.15 < p < 0.35 for p in every.proportions.values())
    assert language.identified(odd, model).count() == len(ODD) and language.identified(empty, model).count() == 0
    nothing = language.learn(empty)
    assert {r.language.lang_pred for r in language.identified(odd, nothing).collect()} == {"und"}


def test_op9_mixture_against_plain_rounds():
    """The fit of one document against expectation-maximisation term by term, and the set against all sets of leading languages."""
    rng = np.random.default_rng(7)
    logs = np.log(rng.dirichlet(np.full(language.BINS, 0.05), 4) + 1e-9)
    like = np.exp(logs)
    for share in ([1, 0, 0, 0], [0.5, 0.5, 0, 0], [0.4, 0.3, 0.3, 0], [0.25, 0.25, 0.25, 0.25]):
        lang = rng.choice(4, 3000, p=share)
        grams = np.concatenate([rng.choice(language.BINS, int((lang == k).sum()), p=like[k] / like[k].sum()) for k in range(4)])

        def fit(some, times=400):
            p = np.array([1.0 if k in some else 0.0 for k in range(4)]) / len(some)
            for _ in range(times):
                part = p[:, None] * like[:, grams]
                p = (part / part.sum(axis=0)).mean(axis=1)
            return p, np.log((p[:, None] * like[:, grams]).sum(axis=0)).sum()

        free, chosen = language.mixtures([grams], logs)
        exact = fit(range(4))[0]
        assert np.abs(free[:, 0] - exact).max() < 0.02
        order, best = np.argsort(-exact), None
        for m in range(1, 5):
            p, value = fit(order[:m].tolist())
            value -= language.PENALTY * (m - 1) * math.log(1000)
            if best is None or value > best[1]:
                best = p, value
        assert np.abs(chosen[:, 0] - best[0]).max() < 0.02 and ((chosen[:, 0] > 0) == (best[0] > 0)).all()


def test_op1_finds_toxic_documents(spark, odd, empty):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op1_toxicity"](spark, folder)
    held = rows.where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)
    assert all(r.predicted == (r.score >= 0.3) for r in held)
    lexicon = toxicity.Lexicon({" idiot ": 8.0, " trash ": 8.0, " veju": 6.0}, ("trash can",))
    hit, none = lexicon.score("You Idiot!"), lexicon.score("You fool")
    assert hit > 0.3 > none
    assert all(lexicon.measures(t)[0] > 0 for t in ("1diot", "ІDІОТ", "ｉｄｉｏｔ", "id1ot.", "vejuté")) and lexicon.measures("trash can, 3 idiots")[0] == 0
    got = toxicity.scored(odd, lexicon).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and toxicity.scored(empty, lexicon).count() == 0
    assert toxicity.learn(empty.withColumn("toxic", F.lit(1))).weights == {}


def plain_measures(lexicon, text):
    """The scorer's measures by looking for each term and phrase at each place."""
    t = toxicity.folded(text)
    at = lambda x: [k for k in range(len(t)) if t.startswith(x, k)]
    spans = [(k, k + len(e) + 2) for e in lexicon.exceptions for k in at(f" {e} ")]
    total = 0.0
    for k in range(len(t)):
        here = [w for x, w in lexicon.weights.items() if t.startswith(x, k) and not any(a <= k and k + len(x) <= b for a, b in spans)]
        total += max(here, default=0.0)
    return math.log1p(total), math.log1p(100 * total / max(len(t.split()), 1))


def test_op1_measures_against_every_place(docs):
    lexicon = toxicity.Lexicon({" idiot ": 8.0, " trash ": 7.5, " idi": 2.0, " can": 1.0, " trash can b": 9.0}, ("trash can", "no idiot here", "can idiot"))
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["trash", "can", "idiot", "no", "here", "idiom", "b", "Tr4sh", "c@n,"], int(n))) for n in rng.integers(0, 40, 200)]
    for t in [*texts, *(d.text or "" for d in list(docs.values())[:40])]:
        assert np.allclose(lexicon.measures(t), plain_measures(lexicon, t))
    assert lexicon.phrases("the idiot, said") == {"the idiot", "idiot said"} and lexicon.phrases("idiot") == set()
    import time

    began = time.time()
    lexicon.measures("trash can idiot " * 80_000)
    assert lexicon.measures("x" * 2_000_000)[0] == 0 and time.time() - began < 10


def test_op1_learns_exceptions(spark):
    rows = [(f"what a trash person number {k} is", 1) for k in range(30)] + [(f"put it in the trash can number {k} please", 0) for k in range(20)] + [(f"a quiet day number {k}", 0) for k in range(400)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))
    assert " trash " in lexicon.weights and "trash can" in lexicon.exceptions
    assert lexicon.score("the trash can") < 0.3 < lexicon.score("what a trash person")


def test_op10_against_brute_force(spark, small, docs, odd, empty):
    def measure(t):
        t = t or ""
        ws = [w.decode() for w in words(t)]
        seen = Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4))
        rep = {j for k in range(len(ws) - 4) if seen[tuple(ws[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        return len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in QUERIES["op10_quality_rules"](spark, small).collect():
        m = measure(docs[r.doc_id].text)
        assert tuple(r[n] for n in names) == m
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0]) and not (r.base_failed and r.kept)
    taken = odd
    for c in ("ws", "lines", "h", "p", "q", "at", "host", "own_host", "of_host", "__p", "__host", "rate", "host_rate"):
        taken = taken.withColumn(c, F.lit(f"mine {c}"))
    held = quality.judged(taken)
    assert held.columns == [c for c in taken.columns if c != "host_rate"] + [*quality.MEASURES, "host_rate", "kept"]
    assert all(r["__p"] == "mine __p" and r["of_host"] == "mine of_host" and r["ws"] == "mine ws" for r in held.collect())
    rows = quality.judged(odd).collect()
    assert Counter(tuple(r[n] for n in names) for r in rows) == Counter(measure(r[1]) for r in ODD) and quality.judged(empty).count() == 0
    bad = spark.createDataFrame([(k, "short", "spam") for k in range(200)] + [(1000 + k, " ".join(f"w{j}" for j in range(50)), "spam" if k < 10 else f"s{k % 20}") for k in range(2000)], "doc_id long, text string, source string")
    verdict = {r.source: r for r in quality.judged(bad).where("not base_failed").collect()}
    assert not verdict["spam"].kept and verdict["s1"].kept
