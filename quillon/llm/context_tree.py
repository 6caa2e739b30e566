"""Language-model scoring by context-tree weighting over bytes.

The coded stream of a text is its lower-cased words joined by one space and an end byte; before it lie only end bytes.  Each
byte is eight binary decisions.  For every context of 0 to DEPTH preceding bytes and every path of decisions a node counts
zeros and ones; its Krichevsky-Trofimov estimate is mixed with the weighted estimate of its longer contexts, half and half by
prior and by what the training texts coded shorter by posterior.  A decision in a context that was never seen takes the
estimate of the longest context that was.

No node is dropped, and counts, estimates and weights are exact.  Documents are dealt into blocks of bounded size; a block asks once for each of its
distinct grams (a context and the byte after it) and for each of its distinct words.  Asks of one gram or word meet in a bucket,
where counts are summed over the corpus.  The grams then form the tree, level by level from the longest contexts up and from the
shortest down; contexts meet by their last three bytes, and what lies above is summed with plain aggregates.  A gram's code
length goes back to the blocks that asked for it, and so do the words' counts, from which the unigram base is worked out.
Neither the tree nor the vocabulary is ever in one place.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batches, blocks_for, bounded_batches, documents, fold, partitions_for, staged, text_key, word_hashes

FOLDS, HELD_OUT = 5, 1
DEPTH = 6
#: Contexts of so many bytes and more are worked out in Python, by lots of their last TOP + 1 bytes; shorter ones by aggregates.
TOP = 2
BLOCK_BYTES = 16 << 20
#: Bytes that are sorted at once.
CHUNK = 1 << 20
#: Code lengths travel in whole multiples of this.
UNIT = 2.0**-33
END = 10

U = np.uint64


def stream(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + b"\n"


def grams(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each coded byte: its context, the latest byte highest, and the byte itself lowest; and each text's number of bytes."""
    coded = [stream(t) for t in texts]
    pad = bytes([END]) * depth
    x = pad + pad.join(coded)
    # eight bytes from each place on, of which the first ``depth`` are the context, the latest one highest
    eight = np.ndarray(len(x) - depth, "<u8", x + bytes(8), strides=(1,))
    key = ((eight & U((1 << (8 * depth)) - 1)) << U(8)) | ((eight >> U(8 * depth)) & U(255))
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    gaps = np.column_stack([sizes, np.full(len(sizes), depth)]).ravel()[:-1]
    own = np.repeat(np.tile([True, False], len(coded))[:-1], gaps)
    return key[own], sizes


def runs(key: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts in a sorted array."""
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)


def log_gamma(z: np.ndarray) -> np.ndarray:
    """Stirling's series, after a shift by six."""
    y = z + 6
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - np.log(z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    out = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1)
    return np.where(zeros + ones > 0, out, 0.0)


def climb(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each node's own estimate against its longer contexts, and the logarithm of its weighted probability."""
    own = log_kt(zeros, ones)
    if below is None:
        return np.ones(len(own)), own
    return 1 / (1 + np.exp(np.clip(below - own, -700, 700))), np.logaddexp(own, below) - math.log(2)


def summed(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = runs(key)
    return key[at], np.add.reduceat(values[order], at) if len(at) else values[:0]


class Subtree:
    """The nodes of contexts of TOP to ``depth`` bytes above distinct grams, which hold all grams of their contexts of TOP + 1 bytes."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, depth: int = DEPTH):
        order = np.argsort(gram)
        self.depth, self.order = depth, order
        self.key, self.n, self.up = {depth: gram[order]}, {depth: n[order].astype(float)}, {}
        for d in range(depth - 1, TOP - 1, -1):
            k = self.key[d + 1]
            self.key[d], self.up[d + 1] = np.unique(((k >> U(16)) << U(8)) | (k & U(255)), return_inverse=True)
            self.n[d] = np.bincount(self.up[d + 1], weights=self.n[d + 1], minlength=len(self.key[d]))

    def levels(self, bit: int) -> dict[int, tuple[np.ndarray, ...]]:
        """For each depth: first gram of each node that decides ``bit``, each gram's node, zeros, ones, weight, and the parent's node; at TOP the last two are what lies below and nothing."""
        out: dict[int, tuple[np.ndarray, ...]] = {}
        weighted = first = None
        for d in range(self.depth, TOP - 1, -1):
            key = self.key[d]
            start = runs(key >> U(8 - bit))
            node = np.zeros(len(key), np.int64)
            node[start] = 1
            node = np.cumsum(node) - 1
            is_one = ((key >> U(7 - bit)) & U(1)).astype(float)
            zeros, ones = np.add.reduceat(self.n[d] * (1 - is_one), start), np.add.reduceat(self.n[d] * is_one, start)
            below = None
            if weighted is not None:
                parent = node[self.up[d + 1][first]]
                out[d + 1] = (*out[d + 1], parent)
                below = np.bincount(parent, weights=weighted, minlength=len(start))
            if d == TOP:
                out[d] = (start, node, zeros, ones, below)
            else:
                weight, weighted = climb(zeros, ones, below)
                out[d], first = (start, node, zeros, ones, weight), start
        return out

    def names(self, bit: int, start: np.ndarray) -> np.ndarray:
        """Context and path of the nodes of TOP bytes, as one number."""
        key = self.key[TOP][start]
        return ((key >> U(8)) << U(8)) | (U(1) << U(bit)) | ((key & U(255)) >> U(8 - bit))

    def tops(self) -> tuple[np.ndarray, ...]:
        """Name, zeros, ones and what lies below of all nodes of TOP bytes."""
        parts = []
        for bit in range(8):
            start, _, zeros, ones, below = self.levels(bit)[TOP]
            parts.append((self.names(bit, start), zeros, ones, below))
        return tuple(np.concatenate(x) for x in zip(*parts))

    def values(self, name: np.ndarray, done: np.ndarray, left: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Decimal logarithm of each gram's probability, in the order that the grams came in, from the states at TOP."""
        by = np.argsort(name)
        name, state = name[by], [x[by] for x in (done, left, last)]
        out = np.zeros(len(self.order))
        for bit in range(8):
            levels = self.levels(bit)
            at = np.searchsorted(name, self.names(bit, levels[TOP][0]))
            done, left, last = (x[at] for x in state)
            for d in range(TOP + 1, self.depth + 1):
                _, _, zeros, ones, weight, parent = levels[d]
                seen, p = zeros + ones > 0, (ones + 0.5) / (zeros + ones + 1)
                done, left, last = done[parent], left[parent], np.where(seen, p, last[parent])
                done = done + np.where(seen, left * weight * p, 0.0)
                left = np.where(seen, left * (1 - weight), left)
            one = (done + left * last)[levels[self.depth][1]]
            is_one = ((self.key[self.depth] >> U(7 - bit)) & U(1)).astype(bool)
            out += np.log10(np.where(is_one, one, 1 - one))
        back = np.empty_like(out)
        back[self.order] = out
        return back


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = key * U(0x9E3779B97F4A7C15)
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return ((h >> U(32)) % U(buckets)).astype(np.int64)


def spread(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and where each bucket's part ends in it."""
    return np.argsort(bucket.astype(np.uint16) if buckets <= 65536 else bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=buckets))


def packed(a: np.ndarray) -> bytes:
    """An array's bytes, all first ones first and so on, which compress well where numbers ascend or are small."""
    return zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def unpacked(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T).view(kind).ravel()


def distinct(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of texts, sorted, with their counts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in batches(iter(texts), CHUNK, lambda t: len(t) + DEPTH):
        key = grams(part)[0]
        key.sort()
        at = runs(key)
        held.append((key[at], np.diff(np.append(at, len(key))).astype(np.uint32)))
        if len(held) == 4:
            held[:] = [summed(*map(np.concatenate, zip(*held)))]
    return summed(*map(np.concatenate, zip(*held))) if held else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))


def _asks(block: pa.Table, buckets: int) -> pa.Table:
    """A block's distinct grams and words with their counts in learned texts, by bucket: grams in the lower half, words in the upper."""
    texts, learned = as_bytes(block.column("text")), block.column("learned").to_pylist()
    known, other = distinct([t for t, y in zip(texts, learned) if y]), distinct([t for t, y in zip(texts, learned) if not y])[0]
    key, n = summed(np.concatenate([known[0], other]), np.concatenate([known[1], np.zeros(len(other), np.uint32)]))
    del known, other
    order, ends = spread(bucket_of(key, buckets), buckets)
    # sums come as 64 bits; a block has fewer than 2**32 bytes of text
    key, n, cut = key[order], n[order].astype(np.uint32), ends[:-1]
    blobs = [(b, packed(k), packed(c)) for b, (k, c) in enumerate(zip(np.split(key, cut), np.split(n, cut))) if len(k)]
    del key, n, order
    # the end token is the empty word: no word is empty
    count, others = Counter({b"": sum(learned)}), set()
    for t, y in zip(texts, learned):
        (count.update if y else others.update)(t.lower().split())
    words = sorted(count.keys() | others)
    order, ends = spread(bucket_of(word_hashes(words), buckets), buckets)
    n = np.fromiter((count[w] for w in words), np.uint32, len(words))[order]
    low = 0
    for b, high in enumerate(ends.tolist()):
        if high > low:
            blobs.append((buckets + b, zstandard.compress(b" ".join([words[k] for k in order[low:high].tolist()]), 1), packed(n[low:high])))
        low = high
    of = [block.column("block")[0].as_py()] * len(blobs)
    return pa.table({"bucket": pa.array([b for b, _, _ in blobs], pa.int64()), "block": pa.array(of, pa.int64()), "keys": pa.array([k for _, k, _ in blobs], pa.binary()), "counts": pa.array([c for _, _, c in blobs], pa.binary())})


def _blobs(asks: pa.Table) -> tuple[list[int], list[bytes], list[np.ndarray]]:
    return asks.column("block").to_pylist(), asks.column("keys").to_pylist(), [unpacked(c, np.uint32) for c in asks.column("counts").to_pylist()]


def same_size(keys, values: np.ndarray) -> None:
    if len(keys) != len(values):
        raise ValueError(f"{len(values)} numbers for {len(keys)} keys")


def _counted(asks: pa.Table, buckets: int) -> pa.Table:
    """The distinct grams of a bucket with their counts in the corpus; nothing for a bucket of words."""
    key, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if asks.column("bucket")[0].as_py() < buckets:
        _, keys, counts = _blobs(asks)
        keys = [unpacked(k, np.uint64) for k in keys]
        for k, c in zip(keys, counts):
            same_size(k, c)
        key, n = summed(np.concatenate(keys), np.concatenate(counts).astype(np.int64))
    return pa.table({"gram": pa.array(key.view(np.int64)), "n": pa.array(n)})


def _answers(asks: pa.Table, values: pa.Table, buckets: int) -> pa.Table:
    """To each block of a bucket what it asked for, in its order: code lengths of grams, or counts of words; and once the bucket's number of learned words."""
    if not asks.num_rows:
        return pa.table({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "found": pa.array([], pa.binary()), "n_learned": pa.array([], pa.int64())})
    bucket, (blocks, keys, counts) = asks.column("bucket")[0].as_py(), _blobs(asks)
    n_learned = 0
    if bucket < buckets:
        key, value = values.column("gram").to_numpy().view(np.uint64), values.column("value").to_numpy()
        order = np.argsort(key)
        key, value = key[order], value[order]
        value = np.rint(value / UNIT).astype(np.int64)
        found = [packed(value[np.searchsorted(key, unpacked(k, np.uint64))]) for k in keys]
    else:
        total: dict[bytes, int] = {}
        words = lambda k: zstandard.decompress(k).split(b" ")
        for k, c in zip(keys, counts):
            same_size(words(k), c)
            for w, x in zip(words(k), c.tolist()):
                total[w] = total.get(w, 0) + x
        found = [packed(np.fromiter(map(total.__getitem__, words(k)), np.int64, len(c))) for k, c in zip(keys, counts)]
        n_learned = sum(x > 0 for x in total.values())
    return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([bucket] * len(blocks), pa.int64()), "found": pa.array(found, pa.binary()), "n_learned": pa.array([n_learned] + [0] * (len(blocks) - 1), pa.int64())})


def text_scores(texts: list[bytes], answer) -> tuple[np.ndarray, np.ndarray]:
    """Sums over each text of its grams' code lengths, and its coded bytes; ``answer`` gives those of all distinct grams, sorted."""
    every = distinct(texts)[0]
    value = answer(every)
    out, sizes = [], []
    for part in batches(iter(texts), CHUNK, lambda t: len(t) + DEPTH):
        key, size = grams(part)
        order = np.argsort(key)
        key = key[order]
        at = runs(key)
        each = np.empty(len(order))
        each[order] = np.repeat(value[np.searchsorted(every, key[at])], np.diff(np.append(at, len(order))))
        out.append(np.add.reduceat(each, np.cumsum(size) - size))
        sizes.append(size)
    return np.concatenate(out), np.concatenate(sizes)


def _scores(block: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """The rows of a block with their scores, from the answers of all buckets."""
    texts = as_bytes(block.column("text"))
    found = dict(zip(answers.column("bucket").to_pylist(), answers.column("found").to_pylist()))
    n_learned = sum(answers.column("n_learned").to_pylist())

    def gathered(bucket: np.ndarray, first: int) -> np.ndarray:
        order, _ = spread(bucket, buckets)
        out = np.empty(len(bucket), np.int64)
        out[order] = np.concatenate([unpacked(found.pop(first + b), np.int64) for b in range(buckets) if first + b in found])
        return out

    score, size = text_scores(texts, lambda key: gathered(bucket_of(key, buckets), 0) * UNIT)
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    number[b""]  # the end token
    ids, n = [], []
    for t in texts:
        ws = t.lower().split()
        ids.append(np.fromiter(map(number.__getitem__, ws), np.int32, len(ws)))
        n.append(len(ws) + 1)
    words = list(number)
    order = np.array(sorted(range(len(words)), key=words.__getitem__))
    c = np.empty(len(words), np.int64)
    c[order] = gathered(bucket_of(word_hashes([words[k] for k in order.tolist()]), buckets), buckets)
    each = c[np.concatenate([x for i in ids for x in (i, [0])])]
    first = np.cumsum(n) - n
    known, base = np.add.reduceat((each > 0).astype(np.int64), first), np.add.reduceat(np.log10(each + 0.5), first)
    new = {"n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "base_sum": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()), "n_coded": pa.array(size, pa.int64())}
    return pa.table({"doc_id": block.column("doc_id"), "learned": block.column("learned"), **new, "v_share": pa.array([n_learned] + [0] * (len(texts) - 1), pa.int64())})


def _above(tops: DataFrame) -> DataFrame:
    """States at TOP, ``node, done, left, last``, from the sums ``node, zeros, ones, below`` there.

    A level has a row for each context of that many bytes and path: 255 at depth 0, 65,280 at depth 1, whatever the corpus.
    """
    @F.arrow_udf("struct<weight:double,weighted:double>")
    def climbed(zeros: pa.Array, ones: pa.Array, below: pa.Array) -> pa.Array:
        weight, weighted = climb(*(x.to_numpy(zero_copy_only=False) for x in (zeros, ones, below)))
        return pa.StructArray.from_arrays([pa.array(weight), pa.array(weighted)], ["weight", "weighted"])

    # the name of a parent: its context without the oldest byte, which is the lowest, and the same path
    parent = F.shiftleft(F.shiftright("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(255))

    def level(sums: DataFrame) -> DataFrame:
        c = sums.withColumn("c", climbed("zeros", "ones", "below"))
        return c.select("node", "zeros", "ones", F.col("c.weight").alias("weight"), F.col("c.weighted").alias("weighted"))

    levels = {TOP: level(tops)}
    for depth in range(TOP, 0, -1):
        sums = levels[depth].groupBy(parent.alias("node")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        levels[depth - 1] = level(sums)

    def entered(rows: DataFrame, done: Column, left: Column, last: Column) -> DataFrame:
        n = F.col("zeros") + F.col("ones")
        p = (F.col("ones") + 0.5) / (n + 1)
        w = F.when(n > 0, F.col("weight")).otherwise(0.0)
        return rows.select("node", (done + left * w * p).alias("done"), (left * (1 - w)).alias("left"), F.when(n > 0, p).otherwise(last).alias("last"))

    states = entered(levels[0], F.lit(0.0), F.lit(1.0), F.lit(0.5))
    for depth in range(1, TOP + 1):
        before = states.select(F.col("node").alias("of"), F.col("done").alias("d"), F.col("left").alias("l"), F.col("last").alias("q"))
        states = entered(levels[depth].join(F.broadcast(before), parent == F.col("of")), F.col("d"), F.col("l"), F.col("q"))
    return states


def model_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", learned: str = "learned") -> DataFrame:
    """``doc_id, learned, n_tokens, n_known, base_sum, score, n_coded, v_share`` of each row of ``docs`` (with a boolean ``learned``).

    score is the model's log10 probability of the whole text and n_coded the number of bytes that it codes, base_sum the sum of
    log10(count + 0.5) over its tokens, and ``v_share`` adds up to the number of distinct training tokens over all rows.  Null
    and empty texts are one end token; a null in ``learned`` counts as false; repeated rows count each and score alike; null ids
    are ids; ties don't arise; an empty table gives an empty table.  A very long text is coded whole, in one block, CHUNK bytes
    or one text at a time.  Only the three named columns are read, so others can't clash.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(learned), F.lit(False)).alias("learned"))
    n_blocks = blocks_for(rows, "text", BLOCK_BYTES)
    buckets = 64 + n_blocks // 4
    # one exchange of the texts feeds the asks and the scores, one of the asks the counts and the answers
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", text_key(F.col("text"))), F.lit(n_blocks))).repartition(partitions_for(spark, n_blocks, 4), "block")

    def asked(block: pa.Table) -> pa.Table:
        return _asks(block, buckets)

    def counted(asks: pa.Table) -> pa.Table:
        return _counted(asks, buckets)

    def answered(asks: pa.Table, values: pa.Table) -> pa.Table:
        return _answers(asks, values, buckets)

    def scored(block: pa.Table, answers: pa.Table) -> pa.Table:
        return _scores(block, answers, buckets)

    def subtree(rows: pa.Table) -> Subtree:
        return Subtree(rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy())

    def topped(lot: pa.Table) -> pa.Table:
        name, zeros, ones, below = subtree(lot).tops()
        return pa.table({"lot": pa.array(np.full(len(name), lot.column("lot")[0].as_py())), "node": pa.array(name.view(np.int64)), "zeros": pa.array(zeros), "ones": pa.array(ones), "below": pa.array(below)})

    def valued(lot: pa.Table, states: pa.Table) -> pa.Table:
        name, *state = (states.column(c).to_numpy() for c in ("node", "done", "left", "last"))
        gram = lot.column("gram").to_numpy()
        value = subtree(lot).values(name.view(np.uint64), *state)
        return pa.table({"bucket": pa.array(bucket_of(gram.view(np.uint64), buckets)), "gram": pa.array(gram), "value": pa.array(value)})

    asks = dealt.groupBy("block").applyInArrow(asked, "bucket bigint, block bigint, keys binary, counts binary").repartition(partitions_for(spark, buckets, 1), "bucket").groupBy("bucket")
    counts = asks.applyInArrow(counted, "gram bigint, n bigint")
    lots = counts.withColumn("lot", F.pmod(F.xxhash64(F.shiftright("gram", 8 * (DEPTH - TOP))), F.lit(buckets))).groupBy("lot")
    tops = lots.applyInArrow(topped, "lot bigint, node bigint, zeros double, ones double, below double")
    states = _above(tops.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))))
    back = tops.select("lot", F.col("node").alias("of_node")).join(states.hint("merge"), F.col("of_node") == F.col("node")).select("lot", "node", "done", "left", "last")
    values = lots.cogroup(back.groupBy("lot")).applyInArrow(valued, "bucket bigint, gram bigint, value double")
    answers = asks.cogroup(values.groupBy("bucket")).applyInArrow(answered, "block bigint, bucket bigint, found binary, n_learned bigint")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, f"doc_id {kind}, learned boolean, n_tokens bigint, n_known bigint, base_sum double, score double, n_coded bigint, v_share bigint")


def op4_lm_scoring(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.withColumn("learned", fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    rows = staged(model_scores(docs), "scores")
    total = rows.agg(F.coalesce(F.sum(F.when(F.col("learned"), F.col("n_tokens"))), F.lit(0)).alias("n"), F.coalesce(F.sum("v_share"), F.lit(0)).alias("v")).first()
    floor = math.log10(total.n + 0.5 * (total.v + 1))
    base = F.col("base_sum") - F.col("n_tokens") * F.lit(floor)
    bits = -F.col("score") * math.log2(10) / F.col("n_coded")
    return rows.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", F.lit(total.n).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score", bits.alias("bits_per_byte"))
