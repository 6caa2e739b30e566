"""Phrase collocations of two to four words from counts of the longest windows alone.

Every place in a piece of text gives one row: the word and the words that lead it by one, two and three places, padded at the
piece's end.  Equal rows are counted, and a ROLLUP over the four columns sums them to shorter prefixes: as each place starts one
window, the count of a prefix is the count of that phrase.  Phrases are never exploded by length.

Most windows hold phrases that are too rare to matter, or too weak to be among a language's best.  Windows are cut (padded early) to
the phrases whose counts are asked for, in three passes over the texts:

1. hashes of one to four words are counted in buckets, which bound the count of each phrase from above;
2. words are counted, and the phrases of one bucket in ``SAMPLED``, from which a score is guessed for each language that enough phrases reach;
3. counted are phrases whose bounds let them reach the guessed score, the parts of such, and the longer phrases that hold one.

The guess decides nothing: if fewer than ``top`` phrases of a language are found at or above it, that language is counted anew without
one.  The bounds are tables of a fixed number of bits, so what a task is sent doesn't grow; if a corpus fills them, less is cut and
the same comes out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, documents, mix, staged, word_hashes
from .context_tree import packed, unpacked

LEAST, SHARE, TOP, LONGEST = 30, 80, 2000, 4
#: Places whose windows a task works on at once, distinct words after which it numbers words anew, and what it gathers before it hands on.
PLACES, WORDS, HELD = 1_000_000, 500_000, 4_000_000
#: Buckets for phrases of each length as a power of two, and of those the ones that are summed together.
BUCKET_BITS, CHUNK_BITS = 26, 20
#: One bucket in so many whose phrases are counted before a score is guessed, and how many times as many as ``top`` shall reach the guess.
SAMPLED, AMPLE = 32, 4
#: Where levels of counts begin, as multiples of the least count: of phrases, close where most lie, and of words, 8 to an octave.
LEVELS = np.array([1, 1.25, 1.5, 2, 2.5, 3, 4, 6, 8, 16, 32, 128, 512, 2048, 16384])
WORD_LEVELS = 2 ** (np.arange(254) / 8)
#: What has the last level isn't bounded, nor is any count as large as this.
UNBOUNDED = 1 << 40
#: Sub-tables in which a language's best are found before they meet.
SALTS = 64
BREAKS = b".,;:!?\n\x0b\x0c\r"
COLUMNS = ["w1", "w2", "w3", "w4"]

U = np.uint64


class Places:
    """Numbered words of texts in order, 0 between pieces, and the language of each; the numbers stay while texts come and go."""

    _same = bytes.maketrans(BREAKS + b"\t", b"\n" * len(BREAKS) + b" ")

    def __init__(self):
        self.words: defaultdict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.hashes = np.zeros(0, np.uint64)
        self.langs: dict[str, int] = {}
        self.words[b"\n"], self.words[b""]  # 0 and 1
        self.clear()

    def clear(self) -> None:
        self.parts: list[np.ndarray] = []
        self.of: list[tuple[int, int]] = []
        self.size = 0

    def add(self, text: bytes, lang: str) -> None:
        tokens = text.lower().translate(self._same).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens))
        ids = np.append(ids[ids != 1], np.int32(0))
        self.parts.append(ids)
        self.of.append((self.langs.setdefault(lang, len(self.langs)), len(ids)))
        self.size += len(ids)

    @property
    def crowded(self) -> bool:
        return len(self.words) >= WORDS or len(self.langs) >= 1 << 11

    def windows(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Language and the four words of each place that has a word, 0 as padding."""
        x = np.concatenate([*self.parts, np.zeros(LONGEST - 1, np.int32)])
        lang = np.repeat(*np.array(self.of, np.int64).reshape(-1, 2).T)
        at = np.flatnonzero(x[: self.size])
        held = [x[at]]
        for k in range(1, LONGEST):
            held.append(np.where(held[-1] > 0, x[at + k], 0))
        return lang[at], held

    def buckets(self, lang: np.ndarray, held: list[np.ndarray], bucket_bits: int) -> list[np.ndarray]:
        """The bucket of the first one, two, three and four words of each window; only of use where it is that long."""
        self.hashes = np.append(self.hashes, word_hashes(list(islice(self.words, len(self.hashes), None))))
        g, out = word_hashes([s.encode() for s in self.langs])[lang], []
        for w in held:
            g = mix(g, self.hashes[w])
            out.append((g >> U(64 - bucket_bits)).astype(np.uint32))
        return out


def sliced(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[Places, bool]]:
    """The texts of a task in slices of ``limit`` places, a very long text in one; true with the last one before words are numbered anew."""
    places = Places()
    for b in batches:
        for text, lang in zip(as_bytes(b.column("text")), b.column("lang").to_pylist()):
            if text:
                places.add(text, lang)
            if places.size >= limit or places.crowded:
                crowded = places.crowded
                yield places, crowded
                places.clear()
                if crowded:
                    places = Places()
    yield places, True


def starts(least: int, of: np.ndarray) -> np.ndarray:
    """The lowest count of each level from 1 on; counts of level 0 are below ``least``."""
    return np.ceil(least * of).astype(np.int64)


def level(count: np.ndarray, least: int, of: np.ndarray) -> np.ndarray:
    return np.searchsorted(starts(least, of), count, side="right").astype(np.uint8)


def blobs_of(held: list[tuple[np.ndarray, np.ndarray]], chunk_bits: int) -> pa.RecordBatch:
    """For each length distinct buckets in order and their numbers, as a row for each chunk of buckets."""
    rows = []
    for n, (bucket, number) in enumerate(held):
        if len(bucket):
            chunk = bucket >> chunk_bits
            cut = np.flatnonzero(np.diff(chunk)) + 1
            start = np.append(0, cut)
            step = np.diff(bucket, prepend=np.uint32(0)).astype(np.uint32)
            step[start] = bucket[start] & ((1 << chunk_bits) - 1)
            rows += [(n, c, packed(s), packed(k)) for c, s, k in zip(chunk[start].tolist(), np.split(step, cut), np.split(number.astype(np.uint32), cut))]
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["n", "chunk", "steps", "counts"])


def tables_of(blobs: DataFrame, lengths: int, bucket_bits: int, bits: int, start: int, meet: np.ufunc, entries: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """For each length the 2**bits bytes that ``entries`` makes of the buckets' numbers in ``blobs``; so much comes to the driver, whatever the input."""

    chunk_bits = min(CHUNK_BITS, bucket_bits)

    def folded(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([packed(entries(total))], pa.binary())], names=["n", "chunk", "levels"])

        key, total = None, None
        for b in it:
            for n, chunk, steps, counts in zip(*(b.column(c).to_pylist() for c in ("n", "chunk", "steps", "counts"))):
                if key != (n, chunk):
                    if key:
                        yield done()
                    key, total = (n, chunk), np.full(1 << chunk_bits, start, np.int64)
                # the places of one blob are distinct
                at = np.cumsum(unpacked(steps, np.uint32))
                total[at] = meet(total[at], unpacked(counts, np.uint32))
        if key:
            yield done()

    tables = [np.zeros(1 << bits, np.uint8) for _ in range(lengths)]
    width = 1 << (bits - bucket_bits + chunk_bits)
    blobs = blobs.repartition("n", "chunk").sortWithinPartitions("n", "chunk")
    for r in blobs.mapInArrow(folded, "n int, chunk int, levels binary").toLocalIterator():
        tables[r.n][r.chunk * width : (r.chunk + 1) * width] = unpacked(bytes(r.levels), np.uint8)
    return tables


BLOB = "n int, chunk int, steps binary, counts binary"


def possible(texts: DataFrame, least: int, bucket_bits: int = BUCKET_BITS, limit: int = PLACES) -> list[np.ndarray]:
    """For each length the levels of the buckets' counts, of all phrases in one, two to a byte: no phrase of a bucket is more frequent."""
    chunk_bits = min(CHUNK_BITS, bucket_bits)

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return blobs_of([np.unique(np.concatenate(parts), return_counts=True) for parts in held], chunk_bits)

        held, size = [[] for _ in range(LONGEST)], 0
        for places, _ in sliced(it, limit):
            lang, ws = places.windows()
            for mine, g, w in zip(held, places.buckets(lang, ws, bucket_bits), ws):
                mine.append(g[w > 0])
            size += places.size
            if size >= HELD:
                yield done()
                held, size = [[] for _ in range(LONGEST)], 0
        if size:
            yield done()

    def entries(total: np.ndarray) -> np.ndarray:
        v = level(total, least, LEVELS)
        return v[::2] | v[1::2] << 4

    return tables_of(texts.mapInArrow(counted, BLOB), LONGEST, bucket_bits, bucket_bits - 1, 0, np.add, entries)


def word_floors(words: DataFrame, least: int, bucket_bits: int = BUCKET_BITS) -> np.ndarray:
    """The lowest level of the words of ``words(lang, phrase, a)`` in each bucket: none of them is less frequent.  Of four buckets of phrases one is made."""
    bucket_bits -= 2
    chunk_bits = min(CHUNK_BITS, bucket_bits)

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                g = mix(word_hashes(as_bytes(b.column("lang"))), word_hashes(as_bytes(b.column("phrase")))) >> U(64 - bucket_bits)
                v = level(b.column("a").to_numpy(), least, WORD_LEVELS)
                order = np.lexsort((v, g))
                bucket, first = np.unique(g[order].astype(np.uint32), return_index=True)
                yield blobs_of([(bucket, v[order][first])], chunk_bits)

    blobs = words.select("lang", "phrase", "a").mapInArrow(counted, BLOB)
    return tables_of(blobs, 1, bucket_bits, bucket_bits, 255, np.minimum, lambda v: np.where(v == 255, 0, v).astype(np.uint8))[0]


def after(x: np.ndarray, k: int) -> np.ndarray:
    """``x`` of the place ``k`` further on; places of a piece are neighbours."""
    return np.append(x[k:], np.zeros(min(k, len(x)), x.dtype))


def levels(places: Places, lang: np.ndarray, held: list[np.ndarray], tables: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Levels of the one, two, three and four words from each place, 0 where they can't be frequent; and their buckets.

    The first of ``tables`` is that of ``possible`` or of ``word_floors``.
    """
    buckets, out = places.buckets(lang, held, len(tables[-1]).bit_length()), []
    for table, g, w in zip(tables, buckets, held):
        v = table[g >> 2] if len(table) < len(tables[-1]) else table[g >> 1] >> ((g & 1) << 2).astype(np.uint8) & 15
        v = np.where(w > 0, v, 0).astype(np.uint8)
        if out:
            # a phrase needs both phrases that are one word shorter
            v[(out[-1] == 0) | (after(out[-1], 1) == 0)] = 0
        out.append(v)
    return out, buckets


def sampled_ones(found: list[np.ndarray], buckets: list[np.ndarray], sampled: int) -> list[np.ndarray]:
    """Which phrases are counted in the second pass: words, and phrases of one bucket in ``sampled``."""
    return [found[0] > 0] + [(v > 0) & (g % sampled == 0) for v, g in zip(found[1:], buckets[1:])]


def asked(found: list[np.ndarray], goal: np.ndarray, least: int) -> list[np.ndarray]:
    """Which phrases are counted in the third pass, from their levels and the score that is to be reached at each place.

    It depends on the words of a phrase and its language alone, so that a phrase is counted at all of its places or at none.
    """

    def bound(a: np.ndarray, left: np.ndarray, right: np.ndarray | int) -> np.ndarray:
        # parts are as frequent as the phrase at least, so this rises with a
        return 2_000_000 * a // np.maximum(np.maximum(left, a) + np.maximum(right, a), 1)

    word = np.append(0, starts(least, WORD_LEVELS))[found[0]]
    over = np.append(np.minimum(starts(least, LEVELS) - 1, UNBOUNDED), UNBOUNDED)
    most: list[np.ndarray] = []
    for v in found[1:]:
        a = over[v]
        most.append(np.minimum(a, np.minimum(most[-1], after(most[-1], 1))) if most else a)
    hot, part = [], []
    for n, (v, a) in enumerate(zip(found[1:], most), 1):
        last = after(word, n)
        # a longer phrase has a cut with its first word alone and one with its last
        top = bound(a, word, last) if n == 1 else bound(a, np.maximum(word, last), 0)
        hot.append((v > 0) & (top >= goal))
        # what it is a part of has its first or its last word, and is no more frequent
        part.append((v > 0) & (bound(a, np.minimum(word, last), 0) >= goal))
    pair, three, four = hot
    holds_three = (found[2] > 0) & (pair | after(pair, 1))
    holds_four = (found[3] > 0) & (pair | after(pair, 1) | after(pair, 2) | three | after(three, 1))
    return [np.zeros(len(word), bool), part[0], part[1] | holds_three, four | holds_four]


def cut(lang: np.ndarray, held: list[np.ndarray], wanted: list[np.ndarray], every: bool) -> tuple[np.ndarray, list[np.ndarray]]:
    """Windows padded after the longest phrase that is wanted; beside the language a bit for each length that is.  Without ``every`` only those with one."""
    lang, longer, out = lang << 4, np.zeros(len(lang), bool), []
    for n in range(LONGEST - 1, -1, -1):
        lang = lang | wanted[n].astype(np.int64) << n
        longer = longer | wanted[n]
        out.append(np.where(longer, held[n], 0))
    at = slice(None) if every else np.flatnonzero(longer)
    return lang[at], [w[at] for w in reversed(out)]


def distinct(lang: np.ndarray, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows as two numbers, language with its bits and first two words, and the last two words; and their counts."""
    a = (lang << 48) | (held[0].astype(np.int64) << 24) | held[1]
    b = (held[2].astype(np.int64) << 24) | held[3]
    short = b == 0
    one, n_one = np.unique(a[short], return_counts=True)
    # long windows: pairs of numbers of their halves
    lefts, left = np.unique(a[~short], return_inverse=True)
    rights, right = np.unique(b[~short], return_inverse=True)
    two, n_two = np.unique((left << 32) | right, return_counts=True)
    return np.append(one, lefts[two >> 32]), np.append(np.zeros_like(one), rights[two & 0xFFFFFFFF]), np.append(n_one, n_two)


def merged(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of several slices, with the sums of their counts."""
    a, b, n = map(np.concatenate, zip(*found))
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    start = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    return a[start], b[start], np.add.reduceat(n, start) if len(a) else n


def window_counts(texts: DataFrame, tables: list[np.ndarray], choose: Callable[[Places, list[np.ndarray]], tuple[np.ndarray, list[np.ndarray]]], limit: int = PLACES) -> DataFrame:
    """``lang, w1, w2, w3, w4, bits, n``: the distinct windows that ``choose`` makes of ``texts(text, lang)`` by ``tables``, and the lengths that it wants of them."""
    # tables are mostly empty unless the corpus fills them, and files of broadcasts lie on every machine
    shared = texts.sparkSession.sparkContext.broadcast([packed(t) for t in tables])

    def rows_of(places: Places, found: list) -> Iterator[pa.RecordBatch]:
        a, b, n = merged(found)
        low = (1 << 24) - 1
        words = pa.array([b"", b"", *islice(places.words, 2, None)], pa.binary()).cast(pa.string())
        langs = pa.array(list(places.langs), pa.string())
        for k in range(0, len(n), 100_000):
            x, y = a[k : k + 100_000], b[k : k + 100_000]
            columns = [words.take(pa.array(w)) for w in ((x >> 24) & low, x & low, y >> 24, y & low)]
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(x >> 52)), *columns, pa.array((x >> 48) & 15, pa.int32()), pa.array(n[k : k + 100_000])], names=["lang", *COLUMNS, "bits", "n"])

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, found = [unpacked(t, np.uint8) for t in shared.value], []
        for places, end in sliced(it, limit):
            if places.size:
                found.append(distinct(*choose(places, tables)))
            if len(found) >= 8:
                found = [merged(found)]
            if found and (end or len(found[0][0]) >= HELD):
                yield from rows_of(places, found)
                found = []

    rows = texts.mapInArrow(counted, "lang string, w1 string, w2 string, w3 string, w4 string, bits int, n bigint")
    return rows.groupBy("lang", *COLUMNS, "bits").agg(F.sum("n").alias("n"))


def frequent(windows: DataFrame, least: int) -> DataFrame:
    """``lang, ws, phrase, a`` of the phrases that were asked for and occur ``least`` times or more, and of no words for each language; written out."""
    counts = staged(windows, "windows")
    sums = counts.rollup("lang", *COLUMNS).agg(F.sum("n").alias("a"), F.bit_or("bits").alias("bits"), F.grouping_id().alias("gid"))
    length = F.lit(LONGEST) - F.bit_count("gid").cast("int")
    ws = F.slice(F.array(*COLUMNS), F.lit(1), F.greatest(length, F.lit(0)))
    # the last word of a prefix is none if the window ended before; windows of one prefix agree on whether it was asked for
    kept = (length == 0) & F.col("lang").isNotNull() & (F.bit_count("gid") == LONGEST) | (length > 0) & (F.col("a") >= least) & (F.element_at(ws, F.greatest(length, F.lit(1))) != "")
    kept = kept & ((length <= 0) | (F.expr(f"shiftright(bits, greatest({LONGEST} - cast(bit_count(gid) as int) - 1, 0))").bitwiseAND(1) == 1))
    return staged(sums.where(kept).select("lang", ws.alias("ws"), F.array_join(ws, " ").alias("phrase"), "a"), "phrases")


def goals(seen: DataFrame, top: int, sampled: int) -> dict[str, int]:
    """A score for each language that about ``AMPLE`` times ``top`` phrases should reach; none for a language with fewer."""
    word = seen.where(F.size("ws") == 1).select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("a").alias("f"))
    x = seen.where(F.size("ws") > 1).select("lang", "a", F.size("ws").alias("size"), F.element_at("ws", 1).alias("left"), F.element_at("ws", -1).alias("right"))
    x = x.join(word.hint("merge"), (F.col("lang") == F.col("of")) & (F.col("left") == F.col("part"))).select("lang", "a", "size", F.col("f").alias("l"), "right")
    x = x.join(word.hint("merge"), (F.col("lang") == F.col("of")) & (F.col("right") == F.col("part"))).select("lang", "a", "size", "l", F.col("f").alias("r"))
    score = 2_000_000 * F.col("a") / F.when(F.col("size") == 2, F.col("l") + F.col("r")).otherwise(F.greatest("l", "r") + F.col("a"))
    steps = x.groupBy("lang", F.floor(4 * F.log2(score)).alias("step")).count().orderBy(F.col("step").desc()).collect()
    found, out = defaultdict(int), {}
    for r in steps:
        found[r.lang] += r["count"]
        if found[r.lang] * sampled >= AMPLE * top and r.lang not in out and r.step > 0:
            out[r.lang] = int(2 ** (r.step / 4))
    return out


def best_of(phrases: DataFrame, words: DataFrame, goal: dict[str, int], share: int, top: int) -> DataFrame:
    """``lang, phrase, a, l, r, score, rank`` of the first ``top`` of each language, of those that reach its goal; written out."""
    candidates = phrases.where(F.size("ws") > 1)
    f = words.unionByName(candidates).select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("a").alias("f"))
    cuts = candidates.select("lang", "phrase", "a", F.size("ws").alias("size"), "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cuts = staged(cuts.select("lang", "phrase", "a", "size", "k", F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("ws", F.col("k") + 1, F.col("size")), " ").alias("right")), "cuts")
    cuts = cuts.join(f.hint("merge"), (F.col("lang") == F.col("of")) & (F.col("left") == F.col("part"))).select("lang", "phrase", "a", "size", "k", F.col("f").alias("l"), "right")
    cuts = cuts.join(f.hint("merge"), (F.col("lang") == F.col("of")) & (F.col("right") == F.col("part"))).select("lang", "phrase", "a", "size", "k", "l", F.col("f").alias("r"))
    score = F.expr("(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    worst = cuts.groupBy("lang", "phrase", "a", "size").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"), F.count(F.lit(1)).alias("cuts"))
    # a phrase without all of its cuts, or below the goal, was counted for the sake of others
    least = F.lit(0)
    for name, x in goal.items():
        least = F.when(F.col("lang") == name, x).otherwise(least)
    worst = worst.where((F.col("cuts") == F.col("size") - 1) & (F.col("cut.score") >= least))
    # the words within longer phrases, with the count of the most frequent one
    spans = [(i, n) for n in range(2, LONGEST) for i in range(1, LONGEST - n + 2)]
    inner = F.filter(F.array(*(F.when((F.size("ws") > n) & (F.size("ws") >= i + n - 1), F.array_join(F.slice("ws", i, n), " ")) for i, n in spans)), lambda p: p.isNotNull())
    held = candidates.where(F.size("ws") > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
    held = held.groupBy(F.col("lang").alias("of"), F.col("phrase").alias("part")).agg(F.max("a").alias("outer"))
    kept = worst.join(held.hint("merge"), (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("part")), "left")
    kept = kept.where(F.coalesce(100 * F.col("outer") < share * F.col("a"), F.lit(True))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    best = kept.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return staged(best, "best")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = SHARE, top: int = TOP, bucket_bits: int = BUCKET_BITS, limit: int = PLACES, sampled: int = SAMPLED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases.

    A phrase's score is that of its worst cut, of equal ones the first.  A phrase is dropped if a longer one that holds it, dropped or not,
    has ``share`` hundredths of its occurrences or more.  Null texts are empty, a null language is ``und``; repeated rows count each;
    ranks have no ties, as phrases of a language differ; texts without words and an empty table give no rows.  A very long text
    is read whole, in one task.  Only the two named columns are read, so others can't clash.  Joins are on language and phrase; the
    parts of phrases are as uneven as words are, and Spark splits what is large in them, for they are read from written tables.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    tables = possible(texts, least, bucket_bits, limit)

    def some(places: Places, tables: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        lang, held = places.windows()
        return cut(lang, held, sampled_ones(*levels(places, lang, held, tables), sampled), True)

    seen = frequent(window_counts(texts, tables, some, limit), least)
    words = seen.where(F.size("ws") == 1)
    tables[0] = word_floors(words, least, bucket_bits)

    def best(texts: DataFrame, goal: dict[str, int]) -> DataFrame:
        def able(places: Places, tables: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
            lang, held = places.windows()
            goals = np.array([goal.get(x, 0) for x in places.langs], np.int64)[lang]
            return cut(lang, held, asked(levels(places, lang, held, tables)[0], goals, least), False)

        return best_of(frequent(window_counts(texts, tables, able, limit), least), words, goal, share, top)

    goal = goals(seen, top, sampled)
    found = best(texts, goal)
    reached = {r.lang: r["count"] for r in found.groupBy("lang").count().collect()} if goal else {}
    if short := [x for x in goal if reached.get(x, 0) < top]:
        found = found.where(~F.col("lang").isin(short)).unionByName(best(texts.where(F.col("lang").isin(short)), {}))
    totals = seen.where(F.size("ws") == 0).select(F.col("lang").alias("of"), F.col("a").alias("n"))
    return found.join(totals.hint("merge"), F.col("lang") == F.col("of")).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir):
    return collocations(documents(spark, sf_dir))


OP12_SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
grams AS (SELECT lang, k.k, unnest(list_transform(range(1, len(w) - k.k + 2), lambda i: array_to_string(list_slice(w, i, i + k.k - 1), ' '))) AS phrase FROM worded, (VALUES (1), (2), (3), (4)) k(k) WHERE len(w) >= k.k),
f AS MATERIALIZED (SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS ws, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, size, ws, a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
scored AS (SELECT c.lang, c.phrase, c.a, min((CAST((CAST(2000000 AS HUGEINT) * c.a) // (x.a + y.a) AS BIGINT), c.k, x.a, y.a)) AS t
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.ws, 1, c.k), ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.ws, c.k + 1, c.size), ' ') GROUP BY ALL),
inner_ones AS (SELECT lang, a, unnest(list_transform(range(1, size - n + 2), lambda i: array_to_string(list_slice(ws, i, i + n - 1), ' '))) AS phrase FROM f, (VALUES (2), (3)) m(n) WHERE size > n),
outer_ones AS (SELECT lang, phrase, max(a) AS most FROM inner_ones GROUP BY ALL),
kept AS (SELECT s.lang, s.phrase, s.a, t[3] AS l, t[4] AS r, t[1] AS score FROM scored s LEFT JOIN outer_ones o ON o.lang = s.lang AND o.phrase = s.phrase WHERE o.most IS NULL OR 100 * o.most < 80 * s.a),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept QUALIFY rank <= 2000)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN totals USING (lang)"""
