"""Toxicity by a weighted lexicon.

Texts are folded (lower case, look-alike letters of other scripts and full-width forms to Latin, digits and signs that stand
for letters to those letters), then an Aho-Corasick automaton finds all terms and exception phrases in one pass.  A hit inside
an exception phrase doesn't count.  The hits' weights, alone and by the length of the text, give a score between 0 and 1.

The lexicon is learned: terms are words, and beginnings of words, whose documents are labelled toxic far more often than
others; a term's weight is its log odds.  Exception phrases are learned too: a hit with the word before or after it, found in
documents that are labelled clean and hardly ever in toxic ones.  Counting runs on Spark over a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, documents, fold

FOLDS, HELD_OUT = 4, 2
#: Labelled rows that the lexicon is learned from at most, chosen by a hash of the id.
SAMPLE_ROWS = 20_000
#: A term is in at least this many toxic documents, and this share of them; its log odds are at least MIN_ODDS.
MIN_DOCS, MIN_SHARE, MIN_ODDS = 3, 0.01, 3.0
PREFIXES = (4, 5, 6, 7)
THRESHOLD = 0.3
#: An exception phrase is in at least this many clean documents, and its log odds of being toxic are at most this.
SPARED_DOCS, SPARED_ODDS = 3, -1.0

#: Look-alikes (fixed values): Cyrillic and Greek letters drawn like Latin ones.
LOOKALIKES = dict(zip("абвеёіјкмнорсѕтухһԁԛԝαβεηικνορτυχϲ", "abbeeijkmhopcstyxhdqwabenikvoptuxc"))
#: Digits and signs written for letters (fixed values).
STAND_INS = dict(zip("013457@$", "oieastas"))

_table = str.maketrans(LOOKALIKES | {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)})
_foreign = re.compile("[" + "".join(LOOKALIKES) + "\uff01-\uff5e]")
_digits = re.compile("[" + re.escape("".join(STAND_INS)) + "]+")
_to_letters = str.maketrans(STAND_INS)
_other_signs = re.compile(r"[^\w\x00-\x7f]")
#: ASCII bytes that are neither letter nor digit become spaces.
_spaced = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def folded(text: str) -> str:
    """``text`` in folded form: words between single spaces; digits and signs are letters where they touch letters."""
    t = text.lower()
    if not t.isascii():
        if _foreign.search(t):
            t = t.translate(_table).lower()
        t = _other_signs.sub(" ", t)
    if _digits.search(t):
        beside = lambda m: t[m.start() - 1 : m.start()].isalpha() or t[m.end() : m.end() + 1].isalpha()
        t = _digits.sub(lambda m: m[0].translate(_to_letters) if beside(m) else m[0], t)
    return " " + b" ".join(t.encode("utf-8", "replace").translate(_spaced).split()).decode() + " "


def terms(text: str) -> set[str]:
    """The terms that a text could give the lexicon: `` word `` and `` beginning``."""
    ws = set(folded(text).split(" ")) - {""}
    return {f" {w} " for w in ws} | {f" {w[:n]}" for w in ws for n in PREFIXES if len(w) > n}


def choose(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms and weights from ``(term, toxic documents, clean documents)``; a term is left out if a beginning of it is in."""
    odds = {}
    for t, a, c in counts:
        w = math.log((a + 0.5) / (n_toxic - a + 0.5)) - math.log((c + 0.5) / (n_clean - c + 0.5))
        if a >= max(MIN_DOCS, MIN_SHARE * n_toxic) and w >= MIN_ODDS:
            odds[t] = (w, a)
    # a beginning gives way to a longer term that is nearly as frequent, and stands for all others that start with it
    beginnings = lambda t: (t[:n] for n in range(2, len(t)) if t[:n] in odds)
    vague = {p for t in odds for p in beginnings(t) if odds[t][1] >= 0.8 * odds[p][1]}
    odds = {t: x for t, x in odds.items() if t not in vague}
    kept = {t: w for t, (w, _) in odds.items() if not any(t[:n] in odds for n in range(2, len(t)))}
    return {t: kept[t] for t in sorted(kept)}


class Lexicon:
    """Terms with weights and exception phrases in one automaton, and the score's coefficients."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = (), coefficients: tuple[float, float, float] = (-4.0, 1.5, 1.5)):
        import ahocorasick

        self.weights, self.exceptions, self.coefficients = weights, tuple(exceptions), coefficients
        self.automaton = ahocorasick.Automaton()
        for t, w in weights.items():
            self.automaton.add_word(t, (len(t), w))
        for e in self.exceptions:
            self.automaton.add_word(f" {e} ", (len(e) + 2, None))
        self.automaton.make_automaton()
        self.any = bool(len(self.automaton))

    def hits(self, t: str) -> list[tuple[int, int, float]]:
        """First and last place and weight of each hit in a folded text, in order; of several that begin at one place the heaviest.

        A hit that lies inside an exception phrase is none.
        """
        found = sorted(((end - n + 1, end, w) for end, (n, w) in self.automaton.iter(t)), key=lambda x: (x[0], x[2] is not None, -(x[2] or 0))) if self.any else []
        out, reach, seen = [], -1, -1
        for a, b, w in found:  # phrases come before the terms that begin where they do
            if w is None:
                reach = max(reach, b)
            elif a > seen and b > reach:
                out.append((a, b, w))
                seen = a
        return out

    def phrases(self, text: str) -> set[str]:
        """Each hit's words with the word before them, and with the word after them."""
        t = folded(text)
        out = set()
        for a, b, _ in self.hits(t):
            # a hit begins with the space before its word and ends with the one after it, or inside the word
            hi = t.index(" ", b)
            if a:
                out.add(t[t.rindex(" ", 0, a) + 1 : hi])
            if hi < len(t) - 1:
                out.add(t[a + 1 : t.index(" ", hi + 1)])
        return out

    def measures(self, text: str) -> tuple[float, float]:
        """Logarithms of one plus the summed weights, and of one plus the same by hundred words."""
        t = folded(text)
        total = sum(w for _, _, w in self.hits(t))
        return math.log1p(total), math.log1p(100 * total / max(t.count(" ") - 1, 1))

    def score(self, text: str) -> float:
        a, b = self.measures(text)
        z = self.coefficients[0] + self.coefficients[1] * a + self.coefficients[2] * b
        return 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 0.05) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
    return tuple(map(float, b))


def counts(rows: DataFrame, kinds) -> DataFrame:
    """``kind, a, c``: toxic and clean documents of ``rows(text, toxic)`` that have each of ``kinds(text)``; the empty kind is in all."""

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, of = {0: Counter(), 1: Counter()}, kinds()
        for b in it:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found[int(y > 0)].update(of(t))
                found[int(y > 0)][""] += 1
        # kinds that no toxic document of this task has are sent too: others may have them
        names = list(found[0].keys() | found[1].keys())
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield pa.record_batch([pa.array(part), pa.array([found[1][t] for t in part], pa.int64()), pa.array([found[0][t] for t in part], pa.int64())], ["kind", "a", "c"])

    return rows.mapInArrow(counted, "kind string, a bigint, c bigint").groupBy("kind").agg(F.sum("a").alias("a"), F.sum("c").alias("c"))


def learn(labelled: DataFrame, text: str = "text", toxic: str = "toxic") -> Lexicon:
    """A lexicon from the rows ``(text, toxic)``; rows with a null in either aren't learned from.

    Without a toxic or a clean row the lexicon is empty.  The rows are a bounded sample (``labelled_sample``); terms and phrases
    that reach the driver are those of it that meet the thresholds above.
    """
    from .common import staged

    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(text).alias("text"), F.col(toxic).cast("int").alias("toxic")).where("text is not null and toxic is not null")
    sums = staged(counts(rows, lambda: terms), "terms")
    n_toxic, n_clean = next(((r.a, r.c) for r in sums.where("kind = ''").collect()), (0, 0))
    least = max(MIN_DOCS, MIN_SHARE * n_toxic)
    often = sums.where((F.col("kind") != "") & (F.col("a") >= least)).where(F.col("a") * max(n_clean, 1) > 3 * F.col("c") * max(n_toxic, 1))
    weights = choose([(r.kind, r.a, r.c) for r in often.collect()], n_toxic, n_clean) if n_clean else {}
    if not weights:
        return Lexicon({})
    seen = counts(rows, lambda: Lexicon(weights).phrases).where((F.col("kind") != "") & (F.col("c") >= SPARED_DOCS)).collect()
    odds = lambda r: math.log((r.a + 0.5) / (n_toxic - r.a + 0.5)) - math.log((r.c + 0.5) / (n_clean - r.c + 0.5))
    exceptions = tuple(sorted(r.kind for r in seen if odds(r) <= SPARED_ODDS))

    def measured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(weights, exceptions)
        for b in it:
            m = [own.measures(t) for t in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array([x for x, _ in m], pa.float64()), pa.array([x for _, x in m], pa.float64()), b.column(1)], ["x", "z", "y"])

    sample = rows.mapInArrow(measured, "x double, z double, y int").toPandas()
    return Lexicon(weights, exceptions, fit(sample[["x", "z"]].to_numpy(), (sample["y"] > 0).to_numpy(float)))


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text", name: str = "score") -> DataFrame:
    """Every row of ``docs`` with the score of its whole text.

    Null and empty texts have no hit and the score of a text without one; a very long text is scored whole, in time that follows
    its length and hits; repeated rows score alike; of hits that begin at one place the heaviest counts; an empty table gives an
    empty table; a column of that name is replaced, and there are no other working columns.
    """
    bounded_batches(docs.sparkSession)
    weights, exceptions, coefficients = lexicon.weights, lexicon.exceptions, lexicon.coefficients

    @F.arrow_udf("double")
    def score(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Lexicon(weights, exceptions, coefficients)
        for texts in it:
            yield pa.array([own.score(t or "") for t in texts.to_pylist()], pa.float64())

    return docs.withColumn(name, score(F.col(text)))


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """Text and label of at most ``limit`` labelled rows outside the held-out fold; the ids are chosen before texts are read."""
    from .common import staged

    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    ids = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    ids = staged(ids, "labelled")  # at most ``limit`` rows of two numbers
    return staged(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic"), "sample")


def op1_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    lexicon = learn(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    return scored(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
