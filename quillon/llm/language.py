"""Language identification as a mixture: how much of a document is in each language.

A document's byte trigrams are seen as drawn from a mixture of the learned languages.  Expectation-maximisation finds the
proportions, and the set of languages is the one of highest likelihood less a penalty for each language (as in the Bayesian
information criterion, with a third of the trigrams as sample size, since they overlap).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bounded_batches, documents, fold

FOLDS, HELD_OUT = 4, 2
#: Trigrams are hashed into this many counters for each language, which bounds the model.
BINS = 1 << 14
#: Expectation-maximisation ends for a document when no proportion moves by more than this between looks, EVERY rounds apart.
STEADY, EVERY = 0.005, 4
#: Weight of the penalty for each language beyond the first.
PENALTY = 1.0
#: Trigrams, each times the number of languages, that are worked on at once.
CHUNK = 1 << 22

_letter = re.compile(r"[^\W\d_]")
#: ASCII bytes that aren't letters count as a space.
_spaced = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def trigrams(text: str) -> np.ndarray:
    """Counter number of each trigram of ``text`` in lower case, bounded by spaces; none if it has no letter."""
    if not _letter.search(text):
        return np.zeros(0, np.int64)
    raw = b" " + text.lower().encode("utf-8", "replace").translate(_spaced) + b" "
    x = np.frombuffer(raw, np.uint8).astype(np.uint32)
    with np.errstate(over="ignore"):
        h = x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    blank = (x[:-2] == 32) & (x[1:-1] == 32)
    return ((h >> np.uint32(12)) % np.uint32(BINS))[~blank].astype(np.int64)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Language names and their smoothed log likelihoods of the trigrams, from all rows with a text and a language.

    Counts are summed on Spark; what reaches the driver is BINS counters for each language.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in it:
            for t, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if len(g := trigrams(t)):
                    own = sums.setdefault(l, np.zeros(BINS, np.int64))
                    own += np.bincount(g, minlength=BINS)
        for l, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.record_batch([pa.array([l] * len(at)), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "bin", "n"])

    counts = rows.mapInArrow(counted, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    table = np.zeros((len(names), BINS))
    table[counts["lang"].map({l: k for k, l in enumerate(names)}).to_numpy(int), counts["bin"].to_numpy(int)] = counts["n"].to_numpy(float)
    return names, np.log((table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * BINS))


class Mixture:
    """Documents as counts of trigrams, with the likelihood of each trigram in each language, relative to its best one."""

    def __init__(self, like: np.ndarray, n: np.ndarray, doc: np.ndarray):
        self.like, self.n, self.doc = like, n, doc
        self.first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        self.total = np.add.reduceat(n, self.first).astype(float)

    def of(self, some: np.ndarray) -> Mixture:
        """The documents where ``some`` is true, numbered anew."""
        if some.all():
            return self
        inside = some[self.doc]
        return Mixture(self.like[:, inside], self.n[inside], (np.cumsum(some) - 1)[self.doc[inside]])

    def gain(self, p: np.ndarray) -> np.ndarray:
        """Log likelihood of each document under proportions ``p``, over that of its trigrams' best languages."""
        mixed = (p[:, self.doc] * self.like).sum(axis=0)
        return np.add.reduceat(self.n * np.log(np.maximum(mixed, 1e-300)), self.first)

    def fitted(self, p: np.ndarray) -> np.ndarray:
        """Proportions after expectation-maximisation from ``p``; a document leaves when its own are steady.  Each round raises the likelihood, so all do."""
        out, at, m = p.copy(), np.arange(p.shape[1]), self
        while len(at):
            before = p
            for _ in range(EVERY):
                part = p[:, m.doc] * m.like
                part *= m.n / np.maximum(part.sum(axis=0), 1e-300)
                p = np.add.reduceat(part, m.first, axis=1) / m.total
            out[:, at] = p
            moving = np.abs(p - before).max(axis=0) > STEADY
            at, p = at[moving], p[:, moving]
            m = m.of(moving) if len(at) else m
        return out


def mixtures(grams: list[np.ndarray], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document (with at least one trigram): proportions of all languages, and those of the chosen set, which sum to 1.

    The set grows by the language next in proportion as long as the penalised likelihood rises, up to all languages.
    """
    sizes = np.array([len(g) for g in grams])
    key = np.repeat(np.arange(len(grams)), sizes) * BINS + np.concatenate(grams)
    key, n = np.unique(key, return_counts=True)
    doc, bin_ = key // BINS, key % BINS
    log = logs[:, bin_]
    log -= log.max(axis=0)
    m = Mixture(np.exp(log), n, doc)
    k = len(logs)
    free = m.fitted(np.full((k, len(grams)), 1.0 / k))
    rank = np.argsort(np.argsort(-free, axis=0, kind="stable"), axis=0, kind="stable")
    # one language: no mixture to fit, and all are tried
    alone = np.add.reduceat(n * log, m.first, axis=1)
    chosen = np.zeros_like(free)
    chosen[alone.argmax(axis=0), np.arange(len(grams))] = 1.0
    value = alone.max(axis=0)
    rising = np.ones(len(grams), bool)
    for size in range(2, k + 1):
        some = m.of(rising)
        start = np.where(rank[:, rising] < size, np.maximum(free[:, rising], 1e-3), 0.0)
        p = some.fitted(start / start.sum(axis=0))
        fit = some.gain(p) - PENALTY * (size - 1) * np.log(np.maximum(some.total / 3, 2))
        at = np.flatnonzero(rising)
        better = fit > value[at]
        at = at[better]
        chosen[:, at], value[at] = p[:, better], fit[better]
        rising = np.isin(np.arange(len(grams)), at)
        if not len(at):
            break
    return free, chosen


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", name: str = "language") -> DataFrame:
    """Every row of ``docs`` with a struct ``lang_pred, score, proportions``.

    lang_pred is the language with the largest proportion in the chosen set, score that proportion; ``proportions`` maps the
    chosen languages to theirs.  Null texts, and texts without a letter, are ``und`` with score 0 and no proportions, as all
    are if nothing was learned.  Ties go to the first language by name; repeated rows are alike; a very long text is looked at
    whole, by itself if need be; an empty table gives an empty table; a column of that name is replaced, and there are no other
    working columns.  The model holds BINS numbers for each language.
    """
    bounded_batches(docs.sparkSession)
    names, logs = model
    sent = docs.sparkSession.sparkContext.broadcast(logs)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("proportions", pa.map_(pa.string(), pa.float64()))])

    @F.arrow_udf("struct<lang_pred:string,score:double,proportions:map<string,double>>")
    def identify(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = sent.value
        for texts in it:
            out: list[dict] = []
            for part in batches((trigrams(t or "") if names else np.zeros(0, np.int64) for t in texts.to_pylist()), CHUNK // max(len(names), 1), len):
                some = [g for g in part if len(g)]
                chosen = iter(mixtures(some, table)[1].T if some else ())
                for g in part:
                    if not len(g):
                        out.append({"lang_pred": "und", "score": 0.0, "proportions": []})
                        continue
                    p = next(chosen)
                    k = int(p.argmax())
                    out.append({"lang_pred": names[k], "score": float(min(p[k], 1.0)), "proportions": [(names[j], float(p[j])) for j in np.flatnonzero(p > 0)]})
            yield pa.array(out, kind)

    return docs.withColumn(name, identify(F.col(text)))


def learned_from(docs: DataFrame) -> DataFrame:
    """The rows outside the held-out fold."""
    return docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)


def op9_language(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = learn(learned_from(docs))
    found = identified(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.col("language.lang_pred").alias("lang_pred"), F.col("language.score").alias("score"))
