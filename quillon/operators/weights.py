"""Inverted-index weights: term frequencies, BM25 weights, inverse document frequencies, hashed dense vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import stemming as N
from quillon.sources import files


def repeated(rows: DataFrame, key: str) -> bool:
    return not rows.groupBy(key).count().where("count > 1").isEmpty()


def counted_terms(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``key, size, terms``: the number of tokens of each chunk that has one, and its distinct stems, ``array<struct<term, tf>>``.

    A chunk's words are stemmed and counted in its task, so that no posting is shuffled.  Only chunks that come in several rows, if there
    are any, are put together.
    """
    lists = files.staged(N.term_lists(chunks, text, key), "counts")
    sizes = lists.select(key, "size")
    if repeated(sizes, key):
        sizes = files.staged(sizes.groupBy(key).agg(F.sum("size").alias("size")), "sizes")
        counts = lists.select(key, F.inline("terms")).groupBy(key, "term").agg(F.sum("tf").alias("tf"))
        # a null key is no chunk, but its tokens count in the mean
        lists = counts.groupBy(key).agg(F.collect_list(F.struct("term", "tf")).alias("terms")).join(sizes.withColumnRenamed(key, "of").hint("merge"), F.col(key).eqNullSafe(F.col("of"))).select(key, "size", "terms")
    return lists


def mean_size(lists: DataFrame) -> float:
    return lists.agg(F.avg("size")).first()[0] or 1.0


def length_part(size, mean: float, k: float = 1.2, b: float = 0.75):
    """What a chunk's size adds to the divisor of its weights."""
    return k * (1 - b + b * size / mean)


def weight(tf, part, k: float = 1.2):
    """Saturated term frequency, by ``length_part``."""
    return tf * (k + 1) / (tf + part)


def weight_of(tf, size, mean: float, k: float = 1.2, b: float = 0.75):
    """Saturated term frequency with length normalisation, of columns or of arrays."""
    return weight(tf, length_part(size, mean, k, b), k)


def postings_of(lists: DataFrame, mean: float, k: float = 1.2, b: float = 0.75, key: str = "chunk_id") -> DataFrame:
    """``key, term, weight``: a row for each term of ``counted_terms``."""
    rows = lists.where(F.col(key).isNotNull()).select(key, "size", F.inline("terms"))
    return rows.select(key, "term", weight_of(F.col("tf"), F.col("size"), mean, k, b).alias("weight"))


def postings(chunks: DataFrame, k: float = 1.2, b: float = 0.75, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """``key, term, weight``: a row for each distinct stem of a chunk."""
    lists = counted_terms(chunks, key, text)
    return postings_of(lists, mean_size(lists), k, b, key)


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "text") -> DataFrame:
    """``key, term``: distinct stems of each query, each of weight one."""
    return N.term_lists(queries, text, key).select(key, F.inline("terms")).select(key, "term").distinct().withColumn("weight", F.lit(1.0))


def term_idf(posts: DataFrame, n_chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``term, df, idf`` with idf = ln(1 + (N - df + 0.5) / (df + 0.5)); ``n_chunks`` has one row with ``n``."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.crossJoin(F.broadcast(n_chunks)).select("term", "df", idf.alias("idf"))


def bucket_of(token: str, dim: int) -> int:
    """Hash bucket of a token: the first eight digits of its MD5, modulo ``dim``."""
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim


def vectors(rows: DataFrame, key: str, text: str = "text", dim: int = 64) -> DataFrame:
    """``key, vector``: unit-length vectors of hashed term frequencies, for the rows that have a token.

    Each distinct word of a task is hashed once, and the tokens of a row are counted where they are.
    """
    N.bounded_batches(rows.sparkSession)

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = N.Remembered(lambda w: bucket_of(w, dim))
        for batch in it:
            keys, sizes, buckets, row, word = N.listed(batch, of)
            tf = np.bincount(row * dim + np.array(buckets, np.int64)[word], minlength=len(sizes) * dim).astype(np.float64)
            yield pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * dim), pa.array(tf))], names=[key, "tf"])

    counts = files.staged(N.texts(rows, key, text).mapInArrow(counted, f"{key} {rows.schema[key].dataType.simpleString()}, tf array<double>"), "counts")
    if repeated(counts, key):
        counts = counts.groupBy(key).agg(F.array(*[F.sum(F.col("tf")[k]) for k in range(dim)]).alias("tf"))
    norm = F.sqrt(F.aggregate("tf", F.lit(0.0), lambda s, x: s + x * x))
    return counts.withColumn("norm", norm).select(key, F.transform("tf", lambda x: x / F.col("norm")).alias("vector"))


def packed(rows: DataFrame, text: str = "text", dim: int = 64) -> DataFrame:
    """``rows`` with ``size, words, counts, tf, norm`` in place of the text: the number of tokens, distinct stems in order, how often each
    occurs, hashed term frequencies and their length.

    What ``counted_terms`` and ``vectors`` give of a row, from one reading of its text, in a few bytes for each stem; nothing is moved.
    """
    N.bounded_batches(rows.sparkSession)
    rest = [c for c in rows.columns if c != text]
    whole = rows.select(F.struct(*rest).alias("row_of"), text)

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = N.Remembered(lambda w: (N.stem_of(w), bucket_of(w, dim)))
        for batch in it:
            sizes, found, row, word = N.placed(batch, of)
            stems = pa.array([x[0] for x in found], pa.string()).dictionary_encode()
            names = pc.sort_indices(stems.dictionary).to_numpy()
            at = np.empty(len(names), np.int64)
            at[names] = np.arange(len(names))
            held, counts = np.unique(row << 32 | at[stems.indices.to_numpy(zero_copy_only=False)][word], return_counts=True)
            ends = np.append(0, np.cumsum(np.bincount(held >> 32, minlength=len(sizes)))).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(ends), stems.dictionary.take(pa.array(names[held & 0xFFFFFFFF])))
            tf = np.bincount(row * dim + np.array([x[1] for x in found], np.int64)[word], minlength=len(sizes) * dim)
            norm = np.sqrt((tf.reshape(-1, dim).astype(np.float64) ** 2).sum(axis=1))
            lists = [pa.ListArray.from_arrays(pa.array(e), pa.array(x.astype(np.int32))) for e, x in ((ends, counts), (np.arange(len(sizes) + 1, dtype=np.int32) * dim, tf))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), words, *lists, pa.array(norm)], names=["row_of", "size", "words", "counts", "tf", "norm"])

    kind = whole.schema["row_of"].dataType.simpleString()
    out = N.texts(whole, "row_of", text).mapInArrow(counted, f"row_of {kind}, size bigint, words array<string>, counts array<int>, tf array<int>, norm double")
    return out.select("row_of.*", "size", "words", "counts", "tf", "norm")


def hashed_vectors(rows: DataFrame, key: str, text: str = "text", dim: int = 64) -> DataFrame:
    """``key, dim, value``: the non-zero entries of ``vectors``."""
    return vectors(rows, key, text, dim).select(key, F.posexplode("vector").alias("dim", "value")).where("value <> 0")


def ensure_index(spark, path: str, schema: str) -> DataFrame:
    """The index table at ``path``, created empty if there is none; the metric and idf are chosen by each query."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)
