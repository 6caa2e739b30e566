"""Helpers shared by the training-data operators.

Words are maximal runs of anything but ASCII white space (``[^\\x20\\x09-\\x0D]+``).  ``bytes.split()`` cuts at exactly these
six characters, so the Python side works on UTF-8 bytes and never decodes a text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.files import shared_dir
from quillon.sources.tables import spread

#: White space between words, for Spark's and DuckDB's regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows and bytes that one Arrow batch may hold, so that a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of Python tasks small, whatever the length of the texts.

    This sets two limits of the session, which stay set: every operator with Python tasks here relies on them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, and no step runs twice.

    The files go when the application's file system client closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents; one small file is spread over all cores, as its partitions would else be too few."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def words(text: Column) -> Column:
    """Array of the words of ``text``; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def fold(doc_id: Column, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; a null id counts as fold 0 and so is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def text_key(text: Column) -> Column:
    """64-bit hash of a text, 0 for null; with the id it names a row, and rows that share both are the same to an operator."""
    return F.coalesce(F.xxhash64(text), F.lit(0))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, so that extra input columns can't clash with working columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def as_bytes(texts) -> list[bytes]:
    """UTF-8 bytes of an Arrow string array, null as empty."""
    import pyarrow as pa

    return [b if b is not None else b"" for b in texts.cast(pa.binary()).to_pylist()]


def small(df: DataFrame, limit: int) -> bool:
    """True if ``df`` has at most ``limit`` rows; reads no more than that many and one."""
    return df.limit(limit + 1).count() <= limit


#: Bytes that are broadcast at most.
BROADCAST_BYTES = 32 << 20


def sized(df: DataFrame, limit: int, otherwise: str = "merge", most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with the join strategy for its measured size: broadcast up to ``limit`` rows and ``most`` bytes, a sort-merge join beyond.

    Bytes are those of the rows as JSON, more than they take in memory unless most are null.  Spark can split the hot keys of a
    sort-merge join at run time.
    """
    light = small(df, limit) and (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= most
    return F.broadcast(df) if light else df.hint(otherwise)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Combine two arrays of 64-bit hashes, in order."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def word_hashes(ws: list[bytes]) -> np.ndarray:
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, ws)), ">u8").astype(np.uint64)


def wide_word_hashes(ws: list[bytes]) -> np.ndarray:
    """Two 64-bit hashes of each word, halves of one of 128 bits."""
    import xxhash

    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, ws)), ">u8").astype(np.uint64).reshape(-1, 2)


def blocks_for(df: DataFrame, text: str, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` of text hold ``df``; it grows with the input."""
    total = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return int(total // block_bytes) + 1


def partitions_for(spark: SparkSession, groups: int, each: int) -> int:
    """Partitions for ``groups`` groups of bounded size, ``each`` to a partition: as many as the session sets at least, more as the input grows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups // each))


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of ``edges(u bigint, v bigint)`` as ``(node, component)``, component = smallest node.

    Every round lets each node point to its smallest neighbour, shortens the pointers by one jump, then contracts the
    graph; the edges left are written out, so that a lost executor costs one round at most. Only a count per round
    reaches the driver. Nodes without an edge to another node are not returned.
    """
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    live = staged(edges.where(F.col("u") != F.col("v")).select("u", "v"), "edges")
    known = None
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        up = both(live).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p"))
        jump = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
        up = staged(up.join(jump.hint("merge"), "p", "left").select("u", F.coalesce("q", "p").alias("p")), "up")
        if known is None:
            known = up.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            moved = up.select(F.col("u").alias("component"), F.col("p").alias("new"))
            known = known.join(moved.hint("merge"), "component", "left").select("node", F.coalesce("new", "component").alias("component"))
        known = staged(known, "known")
        a = up.select("u", F.col("p").alias("a"))
        b = up.select(F.col("u").alias("v"), F.col("p").alias("b"))
        live = live.join(a.hint("merge"), "u").join(b.hint("merge"), "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        live = staged(live, "edges")
    else:
        raise RuntimeError("components did not settle")
    if known is None:
        return edges.sparkSession.createDataFrame([], "node bigint, component bigint")
    return known


def batches(it: Iterator, limit: int, size) -> Iterator[list]:
    """Lists of consecutive items whose sizes sum to about ``limit``."""
    held, total = [], 0
    for x in it:
        held.append(x)
        total += size(x)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; the package is installed on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)

