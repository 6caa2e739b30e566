"""Proportional stratified interleaving into shards.

Rows are ranked within their source in a seeded order; row ``r`` of a source of ``n`` rows gets the fraction ``(r - 1/2) / n``;
all rows are sorted by that fraction and cut into shards of equal row counts, so every shard holds each source in proportion.
Both rankings are range-partitioned sorts with a running number in each partition and an offset for each partition: a source
with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, documents, fresh, sized, staged

SHARDS = 24
SEED = 17
#: Sources whose sizes are broadcast; more are joined by sort-merge.
BROADCAST_SOURCES = 100_000


def ranked(df: DataFrame, order: list[str], within: str | None = None, name: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank of each row in ``order``, for each value of ``within`` or over all; that column comes first in the order."""
    spark = df.sparkSession
    bounded_batches(spark)
    keys = ([within] if within else []) + order
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    pid, run = fresh(df, "part_no"), fresh(df, "run_no")
    schema = T.StructType([*df.schema.fields, T.StructField(pid, T.IntegerType()), T.StructField(run, T.LongType())])

    def number(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me, value, at = TaskContext.get().partitionId(), object(), 0
        for b in it:
            n, runs = b.num_rows, []
            if within:
                for v in b.column(within).to_pylist():
                    at = at + 1 if v == value else 1
                    value = v
                    runs.append(at)
            else:
                runs, at = range(at + 1, at + n + 1), at + n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([me] * n, pa.int32()), pa.array(runs, pa.int64())], names=[*b.schema.names, pid, run])

    dealt = df.repartitionByRange(parts, *[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    dealt = staged(dealt.mapInArrow(number, schema), "ranked")
    # a row for each partition and value in it: their number is bounded by partitions plus values
    by = [pid] + ([within] if within else [])
    seen = dealt.groupBy(*by).agg(F.max(run).alias("n"))
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    if within:
        before = Window.partitionBy(within).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = seen.select(F.col(pid).alias("of_part"), *([F.col(within).alias("of_value")] if within else []), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset_no"))
    match = dealt[pid] == offsets["of_part"]
    if within:
        match = match & dealt[within].eqNullSafe(offsets["of_value"])
    return dealt.join(offsets.hint("merge") if within else F.broadcast(offsets), match).select(*df.columns, (F.col(run) + F.col("offset_no")).alias(name))


def interleaved(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``doc_id, source, size, text_crc32, shard, slot`` for each row of ``docs``; shard sizes in rows differ by one at most.

    The seeded order is the MD5 of seed and id, then the id, then the text's checksum and size.  Rows without source form a
    source of their own; null ids sort first; null texts count as empty; rows that are alike in all of this take neighbouring
    slots in any order.  Of a very long text only size and checksum go on.  An empty table gives an empty table.  Extra columns
    aren't read, so they can't clash.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    seeded = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("seeded")
    rows = staged(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("stratum"), (F.octet_length(body) + 8).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), seeded), "rows")
    total = rows.count()
    order = ["seeded", "doc_id", "text_crc32", "size"]
    inside = ranked(rows, order, "stratum")
    # written out, so that the join below doesn't share a stage with the sums and Spark can split a large source
    sizes = staged(rows.groupBy("stratum").agg(F.count("*").alias("n")).withColumnRenamed("stratum", "of_stratum"), "sizes")
    placed = inside.join(sized(sizes, BROADCAST_SOURCES), inside["stratum"] == sizes["of_stratum"]).withColumn("fraction", (F.col("rank") - 0.5) / F.col("n"))
    placed = placed.select("doc_id", "stratum", "size", "text_crc32", "fraction", "seeded")
    everywhere = ranked(placed, ["fraction", "stratum", *order], None, "place")
    at = F.col("place") - 1
    shard = F.expr(f"((place - 1) * {shards}) div {max(total, 1)}")
    # in integers, so exact: the first place of shard s is s * total / shards, rounded up
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    real = F.when(F.col("stratum") != "", F.expr("substring(stratum, 2)"))
    return everywhere.withColumn("shard", shard).withColumn("slot", at - first).select("doc_id", real.alias("source"), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"))


def op6_sharding(spark, sf_dir):
    out = interleaved(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
