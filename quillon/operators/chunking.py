"""Paragraphs to chunks: an ordered fold over the paragraphs of each section.

The fold adds up words until a group is full.  What a paragraph does depends on what came before it only through the running sum, which
is less than ``full``: so a block of paragraphs is a table from the sum at its start to the sum at its end and the groups that it
closes.  A section of many blocks is folded block by block in three steps: the tables, side by side; their composition in order, which
reads a table for each block; and the blocks themselves from their starts, side by side again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.ranks import fresh, ranked
from quillon.sources import files

FULL, OVERSIZE, TRAILING = 500, 750, 80
#: Paragraph numbers in a block.
BLOCK = 4096
KEYS = ["work_id", "section", "block"]


def walked(words, total: int, group: int, full: int, oversize: int) -> list[int]:
    """Group numbers of paragraphs in order, from a running sum and a group: whole paragraphs until the sum reaches ``full``; larger ones alone."""
    out = []
    for n in words:
        big = n > oversize
        group += big and total > 0
        out.append(int(group))
        total += n
        if big or total >= full:
            group, total = group + 1, 0
    return out


def ends(words, full: int, oversize: int) -> tuple[np.ndarray, np.ndarray]:
    """For each running sum below ``full`` at the start of a block: that at its end, and the groups closed."""
    total, closed = np.arange(full), np.zeros(full, np.int64)
    for n in words:
        if n > oversize:
            closed, total = closed + (total > 0) + 1, np.zeros(full, np.int64)
        else:
            total = total + n
            done = total >= full
            closed, total = closed + done, np.where(done, 0, total)
    return total, closed


def starts(blocks: DataFrame, full: int, oversize: int) -> DataFrame:
    """``work_id, section, block, total, group`` at the start of each block of the sections that have several."""
    @F.pandas_udf("struct<total:array<int>,closed:array<int>>")
    def table(words: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([[x.astype(np.int32) for x in ends(ws, full, oversize)] for ws in words], columns=["total", "closed"])

    several = blocks.groupBy("work_id", "section").agg(F.max("block").alias("last"), F.count("*").alias("n")).where("n > 1")
    held = blocks.join(files.staged(several.select("work_id", "section"), "several").hint("merge"), ["work_id", "section"])
    held = files.staged(held.select(*KEYS, table("words").alias("t")), "tables")
    kinds = {f.name: f.dataType.simpleString() for f in held.schema if f.name in KEYS}

    def carried(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        section, total, group = None, 0, 0
        for pdf in it:
            out = []
            for r in pdf.itertuples():
                if (r.work_id, r.section) != section:
                    section, total, group = (r.work_id, r.section), 0, 0
                out.append((r.work_id, r.section, r.block, total, group))
                group, total = group + int(r.t["closed"][total]), int(r.t["total"][total])
            yield pd.DataFrame(out, columns=[*KEYS, "total", "group"])

    in_order = held.repartition("work_id", "section").sortWithinPartitions(*KEYS)
    return in_order.mapInPandas(carried, ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", total bigint, group bigint")


def grouped(paras: DataFrame, full: int = FULL, oversize: int = OVERSIZE, trailing: int = TRAILING, merge: bool = True, block: int = BLOCK) -> DataFrame:
    """``paras(work_id, section, index, words, ...)`` with the group ``g`` of each; a short last group joins the one before.

    ``block`` paragraph numbers at most meet in a row, whatever the length of a section.  Numbers are unique within a section.
    """
    @F.pandas_udf("array<int>")
    def fold(words: pd.Series, total: pd.Series, group: pd.Series) -> pd.Series:
        return pd.Series([walked(ws.tolist(), t, g, full, oversize) for ws, t, g in zip(words, total, group)])

    rows = F.array_sort(F.collect_list(F.struct("index", F.col("words").cast("bigint").alias("words"))))
    blocks = paras.groupBy("work_id", "section", F.floor(F.col("index") / block).alias("block")).agg(rows.alias("rows"))
    blocks = files.staged(blocks.select(*KEYS, F.transform("rows", lambda r: r["index"]).alias("index"), F.transform("rows", lambda r: r["words"]).alias("words")), "blocks")
    begun = blocks.join(starts(blocks, full, oversize).hint("merge"), KEYS, "left")
    g = fold("words", F.coalesce("total", F.lit(0).cast("bigint")), F.coalesce("group", F.lit(0).cast("bigint")))
    g = begun.select("work_id", "section", F.explode(F.arrays_zip("index", "words", g.alias("g"))).alias("o")).select("work_id", "section", "o.index", "o.words", "o.g")
    if merge:
        # numbers alone tell which groups are short, so the paragraphs are joined once
        g = files.staged(g, "groups")
        sizes = g.groupBy("work_id", "section", "g").agg(F.sum("words").alias("size"))
        last = sizes.groupBy("work_id", "section").agg(F.max("g").alias("last"), F.max_by("size", "g").alias("last_size"))
        small = (F.col("g") == F.col("last")) & (F.col("last") > 0) & (F.col("last_size") < trailing)
        g = g.join(last.hint("merge"), ["work_id", "section"]).withColumn("g", F.when(small, F.col("g") - 1).otherwise(F.col("g")))
    return paras.join(g.select("work_id", "section", "index", "g").hint("merge"), ["work_id", "section", "index"])


def built(members: DataFrame) -> DataFrame:
    """``work_id, section, g, paragraph_ids, text, word_count`` of each group."""
    rows = F.array_sort(F.collect_list(F.struct("index", "paragraph_id", "text")))
    c = members.groupBy("work_id", "section", "g").agg(rows.alias("rows"), F.sum("words").alias("word_count"))
    return c.select("work_id", "section", "g", F.transform("rows", lambda r: r["paragraph_id"]).alias("paragraph_ids"), F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n").alias("text"), "word_count")


def renumbered(chunks: DataFrame) -> DataFrame:
    """Chunk ids that count through a work in the order of its sections; a work may hold any share of all chunks."""
    number = fresh(chunks, "number")
    rows = ranked(chunks, ["section", "g"], "work_id", number)
    return rows.withColumn("chunk_id", F.concat(F.col("work_id").cast("string"), F.lit("_c"), F.col(number).cast("string"))).drop(number)
