"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions alone.

Test items are partitioned by their number of distinct word shingles.  In a partition of items of up to ``u`` shingles an
item's sketch is its ``floor((1 - t) * u) + 1`` smallest shingle hashes: a document that holds a share ``t`` of an item's
shingles misses at most ``floor((1 - t) * u)`` of them, so it holds one of the sketch, however long it is.  Sharing a sketch
hash makes a candidate, and candidates are verified by exact shingle containment on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, fresh, sized, staged, text_key, words

WIDTH = 5
CONTAINMENT = 0.8
#: Sketch or item rows that are broadcast; more are joined by sort-merge.
BROADCAST_ROWS = 200_000


def shingles(ws: Column, width: int = WIDTH) -> Column:
    """Distinct runs of ``width`` words joined by a space; fewer words give one run of them all, none gives none."""
    n = F.size(ws)
    full = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.array_join(F.slice(ws, i, F.lit(width)), " "))
    return F.when(n >= width, F.array_distinct(full)).when(n > 0, F.array(F.array_join(ws, " "))).otherwise(F.array().cast("array<string>"))


def shingle_hashes(ws: Column, width: int = WIDTH) -> Column:
    """64-bit hashes of ``shingles``; the same runs of words have the same hash, repeats included."""
    n = F.size(ws)
    full = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(ws, i, F.lit(width))))
    return F.when(n >= width, full).when(n > 0, F.array(F.xxhash64(ws))).otherwise(F.array().cast("array<bigint>"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """``doc_id, text_hash, item_id, n_item, n_shared, containment`` for each document and item with containment >= ``threshold``.

    Containment is the share of the item's distinct shingles that the document holds; words are lower-cased in A-Z, and an
    item of fewer than ``width`` words is one shingle of them all, which only a text of just these words holds.  Null and
    empty texts and items hold nothing and match nothing.  Rows that repeat in id and text, or items that do, give one row; items
    of one id and several texts are judged text by text; null ids are ids like others.  Ties don't arise.  A very long text is
    one row for each of its shingles, hashes at first and the shingles that items have if it is a candidate.  Empty tables give an
    empty table.  Extra columns aren't read, so they can't clash.
    """
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    item = items.select(F.col(item_id).alias("item_id"), words(lower(F.col(item_text))).alias("ws")).where(F.size("ws") > 0).distinct()
    item = item.select("item_id", shingles(F.col("ws"), width).alias("item_shingles"), F.array_distinct(shingle_hashes(F.col("ws"), width)).alias("hashes"))
    # partition k holds the items of 2^(k-1) < n <= 2^k shingles; u = 2^k bounds them
    bound = F.pow(F.lit(2), F.ceil(F.log2(F.size("hashes")))).cast("int")
    allowed = F.floor(F.lit(1 - threshold + 1e-9) * bound).cast("int") + 1
    sketch = item.select("item_id", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), allowed)).alias("hash"))

    doc = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_key(F.col(text)).alias("text_hash"))
    # the words are a column of their own, so that no expression splits a text again for each of its shingles
    found = doc.select("doc_id", "text_hash", words(lower(F.col("text"))).alias("ws")).select("doc_id", "text_hash", F.explode(shingle_hashes(F.col("ws"), width)).alias("hash"))
    # written out: a count decides whether they go to the texts, which then aren't shuffled, or the texts to them
    candidates = staged(found.join(sized(sketch, BROADCAST_ROWS), "hash").select("doc_id", "text_hash", "item_id").distinct(), "candidates")
    c = candidates.select(F.col("doc_id").alias("c_doc"), F.col("text_hash").alias("c_hash"), F.col("item_id").alias("c_item"))
    # a document's shingles are made once, whatever the number of its candidates, and go on as one narrow row each; only those
    # that an item of some candidate has stay, so a document with many candidates isn't held or built many times over
    some = c.select("c_doc", "c_hash").distinct()
    whole = doc.join(sized(some, BROADCAST_ROWS), doc["doc_id"].eqNullSafe(F.col("c_doc")) & (doc["text_hash"] == F.col("c_hash"))).select("doc_id", "text_hash", words(lower(F.col("text"))).alias("ws"))
    full = staged(item.select("item_id", F.xxhash64(F.array_sort("hashes"), F.size("item_shingles")).alias("item_hash"), F.size("item_shingles").alias("n_item"), F.explode("item_shingles").alias("shingle")).distinct(), "item_shingles")
    whole = staged(whole.select("doc_id", "text_hash", F.explode(shingles(F.col("ws"), width)).alias("shingle")).join(sized(full.select("shingle").distinct(), BROADCAST_ROWS), "shingle", "left_semi").distinct(), "doc_shingles")
    met = c.join(sized(full, BROADCAST_ROWS), F.col("c_item").eqNullSafe(full["item_id"]))
    met = met.select("c_doc", "c_hash", F.col("item_id"), "item_hash", "n_item", F.col("shingle").alias("c_shingle"))
    both = met.join(whole.hint("merge"), F.col("c_doc").eqNullSafe(whole["doc_id"]) & (F.col("c_hash") == whole["text_hash"]) & (F.col("c_shingle") == whole["shingle"]))
    out = both.groupBy("doc_id", "text_hash", "item_id", "item_hash", F.col("n_item").cast("bigint").alias("n_item")).agg(F.count("*").alias("n_shared"))
    out = out.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9)
    return out.drop("item_hash").distinct()


def clean(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that hold no item at ``threshold``; all their columns, repeats and rows without text included.

    Null and empty texts stay; repeated rows stay or go together; an empty table gives an empty table; working columns take
    names that ``docs`` doesn't have.
    """
    of_doc, of_hash, key = (fresh(docs, c) for c in ("bad_doc", "bad_hash", "text_key"))
    found = contained_items(docs, items, threshold, width, text, doc_id)
    bad = staged(found.select(F.col("doc_id").alias(of_doc), F.col("text_hash").alias(of_hash)).distinct(), "contaminated")
    keyed = docs.withColumn(key, text_key(F.col(text)))
    return keyed.join(sized(bad, BROADCAST_ROWS), F.col(doc_id).eqNullSafe(F.col(of_doc)) & (F.col(key) == F.col(of_hash)), "left_anti").select(*docs.columns)


def op8_decontamination(spark, sf_dir):
    found = contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_item", "n_shared", "containment")


OP8_SQL = r"""
WITH d AS (
  SELECT DISTINCT doc_id, text FROM documents
), dw AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM d
), iw AS (
  SELECT row_number() OVER () AS q, item_id, ws FROM (SELECT DISTINCT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark)
), ds AS (
  SELECT DISTINCT r, doc_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i:i + 4], ' ') ELSE array_to_string(ws, ' ') END AS s
  FROM (SELECT r, doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM dw WHERE len(ws) > 0)
), its AS (
  SELECT DISTINCT q, item_id, CASE WHEN len(ws) >= 5 THEN array_to_string(ws[i:i + 4], ' ') ELSE array_to_string(ws, ' ') END AS s
  FROM (SELECT q, item_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM iw WHERE len(ws) > 0)
), n AS (
  SELECT q, count(*) AS n_item FROM its GROUP BY q
), hits AS (
  SELECT DISTINCT r, doc_id, item_id, n_item, n_shared FROM (
    SELECT r, doc_id, q, item_id, n_item, count(*) AS n_shared FROM ds JOIN its USING (s) JOIN n USING (q)
    GROUP BY r, doc_id, q, item_id, n_item HAVING count(*) >= 0.8 * n_item)
)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM hits
"""
