"""Removal of repeated passages by level-wise doubling.

A passage of ``length`` words that occurs twice holds repeated windows of about a quarter and a half of its length.  Windows of
the quarter length are looked at first, those repeated are extended to twice that length on both sides, and what is repeated
there is extended once more, to ``length`` itself; a level without a repeated window ends the search.  The first level is
thinned without loss: of every ``length`` words only the windows whose hash is smallest among them are looked at, and two
equal passages choose alike.

Documents are dealt into blocks of bounded size by a hash of the row.  A block sends each level's window hashes, each once, in
packed form to the buckets that count them, and gets back those that start more than once anywhere.  The levels before the last
only narrow the search and go by 64 bits; windows of the full length are equal if 128 bits of hash are, words hashed to as many.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks_for, bounded_batches, documents, fresh, mix, partitions_for, text_key, wide_word_hashes

LENGTH = 35
BLOCK_BYTES = 2 << 20


def level_lengths(length: int) -> list[int]:
    """Window lengths of the levels: each at most twice the one before, the last is ``length``."""
    first = -(-length // 4)
    return sorted({first, min(2 * first, length), length})


def sliding(a: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """``best`` of every ``width`` consecutive values, by doubling."""
    if len(a) < width:
        return a[:0]
    step = 1
    while 2 * step <= width:
        a = best(a[:-step], a[step:])
        step *= 2
    rest = width - step
    return best(a[: len(a) - rest], a[rest:]) if rest else a


class Block:
    """The words of a block's documents in one array, with the hashes of their windows."""

    def __init__(self, texts: list[bytes], length: int):
        self.length, self.levels = length, level_lengths(length)
        self.words = [t.split() for t in texts]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        flat = [h for ws in self.words if ws for h in (wide_word_hashes(ws),)]
        both = np.concatenate(flat) if flat else np.zeros((0, 2), np.uint64)
        self.h, self.other = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
        n = len(self.h)
        ends = np.cumsum(self.sizes)
        self.end = np.repeat(ends, self.sizes)
        self.begin = np.repeat(ends - self.sizes, self.sizes)
        self.left = self.end - np.arange(n)
        self.spans: dict[int, np.ndarray] = {}

    def rolled(self, h: np.ndarray, length: int) -> np.ndarray:
        """Hash of the ``length`` words from each position, 0 where the document ends before."""
        step = 1
        while 2 * step <= length:
            h = mix(h[:-step], h[step:])
            step *= 2
        if rest := length - step:
            h = mix(h[: max(len(h) - rest, 0)], h[rest:])
        full = np.zeros(len(self.h), np.uint64)
        full[: len(h)] = h | np.uint64(1)
        full[self.left < length] = 0
        return full

    def span(self, length: int) -> np.ndarray:
        if length not in self.spans:
            self.spans[length] = self.rolled(self.h, length)
        return self.spans[length]

    def wide(self, at: np.ndarray) -> np.ndarray:
        """Both hashes of the windows of the full length at these positions."""
        return np.column_stack([self.span(self.length)[at], self.rolled(self.other, self.length)[at]])

    def anchors(self) -> np.ndarray:
        """First-level windows with the smallest hash among those of some passage of the full length."""
        first, n = self.levels[0], len(self.h)
        width = self.length - first + 1
        h = self.span(first)
        least = np.zeros(n, np.uint64)
        m = sliding(h, width)
        least[: len(m)] = m
        least[self.left < self.length] = 0
        reach = sliding(np.concatenate([np.zeros(width - 1, np.uint64), least]), width, np.maximum)
        return np.flatnonzero((reach == h) & (h > 0)) if n else np.zeros(0, np.int64)

    def starts(self, level: int, repeated: np.ndarray) -> np.ndarray:
        """Windows to look at on ``level``, from the hashes that the level before found ``repeated``."""
        if level == 0:
            return self.anchors()
        before, now = self.levels[level - 1], self.levels[level]
        at = self.anchors()
        if level == 2:  # the windows of the level before start at an anchor, or end with the anchor's window
            at = np.concatenate([at, at - (before - self.levels[0])])
            at = np.unique(at[at >= 0])
        at = at[np.isin(self.span(before)[at], repeated)] if len(at) else at
        if now < self.length:
            at = np.concatenate([at, at - (now - before)])
            at = np.unique(at[at >= 0])
            return at[self.span(now)[at] > 0]
        edge = np.zeros(len(self.h) + 1, np.int64)
        np.add.at(edge, np.maximum(at - (now - before), self.begin[at]) if len(at) else at, 1)
        np.add.at(edge, at + 1, -1)
        near = np.cumsum(edge[:-1]) > 0
        return np.flatnonzero(near & (self.span(now) > 0))

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """Words that some repeated window of the full length covers."""
        at = np.flatnonzero(np.isin(self.span(self.length), repeated[:, 0])) if len(repeated) else np.zeros(0, np.int64)
        hit = at[among(self.wide(at), repeated)] if len(at) else at
        edge = np.zeros(len(self.h) + 1, np.int64)
        edge[hit] += 1
        np.add.at(edge, hit + self.length, -1)
        return np.cumsum(edge[:-1]) > 0


def numbered(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal rows of an array of one or two columns follow each other, and the number of each one's run in it."""
    order = np.argsort(a, kind="stable") if a.ndim == 1 else np.lexsort((a[:, 1], a[:, 0]))
    a = a[order]
    new = a[1:] != a[:-1] if a.ndim == 1 else (a[1:, 0] != a[:-1, 0]) | (a[1:, 1] != a[:-1, 1])
    return order, np.cumsum(np.append(True, new)[: len(a)]) - 1


def distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, sorted, with how often each occurs."""
    order, run = numbered(a)
    n = np.bincount(run) if len(a) else np.zeros(0, np.int64)
    return a[order[np.cumsum(n) - n]] if len(a) else a, n


def among(a: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` are rows of ``some``."""
    order, run = numbered(np.concatenate([a, some]))
    has = np.zeros(len(order), bool)
    has[run[order >= len(a)]] = True
    out = np.empty(len(order), bool)
    out[order] = has[run]
    return out[: len(a)]


def _blobs(block: int, found: np.ndarray, buckets: int) -> pa.Table:
    """Window hashes of a block, each once, by bucket; those that the block holds twice or more come again in ``twice``."""
    u, n = distinct(found)
    bucket = ((u if u.ndim == 1 else u[:, 0]) >> np.uint64(40)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    u, n, bucket = u[order], n[order], bucket[order].astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket)) + 1
    parts = list(zip(np.split(u, cut), np.split(n, cut), np.split(bucket, cut))) if len(u) else []
    return pa.table(
        {
            "bucket": pa.array([int(b[0]) for _, _, b in parts], pa.int32()),
            "block": pa.array([block] * len(parts), pa.int64()),
            "once": pa.array([h.tobytes() for h, _, _ in parts], pa.binary()),
            "twice": pa.array([h[c > 1].tobytes() for h, c, _ in parts], pa.binary()),
        }
    )


def _hashes(blobs: list[bytes], columns: int) -> np.ndarray:
    a = np.frombuffer(b"".join(blobs), np.uint64)
    return a.reshape(-1, 2) if columns == 2 else a


def _repeated(blobs: pa.Table, columns: int) -> pa.Table:
    """For a bucket: of each block's hashes those that start more than once."""
    once = blobs.column("once").to_pylist()
    own = _hashes(once, columns)
    order, run = numbered(np.concatenate([own, _hashes(blobs.column("twice").to_pylist(), columns)]))
    again = np.empty(len(order), bool)
    again[order] = (np.bincount(run) > 1)[run] if len(run) else False
    ends = np.cumsum([len(b) // (8 * columns) for b in once])
    back = [h[hit].tobytes() for h, hit in zip(np.split(own, ends[:-1]), np.split(again[: len(own)], ends[:-1]))]
    table = pa.table({"block": blobs.column("block"), "hashes": pa.array(back, pa.binary())})
    return table.filter(pa.array([len(b) > 0 for b in back], pa.bool_()))


def without_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_removed`` and ``kept_text``, the words left joined by single spaces.

    A word goes if a window of ``length`` consecutive words of its document covers it whose word sequence also starts
    elsewhere, in the same document or another.  All windows are judged on the input.  A null or empty text has no words; a
    text with fewer words than ``length`` keeps all; a very long text is judged whole, in one block; repeated rows remove each
    other's words, and ties don't arise: of equal passages none stays; an empty table gives an empty table.  Ids may be null.
    Columns with those three names are replaced; the working column takes a name that ``docs`` doesn't have.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    added = ("n_words", "n_removed", "kept_text")
    keep = [c for c in docs.columns if c not in added]
    docs = docs.select(*keep)
    block = fresh(docs, "block")
    n_blocks = blocks_for(docs, text, BLOCK_BYTES)
    buckets = 64 + n_blocks // 128
    # the same exchange feeds all levels and the output
    dealt = docs.withColumn(block, F.pmod(F.xxhash64(F.col(doc_id), text_key(F.col(text))), F.lit(n_blocks))).repartition(partitions_for(spark, n_blocks, 16), block)
    parts = partitions_for(spark, buckets, 1)
    levels = level_lengths(length)
    last = len(levels) - 1
    schema = "bucket int, block bigint, once binary, twice binary"

    def look(rows: pa.Table, level: int, repeated: np.ndarray) -> pa.Table:
        b = Block(as_bytes(rows.column(text)), length)
        at = b.starts(level, repeated)
        return _blobs(rows.column(block)[0].as_py() if rows.num_rows else 0, b.wide(at) if level == last else b.span(levels[level])[at], buckets)

    def first(rows: pa.Table) -> pa.Table:
        return look(rows, 0, np.zeros(0, np.uint64))

    def further(level: int):
        def at(rows: pa.Table, known: pa.Table) -> pa.Table:
            return look(rows, level, _hashes(known.column("hashes").to_pylist(), 1))

        return at

    def repeated_of(columns: int):
        return lambda blobs: _repeated(blobs, columns)

    for level in range(len(levels)):
        blocks = dealt.groupBy(block)
        sent = blocks.cogroup(answers.groupBy("block")).applyInArrow(further(level), schema) if level else blocks.applyInArrow(first, schema)
        answers = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(repeated_of(2 if level == last else 1), "block bigint, hashes binary")

    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_words bigint, n_removed bigint, kept_text string"])

    def cut(rows: pa.Table, known: pa.Table) -> pa.Table:
        b = Block(as_bytes(rows.column(text)), length)
        gone = b.covered(_hashes(known.column("hashes").to_pylist(), 2))
        ends = np.cumsum(b.sizes)
        masks = np.split(gone, ends[:-1]) if len(ends) else []
        kept = [b" ".join(compress(ws, (~m).tolist())) if m.any() else b" ".join(ws) for ws, m in zip(b.words, masks)]
        rows = rows.select(keep)
        rows = rows.append_column("n_words", pa.array(b.sizes, pa.int64()))
        rows = rows.append_column("n_removed", pa.array([int(m.sum()) for m in masks], pa.int64()))
        return rows.append_column("kept_text", pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()))

    return dealt.groupBy(block).cogroup(answers.groupBy("block")).applyInArrow(cut, out_schema)


def op5_substring_dedup(spark, sf_dir):
    out = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), hit AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM starts) WHERE n > 1
), gone AS (
  SELECT r, list(DISTINCT j) AS js FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM hit) GROUP BY r
), kept AS (
  SELECT w.r, array_to_string(list(ws[w.j] ORDER BY w.j), ' ') AS t
  FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS j FROM w) w
  LEFT JOIN (SELECT r, unnest(js) AS j, true AS out FROM gone) g ON g.r = w.r AND g.j = w.j
  WHERE g.out IS NULL GROUP BY w.r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
