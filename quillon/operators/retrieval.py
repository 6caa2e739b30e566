"""Batch retrieval: dense and sparse top-k, rank fusion and reranking for whole tables of queries.

Every ranking is by score rounded to nine decimals, descending, then by chunk id: a total order, so that runs agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import weights as W
from quillon.operators.ranks import SMALL, checked, small
from quillon.sources import files

RRF_K = 1
PREFETCH = 50
POOL = 15
#: Blocks of postings for each unit of weight, and postings, as a multiple of the hits asked for, from which a query's floor comes.
BLOCKS, SEEDS = 8, 64
#: Units of a BM25 score.
UNITS = 1e12
#: Rows of queries, and of vectors, that meet in one block; cells at most, and what a distance may be off.
QUERY_BLOCK, VECTOR_BLOCK, CELLS, MARGIN = 1024, 4096, 1024, 1e-4
#: Queries that are held beside a pass over the whole corpus at most, and pairs of a posting and a query that are worked on at once.
PASS_QUERIES, PAIRS = 4096, 1 << 20
#: Rows and bytes of an Arrow batch, and rows that a Python task holds beside it.
BATCH_ROWS, BATCH_BYTES, SLICE = 1000, 16 << 20, 1000


def top(hits: DataFrame, limit: int, score: str = "score", by: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """``hits`` with 1-based ``rank``, cut at ``limit`` for each query; Spark cuts before the shuffle too."""
    w = Window.partitionBy(by).orderBy(F.round(F.col(score), 9).desc(), F.col(key))
    return hits.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= limit)


def summed() -> Column:
    """The score of a group of ``weight`` and ``gain``: its parts are whole units before they are added, so that equal parts give equal scores in any order."""
    return F.sum(F.floor(F.col("weight") * F.col("gain") * UNITS + 0.5)) / UNITS


class Best:
    """The best ``limit`` hits of each of a bounded number of queries as a task passes over its chunks."""

    def __init__(self, limit: int):
        self.limit, self.rows, self.floor = limit, None, None

    def add(self, query: np.ndarray, ids: pa.Array, order: np.ndarray, score: np.ndarray) -> None:
        """Hits as parallel columns: the query's number, the chunk, what ranks it (higher first, equal ones by chunk), and its score."""
        new = pa.table({"query": pa.array(query, pa.int64()), "id": ids, "order": pa.array(order), "score": pa.array(score)})
        rows = pa.concat_tables([self.rows, new]) if self.rows is not None else new
        rows = rows.take(pc.sort_indices(rows, [("query", "ascending"), ("order", "descending"), ("id", "ascending")]))
        of = rows.column("query").to_numpy()
        start = np.flatnonzero(np.diff(of, prepend=-1))
        self.rows = rows.filter(pa.array(np.arange(len(of)) - np.repeat(start, np.diff(start, append=len(of))) < self.limit)).combine_chunks()

    def floors(self, n: int, none: float) -> np.ndarray:
        """For each of ``n`` queries what a hit's order must not be below; ``none`` while there are fewer than ``limit``."""
        out = np.full(n, none)
        if self.rows is not None:
            of, order = self.rows.column("query").to_numpy(), self.rows.column("order").to_numpy()
            full = np.flatnonzero(np.bincount(of, minlength=n) >= self.limit)
            out[full] = order[np.searchsorted(of, full, "right") - 1]
        return out

    def batches(self, queries: pa.Array) -> Iterator[pa.RecordBatch]:
        for b in self.rows.to_batches(BATCH_ROWS) if self.rows is not None else ():
            yield pa.RecordBatch.from_arrays([queries.take(b.column("query")), b.column("id"), b.column("score")], names=["query_id", "chunk_id", "score"])


def passed_terms(wanted: DataFrame, lists: DataFrame, mean: float, limit: int) -> DataFrame:
    """``query_id, chunk_id, score``: the best ``limit`` by BM25 of each task's part of ``lists(chunk_id, size, terms)`` of that mean size, in one pass over it.

    ``wanted(query_id, term, gain)`` is small and goes to all tasks.  Scores are counted in whole units, so sums are exact in any order.
    """
    lists.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    lists.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = wanted.select("query_id", "term", "gain").toArrow().combine_chunks().sort_by("term")
    ids = pc.unique(rows.column("query_id"))
    of = pc.index_in(rows.column("query_id"), ids).to_numpy()
    coded = pc.run_end_encode(rows.column("term").combine_chunks()) if len(rows) else None
    terms = coded.values if len(rows) else pa.array([], pa.string())
    ends = coded.run_ends.to_numpy() if len(rows) else np.zeros(0, np.int64)
    shared = lists.sparkSession.sparkContext.broadcast((ids, terms, np.append(0, ends).astype(np.int64), of, rows.column("gain").to_numpy()))

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, start, of, gain = shared.value
        best, n = Best(limit), len(ids)
        for batch in it:
            parts = batch.column("terms")
            held = parts.flatten()
            term = pc.index_in(held.field("term"), value_set=terms)
            asked = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
            term, tf = term.fill_null(0).to_numpy(zero_copy_only=False)[asked], held.field("tf").to_numpy(zero_copy_only=False)[asked]
            row = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))[asked]
            weight = W.weight_of(tf, batch.column("size").to_numpy(zero_copy_only=False)[row], mean)
            many = start[term + 1] - start[term]
            # rows in slices of a bounded number of pairs, or one row
            upto = np.cumsum(np.bincount(row, many, len(parts)))
            first = 0
            while first < len(parts):
                before = upto[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(upto, before + PAIRS, "right")))
                last = min(last, first + max(1, PAIRS // max(n, 1)))
                a, b = np.searchsorted(row, (first, last))
                m = many[a:b]
                pair = np.repeat(start[term[a:b]] - np.cumsum(m) + m, m) + np.arange(m.sum())
                key = np.repeat(row[a:b] - first, m) * n + of[pair]
                units = np.bincount(key, np.floor(np.repeat(weight[a:b], m) * gain[pair] * UNITS + 0.5), (last - first) * n)
                met = np.zeros((last - first) * n, bool)
                met[key] = True
                order = np.floor((units + 500) / 1000)  # nine decimals
                good = np.flatnonzero(met & (order >= np.tile(best.floors(n, -1.0), last - first)))
                if len(good):
                    best.add(good % n, batch.column("chunk_id").take(pa.array(first + good // n)), order[good], units[good] / UNITS)
                first = last
        yield from best.batches(ids)

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((wanted, "query_id"), (lists, "chunk_id"))]
    return lists.where("chunk_id is not null").select("chunk_id", "size", "terms").mapInArrow(scored, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")


def passed_vectors(asked: DataFrame, vectors: DataFrame, limit: int) -> DataFrame:
    """``query_id, chunk_id, score``: the best ``limit`` by cosine of each task's part of ``vectors(id, v)``, in one pass over it.

    ``asked(id, v)`` is small and goes to all tasks; vectors of both are of length one or zeros.
    """
    rows = asked.select("id", "v").toArrow()
    ids, by_length = rows.column("id").combine_chunks(), {}
    for k, v in enumerate(rows.column("v").to_pylist()):
        by_length.setdefault(len(v), []).append((k, v))
    shared = asked.sparkSession.sparkContext.broadcast((ids, {d: (np.array([k for k, _ in q]), np.array([v for _, v in q])) for d, q in by_length.items()}))

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, of_length = shared.value
        best = Best(limit)
        for batch in it:
            lists, flat = batch.column("v"), batch.column("v").flatten().to_numpy(zero_copy_only=False)
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for d, (number, q) in of_length.items():
                rows = np.flatnonzero(np.diff(at) == d)
                if len(rows):
                    cos = np.round(q @ flat[at[rows][:, None] + np.arange(d)].T, 9)
                    k, j = np.nonzero(cos >= best.floors(len(ids), -np.inf)[number][:, None])
                    best.add(number[k], batch.column("id").take(pa.array(rows[j])), cos[k, j], cos[k, j])
        yield from best.batches(ids)

    kinds = [df.schema["id"].dataType.simpleString() for df in (asked, vectors)]
    return vectors.select("id", "v").mapInArrow(scored, f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double")


def term_blocks(posts: DataFrame) -> DataFrame:
    """``term, block, n, peak``: the postings of each term in blocks of like weight, with their number and largest weight."""
    return posts.groupBy("term", block_of(F.col("weight")).alias("block")).agg(F.count("*").alias("n"), F.max("weight").alias("peak"))


def block_of(weight: Column) -> Column:
    return F.floor(weight * BLOCKS).cast("int")


def asked_posts(queries: DataFrame, posts: DataFrame) -> DataFrame:
    """The postings of asked terms, which a search reads several times; those of all others are read once."""
    terms = files.staged(queries.select("term").distinct(), "distinct")
    return files.staged(posts.join(checked(terms), "term", "left_semi").select("chunk_id", "term", "weight"), "mine")


def gains(queries: DataFrame, idf: DataFrame) -> DataFrame:
    """``query_id, term, gain`` of the asked terms that occur."""
    asked = files.staged(queries.groupBy("query_id", "term").agg(F.count("*").alias("times")), "terms")
    return files.staged(idf.select("term", "idf").join(checked(asked), "term").select("query_id", "term", (F.col("idf") * F.col("times")).alias("gain")), "wanted")


def bounded_blocks(queries: DataFrame, posts: DataFrame, idf: DataFrame, blocks: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """``query_id, term, gain`` of the asked terms that occur, and ``query_id, term, block, gain, rest, floor`` of the blocks that may hold a hit.

    A block can add gain * peak at most.  The blocks that can add most, those of rare terms, are read first, until they hold SEEDS
    times ``limit`` postings; the scores of the best chunks in them give each query a floor that a hit must reach.  A term is passed
    over if it can't reach the floor together with all that can add less, and a block if it can't with the most of all other terms.
    ``rest`` is what the terms that are passed over can add.
    """
    wanted = gains(queries, idf)
    held = files.staged(blocks.join(checked(wanted), "term").select("query_id", "term", "block", "n", "gain", (F.col("gain") * F.col("peak")).alias("most")), "blocks")
    # a query has as many terms as its text, and a term as many blocks as there are weights: windows of a few hundred rows
    first = Window.partitionBy("query_id").orderBy(F.col("most").desc(), "term", "block").rowsBetween(Window.unboundedPreceding, -1)
    seeds = held.withColumn("before", F.coalesce(F.sum("n").over(first), F.lit(0))).where(F.col("before") < SEEDS * limit)
    floor = _floors(_joined(seeds, posts), wanted, posts, limit)
    terms = held.groupBy("query_id", "term").agg(F.max("most").alias("peak")).join(floor.hint("merge"), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    upto = Window.partitionBy("query_id").orderBy("peak", "term").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("query_id")
    terms = terms.withColumns({"upto": F.sum("peak").over(upto), "total": F.sum("peak").over(whole)})
    over = F.col("upto") < F.col("floor")
    terms = terms.withColumn("rest", F.coalesce(F.sum(F.when(over, F.col("peak"))).over(whole), F.lit(0.0))).where(~over)
    chosen = held.join(terms.select("query_id", "term", "peak", "total", "rest", "floor").hint("merge"), ["query_id", "term"]).where(F.col("most") + F.col("total") - F.col("peak") >= F.col("floor"))
    return wanted, files.staged(chosen.select("query_id", "term", "block", "gain", "rest", "floor"), "chosen")


def _floors(hits: DataFrame, wanted: DataFrame, posts: DataFrame, limit: int) -> DataFrame:
    """``query_id, floor``: what a query's best by part of their score have in full, the least of ``limit``; 0 for fewer."""
    best = top(hits.select("query_id", "chunk_id", "score"), limit).select("query_id", "chunk_id")
    least = F.when(F.count("*") >= limit, F.min("score") - 1e-8).otherwise(0.0)
    return files.staged(_scored(best, wanted, posts).groupBy("query_id").agg(least.alias("floor")), "floors")


def _joined(chosen: DataFrame, posts: DataFrame) -> DataFrame:
    """Sums over the postings of chosen blocks, ``query_id, chunk_id, score`` and whatever else a query's rows have in common."""
    common = [c for c in ("rest", "floor") if c in chosen.columns]
    met = posts.withColumn("block", block_of(F.col("weight"))).join(checked(chosen), ["term", "block"])
    return met.groupBy("query_id", "chunk_id").agg(summed().alias("score"), *(F.first(c).alias(c) for c in common))


def _scored(pairs: DataFrame, wanted: DataFrame, posts: DataFrame) -> DataFrame:
    """Whole scores of pairs of query and chunk."""
    asked = files.staged(pairs.join(wanted.hint("merge"), "query_id").select("query_id", "chunk_id", "term", "gain"), "asked")
    return posts.join(checked(asked), ["chunk_id", "term"]).groupBy("query_id", "chunk_id").agg(summed().alias("score"))


def sparse_topk(queries: DataFrame, posts: DataFrame, idf: DataFrame, limit: int = 10, blocks: DataFrame | None = None, lists: tuple[DataFrame, float] | None = None) -> DataFrame:
    """BM25 top ``limit``: an equi-join of query terms with the blocks of postings that may hold a hit, never queries with chunks.

    With ``lists``, the ``counted_terms`` of the same postings and their mean size, few queries are answered in one pass over these instead
    (``passed_terms``).

    ``queries(query_id, term)``, ``posts(chunk_id, term, weight)``, ``idf(term, idf)`` with no negative number, and ``term_blocks``
    of the postings, if they are known.  Nothing is lost: what is passed over can't reach the ``limit`` best, by bounds (``bounded_blocks``); chunks that
    still may are scored in full.
    """
    if lists is not None:
        wanted = gains(queries, idf)
        if small(wanted) and wanted.select("query_id").distinct().count() <= PASS_QUERIES:
            return top(files.staged(passed_terms(wanted, *lists, limit), "passed"), limit)
    posts = asked_posts(queries, posts)
    wanted, chosen = bounded_blocks(queries, posts, idf, files.staged(term_blocks(posts), "blocks") if blocks is None else blocks, limit)
    able = files.staged(_joined(chosen, posts), "able")
    # most of the score is known by now, so its best give a higher floor
    higher = _floors(able, wanted, posts, limit).withColumnRenamed("floor", "higher")
    able = able.join(higher.hint("merge"), "query_id").where(F.col("score") + F.col("rest") >= F.greatest("floor", "higher")).select("query_id", "chunk_id")
    return top(_scored(able, wanted, posts), limit)


def units(df: DataFrame, key: str) -> DataFrame:
    """``id, v, norm``: rows with an id and a vector of finite components, scaled to length one; a vector of zeros stays."""
    v = F.col("vector").cast("array<double>")
    # NaN is above infinity in Spark's order
    sound = F.col(key).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    rows = df.select(F.col(key).alias("id"), v.alias("v"), sound.alias("sound")).where("sound").select("id", "v", norm.alias("norm"))
    return rows.select("id", F.transform("v", lambda x: x / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("v"), "norm")


class Cells:
    """Vectors of length one in cells around centres that a hash of their ids chooses, each with its largest distance to the centre.

    Centres, counts and distances are bounded by CELLS and come to the driver; vectors don't.  Vectors of zeros, and those of a length
    that no centre has, are in a cell that is always searched.  Only vectors of one length meet.
    """

    def __init__(self, vectors: DataFrame, kept=None):
        """``kept(name, build)`` as for ``Corpus``."""
        kept = kept or (lambda name, build: files.staged(build(), name))
        # blocks of vectors are rows of megabytes, so that a batch bounded in rows alone would hold a whole task's
        vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        self.key_type = vectors.schema["chunk_id"].dataType.simpleString()
        rows = kept("units", lambda: units(vectors.select("chunk_id", "vector"), "chunk_id"))
        n = min(CELLS, int(rows.count() ** 0.5) + 1)
        centres = [np.array(r.v) for r in rows.where("norm > 0").orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(n).select("v").collect()]
        self.centres = {d: np.stack([c for c in centres if len(c) == d]) for d in {len(c) for c in centres}}
        centres_of = self.centres

        def placed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                for d, part in pdf.groupby(pdf["v"].map(len)):
                    part = part.assign(dim=d, cell=-1, far=np.inf)
                    if d in centres_of:
                        away = distances(np.stack(part["v"]), centres_of[d])
                        near = np.where(part["norm"] > 0, away.argmin(1), -1)
                        part = part.assign(cell=near, far=np.where(near >= 0, away.min(1), np.inf))
                    yield part[["id", "v", "dim", "cell", "far"]]

        self.rows = kept("cells", lambda: rows.mapInPandas(placed, f"id {self.key_type}, v array<double>, dim int, cell int, far double"))
        sizes = self.rows.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
        self.sizes = {(r.dim, r.cell): (r.n, r.far) for r in sizes}

    def near(self, queries: DataFrame, limit: int, reach: bool) -> DataFrame:
        """``id, v, dim, cell``: the cells that each of ``queries(id, v, norm[, reach])`` is to search.

        First the nearest ones that hold ``limit`` vectors; with ``reach``, the distance of the last hit in those, all others that
        may hold a nearer vector, by the triangle inequality.  A query of zeros is as near to all.
        """
        sizes, centres_of, names = self.sizes, self.centres, ["id", "v", "dim", "cell"]

        def chosen(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                out = []
                for q in pdf.itertuples():
                    d = len(q.v)
                    cells = [c for k, c in sizes if k == d]
                    away = np.zeros(len(cells))
                    if d in centres_of and q.norm > 0:
                        from_centres = distances(np.array(q.v)[None], centres_of[d])[0]
                        away = np.array([from_centres[c] if c >= 0 else 0.0 for c in cells])
                    order = np.argsort(away, kind="stable")
                    held = np.cumsum([sizes[d, cells[k]][0] for k in order])
                    # the cells before the one that fills up, and that one; all for a query of zeros
                    first = int(np.searchsorted(held, limit)) + 1 if q.norm > 0 else len(cells)
                    if reach:
                        take = [k for k in order[first:] if away[k] - sizes[d, cells[k]][1] <= q.reach + MARGIN]
                    else:
                        take = order[:first]
                    out += [(q.id, q.v, d, cells[k]) for k in take]
                    while len(out) >= SLICE:
                        yield pd.DataFrame(out[:SLICE], columns=names)
                        out = out[SLICE:]
                yield pd.DataFrame(out, columns=names)

        kind = queries.schema["id"].dataType.simpleString()
        return queries.mapInPandas(chosen, f"id {kind}, v array<double>, dim int, cell int")

    def search(self, asked: DataFrame, limit: int) -> DataFrame:
        """Best ``limit`` of each block of a cell's vectors for each query that searches it: ``query_id, chunk_id, score``."""
        kind = asked.schema["id"].dataType.simpleString()

        def blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
            sizes = files.staged(df.groupBy("dim", "cell").agg(F.count("*").alias("n")), "sizes").withColumnsRenamed({"dim": "of_dim", "cell": "of_cell"})
            df = df.join(checked(sizes), (F.col("dim") == F.col("of_dim")) & (F.col("cell") == F.col("of_cell")))
            lot = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / rows))
            return df.groupBy("dim", "cell", lot.alias(f"{name}_lot")).agg(F.collect_list(F.struct("id", "v")).alias(name))

        left, right = files.staged(blocks(asked, QUERY_BLOCK, "qs"), "asked"), blocks(self.rows.select("id", "v", "dim", "cell"), VECTOR_BLOCK, "vs")
        pairs = right.join(checked(left, 64), ["dim", "cell"]).select("qs", "vs")

        def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for k in range(batch.num_rows):
                    (qi, q), (vi, v) = matrix(batch.column("qs"), k), matrix(batch.column("vs"), k)
                    by = np.argsort(vi.to_numpy(zero_copy_only=False), kind="stable")
                    cos = np.round(q @ v[by].T, 9)
                    best = np.argsort(-cos, axis=1, kind="stable")[:, :limit]
                    asker = np.repeat(np.arange(len(qi)), best.shape[1])
                    score = np.take_along_axis(cos, best, 1).ravel()
                    yield pa.RecordBatch.from_arrays([qi.take(pa.array(asker)), vi.take(pa.array(by[best].ravel())), pa.array(score)], names=["query_id", "chunk_id", "score"])

        return pairs.mapInArrow(compare, f"query_id {kind}, chunk_id {self.key_type}, score double")


def matrix(blocks: pa.ListArray, k: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and vectors of a block of ``id, v`` whose vectors are of one length, without an object for each number."""
    start, end = blocks.offsets[k].as_py(), blocks.offsets[k + 1].as_py()
    ids, v = (blocks.values.field(c).slice(start, end - start) for c in ("id", "v"))
    return ids, v.flatten().to_numpy(zero_copy_only=False).reshape(end - start, -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between rows of length one."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def dense_topk(queries: DataFrame, vectors: DataFrame, limit: int = 10, cells: Cells | Callable[[], Cells] | None = None) -> DataFrame:
    """Exact cosine top ``limit`` of ``vectors(chunk_id, vector)`` for each of ``queries(query_id, vector)``.

    Few queries are answered in one pass over the vectors (``passed_vectors``), unless ``cells`` are there already; they may also be a
    function that makes them when they are needed.  Of many queries, one searches the nearest cells first; the distance of its last hit there rules out cells that lie farther than that beyond
    their radius (``Cells``).  Blocks of queries and of vectors of a cell meet for one matrix product.  Rows without an id or a
    vector, and vectors with a component that is null, NaN or infinite, are left out; vectors of unlike length don't meet; a vector
    of zeros has cosine 0.
    """
    asked = files.staged(units(queries.select("query_id", "vector"), "query_id"), "asked")
    if not isinstance(cells, Cells) and small(asked, PASS_QUERIES):
        vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return top(files.staged(passed_vectors(asked, units(vectors.select("chunk_id", "vector"), "chunk_id"), limit), "passed"), limit)
    cells = cells if isinstance(cells, Cells) else cells() if cells else Cells(vectors)
    first = files.staged(top(cells.search(cells.near(asked, limit, False), limit), limit), "first")
    last = F.when(F.count("*") >= limit, F.sqrt(F.greatest(2 - 2 * F.min("score"), F.lit(0.0)))).otherwise(float("inf"))
    reach = first.groupBy(F.col("query_id").alias("id")).agg(last.alias("reach"))
    wider = asked.join(reach.hint("merge"), "id", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    rest = cells.search(files.staged(cells.near(wider, limit, True), "near"), limit)
    return top(first.drop("rank").unionByName(rest), limit)


def rrf_fuse(*channels: DataFrame, k: float | Column = RRF_K, limit: int = 10, prefetch: int = PREFETCH) -> DataFrame:
    """Reciprocal rank fusion: the sum over channels of 1 / (k + rank), with ranks from 0; a chunk needs one channel only."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    every = None
    for c in channels:
        part = c.where(F.col("rank") <= prefetch).select("query_id", "chunk_id", (1.0 / (k + F.col("rank") - 1)).alias("part"))
        every = part if every is None else every.unionByName(part)
    return top(every.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score")), limit)


def coverage(queries: DataFrame, hits: DataFrame, posts: DataFrame, idf: DataFrame) -> DataFrame:
    """The offline reranker: the share of a query's idf that the chunk's terms cover, for each hit."""
    wanted = queries.select("query_id", "term").join(idf.select("term", "idf").hint("merge"), "term", "left").select("query_id", "term", F.coalesce("idf", F.lit(0.0)).alias("idf"))
    wanted = files.staged(wanted, "wanted")
    total = wanted.groupBy("query_id").agg(F.sum("idf").alias("all_idf"))
    # a query has no more hits than were asked for, and no more terms than its text
    pairs = files.staged(hits.select("query_id", "chunk_id").join(checked(wanted), "query_id"), "pairs")
    found = posts.select("chunk_id", "term").join(checked(pairs), ["chunk_id", "term"])
    part = found.groupBy("query_id", "chunk_id").agg(F.sum("idf").alias("part"))
    scored = hits.join(part.hint("merge"), ["query_id", "chunk_id"], "left").join(total.hint("merge"), "query_id", "left")
    return scored.withColumn("rerank_score", F.coalesce(F.col("part") / F.when(F.col("all_idf") > 0, F.col("all_idf")), F.lit(0.0))).drop("part", "all_idf")


def rerank(scored: DataFrame, limit: int) -> DataFrame:
    """Hits by ``rerank_score``, cut at ``limit``; the fused score stays as ``rrf_score``."""
    kept = scored.withColumnRenamed("score", "rrf_score").drop("rank")
    return top(kept, limit, "rerank_score")


def payload(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk columns for hits that are already cut."""
    return hits.join(chunks, "chunk_id")


class Corpus:
    """Counted terms, idf and vectors of a table of chunks, each a table that is written once and read by all that is asked."""

    def __init__(self, chunks: DataFrame, kept=None):
        """``kept(name, build)`` gives a table that may have been written before; by default each is written here."""
        kept = kept or (lambda name, build: files.staged(build(), name))
        self.lists = kept("terms", lambda: W.counted_terms(chunks))
        self.mean = W.mean_size(self.lists)
        self.posts = W.postings_of(self.lists, self.mean)
        self.idf = kept("idf", lambda: W.term_idf(self.posts, chunks.agg(F.count("*").alias("n"))))
        self.vectors = lambda: kept("vectors", lambda: W.vectors(chunks, "chunk_id"))
        self.cells = lambda: Cells(self.vectors(), kept)

    def sparse(self, queries: DataFrame, limit: int = PREFETCH) -> DataFrame:
        return sparse_topk(W.query_terms(queries), self.posts, self.idf, limit, lists=(self.lists, self.mean))

    def hashed(self, queries: DataFrame, limit: int = PREFETCH) -> DataFrame:
        """Cosine of hashed term vectors; chunks that share no bucket with the query are no hits."""
        return dense_topk(W.vectors(queries, "query_id"), self.vectors(), limit, self.cells).where("score > 0")

    def retrieve(self, queries: DataFrame, top_k: int = 10, pool: int = POOL, k: float = RRF_K, reranked: bool = True) -> DataFrame:
        """Both channels, fused to a pool of max(top_k, pool), reranked, cut at ``top_k``."""
        fused = rrf_fuse(self.sparse(queries), self.hashed(queries), k=k, limit=max(top_k, pool) if reranked else top_k)
        if not reranked:
            return fused
        fused = files.staged(fused, "fused")
        # the terms of hits only
        of = files.staged(fused.select("chunk_id").distinct(), "of")
        posts = W.postings_of(self.lists.join(checked(of), "chunk_id", "left_semi"), self.mean)
        return rerank(coverage(W.query_terms(queries), fused, files.staged(posts, "posts"), self.idf), top_k)


def keyword_and_full(items: DataFrame) -> DataFrame:
    """Each item as two queries: its whole text (``framed``) and its first three tokens (``keyword``)."""
    framed = items.select((F.col("item_id") * 2).alias("query_id"), "item_id", F.lit("framed").alias("style"), "text")
    short = F.array_join(F.slice(T.tokens(F.col("text")), 1, 3), " ")
    return framed.unionByName(items.select((F.col("item_id") * 2 + 1).alias("query_id"), "item_id", F.lit("keyword").alias("style"), short.alias("text")))
