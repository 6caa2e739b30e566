"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints are grouped into tiles by the bit counts of their two 32-bit halves.  Two fingerprints that differ in at most
``radius`` bits lie in tiles whose counts differ by at most ``radius`` in sum, so all other tile pairs are skipped; inside a
pair of tiles the same rule on 16-bit quarters skips sub-tiles, and what is left is compared with numpy's exclusive-or and
bit count.  Texts with one fingerprint are one node from the start, and a tile pair returns a spanning forest of its links,
never all its pairs.  Large tiles are cut into slices of a fixed size.

``without_near_copies`` has a rule of its own, Jaccard similarity of word shingles.  Its candidates come from tiles by shingle
count, in which 128-bit fingerprints are compared, and are verified on the shingles themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, components, documents, fresh, sized, staged

WIDTH = 3
RADIUS = 2
#: Fingerprints that one slice of a tile holds at most, on average.
SLICE = 4096
#: Fingerprints that one lot of tile pairs compares in a task, about.
LOT = 2 * SLICE
#: Near copies: words a shingle, least Jaccard similarity, and the differing bits of 128, and of the first 64, within which pairs
#: are verified.  Pairs of similarity 0.8 differ in 19.4 bits on average, with a deviation of 4.1.
COPY_WIDTH, ALIKE, COPY_RADIUS, HALF_RADIUS = 5, 0.8, 40, 26
#: Texts that one slice of a tile by shingle count holds at most, on average, and pairs of texts that a lot compares, about.
COPY_SLICE, COPY_LOT = 1 << 15, 1 << 27


def fingerprint(text: bytes, width: int = WIDTH) -> bytes:
    """64-bit SimHash of the word shingles of ``text``, eight bytes, most significant first."""
    import xxhash

    ws = text.lower().split()
    if not ws:
        return bytes(8)
    line = b" ".join(ws)
    if len(ws) <= width:
        return xxhash.xxh64_digest(line, 42)
    sizes = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    ends = np.cumsum(sizes)
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], 42) for a, b in zip((ends - sizes)[: 1 - width].tolist(), (ends - 1)[width - 1 :].tolist())])
    n = len(hashes) // 8
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = np.frombuffer(hashes, np.uint8)[8 * k : 8 * (k + (1 << 16))].reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", width: int = WIDTH) -> DataFrame:
    """``docs`` with a column of 16 hexadecimal digits."""
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def hexed(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            yield pa.array([fingerprint(t, width).hex() for t in as_bytes(texts)], pa.string())

    return docs.withColumn(name, hexed(F.col(text)))


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links between ``a`` and ``b`` (positions in their concatenation), or within ``a`` if they are one."""
    qa, qb = _quarters(a), _quarters(b)
    ka, ia = np.unique(qa, axis=0, return_inverse=True)
    kb, ib = np.unique(qb, axis=0, return_inverse=True)
    at_b = np.split(np.argsort(ib, kind="stable"), np.cumsum(np.bincount(ib))[:-1])
    label = np.arange(len(a) + len(b))
    out = []
    for k, rows in enumerate(np.split(np.argsort(ia, kind="stable"), np.cumsum(np.bincount(ia))[:-1])):
        near = np.flatnonzero(np.abs(kb - ka[k]).sum(axis=1) <= radius)
        if not len(near):
            continue
        cols = np.concatenate([at_b[j] for j in near])
        for lo in range(0, len(rows), 256):
            part = rows[lo : lo + 256]
            hit = np.bitwise_count(a[part][:, None] ^ b[cols][None, :]) <= radius
            for r in np.flatnonzero(hit.any(axis=1)):
                i, js = part[r], cols[hit[r]] + len(a)
                roots = np.unique(np.append(label[js], label[i]))
                if len(roots) > 1:
                    out += [(int(roots[0]), int(x)) for x in roots[1:]]
                    label[np.isin(label, roots[1:])] = roots[0]
    return out


def tile_plan(tiled: DataFrame, key: str, slice_rows: int, lot_size: int, partners, cost) -> DataFrame | None:
    """``tiled`` (with ``key`` and a column ``tile``) dealt into slices, each beside the slices that it is to be compared with.

    Adds ``lot, pair, side, own``: a pair is two slices (or one and itself, ``own``), its rows are of side 0 and 1, and a lot is
    some pairs in a row.  ``partners(s)`` are the tiles from ``s`` on that a tile meets and ``cost(m, n)`` what two slices of these
    sizes cost, of which a lot holds about ``lot_size``.  What is on the driver has a row for each pair of tiles, whose number
    doesn't depend on the input; the pairs of slices are made on Spark.
    """
    spark = tiled.sparkSession
    sizes = {r.tile: r.n for r in tiled.groupBy("tile").agg(F.count("*").alias("n")).collect()}
    slices = {t: -(-n // slice_rows) for t, n in sizes.items()}
    pairs, first, filled = [], 0, 0
    for s in sorted(sizes):
        for t in partners(s):
            if t in sizes:
                each = max(cost(sizes[s] // slices[s], sizes[t] // slices[t]), 1)
                n = slices[s] * slices[t]
                pairs.append((s, t, slices[s], slices[t], first, filled, each))
                first, filled = first + n, filled + n * each
    if not pairs:
        return None
    plan = spark.createDataFrame(pairs, "s int, t int, ns bigint, nt bigint, first bigint, filled bigint, each bigint")
    plan = plan.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("ns") - 1)))
    plan = plan.withColumn("j", F.explode(F.sequence(F.when(F.col("s") == F.col("t"), F.col("i")).otherwise(F.lit(0)).cast("bigint"), F.col("nt") - 1)))
    at = F.col("i") * F.col("nt") + F.col("j")
    lot = F.expr(f"(filled + (i * nt + j) * each) div {lot_size}")
    plan = plan.select("s", "i", "t", "j", (F.col("first") + at).alias("pair"), lot.alias("lot"), ((F.col("s") == F.col("t")) & (F.col("i") == F.col("j"))).alias("own"))
    sides = F.explode(F.when(F.col("own"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))
    steps = plan.withColumn("side", sides).select(F.when(F.col("side") == 0, F.col("s")).otherwise(F.col("t")).alias("tile"), F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("j")).alias("slice"), "lot", "pair", "side", "own")
    cut = F.create_map(*[x for t, n in slices.items() for x in (F.lit(t), F.lit(n))])
    dealt = tiled.withColumn("slice", F.pmod(F.xxhash64(key), cut[F.col("tile")]).cast("bigint"))
    # two rows for each pair of slices at most: few are broadcast, many are joined by sort-merge
    return dealt.join(F.broadcast(steps) if first <= 50_000 else steps.hint("merge"), ["tile", "slice"])


def links(nodes: DataFrame, radius: int = RADIUS, slice_rows: int = SLICE) -> DataFrame:
    """Edges ``(u, v)`` that connect the distinct fingerprints ``nodes(fp bigint)`` within ``radius`` bits."""
    tiled = nodes.select("fp", (F.bit_count(F.shiftrightunsigned("fp", 32)) * 64 + F.bit_count(F.col("fp").bitwiseAND(0xFFFFFFFF))).cast("int").alias("tile"))
    # 33 x 33 tiles at most; each meets those whose counts differ by ``radius`` in sum
    steps = [(h, k) for h in range(radius + 1) for k in range(h - radius, radius - h + 1) if (h, k) >= (0, 0)]
    near = lambda s: [s + 64 * h + k for h, k in steps if s // 64 + h <= 32 and 0 <= s % 64 + k <= 32]
    joined = tile_plan(tiled, "fp", slice_rows, LOT, near, lambda m, n: m + n)
    if joined is None:
        return nodes.sparkSession.createDataFrame([], "u bigint, v bigint")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pair, side = pdf["pair"].to_numpy(), pdf["side"].to_numpy()
        fps = np.ascontiguousarray(pdf["fp"].to_numpy(np.int64)).view(np.uint64)
        order = np.lexsort((fps, side, pair))
        pair, side, fps, own = pair[order], side[order], fps[order], pdf["own"].to_numpy()[order]
        found = []
        for at in np.split(np.arange(len(pair)), np.flatnonzero(np.diff(pair)) + 1):
            a, b = fps[at[side[at] == 0]], fps[at[side[at] == 1]]
            if own[at[0]]:
                b = a
            i = np.array(forest(a, b, radius), np.int64).reshape(-1, 2)
            found.append(np.concatenate([a, b])[i])
        uv = np.unique(np.concatenate(found).view(np.int64), axis=0)
        return pd.DataFrame({"u": uv[:, 0], "v": uv[:, 1]})

    return joined.groupBy("lot").applyInPandas(compare, "u bigint, v bigint").where("u <> v")


def _grouped(docs: DataFrame, text: str, doc_id: str, radius: int, width: int) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """``docs`` with fingerprints, written out; the fingerprints with their group; the names of the working columns."""
    name = {k: fresh(docs, k) for k in ("fp", "row", "of_fp", "root")}
    half = lambda at: F.conv(F.substring("fingerprint", at, 8), 16, 10).cast("bigint")
    hashed = with_fingerprint(docs, text, "fingerprint", width)
    hashed = hashed.withColumn(name["fp"], F.shiftleft(half(1), 32).bitwiseOR(half(9))).withColumn(name["row"], F.monotonically_increasing_id())
    hashed = staged(hashed, "simhash")
    nodes = staged(hashed.groupBy(F.col(name["fp"]).alias("fp")).agg(F.min(doc_id).alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    known = nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    known = staged(known, "roots")
    lowest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    member = known.join(lowest.hint("merge"), "root").select(F.col("fp").alias(name["of_fp"]), F.col("root").alias(name["root"]), "component_id")
    return hashed, member, name


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """Every row of ``docs`` with ``fingerprint`` (16 hexadecimal digits) and ``component_id``.

    component_id is the smallest id of all rows whose fingerprints are linked, directly or by a chain, at ``radius`` or
    fewer differing bits.  A null or empty text has no word and fingerprint zero, which links like any other.  Repeated rows
    share a fingerprint; null ids are passed over by the minimum (null where a group has no other).  Ties don't arise: the
    minimum is a value.  A very long text is hashed whole, 65,536 shingles at a time.  An empty table gives an empty table.
    Columns of those two names are replaced; working columns take names that ``docs`` doesn't have.
    """
    keep = [c for c in docs.columns if c not in ("fingerprint", "component_id")]
    hashed, member, name = _grouped(docs.select(*keep), text, doc_id, radius, width)
    return hashed.join(member.hint("merge"), hashed[name["fp"]] == member[name["of_fp"]]).select(*keep, "fingerprint", "component_id")


def first_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group of ``near_duplicates`` the row with the smallest id stays.

    A row without id stays only where its group has no other; among equal ids the row that was read first stays.
    """
    keep = [c for c in docs.columns if c not in ("fingerprint", "component_id")]
    hashed, member, name = _grouped(docs.select(*keep), text, doc_id, radius, width)
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(name["row"]).alias("row"))
    # the minimum is taken for each fingerprint, then for each group: no group is gathered
    by_fp = hashed.groupBy(F.col(name["fp"]).alias(name["of_fp"])).agg(F.min(order).alias("first"))
    first = by_fp.join(member.hint("merge"), name["of_fp"]).groupBy(name["root"]).agg(F.min("first").alias("first"))
    stays = first.select(F.col("first.row").alias(name["of_fp"]))
    return hashed.join(stays.hint("merge"), hashed[name["row"]] == stays[name["of_fp"]], "left_semi").select(*keep)


def shingles(text: bytes, width: int = COPY_WIDTH) -> tuple[bytes, bytes]:
    """The text's words joined by one space, and the 128-bit hashes of its word shingles (a text of fewer words is one)."""
    import xxhash

    ws = text.lower().split()
    line = b" ".join(ws)
    if len(ws) <= width:
        return line, xxhash.xxh3_128_digest(line)
    sizes = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    ends = np.cumsum(sizes)
    digest = xxhash.xxh3_128_digest
    return line, b"".join([digest(line[a:b]) for a, b in zip((ends - sizes)[: 1 - width].tolist(), (ends - 1)[width - 1 :].tolist())])


def shingle_set(hashes: bytes) -> np.ndarray:
    """Sorted distinct first halves of the shingles' hashes."""
    return np.unique(np.frombuffer(hashes, np.uint64)[::2])


def sketch(text: bytes, width: int = COPY_WIDTH) -> tuple[int, int, int, int]:
    """Hash of the text's words, the halves of its 128-bit SimHash over distinct shingles, and their number."""
    import xxhash

    line, hashes = shingles(text, width)
    every = np.frombuffer(hashes, np.uint8).reshape(-1, 16)
    every = every[np.unique(np.frombuffer(hashes, np.uint64)[::2], return_index=True)[1]]
    ones = np.zeros(128, np.int64)
    for k in range(0, len(every), 1 << 16):
        ones += np.unpackbits(every[k : k + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    hi, lo = np.packbits(2 * ones > len(every)).view(np.int64).tolist()
    return int(np.uint64(xxhash.xxh3_64_intdigest(line)).view(np.int64)), hi, lo, len(every)


def _candidates(hi: np.ndarray, lo: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, alike: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each position of ``a`` with a candidate in ``b``: the candidates' positions.  Both are sorted by ``n``."""
    for k in range(0, len(a), 64):
        part = a[k : k + 64]
        # shingle counts further apart rule the similarity out
        cols = b[np.searchsorted(n[b], n[part[0]] * alike - 1e-6) : np.searchsorted(n[b], n[part[-1]] / alike + 1e-6, "right")]
        r, c = np.nonzero(np.bitwise_count(hi[part][:, None] ^ hi[cols][None, :]) <= HALF_RADIUS)
        i, j = part[r], cols[c]
        near = np.bitwise_count(hi[i] ^ hi[j]) + np.bitwise_count(lo[i] ^ lo[j]) <= COPY_RADIUS
        near &= (i != j) & (n[i] >= alike * n[j] - 1e-6) & (n[j] >= alike * n[i] - 1e-6)
        i, j = i[near], j[near]
        for at in np.split(np.arange(len(i)), runs_of(i)[1:]) if len(i) else []:
            yield int(i[at[0]]), j[at]


def runs_of(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1]))


def similar_links(nodes: DataFrame, texts: DataFrame, alike: float = ALIKE, width: int = COPY_WIDTH, slice_rows: int = COPY_SLICE) -> DataFrame:
    """Edges ``(u, v)`` that connect the ``nodes(key, hi, lo, n, row)`` whose shingle sets have Jaccard similarity ``alike``.

    A pair of slices first gives the texts that have a candidate in it; those alone are fetched from ``texts(row, text)`` and
    verified.  Both steps return texts or a spanning forest, never all pairs.
    """
    # one tile for each quarter more shingles; two tiles on only by rounding
    tiled = nodes.withColumn("tile", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / alike)) + 1e-9).cast("int"))
    joined = tile_plan(tiled, "key", slice_rows, COPY_LOT, lambda s: (s, s + 1, s + 2), lambda m, n: m * n)
    if joined is None:
        return nodes.sparkSession.createDataFrame([], "u bigint, v bigint")

    def sides(pdf: pd.DataFrame) -> Iterator[tuple]:
        pdf = pdf.sort_values(["pair", "side", "n", "key"], ignore_index=True)
        pair, side, own = pdf["pair"].to_numpy(), pdf["side"].to_numpy(), pdf["own"].to_numpy()
        hi, lo = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("hi", "lo"))
        n = pdf["n"].to_numpy()
        for at in np.split(np.arange(len(pair)), runs_of(pair)[1:]):
            a = at[side[at] == 0]
            b = a if own[at[0]] else at[side[at] == 1]
            yield pdf, _candidates(hi, lo, n, a, b, alike)

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        hit, of = np.zeros(len(pdf), bool), pdf
        for of, found in sides(pdf):
            for i, js in found:
                hit[i] = True
                hit[js] = True
        return of.loc[hit, ["pair", "side", "own", "key", "hi", "lo", "n", "row"]]

    kinds = "pair bigint, side int, own boolean, key bigint, hi bigint, lo bigint, n bigint, row bigint"
    members = staged(joined.groupBy("lot").applyInPandas(met, kinds), "members")
    wanted = members.select("row").distinct()
    told = staged(texts.join(sized(wanted, 500_000), "row", "left_semi"), "texts")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = [], []
        for of, found in sides(pdf):
            key, text, sets, label = of["key"].to_numpy(), of["text"], {}, np.arange(len(of))

            def set_of(i: int) -> np.ndarray:
                if i not in sets:
                    sets[i] = shingle_set(shingles((text[i] or "").encode(), width)[1])
                return sets[i]

            for i, js in found:
                for j in js.tolist():
                    if label[i] == label[j]:
                        continue
                    a, b = set_of(i), set_of(j)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    if both >= alike * (len(a) + len(b) - both) - 1e-9:
                        u.append(key[i])
                        v.append(key[j])
                        label[label == label[j]] = label[i]
        return pd.DataFrame({"u": np.array(u, np.int64), "v": np.array(v, np.int64)})

    return members.join(told.hint("merge"), "row").groupBy("pair").applyInPandas(verify, "u bigint, v bigint")


def without_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", alike: float = ALIKE, width: int = COPY_WIDTH) -> DataFrame:
    """The rows of ``docs`` of which one of each group stays: texts with Jaccard similarity ``alike`` are linked, and chains of them.

    The similarity is that of the sets of ``width``-word shingles, lower-cased; null and empty texts, which have no word, are
    alike.  Of a group the row with the smallest id stays; a row without id only where there is no other; among equal ids, and
    repeated rows, the one that was read first.  A very long text is compared by its fingerprint and fetched only if it has a
    candidate.  An empty table gives an empty table; working columns take names that ``docs`` doesn't have.
    """
    bounded_batches(docs.sparkSession)
    name = {k: fresh(docs, k) for k in ("sketch", "row", "of_key", "root")}

    @F.arrow_udf("struct<key: bigint, hi: bigint, lo: bigint, n: bigint>")
    def sketched(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            columns = zip(*(sketch(t, width) for t in as_bytes(texts))) if len(texts) else ([], [], [], [])
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "hi", "lo", "n"])

    hashed = docs.withColumn(name["sketch"], sketched(F.col(text))).withColumn(name["row"], F.monotonically_increasing_id())
    hashed = staged(hashed, "sketches")
    of = hashed.select(f"{name['sketch']}.*", F.col(name["row"]).alias("row"))
    nodes = staged(of.groupBy("key").agg(*(F.min(c).alias(c) for c in ("hi", "lo", "n", "row"))), "nodes")
    edges = similar_links(nodes, hashed.select(F.col(name["row"]).alias("row"), F.col(text).alias("text")), alike, width)
    roots = components(edges)
    known = nodes.select("key").join(roots.withColumnRenamed("node", "key").hint("merge"), "key", "left")
    member = known.select(F.col("key").alias(name["of_key"]), F.coalesce("component", "key").alias(name["root"]))
    order = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(name["row"]).alias("row"))
    by_key = hashed.groupBy(F.col(f"{name['sketch']}.key").alias(name["of_key"])).agg(F.min(order).alias("first"))
    first = by_key.join(member.hint("merge"), name["of_key"]).groupBy(name["root"]).agg(F.min("first").alias("first"))
    stays = first.select(F.col("first.row").alias(name["of_key"]))
    return hashed.join(stays.hint("merge"), hashed[name["row"]] == stays[name["of_key"]], "left_semi").select(*docs.columns)


def op2_simhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")
