"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is a weighted share of all words, at most MAX_COPIES times what it has.  Target over size is the number of copies of
each of its documents; the fraction of that number is rounded so that the words taken stay the same.  In a lot of a source's
documents, from the longest on, each is paired with the pool of those after it: words are moved from one to the other, at random
but fairly, until the document or the whole pool is at a full copy or at none.  So a lot leaves one document open, as a rule its
shortest.  Open documents meet in pairs in lots of their own, level by level as a tree, until a source has one, and a fair draw decides it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, documents, sized, staged
from .sharding import ranked

WEIGHTS, MAX_COPIES, SEED = (1, 2, 3), 3, 29
#: Documents of a source in a lot, and open ones in a lot of the tree.
LOT, FAN_IN = 4096, 1024
#: Parts of a word in which mass is counted, so that sums are exact.
PARTS = 1 << 20
#: Sources whose targets are broadcast; more are joined by sort-merge.
BROADCAST_SOURCES = 100_000
DECISION = "source string, doc_id string, size bigint, draw bigint, mass bigint, extra int, open boolean"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """``source, source_size, target`` for ``sizes(source, source_size)``, one row for each source, written out.

    Sources in order of code points, null last, weigh ``weights`` in turn and share all words; what exceeds ``most`` times a source's
    size is shared among the others by weight, round by round.  A round reads one row for each source and brings sums back.
    """
    placed = ranked(sizes.withColumn("last", F.col("source").isNull()), ["last", "source"], name="place").drop("last")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    rows = staged(placed.select("source", "source_size", weight.cast("decimal(20,0)").alias("weight")), "sources")
    limit = F.col("source_size").cast("decimal(20,0)") * most
    everything = rows.agg(F.sum("source_size")).first()[0] or 0
    # what is left to share, and the weights that share it: a source is full if its part, left * weight / shares, reaches its limit
    full, state = F.lit(False), None
    while True:
        sums = rows.agg(F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)), F.coalesce(F.sum(F.when(full, limit)), F.lit(0))).first()
        shares, left = int(sums[0]), everything - int(sums[1])
        if (shares, left) == state or not shares:
            break
        state = shares, left
        full = F.lit(left).cast("decimal(18,0)") * F.col("weight") >= limit * F.lit(shares).cast("decimal(18,0)")
    part = F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(max(shares, 1)))
    return staged(rows.select("source", "source_size", F.when(full, limit.cast("double")).otherwise(part).alias("target")), "targets")


def draws(part: int) -> Column:
    """63 bits that depend on the row alone; ``part`` tells the levels apart."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.lit(part), "doc_id", "size"), 1)


def goes_up(draw: int, up: int, down: int) -> bool:
    """True with probability down / (up + down): what may be gained and lost then balance."""
    return draw * (up + down) < down << 63


def with_pool(lot: list[tuple[int, int]], total: int) -> tuple[list[int], int | None, int]:
    """Roundings (0 or 1) of a lot's documents ``(size, draw)``, longest first, that share ``total`` mass by size; the place of the open one, and its mass.

    Every size is positive; ``total`` lies between nothing and all.  The pool's mass is spread over it by size.
    """
    out, rest, mass = [0] * len(lot), sum(size for size, _ in lot) * PARTS, total
    for k, (size, draw) in enumerate(lot):
        if mass in (0, rest):  # the pool is whole copies
            out[k:] = [int(mass > 0)] * (len(lot) - k)
            return out, None, 0
        full = size * PARTS
        if full == rest:
            return out, k, mass
        own = mass * full // rest
        rest, pool = rest - full, mass - mass * full // rest
        up, down = min(full - own, pool), min(own, rest - pool)
        change = up if goes_up(draw, up, down) else -down
        own, mass = own + change, pool - change
        if 0 < own < full:  # then the pool is whole copies: this document stays open
            out[k + 1 :] = [int(mass > 0)] * (len(lot) - k - 1)
            return out, k, own
        out[k] = int(own > 0)
    return out, None, 0


def in_pairs(lot: list[tuple[int, int, int]]) -> tuple[list[int], int | None, int]:
    """As ``with_pool``, for open documents ``(size, draw, mass)`` of any mass: two meet, and the one still open meets the next."""
    out, at, held = [0] * len(lot), None, 0
    for k, (size, draw, own) in enumerate(lot):
        if at is None:
            at, held = k, own
            continue
        full, other = size * PARTS, lot[at][0] * PARTS
        up, down = min(full - own, held), min(own, other - held)
        change = up if goes_up(draw, up, down) else -down
        own, held = own + change, held - change
        for place, now, whole in ((at, held, other), (k, own, full)):
            if now in (0, whole):
                out[place] = int(now > 0)
        at, held = (at, held) if 0 < held < other else (k, own) if 0 < own < full else (None, 0)
    return out, at, held


def _rounded(rows: DataFrame, level: int) -> DataFrame:
    """The rows of lots (``source, lot``) with ``extra``, one left open in each; a task goes through its lots one after another."""
    order = ["source", "lot", F.col("size").desc(), "draw", "doc_id"]
    dealt = rows.repartition("source", "lot").sortWithinPartitions(*order)
    columns = ("source", "lot", "doc_id", "size", "draw", "mass", "share")

    def decide(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(lot: list[tuple]) -> pa.RecordBatch:
            if level:
                extra, at, mass = in_pairs([(r[3], r[4], r[5]) for r in lot])
            else:
                size = sum(r[3] for r in lot)
                extra, at, mass = with_pool([(r[3], r[4]) for r in lot], min(round(lot[0][6] * size * PARTS), size * PARTS))
            source, _, doc_id, sizes, draw, _, _ = zip(*lot)
            open_ = [k == at for k in range(len(lot))]
            masses = [mass if k == at else 0 for k in range(len(lot))]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            names = ["source", "doc_id", "size", "draw", "mass", "extra", "open"]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((source, doc_id, sizes, draw, masses, extra, open_), kinds)], names=names)

        lot: list[tuple] = []
        for b in it:
            for r in zip(*(b.column(c).to_pylist() for c in columns)):
                if lot and lot[0][:2] != r[:2]:
                    yield done(lot)
                    lot = []
                lot.append(r)
        if lot:
            yield done(lot)

    return dealt.mapInArrow(decide, DECISION)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, text: str = "text", doc_id: str = "doc_id", source: str = "source", lot: int = LOT, fan_in: int = FAN_IN) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of each row of ``docs``; taken is copies times size.

    Each source's words taken differ from its target by less than one document, its last open one.  Null texts and those without
    a word have size 0 and no copy; rows without a source are one source, after all others; null ids are ids; rows that are
    alike are rounded alike or in any order, and any rerun gives the same; an empty table gives an empty table.  Of a very long text
    only its number of words goes on.  Extra columns aren't read, so they can't clash.  Draws follow from id and size.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[doc_id].dataType
    size = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    rows = staged(docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size")), "sizes")
    sums = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sums")
    goal = targets(sums.select("source", "source_size"), weights, most).select(F.col("source").alias("of"), "source_size", "target")
    goal = staged(goal.join(sums.select(F.col("source").alias("own"), "n").hint("merge"), F.col("own").eqNullSafe(F.col("of"))).drop("own"), "goals")
    copies = F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    # a lot is a part of a source by hash, whatever its share of all rows
    n_lots = F.ceil(F.col("n") / lot)
    joined = rows.join(sized(goal, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("of")))
    joined = joined.select("source", "doc_id", "size", draws(0).alias("draw"), F.floor(copies).alias("whole"), (copies - F.floor(copies)).alias("share"), F.pmod(F.xxhash64("doc_id", "size"), n_lots).alias("lot"), F.lit(0).cast("bigint").alias("mass"))
    fractional = (F.col("share") > 0) & (F.col("size") > 0)
    settled = joined.where(~fractional).select("source", "doc_id", "size", F.lit(0).alias("extra"))
    level, now = 0, staged(_rounded(joined.where(fractional).drop("whole"), 0), "rounded")
    parts = [settled, now.where("not open").select("source", "doc_id", "size", "extra")]
    while True:
        left = now.where("open").select("source", "doc_id", "size", "mass")
        widest = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if widest <= 1:
            break
        level += 1
        lots = -(-widest // fan_in)
        dealt = left.select("*", draws(level).alias("draw"), F.pmod(F.xxhash64(F.lit(level), "doc_id", "size"), F.lit(lots)).alias("lot"), F.lit(0.0).alias("share"))
        now = staged(_rounded(dealt, level), "rounded")
        parts.append(now.where("not open").select("source", "doc_id", "size", "extra"))
    # the last of a source: a fair draw, of which the first 31 bits are enough
    chance = F.col("mass") / (F.col("size") * PARTS)
    parts.append(left.select("source", "doc_id", "size", F.when(F.shiftright(draws(-1), 32) / F.lit(float(1 << 31)) < chance, 1).otherwise(0).alias("extra")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    goal = staged(goal.select("of", "source_size", "target", F.floor(copies).alias("whole")), "goals")
    out = staged(every, "decided").join(sized(goal, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("of")))
    copied = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(0)
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "source", "size", "source_size", "target", copied.cast("int").alias("copies"), (F.col("size") * copied).cast("bigint").alias("taken"))


def op13_mixing(spark, sf_dir):
    out = mixed(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
