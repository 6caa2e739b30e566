"""Retrieval and answer evaluation: ranks against gold, recall, MRR, breakdowns, repeatability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators.ranks import checked
from quillon.sources import files

CUTS = (1, 3, 5, 10)


def passages_in(docs: DataFrame, items: DataFrame, width: int = 5) -> DataFrame:
    """``item_id, chunk_id`` of each document that holds an item's text verbatim.

    Each item is looked for by the rarest of its windows of ``width`` inner tokens (all of them if it has fewer), as counted in the
    documents; the outer tokens may go on in a document.  Windows are hashes beside an id; texts come in at the end, where
    document and item have met, and decide.  An item of one or two tokens, which has no inner ones, is looked for by the tokens
    that hold its longest one, found by their letters.  Items without a token, and rows without an id, are never found.
    """
    item = files.staged(items.where("item_id is not null").select("item_id", F.col("text").alias("item_text"), T.tokens(F.col("text")).alias("t")).where(F.size("t") > 0), "items")
    met = _by_windows(docs, item.where(F.size("t") > 2), width)
    short = item.where(F.size("t") <= 2)
    if not short.isEmpty():
        met = met.unionByName(_by_letters(docs, short))
    met = files.staged(met.distinct().join(item.select("item_id", "item_text").hint("merge"), "item_id"), "met")
    found = docs.select("chunk_id", "text").join(checked(met), "chunk_id")
    return found.where(F.col("text").contains(F.col("item_text"))).select("item_id", "chunk_id").distinct()


def _by_windows(docs: DataFrame, item: DataFrame, width: int) -> DataFrame:
    """``item_id, chunk_id`` where a document has the rarest window of an item with inner tokens.

    A window is one hash, of its width and its tokens: distinct numbers are found by a set, distinct structs by comparing all pairs.
    """
    none = F.array().cast("array<bigint>")

    def windows(t: Column, w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(t) - w + 1), lambda k: F.xxhash64(w.cast("int"), F.slice(t, k, w)))
        return F.when(F.size(t) >= w, each).otherwise(none)

    inner = F.slice("t", F.lit(2), F.size("t") - 2)
    asked = item.select("item_id", inner.alias("t")).withColumn("w", F.least(F.size("t"), F.lit(width)))
    asked = files.staged(asked.select("item_id", "w", F.explode(F.array_distinct(windows(F.col("t"), F.col("w")))).alias("h")), "asked")
    wanted = asked.select("h").distinct()
    widths = sorted(r.w for r in asked.select("w").distinct().collect())  # ``width`` of them at most
    t = docs.select("chunk_id", T.tokens(F.col("text")).alias("t"))
    held = t.select("chunk_id", F.explode(F.array_distinct(F.concat(*(windows(F.col("t"), F.lit(w)) for w in widths), none))).alias("h"))
    held = files.staged(held.join(checked(files.staged(wanted, "wanted")), "h"), "held")
    df = held.groupBy("h").agg(F.count("*").alias("n"))
    # a window that no document has is the rarest of all, and its item has no passage
    counted = asked.join(df.hint("merge"), "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("item_id").agg(F.min_by("h", F.struct("n", "h")).alias("h"), F.min("n").alias("n")).where("n > 0")
    return held.join(files.staged(rarest.select("item_id", "h"), "rarest").hint("merge"), "h").select("item_id", "chunk_id")


def _by_letters(docs: DataFrame, item: DataFrame, letters: int = 3) -> DataFrame:
    """``item_id, chunk_id`` where a token of a document holds the longest token of a short item."""
    longest = F.array_max(F.transform("t", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    item = item.select("item_id", longest.alias("x")).withColumn("g", F.substring("x", 1, letters))
    postings = files.staged(docs.select("chunk_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("token")), "tokens")
    sizes = sorted(r[0] for r in item.select(F.length("g")).distinct().collect())  # ``letters`` of them at most

    def parts(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("token") - (n - 1), F.lit(1))), lambda k: F.substr("token", k, F.lit(n)))

    grams = F.flatten(F.array(*map(parts, sizes)))
    words = postings.select("token").distinct().select("token", F.explode(F.array_distinct(grams)).alias("g"))
    holding = words.join(item.hint("merge"), "g").where(F.col("token").contains(F.col("x"))).select("item_id", "token").distinct()
    return postings.join(files.staged(holding, "holding").hint("merge"), "token").select("item_id", "chunk_id")


def hit_ranks(items: DataFrame, hits: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """``items`` with the 1-based rank of the first hit among the item's gold chunks, null without one.

    ``hits(*keys, chunk_id, rank)`` and ``gold(item_id, chunk_id)``; any gold chunk will do.
    """
    first = hits.join(gold, ["item_id", "chunk_id"]).groupBy(*keys).agg(F.min("rank").alias("hit_rank"))
    return items.join(first.hint("merge"), keys, "left")


def recall(k: int, rank: Column) -> Column:
    return F.coalesce(F.avg(F.when(rank <= k, 1.0).otherwise(0.0)), F.lit(0.0))


def measures(rank: str = "hit_rank", cuts: tuple[int, ...] = CUTS) -> list[Column]:
    """Recall at each cut, mean reciprocal rank (a miss counts 0) and the number of items, in one pass."""
    r = F.col(rank)
    return [*(recall(k, r).alias(f"recall_at_{k}") for k in cuts), F.coalesce(F.avg(F.coalesce(1 / r, F.lit(0.0))), F.lit(0.0)).alias("mrr"), F.count("*").alias("n")]


def report(results: DataFrame, attributes: list[str], always: list[str] = [], overall: bool = True, aggregates: list[Column] | None = None) -> DataFrame:  # noqa: B006
    """Overall and by-attribute aggregates from one pass of grouping sets: ``attribute, value`` and the aggregates."""
    sets = [[*always, a] for a in attributes] + ([list(always)] if overall else [])
    cols = [*always, *attributes]
    out = results.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(*(aggregates or measures()), F.grouping_id().alias("gid"))
    bits = {a: 1 << (len(cols) - 1 - cols.index(a)) for a in attributes}
    name, value = F.lit("overall"), F.lit(None).cast("string")
    for a in attributes:
        here = F.col("gid").bitwiseAND(bits[a]) == 0
        name, value = F.when(here, F.lit(a)).otherwise(name), F.when(here, F.col(a).cast("string")).otherwise(value)
    return out.withColumns({"attribute": name, "value": value}).drop("gid", *attributes)


def rank_matrix(results: DataFrame, item: str, config: str, values: list[str]) -> DataFrame:
    return results.groupBy(item).pivot(config, values).agg(F.min("hit_rank"))


def fingerprints(rows: DataFrame, parts: int) -> DataFrame:
    """``part, n, one, two``: the rows by a hash of all their columns, with their number and two sums of hashes, whatever their order."""
    # a null is told apart by a flag beside it, as hashes pass over nulls
    flagged = [x for c in rows.columns for x in (F.col(c), F.col(c).isNull())]
    hashes = [F.xxhash64(F.lit(seed), *flagged) for seed in range(3)]
    hashed = rows.select(F.pmod(hashes[0], F.lit(parts)).alias("part"), *(h.cast("decimal(20,0)").alias(n) for h, n in zip(hashes[1:], ("one", "two"))))
    return hashed.groupBy("part").agg(F.count("*").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"))


def differences(a: DataFrame, b: DataFrame, parts: int = 4096) -> DataFrame:
    """Rows that one of two runs has and the other hasn't, each as often as it is too many.

    The runs are compared by the fingerprints of ``parts`` parts of their rows; only parts that differ are opened, so runs that
    agree are read once each and no row is shuffled.
    """
    b = b.select(*a.columns)
    left, right = fingerprints(a, parts), fingerprints(b, parts).select(F.col("part").alias("of"), F.struct("n", "one", "two").alias("other"))
    both = left.join(right.hint("merge"), F.col("part") == F.col("of"), "full").where(~F.struct("n", "one", "two").eqNullSafe(F.col("other")) | F.col("part").isNull() | F.col("of").isNull())
    unlike = [r[0] for r in both.select(F.coalesce("part", "of")).collect()]  # ``parts`` of them at most
    part = F.pmod(F.xxhash64(F.lit(0), *[x for c in a.columns for x in (F.col(c), F.col(c).isNull())]), F.lit(parts))
    a, b = a.where(part.isin(unlike)), b.where(part.isin(unlike))
    return a.exceptAll(b).withColumn("run", F.lit("first")).unionByName(b.exceptAll(a).withColumn("run", F.lit("second")))


def same_metric(a: Column, b: Column, within: float = 1e-9) -> Column:
    return (F.isnan(a) & F.isnan(b)) | (~F.isnan(a) & ~F.isnan(b) & (F.abs(a - b) <= within))


def mean_ignoring_nan(x: Column) -> Column:
    return F.coalesce(F.avg(F.when(~F.isnan(x), x)), F.lit(float("nan")))
