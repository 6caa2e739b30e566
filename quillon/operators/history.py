"""Conversation history as keyed merges of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.ranks import fresh, ranked
from quillon.sources import files


def resolve_turns(requests: DataFrame, turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``request_id, status, conversation_id, turn_id`` for ``requests(request_id, turn_id, conversation_id)``.

    A turn that is given and known is taken; else a known conversation gets a new turn; without either both are new; an
    unknown id is rejected.  New ids follow the largest ones in the order of requests.
    """
    t = turns.select(F.col("turn_id").alias("known_turn"), F.col("conversation_id").alias("turn_conversation"))
    c = conversations.select(F.col("conversation_id").alias("known_conversation"))
    top = turns.agg(F.coalesce(F.max("turn_id"), F.lit(0)).alias("top_turn")).crossJoin(F.broadcast(conversations.agg(F.coalesce(F.max("conversation_id"), F.lit(0)).alias("top_conversation"))))  # one row each
    r = requests.join(t, requests["turn_id"] == t["known_turn"], "left").join(c, requests["conversation_id"] == c["known_conversation"], "left")
    given, in_conversation = F.col("turn_id").isNotNull(), F.col("conversation_id").isNotNull()
    status = (
        F.when(given & F.col("known_turn").isNull(), "rejected").when(given, "existing")
        .when(in_conversation & F.col("known_conversation").isNull(), "rejected").when(in_conversation, "new_turn").otherwise("new_conversation")
    )
    r = files.staged(r.select("request_id", status.alias("status"), F.coalesce("turn_conversation", "known_conversation").alias("conversation_id"), F.col("known_turn").alias("turn_id")), "requests")
    turns_new = ranked(r.where(F.col("status").isin("new_turn", "new_conversation")).select("request_id"), ["request_id"], name="turn_no")
    conv_new = ranked(r.where("status = 'new_conversation'").select("request_id"), ["request_id"], name="conversation_no")
    out = r.join(turns_new, "request_id", "left").join(conv_new, "request_id", "left").crossJoin(F.broadcast(top))
    rejected = F.col("status") == "rejected"
    return out.select(
        "request_id", "status",
        F.when(~rejected, F.coalesce("conversation_id", F.col("top_conversation") + F.col("conversation_no"))).alias("conversation_id"),
        F.when(~rejected, F.coalesce("turn_id", F.col("top_turn") + F.col("turn_no"))).alias("turn_id"),
    )


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` without the keys that ``new`` has, and ``new``: sets are replaced whole."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with rows of ``new`` in place of those with their keys, as one query; the same ``new`` again changes nothing.

    Of rows of ``new`` with one key the greatest in its other columns counts.  A table that is kept is changed by ``KeyedTable``.
    """
    rest = [c for c in new.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("row")).select(*keys, *(F.col(f"row.`{c}`").alias(c) for c in rest)) if rest else new.distinct()
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def with_parent(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose parent exists."""
    return rows.join(parents.select(key).distinct(), key, "left_semi")


def found_or_rejected(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    mark = fresh(ids, "mark")
    return ids.join(known.select(key, F.lit(True).alias(mark)).distinct(), key, "left").withColumn("found", F.coalesce(mark, F.lit(False))).drop(mark)


def first_of(rows: DataFrame, key: str, value: str, order: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(value, order).alias(name))


def renamed(rows: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` from ``updates`` where the key has one."""
    new = fresh(rows, "new")
    return rows.join(updates.select(key, F.col(column).alias(new)), key, "left").withColumn(column, F.coalesce(new, column)).drop(new)


def cascade(tables: dict[str, DataFrame], chain: list[tuple[str, str]], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table of ``chain`` (name, key) without the rows that hang on the keys in ``gone``."""
    return {name: tables[name].join(gone.select(key).distinct(), key, "left_anti") for name, key in chain}


def tier_of(score: Column) -> Column:
    """Confidence tier of the best rerank score; "moyenne" where nothing was reranked."""
    return F.when(score.isNull(), "moyenne").when(score < 0.28, "très faible").when(score < 0.42, "faible").when(score < 0.55, "moyenne").otherwise("élevée")


def backfilled(rows: DataFrame, children: DataFrame, key: str, column: str, otherwise: str = "unknown") -> DataFrame:
    """``rows`` with a new required column, from the child table or ``otherwise``."""
    return rows.join(children.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(otherwise)))
