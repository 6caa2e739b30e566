"""Evidence signals, confidence tiers and prompts for whole tables of evidence sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.checks import CONFIDENT, TIERS
from quillon.operators.history import tier_of

CONVERGENT = 0.55
#: Bytes of vectors in one broadcast, and broadcasts at most; lines of evidence in one task.
BLOCK_BYTES, BLOCKS, TASK_LINES = 64 << 20, 16, 500_000

#: Default templates; all are parameters of ``build_prompt``.
TEMPLATES = {
    "instructions": "# Consignes", "evidence": "# Extraits", "question": "# Question",
    "cite": "Appuie chaque affirmation sur un extrait et cite son identifiant entre crochets.",
    "frame": "Présente les extraits comme des propos de leur auteur.",
    "one_work": "Tous les extraits viennent d'un seul ouvrage.",
    "converging": "Les extraits viennent de plusieurs ouvrages qui se rejoignent.",
    "diverging": "Les extraits viennent de plusieurs ouvrages qui divergent: distingue-les.",
    "caution": "Les extraits répondent mal à la question: dis-le.",
    "judged": "Tiens compte de l'avis donné sur certains extraits.",
}


def works_of(evidence: DataFrame, key: str = "set_id", *more: Column) -> DataFrame:
    """Sorted distinct works of each evidence set, their number, whether there are several, and ``more`` aggregates."""
    w = evidence.groupBy(key).agg(F.array_sort(F.collect_set("work_id")).alias("works"), *more)
    rest = [c for c in w.columns if c not in (key, "works")]
    return w.select(key, "works", F.size("works").cast("bigint").alias("num_works"), (F.size("works") > 1).alias("is_multi_work"), *rest)


def convergence(evidence: DataFrame, vectors: DataFrame, key: str = "set_id") -> DataFrame:
    """Mean cosine over the unordered pairs of each set's entries that have a vector; no row for sets with fewer than two.

    ``evidence(set_id, pos, chunk_id)``, ``vectors(chunk_id, vector)``.  Unit vectors are summed, so pairs are never formed: the
    sum over pairs of their products is half of (squared length of the sum, less the number of vectors).  A vector of zeros,
    which has no direction, has cosine 0 with every other.
    """
    norm = F.sqrt(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    given = vectors.where("vector is not null").select("chunk_id", F.struct("vector", norm.alias("norm")).alias("v"))
    n_vectors, dims = given.agg(F.count("*"), F.coalesce(F.max(F.size("v.vector")), F.lit(0))).first()
    met = _with_vectors(evidence.select(key, "chunk_id"), given, math.ceil(n_vectors / max(BLOCK_BYTES // (8 * dims + 64), 1)), key)
    unit = lambda k: F.coalesce(F.try_divide(F.get("v.vector", F.lit(k)).cast("double"), F.col("v.norm")), F.lit(0.0))
    parts = [F.sum(unit(k)).alias(f"s{k}") for k in range(dims)]
    sums = met.groupBy(key).agg(*parts, F.sum((F.col("v.norm") > 0).cast("bigint")).alias("real"), F.count("*").alias("n"))
    square = F.aggregate(F.array(*[F.coalesce(f"s{k}", F.lit(0.0)) for k in range(dims)], F.lit(0.0)), F.lit(0.0), lambda s, x: s + x * x)
    return sums.where("n > 1").select(key, ((square - F.col("real")) / (F.col("n") * (F.col("n") - 1))).alias("convergence"))


def _with_vectors(lines: DataFrame, given: DataFrame, blocks: int, key: str) -> DataFrame:
    """``key, v`` of the lines that have a vector, all lines of a set in one partition.

    Only ids are shuffled: the lines go to their sets first, and the vectors come to them in ``blocks`` broadcasts, each bounded in
    bytes.  For more than ``BLOCKS`` of them lines and vectors are joined by a shuffle, and the vectors go on to the sets as they are.
    """
    if blocks > BLOCKS:
        return lines.join(given.hint("merge"), "chunk_id").select(key, "v").repartition(key)
    # a task's sums are 64 doubles for each of its sets, so the partitions follow the lines
    tasks = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines.count() // TASK_LINES)
    out = lines.where("chunk_id is not null").repartition(tasks, key)
    for b in range(blocks):
        part = given.where(F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)) == b).select(F.col("chunk_id").alias(f"id{b}"), F.col("v").alias(f"v{b}"))
        out = out.join(F.broadcast(part), F.col("chunk_id") == F.col(f"id{b}"), "left").drop(f"id{b}")
    none = F.lit(None).cast(given.schema["v"].dataType)
    return out.select(key, F.coalesce(*(f"v{b}" for b in range(blocks)), none).alias("v")).where("v is not null")


def is_convergent(c: Column) -> Column:
    return F.coalesce(F.round(c, 9) >= CONVERGENT, F.lit(True))


def signals(evidence: DataFrame, vectors: DataFrame, key: str = "set_id") -> DataFrame:
    """Works, convergence, best rerank score, tier and the flags that follow, a row for each evidence set."""
    out = works_of(evidence, key, F.max("rerank_score").alias("max_rerank")).join(convergence(evidence, vectors, key).hint("merge"), key, "left")
    out = out.withColumn("tier", tier_of(F.round("max_rerank", 6)))
    return out.withColumns({"is_convergent": is_convergent(F.col("convergence")), "is_confident": F.col("tier").isin(*CONFIDENT)})


def gauge(tier: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), tier)


def included(toggles: DataFrame, keys: list[str]) -> DataFrame:
    """Entries are in until toggled: an even number of toggles leaves them in."""
    return toggles.groupBy(*keys).agg((F.count("*") % 2 == 0).alias("included"))


def evidence_block(chunk_id: Column, work: Column, path: Column, pages: Column, text: Column, judgment: Column) -> Column:
    head = F.concat(F.lit("["), chunk_id, F.lit("] ("), work, F.lit(", "), path, F.lit(", p. "), pages, F.lit(")\n"), text)
    return F.when(judgment.isNull(), head).otherwise(F.concat(head, F.lit("\n(avis: "), judgment, F.lit(")")))


def evidence_text(blocks: DataFrame, key: str = "set_id") -> DataFrame:
    """All blocks of a set, in order; under a heading for each work, in order of works, if there are several.

    ``blocks(set_id, pos, work_id, block)``.  One set's blocks meet, which is as many as were retrieved for one question.
    """
    by_work = blocks.groupBy(key, "work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n\n").alias("body"))
    listed = by_work.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("work_id", "body"))).alias("parts"))
    several = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("=== "), p["work_id"], F.lit(" ===\n\n"), p["body"])), "\n\n")
    return listed.select(key, F.when(F.size("parts") > 1, several).otherwise(F.element_at("parts", 1)["body"]).alias("evidence"))


def instructions(is_multi: Column, convergent: Column, confident: Column, judged: Column, t: dict[str, str] = TEMPLATES) -> Column:
    works = F.when(~is_multi, t["one_work"]).when(convergent, t["converging"]).otherwise(t["diverging"])
    lines = F.array(F.lit(t["cite"]), F.lit(t["frame"]), works, F.when(~confident, t["caution"]), F.when(judged, t["judged"]))
    return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")


def prompt(instruction: Column, evidence: Column, question: Column, t: dict[str, str] = TEMPLATES) -> Column:
    return F.concat_ws("\n\n", F.lit(t["instructions"]), instruction, F.lit(t["evidence"]), evidence, F.lit(t["question"]), question)


def judge_prompt(question: Column, passage: Column, head: str = "L'extrait répond-il à la question ? Réponds en JSON: label, justification.") -> Column:
    return F.concat_ws("\n\n", F.lit(head), F.concat(F.lit("Question: "), question), F.concat(F.lit("Extrait: "), passage))
