"""Answer checks: citations, claims, faithfulness, the gate, and spans to highlight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence tiers in order (fixed values).
TIERS = ("très faible", "faible", "moyenne", "élevée")
CONFIDENT = TIERS[2:]


def citations(answer: Column) -> Column:
    """Ids in square brackets (the pattern is a fixed value), split at commas and semicolons, trimmed, each once, in order."""
    bodies = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[([^\[\]]+)\]"), F.lit(1))
    parts = F.flatten(F.transform(bodies, lambda b: F.split(b, "[,;]")))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def ground_quote(quote: Column, answer: Column) -> Column:
    """The quote as the answer has it: exact, else in the answer's own casing, else null."""
    q = F.trim(quote)
    at = F.instr(F.lower(answer), F.lower(q))
    return F.when((q == "") | q.isNull(), F.lit(None).cast("string")).when(answer.contains(q), q).when(at > 0, F.substr(answer, at, F.length(q)))


def structure(cited: Column, evidence: Column) -> dict[str, Column]:
    unknown = F.array_except(cited, evidence)
    return {"unknown": unknown, "has_citation": F.size(cited) > 0, "passed": (F.size(cited) > 0) & (F.size(unknown) == 0)}


#: Labels of judgments (fixed values).
LABELS = ("pertinent", "partiellement pertinent", "non pertinent")


def parse_judgment(raw: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """Label and justification from the text between the first ``{`` and the last ``}``, with a validity flag in place of an error."""
    body = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), "label string, justification string")
    why = F.trim(body["justification"])
    ok = F.coalesce(body["label"].isin(*labels) & (why != ""), F.lit(False))
    return F.struct(F.when(ok, body["label"]).alias("label"), F.when(ok, why).alias("justification"), ok.alias("valid"))


def sentences(text: Column) -> Column:
    """Offline claims: sentences, cut after a full stop, exclamation or question mark or at a line end, trimmed."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def claim_verdicts(claims: DataFrame, evidence_terms: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Offline verifier: a claim is supported if the evidence holds at least ``threshold`` of its distinct tokens.

    ``claims(answer_id, pos, tokens)``, ``evidence_terms(answer_id, token)`` with each token once.
    """
    words = claims.select("answer_id", "pos", F.explode_outer("tokens").alias("token"))
    found = words.join(evidence_terms.withColumn("here", F.lit(1)).hint("merge"), ["answer_id", "token"], "left")
    share = found.groupBy("answer_id", "pos").agg((F.count("here") / F.greatest(F.count("token"), F.lit(1))).alias("share"))
    return share.withColumn("supported", F.col("share") >= threshold)


def faithfulness(verdicts: DataFrame, answers: DataFrame) -> DataFrame:
    """Share of supported claims for each answer; NaN and no claims where there are none."""
    sums = verdicts.groupBy("answer_id").agg(F.avg(F.col("supported").cast("int")).alias("score"), F.count("*").alias("n_claims"), F.count_if(~F.col("supported")).alias("n_unsupported"))
    out = answers.join(sums.hint("merge"), "answer_id", "left")
    return out.withColumns({"score": F.coalesce("score", F.lit(float("nan"))), "n_claims": F.coalesce("n_claims", F.lit(0)), "n_unsupported": F.coalesce("n_unsupported", F.lit(0))})


def auto_expand(tier: Column, n_unsupported: Column) -> Column:
    """A confident tier and no unsupported claim; citations aren't part of the gate."""
    return tier.isin(*CONFIDENT) & (n_unsupported == 0)


def highlight(quotes: DataFrame) -> DataFrame:
    """``answer_id, start, end``: first case-insensitive place of each quote, longest quotes first, without overlaps.

    ``quotes(answer_id, answer, quote)``.  The fold runs over one answer's quotes.
    """
    lower = F.lower("answer")
    found = quotes.where("quote is not null and quote <> ''").select("answer_id", (F.instr(lower, F.lower("quote")) - 1).alias("start"), F.length("quote").alias("size")).where("start >= 0")
    rows = found.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), F.col("start"), (F.col("start") + F.col("size")).alias("end")))).alias("rows"))
    empty = F.expr("cast(array() as array<struct<order:int,start:int,end:int>>)")
    kept = F.aggregate("rows", empty, lambda acc, x: F.when(F.exists(acc, lambda k: (x["start"] < k["end"]) & (k["start"] < x["end"])), acc).otherwise(F.concat(acc, F.array(x))))
    return rows.select("answer_id", F.explode(kept).alias("k")).select("answer_id", F.col("k.start").alias("start"), F.col("k.end").alias("end"))
