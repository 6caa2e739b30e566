"""Batch model inference: any function over Arrow batches, with a second pass for what failed, and offline stand-ins.

A scorer is a function ``factory() -> (list of prompts -> list of answers or exceptions)``: the factory runs once in each
task, so that a model is loaded once.  The stand-ins are deterministic and make no claim to a model's quality.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import checks as C
from quillon.sources import files

Factory = Callable[[], Callable[[list[str]], list]]


def infer(prompts: DataFrame, factory: Factory, model: str, key: str = "id") -> DataFrame:
    """``key, answer, model, error`` for ``prompts(key, prompt)``; a failure is a row, never the end of the job."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory()
        for pdf in it:
            out = call(pdf["prompt"].tolist())
            bad = [isinstance(x, Exception) for x in out]
            yield pd.DataFrame({key: pdf[key], "answer": [None if b else x for x, b in zip(out, bad)], "model": model, "error": [str(x) if b else None for x, b in zip(out, bad)]})

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {kind}, answer string, model string, error string")


def with_fallback(prompts: DataFrame, first: Factory, second: Factory, names: tuple[str, str] = ("primary", "fallback"), key: str = "id") -> DataFrame:
    """Every prompt by the first model; those that failed by the second; ``model`` says which one answered."""
    one = files.staged(infer(prompts, first, names[0], key), "inference")
    again = prompts.join(one.where("error is not null").select(key), key, "left_semi")
    return one.where("error is null").unionByName(infer(again, second, names[1], key))


def offline_writer() -> Callable[[list[str]], list]:
    """Offline generation: of each passage of a prompt (JSON of question and passages) the sentence that shares most words with the question, with the passage's id."""
    import json
    import re

    words = lambda x: set(re.findall(r"\w+", x.lower()))

    def answer(prompt: str) -> str:
        p = json.loads(prompt)
        asked, lines = words(p.get("question", "")), []
        for e in p["evidence"]:
            parts = [s.strip(" ") for s in re.split(r"[.!?\n]+", e.get("text", ""))]
            best = max((s for s in parts if s), key=lambda s: len(words(s) & asked), default="")
            lines.append(f"{best} [{e['chunk_id']}]")
        return "\n".join(lines)

    return lambda prompts: [answer(p) for p in prompts]


def written(evidence: DataFrame, factory: Factory = offline_writer, key: str = "query_id") -> DataFrame:
    """``key, answer`` of a model that is asked once for each key of ``evidence(key, rank, chunk_id, question, text)``, passages in rank order."""
    passages = F.array_sort(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))))
    asked = evidence.groupBy(key).agg(F.max("question").alias("question"), passages.alias("evidence"))
    prompts = asked.select(key, F.to_json(F.struct(F.coalesce("question", F.lit("")).alias("question"), "evidence")).alias("prompt"))
    return infer(prompts, factory, "writer", key).select(key, "answer")


def best_sentence(question: Column, text: Column) -> Column:
    """Offline generation: the sentence that shares most tokens with the question, the first of equals."""
    q = T.tokens(question)
    scored = F.transform(C.sentences(text), lambda s, i: F.struct((-F.size(F.array_intersect(T.tokens(s), q))).alias("n"), i.alias("i"), s.alias("s")))
    return F.element_at(F.concat(F.array_sort(scored), F.array(F.lit(None).cast("struct<n:int,i:int,s:string>"))), 1)["s"]


def extractive_answers(evidence: DataFrame, key: str = "query_id") -> DataFrame:
    """``key, answer`` from ``evidence(key, rank, chunk_id, question, text)``: best sentences, each with its chunk's id."""
    rows = evidence.select(key, "rank", F.concat(F.coalesce(best_sentence(F.col("question"), F.col("text")), F.lit("")), F.lit(" ["), F.col("chunk_id").cast("string"), F.lit("]")).alias("s"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"]), "\n").alias("answer"))


def judged(pairs: DataFrame, factory: Factory, corrected: str = "\nRéponds seulement en JSON.", key: str = "id") -> DataFrame:
    """Parsed judgments of ``pairs(key, prompt)``; broken outputs are asked for once more, then are errors."""
    parse = lambda df: df.withColumn("j", C.parse_judgment(F.coalesce("answer", F.lit("")))).select(key, "j.label", "j.justification", "j.valid")
    one = files.staged(parse(infer(pairs, factory, "judge", key)), "judgments")
    again = pairs.join(one.where("not valid").select(key), key, "left_semi").withColumn("prompt", F.concat("prompt", F.lit(corrected)))
    return one.where("valid").withColumn("attempts", F.lit(1)).unionByName(parse(infer(again, factory, "judge", key)).withColumn("attempts", F.lit(2)))


def overlap_judge() -> Callable[[list[str]], list]:
    """Offline judge: label by the share of the question's words that the passage has."""

    def call(prompts: list[str]) -> list:
        out = []
        for p in prompts:
            q, _, t = p.partition("\n\nExtrait: ")
            asked, there = set(q.lower().split()), set(t.lower().split())
            share = len(asked & there) / max(len(asked), 1)
            label = "pertinent" if share > 0.5 else "partiellement pertinent" if share > 0.2 else "non pertinent"
            out.append(f'{{"label": "{label}", "justification": "part commune {share:.2f}"}}')
        return out

    return call


def ranked_in(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("bigint"))
