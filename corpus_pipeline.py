"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontamination, language, packing, simhash, substrings
from quillon.llm.common import documents, fresh, staged, vocabulary

#: A document stays if one language holds this share of it.
LEAST_SHARE = 0.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a letter, and those in which no language holds half, go.

    Null and empty texts have no letter and go; repeated rows go or stay together; a very long text is judged whole; of two
    languages that hold exactly half each the first by name decides, and the text stays; an empty table stays empty.  A working
    column takes a name that ``docs`` doesn't have.
    """
    model = language.learn(language.learned_from(docs))
    found = fresh(docs, "language")
    out = language.identified(docs, model, name=found)
    return out.where((F.col(found)["lang_pred"] != "und") & (F.col(found)["score"] >= LEAST_SHARE)).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of every group of near copies, five-word Jaccard similarity of 0.8, one document stays.

    Which one, and what becomes of null and empty texts (one stays), ids that are null or equal, very long texts, empty tables
    and clashing columns, is stated by ``simhash.without_near_copies``.
    """
    return simhash.without_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: repeated passages leave the texts; a document of which nothing is left goes.

    A text without a repeat stays as it is, null, empty and very long ones too; a text that loses words is joined by single
    spaces, and ``n_chars``, if there is such a column, follows.  Repeated rows of 35 words or more lose all and go.  An empty
    table stays empty.  Columns ``n_words``, ``n_removed`` and ``kept_text`` of ``docs`` are carried around the stage unchanged.
    """
    # columns that are named like the operator's own are set aside
    aside = {c: fresh(docs, f"own_{c}") for c in docs.columns if c in ("n_words", "n_removed", "kept_text")}
    out = substrings.without_repeats(docs.withColumnsRenamed(aside)).where((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    changed = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark passage, four fifths of an item's five-word shingles, go.

    Null and empty texts stay; repeated rows go or stay together; very long texts are searched whole; ties don't arise; an empty
    table, or one without items, stays as it is; working columns take names that ``docs`` doesn't have.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of sequences that hold all tokens of the documents left.

    Null and empty texts are one end token; a very long text is cut into pieces; repeated rows are packed each for itself; equal
    lengths go in the order they are read; an empty table gives no pieces; other columns aren't read.
    """
    return packing.packed(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify),
    ("simhash_near_dedup", keep_one_of_each),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", decontaminate),
    ("packing", pack),
]

#: Language identification, SimHash and packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written out and read back before the next."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
