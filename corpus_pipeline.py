"""The corpus pipeline: language ID, exact deduplication, n-gram Jaccard join, benchmark decontamination, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept; all but the last return the columns of
documents. Between stages `run` writes Parquet in the shared folder and reads it again, so a lost executor costs tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing
from tidemark.llm.queries import read, tokenizer
from tidemark.llm.workspace import Workspace


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose text is null or has no letter, which get no language; keeps all others (and all columns as they are)."""
    model = language_id.train(docs)
    columns = docs.columns
    named = docs.withColumns({f"__{c}": F.col(f"`{c}`") for c in ("lang_pred", "score") if c in columns})
    kept = language_id.predict(named, model).filter(F.col("lang_pred") != language_id.UNKNOWN)
    return kept.select(*[F.col(f"`__{c}`").alias(c) if f"__{c}" in kept.columns else F.col(f"`{c}`") for c in columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of equal texts."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: SQL has neither the language model nor the tokenizer; tests/llm/test_pipeline.py holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    ws = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = ws.table(docs, name)
            if k:
                ws.drop(STAGES[k - 1][0])
    return docs
