"""A training corpus from ``documents``: clean, deduplicate, decontaminate, pseudonymise, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and reread as the next stage's docs.  All stages but the last return the columns of
their docs; other columns than doc_id and text pass through, whatever their names.
Empty docs pass every stage; what becomes of null and repeated rows is in the operators'
docstrings.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspark.llm import decontaminate, near_copies, packing, pseudonyms, quality, queries
from dwellspark.llm.shared import new_path


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names (any case) renamed, and the way back."""
    back = {f"__kept_{c}": c for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed({c: k for k, c in back.items()}), back


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    field = queries.fitted(spark, docs, sf_dir)
    aside, back = _aside(docs, "score", "n_lines", "bad_lines")
    return quality.score(aside, field).filter("score >= 0.3").drop("score", "n_lines", "bad_lines").withColumnsRenamed(back)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates."""
    return near_copies.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.remove_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for personal data; n_chars follows the new text."""
    aside, back = _aside(docs, "pii_found")
    out = pseudonyms.pseudonymise(aside, queries.pseudonym_key(spark)).drop("pii_found").withColumnsRenamed(back)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: a row per piece of a document, with its ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1, 2048)


STAGES = [("quality", classify), ("near_duplicates", deduplicate), ("decontamination", decontaminated), ("pii", pseudonymised), ("packing", packed)]

#: Not expressible: the stages fit a model, hash shingles and call a tokenizer library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
