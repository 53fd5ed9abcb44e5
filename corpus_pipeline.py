"""The corpus pipeline: documents in, packed training sequences out.

Every stage works on all documents the one before kept and writes its result
to the shared folder, where the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetgauge.llm import exact_dedup, language, minhash, packing, pii
from fleetgauge.llm.components import first_of_each
from fleetgauge.llm.tables import stored, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CAPACITY = 4096
# A document goes if the language that holds most of its letters holds less of them than this.
LEAST_SHARE = 0.2


def in_a_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a script that the labelled ones teach; those mostly in others, and those without a letter, go.

    A language that nobody labelled stays if its script is known, and so do code and gibberish.
    """
    model = language.learn(docs)
    if not model.languages:  # nothing to judge by
        return docs.where(r"text RLIKE '\\p{L}'")
    kept = language.identify(docs, model).where(F.col("language.score") >= LEAST_SHARE)
    return kept.select("row.*")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.distinct_texts(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts linked by a five-word Jaccard similarity of 0.8 or more."""
    return first_of_each(docs, minhash.near_copies(docs))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack_documents(docs, packing.read_tokenizer(TOKENIZER), CAPACITY)


STAGES = [
    ("language", in_a_known_language),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("personal data", without_personal_data),
    ("packing", packed),
]

# Language models, fingerprints and tokenizers cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of a directory."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
