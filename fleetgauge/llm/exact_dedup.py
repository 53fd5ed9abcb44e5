"""Exact duplicates: group by a 128-bit content hash, compare bytes inside the groups.

Grouping on ``(digest, text)`` hashes by the digest and tells two texts of one
digest apart by their bytes.  Every task first folds its own copies, so a
group of any size reaches the shuffle as one row per task.

Defined results: a null text is the empty text.  Of equal texts the row with
the largest ``doc_id`` stays, a null id being the smallest; rows that repeat
the id and the text of the one that stays are reported as kept too, and
:func:`distinct_texts` returns one of them.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetgauge.llm.tables import texts


def content_hash(text: Column) -> Column:
    """128 bits of a text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, digest=content_hash) -> DataFrame:
    """For every document the row that stays, the group's size and the text's SHA-256.

    Classes are found on bytes.  A document is then led to its class by two
    digests, which are narrow and never sent with the text; Spark splits the
    join where a class is hot.
    """
    source = texts(docs).withColumns({"digest": digest(F.col("text")), "text_sha256": F.sha2("text", 256)})
    classes = (
        source.groupBy("digest", "text")
        .agg(F.max("doc_id").alias("keep_id"), F.expr("count(*) AS group_size"))
        .select("digest", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    return (
        source.select("doc_id", "digest", "text_sha256")
        .join(classes, ["digest", "text_sha256"])
        .selectExpr("doc_id", "keep_id", "group_size", "doc_id <=> keep_id AS kept", "text_sha256")
    )


def distinct_texts(docs: DataFrame, digest=content_hash) -> DataFrame:
    """The rows that stay, with all their columns and one for each text."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    # The row in the order: ties of doc_id are decided by the other columns.
    order = F.struct(F.col("doc_id"), *(F.col(f"`{f.name}`") for f in _sortable(docs) if f.name != "doc_id"))
    return (
        docs.select(F.coalesce("text", F.lit("")).alias("key"), order.alias("position"), row)
        .groupBy(digest(F.col("key")).alias("digest"), "key")
        .agg(F.expr("max_by(row, position)").alias("row"))
        .select("row.*")
    )


def _sortable(docs: DataFrame):
    return [f for f in docs.schema if f.dataType.typeName() not in ("map", "variant") and f.name != "text"]
