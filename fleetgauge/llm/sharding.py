"""Shards by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order of ``(hash(doc_id), doc_id)``, which no
partitioning can change.  A keyed permutation of the numbers gives every row
its place in the shuffle; place modulo shards is the shard and place divided
by shards the slot, so shards differ by one row at most and slots have no gap.
Anyone who has a row number computes shard and slot without the data.

Defined results: a null text has no bytes, a null ``doc_id`` is the smallest.
Rows that repeat an id are numbered by size and checksum; rows that agree in
those as well are interchangeable.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetgauge.llm.tables import texts

ROW_BYTES = 8  # fixed value: bytes a row takes beside its text
ROUNDS = 6
# Rows are numbered bucket by bucket.  The buckets are the leading bits of the
# hash, so their number does not show in the result, and their table is bounded.
_BUCKET_BITS = 14


def row_numbers(rows: DataFrame, ties: list[str]) -> DataFrame:
    """Add ``row_number`` (0..N-1 over all rows) and ``total`` (N) to rows with a ``doc_id``."""
    hashed = F.xxhash64("doc_id")
    bucket = F.shiftrightunsigned(hashed, 64 - _BUCKET_BITS).alias("bucket")
    # 2 ** _BUCKET_BITS rows at most: one task sums them and a broadcast takes them.
    starts = (
        rows.groupBy(bucket)
        .agg(F.expr("count(*) AS n"))
        .selectExpr("bucket", "sum(n) OVER (ORDER BY bucket) - n AS start", "sum(n) OVER () AS total")
    )
    placed = rows.select("*", hashed.alias("hash"), bucket)
    inside = f"row_number() OVER (PARTITION BY bucket ORDER BY hash, {', '.join(['doc_id', *ties])}) - 1"
    return (
        placed.selectExpr("*", f"{inside} AS inside")
        .join(F.broadcast(starts), "bucket")
        .withColumn("row_number", F.col("start") + F.col("inside"))
        .drop("bucket", "hash", "start", "inside")
    )


def feistel(number: str, side: str, seed: int, rounds: int = ROUNDS) -> str:
    """SQL of one pass through the network, a permutation of 0..side*side-1."""
    return (
        f"aggregate(sequence(0, {rounds - 1}), struct({number} div {side} AS l, {number} % {side} AS r),"
        f" (s, k) -> struct(s.r AS l, pmod(s.l + pmod(xxhash64(s.r, {seed}, k), {side}), {side}) AS r),"
        f" s -> s.l * {side} + s.r)"
    )


def shuffled(numbered: DataFrame, seed: int) -> DataFrame:
    """Add ``place``, a permutation of ``row_number`` within 0..total-1.

    The network permutes the smallest square that holds ``total``.  A number
    that lands in the surplus walks on until it falls below ``total``, which
    takes no more steps than the surplus has members; of n rows some 2/sqrt(n)
    walk at all.
    """
    root = "CAST(ceil(sqrt(CAST(total AS DOUBLE))) AS BIGINT)"
    walk = (
        f"IF(first < total, first, aggregate(sequence(CAST(1 AS BIGINT), side * side - total), first,"
        f" (p, i) -> IF(p < total, p, {feistel('p', 'side', seed)})))"
    )
    return (
        numbered.selectExpr("*", f"{root} AS root")
        .selectExpr("*", "IF(root * root < total, root + 1, root) AS side")
        .selectExpr("*", f"{feistel('row_number', 'side', seed)} AS first")
        .selectExpr("*", f"{walk} AS place")
        .drop("root", "side", "first")
    )


def shard(docs: DataFrame, shards: int = 24, seed: int = 20240601) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``row_number``, ``shard`` and ``slot`` of every document.

    Only these narrow columns are shuffled, the text never is.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows = texts(docs).selectExpr(
        "doc_id", f"CAST(octet_length(text) + {ROW_BYTES} AS BIGINT) AS size", "crc32(text) AS text_crc32"
    )
    numbered = row_numbers(rows, ["size", "text_crc32"])
    return shuffled(numbered, seed).selectExpr(
        "doc_id",
        "size",
        "text_crc32",
        "row_number",
        f"CAST(place % {shards} AS INT) AS shard",
        f"place div {shards} AS slot",
    )
