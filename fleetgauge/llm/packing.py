"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents become pieces of at most ``capacity`` tokens.  The plan is made on
the histogram of piece lengths (:mod:`fleetgauge.llm.packing_plan`), which has
no more entries than the capacity.  Pieces of one length are numbered, and the
plan turns a number into a sequence and an offset by arithmetic, so neither a
length nor a sequence is ever gathered in one place.

Defined results: a null text is empty and consists of the closing id alone; a
repeated row is packed as often as it occurs; an empty table gives an empty
one.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetgauge.llm.packing_plan import Pattern, plan
from fleetgauge.llm.tables import stored, texts
from fleetgauge.llm.tokens import RunIds

# Pieces of one length are numbered in as many parts; the result does not depend on it.
_PARTS = 256
_RANKS = 1 << 48  # more than the pieces of one length


@functools.lru_cache(maxsize=1)
def _run_ids(tokenizer_json: str) -> RunIds:
    return RunIds(tokenizer_json)


def token_pieces(
    docs: DataFrame, tokenizer_json: str, capacity: int = 4096, closing_id: int = 1, keep_ids: bool = False
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, with ``keep_ids``, the ids as bytes.

    Ids are little-endian unsigned 32-bit integers; a document ends with ``closing_id``.
    """
    tokenizer = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    closing = struct.pack("<I", closing_id)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_ids = _run_ids(tokenizer.value)
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + keep_ids]
        for batch in batches:
            columns: list[list] = [[] for _ in types]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ids = run_ids.of_text(text) + closing
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part)
                    for column, value in zip(columns, row):
                        column.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=schema_names)

    schema_names = [part.split()[0] for part in schema.split(", ")]
    return texts(docs).mapInArrow(cut, schema)


def _places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each run of numbers of a length: where it starts, its first sequence, items per sequence, first offset."""
    rows, numbered, sequence = [], {}, 0
    for items, bins in patterns:
        offset = 0
        for length, copies in items:
            start = numbered.get(length, 0)
            rows.append((length * _RANKS + start, sequence, copies, offset))
            numbered[length] = start + copies * bins
            offset += length * copies
        sequence += bins
    key, base, copies, offset = np.array(sorted(rows), "int64").reshape(-1, 4).T
    return {"key": key, "base": base, "copies": copies, "offset": offset}


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces with ``doc_id, piece, length, ids_crc32``."""
    # At most ``capacity`` rows.
    found = pieces.groupBy("length").count().collect()
    counts = np.zeros(capacity + 1, "int64")
    for row in found:
        counts[row["length"]] = row["count"]
    places = pieces.sparkSession.sparkContext.broadcast(_places(plan(counts, capacity)))

    parted = pieces.withColumn("part", F.expr(f"pmod(xxhash64(doc_id, piece), {_PARTS})"))
    starts = (
        parted.groupBy("length", "part")
        .agg(F.expr("count(*) AS n"))
        .selectExpr("length", "part", "sum(n) OVER (PARTITION BY length ORDER BY part) - n AS before")
    )
    inside = "row_number() OVER (PARTITION BY length, part ORDER BY doc_id, piece, ids_crc32) - 1 AS inside"
    numbered = (
        parted.selectExpr("*", inside)
        .join(starts, ["length", "part"])
        .selectExpr(*pieces.columns, "before + inside AS number")
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            number = batch.column(batch.schema.get_field_index("number")).to_numpy(zero_copy_only=False)
            key = length * _RANKS + number
            at = np.searchsorted(table["key"], key, side="right") - 1
            nth = key - table["key"][at]
            sequence = table["base"][at] + nth // table["copies"][at]
            offset = table["offset"][at] + nth % table["copies"][at] * length
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.record_batch(
                [*kept, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"]
            )

    return numbered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_json: str, capacity: int = 4096) -> DataFrame:
    """Every piece of every document with its place."""
    # Read for the histogram, the numbering and the result: tokenised once.
    return pack(stored(token_pieces(docs, tokenizer_json, capacity), "pieces"), capacity)


def read_tokenizer(path: str) -> str:
    """A tokenizer's file, read by the driver and sent to the workers."""
    with open(path, encoding="utf-8") as file:
        return file.read()
