"""Near duplicates by SimHash and multi-index hashing.

Fingerprints are 64 bits over shingles of words.  Two of them within
``distance`` bits agree up to ``distance // segments`` bits in one of their
segments, so every distinct fingerprint enumerates that small Hamming ball in
each segment, fetches what the segment's table holds at those keys, and the
whole distance of what was fetched is verified.  With the default two segments
of 32 bits that is 66 keys for each fingerprint and nearly empty buckets.

Copies share one fingerprint and are linked through it: only distinct
fingerprints are probed.

Defined results: a null text is empty; a text without words has fingerprint
zero and is linked like any other; a component of rows without ids has a null
id; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetgauge.llm.components import components
from fleetgauge.llm.tables import stored, texts

SEED = 42
BITS = 64
_AT_ONCE = 255 * 256  # shingles hashed at once, a multiple of what a byte can count


def fingerprint(text: bytes, words: int = 3) -> int:
    """Unsigned SimHash of a UTF-8 text: a bit is set if it is set in over half of its shingles' hashes."""
    from xxhash import xxh64_intdigest

    run = text.lower().split()  # A-Z to lower case, ASCII white space apart
    if not run:
        return 0
    shingles = map(b" ".join, zip(*(run[i:] for i in range(words)))) if len(run) >= words else iter([b" ".join(run)])
    total = max(1, len(run) - words + 1)
    hashes = map(xxh64_intdigest, shingles, repeat(SEED))
    counts = np.zeros(BITS, np.int64)
    for _ in range(0, total, _AT_ONCE):
        part = np.fromiter(islice(hashes, _AT_ONCE), "<u8")
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, BITS)
        for i in range(0, len(bits), 255):
            counts += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp``: the fingerprint as a signed long, ``text_hash`` to tell apart rows of one id."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, words) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            fp = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.record_batch([batch.column(0), batch.column(1), fp], names=["doc_id", "text_hash", "fp"])

    rows = texts(docs).selectExpr("doc_id", "xxhash64(text) AS text_hash", "text")
    return rows.mapInArrow(hashed, "doc_id long, text_hash long, fp long")


def links(nodes: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """Pairs ``a < b`` of different fingerprints (column ``fp``) within ``distance`` bits."""
    width = BITS // segments
    radius = distance // segments
    masks = _ball(width, radius)
    every = ", ".join(str(s) for s in range(segments))
    cut = f"shiftrightunsigned(fp, segment * {width}) & {(1 << width) - 1}L"
    keyed = nodes.selectExpr("fp", f"explode(array({every})) AS segment").selectExpr("fp", "segment", f"{cut} AS key")
    ball = ", ".join(f"{m}L" for m in masks)
    probes = keyed.selectExpr("fp AS a", "segment", f"explode(transform(array({ball}), m -> key ^ m)) AS key")
    table = keyed.selectExpr("fp AS b", "segment", "key")
    near = F.expr(f"a < b AND bit_count(a ^ b) <= {distance}")
    return probes.join(table, ["segment", "key"]).where(near).select("a", "b")


def _ball(width: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` bits out of ``width``."""
    masks = [0]
    for _ in range(radius):
        masks = list(dict.fromkeys(chain(masks, (m | 1 << i for m in masks for i in range(width)))))
    return masks


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, segments: int = 2) -> DataFrame:
    """``doc_id, text_hash, fp, root, component_id``: one row per document.

    ``component_id`` is the smallest ``doc_id`` that links lead to, ``root``
    the smallest fingerprint.
    """
    # Fingerprints are read for the nodes and for the result: computed once.
    rows = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = components(links(nodes, distance, segments)).withColumnRenamed("node", "fp")
    rooted = nodes.join(found, "fp", "left").selectExpr("fp", "first", "coalesce(root, fp) AS root")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # Stored, so that both sides of the last join come from their own shuffle and a hot fingerprint can be split.
    named = stored(rooted.join(least, "root").select("fp", "root", "component_id"), "components")
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def hex_of(fp: str) -> str:
    """SQL of a fingerprint as 16 lowercase hexadecimal digits."""
    return f"lower(lpad(hex({fp}), 16, '0'))"
