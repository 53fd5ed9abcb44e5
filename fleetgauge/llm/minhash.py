"""Near duplicates by SimHash, completed by MinHash bands, every candidate verified.

A text is the set of its shingles, runs of five lower-cased words.  SimHash
fingerprints over those shingles that lie within ``DISTANCE`` bits are found
by multi-index hashing (:mod:`fleetgauge.llm.simhash`).  64 bits miss pairs
near the threshold, so MinHash completes them.  Two sets agree in a value with a probability equal to their Jaccard similarity
s, in a band of ``ROWS`` values with ``s ** ROWS``, and in none of ``BANDS``
bands with ``(1 - s ** ROWS) ** BANDS``: 2 in a million at 0.8.  Texts that
SimHash or a band brings together are compared by the exact similarity of
their sets before they are linked, so all that hashes decide is what is
compared.

Texts of one set are one node, known by two hashes of 64 bits.  A band that
many nodes agree in is not paired up: nodes are first compared with the
smallest and the largest of each band.  Those that these links leave in
different components meet by their rarest shingles (:func:`rarest`), so pages
of one template do not meet for what all of them share.  What is not compared
is in one component already, shares no rare shingle, has too few shingles left
behind the rare one, or differs by too much for its size in the parities of
shingles; the latter three prove that a pair is below the threshold, where
pairs are made, so they make no row.

Defined results: a null text is empty; a text of fewer than five words is one
shingle; texts without words have the empty set and are copies of each other;
an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetgauge.llm import simhash
from fleetgauge.llm.components import components
from fleetgauge.llm.tables import stored, texts

SEED = 42
WORDS = 5
# SimHash: bits in which fingerprints differ at most, and the segments they are cut into.
DISTANCE = 3
SEGMENTS = 2
LEAST = (4, 5)  # similarity from which texts are near copies, as a fraction
ROWS = 4
BANDS = 25
PARITY = 16  # words of 64 bits
_AT_ONCE = 1024  # shingles that meet all multipliers at once


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


_PLACES = _odd(WORDS, SEED)
_MULTIPLIERS = _odd(ROWS * BANDS, SEED + 1)[:, None]


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a UTF-8 text."""
    from xxhash import xxh64_intdigest

    run = text.lower().split()  # A-Z to lower case, ASCII white space apart
    words = np.fromiter(map(xxh64_intdigest, run, repeat(SEED)), np.uint64, len(run))
    total = max(min(len(run), 1), len(run) - WORDS + 1)
    found = np.zeros(total, np.uint64)
    for place, m in enumerate(_PLACES[: len(run)]):
        found += words[place : place + total] * m
    found ^= found >> np.uint64(32)
    return np.unique(found * _PLACES[0])


def bands(found: np.ndarray) -> list[int]:
    """A key for each band of a set of shingles; none for the empty set."""
    from xxhash import xxh64_intdigest

    if not len(found):
        return []
    least = np.full(ROWS * BANDS, 2**64 - 1, np.uint64)
    for i in range(0, len(found), _AT_ONCE):
        np.minimum(least, (found[i : i + _AT_ONCE] * _MULTIPLIERS).min(axis=1), out=least)
    keys = [xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def parity(found: np.ndarray) -> list[int]:
    """Whether an odd number of shingles fall on each of ``64 * PARITY`` places.

    Two sets differ in at least as many shingles as their parities in bits.
    """
    odd = np.bincount(found % np.uint64(64 * PARITY), minlength=64 * PARITY) % 2
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8").tolist()


def _hash_of(found: np.ndarray, seed: int, bits: int = 64) -> int:
    """A set's hash as a signed number of ``bits`` bits at most."""
    from xxhash import xxh64_intdigest

    return (xxh64_intdigest(found.tobytes(), seed) & ((1 << bits) - 1)) - (1 << 63)


def signatures(docs: DataFrame, bits: int = 64) -> DataFrame:
    """``doc_id, text_hash, node, other, fp, keys``: two hashes of a document's set, its SimHash and its bands.

    ``bits`` shortens the first of them, to try what happens when it is not unique.
    """

    def signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, others, prints, keys = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                found = shingles(text)
                prints.append(simhash.fingerprint(text, WORDS))
                nodes.append(_hash_of(found, SEED, bits))
                others.append(_hash_of(found, SEED + 1))
                keys.append(bands(found))
            fp = np.array(prints, np.uint64).view(np.int64)
            hashes = [pa.array(nodes, pa.int64()), pa.array(others, pa.int64()), pa.array(fp)]
            columns = [batch.column(0), batch.column(1), *hashes, pa.array(keys, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["doc_id", "text_hash", "node", "other", "fp", "keys"])

    rows = texts(docs).selectExpr("doc_id", "xxhash64(text) AS text_hash", "text")
    return rows.mapInArrow(signed, "doc_id long, text_hash long, node long, other long, fp long, keys array<long>")


def by_simhash(rows: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of nodes whose fingerprints ``fp`` are within ``DISTANCE`` bits.

    Nodes of one fingerprint stand for each other: they meet the smallest of
    them, which meets those of the fingerprints near by.
    """
    nodes = stored(rows.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    same = rows.select("fp", "node").join(nodes, "fp").selectExpr("least AS a", "node AS b")
    near = (
        simhash.links(nodes, DISTANCE, SEGMENTS)
        .join(nodes.selectExpr("fp AS a", "least AS m"), "a")
        .join(nodes.selectExpr("fp AS b", "least AS n"), "b")
    )
    return same.union(near.selectExpr("least(m, n) AS a", "greatest(m, n) AS b")).where("a <> b").distinct()


def _told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` with another ``node`` for sets that share theirs with one of another ``other``."""
    shared = rows.groupBy("node").agg(F.min("other").alias("least"), F.max("other").alias("most")).where("least <> most")
    shared = stored(shared.select("node", "least"), "shared-nodes")  # some 70 rows of 5e10 documents
    node = F.expr("IF(least <> other, xxhash64(node, other), node)")
    return rows.join(shared, "node", "left").withColumn("node", node).drop("least")


def _sets(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``node, size, parity, found`` of the texts chosen by ``text_hash`` for each node and ``other``."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 256):  # sets are larger than their texts
                part = batch.slice(row, 256)
                found = [shingles(t.as_py()) for t in part.column(2).cast(pa.binary())]
                # A text of the same hash may be another's.
                right = [_hash_of(f, SEED + 1) == other for f, other in zip(found, part.column(1).to_pylist())]
                found = [f for f, is_right in zip(found, right) if is_right]
                columns = [
                    part.column(0).filter(pa.array(right, pa.bool_())),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([parity(f) for f in found], pa.list_(pa.int64())),
                    pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64())),
                ]
                yield pa.record_batch(columns, names=["node", "size", "parity", "found"])

    rows = texts(docs).selectExpr("xxhash64(text) AS text_hash", "text").join(chosen, "text_hash").select("node", "other", "text")
    sets = rows.mapInArrow(listed, "node long, size long, parity array<long>, found array<long>")
    return sets.dropDuplicates(["node"])


def _may_be_near(a: str, b: str) -> str:
    """SQL: what sizes and parities leave possible.  It holds for all sets that are similar enough.

    Similarity s of sets with n elements in all means that (1 - s) / (1 + s) * n are in one only.
    """
    differing = " + ".join(f"bit_count({a}.parity[{i}] ^ {b}.parity[{i}])" for i in range(PARITY))
    num, den = LEAST
    return (
        f"least({a}.size, {b}.size) * {den} >= greatest({a}.size, {b}.size) * {num}"
        f" AND ({differing}) * {den + num} <= ({a}.size + {b}.size) * {den - num}"
    )


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of nodes whose sets are similar enough."""
    num, den = LEAST
    sketch = sets.select("node", "size", "parity")
    left, right = sketch.withColumnRenamed("node", "a").alias("l"), sketch.withColumnRenamed("node", "b").alias("r")
    possible = pairs.join(left, "a").join(right, "b").where(_may_be_near("l", "r")).select("a", "b")
    both = possible.join(sets.selectExpr("node AS a", "size AS n", "found AS f"), "a").join(
        sets.selectExpr("node AS b", "size AS m", "found AS g"), "b"
    )
    shared = both.selectExpr("a", "b", "n + m AS total", "size(array_intersect(f, g)) AS shared")
    return shared.where(f"shared * {den} >= (total - shared) * {num}").select("a", "b")


def rarest(sets: DataFrame) -> DataFrame:
    """The rows of ``sets`` with ``shingle`` in place of ``found``, for so many of the rarest that near sets share one.

    Near sets have four fifths of the larger one in common.  So the fifth of
    each that comes first in an order of all shingles, and one more, cannot be
    apart.  In the order by number of sets, what many share comes last.
    Shingles of one set come first and lead nowhere: they are counted only.
    ``before`` is the one that comes before, ``behind`` how many come at a
    shingle or after it, of those the set shares with others.
    """
    num, den = LEAST
    each = sets.select("*", F.explode("found").alias("shingle")).drop("found")
    shared = each.groupBy("shingle").agg(F.expr("count(*) AS n")).where("n > 1")
    placed = each.join(shared, "shingle").selectExpr(
        "*",
        "row_number() OVER (PARTITION BY node ORDER BY n, shingle) AS place",
        "lag(shingle) OVER (PARTITION BY node ORDER BY n, shingle) AS before",
        "count(*) OVER (PARTITION BY node) AS common",
    )
    return placed.where(f"place <= common - (size * {num} + {den - 1}) DIV {den} + 1").selectExpr(
        "* EXCEPT (n, place, common)", "common - place + 1 AS behind"
    )


def across(sets: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of nodes of different ``part`` that may be near, from ``node, part, size, found``.

    With a column ``parity``, pairs that it rules out do not come out of the join either.
    """
    num, den = LEAST
    first = rarest(sets.drop("parity"))
    if "parity" in sets.columns:  # added to the rows that remain, to shuffle fewer of them
        first = first.join(sets.select("node", "parity"), "node")
    first = stored(first, "rarest")
    near = f"l.node < r.node AND l.part <> r.part AND least(l.size, r.size) * {den} >= greatest(l.size, r.size) * {num}"
    # Pairs that share the shingle before as well have met there.
    near += " AND coalesce(l.before <> r.before, true)"
    # From the first shingle near sets share on, both hold all they have in common: num / (num + den) of their elements.
    near += f" AND least(l.behind, r.behind) * {num + den} >= (l.size + r.size) * {num}"
    if "parity" in sets.columns:
        near += f" AND {_may_be_near('l', 'r')}"
    met = first.alias("l").join(first.alias("r"), F.expr(f"l.shingle = r.shingle AND {near}"))
    return met.selectExpr("l.node AS a", "r.node AS b").distinct()


def near_copies(docs: DataFrame, bits: int = 64) -> DataFrame:
    """``doc_id, text_hash, node, root``: one row per document; ``root`` is the same for all that links connect."""
    rows = _told_apart(stored(signatures(docs, bits), "signatures"))
    keyed = rows.selectExpr("node", "explode(keys) AS key")
    shared = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    members = stored(keyed.join(shared, "key").distinct(), "members")
    near = stored(by_simhash(rows), "near")
    candidates = members.select("node").union(near.selectExpr("explode(array(a, b)) AS node")).distinct()
    chosen = rows.join(candidates, "node", "left_semi")
    chosen = chosen.groupBy("node", "other").agg(F.min("text_hash").alias("text_hash"))
    sets = stored(_sets(docs, chosen), "sets")

    # What SimHash brings together, and each member of a band with the smallest and the largest.
    spokes = members.selectExpr("node", "explode(array(lo, hi)) AS end").where("node <> end")
    spokes = spokes.selectExpr("least(node, end) AS a", "greatest(node, end) AS b")
    first = stored(near.union(spokes).distinct(), "pairs")
    linked = stored(_verified(first, sets), "links")

    # Then nodes of bands that hold several components.
    parts = components(linked)
    placed = members.select("key", "node").join(parts, "node", "left").selectExpr("key", "node", "coalesce(root, node) AS part")
    mixed = placed.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most")
    apart = placed.join(mixed, "key").select("node", "part").distinct()
    met = across(sets.join(apart, "node").select("node", "part", "size", "parity", "found"))
    rest = stored(met.join(first, ["a", "b"], "left_anti"), "pairs")
    found = components(linked.union(_verified(rest, sets)))
    return rows.select("doc_id", "text_hash", "node").join(found, "node", "left").selectExpr(
        "doc_id", "text_hash", "node", "coalesce(root, node) AS root"
    )
