"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of words with period q, at least ``LEAST`` words and two
periods long, that no neighbour extends.  The dictionary names the stretches
of 1, 2, 4, ... words, two of them alike if their words are.  For each length L,
the successive occurrences of a name that lie at most L / 2 apart form an
arithmetic progression, since their distance is the period of the stretch;
progressions that begin within 2 L of each other propose the differences of
their members as periods.  Proposals are extended to both sides by comparing
names of halving length, and those that give one stretch are one run, with the
smallest period.

Every run is proposed: one of period q, L <= q < 2 L, holds its first L words
twice at distance q, and in two progressions unless its period is smaller.
With ``LEAST`` words, L = 4 does for all q below 8.

Work on a text is a few sorts of those of its positions whose stretch occurs
twice; no text meets another.  The texts of a batch are named together.

Defined results: a null text has no words, nor has a blank one; a text without
an id is not rewritten by :func:`planted`; rows that repeat an id are judged
each on its own; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 12
_FIRST = 4  # shortest stretch that proposes
_AT_ONCE = 1 << 17  # words named together, one text at least


def factors(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... words from every position, while shorter than ``longest`` words.

    A stretch that occurs once has a negative name of its own, as has one that reaches beyond the end.
    """
    alone = -1 - np.arange(len(words))
    twice = np.bincount(words)[words] > 1
    again, names = np.flatnonzero(twice), [np.where(twice, words, alone)]
    half = 1
    while 2 * half < longest:
        last = names[-1]
        again = again[again + half < len(words)]
        again = again[last[again + half] >= 0]
        _, found, counts = np.unique(last[again] * len(words) + last[again + half], return_inverse=True, return_counts=True)
        twice = counts[found] > 1
        again, found = again[twice], found[twice]
        named = alone.copy()
        named[again] = found
        names.append(named)
        half *= 2
    return names


def proposals(names: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods that occurrences of the stretches of one ``length`` propose."""
    at = np.flatnonzero(names >= 0)
    if not len(at):
        return at, at
    at = at[np.argsort(names[at], kind="stable")]
    name = names[at]
    same, gap = name[1:] == name[:-1], at[1:] - at[:-1]
    close = same & (2 * gap <= length)
    # Progressions: first and last member, steps between them, difference.
    first = np.flatnonzero(np.concatenate([[True], ~close]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    steps = last - first
    apart = np.where(steps > 0, at[np.minimum(first + 1, len(at) - 1)] - at[first], 0)
    starts, periods = [at[first[steps > 0]]], [apart[steps > 0]]
    least = 1 if length == _FIRST else length
    # Progressions begin over L / 2 apart: within 2 L there are three more at most.
    for ahead in (1, 2, 3):
        a = np.arange(max(0, len(first) - ahead))
        b = a + ahead
        distance = at[first[b]] - at[last[a]]
        near = (name[first[a]] == name[first[b]]) & (distance < 2 * length)
        a, b, distance = a[near], b[near], distance[near]
        difference = np.maximum(np.maximum(apart[a], apart[b]), 1)
        low = np.maximum(0, -(-(least - distance) // difference))
        high = np.minimum(steps[a] + steps[b], (2 * length - 1 - distance) // difference)
        many = np.maximum(0, high - low + 1)
        pair = np.repeat(np.arange(len(a)), many)
        shift = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[pair]
        back = np.minimum(shift, steps[a[pair]])
        starts.append(at[last[a[pair]]] - back * difference[pair])
        periods.append(distance[pair] + shift * difference[pair])
    return np.concatenate(starts), np.concatenate(periods)


def extended(names: list[np.ndarray], start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of the longest stretches that keep a period around a position."""
    size = len(names[0])
    low, high = start.copy(), start + period
    for level in reversed(range(len(names))):
        step, named = 1 << level, names[level]
        x, y = high - period, high
        inside = y < size
        high = high + step * (inside & (named[x] == named[np.minimum(y, size - 1)]))
        x = low - step
        inside = x >= 0
        x = np.maximum(x, 0)
        low = low - step * (inside & (named[x] == named[x + period]))
    return low, high


def runs(words: np.ndarray, longest: int) -> np.ndarray:
    """Rows ``start, length, period`` of every run, by start and period.

    ``words`` are numbers of words, the same for no two texts; no text has over ``longest`` words.
    """
    names = factors(words, longest)
    found = [proposals(named, 1 << k) for k, named in enumerate(names) if _FIRST <= 1 << k <= longest // 2]
    if not found:
        return np.empty((0, 3), np.int64)
    pairs = np.unique(np.stack([np.concatenate(part) for part in zip(*found)], axis=1), axis=0)
    start, period = pairs[:, 0], pairs[:, 1]
    low, high = extended(names, start, period)
    long = high - low >= np.maximum(LEAST, 2 * period)
    rows = np.stack([low[long], high[long], period[long]], axis=1)
    rows = rows[np.lexsort(rows.T[::-1])]
    # Of the periods of one stretch the smallest.
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[new]
    rows[:, 1] -= rows[:, 0]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def planted(n: int, h: int | None) -> np.ndarray:
    """Places in a text of ``n`` words whose words it takes: a repeating tail in one text of ten, by the hash ``h``."""
    places = np.arange(n)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        places[a:] = a + (places[a:] - a) % p
    return places


def report(words: list[bytes], found: np.ndarray) -> tuple:
    """What :data:`SCHEMA` has after ``doc_id``, for a text and its runs."""
    n = len(words)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    kept = words if not len(found) else [w for w, d in zip(words, np.cumsum(edges)[:n].tolist()) if not d]
    best = (None,) * 4
    if len(found):
        s, l, p = min(found.tolist(), key=lambda r: (-r[1], r[0], r[2]))
        best = (s, l, p, 1000 * l // p)
    listed = "".join(f"{s},{l},{p}\n" for s, l, p in found.tolist())
    return (len(found), *best, sha256(listed.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest())


def _reported(texts: list[tuple[list[bytes], np.ndarray]]) -> Iterator[tuple]:
    """Reports of several texts, named together."""
    long = [(words, numbers) for words, numbers in texts if len(words) >= LEAST]
    first = np.cumsum([0] + [len(words) for words, _ in long])
    base = np.cumsum([0] + [int(numbers.max()) + 1 for _, numbers in long])
    found = np.empty((0, 3), np.int64)
    if long:
        whole = np.concatenate([numbers + b for (_, numbers), b in zip(long, base)])
        found = runs(whole, max(len(words) for words, _ in long))
    cuts = np.searchsorted(found[:, 0], first).tolist()
    k = 0
    for words, _ in texts:
        own = found[:0]
        if len(words) >= LEAST:
            own = found[cuts[k] : cuts[k + 1]] - np.array([first[k], 0, 0])
            k += 1
        yield report(words, own)


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string"
)
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def find(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Runs of every text and the digest of the text without repeats; ``plant`` rewrites texts by :func:`planted` first."""

    def searched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in SCHEMA.split(", ")]

        def rows(ids: list, texts: list) -> pa.RecordBatch:
            columns = zip(*((i, *r) for i, r in zip(ids, _reported(texts))))
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=names)

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                words = text.as_py().split()  # ASCII white space apart
                if plant and h is not None and h % 10 == 0:
                    words = [words[k] for k in planted(len(words), h).tolist()]
                known: dict[bytes, int] = {}
                numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
                if ids and size + len(words) > _AT_ONCE:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append((words, numbers))
                size += len(words)
            if ids:
                yield rows(ids, texts)

    hashed = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "crc32(CAST(doc_id AS STRING)) AS h", "coalesce(text, '') AS text")
    return hashed.mapInArrow(searched, SCHEMA)
