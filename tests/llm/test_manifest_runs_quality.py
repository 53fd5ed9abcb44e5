"""Merkle manifest, periodic runs and quality rules against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL_DIR
from hypothesis import example, given, settings, strategies as st

from fleetgauge.llm import merkle, quality, queries, repetition

WHITE = " \t\n\x0b\f\r"


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def split(text: str) -> list[str]:
    return [w for w in "".join(" " if c in WHITE else c for c in text).split(" ") if w]


# Merkle manifest


def plain_leaf(*values) -> str:
    return sha(b"".join(b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode()) for v in values))


def plain_levels(digests: list[str]) -> list[list[str]]:
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def plain_way(levels: list[list[str]], place: int) -> list[tuple[str, str]]:
    way = []
    for level in levels[:-1]:
        run = place - place % 8
        way.append(("".join(level[run:place]), "".join(level[place + 1 : run + 8])))
        place //= 8
    return way


def plain_manifest(rows: list[tuple]) -> Counter:
    """Of ``doc_id, source, lang, n_chars, text``."""
    groups = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        claim = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            claim = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        leaf = plain_leaf(doc_id, source, lang, n_chars, text)
        groups[lang].append((doc_id is not None, doc_id or 0, leaf, doc_id, plain_leaf(doc_id, source, lang, n_chars, claim)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_levels([r[2] for r in sorted(groups[g])]) for g in order}
    top = plain_levels([trees[g][-1][0] for g in order])
    out = Counter()
    for number, g in enumerate(order):
        for place, (_, _, leaf, doc_id, claimed) in enumerate(sorted(groups[g])):
            way = plain_way(trees[g], place) + plain_way(top, number)
            for before, after in way:
                claimed = sha(before + claimed + after)
            proof = sha("".join(b + a for b, a in way))
            out[doc_id, leaf, trees[g][-1][0], top[-1][0], proof, claimed, claimed == top[-1][0]] += 1
    return out


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_of(spark, tmp_path, rows) -> Counter:
    spark.createDataFrame(rows, FIELDS).write.parquet(f"{tmp_path}/documents.parquet")
    return Counter(map(tuple, queries.op11_merkle(spark, str(tmp_path)).collect()))


def test_manifest_on_awkward_tables(spark, awkward):
    rows = [tuple(r) for r in spark.read.parquet(f"{awkward}/documents.parquet").select(*merkle.FIELDS).collect()]
    found = Counter(map(tuple, queries.op11_merkle(spark, awkward).collect()))
    assert found == plain_manifest(rows)
    assert {r[6] for r in found} == {True, False}


@pytest.mark.parametrize("sizes", [(1,), (8,), (9,), (1, 1), (64, 65), (600, 1, 8, 7), (1,) * 70, (513, 3, 0, 2, 1, 1, 1, 1, 1, 1, 1)])
def test_manifest_of_every_shape(spark, tmp_path, sizes):
    rows = [(1000 * g + i, "s", f"l{g}" if g else None, i, f"Text {i} of {g}") for g, n in enumerate(sizes) for i in range(n)]
    assert manifest_of(spark, tmp_path, rows[::-1]) == plain_manifest(rows)


def test_pointers_double(spark):
    # Ten inner levels: every pointer reaches the end after four rounds, with all segments in order.
    rows = [((0, i, 0), (0, i + 1, 0), [(bytes([i]), b"")]) for i in range(1, 11)]
    node = "struct<tree: long, level: int, place: long>"
    pointers = spark.createDataFrame(rows, f"id {node}, up {node}, path array<struct<before: binary, after: binary>>")
    for r in merkle._jump(pointers, 10).collect():
        assert r["up"]["level"] == 11 and [s["before"][0] for s in r["path"]] == list(range(r["id"]["level"], 11))


# Periodic runs


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    n, best = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(12, 2 * p):
                best.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in best.items())


def plain_report(doc_id, text: str) -> tuple:
    words = split(text)
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {i for s, l, p in found for i in range(s + p, s + l)}
    best = (None,) * 4
    if found:
        s, l, p = min(found, key=lambda r: (-r[1], r[0], r[2]))
        best = (s, l, p, 1000 * l // p)
    listed = "".join(f"{s},{l},{p}\n" for s, l, p in found)
    return (doc_id, len(found), *best, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


# Repeats of repeats, cut and joined: what has runs of many periods.
BLOCKS = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9)), max_size=8)


@settings(max_examples=600, deadline=None)
@given(st.lists(BLOCKS, min_size=1, max_size=3), st.integers(1, 3))
@example([[([0, 1], 30), ([1], 1), ([0, 1], 30)]], 2)
@example([[([0], 64), ([1], 1), ([0], 64), ([1], 1), ([0], 63)]], 1)
def test_runs(blocks, times):
    texts = [[w for unit, n in block for w in unit * n] * times for block in blocks]
    base, numbered = 0, []
    for text in texts:
        numbered.append([base + w for w in text])
        base += 3
    whole = np.array([w for text in numbered for w in text], np.int64)
    expected, first = [], 0
    for text in texts:
        expected += [(first + s, l, p) for s, l, p in plain_runs(text)]
        first += len(text)
    assert list(map(tuple, repetition.runs(whole, max(map(len, texts))).tolist())) == expected


def fibonacci(n: int) -> list[int]:
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize(
    "words",
    [[0] * 700, fibonacci(900), [0, 1] * 200 + [1, 0] * 200, [bin(i).count("1") % 2 for i in range(600)], list(range(300)) * 3],
    ids=["one", "fibonacci", "turned", "thue-morse", "long"],
)
def test_runs_of_words_with_many_squares(words):
    found = repetition.runs(np.array(words, np.int64), len(words))
    assert list(map(tuple, found.tolist())) == plain_runs(words)


def test_runs_of_documents(spark, awkward, write):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{awkward}/documents.parquet").collect()]
    short = [r for r in rows if len(r[1] or "") < 100_000]
    more = [(1000 + i, "\x0ba b\tc " * (i % 9) + f"x{i} y z " * (i % 7), None, None, 0) for i in range(300)]
    folder = write([(*r, None, None, 0) for r in short] + more)
    expected = Counter(plain_report(i, t or "") for i, t in short) + Counter(plain_report(r[0], r[1]) for r in more)
    assert Counter(map(tuple, queries.op12_repetition(spark, folder).collect())) == expected
    assert sum(r[1] > 0 for r in expected) > 50


def test_runs_of_given_documents(spark):
    rows = spark.read.parquet(f"{SMALL_DIR}/documents.parquet").select("doc_id", "text").collect()
    small = [r for r in rows if len(r["text"]) < 8_000]
    found = {r["doc_id"]: tuple(r) for r in queries.op12_repetition(spark, SMALL_DIR).collect()}
    assert all(found[r["doc_id"]] == plain_report(r["doc_id"], r["text"]) for r in small)


# Quality rules


def plain_statistics(text: str) -> tuple:
    words = split(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(8)}
    lines = [line for line in text.split("\n") if split(line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(repeated)


def plain_verdicts(rows: list[tuple]) -> Counter:
    """Of ``doc_id, host, text``."""
    def lines(text):
        listed = (split(line) for line in text.split("\n"))
        return [(re.sub("[0-9]+", "0", " ".join(words)).lower(), len(words)) for words in listed if words]

    texts, held = defaultdict(set), defaultdict(set)
    for _, host, text in rows:
        texts[host].add(text)
        for line, _ in lines(text):
            held[host, line].add(text)
    out = Counter()
    for doc_id, host, text in rows:
        found = plain_statistics(text)
        gone = sum(
            n for line, n in lines(text)
            if len(held[host, line]) > quality.LEAST_DOCUMENTS and 1000 * len(held[host, line]) > quality.PER_MILLE * len(texts[host])
        )
        failed = found[0] < 20 or 100 * found[4] > 30 * found[0]
        out[(doc_id, *found, failed, not failed and 100 * (found[0] - gone) >= quality.REMAINING * found[0])] += 1
    return out


def test_quality_of_awkward_tables(spark, awkward):
    rows = [(r["doc_id"], r["source"], r["text"] or "") for r in spark.read.parquet(f"{awkward}/documents.parquet").collect()]
    assert Counter(map(tuple, queries.op13_quality(spark, awkward).collect())) == plain_verdicts(rows)


def test_lines_of_a_host(spark, write):
    menu = "Home | About us | Contact\nAll  rights reserved 20{}\nsubscribe to the newsletter of this host today and read more of it tomorrow"
    own = "this page says something of its own number {} and more words follow here to fill it up"
    short = "some words of its own {}"
    rows = [(i, menu.format(i) + "\n" + own.format("abcdefghijkl"[i]), None, "a") for i in range(12)]
    rows += [(100 + i, menu.format(i) + "\n" + short.format(f"w{chr(97 + i)}"), None, "a") for i in range(3)]
    rows += [(200 + i, menu.format(i) + "\n" + short.format(f"w{chr(97 + i)}"), None, "b") for i in range(5)]  # too few on that host
    rows += [(300 + i, menu + "\n" + short, None, "c") for i in range(40)]  # copies are one document
    rows += [(400 + i, menu.format(7) + "\n" + short.format(f"w{chr(97 + i)}"), None, None) for i in range(15)]
    folder = write([(*r, len(r[1])) for r in rows])
    found = {r["doc_id"]: r["kept"] for r in queries.op13_quality(spark, folder).collect()}
    assert {i for i, kept in found.items() if not kept} == {100, 101, 102, *range(400, 415)}
    assert Counter(map(tuple, queries.op13_quality(spark, folder).collect())) == plain_verdicts([(r[0], r[3], r[1]) for r in rows])


TEXTS = st.lists(st.sampled_from(["a", "b", "c d", "#", "é", " ", " ", "\n", "\r\n", "\t", "\x0b", "a b c d e f g h ", "1", "İ"]), max_size=60).map("".join)


@settings(max_examples=25, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=30))
def test_statistics(spark, texts):
    rows = spark.createDataFrame([(i, "h", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    found = {r["doc_id"]: tuple(r)[1:] for r in quality.scan(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()}
    assert found == {i: plain_statistics(t) for i, t in enumerate(texts)}
