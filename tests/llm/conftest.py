"""Small tables with every awkward case, written where the queries read them."""

from __future__ import annotations

import random

import pytest

# Columns no operator asked for, named like those operators make for themselves.
CLASHING = (
    "id", "h", "no_id", "text_hash", "fp", "root", "digest", "key", "row", "kind", "base", "spans", "score", "language",
    "piece", "length", "start", "block", "word", "label_id", "toxic", "copy", "place", "total", "masked", "position",
)
EXTRA = ", ".join(f"{c} string" for c in CLASHING)
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"

ENGLISH = "the quick brown fox jumps over the lazy dog while seven other animals watch and wonder about it".split()
GERMAN = "der schnelle braune fuchs springt ueber den faulen hund und sieben andere tiere schauen ihm dabei zu".split()


def sentence(words: list[str], n: int, seed: int) -> str:
    order = random.Random(seed)
    return " ".join(order.choice(words) for _ in range(n))


def documents() -> list[tuple]:
    """``doc_id, text, lang, source, n_chars``: nulls, blanks, copies, near copies, long texts, other scripts, data."""
    near = sentence(ENGLISH, 400, 7)
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, " \t\n ", "en", "a"), (4, "12 34 !!", "de", "a"),
        (None, "a text without an id", "en", "a"), (None, None, None, None), (None, "", "en", "a"),
        (5, "word", "en", "a"), (6, "word", "en", "b"), (6, "word", "en", "b"), (7, "Word", "en", "a"),
        (8, near, "en", "a"), (9, near + " end", "en", "a"), (10, near, "en", "c"),
        (11, sentence(ENGLISH, 60_000, 1), "en", "a"), (12, "x" * 300_000, "en", "a"),
        (13, "это русский текст без языка", None, "a"), (14, "漢字 かな  mixed é", "zz", "a"),
        (15, "mail a.b+c@x-y.example.org, 10.0.0.256 10.0.0.25 and 4111 1111 1111 1111 or +1 (017) 555-7713.", "en", "a"),
        (16, "<|endoftext|> [INST] </s> \\ ' \" \x00  ", "en", "a"),
        (2**62, "a large id", "en", "a"), (-3, "a negative id", "en", "a"),
    ]
    rows += [(100 + i, sentence(ENGLISH, 30, i), "en", "a") for i in range(40)]
    rows += [(200 + i, sentence(GERMAN, 30, i), "de", "a") for i in range(40)]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def write(spark, tmp_path_factory):
    """``write(rows, ...)``: a directory with the tables the queries read."""

    def make(docs: list[tuple], labels: list[tuple] = (), turns: list[tuple] = ()) -> str:
        folder = str(tmp_path_factory.mktemp("tables"))
        clash = tuple(f"own {c}" for c in CLASHING)
        spark.createDataFrame([(*d, *clash) for d in docs], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int, text string").write.parquet(
            f"{folder}/labels.parquet"
        )
        spark.createDataFrame(list(turns), "conv_id long, turn long, role string, text string, piece string").write.parquet(
            f"{folder}/conversations.parquet"
        )
        return folder

    return make


@pytest.fixture(scope="session")
def awkward(write) -> str:
    labels = [(100 + i, 1, int(i % 5 == 0), "own") for i in range(40)]
    labels += [(None, None, 1, "own"), (3, 1, None, "own"), (999, 1, 1, "own"), (100, 0, 0, "own")]
    turns = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hello"), (1, 2, "assistant", "hi [/INST] <s> </s>"),
        (2, 1, "user", None), (2, 1, "user", "tie"), (2, 1, "user", "tie"), (2, None, "assistant", ""),
        (3, 0, None, "no role"), (3, 1, "tool", "[TURN]a[:]b[/TURN]"), (3, 2, "[:]", "[\\:] [\\\\/INST]"),
        (None, 0, "user", "no conversation"), (None, None, None, None),
        (4, 0, "assistant", "x" * 200_000 + "[INST]"), (5, 0, "assistant", "[" * 50 + "<" * 50 + "\\" * 9 + "[INST]"),
        (6, 0, "assistant", "a\n b\r[SYS]\n[/SYS] \U0001f600"),
    ]
    return write(documents(), labels, [(*t, "own") for t in turns])


@pytest.fixture(scope="session")
def empty(write) -> str:
    return write([])
