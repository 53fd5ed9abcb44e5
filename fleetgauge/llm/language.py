"""Language of texts, with spans where the language changes.

Every white-space-separated word gets a score in every language: the log
probability of its character trigrams and of itself, both hashed into a fixed
number of buckets.  The script of a word's letters narrows the languages to
those that were seen in that script.  A Viterbi pass over the words, which
pays ``SWITCH`` for each change of language, labels spans; the document has
the language that holds the most letters.

The model is a table of ``2 * BUCKETS`` numbers for each language, summed over
all rows the caller learns from.

Defined results: a text that is null or has no letter is ``und`` with score 0
and has no spans; a text whose letters belong to no learned script gets the
first language in the alphabet with score 0; ties go to the earlier language;
without any learned row every text is ``und``; an empty table gives an empty
one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

UNKNOWN = "und"
BUCKETS = 1 << 16
SMOOTHING = 0.5
SWITCH = 20.0
# A language is written in a script if that share of its letters is.
SCRIPT_SHARE = 0.01
# Words a worker keeps scores of before it starts over.
REMEMBERED = 300_000

# First code points of script ranges; a script ends where the next entry begins.
SCRIPTS = (
    (0x0000, "latin"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0780, "other"),
    (0x0900, "devanagari"),
    (0x0980, "indic"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "ethiopic"),
    (0x1380, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, "other"),
    (0x2C60, "latin"),
    (0x2C80, "other"),
    (0x3040, "kana"),
    (0x3100, "other"),
    (0x3400, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD800, "other"),
    (0xF900, "han"),
    (0xFB00, "latin"),
    (0xFB13, "other"),
    (0x20000, "han"),
    (0x323B0, "other"),
)
_STARTS = np.array([start for start, _ in SCRIPTS])
_NAMES = sorted({name for _, name in SCRIPTS})
_NUMBERS = np.array([_NAMES.index(name) for _, name in SCRIPTS])
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(word: str) -> str:
    """A lower-cased word without what is not a letter, that is not of Unicode category L."""
    kept = _NOT_LETTERS.sub("", word)
    # What is left may be numeric without being a digit, as superscripts, fractions and Roman numerals are.
    return kept if kept.isalpha() else "".join(filter(str.isalpha, kept))


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features, and the word each belongs to; no word is empty."""
    codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    middle = codes[1:-1]
    inside = middle != 10
    mixed = codes[:-2] * np.uint32(0x9E3779B1) ^ middle * np.uint32(0x85EBCA6B) ^ codes[2:] * np.uint32(0xC2B2AE35)
    mixed ^= mixed >> np.uint32(15)
    trigrams = (mixed[inside] & np.uint32(BUCKETS - 1)).astype(np.int64)
    owner = np.cumsum(~inside)[inside]
    whole = np.fromiter((zlib.crc32(w.encode()) % BUCKETS + BUCKETS for w in words), np.int64, len(words))
    return np.concatenate([trigrams, whole]), np.concatenate([owner, np.arange(len(words))])


def _scripts(words: list[str]) -> np.ndarray:
    """Number of the script of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    return _NUMBERS[np.searchsorted(_STARTS, first, side="right") - 1]


@dataclass
class Model:
    """Log probabilities (language, bucket) and the scripts of each language."""

    languages: list[str]
    table: np.ndarray
    scripts: np.ndarray


def learn(docs: DataFrame) -> Model:
    """A model of the rows' ``text`` and ``lang``; rows without either are left out."""
    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(text.lower().split())
            for lang, found in words.items():
                clean: Counter = Counter()
                for word, n in found.items():
                    clean[letters_of(word)] += n
                clean.pop("", None)
                if not clean:
                    continue
                distinct = list(clean)
                times = np.fromiter(clean.values(), np.int64)
                bucket, owner = _features(distinct)
                # Behind the features: letters by script.
                lengths = times * np.fromiter(map(len, distinct), np.int64)
                bucket = np.concatenate([bucket, 2 * BUCKETS + _scripts(distinct)])
                weight = np.concatenate([times[owner], lengths])
                total = np.bincount(bucket, weight).astype(np.int64)
                there = np.flatnonzero(total)
                yield pa.record_batch(
                    [pa.array([lang] * len(there)), pa.array(there), pa.array(total[there])], names=["lang", "bucket", "n"]
                )

    counts = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # At most (2 * BUCKETS + scripts) rows for a language.
    found = counts.toArrow()
    names = found["lang"].to_numpy()
    languages = sorted(set(names.tolist()))
    table = np.zeros((len(languages), 2 * BUCKETS + len(_NAMES)))
    if languages:
        at = np.searchsorted(np.array(languages, dtype=object), names)
        table[at, found["bucket"].to_numpy()] = found["n"].to_numpy()
    scripts = table[:, 2 * BUCKETS :]
    logs = np.empty((len(languages), 2 * BUCKETS), np.float32)
    for part in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
        seen = table[:, part] + SMOOTHING
        logs[:, part] = np.log(seen / seen.sum(axis=1, keepdims=True))
    return Model(languages, logs, scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1))


class Words(dict):
    """Lower-cased word -> its row in ``scores`` and ``letters``."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self._new: list[str] = []
        self.scores = np.empty((0, len(self.model.languages)), np.float32)
        self.letters = np.empty(0, np.int64)

    def __missing__(self, word: str) -> int:
        self._new.append(word)
        row = self[word] = len(self)
        return row

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self._forget()
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self._new:
            scores, letters = self._score([letters_of(w) for w in self._new])
            self.scores = _grown(self.scores, len(self) - len(scores), scores)
            self.letters = _grown(self.letters, len(self) - len(letters), letters)
            self._new = []
        return found

    def _score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        model = self.model
        letters = np.fromiter(map(len, words), np.int64, len(words))
        scores = np.zeros((len(words), len(model.languages)), np.float32)
        there = np.flatnonzero(letters)
        if len(there):
            present = [words[i] for i in there]
            bucket, owner = _features(present)
            for i in range(len(model.languages)):
                scores[there, i] = np.bincount(owner, model.table[i, bucket], len(present))
            allowed = model.scripts[:, _scripts(present)].T
            known = allowed.any(axis=1)
            scores[there] = np.where(allowed, scores[there], scores[there].min(axis=1, keepdims=True) - SWITCH)
            scores[there[~known]] = 0
        return scores, letters


def _grown(old: np.ndarray, used: int, new: np.ndarray) -> np.ndarray:
    """``old[:used]`` followed by ``new``, with room to spare so that growing is rare."""
    if used + len(new) > len(old):
        room = np.empty((2 * (used + len(new)), *old.shape[1:]), old.dtype)
        room[:used] = old[:used]
        old = room
    old[used : used + len(new)] = new
    return old


def label_words(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each word on the best path that pays ``switch`` for each change."""
    best = int(scores.sum(axis=0, dtype=np.float64).argmax())
    # What any stretch in another language could gain over staying with the best one.
    ahead = np.cumsum(scores - scores[:, [best]], axis=0, dtype=np.float64)
    lowest = np.minimum(np.minimum.accumulate(ahead, axis=0), 0)
    if (ahead - lowest).max(initial=0) <= switch / 2:
        return np.full(len(scores), best)
    languages = range(scores.shape[1])
    total, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(total)
        leader = total.index(top)
        top -= switch
        back.append([i if total[i] >= top else leader for i in languages])
        total = [(t if t >= top else top) + s for t, s in zip(total, row)]
    at = total.index(max(total))
    path = [at]
    for row in reversed(back):
        at = row[at]
        path.append(at)
    return np.array(path[::-1])


def identify_text(text: str, words: Words) -> tuple[str, float, list[tuple[int, int, str]]]:
    """Language, share of the letters it holds, and spans (first word, last word, language)."""
    rows = words.rows(text.lower().split())
    if not len(rows) or not words.model.languages:
        return UNKNOWN, 0.0, []
    letters = words.letters[rows]
    if not letters.sum():
        return UNKNOWN, 0.0, []
    scores = words.scores[rows]
    path = label_words(scores)
    # Letters of unknown scripts count for no language.
    held = np.bincount(path, letters * scores.any(axis=1), len(words.model.languages))
    best = int(held.argmax())
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    spans = [(a, b - 1, words.model.languages[path[a]]) for a, b in zip(cuts, cuts[1:])]
    return words.model.languages[best], float(held[best] / letters.sum()), spans


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` as struct ``row``, and struct ``language`` of ``lang_pred, score, lang_spans``.

    Spans count white-space-separated words from 0, both ends included.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.col("text"))
    language = T.StructType.fromDDL(
        "lang_pred string, score double, lang_spans array<struct<first: int, last: int, lang: string>>"
    )
    found = pa.struct(
        [
            ("lang_pred", pa.string()),
            ("score", pa.float64()),
            ("lang_spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))),
        ]
    )

    def label(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                pred, score, spans = identify_text(text or "", words)
                spans = [{"first": a, "last": b, "lang": lang} for a, b, lang in spans]
                out.append({"lang_pred": pred, "score": score, "lang_spans": spans})
            yield pa.record_batch([batch.column(0), pa.array(out, found)], names=["row", "language"])

    return rows.mapInArrow(label, T.StructType([rows.schema["row"], T.StructField("language", language)]))
