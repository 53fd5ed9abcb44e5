"""Toxicity by weak supervision.

1. Features are words, beginnings of words, and several words of a document
   with one beginning.  Those that stand out in the toxic ones of all labelled
   rows are selected; the strongest that do not contain each other become
   voters, which vote on a text that has them and abstain on others.
2. Label model: over the votes on all texts, expectation maximisation
   estimates the share of toxic texts, how often each voter votes on toxic and
   on clean ones, how often none does, and how voters correlate within a
   class.  Votes of one text that repeat each other weigh less; one that
   abstains says nothing, silence of all is evidence of its own.  The labelled
   rows' counts, half of all weight at least, hold the classes in place:
   labels enter by them alone.  Votes
   are kept as distinct combinations with counts.
3. Classifier: a logistic regression on the selected features, trained on the
   label model's posteriors of a bounded sample, scores every text.

The caller gives the labels that may be learned from.  Only text decides a
score.

Defined results: a null text is empty and has the score of a text without
words; labels that are null or have no document are left out, of several for
one document the highest counts; without any label every text scores 0; an
empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetgauge.llm.tables import stored, texts
from fleetgauge.operators.prefilter import may_be_among

# Bounds of what is learned: rows for the classifier, features, voters.
CLASSIFIER_ROWS = 12_000
SELECTED = 5_000
VOTERS = 96
# A selected feature is in as many toxic rows at least and more often than in clean ones, by G-squared.
SUPPORT = 4
SELECT_G2 = 15.0
VOTER_G2 = 30.0
STEMS = (4, 5, 6)
MANY = (2, 3)
ROUNDS = 6
# All texts together weigh at most as much as the labelled rows in a round, so that they cannot pull the classes away.
UNLABELLED = 1.0
REMEMBERED = 300_000
# Words of the filter on labelled ids, 2 MB in all: of 2,000,000 labels, one other text in 60 passes.
FILTER_WORDS = 1 << 18

_PARTS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """Distinct lower-cased words."""
    return {word for run in set(text.lower().split()) for word in _PARTS.findall(run)}


def stems_of(word: str) -> list[str]:
    return [word[:n] for n in STEMS if len(word) > n]


def features(words: Iterable[str]) -> set[str]:
    """Features of distinct words: ``word``, ``stem*``, and ``stem*2`` for two words with that beginning."""
    words = set(words)
    stems = Counter(chain.from_iterable(map(stems_of, words)))
    many = {f"{stem}*{k}" for stem, n in stems.items() for k in MANY if n >= k}
    return words | {f"{stem}*" for stem in stems} | many


class Reader:
    """Finds known features in texts; a worker remembers which words of a run can have one."""

    def __init__(self, known: list[str]):
        self._numbers = {name: i for i, name in enumerate(known)}
        stems = {name.partition("*")[0] for name in known if "*" in name}
        numbers = self._numbers

        class Runs(dict):
            def __missing__(self, run: str) -> tuple[str, ...]:
                if len(self) >= REMEMBERED:
                    self.clear()
                parts = _PARTS.findall(run)
                found = self[run] = tuple(w for w in parts if w in numbers or any(s in stems for s in stems_of(w)))
                return found

        self._runs = Runs()

    def __call__(self, text: str) -> list[int]:
        """Numbers of the features a text has."""
        words = set(chain.from_iterable(map(self._runs.__getitem__, set(text.lower().split()))))
        return [self._numbers[name] for name in features(words) if name in self._numbers] if words else []


def _known(labels: DataFrame) -> DataFrame:
    """One label for each id."""
    return (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").cast("bigint").alias("label_id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of all labelled documents.

    Texts without a label stay where they are scanned, but for the few that a
    filter of fixed size lets pass.  Labels are never broadcast, so the plan
    and what it shuffles do not change with their number.
    """
    known = _known(labels).withColumnRenamed("label_id", "doc_id")
    return may_be_among(texts(docs), known, ["doc_id"], FILTER_WORDS).join(known.hint("merge"), "doc_id").select("text", "toxic")


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """``text`` of at most ``rows`` labelled documents, the same ones for the same labels."""
    known = _known(labels)
    total = known.count()
    # What passes is about twice the bound, so that no task has to sort all labels.
    part = max(1, total // (2 * rows))
    chosen = known.where(F.expr(f"pmod(xxhash64(label_id), {part}) = 0"))
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    # At most ``rows`` rows of two numbers.
    return texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text")


@dataclass
class Features:
    """Selected features, strongest first, with the labelled rows that have them (clean, toxic)."""

    names: list[str]
    rows: np.ndarray
    total: np.ndarray

    def voters(self, most: int = VOTERS) -> Features:
        """The strongest features that do not contain each other."""
        chosen: list[int] = []
        for i, name in enumerate(self.names):
            if len(chosen) < most and _g2(self.rows[i], self.total) >= VOTER_G2:
                if not any(_covers(self.names[c], name) or _covers(name, self.names[c]) for c in chosen):
                    chosen.append(i)
        return Features([self.names[i] for i in chosen], self.rows[chosen], self.total)


def _g2(rows: np.ndarray, total: np.ndarray) -> float:
    """G-squared of a feature's two-by-two table."""
    seen = np.array([rows, total - rows]) + 0.5
    expected = seen.sum(axis=1, keepdims=True) * seen.sum(axis=0, keepdims=True) / seen.sum()
    return float(2 * (seen * np.log(seen / expected)).sum())


def select_features(rows: DataFrame) -> Features:
    """What stands out in the toxic ones of labelled rows."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[toxic > 0].update(features(words_of(text)))
                seen[toxic > 0][""] += 1  # the row itself
        names = list(seen[0].keys() | seen[1].keys())
        columns = [pa.array(names, pa.string()), *(pa.array([s[n] for n in names], pa.int64()) for s in seen)]
        yield pa.record_batch(columns, names=["feature", "clean", "toxic"])

    counts = rows.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    counts = stored(counts.where(f"toxic >= {SUPPORT} OR feature = ''"), "features")
    row = counts.where("feature = ''").first()
    total = np.array([row["clean"], row["toxic"]]) if row else np.zeros(2)
    if not total.all():
        return Features([], np.zeros((0, 2)), total)
    # The same G-squared as in _g2, term by term.
    cells = {"a": "toxic + 0.5D", "b": "clean + 0.5D", "c": f"{total[1]} - toxic + 0.5D", "d": f"{total[0]} - clean + 0.5D"}
    part = "({0}) * ln(({0}) * (a + b + c + d) / (({1}) * ({2})))"
    g2 = "2 * (" + " + ".join(part.format(x, f"a + b" if x in "ab" else "c + d", "a + c" if x in "ac" else "b + d") for x in "abcd") + ")"
    found = (
        counts.where("feature <> ''")
        .selectExpr("feature", "clean", "toxic", *(f"{v} AS {k}" for k, v in cells.items()))
        .selectExpr("feature", "clean", "toxic", f"{g2} AS g2", "a / c > b / d AS more")
        .where(f"more AND g2 >= {SELECT_G2}")
        .orderBy(F.desc("g2"), "feature")
        .limit(SELECTED)
        .collect()
    )
    return Features([r["feature"] for r in found], np.array([[r["clean"], r["toxic"]] for r in found]).reshape(-1, 2), total)


def _covers(general: str, special: str) -> bool:
    """Whether a text with feature ``special`` nearly always has ``general``: the same stem or a longer one."""
    stem, star, _ = general.partition("*")
    return bool(star) and special.startswith(stem)


@dataclass
class LabelModel:
    """Share of toxic texts, voters' rates (clean, toxic), how much voters repeat each other, and the rates of silence."""

    share: float
    rates: np.ndarray
    overlap: np.ndarray
    silence: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        """What a vote weighs if all voters vote."""
        return 1 / (1 + self.overlap.sum(axis=1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability that a text is toxic, for rows of 0/1 votes.

        A vote is shared with the others of its text that it correlates with.
        A lone vote counts whole.
        """
        evidence = (votes / (1 + votes @ self.overlap)) @ np.log(self.rates[:, 1] / self.rates[:, 0])
        evidence = np.where(votes.any(axis=1), evidence, np.log(self.silence[1] / self.silence[0]))
        return 1 / (1 + np.exp(-np.clip(np.log(self.share / (1 - self.share)) + evidence, -50, 50)))


def _votes(found: list[int]) -> int:
    """Votes as bits."""
    out = 0
    for number in found:
        out |= 1 << number
    return out


def _unpacked(combinations: list[bytes], voters: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(combinations), np.uint8).reshape(len(combinations), -1)
    return np.unpackbits(packed, axis=1, bitorder="little")[:, :voters].astype(np.float64)


def combinations(docs: DataFrame, voters: list[str]) -> DataFrame:
    """``votes`` (bits as bytes) and ``n``: the distinct combinations of votes over all texts."""
    size = -(-len(voters) // 8)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(voters)
        for batch in batches:
            seen = Counter(_votes(reader(text)) for text in batch.column(0).to_pylist())
            votes = pa.array([bits.to_bytes(size, "little") for bits in seen], pa.binary())
            yield pa.record_batch([votes, pa.array(seen.values(), pa.int64())], names=["votes", "n"])

    return texts(docs).select("text").mapInArrow(count, "votes binary, n long").groupBy("votes").agg(F.sum("n").alias("n"))


def first_model(known: Features) -> LabelModel:
    """What the labelled rows' counts alone say, as if voters were independent."""
    rates = np.clip((known.rows + 0.5) / (known.total + 1), 1e-7, 1 - 1e-7)
    silence = np.clip(np.prod(1 - rates, axis=0), 1e-7, 1)
    return LabelModel(float(known.total[1] / known.total.sum()), rates, np.zeros((len(rates), len(rates))), silence)


def fit_label_model(votes: DataFrame, known: Features, rounds: int = ROUNDS) -> LabelModel:
    """Expectation maximisation over stored combinations, from the voters' counts in the labelled rows.

    Every round sums, for each class, the posterior weight of every voter, of
    every pair of voters, and of silence: a fixed number of sums, whatever the
    input.
    """
    voters, model = len(known.names), first_model(known)
    width = voters + 2
    for _ in range(rounds):

        def sums(batches: Iterable[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, width, width))
            for batch in batches:
                if not batch.num_rows:
                    continue
                seen = _unpacked(batch.column(0).to_pylist(), voters)
                n = batch.column(1).to_numpy()
                toxic = model.posterior(seen)
                # Silence, and ones: their products are the single sums and the weight of the class.
                wide = np.hstack([seen, ~seen.any(axis=1, keepdims=True), np.ones((len(seen), 1))])
                for side, weight in enumerate((n * (1 - toxic), n * toxic)):
                    total[side] += wide.T @ (wide * weight[:, None])
            flat = total.ravel()
            yield pa.record_batch([pa.array(np.arange(len(flat))), pa.array(flat)], names=["cell", "value"])

        # 2 * (voters + 2) ** 2 rows.
        found = votes.mapInArrow(sums, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(2 * width**2)
        for row in found:
            total[row["cell"]] = row["value"]
        model = maximised(total.reshape(2, width, width), known)
    return model


def maximised(total: np.ndarray, known: Features) -> LabelModel:
    """The model that a round's sums give."""
    total = total * min(1.0, UNLABELLED * known.total.sum() / max(total[:, -1, -1].sum(), 1))
    # The labelled rows count once more, with their labels.
    size = total[:, -1, -1] + known.total
    rates = (total[:, :-2, -1] + known.rows.T + 0.5) / (size[:, None] + 1)
    rates = np.clip(rates, 1e-7, 1 - 1e-7)
    overlap = np.zeros((2, len(known.names), len(known.names)))
    for side in (0, 1):
        together = total[side, :-2, :-2] / max(total[side, -1, -1], 1)
        alone = np.diag(together)
        spread = np.sqrt(alone * (1 - alone)) + 1e-9
        correlation = (together - np.outer(alone, alone)) / np.outer(spread, spread)
        np.fill_diagonal(correlation, 0)
        overlap[side] = np.clip(correlation, 0, 1)
    silence = np.clip((total[:, -2, -1] + 0.5) / (total[:, -1, -1] + 1), 1e-7, 1)
    share = float(np.clip(size[1] / size.sum(), 1e-6, 0.5))
    return LabelModel(share, rates.T, overlap.max(axis=0), silence)


def fit_classifier(rows: DataFrame, selected: Features, voters: Features, model: LabelModel, epochs: int = 12) -> np.ndarray:
    """Weights of the selected features and, last, the intercept, from rows with a ``text``."""
    size = -(-len(voters.names) // 8)
    names, voter_names = selected.names, voters.names

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voting, reader = Reader(voter_names), Reader(names)
        for batch in batches:
            texts_ = batch.column(0).to_pylist()
            votes = pa.array([_votes(voting(t)).to_bytes(size, "little") for t in texts_], pa.binary())
            found = pa.array([sorted(reader(t)) for t in texts_], pa.list_(pa.int32()))
            yield pa.record_batch([votes, found], names=["votes", "found"])

    # At most CLASSIFIER_ROWS rows of selected features.
    sampled = rows.mapInArrow(read, "votes binary, found array<int>").toArrow()
    target = model.posterior(_unpacked(sampled["votes"].to_pylist(), len(voter_names)))
    lists = sampled["found"].combine_chunks()
    starts, found = lists.offsets.to_numpy(), lists.values.to_numpy()
    last = len(names)
    weights, speed = np.zeros(last + 1), np.full(last + 1, 1e-6)
    order = np.random.default_rng(0)
    for _ in range(epochs):
        shuffled = order.permutation(len(target))
        for at in range(0, len(shuffled), 64):
            part = shuffled[at : at + 64]
            lists_ = [np.append(found[starts[r] : starts[r + 1]], last) for r in part]
            every, lengths = np.concatenate(lists_), np.fromiter(map(len, lists_), int)
            log_odds = np.add.reduceat(weights[every], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
            error = 1 / (1 + np.exp(-np.clip(log_odds, -50, 50))) - target[part]
            slope = np.bincount(every, np.repeat(error, lengths), last + 1) / len(part) + 1e-5 * weights
            speed += slope**2
            weights -= 0.2 * slope / np.sqrt(speed)
    return weights


@dataclass
class Classifier:
    """Feature names and their weights, the intercept last; without features every score is 0."""

    names: list[str]
    weights: np.ndarray


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``doc_id, score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = shared.value.names, shared.value.weights
        reader = Reader(names)
        for batch in batches:
            log_odds = np.array([weights[-1] + weights[reader(t)].sum() for t in batch.column(1).to_pylist()])
            out = 1 / (1 + np.exp(-np.clip(log_odds, -500, 500))) if names else np.zeros(batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return texts(docs).mapInArrow(apply, "doc_id long, score double")


def learn(docs: DataFrame, labels: DataFrame) -> Classifier:
    """A classifier from the labels given and the votes on all texts."""
    selected = select_features(labelled(docs, labels))
    voters = selected.voters()
    if not voters.names:
        return Classifier([], np.zeros(1))
    model = fit_label_model(stored(combinations(docs, voters.names), "votes"), voters)
    return Classifier(selected.names, fit_classifier(sample(docs, labels, CLASSIFIER_ROWS), selected, voters, model))
