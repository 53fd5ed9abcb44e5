"""Every operator against a brute-force version, an exact round trip or held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL_DIR
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fleetgauge.llm import (
    bpe, chat, components, exact_dedup, fingerprint, language, packing, packing_plan, pii, queries, sharding, simhash,
    tables, tokens, toxicity,
)

PIECES = st.lists(
    st.sampled_from(["1", "25", "000", ".", ".", "@", "-", "+", " ", "(", ")", "a", "b%", "é", "_", "x.y", "@a.b", "1.2.3.4",
                     "256.1.1.1", "4111111111111111", "+1 (017) 555-7713", "٣"]), max_size=25,
).map("".join)


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.fixture(scope="module")
def awkward_docs(spark, awkward):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{awkward}/documents.parquet").collect()]


# 1: personal data


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    emails = re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text) if "@" in text else ()
    out = [(m.start(), m.end(), 0) for m in emails]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isascii() and c.isdigit()][::-1]
        total = sum(d if i % 2 == 0 else d * 2 // 10 + d * 2 % 10 for i, d in enumerate(digits))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), m.end(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=400, deadline=None)
@given(PIECES)
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_spans_of_long_runs():
    for text in ("1" * 200_000, "a." * 100_000 + "@", "+1" + " " * 100_000, "0" * 9000 + ".1.2.3", "@" * 50_000):
        assert pii.base_spans(text) == ([(0, 9006, 1)] if text.endswith(".1.2.3") else [])


def test_report_of_spans(spark, awkward, awkward_docs):
    expected = Counter()
    for doc_id, text in awkward_docs:
        spans = plain_spans(text)
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in spans)
        expected[(doc_id, *(sum(s[2] == k for s in spans) for k in range(4)), sha(listed), listed)] += 1
    assert Counter(map(tuple, queries.op1_pii(spark, awkward).collect())) == expected


def test_contexts_discover_what_patterns_miss(spark):
    rows = [(i, f"write to {'abcdefgh'[i % 8]}{i}@mail.org or phone extension +1 555 010 {1000 + i} today") for i in range(40)]
    rows += [(100, "phone extension 0049-1234-567 today"), (101, "in the year 12345 something happened")]
    found = {r["doc_id"]: r["added"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["start"], s["end"], s["kind"]) for s in found[100]] == [(16, 29, 3)]
    assert not any(found[i] for i in [*range(40), 101])


def found_in(spark, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: sorted((s["start"], s["end"], s["kind"]) for s in r["added"]) for r in pii.find(rows).collect()}
    return [found[i] for i in range(len(texts))]


@pytest.mark.parametrize("seeds, accepted", [(6, False), (9, True)])
def test_a_context_does_not_feed_itself(spark, seeds, accepted):
    """Of ten values after the same two words so many are seeds; the others have no other context."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    texts = [f"{w} mailto contact {w}@mail.org {w}x" if i < seeds else f"{w} mailto contact {w}@intranet {w}x" for i, w in enumerate(words)]
    found = found_in(spark, texts)
    assert [bool(f) for f in found] == [False] * seeds + [accepted] * (10 - seeds)


def test_runs_that_are_valid_alone_or_elsewhere(spark):
    card, other = "4465758382889437", "4111111111111111"
    texts = [f"{card} {card}", f"pay {other}1 or {card} {other} now", "call +15550100123 or 5550100123", f"number {card[:-1]}8 {card[:-1]}8"]
    assert found_in(spark, texts) == [[(0, 16, 2), (17, 33, 2)], [(25, 41, 2), (42, 58, 2)], [], []]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert pii.redact(docs).where("doc_id = 0").first()["text"] == "[CARD] [CARD]"


@pytest.mark.parametrize("n", range(50, 75))
def test_contexts_hold_whole_words(n):
    text = f"{'w' * n} to 12345 {'v' * n} x"
    at = text.index("12345")
    assert {w for p in pii.contexts(text, at, at + 5) for w in p.split()} <= {*text.split(), "_"}
    assert "to _" in pii.contexts(text, at, at + 5)


# 2: fingerprints


def weighted_jaccard(a: str, b: str) -> float:
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    total = sum(max(x[w], y[w]) for w in x.keys() | y.keys())
    return sum(min(x[w], y[w]) for w in x.keys() & y.keys()) / total if total else 1.0


def test_likeness_estimates_generalised_jaccard(spark):
    docs = {r["doc_id"]: r["text"] for r in tables.table(spark, SMALL_DIR, "documents").collect()}
    order = sorted(docs, reverse=True)
    errors = []
    for row in queries.op2_fingerprints(spark, SMALL_DIR).collect():
        text = docs[row["doc_id"]]
        following = docs[order[(order.index(row["doc_id"]) + 1) % len(order)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), sha(edited))
        errors.append((row["near_edited"] - weighted_jaccard(text, edited), row["near_next"] - weighted_jaccard(text, following)))
    errors = np.array(errors)
    assert np.abs(errors.mean(axis=0)).max() < 0.02 and np.sqrt((errors**2).mean(axis=0)).max() < 0.11


def test_weights_count_and_equal_texts_agree(spark):
    texts = ["a", "a a a a", "b c", "c b", "", " ", "a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    printed = {r["k"]: r["fingerprint"] for r in fingerprint.fingerprints(rows, ["k"], 512).collect()}
    assert printed[2] == printed[3] and printed[4] == printed[5] and printed[0] == printed[6]
    same = np.mean([printed[0][i : i + 4] == printed[1][i : i + 4] for i in range(0, 2048, 4)])
    assert abs(same - 0.25) < 0.08  # one occurrence of four


def test_texts_are_shuffled_by_one_job(spark, awkward):
    """Fingerprints and digests of edited texts come from one job: what is left to do reads no text."""
    plan = queries.op2_fingerprints(spark, awkward)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "edited_sha256" in plan


# 3: SimHash


def test_fingerprint_bits():
    from xxhash import xxh64_intdigest

    def brute(text: str) -> int:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    texts = ["", " \t", "a", "A b", "a B c", "a b c d", "É é\xa0x y\x1fz w", "x " * 700, " ".join(map(str, range(70_000)))]
    assert [simhash.fingerprint(t.encode()) for t in texts] == [brute(t) for t in texts]


@pytest.mark.parametrize("distance, segments", [(3, 2), (3, 4), (1, 2)])
def test_links_are_all_pairs_within_the_distance(spark, distance, segments):
    order = random.Random(5)
    prints = set()
    for _ in range(60):
        base = order.getrandbits(64)
        for _ in range(6):
            prints.add(base)
            base ^= 1 << order.randrange(64)
    prints |= {0, (1 << 64) - 1, 7}
    nodes = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fp long")
    found = {tuple(r) for r in simhash.links(nodes, distance, segments).collect()}
    signed = sorted(p - (p >> 63 << 64) for p in prints)
    mask = (1 << 64) - 1
    assert found == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & mask).bit_count() <= distance}


def union(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    order = random.Random(2)
    edges = [(i, i + 1) for i in range(1, 60)] + [(500, n) for n in range(501, 540)]
    edges += [(order.randrange(1000, 1200), order.randrange(1000, 1200)) for _ in range(120)] + [(7, 7)]
    edges = [(b, a) if order.random() < 0.5 else (a, b) for a, b in edges]
    expected = union(edges, {n for e in edges for n in e if e[0] != e[1]})
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in found} == expected and len(found) == len(expected)


def test_component_of_every_document(spark):
    docs = {r["doc_id"]: simhash.fingerprint(r["text"].encode()) for r in tables.table(spark, SMALL_DIR, "documents").collect()}
    ids = sorted(docs)
    near = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (docs[a] ^ docs[b]).bit_count() <= 3]
    expected = union(near, ids)
    found = queries.op3_simhash(spark, SMALL_DIR).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {
        i: (f"{docs[i]:016x}", expected[i]) for i in ids
    }


# 4: exact duplicates


def test_colliding_hashes_are_told_apart_by_bytes(spark):
    rows = [(i, f"text {i % 5}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def weak(text):
        return F.lit("one digest")

    found = exact_dedup.exact_groups(docs, weak).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in found} == {(i, 25 + i % 5, 6) for i in range(30)}
    assert sorted(r["doc_id"] for r in exact_dedup.distinct_texts(docs, weak).collect()) == [25, 26, 27, 28, 29]


# 5: toxicity


@pytest.fixture(scope="module")
def insulting(spark):
    order = random.Random(4)
    insults = ["zorble", "gnarfle", "blix", "quonk"]
    plain = [f"word{n}" for n in range(300)]
    docs, labels = [], []
    for i in range(900):
        words = [order.choice(plain) for _ in range(order.randrange(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(order.randrange(1, 5)):
                stem = order.choice(insults)
                words.insert(order.randrange(len(words)), stem if stem != "quonk" else f"quonk{order.choice('abcdef')}x")
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_toxic_documents_are_found(insulting):
    docs, labels = insulting
    classifier = toxicity.learn(docs, labels.where("doc_id % 3 = 0"))
    scored = toxicity.score(docs, classifier).join(labels, "doc_id").where("doc_id % 3 <> 0").collect()
    hits = [(r["score"] >= 0.5, r["toxic"] == 1) for r in scored]
    assert sum(p and t for p, t in hits) >= 0.9 * sum(t for _, t in hits)
    assert sum(p and not t for p, t in hits) <= 2


def test_voters_that_repeat_each_other_weigh_less(spark):
    # Votes 0 and 1 are always the same, vote 2 is on its own; 3 bits.
    order = random.Random(0)
    seen = Counter()
    for i in range(4000):
        toxic = i % 5 == 0
        a, b = (order.random() < (0.7 if toxic else 0.02) for _ in range(2))
        seen[bytes([a + 2 * a + 4 * b])] += 1
    votes = spark.createDataFrame(list(seen.items()), "votes binary, n long")
    sample = toxicity.Features(["a", "a2", "b"], np.array([[2, 15], [2, 15], [2, 15]]), np.array([80, 20]))
    model = toxicity.fit_label_model(votes, sample)
    assert abs(model.share - 0.2) < 0.05
    assert model.weights[0] < 0.7 and model.weights[2] > 0.8
    assert abs(model.rates[2, 1] - 0.7) < 0.12 and model.rates[2, 0] < 0.1


def drawn_votes(texts: int = 6000, copies: int = 3, same=(0.1, 0.3), own=(0.01, 0.3)):
    """Votes of ``copies`` voters that say the same and two on their own, with the truth; one byte a text."""
    order = random.Random(3)
    votes, truth = [], []
    for i in range(texts):
        toxic = i % 4 == 0
        a = order.random() < same[toxic]
        b, c = (order.random() < own[toxic] for _ in range(2))
        votes.append([int(a)] * copies + [int(b), int(c)])
        truth.append(toxic)
    return np.array(votes, float), np.array(truth)


def known_rows(votes, truth) -> "toxicity.Features":
    rows = np.stack([votes[~truth].sum(axis=0), votes[truth].sum(axis=0)], axis=1)
    return toxicity.Features([f"v{i}" for i in range(votes.shape[1])], rows, np.array([(~truth).sum(), truth.sum()]))


def stored_votes(spark, votes):
    seen = Counter(np.packbits(row.astype(np.uint8), bitorder="little").tobytes() for row in votes)
    return spark.createDataFrame([(bytearray(v), n) for v, n in seen.items()], "votes binary, n long")


def test_label_model_equals_expectation_maximisation_text_by_text(spark):
    votes, truth = drawn_votes(900)
    known = known_rows(votes[:90], truth[:90])
    got = toxicity.fit_label_model(stored_votes(spark, votes), known, rounds=4)

    voters = votes.shape[1]
    share, rates = known.total[1] / known.total.sum(), (known.rows + 0.5) / (known.total + 1)
    overlap, silence = np.zeros((voters, voters)), np.prod(1 - rates, axis=0)
    for _ in range(4):
        toxic = []
        for row in votes:
            odds = share / (1 - share)
            for i in np.flatnonzero(row):
                odds *= (rates[i, 1] / rates[i, 0]) ** (1 / (1 + sum(overlap[i, j] for j in np.flatnonzero(row))))
            odds *= 1 if row.any() else silence[1] / silence[0]
            toxic.append(odds / (1 + odds))
        toxic = np.array(toxic)
        overlap = np.zeros((voters, voters))
        weights = [1 - toxic, toxic]
        for side, w in enumerate(weights):
            for i in range(voters):
                for j in range(voters):
                    if i != j:
                        x, y = (np.average(votes[:, k], weights=w) for k in (i, j))
                        both = np.average(votes[:, i] * votes[:, j], weights=w)
                        spread = (np.sqrt(x * (1 - x)) + 1e-9) * (np.sqrt(y * (1 - y)) + 1e-9)
                        overlap[i, j] = max(overlap[i, j], min(1, (both - x * y) / spread))
        part = 90 / 900  # all texts weigh as much as the labelled ones
        size = [part * w.sum() + t for w, t in zip(weights, known.total)]
        counts = [part * (votes * w[:, None]).sum(axis=0) + r for w, r in zip(weights, known.rows.T)]
        rates = np.stack([(c + 0.5) / (n + 1) for c, n in zip(counts, size)], axis=1)
        silence = [(part * w[~votes.any(axis=1)].sum() + 0.5) / (part * w.sum() + 1) for w in weights]
        share = size[1] / sum(size)
    assert np.allclose(got.rates, rates, atol=1e-6) and np.allclose(got.overlap, overlap, atol=1e-6)
    assert np.allclose(got.silence, silence, atol=1e-6) and abs(got.share - share) < 1e-6


@pytest.mark.parametrize("same, own", [((0.1, 0.3), (0.01, 0.3)), ((0.2, 0.5), (0.03, 0.6))])
def test_correlated_model_beats_the_independent_one(spark, monkeypatch, same, own):
    votes, truth = drawn_votes(same=same, own=own)
    known = known_rows(votes[:400], truth[:400])
    model = toxicity.fit_label_model(stored_votes(spark, votes), known)
    step = toxicity.maximised
    independent = lambda total, known: replace(step(total, known), overlap=np.zeros((5, 5)))
    monkeypatch.setattr(toxicity, "maximised", independent)
    alone = toxicity.fit_label_model(stored_votes(spark, votes), known)
    loss = [np.mean((m.posterior(votes) - truth) ** 2) for m in (model, alone)]
    assert loss[0] < 0.8 * loss[1]
    # Three votes that are one count as little more than it, a lone vote counts whole.
    three, own = np.array([[1, 1, 1, 0, 0]]), np.array([[0, 0, 0, 1, 0]])
    assert model.posterior(three)[0] < 0.6 and alone.posterior(three)[0] > 0.9
    odds = model.share / (1 - model.share) * model.rates[3, 1] / model.rates[3, 0]
    assert abs(model.posterior(own)[0] - odds / (1 + odds)) < 1e-9


def test_label_model_changes_scores(spark):
    """A clean row labelled toxic, without a voter's word, is not learned; labels enter by the voters' counts alone."""
    docs = [(i, f"plain{i % 7} words{i % 5} here" + (" zorble gnarfle" if i % 4 == 0 else "")) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0 or i in (1, 2, 3))) for i in range(400)], "doc_id long, toxic int")
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(frame, toxicity.learn(frame, labels)).collect()}
    assert min(scored[i] for i in range(0, 400, 4)) > 0.9
    assert max(s for i, s in scored.items() if i % 4) < 0.1


def test_features_are_chosen_from_all_labelled_rows(spark, monkeypatch):
    """A term in a few rows becomes a feature, however few rows the classifier is fitted on."""
    monkeypatch.setattr(toxicity, "CLASSIFIER_ROWS", 50)
    docs = [(i, f"plain{i % 7}" + (" blixig" if i % 100 == 0 else " zorble" if i % 5 == 1 else "")) for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = frame.selectExpr("doc_id", "IF(doc_id % 100 = 0 OR doc_id % 5 = 1, 1, 0) AS toxic")
    found = toxicity.select_features(toxicity.labelled(frame, labels))
    assert "blixig" in found.names and found.total.tolist() == [2370, 630]
    assert toxicity.sample(frame, labels, 50).count() == 50


def test_few_labels_are_joined_as_many_are(spark):
    """Labels are not broadcast when they are few, and texts without one are left at the scan."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2000)] + [(None, "no id"), (7, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 0), (7, 1), (8, 0), (None, 1), (9, None), (5000, 1)], "doc_id long, toxic int")
    found = toxicity.labelled(docs, labels)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted((r["text"], r["toxic"]) for r in found.collect()) == [("again", 1), ("text 7", 1), ("text 8", 0)]
    known = labels.where("doc_id IS NOT NULL")
    assert toxicity.may_be_among(docs, known, ["doc_id"], toxicity.FILTER_WORDS).count() < 20


def test_without_labels_nothing_is_toxic(spark, insulting):
    docs, labels = insulting
    assert toxicity.score(docs, toxicity.learn(docs, labels.where("false"))).agg(F.max("score")).first()[0] == 0


# 6: packing


@pytest.fixture(scope="module")
def word_tokenizer():
    return packing.read_tokenizer(queries.TOKENIZER)


TEXTS = st.lists(
    st.sampled_from(["'", "s", "S", "'LL", "É", "ß", "İ", "Σ", "²", "1", "-", " ", "\t", "\x1c", "\xa0", "é", "漢", "<|endoftext|>",
                     "<|", "|>", "<|ENDOFTEXT|>", "ǆ", "Ǆ", "ſ", "̀", "\x85", "\x00", "word", "Other"]), max_size=20,
).map("".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_ids_are_those_of_the_tokenizer(text):
    global _RUNS, _WHOLE
    if "_RUNS" not in globals():
        from tokenizers import Tokenizer

        source = packing.read_tokenizer(queries.TOKENIZER)
        _RUNS, _WHOLE = tokens.RunIds(source), Tokenizer.from_str(source)
    expected = _WHOLE.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(_RUNS.of_text(text.encode()), "<u4").tolist() == expected


def test_knapsack_finds_the_best_configuration():
    order = np.random.default_rng(1)
    for _ in range(20):
        sizes = np.sort(order.choice(np.arange(1, 15), 4, replace=False))
        prices = order.random(4)
        found = packing_plan.best_configuration(prices, sizes, 20)
        assert sum(sizes[i] * n for i, n in found.items()) <= 20
        best = np.zeros(21)
        for room in range(1, 21):
            best[room] = max([best[room - 1], *(best[room - s] + p for s, p in zip(sizes, prices) if s <= room)])
        assert abs(sum(prices[i] * n for i, n in found.items()) - best[20]) < 1e-9


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_item_in_few_bins(seed):
    order = np.random.default_rng(seed)
    lengths = np.concatenate([order.integers(1, 4097, 3000), order.integers(1, 200, 500), np.full(50, 4096), np.full(900, 1366)])
    counts = np.bincount(lengths, minlength=4097)
    patterns = packing_plan.plan(counts, 4096, steps=300)
    held = np.zeros(4097, int)
    for items, bins in patterns:
        assert sum(length * n for length, n in items) <= 4096 and bins > 0
        for length, n in items:
            held[length] += n * bins
    assert (held == counts).all()
    plain = sum(bins for _, bins in packing_plan.best_fit(counts.copy(), [], 4096))
    assert sum(bins for _, bins in patterns) <= plain


def lengths_of(kind: str, order) -> np.ndarray:
    if kind == "uniform":
        return order.integers(1, 4097, 20_000)
    if kind == "log-normal":
        return np.clip(np.exp(order.normal(6.5, 1, 20_000)), 1, 4096).astype(int)
    return order.integers(1000, 1801, 9_000)


@pytest.mark.parametrize("kind", ["uniform", "log-normal", "1000 to 1800"])
def test_plan_is_never_worse_than_best_fit_nor_below_its_bound(kind):
    counts = np.bincount(lengths_of(kind, np.random.default_rng(7)), minlength=4097)
    patterns, bound = packing_plan.plan_and_bound(counts, 4096)
    bins = sum(n for _, n in patterns)
    assert bins <= sum(n for _, n in packing_plan.best_fit(counts.copy(), [], 4096))
    assert bound <= bins


def test_bound_tells_what_lengths_alone_do_not():
    """Items of a third and a bit go by twos."""
    counts = np.zeros(4097, int)
    counts[1400] = 1000
    patterns, bound = packing_plan.plan_and_bound(counts, 4096, steps=50)
    assert sum(n for _, n in patterns) == 500 and 499.9 < bound < 500.1
    assert packing_plan.plan_and_bound(np.zeros(4097, int), 4096) == ([], 0.0)
    counts[:] = 0
    counts[4096] = 3
    assert packing_plan.plan_and_bound(counts, 4096) == ([(((4096, 1),), 3)], 3.0)


def test_pieces_and_sequences(spark, awkward, awkward_docs, word_tokenizer):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(word_tokenizer)
    expected = Counter()
    for doc_id, text in awkward_docs:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            expected[(doc_id, piece, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    rows = queries.op6_packing(spark, awkward).collect()
    assert Counter(tuple(r)[:5] for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(r["length"] for r in rows) // 4096) + 1


# 7: byte-level BPE


def test_ids_and_bytes_of_awkward_texts(spark, awkward, awkward_docs, monkeypatch):
    encoding = bpe._encoding(bpe.read_ranks(queries.RANKS), public_tokenizers.PATTERN)
    expected = Counter()
    for doc_id, text in awkward_docs:
        ids = encoding.encode_ordinary(text)
        expected[(doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text))] += 1
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 1000)
    assert Counter(map(tuple, queries.op7_bpe(spark, awkward).collect())) == expected


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB1'sl é²ß\t\n\x1c\x85\xa0 　漢😀!-_")), max_size=30))
def test_cutting_matches_the_library(text):
    encoding = bpe._encoding(bpe.read_ranks(queries.RANKS), public_tokenizers.PATTERN)
    parts = bpe.pre_tokenizer(public_tokenizers.PATTERN)(text)
    assert "".join(parts) == text
    assert [i for p in parts for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


# 8: language


def test_held_out_languages(spark):
    docs = {r["doc_id"]: r["lang"] for r in tables.table(spark, SMALL_DIR, "documents").collect()}
    rows = [r for r in queries.op8_language(spark, SMALL_DIR).collect() if r["held_out"]]
    assert {r["doc_id"] for r in rows} == {i for i in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == docs[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_spans_and_scripts(spark, awkward):
    docs = tables.table(spark, awkward, "documents")
    model = language.learn(docs)
    words = language.Words(model)
    english = "the quick brown fox jumps over the lazy dog"
    german = "der schnelle braune fuchs springt ueber den faulen hund"
    lang, score, spans = language.identify_text(f"{english} {german} {german}", words)
    assert lang == "de" and [s[2] for s in spans] == ["en", "de"] and spans[0][:2] == (0, 8) and spans[1][:2] == (9, 26)
    assert 0.5 < score < 0.75
    for text in ("", " \n", "12 !!"):
        assert language.identify_text(text, words) == ("und", 0.0, [])
    assert language.identify_text("только русский", words)[:2] == (model.languages[0], 0.0)


def test_best_path_by_enumeration():
    from itertools import product

    order = np.random.default_rng(3)
    for _ in range(60):
        scores = order.normal(0, 4, (6, 3))
        switch = float(order.choice([0.5, 3.0, 8.0]))

        def worth(path, scores=scores, switch=switch):
            return sum(scores[i, p] for i, p in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))

        assert abs(worth(language.label_words(scores, switch)) - max(map(worth, product(range(3), repeat=6)))) < 1e-6


@pytest.mark.parametrize("text", ["²", "½ ¼", "Ⅷ", "①", "12 ³ 4", "ⅷⅸ ٣"])
def test_numerals_are_no_letters(spark, text):
    model = language.Model(["de", "en"], np.zeros((2, 2 * language.BUCKETS), np.float32), np.ones((2, len(language._NAMES)), bool))
    docs = spark.createDataFrame([(1, text), (2, text + " wort")], "doc_id long, text string")
    found = {r["row"]["doc_id"]: r["language"] for r in language.identify(docs, model).collect()}
    assert (found[1]["lang_pred"], found[1]["score"]) == ("und", 0.0) and found[2]["lang_pred"] in ("de", "en")
    assert docs.where(r"text RLIKE '\\p{L}'").count() == 1


# 9: chats

CHATS = st.lists(
    st.tuples(
        st.sampled_from(["system", "user", "assistant", "tool", "", "[:]"]),
        st.lists(st.sampled_from(["[INST]", "[/INST]", "[\\INST]", "</s>", "<s>", "[", "<", "\\", "[SYS]", "[TURN]", "[:]", "[/TURN]",
                                  "]", ">", "s>", "INST]", "a\n", "é"]), max_size=8).map("".join),
    ), min_size=1, max_size=30,
)


@settings(max_examples=15, deadline=None)
@given(CHATS)
def test_round_trip_of_control_strings(spark, turns):
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    chats = chat.format_chats(rows)
    made = chats.first()
    assert [tuple(t) for t in made["turns"]] == turns
    read = chat.read_back(chats).first()
    loss = "".join(t for r, t in turns if r == "assistant")
    assert read["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns))
    assert (read["loss_chars"], read["loss_sha256"]) == (len(loss), sha(loss))
    bare = re.findall(r"\[/?(?:SYS|INST)\]|</?s>", made["formatted"])
    assert len(bare) == 2 * sum(r in chat.MARKERS for r, _ in turns)  # markers only


# 10: shards


@pytest.mark.parametrize("total", [1, 2, 3, 24, 25, 97, 1000, 4097])
def test_places_are_a_permutation(spark, total):
    numbered = spark.range(total).selectExpr("id AS row_number", f"{total}L AS total")
    places = [r["place"] for r in sharding.shuffled(numbered, 7).orderBy("row_number").collect()]
    assert sorted(places) == list(range(total))
    if total >= 97:
        assert sum(a == b for a, b in enumerate(places)) < 10 and places != [
            r["place"] for r in sharding.shuffled(numbered, 8).orderBy("row_number").collect()
        ]


def test_shards_are_even_and_reproducible(spark):
    docs = tables.table(spark, SMALL_DIR, "documents")
    first = sorted(map(tuple, sharding.shard(docs, 7).collect()))
    again = sorted(map(tuple, sharding.shard(docs.repartition(5, "source"), 7).collect()))
    assert first == again
    slots = defaultdict(list)
    for doc_id, size, crc, _, shard, slot in first:
        slots[shard].append(slot)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 7
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert all((size, crc) == (len(texts[i]) + 8, zlib.crc32(texts[i])) for i, size, crc, *_ in first)
