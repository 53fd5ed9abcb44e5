"""Personal data: fixed patterns, and what bootstrapped contexts find beyond them.

Spans of the fixed patterns are seeds.  The words around a seed are lexical
patterns; so are the words around every other identifier-like run of
characters.  Spark scores the graph of patterns and instances in rounds: a
pattern is worth the share of its instances that are known to be of a kind, an
instance is worth its best pattern.  In later rounds accepted instances count as
known, but not for the pattern they owe that to.  Instances above ``ACCEPT`` are reported wherever
they occur.  So are runs that the fixed patterns take where they stand alone,
and those that are a seed elsewhere: beside other digits they are part of a
longer match that fails.  Seeds keep their kind and no span of theirs changes.

Limits: a run ends at white space.  Of an identifier written in groups with
blanks that no fixed pattern knows, only a group of at least ``DIGITS`` digits
can be found, the rest stays; addresses of IP version 6 and spelled-out e-mail
addresses ("name at host dot org") are not found.

Defined results: a null text is empty; the same value counts once for a
pattern however often copies repeat it; two spans of one place are both
reported; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from fleetgauge.llm.tables import stored

# Kinds in the order of reports.
KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
ACCEPT = 0.8
# An instance has at least so many digits, or an at sign.
DIGITS = 4
# Characters beside a span that are searched for context words.
WINDOW = 64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that ends before a digit or a dot is the longest there, so a later start in the same digits fails as well.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9@]\S*")
_NOT_DIGITS = re.compile("[^0-9]+")

Span = tuple[int, int, int]  # start, end, number of the kind


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their at signs."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and kind."""
    found: list[Span] = [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [part.lstrip("0") or "0" for part in m[0].split(".")]
        if all(len(part) <= 3 and int(part) <= 255 for part in parts):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGITS.sub("", m[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def other_runs(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Identifier-like runs of characters that touch no span of ``taken``."""
    spans = iter(sorted((a, b) for a, b, _ in taken))
    span, last = next(spans, None), 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while start > last and not text[start - 1].isspace():
            start -= 1
        last = end
        while start < end and not text[start].isalnum():
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while span and span[1] <= start:
            span = next(spans, None)
        if span and span[0] < end:
            continue
        run = text[start:end]
        if "@" in run or len(_NOT_DIGITS.sub("", run)) >= DIGITS:
            yield start, end


def kind_alone(run: str) -> int:
    """Kind of a run by the fixed patterns, if one of them takes it whole; otherwise -1."""
    return next((k for a, b, k in base_spans(run) if (a, b) == (0, len(run))), -1)


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a span: one and two words before it, one after, one on each side."""
    left, right = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    # A word that reaches beyond the window is none, however long it is.
    if start > WINDOW and not text[start - WINDOW - 1].isspace():
        left = left.lstrip() if left[:1].isspace() else "".join(left.split(maxsplit=1)[1:])
    if len(text) > end + WINDOW and not any(c.isspace() for c in right.lstrip()):
        right = ""
    before = [w.strip(".,;:!?\"'()[]").lower() for w in left.split()[-2:]]
    after = [w.strip(".,;:!?\"'()[]").lower() for w in right.split()[:1]]
    out = [f"{before[-1]} _"] if before else []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if after:
        out.append(f"_ {after[0]}")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    return out


_SPAN = "struct<start: int, end: int, kind: int>"
_MENTION = "struct<start: int, end: int, kind: int, value: string, patterns: array<string>, alone: int>"


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, base`` (spans) and ``mentions`` (seeds and other runs with their patterns; no kind: -1).

    ``alone`` is the kind that another run has by itself.
    """
    span = [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]
    mention = pa.struct([*span, ("value", pa.string()), ("patterns", pa.list_(pa.string())), ("alone", pa.int32())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, mentions = [], []
            for text in batch.column(2).to_pylist():
                seeds = base_spans(text)
                base.append([{"start": a, "end": b, "kind": k} for a, b, k in seeds])
                every = seeds + [(a, b, -1) for a, b in other_runs(text, seeds)]
                mentions.append(
                    [
                        {
                            "start": a, "end": b, "kind": k, "value": text[a:b].lower(), "patterns": contexts(text, a, b),
                            "alone": k if k >= 0 else kind_alone(text[a:b]),
                        }
                        for a, b, k in every
                    ]
                )
            columns = [batch.column(0), batch.column(1), pa.array(base, pa.list_(pa.struct(span))), pa.array(mentions, pa.list_(mention))]
            yield pa.record_batch(columns, names=["doc_id", "text_hash", "base", "mentions"])

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "xxhash64(coalesce(text, '')) AS text_hash", "coalesce(text, '') AS text")
    return rows.mapInArrow(read, f"doc_id long, text_hash long, base array<{_SPAN}>, mentions array<{_MENTION}>")


def bootstrap(scanned: DataFrame, rounds: int = ROUNDS, accept: float = ACCEPT) -> DataFrame:
    """``value, kind, score`` of instances beyond the seeds that confident patterns discover."""
    mentions = scanned.selectExpr("explode(mentions) AS m").selectExpr("m.value", "m.kind", "m.patterns")
    edges = stored(mentions.selectExpr("value", "kind", "explode(patterns) AS pattern").distinct(), "edges")
    size = edges.groupBy("pattern").agg(F.countDistinct("value").alias("size"))
    seeds = edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.expr("CAST(count(*) AS DOUBLE) AS known"))
    open_edges = edges.where("kind < 0").select("pattern", "value")
    scores = None
    for _ in range(rounds):
        known = seeds
        if scores is not None:
            # A pattern learns from its instances what their other patterns say of them, if that is enough to accept them.
            told = open_edges.join(scores, "value").selectExpr("pattern", "kind", "IF(pattern = by, second, score) AS told")
            grown = told.where(F.col("told") >= accept).groupBy("pattern", "kind").agg(F.sum("told").alias("known"))
            known = seeds.unionByName(grown).groupBy("pattern", "kind").agg(F.sum("known").alias("known"))
        # One instance more than there are: a pattern needs several to be worth anything.
        worth = known.join(size, "pattern").selectExpr("pattern", "kind", "known / (size + 1) AS worth")
        placed = "row_number() OVER (PARTITION BY value, kind ORDER BY worth DESC, pattern) AS place"
        best = open_edges.join(worth, "pattern").selectExpr("*", placed).where("place <= 2")
        scores = stored(
            best.groupBy("value", "kind").agg(
                F.expr("max(worth) AS score"),
                F.expr("min_by(pattern, place) AS by"),
                F.expr("coalesce(max(worth) FILTER (WHERE place = 2), 0D) AS second"),
            ),
            "instances",
        )
    # A value has the kind it scores highest in, the first one listed on a tie.
    top = scores.groupBy("value").agg(F.expr("max_by(struct(kind, score), struct(score, -kind)) AS top"))
    return top.selectExpr("value", "top.kind", "top.score").where(F.col("score") >= accept)


def valid_elsewhere(scanned: DataFrame) -> DataFrame:
    """``value, kind`` of other runs that are valid alone, or a seed somewhere."""
    every = scanned.selectExpr("explode(mentions) AS m").where("m.alone >= 0").selectExpr("m.value", "m.alone AS kind")
    return every.groupBy("value").agg(F.min("kind").alias("kind"))


def discovered(scanned: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of accepted instances for each row of ``scanned`` that has any."""
    runs = scanned.select(*keys, F.explode("mentions").alias("m")).where("m.kind < 0")
    runs = runs.select(*keys, "m.start", "m.end", "m.value")
    return (
        runs.join(accepted.select("value", "kind"), "value")
        .groupBy(*keys)
        .agg(F.expr("collect_list(struct(start, end, kind)) AS added"))
    )


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, base, added``: one row per document, spans of the fixed patterns and of the method."""
    # Read once for the graph and once for the spans; rows are told apart by a number given when they are stored.
    scanned = stored(scan(docs).withColumn("row_id", F.monotonically_increasing_id()), "scanned")
    certain = valid_elsewhere(scanned)
    found = bootstrap(scanned).select("value", "kind").join(certain, "value", "left_anti").unionByName(certain)
    added = discovered(scanned, found, ["row_id"])
    none = F.expr(f"CAST(array() AS array<{_SPAN}>)")
    return scanned.join(added, "row_id", "left").select(
        "doc_id", "text_hash", "base", F.coalesce("added", none).alias("added")
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and ``n_chars`` of the new text if there is one."""
    found = find(docs).selectExpr("doc_id AS span_id", "text_hash AS span_hash", "concat(base, added) AS spans")
    # Rows that agree in id and text have the same spans.
    found = found.where("size(spans) > 0").dropDuplicates(["span_id", "span_hash"])
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(F.expr("CAST(doc_id AS BIGINT) AS own_id"), F.expr("xxhash64(coalesce(text, '')) AS own_hash"), row)
    same = rows["own_id"].eqNullSafe(found["span_id"]) & (rows["own_hash"] == found["span_hash"])
    spanned = rows.join(found, same, "left").select("row", F.col("row.text").alias("text"), "spans")
    schema = T.StructType([spanned.schema["row"], T.StructField("masked", T.StringType())])

    def mask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [
                t if not spans else masked(t, [(s["start"], s["end"], s["kind"]) for s in spans])
                for t, spans in zip(texts, batch.column(2).to_pylist())
            ]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["row", "masked"])

    replaced = spanned.mapInArrow(mask, schema)
    new = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        length = F.when(F.col("masked") == F.col("row.text"), F.col("row.n_chars")).otherwise(F.char_length("masked"))
        new["n_chars"] = F.coalesce(length, F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return replaced.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def masked(text: str, spans: list[Span]) -> str:
    """Spans replaced by the kind; spans that overlap become one, of the first one's kind."""
    out, done = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], s[2])):
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def listed(spans: str) -> str:
    """SQL of spans as ``kind:start:end``, by start and kind."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    parts = "concat_ws(':', get(array({0}), s.kind), s.start, s.end)".format(names)
    ordered = f"array_sort(transform({spans}, s -> struct(s.start AS start, s.kind AS kind, s.end AS end)))"
    return f"concat_ws(',', transform({ordered}, s -> {parts}))"
