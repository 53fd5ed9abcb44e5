"""Quality rules: statistics of a text, and lines that a host repeats on many pages.

The statistics of a text look at that text alone.  The verdict beyond them
comes from all documents: lines are normalised (lower case, white space
squeezed, numbers read as 0) and hashed, the distinct documents of a host that
hold a line are counted, and lines in more than ``LEAST_DOCUMENTS`` documents
and ``PER_MILLE`` of the host's are taken out.  A document of which less than
``REMAINING`` percent of its words remain is rejected.

Copies are one document: what is counted is distinct texts.  A text is read
once; what follows works on hashes of 128 bits.  Windows of words are compared
by hashes of 64 bits within one text.

Defined results: a null text is empty and fails the base rules; a null host is
a host; lines without words are never counted nor removed; rows that repeat an
id are judged each on its own; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fleetgauge.llm.tables import stored

# Fixed values of the base rules.
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of words
_SPACE = r"[ \\t-\\x0D]"
_SYMBOLS = r"[#*$%&|<>]"

LEAST_DOCUMENTS = 10
PER_MILLE = 1
REMAINING = 30


def normalised(text: str) -> str:
    """SQL of a text whose lines are normalised; a line break keeps no blanks beside it."""
    squeezed = rf"regexp_replace({text}, '[ \\t\\x0B-\\x0D]+', ' ')"
    return rf"trim(BOTH ' ' FROM lower(regexp_replace({squeezed}, '[0-9]+', '0')))"


def scan(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: its statistics, the hash of its text, and its lines' hashes with their words."""
    rows = docs.selectExpr(
        "CAST(doc_id AS BIGINT) AS doc_id",
        f"CAST(`{host}` AS STRING) AS host",
        "coalesce(text, '') AS text",
        "monotonically_increasing_id() AS row_id",
    )
    split = rows.selectExpr(
        "*",
        f"filter(split(text, '{_SPACE}+'), w -> w <> '') AS words",
        f"filter(split(text, '\\\\n'), l -> l RLIKE '[^ \\\\t-\\\\x0D]') AS lines",
        f"filter(split({normalised('text')}, ' ?\\\\n ?'), l -> l <> '') AS plain",
    )
    hashed = split.selectExpr("*", "transform(words, w -> xxhash64(w)) AS h1")
    # Hashes of 2, 4 and 8 words in a row; those that reach beyond the end are cut off last.
    for n in (1, 2, 4):
        pairs = f"zip_with(h{n}, slice(h{n}, {n + 1}, size(h{n})), (a, b) -> xxhash64(a, b)) AS h{2 * n}"
        hashed = hashed.selectExpr(*(c for c in hashed.columns if c != f"h{n}"), pairs)
    windows = hashed.selectExpr("*", f"slice(h8, 1, greatest(size(h8) - {WINDOW - 1}, 0)) AS w8").drop("h8")
    # Only a text that repeats a window sorts its windows; neighbours of one hash are the repeated ones.
    ordered = "sort_array(transform(w8, (h, i) -> struct(h, i)))"
    sorted_ = windows.selectExpr("*", f"IF(size(array_distinct(w8)) = size(w8), NULL, {ordered}) AS s").drop("w8")
    twice = "flatten(array_compact(zip_with(s, slice(s, 2, size(s)), (a, b) -> IF(a.h = b.h, array(a.i, b.i), NULL))))"
    covered = (
        f"coalesce(aggregate(sort_array({twice}), struct(0L AS n, 0L AS till),"
        f" (c, i) -> struct(c.n + i + {WINDOW} - greatest(c.till, CAST(i AS BIGINT)) AS n, CAST(i + {WINDOW} AS BIGINT) AS till)).n, 0L)"
    )
    return sorted_.selectExpr(
        "row_id",
        "doc_id",
        "host",
        "unhex(md5(text)) AS digest",
        "CAST(size(words) AS BIGINT) AS n_words",
        "CAST(char_length(array_join(words, '')) AS BIGINT) AS word_chars",
        f"CAST(regexp_count(text, '{_SYMBOLS}') AS BIGINT) AS n_symbols",
        "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT) AS n_dup_lines",
        f"{covered} AS n_repeat_words",
        "transform(plain, l -> struct(unhex(md5(l)) AS line, size(split(l, ' ')) AS words)) AS lines",
    )


def frequent_lines(scanned: DataFrame) -> DataFrame:
    """``host, line`` of the lines above both limits."""
    texts = scanned.select("host", "digest").distinct()
    hosts = texts.groupBy("host").agg(F.expr("count(*) AS documents"))
    held = scanned.selectExpr("host", "digest", "explode(lines.line) AS line").distinct()
    counts = held.groupBy("host", "line").agg(F.expr("count(*) AS n")).where(f"n > {LEAST_DOCUMENTS}")
    of_host = counts.join(hosts.withColumnRenamed("host", "of"), F.expr("host <=> of"))
    return of_host.where(f"n * 1000 > documents * {PER_MILLE}").select("host", "line")


def judged(scanned: DataFrame) -> DataFrame:
    """``scanned`` with ``base_failed``, ``removed`` (words in frequent lines) and ``kept``."""
    frequent = stored(frequent_lines(scanned), "frequent").withColumnRenamed("host", "of")
    lines = scanned.selectExpr("row_id", "host", "inline(lines)").withColumnRenamed("line", "held")
    gone = (
        lines.join(frequent, F.expr("host <=> of AND held = line"))
        .groupBy("row_id")
        .agg(F.expr("CAST(sum(words) AS BIGINT) AS removed"))
    )
    failed = f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"
    return (
        scanned.drop("lines")
        .join(gone, "row_id", "left")
        .selectExpr("* EXCEPT (removed)", "coalesce(removed, 0L) AS removed", f"{failed} AS base_failed")
        .selectExpr("*", f"NOT base_failed AND 100 * (n_words - removed) >= {REMAINING} * n_words AS kept")
    )


def rate(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: ``doc_id``, statistics, ``base_failed``, ``removed`` and ``kept``."""
    return judged(stored(scan(docs, host), "lines"))
