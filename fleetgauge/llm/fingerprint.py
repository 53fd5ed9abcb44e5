"""Document fingerprints by consistent weighted sampling.

A text is the weighted set of its lower-cased words, a word's weight being how
often it occurs.  For each of ``samples`` draws every word gets, from hashes
of word and draw alone, two Gamma(2, 1) variables r, c and a uniform b:

    t = floor(ln(weight) / r + b),    ln a = ln(c) - r * (t - b + 1)

and the draw samples the pair (word, t) with the smallest a.  Two texts sample
the same pair with a probability equal to their generalised Jaccard
similarity, the sum of the smaller weights over the sum of the larger ones.  A
fingerprint has 16 bits of a hash of each sampled pair.

The smallest a of a text is exponential with the text's total weight as rate,
so it exceeds ``SURE`` over that weight with probability e ** -SURE.  Pairs
for which cheap arithmetic shows that a is larger than that are passed over
before any logarithm is taken.

Draws are evaluated in generated code, ``LANES`` of them for each row: one row
for all would make methods that are too long to be compiled.

Defined results: a null text is empty; texts without words are alike to each
other and to nothing else; rows that repeat an id and its text are one
document, reported as often as they occur; without ids rows are ordered last,
by text; a single document is its own next one; an empty table gives an empty
one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetgauge.llm.tables import NO_ID, stored, texts

SAMPLES = 32
LANES = 8
HEX = 4  # hexadecimal digits of a sample
SURE = 40.0

_UNIFORM_BITS = 21


def _uniform(hashed: Column, skip: int) -> Column:
    """Uniform in (0, 1) from 21 bits of a hash."""
    bits = F.shiftrightunsigned(hashed, skip) if skip else hashed
    return (bits.bitwiseAND((1 << _UNIFORM_BITS) - 1) + 0.5) * 2.0**-_UNIFORM_BITS


def _drawn(group: str, lane: int) -> Column:
    """A draw's ln(a) in the upper bits of a long and a hash of (word, t) in the lower 16."""
    first = F.xxhash64("term", group, F.lit(lane))
    second = F.xxhash64(first)
    q = _uniform(first, 0) * _uniform(first, _UNIFORM_BITS)
    p = _uniform(second, 0) * _uniform(second, _UNIFORM_BITS)
    b = _uniform(second, 2 * _UNIFORM_BITS)
    r = -F.ln(q)
    t = F.floor(F.col("ln_weight") / r + b)
    ln_a = F.ln(-F.ln(p)) - r * (t - b + 1)
    # a = c * e ** -(r * (t - b + 1)) where c >= 1 - p, and e ** -r = q.  The power is at least q / weight; of a
    # single word it is q ** (1 - b), at least the harmonic mean of q and 1.
    above = F.when(F.col("weight") == 1, (1 - b) / q + b).otherwise(F.col("weight") / q)
    possible = (1 - p) <= F.col("bound") * above
    # ln(a) is above -64: the weight of a word would have to exceed e ** 30 otherwise.
    order = ((ln_a + 64) * 2.0**39).cast("bigint")
    return F.when(possible, F.shiftleft(order, 16).bitwiseOR((F.col("term_hash") + t).bitwiseAND(0xFFFF)))


def fingerprints(rows: DataFrame, key: list[str], samples: int = SAMPLES) -> DataFrame:
    """``key`` and ``fingerprint`` for rows of ``key`` and ``text``.

    Rows that are already partitioned by ``key``, or a part of it, are not shuffled.
    """
    if samples % LANES:
        raise ValueError(f"samples must be a multiple of {LANES}")
    cut = rows.select(*key, F.split(F.lower("text"), r"[ \t-\r]+").alias("words"))
    # Up to two of them are the empty ends.
    words = cut.selectExpr(*key, "words", "greatest(size(words) - 2, 1) AS total").selectExpr(
        *key, "total", "explode(words) AS word"
    )
    # A text without words keeps its row and samples nothing.
    weighted = (
        words.selectExpr(*key, "total", "IF(word = '', NULL, xxhash64(word)) AS term")
        .groupBy(*key, "term")
        .agg(F.expr("CAST(count(*) AS DOUBLE) AS weight"), F.max("total").alias("total"))
        .selectExpr(
            *key, "term", "weight", "ln(weight) AS ln_weight", f"{SURE}D / total AS bound",
            "xxhash64(term, 'pair') & 65535L AS term_hash",
            f"explode(sequence(0, {samples // LANES - 1})) AS draws",
        )
    )
    lanes = [F.min(F.when(F.col("term").isNotNull(), _drawn("draws", i))).alias(f"lane{i}") for i in range(LANES)]
    drawn = weighted.groupBy(*key, "draws").agg(*lanes)
    digits = ", ".join(f"lower(lpad(hex(coalesce(lane{i}, 0L) & 65535L), {HEX}, '0'))" for i in range(LANES))
    return (
        drawn.selectExpr(*key, "draws", f"concat({digits}) AS part")
        .groupBy(*key)
        .agg(F.expr("array_sort(collect_list(struct(draws, part))) AS parts"))
        .selectExpr(*key, "concat_ws('', transform(parts, p -> p.part)) AS fingerprint")
    )


def likeness(a: str, b: str, samples: int = SAMPLES) -> str:
    """SQL of the share of draws in which two fingerprints agree."""
    same = f"substring({a}, {HEX} * i + 1, {HEX}) = substring({b}, {HEX} * i + 1, {HEX})"
    return f"aggregate(sequence(0, {samples - 1}), 0, (n, i) -> n + IF({same}, 1, 0)) / {samples}D"


def with_next(documents: DataFrame) -> DataFrame:
    """``id, h, n_chars, copies, next_id, next_h`` of distinct documents: the next one by descending id, cyclically."""
    spark = documents.sparkSession
    distinct = documents.groupBy("id", "h", "n_chars").agg(F.expr("count(*) AS copies"))
    # A total order over narrow rows; the numbers hold because they are stored.
    ordered = stored(
        distinct.orderBy(F.desc("id"), "h").withColumn("place", F.monotonically_increasing_id()), "ordered"
    ).selectExpr("*", "shiftright(place, 33) AS part", f"place & {(1 << 33) - 1}L AS inside")
    # A row for each range of the sort.
    starts = (
        ordered.groupBy("part")
        .agg(F.expr("count(*) AS n"))
        .selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS start", "sum(n) OVER () AS total")
    )
    ranked = ordered.join(F.broadcast(starts), "part").selectExpr(
        "id", "h", "n_chars", "copies", "start + inside AS rank", "total"
    )
    following = ranked.selectExpr("id AS next_id", "h AS next_h", "pmod(rank - 1, total) AS rank")
    return ranked.drop("total").join(following, "rank").drop("rank")


def fingerprint_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Every document with its fingerprint, that of its edited text, and the likeness to it and to the next document."""
    keyed = texts(docs).selectExpr(
        f"coalesce(doc_id, {NO_ID}) AS id", "xxhash64(text, doc_id IS NULL) AS h", "text"
    )
    links = with_next(keyed.selectExpr("id", "h", "CAST(char_length(text) AS BIGINT) AS n_chars"))
    # Texts are shuffled once, by document; the next document's share of the edited text is shuffled to its owner.
    placed = keyed.repartition("id", "h").selectExpr("*", "row_number() OVER (PARTITION BY id, h ORDER BY id) AS copy")
    whole = placed.where("copy = 1").select("id", "h", "text")
    owners = links.selectExpr("next_id AS id", "next_h AS h", "id AS own_id", "h AS own_h", "n_chars div 3 AS cut")
    added = whole.join(owners, ["id", "h"]).selectExpr(
        "own_id AS id", "own_h AS h", "cut", "substring(text, 1, CAST(cut AS INT)) AS added"
    )
    edit = "concat(substring(text, 1, CAST(char_length(text) - cut AS INT)), added)"
    both = whole.join(added, ["id", "h"]).selectExpr("id", "h", "text", f"{edit} AS edited")
    variants = both.selectExpr("id", "h", "explode(array(struct(0 AS variant, text), struct(1 AS variant, edited AS text))) AS v")
    printed = fingerprints(variants.selectExpr("id", "h", "v.variant", "v.text"), ["id", "h", "variant"], samples)
    pairs = printed.groupBy("id", "h").agg(
        F.expr("max(fingerprint) FILTER (WHERE variant = 0) AS fingerprint"),
        F.expr("max(fingerprint) FILTER (WHERE variant = 1) AS edited_fingerprint"),
    )
    digests = both.selectExpr("id", "h", "sha2(edited, 256) AS edited_sha256")
    # One job reads the shuffled texts for both; a later one would shuffle them again.
    pairs = stored(pairs.join(digests, ["id", "h"]), "fingerprints")
    after = pairs.selectExpr("id AS next_id", "h AS next_h", "fingerprint AS next_fingerprint")
    return (
        links.join(pairs, ["id", "h"])
        .join(after, ["next_id", "next_h"])
        .withColumn("copy", F.expr("explode(sequence(1L, copies))"))
        .selectExpr(
            f"nullif(id, {NO_ID}) AS doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            f"{likeness('fingerprint', 'edited_fingerprint', samples)} AS near_edited",
            f"{likeness('fingerprint', 'next_fingerprint', samples)} AS near_next",
        )
    )
