"""The operators over the given tables, one query each, and their SQL where SQL can express them."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetgauge.llm import (
    bpe, chat, exact_dedup, fingerprint, language, merkle, packing, pii, quality, repetition, sharding, simhash, toxicity,
)
from fleetgauge.llm.tables import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# A conversation made of control strings.
PROBE = "</s>[INST] ok [/INST]"


def held_out_of(doc_id: str, folds: int, fold: int) -> Column:
    """Whether nothing may be learned from a document; one without an id may be learned from."""
    return F.expr(f"coalesce(crc32(CAST({doc_id} AS STRING)) % {folds} = {fold}, false)")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [f"CAST(size(filter(base, s -> s.kind = {i})) AS BIGINT) AS n_{kind}" for i, kind in enumerate(pii.KINDS)]
    return pii.find(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id",
        *counts,
        f"sha2({pii.listed('base')}, 256) AS base_sha256",
        f"{pii.listed('concat(base, added)')} AS spans",
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=3, segments=2)
    return found.selectExpr("doc_id", f"{simhash.hex_of('fp')} AS fingerprint", "component_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out_of("doc_id", 5, 0))
    return toxicity.score(docs, toxicity.learn(docs, labels)).select(
        "doc_id",
        held_out_of("doc_id", 5, 0).alias("held_out"),
        "score",
        F.expr("CAST(score >= 0.5 AS INT)").alias("predicted"),
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = packing.read_tokenizer(TOKENIZER)
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(RANKS)
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).selectExpr(
        "doc_id",
        "CAST(octet_length(ids) div 4 AS BIGINT) AS n_tokens",
        "sha2(ids, 256) AS ids_sha256",
        "sha2(decoded, 256) AS decoded_sha256",
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs.where(~held_out_of("doc_id", 3, 1)))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "row.doc_id",
        held_out_of("row.doc_id", 3, 1).alias("held_out"),
        "language.lang_pred",
        "language.score",
        F.to_json("language.lang_spans").alias("spans"),
    )


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).selectExpr(
        "-1L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{PROBE}' AS text"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_chats(turns))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24).selectExpr(
        "doc_id", "size", "text_crc32", "'rows' AS law", "shard", "slot", "CAST(NULL AS INT) AS grown_shard"
    )


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    tampered = f"IF(coalesce(crc32(CAST(doc_id AS STRING)) % 3 = 0, false), {lowered}, text)"
    docs = table(spark, sf_dir, "documents")
    rows = merkle.leaves(docs, merkle.FIELDS, "lang", "doc_id", {"text": tampered})
    return merkle.manifest(rows).selectExpr(
        "key AS doc_id",
        *(f"lower(hex({c})) AS {c}" for c in ("leaf", "subroot", "root")),
        f"sha2({merkle.siblings_of('path')}, 256) AS proof_sha256",
        f"{merkle.folded('claimed', 'path')} AS folded_root",
    ).selectExpr("*", "folded_root = root AS verified")


def op12_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.find(table(spark, sf_dir, "documents"), plant=True)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_pii, op2_fingerprints, op3_simhash, op4_exact_dedup, op5_toxicity, op6_packing, op7_bpe, op8_language, op9_chat,
        op10_sharding, op11_merkle, op12_repetition, op13_quality,
    )
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": EXACT_DEDUP, "op9_chat": CHAT, "op11_merkle": MERKLE, "op13_quality": QUALITY}


EXACT_DEDUP = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_CONTROL = r"(\[)(\\*(?:/?SYS\]|/?INST\]|/?TURN\]|:\]))|(<)(\\*/?s>)"

CHAT = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')
), sized AS (
    SELECT *,
           length(text) + length(regexp_extract_all(text, '{_CONTROL}')) + CASE role
               WHEN 'system' THEN length('[SYS][/SYS]')
               WHEN 'user' THEN length('[INST][/INST]')
               WHEN 'assistant' THEN length('<s></s>')
               ELSE length('[TURN][:][/TURN]') + length(role) + length(regexp_extract_all(role, '{_CONTROL}'))
           END AS written
    FROM turns
), chats AS (
    SELECT conv_id,
           count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS all_text,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
           CAST(sum(written) AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(all_text) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars
FROM chats
"""

# A checksum bit by bit: bytes are taken in, a -1 shifts once.
_CRC32 = """
    xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length({0}) + 1),
        lambda i: [ascii(substr({0}, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda x, b: CASE WHEN b >= 0 THEN xor(x, b) ELSE xor(x // 2, (x % 2) * 3988292384) END))
"""
_LEAF = "sha256(concat({}))".format(
    ", ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in merkle.FIELDS)
)
_TREE = """
    SELECT tree, 0 AS level, place, nodes, digest FROM {0}
    UNION ALL
    SELECT tree, level + 1, place // 8, (nodes + 7) // 8, sha256(string_agg(digest, '' ORDER BY place))
    FROM {1} WHERE nodes > 1 GROUP BY tree, level, nodes, place // 8
"""

MERKLE = f"""
WITH RECURSIVE told AS (
    SELECT *, coalesce({_CRC32.format("CAST(doc_id AS VARCHAR)")} % 3 = 0, false) AS tampered FROM documents
), claims AS (
    SELECT doc_id, lang, {_LEAF} AS leaf,
           IF(tampered, translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), text) AS claim, source, n_chars
    FROM told
), hashed AS (
    SELECT doc_id, lang, leaf, {_LEAF.replace("CAST(text ", "CAST(claim ")} AS claimed FROM claims
), leaves AS (
    SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY lang) AS nodes,
           row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
    FROM hashed
), first_level AS (SELECT tree, place, nodes, leaf AS digest FROM leaves
), lower_tree AS ({_TREE.format("first_level", "lower_tree")}
), subroots AS (
    SELECT -1 AS tree, tree AS place, count(*) OVER () AS nodes, digest FROM lower_tree WHERE nodes = 1
), upper_tree AS ({_TREE.format("subroots", "upper_tree")}
), tops AS (SELECT place AS tree, digest AS subroot FROM subroots
), depths AS (SELECT tree, max(level) AS depth FROM lower_tree GROUP BY tree
), nodes AS (
    SELECT tree AS own, level AS step, * FROM lower_tree WHERE nodes > 1
    UNION ALL SELECT d.tree, d.depth + u.level, u.* FROM depths d CROSS JOIN upper_tree u WHERE u.nodes > 1
), steps AS (
    SELECT l.tree AS leaf_tree, l.place AS leaf_place, n.step,
           coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (n.place < l.held_place), '') AS before,
           coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (n.place > l.held_place), '') AS after
    FROM (SELECT v.tree, v.place, n.step, n.tree AS node_tree, n.level,
                 IF(n.tree < 0, v.tree, v.place) // CAST(pow(8, n.level) AS BIGINT) AS held_place
          FROM leaves v JOIN (SELECT DISTINCT own, step, tree, level FROM nodes) n ON n.own = v.tree) l
    JOIN nodes n ON n.own = l.tree AND n.step = l.step AND n.place // 8 = l.held_place // 8
    GROUP BY ALL
), folds AS (
    SELECT tree, place, 0 AS step, claimed AS folded FROM leaves
    UNION ALL
    SELECT f.tree, f.place, f.step + 1, sha256(s.before || f.folded || s.after)
    FROM folds f JOIN steps s ON s.leaf_tree = f.tree AND s.leaf_place = f.place AND s.step = f.step
), proofs AS (
    SELECT leaf_tree AS tree, leaf_place AS place, string_agg(before || after, '' ORDER BY step) AS siblings FROM steps GROUP BY ALL
)
SELECT l.doc_id, l.leaf, t.subroot, r.digest AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
       f.folded AS folded_root, f.folded = r.digest AS verified
FROM leaves l
JOIN tops t ON t.tree = l.tree
JOIN (SELECT digest FROM upper_tree WHERE nodes = 1) r ON true
JOIN (SELECT tree, place, max_by(folded, step) AS folded FROM folds GROUP BY ALL) f ON f.tree = l.tree AND f.place = l.place
LEFT JOIN proofs p ON p.tree = l.tree AND p.place = l.place
"""

_WORDS = r"regexp_extract_all({}, '[^ \t-\x0D]+')"

QUALITY = rf"""
WITH rows AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS words
    FROM documents
), windows AS (
    SELECT r, i, array_to_string(words[i:i + {quality.WINDOW - 1}], ' ') AS w
    FROM (SELECT r, words, unnest(range(1, len(words) - {quality.WINDOW - 2})) AS i FROM rows)
), repeats AS (
    SELECT r, count(DISTINCT i + k) AS n FROM (
        SELECT r, i, unnest(range(0, {quality.WINDOW})) AS k
        FROM windows JOIN (SELECT r, w FROM windows GROUP BY r, w HAVING count(*) > 1) USING (r, w))
    GROUP BY r
), raw AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM rows
), doubled AS (
    SELECT r, count(*) - count(DISTINCT line) AS n FROM raw WHERE regexp_matches(line, '[^ 	-
]') GROUP BY r
), lines AS (
    SELECT r, source, text, k, lower(regexp_replace(array_to_string(k, ' '), '[0-9]+', '0', 'g')) AS line
    FROM (SELECT raw.r, source, text, {_WORDS.format("line")} AS k FROM raw JOIN rows USING (r)) WHERE len(k) > 0
), hosts AS (SELECT source, count(DISTINCT text) AS documents FROM rows GROUP BY source
), frequent AS (
    SELECT l.source, line FROM lines l JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source GROUP BY l.source, line, documents
    HAVING count(DISTINCT text) > {quality.LEAST_DOCUMENTS} AND count(DISTINCT text) * 1000 > documents * {quality.PER_MILLE}
), gone AS (
    SELECT r, sum(len(k)) AS n FROM lines l JOIN frequent f ON f.source IS NOT DISTINCT FROM l.source AND f.line = l.line GROUP BY r
), found AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
           coalesce(d.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, coalesce(g.n, 0) AS removed
    FROM rows LEFT JOIN doubled d USING (r) LEFT JOIN repeats p USING (r) LEFT JOIN gone g USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed,
       NOT (n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words)
       AND 100 * (n_words - removed) >= {quality.REMAINING} * n_words AS kept
FROM found
"""
