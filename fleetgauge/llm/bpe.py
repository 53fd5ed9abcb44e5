"""Byte-level BPE of whole texts, each distinct pre-token encoded once for all documents.

1. Blocks of documents are cut into pre-tokens.  A block keeps its distinct
   pre-tokens and, for every position of every document, which of them stands
   there.
2. The distinct pre-tokens of all blocks are brought together by their hash,
   so each is encoded once; a frequent one comes from a block at most once.
3. Ids go back to the blocks they are needed in, which reassemble their
   documents by position.
4. Decoding looks every id up in the token-byte table.

Positions never leave their block and texts are not shuffled at all.  What a
block sends to one part of the hash range travels as one compressed list.

Defined results: a null text is empty and has no ids; repeated rows are
encoded as often as they occur; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import functools
import re
import sys
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fleetgauge.llm.tables import texts

BLOCK_CHARS = 6_000_000
_BLOCK = pa.schema([("docs", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("words", pa.list_(pa.string())), ("places", pa.binary())])
_IPC = pa.ipc.IpcWriteOptions(compression="zstd")

# White space as Unicode defines it; Python's own class has four more characters.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LATIN_END = 0x250
_BEYOND_LATIN = re.compile(f"[{chr(_LATIN_END)}-{chr(sys.maxunicode)}]")


@functools.lru_cache(maxsize=2)
def pre_tokenizer(pattern: str) -> Callable[[str], list[str]]:
    """Function that cuts a text by a pattern of the byte-level vocabularies.

    Texts of the Latin blocks are cut by the standard library's engine, with
    the Unicode classes spelt out, which is faster.
    """
    import regex

    spaces = pattern.replace(r"(?!\S)", f"(?![^{_SPACE}])").replace(r"\s+", f"[{_SPACE}]+").replace(r"\s", _SPACE)

    def members(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(_LATIN_END) if unicodedata.category(chr(c))[0] == kind)

    def spelt(kind: str) -> str:
        # Alone as a class of its own, or inside one.
        return re.sub(r"(\[[^\]]*)?\\p\{%s\}" % kind, lambda m: m[1] + members(kind) if m[1] else f"[{members(kind)}]", latin)

    latin = spaces
    for kind in "LN":
        latin = spelt(kind)
    whole, fast = regex.compile(spaces), re.compile(latin)
    return lambda text: (whole if _BEYOND_LATIN.search(text) else fast).findall(text)


@functools.lru_cache(maxsize=2)
def _ranks(rank_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines())}


@functools.lru_cache(maxsize=1)
def _encoding(rank_file: bytes, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(rank_file), special_tokens={})


class _Distinct(dict):
    """Pre-token -> number in the order of appearance."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, bytes of one significance side by side: the higher ones are nearly all zero."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: pa.Scalar) -> np.ndarray:
    """What :func:`_planes` was given."""
    data = np.frombuffer(planes.as_buffer(), np.uint8)
    return np.ascontiguousarray(data.reshape(4, -1).T).view("<u4").ravel()


def _pack(docs: list, ends: list[int], words: _Distinct, places: list[np.ndarray]) -> bytes:
    """One block as compressed bytes; frequent pre-tokens get small numbers."""
    every = np.concatenate(places) if places else np.empty(0, np.uint32)
    order = np.argsort(-np.bincount(every, minlength=len(words)), kind="stable")
    renumbered = np.empty(len(words), "<u4")
    renumbered[order] = np.arange(len(words))
    planes = _planes(renumbered[every])
    listed = list(words)
    columns = [pa.array([docs], _BLOCK[0].type), pa.array([ends], _BLOCK[1].type), pa.array([[listed[i] for i in order]], _BLOCK[2].type), pa.array([planes], _BLOCK[3].type)]
    return _compressed(pa.record_batch(columns, schema=_BLOCK))


def _compressed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_IPC) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _expanded(data: pa.Scalar) -> pa.RecordBatch:
    with pa.ipc.open_stream(data.as_buffer()) as reader:
        return reader.read_next_batch()


def _by_part(words: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a block's words, those of one part of the hash range together, and where each part ends."""
    part = np.fromiter((zlib.crc32(w.encode()) % parts for w in words.to_pylist()), np.int64, len(words))
    return np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=parts))


def _blocks(docs: DataFrame, pattern: str) -> DataFrame:
    """``block, payload``: documents in blocks, hash-partitioned by block."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = pre_tokenizer(pattern)
        # The same task finds the same blocks again if it has to be repeated.
        block = TaskContext.get().partitionId() << 32
        docs, ends, words, places, chars = [], [], _Distinct(), [], 0

        def row() -> pa.RecordBatch:
            payload = pa.array([_pack(docs, ends, words, places)], pa.binary())
            return pa.record_batch([pa.array([block]), payload], names=["block", "payload"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                found = split(text)
                places.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                docs.append(doc_id)
                ends.append((ends[-1] if ends else 0) + len(found))
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield row()
                    block += 1
                    docs, ends, words, places, chars = [], [], _Distinct(), [], 0
        if docs:
            yield row()

    return texts(docs).mapInArrow(cut, "block long, payload binary").repartition("block")


def encode(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """``doc_id, ids``: ids are little-endian unsigned 32-bit integers."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(rank_file)
    blocks = _blocks(docs, pattern)
    # A task meets all words of a part, so there are as many parts as tasks.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def words_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = _expanded(payload).column(2).values
                order, ends = _by_part(words, parts)
                sent = [
                    (part, block, _compressed(pa.record_batch([words.take(pa.array(order[start:end]))], names=["word"])))
                    for part, (start, end) in enumerate(zip([0, *ends], ends))
                    if end > start
                ]
                columns = zip(*sent, strict=True) if sent else ([], [], [])
                types = (pa.int32(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "block", "words"])

    def encode_once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks.value, pattern)
        current = None
        for batch in batches:
            out = []
            for part, data in zip(batch.column(0).to_pylist(), batch.column(2)):
                if part != current:
                    current, known = part, {}
                found = []
                for word in _expanded(data).column(0).to_pylist():
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encoding.encode_ordinary(word)
                    found.append(ids)
                lengths = np.fromiter(map(len, found), np.uint32, len(found))
                ids = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
                sent = [pa.array([_planes(n)], pa.binary()) for n in (lengths, ids)]
                out.append(_compressed(pa.record_batch(sent, names=["lengths", "ids"])))
            yield pa.record_batch([batch.column(1), batch.column(0), pa.array(out, pa.binary())], names=["block", "part", "ids"])

    encoded = (
        blocks.mapInArrow(words_of, "part int, block long, words binary")
        .repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(encode_once, "block long, part int, ids binary")
    )

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _expanded(left["payload"][0])
        order, _ = _by_part(block.column(2).values, parts)
        ids: list[bytes] = [b""] * len(order)
        at = 0
        for data in right["ids"].take(pc.sort_indices(right["part"])):
            lengths, values = (_numbers(column[0]) for column in _expanded(data).columns)
            values, start = values.tobytes(), 0
            for i, end in enumerate(np.cumsum(4 * lengths.astype(np.int64)).tolist(), at):
                ids[order[i]] = values[start:end]
                start = end
            at += len(lengths)
        places = _numbers(block.column(3)[0])
        out, start = [], 0
        for end in block.column(1).values.to_pylist():
            out.append(b"".join(map(ids.__getitem__, places[start:end].tolist())))
            start = end
        return pa.table({"doc_id": block.column(0).values, "ids": pa.array(out, pa.binary())})

    return blocks.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(reassemble, "doc_id long, ids binary")


def decode(encoded: DataFrame, rank_file: bytes) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids stand for."""
    ranks = encoded.sparkSession.sparkContext.broadcast(rank_file)

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _ranks(ranks.value)
        token_bytes = [b""] * (max(known.values()) + 1)
        for token, rank in known.items():
            token_bytes[rank] = token
        for batch in batches:
            out = [
                b"".join(map(token_bytes.__getitem__, np.frombuffer(ids.as_buffer(), "<u4").tolist()))
                for ids in batch.column(1)
            ]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(look_up, "doc_id long, ids binary, decoded binary")


def read_ranks(path: str) -> bytes:
    """A rank file, read by the driver and sent to the workers."""
    with open(path, "rb") as file:
        return file.read()
