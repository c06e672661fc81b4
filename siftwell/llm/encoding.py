"""Encoding a whole corpus with a public byte-pair tokenizer: each distinct word is encoded once.

Texts are cut into pre-tokens by the tokenizer's pattern, once. Consecutive documents of a partition make up pieces of bounded
size; a piece is exploded into a row for each of its distinct words with the positions where it stands (by chunks of 65,536 words, so that a
position takes two bytes), and one row that tells which documents it holds and how many words each. The words go through one
global shuffle, where all rows of a word meet and it is encoded once (a word that fills more than a partition is split by
the engine and encoded once in each split). The ids go back by piece with their positions, and each piece is
reassembled by position alone; the texts themselves are never shuffled. Pieces are named by partition, so nothing depends on how ids are spread.
Decoding joins the table of the tokens' bytes by id, in order of position.

Defined results: null and empty texts have an empty list of ids; texts of any length are encoded whole, a very long one as a piece of its own; repeated
rows, equal texts and null ids give one result a row; extra columns are ignored; an empty table gives no rows; ids decode to the exact
text. The rows of a partition must come in the same order if it is computed again, as those of a scan do; a piece that doesn't fit
together is an error, never a wrong result. The vocabulary file is named by path; it is never copied.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = os.environ.get("SIFTWELL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pattern that splits text before the merges of these rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of a chunk, so that positions take two bytes, and words after which a piece ends with the document at hand.
CHUNK, PIECE = 1 << 16, 1 << 17
#: Characters from which a text is split bit by bit instead of at once.
LONG = 1 << 22
_SPLIT = regex.compile(PATTERN)


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def _whole(path: str):
    """An encoder that merges its input as one word."""
    import tiktoken

    return tiktoken.Encoding("word", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer itself, for counts and checks."""
    import tiktoken

    return tiktoken.Encoding("text", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def pretokens(text: str) -> list[str]:
    return _SPLIT.findall(text)


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, chunk, word, at): each piece's distinct words by chunk with their places in it; where word is null, what the piece holds."""
    context = TaskContext.get()
    piece = (context.partitionId() if context else 0) << 32
    names = ["piece", "chunk", "word", "at"]
    held: list[str] = []
    docs: list[tuple[int, int, int]] = []
    chunk = 0

    def words() -> pa.RecordBatch:
        nonlocal held, chunk
        coded = pa.array(held[:CHUNK], pa.string()).dictionary_encode()
        codes = coded.indices.to_numpy()
        n = len(coded.dictionary)
        places = np.argsort(codes, kind="stable").astype("uint16")
        ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=n))]) * 2
        at = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype("int32").tobytes()), pa.py_buffer(places.tobytes())])
        out = pa.RecordBatch.from_arrays([pa.array(np.full(n, piece)), pa.array(np.full(n, chunk, "int32")), coded.dictionary, at], names=names)
        held, chunk = held[CHUNK:], chunk + 1
        return out

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal docs, piece, chunk
        if held:
            yield words()
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([-1], pa.int32()), pa.array([None], pa.string()), pa.array([np.array(docs, "int64").tobytes()], pa.binary())], names=names)
        docs, piece, chunk = [], piece + 1, 0

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            before = chunk * CHUNK + len(held)
            if t and len(t) < LONG:
                held += _SPLIT.findall(t)
                while len(held) >= CHUNK:
                    yield words()
            elif t:
                for m in _SPLIT.finditer(t):
                    held.append(m[0])
                    if len(held) == CHUNK:
                        yield words()
            docs.append((i or 0, i is None, chunk * CHUNK + len(held) - before))
            if chunk * CHUNK + len(held) >= PIECE or len(docs) >= CHUNK:
                yield from close()
    yield from close()


def _id_type(path: str) -> str:
    return "uint16" if max(ranks(path).values()) < 1 << 16 else "uint32"


def _answer(path: str):
    """(piece, chunk, word, at) to (piece, chunk, at, ids); the rows of a word are in one partition, where it is encoded once. No word, no ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_, kind, known = _whole(path).encode_ordinary, _id_type(path), {}
        for b in batches:
            coded = b.column(2).dictionary_encode()
            table = []
            for w in coded.dictionary.to_pylist():
                if (x := known.get(w)) is None:
                    x = known[w] = np.array(encode_(w), kind).tobytes()
                table.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(table, pa.binary()).take(coded.indices)], names=["piece", "chunk", "at", "ids"])
            if len(known) > 250_000:
                known = {}

    return rows


def _flat(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a binary column, and where those of each row begin and the last end."""
    a = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())  # begins at offset 0
    if not len(a):
        return np.empty(0, kind), np.zeros(1, "int64")
    ends = np.frombuffer(a.buffers()[1], "int32")[a.offset : a.offset + len(a) + 1].astype("int64")
    data = np.frombuffer(a.buffers()[2] or b"", "uint8")[ends[0] : ends[-1]].tobytes()
    return np.frombuffer(data, kind), (ends - ends[0]) // np.dtype(kind).itemsize


def _assemble(kind: str):
    def rows(piece: pa.Table) -> pa.Table:
        head = pa.compute.less(piece.column("chunk"), 0)
        docs, _ = _flat(piece.filter(head).column("at"), "int64")
        docs = docs.reshape(-1, 3)
        body = piece.filter(pa.compute.invert(head))
        places, begins = _flat(body.column("at"), "uint16")
        ids, firsts = _flat(body.column("ids").cast(pa.binary()), kind)
        row = np.repeat(np.arange(body.num_rows), np.diff(begins))
        at = places.astype("int64") + (body.column("chunk").to_numpy().astype("int64") * CHUNK)[row]
        n = int(docs[:, 2].sum())
        if len(at) != n or (n and (np.bincount(at, minlength=n) != 1).any()):
            raise ValueError("a piece doesn't fit together: its partition was computed twice in different orders")
        of = np.empty(n, "int64")
        of[at] = row
        sizes = np.diff(firsts)[of]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = ids[np.repeat(firsts[of] - ends[:-1], sizes) + np.arange(ends[-1])].astype("int32") if n else np.empty(0, "int32")
        offsets = ends[np.concatenate([[0], np.cumsum(docs[:, 2])])]
        return pa.table([pa.array(docs[:, 0], pa.int64(), mask=docs[:, 1] == 1), pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(flat))], names=["doc_id", "ids"])

    return rows


def encode(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids): one row for each row of documents (doc_id, text)."""
    exploded = documents.select("doc_id", "text").mapInArrow(_explode, "piece long, chunk int, word string, at binary")
    told = exploded.hint("rebalance", "word").mapInArrow(_answer(path), "piece long, chunk int, at binary, ids binary")
    return told.groupBy("piece").applyInArrow(_assemble(_id_type(path)), "doc_id long, ids array<int>")


@lru_cache(maxsize=2)
def token_bytes(path: str) -> pa.Array:
    """The table of the tokens: the bytes of each id, at its place; null where an id is free."""
    table = ranks(path)
    by_id = {i: b for b, i in table.items()}
    return pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.large_binary())


def decode(encoded: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); a null list gives null, an empty one the empty text; an id that no token has is an error.

    Each batch joins the token table by taking its rows at the ids, in order of position, so nothing is shuffled: what is taken lies
    in one buffer, of which every document is a slice.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for b in batches:
            lists = b.column(1)
            taken = table.take(lists.flatten())
            if taken.null_count:
                raise ValueError("an id has no token")
            ends = np.frombuffer(taken.buffers()[1], "int64")[taken.offset : taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, "int64")
            data = bytes(taken.buffers()[2] or b"") if len(taken) else b""
            sizes = np.where(np.asarray(lists.is_null()), 0, np.asarray(lists.value_lengths().fill_null(0)))
            at = ends[np.concatenate([[0], np.cumsum(sizes)]).astype("int64")]
            texts = [None if null else data[s:e].decode("utf-8", "replace") for null, s, e in zip(lists.is_null().to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """The documents without their text, with `tokens`; null and empty texts have none."""
    kept = [c for c in documents.columns if c != "text"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_ = tokenizer(path).encode_ordinary
        for b in batches:
            n = [len(encode_(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(n, pa.int64())], names=[*kept, "tokens"])

    schema = T.StructType([f for f in documents.schema.fields if f.name in kept] + [T.StructField("tokens", T.LongType())])
    return documents.mapInArrow(rows, schema)
