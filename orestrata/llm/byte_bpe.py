"""Byte-level BPE with the tiktoken library and a local rank file: encoding, and decoding to raw bytes.

Long texts are cut at safe boundaries and encoded in pieces. A place between a character that is not white space and a
space or newline is safe: no alternative of the pattern has white space after its first character except the two that
match white space alone, so a match always ends there, and what follows never looks back.

Defined results: a null text counts as empty and gives no ids; repeated rows give repeated results; a null doc_id stays
null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

#: A text of more characters is cut; also the least distance between cuts.
PIECE = 20_000
#: Rows whose ids a worker holds as Python integers at once.
ROWS = 128
#: A letter, digit or plain punctuation mark before a space or newline; Python and the library agree on all of these.
_SAFE = re.compile(r"(?<=[A-Za-z0-9.,;:!?])(?=[ \n])")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The library's encoder for a rank file of lines 'base64 rank'; one a process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, piece: int = PIECE) -> Iterator[str]:
    """Consecutive parts of text, cut at the first safe boundary after piece characters each; a part without one stays whole."""
    start = 0
    while len(text) - start > piece:
        cut = _SAFE.search(text, start + piece)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, encoder, piece: int = PIECE) -> list[int]:
    if not text:
        return []
    if len(text) <= piece:
        return encoder.encode_ordinary(text)
    ids: list[int] = []
    for part in pieces(text, piece):
        ids += encoder.encode_ordinary(part)
    return ids


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of docs and ids array<int>: the ids of text. A column ids of docs is replaced."""
    docs = docs.drop("ids")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        encoder = encoding(path, pattern)
        for b in _parts(batches):
            ids = pa.array([encode(t, encoder) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, "ids"])

    return docs.mapInArrow(run, schema)


def decode_documents(rows: DataFrame, path: str, pattern: str, column: str = "ids") -> DataFrame:
    """The columns of rows and decoded binary: the raw bytes of the ids, whether or not they are valid UTF-8. A column
    decoded of rows is replaced."""
    rows = rows.drop("decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        encoder = encoding(path, pattern)
        for b in _parts(batches):
            out = pa.array([encoder.decode_bytes(ids or []) for ids in b.column(column).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)


def with_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of docs but text; ids array<int>, n_tokens long, and round_trip: whether the decoded ids are the text's very
    bytes. One pass: neither texts nor decoded bytes leave the worker that made the ids. Columns of docs so named are replaced."""
    made = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    docs = docs.drop(*[f.name for f in made])
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != "text"], *made])

    def run(batches):
        encoder = encoding(path, pattern)
        for b in _parts(batches):
            texts = b.column("text").to_pylist()
            ids = [encode(t, encoder) for t in texts]
            same = [encoder.decode_bytes(i) == (t or "").encode() for i, t in zip(ids, texts, strict=True)]
            kept = b.drop_columns(["text"])
            new = [pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *new], names=schema.names)

    return docs.mapInArrow(lean(run), schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 of encode and decode_bytes, in one pass."""

    def run(batches):
        encoder = encoding(path, pattern)
        decimal = [str(i) for i in range(encoder.n_vocab)]
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for text in b.column("text").to_pylist():
                ids = encode(text, encoder)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(encoder.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
