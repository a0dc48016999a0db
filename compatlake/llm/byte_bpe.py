"""Byte-level byte-pair encoding and decoding with a local rank file, by the tiktoken library.

A rank file (a path, read by each Python worker from its own installation) lists the tokens as base64 and their ranks;
a pattern cuts texts into matches, and each match is encoded by itself. Long texts are cut beforehand, at places where
the pattern always ends a match: before a blank that follows something else, or between a letter and punctuation. So no
call handles more than about ``PART`` characters, unless a single match is longer; the ids are the same as those of the
uncut text. Decoding joins the bytes of the tokens, which need not be valid UTF-8 when ids are not those of a text.

Ids come as ``array<int>`` or, with ``packed=True``, as little-endian unsigned 32-bit integers in one binary value;
``decode`` takes either. A null text is empty and has no ids; null ids give empty bytes, null elements and ids which the file
doesn't list give none. Strings of special tokens are ordinary text. Order of rows, ties and repeated rows don't matter: equal
rows get equal results. An empty table gives an empty one. Extra columns pass through untouched; where the
table already has a column of the new one's name, the new one gets underscores before it.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from .common import free_name

#: Characters after which a long text is cut at the next safe place.
PART = 1 << 16
#: Texts of a batch are handled in slices of about so many bytes.
SLICE_BYTES = 1 << 23

#: Before a blank after a non-blank; or after a letter (of scripts which all Unicode versions agree on), before ASCII
#: or wide punctuation. No match of the pattern goes across, and none looks at what stands before it.
_SAFE = regex.compile(
    r"(?<=\S)(?=[ \n\t])|(?<=[A-Za-zα-ωа-яぁ-ゖァ-ヺ一-龥가-힣])(?=[!-/:-@\[-`{-~、。！，？])"
)


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text, cut at safe places after at least ``size`` characters each."""
    first = 0
    while len(text) - first > size:
        cut = _SAFE.search(text, first + size)
        if cut is None:
            break
        yield text[first : cut.start()]
        first = cut.start()
    yield text[first:] if first else text


class Ranks:
    """A rank file with its pattern: texts to ids, ids to bytes."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.coder = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        tokens = [b""] * (max(ranks.values()) + 2)
        for token, rank in ranks.items():
            tokens[rank] = token
        #: The last entry stands for ids without a token.
        self.tokens = pa.array(tokens, pa.binary())

    def encode(self, text: str) -> np.ndarray:
        done = [self.coder.encode_to_numpy(part, disallowed_special=()) for part in parts(text)]
        return done[0] if len(done) == 1 else np.concatenate(done)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Bytes of several id lists laid end to end; ``ends`` has n + 1 bounds."""
        last = len(self.tokens) - 1
        shown = self.tokens.take(pa.array(np.where((ids < 0) | (ids > last), last, ids)))
        bounds = np.frombuffer(shown.buffers()[1], dtype=np.int32)[shown.offset :][: len(shown) + 1]
        data = shown.buffers()[2] or pa.py_buffer(b"")
        if not len(shown):
            bounds = np.zeros(1, dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(bounds[ends].tobytes()), data])


@functools.cache
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    """The column in slices of about ``SLICE_BYTES``; one row may be more."""
    sizes = column.nbytes // max(1, len(column)) + 1
    rows = max(1, SLICE_BYTES // sizes)
    for first in range(0, len(column), rows):
        yield column.slice(first, rows)


def _mapped(docs: DataFrame, column: str, name: str, kind: T.DataType, function) -> DataFrame:
    """The documents with one more column, made of slices of another one, array to array."""
    place = docs.columns.index(column)
    (name,) = free_name(docs, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for part in _slices(batch.column(place)):
                rows = batch.slice(first, len(part))
                first += len(part)
                yield pa.record_batch([*rows.columns, function(part)], [*rows.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


def encode(
    docs: DataFrame, path: str, pattern: str, text: str = "text", name: str = "ids", packed: bool = False
) -> DataFrame:
    """The documents and the ids of their texts."""

    def encoded(texts: pa.Array) -> pa.Array:
        coder = ranks(path, pattern)
        ids = [coder.encode(value) if value else np.zeros(0, np.uint32) for value in texts.to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        if not packed:
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
        bounds = pa.py_buffer((4 * ends).astype(np.int32).tobytes())
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, bounds, pa.py_buffer(flat.astype("<u4").tobytes())])

    return _mapped(docs, text, name, T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False), encoded)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """The documents and the bytes of their ids."""

    def decoded(column: pa.Array) -> pa.Array:
        coder = ranks(path, pattern)
        if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
            raw = [value or b"" for value in column.to_pylist()]
            flat = np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int64)
            counts = [len(value) // 4 for value in raw]
        else:
            flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return coder.decode(flat, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))

    return _mapped(docs, ids, name, T.BinaryType(), decoded)


def default_vocabulary() -> tuple[str, str]:
    """Path and pattern of the public multilingual rank file in this Python installation."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every whole text of documents, encoded and decoded again."""
    path, pattern = default_vocabulary()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = encode(docs, path, pattern, packed=True).select("doc_id", "ids")
    found = decode(packed, path, pattern)
    return found.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
