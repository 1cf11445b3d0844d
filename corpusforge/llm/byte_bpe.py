"""Byte-level BPE encoding and decoding by the tiktoken library with a local rank file (operator 13).

A text becomes ids piece by piece: each match of the pre-splitting pattern is encoded by itself, without
special tokens. Long texts are cut where a match must end whatever stands around it (before white space
after a visible character; before punctuation after a letter or number), so that no call of the library
meets more than some kilobytes. A stretch without such a place is one or a few very long matches: these
are found by the `regex` module, on which long runs put no load, and encoded one by one. Ids are the same
as the library's for the whole text.

One pass without a shuffle; ranks are loaded once a Python worker from the rank file, whose path is a
parameter and must exist on every executor. Decoding joins the ids' bytes: any list of ids decodes, also
one that stops within a character, as decoding gives bytes.

Nulls: a null text counts as empty and has no ids; null ids decode to no bytes. A null id within a list
or one that the file lacks raises. Bytes of a text that aren't UTF-8 count as U+FFFD. Repeated rows are
encoded each; a very long text is held whole by one task, at several times its bytes. Extra columns stay.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from . import text as T

CHUNK = 1 << 14
LONG = 1 << 16
#: Places at which every match of the pattern ends: white space after a visible character, punctuation (but the
#: apostrophe, which may open a contraction) after a letter or number.
SAFE = regex.compile(r"(?<=[^\s\x00-\x20\x7F-\xA0])(?=[ \t\r\n])|(?<=[\p{L}\p{N}])(?=[!-&(-/:-@\[-`{-~。，、！？])")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token's bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """`text` cut at safe places, in parts of about `size` characters or what is longer without such a place."""
    at = 0
    while len(text) - at > size:
        found = SAFE.search(text, at + size)
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to
    if at < len(text):
        yield text[at:]


class ByteBPE:
    """Encoder and decoder of one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.inner = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
        self.pattern = regex.compile(pattern)

    def encode(self, text: str) -> np.ndarray:
        out = [self._ids(part) for part in chunks(text)]
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def _ids(self, part: str) -> np.ndarray:
        if len(part) <= LONG:
            return np.array(self.inner.encode_ordinary(part), np.int32)
        held = [np.array(self.inner._encode_single_piece(m.group()), np.int32) for m in self.pattern.finditer(part)]
        return np.concatenate(held)

    def decode(self, ids: list[int]) -> bytes:
        return self.inner.decode_bytes(ids)


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def loaded(path: str, pattern: str) -> ByteBPE:
    """One a worker, path and pattern."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE(path, pattern)
    return _LOADED[path, pattern]


def _texts(column: pa.Array) -> list[str]:
    data, at = T.buffers(column)
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _with(part: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = [n for n in part.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), column], [*kept, name])


def _schema(df: DataFrame, name: str, kind) -> StructType:
    return StructType([*(f for f in df.schema.fields if f.name != name), StructField(name, kind)])


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`docs` with the column `ids` (array of int) of each row's whole `text`; a column of that name is replaced."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for part in T.slices(batches, text):
            found = [bpe.encode(t) for t in _texts(part.column(text))]
            at = np.cumsum([0, *(len(x) for x in found)]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield _with(part, ids, pa.ListArray.from_arrays(pa.array(at), pa.array(values)))

    source = docs.withColumn(text, F.col(text).cast("string"))
    return source.mapInArrow(work, _schema(source, ids, ArrayType(IntegerType())))


def decode(rows: DataFrame, ids: str = "ids", data: str = "data", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """`rows` with the column `data` (binary): the bytes of each row's `ids`."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield _with(part, data, pa.array([bpe.decode(x or []) for x in part.column(ids).to_pylist()], pa.binary()))

    return rows.mapInArrow(work, _schema(rows, data, BinaryType()))
