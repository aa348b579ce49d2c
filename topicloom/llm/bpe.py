"""Byte-level BPE: encoding by a local rank file with the tiktoken library, and raw-byte decoding.

``encode_decode`` adds the ids and the decoded bytes of every text, ``encode``
and ``decode`` do the halves. Texts are never shortened.

Long texts are cut at safe boundaries first: before white space that follows
a non-space, and between an ASCII letter and an ASCII digit. No match of the
split pattern spans such a point and the pattern looks only forwards, so the
ids of the parts are the ids of the whole. A part without such a point, or
with a run of white space that the library's backtracking engine can't hold,
is matched by the ``regex`` module and its matches merged one at a time.

Defined results: null text counts as empty; empty text gives no ids and no
bytes; every input column is kept; an output column replaces an input column
of the same name; repeated rows stay repeated.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow, quoted, session, ship_code

#: Parts of about so many characters go to the library at once.
PART_CHARS = 1 << 16
#: The library's engine overflows on white space of some 10^6 characters; from here on it is not asked.
SPACE_RUN = 4096

_SAFE = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[!-~¡-ᙿ])(?=[ \n])")
_LONG_SPACE = re.compile(r"\s{%d,}" % SPACE_RUN)
_encoders: dict = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes, pattern: str):
    """The tiktoken encoding of a rank file's bytes, made once a process."""
    import tiktoken

    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _encoders:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def safe_parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Cut ``text`` at safe boundaries into parts of ``size`` characters or a little more."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def _merge_matches(part: str, enc, pattern: str) -> list[int]:
    import regex

    ids: list[int] = []
    for m in regex.finditer(pattern, part):
        ids.extend(enc._core_bpe.encode_single_piece(m.group().encode()))
    return ids


def encode_text(text: str, enc, pattern: str) -> list[int]:
    if len(text) <= PART_CHARS and not (len(text) > SPACE_RUN and _LONG_SPACE.search(text)):
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in safe_parts(text):
        if len(part) > 4 * PART_CHARS or _LONG_SPACE.search(part):
            ids.extend(_merge_matches(part, enc, pattern))
        else:
            ids.extend(enc.encode_ordinary(part))
    return ids


def _apply(df: DataFrame, new: list[T.StructField], work, held_col: str) -> DataFrame:
    """mapInArrow that keeps all columns and adds ``new``; ``work`` maps values to lists of columns.

    Output batches close at some 4 MB of input, so one batch of long texts
    doesn't become one batch of very long results.
    """
    names = {f.name for f in new}
    kept = [c for c in df.columns if c not in names or c == held_col]
    out = [c for c in kept if c not in names]
    schema = T.StructType([df.schema[c] for c in out] + new)

    def run(batches):
        import pyarrow as pa

        kinds = {"ids": pa.list_(pa.int32()), "bytes": pa.binary()}
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(held_col)).to_pylist()
            at = 0
            while at < len(values):
                end, size = at, 0
                while end < len(values) and size < 4 << 20:
                    size += len(values[end] or "") + 64
                    end += 1
                columns = work(values[at:end])
                made = [pa.array(c, kinds["ids" if isinstance(f.dataType, T.ArrayType) else "bytes"]) for c, f in zip(columns, new)]
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in out] + made, names=out + [f.name for f in new])
                at = end

    return map_arrow(df.select(*map(quoted, kept)), run, schema)


def encode_decode(df: DataFrame, rank_path: str, pattern: str, *, text_col: str = "text", ids_col: str | None = "ids", bytes_col: str | None = "decoded") -> DataFrame:
    """Add the ids of ``text_col`` and the bytes that they decode to; a name of None leaves that column out."""
    spark = session(df)
    ship_code(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(rank_path))  # one file of about 1 MB
    new = ([T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))] if ids_col else []) + ([T.StructField(bytes_col, T.BinaryType())] if bytes_col else [])

    def work(texts):
        enc = encoder(ranks.value, pattern)
        ids = [encode_text(t, enc, pattern) if t else [] for t in texts]
        return ([ids] if ids_col else []) + ([[enc.decode_bytes(x) for x in ids]] if bytes_col else [])

    return _apply(df, new, work, text_col)


def encode(df: DataFrame, rank_path: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    return encode_decode(df, rank_path, pattern, text_col=text_col, ids_col=ids_col, bytes_col=None)


def decode(df: DataFrame, rank_path: str, pattern: str, *, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add the raw bytes of ``ids_col``; null ids decode to nothing, an unknown id raises."""
    spark = session(df)
    ship_code(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(rank_path))

    def work(rows):
        enc = encoder(ranks.value, pattern)
        return [[enc.decode_bytes(x or []) for x in rows]]

    return _apply(df, [T.StructField(bytes_col, T.BinaryType())], work, ids_col)
