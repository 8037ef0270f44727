"""Operator 1: byte-level BPE encoding and decoding with a local rank file.

The tiktoken library does the merges.  A long text is first cut at *safe
boundaries*: positions that no match of the split pattern crosses, so that the
ids of the parts, put together, are the ids of the whole.

Cases: a null text counts as empty; an empty text has no ids and decodes to no
bytes; repeated rows each give their row; further columns are kept as they are;
an input column that bears an output's name is replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import bounded_batches, trim, worker_table

DEFAULT_RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters after which a text is cut at the next safe boundary.
CUT_AT = 1 << 16

#: Blanks from which a run is encoded as the one match that it is: the library's
#: matcher recurses for each blank of a mixed run.
LONG_BLANK = 1000

_SAFE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
_BLANK_RUN = regex.compile(rf"\p{{White_Space}}{{{LONG_BLANK},}}")


class Codec:
    """Encodes whole texts and decodes ids to raw bytes."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG_BLANK:
            return self.encoding.encode_ordinary(text)
        ids, start = [], 0
        for run in _BLANK_RUN.finditer(text):
            # The pattern takes all blanks at the text's end, else all but the last.
            end = run.end() if run.end() == len(text) else run.end() - 1
            ids += self._encode_parts(text[start : run.start()])
            ids += self.encoding._encode_single_piece(text[run.start() : end])
            start = end
        return ids + self._encode_parts(text[start:])

    def _encode_parts(self, text: str) -> list[int]:
        if len(text) <= CUT_AT:
            return self.encoding.encode_ordinary(text)
        return [i for part in safe_parts(text, CUT_AT) for i in self.encoding.encode_ordinary(part)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The raw bytes, which need not be whole UTF-8 characters."""
        return self.encoding.decode_bytes(ids.tolist())


def safe_parts(text: str, size: int) -> Iterator[str]:
    """Cut ``text`` at the first safe boundary after each ``size`` characters.

    Safe are: a non-blank before a blank (only a match's start can be a blank) and
    the border of letters and numbers.  No boundary, no cut.
    """
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found or found.start() >= len(text):
            break
        yield text[start : found.start()]
        start = found.start()
    if start < len(text):
        yield text[start:]


def codec(ranks_path: str) -> Codec:
    """One codec per Python worker."""
    return worker_table(("codec", ranks_path), lambda: Codec(ranks_path))


def _with(df: DataFrame, fields: list[tuple[str, T.DataType]], of: str, function) -> DataFrame:
    """Append columns that ``function(arrow column)`` computes batch by batch."""
    base = df.drop(*(name for name, _ in fields))
    schema = T.StructType([*base.schema.fields, *(T.StructField(name, kind) for name, kind in fields)])
    at = base.columns.index(of)
    names = [*base.columns, *(name for name, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *function(batch.column(at))], names=names)
        trim()

    return bounded_batches(base).mapInArrow(run, schema)


def encode(df: DataFrame, text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """Append ``n_tokens`` and ``token_ids`` (little-endian unsigned 32-bit integers, packed)."""
    path = ranks_path or public_tokenizers.path(DEFAULT_RANKS)

    def run(texts: pa.Array) -> list[pa.Array]:
        coder, counts, packed = codec(path), [], []
        for text in texts:
            ids = coder.encode(text.as_py() or "")
            counts.append(len(ids))
            packed.append(np.asarray(ids, dtype="<u4").tobytes())
        return [pa.array(counts, pa.int64()), pa.array(packed, pa.binary())]

    return _with(df, [("n_tokens", T.LongType()), ("token_ids", T.BinaryType())], text_col, run)


def decode(df: DataFrame, ids_col: str = "token_ids", ranks_path: str | None = None) -> DataFrame:
    """Append ``decoded``, the raw bytes of packed ids (null: none)."""
    path = ranks_path or public_tokenizers.path(DEFAULT_RANKS)

    def run(packed: pa.Array) -> list[pa.Array]:
        coder = codec(path)
        return [pa.array([coder.decode(np.frombuffer(ids.as_py() or b"", dtype="<u4")) for ids in packed], pa.binary())]

    return _with(df, [("decoded", T.BinaryType())], ids_col, run)


def op1_byte_bpe(documents: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """The digests of each document's ids and of the bytes that they decode to."""
    coded = decode(encode(documents.select("doc_id", "text"), ranks_path=ranks_path).drop("text"), ranks_path=ranks_path)
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
