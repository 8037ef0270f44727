"""Operator 9: token counts of sections by offset-mapped attribution.

Each document is encoded once, as a whole, so tokens are those that training will
see.  The tokens' character spans are then joined with the sections' spans, both
sorted, within the same batch; nothing is shuffled.  A token that crosses a
border goes by rule: ``start`` gives it to the section that holds its first byte,
``most`` to the section that holds most of its bytes (of equals the first).

Cases: a null or empty text has one empty section with no tokens; repeated rows
each give their rows; sections need not be even in size nor begin
with the text; offsets are code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.bpe import DEFAULT_RANKS, codec
from strandline.llm.common import bounded_batches

RULES = ("start", "most")


def line_starts(text: str) -> list[int]:
    """Sections are lines, each with the line feed that ends it."""
    starts, at = [0], text.find("\n")
    while at >= 0:
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    return starts


def attribute(text: str, starts: list[int], coder, rule: str = "start") -> tuple[int, np.ndarray]:
    """Tokens in all, and for each section (by its first code point, in order); what stands before the first section is nobody's."""
    if not len(starts) or starts[0]:
        total, counts = attribute(text, [0, *starts], coder, rule)
        return total, counts[1:]
    ids = coder.encode(text)
    counts = np.zeros(len(starts), dtype=np.int64)
    if not ids:
        return 0, counts
    lengths = np.fromiter((len(coder.encoding.decode_single_token_bytes(i)) for i in ids), dtype=np.int64, count=len(ids))
    ends = np.cumsum(lengths)
    begins = ends - lengths
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    first_bytes = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))  # byte offset of each code point
    borders = first_bytes[np.asarray(starts, dtype=np.int64)]
    own = np.searchsorted(borders, begins, side="right") - 1
    if rule == "most":
        last = np.searchsorted(borders, ends - 1, side="right") - 1
        for k in np.flatnonzero(own != last):
            inside = np.arange(own[k], last[k] + 1)
            tops = np.minimum(np.append(borders, len(raw))[inside + 1], ends[k])
            own[k] = inside[np.argmax(tops - np.maximum(borders[inside], begins[k]))]
    np.add.at(counts, own, 1)
    return len(ids), counts


def section_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections: Callable[[str], list[int]] = line_starts, rule: str = "start", ranks_path: str | None = None) -> DataFrame:
    """``id_col, doc_tokens, section, start, end, n_tokens``: one row for each section."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = ranks_path or public_tokenizers.path(DEFAULT_RANKS)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            row, totals, which, begin, end, n = [], [], [], [], [], []
            for k, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                starts = sections(text)
                total, counts = attribute(text, starts, coder, rule)
                row += [k] * len(starts)
                totals += [total] * len(starts)
                which += range(len(starts))
                begin += starts
                end += [*starts[1:], len(text)]
                n += counts.tolist()
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (totals, which, begin, end, n))], names=["id", "doc_tokens", "section", "start", "end", "n_tokens"])

    return bounded_batches(src).mapInArrow(run, f"id {kind}, doc_tokens long, section long, start long, end long, n_tokens long").withColumnRenamed("id", id_col)


def op9_token_counts(documents: DataFrame) -> DataFrame:
    """Tokens of each line of each document."""
    return section_tokens(documents)
