"""Canonical JSON: sorted keys, no blanks, UTF-8 as it is, array order kept.

Spark's ``to_json`` keeps the order of map entries, drops nulls and spells doubles in
its own way, so this is an Arrow-batched Python function.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Deeper documents are refused.
MAX_DEPTH = 256


def _unique(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("a key comes twice")
    return found


def _refused(name: str):
    raise ValueError(f"{name} is no JSON number")


def _depth(text: str) -> int:
    """The deepest nesting of brackets outside strings."""
    depth = most = 0
    quoted = escaped = False
    for c in text:
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
            most = max(most, depth)
        elif c in "]}":
            depth -= 1
    return most


def strict_loads(text: str):
    """A JSON value; repeated keys, NaN, infinities and deep nesting are errors."""
    if text.count("[") + text.count("{") > MAX_DEPTH and _depth(text) > MAX_DEPTH:
        raise ValueError("nested too deeply")
    return json.loads(text, object_pairs_hook=_unique, parse_constant=_refused)


def canonical(text: str | None, fields: tuple[str, ...] | None = None) -> str | None:
    """The canonical form, of the named fields of an object if asked; None if the text is not strict JSON."""
    try:
        value = strict_loads(text)
        if fields is not None:
            value = {k: value[k] for k in fields if k in value}
        return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    except (TypeError, ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(canonical, na_action="ignore").astype(object)


def canonical_sha256(text) -> object:
    """SHA-256 of the canonical form; null for what is not strict JSON."""
    return F.sha2(canonical_json(text), 256)


#: What identifies a file snapshot, and a stage trace.
SNAPSHOT_FIELDS = ("path", "state", "sha256", "file_version_id", "size")
TRACE_FIELDS = ("schema_version", "mode", "state", "trust", "required_stage_ids", "checkpoints", "checkpoint_sequence_sha256", "issues")


def fingerprint(fields: tuple[str, ...]):
    """A function of a JSON object's text: the hash of its named fields alone."""

    @F.pandas_udf(T.StringType())
    def of(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            found = canonical(text, fields)
            return None if found is None else hashlib.sha256(found.encode()).hexdigest()

        return texts.map(one, na_action="ignore").astype(object)

    return of
