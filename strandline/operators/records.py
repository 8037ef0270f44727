"""Stored records checked against a closed shape: keys, values, times and the content address.

A store is ``name, text``: file name and JSON of each record.  Issues are ``code, name, detail``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.canonical import canonical_json, fingerprint
from strandline.functions.scalars import recorded_at


@dataclass(frozen=True)
class Shape:
    """What a record must be: exactly the key ``id`` and ``keys``; the id is ``prefix`` and the hash of all but itself."""

    prefix: str
    keys: tuple[str, ...]
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)
    objects: tuple[str, ...] = ()
    arrays: tuple[str, ...] = ()
    times: tuple[str, ...] = ()


def _bad(test: Column) -> Column:
    return ~F.coalesce(test, F.lit(False))


def issues(store: DataFrame, shape: Shape) -> DataFrame:
    """One pass in generated code and one in Arrow batches; only repeated ids take a shuffle."""
    parsed = store.withColumn("sound", canonical_json("text").isNotNull())
    broken = parsed.where(~F.col("sound")).select(F.lit("INVALID_JSON").alias("code"), "name", F.lit("").alias("detail"))
    whole = parsed.where("sound").withColumns({"keys": F.json_object_keys("text"), "doc": F.try_parse_json("text")})
    value = lambda key: F.try_variant_get("doc", f"$['{key}']", "string")
    kind = lambda key: F.schema_of_variant(F.try_variant_get("doc", f"$['{key}']", "variant"))
    digest = F.concat(F.lit(f"{shape.prefix}:sha256:"), fingerprint(shape.keys)(F.col("text")))
    own = [F.lit(k) for k in ("id", *shape.keys)]
    listed = lambda names: F.array_join(F.array_sort(names), ",")
    named = value("id").rlike(f"^{shape.prefix}:sha256:[0-9a-f]{{64}}$")
    missing, extra = F.array_except(F.array(*own), "keys"), F.array_except("keys", F.array(*own))
    tests = [
        ("NOT_AN_OBJECT", F.col("keys").isNull(), F.lit("")),
        ("KEYS_MISSING", F.size(missing) > 0, listed(missing)), ("KEYS_UNKNOWN", F.size(extra) > 0, listed(extra)),
        *(("VALUE_NOT_ALLOWED", _bad((kind(k) == "STRING") & value(k).isin(*v)), F.lit(k)) for k, v in shape.allowed.items()),
        *(("VALUE_MALFORMED", _bad((kind(k) == "STRING") & value(k).rlike(p)), F.lit(k)) for k, p in shape.patterns.items()),
        *(("NOT_AN_OBJECT", _bad(kind(k).startswith("OBJECT")), F.lit(k)) for k in shape.objects),
        *(("NOT_AN_ARRAY", _bad(kind(k).startswith("ARRAY")), F.lit(k)) for k in shape.arrays),
        *(("TIME_MALFORMED", _bad((kind(k) == "STRING") & recorded_at(value(k)).isNotNull()), F.lit(k)) for k in shape.times),
        ("ID_MALFORMED", _bad(named), F.lit("id")),
        ("HASH_MISMATCH", named & (value("id") != F.col("digest")), F.lit("id")),
        ("NAME_DIFFERS", named & (F.col("name") != F.concat(F.substring_index(value("id"), ":", -1), F.lit(".json"))), F.lit("id")),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(code).alias("code"), detail.alias("detail"))) for code, test, detail in tests)))
    own_issues = whole.withColumn("digest", digest).select("name", F.explode(found).alias("x")).select("x.code", "name", "x.detail")
    again = whole.select("name", value("id").alias("id")).where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n > 1")
    return broken.union(own_issues).union(again.select(F.lit("ID_REPEATED"), "name", "id"))
