"""Vocabularies and rule packs as flat tables, checked by joins: any number of them at once.

- ``types``: ``vocabulary, id, base``; ``units``: ``vocabulary, unit``
- ``predicates``: ``vocabulary, id, kind``; ``arguments``: ``vocabulary, predicate, name, type, unit``
- ``renderers``: ``vocabulary, id, predicate, polarity, language, template``
- ``atoms``: ``vocabulary, rule, at, head, predicate, polarity`` (``at`` names the atom within its rule)
- ``terms``: ``vocabulary, rule, at, name, var, type, value, unit`` (a variable, or a constant)
- ``constraints``: ``vocabulary, rule, op, left, right`` with structs ``var, type, value, unit``

Issues are ``code, vocabulary, detail``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import normal_value, template_fields

#: The base types, those that can be ordered, polarities, kinds and comparators.
BASES = ("ct:string", "ct:symbol", "ct:node_id", "ct:integer", "ct:decimal", "ct:boolean")
ORDERED = ("ct:decimal", "ct:integer")
POLARITIES, KINDS = ("positive", "negative"), ("input", "derived")
COMPARATORS, ORDERING = ("eq", "ne", "gt", "gte", "lt", "lte"), ("gt", "gte", "lt", "lte")


def _issue(rows: DataFrame, code: str, *detail: str) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), "vocabulary", F.concat_ws(" ", *(F.col(d).cast("string") for d in detail)).alias("detail"))


def _repeated(rows: DataFrame, code: str, *by: str) -> DataFrame:
    return _issue(rows.groupBy("vocabulary", *by).agg(F.count("*").alias("n")).where("n > 1"), code, *by)


def _not(test: Column) -> Column:
    return ~F.coalesce(test, F.lit(False))


def _all(found: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, found)


def _bases(types: DataFrame) -> DataFrame:
    return types.groupBy("vocabulary", F.col("id").alias("type")).agg(F.min("base").alias("own_base"))


def _based(rows: DataFrame, types: DataFrame) -> DataFrame:
    """Rows with a ``type``, and its ``base``: its own if it is a core type, null if it is unknown."""
    return rows.join(_bases(types), ["vocabulary", "type"], "left").withColumn("base", F.when(F.col("type").isin(*BASES), F.col("type")).otherwise(F.col("own_base"))).drop("own_base")


def vocabulary_issues(types: DataFrame, units: DataFrame, predicates: DataFrame, arguments: DataFrame, renderers: DataFrame) -> DataFrame:
    """Repeated or reserved names, unknown bases, types, units, kinds and predicates, and templates whose fields are not the predicate's arguments."""
    known = predicates.select("vocabulary", F.col("id").alias("predicate")).distinct()
    typed = _based(arguments, types)
    odd_units = arguments.where("unit IS NOT NULL").join(units.distinct(), ["vocabulary", "unit"], "left_anti")
    names = arguments.groupBy("vocabulary", "predicate").agg(F.array_sort(F.collect_set("name")).alias("names"))
    drawn = renderers.join(known, ["vocabulary", "predicate"], "left_semi").join(names, ["vocabulary", "predicate"], "left")
    fields = F.array_sort(template_fields(F.col("template")))
    return _all([
        _issue(types.where(F.col("id").isin(*BASES)), "TYPE_RESERVED", "id"), _repeated(types, "TYPE_REPEATED", "id"), _issue(types.where(_not(F.col("base").isin(*BASES))), "TYPE_BASE_UNKNOWN", "id"),
        _repeated(units, "UNIT_REPEATED", "unit"), _repeated(predicates, "PREDICATE_REPEATED", "id"), _issue(predicates.where(_not(F.col("kind").isin(*KINDS))), "PREDICATE_KIND_INVALID", "id"),
        _repeated(arguments, "ARGUMENT_REPEATED", "predicate", "name"), _issue(typed.where("base IS NULL"), "ARGUMENT_TYPE_UNKNOWN", "predicate", "name", "type"), _issue(odd_units, "ARGUMENT_UNIT_UNKNOWN", "predicate", "name", "unit"),
        _repeated(renderers, "RENDERER_REPEATED", "id"), _repeated(renderers, "RENDERER_KEY_REPEATED", "predicate", "polarity", "language"), _issue(renderers.where(_not(F.col("polarity").isin(*POLARITIES))), "RENDERER_POLARITY_INVALID", "id"),
        _issue(renderers.join(known, ["vocabulary", "predicate"], "left_anti"), "RENDERER_PREDICATE_UNKNOWN", "id", "predicate"),
        _issue(drawn.where(~fields.eqNullSafe(F.coalesce("names", F.array().cast("array<string>")))), "RENDERER_FIELDS_DIFFER", "id"),
    ])


def _value_fits(base: Column, value: Column) -> Column:
    return F.coalesce(*(F.when(base == kind, normal_value(kind, value).isNotNull()) for kind in BASES), F.lit(False))


def rule_issues(types: DataFrame, units: DataFrame, predicates: DataFrame, arguments: DataFrame, atoms: DataFrame, terms: DataFrame, constraints: DataFrame) -> DataFrame:
    """Rules whose atoms, terms or constraints do not fit the vocabulary, or whose variables are unbound or of two kinds."""
    rule = ["vocabulary", "rule"]
    kinds = predicates.groupBy("vocabulary", F.col("id").alias("predicate")).agg(F.min("kind").alias("kind"))
    placed = atoms.join(kinds, ["vocabulary", "predicate"], "left")
    sound = placed.where("kind IS NOT NULL").select(*rule, "at", "head", "predicate")
    due = sound.join(arguments.select("vocabulary", "predicate", "name", F.col("type").alias("want_type"), F.col("unit").alias("want_unit")), ["vocabulary", "predicate"])
    given = terms.join(sound.select(*rule, "at"), [*rule, "at"], "left_semi")
    met = due.join(given, [*rule, "at", "name"], "full_outer")
    there = due.join(given, [*rule, "at", "name"])
    constant = _based(there.where("var IS NULL"), types)
    mismatch = ~F.col("type").eqNullSafe(F.col("want_type")) | ~F.col("unit").eqNullSafe(F.col("want_unit"))
    body = there.where("var IS NOT NULL AND NOT head").select(*rule, "var", F.struct(F.col("want_type").alias("type"), F.col("want_unit").alias("unit")).alias("kind")).distinct()
    bound = body.groupBy(*rule, "var").agg(F.min("kind").alias("kind"))
    used = there.where("var IS NOT NULL").select(*rule, "var", F.struct(F.col("want_type").alias("type"), F.col("want_unit").alias("unit")).alias("kind")).distinct()
    several = used.groupBy(*rule, "var").agg(F.count("*").alias("n")).where("n > 1")
    heads = there.where("var IS NOT NULL AND head").join(bound, [*rule, "var"], "left_anti")
    # constraints: the kind of each side, by its variable or its constant
    numbered = constraints.withColumn("side", F.explode(F.array(F.struct(F.lit("left").alias("s"), "left.*"), F.struct(F.lit("right").alias("s"), "right.*")))).select(*rule, "op", F.struct("op", "left", "right").alias("key"), "side.*")
    sided = _based(numbered.join(bound.withColumnRenamed("kind", "of"), [*rule, "var"], "left").withColumns({"is_var": F.col("var").isNotNull(), "type": F.coalesce("of.type", "type"), "unit": F.when(F.col("of").isNotNull(), F.col("of.unit")).otherwise(F.col("unit"))}), types)
    consts = sided.where("NOT is_var")
    odd_units = consts.where("unit IS NOT NULL").join(units.distinct(), ["vocabulary", "unit"], "left_anti")
    free = sided.where("is_var AND of IS NULL")
    sides = sided.where("NOT is_var OR of IS NOT NULL").groupBy(*rule, "op", F.col("key").cast("string").alias("key")).agg(F.count("*").alias("n"), F.min(F.struct("type", F.coalesce("unit", F.lit("")))).alias("a"), F.max(F.struct("type", F.coalesce("unit", F.lit("")))).alias("b"), F.min("base").alias("base"))
    ordered = sides.where(F.col("op").isin(*ORDERING) & _not(F.col("base").isin(*ORDERED)))
    return _all([
        _issue(atoms.where("NOT head").select(*rule).distinct().join(atoms.where("head"), rule, "left_anti"), "RULE_WITHOUT_HEAD", "rule"), _issue(atoms.where("head").select(*rule).distinct().join(atoms.where("NOT head"), rule, "left_anti"), "RULE_WITHOUT_BODY", "rule"),
        _issue(placed.where("kind IS NULL"), "RULE_PREDICATE_UNKNOWN", "rule", "predicate"), _issue(placed.where("head AND kind <> 'derived'"), "RULE_HEAD_NOT_DERIVED", "rule", "predicate"), _issue(atoms.where(_not(F.col("polarity").isin(*POLARITIES))), "RULE_POLARITY_INVALID", "rule", "at"),
        _issue(met.where("predicate IS NULL OR NOT coalesce(var IS NOT NULL OR type IS NOT NULL, false)").select(*rule, "at", "name"), "RULE_ARGUMENTS_DIFFER", "rule", "at", "name"),
        _issue(constant.where(mismatch & F.col("type").isNotNull()), "CONSTANT_KIND_DIFFERS", "rule", "at", "name"), _issue(constant.where(~mismatch & ~_value_fits(F.col("base"), F.col("value"))), "CONSTANT_VALUE_INVALID", "rule", "at", "name"),
        _issue(several, "VARIABLE_OF_SEVERAL_KINDS", "rule", "var"), _issue(heads, "VARIABLE_UNBOUND", "rule", "var"), _issue(free, "CONSTRAINT_VARIABLE_UNBOUND", "rule", "var"),
        _issue(constraints.where(_not(F.col("op").isin(*COMPARATORS))), "COMPARATOR_UNKNOWN", "rule", "op"), _issue(consts.where("base IS NULL"), "CONSTRAINT_TYPE_UNKNOWN", "rule", "type"), _issue(odd_units, "CONSTRAINT_UNIT_UNKNOWN", "rule", "unit"),
        _issue(consts.where(F.col("base").isNotNull() & ~_value_fits(F.col("base"), F.col("value"))), "CONSTRAINT_VALUE_INVALID", "rule", "value"),
        _issue(sides.where("n = 2 AND a <> b"), "CONSTRAINT_KINDS_DIFFER", "rule", "op"), _issue(ordered.where("n = 2 AND a = b"), "COMPARISON_NOT_NUMERIC", "rule", "op"),
    ])
