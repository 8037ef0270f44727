"""Scalar functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flags whose values are masked, in any case.
SECRET_FLAGS = ("--api-key", "--apikey", "--authorization", "--password", "--secret", "--token", "--access-token", "--refresh-token", "--private-key")
REDACTED = "[REDACTED]"
_CONTROLS = r"[\x00-\x1F\x7F-\x9F]"


def content_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:sha256:"), F.sha2(text, 256))


def is_digest(value: Column, length: int = 64) -> Column:
    return F.coalesce(value.rlike(f"^[0-9a-f]{{{length}}}$"), F.lit(False))


def redact_argv(argv: Column, flags: tuple[str, ...] = SECRET_FLAGS) -> Column:
    """Mask ``--flag=value`` and the item after ``--flag``; what has been masked is no flag itself."""
    known = [f.lower() for f in flags]
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("hide"))

    def step(state: Column, item: Column) -> Column:
        inline = F.length(F.regexp_extract(F.lower(item), "^(" + "|".join(re.escape(f) for f in known) + ")=", 0))
        shown = F.when(state["hide"], REDACTED).when(inline > 0, F.concat(F.substr(item, F.lit(1), inline), F.lit(REDACTED))).otherwise(item)
        return F.struct(F.array_append(state["out"], shown).alias("out"), F.coalesce(~state["hide"] & F.lower(item).isin(*known), F.lit(False)).alias("hide"))

    return F.aggregate(argv, empty, step, lambda state: state["out"])


def matches_redacted(stored: Column, supplied: Column) -> Column:
    """Whether a supplied item fits a stored one in which the first mask stands for any text."""
    at = F.instr(stored, REDACTED)
    prefix, suffix = F.substr(stored, F.lit(1), at - 1), F.substr(stored, at + len(REDACTED))
    fits = F.startswith(supplied, prefix) & F.endswith(supplied, suffix) & (F.length(supplied) >= F.length(prefix) + F.length(suffix))
    return F.when(at == 0, stored == supplied).otherwise(fits)


def resolves_command(stored: Column, supplied: Column) -> Column:
    """Whether a command may be run again: as stored if nothing is masked (``supplied`` null), else by a supplied one of the same shape."""
    whole = lambda c: (F.size(c) > 0) & F.forall(c, lambda x: F.coalesce(x != "", F.lit(False)))
    masked = F.exists(stored, lambda x: F.contains(x, F.lit(REDACTED)))
    pairs = F.zip_with(stored, supplied, lambda a, b: F.coalesce(matches_redacted(a, b), F.lit(False)))
    given = supplied.isNotNull()
    fits = F.when(masked, given & (F.size(stored) == F.size(supplied)) & whole(supplied) & F.forall(pairs, lambda x: x)).otherwise(~given)
    return F.coalesce(whole(stored) & fits, F.lit(False))


def line_anchor(text: Column, start: int, end: int) -> Column:
    """SHA-256 of the lines ``start`` to ``end`` (from 1), with the line feeds between; null if there are fewer."""
    lines = F.split(text, "\n", -1)
    return F.when(F.size(lines) >= end, F.sha2(F.array_join(F.slice(lines, start, end - start + 1), "\n"), 256))


def json_pointer_value(document: Column, pointer: str) -> Column:
    """The VARIANT at an RFC 6901 pointer of a JSON text: a token names a key of an object and, without leading zeros, a place in an array; SQL null if nothing is there."""
    if pointer and not pointer.startswith("/") or re.search(r"~(?![01])", pointer):
        raise ValueError(f"not a JSON pointer: {pointer!r}")
    found = F.try_parse_json(document)
    for part in pointer.split("/")[1:]:
        token = part.replace("~1", "/").replace("~0", "~")
        quote = '"' if "'" in token else "'"
        if quote in token:
            raise ValueError("a key with both kinds of quotes cannot be addressed")
        steps = [F.try_variant_get(found, f"$[{quote}{token}{quote}]", "variant")]
        if re.fullmatch(r"0|[1-9][0-9]{0,8}", token):
            steps.append(F.try_variant_get(found, f"$[{token}]", "variant"))
        found = F.coalesce(*steps)
    return found


def json_pointer(document: Column, pointer: str) -> Column:
    """The same as text; a JSON null reads ``null``, what is absent is SQL null."""
    value = json_pointer_value(document, pointer)
    return F.when(F.is_variant_null(value), "null").otherwise(F.try_variant_get(value, "$", "string"))


def normal_integer(text: Column) -> Column:
    """Canonical integer text; null if it is none."""
    return F.when(text == "-0", "0").when((F.length(text) <= 1000) & text.rlike(r"^-?(0|[1-9][0-9]*)$"), text)


def normal_artifact_decimal(text: Column) -> Column:
    """Plain decimal text of a number that may have an exponent, up to 38 digits, 18 of them after the point; null if it is none or does not fit exactly."""
    number = F.when((F.length(text) <= 200) & text.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,5})?$"), text)
    plain = number.try_cast("decimal(38,18)")
    exact = plain.cast("double") == number.try_cast("double")
    short = F.regexp_replace(F.regexp_replace(plain.cast("string"), "0+$", ""), r"\.$", "")
    return F.when(exact, F.when(plain == 0, "0").otherwise(short))


def normal_value(kind: str, text: Column) -> Column:
    """A value's canonical text by its base type; null if it is not of the type."""
    bounded = F.length(text) <= 2000
    rules = {
        "ct:decimal": normal_decimal(text), "ct:integer": normal_integer(text), "ct:boolean": F.when(text.isin("true", "false"), text),
        "ct:string": F.when(bounded, text), "ct:symbol": F.when(bounded & (text != ""), text), "ct:node_id": F.when(bounded & text.rlike(r"^[A-Za-z][A-Za-z0-9._:/-]{0,199}$"), text),
    }
    return rules[kind]


def normal_decimal(text: Column) -> Column:
    """Plain decimal text without exponent, trailing zeros or a negative zero; null if it is none."""
    plain = F.when(text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"), text)
    short = F.when(plain.contains("."), F.regexp_replace(F.regexp_replace(plain, "0+$", ""), r"\.$", "")).otherwise(plain)
    return F.when(short == "-0", "0").otherwise(short)


def approx(a: Column, b: Column, tolerance: float) -> Column:
    return F.coalesce(F.abs(a.try_cast("double") - b.try_cast("double")) <= tolerance, F.lit(False))


def portable_path(path: Column) -> Column:
    """Whether a path is relative, in canonical POSIX form, without controls, and stays below its root."""
    odd = path.rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)|(^|/)\.(/|$)|//|/$") | path.rlike(_CONTROLS)
    return F.coalesce((path != "") & (F.length(path) <= 4096) & ~odd, F.lit(False))


def resolved_path(token: Column, folder: Column) -> Column:
    """A relative argument, resolved against the parts of ``folder`` (array); null if it is an option, absolute, or leaves the root."""
    relative = F.coalesce((token != "") & ~token.rlike(r"^-|^/|^[\\]|^[A-Za-z]:") & ~token.rlike(_CONTROLS) & (F.length(token) <= 32768), F.lit(False))
    parts = F.split(F.when(F.contains(token, F.lit("\\")), F.translate(token, "\\", "/")).otherwise(token), "/")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1))
        return F.when(done.isNull() | part.isin("", "."), done).when(part == "..", up).otherwise(F.array_append(done, part))

    return F.when(relative, F.aggregate(parts, folder.cast("array<string>"), step))


def path_is_inside(path: Column, folder: Column) -> Column:
    return (path == folder) | F.startswith(path, F.concat(F.rtrim(folder, F.lit("/")), F.lit("/")))


def has_glob(text: Column) -> Column:
    return text.rlike(r"[*?\[\]]")


def recorded_at(text: Column) -> Column:
    """The instant of an RFC 3339 timestamp that ends in Z; null if it is none."""
    shaped = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"), F.regexp_replace(text, r"(\.\d{6})\d+Z$", "$1Z"))
    return shaped.try_cast("timestamp")


def is_iri(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:.+$") & ~text.rlike(r"[\s\x00-\x1F\x7F\p{Z}]"), F.lit(False))


def language_tag(text: Column) -> Column:
    """A simple language tag, lowered; null if it is none."""
    return F.when((F.length(text) <= 100) & text.rlike(r"^[A-Za-z0-9]+(-[A-Za-z0-9]+)*$"), F.lower(text))


def visible(text: Column, keep_newlines: bool = False, formats: bool = True) -> Column:
    """Controls, and format characters if asked, spelled as ``\\uXXXX``."""
    hidden = ("\\x00-\\x09\\x0B-\\x1F" if keep_newlines else "\\x00-\\x1F") + "\\x7F-\\x9F" + ("\\p{Cf}" if formats else "")
    spelled = lambda c: F.when(c.rlike(f"^[{hidden}]$"), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.unicode(c))), 4, "0"))).otherwise(c)
    return F.when(text.rlike(f"[{hidden}]"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1)), spelled), "")).otherwise(text)


def template_fields(template: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([A-Za-z_][A-Za-z0-9_]*)\}"), F.lit(1)))


def rendered(template: Column, arguments: Column) -> Column:
    """A template with each ``{name}`` replaced by the map's value; null if one is missing."""
    missing = F.exists(template_fields(template), lambda f: ~F.map_contains_key(arguments, f))
    parts = F.regexp_extract_all(template, F.lit(r"(\{[A-Za-z_][A-Za-z0-9_]*\}|[^{]+|\{)"), F.lit(1))
    fill = lambda x: F.coalesce(F.element_at(arguments, F.regexp_extract(x, r"^\{(\w+)\}$", 1)), x)
    return F.when(~missing, F.array_join(F.transform(parts, fill), ""))


def search_text(*columns: Column) -> Column:
    return F.concat_ws(" ", *columns)


def normal_node_id(text: Column) -> Column:
    """A dash stands for no node."""
    return F.when(text != "-", text)


def key_values(items: Column) -> Column:
    """``KEY=VALUE`` items as a map; null if an item has no key or a key comes twice."""
    pairs = F.transform(items, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substr(x, F.instr(x, "=") + 1).alias("v")))
    sound = F.forall(items, lambda x: F.instr(x, "=") > 1) & (F.size(F.array_distinct(F.transform(pairs, lambda x: x["k"]))) == F.size(items))
    return F.when(sound, F.map_from_entries(pairs))
