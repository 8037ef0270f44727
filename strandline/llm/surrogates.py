"""Operator 10: personal data replaced by keyed surrogates.

Detected entities are e-mail addresses, IPv4 addresses, card numbers, social
security numbers (kind ``id``), telephone numbers and names.  Names are found after titles, which may be stacked and be
followed by initials, particles and any number of words; a surname so found is
also taken where it stands bare in the same text.  The words of a name are
entities of their own, so a full name and a bare surname keep belonging together.

A surrogate comes from a keyed permutation of all values of the same *format*
(which characters stand where): letters stay letters of the same script, case and
kind (vowel or consonant, with or without an accent), digits stay digits,
separators stay; a name keeps the last letter, which carries its gender in many
languages, and its title; a card keeps its first digit, and is valid exactly if it
was; an address keeps octets in range.  The permutation is made to move every
value, formats are told from one another by what is kept, so distinct entities
stay distinct, none stays as it is, and the same entity has the same surrogate
everywhere; ``checked`` verifies this on the corpus by grouped counts and raises.
A value whose format holds no other is masked by a keyed digest.

The key is the secret: whoever has it can undo the surrogates.  A surrogate may
equal another value that occurs in the corpus, which has then been replaced too.

Cases: null texts stay null; texts without entities stay as they are; repeated
rows each keep their row; other columns are kept and clashing ones are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import re
import secrets
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import bounded_batches, trim, written

KINDS = ("email", "ip", "card", "id", "phone", "name")
#: Titles. Fixed values.
TITLES = "Mr Mrs Ms Miss Mister Sir Dr Prof Professor Herr Herrn Frau Fräulein Mme Mlle M Monsieur Madame Sr Sra Srta Señor Señora Señorita Don Doña г-н г-жа господин госпожа доктор".split()
#: Words within names. Fixed values.
PARTICLES = "von vom zu zur van der den de du del della di da dos das la le el bin ibn al ter".split()
#: Words that announce a telephone number. Fixed values.
CUES = "tel telefon telephone teléfono téléphone phone fon fax call mobile mobil handy cell móvil portable тел телефон".split()

PATTERNS = (
    ("email", re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("card", re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)")),
    ("id", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ ./-]?)?(?:\(\d{1,4}\)[ ./-]?)?\d{2,5}(?:[ ./-]\d{2,8}){1,4}(?![\w])|(?<!\w)\+\d{8,15}(?!\w)|(?<![\w.])\d{6,15}(?!\w)")),
)
_NAME_WORD = r"\p{Lu}[\p{L}\p{M}]*(?:(?:['’-]\p{L}[\p{L}\p{M}]*)+|(?<=[\p{L}\p{M}]{2}))"
_NAMED = regex.compile(
    rf"(?<!\w)(?:(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\b\.?[  ]+)+"
    rf"((?:(?:\p{{Lu}}\.[  -]?)|(?:{'|'.join(PARTICLES)})[  ])*{_NAME_WORD}"
    rf"(?:[  ](?:(?:{'|'.join(PARTICLES)})[  ])*(?:\p{{Lu}}\.(?=[  ]\p{{Lu}})|{_NAME_WORD}))*)"
)
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_TITLED = regex.compile(rf"(?<!\w)(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})(?!\w)")
_CUE = re.compile(rf"(?:^|\W)(?:{'|'.join(CUES)})\W{{0,3}}(?:\w+\W{{1,2}})?$", re.IGNORECASE)
#: A telephone number without a cue: a country code, a bracketed area code, a trunk zero, or groups of three, three and four.
_SHAPED = re.compile(r"\+|.*\(\d|0\d+[ ./-]|\d{3}[ .-]\d{3}[ .-]\d{4}$")
_DATE = re.compile(r"\d{4}([./-])\d{1,2}\1\d{1,2}|\d{1,2}([./-])\d{1,2}\2(?:\d{4}|\d{2})")
#: The session's name for the key; without it, each run draws its own.
KEY_NAME = "spark.strandline.surrogateKey"


def _alphabets() -> list[str]:
    """Alphabets whose members may replace one another: letters of a script, case, kind and accent; digits."""
    vowels = set("aeiouæœøаеиоуыэюяєіαεηιουω")
    found: dict[tuple, str] = {}
    for point in (*range(0x41, 0x7B), *range(0xC0, 0x180), *range(0x370, 0x530)):
        c = chr(point)
        if c.isalpha() and (c.islower() or c.isupper()) and len(c.lower()) == 1 == len(c.upper()):
            base = unicodedata.normalize("NFD", c)[0]
            key = (point < 0x180, point >= 0x400, c.isupper(), base.lower() in vowels, point >= 0x80 and (point < 0x180 or base != c))
            found[key] = found.get(key, "") + c
    return ["0123456789", *(a for a in found.values() if len(a) > 1)]


ALPHABETS = _alphabets()
_CLASS = {c: k for k, a in enumerate(ALPHABETS) for c in a}


def _rounds(value: int, half: int, key: bytes, tweak: str, back: bool) -> int:
    mask = (1 << half) - 1
    left, right = value >> half, value & mask
    mix = lambda turn, x: int.from_bytes(hashlib.blake2b(f"{tweak}|{turn}|{x}".encode(), key=key[:64]).digest(), "big") & mask
    for turn in reversed(range(8)) if back else range(8):
        if back:
            left, right = right ^ mix(turn, left), left
        else:
            left, right = right, left ^ mix(turn, right)
    return left << half | right


def permuted(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of ``range(size)`` or its inverse: a Feistel network on bits, walked until back in range."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    while True:
        value = _rounds(value, half, key, tweak, back)
        if value < size:
            return value


def moved(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation that moves every value: one step along a secret circle through all of them."""
    return permuted((permuted(value, size, key, tweak) + 1) % size, size, key, tweak, back=True)


def _check_digit(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def valid_card(text: str) -> bool:
    digits = [c for c in text if c.isdigit()]
    return 13 <= len(digits) <= 19 and _check_digit("".join(digits[:-1])) == int(digits[-1])


def _is_phone(text: str, start: int, end: int) -> bool:
    found = text[start:end]
    if not 6 <= sum(c.isdigit() for c in found) <= 15 or _DATE.fullmatch(found):
        return False
    return bool(_CUE.search(text[max(0, start - 40) : start])) or (sum(c.isdigit() for c in found) >= 8 and bool(_SHAPED.match(found)))


def _names(text: str) -> list[tuple[int, int, str]]:
    """The words of names; the first of each mention has kind ``name``, the others ``part``."""
    if not _TITLED.search(text):
        return []
    found, surnames = [], set()
    for m in _NAMED.finditer(text):
        words = [w for w in _WORD.finditer(text, m.start(1), m.end(1)) if w.group() not in PARTICLES]
        found += [(w.start(), w.end(), "part" if k else "name") for k, w in enumerate(words)]
        if len(words[-1].group()) > 1:
            surnames.add(words[-1].group())
    if surnames:
        have = {(a, b) for a, b, _ in found}
        found += [(*w.span(), "name") for w in _WORD.finditer(text) if w.group() in surnames and w.span() not in have]
    return found


def detect(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)``, leftmost first and without overlap; an earlier kind wins."""
    found: list[tuple[int, int, str]] = []
    taken = bytearray(0)

    def keep(start: int, end: int, kind: str) -> None:
        nonlocal taken
        if not taken:
            taken = bytearray(len(text))
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            found.append((start, end, kind))

    for kind, pattern in PATTERNS:
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            if kind == "card" and not (valid_card(m.group()) or sum(c.isdigit() for c in m.group()) == 16):
                continue
            if kind == "phone" and not _is_phone(text, *m.span()):
                continue
            keep(*m.span(), kind)
    for span in _names(text):
        keep(*span)
    return sorted(found)


def surrogate(kind: str, entity: str, key: bytes) -> str:
    """A value of the same kind and format; for a fixed key and kind distinct entities stay distinct and none stays as it is."""
    if kind == "ip":
        number = functools.reduce(lambda a, b: a << 8 | int(b), entity.split("."), 0)
        number = moved(number, 1 << 32, key, "ip")
        return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
    fixed: set[int] = set()
    form, digits = "", []
    if kind == "card":
        digits = [i for i, c in enumerate(entity) if c.isdigit()]
        fixed = {digits[0], digits[-1]}
        off = (int(entity[digits[-1]]) - _check_digit("".join(entity[i] for i in digits[:-1]))) % 10  # 0: valid
        form = f"{off}|"
    elif kind == "phone":
        fixed = set(range(re.match(r"\+\d{1,3}(?=\D)|\+\d\d|0*", entity).end()))
    elif kind == "email":
        fixed = set(range(entity.rindex("."), len(entity)))
    elif kind == "part" or kind == "name":
        kind = "name"
        fixed = {len(entity) - 1} if len(entity) > 1 else set()
    places = [i for i, c in enumerate(entity) if i not in fixed and c in _CLASS]
    # A number's first digit is no zero and does not become one: a zero there is kept and part of the format.
    alphabets = {i: ALPHABETS[_CLASS[entity[i]]] for i in places}
    if kind == "phone" and places and entity[places[0]] in "123456789":
        alphabets[places[0]] = "123456789"
    form += "|".join(f"[{alphabets[i][0]}]" if i in alphabets else c for i, c in enumerate(entity) if not digits or i != digits[-1])
    number, size = 0, 1
    for i in places:
        number = number * len(alphabets[i]) + alphabets[i].index(entity[i])
        size *= len(alphabets[i])
    if size < 2:
        return f"[{kind}-{hashlib.blake2b(entity.encode(), key=key[:64], digest_size=16).hexdigest()}]"
    number = moved(number, size, key, f"{kind}|{form}")
    out = list(entity)
    for i in reversed(places):
        number, rest = divmod(number, len(alphabets[i]))
        out[i] = alphabets[i][rest]
    if kind == "card":
        out[digits[-1]] = str((_check_digit("".join(out[i] for i in digits[:-1])) + off) % 10)
    return "".join(out)


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, or one of this run's own, which nobody keeps."""
    named = spark.conf.get(KEY_NAME, None)
    return hashlib.blake2b(named.encode()).digest() if named else secrets.token_bytes(64)


def checked(pairs: DataFrame) -> None:
    """Raise unless ``kind, entity, surrogate`` are one to one and nothing stays as it is; grouped counts only."""
    distinct = pairs.distinct()
    twice = lambda c: distinct.groupBy("kind", c).count().where("count > 1").select(F.lit(c).alias("what"), "kind")
    bad = twice("entity").union(twice("surrogate")).union(distinct.where("entity = surrogate").select(F.lit("same"), "kind")).limit(1).collect()
    if bad:
        raise RuntimeError(f"surrogates are not one to one: {bad[0]['what']} of kind {bad[0]['kind']}")


def replace(df: DataFrame, key: bytes, text_col: str = "text", out: str = "safe_text") -> DataFrame:
    """Append ``out`` and ``n_<kind>`` (mentions) for each kind; the texts are read once, and the result is stored and checked.

    With ``out`` equal to ``text_col`` the safe text takes the place of the text, which is then not stored.
    """
    if not key:
        raise ValueError("surrogates need a key")
    added = [out, *(f"n_{k}" for k in KINDS)]
    base = df.drop(*(c for c in (*added, "__pairs") if c != text_col))
    kept = [c for c in base.columns if c != out]
    at, names = base.columns.index(text_col), [*kept, *added, "__pairs"]
    pair = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "entity", "surrogate")]))
    schema = T.StructType([*(base.schema[c] for c in kept), T.StructField(out, T.StringType()), *(T.StructField(c, T.LongType()) for c in added[1:]), T.StructField("__pairs", pair)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, pairs = [], [[] for _ in KINDS], []
            for value in batch.column(at):
                text = value.as_py()
                spans = detect(text) if text else []
                pieces, last, own = [], 0, {}
                for a, b, kind in spans:
                    which = "name" if kind == "part" else kind
                    if (which, text[a:b]) not in own:
                        own[which, text[a:b]] = surrogate(kind, text[a:b], key)
                    pieces += [text[last:a], own[which, text[a:b]]]
                    last = b
                texts.append("".join(pieces) + text[last:] if spans else text)
                pairs.append([{"kind": k, "entity": e, "surrogate": s} for (k, e), s in own.items()])
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s[2] == kind for s in spans))
            fields = pa.list_(pa.struct([(c, pa.string()) for c in ("kind", "entity", "surrogate")]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in counts), pa.array(pairs, fields)], names=names)
        trim()

    safe = written(bounded_batches(base).mapInArrow(run, schema), "surrogates")
    checked(safe.select(F.explode("__pairs").alias("p")).select("p.*"))
    return safe.drop("__pairs")


def op10_surrogates(documents: DataFrame) -> DataFrame:
    safe = replace(documents.select("doc_id", "text"), session_key(documents.sparkSession), out="text")
    return safe.select("doc_id", *(f"n_{k}" for k in KINDS), "text")
