"""Room labels: normalisation, resolution, types and match scores, as column expressions."""

from __future__ import annotations

import functools
import html.entities
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.binding import let

#: Room label -> room type. The order decides between equally long labels.
ROOM_TYPES = {
    "MH": "bedroom", "MAKUUHUONE": "bedroom", "MAKUUH": "bedroom",
    "OH": "living_room", "OLOHUONE": "living_room", "OLOH": "living_room", "OLESKELU": "living_room",
    "H": "room", "AH": "hobby_room", "ASKARTELU": "hobby_room", "ALKOVI": "alcove",
    "K": "kitchen", "KEITTIO": "kitchen", "KK": "kitchen", "KT": "kitchen", "KEITTOKOMERO": "kitchen",
    "RUOK": "dining", "RUOKAILU": "dining",
    "ET": "entry", "ETEINEN": "entry", "TK": "draught_lobby", "TUULIKAAPPI": "draught_lobby",
    "AULA": "hall", "KAYTAVA": "corridor", "PORRAS": "stairs",
    "WC": "wc", "KH": "bathroom", "KPH": "bathroom", "KYLPYHUONE": "bathroom",
    "PH": "washroom", "PESUH": "washroom", "PSH": "washroom", "PESUHUONE": "washroom", "PKH": "washroom",
    "SH": "sauna", "SAUNA": "sauna", "S": "sauna", "LO": "sauna", "LOYLYHUONE": "sauna",
    "KHH": "utility", "VAR": "storage", "VARASTO": "storage", "TEKN": "technical_room", "TEKNINEN": "technical_room",
    "ULLAKKO": "attic", "APUK": "utility", "SK": "closet", "PK": "closet",
    "VH": "walk_in_closet", "VAATEHUONE": "walk_in_closet", "PUKUH": "dressing_room", "KOMERO": "closet",
    "TYOHUONE": "office", "TYOTILA": "office", "TH": "office", "RT": "office", "LH": "room",
    "ULKOTILA": "outdoor", "PARVEKE": "balcony", "PARV": "balcony", "TERASSI": "terrace", "KUISTI": "porch",
    "AUTOKATOS": "carport", "AUTOVAJA": "carport", "AUTOTALLI": "garage", "KATTH": "covered_terrace",
    "UNDEFINED": "undefined",
}
UNKNOWN, OTHER = "unknown", "other"
#: Shortest label, and shortest text, that may differ by one letter.
FUZZY_LENGTH = 5
#: Labels, longest first.
BY_LENGTH = sorted(ROOM_TYPES, key=len, reverse=True)


def lexicon(spark: SparkSession) -> DataFrame:
    """The lexicon as a dimension table (label, room_type, ord): 67 rows, always small enough to broadcast."""
    return spark.createDataFrame([(k, ROOM_TYPES[k], i) for i, k in enumerate(BY_LENGTH)], "label string, room_type string, ord int")


#: Stands between the values of a list that is handed over as one literal.
BETWEEN = "\x1f"


def _texts(values) -> Column:
    """A literal array; one expression, which the optimizer folds, instead of one call for each value."""
    return F.split(F.lit(BETWEEN.join(values)), BETWEEN)


def mapped(of: dict[str, str]) -> Column:
    """A literal map, handed over like ``_texts``."""
    return F.map_from_arrays(_texts(of), _texts(of.values()))


def type_of(label: Column) -> Column:
    """Room type of an exact lexicon label, null for any other."""
    return F.element_at(mapped(ROOM_TYPES), label)


def known(label: Column) -> Column:
    return F.array_contains(_texts(ROOM_TYPES), label)


@functools.cache
def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition leaves of other letters: (characters, their one letter, those that leave more)."""
    single, longer = {}, {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x30000)]):
        left = "".join(x for x in unicodedata.normalize("NFKD", c) if x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+")
        if left:
            (single if len(left) == 1 else longer)[c] = left
    return "".join(single), "".join(single.values()), longer


def _ranges(letters) -> str:
    """The inside of a character class of these letters, as runs of code points."""
    runs: list[list[int]] = []
    for k in sorted(map(ord, letters)):
        if runs and runs[-1][1] == k - 1:
            runs[-1][1] = k
        else:
            runs.append([k, k])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)


def unescaped(text: Column) -> Column:
    """``text`` with its character references (numeric, or named with a semicolon) replaced."""
    named = mapped({f"&{k}": v for k, v in html.entities.html5.items() if k.endswith(";")})

    def letter(ref: Column) -> Column:
        body = F.regexp_replace(ref, "^&#[xX]?|;$", "")
        number = F.when(ref.rlike("^&#[xX]"), F.conv(body, 16, 10)).when(ref.startswith("&#"), body).try_cast("int")
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).when(ref.startswith("&#"), "\ufffd").otherwise(F.element_at(named, ref))

    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"), F.lit(0)))
    # The ampersand comes last, so that what it gives is not read again.
    late = lambda r: F.struct(letter(r).eqNullSafe(F.lit("&")).alias("last"), r.alias("ref"))
    replace = lambda t, r: F.replace(t, r["ref"], F.coalesce(letter(r["ref"]), r["ref"]))
    return F.when(text.contains("&"), F.aggregate(F.array_sort(F.transform(refs, late)), text, replace)).otherwise(text)


def normalise_label(text: Column) -> Column:
    """Upper case without accents, references, blanks or punctuation other than ``+``; letters in their plain form."""
    single, plain, longer = _plain_letters()
    wide = _ranges(longer)
    apart = lambda c: F.coalesce(F.element_at(mapped(longer), c), c)

    def spelled(upper: Column) -> Column:
        spread = F.array_join(F.transform(F.split(upper, ""), apart), "")
        letters = F.translate(F.when(upper.rlike(f"[{wide}]"), spread).otherwise(upper), single, plain)
        return F.when(upper.rlike(r"[^\x00-\x7F]"), letters).otherwise(upper)

    return F.regexp_replace(let(F.upper(unescaped(text)), spelled), "[^A-Z0-9+]", "")


@functools.cache
def _accented_letters() -> tuple[str, str]:
    """Letters that are a plain one with accents, by canonical decomposition of their one upper case letter, and the plain ones."""
    plain = {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x30000)]):
        upper = c.upper() if len(c.upper()) == 1 else c
        left = "".join(x for x in unicodedata.normalize("NFD", upper) if x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        if left:
            plain[c] = left
    return "".join(plain), "".join(plain.values())


def stored_label(text: Column) -> Column:
    """The normal form that label keys have in SQL: ``normalise_label`` without compatibility forms or references but ``&amp;``.

    So a superscript or a ligature goes instead of giving its plain letters, and of ``&ouml;`` the letters of its name stay.
    """
    whole = F.replace(F.replace(text, F.lit("&amp;"), F.lit("&")), F.lit("ß"), F.lit("ss"))
    # Upper case comes last: by then only letters without special cases are left.
    return F.upper(F.regexp_replace(F.translate(whole, *_accented_letters()), "[^A-Za-z0-9+]", ""))


def without_index(label: Column) -> Column:
    """A normalised label of two letters or more without the one or two digits that number it; else null."""
    return F.nullif(F.regexp_extract(label, "^([A-Z]{2,})[0-9]{1,2}$", 1), F.lit(""))


def resolve(label: Column) -> Column:
    """The lexicon label that a normalised label stands for: itself, without its index, or one letter away; else null."""
    long = _texts([x for x in BY_LENGTH if len(x) >= FUZZY_LENGTH])

    def found(own: Column) -> Column:
        near = F.get(F.filter(long, lambda x: F.levenshtein(x, own, 1) >= 0), F.lit(0))
        base = without_index(own)
        return F.when(known(own), own).when(known(base), base).when(F.length(own) >= FUZZY_LENGTH, near)

    return let(label, found)


def parts(label: Column) -> Column:
    """The parts of a normalised compound label."""
    return F.filter(F.split(label, r"\+"), lambda p: p != "")


def primary_type(label: Column, resolved: Column) -> Column:
    """The type to store for a normalised label: its own, or that of the first known part of a compound."""
    first = F.get(F.filter(parts(label), known), F.lit(0))
    simple = F.when(~label.contains("+"), type_of(resolved))
    return F.coalesce(simple, F.when(first.isNotNull(), type_of(first)), F.lit(UNKNOWN))


def storable_type(room_type: Column) -> Column:
    """Types outside the enumeration (``unknown`` is) are stored as ``other``."""
    return F.when(F.array_contains(_texts(sorted(set(ROOM_TYPES.values()))), room_type), room_type).otherwise(OTHER)


def nearest_tenth(numerator: Column, denominator: Column) -> Column:
    """5 * numerator / denominator as a rounded integer, ties as binary floats of such scores fall.

    Of the halves only 2.5 and 0.25-like ones occur: 0.5, 1.5, 2.5, 3.5 and 4.5 tenths go to 1, 1, 2, 3 and 5.
    """
    twice = numerator * 10  # halves of a tenth, times the denominator
    half = (twice % denominator == 0) & ((twice / denominator) % 2 == 1)
    halves = twice / denominator
    tied = F.when(halves == 1, 1).when(halves == 3, 1).when(halves == 5, 2).when(halves == 7, 3).otherwise(5)
    return F.when(half, tied).otherwise(F.floor((numerator * 10 + denominator) / (denominator * 2))).cast("int")


def label_score(label: Column) -> Column:
    """How much a normalised text looks like a room label, in tenths."""
    named = _texts([x for x in BY_LENGTH if len(x) >= 2])

    def scored(own: Column) -> Column:
        inside = F.get(F.filter(named, lambda x: own.contains(x)), F.lit(0))
        of = parts(own)
        return (
            F.when(own == "", 0)
            .when(known(own) | F.coalesce(known(without_index(own)), F.lit(False)), 10)
            .when((F.size(of) > 1) & F.forall(of, known), 9)
            .when((F.size(of) > 1) & F.exists(of, known), 7)
            .when(inside.isNotNull(), nearest_tenth(F.length(inside), F.length(own)))
            .otherwise(0)
        )

    return let(label, scored)
