"""Reading dimensions, areas and codes from single tokens, as column expressions."""

from __future__ import annotations

import functools

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.binding import let
from tessella.functions.lexicon import mapped, normalise_label, primary_type, resolve

#: The parts and the shape of each kind of token, and the marks that stand for a raised 2.
NUMBER, AREA_UNIT, LENGTH_UNIT = r"\d+(?:[.,]\d+)?", r"(?:[mM]\s*[²2])", "(?:mm|cm|m)"
FEET = r"(\d+)\s*'\s*(?:-\s*)?(?:(\d+)\s*\")?"
DAMAGED_UNIT = r"(?i)m\s*(?=[\^{}])[\^{}\s]*([2²])?[\^{}\s]*"
SCALE = r"^1\s*[:/]\s*\d{1,4}$"
ELEVATION = r"^[+-]\s*\d{1,3}[.,]\d{2,3}$"
SUMMARY = rf"(?i)^\s*\d+\s*H\b.*?({NUMBER})\s*{AREA_UNIT}\s*$"
SHEET = r"^[A-Za-z]{1,3}[-_ ]?\d{1,4}$|^\d{1,3}\s*/\s*\d{1,3}$"
IMPERIAL = rf"^{FEET}\s*[x×X]\s*{FEET}$"
PAIR = rf"^({NUMBER})\s*{LENGTH_UNIT}?\s*[x×X]\s*({NUMBER})\s*({LENGTH_UNIT})?\s*$"
LABEL_AREA = rf"^([A-Za-zÄÖÅäöå][A-Za-zÄÖÅäöå.+/ ]*?)\s+({NUMBER})\s*{AREA_UNIT}?$"
AREA = rf"^({NUMBER})\s*({AREA_UNIT})?$"
YEAR = r"^(?:19|20)\d{2}$"
APARTMENT_CODE = r"[0-9A-Za-z]\s*H\s*\+\s*[A-Za-z$§]{1,3}(?:\s*\+\s*[A-Za-z$§]{1,3})*"
LEAST_AREA, MOST_AREA, MOST_DOOR, LEAST_MM = 1.0, 500.0, 30, 400
#: Area formats that nothing on the token itself corroborates.
WEAK = ("area_bare_integer", "label_area_integer")


#: Why a token is read as it is, by its format; %s stands for a value of the token.
REASONS = {
    "empty": "empty token",
    "scale": "drawing scale label",
    "elevation": "floor elevation mark",
    "apartment_summary": "apartment summary describing the whole unit, not a room",
    "sheet_number": "sheet or drawing number",
    "imperial_pair": "imperial feet/inches pair",
    "imperial_zero": "imperial pair contains a zero side",
    "pair_zero": "pair contains a zero or negative side",
    "mm_pair_explicit": "millimetre pair",
    "cm_pair": "centimetre pair",
    "m_pair_explicit": "metre pair with explicit unit",
    "m_pair_decimal": "decimal pair read as metres",
    "door_window_code": "integer pair with both sides <= 30 and no unit: Finnish door/window size code in decimetres, not a room dimension",
    "mm_pair": "large integer pair read as mm",
    "pair": "integer pair %sx%s matches neither a door code (both <= 30) nor a millimetre pair (both >= 400)",
    "unknown_label": "looks like a label+area pair but '%s' is not a known Finnish room label",
    "year": "bare 4-digit integer in year range: a year, sheet number or millimetre wall run, but not a room area",
    "bare_integer": "bare integer %s exceeds the plausible area range; most likely a millimetre wall run",
    "explicit": "area with explicit unit",
    "bare": "bare number read as an area",
    "implausible": "; implausible magnitude",
    "label_only": "room label with no dimension attached",
    "nothing": "no dimension, area or code pattern matched",
}
#: Warnings; %s stands for values of the token.
AREA_RANGE, IMPLIED, REPAIRED = "area %s m2 is %s the plausible range [1, 500]", "implied area %s m2 is outside the plausible range", "area unit repaired: %s -> %s"


def significant(value: Column, digits: int = 6) -> Column:
    """A number below a million with so many significant digits, without trailing zeros; above, as a whole number."""
    out = F.format_string(f"%.{digits}f", value)
    for k in range(digits):
        out = F.when(F.abs(value) >= 10.0**k, F.format_string(f"%.{digits - 1 - k}f", value)).otherwise(out)
    return F.when(out.contains("."), F.regexp_replace(out, r"\.?0+$", "")).otherwise(out)


def quoted(text: Column) -> Column:
    """A text between quotes, double ones if it holds single ones only."""
    double = text.contains("'") & ~text.contains('"')
    single = F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'))).otherwise(single)


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def repair_unit(text: Column) -> Column:
    """Undo markup that recognisers put in place of a raised 2; a bare trailing m is left alone."""
    return clean(F.regexp_replace(F.replace(text, F.lit("$"), F.lit("")), DAMAGED_UNIT, "m2"))


def number(text: Column) -> Column:
    """A decimal with comma or point; an empty text has none."""
    return F.replace(F.nullif(text, F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def decimal(text: Column) -> Column:
    return text.rlike("[.,]")


def plausible(area: Column) -> Column:
    return area.between(LEAST_AREA, MOST_AREA)


def apartment_code(text: Column) -> Column:
    """Whether a token carries the type code of a whole apartment."""
    return text.rlike(APARTMENT_CODE)


def staged(first: dict[str, Column], *stages) -> Column:
    """A struct built in stages; each stage gets the struct so far and returns the fields that it adds.

    Every stage is bound to a lambda variable and so evaluated once, however often later stages or the optimizer refer
    to its fields. Plain chained columns would be substituted into each other when a filter is pushed down.
    """

    def follow(r: Column, names: list[str], rest) -> Column:
        if not rest:
            return r
        more = rest[0](r)
        both = F.struct(*[r[n].alias(n) for n in names if n not in more], *[c.alias(n) for n, c in more.items()])
        return let(both, lambda x: follow(x, [n for n in names if n not in more] + list(more), rest[1:]))

    start = F.struct(*[c.alias(n) for n, c in first.items()])
    return let(start, lambda r: follow(r, list(first), stages))


PAIRS = ("imperial_pair", "mm_pair_explicit", "cm_pair", "m_pair_explicit", "m_pair_decimal", "mm_pair")
FIELDS = ["raw", "kind", "fmt", "area_m2", "width_m", "length_m", "label", "room_type", "plausible", "repaired", "reason", "warnings"]


def _text(r: Column) -> dict[str, Column]:
    return {"t": F.when(r["fixed"] == "", r["raw"]).otherwise(r["fixed"])}


def _own_label(r: Column) -> dict[str, Column]:
    return {"norm": normalise_label(r["t"])}


def _rule(r: Column) -> dict[str, Column]:
    t = r["t"]
    return {
        "rule": F.when(t.rlike(SCALE), "scale")
        .when(t.rlike(ELEVATION), "elevation")
        .when(t.rlike(SUMMARY), "apartment_summary")
        .when(t.rlike(SHEET) & r["own"].isNull(), "sheet_number")
        .when(t.rlike(IMPERIAL), "imperial")
        .when(t.rlike(PAIR), "pair")
        .when(t.rlike(LABEL_AREA), "label_area")
        .when(t.rlike(AREA), "area")
        .when(r["own"].isNotNull(), "label_only")
        .otherwise("")
    }


def _values(r: Column) -> dict[str, Column]:
    group = lambda pattern, k: F.regexp_extract(r["t"], pattern, k)
    feet = lambda f, i: (number(group(IMPERIAL, f)) * 12 + F.coalesce(number(group(IMPERIAL, i)), F.lit(0.0))) * 0.0254
    rule = r["rule"]
    return {
        "a": F.when(rule == "imperial", feet(1, 2)).when(rule == "pair", number(group(PAIR, 1))),
        "b": F.when(rule == "imperial", feet(3, 4)).when(rule == "pair", number(group(PAIR, 2))),
        "unit": F.when(rule == "pair", group(PAIR, 3)).when(rule == "area", group(AREA, 2)),
        "fraction": F.when(rule == "pair", decimal(group(PAIR, 1)) | decimal(group(PAIR, 2))),
        "name": F.when(rule == "label_area", group(LABEL_AREA, 1)),
        "digits": F.when(rule == "label_area", group(LABEL_AREA, 2)).when(rule == "area", group(AREA, 1)),
    }


def _format(r: Column) -> dict[str, Column]:
    a, b, unit, rule, value = r["a"], r["b"], r["unit"], r["rule"], number(r["digits"])
    pair = (
        F.when((a <= 0) | (b <= 0), "pair").when(unit == "mm", "mm_pair_explicit").when(unit == "cm", "cm_pair").when(unit == "m", "m_pair_explicit")
        .when(r["fraction"], "m_pair_decimal").when((a <= MOST_DOOR) & (b <= MOST_DOOR), "door_window_code").when((a >= LEAST_MM) & (b >= LEAST_MM), "mm_pair").otherwise("pair")
    )
    named = F.when(r["resolved"].isNull() | r["t"].rlike(AREA_UNIT) | decimal(r["digits"]), "label_area").otherwise("label_area_integer")
    bare = (
        F.when(unit != "", "area_unit").when(r["t"].rlike(YEAR) | (~decimal(r["digits"]) & (value > MOST_AREA)), "bare_integer")
        .when(~decimal(r["digits"]), "area_bare_integer").otherwise("area_bare")
    )
    return {"fmt": F.when(rule == "imperial", "imperial_pair").when(rule == "pair", pair).when(rule == "label_area", named).when(rule == "area", bare).otherwise(rule)}


def _kind(r: Column) -> dict[str, Column]:
    fmt = r["fmt"]
    is_area = fmt.isin("area_unit", "area_bare", *WEAK) | ((fmt == "label_area") & r["resolved"].isNotNull())
    return {
        "kind": F.when(fmt.isin(*PAIRS) & (r["a"] > 0) & (r["b"] > 0), "dimension_pair").when(is_area, "area").when(fmt == "door_window_code", "door_window_code").otherwise("unknown"),
        "scale": F.when(fmt.isin("mm_pair", "mm_pair_explicit"), 1000.0).when(fmt == "cm_pair", 100.0).when(fmt == "door_window_code", 10.0).otherwise(1.0),
    }


def _result(r: Column) -> dict[str, Column]:
    kind, fmt, sides = r["kind"], r["fmt"], r["kind"].isin("dimension_pair", "door_window_code")
    size = F.when(kind == "area", number(r["digits"])).when(kind == "dimension_pair", (r["a"] / r["scale"]) * (r["b"] / r["scale"]))
    labelled = (kind == "area") & (r["rule"] == "label_area")
    likely = F.coalesce(plausible(size), F.lit(True))
    t, why = r["t"], lambda name: F.lit(REASONS[name])
    explicit = F.when(r["rule"] == "label_area", t.rlike(AREA_UNIT)).otherwise(fmt == "area_unit")
    area_reason = F.concat(F.when(explicit, REASONS["explicit"]).otherwise(REASONS["bare"]), F.when(likely, "").otherwise(REASONS["implausible"]))
    zero = (r["a"] <= 0) | (r["b"] <= 0)
    told = F.element_at(mapped(REASONS), fmt)
    reason = (
        F.when(r["raw"] == "", why("empty")).when(kind == "area", area_reason)
        .when(fmt == "label_area", F.format_string(REASONS["unknown_label"], r["named"]))
        .when((fmt == "imperial_pair") & zero, why("imperial_zero")).when((fmt == "pair") & zero, why("pair_zero"))
        .when(fmt == "pair", F.format_string(REASONS["pair"], significant(r["a"]), significant(r["b"])))
        .when(fmt == "bare_integer", F.when(t.rlike(YEAR), why("year")).otherwise(F.format_string(REASONS["bare_integer"], significant(number(r["digits"])))))
        .when(fmt == "", why("nothing")).otherwise(told)
    )
    beyond = F.format_string(AREA_RANGE, significant(size), F.when(size < LEAST_AREA, "below").otherwise("above"))
    warnings = F.array_compact(
        F.array(
            F.when(~likely & (kind == "area"), beyond), F.when(~likely & (kind == "dimension_pair"), F.format_string(IMPLIED, significant(size, 3))),
            F.when(r["fixed"] != r["raw"], F.format_string(REPAIRED, quoted(r["raw"]), quoted(r["fixed"]))),
        )
    )
    return {
        "reason": reason,
        "warnings": warnings,
        "area_m2": F.round(size, 3),
        "width_m": F.when(sides, F.round(r["a"] / r["scale"], 3)),
        "length_m": F.when(sides, F.round(r["b"] / r["scale"], 3)),
        "label": F.when(labelled, r["name"]).when(fmt == "label_only", r["t"]),
        "room_type": F.when(labelled, primary_type(r["named"], r["resolved"])).when(fmt == "label_only", primary_type(r["norm"], r["own"])),
        "plausible": likely,
        "repaired": r["t"] != r["raw"],
    }


def reading(text: Column) -> Column:
    """A struct of FIELDS for one token.

    The rules apply in order, to the repaired text; ``raw`` is the cleaned original, ``reason`` tells the rule and
    ``warnings`` what to doubt. A null or blank token is unknown.
    """
    return staged(
        {"raw": F.coalesce(clean(text), F.lit(""))},
        lambda r: {"fixed": repair_unit(r["raw"])},
        _text,
        _own_label,
        lambda r: {"own": resolve(r["norm"])},
        _rule,
        _values,
        lambda r: {"named": normalise_label(r["name"])},
        lambda r: {"resolved": resolve(r["named"])},
        _format,
        _kind,
        _result,
    )


@functools.lru_cache(maxsize=1)
def _reading_in(gateway) -> Column:
    """The reading of a column ``_text``: a large expression, built once for each JVM."""
    return reading(F.col("_text"))


def parsed(df: DataFrame, text: str = "text", more=None) -> DataFrame:
    """``df`` with the fields of ``reading``, and those that ``more(text)`` gives by name; nothing if it has them already.

    Everything is decided by the text alone and drawings repeat their texts, so each distinct text is read once and the
    readings are joined back. Adaptive execution chooses the join by the size of the vocabulary and splits frequent texts.
    """
    if set(FIELDS) <= set(df.columns):
        return df
    extra = more(F.col("_text")) if more else {}
    once = df.select(F.col(text).alias("_text")).distinct().withColumn("_reading", _reading_in(SparkContext._gateway))
    once = once.select("_text", *[F.col(f"_reading.{c}").alias(c) for c in FIELDS], *[c.alias(n) for n, c in extra.items()])
    return df.join(once, F.col(text).eqNullSafe(F.col("_text")), "left").select(*df.columns, *FIELDS, *extra)


def pattern_score(kind: Column, fmt: Column, ok: Column) -> Column:
    """How much a parsed token looks like drawing text, in tenths."""
    return (
        F.when(kind == "door_window_code", 9).when(kind.isin("area", "dimension_pair"), F.when(ok, 9).otherwise(4))
        .when(fmt.isin("elevation", "scale", "apartment_summary"), 8).when(fmt == "bare_integer", 6).otherwise(0)
    )


def beside(label: DataFrame, area: DataFrame) -> DataFrame:
    """A label's reading combined with that of an area found beside it, on their common columns.

    ``label`` has label_raw and room_type, ``area`` has the fields of ``reading``; what is not an area stays as it is.
    """
    keys = [c for c in label.columns if c in area.columns and c not in ("room_type", "label")]
    own = label.select(*keys, "label_raw", F.nullif(F.col("room_type"), F.lit("unknown")).alias("_type"))
    both = area.join(own, keys)
    is_area = F.col("kind") == "area"
    return both.withColumns(
        {
            "fmt": F.when(is_area, F.concat("fmt", F.lit("+assoc"))).otherwise(F.col("fmt")), "label": F.when(is_area, F.col("label_raw")).otherwise(F.col("label")),
            "room_type": F.when(is_area, F.col("_type")).otherwise(F.col("room_type")),
        }
    ).drop("_type", "label_raw")


def label_key(label: Column, text: Column, normal=normalise_label) -> Column:
    """What a label is known by: the lexicon label it stands for, else its normal form."""
    norm = normal(F.coalesce(label, text))
    return F.coalesce(resolve(norm), norm)
