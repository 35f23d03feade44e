"""Token readings and labels against known literals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.functions import lexicon as lx
from tessella.functions.parse import apartment_code, parsed, pattern_score

AREAS = {
    "11.7": 11.7, "11,7": 11.7, "11.7 m²": 11.7, "11,7m2": 11.7, "11,7 M2": 11.7, "37.5": 37.5, "90 M2": 90, "90M²": 90, "22,6 m 2": 22.6, "90": 90, "MH 11.7": 11.7, "KHH 10,8 m²": 10.8, "WC 1.5": 1.5, "PSH 4.0": 4.0,
    "3,3 m^{2}$": 3.3, "15.5 m^2}$": 15.5, "$12,3 m^{}$": 12.3, "11,5m^{2": 11.5, "2,3 m{2": 2.3, "36.0M^{2}$": 36.0, "6.89$": 6.89, "keittlo 15.4": 15.4, "autova ja 19.5": 19.5,
}
PAIRS = {"3.5x4.2": (3.5, 4.2), "3,5 x 4,2": (3.5, 4.2), "3.5m x 4.2m": (3.5, 4.2), "3500 x 4200": (3.5, 4.2), "3500mm x 4200mm": (3.5, 4.2), "3.5 × 4.2": (3.5, 4.2), "12'6\" x 10'": (3.81, 3.048), "12' - 6\" x 10' - 0\"": (3.81, 3.048), "9.0x21.0": (9.0, 21.0)}
DOORS = ["9X21", "9x21", "10x21", "12X12", "14X12", "6X12", "3 x 4"]
UNKNOWN = {
    "1:100": "scale", "1 : 200": "scale", "1/100": "scale", "+46.290": "elevation", "-2,500": "elevation", "1990": "bare_integer", "19940": "bare_integer", "A-101": "sheet_number", "3/5": "sheet_number",
    "4H K KH WC 90 M2": "apartment_summary", "ZZQ 11.7": "label_area", "50 x 60": "pair", "0x21": "pair", "0.0 x 4.2": "pair", "KHH": "label_only", "IZX6": "sheet_number", "": "", "x": "", "¤": "", "?!": "", "m²": "", "17.6m": "",
}


def read(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r["text"]: r for r in parsed(df).collect()}


def test_areas(spark):
    got = read(spark, AREAS)
    assert {t: (got[t]["kind"], got[t]["area_m2"]) for t in AREAS} == {t: ("area", v) for t, v in AREAS.items()}
    assert got["MH 11.7"]["room_type"] == "bedroom" and got["3,3 m^{2}$"]["repaired"] and got["3,3 m^{2}$"]["raw"] == "3,3 m^{2}$"


def test_pairs_and_doors(spark):
    got = read(spark, [*PAIRS, *DOORS])
    assert {t: (got[t]["kind"], got[t]["width_m"], got[t]["length_m"]) for t in PAIRS} == {t: ("dimension_pair", *v) for t, v in PAIRS.items()}
    assert all(got[t]["kind"] == "door_window_code" and got[t]["area_m2"] is None for t in DOORS)
    assert (got["9X21"]["width_m"], got["9X21"]["length_m"]) == (0.9, 2.1)


def test_unknown(spark):
    got = read(spark, [*UNKNOWN, None])
    assert {t: (got[t]["kind"], got[t]["fmt"]) for t in UNKNOWN} == {t: ("unknown", f) for t, f in UNKNOWN.items()}
    assert got[None]["kind"] == "unknown" and got["KHH"]["room_type"] == "utility"


def test_plausible_bounds(spark):
    got = read(spark, ["0,4 m²", "640 m²", "40.0 x 40.0", "1.0", "500.0"])
    assert [got[t]["plausible"] for t in ("0,4 m²", "640 m²", "40.0 x 40.0", "1.0", "500.0")] == [False, False, False, True, True]


@pytest.mark.parametrize(("text", "resolved", "kind"), [("MH1", "MH", "bedroom"), ("H7", None, "unknown"), ("KEITTIÖ", "KEITTIO", "kitchen"), ("keittlo", "KEITTIO", "kitchen"), ("OLESKELU+RUOK", None, "living_room"), ("Ty&ouml;huone", "TYOHUONE", "office"), ("??", None, "unknown")])
def test_labels(spark, text, resolved, kind):
    norm = lx.normalise_label(F.lit(text))
    got = spark.range(1).select(lx.resolve(norm).alias("r"), lx.primary_type(norm, lx.resolve(norm)).alias("t")).first()
    assert (got["r"], got["t"]) == (resolved, kind)


def test_scores(spark):
    texts = ["TYOHUONE", "TrOHUONE", "9X21", "IZX6", "OLESKELU+RUOK", "K+ZZ", "MH", ""]
    norm = lx.normalise_label(F.col("text"))
    df = parsed(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = {r["text"]: (r["a"], r["b"]) for r in df.select("text", lx.label_score(norm).alias("a"), pattern_score(F.col("kind"), F.col("fmt"), F.col("plausible")).alias("b")).collect()}
    assert got["TYOHUONE"][0] == 10 > got["TrOHUONE"][0] and got["9X21"] == (0, 9) and got["IZX6"] == (0, 0) and got["OLESKELU+RUOK"][0] == 9 and got["K+ZZ"][0] == 7 and got[""] == (0, 0)


def test_apartment_codes(spark):
    texts = {"3H+KT+S": True, "2H+KK": True, "BH+KT+$": True, "MH": False, "11.7": False, "OLESKELU+RUOK": False}
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", apartment_code(F.col("text")).alias("c")).collect()
    assert dict(map(tuple, got)) == texts
