"""Requests, calls and answers with a stub model."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tessella.operators import extraction, pairing

TOKEN = "page_id long, token_index int, text string, confidence double, angle int, x1 int, y1 int, x2 int, y2 int"


def room(**over):
    return {"label_raw": "MH", "room_type": "bedroom", "area_m2": 11.7, "width_m": None, "length_m": None, "source_token_ids": [0, 1], "confidence": 0.9} | over


def model():
    """A stub, made inside a function so that it travels to workers by value."""
    good = json.dumps({"rooms": [room(), room(label_raw="OH", area_m2=None)], "notes": None})
    odd = json.dumps({"rooms": [room(extra=1)], "notes": None})

    def stub(prompt, image):
        if "page 3" in prompt:
            raise RuntimeError("down")
        return {"text": odd if "page 2" in prompt else good, "stop_reason": "end_turn", "input_tokens": 10, "output_tokens": 2}

    return stub


def test_requests_and_answers(spark):
    rows = [(p, k, t, 0.9, 0, 100, 100 + 35 * k, 130, 130 + 35 * k) for p in (1, 2, 3) for k, t in enumerate(["MH", "11.7", f"page {p}"])]
    tokens = spark.createDataFrame(rows, TOKEN)
    asked = extraction.requests(tokens, pairing.pairs(pairing.read_tokens(tokens)), "ocr+llm")
    text = asked.filter("page_id = 1").first()["prompt"]
    assert '  id=0 "MH" bbox=[100,100,130,130] conf=0.90' in text and '"MH" = 11.7 m2 (tokens 0 and 1)' in text
    calls = extraction.called(asked, model())
    assert {c["page_id"]: (c["ok"], c["attempts"], c["input_tokens"]) for c in calls.collect()} == {1: (True, 1, 10), 2: (True, 1, 10), 3: (False, 2, 0)}
    got = extraction.answered(calls).select("page_id", "room_index", "label_raw", "area_m2").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 0, "MH", 11.7), (1, 1, "OH", None)]


def test_labelling_helpers(spark):
    texts = {"MH 11.7": [11.7], "OH. 16.0 n?": [16.0], "9X21": [], "+46.290": [], "$8,1 m^{2}$": [8.1], "x 65 m^{2": [65.0], "24": [], "85m": []}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r["text"]: r["numbers"] for r in extraction.readable_numbers(df).collect()} == texts
    same = df.select("text", extraction.is_label(F.col("text"), F.lit("mh")).alias("m")).filter("m").collect()
    assert [r["text"] for r in same] == ["MH 11.7"]
