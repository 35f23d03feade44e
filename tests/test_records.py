"""Stored plans, batches, annotations, settings and storage on small cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import lexicon as lx
from tessella.functions import parse
from tessella.operators import annotations, costs, extraction, records, reports
from tessella.settings import Settings, file_value
from tessella.sinks import storage, tables
from tessella.sources import files, images


def test_labels_are_normalised_in_full(spark):
    import html
    import unicodedata

    from pyspark.sql import functions as F

    texts = ["keitti&ouml;", "Keittiö", "ﬁn ½ m²", "&#214;H &#xD6;h", "&amp;ouml; x", "straße", "ＫＨ １", "a&b;", "①②", "KHH+&Auml;", "&nosuch;", "ªº", "𝐊𝐇", "&#55296;", "K&NewLine;H", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lx.normalise_label(F.col("t")).alias("n")).collect()
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", html.unescape(t).upper()) if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+")
    assert [x["n"] for x in got] == [plain(t) for t in texts]


@pytest.mark.parametrize("name", ["q_label_normalise", "q_label_resolve"])
def test_label_queries_equal_their_sql_on_odd_words(spark, tmp_path, name):
    import duckdb

    from tessella.plans import catalogue

    words = "0,4 m²\x0bkeitti&ouml; KEITTIÖ ＫＨ ﬁn ǰ ŉ straße STRASSE &amp;ouml; ①② ½ Ø ł ı ſauna K&amp;H ªº K Å e\u0301t\u00a0wc İ "
    every = " ".join(f"x{chr(k)}" for k in [*range(0xA1, 0xD800), *range(0xE000, 0x20000)])
    spark.createDataFrame([(1, words), (2, ""), (3, None), (4, every)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lineitem = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double"
    spark.createDataFrame([(k, k % 7, k, k * 3, 1.0, 2.0, 0.1) for k in range(80)], lineitem).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for table in ("documents", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalogue.SQL[name]).fetchall()) and got


def test_label_keys_take_the_stored_form(spark):
    rows = spark.createDataFrame([("0,4 m²", None), ("MH1 11.7", "MH1"), ("x", "Keittiö")], "text string, label string")
    key = parse.label_key(F.col("label"), F.col("text"), lx.stored_label)
    assert [x[0] for x in rows.select(key).collect()] == ["04M", "MH", "KEITTIO"]


def test_batches(spark):
    asked = spark.createDataFrame([("a", "{1}"), ("b", "{2}")], "custom_id string, request string")
    waits, answers = [], [None, None, [("b", "two")]]
    got = costs.submit_and_wait(asked, lambda r: sorted(r), lambda batch: answers.pop(0), sleep=waits.append)
    assert {x["custom_id"]: (x["body"], x["ok"]) for x in got.collect()} == {"a": (None, False), "b": ("two", True)} and waits == [15.0, 15.0]
    assert costs.submit_and_wait(asked.limit(0), None, None).count() == 0
    for bad in (asked.union(asked.limit(1)), spark.createDataFrame([("a b", "")], asked.schema)):
        with pytest.raises(ValueError, match="identifiers"):
            costs.submit_and_wait(bad, None, None)
    with pytest.raises(TimeoutError):
        costs.submit_and_wait(asked, lambda r: 1, lambda b: None, every=10, most=20, sleep=lambda s: None)


def test_calls_remember_rejections_and_count_failed_attempts(spark):
    memory, sent = set(), []

    def client(prompt, image, temperature):
        sent.append(temperature)
        if temperature is not None:
            raise ValueError("temperature is not supported")
        return {"text": "x"}

    call = extraction.without_temperature(client, "m", 0.2, lambda e: "not supported" in e, memory)
    assert call("p", False) == call("p", False) == {"text": "x"} and sent == [0.2, None, None] and memory == {"m"}

    def failing(prompt, image):
        raise extraction.CallError("bad answer", 7, 2)

    asked = spark.createDataFrame([(1, "vlm", "p", True)], "page_id long, approach string, prompt string, with_image boolean")
    got = extraction.called(asked, failing).first()
    assert (got["ok"], got["attempts"], got["input_tokens"], got["output_tokens"]) == (False, 2, 14, 4)
    got = extraction.called(asked, lambda p, i: {"text": "no", "stop_reason": "refusal", "input_tokens": 3}).first()
    assert (got["ok"], got["error"], got["attempts"], got["input_tokens"]) == (False, "refusal", 1, 3)


def test_listed_approaches(spark):
    texts = [" rules,, nation ,vlm,hybrid ", "\u00a0vlm\u3000,r u", ",", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", records.approaches(F.col("t")).alias("a"))
    got = rows.select("a", records.runnable(F.col("a"), ["rules", "vlm", "hybrid"], F.col("k") % 2 == 1).alias("run")).orderBy("k").collect()
    assert [x["a"] for x in got] == [["rules", "nation", "vlm", "hybrid"], ["vlm", "r u"], [], [], None]
    assert [x["run"] for x in got] == [["rules"], ["vlm"], [], [], None]


def test_approaches_and_rescoring(spark):
    rows = spark.createDataFrame([("a", "vlm", 1, "k"), ("b", "vlm", 2, "k")], "plan string, approach string, labels int, note string")
    bodies = spark.createDataFrame([("a", "vlm", "xyz")], "plan string, approach string, body string")
    got = extraction.rescored(rows, bodies, lambda b: b.selectExpr("plan", "approach", "length(body) AS labels", "1 AS spurious"))
    assert {x["plan"]: (x["labels"], x["spurious"], x["note"]) for x in got.collect()} == {"a": (3, 1, "k"), "b": (2, None, "k")}
    both = extraction.run_approaches(["rules", "nosuch", "vlm"], {"rules": lambda: rows, "vlm": lambda: bodies})
    assert sorted(x["source"] for x in both.collect()) == ["rules", "rules", "vlm"] and extraction.run_approaches(["x"], {}) is None


def test_ink_and_coverage(spark):
    page = np.full((60, 80), 255, np.uint8)
    page[10:50, 10:16] = page[10:50, 54:60] = page[10:16, 10:60] = page[44:50, 10:60] = 0
    assert annotations.ink_fraction(page, 10, 10, 6, 40) == 1.0 and annotations.ink_fraction(page, 200, 0, 5, 5) is None
    assert annotations.edge_and_inside(page, 10, 10, 50, 40) == (1.0, 0.0) and annotations.edge_and_inside(page, 10, 10, 20, 40) == (None, None)
    assert annotations.coverage(10, 10, [(0, 0, 4, 4), (2, 2, 4, 4), (-5, 0, 2, 1)]) == pytest.approx((25 + 25 - 9) / 100)
    pages = spark.createDataFrame([(1, 80, 60, bytearray(page.tobytes())), (2, 80, 60, bytearray(b"x"))], "image_id long, width int, height int, image binary")
    boxes = spark.createDataFrame([(1, "wall", 10.0, 10.0, 6.0, 40.0), (1, "room", 10.0, 10.0, 50.0, 40.0), (2, "wall", 0.0, 0.0, 5.0, 5.0)], "image_id long, category string, x double, y double, w double, h double")
    decode = lambda b: np.frombuffer(b, np.uint8).reshape(60, 80)
    got = annotations.measured(pages, boxes, decode)
    assert {(x["category"], x["real"], x["edge"], x["inside"]) for x in got.collect()} == {("wall", 1.0, None, None), ("room", None, 1.0, 0.0)}
    match = spark.createDataFrame([("original", 2)], "match string, n long")
    assert annotations.verdict(got, match, spark.createDataFrame([(3, 3)], "inside long, n long")).first()["aligned"]
    assert not annotations.verdict(got.limit(0), match, spark.createDataFrame([(0, 0)], "inside long, n long")).first()["aligned"]


def test_images_are_prepared_in_order(spark):
    assert images.skew([1.0, 91.0, -88.0, 40.0]) == 1.0 and images.skew([30.0]) == 0.0
    pages = spark.createDataFrame([(1, bytearray(b"p")), (2, bytearray(b"bad"))], "page_id long, image binary")

    def denoise(b):
        if bytes(b).startswith(b"bad"):
            raise ValueError("unreadable")
        return bytes(b) + b"n"

    got = images.prepared(pages, {"upscale": lambda b: bytes(b) + b"u", "denoise": denoise, "deskew": lambda b, t: bytes(b) + b"d"}, lambda b: [2.0])
    assert {x["page_id"]: (bytes(x["image"]), x["turn"], x["error"]) for x in got.collect()} == {1: (b"pdnu", 2.0, None), 2: (b"bad", 0.0, "ValueError: unreadable")}
    with pytest.raises(ValueError, match="unknown steps"):
        images.prepared(pages, {"nosuch": denoise})


def test_settings_and_storage(spark, tmp_path):
    env = tmp_path / "env"
    env.write_text("# X=1\n\nKEY = 'a b'\nBAD\nX=2\n")
    assert (file_value(str(env), "KEY"), file_value(str(env), "X"), file_value(str(env), "Y"), file_value("/nosuch", "X")) == ("a b", "2", "", "")
    s = Settings.parsed("rules, vlm,", key_file=str(env), key_name="KEY")
    assert s.runnable() == ["rules", "vlm"] and s.max_upload_bytes == 20 << 20 and "a b" not in s.key_state
    assert Settings.parsed("rules,vlm", key_file="/nosuch").runnable() == ["rules"] and Settings(key_file="/nosuch").key_state == "absent"
    box = storage.Storage(spark, str(tmp_path / "root"))
    assert not box.exists("a/b.txt") and box.put("a/b.txt", b"hello") and box.exists("a/b.txt") and box.get("a/b.txt") == b"hello"
    box.put_file("c", str(env))
    assert box.get("c").startswith(b"# X")
    for key in ("../x", "/x", "a/../../x", ""):
        with pytest.raises(ValueError, match="key"):
            box.path(key)
    with pytest.raises(FileNotFoundError):
        box.get("nosuch")
    assert storage.health(spark, {"root": str(tmp_path), "none": "/nosuch"}) == {"session": True, "root": True, "none": False}


def test_prices_and_reports(spark):
    p = files.price_table(spark, "checked: 2026-01-02\nmodels:\n  m: {input: 1, output: 2}\n").first()
    assert (p["mode"], p["batch_multiplier"], p["checked"], p["cache_read"]) == ("standard", 0.5, "2026-01-02", None)
    with pytest.raises(ValueError, match="at most 2 rows"):
        tables.markdown(spark.range(3), most=2)
    flags = spark.createDataFrame([("a", True, False), ("a", True, True), ("a", False, True)], "k string, flagged boolean, real boolean")
    assert tuple(reports.removed(flags, "k").first()) == ("a", 2, 1, 1)
    seeds = [records.sampled(spark.createDataFrame([(i,) for i in x], "plan int"), 5, 3).collect() for x in (range(50), range(49, -1, -1))]
    assert seeds[0] == seeds[1] and len(seeds[0]) == 5
