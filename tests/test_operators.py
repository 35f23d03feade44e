"""Pairing, merging, grounding, scoring, costs, sources, sinks and streams on small cases."""

from __future__ import annotations

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.operators import costs, dedup, grounding, pairing, reports, scoring
from tessella.sinks import tables
from tessella.sources import files
from tessella.streaming import ingest

TOKEN = "page_id long, token_index int, text string, confidence double, angle int, x1 int, y1 int, x2 int, y2 int"


def tokens(spark, *rows):
    return spark.createDataFrame([(1, k, t, 0.9, 0, *b) for k, (t, b) in enumerate(rows)], TOKEN)


def rooms(spark, *rows):
    return {(r["label_raw"], r["area_m2"]) for r in pairing.rules_rooms(tokens(spark, *rows)).collect()}


def test_pairing_cases(spark):
    assert rooms(spark, ("MH", (100, 100, 130, 130)), ("11.7", (100, 135, 140, 160)), ("9X21", (400, 400, 450, 425))) == {("MH", 11.7)}
    assert rooms(spark, ("khh 6.8", (1710, 430, 1848, 474)), ("mh 11.5", (556, 435, 684, 480))) == {("khh", 6.8), ("mh", 11.5)}
    assert rooms(spark, ("khh 6.8", (100, 100, 200, 140)), ("OH", (210, 100, 240, 140))) == {("khh", 6.8), ("OH", None)}
    assert rooms(spark, ("KH", (100, 100, 130, 130)), ("WC", (100, 180, 130, 210)), ("16.0", (100, 135, 150, 160))) == {("KH", 16.0), ("WC", None)}
    assert rooms(spark, ("WC", (0, 0, 30, 30)), ("016", (0, 35, 30, 60)), ("ET", (200, 0, 230, 30)), ("2", (200, 35, 220, 60))) == {("WC", None), ("ET", None)}
    assert rooms(spark, ("BH+KT+$", (434, 608, 489, 774)), ("61,0m2", (396, 611, 441, 731)), ("OH", (425, 876, 465, 932))) == {("OH", None)}
    assert rooms(spark, ("H7", (0, 0, 10, 10))) == set()


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return w * h / (area(a) + area(b) - w * h)


def test_merging_against_a_loop(spark):
    r = random.Random(4)
    rows = []
    for page in range(4):
        for k in range(30):
            x, y = r.randint(0, 60), r.randint(0, 60)
            rows.append((page, k, r.choice(["MH", "HN", "9X21", "IZX6", "TYOHUONE", "TrOHUONE"]), r.randint(50, 99) / 100, r.choice([0, 90, 180, 270]), x, y, x + r.randint(10, 40), y + r.randint(10, 40)))
    df = spark.createDataFrame(rows, TOKEN)
    scored = {(t["page_id"], t["token_index"]): t for t in dedup.scored(df).collect()}
    want, plain = set(), set()
    for page in range(4):
        own = [t for t in rows if t[0] == page]
        clusters: list[list] = []
        for t in sorted(own, key=lambda t: (-(t[7] - t[5]) * (t[8] - t[6]), t[1])):
            home = next((c for c in clusters if any(iou(t[5:], o[5:]) >= 0.5 for o in c)), None)
            home.append(t) if home else clusters.append([t])
        for c in clusters:
            best = max(c, key=lambda t: (scored[t[:2]]["score"], scored[t[:2]]["upright"], t[3]))
            want.add(best[:2])
        kept: list = []
        for t in sorted(own, key=lambda t: (-t[3], t[1])):
            if not any(iou(t[5:], k[5:]) >= 0.5 for k in kept):
                kept.append(t)
        plain |= {t[:2] for t in kept}
    got = dedup.deduplicated(df)
    assert {(t["page_id"], t["token_index"]) for t in got.collect()} == want
    assert {(t["page_id"], t["token_index"]) for t in dedup.suppressed_by_confidence(df).collect()} == plain


def test_merging_known_groups(spark):
    groups = [[("TYOHUONE", 0.88, 90), ("TrOHUONE", 0.94, 180)], [("9X21", 0.823, 90), ("1ZX6", 0.713, 270)], [("14.1", 0.954, 90), ("L'P!", 0.552, 270)], [("MH", 0.946, 180), ("HN", 0.632, 270)]]
    rows = [(k, i, t, c, a, 100, 100, 130, 190) for k, group in enumerate(groups) for i, (t, c, a) in enumerate(group)]
    got = {t["page_id"]: t["text"] for t in dedup.deduplicated(spark.createDataFrame(rows, TOKEN)).collect()}
    assert got == {k: group[0][0] for k, group in enumerate(groups)}


@pytest.mark.parametrize(
    ("approach", "ids", "area", "kinds", "grounded"),
    [
        ("rules", [0, 1], 11.7, [], True), ("rules", [0, 99], 11.7, ["unknown_token_id"], False), ("rules", [0, 1], 99.9, ["ungrounded_area"], False), ("rules", None, 11.7, ["missing_token_ids"], False),
        ("rules", [0], None, [], True), ("vlm", [0], 42.0, ["ungrounded_area"], True), ("hybrid", None, 11.7, [], False), ("rules", [0, 3], 16.0, ["area_from_unparsed_token"], True),
    ],
)
def test_grounding(spark, approach, ids, area, kinds, grounded):
    t = tokens(spark, ("MH", (0, 0, 9, 9)), ("11.7", (0, 10, 9, 19)), ("9X21", (50, 50, 60, 60)), ("OH. 16.0 n?", (80, 80, 90, 90)))
    room = spark.createDataFrame([(1, 0, "MH", area, ids)], "page_id long, label_id int, label_raw string, area_m2 double, source_token_ids array<int>")
    got = grounding.checked(room, t, approach).first()
    assert ([i["kind"] for i in got["issues"]], got["grounded"]) == (kinds, grounded)


def score_plainly(pred, known, tol):
    close = lambda v, k: abs(v - k) <= tol * max(abs(k), 1e-6)
    rest, left, correct = list(known), [], 0
    for p in pred:
        at = next((i for i, k in enumerate(rest) if k[0] == p[0] and close(p[1], k[1])), None)
        if at is None:
            left.append(p)
        else:
            correct += 1
            rest.pop(at)
    away = [p for p in left if any(k[0] != p[0] and close(p[1], k[1]) for k in known)]
    named = [p for p in left if p not in away and any(k[0] == p[0] for k in known)]
    return correct, len(away), len(named), len(left) - len(away) - len(named), len(rest)


def test_scoring(spark):
    r = random.Random(7)
    make = lambda n: [(r.choice(["MH", "OH", "KH"]), r.choice([11.5, 11.7, 12.6, 22.6, 99.9])) for _ in range(n)]
    cases = [([("MH", 11.7)] * 5, [("MH", 11.7)]), ([("OH", 11.7), ("MH", 11.7)], [("MH", 11.7)]), *[(make(r.randint(1, 7)), make(r.randint(1, 5))) for _ in range(40)]]
    rows = lambda side: [(k, "x", i, *room) for k, case in enumerate(cases) for i, room in enumerate(case[side])]
    pred = spark.createDataFrame(rows(0), "plan int, approach string, ord int, label string, area double")
    known = spark.createDataFrame(rows(1), "plan int, approach string, ord int, label string, area double").drop("approach")
    got = scoring.scored(pred, known, [0.05]).collect()
    assert {x["plan"]: tuple(x[c] for c in scoring.MEASURES[:5]) for x in got} == {k: score_plainly(*case, 0.05) for k, case in enumerate(cases)}
    total = scoring.totals(scoring.scored(pred, known, [0.05]), "approach").first()
    assert total["precision"] == pytest.approx(total["correct"] / total["reported"])


def test_costs(spark):
    calls = spark.createDataFrame([(1, k, "small", 1000, 100, 10, 10) for k in range(10)] + [(2, 0, "other", 1, 1, 1, 1)], "run int, seq int, model string, input_tokens int, output_tokens int, cache_read_tokens int, cache_write_tokens int")
    done = costs.costed(calls, costs.prices(spark))
    assert done.filter("run = 1").first()["micro_usd"] == round(1000 + 500 + 1 + 12.5) and done.filter("run = 2").first()["micro_usd"] is None
    assert costs.admitted(done.filter("run = 1"), 15_000, 10_000).count() == 4
    ids = spark.createDataFrame([("p_1",), ("p+1",), ("x" * 70,)], "k string").select(costs.custom_id(F.col("k")).alias("custom_id"))
    assert costs.illegal_ids(ids).count() == 0 and ids.first()[0] == "p_1"


def test_reports(spark):
    notes = spark.range(1).select(reports.printed_areas(F.lit("MH 11.7 x2, none, K 14.5")).alias("v")).first()["v"]
    assert notes == [11.7, 11.7, 14.5]
    cols = "approach string, plan int, ok boolean, error string, ref_labels int, labels int, spurious int, hallucinations int, printed int, areas int, baseline int"
    rows = spark.createDataFrame([("a", 1, False, "late", 1, 1, 0, 0, 0, 0, None), ("a", 2, True, None, 9, 0, 1, 1, 2, 0, 3), ("a", 3, True, None, 9, 9, 0, 0, 0, 0, 9)], cols)
    got = {x["plan"]: (x["score"], x["reason"]) for x in reports.severity(rows).collect()}
    assert got[1] == (100, "call failed: late") and got[3] == (0, "no issue") and got[2][0] == 50 + 20 + 10 + 15 + 15


def test_geometry(spark):
    got = spark.range(1).select(g.shoelace(g.parse_points(F.lit("0,0 100,0 junk 100,200 0,200"))).alias("a"), g.unrotate(F.lit(1), F.lit(2), F.lit(90), F.lit(10), F.lit(20)).alias("p"), g.capped_size(F.lit(3000), F.lit(1000), 1536).alias("s")).first()
    assert got["a"] == 40000.0 and tuple(got["p"]) == (2, 8) and tuple(got["s"]) == (1536, 512)


def test_sources(spark, tmp_path):
    svg = (
        '<svg><g id="1" class="Space Bedroom"><polygon points="0,0 300,0 300,400 0,400"/><g class="TextLabel NameLabel"><text>MH</text></g>'
        '<g class="TextLabel DimensionMeasureLabel"><text>3 m x 4 m</text></g></g><g class="Space Odd"><polygon points="0,0 1,1"/></g></svg>'
    )
    rooms_ = files.svg_rooms(spark.createDataFrame([("p", svg)], "path string, text string"))
    room = rooms_.first()
    assert rooms_.count() == 1 and (room["name"], room["class"], room["area_m2"], room["labelled_w"]) == ("MH", "Bedroom", 12.0, 3.0)
    assert files.svg_scale(rooms_).first()["scale_ok"] and files.known_rooms(rooms_, files.svg_scale(rooms_)).count() == 1
    (tmp_path / "split.txt").write_text("/a/1/\n\n /b/2 \n")
    assert {x["folder"] for x in files.split_list(spark, str(tmp_path / "split.txt"), "/root/").collect()} == {"/root/a/1", "/root/b/2"}
    doc = '{"images":[{"id":1,"file_name":"f","width":10,"height":10}],"categories":[{"id":2,"name":"room"}],"annotations":[{"image_id":1,"category_id":2,"bbox":[1.0,1.0,5.0,5.0]},{"image_id":1,"category_id":2,"bbox":[1.0,1.0,50.0,5.0]}]}'
    (tmp_path / "coco.json").write_text(doc)
    assert tuple(files.boxes_inside(files.coco(spark, str(tmp_path / "coco.json"))).first()) == (1, 2)
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.png").write_bytes(b"png")
    (tmp_path / "up" / "b.txt").write_bytes(b"x")
    assert {x["suffix"]: x["error"] for x in files.page_files(spark, str(tmp_path / "up")).collect()} == {"png": None, "txt": "unsupported type"}
    sizes = spark.createDataFrame([("pdf", 0), ("pdf", 1 << 30), ("jpg", 5)], "suffix string, length long")
    assert [x["error"] for x in files.checked_uploads(sizes).collect()] == ["empty file", "too large", None]
    pages = files.rendered(files.page_files(spark, str(tmp_path / "up")), lambda content, suffix, dpi: [(content, 20, 10)])
    seen = files.recognised(pages.select(F.lit(1).cast("long").alias("page_id"), "image", "width", "height"), lambda image, angle: [("MH", 0.9, [(1.0, 2.0), (3.0, 4.0)]), (" ", 0.9, [])] if angle == 0 else 1 / 0)
    assert [tuple(x) for x in seen.collect()] == [(1, "MH", 0.9, 0, 1, 2, 3, 4)]
    assert files.price_table(spark, "models:\n  a: {input: 1, output: 2}").first()["cache_read"] is None


def test_sinks(spark, tmp_path):
    row = [("1", "f.pdf", 1, "rules", "MH", "bedroom", 11.7, None, None, 0.9, True, 1, 2, 3, 4, "MH", "0,1")]
    kinds = "string string int string string string double double double double boolean int int int int string string".split()
    df = spark.createDataFrame(row, ", ".join(f"{c} {k}" for c, k in zip(tables.EXPORT, kinds, strict=True)))
    tables.write_csv(df.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text.splitlines() == [",".join(tables.EXPORT), '1,f.pdf,1,rules,MH,bedroom,11.7,,,0.9,true,1,2,3,4,MH,"0,1"']
    plans = spark.createDataFrame([("1", "f.pdf", "done")], "plan_id string, filename string, status string")
    assert '"rooms":[{"page_number":1,"name":"MH"' in tables.as_json(plans, df).first()["json"]
    up = tables.upserted(plans, tables.moved(plans, "failed"), "plan_id").collect()
    assert [x["status"] for x in up] == ["failed"] and tables.markdown(plans).startswith("| plan_id |")


def test_streams(spark, tmp_path):
    tokens(spark, ("MH", (100, 100, 130, 130)), ("11.7", (100, 135, 140, 160))).write.parquet(str(tmp_path / "in"))
    ingest.write_rooms(ingest.token_stream(spark, str(tmp_path / "in")), str(tmp_path / "rooms"), str(tmp_path / "ck")).awaitTermination(120)
    assert [(x["label_raw"], x["area_m2"]) for x in spark.read.parquet(str(tmp_path / "rooms")).collect()] == [("MH", 11.7)]
    calls = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'm' as model, 5L as micro_usd union all select timestamp'2024-01-01 00:50:00', 'm', 7L")
    assert [tuple(x)[1:] for x in ingest.cost_windows(calls).collect()] == [("m", 2, 12)]


def test_registry_without_the_corpus_operators():
    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['tessella.llm'] = None\nclass F:\n def find_spec(self, n, p=None, t=None):\n  if n in ('tessella.llm', 'corpus_pipeline'): raise ModuleNotFoundError(n, name=n)\nsys.modules.pop('tessella.llm'); sys.meta_path.insert(0, F())\nimport __spark_entry__ as e; q = e.queries(); assert 'q_rules_rooms' in q and not any(k.startswith('op') for k in q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout) > 40
