"""Sources: page files, text lists, markup, annotations and cached results, as DataFrames.

Image decoding, page rendering and text recognition need libraries that are not part of this package; they are
table functions with an injected engine, so that any can be plugged in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import geometry as g

SUFFIXES = ("pdf", "png", "jpg", "jpeg")
MAX_UPLOAD = 20 << 20
TOKEN_FILE = "plan_id string, tokens array<struct<text:string,confidence:double,bbox:array<int>,angle:int>>"
PAGE = "path string, page_number int, width int, height int, image binary, error string"
READING = "page_id long, text string, confidence double, polygon array<struct<x:double,y:double>>, angle int"


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder with ``suffix`` and, where a file cannot be taken, the reason as ``error``.

    Spark's file source passes over files without any bytes; ``checked_uploads`` tells them where sizes come otherwise.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return checked_uploads(files.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))))


def checked_uploads(files: DataFrame, most: int = MAX_UPLOAD) -> DataFrame:
    """``files`` (suffix, length) with ``error``: a type that is not taken, an empty file, one beyond the size."""
    error = F.when(~F.col("suffix").isin(*SUFFIXES), "unsupported type").when(F.col("length") == 0, "empty file").when(F.col("length") > most, "too large")
    return files.withColumn("error", error)


def rendered(files: DataFrame, render: Callable[[bytes, str, int], list[tuple[bytes, int, int]]], dpi: int = 300) -> DataFrame:
    """A row per page of each file, by the injected ``render(content, suffix, dpi) -> [(image, width, height)]``.

    A file that fails, or has no pages, is one row with its error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, suffix, content in zip(batch["path"], batch["suffix"], batch["content"], strict=True):
                try:
                    pages = render(content, suffix, dpi)
                    out += [(path, k, w, h, image, None) for k, (image, w, h) in enumerate(pages, 1)] or [(path, None, None, None, None, "no pages")]
                except Exception as failed:  # one bad file must not stop the others
                    out.append((path, None, None, None, None, f"{type(failed).__name__}: {failed}"))
            yield pd.DataFrame(out, columns=["path", "page_number", "width", "height", "image", "error"])

    return files.filter("error is null").select("path", "suffix", "content").mapInPandas(run, PAGE)


def recognised(pages: DataFrame, engine: Callable[[bytes, int], list[tuple[str, float, list[tuple[float, float]]]]], angles=(0, 90, 180, 270), least: float = 0.5) -> DataFrame:
    """Token readings of every page at every angle, in page coordinates, with text and enough confidence.

    ``engine(image, angle) -> [(text, confidence, polygon)]``; an angle that fails is passed over. ``pages`` has page_id,
    image, width and height.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, image in zip(batch["page_id"], batch["image"], strict=True):
                for angle in angles:
                    try:
                        out += [(page, t, c, [{"x": x, "y": y} for x, y in p], angle) for t, c, p in engine(image, angle)]
                    except Exception:  # noqa: S112  the other angles still count
                        continue
            yield pd.DataFrame(out, columns=["page_id", "text", "confidence", "polygon", "angle"])

    found = pages.select("page_id", "image").mapInPandas(run, READING).filter((F.trim("text") != "") & (F.col("confidence") >= least))
    w, h = F.col("width"), F.col("height")
    points = F.transform("polygon", lambda p: g.unrotate(p["x"], p["y"], F.col("angle"), h, w))
    axis = lambda f, c: f(F.transform("points", lambda p: p[c]))
    boxes = found.join(pages.select("page_id", "width", "height"), "page_id").withColumn("points", points)
    low = lambda c: F.greatest(F.bround(axis(F.array_min, c)).cast("int"), F.lit(0))
    high = lambda c, most: F.least(F.bround(axis(F.array_max, c)).cast("int"), most)
    return boxes.select("page_id", "text", "confidence", "angle", low("x").alias("x1"), low("y").alias("y1"), high("x", w).alias("x2"), high("y", h).alias("y2"))


def split_list(spark: SparkSession, path: str, root: str) -> DataFrame:
    """(entry, folder) of the lines of a split file that are not blank."""
    lines = spark.read.text(path).select(F.trim("value").alias("entry")).filter("entry <> ''")
    return lines.withColumn("folder", F.concat_ws("/", F.lit(root.rstrip("/")), F.regexp_replace("entry", "^/+|/+$", "")))


def rerooted(path: Column, root: str, folders: list[str]) -> Column:
    """A foreign path from its first known folder on, below ``root``; null without one."""
    part = F.regexp_extract(path, "(?:^|[/\\\\])((?:" + "|".join(folders) + ")[/\\\\].*)$", 1)
    return F.when(part != "", F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(part, r"\\", "/")))


def cached_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(plan_id, tokens) of cached token files; a missing angle is 0 and files without tokens are left out."""
    raw = spark.read.schema(TOKEN_FILE).option("multiLine", "true").json(path).filter("tokens is not null")
    return raw.withColumn("tokens", F.transform("tokens", lambda t: t.withField("angle", F.coalesce(t["angle"], F.lit(0)))))


def coco(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, file_name, width, height, category, x1, y1, x2, y2) of an annotation document."""
    doc = spark.read.option("multiLine", "true").json(path)
    images = doc.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    kinds = doc.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    notes = doc.select(F.explode("annotations").alias("a")).select("a.image_id", "a.category_id", F.col("a.bbox").alias("b"))
    x, y, w, h = (F.col("b")[k] for k in range(4))
    return notes.join(images, "image_id").join(kinds, "category_id").select("image_id", "file_name", "width", "height", "category", x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def boxes_inside(notes: DataFrame, slack: float = 1.0) -> DataFrame:
    """(inside, n): annotation boxes within their image, a pixel of slack allowed."""
    inside = (F.col("x1") >= -slack) & (F.col("y1") >= -slack) & (F.col("x2") <= F.col("width") + slack) & (F.col("y2") <= F.col("height") + slack)
    return notes.agg(F.count_if(inside).alias("inside"), F.count("*").alias("n"))


#: The marks of a room, its outline, its name and its hidden measures in an SVG text.
ROOM_START, ROOM_CLASS, OUTLINE = r'(?=<g[^>]*class="Space )', r'^<g[^>]*class="Space ([^"]+)"', r'<polygon points="([^"]+)"'
NAME = r'class="TextLabel NameLabel"[^>]*>\s*<text[^>]*>([^<]*)</text>'
MEASURES = r'(?s)class="TextLabel DimensionMeasureLabel"[^>]*>(?:(?!</g>).)*?>\s*([\d.]+)\s*m\s*x\s*([\d.]+)\s*m[^<]*</text>'


def svg_rooms(files: DataFrame, units_per_metre: float = 100.0) -> DataFrame:
    """(path, ord, class, name, points, area_m2, x1, y1, x2, y2, labelled_w, labelled_h) of every room of SVG texts (path, text).

    A room without an outline of three points is left out; missing names are empty and missing measures null.
    """
    room = files.select("path", F.posexplode(F.split("text", ROOM_START)).alias("ord", "g")).filter(F.col("g").rlike(ROOM_CLASS))
    measure = lambda k: F.nullif(F.regexp_extract("g", MEASURES, k), F.lit("")).try_cast("double")
    room = room.withColumns(
        {
            "class": F.trim(F.regexp_extract("g", ROOM_CLASS, 1)), "name": F.trim(F.regexp_extract("g", NAME, 1)), "points": g.parse_points(F.regexp_extract("g", OUTLINE, 1)),
            "labelled_w": measure(1), "labelled_h": measure(2),
        }
    ).filter(F.size("points") >= 3)
    axis = lambda f, c: f(F.transform("points", lambda p: p[c]))
    return room.select(
        "path", "ord", "class", "name", "points", F.round(g.shoelace(F.col("points")) / 2 / units_per_metre**2, 3).alias("area_m2"), axis(F.array_min, "x").alias("x1"), axis(F.array_min, "y").alias("y1"),
        axis(F.array_max, "x").alias("x2"), axis(F.array_max, "y").alias("y2"), "labelled_w", "labelled_h",
    )


def svg_scale(rooms: DataFrame, expected: float = 100.0, within: float = 1.0) -> DataFrame:
    """(path, scale, scale_ok): the median of drawn extent over labelled metres, labels of 0.2 m or less left out."""
    sides = F.array(F.struct((F.col("x2") - F.col("x1")).alias("drawn"), F.col("labelled_w").alias("m")), F.struct((F.col("y2") - F.col("y1")).alias("drawn"), F.col("labelled_h").alias("m")))
    edge = rooms.select("path", F.explode(sides).alias("s")).filter("s.m > 0.2")
    scale = edge.groupBy("path").agg(F.median(F.col("s.drawn") / F.col("s.m")).alias("scale"))
    return scale.withColumn("scale_ok", F.abs(F.col("scale") - expected) <= within)


def known_rooms(rooms: DataFrame, scale: DataFrame, least: float = 1.0) -> DataFrame:
    """Rooms that count as known: of a plan to scale, named, of a square metre at least."""
    return rooms.join(scale.filter("scale_ok"), "path", "left_semi").filter((F.col("area_m2") >= least) & (F.trim("name") != ""))


def price_table(spark: SparkSession, text: str) -> DataFrame:
    """Prices from YAML text with ``models: {name: {input, output, cache_read, cache_write}}``.

    Each row carries the ``mode`` (standard by default), the ``batch_multiplier`` (0.5) and the date of the table.
    """
    import yaml

    table = yaml.safe_load(text) or {}
    models = table.get("models", {})
    common = (str(table.get("mode", "standard")), float(table.get("batch_multiplier", 0.5)), None if table.get("checked") is None else str(table["checked"]))
    number = lambda v: None if v is None else float(v)
    rows = [(name, *(number(m.get(k)) for k in ("input", "output", "cache_read", "cache_write")), *common) for name, m in models.items()]
    schema = "model string, input double, output double, cache_read double, cache_write double, mode string, batch_multiplier double, checked string"
    return spark.createDataFrame(rows, schema)


def batch_results(spark: SparkSession, path: str) -> DataFrame:
    """(custom_id, status, stop_reason, text, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens) of a file of batch results, a JSON object a line."""
    schema = (
        "custom_id string, result struct<type:string, message:struct<stop_reason:string, content:array<struct<type:string,text:string>>, "
        "usage:struct<input_tokens:bigint,output_tokens:bigint,cache_read_input_tokens:bigint,cache_creation_input_tokens:bigint>>>"
    )
    raw, m = spark.read.schema(schema).json(path), "result.message"
    text = F.get(F.filter(F.col(f"{m}.content"), lambda b: b["type"] == "text"), F.lit(0))["text"]
    counter = lambda c, name=None: F.coalesce(F.col(f"{m}.usage.{c}"), F.lit(0)).alias(name or c)
    return raw.select("custom_id", F.col("result.type").alias("status"), F.col(f"{m}.stop_reason").alias("stop_reason"), text.alias("text"), counter("input_tokens"), counter("output_tokens"), counter("cache_read_input_tokens", "cache_read_tokens"), counter("cache_creation_input_tokens", "cache_write_tokens"))
