"""Room labels and their areas: corroboration, suppression, nearest area, contention and rule-based rooms.

All joins carry the page as an equality key and pages are bounded, so they shuffle once by page and keep the spatial
test as a residual condition. Ranking uses exact integers; floating distances are only shown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.functions.binding import kept
from tessella.functions.lexicon import normalise_label, primary_type, resolve, storable_type
from tessella.functions.parse import WEAK, apartment_code, parsed


def _labels(text):
    """What pairing needs of a text beside its reading."""
    norm = normalise_label(text)
    return {"norm": norm, "resolved": resolve(norm), "is_code": apartment_code(text)}


def read_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens with their parse, ``resolved`` label, ``is_code``, ``weak`` and the page-wide ``corroborated`` flag.

    Several branches read the tokens of a page, so they are computed once; tokens that are read already come back as they
    are.
    """
    if {"resolved", "corroborated"} <= set(tokens.columns):
        return tokens
    t = parsed(tokens, more=_labels).withColumn("weak", F.col("fmt").isin(*WEAK))
    strong = (F.col("kind") == "area") & F.col("plausible") & ~F.col("weak")
    return kept(t.withColumn("corroborated", F.max(strong).over(Window.partitionBy("page_id"))))


def suppressed(read: DataFrame) -> DataFrame:
    """(page_id, token_index) of tokens whose box meets that of an apartment code on the page."""
    codes = read.filter("is_code").select("page_id", g.box().alias("code"))
    return read.select("page_id", "token_index", g.box().alias("b")).join(codes, "page_id").filter(g.overlaps(F.col("b"), F.col("code"))).select("page_id", "token_index").distinct()


def trusted_areas(read: DataFrame) -> DataFrame:
    """Tokens read as plausible areas that the page corroborates, outside apartment summaries."""
    codes = read.filter("is_code").select(F.col("page_id").alias("p"), g.box().alias("code"))
    areas = read.filter((F.col("kind") == "area") & F.col("plausible") & (F.col("corroborated") | ~F.col("weak")))
    return areas.join(codes, (F.col("page_id") == F.col("p")) & g.overlaps(g.box(), F.col("code")), "left_anti")


def nearest_areas(read: DataFrame) -> DataFrame:
    """(page_id, label_id, area_id, key, area_m2, ...): each label's nearest area in reach, the lower id of equals."""
    trusted = trusted_areas(read)
    combined = trusted.filter("label is not null").select("page_id", "token_index")
    labels = read.filter(F.col("resolved").isNotNull() | F.col("label").isNotNull()).join(combined, ["page_id", "token_index"], "left_anti")
    labels = labels.select("page_id", F.col("token_index").alias("label_id"), "text", F.col("confidence").alias("label_confidence"), g.box().alias("lb"))
    areas = trusted.filter("label is null").select("page_id", F.col("token_index").alias("area_id"), "area_m2", "confidence", g.box().alias("ab"))
    key = g.distance_key(F.col("lb"), F.col("ab"))
    near = labels.join(areas, "page_id").filter((F.col("label_id") != F.col("area_id")) & (key <= g.reach_key(F.col("lb"))))
    best = F.min(F.struct(key.alias("key"), "area_id", "area_m2", "confidence")).alias("best")
    near = near.groupBy("page_id", "label_id", "text", "label_confidence").agg(best)
    return near.select("page_id", "label_id", "text", "best.area_id", "best.key", "best.area_m2", F.least("label_confidence", "best.confidence").alias("confidence"))


def contended(near: DataFrame) -> DataFrame:
    """One label per area: the least distance rounded to a tenth, then the earliest label. Losers get no other area."""
    tenths = F.floor(F.sqrt("key") + 0.5)
    order = Window.partitionBy("page_id", "area_id").orderBy(tenths, "label_id")
    return near.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def pairs(read: DataFrame) -> DataFrame:
    """(page_id, label_id, area_id, label_text, area_m2, key, confidence, combined)."""
    own = trusted_areas(read).filter("label is not null")
    own = own.select("page_id", F.col("token_index").alias("label_id"), F.col("token_index").alias("area_id"), F.col("label").alias("label_text"), "area_m2", F.lit(0).cast("long").alias("key"), "confidence", F.lit(True).alias("combined"))
    won = contended(nearest_areas(read)).select("page_id", "label_id", "area_id", F.col("text").alias("label_text"), "area_m2", "key", "confidence", F.lit(False).alias("combined"))
    return own.unionByName(won)


def typed(rooms: DataFrame) -> DataFrame:
    """``rooms`` with the ``room_type`` to store for ``label_raw``; each distinct label is resolved once."""
    once = rooms.select(F.col("label_raw").alias("_raw")).distinct().withColumn("_norm", normalise_label(F.col("_raw")))
    once = once.withColumn("_resolved", resolve(F.col("_norm")))
    once = once.select("_raw", storable_type(primary_type(F.col("_norm"), F.col("_resolved"))).alias("room_type"))
    return rooms.drop("room_type").join(once, F.col("label_raw").eqNullSafe(F.col("_raw")), "left").drop("_raw")


def rules_rooms(tokens: DataFrame) -> DataFrame:
    """Rooms by rule alone: a room per pair, then known labels without an area.

    (page_id, label_id, label_raw, room_type, area_m2, width_m, length_m, source_token_ids, confidence)
    """
    read = read_tokens(tokens)
    found = pairs(read)
    rest = read.filter("resolved is not null").join(found.select("page_id", F.col("label_id").alias("token_index")), ["page_id", "token_index"], "left_anti")
    paired = found.select("page_id", "label_id", F.col("label_text").alias("label_raw"), "area_m2", F.array_sort(F.array_distinct(F.array("label_id", "area_id"))).alias("source_token_ids"), "confidence")
    alone = rest.select("page_id", F.col("token_index").alias("label_id"), F.col("text").alias("label_raw"), F.lit(None).cast("double").alias("area_m2"), F.array("token_index").alias("source_token_ids"), "confidence")
    rooms = typed(paired.unionByName(alone))
    none = F.lit(None).cast("double")
    return rooms.select(
        "page_id", "label_id", "label_raw", "room_type", "area_m2",
        none.alias("width_m"), none.alias("length_m"), "source_token_ids", F.round("confidence", 4).alias("confidence"),
    )


def suggestions(read: DataFrame, limit: int = 3) -> DataFrame:
    """The nearest readable areas of every known label in reach, at most ``limit`` with different values."""
    labels = read.filter("resolved is not null").select("page_id", F.col("token_index").alias("label_id"), g.box().alias("lb"))
    areas = read.filter((F.col("kind") == "area") & F.col("plausible") & ~F.col("weak")).select("page_id", F.col("token_index").alias("area_id"), "area_m2", g.box().alias("ab"))
    key = g.distance_key(F.col("lb"), F.col("ab"))
    near = labels.join(areas, "page_id").filter(key <= g.reach_key(F.col("lb"))).groupBy("page_id", "label_id", "area_m2").agg(F.min(F.struct(key.alias("key"), "area_id")).alias("best"))
    order = Window.partitionBy("page_id", "label_id").orderBy("best.key", "best.area_id")
    return near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("page_id", "label_id", "place", "area_m2", "best.area_id", "best.key")


def prompt_lines(tokens: DataFrame) -> DataFrame:
    """(page_id, token_list): the text rendering of a page's tokens, in order."""
    line = F.format_string('  id=%d "%s" bbox=[%d,%d,%d,%d] conf=%.2f', "token_index", "text", *g.BOX, "confidence")
    return tokens.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("token_index", line.alias("line")))), lambda x: x["line"]), "\n").alias("token_list"))
