"""Stored plans: rooms as they are saved, and the reads of a service over plans, pages, rooms and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.functions.lexicon import UNKNOWN, normalise_label, primary_type, resolve
from tessella.operators.grounding import room_boxes


def stored_rooms(rooms: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rooms as they are saved: the union of the boxes of their tokens, the type of the lexicon, and the grounded flag.

    ``rooms`` has page_id, label_id, label_raw, room_type (of the model), source_token_ids and grounded. The lexicon's
    type stands over the model's unless it is unknown. A room without tokens on the page has no box; an empty label has
    no name.
    """
    once = rooms.select(F.col("label_raw").alias("_raw")).distinct().withColumn("_norm", normalise_label(F.col("_raw"))).withColumn("_label", resolve(F.col("_norm")))
    once = once.select("_raw", F.nullif(primary_type(F.col("_norm"), F.col("_label")), F.lit(UNKNOWN)).alias("_type"))
    typed = rooms.join(once, F.col("label_raw").eqNullSafe(F.col("_raw")), "left").withColumn("room_type", F.coalesce("_type", "room_type"))
    typed = typed.withColumns({"name": F.nullif(F.col("label_raw"), F.lit("")), "raw_text": F.col("label_raw"), "source_token_ids": grounded_ids(F.col("source_token_ids"))})
    return typed.drop("_raw", "_type").join(room_boxes(rooms, tokens), ["page_id", "label_id"], "left")


def grounded_ids(ids: Column) -> Column:
    """The cited token ids, sorted and once each."""
    return F.array_sort(F.array_distinct(F.coalesce(ids, F.array().cast("array<int>"))))


def plan_tokens(tokens: DataFrame, pages: DataFrame, plan: str | None = None) -> DataFrame:
    """(plan_id, page_number, token columns) of one plan, or of all, in order of page and token."""
    of = pages.select("page_id", "plan_id", "page_number")
    of = of if plan is None else of.filter(F.col("plan_id") == plan)
    return tokens.join(of, "page_id").select("plan_id", "page_number", *tokens.columns).orderBy("plan_id", "page_number", "token_index")


def plan_view(wanted: DataFrame, pages: DataFrame, rooms: DataFrame, tokens: DataFrame, include_tokens: bool = False, source: str | None = None) -> DataFrame:
    """(plan_id, found, pages) for each wanted plan_id; a page holds its rooms, of one source if asked for, and its tokens.

    A plan that does not exist has ``found`` false and no pages; a page without rooms has an empty list.
    """
    chosen = rooms if source is None else rooms.filter(F.col("source") == source)
    listed = lambda df, key, cols, name: df.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(key, *cols))).alias(name))
    of = pages.join(wanted.select("plan_id"), "plan_id", "left_semi")
    inner = of.join(listed(chosen, "label_id", ["label_raw", "room_type", "area_m2"], "rooms"), "page_id", "left")
    fields = [F.coalesce("rooms", F.array()).alias("rooms")]
    if include_tokens:
        inner = inner.join(listed(tokens, "token_index", ["text", "confidence", *g.BOX], "tokens"), "page_id", "left")
        fields.append(F.coalesce("tokens", F.array()).alias("tokens"))
    nested = inner.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "page_id", *fields))).alias("pages"))
    found = wanted.select("plan_id").distinct().join(nested, "plan_id", "left")
    return found.select("plan_id", F.col("pages").isNotNull().alias("found"), F.coalesce("pages", F.array()).alias("pages"))


def page_lookup(wanted: DataFrame, pages: DataFrame, stored: DataFrame) -> DataFrame:
    """(plan_id, page_number, image_key, status) of wanted pages: ok, no such page, or no stored image (``stored`` has image_key)."""
    found = wanted.join(pages.select("plan_id", "page_number", "image_key", F.lit(True).alias("_page")), ["plan_id", "page_number"], "left")
    found = found.join(stored.select("image_key", F.lit(True).alias("_image")).distinct(), "image_key", "left")
    status = F.when(F.col("_page").isNull(), "no such page").when(F.col("_image").isNull(), "no stored image").otherwise("ok")
    return found.select("plan_id", "page_number", "image_key", status.alias("status"))


def approaches(text: Column) -> Column:
    """The names of a comma-separated list, without the spaces around them, blank ones left out."""
    # A function of two arguments would be given the position too, so it is not passed by its name.
    return F.filter(F.transform(F.split(text, ","), lambda a: F.regexp_replace(a, r"^\p{Zs}+|\p{Zs}+$", "")), lambda a: a != "")


def runnable(names: Column, known: list[str], with_key: Column) -> Column:
    """The approaches that can run: known ones, and without a credential only the rules."""
    return F.filter(names, lambda a: a.isin(*known) & (with_key | (a == "rules")))


def reference_sets(rooms: DataFrame) -> DataFrame:
    """(plan, labels, areas): the distinct label keys of a plan but blank and undefined ones, and its areas from 1 m2."""
    label = F.when(~F.col("label_key").isin("", "UNDEFINED"), F.col("label_key"))
    return rooms.groupBy("plan").agg(F.array_sort(F.collect_set(label)).alias("labels"), F.array_sort(F.collect_list(F.when(F.col("area") >= 1.0, F.col("area")))).alias("areas"))


def leftover_areas(areas: DataFrame, claimed: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Areas (page_id, token_index, text, area_m2) that no claimed one (page_id, area_m2) of the page is close to."""
    own = claimed.filter("area_m2 is not null").select(F.col("page_id").alias("_page"), F.col("area_m2").alias("_area")).distinct()
    near = F.abs(F.col("area_m2") - F.col("_area")) <= tolerance * F.greatest(F.col("_area"), F.lit(1e-6))
    return areas.join(own, (F.col("page_id") == F.col("_page")) & near, "left_anti")


def progress(rooms: DataFrame) -> DataFrame:
    """(plan, rooms, printed, decided, complete) of labelled rooms (plan, decided, area_m2)."""
    p = rooms.groupBy("plan").agg(
        F.count("*").alias("rooms"), F.count_if(F.col("decided") & F.col("area_m2").isNotNull()).alias("printed"), F.count_if("decided").alias("decided")
    )
    return p.withColumn("complete", F.col("decided") == F.col("rooms"))


def first_bodies(results: DataFrame) -> DataFrame:
    """(plan, approach, body): the first cached answer with text of each plan and approach, by ``seq``."""
    order = Window.partitionBy("plan", "approach").orderBy("seq")
    full = results.filter("body is not null and body <> ''").withColumn("_place", F.row_number().over(order))
    return full.filter("_place = 1").select("plan", "approach", "body")


def plan_ids(results: DataFrame) -> DataFrame:
    """The distinct plans of a result, in numeric order."""
    return results.select("plan").distinct().orderBy(F.col("plan").try_cast("long"), "plan")


def sampled(plans: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` plans without replacement, the same for a seed whatever the order of the rows; sorted."""
    return plans.select("plan").distinct().orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("plan").cast("string")))).limit(n).orderBy("plan")


def backfilled(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` with columns that an older report lacks, and their defaults where they are null."""
    have = set(rows.columns)
    return rows.withColumns({c: F.coalesce(F.col(c), default) if c in have else default for c, default in columns.items()})


def overlay(b: Column, page_width: Column, shown_width: Column) -> Column:
    """A box in the pixels of a page scaled to the width it is shown in."""
    scale = shown_width / page_width
    return F.struct(*[(b[c] * scale).alias(c) for c in g.BOX])


def token_table(tokens: DataFrame, most: int = 32) -> DataFrame:
    """(page_id, token_index, line): a line of the token table; a text of more than ``most`` characters ends in dots."""
    shown = F.when(F.length("text") > most, F.concat(F.left("text", F.lit(most - 3)), F.lit("..."))).otherwise(F.col("text"))
    line = F.format_string(f"  %-{most}s %6.3f  %5d  (%d,%d,%d,%d)", shown, "confidence", "angle", *g.BOX)
    return tokens.select("page_id", "token_index", line.alias("line"))
