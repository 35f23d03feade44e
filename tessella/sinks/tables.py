"""Sinks: the tables of a run, its exports and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "processing", "done", "failed")
#: The columns of the room export, in order.
EXPORT = [
    "plan_id", "filename", "page_number", "source", "name", "room_type", "area_m2", "width_m", "length_m", "confidence", "grounded",
    "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "raw_text", "source_token_ids",
]


def page_key(plan: Column, page: Column) -> Column:
    """Where the image of a page is kept."""
    return F.format_string("plans/%s/page_%03d.png", plan, page)


def safe_key(key: Column) -> Column:
    """A storage key, or null if it leaves its root."""
    return F.when(~key.startswith("/") & ~F.exists(F.split(key, "/"), lambda p: p == ".."), key)


def numbered(tokens: DataFrame) -> DataFrame:
    """Tokens with a dense ``token_index`` per page in reading order."""
    order = Window.partitionBy("page_id").orderBy("y1", "x1", "text", "angle")
    return tokens.withColumn("token_index", (F.row_number().over(order) - 1).cast("int"))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key, and its other rows added."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def moved(plans: DataFrame, status: str, error: Column | None = None) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(status)
    return plans.withColumns({"status": F.lit(status), "error": F.lit(None).cast("string") if error is None else error})


def terminal(status: Column) -> Column:
    return status.isin("done", "failed")


def write_tokens(tokens: DataFrame, path: str) -> None:
    numbered(tokens).write.mode("append").parquet(path)


def write_csv(rooms: DataFrame, path: str) -> None:
    """The room export: header, line feeds, nulls empty."""
    rooms.select(*EXPORT).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("lineSep", "\n").csv(path)


def as_json(plans: DataFrame, rooms: DataFrame) -> DataFrame:
    """(plan_id, json): a plan's header with its rooms by page."""
    inner = rooms.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "name", "room_type", "area_m2", "source", "grounded"))).alias("rooms"))
    both = plans.join(inner, "plan_id", "left")
    return both.select("plan_id", F.to_json(F.struct("plan_id", "filename", "status", F.coalesce("rooms", F.array().cast(inner.schema["rooms"].dataType)).alias("rooms"))).alias("json"))


def confidence_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.7, "middle").otherwise("low")


def markdown(report: DataFrame, most: int = 1000) -> str:
    """A report as a Markdown table; one of more than ``most`` rows is no report and raises."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows; aggregate it or name a higher bound")
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    lines = [report.columns, ["---"] * len(report.columns), *[[show(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
