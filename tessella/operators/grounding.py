"""Checking extracted rooms against the tokens of their page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.functions.parse import parsed

TOLERANCE = 0.02
#: Numbers that can be read as areas in any token text.
DECIMAL, WITH_UNIT = r"\d+[.,]\d+", r"(\d+)\s*[mM]\s*[\^{\s]{0,3}[2²]"
#: How each approach is checked: whether issues are hard, and kinds of issues that are left out of the report.
POLICY = {"rules": (True, ()), "ocr+llm": (True, ()), "vlm": (False, ()), "hybrid": (True, ("missing_token_ids",))}


def transcribed(text: Column) -> Column:
    """Numbers that a reader could take for areas: decimals, and integers with a (possibly damaged) area unit."""
    decimals = F.transform(F.regexp_extract_all(text, F.lit(DECIMAL), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))
    return F.concat(decimals, F.transform(F.regexp_extract_all(text, F.lit(WITH_UNIT), F.lit(1)), lambda x: x.cast("double")))


def evidence(tokens: DataFrame) -> DataFrame:
    """(page_id, ids, parsed_areas, numbers): what the tokens of a page can vouch for."""
    t = parsed(tokens)
    area = F.when(F.col("kind").isin("area", "dimension_pair"), F.col("area_m2"))
    return t.groupBy("page_id").agg(
        F.collect_set("token_index").alias("ids"), F.collect_set(area).alias("parsed_areas"), F.array_distinct(F.flatten(F.collect_set(transcribed(F.col("text"))))).alias("numbers")
    )


def supported(area: Column, values: Column, tolerance: float = TOLERANCE) -> Column:
    return F.exists(values, lambda v: F.abs(area - v) <= tolerance * F.greatest(F.abs(v), F.lit(1e-6)))


def checked(rooms: DataFrame, tokens: DataFrame, approach: str = "rules", drop: bool = False) -> DataFrame:
    """``rooms`` with ``issues`` (kind, hard, detail) and ``grounded``.

    A room with a hard issue is ungrounded; it stays unless ``drop``. Left-out kinds are not reported, yet still unground
    a room.
    """
    page = rooms.join(evidence(tokens), "page_id", "left")
    page = _judged(page, approach).select(*rooms.columns, "issues", "grounded")
    return page.filter("grounded") if drop else page


def checked_as(rooms: DataFrame, tokens: DataFrame, approaches: list[str]) -> DataFrame:
    """``checked`` under several approaches at once, told apart by ``source``; the evidence is gathered once."""
    page = rooms.join(evidence(tokens), "page_id", "left")
    for a in approaches:
        page = _judged(page, a).withColumn(f"_as_{a}", F.struct(F.lit(a).alias("source"), "issues", "grounded")).drop("issues", "grounded")
    return page.select(*rooms.columns, F.explode(F.array(*[F.col(f"`_as_{a}`") for a in approaches])).alias("_as")).select(*rooms.columns, "_as.*")


def _judged(page: DataFrame, approach: str) -> DataFrame:
    hard, left_out = POLICY[approach]
    ids, area = F.coalesce("source_token_ids", F.array().cast("array<int>")), F.col("area_m2")
    issue = lambda kind, h, detail: F.struct(F.lit(kind).alias("kind"), F.lit(h).alias("hard"), detail.alias("detail"))
    none = F.array().cast("array<int>")
    strange = F.array_except(ids, F.coalesce("ids", none))
    cited = (
        F.when(F.lit(not hard), None).when(F.size(ids) == 0, issue("missing_token_ids", True, F.lit("no source tokens are cited")))
        .when(F.size(strange) > 0, issue("unknown_token_id", True, F.concat(F.lit("no token on the page has the id "), F.array_join(F.array_sort(strange), ", "))))
    )
    claim = F.concat(F.lit("no readable token holds "), area.cast("string"), F.lit(" m2"))
    values = lambda c: F.coalesce(c, F.array().cast("array<double>"))
    valued = F.when(area.isNull() | supported(area, values("parsed_areas")), None).when(supported(area, values("numbers")), issue("area_from_unparsed_token", False, F.lit("the area stands in a token that cannot be parsed"))).otherwise(issue("ungrounded_area", hard, claim))
    found = F.array_compact(F.array(cited, valued))
    kept = lambda i: ~i["kind"].isin(*left_out) if left_out else F.lit(True)
    return page.withColumn("_found", found).withColumns({"issues": F.filter("_found", kept), "grounded": ~F.exists("_found", lambda i: i["hard"])}).drop("_found")


def issue_counts(rooms: DataFrame) -> DataFrame:
    """(source, kind, hard, n) over rooms with ``issues`` and ``source``."""
    return rooms.select("source", F.explode("issues").alias("i")).groupBy("source", "i.kind", "i.hard").agg(F.count("*").alias("n"))


def room_boxes(rooms: DataFrame, tokens: DataFrame) -> DataFrame:
    """(page_id, label_id, x1, y1, x2, y2): the union of the boxes of the tokens that a room cites and that exist."""
    cited = rooms.select("page_id", "label_id", F.explode("source_token_ids").alias("token_index"))
    low, high = [F.min(c).alias(c) for c in g.BOX[:2]], [F.max(c).alias(c) for c in g.BOX[2:]]
    return cited.join(tokens.select("page_id", "token_index", *g.BOX), ["page_id", "token_index"]).groupBy("page_id", "label_id").agg(*low, *high)


def failure_class(area: Column, values: Column, door_codes: Column) -> Column:
    """Why an area was rejected: it stands in a token that cannot be parsed, in a door code, or nowhere."""
    digits = lambda t: F.transform(F.regexp_extract_all(t, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))
    in_code = F.exists(door_codes, lambda t: F.exists(digits(t), lambda v: F.abs(v - area) <= TOLERANCE * F.greatest(F.abs(area), F.lit(1e-6))))
    return F.when(supported(area, values), "scoring_artifact:area_in_garbled_token").when(in_code, "trusted_garbled_ocr:door_code").otherwise("invented:area_not_on_page")
