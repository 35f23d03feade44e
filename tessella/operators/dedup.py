"""Merging the readings of one place on a page: clusters with the best reading, or plain suppression.

Both are order-dependent, so each page is a fold over its sorted tokens, done by higher-order functions in the JVM.
A page's tokens are few; no page is gathered anywhere but in its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.functions.binding import let
from tessella.functions.lexicon import label_score, normalise_label
from tessella.functions.parse import parsed, pattern_score

TOKEN = "array<struct<page_order:bigint,token_index:int,text:string,confidence:double,angle:int,x1:int,y1:int,x2:int,y2:int,score:int,upright:boolean>>"


def scored(tokens: DataFrame, rule: str = "tall_only") -> DataFrame:
    """Tokens with their vocabulary ``score`` in tenths and whether their angle suits their box."""
    t = parsed(tokens, more=lambda text: {"label_score": label_score(normalise_label(text))})
    score = F.greatest(F.col("label_score"), pattern_score(F.col("kind"), F.col("fmt"), F.col("plausible")))
    return t.withColumns({"score": score, "upright": g.plausible_angle(g.box(), F.col("angle"), rule)}).select(*tokens.columns, "score", "upright")


def _pages(tokens: DataFrame, order: Column) -> DataFrame:
    token = F.struct(order.alias("page_order"), "token_index", "text", "confidence", "angle", *g.BOX, "score", "upright")
    return tokens.groupBy("page_id").agg(F.array_sort(F.collect_list(token)).cast(TOKEN).alias("tokens"))


def _winner(cluster: Column) -> Column:
    """Best score, then angle, then confidence; of equals the first in the cluster."""
    key = lambda t: F.struct(t["score"], t["upright"].cast("int"), t["confidence"])
    return F.aggregate(F.slice(cluster, F.lit(2), F.size(cluster)), cluster[0], lambda best, t: F.when(key(t) > key(best), t).otherwise(best))


def deduplicated(tokens: DataFrame, iou: float = 0.5, rule: str = "tall_only") -> DataFrame:
    """The best reading of each cluster, with ``position`` in reading order.

    Larger boxes come first; a token joins the first cluster with a member that it overlaps enough, else opens one.
    """
    pages = _pages(scored(tokens, rule), -g.area(g.box()).cast("long"))

    def step(clusters: Column, t: Column) -> Column:
        fits = F.transform(clusters, lambda c: F.exists(c, lambda o: g.iou(t, o) >= iou))
        joined = lambda at: F.when(at == 0, F.array_append(clusters, F.array(t))).otherwise(F.transform(clusters, lambda c, i: F.when(i + 1 == at, F.array_append(c, t)).otherwise(c)))
        return let(F.array_position(fits, True), joined)

    clusters = F.aggregate("tokens", F.array().cast(f"array<{TOKEN}>"), step)
    kept = pages.select("page_id", F.explode(F.transform(clusters, _winner)).alias("t"))
    return positioned(kept.select("page_id", "t.*").drop("page_order"))


def suppressed_by_confidence(tokens: DataFrame, iou: float = 0.5) -> DataFrame:
    """Greedy suppression: by falling confidence, a token stays if no kept one overlaps it enough."""
    t = tokens.withColumns({"score": F.lit(0), "upright": F.lit(True)})
    pages = _pages(t, F.round(-F.col("confidence") * 1e9).cast("long"))
    step = lambda kept, x: F.when(F.exists(kept, lambda o: g.iou(x, o) >= iou), kept).otherwise(F.array_append(kept, x))
    kept = pages.select("page_id", F.explode(F.aggregate("tokens", F.array().cast(TOKEN), step)).alias("t"))
    return kept.select("page_id", "t.*").select(*tokens.columns)


def positioned(tokens: DataFrame) -> DataFrame:
    """Dense positions in reading order: top, left, then the order before."""
    return tokens.withColumn("position", F.row_number().over(Window.partitionBy("page_id").orderBy("y1", "x1", "token_index")) - 1)
