"""Scoring predicted rooms against known ones.

Matching is greedy and one to one, in the order of the predictions and then of the known rooms: a fold over the two
short lists of a plan. Everything after it is relational.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.binding import let

ROOM = "array<struct<ord:int,label:string,area:double>>"


def close(value: Column, known: Column, tolerance: Column) -> Column:
    return F.abs(value - known) <= tolerance * F.greatest(F.abs(known), F.lit(1e-6))


def greedy(predicted: Column, known: Column, fits) -> Column:
    """(left, matched): predictions without a partner, and the number with one; a known room serves once."""

    def step(acc: Column, p: Column) -> Column:
        def taken(at: Column) -> Column:
            rest = F.when(at == 0, acc["rest"]).otherwise(F.filter(acc["rest"], lambda k, i: i + 1 != at))
            return F.struct(rest.alias("rest"), F.when(at == 0, F.array_append(acc["left"], p)).otherwise(acc["left"]).alias("left"), (acc["n"] + (at > 0).cast("int")).alias("n"))

        return let(F.array_position(F.transform(acc["rest"], lambda k: fits(p, k)), True), taken)

    start = F.struct(known.cast(ROOM).alias("rest"), F.array().cast(ROOM).alias("left"), F.lit(0).alias("n"))
    return F.aggregate(predicted.cast(ROOM), start, step)


def plans(rooms: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The rooms (ord, label, area) of each plan as one sorted list."""
    return rooms.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "label", "area"))).alias(name))


def scored(predicted: DataFrame, known: DataFrame, tolerances: list[float]) -> DataFrame:
    """A row per plan, approach and tolerance: correct, misattributed, wrong_value, hallucinated, missed, known, reported.

    ``predicted`` has plan, approach, ord, label, area; ``known`` plan, ord, label, area.
    """
    p, k = plans(predicted, ["plan", "approach"], "p"), plans(known, ["plan"], "k")
    both = p.join(k, "plan").withColumn("tolerance", F.explode(F.array(*[F.lit(float(t)) for t in tolerances])))
    fits = lambda a, b: (a["label"] == b["label"]) & close(a["area"], b["area"], F.col("tolerance"))
    both = both.withColumn("m", greedy(F.col("p"), F.col("k"), fits))
    elsewhere = lambda x: F.exists("k", lambda o: (o["label"] != x["label"]) & close(x["area"], o["area"], F.col("tolerance")))
    named = lambda x: F.exists("k", lambda o: o["label"] == x["label"])
    count = lambda test: F.size(F.filter("m.left", test)).cast("long")
    return both.select(
        "plan", "approach", "tolerance", F.col("m.n").cast("long").alias("correct"), count(elsewhere).alias("misattributed"),
        count(lambda x: ~elsewhere(x) & named(x)).alias("wrong_value"), count(lambda x: ~elsewhere(x) & ~named(x)).alias("hallucinated"),
        F.size("m.rest").cast("long").alias("missed"), F.size("k").cast("long").alias("known"), F.size("p").cast("long").alias("reported"),
    )


MEASURES = ["correct", "misattributed", "wrong_value", "hallucinated", "missed", "known", "reported"]


def totals(scores: DataFrame, *keys: str) -> DataFrame:
    """Sums of partial scores with precision and recall (0 where nothing was reported or known)."""
    t = scores.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in MEASURES])
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return t.withColumns({"precision": share("correct", "reported"), "recall": share("correct", "known")})


def areas_matched(found: DataFrame, targets: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Greedy match of areas alone, each target in turn taking the first close area: (plan, matched, targets)."""
    f, t = plans(found, ["plan"], "f"), plans(targets, ["plan"], "t")
    fits = lambda a, b: F.abs(b["area"] - a["area"]) <= tolerance * F.greatest(a["area"], F.lit(1e-6))
    return t.join(f, "plan", "left").select("plan", greedy(F.col("t"), F.coalesce("f", F.array().cast(ROOM)), fits)["n"].cast("long").alias("matched"), F.size("t").cast("long").alias("targets"))


def offsets(predicted: DataFrame, known: DataFrame) -> DataFrame:
    """(plan, approach, ord, offset): the relative offset to the nearest known room of the same label, if any."""
    pair = predicted.join(known.select("plan", "label", F.col("area").alias("known_area"), F.col("ord").alias("known_ord")), ["plan", "label"])
    best = F.min(F.struct(F.abs(F.col("known_area") - F.col("area")).alias("d"), "known_ord", "known_area")).alias("best")
    near = pair.groupBy("plan", "approach", "ord", "area").agg(best).filter("best.known_area > 0")
    return near.select("plan", "approach", "ord", ((F.col("area") - F.col("best.known_area")) / F.col("best.known_area")).alias("offset"))
