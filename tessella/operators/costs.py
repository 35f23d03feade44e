"""Model calls: identifiers, requests, batches, keyed results, structured answers, costs and spending."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import geometry as g

#: What an error says when a model does not take a parameter.
REJECTIONS = ("unsupported parameter", "unexpected keyword", "does not support", "not supported", "unrecognized", "removed")
NO_RESULT = "no result returned for this request"
#: Expected dollars a page of each approach, and of any other.
PER_PAGE, OTHER_PAGE = {"ocr+llm": 0.00618, "vlm": 0.00749, "hybrid": 0.00882}, 0.010
#: Tokens of a typical prompt without its image, and of a typical answer.
PROMPT_TOKENS, ANSWER_TOKENS = 400, 810
ID_LENGTH, DIGEST = 64, 8
BATCH_MULTIPLIER = 0.5
#: Default price table, US dollars per million tokens: input, output, cache read, cache write (null: as input).
PRICES = [("small", 1.0, 5.0, 0.1, 1.25), ("medium", 2.0, 10.0, 0.2, 2.5), ("large", 5.0, 25.0, 0.5, 6.25), ("plain", 3.0, 9.0, None, None)]


def custom_id(raw: Column) -> Column:
    """A legal identifier (letters, digits, _ and -, 64 at most); a changed one ends in a digest of the original."""
    plain = F.regexp_replace(raw, "[^a-zA-Z0-9_-]", "_")
    same = (plain == raw) & (F.length(plain) <= ID_LENGTH)
    return F.when(same, plain).otherwise(F.concat(F.substring(plain, 1, ID_LENGTH - DIGEST - 1), F.lit("-"), F.substring(F.sha1(raw), 1, DIGEST)))


def split_custom_id(encoded: Column, slugs: dict[str, str] | None = None) -> Column:
    """(plan, slug) of an identifier: what stands before the last dash, split at the first underscore.

    With ``slugs`` the slug is what it stands for there, null for any other.
    """
    stem = F.regexp_replace(encoded, "-[^-]*$", "")
    slug = F.regexp_replace(stem, "^[^_]*_?", "")
    if slugs is not None:
        slug = F.element_at(F.create_map(*[F.lit(x) for pair in slugs.items() for x in pair]), slug)
    return F.struct(F.split_part(stem, F.lit("_"), F.lit(1)).alias("plan"), slug.alias("slug"))


def prices(spark, rows=PRICES) -> DataFrame:
    """The price table as a dimension: one row per model, always small enough to broadcast."""
    return spark.createDataFrame(rows, "model string, input double, output double, cache_read double, cache_write double")


def costed(calls: DataFrame, price: DataFrame, batch: bool = False) -> DataFrame:
    """``calls`` with ``micro_usd``: the cost in millionths of a dollar, null for an unknown model.

    The four counters are independent and add up; a missing cache rate is the input rate.
    """
    rates = price.select("model", "input", "output", F.coalesce("cache_read", "input").alias("r"), F.coalesce("cache_write", "input").alias("w"))
    cost = F.col("input_tokens") * F.col("input") + F.col("output_tokens") * F.col("output") + F.col("cache_read_tokens") * F.col("r") + F.col("cache_write_tokens") * F.col("w")
    cost = cost * BATCH_MULTIPLIER if batch else cost
    return calls.join(rates, "model", "left").withColumn("micro_usd", F.round(cost).cast("long")).select(*calls.columns, "micro_usd")


def admitted(calls: DataFrame, cap: int, least: int = 10_000, group: str = "run") -> DataFrame:
    """Calls, in order of ``seq`` within a run, until the next could pass the cap: what is spent plus the dearest so far.

    The first call is checked against the default estimate. Costs and the cap are in millionths of a dollar.
    """
    before = Window.partitionBy(group).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(group).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    spent, worst = F.coalesce(F.sum("micro_usd").over(before), F.lit(0)), F.greatest(F.coalesce(F.max("micro_usd").over(before), F.lit(0)), F.lit(least))
    checked = calls.withColumns({"spent": spent, "stop": spent + worst > cap})
    return checked.withColumn("stopped", F.max("stop").over(so_far)).filter("not stopped").drop("stop", "stopped")


def keyed(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items with their result by ``custom_id``, never by position; an item without one is a failure."""
    got = results.select("custom_id", "body", F.lit(True).alias("present"))
    joined = items.join(got, "custom_id", "left")
    return joined.select(*items.columns, "body", F.coalesce("present", F.lit(False)).alias("ok"), F.when(F.col("present").isNull(), NO_RESULT).alias("error"))


def illegal_ids(items: DataFrame) -> DataFrame:
    """(custom_id, n) of identifiers that are not legal or come more than once."""
    return items.groupBy("custom_id").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | ~F.col("custom_id").rlike(r"^[a-zA-Z0-9_-]{1,64}$"))


def answer_status(stop_reason: Column, text: Column, keys: list[str]) -> Column:
    """What became of an answer: truncated, refused, empty, invalid, or parsed. Unexpected or missing keys are invalid."""
    found = F.array_sort(F.json_object_keys(text))
    good = found == F.array(*[F.lit(k) for k in sorted(keys)])
    return (
        F.when(stop_reason == "max_tokens", "max_tokens").when(stop_reason == "refusal", "refusal").when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(F.coalesce(good, F.lit(False)), "parsed").otherwise("invalid")
    )


def usage(calls: DataFrame) -> DataFrame:
    """One row per request from its attempts: counters add up, the last attempt decides, retries are marked."""
    order = Window.partitionBy("request").orderBy(F.desc("attempt"))
    total = Window.partitionBy("request")
    sums = {c: F.sum(F.coalesce(c, F.lit(0))).over(total) for c in ("input_tokens", "output_tokens")}
    last = calls.withColumns(sums | {"attempts": F.count("*").over(total), "place": F.row_number().over(order)}).filter("place = 1").drop("place")
    return last.withColumn("purpose", F.when(F.col("attempts") > 1, F.concat("purpose", F.lit(":retry"))).otherwise(F.col("purpose")))


def parameter_rejected(error: Column) -> Column:
    """Whether an error says that the model does not take a temperature."""
    low = F.lower(error)
    marked = F.lit(False)
    for mark in REJECTIONS:
        marked = marked | low.contains(mark)
    return F.coalesce(low.contains("temperature") & marked, F.lit(False))


def request_json(items: DataFrame, schema: str | None = None) -> DataFrame:
    """``items`` (custom_id, model, max_tokens, prompt, system) with ``request``, the JSON of each; a null system is left out.

    ``schema`` is the JSON schema of the answer, as text.
    """
    message = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    params = [F.col("model"), F.col("max_tokens"), message.alias("messages")]
    if schema is not None:
        kind = F.struct(F.lit("json_schema").alias("type"), F.lit(schema).alias("schema"))
        params.append(F.struct(kind.alias("format")).alias("output_config"))
    params.append(F.nullif(F.col("system"), F.lit("")).alias("system"))
    return items.withColumn("request", F.to_json(F.struct("custom_id", F.struct(*params).alias("params"))))


def submit_and_wait(requests: DataFrame, submit: Callable, poll: Callable, every: float = 15.0, most: float = 3600.0, sleep: Callable = time.sleep, most_items: int = 100_000) -> DataFrame:
    """The results of one batch, joined to its requests (custom_id, request) by identifier.

    ``submit(requests) -> batch`` takes the JSON texts, ``poll(batch)`` gives None until there are results
    [(custom_id, body)]. Illegal or repeated identifiers raise before anything is sent, as do more than ``most_items``,
    which is the service's bound of a batch. No requests, no call.
    """
    spark = requests.sparkSession
    bad = illegal_ids(requests).limit(5).collect()
    if bad:
        raise ValueError(f"illegal or repeated identifiers: {[r['custom_id'] for r in bad]}")
    items = [r["request"] for r in requests.select("request").limit(most_items + 1).collect()]
    if len(items) > most_items:
        raise ValueError(f"a batch takes {most_items} requests")
    results: list | None = []
    if items:
        batch, waited, results = submit(items), 0.0, None
        while (results := poll(batch)) is None:
            if waited >= most:
                raise TimeoutError(f"no results after {most:g} s")
            sleep(every)
            waited += every
    return keyed(requests, spark.createDataFrame(list(results), "custom_id string, body string"))


def batch_projection(pending: DataFrame, multiplier: float = BATCH_MULTIPLIER) -> DataFrame:
    """(requests, usd): what a batch of ``pending`` (approach) should cost at the batch rate."""
    page = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in PER_PAGE.items() for x in pair]), F.col("approach")), F.lit(OTHER_PAGE))
    return pending.agg(F.count("*").alias("requests"), F.round(F.coalesce(F.sum(page * multiplier), F.lit(0.0)), 6).alias("usd"))


def resolution_estimate(images: DataFrame, price: DataFrame, model: str, edges: list[int]) -> DataFrame:
    """(edge, mean_tokens, micro_usd, share): image tokens and cost of a page at each longest edge; ``images`` has width, height.

    ``share`` is the cost relative to the greatest edge, in hundredths.
    """
    sized = images.select(F.explode(F.array(*map(F.lit, edges))).alias("edge"), "width", "height")
    sized = sized.select("edge", F.col("width").alias("w"), F.col("height").alias("h"))
    scale = F.least(F.lit(1.0), F.col("edge") / F.greatest("w", "h"))
    tokens = g.image_tokens((F.col("w") * scale).cast("int"), (F.col("h") * scale).cast("int"))
    mean = sized.groupBy("edge").agg(F.avg(tokens).alias("mean_tokens"))
    rate = price.filter(F.col("model") == model).select("input", "output")
    cost = F.floor(F.col("mean_tokens") + PROMPT_TOKENS) * F.col("input") + F.lit(ANSWER_TOKENS) * F.col("output")
    costed = mean.join(F.broadcast(rate)).select("edge", "mean_tokens", F.round(cost).cast("long").alias("micro_usd"))
    widest = Window.orderBy(F.desc("edge")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return costed.withColumn("share", F.round(100.0 * F.col("micro_usd") / F.first("micro_usd").over(widest), 2))
