"""Extraction by an injected model: requests, calls with retries, strict answers, and the labelling helpers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.lexicon import normalise_label
from tessella.functions.parse import MOST_AREA, parsed
from tessella.operators.grounding import DECIMAL, WITH_UNIT
from tessella.operators.pairing import prompt_lines

APPROACHES = {"ocr+llm": (True, False), "vlm": (False, True), "hybrid": (True, True)}
ROOM = "struct<label_raw:string,room_type:string,area_m2:double,width_m:double,length_m:double,source_token_ids:array<int>,confidence:double>"
ROOM_KEYS = ["label_raw", "room_type", "area_m2", "width_m", "length_m", "source_token_ids", "confidence"]
CALL = "page_id long, approach string, text string, stop_reason string, ok boolean, error string, attempts int, input_tokens long, output_tokens long"
NOT_AN_AREA = ("scale", "elevation", "apartment_summary", "sheet_number", "bare_integer")


def requests(tokens: DataFrame, pairs: DataFrame, approach: str) -> DataFrame:
    """(page_id, approach, prompt, with_image): the token list and candidate pairs, as far as the approach shows them."""
    with_tokens, with_image = APPROACHES[approach]
    line = F.format_string('  "%s" = %s m2 (tokens %d and %d)', "label_text", F.regexp_replace(F.col("area_m2").cast("string"), r"\.0$", ""), "label_id", "area_id")
    near = pairs.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("label_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("candidates"))
    page = prompt_lines(tokens).join(near, "page_id", "left")
    shown = F.concat(F.lit("Tokens on this page:\n"), F.col("token_list"), F.lit("\n\nCandidate pairs:\n"), F.coalesce("candidates", F.lit("  (none found by proximity)")))
    prompt = shown if with_tokens else F.lit("Read the rooms and their areas from the image.")
    return page.select("page_id", F.lit(approach).alias("approach"), prompt.alias("prompt"), F.lit(with_image).alias("with_image"))


class CallError(Exception):
    """A call that failed after it was answered: ``input_tokens`` and ``output_tokens`` were spent nevertheless."""

    def __init__(self, message: str, input_tokens: int = 0, output_tokens: int = 0):
        super().__init__(message)
        self.input_tokens, self.output_tokens = input_tokens, output_tokens


def called(asked: DataFrame, client: Callable[[str, bool], dict], retries: int = 1, wait: float = 0.0) -> DataFrame:
    """The answer to each request; ``client(prompt, with_image)`` gives text, stop_reason and token counts, or raises.

    A failed call is tried again ``retries`` times, after ``wait`` seconds that double each time; a refusal is an answer
    and is not paid for again. Counters add up over attempts, those of a ``CallError`` too, and a request never stops the
    others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for page, approach, prompt, image in batch[["page_id", "approach", "prompt", "with_image"]].itertuples(index=False):
                spent, answer, error, tried = [0, 0], {}, None, 0
                for tried in range(1, retries + 2):
                    try:
                        answer = client(prompt, image)
                    except Exception as failed:
                        answer, error = {}, f"{type(failed).__name__}: {failed}"
                        spent = [a + getattr(failed, c, 0) for a, c in zip(spent, ("input_tokens", "output_tokens"), strict=True)]
                        if wait and tried <= retries:
                            time.sleep(wait * 2 ** (tried - 1))
                        continue
                    spent = [a + (answer.get(c) or 0) for a, c in zip(spent, ("input_tokens", "output_tokens"), strict=True)]
                    error = None if answer.get("text") and answer.get("stop_reason") not in ("refusal", "max_tokens") else answer.get("stop_reason") or "no output"
                    if error is None or answer.get("stop_reason") == "refusal":
                        break
                out.append((page, approach, answer.get("text"), answer.get("stop_reason"), error is None, error, tried, *spent))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CALL.split(", ")])

    return asked.mapInPandas(run, CALL)


def answered(calls: DataFrame) -> DataFrame:
    """(page_id, approach, room_index, room fields) of valid answers ``{"rooms": [...], "notes": ...}``.

    An answer with other keys, in itself or in a room, is not valid and gives no rooms.
    """
    rooms = F.from_json("text", f"struct<rooms:array<{ROOM}>,notes:string>")["rooms"]
    raw = F.from_json(F.get_json_object("text", "$.rooms"), "array<string>")
    keys = F.array(*[F.lit(k) for k in sorted(ROOM_KEYS)])
    strict = (F.array_sort(F.json_object_keys("text")) == F.array(F.lit("notes"), F.lit("rooms"))) & F.forall(raw, lambda r: F.array_sort(F.json_object_keys(r)) == keys)
    good = calls.filter("ok").withColumn("rooms", F.when(strict, rooms))
    return good.select("page_id", "approach", F.posexplode("rooms").alias("room_index", "room")).select("page_id", "approach", "room_index", "room.*")


def is_label(text: Column, label: Column) -> Column:
    """Whether a token is this label: as a whole, or as one of its words."""
    key = normalise_label(label)
    return (key != "") & ((normalise_label(text) == key) | F.exists(F.split(text, r"\s+"), lambda w: normalise_label(w) == key))


def readable_numbers(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``numbers``: what a reader could take for areas, parser or not.

    Tokens read as something else have none; a trusted area is its own; else decimals, and integers with a unit that are
    not the tail of one, within plausible bounds.
    """
    t = parsed(tokens)
    value = lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double")
    decimals = F.transform(F.regexp_extract_all("text", F.lit(DECIMAL), F.lit(0)), value)
    units = F.transform(F.regexp_extract_all(F.regexp_replace("text", DECIMAL, "#"), F.lit(WITH_UNIT), F.lit(1)), value)
    loose = F.filter(F.concat(decimals, units), lambda v: v.between(1.0, MOST_AREA))
    other = (F.col("kind") == "door_window_code") | F.col("fmt").isin(*NOT_AN_AREA)
    sure = (F.col("kind") == "area") & F.col("plausible") & ~F.col("fmt").isin("area_bare_integer", "label_area_integer")
    numbers = F.when(other, F.array().cast("array<double>")).when(sure, F.array("area_m2")).otherwise(loose)
    return t.withColumn("numbers", F.coalesce(numbers, F.array().cast("array<double>"))).select(*tokens.columns, "numbers")


def without_temperature(client: Callable[..., dict], model: str, temperature: float | None, rejected: Callable[[str], bool], memory: set[str]) -> Callable[[str, bool], dict]:
    """A client that sends a temperature until a model rejects it, and then never again to that model.

    ``client(prompt, with_image, temperature)``; ``rejected`` tells such errors; ``memory`` holds the models that do not
    take one. The call that was rejected is made again at once.
    """

    def call(prompt: str, with_image: bool) -> dict:
        if temperature is not None and model not in memory:
            try:
                return client(prompt, with_image, temperature)
            except Exception as failed:
                if not rejected(str(failed)):
                    raise
                memory.add(model)
        return client(prompt, with_image, None)

    return call


def run_approaches(names: list[str], runners: dict[str, Callable[[], DataFrame]]) -> DataFrame | None:
    """The rooms of all approaches with their ``source``; unknown names are passed over, None if no approach is known."""
    parts = [runners[a]().withColumn("source", F.lit(a)) for a in names if a in runners]
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def rescored(rows: DataFrame, bodies: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (plan, approach, ...) with the columns that ``score`` gives from the raw bodies (plan, approach, body).

    ``score(bodies)`` has plan and approach; rows without a body keep what they had.
    """
    new = score(bodies)
    keys, fresh = ["plan", "approach"], [c for c in new.columns if c not in ("plan", "approach")]
    renamed = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in fresh], F.lit(True).alias("_scored"))
    both = rows.join(renamed, keys, "left")
    value = lambda c: F.when(F.col("_scored"), F.col(f"_new_{c}")).otherwise(F.col(c) if c in rows.columns else F.lit(None))
    kept = [c for c in rows.columns if c not in fresh]
    return both.select(*kept, *[value(c).alias(c) for c in fresh])
