"""More registered queries: SQL for the order-dependent operators, stored plans, calls, annotations and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import geometry as g
from tessella.functions import parse as p
from tessella.operators import annotations, costs, grounding, pairing, records, reports, scoring
from tessella.plans import sqlparts as s
from tessella.plans.catalogue import _CALLS_SQL, _EVIDENCE_SQL, _SCORE_SQL, SQL, calls, claimed, known_rooms, predictions, query, read, table
from tessella.sources.token_view import token_view


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


# -- SQL of the folds: one step a token or prediction, the state of a page in one row ------------------------

_COMMON = "greatest(least(o.x2, t.x2) - greatest(o.x1, t.x1), 0) * greatest(least(o.y2, t.y2) - greatest(o.y1, t.y1), 0)"
_OVERLAP = f"{_COMMON} > 0 AND 2 * {_COMMON} >= (o.x2 - o.x1) * (o.y2 - o.y1) + (t.x2 - t.x1) * (t.y2 - t.y1) - {_COMMON}"
_TOKEN = "{'x1': t.x1, 'y1': t.y1, 'x2': t.x2, 'y2': t.y2, 'k': t.k"

SQL["q_nms_tokens"] = recursive(
    s.tokens_sql(
        ", t AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CAST(round(-confidence * 1e9) AS BIGINT), token_index) AS k FROM tokens), "
        f"state AS (SELECT page_id, k, [{_TOKEN}}}] AS kept FROM t WHERE k = 1 UNION ALL "
        f"SELECT s.page_id, t.k, CASE WHEN len(list_filter(s.kept, lambda o: {_OVERLAP})) > 0 THEN s.kept ELSE list_append(s.kept, {_TOKEN}}}) END FROM state s JOIN t ON t.page_id = s.page_id AND t.k = s.k + 1), "
        "last AS (SELECT page_id, arg_max(kept, k) AS kept FROM state GROUP BY page_id), "
        "one AS (SELECT page_id, unnest(kept).k AS k FROM last) SELECT t.page_id, t.token_index, t.text FROM one JOIN t ON t.page_id = one.page_id AND t.k = one.k"
    )
)
SQL["q_dedup_tokens"] = recursive(
    s.tokens_sql(
        f", ls AS ({SQL['q_label_score']}), ps AS ({SQL['q_pattern_score']}), "
        "t AS (SELECT k.*, greatest(ls.score, ps.score) AS score, NOT (k.y2 - k.y1 > (k.x2 - k.x1) * 1.2) OR k.angle IN (90, 270) AS upright, "
        "row_number() OVER (PARTITION BY page_id ORDER BY -((k.x2 - k.x1) * (k.y2 - k.y1)), token_index) AS k FROM tokens k JOIN ls ON ls.text = k.text JOIN ps ON ps.text = k.text), "
        f"state AS (SELECT page_id, k, [{_TOKEN}, 'c': 0}}] AS kept FROM t WHERE k = 1 UNION ALL "
        f"SELECT s.page_id, t.k, list_append(s.kept, {_TOKEN}, 'c': CAST(coalesce(list_min(list_transform(list_filter(s.kept, lambda o: {_OVERLAP}), lambda o: o.c)), list_max(list_transform(s.kept, lambda o: o.c)) + 1) AS INTEGER)}}) "
        "FROM state s JOIN t ON t.page_id = s.page_id AND t.k = s.k + 1), "
        "last AS (SELECT page_id, arg_max(kept, k) AS kept FROM state GROUP BY page_id), one AS (SELECT page_id, unnest(kept) AS o FROM last), "
        "best AS (SELECT t.*, row_number() OVER (PARTITION BY t.page_id, one.o.c ORDER BY score DESC, upright DESC, confidence DESC, t.k) AS place FROM one JOIN t ON t.page_id = one.page_id AND t.k = one.o.k) "
        "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, token_index) - 1 AS INTEGER) AS position, token_index, text, score FROM best WHERE place = 1"
    )
)
_CLOSE = "abs(t.area - o.area) <= tol * greatest(abs(o.area), 1e-6)"
_FOLD_SQL = (
    ", k AS (SELECT plan, list({'label': label, 'area': area} ORDER BY ord) AS known FROM known GROUP BY plan), "
    "t AS (SELECT p.*, row_number() OVER (PARTITION BY plan, approach ORDER BY ord) AS n FROM pred p), "
    "size AS (SELECT plan, approach, count(*) AS reported FROM pred GROUP BY plan, approach), "
    "state AS (SELECT z.plan, z.approach, tol, CAST(0 AS BIGINT) AS n, k.known AS rest, CAST([] AS BIGINT[]) AS free FROM size z JOIN k ON k.plan = z.plan, (SELECT unnest([{tolerances}]) AS tol) UNION ALL "
    "SELECT plan, approach, tol, n, CASE WHEN place > 0 THEN list_concat(rest[:place - 1], rest[place + 1:]) ELSE rest END, CASE WHEN place > 0 THEN free ELSE list_append(free, n) END FROM ("
    f"SELECT s.plan, s.approach, tol, t.n, rest, free, coalesce(list_position(list_transform(rest, lambda o: o.label = t.label AND {_CLOSE}), true), 0) AS place "
    "FROM state s JOIN t ON t.plan = s.plan AND t.approach = s.approach AND t.n = s.n + 1)), "
    "last AS (SELECT s.* FROM state s JOIN size z ON z.plan = s.plan AND z.approach = s.approach AND s.n = z.reported), "
    f"class AS (SELECT l.plan, l.approach, l.tol, len(list_filter(k.known, lambda o: o.label <> t.label AND {_CLOSE})) > 0 AS other, len(list_filter(k.known, lambda o: o.label = t.label)) > 0 AS named "
    "FROM (SELECT plan, approach, tol, unnest(free) AS n FROM last) l JOIN t ON t.plan = l.plan AND t.approach = l.approach AND t.n = l.n JOIN k ON k.plan = l.plan), "
    "counts AS (SELECT plan, approach, tol, count(*) FILTER (other) AS misattributed, count(*) FILTER (NOT other AND named) AS wrong_value, count(*) FILTER (NOT other AND NOT named) AS hallucinated FROM class GROUP BY plan, approach, tol), "
    "scored AS (SELECT l.plan, l.approach, l.tol AS tolerance, z.reported - len(l.free) AS correct, coalesce(c.misattributed, 0) AS misattributed, coalesce(c.wrong_value, 0) AS wrong_value, coalesce(c.hallucinated, 0) AS hallucinated, "
    "len(l.rest) AS missed, len(k.known) AS known, z.reported FROM last l JOIN size z ON z.plan = l.plan AND z.approach = l.approach JOIN k ON k.plan = l.plan LEFT JOIN counts c ON c.plan = l.plan AND c.approach = l.approach AND c.tol = l.tol)"
)


def _folded(tolerances: str, select: str) -> str:
    return recursive(s.rooms_sql(select, _SCORE_SQL + _FOLD_SQL.replace("{tolerances}", tolerances)))


SQL["q_area_greedy_match"] = _folded("CAST(0.05 AS DOUBLE)", "SELECT * FROM scored")
SQL["q_tolerance_sweep"] = _folded(
    "CAST(0.02 AS DOUBLE), 0.05, 0.1, 0.2",
    "SELECT approach, tolerance, "
    + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in scoring.MEASURES)
    + ", CASE WHEN sum(reported) = 0 THEN 0 ELSE sum(correct) / sum(reported) END AS precision, CASE WHEN sum(known) = 0 THEN 0 ELSE sum(correct) / sum(known) END AS recall FROM scored GROUP BY approach, tolerance",
)


# -- stored plans -------------------------------------------------------------------------------------------


def pages_of(tokens: DataFrame) -> DataFrame:
    """Ten pages make a plan; every seventh page has no stored image."""
    page = F.col("page_id")
    plan = F.floor(page / 10).cast("string")
    one = tokens.select("page_id").distinct().select("page_id", plan.alias("plan_id"), (page % 10 + 1).cast("int").alias("page_number"))
    return one.withColumn("image_key", F.format_string("plans/%s/page_%03d.png", "plan_id", "page_number"))


_PAGES_SQL = "pages_of AS (SELECT DISTINCT page_id, CAST(page_id // 10 AS VARCHAR) AS plan_id, CAST(page_id % 10 + 1 AS INTEGER) AS page_number FROM tokens)"


@query(
    s.rooms_sql(
        "SELECT r.page_id, r.label_id, CASE WHEN q.ptype <> 'unknown' THEN q.ptype ELSE m.room_type END AS room_type, nullif(r.label_raw, '') AS name, array_to_string(list_sort(r.source_token_ids), ',') AS ids, b.x1, b.y1, b.x2, b.y2 "
        "FROM room_norm r JOIN m ON m.page_id = r.page_id AND m.label_id = r.label_id LEFT JOIN room_res q ON q.norm = r.norm LEFT JOIN (SELECT x.page_id, x.label_id, min(t.x1) AS x1, min(t.y1) AS y1, max(t.x2) AS x2, max(t.y2) AS y2 "
        "FROM (SELECT page_id, label_id, unnest(source_token_ids) AS token_index FROM rooms) x JOIN tokens t ON t.page_id = x.page_id AND t.token_index = x.token_index GROUP BY x.page_id, x.label_id) b "
        "ON b.page_id = r.page_id AND b.label_id = r.label_id",
        "m AS (SELECT page_id, label_id, CASE WHEN label_id % 3 = 0 THEN 'garage' ELSE room_type END AS room_type FROM rooms)",
    )
)
def q_stored_rooms(spark, d):
    """Rooms as they are saved, where a model has given some of them another type."""
    tokens = read(spark, d)
    rooms = pairing.rules_rooms(tokens).withColumn("room_type", F.when(F.col("label_id") % 3 == 0, "garage").otherwise(F.col("room_type")))
    return records.stored_rooms(rooms, tokens).select("page_id", "label_id", "room_type", "name", F.array_join("source_token_ids", ",").alias("ids"), *g.BOX)


@query(s.tokens_sql(f", {_PAGES_SQL} SELECT plan_id, page_number, token_index, text FROM tokens JOIN pages_of USING (page_id)"))
def q_plan_tokens(spark, d):
    t = token_view(spark, d)
    return records.plan_tokens(t, pages_of(t)).select("plan_id", "page_number", "token_index", "text")


@query(
    s.rooms_sql(
        "SELECT w.plan_id, count(p.page_id) > 0 AS found, count(DISTINCT p.page_id) AS pages, coalesce(sum(r.n), 0)::BIGINT AS rooms, coalesce(sum(t.n), 0)::BIGINT AS tokens, coalesce(string_agg(r.labels, ';' ORDER BY p.page_number), '') AS labels "
        "FROM wanted w LEFT JOIN pages_of p USING (plan_id) LEFT JOIN (SELECT page_id, count(*) AS n, string_agg(label_raw, ',' ORDER BY label_id) AS labels FROM rooms WHERE label_id % 2 = 0 GROUP BY page_id) r ON r.page_id = p.page_id "
        "LEFT JOIN (SELECT page_id, count(*) AS n FROM tokens GROUP BY page_id) t ON t.page_id = p.page_id GROUP BY w.plan_id",
        _PAGES_SQL + ", wanted AS (SELECT DISTINCT plan_id FROM pages_of UNION ALL SELECT 'missing')",
    )
)
def q_plan_view(spark, d):
    """Plans with their pages, the rooms of one source and tokens nested, one plan of which does not exist."""
    tokens = read(spark, d)
    rooms = pairing.rules_rooms(tokens).withColumn("source", F.when(F.col("label_id") % 2 == 0, "rules").otherwise("vlm"))
    pages = pages_of(tokens)
    wanted = pages.select("plan_id").distinct().union(spark.createDataFrame([("missing",)], "plan_id string"))
    v = records.plan_view(wanted, pages, rooms, tokens, include_tokens=True, source="rules")
    total = lambda c: F.aggregate("pages", F.lit(0).cast("long"), lambda n, x: n + F.size(x[c]))
    labels = F.transform(F.filter("pages", lambda x: F.size(x["rooms"]) > 0), lambda x: F.array_join(x["rooms"]["label_raw"], ","))
    return v.select("plan_id", "found", F.size("pages").cast("long").alias("pages"), total("rooms").alias("rooms"), total("tokens").alias("tokens"), F.array_join(labels, ";").alias("labels"))


@query(
    s.tokens_sql(
        f", {_PAGES_SQL}, wanted AS (SELECT plan_id, page_number FROM pages_of WHERE page_id % 3 = 0 UNION ALL SELECT plan_id, 99 FROM pages_of WHERE page_number = 1) "
        "SELECT w.plan_id, w.page_number, CASE WHEN p.page_id IS NULL THEN 'no such page' WHEN p.page_id % 7 = 0 THEN 'no stored image' ELSE 'ok' END AS status FROM wanted w LEFT JOIN pages_of p ON p.plan_id = w.plan_id AND p.page_number = w.page_number"
    )
)
def q_page_lookup(spark, d):
    pages = pages_of(token_view(spark, d))
    wanted = pages.filter("page_id % 3 = 0").select("plan_id", "page_number").union(pages.filter("page_number = 1").select("plan_id", F.lit(99).alias("page_number")))
    return records.page_lookup(wanted, pages, pages.filter("page_id % 7 <> 0")).select("plan_id", "page_number", "status")


@query(
    "SELECT n_nationkey, array_to_string(a, ',') AS listed, array_to_string(list_filter(a, lambda x: x IN ('rules', 'vlm', 'hybrid') AND (n_nationkey % 2 = 0 OR x = 'rules')), ',') AS run FROM ("
    "SELECT n_nationkey, list_filter(list_transform(string_split(' rules,, ' || lower(n_name) || ' ,vlm,hybrid ', ','), lambda x: trim(x)), lambda x: x <> '') AS a FROM nation)"
)
def q_approaches(spark, d):
    """Lists of approaches, and which of them can run with and without a credential."""
    text = F.concat(F.lit(" rules,, "), F.lower("n_name"), F.lit(" ,vlm,hybrid "))
    t = table(spark, d, "nation").select("n_nationkey", records.approaches(text).alias("a"))
    run = records.runnable(F.col("a"), ["rules", "vlm", "hybrid"], F.col("n_nationkey") % 2 == 0)
    return t.select("n_nationkey", F.array_join("a", ",").alias("listed"), F.array_join(run, ",").alias("run"))


@query(s.tokens_sql("SELECT page_id, token_index, x1 * 900 / 640.0 AS x1, y1 * 900 / 640.0 AS y1, x2 * 900 / 640.0 AS x2, y2 * 900 / 640.0 AS y2 FROM tokens").replace("900 / 640.0", "(900 / 640.0::DOUBLE)"))
def q_overlay(spark, d):
    """Boxes of a page of 640 pixels shown 900 wide."""
    return token_view(spark, d).select("page_id", "token_index", records.overlay(g.box(), F.lit(640.0), F.lit(900.0)).alias("b")).select("page_id", "token_index", "b.*")


@query(
    s.tokens_sql(
        "SELECT page_id, token_index, printf('  %-32s %6.3f  %5d  (%d,%d,%d,%d)', CASE WHEN length(long) > 32 THEN left(long, 29) || '...' ELSE long END, confidence, angle, x1, y1, x2, y2) AS line "
        "FROM (SELECT *, CASE WHEN token_index % 5 = 0 THEN repeat('abc ', 3 + token_index % 11) ELSE 'abc' END AS long FROM tokens)"
    )
)
def q_token_table(spark, d):
    long = F.when(F.col("token_index") % 5 == 0, F.repeat(F.lit("abc "), (3 + F.col("token_index") % 11).cast("int"))).otherwise("abc")
    return records.token_table(token_view(spark, d).withColumn("text", long))


# -- labelling and samples ----------------------------------------------------------------------------------


@query(
    s.rooms_sql(
        "SELECT a.page_id, a.token_index, a.area_m2 FROM read a WHERE kind = 'area' AND plausible AND NOT EXISTS (SELECT 1 FROM rooms r WHERE r.page_id = a.page_id AND abs(a.area_m2 - r.area_m2) <= 0.01 * greatest(r.area_m2, 1e-6))"
    )
)
def q_leftover_areas(spark, d):
    """Readable areas that no room claims."""
    tokens = read(spark, d)
    areas = tokens.filter("kind = 'area' and plausible").select("page_id", "token_index", "text", "area_m2")
    return records.leftover_areas(areas, pairing.rules_rooms(tokens).select("page_id", "area_m2")).select("page_id", "token_index", "area_m2")


@query(s.rooms_sql("SELECT page_id AS plan, count(*) AS rooms, count(*) FILTER (label_id % 4 <> 0 AND area_m2 IS NOT NULL) AS printed, count(*) FILTER (label_id % 4 <> 0) AS decided, count(*) FILTER (label_id % 4 <> 0) = count(*) AS complete FROM rooms GROUP BY 1"))
def q_label_progress(spark, d):
    """How far the labelling of each plan is."""
    rooms = pairing.rules_rooms(read(spark, d))
    return records.progress(rooms.select(F.col("page_id").alias("plan"), (F.col("label_id") % 4 != 0).alias("decided"), "area_m2"))


@query(
    s.rooms_sql(
        "SELECT page_id AS plan, array_to_string(list_sort(list(DISTINCT key) FILTER (key NOT IN ('', 'UNDEFINED'))), ',') AS labels, count(*) FILTER (area_m2 >= 1.0) AS areas FROM ("
        "SELECT r.page_id, r.area_m2, coalesce(q.resolved, r.norm) AS key FROM room_norm r LEFT JOIN room_res q ON q.norm = r.norm) GROUP BY 1"
    )
)
def q_reference_sets(spark, d):
    """The label keys and areas that each plan is scored against."""
    rooms = pairing.rules_rooms(read(spark, d))
    keys = rooms.select("label_raw").distinct().withColumn("label_key", p.label_key(F.lit(None).cast("string"), F.col("label_raw")))
    sets = records.reference_sets(rooms.join(keys, "label_raw").select(F.col("page_id").alias("plan"), "label_key", F.col("area_m2").alias("area")))
    return sets.select("plan", F.array_join("labels", ",").alias("labels"), F.size("areas").cast("long").alias("areas"))


@query("SELECT plan, approach, body FROM (SELECT conv_id AS plan, role AS approach, text AS body, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS place FROM conversations WHERE text IS NOT NULL AND text <> '') WHERE place = 1")
def q_first_bodies(spark, d):
    """The first cached body with text of each plan and approach."""
    c = table(spark, d, "conversations")
    return records.first_bodies(c.select(F.col("conv_id").alias("plan"), F.col("role").alias("approach"), F.col("turn").alias("seq"), F.col("text").alias("body")))


@query("SELECT plan FROM (SELECT o_orderkey AS plan FROM orders GROUP BY 1 ORDER BY md5('17:' || o_orderkey) LIMIT 50)")
def q_sampled_plans(spark, d):
    """Fifty plans by a seed (a sampling operator)."""
    return records.sampled(table(spark, d, "orders").select(F.col("o_orderkey").alias("plan")), 50, 17)


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS plan FROM orders")
def q_plan_ids(spark, d):
    return records.plan_ids(table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("plan")))


@query("SELECT event_id, coalesce(event_type, 'none') AS event_type, 0 AS spurious, CAST(event_id % 3 AS BIGINT) AS labels FROM events")
def q_backfilled(spark, d):
    """Rows of an older report with the columns that it lacks."""
    e = table(spark, d, "events").select("event_id", "event_type")
    return records.backfilled(e, {"event_type": F.lit("none"), "spurious": F.lit(0), "labels": (F.col("event_id") % 3).cast("long")})


# -- calls --------------------------------------------------------------------------------------------------

_ERROR = ["temperature is not supported", "Unsupported parameter: TEMPERATURE", "rate limit", "temperature too high", "max_tokens was removed"]


@query("SELECT event_id, e IS NOT NULL AND contains(lower(e), 'temperature') AND (" + " OR ".join(f"contains(lower(e), {s.lit(m)})" for m in costs.REJECTIONS) + f") AS rejected FROM (SELECT event_id, list_extract([{', '.join(map(s.lit, _ERROR))}], CAST(event_id % 6 + 1 AS INTEGER)) AS e FROM events)")
def q_parameter_rejection(spark, d):
    """Which errors say that a model takes no temperature."""
    e = F.get(F.array(*map(F.lit, _ERROR)), (F.col("event_id") % 6).cast("int"))
    return table(spark, d, "events").select("event_id", costs.parameter_rejected(e).alias("rejected"))


@query(
    "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN to_json({'custom_id': conv_id || '_' || turn, 'params': {'model': 'small', 'max_tokens': 100, 'messages': [{'role': 'user', 'content': left(role, 4)}], 'system': 'brief'}}) "
    "ELSE to_json({'custom_id': conv_id || '_' || turn, 'params': {'model': 'small', 'max_tokens': 100, 'messages': [{'role': 'user', 'content': left(role, 4)}]}}) END::VARCHAR AS request FROM conversations"
)
def q_request_json(spark, d):
    """Batch requests as JSON; those without a system text leave it out."""
    items = table(spark, d, "conversations").select(
        "conv_id", "turn", F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("custom_id"), F.lit("small").alias("model"), F.lit(100).alias("max_tokens"),
        F.left("role", F.lit(4)).alias("prompt"), F.when(F.col("turn") % 2 == 0, "brief").alias("system"),
    )
    return costs.request_json(items).select("conv_id", "turn", "request")


@query("SELECT count(*) AS requests, round(sum(CASE event_type WHEN 'click' THEN 0.00618 WHEN 'view' THEN 0.00749 WHEN 'purchase' THEN 0.00882 ELSE 0.010 END * 0.5), 6) AS usd FROM events")
def q_batch_projection(spark, d):
    """What the calls would cost as one batch."""
    names = {"click": "ocr+llm", "view": "vlm", "purchase": "hybrid"}
    approach = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("event_type")), F.lit("other"))
    return costs.batch_projection(table(spark, d, "events").select(approach.alias("approach")))


@query(
    "SELECT edge, CAST(round(mean_tokens * 1000) AS BIGINT) AS milli_tokens, micro_usd, round(100.0 * micro_usd / first(micro_usd) OVER (ORDER BY edge DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 2) AS share FROM ("
    f"SELECT edge, avg(n) AS mean_tokens, CAST(round(floor(avg(n) + {costs.PROMPT_TOKENS}) * 2.0 + {costs.ANSWER_TOKENS} * 10.0) AS BIGINT) AS micro_usd FROM ("
    "SELECT edge, CAST(trunc(trunc(w * least(1.0::DOUBLE, edge::DOUBLE / greatest(w, h))) * trunc(h * least(1.0::DOUBLE, edge::DOUBLE / greatest(w, h))) / 750.0) AS INTEGER) AS n "
    "FROM (SELECT o_orderkey % 4000 + 100 AS w, o_custkey % 3000 + 100 AS h FROM orders), (SELECT unnest([1536, 1024, 768, 512]) AS edge)) GROUP BY edge)"
)
def q_resolution_estimate(spark, d):
    """Image tokens and cost of a page at four resolutions."""
    images = table(spark, d, "orders").select((F.col("o_orderkey") % 4000 + 100).alias("width"), (F.col("o_custkey") % 3000 + 100).alias("height"))
    r = costs.resolution_estimate(images, costs.prices(spark), "medium", [1536, 1024, 768, 512])
    return r.select("edge", F.round(F.col("mean_tokens") * 1000).cast("long").alias("milli_tokens"), "micro_usd", "share")


@query(f"WITH {_CALLS_SQL} SELECT run, seq // 3 AS request, count(*) AS n FROM calls GROUP BY ALL HAVING count(*) > 1")
def q_illegal_ids(spark, d):
    """Identifiers that come more than once in a batch."""
    c = calls(spark, d).select("run", F.floor(F.col("seq") / 3).alias("request"))
    bad = costs.illegal_ids(c.select(F.concat_ws("-", F.col("run").cast("string"), F.col("request").cast("string")).alias("custom_id")))
    part = lambda k: F.split_part("custom_id", F.lit("-"), F.lit(k)).cast("long")
    return bad.select(part(1).alias("run"), part(2).alias("request"), "n")


# -- reports ------------------------------------------------------------------------------------------------


@query(
    s.rooms_sql(
        "SELECT kind, CAST(n AS BIGINT) AS n, CAST(place AS INTEGER) AS place, page_id, label_id FROM (SELECT *, count(*) OVER (PARTITION BY kind) AS n, row_number() OVER (PARTITION BY kind ORDER BY page_id, label_id) AS place FROM ("
        "SELECT CASE k WHEN 1 THEN 'unknown_token_id' ELSE 'missing_token_ids' END AS kind, page_id, label_id FROM judged WHERE k IN (1, 2) UNION ALL "
        "SELECT CASE WHEN seen THEN 'area_from_unparsed_token' ELSE 'ungrounded_area' END, page_id, label_id FROM judged WHERE NOT good)) WHERE place <= 3",
        _EVIDENCE_SQL,
    )
)
def q_issue_examples(spark, d):
    """How many rooms have each issue, with the first three of each (a top-k report)."""
    tokens = read(spark, d)
    found = grounding.checked(claimed(tokens), tokens, "rules").select("page_id", "label_id", F.explode("issues.kind").alias("kind"))
    return reports.examples(found, ["kind"], ["page_id", "label_id"], 3).select("kind", "n", "place", "page_id", "label_id")


@query(s.rooms_sql("SELECT k AS class, count(*) FILTER (NOT good) AS before, count(*) FILTER (NOT good AND NOT seen) AS after, count(*) FILTER (NOT good) - count(*) FILTER (NOT good AND NOT seen) AS removed FROM judged GROUP BY k", _EVIDENCE_SQL))
def q_removed_artifacts(spark, d):
    """Areas flagged by the parser alone, and those that remain once unparsed tokens count."""
    tokens = read(spark, d)
    found = grounding.checked(claimed(tokens), tokens, "rules").withColumn("kinds", F.col("issues.kind"))
    real = F.array_contains("kinds", "ungrounded_area")
    flags = found.select((F.col("label_id") % 6).alias("class"), (real | F.array_contains("kinds", "area_from_unparsed_token")).alias("flagged"), real.alias("real"))
    return reports.removed(flags, "class")


_ARMS = ("off", "aggressive")
_ARM_TOKENS = s.TOKENS.replace("),\ntokens AS (", "),\nbase_tokens AS (") + (
    f", tokens AS (SELECT page_id * 2 AS page_id, token_index, text, confidence, angle, x1, y1, x2, y2 FROM base_tokens UNION ALL "
    "SELECT page_id * 2 + 1, token_index, regexp_replace(text, '(?i)(\\d)\\s*m\\s*$', '\\1 m2'), confidence, angle, x1, y1, x2, y2 FROM base_tokens)"
)


@query(
    s.rooms_sql(
        "SELECT list_extract(['off', 'aggressive'], CAST(t.arm + 1 AS INTEGER)) AS arm, readable, CAST(sum(r.rooms) AS BIGINT) AS rooms, CAST(sum(r.areas) AS BIGINT) AS areas, count(*) FILTER (r.areas <> coalesce(b.areas, 0)) AS changed "
        "FROM (SELECT page_id % 2 AS arm, count(*) FILTER (kind = 'area' AND plausible AND NOT weak) AS readable FROM read GROUP BY 1) t "
        "JOIN (SELECT page_id % 2 AS arm, page_id // 2 AS plan, count(*) AS rooms, count(area_m2) AS areas FROM rooms GROUP BY 1, 2) r ON r.arm = t.arm "
        "LEFT JOIN (SELECT page_id // 2 AS plan, count(area_m2) AS areas FROM rooms WHERE page_id % 2 = 0 GROUP BY 1) b ON b.plan = r.plan GROUP BY t.arm, readable"
    ).replace(s.TOKENS, _ARM_TOKENS)
)
def q_arm_statistics(spark, d):
    """Readable tokens, rooms and areas with and without repair of bare trailing metres, and how many plans change."""
    t = token_view(spark, d)
    both = t.withColumn("page_id", F.col("page_id") * 2).unionByName(t.withColumns({"page_id": F.col("page_id") * 2 + 1, "text": F.regexp_replace("text", r"(?i)(\d)\s*m\s*$", "$1 m2")}))
    tokens = pairing.read_tokens(both)
    arm = lambda df: df.withColumns({"arm": F.get(F.array(*map(F.lit, _ARMS)), (F.col("page_id") % 2).cast("int")), "plan": F.floor(F.col("page_id") / 2)})
    return reports.arm_statistics(arm(tokens), arm(pairing.rules_rooms(tokens)))


@query(
    "SELECT plan, approach, labels, CASE WHEN approach <> 'rules' THEN max(labels) FILTER (approach = 'rules') OVER (PARTITION BY plan) END AS baseline FROM ("
    "SELECT o_custkey AS plan, CASE WHEN o_orderkey % 3 = 0 THEN 'rules' ELSE 'vlm' END AS approach, max(o_orderkey % 9) AS labels FROM orders GROUP BY 1, 2)"
)
def q_baseline(spark, d):
    """The labels that the rules found on the same plan, beside those of each other approach."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("plan"), F.when(k % 3 == 0, "rules").otherwise("vlm").alias("approach")).agg(F.max(k % 9).alias("labels"))
    return reports.with_baseline(rows).select("plan", "approach", "labels", "baseline")


# -- annotations --------------------------------------------------------------------------------------------


def images_of(spark, d) -> DataFrame:
    o, k, c = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    w, h = k % 900 + 100, c % 700 + 100
    return o.select(k.alias("image_id"), F.when(k % 5 == 0, w * 2).otherwise(w).alias("w"), h.alias("h"), w.alias("original_w"), h.alias("original_h"), (w * 2).alias("scaled_w"), F.when(k % 2 == 0, h).otherwise(h * 2).alias("scaled_h"))


_IMAGES_SQL = (
    "images_of AS (SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 5 = 0 THEN 2 * (o_orderkey % 900 + 100) ELSE o_orderkey % 900 + 100 END AS w, o_custkey % 700 + 100 AS h, o_orderkey % 900 + 100 AS original_w, o_custkey % 700 + 100 AS original_h, "
    "2 * (o_orderkey % 900 + 100) AS scaled_w, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END * (o_custkey % 700 + 100) AS scaled_h FROM orders)"
)


@query(f"WITH {_IMAGES_SQL} SELECT CASE WHEN w = original_w AND h = original_h THEN 'original' WHEN w = scaled_w AND h = scaled_h THEN 'scaled' ELSE 'NONE' END AS match, count(*) AS n FROM images_of GROUP BY 1")
def q_size_match(spark, d):
    return annotations.size_match(images_of(spark, d))


@query(f"WITH {_IMAGES_SQL} SELECT image_id, scaled_w / original_w AS ratio_w, scaled_h / original_h AS ratio_h FROM images_of")
def q_size_ratios(spark, d):
    return annotations.size_ratios(images_of(spark, d)).select("image_id", "ratio_w", "ratio_h")


@query(s.tokens_sql("SELECT page_id, token_index, CAST(round(((x1 + 640 / 3.0::DOUBLE) % greatest(1, 640 - (x2 - x1))) * 1000) AS BIGINT) AS x, CAST(round(((y1 + 480 / 3.0::DOUBLE) % greatest(1, 480 - (y2 - y1))) * 1000) AS BIGINT) AS y FROM tokens"))
def q_control_box(spark, d):
    """Boxes moved by a third of a page of 640 by 480, in thousandths."""
    b = annotations.control_box(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(640), F.lit(480))
    milli = lambda c: F.round(F.col(f"b.{c}") * 1000).cast("long").alias(c)
    return token_view(spark, d).select("page_id", "token_index", b.alias("b")).select("page_id", "token_index", milli("x"), milli("y"))


@query(
    f"WITH {_IMAGES_SQL}, m AS (SELECT CASE WHEN w = original_w AND h = original_h THEN 'original' WHEN w = scaled_w AND h = scaled_h THEN 'scaled' ELSE 'NONE' END AS match, count(*) AS n FROM images_of GROUP BY 1), "
    "x AS (SELECT sum(o_orderkey % 10) / greatest(sum(o_orderkey % 3), 1e-9) AS wall, sum(o_custkey % 10) / greatest(sum(o_custkey % 4), 1e-9) AS edge FROM orders) "
    "SELECT CAST(round(wall * 1e6) AS BIGINT) AS wall_ppm, CAST(round(edge * 1e6) AS BIGINT) AS edge_ppm, (SELECT arg_max(match, n) FROM m) AS match, 0.995::DOUBLE AS inside, wall > 1.5 AND edge > 1.5 AS aligned FROM x"
)
def q_alignment_verdict(spark, d):
    """Whether annotations lie on what they describe, from their measures."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    measures = table(spark, d, "orders").select((k % 10).alias("real"), (k % 3).alias("control"), (c % 10).alias("edge"), (c % 4).alias("inside"))
    contained = spark.createDataFrame([(995, 1000)], "inside long, n long")
    v = annotations.verdict(measures, annotations.size_match(images_of(spark, d)), contained)
    ppm = lambda c: F.round(F.col(c) * 1e6).cast("long")
    return v.select(ppm("wall_ratio").alias("wall_ppm"), ppm("edge_ratio").alias("edge_ppm"), "match", "inside", "aligned")
