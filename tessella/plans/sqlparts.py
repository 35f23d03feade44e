"""SQL text of the shared steps, for the DuckDB oracles: each function gives common table expressions."""

from __future__ import annotations

from tessella.functions import parse as p
from tessella.functions.lexicon import BY_LENGTH, ROOM_TYPES
from tessella.sources.token_view import TOKENS_PER_PAGE_ORDERS, VOCABULARY


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LEX = "lex(label, room_type, ord) AS (VALUES " + ", ".join(f"({lit(k)}, {lit(ROOM_TYPES[k])}, {i})" for i, k in enumerate(BY_LENGTH)) + ")"

TOKENS = f"""
raw_tokens AS (
  SELECT CAST(floor(l_orderkey / {TOKENS_PER_PAGE_ORDERS}.0) AS BIGINT) AS page_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
         list_extract([{', '.join(map(lit, VOCABULARY))}], CAST((l_partkey * 7 + l_linenumber) % {len(VOCABULARY)} + 1 AS INTEGER)) AS text,
         round(0.5 + l_discount * 5, 4) AS confidence, CAST(l_linenumber % 4 * 90 AS INTEGER) AS angle,
         CAST((l_suppkey * 37 + l_partkey) % 600 AS INTEGER) AS x1, CAST((l_orderkey * 13 + l_linenumber * 101) % 400 AS INTEGER) AS y1
  FROM lineitem),
tokens AS (
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS INTEGER) AS token_index,
         text, confidence, angle, x1, y1, CAST(x1 + 20 + l_quantity AS INTEGER) AS x2, CAST(y1 + 15 + l_linenumber * 5 AS INTEGER) AS y2
  FROM raw_tokens)"""


def normal(expr: str) -> str:
    return f"regexp_replace(strip_accents(upper(replace(replace({expr}, '&amp;', '&'), 'ß', 'ss'))), '[^A-Z0-9+]', '', 'g')"


def clean(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


REPAIR = p.DAMAGED_UNIT.replace(r"(?=[\^{}])", r"[\^{}]")


def repaired(expr: str) -> str:
    return clean(f"regexp_replace(replace({expr}, '$', ''), {lit(REPAIR)}, 'm2', 'g')")


def resolved(name: str, source: str) -> str:
    """CTE ``name``(norm, resolved, ptype) of the distinct normalised labels in ``source``(norm)."""
    return f"""
{name}_b AS (SELECT norm, CASE WHEN regexp_matches(norm, '^[A-Z]{{2,}}[0-9]{{1,2}}$') THEN regexp_extract(norm, '^([A-Z]{{2,}})', 1) END AS base FROM (SELECT DISTINCT norm FROM {source} WHERE norm IS NOT NULL)),
{name}_f AS (SELECT norm, arg_min(label, ord) AS label FROM {name}_b, lex WHERE length(norm) >= 5 AND length(label) >= 5 AND abs(length(norm) - length(label)) <= 1 AND levenshtein(norm, label) <= 1 GROUP BY norm),
{name}_c AS (SELECT norm, arg_min(room_type, pos) AS room_type FROM (
   SELECT b.norm, l.room_type, b.pos FROM (SELECT norm, unnest(string_split(norm, '+')) AS part, unnest(range(len(string_split(norm, '+')))) AS pos FROM {name}_b) b JOIN lex l ON l.label = b.part) GROUP BY norm),
{name} AS (
  SELECT b.norm, coalesce(e.label, i.label, f.label) AS resolved,
         CASE WHEN contains(b.norm, '+') THEN coalesce(c.room_type, 'unknown') ELSE coalesce(e.room_type, i.room_type, r.room_type, 'unknown') END AS ptype
  FROM {name}_b b LEFT JOIN lex e ON e.label = b.norm LEFT JOIN lex i ON i.label = b.base
  LEFT JOIN {name}_f f ON f.norm = b.norm LEFT JOIN lex r ON r.label = f.label LEFT JOIN {name}_c c ON c.norm = b.norm)"""


_SIZE = "CASE k.kind WHEN 'area' THEN v WHEN 'dimension_pair' THEN (a / scale) * (b / scale) END"
_LIKELY = f"coalesce({_SIZE} BETWEEN {p.LEAST_AREA} AND {p.MOST_AREA}, true)"


def filled(template: str, *values: str) -> str:
    """A fixed text with SQL values in place of its %s."""
    first, *rest = template.split("%s")
    return " || ".join([lit(first), *(f"{v} || {lit(x)}" for v, x in zip(values, rest, strict=True))])


def quoted(e: str) -> str:
    return f"CASE WHEN contains({e}, chr(39)) THEN chr(34) || {e} || chr(34) ELSE chr(39) || {e} || chr(39) END"


REASON = (
    f"CASE WHEN k.raw = '' THEN {lit(p.REASONS['empty'])} WHEN k.kind = 'area' THEN CASE WHEN CASE rule WHEN 'label_area' THEN regexp_matches(t, {lit(p.AREA_UNIT)}) ELSE k.fmt = 'area_unit' END "
    f"THEN {lit(p.REASONS['explicit'])} ELSE {lit(p.REASONS['bare'])} END || CASE WHEN {_LIKELY} THEN '' ELSE {lit(p.REASONS['implausible'])} END "
    f"WHEN k.fmt = 'label_area' THEN {filled(p.REASONS['unknown_label'], 'k.named')} WHEN k.fmt = 'imperial_pair' AND (a <= 0 OR b <= 0) THEN {lit(p.REASONS['imperial_zero'])} "
    f"WHEN k.fmt = 'pair' AND (a <= 0 OR b <= 0) THEN {lit(p.REASONS['pair_zero'])} WHEN k.fmt = 'pair' THEN " + filled(p.REASONS["pair"], "format('{:g}', a)", "format('{:g}', b)") + " "
    f"WHEN k.fmt = 'bare_integer' THEN CASE WHEN regexp_matches(t, {lit(p.YEAR)}) THEN {lit(p.REASONS['year'])} ELSE " + filled(p.REASONS["bare_integer"], "format('{:g}', v)") + " END "
    + " ".join(f"WHEN k.fmt = {lit(x)} THEN {lit(why)}" for x, why in p.REASONS.items() if x in ("scale", "elevation", "apartment_summary", "sheet_number", "imperial_pair", "mm_pair_explicit", "cm_pair", "m_pair_explicit", "m_pair_decimal", "door_window_code", "mm_pair", "label_only"))
    + f" ELSE {lit(p.REASONS['nothing'])} END"
)
WARNINGS = (
    f"list_filter([CASE WHEN k.kind = 'area' AND NOT {_LIKELY} THEN " + filled(p.AREA_RANGE, "format('{:g}', " + _SIZE + ")", f"CASE WHEN {_SIZE} < {p.LEAST_AREA} THEN 'below' ELSE 'above' END") + " END, "
    f"CASE WHEN k.kind = 'dimension_pair' AND NOT {_LIKELY} THEN " + filled(p.IMPLIED, "format('{:.3g}', " + _SIZE + ")") + " END, "
    f"CASE WHEN k.t <> k.raw THEN " + filled(p.REPAIRED, quoted("k.raw"), quoted("k.t")) + " END], lambda w: w IS NOT NULL)"
)


def parsed(source: str = "tokens") -> str:
    """CTE ``parsed``: one row per distinct text of ``source``, with the reading of it."""
    m = lambda pattern: f"regexp_matches(t, {lit(pattern)})"
    g = lambda pattern, k: f"regexp_extract(t, {lit(pattern)}, {k})"
    num = lambda e: f"TRY_CAST(replace(nullif({e}, ''), ',', '.') AS DOUBLE)"
    dec = lambda e: f"regexp_matches({e}, '[.,]')"
    feet = lambda f, i: f"({num(g(p.IMPERIAL, f))} * 12 + coalesce({num(g(p.IMPERIAL, i))}, 0)) * 0.0254"
    weak = ", ".join(map(lit, p.WEAK))
    return f"""
p_raw AS (SELECT text, {clean('text')} AS raw FROM (SELECT DISTINCT text FROM {source})),
p_fix AS (SELECT *, CASE WHEN {repaired('raw')} = '' THEN raw ELSE {repaired('raw')} END AS t FROM p_raw),
p_norm AS (SELECT *, {normal('t')} AS norm, {normal('text')} AS text_norm, CASE WHEN {m(p.LABEL_AREA)} THEN {normal(g(p.LABEL_AREA, 1))} END AS named FROM p_fix),
p_all AS (SELECT norm FROM p_norm UNION SELECT named FROM p_norm UNION SELECT text_norm FROM p_norm),
{resolved('p_res', 'p_all')},
p_rule AS (
  SELECT n.*, o.resolved AS own, o.ptype AS own_type, l.resolved AS named_resolved, l.ptype AS named_type,
    CASE WHEN {m(p.SCALE)} THEN 'scale' WHEN {m(p.ELEVATION)} THEN 'elevation' WHEN {m(p.SUMMARY)} THEN 'apartment_summary'
         WHEN {m(p.SHEET)} AND o.resolved IS NULL THEN 'sheet_number' WHEN {m(p.IMPERIAL)} THEN 'imperial' WHEN {m(p.PAIR)} THEN 'pair'
         WHEN {m(p.LABEL_AREA)} THEN 'label_area' WHEN {m(p.AREA)} THEN 'area' WHEN o.resolved IS NOT NULL THEN 'label_only' ELSE '' END AS rule
  FROM p_norm n LEFT JOIN p_res o ON o.norm = n.norm LEFT JOIN p_res l ON l.norm = n.named),
p_val AS (
  SELECT *, CASE rule WHEN 'imperial' THEN {feet(1, 2)} WHEN 'pair' THEN {num(g(p.PAIR, 1))} END AS a,
    CASE rule WHEN 'imperial' THEN {feet(3, 4)} WHEN 'pair' THEN {num(g(p.PAIR, 2))} END AS b,
    CASE rule WHEN 'label_area' THEN {g(p.LABEL_AREA, 2)} WHEN 'area' THEN {g(p.AREA, 1)} END AS digits FROM p_rule),
p_fmt AS (
  SELECT *, {num('digits')} AS v,
    CASE rule WHEN 'imperial' THEN 'imperial_pair'
      WHEN 'pair' THEN CASE WHEN a <= 0 OR b <= 0 THEN 'pair' WHEN {g(p.PAIR, 3)} = 'mm' THEN 'mm_pair_explicit' WHEN {g(p.PAIR, 3)} = 'cm' THEN 'cm_pair'
        WHEN {g(p.PAIR, 3)} = 'm' THEN 'm_pair_explicit' WHEN {dec(g(p.PAIR, 1))} OR {dec(g(p.PAIR, 2))} THEN 'm_pair_decimal'
        WHEN a <= {p.MOST_DOOR} AND b <= {p.MOST_DOOR} THEN 'door_window_code' WHEN a >= {p.LEAST_MM} AND b >= {p.LEAST_MM} THEN 'mm_pair' ELSE 'pair' END
      WHEN 'label_area' THEN CASE WHEN named_resolved IS NULL OR {m(p.AREA_UNIT)} OR {dec('digits')} THEN 'label_area' ELSE 'label_area_integer' END
      WHEN 'area' THEN CASE WHEN {g(p.AREA, 2)} <> '' THEN 'area_unit' WHEN {m(p.YEAR)} OR (NOT {dec('digits')} AND {num('digits')} > {p.MOST_AREA}) THEN 'bare_integer'
        WHEN NOT {dec('digits')} THEN 'area_bare_integer' ELSE 'area_bare' END
      ELSE rule END AS fmt FROM p_val),
p_kind AS (
  SELECT *, CASE WHEN fmt IN ('imperial_pair', 'mm_pair_explicit', 'cm_pair', 'm_pair_explicit', 'm_pair_decimal', 'mm_pair') AND a > 0 AND b > 0 THEN 'dimension_pair'
      WHEN fmt IN ('area_unit', 'area_bare', {weak}) OR (fmt = 'label_area' AND named_resolved IS NOT NULL) THEN 'area'
      WHEN fmt = 'door_window_code' THEN 'door_window_code' ELSE 'unknown' END AS kind,
    CASE WHEN fmt IN ('mm_pair', 'mm_pair_explicit') THEN 1000.0 WHEN fmt = 'cm_pair' THEN 100.0 WHEN fmt = 'door_window_code' THEN 10.0 ELSE 1.0 END AS scale FROM p_fmt),
parsed AS (
  SELECT k.text, k.raw, k.t, k.t <> k.raw AS repaired, k.kind, k.fmt, k.norm, k.text_norm, q.resolved,
    round(CASE k.kind WHEN 'area' THEN v WHEN 'dimension_pair' THEN (a / scale) * (b / scale) END, 3) AS area_m2,
    CASE WHEN k.kind IN ('dimension_pair', 'door_window_code') THEN round(a / scale, 3) END AS width_m,
    CASE WHEN k.kind IN ('dimension_pair', 'door_window_code') THEN round(b / scale, 3) END AS length_m,
    CASE WHEN k.kind = 'area' AND k.rule = 'label_area' THEN {g(p.LABEL_AREA, 1)} WHEN k.fmt = 'label_only' THEN k.t END AS label,
    CASE WHEN k.kind = 'area' AND k.rule = 'label_area' THEN named_type WHEN k.fmt = 'label_only' THEN own_type END AS room_type,
    coalesce(CASE k.kind WHEN 'area' THEN v WHEN 'dimension_pair' THEN (a / scale) * (b / scale) END BETWEEN {p.LEAST_AREA} AND {p.MOST_AREA}, true) AS plausible,
    {REASON} AS reason, {WARNINGS} AS warnings, k.fmt IN ({weak}) AS weak, regexp_matches(k.text, {lit(p.APARTMENT_CODE)}) AS is_code
  FROM p_kind k LEFT JOIN p_res q ON q.norm = k.text_norm)"""


OVERLAP = "a.x2 >= b.x1 AND b.x2 >= a.x1 AND a.y2 >= b.y1 AND b.y2 >= a.y1"

READ = """
read AS (
  SELECT k.page_id, k.token_index, k.confidence, k.angle, k.x1, k.y1, k.x2, k.y2, p.*,
         bool_or(p.kind = 'area' AND p.plausible AND NOT p.weak) OVER (PARTITION BY k.page_id) AS corroborated
  FROM tokens k JOIN parsed p ON p.text = k.text)"""

KEY = "CAST(25 AS BIGINT) * (a.x1 + a.x2 - b.x1 - b.x2) * (a.x1 + a.x2 - b.x1 - b.x2) + 9 * (a.y1 + a.y2 - b.y1 - b.y2) * (a.y1 + a.y2 - b.y1 - b.y2)"
HEIGHT = "greatest(least(a.x2 - a.x1, a.y2 - a.y1), 1)"

PAIRS = f"""
trusted AS (
  SELECT * FROM read a WHERE kind = 'area' AND plausible AND (corroborated OR NOT weak)
  AND NOT EXISTS (SELECT 1 FROM read b WHERE b.is_code AND b.page_id = a.page_id AND {OVERLAP})),
combined AS (SELECT * FROM trusted WHERE label IS NOT NULL),
near_all AS (
  SELECT a.page_id, a.token_index AS label_id, a.text, b.token_index AS area_id, b.area_m2, least(a.confidence, b.confidence) AS confidence, {KEY} AS key
  FROM read a JOIN trusted b ON a.page_id = b.page_id AND a.token_index <> b.token_index
  WHERE b.label IS NULL AND (a.resolved IS NOT NULL OR a.label IS NOT NULL) AND {KEY} <= CAST(3600 AS BIGINT) * {HEIGHT} * {HEIGHT}
  AND NOT EXISTS (SELECT 1 FROM combined c WHERE c.page_id = a.page_id AND c.token_index = a.token_index)),
nearest AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY page_id, label_id ORDER BY key, area_id) AS place FROM near_all) WHERE place = 1),
contended AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY page_id, area_id ORDER BY floor(sqrt(key) + 0.5), label_id) AS place FROM nearest) WHERE place = 1),
pairs AS (
  SELECT page_id, token_index AS label_id, token_index AS area_id, label AS label_text, area_m2, CAST(0 AS BIGINT) AS key, confidence, true AS combined FROM combined
  UNION ALL SELECT page_id, label_id, area_id, text, area_m2, key, confidence, false FROM contended)"""

ROOMS = f"""
room_rows AS (
  SELECT page_id, label_id, label_text AS label_raw, area_m2, CASE WHEN label_id = area_id THEN [label_id] ELSE [least(label_id, area_id), greatest(label_id, area_id)] END AS source_token_ids, confidence FROM pairs
  UNION ALL SELECT r.page_id, r.token_index, r.text, NULL, [r.token_index], r.confidence FROM read r
  WHERE r.resolved IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.page_id = r.page_id AND p.label_id = r.token_index)),
room_norm AS (SELECT *, {normal('label_raw')} AS norm FROM room_rows),
{resolved('room_res', 'room_norm')},
rooms AS (
  SELECT r.page_id, r.label_id, r.label_raw, CASE WHEN q.ptype IN (SELECT room_type FROM lex) THEN q.ptype ELSE 'other' END AS room_type, r.area_m2, r.source_token_ids, round(r.confidence, 4) AS confidence
  FROM room_norm r LEFT JOIN room_res q ON q.norm = r.norm)"""


def tokens_sql(select: str) -> str:
    return f"WITH {TOKENS} {select}"


def parsed_sql(select: str) -> str:
    return f"WITH {LEX}, {TOKENS}, {parsed()} {select}"


def pairs_sql(select: str) -> str:
    return f"WITH {LEX}, {TOKENS}, {parsed()}, {READ}, {PAIRS} {select}"


def rooms_sql(select: str, more: str = "") -> str:
    return f"WITH {LEX}, {TOKENS}, {parsed()}, {READ}, {PAIRS}, {ROOMS}{', ' + more if more else ''} {select}"
