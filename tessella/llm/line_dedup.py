"""Cross-site boilerplate lines by the spread of distinct sites.

Every line (trimmed, not blank) is known by a 128-bit hash. The sites of a line are sketched with HyperLogLog, and
sketches merge by aggregation. A line is boilerplate if it stands on at least ``MIN_SITES`` distinct sites. The
estimate decides alone only where it is far from that number; lines near it get an exact distinct count.

Boilerplate lines leave every document. A caller that looks for copies afterwards may name a share: texts of which
such lines make up more are then left whole, as copies of each other rather than pages with a notice on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import let, table

MIN_SITES = 10
#: Registers of a sketch, as a power of two, and how far (as a share) an estimate may err and still decide alone:
#: more than five standard errors, 1.04 / sqrt(2 ** LG_REGISTERS) each.
LG_REGISTERS, MARGIN = 10, 0.2
#: Parts that rows of one line are dealt to when they meet the list of boilerplate lines.
SALTS = 64


def line_keys(text: Column) -> Column:
    """One entry per line: the hashes of the trimmed line, null for blank lines. A null text is one blank line."""
    bare = lambda line: F.regexp_replace(line, r"^[\x20\t\r\x0B\f]+|[\x20\t\r\x0B\f]+$", "")
    key = lambda line: F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(7)).alias("b"))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: let(bare(x), lambda s: F.when(F.length(s) > 0, key(s))))


def salted(lines: DataFrame) -> DataFrame:
    """``lines`` (a, b), one row a line, repeated for each part that rows of one line are dealt to."""
    return lines.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(a, b) of every line that stands on at least ``min_sites`` distinct non-null sources.

    Each task reduces a line to one sketch before anything is shuffled, so a line that stands everywhere weighs no more
    than a rare one. For the exact counts only the rows of lines near the threshold are reduced to one a line and site.
    """
    part = F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int").alias("part")
    keys = docs.filter("source is not null").select("source", part, F.explode(F.array_compact(line_keys(F.col("text")))).alias("k"))
    keys = keys.select("k.a", "k.b", "source", "part")
    lines = keys.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", F.lit(LG_REGISTERS))).alias("sites"))
    sure = lines.filter(F.col("sites") > min_sites * (1 + MARGIN)).select("a", "b")
    near = lines.filter(F.col("sites").between(min_sites * (1 - MARGIN), min_sites * (1 + MARGIN))).select("a", "b")
    exact = keys.join(salted(near), ["a", "b", "part"], "left_semi").select("a", "b", "source").distinct().groupBy("a", "b").agg(F.count("*").alias("sites"))
    return sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("a", "b"))


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES, max_share: float | None = None) -> DataFrame:
    """All columns of ``docs`` with ``n_lines`` (not blank), ``n_boilerplate``, ``n_removed`` and ``kept``, the text left.

    Kept lines stay as they were, blank ones included, joined by line feeds. A null text counts as empty; a null source
    is no site. Repeated rows are one site's lines however often they come. Columns with the names of results are
    replaced, others pass through. Whether a line goes depends on all documents, never on their order. With
    ``max_share`` a text is left whole if boilerplate makes up more than that share of the characters of its lines.
    """
    docs = docs.drop("n_lines", "n_boilerplate", "n_removed", "kept")
    wide = boilerplate(docs, min_sites)
    # With the id, copies of one text are different keys and spread over the tasks.
    own = [F.col(c) for c in ("doc_id", "source", "text") if c in docs.columns]
    row = lambda salt: F.xxhash64(*own, F.lit(salt))
    found = docs.select(row(1).alias("_ld_1"), row(2).alias("_ld_2"), F.explode(F.array_distinct(F.array_compact(line_keys(F.col("text"))))).alias("k"))
    # Rows of a frequent line are dealt to SALTS parts.
    found = found.select("_ld_1", "_ld_2", "k.a", "k.b", F.pmod("_ld_1", F.lit(SALTS)).cast("int").alias("part"))
    hits = found.join(salted(wide), ["a", "b", "part"]).groupBy("_ld_1", "_ld_2").agg(F.collect_set(F.struct("a", "b")).alias("_ld_hits"))
    marked = docs.withColumns({"_ld_1": row(1), "_ld_2": row(2)}).join(hits, ["_ld_1", "_ld_2"], "left").drop("_ld_1", "_ld_2")

    text = F.coalesce(F.col("text"), F.lit(""))

    def judged(hits: Column) -> Column:
        lines = F.arrays_zip(line_keys(text).alias("key"), F.split(text, "\n", -1).alias("line"))

        def result(x: Column) -> Column:
            size = lambda of: F.aggregate(of, F.lit(0).cast("long"), lambda n, y: n + F.length(y["line"]))
            full = F.filter(x, lambda y: y["key"].isNotNull())
            gone = F.filter(full, lambda y: F.array_contains(hits, y["key"]))
            copy = F.lit(False) if max_share is None else size(gone) > max_share * size(full)
            stay = F.when(copy, x).otherwise(F.filter(x, lambda y: y["key"].isNull() | ~F.array_contains(hits, y["key"])))
            return F.struct(
                F.size(full).cast("long").alias("n_lines"),
                F.size(gone).cast("long").alias("n_boilerplate"),
                F.when(copy, 0).otherwise(F.size(gone)).cast("long").alias("n_removed"),
                F.array_join(F.transform(stay, lambda y: y["line"]), "\n").alias("kept"),
            )

        return let(lines, result)

    none = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return marked.withColumn("_ld", judged(F.coalesce("_ld_hits", none))).select(*docs.columns, "_ld.*")


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    got = cleaned(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return got.select("doc_id", "n_lines", "n_boilerplate", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare FROM lines),
wide AS (SELECT bare FROM bare WHERE bare <> '' AND source IS NOT NULL GROUP BY bare HAVING count(DISTINCT source) >= {MIN_SITES}),
marked AS (SELECT b.*, w.bare IS NOT NULL AS hit FROM bare b LEFT JOIN wide w ON b.bare = w.bare)
SELECT doc_id, count(*) FILTER (bare <> '') AS n_lines, count(*) FILTER (hit) AS n_boilerplate, count(*) FILTER (hit) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT hit), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
