"""A corpus pipeline: language, boilerplate lines, near-duplicates, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bpe import encoded
from tessella.llm.common import table, use_checkpoints
from tessella.llm.decontaminate import contaminated
from tessella.llm.jaccard_join import classified, keyed
from tessella.llm.language_id import fit, identified
from tessella.llm.line_dedup import cleaned

#: A document goes if the best language contains less than this share of its letter grams.
MIN_COVERAGE = 0.2
#: Shorter texts, in characters, are not judged by their grams.
JUDGED = 8
#: A text stays whole if boilerplate lines are more than this share of it: it is a copy of other texts, and the next
#: stage, which keeps one of them, has to see it whole.
COPY_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns the languages from all labelled documents; those without letters or in no learned language go.

    A text of fewer than JUDGED characters has too few grams to be judged and stays if it has letters. Without any labelled
    document nothing is learned and all stay.
    """
    filters = fit(docs)
    if not filters.languages:
        return docs
    judged = identified(docs, filters)
    good = (F.col("coverage") >= MIN_COVERAGE) | (F.length("text") < JUDGED)
    return judged.filter((F.col("lang_pred") != "und") & good).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out of the texts; every document stays, and copies (see COPY_SHARE) stay whole."""
    text = F.when(F.col("text").isNotNull(), F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))}
    return cleaned(docs, max_share=COPY_SHARE).withColumns(changed).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each class; of repeated rows one. Rows without a doc_id stay.

    Rows that share a doc_id are different documents if they are of different classes, or differ and have no words.
    """
    own = classified(docs).filter("doc_id = class_id").groupBy("doc_id", "root").agg(F.min(F.struct("k1", "k2")).alias("node"), F.count("*").alias("n"))
    first = own.select(F.col("doc_id").alias("_id"), "node", "n")
    rows = keyed(docs.filter("doc_id is not null"))
    same = F.col("_k1").eqNullSafe(F.col("node.k1")) & F.col("_k2").eqNullSafe(F.col("node.k2"))
    kept = rows.join(first, (F.col("doc_id") == F.col("_id")) & same, "left_semi")
    if first.filter("n > 1").limit(1).count():
        kept = kept.withColumn("_text", F.when(F.col("_k1").isNull(), F.coalesce("text", F.lit("")))).dropDuplicates(["doc_id", "_k1", "_k2", "_text"])
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return contaminated(docs, table(spark, sf_dir, "benchmark")).filter(F.size("hits") == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left."""
    return encoded(docs).select("doc_id", "source", "lang", "n_chars", "n_tokens", "ids", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

#: The tokens of the last stage have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each result is written to the shared folder and read again."""
    use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
