"""A table of page tokens derived from ``lineitem``, with every kind of token text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Token texts, dealt to rows by key; the order is part of the definition.
VOCABULARY = [
    "MH", "11.7", "9X21", "OH", "22,6 m2", "KHH", "10.8", "WC", "1.5", "3500 x 4200", "19940", "ET", "6.1", "+46.290",
    "VH 3.6", "KEITTLO", "24", "1:100", "PSH", "3,3 m^{2}$", "A-101", "IZX6", "H7", "3H+KT+S", "MH1", "KEITTIÖ",
    "OLESKELU+RUOK", "12'6\" x 10'", "1990", "4H K KH WC 90 M2", "350cm x 420cm", "640 m²", "K 2", "TrOHUONE", "0,4 m²",
    "3.5 x 4.2", "ZZQ 11.7", "17.6m", "  S  ", "50 x 60",
]
TOKENS_PER_PAGE_ORDERS = 40


def token_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, token_index, text, confidence, angle, x1, y1, x2, y2); tokens of a page are numbered from 0."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    page = F.floor(F.col("l_orderkey") / TOKENS_PER_PAGE_ORDERS).cast("long")
    order = Window.partitionBy("page_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    text = F.element_at(F.array(*map(F.lit, VOCABULARY)), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % len(VOCABULARY) + 1).cast("int"))
    x1 = ((F.col("l_suppkey") * 37 + F.col("l_partkey")) % 600).cast("int")
    y1 = ((F.col("l_orderkey") * 13 + F.col("l_linenumber") * 101) % 400).cast("int")
    return li.withColumn("page_id", page).select(
        "page_id",
        (F.row_number().over(order) - 1).alias("token_index"),
        text.alias("text"),
        F.round(0.5 + F.col("l_discount") * 5, 4).alias("confidence"),
        (F.col("l_linenumber") % 4 * 90).cast("int").alias("angle"),
        x1.alias("x1"),
        y1.alias("y1"),
        (x1 + 20 + F.col("l_quantity")).cast("int").alias("x2"),
        (y1 + 15 + F.col("l_linenumber") * 5).cast("int").alias("y2"),
    )
