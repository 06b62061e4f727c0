"""Signal views of tables: ordered integer samples by stream.

Long form: stream_id, frame_no, x. Frame form: stream_id, frame_no, samples (an integer for each channel).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Total order of lineitem rows inside an order.
LINE_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream a user: cents of `value` in the order of (ts, event_id)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = F.round(F.col("value") * 100).cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_no"), x.alias("x"))


def events_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one stream, numbered by event_id: for operators that need no neighbours, so nothing is shuffled."""
    return table(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("stream_id"), F.col("event_id").alias("frame_no"), F.round(F.col("value") * 100).cast("int").alias("x"))


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream an order, with four channels: quantity, price, discount and tax in hundredths."""
    order = Window.partitionBy("l_orderkey").orderBy(*LINE_KEY)
    samples = F.array(*[F.round(F.col(c) * 100).cast("int") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stream_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_no"), samples.alias("samples"))


def embedding_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block a vector: block_no, samples array<double>."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("block_no"), F.col("embedding").cast("array<double>").alias("samples"))
