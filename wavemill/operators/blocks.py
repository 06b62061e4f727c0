"""Aggregates over blocks of a fixed number of frames, and what thins a stream out. Blocks shuffle by (stream_id, block), with partial sums before the shuffle, so a long stream is no bottleneck."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.operators.scalar import decibel


def block_of(size: int) -> Column:
    return F.floor(F.col("frame_no") / size).alias("block_no")


def bin_frames(rows: DataFrame, size: int, average: bool = False) -> DataFrame:
    """Sum, or mean truncated towards zero, of each `size` frames; an incomplete last block isn't given out. Long form; size 0 gives nothing."""
    if size <= 0:
        return rows.select("stream_id", F.col("frame_no").alias("block_no"), F.col("x").cast("long").alias("x")).limit(0)
    got = rows.groupBy("stream_id", block_of(size)).agg(F.sum("x").alias("s"), F.count("*").alias("n")).filter(F.col("n") == size)
    x = (F.col("s") / size).cast("long") if average else F.col("s")
    return got.select("stream_id", "block_no", x.alias("x"))


def bin_channels(frames: DataFrame, size: int, channels: int, average: bool = False, pairs: bool = False) -> DataFrame:
    """bin_frames() of every channel; with pairs, channel 1 is taken from 0, 3 from 2 and so on, before the mean is truncated. Size 0 gives nothing."""
    if size <= 0:
        return frames.select("stream_id", F.col("frame_no").alias("block_no"), F.col("samples").cast("array<bigint>").alias("samples")).limit(0)
    sums = [F.sum(F.get("samples", F.lit(k))).alias(f"c{k}") for k in range(channels)]
    got = frames.groupBy("stream_id", block_of(size)).agg(*sums, F.count("*").alias("n")).filter(F.col("n") == size)
    out = [F.col(f"c{k}") - F.col(f"c{k + 1}") for k in range(0, channels - 1, 2)] if pairs else [F.col(f"c{k}") for k in range(channels)]
    return got.select("stream_id", "block_no", F.array(*[(c / size).cast("long") if average else c for c in out]).alias("samples"))


def decimate(rows: DataFrame, factor: int) -> DataFrame:
    """Every factor-th frame, counted from the first, renumbered; factor 0 gives nothing."""
    if factor <= 0:
        return rows.limit(0)
    kept = rows.filter((F.col("frame_no") + 1) % factor == 0)
    return kept.withColumn("frame_no", F.floor(F.col("frame_no") / factor))


def timed(rows: DataFrame, rate: int, start_s: float, end_s: float) -> DataFrame:
    return rows.filter((F.col("frame_no") >= int(start_s * rate)) & (F.col("frame_no") < int(end_s * rate)))


def center(rows: DataFrame, size: int) -> DataFrame:
    """Samples less their block's truncated mean."""
    mean = rows.groupBy("stream_id", block_of(size)).agg((F.sum("x") / F.count("*")).cast("int").alias("mean"))
    return rows.withColumn("block_no", block_of(size)).join(mean, ["stream_id", "block_no"]).select("stream_id", "frame_no", (F.col("x") - F.col("mean")).alias("x"))


def volume_meter(rows: DataFrame, size: int, most: int = 32767) -> DataFrame:
    """Peak, mean magnitude and level of each block."""
    got = rows.groupBy("stream_id", block_of(size)).agg(F.max(F.abs("x")).alias("peak"), F.avg(F.abs(F.col("x"))).alias("mean"))
    return got.select("stream_id", "block_no", "peak", F.round("mean", 6).alias("mean"), F.round(decibel(F.col("peak") / most), 6).alias("db"))


def goertzel(rows: DataFrame, size: int, rate: int, frequencies: list[float], most: int = 32767) -> DataFrame:
    """Magnitude at each frequency of each complete block, as sums of x * cos and x * sin: no recursion and one shuffle for all frequencies."""
    k, v = F.pmod(F.col("frame_no"), F.lit(size)), F.col("x") / F.lit(float(most))
    sums = []
    for i, hz in enumerate(frequencies):
        angle = k * F.lit(2 * math.pi * hz / rate)
        sums += [F.sum(v * F.cos(angle)).alias(f"re{i}"), F.sum(v * F.sin(angle)).alias(f"im{i}")]
    got = rows.groupBy("stream_id", block_of(size)).agg(*sums, F.count("*").alias("n")).filter(F.col("n") == size)
    each = F.explode(F.array(*[F.struct(F.lit(float(hz)).alias("hz"), F.sqrt(F.col(f"re{i}") ** 2 + F.col(f"im{i}") ** 2).alias("m")) for i, hz in enumerate(frequencies)])).alias("e")
    return got.select("stream_id", "block_no", each).select("stream_id", "block_no", F.col("e.hz").alias("hz"), F.round("e.m", 6).alias("magnitude"))


def levels(rows: DataFrame, rate: int) -> DataFrame:
    """Of each stream: frames, seconds, mean (the DC offset), root mean square and peak. Partial sums precede the shuffle."""
    x = F.col("x").cast("double")
    got = rows.groupBy("stream_id").agg(F.count("*").alias("frames"), F.avg(x).alias("mean"), F.sqrt(F.avg(x * x)).alias("rms"), F.max(F.abs("x")).alias("peak"))
    return got.select("stream_id", "frames", F.round(F.col("frames") / rate, 6).alias("seconds"), F.round("mean", 4).alias("mean"), F.round("rms", 4).alias("rms"), "peak")
