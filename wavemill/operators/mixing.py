"""Positional joins of streams, generators over the frame index, and resampling helpers."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(inputs: list[tuple[DataFrame, float]]) -> DataFrame:
    """Streams side by side as channels, each sample times its input's weight; as long as the shortest."""
    parts = [df.select("stream_id", "frame_no", (F.col("x") * F.lit(float(w))).cast("int").alias(f"x{k}")) for k, (df, w) in enumerate(inputs)]
    joined = reduce(lambda a, b: a.join(b, ["stream_id", "frame_no"]), parts)
    return joined.select("stream_id", "frame_no", F.array(*[f"x{k}" for k in range(len(parts))]).alias("samples"))


def mix(inputs: list[tuple[DataFrame, float]]) -> DataFrame:
    """Sum of the samples, each times its input's part of all weights and truncated; a missing sample is 0. A union and one aggregation, whose partial sums precede the shuffle."""
    total = sum(w for _, w in inputs)
    parts = [df.select("stream_id", "frame_no", (F.col("x") * F.lit(w / total)).cast("int").alias("x")) for df, w in inputs]
    return reduce(DataFrame.unionByName, parts).groupBy("stream_id", "frame_no").agg(F.sum("x").alias("x"))


def mix_common(inputs: list[tuple[DataFrame, float]]) -> DataFrame:
    """mix() of the frames that every input has: what an output that waits for all its inputs gives, as long as the shortest."""
    total = sum(w for _, w in inputs)
    parts = [df.select("stream_id", "frame_no", (F.col("x") * F.lit(w / total)).cast("int").alias("x")) for df, w in inputs]
    summed = reduce(DataFrame.unionByName, parts).groupBy("stream_id", "frame_no").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return summed.filter(F.col("n") == len(inputs)).drop("n")


def average(inputs: list[DataFrame]) -> DataFrame:
    """The truncated mean over the inputs that have the frame."""
    rows = reduce(DataFrame.unionByName, [df.select("stream_id", "frame_no", "x") for df in inputs])
    return rows.groupBy("stream_id", "frame_no").agg((F.sum("x") / F.count("*")).cast("int").alias("x"))


def concatenate(inputs: list[DataFrame]) -> DataFrame:
    """One after another in each stream: frame numbers go on where the one before ended. Only lengths meet in a window."""
    rows = reduce(DataFrame.unionByName, [df.select("stream_id", "frame_no", "x").withColumn("part", F.lit(k)) for k, df in enumerate(inputs)])
    size = rows.groupBy("stream_id", "part").agg((F.max("frame_no") + 1).alias("n"))
    order = Window.partitionBy("stream_id").orderBy("part")
    base = size.select("stream_id", "part", (F.sum("n").over(order) - F.col("n")).alias("base"))
    return rows.join(base, ["stream_id", "part"]).select("stream_id", (F.col("frame_no") + F.col("base")).alias("frame_no"), "x")


#: Rates that common converters take, in Hz (fixed values).
RATES = (8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000, 88200, 96000, 176400, 192000)


def closest_rate(rate: Column, rates: tuple[int, ...] = RATES) -> Column:
    """The supported rate nearest to rate; of two equally near ones the first."""
    return F.array_min(F.transform(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("r")) for k, r in enumerate(rates)]), lambda p: F.struct(F.abs(p["r"] - rate).alias("d"), p["k"].alias("k"), p["r"].alias("r"))))["r"]


def generated(lengths: DataFrame, make: Callable[[Column], Column], part: int = 1 << 16) -> DataFrame:
    """(stream_id, frame_no, x): of lengths (stream_id, n) n frames each, x = make(frame_no). Long streams are made in parts, dealt over all tasks."""
    parts = lengths.filter("n > 0").select("stream_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(part).cast("long"))).alias("first"))
    frames = parts.select("stream_id", F.explode(F.sequence("first", F.least(F.col("first") + part, F.col("n")) - 1)).alias("frame_no"))
    return frames.select("stream_id", "frame_no", make(F.col("frame_no")).alias("x"))


def sine(frame_no: Column, hz: float, rate: float, amplitude: float, phase: float = 0.0) -> Column:
    return (F.lit(float(amplitude)) * F.sin(frame_no * F.lit(2 * math.pi * hz / rate) + phase)).cast("int")


def fast_sine(frame_no: Column, hz: float, rate: float, amplitude: float, phase: float = 0.0) -> Column:
    """A sine by a polynomial of fifth degree in the place within the period; its coefficients are fixed values. phase is in periods."""
    t = frame_no * F.lit(hz / rate) + phase
    p = t - F.floor(t) - 0.5
    pp = p * p
    return (F.lit(float(amplitude)) * (p - 6.283211 * pp * p + 9.132843 * pp * pp * p) * -6.221086).cast("int")


def int_sine(frame_no: Column, hz: float, rate: float, amplitude: int) -> Column:
    """A sine in 256 steps a period and 1/32768 of the amplitude, by a 32-bit phase."""
    step = F.floor(_phase(frame_no, hz, rate) / 2**24)
    return F.shiftright(F.round(F.lit(32767) * F.sin(step * F.lit(2 * math.pi / 256))).cast("long") * amplitude, 15).cast("int")


def _phase(frame_no: Column, hz: float, rate: float) -> Column:
    """32-bit phase of an oscillator."""
    return F.pmod(frame_no * F.lit(int(hz / rate * 2**32)), F.lit(2**32))


def square(frame_no: Column, hz: float, rate: float, amplitude: int) -> Column:
    return F.when(_phase(frame_no, hz, rate) < 2**31, amplitude).otherwise(-amplitude)


def saw(frame_no: Column, hz: float, rate: float, amplitude: int) -> Column:
    p = _phase(frame_no, hz, rate)
    return F.shiftright(F.when(p < 2**31, p).otherwise(p - 2**32) * amplitude, 31).cast("int")


def from_array(frame_no: Column, samples: list[int]) -> Column:
    return F.get(F.array(*map(F.lit, samples)), F.pmod(frame_no, F.lit(len(samples))).cast("int"))


def lms(rows: DataFrame, taps: int, mu: float) -> DataFrame:
    """Echo cancelling: rows have x (microphone) and ref; y = x less the echo that an adaptive filter of `taps` weights predicts from ref. Walked batch by batch with one state a stream."""
    import pyarrow as pa

    ordered = rows.select("stream_id", "frame_no", "x", "ref").repartition("stream_id").sortWithinPartitions("stream_id", "frame_no")

    def run(batches):
        at, w, past = None, None, None
        for b in batches:
            out = []
            for stream, x, ref in zip(*(b.column(c).to_pylist() for c in ("stream_id", "x", "ref")), strict=True):
                if stream != at or w is None:
                    at, w, past = stream, [0.0] * taps, [0.0] * taps
                past = [ref, *past[:-1]]
                e = x - sum(p * q for p, q in zip(w, past, strict=True))
                w = [p + mu * e * q for p, q in zip(w, past, strict=True)]
                out.append(float(e))
            yield pa.RecordBatch.from_arrays([b.column("stream_id"), b.column("frame_no"), pa.array(out)], ["stream_id", "frame_no", "y"])

    kind = dict(rows.dtypes)
    return ordered.mapInArrow(run, f"stream_id {kind['stream_id']}, frame_no {kind['frame_no']}, y double")
