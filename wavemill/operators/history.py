"""Filters of finite history: window frames over blocks of a stream's frames, with the frames they look back on copied to the blocks' edges."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wavemill.operators.channels import convert_channels
from wavemill.operators.scalar import convert_bits


#: Frames of a block: a stream of more is cut, so that no task holds or sorts a stream as a whole.
BLOCK = 1 << 16


def stream() -> WindowSpec:
    """A stream's frames in order."""
    return Window.partitionBy("stream_id").orderBy("frame_no")


def piece() -> WindowSpec:
    """The frames of a block of in_blocks() in order, with those copied to its edges."""
    return Window.partitionBy("stream_id", "__block").orderBy("frame_no")


def in_blocks(rows: DataFrame, back: int, ahead: int = 0, block: int | None = None) -> DataFrame:
    """rows by blocks of frame_no (`__block`); the `back` frames before a block and the `ahead` frames after it are copied to it (`__own` is false for these). own() takes them away again. What looks no further than that gives the same in piece() as in stream(), over as many tasks as there are blocks."""
    block = block or BLOCK
    at = lambda k: F.floor((F.col("frame_no") + k) / block)
    first, last = F.greatest(at(-ahead), F.lit(0)), at(back)
    placed = rows.withColumn("__block", F.explode(F.when(first == last, F.array(first)).otherwise(F.sequence(first, last))))
    return placed.withColumn("__own", F.col("__block") == at(0))


def own(rows: DataFrame) -> DataFrame:
    return rows.filter("__own").drop("__block", "__own")


def moving_average(rows: DataFrame, n: int) -> DataFrame:
    return own(in_blocks(rows, n - 1).withColumn("y", F.avg("x").over(piece().rowsBetween(-(n - 1), 0))))


def fir(rows: DataFrame, taps: list[float]) -> DataFrame:
    """y[i] = sum of taps[k] * x[i - k]; frames before the first are 0."""
    terms = [F.coalesce(F.lag("x", k).over(piece()) if k else F.col("x"), F.lit(0)) * F.lit(float(b)) for k, b in enumerate(taps)]
    return own(in_blocks(rows, len(taps) - 1).withColumn("y", reduce(lambda a, b: a + b, terms)))


def median(rows: DataFrame, n: int = 7) -> DataFrame:
    """Of the last n frames, those before the first being 0."""
    held = F.array(*[F.coalesce(F.lag("x", k).over(piece()) if k else F.col("x"), F.lit(0)) for k in range(n)])
    return own(in_blocks(rows, n - 1).withColumn("y", F.get(F.array_sort(held), F.lit(n // 2))))


def remove_silence(rows: DataFrame, n: int = 8, limit: int = 2) -> DataFrame:
    """Only frames of which one of the last n exceeds the limit; the kept ones are renumbered."""
    loud = F.max(F.when(F.abs("x") > limit, 1).otherwise(0)).over(stream().rowsBetween(-(n - 1), 0))
    kept = rows.withColumn("loud", loud).filter("loud = 1").drop("loud")
    return kept.withColumn("frame_no", F.row_number().over(stream()) - 1)


def zero_crossings(rows: DataFrame, rate: int) -> DataFrame:
    """Frequencies between rising crossings (a frame of at most 0 before a positive one)."""
    up = rows.withColumn("next", F.lead("x").over(stream())).filter("x <= 0 and next > 0")
    return up.withColumn("frames", F.col("frame_no") - F.lag("frame_no").over(stream())).filter("frames is not null").select("stream_id", "frame_no", (rate / F.col("frames")).alias("hz"))


def quality(rows: DataFrame, most: int = 32767, click: float = 0.5, quiet: float = 0.01, loud: float = 0.99, dropout: int = 10, clipping: int = 3) -> DataFrame:
    """Per stream: frames, clicks (jumps of more than click * most), dropouts and clippings (runs of quiet or loud frames).

    A run counts at the frame that makes it long enough: its last frames are all hits and the one before them, if any, is none. So
    nothing looks further back than a run's length, and one window and one aggregation do.
    """
    jump = F.abs(F.col("x") - F.lag("x").over(piece())) > click * most

    def reached(hit: Column, n: int) -> Column:
        flag = F.when(hit, 1).otherwise(0)
        return (F.sum(flag).over(piece().rowsBetween(1 - n, 0)) == n) & (F.coalesce(F.lag(flag, n).over(piece()), F.lit(0)) == 0)

    seen = in_blocks(rows.select("stream_id", "frame_no", "x"), max(dropout, clipping, 1))
    size = F.abs("x")
    flags = own(seen.select("stream_id", "__block", "__own", jump.alias("jump"), reached(size <= quiet * most, dropout).alias("quiet"), reached(size >= loud * most, clipping).alias("loud")))
    counts = [F.count_if(c).alias(n) for c, n in (("jump", "clicks"), ("quiet", "dropouts"), ("loud", "clippings"))]
    return flags.groupBy("stream_id").agg(F.count("*").alias("frames"), *counts)


def pid(rows: DataFrame, target: float, dt: float, most: float, least: float, kp: float, ki: float, kd: float) -> DataFrame:
    """P, I and D terms from a running sum and a lag, clamped."""
    error = F.lit(float(target)) - F.col("x")
    total = F.sum(error).over(stream().rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.lag(error).over(stream()), F.lit(0.0))
    y = kp * error + ki * total * dt + kd * (error - before) / dt
    return rows.withColumn("y", F.least(F.greatest(y, F.lit(float(least))), F.lit(float(most))))


#: Interpolators between x1 and x2 at t in 0..1, with x0 before and x3 after.
INTERPOLATORS = {
    "linear": lambda x0, x1, x2, x3, t: x1 + t * (x2 - x1),
    "hermite": lambda x0, x1, x2, x3, t: x1 + t * (x2 - x0) / 2 + t * t * (x0 - 2.5 * x1 + 2 * x2 - 0.5 * x3) + t * t * t * (1.5 * (x1 - x2) + 0.5 * (x3 - x0)),
    "bspline": lambda x0, x1, x2, x3, t: ((x0 + 4 * x1 + x2) + 3 * t * (x2 - x0) + 3 * t * t * (x0 - 2 * x1 + x2) + t * t * t * (x3 - x0 + 3 * (x1 - x2))) / 6,
    "parabolic": lambda x0, x1, x2, x3, t: 0.5 * x1 + 0.25 * (x0 + x2) + t * 0.5 * (x2 - x0) + t * t * 0.25 * (x3 - x1 - x2 + x0),
    "lagrange": lambda x0, x1, x2, x3, t: x0 * (-t * (t - 1) * (t - 2) / 6) + x1 * ((t + 1) * (t - 1) * (t - 2) / 2) + x2 * (-t * (t + 1) * (t - 2) / 2) + x3 * (t * (t + 1) * (t - 1) / 6),
}


def resample(rows: DataFrame, step: float, kind: str = "linear") -> DataFrame:
    """Frame k of the output is the input at k * step, which must have a frame on both sides. Each input frame gives out the frames from itself to the next, so nothing but the blocks' window is shuffled."""
    before, after, later = F.lag("x").over(piece()), F.lead("x").over(piece()), F.lead("x", 2).over(piece())
    near = own(in_blocks(rows, 1, 2).select("stream_id", "frame_no", F.coalesce(before, "x").alias("x0"), F.col("x").alias("x1"), after.alias("x2"), F.coalesce(later, after).alias("x3"), "__block", "__own")).filter("x2 is not null")
    first, end = F.ceil(F.col("frame_no") / F.lit(step)).cast("long"), F.ceil((F.col("frame_no") + 1) / F.lit(step)).cast("long") - 1
    each = near.withColumn("k", F.explode(F.when(end >= first, F.sequence(first, end)).otherwise(F.array().cast("array<bigint>"))))
    y = INTERPOLATORS[kind](F.col("x0"), F.col("x1"), F.col("x2"), F.col("x3"), F.col("k") * F.lit(step) - F.col("frame_no"))
    return each.select("stream_id", F.col("k").alias("frame_no"), y.alias("y"))


def resample_frames(frames: DataFrame, step: float, kind: str = "linear") -> DataFrame:
    """resample() of every channel of the frame form; the samples come out as doubles."""
    before, after, later = F.lag("samples").over(piece()), F.lead("samples").over(piece()), F.lead("samples", 2).over(piece())
    near = own(in_blocks(frames, 1, 2).select("stream_id", "frame_no", F.coalesce(before, "samples").alias("s0"), F.col("samples").alias("s1"), after.alias("s2"), F.coalesce(later, after).alias("s3"), "__block", "__own")).filter("s2 is not null")
    first, end = F.ceil(F.col("frame_no") / F.lit(step)).cast("long"), F.ceil((F.col("frame_no") + 1) / F.lit(step)).cast("long") - 1
    each = near.withColumn("k", F.explode(F.when(end >= first, F.sequence(first, end)).otherwise(F.array().cast("array<bigint>"))))
    each = each.withColumn("t", F.col("k") * F.lit(step) - F.col("frame_no"))
    y = F.transform(F.arrays_zip("s0", "s1", "s2", "s3"), lambda s: INTERPOLATORS[kind](s["s0"], s["s1"], s["s2"], s["s3"], F.col("t")))
    return each.select("stream_id", F.col("k").alias("frame_no"), y.alias("samples"))


def to_supported_rate(rows: DataFrame, rate: int, rates: tuple[int, ...]) -> DataFrame:
    """stream_id, frame_no and y at the supported rate nearest to rate; a supported rate leaves the samples alone."""
    best = min(rates, key=lambda r: abs(r - rate))
    return rows.select("stream_id", "frame_no", F.col("x").cast("double").alias("y")) if best == rate else resample(rows, rate / best)


def convert_format(frames: DataFrame, rate: tuple[int, int], channels: tuple[int, int], bits: tuple[int, int]) -> DataFrame:
    """Frames of another rate, number of channels and bit depth, each given as (from, to): resampled, then truncated, then mixed down or repeated, then scaled."""
    out = frames if rate[0] == rate[1] else resample_frames(frames, rate[0] / rate[1])
    whole = F.transform("samples", lambda x: x.cast("int"))
    mixed = out.select("stream_id", "frame_no", convert_channels(whole, channels[1], channels[0]).alias("samples"))
    return mixed.select("stream_id", "frame_no", F.transform("samples", lambda x: convert_bits(x, *bits)).alias("samples"))


def band_kernel(gains_db: list[float], rate: float, taps: int) -> list[int]:
    """A kernel in 1/32768 of a graphic equalizer: unity plus, for each band of at least 0.1 dB, a windowed band-pass that is
    scaled to the band's gain at its centre. Centres lie evenly in log frequency between 20 Hz and rate / 2 (one band: in the
    middle); a band is an octave wide, or 4 * rate / taps where that is more. Gains are held to -90..12 dB."""
    n = np.arange(taps) - (taps - 1) // 2
    centres = np.geomspace(20, rate / 2, len(gains_db)) if len(gains_db) > 1 else np.array([math.sqrt(10 * rate)])
    kernel = (n == 0).astype(float)
    for hz, db in zip(centres, np.clip(gains_db, -90, 12), strict=True):
        if abs(db) < 0.1:
            continue
        wider = max(0.0, (4 * rate / taps - 0.707 * hz) / 2)
        low, high = 0.707 * hz - wider, 1.414 * hz + wider
        low, high = np.clip([max(low, 1.0) if wider else low, high], 0, rate / 2) / rate
        if high <= low:
            continue
        band = 2 * np.blackman(taps) * (high * np.sinc(2 * high * n) - low * np.sinc(2 * low * n))
        peak = abs(np.sum(band * np.exp(-2j * np.pi * hz / rate * n)))
        kernel += band * (10 ** (db / 20) - 1) / (peak if peak > 1e-6 else 1)
    return [int(k) for k in np.clip(np.trunc(kernel * 32767), -32768, 32767)]


def band_equalizer(rows: DataFrame, gains_db: list[float], rate: float, taps: int = 31) -> DataFrame:
    """The FIR filter of band_kernel() in fixed point: floor of the sum over 32768, clipped to 16 bits."""
    out = fir(rows, band_kernel(gains_db, rate, taps))
    return out.withColumn("y", F.greatest(F.least(F.floor(F.col("y") / 32768), F.lit(32767)), F.lit(-32768)))
