"""Channel algebra inside a frame: expressions over the samples array."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at(s: Column, k: int) -> Column:
    return F.get(s, F.lit(k))


def swap(s: Column, channels: int) -> Column:
    """Left and right change places; other layouts stay."""
    return F.array(_at(s, 1), _at(s, 0)) if channels == 2 else s


def reduce_channels(s: Column, to: int, of: int) -> Column:
    """The first to - 1 channels stay; the last is the sum of the others, each divided and truncated."""
    share = of - to + 1
    tail = reduce(lambda a, b: a + b, [(_at(s, k) / share).cast("int") for k in range(to - 1, of)])
    return F.array(*[_at(s, k) for k in range(to - 1)], tail)


def enhance_channels(s: Column, to: int, of: int) -> Column:
    """The last channel is repeated."""
    return F.concat(s, F.array_repeat(_at(s, of - 1), to - of))


def convert_channels(s: Column, to: int, of: int) -> Column:
    return s if to == of else reduce_channels(s, to, of) if to < of else enhance_channels(s, to, of)


def difference(s: Column) -> Column:
    return F.array(_at(s, 0) - _at(s, 1))


def average(s: Column) -> Column:
    return F.array(((_at(s, 0) + _at(s, 1)) / 2).cast("int"))


def mix_to_all(s: Column, channels: int) -> Column:
    mean = (F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + x) / channels).cast("int")
    return F.array_repeat(mean, channels)


def copy_channel(s: Column, source: int, channels: int, shift: int = 0) -> Column:
    return F.array_repeat(F.shiftleft(_at(s, source), shift), channels)


def select_channels(s: Column, wanted: list[int], channels: int) -> Column:
    """An index beyond the last channel means the last."""
    return F.array(*[_at(s, min(k, channels - 1)) for k in wanted])


def split(frames: DataFrame) -> DataFrame:
    """A row for each channel: stream_id, frame_no, ch, x."""
    return frames.select("stream_id", "frame_no", F.posexplode("samples").alias("ch", "x"))


def join_channels(rows: DataFrame) -> DataFrame:
    """split() undone."""
    got = rows.groupBy("stream_id", "frame_no").agg(F.array_sort(F.collect_list(F.struct("ch", "x"))).alias("s"))
    return got.select("stream_id", "frame_no", F.transform("s", lambda p: p["x"]).alias("samples"))


def fill_empty(frames: DataFrame) -> DataFrame:
    """Of stereo streams, a channel that is all zero takes the other's samples."""
    loud = frames.groupBy("stream_id").agg(*[F.max(F.abs(F.get("samples", F.lit(k)))).alias(f"top_{k}") for k in (0, 1)])
    left, right = F.get("samples", F.lit(0)), F.get("samples", F.lit(1))
    filled = F.when((F.col("top_0") == 0) & (F.col("top_1") > 0), F.array(right, right)).when((F.col("top_1") == 0) & (F.col("top_0") > 0), F.array(left, left)).otherwise(F.col("samples"))
    return frames.join(loud, "stream_id").select("stream_id", "frame_no", filled.alias("samples"))


def volumes(s: Column, factors: list[float], most: float = 32767) -> Column:
    """A volume for each channel, the last one for further channels; truncated and clipped."""
    factor = F.array(*[F.lit(float(f)) for f in factors])
    return F.transform(s, lambda x, k: F.least(F.greatest(x * F.get(factor, F.least(k, F.lit(len(factors) - 1))), F.lit(-most)), F.lit(most)).cast("int"))
