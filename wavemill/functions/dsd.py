"""DSF files: one-bit audio decimated to PCM."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions.formats import little_endian

#: Where the data of a DSF file begins (fixed value).
DATA = 92


def low_pass_taps(factor: int, periods: int = 8) -> list[float]:
    """A Hann-windowed sinc for decimation by factor, `periods` output frames long."""
    n = factor * periods
    t = np.arange(n) - (n - 1) / 2
    return (np.sinc(t / factor) * (0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(n) + 0.5) / n))).tolist()


def dsd_frames(files: DataFrame, factor: int = 64, taps: Sequence[float] | None = None, groups: int = 64) -> DataFrame:
    """(path, frame_no, samples): 16-bit frames of DSF files (path, content), one for every `factor` bits.

    Frame n weighs the bits up to n * factor by taps, the newest first; bits are -1 or 1, those before the first 0, and taps are
    scaled to a sum of 1. Channels lie in turn in blocks of bytes. Runs of `groups` blocks of every channel, with the blocks
    before them that the taps reach into, are rows of their own, so that one file is decimated by many tasks. Files of another
    format, without channels or without bits are left out, as are bits beyond the sample count.
    """
    weights = np.asarray(taps if taps is not None else low_pass_taps(factor), float)
    weights = weights / weights.sum()
    c = F.col("content")
    ok = (F.substring(c, 1, 4) == F.encode(F.lit("DSD "), "utf-8")) & (F.substring(c, 29, 4) == F.encode(F.lit("fmt "), "utf-8")) & (F.substring(c, 81, 4) == F.encode(F.lit("data"), "utf-8"))
    fields = {"channels": (52, 4), "bits": (60, 4), "n": (64, 8), "block": (72, 4)}
    own = files.filter(ok & (F.length(c) > DATA)).select("path", "content", *[little_endian(c, *p).alias(n) for n, p in fields.items()]).filter("channels > 0 and block > 0 and n > 0")
    whole = F.floor((F.length(c) - DATA) / (F.col("channels") * F.col("block")))
    used = F.least(whole, F.ceil(F.col("n") / (F.col("block") * 8)))
    edge = F.ceil(F.lit(len(weights) - 1) / (F.col("block") * 8))
    parts = own.filter(used > 0).select("*", used.alias("used"), F.explode(F.sequence(F.lit(0).cast("long"), used - 1, F.lit(groups).cast("long"))).alias("first"))
    low = F.greatest(F.col("first") - edge, F.lit(0))
    size = F.col("channels") * F.col("block")
    piece = F.substr("content", (DATA + low * size + 1).cast("int"), ((F.least(F.col("first") + groups, F.col("used")) - low) * size).cast("int"))
    rows = parts.select("path", "channels", "bits", "n", "block", "first", low.alias("low"), piece.alias("piece")).repartition("path", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                channels, block = r["channels"], r["block"]
                data = np.frombuffer(r["piece"], np.uint8).reshape(-1, channels, block).transpose(1, 0, 2).reshape(channels, -1)
                bits = np.unpackbits(data, axis=1, bitorder="little" if r["bits"] == 1 else "big") * 2.0 - 1
                begin, start = r["low"] * block * 8, r["first"] * block * 8
                bits = np.concatenate([np.zeros((channels, len(weights) - 1)), bits[:, : r["n"] - begin]], axis=1)
                frames = np.arange(-(-start // factor), -(-(begin + bits.shape[1] - len(weights) + 1) // factor))
                if not len(frames):
                    continue
                at = frames * factor - begin  # in padded bits, the oldest of the frame's
                seen = np.lib.stride_tricks.sliding_window_view(bits, len(weights), axis=1)[:, at]
                x = np.trunc(np.clip(np.round(seen @ weights[::-1] * 32767, 6), -32768, 32767)).astype(np.int64).T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(frames) + 1, dtype=np.int32) * channels), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(frames), pa.string()), pa.array(frames.astype(np.int64)), lists], ["path", "frame_no", "samples"])

    return rows.mapInArrow(run, "path string, frame_no long, samples array<bigint>")
