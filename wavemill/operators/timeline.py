"""Operators on positions in time: transitions, tails, activity, clocks, modulated delays, and notes played as voices."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.operators.history import in_blocks, own, piece, stream
from wavemill.operators.scalar import clip, truncate

#: Frames of a block of notes, and notes (in each block they touch) that are played at once.
NOTE_BLOCK, NOTES_AT_ONCE = 65_536, 4096


def remove_pops(rows: DataFrame, n: int, at: str = "start") -> DataFrame:
    """Zeroes each block of n frames up to its first ("start") or after its last ("end") zero transition: a frame that is 0 or on the other side of 0 than the block's outer frame. A block without one becomes 0."""
    block = rows.withColumn("block", F.floor(F.col("frame_no") / n))
    whole = Window.partitionBy("stream_id", "block").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = block.withColumn("edge", (F.first if at == "start" else F.last)("x").over(whole))
    crossing = F.when(F.signum("edge") * F.signum("x") <= 0, F.col("frame_no"))
    if at == "start":
        keep = F.col("frame_no") >= F.min(crossing).over(whole)
    else:
        keep = F.col("frame_no") <= F.max(crossing).over(whole)
    return edge.select("stream_id", "frame_no", F.when(keep, F.col("x")).otherwise(0).alias("x"))


def fade_tail(rows: DataFrame, steps: int = 200) -> DataFrame:
    """Streams with `steps` frames more, which lead linearly from the last sample to 0."""
    last = rows.groupBy("stream_id").agg(F.max("frame_no").alias("end"), F.max_by("x", "frame_no").alias("last"))
    tail = last.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    ramp = truncate(F.col("last") * (steps - F.col("k")) / F.lit(float(steps)))
    return rows.select("stream_id", "frame_no", "x").union(tail.select("stream_id", F.col("end") + F.col("k"), ramp))


def center_by_first(rows: DataFrame, n: int) -> DataFrame:
    """Samples less the truncated mean of their stream's first n frames."""
    mean = rows.filter(F.col("frame_no") < n).groupBy("stream_id").agg(truncate(F.avg("x")).alias("mean"))
    return rows.join(mean, "stream_id").select("stream_id", "frame_no", (F.col("x") - F.col("mean")).alias("x"))


def active(rows: DataFrame, n: int, percent: float = 20, most: int = 32767) -> DataFrame:
    """Whether one of a frame's last n samples is over that part of the range."""
    peak = F.max(F.abs("x")).over(piece().rowsBetween(-(n - 1), 0))
    return own(in_blocks(rows, n - 1).withColumn("active", peak * 100 > F.lit(percent * most)))


def event_time(frame_no: Column, rate: int, start_us: int = 0) -> Column:
    """The media clock: when a frame plays, as a timestamp."""
    return F.timestamp_micros(F.lit(start_us) + F.floor(frame_no * 1_000_000 / F.lit(rate)).cast("long"))


def video_frames(rows: DataFrame, rate: int, fps: int) -> DataFrame:
    """Interleaving by the audio clock: (stream_id, frame_no, video) for each video frame that is due during an audio frame."""
    first = F.ceil(F.col("frame_no") * fps / F.lit(rate)).cast("long")
    end = F.ceil((F.col("frame_no") + 1) * fps / F.lit(rate)).cast("long") - 1
    return rows.filter(end >= first).select("stream_id", "frame_no", F.explode(F.sequence(first, end)).alias("video"))


def sequence_gaps(records: DataFrame) -> DataFrame:
    """(stream_id, seq, missing) where records before seq are missing."""
    before = F.lag("seq").over(Window.partitionBy("stream_id").orderBy("seq"))
    return records.select("stream_id", "seq", (F.col("seq") - before - 1).alias("missing")).filter("missing > 0")


def flanger(rows: DataFrame, gain: float, depth: int, hz: float, rate: float) -> DataFrame:
    """x plus gain times the sample d frames before, d swinging between 0 and depth as a sine of hz; frames before the first are 0."""
    swing = F.floor(F.round((1 + F.sin(F.col("frame_no") * F.lit(2 * math.pi * hz / rate))) * F.lit(depth / 2), 6)).cast("int")
    met = with_earlier(rows, F.col("frame_no") - swing, "__echo")
    return met.withColumn("y", truncate(clip(F.col("x") + F.lit(float(gain)) * F.col("__echo"), 32767.0))).drop("__echo")


def with_earlier(rows: DataFrame, place: Column, name: str) -> DataFrame:
    """rows with the sample x of their stream's frame `place`, 0 where there is none. A join on (stream, frame), which spreads a long stream over all tasks and holds nothing for a row."""
    earlier = rows.select("stream_id", F.col("frame_no").alias("__place"), F.col("x").alias(name))
    met = rows.withColumn("__place", place.cast("long")).join(earlier, ["stream_id", "__place"], "left")
    return met.select(*rows.columns, F.coalesce(name, F.lit(0)).alias(name))


def envelope(k: Column, on: Column, attack: int, decay: int, sustain: float, release: int) -> Column:
    """Attack, decay, sustain and release of a note's frame k, with the key up at frame `on`; closed form of the state machine for keys held through the decay."""
    held = F.when(k < attack, k / F.lit(float(attack))).when(k < attack + decay, 1 - (1 - sustain) * (k - attack) / F.lit(float(decay))).otherwise(F.lit(sustain))
    return F.when(k < on, held).otherwise(F.greatest(F.lit(0.0), sustain * (1 - (k - on) / F.lit(float(release)))))


def synthesize(notes: DataFrame, rate: int, attack: int = 10, decay: int = 10, sustain: float = 0.8, release: int = 20) -> DataFrame:
    """Streams of notes (stream_id, start, length, hz, amplitude): each frame is the mean of the voices that sound, truncated and clipped. Notes go to the
    blocks of NOTE_BLOCK frames they touch and are walked by their start, so only notes are shuffled and only frames that later notes may reach are held."""
    placed = notes.filter("start is not null and length is not null").select("stream_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), *[F.col(c).cast("double").alias(c) for c in ("hz", "amplitude")])
    first, last = (F.floor(c / NOTE_BLOCK).cast("long") for c in (F.col("start"), F.col("start") + F.col("length") + release - 1))
    blocks = placed.filter(F.col("length") + release > 0).withColumn("block", F.explode(F.sequence(first, last)))
    ordered = blocks.repartition("stream_id", "block").sortWithinPartitions("stream_id", "block", "start")
    kind = dict(placed.dtypes)["stream_id"]

    def voices(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Of each frame of each note inside its block: the note, the frame, and the value, NaN if unknown."""
        start, length, block = (part.column(c).to_numpy() for c in ("start", "length", "block"))
        hz, amplitude = (part.column(c).to_numpy(zero_copy_only=False) for c in ("hz", "amplitude"))
        low = np.maximum(start, block * NOTE_BLOCK)
        n = np.minimum(start + length + release, (block + 1) * NOTE_BLOCK) - low
        note = np.repeat(np.arange(len(n)), n)
        frame = np.arange(len(note)) - np.repeat(np.cumsum(n) - n - low, n)
        k = (frame - start[note]).astype(float)
        on = length[note]
        with np.errstate(divide="ignore", invalid="ignore"):
            held = np.where(k < attack, k / float(attack), np.where(k < attack + decay, 1 - (1 - sustain) * (k - attack) / float(decay), sustain))
            weight = np.where(k < on, held, np.maximum(0.0, sustain * (1 - (k - on) / float(release))))
        return note, frame, np.trunc(np.round(amplitude[note] * np.sin(k * hz[note] * (2 * math.pi / rate)) * weight, 6))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(streams: pa.Array, frames: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            x = np.trunc(np.clip(sums[:, 0] / sums[:, 2], -32767, 32767)).astype(np.int32)
            return pa.RecordBatch.from_arrays([streams, pa.array(frames), pa.array(x, mask=sums[:, 1] == 0)], ["stream_id", "frame_no", "x"])

        key, frames, sums, own = None, np.zeros(0, np.int64), np.zeros((0, 3)), None
        for b in batches:
            for lo in range(0, b.num_rows, NOTES_AT_ONCE):
                part = b.slice(lo, NOTES_AT_ONCE)
                streams, block, start = part.column("stream_id"), part.column("block").to_numpy(), part.column("start").to_numpy()
                code = streams.dictionary_encode(null_encoding="encode").indices.to_numpy()
                group = np.concatenate([[0], np.cumsum((code[1:] != code[:-1]) | (block[1:] != block[:-1]))])
                if key != (streams[0].as_py(), block[0]):
                    if len(frames):
                        yield out(pa.nulls(len(frames), streams.type) if own is None else pa.repeat(own, len(frames)), frames, sums)
                    frames, sums = np.zeros(0, np.int64), np.zeros((0, 3))
                note, frame, v = voices(part)
                known = ~np.isnan(v)
                notes_of, frame = np.concatenate([np.zeros(len(frames), np.int64), note]), np.concatenate([frames, frame])
                sums = np.concatenate([sums, np.stack([np.where(known, v, 0), known, np.ones(len(v))], 1)])
                order = np.lexsort((frame, group[notes_of]))
                notes_of, frame = notes_of[order], frame[order]
                at = np.flatnonzero(np.concatenate([[True], (np.diff(frame) != 0) | (np.diff(group[notes_of]) != 0)]))
                sums, frame, notes_of = np.add.reduceat(sums[order], at, axis=0), frame[at], notes_of[at]
                open_ = (group[notes_of] == group[-1]) & (frame >= start[-1])
                yield out(streams.take(pa.array(notes_of[~open_])), frame[~open_], sums[~open_])
                own = streams[-1] if streams[-1].is_valid else None
                key, frames, sums = (streams[-1].as_py(), block[-1]), frame[open_], sums[open_]
        if len(frames):
            yield out(pa.nulls(len(frames), streams.type) if own is None else pa.repeat(own, len(frames)), frames, sums)

    return ordered.mapInArrow(run, f"stream_id {kind}, frame_no long, x int")


def triangle(frame_no: Column, most: int) -> Column:
    """A test ramp between -(most - 1) and most - 1 in steps of one; frame 0 is 1."""
    top = most - 1
    p = F.pmod(frame_no + 1, F.lit(4 * top))
    return F.when(p <= top, p).when(p <= 3 * top, 2 * top - p).otherwise(p - 4 * top)


def drawn(seed: int, *position: Column) -> Column:
    """A value in [0, 1) that a hash of seed and position draws: there is no state, and reruns agree at any partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in position]).cast("binary"))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("long") / F.lit(2.0**20)


def white_noise(frame_no: Column, amplitude: int, seed: int) -> Column:
    return truncate((drawn(seed, frame_no) * 2 - 1) * amplitude)


def pink_noise(frame_no: Column, amplitude: int, seed: int, rows: int = 5) -> Column:
    """Mean of `rows` random values, the k-th of which is drawn anew every 2^k frames."""
    values = [drawn(seed, F.lit(k), F.shiftright(frame_no, k)) * 2 - 1 for k in range(rows)]
    return truncate(sum(values[1:], values[0]) / rows * amplitude)


def noise_lfo(frame_no: Column, period: int, seed: int) -> Column:
    """A random signal in [0, 1]: a value is drawn every `period` frames, straight lines join them."""
    at = F.floor(frame_no / F.lit(period)).cast("long")
    first, second = (drawn(seed, at + k) for k in (0, 1))
    part = (frame_no - at * period) / F.lit(float(period))
    return first + (second - first) * part


def from_end(rows: DataFrame) -> DataFrame:
    """Adds `left`, the number of frames of the stream that follow."""
    size = rows.groupBy("stream_id").agg(F.max("frame_no").alias("last"))
    return rows.join(size, "stream_id").withColumn("left", F.col("last") - F.col("frame_no")).drop("last")


def fade_out(rows: DataFrame, frames: int) -> DataFrame:
    """The last `frames` frames of each stream go down to 0 along a straight line."""
    return from_end(rows).withColumn("x", truncate(F.col("x") * F.least(F.lit(1.0), F.col("left") / F.lit(float(frames))))).drop("left")


def smooth_end(rows: DataFrame, step: float = 0.01) -> DataFrame:
    """The k-th frame from a stream's end, the last being the 0th, is weighed by k * step until that reaches 0.8."""
    factor = F.col("left") * F.lit(step)
    return from_end(rows).withColumn("x", truncate(F.when(factor < 0.8, F.col("x") * factor).otherwise(F.col("x").cast("double")))).drop("left")


def loop(rows: DataFrame, times: int) -> DataFrame:
    """Each stream `times` times in a row."""
    size = rows.groupBy("stream_id").agg((F.max("frame_no") + 1).alias("size"))
    again = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    return rows.join(size, "stream_id").withColumn("turn", again).select("stream_id", (F.col("frame_no") + F.col("turn") * F.col("size")).alias("frame_no"), "x")


def chorus(rows: DataFrame, lfo: Column, base: float, swing: float) -> DataFrame:
    """The signal base + swing * lfo frames before (lfo in 0..1), between two frames by a straight line; frames before the first are 0. Nothing of the undelayed signal is added."""
    late = F.round(F.lit(float(base)) + F.lit(float(swing)) * lfo, 6)
    whole = F.floor(late)
    met = with_earlier(with_earlier(rows.withColumn("__late", late), F.col("frame_no") - whole, "__near"), F.col("frame_no") - F.floor("__late") - 1, "__far")
    return met.withColumn("y", F.col("__near") + (F.col("__far") - F.col("__near")) * (F.col("__late") - F.floor("__late"))).drop("__near", "__far", "__late")
