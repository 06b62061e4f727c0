"""Decisions along a stream: recognised commands with suppression, and which video frames are worth decoding."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def smoothed_labels(scores: DataFrame, window_ms: int) -> DataFrame:
    """(stream_id, ts, label, score) from the scores (stream_id, ts in ms, label, score) of a model: at each time the best label is taken (of equal ones the first by name), and of the labels taken within window_ms before, up to now, the one with the greatest sum wins, with its mean."""
    order = Window.partitionBy("stream_id", "ts").orderBy(F.desc("score"), "label")
    best = scores.withColumn("place", F.row_number().over(order)).filter("place = 1").select("stream_id", "ts", "label", "score")
    span = Window.partitionBy("stream_id").orderBy("ts").rangeBetween(-window_ms, 0)
    held = best.select("stream_id", "ts", F.collect_list(F.struct("label", F.col("score").cast("double").alias("score"))).over(span).alias("held"))
    labels = F.array_sort(F.array_distinct(F.transform("held", lambda h: h["label"])))

    def summed(label):
        own = F.transform(F.filter("held", lambda h: h["label"] == label), lambda h: h["score"])
        total = F.aggregate(own, F.lit(0.0), lambda a, v: a + v)
        return F.struct(total.alias("total"), (total / F.size(own)).alias("score"), label.alias("label"))

    sums = F.transform(labels, summed)
    top = F.aggregate(sums, F.get(sums, F.lit(0)), lambda a, s: F.when(s["total"] > a["total"], s).otherwise(a))
    return held.select("stream_id", "ts", top["label"].alias("label"), top["score"].alias("score"))


class Suppressor:
    """Whether a label is a new command: another one than the last, above the threshold, and more than suppression_ms after it."""

    def __init__(self, threshold: float, suppression_ms: int, last: str | None = None, since: int | None = None):
        self.threshold, self.suppression_ms, self.last, self.since = threshold, suppression_ms, last, since

    def fires(self, ts: int, label: str, score: float) -> bool:
        if label == self.last or score <= self.threshold or (self.since is not None and ts - self.since <= self.suppression_ms):
            return False
        self.last, self.since = label, ts
        return True


def commands(scores: DataFrame, window_ms: int = 1000, threshold: float = 50, suppression_ms: int = 1500) -> DataFrame:
    """(stream_id, ts, label, score): the times at which a smoothed label is a new command. The smoothing is a window; only its result, a row a time, is walked with one state a stream."""
    rows = smoothed_labels(scores, window_ms).repartition("stream_id").sortWithinPartitions("stream_id", "ts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            keep = []
            for stream, *row in zip(*(b.column(c).to_pylist() for c in ("stream_id", "ts", "label", "score")), strict=True):
                if state is None or stream != at:
                    at, state = stream, Suppressor(threshold, suppression_ms)
                keep.append(state.fires(*row))
            yield b.filter(pa.array(keep, pa.bool_()))

    kind = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kind[c]}" for c in ("stream_id", "ts", "label", "score")))


def commands_stream(scores: DataFrame, window_ms: int = 1000, threshold: float = 50, suppression_ms: int = 1500) -> DataFrame:
    """commands() on an unbounded stream. State: the labels of the last window_ms, and the last command. Scores of a time must come in one micro-batch, and times in order."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        kept, last, since = held.get if held.exists else ("[]", None, None)
        recent, state = json.loads(kept), Suppressor(threshold, suppression_ms, last, since)
        got = pd.concat(list(parts)).sort_values(["ts", "score", "label"], ascending=[True, False, True]).drop_duplicates("ts")
        out = []
        for ts, label, score in zip(got["ts"].tolist(), got["label"].tolist(), got["score"].tolist(), strict=True):
            recent = [r for r in recent if r[0] >= ts - window_ms] + [[ts, label, score]]
            sums: dict = {}
            for _, name, value in recent:
                total, n = sums.get(name, (0.0, 0))
                sums[name] = total + value, n + 1
            name = min(sums, key=lambda k: (-sums[k][0], k))
            mean = sums[name][0] / sums[name][1]
            if state.fires(ts, name, mean):
                out.append((key[0], ts, name, mean))
        held.update((json.dumps(recent), state.last, state.since))
        yield pd.DataFrame(out, columns=["stream_id", "ts", "label", "score"])

    kind = dict(scores.dtypes)
    result = f"stream_id {kind['stream_id']}, ts long, label string, score double"
    return scores.select("stream_id", "ts", "label", "score").groupBy("stream_id").applyInPandasWithState(run, result, "recent string, last string, since long", "append", GroupStateTimeout.NoTimeout)


def ahead_of_clock(frames: DataFrame, clock: DataFrame, period_us: int) -> DataFrame:
    """frames (stream_id, frame_no, ts, key) with ahead_ms: how far frame_no's time by its period lies after what the audio clock (stream_id, ts, played_us) had played at ts; negative if the frame is late. An as-of join by one window: the last clock value at or before ts, 0 before the first."""
    both = frames.select("stream_id", "ts", "frame_no", "key", F.lit(None).cast("long").alias("played_us")).unionByName(clock.select("stream_id", "ts", "played_us"), allowMissingColumns=True)
    upto = Window.partitionBy("stream_id").orderBy("ts", F.col("frame_no").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    played = F.coalesce(F.last("played_us", ignorenulls=True).over(upto), F.lit(0))
    met = both.withColumn("played", played).filter("frame_no is not null")
    return met.select("stream_id", "frame_no", "ts", "key", F.floor((F.col("frame_no") * period_us - F.col("played")) / 1000).alias("ahead_ms"))


def admitted(frames: DataFrame, late_ms: int = -150, very_late_ms: int = -400, most: int = 5) -> DataFrame:
    """frames (stream_id, frame_no, key, ahead_ms) with `admitted`: whether a frame is worth decoding, by what was known before it.

    A key frame begins a group. If the frame before it was later than very_late_ms, the whole group is dropped, but of such groups in a
    row every (most + 1)-th is let through. Inside a group, frames after one later than late_ms are dropped up to the next key
    frame. Frames before the first key frame are a group of their own that isn't dropped as a whole. Groups dropped in a row are
    islands of a flag, so their places come from windows; no frame waits for a state.
    """
    order = Window.partitionBy("stream_id").orderBy("frame_no")
    own = frames.withColumn("before", F.lag("ahead_ms").over(order)).withColumn("gop", F.sum(F.col("key").cast("int")).over(order))
    within = Window.partitionBy("stream_id", "gop").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("fell_behind", F.coalesce(F.max(F.col("ahead_ms") < late_ms).over(within), F.lit(False)))
    groups = own.filter("key").select("stream_id", "gop", F.coalesce(F.col("before") < very_late_ms, F.lit(False)).alias("wanted"))
    by_group = Window.partitionBy("stream_id").orderBy("gop")
    groups = groups.withColumn("island", F.sum(F.when(F.col("wanted"), 0).otherwise(1)).over(by_group))
    place = F.row_number().over(Window.partitionBy("stream_id", "island", "wanted").orderBy("gop"))
    dropped = groups.select("stream_id", "gop", (F.col("wanted") & (place % (most + 1) != 0)).alias("dropped"))
    met = own.join(dropped, ["stream_id", "gop"], "left")
    keep = ~F.coalesce("dropped", F.lit(False)) & (F.col("key") | ~F.col("fell_behind"))
    return met.select(*frames.columns, keep.alias("admitted"))
