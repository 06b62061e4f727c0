"""Signal operators on unbounded streams. Stateless ones work on `readStream` as they are; blocks and recursive filters need state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavemill.operators.scalar import truncate
from wavemill.operators.timeline import event_time


def bin_stream(rows: DataFrame, n: int, rate: int, late: str = "10 seconds", average: bool = False) -> DataFrame:
    """Sums or truncated means of n frames of (stream_id, frame_no, x), by the media clock of `rate`. A block goes out, and its state goes, once the watermark passes it; incomplete ones are left out. A block must last a whole number of microseconds."""
    width = n * 1_000_000 // rate
    if n < 1 or n * 1_000_000 % rate:
        raise ValueError("a block must last a whole number of microseconds")
    timed = rows.withColumn("ts", event_time(F.col("frame_no"), rate)).withWatermark("ts", late)
    total = F.sum("x")
    got = timed.groupBy("stream_id", F.window("ts", f"{width} microseconds").alias("w")).agg(F.count("*").alias("n"), F.min("frame_no").alias("first"), (truncate(total / n) if average else total).cast("long").alias("x"))
    return got.filter(F.col("n") == n).select("stream_id", F.floor(F.col("first") / n).alias("block_no"), "x")


def fold_stream(rows: DataFrame, init: tuple[float, ...], step: Callable[[tuple, float], tuple[tuple, float]]) -> DataFrame:
    """y = the output of step(state, x), which also gives the next state, a tuple of floats as long as init. Frames of a stream are ordered inside a micro-batch; micro-batches must come in order, as from an ordered log. State: one tuple a stream."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else init
        got = pd.concat(list(parts)).sort_values("frame_no", ignore_index=True)
        out = []
        for x in got["x"].tolist():
            state, y = step(state, x)
            out.append(float(y))
        held.update(tuple(state))
        yield got[["stream_id", "frame_no", "x"]].assign(y=out)

    kind = dict(rows.dtypes)
    kept = ", ".join(f"s{k} double" for k in range(len(init)))
    result = f"stream_id {kind['stream_id']}, frame_no {kind['frame_no']}, x {kind['x']}, y double"
    return rows.select("stream_id", "frame_no", "x").groupBy("stream_id").applyInPandasWithState(run, result, kept, "append", GroupStateTimeout.NoTimeout)
