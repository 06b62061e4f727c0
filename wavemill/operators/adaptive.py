"""Filters that follow their signal: Chebyshev and envelope filters, MDF echo cancelling, resampling by a step that changes, a pitch ring aligned by phase."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.operators.recursive import Maker, linear

Sections = list[tuple[list[float], list[float]]]
#: Parts of an output frame that places of varying resampling are counted in.
UNITS = 1 << 20


def _prototype(order: int, ripple: float) -> tuple[np.ndarray, float]:
    """Poles of the analog type I low pass with cutoff 1, one of each pair, and its gain at 0; ripple is the part of the amplitude that the pass band may lose."""
    if order % 2 or not 0 <= ripple < 1:
        raise ValueError("the order is even, and ripple from 0 to less than 1")
    angle = np.pi * (2 * np.arange(order // 2) + 1) / (2 * order)
    if ripple == 0:
        return -np.sin(angle) + 1j * np.cos(angle), 1.0
    size = math.sqrt(1 / (1 - ripple) ** 2 - 1)
    v = math.asinh(1 / size) / order
    return -math.sinh(v) * np.sin(angle) + 1j * math.cosh(v) * np.cos(angle), 1 - ripple


def chebyshev(cutoff: float, order: int = 4, ripple: float = 0.1, high: bool = False) -> Sections:
    """Second-order sections of a Chebyshev filter of type I by the bilinear transform; cutoff is a part of the sample rate (0 to 0.5), the gain at 0 (or at half the rate) is 1. Sections go to linear()."""
    if not 0 < cutoff < 0.5:
        raise ValueError("the cutoff lies between 0 and half the sample rate")
    poles, _ = _prototype(order, ripple)
    sections = []
    for b, a in zip(*_bilinear(poles, np.array([math.tan(math.pi * cutoff)]), high), strict=True):
        sections.append((b[0].tolist(), a[0].tolist()))
    return sections


def _bilinear(poles: np.ndarray, warped: np.ndarray, high: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each pole pair numerators and denominators (a row a cutoff) of sections of gain 1; warped is tan(pi * cutoff)."""
    nums, dens = [], []
    for p in poles:
        re, m = -2 * p.real, abs(p) ** 2
        w = 1 / warped if high else warped  # s -> (1 + z^-1) / (1 - z^-1) for high passes, its inverse for low ones
        a0 = 1 + re * w + m * w * w
        a1, a2 = 2 * (m * w * w - 1) / a0, (1 - re * w + m * w * w) / a0
        gain = (1 + a1 + a2) / 4
        b = np.stack([gain, 2 * gain, gain], axis=1)
        a = np.stack([np.ones_like(w), a1, a2], axis=1)
        if high:
            b, a = b * [1, -1, 1], a * [1, -1, 1]
        nums.append(b)
        dens.append(a)
    return nums, dens


def low_pass(rows: DataFrame, cutoff: float, order: int = 4, ripple: float = 0.1) -> DataFrame:
    """stream_id, frame_no, x and y of a Chebyshev low pass, one stream over many tasks."""
    return linear(rows, chebyshev(cutoff, order, ripple))


def envelope(rows: DataFrame, cutoff: float, window: int = 128, order: int = 4, ripple: float = 0.1) -> DataFrame:
    """stream_id, frame_no, x and y, the low-passed root mean square of the last `window` frames (those before the first are 0), for samples of 16 bits in parts of 32767."""
    past = Window.partitionBy("stream_id").orderBy("frame_no").rowsBetween(1 - window, 0)
    x = F.col("x") / F.lit(32767.0)
    loud = rows.select("stream_id", "frame_no", F.sqrt(F.sum(x * x).over(past) / window).alias("x"))
    return linear(loud, chebyshev(cutoff, order, ripple)).withColumn("y", F.greatest("y", F.lit(0.0)))


def envelope_filter(rows: DataFrame, follower: float = 0.00006, base: float = 0.001, depth: float = 2.0, order: int = 4, ripple: float = 0.1, window: int = 128) -> DataFrame:
    """stream_id, frame_no, x and y: a Chebyshev low pass whose cutoff, as a part of the sample rate, is base plus depth times the envelope (at most 0.49) at each frame.

    The envelope is a filter of its own and scanned in blocks; the coefficients of all frames of a batch are worked out
    at once, and only the recursion walks frame by frame, with one state a stream.
    """
    poles, _ = _prototype(order, ripple)
    follow = envelope(rows, follower, window, order, ripple).select("stream_id", "frame_no", F.least(F.lit(0.49), base + depth * F.col("y")).alias("cutoff"))
    met = rows.select("stream_id", "frame_no", "x").join(follow, ["stream_id", "frame_no"]).repartition("stream_id").sortWithinPartitions("stream_id", "frame_no")
    kind = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            stream, x = b.column("stream_id").to_pylist(), b.column("x").to_numpy(zero_copy_only=False).astype(float)
            nums, dens = _bilinear(poles, np.tan(np.pi * b.column("cutoff").to_numpy(zero_copy_only=False)))
            steps = list(zip(*[np.concatenate([n, d[:, 1:]], axis=1).tolist() for n, d in zip(nums, dens, strict=True)], strict=True))
            out = np.empty(len(x))
            for k, v in enumerate(x.tolist()):
                if state is None or stream[k] != at:
                    at, state = stream[k], [[0.0] * 4 for _ in poles]
                for (b0, b1, b2, a1, a2), s in zip(steps[k], state, strict=True):
                    y = b0 * v + b1 * s[0] + b2 * s[1] - a1 * s[2] - a2 * s[3]
                    s[0], s[1], s[2], s[3], v = v, s[0], y, s[2], y
                out[k] = v
            yield pa.RecordBatch.from_arrays([b.column("stream_id"), b.column("frame_no"), b.column("x"), pa.array(out)], ["stream_id", "frame_no", "x", "y"])

    return met.mapInArrow(run, f"stream_id {kind['stream_id']}, frame_no {kind['frame_no']}, x {kind['x']}, y double")


class EchoCanceller:
    """Multi-delay block frequency-domain adaptive filter with two paths.

    Reference and error are taken block by block through FFTs of two blocks (overlap-save); the filter is cut into `parts` of
    a block each, so that its length costs no delay. The background filter adapts, each bin by a step that its power normalises, and its
    gradient is kept causal. The foreground filter, which gives the output, takes the background's weights when that leaves
    less error, and the background goes back to the foreground's when it diverges.
    """

    def __init__(self, block: int = 64, parts: int = 4, rate: float = 0.5, smooth: float = 0.9):
        self.n, self.rate, self.smooth = block, rate, smooth
        self.past = np.zeros(2 * block)
        self.seen = np.zeros((parts, block + 1), complex)
        self.back, self.front = np.zeros((parts, block + 1), complex), np.zeros((parts, block + 1), complex)
        self.power = np.full(block + 1, 1e-3)
        self.lead = self.spread = 0.0

    def _echo(self, weights: np.ndarray) -> np.ndarray:
        return np.fft.irfft((weights * self.seen).sum(axis=0))[self.n :]

    def step(self, mic: np.ndarray, ref: np.ndarray) -> np.ndarray:
        """The block of mic without the echo of ref."""
        self.past = np.concatenate([self.past[self.n :], ref])
        self.seen = np.concatenate([np.fft.rfft(self.past)[None], self.seen[:-1]])
        now = np.abs(self.seen[0]) ** 2
        self.power = self.smooth * self.power + (1 - self.smooth) * now
        front, back = mic - self._echo(self.front), mic - self._echo(self.back)
        size = (mic**2).sum() + 1e-9
        gain = (front**2).sum() - (back**2).sum()
        # the lead of the background, smoothed, against how much the two differ
        self.lead = 0.6 * self.lead + 0.4 * gain
        self.spread = 0.36 * self.spread + 0.16 * (front**2).sum() * ((front - back) ** 2).sum()
        if self.lead > 0 and self.lead**2 > 0.25 * self.spread:
            self.front, front = self.back.copy(), back
            self.lead = self.spread = 0.0
        elif (back**2).sum() > 4 * size or -gain > 2 * (front**2).sum() + 1e-9:
            self.back, back = self.front.copy(), front
            self.lead = self.spread = 0.0
        error = np.fft.rfft(np.concatenate([np.zeros(self.n), back]))
        total = (np.abs(self.seen) ** 2).sum(axis=0) + len(self.seen) * (0.1 * self.power + 1e-9) + 1e-6
        gradient = np.fft.irfft(np.conj(self.seen) * (error / total), axis=1)
        gradient[:, self.n :] = 0
        self.back = self.back + self.rate * np.fft.rfft(gradient, axis=1)
        return front


def mdf(rows: DataFrame, block: int = 64, parts: int = 4, rate: float = 0.5) -> DataFrame:
    """Echo cancelling of rows (stream_id, frame_no, x: microphone, ref): stream_id, frame_no and y. A stream is walked block by block with one EchoCanceller; frames of its last block that is not whole go through as they are."""
    ordered = rows.select("stream_id", "frame_no", F.col("x").cast("double").alias("x"), F.col("ref").cast("double").alias("ref")).repartition("stream_id").sortWithinPartitions("stream_id", "frame_no")
    kind = dict(rows.dtypes)
    names = ["stream_id", "frame_no", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        state: EchoCanceller | None = None

        def out(part: pa.Table, y: np.ndarray) -> pa.RecordBatch:
            own = part.combine_chunks()
            return pa.RecordBatch.from_arrays([own.column("stream_id").combine_chunks(), own.column("frame_no").combine_chunks(), pa.array(y)], names)

        def blocks(own: pa.Table, last: bool) -> Iterator[pa.RecordBatch | pa.Table]:
            """Outputs of one stream's whole blocks, then what is left."""
            nonlocal state
            state = state or EchoCanceller(block, parts, rate)
            x, ref = own.column("x").to_numpy(), own.column("ref").to_numpy()
            whole = len(x) // block * block
            if whole:
                y = np.concatenate([state.step(x[k : k + block], ref[k : k + block]) for k in range(0, whole, block)])
                yield out(own.slice(0, whole), y)
            if last:
                if whole < len(x):
                    yield out(own.slice(whole), x[whole:])
                state = None
            else:
                yield own.slice(whole)

        at = None
        for b in batches:
            table, stream = pa.Table.from_batches([b]), b.column("stream_id").to_pylist()
            edges = [0, *(k for k in range(1, len(stream)) if stream[k] != stream[k - 1]), len(stream)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if held is not None and at != stream[lo]:
                    yield from blocks(held, True)
                    held = None
                at, part = stream[lo], table.slice(lo, hi - lo)
                for got in blocks(part if held is None else pa.concat_tables([held, part]), False):
                    if isinstance(got, pa.Table):
                        held = got
                    else:
                        yield got
        if held is not None:
            yield from blocks(held, True)

    return ordered.mapInArrow(run, f"stream_id {kind['stream_id']}, frame_no {kind['frame_no']}, y double")


def drift(clocks: DataFrame, blocks: int = 8, most: float = 0.05) -> DataFrame:
    """(stream_id, block_no, step) from clocks (stream_id, block_no, made, played): the producer's frames for each of the consumer's, as the slope of a regression of made on played over the last `blocks` blocks, within 1 ± most, to six places; 1 for the first block."""
    past = Window.partitionBy("stream_id").orderBy("block_no").rowsBetween(1 - blocks, 0)
    slope = F.regr_slope(F.col("made").cast("double"), F.col("played").cast("double")).over(past)
    return clocks.select("stream_id", "block_no", F.round(F.greatest(F.lit(1 - most), F.least(F.lit(1 + most), F.coalesce(slope, F.lit(1.0)))), 6).alias("step"))


def resample_varying(rows: DataFrame, steps: DataFrame, block: int) -> DataFrame:
    """(stream_id, frame_no, y): rows read by a step that changes with the blocks of `block` input frames, as steps (stream_id, block_no, step > 0) say; linear between neighbours, up to the last frame.

    The input's place is a running sum of steps. Turned round, every block gives block / step output frames, so prefix
    sums over the blocks say which output frames each input frame gives rise to, and frames need only their next neighbour.
    Sums are taken in whole UNITS of a frame, so that they are exact in any order.
    """
    order = Window.partitionBy("stream_id").orderBy("block_no")
    units = F.round(F.lit(float(block * UNITS)) / F.col("step")).cast("long")
    begins = steps.select("stream_id", "block_no", units.alias("units"), (F.sum(units).over(order) - units).alias("begin"))
    after = Window.partitionBy("stream_id").orderBy("frame_no")
    each = rows.select("stream_id", F.floor(F.col("frame_no") / block).alias("block_no"), (F.col("frame_no") % block).alias("k"), "x", F.lead("x").over(after).alias("next")).join(begins, ["stream_id", "block_no"])
    at = lambda k: F.col("begin") + F.floor(k * F.col("units") / block)
    each = each.filter("next is not null").select("stream_id", "x", "next", at(F.col("k")).alias("low"), at(F.col("k") + 1).alias("high"))
    first, last = (F.ceil(F.col(c) / UNITS) for c in ("low", "high"))
    made = each.withColumn("frame_no", F.explode(F.when(first < last, F.sequence(first, last - 1))))
    part = (F.col("frame_no") * UNITS - F.col("low")) / (F.col("high") - F.col("low"))
    return made.select("stream_id", "frame_no", (F.col("x") + part * (F.col("next") - F.col("x"))).alias("y"))


def aligned_ring(size: int, shift: float) -> Maker:
    """Pitch shifting for fold(): the ring of the last `size` samples is read `shift` times as fast as it is written, between neighbours by a line. Where reading and writing would meet, reading goes on at the nearest place ahead whose samples enclose the last output on a slope of the same direction, so that the phase holds; where there is none, half a ring ahead."""
    if size < 4 or shift <= 0:
        raise ValueError("the ring has at least 4 samples and is read forwards")

    def make() -> Callable[[float], float]:
        ring, write, read = [0.0] * size, 0, size / 2
        last, rising = 0.0, True

        def jump(at: float) -> float:
            for j in range(max(1, math.ceil(2 * shift)), size - 1):
                k = (int(at) + j) % size
                if write in (k, (k + 1) % size):
                    continue
                low, high = ring[k], ring[(k + 1) % size]
                if (high >= low) == rising and min(low, high) <= last <= max(low, high):
                    return (k + ((last - low) / (high - low) if high != low else 0.0)) % size
            return (at + size / 2) % size

        def step(x: float) -> float:
            nonlocal write, read, last, rising
            if int(read) == write or (int(read) + 1) % size == write:
                read = jump(read)
            ring[write] = float(x)
            write = (write + 1) % size
            k = int(read)
            low, high = ring[k], ring[(k + 1) % size]
            last, rising = low + (high - low) * (read - k), high >= low
            read = (read + shift) % size
            return last

        return step

    return make


def overlap_add_scaled(blocks: DataFrame, stride: int, most: float) -> DataFrame:
    """(stream_id, frame_no, y): overlap_add() scaled by the greatest value so far, step by step: `stride` frames leave at a time, divided by the maximum of all that have left (above 0; before there is one they are 0), times most, within ± most. Only a row a step meets in the prefix maximum."""
    from wavemill.operators.spectral import overlap_add

    whole = overlap_add(blocks, stride).withColumn("step", F.floor(F.col("frame_no") / stride))
    upto = Window.partitionBy("stream_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    tops = whole.groupBy("stream_id", "step").agg(F.max("y").alias("top")).select("stream_id", "step", F.max("top").over(upto).alias("top"))
    y = F.when(F.col("top") > 0, F.col("y") / F.col("top") * most).otherwise(0.0)
    return whole.join(tops, ["stream_id", "step"]).select("stream_id", "frame_no", F.greatest(F.lit(-float(most)), F.least(F.lit(float(most)), y)).alias("y"))
