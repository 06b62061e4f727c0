"""Filters whose state has no bound in time.

`fold` deals streams to partitions, sorts frames, and walks them batch by batch with one state a stream, so a task holds one Arrow batch whatever
the length of a stream. Coefficients are computed once, when the plan is built.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Makes the state of one stream: a function from a sample to an output. A linear filter's has `sections` (numerator, denominator), for linear().
Maker = Callable[[], Callable[[float], float]]
#: Types of stream_id that linear() takes.
STREAM_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def fold(rows: DataFrame, make: Maker, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """keys, frame_no, x and y = the state's output for x, in the order of frame_no. A state belongs to one value of the keys.

    Makers of linear filters say what sections they are; streams go through linear() then, a long one as many tasks.
    """
    keys, kind = list(keys), dict(rows.dtypes)
    sections = getattr(make, "sections", None)
    if sections and keys == ["stream_id"] and kind["stream_id"] in STREAM_TYPES:
        return linear(rows, sections).select("stream_id", F.col("frame_no").cast(kind["frame_no"]).alias("frame_no"), F.col("x").cast(kind["x"]).alias("x"), "y")
    ordered = rows.select(*keys, "frame_no", "x").repartition(*keys).sortWithinPartitions(*keys, "frame_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step = None, None
        for b in batches:
            out = []
            for *stream, x in zip(*(b.column(c).to_pylist() for c in (*keys, "x")), strict=True):
                if stream != at or step is None:
                    at, step = stream, make()
                out.append(float(step(x)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, "y"])

    return ordered.mapInArrow(run, ", ".join(f"{c} {kind[c]}" for c in (*keys, "frame_no", "x")) + ", y double")


def fold_channels(frames: DataFrame, makers: Sequence[Maker]) -> DataFrame:
    """stream_id, frame_no and samples array<double>: channel k of the frames (stream_id, frame_no, samples) through a filter of makers[k], of the last one for further channels. One walk for all channels: frames stay whole and meet once."""
    ordered = frames.select("stream_id", "frame_no", "samples").repartition("stream_id").sortWithinPartitions("stream_id", "frame_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, steps = None, []
        for b in batches:
            out = []
            for stream, samples in zip(b.column("stream_id").to_pylist(), b.column("samples").to_pylist(), strict=True):
                if stream != at:
                    at, steps = stream, []
                while len(steps) < len(samples):
                    steps.append(makers[min(len(steps), len(makers) - 1)]())
                out.append([float(step(x)) for step, x in zip(steps, samples, strict=False)])
            yield pa.RecordBatch.from_arrays([b.column("stream_id"), b.column("frame_no"), pa.array(out, pa.list_(pa.float64()))], ["stream_id", "frame_no", "samples"])

    kind = dict(frames.dtypes)
    return ordered.mapInArrow(run, f"stream_id {kind['stream_id']}, frame_no {kind['frame_no']}, samples array<double>")


def biquad(kind: str, hz: float, rate: float, q: float = 0.7071, gain_db: float = 0.0, slope: float = 1.0) -> tuple[list[float], list[float]]:
    """(b, a) of the well-known audio-EQ shapes, normalised to a[0] = 1: low_pass, high_pass, band_pass, notch, low_shelf, high_shelf."""
    w = 2 * math.pi * hz / rate
    c, s = math.cos(w), math.sin(w)
    alpha = s / (2 * q)
    if kind in ("low_shelf", "high_shelf"):
        big = 10 ** (gain_db / 40)
        beta = 2 * math.sqrt(big) * (s / 2 * math.sqrt((big + 1 / big) * (1 / slope - 1) + 2))
        d = 1 if kind == "low_shelf" else -1
        b = [big * ((big + 1) - d * (big - 1) * c + beta), d * 2 * big * ((big - 1) - d * (big + 1) * c), big * ((big + 1) - d * (big - 1) * c - beta)]
        a = [(big + 1) + d * (big - 1) * c + beta, -d * 2 * ((big - 1) + d * (big + 1) * c), (big + 1) + d * (big - 1) * c - beta]
    else:
        b = {"low_pass": [(1 - c) / 2, 1 - c, (1 - c) / 2], "high_pass": [(1 + c) / 2, -(1 + c), (1 + c) / 2], "band_pass": [alpha, 0.0, -alpha], "notch": [1.0, -2 * c, 1.0]}[kind]
        a = [1 + alpha, -2 * c, 1 - alpha]
    return [v / a[0] for v in b], [v / a[0] for v in a]


def iir(b: Sequence[float], a: Sequence[float]) -> Maker:
    """Direct form I of any order."""
    b, a = [v / a[0] for v in b], [v / a[0] for v in a]

    def make() -> Callable[[float], float]:
        xs, ys = [0.0] * len(b), [0.0] * len(a)

        def step(x: float) -> float:
            xs.insert(0, x)
            xs.pop()
            y = sum(p * v for p, v in zip(b, xs, strict=True)) - sum(p * v for p, v in zip(a[1:], ys, strict=False))
            ys.insert(0, y)
            ys.pop()
            return y

        return step

    if max(len(b), len(a)) <= 3:
        make.sections = [tuple(p + [0.0] * (3 - len(p)) for p in (b, a))]
    return make


def biquad_df2(b: Sequence[float], a: Sequence[float], gain: float = 1.0) -> Maker:
    """Direct form II of order two."""

    def make() -> Callable[[float], float]:
        w1 = w2 = 0.0

        def step(x: float) -> float:
            nonlocal w1, w2
            w0 = x - a[1] * w1 - a[2] * w2
            y = gain * (b[0] * w0 + b[1] * w1 + b[2] * w2)
            w1, w2 = w0, w1
            return y

        return step

    make.sections = [([gain * v for v in b], list(a))]
    return make


def chain(*makers: Maker) -> Maker:
    """Filters one after another, as in second-order sections."""

    def make() -> Callable[[float], float]:
        steps = [m() for m in makers]

        def step(x: float) -> float:
            for s in steps:
                x = s(x)
            return x

        return step

    if makers and all(getattr(m, "sections", None) for m in makers):
        make.sections = [own for m in makers for own in m.sections]
    return make


def kalman(q: float = 0.01, r: float = 1.0) -> Maker:
    def make() -> Callable[[float], float]:
        p, value = 1.0, 0.0

        def step(x: float) -> float:
            nonlocal p, value
            p += q
            k = p / (p + r)
            value += k * (x - value)
            p *= 1 - k
            return value

        return step

    return make


def delay(frames: int, depth: float = 0.5, feedback: float = 0.5, most: float = 32767) -> Maker:
    """(1 - depth) * x + depth * the line's end; the line takes x + feedback * its end, clipped."""

    def make() -> Callable[[float], float]:
        line, at = [0.0] * max(1, frames), 0

        def step(x: float) -> float:
            nonlocal at
            old = line[at]
            line[at] = min(max(round(x + feedback * old), -most), most)
            at = (at + 1) % len(line)
            return (1 - depth) * x + depth * old

        return step

    return make


def equalizer3(rate: float, low_hz: float = 880, high_hz: float = 5000, low: float = 1, middle: float = 1, high: float = 1) -> Maker:
    """Three bands from two cascades of four one-pole filters; the high band is what they leave of a sample three frames old."""
    fl, fh = 2 * math.sin(math.pi * low_hz / rate), 2 * math.sin(math.pi * high_hz / rate)

    def make() -> Callable[[float], float]:
        lp, hp, past = [0.0] * 4, [0.0] * 4, [0.0] * 3

        def step(x: float) -> float:
            for f, poles in ((fl, lp), (fh, hp)):
                v = x
                for k in range(4):
                    poles[k] += f * (v - poles[k])
                    v = poles[k]
            bottom, top = lp[3], past[2] - hp[3]
            mid = past[2] - (top + bottom)
            past.insert(0, x)
            past.pop()
            return low * bottom + middle * mid + high * top

        return step

    return make


def adsr(attack: float, decay: float, sustain: float, release: float, off_at: int) -> Maker:
    """Samples times a linear attack, decay, sustain and release envelope; the key goes up at frame off_at."""

    def make() -> Callable[[float], float]:
        level, n, phase = 0.0, 0, "attack"

        def step(x: float) -> float:
            nonlocal level, n, phase
            if n == off_at:
                phase = "release"
            n += 1
            if phase == "attack":
                level = min(1.0, level + attack)
                phase = "decay" if level >= 1 else phase
            elif phase == "decay":
                level = max(sustain, level - decay)
                phase = "sustain" if level <= sustain else phase
            elif phase == "release":
                level = max(0.0, level - release)
            return x * level

        return step

    return make


def compressor(rate: float, attack_ms: float = 30, release_ms: float = 20, hold_ms: float = 10, threshold: float = 0.1, ratio: float = 0.5, most: float = 32767) -> Maker:
    """A gain between 1 and `ratio` in four phases. A sample over the threshold starts an attack, which runs to its end whatever
    follows; the reduced gain is then held, anew from every further loud sample, until it is released."""
    idle, attack, reduced, release = range(4)
    ms = {attack: attack_ms, reduced: hold_ms, release: release_ms}
    frames = {phase: max(1, int(rate * t / 1000)) for phase, t in ms.items()}
    fall, rise = (1 - ratio) / frames[attack], (1 - ratio) / frames[release]
    limit = threshold * most

    def make() -> Callable[[float], float]:
        gain, phase, left = 1.0, idle, 0

        def enter(new: int) -> None:
            nonlocal phase, left
            phase, left = new, frames.get(new, left)

        def step(x: float) -> float:
            nonlocal gain, left
            if abs(x) > limit:
                if phase in (idle, release) and gain >= ratio:
                    enter(attack)
                if phase == reduced:
                    left = frames[reduced]
            elif abs(x) < limit and phase == reduced and left == 0 and gain <= 1:
                enter(release)
            change = {attack: -fall if gain > ratio else 0, release: rise if gain < 1 else 0}.get(phase, 0)
            if phase == idle:
                gain = max(gain, 1.0)
            elif left > 0 and (change or phase == reduced):
                gain += change
                left -= 1
            else:
                enter({attack: reduced, reduced: release, release: idle}[phase])
            return x * gain

        return step

    return make


def ring_pitch(shift: float, size: int = 1000) -> Maker:
    """Pitch times `shift`: a ring of `size` samples is written at speed one and read at speed `shift`, at the nearest place."""

    def make() -> Callable[[float], float]:
        ring, write, read = [0.0] * size, 0, 0.0

        def step(x: float) -> float:
            nonlocal write, read
            ring[write] = x
            write = (write + 1) % size
            y = ring[int(read)]
            read = (read + shift) % size
            return y

        return step

    return make


def filtered_delay(frames: int, inner: Maker, feedback: float = 0.5) -> Maker:
    """x plus the end of a line of `frames` samples that takes x and its own end through the inner filter."""

    def make() -> Callable[[float], float]:
        line, at, filtered = [0.0] * max(1, frames), 0, inner()

        def step(x: float) -> float:
            nonlocal at
            old = line[at]
            line[at] = x + feedback * filtered(old)
            at = (at + 1) % len(line)
            return x + old

        return step

    return make


def ring_pitch_faded(shift: float, size: int = 1000) -> Maker:
    """As ring_pitch, with a second reader half a ring away. The place of writing is `gap` frames ahead of a reader; a reader whose gap is
    within a tenth of the ring weighs gap over that tenth and the other one the rest, which stays so until a gap is small again."""
    near = size // 10

    def make() -> Callable[[float], float]:
        ring, write, read, weight = [0.0] * size, 0, 0.0, 1.0

        def step(x: float) -> float:
            nonlocal write, read, weight
            ring[write] = x
            write = (write + 1) % size
            first = math.floor(read + 0.5)
            places = first, (first + size // 2) % size
            for turn, place in enumerate(places if shift != 1 and near else ()):
                gap = write - place
                if 0 <= gap <= near:
                    weight = abs(turn - gap / near)
            read = 0.0 if math.floor(read + shift + 0.5) >= size else read + shift
            return ring[places[0]] * weight + ring[places[1]] * (1 - weight)

        return step

    return make


def state_space(sections: Sequence[tuple[Sequence[float], Sequence[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(A, B, C, D) of second-order sections one after another: state' = A state + B x and y = C state + D x."""
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
    for num, den in sections:
        num, den = ([v / den[0] for v in p] for p in (num, den))
        own, into = np.array([[-den[1], -den[2]], [1.0, 0.0]]), np.array([1.0, 0.0])
        out = np.array([num[1] - num[0] * den[1], num[2] - num[0] * den[2]])
        a = np.block([[a, np.zeros((len(a), 2))], [np.outer(into, c), own]])
        b, c, d = np.concatenate([b, into * d]), np.concatenate([num[0] * c, out]), num[0] * d
    return a, b, c, d


class _Chunked:
    """A linear filter over runs of samples, CHUNK at a time as matrix products."""

    CHUNK = 64

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: float):
        powers = [np.eye(len(a))]
        for _ in range(self.CHUNK):
            powers.append(a @ powers[-1])
        self.a, self.powers = a, powers
        self.seen = np.array([c @ p for p in powers[:-1]])
        self.reach = np.array([p @ b for p in reversed(powers[:-1])]).T
        echo = np.array([d, *(c @ p @ b for p in powers[:-2])])
        lag = np.subtract.outer(np.arange(self.CHUNK), np.arange(self.CHUNK))
        self.echo = np.where(lag >= 0, echo[np.maximum(lag, 0)], 0.0)

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The outputs and the state after them."""
        out = np.empty(len(x))
        for lo in range(0, len(x), self.CHUNK):
            part = x[lo : lo + self.CHUNK]
            n = len(part)
            out[lo : lo + n] = self.seen[:n] @ state + self.echo[:n, :n] @ part
            state = self.powers[n] @ state + self.reach[:, self.CHUNK - n :] @ part
        return out, state


def linear(rows: DataFrame, sections: Sequence[tuple[Sequence[float], Sequence[float]]], block: int = 4096) -> DataFrame:
    """stream_id, frame_no, x and y of second-order sections, with one stream over many tasks.

    A filter is linear in its state: every block of `block` frames gives, from a zero state, the state it ends with; these few
    numbers a block are scanned stream by stream, and each block then runs from its true state. Blocks meet by (stream,
    block), so a long stream is as parallel as many short ones; frames shuffle twice. Frames are numbered without gaps.
    """
    space = state_space(sections)
    size = len(space[0])
    kind = dict(rows.dtypes)["stream_id"]
    own = rows.select("stream_id", F.floor(F.col("frame_no") / block).alias("block"), "frame_no", F.col("x").cast("double").alias("x"), F.lit(None).cast("array<double>").alias("state"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(stream, block, first state, frames, samples) of sorted rows; a row without a frame that comes first has the state."""
        at, state, frames, samples = None, None, [], []
        for b in batches:
            stream, number, frame, x, states = (b.column(c) for c in ("stream_id", "block", "frame_no", "x", "state"))
            keys = list(zip(stream.to_pylist(), number.to_pylist(), strict=True))
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if keys[lo] != at:
                    if frames:
                        yield *at, state, np.concatenate(frames), np.concatenate(samples)
                    at, state, frames, samples = keys[lo], np.zeros(size), [], []
                if not frame[lo].is_valid:
                    state, lo = np.asarray(states[lo].as_py()), lo + 1
                if lo < hi:
                    frames.append(frame.slice(lo, hi - lo).to_numpy(zero_copy_only=False))
                    samples.append(x.slice(lo, hi - lo).to_numpy(zero_copy_only=False))
        if frames:
            yield *at, state, np.concatenate(frames), np.concatenate(samples)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, found = _Chunked(*space), []
        for stream, number, state, _, x in blocks(batches):
            found.append((stream, number, len(x), walk.run(x, state)[1].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa_kind, pa.int64(), pa.int64(), pa.list_(pa.float64())))], ["stream_id", "block", "n", "state"])

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, at, state = _Chunked(*space), None, None
        for b in batches:
            out = []
            for stream, n, end in zip(*(b.column(c).to_pylist() for c in ("stream_id", "n", "state")), strict=True):
                if stream != at:
                    at, state = stream, np.zeros(size)
                out.append(state.tolist())
                state = np.linalg.matrix_power(walk.a, n) @ state + np.asarray(end)
            yield pa.RecordBatch.from_arrays([b.column("stream_id"), b.column("block"), pa.array(out, pa.list_(pa.float64()))], ["stream_id", "block", "state"])

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Chunked(*space)
        for stream, _, state, frames, x in blocks(batches):
            columns = [pa.array([stream] * len(x), pa_kind), pa.array(frames, pa.int64()), pa.array(x), pa.array(walk.run(x, state)[0])]
            yield pa.RecordBatch.from_arrays(columns, ["stream_id", "frame_no", "x", "y"])

    pa_kind = STREAM_TYPES[kind]
    order = ["stream_id", "block", "frame_no"]
    dealt = own.repartition("stream_id", "block").sortWithinPartitions(*order)
    last = dealt.mapInArrow(ends, f"stream_id {kind}, block long, n long, state array<double>")
    first = last.repartition("stream_id").sortWithinPartitions("stream_id", "block").mapInArrow(starts, f"stream_id {kind}, block long, state array<double>")
    known = first.select("stream_id", "block", F.lit(None).cast("long").alias("frame_no"), F.lit(None).cast("double").alias("x"), "state")
    both = own.withColumn("frame_no", F.col("frame_no").cast("long")).unionByName(known).repartition("stream_id", "block").sortWithinPartitions(*order)
    return both.mapInArrow(outputs, f"stream_id {kind}, frame_no long, x double, y double")
