"""Short-time spectra: blocks of samples in, bins out. A block is transformed where it is; blocks of a stream come from one shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators.scalar import to_mel


def blocks_of(rows: DataFrame, length: int, stride: int | None = None) -> DataFrame:
    """(stream_id, block_no, samples): every complete run of `length` frames that starts at a multiple of stride. A frame goes to each block that covers it, so blocks are independent of each other."""
    stride = stride or length
    last, first = F.floor(F.col("frame_no") / stride), F.greatest(F.lit(0), F.ceil((F.col("frame_no") - length + 1) / stride))
    each = rows.withColumn("block_no", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    got = each.groupBy("stream_id", "block_no").agg(F.array_sort(F.collect_list(F.struct("frame_no", "x"))).alias("s")).filter(F.size("s") == length)
    return got.select("stream_id", "block_no", F.transform("s", lambda p: p["x"].cast("double")).alias("samples"))


def _blockwise(blocks: DataFrame, fn: Callable[[np.ndarray], np.ndarray], name: str = "samples") -> DataFrame:
    """fn over a matrix of blocks (rows) of equal length; the other columns stay."""
    kept = [c for c in blocks.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(name)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            out = fn(flat.reshape(b.num_rows, -1)) if b.num_rows else np.zeros((0, 0))
            width = out.shape[1] if b.num_rows else 0
            column = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * width), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), column], [*kept, name])

    fields = ", ".join(f"{c} {t}" for c, t in blocks.select(*kept).dtypes)
    return blocks.select(*kept, name).mapInArrow(run, f"{fields}, {name} array<double>")


def weights(name: str, n: int) -> np.ndarray:
    """window_factor() of scalar.py for every sample."""
    from wavemill.operators.scalar import COSINE_WINDOWS

    i = np.arange(n)
    k = np.where(i <= n // 2, i, n - i - 1).astype(float)
    if name == "rectangle":
        y = np.ones(n)
    elif name == "triangle":
        y = 1 - np.abs((k - 1 - (n - 1) / 2) / ((n - 1) / 2))
    elif name == "welch":
        y = 1 - ((k - 1 - (n - 1) / 2) / ((n - 1) / 2)) ** 2
    else:
        y = sum((-1) ** m * a * np.cos(2 * np.pi * k * m / (n - 1)) for m, a in enumerate(COSINE_WINDOWS[name]))
    return np.minimum(y, 1.0)


def _check(length: int) -> None:
    if length & (length - 1) or length < 2:
        raise ValueError("an FFT block needs a power of two frames")


def magnitudes(blocks: DataFrame, length: int, window: str = "rectangle") -> DataFrame:
    """The magnitudes of the first length / 2 bins of each block, unnormalised."""
    _check(length)
    w = weights(window, length)
    return _blockwise(blocks, lambda x: np.abs(np.fft.rfft(x * w, axis=1))[:, : length // 2])


def grouped_bins(spectra: DataFrame, start: int, group: int) -> DataFrame:
    """Bars of a display: means of `group` bins each, from bin `start` on; bins beyond the last count as the last."""
    n = F.size("samples")
    at = lambda x, j: F.get("samples", F.least(start + x * group + j, n - 1).cast("int"))
    bars = F.transform(F.sequence(F.lit(0), F.ceil((n - start) / group).cast("int") - 1), lambda x: sum((at(x, j) for j in range(1, group)), at(x, 0)) / group)
    return spectra.withColumn("samples", bars)


def peaks(spectra: DataFrame, rate: float, length: int, n: int = 1) -> DataFrame:
    """The n strongest bins of each block: rank, bin, hz, mel and magnitude; of equal ones the lower bin comes first."""
    pairs = F.transform("samples", lambda m, k: F.struct((-F.round(m, 6)).alias("m"), k.alias("bin")))
    top = F.slice(F.array_sort(pairs), 1, n)
    keys = [c for c in spectra.columns if c != "samples"]
    got = spectra.select(*keys, F.posexplode(top).alias("rank", "p"))
    hz = F.col("p.bin") * F.lit(rate / length)
    return got.select(*keys, (F.col("rank") + 1).alias("rank"), F.col("p.bin").alias("bin"), hz.alias("hz"), F.round(to_mel(hz), 6).alias("mel"), (-F.col("p.m")).alias("magnitude"))


def effect(blocks: DataFrame, length: int, change: Callable[[np.ndarray], np.ndarray], window: str = "hann") -> DataFrame:
    """FFT, a change of the bins, inverse FFT."""
    _check(length)
    w = weights(window, length)
    return _blockwise(blocks, lambda x: np.fft.irfft(change(np.fft.rfft(x * w, axis=1)), length, axis=1))


def robotize(bins: np.ndarray) -> np.ndarray:
    return np.abs(bins).astype(complex)


def whisper(seed: int = 1) -> Callable[[np.ndarray], np.ndarray]:
    """Random phases, the same in every run."""
    return lambda bins: np.abs(bins) * np.exp(2j * np.pi * np.random.default_rng(seed).random(bins.shape[1]))


def pitch_shift(by: int) -> Callable[[np.ndarray], np.ndarray]:
    """Bins move up, or down if by is negative; what is left is 0."""

    def change(bins: np.ndarray) -> np.ndarray:
        out = np.zeros_like(bins)
        if by >= 0:
            out[:, by:] = bins[:, : bins.shape[1] - by]
        else:
            out[:, :by] = bins[:, -by:]
        return out

    return change


def band_gains(gains_db: list[float], rate: float, length: int, low_hz: float = 20.0) -> Callable[[np.ndarray], np.ndarray]:
    """Bands spaced by logarithm from low_hz to half the rate."""
    edges = np.geomspace(low_hz, rate / 2, len(gains_db) + 1)
    band = np.clip(np.searchsorted(edges, np.fft.rfftfreq(length, 1 / rate), "right") - 1, 0, len(gains_db) - 1)
    return lambda bins: bins * (10 ** (np.asarray(gains_db) / 20))[band]


def wake_words(top: DataFrame, templates: DataFrame, n: int, threshold: float) -> DataFrame:
    """(stream_id, block_no, name, percent) where the blocks up to block_no match a template's frames to at least threshold percent.

    top: (stream_id, block_no, rank, hz), the n strongest frequencies of each block, as peaks() gives them; templates: (name, k, rank,
    hz) of recorded frames k = 0, 1, ... A frame matches if at least n - 1 of its n ranks have the same frequency. Frames meet
    blocks by (rank, hz), so only what agrees somewhere is compared, and a match at k counts for the block where its template ends.
    """
    size = templates.groupBy("name").agg((F.max("k") + 1).alias("size"))
    agree = top.join(templates, ["rank", "hz"]).groupBy("stream_id", "block_no", "name", "k").agg(F.count("*").alias("same")).filter(F.col("same") >= max(1, n - 1))
    ends = agree.join(size, "name").withColumn("end", F.col("block_no") + F.col("size") - 1 - F.col("k"))
    held = ends.groupBy("stream_id", "end", "name", "size").agg(F.count("*").alias("frames"))
    blocks = top.select("stream_id", F.col("block_no").alias("end")).distinct()
    first = top.groupBy("stream_id").agg(F.min("block_no").alias("first"))
    whole = held.join(blocks, ["stream_id", "end"]).join(first, "stream_id").filter(F.col("end") - F.col("size") + 1 >= F.col("first"))
    percent = F.col("frames") * 100.0 / F.col("size")
    return whole.filter(percent >= threshold).select("stream_id", F.col("end").alias("block_no"), "name", percent.alias("percent"))


def overlap_add(blocks: DataFrame, stride: int) -> DataFrame:
    """(stream_id, frame_no, y): sums of what blocks give to each frame."""
    each = blocks.select("stream_id", "block_no", F.posexplode("samples").alias("k", "v"))
    return each.groupBy("stream_id", (F.col("block_no") * stride + F.col("k")).alias("frame_no")).agg(F.sum("v").alias("y"))


def autocorrelation(blocks: DataFrame, rate: float, low_hz: float = 50, high_hz: float = 1000) -> DataFrame:
    """The frequency whose lag has the greatest sum of x[i] * x[i + lag]; of equal lags the shorter."""

    def best(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        lags = np.arange(max(1, int(rate / high_hz)), min(n, int(rate / low_hz)))
        if not len(lags):
            return np.zeros((len(x), 1))
        sums = np.stack([(x[:, : n - k] * x[:, k:]).sum(axis=1) for k in lags], axis=1)
        return (rate / lags[sums.argmax(axis=1)])[:, None]

    keys = [c for c in blocks.columns if c != "samples"]
    return _blockwise(blocks, best).select(*keys, F.get("samples", F.lit(0)).alias("hz"))
