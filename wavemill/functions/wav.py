"""WAV files as they are found: chunks in any order, PCM of 8 to 32 bits, floats, A-law, mu-law and IMA ADPCM.

The `data` chunk is looked for behind whatever comes before it, and ends where its size says; a size of 0 or of 0x7FFF0000 and more,
as streams have it, means the end of the file. Chunks of odd size have a byte of padding. Files without `fmt ` before `data`, and
of other formats, are left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions.codecs import IMA_INDEX, IMA_STEPS
from wavemill.functions.containers import walk

#: Format tags (fixed values).
PCM, FLOAT, A_LAW, MU_LAW, IMA, EXTENSIBLE = 1, 3, 6, 7, 0x11, 0xFFFE
#: Sizes of `data` from here on mean that the writer didn't know it (fixed value).
UNKNOWN_SIZE = 0x7FFF0000
FRAMES_A_BATCH = 1 << 15

_STEPS, _INDEX = np.asarray(IMA_STEPS, np.int64), np.asarray(IMA_INDEX, np.int64)


@dataclass
class Layout:
    format: int
    channels: int
    rate: int
    bits: int
    block: int
    at: int
    size: int
    samples: int | None  # frames by the `fact` chunk

    @property
    def frames(self) -> int:
        if self.format == IMA:
            whole, rest = divmod(self.size, self.block)
            n = whole * self._in_block(self.block) + self._in_block(rest)
            return n if self.samples is None else min(n, self.samples)
        return self.size // (self.channels * (self.bits // 8))

    def _in_block(self, size: int) -> int:
        """Frames of an IMA block: one in its head, and two a byte after it in words of four bytes a channel."""
        words = (size - 4 * self.channels) // (4 * self.channels)
        return 8 * words + 1 if size >= 4 * self.channels else 0


def layout(content: bytes) -> Layout | None:
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, fmt, fact = 12, None, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        body = at + 8
        if name == b"fmt " and size >= 16 and body + 16 <= len(content):
            fmt = struct.unpack_from("<HHIIHH", content, body)
            if fmt[0] == EXTENSIBLE and size >= 26:
                fmt = (int.from_bytes(content[body + 24 : body + 26], "little"), *fmt[1:])
        elif name == b"fact" and size >= 4:
            fact = int.from_bytes(content[body : body + 4], "little")
        elif name == b"data":
            if fmt is None:
                return None
            left = len(content) - body
            kind, channels, rate, _, block, bits = fmt
            known = (kind == PCM and bits in (8, 16, 24, 32)) or (kind == FLOAT and bits in (32, 64)) or (kind in (A_LAW, MU_LAW) and bits == 8) or (kind == IMA and bits == 4 and block > 4 * channels)
            return Layout(kind, channels, rate, bits, block, body, left if size == 0 or size >= UNKNOWN_SIZE else min(size, left), fact) if known and channels else None
        at = body + size + (size & 1)
    return None


def wav_header(files: DataFrame) -> DataFrame:
    """path, format (its tag), channels, rate, bits and frames of files as binaryFile reads them."""

    def parts(content: bytes) -> Iterator[tuple]:
        if found := layout(content):
            yield found.format, found.channels, found.rate, found.bits, found.frames

    names = ("format", "channels", "rate", "bits", "frames")
    return walk(files, parts, pa.schema([(n, pa.int64()) for n in names]), ", ".join(f"{n} long" for n in names)).drop("k")


def _expand_mu_law(code: np.ndarray) -> np.ndarray:
    c = 255 - code.astype(np.int64)
    m = ((c & 15) * 8 + 132 << ((c & 127) >> 4)) - 132
    return np.where(c >= 128, -m, m)


def _expand_a_law(code: np.ndarray) -> np.ndarray:
    c = code.astype(np.int64) ^ 0x55
    segment, low = (c & 0x70) >> 4, (c & 15) * 16 + 8
    m = np.where(segment == 0, low, (low + 256) << np.maximum(segment - 1, 0))
    return np.where(c >= 128, m, -m)


def ima_decode(blocks: np.ndarray, channels: int) -> np.ndarray:
    """(blocks, frames, channels) of IMA blocks of equal size (rows of bytes): heads of four bytes a channel, then words of four bytes a channel in turn, lower codes first. Blocks are independent, so each step is taken for all at once."""
    n = len(blocks)
    heads = blocks[:, : 4 * channels].reshape(n, channels, 4)
    x = np.ascontiguousarray(heads[:, :, :2]).view("<i2")[:, :, 0].astype(np.int64)
    index = np.minimum(heads[:, :, 2].astype(np.int64), 88)
    words = (blocks.shape[1] - 4 * channels) // (4 * channels)
    body = blocks[:, 4 * channels : 4 * channels * (1 + words)].reshape(n, words, channels, 4)
    codes = np.stack([body & 15, body >> 4], axis=-1).transpose(0, 1, 3, 4, 2).reshape(n, 8 * words, channels).astype(np.int64)
    out = np.empty((n, 8 * words + 1, channels), np.int64)
    out[:, 0] = x
    for k in range(8 * words):
        x, index = _ima_step(x, index, codes[:, k])
        out[:, k + 1] = x
    return out


def _ima_step(x: np.ndarray, index: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = _STEPS[index]
    change = (step >> 3) + sum((step >> 2 - k) * (code >> k & 1) for k in range(3))
    return np.clip(np.where(code & 8, x - change, x + change), -32768, 32767), np.clip(index + _INDEX[code & 7], 0, 88)


def ima_encode(frames: np.ndarray, block: int) -> bytes:
    """IMA blocks of `block` bytes of 16-bit frames (rows); each block begins anew with its first frame and step index 0. The last block is filled with its last frame."""
    channels = frames.shape[1]
    words = (block - 4 * channels) // (4 * channels)
    each = 8 * words + 1
    n = -(-len(frames) // each)
    if not n:
        return b""
    padded = np.concatenate([frames, np.repeat(frames[-1:], n * each - len(frames), axis=0)]).astype(np.int64).reshape(n, each, channels)
    x, index = padded[:, 0], np.zeros((n, channels), np.int64)
    codes = np.empty((n, each - 1, channels), np.uint8)
    head = np.zeros((n, channels, 4), np.uint8)
    head[:, :, :2] = np.ascontiguousarray(x.astype("<i2"))[:, :, None].view(np.uint8)
    for k in range(each - 1):
        rest, code = padded[:, k + 1] - x, np.zeros_like(x)
        code |= np.where(rest < 0, 8, 0)
        rest, step = np.abs(rest), _STEPS[index]
        for b in (4, 2, 1):
            over = rest >= step
            code |= np.where(over, b, 0)
            rest, step = np.where(over, rest - step, rest), step >> 1
        x, index = _ima_step(x, index, code)
        codes[:, k] = code
    pairs = codes.reshape(n, words, 4, 2, channels)
    body = (pairs[:, :, :, 0] | pairs[:, :, :, 1] << 4).transpose(0, 1, 3, 2)
    return np.concatenate([head.reshape(n, -1), body.reshape(n, -1)], axis=1).tobytes()


def _samples(content: bytes, own: Layout) -> Iterator[np.ndarray]:
    """Frames (rows of channels) in order, in batches."""
    if own.format == IMA:
        each = max(1, FRAMES_A_BATCH // own._in_block(own.block))
        left = own.frames
        for at in range(own.at, own.at + own.size, each * own.block):
            data = np.frombuffer(content, np.uint8, min(each * own.block, own.at + own.size - at), at)
            whole = len(data) // own.block * own.block
            for part in (data[:whole].reshape(-1, own.block), data[whole:][None]):
                if part.size >= 4 * own.channels:
                    got = ima_decode(part, own.channels).reshape(-1, own.channels)[:left]
                    left -= len(got)
                    yield got
        return
    width = own.bits // 8
    frame = own.channels * width
    for k in range(0, own.frames, FRAMES_A_BATCH):
        n = min(FRAMES_A_BATCH, own.frames - k) * own.channels
        at = own.at + k * frame
        if own.format == FLOAT:
            v = np.frombuffer(content, f"<f{width}", n, at).astype(float)
            x = np.trunc(np.clip(np.nan_to_num(v, nan=0.0), -1, 1) * 32767).astype(np.int64)
        elif own.format in (A_LAW, MU_LAW):
            x = (_expand_a_law if own.format == A_LAW else _expand_mu_law)(np.frombuffer(content, np.uint8, n, at))
        elif width == 1:
            x = np.frombuffer(content, np.uint8, n, at).astype(np.int64) - 128
        elif width == 3:
            b = np.frombuffer(content, np.uint8, 3 * n, at).reshape(-1, 3).astype(np.int64)
            u = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
            x = u - (u >> 23 << 24)
        else:
            x = np.frombuffer(content, f"<i{width}", n, at).astype(np.int64)
        yield x.reshape(-1, own.channels)


def wav_frames(files: DataFrame, bits: int | None = None) -> DataFrame:
    """(path, frame_no, samples) of WAV files, of those with `bits` bits a sample if given. PCM keeps its range (8 bits are unsigned in the file and signed here); floats, A-law, mu-law and ADPCM become 16-bit samples. An incomplete last frame is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                own = layout(content.as_py()) if content.is_valid else None
                if own is None or bits not in (None, own.bits):
                    continue
                first = 0
                for x in _samples(content.as_py(), own):
                    n = len(x)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * own.channels), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.arange(first, first + n, dtype=np.int64)), lists], ["path", "frame_no", "samples"])
                    first += n

    return files.select("path", "content").mapInArrow(run, "path string, frame_no long, samples array<bigint>")


def ima_wav(files: DataFrame, rate: int, channels: int, block: int = 256) -> DataFrame:
    """(path, content): WAV files of IMA ADPCM from (path, samples), interleaved 16-bit samples; `block` bytes a block."""

    @F.arrow_udf("binary")
    def made(samples: pa.Array) -> pa.Array:
        out = []
        for own in samples:
            x = own.values.to_numpy(zero_copy_only=False).astype(np.int64) if own.is_valid else np.zeros(0, np.int64)
            x = x[: len(x) // channels * channels].reshape(-1, channels)
            data = ima_encode(x, block)
            each = 8 * ((block - 4 * channels) // (4 * channels)) + 1
            head = struct.pack("<4sI4s4sIHHIIHHHH4sII4sI", b"RIFF", 52 + len(data), b"WAVE", b"fmt ", 20, IMA, channels, rate, rate * block // each, block, 4, 2, each, b"fact", 4, len(x), b"data", len(data))
            out.append(head + data)
        return pa.array(out, pa.binary())

    return files.select("path", made("samples").alias("content"))
