"""Formats whose parts can only be found one after another: each row's bytes are walked by a small generator, in Arrow batches.

Files have (path, content), as Spark's `binaryFile` reads them; null content gives no parts, and a walk ends where the bytes break the format.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.functions.formats import little_endian

#: Sample rates by the index in an ADTS header, in Hz (fixed values).
ADTS_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)

#: Text encodings by the first byte of an ID3v2 text frame (fixed values).
ID3_ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


#: Parts that one Arrow batch of a walk holds, by number and by bytes.
WALK_PARTS, WALK_BYTES = 4096, 16 << 20


def walk(files: DataFrame, parts: Callable[[bytes], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """(path, k, *schema): a row for each part, numbered in order. Rows stay in their partitions; nothing is shuffled, and parts of a file leave in batches, so that never all are held."""

    def batches_of(path: str, content: bytes) -> Iterator[pa.RecordBatch]:
        first, held, size = 0, [], 0
        for part in parts(content):
            held.append(part)
            size += sum(len(v) for v in part if isinstance(v, bytes))
            if len(held) >= WALK_PARTS or size >= WALK_BYTES:
                yield batch(path, first, held)
                first, held, size = first + len(held), [], 0
        if held:
            yield batch(path, first, held)

    def batch(path: str, first: int, found: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([path] * len(found), pa.string()), pa.array(range(first, first + len(found)), pa.int32())]
        columns += [pa.array(list(v), f.type) for v, f in zip(zip(*found, strict=True), schema, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["path", "k", *schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                if content.is_valid:
                    yield from batches_of(path, content.as_py())

    return files.select("path", "content").mapInArrow(run, f"path string, k int, {ddl}")


def icy_parts(files: DataFrame, every: int) -> DataFrame:
    """(path, k, audio, metadata) of radio streams: `every` audio bytes, then a length in units of 16 bytes and as much metadata. The last part may be short."""

    def parts(content: bytes) -> Iterator[tuple]:
        at = 0
        while at < len(content):
            audio, at = content[at : at + every], at + every
            size = 16 * content[at] if at < len(content) else 0
            yield audio, content[at + 1 : at + 1 + size].rstrip(b"\0").decode("utf-8", "replace")
            at += 1 + size

    return walk(files, parts, pa.schema([("audio", pa.binary()), ("metadata", pa.string())]), "audio binary, metadata string")


def id3v2_frames(files: DataFrame) -> DataFrame:
    """(path, k, frame, text) of the text frames of a tag of version 2.3 or 2.4 at the start."""

    def size7(b: bytes) -> int:
        return sum(v << 7 * k for k, v in enumerate(reversed(b)))

    def parts(content: bytes) -> Iterator[tuple]:
        if content[:3] != b"ID3" or len(content) < 10 or content[3] not in (3, 4):
            return
        at, end = 10, min(len(content), 10 + size7(content[6:10]))
        while at + 10 <= end and content[at]:
            head = content[at : at + 10]
            size = size7(head[4:8]) if content[3] == 4 else int.from_bytes(head[4:8], "big")
            body = content[at + 10 : min(at + 10 + size, end)]
            if head[:1] == b"T" and body and body[0] < len(ID3_ENCODINGS):
                yield head[:4].decode("latin-1"), body[1:].decode(ID3_ENCODINGS[body[0]], "replace").rstrip("\0")
            at += 10 + size

    return walk(files, parts, pa.schema([("frame", pa.string()), ("text", pa.string())]), "frame string, text string")


def http_chunks(files: DataFrame) -> DataFrame:
    """(path, k, chunk) of a body in chunked transfer encoding, up to the empty chunk."""

    def parts(content: bytes) -> Iterator[tuple]:
        at = 0
        while (line := content.find(b"\r\n", at)) >= 0:
            try:
                size = int(content[at:line].split(b";")[0], 16)
            except ValueError:
                return
            if size <= 0:
                return
            yield (content[line + 2 : line + 2 + size],)
            at = line + 2 + size + 2

    return walk(files, parts, pa.schema([("chunk", pa.binary())]), "chunk binary")


def framed_records(files: DataFrame) -> DataFrame:
    """(path, k, record) of records that each follow their length, a little-endian integer of eight bytes. An incomplete last one is left out."""

    def parts(content: bytes) -> Iterator[tuple]:
        at = 0
        while at + 8 <= len(content):
            end = at + 8 + int.from_bytes(content[at : at + 8], "little")
            if end > len(content):
                return
            yield (content[at + 8 : end],)
            at = end

    return walk(files, parts, pa.schema([("record", pa.binary())]), "record binary")


def adts_header(content: Column) -> list[Column]:
    """profile, rate, channels and frame_bytes of the AAC frame at the start; null if there is none."""
    octet = [little_endian(content, k, 1) for k in range(7)]
    ok = (F.length(content) >= 7) & (octet[0] == 0xFF) & (octet[1].bitwiseAND(0xF6) == 0xF0)
    rate = F.get(F.array(*map(F.lit, ADTS_RATES)), F.shiftright(octet[2], 2).bitwiseAND(15).cast("int"))
    channels = F.shiftleft(octet[2].bitwiseAND(1), 2) + F.shiftright(octet[3], 6)
    size = F.shiftleft(octet[3].bitwiseAND(3), 11) + F.shiftleft(octet[4], 3) + F.shiftright(octet[5], 5)
    found = {"profile": F.shiftright(octet[2], 6) + 1, "rate": rate, "channels": channels, "frame_bytes": size}
    return [F.when(ok, v.cast("int")).alias(n) for n, v in found.items()]


def hamming_encode(nibble: Column) -> Column:
    """Four bits as seven of the (7,4) code: positions 1, 2 and 4 hold parities."""
    d = [F.shiftright(nibble, k).bitwiseAND(1) for k in range(4)]
    bits = [d[0].bitwiseXOR(d[1]).bitwiseXOR(d[3]), d[0].bitwiseXOR(d[2]).bitwiseXOR(d[3]), d[0], d[1].bitwiseXOR(d[2]).bitwiseXOR(d[3]), d[1], d[2], d[3]]
    return sum((F.shiftleft(b, k) for k, b in enumerate(bits[1:], 1)), bits[0])


def hamming_decode(code: Column) -> Column:
    """The four bits of a code of which at most one bit is wrong."""
    bits = [F.shiftright(code, k).bitwiseAND(1) for k in range(7)]
    wrong = F.lit(0)
    for k, b in enumerate(bits, 1):
        wrong = wrong.bitwiseXOR(b * k)
    right = [b.bitwiseXOR((wrong == k).cast("int")) for k, b in enumerate(bits, 1)]
    return right[2] + right[4] * 2 + right[5] * 4 + right[6] * 8


def _padded(content: Column) -> Column:
    """Zero bytes up to the next multiple of four."""
    return F.concat(content, F.unhex(F.repeat(F.lit("00"), F.pmod(-F.length(content), F.lit(4)))))


def _osc_text(text: Column) -> Column:
    return _padded(F.concat(F.encode(text, "utf-8"), F.unhex(F.lit("00"))))


def _big_endian(value: Column, size: int) -> Column:
    return F.unhex(F.substring(F.lpad(F.hex(value.cast("long")), 16, "0"), 17 - 2 * size, 2 * size))


#: Floats of OSC messages by their kind, as numpy names them (fixed values).
FLOATS = {"f": ">f4", "d": ">f8"}


def _float_bytes(form: str) -> Callable[[Column], Column]:
    @F.arrow_udf("binary")
    def packed(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else np.array(v, form).tobytes() for v in values.to_pylist()], pa.binary())

    return packed


def _float_value(form: str) -> Callable[[Column], Column]:
    size = int(form[-1])

    @F.arrow_udf("double")
    def value(content: pa.Array) -> pa.Array:
        return pa.array([float(np.frombuffer(v, form)[0]) if v is not None and len(v) == size else None for v in content.to_pylist()], pa.float64())

    return value


def osc_message(address: Column, kinds: str, values: list[Column]) -> Column:
    """A message with an address and values of kinds i (32 bits), h and t (64 bits), f and d (floats of 32 and 64 bits), s (text) and b (bytes), big-endian, in units of four bytes."""
    parts = [_osc_text(address), _osc_text(F.lit("," + kinds))]
    for kind, value in zip(kinds, values, strict=True):
        if kind == "b":
            parts.append(F.concat(_big_endian(F.length(value), 4), _padded(value)))
        elif kind in FLOATS:
            parts.append(_float_bytes(FLOATS[kind])(value.cast("double")))
        else:
            parts.append(_osc_text(value) if kind == "s" else _big_endian(value, 4 if kind == "i" else 8))
    return F.concat(*parts)


def osc_values(content: Column, kinds: str) -> list[Column]:
    """Of messages: address, format, and the values v0, v1, ... by kinds; values are null where the format is another one."""
    text = F.decode(content, "ISO-8859-1")

    def string(at: Column) -> tuple[Column, Column]:
        """The bytes up to the next zero byte, and what they take."""
        n = F.locate("\0", F.substr(text, at + 1)) - 1
        return F.decode(F.substr(content, at + 1, n), "utf-8"), (F.floor(n / 4) * 4 + 4).cast("int")

    def number(at: Column, size: int) -> Column:
        whole = F.conv(F.hex(F.substr(content, at + 1, F.lit(size))), 16, -10).cast("long")
        return F.when(whole >= 2**31, whole - 2**32).otherwise(whole) if size == 4 else whole

    address, size = string(F.lit(0))
    layout, more = string(size)
    at, out = size + more, [address.alias("address"), F.substring(layout, 2, 1000).alias("format")]
    same = layout == F.lit("," + kinds)
    for k, kind in enumerate(kinds):
        if kind == "s":
            value, size = string(at)
        elif kind == "b":
            n = number(at, 4).cast("int")
            value, size = F.substr(content, at + 5, n), 4 + n + F.pmod(-n, F.lit(4))
        elif kind in FLOATS:
            size = int(FLOATS[kind][-1])
            value = _float_value(FLOATS[kind])(F.substr(content, at + 1, F.lit(size)))
        else:
            size = 4 if kind == "i" else 8
            value = number(at, size)
        out.append(F.when(same, value).alias(f"v{k}"))
        at = at + size
    return out
