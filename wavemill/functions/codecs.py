"""Byte forms of samples, both ways, and headers of frames and files, as Column expressions; walks where parts follow each other."""

from __future__ import annotations

import struct
from binascii import crc_hqx
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.functions.containers import walk
from wavemill.functions.formats import little_endian
from wavemill.functions.metadata import crc16

#: Scale between 8-bit and 16-bit samples, and the middle of unsigned 8-bit ones (fixed values).
L8_SCALE, L8_MIDDLE = 258, 129
#: MPEG audio: kilobits a second by bitrate index 1..14 for version 1, layers 1 to 3, and for versions 2 and 2.5, layer 1 and the others; Hz by rate index for version 1 (fixed values).
MPEG_1_KBITS = {
    1: (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    2: (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    3: (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
}
MPEG_2_KBITS = {1: (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), 2: (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
MPEG_1_RATES = (44100, 48000, 32000)
#: IMA ADPCM: change of the step index by the code's lower three bits (fixed values).
IMA_INDEX = (-1, -1, -1, -1, 2, 4, 6, 8)
#: IMA ADPCM: the 89 step sizes (fixed values).
IMA_STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658,
    724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818,
    18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
#: MP4 boxes that hold boxes (fixed values).
MP4_PARENTS = ("moov", "trak", "mdia", "minf", "stbl", "udta", "dinf")


def l8_encode(x: Column, signed: bool = False) -> Column:
    """A 16-bit sample in eight bits; unsigned ones have their middle at 129."""
    y = F.least(F.greatest((x / L8_SCALE).cast("int"), F.lit(-128)), F.lit(127))
    return y if signed else F.least(F.greatest(y + L8_MIDDLE, F.lit(0)), F.lit(255))


def l8_decode(y: Column, signed: bool = False) -> Column:
    return F.least(F.greatest((y if signed else y - L8_MIDDLE) * L8_SCALE, F.lit(-32767)), F.lit(32767))


def a_law(x: Column) -> Column:
    """G.711 A-law code of a 16-bit sample: sign (set for positive), segment and four bits, with every second bit inverted."""
    m = F.shiftright(F.when(x >= 0, x).otherwise(-x - 1), 3)
    segment = F.greatest(F.floor(F.log2(F.greatest(m, F.lit(1)).cast("double"))).cast("int") - 4, F.lit(0))
    mantissa = F.floor(m / F.pow(F.lit(2), F.greatest(segment, F.lit(1)))).cast("int").bitwiseAND(15)
    return (segment * 16 + mantissa + F.when(x >= 0, 128).otherwise(0)).bitwiseXOR(F.lit(0x55))


def a_law_decoded(code: Column) -> Column:
    """The middle of the code's interval."""
    c = code.bitwiseXOR(F.lit(0x55))
    segment, low = F.shiftright(c.bitwiseAND(0x70), 4), c.bitwiseAND(15) * 16 + 8
    m = F.when(segment == 0, low).otherwise((low + 256) * F.pow(F.lit(2), segment - 1)).cast("int")
    return F.when(c >= 128, m).otherwise(-m)


def pcm_hex(x: Column, size: int, big: bool = False) -> Column:
    """A sample as the hex of its `size` bytes, low byte first, or high byte first (network order)."""
    digits = F.substring(F.lpad(F.hex(x.cast("long")), 16, "0"), 17 - 2 * size, 2 * size)
    return digits if big else F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])


def pcm_bytes(samples: Column, size: int, big: bool = False) -> Column:
    """An array of samples as PCM bytes; null samples have none."""

    def run(lists: pa.Array) -> pa.Array:
        flat = lists.flatten()
        counts = np.bincount(np.asarray(pc.list_parent_indices(lists))[np.asarray(flat.is_valid())], minlength=len(lists)) if len(flat) else np.zeros(len(lists), int)
        octets = np.asarray(flat.drop_null().cast(pa.int64())).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size]
        data = np.ascontiguousarray(octets[:, ::-1] if big else octets)
        ends = np.concatenate([[0], np.cumsum(counts) * size]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(lists), [lists.is_valid().buffers()[1], pa.py_buffer(ends), pa.py_buffer(data)])

    return F.arrow_udf(run, T.BinaryType())(samples)


def pcm_samples(content: Column, size: int, big: bool = False) -> Column:
    """PCM bytes as an array of signed samples; an incomplete last one is left out."""

    def run(contents: pa.Array) -> pa.Array:
        whole = [b"" if c is None else c[: len(c) // size * size] for c in contents.to_pylist()]
        octets = np.frombuffer(b"".join(whole), np.uint8).reshape(-1, size)
        wide = np.zeros((len(octets), 8), np.uint8)
        wide[:, 8 - size :] = octets[:, ::-1] if big else octets
        ends = np.concatenate([[0], np.cumsum([len(c) // size for c in whole])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(wide.view("<i8").ravel() >> (64 - 8 * size)))

    return F.arrow_udf(run, T.ArrayType(T.LongType()))(content)


def wav_bytes(samples: Column, rate: int, channels: int, bits: int = 16) -> Column:
    """Interleaved samples as a WAV file: a header of 44 bytes and PCM data."""
    size = bits // 8
    data = F.size(samples) * size
    number = lambda v, n: F.unhex(pcm_hex(v if isinstance(v, Column) else F.lit(v), n))
    head = [F.encode(F.lit("RIFF"), "utf-8"), number(data + 36, 4), F.encode(F.lit("WAVEfmt "), "utf-8"), number(16, 4), number(1, 2), number(channels, 2), number(rate, 4), number(rate * channels * size, 4), number(channels * size, 2), number(bits, 2)]
    return F.concat(*head, F.encode(F.lit("data"), "utf-8"), number(data, 4), pcm_bytes(samples, size))


def csv_samples(line: Column, delimiter: str = ",") -> Column:
    """The integers of a CSV line; what is none becomes null."""
    return F.transform(F.split(line, delimiter), lambda v: F.trim(v).try_cast("int"))


def base64_decoded(text: Column) -> Column:
    """Base64 text, in lines or not, as text again; null where it isn't base64."""
    return F.decode(F.try_to_binary(F.regexp_replace(text, r"\s", ""), F.lit("base64")), "utf-8")


def without_tags(content: Column) -> Column:
    """Bytes without an ID3v2 tag at the start and an ID3v1 tag of 128 bytes at the end."""
    octet = [little_endian(content, 6 + k, 1) for k in range(4)]
    size = 10 + sum((F.shiftleft(b.bitwiseAND(127), 7 * (3 - k)) for k, b in enumerate(octet)), F.lit(0))
    first = F.when(F.substring(content, 1, 3) == F.encode(F.lit("ID3"), "utf-8"), size).otherwise(0).cast("int")
    n = F.length(content)
    last = F.when((n >= first + 128) & (F.substr(content, n - 127, F.lit(3)) == F.encode(F.lit("TAG"), "utf-8")), 128).otherwise(0)
    return F.substr(content, first + 1, F.greatest(n - first - last, F.lit(0)))


def _pick(values: tuple, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def mpeg_header(content: Column) -> list[Column]:
    """version (1, 2 or 2.5), layer, kbits, rate, channels, padding and frame_bytes of the MPEG audio frame at the start; null if there is none or a field is reserved."""
    b1, b2, b3 = (little_endian(content, k, 1) for k in (1, 2, 3))
    version = _pick((2.5, None, 2.0, 1.0), F.shiftright(b1, 3).bitwiseAND(3))
    layer = _pick((None, 3, 2, 1), F.shiftright(b1, 1).bitwiseAND(3))
    index, padding = F.shiftright(b2, 4), F.shiftright(b2, 1).bitwiseAND(1)
    tables = [F.when((version == 1) & (layer == k), _pick(v, index - 1)) for k, v in MPEG_1_KBITS.items()]
    tables += [F.when((version != 1) & ((layer == 1) if k == 1 else (layer > 1)), _pick(v, index - 1)) for k, v in MPEG_2_KBITS.items()]
    kbits = F.when(index == 0, 0).otherwise(F.coalesce(*tables))
    rate = F.floor(_pick(MPEG_1_RATES, F.shiftright(b2, 2).bitwiseAND(3)) / F.when(version == 1, 1).when(version == 2, 2).otherwise(4)).cast("int")
    size = F.floor(F.when(version == 1, 144).otherwise(72) * kbits * 1000 / rate) + padding
    ok = (F.length(content) >= 4) & (little_endian(content, 0, 1) == 0xFF) & (b1 >= 0xE0) & version.isNotNull() & layer.isNotNull() & kbits.isNotNull() & rate.isNotNull()
    found = {"version": version, "layer": layer, "kbits": kbits, "rate": rate, "channels": F.when(b3 >= 192, 1).otherwise(2), "padding": padding.cast("int"), "frame_bytes": size.cast("int")}
    return [F.when(ok, v).alias(n) for n, v in found.items()]


def _mpeg_size(head: bytes) -> int:
    """Bytes of the MPEG audio frame whose header these four bytes are; 0 if it is none."""
    version, layer = head[1] >> 3 & 3, 4 - (head[1] >> 1 & 3)
    index, rate = head[2] >> 4, head[2] >> 2 & 3
    if head[0] != 0xFF or head[1] < 0xE0 or version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return 0
    kbits = MPEG_1_KBITS[layer] if version == 3 else MPEG_2_KBITS[min(layer, 2)]
    hz = MPEG_1_RATES[rate] // {3: 1, 2: 2, 0: 4}[version]
    return (144 if version == 3 else 72) * kbits[index - 1] * 1000 // hz + (head[2] >> 1 & 1)


def _adts_size(head: bytes) -> int:
    """Bytes of the AAC frame whose header these seven bytes are; 0 if it is none."""
    size = (head[3] & 3) << 11 | head[4] << 3 | head[5] >> 5
    return size if head[0] == 0xFF and head[1] & 0xF6 == 0xF0 and size >= 7 else 0


def audio_frames(files: DataFrame, kind: str) -> DataFrame:
    """(path, k, at, frame) of MPEG audio (`mpeg`) or AAC files (`adts`): frames one after another. What is no frame is skipped up to the next header; an incomplete last frame is left out."""
    size_of, head = {"mpeg": (_mpeg_size, 4), "adts": (_adts_size, 7)}[kind]

    def parts(content: bytes) -> Iterator[tuple]:
        at = 0
        while 0 <= at <= len(content) - head:
            size = size_of(content[at : at + head])
            if size and at + size <= len(content):
                yield at, content[at : at + size]
                at += size
            else:
                at = content.find(b"\xff", at + 1)

    return walk(files, parts, pa.schema([("at", pa.int64()), ("frame", pa.binary())]), "at long, frame binary")


def transport_packets(files: DataFrame) -> DataFrame:
    """(path, k, pid, starts, counter, payload) of MPEG transport streams: packets of 188 bytes that begin with 0x47; payload is what follows the header and the adaptation field."""
    n = F.floor(F.length("content") / 188).cast("int")
    each = files.filter(n > 0).select("path", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"), "content").select("path", "k", F.substring("content", F.col("k") * 188 + 1, 188).alias("p"))
    b = [little_endian(F.col("p"), k, 1) for k in range(5)]
    skip = F.when(F.shiftright(b[3], 4).bitwiseAND(2) > 0, 5 + b[4]).otherwise(4)
    payload = F.when(F.shiftright(b[3], 4).bitwiseAND(1) > 0, F.substr("p", skip.cast("int") + 1))
    pid = F.shiftleft(b[1].bitwiseAND(31), 8) + b[2]
    return each.filter(b[0] == 0x47).select("path", "k", pid.cast("int").alias("pid"), (b[1].bitwiseAND(64) > 0).alias("starts"), b[3].bitwiseAND(15).cast("int").alias("counter"), payload.alias("payload"))


def chunks(files: DataFrame) -> DataFrame:
    """(path, k, depth, id, kind, at, size) of RIFF files (WAV, AVI) in order: chunks, and lists with what they hold; at is where a chunk's data begins."""

    def parts(content: bytes) -> Iterator[tuple]:
        def inside(at: int, end: int, depth: int) -> Iterator[tuple]:
            while at + 8 <= end:
                name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
                if at + 8 + size > end:
                    return
                group = name in (b"RIFF", b"LIST") and size >= 4
                yield depth, name.decode("latin-1"), content[at + 8 : at + 12].decode("latin-1") if group else None, at + 8, size
                if group:
                    yield from inside(at + 12, at + 8 + size, depth + 1)
                at += 8 + size + (size & 1)

        return inside(0, len(content), 0)

    return walk(files, parts, pa.schema([("depth", pa.int32()), ("id", pa.string()), ("kind", pa.string()), ("at", pa.int64()), ("size", pa.int64())]), "depth int, id string, kind string, at long, size long")


def boxes(files: DataFrame) -> DataFrame:
    """(path, k, depth, type, at, size) of MP4 files in order: boxes, and those inside boxes that hold boxes; at is where a box's content begins, size its content's bytes. Size 0 means to the end, 1 a size of 64 bits."""

    def parts(content: bytes) -> Iterator[tuple]:
        def inside(at: int, end: int, depth: int) -> Iterator[tuple]:
            while at + 8 <= end:
                size, name, head = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8].decode("latin-1"), 8
                if size == 1 and at + 16 <= end:
                    size, head = int.from_bytes(content[at + 8 : at + 16], "big"), 16
                size = size or end - at
                if size < head or at + size > end:
                    return
                yield depth, name, at + head, size - head
                if name in MP4_PARENTS:
                    yield from inside(at + head, at + size, depth + 1)
                at += size

        return inside(0, len(content), 0)

    return walk(files, parts, pa.schema([("depth", pa.int32()), ("type", pa.string()), ("at", pa.int64()), ("size", pa.int64())]), "depth int, type string, at long, size long")


def ima_samples(files: DataFrame) -> DataFrame:
    """(path, k, x) of one mono block of IMA ADPCM: a first sample (16 bits), a step index and a zero byte, then two codes a byte, the lower one first."""

    def parts(content: bytes) -> Iterator[tuple]:
        if len(content) < 4:
            return
        x, index = struct.unpack("<hB", content[:3])
        index = min(index, 88)
        yield (x,)
        for byte in content[4:]:
            for code in (byte & 15, byte >> 4):
                step = IMA_STEPS[index]
                change = (step >> 3) + sum(step >> 2 - k for k in range(3) if code >> k & 1)
                x = min(max(x - change if code & 8 else x + change, -32768), 32767)
                index = min(max(index + IMA_INDEX[code & 7], 0), 88)
                yield (x,)

    return walk(files, parts, pa.schema([("x", pa.int32())]), "x int")


def dsf_header(content: Column) -> list[Column]:
    """channels, rate, bits and samples (a channel) of a DSF file, whose `fmt ` chunk follows its head of 28 bytes; null if it is none."""
    ok = (F.substring(content, 1, 4) == F.encode(F.lit("DSD "), "utf-8")) & (F.substring(content, 29, 4) == F.encode(F.lit("fmt "), "utf-8"))
    found = {"channels": (52, 4), "rate": (56, 4), "bits": (60, 4), "samples": (64, 8)}
    return [F.when(ok, little_endian(content, *p)).alias(n) for n, p in found.items()]


def hdlc_content(frame: Column) -> Column:
    """The content of a frame given as hex, without flags, escapes and CRC; null where flags are missing or the CRC is another one."""
    body = F.regexp_extract(frame, "^7E((?:..)*)7E$", 1)
    octets = F.regexp_replace(body, "(..)", "$1 ")
    plain = F.replace(F.replace(F.replace(octets, F.lit("7D 5E "), F.lit("7E ")), F.lit("7D 5D "), F.lit("7D ")), F.lit(" "), F.lit(""))
    content = F.unhex(F.substr(plain, F.lit(1), F.length(plain) - 4))
    crc = F.lpad(F.hex(crc16(content)), 4, "0")
    return F.when((F.length(plain) >= 4) & (F.substr(plain, F.length(plain) - 3) == crc), content)


def hdlc_frames(files: DataFrame) -> DataFrame:
    """(path, k, content) of the frames in byte streams (path, content): what lies between flags (0x7E), without escapes, where its last two bytes are its CRC. Other bytes and broken frames are left out; k counts those that are whole."""

    def parts(content: bytes) -> Iterator[tuple]:
        start = content.find(b"\x7e")
        while start >= 0 and (end := content.find(b"\x7e", start + 1)) >= 0:
            plain = content[start + 1 : end].replace(b"\x7d\x5e", b"\x7e").replace(b"\x7d\x5d", b"\x7d")
            if len(plain) > 2 and crc_hqx(plain[:-2], 0xFFFF) == int.from_bytes(plain[-2:], "big"):
                yield (plain[:-2],)
            start = end

    return walk(files, parts, pa.schema([("content", pa.binary())]), "content binary")
