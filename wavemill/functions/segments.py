"""Segments of a binary container, records of a synchronised transfer, streams of AVI files, and decoding by detected type."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions import codecs, dsd, formats, metadata, wav
from wavemill.functions.containers import walk

#: Kinds of segments by their number (fixed values).
SEGMENTS = {1: "header", 2: "audio", 3: "meta", 4: "video_header", 5: "video"}
#: First byte and kinds of transfer records by their number (fixed values).
SYNC_APP, SYNC_RECORDS = 123, {1: "begin", 2: "send", 3: "receive", 4: "end"}
#: Key frames in an AVI index (fixed value).
AVI_KEY = 0x10
_SEGMENT_HEAD = 8


def _little(value: Column | int, size: int) -> Column:
    return F.unhex(codecs.pcm_hex(F.lit(value) if isinstance(value, int) else value, size))


def check_sum(content: Column) -> Column:
    """All bytes of content xor-ed."""
    return F.aggregate(metadata._octets(content), F.lit(0), lambda acc, b: acc.bitwiseXOR(b))


def segment(kind: str, payload: Column) -> Column:
    """A segment: CR LF, its kind, its length with the head of eight bytes (a header's without), the check sum of audio and video, and the payload."""
    number = next(n for n, name in SEGMENTS.items() if name == kind)
    plain = kind in ("header", "video_header")
    total = F.length(payload) + (0 if plain else _SEGMENT_HEAD)
    check = check_sum(payload) if kind in ("audio", "video") else F.lit(0)
    return F.concat(F.unhex(F.lit("0D0A")), _little(number, 1), _little(0, 1), _little(total, 2), _little(check, 1), _little(0, 1), payload)


def audio_info(rate: Column | int, channels: Column | int, bits: Column | int) -> Column:
    """The payload of a header segment."""
    return F.concat(_little(rate, 4), _little(channels, 2), _little(bits, 1), _little(0, 1))


def segments(files: DataFrame) -> DataFrame:
    """(path, k, kind, at, payload, rate, channels, bits) of binary containers: rate, channels and bits of the last header before a segment. Bytes that are no segment, and segments of a wrong check sum, are passed over up to the next CR LF; an incomplete last one is left out."""

    def parts(content: bytes) -> Iterator[tuple]:
        info, at = (None, None, None), content.find(b"\r\n")
        while 0 <= at <= len(content) - _SEGMENT_HEAD:
            kind = SEGMENTS.get(content[at + 2])
            size = int.from_bytes(content[at + 4 : at + 6], "little")
            plain = kind in ("header", "video_header")
            end = at + size + (_SEGMENT_HEAD if plain else 0)
            payload = content[at + _SEGMENT_HEAD : end]
            check = 0
            if kind in ("audio", "video"):
                for b in payload:
                    check ^= b
            ok = kind and end >= at + _SEGMENT_HEAD and end <= len(content) and (kind not in ("audio", "video") or check == content[at + 6])
            if not ok:
                at = content.find(b"\r\n", at + 2)
                continue
            if kind == "header" and len(payload) >= 7:
                info = int.from_bytes(payload[:4], "little"), int.from_bytes(payload[4:6], "little"), payload[6]
            yield kind, at, payload, *info
            at = content.find(b"\r\n", end)

    schema = pa.schema([("kind", pa.string()), ("at", pa.int64()), ("payload", pa.binary()), *((n, pa.int32()) for n in ("rate", "channels", "bits"))])
    return walk(files, parts, schema, "kind string, at long, payload binary, rate int, channels int, bits int")


def sync_record(kind: str, seq: Column, payload: Column | None = None) -> Column:
    """A record of a transfer: begin (its payload is that of audio_info() and a byte of the type), send (with data), receive (payload: how much may come, two bytes) or end."""
    number = next(n for n, name in SYNC_RECORDS.items() if name == kind)
    head = F.concat(_little(SYNC_APP, 1), _little(number, 1), _little(seq, 2))
    if kind == "send":
        return F.concat(head, _little(F.length(payload), 2), payload)
    if kind == "begin":
        return F.concat(head, F.rpad(payload, 12, b"\x00"))
    return head if payload is None else F.concat(head, payload)


def sync_records(files: DataFrame) -> DataFrame:
    """(path, k, kind, seq, payload, missing): records of a transfer in order, with how many sequence numbers (of 16 bits) lie between this one and the one before. The walk ends where no record begins or one is incomplete."""

    def parts(content: bytes) -> Iterator[tuple]:
        at = 0
        while at + 4 <= len(content) and content[at] == SYNC_APP and (kind := SYNC_RECORDS.get(content[at + 1])):
            seq, body = int.from_bytes(content[at + 2 : at + 4], "little"), at + 4
            if kind == "send":
                size, body = int.from_bytes(content[body : body + 2], "little"), body + 2
            else:
                size = {"begin": 12, "receive": 2, "end": 0}[kind]
            if body + size > len(content):
                return
            yield kind, seq, content[body : body + size]
            at = body + size

    got = walk(files, parts, pa.schema([("kind", pa.string()), ("seq", pa.int32()), ("payload", pa.binary())]), "kind string, seq int, payload binary")
    before = F.lag("seq").over(Window.partitionBy("path").orderBy("k"))
    return got.withColumn("missing", F.coalesce(F.pmod(F.col("seq") - before - 1, F.lit(65536)), F.lit(0)))


def avi_streams(files: DataFrame) -> DataFrame:
    """(path, stream, kind, handler, per_second, rate, channels, bits, width, height) of AVI files: kind is `auds`, `vids` or another, handler the codec's four letters, per_second the samples or frames a second; rate, channels and bits of audio, width and height of video, else null. Streams are numbered by their lists; a list's format follows its header."""
    found = codecs.chunks(files)
    own = found.filter("id in ('strh', 'strf')").join(files.select("path", "content"), "path")
    body = own.select("path", "k", "id", F.substr("content", (F.col("at") + 1).cast("int"), F.col("size").cast("int")).alias("b"))
    order = Window.partitionBy("path").orderBy("k")
    body = body.withColumn("stream", F.sum(F.when(F.col("id") == "strh", 1).otherwise(0)).over(order) - 1)
    four = lambda at: F.decode(F.substring("b", at + 1, 4), "ISO-8859-1")
    number = lambda at, n: formats.little_endian(F.col("b"), at, n)
    heads = body.filter("id = 'strh' and length(b) >= 28").select("path", "stream", four(0).alias("kind"), four(4).alias("handler"), (number(24, 4) / F.nullif(number(20, 4), F.lit(0))).alias("per_second"))
    tails = body.filter("id = 'strf'").groupBy("path", "stream").agg(F.min_by("b", "k").alias("b"))
    met = heads.join(tails, ["path", "stream"], "left")
    audio = {"channels": (2, 2), "rate": (4, 4), "bits": (14, 2)}
    video = {"width": (4, 4), "height": (8, 4)}
    fields = [F.when((F.col("kind") == kind) & (F.length("b") >= p[0] + p[1]), number(*p)).alias(n) for kind, own in (("auds", audio), ("vids", video)) for n, p in own.items()]
    return met.select("path", F.col("stream").cast("int").alias("stream"), "kind", "handler", "per_second", *fields).select("path", "stream", "kind", "handler", "per_second", "rate", "channels", "bits", "width", "height")


def avi_samples(files: DataFrame) -> DataFrame:
    """(path, stream, k, kind, at, size, key, bytes) of what a `movi` list holds: the k-th chunk of each stream, kind being its last two letters (wb audio; dc, db video); key is true where the index marks it, null without an entry. The index is joined by a chunk's place: entries count from the list's name, or from the file's beginning."""
    found = codecs.chunks(files)
    movi = found.filter("kind = 'movi'").groupBy("path").agg(F.min("at").alias("movi"), F.min("k").alias("list"))
    data = found.filter(F.col("id").rlike("^[0-9]{2}(wb|dc|db|pc|tx)$")).join(movi, "path").filter("k > list")
    own = files.select("path", "content")
    index = found.filter("id = 'idx1' and size >= 16").join(own, "path").select("path", F.substr("content", (F.col("at") + 1).cast("int"), F.col("size").cast("int")).alias("b"))
    entry = index.select("path", "b", F.explode(F.sequence(F.lit(0), F.floor(F.length("b") / 16).cast("int") - 1)).alias("n")).select("path", F.substr("b", F.col("n") * 16 + 1, F.lit(16)).alias("e"))
    entry = entry.select("path", F.decode(F.substring("e", 1, 4), "ISO-8859-1").alias("id"), formats.little_endian(F.col("e"), 4, 4).alias("flags"), formats.little_endian(F.col("e"), 8, 4).alias("offset"))
    # offsets from the beginning of the file reach behind the list's name
    entry = entry.join(movi.select("path", "movi"), "path").select("path", "id", F.when(F.col("offset") >= F.col("movi"), F.col("offset")).otherwise(F.col("movi") + F.col("offset")).alias("place"), (F.col("flags").bitwiseAND(AVI_KEY) > 0).alias("key"))
    order = Window.partitionBy("path", "stream").orderBy("at")
    each = data.withColumn("place", F.col("at") - 8).join(entry.dropDuplicates(["path", "id", "place"]), ["path", "id", "place"], "left").withColumn("stream", F.substring("id", 1, 2).cast("int"))
    placed = each.select("path", "stream", (F.row_number().over(order) - 1).cast("long").alias("k"), F.substring("id", 3, 2).alias("kind"), "at", "size", "key")
    return placed.join(own, "path").select(*placed.columns, F.substr("content", (F.col("at") + 1).cast("int"), F.col("size").cast("int")).alias("bytes"))


def decode_any(files: DataFrame, dsd_factor: int = 64) -> DataFrame:
    """(path, type, k, samples, frame) of files of any type that this library knows, told by their first bytes: frames of samples of WAV (PCM, floats, logarithmic, ADPCM) and DSF files; MPEG and AAC files, whose codecs it doesn't have, give their encoded frames. Others are left out. A file is read by the one decoder of its type, and the decoders' results are put together."""
    typed = files.select("path", "content", metadata.type_by_bytes(F.col("content")).alias("type"))
    of = lambda *kinds: typed.filter(F.col("type").isin(*kinds)).select("path", "content")
    empty = F.lit(None).cast("binary").alias("frame")
    sampled = [wav.wav_frames(of("audio/wav", "audio/adpcm")), dsd.dsd_frames(of("audio/dsf"), dsd_factor)]
    parts = [df.select("path", F.col("frame_no").alias("k"), "samples", empty) for df in sampled]
    framed = [codecs.audio_frames(of("audio/mpeg").select("path", codecs.without_tags(F.col("content")).alias("content")), "mpeg"), codecs.audio_frames(of("audio/aac"), "adts")]
    parts += [df.select("path", F.col("k").cast("long").alias("k"), F.lit(None).cast("array<bigint>").alias("samples"), "frame") for df in framed]
    return reduce(DataFrame.unionByName, parts).join(typed.select("path", "type"), "path").select("path", "type", "k", "samples", "frame")
