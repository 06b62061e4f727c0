"""Tracks of MP4 and M4A files: sample tables, which say where each sample lies, and the samples.

A track's tables are run-length coded: `stsc` gives samples a chunk for runs of chunks, `stco` or `co64` where chunks begin, `stsz` the
sizes of samples, `stts` how long runs of samples last. A walk of the boxes reads them; runs are then expanded and joined as tables,
offsets inside a chunk are prefix sums of sizes, and only the last step slices the bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.codecs import pcm_hex
from wavemill.functions.containers import walk

#: Boxes on the way to a track's tables (fixed values).
PARENTS = (b"moov", b"trak", b"mdia", b"minf", b"stbl")
#: Entries of each table as its number of columns and their width in bytes (fixed values): chunk runs, chunk offsets, and runs of durations.
ENTRIES = {b"stsc": (3, 4), b"stco": (1, 4), b"co64": (1, 8), b"stts": (2, 4)}
TABLE = ["path", "track"]


def mp4_tables(files: DataFrame) -> DataFrame:
    """(path, track, kind, entry, a, b) of every track, tracks and entries from 0: `stsz` (a size; b samples of it), `stsc` (first chunk, from 0; samples a chunk), `stco` (offset), `stts` (b samples last a each), and one `codec` (see codec_of). Entries beyond the file's or the box's end are left out."""

    def parts(content: bytes) -> Iterator[tuple]:
        track = -1

        def inside(at: int, end: int) -> Iterator[tuple]:
            nonlocal track
            while at + 8 <= end:
                size, name, head = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8], 8
                if size == 1 and at + 16 <= end:
                    size, head = int.from_bytes(content[at + 8 : at + 16], "big"), 16
                size = size or end - at
                if size < head or at + size > end:
                    return
                body, last = at + head, at + size
                track += name == b"trak"
                if name in PARENTS:
                    yield from inside(body, last)
                elif name == b"stsz" and body + 12 <= last:
                    each, n = struct.unpack_from(">II", content, body + 4)
                    if each:
                        yield track, "stsz", 0, each, n
                    else:
                        n = min(n, (last - body - 12) // 4)
                        for k, (v,) in enumerate(struct.iter_unpack(">I", content[body + 12 : body + 12 + 4 * n])):
                            yield track, "stsz", k, v, 1
                elif name in ENTRIES and body + 8 <= last:
                    columns, width = ENTRIES[name]
                    n = min(int.from_bytes(content[body + 4 : body + 8], "big"), (last - body - 8) // (columns * width))
                    for k, v in enumerate(struct.iter_unpack(">" + ("Q" if width == 8 else "I") * columns, content[body + 8 : body + 8 + n * columns * width])):
                        if name == b"stsc":
                            yield track, "stsc", k, v[0] - 1, v[1]
                        elif name == b"stts":
                            yield track, "stts", k, v[1], v[0]
                        else:
                            yield track, "stco", k, v[0], None
                elif name == b"stsd" and (found := codec_of(content[body:last])):
                    yield track, "codec", *found
                at += size

        return inside(0, len(content))

    schema = pa.schema([("track", pa.int32()), ("kind", pa.string()), ("entry", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    return walk(files, parts, schema, "track int, kind string, entry long, a long, b long").drop("k")


#: Codecs of audio tracks by their number in mp4_tables(), and their media types (fixed values).
CODECS = {1: "audio/aac", 2: "audio/alac", 3: "audio/mpeg"}


def codec_of(stsd: bytes) -> tuple[int, int, int] | None:
    """(codec, profile, rate index * 16 + channel configuration) of a sample description; profile and the rest only for AAC."""
    kind, at = stsd[12:16], 8 + 36
    if kind == b"alac":
        return 2, 0, 0
    if kind != b"mp4a":
        return None
    esds = stsd.find(b"esds", at)
    if esds < 0:
        return None
    at, levels = esds + 8, {3: 3, 4: 13}  # of the descriptors, what comes before the one inside
    oti = 0
    while at < len(stsd):
        tag, at = stsd[at], at + 1
        for _ in range(4):
            more, at = (stsd[at] if at < len(stsd) else 0) & 0x80, at + 1
            if not more:
                break
        if tag == 4 and at < len(stsd):
            oti = stsd[at]
        if tag == 5 and at + 2 <= len(stsd):
            bits = stsd[at] << 8 | stsd[at + 1]
            return (3, 0, 0) if oti in (0x69, 0x6B) else (1, bits >> 11, (bits >> 7 & 15) * 16 + (bits >> 3 & 15))
        if tag not in levels:
            break
        at += levels[tag]
    return (3, 0, 0) if oti in (0x69, 0x6B) else None


def _expanded(tables: DataFrame, kind: str, name: str) -> DataFrame:
    """Runs (a, b times) as a row for each of their members, numbered through in `sample`."""
    order = Window.partitionBy(*TABLE).orderBy("entry")
    runs = tables.filter(F.col("kind") == kind).select(*TABLE, "entry", "a", "b", (F.sum("b").over(order) - F.col("b")).alias("first"))
    return runs.filter("b > 0").select(*TABLE, F.col("a").alias(name), F.explode(F.sequence("first", F.col("first") + F.col("b") - 1)).alias("sample"))


def sample_places(tables: DataFrame) -> DataFrame:
    """(path, track, sample, chunk, at, size, time) of mp4_tables(): offset and size in bytes, time in units of the track's clock (null where `stts` ends before). Samples beyond the last chunk are left out."""
    runs = tables.filter("kind = 'stsc'").select(*TABLE, F.col("a").alias("chunk"), F.col("b").alias("each"), F.lit(None).cast("long").alias("begin"))
    chunks = tables.filter("kind = 'stco'").select(*TABLE, F.col("entry").alias("chunk"), F.lit(None).cast("long").alias("each"), F.col("a").alias("begin"))
    upto = Window.partitionBy(*TABLE).orderBy("chunk", F.col("begin").isNotNull())
    held = runs.unionByName(chunks).withColumn("each", F.last("each", ignorenulls=True).over(upto)).filter("begin is not null and each > 0")
    order = Window.partitionBy(*TABLE).orderBy("chunk")
    held = held.withColumn("first", F.sum("each").over(order) - F.col("each"))
    placed = held.select(*TABLE, "chunk", "begin", F.explode(F.sequence("first", F.col("first") + F.col("each") - 1)).alias("sample"))
    in_chunk = Window.partitionBy(*TABLE, "chunk").orderBy("sample")
    met = placed.join(_expanded(tables, "stsz", "size"), [*TABLE, "sample"])
    met = met.withColumn("at", F.col("begin") + F.sum("size").over(in_chunk) - F.col("size"))
    lasting = _expanded(tables, "stts", "lasts").withColumn("time", F.sum("lasts").over(Window.partitionBy(*TABLE).orderBy("sample")) - F.col("lasts"))
    return met.join(lasting, [*TABLE, "sample"], "left").select(*TABLE, "sample", "chunk", "at", "size", "time")


def mp4_samples(files: DataFrame) -> DataFrame:
    """(path, track, k, at, size, time, bytes) of every sample that lies in its file. Paths must differ. A file's places come to its row as one list, and each sample is cut from there."""
    places = sample_places(mp4_tables(files)).groupBy("path").agg(F.collect_list(F.struct("track", "sample", "at", "size", "time")).alias("places"))
    each = files.select("path", "content").join(places, "path").select("path", "content", F.explode("places").alias("p"))
    inside = each.filter(F.col("p.at") + F.col("p.size") <= F.length("content"))
    return inside.select("path", "p.track", F.col("p.sample").alias("k"), "p.at", "p.size", "p.time", F.substr("content", (F.col("p.at") + 1).cast("int"), F.col("p.size").cast("int")).alias("bytes"))


def adts_head(profile: Column, rate_index: Column, channels: Column, size: Column) -> Column:
    """The seven bytes before an AAC frame of `size` bytes; profile is the audio object type."""
    n = size + 7
    value = F.lit(0xFFF1).cast("long")
    for v, bits in ((profile - 1, 2), (rate_index, 4), (F.lit(0), 1), (channels, 3), (F.lit(0), 4), (n, 13), (F.lit(0x7FF), 11), (F.lit(0), 2)):
        value = F.shiftleft(value, bits).bitwiseOR(v.cast("long"))
    return F.unhex(pcm_hex(value, 7, True))


def m4a_frames(files: DataFrame) -> DataFrame:
    """(path, track, k, type, time, frame) of the audio tracks: AAC frames with an ADTS header, so that they play as a file one after another; ALAC and MPEG frames as they are."""
    tables = mp4_tables(files)
    codec = tables.filter("kind = 'codec'").select(*TABLE, F.col("entry").alias("codec"), F.col("a").alias("profile"), F.shiftright("b", 4).alias("rate_index"), F.col("b").bitwiseAND(15).alias("channels"))
    kind = F.coalesce(*[F.when(F.col("codec") == n, t) for n, t in CODECS.items()])
    frame = F.when(F.col("codec") == 1, F.concat(adts_head(F.col("profile"), F.col("rate_index"), F.col("channels"), F.col("size")), F.col("bytes"))).otherwise(F.col("bytes"))
    return mp4_samples(files).join(codec, TABLE).select(*TABLE, "k", kind.alias("type"), "time", frame.alias("frame"))
