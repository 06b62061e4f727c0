"""MPEG transport and program streams: elementary streams put together from packets.

Transport packets are rows. The program association table names the packets that hold program maps, and these name the elementary
streams; both are joins on packet ids. A stream's packets fall into runs that each begin with a start flag (gaps and
islands), a run's payloads make one PES packet, and the continuity counter tells whether packets are missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.codecs import transport_packets
from wavemill.functions.containers import walk
from wavemill.functions.formats import little_endian

#: Stream types of program maps, by what they hold (fixed values).
STREAM_TYPES = {0x01: "video/mpeg", 0x02: "video/mpeg", 0x03: "audio/mpeg", 0x04: "audio/mpeg", 0x0F: "audio/aac", 0x11: "audio/aac", 0x1B: "video/h264", 0x24: "video/h265", 0x81: "audio/ac3"}


def _octet(content: Column, at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substr(content, at.cast("int") + 1, F.lit(1))), 16, 10).cast("int")


def _number(content: Column, at: Column | int, size: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substr(content, at.cast("int") + 1, F.lit(size))), 16, 10).cast("long")


def _section(payload: Column) -> Column:
    """A table's section: what follows the pointer field, up to its CRC."""
    body = F.substr(payload, 2 + little_endian(payload, 0, 1).cast("int"))
    size = _number(body, 1, 2).bitwiseAND(0xFFF).cast("int")
    return F.substr(body, F.lit(1), 3 + size - 4)


def programs(packets: DataFrame) -> DataFrame:
    """(path, program, map_pid) by the association tables of transport_packets(). Network entries (program 0) are left out; a table of several packets is read as far as its first."""
    tables = packets.filter("pid = 0 and starts and payload is not null").select("path", _section(F.col("payload")).alias("s")).filter((_octet(F.col("s"), 0) == 0) & (F.length("s") >= 12))
    entry = tables.select("path", "s", F.explode(F.sequence(F.lit(8), F.length("s") - 4, F.lit(4))).alias("at"))
    return entry.select("path", _number(F.col("s"), F.col("at"), 2).cast("int").alias("program"), _number(F.col("s"), F.col("at") + 2, 2).bitwiseAND(0x1FFF).cast("int").alias("map_pid")).filter("program > 0").distinct()


def elementary_streams(packets: DataFrame) -> DataFrame:
    """(path, program, pid, stream_type, type) by the program maps; an entry follows the descriptors of the one before."""
    named = programs(packets).select("path", "program", F.col("map_pid").alias("pid"))
    maps = packets.filter("starts and payload is not null").join(named, ["path", "pid"]).select("path", "program", _section(F.col("payload")).alias("s")).filter(_octet(F.col("s"), 0) == 2).distinct()

    @F.arrow_udf("array<struct<pid:int,stream_type:int>>")
    def entries(section: pa.Array) -> pa.Array:
        out = []
        for s in section.to_pylist():
            at, found = 12 + ((s[10] & 15) << 8 | s[11]) if len(s) >= 12 else len(s), []
            while at + 5 <= len(s):
                found.append({"pid": (s[at + 1] & 31) << 8 | s[at + 2], "stream_type": s[at]})
                at += 5 + ((s[at + 3] & 15) << 8 | s[at + 4])
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("pid", pa.int32()), ("stream_type", pa.int32())])))

    each = maps.select("path", "program", F.explode(entries("s")).alias("e")).select("path", "program", "e.pid", "e.stream_type").distinct()
    return each.withColumn("type", F.coalesce(*[F.when(F.col("stream_type") == n, t) for n, t in STREAM_TYPES.items()]))


def _stamp(content: Column, at: int) -> Column:
    """33 bits of a time stamp in five bytes, three of them parted by marker bits."""
    v = _number(content, at, 5)
    part = lambda shift, bits: F.shiftright(v, shift).bitwiseAND(2**bits - 1)
    return F.shiftleft(part(33, 3), 30) + F.shiftleft(part(17, 15), 15) + part(1, 15)


def pes_fields(pes: Column) -> list[Column]:
    """stream_id, pts, dts (in 1/90000 s; null if absent) and payload of a PES packet; null if it is none. A length of 0 means to the end."""
    c = pes
    ok = (F.length(c) >= 9) & (F.hex(F.substring(c, 1, 3)) == "000001")
    size = _number(c, 4, 2).cast("int")
    flags, head = F.shiftright(_octet(c, 7), 6), 9 + _octet(c, 8)
    end = F.when(size > 0, F.least(6 + size, F.length(c))).otherwise(F.length(c))
    found = {"stream_id": _octet(c, 3), "pts": F.when(flags >= 2, _stamp(c, 9)), "dts": F.when(flags == 3, _stamp(c, 14)), "payload": F.substr(c, head + 1, F.greatest(end - head, F.lit(0)))}
    return [F.when(ok, v).alias(n) for n, v in found.items()]


def pes_packets(files: DataFrame) -> DataFrame:
    """(path, program, pid, type, k, stream_id, pts, dts, missing, payload) of transport streams (path, content): the k-th PES packet of each elementary stream; missing tells that the counter jumped inside it or before it.

    Packets before a stream's first start flag, and without payload, belong to none. A packet sent twice (equal counters) counts once.
    """
    packets = transport_packets(files)
    order = Window.partitionBy("path", "pid").orderBy("k")
    own = packets.filter("payload is not null").join(elementary_streams(packets), ["path", "pid"])
    before = F.lag("counter").over(order)
    own = own.select("*", F.pmod(F.col("counter") - before, F.lit(16)).alias("step")).filter("step is null or step <> 0")
    own = own.select("*", F.sum(F.col("starts").cast("int")).over(order).alias("pes")).filter("pes > 0")
    whole = own.groupBy("path", "program", "pid", "type", "pes").agg(F.array_sort(F.collect_list(F.struct("k", "payload"))).alias("parts"), F.max(F.coalesce(F.col("step") != 1, F.lit(False))).alias("missing"))
    content = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["payload"]))
    return whole.select("path", "program", "pid", "type", (F.col("pes") - 1).alias("k"), "missing", content.alias("pes")).select("path", "program", "pid", "type", "k", *pes_fields(F.col("pes")), "missing")


def _pes_head(content: bytes, at: int, end: int) -> tuple[int | None, int | None, int]:
    """pts, dts and where the payload begins of a packet whose header begins at `at`: either version."""

    def stamp(k: int) -> int:
        b = content[k : k + 5]
        return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1

    if at + 3 <= end and content[at] >> 6 == 2:
        flags, head = content[at + 1] >> 6, at + 3 + content[at + 2]
        pts = stamp(at + 3) if flags >= 2 and at + 8 <= end else None
        return pts, stamp(at + 8) if flags == 3 and at + 13 <= end else None, head
    while at < end and content[at] == 0xFF:  # stuffing of the first version
        at += 1
    if at + 2 <= end and content[at] >> 6 == 1:
        at += 2
    if at + 5 <= end and content[at] >> 4 == 2:
        return stamp(at), None, at + 5
    if at + 10 <= end and content[at] >> 4 == 3:
        return stamp(at), stamp(at + 5), at + 10
    return None, None, at + 1


def program_packets(files: DataFrame) -> DataFrame:
    """(path, k, at, stream_id, clock, pts, dts, payload) of program streams: packets of audio (0xC0 to 0xDF), video (0xE0 to 0xEF) and private streams (0xBD), each found by its start code; clock is that of the pack before it (1/90000 s). Other packets, and bytes between start codes, are passed over; a packet beyond the end is cut there."""

    def parts(content: bytes) -> Iterator[tuple]:
        at, clock = content.find(b"\0\0\1"), None
        while 0 <= at <= len(content) - 4:
            code, body = content[at + 3], at + 4
            if code == 0xBA and body + 8 <= len(content):
                b = content[body : body + 6]
                if b[0] >> 6 == 1:
                    clock = (b[0] >> 3 & 7) << 30 | (b[0] & 3) << 28 | b[1] << 20 | b[2] >> 3 << 15 | (b[2] & 3) << 13 | b[3] << 5 | b[4] >> 3
                else:
                    clock = (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1
                at = content.find(b"\0\0\1", body + 8)
            elif code >= 0xBB and body + 2 <= len(content):
                end = min(body + 2 + int.from_bytes(content[body : body + 2], "big"), len(content))
                if code == 0xBD or 0xC0 <= code <= 0xEF:
                    pts, dts, head = _pes_head(content, body + 2, end)
                    yield at, code, clock, pts, dts, content[min(head, end) : end]
                at = content.find(b"\0\0\1", end)
            else:
                at = content.find(b"\0\0\1", body)

    schema = pa.schema([("at", pa.int64()), ("stream_id", pa.int32()), ("clock", pa.int64()), ("pts", pa.int64()), ("dts", pa.int64()), ("payload", pa.binary())])
    return walk(files, parts, schema, "at long, stream_id int, clock long, pts long, dts long, payload binary")
