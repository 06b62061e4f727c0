"""Parsers of names, tags, protocol lines and ringtones, as Column expressions; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.formats import little_endian

#: Media types by file extension (fixed values).
TYPES = {"aac": "audio/aac", "ac3": "audio/ac3", "aiff": "audio/aiff", "aif": "audio/aiff", "aifc": "audio/aiff", "alac": "audio/alac", "amr": "audio/amr", "au": "audio/basic", "caf": "audio/x-caf", "dts": "audio/vnd.dts", "flac": "audio/flac", "m3u": "audio/x-mpegurl", "m3u8": "application/vnd.apple.mpegurl", "m4a": "audio/m4a", "mid": "audio/midi", "midi": "audio/midi", "mka": "audio/x-matroska", "mkv": "video/x-matroska", "mp2": "audio/mpeg", "mp2t": "video/MP2T", "mp3": "audio/mpeg", "mp4": "video/mp4", "mpeg": "audio/mpeg", "oga": "audio/ogg", "ogg": "audio/ogg", "ogv": "video/ogg", "opus": "audio/ogg; codecs=opus", "sid": "audio/prs.sid", "spx": "audio/ogg; codecs=spx", "ts": "video/MP2T", "vorbis": "audio/ogg; codec=vorbis", "wave": "audio/vnd.wave", "wav": "audio/vnd.wave", "webm": "video/webm", "wma": "audio/x-ms-wma"}


def type_by_name(name: Column) -> Column:
    """By what follows the last dot, in any case; null if unknown."""
    table = F.create_map(*[F.lit(v) for pair in TYPES.items() for v in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)))


def type_by_bytes(content: Column) -> Column:
    """By the first bytes; of several signatures the first that fits; null if none does."""

    def has(text: str, at: int = 0) -> Column:
        return F.substring(content, at + 1, len(text)) == F.lit(text.encode("latin-1"))

    sync = F.conv(F.hex(F.substring(content, 1, 2)), 16, 10).cast("int")
    found = [
        (has("RIFF") & has("WAVE", 8) & little_endian(content, 20, 2).isin(2, 17), "audio/adpcm"),
        (has("RIFF") & has("WAVE", 8), "audio/wav"),
        (has("fLaC"), "audio/flac"),
        (has("OggS") & has("FLAC", 29), "audio/ogg; codecs=flac"),
        (has("OggS") & has("OpusHead", 28), "audio/ogg; codecs=opus"),
        (has("OggS") & has("vorbis", 29), "audio/ogg; codecs=vorbis"),
        (has("OggS"), "audio/ogg"),
        (has("G") & has("G", 188), "video/MP2T"),
        (has("DSD "), "audio/dsf"),
        (has("ID3") | ((sync >= 0xFFE0) & (sync.bitwiseAND(0x06) != 0)), "audio/mpeg"),
        (sync.bitwiseAND(0xFFF6) == 0xFFF0, "audio/aac"),
    ]
    return F.coalesce(*[F.when(test, kind) for test, kind in found])


def id3v1(content: Column) -> list[Column]:
    """title, artist, album and year of the tag in the last 128 bytes; null without one."""
    tag = F.substring(content, -128, 128)
    ok = (F.length(tag) == 128) & (F.substring(tag, 1, 3) == F.lit(b"TAG"))
    parts = (("title", 4, 30), ("artist", 34, 30), ("album", 64, 30), ("year", 94, 4))
    return [F.when(ok, F.rtrim(F.regexp_replace(F.decode(F.substring(tag, at, n), "ISO-8859-1"), "\\x00.*$", ""))).alias(name) for name, at, n in parts]


def id3v1_extended(content: Column) -> list[Column]:
    """title, artist, album (up to 90 characters each), speed, genre, start and end of the extended tag (`TAG+`, 227 bytes) before the one in the last 128 bytes; null without both. The long fields go on where those of the short tag are full."""
    tag = F.substring(content, -355, 227)
    ok = (F.length(content) >= 355) & (F.substring(tag, 1, 4) == F.lit(b"TAG+")) & (F.substring(F.substring(content, -128, 128), 1, 3) == F.lit(b"TAG"))
    plain = lambda at, n, own=tag: F.regexp_replace(F.decode(F.substring(own, at, n), "ISO-8859-1"), "\\x00.*$", "")
    short = F.substring(content, -128, 128)
    both = [F.rtrim(F.concat(plain(4 + 30 * k, 30, short), plain(5 + 60 * k, 60))).alias(n) for k, n in enumerate(("title", "artist", "album"))]
    speed = F.conv(F.hex(F.substring(tag, 185, 1)), 16, 10).cast("int").alias("speed")
    rest = [F.rtrim(plain(at, n)).alias(name) for name, at, n in (("genre", 186, 30), ("start", 216, 6), ("end", 222, 6))]
    names = ("title", "artist", "album", "speed", "genre", "start", "end")
    return [F.when(ok, c).alias(n) for n, c in zip(names, (*both, speed, *rest), strict=True)]


def id3_tags(files: DataFrame) -> DataFrame:
    """(path, title, artist, album, year) of files (path, content): each field from the tag at the start, or else from the one in the last 128 bytes; files with neither are left out."""
    from wavemill.functions.containers import id3v2_frames

    names = {"title": ("TIT2",), "artist": ("TPE1",), "album": ("TALB",), "year": ("TDRC", "TYER")}
    first = id3v2_frames(files).groupBy("path").agg(*[F.min_by(F.when(F.col("frame").isin(*own), F.col("text")), F.when(F.col("frame").isin(*own), F.col("k"))).alias(f"new_{n}") for n, own in names.items()])
    last = files.select("path", *id3v1(F.col("content")))
    met = last.join(first, "path", "left")
    fields = [F.coalesce(F.nullif(F.col(f"new_{n}"), F.lit("")), F.nullif(F.col(n), F.lit(""))).alias(n) for n in names]
    return met.select("path", *fields).filter(" or ".join(f"{n} is not null" for n in names))


def stream_title(metadata: Column) -> Column:
    return F.nullif(F.regexp_extract(metadata, "StreamTitle='(.*?)';", 1), F.lit(""))


def http_request(line: Column) -> list[Column]:
    return [F.regexp_extract(line, r"^(\S+) (\S+) (\S+)", k).alias(n) for k, n in enumerate(("method", "path", "protocol"), 1)]


def http_status(line: Column) -> list[Column]:
    whole = r"^(\S+) (\d{3}) ?(.*)$"
    return [F.regexp_extract(line, whole, 1).alias("protocol"), F.regexp_extract(line, whole, 2).try_cast("int").alias("code"), F.regexp_extract(line, whole, 3).alias("reason")]


def http_header(text: Column, name: str) -> Column:
    """The value of a header line, its name in any case; null if absent."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)), F.lit(""))


def _octets(content: Column) -> Column:
    size = F.length(content)
    return F.when(size == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), size), lambda k: F.conv(F.hex(F.substring(content, k, 1)), 16, 10).cast("int")))


def _crc_table() -> list[int]:
    """The CRC of every byte on its own."""
    table = []
    for value in range(256):
        c = value << 8
        for _ in range(8):
            c = (c << 1 ^ 0x1021 if c & 0x8000 else c << 1) & 0xFFFF
        table.append(c)
    return table


def crc16(content: Column) -> Column:
    """CRC-16 of polynomial 0x1021, from 0xFFFF, high bit first."""
    table = F.split(F.lit(",".join(map(str, _crc_table()))), ",").cast("array<int>")
    octet = lambda c, b: F.get(table, F.shiftright(c, 8).bitwiseXOR(b)).bitwiseXOR(F.shiftleft(c, 8).bitwiseAND(0xFFFF))
    return F.aggregate(_octets(content), F.lit(0xFFFF), octet)


def hdlc_frame(content: Column, sent: Column | None = None) -> Column:
    """Content and its CRC (high byte first) between flags, as hex; flag and escape bytes inside are escaped. sent: what stands there instead of the content under its CRC."""
    raw = F.concat(F.hex(content if sent is None else sent), F.lpad(F.hex(crc16(content)), 4, "0"))
    octets = F.regexp_replace(raw, "(..)", "$1 ")
    body = F.replace(F.replace(F.replace(octets, F.lit("7D "), F.lit("7D5D ")), F.lit("7E "), F.lit("7D5E ")), F.lit(" "), F.lit(""))
    return F.concat(F.lit("7E"), body, F.lit("7E"))


def ringtone_notes(tunes: DataFrame) -> DataFrame:
    """(tune_id, k, start_ms, ms, hz) of ringtone texts (tune_id, text) `title:d=4,o=6,b=63:notes`; a rest has hz 0. A note is its duration, a letter (h is b), `#`, a dot for half as long again, and an octave."""
    parts = F.split("text", ":")
    heads = [F.coalesce(F.nullif(F.regexp_extract(F.get(parts, 1), f"{c}=([0-9]+)", 1), F.lit("")).cast("int"), F.lit(n)) for c, n in (("d", 4), ("o", 6), ("b", 63))]
    notes = tunes.select("tune_id", *[h.alias(n) for h, n in zip(heads, "dob", strict=True)], F.posexplode(F.split(F.lower(F.get(parts, 2)), ",")).alias("k", "note"))
    field = lambda k: F.nullif(F.regexp_extract(F.trim("note"), r"^([0-9]*)([a-hpr])(#?)(\.?)([0-9]?)(\.?)$", k), F.lit(""))
    dotted = field(4).isNotNull() | field(6).isNotNull()
    ms = 240000 / F.col("b") / F.coalesce(field(1).cast("int"), F.col("d")) * F.when(dotted, 1.5).otherwise(1.0)
    place = F.instr(F.lit("c_d_ef_g_a_b"), F.translate(field(2), "h", "b")) - 1 + F.when(field(3).isNotNull(), 1).otherwise(0)
    hz = 440 * F.pow(F.lit(2.0), (place - 9) / 12 + F.coalesce(field(5).cast("int"), F.col("o")) - 4)
    each = notes.select("tune_id", "k", ms.alias("ms"), F.when(field(2).isin("p", "r"), 0.0).otherwise(hz).alias("hz"))
    order = Window.partitionBy("tune_id").orderBy("k")
    return each.select("tune_id", "k", (F.sum("ms").over(order) - F.col("ms")).alias("start_ms"), "ms", "hz")
