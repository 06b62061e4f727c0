"""Queries of byte codecs, frame headers and containers over the test tables, with SQL that builds the same from numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.functions import codecs, containers, formats, metadata, text, wav
from wavemill.operators import scalar
from wavemill.sources import signals


def _bytes(*parts: Column | str) -> Column:
    """Hex texts and binary columns one after another."""
    return F.concat(*[F.unhex(F.lit(p)) if isinstance(p, str) else p for p in parts])


def _ascii(value: str) -> Column:
    return F.encode(F.lit(value), "utf-8")


def _int(value: Column | int, size: int, big: bool = False) -> Column:
    return F.unhex(codecs.pcm_hex(F.lit(value) if isinstance(value, int) else value, size, big))


def register(add: Callable, flat: Callable, ef: str, lo: str) -> None:
    pages = lambda s, d: signals.table(s, d, "pages")
    files = lambda s, d, c: pages(s, d).select(F.col("page_id").cast("string").alias("path"), c.alias("content"))
    url = lambda: F.encode("url", "utf-8")
    clipped = lambda x: scalar.clip(x - 20000, 32767).cast("int")
    cx = "least(greatest(x - 20000, -32767), 32767)"

    # samples as bytes, and back
    flat("mu_law", lambda x, k: formats.mu_law(clipped(x)), f"(SELECT 255 - (CASE WHEN v < 0 THEN 128 ELSE 0 END + s * 16 + (m >> (s + 3)) % 16) FROM (SELECT *, (length(bin(m)) - 8)::INTEGER AS s FROM (SELECT {cx} AS v, least(abs({cx}), 32635) + 132 AS m)))::INTEGER")
    # the decoder's value is the middle of the code's interval: of the values that share a code
    flat("mu_law_decoded", lambda x, k: formats.mu_law_decoded(F.pmod(x, F.lit(256)).cast("int")), "(SELECT CASE WHEN c >= 128 THEN -m ELSE m END FROM (SELECT c, ((c % 16 * 2 + 33) << (c % 128 // 16)) * 4 - 132 AS m FROM (SELECT 255 - x % 256 AS c)))::INTEGER")
    flat("mu_law_round_trip", lambda x, k: formats.mu_law_decoded(formats.mu_law(clipped(x))), f"(SELECT CASE WHEN v < 0 THEN -1 ELSE 1 END * ((((m >> (s + 3)) << (s + 3)) + (1 << (s + 2))) - 132) FROM (SELECT *, (length(bin(m)) - 8)::INTEGER AS s FROM (SELECT {cx} AS v, least(abs({cx}), 32635) + 132 AS m)))::INTEGER")
    flat("a_law", lambda x, k: codecs.a_law(clipped(x)), f"(SELECT xor(CASE WHEN v >= 0 THEN 128 ELSE 0 END + s * 16 + (m >> greatest(s, 1)) % 16, 85) FROM (SELECT *, greatest(length(bin(m)) - 5, 0)::INTEGER AS s FROM (SELECT {cx} AS v, CASE WHEN {cx} >= 0 THEN {cx} ELSE -{cx} - 1 END >> 3 AS m)))::INTEGER")
    flat("a_law_round_trip", lambda x, k: codecs.a_law_decoded(codecs.a_law(clipped(x))), f"(SELECT CASE WHEN v < 0 THEN -1 ELSE 1 END * ((m >> greatest(s, 1)) * (1 << (greatest(s, 1) + 3)) + (1 << (greatest(s, 1) + 2))) FROM (SELECT *, greatest(length(bin(m)) - 5, 0)::INTEGER AS s FROM (SELECT {cx} AS v, CASE WHEN {cx} >= 0 THEN {cx} ELSE -{cx} - 1 END >> 3 AS m)))::INTEGER")
    flat("l8_encode", lambda x, k: codecs.l8_encode(clipped(x)), f"(trunc({cx} / 258)::INTEGER + 129)")
    flat("l8_decode", lambda x, k: codecs.l8_decode(F.pmod(x, F.lit(256)).cast("int")), "least(greatest((x % 256 - 129) * 258, -32767), 32767)::INTEGER")
    flat("l16_network_hex", lambda x, k: codecs.pcm_hex(clipped(x), 2, True), f"printf('%04X', ({cx} + 65536) % 65536)")
    flat("pcm_24_hex", lambda x, k: codecs.pcm_hex(clipped(x) * 256, 3), f"(SELECT printf('%02X%02X%02X', u % 256, (u >> 8) % 256, u >> 16) FROM (SELECT ({cx} * 256 + 16777216) % 16777216 AS u))")
    for name, size, big in (("pcm_16", 2, False), ("l16_network", 2, True), ("pcm_24", 3, False), ("network_32", 4, True)):
        add(f"{name}_round_trip", lambda s, d, n=size, b=big: signals.order_frames(s, d).select("stream_id", "frame_no", codecs.pcm_samples(codecs.pcm_bytes(F.transform("samples", lambda x: scalar.clip(x - 1000, 32767).cast("int")), n, b), n, b).alias("samples")), f"WITH {lo} SELECT stream_id, frame_no, [{', '.join(f'least(greatest(c{c} - 1000, -32767), 32767)::BIGINT' for c in range(4))}] AS samples FROM lo")
    add("csv_samples", lambda s, d: signals.order_frames(s, d).select("stream_id", "frame_no", codecs.csv_samples(F.concat(formats.csv_line(F.col("samples")), F.lit(", x,-7"))).alias("samples")), f"WITH {lo} SELECT stream_id, frame_no, [c0, c1, c2, c3, NULL, -7] AS samples FROM lo")
    add("base64_decoded", lambda s, d: pages(s, d).select("page_id", codecs.base64_decoded(F.regexp_replace(formats.base64_text(F.col("url")), "(.{8})", "$1\r\n")).alias("y"), codecs.base64_decoded(F.lit("?")).alias("none")), "SELECT page_id, url AS y, NULL::VARCHAR AS none FROM pages")
    steps, indexes = list(codecs.IMA_STEPS), [-1, -1, -1, -1, 2, 4, 6, 8]
    add("ima_samples", lambda s, d: codecs.ima_samples(files(s, d, _bytes(_int(F.col("page_id").cast("int"), 2), "0500", url()))), f"""WITH RECURSIVE n AS (SELECT page_id, i - 1 AS k, ('0x' || substr(hex(url), CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END, 1))::INTEGER AS code FROM pages, unnest(range(1, length(hex(url)) + 1)) t(i)),
 r(page_id, k, x, i) AS (SELECT page_id, 0::BIGINT, page_id::INTEGER, 5 FROM pages UNION ALL
 SELECT r.page_id, r.k + 1, least(greatest(r.x + (CASE WHEN code >= 8 THEN -1 ELSE 1 END) * (s // 8 + (code // 4 % 2) * s + (code // 2 % 2) * (s // 2) + (code % 2) * (s // 4)), -32768), 32767)::INTEGER, least(greatest(r.i + {indexes}[code % 8 + 1], 0), 88)::INTEGER
 FROM (SELECT *, {steps}[i + 1] AS s FROM r) r JOIN n ON n.page_id = r.page_id AND n.k = r.k) SELECT page_id::VARCHAR AS path, k::INTEGER AS k, x FROM r""")

    # files of samples
    frames = lambda s, d: signals.order_frames(s, d).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("frame_no", "samples"))).alias("f")).select(F.col("stream_id").cast("string").alias("path"), codecs.wav_bytes(F.flatten(F.transform("f", lambda p: F.transform(F.slice(p["samples"], 1, 2), lambda x: scalar.clip(x, 32767).cast("int")))), 8000, 2).alias("content"))
    add("wav_header", lambda s, d: wav.wav_header(frames(s, d)).drop("format"), f"WITH {lo} SELECT stream_id::VARCHAR AS path, 2::BIGINT AS channels, 8000::BIGINT AS rate, 16::BIGINT AS bits, count(*) AS frames FROM lo GROUP BY 1")
    add("wav_frames", lambda s, d: wav.wav_frames(frames(s, d)).withColumn("frame_no", F.col("frame_no").cast("int")), f"WITH {lo} SELECT stream_id::VARCHAR AS path, frame_no::INTEGER AS frame_no, [least(c0, 32767)::BIGINT, least(c1, 32767)::BIGINT] AS samples FROM lo")
    add("wav_bytes", lambda s, d: frames(s, d).select("path", F.hex(F.substring("content", 1, 44)).alias("head")), f"""WITH {lo}, n AS (SELECT stream_id, count(*) * 4 AS n FROM lo GROUP BY 1), le AS (SELECT stream_id, n, printf('%02X%02X0000', (n + 36) % 256, (n + 36) // 256) AS whole, printf('%02X%02X0000', n % 256, n // 256) AS part FROM n)
 SELECT stream_id::VARCHAR AS path, hex('RIFF') || whole || hex('WAVEfmt ') || '10000000' || '0100' || '0200' || '401F0000' || '007D0000' || '0400' || '1000' || hex('data') || part AS head FROM le""")
    riff = lambda s, d: files(s, d, _bytes(_ascii("RIFF"), _int(F.length(url()) + F.length(url()) % 2 + 44, 4), _ascii("AVI LIST"), _int(24, 4), _ascii("hdrlavih"), _int(3, 4), "01020300", _ascii("strh"), _int(0, 4), _ascii("movi"), _int(F.length(url()), 4), url(), F.unhex(F.repeat(F.lit("00"), (F.length(url()) % 2).cast("int")))))
    add("chunks", lambda s, d: codecs.chunks(riff(s, d)), """WITH p AS (SELECT page_id::VARCHAR AS path, strlen(url) AS n FROM pages), t(k, depth, id, kind, "at", size) AS (VALUES (0, 0, 'RIFF', 'AVI ', 8, NULL), (1, 1, 'LIST', 'hdrl', 20, 24), (2, 2, 'avih', NULL, 32, 3), (3, 2, 'strh', NULL, 44, 0), (4, 1, 'movi', NULL, 52, NULL))
 SELECT path, k, depth, id, kind, "at"::BIGINT AS "at", coalesce(size, CASE WHEN k = 0 THEN n + n % 2 + 44 ELSE n END)::BIGINT AS size FROM p, t""")
    mp4 = lambda s, d: files(s, d, _bytes(_int(12, 4, True), _ascii("ftypM4A "), _int(F.length(url()) + 24, 4, True), _ascii("moov"), _int(16, 4, True), _ascii("trak"), _int(8, 4, True), _ascii("tkhd"), _int(F.length(url()), 4, True), F.concat(_ascii("free"), F.substr(url(), F.lit(9))), _int(0, 4, True), _ascii("mdat"), url()))
    add("boxes", lambda s, d: codecs.boxes(mp4(s, d)), """WITH p AS (SELECT page_id::VARCHAR AS path, strlen(url) AS n FROM pages), t(k, depth, type, a, b, c, e) AS (VALUES (0, 0, 'ftyp', 8, 0, 4, 0), (1, 0, 'moov', 20, 0, 16, 1), (2, 1, 'trak', 28, 0, 8, 0), (3, 2, 'tkhd', 36, 0, 0, 0), (4, 1, 'free', 44, 0, -8, 1), (5, 0, 'mdat', 44, 1, 0, 1))
 SELECT path, k, depth, type, (a + b * n)::BIGINT AS "at", (c + e * n)::BIGINT AS size FROM p, t""")
    packet = lambda k: F.concat(_int(0x47, 1), _int(F.lit(k % 2 * 64) + F.floor(F.col("page_id") / 256) % 32, 1), _int(F.col("page_id") % 256, 1), _int(F.lit((16, 48, 32)[k] + k), 1), F.unhex(F.lit("07" + "00" * 7 if k else "")), F.rpad(url(), 184 - (8 if k else 0), b"\\xff"))
    add("transport_packets", lambda s, d: codecs.transport_packets(files(s, d, F.concat(*[packet(k) for k in range(3)], F.unhex(F.lit("4700"))))).select("path", "k", "pid", "starts", "counter", F.length("payload").alias("n"), F.decode(F.substring("payload", 1, 8), "utf-8").alias("head")), "SELECT page_id::VARCHAR AS path, k::INTEGER AS k, (page_id % 8192)::INTEGER AS pid, k = 1 AS starts, k::INTEGER AS counter, CASE k WHEN 0 THEN 184 WHEN 1 THEN 176 END::INTEGER AS n, CASE WHEN k < 2 THEN url[1:8] END AS head FROM pages, range(0, 3) t(k)")
    add("dsf_header", lambda s, d: pages(s, d).select("page_id", *codecs.dsf_header(F.concat(_bytes(_ascii("DSD "), F.unhex(F.lit("00" * 24)), _ascii("fmt "), F.unhex(F.lit("00" * 20)), _int(2, 4), _int(2822400, 4), _int(1, 4), _int(F.col("page_id") * 1000, 8))))), "SELECT page_id, 2::BIGINT AS channels, 2822400::BIGINT AS rate, 1::BIGINT AS bits, page_id * 1000 AS samples FROM pages")

    # frame headers: every combination of version, layer, bitrate and rate index meets some event
    head = lambda k: F.concat(_int(255, 1), _int(F.lit(224) + F.pmod(k, F.lit(32)), 1), _int(F.pmod(F.floor(k / 32), F.lit(256)), 1), _int(F.pmod(k * 37, F.lit(256)), 1))
    fields = ("version", "layer", "kbits", "rate", "channels", "padding", "frame_bytes")
    one = {1: "[32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448]", 2: "[32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384]", 3: "[32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]"}
    add("mpeg_header", lambda s, d: signals.events_flat(s, d).select("frame_no", *codecs.mpeg_header(head(F.col("frame_no")))), f"""WITH {ef}, b AS (SELECT frame_no, 224 + frame_no % 32 AS b1, frame_no // 32 % 256 AS b2, frame_no * 37 % 256 AS b3 FROM ef),
 f AS (SELECT *, [2.5::DOUBLE, NULL, 2.0::DOUBLE, 1.0::DOUBLE][(b1 >> 3) % 4 + 1] AS version, [NULL, 3, 2, 1][(b1 >> 1) % 4 + 1] AS layer, b2 >> 4 AS i, (b2 >> 1) % 2 AS padding, [44100, 48000, 32000, NULL][(b2 >> 2) % 4 + 1] AS base FROM b),
 g AS (SELECT *, CASE WHEN i = 0 THEN 0 WHEN version = 1 THEN CASE layer WHEN 1 THEN {one[1]}[i] WHEN 2 THEN {one[2]}[i] ELSE {one[3]}[i] END WHEN layer = 1 THEN [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256][i] ELSE [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160][i] END AS kbits, (base // CASE version WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END)::INTEGER AS rate FROM f),
 h AS (SELECT *, version IS NOT NULL AND layer IS NOT NULL AND kbits IS NOT NULL AND rate IS NOT NULL AS ok FROM g)
 SELECT frame_no, {', '.join(f'CASE WHEN ok THEN {e} END AS {n}' for n, e in zip(fields, ('version', 'layer', 'kbits', 'rate', '(CASE WHEN b3 >= 192 THEN 1 ELSE 2 END)', 'padding::INTEGER', '((CASE WHEN version = 1 THEN 144 ELSE 72 END) * kbits * 1000 // rate + padding)::INTEGER'), strict=True))} FROM h""")
    add("adts_header", lambda s, d: signals.events_flat(s, d).select("frame_no", *containers.adts_header(F.concat(_int(255, 1), _int(F.lit(240) + F.pmod("frame_no", F.lit(16)), 1), _int(F.pmod(F.floor(F.col("frame_no") / 16), F.lit(256)), 1), _int(F.pmod(F.col("frame_no") * 37, F.lit(256)), 1), _int(F.pmod(F.col("frame_no"), F.lit(256)), 1), F.unhex(F.lit("7FFC"))))), f"""WITH {ef}, b AS (SELECT frame_no, 240 + frame_no % 16 AS b1, frame_no // 16 % 256 AS b2, frame_no * 37 % 256 AS b3, frame_no % 256 AS b4 FROM ef), h AS (SELECT *, (b1 // 2) % 4 = 0 AS ok FROM b)
 SELECT frame_no, CASE WHEN ok THEN (b2 >> 6) + 1 END::INTEGER AS profile, CASE WHEN ok THEN [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350][(b2 >> 2) % 16 + 1] END::INTEGER AS rate, CASE WHEN ok THEN b2 % 2 * 4 + (b3 >> 6) END::INTEGER AS channels, CASE WHEN ok THEN b3 % 4 * 2048 + b4 * 8 + 3 END::INTEGER AS frame_bytes FROM h""")

    # tags, frames and links
    tag = lambda n: F.concat(_ascii("TAG"), F.rpad(F.substring(url(), 1, 30), 30, b"\\x00"), F.unhex(F.lit("00" * 95)))
    add("without_tags", lambda s, d: pages(s, d).select("page_id", F.decode(codecs.without_tags(F.concat(F.when(F.col("page_id") % 2 == 0, _bytes(_ascii("ID3"), "0300000000", "0105", F.unhex(F.lit("00" * 133)))).otherwise(F.unhex(F.lit(""))), url(), F.when(F.col("page_id") % 3 == 0, tag(0)).otherwise(F.unhex(F.lit(""))))), "utf-8").alias("y")), "SELECT page_id, url AS y FROM pages")
    octets = "list_transform(range(1, strlen(url) + 1), lambda i: ('0x' || substr(hex(url), 2 * i - 1, 2))::INTEGER)"
    crc = f"list_reduce(list_prepend(65535, flatten(list_transform({octets}, lambda b: list_transform(range(0, 8), lambda k: ((b >> (7 - k)::INTEGER) % 2)::INTEGER)))), lambda c, b: xor((c * 2) % 65536, CASE WHEN (c >> 15) <> b THEN 4129 ELSE 0 END)::INTEGER)"
    escaped = "replace(replace(regexp_replace(hex(url) || printf('%04X', crc), '(..)', '\\1 ', 'g'), '7D ', '7D5D '), '7E ', '7D5E ')"
    add("hdlc_frame", lambda s, d: pages(s, d).select("page_id", metadata.hdlc_frame(url()).alias("y")), f"SELECT page_id, '7E' || replace({escaped}, ' ', '') || '7E' AS y FROM (SELECT *, {crc} AS crc FROM pages)")
    add("hdlc_content", lambda s, d: pages(s, d).select("page_id", F.decode(codecs.hdlc_content(metadata.hdlc_frame(F.concat(_bytes("7E7D7D5E"), url()))), "utf-8").alias("y"), codecs.hdlc_content(F.lit("7E00")).alias("none")), "SELECT page_id, '~}}^' || url AS y, NULL::BLOB AS none FROM pages")
    # a stream a page: noise, a frame, one whose last content byte was changed on the way, flags in a row, a frame of an odd page only
    link = lambda c: F.unhex(metadata.hdlc_frame(c))
    broken = lambda: F.unhex(metadata.hdlc_frame(url(), F.concat(F.substr(url(), F.lit(1), F.length(url()) - 1), _bytes("00"))))
    add("hdlc_frames", lambda s, d: codecs.hdlc_frames(files(s, d, _bytes("00112233", link(F.concat(url(), _bytes("7D7E"))), broken(), "7E7E", F.when(F.col("page_id") % 2 == 1, link(_ascii("odd"))).otherwise(F.unhex(F.lit(""))), "7E41"))).withColumn("content", F.decode("content", "utf-8")), "SELECT page_id::VARCHAR AS path, k::INTEGER AS k, CASE k WHEN 0 THEN url || '}~' ELSE 'odd' END AS content FROM pages, range(0, 2) t(k) WHERE k = 0 OR page_id % 2 = 1")
    add("id3v1_tag", lambda s, d: pages(s, d).select("page_id", *metadata.id3v1(F.concat(url(), tag(0)))), "SELECT page_id, url[1:30] AS title, '' AS artist, '' AS album, '' AS year FROM pages")
    frame = lambda name, c: F.concat(_ascii(name), _int(F.length(c) + 1, 4, True), F.unhex(F.lit("000003")), c)
    add("id3v2_frames", lambda s, d: containers.id3v2_frames(files(s, d, _bytes(_ascii("ID3"), "0300000000", _int(F.floor((F.length(url()) + 27) / 128), 1), _int((F.length(url()) + 27) % 128, 1), frame("TIT2", url()), frame("TPE1", _ascii("by me"))))).select("path", "k", "frame", "text"), "SELECT page_id::VARCHAR AS path, k::INTEGER AS k, ['TIT2', 'TPE1'][k + 1] AS frame, [url, 'by me'][k + 1] AS text FROM pages, range(0, 2) t(k)")
    add("object_records", lambda s, d: containers.framed_records(files(s, d, F.concat(_int(F.length(url()), 8), url(), _int(2, 8), _ascii("ok")))).select("path", "k", F.decode("record", "utf-8").alias("record")), "SELECT page_id::VARCHAR AS path, k::INTEGER AS k, [url, 'ok'][k + 1] AS record FROM pages, range(0, 2) t(k)")
    lists = lambda s, d: pages(s, d).select(F.col("page_id").alias("list_id"), F.concat(F.lit("#EXTM3U\n#EXTINF:9.5,\n"), "url", F.lit("\n#EXTINF:4,\nlast.ts\n"), "url", F.lit("\r\nlast.ts\n\n")).alias("text"))
    add("playlist_segments", lambda s, d: text.playlist_segments(lists(s, d)), "SELECT page_id AS list_id, k::INTEGER AS seq, [9.5::DOUBLE, 4.0::DOUBLE][k + 1] AS seconds, [url, 'last.ts'][k + 1] AS url FROM pages, range(0, 2) t(k)")
    kinds = {"52494646000000005741564500000000000000000100": "audio/wav", "52494646000000005741564500000000000000000200": "audio/adpcm", "664C6143": "audio/flac", "44534420": "audio/dsf", "494433": "audio/mpeg", "FFFB": "audio/mpeg", "FFF1": "audio/aac", "4F676753": "audio/ogg", "0000": None, "": None}
    held = lambda: F.unhex(F.get(F.array(*map(F.lit, kinds)), F.pmod("page_id", F.lit(len(kinds))).cast("int")))
    add("type_by_bytes", lambda s, d: pages(s, d).select("page_id", metadata.type_by_bytes(held()).alias("y")), f"SELECT page_id, {[v or '' for v in kinds.values()]}[page_id % {len(kinds)} + 1] AS y FROM pages".replace("''", "NULL"))
    masters = lambda s, d: pages(s, d).select(F.col("page_id").alias("list_id"), F.concat(F.lit("#EXTM3U\n#EXT-X-STREAM-INF:PROGRAM-ID=1,BANDWIDTH="), F.col("page_id") * 1000, F.lit(",AVERAGE-BANDWIDTH=5\n"), "url", F.lit("\n\n#EXT-X-STREAM-INF:CODECS=x\r\nlow.m3u8\nstray.m3u8\n")).alias("text"))
    add("playlist_variants", lambda s, d: text.playlist_variants(masters(s, d)), "SELECT page_id AS list_id, k::INTEGER AS seq, CASE WHEN k = 0 THEN page_id * 1000 END AS bandwidth, [url, 'low.m3u8'][k + 1] AS url FROM pages, range(0, 2) t(k)")
    # frames of 36 and 37 bytes (version 2, layer 3, 8 kbit/s, 16,000 Hz, without and with padding) between junk, and one that is cut off
    filled = lambda head, n: F.concat(F.unhex(F.lit(head)), F.rpad(url(), n - len(head) // 2, b"\x00"))
    add("mpeg_frames", lambda s, d: codecs.audio_frames(files(s, d, _bytes("FF00", filled("FFF318C0", 36), "00FFFF", filled("FFF31AC0", 37), "FFF318C0")), "mpeg").select("path", "k", "at", F.length("frame").alias("n"), F.decode(F.substring("frame", 5, 8), "utf-8").alias("head")), "SELECT page_id::VARCHAR AS path, k::INTEGER AS k, [2, 41][k + 1]::BIGINT AS \"at\", [36, 37][k + 1]::INTEGER AS n, url[1:8] AS head FROM pages, range(0, 2) t(k)")
    add("adts_frames", lambda s, d: codecs.audio_frames(files(s, d, _bytes(filled("FFF15080027FFC", 19), "00", filled("FFF1508003BFFC", 29), "FFF150")), "adts").select("path", "k", "at", F.length("frame").alias("n"), F.decode(F.substring("frame", 8, 8), "utf-8").alias("head")), "SELECT page_id::VARCHAR AS path, k::INTEGER AS k, [0, 20][k + 1]::BIGINT AS \"at\", [19, 29][k + 1]::INTEGER AS n, url[1:8] AS head FROM pages, range(0, 2) t(k)")
