"""Queries of WAV files, tracks of MP4 files, transport and program streams over the test tables, with SQL that works the parts out from numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.functions import codecs, mp4, transport, wav
from wavemill.operators import scalar
from wavemill.sources import signals


def _hex(*parts: str) -> Column:
    return F.unhex(F.lit("".join(parts)))


def _ascii(value: str) -> Column:
    return F.encode(F.lit(value), "utf-8")


def _int(value: Column | int, size: int, big: bool = False) -> Column:
    return F.unhex(codecs.pcm_hex(F.lit(value) if isinstance(value, int) else value, size, big))


def _zeros(n: Column | int) -> Column:
    return F.unhex(F.repeat(F.lit("00"), (F.lit(n) if isinstance(n, int) else n).cast("int")))


def _chunk(name: str, body: Column) -> Column:
    """A RIFF chunk, padded to an even size."""
    return F.concat(_ascii(name), _int(F.length(body), 4), body, _zeros(F.length(body) % 2))


def _box(name: str, *body: Column) -> Column:
    return F.concat(_int(8 + sum((F.length(b) for b in body), F.lit(0)), 4, True), _ascii(name), *body)


def _ints(values: Column, size: int = 4) -> Column:
    """An array of numbers, high bytes first."""
    return F.unhex(F.array_join(F.transform(values, lambda v: codecs.pcm_hex(v, size, True)), ""))


def made(files: DataFrame) -> DataFrame:
    """Files whose content an expression builds, built once: without this the expression would stand wherever a byte of the content is looked at."""
    return files.select("path", "content").mapInArrow(lambda batches: batches, "path string, content binary")


def register(add: Callable, lo: str) -> None:
    pages = lambda s, d: signals.table(s, d, "pages")
    files = lambda s, d, c: pages(s, d).select(F.col("page_id").cast("string").alias("path"), c.alias("content"))
    url = lambda: F.encode("url", "utf-8")
    pid = lambda: F.col("page_id")

    # WAV files of an order's first two channels: a chunk of odd size before `data`, behind it, both or none; 16, 8 and 24 bits, mu-law, and sizes that say nothing
    def wav_files(s, d: str) -> DataFrame:
        own = signals.order_frames(s, d).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("frame_no", "samples"))).alias("f"))
        two = own.select("stream_id", F.flatten(F.transform("f", lambda p: F.transform(F.slice(p["samples"], 1, 2), lambda x: scalar.clip(x - 1000, 32767).cast("int")))).alias("x"))
        sid, k = F.col("stream_id"), F.col("stream_id") % 4
        joined = lambda fn: F.unhex(F.array_join(F.transform("x", fn), ""))
        data = F.when(k == 0, joined(lambda x: codecs.pcm_hex(x, 2))).when(k == 1, joined(lambda x: codecs.pcm_hex(F.pmod(x, F.lit(256)), 1))).when(k == 2, joined(lambda x: codecs.pcm_hex(x * 200, 3))).otherwise(joined(lambda x: codecs.pcm_hex(F.pmod(x, F.lit(256)), 1)))
        bits = F.when(k == 0, 16).when(k == 2, 24).otherwise(8)
        fmt = F.concat(_int(F.when(k == 3, wav.MU_LAW).otherwise(wav.PCM), 2), _int(2, 2), _int(8000, 4), _int(16000 * bits / 8, 4), _int(2 * bits / 8, 2), _int(bits, 2))
        extra = F.when(k == 3, F.concat(fmt, _int(0, 2))).otherwise(fmt)
        note = _chunk("LIST", _ascii("INFOdata!"))
        at_end = F.concat(_ascii("data"), _int(F.when(sid % 7 == 1, 0).otherwise(0x7FFFFFFF), 4), data)
        body = F.concat(_ascii("WAVE"), F.when(sid % 3 == 0, note).otherwise(_zeros(0)), _chunk("fmt ", extra), F.when(sid % 5 < 2, note).otherwise(_zeros(0)))
        known = F.concat(body, _chunk("data", data), F.when(sid % 2 == 0, note).otherwise(_zeros(0)))
        whole = F.when(sid % 7 < 2, F.concat(body, at_end)).otherwise(known)
        return two.select(sid.cast("string").alias("path"), F.concat(_ascii("RIFF"), _int(F.length(whole), 4), whole).alias("content"))

    value = "CASE stream_id % 4 WHEN 0 THEN v WHEN 1 THEN (v % 256 + 256) % 256 - 128 WHEN 2 THEN v * 200 ELSE (SELECT CASE WHEN u >= 128 THEN -m ELSE m END FROM (SELECT u, ((u % 16 * 8 + 132) << ((u % 128) >> 4)::INTEGER) - 132 AS m FROM (SELECT 255 - (v % 256 + 256) % 256 AS u))) END"
    add("wav_layouts", lambda s, d: wav.wav_frames(wav_files(s, d)), f"""WITH {lo}, v AS (SELECT stream_id, frame_no, unnest([0, 1]) AS ch, unnest([least(greatest(c0 - 1000, -32767), 32767), least(greatest(c1 - 1000, -32767), 32767)])::BIGINT AS v FROM lo)
 SELECT stream_id::VARCHAR AS path, frame_no, list(({value})::BIGINT ORDER BY ch) AS samples FROM v GROUP BY 1, 2""")
    add("wav_info", lambda s, d: wav.wav_header(wav_files(s, d)), f"WITH {lo} SELECT stream_id::VARCHAR AS path, CASE WHEN stream_id % 4 = 3 THEN 7 ELSE 1 END::BIGINT AS format, 2::BIGINT AS channels, 8000::BIGINT AS rate, [16, 8, 24, 8][stream_id % 4 + 1]::BIGINT AS bits, count(*) AS frames FROM lo GROUP BY stream_id")

    # IMA ADPCM in WAV: two channels whose codes are the bytes of a page's URL, one block a file
    def ima_files(s, d: str) -> DataFrame:
        words = F.greatest(F.ceil(F.length(url()) / 8).cast("int"), F.lit(1))
        body = F.concat(_int(pid() % 3000, 2), _hex("0500"), _int(-(pid() % 77), 2), _hex("0C00"), F.rpad(url(), words * 8, b"\x10"))
        fmt = F.concat(_int(0x11, 2), _int(2, 2), _int(8000, 4), _int(8000, 4), _int(F.length(body), 2), _int(4, 2), _int(2, 2), _int(words * 8 + 1, 2))
        whole = F.concat(_ascii("WAVE"), _chunk("fmt ", fmt), _chunk("fact", _int(words * 8 - 1, 4)), _chunk("data", body))
        return files(s, d, F.concat(_ascii("RIFF"), _int(F.length(whole), 4), whole))

    steps, indexes = list(codecs.IMA_STEPS), list(codecs.IMA_INDEX)
    add("wav_ima", lambda s, d: wav.wav_frames(ima_files(s, d)), f"""WITH RECURSIVE p AS (SELECT page_id, greatest(ceil(strlen(url) / 8.0), 1)::INTEGER AS words, hex(url) AS h FROM pages),
 b AS (SELECT page_id, words, rpad(h, words * 16, '10') AS h FROM p), n AS (SELECT page_id, words, ch, k, ('0x' || substr(h, 2 * (k // 8 * 8 + ch * 4 + k % 8 // 2) + CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END, 1))::INTEGER AS code FROM b, range(0, 2) c(ch), unnest(range(0, words * 8)) t(k)),
 r(page_id, ch, k, x, i) AS (SELECT page_id, ch, 0::BIGINT, CASE ch WHEN 0 THEN page_id % 3000 ELSE -(page_id % 77) END::INTEGER, CASE ch WHEN 0 THEN 5 ELSE 12 END FROM pages, range(0, 2) c(ch) UNION ALL
 SELECT r.page_id, r.ch, r.k + 1, least(greatest(r.x + (CASE WHEN code >= 8 THEN -1 ELSE 1 END) * (s // 8 + (code // 4 % 2) * s + (code // 2 % 2) * (s // 2) + (code % 2) * (s // 4)), -32768), 32767)::INTEGER, least(greatest(r.i + {indexes}[code % 8 + 1], 0), 88)::INTEGER
 FROM (SELECT *, {steps}[i + 1] AS s FROM r) r JOIN n ON n.page_id = r.page_id AND n.ch = r.ch AND n.k = r.k)
 SELECT r.page_id::VARCHAR AS path, k AS frame_no, list(x::BIGINT ORDER BY ch) AS samples FROM r JOIN p ON p.page_id = r.page_id AND k < words * 8 - 1 GROUP BY 1, 2""")

    # an M4A file a page, media first: 5 to 8 samples of 1 to 5 bytes; two chunks of two samples, then chunks of one, with three bytes between chunks
    def m4a_files(s, d: str) -> DataFrame:
        n = (pid() % 4 + 5).cast("int")
        sizes = F.transform(F.sequence(F.lit(0), n - 1), lambda k: ((k * 7 + pid()) % 5 + 1).cast("long"))
        upto = lambda k: F.aggregate(F.slice(sizes, F.lit(1), k.cast("int")), F.lit(0).cast("long"), lambda a, v: a + v)
        first = lambda c: F.when(c < 2, c * 2).otherwise(c + 2)
        offsets = F.transform(F.sequence(F.lit(0), n - 3), lambda c: 20 + upto(first(c)) + 3 * c)
        media = F.rpad(F.concat(_ascii("mediabytes"), url()), 64, b"\x2e")
        esds = _box("esds", _hex("00000000", "0319", "000100", "0411", "40", "15000000" + "00" * 8, "0502", "1290", "060102"))
        stsd = _box("stsd", _hex("00000000", "00000001"), _box("mp4a", _zeros(28), esds))
        tables = [stsd, _box("stts", _hex("00000000", "00000002", "00000003", "00000400"), _int(n - 3, 4, True), _hex("00000200")), _box("stsc", _hex("00000000", "00000002", "00000001", "00000002", "00000001", "00000003", "00000001", "00000001")), _box("stsz", _hex("00000000", "00000000"), _int(n, 4, True), _ints(sizes))]
        stco = F.when(pid() % 2 == 0, _box("stco", _hex("00000000"), _int(n - 2, 4, True), _ints(offsets))).otherwise(_box("co64", _hex("00000000"), _int(n - 2, 4, True), _ints(offsets, 8)))
        # in steps, each a column: a box holds its content twice
        own = pages(s, d).select("page_id", media.alias("media"), F.concat(*tables, stco).alias("in"))
        for name in ("stbl", "minf", "mdia", "trak"):
            own = own.withColumn("in", _box(name, F.col("in")))
        other = _box("trak", _box("mdia", _box("hdlr", _zeros(4))))
        whole = F.concat(_box("ftyp", _ascii("M4A ")), _box("mdat", F.col("media")), _box("moov", other, F.col("in")))
        return made(own.select(pid().cast("string").alias("path"), whole.alias("content")))

    _M4A = """p AS (SELECT page_id, 5 + page_id % 4 AS n, rpad('mediabytes' || url, 64, '.') AS media FROM pages),
 z AS (SELECT page_id, n, media, k, (k * 7 + page_id) % 5 + 1 AS size, CASE WHEN k < 4 THEN k // 2 ELSE k - 2 END AS chunk FROM p, unnest(range(0, n)) t(k)),
 m AS (SELECT *, 20 + sum(size) OVER (PARTITION BY page_id ORDER BY k) - size + 3 * chunk AS o, CASE WHEN k < 3 THEN k * 1024 ELSE 3072 + (k - 3) * 512 END AS time FROM z)"""
    add("mp4_places", lambda s, d: mp4.sample_places(mp4.mp4_tables(m4a_files(s, d))).withColumnRenamed("sample", "k"), f'WITH {_M4A} SELECT page_id::VARCHAR AS path, 1::INTEGER AS track, k, chunk, o::BIGINT AS "at", size, time FROM m')
    add("mp4_samples", lambda s, d: mp4.mp4_samples(m4a_files(s, d)).withColumn("bytes", F.hex("bytes")), f'WITH {_M4A} SELECT page_id::VARCHAR AS path, 1::INTEGER AS track, k, o::BIGINT AS "at", size, time, substr(hex(media), 2 * (o - 20)::BIGINT + 1, 2 * size) AS bytes FROM m')
    add("m4a_frames", lambda s, d: mp4.m4a_frames(m4a_files(s, d)).withColumn("frame", F.hex("frame")), f"WITH {_M4A} SELECT page_id::VARCHAR AS path, 1::INTEGER AS track, k, 'audio/aac' AS type, time, 'FFF15480' || printf('%02X', (size + 7) // 8) || printf('%02X', (size + 7) % 8 * 32 + 31) || 'FC' || substr(hex(media), 2 * (o - 20)::BIGINT + 1, 2 * size) AS frame FROM m")

    # a transport stream a page: association table, map of an AAC and a video stream, and three PES packets of which the second takes two packets, the second one of them lost for every third page
    def packet(packet_id: Column | int, starts: Column | int, counter: Column | int, payload: Column) -> Column:
        number = lambda v: F.lit(v) if isinstance(v, int) else v
        stuffing = 183 - F.length(payload)
        field = F.concat(_int(stuffing, 1), F.when(stuffing > 0, F.concat(_hex("00"), F.unhex(F.repeat(F.lit("FF"), (stuffing - 1).cast("int"))))).otherwise(_zeros(0)))
        return F.concat(_int(0x47, 1), _int(number(starts) * 0x4000 + number(packet_id), 2, True), _int(number(counter) + 0x30, 1), field, payload)

    stamp = lambda v, mark: _int(F.shiftleft(F.lit(mark).cast("long"), 36).bitwiseOR(F.shiftleft(F.shiftright(v, 30), 33)).bitwiseOR(F.shiftleft(F.shiftright(v, 15).bitwiseAND(0x7FFF), 17)).bitwiseOR(F.shiftleft(v.bitwiseAND(0x7FFF), 1)).bitwiseOR(F.lit(0x100010001)), 5, True)

    def ts_files(s, d: str) -> DataFrame:
        map_pid, audio = pid() % 100 + 4000, pid() % 50 + 300
        pat = F.concat(_hex("00", "00B011", "0001C10000", "0000E010", "0001"), _int(map_pid + 0xE000, 2, True), _hex("FFFFFFFF"))
        pmt = F.concat(_hex("00", "02B019", "0001C10000", "E100", "F002", "0504", "0F"), _int(audio + 0xE000, 2, True), _hex("F000", "1BE101", "F000", "FFFFFFFF"))
        pts = (pid() * 1_000_003) % 2**33
        one = F.concat(_hex("000001C0"), _int(8 + F.length(url()), 2, True), _hex("808005"), stamp(pts, 2), url(), _ascii("!!"))
        head = F.concat(_hex("000001E0", "0000", "80C00A"), stamp(pts, 3), stamp(F.greatest(pts - 3000, F.lit(0)), 1), url())
        lost = F.when(pid() % 3 == 0, _zeros(0)).otherwise(packet(257, 0, 8, F.concat(_ascii("more"), url())))
        three = F.concat(_hex("000001C0", "0000", "800000"), _ascii("end"))
        parts = [packet(0, 1, 0, pat), packet(map_pid, 1, 0, pmt), packet(audio, 0, 4, _ascii("stray")), packet(audio, 1, 5, one), packet(audio, 1, 5, one), packet(257, 1, 7, head), lost, packet(257, 0, 9, _ascii("tail")), packet(audio, 1, 6, three), packet(999, 1, 0, three)]
        return made(files(s, d, F.concat(*parts)))

    _PID = "page_id % 50 + 300"
    add("ts_streams", lambda s, d: transport.elementary_streams(codecs.transport_packets(ts_files(s, d))), f"SELECT page_id::VARCHAR AS path, 1::INTEGER AS program, unnest([{_PID}, 257])::INTEGER AS pid, unnest([15, 27])::INTEGER AS stream_type, unnest(['audio/aac', 'video/h264']) AS type FROM pages")
    add("pes_packets", lambda s, d: transport.pes_packets(ts_files(s, d)).withColumn("payload", F.decode("payload", "utf-8")), f"""SELECT page_id::VARCHAR AS path, 1::INTEGER AS program, pid::INTEGER AS pid, type, k, stream_id::INTEGER AS stream_id, CASE WHEN timed THEN pts END AS pts, CASE WHEN pid = 257 THEN greatest(pts - 3000, 0) END AS dts, payload, missing FROM (
 SELECT page_id, (page_id * 1000003) % 8589934592 AS pts, unnest([{_PID}, {_PID}, 257]) AS pid, unnest(['audio/aac', 'audio/aac', 'video/h264']) AS type, unnest([0::BIGINT, 1, 0]) AS k, unnest([192, 192, 224]) AS stream_id, unnest([true, false, true]) AS timed,
 unnest([url, 'end', url || CASE WHEN page_id % 3 = 0 THEN '' ELSE 'more' || url END || 'tail']) AS payload, unnest([false, false, page_id % 3 = 0]) AS missing FROM pages)""")

    # a program stream a page: packs of either version, an MPEG-1 and an MPEG-2 audio packet, a padding packet, a private one that is cut off
    def ps_files(s, d: str) -> DataFrame:
        v = (pid() * 7919) % 2**33
        first = F.concat(_hex("000001BA"), stamp(v, 2), _hex("800001"))
        second_bits = F.shiftleft(F.lit(1).cast("long"), 46).bitwiseOR(F.shiftleft(F.shiftright(v, 30), 43)).bitwiseOR(F.shiftleft(F.shiftright(v, 15).bitwiseAND(0x7FFF), 27)).bitwiseOR(F.lit(1 << 42)).bitwiseOR(F.lit(1 << 26)).bitwiseOR(F.shiftleft(v.bitwiseAND(0x7FFF), 11)).bitwiseOR(F.lit(1 << 10))
        second = F.concat(_hex("000001BA"), _int(second_bits, 6, True), _hex("000003F8"))
        old = F.concat(_hex("000001C1"), _int(F.length(url()) + 9, 2, True), _hex("FFFF", "4020"), _hex("2100010001"), url())
        new = F.concat(_hex("000001C0"), _int(F.length(url()) + 8, 2, True), _hex("808005", "2100010003"), url())
        padding = _hex("000001BE", "0004", "000001C0")
        return files(s, d, F.concat(_ascii("junk"), first, old, padding, F.when(pid() % 2 == 0, second).otherwise(_zeros(0)), new, _hex("000001BD", "0100", "800000"), _ascii("cut")))

    add("program_packets", lambda s, d: transport.program_packets(ps_files(s, d)).withColumn("payload", F.decode("payload", "utf-8")), """SELECT page_id::VARCHAR AS path, k::INTEGER AS k, (CASE k WHEN 0 THEN 16 ELSE 41 + strlen(url) + CASE WHEN page_id % 2 = 0 THEN 14 ELSE 0 END + CASE WHEN k = 2 THEN 14 + strlen(url) ELSE 0 END END)::BIGINT AS "at",
 [193, 192, 189][k + 1]::INTEGER AS stream_id, page_id * 7919 AS clock, CASE k WHEN 0 THEN 0 WHEN 1 THEN 1 END::BIGINT AS pts, NULL::BIGINT AS dts, CASE k WHEN 2 THEN 'cut' ELSE url END AS payload FROM pages, range(0, 3) t(k)""")
