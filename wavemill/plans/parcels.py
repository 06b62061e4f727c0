"""Queries of segments, transfer records, AVI streams, dispatch by type, OSC floats and extended tags, whose layout varies with the page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.functions import codecs, containers, fec, metadata, segments
from wavemill.plans.media import made
from wavemill.sources import signals


def _hex(*parts: str) -> Column:
    return F.unhex(F.lit("".join(parts)))


def _ascii(value: str) -> Column:
    return F.encode(F.lit(value), "utf-8")


def _int(value: Column | int, size: int) -> Column:
    return F.unhex(codecs.pcm_hex(F.lit(value) if isinstance(value, int) else value, size))


def _chunk(name: Column | str, body: Column) -> Column:
    return F.concat(_ascii(name) if isinstance(name, str) else name, _int(F.length(body), 4), body, F.unhex(F.repeat(F.lit("00"), (F.length(body) % 2).cast("int"))))


def register(add: Callable) -> None:
    pages = lambda s, d: signals.table(s, d, "pages")
    files = lambda s, d, c: pages(s, d).select(F.col("page_id").cast("string").alias("path"), c.alias("content"))
    url = lambda: F.encode("url", "utf-8")
    pid = lambda: F.col("page_id")
    none = lambda: F.unhex(F.lit(""))

    # a header, audio, junk, audio of a wrong check sum, meta data, a second header for every other page, and audio under it; the last segment is cut off
    def parcels(s, d: str) -> DataFrame:
        good = segments.segment("audio", url())
        bad = F.concat(F.substr(good, F.lit(1), F.length(good) - 1), _hex("00"))
        again = F.when(pid() % 2 == 0, segments.segment("header", segments.audio_info(48000, 1, 24))).otherwise(none())
        return files(s, d, F.concat(_ascii("xx"), segments.segment("header", segments.audio_info(pid() + 8000, 2, 16)), good, _hex("0D0AFF"), bad, segments.segment("meta", _ascii("about")), again, segments.segment("audio", _ascii("tail")), F.substring(good, 1, 9)))

    size = "strlen(url)"
    add("container_segments", lambda s, d: segments.segments(parcels(s, d)).withColumn("payload", F.hex("payload")), f"""WITH t AS (SELECT page_id, url, unnest(CASE WHEN page_id % 2 = 0 THEN [0, 1, 2, 3, 4] ELSE [0, 1, 2, 4] END) AS c FROM pages)
 SELECT page_id::VARCHAR AS path, row_number() OVER (PARTITION BY page_id ORDER BY c)::INTEGER - 1 AS k, ['header', 'audio', 'meta', 'header', 'audio'][c + 1] AS kind,
 (CASE c WHEN 0 THEN 2 WHEN 1 THEN 18 WHEN 2 THEN 37 + 2 * {size} WHEN 3 THEN 50 + 2 * {size} ELSE 50 + 2 * {size} + CASE WHEN page_id % 2 = 0 THEN 16 ELSE 0 END END)::BIGINT AS "at",
 CASE c WHEN 0 THEN printf('%02X%02X0000', (page_id + 8000) % 256, (page_id + 8000) // 256) || '02001000' WHEN 1 THEN hex(url) WHEN 2 THEN hex('about') WHEN 3 THEN '80BB000001001800' ELSE hex('tail') END AS payload,
 CASE WHEN c >= 3 AND page_id % 2 = 0 THEN 48000 ELSE page_id + 8000 END::INTEGER AS rate, CASE WHEN c >= 3 AND page_id % 2 = 0 THEN 1 ELSE 2 END::INTEGER AS channels, CASE WHEN c >= 3 AND page_id % 2 = 0 THEN 24 ELSE 16 END::INTEGER AS bits FROM t""")

    # a transfer: its numbers start near the end of 16 bits, and page_id % 4 records are lost before the second piece of data
    def transfer(s, d: str) -> DataFrame:
        at = lambda k: F.pmod(pid() * 37 + 65530 + k, F.lit(65536))
        begin = segments.sync_record("begin", at(0), F.concat(segments.audio_info(8000, 1, 16), _hex("02")))
        return files(s, d, F.concat(begin, segments.sync_record("receive", at(1), _int(pid() % 999, 2)), segments.sync_record("send", at(2), url()), segments.sync_record("send", at(3 + pid() % 4), _ascii("rest")), segments.sync_record("end", at(4 + pid() % 4)), _hex("7B02")))

    add("sync_records", lambda s, d: segments.sync_records(transfer(s, d)).withColumn("payload", F.hex("payload")), """SELECT page_id::VARCHAR AS path, k::INTEGER AS k, ['begin', 'receive', 'send', 'send', 'end'][k + 1] AS kind, ((page_id * 37 + 65530 + k + CASE WHEN k > 2 THEN page_id % 4 ELSE 0 END) % 65536)::INTEGER AS seq,
 CASE k WHEN 0 THEN '401F0000010010000200' || '0000' WHEN 1 THEN printf('%02X%02X', page_id % 999 % 256, page_id % 999 // 256) WHEN 2 THEN hex(url) WHEN 3 THEN hex('rest') ELSE '' END AS payload, CASE WHEN k = 3 THEN page_id % 4 ELSE 0 END::INTEGER AS missing FROM pages, range(0, 5) t(k)""")

    # an AVI file: an audio and a video stream, chunks of odd size in a list inside `movi`, an index that counts from the list or, for odd pages, from the file's beginning
    def avi(s, d: str) -> DataFrame:
        strh = lambda kind, handler, scale, rate: _chunk("strh", F.concat(_ascii(kind), _ascii(handler), F.unhex(F.lit("00" * 12)), _int(scale, 4), _int(rate, 4), F.unhex(F.lit("00" * 28))))
        wide = _chunk("strf", F.concat(_int(40, 4), _int(pid() + 320, 4), _int(240, 4), F.unhex(F.lit("00" * 28))))
        sound = _chunk("strf", F.concat(_int(1, 2), _int(2, 2), _int(pid() + 8000, 4), _int(32000, 4), _int(4, 2), _int(16, 2)))
        own = pages(s, d).select("page_id", F.encode("url", "utf-8").alias("u"))
        # in steps, each a column: a part's bytes stand three times in the chunk around it
        steps = {
            "vids": F.concat(_ascii("strl"), strh("vids", "MJPG", 1001, 30000), wide),
            "auds": F.concat(_ascii("strl"), strh("auds", "\x00" * 4, 1, pid() + 8000), sound),
            "hdrl": F.concat(_ascii("hdrl"), _chunk("avih", _hex("00" * 4)), _chunk("LIST", F.col("vids")), _chunk("LIST", F.col("auds"))),
            "head": _chunk("LIST", F.col("hdrl")),
            "rec": F.concat(_ascii("rec "), _chunk("01wb", _ascii("abc")), _chunk("00dc", _ascii("xy"))),
            "movi": F.concat(_ascii("movi"), _chunk("00dc", F.col("u")), _chunk("LIST", F.col("rec")), _chunk("JUNK", _ascii("0")), _chunk("01wb", F.col("u"))),
            "start": F.when(pid() % 2 == 1, 12 + F.length("head") + 8).otherwise(0),
            "after": 4 + 8 + F.length("u") + F.length("u") % 2,
        }
        entry = lambda name, flags, at: F.concat(_ascii(name), _int(flags, 4), _int(F.col("start") + at, 4), _int(0, 4))
        steps["index"] = F.concat(entry("00dc", 0x10, F.lit(4)), entry("01wb", 0x10, F.col("after") + 12), entry("00dc", 0, F.col("after") + 24))
        steps["body"] = F.concat(_ascii("AVI "), F.col("head"), _chunk("LIST", F.col("movi")), _chunk("idx1", F.col("index")))
        for name, column in steps.items():
            own = own.withColumn(name, column)
        return made(own.select(pid().cast("string").alias("path"), F.concat(_ascii("RIFF"), _int(F.length("body"), 4), F.col("body")).alias("content")))

    add("avi_streams", lambda s, d: segments.avi_streams(avi(s, d)).withColumn("handler", F.rtrim(F.replace("handler", F.lit("\x00"), F.lit(" ")))).withColumn("per_second", F.round("per_second", 6)), """SELECT page_id::VARCHAR AS path, n::INTEGER AS stream, ['vids', 'auds'][n + 1] AS kind, ['MJPG', ''][n + 1] AS handler, CASE n WHEN 0 THEN round(30000 / 1001.0::DOUBLE, 6) ELSE page_id + 8000 END AS per_second,
 CASE n WHEN 1 THEN page_id + 8000 END AS rate, CASE n WHEN 1 THEN 2 END::BIGINT AS channels, CASE n WHEN 1 THEN 16 END::BIGINT AS bits, CASE n WHEN 0 THEN page_id + 320 END AS width, CASE n WHEN 0 THEN 240 END::BIGINT AS height FROM pages, range(0, 2) t(n)""")
    add("avi_samples", lambda s, d: segments.avi_samples(avi(s, d)).withColumn("bytes", F.decode("bytes", "utf-8")), """WITH p AS (SELECT page_id, url, strlen(url) AS n, strlen(url) + strlen(url) % 2 AS m FROM pages), o AS (SELECT *, 12 + 248 + 8 AS movi FROM p)
 SELECT page_id::VARCHAR AS path, [0, 1, 0, 1][c + 1]::INTEGER AS stream, [0, 0, 1, 1][c + 1]::BIGINT AS k, ['dc', 'wb', 'dc', 'wb'][c + 1] AS kind, (movi + CASE c WHEN 0 THEN 12 WHEN 1 THEN m + 32 WHEN 2 THEN m + 44 ELSE m + 64 END)::BIGINT AS "at",
 CASE c WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE n END::BIGINT AS size, [true, true, false, NULL][c + 1] AS key, CASE c WHEN 1 THEN 'abc' WHEN 2 THEN 'xy' ELSE url END AS bytes FROM o, range(0, 4) t(c)""")

    # files of five types by page: WAV, mu-law WAV, MPEG frames behind a tag, AAC frames, and text, which is left out
    def mixed(s, d: str) -> DataFrame:
        wave = lambda kind, bits, body: F.concat(_ascii("RIFF"), _int(36 + F.length(body), 4), _ascii("WAVE"), _chunk("fmt ", F.concat(_int(kind, 2), _int(1, 2), _int(8000, 4), _int(8000, 4), _int(bits // 8, 2), _int(bits, 2))), _ascii("data"), _int(F.length(body), 4), body)
        frame = lambda head, n: F.concat(F.unhex(F.lit(head)), F.rpad(url(), n - len(head) // 2, b"\x00"))
        kinds = [wave(1, 8, url()), wave(7, 8, _hex("FF80")), F.concat(_ascii("ID3"), _hex("0300000000", "0002", "0000"), frame("FFF318C0", 36), frame("FFF31AC0", 37)), frame("FFF15080027FFC", 19), _ascii("plain text")]
        own = pages(s, d).filter("false").select(pid().cast("string").alias("path"), url().alias("content"))
        for k, content in enumerate(kinds):
            own = own.unionByName(files(s, d, content).filter(F.col("path").cast("long") % 5 == k))
        return made(own)

    add("decoded_by_type", lambda s, d: segments.decode_any(mixed(s, d)).withColumn("frame", F.hex("frame")), """WITH o AS (SELECT page_id, page_id % 5 AS t, hex(url) AS h, strlen(url) AS n, CASE page_id % 5 WHEN 0 THEN strlen(url) WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS parts FROM pages), e AS (SELECT *, unnest(range(0, parts)) AS k FROM o)
 SELECT page_id::VARCHAR AS path, ['audio/wav', 'audio/wav', 'audio/mpeg', 'audio/aac'][t + 1] AS type, k, CASE t WHEN 0 THEN [('0x' || substr(h, 2 * k + 1, 2))::BIGINT - 128] WHEN 1 THEN [[0, 32124][k + 1]::BIGINT] END AS samples,
 CASE t WHEN 2 THEN ['FFF318C0', 'FFF31AC0'][k + 1] || rpad(h, (64 + 2 * k)::INTEGER, '00')[1:64 + 2 * k] WHEN 3 THEN 'FFF15080027FFC' || rpad(h, 24, '00')[1:24] END AS frame FROM e""")

    message = lambda s, d: pages(s, d).select("page_id", containers.osc_message(F.lit("/level"), "fid", [pid() / 8 - 3.25, pid(), F.lit(0.1) * pid()]).alias("m"))
    add("osc_floats", lambda s, d: message(s, d).select("page_id", *containers.osc_values(F.col("m"), "fid")), "SELECT page_id, '/level' AS address, 'fid' AS format, page_id / 8 - 3.25::DOUBLE AS v0, page_id AS v1, 0.1::DOUBLE * page_id AS v2 FROM pages")
    text = lambda value, n: F.rpad(F.substring(value, 1, n), n, b"\x00")
    longer = lambda: F.concat(_ascii("TAG+"), F.rpad(F.substring(url(), 31, 60), 60, b"\x00"), text(_ascii("and more"), 60), text(_ascii(""), 60), _int(pid() % 5, 1), text(_ascii("Field recording"), 30), text(_ascii("00:01"), 6), text(_ascii("10:00"), 6))
    short = lambda: F.concat(_ascii("TAG"), F.rpad(F.substring(url(), 1, 30), 30, b"\x00"), text(_ascii("Somebody "), 30), F.unhex(F.lit("00" * 65)))
    add("id3v1_extended", lambda s, d: pages(s, d).select("page_id", *metadata.id3v1_extended(F.concat(url(), F.when(pid() % 3 > 0, longer()).otherwise(F.unhex(F.lit("00" * 227))), short()))), """SELECT page_id, CASE WHEN page_id % 3 > 0 THEN url[1:90] END AS title, CASE WHEN page_id % 3 > 0 THEN 'Somebody and more' END AS artist, CASE WHEN page_id % 3 > 0 THEN '' END AS album,
 CASE WHEN page_id % 3 > 0 THEN page_id % 5 END::INTEGER AS speed, CASE WHEN page_id % 3 > 0 THEN 'Field recording' END AS genre, CASE WHEN page_id % 3 > 0 THEN '00:01' END AS start, CASE WHEN page_id % 3 > 0 THEN '10:00' END AS end FROM pages""")

    # both tags: the one at the start has the title for odd pages only, the one at the end belongs to every page but each third
    frame = lambda name, c: F.concat(_ascii(name), F.unhex(codecs.pcm_hex(F.length(c) + 1, 4, True)), _hex("000003"), c)
    front = lambda: F.when(pid() % 2 == 1, frame("TIT2", _ascii("front"))).otherwise(frame("TYER", _ascii("1999")))
    tagged = lambda s, d: files(s, d, F.concat(F.when(pid() % 5 > 0, F.concat(_ascii("ID3"), _hex("0300000000", "00"), _int(F.length(front()), 1), front())).otherwise(none()), url(), F.when(pid() % 3 > 0, short()).otherwise(none())))
    add("id3_tags", lambda s, d: metadata.id3_tags(tagged(s, d)), """SELECT * FROM (SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 5 > 0 AND page_id % 2 = 1 THEN 'front' WHEN page_id % 3 > 0 THEN url[1:30] END AS title,
 CASE WHEN page_id % 3 > 0 THEN 'Somebody' END AS artist, NULL::VARCHAR AS album, CASE WHEN page_id % 5 > 0 AND page_id % 2 = 0 THEN '1999' END AS year FROM pages) WHERE title IS NOT NULL OR artist IS NOT NULL OR year IS NOT NULL""")

    # Hamming blocks of 16 bits: a bit of block page_id % 5 flips, for every third page a second one
    def noisy(s, d: str) -> DataFrame:
        code = fec.hamming_files(files(s, d, url()), 16).select("path", F.hex("content").alias("h"), F.col("path").cast("long").alias("p"))
        at = (F.col("p") % 5 * 4 + 1).cast("int")
        word = F.conv(F.substr("h", at, F.lit(4)), 16, 10).cast("int")
        flips = F.call_function("shiftleft", F.lit(1), (F.col("p") % 16).cast("int")).bitwiseXOR(F.when(F.col("p") % 3 == 0, F.call_function("shiftleft", F.lit(1), ((F.col("p") + 7) % 16).cast("int"))).otherwise(0))
        return code.select("path", F.unhex(F.overlay("h", F.lpad(F.hex(word.bitwiseXOR(flips)), 4, "0"), at)).alias("content"))

    add("hamming_content", lambda s, d: fec.hamming_content(noisy(s, d), 16).select("path", "fixed", "broken", F.when(F.col("broken") == 0, F.decode("content", "utf-8")).alias("text")).withColumn("text", F.replace("text", F.lit("\x00"), F.lit(""))), "SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 3 = 0 THEN 0 ELSE 1 END::INTEGER AS fixed, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END::INTEGER AS broken, CASE WHEN page_id % 3 > 0 THEN url END AS text FROM pages")
