"""Formats that are walked part by part, codes, and filters with rings."""

from pyspark.sql import functions as F

from tests.test_signals import long, values
from wavemill.functions import containers
from wavemill.operators import recursive


def _files(spark, *items):
    return spark.createDataFrame([(str(k), None if b is None else bytearray(b)) for k, b in enumerate(items)], "path string, content binary")


def _rows(df, *columns):
    return [tuple(r) for r in df.select("path", *columns).orderBy("path", "k").collect()]


def test_icy_parts(spark):
    files = _files(spark, b"abcd\1" + b"StreamTitle='T';" + b"efgh\0ij", b"", None)
    assert [(p, bytes(a), m) for p, a, m in _rows(containers.icy_parts(files, 4), "audio", "metadata")] == [("0", b"abcd", "StreamTitle='T';"), ("0", b"efgh", ""), ("0", b"ij", "")]


def test_id3v2_frames(spark):
    body = b"TIT2" + (6).to_bytes(4, "big") + b"\0\0\0Title" + b"TPE1" + (6).to_bytes(4, "big") + b"\0\0\3B\xc3\xa4nd" + b"\0" * 20
    files = _files(spark, b"ID3\3\0\0\0\0\0" + bytes([len(body)]) + body, b"ID3", b"none", None)
    assert _rows(containers.id3v2_frames(files), "frame", "text") == [("0", "TIT2", "Title"), ("0", "TPE1", "Bänd")]


def test_chunks_and_records(spark):
    files = _files(spark, b"4\r\nWiki\r\nA;x=1\r\n0123456789\r\n0\r\n\r\n", b"zz\r\n", b"", None)
    assert [bytes(c) for _, c in _rows(containers.http_chunks(files), "chunk")] == [b"Wiki", b"0123456789"]
    files = _files(spark, (2).to_bytes(8, "little") + b"ab" + (0).to_bytes(8, "little") + (9).to_bytes(8, "little") + b"x", b"", None)
    assert [bytes(c) for _, c in _rows(containers.framed_records(files), "record")] == [b"ab", b""]


def test_adts_header(spark):
    files = _files(spark, bytes([0xFF, 0xF1, 0x50, 0x80, 0x2E, 0x7F, 0xFC]), b"\xff", b"", None)
    got = [tuple(r) for r in files.select("path", *containers.adts_header(F.col("content"))).orderBy("path").collect()]
    assert got == [("0", 2, 44100, 2, 371), *[(str(k), None, None, None, None) for k in (1, 2, 3)]]


def test_hamming_corrects_any_one_bit(spark):
    code = containers.hamming_encode(F.col("id").cast("int"))
    got = spark.range(16).select("id", *[containers.hamming_decode(code.bitwiseXOR(F.lit(1 << k if k < 7 else 0))).alias(f"y{k}") for k in range(8)])
    assert all(set(r[1:]) == {r.id} for r in got.collect())


def test_rings(spark):
    rows = long(spark, [1, 2, 3, 4, 5, 6, 7, 8])
    assert values(recursive.fold(rows, recursive.ring_pitch(1.0, 4)), "frame_no", "y") == [1, 2, 3, 4, 5, 6, 7, 8]
    assert values(recursive.fold(rows, recursive.ring_pitch(0.5, 8)), "frame_no", "y") == [1, 1, 2, 2, 3, 3, 4, 4]
    half = recursive.iir([0.5], [1.0])
    assert values(recursive.fold(long(spark, [8, 0, 0, 0, 0]), recursive.filtered_delay(2, half, 0.5)), "frame_no", "y") == [8, 0, 8, 0, 2]
