"""Operators on positions in time, parsers, and operators on unbounded streams."""

import binascii

import pytest
from pyspark.sql import functions as F

from tests.test_signals import long, values
from wavemill.functions import metadata
from wavemill.operators import recursive, timeline
from wavemill.streaming import stateful


def test_pops_tails_and_empty_streams(spark):
    rows = long(spark, [5, 3, -1, 4, 2, -6, -7, -2])
    assert values(timeline.remove_pops(rows, 8), "frame_no", "x") == [0, 0, -1, 4, 2, -6, -7, -2]
    assert values(timeline.remove_pops(rows, 8, "end"), "frame_no", "x") == [5, 3, -1, 4, 2, 0, 0, 0]
    assert values(timeline.remove_pops(long(spark, [1, 2]), 8), "frame_no", "x") == [0, 0]
    assert values(timeline.fade_tail(long(spark, [9, 8]), 4), "frame_no", "x") == [9, 8, 6, 4, 2, 0]
    assert timeline.fade_tail(rows.limit(0), 4).count() == 0
    assert values(timeline.center_by_first(long(spark, [100] * 4 + [50] * 4), 4), "frame_no", "x") == [0] * 4 + [-50] * 4


def test_triangle_walks_by_one(spark):
    y = values(spark.range(20).select("id", timeline.triangle(F.col("id"), 4).alias("y")), "id", "y")
    assert y[:13] == [1, 2, 3, 2, 1, 0, -1, -2, -3, -2, -1, 0, 1]


def test_pink_noise_repeats_and_keeps_its_range(spark):
    y = lambda: values(spark.range(500).select("id", timeline.pink_noise(F.col("id"), 100, 3).alias("y")), "id", "y")
    assert y() == y() and max(map(abs, y())) <= 100 and len(set(y())) > 50


def test_synthesizer_averages_the_voices_that_sound(spark):
    notes = spark.createDataFrame([(1, 0, 30, 100.0, 1000.0), (1, 0, 30, 100.0, 3000.0)], "stream_id long, start long, length long, hz double, amplitude double")
    one = {r.frame_no: r.x for r in timeline.synthesize(notes.limit(1), 8000).collect()}
    both = {r.frame_no: r.x for r in timeline.synthesize(notes, 8000).collect()}
    assert set(one) == set(range(50)) and all(abs(both[k] - 2 * one[k]) <= 3 for k in one)


def _bytes(spark, *items):
    return spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(items)], "k long, content binary")


def test_crc_and_frames(spark):
    items = [b"123456789", b"", b"\x7e\x7d ok", bytes(range(256))]
    got = _bytes(spark, *items).select("k", metadata.crc16(F.col("content")).alias("crc"), metadata.hdlc_frame(F.col("content")).alias("frame"))
    assert values(got, "k", "crc") == [binascii.crc_hqx(b, 0xFFFF) for b in items]
    for b, frame in zip(items, values(got, "k", "frame"), strict=True):
        raw = bytes.fromhex(frame)
        assert raw[0] == raw[-1] == 0x7E and 0x7E not in raw[1:-1]
        inner = raw[1:-1].replace(b"\x7d\x5e", b"\x7e").replace(b"\x7d\x5d", b"\x7d")
        assert inner == b + binascii.crc_hqx(b, 0xFFFF).to_bytes(2, "big")


def test_types_and_tags(spark):
    wav = b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0"
    items = [wav + b"\1\0", wav + b"\2\0", b"fLaC", b"OggS" + b"\0" * 24 + b"OpusHead", b"ID3\3", b"\xff\xfb\x90", b"\xff\xf1\x50", b"<html>", b""]
    found = _bytes(spark, *items).select("k", metadata.type_by_bytes(F.col("content")).alias("y"))
    assert values(found, "k", "y") == ["audio/wav", "audio/adpcm", "audio/flac", "audio/ogg; codecs=opus", "audio/mpeg", "audio/mpeg", "audio/aac", None, None]
    tag = b"TAG" + b"Song".ljust(30, b"\0") + b"Band".ljust(30) + b"Disk".ljust(30, b"\0") + b"1999" + b"\0" * 31
    rows = _bytes(spark, b"x" * 500 + tag, b"TAG", b"").select("k", *metadata.id3v1(F.col("content"))).orderBy("k").collect()
    assert rows[0][1:] == ("Song", "Band", "Disk", "1999") and rows[1][1:] == rows[2][1:] == (None,) * 4
    title = spark.createDataFrame([("StreamTitle='A - B';StreamUrl='';",), ("",), (None,)], "m string").select(metadata.stream_title(F.col("m")).alias("y"))
    assert [r.y for r in title.collect()] == ["A - B", None, None]


def test_ringtone(spark):
    got = metadata.ringtone_notes(spark.createDataFrame([(1, "Tune:d=4,o=5,b=120:8a4,p,2c#6."), (2, None)], "tune_id long, text string")).orderBy("k").collect()
    assert [(r.k, r.start_ms, r.ms) for r in got] == [(0, 0, 250), (1, 250, 500), (2, 750, 1500)]
    assert got[0].hz == pytest.approx(440) and got[1].hz == 0 and got[2].hz == pytest.approx(1108.73, abs=0.01)


def _stream(spark, folder, parts):
    for k, xs in parts:
        spark.createDataFrame([(1, k + i, x) for i, x in enumerate(xs)], "stream_id long, frame_no long, x int").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("stream_id long, frame_no long, x int").option("maxFilesPerTrigger", 1).parquet(folder)


def _run(df, name, tmp_path):
    df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_blocks_equal_batch_blocks(spark, tmp_path):
    rows = _stream(spark, str(tmp_path / "in"), [(0, [1, 2, 3]), (3, [4, 5, 6, 7]), (400, [0])])
    got = _run(stateful.bin_stream(rows, 2, 10), "bins", tmp_path)
    assert [(r.block_no, r.x) for r in got.orderBy("block_no").collect()] == [(0, 3), (1, 7), (2, 11)]


def test_stream_fold_equals_batch_fold(spark, tmp_path):
    def step(state, x):
        y = 0.9 * state[0] + 0.1 * x
        return (y,), y

    xs = [5, -3, 8, 1, 9, 2]
    got = values(_run(stateful.fold_stream(_stream(spark, str(tmp_path / "in"), [(0, xs[:4]), (4, xs[4:])]), (0.0,), step), "folds", tmp_path), "frame_no", "y")
    want = values(recursive.fold(long(spark, xs), recursive.iir([0.1], [1.0, -0.9])), "frame_no", "y")
    assert got == pytest.approx(want)


def test_types_of_all_extensions(spark):
    want = {"a.WMA": "audio/x-ms-wma", "a.m4a": "audio/m4a", "a.wav": "audio/vnd.wave", "a.opus": "audio/ogg; codecs=opus", "a.b.ts": "video/MP2T", "a.caf": "audio/x-caf", "a.": None, "mp3": None, "a.xyz": None}
    rows = spark.createDataFrame([(n,) for n in want], "n string").select("n", metadata.type_by_name(F.col("n")).alias("y")).collect()
    assert {r.n: r.y for r in rows} == want and len(metadata.TYPES) == 35
