"""Fixed vectors of blocks, decimation, centering and transitions, and long streams through the filters that cut them into blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import codecs, wav
from wavemill.operators import blocks, history, recursive, scalar, timeline


def long_form(spark, *streams):
    rows = [(s, k, x) for s, own in enumerate(streams) for k, x in enumerate(own)]
    return spark.createDataFrame(rows, "stream_id long, frame_no long, x int").repartition(3)


def frame_form(spark, *streams):
    rows = [(s, k, list(x)) for s, own in enumerate(streams) for k, x in enumerate(own)]
    return spark.createDataFrame(rows, "stream_id long, frame_no long, samples array<int>").repartition(3)


def values(df, name="x", by="frame_no"):
    out = {}
    for r in df.orderBy("stream_id", by).collect():
        out.setdefault(r.stream_id, []).append(r[name])
    return [out[k] for k in sorted(out)]


def test_bins(spark):
    """Streams that begin anew stand for a reset."""
    stereo = frame_form(spark, [(k, 100 + k) for k in range(1, 9)])
    assert values(blocks.bin_channels(stereo, 4, 2), "samples", "block_no") == [[[10, 410], [26, 426]]]
    assert values(blocks.bin_frames(long_form(spark, [2, 4, 6, 8]), 4, True), by="block_no") == [[5]]
    assert values(blocks.bin_frames(long_form(spark, [1, 2], [10, 20, 30, 40]), 4), by="block_no") == [[100]]
    assert blocks.bin_frames(long_form(spark, [1, 2, 3]), 0).count() == 0
    assert blocks.bin_channels(stereo, 0, 2).count() == 0


def test_bin_differences(spark):
    rows = [(10, 1, 100, 5), (20, 2, 200, 10), (30, 3, 300, 15), (40, 4, 400, 20)]
    four = frame_form(spark, rows, rows[:1], rows[2:])
    assert values(blocks.bin_channels(four, 2, 4, False, True), "samples", "block_no") == [[[27, 285], [63, 665]], [[63, 665]]]
    assert values(blocks.bin_channels(frame_form(spark, rows[:2]), 2, 4, True, True), "samples", "block_no") == [[[13, 142]]]
    assert blocks.bin_channels(four, 0, 4, False, True).count() == 0


def test_decimation(spark):
    assert values(blocks.decimate(long_form(spark, [1, 2, 3, 4, 5, 6]), 3)) == [[3, 6]]
    assert values(blocks.decimate(long_form(spark, [1, 2], [10, 20, 30]), 3)) == [[30]]
    assert blocks.decimate(long_form(spark, [1, 2]), 0).count() == 0


def test_centering(spark):
    assert values(timeline.center_by_first(long_form(spark, [100] * 4, [50] * 4), 4)) == [[0] * 4, [0] * 4]


@pytest.mark.parametrize("channel", [0, 1])
def test_transitions(spark, channel):
    """A later call goes on with the factor of the one before, so a stream of both calls is weighed at its first or last frames only."""
    first, second = [(10, 20), (30, 40)], [(50, 60), (70, 80)]
    mono = lambda rows: [r[channel] for r in rows]
    rows = long_form(spark, mono(first + second))
    start = rows.withColumn("x", scalar.smooth_start(F.col("x"), F.col("frame_no"), 0.5))
    assert values(start) == [mono([(0, 0), (15, 20), *second])]
    assert values(timeline.smooth_end(long_form(spark, mono(first)), 0.5)) == [mono([(5, 10), (0, 0)])]


def test_fades_and_loops(spark):
    assert values(timeline.fade_out(long_form(spark, [100] * 5, [8]), 2)) == [[100, 100, 100, 50, 0], [0]]
    assert values(timeline.loop(long_form(spark, [1, 2], [7]), 2)) == [[1, 2, 1, 2], [7, 7]]


def test_compressor_phases(spark):
    got = values(recursive.fold(long_form(spark, [20000, 0, 0, 20000, 100, 20000]), recursive.compressor(1000)), "y")
    assert [int(y) for y in got[0]] == [19666, 0, 0, 18666, 91, 17999]


@pytest.mark.parametrize("block", [1, 7, 64, 100, 4096])
def test_blocks_of_a_linear_filter(spark, block):
    """Blocks of any size give what one walk gives, for a long stream, a short one and one of a single frame."""
    rng = np.random.default_rng(1)
    rows = long_form(spark, rng.integers(-9000, 9000, 700).tolist(), rng.integers(-9000, 9000, 30).tolist(), [5])
    sections = [recursive.biquad("low_pass", 1000, 44100), recursive.biquad("high_shelf", 3000, 44100, gain_db=6)]
    want = values(recursive.fold(rows, recursive.chain(*(recursive.biquad_df2(*s) for s in sections))), "y")
    got = values(recursive.linear(rows, sections, block), "y")
    assert [len(g) for g in got] == [700, 30, 1]
    assert all(np.allclose(g, w, atol=1e-6) for g, w in zip(got, want, strict=True))
    assert recursive.linear(rows.limit(0), sections, block).count() == 0


def test_filters_per_channel(spark):
    rows = frame_form(spark, [(100 * k, -k) for k in range(20)])
    gain = lambda g: lambda: lambda x: g * x
    got = values(recursive.fold_channels(rows, [gain(2.0), gain(-1.0)]), "samples")
    assert got == [[[200.0 * k, float(k)] for k in range(20)]]


def test_format_conversion(spark):
    rows = frame_form(spark, [(k * 100, k * 50) for k in range(9)])
    assert values(history.convert_format(rows, (44100, 44100), (2, 2), (16, 16)), "samples") == [[[k * 100, k * 50] for k in range(9)]]
    half = values(history.convert_format(rows, (44100, 22050), (2, 1), (16, 16)), "samples")
    assert half == [[[k * 100 // 2 + k * 50 // 2] for k in range(0, 8, 2)]]


def test_codes_of_extreme_samples(spark):
    extremes = [-32768, -32767, -1, 0, 1, 32766, 32767]
    df = spark.createDataFrame([(x,) for x in extremes], "x int")
    got = df.select("x", codecs.a_law(F.col("x")).alias("a"), codecs.l8_encode(F.col("x")).alias("l"), codecs.pcm_samples(codecs.pcm_bytes(F.array("x"), 2), 2)[0].alias("p")).collect()
    assert [r.p for r in got] == extremes
    assert all(0 <= r.a <= 255 and 0 <= r.l <= 255 for r in got)
    assert [r.a for r in got if r.x in (-1, 0)] == [0x55, 0xD5]
    assert df.limit(1).select(F.size(codecs.pcm_samples(F.lit(b"\x01"), 2)).alias("n")).first().n == 0


def test_broken_files_give_what_is_whole(spark):
    files = lambda *parts: spark.createDataFrame([(str(k), p) for k, p in enumerate(parts)], "path string, content binary")
    nested = b"RIFF" + (20).to_bytes(4, "little") + b"AVI LIST" + (4).to_bytes(4, "little") + b"hdrl" + b"xxxx"
    assert [(r.depth, r.id, r.kind) for r in codecs.chunks(files(nested, None, b"", b"RIFF\xff\xff\xff\xff")).collect()] == [(0, "RIFF", "AVI "), (1, "LIST", "hdrl")]
    box = (8).to_bytes(4, "big") + b"free"
    wide = (1).to_bytes(4, "big") + b"moov" + (24).to_bytes(8, "big") + box
    assert [(r.depth, r.type, r.size) for r in codecs.boxes(files(box + wide + b"\0\0\0\x04bad!", b"\0")).collect()] == [(0, "free", 0), (0, "moov", 8), (1, "free", 0)]
    assert codecs.transport_packets(files(b"G" * 187, None)).count() == 0
    assert codecs.ima_samples(files(b"\x01", b"\x07\x00\x00\x00")).collect()[0].x == 7
    assert wav.wav_frames(files(b"RIFF", None)).count() == 0
