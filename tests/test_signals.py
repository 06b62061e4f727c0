"""Golden vectors and properties of the signal operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import formats, text, wav
from wavemill.operators import blocks, channels, history, mixing, recursive, scalar, spectral


def long(spark, xs, stream=1):
    return spark.createDataFrame([(stream, k, x) for k, x in enumerate(xs)], "stream_id long, frame_no long, x int")


def frames(spark, rows):
    return spark.createDataFrame([(1, k, list(r)) for k, r in enumerate(rows)], "stream_id long, frame_no long, samples array<int>")


def values(df, key, col):
    return [r[col] for r in df.orderBy(key).collect()]


def test_bin_holds_back_an_incomplete_block(spark):
    rows = frames(spark, [(k, 100 + k) for k in range(1, 9)])
    assert values(blocks.bin_channels(rows, 4, 2), "block_no", "samples") == [[10, 410], [26, 426]]
    assert values(blocks.bin_frames(long(spark, [2, 4, 6, 8, 1]), 4, True), "block_no", "x") == [5]
    assert blocks.bin_frames(long(spark, [1, 2]), 0).count() == 0


def test_bin_difference(spark):
    rows = frames(spark, [(10, 1, 100, 5), (20, 2, 200, 10), (30, 3, 300, 15), (40, 4, 400, 20)])
    assert values(blocks.bin_channels(rows, 2, 4, False, True), "block_no", "samples") == [[27, 285], [63, 665]]
    assert values(blocks.bin_channels(rows, 2, 4, True, True), "block_no", "samples")[0] == [13, 142]


def test_decimate_and_center(spark):
    assert values(blocks.decimate(long(spark, [1, 2, 3, 4, 5, 6]), 3), "frame_no", "x") == [3, 6]
    assert values(blocks.center(long(spark, [100] * 4), 4), "frame_no", "x") == [0] * 4


def test_clip_and_scale_limits(spark):
    df = long(spark, [32767, -32768, 0, 500])
    assert values(df.withColumn("y", scalar.clip(F.col("x"), 32767)), "frame_no", "y") == [32767, -32767, 0, 500]
    assert values(df.withColumn("y", scalar.scale(F.col("x"), 1.7, -500, 30000)), "frame_no", "y") == [30000, -30000, -850, 0]


def test_channels_round_trip(spark):
    df = frames(spark, [(1, 2), (3, 4)])
    assert values(channels.join_channels(channels.split(df)), "frame_no", "samples") == [[1, 2], [3, 4]]
    assert values(channels.fill_empty(frames(spark, [(0, 2), (0, 4)])), "frame_no", "samples") == [[2, 2], [4, 4]]


def test_history_filters(spark):
    xs = [5, 9, 1, 7, 3, 8]
    df = long(spark, xs)
    assert values(history.fir(df, [1.0, 0.5]), "frame_no", "y") == pytest.approx(np.convolve(xs, [1.0, 0.5])[:6].tolist())
    assert values(history.median(df, 3), "frame_no", "y") == [0, 5, 5, 7, 3, 7]
    assert values(history.resample(df, 0.5), "frame_no", "y")[:4] == [5, 7, 9, 5]
    assert values(history.remove_silence(long(spark, [9, 0, 0, 0, 9]), 2, 2), "frame_no", "x") == [9, 0, 9]


def test_quality_counts_each_run_once(spark):
    loud, quiet = 32767, 0
    r = history.quality(long(spark, [20000] + [quiet] * 10 + [loud] * 3 + [quiet] * 9)).first()
    assert (r.frames, r.clicks, r.dropouts, r.clippings) == (23, 3, 1, 1)


@pytest.mark.parametrize("kind", ["low_pass", "high_pass", "band_pass", "notch", "low_shelf", "high_shelf"])
def test_both_forms_of_a_biquad_agree(spark, kind):
    b, a = recursive.biquad(kind, 500, 8000, gain_db=6)
    df = long(spark, [int(1000 * math.sin(k)) for k in range(60)])
    one, two = (values(recursive.fold(df, m), "frame_no", "y") for m in (recursive.iir(b, a), recursive.biquad_df2(b, a)))
    assert one == pytest.approx(two, abs=1e-6)


def test_fold_keeps_streams_apart_and_needs_no_order(spark):
    both = long(spark, [10, 20, 30]).union(long(spark, [10, 20, 30], 2)).orderBy(F.rand(3))
    out = recursive.fold(both, recursive.kalman())
    assert values(out.filter("stream_id = 1"), "frame_no", "y") == values(out.filter("stream_id = 2"), "frame_no", "y")
    assert recursive.fold(both.limit(0), recursive.kalman()).count() == 0


def test_echo_goes(spark):
    ref = np.random.default_rng(0).normal(size=2000)
    rows = [(1, k, float(0.6 * r), float(r)) for k, r in enumerate(ref)]
    y = values(mixing.lms(spark.createDataFrame(rows, "stream_id long, frame_no long, x double, ref double"), 2, 0.05), "frame_no", "y")
    assert np.square(y[1000:]).sum() < 0.05 * np.square(0.6 * ref[1000:]).sum()


def test_spectrum_and_overlap_add(spark):
    xs = [int(1000 * math.sin(2 * math.pi * 4 * k / 32)) for k in range(64)]
    blocks_ = spectral.blocks_of(long(spark, xs), 32, 16)
    top = spectral.peaks(spectral.magnitudes(blocks_, 32), 32, 32).collect()
    assert {r.bin for r in top} == {4} and len(top) == 3
    back = values(spectral.overlap_add(spectral.effect(blocks_, 32, lambda b: b, "rectangle"), 16), "frame_no", "y")
    assert back[16:48] == pytest.approx([2 * x for x in xs[16:48]], abs=1e-6)
    with pytest.raises(ValueError):
        spectral.magnitudes(blocks_, 12)


def test_mixing(spark):
    a, b = long(spark, [10, 20, 30]), long(spark, [1, 2])
    assert values(mixing.merge([(a, 1), (b, 2)]), "frame_no", "samples") == [[10, 2], [20, 4]]
    assert values(mixing.mix([(a, 1), (b, 1)]), "frame_no", "x") == [5, 11, 15]
    assert values(mixing.concatenate([b, a]), "frame_no", "x") == [1, 2, 10, 20, 30]
    assert spark.range(1).select(mixing.closest_rate(F.lit(20000))).first()[0] == 22050


def test_text_and_bytes(spark):
    one = spark.range(1)
    for pattern, given, want in (("*.mp3", "a.mp3", True), ("a?c", "abc", True), ("a?c", "ac", False), ("x; *b", "ab", True), ("", "", True), ("", "a", False)):
        assert one.select(text.glob_match(F.lit(given), pattern)).first()[0] is want
    xs = long(spark, [0, 1, -1, 1000, -1000, 32000])
    back = values(xs.withColumn("y", formats.mu_law_decoded(formats.mu_law(F.col("x")))), "frame_no", "y")
    assert all(abs(x - y) <= max(16, abs(x) / 16) for x, y in zip([0, 1, -1, 1000, -1000, 32000], back, strict=True))
    lists = spark.createDataFrame([(1, "#EXTM3U\n#EXTINF:4.5,\na.ts\n#EXTINF:3,\nb.ts\n#EXTINF:4.5,\na.ts\n")], "list_id int, text string")
    assert [tuple(r) for r in text.playlist_segments(lists).orderBy("seq").collect()] == [(1, 0, 4.5, "a.ts"), (1, 1, 3.0, "b.ts")]


def test_wav_header(spark):
    body = b"RIFF" + (44).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + b"\x01\x00\x02\x00" + (44100).to_bytes(4, "little") + (176400).to_bytes(4, "little") + b"\x04\x00\x10\x00" + b"data" + (8).to_bytes(4, "little") + bytes(8)
    df = spark.createDataFrame([("a", bytearray(body)), ("b", bytearray(b"no"))], "path string, content binary")
    assert [tuple(r) for r in wav.wav_header(df).drop("format").collect()] == [("a", 2, 44100, 16, 2)]


def test_joins_of_streams_read_whole_streams(spark, tmp_path):
    from wavemill.plans import registry

    x = [(k * 37) % 101 for k in range(90)]
    spark.createDataFrame([(k, 7, k, v / 100) for k, v in enumerate(x)], "event_id long, user_id long, ts long, value double").write.parquet(str(tmp_path / "events.parquet"))
    less = [-v for v in x[2::3]]
    rows = {n: [r[-1] for r in registry.queries()[f"{n}_whole"](spark, str(tmp_path)).orderBy("frame_no").collect()] for n in ("merge", "mix", "generator_average", "concatenate")}
    part = lambda v, w: int(v * (w / 150))
    assert rows["merge"] == [[a, int(b * 0.5)] for a, b in zip(x, less)]
    assert rows["mix"] == [part(v, 100) + (part(less[k], 50) if k < 30 else 0) for k, v in enumerate(x)]
    assert rows["generator_average"] == [int((v + less[k]) / 2) if k < 30 else v for k, v in enumerate(x)]
    assert rows["concatenate"] == less + x


def test_mix_depends_on_both_streams_and_adds_what_only_one_has(spark, tmp_path):
    from wavemill.plans import registry

    x = [(k * 37) % 101 * 9 for k in range(90)]
    spark.createDataFrame([(k, 7, k, v / 100) for k, v in enumerate(x)], "event_id long, user_id long, ts long, value double").write.parquet(str(tmp_path / "events.parquet"))
    rows = [tuple(r) for r in registry.queries()["mix"](spark, str(tmp_path)).orderBy("frame_no").collect()]
    part = lambda v, w: int(v * (w / 150))
    assert rows == [(7, k, (part(x[k], 100) if k < 90 else 0) + (part(-x[k - 20], 50) if k >= 20 else 0)) for k in range(110)]
    assert len({r[-1] for r in rows}) > 50
