"""Equalizer kernels, the chorus, the faded pitch ring and messages of addressed values."""

import numpy as np
from pyspark.sql import functions as F

from tests.test_signals import long, values
from wavemill.functions import containers
from wavemill.operators import history, recursive, timeline


def test_band_kernel_reaches_its_gain_at_the_centre(spark):
    assert history.band_kernel([0.0, 0.05], 8000, 9) == [0] * 4 + [32767] + [0] * 4
    kernel = np.asarray(history.band_kernel([-6.0], 8000, 255)) / 32767
    gain = abs(np.sum(kernel * np.exp(-2j * np.pi * np.sqrt(20 * 4000) / 8000 * np.arange(255))))
    assert abs(20 * np.log10(gain) + 6) < 0.05
    assert history.band_kernel([20.0, 0.0], 8000, 31) == history.band_kernel([12.0, 0.0], 8000, 31)
    y = values(history.band_equalizer(long(spark, [32767, 0, -5, 7]), [0.0], 8000, 3), "frame_no", "y")
    assert y == [0, 32766, 0, -5]


def test_chorus_takes_earlier_frames(spark):
    rows = long(spark, [10, 20, 40, 80, 160])
    assert values(timeline.chorus(rows, F.lit(0.0), 2, 3), "frame_no", "y") == [0, 0, 10, 20, 40]
    assert values(timeline.chorus(rows, F.lit(0.5), 1, 1), "frame_no", "y") == [0, 5, 15, 30, 60]
    assert timeline.chorus(rows.limit(0), F.lit(0.5), 1, 1).count() == 0
    lfo = values(spark.range(200).select("id", timeline.noise_lfo(F.col("id"), 10, 3).alias("y")), "id", "y")
    assert 0 <= min(lfo) and max(lfo) <= 1 and len(set(lfo)) > 100 and max(map(abs, np.diff(lfo))) <= 0.1


def test_faded_ring_of_shift_one_is_the_signal():
    step = recursive.ring_pitch_faded(1.0, 20)()
    assert [step(x) for x in range(50)] == list(range(50))
    step = recursive.ring_pitch_faded(1.3, 40)()
    y = [step(100.0) for _ in range(400)]
    assert y[-200:] == [100.0] * 200


def test_messages_round_trip(spark):
    rows = spark.createDataFrame([(-5, 2**40, "é", bytearray(b"\x00\xff\x01")), (2**31 - 1, -1, "", bytearray()), (-(2**31), -(2**63), "four", bytearray(b"1234")), (None, 1, "x", bytearray())], "a int, b long, c string, d binary")
    sent = rows.select(containers.osc_message(F.lit("/a/b"), "ihsb", [F.col(c) for c in "abcd"]).alias("m"), "*")
    found = sent.select(*containers.osc_values(F.col("m"), "ihsb"), *containers.osc_values(F.col("m"), "ii")[2:]).collect()
    assert [tuple(r)[:6] for r in found[:3]] == [("/a/b", "ihsb", *r) for r in rows.collect()[:3]]
    assert tuple(found[3]) == (None,) * 8 and tuple(found[0])[6:] == (None, None)
    assert bytes(sent.first().m[:16]) == b"/a/b\0\0\0\0,ihsb\0\0\0"
