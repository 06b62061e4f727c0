"""Queries of windows, spectra, noise, modulation and whole-stream shapes, with SQL that works the sums out by their definitions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import functions as F

from wavemill.operators import blocks, channels, history, mixing, recursive, scalar, spectral, timeline
from wavemill.plans.recursions import _df2, shape_sql, walk_sql
from wavemill.sources import signals

_MIRROR = "(CASE WHEN frame_no % 64 <= 32 THEN frame_no % 64 ELSE 63 - frame_no % 64 END)"
_T = f"({_MIRROR} * 2 * pi() / 63)"
_WINDOWS = {
    "rectangle": "1.0::DOUBLE",
    "triangle": f"1 - abs(({_MIRROR} - 1 - 31.5) / 31.5)",
    "welch": f"1 - pow(({_MIRROR} - 1 - 31.5) / 31.5, 2)",
    "hamming": f"0.54 - 0.46 * cos({_T})",
    "hann": f"0.54 - 0.54 * cos({_T})",
    "blackman": f"0.42323 - 0.49755 * cos({_T}) + 0.07922 * cos(2 * {_T})",
    "nuttall": f"0.355768 - 0.487396 * cos({_T}) + 0.144232 * cos(2 * {_T}) - 0.012604 * cos(3 * {_T})",
    "blackman_nuttall": f"0.3635819 - 0.4891775 * cos({_T}) + 0.1365995 * cos(2 * {_T}) - 0.0106411 * cos(3 * {_T})",
    "flat_top": f"0.2810639 - 0.5208972 * cos({_T}) + 0.1980399 * cos(2 * {_T})",
}
#: Blocks of 16 frames at every 8th, weighed by the window, and their bins.
_BINS = """, bl AS (SELECT stream_id, block_no, frame_no - block_no * 8 AS k, x FROM (SELECT *, unnest([frame_no // 8, frame_no // 8 - 1]) AS block_no FROM eu) WHERE block_no >= 0),
 w AS (SELECT stream_id, block_no, k, x * least(1, 0.54 - 0.54 * cos((CASE WHEN k <= 8 THEN k ELSE 15 - k END) * 2 * pi() / 15)) AS v FROM bl WHERE (stream_id, block_no) IN (SELECT (stream_id, block_no) FROM bl GROUP BY stream_id, block_no HAVING count(*) = 16)),
 d AS (SELECT stream_id, block_no, j, sum(v * cos(2 * pi() * j * k / 16)) AS re, -sum(v * sin(2 * pi() * j * k / 16)) AS im FROM w, range(0, 9) t(j) GROUP BY ALL),
 c AS ({changed})
 SELECT stream_id, block_no * 8 + k AS frame_no, round(sum((CASE WHEN j IN (0, 8) THEN 1 ELSE 2 END) / 16.0::DOUBLE * (re * cos(2 * pi() * j * k / 16) - im * sin(2 * pi() * j * k / 16))), 4) AS y FROM c, range(0, 16) t(k) GROUP BY 1, 2"""


def _draw(seed: int, *position: str) -> str:
    return f"(('0x' || substr(md5({' || chr(58) || '.join([repr(str(seed)), *(f'({p})::VARCHAR' for p in position)])}), 1, 5))::INTEGER / 1048576.0::DOUBLE)"


_LFO = {
    "triangle": "list_sum(list_transform(range(0, 35), lambda j: pow(-1.0, j) * sin((2 * j + 1) * T) / (2 * j + 1)))",
    "square": "list_sum(list_transform(range(0, 35), lambda j: sin((2 * j + 1) * T) / (2 * j + 1)))",
    "saw": "list_sum(list_transform(range(1, 11), lambda j: pow(-1.0, j) * sin(j * T) / j))",
    "sine": "sin(T)",
    "off_sine": "(sin(T) + 1) * 0.5",
    "ramp": "(frame_no * 7) % 1000 / 1000.0::DOUBLE",
    "one": "1.0::DOUBLE",
}


def register(add: Callable, flat: Callable, user: Callable, eu: str, ef: str, lo: str) -> None:
    for name, sql in _WINDOWS.items():
        flat(f"window_{name}", lambda x, k, n=name: F.round(scalar.window_factor(n, F.pmod(k, F.lit(64)), 64), 6), f"round(least(1, {sql})::DOUBLE, 6)")
    phases = (2 * np.pi * np.random.default_rng(1).random(9)).tolist()
    changes = {
        "robotize": (spectral.robotize, "SELECT stream_id, block_no, j, sqrt(re * re + im * im) AS re, 0 AS im FROM d"),
        "whisper": (spectral.whisper(), f"SELECT stream_id, block_no, j, sqrt(re * re + im * im) * cos({phases}[j + 1]) AS re, sqrt(re * re + im * im) * sin({phases}[j + 1]) AS im FROM d"),
        "pitch_shift": (spectral.pitch_shift(2), "SELECT stream_id, block_no, j + 2 AS j, re, im FROM d WHERE j <= 6"),
        "band_equalizer": (spectral.band_gains([3.0, 0.0, -6.0], 44100, 16), "SELECT stream_id, block_no, j, g * re AS re, g * im AS im FROM (SELECT *, pow(10.0::DOUBLE, [3, 0, -6][1 + CASE WHEN j = 0 THEN 0 ELSE least(2, floor(3 * ln(j * 44100 / 16 / 20) / ln(22050 / 20)))::INTEGER END] / 20) AS g FROM d)"),
    }
    for name, (change, sql) in changes.items():
        user(f"fft_{name}", lambda r, f=change: spectral.overlap_add(spectral.effect(spectral.blocks_of(r, 16, 8), 16, f), 8).withColumn("y", F.round("y", 4)), _BINS.format(changed=sql))
    magnitudes = "v AS (SELECT vec_id AS block_no, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings), m AS (SELECT block_no, bin::INTEGER AS bin, sqrt(sum(x * cos(2 * pi() * k * bin / 64)) ** 2 + sum(x * sin(2 * pi() * k * bin / 64)) ** 2) AS m FROM v, range(0, 32) b(bin) GROUP BY 1, 2)"
    add("stft_peaks", lambda s, d: spectral.peaks(spectral.magnitudes(signals.embedding_blocks(s, d), 64), 44100, 64, 3), f"""WITH {magnitudes}, r AS (SELECT *, row_number() OVER (PARTITION BY block_no ORDER BY round(m, 6) DESC, bin)::INTEGER AS rank FROM m)
 SELECT block_no, rank, bin, bin * (44100 / 64.0::DOUBLE) AS hz, round(2595 * log10(1 + bin * (44100 / 64.0::DOUBLE) / 700), 6) AS mel, round(m, 6) AS magnitude FROM r WHERE rank <= 3""")
    add("spectrum_bars", lambda s, d: spectral.grouped_bins(spectral.magnitudes(signals.embedding_blocks(s, d), 64), 2, 4).select("block_no", F.posexplode("samples").alias("bar", "m")).select("block_no", "bar", F.round("m", 4).alias("magnitude")), f"WITH {magnitudes} SELECT block_no, bar::INTEGER AS bar, round(sum(m) / 4, 4) AS magnitude FROM range(0, 8) t(bar), range(0, 4) u(j), m WHERE bin = least(2 + bar * 4 + j, 31) GROUP BY 1, 2")
    add("autocorrelation", lambda s, d: spectral.autocorrelation(signals.embedding_blocks(s, d), 2000).withColumn("hz", F.round("hz", 6)), """WITH e AS (SELECT vec_id AS block_no, embedding::DOUBLE[] AS x FROM embeddings),
 r AS (SELECT block_no, lag, list_dot_product(x[1:64 - lag], x[1 + lag:64]) AS s FROM e, range(2, 40) t(lag)), k AS (SELECT *, row_number() OVER (PARTITION BY block_no ORDER BY s DESC, lag) AS n FROM r)
 SELECT block_no, round(2000 / lag, 6) AS hz FROM k WHERE n = 1""")
    tops = lambda s, d: spectral.peaks(spectral.magnitudes(signals.embedding_blocks(s, d), 64), 44100, 64, 3).withColumn("stream_id", F.lit(0))
    heard = lambda s, d: tops(s, d).filter("block_no in (3, 4, 7)").select(F.when(F.col("block_no") == 7, "one").otherwise("two").alias("name"), F.when(F.col("block_no") == 4, 1).otherwise(0).alias("k"), "rank", "hz")
    add("wake_words", lambda s, d: spectral.wake_words(tops(s, d), heard(s, d), 3, 50.0).select("block_no", "name", "percent"), f"""WITH {magnitudes}, r AS (SELECT *, row_number() OVER (PARTITION BY block_no ORDER BY round(m, 6) DESC, bin) AS rank FROM m),
 p AS (SELECT block_no, list(bin ORDER BY rank) AS bins FROM r WHERE rank <= 3 GROUP BY 1), g AS (SELECT a.block_no, t.block_no AS heard, (a.bins[1] = t.bins[1])::INTEGER + (a.bins[2] = t.bins[2])::INTEGER + (a.bins[3] = t.bins[3])::INTEGER >= 2 AS same FROM p a, p t WHERE t.block_no IN (3, 4, 7)),
 w AS (SELECT block_no, 'one' AS name, CASE WHEN same THEN 100.0::DOUBLE ELSE 0 END AS percent FROM g WHERE heard = 7
 UNION ALL SELECT b.block_no, 'two', 50.0::DOUBLE * (a.same::INTEGER + b.same::INTEGER) FROM g a JOIN g b ON b.block_no = a.block_no + 1 WHERE a.heard = 3 AND b.heard = 4)
 SELECT * FROM w WHERE percent >= 50""")
    flat("white_noise", lambda x, k: timeline.white_noise(k, 10000, 7), f"trunc(({_draw(7, 'frame_no')} * 2 - 1) * 10000)::INTEGER")
    flat("pink_noise", lambda x, k: timeline.pink_noise(k, 10000, 7), "trunc((" + " + ".join(f"({_draw(7, str(k), f'frame_no >> {k}')} * 2 - 1)" for k in range(5)) + ") / 5 * 10000)::INTEGER")
    first, second = _draw(7, "frame_no // 50"), _draw(7, "frame_no // 50 + 1")
    flat("noise_lfo", lambda x, k: F.round(timeline.noise_lfo(k, 50, 7), 6), f"round({first} + ({second} - {first}) * (frame_no % 50 / 50.0::DOUBLE), 6)")
    for name, sql in _LFO.items():
        flat(f"lfo_{name}", lambda x, k, n=name: F.round(scalar.lfo(n, k, 7, 1000), 6), f"round(({sql.replace('T)', '((frame_no * 7) % 1000 * 2 * pi() / 1000))')})::DOUBLE, 6)")
    flat("scaled_parameter", lambda x, k: F.round(scalar.scaled_parameter(x / 100, 0.5, 2.0), 6), "round(x / 100 + 0.5 * (2.0 - 0.5), 6)::DOUBLE")
    flat("note_name", lambda x, k: scalar.note_name(x.cast("double")), """(SELECT ['C', 'CS', 'D', 'DS', 'E', 'F', 'FS', 'G', 'GS', 'A', 'AS', 'B'][n % 12 + 1] || (n // 12)::VARCHAR FROM range(0, 108) t(n) WHERE ef.x > 0 ORDER BY abs(440 * pow(2.0::DOUBLE, (n - 57) / 12) - ef.x), n LIMIT 1)""")
    # generators run as long as each user's stream
    long = ", n AS (SELECT stream_id, count(*) AS n FROM eu GROUP BY 1)"
    lengths = lambda r: r.groupBy("stream_id").agg(F.count("*").alias("n"))
    user("fixed_value", lambda r: mixing.generated(lengths(r), lambda k: F.lit(1000)), f"{long} SELECT stream_id, unnest(range(0, n)) AS frame_no, 1000 AS x FROM n")
    user("silence", lambda r: mixing.generated(lengths(r), lambda k: F.lit(0)), f"{long} SELECT stream_id, unnest(range(0, n)) AS frame_no, 0 AS x FROM n")
    user("generated_stream", lambda r: mixing.generated(lengths(r), lambda k: mixing.from_array(k, [3, 1, 2])), f"{long} SELECT stream_id, frame_no, [3, 1, 2][frame_no % 3 + 1] AS x FROM (SELECT stream_id, unnest(range(0, n)) AS frame_no FROM n)")
    flat("sine_generated", lambda x, k: mixing.sine(k, 441, 44100, 10000, 0.1), "trunc(10000 * sin(frame_no * (2 * pi() * 441 / 44100) + 0.1))::INTEGER")
    flat("fast_sine", lambda x, k: mixing.fast_sine(k, 441, 44100, 10000), "(SELECT trunc(10000 * (p - 6.283211::DOUBLE * p * p * p + 9.132843::DOUBLE * pow(p, 5)) * -6.221086::DOUBLE)::INTEGER FROM (SELECT frame_no * (441 / 44100.0::DOUBLE) - floor(frame_no * (441 / 44100.0::DOUBLE)) - 0.5 AS p))")
    flat("int_sine", lambda x, k: mixing.int_sine(k, 440, 44100, 10000), f"((round(32767 * sin((frame_no * {440 * 2**32 // 44100} % 4294967296 // 16777216) * 2 * pi() / 256))::BIGINT * 10000) >> 15)::INTEGER")
    last = ", l AS (SELECT *, max(frame_no) OVER (PARTITION BY stream_id) - frame_no AS rest FROM eu)"
    user("fade_out", lambda r: timeline.fade_out(r, 20), f"{last} SELECT stream_id, frame_no, trunc(x * least(1.0::DOUBLE, rest / 20.0::DOUBLE))::INTEGER AS x FROM l")
    user("smooth_end", lambda r: timeline.smooth_end(r, 0.05), f"{last} SELECT stream_id, frame_no, trunc(CASE WHEN rest * 0.05::DOUBLE < 0.8::DOUBLE THEN x * (rest * 0.05::DOUBLE) ELSE x END)::INTEGER AS x FROM l")
    user("loop", lambda r: timeline.loop(r, 3), ", l AS (SELECT stream_id, count(*) AS n FROM eu GROUP BY 1) SELECT stream_id, frame_no + n * t AS frame_no, x FROM eu JOIN l USING (stream_id), range(0, 3) k(t)")
    over = "OVER (PARTITION BY stream_id ORDER BY frame_no)"
    resampled = f""", n AS (SELECT *, lead(c0) {over} AS d0, lead(c1) {over} AS d1, lead(c2) {over} AS d2, lead(c3) {over} AS d3 FROM lo), g AS (SELECT n.*, k, k * 0.75::DOUBLE - frame_no AS t FROM n JOIN range(0, 4000) r(k) ON floor(k * 0.75::DOUBLE) = frame_no WHERE d0 IS NOT NULL)"""
    add("resample_frames", lambda s, d: history.resample_frames(signals.order_frames(s, d), 0.75).select("stream_id", "frame_no", F.transform("samples", lambda y: F.round(y, 4)).alias("samples")), f"WITH {lo}{resampled} SELECT stream_id, k AS frame_no, [{', '.join(f'round(c{c} + t * (d{c} - c{c}), 4)' for c in range(4))}] AS samples FROM g")
    to8 = "trunc(least(greatest(({0})::DOUBLE * 127.0::DOUBLE / 32767.0::DOUBLE, -127), 127))::INTEGER"
    whole = [f"trunc(c{c} + t * (d{c} - c{c}))::INTEGER" for c in range(4)]
    mixed = [to8.format(whole[0]), to8.format(" + ".join(f"trunc({w} / 3)::INTEGER" for w in whole[1:]))]
    add("convert_format", lambda s, d: history.convert_format(signals.order_frames(s, d), (33075, 44100), (4, 2), (16, 8)), f"WITH {lo}{resampled} SELECT stream_id, k AS frame_no, [{', '.join(mixed)}] AS samples FROM g")
    add("convert_channels", lambda s, d: signals.order_frames(s, d).select("stream_id", "frame_no", channels.convert_channels(channels.convert_channels(F.col("samples"), 2, 4), 5, 2).alias("samples")), f"WITH {lo}, m AS (SELECT *, trunc(c1 / 3)::INTEGER + trunc(c2 / 3)::INTEGER + trunc(c3 / 3)::INTEGER AS m FROM lo) SELECT stream_id, frame_no, [c0, m, m, m, m] AS samples FROM m")
    quiet = lambda s, d: signals.order_frames(s, d).select("stream_id", "frame_no", F.when(F.col("stream_id") % 3 == 0, F.array(F.lit(0), F.get("samples", 1))).when(F.col("stream_id") % 3 == 1, F.array(F.get("samples", 0), F.lit(0))).otherwise(F.slice("samples", 1, 2)).alias("samples"))
    add("fill_empty", lambda s, d: channels.fill_empty(quiet(s, d)), f"WITH {lo} SELECT stream_id, frame_no, CASE WHEN stream_id % 3 = 0 THEN [c1, c1] WHEN stream_id % 3 = 1 THEN [c0, c0] ELSE [c0, c1] END AS samples FROM lo")
    add("channels_joined", lambda s, d: channels.join_channels(channels.split(signals.order_frames(s, d))), f"WITH {lo} SELECT stream_id, frame_no, [c0, c1, c2, c3] AS samples FROM lo")

    # filters a channel: SQL walks every (stream, channel) as a stream of its own
    long = f"{lo}, eu AS (SELECT stream_id * 4 + ch AS stream_id, frame_no, [c0, c1, c2, c3][ch + 1] AS x FROM lo, range(0, 4) t(ch))"
    lists = lambda walked: f"SELECT stream_id // 4 AS stream_id, frame_no, list(y ORDER BY stream_id % 4) AS samples FROM ({walked}) GROUP BY 1, 2"
    rounded = lambda f: f.select("stream_id", "frame_no", F.transform("samples", lambda y: scalar.rounded(y, 4)).alias("samples"))
    low, high = (recursive.biquad_df2(*recursive.biquad(kind, hz, 44100)) for kind, hz in (("low_pass", 1000), ("high_pass", 200)))
    pick = "p AS (SELECT ch, b0, b1, b2, a1, a2 FROM k, (SELECT 0 AS ch) UNION ALL SELECT ch, b0, b1, b2, a1, a2 FROM h, range(1, 4) t(ch))"
    views = f", {shape_sql('k', 'low_pass', 1000)}, {shape_sql('h', 'high_pass', 200)}, {pick}"
    add("filter_per_channel", lambda s, d: rounded(recursive.fold_channels(signals.order_frames(s, d), [low, high])), lists(walk_sql(long, _df2("f.x", "p"), "round(y, 4)", views, " JOIN p ON p.ch = f.stream_id % 4")))
    bands = {}
    for cascade, hz in (("p", 880), ("q", 5000)):
        for k in range(1, 5):
            into = "f.x" if k == 1 else f"n_{cascade}{k - 1}"
            bands[f"{cascade}{k}"] = ("0.0::DOUBLE", f"r.{cascade}{k} + 2 * sin(pi() * {hz} / 44100) * ({into} - r.{cascade}{k})")
    gain = lambda a, b: f"(CASE WHEN f.stream_id % 4 = 0 THEN {a} ELSE {b} END)::DOUBLE"
    bands |= {"top": ("0.0::DOUBLE", "r.x3 - n_q4"), "y": ("0.0::DOUBLE", f"{gain(1.2, 0.5)} * n_p4 + (r.x3 - (n_top + n_p4)) + {gain(0.8, 1.5)} * n_top"), "x3": ("0.0::DOUBLE", "r.x2"), "x2": ("0.0::DOUBLE", "r.x1"), "x1": ("0.0::DOUBLE", "f.x::DOUBLE")}
    makers = [recursive.equalizer3(44100, low=1.2, high=0.8), recursive.equalizer3(44100, low=0.5, high=1.5)]
    add("equalizer3_per_channel", lambda s, d: rounded(recursive.fold_channels(signals.order_frames(s, d), makers)), lists(walk_sql(long, bands, "round(y, 4)")))
    add("volume_per_channel", lambda s, d: signals.order_frames(s, d).select("stream_id", "frame_no", channels.volumes(F.col("samples"), [0.5, 0.01, 2.0]).alias("samples")), f"WITH {lo} SELECT stream_id, frame_no, [trunc(c0 * 0.5)::INTEGER, trunc(least(c1 * 0.01::DOUBLE, 32767))::INTEGER, trunc(c2 * 2.0)::INTEGER, trunc(c3 * 2.0)::INTEGER] AS samples FROM lo")
    flat("dequantise_affine", lambda x, k: scalar.affine_dequantise(scalar.affine_quantise(x, 256.0, -128), 256.0, -128), "(least(greatest(round(x / 256.0::DOUBLE)::INTEGER - 128, -128), 127) + 128) * 256.0::DOUBLE")
    flat("midi_to_hz", lambda x, k: F.round(scalar.midi_to_hz(F.pmod(k, F.lit(128))), 6), "round(440 * pow(2.0::DOUBLE, (frame_no % 128 - 69) / 12), 6)")
    user("levels", lambda r: blocks.levels(r, 44100), " SELECT stream_id, count(*) AS frames, round(count(*) / 44100, 6) AS seconds, round(avg(x), 4) AS mean, round(sqrt(avg(x::DOUBLE * x)), 4) AS rms, max(abs(x)) AS peak FROM eu GROUP BY 1")
    near = ", n AS (SELECT stream_id, frame_no, x AS x1, lead(x) OVER (PARTITION BY stream_id ORDER BY frame_no) AS x2 FROM eu), g AS (SELECT n.*, k, k * (20000 / 22050::DOUBLE) - frame_no AS t FROM n JOIN range(0, 4000) r(k) ON floor(k * (20000 / 22050::DOUBLE)) = frame_no WHERE x2 IS NOT NULL)"
    user("supported_rate", lambda r: history.to_supported_rate(r, 20000, mixing.RATES).withColumn("y", F.round("y", 4)), f"{near} SELECT stream_id, k AS frame_no, round(x1 + t * (x2 - x1), 4) AS y FROM g")
    user("supported_rate_kept", lambda r: history.to_supported_rate(r, 44100, mixing.RATES), " SELECT stream_id, frame_no, x::DOUBLE AS y FROM eu")
