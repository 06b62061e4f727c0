"""All queries over the signal views of the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions import containers, formats, metadata, text
from wavemill.operators import blocks, channels, history, mixing, recursive, scalar, spectral, timeline
from wavemill.plans import codecs, followers, media, parcels, recursions, spectra
from wavemill.sources import signals

QUERIES: dict = {}
ORACLES: dict = {}

EU = "eu AS (SELECT user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no, round(value * 100)::INTEGER AS x FROM events)"
EF = "ef AS (SELECT 0::BIGINT AS stream_id, event_id AS frame_no, round(value * 100)::INTEGER AS x FROM events)"
LO = """lo AS (SELECT l_orderkey AS stream_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS frame_no,
 round(l_quantity * 100)::INTEGER AS c0, round(l_extendedprice * 100)::INTEGER AS c1, round(l_discount * 100)::INTEGER AS c2, round(l_tax * 100)::INTEGER AS c3 FROM lineitem)"""


def add(name: str, plan, sql: str | None = None) -> None:
    QUERIES[name] = plan
    if sql:
        ORACLES[name] = sql


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


def _flat(name: str, column, sql: str) -> None:
    """A stateless transform of all events: column(x, frame_no) against a SQL expression of x and frame_no."""
    add(name, lambda s, d: signals.events_flat(s, d).select("frame_no", column(F.col("x"), F.col("frame_no")).alias("y")), f"WITH {EF} SELECT frame_no, {sql} AS y FROM ef")


def _clip(x: str, most: float = 32767) -> str:
    return f"least(greatest({x}, -{most}), {most})"


def _cut(x: str) -> str:
    return f"trunc({x})::INTEGER"


_flat("scale", lambda x, k: scalar.scale(x, 1.7, -500, 30000), _cut(_clip("(x - 500) * 1.7::DOUBLE", 30000.0)))
_flat("invert", lambda x, k: scalar.invert(x), "-x")
_flat("unsigned_dac", lambda x, k: scalar.to_unsigned_dac(x), "(x + 32768) % 65536")
_flat("clip", lambda x, k: scalar.clip(x, 32767), _clip("x"))
_flat("bits_16_to_8", lambda x, k: scalar.convert_bits(x, 16, 8), _cut(_clip("x::DOUBLE * 1.0::DOUBLE * 127.0::DOUBLE / 32767.0::DOUBLE", 127.0)))
_flat("bits_16_to_24", lambda x, k: scalar.convert_bits(x, 16, 24), _cut(_clip("x::DOUBLE * 1.0::DOUBLE * 8388607.0::DOUBLE / 32767.0::DOUBLE", 8388607.0)))
_flat("to_float", lambda x, k: F.round(scalar.to_float(x), 6), "round(x / 32767.0::DOUBLE, 6)")
_CURVES = {"linear": (scalar.linear_curve, "0.7"), "logarithmic": (scalar.logarithmic_curve, "(pow(81.0::DOUBLE, 0.7) - 1) / 80"), "exponential": (scalar.exponential_curve, "(pow(2.0::DOUBLE, 0.7) - 1)"), "pot": (scalar.pot_curve, "(0.1::DOUBLE + (0.7::DOUBLE - 0.5) * (1 - 0.1::DOUBLE) / 0.5)")}
for _name, (_curve, _sql) in _CURVES.items():
    _flat(f"volume_{_name}", lambda x, k, c=_curve: scalar.volume(x, 0.7, c), _cut(_clip(f"x * {_sql}::DOUBLE", 32767.0)))
_flat("volume_callback", lambda x, k: scalar.volume(x, 0.3, lambda v: v**3), _cut(_clip("x * pow(0.3::DOUBLE, 3)", 32767.0)))
_flat("volume_boost", lambda x, k: scalar.volume(x, 1.5, boost=True), _cut("x * 1.5::DOUBLE"))
_flat("boost", lambda x, k: scalar.boost(x, 2.5), _cut(_clip("x * 2.5::DOUBLE", 32767.0)))
_flat("distortion", lambda x, k: scalar.distortion(x), "CASE WHEN x > 4990 THEN 6500 WHEN x < -4990 THEN -6500 ELSE x END")
_flat("fuzz", lambda x, k: scalar.fuzz(x), _cut(f"({_clip('x * 6.5::DOUBLE', 32767.0)} * 6.5::DOUBLE + 32768.0::DOUBLE) * 600.0::DOUBLE / 65536.0::DOUBLE - 300.0::DOUBLE"))
_flat("tremolo", lambda x, k: scalar.tremolo(x, k, 1000, 100, 0.5), _cut("x * (0.5::DOUBLE + 0.01::DOUBLE * (CASE WHEN frame_no % 100 <= 50 THEN frame_no % 100 ELSE 100 - frame_no % 100 END))"))
_flat("fade_in", lambda x, k: scalar.fade_in(x, k, 400), _cut("x * least(1.0::DOUBLE, frame_no / 400.0::DOUBLE)"))
_flat("smooth_start", lambda x, k: scalar.smooth_start(x, k), _cut("CASE WHEN frame_no * 0.01::DOUBLE < 0.8::DOUBLE THEN x * (frame_no * 0.01::DOUBLE) ELSE x END"))
_flat("decibel", lambda x, k: F.round(scalar.decibel(x / 32767), 6), "CASE WHEN x > 0 THEN round(20 * log10(x / 32767), 6) ELSE -1000.0::DOUBLE END")
_flat("midi_note", lambda x, k: scalar.hz_to_midi(x.cast("double")), "CASE WHEN x > 0 THEN round(69 + 12 * log2(x::DOUBLE / 440.0::DOUBLE))::INTEGER END")
_flat("quantise_affine", lambda x, k: scalar.affine_quantise(x, 256.0, -128), "least(greatest(round(x / 256.0::DOUBLE)::INTEGER - 128, -128), 127)")
_flat("window_blackman_harris", lambda x, k: F.round(scalar.window_factor("blackman_harris", F.pmod(k, F.lit(64)), 64), 6), "round(least(1, 0.35875 - 0.48829 * cos(w) + 0.14128 * cos(2 * w) - 0.01168 * cos(3 * w)), 6)".replace("w)", "((CASE WHEN frame_no % 64 <= 32 THEN frame_no % 64 ELSE 63 - frame_no % 64 END) * 2 * pi() / 63))"))
_flat("sine", lambda x, k: scalar.truncate(F.round(10000 * F.sin(k * F.lit(2 * math.pi * 440 / 44100)), 6)), "trunc(round(10000 * sin(frame_no * (2 * pi() * 440 / 44100)), 6))::INTEGER")
_flat("square", lambda x, k: mixing.square(k, 440, 44100, 1000), f"CASE WHEN (frame_no * {int(440 / 44100 * 2**32)}) % 4294967296 < 2147483648 THEN 1000 ELSE -1000 END")
_flat("saw", lambda x, k: mixing.saw(k, 440, 44100, 1000), f"(((CASE WHEN p < 2147483648 THEN p ELSE p - 4294967296 END) * 1000) >> 31)::INTEGER".replace("p ", f"((frame_no * {int(440 / 44100 * 2**32)}) % 4294967296) ").replace("(CASE WHEN ((", "(CASE WHEN (("))
_flat("wavetable", lambda x, k: mixing.from_array(k, [0, 5, 9, 5, 0, -5, -9, -5]), "[0, 5, 9, 5, 0, -5, -9, -5][frame_no % 8 + 1]")
_flat("closest_rate", lambda x, k: mixing.closest_rate(x), "list_sort(list_transform([8000, 11025, 12000, 16000, 22050, 24000, 32000, 44100, 48000, 88200, 96000, 176400, 192000], lambda r, i: {'d': abs(r - x), 'i': i, 'r': r}))[1]['r']")


def _frames(name: str, column, sql: str) -> None:
    add(name, lambda s, d: signals.order_frames(s, d).select("stream_id", "frame_no", column(F.col("samples")).alias("samples")), f"WITH {LO} SELECT stream_id, frame_no, {sql} AS samples FROM lo")


_frames("channel_swap", lambda s: channels.swap(F.slice(s, 1, 2), 2), "[c1, c0]")
_frames("channel_reduce", lambda s: channels.reduce_channels(s, 2, 4), "[c0, trunc(c1 / 3)::INTEGER + trunc(c2 / 3)::INTEGER + trunc(c3 / 3)::INTEGER]")
_frames("channel_enhance", lambda s: channels.enhance_channels(s, 6, 4), "[c0, c1, c2, c3, c3, c3]")
_frames("channel_difference", channels.difference, "[c0 - c1]")
_frames("channel_average", channels.average, "[trunc((c0 + c1) / 2)::INTEGER]")
_frames("channel_mix", lambda s: channels.mix_to_all(s, 4), "list_resize([trunc((c0 + c1 + c2 + c3) / 4)::INTEGER], 4, trunc((c0 + c1 + c2 + c3) / 4)::INTEGER)")
_frames("channel_copy", lambda s: channels.copy_channel(s, 2, 4, 1), "[c2 * 2, c2 * 2, c2 * 2, c2 * 2]")
_frames("channel_select", lambda s: channels.select_channels(s, [3, 9], 4), "[c3, c3]")
add("channel_split", lambda s, d: channels.split(signals.order_frames(s, d)), f"WITH {LO} SELECT stream_id, frame_no, unnest([0, 1, 2, 3]) AS ch, unnest([c0, c1, c2, c3]) AS x FROM lo")
add("bin_channels", lambda s, d: blocks.bin_channels(signals.order_frames(s, d), 2, 4, True), f"WITH {LO} SELECT stream_id, frame_no // 2 AS block_no, [trunc(sum(c0) / 2)::BIGINT, trunc(sum(c1) / 2)::BIGINT, trunc(sum(c2) / 2)::BIGINT, trunc(sum(c3) / 2)::BIGINT] AS samples FROM lo GROUP BY 1, 2 HAVING count(*) = 2")
add("bin_difference", lambda s, d: blocks.bin_channels(signals.order_frames(s, d), 2, 4, False, True), f"WITH {LO} SELECT stream_id, frame_no // 2 AS block_no, [(sum(c0) - sum(c1))::BIGINT, (sum(c2) - sum(c3))::BIGINT] AS samples FROM lo GROUP BY 1, 2 HAVING count(*) = 2")


def _user(name: str, plan, sql: str | None = None) -> None:
    """A query over the users' event streams; sql begins with `, ` if it defines more views."""
    add(name, lambda s, d: plan(signals.events_by_user(s, d)), f"WITH {EU}{sql}" if sql else None)


def _m0(rows: DataFrame) -> DataFrame:
    return blocks.bin_frames(rows.withColumn("x", scalar.scale(F.col("x"), 1.7, -500, 30000)), 4, True)


_SCALED = _cut(_clip("(x - 500) * 1.7::DOUBLE", 30000.0))
_user("m0_scale_bin", _m0, f" SELECT stream_id, frame_no // 4 AS block_no, trunc(sum({_SCALED}) / 4)::BIGINT AS x FROM eu GROUP BY 1, 2 HAVING count(*) = 4")
_user("bin_sum", lambda r: blocks.bin_frames(r, 4), " SELECT stream_id, frame_no // 4 AS block_no, sum(x)::BIGINT AS x FROM eu GROUP BY 1, 2 HAVING count(*) = 4")
_user("decimate", lambda r: blocks.decimate(r, 3), " SELECT stream_id, frame_no // 3 AS frame_no, x FROM eu WHERE (frame_no + 1) % 3 = 0")
_user("timed", lambda r: blocks.timed(r, 10, 1, 4), " SELECT stream_id, frame_no, x FROM eu WHERE frame_no >= 10 AND frame_no < 40")
_user("center", lambda r: blocks.center(r, 8), " SELECT stream_id, frame_no, x - trunc(avg(x) OVER (PARTITION BY stream_id, frame_no // 8))::INTEGER AS x FROM eu")
_user("volume_meter", lambda r: blocks.volume_meter(r, 8), " SELECT stream_id, frame_no // 8 AS block_no, max(abs(x)) AS peak, round(avg(abs(x)), 6) AS mean, CASE WHEN max(abs(x)) > 0 THEN round(20 * log10(max(abs(x)) / 32767), 6) ELSE -1000.0::DOUBLE END AS db FROM eu GROUP BY 1, 2")
_user("goertzel", lambda r: blocks.goertzel(r, 16, 8000, [500.0, 1000.0]), """ SELECT stream_id, frame_no // 16 AS block_no, hz, round(sqrt(sum(x / 32767 * cos(frame_no % 16 * 2 * pi() * hz / 8000)) ** 2 + sum(x / 32767 * sin(frame_no % 16 * 2 * pi() * hz / 8000)) ** 2), 6) AS magnitude
 FROM eu, (SELECT unnest([500.0::DOUBLE, 1000.0::DOUBLE]) AS hz) GROUP BY 1, 2, 3 HAVING count(*) = 16""")
_OVER = "OVER (PARTITION BY stream_id ORDER BY frame_no"
_user("moving_average", lambda r: history.moving_average(r, 5).select("stream_id", "frame_no", F.round("y", 6).alias("y")), f" SELECT stream_id, frame_no, round(avg(x) {_OVER} ROWS 4 PRECEDING), 6) AS y FROM eu")
_user("fir", lambda r: history.fir(r, [0.021, 0.096, 0.146, 0.096, 0.021]).select("stream_id", "frame_no", F.round("y", 6).alias("y")), " SELECT stream_id, frame_no, round(" + " + ".join(f"coalesce(lag(x, {k}) {_OVER}), 0) * {b}::DOUBLE" for k, b in enumerate([0.021, 0.096, 0.146, 0.096, 0.021])) + ", 6) AS y FROM eu")
_user("median", lambda r: history.median(r, 5).select("stream_id", "frame_no", "y"), " SELECT stream_id, frame_no, list_sort([" + ", ".join(f"coalesce(lag(x, {k}) {_OVER}), 0)" for k in range(5)) + "])[3] AS y FROM eu")
_user("remove_silence", lambda r: history.remove_silence(r, 2, 20000), f", k AS (SELECT *, max((abs(x) > 20000)::INTEGER) {_OVER} ROWS 1 PRECEDING) AS loud FROM eu) SELECT stream_id, row_number() {_OVER}) - 1 AS frame_no, x FROM k WHERE loud = 1")
_user("zero_crossings", lambda r: history.zero_crossings(r.withColumn("x", F.col("x") - 9000), 44100).withColumn("hz", F.round("hz", 6)), f", k AS (SELECT stream_id, frame_no, x - 9000 AS x, lead(x - 9000) {_OVER}) AS nx FROM eu), u AS (SELECT stream_id, frame_no, frame_no - lag(frame_no) {_OVER}) AS n FROM k WHERE x <= 0 AND nx > 0) SELECT stream_id, frame_no, round(44100 / n, 6) AS hz FROM u WHERE n IS NOT NULL")
_user("quality", lambda r: history.quality(r.withColumn("x", F.when(F.col("x") < 4000, 0).otherwise(F.col("x"))), dropout=2, clipping=2), f""", z AS (SELECT stream_id, frame_no, CASE WHEN x < 4000 THEN 0 ELSE x END AS x FROM eu),
 f AS (SELECT *, abs(x - lag(x) {_OVER})) > 0.5 * 32767 AS jump, abs(x) <= 0.01 * 32767 AS q, abs(x) >= 0.99 * 32767 AS l FROM z),
 a AS (SELECT stream_id, count(*) AS n FROM (SELECT stream_id, g, count(*) AS c FROM (SELECT stream_id, frame_no - row_number() {_OVER}) AS g FROM f WHERE q) GROUP BY 1, 2) WHERE c >= 2 GROUP BY 1),
 b AS (SELECT stream_id, count(*) AS n FROM (SELECT stream_id, g, count(*) AS c FROM (SELECT stream_id, frame_no - row_number() {_OVER}) AS g FROM f WHERE l) GROUP BY 1, 2) WHERE c >= 2 GROUP BY 1)
 SELECT stream_id, count(*) AS frames, count(*) FILTER (jump) AS clicks, coalesce(any_value(a.n), 0) AS dropouts, coalesce(any_value(b.n), 0) AS clippings FROM f LEFT JOIN a USING (stream_id) LEFT JOIN b USING (stream_id) GROUP BY 1""")
_user("pid", lambda r: history.pid(r, 10000, 0.1, 50000, -50000, 0.5, 0.1, 0.01).select("stream_id", "frame_no", F.round("y", 4).alias("y")), f", e AS (SELECT *, 10000.0::DOUBLE - x AS e FROM eu) SELECT stream_id, frame_no, round(least(greatest(0.5 * e + 0.1 * sum(e) {_OVER}) * 0.1 + 0.01 * (e - coalesce(lag(e) {_OVER}), 0)) / 0.1, -50000.0::DOUBLE), 50000.0::DOUBLE), 4) AS y FROM e")
_INTER = {"parabolic": "0.5::DOUBLE * x1 + 0.25::DOUBLE * (x0 + x2) + t * 0.5::DOUBLE * (x2 - x0) + t * t * 0.25::DOUBLE * (x3 - x1 - x2 + x0)", "linear": "x1 + t * (x2 - x1)", "hermite": "x1 + t * (x2 - x0) / 2 + t * t * (x0 - 2.5 * x1 + 2 * x2 - 0.5 * x3) + t * t * t * (1.5 * (x1 - x2) + 0.5 * (x3 - x0))", "bspline": "((x0 + 4 * x1 + x2) + 3 * t * (x2 - x0) + 3 * t * t * (x0 - 2 * x1 + x2) + t * t * t * (x3 - x0 + 3 * (x1 - x2))) / 6", "lagrange": "x0 * (-t * (t - 1) * (t - 2) / 6) + x1 * ((t + 1) * (t - 1) * (t - 2) / 2) + x2 * (-t * (t + 1) * (t - 2) / 2) + x3 * (t * (t + 1) * (t - 1) / 6)"}
for _name, _sql in _INTER.items():
    _user(f"resample_{_name}", lambda r, n=_name: history.resample(r, 0.75, n).withColumn("y", F.round("y", 4)), f", n AS (SELECT stream_id, frame_no, coalesce(lag(x) {_OVER}), x) AS x0, x AS x1, lead(x) {_OVER}) AS x2, coalesce(lead(x, 2) {_OVER}), lead(x) {_OVER})) AS x3 FROM eu), g AS (SELECT n.*, k, k * 0.75::DOUBLE - frame_no AS t FROM n JOIN range(0, 4000) r(k) ON floor(k * 0.75::DOUBLE) = frame_no WHERE x2 IS NOT NULL) SELECT stream_id, k AS frame_no, round(({_sql})::DOUBLE, 4) AS y FROM g")
_other = lambda r: r.withColumn("x", 3000 - 2 * F.col("x"))
_user("merge", lambda r: mixing.merge([(r, 1.0), (_other(r), 0.5)]), " SELECT stream_id, frame_no, [x, trunc((3000 - 2 * x) * 0.5::DOUBLE)::INTEGER] AS samples FROM eu")
_late = lambda r: r.select("stream_id", (F.col("frame_no") + 20).alias("frame_no"), (-F.col("x")).alias("x"))
_user("mix", lambda r: mixing.mix([(r, 100), (_late(r), 50)]), f" SELECT stream_id, frame_no, sum(y)::BIGINT AS x FROM (SELECT stream_id, frame_no, trunc(x * ({100 / 150!r}::DOUBLE))::BIGINT AS y FROM eu UNION ALL SELECT stream_id, frame_no + 20, trunc(-x * ({50 / 150!r}::DOUBLE))::BIGINT FROM eu) GROUP BY 1, 2")
_user("generator_average", lambda r: mixing.average([r, _other(r)]), " SELECT stream_id, frame_no, trunc((3000 - x) / 2.0::DOUBLE)::INTEGER AS x FROM eu")
_user("concatenate", lambda r: mixing.concatenate([_other(r), r]), " SELECT stream_id, frame_no, 3000 - 2 * x AS x FROM eu UNION ALL SELECT stream_id, frame_no + count(*) OVER (PARTITION BY stream_id), x FROM eu")

_less = lambda r: blocks.decimate(r.withColumn("x", -F.col("x")), 3)
_LESS = ", h AS (SELECT stream_id, frame_no // 3 AS frame_no, -x AS x FROM eu WHERE (frame_no + 1) % 3 = 0)"
_user("merge_whole", lambda r: mixing.merge([(r, 1.0), (_less(r), 0.5)]), f"{_LESS} SELECT stream_id, frame_no, [eu.x, trunc(h.x * 0.5::DOUBLE)::INTEGER] AS samples FROM eu JOIN h USING (stream_id, frame_no)")
_user("mix_whole", lambda r: mixing.mix([(r, 100), (_less(r), 50)]), f"{_LESS} SELECT stream_id, frame_no, trunc(eu.x * ({100 / 150!r}::DOUBLE))::BIGINT + coalesce(trunc(h.x * ({50 / 150!r}::DOUBLE))::BIGINT, 0) AS x FROM eu LEFT JOIN h USING (stream_id, frame_no)")
_user("generator_average_whole", lambda r: mixing.average([r, _less(r)]), f"{_LESS} SELECT stream_id, frame_no, CASE WHEN h.x IS NULL THEN eu.x ELSE trunc((eu.x + h.x) / 2)::INTEGER END AS x FROM eu LEFT JOIN h USING (stream_id, frame_no)")
_user("concatenate_whole", lambda r: mixing.concatenate([_less(r), r]), f"{_LESS} SELECT stream_id, frame_no, x FROM h UNION ALL SELECT stream_id, frame_no + coalesce(n, 0), x FROM eu LEFT JOIN (SELECT stream_id, count(*) AS n FROM h GROUP BY 1) USING (stream_id)")

_user("mix_common", lambda r: mixing.mix_common([(r, 100), (_less(r), 50)]), f"{_LESS} SELECT stream_id, frame_no, trunc(eu.x * ({100 / 150!r}::DOUBLE))::BIGINT + trunc(h.x * ({50 / 150!r}::DOUBLE))::BIGINT AS x FROM eu JOIN h USING (stream_id, frame_no)")
_flat("map_range", lambda x, k: F.round(scalar.map_range(x, 0, 32767, -1, 1), 9), "round(x * 2.0::DOUBLE / 32767 - 1, 9)")

recursions.register(add, EU, signals.events_by_user)
spectra.register(add, _flat, _user, EU, EF, LO)
codecs.register(add, _flat, EF, LO)
media.register(add, LO)
followers.register(add, _user, EU)
parcels.register(add)


def _recursive(name: str, make, digits: int = 4) -> None:
    _user(name, lambda r: recursive.fold(r, make).select("stream_id", "frame_no", F.round("y", digits).alias("y")))


_recursive("kalman", recursive.kalman())
ORACLES["kalman"] = f"""WITH RECURSIVE {EU}, r(stream_id, frame_no, p, v) AS (
 SELECT stream_id, frame_no, (1 - 1.01::DOUBLE / 2.01::DOUBLE) * 1.01::DOUBLE, 1.01::DOUBLE / 2.01::DOUBLE * x FROM eu WHERE frame_no = 0 UNION ALL
 SELECT stream_id, frame_no, p * (1 - p / (p + 1)), v + p / (p + 1) * (x - v) FROM (SELECT eu.stream_id, eu.frame_no, p + 0.01::DOUBLE AS p, v, x FROM r JOIN eu ON eu.stream_id = r.stream_id AND eu.frame_no = r.frame_no + 1))
 SELECT stream_id, frame_no, round(v, 4) AS y FROM r"""
add("spectrum", lambda s, d: spectral.magnitudes(signals.embedding_blocks(s, d), 64).select("block_no", F.posexplode("samples").alias("bin", "m")).select("block_no", "bin", F.round("m", 4).alias("magnitude")), """
 WITH v AS (SELECT vec_id AS block_no, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)
 SELECT block_no, bin::INTEGER AS bin, round(sqrt(sum(x * cos(2 * pi() * k * bin / 64)) ** 2 + sum(x * sin(2 * pi() * k * bin / 64)) ** 2), 4) AS magnitude FROM v, range(0, 32) b(bin) GROUP BY 1, 2""")
add("pcm_hex", lambda s, d: signals.events_flat(s, d).select("frame_no", formats.int16_hex(scalar.clip(F.col("x"), 32767)).alias("y")), f"WITH {EF} SELECT frame_no, upper(printf('%02x%02x', least(x, 32767) & 255, least(x, 32767) >> 8)) AS y FROM ef")
add("csv_lines", lambda s, d: signals.order_frames(s, d).select("stream_id", "frame_no", formats.csv_line(F.col("samples")).alias("line")), f"WITH {LO} SELECT stream_id, frame_no, concat_ws(',', c0, c1, c2, c3) AS line FROM lo")
add("base64_text", lambda s, d: signals.table(s, d, "pages").select("page_id", formats.base64_text(F.col("url")).alias("y")), "SELECT page_id, base64(encode(url)) AS y FROM pages")
add("url_parts", lambda s, d: signals.table(s, d, "pages").select("page_id", *text.url_parts(F.col("url"))), "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS protocol, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
add("glob_match", lambda s, d: signals.table(s, d, "part").select("p_partkey", text.glob_match(F.col("p_name"), "*a*; b?g*").alias("y")), r"SELECT p_partkey, regexp_full_match(p_name, '.*a.*') OR regexp_full_match(p_name, 'b.g.*') AS y FROM part")

_low = lambda r: r.withColumn("x", F.col("x") - 9000)
_EDGE = "OVER (PARTITION BY stream_id, frame_no // 8"
for _side, _pick, _hold in (("start", "first_value", "frame_no >= min"), ("end", "last_value", "frame_no <= max")):
    _user(f"pops_{_side}", lambda r, s=_side: timeline.remove_pops(_low(r), 8, s), f""", e AS (SELECT stream_id, frame_no, x - 9000 AS x, {_pick}(x - 9000) {_EDGE} ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS edge FROM eu)
 SELECT stream_id, frame_no, CASE WHEN {_hold}(CASE WHEN sign(edge) * sign(x) <= 0 THEN frame_no END) {_EDGE}) THEN x ELSE 0 END AS x FROM e""")
_user("fade_tail", lambda r: timeline.fade_tail(r, 20), ", l AS (SELECT stream_id, max(frame_no) AS e, arg_max(x, frame_no) AS v FROM eu GROUP BY 1) SELECT stream_id, frame_no, x FROM eu UNION ALL SELECT stream_id, e + k, trunc(v * (20 - k) / 20.0::DOUBLE)::INTEGER FROM l, range(1, 21) t(k)")
_user("center_by_first", lambda r: timeline.center_by_first(r, 8), " SELECT stream_id, frame_no, x - m AS x FROM eu JOIN (SELECT stream_id, trunc(avg(x))::INTEGER AS m FROM eu WHERE frame_no < 8 GROUP BY 1) USING (stream_id)")
_user("active", lambda r: timeline.active(r, 4, 40).select("stream_id", "frame_no", "active"), f" SELECT stream_id, frame_no, max(abs(x)) {_OVER} ROWS 3 PRECEDING) * 100 > 40 * 32767 AS active FROM eu")
_user("event_time", lambda r: r.select("stream_id", "frame_no", F.unix_micros(timeline.event_time(F.col("frame_no"), 44100)).alias("us")), " SELECT stream_id, frame_no, frame_no * 1000000 // 44100 AS us FROM eu")
_user("video_frames", lambda r: timeline.video_frames(r, 100, 30), ", g AS (SELECT stream_id, frame_no, (frame_no * 30 + 99) // 100 AS a, (frame_no * 30 + 129) // 100 AS b FROM eu) SELECT stream_id, frame_no, a AS video FROM g WHERE b > a")
_user("flanger", lambda r: timeline.flanger(r, 0.5, 6, 30, 1000).select("stream_id", "frame_no", "y"), """, d AS (SELECT *, frame_no - floor(round((1 + sin(frame_no * (2 * pi() * 30 / 1000))) * 3, 6))::BIGINT AS f FROM eu)
 SELECT d.stream_id, d.frame_no, trunc(least(greatest(d.x + 0.5::DOUBLE * coalesce(eu.x, 0), -32767), 32767))::INTEGER AS y FROM d LEFT JOIN eu ON eu.stream_id = d.stream_id AND eu.frame_no = d.f""")
add("sequence_gaps", lambda s, d: timeline.sequence_gaps(signals.table(s, d, "events").select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("seq"))), "SELECT * FROM (SELECT user_id AS stream_id, event_id AS seq, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS missing FROM events) WHERE missing > 0")
_flat("triangle", lambda x, k: timeline.triangle(k, 100), "CASE WHEN (frame_no + 1) % 396 <= 99 THEN (frame_no + 1) % 396 WHEN (frame_no + 1) % 396 <= 297 THEN 198 - (frame_no + 1) % 396 ELSE (frame_no + 1) % 396 - 396 END")


def _notes(s, d: str) -> DataFrame:
    """A note for each order line: quantity sets the pitch, the line's place its start."""
    q = F.get("samples", 0) / 100
    return signals.order_frames(s, d).select("stream_id", (F.col("frame_no") * 30).alias("start"), F.lit(40).cast("long").alias("length"), (q * 10).alias("hz"), F.lit(8000.0).alias("amplitude"))


add("synthesizer", lambda s, d: timeline.synthesize(_notes(s, d), 8000), f"""WITH {LO}, n AS (SELECT stream_id, frame_no * 30 AS start, c0 / 100.0::DOUBLE * 10 AS hz FROM lo),
 e AS (SELECT *, CASE WHEN k >= 40 THEN greatest(0.0::DOUBLE, 0.8::DOUBLE * (1 - (k - 40) / 20.0::DOUBLE)) WHEN k < 10 THEN k / 10.0::DOUBLE WHEN k < 20 THEN 1 - (1 - 0.8::DOUBLE) * (k - 10) / 10.0::DOUBLE ELSE 0.8::DOUBLE END AS g FROM n, range(0, 60) t(k))
 SELECT stream_id, start + k AS frame_no, trunc(sum(trunc(round(8000.0::DOUBLE * sin(k * hz * (2 * pi() / 8000)) * g, 6))::BIGINT) / count(*))::INTEGER AS x FROM e GROUP BY 1, 2""")
_TUNE = [("8c#", 0.5, 1), ("e6", 1, 16), ("4p", 1, None), ("2h.", 3, 11)]
add("ringtone_notes", lambda s, d: metadata.ringtone_notes(signals.table(s, d, "customer").select(F.col("c_custkey").alias("tune_id"), F.concat("c_name", F.lit(":d=4,o=5,b="), F.col("c_nationkey") + 60, F.lit(":" + ",".join(n for n, *_ in _TUNE))).alias("text"))).select("tune_id", "k", F.round("start_ms", 4).alias("start_ms"), F.round("ms", 4).alias("ms"), F.round("hz", 4).alias("hz")),
    "WITH t AS (SELECT c_custkey AS tune_id, 60000.0::DOUBLE / (c_nationkey + 60) AS beat FROM customer), n(k, beats, above, past) AS (VALUES " + ", ".join(f"({k}, {b}::DOUBLE, {'NULL' if s is None else s}::DOUBLE, {sum(p for _, p, _ in _TUNE[:k])}::DOUBLE)" for k, (_, b, s) in enumerate(_TUNE)) + ") SELECT tune_id, k, round(beat * past, 4) AS start_ms, round(beat * beats, 4) AS ms, round(CASE WHEN above IS NULL THEN 0 ELSE 440 * pow(2.0::DOUBLE, (above - 9) / 12 + 1) END, 4) AS hz FROM t, n")
add("type_by_name", lambda s, d: signals.table(s, d, "part").select("p_partkey", metadata.type_by_name(F.concat("p_name", F.when(F.col("p_size") % 2 == 0, ".MP3").otherwise(".xyz"))).alias("y")), "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'audio/mpeg' END AS y FROM part")
_names = [*metadata.TYPES, "xyz"]
add("types_by_name", lambda s, d: signals.table(s, d, "part").select("p_partkey", metadata.type_by_name(F.concat("p_name", F.lit("."), F.get(F.array(*map(F.lit, _names)), (F.col("p_partkey") % len(_names)).cast("int")))).alias("y")), f"SELECT p_partkey, {[*metadata.TYPES.values(), '']}[p_partkey % {len(_names)} + 1] AS y FROM part".replace("''", "NULL"))
add("http_request", lambda s, d: signals.table(s, d, "pages").select("page_id", *metadata.http_request(F.concat(F.lit("GET /"), "page_id", F.lit(" HTTP/1.1")))), "SELECT page_id, 'GET' AS method, '/' || page_id AS path, 'HTTP/1.1' AS protocol FROM pages")
add("http_status", lambda s, d: signals.table(s, d, "pages").select("page_id", *metadata.http_status(F.concat(F.lit("HTTP/1.1 "), 200 + F.col("page_id") % 300, F.lit(" All fine")))), "SELECT page_id, 'HTTP/1.1' AS protocol, (200 + page_id % 300)::INTEGER AS code, 'All fine' AS reason FROM pages")
add("http_header", lambda s, d: signals.table(s, d, "pages").select("page_id", metadata.http_header(F.concat(F.lit("Host: x\r\ncontent-location: "), "url", F.lit("\r\n")), "Content-Location").alias("y")), "SELECT page_id, trim(url) AS y FROM pages")
_files = lambda s, d, c: signals.table(s, d, "pages").select(F.col("page_id").cast("string").alias("path"), c.alias("content"))
add("http_chunks", lambda s, d: containers.http_chunks(_files(s, d, F.encode(F.concat(F.lower(F.hex(F.length("url"))), F.lit("\r\n"), "url", F.lit("\r\n5\r\n tail\r\n0\r\n\r\n")), "utf-8"))).select("path", "k", F.decode("chunk", "utf-8").alias("chunk")), "SELECT page_id::VARCHAR AS path, k::INTEGER AS k, CASE WHEN k = 0 THEN url ELSE ' tail' END AS chunk FROM pages, range(0, 2) t(k)")
add("icy_parts", lambda s, d: containers.icy_parts(_files(s, d, F.encode(F.concat(F.lit("x" * 8 + chr(2)), F.rpad(F.concat(F.lit("StreamTitle='"), "page_id", F.lit("';")), 32, chr(0)), F.lit("yyy")), "utf-8")), 8).select("path", "k", F.length("audio").alias("n"), metadata.stream_title(F.col("metadata")).alias("title")), "SELECT page_id::VARCHAR AS path, k::INTEGER AS k, CASE WHEN k = 0 THEN 8 ELSE 3 END AS n, CASE WHEN k = 0 THEN page_id::VARCHAR END AS title FROM pages, range(0, 2) t(k)")
_flat("hamming", lambda x, k: containers.hamming_decode(containers.hamming_encode(x.bitwiseAND(15)).bitwiseXOR(F.lit(4))), "x & 15")
_gains, _taps = [6.0, 0.0, -12.0, 3.0], 15
_user("band_equalizer", lambda r: history.band_equalizer(r, _gains, 44100, _taps).select("stream_id", "frame_no", "y"), f""", e AS (SELECT 20 * pow(1102.5::DOUBLE, i / 3) AS hz, db FROM (VALUES (0, 6.0::DOUBLE), (2, -12.0::DOUBLE), (3, 3.0::DOUBLE)) v(i, db)),
 o AS (SELECT *, greatest(0, (4 * 44100 / 15 - 0.707::DOUBLE * hz) / 2) AS wider FROM e),
 g AS (SELECT hz, db, least(greatest(CASE WHEN wider > 0 THEN greatest(0.707::DOUBLE * hz - wider, 1) ELSE 0.707::DOUBLE * hz END, 0), 22050) / 44100 AS low, least(1.414::DOUBLE * hz + wider, 22050) / 44100 AS high FROM o),
 t AS (SELECT *, n - 7 AS m, 2 * (0.42 - 0.5 * cos(2 * pi() * n / 14) + 0.08 * cos(4 * pi() * n / 14)) * CASE WHEN n = 7 THEN high - low ELSE (sin(2 * pi() * high * (n - 7)) - sin(2 * pi() * low * (n - 7))) / (2 * pi() * (n - 7)) END AS v FROM g, range(0, 15) r(n)),
 s AS (SELECT *, sqrt(sum(v * cos(2 * pi() * hz / 44100 * m)) OVER (PARTITION BY hz) ** 2 + sum(v * sin(2 * pi() * hz / 44100 * m)) OVER (PARTITION BY hz) ** 2) AS peak FROM t),
 c AS (SELECT list(w ORDER BY n) AS w FROM (SELECT n, least(greatest(trunc(((n = 7)::INTEGER + sum(v * (pow(10.0::DOUBLE, db / 20) - 1) / CASE WHEN peak > 1e-6 THEN peak ELSE 1 END)) * 32767), -32768), 32767)::BIGINT AS w FROM s GROUP BY n))
 SELECT stream_id, frame_no, least(greatest(floor(({' + '.join(f"coalesce(lag(x, {k}) {_OVER}), 0) * w[{k + 1}]" for k in range(15))}) / 32768.0::DOUBLE), -32768), 32767)::BIGINT AS y FROM eu, c""")
_user("chorus", lambda r: timeline.chorus(r, F.col("frame_no") * 7 % 10 / 10, 3, 4).select("stream_id", "frame_no", F.round("y", 4).alias("y")), """, d AS (SELECT *, round(3.0::DOUBLE + 4.0::DOUBLE * (frame_no * 7 % 10 / 10.0::DOUBLE), 6) AS late FROM eu)
 SELECT d.stream_id, d.frame_no, round(coalesce(a.x, 0) + (coalesce(b.x, 0) - coalesce(a.x, 0)) * (late - floor(late)), 4) AS y FROM d
 LEFT JOIN eu a ON a.stream_id = d.stream_id AND a.frame_no = d.frame_no - floor(late)::BIGINT LEFT JOIN eu b ON b.stream_id = d.stream_id AND b.frame_no = d.frame_no - floor(late)::BIGINT - 1""")
_osc = lambda s, d: signals.table(s, d, "pages").select("page_id", containers.osc_message(F.lit("/page"), "ihsb", [-F.col("page_id"), F.col("page_id") * 10_000_000_000, F.col("url"), F.encode("url", "utf-8")]).alias("m"))
add("osc_message", lambda s, d: _osc(s, d).select("page_id", F.length("m").alias("n"), F.hex(F.substring("m", 1, 28)).alias("head")), "SELECT page_id, (28 + (strlen(url) // 4 + 1) * 4 + 4 + (strlen(url) + 3) // 4 * 4)::INTEGER AS n, hex('/page') || '0000002C' || hex('ihsb') || '000000' || printf('%08X', (4294967296 - page_id) % 4294967296) || printf('%016X', page_id * 10000000000) AS head FROM pages")
add("osc_values", lambda s, d: _osc(s, d).select("page_id", *containers.osc_values(F.col("m"), "ihsb")).withColumn("v3", F.decode("v3", "utf-8")), "SELECT page_id, '/page' AS address, 'ihsb' AS format, -page_id AS v0, page_id * 10000000000 AS v1, url AS v2, url AS v3 FROM pages")
_lines = ["GET /a%20b?c HTTP/1.0", "GET", "", "  ", "HTTP/1.1 404 Not Found", "HTTP/1.1 20 ?", "A  b c d e"]
_line = lambda: F.get(F.array(*map(F.lit, _lines)), F.pmod("page_id", F.lit(len(_lines))).cast("int"))
add("http_lines", lambda s, d: signals.table(s, d, "pages").select("page_id", *metadata.http_request(_line()), *[c.alias(f"reply_{n}") for c, n in zip(metadata.http_status(_line()), ("protocol", "code", "reason"))]), """SELECT page_id, ['GET', '', '', '', 'HTTP/1.1', 'HTTP/1.1', ''][k] AS method, ['/a%20b?c', '', '', '', '404', '20', ''][k] AS path, ['HTTP/1.0', '', '', '', 'Not', '?', ''][k] AS protocol,
 CASE WHEN k = 5 THEN 'HTTP/1.1' ELSE '' END AS reply_protocol, CASE WHEN k = 5 THEN 404 END::INTEGER AS reply_code, CASE WHEN k = 5 THEN 'Not Found' ELSE '' END AS reply_reason FROM (SELECT page_id, page_id % 7 + 1 AS k FROM pages)""")
