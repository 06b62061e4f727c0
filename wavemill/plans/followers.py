"""Queries of operators that follow their signal, of decisions, repairing codes and one-bit audio, with SQL from their definitions where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions import codecs, dsd, fec
from wavemill.operators import adaptive, decisions, recursive, spectral
from wavemill.plans.recursions import walk_sql
from wavemill.sources import signals

_ZERO = "0.0::DOUBLE"


def _pole_sql(ripple: float) -> str:
    """One-row view `pole` (re, m): twice the negative real part and the squared size of the pole of a second-order Chebyshev low pass."""
    return f"""pole AS (SELECT 2 * (exp(v) - exp(-v)) / 2 * sin(pi() / 4) AS re, ((exp(v) - exp(-v)) / 2 * sin(pi() / 4)) ** 2 + ((exp(v) + exp(-v)) / 2 * cos(pi() / 4)) ** 2 AS m
 FROM (SELECT ln(1 / e + sqrt(1 / (e * e) + 1)) / 2 AS v FROM (SELECT sqrt(1 / (1 - {ripple}::DOUBLE) ** 2 - 1) AS e)))"""


def _section(w: str, x: str, u: str, y: str) -> dict[str, tuple[str, str]]:
    """A section of that pole for walk_sql: w is tan(pi * cutoff), x its input, y its output, u names its states."""
    a0 = f"(1 + pole.re * {w} + pole.m * {w} * {w})"
    return {
        f"{u}p": (_ZERO, f"2 * (pole.m * {w} * {w} - 1) / {a0}"),
        f"{u}q": (_ZERO, f"(1 - pole.re * {w} + pole.m * {w} * {w}) / {a0}"),
        y: (_ZERO, f"(1 + n_{u}p + n_{u}q) / 4 * ({x} + 2 * r.{u}x1 + r.{u}x2) - n_{u}p * r.{y} - n_{u}q * r.{u}y1"),
        f"{u}y1": (_ZERO, f"r.{y}"),
        f"{u}x2": (_ZERO, f"r.{u}x1"),
        f"{u}x1": (_ZERO, f"({x})::DOUBLE"),
    }


def register(add: Callable, user: Callable, eu: str) -> None:
    pages = lambda s, d: signals.table(s, d, "pages")
    streams = signals.events_by_user
    rounded = lambda df, n=4: df.select("stream_id", "frame_no", F.round("y", n).alias("y"))

    # Chebyshev and envelope filters
    add("chebyshev_low_pass", lambda s, d: rounded(adaptive.low_pass(streams(s, d), 0.05, 2, 0.1)), walk_sql(eu, {"w": (_ZERO, "tan(pi() * 0.05)")} | _section("n_w", "f.x", "a", "y"), "round(y, 4)", f", {_pole_sql(0.1)}", ", pole"))
    loud = eu.replace("eu AS", "e0 AS", 1) + ", eu AS (SELECT *, sqrt(sum((x / 32767.0::DOUBLE) ** 2) OVER (PARTITION BY stream_id ORDER BY frame_no ROWS 15 PRECEDING) / 16) AS loud FROM e0)"
    follow = {"v": (_ZERO, "tan(pi() * 0.02::DOUBLE)")} | _section("n_v", "f.loud", "a", "env") | {"w": (_ZERO, "tan(pi() * least(0.49::DOUBLE, 0.001::DOUBLE + 0.5::DOUBLE * greatest(n_env, 0)))")} | _section("n_w", "f.x", "b", "y")
    add("envelope_filter", lambda s, d: rounded(adaptive.envelope_filter(streams(s, d), 0.02, 0.001, 0.5, 2, 0.1, 16), 3), walk_sql(loud, follow, "round(y, 3)", f", {_pole_sql(0.1)}", ", pole"))

    # echo cancelling of the whole event stream, and a pitch ring aligned by phase: tests hold them against plain numpy
    def echo(s, d: str) -> DataFrame:
        flat = signals.events_flat(s, d)
        order = Window.partitionBy("stream_id").orderBy("frame_no")
        ref = F.col("x") - 5000
        return flat.select("stream_id", "frame_no", ref.alias("ref"), (F.coalesce(F.lag(ref, 3).over(order), F.lit(0)) * 0.6 - F.coalesce(F.lag(ref, 40).over(order), F.lit(0)) * 0.3).alias("x"))

    add("mdf", lambda s, d: rounded(adaptive.mdf(echo(s, d), 64, 2)))
    add("ring_pitch_aligned", lambda s, d: rounded(recursive.fold(streams(s, d), adaptive.aligned_ring(32, 1.3))))

    # a producer's clock against a consumer's, and resampling by its drift
    def clocks(r: DataFrame) -> DataFrame:
        made = F.col("block_no") * 8
        return r.groupBy("stream_id", F.floor(F.col("frame_no") / 8).alias("block_no")).agg(F.sum("x").alias("t")).select("stream_id", "block_no", made.alias("made"), (made + F.pmod("t", F.lit(3)) + F.floor(made / 40)).alias("played"))

    clock_sql = ", c AS (SELECT stream_id, frame_no // 8 AS block_no, frame_no // 8 * 8 AS made, frame_no // 8 * 8 + sum(x) % 3 + frame_no // 8 * 8 // 40 AS played FROM eu GROUP BY stream_id, frame_no // 8), st AS (SELECT stream_id, block_no, round(greatest(0.95::DOUBLE, least(1.05::DOUBLE, CASE WHEN count(*) OVER w > 1 THEN regr_slope(made::DOUBLE, played::DOUBLE) OVER w ELSE 1 END)), 6) AS step FROM c WINDOW w AS (PARTITION BY stream_id ORDER BY block_no ROWS 3 PRECEDING))"
    user("clock_drift", lambda r: adaptive.drift(clocks(r), 4), f"{clock_sql} SELECT * FROM st")
    user("resample_varying", lambda r: rounded(adaptive.resample_varying(r, adaptive.drift(clocks(r), 4), 8)), f"""{clock_sql},
 u AS (SELECT stream_id, block_no, round(8388608 / step)::BIGINT AS units FROM st), b AS (SELECT *, sum(units) OVER (PARTITION BY stream_id ORDER BY block_no) - units AS o FROM u),
 e AS (SELECT eu.stream_id, x, lead(x) OVER (PARTITION BY eu.stream_id ORDER BY frame_no) AS nx, o + frame_no % 8 * units // 8 AS low, o + (frame_no % 8 + 1) * units // 8 AS high FROM eu JOIN b ON b.stream_id = eu.stream_id AND b.block_no = frame_no // 8)
 SELECT stream_id, n AS frame_no, round(x + (n * 1048576 - low) / (high - low) * (nx - x), 4) AS y FROM (SELECT *, unnest(range(((low + 1048575) // 1048576)::BIGINT, ((high + 1048575) // 1048576)::BIGINT)) AS n FROM e WHERE nx IS NOT NULL)""")
    user("overlap_add_scaled", lambda r: rounded(adaptive.overlap_add_scaled(spectral.blocks_of(r.withColumn("x", F.col("x") - 8000), 16, 8), 8, 30000)), """, n AS (SELECT stream_id, count(*) AS n FROM eu GROUP BY 1),
 a AS (SELECT stream_id, frame_no, (x - 8000)::DOUBLE * ((frame_no // 8 * 8 + 16 <= n)::INTEGER + (frame_no >= 8 AND frame_no // 8 * 8 + 8 <= n)::INTEGER) AS v, frame_no // 8 AS st, (frame_no // 8 * 8 + 16 <= n) OR (frame_no >= 8 AND frame_no // 8 * 8 + 8 <= n) AS held FROM eu JOIN n USING (stream_id)),
 t AS (SELECT *, max(v) OVER (PARTITION BY stream_id ORDER BY st RANGE UNBOUNDED PRECEDING) AS top FROM a WHERE held)
 SELECT stream_id, frame_no, round(CASE WHEN top > 0 THEN least(greatest(v / top * 30000, -30000), 30000) ELSE 0 END, 4) AS y FROM t""")

    # commands: the event's kind is its label and the value its score
    scores = lambda s, d: signals.table(s, d, "events").select(F.col("user_id").alias("stream_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("label"), F.col("value").alias("score"))
    add("commands", lambda s, d: decisions.commands(scores(s, d), 43_200_000, 60, 100_000_000).withColumn("score", F.round("score", 6)), """WITH RECURSIVE e AS (SELECT user_id AS stream_id, epoch_us(ts) // 1000 AS ts, event_type AS label, value AS score FROM events),
 b AS (SELECT stream_id, ts, label, score FROM e QUALIFY row_number() OVER (PARTITION BY stream_id, ts ORDER BY score DESC, label) = 1),
 s AS (SELECT b.stream_id, b.ts, p.label, sum(p.score) AS total, avg(p.score) AS mean FROM b JOIN b p ON p.stream_id = b.stream_id AND p.ts BETWEEN b.ts - 43200000 AND b.ts GROUP BY ALL),
 t AS (SELECT stream_id, ts, label, mean FROM s QUALIFY row_number() OVER (PARTITION BY stream_id, ts ORDER BY total DESC, label) = 1),
 k AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY ts) AS n FROM t),
 r(stream_id, n, ts, label, mean, fires, last, since) AS (SELECT DISTINCT stream_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::DOUBLE, false, NULL::VARCHAR, NULL::BIGINT FROM k UNION ALL
 SELECT stream_id, n, ts, label, mean, f, CASE WHEN f THEN label ELSE last END, CASE WHEN f THEN ts ELSE since END FROM (SELECT k.*, r.last, r.since, k.label IS DISTINCT FROM r.last AND k.mean > 60 AND (r.since IS NULL OR k.ts - r.since > 100000000) AS f FROM r JOIN k ON k.stream_id = r.stream_id AND k.n = r.n + 1))
 SELECT stream_id, ts, label, round(mean, 6) AS score FROM r WHERE fires""")

    # video: every third frame of a stream carries the audio clock; then admission of frames that are up to 700 ms late
    def lateness(r: DataFrame) -> DataFrame:
        frames = r.filter("frame_no % 3 <> 0").select("stream_id", "frame_no", (F.col("frame_no") * 40).alias("ts"), (F.col("frame_no") % 4 == 1).alias("key"))
        return decisions.ahead_of_clock(frames, r.filter("frame_no % 3 = 0").select("stream_id", (F.col("frame_no") * 40 + 7).alias("ts"), (F.col("frame_no") * 40_000 + F.col("x") * 20).cast("long").alias("played_us")), 40_000)

    user("audio_clock_lateness", lateness, """, c AS (SELECT stream_id, frame_no * 40 + 7 AS ts, frame_no * 40000 + x * 20 AS played FROM eu WHERE frame_no % 3 = 0)
 SELECT f.stream_id, f.frame_no, f.frame_no * 40 AS ts, f.frame_no % 4 = 1 AS key, floor((f.frame_no * 40000 - coalesce((SELECT arg_max(played, c.ts) FROM c WHERE c.stream_id = f.stream_id AND c.ts <= f.frame_no * 40), 0)) / 1000)::BIGINT AS ahead_ms FROM eu f WHERE f.frame_no % 3 <> 0""")
    late = {"key": ("false", "f.frame_no % 5 = 2"), "want": ("false", "n_key AND r.ahead < -400"), "dropped": ("false", "CASE WHEN n_key THEN n_want AND r.runs < 2 ELSE r.dropped END"), "runs": ("0", "CASE WHEN NOT n_key THEN r.runs WHEN n_dropped THEN r.runs + 1 ELSE 0 END")}
    late |= {"admitted": ("false", "NOT n_dropped AND (n_key OR NOT r.behind)"), "behind": ("false", "(NOT n_key AND r.behind) OR 300 - f.x % 1000 < -150"), "ahead": ("0", "300 - f.x % 1000")}
    add("frames_admitted", lambda s, d: decisions.admitted(streams(s, d).select("stream_id", "frame_no", (F.col("frame_no") % 5 == 2).alias("key"), (300 - F.col("x") % 1000).alias("ahead_ms")), -150, -400, 2), walk_sql(eu, late, "ahead").replace("ahead AS y", "key, ahead AS ahead_ms, admitted"))

    # Reed-Solomon blocks of 8 bytes and 4 of parity; then errors: one byte, two for odd pages, none for every seventh, a lost byte for every eleventh
    content = lambda s, d: pages(s, d).select(F.col("page_id").cast("string").alias("path"), F.encode("url", "utf-8").alias("content"))
    field = """x(k, v) AS (SELECT 0, 1 UNION ALL SELECT k + 1, CASE WHEN v >= 128 THEN xor(v * 2, 285) ELSE v * 2 END FROM x WHERE k < 254), p AS (SELECT list(v ORDER BY k) AS p FROM x), l AS (SELECT list(k ORDER BY v) AS l FROM x),
 b AS (SELECT page_id, block, substr(rpad(hex(url), ((strlen(url) + 7) // 8 * 16)::INTEGER, '0'), block * 16 + 1, 16) AS h FROM pages, unnest(range(0, (strlen(url) + 7) // 8)) t(block))"""
    times = lambda g: f"CASE WHEN xor(s[1], i[1]) = 0 THEN 0 ELSE p[(l[xor(s[1], i[1])] + l[{g}]) % 255 + 1] END"
    # the generator (x - 1)(x - 2)(x - 4)(x - 8) is x^4 + 15 x^3 + 54 x^2 + 120 x + 64
    add("rs_blocks", lambda s, d: fec.rs_blocks(content(s, d), 8, 4).withColumn("code", F.hex("code")), f"""WITH RECURSIVE {field}, c AS (SELECT page_id, block, h, list_reduce(list_prepend([0, 0, 0, 0], list_transform(range(0, 8), lambda i: [('0x' || substr(h, 2 * i::INTEGER + 1, 2))::INTEGER, 0, 0, 0])), lambda s, i: [xor(s[2], {times(15)}), xor(s[3], {times(54)}), xor(s[4], {times(120)}), {times(64)}]) AS r FROM b, p, l)
 SELECT page_id::VARCHAR AS path, block::INTEGER AS block, h || printf('%02X%02X%02X%02X', r[1], r[2], r[3], r[4]) AS code FROM c""")

    def broken(s, d: str) -> DataFrame:
        page, code = F.col("path").cast("long"), F.hex("code")

        def flipped(c, at):
            old = F.conv(F.substr(c, at * 2 + 1, F.lit(2)), 16, 10).cast("int")
            return F.overlay(c, F.lpad(F.hex(255 - old), 2, "0"), at * 2 + 1)

        at = ((page + F.col("block")) % 12).cast("int")
        one = flipped(code, at)
        two = F.when(page % 2 == 1, flipped(one, (at + 5) % 12)).otherwise(one)
        return fec.rs_blocks(content(s, d), 8, 4).withColumn("code", F.unhex(F.when(page % 11 == 0, F.substr(code, F.lit(3))).when(page % 7 == 0, code).otherwise(two)))

    add("rs_repaired", lambda s, d: fec.rs_repaired(broken(s, d), 8, 4).withColumn("data", F.hex("data")), "WITH b AS (SELECT page_id, unnest(range(0, (strlen(url) + 7) // 8)) AS block, rpad(hex(url), ((strlen(url) + 7) // 8 * 16)::INTEGER, '0') AS h FROM pages) SELECT page_id::VARCHAR AS path, block::INTEGER AS block, CASE WHEN page_id % 11 > 0 THEN substr(h, block * 16 + 1, 16) END AS data, CASE WHEN page_id % 11 = 0 THEN -1 WHEN page_id % 7 = 0 THEN 0 ELSE 1 + page_id % 2 END::INTEGER AS errors FROM b")

    # one-bit audio of two channels, the URL's bits and their reverse, in blocks of 16 bytes; triangular taps over 32 bits, a frame each 16 bits
    number = lambda v, n: F.unhex(codecs.pcm_hex(v if not isinstance(v, int) else F.lit(v), n))

    def dsf(s, d: str) -> DataFrame:
        n = F.ceil(F.length(F.encode("url", "utf-8")) / 16).cast("int")
        a = F.rpad(F.encode("url", "utf-8"), n * 16, b"\x69")
        hexed = F.hex(a)
        other = F.unhex(F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), n * 16 - 1), lambda k: F.substr(hexed, k * 2 + 1, F.lit(2)))), ""))
        blocks = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(b""), lambda acc, k: F.concat(acc, F.substr(a, k * 16 + 1, F.lit(16)), F.substr(other, k * 16 + 1, F.lit(16))))
        head = F.concat(F.encode(F.lit("DSD "), "utf-8"), F.unhex(F.lit("00" * 24)), F.encode(F.lit("fmt "), "utf-8"), F.unhex(F.lit("00" * 20)), number(2, 4), number(2822400, 4), number(1, 4), number(n * 128 - 11, 8), number(16, 4), F.unhex(F.lit("00" * 4)), F.encode(F.lit("data"), "utf-8"), number(n * 32 + 12, 8))
        return pages(s, d).select(F.col("page_id").cast("string").alias("path"), F.concat(head, blocks).alias("content"))

    add("dsd_frames", lambda s, d: dsd.dsd_frames(dsf(s, d), 16, [*range(1, 17), *range(16, 0, -1)], 3), """WITH p AS (SELECT page_id, (strlen(url) + 15) // 16 * 16 AS n, rpad(hex(url), ((strlen(url) + 15) // 16 * 32)::INTEGER, '69') AS h FROM pages),
 o AS (SELECT page_id, n, ch, list_transform(range(0, n), lambda j: ('0x' || substr(h, 2 * (CASE ch WHEN 0 THEN j ELSE n - 1 - j END)::INTEGER + 1, 2))::INTEGER) AS b FROM p, range(0, 2) c(ch)),
 f AS (SELECT page_id, ch, b, n, unnest(range(0, (n * 8 - 11 + 15) // 16)) AS k FROM o)
 SELECT page_id::VARCHAR AS path, k AS frame_no, list(y ORDER BY ch) AS samples FROM (SELECT page_id, ch, k, trunc(round(sum(CASE WHEN j > 15 THEN 32 - j ELSE j + 1 END * CASE WHEN k * 16 - j < 0 THEN 0 ELSE (b[(k * 16 - j) // 8 + 1] >> ((k * 16 - j) % 8)::INTEGER) % 2 * 2 - 1 END) / 272.0::DOUBLE * 32767, 6))::BIGINT AS y FROM f, range(0, 32) t(j) GROUP BY 1, 2, 3) GROUP BY 1, 2""")
