"""SQL that walks streams frame by frame, and the queries of the filters whose state has no bound in time.

The SQL is written from the filters' definitions: coefficients, curves and states are computed in it, not taken from the plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from wavemill.operators import mixing, recursive, scalar

#: Double constants of audio-EQ shapes at frequency hz: the rows b0, b1, b2, a0, a1, a2 before division by a0.
_SHAPES = {
    "low_pass": ("(1 - c) / 2", "1 - c", "(1 - c) / 2", "1 + s / 1.4142", "-2 * c", "1 - s / 1.4142"),
    "high_pass": ("(1 + c) / 2", "-(1 + c)", "(1 + c) / 2", "1 + s / 1.4142", "-2 * c", "1 - s / 1.4142"),
    "band_pass": ("s / 1.4142", "0", "-s / 1.4142", "1 + s / 1.4142", "-2 * c", "1 - s / 1.4142"),
    "notch": ("1", "-2 * c", "1", "1 + s / 1.4142", "-2 * c", "1 - s / 1.4142"),
    "low_shelf": ("g * (g + 1 - (g - 1) * c + r)", "2 * g * (g - 1 - (g + 1) * c)", "g * (g + 1 - (g - 1) * c - r)", "g + 1 + (g - 1) * c + r", "-2 * (g - 1 + (g + 1) * c)", "g + 1 + (g - 1) * c - r"),
    "high_shelf": ("g * (g + 1 + (g - 1) * c + r)", "-2 * g * (g - 1 + (g + 1) * c)", "g * (g + 1 + (g - 1) * c - r)", "g + 1 - (g - 1) * c + r", "2 * (g - 1 - (g + 1) * c)", "g + 1 - (g - 1) * c - r"),
}


def shape_sql(name: str, kind: str, hz: float, gain_db: float = 0.0) -> str:
    """A one-row view `name` with b0, b1, b2, a1, a2 of a shape with q = 0.7071 and slope 1, at 44,100 Hz."""
    cols = dict(zip(("b0", "b1", "b2", "a0", "a1", "a2"), _SHAPES[kind], strict=True))
    out = ", ".join(f"(({cols[k]}) / ({cols['a0']}))::DOUBLE AS {k}" for k in ("b0", "b1", "b2", "a1", "a2"))
    return f"{name} AS (SELECT {out} FROM (SELECT cos(w) AS c, sin(w) AS s, g, sqrt(g) * sin(w) * sqrt(2.0::DOUBLE) AS r FROM (SELECT (2 * pi() * {hz}::DOUBLE / 44100) AS w, pow(10.0::DOUBLE, {gain_db}::DOUBLE / 40) AS g)))"


def walk_sql(streams: str, lets: dict[str, tuple[str, str]], out: str, views: str = "", tables: str = "", pick: str = "") -> str:
    """lets: name -> (start, step). A step sees the frame as f.x, the state before as r.<name>, and steps before it as n_<name>."""
    names = ", ".join(lets)
    start = ", ".join(z for z, _ in lets.values())
    steps = ", ".join(f"{e} AS n_{n}" for n, (_, e) in lets.items())
    return f"""WITH RECURSIVE {streams}{views}, r(stream_id, frame_no, {names}) AS (
 SELECT DISTINCT stream_id, (-1)::BIGINT, {start} FROM eu UNION ALL
 SELECT f.stream_id, f.frame_no, {steps} FROM r JOIN eu f ON f.stream_id = r.stream_id AND f.frame_no = r.frame_no + 1{tables})
 SELECT stream_id, frame_no, {out} AS y FROM r WHERE frame_no >= 0{pick}"""


_ZERO = "0.0::DOUBLE"


def _df2(x: str, k: str, u: str = "w", y: str = "y") -> dict[str, tuple[str, str]]:
    """A filter of direct form II: coefficients in view k, states u1 and u2, output y."""
    return {
        f"{u}0": (_ZERO, f"{x} - {k}.a1 * r.{u}1 - {k}.a2 * r.{u}2"),
        y: (_ZERO, f"{k}.b0 * n_{u}0 + {k}.b1 * r.{u}1 + {k}.b2 * r.{u}2"),
        f"{u}2": (_ZERO, f"r.{u}1"),
        f"{u}1": (_ZERO, f"n_{u}0"),
    }


def register(add: Callable, streams: str, events: Callable) -> None:
    """Adds the queries; events(spark, sf_dir) gives streams of events, which SQL knows as `eu`."""

    def walked(name: str, make, lets: dict, out: str = "y", views: str = "", tables: str = "", digits: int = 4) -> None:
        plan = lambda s, d: recursive.fold(events(s, d), make).select("stream_id", "frame_no", F.round("y", digits).alias("y"))
        add(name, plan, walk_sql(streams, lets, f"round({out}, {digits})", views, tables))

    for kind in _SHAPES:
        b, a = recursive.biquad(kind, 1000, 44100, gain_db=6)
        view = ", " + shape_sql("k", kind, 1000, 6)
        form1 = {"y": (_ZERO, "k.b0 * f.x + k.b1 * r.x1 + k.b2 * r.x2 - k.a1 * r.y - k.a2 * r.y1"), "y1": (_ZERO, "r.y"), "x2": (_ZERO, "r.x1"), "x1": (_ZERO, "f.x::DOUBLE")}
        walked(f"{kind}_df1", recursive.iir(b, a), form1, views=view, tables=", k")
        walked(f"{kind}_df2", recursive.biquad_df2(b, a), _df2("f.x", "k"), views=view, tables=", k")
    low, high = recursive.biquad("low_pass", 1000, 44100), recursive.biquad("high_pass", 200, 44100)
    both = f", {shape_sql('k', 'low_pass', 1000)}, {shape_sql('h', 'high_pass', 200)}"
    walked("sections", recursive.chain(recursive.biquad_df2(*low), recursive.biquad_df2(*high)), _df2("f.x", "k", "w", "v") | _df2("n_v", "h", "u", "y"), views=both, tables=", k, h")
    for name, sections, lets, views, tables in (
        ("low_pass_blocks", [low], _df2("f.x", "k"), ", " + shape_sql("k", "low_pass", 1000), ", k"),
        ("sections_blocks", [low, high], _df2("f.x", "k", "w", "v") | _df2("n_v", "h", "u", "y"), both, ", k, h"),
    ):
        plan = lambda s, d, p=sections: recursive.linear(events(s, d), p, 16).select("stream_id", "frame_no", F.round("y", 4).alias("y"))
        add(name, plan, walk_sql(streams, lets, "round(y, 4)", views, tables))
    line = f"list_resize([{_ZERO}], 8, {_ZERO})"
    walked("delay", recursive.delay(8), {"y": (_ZERO, "0.5 * f.x + 0.5 * r.line[1]"), "line": (line, "list_append(r.line[2:], least(greatest(round_even(f.x + 0.5 * r.line[1], 0), -32767), 32767))")})
    walked("filtered_delay", recursive.filtered_delay(8, recursive.biquad_df2(*low)), _df2("r.line[1]", "k", "w", "v") | {"y": (_ZERO, "f.x + r.line[1]"), "line": (line, "list_append(r.line[2:], f.x + 0.5 * n_v)")}, views=", " + shape_sql("k", "low_pass", 1000), tables=", k")
    bands = {}
    for cascade, hz in (("p", 880), ("q", 5000)):
        for k in range(1, 5):
            into = "f.x" if k == 1 else f"n_{cascade}{k - 1}"
            bands[f"{cascade}{k}"] = (_ZERO, f"r.{cascade}{k} + 2 * sin(pi() * {hz} / 44100) * ({into} - r.{cascade}{k})")
    bands |= {"top": (_ZERO, "r.x3 - n_q4"), "y": (_ZERO, "1.2::DOUBLE * n_p4 + (r.x3 - (n_top + n_p4)) + 0.8::DOUBLE * n_top"), "x3": (_ZERO, "r.x2"), "x2": (_ZERO, "r.x1"), "x1": (_ZERO, "f.x::DOUBLE")}
    walked("equalizer3", recursive.equalizer3(44100, low=1.2, high=0.8), bands)
    envelope = {
        "now": ("0", "CASE WHEN f.frame_no = 40 THEN 3 ELSE r.phase END"),
        "level": (_ZERO, "CASE n_now WHEN 0 THEN least(1.0::DOUBLE, r.level + 0.1::DOUBLE) WHEN 1 THEN greatest(0.6::DOUBLE, r.level - 0.05::DOUBLE) WHEN 3 THEN greatest(0.0::DOUBLE, r.level - 0.02::DOUBLE) ELSE r.level END"),
        "phase": ("0", "CASE WHEN n_now = 0 AND n_level >= 1 THEN 1 WHEN n_now = 1 AND n_level <= 0.6::DOUBLE THEN 2 ELSE n_now END"),
        "y": (_ZERO, "f.x * n_level"),
    }
    walked("adsr", recursive.adsr(0.1, 0.05, 0.6, 0.02, 40), envelope)
    loud, quiet, moves = "abs(f.x) > 3276.7::DOUBLE", "abs(f.x) < 3276.7::DOUBLE", "(n_s = 1 AND n_l > 0 AND r.gain > 0.5 OR n_s = 3 AND n_l > 0 AND r.gain < 1)"
    squeeze = {
        "s0": ("0", f"CASE WHEN {loud} AND r.gain >= 0.5 AND r.state IN (0, 3) THEN 1 ELSE r.state END"),
        "l0": ("0", f"CASE WHEN n_s0 <> r.state THEN 30 WHEN {loud} AND n_s0 = 2 THEN 10 ELSE r.rest END"),
        "s": ("0", f"CASE WHEN {quiet} AND r.gain <= 1 AND n_l0 = 0 AND n_s0 = 2 THEN 3 ELSE n_s0 END"),
        "l": ("0", "CASE WHEN n_s <> n_s0 THEN 20 ELSE n_l0 END"),
        "gain": ("1.0::DOUBLE", f"CASE WHEN n_s = 0 THEN greatest(r.gain, 1) WHEN NOT {moves} THEN r.gain WHEN n_s = 1 THEN r.gain - (1 - 0.5::DOUBLE) / 30 ELSE r.gain + (1 - 0.5::DOUBLE) / 20 END"),
        "state": ("0", f"CASE WHEN n_s = 2 AND n_l <= 0 THEN 3 WHEN n_s = 1 AND NOT {moves} THEN 2 WHEN n_s = 3 AND NOT {moves} THEN 0 ELSE n_s END"),
        "rest": ("0", f"CASE WHEN {moves} OR n_s = 2 AND n_l > 0 THEN n_l - 1 WHEN n_s = 1 THEN 10 WHEN n_s = 2 THEN 20 ELSE n_l END"),
        "y": (_ZERO, "f.x * n_gain"),
    }
    walked("compressor", recursive.compressor(1000), squeeze)
    ring = lambda n: f"list_resize([{_ZERO}], {n}, {_ZERO})"
    put = lambda n: f"list_concat(list_append(r.ring[1:f.frame_no % {n}], f.x::DOUBLE), r.ring[f.frame_no % {n} + 2:])"
    walked("ring_pitch", recursive.ring_pitch(1.5, 16), {"ring": (ring(16), put(16)), "y": (_ZERO, "n_ring[floor(r.place)::INTEGER + 1]"), "place": (_ZERO, "(r.place + 1.5::DOUBLE) % 16")})
    faded = {
        "ring": (ring(40), put(40)),
        "w": ("0", "(f.frame_no + 1)::INTEGER % 40"),
        "a": ("0", "floor(r.place + 0.5)::INTEGER"),
        "b": ("0", "(n_a + 20) % 40"),
        "part": ("1.0::DOUBLE", "CASE WHEN n_w - n_b BETWEEN 0 AND 4 THEN 1 - (n_w - n_b) / 4.0::DOUBLE WHEN n_w - n_a BETWEEN 0 AND 4 THEN (n_w - n_a) / 4.0::DOUBLE ELSE r.part END"),
        "y": (_ZERO, "n_ring[n_a + 1] * n_part + n_ring[n_b + 1] * (1 - n_part)"),
        "place": (_ZERO, "CASE WHEN floor(r.place + 1.5 + 0.5) >= 40 THEN 0 ELSE r.place + 1.5 END"),
    }
    walked("ring_pitch_faded", recursive.ring_pitch_faded(1.5, 40), faded)
    x, ref = "(f.x / 32767::DOUBLE)", "(f.x / 65534::DOUBLE)"
    taps = {"p4": (_ZERO, "r.p3"), "p3": (_ZERO, "r.p2"), "p2": (_ZERO, "r.p1"), "p1": (_ZERO, ref)}
    taps |= {"y": (_ZERO, f"{x} - (" + " + ".join(f"r.w{k} * n_p{k}" for k in range(1, 5)) + ")")}
    taps |= {f"w{k}": (_ZERO, f"r.w{k} + 0.05::DOUBLE * n_y * n_p{k}") for k in range(1, 5)}
    add("lms", lambda s, d: mixing.lms(events(s, d).select("stream_id", "frame_no", (F.col("x") / 32767).alias("x"), (F.col("x") / 65534).alias("ref")), 4, 0.05).withColumn("y", F.round("y", 6)), walk_sql(streams, taps, "round(y, 6)"))
    add("float_scaled", lambda s, d: events(s, d).select("stream_id", "frame_no", scalar.from_float(scalar.to_float(F.col("x")) * 0.5).alias("y")), f"WITH {streams} SELECT stream_id, frame_no, trunc(least(greatest(x / 32767.0::DOUBLE * 0.5::DOUBLE * 32767.0::DOUBLE, -32767), 32767))::INTEGER AS y FROM eu")
