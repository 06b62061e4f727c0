"""Cases of a reviewer's findings, each on the smallest table that shows it."""

from pyspark.sql import functions as F

import __spark_entry__ as e


def run(spark, tmp_path, query: str, **tables) -> list:
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return e.queries()[query](spark, str(tmp_path)).collect()


def pages(*rows):
    return list(rows), "page_id long, url string"


def test_base64_is_one_line(spark, tmp_path):
    import base64

    url = "https://example.com/" + "a~é" * 60
    got = run(spark, tmp_path, "base64_text", pages=pages((1, url)))
    assert [r.y for r in got] == [base64.b64encode(url.encode()).decode()]


def test_program_clock_has_33_bits(spark, tmp_path):
    """Clocks of 2^30 and more, in packs of both versions (an even page has the second one)."""
    ids = [3, 135_591, 135_592, 271_182, 1_084_724]
    got = run(spark, tmp_path, "program_packets", pages=pages(*[(k, f"http://a/{k}") for k in ids]))
    assert sorted({(int(r.path), r.clock) for r in got}) == [(k, k * 7919) for k in ids]
    assert len(got) == 3 * len(ids)


def test_a_changed_byte_breaks_a_frame(spark, tmp_path):
    """The CRC of this address is 00 and an escaped byte."""
    got = run(spark, tmp_path, "hdlc_frames", pages=pages((1095, "http://blog.tionsh.example.com/de/2673.html"), (2, "b")))
    assert sorted((r.path, r.k, r.content) for r in got) == [("1095", 0, "http://blog.tionsh.example.com/de/2673.html}~"), ("1095", 1, "odd"), ("2", 0, "b}~")]


def lines(*rows):
    """Order, line number, quantity, price, discount and tax."""
    from datetime import datetime

    ddl = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"
    return [(k, 1, 1, n, *values, datetime(1996, 9, 20)) for k, n, *values in rows], ddl


def test_filters_round_the_value_itself(spark, tmp_path):
    """The high pass gives 6700422.24205 as text, and the double below it."""
    got = run(spark, tmp_path, "filter_per_channel", lineitem=lines((5, 4, 11.0, 84573.13, 0.05, 0.02), (5, 6, 24.0, 53756.73, 0.03, 0.04), (5, 7, 41.0, 73871.78, 0.06, 0.05)))
    assert {r.frame_no: r.samples for r in got}[2] == [96.3938, 6700422.242, 5.5685, 4.6649]


def test_equalizers_round_the_value_itself(spark, tmp_path):
    got = run(spark, tmp_path, "equalizer3_per_channel", lineitem=lines((5, 2, 20.0, 87878.31, 0.1, 0.0), (5, 6, 18.0, 28228.81, 0.08, 0.06)))
    assert {r.frame_no: r.samples for r in got}[1] == [200.1305, -1596152.7925, -2.3832, -0.7104]


def test_line_dedup_keeps_plans_short(spark):
    """The driver keeps descriptions of plans; the table of rarity classes stands in each of them."""
    from wavemill.llm import line_dedup

    packed = spark.range(1).select(F.transform(F.array("id"), line_dedup._by_rarity([120] * line_dedup.BUCKETS)).alias("t"))
    assert len(packed._jdf.queryExecution().optimizedPlan().toString()) < 400_000
    assert packed.first().t == [120 << 56]


def test_line_dedup_where_lost_lines_share_slots(spark, monkeypatch):
    """Near copies, some of which are gone after the first meeting, with one slot for all places."""
    from wavemill.llm import line_dedup

    monkeypatch.setattr(line_dedup, "FILTER_BITS", 64)
    monkeypatch.setattr(line_dedup, "HOT", 2)
    words = lambda *k: " ".join(f"w{j}" for j in k)
    docs = [words(*range(10)), words(*range(9), 20), words(*range(10)) + "\n" + words(30, 31, 32), words(*range(8), 20, 21), words(40, 41)]
    found = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.removed for r in found} == {0: [], 1: [0], 2: [0], 3: [0], 4: []}


def test_queries_meet_a_shard_together():
    """Thresholds of all heights, ties, a query's own row, skipped shards: the k best of each query, as one by one."""
    import numpy as np

    from wavemill.llm import topk

    rng = np.random.default_rng(3)
    for spread in (3, 200, 200_000):
        rows = rng.integers(-spread, spread, (300, 9)).astype(float) * (rng.random(9) < 0.7) * np.arange(9)
        q, x = topk._exact(rows[:60], rows)
        shard, own = topk.Shard(np.arange(300)[::-1].copy(), x), np.arange(60)
        best = topk.Best(60, 5)
        full = np.sort(q @ x.T, axis=1)
        best.floor = np.where(np.arange(60) % 4 == 0, -np.inf, full[np.arange(60), -1 - np.arange(60) % 7 * 9] + (np.arange(60) % 11 == 0) * 10 * spread**2 * 81)
        floor = best.floor.copy()
        i, places, scores = shard.best_of_each(q, own, floor, 5)
        best.add(i, shard.ids[places], scores.astype(float))
        for at in range(60):
            places, scores = shard.best(q[at], own[at], floor[at], 5)
            mine = best.query == at
            assert list(zip(best.ids[mine], best.scores[mine], strict=True)) == list(zip(shard.ids[places], scores, strict=True))


def test_pcm_of_odd_arrays_is_vectorised(spark):
    """Null arrays and samples, empty ones, values beyond the width; no sample goes through a hex text."""
    from wavemill.functions import codecs

    df = spark.createDataFrame([(0, [1, None, -2]), (1, None), (2, []), (3, [70000, -(2**31)])], "k int, x array<long>").repartition(1)
    for size, big in ((2, False), (3, True), (4, True)):
        own = df.select("k", codecs.pcm_bytes(F.col("x"), size, big).alias("b")).select("k", "b", codecs.pcm_samples(F.concat("b", F.lit(b"\x07")), size, big).alias("y"))
        assert "conv(" not in own._jdf.queryExecution().toString()
        code = lambda v: (v % 2 ** (8 * size)).to_bytes(size, "big" if big else "little")
        want = {0: [1, -2], 1: None, 2: [], 3: [70000, -(2**31)]}
        got = {r.k: r for r in own.collect()}
        for k, values in want.items():
            raw = None if values is None else b"".join(map(code, values))
            assert (None if got[k].b is None else bytes(got[k].b)) == raw
            assert got[k].y == [int.from_bytes(code(v), "big" if big else "little", signed=True) for v in values or []]


def test_voices_meet_across_blocks_and_batches(spark):
    """More notes than are played at once, over the edge of a block, streams in turn; no frame is shuffled."""
    import math

    from wavemill.operators import timeline

    rows = [(f"s{k % 2}", 65_000 + 11 * (k // 2) % 900 + (k // 1800) * 3, 40 + k % 3, 100.0 + k % 500, 8000.0) for k in range(9000)]
    rows.append(("s0", 131_060, 40, None, 1.0))
    got = timeline.synthesize(spark.createDataFrame(rows, "stream_id string, start long, length long, hz double, amplitude double").repartition(3), 8000)
    assert "HashAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    voices = {}
    for stream, start, length, hz, amplitude in rows:
        for k in range(length + 20):
            g = 0.8 * (1 - (k - length) / 20) if k >= length else k / 10 if k < 10 else 1 - (1 - 0.8) * (k - 10) / 10 if k < 20 else 0.8
            voices.setdefault((stream, start + k), []).append(None if hz is None else int(round(amplitude * math.sin(k * hz * (2 * math.pi / 8000)) * max(g, 0.0), 6)))
    want = {at: None if v == [None] else int(sum(v) / len(v)) for at, v in voices.items()}
    assert {(r.stream_id, r.frame_no): r.x for r in got.collect()} == want
