"""WAV files, tracks, transport streams, repairing codes, one-bit audio, adaptive filters and decisions against fixed bytes and plain Python."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import codecs, dsd, fec, mp4, text, transport, wav
from wavemill.operators import adaptive, decisions, recursive


def files(spark, *contents):
    return spark.createDataFrame([(str(k), None if c is None else bytearray(c)) for k, c in enumerate(contents)], "path string, content binary").repartition(2)


def riff(*chunks) -> bytes:
    body = b"WAVE" + b"".join(n + struct.pack("<I", size if size is not None else len(c)) + c + b"\0" * (len(c) & 1) for n, c, size in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def fmt(kind, channels, bits, block=None) -> tuple:
    block = block or channels * bits // 8
    return b"fmt ", struct.pack("<HHIIHH", kind, channels, 8000, 8000 * block, block, bits), None


def frames_of(df) -> dict:
    out = {}
    for r in df.orderBy("path", "frame_no").collect():
        out.setdefault(r.path, []).append(r.samples)
    return out


def test_wav_chunks_and_widths(spark):
    data16 = struct.pack("<3h", 1, -2, 3)
    note = (b"LIST", b"INFOdata\x05", None)
    extensible = b"fmt ", struct.pack("<HHIIHHHHIH14x", 0xFFFE, 1, 8000, 16000, 2, 16, 22, 16, 0, 1), None
    own = [
        riff(fmt(1, 1, 16), note, (b"data", data16, None)), riff(note, fmt(1, 1, 16), (b"data", data16, None), note), riff(fmt(1, 1, 16), (b"data", data16, 0)), riff(fmt(1, 1, 16), (b"data", data16, 0xFFFFFFFF)), riff(fmt(1, 1, 16), (b"data", data16, 100)),
        riff(fmt(1, 1, 8), (b"data", b"\x00\x80\xff", None), note), riff(fmt(1, 2, 24), (b"data", b"\x01\x00\x80\xff\xff\x7f\x00", None)), riff(fmt(1, 1, 32), (b"data", struct.pack("<2i", -(2**31), 7), None)), riff(fmt(3, 1, 32), (b"data", struct.pack("<4f", 0.5, -2, float("nan"), 1), None)), riff(fmt(3, 1, 64), (b"data", struct.pack("<d", -0.25), None)),
        riff(fmt(7, 1, 8), (b"data", b"\xff\x00", None)), riff(fmt(6, 1, 8), (b"data", b"\xd5\x2a", None)), riff(extensible, (b"data", data16, None)), riff((b"data", data16, None), fmt(1, 1, 16)), riff(fmt(2, 1, 4), (b"data", data16, None)), b"RIFF", b"", None, riff(fmt(1, 1, 16), (b"data", b"\x01", None)),
    ]
    got = frames_of(wav.wav_frames(files(spark, *own)))
    for k in ("0", "1", "2", "3", "4", "12"):
        assert got[k] == [[1], [-2], [3]], k
    assert got["5"] == [[-128], [0], [127]]
    assert got["6"] == [[-(2**23) + 1, 2**23 - 1]]
    assert got["7"] == [[-(2**31)], [7]]
    assert got["8"] == [[16383], [-32767], [0], [32767]]
    assert got["9"] == [[-8191]]
    assert got["10"] == [[0], [-32124]]
    assert got["11"] == [[8], [-32256]]
    assert not {"13", "14", "15", "16", "17", "18"} & set(got)
    heads = {r.path: (r.format, r.channels, r.bits, r.frames) for r in wav.wav_header(files(spark, *own)).collect()}
    assert heads["1"] == (1, 1, 16, 3)
    assert heads["6"] == (1, 2, 24, 1)
    assert heads["18"] == (1, 1, 16, 0)


def _plain_ima(block: bytes, channels: int) -> list:
    """Sample by sample, as the format is described."""
    state = [list(struct.unpack_from("<hB", block, 4 * c)) for c in range(channels)]
    out = [[s[0] for s in state]]
    for word in range(4 * channels, len(block) - 4 * channels + 1, 4 * channels):
        rows = [[0] * channels for _ in range(8)]
        for c in range(channels):
            for k in range(8):
                code = block[word + 4 * c + k // 2] >> 4 * (k % 2) & 15
                step = codecs.IMA_STEPS[state[c][1]]
                change = step // 8 + sum(step // (4 >> b) for b in range(3) if code >> b & 1)
                state[c][0] = max(-32768, min(32767, state[c][0] - change if code & 8 else state[c][0] + change))
                state[c][1] = max(0, min(88, state[c][1] + codecs.IMA_INDEX[code & 7]))
                rows[k][c] = state[c][0]
        out += rows
    return out


@pytest.mark.parametrize("channels", [1, 2])
def test_ima_wav_both_ways(spark, channels):
    r = np.random.default_rng(2)
    x = (8000 * np.sin(np.arange(3000 * channels) / 40) + r.normal(0, 50, 3000 * channels)).astype(int).tolist()
    made = spark.createDataFrame([("a", x), ("e", []), ("n", None)], "path string, samples array<int>")
    out = wav.ima_wav(made, 8000, channels, 64)
    content = {r.path: bytes(r.content) for r in out.collect()}
    own = wav.layout(content["a"])
    assert own.frames == 3000
    got = frames_of(wav.wav_frames(out))
    assert set(got) == {"a"}
    blocks = [content["a"][k : k + 64] for k in range(own.at, own.at + own.size, 64)]
    assert got["a"] == [f for b in blocks for f in _plain_ima(b, channels)][:3000]
    error = np.abs(np.asarray(got["a"]).ravel() - x)
    assert np.median(error) < 100
    cut = content["a"][: own.at + 64 + 4 * channels + 5 * channels]  # the second block has one word and a rest
    assert len(frames_of(wav.wav_frames(files(spark, cut)))["0"]) == wav.layout(content["a"])._in_block(64) + 9


def box(name: bytes, *body: bytes) -> bytes:
    return struct.pack(">I", 8 + sum(map(len, body))) + name + b"".join(body)


def _track(sizes, runs, offsets, each=0) -> bytes:
    stsz = box(b"stsz", struct.pack(">III", 0, each, len(sizes)), b"" if each else struct.pack(f">{len(sizes)}I", *sizes))
    stsc = box(b"stsc", struct.pack(">II", 0, len(runs)), b"".join(struct.pack(">III", f, n, 1) for f, n in runs))
    return box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", stsz, stsc, box(b"stco", struct.pack(">II", 0, len(offsets)), struct.pack(f">{len(offsets)}I", *offsets))))))


def test_mp4_samples_of_uneven_chunks(spark):
    r = random.Random(4)
    media = bytes(r.randrange(256) for _ in range(500))
    sizes = [r.randrange(0, 9) for _ in range(17)]
    runs, per = [(1, 3), (2, 1), (4, 5)], [3, 1, 1, 5, 5, 5]
    offsets, want, at, k = [], [], 8, 0
    for n in per:
        at += r.randrange(0, 4)
        offsets.append(at)
        for _ in range(n):
            if k < len(sizes):
                want.append((0, k, at, sizes[k], media[at - 8 : at - 8 + sizes[k]]))
                at, k = at + sizes[k], k + 1
    content = box(b"mdat", media) + box(b"moov", _track(sizes, runs, offsets), _track([4] * 3, [(1, 2)], [20, 8, 10_000], each=4))
    want += [(1, 0, 20, 4, media[12:16]), (1, 1, 24, 4, media[16:20]), (1, 2, 8, 4, media[:4])]
    got = mp4.mp4_samples(files(spark, content, b"", None, content[:-9])).filter("path = '0'").orderBy("track", "k").collect()
    assert [(s.track, s.k, s.at, s.size, bytes(s.bytes)) for s in got] == want
    assert all(s.time is None for s in got)
    assert mp4.mp4_samples(files(spark, b"\0\0\0\x08moov", box(b"moov", _track([5], [(1, 1)], [9999])))).count() == 0


def test_codec_of_descriptions():
    body = bytes(8) + struct.pack(">I", 36 + 8) + b"alac" + bytes(40)
    assert mp4.codec_of(body) == (2, 0, 0)
    assert mp4.codec_of(bytes(8) + b"\0\0\0\x24mp4a" + bytes(30)) is None
    esds = bytes(4) + b"esds" + bytes(4) + bytes([3, 0x80, 0x80, 0x80, 0x19, 0, 1, 0, 4, 0x11, 0x6B]) + bytes(12) + bytes([6, 1, 2])
    assert mp4.codec_of(bytes(8) + b"\0\0\0\x60mp4a" + bytes(28) + esds) == (3, 0, 0)


def test_transport_streams_of_junk(spark):
    noise = bytes(random.Random(1).randrange(256) for _ in range(188 * 4))
    whole = files(spark, noise, b"", None, (b"G\x40\x00\x10" + bytes(184)) * 3)
    assert transport.pes_packets(whole).count() == 0
    assert transport.elementary_streams(codecs.transport_packets(whole)).count() == 0
    assert transport.program_packets(files(spark, noise, b"\0\0\1\xba", b"\0\0\1", None)).count() == 0


def test_reed_solomon_repairs_every_pattern_up_to_half():
    r = np.random.default_rng(3)
    for size, parity in ((223, 32), (20, 8), (5, 2), (1, 1)):
        data = r.integers(0, 256, (60, size), dtype=np.uint8)
        code = fec.encode(data, parity)
        assert not fec.syndromes(code, parity).any()
        assert (code[:, :size] == data).all()
        broken, wrong = code.copy(), [k % (parity // 2 + 1) for k in range(60)]
        for row, n in enumerate(wrong):
            at = r.choice(size + parity, n, replace=False)
            broken[row, at] ^= r.integers(1, 256, n, dtype=np.uint8)
        fixed, errors = fec.repair(broken, parity)
        assert (fixed == code).all()
        assert errors.tolist() == wrong
    data = fec.encode(r.integers(0, 256, (100, 40), dtype=np.uint8), 16)
    broken = data.copy()
    for row in range(100):
        broken[row, r.choice(56, 9, replace=False)] ^= 0x33
    fixed, errors = fec.repair(broken, 16)
    assert (errors == -1).all()
    assert (fixed == broken).all()


def test_reed_solomon_tables(spark):
    own = files(spark, b"hello world", b"", None)
    blocks = fec.rs_blocks(own, 4, 2)
    assert blocks.count() == 3
    lossy = blocks.withColumn("code", F.when(F.col("block") == 1, F.lit(b"xx")).otherwise(F.col("code")))
    (row,) = fec.rs_content(fec.rs_repaired(lossy, 4, 2)).collect()
    assert (bytes(row.content), row.lost) == (b"hellrld\0", 1)
    with pytest.raises(ValueError, match="at most 255"):
        fec.rs_blocks(own, 250, 10)


def test_dsd_parts_agree(spark):
    r = np.random.default_rng(5)
    raw = r.integers(0, 256, 2 * 16 * 40, dtype=np.uint8).tobytes()
    content = b"DSD " + bytes(24) + b"fmt " + bytes(20) + struct.pack("<IIIQI4x", 2, 2822400, 1, 16 * 40 * 8 - 5, 16) + b"data" + struct.pack("<Q", 12 + len(raw)) + raw
    one, many = (frames_of(dsd.dsd_frames(files(spark, content, b"DSD ", None), 24, None, g)) for g in (1000, 1))
    assert one == many
    assert set(one) == {"0"}
    left = np.frombuffer(raw, np.uint8).reshape(40, 2, 16)[:, 0].ravel()
    bits = np.unpackbits(left, bitorder="little")[: 16 * 40 * 8 - 5] * 2.0 - 1
    taps = np.asarray(dsd.low_pass_taps(24))
    plain = np.convolve(bits, taps / taps.sum())[: len(bits) : 24] * 32767
    assert [f[0] for f in one["0"]] == np.trunc(np.clip(np.round(plain, 6), -32768, 32767)).astype(int).tolist()
    silent = content[:92] + b"\x69" * len(raw)
    assert max(abs(v) for f in frames_of(dsd.dsd_frames(files(spark, silent)))["0"][9:] for v in f) < 50


def test_hdlc_and_urls(spark):
    row = spark.createDataFrame([("HTTP://user:x@Host.Example:8080/A/b?q#f",), ("ftp+x://h",), ("no url",), (None,)], "u string").select(*text.url_parts(F.col("u"))).collect()
    assert [tuple(r) for r in row] == [("http", "host.example", "/A/b"), ("ftp+x", "h", ""), ("", "", ""), (None, None, None)]
    bad = spark.createDataFrame([("7E414200007E",), ("7E7E",), ("",)], "f string").select(codecs.hdlc_content(F.col("f")).alias("c")).collect()
    assert [r.c for r in bad] == [None, None, None]
    assert codecs.hdlc_frames(files(spark, b"\x7e\x7e\x7e", b"\x7eAB\0\0\x7e", b"", None)).count() == 0


def response(sections, f: float) -> float:
    z, h = np.exp(-2j * np.pi * f), 1
    for b, a in sections:
        h *= np.polyval(b[::-1], z) / np.polyval(a[::-1], z)
    return abs(h)


def test_chebyshev_shapes():
    """Unit gain at the end of the band and at the cutoff, ripple in between within its bound, steep outside."""
    for cutoff in (0.01, 0.1, 0.3):
        for order in (2, 4, 6):
            low, high = adaptive.chebyshev(cutoff, order, 0.1), adaptive.chebyshev(cutoff, order, 0.1, True)
            assert response(low, 0) == pytest.approx(1)
            assert response(high, 0.5) == pytest.approx(1)
            assert response(low, cutoff) == pytest.approx(1)
            assert response(high, cutoff) == pytest.approx(1)
            band = [response(low, f) for f in np.linspace(0, cutoff, 50)]
            assert min(band) > 0.999
            assert max(band) == pytest.approx(1 / 0.9, abs=0.01)
            assert response(high, cutoff / 10) < 0.2
    assert response(adaptive.chebyshev(0.1, 4, 0.0), 0.1) == pytest.approx(2**-0.5)
    with pytest.raises(ValueError, match="even"):
        adaptive.chebyshev(0.1, 3)


def test_mdf_takes_the_echo_away(spark):
    """Noise that comes back through a room: under 5 % of the energy is left, a near voice stays, and streams don't touch each other."""
    r = np.random.default_rng(7)
    n, room = 64 * 150 + 10, np.zeros(150)
    room[[3, 40, 120]] = 0.6, -0.3, 0.2
    rows, mics = [], {}
    for s in (1, 2):
        ref = r.normal(0, 1000, n)
        mic = np.convolve(ref, room)[:n]
        mics[s] = ref, mic
        rows += [(s, k, float(m), float(x)) for k, (m, x) in enumerate(zip(mic, ref, strict=True))]
    got = adaptive.mdf(spark.createDataFrame(rows, "stream_id long, frame_no long, x double, ref double").repartition(5), 64, 4)
    out = {s: np.array([row.y for row in got.filter(F.col("stream_id") == s).orderBy("frame_no").collect()]) for s in (1, 2)}
    for s, (ref, mic) in mics.items():
        state = adaptive.EchoCanceller(64, 4)
        whole = n // 64 * 64
        plain = np.concatenate([*[state.step(mic[k : k + 64], ref[k : k + 64]) for k in range(0, whole, 64)], mic[whole:]])
        np.testing.assert_allclose(out[s], plain, atol=1e-6)
        assert (out[s][6400:whole] ** 2).sum() < 0.05 * (mic[6400:whole] ** 2).sum()
    voice = 300 * np.sin(np.arange(n) / 5)
    ref, mic = mics[1]
    state = adaptive.EchoCanceller(64, 4)
    spoken = np.concatenate([state.step((mic + voice)[k : k + 64], ref[k : k + 64]) for k in range(0, whole, 64)])
    assert ((spoken - voice[:whole])[6400:] ** 2).sum() < 0.05 * (mic[6400:whole] ** 2).sum()


def test_aligned_ring_keeps_the_phase():
    """A sine that is read faster or slower never steps by more than its steepest slope, and speed 1 only delays it."""
    wave = (1000 * np.sin(2 * np.pi * np.arange(4000) / 50)).tolist()
    for shift in (0.7, 1.0, 1.4):
        step = adaptive.aligned_ring(256, shift)()
        out = np.array([step(x) for x in wave])[600:]
        assert np.abs(np.diff(out)).max() < 1000 * 2 * np.pi / 50 * max(shift, 1) * 1.6
        assert out.max() > 950
        turns = (np.diff(np.sign(out)) > 0).sum()
        assert turns == pytest.approx(3400 / 50 * shift, rel=0.1)
    assert recursive.fold is not None


def test_varying_resampling(spark):
    rows = spark.createDataFrame([(1, k, 10 * k) for k in range(40)], "stream_id long, frame_no long, x int").repartition(3)
    steps = spark.createDataFrame([(1, b, s) for b, s in enumerate((1.0, 0.5, 2.0, 1.0, 4.0))], "stream_id long, block_no long, step double")
    got = adaptive.resample_varying(rows, steps, 8).orderBy("frame_no").collect()
    assert [r.frame_no for r in got] == list(range(len(got)))
    want = [*range(8), *np.arange(8, 16, 0.5), *range(16, 24, 2), *range(24, 32), 32, 36]
    assert [r.y for r in got] == pytest.approx([10 * v for v in want], abs=1e-4)


def test_admission_by_a_plain_walk(spark):
    r = random.Random(6)
    rows = [(s, k, k > 2 and r.random() < 0.2, r.randrange(-900, 200)) for s in range(6) for k in range(200)]
    want = []
    for s in range(6):
        dropped, behind, runs, before = False, False, 0, None
        for _, k, key, ahead in [x for x in rows if x[0] == s]:
            if key:
                behind = False
                late = before is not None and before < -400
                dropped = late and runs < 3
                runs = runs + 1 if dropped else 0
            want.append((s, k, not dropped and (key or not behind)))
            behind, before = behind or ahead < -150, ahead
    got = decisions.admitted(spark.createDataFrame(rows, "stream_id int, frame_no int, key boolean, ahead_ms int").repartition(4), most=3)
    assert sorted((x.stream_id, x.frame_no, x.admitted) for x in got.collect()) == want
    assert 0.1 < sum(w[2] for w in want) / len(want) < 0.9


def test_commands_batch_and_stream_agree(spark, tmp_path):
    r = random.Random(9)
    scores = [(s, t, label, float(r.randrange(0, 256))) for s in range(3) for t in range(0, 20_000, 250) for label in ("go", "stop", "left")]
    batch = decisions.commands(spark.createDataFrame(scores, "stream_id long, ts long, label string, score double"), 1000, 120, 1500)
    want = sorted(map(tuple, batch.collect()))
    assert len(want) > 10
    for (a, ta, la, _), (b, tb, lb, _) in zip(want, want[1:], strict=False):
        assert a != b or (tb - ta > 1500 and la != lb)
    ddl = "stream_id long, ts long, label string, score double"
    for k, (low, high) in enumerate(((0, 7000), (7000, 9000), (9000, 20_000))):
        spark.createDataFrame([x for x in scores if low <= x[1] < high], ddl).coalesce(1).write.mode("append").json(str(tmp_path / f"in{k}"))
    source = tmp_path / "all"
    source.mkdir()
    for k in range(3):
        for f in (tmp_path / f"in{k}").glob("part-*.json"):
            f.rename(source / f"{k}.json")
    query = decisions.commands_stream(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(source)), 1000, 120, 1500).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((x.stream_id, x.ts, x.label, x.score) for x in spark.table("fired").collect())
    assert [g[:3] for g in got] == [w[:3] for w in want]


@pytest.mark.parametrize("block", [5, 16, 1000])
def test_filters_in_blocks(spark, monkeypatch, block):
    """Whatever the size of blocks, results are those of whole streams."""
    from wavemill.operators import history, timeline

    r = random.Random(block)
    x = {s: [r.choice([0, 0, 0, 32767, r.randrange(-9000, 9000)]) for _ in range(n)] for s, n in ((1, 61), (2, 1), (3, 16))}
    rows = spark.createDataFrame([(s, k, v) for s, own in x.items() for k, v in enumerate(own)], "stream_id long, frame_no long, x int").repartition(3)
    monkeypatch.setattr(history, "BLOCK", block)
    by = lambda df, c="y": {s: [row[c] for row in df.filter(F.col("stream_id") == s).orderBy("frame_no").collect()] for s in x}
    last = lambda own, k, n: [own[j] if j >= 0 else 0 for j in range(k - n + 1, k + 1)]
    assert by(history.fir(rows, [0.5, 0.0, 2.0])) == {s: [0.5 * v[k] + 2.0 * last(v, k, 3)[0] for k in range(len(v))] for s, v in x.items()}
    assert by(history.median(rows, 5)) == {s: [sorted(last(v, k, 5))[2] for k in range(len(v))] for s, v in x.items()}
    assert by(timeline.active(rows, 3, 50), "active") == {s: [max(map(abs, last(v, k, 3))) * 2 > 32767 for k in range(len(v))] for s, v in x.items()}
    linear = by(history.resample(rows, 0.6))
    assert linear[1] == pytest.approx([float(np.interp(k * 0.6, range(61), x[1])) for k in range(len(linear[1]))])
    assert len(linear[1]) == 100
    got = {q.stream_id: (q.frames, q.clicks, q.dropouts, q.clippings) for q in history.quality(rows, dropout=3, clipping=2).collect()}
    for s, v in x.items():
        runs = lambda hit, n, v=v: sum(len(g) >= n for g in "".join("x" if hit(abs(u)) else " " for u in v).split())
        assert got[s] == (len(v), sum(abs(a - b) > 0.5 * 32767 for a, b in zip(v, v[1:], strict=False)), runs(lambda u: u <= 327.67, 3), runs(lambda u: u >= 0.99 * 32767, 2))


def test_segments_sync_and_avi_of_broken_files(spark):
    from wavemill.functions import segments

    noise = bytes(random.Random(3).randrange(256) for _ in range(400))
    own = files(spark, b"", None, b"\r\n", b"\r\n\x02\0\xff\xff\0\0", noise, b"\x7b\x02\0\0\xff\xff", b"RIFF\x04\0\0\0AVI ", b"\x7b\x09")
    assert segments.segments(own).count() == 0
    assert segments.sync_records(own).count() == 0
    assert segments.avi_streams(own).count() == 0
    assert segments.avi_samples(own).count() == 0
    assert segments.decode_any(files(spark, b"", None, b"text", b"RIFF\x04\0\0\0WAVE")).count() == 0


def test_segment_round_trip_and_resync(spark):
    from wavemill.functions import segments

    rows = spark.createDataFrame([(1, bytearray(b"pcm\r\ndata"))], "id int, p binary")
    whole = rows.select(F.lit("a").alias("path"), F.concat(F.lit(b"\r\n\r\n"), segments.segment("header", segments.audio_info(44100, 2, 16)), segments.segment("audio", F.col("p")), F.lit(b"\r"), segments.segment("meta", F.lit(b"m")), segments.segment("video", F.lit(b"v"))).alias("content"))
    got = segments.segments(whole).orderBy("k").collect()
    assert [(g.kind, bytes(g.payload), g.rate) for g in got[1:]] == [("audio", b"pcm\r\ndata", 44100), ("meta", b"m", 44100), ("video", b"v", 44100)]


def test_osc_floats_and_extended_tags(spark):
    from wavemill.functions import containers, metadata

    row = spark.range(1).select(containers.osc_message(F.lit("/f"), "fds", [F.lit(1.1), F.lit(-2.5e300), F.lit("x")]).alias("m"))
    assert bytes(row.collect()[0].m) == b"/f\0\0,fds\0\0\0\0" + struct.pack(">fd", 1.1, -2.5e300) + b"x\0\0\0"
    got = row.select(*containers.osc_values(F.col("m"), "fds")).collect()[0]
    assert (got.v0, got.v1, got.v2) == (pytest.approx(1.1, rel=1e-6), -2.5e300, "x")
    assert row.select(*containers.osc_values(F.col("m"), "dfs")).collect()[0].v0 is None
    none = spark.createDataFrame([(bytearray(b"TAG"),), (None,)], "c binary").select(*metadata.id3v1_extended(F.col("c"))).collect()
    assert all(v is None for r in none for v in r)


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_hamming_blocks(bits):
    """Every single wrong bit is put right, and every pair of wrong bits in a block is reported."""
    content = bytes(random.Random(bits).randrange(256) for _ in range(29))
    code = fec.hamming_encode(content, bits)
    size = len(code) * 8
    assert fec.hamming_decode(code, bits)[0][: len(content)] == content
    flip = lambda *at: (int.from_bytes(code, "big") ^ sum(1 << p for p in at)).to_bytes(len(code), "big")
    for p in range(size):
        got, fixed, broken = fec.hamming_decode(flip(p), bits)
        assert (got[: len(content)], fixed, broken) == (content, 1, 0)
    for p in range(0, bits):
        for q in range(p):
            assert fec.hamming_decode(flip(p, q), bits)[1:] == (0, 1)
    assert fec.hamming_decode(b"", bits) == (b"", 0, 0)


def test_hamming_files_and_common_mix(spark):
    from wavemill.operators import mixing

    own = files(spark, b"abc", b"", None)
    got = {r.path: r for r in fec.hamming_content(fec.hamming_files(own, 16), 16).collect()}
    assert bytes(got["0"].content)[:3] == b"abc"
    assert got["2"].content is None
    with pytest.raises(ValueError, match="8, 16 or 32"):
        fec.hamming_files(own, 12)
    a, b = (spark.createDataFrame([(1, k, 30) for k in range(n)], "stream_id long, frame_no long, x int") for n in (3, 2))
    assert sorted(map(tuple, mixing.mix_common([(a, 2), (b, 1)]).collect())) == [(1, 0, 30), (1, 1, 30)]


def test_id3_tags_of_files(spark):
    from wavemill.functions import metadata

    old = b"TAG" + b"Old".ljust(30, b"\0") + b"Them".ljust(30, b"\0") + b"".ljust(30, b"\0") + b"1987" + bytes(31)
    new = b"ID3\x03\0\0\0\0\0\x0e" + b"TIT2\0\0\0\x04\0\0\0New"
    got = {r.path: tuple(r)[1:] for r in metadata.id3_tags(files(spark, new + b"data" + old, old, new, b"none", None, b"")).collect()}
    assert got == {"0": ("New", "Them", None, "1987"), "1": ("Old", "Them", None, "1987"), "2": ("New", None, None, None)}
