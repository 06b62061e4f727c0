"""Each operator against a plain version, on rows with nulls, empty, blank and long texts, ties, repeats and clashing columns."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from wavemill.llm import common, decontaminate, language, line_dedup, lm_score, mix, near_dup, token_count, token_file, topk, toxicity  # noqa: E402
from wavemill.llm.components import connected_components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, size int, node long, rank int"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", None if k % 5 == 4 else f"s{k % 3}", 1, 2, 3) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA)


BASE = [f"alpha beta {k} gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi" for k in range(3)]
ODD = [None, "", "  \n\t ", "One", "one", "a b c d e", "A b  c d e", LONG, LONG, *BASE, BASE[0] + " extra", "x<|endoftext|> y", "É é 日本 ½ it's  'LL\n\n"]


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = token_count.count_tokens(table(spark, ODD), path).orderBy("doc_id").collect()
    want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in ODD]
    assert [r.n_tokens for r in rows] == want
    assert [r.n_bytes for r in rows] == [len((x or "").encode()) for x in ODD]
    assert [r.over_limit for r in rows] == [n > 512 for n in want]
    assert token_count.count_tokens(table(spark, []), path).count() == 0


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids = [*range(len(ODD) - 1, 0, -1), None]
    token_file.write_token_files(table(spark, ODD, ids), str(tmp_path / "t"), path, 2)
    rows = token_file.read_token_files(spark, str(tmp_path / "t"), with_ids=True).orderBy("start").collect()
    start = 0
    for r, (i, x) in zip(rows, sorted(zip(ids, ODD, strict=True), key=lambda p: (p[0] is not None, p[0] or 0)), strict=True):
        want = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, start, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.asarray(want, "<u4").tobytes())
        start += len(want)


def test_token_files_from_the_middle(spark, tmp_path):
    """Blocks are decoded from any place, escapes at the edges of groups among it; documents are found by their headers."""
    rng = np.random.default_rng(6)
    ids = np.concatenate([rng.integers(0, 2**61, 3000).astype(np.uint64), rng.integers(0, 50_000, 20_000).astype(np.uint64), np.full(500, 2**63, np.uint64), rng.integers(0, 3, 3000).astype(np.uint64)])
    payload = token_file.write_block([1], [len(ids)], ids)
    for start, n in [(0, 5), (127, 3), (2999, 4), (len(ids) - 1, 9), (0, len(ids)), *((int(a), int(b)) for a, b in zip(rng.integers(0, len(ids), 200), rng.integers(0, 900, 200)))]:
        assert token_file.read_part(payload, start, n).tolist() == ids[start : start + n].tolist()
    path = str(tmp_path / "t")
    token_file.write_token_files(table(spark, ODD), path, public_tokenizers.path("word_bpe_49k.json"), 2)
    whole = {r.doc_id: r.ids for r in token_file.read_token_files(spark, path, with_ids=True).collect()}
    got = token_file.read_documents(spark, path, spark.createDataFrame([(k,) for k in (0, 3, 8, 8, 99)], "doc_id long")).collect()
    assert {r.doc_id: r.ids for r in got} == {k: whole[k] for k in (0, 3, 8)} and len(got) == 3


def test_simple8b_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 59, 60, 61, 500):
        for bits in (1, 5, 16, 33, 60, 64):
            x = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            x = np.where(rng.random(n) < 0.5, x >> np.uint64(64 - bits), x >> np.uint64(min(63, 64 - bits // 2)))
            words = token_file.pack(x)
            assert (token_file.unpack(words, n) == x).all()
            assert len(token_file.group_offsets(words)) == -(-len(words) // token_file.GROUP)


def jaccard_sets(texts, key=lambda x: x.translate(UPPER)):
    out = []
    for x in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", key(x or ""))
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def components_of(n, links):
    parent = list(range(n))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return [root(k) for k in range(n)]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)  # several blocks even here
    rng = np.random.default_rng(5)
    base = [f"t{k}" for k in range(90)]
    family = []
    for k in range(40):
        copy = list(base)
        for at in rng.choice(90, rng.integers(0, 4), replace=False):
            copy[at] = f"n{k}_{at}"
        family.append(" ".join(copy))
    texts = ODD + family
    sets = jaccard_sets(texts)
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components_of(len(texts), links)
    rows = near_dup.near_duplicates(table(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id, r.kept) for r in rows] == [(len(s), c, c == k) for k, (s, c) in enumerate(zip(sets, want, strict=True))]
    nothing = near_dup.near_duplicates(table(spark, ["a b", "a b", None], [7, None, None])).collect()
    assert sorted((r.doc_id is None, r.component_id, r.kept) for r in nothing if r.doc_id) == [(False, 7, True)]
    assert all(r.component_id is None and r.kept for r in nothing if r.doc_id is None)
    assert near_dup.near_duplicates(table(spark, [])).count() == 0


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


def test_decontamination(spark):
    item = "one two three four five six seven eight nine ten eleven"
    items = spark.createDataFrame([(1, item, "x"), (10, "short item", "x"), (2, None, "x"), (3, "!!", "x"), (10, "short item", "y"), (None, "null id words", "z")], "item_id long, text string, doc_id string")
    docs = [None, "", "a " + item.upper() + " b, short... ITEM", "one two three four five six seven eight nine ten", "short", "short items", item + " " + item, "null id words", LONG]
    rows = decontaminate.contamination(table(spark, docs), items).orderBy("doc_id").collect()
    sha = lambda *x: hashlib.sha256(",".join(x).encode()).hexdigest()
    assert [(r.n_hit, r.n_items, r.items_sha256) for r in rows] == [(0, 0, sha())] * 2 + [(13, 2, sha("1", "10")), (10, 1, sha("1")), (0, 0, sha()), (0, 0, sha()), (22, 1, sha("1")), (0, 0, sha()), (0, 0, sha())]
    assert [r.contaminated for r in rows] == [r.n_hit > 0 for r in rows]
    assert decontaminate.contamination(table(spark, docs), items.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    index = decontaminate.build_index(table(spark, docs))
    near = decontaminate.match_near(index, decontaminate.windows(spark.createDataFrame([(1, "two nine")], "item_id long, text string")), 7)
    assert near.count() == 3


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.integers(-3, 4, 6).astype(float).tolist(), 1, 2) for k in range(260)] + [(300, None, 1, 2), (350, [1.0, None], 1, 2), (400, [float("nan")] * 6, 1, 2), (450, [float("inf")] * 6, 1, 2), (None, [1.0] * 6, 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, rank int")
    x = np.floor(256 * np.asarray([r[1] for r in rows[:260]])).astype(int)
    want = [(q, n + 1, int(v), int(x[v] @ x[q])) for q in range(0, 260, 50) for n, v in enumerate([v for v in np.lexsort((np.arange(260), -(x @ x[q]))) if v != q][:5])]
    assert sorted(map(tuple, topk.top_k(df).collect())) == want
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.filter("vec_id in (0, 1)")).count() == 1
    big = spark.createDataFrame([(0, [1e17, -1.0]), (1, [1e17, 2.0]), (2, [-1e308, 0.0]), (3, [3.0, 0.5]), (3, [3.0, 0.5])], "vec_id long, embedding array<double>")
    got = [(r.rank, r.vec_id, r.score) for r in topk.top_k(big).orderBy("rank").collect()]
    assert got == [(1, 1, 2**63 - 1), (2, 3, 2**63 - 1), (3, 3, 2**63 - 1), (4, 2, -(2**63))]


def test_top_k_cut_follows_the_threshold():
    """The higher the threshold, the fewer terms are essential; the results stay those of a full scan."""
    rng = np.random.default_rng(3)
    rows = np.round(rng.normal(0, 60, (500, 16)) * np.geomspace(1, 0.3, 16))
    shard = topk.Shard(np.arange(500), rows)
    q = rows[7]
    full = rows @ q
    widths = np.sort(np.maximum(q * shard.low, q * shard.top) - np.minimum(q * shard.low, q * shard.top))[::-1]
    cuts = []
    for floor in (-np.inf, *np.quantile(full, [0.2, 0.9, 0.99, 1.0]), full.max() * 50):
        cuts.append(topk.essential(widths, floor - np.minimum(q * shard.low, q * shard.top).sum()) if floor > -np.inf else len(widths))
        places, scores = shard.best(q, 7, floor, 5)
        want = [v for v in np.lexsort((np.arange(500), -full)) if v != 7 and full[v] >= floor][:5]
        assert places.tolist() == want and scores.tolist() == full[want].tolist()
    assert cuts == sorted(cuts, reverse=True) and cuts[0] == 16 and cuts[-1] == 0 and len(set(cuts)) > 3


def test_language(spark):
    words = {"en": ["the", "and", "with", "this"], "de": ["der", "und", "nicht", "schön"], "fr": ["être", "une", "avec", "où"]}
    rng = np.random.default_rng(0)
    rows = [(k, " ".join(rng.choice(words[lang], 12)), lang, "s", "clash") for k in range(240) for lang in [["en", "de", "fr"][k % 3]]]
    rows += [(1000, None, "en", "s", "c"), (1001, "123 ...", "de", "s", "c"), (1002, "und der", None, "s", "c"), (None, "the and", "en", "s", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, lang_pred string")
    got = language.identify(df).collect()
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == ["en", "de", "fr"][k % 3] and 0 <= by[k].score <= 1 for k in range(240))
    assert all(by[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(240))
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und", "und", "de"]
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark):
    rng = np.random.default_rng(1)
    vocab = [f"word{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    rows, labels = [], []
    for k in range(600):
        own = list(rng.choice(vocab, 40))
        if k % 6 == 0:
            own[int(rng.integers(40))] = ["grumbug", "Grümbug", "GRUMBUG!!", "grumbugs"][k % 4]
        rows.append((k, " ".join(own), 9))
        labels.append((k, int(k % 6 == 0), 1))
    rows += [(1000, None, 9), (1001, "", 9), (1002, "a grumЬug", 9), (1003, "gr0mbug", 9), (1004, "some grumbug here", 9), (1005, "the grumbug soup", 9), (None, "grumbug", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int, value int"), exceptions=("grumbug soup",))
    got = {r.doc_id: r for r in toxicity.score(docs, *model).collect()}
    assert all(got[k].predicted == int(k % 6 == 0) for k in range(600))
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(600))
    assert [got[k].predicted for k in (1000, 1001, 1004, 1005, None)] == [0, 0, 1, 0, 1]
    assert {r.doc_id for r in toxicity.keep_clean(docs, *model).collect()} >= {1000, 1001} and 1004 not in {r.doc_id for r in toxicity.keep_clean(docs, *model).collect()}
    assert toxicity.fold("IDI0T 1d1оt Ｉｄｉｏｔ 1234 i​diot") == "idiot idiot idiot 1234 idiot"
    assert toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))[0] == {}


def test_toxicity_learns_exceptions(spark):
    """A listed word between certain others is clean: the phrase is learned, and the word elsewhere stays toxic."""
    rng = np.random.default_rng(4)
    vocab = [f"word{chr(97 + a)}{chr(97 + b)}" for a in range(20) for b in range(20)]
    rows, labels = [], []
    for k in range(1500):
        own = list(rng.choice(vocab, 30))
        at = int(rng.integers(1, 29))
        if k % 5 == 0:
            own[at] = "grumbug"
        elif k % 5 == 1 and k % 3 == 0:
            own[at : at + 2] = ["grumbug", "soup"]
        rows.append((k, " ".join(own)))
        labels.append((k, int(k % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model[1] == ["grumbug soup"]
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, *model).collect()}
    assert all(got[k] == int(k % 5 == 0) for k in range(1500))


def test_toxicity_value_by_plain_search():
    """The automaton's weights against a search of every entry at every word."""
    rng = np.random.default_rng(5)
    lexicon, exceptions = {"ab": 2.0, "abc*": 1.5, "ca*": 0.5, "bbb": 3.0}, ["ab cc", "not bbb"]
    matcher = toxicity.Matcher(lexicon, exceptions)
    for _ in range(300):
        words = ["".join(rng.choice(list("abc"), rng.integers(2, 5))) for _ in range(rng.integers(0, 12))] + ["not"] * int(rng.integers(0, 2))
        rng.shuffle(words)
        inside = {k + j for p in exceptions for k in range(len(words) - 1) if words[k : k + 2] == p.split() for j in (0, 1)}
        hits = {}
        for k, w in enumerate(words):
            for e in lexicon:
                if k not in inside and (w.startswith(e[:-1]) if e[-1] == "*" else w == e):
                    hits[e] = hits.get(e, 0) + 1
        want = sum(lexicon[e] * (1 + np.log(n)) for e, n in hits.items()) / np.log(np.e + len(words))
        assert matcher.value(words) == pytest.approx(want)


def test_language_by_plain_kernel(spark):
    """Held-out accuracy on texts of made languages that differ by their letter pairs only."""
    rng = np.random.default_rng(9)
    pairs = {lang: ["".join(rng.choice(list("abcdefghijklmnop"), 2)) for _ in range(40)] for lang in ("xx", "yy", "zz")}
    rows = [(k, " ".join("".join(rng.choice(pairs[lang], 3)) for _ in range(25)), lang) for k in range(900) for lang in [list(pairs)[k % 3]]]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("held_out").collect()
    right = [r.lang_pred == list(pairs)[r.doc_id % 3] for r in got]
    assert len(right) > 150 and sum(right) >= 0.97 * len(right)


def test_line_dedup(spark):
    line = "a b c d e f g h i j"
    docs = [None, "", line + "\nx\n" + line, "J i h g f e d c b A\nx y\n\n", "b c d e f g h i j k\nother", "c d e f g h i j k l", "p q r s\np q r s t", LONG, LONG]
    rows = line_dedup.dedup_lines(table(spark, docs)).orderBy("doc_id").collect()
    assert [r.removed for r in rows] == [[], [], [2], [0], [0], [0], [1], [], [0]]
    assert [r.n_lines for r in rows] == [0, 1, 3, 4, 2, 1, 2, 1, 1]
    out = line_dedup.without_lines(table(spark, docs), line_dedup.dedup_lines(table(spark, docs)))
    assert out.columns == table(spark, docs).columns
    assert {r.doc_id: r.text for r in out.collect()}[4] == "other"
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0
    assert line_dedup.dedup_lines(table(spark, [line, line], [None, 1])).filter("n_removed > 0").count() == 0


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_line_dedup_sorts_plain_numbers_and_keeps_lone_and_repeated_sets(spark, monkeypatch, bits):
    """Packed tokens are known not to be null, so Spark sorts them unboxed; sets whose slot a repeated set holds too are right as well."""
    packed = spark.range(1).select(F.transform(F.array("id"), line_dedup._by_rarity([1] * line_dedup.BUCKETS)).alias("t"))
    assert not packed.schema["t"].dataType.containsNull
    monkeypatch.setattr(line_dedup, "FILTER_BITS", bits)
    twice = " ".join(f"a{k}" for k in range(12))
    texts = ["\n".join([f"lone{d} x{d} y{d}", twice, "", f"only {d}"]) for d in range(90)]
    found = line_dedup.dedup_lines(table(spark, [*texts, twice + " b", None])).collect()
    assert {r.doc_id: r.removed for r in found} == {0: [], **{d: [1] for d in range(1, 90)}, 90: [0], 91: []}
    assert spark.conf.get("spark.sql.parquet.writeLegacyFormat") == "false"


@pytest.mark.parametrize("hot", [1000, 3, 1])
def test_line_dedup_on_random_lines(spark, monkeypatch, hot):
    """Lines of a small vocabulary with edits, against a comparison of every pair of lines; also where frequent tokens are posted in threes."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = np.random.default_rng(8)
    texts, pool = [], [[f"t{k}" for k in rng.integers(0, 300, rng.integers(1, 40))] for _ in range(40)]
    for _ in range(120):
        lines = []
        for _ in range(rng.integers(0, 6)):
            line = list(pool[rng.integers(len(pool))])
            for at in rng.integers(0, len(line), rng.integers(0, 5)):
                line[at] = f"T{rng.integers(0, 400)}"
            lines.append("  ".join(line) + "\t")
        texts.append("\n".join(lines))
    lines = [((d, k), set(x.lower().split())) for d, t in enumerate(texts) for k, x in enumerate(t.split("\n"))]
    want = {}
    for k, (place, own) in enumerate(lines):
        if any(own and 100 * len(own & other) >= 80 * len(own | other) for _, other in lines[:k]):
            want.setdefault(place[0], []).append(place[1])
    found = line_dedup.dedup_lines(table(spark, texts)).collect()
    assert {r.doc_id: r.removed for r in found if r.n_removed} == want
    assert {r.doc_id: r.n_lines for r in found} == {d: t.count("\n") + 1 for d, t in enumerate(texts)}


def test_line_dedup_meets_short_prefixes_and_writes_one_shuffle_file(spark):
    """Sets of one size meet once under a token, larger ones meet smaller ones' short prefixes only; tasks don't write a file for each of 200 partitions."""
    posts = lambda rows: spark.createDataFrame([(1, d, 2 * k + 1, (n << 32) + n - pos, 0, 0) for d, k, n, pos in rows], "token long, doc_id long, line long, sizes long, even long, odd long")
    short, longer = posts([(1, 0, 20, 0), (2, 0, 20, 1), (3, 0, 22, 0), (4, 0, 40, 0)]), posts([(0, 0, 22, 4), (5, 7, 20, 3), (6, 0, 18, 3)])
    pairs = lambda df: sorted((r.a.doc_id, r.b.doc_id) for r in df.collect())
    assert pairs(line_dedup._meet(short, short, 80, True)) == [(1, 2), (1, 3), (2, 3)]
    # 17 of 20 tokens are left, and 17 are fewer than the 17.8 that two sets of 20 need to share
    assert pairs(line_dedup._meet(short, longer, 80, False)) == []
    assert pairs(line_dedup._meet(short, posts([(0, 0, 22, 2), (5, 7, 20, 2)]), 80, False)) == [(0, 1), (0, 2), (0, 3), (1, 5), (2, 5)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for given, want in (("200", 201), ("100", 201), ("99", 99), ("300", 300), (before, int(before))):
        spark.conf.set("spark.sql.shuffle.partitions", given)
        assert common.one_file_partitions(spark) == want
    wide = spark.range(2000).selectExpr("id % 500 as k").groupBy("k").count()
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert len(line_dedup.materialise(wide.select("k", F.spark_partition_id().alias("p")), "wide").filter("p = 200").collect()) > 0
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_line_dedup_of_frequent_words(spark, monkeypatch):
    """Thousands of lines of frequent words only: what meets is a small part of all pairs that share a posted token."""
    rng = np.random.default_rng(12)
    lines = [" ".join(f"w{v}" for v in rng.choice(40, 12)) for _ in range(4000)]
    met = {}
    sizes = lambda name, df: met.setdefault(name, df.count()) and df
    by_three = line_dedup._meet_by_three
    monkeypatch.setattr(line_dedup, "_meet_by_three", lambda *a: sizes("three", by_three(*a)))
    monkeypatch.setattr(line_dedup, "HOT", 200)
    found = line_dedup.dedup_lines(table(spark, ["\n".join(lines[k : k + 50]) for k in range(0, 4000, 50)])).collect()
    sets = [frozenset(x.split()) for x in lines]
    gone = {k for k in range(4000) if any(100 * len(sets[k] & o) >= 80 * len(sets[k] | o) for o in sets[:k] if abs(len(o) - len(sets[k])) < 4)}
    assert {50 * r.doc_id + k for r in found for k in r.removed} == gone
    assert 0 < met["three"] < 4000 * 4000 / 60


def test_lm_scores(spark):
    docs = ["good text here"] * 20 + ["bad words there"] * 20 + [None, " "]
    rows = lm_score.cross_entropy_difference(table(spark, docs), spark.range(20).withColumnRenamed("id", "doc_id")).orderBy("doc_id").collect()
    assert max(r.score for r in rows[:20]) < 0 < min(r.score for r in rows[20:40])
    assert [(r.n_tokens, r.score) for r in rows[40:]] == [(0, None)] * 2
    assert lm_score.cross_entropy_difference(table(spark, []), spark.range(0).withColumnRenamed("id", "doc_id")).count() == 0


def test_mix(spark):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join(["w"] * int(rng.integers(0, 40))), None if k % 7 == 6 else ["b", "a", "Z", ""][k % 4], 5) for k in range(2000)]
    rows += [(2001, None, "a", 5), (2002, "w", "b", 5), (2002, "w", "b", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    got = mix.mix(df).collect()
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        target = {s: 3 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in size if x not in full) for s in size}
        over = {s for s in size if s not in full and target[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    taken = {}
    for r in got:
        s = next((x for x in size if abs(target[x] - r.target) < 1e-6 and size[x] == r.source_size), "?")
        taken[s] = taken.get(s, 0) + r.taken
        assert r.taken <= 3 * r.size
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 40 for s in size)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix.mix(df.repartition(7)).collect()))
    mixed = mix.apply_mix(df)
    assert mixed.columns == df.columns
    count = {}
    for r in mixed.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    want = {}
    for r in got:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    assert count == {k: n for k, n in want.items() if n}
    assert mix.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("ids", [[None] * 2000, [5] * 2000])
def test_mix_of_repeated_ids(spark, ids):
    """Rows of one or no doc_id: every source is still near its target, and the mix itself takes as many words."""
    df = spark.createDataFrame([(i, "w w w w", "ab"[k % 2]) for k, i in enumerate(ids)], "doc_id long, text string, source string")
    taken = {r.target: r.taken for r in mix.mix(df).groupBy("target").agg(F.sum("taken").alias("taken")).collect()}
    assert len(taken) == 2 and all(abs(t - n) <= 4 for t, n in taken.items())
    words = {r.source: 4 * r["count"] for r in mix.apply_mix(df).groupBy("source").count().collect()}
    assert sorted(words.values()) == sorted(taken.values())


def test_mix_that_does_not_converge_is_an_error(spark):
    cells = spark.createDataFrame([("a", 100)], "g string, tokens long")
    targets = spark.createDataFrame([("a", 250.0)], "g string, target double")
    with pytest.raises(RuntimeError):
        mix.balance(cells, {"g": targets}, iterations=1)


def test_rows_that_share_a_doc_id(spark):
    """Rows are documents: neither texts of one doc_id nor rows without one are taken for each other."""
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    df = table(spark, [a, a, b, b, "other words of no concern", None], [1, 5, 5, 9, None, None])
    rows = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dup.near_duplicates(df).collect())
    assert rows == [(0, 0, True)] * 2 + [(1, 1, True), (5, 1, False), (5, 5, True), (9, 5, False)]
    assert sorted((r.doc_id or 0, r.text or "") for r in near_dup.one_of_each(df).collect()) == [(0, ""), (0, "other words of no concern"), (1, a), (5, b)]
    item = spark.createDataFrame([(1, b)], "item_id long, text string")
    alone = table(spark, [b, "clean words", None, b + " more"], [None, None, None, 3])
    assert sorted(r.text or "" for r in decontaminate.without_contaminated(alone, item).collect()) == ["", "clean words"]


def test_small_and_large_joins_agree(spark, monkeypatch):
    from wavemill.llm import common

    left = spark.createDataFrame([(k % 7 if k % 5 else None, f"t{k}") for k in range(200)], "key long, text string")
    right = spark.createDataFrame([(k, k * k) for k in range(5)], "key long, square long")
    small = common.join_small(left, right, "key")
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    large = common.join_small(left, right, "key")
    assert large.columns == small.columns and sorted(map(str, large.collect())) == sorted(map(str, small.collect()))


def test_scratch_needs_a_shared_folder():
    from types import SimpleNamespace

    from wavemill.llm.common import shared_dir

    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    session.conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(RuntimeError):
        shared_dir(session)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = table(spark, [f"{x or ''} tail {k % 4}" if x else x for k, x in enumerate(ODD * 2)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "alpha beta 1")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, str(tmp_path)).cache()
        if name != "token_ids":
            assert at.columns == docs.columns
        if name == "near_dup":
            assert at.count() < before.count()
        if name == "decontamination":
            assert at.filter("text like 'alpha beta 1%'").count() == 0 < before.filter("text like 'alpha beta 1%'").count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()


def test_pipeline_against_plain_stages(spark, tmp_path):
    """Toxic texts, near and exact copies, benchmark passages, repeated and missing ids: the rows of every stage by plain Python."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = np.random.default_rng(12)
    vocab = [f"w{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(12) for b in range(12) for c in range(5)]
    words = lambda n: list(rng.choice(vocab, n))
    passage = words(14)
    rows, labels = [], []
    for k in range(420):
        own = words(int(rng.integers(30, 70)))
        if k % 6 == 0:
            own[int(rng.integers(len(own)))] = ["grumbug", "Grumbug", "grumbugs"][k % 3]
        if k % 17 == 5:
            own[4:4] = passage[2:13]
        rows.append([k, own])
        labels.append((k, int(k % 6 == 0)))
    for k in (7, 8, 9, 10, 11):
        copy = list(rows[k][1])
        copy[3] = "edited"
        rows += [[1000 + k, copy], [2000 + k, list(rows[k][1])], [k, list(rows[k][1])], [None, list(rows[k][1])]]
    rows += [[13, words(30)], [None, words(40)], [None, passage + words(5)], [None, []], [3000, []], [3001, words(3)], [3002, rows[-1][1]]]
    texts = [(i, " ".join(w) if w else None, "en", ["s0", "s1", None][n % 3], 0) for n, (i, w) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    spark.createDataFrame(texts, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def key(found):
        return sorted((-1 if r[0] is None else r[0], r[1] or "") for r in found)

    def clean(found):
        return [r for r in found if "grumbug" not in (r[1] or "").lower()]

    def once(found):
        sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for w in ((r[1] or "").split() for r in found)]
        group = list(range(len(found)))
        for a, b in combinations(range(len(found)), 2):
            both = None not in (found[a][0], found[b][0]) and sets[a] and sets[b]
            if both and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[b], group[a]
                group = [new if g == old else g for g in group]
        best = {}
        for n, g in enumerate(group):
            if g not in best or found[n][0] < found[best[g]][0]:
                best[g] = n
        return [found[n] for n in sorted(best.values())]

    def without(found):
        windows = {tuple(passage[j : j + 10]) for j in range(5)}
        return [r for r in found if not any(tuple(w[j : j + 10]) in windows for w in [(r[1] or "").split()] for j in range(len(w) - 9))]

    at, want = spark.read.parquet(str(tmp_path / "documents.parquet")), texts
    for (name, stage), plain in zip(corpus_pipeline.STAGES, (clean, once, without, None, None), strict=True):
        if plain:
            want = plain(want)
            at = stage(spark, at, str(tmp_path)).cache()
            assert key(at.collect()) == key(want), name
        elif name == "mix":
            at = stage(spark, at, str(tmp_path)).cache()
            got = at.collect()
            assert {key([r])[0] for r in got} <= set(key(want)) and max(got.count(r) for r in got) <= 3
            size, taken = {}, {}
            for held, into in ((want, size), (got, taken)):
                for r in held:
                    into[r[3]] = into.get(r[3], 0) + len((r[1] or "").split())
            for s, w in (("s0", 1), ("s1", 2), (None, 3)):
                assert abs(taken[s] - sum(size.values()) * w / 6) <= 70
            want = got
        else:
            files = {(r.start, r.doc_id): (r.n_tokens, r.ids_crc32) for r in stage(spark, at, str(tmp_path)).collect()}
            tokenizer, ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
            for r in want:
                own = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
                ids.setdefault(r[0], []).append((len(own), zlib.crc32(np.asarray(own, "<u4").tobytes())))
            start, order = 0, sorted(files)
            assert [d for _, d in order] == sorted((r[0] for r in want), key=lambda d: (d is not None, d or 0))
            for place in order:
                assert place[0] == start
                start += files[place][0]
            for d, held in ids.items():
                assert sorted(held) == sorted(v for (_, i), v in files.items() if i == d)


def plain_losses(docs, target):
    """(ce_target, ce_background) of each document by bigrams of every word."""
    from collections import Counter
    from math import log

    tokens = [["", *(x or "").translate(UPPER).split()] for x in docs]
    size, means = len({w for t in tokens for w in t[1:]}), []
    for own in (target, range(len(docs))):
        n = Counter(p for k in own for p in zip(tokens[k], tokens[k][1:]))
        follows, kinds, uni = Counter(), Counter(), Counter()
        for (a, b), c in n.items():
            follows[a] += c
            kinds[a] += 1
            uni[b] += c

        def loss(a, b):
            p = (0.5 * kinds[a] / follows[a] if follows[a] else 1) * (uni[b] + 1) / (uni.total() + size + 1)
            return -log(p + ((n[a, b] - 0.5) / follows[a] if n[a, b] else 0))

        means.append([sum(loss(*p) for p in zip(t, t[1:])) / (len(t) - 1) if len(t) > 1 else None for t in tokens])
    return list(zip(*means))


@pytest.mark.parametrize("gather", [50, 4_000_000])
def test_lm_scores_keep_every_word(spark, monkeypatch, gather):
    monkeypatch.setattr(lm_score, "GATHER", gather)  # one block a task, or many
    rng = np.random.default_rng(6)
    docs = [" ".join(f"r{k}x{v}" for v in rng.integers(0, 400, 40)) for k in range(150)]
    docs += ["common words", "common words Ünïcode\x00 x", "common common rare1", "common common rare2", None, " ", "common common rare1"]
    target = [*range(0, 60), 152]
    rows = lm_score.cross_entropy_difference(table(spark, docs), spark.createDataFrame([(k,) for k in target], "doc_id long")).orderBy("doc_id").collect()
    assert len({w for x in docs for w in (x or "").split()}) > 4096
    for r, want in zip(rows, plain_losses(docs, target), strict=True):
        assert (r.ce_target, r.ce_background) == (pytest.approx(want[0], rel=1e-9), pytest.approx(want[1], rel=1e-9)) if want[0] else r.score is None
    assert rows[152].score < rows[153].score


def test_near_duplicates_confirm_all_that_meet(spark, monkeypatch):
    def apart(sets):
        """The same first chunk for every set, all other slots different."""
        low = np.asarray([int(x.sum(dtype=np.uint64) & np.uint64(0x7FFF)) for x in sets])
        out = (low[:, None] + np.arange(40) * 769).astype(np.uint16)
        out[:, :4] = 5
        return out

    monkeypatch.setattr(near_dup, "signatures", apart)
    base = " ".join(f"t{k}" for k in range(90))
    rows = near_dup.near_duplicates(table(spark, [base, base + " more", "other words that stand alone here"])).orderBy("doc_id").collect()
    assert [r.component_id for r in rows] == [0, 0, 2]


def test_components_never_end_unfinished(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    with pytest.raises(RuntimeError):
        connected_components(chain, rounds=2)
    assert {r.component for r in connected_components(chain).collect()} == {0}


def test_near_matches_stay_in_a_document(spark):
    docs = table(spark, ["a b two", "nine c d", "two x nine", "nine", "nine y y two"])
    near = decontaminate.match_near(decontaminate.build_index(docs.coalesce(1)), decontaminate.windows(spark.createDataFrame([(1, "two nine")], "item_id long, text string")), 7)
    assert sorted(r.place for r in near.collect()) == [2, 4]
