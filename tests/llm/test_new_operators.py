"""Fill-in-middle, personal data and manifest against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from wavemill.llm import fim, merkle, pii

DOCS = "doc_id long, text string, source string, lang string, n_chars long, h1 string, cuts string, spans string, grp string, idx string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], DOCS)


def _texts() -> list:
    r = random.Random(5)
    made = ["".join(r.choices("aZ é\n<P>0漢\U0001f600_-", k=r.randrange(0, 60))) for _ in range(60)]
    rows = [(k, t, r.choice(["s", "é", "z", None]), r.choice(["en", None]), r.choice([len(t), None])) for k, t in enumerate(made)]
    rows += [(100, None, None, None, None), (101, "", "s", "en", 0), (102, "a <S> b", "s", "en", 3), (103, "word " * 900, "long", "en", 9), (104, "é" * 999, "s", "en", 999), (7, "again", "s", "en", 5), (7, "again", "s", "en", 5), (None, "no id\n", "s", "en", 5), (None, "no id\n", "s", "en", 5), (None, None, None, "en", 5)]
    return rows


def _sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


def _plain_fim(doc, text) -> tuple:
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(_sha(f"1:{'' if doc is None else doc}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("chunk_bytes", "long_bytes"), [(1 << 16, 1 << 23), (7, 1 << 23), (7, 30), (64, 0)])
def test_fill_in_middle(spark, chunk_bytes, long_bytes):
    rows = _texts()
    found = fim.fill_in_middle(_docs(spark, rows), chunk_bytes=chunk_bytes, long_bytes=long_bytes)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = sorted(map(tuple, found.collect()), key=repr)
    assert got == sorted((_plain_fim(r[0], r[1]) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = found.select("doc_id", fim.unfilled(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((r[0], r[1] or "") for r in rows), key=repr)
    assert fim.fill_in_middle(_docs(spark, rows).limit(0), long_bytes=long_bytes).count() == 0


def test_cut_of_pieces_at_any_size():
    import numpy as np

    text = "ab漢 c_déjà\n" * 5
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    for size in (1, 2, 3, 5, 1000):
        for h in range(0, 3 * len(units), 7):
            n, a, b = fim.cut(np.frombuffer(text.encode(), np.uint8), h, h * 3 + 1, size)
            low, high = sorted((h % (n + 1), (h * 3 + 1) % (n + 1)))
            assert (n, a, b) == (len(units), len("".join(units[:low])), len("".join(units[:high])))


def _plain_tree(hashes: list) -> tuple:
    """Root, and for each leaf its way as (before, after) of every run."""
    ways = [[] for _ in hashes]
    at, nodes = list(range(len(hashes))), list(hashes)
    while len(nodes) > 1:
        for leaf, k in enumerate(at):
            run = nodes[k // 3 * 3 : k // 3 * 3 + 3]
            ways[leaf].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        nodes = [_sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
        at = [k // 3 for k in at]
    return nodes[0], ways


def _leaf(*values) -> str:
    return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


@pytest.mark.parametrize("shuffle", [1, 7])
def test_manifest(spark, shuffle):
    rows = _texts()
    docs = _docs(spark, rows).repartition(shuffle)
    groups: dict = {}
    for doc, text, source, lang, n in rows:
        now = None if text is None else text.replace("\n", "")
        groups.setdefault(source, []).append((-1 if doc is None else doc, _leaf(doc, source, lang, n, text), _leaf(doc, source, lang, n, now)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _plain_tree([h for _, h, _ in sorted(groups[s])]) for s in order}
    root, tops = _plain_tree([trees[s][0] for s in order])
    want = []
    for s, top in zip(order, tops, strict=True):
        for (doc, leaf, now), way in zip(sorted(groups[s]), trees[s][1], strict=True):
            for left, right in way + top:
                now = _sha(left + now + right)
            want.append((None if doc < 0 else doc, leaf, trees[s][0], root, _sha("".join(a + b for a, b in way + top)), now, now == root))
    found = merkle.verify(docs, {"text": F.replace("text", F.lit("\n"), F.lit(""))})
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("proof")), "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_of_no_and_one_row(spark):
    docs = _docs(spark, [(1, "t", None, None, 1)])
    assert merkle.manifest(docs.limit(0)).count() == 0
    (row,) = merkle.manifest(docs).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == _leaf(1, None, None, 1, "t")
    assert row["proof"] == []


def test_numbers_of_hot_group(spark):
    """A group that holds nearly all rows, and copies of one row, are numbered without gaps."""
    rows = spark.range(5000).select((F.col("id") % 7).alias("doc_id"), F.when(F.col("id") < 4900, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id")
    got = merkle.numbered(rows.repartition(9), "g", ["doc_id", "id"]).filter("g = 'hot'").orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(4900))
    assert [(r["doc_id"], r["id"]) for r in got] == sorted((r["doc_id"], r["id"]) for r in got)
    assert {r["n"] for r in got} == {4900}


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain_spans(text: str) -> list:
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            check = sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and check, "phone": 8 <= len(d) <= 15}[kind]:
                out.append((list(PLAIN).index(kind), *m.span()))
    return out


def test_base_spans_by_plain_patterns():
    r = random.Random(3)
    alphabets = ["a@.b-1_", "0123456789.", "0123456789- ", "+0123456789 ().-", "a@.1+ é(", "4 -1+.@a9"]
    for k in range(6000):
        text = "".join(r.choices(alphabets[k % len(alphabets)], k=r.randrange(0, 70)))
        assert pii.base_spans(text)[0] == _plain_spans(text), text
    assert pii.base_spans("4111 1111 1111 1111")[0] == [(2, 0, 19)]
    long = "a" * 300_000 + " " + "1." * 200_000 + "+" * 200_000 + "9 " * 200_000 + "x@y.z"
    assert pii.base_spans(long)[0][:1] == [(0, len(long) - 5, len(long))]


def test_candidates_of_long_texts_are_linear():
    for text in ("1 " * 100_000, "a at " * 50_000, "a.b " * 50_000 + "x at y", "+(" * 100_000, "1:" * 100_000, "@" * 100_000):
        assert len(pii.candidates(text, [])) <= 20 * len(text)


@pytest.fixture(scope="module")
def model(spark):
    words = "the of and tion ere las dos uni web mail anna team sun river".split()
    r = random.Random(1)
    docs = [(k, " ".join(r.choices(words, k=80)), "s", "en", 1) for k in range(300)]
    return pii.learn(_docs(spark, docs), most=3000)


def test_added_spans_on_other_passages(model):
    """Values and look-alikes in passages the model has not seen: every kind is found, and clean texts stay clean."""
    r = random.Random(99)
    words = "plus encore jardin schule nicht casa perro blue green under".split()
    right, found, good = 0, 0, 0
    for seed in range(1_000_000, 1_001_500):
        text, spans, _ = pii.written(" ".join(r.choices(words, k=30)), seed)
        base, bad = pii.base_spans(text)
        want = set(spans) - set(base)
        got = set(model.spans(text, base, bad))
        right, found, good = right + len(want), found + len(got), good + len(got & want)
    assert good / right > 0.95
    assert good / found > 0.95


@pytest.mark.parametrize(("text", "want"), [
    ("Contact john dot smith at example dot com now", {"john dot smith at example dot com"}), ("call (555) 123-4567 today", {"(555) 123-4567"}), ("cards 4111111111111111 5500005555555559 here", {"4111111111111111", "5500005555555559"}),
    ("reach +1 (555) 123-4567 10.0.0.1 here", {"+1 (555) 123-4567"}), ("order 4111 1111 1111 1112 shipped", set()), ("we met at home. The next day", set()), ("on 2024-01-02 at 12:34:56", set()), ("version 10.2.300.4 is out", set()),
])
def test_added_spans(model, text, want):
    base, bad = pii.base_spans(text)
    assert {text[a:b] for _, a, b in model.spans(text, base, bad)} == want


def test_find_and_redact(spark, model):
    rows = [(1, "mail a.b@c.de or 10.0.0.1, 4111 1111 1111 1111, +1 (555) 123-4567", "s", "en", 1), (2, None, None, None, None), (3, "", "s", "en", 0), (3, "", "s", "en", 0), (None, "é x@y.org", "s", "en", 1), (4, "clean words " * 20_000, "s", "en", 1)]
    docs = _docs(spark, rows)
    got = pii.find(docs, model).collect()
    assert len(got) == len(rows)
    spans = {r["doc_id"]: [(s["kind"], r["text"][s["start"] : s["end"]], s["base"]) for s in r["spans"]] for r in got}
    assert spans[1] == [("email", "a.b@c.de", True), ("ip", "10.0.0.1", True), ("card", "4111 1111 1111 1111", True), ("phone", "+1 (555) 123-4567", True)]
    assert spans[None] == [("email", "x@y.org", True)]
    assert spans[2] == spans[3] == spans[4] == []
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs, model).select(*docs.columns).collect()}
    assert clean[1] == "mail [EMAIL] or [IP], [CARD], [PHONE]"
    assert clean[2] is None
    assert clean[4] == rows[5][1]
    assert pii.find(docs.limit(0), model).count() == 0


def test_learning_from_nothing(spark):
    model = pii.learn(_docs(spark, [(1, None, None, None, None)]), most=400)
    base, bad = pii.base_spans("no data")
    assert model.spans("no data", base, bad) == []


def test_personal_data_query(spark, tmp_path):
    """The query's digests of base spans against plain patterns, and nothing but base spans and what was added in its list."""
    from wavemill.llm import queries

    values = ["a.b@c.de", "10.0.0.1", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 123-4567", "jane at corp dot org", "word", "2024-01-02"]
    r = random.Random(8)
    clean = "the of and tion ere las dos uni web mail anna team sun river".split()
    rows = [(k, " ".join(r.choices(clean, k=60) + (r.choices(values, k=3) + r.choices(clean, k=5) if k % 4 == 0 else [])), "s", "en", 1) for k in range(400)] + [(900, None, None, None, None), (901, "", "s", "en", 0)]
    _docs(spark, rows).drop("spans").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op12_personal_data(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for doc, text, *_ in rows:
        base = _plain_spans(text or "")
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert got[doc]["base_sha256"] == _sha(",".join(listed))
        assert [got[doc][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == n for s in base) for n in range(4)]
        spans = got[doc]["spans"].split(",") if got[doc]["spans"] else []
        assert set(listed) <= set(spans)
        assert len(spans) == len(base) + got[doc]["n_added"]
    assert sum(r["n_added"] for r in got.values()) > 20
