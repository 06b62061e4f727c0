"""Language ID against the kernel, its Nystroem features and the regression written out, and inputs that break rules of thumb."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import common, decontaminate, language, toxicity

DOCS = "doc_id long, text string, lang string, source string, held_out string, score string"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], DOCS)


def _grams(text: str) -> list:
    """Distinct letters, pairs and triples of a text; what isn't a letter is one gap, and there is one at either end."""
    out = [""]
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif out[-1]:
            out.append("")
    out += [] if len(out) > 1 and not out[-1] else [""]
    return [{c for c in out if c}, {(a, b) for a, b in zip(out, out[1:]) if a or b}, set(zip(out, out[1:], out[2:]))]


def _kernel(x: list, z: list) -> float:
    return sum(len(a & b) / math.sqrt(len(a) * len(b)) for a, b in zip(x, z, strict=True) if a and b) / 3


def _plain(sample: list, asked: list) -> list:
    languages = sorted({lang for _, lang in sample})
    own = [(_grams(text), lang) for text, lang in sample]
    turns = {lang: [k for k, (_, x) in enumerate(own) if x == lang] for lang in languages}
    order = [turns[lang][t] for t in range(len(own)) for lang in languages if t < len(turns[lang])][: max(256, len(languages))]
    landmarks = [own[k][0] for k in order]
    inner = np.array([[_kernel(a, b) for b in landmarks] for a in landmarks])
    values, vectors = np.linalg.eigh(inner)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    feature = lambda grams: [*(np.array([_kernel(grams, z) for z in landmarks]) @ root), 1.0]
    x = np.array([feature(g) for g, _ in own])
    w = np.diag([len(own) / (len(languages) * len(turns[lang])) for _, lang in own])
    y = np.array([[1.0 if lang == other else -1.0 for other in languages] for _, lang in own])
    beta = np.linalg.solve(x.T @ w @ x + 1e-3 * len(own) * np.eye(x.shape[1]), x.T @ w @ y)
    out = []
    for text in asked:
        grams = _grams(text or "")
        if not grams[0]:
            out.append(("und", 0.0))
            continue
        p = np.exp(language.SHARPNESS * (np.array(feature(grams)) @ beta))
        out.append((languages[int(p.argmax())], float(p.max() / p.sum())))
    return out


def test_language_by_brute_force(spark):
    r = random.Random(2)
    words = {"aa": "the and with from over under house".split(), "bb": "der und mit von über haus straße".split(), "cc": "el los con niño casa señor ñandú".split(), "dd": "дом и над под из улица".split()}
    rows = [(k, " ".join(r.choices(words[lang], k=r.randrange(1, 9))) + r.choice(["", "!", " 12", "\n"]), lang) for k in range(110) for lang in [sorted(words)[k % 4]]]
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "123 !?", "cc"), (203, "haus und " * 30_000, "bb"), (7, rows[7][1], rows[7][2]), (204, "the house", None), (None, "los niños", "cc")]
    docs = _docs(spark, rows)
    fit = docs.filter("doc_id is not null").withColumn("out", F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2).filter("not out")
    sample = language.training_sample(fit.select("doc_id", "text", "lang"))
    assert 40 < len(sample) < 110
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    want = dict(zip([(r[0], r[1]) for r in rows], _plain(sample, [r[1] for r in rows]), strict=True))
    by = {(x.doc_id, x.held_out): x for x in got}
    for doc, text, _ in rows:
        pred, score = want[doc, text]
        x = next(v for (d, _), v in by.items() if d == doc)
        assert x.lang_pred == pred
        assert x.score == pytest.approx(score, abs=2e-3)
    assert {x.doc_id for x in got if x.lang_pred == "und"} == {200, 201, 202}


def test_language_without_rows_and_with_many_languages(spark):
    assert language.identify(_docs(spark, [(1, "text", "aa")]).limit(0)).count() == 0
    assert [x.lang_pred for x in language.identify(_docs(spark, [(1, "text", None), (2, None, None)])).collect()] == ["und", "und"]
    model = language.fit([(chr(0x4E00 + k) * 3, f"l{k:03}") for k in range(300)], landmarks=10)
    assert model.landmarks.shape[1] == 300


def test_toxicity_of_long_repeated_and_no_rows(spark):
    lexicon = {"vile*": 9.0, "rotten": 7.0}
    rows = [(1, "clean word " * 50_000, "aa"), (2, "clean word " * 50_000 + "v1lest", "aa"), (3, "so vile", "aa"), (3, "so vile", "aa"), (None, "rotten", "aa"), (4, None, None), (5, "", None)]
    got = toxicity.score(_docs(spark, rows), lexicon, ["rotten tomato"], 4.0, 0.5).collect()
    assert len(got) == len(rows)
    plain = lambda n, hits, weight: 1 / (1 + math.exp(-4 * (hits * weight / math.log(math.e + n) - 0.5)))
    want = {1: plain(100_000, 0, 9), 2: plain(100_001, 1, 9), 3: plain(2, 1, 9), None: plain(1, 1, 7), 4: plain(0, 0, 9), 5: plain(0, 0, 9)}
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id])
        assert r.predicted == (r.score >= 0.5)
    assert toxicity.score(_docs(spark, rows).limit(0), lexicon, [], 4.0, 0.5).count() == 0
    lexicon, exceptions, slope, middle = toxicity.learn(_docs(spark, rows).limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert (lexicon, exceptions) == ({}, [])


@pytest.mark.parametrize("part", [200_000, 3])
def test_windows_of_many_parts(spark, monkeypatch, part):
    """Windows reach segments by their rarest term, also where they take several parts, against a search of every place."""
    monkeypatch.setattr(decontaminate, "WINDOWS_A_PART", part)
    monkeypatch.setattr(decontaminate, "SEGMENT_BYTES", 400)
    r = random.Random(part)
    vocabulary = [f"w{k}" for k in range(12)]
    docs = [(k, " ".join(r.choices(vocabulary, k=r.randrange(0, 60))), None) for k in range(40)] + [(50, None, None), (51, "", None), (52, "only w1 w2 w3 here " * 200, None)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randrange(0, 6)))) for k in range(30)] + [(99, "absent w1 w2"), (98, None), (None, "w1"), (0, "w1 w1")]
    found = decontaminate.contamination(_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string"), width=3).collect()
    assert len(found) == len(docs)
    texts = {d: (t or "").split() for d, t, _ in docs}
    for row in found:
        own, hit, of = texts[row.doc_id], set(), set()
        for item, text in items:
            words = (text or "").split()
            for k in range(max(1, len(words) - 2)) if words and item is not None else ():
                window = words[k : k + 3]
                for at in range(len(own) - len(window) + 1):
                    if own[at : at + len(window)] == window:
                        hit |= set(range(at, at + len(window)))
                        of.add(item)
        assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (len(own), len(hit), len(of), bool(hit))


def test_clean_takes_scratch_away(spark):
    import os

    table = common.materialise(spark.range(5), "kept")
    path = common._SCRATCH[spark.sparkContext.applicationId][-1].removeprefix("file://")
    assert table.count() == 5
    assert os.path.isdir(path)
    assert common.clean(spark) >= 1
    assert not os.path.isdir(path)
    assert common.clean(spark) == 0
