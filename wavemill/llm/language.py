"""Language ID with a blended-spectrum string kernel.

k(x, z) is the mean over n = 1..3 of |S_n(x) & S_n(z)| / sqrt(|S_n(x)| |S_n(z)|), where S_n holds the distinct n-grams of
a text's letters. LANDMARKS training texts span a Nystroem feature space, in which one-versus-rest kernel ridge regression
is fitted. The scores of a batch of texts are then two matrix products: n-gram presence by landmarks, kernel by classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import crc_mod, per_worker, small_batches, texts

NGRAMS = (1, 2, 3)
#: Bounds of the fit: training texts of a language, and landmarks among all of them (one a language where there are more languages).
TEXTS_A_LANGUAGE = 200
LANDMARKS = 256
RIDGE = 1e-3
SHARPNESS = 6.0
UNKNOWN = "und"


class _Letters:
    """Letters of a text as code points, in lower case, with a 0 where anything else parts them."""

    def __init__(self):
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def __call__(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        c = np.where(self.letter[c], c, 0)
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
        return np.concatenate([[0], c[keep], [0]])


def spectra(c: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct n-grams for each n, as integers of 21 bits a letter; of single letters without the gap."""
    one = np.unique(c)
    two = np.unique(c[:-1] << 21 | c[1:])
    three = np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:]) if len(c) > 2 else np.zeros(0, np.int64)
    return [one[one > 0], two[two > 0], three]


class _Model:
    def __init__(self, languages: list[str], vocabulary: list[np.ndarray], landmarks: np.ndarray, weights: np.ndarray):
        self.languages, self.vocabulary, self.landmarks, self.weights = languages, vocabulary, landmarks, weights
        self.base = np.concatenate([[0], np.cumsum([len(v) for v in vocabulary])])

    def presence(self, sets: list[list[np.ndarray]]) -> np.ndarray:
        """A row for each text: 1 / (n-gram lengths * sqrt of the set's size) at the vocabulary's n-grams that it has."""
        out = np.zeros((len(sets), self.base[-1]), np.float32)
        for row, own in zip(out, sets, strict=True):
            for base, known, s in zip(self.base, self.vocabulary, own, strict=False):
                if len(s) and len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    row[base + at[known[at] == s]] = 1 / (len(NGRAMS) * np.sqrt(len(s)))
        return out

    def scores(self, sets: list[list[np.ndarray]]) -> np.ndarray:
        kernel = self.presence(sets) @ self.landmarks
        return np.hstack([kernel, np.ones((len(kernel), 1), np.float32)]) @ self.weights


def fit(sample: list[tuple[str, str]], landmarks: int = LANDMARKS) -> _Model:
    """A model of (text, language) pairs; landmarks are dealt out over the languages in turn, and every language has one."""
    letters = _Letters()
    languages = sorted({lang for _, lang in sample})
    landmarks = max(landmarks, len(languages))
    sets = [spectra(letters(text)) for text, _ in sample]
    label = np.asarray([languages.index(lang) for _, lang in sample])
    turn = np.zeros(len(sample), int)
    for k in range(len(languages)):
        turn[label == k] = np.arange((label == k).sum())
    chosen = np.lexsort((label, turn))[:landmarks]
    vocabulary = [np.unique(np.concatenate([sets[i][n] for i in chosen])) if len(chosen) else np.zeros(0, np.int64) for n in range(len(NGRAMS))]
    model = _Model(languages, vocabulary, np.zeros((0, 0)), np.zeros((0, 0)))
    model.landmarks = np.ascontiguousarray(model.presence([sets[i] for i in chosen]).T) * len(NGRAMS)
    kernel = model.presence(sets).astype(np.float64) @ model.landmarks
    values, vectors = np.linalg.eigh(kernel[chosen])
    root = vectors * (1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    features = np.hstack([kernel @ root, np.ones((len(sample), 1))])
    share = np.bincount(label, minlength=len(languages))
    weight = (len(sample) / (len(languages) * share))[label][:, None]
    target = np.where(label[:, None] == np.arange(len(languages)), 1.0, -1.0)
    solved = np.linalg.solve(features.T @ (weight * features) + RIDGE * len(sample) * np.eye(features.shape[1]), features.T @ (weight * target))
    model.weights = np.vstack([root @ solved[:-1], solved[-1:]]).astype(np.float32)
    return model


def training_sample(train: DataFrame, texts_a_language: int = TEXTS_A_LANGUAGE) -> list[tuple[str, str]]:
    """At most about twice texts_a_language (text, lang) rows of each language, picked by a hash, then cut to that many distinct texts. A count of rows a language reaches the driver first."""
    known = train.filter("lang is not null and text is not null").filter(F.col("text").rlike(r"\p{L}"))
    share = {r["lang"]: min(1.0, 2 * texts_a_language / r["count"]) for r in known.groupBy("lang").count().collect()}
    if not share:
        return []
    limit = F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col("lang")]
    at = F.pmod(F.xxhash64(F.lit(11), "doc_id", F.length("text")), F.lit(1_000_003)) / 1_000_003
    rows = known.withColumn("at", at).filter(F.col("at") < limit).select("at", "lang", "text").collect()
    taken, out = {}, []
    for r in sorted(rows, key=lambda r: (r["at"], r["lang"], r["text"])):
        own = taken.setdefault(r["lang"], set())
        if len(own) < texts_a_language and r["text"] not in own:
            own.add(r["text"])
            out.append((r["text"], r["lang"]))
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_out: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred and score (the predicted language's share of the softmax of all scores).

    Fitted on at most TEXTS_A_LANGUAGE texts of each language, among documents whose crc32(doc_id) mod folds isn't held_out
    and whose lang isn't null. Null texts and texts without a letter are `und` with score 0; so is every text where nothing
    could be learned. Rows without a doc_id count as held out. Repeated rows each give a row; whole texts are read; other
    columns are not.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out_of_fit = F.coalesce(crc_mod(F.col(id_col), folds) == held_out, F.lit(True))
    own = texts(docs, id_col, text_col, F.col(lang_col).cast("string").alias("lang"), out_of_fit.alias("held_out"))
    sample = training_sample(own.filter("not held_out"))
    model = spark.sparkContext.broadcast(fit(sample) if sample else None)  # bounded by the landmarks' n-grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, m = per_worker("letters", _Letters), model.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 250):
                b = whole.slice(lo, 250)
                found = [letters(t) if t else None for t in b.column("text").to_pylist()]
                real = [k for k, c in enumerate(found) if m and c is not None and c.any()]
                pred, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
                if real:
                    raw = SHARPNESS * m.scores([spectra(found[k]) for k in real]).astype(np.float64)
                    p = np.exp(raw - raw.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    for k, best, row in zip(real, p.argmax(axis=1).tolist(), p, strict=True):
                        pred[k], score[k] = m.languages[best], row[best]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(pred), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return own.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
