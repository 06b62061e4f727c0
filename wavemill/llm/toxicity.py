"""Toxicity by a weighted lexicon.

Texts are folded (lower case, look-alike characters, accents, digit and symbol substitutions inside words), cut into words
and searched in one Aho-Corasick pass for all lexicon entries and exception phrases at once. An entry is a whole word or a
stem that begins a word; a hit inside an exception phrase doesn't count. The weights of the hits, normalised by the length
of the text, go through a logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import crc_mod, join_small, materialise, small_batches, texts

#: Letters of other scripts that look like Latin ones (fixed values).
LOOK_ALIKE = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ё": "e", "ї": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c", "ı": "i", "ſ": "s", "ɑ": "a", "ɡ": "g", "ℓ": "l",
}
#: Characters that stand for letters inside words (fixed values).
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}
INVISIBLE = "­​‌‍⁠﻿"
#: Bounds of the fit: entries of the lexicon, and documents of each label that lexicon and curve are fitted on.
MAX_ENTRIES = 20_000
ROWS_A_LABEL = 10_000
STEM_LENGTHS = (4, 5, 6, 7, 8)

_MIXED = re.compile(r"[^\W\d_][0-9]|[0-9][^\W\d_]")
_WITH_DIGIT = re.compile(r"[^\W_]*[0-9][^\W_]*")
_INNER = re.compile(r"(?<=[^\W\d_])[@$!|€]+(?=[^\W\d_])")
_HAS_SYMBOL = re.compile(r"[@$!|€]")
_WORD = re.compile(r"[^\W\d_]+")


def _folding() -> dict[int, str | None]:
    fold: dict[int, str | None] = {ord(c): None for c in INVISIBLE}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D6A4)]:
        base = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
        if base != chr(c) and base:
            fold[c] = base
    return fold | {c: None for c in range(0x300, 0x370)} | {ord(k): v for k, v in LOOK_ALIKE.items()}


_FOLD = _folding()
_DIGITS, _SYMBOLS = str.maketrans(DIGITS), str.maketrans(SYMBOLS)


def _spelled(m: re.Match) -> str:
    word = m[0]
    return word.translate(_DIGITS) if any(c.isalpha() for c in word) else word


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    if _HAS_SYMBOL.search(text):
        text = _INNER.sub(lambda m: m[0].translate(_SYMBOLS), text)
    if _MIXED.search(text):
        text = _WITH_DIGIT.sub(_spelled, text)
    return text


def folded_words(text: str | None) -> list[str]:
    return _WORD.findall(fold(text)) if text else []


class Matcher:
    """lexicon: entry -> weight; an entry that ends in `*` is a stem."""

    def __init__(self, lexicon: dict[str, float], exceptions: Iterable[str] = ()):
        self.find = ahocorasick.Automaton()
        for phrase in exceptions:
            key = f" {' '.join(folded_words(phrase))} "
            self.find.add_word(key, (len(key), None, key))
        for entry, weight in lexicon.items():
            key = f" {entry[:-1]}" if entry[-1] == "*" else f" {entry} "
            if key not in self.find:
                self.find.add_word(key, (len(key), weight, key))
        self.find.make_automaton()

    def around(self, words: Sequence[str]) -> set[tuple[str, str]]:
        """(entry, phrase) of every hit: the hit word with the word before it, and with the word after it."""
        line = f" {' '.join(words)} "
        found = set()
        for end, (n, weight, key) in self.find.iter(line):
            if weight is not None:
                a, b = end - n + 2, line.index(" ", end if key[-1] == " " else end + 1)
                before, after = line.rfind(" ", 0, a - 1) + 1, line.find(" ", b + 1)
                if before < a - 1:
                    found.add((key, line[before:b]))
                if after > 0:
                    found.add((key, line[a:after]))
        return found

    def value(self, words: Sequence[str]) -> float:
        """Weights of all hits outside exceptions, each entry counted with the logarithm of its hits, over the logarithm of the text's length."""
        line = f" {' '.join(words)} "
        found = [(end - n + 1, end, weight, key) for end, (n, weight, key) in self.find.iter(line)] if len(self.find) else []
        if not found:
            return 0.0
        spans = [(a, b) for a, b, weight, _ in found if weight is None]
        hits = Counter(key for a, b, weight, key in found if weight is not None and not any(x <= a and b <= y for x, y in spans))
        weights = {key: weight for _, _, weight, key in found if weight is not None}
        return sum(weights[k] * (1 + math.log(n)) for k, n in hits.items()) / math.log(math.e + len(words))


def _word_counts(rows: DataFrame) -> DataFrame:
    """(word, bad, good): documents of rows (text, toxic) that hold the word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter(), Counter()

        def out() -> pa.RecordBatch:
            words = list(held[0].keys() | held[1].keys())
            columns = [pa.array(words, pa.string()), *(pa.array([held[k][w] for w in words], pa.int64()) for k in (1, 0))]
            for h in held:
                h.clear()
            return pa.RecordBatch.from_arrays(columns, ["word", "bad", "good"])

        for b in batches:
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                held[toxic].update(set(folded_words(text)))
            if len(held[0]) + len(held[1]) > 300_000:
                yield out()
        yield out()

    return rows.mapInArrow(count, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def _entries(by_word: DataFrame) -> DataFrame:
    """The counts of words and of the stems that begin them; a stem's are summed over its words."""
    stems = [F.when(F.length("word") >= n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in STEM_LENGTHS]
    each = by_word.withColumn("entry", F.explode(F.array_compact(F.array("word", *stems))))
    return each.groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter("bad > 0")


def _once(train: DataFrame) -> DataFrame:
    """One row (text, toxic) for the copies of a text: those that share the three smallest hashes of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sketch = [str(sorted(xxhash.xxh3_64_intdigest(w) for w in set(folded_words(t)))[:3]) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("text"), b.column("toxic"), pa.array(sketch, pa.string())], ["text", "toxic", "sketch"])

    sketched = train.select("text", "toxic").mapInArrow(run, "text string, toxic int, sketch string")
    return materialise(sketched.groupBy("sketch", "toxic").agg(F.min("text").alias("text")).select("text", "toxic"), "once")


def learn_exceptions(train: DataFrame, lexicon: dict[str, float], level: float = 0.01) -> list[str]:
    """Phrases of two words, one of them a hit, that clean documents hold far more often than the documents that hit the entry do in
    general: the likelihood ratio is one that chance gives to less than `level` of all candidates, and more documents with the phrase are
    clean than toxic. At most MAX_ENTRIES, those of highest ratio, reach the driver."""
    if not lexicon:
        return []
    sent = train.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value)
        for b in batches:
            rows = [(e, p, t) for x, t in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True) for found in [matcher.around(folded_words(x))] for e, p in found | {(e, "") for e, _ in found}]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32()))], ["entry", "phrase", "toxic"])

    seen = _once(train).mapInArrow(run, "entry string, phrase string, toxic int").groupBy("entry", "phrase").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    seen = materialise(seen, "phrases")
    whole = seen.filter("phrase = ''").select("entry", (F.col("bad") / F.col("all")).alias("share"))
    p, q = F.col("bad") / F.col("all"), F.greatest(F.least(F.col("share"), F.lit(1 - 1e-3)), F.lit(1e-3))
    part = lambda n, x, y: F.when(n > 0, n * F.log(x / y)).otherwise(0.0)
    ratio = 2 * (part(F.col("bad"), p, q) + part(F.col("all") - F.col("bad"), 1 - p, 1 - q))
    least = 2 * math.log(max(2, seen.count()) / level)
    good = seen.filter("phrase <> '' and 2 * bad < all").join(whole, "entry").withColumn("ratio", ratio).filter((p < q) & (F.col("ratio") >= least))
    return sorted({r.phrase for r in good.orderBy(F.desc("ratio"), "phrase").limit(MAX_ENTRIES).collect()})


def learn_lexicon(train: DataFrame, level: float = 0.01, rounds: int = 8) -> dict[str, float]:
    """Weights of words and stems that toxic documents hold far more often than others.

    train: text, toxic (0/1). Copies of a text count once; counts are over all rows given. An entry needs a likelihood ratio that
    chance gives to less than `level` of all candidates, and more toxic documents than clean ones. Each round takes the
    entries with at least a quarter of the best ratio; the next counts only toxic documents that none of them explains, so
    that the other words of a much copied toxic text are not taken for toxic themselves. Of nested stems the longest that
    still has 95 % of the shorter one's toxic documents stays, and entries that a kept stem covers go. At most MAX_ENTRIES
    candidates of a round, those of highest ratio, reach the driver.
    """
    once = _once(train)
    totals = dict(once.groupBy("toxic").count().collect())
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return {}
    entries = materialise(_entries(_word_counts(once)), "entries")
    toxic = materialise(once.filter("toxic = 1"), "toxic")
    least = 2 * math.log(max(2, entries.count()) / level)
    sent = toxic.sparkSession.sparkContext.broadcast
    kept: dict[str, float] = {}
    now = entries
    for _ in range(rounds):
        share = bad / (bad + good)
        both = F.col("bad") + F.col("good")
        ratio = 2 * (F.col("bad") * F.log(F.col("bad") / (both * share)) + F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / (both * (1 - share)))).otherwise(0.0))
        rows = now.filter(F.col("bad") > F.col("good")).withColumn("ratio", ratio).filter(F.col("ratio") >= least).orderBy(F.desc("ratio"), "entry").limit(MAX_ENTRIES).collect()
        found = {r.entry: (r.bad, math.log((r.bad + 0.5) / bad * good / (r.good + 0.5))) for r in rows if r.ratio >= rows[0].ratio / 4}
        if not found:
            break
        for e in sorted(_longest(found), key=len):
            if not any(e[:k] + "*" in kept for k in STEM_LENGTHS if k < len(e) - 1):
                kept[e] = found[e][1]
        for e in found:
            if e[-1] != "*" and not any(e[:k] + "*" in kept for k in STEM_LENGTHS):
                kept[e] = found[e][1]
        known = sent(kept)
        rest = _values(toxic, lambda known=known: Matcher(known.value, ()), "text string, toxic int", ["text", "toxic"]).filter("value = 0").drop("value")
        rest = materialise(rest, "unexplained")
        bad = rest.count()
        if not bad:
            break
        now = _entries(_word_counts(rest)).select("entry", "bad").join(entries.select("entry", "good"), "entry")
    return kept


def _longest(found: dict[str, tuple[int, float]]) -> set[str]:
    """Stems of found without a one letter longer stem that has 95 % of their toxic documents."""
    best: dict[str, int] = {}
    for e, (n, _) in found.items():
        if e[-1] == "*":
            best[e[:-2]] = max(best.get(e[:-2], 0), n)
    return {e for e, (n, _) in found.items() if e[-1] == "*" and best.get(e[:-1], 0) < 0.95 * n}


def fit_curve(values: np.ndarray, toxic: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and middle of a logistic curve, by Newton's steps with a small ridge; without both labels one that calls a value over 0.5 toxic."""
    if len(set(toxic.tolist())) < 2:
        return 4.0, 0.5
    x = np.column_stack([values, np.ones(len(values))])
    w = np.array([1.0, -2.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - toxic) + 1e-3 * w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slope = max(w[0], 1e-3)
    return float(slope), float(-w[1] / slope)


def _values(rows: DataFrame, matcher_of, more: str, kept: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of()
        for b in batches:
            v = [matcher.value(folded_words(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(v, pa.float64())], [*kept, "value"])

    return rows.mapInArrow(run, f"{more}, value double")


def _share(rows: int) -> float:
    return min(1.0, 0.95 * ROWS_A_LABEL / max(1, rows))


def learn(docs: DataFrame, labels: DataFrame, exceptions: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out: int = 0) -> tuple[dict[str, float], list[str], float, float]:
    """(lexicon, exceptions, slope, middle), the exceptions with those given, from at most about ROWS_A_LABEL documents of each label outside the held-out fold, picked by a hash. A document labelled both ways is left out."""
    small_batches(docs.sparkSession)
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(crc_mod(F.col("doc_id"), folds) != held_out)
    own = own.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    held = dict(own.groupBy("toxic").count().collect())
    # the hash leaves a label at most ROWS_A_LABEL rows or so; join_small counts them before it broadcasts
    part = F.when(F.col("toxic") == 1, F.lit(_share(held.get(1, 0)))).otherwise(F.lit(_share(held.get(0, 0))))
    picked = own.filter(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_003)) < 1_000_003 * part)
    train = materialise(join_small(texts(docs, id_col, text_col).filter("text is not null"), picked, "doc_id").filter("toxic is not null").select("text", "toxic"), "train")
    lexicon = learn_lexicon(train)
    exceptions = sorted({*exceptions, *learn_exceptions(train, lexicon)})
    sent = docs.sparkSession.sparkContext.broadcast((lexicon, tuple(exceptions)))
    rows = _values(train, lambda: Matcher(*sent.value), "toxic int", ["toxic"]).collect()  # two numbers for each sampled row
    slope, middle = fit_curve(np.asarray([r.value for r in rows]), np.asarray([r.toxic for r in rows], float))
    return lexicon, exceptions, slope, middle


def score(docs: DataFrame, lexicon: dict[str, float], exceptions: Sequence[str], slope: float, middle: float, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted (1 if score >= 0.5).

    Null, empty and wordless texts have no hits, so they score as any text without one. Rows without a doc_id count as held
    out; repeated rows each give a row; an empty table gives an empty result; other columns are not read. Whole texts are
    searched where they are read; there is no shuffle.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((lexicon, tuple(exceptions)))  # at most MAX_ENTRIES entries
    out_of_fit = F.coalesce(crc_mod(F.col(id_col), folds) == held_out, F.lit(True))
    found = _values(texts(docs, id_col, text_col, out_of_fit.alias("held_out")), lambda: Matcher(*sent.value), "doc_id long, held_out boolean", ["doc_id", "held_out"])
    p = 1 / (1 + F.exp(-slope * (F.col("value") - middle)))
    return found.select("doc_id", "held_out", p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, lexicon: dict[str, float], exceptions: Sequence[str], slope: float, middle: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score under 0.5."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((lexicon, tuple(exceptions)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*sent.value)
        for b in batches:
            found = [matcher.value(folded_words(t)) for t in b.column(text_col).to_pylist()]
            yield b.filter(pa.array([slope * (v - middle) < 0 for v in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
