"""Benchmark decontamination with a positional inverted index that is split by documents.

`build_index` stores segments: each holds the whole postings of some documents, that is, for every term the ascending
positions of its occurrences. `match_phrases` and `match_near` take test items as a table of windows: where there are few,
every segment meets all; else a window goes, by a join, to the segments that hold its rarest term of all documents. There,
from the postings of the terms that are asked for, the offset-adjusted lists are intersected from the rarest on. Nothing of the
index passes through the driver, no more than a bounded number of windows do, and building it shuffles no text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import mark, materialise, small_batches, texts, utf8

WINDOW = 10
#: Bytes of text in a segment, but for the document that ends it.
SEGMENT_BYTES = 2 << 20
#: About so many windows at most meet a segment at once; of more, a segment takes part after part. As many, of so many bytes, are sent to all tasks.
WINDOWS_A_PART, WINDOWS_BYTES = 200_000, 32 << 20
#: 0-9, a-z, A-Z (in lower case) and every byte of a non-ASCII character make words; all else parts them.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SEGMENTS = "segment long, doc_ids array<long>, marks array<long>, n_words array<long>, terms binary, counts binary, positions binary"
MATCHES = "segment long, place int, item_id long, n_hit int, hits binary"


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of all documents. Position p of a segment is a word; one position is left free after each document, so that no phrase runs into the next."""
    small_batches(docs.sparkSession)

    def segment(number: int, ids: list, marks: list[int], lists: list[list[bytes]]) -> pa.RecordBatch:
        term_of: dict[bytes, int] = {}
        n = np.asarray([len(x) for x in lists], np.int64)
        flat = np.fromiter((term_of.setdefault(w, len(term_of)) for x in lists for w in x), np.int32, int(n.sum()))
        place = np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)
        order = np.argsort(flat, kind="stable")
        counts = np.bincount(flat, minlength=len(term_of)).astype("<u4")
        row = [number], [ids], [marks], [n.tolist()], [b" ".join(term_of)], [counts.tobytes()], [place[order].astype("<u4").tobytes()]
        types = pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["segment", "doc_ids", "marks", "n_words", "terms", "counts", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, marks, lists, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        for b in batches:
            for doc_id, own, text in zip(b.column("doc_id").to_pylist(), b.column("mark").to_pylist(), utf8(b.column("text")), strict=True):
                ids.append(doc_id)
                marks.append(own)
                lists.append(words(text))
                size += len(text or b"")
                if size >= SEGMENT_BYTES:
                    yield segment(number, ids, marks, lists)
                    number, ids, marks, lists, size = number + 1, [], [], [], 0
        if ids:
            yield segment(number, ids, marks, lists)

    return texts(docs, id_col, text_col, mark(text_col)).mapInArrow(run, SEGMENTS)


class _Postings:
    """The postings of a segment, for the terms asked for."""

    def __init__(self, terms: bytes, counts: bytes, positions: bytes, wanted: dict[bytes, int]):
        n = np.frombuffer(counts, "<u4").astype(np.int64)
        ends = np.cumsum(n)
        data = np.frombuffer(positions, "<u4")
        names = terms.split(b" ") if terms else []
        self.lists = {wanted[t]: data[ends[k] - n[k] : ends[k]] for k, t in enumerate(names) if t in wanted}

    def phrase(self, terms: list[int]) -> np.ndarray:
        """Positions at which the terms follow each other: lists are intersected from the rarest on."""
        order = sorted(range(len(terms)), key=lambda k: len(self.lists[terms[k]]))
        first = order[0]
        starts = self.lists[terms[first]].astype(np.int64) - first
        starts = starts[starts >= 0]
        for k in order[1:]:
            if not len(starts):
                break
            other = self.lists[terms[k]]
            at = np.searchsorted(other, starts + k)
            starts = starts[other[np.minimum(at, len(other) - 1)] == starts + k]
        return starts

    def near(self, terms: list[int], slop: int, begin: np.ndarray) -> np.ndarray:
        """Positions of the rarest term that have every other term at most slop positions away in the same document; begin: where documents begin."""
        order = sorted(set(terms), key=lambda t: len(self.lists[t]))
        at = self.lists[order[0]].astype(np.int64)
        for t in order[1:]:
            other = self.lists[t].astype(np.int64)
            doc = np.searchsorted(begin, at, "right")
            k = np.searchsorted(other, np.maximum(at - slop, begin[doc - 1]))
            end = np.append(begin, np.iinfo(np.int64).max)[doc]
            at = at[(k < len(other)) & (other[np.minimum(k, len(other) - 1)] <= np.minimum(at + slop, end - 1))]
        return at


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(item_id, terms array<binary>): every run of width words of an item; of an item of fewer words, but not none, the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = [], []
            for item, text in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), strict=True):
                found = words(text)
                own = [found[k : k + width] for k in range(max(1, len(found) - width + 1))] if found else []
                ids += [item] * len(own)
                lists += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.binary()))], ["item_id", "terms"])

    return texts(items, id_col, text_col).mapInArrow(run, "item_id long, terms array<binary>").distinct()


def _terms(index: DataFrame) -> DataFrame:
    """(segment, h, n): hashes of the terms of every segment, and how often it holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for segment, terms, counts in zip(*(b.column(c).to_pylist() for c in ("segment", "terms", "counts")), strict=True):
                names = terms.split(b" ") if terms else []
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), segment)), pa.array(h), pa.array(np.frombuffer(counts, "<u4").astype(np.int64))], ["segment", "h", "n"])

    return index.select("segment", "terms", "counts").mapInArrow(run, "segment long, h long, n long")


def _routed(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(segment, part, asked): the windows (item_id, terms) for each segment that holds their rarest term; windows with a term that no document holds are dropped. Hashes of terms only route: the search compares the terms."""

    @F.arrow_udf("array<bigint>")
    def hashed(terms: pa.Array) -> pa.Array:
        lists = [np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)).view(np.int64) for own in terms.to_pylist()]
        return pa.array(lists, pa.list_(pa.int64()))

    asked = materialise(asked.withColumn("hashes", hashed("terms")), "hashed")
    parts = max(1, -(-asked.count() // WINDOWS_A_PART))
    vocabulary = asked.select(F.explode("hashes").alias("h")).distinct()
    held = materialise(_terms(index).join(vocabulary, "h"), "held")
    times = held.groupBy("h").agg(F.sum("n").alias("n"))
    key = asked.select("item_id", "terms", F.xxhash64("item_id", "terms").alias("w"), F.size(F.array_distinct("hashes")).alias("distinct"), F.explode(F.array_distinct("hashes")).alias("h"))
    rarest = key.join(times, "h").groupBy("w", "item_id", "terms", "distinct").agg(F.count("*").alias("known"), F.min(F.struct("n", "h")).alias("rarest"))
    anchored = rarest.filter("known = distinct").select("item_id", "terms", F.pmod("w", F.lit(parts)).alias("part"), F.col("rarest.h").alias("h"))
    met = held.select("segment", "h").join(anchored, "h")
    return met.groupBy("segment", "part").agg(F.collect_list(F.struct("item_id", "terms")).alias("asked"))


def _found(s: dict, postings: _Postings, rows: list[tuple[int, list[int]]], slop: int | None) -> pa.RecordBatch:
    """MATCHES of a segment for windows (item_id, terms) whose terms it has."""
    n = np.asarray(s["n_words"], np.int64)
    begin = np.cumsum(n + 1) - n - 1
    hits: dict[tuple[int, int], set] = defaultdict(set)
    for item, terms in rows:
        starts = postings.phrase(terms) if slop is None else postings.near(terms, slop, begin)
        for doc, at in zip((np.searchsorted(begin, starts, "right") - 1).tolist(), starts.tolist(), strict=True):
            hits[doc, item].update(range(at - int(begin[doc]), at - int(begin[doc]) + (len(terms) if slop is None else 1)))
    out = [(s["segment"], d, item, len(h), np.asarray(sorted(h), "<u4").tobytes()) for (d, item), h in hits.items()]
    columns = [pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, ["segment", "place", "item_id", "n_hit", "hits"])


def _search(index: DataFrame, asked: DataFrame, slop: int | None) -> DataFrame:
    """MATCHES of the windows asked for: per document and item the bitmap of words that an occurrence covers (phrases), or that are the
    anchor of one (slop given). Windows of a counted, small number and size are sent to all tasks; more go by _routed(). Results are the same."""
    asked = materialise(asked, "windows")
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda acc, t: acc + F.length(t))
    count, total = asked.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = index.select("segment", "n_words", "terms", "counts", "positions")
    if count <= WINDOWS_A_PART and total <= WINDOWS_BYTES:
        wanted: dict[bytes, int] = {}
        rows = [(r.item_id, [wanted.setdefault(bytes(t), len(wanted)) for t in r.terms]) for r in asked.collect()]
        sent = index.sparkSession.sparkContext.broadcast((wanted, rows))

        def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted, rows = sent.value
            matrix = np.full((len(rows), max((len(t) for _, t in rows), default=1)), len(wanted), np.int64)
            for i, (_, t) in enumerate(rows):
                matrix[i, : len(t)] = t
            for b in batches:
                for s in b.to_pylist():
                    postings = _Postings(s["terms"], s["counts"], s["positions"], wanted)
                    present = np.zeros(len(wanted) + 1, bool)
                    present[[*postings.lists, len(wanted)]] = True
                    yield _found(s, postings, [rows[i] for i in np.flatnonzero(present[matrix].all(axis=1))], slop)

        return parts.mapInArrow(few, MATCHES)

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                wanted: dict[bytes, int] = {}
                rows = [(w["item_id"], [wanted.setdefault(t, len(wanted)) for t in w["terms"]]) for w in s["asked"]]
                postings = _Postings(s["terms"], s["counts"], s["positions"], wanted)
                yield _found(s, postings, [r for r in rows if all(t in postings.lists for t in r[1])], slop)

    return parts.join(_routed(index, asked), "segment").drop("part").mapInArrow(many, MATCHES)


def match_phrases(index: DataFrame, asked: DataFrame) -> DataFrame:
    return _search(index, asked, None)


def match_near(index: DataFrame, asked: DataFrame, slop: int) -> DataFrame:
    return _search(index, asked, slop)


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256 (of the sorted
    item ids, joined by commas; of nothing if there is none), contaminated (n_hit > 0) and mark (64 bits of the text).

    Null and empty texts have no words; items without words have no windows; items with a null id are left out. Repeated
    documents each give a row, repeated items count once, an empty table of either kind gives no hits. Other columns are not
    read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    index = materialise(build_index(docs, id_col, text_col), "index")
    matches = materialise(match_phrases(index, windows(items.filter(F.col(item_col).isNotNull()), item_col, item_text_col, width)), "matches")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(np.unique(np.concatenate([np.frombuffer(h, "<u4") for h in hs]))) for hs in b.column("hits").to_pylist()]
            ids = [sorted({str(i) for i in x}) for x in b.column("items").to_pylist()]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("segment"), b.column("place"), pa.array(n, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(sha)], ["segment", "place", "n_hit", "n_items", "items_sha256"])

    of_doc = matches.groupBy("segment", "place").agg(F.collect_list("hits").alias("hits"), F.collect_list("item_id").alias("items"))
    of_doc = of_doc.mapInArrow(merge, "segment long, place int, n_hit long, n_items long, items_sha256 string")
    every = index.select("segment", F.posexplode(F.arrays_zip("doc_ids", "marks", "n_words")).alias("place", "d")).select("segment", "place", "d.*")
    out = every.join(of_doc, ["segment", "place"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("doc_ids").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.col("marks").alias("mark"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has no window of an item; rows are told apart by doc_id and text. The columns are those of docs."""
    bad = contamination(docs, items, id_col=id_col, text_col=text_col).filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    own = docs.withColumn("__own", mark(text_col))
    return own.join(bad, F.col(id_col).cast("long").eqNullSafe(bad["__id"]) & (own["__own"] == bad["__mark"]), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
