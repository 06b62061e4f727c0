"""Language-model scoring by cross-entropy difference.

Two bigram models, of a target set and of all documents (the background), share one vocabulary: every word of the table.
Both have the same form (bigram counts, absolute discounting, backing off to add-one unigrams, in which one more token stands
for all unseen ones). A document's score is the mean over its tokens of the loss under the target model less the loss
under the background model: low scores read like the target.

Documents are numbered in blocks. A block sends the hashes of its distinct pairs, packed and dealt to ranges by their upper
bits; where a range's rows meet, counts are summed, and each block gets back the sums of its own pairs, in the order it sent
them. The same is done with words. Ranges grow with the tokens of the table, so what meets in one is bounded at every size,
whatever pair is frequent, and nothing but four sums reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import LOWER, materialise, small_batches, texts, utf8

DISCOUNT = 0.5
#: About so many tokens make a block; twelve bytes of text count as one more.
GATHER = 3_000_000
#: Ranges for as many tokens as make a block.
RANGES = 4
_FAR = 0xFFFF


def words(text: bytes | None) -> list[bytes]:
    """What ASCII white space leaves, with A-Z in lower case."""
    return (text or b"").translate(LOWER).split()


class _Ids(dict):
    """Numbers words within a block as they come; b"" is the start mark, 0."""

    def __init__(self):
        super().__init__({b"": 0})

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        return at

    def of(self, text: bytes | None) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.__getitem__, found), np.uint32, len(found))

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self), np.uint64, len(self))


BLOCKS = "block long, tokens long, doc_ids array<long>, n_tokens binary, target binary, near binary, far binary, words binary"


def encode(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, target) in blocks of about GATHER tokens: the block's documents, its tokens in the block's own numbers (two
    bytes each in near, compressed; those that need more are marked there and follow in far), and the 64-bit hash of every numbered word."""

    gather = GATHER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, rows, size = TaskContext.get().partitionId() << 32, _Ids(), [], 0

        def out() -> pa.RecordBatch:
            flat = np.concatenate([x for _, _, x in rows])
            n = np.asarray([len(x) for _, _, x in rows], "<i8")
            near = np.minimum(flat, _FAR).astype("<u2")
            target = np.asarray([bool(t) for _, t, _ in rows], np.uint8)
            packed = [n.tobytes(), target.tobytes(), pa.compress(near.tobytes(), "zstd", asbytes=True), flat[flat >= _FAR].astype("<u4").tobytes(), ids.hashes().astype("<u8").tobytes()]
            columns = [pa.array([block]), pa.array([len(flat)]), pa.array([[d for d, _, _ in rows]], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in packed)]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCKS.split(", ")])

        for b in batches:
            for d, t, target in zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), b.column("target").to_pylist(), strict=True):
                rows.append((d, target, ids.of(t)))
                size += len(rows[-1][2]) + len(t or b"") // 12
                if size >= gather:
                    yield out()
                    block, ids, rows, size = block + 1, _Ids(), [], 0
        if rows:
            yield out()

    return docs.select("doc_id", "text", "target").mapInArrow(run, BLOCKS)


class _Block:
    """A block with its distinct pairs, in the order of their hashes. pair_of: the pair of each token."""

    def __init__(self, row: dict):
        self.block, self.doc_ids, self.n = row["block"], row["doc_ids"], np.frombuffer(row["n_tokens"], "<i8")
        near = pa.decompress(row["near"], 2 * row["tokens"], "zstd", asbytes=True) if row["tokens"] else b""
        token = np.frombuffer(near, "<u2").astype(np.int64)
        token[token == _FAR] = np.frombuffer(row["far"], "<u4")
        self.hashes = np.frombuffer(row["words"], "<u8")
        before = np.concatenate([[0], token])[: len(token)]
        before[(np.cumsum(self.n) - self.n)[self.n > 0]] = 0
        code, place, n_all = np.unique(before << 32 | token, return_inverse=True, return_counts=True)
        target = np.repeat(np.frombuffer(row["target"], np.uint8), self.n)
        n_target = np.bincount(place, target, len(code)).astype(np.int64)
        h = self.hashes[code >> 32] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[code & 0xFFFFFFFF]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        order = np.argsort(h, kind="stable")
        self.pair_hashes, self.n_all, self.n_target = h[order], n_all[order], n_target[order]
        self.before, self.token = code[order] >> 32, code[order] & 0xFFFFFFFF
        self.pair_of = np.empty(len(order), np.int64)
        self.pair_of[order] = np.arange(len(order))
        self.pair_of = self.pair_of[place]


def _dealt(block: int, bits: int, hashes: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch:
    """One row a range that sorted hashes fall in: block, range, the hashes and their values."""
    cut = np.searchsorted(hashes, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    parts = [np.split(x, cut) for x in (hashes.astype("<u8"), *(v.astype("<u4") for v in values))]
    held = [r for r, x in enumerate(parts[0]) if len(x)]
    columns = [pa.array([block] * len(held), pa.int64()), pa.array(held, pa.int32()), pa.array([parts[0][r].tobytes() for r in held], pa.binary())]
    columns.append(pa.array([np.concatenate([v[r] for v in parts[1:]]).tobytes() for r in held], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["block", "range", "hashes", "counts"])


_DEALT = "block long, range int, hashes binary, counts binary"
_FOUND = "block long, range int, kind int, n int, counts binary, sums array<long>"


def _summed(n_values: int, kind: int):
    """Sums the values of equal hashes in a range and gives each block the sums for what it sent, as n_values 64-bit arrays, then a
    byte each that is 1 for one block of those that sent the hash. The first row has the range's sums: hashes and values."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        hashes = [np.frombuffer(x, "<u8") for x in rows.column("hashes").to_pylist()]
        ends = np.cumsum([len(x) for x in hashes])
        values = np.concatenate([np.frombuffer(x, "<u4").reshape(n_values, -1) for x in rows.column("counts").to_pylist()], axis=1)
        _, first, place = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        total = [np.bincount(place, v).astype("<i8") for v in values]
        flag = np.zeros(ends[-1], np.uint8)
        flag[first] = 1
        counts = [pa.compress(b"".join([*(t[p].tobytes() for t in total), f.tobytes()]), "zstd", asbytes=True) for p, f in zip(np.split(place, ends[:-1]), np.split(flag, ends[:-1]), strict=True)]
        sums = [[len(first), *(int(t.sum()) for t in total)], *[None] * (len(ends) - 1)]
        columns = [rows.column("block"), rows.column("range"), pa.array([kind] * len(ends), pa.int32()), pa.array([len(x) for x in hashes], pa.int32()), pa.array(counts, pa.binary()), pa.array(sums, pa.list_(pa.int64()))]
        return pa.table(columns, ["block", "range", "kind", "n", "counts", "sums"])

    return run


def _returned(found: pa.Table, kind: int, n_values: int) -> list[np.ndarray]:
    """What _summed gave a block, over all ranges: n_values arrays and the flags."""
    own = found.filter(pa.compute.equal(found.column("kind"), kind)).sort_by("range")
    n = own.column("n").to_pylist()
    rows = [pa.decompress(x, k * (8 * n_values + 1), "zstd", asbytes=True) for x, k in zip(own.column("counts").to_pylist(), n, strict=True)]
    values = [np.frombuffer(x, "<i8", n_values * k).reshape(n_values, k) for x, k in zip(rows, n, strict=True)]
    flags = [np.frombuffer(x, np.uint8, k, 8 * n_values * k) for x, k in zip(rows, n, strict=True)]
    return [*np.concatenate([np.zeros((n_values, 0), "<i8"), *values], axis=1), np.concatenate([np.zeros(0, np.uint8), *flags])]


_PAIR, _WORD = 0, 1


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ce_target, ce_background (nats a token) and score (ce_target - ce_background).

    target_ids: (doc_id) of the target set. Texts without words have n_tokens 0 and null losses. An empty target set gives
    the uniform model as target. Rows without a doc_id are background only; repeated rows count and are scored each; an
    empty table gives an empty result. Other columns are not read. Words are told apart by 64 bits of hash, and so are pairs.
    """
    small_batches(docs.sparkSession)
    own = texts(docs, id_col, text_col)
    marked = target_ids.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(True).alias("target")).filter("doc_id is not null").distinct()
    blocks = materialise(encode(own.join(marked.hint("merge"), "doc_id", "left")), "blocks", {"compression": "zstd"})
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    bits = max(1, (RANGES * tokens // GATHER).bit_length())

    def send_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                x = _Block(row)
                yield _dealt(x.block, bits, x.pair_hashes, [x.n_all, x.n_target])

    def send_words(rows: pa.Table, found: pa.Table) -> pa.Table:
        x = _Block(rows.to_pylist()[0])
        _, t_target, flag = _returned(found, _PAIR, 2)
        size = len(x.hashes)
        sides = [(x.before, x.n_all), (x.before, x.n_target), (x.before, flag), (x.before, flag * (t_target > 0)), (x.token, x.n_all), (x.token, x.n_target)]
        order = np.argsort(x.hashes, kind="stable")
        return pa.Table.from_batches([_dealt(x.block, bits, x.hashes[order], [np.bincount(at, v, size)[order] for at, v in sides])])

    pairs = blocks.mapInArrow(send_pairs, _DEALT).groupBy("range").applyInArrow(_summed(2, _PAIR), _FOUND)
    pairs = materialise(pairs, "pairs", {"compression": "zstd"})
    sent = blocks.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(send_words, _DEALT)
    known = materialise(sent.groupBy("range").applyInArrow(_summed(6, _WORD), _FOUND), "words", {"compression": "zstd"})
    # of all words that have a hash one is the start mark, which no document holds
    n_words, all_tokens, target_tokens = (x or 0 for x in known.agg(*[F.sum(F.col("sums")[k]) for k in (0, 5, 6)]).first())
    n_words -= 1

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        x = _Block(rows.to_pylist()[0])
        times = dict(zip(("all", "target"), _returned(found, _PAIR, 2), strict=False))
        stats = _returned(found, _WORD, 6)
        back_order = np.argsort(np.argsort(x.hashes, kind="stable"), kind="stable")
        f_all, f_target, k_all, k_target, u_all, u_target = (s[back_order].astype(np.float64) for s in stats[:6])
        row, mean = np.repeat(np.arange(len(x.n)), x.n), []
        for model, follows, kinds, uni, total in (("target", f_target, k_target, u_target, target_tokens), ("all", f_all, k_all, u_all, all_tokens)):
            back = np.divide(DISCOUNT * kinds, follows, out=np.ones(len(follows)), where=follows > 0)
            p = back[x.before] * ((uni[x.token] + 1) / (total + n_words + 1))
            n = times[model].astype(np.float64)
            p += np.divide(n - DISCOUNT, follows[x.before], out=np.zeros(len(p)), where=n > 0)
            mean.append(np.bincount(row, -np.log(p)[x.pair_of], len(x.n)) / np.maximum(x.n, 1))
        empty = x.n == 0
        columns = [pa.array(x.doc_ids, pa.int64()), pa.array(x.n), *(pa.array(v, mask=empty) for v in (mean[0], mean[1], mean[0] - mean[1]))]
        return pa.table(columns, ["doc_id", "n_tokens", "ce_target", "ce_background", "score"])

    found = pairs.unionByName(known)
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, ce_target double, ce_background double, score double")
