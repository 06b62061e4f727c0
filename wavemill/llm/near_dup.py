"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature has SLOTS b-bit minima, cut into CHUNKS chunks. Two signatures that differ in at most
2 * CHUNKS - 1 slots have, by the pigeonhole principle, a chunk with at most one differing slot. Each chunk is indexed once
for every slot that may be wrong, under the other slots, so every such pair meets under some key. Documents that meet are
confirmed on their full shingle sets, however far their signatures are apart.

Equal sets are one class from the start. Under a key each class first meets only the key's smallest class (its hub); keys
whose classes are then still in several components have all pairs across components compared, in blocks. So a group of n
copies costs n comparisons a key, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavemill.llm.common import LOWER, mark, materialise, per_worker, small_batches, texts, utf8
from wavemill.llm.components import connected_components

SHINGLE = 5
CHUNKS, CHUNK = 10, 4
SLOTS = CHUNKS * CHUNK
BLOCK = 256
_RNG = np.random.default_rng(20_240_607)
_WEIGHTS = _RNG.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RNG.integers(1, 2**31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RNG.integers(0, 2**32, SLOTS, dtype=np.uint32)
_CACHE_WORDS = 300_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, filled as they are met."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def trim(self) -> None:
        if len(self) > _CACHE_WORDS:  # the words met first are the frequent ones
            keep = dict(islice(self.items(), _CACHE_WORDS // 2))
            self.clear()
            self.update(keep)


def shingle_set(text: bytes | None, words: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; of the whole sequence if it has fewer words."""
    found = (text or b"").translate(LOWER).split()
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = len(h)
    if not n:
        return h
    if n < SHINGLE:
        return _mix(np.sum(h * _WEIGHTS[:n], keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = h[: n - SHINGLE + 1] * _WEIGHTS[0]
    for k in range(1, SHINGLE):
        total += h[k : n - SHINGLE + 1 + k] * _WEIGHTS[k]
    return np.unique(_mix(total))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SLOTS 16-bit minima for each set; none may be empty."""
    flat = np.concatenate(sets)
    h = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), SLOTS), np.uint32)
    for k in range(SLOTS):
        out[:, k] = np.minimum.reduceat(h * _MUL[k] + _ADD[k], begin)
    out ^= out >> np.uint32(15)
    return (out & np.uint32(0xFFFF)).astype(np.uint16)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """For each signature a key for every chunk and every slot of it that may be wrong: the chunk's other slots."""
    parts = sig.reshape(len(sig), CHUNKS, CHUNK).astype(np.int64)
    out = np.empty((len(sig), CHUNKS, CHUNK), np.int64)
    for wrong in range(CHUNK):
        key = np.arange(CHUNKS, dtype=np.int64)[None, :] * CHUNK + wrong
        for k in range(CHUNK):
            if k != wrong:
                key = key << 16 | parts[:, :, k]
        out[:, :, wrong] = key
    return out.reshape(len(sig), SLOTS)


SIGNED = "doc_id long, mark long, n_shingles long, cls binary, keys array<long>"


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: mark (64 bits of its text), number of shingles, class (128 bits of the set; null if empty) and index keys."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_worker("words", _Words)
        for whole in batches:
            for lo in range(0, whole.num_rows, 200):
                b = whole.slice(lo, 200)
                words.trim()
                sets = [shingle_set(t, words) for t in utf8(b.column("text"))]
                full = [s for s in sets if len(s)]
                n = np.asarray([len(s) for s in sets])
                cls, keys = [None] * len(sets), pa.nulls(len(sets), pa.list_(pa.int64()))
                if full:
                    ids = iter([int(np.sum(s, dtype=np.uint64)).to_bytes(8, "little") + int(np.sum(_mix(s + np.uint64(len(s))), dtype=np.uint64)).to_bytes(8, "little") for s in full])
                    cls = [next(ids) if k else None for k in n]
                    found = signatures(full)
                    off = np.concatenate([[0], np.cumsum(np.where(n > 0, SLOTS, 0))]).astype(np.int32)
                    off = pa.array(off, mask=np.append(n == 0, False))
                    keys = pa.ListArray.from_arrays(off, pa.array(chunk_keys(found).ravel()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), keys], ["doc_id", "mark", "n_shingles", "cls", "keys"])

    return texts(docs, id_col, text_col, mark(text_col)).mapInArrow(run, SIGNED)


def _confirm(pairs: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets have 100 * intersection >= percent * union. A text that many pairs need is repeated for every 1000 of them."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / 1000).cast("int").alias("salts"))
    left = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int")).drop("salts")
    a = own.join(salts, own.node == salts.a).select("a", F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    needed = pairs.select("b").distinct()
    b = own.join(needed, own.node == needed.b).select("b", F.col("text").alias("text_b"))
    both = left.join(a, ["a", "salt"]).join(b, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = per_worker("words", _Words), {}

        def of(node: int, text: bytes) -> np.ndarray:
            if (node, text) not in held:
                if len(held) > 200:
                    held.clear()
                held[node, text] = shingle_set(text, words)
            return held[node, text]

        for batch in batches:
            words.trim()
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for x, y, tx, ty in zip(a, b, utf8(batch.column("text_a")), utf8(batch.column("text_b")), strict=True):
                s, t = of(x, tx), of(y, ty)
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _block_links(rows: list[tuple], words: _Words, percent: int) -> Iterator[tuple[int, int]]:
    """Of one block: for each minor row a link to every other component that holds one. Intersections are counted by products of 0/1 matrices over slabs of the shingles that at least two rows hold."""
    sets = [shingle_set(r[2], words) for r in rows]
    minor = np.asarray([r[3] for r in rows], bool)
    component = np.asarray([r[1] for r in rows])
    n = np.asarray([len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(rows)), n)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    held = place[column] >= 0
    row, column = row[held], place[column[held]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    at_m, at_a = np.flatnonzero(minor), np.flatnonzero(~minor)
    common = np.zeros((len(at_m), len(at_a)), np.float32)
    for lo in range(0, len(shared), 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        slab = np.zeros((len(rows), min(4096, len(shared) - lo)), np.float32)
        slab[row[i:j], column[i:j] - lo] = 1
        common += slab[at_m] @ slab[at_a].T
    linked = (common > 0) & (100 * common >= percent * (n[at_m][:, None] + n[at_a][None, :] - common)) & (component[at_m][:, None] != component[at_a][None, :])
    for k in np.flatnonzero(linked.any(axis=1)):
        others = at_a[np.flatnonzero(linked[k])]
        for other in others[np.unique(component[others], return_index=True)[1]]:
            yield rows[at_m[k]][0], rows[other][0]


def _across(pairs: DataFrame, component: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components among the classes that share a hub.

    pairs (a: hub, b: class) has every class that shares a key with its hub, so two classes that share a key share a hub.
    Hubs whose classes lie in one component are done. For the others, classes outside the hub's component are compared with
    all of the hub's classes on full sets, in blocks of BLOCK by BLOCK rows; only links leave a block.
    """
    label = component.withColumnRenamed("node", "b")
    part = pairs.join(label, "b", "left").select("a", "b", F.coalesce("component", "b").alias("component"))
    hub = component.select(F.col("node").alias("a"), F.col("component").alias("hub_component"))
    stats = part.groupBy("a").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    stats = stats.join(hub, "a", "left").select("a", F.coalesce("hub_component", "a").alias("hub_component"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = part.join(materialise(stats, "open"), "a").join(own, F.col("b") == own.node).select("a", "b", "component", "blocks", "text", (F.col("component") != F.col("hub_component")).alias("minor"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    member = rows.select("a", F.col("own").alias("i"), F.explode(every).alias("j"), "b", "component", "text", F.lit(False).alias("minor"))
    minor = rows.filter("minor").select("a", F.explode(every).alias("i"), F.col("own").alias("j"), "b", "component", "text", "minor")
    dealt = member.unionByName(minor).repartition("a", "i", "j").sortWithinPartitions("a", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at, held = per_worker("words", _Words), None, []

        def links() -> pa.RecordBatch:
            words.trim()
            found = list(_block_links(held, words, percent)) if len({r[3] for r in held}) == 2 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in "aij"), strict=True)
            values = zip(b.column("b").to_pylist(), b.column("component").to_pylist(), utf8(b.column("text")), b.column("minor").to_pylist(), strict=True)
            for key, value in zip(keys, values, strict=True):
                if key != at and held:
                    yield links()
                    held = []
                at = key
                held.append(value)
        if held:
            yield links()

    return dealt.mapInArrow(run, "a long, b long").distinct()


def groups(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, mark (64 bits of the text), n_shingles and head, the smallest (doc_id, mark) of the rows that links reach; head is
    null for rows without a doc_id or without words, which link with nothing."""
    small_batches(docs.sparkSession)
    signed = materialise(sign(docs, id_col, text_col), "signed")
    classes = signed.filter("cls is not null and doc_id is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "mark")).alias("head"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    sizes = classes.select("node", "n")
    index = classes.select("node", F.explode("keys").alias("key"))
    hubs = index.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("held")).filter("held > 1").drop("held")
    pairs = index.join(hubs, "key").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = materialise(pairs, "pairs")

    def close(pairs: DataFrame) -> DataFrame:
        """Only pairs whose sizes allow a link."""
        a, b = (sizes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
        both = pairs.join(a, "a").join(b, "b")
        fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
        return both.filter(fits).select("a", "b").distinct()

    # the texts of candidates leave the table in one shuffle, by the same plan at every size
    candidates = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    candidates = classes.join(candidates, "node").select("node", "head.*")
    own = texts(docs, id_col, text_col, mark(text_col)).join(candidates.hint("merge"), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])
    own = materialise(own.select("node", "text"), "candidates")
    links = materialise(_confirm(materialise(close(pairs), "close"), own, percent), "confirmed")

    component = materialise(connected_components(links), "component")
    second = materialise(_across(pairs, component, own, percent), "across")
    if not second.isEmpty():
        component = materialise(connected_components(links.unionByName(second)), "component")
    of_class = materialise(classes.select("cls", "node", "head").join(component, "node", "left").select("cls", "head", F.coalesce("component", "node").alias("component")), "of-class")
    heads = of_class.groupBy("component").agg(F.min("head").alias("head"))
    of_class = materialise(of_class.drop("head").join(heads, "component").select("cls", "head"), "heads")
    out = signed.select("doc_id", "mark", "n_shingles", "cls").join(of_class, "cls", "left")
    return out.select("doc_id", "mark", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("head")).alias("head"))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id that links reach) and kept (doc_id = component_id).

    Words are what ASCII white space leaves, with A-Z in lower case; a document's set has its distinct five-word shingles, or
    the whole sequence when it has fewer words. Null, empty and blank texts have no set and link with nothing. A row is a
    document: rows that share a doc_id each have their own set and component, so a doc_id of different texts may be given
    twice. Rows without a doc_id are never linked: component_id is null and they are kept. An empty table gives an empty
    result; other columns are not read.
    """
    component_id = F.coalesce("head.doc_id", "doc_id")
    return groups(docs, percent, id_col, text_col).select("doc_id", "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row of the smallest doc_id (of several texts under it, of the smallest
    hash), once however often it is repeated. Rows without a doc_id or without words stay. The columns are those of docs."""
    keyed = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__mark", mark(text_col))
    alone = F.col("__id").isNull() | ~F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    first = groups(docs, percent, id_col, text_col).filter("head = struct(doc_id, mark)").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    met = keyed.join(materialise(first, "first").hint("merge"), ["__id", "__mark"])
    order = Window.partitionBy("__id", "__mark").orderBy(F.xxhash64(*docs.columns))
    met = met.withColumn("__row", F.row_number().over(order)).filter("__row = 1")
    return met.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(keyed.filter(alone).select(*[F.col(f"`{c}`") for c in docs.columns]))
