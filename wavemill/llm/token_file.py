"""Token-id files in Simple-8b.

A file is a sequence of blocks in ascending doc_id order. A block holds whole documents: a header, the doc_ids, the ids of
each document, the first id of every GROUP words (so that a reader can decode from the middle), and 64-bit words. The top
four bits of a word select how many ids of how many bits the other 60 hold; selector 0 is the escape, whose id stands raw
in the next word. Blocks are rows of a Parquet container, which gives them Spark's write commit and any Hadoop path.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavemill.llm.common import join_small, per_worker, small_batches, texts
from wavemill.llm.pieces import PieceTable
from wavemill.llm.token_count import _STOPS, _byte_chars

#: Ids in a word and bits of each, by selector; selector 0 is the escape (fixed values of the format).
COUNTS = (1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: Pre-token pattern of the word-end vocabulary, which has its texts composed and in lower case (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters that composing could change, or that Unicode versions could class otherwise; the library does such pieces whole, and those that may hold a special string.
_EXOTIC = re.compile("[^\x00-\u024f]|[\x1c-\x1f\x85]")
MAGIC = b"S8B1"
GROUP = 128
BLOCK_IDS = 1 << 16
_HEAD = struct.Struct("<4sIQQ")
BLOCKS = "file_no long, block_no long, ids_before long, n_ids long, payload binary"


def pack(ids: np.ndarray) -> np.ndarray:
    """Unsigned ids below 2**64 as Simple-8b words: at each place the selector that takes most ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    sel = np.zeros(n, np.int64)  # the escape, unless a width fits
    can = np.arange(n, dtype=np.int64)
    for s in range(len(COUNTS) - 1, 0, -1):  # what fits a width and its count also fits every wider one, so candidates dwindle
        low, c = np.uint64(1 << WIDTHS[s]), COUNTS[s]
        if len(can) == n:
            fits = padded < low
            ok = fits[:n].copy()
            for k in range(1, c):
                ok &= fits[k : n + k]
            can = np.flatnonzero(ok)
        else:
            for k in range(c):
                can = can[padded[can + k] < low]
        if not len(can):
            break
        sel[can] = s
    step = np.asarray(COUNTS, np.int64)[sel].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.asarray(starts, np.int64)
    chosen = sel[starts]
    width = np.where(chosen == 0, 2, 1)
    where = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    for s in np.unique(chosen):
        at = chosen == s
        if s == 0:
            words[where[at] + 1] = ids[starts[at]]
            continue
        c, shift = COUNTS[s], np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(WIDTHS[s])
        body = np.bitwise_or.reduce(padded[starts[at][:, None] + np.arange(c)] << shift, axis=1)
        words[where[at]] = body | np.uint64(int(s) << 60)
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids that pack() made the words of."""
    top = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (top == 0).any():  # an escape's raw word may look like anything: walk only the escapes
        at = 0
        escapes = np.flatnonzero(top == 0)
        k = 0
        while k < len(escapes):
            at = escapes[k]
            raw[at + 1] = True
            k += 2 if k + 1 < len(escapes) and escapes[k + 1] == at + 1 else 1
    count = np.where(raw, 0, np.asarray(COUNTS, np.int64)[np.minimum(top, len(COUNTS) - 1)])
    begin = np.cumsum(count) - count
    out = np.zeros(int(count.sum()) + 60, np.uint64)
    for s in np.unique(top[~raw]):
        at = np.flatnonzero((top == s) & ~raw)
        if s == 0:
            out[begin[at]] = words[at + 1]
            continue
        c, w = COUNTS[s], WIDTHS[s]
        shift = np.arange(c, dtype=np.uint64) * np.uint64(w)
        out[begin[at][:, None] + np.arange(c)] = (words[at][:, None] >> shift) & np.uint64((1 << w) - 1)
    return out[:n]


def group_offsets(words: np.ndarray) -> np.ndarray:
    """The index of the first id of every GROUP words; an escape's raw word counts as no id."""
    top = (words >> np.uint64(60)).astype(np.int64)
    count = np.asarray(COUNTS, np.int64)[np.minimum(top, len(COUNTS) - 1)]
    escapes = np.flatnonzero(top == 0)
    skip = -2
    for at in escapes.tolist():
        if at != skip:
            skip = at + 1
            count[skip] = 0
    return (np.cumsum(count) - count)[::GROUP].astype(np.uint64)


def write_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words = pack(ids)
    known = np.asarray([d is not None for d in doc_ids], np.uint8)
    own = np.asarray([d or 0 for d in doc_ids], "<i8")
    return b"".join((_HEAD.pack(MAGIC, len(doc_ids), len(ids), len(words)), own.tobytes(), known.tobytes(), np.asarray(lengths, "<u8").tobytes(), group_offsets(words).astype("<u8").tobytes(), words.astype("<u8").tobytes()))


def read_block(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, all ids."""
    magic, n_docs, n_ids, n_words = _HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = _HEAD.size
    own = np.frombuffer(payload, "<i8", n_docs, at)
    known = np.frombuffer(payload, np.uint8, n_docs, at := at + 8 * n_docs)
    lengths = np.frombuffer(payload, "<u8", n_docs, at := at + n_docs)
    at += 8 * n_docs + 8 * -(-n_words // GROUP)
    words = np.frombuffer(payload, "<u8", n_words, at)
    return [d if k else None for d, k in zip(own.tolist(), known.tolist(), strict=True)], lengths.astype(np.int64), unpack(words, n_ids)


def read_head(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, whether each is known, and the number of ids of each document."""
    _, n_docs, _, _ = _HEAD.unpack_from(payload)
    own, known = np.frombuffer(payload, "<i8", n_docs, _HEAD.size), np.frombuffer(payload, np.uint8, n_docs, _HEAD.size + 8 * n_docs) > 0
    return own, known, np.frombuffer(payload, "<u8", n_docs, _HEAD.size + 9 * n_docs).astype(np.int64)


def read_part(payload: bytes, start: int, n: int) -> np.ndarray:
    """The n ids of a block from place start on. Only the words that hold them are decoded: the offsets of the groups lead there."""
    _, n_docs, n_ids, n_words = _HEAD.unpack_from(payload)
    n = max(0, min(n, n_ids - start))
    at = _HEAD.size + 17 * n_docs
    groups = -(-n_words // GROUP)
    offsets = np.frombuffer(payload, "<u8", groups, at).astype(np.int64)
    words = np.frombuffer(payload, "<u8", n_words, at + 8 * groups)
    if not n:
        return np.zeros(0, np.uint64)
    first, last = (int(np.searchsorted(offsets, x, "right")) - 1 for x in (start, start + n - 1))
    while first and int(words[first * GROUP - 1]) >> 60 == 0:  # what follows selector 0 may be an escape's raw word
        first -= 1
    end = min(n_words, (last + 1) * GROUP + 1)
    part = np.append(words[first * GROUP : end], np.uint64(1 << 60))  # the last word may be an escape whose raw word isn't needed
    return unpack(part, start + n - int(offsets[first]))[start - int(offsets[first]) :]


class _Encoder:
    """Ids of texts in one Python worker. White space ends every pre-token of this vocabulary, so ids are looked up by white-space piece."""

    CACHE = 200_000

    def __init__(self, spec: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.find = regex.compile(PRE_TOKEN).findall
        self.stand_in = {b: c for c, b in _byte_chars().items()}
        self.known = PieceTable(self._make)
        self.tokens: dict[str, bytes] = {}

    def _token(self, t: str) -> bytes:
        """The ids of one pre-token, by the library's merges."""
        if (ids := self.tokens.get(t)) is None:
            found = self.model.tokenize(t.encode().decode("latin-1").translate(self.stand_in))
            self.tokens[t] = ids = b"".join(x.id.to_bytes(4, "little") for x in found)
        return ids

    def _piece(self, word: str) -> bytes:
        if "<|" in word or not (word.isascii() and word.isprintable()) and _EXOTIC.search(word):
            return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        word = word.lower()
        if word.isalpha():
            return self._token(word)
        if word[-1:] in _STOPS and word[:-1].isalpha():
            return self._token(word[:-1]) + self._token(word[-1])
        return b"".join(map(self._token, self.find(word)))

    def _make(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tokens) > self.CACHE:  # the tokens met first are the frequent ones
            self.tokens = dict(islice(self.tokens.items(), self.CACHE // 2))
        found = list(map(self._piece, words))
        return np.asarray([len(x) // 4 for x in found], np.int64), np.frombuffer(b"".join(found), "<u4")

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts, and how many each text has. Arrow cuts the texts and numbers the distinct pieces; only these are looked up."""
        pieces = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = pieces.flatten().dictionary_encode()
        size, begin, table = self.known.lookup(words.dictionary)
        which = words.indices.to_numpy()
        n = size[which]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = table[np.repeat(begin[which] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, np.diff(upto[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()])


def encode_blocks(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of all documents in ascending doc_id order; each document's ids end with end_id.

    The rows are dealt by ranges of doc_id and sorted inside; range i makes file i, so files follow each other in doc_id
    order. Null texts count as empty: only end_id. Documents without a doc_id come first; repeated rows are all written.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # fixed size: one vocabulary
    small_batches(spark, 500)
    end = np.asarray([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file_no = per_worker("encoder", _Encoder, spec.value), TaskContext.get().partitionId()
        block_no, before, held, doc_ids, lengths, data = 0, 0, 0, [], [], []

        def block() -> pa.RecordBatch:
            ids = np.concatenate(data)
            row = [file_no], [block_no], [before], [len(ids)], [write_block(doc_ids, lengths, ids)]
            types = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["file_no", "block_no", "ids_before", "n_ids", "payload"])

        for b in batches:
            ids, sizes = encoder.ids(b.column("text"))
            at = 0
            for doc_id, n in zip(b.column("doc_id").to_pylist(), sizes.tolist(), strict=True):
                doc_ids.append(doc_id)
                lengths.append(n + 1)
                data += (ids[at : at + n], end)
                at += n
                held += n + 1
                if held >= BLOCK_IDS:
                    yield block()
                    block_no, before, held, doc_ids, lengths, data = block_no + 1, before + held, 0, [], [], []
        if doc_ids:
            yield block()

    ordered = texts(docs, id_col, text_col).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return ordered.mapInArrow(run, BLOCKS)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, **columns: str) -> None:
    """Encodes docs and writes the token files under path. The words are dense already, so the container isn't compressed."""
    encode_blocks(docs, tokenizer_path, end_id, **columns).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files under path: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, on demand, ids."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    files = blocks.groupBy("file_no").agg(F.sum("n_ids").alias("n"))  # one row a file
    base = files.select("file_no", (F.sum("n").over(Window.orderBy("file_no")) - F.col("n")).alias("file_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file_start, before, payload in zip(b.column("file_start").to_pylist(), b.column("ids_before").to_pylist(), b.column("payload").to_pylist(), strict=True):
                doc_ids, lengths, ids = read_block(payload)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw, cut = memoryview(ids.astype("<u4").tobytes()), list(zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True))
                columns = [pa.array(doc_ids, pa.int64()), pa.array(starts + before + file_start, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(raw[i:j]) for i, j in cut], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    joined = join_small(blocks, base, "file_no").select("file_start", "ids_before", "payload")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def documents_at(spark: SparkSession, path: str) -> DataFrame:
    """Where documents are, by the blocks' headers alone: doc_id, file_no, block_no, place (of the first id in its block) and n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file_no, block_no, payload in zip(*(b.column(c).to_pylist() for c in ("file_no", "block_no", "payload")), strict=True):
                own, known, n = read_head(payload)
                columns = [pa.array(own, mask=~known), pa.array([file_no] * len(n), pa.int64()), pa.array([block_no] * len(n), pa.int64()), pa.array(np.cumsum(n) - n), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "file_no", "block_no", "place", "n_tokens"])

    return spark.read.schema(BLOCKS).parquet(path).mapInArrow(run, "doc_id long, file_no long, block_no long, place long, n_tokens long")


def read_documents(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, ids) of the documents with the doc_ids of wanted (doc_id); repeated documents each give a row. Of a block only the words of these documents are decoded."""
    found = documents_at(spark, path).join(wanted.select("doc_id").distinct(), "doc_id")
    parts = found.groupBy("file_no", "block_no").agg(F.collect_list(F.struct("doc_id", "place", "n_tokens")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for payload, own in zip(b.column("payload").to_pylist(), b.column("parts").to_pylist(), strict=True):
                ids = [read_part(payload, p["place"], p["n_tokens"]).astype(np.int64) for p in own]
                yield pa.RecordBatch.from_arrays([pa.array([p["doc_id"] for p in own], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return spark.read.schema(BLOCKS).parquet(path).join(parts, ["file_no", "block_no"]).select("payload", "parts").mapInArrow(run, "doc_id long, ids array<long>")
