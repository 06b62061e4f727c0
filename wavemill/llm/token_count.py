"""Token counts by the whole-token shortcut.

A byte-level BPE first cuts a text into pre-tokens and then merges inside each. A vocabulary string that is one pre-token
and that the merges lead to a single id always counts as one token. That is proved once, on the driver, for every
vocabulary string (`prove_whole_tokens`); executors then look pre-tokens up in the proven set and merge only the rest.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import per_worker, small_batches, texts
from wavemill.llm.pieces import PieceTable

#: Pre-token pattern of the byte-level vocabulary (fixed value).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A single space between two visible characters begins a pre-token, so a text can be cut there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Where Unicode versions or definitions of white space could differ, the library does the whole piece.
_EXOTIC = re.compile("[^\x00-ɏ]|[\x1c-\x1f\x85]")
_STOPS = tuple(".,;:!?")
_CACHE_TOKENS = 400_000
#: In place of a count: the piece needs the text around it.
RAGGED = 2**32 - 1


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by its rule: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}


def prove_whole_tokens(tokenizer_json: str) -> frozenset[str]:
    """The vocabulary strings that are one pre-token and encode alone as one token."""
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_json)
    chars, pattern, found = _byte_chars(), regex.compile(PRE_TOKEN), []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        try:
            word = bytes(chars[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if not _EXOTIC.search(word) and pattern.findall(word) == [word]:
            found.append(word)
    encoded = tokenizer.encode_batch(found, add_special_tokens=False)
    return frozenset(w for w, e in zip(found, encoded, strict=True) if len(e.ids) == 1)


class _Counter:
    """Counts tokens of texts in one Python worker."""

    def __init__(self, tokenizer_json: str, whole: frozenset[str]):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.special = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.find = regex.compile(PRE_TOKEN).findall
        self.model = self.tokenizer.model
        self.stand_in = {b: c for c, b in _byte_chars().items()}
        self.whole, self.merged = whole, {}
        self.known = PieceTable(self._make)

    def _cut(self, piece: str, lead: str) -> list[str]:
        """The pre-tokens of lead + piece; a word, or one and a stop, needs no pattern."""
        if piece.isalpha():
            return [lead + piece]
        if piece[-1:] in _STOPS and piece[:-1].isalpha():
            return [lead + piece[:-1], piece[-1]]
        return self.find(lead + piece)

    def _merge(self, token: str) -> int:
        """Tokens of one pre-token, by the library's merges."""
        return len(self.model.tokenize(token.encode().decode("latin-1").translate(self.stand_in)))

    def _piece(self, piece: str, lead: str) -> int:
        """Tokens of lead + piece: whole tokens directly, merges only for the rest."""
        if not (piece.isascii() and piece.isprintable()) and _EXOTIC.search(piece):
            return len(self.tokenizer.encode(lead + piece, add_special_tokens=False).ids)
        n = 0
        for t in self._cut(piece, lead):
            if t in self.whole:
                n += 1
            else:
                if (m := self.merged.get(t)) is None:
                    m = self.merged[t] = self._merge(t)
                n += m
        return n

    def _make(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.merged) > _CACHE_TOKENS:  # the tokens met first are the frequent ones
            self.merged = dict(islice(self.merged.items(), _CACHE_TOKENS // 2))
        # an empty piece, or white space at its end, means that a space doesn't part pre-tokens there
        n = [RAGGED if not p or p[0].isspace() or p[-1].isspace() or "<|" in p else self._piece(p, " ") for p in pieces]
        return np.ones(len(n), np.int64), np.asarray(n, np.uint32)

    def _slow(self, text: str) -> int:
        """Of a text with special strings or irregular spaces."""
        plain = self.split_special.split(text) if self.split_special else [text]
        n = len(plain) - 1
        for s in filter(None, plain):
            first, *later = _CUT.split(s)
            n += self._piece(first, "") + sum(self._piece(p, " ") * m for p, m in Counter(later).items())
        return n

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text. Arrow cuts the texts at spaces and numbers the distinct pieces; only these are looked up."""
        texts = pc.fill_null(texts, "")
        pieces = pc.split_pattern(texts, " ")
        words = pieces.flatten().dictionary_encode()
        _, begin, table = self.known.lookup(words.dictionary)
        which, off = words.indices.to_numpy(), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        n = table[begin][which].astype(np.int64)
        slow = np.diff(np.concatenate([[0], np.cumsum(n == RAGGED)])[off]) > 0
        total = np.diff(np.concatenate([[0], np.cumsum(n)])[off])
        first = words.dictionary.take(pa.array(which[off[:-1]])).to_pylist() if len(texts) else []
        for k, s in enumerate(slow.tolist()):  # no space leads the first piece
            total[k] = self._slow(texts[k].as_py()) if s else total[k] - n[off[k]] + self._piece(first[k], "")
        return total


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit), as the library counts the whole text.

    Null and empty texts have 0 bytes and 0 tokens. A null doc_id stays null; repeated rows each give a row; an empty table
    gives an empty result; other columns are not read. Special strings inside a text count as one token each. There is no
    shuffle: every text is counted where it is read, in Arrow batches; the caches of a worker are bounded.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    model = spark.sparkContext.broadcast((spec, prove_whole_tokens(spec)))  # fixed size: one vocabulary
    small_batches(spark, 2000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_worker("counter", _Counter, *model.value)
        for b in batches:
            n = pa.array(counter.count(b.column("text")), pa.int64())
            size = pc.fill_null(pc.binary_length(b.column("text").cast(pa.binary())), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, n], ["doc_id", "n_bytes", "n_tokens"])

    out = texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
