"""Fill-in-middle: texts are cut at two units and put in another order, for models that learn to fill gaps.

A unit is a run of letters A-Z and a-z or one other character, so a character begins a unit unless it and the one before it are
letters. That looks at adjacent characters only: a text is cut into chunks that overlap by one byte, each chunk counts its
units by itself, and prefix sums of the counts say which chunk owns a cut's rank; only owning chunks are scanned again. Chunks
of one text are counted where the text lies; those of a text beyond `long_bytes` are rows of their own, dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.llm.common import mark, small_batches, texts

#: What begins prefix, suffix and middle in an output (fixed values of the format).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHUNK_BYTES = 1 << 16
LONG_BYTES = 8 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CUTS = "struct<n:bigint,a:bigint,b:bigint>"


def begins(piece: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the UTF-8 bytes after the overlap (0 or 1 byte): which begin a unit, and which begin a character."""
    letter = _LETTER[piece]
    character = (piece[overlap:] & 0xC0) != 0x80
    unit = character.copy()
    unit[1 - overlap :] &= ~(letter[1:] & letter[:-1])
    return unit, character


def chunks(data: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, int]]:
    """Chunks of `size` bytes with the byte before each, and whether there is one."""
    for at in range(0, len(data), size):
        overlap = int(at > 0)
        yield data[at - overlap : at + size], overlap


def cut(data: np.ndarray, h1: int, h2: int, size: int) -> tuple[int, int, int]:
    """Units of a text, and the characters before its two cuts."""
    counts = np.asarray([[m.sum() for m in begins(*c)] for c in chunks(data, size)], np.int64).reshape(-1, 2)
    before = np.concatenate([np.zeros((1, 2), np.int64), counts.cumsum(axis=0)])
    n, whole = (int(v) for v in before[-1])
    places = []
    for rank in sorted((h1 % (n + 1), h2 % (n + 1))):
        if rank == n:
            places.append(whole)
            continue
        k = int(np.searchsorted(before[:, 0], rank, "right")) - 1
        overlap = int(k > 0)
        places.append(int(before[k, 1]) + _place(data[k * size - overlap : (k + 1) * size], overlap, rank - int(before[k, 0])))
    return n, places[0], places[1]


def _place(piece: np.ndarray, overlap: int, rank: int) -> int:
    """Characters of a chunk before its unit of that rank."""
    unit, character = begins(piece, overlap)
    return int(character[: np.flatnonzero(unit)[rank]].sum())


def _raw(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(v or b"", np.uint8) for v in column.cast(pa.large_binary()).to_pylist()]


def _cuts(size: int) -> Column:
    """n, a and b of the column text by the columns h1 and h2."""

    @F.arrow_udf(_CUTS)
    def find(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        found = [cut(*row, size) for row in zip(_raw(text), h1.to_pylist(), h2.to_pylist(), strict=True)]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "a", "b"])

    return find("text", "h1", "h2")


def _long_cuts(rows: DataFrame, size: int) -> DataFrame:
    """Of (doc_id, mark, h1, h2, text) the cuts by (doc_id, mark): chunks are rows, counted and scanned wherever they are dealt."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, key, data in zip(b.column("doc_id").to_pylist(), b.column("mark").to_pylist(), _raw(b.column("text")), strict=True):
                for k, (piece, overlap) in enumerate(chunks(data, size)):
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([key], pa.int64()), pa.array([k], pa.int64()), pa.array([overlap], pa.int32()), pa.array([piece.tobytes()], pa.binary())], ["doc_id", "mark", "k", "overlap", "piece"])

    @F.arrow_udf("struct<units:bigint,chars:bigint>")
    def count(piece: pa.Array, overlap: pa.Array) -> pa.Array:
        found = [begins(*c) for c in zip(_raw(piece), overlap.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([int(f[k].sum()) for f in found], pa.int64()) for k in (0, 1)], ["units", "chars"])

    @F.arrow_udf("bigint")
    def scan(piece: pa.Array, overlap: pa.Array, rank: pa.Array) -> pa.Array:
        return pa.array([_place(*c) for c in zip(_raw(piece), overlap.to_pylist(), rank.to_pylist(), strict=True)], pa.int64())

    key = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "mark"]
    names = ["id", "no_id", "mark"]
    one = rows.dropDuplicates(["doc_id", "mark"])
    pieces = one.select("doc_id", "mark", "text").mapInArrow(split, "doc_id long, mark long, k long, overlap int, piece binary").select(*key, "k", "overlap", "piece").repartition(*names, "k")
    counted = pieces.select(*names, "k", count("piece", "overlap").alias("c")).select(*names, "k", "c.*")
    every = Window.partitionBy(*names)
    earlier = every.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    summed = counted.select(*names, "k", "units", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("units", "chars")], *[F.sum(c).over(every).alias(f"all_{c}") for c in ("units", "chars")])
    ranked = summed.join(one.select(*key, "h1", "h2"), names)
    ranks = [F.pmod(h, F.col("all_units") + 1) for h in ("h1", "h2")]
    ranked = ranked.select("*", F.posexplode(F.sort_array(F.array(*ranks))).alias("which", "rank"))
    rank = F.col("rank")
    # the last cut may lie behind the last unit: the first chunk reports it, and no chunk is scanned
    behind = ranked.filter((rank == F.col("all_units")) & (F.col("k") == 0)).select(*names, "all_units", "which", F.col("all_chars").alias("at"))
    owned = ranked.filter((rank >= F.col("units_before")) & (rank < F.col("units_before") + F.col("units"))).join(pieces, [*names, "k"])
    inside = owned.select(*names, "all_units", "which", (F.col("chars_before") + scan("piece", "overlap", rank - F.col("units_before"))).alias("at"))
    found = behind.unionByName(inside).groupBy(*names, "all_units").agg(*[F.max(F.when(F.col("which") == k, F.col("at"))).alias(c) for k, c in enumerate("ab")])
    return found.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "mark", F.struct(F.col("all_units").alias("n"), "a", "b").alias("cuts"))


def fill_in_middle(docs: DataFrame, plain: int = 90, spm: int = 20, seed: int = 1, chunk_bytes: int = CHUNK_BYTES, long_bytes: int = LONG_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output.

    Numbers h1 to h4 are the first four groups of eight digits of the hex sha256 of "seed:doc_id". The prefix ends after
    h1 or h2 modulo n + 1 units, whichever is less, the middle after the other. The form is plain for texts that are empty or
    hold a marker and where h3 % 100 >= plain; else spm where h4 % 100 < spm, and psm otherwise. Null texts are empty; a null
    doc_id counts as the empty string. Rows that share a doc_id are documents of their own, cut by the same numbers. An empty
    table gives an empty result; other columns are not read. unfilled() gives the text back.
    """
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = texts(docs, id_col, text_col, *numbers).withColumn("text", F.coalesce("text", F.lit("")))
    is_long = F.octet_length("text") > long_bytes
    own = rows.filter(~is_long).withColumn("cuts", _cuts(chunk_bytes))
    far = rows.filter(is_long).withColumn("mark", mark())
    met = far.alias("f").join(_long_cuts(far, chunk_bytes).alias("c"), F.col("f.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("f.mark") == F.col("c.mark")))
    cut_rows = own.unionByName(met.select("f.doc_id", "f.text", *[f"f.h{k}" for k in (1, 2, 3, 4)], "cuts"))

    text, a, b = F.col("text"), F.col("cuts.a").cast("int"), F.col("cuts.b").cast("int")
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(m))
    form = F.when((text == "") | marked | (F.col("h3") % 100 >= plain), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    p, m, s = F.substr(text, F.lit(1), a), F.substr(text, a + 1, b - a), F.substr(text, b + 1)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), p, F.lit(SUFFIX), s, F.lit(MIDDLE), m)).otherwise(F.concat(F.lit(SUFFIX), s, F.lit(PREFIX), p, F.lit(MIDDLE), m))
    shown = [F.when(F.col("form") != "plain", c.cast("long")).alias(n) for n, c in (("prefix_chars", a), ("middle_chars", b - a))]
    return cut_rows.withColumn("form", form).select("doc_id", F.col("cuts.n").alias("n"), "form", *shown, output.alias("output"))


def unfilled(output: Column, form: Column) -> Column:
    """The text of an output. Its parts hold no marker, and no marker begins as another ends, so the first of each is the one that was put there."""
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    at = F.instr(body, second)
    one, rest = F.substr(body, F.lit(1), at - 1), F.substr(body, at + len(PREFIX))
    at = F.instr(rest, F.lit(MIDDLE))
    two, middle = F.substr(rest, F.lit(1), at - 1), F.substr(rest, at + len(MIDDLE))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
