"""Reed-Solomon codes over GF(256): blocks are rows, coded and repaired a batch at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The field's polynomial, x^8 + x^4 + x^3 + x^2 + 1, with generator 2 (fixed value).
POLYNOMIAL = 0x11D


@lru_cache
def _field() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the generator (twice round) and logarithms."""
    power, log, v = np.zeros(510, np.int64), np.zeros(256, np.int64), 1
    for k in range(255):
        power[k] = power[k + 255] = v
        log[v] = k
        v = v << 1 ^ (POLYNOMIAL if v & 0x80 else 0)
    return power, log


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    power, log = _field()
    return np.where((a == 0) | (b == 0), 0, power[log[a] + log[b]])


def _inverse(a: np.ndarray) -> np.ndarray:
    power, log = _field()
    return power[255 - log[a]]


def _generator(parity: int) -> np.ndarray:
    """The product of x - 2^k for k below parity, highest power first."""
    g = np.array([1], np.int64)
    for k in range(parity):
        g = np.append(g, 0) ^ np.append(0, multiply(g, _field()[0][k]))
    return g


def encode(data: np.ndarray, parity: int) -> np.ndarray:
    """Blocks (rows of bytes) followed by their parity: the remainder of the division by the generator, worked out for all rows at once."""
    g = _generator(parity)[1:]
    rest = np.zeros((len(data), parity), np.int64)
    for column in data.T.astype(np.int64):
        first = column ^ rest[:, 0]
        rest = np.concatenate([rest[:, 1:], np.zeros((len(data), 1), np.int64)], axis=1) ^ multiply(first[:, None], g[None])
    return np.concatenate([data, rest.astype(np.uint8)], axis=1)


def syndromes(code: np.ndarray, parity: int) -> np.ndarray:
    """Values of the blocks' polynomials at 2^0, 2^1, ...; all 0 where a block is whole."""
    roots = _field()[0][:parity]
    out = np.zeros((len(code), parity), np.int64)
    for column in code.T.astype(np.int64):
        out = multiply(out, roots[None]) ^ column[:, None]
    return out


def _locator(s: np.ndarray) -> list[int]:
    """Berlekamp-Massey: the shortest feedback that makes the syndromes, lowest power first."""
    now, before, length, since, last = [1], [1], 0, 1, 1
    for k in range(len(s)):
        d = int(s[k])
        for j in range(1, min(length, len(now) - 1) + 1):
            d ^= int(multiply(np.int64(now[j]), s[k - j]))
        if d == 0:
            since += 1
            continue
        factor = multiply(np.int64(d), _inverse(np.int64(last)))
        shifted = [0] * since + [int(multiply(factor, np.int64(v))) for v in before]
        size = max(len(now), len(shifted))
        new = [(now[j] if j < len(now) else 0) ^ (shifted[j] if j < len(shifted) else 0) for j in range(size)]
        if 2 * length <= k:
            before, last, length, since = now, d, k + 1 - length, 1
        else:
            since += 1
        now = new
    return now[: length + 1] if len(now) > length else [*now, *[0] * (length + 1 - len(now))]


def _value(poly: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A polynomial (lowest power first) at many places."""
    out = np.zeros_like(at)
    for c in reversed(poly):
        out = multiply(out, at) ^ int(c)
    return out


def repair(code: np.ndarray, parity: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks with their errors put right, and how many there were; -1 where there are more than parity / 2."""
    power, _ = _field()
    code, n = code.copy(), code.shape[1]
    found = syndromes(code, parity)
    errors = np.zeros(len(code), np.int64)
    for row in np.flatnonzero(found.any(axis=1)):
        s = found[row]
        locator = np.array(_locator(s), np.int64)
        count = len(locator) - 1
        places = np.arange(n)  # place k holds the power n - 1 - k
        inverse = power[(255 - (n - 1 - places) % 255) % 255]
        roots = np.flatnonzero(_value(locator, inverse) == 0)
        errors[row] = -1
        if count > parity // 2 or len(roots) != count:
            continue
        evaluator = np.zeros(parity, np.int64)
        for j, c in enumerate(locator):
            evaluator[j:] ^= multiply(s[: parity - j], c)
        slope = np.where(np.arange(1, count + 1) % 2 == 1, locator[1:], 0)  # the derivative: even powers vanish
        x = inverse[roots]
        fix = multiply(multiply(_value(evaluator, x), _inverse(x)), _inverse(_value(slope, x)))
        code[row, roots] ^= fix.astype(np.uint8)
        if not syndromes(code[row : row + 1], parity).any():
            errors[row] = count
        else:
            code[row, roots] ^= fix.astype(np.uint8)
    return code, errors


def _check(size: int, parity: int) -> None:
    if size < 1 or parity < 1 or size + parity > 255:
        raise ValueError("a block has at least one byte of data and of parity, and at most 255 in all")


def rs_blocks(files: DataFrame, size: int, parity: int) -> DataFrame:
    """(path, block, code) of files (path, content): blocks of `size` bytes, each followed by `parity` bytes. The last block is filled with zero bytes; null and empty files have no blocks."""
    _check(size, parity)
    n = F.ceil(F.length("content") / size).cast("int")
    each = files.filter(n > 0).select("path", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"), "content")
    data = each.select("path", "block", F.rpad(F.substr("content", F.col("block") * size + 1, F.lit(size)), size, b"\x00").alias("data"))

    @F.arrow_udf("binary")
    def coded(data: pa.Array) -> pa.Array:
        rows = np.frombuffer(b"".join(data.to_pylist()), np.uint8).reshape(-1, size)
        return pa.array([r.tobytes() for r in encode(rows, parity)], pa.binary())

    return data.select("path", "block", coded("data").alias("code"))


def rs_repaired(blocks: DataFrame, size: int, parity: int) -> DataFrame:
    """(path, block, data, errors) of (path, block, code): errors that were put right. Blocks that can't be, and those of another length, have null data and errors -1."""
    _check(size, parity)

    @F.arrow_udf("struct<data:binary,errors:int>")
    def mended(code: pa.Array) -> pa.Array:
        own = [c if c is not None and len(c) == size + parity else None for c in code.to_pylist()]
        rows = np.frombuffer(b"".join(c for c in own if c is not None), np.uint8).reshape(-1, size + parity)
        right, errors = repair(rows, parity)
        done = iter(zip(right, errors.tolist(), strict=True))
        out = [next(done) if c is not None else (None, -1) for c in own]
        return pa.array([{"data": None if n < 0 else r[:size].tobytes(), "errors": n} for r, n in out], pa.struct([("data", pa.binary()), ("errors", pa.int32())]))

    return blocks.select("path", "block", mended("code").alias("r")).select("path", "block", "r.data", "r.errors")


def rs_content(repaired: DataFrame) -> DataFrame:
    """(path, content, lost): data of rs_repaired() one block after another, and how many blocks were lost; these are left out. The zero bytes that filled the last block stay."""
    got = repaired.groupBy("path").agg(F.array_sort(F.collect_list(F.when(F.col("data").isNotNull(), F.struct("block", "data")))).alias("b"), F.count_if(F.col("data").isNull()).alias("lost"))
    return got.select("path", F.aggregate("b", F.lit(b""), lambda acc, p: F.concat(acc, p["data"])).alias("content"), "lost")


def _places(bits: int) -> np.ndarray:
    """Positions of a Hamming block that hold message bits: all but 0 and the powers of two."""
    return np.array([p for p in range(3, bits) if p & (p - 1)])


def _check_bits(bits: int) -> None:
    if bits not in (8, 16, 32):
        raise ValueError("a Hamming block has 8, 16 or 32 bits")


def hamming_encode(content: bytes, bits: int) -> bytes:
    """Blocks of `bits` bits, high byte first: message bits (high bits of a byte first) at the positions that are no powers of two; position 2^k makes the parity of all positions with that bit even, position 0 that of the whole block. The last block is filled with zero bits."""
    places = _places(bits)
    message = np.unpackbits(np.frombuffer(content, np.uint8))
    n = -(-len(message) // len(places))
    block = np.zeros((n, bits), np.uint8)
    block[:, places] = np.pad(message, (0, n * len(places) - len(message))).reshape(n, len(places))
    for k in range(bits.bit_length() - 1):
        block[:, 1 << k] = block[:, np.arange(bits) >> k & 1 == 1].sum(axis=1) & 1
    block[:, 0] = block[:, 1:].sum(axis=1) & 1
    return np.packbits(block[:, ::-1], axis=1).tobytes()


def hamming_decode(code: bytes, bits: int) -> tuple[bytes, int, int]:
    """The message (whole bytes of it), the blocks in which one bit was put right, and those with two wrong bits, which stay as they are. An incomplete last block is left out."""
    size = bits // 8
    block = np.unpackbits(np.frombuffer(code, np.uint8)[: len(code) // size * size]).reshape(-1, bits)[:, ::-1].copy()
    wrong = np.bitwise_xor.reduce(np.where(block == 1, np.arange(bits), 0), axis=1) if len(block) else np.zeros(0, np.int64)
    odd = block.sum(axis=1) & 1
    fixed = np.flatnonzero(odd == 1)
    block[fixed, wrong[fixed]] ^= 1  # position 0 where only the block's own parity was hit
    message = block[:, _places(bits)].ravel()
    return np.packbits(message[: len(message) // 8 * 8]).tobytes(), len(fixed), int(((odd == 0) & (wrong != 0)).sum())


def hamming_files(files: DataFrame, bits: int) -> DataFrame:
    """(path, content) of files (path, content) in Hamming blocks; null stays null."""
    _check_bits(bits)

    @F.arrow_udf("binary")
    def coded(content: pa.Array) -> pa.Array:
        return pa.array([None if c is None else hamming_encode(c, bits) for c in content.to_pylist()], pa.binary())

    return files.select("path", coded("content").alias("content"))


def hamming_content(files: DataFrame, bits: int) -> DataFrame:
    """(path, content, fixed, broken) of files in Hamming blocks: the message with the zero bytes that filled it, blocks put right and blocks with two wrong bits."""
    _check_bits(bits)

    @F.arrow_udf("struct<content:binary,fixed:int,broken:int>")
    def mended(content: pa.Array) -> pa.Array:
        found = [(None, None, None) if c is None else hamming_decode(c, bits) for c in content.to_pylist()]
        return pa.array([dict(zip(("content", "fixed", "broken"), f, strict=True)) for f in found], pa.struct([("content", pa.binary()), ("fixed", pa.int32()), ("broken", pa.int32())]))

    return files.select("path", mended("content").alias("r")).select("path", "r.*")
