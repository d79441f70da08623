"""Random draws as pure functions of keys.

A draw depends only on (seed, stream, row id, index): a retried task or another
partitioning gives the same values.  As a Column, one MD5 digest yields four
32-bit draws; inside Arrow batches, a 60-bit row hash is expanded to any number of
draws with SplitMix64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

DRAWS_PER_DIGEST = 4

# SplitMix64 increment and multipliers (public-domain generator).
STEP, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_SCALE = float(1 << 32)

# Initial state, shifts and constants of MD5 (RFC 1321).
MD5_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
MD5_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]


def _hex_to_long(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def row_hash(seed: int | str | Column, key: Column) -> Column:
    """60-bit integer used to put rows in random order; ties are broken by the key."""
    seed_c = seed if isinstance(seed, Column) else F.lit(str(seed))
    return _hex_to_long(F.substring(F.md5(F.concat(seed_c.cast("string"), F.lit("|"), key.cast("string"))), 1, 15))


def digest(seed: int | str | Column, stream: str, key: Column, block: int | Column) -> Column:
    """Digest holding draws 4 * block .. 4 * block + 3 of a stream."""
    seed_c = seed if isinstance(seed, Column) else F.lit(str(seed))
    block_c = block if isinstance(block, Column) else F.lit(block)
    return F.md5(F.concat(seed_c.cast("string"), F.lit(f"|{stream}|"), key.cast("string"), F.lit("|"), block_c.cast("string")))


def draw_from(digest_column: Column, slot: int) -> Column:
    """One of the four draws of a digest, strictly between 0 and 1."""
    return (_hex_to_long(F.substring(digest_column, slot * 8 + 1, 8)).cast("double") + 0.5) / _SCALE


def uniform(seed: int | str | Column, stream: str, key: Column, index: int) -> Column:
    """Draw ``index`` of a stream for a row."""
    block, slot = divmod(index, DRAWS_PER_DIGEST)
    return draw_from(digest(seed, stream, key, block), slot)


def draw_array(seed: int | str | Column, stream: str, key: Column, n: int) -> Column:
    """Draws 0 .. n-1 of a stream as an array.

    Written with ``transform`` so that a row with dozens of draws stays one small
    expression; spelled out per draw it outgrows the JVM's method limit.
    """
    digests = F.transform(F.sequence(F.lit(0), F.lit((n - 1) // DRAWS_PER_DIGEST)), lambda b: digest(seed, stream, key, b))
    words = F.flatten(
        F.transform(digests, lambda d: F.transform(F.sequence(F.lit(1), F.lit(25), F.lit(8)), lambda at: F.substr(d, at, F.lit(8))))
    )
    return F.transform(F.slice(words, 1, n), lambda w: (_hex_to_long(w).cast("double") + 0.5) / _SCALE)


def integer_between(u: Column, lo: int | Column, hi: int | Column) -> Column:
    """Uniform integer in [lo, hi] from a uniform draw."""
    lo_c = F.lit(lo) if isinstance(lo, int) else lo
    hi_c = F.lit(hi) if isinstance(hi, int) else hi
    return (lo_c + F.floor(u * (hi_c - lo_c + 1))).cast("int")


def mixed(hashes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The 64 bits behind draw number ``index`` (from 1) of each row hash; the arguments broadcast."""
    with np.errstate(over="ignore"):
        z = hashes.astype(np.uint64) + index.astype(np.uint64) * np.uint64(STEP)
        moved = np.empty_like(z)
        for shift, factor in ((30, MIX1), (27, MIX2), (31, 1)):
            np.right_shift(z, np.uint64(shift), out=moved)
            z ^= moved
            if factor != 1:
                z *= np.uint64(factor)
    return z


def expand(hashes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Draw number ``index`` (from 1) of each row hash, in [0, 1); the arguments broadcast."""
    return (mixed(hashes, index) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def decimals(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and digits (rows x bytes) of the keys' decimal texts, those of equal length together."""
    text = pc.cast(pa.array(keys, pa.int64()), pa.string())
    starts = np.frombuffer(text.buffers()[1], np.int32)[: len(keys) + 1]
    data, lengths = np.frombuffer(text.buffers()[2] or b"", np.uint8), np.diff(starts)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, data[starts[rows][:, None] + np.arange(n)]


def md5_words(before: bytes, digits: np.ndarray, after: bytes = b"") -> np.ndarray:
    """MD5 of ``before`` + the row's bytes + ``after`` as four big-endian words (4 x rows): the Columns' digests inside Arrow batches."""
    n, size = len(digits), len(before) + digits.shape[1] + len(after)
    if size > 55:
        raise ValueError("a message has 55 bytes at most")
    block = np.zeros((n, 64), np.uint8)
    block[:, :size] = np.concatenate([np.broadcast_to(np.frombuffer(b, np.uint8), (n, len(b))) if isinstance(b, bytes) else b for b in (before, digits, after)], axis=1)
    block[:, size] = 0x80
    block[:, 56:58] = np.array([size * 8], "<u2").view(np.uint8)
    words = np.ascontiguousarray(block.view("<u4").T)
    a, b, c, d = (np.full(n, v, np.uint32) for v in MD5_STATE)
    f = np.empty(n, np.uint32)
    for i, (sine, shift) in enumerate(zip(MD5_SINES, MD5_SHIFTS)):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        at = (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        a += f
        a += np.uint32(sine)
        if at <= size // 4 or at == 14:  # the others are zero
            a += words[at]
        np.left_shift(a, np.uint32(shift), out=f)
        a >>= np.uint32(32 - shift)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return np.stack([x + np.uint32(v) for x, v in zip((a, b, c, d), MD5_STATE)]).byteswap()


def draw_of_word(words: np.ndarray) -> np.ndarray:
    """``draw_from`` of a digest's words."""
    return (words.astype(np.float64) + 0.5) / _SCALE
