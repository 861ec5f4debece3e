"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import functools
import sys

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import discard, fresh_path, shared_dir, written

__all__ = ["KeyFilter", "WordHashes", "WordStream", "anti_join", "ascii_words", "batches", "discard", "fresh_path", "mix64", "released", "semi_join", "shared_dir", "shingle_hashes", "shingle_stream", "shingles_of", "written"]

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Returns memory that this process no longer needs to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()  # functions of earlier tasks, with the tables that they carry, are in cycles
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


@functools.cache
def large_blocks_apart() -> None:
    """Has freed blocks of a few MB returned to the system at once: by itself glibc raises that limit
    to 32 MB, and what a worker freed stays with it. Once a process."""
    import ctypes

    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD


def released(run):
    """``run`` (a generator function over a task's batches) that leaves nothing behind: Python
    workers are kept for later tasks, and freed memory that they hold on to adds up."""

    @functools.wraps(run)
    def wrapper(parts):
        large_blocks_apart()
        try:
            yield from run(parts)
        finally:
            give_back()

    return wrapper


class KeyFilter:
    """A Bloom filter of the keys (columns ``on``) of a table, as a column test for other tables.

    It says no only for keys that the table doesn't hold, so a join may leave those rows
    where they are. It takes about 16 bits a key and 4 MB at most: with many more keys than
    two million it says yes more often, and the join after it does more of the work.
    """

    MOST = 1 << 25
    TESTS = 3

    def __init__(self, keys: DataFrame, on: list[str]):
        self.on = on
        bits = min(self.MOST, max(1 << 16, 1 << (16 * keys.count()).bit_length()))
        place = keys.select(F.explode(F.array(*self._places(bits))).alias("place"))
        word, bit = F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))")
        got = place.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()  # bits / 64 rows at most
        self.bits, self.table = bits, np.zeros(bits >> 6, np.uint64)
        self.table[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)

    def _places(self, bits: int) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(k), *self.on), F.lit(bits)) for k in range(self.TESTS)]

    def maybe(self) -> Column:
        """Whether a row with columns ``on`` may have one of the keys."""
        table = self.table

        @F.arrow_udf("boolean")
        def held(a, b, c):
            import pyarrow as pa

            out = np.ones(len(a), bool)
            for x in (a, b, c):
                at = x.to_numpy(zero_copy_only=False)
                out &= ((table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            return pa.array(out)

        return held(*self._places(self.bits))


def anti_join(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` without a partner in ``keys``; rows that surely have none aren't shuffled."""
    maybe = KeyFilter(keys, on).maybe()
    return df.where(~maybe).unionAll(df.where(maybe).join(keys, on, "left_anti").select(df.columns))


def semi_join(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` with a partner in ``keys``; rows that surely have none aren't shuffled."""
    return df.where(KeyFilter(keys, on).maybe()).join(keys, on, "left_semi").select(df.columns)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, kept for reuse; emptied when it gets large."""

    LIMIT = 500_000

    def __missing__(self, word):
        import xxhash

        value = xxhash.xxh64_intdigest(word)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value
        return value


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.

    ``bytes.split`` without arguments splits on exactly these six bytes and
    ``bytes.lower`` touches A-Z only.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


@functools.cache
def _word_tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Made once a Python worker, which serves many tasks."""
    inside = np.fromiter((chr(i).isalnum() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    char = mix64(np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return inside, char, mix64(np.arange(1, 4097, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


class WordStream:
    """Hashes of the words of a text, runs of letters and digits after lower-casing,
    without a Python object for each: a word's hash is the mixed sum over its
    characters of a random number for the character times one for the place."""

    def __init__(self, seed: int = 1):
        self.inside, self.char, self.place = _word_tables(seed)

    def spans(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points, first and end place of each word) of the lower-cased text."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4") if text else np.empty(0, "<u4")
        edge = np.diff(self.inside[codes].view(np.int8), prepend=0, append=0)
        return codes, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def hashes(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.empty(0, np.uint64)
        sizes = ends - starts
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        kept = codes[np.repeat(starts, sizes) + place]
        return mix64(np.add.reduceat(self.char[kept] * self.place[place & 4095], first) + sizes.astype(np.uint64))

    def __call__(self, text: str | None) -> np.ndarray:
        return self.hashes(*self.spans(text))


def shingle_hashes(words: list[bytes], size: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word ``size``-grams; a shorter
    sequence counts as one shingle, no words give none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    return np.unique(shingle_stream(words, size, cache))


def shingle_stream(words: list[bytes], size: int, cache: dict) -> np.ndarray:
    """Hash of each ``size``-gram in order of place."""
    return shingles_of(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)), size)


def shingles_of(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size``-gram of word hashes; a shorter sequence is one gram."""
    n = len(h)
    if n <= size:
        out = np.full(1, n, np.uint64)
        for i in range(n):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + 1])
        return out
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n - size + 1])
    return out


def batches(batch, columns: list[str], rows: int = 256):
    """Small slices of an Arrow batch as tuples of Python lists."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield tuple(part.column(c).to_pylist() for c in columns)
