"""Best-fit packing with Martello-Toth dominance reduction.

Only lengths matter for packing, and there are at most ``capacity`` of them. So
the corpus is reduced to a histogram of piece lengths (at most 2048 numbers,
whatever the input), the driver solves that exactly as a bin-packing instance,
and the plan goes back as runs "pieces number a..b of length l take place o of
sequences s, s+1, ...". Pieces are numbered within their length by a window
over (length, salt), with more salts the more pieces there are, so that one common
length does not meet in one task.

Nulls: a null text is an empty one (its only id is the end mark); a null doc_id
stays null. Repeated rows are packed each. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import batches, released, written
from .tokens import make_encoder, tokenizer_files

CAPACITY = 2048
END = 0
#: Pieces are dealt to so many salts at least and at most, else to one for this many pieces.
SALTS, MOST_SALTS, SALT_PIECES = 64, 4096, 200_000
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones at the end, the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ranks: str | None = None, end: int = END) -> DataFrame:
    """Per piece of each document: place, length and CRC-32 of its ids."""
    files = tokenizer_files(tokenizer, ranks)

    def run(parts):
        from zlib import crc32

        encode = make_encoder(*files)
        for batch in parts:
            out = ([], [], [], [], [])
            for ids, texts in batches(batch, ["doc_id", "text"]):
                for doc, text in zip(ids, texts, strict=True):
                    got = np.array([*encode(text), end] if text else [end], "<u4")
                    for k, (start, length) in enumerate(cut(len(got), capacity)):
                        for col, value in zip(out, (doc, k, start, length, crc32(got[start : start + length].tobytes())), strict=True):
                            col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), PIECES)


def with_length(bits: int, x: int, top: int) -> int:
    """Bit s of ``bits`` tells whether some pieces add up to s; adds pieces of length x, any number of them."""
    mask, step = (1 << (top + 1)) - 1, x
    while step <= top:
        bits |= (bits << step) & mask
        step *= 2
    return bits


class Sums:
    """Which sums up to ``top`` copies of some lengths can make; kept for the last set of lengths."""

    def __init__(self, top: int):
        self.top, self.known, self.bits = top, frozenset(), 1

    def of(self, lengths: list[int]) -> int:
        now = frozenset(lengths)
        if not self.known <= now:
            self.known, self.bits = frozenset(), 1
        for x in now - self.known:
            self.bits = with_length(self.bits, x, self.top)
        self.known = now
        return self.bits


def reduce_dominated(count: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Fixes sets that dominate every other set with the same largest item.

    For the largest length a: alone, if nothing fits beside it; with b, if a + b
    fill the bin; with the largest b that fits, if no choice of other pieces adds
    up to more than b within the gap (then b can take the place of any such
    choice). ``count`` (by length) loses what is fixed. Returns (pattern, how often)
    with a pattern as [(length, copies)].
    """
    fixed: list[tuple[list[tuple[int, int]], int]] = []
    sums = Sums(capacity)
    for a in range(capacity, 0, -1):
        while count[a]:
            gap = capacity - a
            below = np.flatnonzero(count[1 : gap + 1]) + 1
            if a <= gap and count[a] == 1:
                below = below[below != a]
            if not len(below):
                fixed.append(([(a, 1)], int(count[a])))
                count[a] = 0
                break
            b = int(below[-1])
            if b < gap:
                if (sums.of(below.tolist()) >> (b + 1)) & ((1 << (gap - b)) - 1):
                    break
            if b == a:
                n = int(count[a]) // 2
                fixed.append(([(a, 2)], n))
                count[a] -= 2 * n
            else:
                n = int(min(count[a], count[b]))
                fixed.append(([(a, 1), (b, 1)], n))
                count[a] -= n
                count[b] -= n
    return fixed


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing on the histogram: equal bins are kept as one entry with a number."""
    open_bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    present = np.zeros(capacity + 1, bool)

    def put(gap, pattern, n):
        open_bins.setdefault(gap, []).append((pattern, n))
        present[gap] = True

    for a in range(capacity, 0, -1):
        left = int(count[a])
        while left:
            fit = np.flatnonzero(present[a:])
            if not len(fit):
                each = capacity // a
                bins, rest = divmod(left, each)
                if bins:
                    put(capacity - each * a, [(a, each)], bins)
                if rest:
                    put(capacity - rest * a, [(a, rest)], 1)
                left = 0
                break
            gap = int(fit[0]) + a
            pattern, n = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
                present[gap] = False
            each = min(gap // a, left)  # the fullest bin stays the fullest while it fits
            bins = min(n, left // each)
            if n > bins:
                put(gap, pattern, n - bins)
            put(gap - each * a, [*pattern, (a, each)], bins)
            left -= bins * each
    return [entry for entries in open_bins.values() for entry in entries]


def solve(count: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, end rank, copies, first sequence, offset) and the number of sequences."""
    count = count.astype(np.int64).copy()
    patterns = reduce_dominated(count, capacity)
    patterns += best_fit(count, capacity)
    used = np.zeros(capacity + 1, np.int64)
    runs, at = [], 0
    for pattern, n in patterns:
        offset = 0
        for length, copies in pattern:
            runs.append((length, used[length], used[length] + n * copies, copies, at, offset))
            used[length] += n * copies
            offset += length * copies
        at += n
    return np.array(sorted(runs), np.int64).reshape(-1, 6), at


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, ranks: str | None = None, end: int = END, salts: int | None = None) -> DataFrame:
    """All documents in as few sequences of at most ``capacity`` tokens as best fit finds.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    meta = written(pieces(docs, capacity, tokenizer, ranks, end), "pieces")
    salts = salts or min(MOST_SALTS, max(SALTS, meta.count() // SALT_PIECES))
    meta = meta.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    table = np.zeros((capacity + 1, salts), np.int64)
    for length, salt, n in meta.groupBy("length", "salt").count().collect():  # at most capacity * salts rows
        table[length, salt] = n
    runs, _ = solve(table.sum(axis=1), capacity)
    before = np.cumsum(table, axis=1) - table
    first = np.searchsorted(runs[:, 0], np.arange(capacity + 2))

    def place(parts):
        for batch in parts:
            length, salt, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "salt", "rank"))
            rank = rank - 1 + before[length, salt]
            which = np.empty(len(rank), np.int64)
            for x in np.unique(length):
                mine = length == x
                lo, hi = first[x], first[x + 1]
                which[mine] = lo + np.searchsorted(runs[lo:hi, 2], rank[mine], side="right")
            _, start, _, copies, sequence, offset = runs[which].T if len(which) else np.zeros((6, 0), np.int64)
            number, slot = np.divmod(rank - start, copies)
            kept = [batch.column(c) for c in ("doc_id", "piece", "start")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(length), batch.column("ids_crc32"), pa.array(sequence + number), pa.array(offset + slot * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = meta.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    return ranked.mapInArrow(released(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
