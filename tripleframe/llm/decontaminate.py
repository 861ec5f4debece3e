"""Benchmark decontamination: size-partitioned MinHash containment search.

Words are runs of letters and digits, lower-cased: marks and layout don't hide a
leak. A test item leaks into a document if at least ``percent`` % of its distinct
5-word shingles are in the document (an item of fewer words counts as one
shingle of its words). Items are partitioned by size; for items of at most u
shingles a document is seen through overlapping windows of 2u shingles, which
turns containment in a long document into a Jaccard similarity of 0.19 or more
with one window, whatever the document's length. One of ``HASHES`` minima in
common makes a pair a candidate (an item in one piece is missed with a
probability of 2e-6); every candidate is verified by exact containment in the
whole document. Window minima of a size class come from those of the class below.

The items' minima are the only broadcast data: ``ITEM_BLOCK`` items at a time;
a larger benchmark is searched in as many passes.

Nulls and odd cases: null or wordless texts match nothing; ids may be null or
repeated, each row counts; empty tables give no rows; extra columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordStream, batches, released, shingles_of, written
from .near_dups import hash_family

SHINGLE, PERCENT = 5, 80
HASHES = 64
SMALLEST = 8
ITEM_BLOCK = 20_000
BITMAP = 1 << 22
PAIRS = "doc_id long, item_id long, item_shingles long, shared long, containment double"


class Index:
    """Minima of the items, by shingle length and size class."""

    def __init__(self, items: list[tuple], shingle: int, hashes: int):
        self.a, self.b = hash_family(hashes, seed=11)
        self.ids, self.sets, self.by = [], [], {}
        stream = WordStream()
        for item, text in items:
            words = stream(text)
            if not len(words):
                continue
            size = min(shingle, len(words))
            own = np.unique(shingles_of(words, size))
            u = max(SMALLEST, 1 << (len(own) - 1).bit_length())
            self.by.setdefault((size, u), []).append(len(self.ids))
            self.ids.append(item)
            self.sets.append(own)
        self.tables = {}
        for key, members in self.by.items():
            low = np.array([(self.sets[m][None, :] * self.a[:, None] + self.b[:, None]).min(axis=1) for m in members])
            low = low ^ np.arange(hashes, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)  # values of different functions apart
            flat, owner = low.ravel(), np.repeat(np.array(members), hashes)
            order = np.argsort(flat, kind="stable")
            seen = np.zeros(BITMAP, bool)
            seen[(flat & np.uint64(BITMAP - 1)).astype(np.int64)] = True
            self.tables[key] = (seen, flat[order], owner[order])
        del self.by

    def candidates(self, stream: np.ndarray, size: int) -> set[int]:
        """Numbers of the items that share a minimum with a window of the stream."""
        classes = sorted(u for s, u in self.tables if s == size)
        found: set[int] = set()
        salt = np.arange(len(self.a), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        step = classes[0]
        padded = np.concatenate([stream, np.repeat(stream[-1:], -len(stream) % step)])
        columns = np.ascontiguousarray(padded.reshape(-1, step).T)  # minima run along the first axis, many blocks at once
        blocks = np.empty((len(self.a), columns.shape[1]), np.uint64)
        wide = max(1, 2048 // step)
        for lo in range(0, columns.shape[1], wide):
            part = columns[None, :, lo : lo + wide]
            for i in range(0, len(self.a), 16):
                blocks[i : i + 16, lo : lo + wide] = (part * self.a[i : i + 16, None, None] + self.b[i : i + 16, None, None]).min(axis=1)
        for u in classes:
            while step < u:
                if blocks.shape[1] % 2:
                    blocks = np.concatenate([blocks, blocks[:, -1:]], axis=1)
                blocks = np.minimum(blocks[:, ::2], blocks[:, 1::2])
                step *= 2
            windows = (np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks) ^ salt[:, None]
            seen, values, owner = self.tables[size, u]
            hits = windows[seen[(windows & np.uint64(BITMAP - 1)).view(np.int64)]]
            if len(hits):
                lo, hi = np.searchsorted(values, hits), np.searchsorted(values, hits, side="right")
                for x, y in set(zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True)):
                    found.update(owner[x:y].tolist())
        return found


def leaks_in(text: str | None, index: Index, sizes: list[int], words_of: WordStream, percent: int) -> list[tuple[int, int]]:
    """(item number, shared shingles) of the items that leak into one text."""
    out, words = [], words_of(text)
    for size in sizes:
        if len(words) < size:
            continue
        stream = shingles_of(words, size)
        near = index.candidates(stream, size)
        whole = np.unique(stream) if near else None
        for item in sorted(near):
            own = index.sets[item]
            at = np.minimum(np.searchsorted(whole, own), len(whole) - 1)
            shared = int((whole[at] == own).sum())
            if 100 * shared >= percent * len(own):
                out.append((item, shared))
    return out


def _pass(docs: DataFrame, index: Index, percent: int) -> DataFrame:
    sizes = sorted({size for size, _ in index.tables})

    def run(parts):
        stream = WordStream()
        for batch in parts:
            for ids, texts in batches(batch, ["doc_id", "text"]):
                rows = [(doc, index.ids[item], len(index.sets[item]), shared, shared / len(index.sets[item])) for doc, text in zip(ids, texts, strict=True) for item, shared in leaks_in(text, index, sizes, stream, percent)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "item_shingles", "shared", "containment"])

    return docs.mapInArrow(released(run), PAIRS)


def holds_item(text: Column, index: Index, percent: int = PERCENT) -> Column:
    """Whether a text holds an item of the index; other columns of a row stay in the JVM."""
    sizes = sorted({size for size, _ in index.tables})

    @F.pandas_udf("boolean")
    @released
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        stream = WordStream()
        for column in columns:
            yield pd.Series([bool(leaks_in(t, index, sizes, stream, percent)) for t in column], dtype="bool")

    return run(text.cast("string"))


def item_blocks(benchmark: DataFrame, size: int):
    """The items in lists of at most ``size``; an empty benchmark gives one empty list."""
    block, any_ = [], False
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        block.append(tuple(row))
        if len(block) == size:
            yield block
            block, any_ = [], True
    if block or not any_:
        yield block


def clean_rows(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, hashes: int = HASHES, item_block: int = ITEM_BLOCK) -> DataFrame:
    """The whole rows that hold no item."""
    for k, block in enumerate(item_blocks(benchmark, item_block)):
        docs = written(docs, "clean") if k else docs
        docs = docs.where(~holds_item(docs["text"], Index(block, shingle, hashes), percent))
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, hashes: int = HASHES, item_block: int = ITEM_BLOCK) -> DataFrame:
    """Per document and leaked item: doc_id, item_id, item_shingles, shared, containment."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for block in item_blocks(benchmark, item_block):
        part = _pass(texts, Index(block, shingle, hashes), percent)
        if found is not None or len(block) == item_block:  # more passes: one index at a time
            part = written(part, "leaks")
        found = part if found is None else found.unionAll(part)
    return found
