"""Training-order materialisation of token ids in binary shards.

1. Each input partition tokenises its documents once; ids and an end mark follow
   each other and are cut into sequences of ``stride`` tokens (only the last of a
   partition may be shorter). The sequences are written to the shared folder.
2. Partition counts, one number a partition, give every sequence a global index.
3. A keyed Feistel network with cycle-walking permutes 0..N-1: index -> slot.
4. Shard ``slot // shard_slots`` is one file of fixed-stride records; each task
   writes whole shards, under a temporary name first, so that a lost or repeated
   task leaves the same files. A reader seeks to ``(slot - first) * stride * 2``.

Nulls and empty texts: a null text is an empty one and gives the end mark alone;
a null doc_id stays null in ``doc_ids``. Repeated rows are written each. An empty
table gives no rows and no files. Extra columns are ignored. A vocabulary with ids of
65535 or more is an error, as the records are 16 bits wide.

The index follows the order in which the input is read: the same files read in splits
of the same size get the same slots.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, fresh_path, mix64, written
from .tokens import make_encoder, tokenizer_files

STRIDE = 2048
SHARD_SLOTS = 4096
PAD = 0xFFFF
END = 50256
SAMPLES = 400
ROWS = "part int, place long, n_tokens int, doc_ids array<long>, ids binary"
FILED = "slot long, sequence long, shard int, byte_offset long, n_tokens int, doc_ids array<long>, path string"


def feistel(index: np.ndarray, size: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed bijection of 0..size-1: a balanced Feistel network on the next even
    number of bits; values outside walk on along their cycle until they are inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [mix64(np.array([(key * 0x9E3779B97F4A7C15 + r + 1) & (2**64 - 1)], np.uint64))[0] for r in range(rounds)]

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix64(right + k) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= size)):
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def travel_form(docs: DataFrame, stride: int, files: tuple, samples: int = SAMPLES) -> tuple[bytes, np.ndarray]:
    """A zstd dictionary and ids by frequency, from ``samples`` whole texts read in one task.
    They change how ids travel between stages (common ids as small numbers, compressed),
    never what is written."""

    def run(parts):
        import zstandard

        encode = make_encoder(*files)
        flow = sixteen_bits([i for batch in parts for (t,) in batches(batch, ["text"]) for x in t for i in encode(x)])
        order = np.argsort(-np.bincount(flow, minlength=1 << 16), kind="stable").astype("<u2")
        ranked = _inverse(order)[flow]
        pieces = [ranked[k : k + stride].tobytes() for k in range(0, len(flow) - stride, stride)]
        dictionary = zstandard.train_dictionary(112_640, pieces).as_bytes() if len(pieces) * stride * 2 >= 1_000_000 else b""
        yield pa.RecordBatch.from_arrays([pa.array([dictionary], pa.binary()), pa.array([order.tobytes()], pa.binary())], names=["dictionary", "by_count"])

    some = docs.where("text is not null").select(F.col("text").cast("string").alias("text")).limit(samples).coalesce(1)
    got = some.mapInArrow(run, "dictionary binary, by_count binary").collect()  # one row
    return (bytes(got[0]["dictionary"]), np.frombuffer(got[0]["by_count"], "<u2")) if got else (b"", np.arange(1 << 16, dtype="<u2"))


def sixteen_bits(ids: list[int]) -> np.ndarray:
    if ids and max(ids) >= PAD:
        raise ValueError(f"token id {max(ids)} does not fit a 16-bit record")
    return np.array(ids, "<u2")


def _inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty(1 << 16, "<u2")
    out[order] = np.arange(1 << 16, dtype="<u2")
    return out


def travel_codec(form: tuple[bytes, np.ndarray]):
    """(pack, unpack) for the bytes of uint16 ids."""
    import zstandard

    dictionary, order = form
    rank = _inverse(order)
    known = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    press, release = zstandard.ZstdCompressor(level=9, **known), zstandard.ZstdDecompressor(**known)
    return lambda data: press.compress(rank[np.frombuffer(data, "<u2")].tobytes()), lambda data: order[np.frombuffer(release.decompress(data), "<u2")].tobytes()


def token_sequences(docs: DataFrame, stride: int, files: tuple, end: int, form: tuple) -> DataFrame:
    """Per sequence: input partition, place in it, compressed ids (little-endian uint16), documents."""

    def run(parts):
        from pyspark import TaskContext

        encode, part = make_encoder(*files), TaskContext.get().partitionId()
        pack, _ = travel_codec(form)
        held, held_docs, place = np.empty(0, "<u2"), [], 0

        def frame(rows):
            return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) // 2 for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([pack(r[1]) for r in rows], pa.binary())], names=["part", "place", "n_tokens", "doc_ids", "ids"])

        for batch in parts:
            for ids, texts in batches(batch, ["doc_id", "text"]):
                new = [sixteen_bits([*encode(t), end] if t else [end]) for t in texts]
                ends = len(held) + np.cumsum([len(x) for x in new])
                starts = ends - [len(x) for x in new]
                flow = np.concatenate([held, *new])
                whole = len(flow) // stride
                first, last = starts // stride, (ends - 1) // stride
                of: list[list] = [[] for _ in range(len(flow) // stride + 1)]
                of[0] = list(held_docs)
                for doc, a, b in zip(ids, first.tolist(), last.tolist(), strict=True):
                    for k in range(a, b + 1):
                        of[k].append(doc)
                rows = [(place + k, flow[k * stride : (k + 1) * stride].tobytes(), of[k]) for k in range(whole)]
                place += whole
                held, held_docs = flow[whole * stride :], of[whole]
                for at in range(0, len(rows), 512):
                    yield frame(rows[at : at + 512])
        if len(held):
            yield frame([(place, held.tobytes(), held_docs)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ROWS)


def materialise(docs: DataFrame, key: int = 20_240_601, stride: int = STRIDE, shard_slots: int = SHARD_SLOTS, tokenizer: str | None = None, ranks: str | None = None, end: int = END, target: str | None = None) -> DataFrame:
    """Writes the shards and returns the manifest: per slot its sequence, shard,
    byte offset, number of tokens, documents and file."""
    spark = docs.sparkSession
    target = target or fresh_path(spark, "shards")
    files = tokenizer_files(tokenizer, ranks)
    form = travel_form(docs, stride, files)
    flow = written(token_sequences(docs, stride, files, end, form), "sequences")
    counts = dict(flow.groupBy("part").count().collect())  # one number an input partition
    parts = sorted(counts)
    first = np.zeros((max(parts) if parts else 0) + 1, np.int64)
    first[parts] = np.cumsum([0, *(counts[p] for p in parts)])[:-1]
    total = sum(counts.values())

    def number(parts):
        for batch in parts:
            index = first[batch.column("part").to_numpy()] + batch.column("place").to_numpy()
            slot = feistel(index, total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(index), pa.array((slot // shard_slots).astype("i4")), *(batch.column(c) for c in ("n_tokens", "doc_ids", "ids"))], names=["slot", "sequence", "shard", "n_tokens", "doc_ids", "ids"])

    def write(parts):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        _, unpack = travel_codec(form)
        now, out, temporary = None, None, None

        def finish():
            out.close()
            store.move(f"{root}/{temporary}", f"{root}/shard-{now:06d}.bin")

        for batch in parts:
            slots, shards, n = (batch.column(c).to_numpy() for c in ("slot", "shard", "n_tokens"))
            for shard, tokens, data in zip(shards.tolist(), n.tolist(), batch.column("ids"), strict=True):
                if shard != now:
                    if out is not None:
                        finish()
                    now, temporary = shard, f".shard-{shard:06d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{root}/{temporary}")
                out.write(unpack(data.as_py()))
                if tokens < stride:
                    out.write(np.full(stride - tokens, PAD, "<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("slot"), batch.column("sequence"), batch.column("shard"), pa.array((slots % shard_slots) * stride * 2), batch.column("n_tokens"), batch.column("doc_ids"), pa.array([f"{target}/shard-{s:06d}.bin" for s in shards.tolist()], pa.string())], names=["slot", "sequence", "shard", "byte_offset", "n_tokens", "doc_ids", "path"])
        if out is not None:
            finish()

    numbered = flow.mapInArrow(number, "slot long, sequence long, shard int, n_tokens int, doc_ids array<long>, ids binary")
    shards = max(1, -(-total // shard_slots))
    ranged = numbered.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")  # partition k is slot range k
    return written(ranged.mapInArrow(write, FILED), "manifest")


def read_shards(manifest: DataFrame, stride: int = STRIDE) -> DataFrame:
    """Reads every slot of the manifest back from its file: adds ``ids`` (binary,
    little-endian uint16, without padding)."""

    def read(parts):
        from pyarrow import fs

        opened, now = None, None
        for batch in parts:
            got = []
            for path, offset, n in zip(*(batch.column(c).to_pylist() for c in ("path", "byte_offset", "n_tokens")), strict=True):
                if path != now:
                    store, where = fs.FileSystem.from_uri(path)
                    opened, now = store.open_input_file(where), path
                got.append(opened.read_at(n * 2, offset))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*batch.schema.names, "ids"])

    return manifest.mapInArrow(read, FILED + ", ids binary")


def read_from(path: str, slot: int, n: int, stride: int = STRIDE, shard_slots: int = SHARD_SLOTS) -> list[np.ndarray]:
    """Up to ``n`` slots of one shard file from ``slot`` on, with one seek: how a trainer resumes."""
    from pyarrow import fs

    store, where = fs.FileSystem.from_uri(path)
    with store.open_input_file(where) as f:
        data = np.frombuffer(f.read_at(n * stride * 2, (slot % shard_slots) * stride * 2), "<u2")
    return [row[row != PAD] for row in data.reshape(-1, stride)]
