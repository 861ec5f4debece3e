"""MinHash near-dedup: universal hash minima, banding, signature verification, exact
confirmation, and connected components by alternating large-star and small-star.

Every document becomes the set of its distinct word shingles. Two documents are
linked if ``100 * |A & B| >= percent * |A | B|``; a group is a connected component.

* Documents with equal sets are one class, found by a 128-bit fingerprint and an
  ordinary aggregate; only the class representative (smallest doc_id) goes on. Its
  signature stays in the features; texts are read anew, in place, for the few
  documents whose full sets are needed. Neither is shuffled as a whole.
* ``BANDS * ROWS`` minima of functions a*x+b mod 2**64; equal bands put
  representatives in one bucket. At Jaccard 0.8 a pair misses all 40 bands of 6
  with probability 5e-6.
* Round 1 pairs each representative with the bucket heads (two a bucket) that its
  signature resembles most, at most ``TRIES``, so a large group of near copies
  costs a few pairs a member; each pair is confirmed on the full sets of 64-bit
  shingle hashes.
* Round 2 takes the buckets that still hold several components and compares all
  members of different components, in blocks of about ``BLOCK`` bytes: signatures
  first, then the full sets, each pair in the first band it shares. A task returns
  a spanning forest of the links it confirms, so no more rows than members.

Nulls and odd cases: a null, empty or blank text has no shingles and links with
nothing; a text shorter than a shingle counts as one shingle; rows with a null
doc_id get null component and are kept; rows that repeat a doc_id are one node
that has the links of each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import KeyFilter, WordHashes, anti_join, ascii_words, batches, discard, mix64, released, semi_join, shingle_hashes, written

BANDS, ROWS = 40, 6
#: About so many bytes of members are compared with so many others in one task.
BLOCK = 3_000_000
TRIES = 3
#: Signatures must agree in this much less than the wanted share: four standard deviations.
SLACK = 0.11
FEATURES = "doc_id long, n_shingles long, fp binary, bands array<long>, sig binary"


def hash_family(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``n`` universal hash functions on 64 bits."""
    x = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return x[:n] | np.uint64(1), x[n:]


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each function over the set; 2048 hashes at a time stay in the CPU's cache."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048]
        for lo in range(0, len(a), 16):
            got = (part[None, :] * a[lo : lo + 16, None] + b[lo : lo + 16, None]).min(axis=1)
            np.minimum(out[lo : lo + 16], got, out=out[lo : lo + 16])
    return out


def features(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: size of its set, fingerprint of the set, 64-bit band keys and 8-bit signature."""

    def run(parts):
        import xxhash

        cache, (a, b) = WordHashes(), hash_family(bands * rows)
        for batch in parts:
            for ids, texts in batches(batch, ["doc_id", "text"]):
                out = ([], [], [], [], [])
                for doc, text in zip(ids, texts, strict=True):
                    hashes = shingle_hashes(ascii_words(text), size, cache)
                    out[0].append(doc)
                    out[1].append(len(hashes))
                    if len(hashes):
                        low = minima(hashes, a, b)
                        keys = np.full(bands, 1, np.uint64)
                        for r in range(rows):
                            keys = mix64(keys * np.uint64(31) + low[r::rows])
                        keys = mix64(keys + np.arange(bands, dtype=np.uint64))
                        out[2].append(xxhash.xxh3_128_digest(hashes.tobytes()))
                        out[3].append(keys.view(np.int64))
                        out[4].append((mix64(low) >> np.uint64(56)).astype(np.uint8).tobytes())
                    else:
                        for c in out[2:]:
                            c.append(None)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["doc_id", "n_shingles", "fp", "bands", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), FEATURES)


def set_table(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, fingerprint and the sorted shingle hashes as bytes."""

    def run(parts):
        import xxhash

        cache = WordHashes()
        for batch in parts:
            for ids, texts in batches(batch, ["doc_id", "text"], 64):
                sets = [shingle_hashes(ascii_words(t), size, cache).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["doc_id", "fp", "hashes"])

    return docs.mapInArrow(released(run), "doc_id long, fp binary, hashes binary")


def agreement(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Adds ``alike``, the share of equal minima, to pairs (a, b)."""

    def run(parts):
        for batch in parts:
            got = [float(np.mean(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8))) for x, y in zip(batch.column("sig_a").to_pylist(), batch.column("sig_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(got, pa.float64())], names=["a", "b", "alike"])

    both = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.mapInArrow(released(run), "a long, b long, alike double")


def enough(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are alike enough."""
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(short) < percent * len(long):
        return False
    at = np.searchsorted(long, short)
    common = int(np.sum(long[np.minimum(at, len(long) - 1)] == short))
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""

    def run(parts):
        for batch in parts:
            keep = [enough(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("set_a")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(released(run), "a long, b long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge; component is its smallest node.

    Alternates small-star and large-star until the edges stay the same. A star step
    sends, for each node, its neighbours to the smallest of them and itself; both
    are an aggregate (which combines before the shuffle) and a join.
    """
    now = written(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct(), "edges")
    state = None
    while True:
        # Each star deals its edges once; the aggregate and the join share that exchange.
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select("hi", "lo")).repartition("u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").repartition("hi")
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).union(down.select("m", "hi")).where("lo < hi").distinct()
        last, now = now, written(small.select("lo", "hi"), "edges")
        discard(last)
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("s")).first()
        if state == (row["n"], row["s"]):
            break
        state = (row["n"], row["s"])
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())


def block_links(placed: DataFrame, facts: DataFrame, sets: DataFrame, floor: float, percent: int) -> DataFrame:
    """Links between members of one bucket in different components.

    placed: bucket, band, doc_id, component; facts: doc_id, fp, size, bands, sig; sets:
    doc_id, fp, hashes. A component of more than BLOCK bytes has blocks of its own,
    smaller ones share blocks; a task gets two blocks, and pairs of blocks of one large
    component are left out.
    """
    weight = facts.groupBy("doc_id").agg(F.sum(8 * F.col("size") + 2000).alias("weight"))
    slim = placed.join(weight, "doc_id").select("bucket", "band", "doc_id", "component", "weight")
    sizes = slim.groupBy("bucket", "component").agg(F.sum("weight").alias("n"))
    split = F.when(F.col("n") > BLOCK, F.concat_ws(":", F.col("component"), F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / BLOCK))))
    total = sizes.where(F.col("n") <= BLOCK).groupBy("bucket").agg(F.sum("n").alias("small"))
    keyed = slim.join(sizes, ["bucket", "component"]).join(total, "bucket", "left")
    keyed = keyed.withColumn("block", F.coalesce(split, F.concat_ws(":", F.lit("s"), F.pmod(F.xxhash64("component"), F.ceil(F.col("small") / BLOCK)))))
    keyed = keyed.withColumn("own", F.when(F.col("n") > BLOCK, F.col("component"))).select("bucket", "band", "doc_id", "component", "block", "own")
    blocks = keyed.select("bucket", "block", "own").distinct()
    other = blocks.select("bucket", F.col("block").alias("block2"), F.col("own").alias("own2"))
    tasks = blocks.join(other, "bucket").where("block <= block2").where("own is null or own2 is null or own <> own2").select("bucket", "block", "block2")
    sides = tasks.select("bucket", F.col("block").alias("take"), "block", "block2", F.lit(0).alias("side")).union(tasks.where("block <> block2").select("bucket", F.col("block2"), "block", "block2", F.lit(1)))
    dealt = keyed.withColumnRenamed("block", "take").join(sides, ["bucket", "take"]).select("bucket", "band", "block", "block2", "side", "doc_id", "component")

    def promising(sigs, keys, sizes, comp, side, band):
        """For each left row: the right rows that may be alike enough, the most alike first."""
        two = side.any()
        right = np.flatnonzero(side == 1) if two else np.arange(len(side))
        for i in np.flatnonzero(side == 0) if two else range(len(side)):
            other = right if two else right[i + 1 :]
            other = other[(comp[other] != comp[i]) & (100 * np.minimum(sizes[other], sizes[i]) >= percent * np.maximum(sizes[other], sizes[i]))]
            if len(other):
                alike = (sigs[other] == sigs[i]).mean(axis=1)
                good = np.flatnonzero((alike >= floor) & ((keys[other] == keys[i]).argmax(axis=1) == band[i]))
                if len(good):
                    yield i, other[good[np.argsort(-alike[good], kind="stable")]]

    def columns(table):
        comp, side, band, sizes = (table.column(c).to_numpy() for c in ("component", "side", "band", "size"))
        sigs = np.stack([np.frombuffer(x, np.uint8) for x in table.column("sig").to_pylist()])
        keys = np.stack([np.asarray(x) for x in table.column("bands").to_numpy()])
        return sigs, keys, sizes, comp, side, band

    def select(table):
        hit = np.zeros(table.num_rows, bool)
        for i, others in promising(*columns(table)):
            hit[i] = True
            hit[others] = True
        return table.filter(pa.array(hit))

    def compare(table):
        ids, comp = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        group = {int(c): int(c) for c in comp}

        def root(c):
            while group[c] != c:
                group[c] = group[group[c]]
                c = group[c]
            return c

        a, b = [], []
        for i, others in promising(*columns(table)):
            for j in others:
                x, y = root(int(comp[i])), root(int(comp[j]))
                if x != y and enough(sets[i], sets[j], percent):
                    group[x] = y
                    a.append(min(int(ids[i]), int(ids[j])))
                    b.append(max(int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    # Signatures go to all tasks first; full sets only to those of documents that pass there.
    task = ["bucket", "block", "block2"]
    light = dealt.join(facts, "doc_id").select(*task, "band", "side", "doc_id", "component", "fp", "size", "bands", "sig")
    chosen = written(light.groupBy(*task).applyInArrow(select, light.schema), "promising")
    links = written(chosen.join(sets, ["doc_id", "fp"]).groupBy(*task).applyInArrow(compare, "a long, b long").distinct(), "links")
    discard(chosen)
    return links


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id of its group), kept."""
    found = written(features(docs, shingle, bands, rows), "features")
    floor = max(0.0, percent / 100 - SLACK)
    real = found.where("fp is not null and doc_id is not null")
    classes = written(real.groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")  # written, so that a skewed join below can be split
    member = written(real.select("doc_id", "fp").join(classes, "fp").select("doc_id", "fp", "rep"), "classes")
    sides = written(member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.count("*").alias("n")).where("n > 1"), "repeated")  # a repeated doc_id may have two texts
    twice = member.join(sides.where("a < b").drop("n"), "doc_id").select("a", F.col("rep").alias("b")).where("a < b")
    # A row that repeats a doc_id and text may stay twice here; pairs and links are distinct later.
    reps = anti_join(real, member.where("doc_id <> rep").select("doc_id", "fp"), ["doc_id", "fp"])

    # Dealt once, for the aggregate and the join: both read the same three columns (a bucket has one band).
    rows_of = reps.select("doc_id", F.posexplode("bands").alias("band", "bucket")).repartition("bucket")
    some_of = F.min(F.struct(F.xxhash64("doc_id", "bucket"), F.col("doc_id").alias("id")))["id"]
    crowded = rows_of.groupBy("bucket").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail"), some_of.alias("other"), F.min("band").alias("least")).where("head < tail").drop("tail")
    buckets = written(rows_of.join(crowded, "bucket").where("band >= least").drop("least"), "buckets")
    some = written(buckets.select("doc_id").distinct(), "members")
    facts = written(semi_join(reps, some, ["doc_id"]).select("doc_id", "fp", F.col("n_shingles").alias("size"), "bands", "sig"), "signatures")

    heads = buckets.select(F.col("doc_id").alias("b"), F.explode(F.array("head", "other")).alias("a")).where("a <> b")
    heads = heads.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b")  # round 2 sees the pairs of one band
    first = agreement(heads, facts).where(F.col("alike") >= floor)
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("alike"), "a"))
    best = written(first.withColumn("rank", rank).where(F.col("rank") <= TRIES).select("a", "b"), "pairs")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    again = KeyFilter(sides, ["doc_id"]).maybe()

    def sets_of(ids):
        """Sets of (at least) some documents, each once; where a doc_id has several texts, each."""
        got = written(set_table(texts.where(KeyFilter(ids, ["doc_id"]).maybe()), shingle), "sets")
        return got.where(~again).unionAll(got.where(again).dropDuplicates())

    alike = written(best.select(F.col("a").alias("doc_id")).union(best.select("b")).distinct(), "alike")
    sets = sets_of(alike)
    links = written(confirmed(best, sets, percent).union(twice), "links")
    groups = written(components(links), "groups")
    discard(best, links)

    placed = buckets.join(groups, F.col("doc_id") == F.col("node"), "left").select("bucket", "band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    placed = written(placed.join(mixed, "bucket"), "mixed")
    more = written(placed.select("doc_id").distinct().join(alike, "doc_id", "left_anti"), "alike")
    sets = sets.unionAll(sets_of(more).join(more, "doc_id", "left_semi"))
    extra = block_links(placed, facts, sets, floor, percent)
    discard(placed, buckets, facts, some, alike, more)
    if not extra.isEmpty():  # components of components: the second graph has the new links only
        of = lambda side, name: groups.select(F.col("node").alias(side), F.col("component").alias(name))
        joined = extra.join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        above = written(components(joined), "groups").select(F.col("node").alias("component"), F.col("component").alias("top"))
        moved = groups.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        fresh = above.join(groups, above["component"] == groups["node"], "left_anti").select(F.col("component").alias("node"), F.col("top").alias("component"))
        groups = written(moved.union(fresh), "groups")

    of = member.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(groups, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    out = found.select("doc_id", "n_shingles").join(of, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
