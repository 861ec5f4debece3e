"""LM scoring by masked pseudo-likelihood.

Every word is predicted from the ``SIDE`` words on either side of it by a small
window network (position-wise input tables, tanh layer, two-level softmax)
trained in numpy; the sum of the conditional log-probabilities scores a document.

* Words are counted over all documents. There are as many classes as the square root
  of the number of word types, at least ``CLASSES`` and at most 65025. The most frequent
  words have a class of their own; any other word falls in one of ``TAILS`` classes by
  its ending, in which it is as likely as its share of that class's tokens: the counts
  of all these words are joined to their places in the documents.
* Class ids are written once. Training makes ``rounds`` passes over all documents;
  in each, every partition runs SGD over all positions of its documents (``share``
  below 1 takes a keyed share of them), a lot of documents in mixed order, and the parameters are averaged by weight in two levels, so the driver
  gets about the square root of the number of partitions of them.
* Scoring reads every position of every document.

Every partition trains its own copy from the same start, so scores depend a little on
how the input is split: the same files read in splits of the same size give the same.

Nulls and odd cases: texts without words (null, empty) score 0 with 0 words; a
document's edge is seen as a padding class; repeated rows are scored each; a null
doc_id stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordStream, batches, mix64, written

GROUPS = 32
CLASSES = GROUPS * GROUPS
TAILS = 64
WORDS = CLASSES - TAILS
SIDE = 2
HIDDEN = 32
ROUNDS = 1
SHARE = 1.0
GROWS = 1024
PAD = CLASSES


def words_and_tails(stream: WordStream, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number (0 to TAILS - 1) of its last two characters."""
    codes, starts, ends = stream.spans(text)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    last = codes[ends - 1].astype(np.uint64)
    before = np.where(ends - starts > 1, codes[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    return stream.hashes(codes, starts, ends), (mix64(last * np.uint64(0x110000) + before) % np.uint64(TAILS)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word hash, tail, n) over all documents; counted in each task first, in tables of bounded size."""

    def run(parts):
        stream = WordStream()
        held: list[tuple] = []
        size = 0

        def merged():
            words, tails, n = (np.concatenate(c) for c in zip(*held, strict=True))
            own, first, where = np.unique(words, return_index=True, return_inverse=True)
            return own, tails[first], np.bincount(where, n, len(own)).astype(np.int64)

        def rows(words, tails, n):
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(tails.astype(np.int32)), pa.array(n)], names=["word", "tail", "n"])

        for batch in parts:
            for (texts,) in batches(batch, ["text"]):
                both = [words_and_tails(stream, t) for t in texts]
                words, tails = np.concatenate([w for w, _ in both]), np.concatenate([t for _, t in both])
                held.append((words, tails, np.ones(len(words), np.int64)))
                size += len(words)
                if size > 1_500_000:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > 700_000:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*merged())

    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word long, tail int, n long")
    return counts.groupBy("word").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    words: np.ndarray  # hashes of the words with a class of their own, sorted
    classes: np.ndarray  # their classes
    spread: np.ndarray  # per class: log of the number of tokens that share it, 0 for a word's own
    groups: int = GROUPS  # there are groups * groups classes, the last TAILS of them for endings

    def of(self, words: np.ndarray, tails: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return self.groups**2 - TAILS + tails
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.classes[at], self.groups**2 - TAILS + tails)


def groups_for(types: int) -> int:
    """Class groups for a number of word types; class ids are 16 bits wide."""
    return min(255, max(GROUPS, int(np.ceil(types**0.25))))


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    """counts: the table of ``word_counts``, where it is written already."""
    counts = written(word_counts(docs), "word-counts") if counts is None else counts
    types, tokens = 0, [0] * TAILS
    for r in counts.groupBy("tail").agg(F.count("*").alias("types"), F.sum("n").alias("n")).collect():  # TAILS rows
        types, tokens[r["tail"]] = types + r["types"], r["n"]
    groups = groups_for(types)
    top = counts.orderBy(F.desc("n"), "word").limit(groups**2 - TAILS).collect()
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    for r in top:
        tokens[r["tail"]] -= r["n"]
    spread = np.concatenate([np.zeros(groups**2 - TAILS), np.log(np.maximum(np.array(tokens, np.float64), 1.0))])
    return Vocabulary(words[order], order, spread, groups)


def class_ids(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Number of the row, doc_id, the classes of all its words as little-endian uint16
    and the hashes of those without a class of their own as little-endian uint64."""

    def run(parts):
        from pyspark import TaskContext

        stream, row = WordStream(), TaskContext.get().partitionId() << 40
        for batch in parts:
            for ids, texts in batches(batch, ["doc_id", "text"]):
                got, rest = [], []
                for text in texts:
                    words, tails = words_and_tails(stream, text)
                    classes = vocab.of(words, tails)
                    got.append(classes.astype("<u2").tobytes())
                    rest.append(words[classes >= vocab.groups**2 - TAILS].astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array(got, pa.binary()), pa.array(rest, pa.binary())], names=["row", "doc_id", "classes", "rest"])
                row += len(ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "row long, doc_id long, classes binary, rest binary")


def rest_scores(ids: DataFrame, counts: DataFrame) -> DataFrame:
    """(row, log_n): sum of log n(word) over a row's words without a class of their own."""

    def run(parts):
        for batch in parts:
            for rows, blobs in batches(batch, ["row", "rest"]):
                each = [np.unique(np.frombuffer(b, "<i8"), return_counts=True) for b in blobs]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(rows, np.int64), [len(w) for w, _ in each])), pa.array(np.concatenate([w for w, _ in each])), pa.array(np.concatenate([k for _, k in each]).astype(np.int64))], names=["row", "word", "k"])

    # Whole numbers, so that the sum does not depend on the order of the rows.
    log_n = F.round(F.log("n") * F.lit(2.0**32)).cast("long")
    places = ids.select("row", "rest").mapInArrow(run, "row long, word long, k long")
    # The log of a single occurrence is 0: such words, most of the types, needn't be joined.
    return places.join(counts.where("n > 1").select("word", log_n.alias("log_n")), "word").groupBy("row").agg((F.sum(F.col("k") * F.col("log_n")) / F.lit(2.0**32)).alias("log_n"))


class Network:
    """Tables for the 2 * SIDE neighbours, a tanh layer, softmax over groups and within the group."""

    def __init__(self, flat: np.ndarray | None = None, seed: int = 5, groups: int = GROUPS):
        self.groups = groups
        shapes = [(2 * SIDE, groups**2 + 1, HIDDEN), (HIDDEN,), (HIDDEN, groups), (groups,), (groups, HIDDEN, groups), (groups, groups)]
        sizes = [int(np.prod(s)) for s in shapes]
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([(rng.normal(0, 0.2, n) if len(s) > 1 else np.zeros(n)).astype(np.float32) for n, s in zip(sizes, shapes, strict=True)])
        self.flat = flat
        at = np.cumsum([0, *sizes])
        self.table, self.bias, self.out, self.out_bias, self.inner, self.inner_bias = (flat[a:b].reshape(s) for a, b, s in zip(at[:-1], at[1:], shapes, strict=True))

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.table[0].take(context[0], axis=0)
        for k in range(1, 2 * SIDE):
            total += self.table[k].take(context[k], axis=0)
        total += self.bias
        return np.tanh(total, out=total)

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order = np.argsort(target.astype(np.uint16), kind="stable")  # a radix sort; class ids fit
        rows, h = np.arange(len(target)), self.hidden(context[:, order])
        group, inner = np.divmod(target[order], self.groups)
        score = h @ self.out + self.out_bias
        got = score[rows, group] - _log_sum(score)
        for g, a, b in _spans(group):
            np.matmul(h[a:b], self.inner[g], out=score[a:b])
        score += self.inner_bias[group]
        got += score[rows, inner] - _log_sum(score)
        out = np.empty_like(got)
        out[order] = got
        return out

    def step(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One SGD step on a small batch."""
        order = np.argsort(target.astype(np.uint16), kind="stable")  # a radix sort; class ids fit
        n, context, (group, inner) = len(target), context[:, order], np.divmod(target[order], self.groups)
        rows, ones, rate = np.arange(n), np.ones(n, np.float32), np.float32(rate / n)
        h = self.hidden(context)
        d_out = _softmax(h @ self.out + self.out_bias)
        d_out[rows, group] -= 1
        spans = _spans(group)
        own, starts = [g for g, _, _ in spans], [a for _, a, _ in spans]
        d_in = np.empty((n, self.groups), np.float32)
        for g, a, b in spans:
            np.matmul(h[a:b], self.inner[g], out=d_in[a:b])
        d_in += self.inner_bias.take(group, axis=0)
        d_in = _softmax(d_in)
        d_in[rows, inner] -= 1
        d_h, back, slope = d_out @ self.out.T, np.empty_like(h), np.empty((len(own), HIDDEN, self.groups), np.float32)
        for i, (g, a, b) in enumerate(spans):
            np.matmul(d_in[a:b], self.inner[g].T, out=back[a:b])
            np.matmul(h[a:b].T, d_in[a:b], out=slope[i])
        d_h += back
        slope *= rate
        self.inner[own] -= slope
        self.inner_bias[own] -= rate * np.add.reduceat(d_in, starts, axis=0)
        d_h *= 1 - h * h
        self.out -= rate * (h.T @ d_out)
        self.out_bias -= rate * (ones @ d_out)
        self.bias -= rate * (ones @ d_h)
        d_h *= rate
        pairs = d_h.view(np.complex64)  # two columns at a time halve the calls that reduceat makes
        for k in range(2 * SIDE):
            order = np.argsort(context[k].astype(np.uint16), kind="stable")
            cell = context[k][order]
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            self.table[k][cell[first]] -= np.add.reduceat(pairs.take(order, axis=0), first, axis=0).view(np.float32)


def _spans(group: np.ndarray) -> list[tuple[int, int, int]]:
    """(group, first, end) of each run of a sorted array."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    return list(zip(group[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True))


#: Scores within this need no shift before exp in single precision.
SAFE = 60.0


def _tops(score: np.ndarray) -> np.ndarray | None:
    """The maximum of each row, or None where exp of all scores is safe without it."""
    if not score.size or (score.max() < SAFE and score.min() > -SAFE):
        return None
    return score.max(axis=1)


def _log_sum(score: np.ndarray) -> np.ndarray:
    """Log of the sum of exp of each row; overwrites ``score``."""
    top = _tops(score)
    if top is not None:
        score -= top[:, None]
    np.exp(score, out=score)
    out = np.log(score @ np.ones(score.shape[1], score.dtype))
    return out if top is None else top + out


def _softmax(score: np.ndarray) -> np.ndarray:
    """In place."""
    top = _tops(score)
    if top is not None:
        score -= top[:, None]
    np.exp(score, out=score)
    score *= (1 / (score @ np.ones(score.shape[1], score.dtype)))[:, None]
    return score


def windows(docs: list[np.ndarray], pad: int = PAD) -> tuple[np.ndarray, np.ndarray]:
    """Contexts (2 * SIDE x positions) and targets of all positions of some documents."""
    gap = np.full(SIDE, pad, np.int64)
    flow = np.concatenate([gap, *(x for d in docs for x in (d.astype(np.int64), gap))])
    at = np.flatnonzero(flow != pad)
    return np.stack([flow[at + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))]), flow[at]


def averaged(blobs: list[bytes], weights: list[float]) -> np.ndarray:
    total = sum(weights) or 1.0
    out = np.zeros(len(blobs[0]) // 4)
    for blob, weight in zip(blobs, weights, strict=True):
        out += np.frombuffer(blob, np.float32) * (weight / total)
    return out.astype(np.float32)


def train(ids: DataFrame, rounds: int = ROUNDS, share: float = SHARE, rate: float = 2.0, batch_size: int = 256, seed: int = 5, groups: int = GROUPS) -> Network:
    """Parameter-averaged SGD; ids: doc_id, classes, as written to files. After GROWS batches
    of a partition, batches are four times as large and the rate half as much again."""
    net = Network(seed=seed, groups=groups)
    parts = max(1, ids.rdd.getNumPartitions())
    fan = max(1, int(np.ceil(np.sqrt(parts))))
    for turn in range(rounds):
        start = net.flat

        def run(batches_, start=start, turn=turn):
            from pyspark import TaskContext

            own, part, seen = Network(start.copy(), groups=groups), TaskContext.get().partitionId(), 0
            rng = np.random.default_rng([seed, turn, part])
            held_c, held_t, held = [], [], 0

            def learn(last=False):
                nonlocal held_c, held_t, held
                context, target = np.concatenate(held_c, axis=1), np.concatenate(held_t)
                mixed = rng.permutation(held)
                size, speed = (4 * batch_size, 1.5 * rate) if seen > GROWS * batch_size else (batch_size, rate)
                for lo in range(0, held if last else held - held % size, size):
                    now = mixed[lo : lo + size]
                    own.step(context[:, now], target[now], speed / (1 + turn) * (len(now) / min(size, seen)))
                left = mixed[held - held % size :]  # goes with the next lot
                held_c, held_t, held = [context[:, left]], [target[left]], len(left)

            for batch in batches_:
                for (blobs,) in batches(batch, ["classes"]):
                    context, target = windows([np.frombuffer(b, "<u2") for b in blobs], groups**2)
                    if share < 1:
                        key = mix64(np.arange(len(target), dtype=np.uint64) + np.uint64(seen * 31 + turn * 1_000_003 + part))
                        pick = np.flatnonzero(key.astype(np.float64) < share * 2.0**64)
                        context, target = context[:, pick], target[pick]
                    seen += len(target)
                    held_c.append(context)
                    held_t.append(target)
                    held += len(target)
                    if held >= 8192:
                        learn()
            if held:
                learn(last=True)
            yield pa.RecordBatch.from_arrays([pa.array([part % fan], pa.int32()), pa.array([float(seen)], pa.float64()), pa.array([own.flat.tobytes()], pa.binary())], names=["lot", "weight", "blob"])

        def merge(table):
            weights = table.column("weight").to_pylist()
            return pa.table({"weight": [sum(weights)], "blob": pa.array([averaged(table.column("blob").to_pylist(), weights).tobytes()], pa.binary())})

        got = ids.select("classes").mapInArrow(run, "lot int, weight double, blob binary").groupBy("lot").applyInArrow(merge, "weight double, blob binary").collect()  # at most ``fan`` rows
        if got:
            net = Network(averaged([r["blob"] for r in got], [r["weight"] for r in got]), groups=groups)
    return net


def score(ids: DataFrame, net: Network, spread: np.ndarray) -> DataFrame:
    """Per document: row, doc_id, n_words, log_likelihood (natural log, summed), mean;
    words without a class of their own are as likely as 1 / tokens of their class."""
    flat, groups = net.flat, net.groups

    def run(parts):
        own = Network(flat, groups=groups)
        for batch in parts:
            for rows, docs, blobs in batches(batch, ["row", "doc_id", "classes"], 64):
                arrays = [np.frombuffer(b, "<u2") for b in blobs]
                context, target = windows(arrays, groups**2)
                each = np.empty(len(target))
                for lo in range(0, len(target), 4096):  # stays in the CPU's cache
                    each[lo : lo + 4096] = own.log_probability(context[:, lo : lo + 4096], target[lo : lo + 4096])
                each -= spread[target]
                n = np.array([len(a) for a in arrays], np.int64)
                sums = np.zeros(len(n))
                full = np.flatnonzero(n)
                if len(full):
                    sums[full] = np.add.reduceat(each, (np.cumsum(n) - n)[full])
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(docs, pa.int64()), pa.array(n), pa.array(sums), pa.array(sums / np.maximum(n, 1))], names=["row", "doc_id", "n_words", "log_likelihood", "mean"])

    return ids.select("row", "doc_id", "classes").mapInArrow(run, "row long, doc_id long, n_words long, log_likelihood double, mean double")


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS, share: float = SHARE) -> DataFrame:
    """Vocabulary, training and scoring over all of ``docs``."""
    counts = written(word_counts(docs), "word-counts")
    vocab = vocabulary(docs, counts)
    ids = written(class_ids(docs, vocab), "classes")
    scores = score(ids, train(ids, rounds, share, groups=vocab.groups), vocab.spread).join(rest_scores(ids, counts), "row", "left")
    whole = F.col("log_likelihood") + F.coalesce("log_n", F.lit(0.0))
    return scores.select("doc_id", "n_words", whole.alias("log_likelihood"), (whole / F.greatest("n_words", F.lit(1))).alias("mean"))
