"""Language ID: script ranges narrow the candidates of a word, then Viterbi over
per-word scores with a switching penalty labels spans of mixed-language text.

Training counts hashed character 1- to 3-grams of the words of labelled documents
per language, on a sample bounded by ``train_docs`` documents a language (chosen
by a hash of doc_id, the same at every size of cluster). Prediction reads whole
texts and uses the text alone. A word's score is the sum of the log-probabilities
of its grams; languages never seen in the word's script are out.

Nulls and odd cases: null texts, texts without a letter and, if nothing could be
learnt, all texts get ``und`` with score 0; ties go to the language that sorts
first; repeated rows are judged each; a null doc_id or lang is never learnt from
and a null doc_id is not held out. Extra columns are ignored.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, released

UND = "und"
BUCKETS = 1 << 15
#: At most about so many documents a language are learnt from.
TRAIN_DOCS = 1000
#: What a change of language between two words costs, in nats.
SWITCH = 10.0
#: First and last code point of the scripts told apart.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
WORD = re.compile(r"[^\W\d_]+")


def script_of(word: str) -> str:
    code = ord(word[0])
    if 0x41 <= code <= 0x24F:
        return "latin"
    return next((name for name, lo, hi in SCRIPTS if lo <= code <= hi), "other")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 1- to 3-grams of words between boundary marks, all words at once:
    (characters x 3 buckets, which of them lie within their word, first character of each word)."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))
    buckets, state = np.empty((len(codes), 3), np.int64), np.zeros(len(codes), np.uint64)
    for n in range(3):
        state = mix64(state * np.uint64(31) + np.concatenate([codes[n:], np.zeros(n, np.uint64)]) + np.uint64(n))
        buckets[:, n] = state % np.uint64(BUCKETS)
    return buckets, left[:, None] > np.arange(3), starts


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # BUCKETS x languages
    scripts: dict[str, list[bool]]  # script -> which languages use it


def held_out(doc_id) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learns from documents with a text and a lang that are not held out."""
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and text is not null and lang is not null").where(~held_out("doc_id"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, train_docs / counts[k]))]) if langs else None
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), {})
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.where(place < share[F.col("lang")]).select("text", "lang")

    def count(parts):
        words: dict[str, dict[str, int]] = {}
        for batch in parts:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                own = words.setdefault(lang, {})
                for w in WORD.findall(text.lower()):
                    own[w] = own.get(w, 0) + 1
        table, seen = {}, {}
        for lang, own in words.items():
            row, names = np.zeros(BUCKETS), list(own)
            for at in range(0, len(names), 20_000):
                part = names[at : at + 20_000]
                buckets, inside, starts = grams(part)
                weight = np.repeat([own[w] for w in part], np.diff([*starts, len(buckets)]))
                row += np.bincount(buckets[inside], weights=np.broadcast_to(weight[:, None], inside.shape)[inside], minlength=BUCKETS)
            table[lang] = row
            for w, n in own.items():
                key = (lang, script_of(w))
                seen[key] = seen.get(key, 0) + n * len(w)
        rows = [(lang, "", int(b), int(row[b])) for lang, row in table.items() for b in np.flatnonzero(row)] + [(lang, s, -1, n) for (lang, s), n in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["lang", "script", "bucket", "n"])

    got = sample.mapInArrow(released(count), "lang string, script string, bucket long, n long").groupBy("lang", "script", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows a language
    at = {k: i for i, k in enumerate(langs)}
    table, scripts = np.zeros((BUCKETS, len(langs))), {}
    for lang, script, bucket, n in zip(*(got.column(c).to_pylist() for c in ("lang", "script", "bucket", "n")), strict=True):
        if bucket >= 0:
            table[bucket, at[lang]] = n
        else:
            scripts.setdefault(script, np.zeros(len(langs)))[at[lang]] = n
    letters = np.sum([*scripts.values(), np.zeros(len(langs))], axis=0)
    logp = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * BUCKETS))
    return Model(langs, logp, {s: (n >= 0.01 * np.maximum(letters, 1)).tolist() for s, n in scripts.items()})


class WordScores(dict):
    """word -> row in a growing score table; emptied when it gets large."""

    LIMIT = 200_000

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.rows, self.new = model, np.zeros((0, len(model.langs)), np.float32), []

    def __missing__(self, word):
        self[word] = number = len(self.rows) + len(self.new)
        self.new.append(word)
        return number

    def table(self) -> np.ndarray:
        """The scores of all words met so far: sums over grams, within the languages of the word's script."""
        if self.new:
            low, many = [w.lower() for w in self.new], max(100, 100_000 // len(self.model.langs))
            score = np.empty((len(low), len(self.model.langs)))
            for at in range(0, len(low), many):
                buckets, inside, starts = grams(low[at : at + many])
                each = self.model.logp[buckets[:, 0]]
                for n in (1, 2):
                    each = each + np.where(inside[:, n : n + 1], self.model.logp[buckets[:, n]], 0.0)
                score[at : at + many] = np.add.reduceat(each, starts, axis=0)
            numbers: dict[str, list[int]] = {}
            for k, w in enumerate(low):
                numbers.setdefault(script_of(w), []).append(k)
            for script, own in numbers.items():
                users = np.array(self.model.scripts.get(script, [False] * len(self.model.langs)))
                if users.any():
                    score[np.ix_(own, ~users)] = score[own].min() - 50.0
                else:
                    score[own] = 0
            self.rows = np.concatenate([self.rows, (score - score.max(axis=1, keepdims=True)).astype(np.float32)])
            self.new = []
        return self.rows

    def trim(self) -> None:
        if len(self.rows) > self.LIMIT:
            self.clear()
            self.rows = self.rows[:0]


def viterbi(paths: list[np.ndarray], table: np.ndarray, penalty: float) -> list[np.ndarray]:
    """Best language of every word of every document; documents of like length go step by step together."""
    langs = table.shape[1]
    out: list[np.ndarray] = [np.empty(0, np.uint8)] * len(paths)
    order = sorted(range(len(paths)), key=lambda i: -len(paths[i]))
    at = 0
    while at < len(order) and len(paths[order[at]]):
        longest = len(paths[order[at]])
        many = max(1, min(256, 2_000_000 // longest))
        group = [i for i in order[at : at + many] if len(paths[i])]
        at += many
        n = np.array([len(paths[i]) for i in group])
        alive = np.searchsorted(-n, -np.arange(longest), side="left")  # how many documents reach step t
        words = np.zeros((longest, len(group)), np.int32)
        for k, i in enumerate(group):
            words[: n[k], k] = paths[i]
        stay, switch = np.empty((longest, langs, len(group)), bool), np.empty((longest, len(group)), np.uint8)
        value = np.zeros((langs, len(group)), np.float64)
        for t in range(longest):
            d = alive[t]
            now = value[:, :d]
            best = now.argmax(axis=0)
            top = now.max(axis=0)
            floor = top - penalty
            stay[t, :, :d] = now >= floor
            switch[t, :d] = best
            value[:, :d] = np.maximum(now, floor) + table[words[t, :d]].T - top
        state = value.argmax(axis=0)
        label = np.empty((longest, len(group)), np.uint8)
        cols = np.arange(len(group))
        for t in range(longest - 1, -1, -1):
            d = alive[t]
            mine = state[:d]
            label[t, :d] = mine
            state[:d] = np.where(stay[t, mine, cols[:d]], mine, switch[t, :d])
        for k, i in enumerate(group):
            out[i] = label[: n[k], k]
    return out


def label_words(texts: list, scores: WordScores, penalty: float) -> tuple[list[list[str]], list[np.ndarray]]:
    """Words with a letter of each text and the language number of each word."""
    low = [t.lower() if t else "" for t in texts]
    words = [WORD.findall(t if len(t) == len(text or "") else text) for t, text in zip(low, texts, strict=True)]
    words = [ws if all(map(str.isalpha, ws)) else [w for w in ws if any(map(str.isalpha, w))] for ws in words]
    paths = [np.fromiter(map(scores.__getitem__, ws), np.int32, len(ws)) for ws in words]
    return words, viterbi(paths, scores.table(), penalty)


def judged(texts: list, scores: WordScores, model: Model, penalty: float) -> list[tuple[str, float]]:
    """(language, share of the letters in its spans) of each text."""
    out, langs = [], model.langs
    words, labels = label_words(texts if langs else [None] * len(texts), scores, penalty)
    for ws, label in zip(words, labels, strict=True):
        if not ws:
            out.append((UND, 0.0))
            continue
        weight = np.bincount(label, weights=np.fromiter(map(len, ws), np.float64, len(ws)), minlength=len(langs))
        out.append((langs[int(weight.argmax())], float(weight.max() / weight.sum())))
    scores.trim()
    return out


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH) -> DataFrame:
    """Adds lang_pred and score (share of the letters in spans of that language) to
    (doc_id, text) rows; only doc_id is kept of the input."""
    return _judge(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, penalty).drop("text")


def _judge(docs: DataFrame, model: Model, penalty: float) -> DataFrame:
    def run(parts):
        scores = WordScores(model)
        for batch in parts:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                names, shares = zip(*judged(part.column("text").to_pylist(), scores, model, penalty), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(shares, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(released(run), f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, lang_pred string, score double")


def predict(text: Column, model: Model, penalty: float = SWITCH) -> Column:
    """A struct (lang_pred, score) for a text column; other columns of a row stay in the JVM."""

    @F.pandas_udf("lang_pred string, score double")
    @released
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scores = WordScores(model)
        for column in columns:
            got = [pair for at in range(0, len(column), 2048) for pair in judged(column.iloc[at : at + 2048].tolist(), scores, model, penalty)]
            yield pd.DataFrame({"lang_pred": [p for p, _ in got], "score": [s for _, s in got]}, columns=["lang_pred", "score"])

    return run(text.cast("string"))


def has_letter(text: Column) -> Column:
    """Whether a text has a word that ``predict`` would judge, whatever the model."""

    @F.pandas_udf("boolean")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([any(any(map(str.isalpha, w)) for w in WORD.findall(text)) if text else False for text in column], dtype=bool)

    return run(text.cast("string"))


def language_spans(docs: DataFrame, model: Model, penalty: float = SWITCH) -> DataFrame:
    """Per span of one language: doc_id, start and end in code points, lang."""
    langs = model.langs

    def run(parts):
        scores = WordScores(model)
        for batch in parts:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                _, labels = label_words(texts if langs else [None] * len(texts), scores, penalty)
                rows = []
                for doc, text, label in zip(ids, texts, labels, strict=True):
                    spots = [m.span() for m in WORD.finditer(text or "") if any(map(str.isalpha, m[0]))] if len(label) else []
                    for k, (a, b) in enumerate(spots):
                        if k and label[k] == label[k - 1]:
                            rows[-1][2] = b
                        else:
                            rows.append([doc, a, b, langs[label[k]]])
                scores.trim()
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "start", "end", "lang"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), "doc_id long, start long, end long, lang string")
