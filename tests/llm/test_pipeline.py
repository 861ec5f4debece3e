"""The corpus pipeline against brute force, stage by stage."""

import zlib

import corpus_pipeline
from tests_helpers import brute_near_kept, plain_words

from tripleframe.llm import langid

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    one = corpus_pipeline.language_id(spark, docs, SF)
    assert one.columns == docs.columns
    kept = {r["doc_id"] for r in one.collect()}
    assert kept == {d for d, t in rows.items() if t and any(c.isalpha() for c in t)}
    two = corpus_pipeline.near_dedup(spark, one, SF)
    assert two.columns == docs.columns
    kept = brute_near_kept({d: rows[d] for d in kept}, 5)
    assert {r["doc_id"] for r in two.collect()} == kept
    three = corpus_pipeline.decontamination(spark, two, SF)
    items = [plain_words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items if len(w) >= 5]

    def leaks(text):
        w = plain_words(text)
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        return any(100 * len(g & own) >= 80 * len(g) for g in grams)

    kept = {d for d in kept if not leaks(rows[d])}
    assert {r["doc_id"] for r in three.collect()} == kept
    last = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in last.collect()} == kept


def test_odd_rows_pass_the_stages(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the plain words of a text", "en", "s", 1), (1, "the plain words of a text", "en", "s", 1), (None, "more words here", None, None, None), (2, None, "en", None, None), (3, "77", "en", None, 2)]
    docs = spark.createDataFrame(rows, schema)
    out = corpus_pipeline.language_id(spark, docs, SF)
    assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 1]
    assert corpus_pipeline.near_dedup(spark, out, SF).count() == 3
    none = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
    assert langid.UND == "und"


def test_texts_stay_where_no_language_can_be_learnt(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = ["the plain words of a text", "mots d'un texte", "77 !!", "", None, "\u4e2d\u6587", "\u0301 5", "7a", "Stra\u00dfe"]
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 4 == 2][:3]
    for rows in ([(k, t, None) for k, t in enumerate(texts)], [(k, t, "en") for k, t in zip(held, texts)]):
        docs = spark.createDataFrame([(*r, "s", 1) for r in rows], schema)
        want = sorted(k for k, t, _ in rows if t and any(c.isalpha() for c in t))
        assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF).collect()) == want
        learnt = spark.createDataFrame([(900, "some english words", "en", "s", 1), (901, "more english words", "en", "s", 1)], schema)
        kept = corpus_pipeline.language_id(spark, docs.union(learnt), SF).where("doc_id < 900").collect()
        assert sorted(r["doc_id"] for r in kept) == want
