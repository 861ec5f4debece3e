"""The registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, decontaminate, html_text, langid, masked_lm, near_dups, packing, token_shards, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (host, path, verdict) of the URL filter's rules
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of ``pages``."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of ``documents`` on 4-word shingles at Jaccard 0.8."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles FROM g),
s AS (SELECT doc_id, unnest(g) AS h FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n_shingles + y.n_shingles - common)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y)
SELECT doc_id, n_shingles, min(y) AS component_id, doc_id = min(y) AS kept FROM n JOIN r ON x = doc_id GROUP BY doc_id, n_shingles
"""


def op3_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every text of ``documents``."""
    return masked_lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op4_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best ``documents`` for every document whose id is divisible by 20."""
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text"), k=10)


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in training order in binary shards, as read back from the files."""
    manifest = token_shards.materialise(table(spark, sf_dir, "documents"))
    return token_shards.read_shards(manifest).select("slot", "sequence", "shard", "byte_offset", "n_tokens", "doc_ids", F.crc32("ids").alias("ids_crc32"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written as WARC archives and read back."""
    return warc.digests(spark, warc.archive(table(spark, sf_dir, "pages")))


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every url of ``pages``: rules, else trees learnt from the URLs that rules decide."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak of a ``benchmark`` item in ``documents``."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM dw WHERE len(w) >= 5)),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
xs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM iw WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS item_shingles FROM xs GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN xs USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, CAST(item_shingles AS BIGINT) AS item_shingles, CAST(shared AS BIGINT) AS shared, CAST(shared AS DOUBLE) / item_shingles AS containment
FROM c JOIN n USING (item_id) WHERE 100 * shared >= 80 * item_shingles
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of ``documents``, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_html_text, op2_minhash, op3_masked_lm, op4_bm25, op5_token_shards, op6_warc, op7_url_filter, op8_packing, op9_decontaminate, op10_language_id)}
ORACLE: dict[str, str] = {"op2_minhash": OP2_SQL, "op6_warc": OP6_SQL, "op9_decontaminate": OP9_SQL}
