"""Hash embeddings and exact cosine top-k, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIM = 256


def hash_embedding(text: Column, dim: int = DIM) -> Column:
    """Counts of the lower-case alphanumeric tokens by hash bucket, at unit length."""
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    buckets = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.size(F.filter(buckets, lambda b: b == k)).cast("double"))
    return normalized(counts)


def normalized(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(index: DataFrame, query: list[float], k: int, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(id, score) of the k most similar vectors; score descending, then id; other
    dimensions never match and non-finite scores come last."""
    q = F.array(*[F.lit(float(x)) for x in query])
    score = dot(normalized(F.col(vec_col)), normalized(q))
    rows = index.where(F.size(vec_col) == len(query)).select(F.col(id_col), score.alias("score"))
    return rows.orderBy(F.isnan("score"), F.desc("score"), id_col).limit(k)


def top_k_batch(index: DataFrame, queries: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec") -> DataFrame:
    """(query_id, id, score, rank) for a frame of queries (query_id, vec) of checked, small size."""
    if queries.limit(10_001).count() > 10_000:
        raise ValueError("search at most 10000 queries at once")
    q = F.broadcast(queries.select("query_id", normalized(F.col("vec")).alias("q_")))
    pairs = index.select(F.col(id_col), normalized(F.col(vec_col)).alias("v_")).join(q, F.size("v_") == F.size("q_")).select("query_id", id_col, dot(F.col("v_"), F.col("q_")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), id_col))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)
