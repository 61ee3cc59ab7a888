"""Lexical retrieval: corpus statistics, BM25, rank fusion and rarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import tokens
from skein.operators.ordered import ranks
from skein.session import materialize

# Fixed values of the ranking.
K1, B, RRF_K = 1.2, 0.75, 60
DENSE_WEIGHT = (0.25, 4.0)


def terms(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(id, token, tf, length) of docs(id, text): one row per document and token, those of `only`(token) if given, combined
    before the shuffle; the length counts all tokens."""
    listed = docs.select("id", tokens(F.col("text")).alias("t"))
    rows = listed.select("id", F.size("t").cast("bigint").alias("length"), F.explode("t").alias("token"))
    if only is not None:
        rows = rows.join(only, "token", "left_semi")
    return rows.groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"), F.first("length").alias("length"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """(token, df) with each document counted once a token."""
    each = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """(n_docs, total_tokens, avgdl), the average over at least one document."""
    sizes = docs.select(F.size(tokens(F.col("text"))).cast("bigint").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return sizes.agg(F.count(F.lit(1)).alias("n_docs"), total.alias("total_tokens"), (total / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("avgdl"))


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token) of queries(query_id, query), each token once a query."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token"))


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, score) of all documents with a positive score.

    Only the queries' tokens are counted; their document frequencies come from the same counts, so that the texts
    are read once for the statistics and once for the terms. A token no document has contributes nothing.
    """
    wanted = query_tokens(queries)
    stats = corpus_stats(docs)
    tf = terms(docs, wanted.select("token").distinct())
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weighed = wanted.join(df, "token").crossJoin(F.broadcast(stats))  # the statistics are one row
    n, d = F.col("n_docs"), F.col("df")
    weighed = weighed.select("query_id", "token", F.log(1 + (n - d + 0.5) / (d + 0.5)).alias("idf"), "avgdl")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl")))
    return tf.join(weighed, "token").groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, score: str = "score", by: str = "query_id", tie: str = "id") -> DataFrame:
    """The k best rows of each `by`, by score falling, then id; numbered from 1."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tie))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_per_group(scores: DataFrame, group: str) -> DataFrame:
    """The best positive score of each query and group."""
    return scores.groupBy("query_id", group).agg(F.max("score").alias("score")).where("score > 0")


def fuse_rrf(dense: DataFrame, lexical: DataFrame, dense_weight: float = 1.0, k: int = RRF_K) -> DataFrame:
    """(query_id, id, score): reciprocal ranks of two score tables(query_id, id, score) added up; an id needs only one of them."""
    # Ranges are found by a sample of the scores, which would be computed again for each use.
    dense, lexical = (materialize(x.select("query_id", "id", "score"), "scores") for x in (dense, lexical))
    weight = min(max(dense_weight, DENSE_WEIGHT[0]), DENSE_WEIGHT[1])

    def ranked(df, by):
        numbered = ranks(df.select("query_id", "id", "score"), "query_id", [F.col("score").desc(), F.col("id")])
        return numbered.select("query_id", "id", (F.lit(float(by)) / (k + F.col("rank_no"))).alias("part"))

    both = ranked(dense, weight).unionByName(ranked(lexical.where("score > 0"), 1.0))
    return both.groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def hybrid(dense: DataFrame, lexical: DataFrame, dense_weight: float = 1.0) -> DataFrame:
    """Fused scores of queries with a lexical hit, dense scores of the rest."""
    dense, lexical = (materialize(x.select("query_id", "id", "score"), "scores") for x in (dense, lexical))
    hit = lexical.where("score > 0").select("query_id").distinct()
    fused = fuse_rrf(dense.join(hit, "query_id", "left_semi"), lexical, dense_weight)
    return fused.unionByName(dense.join(hit, "query_id", "left_anti").select("query_id", "id", "score"))


def rarity(df: DataFrame, n_docs: int) -> DataFrame:
    """`df`(token, df) with rarity in thousandths of a bit, rounded down."""
    return df.withColumn("rarity_milli", F.floor(1000 * F.log2((F.lit(n_docs) + 1) / (F.col("df") + 1)) + 1e-9).cast("bigint"))
