"""Fusing ranked lists, reranking and shaping search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
# Fixed value: the scheme of a result's file address.
FILE_SCHEME = "qmd://"


def reciprocal_rank_fusion(vector: DataFrame, lexical: DataFrame, key: str = "id", query_id: str = "query_id", k: int = RRF_K) -> DataFrame:
    """``query_id, key, fusion_score, vector_rank, bm25_rank, position`` of two ranked lists per query.

    Both lists have ``query_id, key, rank``. Equal scores keep the order of the vector
    list, then of the lexical one.
    """
    v = vector.select(query_id, key, F.col("rank").cast("int").alias("vector_rank"))
    b = lexical.select(query_id, key, F.col("rank").cast("int").alias("bm25_rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    fused = v.join(b, [query_id, key], "full_outer").withColumn("fusion_score", part("vector_rank") + part("bm25_rank"))
    order = Window.partitionBy(query_id).orderBy(F.desc(F.round("fusion_score", 12)), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"))
    return fused.withColumn("position", F.row_number().over(order))


def rerank_prefix(fused: DataFrame, score: Column | str, limit: int, query_id: str = "query_id") -> DataFrame:
    """The first ``max(1, limit)`` positions of each query ordered anew by ``score``; the rest keep their order.

    A reranked row carries its rerank score as ``fusion_score`` from then on; the score
    before is kept as ``first_score``.
    """
    score = F.col(score) if isinstance(score, str) else score
    head = F.col("position") <= max(1, limit)
    marked = fused.withColumn("rerank_score", F.when(head, score.cast("double")))
    order = Window.partitionBy(query_id).orderBy((~head).cast("int"), F.when(head, F.col("rerank_score")).desc_nulls_last(), "position")
    placed = marked.withColumn("_new", F.row_number().over(order)).withColumn("first_score", F.col("fusion_score"))
    return placed.withColumn("fusion_score", F.when(head, F.col("rerank_score")).otherwise(F.col("fusion_score"))).withColumn("position", F.col("_new")).drop("_new")


def diversify(rows: DataFrame, k: int, doc: str = "doc_id", query_id: str = "query_id") -> DataFrame:
    """The first row of every document in order, then the others in order, cut to ``k``; ``position`` anew.

    A document's rows are numbered inside the query, which holds no more rows than both
    branches deliver.
    """
    nth = F.row_number().over(Window.partitionBy(query_id, doc).orderBy("position"))
    order = Window.partitionBy(query_id).orderBy((F.col("_nth") > 1).cast("int"), "position")
    return rows.withColumn("_nth", nth).withColumn("_new", F.row_number().over(order)).where(F.col("_new") <= k).withColumn("position", F.col("_new")).drop("_nth", "_new")


def resort_by_score(rows: DataFrame, query_id: str = "query_id", score: str = "final_score") -> DataFrame:
    """``position`` anew by falling score; equal scores keep their order."""
    order = Window.partitionBy(query_id).orderBy(F.desc(score), "position")
    return rows.withColumn("_new", F.row_number().over(order)).withColumn("position", F.col("_new")).drop("_new")


# Fixed value: columns of a search result.
RESULT_COLUMNS = (
    "chunk_rowid chunk_id doc_id collection_id collection_name title source_path relative_path section_path chunk_type text "
    "fusion_score rerank_score final_score vector_rank bm25_rank"
).split()


def hydrate(fused: DataFrame, chunks: DataFrame, key: str = "id") -> DataFrame:
    """Ranked keys with the chunks' columns; keys without a chunk drop out."""
    return fused.join(chunks, key)


def with_current_names(rows: DataFrame, collections: DataFrame) -> DataFrame:
    """Collection names as the registry has them now; the stored name where it has none."""
    now = collections.select("collection_id", F.col("name").alias("_name"))
    return rows.join(now, "collection_id", "left").withColumn("collection_name", F.coalesce("_name", "collection_name")).drop("_name")


def final_scores(rows: DataFrame) -> DataFrame:
    """``final_score``: the rerank score, else the fused one."""
    return rows.withColumn("final_score", F.coalesce("rerank_score", "fusion_score"))


def rerank_text(title: Column, section: Column, text: Column) -> Column:
    """What a reranker reads of a chunk: its title, section and text, as far as they are not blank."""
    from vellumdex.functions.text import joined_nonblank

    return joined_nonblank("\n\n", title, section, text)


def rounded(x: Column, digits: int = 4) -> Column:
    """Rounded in binary arithmetic, so that 0.31675, which is a little less, becomes 0.3167."""
    return F.signum(x) * F.floor(F.abs(x) * 10.0**digits + 0.5) / 10.0**digits


def result_payload(rows: DataFrame, show_type: bool = False) -> DataFrame:
    """Columns of a result as the JSON output shows them, in order of ``position``."""
    collection = F.coalesce(F.when(F.trim("collection_name") != "", F.trim("collection_name")), F.col("collection_id"))
    columns = [
        F.col("doc_id"), rounded(F.col("final_score")).alias("score"), F.concat(F.lit(FILE_SCHEME), collection, F.lit("/"), F.col("relative_path")).alias("file"),
        F.col("title"), F.trim("text").alias("snippet"), *([F.col("chunk_type")] if show_type else []),
    ]
    return rows.orderBy("position").select(*columns)
