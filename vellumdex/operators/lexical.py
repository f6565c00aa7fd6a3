"""Full-text index and BM25 ranking as DataFrame operators.

An index is three tables: postings ``chunk, term, tf``, document frequencies ``term, df`` and
one row of corpus scalars ``doc_count, avgdl``. They are global to the index: a collection
filter narrows the candidates of a search, never the statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumdex.functions import text as tx

K1, B = 1.5, 0.75


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once: a lambda variable is not copied into its uses."""
    return F.get(F.transform(F.array(value), body), 0)


def term_counts_of(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of an array of tokens: runs of the sorted array, without a shuffle."""

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        places = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        first = F.filter(places, lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)))
        count = lambda starts: F.transform(starts, lambda s, j: F.struct(F.get(ordered, s - 1).alias("term"), (F.coalesce(F.get(starts, j + 1), n + 1) - s).cast("int").alias("tf")))
        return _let(first, count)

    return _let(F.sort_array(tokens), runs)


def postings_of(chunks: DataFrame, key: str = "id", text: str = "search_text") -> DataFrame:
    """``key, term, tf`` of every chunk. A null text has no terms; each row is counted by itself."""
    norm = chunks.select(key, tx.nfkc_lower(text).alias("norm")).where("norm is not null")
    runs = norm.select(key, F.explode(term_counts_of(tx.search_tokens(F.col("norm")))).alias("p"))
    return runs.select(key, "p.term", "p.tf")


def document_frequencies(postings: DataFrame, term: str = "term") -> DataFrame:
    """In how many postings each term occurs."""
    return postings.where(F.col(term).isNotNull()).groupBy(term).agg(F.count("*").alias("df"))


def corpus_scalars(chunks: DataFrame, length: str = "token_count") -> DataFrame:
    """One row: number of chunks and their mean length (0 for an empty index or unknown lengths)."""
    return chunks.agg(F.count("*").alias("doc_count"), F.coalesce(F.avg(length), F.lit(0.0)).alias("avgdl"))


def bm25_weight(tf: Column, df: Column, dl: Column, doc_count: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """One term's part of a chunk's score; null where the length term is not positive."""
    idf = F.ln(1 + (doc_count - df + 0.5) / (df + 0.5))
    norm = tf + k1 * (1 - b + b * F.try_divide(dl, avgdl))
    return F.when(norm > 0, idf * tf * (k1 + 1) / norm)


def query_terms(queries: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """``query_id, term``: the distinct search tokens of every query."""
    norm = queries.select(query_id, tx.query_text_col(F.col(query)).alias("norm"))
    return norm.select(query_id, F.explode(F.array_distinct(tx.search_tokens(F.col("norm")))).alias("term"))


def bm25_scores(terms: DataFrame, postings: DataFrame, chunks: DataFrame, frequencies: DataFrame | None = None, scalars: DataFrame | None = None, collections: Sequence[str] | None = None, key: str = "id", query_id: str = "query_id", digits: int | None = 9) -> DataFrame:
    """``query_id, key, score`` of every chunk that holds a term of the query.

    ``terms`` has ``query_id, term``; ``chunks`` one row per chunk with ``key, token_count,
    collection_id``; chunks without a known length do not rank. An empty list of
    collections means no filter. Scores are rounded to ``digits`` so that ties do not
    hang on the order of a sum. Postings are narrowed to the queries' terms before
    anything else; which side of that join is broadcast, Spark decides by size.
    """
    scalars = corpus_scalars(chunks) if scalars is None else scalars
    asked = terms.select(query_id, "term").distinct()
    kept = chunks.select(key, "token_count", "collection_id")
    if collections:
        kept = kept.where(F.col("collection_id").isin(list(collections)))
    wanted = asked.select("term").distinct()
    narrowed = postings.join(wanted, "term", "left_semi")
    known = document_frequencies(narrowed) if frequencies is None else frequencies.join(wanted, "term", "left_semi")
    found = narrowed.join(known, "term")
    parts = found.join(kept.where("token_count is not null"), key).join(F.broadcast(scalars)).where("doc_count > 0 and avgdl > 0")
    weight = bm25_weight(F.col("tf").cast("double"), F.col("df").cast("double"), F.col("token_count").cast("double"), F.col("doc_count").cast("double"), F.col("avgdl"))
    weighed = parts.select(key, "term", weight.alias("w")).where("w is not null")
    score = F.sum("w")
    return weighed.join(asked, "term").groupBy(query_id, key).agg((F.round(score, digits) if digits is not None else score).alias("score"))


def top_k(scores: DataFrame, k: int, query_id: str = "query_id", key: str = "id", score: str = "score") -> DataFrame:
    """The ``k`` best rows of every query with ``rank`` from 1; ties go to the smaller key.

    Spark keeps only ``k`` rows of a query in each task before the shuffle.
    """
    order = Window.partitionBy(query_id).orderBy(F.desc(score), F.asc(key))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_topk(spark, query: str, postings: DataFrame, chunks: DataFrame, k: int = 20, collections: Sequence[str] | None = None, key: str = "id", **tables: DataFrame) -> DataFrame:
    """``key, score, rank`` of one query; empty for a query without tokens."""
    tokens = tx.query_tokens(query)
    listed = F.array(*[F.lit(t) for t in tokens]).cast("array<string>")
    terms = spark.range(1).select(F.lit(0).alias("query_id"), F.explode(listed).alias("term"))  # of known size, unlike a local list
    postings = postings.where(F.col("term").isin(tokens))  # literals reach the scan, a join would not
    best = bm25_scores(terms, postings, chunks, collections=collections, key=key, **tables).orderBy(F.desc("score"), key).limit(k)
    return top_k(best, k, key=key).drop("query_id")
