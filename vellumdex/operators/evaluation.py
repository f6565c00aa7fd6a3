"""Retrieval quality over a golden set: recall@5, reciprocal rank@10, nDCG@10."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def evaluate_rankings(golden: DataFrame, ranked: DataFrame, query_id: str = "query_id", name: str = "name", recall_at: int = 5, cut: int = 10) -> DataFrame:
    """``query_id, n_relevant, recall_at_5, rr_at_10, ndcg_at_10`` of every query of the golden set.

    ``golden`` has ``query_id, relevant_docs`` (file-name parts; repeated ones count once), ``ranked``
    has ``query_id, name, rank``. A file matches a part that it contains. For recall a part
    counts once, however many files hold it; for nDCG each place takes the first part, in
    sorted order, that no earlier place took. A query without results scores 0.
    """
    goals = golden.select(query_id, F.array_sort(F.array_distinct(F.coalesce("relevant_docs", F.array().cast("array<string>")))).alias("goals"))
    top = ranked.where(F.col("rank") <= cut).groupBy(query_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(name).alias("n")))), lambda x: x["n"]).alias("names"))
    both = goals.join(top, query_id, "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    hit = F.filter("goals", lambda g: F.exists(F.slice("names", 1, recall_at), lambda d: d.contains(g)))
    first = F.coalesce(F.array_min(F.filter(F.transform("names", lambda d, i: F.when(F.exists("goals", lambda g: d.contains(g)), i + 1)), lambda i: i.isNotNull())), F.lit(0))
    start = F.struct(F.col("goals").alias("left"), F.lit(0.0).alias("dcg"), F.lit(0).alias("place"))

    def step(state: Column, doc: Column) -> Column:
        match = F.get(F.filter(state["left"], lambda g: doc.contains(g)), 0)
        place = state["place"] + 1
        gain = F.when(match.isNotNull(), 1 / F.log2(place + F.lit(1.0))).otherwise(F.lit(0.0))
        left = F.when(match.isNotNull(), F.filter(state["left"], lambda g: g != match)).otherwise(state["left"])
        return F.struct(left.alias("left"), (state["dcg"] + gain).alias("dcg"), place.alias("place"))

    n = F.size("goals")
    ideal = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(cut)))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1.0)))
    return both.select(
        query_id, n.alias("n_relevant"), F.least(F.size(hit) / F.greatest(n, F.lit(1)), F.lit(1.0)).alias("recall_at_5"),
        F.when(first > 0, 1 / first).otherwise(F.lit(0.0)).alias("rr_at_10"), F.aggregate("names", start, step)["dcg"].alias("dcg"), ideal.alias("idcg"),
    ).select(query_id, "n_relevant", "recall_at_5", "rr_at_10", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg_at_10"))


def summary(per_query: DataFrame) -> DataFrame:
    """One row: the mean of each measure over all queries, and their number."""
    return per_query.agg(F.avg("recall_at_5").alias("recall_at_5"), F.avg("rr_at_10").alias("mrr_at_10"), F.avg("ndcg_at_10").alias("ndcg_at_10"), F.count("*").alias("queries"))
