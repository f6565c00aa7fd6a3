"""One ranking from several scores on unlike scales.

Each score is replaced by its rank within the group (0 worst, 1 best, ties share the mean
rank, missing values are worst). The correlation matrix of these ranks over all rows is
one distributed aggregation; its first principal component, turned as a whole so that better
ranks raise the result, weighs the ranks into one number. Groups that fit into a task are ranked by
windows over one exchange; only larger ones take the way over counted values and buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumdex.session import materialize

# The scores of a search result and whether more or less is better.
SEARCH_SIGNALS = {"fusion_score": "higher", "rerank_score": "higher", "vector_rank": "lower", "bm25_rank": "lower"}

#: Rows of one group that a task sorts; larger groups are counted by value and cut at quantiles.
BUCKET_ROWS = 100_000


def deduplicated(rows: DataFrame, group: str, item: str, signals: Sequence[str], latest: str | None = None) -> DataFrame:
    """``group, item`` and the scores, one row each: of repeated rows the latest, then the greatest values. NaN becomes null.

    An aggregation with map-side combine, so that many copies of a row meet before the shuffle.
    """
    values = [F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")).alias(s) for s in signals]
    order = F.struct(*([F.col(latest)] if latest else []), *values)
    best = rows.groupBy(F.col(group), F.col(item)).agg(F.max(order).alias("_best"))
    return best.select(group, item, *[F.col(f"_best.{s}").alias(s) for s in signals])


def _beside(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal."""
    right = other.withColumnsRenamed({k: f"_{k}" for k in keys})
    joined = rows.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how)
    return joined if how == "left_semi" else joined.drop(*[f"_{k}" for k in keys])


def counts_below(long: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``grp, signal, value, n, below, size``: how often each value occurs in its group, and how many lie below it.

    Rows ``grp, signal, value`` are first counted by value. A group with more distinct values
    than ``bucket_rows`` is cut at its quantiles into buckets that are ranked apart and
    offset by the counts below them, so that no group has to fit into one task. Null is
    the least value.
    """
    keys = ["grp", "signal"]
    counts = long.groupBy(*keys, "value").agg(F.count("*").alias("n"))
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("size"), F.count("value").alias("distinct"))
    large = sizes.where(F.col("distinct") > bucket_rows).select(*keys)
    cut = not large.isEmpty()
    if cut:
        edges = _beside(counts, large, keys, "left_semi").where("value is not null").groupBy(*keys).agg(F.percentile_approx("value", [i / 256 for i in range(1, 256)], 10_000).alias("edges"))
        place = F.when(F.col("edges").isNull(), 0).otherwise(F.size(F.filter("edges", lambda e: e < F.col("value"))))
        bucketed = _beside(counts, edges, keys, "left").withColumn("bucket", F.coalesce(place, F.lit(0))).drop("edges")
    else:
        bucketed = counts.withColumn("bucket", F.lit(0))
    within = Window.partitionBy(*keys, "bucket").orderBy(F.asc_nulls_first("value")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = bucketed.withColumn("below", F.coalesce(F.sum("n").over(within), F.lit(0)))
    if cut:
        totals = bucketed.groupBy(*keys, "bucket").agg(F.sum("n").alias("m"))
        before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*keys, "bucket", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("lower"))
        ranked = _beside(ranked, offsets, [*keys, "bucket"]).withColumn("below", F.col("below") + F.col("lower"))
    return _beside(ranked, sizes, keys).select(*keys, "value", "n", "below", "size")


def large_groups(rows: DataFrame, group: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame | None:
    """The groups with more rows than a task ranks at once (there are at most rows / ``bucket_rows``); null if there are none."""
    large = materialize(rows.groupBy(F.col(group).alias("_large")).agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows).select("_large"))
    return None if large.isEmpty() else large


def _directed(signals: Mapping[str, str]) -> list[Column]:
    """Each score as a double of which more is better; null and NaN are null."""
    return [F.when(F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double")), F.col(s).cast("double") * (1 if way == "higher" else -1) + F.lit(0.0)) for s, way in signals.items()]


def rank_transform(rows: DataFrame, group: str, item: str, signals: Mapping[str, str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``group, item`` and for each score ``r_<score>`` from 0 (worst) to 1 (best).

    The mean rank of tied values over the group's size, counting what lies below. Null and
    NaN take part as one tied worst value of rank 0. Both ways give equal ranks.
    """
    large = large_groups(rows, group, bucket_rows)
    if large is None:
        return _ranked_by_windows(rows, group, item, signals)
    is_large = F.col(group).eqNullSafe(F.col("_large"))
    return _ranked_by_windows(rows.join(large, is_large, "left_anti"), group, item, signals).unionByName(_ranked_by_counts(rows.join(large, is_large, "left_semi"), group, item, signals, bucket_rows))


def _ranked_by_windows(rows: DataFrame, group: str, item: str, signals: Mapping[str, str]) -> DataFrame:
    values = rows.select(group, item, *[v.alias(f"_v{i}") for i, v in enumerate(_directed(signals))])
    whole = Window.partitionBy(group)
    out = values.withColumn("_size", F.count("*").over(whole))
    for i, s in enumerate(signals):
        ties = whole.orderBy(F.asc_nulls_first(f"_v{i}"))
        mean = F.rank().over(ties) - 1 + (F.count("*").over(ties.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2
        out = out.withColumn(f"r_{s}", F.when(F.col(f"_v{i}").isNull() | (F.col("_size") < 2), 0.0).otherwise(mean / (F.col("_size") - 1)))
    return out.select(group, item, *[f"r_{s}" for s in signals])


def _ranked_by_counts(rows: DataFrame, group: str, item: str, signals: Mapping[str, str], bucket_rows: int) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(i).alias("signal"), v.alias("value")) for i, v in enumerate(_directed(signals))])
    long = rows.select(F.col(group).alias("grp"), F.col(item).alias("item"), F.explode(pairs).alias("p")).select("grp", "item", "p.signal", "p.value")
    mean = (F.col("below") + (F.col("n") - 1) / 2) / (F.col("size") - 1)
    placed = counts_below(long, bucket_rows).select("grp", "signal", "value", F.when(F.col("value").isNull() | (F.col("size") < 2), 0.0).otherwise(mean).alias("rank"))
    joined = _beside(long, placed, ["grp", "signal", "value"])
    wide = joined.groupBy("grp", "item").agg(*[F.max(F.when(F.col("signal") == i, F.col("rank"))).alias(f"r_{s}") for i, s in enumerate(signals)])
    return wide.withColumnsRenamed({"grp": group, "item": item})


def with_rank(fused: DataFrame, group: str = "query_id", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``fused`` with ``rank``: 1 for the best of a group; equal results share the smallest rank of theirs."""
    by_window = lambda rows: rows.withColumn("rank", F.rank().over(Window.partitionBy(group).orderBy(F.desc("fused"))))
    large = large_groups(fused, group, bucket_rows)
    if large is None:
        return by_window(fused)
    is_large = F.col(group).eqNullSafe(F.col("_large"))
    rest = fused.join(large, is_large, "left_semi")
    long = rest.select(F.col(group).alias("grp"), F.lit(0).alias("signal"), F.col("fused").alias("value"))
    placed = counts_below(long, bucket_rows).select(F.col("grp").alias(group), F.col("value").alias("fused"), (F.col("size") - F.col("below") - F.col("n") + 1).cast("int").alias("rank"))
    return by_window(fused.join(large, is_large, "left_anti")).unionByName(_beside(rest, placed, [group, "fused"]))


def principal_weights(ranks: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Weights of the columns from the first principal component of their correlation matrix.

    One aggregation gives all sums of products; the matrix has as many rows as there are
    scores. The component is turned as a whole so that its loadings, which the declared
    directions of the ranks make alike in sign, add up to more than 0. A score that still loads
    against its declared direction opposes the others; it gets no weight, since with a negative one a
    missing value would help. A score without variance gets none either; if none varies, all
    weigh alike.
    """
    k = len(columns)
    sums = [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]]
    sums += [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    row = ranks.agg(*sums).first()
    if not row["n"]:
        return dict.fromkeys(columns, 1.0 / k)
    n = row["n"]
    mean = np.array([row[f"s{i}"] or 0.0 for i in range(k)]) / n
    cov = np.array([[(row[f"p{min(i, j)}_{max(i, j)}"] or 0.0) / n - mean[i] * mean[j] for j in range(k)] for i in range(k)])
    deviation = np.sqrt(np.clip(np.diag(cov), 0, None))
    live = deviation > 1e-9
    if not live.any():
        return dict.fromkeys(columns, 1.0 / k)
    corr = cov[np.ix_(live, live)] / np.outer(deviation[live], deviation[live])
    component = np.linalg.eigh((corr + corr.T) / 2)[1][:, -1]
    component = component if component.sum() >= 0 else -component
    loading = np.zeros(k)
    loading[live] = np.clip(component, 0, None) / deviation[live]
    return dict(zip(columns, (loading / loading.sum()).tolist()))


def fuse_rankings(rows: DataFrame, group: str = "query_id", item: str = "chunk_rowid", signals: Mapping[str, str] = SEARCH_SIGNALS, latest: str | None = "searched_at") -> DataFrame:
    """``group, item, r_<score>..., fused`` with ``fused`` from 0 to 1, greater is better.

    Order a group by ``fused`` downwards and, for ties, by ``item`` upwards. Repeated rows
    count once. A group of one item has rank 0 in all scores. Null groups form one group,
    null items are kept as one item.
    """
    single = materialize(deduplicated(rows, group, item, list(signals), latest))
    ranks = materialize(rank_transform(single, group, item, signals))
    columns = [f"r_{s}" for s in signals]
    weights = principal_weights(ranks, columns)
    return ranks.withColumn("fused", sum((F.col(c) * F.lit(w) for c, w in weights.items()), F.lit(0.0)))


def first_of_group(fused: DataFrame, group: str = "query_id", item: str = "chunk_rowid") -> DataFrame:
    """``group, item`` of the item that stands first, by an aggregation instead of a sort; items of any type, null last."""
    best = fused.groupBy(group).agg(F.min(F.struct((-F.col("fused")).alias("worse"), F.col(item).isNull().alias("void"), F.col(item).alias("item"))).alias("best"))
    return best.select(group, F.col("best.item").alias(item))
