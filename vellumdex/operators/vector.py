"""Exact vector search: inner product over unit vectors.

Two paths with equal results. The native one is an expression and suits a single query;
the block one multiplies blocks of queries with a task's vectors in numpy and returns only
the task's best, which is the path for many queries on large tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset, fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vellumdex.session import stored

#: Queries that go through the vectors together; a block's matrix is at most 8 MB at 1024 dimensions.
QUERY_BLOCK = 1024
#: Bytes of vectors that a task holds while the queries pass, and rows of them that are multiplied at once.
HELD_BYTES = 128 << 20
SLICE_ROWS = 4096


class VectorDimensionError(ValueError):
    """Vectors of different lengths, or a query of another length than the vectors."""


def inner_product(a: Column, b: Column) -> Column:
    """In double precision; null if either side is."""
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalized(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = l2_norm(v)
    return F.when(norm > 0, F.transform(v.cast("array<double>"), lambda x: x / norm)).otherwise(v.cast("array<double>"))


def dimension_of(vectors: DataFrame, vector: str = "embedding") -> int | None:
    """The common length of all vectors; null for none; an error if they differ."""
    row = vectors.where(F.col(vector).isNotNull()).agg(F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("most")).first()
    if row["least"] != row["most"]:
        raise VectorDimensionError(f"vectors of {row['least']} to {row['most']} dimensions in one index")
    return row["least"]


def vector_topk(vectors: DataFrame, query: Sequence[float], k: int = 20, key: str = "vec_id", vector: str = "embedding", digits: int = 6, prefilter: Column | None = None, dimension: int | None = None) -> DataFrame:
    """``key, score, rank`` of the ``k`` nearest vectors; ties go to the smaller key.

    Filters that are applied to the result come after the cut, so that fewer than ``k`` rows
    may be left; ``prefilter`` narrows the vectors before it. Null vectors do not rank.
    """
    if dimension is not None and dimension != len(query):
        raise VectorDimensionError(f"a query of {len(query)} dimensions against vectors of {dimension}")
    rows = vectors if prefilter is None else vectors.where(prefilter)
    ask = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.where(F.col(vector).isNotNull()).select(key, F.round(inner_product(F.col(vector), ask), digits).alias("score"))
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def vector_batch_topk(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", query_vector: str = "vector", digits: int = 6) -> DataFrame:
    """``query_id, key, score, rank``: the ``k`` nearest vectors of every query.

    The queries are written once to the shared folder. Each task takes up vectors as long as they
    fit into ``HELD_BYTES``, reads the queries in blocks of ``QUERY_BLOCK`` from there, and returns its ``k``
    best of each query for all vectors it holds; a window picks the best of these. Nothing passes through
    the driver, and the vectors are scanned once however many queries there are.
    """
    asked = stored(queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<double>").alias("v")))
    kind, stored_kind = queries.schema[query_id].dataType, vectors.schema[key].dataType
    arrow = to_arrow_type(kind)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, matrix in _held(batches):
            for block in _query_blocks(asked):
                wanted = _matrix(block.column(1))
                if wanted.shape[1] != matrix.shape[1]:
                    raise VectorDimensionError(f"queries of {wanted.shape[1]} dimensions against vectors of {matrix.shape[1]}")
                place, score = _best(wanted, matrix, keys, k, digits)
                ids = block.column(0).cast(arrow).take(pa.array(np.repeat(np.arange(block.num_rows), place.shape[1])))
                yield pa.record_batch([ids, keys.take(pa.array(place.ravel())), pa.array(score.ravel())], ["query_id", "key", "score"])

    chosen = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    found = chosen.mapInArrow(search, f"query_id {kind.simpleString()}, key {stored_kind.simpleString()}, score double").withColumnRenamed("key", key)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumnRenamed("query_id", query_id)


def _matrix(lists: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles."""
    length = np.unique(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    if len(length) != 1:
        raise VectorDimensionError(f"vectors of {length.min()} to {length.max()} dimensions in one table")
    return np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(lists), -1)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Keys and vectors of as many batches as fit into ``HELD_BYTES`` together."""
    keys: list[pa.Array] = []
    parts: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys.append(batch.column(0))
        parts.append(_matrix(batch.column(1)))
        if parts[-1].shape[1] != parts[0].shape[1]:
            raise VectorDimensionError(f"vectors of {parts[0].shape[1]} and {parts[-1].shape[1]} dimensions in one table")
        if sum(p.nbytes for p in parts) >= HELD_BYTES:
            yield pa.concat_arrays(keys), np.concatenate(parts)
            keys, parts = [], []
    if parts:
        yield pa.concat_arrays(keys), np.concatenate(parts)


def _query_blocks(folder: str) -> Iterator[pa.RecordBatch]:
    """The queries in the shared folder, block by block."""
    where, path = fs.FileSystem.from_uri(folder)
    yield from (b for b in dataset.dataset(path, filesystem=where, format="parquet").to_batches(batch_size=QUERY_BLOCK) if b.num_rows)


def _best(queries: np.ndarray, stored: np.ndarray, keys: pa.Array, k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` best rows of ``stored`` for each query, found slice by slice with a running best."""
    order_of = np.asarray(pc.rank(keys, tiebreaker="first")).astype(np.int64)
    place, score = np.zeros((len(queries), 0), np.int64), np.zeros((len(queries), 0))
    for a in range(0, len(stored), SLICE_ROWS):
        fresh = np.round(queries @ stored[a : a + SLICE_ROWS].T, digits)
        here = np.arange(a, a + fresh.shape[1])
        if fresh.shape[1] > k:  # all that reach the slice's k-th best score, ties included
            least = np.partition(fresh, -k, axis=1)[:, -k]
            most = int((fresh >= least[:, None]).sum(axis=1).max())
            some = np.argpartition(-fresh, most - 1, axis=1)[:, :most]
        else:
            some = np.broadcast_to(np.arange(fresh.shape[1]), fresh.shape)
        place = np.concatenate([place, here[some]], axis=1)
        score = np.concatenate([score, np.take_along_axis(fresh, some, axis=1)], axis=1)
        order = np.lexsort((order_of[place], -score), axis=1)[:, :k]
        place, score = np.take_along_axis(place, order, axis=1), np.take_along_axis(score, order, axis=1)
    return place, score


def checked_vectors(chunks: DataFrame, cache: DataFrame, model: str | None = None, key: str = "id") -> DataFrame:
    """``key, embedding`` of each chunk from the cache of vectors by content hash; several chunks may share one."""
    stored = cache if model is None else cache.where(F.col("model") == model)
    return chunks.select(key, "embedding_hash").join(stored.select("embedding_hash", "embedding"), "embedding_hash").select(key, "embedding")


def missing_vectors(chunks: DataFrame, cache: DataFrame, text: str = "search_text") -> DataFrame:
    """``embedding_hash, text`` of each content hash that the cache lacks, once."""
    lacking = chunks.where("embedding_hash is not null").join(cache.select("embedding_hash").distinct(), "embedding_hash", "left_anti")
    return lacking.groupBy("embedding_hash").agg(F.min(text).alias("text"))
