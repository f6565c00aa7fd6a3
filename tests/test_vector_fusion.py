import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumdex.operators import evaluation, fusion, vector


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(3)
    data = r.normal(size=(200, 8))
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    data[7] = data[3]  # a tie
    return data, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id bigint, embedding array<float>")


def brute(data, q, k):
    scores = np.round(data.astype(np.float32).astype(float) @ q, 6)
    return sorted(range(len(data)), key=lambda i: (-scores[i], i))[:k]


def test_both_paths_match_brute_force(spark, vectors):
    data, df = vectors
    queries = [(i, [float(x) for x in data[i]]) for i in (0, 3, 9)]
    frame = spark.createDataFrame(queries, "query_id int, vector array<double>")
    batch = vector.vector_batch_topk(df, frame, 5).orderBy("query_id", "rank").collect()
    for i, q in queries:
        want = brute(data, np.array(q), 5)
        assert [r["vec_id"] for r in vector.vector_topk(df, q, 5).orderBy("rank").collect()] == want
        assert [r["vec_id"] for r in batch if r["query_id"] == i] == want


def test_blocks_give_the_same(spark, vectors, monkeypatch):
    data, df = vectors
    frame = spark.createDataFrame([(i, [float(x) for x in data[i]]) for i in range(7)], "query_id int, vector array<double>")
    whole = {tuple(r) for r in vector.vector_batch_topk(df, frame, 3).collect()}
    for name, value in (("QUERY_BLOCK", 2), ("HELD_BYTES", 1000), ("SLICE_ROWS", 7)):
        monkeypatch.setattr(vector, name, value)
        assert {tuple(r) for r in vector.vector_batch_topk(df, frame, 3).collect()} == whole


def test_a_slice_keeps_ties_and_the_running_best():
    import pyarrow as pa

    r = np.random.default_rng(5)
    keys = r.permutation(500)
    stored = r.integers(0, 3, (500, 2)).astype(float)
    queries = r.integers(-1, 3, (4, 2)).astype(float)
    for k in (1, 5, 700):
        place, score = vector._best(queries, stored, pa.array(keys), k, 6)
        for q, places, scores in zip(queries, place, score):
            want = sorted(range(500), key=lambda i: (-(stored[i] @ q), keys[i]))[:k]
            assert list(places) == want and list(scores) == [stored[i] @ q for i in want]


def test_batch_search_leaves_queries_to_the_tasks(spark, vectors):
    import inspect

    _, df = vectors
    source = inspect.getsource(vector.vector_batch_topk)
    assert "collect" not in source and "toLocalIterator" not in source
    text = vector.vector_batch_topk(df, spark.createDataFrame([(1, [1.0] * 8)], "query_id int, vector array<double>"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and text.count("MapInArrow") == 1


def test_dimensions(spark, vectors):
    _, df = vectors
    with pytest.raises(vector.VectorDimensionError):
        vector.vector_topk(df, [1.0], dimension=8)
    with pytest.raises(vector.VectorDimensionError):
        vector.dimension_of(df.unionByName(spark.createDataFrame([(1, [1.0])], df.schema)))
    assert vector.dimension_of(df.limit(0)) is None
    empty = spark.createDataFrame([], "query_id int, vector array<double>")
    assert vector.vector_batch_topk(df, empty, 3).count() == 0


def test_normalize(spark):
    row = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(vector.l2_normalized(F.col("v")).alias("v")).collect()
    assert [list(r["v"]) for r in row] == [[0.6, 0.8], [0.0, 0.0]]


def test_rrf(spark):
    v = spark.createDataFrame([(0, 10, 1), (0, 20, 2)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(0, 20, 1), (0, 30, 2)], "query_id int, id int, rank int")
    rows = fusion.reciprocal_rank_fusion(v, b).orderBy("position").collect()
    assert [r["id"] for r in rows] == [20, 10, 30]
    assert abs(rows[0]["fusion_score"] - (1 / 62 + 1 / 61)) < 1e-12
    tie = fusion.reciprocal_rank_fusion(spark.createDataFrame([(0, "a", 1), (0, "b", 2)], "query_id int, id string, rank int"), spark.createDataFrame([(0, "b", 1), (0, "a", 2)], "query_id int, id string, rank int"))
    assert [r["id"] for r in tie.orderBy("position").collect()] == ["a", "b"]


def test_diversity_and_resort(spark):
    rows = spark.createDataFrame([(0, i, d, i + 1, s) for i, (d, s) in enumerate([("d1", 5.0), ("d1", 4.0), ("d2", 3.0), ("d1", 2.0), ("d3", 1.0)])], "query_id int, id int, doc_id string, position int, final_score double")
    assert [r["id"] for r in fusion.diversify(rows, 3).orderBy("position").collect()] == [0, 2, 4]
    assert [r["final_score"] for r in fusion.resort_by_score(fusion.diversify(rows, 2)).orderBy("position").collect()] == [5.0, 3.0]
    assert [r["final_score"] for r in fusion.resort_by_score(fusion.diversify(rows, 4)).orderBy("position").collect()] == [5.0, 4.0, 3.0, 1.0]


def test_rerank_prefix(spark):
    rows = spark.createDataFrame([(0, "a", 1, 0.9, 0.1), (0, "b", 2, 0.8, 1.0), (0, "c", 3, 0.7, 5.0)], "query_id int, id string, position int, fusion_score double, s double")
    out = fusion.rerank_prefix(rows, "s", 2).orderBy("position").collect()
    assert [(r["id"], r["fusion_score"], r["rerank_score"]) for r in out] == [("b", 1.0, 1.0), ("a", 0.1, 0.1), ("c", 0.7, None)]


def test_metrics(spark):
    golden = spark.createDataFrame([(1, ["p1", "p2", "p1"]), (2, ["q"]), (3, [])], "query_id int, relevant_docs array<string>")
    ranked = spark.createDataFrame([(1, n, i) for i, n in enumerate(["p1", "x", "p1", "p2"], 1)], "query_id int, name string, rank int")
    rows = {r["query_id"]: r for r in evaluation.evaluate_rankings(golden, ranked).collect()}
    assert rows[1]["recall_at_5"] == 1.0 and rows[1]["rr_at_10"] == 1.0 and abs(rows[1]["ndcg_at_10"] - 0.877215) < 1e-6
    assert rows[2]["recall_at_5"] == rows[2]["rr_at_10"] == rows[2]["ndcg_at_10"] == 0.0
    assert rows[3]["ndcg_at_10"] == 0.0
