import pytest
from pyspark.sql import functions as F

from vellumdex.operators import lexical, vector
from vellumdex.operators.context import context_texts


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("plans"))
    rows = [(i, "A", 3, f"alpha word{i}", "unused") for i in range(50)]
    spark.createDataFrame(rows, "id bigint, collection_id string, token_count int, search_text string, other string").write.parquet(f"{folder}/chunks")
    lexical.postings_of(spark.read.parquet(f"{folder}/chunks")).write.parquet(f"{folder}/postings")
    return spark.read.parquet(f"{folder}/chunks"), spark.read.parquet(f"{folder}/postings")


def test_terms_reach_the_scan_and_columns_are_pruned(spark, stored):
    chunks, postings = stored
    text = plan(lexical.bm25_topk(spark, "alpha word3", postings, chunks))
    assert "PushedFilters: [In(term, [alpha,word3])" in text or "In(term, [alpha,word3])" in text
    assert "other" not in text and "search_text" not in text
    assert "CartesianProduct" not in text


def test_postings_need_no_shuffle(stored):
    chunks, _ = stored
    assert "Exchange" not in plan(lexical.postings_of(chunks))


def test_batch_ranking_limits_groups_before_the_shuffle(spark, stored):
    chunks, postings = stored
    queries = spark.createDataFrame([(1, "alpha"), (2, "word3")], "query_id int, query string")
    text = plan(lexical.top_k(lexical.bm25_scores(lexical.query_terms(queries), postings, chunks), 5))
    assert "WindowGroupLimit" in text and "CartesianProduct" not in text


def test_contexts_are_an_equi_join(spark):
    docs = spark.createDataFrame([("d", "A", "a/b.md")], "doc_id string, collection_id string, relative_path string")
    ctx = spark.createDataFrame([(None, "a", "x", "1"), ("A", "", "y", "2")], "collection_id string, path_prefix string, text string, created_at string")
    text = plan(context_texts(docs, ctx))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_single_vector_query_takes_ordered(spark):
    vectors = spark.range(10).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    assert "TakeOrderedAndProject" in plan(vector.vector_topk(vectors, [1.0, 0.0], 3))
