import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellumdex.functions import text as tx
from vellumdex.operators import lexical

TEXTS = {1: "alpha banana", 2: "beta carrot", 3: None, 4: ""}


@pytest.fixture(scope="module")
def index(spark):
    chunks = spark.createDataFrame([(i, t, tx and (len(t.split()) if t else 0), "A" if i == 1 else "B") for i, t in TEXTS.items()], "id bigint, search_text string, token_count int, collection_id string")
    return chunks, lexical.postings_of(chunks)


def test_postings_match_counting(spark):
    text = "b a b 中文字 中文 a.b b"
    got = {(r["term"], r["tf"]) for r in lexical.postings_of(spark.createDataFrame([(1, text)], "id int, search_text string")).collect()}
    words = Counter(tx.query_tokens("")) + Counter(["b", "a", "b", "a.b", "b", "中文", "文字", "中文"])
    assert got == set(words.items())


def test_two_chunks_score_ln2(spark):
    chunks = spark.createDataFrame([(1, "alpha banana", 2, "A"), (2, "beta carrot", 2, "B")], "id bigint, search_text string, token_count int, collection_id string")
    rows = lexical.bm25_topk(spark, "banana carrot", lexical.postings_of(chunks), chunks).orderBy("rank").collect()
    assert [(r["id"], r["rank"]) for r in rows] == [(1, 1), (2, 2)]
    assert all(abs(r["score"] - math.log(2)) < 1e-9 for r in rows)
    only = lexical.bm25_topk(spark, "banana carrot", lexical.postings_of(chunks), chunks, collections=["B"]).collect()
    assert [r["id"] for r in only] == [2] and abs(only[0]["score"] - math.log(2)) < 1e-9


def test_empty_and_null(spark, index):
    chunks, postings = index
    assert postings.where("id in (3, 4)").count() == 0
    assert lexical.bm25_topk(spark, "  ", postings, chunks).count() == 0
    assert lexical.bm25_topk(spark, "zeta", postings, chunks).count() == 0
    none = chunks.limit(0)
    assert lexical.bm25_topk(spark, "alpha", lexical.postings_of(none), none).count() == 0
    assert lexical.corpus_scalars(none).first().asDict() == {"doc_count": 0, "avgdl": 0.0}


def test_duplicate_query_terms_count_once(spark, index):
    chunks, postings = index
    one, two = (lexical.bm25_topk(spark, q, postings, chunks).select(F.sum("score")).first()[0] for q in ("alpha", "alpha ALPHA alpha"))
    assert one == two
