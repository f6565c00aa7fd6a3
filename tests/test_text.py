from pyspark.sql import functions as F

from vellumdex.functions import text as tx


def test_tokens_and_atoms(spark):
    df = spark.createDataFrame([("MULH 高位錯誤 x",), ("Ａ-b.c 中",), ("",), (None,)], "t string").withColumn("n", tx.nfkc_lower("t"))
    rows = df.select(tx.search_tokens(F.col("n")).alias("tokens"), tx.atom_count(F.col("n")).alias("atoms")).collect()
    assert rows[0]["tokens"] == ["mulh", "x", "高位", "位錯", "錯誤"] and rows[0]["atoms"] == 6
    assert rows[1]["tokens"] == ["a-b.c", "中"] and rows[1]["atoms"] == 2
    assert rows[2]["tokens"] == [] and rows[2]["atoms"] == 0
    assert rows[3]["tokens"] is None and rows[3]["atoms"] is None


def test_query_text(spark):
    raw = " Ａ—Ｂ　c "
    assert tx.query_text(raw) == "a-b c"
    assert spark.createDataFrame([(raw,)], "q string").select(tx.query_text_col(F.col("q"))).first()[0] == "a-b c"
    assert tx.query_tokens("b a b 高位錯") == ["b", "a", "高位", "位錯"]
    assert tx.query_tokens(None) == []


def test_hash_and_snippet(spark):
    row = spark.createDataFrame([("ab \n c", " ABC ")], "t string, h string").select(tx.sha256_hex(F.col("t")), tx.clean_hash("h"), tx.snippet(F.col("t"), 4)).first()
    import hashlib

    assert list(row) == [hashlib.sha256(b"ab \n c").hexdigest(), "abc", "ab c"]


def test_pairs_of_whole_texts(spark, tmp_path):
    from vellumdex.plans.retrieval_queries import QUERIES

    spark.createDataFrame([(1, "标题", "plain " * 1000 + "词项目 x 中"), (2, None, ""), (3, "标题", None)], "doc_id bigint, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["cjk_bigrams_text"](spark, str(tmp_path)).collect()))
    assert got == [(1, "词项 项目 中"), (2, "")]
