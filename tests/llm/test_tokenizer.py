import os
import random

import pytest

from vellumdex.llm import tokenizer as K

pytestmark = pytest.mark.skipif(not os.path.exists(K.default_vocabulary()), reason="no vocabulary files here")
TEXTS = ["", None, "Hello world, it's 42!", "  two  spaces\n\n\tand\r\ntabs ", "中文字と日本語のテキスト", "naïve ﬁ ½ 😀\u200b\ufeff", "<|endoftext|>", "a" * 5000, "\x00\x01", "é" * 300, "Привет, мир"]


def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=K.SPLIT_PATTERN, mergeable_ranks=K.load_ranks(K.default_vocabulary()), special_tokens={})


def test_corpus_ids_match(spark):
    want = reference()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "null key", 1), (2, TEXTS[2], 1)], "doc_id bigint, text string, ids int")
    for words in (0, 3, 50_000):
        rows = K.encode_corpus(df, words=words).collect()
        assert len(rows) == len(TEXTS) + 2
        for r in rows:
            text = "null key" if r["doc_id"] is None else TEXTS[r["doc_id"]]
            assert r["ids"] == want.encode_ordinary(text or "")
    assert K.encode_corpus(df.limit(0)).count() == 0
    counts = {r["doc_id"]: r["n_tokens"] for r in K.token_counts(df, ["doc_id"]).collect()}
    assert counts[0] == counts[1] == 0 and counts[2] == len(want.encode_ordinary(TEXTS[2]))


def test_lexicon_is_exact_and_minimal(tmp_path):
    r = random.Random(1)
    words = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 8))) for _ in range(400)} | {b"walking", b"talking", b"walked", b"talked"}
    entries = {w: tuple(r.randrange(1000) for _ in range(r.randint(1, 4))) for w in words}
    path = tmp_path / "lexicon.bin"
    path.write_bytes(K.Lexicon.compile(entries))
    lexicon = K.Lexicon.open(str(path))
    probes = sorted(words) + [w + b"x" for w in sorted(words)] + [w[:-1] for w in sorted(words)] + [b"", b"zzz", b"a" * 100]
    places = lexicon.find(probes)
    for w, p in zip(probes, places):
        assert (p >= 0) == (w in entries)
        if p >= 0:
            assert tuple(lexicon.ids[lexicon.offset[p] : lexicon.offset[p + 1]]) == entries[w]
    (tmp_path / "small.bin").write_bytes(K.Lexicon.compile({b"walking": (1,), b"talking": (2,)}))
    assert len(K.Lexicon.open(str(tmp_path / "small.bin")).final) == 8  # w and t lead to the same suffix
    (tmp_path / "none.bin").write_bytes(K.Lexicon.compile({}))
    assert list(K.Lexicon.open(str(tmp_path / "none.bin")).find([b"a", b""])) == [-1, -1]


def test_merging_matches_on_random_text():
    want, r = reference(), random.Random(5)
    encoder = K.Encoder(K.default_vocabulary(), None)
    texts = ["".join(r.choice("ab的のé <|>\u0301😀\n\t\xa0'sT9") for _ in range(r.randint(0, 80))) for _ in range(500)]
    ids, counts = encoder.encode(texts)
    at = 0
    for t, n in zip(texts, counts):
        assert list(ids[at : at + n]) == want.encode_ordinary(t)
        at += n


def test_lexicon_counts_the_words_of_all_documents(spark):
    from pyspark import SparkFiles
    from pyspark.sql import functions as F

    word = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    file = K.build_lexicon(spark.range(12_000).select(word.alias("text")))
    words = ["".join("abcdefghij"[int(d)] for d in str(i)).encode() for i in range(12_000)]
    assert (K.Lexicon.open(SparkFiles.get(file)).find(words) >= 0).all()
    often = spark.range(12_000).select(F.concat_ws(" ", word, F.when(F.col("id") < 600, F.lit("z"))).alias("text"))
    found = K.Lexicon.open(SparkFiles.get(K.build_lexicon(often, words=1))).find([b" z", b"a", b"b"])
    assert (found >= 0).tolist() == [True, False, False]
