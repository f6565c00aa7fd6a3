import os

import pytest
from pyspark.sql import functions as F

from vellumdex.llm import language as L
from vellumdex.llm import mixture as M
from vellumdex.llm import tokenizer as K

needs_vocabulary = pytest.mark.skipif(not os.path.exists(K.default_vocabulary()), reason="no vocabulary files here")


def test_water_filling():
    sizes, weights, caps = {"a": 100, "b": 10, "c": 50, "d": 0}, {"a": 50.0, "b": 40.0, "c": 10.0, "d": 5.0, "e": 3.0}, {"a": 2, "b": 2, "c": None, "d": 9}
    take = M.water_fill(sizes, weights, caps, 120)
    assert take["b"] == 20 and abs(sum(take.values()) - 120) < 1e-9 and abs(take["a"] / take["c"] - 5) < 1e-9
    assert M.water_fill(sizes, weights, caps, 10_000) == {"a": 200, "b": 20, "c": 50}
    assert M.water_fill(sizes, {"a": None, "b": float("nan"), "c": -1.0}, caps) == {}
    assert M.water_fill({}, weights, caps) == {}
    total = M.exact_total(sizes, weights, caps)
    exact = M.water_fill(sizes, weights, caps, total)
    assert abs(total - 50) < 1e-9 and abs(exact["b"] - 20) < 1e-9 and abs(exact["a"] / total - 0.5) < 1e-9


def test_bins_that_overshoot_are_left_out():
    total = lambda bins, rest: sum(b for b, t in zip(bins, M._taken(bins, rest)) if t == "1")
    assert M._taken([5, 5, 100, 5, 5], 18) == "11011" and M._taken([5, 5], 0.2) == "00" and M._taken([], 5) == ""
    assert total([500] * 20 + [10] * 50, 100) == 100
    assert total([500] * 4000 + [10] * 96, 960) == 960
    r = __import__("random").Random(1)
    for _ in range(200):
        bins = [r.choice([0, 1, 5, 50, 700]) for _ in range(r.randint(1, 60))]
        rest = r.random() * sum(bins)
        assert abs(total(bins, rest) - rest) <= max(bins) / 2 + 0.5


TARGETS = "source string, target_share double, max_repeats int"


@needs_vocabulary
def test_mix(spark):
    docs = [(i, "word " * 10, " Big-One " if i % 3 else "BIG_ONE") for i in range(600)] + [(1000 + i, "word " * 10, "small") for i in range(10)] + [(2000, None, "small"), (2001, "", "small"), (2002, "x y", None), (2003, "x y", "unnamed")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("big_one", 50.0, 1), ("small", 50.0, 3), ("nothing", 10.0, 2), ("zero", None, 1)], TARGETS)
    mix, shares = M.mix_sources(frame, targets, total=2000)
    rows = mix.collect()
    assert max(r["repeats"] for r in rows if r["source"] == "small") <= 3 and all(r["repeats"] == 1 for r in rows if r["source"] == "big_one")
    assert len({r["doc_id"] for r in rows}) == len(rows)
    report = {r["source"]: r for r in shares.collect()}
    assert report["small"]["most_repeats"] == 3 and abs(report["small"]["planned_share"] - 330 / 2000) < 0.02
    assert abs(report["big_one"]["reached_share"] - report["big_one"]["planned_share"]) < 0.01
    assert report["nothing"]["reached_share"] == report["zero"]["reached_share"] == 0.0
    assert {tuple(r) for r in M.mix_sources(frame, targets, total=2000)[0].collect()} == {tuple(r) for r in rows}
    none, empty = M.mix_sources(frame.limit(0), targets)
    assert none.count() == 0 and empty.count() == 4
    assert M.mix_sources(frame, targets.limit(0))[0].count() == 0


WORDS = {
    "en": "the small queue keeps all of the old records and it was never empty before the last review of this table",
    "de": "die kleine Warteschlange behält alle alten Einträge und sie war vor der letzten Prüfung dieser Tabelle niemals leer",
    "fr": "la petite file garde tous les anciens relevés et elle n'était jamais vide avant la dernière relecture de cette table",
    "zh": "这个小的队列保留了所有的旧记录在上次检查之前它从来没有空过", "ja": "この小さなキューはすべての古い記録を残していて前回の確認までは空になったことがありません",
}
CODES = [("en", "eng", "English"), ("de", "deu", "German"), ("fr", "fra", "French"), ("zh", "zho", "Chinese"), ("ja", "jpn", "Japanese")]


def sentence(lang):
    return WORDS[lang] + ("。" if lang in ("zh", "ja") else ".")


@pytest.fixture(scope="module")
def profiles():
    return L.fit_profiles([(lang, sentence(lang) + " ") for lang in WORDS for _ in range(3)])


def test_sentences_skip_what_is_no_text():
    text = "# Überschrift hier\n\nEin Satz mit [Link](http://x.y/the/of). Noch einer, 2.5 lang!\n\n```py\nthe = of\n```\n\n- Punkt eins.\n\n\\section{Title}\nLast one"
    got = [(p.strip(), whole) for _, _, p, whole in L.sentences(text)]
    assert [w for _, w in got] == [True, True, True, False]
    assert "the" not in " ".join(p for p, _ in got).split()


def test_distances_match_a_plain_count(profiles):
    from collections import Counter

    text = sentence("de") + " " + sentence("en")
    counts = Counter(g for w in L.WORD.findall(text) for g in L.word_ngrams(w) if g in profiles.number)
    order = sorted(counts, key=lambda g: (-counts[g], profiles.order[profiles.number[g]]))
    far, _, whole = profiles.distances([text], __import__("numpy").array([0]))
    for j, lang in enumerate(profiles.languages):
        if not profiles.wide[j]:
            want = sum(abs(int(profiles.rank[profiles.number[g], j]) - i) for i, g in enumerate(order)) / len(order)
            assert abs(far[0, j] - want) < 1e-9 and abs(whole[0, j] - want) < 1e-9


def test_long_words_are_scored_whole(profiles):
    word = "q" * 64 + "warteschlange"
    places = [int(profiles.order[profiles.number[g]]) for g in L.word_ngrams(word) if g in profiles.number]
    assert profiles.grams(word) == places and len(places) > len(profiles.grams(word[:64]))
    assert word not in profiles.memo


def test_counts_and_ranks_have_no_limit(profiles):
    import numpy as np

    a, b = sentence("de"), sentence("en")
    many = (a + " ") * 40_000 + (b + " ") * 70_000  # both counts are over 65,535 for some n-grams
    from collections import Counter

    per = [Counter(g for w in L.WORD.findall(x) for g in L.word_ngrams(w) if g in profiles.number) for x in (a, b)]
    counts = Counter({g: 40_000 * per[0][g] + 70_000 * per[1][g] for g in per[0] | per[1]})
    assert sorted(counts.values())[-2] > 65_535
    order = sorted(counts, key=lambda g: (-counts[g], profiles.order[profiles.number[g]]))
    far, _, whole = profiles.distances([many], np.array([0]))
    j = profiles.languages.index("de")
    want = sum(abs(int(profiles.rank[profiles.number[g], j]) - i) for i, g in enumerate(order)) / len(order)
    assert abs(far[0, j] - want) < 1e-9 and abs(whole[0, j] - want) < 1e-9
    keys = np.array([0, 1, 2, len(profiles.number) + 1])
    out = [np.zeros((2, len(profiles.languages))) for _ in range(2)]
    profiles._out_of_place(keys, np.array([1, 3, 2, 1]), out[0])
    profiles._out_of_place(keys, np.array([1, 3, 2, 1]) * 2**58, out[1])  # too great to be packed
    assert (out[0] == out[1]).all() and out[0].any()


def test_long_formulas_and_tags_are_no_text():
    formula = "$" + " + ".join(f"the_{{{i}}}" for i in range(60)) + "$"
    tag = "<a " + " ".join(f'x{i}="of the"' for i in range(80)) + ">"
    plain = L.masked(f"Wort {formula} und {tag} noch ($5-$8) eins.")
    assert len(formula) > 200 < len(tag) and "the" not in plain and "of" not in plain and plain.split() == ["Wort", "und", "noch", "($5-$8)", "eins."]


def test_fit_takes_whole_texts_of_a_hot_key(spark):
    head, tail = sentence("de") * 300, " " + sentence("fr") * 900
    rows = [(None, f"{sentence('de')} {sentence('de')} {i}.", "de") for i in range(500)] + [(1, head + tail, "fr")]
    fitted = L.fit_from_documents(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), CODES, most=5)
    assert fitted.languages == ["de", "fr"]
    far, _, _ = fitted.distances([sentence("fr")])
    assert far[0, 1] < far[0, 0]


def test_passages(spark, profiles):
    mixed = f"{sentence('de')} {sentence('de')} {sentence('fr')} {sentence('de')}\n\n{sentence('ja')}"
    docs = [(i, sentence(lang) + " " + sentence(lang), lang) for i, lang in enumerate(WORDS)]
    docs += [(10, mixed, "de-AT"), (11, None, "en"), (12, "", None), (13, " \n ", "en"), (14, "12345 ...", "en"), (15, "Hm. " * 20_000, "en"), (0, docs[0][1], "en")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id bigint, text string, lang string, start int")
    rows = L.identify_languages(df, profiles, label=L.label_code(F.col("lang"), CODES)).collect()
    for i, lang in enumerate(WORDS):
        assert {(r["doc_lang"], r["lang"]) for r in rows if r["doc_id"] == i} == {(lang, lang)}
    ten = sorted((r["start"], r["lang"]) for r in rows if r["doc_id"] == 10)
    assert [g for _, g in ten] == ["de", "fr", "de", "ja"] and {r["doc_lang"] for r in rows if r["doc_id"] == 10} == {"de"}
    assert all(0 <= r["confidence"] <= 1 for r in rows)
    for i in (11, 12, 13):
        assert [(r["lang"], r["doc_confidence"]) for r in rows if r["doc_id"] == i] == [(None, 0.0)]
    assert len([r for r in rows if r["doc_id"] == 0]) == 2
    assert L.identify_languages(df.limit(0), profiles).count() == 0
    assert {r["lang"] for r in L.identify_languages(df, L.Profiles({})).collect()} == {None}


def test_labels(spark):
    labels = [("en", "en"), (" EN_us ", "en"), ("German", "de"), ("deu", "de"), ("de-AT", "de"), ("xx", None), ("-", None), (None, None), ("", None)]
    df = spark.createDataFrame(labels, "l string, want string")
    assert df.where(~L.label_code(F.col("l"), CODES).eqNullSafe(F.col("want"))).count() == 0


def test_fit_from_documents_finds_wrong_labels(spark):
    rows = [(i, " ".join([sentence(lang)] * 3), lang if i % 10 else "en") for i, lang in enumerate(list(WORDS) * 12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    fitted = L.fit_from_documents(df, CODES, most=8)
    got = {r["doc_id"]: r["doc_lang"] for r in L.identify_languages(df, fitted).collect()}
    assert all(got[i] == lang for i, lang in enumerate(list(WORDS) * 12))
    assert L.fit_from_documents(df.limit(0), CODES).languages == []
