import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellumdex.llm import splitting as S

SCHEMA = "id bigint, text string, section_path string, title string, context_text string, extra int"


def test_range_maximum_matches_brute_force():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 64, 100):
        v = r.integers(0, 4, n)
        index = S.StrongestCut(v)
        for lo in range(n):
            for hi in range(lo, n):
                best = max(range(lo, hi + 1), key=lambda i: (v[i], i))
                assert index.query(lo, hi) == best


ALPHABET = ["a", "B", "9", "中", "é", "é", "ﬁ", "㎏", "½", " ", "\n", "\n\n", ". ", "。", ", ", "-", "\n# ", "か゛", "ß", "İ", "\t", "_", "<", "…", "\uff0c", "\uff01", "\uff1f", "\uff1b", "\uff1a", "\u3001"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=200), st.integers(4, 30), st.integers(0, 3))
def test_pieces_hold_every_limit(parts, most, overlap):
    text = "".join(parts)
    pieces = S.split_text(text, most, overlap)
    total = S.atom_count(text)
    assert len(pieces) == 1 if total <= most else len(pieces) > 1
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for a, b, n in pieces:
        assert a <= b and n <= most
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:]):
        assert a < c and b < d or b == d
        assert c <= b or not S.atom_count(text[b:c])
        assert S.atom_count(text[c:b]) <= overlap if c < b else True


def test_cuts_at_the_strongest_place():
    text = " ".join(["w"] * 10) + ". " + " ".join(["w"] * 5) + "\n\n" + " ".join(["w"] * 12)
    pieces = S.split_text(text, 20, 4)
    assert text[pieces[0][0] : pieces[0][1]].endswith("w") and text[pieces[0][1] :].startswith("\n\n")
    equal = " ".join(["w"] * 50)
    assert S.split_text(equal, 20, 0)[0][2] == 20  # of equal cuts the rightmost


def test_full_width_stops():
    text = "天气很好\uff0c我们去公园\uff01你来吗\uff1f好的\uff1b再见\uff1a明天\u3001后天\u3002完"
    spans = S.atom_spans(text)
    found = {text[spans[k - 1][1]]: int(v) for k, v in enumerate(S.gap_strengths(text, spans)) if 0 < k < len(spans) and spans[k][0] > spans[k - 1][1]}
    assert found == {"\uff0c": S.CLAUSE, "\uff1b": S.CLAUSE, "\uff1a": S.CLAUSE, "\u3001": S.CLAUSE, "\uff01": S.SENTENCE, "\uff1f": S.SENTENCE, "\u3002": S.SENTENCE}


@pytest.mark.parametrize("letters, stops", [("天地人和山水火木", "\uff0c\u3002\uff01\uff1f\uff1b\uff1a"), ("あいうえ日本語の", "\u3001\u3002\uff01\uff1f")])
def test_cuts_are_the_strongest_of_their_windows(letters, stops):
    r = random.Random(6)
    text = "".join("".join(r.choice(letters) for _ in range(r.randint(7, 19))) + r.choice(stops) for _ in range(120))
    spans = S.atom_spans(text)
    strengths = S.gap_strengths(text, spans)
    most, overlap = 60, 12
    bounds = S.piece_bounds(strengths, most, overlap)
    assert len(bounds) > 5
    for (a, end), (start, _) in zip(bounds, bounds[1:]):
        window = range(a + max(overlap + 1, most // 2), a + most + 1)
        assert end == max(window, key=lambda i: (strengths[i], i)) and strengths[end] >= (S.CLAUSE if len(spans) else 0)
        back = range(max(end - overlap, a + 1), end - overlap // 2 + 1)
        assert start == max(back, key=lambda i: (strengths[i], i))


def test_long_text_without_breaks():
    text = "中" * 5000
    assert all(n <= 800 for _, _, n in S.split_text(text))
    assert len(S.split_text("a" * 100_000)) == 1  # one atom
    with pytest.raises(ValueError):
        S.piece_bounds(np.zeros(11), 5, 5)


def test_operator(spark):
    long = " ".join(f"word{i}." for i in range(1000))
    rows = [(1, long, "Sec", "T", "ctx", 0), (1, long, "Sec", "T", "ctx", 0), (2, "short", None, "T", None, 0), (3, None, "s", "t", "c", 0), (4, "", " ", None, "", 0), (None, "x", "s", "t", "", 0)]
    out = S.split_chunks(spark.createDataFrame(rows, SCHEMA)).collect()
    first = [r for r in out if r["id"] == 1]
    assert len(first) == 4 and {r["section_path"] for r in first} == {"Sec::part1", "Sec::part2"}
    assert all(r["search_text"].startswith("ctx\n\n") and r["token_count"] == S.atom_count(r["search_text"]) for r in first)
    by = {r["id"]: r for r in out if r["id"] != 1}
    assert by[2]["section_path"] == "T" and by[2]["n_pieces"] == 1
    assert 3 not in by and by[4]["section_path"] == "untitled" and by[4]["token_count"] == 0 and by[None]["text"] == "x"
    assert S.split_chunks(spark.createDataFrame([], SCHEMA)).count() == 0


def test_found_query_counts_the_text(spark, tmp_path):
    from vellumdex.llm.queries import p1_found

    r = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(n)), None, None, None, 0) for i, n in enumerate([800, 801, 799, 5000, 0] + [r.randint(1, 1600) for _ in range(20)])]
    spark.createDataFrame(rows + rows[:3], SCHEMA).write.parquet(str(tmp_path / "chunks.parquet"))
    assert sorted(x["id"] for x in p1_found(spark, str(tmp_path)).collect()) == sorted(i for i, t, *_ in rows if S.atom_count(t) > 800)
