import pytest

from vellumdex.llm import markup, markup_rules as rules, markup_signs
from vellumdex.llm.markup_writer import Writer

SCHEMA = "id bigint, text string, search_text string"


def kinds(text):
    return rules.kinds_of(markup_signs.line_signs(text.split("\n")))


def labelled(*texts):
    return [rules.kinds_of(labels) for _, labels, _ in markup.label_blocks(list(texts), markup.BlockLabeller.load(), markup.Features())]


PLAIN = [
    "A price of $5-$9 and US$30, (x < 10, y > 3), R&D, ~40 %, 2 * 3 * 4 = 24.", "See C:\\temp\\new and a_b_c for == 7 items.", "(k<=5 && m>=3) or (p|q) or {3, 5} or [0, 1)",
    "('a', 'b') ===> (4 > 3 < 9) (n^2) (-> 12) (<5 ms)", "It's the readers' choice, isn't it.", "这个集合比较了标题清单。",
]
MARKED = [
    ("<p>one</p>", {"html"}), ("a <b>c</b> d", {"html"}), ("x &amp; y", {"html"}), ("<!-- note -->", {"html"}), ("line<BR />", {"html"}), ("<img src='a'\n  width=4>", {"html"}),
    ("## Head", {"markdown"}), ("Title\n=====", {"markdown"}), ("> quoted", {"markdown"}), ("- item", {"markdown"}), ("1. item", {"markdown"}), ("some *word* here", {"markdown"}), ("some `code` here", {"markdown"}),
    ("[a](b.md)", {"markdown"}), ("![a](b.png)", {"markdown"}), ("| a | b |\n|---|---|", {"markdown"}), ("---\n", {"markdown"}), ("a note[^1]", {"markdown"}), ("a \\*star\\*", {"markdown"}), ("~~gone~~", {"markdown"}), ("`<b>` shown", {"markdown"}),
    ("[[Page|name]]", {"wiki"}), ("'''bold'''", {"wiki"}), ("== Head ==", {"wiki"}), ("{{Infobox|a=1}}", {"wiki"}), ("{| class=x\n|-\n| a || b\n|}", {"wiki"}), ("__NOTOC__", {"wiki"}),
    ("\\section{One}", {"latex"}), ("\\begin{itemize}\n\\item a\n\\end{itemize}", {"latex"}), ("so $a^2 + b$ holds", {"latex"}), ("\\[ x = \\frac{1}{2} \\]", {"latex"}), ("as in \\ref{s:1}", {"latex"}), ("a~\\cite{b}", {"latex"}),
    ("# Head\nwith <i>x</i>", {"markdown", "html"}),
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_prose_is_no_markup(text):
    assert kinds(text) == set()


@pytest.mark.parametrize("text, want", MARKED)
def test_signs(text, want):
    assert kinds(text) == want


def test_labeller_names_the_kinds_itself():
    texts = [f"The queue drops most of the queries.\n\n{t}\n\nNothing else was touched." for t, _ in MARKED]
    assert [(t, f) for t, f, (_, want) in zip(texts, labelled(*texts), MARKED) if f != want] == []
    assert labelled(*PLAIN) == [set()] * len(PLAIN)


def test_made_up_documents_of_known_kinds():
    pool = ["The lamp of the old harbour was lit before noon.", "Nobody had counted the boats.", "Der Hafen war leer.", "港口里没有船。", "Порт был пуст.", "Le port était vide depuis hier.", "港には船がありませんでした。"]
    documents = Writer(pool, 123).corpus(600)
    found = labelled(*("\n".join(lines) for lines, _ in documents))
    right = [rules.kinds_of(labels) for _, labels in documents]
    hit, named, true = sum(len(a & b) for a, b in zip(found, right)), sum(map(len, found)), sum(map(len, right))
    assert hit >= 0.98 * true and hit >= 0.98 * named


MARKS = [("an *important* word", {"markdown"}), ("a [link](a/b.md) here", {"markdown"}), ("a <b>bold</b> word", {"html"}), ("as in \\cite{a1} and", {"latex"}), ("a [[Page|name]] b", {"wiki"}), ("[[Main page|main]]", {"wiki"}), ("[the page](../x.md)", {"markdown"}), ("\\section{Words}", {"latex"}), ("$x^2+1$", {"latex"}), ("<b>bold</b>", {"html"})]


@pytest.mark.parametrize("mark, want", MARKS)
@pytest.mark.parametrize("before, after", [(0, 0), (728, 0), (5000, 0), (5000, 5000)])
def test_marks_late_in_a_long_line(mark, want, before, after):
    plain = "the small queue keeps all of the old records and was never empty before the last review "
    line = (plain * 100)[:before] + " " + mark + " " + (plain * 100)[:after]
    ((lines, labels, _),) = markup.label_blocks([line], markup.BlockLabeller.load(), markup.Features())
    assert rules.kinds_of(labels) == want
    assert markup.clean_text(lines, labels) == rules.clean_line(line, labels[0]).rstrip() != line.rstrip()


def test_tables_formulas_and_elements_without_limits():
    formula = "$" + " + ".join(f"x_{{{i}}}^{{2}}" for i in range(40)) + "$"
    assert len(formula) > 200
    nested = "\n".join([f"\\begin{{b{i}}}" for i in range(9)] + ["The boats lay still."] + [f"\\end{{b{i}}}" for i in reversed(range(9))] + ["Nobody had counted them."])
    assert labelled("|a|b|\n|--|--|\n|1|2|", f"so {formula} holds", nested) == [{"markdown"}, {"latex"}, {"latex"}]
    assert rules.tag_paths(nested.split("\n"))[-1] == ""
    deep = rules.tag_paths(["{|"] + [f"\\begin{{b{i}}}" for i in range(9)] + ["words"])
    assert deep[-1].startswith("wikitable>b3")
    assert rules.tag_paths(["\\begin{x}"] * 50_000 + ["\\end{y}"] * 50_000)[-1] == "x>x>x>x>x>x"


def test_every_character_is_in_a_block():
    features = markup.Features()
    line = " ".join(f"w{i}" if i % 7 else f"*{i}*" for i in range(2000))
    blocks, counts = features.blocks([line, "", "short one"], ["", "", ""])
    step = markup.BLOCK_CHARS - markup.SHARED_CHARS
    assert counts == [len(blocks) - 2, 1, 1] and (counts[0] - 1) * step + markup.BLOCK_CHARS >= len(line)
    assert all(len(b) > 3 for b in blocks[: counts[0]])


def test_wiki_table_headers(spark):
    rows = [(1, "{|\n! a !! b\n|-\n| 1 || 2\n|}", None), (2, "{|\n! a\n! b\n|-\n| 1 || 2\nmore of it\n\n|}", None)]
    clean = {r["id"]: r for r in markup.clean_markup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert clean[1]["text"] == "a\tb\n1\t2"
    assert [tuple(b) for b in clean[1]["blocks"]] == [("table", "a\tb"), ("table", "1\t2")]
    lines = rows[1][1].split("\n")
    assert [bool(x) for x in markup_signs.line_signs(lines)] == [True] * 6 + [False, True]
    assert kinds("! a !! b") == {"wiki"} and kinds("the end -->") == {"html"} and kinds("-- -") == {"markdown"}
    assert kinds("Stop! It works!! Now.") == set()


def test_gradients_match_differences():
    import numpy as np

    model = markup.BlockLabeller.fresh(3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    blocks, lengths = [[1, 2], [3], [4, 5, 6], [7]], np.array([1, 3])
    counts = np.array([1, 2, 1])  # the second line has two blocks
    truth = (np.random.default_rng(0).random((3, len(rules.LABELS))) > 0.5).astype(float)
    _, grads = model.gradients(blocks, lengths, truth, counts)
    for name in ("Wf", "Wb", "bf", "V", "c", "E"):
        flat = model.p[name].reshape(-1)
        for i in (int(np.abs(grads[name]).argmax()),):
            old = flat[i]
            flat[i] = old + 1e-5
            up, _ = model.gradients(blocks, lengths, truth, counts)
            flat[i] = old - 1e-5
            down, _ = model.gradients(blocks, lengths, truth, counts)
            flat[i] = old
            assert abs((up - down) / 2e-5 - grads[name].reshape(-1)[i]) < 2e-3 * max(1, abs(grads[name].reshape(-1)[i]))


def test_training_learns():
    import numpy as np

    from vellumdex.llm.train_markup import matrix

    texts = [["plain words here", "<p>x</p>", "more"], ["# head", "text"], ["nothing", "at all"]] * 20
    model = markup.train(texts, [matrix(markup_signs.line_signs(t)) for t in texts], epochs=30, batch=12)
    features = markup.Features()
    prob = model.line_probabilities([features.blocks(texts[0], rules.tag_paths(texts[0]))])
    j = rules.LABELS.index("html")
    assert prob[1, j] > 0.5 > prob[0, j]


def test_found_and_clean(spark):
    body = "The queue drops most of the queries.\n\n## Head\n\n- an *important* item\n\n```\ncode *stays*\n```"
    rows = [(1, body, "ctx\n\n" + body), (1, body, "ctx\n\n" + body), (2, None, None), (3, "", ""), (4, "plain text.", "<p>plain text.</p>"), (None, "a [[Page|name]] b", None), (5, "x" * 50_000, "x" * 50_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = [(r["id"], r["kinds"]) for r in markup.find_markup(df).collect()]
    assert found.count((1, ["markdown"])) == 2 and (2, []) in found and (3, []) in found and (4, ["html"]) in found and (None, ["wiki"]) in found and (5, []) in found
    clean = {r["id"]: r for r in markup.clean_markup(df).collect()}
    assert clean[1]["text"] == "The queue drops most of the queries.\n\nHead\n\n• an important item\n\ncode *stays*"
    assert [b["shape"] for b in clean[1]["blocks"]] == ["heading", "list", "code"]
    assert clean[2]["text"] is None and clean[3]["text"] == "" and clean[4]["search_text"] == "plain text." and clean[None]["text"] == "a name b"
    assert markup.find_markup(df.limit(0)).count() == 0 and markup.clean_markup(df.limit(0)).count() == 0
