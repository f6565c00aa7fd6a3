"""Made-up documents whose markup is known, for fitting and judging the block labeller.

A document is written line by line in one or two markup languages, or in none. Each line comes
with the labels it was *written* with, so that no rule decides what counts as markup. Sentences
are any plain prose; between them stand signs that are no markup (prices, paths, comparisons,
identifiers, intervals, key=value pairs).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from vellumdex.llm.markup_rules import CODE, FORMULA, HEADING, HTML, LATEX, LIST, MARKDOWN, TABLE, WIKI

Line = tuple[str, frozenset[str]]

_SYLLABLES = "ba cor dre el fin gal hir is jun ka lem mor nix osk pel qui ras sel tov um von wex yar zel".split()

# Signs that prose holds without being markup; w is a word, n a number, x a letter.
INNOCENT = [
    "[n]", "(x < n, x > n)", "(n > n < n)", "(x<=n && x>=n)", "(x|x)", "(n * n * n = n)", "a_b_c", "w_w_w", "w_w", "w_nx", "w_n", "(R&D)", "AT&T", "[n, n)", "(n, n]", "(<n ms)", "($n-$n)", "(US$n)", "$n.n", "$n and $n", "$n for w, $n for w", "n$",
    "(C:\\w\\w)", "(C:\\w\\nxw)", "C:\\w\\w_w\\w.txt", "\\\\w\\w\\w", "(~n %)", "~n", "== n", "===> n", "(-> n)", "-> w", "=> w", "<- w", "<-> w", "{n, n}", "{n}", "{w}", "('x', 'x')", "(x^n)", "x^n", "w=n", "w=n w=n", "w-n=n", "w_w=n", "w-n", "w-nx", "w-n w=n w_w",
    "/w/w/w", "~/w/w_w", "../w/w.md", "w.md", "w_w.py", "w/w_w", "f(x)", "x[n]", "w[n]", "#n", "#w", "@w", "--w", "-x", "-n", "n-n", "n*n", "n * n", "x*x", "x**n", "w++", "!w", "x != x", "x == n", "x -> x", "n% & more", "w & w", "\"w\"", "'w'", "'w w'", "n' n\"", "$W", "€n", "w|w|w", "x || x", "| w", "[sic]",
    "[…]", "[w]", ">= n", "<= n", "<< w", ">> w", "<n", "> n", "< n", "^_^", "_w", "w_", "http://w.org/w_w?x=n&y=n", "https://w.net/w-w#w", "w@w.org", "n:n", "n/n", "w:w", "x := n", "x; x", "±n", "n °C", "* n", "w*", "** n", "…", "w--w", "– w –", "`", "w`s", "n^n", "x_n", "(x_n, x_n)", "%w", "n%", "100 %", "{}", "[]", "()", "<>", "\\", "&", "&w", "$", "_", "*",
    "x = n", "x <= w", "if x < x", "w(n) > n", "(n+n)", "+n", "n+", "=n", "= n", "w = w", "~w", "n ~ n", "!!", "?!", "w!!", "::", "w::w", "';'", "';", "w';", "//", "/*", "w//w", "<--", "<---", "=====> w", ":-)", ";-)", "<3", "o_o", "T_T", "¯\\_(x)_/¯",
]
# Lines of programs and listings; in a code block only.
PROGRAM = [
    "w = n", "w=n", "w-n = n", "w_w = n", "W=n", "def w(x):", "    return x + n", "if x < n and x > n:", "# w w w", "## w", "// w", "/* w */", "x = {'x': n}", "w[n] = [[n]]", "print(w)", "<x>w</x>", "**w**", "for x in range(n):", "  - w: n", "* w", "int *w = &x;", "$ w --w n",
    "SELECT * FROM w WHERE x > n;", "{", "}", "  w;", "", "w -> w", "w w w", "[w](w)", "''w''", "== w ==", "\\w{w}", "x$n", "w: w", "w", "w.w(n)", "> w", "> 5 > w", "<!-- w -->", "| w | n |", "=====", "---",
]


class Writer:
    """Writes documents from a pool of plain sentences; the same seed gives the same documents."""

    def __init__(self, sentences: Sequence[str], seed: int = 5):
        self.r = np.random.default_rng(seed)
        self.pool = list(sentences)

    # ---- parts of a text

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def one(self, of: Sequence):
        return of[int(self.r.integers(len(of)))]

    def name(self) -> str:
        word = "".join(self.one(_SYLLABLES) for _ in range(int(self.r.integers(1, 4))))
        style = self.r.random()
        if style < 0.1:
            word = f"{word}-{self.number()}"
        elif style < 0.2:
            word = f"{word}_{self.one(_SYLLABLES)}"
        elif style < 0.25:
            word = f"{word}{self.number()}{self.one('abkmz')}"
        elif style < 0.28:
            word = f"{word}.{self.number()}{self.one('abkmz')}"
        return word.capitalize() if self.chance(0.25) else word

    def number(self) -> str:
        return str(int(self.r.integers(0, self.one([10, 10, 100, 100000]))))

    def letter(self) -> str:
        return self.one("abcdefijkmnpqrstuvxyz")

    def filled(self, pattern: str) -> str:
        """A pattern with its w, W, n and x replaced where they stand alone."""
        out = []
        for i, c in enumerate(pattern):
            before, after = pattern[i - 1 : i], pattern[i + 1 : i + 2]
            alone = not (before.isalpha() and before not in "wnx") and not (after.isalpha() and after not in "wnx")
            out.append({"w": self.name, "W": lambda: self.name().upper(), "n": self.number, "x": self.letter}[c]() if c in "wWnx" and alone else c)
        return "".join(out)

    def sentence(self) -> str:
        text = self.one(self.pool)
        return text.upper() if self.chance(0.02) else text

    def title(self) -> str:
        words = self.sentence().rstrip(".。!?").split(" ")
        few = " ".join(words[: int(self.r.integers(1, 5))])[: int(self.r.integers(4, 40))].strip() or self.name()
        return f"{few} {self.one([self.name, self.number])()}" if self.chance(0.4) else few

    def prose(self, mark: Callable[[str], str] | None = None, most: int = 5, marked: float = 1.0) -> tuple[str, bool]:
        """Some sentences in one line, and whether one of them got a mark."""
        parts, done = [], False
        for _ in range(int(self.r.integers(1, most + 1))):
            sentence = self.sentence()
            if mark is not None and self.chance(0.1):  # a mark can also stand in or beside signs that are none
                sentence = f"{sentence} {self.filled(self.one(INNOCENT))} {self.name()}"
            if mark is not None and self.chance(marked / 2) or (mark is not None and marked >= 1 and not parts):
                sentence, done = mark(sentence), True
            parts.append(sentence)
            if self.chance(0.15):
                parts.append(self.filled(self.one(INNOCENT)))
        if self.chance(0.02):
            parts.insert(0, self.filled(self.one(INNOCENT)) + ":")
        text = parts[0]
        for a, b in zip(parts, parts[1:]):
            text += ("" if a[-1:] in "。！？" and self.chance(0.7) else " ") + b
        return text, done

    def around(self, sentence: str, left: str, right: str) -> str:
        """A mark put around one word, or around some characters where there are no blanks."""
        words = sentence.split(" ")
        if len(words) > 3 and self.chance(0.93):
            j = int(self.r.integers(len(words)))
            if self.chance(0.12):  # a name, a number or a letter instead of the sentence's own word
                words[j] = self.one([self.number, self.letter, self.name, lambda: self.filled(self.one(["n.n", "w-n", "-n", ".n", "w'w", "n:n", "w_w"]))])()
            span = 1 if self.chance(0.85) else int(self.r.integers(1, 5))
            inner = " ".join(words[j : j + span])
            tail = inner[-1:] if inner[-1:] in ".,;:!?" and len(inner) > 1 and self.chance(0.6) else ""
            inner = inner[: len(inner) - len(tail)]
            return " ".join([*words[:j], f"{left}{inner}{right}{tail}", *words[j + span :]])
        if len(sentence) < 4:
            return f"{left}{sentence}{right}"
        if self.chance(0.15):  # a number or name at one border of the mark
            at = int(self.r.integers(1, len(sentence) - 2))
            sentence = sentence[:at] + self.one([self.number, self.name])() + sentence[at:]
            return sentence[:at] + left + sentence[at : at + 4] + right + sentence[at + 4 :] if len(sentence) > at + 5 and not sentence[at + 3].isspace() else left + sentence + right
        a = int(self.r.integers(0, len(sentence) - 3))
        b = min(len(sentence) - 1, a + int(self.r.integers(1, 6)))
        while a < b - 1 and sentence[a].isspace():
            a += 1
        while b > a + 1 and sentence[b - 1].isspace():
            b -= 1
        return sentence[:a] + left + sentence[a:b] + right + sentence[b:]

    def after(self, sentence: str, mark: str) -> str:
        return sentence + mark

    # ---- HTML

    def html_mark(self, s: str) -> str:
        n = self.one(["b", "i", "em", "strong", "span", "font", "code", "sub", "sup", "u", "small", "kbd", "mark", "abbr", "q", "s", "del", "tt", "big", "cite"])
        n = self.one([n, n, n, n.upper(), n.capitalize()])
        href = self.one([f'"/p/{self.number()}"', f"'/p/{self.number()}'", f"/p/{self.number()}", f'"https://{self.name()}.org/{self.name()}"'])
        attribute = self.one(["", "", "", f' class="{self.name()}"', f" id={self.name()}", f" style='color:red'", f' title="{self.name()} {self.name()}"'])
        entity = self.one(["&nbsp;", "&amp;", "&lt;", "&gt;", "&quot;", "&#8217;", "&#x2013;", "&mdash;", "&eacute;", "&hellip;", "&amp;nbsp;", "&copy;", "&#39;", "&rsquo;", "&apos;"])
        return self.one(
            [
                lambda: self.around(s, f"<{n}{attribute}>", f"</{n}>"), lambda: self.around(s, f"<{n}>", f"</{n}>"), lambda: self.around(s, f"<a href={href}>", "</a>"), lambda: self.around(s, f"<a href={href}>", "</a>"),
                lambda: self.after(s, self.one(["<br>", "<br/>", "<br />", "<br >", "<BR>", "<BR />", "<hr>", "<hr/>"])), lambda: self.after(s, f" <!-- {self.name()} -->"), lambda: self.after(s, f'<img src="img/{self.number()}.png" alt="{self.name()}">'),
                lambda: self.around(s, entity, self.one([entity, "", " "])), lambda: self.around(s, "", entity), lambda: self.around(s, "&lt;b&gt;", "&lt;/b&gt;"), lambda: self.around(s, f"&lt;{n}&gt;", f"&lt;/{n}&gt;"), lambda: self.around(s, "&quot;", "&quot;"),
                lambda: self.after(s, f"<sup>{self.number()}</sup>"), lambda: self.after(s, "</p>"), lambda: "<p>" + s, lambda: self.after(s, self.one(["</div>", "</span>", "</li>", "</td>", "</b>"])),
            ]
        )()

    def html_block(self) -> list[Line]:
        w = self.name
        on = frozenset({HTML})
        attribute = self.one(["", "", "", "", ' class="lead"', f" id='s{self.number()}'", ' style="margin:0"', f' class="box {w()}"'])
        mark = self.html_mark if self.chance(0.3) else None
        kind = self.r.random()
        if kind < 0.16:
            k = int(self.r.integers(1, 7))
            tag = self.one([f"h{k}", f"h{k}", f"H{k}"])
            return [(f"<{tag}{attribute if self.chance(0.2) else ''}>{self.title()}</{tag}>", on | {HEADING})]
        if kind < 0.34:
            if self.chance(0.2):
                return [(f"<p{attribute}>", on), (self.prose()[0], frozenset()), ("</p>", on)]
            if self.chance(0.15):
                return [(f"<p{attribute}>{self.prose(mark)[0]}", on), (self.prose()[0], frozenset()), (f"{self.prose(mark, 2)[0]}</p>", on)]
            end = "" if self.chance(0.15) else "</p>"
            return [(f"<p{attribute}>{self.prose(mark)[0]}{end}", on)]
        if kind < 0.44:
            tag, end = self.one(["ul", "ol", "UL"]), self.one(["</li>", "", ""])
            pad = self.one(["", "", "  "])
            items = [(f"{pad}<li>{self.prose(mark, 2)[0]}{end}", on | {LIST}) for _ in range(int(self.r.integers(1, 5)))]
            return [(f"<{tag}>", on), *items, (f"</{tag}>", on)]
        if kind < 0.52:
            if self.chance(0.5):
                rows = "".join(f"<tr><td>{w()}<td>{self.number()}{self.one(['', '</td>'])}</tr>" for _ in range(int(self.r.integers(1, 4))))
                return [(f"<table{attribute}>{rows}</table>", on | {TABLE})]
            cell = self.one(["td", "th"])
            rows = [(f"{self.one(['', '  '])}<tr><{cell}>{w()}</{cell}><{cell}>{self.number()}</{cell}></tr>", on | {TABLE}) for _ in range(int(self.r.integers(1, 4)))]
            return [(f"<table{attribute}>", on), *rows, ("</table>", on)]
        if kind < 0.6:
            if self.chance(0.5):
                return [(f"<pre><code>{w()} = {self.number()}</code></pre>", on | {CODE})]
            body = [(self.filled(self.one(PROGRAM)).replace("</", "<"), on | {CODE}) for _ in range(int(self.r.integers(1, 5)))]
            return [(self.one(["<pre>", "<pre><code>", '<pre class="x">']), on | {CODE}), *body, (self.one(["</pre>", "</code></pre>"]), on | {CODE})]
        if kind < 0.68:
            end = self.one([f"   width={self.number()}>", f'  height="{self.number()}">', "   />", f'   title="{w()}" />', "   >"])
            start = self.one([f'<img src="img/{self.number()}.png" alt="{w()}"', f'<a href="/p/{self.number()}"', '<div class="x"', "<td"])
            return [(start, on), (end, on)]
        if kind < 0.76:
            return [(self.one([f"<!-- {w()} {w()} -->", f"<script>var {self.letter()}={self.number()};</script>", "<style>p {margin: 0}</style>", f"<title>{self.title()}</title>", f'<meta charset="utf-8">', f'<link rel="x" href="{w()}.css">', "<!DOCTYPE html>"]), on)]
        if kind < 0.82:
            return [("<!--", on), *[(self.prose(None, 2)[0] if self.chance(0.6) else w(), on) for _ in range(int(self.r.integers(1, 3)))], ("-->", on)]
        if kind < 0.9:
            return [(f"<div{attribute}>", on), *([(self.prose()[0], frozenset())] if self.chance(0.5) else []), ("</div>", on)]
        if kind < 0.94:
            return [(self.one(["<html>", "</html>", "<body>", "</body>", "<head>", "</head>", "<hr>", "<hr />", "<br>", "</div>", "</table>", "<blockquote>", "</blockquote>", "</ul>", "<ul>", "<dl>", "<section>", "&nbsp;"]), on)]
        return [(self.prose(self.html_mark)[0], on)]

    # ---- Markdown

    def markdown_mark(self, s: str) -> str:
        w = self.name
        left, right = self.one([("*", "*"), ("**", "**"), ("_", "_"), ("__", "__"), ("***", "***"), ("___", "___"), ("~~", "~~"), ("`", "`"), ("``", "``"), ("**`", "`**")])
        place = self.one([f"{w()}/{w()}.md", f"../{w()}.md", f"./{w()}.md", f"img/{w()}.md", f"https://{w()}.org/{w()}", f"#{w()}", f'{w()}.md "{w()}"', "<a b.md>", ""])
        sign = self.one("*_*_#`~>+!|")
        return self.one(
            [
                lambda: self.around(s, left, right), lambda: self.around(s, left, right), lambda: self.around(s, left, right), lambda: self.around(s, "[", f"]({place})"), lambda: self.around(s, "[", f"]({place})"), lambda: self.around(s, "![", f"]({place})"),
                lambda: self.around(s, "[", f"][{self.number()}]"), lambda: self.around(s, "[", f"][{self.one([w(), ''])}]"), lambda: self.after(s, f"[^{self.one([self.number(), self.letter(), w()])}]"), lambda: self.after(s, f"[^{self.number()}]"),
                lambda: self.around(s, f"\\{sign}", f"\\{sign}"), lambda: f"{self.around(s, chr(92) + '*', chr(92) + '*')} \\_{w()}\\_", lambda: self.after(s, f" \\_{w()}\\_"), lambda: self.after(s, f" ![{w()}](img/{w()}.png)"), lambda: self.after(s, f" <https://{w()}.org>"), lambda: self.after(s, f" \\{sign}{w()}"),
                lambda: self.after(s, f" `{self.filled(self.one(INNOCENT)).replace('`', '')} {w()}`"), lambda: self.after(s, f" _{w()}_"), lambda: self.after(s, f" *{w()} {w()}*"), lambda: self.after(s, f" `<b>` `{w()}()`"),
            ]
        )()

    def markdown_block(self) -> list[Line]:
        w = self.name
        on = frozenset({MARKDOWN})
        mark = self.markdown_mark if self.chance(0.25) else None
        kind = self.r.random()
        if kind < 0.14:
            end = self.one(["", "", "", " #", " ##"])
            return [(f"{'#' * int(self.r.integers(1, 7))} {self.title()}{end}", on | {HEADING})]
        if kind < 0.24:
            title = self.title()
            return [(title, on | {HEADING}), (self.one("=-") * int(self.r.integers(3, max(5, len(title) + 3))), on | {HEADING})]
        if kind < 0.44:
            sign = self.one(["-", "*", "+", "-", "- [ ]", "- [x]", "1.", "2.", "10.", "1)"])
            pad = self.one(["", "", "", "  ", "    "])
            out = []
            for i in range(int(self.r.integers(1, 6))):
                own = sign if sign[0] not in "12" or self.chance(0.5) else f"{i + 1}{sign[-1]}"
                body = self.prose(mark, 2)[0] if self.chance(0.8) else self.one([self.number(), w(), self.filled(self.one(INNOCENT)) + " " + w(), self.title()])
                out.append((f"{pad if i else ''}{own} {body}", on | {LIST}))
            return out
        if kind < 0.54:
            sign = self.one(["> ", ">", "> ", ">> ", "> > "])
            return [(f"{sign}{self.prose(mark, 2)[0]}", on) for _ in range(int(self.r.integers(1, 4)))]
        if kind < 0.66:
            if self.chance(0.12):
                return [(f"{w()} | {w()}", on | {TABLE}), (self.one(["--- | ---", "--|--", ":--- | ---:"]), on | {TABLE}), *[(f"{w()} | {self.number()}", on | {TABLE}) for _ in range(int(self.r.integers(1, 4)))]]
            rule = self.one(["|:---|---:|", "|---|---|", "| --- | --- |", "|--|--|", "|:-:|:-:|", "| :--- | ---: |"])
            rows = [(self.one(["| {} | {} |", "|{}|{}|", "| {} | {} | |"]).format(self.one([w(), w(), self.title()]), self.one([self.number(), w()])), on | {TABLE}) for _ in range(int(self.r.integers(1, 5)))]
            head = [(self.one(["| id | n |", "|a|b|", f"| {w()} | {w()} |", "|  |  |"]), on | {TABLE}), (rule, on | {TABLE})] if self.chance(0.9) else []
            return [*head, *rows]
        if kind < 0.76:
            fence = self.one(["```", "```", "~~~", "````"])
            head = fence + self.one(["", "", "python", "sql", " text", "c++"])
            body = [(self.filled(self.one(PROGRAM)), on | {CODE}) for _ in range(int(self.r.integers(1, 6)))]
            return [(head, on | {CODE}), *body, (fence, on | {CODE})]
        if kind < 0.82:
            return [(self.one(["---", "***", "___", "* * *", "- - -", "_ _ _", "-----", "-------", "*****"]), on)]
        if kind < 0.88:
            return [(self.one([f"[{self.number()}]: {w()}/{w()}.md", f"[{w()}]: https://{w()}.org", f"[^{self.number()}]: {self.prose(None, 1)[0]}", f"[{self.number()}]: notes/{w()}.md", f'[{w()}]: {w()}.md "{w()}"']), on)]
        if kind < 0.9:
            return [(self.one([f"![{w()}](img/{w()}.png)", f"![{self.one(['', '.', 'e-', 'v']) + self.number()}](img/{w()}.png)", f"**{self.title()}**", f"`{w()}`", f"[{w()}](./{w()}.md)", f"*{self.title()}*", f"__{self.title()}__"]), on)]
        return [(self.prose(self.markdown_mark)[0], on)]

    # ---- wiki text

    def wiki_mark(self, s: str) -> str:
        w = self.name
        left = self.one(["''", "'''", "'''''"])
        return self.one(
            [
                lambda: self.around(s, left, left), lambda: self.around(s, left, left), lambda: self.around(s, "[[", "]]"), lambda: self.around(s, f"[[{self.one([w(), w() + ' ' + w()])}|", "]]"), lambda: self.around(s, f"[[{w()}|", "]]"),
                lambda: self.after(s, f" [[#{w()}]]"), lambda: self.after(s, f"{{{{{self.one(['fn', 'ref', 'note', 'see', w()])}|{self.number()}}}}}"), lambda: self.after(s, f"{{{{fn|{self.number()}}}}}"), lambda: self.after(s, f" {{{{{w()}}}}}"),
                lambda: self.after(s, f" {{{{{self.one(['see', 'box', 'note', w()])}|{w()}={self.number()}|{w()}}}}}"), lambda: self.after(s, f" [[{self.one(['Category', 'File', 'Kategorie', 'Datei', 'Help'])}:{w()}]]"), lambda: self.after(s, f"<ref>{w()}</ref>"), lambda: self.after(s, f" [[{w()}]]"),
            ]
        )()

    def wiki_block(self) -> list[Line]:
        w = self.name
        on = frozenset({WIKI})
        mark = self.wiki_mark if self.chance(0.3) else None
        kind = self.r.random()
        if kind < 0.3:
            signs = "=" * int(self.r.integers(2, 7))
            blank = self.one([" ", " ", ""])
            return [(f"{signs}{blank}{self.title()}{blank}{signs}", on | {HEADING})]
        if kind < 0.38:
            return [(f"'''{self.title()}'''", on)]
        if kind < 0.58:
            rows: list[Line] = []
            for _ in range(int(self.r.integers(1, 4))):
                if self.chance(0.75):
                    rows += [(self.one(["|-", "|-", "|----", '|- class="x"']), on | {TABLE}), (f"| {w()} || {self.number()}", on | {TABLE})]
                else:
                    rows += [("|-", on | {TABLE}), (f"| {w()}", on | {TABLE}), (f"| {self.number()}", on | {TABLE})]
            caption = [(f"|+ {self.title()}", on | {TABLE})] if self.chance(0.15) else []
            head = [(self.one([f"! id !! n", f"! {w()} !! {w()}", f"! {w()}"]), on | {TABLE})] if self.chance(0.8) else []
            return [(self.one(['{| class="wt"', "{|", '{| class="wikitable" style="x"', "{| border=1"]), on | {TABLE}), *caption, *head, *rows, ("|}", on | {TABLE})]
        if kind < 0.66:
            return [(self.one(["__NOTOC__", "__TOC__", "__NOEDITSECTION__", "__FORCETOC__", "__NOINDEX__", "__INDEX__", "__NOGALLERY__"]), on)]
        if kind < 0.76:
            return [(f"[[{self.one(['Category', 'File', 'Kategorie', 'Catégorie', 'Datei', 'Image', 'Категория', '分类'])}:{w()}{self.one(['', '', '|thumb|' + w()])}]]", on)]
        if kind < 0.86:
            if self.chance(0.3):
                return [("{{" + self.one(["Infobox", "box", w()]), on), *[(f"| {w()} = {self.number()}", on) for _ in range(int(self.r.integers(1, 4)))], ("}}", on)]
            return [(f"{{{{{self.one(['Infobox', 'box', 'note', 'see', w()])}|{w()}={self.number()}}}}}", on)]
        return [(self.prose(self.wiki_mark)[0], on)]

    # ---- LaTeX

    def formula(self) -> str:
        x, y, n = self.letter(), self.letter(), self.number()
        tight = self.chance(0.3)
        shape = self.one(
            [
                f"{x}^{n} + {n}", f"{x}_{y} \\le \\alpha", f"\\frac{{{x}}}{{{n}}}", f"\\sum_{{{y}=1}}^{{{x}}} {y}", f"E_{x} = \\int_0^{n} {x}\\,d{x}", f"{x}^2 + {y}^2 = z^2", f"\\sqrt{{{x}}}", f"{x} = {y} + {n}", f"\\mathbf{{{x}}} \\cdot \\mathbf{{{y}}}", f"\\alpha_{{{n}}}",
                f"f({x}) = {x}^{n}", f"{x} \\in \\mathbb{{R}}", f"{x} < {y}", f"{x} \\times {n}", f"O({x} \\log {x})", f"{x}_{{{n}}}, \\dots, {x}_{{{y}}}", f"{x}", f"{x}={n}", f"\\left( {x} + {y} \\right)", " + ".join(f"{self.letter()}_{{{i}}}^{{2}}" for i in range(int(self.r.integers(2, 30)))),
            ]
        )
        return shape.replace(" ", "") if tight and "\\" not in shape else shape

    def latex_mark(self, s: str) -> str:
        w = self.name
        command = self.one(["texttt", "textbf", "emph", "textit", "underline", "textsc", "textsf", "mbox"])
        return self.one(
            [
                lambda: self.around(s, f"\\{command}{{", "}"), lambda: self.around(s, f"\\{command}{{", "}"), lambda: self.around(s, "\\texttt{", "}"), lambda: self.after(s, f"~\\cite{{{w()}{self.number()}}}"), lambda: self.after(s, f" \\cite[p. {self.number()}]{{{w()}}}"),
                lambda: self.after(s, f" (\\ref{{s:{self.number()}}})"), lambda: self.after(s, f"\\footnote{{{self.sentence()}}}"), lambda: self.after(s, f" ${self.formula()}$"), lambda: self.after(s, f" ${self.formula()}$."), lambda: self.after(s, f" \\( {self.formula()} \\)"), lambda: self.after(s, f" \\textgreater{{}} {self.number()}\\% \\ldots"),
                lambda: self.after(s, f"\\label{{{w()}}}"), lambda: self.after(s, f" $${self.formula()}$$"), lambda: self.after(s, f" {self.number()}\\%"), lambda: self.after(s, f" \\ldots"), lambda: self.after(s, " \\LaTeX{}"), lambda: self.after(s, f" \\eqref{{{w()}}}"), lambda: self.after(s, f" \\url{{https://{w()}.org}}"),
                lambda: f"${self.formula()}$ {s}", lambda: self.after(s, f" \\href{{https://{w()}.org}}{{{w()}}}"), lambda: self.after(s, " \\\\"),
            ]
        )()

    def latex_block(self) -> list[Line]:
        w = self.name
        on = frozenset({LATEX})
        mark = self.latex_mark if self.chance(0.3) else None
        kind = self.r.random()
        if kind < 0.3:
            command = self.one(["section", "subsection", "subsubsection", "paragraph", "chapter", "title", "subsection*", "section*"])
            return [(f"\\{command}{{{self.title()}}}{self.one(['', '', f'{chr(92)}label{{s:{self.number()}}}'])}", on | {HEADING})]
        if kind < 0.44:
            env = self.one(["itemize", "enumerate", "description"])
            pad = self.one(["  ", "  ", "", "    "])
            items = [(f"{pad}\\item{self.one(['', '', '', f'[{w()}]'])} {self.prose(mark, 2)[0]}", on | {LIST}) for _ in range(int(self.r.integers(1, 5)))]
            return [(f"\\begin{{{env}}}", on), *items, (f"\\end{{{env}}}", on)]
        if kind < 0.6:
            shape = on | {FORMULA}
            form = self.r.random()
            if form < 0.35:
                env = self.one(["equation", "align", "equation*", "displaymath", "gather", "multline", "eqnarray"])
                return [(f"\\begin{{{env}}}", shape), *[(self.formula() + self.one(["", " \\\\"]), shape) for _ in range(int(self.r.integers(1, 4)))], (f"\\end{{{env}}}", shape)]
            if form < 0.5:
                return [("\\[", shape), (self.formula(), shape), ("\\]", shape)]
            if form < 0.58:
                return [("$$", shape), (self.formula(), shape), ("$$", shape)]
            return [(self.one(["\\[ {} \\]", "\\( {} \\)", "$${}$$", "${}$", "$$ {} $$"]).format(self.formula()), shape)]
        if kind < 0.7:
            shape = on | {TABLE}
            rows = [(f"{self.one([w(), self.title()])} & {self.number()} \\\\", shape) for _ in range(int(self.r.integers(1, 4)))]
            lines = [("\\hline", on)] if self.chance(0.3) else []
            return [("\\begin{tabular}" + self.one(["{lr}", "{ll}", "{l|r}"]), on), *lines, *rows, *lines, ("\\end{tabular}", on)]
        if kind < 0.8:
            env = self.one(["verbatim", "verbatim", "lstlisting"])
            body = [(self.filled(self.one(PROGRAM)), on | {CODE}) for _ in range(int(self.r.integers(1, 5)))]
            return [(f"\\begin{{{env}}}", on | {CODE}), *body, (f"\\end{{{env}}}", on | {CODE})]
        if kind < 0.88:
            return [(self.one([f"\\usepackage{{{w()}}}", "\\documentclass{article}", "\\begin{document}", "\\end{document}", f"\\includegraphics[width=0.{self.number()}]{{{w()}}}", f"\\caption{{{self.title()}}}", "\\centering", "\\maketitle", f"\\label{{{w()}}}", "\\newpage", "\\begin{figure}", "\\end{figure}", f"\\author{{{w()}}}", "\\tableofcontents", f"\\bibitem{{{w()}}}"]), on)]
        if kind < 0.91:
            return [("\\begin{quote}", on), (self.prose()[0], frozenset()), ("\\end{quote}", on)]
        return [(self.prose(self.latex_mark)[0], on)]

    # ---- documents

    def plain_block(self) -> list[Line]:
        kind = self.r.random()
        nothing: frozenset[str] = frozenset()
        if kind < 0.76:
            return [(self.prose(None, self.one([5, 5, 5, 15]))[0], nothing)]
        if kind < 0.86:
            return [(self.title(), nothing)]
        if kind < 0.91:
            return [(self.one([" ", " ", ",", ";", "/", ", ", "; ", "|", ":", "&", "+"]).join(self.filled(self.one(["w=n", "w-n=n", "w_w=n", "w-n", "w_w", "w", "w", "nw", "w.n"])) for _ in range(int(self.r.integers(1, self.one([6, 40, 150]))))), nothing)]
        if kind < 0.94:
            return [("\t".join([self.name(), self.number()]), nothing) for _ in range(int(self.r.integers(1, 4)))]
        if kind < 0.97:
            pattern = [self.one([self.name, self.number, self.number, lambda: self.one(["h", "ok", "%", "ms", "x", "v"]), lambda: self.one(" :-./ ,;=_ \t")]) for _ in range(int(self.r.integers(3, 12)))]
            lines = ["".join(part() + self.one(["", "", " "]) for part in pattern).strip(" -=:/_.,;\t") for _ in range(int(self.r.integers(1, 4)))]
            return [(text, nothing) for text in lines if text]
        lead = self.filled(self.one(INNOCENT))
        return [(f"{lead} {self.sentence()}", nothing)] if lead[0] not in "*>-+|=#~_`" and self.chance(0.5) else [(f"• {self.sentence()}", nothing)]

    def document(self, kinds: Sequence[str], share: float | None = None) -> tuple[list[str], list[frozenset[str]]]:
        """Lines and labels of a document that is written in ``kinds`` (none of them for plain text)."""
        write = {HTML: self.html_block, MARKDOWN: self.markdown_block, WIKI: self.wiki_block, LATEX: self.latex_block}
        marks = {HTML: self.html_mark, MARKDOWN: self.markdown_mark, WIKI: self.wiki_mark, LATEX: self.latex_mark}
        share = self.one([0.1, 0.3, 0.6, 0.9]) if share is None else share
        lines: list[Line] = []
        blank = self.chance(0.85)
        for _ in range(int(self.r.integers(1, 9))):
            if kinds and self.chance(share):
                kind = self.one(kinds)
                if self.chance(0.3):
                    lines.append((self.prose(marks[kind])[0], frozenset({kind})))
                else:
                    lines += write[kind]()
            else:
                lines += self.plain_block()
            if blank:
                lines.append(("", frozenset()))
        if self.chance(0.06):
            ends = self.one(["\r", " ", "  ", "\t"])
            lines = [(text + ends, own) for text, own in lines]
        if self.chance(0.03):
            lines[0] = (self.one(["﻿", "​"]) + lines[0][0], lines[0][1])
        if self.chance(0.06):
            lines = [(text[: len(text) // 2] + self.one(["­", "​", " ", "…", "㎏", "😀", "→"]) + text[len(text) // 2 :] if len(text) > 40 and not own else text, own) for text, own in lines]
        while lines and not lines[-1][0].strip() and self.chance(0.9):
            lines.pop()
        return [text for text, _ in lines], [own for _, own in lines]

    def long_line(self, kind: str | None, words: int) -> tuple[list[str], list[frozenset[str]]]:
        """One line of about so many words, with at most one mark in it."""
        sentences: list[str] = []
        while sum(max(len(s.split()), len(s) // 8) for s in sentences) < words:
            sentences.append(self.sentence())
            if self.chance(0.1):
                sentences.append(self.filled(self.one(INNOCENT)))
        if kind is None:
            return [" ".join(sentences)], [frozenset()]
        mark = {HTML: self.html_mark, MARKDOWN: self.markdown_mark, WIKI: self.wiki_mark, LATEX: self.latex_mark}[kind]
        j = int(self.r.integers(len(sentences)))
        sentences[j] = mark(sentences[j])
        return [" ".join(sentences)], [frozenset({kind})]

    def corpus(self, n: int) -> list[tuple[list[str], list[frozenset[str]]]]:
        """``n`` documents: a quarter plain, a fifth of two kinds, a tenth one long line, the others of one kind."""
        names = (HTML, MARKDOWN, WIKI, LATEX)
        out = []
        for _ in range(n):
            chance = self.r.random()
            if chance < 0.12:
                out.append(self.long_line(self.one([*names, None, None]), int(self.r.integers(30, 300))))
            elif chance < 0.35:
                out.append(self.document(()))
            else:
                out.append(self.document([self.one(names) for _ in range(2 if chance > 0.8 else 1)]))
        return out


#: Characters beside letters, digits and blanks that a sentence of the pool may hold.
HARMLESS = frozenset(".,;:!?()%/'\"-–—。，、；：！？「」『』（）…’“”«»¿¡")


def plain_sentences(texts: Sequence[str], most: int) -> list[str]:
    """Sentences without any sign that markup could use, from the given texts, each once."""
    found: dict[str, None] = {}
    for text in texts:
        for line in text.split("\n"):
            for piece in line.replace("。", "。\n").replace(". ", ".\n").split("\n"):
                piece = piece.strip()
                if 3 < len(piece) < 400 and piece[0].isalpha() and "''" not in piece and all(c.isalnum() or c.isspace() or c in HARMLESS for c in piece):
                    found[piece] = None
                    if len(found) == most:
                        return list(found)
    return list(found)
