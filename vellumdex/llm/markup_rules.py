"""What the signs of four markup languages look like in a line, and converting lines to clean text."""

from __future__ import annotations

import html
import re
from collections import Counter

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"
KINDS = (HTML, LATEX, MARKDOWN, WIKI)
HEADING, LIST, CODE, FORMULA, TABLE = "heading", "list", "code", "formula", "table"
SHAPES = (HEADING, LIST, CODE, FORMULA, TABLE)
LABELS = KINDS + SHAPES

# Element names of HTML.
ELEMENTS = (
    "a abbr acronym address article aside b base big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em "
    "fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav "
    "ol option p picture pre q s samp script section select small source span strike strong style sub summary sup table tbody td textarea tfoot th thead time title tr tt u ul var video wbr"
).split()

_TAG = rf"</?(?:{'|'.join(sorted(ELEMENTS, key=len, reverse=True))})(?:\s[^<>]*)?\s*/?(?:>|$)"
MD_FENCE = re.compile(r"^\s{0,3}(?:```+|~~~+)[^`\n]*$")
_UNDERLINE = re.compile(r"^\s{0,3}(?:={3,}|-{3,})\s*$")
OPEN_TAG = re.compile(rf"<(?:{'|'.join(ELEMENTS)})(?:\s[^<>]*)?$", re.I)
_OPEN_PRE, _CLOSE_PRE = re.compile(r"<(pre|script|style|textarea)\b", re.I), re.compile(r"</(?:pre|script|style|textarea)\s*>", re.I)
_BEGIN, _CLOSE = re.compile(r"\\begin\{(\w+)\*?\}"), re.compile(r"\\end\{(\w+)\*?\}")
_MATH_ENV = frozenset("equation align displaymath eqnarray gather multline math".split())
_CODE_ENV = frozenset("verbatim lstlisting minted alltt".split())
_CONTAINERS = ("fence", "pre", "comment", "tag", "wikitable", "dollars", *sorted(_MATH_ENV), *sorted(_CODE_ENV))


class _Open:
    """The stack of open elements; how often each name is on it is counted, so that no step looks through all of it."""

    def __init__(self):
        self.names: list[str] = []
        self.count: Counter[str] = Counter()

    def push(self, name: str) -> None:
        self.names.append(name)
        self.count[name] += 1

    def close(self, name: str) -> None:
        """Closes the innermost element of that name with all that stands in it; nothing if there is none."""
        while self.count[name]:
            last = self.names.pop()
            self.count[last] -= 1
            if last == name:
                return

    def top(self) -> str:
        return self.names[-1] if self.names else ""

    def shown(self) -> str:
        """The innermost six names after those of the kinds that change how lines are read, wherever they stand."""
        near = self.names[-6:]
        if len(self.names) > 6:
            near = [n for n in _CONTAINERS if self.count[n] and n not in near] + near
        return ">".join(near)


def tag_paths(lines: list[str]) -> list[str]:
    """Of each line the open structure it stands in, outermost first, as ``table>pre``.

    Elements are kept open to any depth; of a deep path the innermost six are shown, and
    every container of code, formulas or tables that is open.
    """
    out, path = [], _Open()
    for line in lines:
        inside = path.top()
        plain = inside != "tag" and "<" not in line and "`" not in line and "~" not in line and "{|" not in line and "|}" not in line and "\\" not in line and "--" not in line and "$$" not in line
        if plain:
            out.append(path.shown())
            continue
        depth, before = len(path.names), path.shown()
        if inside == "fence":
            if MD_FENCE.match(line):
                path.close("fence")
        elif inside == "pre":
            if _CLOSE_PRE.search(line):
                path.close("pre")
        elif inside == "comment":
            if "-->" in line:
                path.close("comment")
        elif inside == "tag":
            if ">" in line or not line.strip():
                path.close("tag")
        elif inside in _CODE_ENV:
            if any(m.group(1) == inside for m in _CLOSE.finditer(line)):
                path.close(inside)
        elif MD_FENCE.match(line):
            path.push("fence")
        else:
            if line.startswith("{|"):
                path.push("wikitable")
            elif line.startswith("|}"):
                path.close("wikitable")
            for m in _BEGIN.finditer(line):
                path.push(m.group(1))
            for m in _CLOSE.finditer(line):
                path.close(m.group(1))
            if "\\[" in line and "\\]" not in line.split("\\[", 1)[1]:
                path.push("displaymath")
            elif "\\]" in line:
                path.close("displaymath")
            elif line.strip() == "$$":
                path.close("dollars") if path.count["dollars"] else path.push("dollars")
            opened, closed = len(_OPEN_PRE.findall(line)), len(_CLOSE_PRE.findall(line))
            if opened > closed:
                path.push("pre")
            if line.count("<!--") > line.count("-->"):
                path.push("comment")
            elif "<" in line and OPEN_TAG.search(line):
                path.push("tag")
        out.append(before if depth >= len(path.names) else path.shown())
    return out


def kinds_of(signs: list[set[str]]) -> set[str]:
    return {k for x in signs for k in x if k in KINDS}


_STRIP = [
    (re.compile(r"<!--.*?-->"), ""),
    (re.compile(r"<br\s*/?>", re.I), "\n"),
    (re.compile(_TAG, re.I), ""),
]
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]")
_MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\](?:\([^()\n]*\)|\[[^\[\]\n]*\])")
_LATEX_NOTE = re.compile(r"\\footnote\*?\{([^{}]*)\}")
_LATEX_ARG = re.compile(r"\\(?:text\w\w|emph|underline|(?:sub)*section|(?:sub)*paragraph|chapter|title)\*?\{([^{}]*)\}")
_LATEX_DROP = re.compile(r"~?\\(?:label|ref|cite\w*|begin|end|includegraphics|index|vspace|hspace)\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})+")
_INLINE_MATH = re.compile(r"(?:(?<![\\$\w])\$\$?(?=[^\s$])|\\\(\s*)([^$\n]*?[^\s\\$])(?:\$\$?(?![\d$])|\s*\\\))")
_MATH_MARKS = re.compile(r"\$\$|(?<!\w)\$|\$(?!\d)|\\\[|\\\]|\\\(|\\\)")


def clean_line(line: str, labels: set[str]) -> str:
    """The line without the marks of the kinds in ``labels``; code and formulas keep their content."""
    text = line
    if HTML in labels:
        for rule, by in _STRIP:
            text = rule.sub(by, text)
        text = html.unescape(text)
    if CODE in labels and labels & {MARKDOWN, LATEX, HTML}:
        return "" if MD_FENCE.match(text) or _BEGIN.match(text.strip()) or _CLOSE.match(text.strip()) else text
    if LATEX in labels:
        text = _LATEX_DROP.sub("", _LATEX_ARG.sub(r"\1", _LATEX_NOTE.sub(r" (\1)", text)))
        text = re.sub(r"\\text(?:greater|less|backslash|tilde)\{\}", lambda m: {"g": ">", "l": "<", "b": "\\", "t": "~"}[m.group()[5]], text)
        if FORMULA in labels:
            text = _MATH_MARKS.sub("", text).strip()
        else:
            text = re.sub(r"\\item\b\s*", "• ", _INLINE_MATH.sub(r"\1", text))
            text = re.sub(r"\s*\\\\\s*$", "", text) if TABLE in labels else text
            text = re.sub(r"\\([%&_#$])", r"\1", text)
    if WIKI in labels:
        text = _WIKI_LINK.sub(r"\1", re.sub(r"\{\{[^{}\n]*\}\}|__[A-Z]{3,}__", "", text))
        text = re.sub(r"'{2,5}", "", text)
        text = re.sub(r"^={2,6}\s*(.*?)\s*={2,6}\s*$", r"\1", text)
        if TABLE in labels:
            text = "" if re.match(r"\{\||\|\}|\|-", text) else re.sub(r"\s*(?:!!|\|\|)\s*", "\t", re.sub(r"^[!|]\s*", "", text))
    if MARKDOWN in labels:
        text = re.sub(r"(`+)([^`\n]+)\1", r"\2", text)
        text = _MD_LINK.sub(r"\1", text)
        text = re.sub(r"\[\^[^\[\]\n]+\]", "", text)
        text = re.sub(r"(?<!\\)(\*{1,3}|~~)(?=\S)([^*~\n]+?)(?<=[^\s\\])\1", r"\2", text)
        text = re.sub(r"(?<![A-Za-z0-9_\\])(_{1,3})(?=[^\s_])([^_\n]*?)(?<=[^\s_])\1(?![A-Za-z0-9_])", r"\2", text)
        if HEADING in labels:
            text = "" if _UNDERLINE.match(text) else re.sub(r"^\s{0,3}#{1,6}\s+|\s+#+\s*$", "", text)
        elif TABLE in labels:
            text = "" if re.match(r"^[\s|:\-]+$", text) else re.sub(r"\s*\|\s*", "\t", text.strip().strip("|").strip())
        elif re.match(r"^\s{0,3}(?:(?:-[ \t]*){3,}|(?:_[ \t]*){3,}|(?:\*[ \t]*){3,})$", text):
            text = ""
        elif LIST in labels:
            text = re.sub(r"^(\s*)(?:[-*+])[ \t]+", r"\1• ", text)
        else:
            text = re.sub(r"^\s*(?:>\s?)+", "", text)
        text = re.sub(r"\\([*_#`~>+!\[\]{}()|-])", r"\1", text)
    elif LIST in labels and HTML in labels:
        text = "• " + text.strip() if text.strip() else ""
    return text
