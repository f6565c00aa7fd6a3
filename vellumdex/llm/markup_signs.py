"""Plain sign rules: what the signs of four markup languages look like in a single line.

A second opinion for measuring the labeller: nothing else uses them, and no label is fitted on them.
"""

from __future__ import annotations

import re

from vellumdex.llm.markup_rules import _CODE_ENV, _MATH_ENV, _TAG, _UNDERLINE, CODE, FORMULA, HEADING, HTML, LATEX, LIST, MARKDOWN, MD_FENCE, OPEN_TAG, TABLE, WIKI, tag_paths

HTML_SIGN = re.compile(rf"<!--|-->|<!DOCTYPE\b|{_TAG}|&(?:#\d{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,9}});", re.I)
LATEX_MATH = re.compile(r"\$\$[^$\n]+\$\$|\$\$\s*$|(?<![\\$\w])\$(?=[^\s$\d])[^$\n]*?(?<=[^\s\\$(])\$(?![\d$])|\\\[(?=[^\n]*[\\^_=])[^\n]*|^[^\n]*\\\]\s*$|\\\((?=[^\n]*[\\^_=])[^\n]*?\\\)")
LATEX_SIGN = re.compile(r"(?<![\w:\\])\\(?:begin|end)\s*\{[^}\n]*\}(?:\{[^}\n]*\}|\[[^\]\n]*\])*|(?<![\w:\\/])\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*|(?<=\w)\\(?:cite|ref|label|footnote|index|emph|text\w\w)\b\*?(?:\{[^{}\n]*\})+|(?<=\d)\\%|[ \w]&[ \w][^\n]*\\\\\s*$")
WIKI_SIGN = re.compile(r"\[\[[^\[\]\n]+\]\]|\{\{[^{}\n]+\}\}|(?<!')'{2,5}(?=[^'\s])[^\n]*?(?<=[^'\s])'{2,5}(?!')|^={2,6}[^=\n]+={2,6}\s*$|^\{\||^\|\}|^\|-(?:[^-|:]|$)|^![^\n]*!!|^\|[^|\n]*\|\||^\s*__[A-Z]{3,}__\s*$|__(?:NO|FORCE)?TOC__|__NO(?:EDITSECTION|GALLERY|INDEX|TITLE)__|__INDEX__|</?(?:nowiki|ref|gallery)\b")
MD_CODE = re.compile(r"(?<!`)(`+)(?!`)[^\n]*?[^`](?:\1)(?!`)")
MD_START = re.compile(
    r"^ {0,3}#{1,6}[ \t]+\S|^\s*>+\s?[^\s>=\d]|^\s*>+\s*\d+[.)]? \w|^\s*[-*+][ \t]+[^\s\d(=]|^\s*[-*+][ \t]+(?:\d|\()[^=\n]*[\w.]$|^\s*\d{1,3}[.)][ \t]+\S|^\s{0,3}\[[^\]\n]+\]:\s*\S"
    r"|^\s*\|[^\n]*\|\s*$|^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$|^\s{0,3}(?:(?:-[ \t]*){3,}|(?:_[ \t]*){3,}|(?:\*[ \t]*){3,})$"
)
MD_INLINE = re.compile(
    r"!?\[[^\[\]\n]*\]\([^()\n]*\)|\[[^\[\]\n]+\]\[[^\[\]\n]*\]|\[\^[^\[\]\n]+\]|~~(?=\S)[^~\n]+(?<=\S)~~"
    r"|(?<![\\*])\*{1,3}(?=[^\s*])[^*\n]*?(?<=[^\s*\\])\*{1,3}(?!\*)|(?<![A-Za-z0-9_\\])_{1,3}(?=[^\s_])[^_\n]*?(?<=[^\s_\\])_{1,3}(?![A-Za-z0-9_])|<(?:https?|mailto):[^\s<>]+>"
)
ESCAPE = re.compile(r"(?<![\w:\\])\\[*_#`~>+!\[\]{}()|-]|(?<=\w)\\[*_#`](?!\w*\\)")
#: No rule can match a text in which this finds nothing.
ANY_SIGN = re.compile(r"[<`\\$|~\[]|''|==|\*|_|\{\{|&\w|&#|^\s*(?:#|>|[-+][ \t]|\d{1,3}[.)][ \t]|-[ \t]*-[ \t]*-)|^=|^![^\n]*!!|-->", re.M)
_LIST_START = re.compile(r"^\s*(?:[-*+]|\d{1,3}[.)]|[*#:;]+)[ \t]+")


def _blank(m: re.Match) -> str:
    return " " * len(m.group())


def line_signs(lines: list[str], paths: list[str] | None = None) -> list[set[str]]:
    """Labels of each line that its own signs speak for; every label is one of ``LABELS``."""
    paths = tag_paths(lines) if paths is None else paths
    found: list[set[str]] = []
    unsure: list[int] = []
    previous = ""
    for i, (line, path) in enumerate(zip(lines, paths)):
        labels: set[str] = set()
        found.append(labels)
        inner = path.rpartition(">")[2]
        if inner == "fence" or MD_FENCE.match(line):
            labels |= {MARKDOWN, CODE}
            previous = ""
            continue
        if inner in _CODE_ENV or inner in _MATH_ENV:
            labels |= {LATEX, CODE if inner in _CODE_ENV else FORMULA}
            previous = ""
            continue
        if inner in ("pre", "comment"):
            labels.add(HTML)
            if inner == "pre":
                labels.add(CODE)
            previous = ""
            continue
        if inner == "tag" and not OPEN_TAG.search(line):
            labels.add(HTML)
            previous = ""
            continue
        if not ANY_SIGN.search(line) and not ("wikitable" in path and line.strip()):
            previous = line
            continue
        rest = line
        if "`" in rest and MD_CODE.search(rest):
            labels.add(MARKDOWN)
            rest = MD_CODE.sub(_blank, rest)
        if ("<" in rest or "&" in rest or "-->" in rest) and HTML_SIGN.search(rest):
            labels.add(HTML)
            low = rest.lower()
            for mark, shape in (("<h", HEADING), ("<li", LIST), ("<td", TABLE), ("<th", TABLE), ("<code", CODE)):
                if mark in low and not (mark == "<h" and not re.search(r"<h[1-6]", low)) and not (mark == "<th" and "<the" in low and "<th>" not in low):
                    labels.add(shape)
            rest = HTML_SIGN.sub(_blank, rest)
        if "$" in rest or "\\" in rest:
            if LATEX_MATH.search(rest):
                labels |= {LATEX, FORMULA}
                rest = LATEX_MATH.sub(_blank, rest)
            if LATEX_SIGN.search(rest):
                labels.add(LATEX)
                if re.search(r"\\(?:sub)*(?:section|paragraph)\b|\\(?:chapter|title)\b", rest):
                    labels.add(HEADING)
                elif "\\item" in rest:
                    labels.add(LIST)
                elif rest.rstrip().endswith("\\\\"):
                    labels.add(TABLE)
                rest = LATEX_SIGN.sub(_blank, rest)
            if ESCAPE.search(rest):
                unsure.append(i)
                rest = ESCAPE.sub(_blank, rest)
        if WIKI_SIGN.search(rest):
            labels.add(WIKI)
            if rest.startswith("="):
                labels.add(HEADING)
            elif rest.startswith(("{|", "|", "!")):
                labels.add(TABLE)
            rest = WIKI_SIGN.sub(_blank, rest)
        elif "wikitable" in path:
            labels |= {WIKI, TABLE}
            rest = ""
        if MD_START.match(rest):
            labels.add(MARKDOWN)
            bare = rest.lstrip()
            if bare.startswith("#"):
                labels.add(HEADING)
            elif bare.startswith("|"):
                labels.add(TABLE)
            elif _LIST_START.match(rest) and re.search(r"\w", rest):
                labels.add(LIST)
        elif _UNDERLINE.match(rest) and previous.strip() and i:
            labels |= {MARKDOWN, HEADING}
            found[i - 1] |= {MARKDOWN, HEADING}
        if MARKDOWN not in labels and MD_INLINE.search(rest):
            labels.add(MARKDOWN)
        previous = line
    latex = any(LATEX in x for x in found)
    for i in unsure:
        found[i].add(LATEX if latex and MARKDOWN not in found[i] else MARKDOWN)
    return found
