"""Cutting oversized texts into pieces at natural boundaries.

A text is a row of atoms (single Chinese characters and words of the normalized text). The
gap before each atom has a strength: how natural a cut there would be. A sparse table
over the strengths answers, in constant time, where the strongest gap of any range lies.
Each piece ends at the strongest gap of the permissible range, the rightmost of equals;
the next one starts up to ``overlap`` atoms before that end, again at the strongest gap.
Pieces are substrings of the original text; nothing between the first and the last atom of
a text is lost.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumdex.functions.text import ATOM_RE, fold
from vellumdex.llm.batches import bounded

MAX_ATOMS = 800
OVERLAP = 120

# Strength of a gap, by what stands in it. Full-width stops are written by their numbers, since they look like the others.
HEADING, BLANK_LINE, LINE, SENTENCE, CLAUSE, SPACE, NONE = 6, 5, 4, 3, 2, 1, 0

_RULES = [
    (HEADING, re.compile(r"\n[ \t]*(?:#{1,6}[ \t]|={2,6}[^=\n]|<h[1-6]\b|\\(?:sub)*section\b)", re.I)),
    (BLANK_LINE, re.compile(r"\n[ \t\r]*\n| ")),
    (LINE, re.compile(r"[\n\r \x0b\x0c\x85]")),
    (SENTENCE, re.compile(r"[.!?\u2026][\"'\u00bb\u201d\u2019)\]]*\s|[\u3002\uff01\uff1f\uff0e\uff61\u2026]|[.!?][\"'\u00bb\u201d\u2019)\]]+$")),
    (CLAUSE, re.compile(r"[,;:\uff0c\u3001\uff1b\uff1a\uff64\u2014\u2013]|\s-\s")),
    (SPACE, re.compile(r"\s")),
]
_STOPS = frozenset(",;:!?\u3002\uff01\uff1f\uff0e\uff61\uff0c\u3001\uff1b\uff1a\uff64")


class StrongestCut:
    """Range-maximum index: the place of the greatest value in any range, rightmost of equals."""

    def __init__(self, values: np.ndarray):
        self.values = np.asarray(values)
        rows = [np.arange(len(self.values))]
        width = 1
        while 2 * width <= len(self.values):
            left, right = rows[-1][:-width], rows[-1][width:]
            rows.append(np.where(self.values[left] > self.values[right], left, right))
            width *= 2
        self.rows = rows

    def query(self, lo: int, hi: int) -> int:
        """The place in ``lo..hi`` (both included)."""
        level = (hi - lo + 1).bit_length() - 1
        a, b = int(self.rows[level][lo]), int(self.rows[level][hi - (1 << level) + 1])
        return a if self.values[a] > self.values[b] else max(a, b)


def atom_count(text: str) -> int:
    return len(ATOM_RE.findall(fold(text)))


def atom_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each atom in the *original* text.

    Where normalization changes lengths, each character with the marks that follow it is
    normalized by itself, which gives a map back to the original places.
    """
    norm = fold(text)
    if len(norm) == len(text) and unicodedata.is_normalized("NFKC", text):
        return [m.span() for m in ATOM_RE.finditer(norm)]
    parts, owner = [], []
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        while j < n and (unicodedata.combining(text[j]) or "ᅠ" <= text[j] <= "ᇿ" or text[j] in "゙゚゙゚"):
            j += 1
        part = fold(text[i:j])
        parts.append(part)
        owner += [(i, j)] * len(part)
        i = j
    return [(owner[m.start()][0], owner[m.end() - 1][1]) for m in ATOM_RE.finditer("".join(parts))]


def gap_strengths(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """The strength of a cut before each atom; the first and the place after the last count as strongest."""
    strengths = np.zeros(len(spans) + 1, np.int8)
    strengths[0] = strengths[-1] = HEADING
    for k in range(1, len(spans)):
        a, b = spans[k - 1][1], spans[k][0]
        if b > a:
            gap = text[a:b]
            if gap == " ":
                strengths[k] = SPACE
            else:
                # a full stop that ends a word belongs to the atom itself
                probe = text[a - 1 : b] if text[a - 1] in ".-" else gap
                strengths[k] = next((s for s, rule in _RULES if rule.search(probe)), NONE)
                if strengths[k] == NONE and b - a > 1:
                    strengths[k] = SPACE
        elif b < a:
            strengths[k] = -1  # both atoms come from one character: never cut here
    # a sentence can also end in the atom before the gap, as in "figure. The"
    for k in range(1, len(spans)):
        if strengths[k] == SPACE and spans[k - 1][1] > 1 and text[spans[k - 1][1] - 1] == "." and text[spans[k - 1][1] - 2].isalnum():
            strengths[k] = SENTENCE
    return strengths


def piece_bounds(strengths: np.ndarray, most: int = MAX_ATOMS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Ranges of atoms, each of at most ``most``, that together cover all of them."""
    if not 0 <= overlap < most:
        raise ValueError("overlap must be at least 0 and less than the size limit")
    n = len(strengths) - 1
    if n <= most:
        return [(0, n)] if n else []
    index = StrongestCut(strengths)
    least = max(overlap + 1, most // 2)
    bounds, start = [], 0
    while n - start > most:
        end = index.query(start + least, start + most)
        bounds.append((start, end))
        start = index.query(max(end - overlap, start + 1), end - overlap // 2) if overlap else end
    return [*bounds, (start, n)]


def split_text(text: str, most: int = MAX_ATOMS, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Start, end and number of atoms of each piece of ``text``; one piece if it is short enough."""
    if len(text) <= most and fold(text) == text.lower():
        return [(0, len(text), atom_count(text))]
    spans = atom_spans(text)
    if len(spans) <= most:
        return [(0, len(text), len(spans))]
    out = []
    for a, b in piece_bounds(gap_strengths(text, spans), most, overlap):
        begin = 0 if a == 0 else max(spans[a - 1][1], _lead(text, spans[a - 1][1], spans[a][0]))
        stop = len(text) if b == len(spans) else _tail(text, spans[b - 1][1], spans[b][0])
        out.append((begin, stop, b - a))
    return out


def _lead(text: str, a: int, b: int) -> int:
    """Where a piece begins in the gap ``a..b`` before its first atom: after the last white space or stop."""
    for i in range(b - 1, a - 1, -1):
        if text[i] in "\n" or text[i].isspace() or text[i] in _STOPS:
            return i + 1
    return a


def _tail(text: str, a: int, b: int) -> int:
    """Where a piece ends in the gap ``a..b`` after its last atom: closing signs go with it."""
    i = a
    while i < b and not text[i].isspace() and not (text[i] in "([{<«“‘「『"):
        i += 1
    return i


def split_chunks(chunks: DataFrame, most: int = MAX_ATOMS, overlap: int = OVERLAP, key: str = "id", text: str = "text", section: str = "section_path", title: str | None = "title", context: str | None = "context_text") -> DataFrame:
    """One row per piece: ``key, piece, n_pieces, section_path, text, search_text, token_count, start, stop``.

    Sizes are counted in the text itself; any stored count is ignored. A text within the
    limit comes out whole as piece 1 of 1 with its section unchanged; a longer one has
    ``::part<n>`` appended. A missing or blank section is replaced by the title, or
    ``untitled``. A null text gives no piece; an empty or blank one gives one piece of 0
    atoms. ``search_text`` is the context and the piece, and ``token_count`` its atoms. Rows
    are handled one by one, so that repeated rows and keys give repeated pieces.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 1):
            columns = [[] for _ in range(9)]
            rows = zip(*[batch.column(i).to_pylist() for i in range(5)])
            for place, (_, body, path, head, intro) in enumerate(rows):
                if body is None:
                    continue
                path = (path or "").strip() or (head or "").strip() or "untitled"
                intro = (intro or "").strip()
                extra = atom_count(intro) if intro else 0
                pieces = split_text(body, most, overlap)
                for number, (a, b, atoms) in enumerate(pieces, 1):
                    piece = body[a:b]
                    name = path if len(pieces) == 1 else f"{path}::part{number}"
                    search = f"{intro}\n\n{piece.strip()}" if intro else piece.strip()
                    for column, value in zip(columns, (place, number, len(pieces), name, piece, search, extra + atoms, a, b)):
                        column.append(value)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            keys = batch.column(0).take(pa.array(columns[0], pa.int64()))
            yield pa.record_batch([keys, *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]], ["key", "piece", "n_pieces", "section_path", "text", "search_text", "token_count", "start", "stop"])

    blank = F.lit(None).cast("string")
    chosen = chunks.select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(section).alias("section") if section else blank.alias("section"),
        F.col(title).alias("title") if title else blank.alias("title"), F.col(context).alias("context") if context else blank.alias("context"),
    )
    kind = chunks.schema[key].dataType.simpleString()
    out = chosen.mapInArrow(cut, f"key {kind}, piece int, n_pieces int, section_path string, text string, search_text string, token_count int, start int, stop int")
    return out.withColumnRenamed("key", key)
