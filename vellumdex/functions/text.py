"""Text primitives: normalization, tokens, hashes.

Everything that Spark's own expressions can say stays an expression. The exception is
Unicode compatibility normalization (NFKC), for which Spark has no built-in; it runs as an
Arrow UDF.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The character classes of the search tokenizer.
WORD_CLASS = r"[a-z0-9_+\-.]+"
CJK_CLASS = "[一-鿿]"
ATOM_CLASS = CJK_CLASS + "|" + WORD_CLASS

WORD_RE = re.compile(WORD_CLASS)
CJK_RUN_RE = re.compile(CJK_CLASS + "+")
ATOM_RE = re.compile(ATOM_CLASS)


def fold(text: str) -> str:
    """NFKC and lower case of one string."""
    return unicodedata.normalize("NFKC", text).lower()


@F.arrow_udf(T.StringType())
def nfkc_lower(texts: pa.Array) -> pa.Array:
    """NFKC and lower case of a column; null stays null."""
    return pa.array([None if t is None else fold(t) for t in texts.to_pylist()], pa.string())


def normalized(col: Column | str, ascii_only: bool = False) -> Column:
    """The normalized text; ``ascii_only`` states that ``lower`` is enough."""
    col = F.col(col) if isinstance(col, str) else col
    return F.lower(col) if ascii_only else nfkc_lower(col)


def words_of(norm: Column) -> Column:
    """Word tokens of a normalized text, in order."""
    return F.regexp_extract_all(norm, F.lit(WORD_CLASS), F.lit(0))


def cjk_bigrams_of(norm: Column) -> Column:
    """Overlapping pairs of each run of Chinese characters; a run of one stays as it is."""
    runs = F.regexp_extract_all(norm, F.lit(CJK_CLASS + "+"), F.lit(0))
    pairs = lambda run: F.when(F.length(run) < 2, F.array(run)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: run.substr(i, F.lit(2)))
    )
    return F.flatten(F.transform(runs, pairs))


def search_tokens(norm: Column) -> Column:
    """Tokens as the full-text index counts them: words, then pairs of Chinese characters."""
    return F.concat(words_of(norm), cjk_bigrams_of(norm))


def atoms_of(norm: Column) -> Column:
    """Atoms (single Chinese characters and words) of a normalized text, in order."""
    return F.regexp_extract_all(norm, F.lit(ATOM_CLASS), F.lit(0))


def atom_count(norm: Column) -> Column:
    """Number of atoms, the length measure of the index."""
    return F.regexp_count(norm, F.lit(ATOM_CLASS)).cast("int")


def sha256_hex(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def clean_hash(col: Column | str) -> Column:
    """A hash without outer blanks and in lower case; spellings of one hash become equal."""
    col = F.col(col) if isinstance(col, str) else col
    return F.lower(F.regexp_replace(col, r"^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$", ""))


def blank_to_null(col: Column) -> Column:
    return F.when(F.trim(col) != "", col)


def joined_nonblank(sep: str, *cols: Column) -> Column:
    """The trimmed parts that are not blank, joined by ``sep``."""
    return F.concat_ws(sep, *[F.when(F.trim(c) != "", F.trim(c)) for c in cols])


def query_text(text: str | None) -> str:
    """A query normalized: NFKC, lower case, dashes folded, white space collapsed."""
    folded = re.sub("[‐-―]", "-", fold(text or ""))
    return " ".join(folded.split())


def query_text_col(col: Column) -> Column:
    """``query_text`` over a column."""
    dashes = F.regexp_replace(nfkc_lower(col), "[‐-―]", "-")
    return F.trim(F.regexp_replace(dashes, r"(?U)\s+", " "))


def query_tokens(text: str | None) -> list[str]:
    """Distinct search tokens of one query, in order of first appearance."""
    norm = query_text(text)
    found = WORD_RE.findall(norm)
    for run in CJK_RUN_RE.findall(norm):
        found += [run[i : i + 2] for i in range(max(1, len(run) - 1))]
    return list(dict.fromkeys(found))


def snippet(col: Column, width: int = 180) -> Column:
    """White space collapsed, cut to ``width`` with an ellipsis."""
    flat = F.trim(F.regexp_replace(col, r"\s+", " "))
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.substring(flat, 1, width - 3), F.lit("...")))
