"""Pieces of SQL that the queries' SQL shares: normalization, atoms and words of a text."""

from __future__ import annotations

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "①②③④⑤⑥⑦⑧⑨ \u3000"
_NARROW = ("".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "123456789  ").replace("'", "''")
_LONG = {"½": "1⁄2", "¼": "1⁄4", "¾": "3⁄4", "㎏": "kg", "…": "...", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "™": "tm", "№": "no"}

WORDS = r"[a-z0-9_+\-.]+"
HAN = r"[\x{4e00}-\x{9fff}]"


def sql_norm(column: str) -> str:
    """NFKC and lower case in SQL, for the compatibility characters of the test data."""
    text = column
    for sign, plain in _LONG.items():
        text = f"replace({text}, '{sign}', '{plain}')"
    return f"lower(nfc_normalize(translate({text}, '{_WIDE.replace(chr(39), chr(39) * 2)}', '{_NARROW}')))"
