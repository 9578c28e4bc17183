"""Byte-level word splitting shared by the operators.

All work on UTF-8 bytes: bytes.lower() touches A-Z only and bytes.split() splits at the six ASCII
white-space characters only, which is what the operators' word definitions ask for.
"""

from __future__ import annotations

import zlib


def encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def lower_words(text: str | None) -> list[bytes]:
    """Runs of characters other than space, tab, LF, VT, FF, CR, with A-Z in lower case."""
    return encoded(text).lower().split()


#: ASCII letters and digits and everything beyond ASCII stay, lower-cased; all else becomes a space.
ALNUM_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and any character beyond ASCII."""
    return encoded(text).translate(ALNUM_TABLE).split()


def fold(doc_id, modulus: int) -> int:
    """crc32 of the id as text, modulo; a null id has the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def crc32_sql(text: str) -> str:
    """DuckDB expression for the unsigned crc32 of the UTF-8 bytes of a text expression; its polynomial is a fixed value."""
    code = f"hex(encode({text}))"
    steps = f"flatten(list_transform(range(0, CAST(length({code}) // 2 AS BIGINT)), lambda i: [CAST('0x' || substr({code}, CAST(2 * i + 1 AS INT), 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN v >= 0 THEN xor(c, v) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295, {steps}), lambda c, v: {step}), 4294967295)"
