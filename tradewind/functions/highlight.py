"""Where the words of a search stand in a text, in the text's own places though accents and case do not matter."""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RANGES = "array<struct<start:int,end:int>>"


def folded(char: str) -> str:
    """One character without marks, in lower case; it may become several, or none."""
    return "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)).lower()


def fold_map(text: str, known: dict[str, str]) -> tuple[str, list[int]]:
    """The folded text, and for each of its characters (and its end) the place in `text` that it comes from."""
    parts, origin = [], []
    for i, char in enumerate(text):
        if (f := known.get(char)) is None:
            f = known[char] = folded(char)
        parts.append(f)
        origin += [i] * len(f)
    return "".join(parts), [*origin, len(text)]


def ranges(text: str | None, words: list[str], known: dict[str, str]) -> list[tuple[int, int]]:
    """[start, end) of all places where a word begins as one of `words` does; overlapping and touching ones are one range."""
    if not text or not words:
        return []
    if text.isascii():
        flat, origin = text.lower(), None
    else:
        flat, origin = fold_map(text, known)
    spans = []
    for word in words:
        at = flat.find(word)
        while at >= 0:
            before = flat[at - 1] if at else " "
            if not (before.isascii() and before.isalnum()):
                spans.append((at, at + len(word)) if origin is None else (origin[at], origin[at + len(word)]))
            at = flat.find(word, at + 1)
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def marks(texts: pa.Array, words: list[str], known: dict[str, str]) -> pa.Array:
    """ranges() of each text as Arrow lists. Python holds one text and its places at a time; those of all are kept as plain integers."""
    starts, ends, offsets = array("i"), array("i"), array("i", [0])
    for text in texts:
        for start, end in ranges(text.as_py(), words, known):
            starts.append(start)
            ends.append(end)
        offsets.append(len(starts))
    whole = lambda x: pa.Array.from_buffers(pa.int32(), len(x), [None, pa.py_buffer(x)])
    return pa.ListArray.from_arrays(whole(offsets), pa.StructArray.from_arrays([whole(starts), whole(ends)], ["start", "end"]))


def highlight(text: Column, words: list[str]) -> Column:
    """array<struct<start, end>> of code points; null and empty texts have none. The words are folded as the texts are."""
    wanted = sorted({f for w in words if (f := "".join(map(folded, w)))})

    def mark(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, str] = {}
        for part in texts:
            yield marks(part, wanted, known)

    return F.arrow_udf(mark, RANGES)(text)
