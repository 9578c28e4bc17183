"""Small hashes that file names and shuffles need to be the same everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the 32-bit FNV-1a hash.
OFFSET, PRIME, WORD = 2_166_136_261, 16_777_619, 1 << 32


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the characters of an ASCII text, as a long; the offset for an empty one, null for null."""
    letters = F.filter(F.split(c, ""), lambda x: x != "")
    return F.aggregate(letters, F.lit(OFFSET).cast("long"), lambda h, x: h.bitwiseXOR(F.ascii(x).cast("long")) * PRIME % WORD)


def base36(c: Column) -> Column:
    """A non-negative number in lower-case base 36."""
    return F.lower(F.conv(c.cast("string"), 10, 36))
