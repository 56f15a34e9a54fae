"""Scalar text functions, as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGEST_PREFIX = "sha256:"
SHORT_ID, PREVIEW, LONG_PREVIEW = 12, 160, 600


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(c: Column | str) -> Column:
    """Runs of blanks, tabs, vertical tabs and form feeds become one blank; outer white space goes. Line breaks and case stay."""
    return F.regexp_replace(F.regexp_replace(col(c), r"[ \t\f\x0B]+", " "), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def digest(c: Column | str) -> Column:
    """Content address of a text or of bytes."""
    return F.concat(F.lit(DIGEST_PREFIX), F.sha2(col(c), 256))


def chunk_digest(c: Column | str) -> Column:
    """Content address of a text as normalized."""
    return digest(normalize(c))


def digest_prefix(value: str) -> str:
    """A digest or its beginning as typed by a user; ValueError unless it is hexadecimal.

    A leading # and the algorithm's name are dropped, letters become small.
    """
    v = value.strip().removeprefix("#").lower()
    v = v.partition(":")[2] if ":" in v else v
    if not v or any(ch not in "0123456789abcdef" for ch in v):
        raise ValueError(f"not a digest: {value!r}")
    return v


def short_id(c: Column | str) -> Column:
    """The first hexadecimal digits of a digest."""
    return F.substring(F.element_at(F.split(col(c), ":"), -1), 1, SHORT_ID)


def preview(c: Column | str, width: int = PREVIEW) -> Column:
    """On one line, cut to `width` characters, three of them dots."""
    one = F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))
    return F.when(F.char_length(one) > width, F.concat(F.substring(one, 1, width - 3), F.lit("..."))).otherwise(one)


def has_han(c: Column | str) -> Column:
    """Whether there is a Chinese character."""
    return col(c).rlike("[一-鿿]")


def length_bucket(c: Column | str) -> Column:
    """Query length class by code points: 1, 2, 3, 4-9, 10+."""
    n = F.char_length(col(c))
    return F.when(n <= 3, n.cast("string")).when(n <= 9, "4-9").otherwise("10+")


def folded_letters() -> tuple[str, str]:
    """Latin letters with a diacritic, and the plain letters they fold to; by rule, from the Unicode decompositions."""
    marked = [chr(c) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if len(unicodedata.normalize("NFD", chr(c))) > 1]
    marked = [c for c in marked if unicodedata.normalize("NFD", c)[0].isascii() and c == c.lower() and len(c.lower()) == 1]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


def fold(c: Column | str) -> Column:
    """Small letters without Latin diacritics."""
    return F.translate(F.lower(col(c)), *folded_letters())
