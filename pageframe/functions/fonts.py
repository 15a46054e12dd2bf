"""How wide texts are in the standard fonts, as column functions over one array of advance widths a font."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Advance widths in thousandths of the size, of the characters from space to tilde.
REGULAR = """
278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556
1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556
333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584
"""
BOLD = """
278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611
975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556
333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584
"""
OTHER = 556


def widths(font: str = "regular") -> list[int]:
    """Advance widths by code point up to 255: a letter with a mark is as wide as the letter, signs without a width of their own as a digit."""
    told = [int(w) for w in {"regular": REGULAR, "bold": BOLD}[font].split()]
    plain = lambda c: unicodedata.normalize("NFD", chr(c))[0]
    return [told[ord(plain(c)) - 32] if 32 <= ord(plain(c)) < 127 else 0 if c < 32 else OTHER for c in range(256)]


def units(text: Column, font: str = "regular") -> Column:
    """Width of a text in thousandths of its size (long); pairs are not kerned, characters beyond the table are as wide as a digit."""
    table = F.array(*[F.lit(w) for w in widths(font)])
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda n, c: n + F.coalesce(F.get(table, F.ascii(c)), F.lit(OTHER)))


def text_width(text: Column, size: Column | float, font: str = "regular") -> Column:
    return units(text, font) * size / 1000
