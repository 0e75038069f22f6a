"""Text column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is stripped from text: ASCII blanks and separators, then the Unicode ones.
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0            "
          "    　")


def strip(value) -> Column:
    """``value`` without white space at either end (all of ``BLANKS``, not only spaces); linear in its length."""
    return F.trim(F.col(value) if isinstance(value, str) else value, F.lit(BLANKS))
