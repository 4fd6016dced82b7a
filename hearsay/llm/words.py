"""Words of letters and digits, as expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, said positively (faster), for texts without A-Z ------
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z, every other character as it is; null as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)  # then lower() does the same, and faster
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words_of(text: Column) -> Column:
    """The words of a text in order, A-Z lower-cased; none for null."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), 0)
