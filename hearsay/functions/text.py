"""Text cleaning, hashtags and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark's trim knows only the space, and Java's \s and \w are ASCII; these sets
# cover Unicode white space and Unicode letters/digits in every position.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        "
    "        　"
)
SPACE = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WORD = r"\p{L}\p{N}_"
_LETTER = r"\p{L}\p{Nl}\p{No}"

# --- Fixed values: patterns ---------------------------------------------------
MENTION = "@[A-Za-z0-9_]+"
RETWEET = f"RT[{SPACE}]+"
URL = f"https?://[^{SPACE}]+"
HASHTAG = f"#([{_WORD}]+)"
WORD = f"[{_WORD}][{_WORD}']+"
TOKEN = f"[{_WORD}][{_WORD}']*"


def strip(c: Column) -> Column:
    """Drop Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean_text(c: Column) -> Column:
    """Drop mentions, hash signs, retweet marks and URLs, in that order; null gives ''."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), MENTION, "")
    out = F.replace(out, F.lit("#"), F.lit(""))
    out = F.regexp_replace(out, RETWEET, "")
    return strip(F.regexp_replace(out, URL, ""))


def extract_hashtags(c: Column) -> Column:
    """All tags in ``c`` without the '#', in order, repeats kept; null gives []."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(HASHTAG), 1)


def hashtag_bag(hashtags: Column, text: Column, strip_hash: bool = False) -> Column:
    """Tags listed in the hashtag column followed by the tags found in the text.

    The column may hold a list literal or free text; a literal that does not
    parse is scanned like free text. It is only ever parsed, never evaluated.
    """
    scanned = extract_hashtags(hashtags)
    parsed = F.filter(F.from_json(hashtags, "array<string>"), lambda t: t.isNotNull())
    listed = F.when(hashtags.startswith("["), F.coalesce(parsed, scanned)).otherwise(scanned)
    if strip_hash:
        listed = F.transform(listed, lambda t: F.regexp_replace(t, "^#", ""))
    return F.concat(listed, extract_hashtags(text))


def words(c: Column) -> Column:
    """Lower-case tokens of two or more word characters (inner apostrophes kept)."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), 0)


def letter_tokens(c: Column, shortest: int = 2, longest: int = 15) -> Column:
    """Lower-case digit-free tokens of the topic model, limited by length.

    The length limits are part of the pattern, as a filter over the tokens would
    run interpreted for each of them.
    """
    whole = f"(?<![{_LETTER}_])[{_LETTER}][{_LETTER}_]{{{shortest - 1},{longest - 1}}}+(?![{_LETTER}_])"
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(whole), 0)


def entity_tokens(c: Column) -> Column:
    """Lower-case tokens as of :func:`words`, but also those of one character."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), 0)


def slices(tokens: Column, starts: Column) -> Column:
    """The token sequences that begin at ``starts``, an array of (p, lengths), joined by a space.

    Those that the text is too short for are left out.
    """

    def from_start(s: Column) -> Column:
        fitting = F.filter(s["lengths"], lambda n: s["p"] + n <= F.size(tokens))
        return F.transform(fitting, lambda n: F.array_join(F.slice(tokens, s["p"] + 1, n), " "))

    return F.flatten(F.transform(starts, from_start))
