"""Six-way sentiment class."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearsay.functions.binding import let
from hearsay.functions.text import words
from hearsay.schema import DISASTER_WORDS, HAPPY_WORDS, SAD_WORDS

#: Polarities are summed as whole billionths, so that a sum does not depend on
#: the order in which Spark adds it up.
SCALE = 1_000_000_000


def contains_any(lowered: Column, terms: Iterable[str], match: str = "substring") -> Column:
    """Whether lower-case text holds any of the terms, as substring or as whole word.

    Substring tests are a chain of ``contains``: twice as fast as one plain
    alternation regex, because they compare bytes and build no Java string.
    """
    if match == "substring":
        return reduce(or_, [lowered.contains(t) for t in terms])
    if match == "word":
        return lowered.rlike(r"\b(?:" + "|".join(re.escape(t) for t in terms) + r")\b")
    raise ValueError(f"unknown match mode: {match}")


def any_term_pattern(terms: Iterable[str], letters: int = 7) -> str:
    """Regular expression for any of the (lower-case letter) terms, quick to fail.

    Terms are grouped by ``letters`` first letters; before a group is tried, the
    next characters must be possible for it. Measured on long texts without any
    term: 1.8 s, against 5.2 s for the ``contains`` chain.
    """
    terms = sorted(terms)
    firsts = sorted({t[0] for t in terms})
    groups = [[t for t in terms if t[0] in firsts[i : i + letters]] for i in range(0, len(firsts), letters)]

    def guarded(group: list[str]) -> str:
        depth = min(3, min(map(len, group)))
        ahead = "".join("[" + "".join(sorted({t[k] for t in group})) + "]" for k in range(depth))
        return f"(?={ahead})(?:{'|'.join(group)})"

    return "|".join(guarded(g) for g in groups)


def keyword_class(lowered: Column, match: str = "substring") -> Column:
    """Disaster, Happy or Sad, tested in this order; null if no keyword occurs.

    In substring mode one pattern over all keywords first sorts out the texts
    without any; only the others are asked for each class.
    """
    chain, tested = F, []
    for name, terms in (("Disaster", DISASTER_WORDS), ("Happy", HAPPY_WORDS), ("Sad", SAD_WORDS)):
        if match == "substring":
            # a term that holds another one of this or an earlier class never decides
            tested += terms
            terms = [t for t in terms if not any(o in t and o != t for o in tested)]
        chain = chain.when(contains_any(lowered, terms, match), name)
    if match != "substring":
        return chain
    needed = [t for t in tested if not any(o in t and o != t for o in tested)]
    return F.when(lowered.rlike(any_term_pattern(needed)), chain)


def polarity_class(polarity: Column) -> Column:
    """Positive above 0.1, Negative below -0.1, else (also for null) Neutral."""
    return F.when(polarity > 0.1, "Positive").when(polarity < -0.1, "Negative").otherwise("Neutral")


def to_units(polarity: float) -> int:
    return int(round(polarity * SCALE))


def mean_polarity(total_units: Column, hits: Column) -> Column:
    """Mean of the matched polarities; null when nothing matched."""
    return F.try_divide(total_units.cast("double"), hits.cast("double")) / F.lit(float(SCALE))


def lexicon_polarity(tokens: Column, lexicon: Mapping[str, float]) -> Column:
    """Mean polarity of the tokens that a small lexicon knows, without any shuffle.

    One hashed set test per token keeps the few hits; only those walk the
    branches, one per distinct polarity value.
    """
    by_value: dict[int, list[str]] = {}
    for word, polarity in lexicon.items():
        by_value.setdefault(to_units(polarity), []).append(word)
    if not by_value:
        return F.lit(None).cast("double")

    def units(t: Column) -> Column:
        chain = F
        for value, group in by_value.items():
            chain = chain.when(t.isin(group), F.lit(value).cast("bigint"))
        return chain

    def mean(hits: Column) -> Column:
        total = F.aggregate(hits, F.lit(0).cast("bigint"), lambda acc, t: acc + units(t))
        return mean_polarity(total, F.size(hits))

    return let(F.filter(tokens, lambda t: t.isin(list(lexicon))), mean)


def sentiment_class(text: Column, lexicon: Mapping[str, float], match: str = "substring") -> Column:
    """Class of a cleaned text by keywords, else by a small lexicon.

    Texts that a keyword decides are never tokenised.
    """
    return let(
        F.lower(F.coalesce(text, F.lit(""))),
        lambda t: F.coalesce(
            keyword_class(t, match), polarity_class(lexicon_polarity(words(t), lexicon))
        ),
    )
