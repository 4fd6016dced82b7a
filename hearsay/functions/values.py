"""Counts, times, platform names and missing values."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearsay.functions.binding import let
from hearsay.functions.text import SPACE, strip
from hearsay.schema import NA_STRINGS, PLATFORMS

_NUMBER = rf"^[{SPACE}]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[{SPACE}]*$"

# Times are read token by token. Each token gets a letter: d (1-2 digits), y (4), h (6), D (8), S (14), f (any other
# number), m (month name), a and p (halves of the day), T, z (zone name), its own sign, x (anything else); weekdays,
# ordinal endings and small words get none. What a text means is read off its letters.
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_WEEKDAYS = "mon tue wed thu fri sat sun".split()
_WEEKDAY = rf"^(?:{'|'.join(_WEEKDAYS)})[a-z]*\.?,?\s+"
_SMALL = "st nd rd th at of".split()
_TOKEN = r"[a-z]+|[0-9]+|[^a-z0-9\s]"
#: In number-only dates the month comes first, unless that can't be a month.
_DATE = r"y[-.]d[-.]d|d[-.]d[-.][yd]|d-?m\.?,?-?[yd]|m\.?-?d,?-?y|m\.?,?-?y|d-y|D|S"
_CLOCK = r"d:d(?::d(?:[.,][dyhDf])?)?[ap]?|d[ap]|h"
_ZONE = r"(?:z|[+-](?:d:d|d|y))"
#: Before, date, between, clock: with the date first, the clock first, or the year last.
_ORDERS = (
    rf"^()({_DATE})(,?T?)({_CLOCK}|){_ZONE}?$",
    rf"^({_CLOCK}){_ZONE}?,?({_DATE})()()$",
    rf"^()(m\.?d)()({_CLOCK}){_ZONE}?(y)$",
)


def null_if_missing(c: Column, missing: Iterable[str] = NA_STRINGS) -> Column:
    """Null for the strings a CSV uses for a missing cell."""
    return F.when(~c.isin(list(missing)), c)


def to_count(c: Column) -> Column:
    """Whole number, truncated toward zero; anything not numeric gives 0."""

    def whole(number: Column) -> Column:
        # A cast that fails costs an exception per row, so each sees only fitting text.
        found = F.when(number == "", F.lit(0).cast("bigint"))
        found = found.when(number.rlike("[.eE]"), number.try_cast("double").try_cast("bigint"))
        return found.otherwise(number.try_cast("bigint"))

    return F.coalesce(let(F.regexp_extract(c, _NUMBER, 1), whole), F.lit(0).cast("bigint"))


def _pieces(text: Column) -> Column:
    """The tokens of a lower-case text that count: (letter, value); a month's value is its number."""

    def piece(token: Column) -> Column:
        n, three = F.length(token), F.left(token, F.lit(3))
        number = F.when(n <= 2, "d").when(n == 4, "y").when(n == 6, "h").when(n == 8, "D").when(n == 14, "S").otherwise("f")
        word = (
            F.when(token.isin("a", "am"), "a").when(token.isin("p", "pm"), "p").when(token == "t", "T")
            .when(token.isin("z", "utc", "gmt"), "z").when(token.isin(_SMALL) | three.isin(_WEEKDAYS), "")
            .when(three.isin(_MONTHS), "m").when(token.isin("-", "/"), "-").when(token.isin(".", ",", ":", "+"), token)
        )
        letter = F.when(token.rlike("^[0-9]"), number).otherwise(F.coalesce(word, F.lit("x")))
        month = F.array_position(F.array(*map(F.lit, _MONTHS)), three).cast("string")
        return F.struct(letter.alias("letter"), F.when(letter == "m", month).otherwise(token).alias("value"))

    plain = F.regexp_replace(F.regexp_replace(text, _WEEKDAY, ""), r"([ap])\.m\.?", "$1m")
    tokens = F.regexp_extract_all(plain, F.lit(_TOKEN), 0)
    return F.filter(F.transform(tokens, piece), lambda p: p["letter"] != "")


def _day(pieces: Column) -> Column:
    """``y-m-d`` of a date's pieces."""
    numbers = F.filter(pieces, lambda p: p["letter"].isin(list("dymDS")))
    told = F.array_join(F.transform(numbers, lambda p: p["letter"]), "")
    n = lambda i: F.get(numbers, F.lit(i))["value"]
    # two digits mean a year from 1969 to 2068
    year = lambda y: F.when(F.length(y) == 4, y).otherwise(F.concat(F.when(y >= "69", "19").otherwise("20"), y))
    joined = lambda y, m, d: F.concat_ws("-", year(y), m, d)
    swapped = n(0).try_cast("int") > 12
    whole = lambda at, size: F.substring(n(0), at, size)
    return (
        F.when(told == "ydd", joined(n(0), n(1), n(2)))
        .when(told.isin("ddy", "ddd"), joined(n(2), F.when(swapped, n(1)).otherwise(n(0)), F.when(swapped, n(0)).otherwise(n(1))))
        .when(told.isin("dmy", "dmd"), joined(n(2), n(1), n(0)))
        .when(told == "mdy", joined(n(2), n(0), n(1)))
        .when(told.isin("my", "dy"), joined(n(1), n(0), F.lit("1")))
        .otherwise(joined(whole(1, 4), whole(5, 2), whole(7, 2)))
    )


def _clock(pieces: Column, code: Column) -> Column:
    """Time of day of a clock's pieces."""
    numbers = F.filter(pieces, lambda p: p["letter"].isin(list("dyhDf")))
    n = lambda i: F.get(numbers, F.lit(i))["value"]
    hour = n(0).try_cast("int")
    half = F.right(code, F.lit(1))
    hour = F.when(half.isin("a", "p"), F.when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))).otherwise(hour)
    told = F.concat(
        hour.cast("string"), F.lit(":"), F.coalesce(n(1), F.lit("00")), F.lit(":"), F.coalesce(n(2), F.lit("00")),
        F.coalesce(F.concat(F.lit("."), F.left(n(3), F.lit(6))), F.lit("")),
    )
    compact = lambda at: F.substring(n(0), at, 2)
    return (
        F.when(code == "", "00:00:00")
        .when(code == "h", F.concat_ws(":", compact(1), compact(3), compact(5)))
        .otherwise(told)
    )


def _by_tokens(pieces: Column) -> Column:
    """Timestamp of some pieces; null if they are none."""

    def read(code: Column) -> Column:
        def ordered(order: str, first_clock: bool, year_last: bool) -> Column:
            group = lambda i: F.regexp_extract(code, order, i)
            before, date, between, clock = (group(i) for i in range(1, 5))
            part = lambda after, size: F.slice(pieces, after + 1, F.length(size))
            at = F.length(code) - F.length(date) if first_clock else F.length(before)
            days = part(at, date)
            if year_last:
                days = F.concat(days, F.slice(pieces, F.length(code), 1))
            if first_clock:
                time = _clock(part(F.lit(0), before), before)
            else:
                time = _clock(part(at + F.length(date) + F.length(between), clock), clock)
            stamp = F.get(F.filter(days, lambda p: p["letter"] == "S"), F.lit(0))["value"]
            compact = F.concat(*(x for i in (9, 11, 13) for x in (F.substring(stamp, i, 2), F.lit(":")))).substr(F.lit(1), F.lit(8))
            return F.concat(_day(days), F.lit(" "), F.coalesce(compact, time))

        found = F
        for order, first_clock, year_last in zip(_ORDERS, (False, True, False), (False, False, True)):
            found = found.when(code.rlike(order), ordered(order, first_clock, year_last))
        return found.try_cast("timestamp_ntz")

    return let(F.array_join(F.transform(pieces, lambda p: p["letter"]), ""), read)


def read_time(c: Column) -> Column:
    """Timestamp without zone, read token by token; null for blank or unreadable values.

    An offset is dropped: the wall-clock time of the post is what counts. A month
    without a day is its first day.
    """
    value = strip(c)
    return F.coalesce(value.try_cast("timestamp_ntz"), let(_pieces(F.lower(value)), _by_tokens))


def to_time(c: Column, ingest_ts: Column) -> Column:
    """:func:`read_time`; blank or unreadable values give ``ingest_ts``."""
    return F.coalesce(read_time(c), ingest_ts.cast("timestamp_ntz"))


def unreadable_time(c: Column) -> Column:
    """Whether a value is there but can't be read as a time."""
    return F.coalesce(strip(c) != "", F.lit(False)) & read_time(c).isNull()


def hour_floor(c: Column) -> Column:
    return F.date_trunc("hour", c).cast("timestamp_ntz")


def canonical_platform(c: Column) -> Column:
    """Known platforms in title case, missing ones 'Unknown', others trimmed."""
    name = strip(c)
    known = {p.lower(): p for p in PLATFORMS} | {"": "Unknown"}
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.when(name.isNull() | name.isin("nan", "None"), "Unknown").otherwise(
        F.coalesce(F.try_element_at(names, F.lower(name)), name)
    )


def log_bin(c: Column) -> Column:
    """Decimal order of magnitude; null for values the log axis cannot show."""
    return F.when(c > 0, F.floor(F.log10(c)).cast("bigint"))
