"""Place strings: parts, level and label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearsay.functions.text import strip

_NOT_A_PLACE = ["", "None", "nan"]


def place_parts(c: Column) -> Column:
    """Comma-separated parts of a place string, each stripped."""
    return F.transform(F.split(strip(c), ",", -1), strip)


def parse_location(location: Column, parts: Column) -> dict[str, Column]:
    """City, state and country of 'city, state, country' or 'city, country'.

    Any other number of parts is kept whole as the country; empty parts are
    null. ``parts`` is a column holding :func:`place_parts`, so that the string
    is split once.
    """
    n = F.size(parts)
    known = lambda c: F.nullif(c, F.lit(""))
    part = lambda i: known(F.get(parts, F.lit(i)))
    return {
        "city": F.when(n.isin(2, 3), part(0)),
        "state": F.when(n == 3, part(1)),
        "country": F.when(n == 3, part(2)).when(n == 2, part(1)).otherwise(known(strip(location))),
    }


def finest_place(city: Column, state: Column, country: Column) -> Column:
    """The finest known place as an array of at most one (level, name, state, country)."""

    def at(level: str, name: Column, state_: Column) -> Column:
        return F.struct(
            F.lit(level).alias("level"), name.alias("name"), state_.alias("state"), country.alias("country")
        )

    levels = F.array(
        at("city", city, state), at("state", state, state), at("country", country, F.lit(None).cast("string"))
    )
    return F.slice(F.filter(levels, lambda p: p["name"].isNotNull() & ~p["name"].isin(_NOT_A_PLACE)), 1, 1)


def place_label(level: Column, name: Column, state: Column, country: Column, count: Column) -> Column:
    """'name[, state][, country] (n posts)'; a level names only the parts above it."""
    return F.concat(
        F.concat_ws(
            ", ",
            name,
            F.when(level == "city", state),
            F.when(level.isin("city", "state"), country),
        ),
        F.lit(" ("),
        count.cast("string"),
        F.lit(" posts)"),
    )
