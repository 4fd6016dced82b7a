"""Place counts, coordinates and breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearsay.functions.places import finest_place, place_label
from hearsay.operators.rankings import top

PLACE_KEYS = ("level", "name", "state", "country")


def located(posts: DataFrame) -> DataFrame:
    """Add the finest known place as (level, name, state, country); drop posts without any."""
    place = finest_place(F.col("city"), F.col("state"), F.col("country"))
    return posts.select(F.explode(place).alias("place")).select("place.*")


def place_counts(posts: DataFrame, parity: bool = False) -> DataFrame:
    """Posts per place; with ``parity`` only places that have all four keys."""
    places = located(posts)
    if parity:
        places = places.dropna(subset=list(PLACE_KEYS))
    return places.groupBy(*PLACE_KEYS).agg(F.count("*").alias("count"))


def standardise_country(df: DataFrame, aliases: DataFrame, column: str, output: str) -> DataFrame:
    """Replace a country name by its standard form; unknown names stay.

    Meant for counted places (one row per name), so no name is hot here; Spark
    broadcasts the alias table when its size allows and sorts both otherwise.
    """
    known = aliases.groupBy(F.col("alias").alias("_alias")).agg(F.max("name_short").alias("_standard"))
    return (
        df.join(known, F.col(column) == F.col("_alias"), "left")
        .withColumn(output, F.coalesce("_standard", column))
        .drop("_alias", "_standard")
    )


def heat_points(
    counts: DataFrame, gazetteer: DataFrame, country_aliases: DataFrame | None = None
) -> DataFrame:
    """Counted places with coordinates and a label; places not in the gazetteer drop out.

    Counting comes first, so the join sees each place once whatever the number
    of posts; the gazetteer is broadcast only if Spark finds it small enough.
    """
    places = counts.withColumn("_lookup", F.col("name"))
    if country_aliases is not None:
        places = standardise_country(places, country_aliases, "name", "_standard_name").withColumn(
            "_lookup", F.when(F.col("level") == "country", F.col("_standard_name")).otherwise(F.col("name"))
        )
    known = gazetteer.groupBy("level", F.col("name").alias("_lookup")).agg(
        F.max(F.struct("lat", "lon")).alias("_at")
    )
    return places.join(known, ["level", "_lookup"]).select(
        *PLACE_KEYS,
        F.col("_at.lat").alias("lat"),
        F.col("_at.lon").alias("lon"),
        F.col("count").alias("weight"),
        place_label(
            F.col("level"), F.col("name"), F.col("state"), F.col("country"), F.col("count")
        ).alias("label"),
    )


def map_centre(points: DataFrame) -> DataFrame:
    """Unweighted mean coordinates of the points; (20, 0) without points."""
    return points.agg(
        F.coalesce(F.avg("lat"), F.lit(20.0)).alias("lat"),
        F.coalesce(F.avg("lon"), F.lit(0.0)).alias("lon"),
    )


def level_counts(posts: DataFrame) -> DataFrame:
    """Posts per city, state and country name, as (level, name, count).

    The three parts are counted together before they are unpivoted, so the
    threefold rows are those of the distinct places, not of the posts.
    """
    parts = posts.groupBy("city", "state", "country").agg(F.count("*").alias("n"))
    levels = F.explode(
        F.array(
            *[
                F.struct(F.lit(level).alias("level"), F.col(level).alias("name"))
                for level in ("city", "state", "country")
            ]
        )
    )
    return (
        parts.select(levels.alias("p"), "n")
        .select("p.level", "p.name", "n")
        .filter(F.col("name").isNotNull() & (F.col("name") != ""))
        .groupBy("level", "name")
        .agg(F.sum("n").alias("count"))
    )


def place_breakdown(posts: DataFrame, k: int = 10) -> DataFrame:
    """Top-k names of each level.

    Spark limits each task to k rows per level before the shuffle (window group
    limit), so a level with very many names does not land in one task.
    """
    order = Window.partitionBy("level").orderBy(F.desc("count"), "name")
    return (
        level_counts(posts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    )


def top_place(posts: DataFrame) -> DataFrame:
    """Most frequent name of each level."""
    return place_breakdown(posts, 1).drop("rank")


def country_counts(posts: DataFrame) -> DataFrame:
    """Posts of every country."""
    return (
        posts.filter(F.col("country").isNotNull() & (F.col("country") != ""))
        .groupBy("country")
        .agg(F.count("*").alias("count"))
    )


def by_country(posts: DataFrame, column: str) -> DataFrame:
    """Counts per country and ``column`` with subtotals and the grand total.

    Subtotal rows have nulls in the rolled-up columns and ``depth`` 2 (leaf),
    1 (country) or 0 (all). Pairs are counted first: the rollup expands pairs.
    """
    pairs = posts.filter(F.col("country").isNotNull()).groupBy("country", column).agg(
        F.count("*").alias("n")
    )
    return pairs.rollup("country", column).agg(
        F.sum("n").alias("count"),
        (F.lit(2) - F.grouping("country") - F.grouping(column)).cast("int").alias("depth"),
    )


def platform_by_country(posts: DataFrame) -> DataFrame:
    return by_country(posts, "platform")


def sentiment_by_country(posts: DataFrame) -> DataFrame:
    return by_country(posts, "sentiment")


def top_countries(posts: DataFrame, k: int = 10) -> DataFrame:
    return top(country_counts(posts), "count", "country", k=k)
