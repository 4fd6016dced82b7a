"""All panels of a topic report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from hearsay.operators import crisis, distributions, geography, language, rankings
from hearsay.sources.store import PostStore


def panels(
    posts: DataFrame,
    gazetteer: DataFrame | None = None,
    entities: DataFrame | None = None,
    country_aliases: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Panel name to lazy DataFrame; cache ``posts`` before computing several.

    Each panel scans only the columns it uses.
    """
    out = {
        "key_metrics": distributions.key_metrics(posts),
        "crisis": crisis.crisis(posts),
        "disaster_sample": crisis.disaster_sample(posts),
        "sentiment": distributions.sentiment_counts(posts),
        "platforms": distributions.platform_distribution(posts),
        "volume": distributions.hourly_volume(posts),
        "hashtags": rankings.top_hashtags(posts),
        "users": rankings.top_users(posts),
        "influencers": rankings.top_influencers(posts),
        "engagement": rankings.engagement_bins(posts),
        "words": language.word_frequency(posts),
        "top_place": geography.top_place(posts),
        "places": geography.place_breakdown(posts),
        "countries": geography.country_counts(posts),
        "platform_by_country": geography.platform_by_country(posts),
        "sentiment_by_country": geography.sentiment_by_country(posts),
    }
    if entities is not None:
        out["entities"] = rankings.top(
            language.entity_counts(posts, entities), "count", "entity", "type", k=20
        )
    if gazetteer is not None:
        out["heat_points"] = geography.heat_points(
            geography.place_counts(posts), gazetteer, country_aliases
        )
        out["map_centre"] = geography.map_centre(out["heat_points"])
    return out


def topic_report(store: PostStore, topic: str, **lookups: DataFrame) -> dict[str, DataFrame] | None:
    """The panels of a stored topic, None if the topic is unknown.

    Hashtags and sentiment come from the stored counts, as they are small.
    """
    if not store.has_topic(topic):
        return None
    out = panels(store.topic_posts(topic), **lookups)
    out["hashtags"] = store.topic_hashtags(topic)
    out["sentiment"] = store.topic_sentiment(topic)
    return out
