"""From a CSV export or a landed feed to stored posts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from hearsay.operators.ingest import alias_columns, enrich, filter_topic, normalise, require_text
from hearsay.sources.csv import read_posts_csv
from hearsay.sources.store import PostStore


def prepare(
    raw: DataFrame,
    ingest_ts: dt.datetime | str | None = None,
    topic: str | None = None,
    lexicon: DataFrame | None = None,
    row_key: str | None = None,
    literal: bool = False,
    on_collision: str = "error",
    spread: bool = False,
    enriched: bool = True,
) -> DataFrame:
    """Raw rows under any accepted header to enriched posts of a topic.

    Works on batches and streams alike. Headers are renamed before the topic
    filter, so that the filter finds the text under every name. ``spread`` (for
    batches) rebalances the posts of the topic before they are enriched, where
    the source has too few partitions. ``enriched=False`` stops after the typed
    columns, for a stream whose micro-batches the sink enriches.
    """
    posts = require_text(alias_columns(raw, on_collision))
    if topic is not None:
        posts = filter_topic(posts, topic, literal)
    if spread:
        posts = posts.hint("rebalance")
    posts = normalise(posts, ingest_ts, row_key)
    return enrich(posts, lexicon) if enriched else posts


def import_csv(
    store: PostStore,
    path: str | list[str],
    topic: str,
    now: dt.datetime,
    lexicon: DataFrame | None = None,
    multiline: bool | None = None,
    recent: dt.timedelta | None = None,
    spread: bool = True,
    **options,
) -> str | None:
    """Import the posts of a topic from CSV files; None if no post matches.

    A file with line breaks inside cells is parsed by one task; ``spread`` deals
    the topic's posts out anew before the costlier steps.
    """
    raw = read_posts_csv(store.spark, path, multiline)
    posts = prepare(raw, now, topic, lexicon, spread=spread, **options)
    return store.write_import(posts, topic, now, recent=recent)
