"""Idempotent sinks and triggers for streams of posts."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from hearsay.operators.ingest import enrich
from hearsay.sources.files import listing, literal, remove
from hearsay.sources.log import KEEP_SECONDS, Log
from hearsay.sources.store import PostStore

#: Refresh period of a live view, in minutes.
MIN_REFRESH, MAX_REFRESH, DEFAULT_REFRESH = 15, 120, 80


def accepted_refresh(minutes: int) -> bool:
    """Whether a live view may be refreshed so often."""
    return MIN_REFRESH <= minutes <= MAX_REFRESH


def start(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "update",
    refresh_minutes: int | None = DEFAULT_REFRESH,
) -> StreamingQuery:
    """Start a query that hands every micro-batch to ``write(batch, batch_id)``.

    It refreshes every 15 to 120 minutes; ``None`` processes what is there and
    stops. ``write`` must replace, not add, since a batch may be repeated.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    if refresh_minutes is None:
        return writer.trigger(availableNow=True).start()
    if not accepted_refresh(refresh_minutes):
        raise ValueError(f"refresh must be {MIN_REFRESH} to {MAX_REFRESH} minutes")
    return writer.trigger(processingTime=f"{refresh_minutes} minutes").start()


def batches_to(path: str, *keys: str, compact_every: int = 16) -> Callable[[DataFrame, int], None]:
    """Write each micro-batch to a Parquet table, for :func:`all_rows` or, with ``keys``, :func:`latest_rows`.

    Without keys a batch is a partition of its own, which a repeated batch
    overwrites. With ``keys`` (of rows that later batches update) the table has
    versions: a log names the folders that make it up. A batch is written to a
    new folder, then its log entry makes it visible at once. Every so many
    batches the newest row of each key is written to one folder, whose entry
    replaces all before it in the same way: the number of files follows the
    keys and not the batches, a merge that breaks off changes nothing, and a
    reader keeps the version it began with.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if not keys:
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            return
        spark = batch.sparkSession
        if batch_id and batch_id % compact_every == 0:
            _merge(spark, path, batch.schema, keys, batch_id - 1)
        folder = f"rows-{batch_id}-{uuid.uuid4().hex}"
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.parquet(f"{path}/{folder}")
        _commit(spark, path, folder, batch_id, merged=False)

    return write


#: Rows of the log of a versioned table. A merged folder holds all batches up to its own.
_FOLDERS = "folder string, batch_id bigint, merged boolean, at bigint"


def _log(spark: SparkSession, path: str) -> Log:
    return Log(spark, f"{path}/_log", StructType.fromDDL(_FOLDERS), _current)


def _current(rows: DataFrame) -> DataFrame:
    """The folders that make up the table: the last merged one, and the newest of each later batch."""
    whole = Window.partitionBy(F.lit(0))  # as many rows as batches since the last merge, about
    last = F.max(F.when(F.col("merged"), F.struct("batch_id", "at"))).over(whole)
    newest = F.max("at").over(Window.partitionBy("batch_id", "merged"))
    rows = rows.withColumns({"_last": last, "_newest": newest}).filter("at = _newest")
    kept = F.when(F.col("merged"), F.struct("batch_id", "at") == F.col("_last"))
    kept = kept.otherwise(F.col("_last").isNull() | (F.col("batch_id") > F.col("_last.batch_id")))
    return rows.filter(kept).drop("_last", "_newest")


def _commit(spark: SparkSession, path: str, folder: str, batch_id: int, merged: bool) -> None:
    row = {"folder": folder, "batch_id": batch_id, "merged": merged, "at": time.time_ns()}
    _log(spark, path).commit(lambda _: [row])


def _merge(spark: SparkSession, path: str, schema: StructType, keys: tuple[str, ...], last: int) -> None:
    """Replace what the log names up to a batch by one folder, and delete what has long been replaced."""
    folder = f"merged-{last}-{uuid.uuid4().hex}"
    rows = _batch_rows(spark, path, schema).filter(F.col("batch_id") <= last)
    _newest(rows, keys).withColumn("batch_id", F.lit(last).cast("long")).write.parquet(f"{path}/{folder}")
    _commit(spark, path, folder, last, merged=True)
    named = {r.folder for r in _log(spark, path).rows().select("folder").collect()}
    for name, changed in listing(spark, path):
        if name.startswith(("rows-", "merged-")) and name not in named and changed < (time.time() - KEEP_SECONDS) * 1000:
            remove(spark, f"{path}/{name}")


def imports_to(
    store: PostStore,
    topic: str,
    name: str,
    now: Callable[[], dt.datetime],
    lexicon: DataFrame | None = None,
):
    """Append each micro-batch of enriched posts to the store as one import.

    With ``lexicon`` the batches hold normalised posts (``prepare(enriched=False)``)
    and are enriched here, where a lexicon of any size can be joined. The import
    id is made of the stream's name and the batch number, so a repeated batch
    replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        posts = batch if lexicon is None else enrich(batch, lexicon)
        store.write_import(posts, topic, now(), import_id=f"{name}-{batch_id}", source="stream")

    return write


def all_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of all micro-batches, for streams in append mode."""
    return spark.read.schema(schema).parquet(path).drop("batch_id")


def _batch_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of the folders that the log names now; a bounded list, as merges keep it short.

    A table written without keys has no log; its batches are partitions.
    """
    schema = StructType([*schema.fields, StructField("batch_id", LongType())])
    folders = [r.folder for r in _log(spark, path).rows().select("folder").collect()]
    if not folders and any(name.startswith("batch_id=") for name, _ in listing(spark, path)):
        return spark.read.schema(schema).parquet(path)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(literal(f"{path}/{f}") for f in folders))


def _newest(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return newest.select(*keys, "v.*")


def latest_rows(spark: SparkSession, path: str, schema: StructType, *keys: str) -> DataFrame:
    """Newest row per key, for windowed counts written in update mode."""
    return _newest(_batch_rows(spark, path, schema), keys)
