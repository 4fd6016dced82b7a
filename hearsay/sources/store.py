"""Post store: imports, posts and their counts as Parquet tables.

Layout: posts and counts lie in folders by ``topic_hash`` (a digest of the
lower-case topic, safe in any path), ``import_id`` and ``attempt``. Every try of
an import writes an attempt of its own; the import's row in the registry, written
last, names the attempt that counts. So a failed import leaves nothing visible, a
repeated one is replaced as a whole, also by nothing, and no folder is ever
overwritten. Reading a topic lists that topic's folder only.

The registry is a commit log (``log.py``) for each of ``BUCKETS``, by topic. The
newest row of an import counts. An import decides which search it joins from the
state its entry follows, so imports may run at the same time, of the same topic
too. A reader sees one state of the registry, whatever is committed meanwhile.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearsay.operators.distributions import sentiment_metrics, with_share
from hearsay.operators.rankings import hashtag_counts, top
from hearsay.operators.search import posts_search
from hearsay.schema import IMPORT_SCHEMA, POST_SCHEMA
from hearsay.sources.files import remove
from hearsay.sources.log import Log, read
from hearsay.sources.lookups import small_rows

PARTITIONS = ("topic_hash", "import_id", "attempt")
_KEYS = [T.StructField(name, T.StringType()) for name in PARTITIONS]
_HASHTAGS = [T.StructField("hashtag", T.StringType()), T.StructField("count", T.LongType())]
_SENTIMENTS = [T.StructField("sentiment", T.StringType()), T.StructField("count", T.LongType())]

#: The second of a post's time as a number: Spark compares times without zone only after reading them.
_SECOND = "created_second"

TABLES = {
    "posts": T.StructType([*POST_SCHEMA.fields, T.StructField(_SECOND, T.LongType()), *_KEYS]),
    "hashtag_counts": T.StructType(_HASHTAGS + _KEYS),
    "sentiment_counts": T.StructType(_SENTIMENTS + _KEYS),
}
REGISTRY = T.StructType(
    [*IMPORT_SCHEMA.fields, *(T.StructField(c, T.StringType()) for c in ("topic_hash", "attempt"))]
)

#: Each task sorts its posts by time, so row groups and pages of its file have narrow ranges of time; platforms and
#: ids are also kept as bloom filters. A read by any of them leaves out what can't match.
_SKIPPING = {
    "parquet.bloom.filter.enabled#platform": "true",
    "parquet.bloom.filter.enabled#post_id": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
}

#: One log for each first digit of a topic's digest.
BUCKETS = "0123456789abcdef"


class PostStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # -- tables ---------------------------------------------------------------

    def create(self) -> "PostStore":
        """Make the empty tables; existing ones stay as they are."""
        for name, schema in TABLES.items():
            empty = self.spark.createDataFrame([], schema)
            empty.write.mode("append").partitionBy(*PARTITIONS).parquet(self._path(name))
        return self

    def _path(self, name: str, topic: str | None = None, import_id: str | None = None, attempt: str | None = None) -> str:
        keys = {"topic_hash": None if topic is None else _hash(topic), "import_id": import_id, "attempt": attempt}
        return "/".join([self.root, name, *(f"{k}={v}" for k, v in keys.items() if v is not None)])

    def _load(self, schema: T.StructType, root: str, path: str) -> DataFrame:
        """What a folder of a table holds; no rows if there is no such folder."""
        try:
            return self.spark.read.schema(schema).option("basePath", root).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND" or path == root:
                raise
            return self.spark.createDataFrame([], schema)

    def _read(
        self, name: str, topic: str | None = None, import_id: str | None = None, attempt: str | None = None
    ) -> DataFrame:
        """A table, or only what it holds of a topic, import or attempt."""
        return self._load(TABLES[name], self._path(name), self._path(name, topic, import_id, attempt))

    # -- import ---------------------------------------------------------------

    def write_import(
        self,
        posts: DataFrame,
        topic: str,
        imported_at: dt.datetime,
        import_id: str | None = None,
        source: str = "csv",
        platform: str = "multiple",
        recent: dt.timedelta | None = None,
    ) -> str | None:
        """Store enriched posts of a topic; returns the import id, None without posts.

        The import joins the latest search of the topic, ignoring case; with
        ``recent`` only one of exactly that topic that began within that time.
        All rows go to one folder, each task writing its own file there, sorted by
        time, so the write needs no shuffle however large the topic is. Repeating an import
        id replaces all it stored; repeated without posts, it is gone.
        """
        import_id = import_id or uuid.uuid4().hex
        if not re.fullmatch(r"[\w.-]+", import_id, re.ASCII):
            raise ValueError(f"an import id is made of letters, digits, '.', '_' and '-': {import_id!r}")
        attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"  # sorts by time
        place = lambda name: self._path(name, topic, import_id, attempt)
        rows = posts.select(*POST_SCHEMA.fieldNames(), _second(F.col("created_at")).alias(_SECOND)).sortWithinPartitions(_SECOND)
        rows.write.options(**_SKIPPING).parquet(place("posts"))

        # Counts come from the written files: enriching again would double the
        # work, and the files survive the loss of any executor.
        stored = self._read("posts", topic, import_id, attempt)
        stored.groupBy("sentiment").agg(F.count("*").alias("count")).write.parquet(place("sentiment_counts"))
        written = self._read("sentiment_counts", topic, import_id, attempt).agg(F.sum("count")).first()[0] or 0
        if written:
            hashtag_counts(stored).write.parquet(place("hashtag_counts"))
        elif self.imports(topic).filter(F.col("import_id") == import_id).isEmpty():
            return None

        since = imported_at - recent if recent is not None else None
        topic_key = _key(topic)

        def row(imports: DataFrame) -> list[dict]:
            search_id = self.find_search(topic, recent is not None, since, imports, import_id)
            values = (import_id, search_id or import_id, topic, topic_key, imported_at.isoformat(), source, platform, written)
            return [dict(zip(REGISTRY.fieldNames(), (*values, _hash(topic), attempt)))]

        self._register(row, topic)
        return import_id if written else None

    def _log(self, topic: str) -> Log:
        return self._bucket(_hash(topic)[0])

    def _bucket(self, bucket: str) -> Log:
        return Log(self.spark, f"{self._path('imports')}/bucket={bucket}", REGISTRY, _newest)

    def _register(self, row: Callable[[DataFrame], list[dict]], topic: str) -> None:
        """Commit what ``row`` makes of the topic's rows."""
        self._log(topic).commit(lambda rows: row(_of(rows, topic)))

    def vacuum(self) -> int:
        """Delete attempts that no import names: failed and replaced ones. Not while imports run."""
        named = self.imports_with_attempts().select(*PARTITIONS)
        gone = 0
        for name in TABLES:
            for r in self._read(name).select(*PARTITIONS).distinct().join(named, [*PARTITIONS], "left_anti").toLocalIterator():
                remove(self.spark, f"{self._path(name)}/topic_hash={r.topic_hash}/import_id={r.import_id}/attempt={r.attempt}")
                gone += 1
        return gone

    # -- searches -------------------------------------------------------------

    def imports_with_attempts(self, topic: str | None = None) -> DataFrame:
        if topic is None:
            logs = [self._bucket(b) for b in BUCKETS]
            return read([(log, log.snapshot()) for log in logs]).filter("n_posts > 0")
        return _of(self._log(topic).rows(), topic).filter("n_posts > 0")

    def imports(self, topic: str | None = None) -> DataFrame:
        """One row per import, of all topics or of one."""
        return self.imports_with_attempts(topic).select(*IMPORT_SCHEMA.fieldNames())

    def searches(self, topic: str | None = None) -> DataFrame:
        """One row per search: imports that were put together, from the first on."""
        return _searches(self.imports(topic))

    def latest_search(self, topic: str, exact: bool = False, since: dt.datetime | None = None) -> DataFrame:
        """(search_id) of the newest search of the topic, no row if there is none."""
        return _latest(self.imports(topic), topic, exact, since)

    def find_search(
        self,
        topic: str,
        exact: bool = False,
        since: dt.datetime | None = None,
        imports: DataFrame | None = None,
        import_id: str | None = None,
    ) -> str | None:
        """The search of an earlier try of the import, if there is one, else the newest of the topic; one job.

        ``imports`` is a state of the topic's registry rows, else that of now.
        """
        found = (self.imports_with_attempts(topic) if imports is None else imports).filter("n_posts > 0")
        own = found.filter(F.col("import_id") == import_id).select("search_id", F.lit(True).alias("own"))
        latest = _latest(found, topic, exact, since).withColumn("own", F.lit(False))
        return own.unionByName(latest).agg(F.max_by("search_id", "own")).first()[0]

    def has_topic(self, topic: str, exact: bool = False) -> bool:
        return not self._topic_imports(topic, exact).limit(1).isEmpty()

    def known_topics(self, topics: DataFrame) -> DataFrame:
        """Add ``known`` to a table of topics: whether any import has it, ignoring case."""
        keys = self.imports().select(F.col("topic_key").alias("_key"), F.lit(True).alias("_found")).distinct()
        return topics.join(keys, F.lower("topic") == F.col("_key"), "left").select(
            *topics.columns, F.coalesce("_found", F.lit(False)).alias("known")
        )

    def search_history(self, k: int = 10) -> DataFrame:
        """Distinct topics, last searched first."""
        topics = self.searches().groupBy("topic").agg(F.max("searched_at").alias("last_searched"))
        return top(topics, "last_searched", "topic", k=k)

    def import_summary(self) -> DataFrame:
        return self.imports().select("import_id", "topic", "imported_at", "n_posts")

    # -- topic reads ----------------------------------------------------------

    def _topic_imports(self, topic: str, exact: bool) -> DataFrame:
        found = self.imports_with_attempts(topic)
        return found.filter(F.col("topic") == topic) if exact else found

    def _of_topic(self, name: str, topic: str, latest: bool, exact: bool, only: DataFrame | None = None) -> DataFrame:
        """Rows of the topic's imports that are complete; with ``only``, of those whose import_id it holds."""
        found = self.imports_with_attempts(topic)  # one state of the registry for all that follows
        imports = found.filter(F.col("topic") == topic) if exact else found
        if latest:
            search_id = self.find_search(topic, exact, imports=found)
            imports = imports.filter(F.col("search_id") == (search_id or ""))
        rows = self._read(name, topic).drop("topic_hash")
        if only is not None:
            few = small_rows(only)
            if few is None:
                imports = imports.join(only, "import_id", "left_semi")
            else:  # literals choose the folders before any is listed
                rows = rows.filter(F.col("import_id").isin([r.import_id for r in few]))
        return rows.join(imports.select("import_id", "attempt", "imported_at"), ["import_id", "attempt"]).drop("attempt")

    def topic_posts(self, topic: str, latest: bool = False, exact: bool = False) -> DataFrame:
        """Posts of a topic: of all its imports, or of the latest search only."""
        return self._of_topic("posts", topic, latest, exact).drop("imported_at", _SECOND)

    def search(
        self,
        topic: str,
        keyword: str | None = None,
        hashtag: str | None = None,
        start=None,
        end=None,
        platform: str | None = None,
        literal: bool = False,
        latest: bool = False,
        exact: bool = False,
    ) -> DataFrame:
        """Stored posts of a topic that meet every given condition.

        The counts of a tag are its index: imports that never used it are not
        opened. Times and platforms leave out row groups of the files.
        """
        tagged = None
        if hashtag is not None:
            tagged = self._of_topic("hashtag_counts", topic, latest, exact).filter(F.col("hashtag") == hashtag)
            tagged = tagged.select("import_id").distinct()
        posts = self._of_topic("posts", topic, latest, exact, only=tagged).drop("imported_at")
        for bound, fits in ((start, Column.__ge__), (end, Column.__le__)):
            if bound is not None:
                posts = posts.filter(fits(F.col(_SECOND), _second(F.lit(str(bound)).cast("timestamp_ntz"))))
        posts = posts.drop(_SECOND)
        if platform is not None:
            posts = posts.filter(F.col("platform") == platform)
        return posts_search(posts, keyword, hashtag, start, end, literal)

    def topic_hashtags(
        self, topic: str, k: int = 10, parity: bool = False, latest: bool = False, exact: bool = False
    ) -> DataFrame:
        """Top tags; with ``parity`` per import, so a tag may be listed repeatedly."""
        rows = self._of_topic("hashtag_counts", topic, latest, exact)
        if parity:
            return top(rows, "count", "hashtag", "import_id", k=k).select("hashtag", "count")
        return top(rows.groupBy("hashtag").agg(F.sum("count").alias("count")), "count", "hashtag", k=k)

    def topic_sentiment(self, topic: str, latest: bool = False, exact: bool = False) -> DataFrame:
        rows = self._of_topic("sentiment_counts", topic, latest, exact)
        return with_share(rows.groupBy("sentiment").agg(F.sum("count").alias("count")))

    def topic_sentiment_imports(self, topic: str, latest: bool = False, exact: bool = False) -> DataFrame:
        """Stored sentiment counts of each import of the topic."""
        return self._of_topic("sentiment_counts", topic, latest, exact).select(
            "import_id", "imported_at", "sentiment", "count"
        )

    def topic_metrics(self, topic: str, latest: bool = False, exact: bool = False) -> DataFrame:
        """The same counts as (metric, value) text rows, one per import and class."""
        return sentiment_metrics(self._of_topic("sentiment_counts", topic, latest, exact))


def _second(time: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time)


def _of(rows: DataFrame, topic: str) -> DataFrame:
    return rows.filter(F.col("topic_hash") == _hash(topic))


def _searches(imports: DataFrame) -> DataFrame:
    """One row per search of some imports."""
    first = F.struct("imported_at", "import_id")
    return imports.groupBy("search_id", "topic_key").agg(
        F.min_by("topic", first).alias("topic"),
        F.min("imported_at").alias("searched_at"),
        F.min_by("source", first).alias("source"),
        F.min_by("platform", first).alias("platform"),
        F.sum("n_posts").alias("n_posts"),
    )


def _latest(imports: DataFrame, topic: str, exact: bool, since: dt.datetime | None = None) -> DataFrame:
    found = _searches(imports)
    if exact:
        found = found.filter(F.col("topic") == topic)
    if since is not None:
        found = found.filter(F.col("searched_at") > F.lit(since).cast("timestamp_ntz"))
    return top(found, "searched_at", "search_id", k=1).select("search_id")


def _newest(rows: DataFrame) -> DataFrame:
    """The newest registry row of each import."""
    values = [c for c in rows.columns if c not in ("topic_hash", "import_id")]
    newest = rows.groupBy("topic_hash", "import_id").agg(F.max_by(F.struct(*values), "attempt").alias("v"))
    return newest.select("topic_hash", "import_id", "v.*").select(*rows.columns)


def _key(topic: str) -> str:
    if not topic.strip():
        raise ValueError("a topic must not be blank")
    return topic.lower()


def _hash(topic: str) -> str:
    return hashlib.md5(_key(topic).encode()).hexdigest()
