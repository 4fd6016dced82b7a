"""Boilerplate lines by their frequency relative to the site.

Lines are counted once per page and divided by the pages of the page's host; a
line above the ratio is dropped from all pages of that host. It must be on
``MORE`` pages beyond the ratio's, at every size of the host, so that what a few
pages of a small host have in common by chance stays. Only a digest of a
line (96 bits) is counted and shuffled, after partial counts; a host's dropped
lines are bounded by lines per page / ratio, and texts are never shuffled while
Spark finds that list small enough to broadcast.

Edge cases: a null text is a page without lines and stays null; blank lines are
never counted or dropped; a text whose lines are all dropped becomes empty. A
null host is a host of its own. Repeated rows are pages of their own. A host
of two pages has no line on enough of them. An empty table gives an empty
result. All columns of the input are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearsay.llm.tables import written

RATIO = 0.1
MORE = 2
BLANK = r"^[\x20\x09-\x0D]*$"


def _digest(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate(
    docs: DataFrame,
    text_column: str = "text",
    host_column: str = "source",
    ratio: float = RATIO,
    more: float = MORE,
) -> DataFrame:
    """(host, lines): digests of the lines on more than ``ratio`` of a host's pages and ``more``."""
    pages = docs.select(F.col(host_column).alias("host"), F.split(text_column, "\n").alias("lines"))
    totals = pages.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    lines = lines.where(~F.col("line").rlike(BLANK)).select("host", _digest(F.col("line")).alias("d"))
    counts = lines.groupBy("host", F.col("d.a").alias("a"), F.col("d.b").alias("b")).agg(F.count("*").alias("n"))
    common = counts.where(F.col("n") > more).join(totals, F.col("host").eqNullSafe(F.col("h")))
    common = common.where(F.col("n") > F.lit(ratio) * F.col("pages") + more)
    return common.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("lines"))


def drop_boilerplate(
    docs: DataFrame,
    text_column: str = "text",
    host_column: str = "source",
    ratio: float = RATIO,
    more: float = MORE,
) -> DataFrame:
    """The input with boilerplate lines dropped from the text."""
    found = written(boilerplate(docs, text_column, host_column, ratio, more), "boilerplate")
    found = found.select(F.col("host").alias("_site_host"), F.col("lines").alias("_site_lines"))
    joined = docs.join(found, F.col(host_column).eqNullSafe(F.col("_site_host")), "left")
    rest = F.filter(F.split(text_column, "\n"), lambda x: ~F.array_contains("_site_lines", _digest(x)))
    text = F.when(F.col("_site_lines").isNull(), F.col(text_column)).otherwise(F.array_join(rest, "\n"))
    return joined.select(*[text.alias(c) if c == text_column else F.col(c) for c in docs.columns])
