"""CSV source.

Files are split over tasks, also those whose quoted cells hold line breaks. For
these, each line tells how it ends if it begins outside a quoted cell, and how if
inside. Running these two answers together over the lines of a byte range, and
then over the ranges of a file, tells where every record begins; lines of one
record are put together, and each record is parsed for itself.
"""

from __future__ import annotations

import csv
import re
from collections import Counter
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearsay.functions.values import null_if_missing
from hearsay.sources.files import exists, literal
from hearsay.sources.scratch import written

_PARSING = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _paths(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Paths for Spark's readers: the name of what is there stands for itself, any other is a pattern."""
    given = [path] if isinstance(path, str) else path
    return [literal(p) if re.search(r"[{}\[\]*?\\]", p) and exists(spark, p) else p for p in given]


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, at, value): lines with their file, byte range and order in it."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def file_forms(spark: SparkSession, path: str | list[str]) -> list[tuple[list[str], bool, list[str]]]:
    """(columns, whether quoted cells hold line breaks, files): the forms among the CSV files.

    One pass over the lines finds each file's first line, and whether a line ends
    inside quotes, which an odd number of quotes tells.
    """
    lines = _lines(spark, _paths(spark, path))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    files = lines.groupBy("file").agg(
        F.min_by("value", F.struct("block", "at")).alias("header"), F.max(quotes % 2 == 1).alias("open")
    )
    forms: dict[tuple, list[str]] = {}
    for r in files.collect():  # one row per file, as Spark's own listing of them
        names = next(csv.reader([(r.header or "").lstrip("﻿").rstrip("\r")]), [])
        if names:
            forms.setdefault((tuple(names), r.open), []).append(unquote(r.file))
    return [(list(names), multiline, sorted(found)) for (names, multiline), found in sorted(forms.items())]


def _unique(names: list[str]) -> list[str]:
    """A name that comes again gets a number, as spreadsheet readers do: User, User.1."""
    seen: Counter[str] = Counter()
    out = []
    for name in names:
        new = f"{name}.{seen[name]}" if seen[name] else name
        while seen[name] and new in names:
            seen[name] += 1
            new = f"{name}.{seen[name]}"
        seen[name] += 1
        out.append(new)
    return out


def _ends_inside(value: Column) -> tuple[Column, Column]:
    """Whether a line ends inside a quoted cell, if it begins outside of one, and if it begins inside."""
    body = r'[^"]*+(?:""[^"]*+)*+"'
    opens = lambda line: F.regexp_replace(line, f',"{body}', ",").contains(',"')
    closed = F.regexp_replace(value, f"^{body}", "x")
    quoted = value.contains('"')
    outside = quoted & opens(F.concat(F.lit(","), value))
    inside = ~quoted | (closed == value) | opens(closed)
    return outside, inside


def _running(outside: Column, inside: Column, over: Window) -> tuple[Column, Column]:
    """Of all steps so far: the last fixed state, seen through later turns (null: none), and the parity of turns."""
    turns = (F.coalesce(F.sum((outside & ~inside).cast("int")).over(over), F.lit(0)) % 2).cast("int")
    fixed = F.last(F.when(outside == inside, outside.cast("int").bitwiseXOR(turns)), ignorenulls=True).over(over)
    return fixed, turns


def split_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(value): the records below the header of CSV files whose quoted cells may hold line breaks.

    All work is on byte ranges and their lines: a range is sorted as a whole, a
    file is not. Only lines of records of several lines are grouped.
    """
    outside, inside = _ends_inside(F.col("value"))
    lines = _lines(spark, [literal(f) for f in files]).withColumns({"outside": outside, "inside": inside})
    in_range = Window.partitionBy("file", "block").orderBy("at")
    so_far = in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fixed, turns = _running(F.col("outside"), F.col("inside"), so_far)
    lines = lines.withColumn("fixed", fixed).withColumn("turns", turns)
    # the whole range as one step, and from these how each range begins
    ranges = lines.groupBy("file", "block").agg(F.max_by("fixed", "at").alias("f"), F.max_by("turns", "at").alias("t"))
    state = lambda begin: F.coalesce("f", F.lit(begin)).bitwiseXOR(F.col("t"))
    ranges = ranges.withColumns({"outside": state(0) == 1, "inside": state(1) == 1})
    in_file = Window.partitionBy("file").orderBy("block")
    fixed, turns = _running(F.col("outside"), F.col("inside"), in_file.rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("file", "block", F.coalesce(fixed, F.lit(0)).bitwiseXOR(turns).alias("begin"))
    lines = lines.join(ranges, ["file", "block"])
    after = F.coalesce("fixed", "begin").bitwiseXOR(F.col("turns"))
    lines = lines.select("file", "block", "at", "value", "begin", after.alias("after"))
    before = F.coalesce(F.lag("after").over(in_range), "begin")
    lines = lines.withColumn("first", before == 0)
    lines = lines.withColumn("record", F.sum(F.col("first").cast("long")).over(so_far))
    alone = lines.where("first and after = 0").select("block", "record", "value")
    # records of several lines; a range's first lines may belong to a record of an earlier range
    rest = lines.where("not first or after <> 0")
    last = lines.groupBy("file", "block").agg(F.max("record").alias("n"))
    owner = F.last(F.when(F.col("n") > 0, F.struct("block", "n")), ignorenulls=True)
    last = last.withColumn("owner", owner.over(in_file.rowsBetween(Window.unboundedPreceding, -1))).select("file", "block", "owner")
    own = F.when(F.col("record") > 0, F.struct("block", F.col("record").alias("n"))).otherwise(F.col("owner"))
    rest = rest.join(last, ["file", "block"]).select("file", own.alias("own"), F.struct("block", "at", "value").alias("line"))
    put = F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["value"]), "\n")
    several = rest.groupBy("file", "own").agg(put.alias("value")).select(F.col("own.block").alias("block"), F.col("own.n").alias("record"), "value")
    records = alone.unionByName(several).where("not (block = 0 and record = 1)")
    # where a record ends with both characters, its inner line breaks count as one, as Spark's own reader has it
    both = F.replace(F.expr("left(value, length(value) - 1)"), F.lit("\r\n"), F.lit("\n"))
    return records.select(F.when(F.col("value").endswith("\r"), both).otherwise(F.col("value")).alias("value")).where("value <> ''")


def read_posts_csv(
    spark: SparkSession, path: str | list[str], multiline: bool | None = None, malformed: str | None = None
) -> DataFrame:
    """Posts from CSV files with a header; all columns are strings.

    Files may have different headers: each is read by its own, and a column that
    a file lacks is null there. A header that repeats a name gets numbers (User,
    User.1); names that differ in case are different columns. Whether quoted
    cells hold line breaks is found out; ``multiline`` overrides it. ``malformed``
    names a column for the text of lines with too many or too few cells (null for
    all others). A path that is there is taken as it is, any other as a pattern.
    """
    forms = [(_unique(names), found, files) for names, found, files in file_forms(spark, path)]
    if not forms:
        raise ValueError(f"no CSV file with a header in {path}")
    columns = list(dict.fromkeys(name for names, _, _ in forms for name in names))
    if malformed:
        columns.append(malformed)
    parts = []
    for names, found, files in forms:
        own = [*names, *([malformed] if malformed else [])]
        # by place: names may hold any character, and differ in case alone
        schema = ", ".join(f"_{i} string" for i in range(len(own)))
        options = {**_PARSING, **({"columnNameOfCorruptRecord": f"_{len(names)}"} if malformed else {})}
        if found if multiline is None else multiline:
            rows = split_records(spark, files).select(F.from_csv("value", schema, options).alias("r")).select("r.*")
        else:
            rows = spark.read.schema(schema).options(header=True, **options).csv([literal(f) for f in files])
        at = {name: null_if_missing(F.col(f"_{i}")) for i, name in enumerate(own)}
        parts.append(rows.select([at.get(c, F.lit(None).cast("string")).alias(f"_{i}") for i, c in enumerate(columns)]))
    return reduce(DataFrame.unionByName, parts).toDF(*columns)


def malformed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line) of the lines with too many or too few cells; a spreadsheet reader would refuse such a file."""
    rows = read_posts_csv(spark, path, malformed="_malformed")
    # written first: Spark does not read this column alone
    rows = rows.toDF(*(f"_{i}" for i in range(len(rows.columns) - 1)), "_malformed")
    return written(rows, "csv-rows").select(F.col("_malformed").alias("line")).filter(F.col("line").isNotNull())


def write_posts_csv(df: DataFrame, path: str) -> None:
    """Write all-string posts so that :func:`read_posts_csv` gives them back."""
    (
        df.write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
