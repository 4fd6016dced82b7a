"""Lookup tables: lexicon, gazetteers, country names, stopwords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Largest lookup that is turned into literals of a plan.
MAX_LITERAL_ROWS = 5_000
MAX_LITERAL_CHARS = 200_000
MAX_CELL_CHARS = 1_000


def read_lookup(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """A lookup table with a fixed schema, from Parquet, JSON or CSV."""
    reader = spark.read.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def small_rows(df: DataFrame, max_rows: int = MAX_LITERAL_ROWS) -> list | None:
    """The rows if there are at most ``max_rows`` of at most MAX_LITERAL_CHARS, else None.

    One job fetches one row more than allowed, each cell one character longer
    than allowed, and the decision is made on what came back.
    """
    strings = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    cut = df.withColumns({c: F.left(c, F.lit(MAX_CELL_CHARS + 1)) for c in strings})
    rows = cut.limit(max_rows + 1).collect()
    lengths = [len(r[c]) for r in rows for c in strings if r[c] is not None]
    if len(rows) > max_rows or sum(lengths) > MAX_LITERAL_CHARS or max(lengths, default=0) > MAX_CELL_CHARS:
        return None
    return rows
