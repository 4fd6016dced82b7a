"""Mixing sources to target weights by Pareto order sampling.

Each source gets a word target: the total of all sizes shared by the source
weights, at most ``cap`` times the source's own size, the excess shared again.
A document is taken ``floor(target / size of its source)`` times for certain.
The rest of the target is drawn as a Pareto order sample: documents are ranked
by random odds divided by their inclusion odds, and the lowest ranks are taken
until the words are reached. Inclusion probabilities follow ``weight`` within a
source and differ between sources.

The ranking is cut without sorting a source: ranks fall into ``BINS`` bins, the
bins' words are summed before the shuffle, and a source's cut is a bin number.
So a source of any size costs one row per task and bin, and the result is
within half a bin (or half a document, if that is more) of the target.

Edge cases: a null text has size 0; sizeless documents are taken 0 words. Null
is a source of its own, ordered last. The random number depends on the id and
the seed alone, so reruns agree and repeated rows are taken alike. An empty
table gives an empty result. Other columns are kept, unless they have the name
of an output, which replaces them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.llm.tables import written

# --- Fixed values --------------------------------------------------------------
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CAP = 3

BINS = 4096
SEED = "mix-1"


def size_of(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number between 0 and 1 that only depends on the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row per source.

    Sources are numbered in code point order by a distributed sort; only the
    number of rows of each sorted part and the sums of each round come to the driver.
    """
    ordered = written(
        sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "mix-sources"
    )
    part = F.shiftright("at", 33)
    before, offsets = 0, []
    for r in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets += [F.lit(r.part), F.lit(before)]
        before += r["count"]
    if not before:
        return sizes.select("source", "source_size", F.lit(1).alias("weight"), F.lit(0.0).alias("target"))
    position = F.element_at(F.create_map(*offsets), part) + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (position % len(weights) + 1).cast("int"))
    ordered = ordered.select("source", "source_size", weight.alias("weight"))
    level, n_capped = 0.0, -1
    total = None
    while True:
        over = F.lit(float(cap)) * F.col("source_size") / F.col("weight") < F.lit(level)
        got = ordered.agg(
            F.sum("source_size").alias("total"),
            F.count_if(over).alias("n"),
            F.coalesce(F.sum(F.when(over, cap * F.col("source_size"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        total = got.total
        if got.n == n_capped or not got.open:
            break
        level, n_capped = (total - got.capped) / got.open, got.n
    over = F.lit(float(cap)) * F.col("source_size") / F.col("weight") < F.lit(level)
    target = F.when(over, (cap * F.col("source_size")).cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return ordered.withColumn("target", target)


def _rank(p: Column, key: Column, seed: str) -> Column:
    """Bin of the Pareto rank ``(u / (1 - u)) / (p / (1 - p))``, mapped to 0..BINS-1."""
    u = uniform(key, seed)
    q = (u / (1.0 - u)) * ((1.0 - p) / p)
    return F.when(p > 0, F.least(F.floor((q / (1.0 + q)) * BINS), F.lit(BINS - 1))).cast("int")


def plan_mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
    weight: Column | None = None,
) -> DataFrame:
    """(source, source_size, target, whole, rate, cut), one row per source."""
    sized = written(
        docs.select(
            F.col(id_column).alias("id"),
            F.col(source_column).alias("source"),
            size_of(F.col(text_column)).alias("size"),
            (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"),
        ),
        "mix-sizes",
    )
    sources = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.col("w") * F.col("size")).alias("weighted")
    )
    sources = written(sources, "mix-source-sizes")
    targets = source_targets(sources.select("source", "source_size"), weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("whole", whole.cast("long")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    plan = plan.join(sources.select(F.col("source").alias("s"), "weighted"), F.col("source").eqNullSafe(F.col("s")))
    plan = plan.withColumn("rate", F.when(F.col("weighted") > 0, F.col("rest") / F.col("weighted")).otherwise(0.0))
    plan = written(plan.drop("s", "weighted"), "mix-plan")

    ranked = sized.join(
        plan.select(F.col("source").alias("s"), "rate", "rest"), F.col("source").eqNullSafe(F.col("s"))
    )
    p = F.least(F.col("rate") * F.col("w"), F.lit(1.0))
    bins = ranked.select("source", "rest", "size", _rank(p, F.col("id"), seed).alias("bin")).where("bin is not null")
    bins = bins.groupBy("source", "rest", "bin").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source", "rest").orderBy("bin"))
    reached = bins.withColumn("middle", upto - F.col("words") / 2).where("middle <= rest")
    cuts = reached.groupBy(F.col("source").alias("s")).agg(F.max("bin").alias("cut"))
    plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left")
    return written(
        plan.select("source", "source_size", "target", "whole", "rate", F.coalesce("cut", F.lit(-1)).alias("cut")),
        "mix-cuts",
    )


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
    weight: Column | None = None,
) -> DataFrame:
    """All rows with size, source_size, target, copies and taken (copies times size)."""
    added = ("size", "source_size", "target", "copies", "taken")
    plan = plan_mix(docs, id_column, text_column, source_column, weights, cap, seed, weight)
    plan = plan.select(*[F.col(c).alias(f"_mix_{c}") for c in plan.columns])
    keep = [c for c in docs.columns if c not in added]
    w = F.lit(1.0) if weight is None else weight.cast("double")
    joined = docs.join(plan, F.col(source_column).eqNullSafe(F.col("_mix_source")), "left")
    p = F.least(F.col("_mix_rate") * w, F.lit(1.0))
    drawn = F.coalesce(_rank(p, F.col(id_column), seed) <= F.col("_mix_cut"), F.lit(False))
    sized = joined.select(
        *keep,
        size_of(F.col(text_column)).alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_whole") + drawn.cast("long")).alias("copies"),
    )
    return sized.withColumn("taken", F.col("copies") * F.col("size"))


def materialise(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of the input."""
    mixed = mix(docs, **options).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)
