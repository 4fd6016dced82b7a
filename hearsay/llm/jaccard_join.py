"""Documents whose n-gram sets are alike: a prefix-tree join.

A set is the distinct word n-grams of a text as 52-bit hashes. Two documents
link when their Jaccard similarity reaches ``percent``; the result is their
connected components, and no link between different sets is left out.

1. Equal sets become one class, named by its smallest id.
2. All n-grams get one global order: by the number of sets that have them, most
   frequent first, then by hash. N-grams that no other set has link nothing and
   are only counted: a set with too many of them goes, as it can't reach the
   needed overlap with any other.
3. So many of the rarest n-grams are a set's prefix that sets that can link share
   one of theirs. An n-gram counts in the own size class and in the next, so only
   sets of similar size meet. Passages that unlike texts share are not rare, so
   prefixes bring together little more than sets that link.
4. Sets that share prefix n-grams, directly or over others, form clusters, found
   from ids alone. A cluster's sets meet in blocks of bounded size, its first set
   in each. A block stores its sets in a prefix tree, in the global order, and
   joins them by walking it: the overlap of a shared prefix is counted once for
   each probe, and a subtree is left as soon as the remaining lengths can't reach
   the needed overlap. Links give components.
5. In clusters of several blocks, sets that still share a prefix n-gram with a set
   of another component are joined again, only across components: what is not in
   the cluster's largest component meets all others, in pairs of bounded blocks.

Links leave a block as a spanning forest, never as all pairs. Copies are merged
in each task before the shuffle. A group of near copies becomes many blocks.

Edge cases: a text with fewer words than ``n`` has one n-gram, the whole
sequence; null, empty and blank texts have none and link with nothing. Repeated
rows are each returned. Rows that share an id count as one document for links.
Rows without an id get no component. An empty table gives an empty result.
Other columns are ignored by :func:`near_duplicates`, and kept by
:func:`keep_one`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.graphs import components
from hearsay.llm.tables import discard, written
from hearsay.llm.textblocks import Block, blocks, mix

NGRAM = 3
PERCENT = 90

#: n-grams that a block of the join holds, about.
BLOCK_NGRAMS = 1 << 20
#: Bytes of the table that tells which n-grams each probe has.
PROBE_BYTES = 1 << 24
#: Most bits of the table of shared n-grams: it spares shuffling others, as long as it is not full of marks.
MARK_BITS = 1 << 26
#: n-grams that a task counts together before they are shuffled, about.
COUNTED = 1 << 20

_HASH_BITS = np.uint64(52)
#: More sets than so many count as so many in the global order.
_MOST_HELD = 2047
_HASH_MASK = np.uint64((1 << 52) - 1)


def ngram_sets(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct n-gram, sorted by both."""
    at, hashes = block.ngrams(n)
    rows = block.word_rows[at]
    counts = np.diff(block.words_before)
    for short in np.flatnonzero((counts > 0) & (counts < n)):
        words = block.words[block.words_before[short] : block.words_before[short + 1]]
        whole = mix(words + np.arange(1, len(words) + 1, dtype=np.uint64)).sum(dtype=np.uint64)
        rows, hashes = np.append(rows, short), np.append(hashes, whole)
    keys = np.sort((rows.astype(np.uint64) << _HASH_BITS) | (hashes & _HASH_MASK))
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return (keys >> _HASH_BITS).astype(np.int64), keys & _HASH_MASK


class SizeClasses:
    """Set sizes in ranges such that sets that can link are in one range or in neighbouring ones."""

    def __init__(self, percent: int):
        first, lows = 1, []
        while first < 1 << 40:
            lows.append(first)
            first = first * 100 // percent + 1
        self.lows = np.array(lows)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, side="right") - 1


def _digests(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Two sums of 64 bits that name each of ``n`` sets."""
    out = np.zeros((n, 2), dtype=np.uint64)
    np.add.at(out[:, 0], rows, mix(hashes))
    np.add.at(out[:, 1], rows, mix(hashes + np.uint64(1 << 60)))
    return out


def _names(docs: DataFrame, id_column: str, text_column: str, n: int) -> DataFrame:
    """(id, n, key, digest): each row's set size and digest, also as a number."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1), fold=True):
                rows, hashes = ngram_sets(block, n)
                digests = _digests(rows, hashes, len(block))
                columns = [
                    batch.column(0).slice(block.first, len(block)),
                    pa.array(np.bincount(rows, minlength=len(block)), pa.int64()),
                    pa.array([d.tobytes() for d in digests], pa.binary()),
                    pa.array(digests[:, 0].view(np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "key", "digest"])

    return docs.select(id_column, text_column).mapInArrow(run, f"id {kind}, n bigint, key binary, digest bigint")


def _first_sets(
    batches: Iterator[pa.RecordBatch], n: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(digest, size, n-gram) of the first of equal sets in a task."""
    seen: set[bytes] = set()
    for batch in batches:
        for block in blocks(batch.column(0), fold=True):
            rows, hashes = ngram_sets(block, n)
            sizes, digests = np.bincount(rows, minlength=len(block)), _digests(rows, hashes, len(block))
            fresh = np.zeros(len(block), dtype=bool)
            for i, key in enumerate(d.tobytes() for d in digests):
                if key not in seen:
                    seen.add(key)
                    fresh[i] = True
            use = fresh[rows]
            rows = rows[use]
            yield digests[rows, 0].view(np.int64), sizes[rows].astype(np.int32), hashes[use].view(np.int64)


def _held(texts: DataFrame, n: int) -> DataFrame:
    """(gram, held): n-grams of more than one set.

    A task counts about COUNTED n-grams together, so frequent ones are few rows;
    Spark's own counting before the shuffle would sort all the rare ones on disk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def counted() -> pa.RecordBatch:
            grams, times = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(times.astype(np.int64))], names=["gram", "n"])

        for _, _, grams in _first_sets(batches, n):
            waiting.append(grams)
            size += len(grams)
            if size >= COUNTED:
                yield counted()
                waiting, size = [], 0
        if waiting:
            yield counted()

    counts = texts.mapInArrow(run, "gram bigint, n bigint").repartition("gram")
    return counts.groupBy("gram").agg(F.sum("n").alias("held")).where("held > 1")


def _shared_ngrams(texts: DataFrame, n: int, held: DataFrame) -> DataFrame:
    """(digest, size, gram): the n-grams of all sets, but for such as the table of marks shows to be in no other."""
    bit = F.col("gram").bitwiseAND(MARK_BITS - 1)
    words = held.select(F.shiftright(bit, 6).alias("word"), F.expr("shiftleft(1L, cast(gram & 63 as int))").alias("mark"))
    found = words.groupBy("word").agg(F.bit_or("mark").alias("marks")).toArrow()
    marks = np.zeros(MARK_BITS >> 6, dtype=np.uint64)
    marks[found["word"].to_numpy()] = found["marks"].to_numpy().view(np.uint64)
    shared = texts.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _first_sets(batches, n):
            bits = columns[2].view(np.uint64) & np.uint64(MARK_BITS - 1)
            use = (shared.value[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1) == 1
            yield pa.RecordBatch.from_arrays([pa.array(c[use]) for c in columns], names=["digest", "size", "gram"])

    return texts.mapInArrow(run, "digest bigint, size int, gram bigint")


def _ordered_sets(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(digest, size, path): sets of which enough n-grams are in other sets too; these, in the global order.

    An n-gram travels with its set's digest and size alone, which its neighbours have too.
    """
    held = written(_held(texts, n), "held")
    ngrams = _shared_ngrams(texts, n, held)
    rank = F.shiftleft(F.lit(_MOST_HELD) - F.least("held", F.lit(_MOST_HELD)), int(_HASH_BITS)).bitwiseOR(F.col("gram"))
    known = ngrams.join(held, "gram").select("digest", "size", rank.alias("rank"))
    # equal sets of several tasks come together here
    sets = known.groupBy("digest", "size").agg(F.sort_array(F.collect_set("rank")).alias("path"))
    sets = written(sets.where(100 * F.size("path") >= percent * F.col("size")), "sets")
    discard(held)
    return sets


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(part, rep): hashes of each set's rarest n-grams, one of which it shares with all that it links with.

    An n-gram counts once in the own size class and once in the next, so only
    sets of similar size meet.
    """
    kind = sets.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = SizeClasses(percent)
        for batch in batches:
            size, paths = batch.column(1).to_numpy(), batch.column(2)
            ends = paths.offsets.to_numpy().astype(np.int64)
            length = np.diff(ends)
            # so many n-grams of the whole set, less those that no other set has
            take = size - (percent * size + 99) // 100 + 1 - (size - length)
            first = ends[1:] - take
            before = np.cumsum(take) - take
            at = np.repeat(first - before, take) + np.arange(take.sum())
            ranks = paths.values.to_numpy()[at].view(np.uint64)
            row = np.repeat(np.arange(len(batch)), take)
            own = classes.of(size)[row].astype(np.uint64)
            for which in (own, own + np.uint64(1)):
                part = mix(ranks ^ mix(which))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part.view(np.int64)), batch.column(0).take(pa.array(row))], names=["part", "rep"]
                )

    return sets.select("id", "size", "path").mapInArrow(run, f"part bigint, rep {kind}")


def tree_links(ids: list, sets: list[np.ndarray], sizes: list[int], percent: int, groups: list | None = None) -> list[tuple]:
    """A spanning forest of the links among some sets, found by walking their prefix tree.

    A set is given by its n-grams in the global order, without those that no other
    set has, and by its whole size. With ``groups``, only links between sets of
    different groups count.
    """
    m = len(sets)
    if m < 2:
        return []
    grams, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(s) for s in sets])
    ordered = [at[e - len(s) : e] for s, e in zip(sets, ends)]
    order = sorted(range(m), key=lambda i: ordered[i].astype(">u4").tobytes())
    paths = [ordered[i] for i in order]
    names = [ids[i] for i in order]
    full = np.array([sizes[i] for i in order], dtype=np.int64)
    size = np.array([len(p) for p in paths])
    group = np.unique([groups[i] for i in order], return_inverse=True)[1] if groups is not None else np.arange(m)
    shared = np.zeros(m, dtype=np.int64)  # with the path before
    for i in range(1, m):
        k = min(size[i - 1], size[i])
        unequal = paths[i - 1][:k] != paths[i][:k]
        shared[i] = np.argmax(unequal) if unequal.any() else k
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    step = max(1, PROBE_BYTES // len(grams))
    for first in range(0, m, step):
        probes = np.arange(first, min(m, first + step))
        has = np.zeros((len(probes), len(grams)), dtype=bool)
        for j, p in enumerate(probes):
            has[j, paths[p]] = True
        keys = np.concatenate([paths[p] + j * len(grams) for j, p in enumerate(probes)])
        begins = np.concatenate([[0], np.cumsum(size[probes])])
        # a node: the paths low..high-1, which share their first ``depth`` n-grams; probes still there and their overlap
        stack = [(0, m, 0, np.arange(len(probes)), np.zeros(len(probes), dtype=np.int64))]
        while stack:
            low, high, depth, alive, overlap = stack.pop()
            single = high - low == 1
            to = size[low] if single else shared[low + 1 : high].min()
            edge = paths[low][depth:to]
            keep = probes[alive] > low  # each pair once
            if groups is not None and (group[low:high] == group[low]).all():
                keep &= group[probes[alive]] != group[low]
            alive, overlap = alive[keep], overlap[keep]
            if not len(alive):
                continue
            own = full[probes[alive]]
            rest = size[probes[alive]]
            if len(edge):
                overlap = overlap + has[np.ix_(alive, edge)].sum(axis=1)
                rest = rest - (np.searchsorted(keys, alive * len(grams) + edge[-1], side="right") - begins[alive])
            least, most = full[low:high].min(), full[low:high].max()
            reach = overlap + np.minimum(size[low:high].max() - to, rest)
            keep = ((100 + percent) * reach >= percent * (own + least)) & (100 * most >= percent * own)
            keep &= 100 * own >= percent * least
            alive, overlap = alive[keep], overlap[keep]
            if single:
                for p in probes[alive]:
                    a, b = find(int(p)), find(low)
                    if a != b and names[p] != names[low]:
                        root[max(a, b)] = min(a, b)
                        out.append((names[p], names[low]))
            elif len(alive):
                cuts = [low, *(low + 1 + np.flatnonzero(shared[low + 1 : high] == to)), high]
                stack += [(a, b, int(to), alive, overlap) for a, b in zip(cuts[:-1], cuts[1:])]
    return out


def _block_links(rows: DataFrame, keys: list[str], percent: int, grouped: bool) -> DataFrame:
    """(a, b): links inside each block of (keys, id, size, path[, comp]), a stream of sorted blocks per task."""
    kind = rows.schema["id"].dataType.simpleString()
    width = len(keys)

    def links(block: list[tuple]) -> list[tuple]:
        ids, sizes, paths, *comps = zip(*(r[width:] for r in block)) if block else ((), (), ())
        return tree_links(list(ids), list(paths), list(sizes), percent, list(comps[0]) if grouped and block else None)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, block = None, []
        for frame in frames:
            found = []
            for r in frame.itertuples(index=False, name=None):
                if r[:width] != key:
                    found += links(block)
                    key, block = r[:width], []
                block.append(r)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])
        if found := links(block):
            yield pd.DataFrame(found, columns=["a", "b"])

    columns = [*keys, "id", "size", "path", *(["comp"] if grouped else [])]
    dealt = rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, f"a {kind}, b {kind}")


def _joined_parts(parts: DataFrame) -> DataFrame:
    """(lead, rep): each set with the smallest one that has the same part; these join all that share it."""
    leaders = parts.groupBy("part").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last")
    return parts.join(leaders, "part").where("rep > lead").select("lead", "rep").distinct()


def _across(rows: DataFrame) -> DataFrame:
    """(cluster, x, y, id, comp): pairs of bounded blocks in which all rows of different components meet.

    Only the rest, what is not in a cluster's largest component, is dealt to
    several blocks: to each block of the largest component (x >= 0), and of the
    rest (x < 0). While the rest is one block, that is linear in the cluster.
    """
    half = BLOCK_NGRAMS / 2
    loads = rows.groupBy("cluster", "comp").agg(F.sum("size").alias("load"))
    totals = loads.groupBy("cluster").agg(
        F.max_by("comp", F.struct("load", "comp")).alias("main"),
        (F.max("load") / half + 1).cast("long").alias("mains"),
        ((F.sum("load") - F.max("load")) / half + 1).cast("long").alias("rests"),
    )
    dealt = rows.join(totals, "cluster")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("comp") == F.col("main"), F.col("mains")).otherwise(F.col("rests")))
    dealt = dealt.withColumn("mine", mine)
    place = lambda x, y: F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    of_main = F.transform(upto("rests"), lambda y: place(F.col("mine"), y))
    of_rest = F.concat(
        F.transform(upto("mains"), lambda x: place(x, F.col("mine"))),
        F.transform(upto("rests"), lambda k: place(-1 - F.least(k, F.col("mine")), F.greatest(k, F.col("mine")))),
    )
    places = F.explode(F.when(F.col("comp") == F.col("main"), of_main).otherwise(of_rest)).alias("at")
    return dealt.select("cluster", places, F.col("rep").alias("id"), "comp").select("cluster", "at.x", "at.y", "id", "comp")


def _links_across(
    parts: DataFrame, clusters: DataFrame, several: DataFrame, found: DataFrame, sets: DataFrame, percent: int
) -> DataFrame:
    """(a, b): links between components of clusters of several blocks, of sets that share a part."""
    comp = F.coalesce("component", "rep").alias("comp")
    known = clusters.join(several.select("cluster"), "cluster", "left_semi")
    known = known.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "size", "cluster", comp)
    known = written(known, "large-clusters")
    shared = parts.join(known.select("rep", "comp"), "rep")
    split = shared.groupBy("part").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    again = known.join(shared.join(split, "part", "left_semi").select("rep").distinct(), "rep", "left_semi")
    again = written(again, "split-clusters")
    blocks_of_sets = _across(again).join(sets, "id")
    return written(_block_links(blocks_of_sets, ["cluster", "x", "y"], percent, grouped=True), "more-links")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = NGRAM, percent: int = PERCENT
) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    rows = written(_names(docs, id_column, text_column, n), "set-digests")
    classes = rows.where("n > 0 and id is not null").groupBy("key").agg(
        F.min("id").alias("rep"), F.max("n").alias("size"), F.max("digest").alias("digest")
    )
    classes = written(classes, "classes")
    members = rows.where("n > 0 and id is not null").select("id", "key").join(classes, "key").select("id", "rep", "size")
    members = written(members, "members")

    ordered = _ordered_sets(docs.where(F.col(id_column).isNotNull()).select(text_column), n, percent)
    named = ordered.join(classes.select(F.col("rep").alias("id"), "digest", "size"), ["digest", "size"])
    sets = written(named.select("id", F.col("size").cast("long").alias("size"), "path"), "class-sets")
    discard(ordered)

    # sets that share prefix n-grams, directly or over others, are a cluster
    prefixes = written(_prefixes(sets, percent), "prefixes")
    near = written(_joined_parts(prefixes), "near")
    clusters = written(components(near.select(F.col("rep").alias("a"), F.col("lead").alias("b"))), "clusters")
    discard(near)
    sizes = members.groupBy("rep").agg(F.max("size").alias("size"))
    clusters = clusters.withColumnsRenamed({"node": "rep", "component": "cluster"}).join(sizes, "rep")
    load = clusters.groupBy("cluster").agg((F.sum("size") / BLOCK_NGRAMS + 1).cast("long").alias("blocks"))
    load = written(load, "cluster-loads")
    placed = clusters.join(load, "cluster").select(
        "cluster", F.pmod(F.xxhash64("rep"), "blocks").alias("block"), F.col("rep").alias("id")
    )
    several = load.where("blocks > 1")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    placed = placed.unionByName(several.select("cluster", each, F.col("cluster").alias("id")))
    links = written(_block_links(placed.join(sets, "id"), ["cluster", "block"], percent, grouped=False), "links")

    # rows that share an id but not the set: their classes are one
    same_id = members.groupBy("id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where("a <> b").select("a", "b")
    links = links.unionByName(same_id)
    found = components(links)

    if not several.isEmpty():
        more = _links_across(prefixes, clusters, several, found, sets, percent)
        if not more.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    by_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = by_class.select("key", F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", "n", "key").join(by_class, "key", "left")
    alone = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), alone).alias("component_id")
    )


def keep_one(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = NGRAM, percent: int = PERCENT
) -> DataFrame:
    """One row for each component: the row with its smallest id. Rows without an id all stay."""
    found = written(near_duplicates(docs, id_column, text_column, n, percent), "components")
    gone = found.where(f"`{id_column}` <> component_id").select(F.col(id_column).alias("_id")).distinct()
    repeated = found.where(f"`{id_column}` is not null").groupBy(F.col(id_column).alias("_id")).count().where("count > 1")
    same = F.col(id_column) == F.col("_id")
    first = docs.join(written(gone, "copies"), same, "left_anti")
    repeated = written(repeated.select("_id"), "repeated")
    once = first.join(repeated, same, "left_semi").dropDuplicates([id_column])
    return first.join(repeated, same, "left_anti").unionByName(once)
