"""What conversations share: a prefix trie of their turns, packed as double arrays.

A conversation is a sequence of turns (role, text). Each distinct sequence of
first turns is a node; its members are the conversations that start with it.

1. Turns become digests, so texts are never shuffled; the digests of a
   conversation, in order, are one record. Equal sequences become one, with the
   number and the smallest of their ids.
2. Distinct sequences are sorted over the whole table and cut into shards of at
   most ``SHARD_TURNS`` turns each (a longer sequence is a shard of its own), so
   a prefix that most conversations share is dealt to many shards.
3. A shard numbers its turns densely and packs its trie into a BASE and a CHECK
   array: from state ``s`` turn ``c`` leads to ``BASE[s] + c`` if CHECK names
   ``s`` there. Its sequences are walked through the arrays to count members.
4. Only nodes on the paths of a shard's first and last sequence can also lie in
   other shards. These upper nodes are added up over all shards by a digest of
   their turns; the sums over their subtrees take about log2(depth) rounds of
   joins. All other nodes are complete in their shard.

The digest of the members that end at a node needs their ids in one order, as
SHA-256 is sequential: sorted ids stream through it, none is held back.

Edge cases: rows without an id belong to no conversation; a null role or text
counts as empty; turns are ordered by number (null first), then role, then
digest, so repeated rows are repeated turns; a conversation without turns is a
member of the root alone; without conversations there is no node, not even the
root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.tables import written

#: Turns of a shard, about; a shard's trie is held in memory.
SHARD_TURNS = 1 << 16
#: Slots tried for a state's children before the arrays grow.
TRIES = 64

TURNS = "array<struct<digest: binary, chars: int>>"
ROOT = bytes(16)
NO_MEMBERS = hashlib.sha256(b"").hexdigest()

_NODES = {
    "conv_id": pa.int64(),
    "depth": pa.int64(),
    "parent_conv_id": pa.int64(),
    "n_convs": pa.int64(),
    "n_children": pa.int64(),
    "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(),
    "ends_sha256": pa.string(),
    "chars": pa.int64(),  # code points of the last text
    "key": pa.binary(),  # of upper nodes
    "parent_key": pa.binary(),  # of nodes below upper nodes
}
_SCHEMA = ", ".join(f"{n} {({pa.int64(): 'bigint', pa.string(): 'string'}).get(t, 'binary')}" for n, t in _NODES.items())


def sequences(
    turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text"
) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as digests and lengths."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_column, text_column))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    turn = F.struct(
        F.col(turn_column).alias("at"), role.alias("role"), digest.alias("digest"), F.length(text).alias("chars")
    )
    rows = turns.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("conv_id"), turn.alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    plain = F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars")))
    return rows.groupBy("conv_id").agg(plain.cast(TURNS).alias("turns"))


class DoubleArray:
    """A trie of sorted distinct sequences of ids from 1 on, as BASE and CHECK; state 0 is the root.

    Equal prefixes must be neighbours. States are made parents first.
    """

    def __init__(self, paths: list[np.ndarray], n_ids: int):
        self.base = np.zeros(n_ids + 2, dtype=np.int64)
        self.check = np.full(n_ids + 2, -1, dtype=np.int64)
        self.check[0] = 0
        self.order = [0]
        self._free = 1
        todo = [(0, 0, len(paths), 0)]
        for state, low, high, depth in todo:  # grows while it is read: breadth first
            while low < high and len(paths[low]) == depth:
                low += 1
            if low == high:
                continue
            codes = np.array([p[depth] for p in paths[low:high]], dtype=np.int64)
            cuts = np.concatenate([[0], 1 + np.flatnonzero(codes[1:] != codes[:-1]), [high - low]])
            first = codes[cuts[:-1]]
            base = self._place(first)
            self.base[state] = base
            self.check[base + first] = state
            for code, a, b in zip(first.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                self.order.append(base + code)
                todo.append((base + code, low + a, low + b, depth + 1))

    def _place(self, codes: np.ndarray) -> int:
        """A base at which the slots of all codes are free."""
        least = int(codes.min())
        while self._free < len(self.check) and self.check[self._free] >= 0:
            self._free += 1
        slots = self._free + np.flatnonzero(self.check[self._free : self._free + 4 * TRIES] < 0)[:TRIES]
        for slot in (slots - least).tolist():
            wanted = slot + codes
            inside = wanted[wanted < len(self.check)]
            if (self.check[inside] < 0).all():
                break
        else:
            slot = len(self.check) - least
        need = slot + int(codes.max()) + 1
        if need > len(self.check):
            more = max(need, 2 * len(self.check)) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, dtype=np.int64))
            self.check = np.append(self.check, np.full(more, -1, dtype=np.int64))
        return slot

    def step(self, state: int, code: int) -> int:
        """The state after ``code``, -1 if there is none."""
        to = int(self.base[state]) + code
        return to if 0 < to < len(self.check) and self.check[to] == state else -1

    def walk(self, path: np.ndarray) -> list[int]:
        """The states from the root along a path, as far as it is known."""
        states = [0]
        for code in path.tolist():
            to = self.step(states[-1], code)
            if to < 0:
                break
            states.append(to)
        return states


def shard_nodes(paths: list[np.ndarray], chars: list[np.ndarray], n: list[int], ids: list[int], ends: list[str]) -> dict[str, list]:
    """Columns of ``_NODES``: the nodes of a shard's distinct sequences of digests."""
    flat = np.concatenate(paths)
    digests, dense = np.unique(flat, axis=0, return_inverse=True)
    dense = dense.reshape(-1)
    # numbered level by level, so that a state's children have ids close together and the arrays few gaps
    level = np.lexsort((np.arange(len(dense)), np.concatenate([np.arange(len(p)) for p in paths])))
    number = np.empty(len(digests), dtype=np.int64)
    number[np.argsort(np.unique(dense[level], return_index=True)[1])] = np.arange(1, len(digests) + 1)
    dense = number[dense]
    cuts = np.cumsum([len(p) for p in paths])[:-1]
    coded = np.split(dense, cuts)
    trie = DoubleArray(coded, len(digests))
    size = len(trie.check)
    depth, length, members = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    smallest = np.full(size, np.iinfo(np.int64).max)
    ending: dict[int, str] = {}
    keys: dict[int, bytes] = {}
    for i, path in enumerate(coded):
        states = trie.walk(path)
        members[states] += n[i]
        smallest[states] = np.minimum(smallest[states], ids[i])
        depth[states] = np.arange(len(states))
        length[states[1:]] = chars[i]
        ending[states[-1]] = ends[i]
        if i in (0, len(coded) - 1):
            keys[0] = ROOT
            for above, state, digest in zip(states, states[1:], paths[i]):
                keys[state] = hashlib.blake2b(keys[above] + digest.tobytes(), digest_size=16).digest()

    children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    out: dict[str, list] = {name: [] for name in _NODES}
    for state in reversed(trie.order):  # children first
        above, upper = int(trie.check[state]), state in keys
        if not upper:
            leaves[state] += children[state] == 0
            saved[state] += (members[state] - 1) * length[state]
            children[above] += 1
            leaves[above] += leaves[state]
            saved[above] += saved[state]
        hidden = state == 0 or above in keys
        row = (
            int(smallest[state]),
            int(depth[state]),
            None if hidden else int(smallest[above]),
            int(members[state]),
            int(children[state]),
            int(leaves[state]),
            int(saved[state]),
            ending.get(state),
            int(length[state]),
            keys.get(state),
            keys[above] if hidden and state else None,
        )
        for name, value in zip(out, row):
            out[name].append(value)
    return out


def _shards(batches: Iterator[pa.RecordBatch], shard_turns: int) -> Iterator[pa.RecordBatch]:
    """Sorted (turns, n, conv_id, ends) to nodes, shard by shard."""

    def nodes(shard: list[tuple]) -> pa.RecordBatch:
        columns = shard_nodes(*(list(c) for c in zip(*shard)))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) for c, t in _NODES.items()], names=list(_NODES))

    shard, load = [], 0
    for batch in batches:
        turns, n, ids, ends = batch.columns
        offsets = turns.offsets.to_numpy()
        flat = turns.values
        digests = flat.field("digest").cast(pa.binary(16))
        digests = np.frombuffer(b"".join(digests.to_pylist()), dtype=np.uint64).reshape(-1, 2)
        chars = flat.field("chars").to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, *rest in zip(offsets[:-1], offsets[1:], n.to_pylist(), ids.to_pylist(), ends.to_pylist()):
            if shard and load + b - a > shard_turns:
                yield nodes(shard)
                shard, load = [], 0
            shard.append((digests[a:b], chars[a:b], *rest))
            load += b - a + 1
    if shard:
        yield nodes(shard)


def _end_digests(members: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of the sorted ids of each key, from a stream of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            keys, ends = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], names=["key", "ends"])

        for batch in batches:
            rows = []
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k == key:
                    digest.update(b",%d" % i)
                else:
                    if key is not None:
                        rows.append((key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(b"%d" % i)
            if rows:
                yield out(rows)
        if key is not None:
            yield out([(key, digest.hexdigest())])

    dealt = members.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    return dealt.mapInArrow(run, "key binary, ends string")


def _merged(parts: DataFrame) -> DataFrame:
    """The upper nodes, added up over all shards."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    same = [F.max(c).alias(c) for c in ("depth", "parent_key", "chars", "ends_sha256")]
    upper = parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), *same, *sums)
    below = upper.groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("_more"))
    upper = upper.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0)))
    return written(
        upper.withColumns(
            {
                "n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"),
                "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars"),
                "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_MEMBERS)),
            }
        ).drop("_more"),
        "trie-upper",
    )


def _subtree_sums(upper: DataFrame) -> DataFrame:
    """(key, n_leaves, saved_tokens) summed over the upper nodes below, by doubling steps towards the root.

    After k rounds a node has the sums of its subtree to a depth of 2**k - 1, and
    ``up`` is its ancestor 2**k levels above.
    """
    depth = upper.agg(F.max("depth")).first()[0] or 0
    now = upper.select("key", F.col("parent_key").alias("up"), "n_leaves", "saved_tokens")
    for _ in range(int(depth).bit_length()):
        add = now.where("up is not null").groupBy(F.col("up").alias("key"))
        add = add.agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        further = now.select(F.col("key").alias("up"), F.col("up").alias("_up"))
        now = now.join(add, "key", "left").join(further, "up", "left")
        now = now.select(
            "key",
            F.col("_up").alias("up"),
            (F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("_saved", F.lit(0))).alias("saved_tokens"),
        )
        now = written(now, "trie-sums")
    return now.drop("up")


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each node of the trie of (conv_id, turns); ids are distinct.

    conv_id (of the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens (over the subtree: members beyond the first, times the
    last text's code points), ends_sha256 (of the members with no further turn).
    """
    hexes = F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")
    members = written(conversations.select("conv_id", "turns", F.unhex(F.sha2(hexes, 256)).alias("key")), "trie-members")
    distinct = members.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    first = members.join(distinct, ["key", "conv_id"]).join(_end_digests(members), "key")
    ordered = written(first.select("turns", "n", "conv_id", "ends"), "trie-sequences").orderBy("turns")
    parts = written(ordered.mapInArrow(lambda batches: _shards(batches, shard_turns), _SCHEMA), "trie-nodes")

    upper = _merged(parts.where("key is not null"))
    upper = upper.drop("n_leaves", "saved_tokens").join(_subtree_sums(upper), "key").drop("key", "chars")
    nodes = parts.where("key is null").drop("key", "chars")
    nodes = nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)))
    above = parts.where("key is not null").groupBy(F.col("key").alias("parent_key")).agg(F.min("conv_id").alias("_above"))
    nodes = nodes.unionByName(upper, allowMissingColumns=True)
    below = nodes.where("parent_key is not null").join(above, "parent_key").withColumn("parent_conv_id", F.col("_above")).drop("_above")
    nodes = nodes.where("parent_key is null").unionByName(below)
    return nodes.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        "ends_sha256",
    )
