"""A trie of conversation prefixes, searched by vertical bitmaps.

Conversations are dealt to shards by ranges of their ids. A shard indexes (position, turn)
to a bitset of its conversations; a node's children are the intersections of its bitset
with the postings of the next position, found depth first, and popcounts and end lists
come with them. Nodes of different shards with the same turns are one node: they meet by
a digest of the whole prefix, chained from turn to turn.

What a node sums up over its subtree is a property of other nodes. Each of those has a
smallest member, which passes through all nodes above it; so its share is added in the
shard of that member only, along the subtrees there, and sums over shards are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from waxgraph.llm.common import Scratch, parts_for, prepare

# A shard is closed at so many conversations, or at so many turns.
SHARD_CONVS, SHARD_TURNS = 4096, 1 << 16
# Turns that a task reads, about, and those worth a task of their own.
TASK_TURNS, SPREAD_TURNS = 1 << 19, 1 << 14

_NODES = pa.schema(
    [
        ("shard", pa.string()), ("place", pa.int32()), ("last", pa.int32()), ("up", pa.int32()),
        ("key", pa.binary()), ("depth", pa.int32()), ("conv_id", pa.int64()), ("n_convs", pa.int64()),
        ("n_chars", pa.int64()), ("kids", pa.int32()), ("ends", pa.list_(pa.int64())),
    ]
)
_NODES_SQL = (
    "shard string, place int, last int, up int, key binary, depth int, conv_id long, n_convs long, "
    "n_chars long, kids int, ends array<long>"
)
ROOT = hashlib.sha256(b"root").digest()


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, pos, digest, n_chars``: turns numbered from 1 in each conversation.

    They go by turn number, null first; equal numbers by role, then text. A null role or
    text is empty. Rows without a conversation id are left out; repeated rows count each.
    """
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    digest = F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest")
    scratch = Scratch(prepare(conversations.sparkSession))
    # Texts are needed for the order of equal numbers only, so no others are shuffled.
    tied = scratch.keep(rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    if tied.isEmpty():
        placed = rows.select("conv_id", "turn", F.lit("").alias("role"), F.lit("").alias("tie"), digest, F.length("text").alias("n_chars"))
    else:
        tied = tied.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
        same = (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
        placed = rows.join(tied, same, "left").select(
            "conv_id", "turn", "role", F.when(F.col("c").isNotNull(), F.col("text")).alias("tie"), digest, F.length("text").alias("n_chars")
        )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "tie", "digest")
    return placed.select("conv_id", F.row_number().over(order).alias("pos"), "digest", F.col("n_chars").cast("long").alias("n_chars"))


def with_heads(numbered: DataFrame, head_of: Column, length: Column, most: int) -> DataFrame:
    """``conv_id, part, pos, digest, n_chars``: conversations that begin like others.

    ``numbered`` as ``turns`` gives it. A conversation's first ``length`` turns, at most
    ``most``, give way to those of conversation ``head_of``: all it has if fewer, none if
    it does not exist. Both are expressions of ``conv_id``. Each conversation has a row
    of part 0 without a turn, so that one without turns is one still.
    """
    convs = numbered.select("conv_id").distinct().select("conv_id", head_of.alias("head"), length.alias("h"))
    heads = numbered.where(F.col("pos") <= most).select(F.col("conv_id").alias("head"), "pos", "digest", "n_chars")
    borrowed = convs.where("h > 0").join(heads, "head").where("pos <= h")
    own = numbered.where(F.col("pos") > length)
    none = F.lit(None)
    marks = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("pos"), none.cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_chars"))
    return marks.union(borrowed.select("conv_id", F.lit(1), "pos", "digest", "n_chars")).union(
        own.select("conv_id", F.lit(2), "pos", "digest", "n_chars")
    )


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, list, list]]]:
    """Whole conversations (id, digests, lengths) in lists of a shard's size, out of sorted rows."""
    shard, held = [], 0
    for batch in batches:
        rows = zip(batch["conv_id"].to_pylist(), batch["digest"].to_pylist(), batch["n_chars"].to_pylist())
        for conv, digest, n_chars in rows:
            if not shard or shard[-1][0] != conv:
                if len(shard) >= SHARD_CONVS or held >= SHARD_TURNS:
                    yield shard
                    shard, held = [], 0
                shard.append((conv, [], []))
            if digest is not None:
                shard[-1][1].append(digest)
                shard[-1][2].append(n_chars)
                held += 1
    if shard:
        yield shard


def postings(shard: list[tuple[int, list, list]]) -> dict[tuple[int, bytes], int]:
    """The vertical index: (position, turn) to the bitset of conversations with that turn there."""
    members: dict[tuple[int, bytes], list[int]] = {}
    for bit, (_, digests, _) in enumerate(shard):
        for pos, digest in enumerate(digests):
            members.setdefault((pos, digest), []).append(bit)
    index = {}
    for key, bits in members.items():
        flags = np.zeros(bits[-1] + 1, np.uint8)
        flags[bits] = 1
        index[key] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
    return index


def bits_of(bitset: int) -> np.ndarray:
    """Numbers of the bits set, ascending."""
    raw = np.frombuffer(bitset.to_bytes((bitset.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def shard_nodes(shard: list[tuple[int, list, list]]) -> list[list]:
    """``[place, last, up, key, depth, conv_id, n_convs, n_chars, kids, ends]`` of each node, depth first.

    ``place`` numbers the nodes in the order they are met, a node's subtree are those up
    to ``last``, and ``up`` is the place of its parent (-1: none).
    """
    index = postings(shard)
    # Conversations that end at a depth, as a bitset: those among a node's members end there.
    ending: dict[int, int] = {}
    for bit, (_, digests, _) in enumerate(shard):
        ending[len(digests)] = ending.get(len(digests), 0) | 1 << bit
    found: list[list] = []
    todo = [((1 << len(shard)) - 1, 0, ROOT, -1)]
    while todo:
        members, depth, key, up = todo.pop()
        place = len(found)
        lowest = (members & -members).bit_length() - 1
        stop = members & ending.get(depth, 0)
        left = members ^ stop
        children = []
        while left:
            first = (left & -left).bit_length() - 1
            digest = shard[first][1][depth]
            child = left & index[depth, digest]
            left ^= child
            children.append((child, depth + 1, hashlib.sha256(key + digest).digest(), place))
        n_chars = shard[lowest][2][depth - 1] if depth else 0
        ends = [shard[bit][0] for bit in bits_of(stop).tolist()] if stop else []
        found.append([place, place, up, key, depth, shard[lowest][0], members.bit_count(), n_chars, len(children), ends])
        todo += reversed(children)
    for node in reversed(found):
        if node[2] >= 0:
            above = found[node[2]]
            above[1] = max(above[1], node[1])
    return found


def _local_nodes(batches):
    for shard in _shards(batches):
        nodes = shard_nodes(shard)
        name = f"{shard[0][0]}"
        for start in range(0, len(nodes), 1 << 14):
            some = nodes[start : start + (1 << 14)]
            columns = [pa.array([name] * len(some)), *map(pa.array, zip(*some))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _NODES)], schema=_NODES)


def _below(table: pa.Table) -> pa.Table:
    """Sums over the subtrees of one shard, from what each node adds in it, and parents' smallest members."""
    table = table.sort_by("place")
    last, up = table["last"].to_numpy(), table["up"].to_numpy()

    def summed(values) -> np.ndarray:
        total = np.r_[0, np.cumsum(values.to_numpy().astype(np.int64))]
        return total[last + 1] - total[:-1]

    leads = table["leads"].to_numpy(zero_copy_only=False).astype(np.int64)
    children = np.zeros(len(last), np.int64)
    np.add.at(children, up[up >= 0], leads[up >= 0])
    smallest = table["least"].to_numpy()
    return pa.table(
        {
            "key": table["key"].cast(pa.binary()),
            "parent_conv_id": pa.array(smallest[np.maximum(up, 0)], pa.int64(), mask=up < 0),
            "n_children": children,
            "n_leaves": summed(table["leaf"]),
            "saved_tokens": summed(table["saved"]),
        }
    )


def _ends_digests(batches):
    """One row for each node with ends: SHA-256 of their numbers, read in order of the shards."""
    schema = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])
    key, state = None, None
    for batch in batches:
        out = []
        for k, ends in zip(batch["key"].to_pylist(), batch["ends"].to_pylist()):
            text = ",".join(map(str, ends)).encode()
            if k != key:
                if state:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text)
            else:
                state.update(b"," + text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], schema=schema)


def build(rows: DataFrame) -> DataFrame:
    """``key, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``rows``: conv_id, part, pos, digest, n_chars, one with a null digest for each
    conversation at least, as ``with_heads`` gives them; turns go by part and pos. A node
    is a distinct sequence of first turns, from the root without any; ``key`` is its
    digest. It is named by its smallest member and depth. ``saved_tokens`` sums, over the
    node and those below, members but one times the characters of the last turn.
    ``ends_sha256`` is that of the members without further turns, ascending, in decimal
    with commas. No conversations give no nodes, not even a root.

    A task holds one shard: up to ``SHARD_CONVS`` conversations and ``SHARD_TURNS`` turns,
    or one conversation if that is longer.
    """
    spark = prepare(rows.sparkSession)
    scratch = Scratch(spark)
    rows = scratch.keep(rows)
    total = rows.count()
    # A small table is spread over the cores there are.
    tasks = max(parts_for(total, TASK_TURNS), min(spark.sparkContext.defaultParallelism, parts_for(total, SPREAD_TURNS)))
    dealt = rows.repartitionByRange(tasks, "conv_id").sortWithinPartitions("conv_id", "part", "pos")
    local = scratch.keep(dealt.select("conv_id", "digest", "n_chars").mapInArrow(_local_nodes, _NODES_SQL))

    merged = scratch.keep(
        local.groupBy("key").agg(
            F.min(F.struct("conv_id", "shard")).alias("first"),
            F.sum("n_convs").alias("n_convs"),
            F.first("depth").cast("long").alias("depth"),
            F.first("n_chars").alias("n_chars"),
            (F.sum("kids") == 0).cast("long").alias("leaf"),
        )
    )
    leads = (F.col("first.shard") == F.col("shard")).cast("long")
    shares = local.join(merged.select("key", "first", "leaf", F.col("n_convs").alias("all"), F.col("n_chars").alias("chars")), "key").select(
        "shard", "place", "last", "up", "key",
        F.col("first.conv_id").alias("least"),
        leads.alias("leads"),
        (leads * F.col("leaf")).alias("leaf"),
        (leads * (F.col("all") - 1) * F.col("chars")).alias("saved"),
    )
    below = shares.groupBy("shard").applyInArrow(
        _below, "key binary, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"
    )
    below = below.groupBy("key").agg(
        F.first("parent_conv_id").alias("parent_conv_id"),
        *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")),
    )
    # Shards are ranges of ids, so a node's lists follow each other in order of the shards.
    ends = local.where(F.size("ends") > 0).select("key", "conv_id", "ends")
    ends = ends.repartition("key").sortWithinPartitions("key", F.col("ends")[0])
    digests = ends.select("key", "ends").mapInArrow(_ends_digests, "key binary, ends_sha256 string")
    none = hashlib.sha256(b"").hexdigest()
    return merged.join(below, "key").join(digests, "key", "left").select(
        "key", F.col("first.conv_id").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
