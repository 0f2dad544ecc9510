"""Nearest neighbours by inner product, with vantage-point trees.

Inner products become distances: a row x gets one more component ``sqrt(M*M - |x|**2)``,
where M is the greatest norm, and a query gets 0 there; the nearest row is then the one
with the largest product. A vantage point cuts the rows around it into an inner and an
outer half; by the triangle inequality a half farther than the best distances known so
far holds nothing better. ``factor`` relaxes that: a half goes as soon as its distance
times ``factor`` is above them. With 1 the search is exact.

A tree on a bounded sample deals rows to shards, so a shard holds rows near each other,
and each shard has a tree of its own. A query first searches its own shard. What it finds
bounds the search of the others, and those it rules out are never visited.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from waxgraph.llm.common import Scratch, parts_for, prepare
from waxgraph.llm.vector_codes import usable, usual_length

# Distinct vectors of a shard, and queries that meet it in one task, about.
SHARD_ROWS, BLOCK_QUERIES = 8192, 4096
# Distinct vectors, picked by a hash, that the dealing tree is fitted on.
SAMPLE = 4096
LEAF = 512
# Room for rounding in distances, as a share of the greatest norm, and in products.
ROOM, ROOM_SCORE = 1e-6, 1e-9


@dataclass
class Tree:
    """Nodes in lists: vantage point, radius, inner and outer child; a leaf has rows instead."""

    points: np.ndarray
    node: list = field(default_factory=list)

    def grow(self, rows: np.ndarray, leaf: int, depth: int = 64) -> int:
        place = len(self.node)
        self.node.append(None)
        # Of a few candidates the one whose distances vary most cuts best.
        far = None
        if len(rows) > leaf and depth:
            for candidate in rows[:: max(1, len(rows) // 4)][:4]:
                found = distances(self.points[candidate][None], self.points[rows])[0]
                if far is None or found.std() > far.std():
                    centre, far = candidate, found
            radius = np.median(far)
            inner = far <= radius
            if inner.all():
                far = None
        if far is None:
            self.node[place] = rows
        else:
            self.node[place] = (
                int(centre), float(radius), self.grow(rows[inner], leaf, depth - 1), self.grow(rows[~inner], leaf, depth - 1)
            )
        return place


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Rows with their additional component."""
    rest = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(axis=1), 0))
    return np.c_[vectors, rest]


def flat(vectors: np.ndarray) -> np.ndarray:
    """Queries with theirs."""
    return np.c_[vectors, np.zeros(len(vectors))]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in turn, added up from the first component to the last."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T):
        total += x * y
    return total


class Best:
    """The best ``k`` rows of each query so far: exact product first, then the smallest id."""

    def __init__(self, queries: np.ndarray, bounds: np.ndarray, k: int, norm: float, first_ids: np.ndarray):
        self.queries, self.k, self.norm, self.first_ids = queries, k, norm, first_ids
        self.squares = (queries * queries).sum(axis=1)
        self.score = np.full((len(queries), k), -np.inf)
        self.row = np.full((len(queries), k), -1)
        self.bound = bounds.copy()

    def reach(self, some: np.ndarray) -> np.ndarray:
        """Distance beyond which there is nothing better for these queries."""
        square = self.squares[some] + self.norm * self.norm - 2 * self.bound[some]
        return np.where(np.isinf(square), np.inf, np.sqrt(np.maximum(square, 0)))

    def take(self, some: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        """Look at all ``rows`` for the queries ``some``."""
        rough = self.queries[some] @ vectors[rows].T
        room = ROOM_SCORE * self.norm * np.sqrt(self.squares[some])
        least = self.bound[some]
        if len(rows) > self.k:
            least = np.maximum(least, np.partition(rough, -self.k, axis=1)[:, -self.k] - room)
        q, r = np.nonzero(rough >= (least - room)[:, None])
        if not len(q):
            return
        exact = products(self.queries[some[q]], vectors[rows[r]])
        met = np.unique(q)
        old_q, old_slot = np.nonzero(self.row[some[met]] >= 0)
        q = np.r_[met[old_q], q]
        score = np.r_[self.score[some[met[old_q]], old_slot], exact]
        row = np.r_[self.row[some[met[old_q]], old_slot], rows[r]]
        order = np.lexsort((self.first_ids[row], -score, q))
        q, score, row = q[order], score[order], row[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        slot = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        kept = slot < self.k
        q, slot = some[q[kept]], slot[kept]
        self.score[q, slot], self.row[q, slot] = score[kept], row[kept]
        self.bound[some[met]] = np.maximum(self.bound[some[met]], self.score[some[met], -1])


def search(tree: Tree, vectors: np.ndarray, best: Best, factor: float) -> None:
    """Depth first, nearer half first, all queries that go the same way together."""
    queries, room = flat(best.queries), ROOM * best.norm
    todo = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
    while todo:
        place, some, apart = todo.pop()
        alive = apart * factor <= best.reach(some) + room
        some, apart = some[alive], apart[alive]
        if not len(some):
            continue
        node = tree.node[place]
        if not isinstance(node, tuple):
            best.take(some, node, vectors)
            continue
        centre, radius, inner, outer = node
        far = distances(queries[some], tree.points[centre][None])[:, 0]
        near = far <= radius
        to_inner, to_outer = np.maximum(apart, far - radius), np.maximum(apart, radius - far)
        # The last one on the list comes first.
        todo += [
            (outer, some[near], to_outer[near]), (inner, some[~near], to_inner[~near]),
            (outer, some[~near], to_outer[~near]), (inner, some[near], to_inner[near]),
        ]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    flat_values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat_values.reshape(len(column), -1)


def _leaf_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    """Leaf that each point falls into."""
    where = np.zeros(len(points), np.int64)
    todo = [(0, np.arange(len(points)))]
    while todo:
        place, some = todo.pop()
        node = tree.node[place]
        if not isinstance(node, tuple):
            where[some] = place
        elif len(some):
            centre, radius, inner, outer = node
            near = distances(points[some], tree.points[centre][None])[:, 0] <= radius
            todo += [(inner, some[near]), (outer, some[~near])]
    return where


def _leaves_apart(tree: Tree, queries: np.ndarray) -> dict[int, np.ndarray]:
    """The least distance between each query and the rows of each leaf."""
    found, todo = {}, [(0, np.zeros(len(queries)))]
    while todo:
        place, apart = todo.pop()
        node = tree.node[place]
        if not isinstance(node, tuple):
            found[place] = apart
            continue
        centre, radius, inner, outer = node
        far = distances(queries, tree.points[centre][None])[:, 0]
        todo += [(inner, np.maximum(apart, far - radius)), (outer, np.maximum(apart, radius - far))]
    return found


def _dealt(tree: Tree, norm: float, names: list[str]):
    def rows(batches):
        for batch in batches:
            leaf = _leaf_of(tree, lifted(_matrix(batch["vector"]), norm))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], names=names)

    return rows


def _visits(tree: Tree, norm: float, factor: float):
    """(pid, leaf) of the leaves that a query has to visit besides its own."""
    schema = pa.schema([("pid", pa.int64()), ("leaf", pa.int32())])

    def rows(batches):
        for batch in batches:
            vectors = _matrix(batch["vector"])
            if not len(vectors):
                continue
            own, pid = batch["leaf"].to_numpy(), batch["pid"].to_numpy()
            bound = batch["bound"].to_numpy(zero_copy_only=False)
            best = Best(vectors, bound, 1, norm, pid)
            reach = best.reach(np.arange(len(vectors))) + ROOM * norm
            for leaf, apart in _leaves_apart(tree, flat(vectors)).items():
                goes = (own != leaf) & (apart * factor <= reach)
                some = pid[goes]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), leaf, np.int32))], schema=schema)

    return rows


def _searched(norm: float, k: int, factor: float):
    schema = pa.schema([("pid", pa.int64()), ("row", pa.int64()), ("score", pa.float64())])

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        # One and the same tree and order, whatever the order the rows came in.
        left = left.sort_by("pid")
        vectors, pid = _matrix(left["vector"]), left["pid"].to_numpy()
        tree = Tree(lifted(vectors, norm))
        tree.grow(np.arange(len(vectors)), LEAF)
        best = Best(_matrix(right["vector"]), right["bound"].to_numpy(), k, norm, left["first_id"].to_numpy())
        search(tree, vectors, best, factor)
        query, slot = np.nonzero((best.row >= 0) & (best.score >= right["bound"].to_numpy()[:, None]))
        return pa.table(
            [right["pid"].to_numpy()[query], pid[best.row[query, slot]], best.score[query, slot]], schema=schema
        )

    return rows


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    factor: float = 1.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product for each query.

    ``queries`` are rows of ``vectors``; all other rows are candidates. Best first, ties to
    the smaller id; with fewer than ``k`` other rows all of them. The score is the sum of
    products of the components in double precision, from the first to the last.

    Rows whose vector is null, empty, zero or not all finite, or has not the usual length
    (the most frequent one, the greater of equally frequent ones), and rows without an id
    take no part. Repeats of an id with one vector are one row. An id with several vectors
    is a row for each, and a query for each. Components beyond about 1e150, whose squares
    are not finite, are not supported.

    Equal vectors are one point that keeps its first ``k + 1`` ids: no more can be asked for.
    A shard holds about ``SHARD_ROWS`` points; one that gets more is split by a hash.
    """
    spark = prepare(vectors.sparkSession)
    scratch = Scratch(spark)

    def rows_of(frame: DataFrame) -> DataFrame:
        zero = F.forall("vector", lambda x: x == 0)
        picked = frame.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
        return picked.where(usable(F.col("vector")) & ~zero & F.col("id").isNotNull())

    rows = rows_of(vectors)
    dims = usual_length(rows, "vector")
    # Zeros of either sign are one number, also as parts of a key.
    plain = F.transform("vector", lambda x: x + F.lit(0.0))
    rows = rows.where(F.size("vector") == dims).select("id", plain.alias("vector")).distinct()
    asked = rows_of(queries).where(F.size("vector") == dims).select("id", plain.alias("vector")).distinct()
    order = Window.partitionBy("vector").orderBy("id")
    first = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    points = scratch.keep(
        first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
            F.monotonically_increasing_id().alias("pid"), "vector", "ids", F.col("ids")[0].alias("first_id")
        )
    )
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    whole = points.agg(F.count("*").alias("n"), F.max(square).alias("square")).first()
    # Who asks for which point.
    asking = scratch.keep(asked.join(points.select("pid", "vector"), "vector").select(F.col("id").alias("query_id"), "pid"))
    if not whole["n"]:
        return asking.select("query_id", F.lit(0).alias("rank"), F.col("pid").alias("vec_id"), F.lit(0.0).alias("score"))

    # A hair more than the greatest norm, so that no root is of a negative number.
    norm = float(np.sqrt(whole["square"]) * (1 + 1e-12))
    sample = points.orderBy(F.xxhash64("vector"), "pid").limit(SAMPLE).select("vector").collect()
    tree = Tree(lifted(np.array([row["vector"] for row in sample]), norm))
    tree.grow(np.arange(len(sample)), max(8, SAMPLE * SHARD_ROWS // max(whole["n"], 1)) if whole["n"] > SHARD_ROWS else SAMPLE)
    # Shards are leaves; their sample rows are not needed again.
    tree.node = [n if isinstance(n, tuple) else None for n in tree.node]

    names = [*points.columns, "leaf"]
    dealt = scratch.keep(
        points.mapInArrow(_dealt(tree, norm, names), "pid long, vector array<double>, ids array<long>, first_id long, leaf int")
    )
    # Few rows: the tree has no more leaves than the sample has rows.
    counts = {row["leaf"]: row["count"] for row in dealt.groupBy("leaf").count().collect()}
    salts = spark.createDataFrame(
        [(leaf, parts_for(n, SHARD_ROWS)) for leaf, n in counts.items()], "leaf int, salts int"
    )
    asked_points = asking.select("pid").distinct()
    wanting = scratch.keep(dealt.join(asked_points, "pid", "left_semi").select("pid", "vector", "leaf"))
    blocks = parts_for(wanting.count(), BLOCK_QUERIES)

    shards = dealt.join(F.broadcast(salts), "leaf").select(
        "pid", "vector", "first_id", "leaf", (F.abs(F.xxhash64("pid")) % F.col("salts")).cast("int").alias("salt"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
    )

    def searched(visits: DataFrame) -> DataFrame:
        """``visits``: pid, vector, bound, leaf."""
        spread = visits.join(F.broadcast(salts), "leaf").select(
            "pid", "vector", "bound", "leaf", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
            F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int").alias("block"),
        )
        keys = ["leaf", "salt", "block"]
        return shards.groupBy(keys).cogroup(spread.groupBy(keys)).applyInArrow(
            _searched(norm, k + 1, factor), "pid long, row long, score double"
        )

    home = scratch.keep(searched(wanting.withColumn("bound", F.lit(float("-inf")))))
    # The last of k + 1 points is a bound for whatever else there is.
    by_score = Window.partitionBy("pid").orderBy(F.desc("score"), "row")
    bounds = home.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k + 1).select("pid", F.col("score").alias("bound"))
    bounded = scratch.keep(
        wanting.join(bounds, "pid", "left").select("pid", "vector", "leaf", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
    )
    found = home
    if len(counts) > 1:
        others = bounded.mapInArrow(_visits(tree, norm, factor), "pid long, leaf int")
        visits = others.join(bounded.drop("leaf"), "pid")
        found = home.union(scratch.keep(searched(visits)))
    return _ranked(scratch, found, points, asking, k)


def _ranked(scratch: Scratch, found: DataFrame, points: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """Ids of the points found, the best ``k + 1`` of each query point, handed to all who ask for it."""
    some = found.join(points.select(F.col("pid").alias("row"), "first_id"), "row")
    by_first = Window.partitionBy("pid").orderBy(F.desc("score"), "first_id")
    some = some.withColumn("n", F.row_number().over(by_first)).where(F.col("n") <= k + 1).drop("n", "first_id")
    ids = some.join(points.select(F.col("pid").alias("row"), "ids"), "row").select("pid", "row", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("pid").orderBy(F.desc("score"), "vec_id")
    best = scratch.keep(ids.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1).drop("n"))
    # Of k + 1 at most one is the query's own.
    answers = best.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "row"))).alias("best"))
    own = F.filter("best", lambda x: ~((x["vec_id"] == F.col("query_id")) & (x["row"] == F.col("pid"))))
    listed = asking.join(scratch.keep(answers), "pid").select("query_id", F.posexplode(F.slice(own, 1, k)).alias("n", "x"))
    return listed.select(
        "query_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score")
    )
