"""Exact top-k in Hamming distance by incremental multi-index hashing.

A code of 64 bits is cut into segments, and each segment is an index of its own. Codes
within distance ``m(r+1) - 1`` of a query, for ``m`` segments, equal it in one of them up
to ``r`` bits. So the search radius grows until enough neighbours lie within the distance
that the radius covers; only queries that lack neighbours go on to the next one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from waxgraph.llm.common import Scratch, prepare

BITS = 64
# Probes in one batch.
PROBES = 1 << 16
_PROBES = pa.schema([("query", pa.int64()), ("segment", pa.int32()), ("value", pa.int64())])


def sign_codes(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``id, code``: bit i of the code is one where component i is above zero.

    Vectors that are null or have not 64 components, and rows without an id, have no code.
    """
    bits = F.transform(F.col(vector_column), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(0))
    return (
        vectors.where((F.size(vector_column) == BITS) & F.col(id_column).isNotNull())
        .select(F.col(id_column).cast("long").alias("id"), F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).alias("code"))
    )


def segments_for(codes: int) -> list[tuple[int, int]]:
    """Offset and width of each segment; about as wide as the logarithm of the number of codes.

    So a value of a segment has about one code, however many codes there are, up to two
    segments of half a code.
    """
    wide = min(BITS // 2, max(4, round(math.log2(max(codes, 2)))))
    count = math.ceil(BITS / wide)
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _values(code, segments):
    return F.array(*(
        F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned(code, offset).bitwiseAND((1 << width) - 1).alias("value"))
        for i, (offset, width) in enumerate(segments)
    ))


def _flips(width: int, radius: int) -> Iterator[np.ndarray]:
    """Masks of exactly ``radius`` of ``width`` bits, some at a time."""
    masks = (sum(1 << b for b in bits) for bits in combinations(range(width), radius))
    while some := list(islice(masks, PROBES)):
        yield np.array(some, np.int64)


def _probes(segments: list[tuple[int, int]], radius: int):
    """Values of each segment that differ from the query's in exactly ``radius`` bits."""

    def rows(batches):
        for batch in batches:
            queries = batch["query"].to_numpy()
            for i, (offset, width) in enumerate(segments):
                own = (queries.view(np.uint64) >> np.uint64(offset)).astype(np.int64) & ((1 << width) - 1)
                for masks in _flips(width, radius):
                    each = max(1, PROBES // len(masks))
                    for start in range(0, len(queries), each):
                        some = queries[start : start + each]
                        values = (own[start : start + each, None] ^ masks).ravel()
                        yield pa.RecordBatch.from_arrays(
                            [np.repeat(some, len(masks)), np.full(len(values), i, np.int32), values], schema=_PROBES
                        )

    return rows


def nearest(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, place, id, distance``: the ``k`` nearest other rows of each query.

    Both inputs have ``id, code``, a query is itself a row of ``codes`` or not; rows with
    its id are left out. Ties go to the smaller id. With fewer than ``k`` other rows all
    of them are returned. Rows that repeat an id with other codes count each; repeats of
    one id and code are one row.
    """
    spark = prepare(codes.sparkSession)
    scratch = Scratch(spark)
    # Of a code that very many ids have, k + 1 are all that can be returned.
    order = Window.partitionBy("code").orderBy("id")
    single = codes.select("code", "id").distinct()
    holders = scratch.keep(single.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("code", "id"))
    # Each id counts at its first code only: no sum over codes exceeds the ids they have.
    counted = holders.groupBy("id").agg(F.min("code").alias("code")).groupBy("code").agg(F.count("*").alias("held"))
    distinct = scratch.keep(
        holders.select("code").distinct().join(counted, "code", "left").select("code", F.coalesce("held", F.lit(0)).alias("held"))
    )
    segments = segments_for(distinct.count())
    index = scratch.keep(
        distinct.select("code", "held", F.explode(_values(F.col("code"), segments)).alias("s")).select("code", "held", "s.*")
    )
    asked = scratch.keep(queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct())
    active = scratch.keep(asked.select("query").distinct())
    widest = max(width for _, width in segments)
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).cast("int")
    # Ids at smaller distances: with more than k of them a code holds nothing better.
    nearer = F.sum("held").over(Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1))
    met, found = None, []
    for radius in range(widest + 1):
        covered = len(segments) * (radius + 1) - 1 if radius < widest else BITS
        # Probes grow with the radius, whatever Spark thinks of their size: both sides are sorted.
        probes = active.mapInArrow(_probes(segments, radius), "query long, segment int, value long").hint("merge")
        near = probes.join(index, ["segment", "value"]).select("query", "code", "held", distance.alias("distance"))
        # What earlier radii met is kept: a probe is sent once.
        near = near.union(met.select(*near.columns).join(active, "query", "left_semi")) if met is not None else near
        near = near.repartition("query").groupBy("query", "code").agg(*(F.first(c).alias(c) for c in ("held", "distance")))
        nearest_few = near.withColumn("nearer", nearer).where(F.coalesce("nearer", F.lit(0)) <= k).drop("nearer")
        before, met = met, scratch.keep(nearest_few)
        # Of more than k ids, one at most is the query's own.
        covers = met.where(F.col("distance") <= covered)
        enough = covers.groupBy("query").agg(F.sum("held").alias("held")).where(F.col("held") > k).select("query")
        done = scratch.keep(enough if radius < widest else active)
        found.append(scratch.keep(met.where(F.col("distance") <= covered).join(done, "query", "left_semi").select("query", "code", "distance")))
        left = scratch.keep(active.join(done, "query", "left_anti"))
        scratch.drop(active, done, *([before] if before is not None else []))
        active = left
        if active.isEmpty():
            break
    scratch.drop(active, met, index)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    pairs = every.join(holders, "code").join(asked, "query").where("id <> query_id").select("query_id", "id", "distance").distinct()
    ranked = Window.partitionBy("query_id").orderBy("distance", "id")
    return pairs.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k).select(
        "query_id", "place", "id", "distance"
    )
