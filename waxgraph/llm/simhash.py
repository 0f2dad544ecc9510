"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. Every bit gets a vector of ``radius + 1`` bits, and each
vector but zero defines a mask: the bits whose vectors have an odd product with it. Any
``radius`` differing bits leave one mask that holds none of them, so each pair within the
radius meets in a table, for sure and not just likely. Only distinct fingerprints are
hashed, so copies cost nothing.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from waxgraph.llm.common import Scratch, batch_of, prepare, texts
from waxgraph.llm.components import components

BITS = 64
SEED = 42
# Buckets with more fingerprints are linked over shared midpoints instead of in pairs.
CROWD = 64

_OUT = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])


def fingerprint(text: str, shingle: int) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; no words: zero."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: lower-cases A-Z, splits on \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) <= shingle:
        joined = [b" ".join(words)]
    else:
        joined = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return folded(np.array([digest(s, SEED) for s in joined], np.dtype("<u8")))


def folded(hashes: np.ndarray) -> int:
    """Unsigned fingerprint of 64-bit hashes: the bits that over half of them have; none: zero."""
    if not len(hashes):
        return 0
    hashes = np.ascontiguousarray(hashes, np.dtype("<u8"))
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.dtype("<u8"))[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fingerprint`` (long, the same 64 bits) for every row of ``doc_id, text``."""

    def rows(batches):
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], np.uint64).view(np.int64)
            yield batch_of(_OUT, [batch["doc_id"], found])

    return docs.mapInArrow(rows, "doc_id long, fingerprint long")


def masks(radius: int, seed: int = SEED) -> list[int]:
    """``2**(radius+1) - 1`` masks, one of which avoids any ``radius`` bits."""
    width = radius + 1
    vectors = [1 + i % (2**width - 1) for i in range(BITS)]
    random.Random(seed).shuffle(vectors)
    return [
        sum(1 << i for i, vector in enumerate(vectors) if (vector & mask).bit_count() % 2) for mask in range(1, 2**width)
    ]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def links(scratch: Scratch, prints: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` between distinct ``fingerprint`` values that differ in 1 to ``radius`` bits.

    Buckets of up to ``CROWD`` fingerprints give all their close pairs. In larger ones,
    fingerprints are tied to the smallest one around each midpoint, which yields the same
    components with a row per midpoint and no pairs; ``radius`` must be even for that.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    tables = F.array(*(
        F.struct(F.lit(i).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for i, m in enumerate(masks(radius))
    ))
    hashed = prints.select("fingerprint", F.explode(tables).alias("t")).select("fingerprint", "t.mask", "t.key")
    sizes = hashed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.keep(hashed.join(sizes, ["mask", "key"]))

    def close(x):
        return (x > F.col("a")) & (F.bit_count(x.bitwiseXOR(F.col("a"))) <= radius)

    pairs = (
        met.where(F.col("n") <= CROWD)
        .groupBy("mask", "key").agg(F.collect_list("fingerprint").alias("near"))
        .select(F.explode("near").alias("a"), "near")
        .select("a", F.explode(F.filter("near", close)).alias("b"))
    )

    flips = [0]
    for _ in range(radius // 2):
        flips = sorted({f ^ (1 << i) for f in flips for i in range(BITS)} | set(flips))
    centres = F.explode(F.array(*(F.col("fingerprint").bitwiseXOR(F.lit(_signed(f))) for f in flips)))
    around = (
        met.where(F.col("n") > CROWD).select("fingerprint").distinct().select("fingerprint", centres.alias("centre"))
    )
    least = around.groupBy("centre").agg(F.min("fingerprint").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = around.join(least, "centre").where("fingerprint <> b").select(F.col("fingerprint").alias("a"), "b")
    return pairs.union(stars)


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 3,
    radius: int = 2,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document.

    Documents link when their fingerprints differ in at most ``radius`` bits;
    ``component_id`` is the smallest id that can be reached, the document's own included.
    Null and empty texts have fingerprint zero and link like any other. A null id stays a
    row, is never a component id unless its component has no other. Repeated rows stay.
    An empty table gives an empty result; further columns are not looked at.
    """
    scratch = Scratch(prepare(docs.sparkSession))
    found = scratch.keep(fingerprints(texts(docs, id_column, text_column), shingle))
    classes = scratch.keep(found.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = scratch.keep(components(scratch, links(scratch, classes, radius)))
    linked = classes.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = linked.join(smallest, "root").select("fingerprint", "component_id")
    return found.join(ids, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
