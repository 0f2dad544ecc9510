"""Near copies by SimHash and an exact check of the shingles' similarity, and MinHash for the rest.

A text is its set of hashed word shingles. Texts whose SimHash fingerprints of these differ
in up to ``RADIUS`` bits are candidates, found by ``simhash.links``. At the similarity asked
for, two fingerprints differ in some ten bits, so that most pairs near the border are not
among them. Each text also gets ``BANDS`` keys of ``ROWS`` minima; two texts of similarity s share a key with probability ``1 - (1 - s**ROWS)**BANDS``
(0.99993 at 0.8). Texts that share one are candidates, and only those whose sets really
have the similarity are linked. Equal sets are one node, so copies cost nothing.

In a bucket of many texts each is compared with one of them. Texts that are then still in
different components meet by their rarest shingles: sets of the similarity share one
among the first few of each in any common order (prefix filter), and texts of one
template that differ otherwise share none there. So no bucket is compared in pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from waxgraph.llm import simhash
from waxgraph.llm.common import Scratch, prepare
from waxgraph.llm.components import components

SEED = 42
BANDS, ROWS = 24, 5
# Bits in which fingerprints of candidates differ at most.
RADIUS = 2
# Similarity from which texts are near copies, as a fraction: no rounding at the border.
SIMILARITY = (4, 5)
# Buckets with more nodes are tied to one of them first, see ``links``.
CROWD = 16
# Up to so many ids of eight bytes go to every task; more of them meet the texts by a shuffle.
BROADCAST_IDS = 1 << 20

_RNG = np.random.default_rng(SEED)
_SEEDS, _FACTORS = _RNG.integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[0], [1]], np.uint64)
_MIX = _RNG.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text of fewer words is one shingle, no words are none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) > size else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for start in range(0, len(hashes), 4096):
        part = hashes[start : start + 4096, None]
        least = np.minimum(least, ((part ^ _SEEDS) * _FACTORS).min(axis=0))
    least ^= least >> np.uint64(31)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def set_digest(hashes: np.ndarray) -> bytes:
    """Equal sets have equal digests; of 128 bits, for a shorter one would join unlike texts of a large corpus."""
    return xxhash.xxh3_128_digest(hashes.tobytes(), SEED)


def _described(schema: pa.Schema, size: int):
    def rows(batches):
        for batch in batches:
            sets = [shingles(t or "", size) for t in batch["shingled"].to_pylist()]
            columns = [
                *batch.columns[:-1],
                pa.array(map(set_digest, sets), pa.binary()),
                pa.array(map(len, sets), pa.int32()),
                pa.array(map(band_keys, sets), pa.list_(pa.int64())),
                pa.array(np.array([simhash.folded(s) for s in sets], np.uint64).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema)

    return rows


def _sets(size: int):
    schema = pa.schema([("node", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def rows(batches):
        for batch in batches:
            sets = [shingles(t or "", size).view(np.int64) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, schema.field(1).type)], schema=schema)

    return rows


def _few(ids: DataFrame) -> DataFrame:
    """A stored table of ids, marked to go to every task if it is small."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _confirmed(scratch: Scratch, pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Those of the pairs ``a, b`` whose shingle sets have the similarity."""
    part, whole = similarity
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b")), "b")
    )
    equal = F.size(F.array_intersect("of_a", "of_b"))
    return scratch.keep(both.where(equal * (part + whole) >= (F.size("of_a") + F.size("of_b")) * part).select("a", "b"))


def _alike(a, b, similarity: tuple[int, int]):
    """Whether sets of these sizes can have the similarity."""
    part, whole = similarity
    return F.least(a, b) * whole >= F.greatest(a, b) * part


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _by_rare_shingles(scratch: Scratch, placed: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Pairs ``a, b`` of ``placed`` (node, root) of different roots that share a rare shingle.

    Shingles are ordered by how many of these sets have them. Sets x and y of similarity s
    have ``s * |x|`` shingles in common at least, so they share one among the first
    ``|x| - ceil(s * |x|) + 1`` of x and as many of y.
    """
    part, whole = similarity
    grams = placed.join(sets, "node").select("node", "root", F.size("hashes").alias("size"), F.explode("hashes").alias("gram"))
    often = scratch.keep(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    # A shingle that one set has alone matches nothing, but takes its place in the order.
    ranked = grams.join(often, "gram", "left").withColumn(
        "place", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("n", F.lit(1)), "gram"))
    )
    first = F.col("size") - F.ceil(F.col("size") * F.lit(part) / F.lit(whole)) + 1
    prefix = scratch.keep(ranked.where((F.col("place") <= first) & F.col("n").isNotNull()).select("gram", "node", "root", "size"))
    other = prefix.select("gram", *(F.col(c).alias(f"other_{c}") for c in ("node", "root", "size")))
    met = prefix.join(other, "gram").where(
        (F.col("node") < F.col("other_node")) & (F.col("root") != F.col("other_root"))
        & _alike(F.col("size"), F.col("other_size"), similarity)
    )
    found = scratch.keep(_ordered(met.select(F.col("node").alias("a"), F.col("other_node").alias("b"))))
    scratch.drop(often, prefix)
    return found


def _by_fingerprints(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of nodes with near fingerprints: each with the least node of its own, and those with each other."""
    prints = scratch.keep(nodes.groupBy("fingerprint").agg(F.min("node").alias("least")))
    same = nodes.join(prints, "fingerprint").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    close = simhash.links(scratch, prints, RADIUS)
    for end in ("a", "b"):
        least = prints.select(F.col("fingerprint").alias(end), F.col("least").alias(f"of_{end}"))
        close = close.join(least, end)
    found = scratch.keep(same.union(close.select("of_a", "of_b")))
    scratch.drop(prints)
    return found


def links(
    scratch: Scratch, nodes: DataFrame, rows: DataFrame, size: int, similarity: tuple[int, int] = SIMILARITY
) -> DataFrame:
    """``node, root`` of all ``nodes`` (``node, size, bands, fingerprint``) that are near copies of others.

    ``rows`` has the texts (node, text); those of nodes that share a bucket are read once.
    Of buckets with up to ``CROWD`` nodes all pairs are looked at. In larger ones every
    node is compared with one of them first; what is then in different components is
    compared by rare shingles, so the components are those of all pairs that share a bucket.
    """
    hashed = nodes.select("node", "size", F.posexplode("bands").alias("band", "key")).select(
        F.xxhash64("band", "key").alias("bucket"), "node", "size"
    )
    # Another node in every bucket, so that one odd node does not stand for all.
    centre = F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), "node", "size")).alias("centre")
    sizes = scratch.keep(hashed.groupBy("bucket").agg(F.count("*").alias("n"), centre).where("n > 1"))
    met = scratch.keep(hashed.join(sizes, "bucket"))

    near = F.filter(
        "near", lambda x: (x["node"] > F.col("x.node")) & _alike(x["size"], F.col("x.size"), similarity)
    )
    small = (
        met.where(F.col("n") <= CROWD)
        .groupBy("bucket").agg(F.collect_list(F.struct("node", "size")).alias("near"))
        .select(F.explode("near").alias("x"), "near")
        .select(F.col("x.node").alias("a"), F.explode(near).alias("y"))
        .select("a", F.col("y.node").alias("b"))
    )
    stars = (
        met.where(F.col("n") > CROWD)
        .where((F.col("node") != F.col("centre.node")) & _alike(F.col("size"), F.col("centre.size"), similarity))
        .select(F.col("node").alias("a"), F.col("centre.node").alias("b"))
    )
    close = _by_fingerprints(scratch, nodes)
    pairs = scratch.keep(_ordered(close.union(small).union(stars)))
    crowded = scratch.keep(met.where(F.col("n") > CROWD).select("bucket", "node"))
    paired = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    asked = scratch.keep(paired.union(crowded.select("node")).distinct())
    scratch.drop(sizes, met, close)
    sets = scratch.keep(rows.join(_few(asked), "node").select("node", "text").mapInArrow(_sets(size), "node long, hashes array<long>"))
    found = _confirmed(scratch, pairs, sets, similarity)
    roots = scratch.keep(components(scratch, found))
    placed = scratch.keep(crowded.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")))
    split = placed.groupBy("bucket").agg((F.min("root") != F.max("root")).alias("split")).where("split").select("bucket")
    apart = scratch.keep(placed.join(split, "bucket", "left_semi").select("node", "root").distinct())
    if not apart.isEmpty():
        rare = _by_rare_shingles(scratch, apart, sets, similarity)
        more = rare.join(pairs, ["a", "b"], "left_anti")
        every = scratch.keep(found.union(_confirmed(scratch, more, sets, similarity)))
        scratch.drop(roots, rare)
        roots = scratch.keep(components(scratch, every))
        scratch.drop(every)
    scratch.drop(pairs, crowded, asked, sets, found, placed, apart)
    return roots


def first_of_each(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 5,
    similarity: tuple[int, int] = SIMILARITY,
) -> DataFrame:
    """One row of ``docs`` for each component of near copies, all columns as they were.

    Rows are judged one by one, whatever their ids. Of a component the row with the
    smallest id stays, a null id comes after all others, and of equal ids the first row
    in the order of the input's partitions. Null texts and texts without words are one
    component. An empty table gives an empty result.

    The rows are stored once with their sketches. Texts are read again for candidates
    only, and rows are met by the ids of those that go; both are far fewer than all.
    """
    scratch = Scratch(prepare(docs.sparkSession))
    fields = docs.schema.fields
    plain = docs.select(
        *(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)),
        F.monotonically_increasing_id().alias("uid"),
        F.col(f"`{text_column}`").alias("shingled"),
    )
    schema = T.StructType([
        *plain.schema.fields[:-1],
        T.StructField("digest", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())),
        T.StructField("fingerprint", T.LongType()),
    ])
    rows = scratch.keep(plain.mapInArrow(_described(schema.names, shingle), schema))
    place = {f.name: F.col(f"c{i}") for i, f in enumerate(fields)}
    number = place[id_column].cast("long")
    order = F.struct(number.isNull().alias("none"), number.alias("id"), F.col("uid").alias("uid"))
    # Copies give way to the first of them before any sketch is shuffled; its uid stands for all.
    best = scratch.keep(rows.groupBy("digest").agg(F.min(order).alias("best")).select("best", F.col("best.uid").alias("node")))
    nodes = rows.select(F.col("uid").alias("node"), "size", "bands", "fingerprint").join(best.select("node"), "node", "left_semi")
    texts = rows.select(F.col("uid").alias("node"), place[text_column].alias("text"))
    roots = links(scratch, nodes, texts, shingle, similarity)
    kept = (
        best.join(roots, "node", "left")
        .groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    )
    winners = scratch.keep(kept.select(F.col("best.uid").alias("uid")))
    losers = scratch.keep(rows.select("uid").join(winners, "uid", "left_anti"))
    scratch.drop(best, roots, winners)
    return rows.join(_few(losers), "uid", "left_anti").select(*(F.col(f"c{i}").alias(f.name) for i, f in enumerate(fields)))
