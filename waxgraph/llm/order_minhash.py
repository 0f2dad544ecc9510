"""Order MinHash: document fingerprints that follow the edit distance.

The k-mers of a text are numbered by occurrence, so that repeats count. Each of the hash
functions picks the two numbered k-mers with the smallest values, puts them in the order
they have in the text, and hashes the pair to 16 bits. Two texts are alike as far as
their fingerprints agree, place by place.

Comparing a document with the next one needs the order of all documents: they are dealt
by ranges of ids, each task walks through its own range, and the seams between tasks
are closed afterwards from the first and last document of each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waxgraph.llm.common import Scratch, batch_of, parts_for, prepare, texts

LENGTH = 5
PLACES = 64
# Bytes of text in a range, and k-mers hashed at once.
RANGE_BYTES = 16 << 20
BLOCK = 8192

_random = np.random.default_rng(2019)
_SEEDS = _random.integers(0, 1 << 32, PLACES, np.uint32)[:, None]
_FACTORS = (_random.integers(0, 1 << 32, PLACES, np.uint32) | np.uint32(1))[:, None]
_TOP = np.uint32(0xFFFFFFFF)

_FIELDS = [
    ("doc_id", pa.int64(), "long"),
    ("n_chars", pa.int64(), "long"),
    ("edited_sha256", pa.string(), "string"),
    ("fingerprint", pa.binary(), "binary"),
    ("edited_fingerprint", pa.binary(), "binary"),
    ("near_edited", pa.float64(), "double"),
    ("near_next", pa.float64(), "double"),
    # Seams: the first (0) or last (1) text of a range, else null.
    ("part", pa.int32(), "int"),
    ("seam", pa.int32(), "int"),
    ("text", pa.string(), "string"),
]
_OUT = pa.schema([(name, kind) for name, kind, _ in _FIELDS])
_DDL = ", ".join(f"{name} {kind}" for name, _, kind in _FIELDS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def numbered_kmers(text: str, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the occurrence-numbered k-mers, and their places; a shorter text is one k-mer."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(points):
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    count = max(1, len(points) - length + 1)
    hashed = np.zeros(count, np.uint64)
    for i in range(min(length, len(points))):
        hashed = _mix(hashed * np.uint64(0x100000001B3) + points[i : i + count] + np.uint64(1))
    keyed = np.sort(hashed >> np.uint64(32) << np.uint64(32) | np.arange(count, dtype=np.uint64))
    kmers, places = keyed >> np.uint64(32), (keyed & np.uint64(_TOP)).astype(np.int64)
    at = np.arange(count)
    new = np.append(True, kmers[1:] != kmers[:-1])
    occurrence = at - np.maximum.accumulate(np.where(new, at, 0))
    return (_mix(kmers << np.uint64(24) ^ _mix(occurrence.astype(np.uint64))) & np.uint64(_TOP)).astype(np.uint32), places


def _two_least(kmers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash function the columns of its smallest and second smallest value."""
    rows = np.arange(PLACES)[:, None]
    chosen = []
    for start in range(0, len(kmers), BLOCK):
        values = (kmers[None, start : start + BLOCK] ^ _SEEDS) * _FACTORS
        one = values.argmin(axis=1)[:, None]
        values[rows, one] = _TOP
        chosen += [one + start, values.argmin(axis=1)[:, None] + start]
    chosen = np.concatenate(chosen, axis=1)
    values = (kmers[chosen] ^ _SEEDS) * _FACTORS
    one = values.argmin(axis=1)[:, None]
    first = chosen[rows, one]
    values[chosen == first] = _TOP
    return first[:, 0], chosen[rows, values.argmin(axis=1)[:, None]][:, 0]


def fingerprint(text: str) -> np.ndarray:
    """16-bit entries; zeros for an empty text."""
    kmers, places = numbered_kmers(text)
    if not len(kmers):
        return np.zeros(PLACES, np.uint16)
    a, b = _two_least(kmers)
    swap = places[a] > places[b]
    first, second = kmers[np.where(swap, b, a)].astype(np.uint64), kmers[np.where(swap, a, b)].astype(np.uint64)
    return (_mix(first << np.uint64(32) | second) & np.uint64(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """A text whose last third is replaced by the start of the next one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def _result(doc_id, text, own, following, following_own):
    changed = edited(text, following)
    other = fingerprint(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(text), digest, own.tobytes(), other.tobytes(), likeness(own, other), likeness(own, following_own))


def _walk(batches):
    before = part = None
    out = []
    for batch in batches:
        for doc_id, text, part in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "part"))):
            own = fingerprint(text)
            if before is None:
                out.append((None, None, None, own.tobytes(), None, None, None, part, 0, text))
            else:
                out.append((*_result(*before, text, own), part, None, None))
            before = doc_id, text, own
        if out:
            yield batch_of(_OUT, list(zip(*out)))
            out = []
    if before is not None:
        doc_id, text, own = before
        yield batch_of(_OUT, list(zip((doc_id, None, None, own.tobytes(), None, None, None, part, 1, text))))


def _close(batches):
    for batch in batches:
        rows = zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "fingerprint", "following", "following_print")))
        out = [
            (*_result(doc_id, text, np.frombuffer(own, np.uint16), following, np.frombuffer(other, np.uint16)), None, None, None)
            for doc_id, text, own, following, other in rows
        ]
        if out:
            yield batch_of(_OUT, list(zip(*out)))


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how near they and the next text's are.

    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. The next document is the one with the next smaller id,
    after the smallest comes the largest; a lone document is its own next one. Rows with
    one id are ordered by a hash of their texts, then by the texts; null ids come last.
    Null texts count as empty. An empty table gives an empty result; further columns are
    not looked at.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark)
    plain = texts(docs, id_column, text_column)
    total = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    walked = scratch.keep(
        plain.repartitionByRange(parts_for(total, RANGE_BYTES), *order)
        .sortWithinPartitions(*order, "text")
        .withColumn("part", F.spark_partition_id())
        .mapInArrow(_walk, _DDL)
    )
    # One number for each range that has documents.
    parts = sorted(row.part for row in walked.where("seam = 1").select("part").collect())
    following = spark.createDataFrame(
        list(zip(parts, parts[1:] + parts[:1])), "part int, following_part int"
    )
    heads = walked.where("seam = 0").select(
        F.col("part").alias("following_part"), F.col("text").alias("following"), F.col("fingerprint").alias("following_print")
    )
    tails = walked.where("seam = 1").join(following, "part").join(heads, "following_part")
    closed = tails.select("doc_id", "text", "fingerprint", "following", "following_print").mapInArrow(_close, _DDL)
    return walked.where("seam is null").unionByName(closed).select(
        "doc_id", "n_chars", "edited_sha256",
        F.lower(F.hex("fingerprint")).alias("fingerprint"),
        F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )
