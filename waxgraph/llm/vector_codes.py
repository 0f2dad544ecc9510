"""Vector codes of a few bytes: product quantisation in whole numbers.

A vector's components become integers and are cut into equal parts; each part has a
codebook, and a code names the nearest entry of each. Distances are those of integer
Walsh-Hadamard transforms, in order of sequency: the transform of a part padded with
zeros to ``n`` components (a power of two) keeps squared distances but for the factor
``n``, so squared differences are added up coefficient by coefficient, and an entry is
out as soon as its sum is above a full distance already known. No floating point.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from waxgraph.llm.common import Scratch, prepare

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 256
# Share of entries still in from which all are carried on together.
DENSE = 0.2
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Compressed:
    """``rows``: id, label, code, error, label_error. ``codebooks``: part, entry, component."""

    rows: DataFrame
    codebooks: list[list[list[int]]]

    def digest(self) -> str:
        """SHA-256 of all components in order, in decimal, with commas."""
        numbers = (str(x) for book in self.codebooks for entry in book for x in entry)
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def usual_length(vectors: DataFrame, column: str) -> int:
    """The most frequent length, the greatest of equally frequent ones; 0 without vectors."""
    sizes = vectors.groupBy(F.size(column).alias("size")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return first["size"] if first else 0


def sequency(n: int) -> np.ndarray:
    """Order in which the rows of the Hadamard matrix of size ``n`` change sign more and more often."""
    signs = np.ones((1, 1), np.int8)
    while len(signs) < n:
        signs = np.block([[signs, signs], [signs, -signs]])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


def transform(parts: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Coefficients of each row, in columns by sequency; rows are padded with zeros to a power of two."""
    rows, width = parts.shape
    n = 1 << (width - 1).bit_length()
    out = np.zeros((rows, n), kind)
    out[:, :width] = parts
    step = 1
    while step < n:
        pairs = out.reshape(rows, n // (2 * step), 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, n)
        step *= 2
    return out[:, sequency(n)]


def number_kind(most: int, width: int) -> np.dtype:
    """The smallest integers in which no sum can overflow, for components up to ``most`` in size."""
    n = 1 << (width - 1).bit_length()
    bound = 4 * n * n * most * most
    return np.dtype(np.int32) if bound < 1 << 31 else np.dtype(np.int64) if bound < 1 << 63 else np.dtype(object)


def nearest_entries(coefficients: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance (times ``n``) of each row's nearest entry; ties go to the lower index."""
    rows, n = coefficients.shape
    quarter = max(1, n // 4)
    total = np.zeros((rows, len(entries)), coefficients.dtype)
    done, every = 0, np.arange(rows)
    while True:
        for j in range(done, min(done + quarter, n)):
            apart = coefficients[:, j, None] - entries[None, :, j]
            apart *= apart
            total += apart
        done = min(done + quarter, n)
        if done == n:
            best = total.argmin(axis=1)
            return best, total[every, best]
        # The full distance to any entry is a bound; the one that leads so far is a good one.
        leader = total.argmin(axis=1)
        bound = ((coefficients - entries[leader]) ** 2).sum(axis=1)
        row, entry = np.nonzero(total <= bound[:, None])
        if len(row) <= DENSE * total.size:
            break
    left = total[row, entry]
    while done < n:
        upto = min(done + quarter, n)
        left = left + ((coefficients[row, done:upto] - entries[entry, done:upto]) ** 2).sum(axis=1)
        done = upto
        kept = left <= bound[row]
        row, entry, left = row[kept], entry[kept], left[kept]
    # Rows are in order and each has one entry at least, the leader; entries ascend.
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(left, starts)
    hits = np.flatnonzero(left == np.repeat(least, np.diff(np.r_[starts, len(row)])))
    first = hits[np.r_[True, row[hits][1:] != row[hits][:-1]]]
    return entry[first], left[first]


class _Coder:
    """Assigns the parts of vectors to entries; goes to the workers with the codebooks."""

    def __init__(self, books: list[list[list[int]]], most: int):
        self.width = len(books[0][0])
        self.kind = number_kind(most, self.width)
        self.books = [transform(np.array(book, self.kind), self.kind) for book in books]
        self.scale = self.books[0].shape[1]

    def matrices(self, column: pa.ListArray):
        flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.width * len(self.books))
        for start in range(0, len(flat), BLOCK):
            yield flat[start : start + BLOCK].astype(self.kind)

    def assign(self, matrix: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Entry of each part, and the squared distances summed over the parts."""
        codes, error = [], np.zeros(len(matrix), object if self.kind == object else np.int64)
        for p, entries in enumerate(self.books):
            part = transform(matrix[:, p * self.width : (p + 1) * self.width], self.kind)
            best, far = nearest_entries(part, entries)
            codes.append(best)
            error = error + far // self.scale
        return np.array(codes).T, error


def _sums_schema(width: int) -> pa.Schema:
    wide = pa.decimal128(38, 0)
    return pa.schema(
        [("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64())] + [(f"s{i}", wide) for i in range(width)]
    )


def _sums(coder: _Coder):
    """What the vectors of a task add to each entry: one row for each entry used."""
    schema = _sums_schema(coder.width)

    def rows(batches):
        parts, size = len(coder.books), len(coder.books[0])
        count = np.zeros((parts, size), np.int64)
        total = np.zeros((parts, size, coder.width), object)
        for batch in batches:
            for matrix in coder.matrices(batch["ints"]):
                codes, _ = coder.assign(matrix)
                for p in range(parts):
                    order = np.argsort(codes[:, p], kind="stable")
                    used, starts = np.unique(codes[order, p], return_index=True)
                    part = matrix[order, p * coder.width : (p + 1) * coder.width]
                    part = part if coder.kind == object else part.astype(np.int64)
                    total[p, used] += np.add.reduceat(part, starts, axis=0)
                    count[p, used] += np.diff(np.r_[starts, len(order)])
        part, entry = np.nonzero(count)
        sums = total[part, entry]
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry], pa.int64())]
        columns += [pa.array(map(Decimal, map(int, sums[:, i])), schema.field(3 + i).type) for i in range(coder.width)]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return rows


def _coded(coder: _Coder, names: list[str]):
    def rows(batches):
        for batch in batches:
            codes, errors = [], []
            for matrix in coder.matrices(batch["ints"]):
                found, error = coder.assign(matrix)
                codes += ["".join(f"{x:02x}" for x in row) for row in found.tolist()]
                errors += [x if x <= LONG else None for x in error.tolist()]
            columns = [*batch.columns[:-1], pa.array(codes, pa.string()), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows


def compress(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> Compressed:
    """Codes of all usable vectors, with the codebooks they refer to.

    A component x is the integer ``floor(scale * x)``, the nearest long where that is
    none. A codebook starts as the parts of the first ``entries`` vectors by id (null ids
    last, ties by the components); a round moves every entry to the floor of the mean of
    its parts, and one without parts stays. Vectors that are null or empty, hold a
    component that is null or not finite, or have not the usual length (the most frequent
    one, the greater of equally frequent ones) have no code. Repeated rows count each.

    ``error`` is the squared distance to the entries in all, ``label_error`` its sum over
    rows of one label, null labels together; null where it is beyond a long. The usual
    length must be a multiple of ``parts``. An empty table gives no rows and no codebooks.
    Only codebooks, of a fixed size, pass through the driver.
    """
    spark = prepare(vectors.sparkSession)
    scratch = Scratch(spark)
    kept = vectors.where(usable(F.col(vector_column)))
    dims = usual_length(kept, vector_column)
    if dims % parts:
        raise ValueError(f"{dims} components cannot be cut into {parts} equal parts")
    width = dims // parts
    whole = F.transform(F.col(vector_column), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    table = scratch.keep(
        kept.where(F.size(vector_column) == dims).select(
            F.col(id_column).alias("id"), F.col(label_column).alias("label"), whole.alias("ints")
        )
    )
    first = table.orderBy(F.col("id").asc_nulls_last(), "ints").limit(entries).collect()
    if not first:
        empty = table.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return Compressed(empty.withColumn("label_error", F.col("error")), [])
    books = [[list(row["ints"][p * width : (p + 1) * width]) for row in first] for p in range(parts)]
    size = F.greatest(F.array_max("ints").cast("decimal(38,0)"), -F.array_min("ints").cast("decimal(38,0)"))
    most = int(table.agg(F.max(size)).first()[0])

    schema = ", ".join(["part int", "entry int", "n long"] + [f"s{i} decimal(38,0)" for i in range(width)])
    for _ in range(rounds):
        partial = table.select("ints").mapInArrow(_sums(_Coder(books, most)), schema)
        moved = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(width)))
        for row in moved.collect():
            books[row["part"]][row["entry"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]

    found = table.select("id", "label", "ints")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields[:-1]] + ["code string", "error long"]
    coded = scratch.keep(
        found.mapInArrow(_coded(_Coder(books, most), ["id", "label", "code", "error"]), ", ".join(fields))
    )
    # Nulls would not be missed in a sum, so they are counted.
    sums = scratch.keep(
        coded.groupBy("label").agg(
            F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error")).alias("label_error")
        ).withColumnRenamed("label", "of")
    )
    rows = coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return Compressed(rows, books)
