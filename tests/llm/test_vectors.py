"""Vector codes and vantage-point search against brute force, and on awkward rows."""

import math
import random
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from waxgraph.llm import vantage, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def nearest_by_hand(parts, entries):
    """Lowest index of the least squared distance, in Python's whole numbers."""
    far = [[sum((int(x) - int(y)) ** 2 for x, y in zip(p, e)) for e in entries] for p in parts]
    return [min(range(len(entries)), key=lambda i: (row[i], i)) for row in far], [min(row) for row in far]


@pytest.mark.parametrize("width", [1, 3, 4, 16])
@pytest.mark.parametrize("most", [3, 1000, 1 << 25, 1 << 50])
def test_transform_finds_what_plain_distances_find(width, most):
    rng = random.Random(width * most)
    draw = lambda n: [[rng.randint(-most, most) for _ in range(width)] for _ in range(n)]
    entries, parts = draw(40), draw(60)
    parts += entries[:5] + [entries[7]] * 2
    entries += entries[:3]
    kind = vector_codes.number_kind(most, width)
    a = vector_codes.transform(np.array(parts, kind), kind)
    b = vector_codes.transform(np.array(entries, kind), kind)
    found, far = vector_codes.nearest_entries(a, b)
    want, least = nearest_by_hand(parts, entries)
    assert found.tolist() == want and [int(x) // a.shape[1] for x in far] == least


def test_sequency_order_and_scale():
    signs = vector_codes.transform(np.eye(8, dtype=np.int64), np.dtype(np.int64)).T
    assert [(row[1:] != row[:-1]).sum() for row in signs] == list(range(8))
    assert (signs @ signs.T == 8 * np.eye(8)).all()


def codes_by_hand(rows, parts, entries, rounds, scale=1024):
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(scale * x) for x in v] for _, v, _ in kept]
    width = len(ints[0]) // parts
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0] or 0, ints[j]))[:entries]
    books = [[ints[j][p * width : (p + 1) * width] for j in order] for p in range(parts)]
    cut = [[v[p * width : (p + 1) * width] for v in ints] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            codes, _ = nearest_by_hand(cut[p], books[p])
            for e in set(codes):
                own = [x for x, c in zip(cut[p], codes) if c == e]
                books[p][e] = [sum(column) // len(own) for column in zip(*own)]
    found = [nearest_by_hand(cut[p], books[p]) for p in range(parts)]
    errors = [sum(found[p][1][j] for p in range(parts)) for j in range(len(kept))]
    sums = {}
    for (_, _, label), error in zip(kept, errors):
        sums[label] = sums.get(label, 0) + error
    longs = lambda x: x if x <= vector_codes.LONG else None
    errors, sums = [longs(x) for x in errors], {label: longs(x) for label, x in sums.items()}
    return sorted((
        (str(i), "".join(f"{found[p][0][j]:02x}" for p in range(parts)), errors[j], sums[label])
        for j, (i, _, label) in enumerate(kept)
    ), key=str), books


@pytest.mark.parametrize("size", [1.0, 3e4, 1e9])
def test_codes_against_brute_force(make, size):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, size) for _ in range(12)], rng.choice([1, 2, None])) for i in range(150)]
    rows += [(None, rows[3][1], 1), (3, rows[4][1], 2), (3, rows[4][1], 2)]
    rows += [(500, None, 1), (501, [], 1), (502, [NAN] * 12, 1), (503, [1.0] * 11 + [INF], 2), (504, [None] + [0.5] * 11, 2), (505, [0.0] * 12, None)]
    frame = make(rows, SCHEMA).repartition(5)
    got = vector_codes.compress(frame.withColumns({"ints": F.lit(1), "code": F.lit("x"), "id": F.lit(2)}), parts=3, entries=8, rounds=3)
    want, books = codes_by_hand(rows, 3, 8, 3)
    assert got.codebooks == books
    assert sorted(((str(r.id), r.code, r.error, r.label_error) for r in got.rows.collect()), key=str) == want


def test_codes_of_odd_tables(make):
    assert vector_codes.compress(make([], SCHEMA)).rows.collect() == []
    assert vector_codes.compress(make([(1, None, 1), (2, [NAN] * 4, 1)], SCHEMA)).rows.collect() == []
    # The usual length decides; lengths that cannot be cut are refused.
    mixed = make([(1, [1.0] * 4, 1), (2, [2.0] * 4, 1), (3, [1.0] * 8, 1)], SCHEMA)
    assert {r.id for r in vector_codes.compress(mixed).rows.collect()} == {1, 2}
    with pytest.raises(ValueError):
        vector_codes.compress(make([(1, [1.0] * 5, 1)], SCHEMA))
    # Beyond a long: components are cut to it, errors are null.
    (row,) = [r for r in vector_codes.compress(make([(1, [1e300] * 4, 1), (2, [-1e300] * 4, 1)], SCHEMA), entries=1).rows.collect() if r.id == 1]
    assert row.code == "00000000" and row.error is None and row.label_error is None


def search_by_hand(rows, asked, k):
    kept = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    found = []
    for q, qv in (row for row in kept if asked(row[0])):
        score = lambda v: reduce(lambda total, ab: total + ab[0] * ab[1], zip(qv, v), 0.0)
        best = sorted(((-score(v), i) for i, v in kept if (i, v) != (q, qv)))[:k]
        found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(found)


def _rows(n, dims, seed, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims)) * 3
    return [(i, (centres[rng.integers(clusters)] + rng.normal(size=dims)).tolist(), 0) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_search_is_exact_with_factor_one(make, monkeypatch, small):
    if small:
        for name, value in {"SHARD_ROWS": 40, "BLOCK_QUERIES": 7, "SAMPLE": 64, "LEAF": 8}.items():
            monkeypatch.setattr(vantage, name, value)
    rows = _rows(400, 6, 1)
    rows += [(1000 + i, rows[0][1], 0) for i in range(30)] + [(900, [0.0] * 6, 0), (920, None, 0), (940, [NAN] * 6, 0), (None, rows[1][1], 0)]
    rows += [(960, [1.0] * 5 + [INF], 0), (20, rows[20][1], 0), (20, rows[5][1], 0), (980, [], 0), (40, [0.5] * 4, 0)]
    frame = make(rows, SCHEMA).repartition(4).withColumns({"pid": F.lit(1), "vector": F.lit("x"), "id": F.lit(3), "leaf": F.lit(0)})
    found = vantage.nearest(frame, frame.where("vec_id % 20 = 0"), k=5)
    rows.remove(rows[-1])
    assert sorted(map(tuple, found.collect())) == search_by_hand(rows, lambda i: i % 20 == 0, 5)


def test_ties_go_to_the_smaller_id_over_shards(make, monkeypatch):
    for name, value in {"SHARD_ROWS": 16, "SAMPLE": 32, "LEAF": 4}.items():
        monkeypatch.setattr(vantage, name, value)
    rng = random.Random(3)
    # Many different vectors, few different products.
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(7)], 0) for i in range(300)]
    frame = make(rows, SCHEMA)
    found = vantage.nearest(frame, frame.where("vec_id % 20 = 0"), k=9)
    assert sorted(map(tuple, found.collect())) == search_by_hand(rows, lambda i: i % 20 == 0, 9)


def test_relaxed_search_leaves_out_halves_and_finds_most(make):
    rows = _rows(4000, 8, 4, clusters=40)
    vectors = np.array([v for _, v, _ in rows])
    norm = float(np.linalg.norm(vectors, axis=1).max() * 1.0001)
    tree = vantage.Tree(vantage.lifted(vectors, norm))
    tree.grow(np.arange(len(vectors)), 32)
    queries = vectors[::50]
    truth = np.argsort(-(queries @ vectors.T), axis=1, kind="stable")[:, :10]

    class Counted(vantage.Best):
        seen = 0

        def take(self, some, rows, vectors):
            Counted.seen += len(some) * len(rows)
            super().take(some, rows, vectors)

    looked, recall = {}, {}
    for factor in (1.0, 1.3, 2.0):
        Counted.seen = 0
        best = Counted(queries, np.full(len(queries), -np.inf), 10, norm, np.arange(len(vectors)))
        vantage.search(tree, vectors, best, factor)
        looked[factor] = Counted.seen
        recall[factor] = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(best.row.tolist(), truth.tolist())])
    assert recall[1.0] == 1.0 and recall[1.3] >= 0.9
    assert looked[2.0] < looked[1.3] < looked[1.0] < len(queries) * len(vectors)


def test_search_of_few_and_no_rows(make):
    none = make([], SCHEMA)
    assert vantage.nearest(none, none).collect() == []
    zero = make([(0, [0.0, 0.0], 1), (20, None, 1)], SCHEMA)
    assert vantage.nearest(zero, zero).collect() == []
    lone = make([(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1)], SCHEMA)
    assert vantage.nearest(lone, lone).collect() == []
    two = make([(0, [1.0, 2.0], 1), (7, [-1.0, 0.5], 1)], SCHEMA)
    assert sorted(map(tuple, vantage.nearest(two, two.where("vec_id = 0")).collect())) == [(0, 1, 7, 0.0)]
