import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waxgraph.llm import near_copies, simhash
from waxgraph.llm.common import Scratch, prepare

SCHEMA = "doc_id long, text string"


def sets_of(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept_by_force(rows):
    sets = [sets_of(t) for _, t in rows]
    left, kept = set(range(len(rows))), []
    while left:
        todo = [left.pop()]
        group = list(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])}
            left -= near
            group += near
            todo += near
        kept.append(min(rows[i][0] for i in group))
    return sorted(kept)


def edited(rng, words, places):
    words = list(words)
    for at in rng.sample(range(len(words)), places):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("crowd", [16, 2])
def test_near_dedup_equals_brute_force(spark, make, monkeypatch, crowd):
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    rng = random.Random(4)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        # Up to 0.98, about 0.8, and below: one word changes five of 196 shingles.
        rows += [" ".join(edited(rng, base, n)) for n in (0, 0, 1, 2, 3, 4, 4, 5, 6, 8, 12)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, make(rows, SCHEMA), "").collect())
    assert kept == kept_by_force(rows)


def test_pairs_at_the_border_are_found(spark, make):
    rng = random.Random(5)
    rows = []
    for i in range(100):
        base = [f"d{i}w{k}" for k in range(200)]
        other = list(base)
        for at in (20, 60, 100, 140):  # 20 of 196 shingles: similarity 176 / 216 = 0.815
            other[at] = f"new{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, make(rows, SCHEMA), "").collect()}
    assert kept == set(range(0, 200, 2))


def test_rows_are_judged_one_by_one(spark, make):
    text, other, third = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = text.replace("a59", "end")
    rows = [
        (1, text), (None, near), (None, other), (None, other + " more"), (None, "one more clean text of its own without an id"),
        (7, third), (7, third), (7, text.upper()), (7, "a clean text under the repeated id seven, not like any"), (8, None), (None, ""),
    ]
    docs = make(rows, SCHEMA).withColumn("node", F.lit("x")).coalesce(1)
    found = corpus_pipeline.near_dedup(spark, docs, "")
    assert found.columns == docs.columns
    want = [rows[i] for i in (0, 2, 4, 5, 8, 9)]
    assert sorted(map(str, found.select("doc_id", "text").collect())) == sorted(str(r) for r in make(want, SCHEMA).collect())


def test_a_crowded_bucket_of_unlike_pages_is_not_compared_in_pairs(spark, make, monkeypatch):
    """Pages of one template share most of their minima, and nothing that tells two of them alike."""
    template = [f"t{i}" for i in range(160)]
    pages = [" ".join(template + [f"p{i}w{k}" for k in range(60)]) for i in range(5000)]
    # Two that are alike but for the last words, in the same buckets.
    pages += [pages[7] + " and more", pages[7] + " or less"]
    looked = []
    plain = near_copies._confirmed

    def counted(scratch, pairs, sets, similarity):
        looked.append(pairs.count())
        return plain(scratch, pairs, sets, similarity)

    monkeypatch.setattr(near_copies, "_confirmed", counted)
    frame = make(list(enumerate(pages)), SCHEMA).repartition(8)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").select("doc_id").collect()}
    assert kept == set(range(5000))
    assert sum(looked) < 24 * 5002


@pytest.mark.parametrize("crowd", [16, 2])
def test_no_rows_and_clashing_columns(spark, make, monkeypatch, crowd):
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    names = ["uid", "node", "size", "bands", "digest", "shingled", "bucket", "root", "best", "c0", "hashes"]
    wide = {n: F.lit("x") for n in names}
    none = corpus_pipeline.near_dedup(spark, make([], SCHEMA).withColumns(wide), "")
    assert none.collect() == [] and none.columns == ["doc_id", "text", *names]
    rows = [(i, "a b c d e f g h i j k l m n o p q r s t u v w " + x) for i, x in enumerate(["x", "x", "y", "z", "x y", "x z"])]
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, make(rows, SCHEMA).withColumns(wide), "").collect()] == [0]


def test_fingerprints_alone_tie_near_copies(spark, make):
    """Without a band in common: SimHash proposes, the exact check decides."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base), " ".join(base + ["more"]), " ".join(f"v{rng.randrange(10**6)}" for _ in range(400))]
    sets = [near_copies.shingles(t, 5) for t in texts]
    prints = [simhash.folded(s) for s in sets]
    assert (prints[0] ^ prints[1]).bit_count() <= near_copies.RADIUS
    # The third has the fingerprint of the first, but not its text.
    prints[2] = prints[0]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = make([(i, len(s), [], p) for i, (s, p) in enumerate(zip(sets, signed))], "node long, size int, bands array<long>, fingerprint long")
    roots = near_copies.links(Scratch(prepare(spark)), nodes, make(list(enumerate(texts)), "node long, text string"), 5)
    assert sorted(map(tuple, roots.select("node", "root").collect())) == [(0, 0), (1, 0)]
