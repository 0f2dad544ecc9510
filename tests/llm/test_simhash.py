import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from waxgraph.llm import simhash
from waxgraph.llm.common import Scratch, prepare
from waxgraph.llm.components import components


def plain_fingerprint(text, shingle=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in lowered + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    parts = [words] if len(words) < shingle else [words[i : i + shingle] for i in range(len(words) - shingle + 1)]
    hashes = [xxhash.xxh64(" ".join(p).encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \t\n", "One", "One two", "ÉA b\x0bC d e F", "a b c " * 9, "the end of the end of the end"])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 3) == plain_fingerprint(text)


def test_hash_is_sparks(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64(b"a b c", seed=42).intdigest()


@pytest.mark.parametrize("radius", [2, 4])
def test_masks_cover(radius):
    rng = random.Random(radius)
    for _ in range(2000):
        flipped = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not flipped & m for m in simhash.masks(radius))


def groups_by_force(values, radius):
    left, groups = set(values), []
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            group |= near
            todo += near
        groups.append(frozenset(v - 2**64 if v >> 63 else v for v in group))
    return {g for g in groups if len(g) > 1}


@pytest.mark.parametrize("radius,crowd", [(2, 64), (2, 3), (4, 64), (4, 4)])
def test_links_equal_brute_force(spark, make, monkeypatch, radius, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(5)
    values = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius + 1)))
            values.add(x)
    prints = make([(v - 2**64 if v >> 63 else v,) for v in values], "fingerprint long")
    scratch = Scratch(prepare(spark))
    found = components(scratch, simhash.links(scratch, prints, radius)).groupBy("root").agg(F.collect_set("node").alias("g"))
    assert {frozenset(r.g) for r in found.collect()} == groups_by_force(values, radius)


def test_odd_radius_is_refused(spark, make):
    with pytest.raises(ValueError):
        simhash.links(Scratch(spark), make([], "fingerprint long"), 3)


def test_component_is_the_smallest_id(make):
    text = "some words that make a text which is long enough"
    rows = [(9, text), (4, text.upper()), (7, "quite another text with other words in it"), (None, text), (5, None), (3, " ")]
    found = {r.doc_id: r for r in simhash.near_duplicates(make(rows, "doc_id long, text string")).collect()}
    assert {k: r.component_id for k, r in found.items()} == {9: 4, 4: 4, 7: 7, None: 4, 5: 3, 3: 3}
    assert found[5].fingerprint == "0" * 16


def test_components_of_chains_and_stars(spark, make):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 300)]
    random.Random(1).shuffle(edges)
    found = components(Scratch(prepare(spark)), make(edges, "a long, b long")).collect()
    assert Counter(r.root for r in found) == {0: 41, 100: 51}
