import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waxgraph.llm import repeats


def brute(rows, width):
    """Removed flags per row: strings of documents with a smaller id; a null id is the largest."""
    bodies = [(repeats.NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in bodies:
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            least[s] = min(least.get(s, i), i)
    for i, b in bodies:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if least[b[k : k + width]] < i:
                gone[k : k + width] = True
        yield gone


def held_against(spark_rows, rows, width):
    want = []
    for (i, t), gone in zip(rows, brute(rows, width)):
        b = np.frombuffer((t or "").encode(), np.uint8)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((str(i), len(b), spans, hashlib.sha1(b[~gone].tobytes()).hexdigest()))
    got = [(str(r.doc_id), r.n_bytes, len(r.spans), hashlib.sha1(bytes(r.kept)).hexdigest()) for r in spark_rows]
    assert sorted(got) == sorted(want)


def passages(seed, count):
    rng = random.Random(seed)
    words = ["al", "bé", "cor", "dan", "el", "fir", "gö", "hum"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [text(rng.randint(8, 40)) for _ in range(6)]
    rows = []
    for i in range(count):
        parts = [rng.choice(shared) if rng.random() < 0.5 else text(rng.randint(0, 30)) for _ in range(rng.randint(0, 4))]
        rows.append((rng.choice([i, i, i, i // 2]), " ".join(parts)))
    return rows + [(900, "x" * 400), (901, "x" * 120), (None, shared[0]), (None, shared[0]), (902, None)]


@pytest.mark.parametrize("width", [12, 50])
@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_equals_brute_force(make, monkeypatch, width, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "LEAST_BLOCK", 1500)  # several blocks and shards
    rows = passages(width + hot, 60)
    found = repeats.remove_repeats(make(rows, "doc_id long, text string"), width=width, memory=0).collect()
    held_against(found, rows, width)


def test_whole_characters_stay(make):
    rows = [(1, "é" * 60), (2, "aé" + "é" * 40 + "b")]
    found = {r.doc_id: r.kept for r in repeats.remove_repeats(make(rows, "doc_id long, text string"), as_text=True).collect()}
    assert found == {1: "é" * 60, 2: "ab"}


def test_spans_are_positions_in_the_text(make):
    shared = "This passage is long enough to count, for it has more than fifty bytes."
    rows = [(1, shared), (2, "before " + shared + " after")]
    found = {r.doc_id: r for r in repeats.remove_repeats(make(rows, "doc_id long, text string")).collect()}
    (span,) = found[2].spans
    assert (span.start, span.end) == (7, 7 + len(shared)) and bytes(found[2].kept) == b"before  after"
    assert found[1].spans == []


def test_repeats_of_one_row_are_dealt_over_blocks(spark, make, monkeypatch):
    from waxgraph.llm.common import Scratch, prepare

    monkeypatch.setattr(repeats, "LEAST_BLOCK", 4000)
    monkeypatch.setattr(repeats, "BLOCK_ROOT", 1)
    common = "a passage that a third of all rows have, without any id, and that is long enough "
    rows = [(None if i % 3 == 0 else i, common if i % 3 == 0 else f"text number {i} " * 6) for i in range(900)] + [(1000, common + "end")]
    docs = make(rows, "doc_id long, text string")
    dealt, count = repeats._dealt(Scratch(prepare(spark)), docs)
    largest = dealt.groupBy("block").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0]
    assert count > 10 and largest < 3 * 4000
    found = repeats.remove_repeats(docs).collect()
    assert len(found) == len(rows)
    assert {len(r.kept) for r in found if r.doc_id is None} == {0}
    assert [len(r.kept) for r in found if r.doc_id == 1000] == [len(common) + 3]
