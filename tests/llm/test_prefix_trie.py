"""The prefix trie against a brute-force one, over shards of any size, and on awkward rows."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from waxgraph.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found_by_spark(frame):
    conv = F.col("conv_id")
    length = F.crc32(conv.cast("string").cast("binary")) % 6
    rows = prefix_trie.with_heads(prefix_trie.turns(frame), conv - conv % 100, length, most=5)
    return sorted(map(tuple, prefix_trie.build(rows).select(*COLUMNS).collect()), key=str)


def found_by_hand(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(turns)] for c, turns in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    found = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        ends = sorted(c for c in members if len(rebuilt[c]) == len(prefix))
        found.append((
            min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members),
            sum(len(p) == len(prefix) + 1 for p in below),
            sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p in below),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(found, key=str)


def _rows(seed, convs=60, most=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), convs):
        for turn in range(rng.randint(1, most)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é𝄞", None])))
    return rows


@pytest.mark.parametrize("convs,turns,task", [(4096, 1 << 16, 1 << 19), (3, 1 << 16, 40), (4096, 5, 10), (1, 1, 1)])
def test_against_brute_force_over_shards(make, monkeypatch, convs, turns, task):
    for name, value in {"SHARD_CONVS": convs, "SHARD_TURNS": turns, "TASK_TURNS": task}.items():
        monkeypatch.setattr(prefix_trie, name, value)
    rows = _rows(convs + turns)
    assert found_by_spark(make(rows, SCHEMA).repartition(3)) == found_by_hand(rows)


def test_awkward_rows(make):
    rows = [
        (None, 1, "user", "x"), (100, None, "user", "first"), (100, 3, None, None), (100, 3, None, None),
        (101, 2, "user", "tie b"), (101, 2, "user", "tie a"), (101, 2, "assistant", "z"), (-5, 0, "user", "minus"),
        (-100, 0, "user", "minus"), (102, 0, "", ""), (102, 0, "a:", "b"), (103, 0, "a", ":b"), (104, 0, "user", "long " * 30000),
    ]
    wide = make(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("pos", "digest", "part", "n_chars", "key", "shard")})
    assert found_by_spark(wide) == found_by_hand(rows)
    assert found_by_spark(make([], SCHEMA)) == []


def test_one_common_conversation_and_a_long_one(make, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_CONVS", 16)
    rows = [(c, t, "user", f"turn {t}") for c in range(60) for t in range(3)]
    rows += [(c, 0, "user", "turn 0") for c in range(60, 90)] + [(95, t, "user", "same") for t in range(120)]
    assert found_by_spark(make(rows, SCHEMA)) == found_by_hand(rows)


def test_children_are_intersections_of_bitsets():
    shard = [(1, [b"a", b"b"], [1, 1]), (2, [b"a", b"c"], [1, 1]), (5, [b"a", b"b"], [1, 1]), (9, [], [])]
    index = prefix_trie.postings(shard)
    assert index[0, b"a"] == 0b0111 and index[1, b"b"] == 0b0101
    assert prefix_trie.bits_of(0b1000000000101).tolist() == [0, 2, 12]
    nodes = prefix_trie.shard_nodes(shard)
    assert [(n[0], n[1], n[2], n[4], n[5], n[6], n[8], n[9]) for n in nodes] == [
        (0, 3, -1, 0, 1, 4, 1, [9]), (1, 3, 0, 1, 1, 3, 2, []), (2, 2, 1, 2, 1, 2, 0, [1, 5]), (3, 3, 1, 2, 2, 1, 0, [2]),
    ]
