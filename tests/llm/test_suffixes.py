"""Induced suffix sorting against plain sorting, in memory and with everything on disk."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from waxgraph.llm.suffixes import SuffixQueue, range_min, suffixes_descending

TEXTS = st.one_of(
    st.binary(max_size=80).map(lambda b: bytes(1 + x % 3 for x in b)),
    st.binary(max_size=80).map(lambda b: bytes(1 + x % 250 for x in b)),
    st.tuples(st.binary(min_size=1, max_size=6), st.integers(1, 30)).map(lambda t: bytes(1 + x % 250 for x in t[0]) * t[1]),
)


def sorted_with_shared(text: bytes, cap: int, memory: int):
    order, shared = [], []
    for places, common in suffixes_descending(np.frombuffer(text, np.uint8), cap, memory):
        order += places.tolist()
        shared += common.tolist()
    return order, shared


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.sampled_from([1, 3, 50]), st.sampled_from([0, 200, 1 << 30]))
def test_order_and_shared_prefixes(body, cap, memory):
    text = body + b"\0"
    order, shared = sorted_with_shared(text, cap, memory)
    assert order == sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
    for before, here, common in zip(order, order[1:], shared[1:]):
        a, b = text[before:], text[here:]
        length = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common == min(length, cap)


def test_queue_keeps_order_on_disk():
    queue = SuffixQueue(memory=0)
    for start in range(5):
        queue.push(start % 2, np.array([start], np.int64), np.array([start], np.uint8))
    assert queue.file is not None
    assert queue.pop(0)[0].tolist() == [0, 2, 4]
    assert queue.pop(1)[1].tolist() == [1, 3]
    assert len(queue.pop(1)[0]) == 0


def test_range_min():
    values = np.array([5, 3, 8, 1, 9, 2], np.uint8)
    low, high = zip(*[(a, b) for a in range(6) for b in range(a, 6)])
    found = range_min(values, np.array(low), np.array(high))
    assert found.tolist() == [values[a : b + 1].min() for a, b in zip(low, high)]


@pytest.mark.parametrize("memory", [0, 1 << 30])
def test_long_runs(memory):
    text = b"\2" * 3000 + b"\3" * 2000 + b"\2\3" * 1000 + b"\0"
    order, _ = sorted_with_shared(text, 50, memory)
    assert order == sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
