"""External induced suffix sorting with common-prefix lengths.

A suffix is of type S if it is smaller than the one after it, else of type L. Only the
leftmost suffixes of every S run are sorted directly: they cut the text into substrings,
the substrings get names by rank, and the names form a string of a third of the length,
which is sorted by recursion, or by doubling once it fits into memory. All other suffixes
are induced in two passes, L types in rising order and S types in falling order: who
leaves the queue puts its left neighbour in.

The queue is ordered by first symbol, then by arrival, which is the order of the suffixes
without that symbol. Its tuples carry the position and the prefix shared with the entry
before: one more than the smallest such value between the two neighbours. Beyond a memory
bound the tuples go to disk and come back symbol by symbol. In memory stay the symbols,
their types, and the tuples of one symbol.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

# Bytes of a name's working set in the in-memory sort.
NAME_BYTES = 64
PLACE = np.int64


class SuffixQueue:
    """Tuples (position, shared prefix) by symbol, first in first out, on disk beyond ``memory`` bytes."""

    def __init__(self, memory: int):
        self.memory = memory
        self.held = 0
        self.chunks: dict[int, list] = defaultdict(list)
        self.file = None

    def push(self, symbol: int, places: np.ndarray, shared: np.ndarray) -> None:
        self.chunks[symbol].append((places, shared))
        self.held += places.nbytes + shared.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for symbol, chunks in self.chunks.items():
            for i, chunk in enumerate(chunks):
                if isinstance(chunk[0], np.ndarray):
                    start = self.file.tell()
                    self.file.write(chunk[0].tobytes() + chunk[1].tobytes())
                    chunks[i] = (start, len(chunk[0]))
        self.held = 0

    def _load(self, chunk):
        if isinstance(chunk[0], np.ndarray):
            self.held -= chunk[0].nbytes + chunk[1].nbytes
            return chunk
        start, count = chunk
        self.file.seek(start)
        return (
            np.frombuffer(self.file.read(count * PLACE().nbytes), PLACE),
            np.frombuffer(self.file.read(count), np.uint8),
        )

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        found = [self._load(c) for c in self.chunks.pop(symbol, ())]
        if not found:
            return np.empty(0, PLACE), np.empty(0, np.uint8)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def holds(self, symbol: int) -> bool:
        return symbol in self.chunks

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest of ``values[low:high + 1]`` for each pair, over tables of doubled width."""
    out = np.empty(len(low), values.dtype)
    level = (np.frexp(high - low + 1)[1] - 1).astype(np.uint8)
    table, width = values, 1
    for k in range(int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - width + 1])
        table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def _padded(symbols: np.ndarray, cap: int) -> tuple[np.ndarray, int]:
    """Every position's next 8 bytes as one big-endian number, and the symbols in it."""
    size = symbols.itemsize
    raw = np.concatenate([symbols, np.zeros(cap + 16, symbols.dtype)]).astype(symbols.dtype.newbyteorder(">"))
    return np.ndarray((len(symbols) + cap + 8,), ">u8", raw.tobytes(), strides=(size,)), 8 // size


def _s_types(symbols: np.ndarray) -> np.ndarray:
    last = len(symbols) - 1
    turns = np.where(symbols[:-1] != symbols[1:], np.arange(last), last)
    turn = np.minimum.accumulate(turns[::-1])[::-1]
    return np.append(symbols[turn] < symbols[turn + 1], True) if last else np.ones(1, bool)


def _split_ties(rank: np.ndarray, members: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Refine ``rank`` (the number of smaller items) of whole groups of ties by ``keys``, in place.

    Returns the members that are still tied.
    """
    old = rank[members]
    if keys.dtype == PLACE and len(rank) < 1 << 31:  # both fit into one number
        order = np.argsort(old << 32 | keys)
    else:
        order = np.lexsort((keys, old))
    members, keys, old = members[order], keys[order], old[order]
    first = np.append(True, old[1:] != old[:-1])
    new = first | np.append(True, keys[1:] != keys[:-1])
    at = np.arange(len(members))
    group = np.maximum.accumulate(np.where(first, at, 0))
    rank[members] = old + np.maximum.accumulate(np.where(new, at, 0)) - group
    return members[~(new & np.append(new[1:], True))]


def _tied(rank: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)


def _first_rank(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    found = keys[order]
    head = np.append(True, found[1:] != found[:-1])
    rank = np.empty(len(keys), PLACE)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))
    return rank


def _names(words: np.ndarray, width: int, starts: np.ndarray) -> np.ndarray:
    """Dense ranks of the substrings between leftmost S positions, both ends included.

    A substring that ends is larger than a longer one with the same symbols, whose
    symbol there is of type L: so keys are filled up with ones.
    """
    length = np.append(np.diff(starts) + 1, 1)
    bits = np.uint64(64 // width)

    def keys(of: np.ndarray, offset: int) -> np.ndarray:
        left = np.clip(length[of] - offset, 0, width).astype(np.uint64)
        fill = np.where(left > 0, ~np.uint64(0) >> np.minimum(left * bits, np.uint64(63)), ~np.uint64(0))
        fill[left == width] = 0
        return words[np.where(left > 0, starts[of] + offset, 0)].astype(np.uint64) | fill

    rank = _first_rank(keys(np.arange(len(starts)), 0))
    offset = width
    tied = _tied(rank)
    while len(tied):
        open_ranks = np.zeros(len(rank), bool)
        open_ranks[rank[tied[length[tied] > offset]]] = True
        tied = tied[open_ranks[rank[tied]]]
        if not len(tied):
            break
        tied = _split_ties(rank, tied, keys(tied, offset))
        offset += width
    used = np.zeros(len(rank), PLACE)
    used[rank] = 1
    return (np.cumsum(used) - 1)[rank]


def _doubled(names: np.ndarray) -> np.ndarray:
    """Positions of a string's suffixes in order, by prefix doubling over what is still tied."""
    rank = _first_rank(names)
    tied, step = _tied(rank), 1
    while len(tied):
        after = tied + step
        keys = np.where(after < len(rank), rank[np.minimum(after, len(rank) - 1)] + 1, 0)
        tied, step = _split_ties(rank, tied, keys), step * 2
    order = np.empty(len(rank), PLACE)
    order[rank] = np.arange(len(rank))
    return order


def _shared(words: np.ndarray, width: int, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and ``b`` share, ``cap`` at most."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    bits = 64 // width
    for offset in range(0, cap, width):
        differ = words[a[live] + offset] ^ words[b[live] + offset]
        end = differ != 0
        found = differ[end].astype(np.uint64)
        out[live[end]] = offset + sum(
            (found >> np.uint64(64 - bits * k) == 0).astype(np.int64) for k in range(1, width)
        )
        live = live[~end]
        if not len(live):
            break
    out[live] = cap
    return np.minimum(out, cap).astype(np.uint8)


def _run(symbols: np.ndarray, place: int, cap: int) -> int:
    other = np.flatnonzero(symbols[place : place + cap + 1] != symbols[place])
    return int(other[0]) if len(other) else cap


def _rounds(symbols, symbol, places, shared, cap):
    """A symbol's queue entries and those of its runs: each round puts one more such symbol in front."""
    all_places, all_shared, length = [], [], 0
    while len(places):
        all_places.append(places)
        all_shared.append(shared)
        length += 1
        on = np.flatnonzero((places > 0) & (symbols[places - 1] == symbol))
        grown = np.empty(len(on), np.uint8)
        if len(on):
            grown[0] = min(length, cap)
            grown[1:] = np.minimum(range_min(shared, on[:-1] + 1, on[1:]), cap - 1) + 1
        places, shared = places[on] - 1, grown
    if not all_places:
        return places, shared, 0
    return np.concatenate(all_places), np.concatenate(all_shared), length


def _send(queue: SuffixQueue, symbols, places, shared, on, cap) -> None:
    """Put the left neighbours of ``places[on]`` into the queue."""
    if not len(on):
        return
    left = symbols[places[on] - 1]
    order = np.argsort(left, kind="stable")
    left, at = left[order], on[order]
    heads = np.append(0, np.flatnonzero(left[1:] != left[:-1]) + 1)
    before = np.append(at[:1], at[:-1])
    before[heads] = at[heads] - 1
    grown = np.minimum(range_min(shared, before + 1, at), cap - 1) + 1
    grown[heads] = 0
    moved = places[at] - 1
    for start, end in zip(heads.tolist(), [*heads[1:].tolist(), len(at)]):
        symbol = int(left[start])
        grown[start] = min(1, cap) if queue.holds(symbol) else 0
        queue.push(symbol, moved[start:end], grown[start:end])


def suffixes_descending(symbols: np.ndarray, cap: int, memory: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes from the largest to the smallest, in chunks ``positions, shared``.

    ``symbols`` is an array of uint8 or uint32 whose last symbol is 0 and occurs once.
    ``shared[i]`` is the prefix length that a suffix shares with the one before it in
    this order, ``cap`` at most (254 or less); 0 at the start of a chunk.
    """
    if len(symbols) == 1:
        yield np.zeros(1, PLACE), np.zeros(1, np.uint8)
        return
    types = _s_types(symbols)
    starts = np.flatnonzero(types[1:] & ~types[:-1]) + 1
    words, width = _padded(symbols, cap)
    names = _names(words, width, starts)
    if names.max() == len(names) - 1:
        order = np.argsort(names)
    elif len(names) * NAME_BYTES <= memory or len(names) < 4:
        order = _doubled(names)
    else:
        inner = [p for p, _ in suffixes_descending(names.astype(np.uint32), 1, memory)]
        order = np.concatenate(inner)[::-1]
    seeds = starts[order]
    seeds_shared = np.append(np.uint8(0), _shared(words, width, seeds[:-1], seeds[1:], cap))
    del words, names, order

    alphabet = np.unique(symbols)
    begins = np.searchsorted(symbols[seeds], alphabet, "left")
    ends = np.searchsorted(symbols[seeds], alphabet, "right")
    queue, large = SuffixQueue(memory), SuffixQueue(memory)
    for symbol, begin, end in zip(alphabet.tolist(), begins.tolist(), ends.tolist()):
        places, shared, length = _rounds(symbols, symbol, *queue.pop(symbol), cap)
        if len(places):
            large.push(symbol, places, shared)
        own, own_shared = seeds[begin:end], seeds_shared[begin:end].copy()
        if len(own):
            own_shared[0] = min(length, _run(symbols, own[0], cap), cap)
        places, shared = np.concatenate([places, own]), np.concatenate([shared, own_shared])
        on = np.flatnonzero((places > 0) & (symbols[places - 1] > symbol))
        _send(queue, symbols, places, shared, on, cap)
    queue.close()

    queue = SuffixQueue(memory)
    for symbol in alphabet[::-1].tolist():
        places, shared, length = _rounds(symbols, symbol, *queue.pop(symbol), cap)
        down, down_shared = large.pop(symbol)
        if len(down):
            turned = np.append(np.uint8(0), down_shared[1:][::-1]).astype(np.uint8)
            turned[0] = min(length, _run(symbols, down[-1], cap), cap)
            places, shared = np.concatenate([places, down[::-1]]), np.concatenate([shared, turned])
        if not symbol:
            places, shared = np.array([len(symbols) - 1], PLACE), np.zeros(1, np.uint8)
        shared = shared.copy()
        shared[:1] = 0
        on = np.flatnonzero((places > 0) & (symbols[places - 1] < symbol))
        _send(queue, symbols, places, shared, on, cap)
        yield places, shared
    queue.close()
    large.close()
