"""Unigram Viterbi segmentation over a double-array trie, and decoding.

Pieces and log scores come from a SentencePiece model file. The whitespace marker of the
pieces is a plain blank here and a text gets one in front, so a text that holds the
marker as a character is not mixed up with blanks: characters that no piece covers are
spelled in byte pieces, and decoding gives back exactly what was encoded.

Where no piece has a blank after another character, the best segmentation never crosses
from a word to the blank behind it. Texts then fall apart into words, new words are
segmented many at a time, and known ones are looked up.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from waxgraph.llm.common import batch_of, prepare

MARKER = "▁"
# Below the lowest score, for a character that no piece covers.
UNKNOWN_PENALTY = 10.0
# Words whose segmentation a worker remembers.
CACHE = 500_000
# Bytes from which a word is segmented by itself: few are as long, and steps for few cost as much as for many.
LONG = 256

_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("crc32", pa.int64())])
_TEXT = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("crc32", pa.int64()), ("decoded", pa.string())])


@dataclass
class Pieces:
    """A vocabulary: the bytes of every piece, scores, and what the trie and the fallback need."""

    spelled: list[bytes]
    scores: list[float]
    normal: list[int]
    byte_ids: list[int]
    unknown: int


def load_pieces(model_file: str | Path) -> Pieces:
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=str(model_file))
    spelled, normal, byte_ids = [], [], [model.unk_id()] * 256
    count = model.get_piece_size()
    for i in range(count):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            spelled.append(bytes([value]))
            byte_ids[value] = i
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"")
        else:
            spelled.append(piece.replace(MARKER, " ").encode("utf-8"))
            normal.append(i)
    return Pieces(spelled, [model.get_score(i) for i in range(count)], normal, byte_ids, model.unk_id())


@dataclass
class DoubleArray:
    """Trie in two arrays: the child of ``s`` by byte ``c`` is ``t = base[s] + c`` if ``check[t] == s``."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # what ends at a state, or -1

    def find(self, key: bytes) -> int:
        state = 0
        for c in key:
            to = int(self.base[state]) + c
            if self.check[to] != state:
                return -1
            state = to
        return int(self.value[state])


def double_array(entries: dict[bytes, int]) -> DoubleArray:
    children: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for key in sorted(entries):
        at = 0
        for c in key:
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
            at = children[at][c]
        ends[at] = entries[key]

    size = 2 * len(children) + 1024
    used = bytearray(size)
    used[0] = 1
    base, check, value = array("i", [0]) * size, array("i", [-1]) * size, array("i", [-1]) * size
    if 0 in ends:
        value[0] = ends[0]
    waiting, low = [(0, 0)], 1
    for node, state in waiting:
        codes = sorted(children[node])
        if not codes:
            continue
        while used[low]:
            low += 1
        at = low
        while True:  # the first free place for the smallest code at which all others fit too
            start = at - codes[0]
            if start >= 0 and not any(used[start + c] for c in codes):
                break
            at = used.find(0, at + 1)
        base[state] = start
        for c in codes:
            to = start + c
            used[to] = 1
            check[to] = state
            child = children[node][c]
            value[to] = ends.get(child, -1)
            waiting.append((child, to))
        if max(codes) + start + 512 > size:
            extra = size
            size += extra
            used.extend(bytes(extra))
            base.extend([0] * extra)
            check.extend([-1] * extra)
            value.extend([-1] * extra)
    return DoubleArray(np.array(base), np.array(check), np.array(value))


@dataclass
class Segmenter:
    """Viterbi over many words in lock-step."""

    trie: DoubleArray
    scores: np.ndarray
    byte_ids: list[int]
    by_word: bool
    lowest: float

    @classmethod
    def of(cls, pieces: Pieces) -> Segmenter:
        entries: dict[bytes, int] = {}
        for i in pieces.normal:
            entries.setdefault(pieces.spelled[i], i)
        by_word = not any(b" " in piece.lstrip(b" ") for piece in entries)
        lowest = min((pieces.scores[i] for i in pieces.normal), default=0.0) - UNKNOWN_PENALTY
        return cls(double_array(entries), np.array(pieces.scores), pieces.byte_ids, by_word, lowest)

    def segment(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as 32-bit numbers. On ties the earlier start of the last piece wins."""
        if any(len(w) > LONG for w in words):
            short = iter(self.segment([w for w in words if len(w) <= LONG]))
            return [self.segment_one(w) if len(w) > LONG else next(short) for w in words]
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        sizes = np.array([len(words[i]) for i in order], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        flat = np.frombuffer(b"\0".join(words[i] for i in order) + b"\0" * 8, np.uint8)
        heads = (flat & 0xC0) != 0x80
        best = np.full(len(flat), -np.inf)
        best[begins] = 0.0
        back = np.zeros(len(flat), np.int32)
        piece = np.full(len(flat), -1, np.int32)

        def offer(ends, starts, score, ids):
            better = score > best[ends]
            at = ends[better]
            best[at], back[at], piece[at] = score[better], starts[better], ids[better]

        for place in range(int(sizes.max(initial=0))):
            n = np.searchsorted(-sizes, -place, "left")  # words longer than this
            starts = begins[:n] + place
            starts = starts[heads[starts]]
            if not len(starts):
                continue
            stops = (begins[:n] + sizes[:n])[heads[begins[:n] + place]]
            width = 1 + (flat[starts] >= 0xC0) + (flat[starts] >= 0xE0) + (flat[starts] >= 0xF0)
            ends = np.minimum(starts + width, stops)
            states, alive, depth = np.zeros(len(starts), np.int64), np.arange(len(starts)), 0
            while len(alive):
                at = starts[alive] + depth
                to = base[states] + flat[at].astype(np.int64)
                on = (check[to] == states) & (at < stops[alive])
                states, alive = to[on], alive[on]
                depth += 1
                ids = value[states]
                full = ids >= 0
                if full.any():
                    rows, found = alive[full], ids[full]
                    offer(starts[rows] + depth, starts[rows], best[starts[rows]] + self.scores[found], found)
            offer(ends, starts, best[starts] + self.lowest, np.full(len(starts), -1))

        out = [b""] * len(words)
        back, piece, raw = back.tolist(), piece.tolist(), flat.tobytes()
        for i, begin, size in zip(order, begins.tolist(), sizes.tolist()):
            at, ids = begin + size, []
            while at > begin:
                start = back[at]
                if piece[at] >= 0:
                    ids.append(piece[at])
                else:
                    ids.extend(self.byte_ids[c] for c in reversed(raw[start:at]))
                at = start
            out[i] = array("i", ids[::-1]).tobytes()
        return out


    def segment_one(self, word: bytes) -> bytes:
        """The same for one word of any length, byte by byte."""
        base, check, value, scores = self.lists
        n = len(word)
        best, back, piece = [-np.inf] * n + [-np.inf], [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            head = word[start]
            if head & 0xC0 == 0x80:
                continue
            sofar, state = best[start], 0
            for at in range(start, n):
                to = base[state] + word[at]
                if check[to] != state:
                    break
                state = to
                found = value[state]
                if found >= 0 and sofar + scores[found] > best[at + 1]:
                    best[at + 1], back[at + 1], piece[at + 1] = sofar + scores[found], start, found
            end = min(n, start + 1 + (head >= 0xC0) + (head >= 0xE0) + (head >= 0xF0))
            if sofar + self.lowest > best[end]:
                best[end], back[end], piece[end] = sofar + self.lowest, start, -1
        at, ids = n, []
        while at > 0:
            start = back[at]
            if piece[at] >= 0:
                ids.append(piece[at])
            else:
                ids.extend(self.byte_ids[c] for c in reversed(word[start:at]))
            at = start
        return array("i", ids[::-1]).tobytes()

    @cached_property
    def lists(self) -> tuple[list, list, list, list]:
        """Plain lists are faster by the element."""
        return self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist()


_WORDS = re.compile(" *[^ ]+| +")


class Encoder:
    def __init__(self, segmenter: Segmenter):
        self.segmenter = segmenter
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit numbers; an empty text has none."""
        if not self.segmenter.by_word:
            return self.segmenter.segment([f" {t}".encode("utf-8", "surrogatepass") if t else b"" for t in texts])
        if len(self.known) > CACHE:
            self.known.clear()
        split = [_WORDS.findall(f" {t}") if t else [] for t in texts]
        new = list({w for words in split for w in words if w not in self.known})
        self.known.update(zip(new, self.segmenter.segment([w.encode("utf-8", "surrogatepass") for w in new])))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def _plain(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )


def encode(docs: DataFrame, model_file: str | Path, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids, crc32`` of every document: its pieces' ids and the CRC of its UTF-8 text.

    A null text counts as empty; an empty one has no pieces. Repeated rows and null ids
    stay rows, an empty table gives an empty result; further columns are not looked at.
    """
    import zlib

    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Segmenter.of(load_pieces(model_file)))

    def rows(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = encoder.encode(texts)
            offsets = np.cumsum([0, *(len(f) // 4 for f in found)])
            ids = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32), pa.int32())
            )
            yield batch_of(_IDS, [batch["doc_id"], ids, [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts]])

    return _plain(docs, id_column, text_column).mapInArrow(rows, "doc_id long, ids array<int>, crc32 long")


def decode(tokens: DataFrame, model_file: str | Path) -> DataFrame:
    """The rows of ``encode`` with ``decoded``: blanks for markers, bytes put together, the blank in front removed."""
    spark = prepare(tokens.sparkSession)
    shared = spark.sparkContext.broadcast(load_pieces(model_file).spelled)

    def rows(batches):
        spelled = shared.value
        for batch in batches:
            decoded = [
                b"".join([spelled[i] for i in ids])[1:].decode("utf-8", "replace") for ids in batch["ids"].to_pylist()
            ]
            yield batch_of(_TEXT, [batch["doc_id"], batch["ids"], batch["crc32"], decoded])

    return tokens.mapInArrow(rows, "doc_id long, ids array<int>, crc32 long, decoded string")


def round_trip(docs: DataFrame, model_file: str | Path, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``encode`` and ``decode`` in one pass: ``doc_id, ids, crc32, decoded``."""
    import zlib

    spark = prepare(docs.sparkSession)
    pieces = load_pieces(model_file)
    shared = spark.sparkContext.broadcast((Segmenter.of(pieces), pieces.spelled))

    def rows(batches):
        segmenter, spelled = shared.value
        encoder = Encoder(segmenter)
        for batch in batches:
            texts = batch["text"].to_pylist()
            found = [np.frombuffer(ids, np.int32) for ids in encoder.encode(texts)]
            decoded = [b"".join(map(spelled.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace") for ids in found]
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([*found, np.empty(0, np.int32)]))
            )
            crcs = [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield batch_of(_TEXT, [batch["doc_id"], lists, crcs, decoded])

    return _plain(docs, id_column, text_column).mapInArrow(rows, "doc_id long, ids array<int>, crc32 long, decoded string")
