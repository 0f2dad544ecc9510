"""Best-two-fit packing of tokenized documents into sequences of fixed size.

A bin is filled greedily with the longest piece that fits. Then its smallest piece is
replaced by two unpacked pieces that fill the widened gap more tightly, as long as such a
pair exists. Pieces are dealt to shards of bounded size by a hash and packed there; what
ends up in loose bins is pooled and packed again, until that frees no more of them.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_right
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from waxgraph.llm.common import Scratch, batch_of, parts_for, prepare, texts

LIMIT = 4096
END = 1
# Pieces packed in one task.
SHARD = 8192
# Bins with more free room than this are packed again with those of other shards.
LOOSE = 32
# Words whose ids a worker remembers.
CACHE = 500_000

_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
])
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long, fill long"

# Letters on whose class all versions of Unicode agree; other words are encoded as a whole.
_LATIN = regex.compile("[\x00-\u024f]*")
# Python's str.split also splits at these, which the vocabulary's patterns do not.
_OTHER_BREAKS = regex.compile("[\x1c-\x1f]")


class WordIds:
    """Token ids of a text as little-endian bytes, remembered by word.

    The vocabulary drops white space and never joins characters across it, so the ids of
    a text are those of its words in turn. ``tokenizers`` does the encoding of new words:
    as a whole where they hold a special token, else its normalizer and its merges one by
    one, which costs a fraction of a call for each word.
    """

    def __init__(self, vocabulary: str):
        import json

        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        self.special = tuple(token["content"] for token in spec["added_tokens"])
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if "pattern" in p))
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8").decode("latin-1").translate(self.letters)
        found = array("I", [token.id for token in self.model.tokenize(letters)]).tobytes()
        self.pieces[piece] = found
        return found

    def _learn(self, words: list[str]) -> None:
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        joined = " ".join(words)
        if not _LATIN.fullmatch(joined):
            self.words |= {word: self.whole(word) for word in words if not _LATIN.fullmatch(word)}
            words = [word for word in words if _LATIN.fullmatch(word)]
            joined = " ".join(words)
        if not words:
            return
        plain = (joined.lower() if joined.isascii() else self.tokenizer.normalizer.normalize_str(joined)).split(" ")
        if len(plain) != len(words) or any(s in joined for s in self.special):
            self.words |= {word: self.whole(word) for word in words}
            return
        known, piece_ids = self.pieces.get, self._piece
        for word, normal in zip(words, plain):
            bare = normal.rstrip(".,;:!?")
            if bare.isalpha():  # letters, and maybe marks after them
                found = known(bare) or piece_ids(bare)
                if len(bare) < len(normal):
                    marks = normal[len(bare) :]
                    found += known(marks) or piece_ids(marks)
            else:
                found = b"".join([known(piece) or piece_ids(piece) for piece in self.split.findall(normal)])
            self.words[word] = found

    def __call__(self, text: str) -> bytes:
        if _OTHER_BREAKS.search(text):
            return self.whole(text)
        if len(self.words) > CACHE:
            self.words.clear()
        words = text.split()
        known = self.words
        ids = list(map(known.get, words))
        if None in ids:
            new = [i for i, found in enumerate(ids) if found is None]
            self._learn(list(dict.fromkeys([words[i] for i in new])))
            for i in new:
                ids[i] = known[words[i]]
        return b"".join(ids)


def cut(ids: bytes, limit: int):
    """``piece, start, length, crc32`` of each piece of at most ``limit`` ids."""
    for piece, start in enumerate(range(0, len(ids), 4 * limit)):
        part = ids[start : start + 4 * limit]
        yield piece, start // 4, len(part) // 4, zlib.crc32(part)


def pieces(docs: DataFrame, vocabulary: str | Path, limit: int = LIMIT, end: int = END) -> DataFrame:
    """Pieces of every document of ``doc_id, text``: its ids and ``end``, cut where longer than ``limit``."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))
    last = end.to_bytes(4, "little")

    def rows(batches):
        encode = WordIds(shared.value)
        for batch in batches:
            out = [
                (doc_id, *row)
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())
                for row in cut(encode(text) + last, limit)
            ]
            yield batch_of(_PIECES, list(zip(*out)) or [[]] * len(_PIECES))

    return docs.mapInArrow(rows, PIECES)


def _best_pair(lengths: list[int], count: list[int], room: int) -> tuple[int, int]:
    """The two available lengths with the largest sum up to ``room``; zeros if there are none."""
    have = np.array(lengths)
    first = np.arange(bisect_right(lengths, room // 2))
    if not len(first):
        return 0, 0
    second = np.searchsorted(have, room - have[first], "right") - 1
    alone = (second == first) & (np.array([count[have[i]] for i in first]) < 2)
    total = np.where((second < first) | alone, 0, have[first] + have[second])
    best = int(total.argmax())
    return (int(have[best]), int(have[second[best]])) if total[best] else (0, 0)


def best_two_fit(lengths, limit: int = LIMIT) -> list[list[int]]:
    """Lengths of each bin, in order. Lengths are from 1 to ``limit``."""
    count = np.bincount(np.asarray(lengths, np.int64), minlength=limit + 1).tolist()
    have = [n for n in range(1, limit + 1) if count[n]]
    bins = []

    def take(n: int) -> None:
        count[n] -= 1
        if not count[n]:
            del have[bisect_right(have, n) - 1]

    def give(n: int) -> None:
        count[n] += 1
        if count[n] == 1:
            have.insert(bisect_right(have, n), n)

    while have:
        held, gap = [], limit
        while i := bisect_right(have, gap):
            held.append(have[i - 1])
            gap -= held[-1]
            take(held[-1])
        while gap and have:
            small = held[-1]
            pair = _best_pair(have, count, gap + small)
            if sum(pair) <= small:
                break
            held.pop()
            for n in pair:
                take(n)
            give(small)
            held = sorted([*held, *pair], reverse=True)
            gap += small - sum(pair)
        bins.append(held)
    return bins


def _pack_shard(limit: int, stage: int):
    def packed(key, table):
        columns = {name: table[name].to_numpy(zero_copy_only=False) for name in ("piece", "length", "shard")}
        ids = table["doc_id"].fill_null(-1).to_numpy()
        order = np.lexsort((columns["piece"], ids, columns["length"]))
        length = columns["length"][order]
        bins = best_two_fit(length, limit)
        flat = np.array([n for b in bins for n in b], np.int64)
        sizes = np.array([len(b) for b in bins])
        home = np.repeat(np.arange(len(bins)), sizes)
        ends = np.cumsum(flat)
        fill = np.add.reduceat(flat, np.cumsum(sizes) - sizes)
        place = ends - flat - np.repeat(np.cumsum(fill) - fill, sizes)
        slots = np.argsort(flat, kind="stable")  # slots and rows by length meet one to one
        out = table.take(pa.array(order))
        base = (stage << 56) + (int(columns["shard"][0]) << 20)
        for name, values in (("sequence_id", base + home[slots]), ("offset", place[slots]), ("fill", fill[home[slots]])):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out.drop_columns(["shard"])

    return packed


def _dealt(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of a stored table with their ``shard``; those of one id or none are told apart by their place in it."""
    return rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", F.monotonically_increasing_id()), F.lit(shards)))


def _pack(rows: DataFrame, count: int, limit: int, shard: int, stage: int) -> DataFrame:
    dealt = _dealt(rows, parts_for(count, shard))
    return dealt.groupBy("shard").applyInArrow(_pack_shard(limit, stage), PACKED)


def pack(scratch: Scratch, rows: DataFrame, limit: int = LIMIT, shard: int = SHARD) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: sequences hold up to ``limit`` tokens without gaps."""
    whole, stage = rows.count(), 0
    found = scratch.keep(_pack(rows, whole, limit, shard, stage))
    closed = []
    while True:
        loose = found.where(F.col("fill") < limit - LOOSE).drop("sequence_id", "offset", "fill")
        left = loose.count()
        if whole <= shard or left == whole:
            break
        closed.append(found.where(F.col("fill") >= limit - LOOSE))
        whole, stage = left, stage + 1
        found = scratch.keep(_pack(loose, whole, limit, shard, stage))
    for part in closed:
        found = found.unionByName(part)
    return found.drop("fill")


def packed_documents(
    docs: DataFrame,
    vocabulary: str | Path,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = LIMIT,
    end: int = END,
) -> DataFrame:
    """Every document's pieces with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece that holds only ``end``. Rows that repeat, null ids
    included, are packed once each. Only documents longer than ``limit`` are cut. An empty
    table gives an empty result; further columns are not looked at.
    """
    scratch = Scratch(prepare(docs.sparkSession))
    rows = scratch.keep(pieces(texts(docs, id_column, text_column), vocabulary, limit, end))
    return pack(scratch, rows, limit)
