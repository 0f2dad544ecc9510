"""Removal of passages that an earlier document holds, by suffix arrays over shards.

Every byte is removed that is covered by a ``width``-byte string which also starts in a
document with a smaller id. Sorting all suffixes of the corpus in one order would ship
each of them with its context, so the suffixes are dealt to shards first:

1. Every string has an anchor, its ``GRAM``-byte piece with the smallest hash, which any
   copy of the string has too. About one position in thirteen is an anchor. Blocks of
   documents send the hashes of their anchors to buckets, once each, and get those back
   that another document has as well.
2. Around these, the bytes of all strings with that anchor (a segment) go to the shard
   of the anchor, once per block and text. Where very many documents share an anchor,
   each string goes to a shard of its own hash instead, so that no shard can overflow.
3. A shard sorts the suffixes of all segments that differ from others with their anchor
   by external induced sorting (``suffixes``). Neighbours that share ``width`` bytes form the groups of equal strings,
   and the smallest id in a group decides for all its members.
4. The blocks turn the answers into spans and cut them out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from waxgraph.llm.common import Scratch, parts_for, prepare
from waxgraph.llm.suffixes import suffixes_descending

WIDTH = 50
# Bytes of text in a block or shard: grows with the root of the input between these bounds.
LEAST_BLOCK, MOST_BLOCK, BLOCK_ROOT = 1 << 21, 1 << 24, 1 << 12
# Anchors in more documents than this send single strings.
HOT = 2000
# Working memory of a suffix sort; what goes beyond is on disk.
MEMORY = 256 << 20
SEPARATOR, SHIFT = 1, 2
NO_ID = np.iinfo(np.int64).max
KEY_BYTES, KEY_MASK = 5, np.uint64((1 << 40) - 1)
_FACTORS = [pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64) for k in range(8)]

SENT = "block int, bucket int, keys binary, counts binary"
SEGMENTS = "block int, bucket int, lengths binary, ids binary, bytes binary"
ANSWERS = "block int, bucket int, keys binary, hot binary, masks binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` neighbours, from each position on."""
    have = 1
    while have * 2 <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Odd 64-bit hashes of the ``gram`` symbols from each position on, built up by doubling."""
    hashed = {1: _mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_FACTORS[0]))[symbols]}
    size, level = 1, 0
    while size * 2 <= gram:
        half = hashed[size]
        hashed[size * 2] = half[:-size] * np.uint64(_FACTORS[level]) + half[size:]
        size, level = size * 2, level + 1
    whole, rest = hashed.pop(size), gram - size
    while rest:
        part = 1 << (rest.bit_length() - 1)
        tail = hashed[part][gram - rest :]
        keep = min(len(whole), len(tail))
        whole, rest = whole[:keep] * np.uint64(pow(_FACTORS[0], part, 1 << 64)) + tail[:keep], rest - part
    return _mixed(whole[: len(symbols) - gram + 1]) | np.uint64(1)


class Block:
    """Documents of a block as one string of symbols, and the anchors in it.

    ``symbols`` are the bytes plus two, with a separator after every document.
    """

    def __init__(self, table: pa.Table, width: int):
        ids = table["doc_id"].fill_null(NO_ID).to_numpy()
        self.order = np.argsort(ids, kind="stable")
        self.ids = ids[self.order]
        raw = table["text"].cast(pa.binary()).combine_chunks()
        sizes = pc.binary_length(raw).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[self.order]
        self.begins = np.cumsum(sizes + 1) - sizes - 1
        self.ends = self.begins + sizes
        self.symbols = np.full(int((sizes + 1).sum()), SEPARATOR, np.uint8)
        for i, begin, end in zip(self.order.tolist(), self.begins.tolist(), self.ends.tolist()):
            if end > begin:
                self.symbols[begin:end] = np.frombuffer(raw[i].as_buffer(), np.uint8)
                self.symbols[begin:end] += SHIFT
        self.width = width
        self.gram = width // 2 + 1
        self._anchors()

    def _anchors(self) -> None:
        n, width, gram = len(self.symbols), self.width, self.gram
        self.places = self.first = self.last = np.empty(0, np.int64)
        self.hashes = np.empty(0, np.uint64)
        if n < width:
            return
        self.grams = gram_hashes(self.symbols, gram)
        span = width - gram + 1
        least = _sliding(self.grams, span, np.minimum)
        # Strings that run over a document's end count for nothing.
        inside = np.zeros(n + 1, np.int8)
        long = self.ends - self.begins >= width
        np.add.at(inside, self.begins[long], 1)
        np.add.at(inside, self.ends[long] - width + 1, -1)
        self.least = np.where(np.cumsum(inside[: len(least)], dtype=np.int8) > 0, least, np.uint64(0))
        del least, inside
        front = np.concatenate([np.zeros(span - 1, np.uint64), self.least, np.zeros(span - 1, np.uint64)])
        reach = _sliding(front, span, np.maximum)[: len(self.grams)]
        self.places = np.flatnonzero(reach == self.grams)
        # Smallest hashes are small: mixed again, they deal evenly.
        self.hashes = _mixed(self.grams[self.places] * np.uint64(_FACTORS[2]))
        self.span = span

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, places, "right") - 1

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last start of the strings that the anchors ``which`` stand for."""
        places = self.places[which]
        hashes = self.grams[places]
        first, last = np.full(len(which), np.iinfo(np.int64).max), np.full(len(which), -1)
        for back in range(self.span):
            start = places - back
            fits = (start >= 0) & (start < len(self.least))
            fits &= self.least[np.where(fits, start, 0)] == hashes
            np.minimum(first, start, out=first, where=fits)
            np.maximum(last, start, out=last, where=fits)
        return first, last

    def identity(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the bytes from ``first`` to the end of the string at ``last``; pieces overlap."""
        gram, width = self.gram, self.width
        whole = self.grams[first]
        for place in (last, last + width - gram, np.minimum(first + gram - 1, last + width - gram)):
            whole = _mixed(whole * np.uint64(_FACTORS[3]) + self.grams[place])
        return _mixed(whole + (last - first).astype(np.uint64))


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)).astype(np.int64)


def _packed_keys(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def _unpacked_keys(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return wide.view("<u8").ravel()


def _slices(sorted_values: np.ndarray):
    """Value, start and end of each run of equal values."""
    if len(sorted_values):
        heads = np.append(0, np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1)
        yield from zip(sorted_values[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(sorted_values)])


def _rows(rows: list, names: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}
    fields = [field.split() for field in names.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns)})


def _send_anchors(width: int, buckets: int):
    """Block to buckets: each anchor hash once, with the number of its documents up to 255."""

    def send(key, table):
        block = Block(table, width)
        order = np.argsort(block.hashes, kind="stable")
        hashes, docs = block.hashes[order], block.doc_of(block.places[order])
        new = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
        other = new | np.append(True, docs[1:] != docs[:-1])[: len(hashes)]
        heads = np.flatnonzero(new)
        counts = np.minimum(np.add.reduceat(other.astype(np.int64), heads), 255).astype(np.uint8) if len(heads) else heads
        hashes = hashes[heads]
        rows = [
            (key[0].as_py(), bucket, _packed_keys(hashes[a:b] & KEY_MASK), counts[a:b].tobytes())
            for bucket, a, b in _slices(_bucket(hashes, buckets))
        ]
        return _rows(rows, SENT)

    return send


def _find_shared(key, table):
    """Bucket to blocks: the hashes that more than one document has."""
    raw = table["keys"].to_pylist()
    keys = np.concatenate([_unpacked_keys(r) for r in raw])
    counts = np.concatenate([np.frombuffer(r, np.uint8) for r in table["counts"].to_pylist()]).astype(np.int64)
    sizes = [len(r) // KEY_BYTES for r in raw]
    found, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, counts, len(found))[place]
    rows, at = [], 0
    for block, size in zip(table["block"].to_pylist(), sizes):
        mine = slice(at, at + size)
        shared = total[mine] > 1
        if shared.any():
            rows.append((block, key[0].as_py(), _packed_keys(keys[mine][shared]), (total[mine][shared] > HOT).tobytes(), None))
        at += size
    return _rows(rows, ANSWERS)


class Segments:
    """The strings of a block whose anchors are shared, as segments with their bucket.

    ``row`` maps each segment to its text among the distinct ones, which are sorted by
    bucket; ``owner`` is the smallest id that has the text in this block.
    """

    def __init__(self, block: Block, answers: pa.Table, buckets: int):
        keys, hot = [], []
        for bucket, raw, flags in zip(*(answers[c].to_pylist() for c in ("bucket", "keys", "hot"))):
            if raw is not None:
                keys.append(_unpacked_keys(raw) | np.uint64(bucket) << np.uint64(40))
                hot.append(np.frombuffer(flags, bool))
        self.first = self.last = self.row = np.empty(0, np.int64)
        self.owner = self.bucket = np.empty(0, np.int64)
        if not keys:
            return
        keys, hot = np.concatenate(keys), np.concatenate(hot)
        order = np.argsort(keys)
        keys, hot = keys[order], hot[order]
        home = _bucket(block.hashes, buckets)
        mine = block.hashes & KEY_MASK | home.astype(np.uint64) << np.uint64(40)
        at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        which = np.flatnonzero(keys[at] == mine)
        first, last = block.strings(which)
        single = hot[at[which]]
        bucket = home[which]
        if single.any():  # one string each
            runs = (last - first + 1)[single]
            starts = np.repeat(first[single], runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            first, last = np.append(first[~single], starts), np.append(last[~single], starts)
            bucket = np.append(bucket[~single], _bucket(block.identity(starts, starts), buckets))
        self.first, self.last = first, last
        docs = block.ids[block.doc_of(first)]
        identity = block.identity(first, last)
        order = np.lexsort((docs, identity, bucket))
        b, i = bucket[order], identity[order]
        new = np.append(True, (b[1:] != b[:-1]) | (i[1:] != i[:-1]))
        self.row = np.empty(len(order), np.int64)
        self.row[order] = np.cumsum(new) - 1
        heads = order[new]
        self.heads, self.bucket, self.owner = heads, bucket[heads], docs[heads]


def _send_segments(width: int, buckets: int):
    """Block to shards: each distinct segment with the smallest id that has it."""

    def send(key, docs, answers):
        block = Block(docs, width)
        found = Segments(block, answers, buckets)
        rows = []
        for bucket, a, b in _slices(found.bucket):
            heads = found.heads[a:b]
            sizes = found.last[heads] - found.first[heads] + width
            starts = np.repeat(found.first[heads], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            rows.append((
                key[0].as_py(), bucket, sizes.astype("<u2").tobytes(),
                found.owner[a:b].astype("<i8").tobytes(), block.symbols[starts].tobytes(),
            ))
        return _rows(rows, SEGMENTS)

    return send


def _sort_shard(width: int, memory: int):
    """Shard to blocks: for each segment sent, which of its strings an earlier document has."""

    def decide(key, table):
        texts: dict[bytes, int] = {}
        senders, owner, rows_of = [], [], []
        for block, lengths, ids, raw in zip(*(table[c].to_pylist() for c in ("block", "lengths", "ids", "bytes"))):
            ids = np.frombuffer(ids, "<i8")
            ends = np.cumsum(np.frombuffer(lengths, "<u2").astype(np.int64)).tolist()
            mine, start = [], 0
            for end, doc in zip(ends, ids.tolist()):
                text = raw[start:end]
                row = texts.setdefault(text, len(texts))
                if row == len(owner):
                    owner.append(doc)
                elif doc < owner[row]:
                    owner[row] = doc
                mine.append(row)
                start = end
            senders.append((block, ids))
            rows_of.append(np.array(mine))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes + 1) - sizes - 1
        symbols = np.frombuffer(b"\x01".join(texts) + b"\x01", np.uint8)
        owner = np.array(owner, np.int64)
        least = np.repeat(owner, sizes + 1)
        # The anchor of all strings in a text is its smallest piece. Equal strings have equal
        # anchors, so a text that is alone with its anchor has no string that another has.
        gram = width // 2 + 1
        grams = np.append(gram_hashes(symbols, gram), np.full(gram - 1, ~np.uint64(0)))
        edges = np.stack([begins, begins + sizes - gram + 1], axis=1).ravel()
        anchors = np.minimum.reduceat(grams, edges)[::2]
        _, place, count = np.unique(anchors, return_inverse=True, return_counts=True)
        contested = np.flatnonzero(count[place] > 1)
        chosen = np.repeat(begins[contested], sizes[contested] + 1)
        inner = np.arange(len(chosen)) - np.repeat(np.cumsum(sizes[contested] + 1) - sizes[contested] - 1, sizes[contested] + 1)
        origin = np.append(chosen + inner, 0)
        if len(contested):
            sorted_symbols = np.append(symbols[origin[:-1]], np.uint8(0))
            for places, shared in suffixes_descending(sorted_symbols, width, memory):
                same = shared >= width
                members = same.copy()
                members[:-1] |= same[1:]
                if members.any():
                    at = origin[places[members]]
                    heads = np.flatnonzero(~same[members])
                    group = np.minimum.reduceat(least[at], heads)
                    least[at] = np.repeat(group, np.diff(np.append(heads, len(at))))
        out = []
        for (block, ids), rows in zip(senders, rows_of):
            mask = np.zeros(len(rows), np.uint64)
            for offset in range(int(sizes.max()) - width + 1):
                has = offset <= sizes[rows] - width
                earlier = least[np.where(has, begins[rows] + offset, 0)] < ids
                mask |= (has & earlier).astype(np.uint64) << np.uint64(offset)
            out.append((block, key[0].as_py(), None, None, mask.astype("<u8").tobytes()))
        return _rows(out, ANSWERS)

    return decide


def _cut(width: int, buckets: int, schema: pa.Schema):
    """Block and answers to its documents with removed spans and the bytes that stay."""

    def cut(key, docs, answers):
        block = Block(docs, width)
        n = len(block.symbols)
        change = np.zeros(n + 1, np.int64)
        found = Segments(block, answers.filter(answers["masks"].is_null()), buckets)
        if len(found.first):
            masks = np.zeros(len(found.bucket), np.uint64)
            for bucket, raw in zip(answers["bucket"].to_pylist(), answers["masks"].to_pylist()):
                if raw is not None:
                    a, b = np.searchsorted(found.bucket, [bucket, bucket + 1])
                    masks[a:b] = np.frombuffer(raw, "<u8")
            mask = masks[found.row]
            mask[block.ids[block.doc_of(found.first)] > found.owner[found.row]] = ~np.uint64(0)
            hits = []
            for offset in range(int((found.last - found.first).max()) + 1):
                hit = (found.first + offset <= found.last) & (mask >> np.uint64(offset) & np.uint64(1) == 1)
                hits.append(found.first[hit] + offset)
            hits = np.concatenate(hits)
            change = np.bincount(hits, minlength=n + 1) - np.bincount(hits + width, minlength=n + 1)
        gone = np.cumsum(change[:n]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        doc = block.doc_of(starts)
        lists = np.searchsorted(doc, np.arange(len(block.ids) + 1))
        stay = block.symbols - np.uint8(SHIFT)
        kept = [stay[b:e][~gone[b:e]].tobytes() for b, e in zip(block.begins.tolist(), block.ends.tolist())]
        if schema.field("kept").type == pa.string():
            kept = [k.decode("utf-8", "ignore") for k in kept]
        # Back to the order of the rows that came in.
        out = docs.take(pa.array(block.order))
        columns = [out[name] for name in schema.names[:-3]]
        relative = np.stack([starts, ends]) - block.begins[doc]
        spans = pa.ListArray.from_arrays(
            pa.array(lists, pa.int32()),
            pa.StructArray.from_arrays([pa.array(relative[0], pa.int64()), pa.array(relative[1], pa.int64())], ["start", "end"]),
        )
        sizes = pa.array(block.ends - block.begins, pa.int64())
        return pa.table([*columns, sizes, pa.array(kept, schema.field("kept").type), spans], schema=schema)

    return cut


def _dealt(scratch: Scratch, plain: DataFrame) -> tuple[DataFrame, int]:
    """Rows of ``doc_id, text, ...`` with their ``block``, and how many blocks there are.

    Rows go by a hash of id and text. Where repeats of one row alone would fill a good
    part of a block, the rows are stored first and dealt by their place in that table as
    well: it has to be the same each time they are read.
    """
    repeated = plain.groupBy(F.xxhash64("doc_id", "text").alias("row")).agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("bytes"), F.count("*").alias("n")
    )
    total, heaviest = repeated.agg(
        F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max(F.when(F.col("n") > 1, F.col("bytes"))), F.lit(0))
    ).first()
    each = min(MOST_BLOCK, max(LEAST_BLOCK, math.isqrt(total * BLOCK_ROOT)))
    count = parts_for(total, each)
    salt = []
    if heaviest > each // 8 and count > 1:
        plain = scratch.keep(plain.withColumn("salt", F.monotonically_increasing_id()))
        salt = ["salt"]
    block = F.pmod(F.xxhash64("doc_id", "text", *salt), F.lit(count)).cast("int").alias("block")
    return plain.select(block, "*").drop("salt"), count


def remove_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = WIDTH,
    memory: int = MEMORY,
    as_text: bool = False,
) -> DataFrame:
    """Every row of ``docs`` with ``n_bytes, kept, spans``.

    ``spans`` are the maximal runs of removed bytes (start and end in the UTF-8 text),
    ``kept`` the remaining bytes, or with ``as_text`` the whole characters among them.
    Strings are judged on the input and never cross
    documents. A null or empty text is empty. Of rows with one id none counts as earlier
    than another; a null id counts as later than all. Other columns are carried along,
    whatever their names; those named like the three results are replaced. An empty
    table gives an empty result.
    """
    if not 4 <= width <= 120:
        raise ValueError("the width must be from 4 to 120 bytes")
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark)
    carried = [f for f in docs.schema.fields if f.name not in ("n_bytes", "kept", "spans")]
    plain = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.col(f"`{text_column}`").alias("text"),
        *(F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(carried) if f.name != text_column),
    )
    blocks, count = _dealt(scratch, plain)
    narrow = blocks.select("block", "doc_id", "text")

    sent = narrow.groupBy("block").applyInArrow(_send_anchors(width, count), SENT)
    shared = scratch.keep(sent.groupBy("bucket").applyInArrow(_find_shared, ANSWERS))
    segments = narrow.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_send_segments(width, count), SEGMENTS)
    masks = scratch.keep(segments.groupBy("bucket").applyInArrow(_sort_shard(width, memory), ANSWERS))

    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [f for f in blocks.schema.fields if f.name not in ("block", "doc_id")]
    result = T.StructType([
        *fields, T.StructField("n_bytes", T.LongType()), T.StructField("kept", T.StringType() if as_text else T.BinaryType()), T.StructField("spans", spans),
    ])
    from pyspark.sql.pandas.types import to_arrow_schema

    answers = shared.unionByName(masks)
    done = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _cut(width, count, to_arrow_schema(result)), result
    )
    names = [
        F.col("text" if f.name == text_column else f"c{i}").alias(f.name) for i, f in enumerate(carried)
    ]
    return done.select(*names, "n_bytes", "kept", "spans")
