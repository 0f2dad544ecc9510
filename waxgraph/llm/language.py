"""Language identification by cross-parsing against suffix automata.

Per language, the suffix automaton of a bounded sample of labelled text accepts exactly
the strings that occur in it. A text is parsed greedily into the longest phrases found
there; the phrases needed, times the logarithm of the sample's length and divided by the
length of the text, estimate its entropy relative to the language. The lowest one wins.

Many texts advance together, one symbol at a time, through dense transition tables: a
missing transition already leads to where the next phrase starts and carries the phrases that end.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from waxgraph.llm.common import Scratch, prepare

# The sample: this many texts of each language, and this many characters of each.
SAMPLE_TEXTS = 32
SAMPLE_CHARS = 1024
# Texts are parsed in stretches of this length; a phrase ends where its stretch ends.
STRETCH = 1024
UNDETERMINED = "und"
BLANK, UNSEEN = 0, 1


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state; state 0 is the start, every path spells a substring."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for symbol in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at >= 0:
            to = moves[at][symbol]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                clone = len(moves)
                moves.append(dict(moves[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                while at >= 0 and moves[at].get(symbol) == to:
                    moves[at][symbol] = clone
                    at = link[at]
                link[to] = link[new] = clone
        last = new
    return moves


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _collapsed(symbols: np.ndarray) -> np.ndarray:
    """One blank for each run of blanks."""
    return symbols[np.append(True, (symbols[1:] != BLANK) | (symbols[:-1] != BLANK))[: len(symbols)]]


@dataclass
class Model:
    """Automata of all languages over one alphabet of letters; everything else is a blank."""

    languages: list[str]
    alphabet: np.ndarray  # code points of the symbols from 2 on
    automata: list[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]  # from, symbol, to, states, sample length


def learn(samples: dict[str, str]) -> Model:
    letters = _letters()
    points = {lang: _code_points(text) for lang, text in sorted(samples.items())}
    seen = np.unique(np.concatenate([*points.values(), np.empty(0, np.uint32)]))
    alphabet = seen[letters[seen]]
    codes = symbol_table(alphabet, letters)
    automata = []
    for of in points.values():
        symbols = _collapsed(codes[of]).tolist()
        moves = suffix_automaton(symbols)
        flat = np.array([(s, c, t) for s, m in enumerate(moves) for c, t in m.items()], np.int32).reshape(-1, 3)
        automata.append((flat[:, 0], flat[:, 1], flat[:, 2], len(moves), len(symbols)))
    return Model(list(points), alphabet, automata)


def symbol_table(alphabet: np.ndarray, letters: np.ndarray) -> np.ndarray:
    codes = np.where(letters, UNSEEN, BLANK).astype(np.uint16)
    codes[alphabet] = np.arange(2, 2 + len(alphabet))
    return codes


class Parser:
    """A model's automata as tables, and the parse of many texts at once."""

    def __init__(self, model: Model):
        self.languages = model.languages
        self.letters = _letters()
        self.codes = symbol_table(model.alphabet, self.letters)
        self.pad = 2 + len(model.alphabet)
        self.weights = [math.log2(max(size, 2)) for *_, size in model.automata]
        width = self.pad + 1
        self.tables = []
        for origin, symbol, target, states, _ in model.automata:
            table = np.full((states, width), -1, np.int64)
            table[origin, symbol] = target.astype(np.int64) * width << 2
            # A phrase ends; a symbol that starts none is one more by itself.
            start = np.where(table[0] < 0, 2, table[0] | 1)
            table = np.where(table < 0, start, table)
            table[0] -= table[0] & 3 > 0
            table[:, self.pad] = 1
            table[0, self.pad] = 0
            self.tables.append(table.astype(np.int32 if states * width < 1 << 29 else np.int64).ravel())

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases per language and text, symbols per text, and which texts have a letter."""
        points = [_code_points(t) for t in texts]
        lettered = np.array([bool(self.letters[p].any()) for p in points], bool)
        symbols = [_collapsed(self.codes[p]) for p in points]
        sizes = np.array([len(s) for s in symbols], np.int64)
        stretches = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), stretches)
        offset = (np.arange(len(owner)) - np.repeat(np.cumsum(stretches) - stretches, stretches)) * STRETCH
        length = np.minimum(sizes[owner] - offset, STRETCH)
        order = np.argsort(-length, kind="stable")
        owner, offset, length = owner[order], offset[order], length[order]
        flat = np.concatenate([*symbols, np.empty(0, np.uint16)])
        begins = (np.cumsum(sizes) - sizes)[owner] + offset
        steps = int(length.max(initial=0)) + 1
        active = np.searchsorted(-length, -np.arange(steps), "right")  # stretches of at least so many symbols
        counts = np.zeros((len(self.tables), len(owner)), np.int64)
        states = [np.zeros(len(owner), t.dtype) for t in self.tables]
        for step in range(steps):
            n = active[step]
            inside = length[:n] > step
            now = np.where(inside, flat[np.minimum(begins[:n] + step, len(flat) - 1)], self.pad)
            for k, table in enumerate(self.tables):
                moved = table[states[k][:n] + now]
                counts[k, :n] += moved & 3
                states[k][:n] = moved >> 2
        totals = np.zeros((len(self.tables), len(texts)), np.int64)
        for k in range(len(self.tables)):
            totals[k] = np.bincount(owner, counts[k], len(texts))
        return totals, sizes, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language and score of each text, and whether it has a letter."""
        if not self.languages:
            lettered = np.array([bool(self.letters[_code_points(t)].any()) for t in texts], bool)
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), lettered
        totals, sizes, lettered = self.phrases(texts)
        rates = totals * np.array(self.weights)[:, None] / np.maximum(sizes, 1)
        best = rates.argmin(axis=0)
        ranked = np.sort(rates, axis=0)
        second = ranked[1] if len(ranked) > 1 else np.full(len(texts), np.inf)
        with np.errstate(invalid="ignore"):
            score = np.where(np.isinf(second), 1.0, second / np.maximum(ranked[0] + second, 1e-300))
        names = [self.languages[b] if has else UNDETERMINED for b, has in zip(best.tolist(), lettered.tolist())]
        return names, np.where(lettered, score, 0.0), lettered


def sample(labelled: DataFrame, texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Bounded sample of ``text, lang``: for each language the starts of some distinct texts, picked by hash."""
    hashed = labelled.where("text is not null and lang is not null").select(
        "lang", F.xxhash64("text").alias("h"), F.substring("text", 1, chars).alias("head")
    )
    ranked = hashed.groupBy("lang", "h").agg(F.lit(1).alias("one")).selectExpr(
        "lang", "h", "row_number() over (partition by lang order by h) as place"
    )
    # A stored table of a few rows a language: it goes to the texts, and no text is shuffled.
    scratch = Scratch(labelled.sparkSession)
    picked = scratch.keep(ranked.where(F.col("place") <= texts).select("lang", "h"))
    heads = hashed.join(picked, ["lang", "h"]).groupBy("lang", "h").agg(F.min("head").alias("head")).orderBy("lang", "h").collect()
    scratch.drop(picked)
    found: dict[str, str] = {}
    for row in heads:
        found[row.lang] = found.get(row.lang, "") + row.head + "\n"
    return found


def held_out(id_column: str = "doc_id"):
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(
    docs: DataFrame,
    labelled: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    texts: int = SAMPLE_TEXTS,
    chars: int = SAMPLE_CHARS,
    carry: bool = False,
    flag: str | None = None,
) -> DataFrame:
    """``doc_id, lang_pred, score`` for every document, learned from ``labelled`` (text, lang).

    With ``carry`` every column of ``docs`` is kept, followed by the two; columns of
    their names are replaced. ``flag`` names one more column that says whether the text
    has a letter, whatever could be learned.

    ``lang_pred`` is a language of the sample, or ``und`` with score 0 where the text is
    null, empty or without a letter, or where nothing could be learned. ``score`` is the
    second-lowest entropy over the sum of the two lowest, 1 with one language; ties go
    to the first language in alphabetical order. Repeated rows and null ids stay rows;
    further columns are not looked at.
    """
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(learn(sample(labelled, texts, chars)))
    added = ["lang_pred", "score", *([flag] if flag else [])]
    kept = [c for c in docs.columns if c not in added] if carry else []
    plain = docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)) if carry else [F.col(id_column).cast("long").alias("doc_id")],
        F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"),
    )
    schema = T.StructType([
        *plain.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        *([T.StructField(flag, T.BooleanType())] if flag else []),
    ])

    def rows(batches):
        parser = Parser(model.value)
        for batch in batches:
            names, score, lettered = parser.predict(batch["text"].to_pylist())
            columns = [*batch.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64())]
            columns += [pa.array(lettered, pa.bool_())] if flag else []
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    found = plain.mapInArrow(rows, schema)
    return found.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), *added) if carry else found
