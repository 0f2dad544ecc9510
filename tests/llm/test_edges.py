"""Every document operator on nulls, empty and very long texts, ties, repeats, clashing columns and no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waxgraph.llm import language, order_minhash, packing, queries, repeats, simhash, templates, unigram

LONG = "one two three four five six seven eight nine ten " * 3000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here", "en", "a"),
    (1, "Another text with the same id", "en", None),
    (2, None, None, None),
    (3, "", "en", "b"),
    (None, "The quick brown fox jumps over the lazy dog and runs far away from here", "en", "a"),
    (None, None, None, None),
    (5, LONG, "en", "b"),
    (6, "\n\n \t\n", "de", "b"),
    (7, "12345 !!! 漢字 é 𝄞 ▁", "de", "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
EXTRA = ["text_", "block", "hash", "key", "id", "row", "print", "shape", "leaf", "part", "fingerprint", "n_bytes", "c0", "score", "shard"]


def _vocabulary():
    return queries.tokenizer("word_bpe_49k.json")


OPERATORS = {
    "repeats": lambda d: repeats.remove_repeats(d).select("doc_id", "n_bytes", F.length("kept").alias("left")),
    "order_minhash": order_minhash.compare_with_next,
    "unigram": lambda d: unigram.encode(d, queries.tokenizer("piece_bpe_32k.model")),
    "language": lambda d: language.identify(d, d),
    "language_carried": lambda d: language.identify(d, d, carry=True).select("doc_id", "lang_pred"),
    "templates": lambda d: templates.drop_recurring(d).select("doc_id", "text", "n_lines", "n_dropped"),
    "simhash": simhash.near_duplicates,
    "packing": lambda d: packing.packed_documents(d, _vocabulary()),
}


def widened(df):
    for name in EXTRA:
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(make, name):
    docs = make(ROWS, SCHEMA)
    found = OPERATORS[name](widened(docs)).collect()
    plain = OPERATORS[name](docs).collect()
    assert sorted(map(str, found)) == sorted(map(str, plain))
    ids = sorted(str(row.doc_id) for row in found if getattr(row, "piece", 0) == 0)
    assert ids == sorted(str(row[0]) for row in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(make, name):
    assert OPERATORS[name](make([], SCHEMA)).collect() == []


def test_pipeline_on_awkward_rows_and_on_none(spark, make):
    docs = make(ROWS, SCHEMA).withColumn("n_chars", F.lit(0).cast("long"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns, name
    assert {row.doc_id for row in kept.collect()} >= {1, 5, 7}
    assert corpus_pipeline.STAGES[-1][1](spark, kept, "").count() >= 3
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, "")
    assert nothing.count() == 0
