"""The corpus pipeline: each stage takes what its predecessor kept and hands on what it keeps.

All stages but the last return the columns of ``documents``; the last one returns the
packed pieces. No stage can be stated in SQL as a whole, so there is no twin; the tests
hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waxgraph.llm import language, near_copies, packing, queries, repeats, templates
from waxgraph.llm.common import Scratch, prepare

# Near copies: texts whose sets of five-word shingles have a similarity of 0.8 or more.
SHINGLE = 5


def _measured(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("n_chars", F.length(text).cast("long"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, a null ``lang`` filled with the language found; others go.

    Lettered texts stay whatever the labels are, and their ``lang`` stays null where no
    language could be learned.
    """
    found = language.identify(docs, docs, carry=True, flag="_has_letter").where("_has_letter")
    told = F.when(F.col("lang_pred") != language.UNDETERMINED, F.col("lang_pred"))
    return found.withColumn("lang", F.coalesce("lang", told)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without recurring lines: those of templates, and short ones as they are."""
    found = templates.drop_recurring(docs, short_lines=True)
    return _measured(found.drop("n_lines", "n_dropped"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest id, null ids last, then the first row."""
    return near_copies.first_of_each(docs, shingle=SHINGLE)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one holds; split characters go as well."""
    found = repeats.remove_repeats(docs, as_text=True)
    return _measured(found.withColumn("text", F.col("kept"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a sequence."""
    return packing.packed_documents(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_removal),
    ("best_fit_packing", pack),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as a table and read again."""
    scratch = Scratch(prepare(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        if place == len(STAGES) - 1:
            return found
        docs = scratch.keep(found)
    return docs
