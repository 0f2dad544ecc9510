"""Postings in blocks, ordered by impact: a text index that is stored and read in part.

The postings of a token are ordered by what they are worth, best first, and cut into
blocks. A block carries the greatest frequency and the least length in it, which bound
what it can add to a score whatever the mean length is: the index stays right while
documents come and go. A search opens the first blocks of its rarest tokens, takes the
score of the ``size``-th text found as a bar, and opens the other blocks only where they
can reach it. Entries hold their text, so an opened posting is scored for all tokens of
the query at once and no other list is looked into.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from waxgraph import fixed
from waxgraph.functions import text as X
from waxgraph.operators.latest import top_per
from waxgraph.operators.search import SCORE_DIGITS
from waxgraph.session import settle

# Postings in a block; a power of two.
BLOCK = 128
FIRST = ("kind", "space", "id", "id_num")


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def texts_of(documents: DataFrame) -> DataFrame:
    """(text, documents, doc_key, first): distinct texts with their first node."""
    first = F.min_by(F.struct(*FIRST), "doc_key")
    return documents.groupBy("text").agg(
        F.count(F.lit(1)).alias("documents"), F.min("doc_key").alias("doc_key"), first.alias("first")
    )


def spread(texts: DataFrame) -> DataFrame:
    """(token, tf, length, entry): one row per text and distinct token."""
    listed = texts.select(
        F.struct("text", "documents", "doc_key", "first").alias("entry"), F.split("text", " ").alias("words")
    )
    tokens = listed.select("entry", "words", F.explode(F.array_distinct("words")).alias("token"))
    tf = F.size(F.filter("words", lambda word: word == F.col("token")))
    return tokens.select("token", tf.alias("tf"), F.size("words").alias("length"), "entry")


def blocks(postings: DataFrame, buckets: int, size: int = BLOCK) -> DataFrame:
    """(bucket, token, tf, length, df, texts, entries): postings as ``spread`` gives them, in blocks.

    Dealt out by ranges of (token, impact), so that a token on a third of all texts is
    many partitions; a block is a run of ``size`` rows of one token in one of them.
    """
    order = [F.col("token"), F.col("tf").desc(), F.col("length"), F.col("entry.doc_key")]
    dealt = postings.repartitionByRange(*order).sortWithinPartitions(*order)
    # The low bits count the rows of a partition.
    run = F.shiftright(F.monotonically_increasing_id(), int(math.log2(size)))
    grouped = dealt.withColumn("run", run).groupBy("token", "run").agg(
        F.max("tf").alias("tf"),
        F.min("length").alias("length"),
        F.sum("entry.documents").alias("df"),
        F.count(F.lit(1)).alias("texts"),
        F.collect_list("entry").alias("entries"),
    )
    return grouped.select(bucket_of(F.col("token"), buckets).alias("bucket"), "token", "tf", "length", "df", "texts", "entries")


def entries_of(found: DataFrame) -> DataFrame:
    """Blocks back to postings (token, tf, length, entry)."""
    opened = found.select("token", F.explode("entries").alias("entry"))
    words = F.split("entry.text", " ")
    tf = F.size(F.filter(words, lambda word: word == F.col("token")))
    return opened.select("token", tf.alias("tf"), F.size(words).alias("length"), "entry")


def _worth(tf: Column, length: Column, mean: float) -> Column:
    norm = fixed.BM25_K1 * (1 - fixed.BM25_B + fixed.BM25_B * length / F.lit(mean))
    return tf * (fixed.BM25_K1 + 1) / (tf + norm)


def asked_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token, times) of prepared queries."""
    asked = queries.select("query_id", F.explode(X.tokens(F.col("term"))).alias("token"))
    return asked.groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))


def best_texts(asked: DataFrame, found: DataFrame, total: int, mean: float, size: int = fixed.POOL) -> DataFrame:
    """(query_id, text, score, documents, doc_key, first): the best ``size`` texts of every query by BM25.

    ``asked`` as ``asked_tokens`` gives it, ``found`` the blocks of its tokens (and maybe
    of others), ``total`` and ``mean`` the number of documents and their mean length.
    Ties go by document key. The rows are those of a search that opens every block.
    """
    heads = found.join(asked.select("token").distinct(), "token", "left_semi").select(
        "token", "tf", "length", "df", "texts", _worth(F.col("tf"), F.col("length"), mean).alias("bound")
    )
    counts = heads.groupBy("token").agg(
        F.sum("df").alias("df"), F.sum("texts").alias("texts"), F.max("bound").alias("best")
    )
    idf = F.log(1 + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("times") * idf
    # A few rows per query.
    weighted = settle(
        asked.join(counts, "token").select(
            "query_id", "token", "texts", weight.alias("weight"), (weight * F.col("best")).alias("upper")
        )
    )
    rare_first = Window.partitionBy("query_id").orderBy("texts", "token")
    before = F.sum("texts").over(rare_first.rowsBetween(Window.unboundedPreceding, -1))
    after = F.sum("upper").over(rare_first.rowsBetween(1, Window.unboundedFollowing))
    terms = F.collect_list(F.struct("token", "weight")).over(Window.partitionBy("query_id"))
    placed = settle(
        weighted.select(
            "query_id", "token", "weight", (F.coalesce(before, F.lit(0)) < size).alias("rare"),
            F.coalesce(after, F.lit(0.0)).alias("after"), terms.alias("terms"),
        )
    )
    # Blocks that hold the ``size`` best postings of their token come before all others.
    bound = _worth(F.col("tf"), F.col("length"), mean)
    ahead = F.sum("texts").over(
        Window.partitionBy("token").orderBy(F.desc("bound")).rowsBetween(Window.unboundedPreceding, -1)
    )
    bars = found.join(placed.where("rare").select("token").distinct(), "token", "left_semi").withColumn("bound", bound)
    bars = bars.withColumn("ahead", F.coalesce(ahead, F.lit(0))).where(F.col("ahead") < size)
    first = settle(_scored(placed.where("rare").join(bars, "token"), mean))
    bar = top_per(first, ["query_id"], [F.col("score").desc()], size).where(F.col("rk") == size)
    bar = bar.select("query_id", F.col("score").alias("bar"))
    # Scores are rounded, so the bar is met with some room. A text is opened by the first
    # of its tokens, so the tokens before that one add nothing to it.
    reach = F.col("weight") * F.col("bound") + F.col("after")
    opens = F.col("bar").isNull() | (reach >= F.col("bar") - 10.0 ** (1 - SCORE_DIGITS))
    asking = settle(placed.join(bar, "query_id", "left"))
    others = asking.join(found.withColumn("bound", bound), "token").where(opens)
    every = first.unionByName(_scored(others, mean))
    distinct = every.groupBy("query_id", "text").agg(
        *(F.first(name).alias(name) for name in ("score", "documents", "doc_key", "first"))
    )
    return top_per(distinct, ["query_id"], [F.col("score").desc(), F.col("doc_key").asc()], size).drop("rk")


def _scored(opened: DataFrame, mean: float) -> DataFrame:
    """Entries of blocks opened for a query, with the whole score of their texts; a text may come more than once."""
    listed = opened.select("query_id", "terms", F.explode("entries").alias("entry")).select(
        "query_id", "terms", "entry.*", F.split("entry.text", " ").alias("words")
    )

    def part(term: Column) -> Column:
        tf = F.size(F.filter("words", lambda word: word == term["token"]))
        return term["weight"] * _worth(tf, F.size("words"), mean)

    score = F.aggregate("terms", F.lit(0.0), lambda sum_, term: sum_ + part(term))
    return listed.select("query_id", "text", F.round(score, SCORE_DIGITS).alias("score"), "documents", "doc_key", "first")
