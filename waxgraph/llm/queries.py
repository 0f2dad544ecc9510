"""The operators of this subpackage as queries on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from waxgraph.llm import (
    binary_search,
    language,
    order_minhash,
    packing,
    prefix_trie,
    repeats,
    simhash,
    templates,
    unigram,
    url_lists,
    vantage,
    vector_codes,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(run: Query) -> Query:
    REGISTRY[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


@query
def op10_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op7_cross_parsing_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, docs.where(~language.held_out() & F.col("doc_id").isNotNull()))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query
def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_with_next(table(spark, sf_dir, "documents"))


@query
def op8_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.drop_recurring(table(spark, sf_dir, "documents"), short_lines=True)
    return found.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


@query
def op5_unigram_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = unigram.round_trip(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.crc32(F.col("decoded").cast("binary")) == F.col("crc32")).alias("round_trip"),
    )


def url_list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries out of the pages: each page's host, domain or first path part is listed or taken off."""
    host = url_lists.host_of(F.coalesce("url", F.lit("")))
    first = F.regexp_extract(F.coalesce("url", F.lit("")), url_lists.SCHEME + "[^/?#]*/([^/?#]+)", 1)
    which = F.col("page_id") % 5
    pattern = (
        F.when(which < 2, F.array_join(F.slice(F.split(host, "[.]"), -2, 2), "."))
        .when(which < 4, host)
        .otherwise(F.concat(host, F.lit("/"), first, F.lit("/")))
    )
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
    return pages.select(pattern.alias("pattern"), day.alias("dated"), (F.col("page_id") % 3 != 0).alias("listed"))


@query
def op3_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 101 % 366).cast("int"))
    captures = pages.select("page_id", "url", day.alias("fetched"))
    found = url_lists.evaluate(captures, url_list_entries(pages), id_column="page_id")
    return found.select(F.col("id").alias("page_id"), "host", "listed", "pattern", F.col("since").cast("string").alias("since"))


@query
def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = binary_search.sign_codes(table(spark, sf_dir, "embeddings"))
    return binary_search.nearest(codes, codes.where(F.col("id") % 50 == 0), k=10)


@query
def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.derivatives(warc.response_records(table(spark, sf_dir, "pages")))
    return found.select(
        F.col("source_id").alias("page_id"), "type", "record_id", "refers_to", "target_uri", "date", "source_digest",
        "block_digest", "n_links", F.md5("record").alias("record_md5"), "error",
    )


@query
def op11_walsh_hadamard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return found.rows.select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256")
    )


@query
def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = prefix_trie.turns(table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    heads = F.crc32(conv.cast("string").cast("binary")) % 6
    nodes = prefix_trie.build(prefix_trie.with_heads(numbered, conv - conv % 100, heads, most=5))
    return nodes.drop("key")


@query
def op13_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vantage.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)
