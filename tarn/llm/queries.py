"""The ``opN_<name>`` queries: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.bpe import encode_decode
from tarn.llm.exact_dedup import exact_dedup
from tarn.llm.exact_topk import exact_topk
from tarn.llm.language_id import address_host, address_suffix, identify_languages, markup_language, markup_text, train_text_model
from tarn.llm.line_dedup import line_dedup
from tarn.llm.mixing import mix_sources
from tarn.llm.oracles import ORACLE
from tarn.llm.quality import fit_quality, held_out, score_quality
from tarn.llm.secret_scan import scan_secrets
from tarn.llm.sharding import shard_by_bytes, text_size
from tarn.llm.simhash import simhash_groups

N_SHARDS = 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(_table(spark, sf_dir, "embeddings"), k=5, query_every=50)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    slim = _table(spark, sf_dir, "documents").select(
        "doc_id", text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32")
    )
    return shard_by_bytes(slim, N_SHARDS, "size", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"), keep=("source",))
    first = mixed.withColumn("first_position", F.try_element_at("positions", F.lit(1)))
    order = [F.col("first_position").asc_nulls_last(), F.col("doc_id")]  # documents not taken have no position, and are many
    return first.repartitionByRange(*order).sortWithinPartitions(*order)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"), max_edits=2, least_chars=9, word_share=0.1, exact_chars=1).drop("_row")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model, found = train_text_model(docs), ("lang", "probability", "kept")
    # Documents have no address or markup: their source stands for the host.
    of_docs = identify_languages(docs, model, "doc_id", F.col("text"), host=F.col("source"))
    host, html = address_host(F.col("url")), F.col("html")
    of_pages = identify_languages(_table(spark, sf_dir, "pages"), model, "page_id", markup_text(html), host, address_suffix(host), markup_language(html))
    none = F.lit(None).cast("long")
    of_docs = of_docs.select(F.lit("documents").alias("table"), "doc_id", none.alias("page_id"), *found)
    return of_docs.unionByName(of_pages.select(F.lit("pages").alias("table"), none.alias("doc_id"), "page_id", *found))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return encode_decode(_table(spark, sf_dir, "documents"), path, ("n_tokens", "ids_sha256", "decoded_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_topk": op1_exact_topk,
        "op2_sharding": op2_sharding,
        "op3_mixing": op3_mixing,
        "op4_secret_scan": op4_secret_scan,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_line_dedup": op6_line_dedup,
        "op7_language_id": op7_language_id,
        "op8_bpe": op8_bpe,
        "op9_simhash": op9_simhash,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
