"""The registered queries of the corpus operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from loomlog.llm.bpe import round_trip
from loomlog.llm.common import documents, prepared, shared_folder
from loomlog.llm.exact import exact_groups
from loomlog.llm.langid import languages
from loomlog.llm.media import fingerprints, to_wav
from loomlog.llm.minhash import near_duplicates
from loomlog.llm.mixing import taken_words
from loomlog.llm.phrases import collocations
from loomlog.llm.prefix_trie import prefix_trie
from loomlog.llm.secrets import secret_spans
from loomlog.llm.substring import without_repeats
from loomlog.llm.token_counts import token_counts
from loomlog.llm.urls import judge_urls
from loomlog.llm.warc import read_archives, write_archives

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir))


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    write_archives(prepared(spark).read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(spark, folder).drop("complete")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(documents(spark, sf_dir))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op5_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints show as their number and one digest of times and codes."""
    found = fingerprints(to_wav(documents(spark, sf_dir)))
    digest = F.sha1(F.to_json(F.struct("times", "codes")))
    pairs = F.size("codes").cast("string")
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(":", F.col("n_frames").cast("string"), pairs, digest).alias("feature"),
    )


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))


def op7_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(prepared(spark).read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(prepared(spark).read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_warc_segments": op2_warc_segments,
    "op3_source_mix": op3_source_mix,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_media_fingerprints": op5_media_fingerprints,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_secret_links": op7_secret_links,
    "op8_token_counts": op8_token_counts,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_url_filter": op13_url_filter,
    "pipeline": corpus_pipeline.run,
}
