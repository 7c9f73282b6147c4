"""Queries opN_<name>: each applies its operator to the whole of its table and returns the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gramlode.llm import langid

    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gramlode.llm import pii

    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gramlode.llm.ngram_join import join

    return join(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gramlode.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gramlode.llm.warc import history, write_warc

    return history(write_warc(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gramlode.llm.media import media_columns

    return media_columns(table(spark, sf_dir, "documents"), full=False)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gramlode.llm.bpe import bpe_encode

    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, decoded=False)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gramlode.llm.substrings import dedup

    return dedup(table(spark, sf_dir, "documents"), full=False)


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gramlode.llm.ann import search

    return search(table(spark, sf_dir, "embeddings"))


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gramlode.llm import license as lic

    return lic.digest(lic.scan(table(spark, sf_dir, "documents")))


# ---- what SQL can express of queries that it can't express whole: these columns come through the same operators


def langid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_langid(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("unknown"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_pii(spark, sf_dir).drop("spans")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


PARTS = (langid_split, pii_base, mixing_targets, media_payload, bpe_round_trip)


def queries() -> dict[str, Query]:
    whole = {k: f for k, f in globals().items() if k[:2] == "op" and k[2:3].isdigit()}
    return whole | {f.__name__: f for f in PARTS}


def oracle_sql() -> dict[str, str]:
    from gramlode.llm import oracle

    return oracle.queries()
