"""The corpus pipeline: each stage takes documents and returns documents, the last one tokens.

Every function takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlode.llm import bpe, langid, mixing, ngram_join, pii
from gramlode.llm.common import bounded, saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A prediction that is less sure rejects the document; so does a text without a letter.
LEAST_SCORE = 0.4
#: Words of a shingle and least similarity, in hundredths, of near copies.
SHINGLE, SIMILAR = 5, 80
#: Removed ids that are broadcast at most; with more, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known stay, with the predicted language in ``lang``. Null and letterless texts go."""
    docs = docs.select(*COLUMNS)
    bounded(spark)
    model = langid.train(docs.filter(~langid.held_out()))
    told = langid.identify(docs, model, COLUMNS).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays (an id before null; of repeated rows, one). Documents without words stay."""
    docs = docs.select(*COLUMNS)
    rows, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if rows == ids:
        found = ngram_join.join(docs, words=SHINGLE, similar=SIMILAR)
        gone = saved(found.filter((F.col("n_shingles") > 0) & (F.col("doc_id") != F.col("component_id"))).select("doc_id"), "pipeline-copies")
    else:  # ids repeat: rows get a number of their own
        docs = saved(docs.withColumn("row", F.monotonically_increasing_id()), "pipeline-rows")
        found = ngram_join.join(docs.select(F.col("row").alias("doc_id"), "text"), words=SHINGLE, similar=SIMILAR).filter("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id")
        named = found.join(docs.select("row", "doc_id"), "row")
        first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")).alias("first"))
        gone = saved(found.join(first.select(F.col("first.row").alias("row")), "row", "left_anti").select("row"), "pipeline-copies")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, gone.columns, "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in brackets. Null texts stay null."""
    found = pii.spans(docs.withColumn("no_text", F.col("text").isNull()), keep=("doc_id", "lang", "source", "n_chars", "no_text"))
    out = found.withColumn("text", F.when(~F.col("no_text"), pii.redacted(F.col("text"), F.col("spans"))))
    return out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times. Documents without words are in no mix and go."""
    taken = mixing.mix(docs.select(*COLUMNS), keep=COLUMNS).filter((F.col("copies") > 0) & (F.col("size") > 0))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids, and whether decoding the ids gives the text's bytes."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = docs.withColumn("text_sha256", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))
    out = bpe.bpe_encode(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "source", "lang", "text_sha256"), decoded=False)
    return out.select("doc_id", "source", "lang", "n_tokens", "ids", (F.col("decoded_sha256") == F.col("text_sha256")).alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]

#: No SQL expresses the trained stages; tests compare the pipeline with a plain one on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
