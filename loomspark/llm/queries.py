"""The thin queries of the operators, one for each, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe, byte_bpe, collocations, compaction, imatch, langid, line_dedup, mixing, quality, simhash, sstable, url_filter, whitening
from loomspark.llm.common import fresh_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> str:
    """The tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that labels calls good."""
    return _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in a mix whose source weights follow the square root of the sources' sizes."""
    made = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source"))
    return made.select("doc_id", "source", F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__rank").alias("rank"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.judge(_read(spark, sf_dir, "documents").select("doc_id", "text"), trusted_ids(spark, sf_dir))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return made.select("doc_id", *(F.col(f"__{n}").alias(n) for n in names))


#: The rules that the URL query applies.
URL_RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    made = url_filter.judge_urls(pages, url_filter.rule_table(spark, URL_RULES))
    return made.select("page_id", *(F.col(f"__{n}").alias(n) for n in ("host", "path", "rule", "verdict")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return made.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), kept.alias("kept_sha256"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    plan = imatch.IMatchPlan()
    held = spark.sparkContext.broadcast(imatch.lexicon(docs, "text", plan))

    return imatch.with_next(docs, imatch.EditLikeness(held, plan), imatch.EditLikeness.COLUMNS)


def op7_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    sstable.write_tokens(_read(spark, sf_dir, "documents"), path, vocabulary())

    def use(doc_id: int | None, start: int, ids: np.ndarray) -> tuple:
        return doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
    return sstable.read_tokens(spark, path, use, schema, "doc_id long, start long, n_tokens long, ids_crc32 long")


#: Batches in which op8_sharding's documents arrive.
ARRIVALS = 4


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it is read from the last version, after ARRIVALS batches of small shards, each compacted on arrival."""
    made = compaction.ShardSet(spark, fresh_path(spark, "shards"))
    docs = _read(spark, sf_dir, "documents").withColumn("arrival", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(ARRIVALS)))
    for n in range(ARRIVALS):
        made.append(docs.where(F.col("arrival") == n))
        made.compact()
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return made.read().select("doc_id", "source", "arrival", F.length("text").cast("long").alias("n_chars"), digest.alias("text_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), vocabulary())


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    mark = langid.held_out(F.col("doc_id")).alias("held_out")
    return langid.identify(docs, model).select("doc_id", mark, "lang_pred", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"), 8)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_quality": op2_quality,
    "op3_url_filter": op3_url_filter,
    "op4_simhash": op4_simhash,
    "op5_line_dedup": op5_line_dedup,
    "op6_imatch": op6_imatch,
    "op7_sstable": op7_sstable,
    "op8_sharding": op8_sharding,
    "op9_bpe": op9_bpe,
    "op10_langid": op10_langid,
    "op11_whitening": op11_whitening,
    "op12_collocations": op12_collocations,
    "op13_byte_bpe": op13_byte_bpe,
}
