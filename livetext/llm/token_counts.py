"""Operator 1, token counts by a digest cache.

Texts are reduced to SHA-256 digests of their normalised content. Digests are joined to a table of
stored counts for the same tokenizer version; only distinct texts that it lacks are encoded, and their
counts are appended to it.

Two jobs may append one digest; such repeats are reduced to one count when the cache is read. A text is encoded whole
in one task, so its length is bounded by an executor's memory only. Null text is the empty text (0 tokens). Repeated rows and ids each keep their row. An empty table gives an
empty result and an empty cache. Other columns are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livetext.llm.common import new_path, small_batches, table, whole, written
from livetext.llm.encoding import encoder, version

CACHE_SCHEMA = "digest binary, n_tokens long"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def count_tokens(docs: DataFrame, tokenizer: str, cache_dir: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``docs`` with n_bytes, n_tokens, over_limit for each row; ``cache_dir`` is read and appended to.

    The normal form is the text itself with null as empty: a byte-level vocabulary counts every byte, so
    nothing else may be folded.
    """
    spark = docs.sparkSession
    small_batches(spark)
    store = f"{cache_dir}/tokenizer={version(tokenizer)}"
    keyed = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))

    @F.pandas_udf("long")
    def n_tokens(texts: pd.Series) -> pd.Series:
        count = encoder(tokenizer).count
        return pd.Series([count(t) for t in texts], dtype="int64")

    # dropDuplicates combines on the map side: a text with many copies is sent once from each task
    misses = keyed.select("digest", "text").dropDuplicates(["digest"])
    if _exists(spark, store):
        misses = misses.join(spark.read.schema(CACHE_SCHEMA).parquet(store).select("digest"), "digest", "left_anti")
    misses.select("digest", n_tokens("text").alias("n_tokens")).write.mode("append").parquet(store)

    # two writers may have appended the same digest; written out, so that the join below can still split a hot digest
    stored = spark.read.schema(CACHE_SCHEMA).parquet(store)
    counts = written(stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "counts")
    rows = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    # a sort-merge join: adaptive execution splits the partition of a digest with very many copies
    return rows.join(counts.hint("merge"), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "token-cache"))
