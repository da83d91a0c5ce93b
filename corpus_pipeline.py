"""Corpus pipeline over ``documents``: five operators, each stage's table written and read as the next one's input.

Rows with a null doc_id can't be named by a near-duplicate class and stay. Rows that share a doc_id share the fate of
that document in the near-duplicate and benchmark stages. Null texts are empty texts; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from livetext.llm.common import table, written
from livetext.llm.decontaminate import decontaminate
from livetext.llm.packing import pack
from livetext.llm.pii import key_of, replace_entities
from livetext.llm.simhash import near_copy_components
from livetext.llm.toxicity import THRESHOLD, score_documents


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the last category is below the threshold."""
    mark = unused(docs, "__toxicity")
    scored = score_documents(spark, docs, sf_dir, mark)
    return scored.filter(F.col(mark)["toxic"] < THRESHOLD).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies."""
    found = near_copy_components(docs)
    kept = written(found.filter("doc_id = component_id").select("doc_id").distinct(), "kept-ids")
    named = docs.filter(F.col("doc_id").isNotNull()).join(kept.hint("merge"), docs["doc_id"] == kept["doc_id"], "left_semi")
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = replace_entities(docs, key_of(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", replace_pii),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}-{name}")
    return docs
