"""Corpus cleaning as a chain of stages, each written and read again before the next.

Stages take (spark, docs, sf_dir) and return a DataFrame. All but the last return the columns of documents:
the quality network drops what it rejects, line dedup empties later copies of long repeated runs, the set join
keeps one document of each group, and decontamination drops documents with benchmark windows. The last one
returns doc_id, ids (binary token ids) and n_tokens.

Defined cases: a null text is kept as one by all stages (the network scores it as an empty one) and has no tokens. Rows of
one id stay or go together in the set join; rows equal in id and text get equal results everywhere. Ties go to the smaller
id, and within an id to the text's hash. An empty table runs through to an empty result. Texts of any length are read whole, and
columns besides doc_id and text stay as they are, whatever their names, until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewise.llm import byte_bpe, decontaminate, line_dedup, quality, set_join
from cratewise.llm.common import materialise, read

KEEP_AT = 0.7


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    network = quality.fit(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return quality.keep(docs, network, KEEP_AT)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.remove(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return set_join.keep_one(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    encoded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_filter),
    ("byte-level BPE", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
