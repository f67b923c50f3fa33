"""A corpus pipeline of four operators; each stage reads what the one before kept.

Toxic documents go, then those that the quality rules reject, then all but one of each group of
near duplicates; the rest is packed into token sequences.  Every stage but the last returns the
columns of ``documents``.  Each result is written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from iontide.llm.bpe_encoding import tokenizer_path
from iontide.llm.jaccard_join import near_duplicates_stage
from iontide.llm.packing import TOKENIZER, pack
from iontide.llm.quality_rules import quality_stage
from iontide.llm.storage import Stored, read
from iontide.llm.toxicity import toxicity_stage


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality rules", quality_stage),
    ("n-gram jaccard join", near_duplicates_stage),
    ("packing", packing_stage),
]

#: The stages are trained models, sampled joins and tokenizers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    stored = None
    for name, stage in STAGES:
        before, stored = stored, Stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        docs = stored.frame
        if before:
            before.discard()
    return docs
