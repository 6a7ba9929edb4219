"""A corpus, cleaned: quality rules, near duplicates, secrets, the mix of sources, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from narrata.llm import jaccard, mixing, packing, quality, secrets
from narrata.llm.common import stash
from narrata.llm.queries import TOKENIZER

#: The column that carries the mix from its stage to packing.
POSITION = "mix_position"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled cutoff reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, one stays."""
    return jaccard.keep_one(docs, jaccard.Likeness(5, 80))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are put out of the texts."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mix, with their positions in it."""
    return mixing.in_mix_order(docs, at=POSITION)


def best_two_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens with their places in sequences, which follow the mix."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), at=POSITION if POSITION in docs.columns else None)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("best-fit packing", best_two_fit),
]
#: Thresholds from binomial bounds, hashes and tokens aren't expressible; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage-{k}")
    return docs
