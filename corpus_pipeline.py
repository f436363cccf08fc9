"""From raw documents to packed training sequences: filter, deduplicate, mask personal data, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lossgauge.llm import exact_dedup, packing, pii, quality_rules, simhash
from lossgauge.llm.common import documents
from lossgauge.llm.queries import MASKING_KEY, tokenizer
from lossgauge.session import stable


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality_rules.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.keep_first_of_each(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    return packing.pack(docs, tokenizer(), end_id=1)


def stages(masking_key: bytes) -> list[tuple]:
    """The stages in their order. The key makes the surrogates: a job takes it from its secret store."""

    def masking_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        """Personal data gives way to surrogates; all documents stay."""
        return pii.mask(docs, masking_key)

    return [
        ("quality rules", quality_stage),
        ("exact dedup", exact_stage),
        ("SimHash near-dedup", near_stage),
        ("PII", masking_stage),
        ("packing", packing_stage),
    ]


# with the key of the test tables
STAGES = stages(MASKING_KEY)

# fingerprints, keyed digests and a tokenizer are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, masking_key: bytes = MASKING_KEY) -> DataFrame:
    """All stages in order. Each result is stored as Parquet and read again as the next stage's documents.

    The default key is that of the test tables: whoever knows it can make the same surrogates.
    """
    made = documents(spark, sf_dir)
    for _, stage in stages(masking_key):
        made = stable(stage(spark, made, sf_dir))
    return made
