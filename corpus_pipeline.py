"""The corpus pipeline: stages from documents to packed windows, each written and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results, for every stage: an empty table gives an empty one; columns beyond those of documents pass through, whatever
their names are; null doc_ids and other null cells stay; texts of any length are taken whole; repeated rows are judged each.
What a stage does with null and empty texts, and with ties, its own docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm.common import keep
from tarn.llm.decontam import decontaminated
from tarn.llm.jaccard import distinct_documents
from tarn.llm.packing import pack
from tarn.llm.pii import redacted
from tarn.llm.quality import kept_documents
from tarn.llm.queries import table, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; null and empty texts, having too few words, are among them."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8. Equal rows are copies; of a group the
    smallest doc_id stays, nulls counting as the largest, and of one id the least key of the text. Texts without words stay."""
    return distinct_documents(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item's words in common passages, or more, go. Null and empty texts stay."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind's mark, overlapping ones one mark; n_chars follows. Null texts stay null."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, in windows. A null or empty text is its closing id; of pieces of one size the earlier comes first."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packing),
]
#: Tokenizing, tiling and boosted trees are beyond SQL; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
