"""A corpus pipeline: five stages, each an operator of ``gaugeworks.llm``.

A stage takes the documents that its predecessor kept, all of them, and returns a
DataFrame that is written as Parquet and read again as the next one's documents.

In every stage null and empty texts count as texts without words: they are neither toxic,
contaminated nor copies of anything, have no ids, and are judged for quality as one empty
passage.  Rows with a null id are treated as any other and are never near duplicates.  Equal
rows fare alike, but for near duplicates, where one is kept.  Texts of any length are read
whole, other columns stay as they are, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, chosen_path, fm_index, mil, toxicity
from gaugeworks.llm.common import free_name, persist, table
from gaugeworks.llm.queries import quality_model, tokenizer_path, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 for toxicity."""
    return toxicity.drop_toxic(docs, toxicity_model(spark, sf_dir, docs))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more for quality."""
    return mil.keep_good(docs, quality_model(spark, sf_dir, docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of similar ones."""
    return chosen_path.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows."""
    return fm_index.drop_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents' ids in place of their texts, with their number.  Where a column has one of
    the new names already, in whatever case, the new one gets an underscore behind it."""
    ids = free_name(docs, "token_ids")
    out = bpe.encode_documents(docs, tokenizer_path(), ids_col=ids)
    return out.select("*", F.size(ids).alias(free_name(docs, "n_tokens")))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL can express neither the learned filters nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = persist(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
