"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last
return the columns of ``documents``. Rows that share a doc_id are one document: a filter keeps or
drops them together. No stage can be written as SQL that gives the same rows (a fitted forest,
raked probabilities, BPE ids), so ORACLE_SQL is None and tests compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspan.llm.common import read
from longspan.llm.mixing import mix
from longspan.llm.ngram_jaccard import jaccard_components
from longspan.llm.packing import pack
from longspan.llm.quality_rules import quality_rules
from longspan.llm.queries import workers_find_package
from longspan.llm.substring_dedup import remove_repeated_spans
from longspan.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
NEAR_WORDS = 5
NEAR_PERCENT = 80


def _only(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents whose id, which may be NULL, is among the chosen ones."""
    ids = chosen.select(F.col("doc_id").alias("chosen_id")).distinct()
    own = docs.select(*COLUMNS)
    return own.join(ids, own["doc_id"].eqNullSafe(ids["chosen_id"]), "left_semi")


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    workers_find_package(spark)
    return _only(docs, quality_rules(docs, read(spark, sf_dir, "labels")).where("kept"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplicate links join, the one with the smallest id stays.

    Near copies have a Jaccard of 0.8 over five words; the three words and 0.9 of op6 are that query's contract.
    """
    workers_find_package(spark)
    return _only(docs, jaccard_components(docs, n=NEAR_WORDS, percent=NEAR_PERCENT).where("component_id <=> doc_id"))


def without_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what an earlier document says; all documents stay, untouched texts as they are."""
    workers_find_package(spark)
    kept = remove_repeated_spans(docs, carry=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("kept_text").isNull(), F.col("text")).otherwise(F.col("kept_text"))
    n_chars = F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw of the documents with raked probabilities."""
    workers_find_package(spark)
    return _only(docs, mix(docs).where("sampled"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in training sequences."""
    workers_find_package(spark)
    return pack(docs)


STAGES = [
    ("quality_rules", by_quality),
    ("ngram_jaccard_join", one_of_near_copies),
    ("substring_dedup", without_repeated_spans),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
