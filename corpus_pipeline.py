"""Corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination, PII sanitisation, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Defined cases: null and empty texts fail the quality rules; of rows that repeat both id and text one stays from the
near-duplicate stage on; extra columns pass through all stages but the last with their values, whatever their names; empty
tables give no rows.  Tables that a stage writes on its way are deleted when its rows have been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.cascade import cascade
from driftloom.llm.common import delete_dir, quoted, read_table, scratch, shared_dir, unused
from driftloom.llm.decontam import without_contaminated
from driftloom.llm.neardup import one_of_each
from driftloom.llm.packing import pack_documents
from driftloom.llm.pii import sanitise

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    kept = unused(docs.columns, "__dl_") + "kept"
    return cascade(docs, counts=False, kept_col=kept).where(kept).drop(kept)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies (five-word shingles, similarity 0.8 or more) stays: the one whose id names it."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copied or edited benchmark item go."""
    return without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pii_sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that give it away are replaced in the text; n_chars follows the text."""
    spans = unused(docs.columns, "__dl_") + "spans"
    clean = sanitise(docs, replace=True, spans_col=spans).withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*map(quoted, docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii_sanitisation", pii_sanitisation),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet in the shared folder and read by the next."""
    docs, earlier = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = shared_dir(spark)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if earlier:
            delete_dir(spark, earlier)
        earlier = path
    return docs
