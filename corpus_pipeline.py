"""A pipeline over documents: quality rules, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes all documents that the one before it kept. All but the last return the columns of documents; they
leave out rejected rows or rewrite texts. The packed pieces are the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import LAST_ID, release, stage, unstage
from lanewise.llm.decontaminate import clean_documents
from lanewise.llm.jaccard import JaccardJoin
from lanewise.llm.packing import pack
from lanewise.llm.pii import redact
from lanewise.llm.quality import kept_documents

#: None: the packing's tokens can't be computed in SQL. The tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict keep. Null and empty texts go; a null source is a host of its own;
    rows equal in doc_id, text and source share their fate."""
    return kept_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one of smallest doc_id (a null one is larger than all), of
    these the one of smallest text key. Every text without words stays, also those of null or equal ids."""
    kept = stage(JaccardJoin(docs).firsts(), "kept")
    release(spark)
    keys = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("_doc"), F.xxhash64("text").alias("_text"), F.struct(*docs.columns).alias("_row"))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # rows of equal id and text are one document
    ones = keys.join(kept.hint("merge"), ["_doc", "_text"], "left_semi").dropDuplicates(["_doc", "_text"])
    return ones.select("_row.*").unionByName(docs.filter(~words))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth. Each row is judged by its own text; null and empty
    texts stay."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind. Null texts stay null; repeated rows all stay."""
    return redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, packed. A null or empty text is the end id alone; repeated rows are documents of their
    own."""
    return pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents; a stage's table goes when the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES[:-1]):
        done = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            unstage(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
