"""Deterministic adapters from the star-schema tables to the engine's samples, calls and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    place = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*ORDER)) - 1
    return lines.withColumn("i", place.cast("bigint")).withColumnRenamed("l_suppkey", "trace_id")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, i and four channels g, a, t, c of whole numbers."""
    return _lines(spark, sf_dir).select(
        "trace_id",
        "i",
        F.col("l_quantity").alias("g"),
        F.floor(F.col("l_extendedprice") / 2000).cast("double").alias("a"),
        F.round(F.col("l_discount") * 500).cast("double").alias("t"),
        F.round(F.col("l_tax") * 600).cast("double").alias("c"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, ordinal, pos and the fields of a base call."""
    return _lines(spark, sf_dir).select(
        "trace_id",
        F.col("i").alias("ordinal"),
        (F.col("i") * 12 + F.col("l_quantity").cast("bigint") % 7).alias("pos"),
        F.when(F.col("l_tax") == 0, "N").otherwise(F.substring(F.lit("GATC"), (F.col("l_linenumber") % 4 + 1).cast("int"), 1)).alias("letter"),
        (5 + F.col("l_quantity").cast("int") % 36).alias("phred"),
        (1 + F.col("l_extendedprice") / 5000).alias("snr"),
        (1 + F.col("l_discount") * 5).alias("isolation"),
        (F.col("l_tax") * 10).alias("shape_score"),
        (1 - F.col("l_discount") * 10).alias("spacing_score"),
        (F.col("l_returnflag") == "R").alias("tail_rescued"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("imputed"),
        (F.col("l_discount") >= 0.09).alias("heterozygote"),
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the letters ACGTN of each document's text in upper case."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGTN]", "").alias("seq"))


_PLACE = "row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1"

#: The same in DuckDB, as common table expressions.
SQL_SAMPLES = f"""samples AS (SELECT l_suppkey AS trace_id, {_PLACE} AS i, l_quantity AS g, CAST(floor(l_extendedprice / 2000) AS DOUBLE) AS a,
 CAST(round(l_discount * 500) AS DOUBLE) AS t, CAST(round(l_tax * 600) AS DOUBLE) AS c FROM lineitem)"""
SQL_LONG = SQL_SAMPLES + """, long AS (SELECT trace_id, 0 AS ch, i, g AS y FROM samples UNION ALL SELECT trace_id, 1, i, a FROM samples
 UNION ALL SELECT trace_id, 2, i, t FROM samples UNION ALL SELECT trace_id, 3, i, c FROM samples)"""
SQL_CALLS = f"""lines AS (SELECT *, {_PLACE} AS i FROM lineitem),
calls AS (SELECT l_suppkey AS trace_id, i AS ordinal, i * 12 + CAST(l_quantity AS BIGINT) % 7 AS pos,
 CASE WHEN l_tax = 0 THEN 'N' ELSE substr('GATC', l_linenumber % 4 + 1, 1) END AS letter, 5 + CAST(l_quantity AS INT) % 36 AS phred,
 1 + l_extendedprice / 5000 AS snr, 1 + l_discount * 5 AS isolation, l_tax * 10 AS shape_score, 1 - l_discount * 10 AS spacing_score,
 l_returnflag = 'R' AS tail_rescued, l_returnflag = 'R' AND l_linestatus = 'F' AS imputed, l_discount >= 0.09 AS heterozygote FROM lines)"""
SQL_SEQS = "seqs AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS seq FROM documents)"
