"""Crosstalk matrix files."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import SparkSession

#: Names under which a matrix may lie beside a trace, in the order in which they are tried.
NAMES = ("matrix.csv", "crosstalk.csv", "crosstalk_matrix.csv", "influence_matrix.csv")


def parse_matrix(text: str) -> np.ndarray:
    """The top left 4 x 4 numbers, separated by semicolons, commas, tabs or white space (tried in this order); '#' starts a
    comment."""
    lines = [line for raw in text.splitlines() if (line := raw.split("#")[0].rstrip("\r\n")).strip()]
    for mark in (r"\s*;\s*", r"\s*,\s*", r"\t", r"\s+"):
        try:
            rows = [[float(x) for x in re.split(mark, line.strip()) if x != ""] for line in lines]
        except ValueError:
            continue
        if len(rows) >= 4 and len({len(r) for r in rows}) == 1 and len(rows[0]) >= 4:
            return np.array(rows)[:4, :4]
    raise ValueError("no 4 x 4 matrix of numbers")


def read_matrix(spark: SparkSession, path: str) -> np.ndarray:
    """A matrix file, read where Spark reads."""
    return parse_matrix(spark.read.text(path, wholetext=True).first()[0])


def beside(spark: SparkSession, trace: str) -> np.ndarray | None:
    """The first matrix beside a trace that parses."""
    folder = trace.rsplit("/", 1)[0]
    for name in NAMES:
        try:
            return read_matrix(spark, f"{folder}/{name}")
        except Exception:  # missing or not a matrix: the next name is tried
            continue
    return None
