"""parse_blast_text(report): the hits of a text report as a table function for SQL. In DataFrame code text_hits() does the
same without Python."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .parse import COVER, IDENTITY, MARK

COLUMNS = "rank int, accession string, description string, score double, evalue string, identity_pct int, query_cover_pct int"
#: A row of the table: a name, any words, a number and an expectation.
ROW = re.compile(r"^[ \t]*(\S+)(.*?)[ \t](?=\S+[ \t]+\S+[ \t\r]*$)([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)[ \t]+(\S+)[ \t\r]*$", re.MULTILINE)


class TextHits:
    def eval(self, report: str) -> Iterator[tuple]:
        text = report or ""
        same, cover = (iter(re.findall(p, text)) for p in (IDENTITY, COVER))
        start = text.find(MARK)
        first = text.find("\n", start) + 1 if start >= 0 else 0
        top = ROW.search(text, first) if first else None
        if top:
            blank = re.compile(r"^[ \t\r]*$", re.MULTILINE).search(text, top.end())
            end = blank.start() if blank else len(text)
            for rank, (name, about, score, chance) in enumerate(ROW.findall(text[:end], first), 1):
                numbers = [None if (x := next(found, None)) is None else int(x) for found in (same, cover)]
                yield rank, name, " ".join(about.split()), float(score), chance, *numbers


def register(spark: SparkSession) -> None:
    spark.udtf.register("parse_blast_text", udtf(TextHits, returnType=COLUMNS))
