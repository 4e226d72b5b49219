"""Host-level quality rules: failures of document rules are aggregated by host, rates are shrunk with an empirical beta
prior, and host verdicts are joined back to the documents. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, hot_join, stage

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
#: The rules whose failures are counted for each host: the contract's base rule, many symbols, many repeated lines.
RULES = ("base", "symbols", "lines")


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Symbols for each 10 words, repeated lines for each 10 lines with a word.
    max_symbols_of_10: int = 1
    max_lines_of_10: int = 3
    #: A host goes if the shrunken rate of any rule is above this percentage.
    max_host_percent: int = 50


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda total, x: total + x)


def repeat_words(words: Column) -> Column:
    """Words lying in 3-word windows that occur twice or more in the array.

    Windows are sorted as numbers that hold a hash above and the place below; only windows whose hash meets another are
    compared by their words, so the count is exact and costs a sort."""

    def window(w: Column, i: Column) -> Column:
        return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def same(e: Column, x: Column, j: Column) -> Column:
        return F.get(e, j)["w"] == x["w"]

    def counted(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        # room for the place: the hash keeps 64 - 20 bits, or 64 - 40 in texts of over a million words
        room = F.when(F.size(w) < (1 << 20), F.lit((1 << 20) - 1)).otherwise(F.lit((1 << 40) - 1)).cast("bigint")

        def meet(mask: Column) -> Column:
            packed = F.transform(places, lambda i: window(w, i).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("bigint")))
            return _let(F.sort_array(packed), lambda s: F.transform(F.filter(s, lambda x, j: near(s, x, j, mask)), lambda x: x.bitwiseAND(mask).cast("int")))

        def near(s: Column, x: Column, j: Column, mask: Column) -> Column:
            after = x.bitwiseXOR(F.get(s, j + 1)).bitwiseAND(F.bitwise_not(mask)) == 0
            before = x.bitwiseXOR(F.get(s, j - 1)).bitwiseAND(F.bitwise_not(mask)) == 0
            return F.coalesce(after, F.lit(False)) | ((j > 0) & F.coalesce(before, F.lit(False)))

        def exact(found: Column) -> Column:
            spelled = F.sort_array(F.transform(found, lambda i: F.struct(F.array(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("w"), i.alias("i"))))
            twice = _let(spelled, lambda e: F.transform(F.filter(e, lambda x, j: F.coalesce(same(e, x, j + 1), F.lit(False)) | ((j > 0) & F.coalesce(same(e, x, j - 1), F.lit(False)))), lambda x: x["i"]))
            return _let(F.sort_array(twice), lambda p: _sum(F.transform(p, lambda x, j: F.when(j == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, j - 1))).cast("bigint"))))

        return _let(_let(room, meet), exact)

    return F.when(F.size(words) < 4, F.lit(0).cast("bigint")).otherwise(counted(words))


def measures(docs: DataFrame, p: QualityParams = QualityParams(), keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, host, the counts of the base rule and the failures of each rule; `keep` names further columns to carry."""
    body = F.coalesce(F.col("text"), F.lit(""))
    # a null host is a host of its own
    base = docs.select(*[F.col(c).alias(f"_keep_{c}") for c in keep], F.col("doc_id"), F.col("source").alias("host"), body.alias("_t"), F.array_remove(F.split(F.translate(body, SPACES, " " * len(SPACES)), " +", -1), "").alias("_w"))
    lines = F.filter(F.split("_t", "\n", -1), lambda line: F.length(F.translate(line, SPACES, "")) > 0)
    full = base.select(
        *[F.col(f"_keep_{c}") for c in keep],
        "doc_id",
        "host",
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("all"), F.size(F.array_distinct(x)).cast("bigint").alias("own"))).alias("_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
    )
    return (
        full.withColumn("n_dup_lines", F.col("_lines.all") - F.col("_lines.own"))
        .withColumn("base_failed", (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > p.max_repeat_percent * F.col("n_words")))
        .withColumn("symbols_failed", 10 * F.col("n_symbols") > p.max_symbols_of_10 * F.col("n_words"))
        .withColumn("lines_failed", 10 * F.col("n_dup_lines") > p.max_lines_of_10 * F.col("_lines.all"))
        .drop("_lines")
    )


def host_verdicts(measured: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """host, n_docs, the shrunken rate of each rule and host_kept.

    The prior of each rule is a beta distribution fitted by moments over hosts of two or more documents. The moments are
    unbiased in the number of documents (k / n and k(k-1) / n(n-1)) and summed as whole millionths, so that no order of
    summation shows. Hosts that don't differ beyond chance get the common rate; without such hosts the prior is (1, 1).
    """
    counts = stage(measured.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.count_if(f"{r}_failed").alias(f"k_{r}") for r in RULES]), "hosts")
    n = F.col("n_docs").cast("double")
    first = lambda k: F.floor(F.col(k) / n * 1e6)
    second = lambda k: F.floor(F.col(k) / n * ((F.col(k) - 1) / (n - 1)) * 1e6)
    sums = counts.filter("n_docs >= 2").agg(F.count("*").alias("hosts"), *[F.sum(first(f"k_{r}")).alias(f"a_{r}") for r in RULES], *[F.sum(second(f"k_{r}")).alias(f"b_{r}") for r in RULES]).first()
    rates = []
    for r in RULES:
        a, b = beta_prior(sums["hosts"], sums[f"a_{r}"], sums[f"b_{r}"])
        rates.append(((F.col(f"k_{r}") + F.lit(a)) / (n + F.lit(a + b))).alias(f"rate_{r}"))
    rated = counts.select("host", "n_docs", *rates)
    kept = F.lit(True)
    for r in RULES:
        kept = kept & (F.col(f"rate_{r}") * 100 <= p.max_host_percent)
    return rated.withColumn("host_kept", kept)


def beta_prior(hosts: int, first: int | None, second: int | None) -> tuple[float, float]:
    """Parameters of the beta distribution with the moments first / hosts and second / hosts, in millionths."""
    if not hosts:
        return 1.0, 1.0
    m, s = first / 1e6 / hosts, second / 1e6 / hosts
    strength = (m - s) / (s - m * m) if s > m * m else 1e6
    strength = min(max(strength, 2.0), 1e6)
    return m * strength, (1 - m) * strength


def quality(docs: DataFrame, p: QualityParams = QualityParams(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Document measures with base_failed, host rates and kept = not base_failed and host_kept.

    Null and empty texts have no words and fail the base rule; a null host is a host of its own. Rows with equal doc_id
    are rows of their own. An empty table gives no rows. Columns other than doc_id, text, source and `keep` are not
    read, so clashing names don't matter.
    """
    measured = stage(measures(docs, p, keep), "quality").withColumn("_host", F.coalesce(F.concat(F.lit("h"), "host"), F.lit("")))
    hosts = host_verdicts(measured, p).withColumn("_host", F.coalesce(F.concat(F.lit("h"), "host"), F.lit(""))).drop("host")
    total = measured.count()
    joined = hot_join(measured, stage(hosts, "verdicts"), "_host", "n_docs", total)
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).drop("_host")


def kept_documents(docs: DataFrame, p: QualityParams = QualityParams()) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns. Rows equal in doc_id, text and source share their fate;
    null ids, texts and sources count as values of their own. What is staged are measures; the rows themselves meet the
    kept keys in one shuffle."""
    own = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)), F.xxhash64("text"), F.coalesce(F.concat(F.lit("h"), "source"), F.lit(""))]
    key, host = own[1].alias("_text"), F.coalesce(F.concat(F.lit("h"), "host"), F.lit("")).alias("_host")
    judged = quality(docs.select("doc_id", "text", "source", key), p, ("_text",)).filter("kept")
    kept = judged.select(own[0].alias("_doc"), F.col("_keep__text").alias("_text"), host).distinct()
    rows = docs.select(*[c.alias(n) for c, n in zip(own, ("_doc", "_text", "_host"), strict=True)], F.struct(*docs.columns).alias("_row"))
    return rows.join(kept.hint("merge"), ["_doc", "_text", "_host"], "left_semi").select("_row.*")


def op1_host_rules(spark, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_RATE = "((k_{r} + CASE WHEN hosts > 0 THEN m_{r} * g_{r} ELSE 1 END) / (n_docs + CASE WHEN hosts > 0 THEN m_{r} * g_{r} + (1 - m_{r}) * g_{r} ELSE 2 END)) * 100 <= 50"

OP1_SQL = f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: length(translate(x, ' ' || {_SPACE}, '')) > 0) AS l,
             row_number() OVER () AS r FROM t),
g AS (SELECT r, s, w[s + 1 : s + 3] AS g FROM w, unnest(range(greatest(len(w) - 2, 0))) AS x(s)),
twice AS (SELECT r, s FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, count(DISTINCT s + k) AS n FROM twice, unnest(range(3)) AS x(k) GROUP BY r),
m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, ' ' || {_SPACE}, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10 * n_symbols > n_words AS symbols_failed,
             10 * n_dup_lines > 3 * n_lines AS lines_failed FROM m),
h AS (SELECT source, count(*) AS n_docs, count_if(base_failed) AS k_base, count_if(symbols_failed) AS k_symbols, count_if(lines_failed) AS k_lines FROM f GROUP BY source),
s AS (SELECT count(*) AS hosts, {", ".join(f"sum(floor(CAST(k_{r} AS DOUBLE) / n_docs * 1e6)) / 1e6 / count(*) AS m_{r}, sum(floor(CAST(k_{r} AS DOUBLE) / n_docs * (CAST(k_{r} - 1 AS DOUBLE) / (n_docs - 1)) * 1e6)) / 1e6 / count(*) AS s_{r}" for r in RULES)}
      FROM h WHERE n_docs >= 2),
q AS (SELECT *, {", ".join(f"least(greatest(CASE WHEN s_{r} > m_{r} * m_{r} THEN (m_{r} - s_{r}) / (s_{r} - m_{r} * m_{r}) ELSE 1e6 END, 2.0), 1e6) AS g_{r}" for r in RULES)} FROM s),
v AS (SELECT source, {" AND ".join(_RATE.format(r=r) for r in RULES)} AS host_kept FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
