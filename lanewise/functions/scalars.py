"""Scores, qualities and sequence functions as column expressions, and their registration for SQL."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..schema import LETTERS


def unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def phred_score(snr: Column, isolation: Column, shape: Column, spacing: Column, place: Column) -> Column:
    """Phred-style quality from signal-to-noise, isolation, shape, spacing and the place in the trace (0 to 1)."""
    base = F.least(F.greatest(20.0 * F.log10(F.greatest(snr, F.lit(1.0))) + 18.0, F.lit(0.0)), F.lit(40.0))
    alone = F.when(isolation < 1.05, 3.0).when(isolation < 1.25, 1.5 * (1.25 - isolation) / 0.2).otherwise(0.0)
    late = F.when(place > 0.88, 6.0 * (place - 0.88) / 0.12).when(place > 0.75, 2.5 * (place - 0.75) / 0.13).otherwise(0.0)
    left = base - alone - 1.5 * (1.0 - unit(shape)) - 1.0 * (1.0 - unit(spacing)) - late
    return F.least(F.greatest(F.bround(left, 0), F.lit(5.0)), F.lit(40.0)).cast("int")


def raw_score(snr: Column, isolation: Column, shape: Column, spacing: Column) -> Column:
    """A score of up to 99 of four capped parts."""
    clear = F.least(40.0 * F.log10(F.greatest(snr, F.lit(0.01)) + 1.0) / F.log10(F.lit(11.0)), F.lit(40.0))
    alone = F.least(25.0 * F.log10(F.greatest(isolation, F.lit(1.0))) / F.log10(F.lit(5.0)), F.lit(25.0))
    return F.least(clear + alone + 20.0 * unit(shape) + 14.0 * unit(spacing), F.lit(99.0))


def late_thresholds(place: Column, min_snr: float, min_isolation: float) -> tuple[Column, Column]:
    """Thresholds of signal-to-noise and isolation, which relax over the last 40 % of a trace."""
    t = (place - 0.6) / 0.4
    snr = F.when(place > 0.6, F.greatest(min_snr * (1.0 - 0.4 * t), F.lit(0.8))).otherwise(F.lit(min_snr))
    isolation = F.when(place > 0.6, F.greatest(min_isolation - 0.25 * t, F.lit(1.05))).otherwise(F.lit(min_isolation))
    return snr, isolation


def rescued(snr: Column, isolation: Column, spacing: Column, min_snr: float, min_isolation: float) -> Column:
    """A call that fails both plain thresholds, or whose spacing is poor."""
    return ((snr < min_snr) & (isolation < min_isolation)) | (spacing < 0.25)


def downgraded(phred: Column, score: Column, is_rescued: Column) -> tuple[Column, Column]:
    return F.when(is_rescued, F.greatest(F.lit(5), F.floor(phred / 2).cast("int"))).otherwise(phred), F.when(is_rescued, score * 0.5).otherwise(score)


def isolation_ratio(g: Column, a: Column, t: Column, c: Column) -> Column:
    ranked = F.sort_array(F.array(g, a, t, c), asc=False)
    return F.get(ranked, F.lit(0)) / (F.get(ranked, F.lit(1)) + 1e-9)


def argmax(g: Column, a: Column, t: Column, c: Column) -> Column:
    """Channel of the largest value; the first of equals."""
    return (F.array_position(F.array(g, a, t, c), F.greatest(g, a, t, c)) - 1).cast("int")


def heterozygote(g: Column, a: Column, t: Column, c: Column, threshold: float = 0.45) -> Column:
    """struct(heterozygote, het_channel, het_ratio) of the second-largest channel; of equals the larger number first."""
    ranked = F.sort_array(F.array(*[F.struct(y.alias("y"), F.lit(n).alias("n")) for n, y in enumerate((g, a, t, c))]), asc=False)
    one, two = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    ratio = two["y"] / (one["y"] + 1e-9)
    yes = (one["y"] > 0) & (ratio >= threshold)
    return F.struct(yes.alias("heterozygote"), F.when(yes, two["n"]).otherwise(-1).alias("het_channel"), F.when(yes, ratio).otherwise(0.0).alias("het_ratio"))


def called_letter(channel: Column, is_rescued: Column, allow_uncertain: bool = True) -> Column:
    letter = F.substring(F.lit(LETTERS), (channel + 1).cast("int"), 1)
    return letter if allow_uncertain else F.when(is_rescued, "N").otherwise(letter)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgtNn", "TGCAtgcaNn"))


def trim_n(seq: Column) -> Column:
    return F.btrim(seq, F.lit("N"))


def trim_primer(seq: Column, primer: str, mismatches: int = 2, limit: int = 80) -> Column:
    """struct(sequence, cut): what follows the best place of the primer among the first `limit`; N matches anything."""
    size, primer = len(primer), primer.upper()
    kept = F.struct(seq.alias("sequence"), F.lit(0).alias("cut"))
    if not primer:
        return kept
    starts = F.least(F.length(seq) - size + 1, F.lit(limit))

    def best(letters: Column) -> Column:
        """Fewest mismatches and where, over the letters that any start can reach."""

        def missed(i: Column) -> Column:
            parts = [F.when(F.get(letters, i + k).isin(p, "N"), 0).otherwise(1) for k, p in enumerate(primer) if p != "N"]
            return sum(parts[1:], parts[0]) if parts else F.lit(0)

        return F.array_min(F.transform(F.sequence(F.lit(0), starts - 1), lambda i: F.struct(missed(i).alias("n"), i.alias("i"))))

    taken = lambda b: F.when(b["n"] <= mismatches, F.struct(F.substr(seq, b["i"] + size + 1).alias("sequence"), (b["i"] + size).alias("cut"))).otherwise(kept)
    once = lambda value, of: F.get(F.transform(F.array(value), of), F.lit(0))
    letters = F.split(F.upper(F.substring(seq, 1, limit + size - 1)), "", -1)
    # each value is bound once, so neither the letters nor the search is worked out for each of its uses
    return F.when(starts > 0, once(once(letters, best), taken)).otherwise(kept)


def wrapped(seq: Column, width: int = 80) -> Column:
    """Lines of `width` letters, each ended by a line feed."""
    return F.regexp_replace(seq, f"(.{{1,{width}}})", "$1\n")


def one_decimal(x: Column) -> Column:
    """Fixed one decimal, rounded half to even on the exact binary value."""
    return F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def quality_letters(phred: Column) -> Column:
    """Phred+33 letters of an array of qualities."""
    return F.array_join(F.transform(phred, lambda q: F.char(q + 33)), "")


def readiness(identity: Column, length: Column) -> Column:
    """green, amber or red."""
    return F.when((identity >= 95) & (length >= 200), "green").when((identity >= 85) | (length >= 100), "amber").otherwise("red")


def hit_band(identity: Column) -> Column:
    """Display band of a hit's identity."""
    return F.when(identity >= 99, "best").when(identity >= 95, "good").when(identity < 80, "poor").otherwise("plain")


#: Functions for SQL text; CREATE FUNCTION keeps them expressions that the optimizer sees through.
SQL_FUNCTIONS = {
    "reverse_complement(s STRING) RETURNS STRING": "reverse(translate(s, 'ACGTacgtNn', 'TGCAtgcaNn'))",
    "trim_n(s STRING) RETURNS STRING": "trim(BOTH 'N' FROM s)",
    "error_probability(q DOUBLE) RETURNS DOUBLE": "pow(10, -q / 10)",
    "readiness(identity DOUBLE, length BIGINT) RETURNS STRING": "CASE WHEN identity >= 95 AND length >= 200 THEN 'green' WHEN identity >= 85 OR length >= 100 THEN 'amber' ELSE 'red' END",
    "hit_band(identity DOUBLE) RETURNS STRING": "CASE WHEN identity >= 99 THEN 'best' WHEN identity >= 95 THEN 'good' WHEN identity < 80 THEN 'poor' ELSE 'plain' END",
    "one_decimal(x DOUBLE) RETURNS STRING": "replace(format_number(x, 1), ',', '')",
    "file_stem(path STRING) RETURNS STRING": r"regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1)",
    "isolation_ratio(g DOUBLE, a DOUBLE, t DOUBLE, c DOUBLE) RETURNS DOUBLE": "sort_array(array(g, a, t, c), false)[0] / (sort_array(array(g, a, t, c), false)[1] + 1e-9)",
    "raw_score(snr DOUBLE, isolation DOUBLE, shape DOUBLE, spacing DOUBLE) RETURNS DOUBLE": "least(least(40 * log10(greatest(snr, 0.01D) + 1) / log10(11), 40D) + least(25 * log10(greatest(isolation, 1D)) / log10(5), 25D) + 20 * least(greatest(shape, 0D), 1D) + 14 * least(greatest(spacing, 0D), 1D), 99D)",
    "phred_score(snr DOUBLE, isolation DOUBLE, shape DOUBLE, spacing DOUBLE, place DOUBLE) RETURNS INT": "cast(least(greatest(bround(least(greatest(20 * log10(greatest(snr, 1D)) + 18, 0D), 40D)"
    " - CASE WHEN isolation < 1.05 THEN 3D WHEN isolation < 1.25 THEN 1.5D * (1.25D - isolation) / 0.2D ELSE 0D END - 1.5D * (1 - least(greatest(shape, 0D), 1D)) - (1 - least(greatest(spacing, 0D), 1D))"
    " - CASE WHEN place > 0.88 THEN 6 * (place - 0.88D) / 0.12D WHEN place > 0.75 THEN 2.5D * (place - 0.75D) / 0.13D ELSE 0D END, 0), 5D), 40D) AS INT)",
    "late_min_snr(place DOUBLE, min_snr DOUBLE) RETURNS DOUBLE": "CASE WHEN place > 0.6 THEN greatest(min_snr * (1 - 0.4D * ((place - 0.6D) / 0.4D)), 0.8D) ELSE min_snr END",
    "late_min_isolation(place DOUBLE, min_isolation DOUBLE) RETURNS DOUBLE": "CASE WHEN place > 0.6 THEN greatest(min_isolation - 0.25D * ((place - 0.6D) / 0.4D), 1.05D) ELSE min_isolation END",
    "called_letter(channel INT, rescued BOOLEAN, allow_uncertain BOOLEAN) RETURNS STRING": "CASE WHEN rescued AND NOT allow_uncertain THEN 'N' ELSE substring('GATC', channel + 1, 1) END",
    "heterozygote(g DOUBLE, a DOUBLE, t DOUBLE, c DOUBLE, threshold DOUBLE) RETURNS STRUCT<heterozygote: BOOLEAN, het_channel: INT, het_ratio: DOUBLE>": "get(transform(array(sort_array(array(struct(g AS y, 0 AS n), struct(a AS y, 1 AS n), struct(t AS y, 2 AS n), struct(c AS y, 3 AS n)), false)),"
    " r -> CASE WHEN r[0].y > 0 AND r[1].y / (r[0].y + 1e-9D) >= threshold THEN named_struct('heterozygote', true, 'het_channel', r[1].n, 'het_ratio', r[1].y / (r[0].y + 1e-9D)) ELSE named_struct('heterozygote', false, 'het_channel', -1, 'het_ratio', 0D) END), 0)",
    "trim_primer(seq STRING, primer STRING) RETURNS STRUCT<sequence: STRING, cut: INT>": "get(transform(array(array_min(transform(CASE WHEN primer <> '' AND length(seq) >= length(primer) THEN sequence(0, least(length(seq) - length(primer), 79)) ELSE array() END,"
    " i -> struct(size(filter(zip_with(split(upper(primer), '', -1), split(upper(substring(seq, i + 1, length(primer))), '', -1), (p, s) -> p <> 'N' AND p <> s AND s <> 'N'), x -> x)) AS n, i AS i)))),"
    " b -> CASE WHEN b.n <= 2 THEN named_struct('sequence', substring(seq, b.i + length(primer) + 1), 'cut', b.i + length(primer)) ELSE named_struct('sequence', seq, 'cut', 0) END), 0)",
}


def register(spark: SparkSession) -> None:
    """Make the functions callable from spark.sql()."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
