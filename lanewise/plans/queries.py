"""The registered queries over the test tables, each with its SQL for DuckDB (None where SQL can't say it)."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import scalars as S
from ..operators import calls as C
from ..operators import matrices as M
from ..operators import samples as P
from ..operators import traces as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A fixed crosstalk matrix for the queries, and shifts.
CROSSTALK = ((1.0, 0.25, 0.1, 0.05), (0.2, 1.0, 0.15, 0.1), (0.05, 0.1, 1.0, 0.3), (0.1, 0.05, 0.2, 1.0))
SHIFTS = (0, 1, -1, 2)
PRIMER = "GACTN"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Calls

_SEGMENT = """
SELECT trace_id, {k} AS k, count(*) AS n, avg(phred) AS mean, min({{'loss': m - s, 'last': ordinal, 'start': a}}) AS best FROM (
 SELECT *, max(CASE WHEN b = m THEN ordinal END) OVER w AS a FROM (
  SELECT *, min(b) OVER w AS m FROM (
   SELECT *, s - (phred - {q}) AS b FROM (SELECT trace_id, ordinal, phred, sum(phred - {q}) OVER w AS s FROM calls WINDOW w AS (PARTITION BY trace_id ORDER BY ordinal))
  ) WINDOW w AS (PARTITION BY trace_id ORDER BY ordinal)
 ) WINDOW w AS (PARTITION BY trace_id ORDER BY ordinal)
) GROUP BY trace_id"""


def _segments(*thresholds: float) -> str:
    union = " UNION ALL ".join(_SEGMENT.format(k=k, q=q) for k, q in enumerate(thresholds))
    return f"""raw AS ({union}),
seg AS (SELECT trace_id, k, n, CASE WHEN n < 20 OR best.loss >= 0 THEN 0 ELSE best.start END AS a,
 CASE WHEN n < 20 THEN CASE WHEN mean >= [{", ".join(map(str, thresholds))}][k + 1] THEN n ELSE 0 END WHEN best.loss >= 0 THEN 0 ELSE best.last + 1 END AS b FROM raw)"""


_LADDER = _segments(*C.LADDER) + """, win AS (SELECT trace_id, coalesce(min({'k': k, 'a': a, 'b': b}) FILTER (WHERE b - a >= 150), {'k': 9, 'a': 0, 'b': any_value(n)}) AS w FROM seg GROUP BY trace_id),
blast AS (SELECT trace_id, CAST(w.a AS BIGINT) AS blast_start, CAST(w.b AS BIGINT) AS blast_end FROM win)"""


@query("kadane_trim", f'WITH {A.SQL_CALLS}, {_segments(20.0)} SELECT trace_id, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end" FROM seg')
def kadane_trim(spark, sf_dir):
    return C.window_trim(A.calls(spark, sf_dir))


@query("blast_window", f"WITH {A.SQL_CALLS}, {_LADDER} SELECT * FROM blast")
def blast_window(spark, sf_dir):
    return C.search_window(A.calls(spark, sf_dir))


_ENDS = 'SELECT trace_id, coalesce(min(ordinal) FILTER (WHERE phred >= 15), 0) AS start, coalesce(max(ordinal) FILTER (WHERE phred >= 15) + 1, 0) AS "end" FROM calls GROUP BY trace_id'


@query("trim_ends", f"WITH {A.SQL_CALLS} {_ENDS}")
def trim_ends(spark, sf_dir):
    return C.end_trim(A.calls(spark, sf_dir))


_STATS = f"""stats AS (SELECT trace_id, count(*) AS total_bases, count_if(sure) AS confirmed_bases, count_if(tail_rescued AND NOT imputed) AS tail_rescued, count_if(imputed) AS imputed_bases,
 count_if(heterozygote) AS heterozygote_bases, coalesce(avg(phred) FILTER (WHERE sure), 0) AS mean_phred, CAST(coalesce(median(phred) FILTER (WHERE sure), 0) AS DOUBLE) AS median_phred,
 coalesce(min(phred) FILTER (WHERE sure), 0) AS min_phred, coalesce(max(phred) FILTER (WHERE sure), 0) AS max_phred,
 count_if(sure AND phred >= 20) AS q20_count, count_if(sure AND phred >= 30) AS q30_count, count_if(sure AND phred >= 35) AS q35_count,
 coalesce(avg(snr) FILTER (WHERE sure), 0) AS mean_snr, coalesce(avg(isolation) FILTER (WHERE sure), 0) AS mean_isolation, coalesce(avg(shape_score) FILTER (WHERE sure), 0) AS mean_shape_score
 FROM (SELECT *, NOT tail_rescued AND NOT imputed AS sure FROM calls) GROUP BY trace_id),
est AS (SELECT trace_id, 100 * avg(1 - pow(10, -phred / 10.0)) AS blast_est_identity FROM calls JOIN blast USING (trace_id) WHERE ordinal >= blast_start AND ordinal < blast_end GROUP BY trace_id)"""
_TRIM = _segments(20.0).replace("raw AS", "raw20 AS").replace("seg AS", "seg20 AS").replace("FROM raw)", "FROM raw20)")


@query("quality_stats", f"""WITH {A.SQL_CALLS}, {_LADDER}, {_TRIM}, {_STATS}
SELECT trace_id, total_bases, confirmed_bases, tail_rescued, imputed_bases, heterozygote_bases, CAST(b - a AS BIGINT) AS window_trimmed_len, blast_end - blast_start AS blast_window_len, blast_start, blast_end,
 round(blast_est_identity, 6) AS blast_est_identity, blast_end - blast_start >= 100 AS blast_ready, round(mean_phred, 6) AS mean_phred, median_phred, min_phred, max_phred, q20_count, q30_count, q35_count,
 {", ".join(f"round(CASE WHEN confirmed_bases > 0 THEN 100.0 * q{q}_count / confirmed_bases ELSE 0 END, 6) AS pct_q{q}" for q in (20, 30, 35))},
 round(mean_snr, 6) AS mean_snr, round(mean_isolation, 6) AS mean_isolation, round(mean_shape_score, 6) AS mean_shape_score
FROM stats JOIN blast USING (trace_id) JOIN seg20 USING (trace_id) JOIN est USING (trace_id)""")
def quality_stats(spark, sf_dir):
    return rounded(C.quality_stats(A.calls(spark, sf_dir)))


@query("readiness", f"""WITH {A.SQL_CALLS}, {_LADDER}, {_STATS} SELECT trace_id, round(blast_est_identity, 6) AS blast_est_identity, blast_end - blast_start AS blast_window_len,
 CASE WHEN blast_est_identity >= 95 AND blast_end - blast_start >= 200 THEN 'green' WHEN blast_est_identity >= 85 OR blast_end - blast_start >= 100 THEN 'amber' ELSE 'red' END AS readiness FROM est JOIN blast USING (trace_id)""")
def readiness(spark, sf_dir):
    return rounded(C.readiness_of(C.quality_stats(A.calls(spark, sf_dir))))


_UNIT = "least(greatest({0}, 0), 1)"
_SCORES = f"""scored AS (SELECT trace_id, ordinal, snr, isolation, spacing_score,
 least(greatest(round_even(least(greatest(20 * log10(greatest(snr, 1)) + 18, 0), 40)
  - CASE WHEN isolation < 1.05 THEN 3 WHEN isolation < 1.25 THEN 1.5 * (1.25 - isolation) / 0.2 ELSE 0 END
  - 1.5 * (1 - {_UNIT.format("shape_score")}) - (1 - {_UNIT.format("spacing_score")})
  - CASE WHEN f > 0.88 THEN 6 * (f - 0.88) / 0.12 WHEN f > 0.75 THEN 2.5 * (f - 0.75) / 0.13 ELSE 0 END, 0), 5), 40) AS q,
 least(least(40 * log10(greatest(snr, 0.01) + 1) / log10(11), 40) + least(25 * log10(greatest(isolation, 1)) / log10(5), 25) + 20 * {_UNIT.format("shape_score")} + 14 * {_UNIT.format("spacing_score")}, 99) AS s, f
 FROM (SELECT *, CAST(ordinal AS DOUBLE) / count(*) OVER (PARTITION BY trace_id) AS f FROM calls))"""


def _placed(calls: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return calls.withColumn("f", F.col("ordinal") / F.count("*").over(Window.partitionBy("trace_id")))


@query("phred_and_score", f"WITH {A.SQL_CALLS}, {_SCORES} SELECT trace_id, ordinal, CAST(q AS INT) AS phred, round(s, 6) AS score FROM scored")
def phred_and_score(spark, sf_dir):
    c = _placed(A.calls(spark, sf_dir))
    four = [F.col(x) for x in ("snr", "isolation", "shape_score", "spacing_score")]
    return rounded(c.select("trace_id", "ordinal", S.phred_score(*four, F.col("f")).alias("phred"), S.raw_score(*four).alias("score")))


@query("tail_rescue", f"""WITH {A.SQL_CALLS}, {_SCORES},
th AS (SELECT *, CASE WHEN f > 0.6 THEN greatest(4.0 * (1 - 0.4 * (f - 0.6) / 0.4), 0.8) ELSE 4.0 END AS ts, CASE WHEN f > 0.6 THEN greatest(1.3 - 0.25 * (f - 0.6) / 0.4, 1.05) ELSE 1.3 END AS ti,
 (snr < 4.0 AND isolation < 1.3) OR spacing_score < 0.25 AS r FROM scored)
SELECT trace_id, ordinal, r AS rescued, CAST(CASE WHEN r THEN greatest(5, floor(q / 2)) ELSE q END AS INT) AS phred, round(CASE WHEN r THEN s * 0.5 ELSE s END, 6) AS score FROM th WHERE snr >= ts AND isolation >= ti""")
def tail_rescue(spark, sf_dir):
    c = _placed(A.calls(spark, sf_dir))
    four = [F.col(x) for x in ("snr", "isolation", "shape_score", "spacing_score")]
    least_snr, least_iso = S.late_thresholds(F.col("f"), 4.0, 1.3)
    c = c.filter((F.col("snr") >= least_snr) & (F.col("isolation") >= least_iso)).withColumn("rescued", S.rescued(F.col("snr"), F.col("isolation"), F.col("spacing_score"), 4.0, 1.3))
    q, s = S.downgraded(S.phred_score(*four, F.col("f")), S.raw_score(*four), F.col("rescued"))
    return rounded(c.select("trace_id", "ordinal", "rescued", q.alias("phred"), s.alias("score")))


_ASSEMBLED = """joined AS (SELECT trace_id, string_agg(letter, '' ORDER BY ordinal) AS sequence, string_agg(chr(phred + 33), '' ORDER BY ordinal) AS quality FROM calls GROUP BY trace_id)"""


@query("assemble", f"WITH {A.SQL_CALLS}, {_ASSEMBLED} SELECT trace_id, sequence, reverse(translate(sequence, 'ACGTacgtNn', 'TGCAtgcaNn')) AS sequence_rc, quality FROM joined")
def assemble(spark, sf_dir):
    return C.assemble(A.calls(spark, sf_dir))


@query("average_quality", f"WITH {A.SQL_CALLS} SELECT trace_id, round(coalesce(avg(phred) FILTER (WHERE NOT tail_rescued AND NOT imputed), 0), 6) AS avg_quality FROM calls GROUP BY trace_id")
def average_quality(spark, sf_dir):
    return rounded(C.average_quality(A.calls(spark, sf_dir)))


@query("orientation", f"""WITH {A.SQL_CALLS}, {_LADDER}, {_ASSEMBLED}, m AS (SELECT trace_id, round(avg(phred), 6) AS q, count(*) AS n FROM calls JOIN blast USING (trace_id) WHERE ordinal >= blast_start AND ordinal < blast_end GROUP BY trace_id)
SELECT trace_id, sequence AS forward, CAST(length(sequence) AS INT) AS forward_len, n AS forward_blast_window_len, q AS forward_mean_q, reverse(translate(sequence, 'ACGTacgtNn', 'TGCAtgcaNn')) AS rc,
 CAST(length(sequence) AS INT) AS rc_len, n AS rc_blast_window_len, q AS rc_mean_q, 'forward' AS recommended FROM joined JOIN m USING (trace_id)""")
def orientation(spark, sf_dir):
    return rounded(C.orientation(A.calls(spark, sf_dir)))


@query("vendor_identity", f"""WITH {A.SQL_CALLS}, v AS (SELECT trace_id, letter AS a, CASE WHEN phred % 7 = 0 THEN 'N' ELSE letter END AS b FROM calls)
SELECT trace_id, count(*) AS compared, count_if(a = b) AS matches, round(100.0 * count_if(a = b) / count(*), 6) AS percent FROM v GROUP BY trace_id""")
def vendor_identity(spark, sf_dir):
    c = A.calls(spark, sf_dir)
    other = c.withColumn("letter", F.when(F.col("phred") % 7 == 0, "N").otherwise(F.col("letter")))
    return rounded(C.vendor_identity(C.assemble(c), C.assemble(other)))


@query("vendor_summary", f"""WITH {A.SQL_CALLS} SELECT trace_id, CAST(count(*) AS INT) AS n, round(avg(phred), 6) AS mean_quality, CAST(count_if(phred >= 20) AS INT) AS q20, CAST(count_if(phred >= 30) AS INT) AS q30, min(d) AS min_spacing, max(d) AS max_spacing
FROM (SELECT *, pos - lag(pos) OVER (PARTITION BY trace_id ORDER BY ordinal) AS d FROM calls) GROUP BY trace_id""")
def vendor_summary(spark, sf_dir):
    listed = A.calls(spark, sf_dir).groupBy("trace_id").agg(F.transform(C._ordered("phred"), lambda q: q.cast("double")).alias("kb_quality"), C._ordered("pos").alias("peak_locs"))
    return rounded(C.vendor_summary(listed))


@query("fastq", f"""WITH {A.SQL_CALLS}, {_segments(20.0)}, e AS ({_ENDS}),
b AS (SELECT trace_id, CASE WHEN seg.b > seg.a THEN seg.a ELSE start END AS lo, CASE WHEN seg.b > seg.a THEN seg.b ELSE "end" END AS hi FROM seg JOIN e USING (trace_id))
SELECT trace_id, '@trace_' || trace_id || chr(10) || coalesce(string_agg(letter, '' ORDER BY ordinal), '') || chr(10) || '+' || chr(10) || coalesce(string_agg(chr(phred + 33), '' ORDER BY ordinal), '') || chr(10) AS record
FROM calls JOIN b USING (trace_id) WHERE ordinal >= lo AND ordinal < hi GROUP BY trace_id""")
def fastq(spark, sf_dir):
    return C.fastq(A.calls(spark, sf_dir), F.concat(F.lit("trace_"), F.col("trace_id")))


def _candidates(spark, sf_dir) -> DataFrame:
    return A.calls(spark, sf_dir).select("trace_id", F.floor(F.col("pos") / 6).alias("pos"), (F.col("phred") % 4).alias("ch"), "snr").groupBy("trace_id", "pos", "ch").agg(F.max("snr").alias("amp"))


_CANDIDATES = "cand AS (SELECT trace_id, CAST(floor(pos / 6) AS BIGINT) AS pos, phred % 4 AS ch, max(snr) AS amp FROM calls GROUP BY ALL)"
_FOLD = """ordered AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY pos, ch) AS r FROM cand),
fold AS (SELECT trace_id, r, pos, ch, amp, pos AS start, 0 AS cluster FROM ordered WHERE r = 1
 UNION ALL SELECT o.trace_id, o.r, o.pos, o.ch, o.amp, CASE WHEN o.pos - f.start > 3 THEN o.pos ELSE f.start END, f.cluster + CAST(o.pos - f.start > 3 AS INT) FROM fold f JOIN ordered o ON o.trace_id = f.trace_id AND o.r = f.r + 1)"""


@query("cluster_merge", f"""WITH RECURSIVE {A.SQL_CALLS}, {_CANDIDATES}, {_FOLD}, b AS (SELECT trace_id, cluster, min({{'m': -amp, 'pos': pos, 'ch': ch}}) AS x FROM fold GROUP BY trace_id, cluster)
SELECT trace_id, cluster, x.pos AS pos, x.ch AS ch, round(-x.m, 6) AS amp FROM b""")
def cluster_merge(spark, sf_dir):
    return rounded(C.resolve(C.clusters(_candidates(spark, sf_dir), 3)))


@query("spacing_fold", f"""WITH RECURSIVE {A.SQL_CALLS}, fold AS (
 SELECT c.trace_id, ordinal, pos, CAST(1 AS DOUBLE) AS s, CAST(snr >= 4 AND isolation >= 1.1 AS INT) AS n, CASE WHEN snr >= 4 AND isolation >= 1.1 THEN pos END AS last FROM calls c WHERE ordinal = 0
 UNION ALL SELECT trace_id, ordinal, pos, s, n + CAST(ok AND s >= 0.25 AS INT), CASE WHEN ok AND s >= 0.25 THEN pos ELSE last END FROM (
  SELECT c.trace_id, c.ordinal, c.pos, f.n, f.last, c.snr >= 4 AND c.isolation >= 1.1 AS ok,
   CASE WHEN f.n < 2 OR f.last >= 12000 THEN 1.0 ELSE greatest(0.0, 1.0 - abs((c.pos - f.last) - (12 + floor(f.last / 2000))) / (12 + floor(f.last / 2000)) / 0.35) END AS s
  FROM fold f JOIN calls c ON c.trace_id = f.trace_id AND c.ordinal = f.ordinal + 1))
SELECT trace_id, ordinal, pos, round(s, 6) AS spacing_score FROM fold""")
def spacing_fold(spark, sf_dir):
    model = F.transform(F.sequence(F.lit(0), F.lit(11999)), lambda p: (12 + F.floor(p / 2000)).cast("double"))
    return rounded(C.spacing_fold(A.calls(spark, sf_dir), model, (F.col("snr") >= 4) & (F.col("isolation") >= 1.1)))


# Sequences


@query("reverse_complement", f"WITH {A.SQL_SEQS} SELECT doc_id, reverse(translate(seq, 'ACGTacgtNn', 'TGCAtgcaNn')) AS rc, trim(seq, 'N') AS trimmed FROM seqs")
def reverse_complement(spark, sf_dir):
    return A.sequences(spark, sf_dir).select("doc_id", S.reverse_complement(F.col("seq")).alias("rc"), S.trim_n(F.col("seq")).alias("trimmed"))


@query("fasta", f"""WITH {A.SQL_SEQS} SELECT doc_id, '>doc_' || doc_id || ' length=' || length(trim(seq, 'N')) || chr(10) || coalesce((SELECT string_agg(substr(trim(seq, 'N'), k * 80 + 1, 80) || chr(10), '' ORDER BY k) FROM range((length(trim(seq, 'N')) + 79) // 80) AS r(k)), '') AS record FROM seqs""")
def fasta(spark, sf_dir):
    from ..sinks.fasta import fasta_record

    s = A.sequences(spark, sf_dir).withColumn("seq", S.trim_n(F.col("seq")))
    return s.select("doc_id", fasta_record(F.concat(F.lit("doc_"), "doc_id", F.lit(" length="), F.length("seq")), F.col("seq")).alias("record"))


@query("primer_trim", f"""WITH {A.SQL_SEQS}, starts AS (SELECT doc_id, seq, i, (SELECT count(*) FROM range(5) AS r(k) WHERE substr('{PRIMER}', k + 1, 1) <> 'N' AND substr(seq, i + k + 1, 1) NOT IN (substr('{PRIMER}', k + 1, 1), 'N')) AS mm FROM seqs, unnest(range(greatest(least(length(seq) - 4, 80), 0))) AS t(i)),
best AS (SELECT doc_id, min({{'mm': mm, 'i': i}}) AS b FROM starts GROUP BY doc_id)
SELECT doc_id, CASE WHEN b.mm <= 2 THEN substr(seq, b.i + 6) ELSE seq END AS sequence, CAST(CASE WHEN b.mm <= 2 THEN b.i + 5 ELSE 0 END AS INT) AS cut FROM seqs LEFT JOIN best USING (doc_id)""")
def primer_trim(spark, sf_dir):
    return A.sequences(spark, sf_dir).select("doc_id", S.trim_primer(F.col("seq"), PRIMER).alias("x")).select("doc_id", "x.*")


@query("one_decimal", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, printf('%.1f', l_extendedprice / 100) AS text FROM lineitem")
def one_decimal(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", S.one_decimal(F.col("l_extendedprice") / 100).alias("text"))


@query("file_stem", "SELECT page_id, regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1) AS stem FROM pages")
def file_stem(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", S.file_stem(F.col("url")).alias("stem"))


# Samples


@query("channel_shift", f"""WITH {A.SQL_SAMPLES} SELECT trace_id, i, g, lag(a, 1, 0) OVER w AS a, lead(t, 1, 0) OVER w AS t, lag(c, 2, 0) OVER w AS c FROM samples WINDOW w AS (PARTITION BY trace_id ORDER BY i)""")
def channel_shift(spark, sf_dir):
    return P.shift(A.samples(spark, sf_dir), SHIFTS)


def _inverse(matrix) -> list[list[float]]:
    """Inverse by elimination in exact fractions."""
    n = len(matrix)
    rows = [[Fraction(v) for v in row] + [Fraction(int(r == k)) for k in range(n)] for r, row in enumerate(matrix)]
    for k in range(n):
        pivot = next(r for r in range(k, n) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [v / rows[k][k] for v in rows[k]]
        for r in set(range(n)) - {k}:
            rows[r] = [a - rows[r][k] * b for a, b in zip(rows[r], rows[k], strict=True)]
    return [[float(v) for v in row[n:]] for row in rows]


def _unmixed_sql() -> str:
    rows = [f"round(greatest({' + '.join(f'({v!r}) * {c}' for v, c in zip(row, P.WIDE, strict=True))}, 0), 6) + 0 AS {name}" for name, row in zip(P.WIDE, _inverse(CROSSTALK), strict=True)]
    return f"WITH {A.SQL_SAMPLES} SELECT trace_id, i, {', '.join(rows)} FROM samples"


@query("unmix", _unmixed_sql())
def unmix(spark, sf_dir):
    return rounded(P.unmix(A.samples(spark, sf_dir), CROSSTALK))


#: Mirrored rows: with the edge repeated (k = 1), or not (k = 0).
_MIRROR = """num AS (SELECT *, count(*) OVER (PARTITION BY trace_id, ch) AS n FROM long),
pad AS (SELECT trace_id, ch, i, y, n FROM num UNION ALL SELECT trace_id, ch, -i - {k}, y, n FROM num WHERE i >= 1 - {k} AND i < {h} + 1 - {k}
 UNION ALL SELECT trace_id, ch, 2 * n - 2 + {k} - i, y, n FROM num WHERE i < n - 1 + {k} AND i >= n - {h} - 1 + {k})"""
_MEDIAN = f"""WITH {A.SQL_LONG}, {_MIRROR.format(k=1, h=50)}, b AS (SELECT *, quantile_cont(y, 0.5) OVER (PARTITION BY trace_id, ch ORDER BY i ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS p FROM pad)"""


@query("rolling_median", _MEDIAN + " SELECT trace_id, CAST(ch AS INT) AS ch, i, round(p, 6) AS baseline, round(greatest(y - p, 0), 6) AS y FROM b WHERE i >= 0 AND i < n")
def rolling_median(spark, sf_dir):
    from ..operators.traces import baseline_lanes

    return rounded(baseline_lanes(A.samples(spark, sf_dir), "rolling"))


@query("snr_map", _MEDIAN + " SELECT trace_id, CAST(ch AS INT) AS ch, i, round(least(greatest(greatest(y - p, 0) / (p + 1e-9), 0), 50), 6) AS snr FROM b WHERE i >= 0 AND i < n")
def snr_map(spark, sf_dir):
    from ..operators.traces import baseline_lanes

    return rounded(P.snr_map(baseline_lanes(A.samples(spark, sf_dir), "rolling"), "baseline").select("trace_id", "ch", "i", "snr"))


@query("noise_floor", f"""WITH {A.SQL_LONG}, {_MIRROR.format(k=0, h=25)}, b AS (SELECT *, quantile_cont(y, 0.05) OVER (PARTITION BY trace_id, ch ORDER BY i ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) AS p,
 max(abs(y)) OVER (PARTITION BY trace_id, ch) AS top FROM pad) SELECT trace_id, CAST(ch AS INT) AS ch, i, round(greatest(p, CASE WHEN top > 0 THEN top ELSE 1 END * 0.0005), 6) AS noise FROM b WHERE i >= 0 AND i < n""")
def noise_floor(spark, sf_dir):
    from ..operators.traces import noise_lanes

    return rounded(noise_lanes(A.samples(spark, sf_dir), 51, 5.0))


@query("moving_percentile", f"""WITH {A.SQL_LONG}, {_MIRROR.format(k=1, h=10)}, b AS (SELECT *, quantile_cont(y, 0.25) OVER (PARTITION BY trace_id, ch ORDER BY i ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS p FROM pad) SELECT trace_id, CAST(ch AS INT) AS ch, i, y, round(p, 6) AS p FROM b WHERE i >= 0 AND i < n""")
def moving_percentile(spark, sf_dir):
    return rounded(P.moving_percentile(P.long(A.samples(spark, sf_dir)), 21, 0.25, True))


@query("morph_open", f"""WITH {A.SQL_LONG}, e AS (SELECT *, min(y) OVER (PARTITION BY trace_id, ch ORDER BY i ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS low FROM long)
SELECT trace_id, CAST(ch AS INT) AS ch, i, max(low) OVER (PARTITION BY trace_id, ch ORDER BY i ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS opened FROM e""")
def morph_open(spark, sf_dir):
    return P.opened(P.long(A.samples(spark, sf_dir))).select("trace_id", "ch", "i", "opened")


@query("envelope", f"""WITH {A.SQL_LONG}, e AS (SELECT *, greatest(max(y) OVER (PARTITION BY trace_id, ch ORDER BY i ROWS BETWEEN 150 PRECEDING AND 149 FOLLOWING), 0.03 * max(y) OVER (PARTITION BY trace_id, ch)) AS envelope FROM long)
SELECT trace_id, CAST(ch AS INT) AS ch, i, round(envelope, 6) AS envelope, round(CASE WHEN envelope > 0 THEN y / envelope ELSE 0 END, 6) AS normal FROM e""")
def envelope(spark, sf_dir):
    return rounded(T.envelope_lanes(A.samples(spark, sf_dir)))


_BLOB = """summed AS (SELECT trace_id, i, g + a + t + c AS s, max(g + a + t + c) OVER (PARTITION BY trace_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS ahead, count(*) OVER (PARTITION BY trace_id) AS n FROM samples),
first AS (SELECT trace_id, min({'m': -s, 'i': i}) AS p FROM summed WHERE i < 500 GROUP BY trace_id),
calm AS (SELECT trace_id, any_value(n) AS n, any_value(first.p.i) AS pk, min(s.i) FILTER (WHERE s.i >= first.p.i AND s.i < n - 20 AND ahead < -first.p.m * 0.4) AS i, any_value(-first.p.m) AS top FROM summed s JOIN first USING (trace_id) GROUP BY trace_id),
blob AS (SELECT trace_id, CAST(CASE WHEN top <= 0 THEN 0 ELSE coalesce(i, least(pk + 50, 500, n)) END AS BIGINT) AS blob_end FROM calm)"""


@query("blob_end", f"WITH {A.SQL_SAMPLES}, {_BLOB} SELECT * FROM blob")
def blob_end(spark, sf_dir):
    return P.blob_end(A.samples(spark, sf_dir))


@query("channel_floor", f"""WITH {A.SQL_LONG}, t AS (SELECT *, max(y) OVER (PARTITION BY trace_id, ch) AS top FROM long), s AS (SELECT trace_id, ch, any_value(top) AS top, count(y) FILTER (WHERE y < 0.1 * top) AS n, stddev_pop(y) FILTER (WHERE y < 0.1 * top) AS sd FROM t GROUP BY trace_id, ch)
SELECT trace_id, CAST(ch AS INT) AS ch, round(CASE WHEN top <= 0 THEN 1e-6 WHEN n < 20 THEN greatest(top * 0.01, 1e-6) ELSE greatest(sd, top * 0.005, 1e-6) END, 6) AS floor FROM s""")
def channel_floor(spark, sf_dir):
    return rounded(P.channel_floor(P.long(A.samples(spark, sf_dir))))


@query("sample_features", f"""WITH {A.SQL_SAMPLES}, r AS (SELECT *, list_reverse_sort([{{'y': g, 'n': 0}}, {{'y': a, 'n': 1}}, {{'y': t, 'n': 2}}, {{'y': c, 'n': 3}}]) AS r FROM samples),
h AS (SELECT *, r[1].y > 0 AND r[2].y / (r[1].y + 1e-9) >= 0.45 AS yes FROM r)
SELECT trace_id, i, round(r[1].y / (r[2].y + 1e-9), 3) AS isolation, CAST(list_position([g, a, t, c], greatest(g, a, t, c)) - 1 AS INT) AS channel, yes AS heterozygote, CASE WHEN yes THEN r[2].n ELSE -1 END AS het_channel, round(CASE WHEN yes THEN r[2].y / (r[1].y + 1e-9) ELSE 0 END, 3) AS het_ratio FROM h""")
def sample_features(spark, sf_dir):
    return rounded(P.sample_features(A.samples(spark, sf_dir)), 3)


_PEAKS = "n AS (SELECT *, lag(y) OVER w AS b, lead(y) OVER w AS f FROM long WINDOW w AS (PARTITION BY trace_id, ch ORDER BY i)), peaks AS (SELECT trace_id, CAST(ch AS INT) AS ch, i AS pos, y AS amp FROM n WHERE y > b AND y > f)"


@query("local_maxima", f"WITH {A.SQL_LONG}, {_PEAKS} SELECT * FROM peaks")
def local_maxima(spark, sf_dir):
    return P.local_maxima(P.long(A.samples(spark, sf_dir)))


@query("shadow_peaks", f"""WITH {A.SQL_LONG}, {_PEAKS} SELECT * FROM peaks p WHERE NOT EXISTS (SELECT 1 FROM peaks q WHERE q.trace_id = p.trace_id AND q.ch = p.ch AND q.pos BETWEEN p.pos + 2 AND p.pos + 8 AND q.amp > 0 AND p.amp / (q.amp + 1e-9) <= 0.25)""")
def shadow_peaks(spark, sf_dir):
    return P.suppress_shadows(P.local_maxima(P.long(A.samples(spark, sf_dir))))


@query("peak_filters", f"""WITH {A.SQL_LONG}, {_PEAKS}, t AS (SELECT *, max(y) OVER (PARTITION BY trace_id, ch) AS top FROM long), s AS (SELECT trace_id, CAST(ch AS INT) AS ch, any_value(top) AS top, count(y) FILTER (WHERE y < 0.1 * top) AS n, stddev_pop(y) FILTER (WHERE y < 0.1 * top) AS sd FROM t GROUP BY trace_id, ch),
fl AS (SELECT trace_id, ch, CASE WHEN top <= 0 THEN 1e-6 WHEN n < 20 THEN greatest(top * 0.01, 1e-6) ELSE greatest(sd, top * 0.005, 1e-6) END AS floor FROM s)
SELECT trace_id, ch, pos, amp, round(amp / greatest(floor, 1e-9), 4) AS snr FROM peaks JOIN fl USING (trace_id, ch) WHERE amp >= 1e-6 AND amp / greatest(floor, 1e-9) >= 0.75""")
def peak_filters(spark, sf_dir):
    lanes = P.long(A.samples(spark, sf_dir))
    return rounded(P.call_filters(P.local_maxima(lanes), P.channel_floor(lanes), 5.0).select("trace_id", "ch", "pos", "amp", "snr"), 4)


# Matrices

#: Corrected by the moving median of 101 samples, from the end of each trace's blob on.
_DOMINANT = f"""{_MEDIAN.removeprefix("WITH ")}, cor AS (SELECT trace_id, ch, i, greatest(y - p, 0) AS y FROM b WHERE i >= 0 AND i < n), {_BLOB},
rest AS (SELECT cor.* FROM cor JOIN blob USING (trace_id) WHERE i >= blob_end), all4 AS (SELECT DISTINCT trace_id, ch FROM cor),
lim AS (SELECT trace_id, ch, quantile_cont(y, 0.99) * 0.04 AS thr FROM rest GROUP BY trace_id, ch),
vec AS (SELECT trace_id, i, list(y ORDER BY ch) AS v FROM rest GROUP BY trace_id, i),
lead AS (SELECT trace_id, i, v, list_position(v, list_max(v)) - 1 AS ch, list_max(v) AS top, list_reverse_sort(v)[2] AS second FROM vec),
fit AS (SELECT lead.*, row_number() OVER (PARTITION BY trace_id, ch ORDER BY top DESC, i) AS r FROM lead JOIN lim USING (trace_id, ch) WHERE top >= CASE WHEN thr > 0 THEN thr ELSE 1e-6 END AND top / (second + 1e-9) >= 1.5),
mean AS (SELECT trace_id, ch, k AS row, avg(v[k + 1] / (top + 1e-9)) AS v, count(*) AS n FROM fit, range(4) AS t(k) WHERE r <= 500 GROUP BY ALL),
grid AS (SELECT trace_id, ch, k AS row FROM all4, range(4) AS t(k)),
dom AS (SELECT trace_id AS matrix_id, row, ch AS col, CASE WHEN coalesce(n, 0) < 5 THEN CAST(row = ch AS DOUBLE) WHEN row = ch THEN greatest(v, 1.0) ELSE v END AS v, coalesce(n, 0) AS n FROM grid LEFT JOIN mean USING (trace_id, ch, row))"""
_CONSTRAINED = "con AS (SELECT matrix_id, row, col, CASE WHEN row = col THEN 1.0 ELSE least(greatest(v, 0), 0.95) END AS v FROM dom)"


def _dominant(spark, sf_dir):
    samples = A.samples(spark, sf_dir)
    return M.dominant(samples, blobs=P.blob_end(samples))


@query("dominant_matrix", f"WITH {_DOMINANT} SELECT matrix_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(v, 6) AS v, n FROM dom")
def dominant_matrix(spark, sf_dir):
    return rounded(_dominant(spark, sf_dir))


@query("robust_matrix", f"WITH {_DOMINANT}, {_CONSTRAINED} SELECT matrix_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, round(v, 6) AS v FROM con")
def robust_matrix(spark, sf_dir):
    samples = A.samples(spark, sf_dir)
    return rounded(M.robust(samples, blobs=P.blob_end(samples)).drop("n"))


@query("matrix_plausibility", f"""WITH {_DOMINANT}, s AS (SELECT matrix_id, col, sum(CASE WHEN row = col THEN -10 * abs(v - 1) WHEN v BETWEEN 0 AND 1 THEN 1 WHEN v < 0 THEN -4 ELSE -2 * v END) AS e, max(v) FILTER (WHERE row = col) AS d, max(v) FILTER (WHERE row <> col) AS o FROM dom GROUP BY ALL)
SELECT matrix_id, round(sum(e + CASE WHEN d >= o THEN 3 ELSE -5 * (o - d) END), 6) AS plausibility FROM s GROUP BY matrix_id""")
def matrix_plausibility(spark, sf_dir):
    return rounded(M.plausibility(_dominant(spark, sf_dir)))


@query("matrix_compare", f"""WITH {_DOMINANT}, {_CONSTRAINED}, d AS (SELECT dom.matrix_id, dom.v - con.v * 0.9 AS d FROM dom JOIN con USING (matrix_id, row, col))
SELECT matrix_id, round(sqrt(sum(d * d)), 6) AS frobenius, round(max(abs(d)), 6) AS largest, round(avg(abs(d)), 6) AS mean FROM d GROUP BY matrix_id""")
def matrix_compare(spark, sf_dir):
    one = _dominant(spark, sf_dir)
    return rounded(M.compare(one, M.constrain(one).withColumn("v", F.col("v") * 0.9)))


@query("matrix_validate", f"""WITH {_DOMINANT}, s AS (SELECT matrix_id, row, max(v) FILTER (WHERE row = col) AS d, max(abs(v)) FILTER (WHERE row <> col) AS o FROM dom GROUP BY ALL)
SELECT matrix_id, count_if(d <= 0) AS not_positive, count_if(d > 0 AND d < 1.05) AS near_one, count_if(d < o) AS not_leading FROM s GROUP BY matrix_id""")
def matrix_validate(spark, sf_dir):
    return M.validate(_dominant(spark, sf_dir))


from . import peak_queries, trace_queries  # noqa: E402,F401  (add their queries)
