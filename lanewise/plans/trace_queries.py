"""Queries on whole traces, files and reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..blast import parse as B
from ..functions import scalars as S
from ..functions import tables
from ..operators import matrices as M
from ..operators import samples as P
from ..operators import traces as T
from ..params import PipelineParams
from ..sinks.abif import abif_bytes
from ..sinks.fasta import batch_headers, exportable, fasta_record, search_pair, single_header, single_records
from ..sinks.files import shared_folder, write_files
from ..sinks.record_sink import write_ordered
from ..sinks.tables import peak_table, summary_table
from ..sources import readers as R
from ..sources import trace_source
from . import pipeline as PL
from .peak_queries import peaks_sql, polynomial_weight
from .queries import _ASSEMBLED, _BLOB, _LADDER, _MEDIAN, _PEAKS, _STATS, _TRIM, CROSSTALK, ORACLES, _candidates, _segments, query, rounded


def _morph_sql() -> str:
    weights = (lambda w: w / w.sum())(np.exp(-0.5 * (np.arange(-48, 49) / 12.0) ** 2))
    listed = ", ".join(f"({k - 48}, {float(w)!r})" for k, w in enumerate(weights))
    return f"""WITH {A.SQL_LONG}, e AS (SELECT *, min(y) OVER (PARTITION BY trace_id, ch ORDER BY i ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS low, count(*) OVER (PARTITION BY trace_id, ch) AS n FROM long),
o AS (SELECT trace_id, ch, i, y, n, max(low) OVER (PARTITION BY trace_id, ch ORDER BY i ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS o FROM e), k(d, w) AS (VALUES {listed}),
near AS (SELECT trace_id, ch, i, y, w, CASE WHEN i + d < 0 THEN -i - d - 1 WHEN i + d >= n THEN 2 * n - 1 - i - d ELSE i + d END AS j FROM o, k),
b AS (SELECT a.trace_id, a.ch, a.i, any_value(a.y) AS y, sum(w * o.o) AS b FROM near a JOIN o ON o.trace_id = a.trace_id AND o.ch = a.ch AND o.i = a.j GROUP BY ALL)
SELECT trace_id, CAST(ch AS INT) AS ch, i, round(greatest(b, 0), 6) + 0 AS baseline, round(greatest(y - b, 0), 6) + 0 AS y FROM b"""


@query("morph_baseline", _morph_sql())
def morph_baseline(spark, sf_dir):
    return rounded(T.baseline_lanes(A.samples(spark, sf_dir), "morph"))


def _savgol_sql(width: int = 19) -> str:
    """Each sample's window is the one around it, or the first or last; the weights are those of orthogonal polynomials."""
    half = width // 2
    weight = polynomial_weight(str(width), "(l.i - s)", "(p.i - s)")
    return f"""WITH {A.SQL_LONG}, num AS (SELECT *, count(*) OVER (PARTITION BY trace_id, ch) AS n FROM long),
p AS (SELECT *, greatest(0, least(i - {half}, n - {width})) AS s FROM num)
SELECT p.trace_id, CAST(p.ch AS INT) AS ch, p.i, round(greatest(sum(l.y * ({weight})), 0), 6) + 0 AS y FROM p JOIN long l ON l.trace_id = p.trace_id AND l.ch = p.ch AND l.i BETWEEN s AND s + {width - 1} GROUP BY p.trace_id, p.ch, p.i"""


@query("savgol", _savgol_sql())
def savgol(spark, sf_dir):
    return rounded(T.lanes(T.smoothed(T.traces(A.samples(spark, sf_dir))), "y"))


@query("als_baseline")
def als_baseline(spark, sf_dir):
    return rounded(T.baseline_lanes(A.samples(spark, sf_dir), "als"), 4)


#: The equations are solved to rounding: the largest difference of their two sides is 0 for every channel.
@query("als_residual", f"WITH {A.SQL_LONG} SELECT trace_id, CAST(ch AS INT) AS ch, count(*) AS n, CAST(0 AS DOUBLE) AS worst FROM long GROUP BY trace_id, ch")
def als_residual(spark, sf_dir):
    return rounded(P.curve_residual(T.fitted(T.traces(A.samples(spark, sf_dir)))), 4)


#: Four components of four channels: the corrected samples are their product, and no entry is negative.
@query("nmf_residual", "SELECT l_suppkey AS trace_id, count(*) AS n, CAST(0 AS DOUBLE) AS error, true AS positive FROM lineitem GROUP BY l_suppkey")
def nmf_residual(spark, sf_dir):
    found = P.factor_residual(T.factors(T.traces(A.samples(spark, sf_dir))))
    return rounded(found.select("trace_id", "n", "error", (F.col("least") >= 0).alias("positive")), 9)


#: Amount 0.8 over the last quarter; the smoothing's weights reach 2 samples (four sigma of 0.4), its ends are mirrored.
_SHARPEN = f"""WITH {A.SQL_LONG}, num AS (SELECT *, count(*) OVER (PARTITION BY trace_id, ch) AS n, max(y) OVER (PARTITION BY trace_id, ch) AS top FROM long),
k(d, w) AS (SELECT d, exp(-0.5 * pow(d / 0.4, 2)) / sum(exp(-0.5 * pow(d / 0.4, 2))) OVER () FROM range(-2, 3) AS r(d)),
near AS (SELECT trace_id, ch, i, w, CASE WHEN i + d < 0 THEN -i - d - 1 WHEN i + d >= n THEN 2 * n - 1 - i - d ELSE i + d END AS j FROM num, k),
soft AS (SELECT a.trace_id, a.ch, a.i, sum(w * l.y) AS b FROM near a JOIN long l ON l.trace_id = a.trace_id AND l.ch = a.ch AND l.i = a.j GROUP BY ALL),
sharp AS (SELECT num.*, greatest(y + CASE WHEN i < floor(0.75 * n) THEN 0 ELSE 0.8 * (i - floor(0.75 * n)) / (n - floor(0.75 * n) - 1) END * (y - b), 0) AS s FROM num JOIN soft USING (trace_id, ch, i))
SELECT trace_id, CAST(ch AS INT) AS ch, i, round(CASE WHEN top > 0 THEN s * CASE WHEN m > 0 THEN top / m ELSE 1 END ELSE y END, 6) AS y FROM (SELECT *, max(s) OVER (PARTITION BY trace_id, ch) AS m FROM sharp)"""


@query("sharpen_tail", _SHARPEN)
def sharpen_tail(spark, sf_dir):
    return rounded(T.lanes(T.sharpened(T.traces(A.samples(spark, sf_dir)), 0.8), "y"))


@query("mobility")
def mobility(spark, sf_dir):
    return rounded(T.lanes(T.aligned(T.traces(A.samples(spark, sf_dir))), "y"), 4)


@query("peaks_and_shapes")
def peaks_and_shapes(spark, sf_dir):
    return rounded(T.found_peaks(T.traces(A.samples(spark, sf_dir))), 4)


#: Peaks of corrected channels where some channel leads by 2, else by 1.5, else by 1.2: the first with five of them.
_PEAK_MATRIX = f"""WITH RECURSIVE {_MEDIAN.removeprefix("WITH ")}, cor AS (SELECT trace_id, ch, i, greatest(y - p, 0) AS y FROM b WHERE i >= 0 AND i < n), {peaks_sql("pk", "cor", 5, "0.005")},
vec AS (SELECT trace_id, i, list(y ORDER BY ch) AS v, list_reverse_sort(list(y)) AS r FROM cor GROUP BY trace_id, i),
lead AS (SELECT pk.trace_id, pk.ch, v, r[1] >= k * (r[2] + 1e-9) AS ok, k FROM pk JOIN vec ON vec.trace_id = pk.trace_id AND vec.i = pk.pos, (VALUES (2.0), (1.5), (1.2)) AS t(k) WHERE pk.amp <> 0),
pick AS (SELECT trace_id, ch, max(k) AS k FROM (SELECT trace_id, ch, k FROM lead WHERE ok GROUP BY ALL HAVING count(*) >= 5) GROUP BY trace_id, ch),
mean AS (SELECT trace_id, ch, row, avg(v[row + 1] / v[ch + 1]) AS v FROM lead JOIN pick USING (trace_id, ch, k), range(4) AS t(row) WHERE ok GROUP BY ALL),
grid AS (SELECT trace_id, ch, row FROM (SELECT DISTINCT trace_id, ch FROM cor), range(4) AS t(row)),
whole AS (SELECT trace_id, row, ch, CASE WHEN row = ch THEN greatest(coalesce(v, 1), 1) ELSE coalesce(v, 0) END AS v FROM grid LEFT JOIN mean USING (trace_id, ch, row))
SELECT trace_id AS matrix_id, CAST(row AS INT) AS row, CAST(ch AS INT) AS col, round(CASE WHEN row = ch THEN v + 0.01 * greatest(avg(CASE WHEN row = ch THEN v END) OVER (PARTITION BY trace_id), 1) ELSE v END, 9) AS v FROM whole"""


@query("peak_matrix", _PEAK_MATRIX)
def peak_matrix(spark, sf_dir):
    return rounded(T.estimated(T.traces(A.samples(spark, sf_dir)), "peaks"), 9)


@query("nmf_matrix")
def nmf_matrix(spark, sf_dir):
    return rounded(T.estimated(T.traces(A.samples(spark, sf_dir)), "nmf"), 3)


@query("called_letters", f"WITH {A.SQL_CALLS} SELECT trace_id, ordinal, CASE WHEN tail_rescued THEN 'N' ELSE substr('GATC', phred % 4 + 1, 1) END AS strict, substr('GATC', phred % 4 + 1, 1) AS guessed FROM calls")
def called_letters(spark, sf_dir):
    c = A.calls(spark, sf_dir)
    return c.select("trace_id", "ordinal", S.called_letter(F.col("phred") % 4, F.col("tail_rescued"), False).alias("strict"), S.called_letter(F.col("phred") % 4, F.col("tail_rescued")).alias("guessed"))


@query("normal_places", f"""WITH {A.SQL_LONG}, {_PEAKS}, {_BLOB} SELECT trace_id, ch, pos, amp, round((pos - blob_end) / greatest(n - blob_end, 1), 6) AS place
FROM peaks JOIN blob USING (trace_id) JOIN (SELECT trace_id, count(*) AS n FROM samples GROUP BY trace_id) USING (trace_id) WHERE pos >= blob_end""")
def normal_places(spark, sf_dir):
    samples = A.samples(spark, sf_dir)
    return rounded(P.normal_places(P.local_maxima(P.long(samples)), samples, P.blob_end(samples)))


@query("matrix_of_robust_plausibility", "SELECT DISTINCT l_suppkey AS matrix_id, CAST(24 AS DOUBLE) AS plausibility FROM lineitem")
def matrix_of_robust_plausibility(spark, sf_dir):
    """Every constrained matrix scores 24, as does the identity."""
    return rounded(M.plausibility(M.robust(A.samples(spark, sf_dir))))


PARAMS = PipelineParams.interactive(matrix=CROSSTALK, auto_trim_blob=False, detect_het=True)


def _results(spark, sf_dir):
    traces = T.traces(A.samples(spark, sf_dir)).withColumn("sample_name", F.concat(F.lit("s"), "trace_id")).withColumn("path", F.concat(F.lit("/traces/t"), "trace_id", F.lit(".ab1")))
    return PL.run(traces, PARAMS)


@query("basecall")
def basecall(spark, sf_dir):
    return rounded(PL.base_calls(_results(spark, sf_dir)), 4)


@query("peak_table")
def peak_export(spark, sf_dir):
    return rounded(peak_table(PL.base_calls(_results(spark, sf_dir))), 4)


@query("batch_summary")
def batch_summary(spark, sf_dir):
    return rounded(summary_table(PL.summarise(_results(spark, sf_dir), PARAMS)), 4)


@query("batch_success", "SELECT count(DISTINCT l_suppkey) AS n_ok, count(DISTINCT l_suppkey) AS n_files FROM lineitem")
def batch_success(spark, sf_dir):
    from ..operators.calls import batch_summary as counted

    return counted(_results(spark, sf_dir))


@query("emb_samples", "SELECT label AS trace_id, count(*) * 64 AS n, round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 4) AS total FROM embeddings GROUP BY label")
def emb_samples(spark, sf_dir):
    """A second shape of samples, with negative values: sums of the embeddings' dimensions dealt to channels."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.posexplode("embedding").alias("d", "y"))
    lanes = e.select(F.col("label").alias("trace_id"), (F.col("d") % 4).alias("ch"), F.col("y").cast("double"))
    return rounded(lanes.groupBy("trace_id").agg(F.count("*").alias("n"), F.sum("y").alias("total")), 4)


# Files: contents are built from the samples, read by the parsers, and compared with the samples.

_BACK = f"WITH {A.SQL_LONG} SELECT trace_id, CAST(ch AS INT) AS ch, i, y FROM long"


def _numbered(parsed):
    return T.lanes(parsed.withColumn("trace_id", F.col("trace_id").cast("bigint")), "signals").select("trace_id", "ch", "i", F.col("signals").alias("y"))


def _rows_of(samples, line):
    lines = F.transform(F.sort_array(F.collect_list(F.struct("i", *P.WIDE))), line)
    return samples.groupBy("trace_id").agg(F.array_join(lines, "\n").alias("body"))


def _csv_files(spark, sf_dir):
    rows = _rows_of(A.samples(spark, sf_dir), lambda x: F.concat_ws(";", *[x[c].cast("int").cast("string") for c in P.WIDE]))
    return rows.select(F.concat(F.lit("/in/"), "trace_id", F.lit(".csv")).alias("path"), F.col("body").cast("binary").alias("content"))


def _srd_files(spark, sf_dir):
    point = lambda x: F.concat(F.lit("<Point><Data>"), *[F.concat(F.lit("<int>"), x[c].cast("int").cast("string"), F.lit("</int>")) for c in P.WIDE], F.lit("</Data></Point>"))
    rows = _rows_of(A.samples(spark, sf_dir), point)
    body = F.concat(F.lit("<Root><TimeStep>10</TimeStep>"), "body", F.lit("</Root>"))
    return rows.select(F.concat(F.lit("/in/"), "trace_id", F.lit(".srd")).alias("path"), body.cast("binary").alias("content"))


def _abif_files(spark, sf_dir):
    def build(batches):
        for one in batches:
            out = [{"path": f"/in/{name}.ab1", "content": abif_bytes(T.signal_of(s)[[2, 0, 3, 1]], dyes="TGCA", name=f"s{name}")} for name, s in zip(one.column(0).to_pylist(), one.column(1), strict=True)]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return T.traces(A.samples(spark, sf_dir)).select("trace_id", "signals").mapInArrow(build, "path string, content binary")


@query("read_csv", _BACK)
def read_csv(spark, sf_dir):
    return _numbered(R.parse(_csv_files(spark, sf_dir)))


@query("read_srd", _BACK)
def read_srd(spark, sf_dir):
    return _numbered(R.parse(_srd_files(spark, sf_dir)))


@query("read_abif", _BACK)
def read_abif(spark, sf_dir):
    return _numbered(R.parse(_abif_files(spark, sf_dir)))


def _through_files(spark, files, name):
    """The traces after a round through files and the data source."""
    folder = shared_folder(spark, name)
    write_files(files, folder)
    trace_source.register(spark)
    return spark.read.format("traces").schema("trace_id string, signals array<array<double>>").load(folder)


@query("source_csv", _BACK)
def source_csv(spark, sf_dir):
    return _numbered(_through_files(spark, _csv_files(spark, sf_dir), "csv"))


@query("source_srd", _BACK)
def source_srd(spark, sf_dir):
    return _numbered(_through_files(spark, _srd_files(spark, sf_dir), "srd"))


@query("source_abif", _BACK)
def source_abif(spark, sf_dir):
    return _numbered(_through_files(spark, _abif_files(spark, sf_dir), "abif"))


# SQL text alone: functions on tables.


@query("sql_trim_reads", f'WITH {A.SQL_CALLS}, {_segments(20.0)} SELECT trace_id, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end" FROM seg')
def sql_trim_reads(spark, sf_dir):
    tables.register(spark)
    A.calls(spark, sf_dir).createOrReplaceTempView("lanewise_calls")
    return spark.sql("SELECT * FROM trim_reads(TABLE(SELECT trace_id, ordinal, phred FROM lanewise_calls) PARTITION BY trace_id ORDER BY (ordinal), 20.0D, 20)")


@query("sql_merge_clusters", ORACLES["cluster_merge"])
def sql_merge_clusters(spark, sf_dir):
    tables.register(spark)
    _candidates(spark, sf_dir).createOrReplaceTempView("lanewise_candidates")
    return rounded(spark.sql("SELECT * FROM merge_clusters(TABLE(lanewise_candidates) PARTITION BY trace_id ORDER BY (pos, ch), 3)"))


# Whole exports of a batch: written in order by several tasks, and read back.


@query("ordered_fasta", f"WITH {A.SQL_SEQS}, x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, '>doc' || doc_id AS line FROM seqs WHERE length(seq) > 0) SELECT place, line FROM x")
def ordered_fasta(spark, sf_dir):
    """Header lines of a batch's file in the order of names of files and lines in them."""
    s = A.sequences(spark, sf_dir).filter(F.length("seq") > 0)
    folder = shared_folder(spark, "fasta")
    write_ordered(s.select("doc_id", fasta_record(F.concat(F.lit("doc"), "doc_id"), F.col("seq")).alias("record")), folder, "doc_id")
    # the sum of the headers in the files before gives each file's first place
    lines = spark.read.text(f"{folder}/part-*.fasta").select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).filter("value LIKE '>%'")
    counts = lines.groupBy("file").agg(F.count("*").alias("n"))
    before = counts.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("file").orderBy("at")) - 1
    return lines.join(F.broadcast(before), "file").select((F.col("before") + own).alias("place"), F.col("value").alias("line"))


# Reports of searches, built from the lines of each order.

_HITS = "hits AS (SELECT l_suppkey AS query_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rank, 'ACC' || l_partkey AS accession, 'order ' || l_orderkey || ' line ' || l_linenumber AS description, CAST(floor(l_extendedprice / 100) AS DOUBLE) AS score, CAST(l_quantity AS INT) AS q FROM lineitem), few AS (SELECT * FROM hits WHERE rank <= 20)"


#: The SQL of blast_text, blast_json and blast_xml asks for each report's first hits; their twins with _all give all hits.
ASKED = 20


def _every(sql):
    return sql.replace("FROM few", "FROM hits")


def _hits(spark, sf_dir):
    lines = A._lines(spark, sf_dir)
    one = F.struct(
        F.col("i"), F.concat(F.lit("ACC"), "l_partkey").alias("acc"), F.concat(F.lit("order "), "l_orderkey", F.lit(" line "), "l_linenumber").alias("d"),
        F.floor(F.col("l_extendedprice") / 100).cast("string").alias("s"), F.col("l_quantity").cast("int").alias("q"),
    )
    return lines.groupBy(F.col("trace_id").alias("query_id")).agg(F.sort_array(F.collect_list(one)).alias("h"))


_TEXT_SQL = f"WITH {_HITS} SELECT query_id, CAST(rank AS INT) AS rank, accession, description, score, q || 'e-9' AS evalue, q AS identity_pct, CASE WHEN rank <= 10 THEN 100 - q END AS query_cover_pct FROM few"


@query("blast_text_all", _every(_TEXT_SQL))
def blast_text_all(spark, sf_dir):
    table = F.array_join(F.transform("h", lambda x: F.concat_ws("  ", x["acc"], x["d"], x["s"], F.concat(x["q"].cast("string"), F.lit("e-9")))), "\n")
    same = F.array_join(F.transform("h", lambda x: F.concat(F.lit(" Identities = 9/10 ("), x["q"].cast("string"), F.lit("%)"))), "\n")
    cover = F.array_join(F.transform(F.slice("h", 1, 10), lambda x: F.concat(F.lit(" query cover: "), (100 - x["q"]).cast("string"), F.lit("%"))), "\n")
    report = F.concat(F.lit(f"BLASTN\n{B.MARK}:   (Bits)  Value\n\n"), table, F.lit("\n\nAlignments a b 1 2\n"), same, F.lit("\n"), cover)
    return B.text_hits(_hits(spark, sf_dir).select("query_id", report.alias("report")))


@query("blast_text", _TEXT_SQL)
def blast_text(spark, sf_dir):
    return blast_text_all(spark, sf_dir).filter(F.col("rank") <= ASKED)


_JSON_SQL = f"WITH {_HITS} SELECT query_id, CAST(rank AS INT) AS rank, accession, description, score, printf('%.2e', q / 1e10) AS evalue, CAST(floor(100 * q / 60) AS INT) AS identity_pct, CAST(NULL AS INT) AS query_cover_pct, 60 AS align_length, 0 AS gaps FROM few"


@query("blast_json_all", _every(_JSON_SQL))
def blast_json_all(spark, sf_dir):
    hit = lambda x: F.struct(F.array(F.struct(x["acc"].alias("accession"), x["d"].alias("title"))).alias("description"), F.array(F.struct(x["s"].cast("double").alias("bit_score"), (x["q"] / 1e10).alias("evalue"), x["q"].alias("identity"), F.lit(60).alias("align_len"))).alias("hsps"))
    inner = F.struct(F.struct(F.struct(F.struct(F.transform("h", hit).alias("hits")).alias("search")).alias("results")).alias("report"))
    body = F.to_json(F.struct(F.array(inner).alias("BlastOutput2")))
    return B.json_hits(_hits(spark, sf_dir).select("query_id", F.concat(F.lit("<p>"), body, F.lit("</p>")).alias("report")))


@query("blast_json", _JSON_SQL)
def blast_json(spark, sf_dir):
    return blast_json_all(spark, sf_dir).filter(F.col("rank") <= ASKED)


_XML_SQL = f"WITH {_HITS} SELECT query_id, CAST(rank AS INT) AS rank, accession, 'id ' || description AS description, score, printf('%.2e', q / 1e10) AS evalue, CAST(floor(100 * q / 60) AS INT) AS identity_pct, CAST(floor(100 * q / 80) AS INT) AS query_cover_pct, 60 AS align_length, 2 AS gaps FROM few"


@query("blast_xml_all", _every(_XML_SQL))
def blast_xml_all(spark, sf_dir):
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    hsp = lambda x: tag("Hsp", F.concat(tag("Hsp_score", x["s"]), tag("Hsp_evalue", F.format_string("%.1e", x["q"] / 1e10)), tag("Hsp_query-from", F.lit("1")), tag("Hsp_query-to", (x["q"] + 1).cast("string")), tag("Hsp_identity", x["q"].cast("string")), tag("Hsp_gaps", F.lit("2")), tag("Hsp_align-len", F.lit("60"))))
    hit = lambda x: tag("Hit", F.concat(tag("Hit_id", F.lit("id")), tag("Hit_def", x["d"]), tag("Hit_accession", x["acc"]), tag("Hit_hsps", hsp(x))))
    body = tag("BlastOutput", F.concat(tag("BlastOutput_query-len", F.lit("80")), tag("BlastOutput_iterations", tag("Iteration", tag("Iteration_hits", F.array_join(F.transform("h", hit), ""))))))
    return B.xml_hits(_hits(spark, sf_dir).select("query_id", body.alias("report")))


@query("blast_xml", _XML_SQL)
def blast_xml(spark, sf_dir):
    return blast_xml_all(spark, sf_dir).filter(F.col("rank") <= ASKED)


@query("hit_bands", f"WITH {_HITS} SELECT query_id, CAST(rank AS INT) AS rank, accession, description, score, q || 'e-9' AS evalue, q AS identity_pct, CASE WHEN rank <= 10 THEN 100 - q END AS query_cover_pct, CASE WHEN q >= 99 THEN 'best' WHEN q >= 95 THEN 'good' WHEN q < 80 THEN 'poor' ELSE 'plain' END AS band FROM few WHERE rank <= 10")
def hit_bands(spark, sf_dir):
    return B.top_hits(blast_text_all(spark, sf_dir), 10)


@query("reply_states", """SELECT event_id AS query_id, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'WAITING' WHEN (SELECT max(event_type) FROM events) THEN 'READY' ELSE 'UNKNOWN' END AS status, 'R' || event_id AS rid FROM events""")
def reply_states(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    low, high = e.agg(F.min("event_type"), F.max("event_type")).first()
    reply = F.when(F.col("event_type") == low, "Status=WAITING").when(F.col("event_type") == high, "ThereAreHits=yes").otherwise("?")
    replies = e.select(F.col("event_id").alias("query_id"), F.concat(F.lit("QBlastInfo\n RID = R"), "event_id", F.lit("\n"), reply).alias("reply"))
    return B.statuses(replies).join(B.request_ids(replies), "query_id")


# Exports


def _export_rows(spark, sf_dir):
    s = A.sequences(spark, sf_dir).filter(F.length("seq") > 0)
    n = F.length("seq")
    return s.select(F.concat(F.lit("doc"), "doc_id").alias("name"), F.col("seq").alias("sequence"), F.lit(0).alias("blast_start"), n.alias("blast_end"), (n % 40 + 0.25).alias("mean_phred"), (n % 100 + 0.5).alias("pct_q20"), (n % 7 + 90.125).alias("blast_est_identity"), (n % 3).alias("primer_trim_pos"), (n % 2).alias("n_heterozygotes"), F.lit(0).alias("n_imputed"))


_EXPORT = f"""WITH {A.SQL_SEQS}, x AS (SELECT 'doc' || doc_id AS name, seq, length(seq) AS n FROM seqs WHERE length(seq) > 0)"""
_WRAP = "(SELECT string_agg(substr({0}, k * 80 + 1, 80) || chr(10), '' ORDER BY k) FROM range((length({0}) + 79) // 80) AS r(k))"
_RC = "reverse(translate(seq, 'ACGTacgtNn', 'TGCAtgcaNn'))"
_NUMBERS = "printf('%.1f', n % 40 + 0.25) || ' pct_Q20=' || printf('%.1f', n % 100 + 0.5)"


@query("search_pair", _EXPORT + f""" SELECT name, '>' || name || '_forward length=' || n || ' blast_window=0-' || n || ' mean_Q=' || {_NUMBERS} || ' est_identity=' || printf('%.1f', n % 7 + 90.125) || '%' || chr(10) || {_WRAP.format("seq")} AS forward,
 '>' || name || '_reverse_complement length=' || n || ' blast_window=0-' || n || ' mean_Q=' || {_NUMBERS} || ' est_identity=' || printf('%.1f', n % 7 + 90.125) || '%' || chr(10) || {_WRAP.format(_RC)} AS reverse FROM x""")
def export_pair(spark, sf_dir):
    return search_pair(_export_rows(spark, sf_dir))


@query("multi_fasta", _EXPORT + f""" SELECT name, '>' || name || ' length=' || n || ' mean_Q=' || {_NUMBERS} || ' est_id=' || printf('%.1f', n % 7 + 90.125) || '%' || chr(10) || {_WRAP.format("seq")} AS record FROM x""")
def multi_fasta(spark, sf_dir):
    return _export_rows(spark, sf_dir).select("name", fasta_record(batch_headers(), F.col("sequence")).alias("record"))


@query("single_headers", _EXPORT + f""" SELECT name, 'sanger_sequence length=' || n || ' mean_Q=' || {_NUMBERS} || ' shifts=G0_A1_T-1_C2' || CASE WHEN n % 3 > 0 THEN ' primer_trim=' || n % 3 ELSE '' END || CASE WHEN n % 2 > 0 THEN ' het=1' ELSE '' END AS plain,
 'sanger_sequence_window_trimmed length=' || n || ' mean_Q=' || {_NUMBERS} || ' window_size=20 window_min_q=20 shifts=G0_A1_T-1_C2' || CASE WHEN n % 3 > 0 THEN ' primer_trim=' || n % 3 ELSE '' END AS trimmed,
 'sanger_reverse_complement length=' || length(trim(seq, 'N')) || ' mean_Q=' || {_NUMBERS} || ' shifts=G0_A1_T-1_C2' AS rc FROM x""")
def single_headers(spark, sf_dir):
    s = (0, 1, -1, 2)
    return _export_rows(spark, sf_dir).select("name", single_header("sequence", s).alias("plain"), single_header("sequence_window_trimmed", s, (20, 20.0)).alias("trimmed"), single_header("reverse_complement", s).alias("rc"))


# The same exports from calls, through the pipeline's summary; five sample names repeat.


def _summary(spark, sf_dir):
    calls = A.calls(spark, sf_dir)
    fields = {"time": F.col("pos").cast("double"), "channel": F.lit(0), "amplitude": F.lit(0.0), "score": F.lit(0.0), "noise": F.lit(0.0), "het_channel": F.lit(-1), "het_ratio": F.lit(0.0)}
    call = F.struct("ordinal", "pos", "letter", "phred", "snr", "isolation", "shape_score", "spacing_score", "tail_rescued", "imputed", "heterozygote", *[v.alias(k) for k, v in fields.items()])
    results = calls.groupBy("trace_id").agg(F.sort_array(F.collect_list(call)).alias("calls"))
    named = results.withColumns({"path": F.concat(F.lit("/traces/t"), "trace_id", F.lit(".ab1")), "sample_name": F.when(F.col("trace_id") % 6 == 0, "").otherwise(F.concat(F.lit("s"), F.col("trace_id") % 5)), "mobility_applied": F.lit(False), "blob_end": F.lit(0), "error": F.lit(None).cast("string")})
    return PL.summarise(named)


_SUMMED = f"""{A.SQL_CALLS}, {_LADDER}, {_TRIM}, {_STATS}, {_ASSEMBLED},
x AS (SELECT trace_id, CASE WHEN trace_id % 6 = 0 THEN 't' || trace_id ELSE 's' || trace_id % 5 END AS name, sequence AS whole, substr(sequence, CAST(blast_start AS INT) + 1, CAST(blast_end - blast_start AS INT)) AS seq, substr(sequence, CAST(a AS INT) + 1, CAST(b - a AS INT)) AS cut,
 blast_start, blast_end, printf('%.1f', mean_phred) AS q, printf('%.1f', CASE WHEN confirmed_bases > 0 THEN 100.0 * q20_count / confirmed_bases ELSE 0 END) AS share, printf('%.1f', blast_est_identity) AS est, heterozygote_bases AS het, imputed_bases AS imp
 FROM joined JOIN blast USING (trace_id) JOIN stats USING (trace_id) JOIN est USING (trace_id) JOIN seg20 USING (trace_id))"""
_PAIR = "length=' || length(seq) || ' blast_window=' || blast_start || '-' || blast_end || ' mean_Q=' || q || ' pct_Q20=' || share || ' est_identity=' || est || '%' || chr(10)"


@query("export_pairs", f"""WITH {_SUMMED} SELECT name, '>' || name || '_forward {_PAIR} || {_WRAP.format("seq")} AS forward, '>' || name || '_reverse_complement {_PAIR} || {_WRAP.format(_RC)} AS reverse FROM x WHERE length(seq) > 0""")
def export_pairs(spark, sf_dir):
    return search_pair(exportable(_summary(spark, sf_dir)))


_SINGLE = "mean_Q=' || q || ' pct_Q20=' || share || '"
_PLAIN, _TURNED = "trim(seq, 'N')", f"trim({_RC}, 'N')"


@query("export_singles", f"""WITH {_SUMMED} SELECT name, CASE WHEN length({_PLAIN}) > 0 THEN '>sanger_sequence length=' || length({_PLAIN}) || ' {_SINGLE} shifts=G0_A1_T-1_C2' || CASE WHEN het > 0 THEN ' het=' || het ELSE '' END || CASE WHEN imp > 0 THEN ' imputed=' || imp ELSE '' END || chr(10) || {_WRAP.format(_PLAIN)} ELSE '' END AS plain,
 CASE WHEN length(cut) > 0 THEN '>sanger_sequence_window_trimmed length=' || length(cut) || ' {_SINGLE} window_size=20 window_min_q=20 shifts=G0_A1_T-1_C2' || chr(10) || {_WRAP.format("cut")} ELSE '' END AS trimmed,
 CASE WHEN length({_TURNED}) > 0 THEN '>sanger_reverse_complement length=' || length({_TURNED}) || ' {_SINGLE} shifts=G0_A1_T-1_C2' || chr(10) || {_WRAP.format(_TURNED)} ELSE '' END AS rc FROM x WHERE length(seq) > 0""")
def export_singles(spark, sf_dir):
    return single_records(exportable(_summary(spark, sf_dir)), (0, 1, -1, 2), (20, 20.0))


@query("search_input", f"WITH {_SUMMED} SELECT trace_id, CASE WHEN seq <> '' THEN seq ELSE trim(whole, 'N') END AS query, CASE WHEN seq <> '' THEN length(seq) ELSE length(trim(whole, 'N')) END < 100 AS offer_reverse FROM x")
def search_input(spark, sf_dir):
    return B.search_policy(_summary(spark, sf_dir))
