"""Readers, writers, report parsers, client and stream."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.blast import parse as B
from lanewise.blast.client import Client
from lanewise.params import PipelineParams
from lanewise.plans import pipeline as PL
from lanewise.sinks.abif import abif_bytes
from lanewise.sinks.fasta import fasta_record, reverse_path, write_records
from lanewise.sinks.tables import matrix_text, peak_table, summary_table, write_csv, write_matrix
from lanewise.sources import matrices as MX
from lanewise.sources import readers as R
from lanewise.streaming.drop import incoming, process_stream
from test_kernels import chromatogram

RNG = np.random.default_rng(3)


def test_abif_round_trip_and_fallbacks():
    y = RNG.integers(0, 900, (4, 40))
    t = R.parse_abif(abif_bytes(y, bases="GATTACA", quality=[10, 20, 30], places=[5, 17, 29], name="one"))
    assert t["signals"] == y.astype(float).tolist() and t["kb_bases"] == "GATTACA" and t["kb_quality"] == [10, 20, 30]
    assert t["peak_locs"] == [5, 17, 29] and t["sample_name"] == "one" and t["data_source"] == "1-4 (raw)"
    assert R.parse_abif(abif_bytes(y[[3, 2, 1, 0]], dyes="CTAG"))["signals"] == y.astype(float).tolist()
    assert R.parse_abif(abif_bytes(y, first=9))["data_source"] == "9-12 (analysed, fallback)"
    assert R.parse_abif(abif_bytes(y, first=9), prefer_raw=False)["data_source"] == "9-12 (analysed)"
    assert R.parse_abif(abif_bytes(y[:2]))["signals"][2] == [0.0] * 40  # a missing channel
    with pytest.raises(ValueError):
        R.parse_abif(b"nope" + bytes(200))
    with pytest.raises(ValueError):
        R.parse_abif(abif_bytes(np.zeros((0, 4))))


def test_abif_compact_layout():
    """The option for files whose directory has 22-byte entries, unlike the published layout."""
    import struct

    y = RNG.integers(0, 900, (4, 30))
    entries, body, at = [], b"", 64
    for k, row in enumerate(y):
        value = row.astype(">i2").tobytes()
        entries.append(struct.pack(">4sihiii", b"DATA", k + 1, 4, 2, 30, at))
        body += value
        at += len(value)
    head = b"ABIF".ljust(40, b"\0") + struct.pack(">ii", 4, at)
    data = head.ljust(64, b"\0") + body + b"".join(entries)
    assert R.parse_abif(data, layout="compact")["signals"] == y.astype(float).tolist()


def test_srd():
    point = lambda *v: "<Point><Data>" + "".join(f"<int>{x}</int>" for x in v) + "</Data></Point>"
    text = f"<R><TimeStep>20</TimeStep>{point(1, 2, 3, 4)}<A><B>{point(5, 6, 7, 8, 9)}</B></A>{point(1, 2)}</R>"
    t = R.parse_srd(text.encode())
    assert t["signals"] == [[1, 5], [2, 6], [3, 7], [4, 8]] and t["time"] == [0.0, 0.02]
    assert R.parse_srd(text.encode(), legacy_time_step=True)["time"] == [0.0, 0.01]  # the file's step is left unread
    with pytest.raises(ValueError):
        R.parse_srd(b"<R></R>")


def test_signal_csv():
    assert R.parse_signal_csv(b"10;20;5;3;\n11;21;6;4;\n")["signals"] == [[10, 11], [20, 21], [5, 6], [3, 4]]
    t = R.parse_signal_csv(b"time,G,A,T,C\n0.5,1,2,3,4\n1.5,5,6,7,8\n")
    assert t["time"] == [0.5, 1.5] and t["signals"][3] == [4, 8]
    assert R.parse_signal_csv(b"name,G,A,T,C\nx,1,2,3,4\n")["signals"] == [[1], [2], [3], [4]]
    for broken in (b"G,A\n1,2\n", b"1;2;3\n1;2\n"):
        with pytest.raises(ValueError):
            R.parse_signal_csv(broken)


def test_matrices(spark, tmp_path):
    m = np.arange(16).reshape(4, 4) / 3
    for mark in (";", ",", "\t", "  "):
        assert np.allclose(MX.parse_matrix("# note\n" + "\n".join(mark.join(map(repr, map(float, r))) for r in m)), m)
    with pytest.raises(ValueError):
        MX.parse_matrix("1,2\n3,4")
    (tmp_path / "crosstalk.csv").write_text(matrix_text(m))
    assert np.allclose(MX.beside(spark, f"{tmp_path}/x.ab1"), m)
    assert MX.beside(spark, f"{tmp_path}/none/x.ab1") is None
    write_matrix(spark, m, f"{tmp_path}/out")
    assert np.allclose(MX.read_matrix(spark, f"{tmp_path}/out"), m)


def test_batch_isolates_errors_and_exports(spark, tmp_path):
    want, y, m = chromatogram(60)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/good.ab1").write_bytes(abif_bytes(np.rint(y), name="good"))
    (tmp_path / "in/bad.ab1").write_bytes(b"ABIX")
    (tmp_path / "in/plain.csv").write_text("\n".join(";".join(str(int(v)) for v in row) for row in y.T))
    traces = R.batch_files(R.read_traces(spark, f"{tmp_path}/in"))
    p = PipelineParams.interactive(matrix=tuple(map(tuple, m)), mobility_enabled=False, unknown=1)
    results = PL.run(traces, p, stages=True).persist()
    rows = {r["trace_id"]: r for r in results.collect()}
    assert rows["bad"]["error"] and not rows["bad"]["calls"]
    assert len(rows["good"]["calls"]) > 50 and len(rows["plain"]["calls"]) > 50 and set(rows["good"]["stages"]) == set(PL.STAGES)
    out = {r["trace_id"]: r for r in PL.summarise(results, p).collect()}
    assert out["good"]["sequence"][::-1].translate(str.maketrans("GATC", "CTAG")) == out["good"]["sequence_rc"]
    assert out["good"]["quality_stats"]["total_bases"] == len(out["good"]["sequence"]) and out["bad"]["sequence"] == ""
    primed = PL.summarise(results, p.but(primer_sequence=out["good"]["sequence"][:12])).filter("trace_id = 'good'").first()
    assert primed["primer_trim_pos"] == 12 and primed["sequence"] == out["good"]["sequence"][12:] and primed["avg_quality"] == out["good"]["avg_quality"]
    write_csv(peak_table(PL.base_calls(results)).drop("trace_id", "ordinal"), f"{tmp_path}/peaks")
    back = spark.read.option("header", True).csv(f"{tmp_path}/peaks")
    assert len(back.columns) == 19 and back.count() == sum(len(r["calls"]) for r in rows.values())
    write_csv(summary_table(PL.summarise(results, p)), f"{tmp_path}/summary")
    assert len(spark.read.option("header", True).csv(f"{tmp_path}/summary").columns) == 22


def test_fasta_files(spark, tmp_path):
    seqs = spark.createDataFrame([("b", "A" * 165), ("a", "G" * 80), ("c", "")], "name string, seq string")
    write_records(seqs.select("name", fasta_record(F.col("name"), F.col("seq")).alias("record")), f"{tmp_path}/fa", order="name")
    text = "".join(open(f).read() for f in glob.glob(f"{tmp_path}/fa/part*"))
    assert text == ">a\n" + "G" * 80 + "\n>b\n" + "A" * 80 + "\n" + "A" * 80 + "\nAAAAA\n>c\n"
    # one _rc before the ending; a second one would come from replacing .fa within .fasta
    assert [reverse_path(p) for p in ("x.fasta", "x.fa", "x.txt")] == ["x_rc.fasta", "x_rc.fa", "x.txt_rc.fasta"]


REPORT = f"""BLASTN
{B.MARK}:

ACC1 first hit thing  120  1e-30
short
ACC2 second hit  bad  1e-9
ACC3 third 99.5 2e-8

ACC9 after the table 5 1
 Identities = 9/10 (90%), Gaps
 Identities = 99/100 (99%)
 Query Cover: 95%
"""


def test_text_reports(spark):
    df = spark.createDataFrame([(1, REPORT), (2, "No significant similarity found"), (3, None)], "query_id int, report string")
    got = [tuple(r) for r in B.text_hits(df).orderBy("rank").collect()]
    assert got == [(1, 1, "ACC1", "first hit thing", 120.0, "1e-30", 90, 95), (1, 2, "ACC3", "third", 99.5, "2e-8", 99, None)]


def test_the_first_of_two_tables_counts(spark):
    from lanewise.blast.table_function import TextHits

    two = REPORT + "\nSequences producing significant alignments:\n\nACC77 other 5.0 1e-3\n\n"
    got = [r["accession"] for r in B.text_hits(spark.createDataFrame([(1, two)], "query_id int, report string")).orderBy("rank").collect()]
    assert got == ["ACC1", "ACC3"] == [r[1] for r in TextHits().eval(two)]


def test_exports_of_the_pipelines_result(spark):
    """Search pair, batch file and single files from a summary; two reads of one name stay two."""
    from lanewise.sinks.fasta import batch_headers, exportable, fasta_record, search_pair, single_records

    stats = "struct<blast_start:bigint,blast_end:bigint,mean_phred:double,pct_q20:double,blast_est_identity:double>"
    rows = [
        ("t1", "/x/a.ab1", "same", "NNACGTACGTNN", "CGTAC", "ACGTA", (2, 7, 31.25, 80.0, 99.5), 0, 0, 0),
        ("t2", "/x/b.ab1", "same", "TTTT", "", "", (0, 0, 20.0, 50.0, 90.0), 3, 1, 2),
        ("t3", "/x/c.ab1", None, "NACN", "", "AC", (1, 3, 20.0, 50.0, 90.0), 0, 0, 0),
        ("t4", "/x/d.ab1", "", "NN", "", "", None, 0, 0, 0),
    ]
    df = exportable(spark.createDataFrame(rows, f"trace_id string, path string, sample_name string, sequence string, window_trimmed_seq string, blast_window string, quality_stats {stats}, primer_trim_pos int, n_heterozygotes int, n_imputed int"))
    pairs = {(r["name"], r["forward"].split("\n")[1], r["reverse"].split("\n")[1]) for r in search_pair(df).collect()}
    assert pairs == {("same", "ACGTA", "TACGT"), ("same", "TTTT", "AAAA"), ("c", "AC", "GT")} and search_pair(df).count() == 3
    multi = {r[0] for r in df.select(fasta_record(batch_headers(), F.col("sequence"))).collect()}
    assert ">c length=2 mean_Q=20.0 pct_Q20=50.0 est_id=90.0%\nAC\n" in multi and len(multi) == 3
    single = {r["plain"]: r for r in single_records(df, (0, 1, -1, 2), (20, 20.0)).collect()}
    first = next(r for k, r in single.items() if k.endswith("ACGTA\n"))
    assert first["trimmed"].startswith(">sanger_sequence_window_trimmed length=5 ") and first["trimmed"].endswith("\nCGTAC\n") and first["rc"].endswith("\nTACGT\n")
    assert all(r["trimmed"] == "" for k, r in single.items() if r is not first)


def test_table_function(spark):
    from lanewise.blast.table_function import register

    register(spark)
    df = spark.createDataFrame([(1, REPORT), (2, "nothing"), (3, None)], "query_id int, report string")
    df.createOrReplaceTempView("reports")
    got = spark.sql("SELECT query_id, h.* FROM reports, LATERAL parse_blast_text(report) h ORDER BY rank").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in B.text_hits(df).orderBy("rank").collect()]


def test_json_reports(spark):
    good = '<p>{"BlastOutput2":[{"report":{"results":{"search":{"hits":[{"description":[{"title":"t"}],"hsps":[{"bit_score":5.5,"evalue":0.00012,"identity":9,"align_len":10}]},{"description":[{}],"hsps":[]}]}}}}]}</p>'
    df = spark.createDataFrame([(1, good), (2, "{broken"), (3, "")], "query_id int, report string")
    got = [tuple(r) for r in B.json_hits(df).orderBy("rank").collect()]
    assert got[0] == (1, 1, "?", "t", 5.5, "1.20e-04", 90, None, 10, 0) and len(got) == 2


def test_client():
    replies = iter(["RID = ABC1", "Status=WAITING", "?", "ThereAreHits=yes", "Query= 1\nreport"])
    asked = []
    client = Client("a@b.c", lambda method, fields: asked.append(fields) or next(replies), key="k", sleep=lambda s: None)
    assert client.search("ACGT") == "Query= 1\nreport" and asked[0]["WORD_SIZE"] == "28" and asked[0]["QUERY"] == ">query\nACGT" and asked[-1]["FORMAT_TYPE"] == "Text"
    with pytest.raises(TimeoutError):
        Client("a@b.c", lambda m, f: "RID = X" if m == "POST" else "?", sleep=lambda s: None).search("A")
    with pytest.raises(RuntimeError):
        Client("a@b.c", lambda m, f: "RID = X" if m == "POST" else "Status=FAILED", sleep=lambda s: None).search("A")
    for page in ("Status=WAITING", "", "<html>Error 500: try again later</html>"):
        with pytest.raises(RuntimeError, match="no report"):
            Client("a@b.c", lambda m, f, page=page: page).retrieve("X")
    for page in ("No significant similarity found", "<BlastOutput>", '{"BlastOutput2":[]}', "Sequences producing"):
        assert Client("a@b.c", lambda m, f, page=page: page).retrieve("X") == page
    with pytest.raises(ValueError):
        Client("nobody", lambda m, f: "")


@pytest.mark.parametrize("format", ["Text", "JSON2", "XML"])
def test_from_sequence_to_hits(spark, format):
    xml = "<BlastOutput><BlastOutput_query-len>80</BlastOutput_query-len><BlastOutput_iterations><Iteration><Iteration_hits><Hit><Hit_id>i</Hit_id><Hit_def>d</Hit_def><Hit_accession>A1</Hit_accession><Hit_hsps><Hsp><Hsp_score>5</Hsp_score><Hsp_evalue>0.1</Hsp_evalue><Hsp_query-from>1</Hsp_query-from><Hsp_query-to>41</Hsp_query-to><Hsp_identity>9</Hsp_identity><Hsp_gaps>0</Hsp_gaps><Hsp_align-len>10</Hsp_align-len></Hsp></Hit_hsps></Hit></Iteration_hits></Iteration></BlastOutput_iterations></BlastOutput>"
    json = '{"BlastOutput2":[{"report":{"results":{"search":{"hits":[{"description":[{"accession":"A1","title":"t"}],"hsps":[{"bit_score":5.5,"evalue":0.1,"identity":9,"align_len":10}]}]}}}}]}'
    text = f"Query= 1\n{B.MARK}:\n\nA1 some words 5.5 1e-9\n\n Identities = 9/10 (90%)\n"
    page = {"Text": text, "JSON2": json, "XML": xml}[format]
    client = Client("a@b.c", lambda m, f: "RID = R1" if m == "POST" else "Status=READY" if "FORMAT_OBJECT" in f else page, sleep=lambda s: None)
    got = client.hits(spark, {"one": "ACGT", "two": "AC"}, format).select("query_id", "rank", "accession", "identity_pct").collect()
    assert sorted(map(tuple, got)) == [("one", 1, "A1", 90), ("two", 1, "A1", 90)]
    assert B.report_kinds(spark.createDataFrame([(1, page), (2, "<html>"), (3, "No significant similarity found")], "query_id int, page string")).orderBy("query_id").collect() == [(1, {"Text": "text", "JSON2": "json", "XML": "xml"}[format]), (2, "page"), (3, "none")]


def test_an_xml_report_is_parsed_once(spark):
    plan = B.xml_hits(spark.createDataFrame([(1, "x")], "query_id int, report string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1


def test_line_ends_of_either_kind(spark):
    from lanewise.blast.table_function import register

    register(spark)
    df = spark.createDataFrame([(1, REPORT), (2, REPORT.replace("\n", "\r\n"))], "query_id int, report string")
    df.createOrReplaceTempView("reports_x")
    one, two = (spark.sql(f"SELECT h.* FROM reports_x, LATERAL parse_blast_text(report) h WHERE query_id = {k} ORDER BY rank").collect() for k in (1, 2))
    assert one and one == two == [r[1:] for r in B.text_hits(df.filter("query_id = 2")).orderBy("rank").collect()]


def test_catalogue(spark):
    rows = B.catalogue(spark).collect()
    assert [r["name"] for r in rows if r["kind"] == "program"] == list(B.PROGRAMS) and len(rows) == len(B.DATABASES) + 2


def test_replies_and_policy(spark):
    df = spark.createDataFrame([(1, "Status=WAITING"), (2, "ThereAreHits=yes"), (3, "x"), (4, "Status=FAILED RID = Q7")], "query_id int, reply string")
    assert [r[1] for r in B.statuses(df).orderBy("query_id").collect()] == ["WAITING", "READY", "UNKNOWN", "FAILED"]
    assert B.request_ids(df).filter("query_id = 4").first()[1] == "Q7"
    rows = spark.createDataFrame([(1, "", "NNACGTN"), (2, "A" * 120, "x")], "trace_id int, blast_window string, sequence string")
    assert [tuple(r) for r in B.search_policy(rows).orderBy("trace_id").collect()] == [(1, "ACGT", True), (2, "A" * 120, False)]


def test_stream(spark, tmp_path):
    (tmp_path / "drop").mkdir()
    _, y, m = chromatogram(40)
    p = PipelineParams.interactive(matrix=tuple(map(tuple, m)), mobility_enabled=False)
    for name in ("one", "two"):
        (tmp_path / f"drop/{name}.ab1").write_bytes(abif_bytes(np.rint(y)))
        process_stream(incoming(spark, f"{tmp_path}/drop"), f"{tmp_path}/out", f"{tmp_path}/check", p, once=True).awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["trace_id"] for r in got.collect()) == ["one", "two"]
    assert os.path.isdir(tmp_path / "check")


def test_reports_hold_all_rows(spark):
    from lanewise.plans import trace_queries as Q
    from lanewise.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    assert Q._hits(spark, sf).selectExpr("sum(size(h))").first()[0] == lines.count() > 20 * lines.select("l_suppkey").distinct().count()
    assert [QUERIES[f"blast_{k}_all"](spark, sf).count() for k in ("text", "json", "xml")] == [lines.count()] * 3
