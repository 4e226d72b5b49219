"""The data source, the ordered sink and the functions on tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.functions import tables
from lanewise.operators import calls as C
from lanewise.sinks import record_sink
from lanewise.sinks.abif import abif_bytes
from lanewise.sinks.files import write_files
from lanewise.sources import trace_source
from lanewise.sources.readers import read_traces

RNG = np.random.default_rng(12)


@pytest.fixture()
def folder(tmp_path):
    for k in range(5):
        (tmp_path / f"t{k}.ab1").write_bytes(abif_bytes(RNG.integers(0, 99, (4, 30)), name=f"n{k}"))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.csv").write_text("1;2;3;4\n5;6;7;8\n")
    (tmp_path / "broken.ab1").write_bytes(b"nothing")
    (tmp_path / "notes.md").write_text("not a trace")
    (tmp_path / ".hidden.csv").write_text("1;2;3;4\n")
    return tmp_path


def test_traces_equal_the_reader(spark, folder):
    trace_source.register(spark)
    ours = spark.read.format("traces").load(str(folder))
    theirs = read_traces(spark, [str(folder / "*.ab1"), str(folder / "sub")])
    plain = lambda df: sorted(map(repr, df.drop("path").collect()))
    assert plain(ours) == plain(theirs) and len(plain(ours)) == 7
    assert [r["error"][:10] for r in ours.filter("error IS NOT NULL").collect()] == ["ValueError"]


def test_groups_and_columns(spark, folder):
    trace_source.register(spark)
    read = lambda **o: spark.read.format("traces").options(**o)
    assert read(groupBytes=1).load(str(folder)).rdd.getNumPartitions() == 7
    assert read().load(str(folder)).rdd.getNumPartitions() == 1
    few = read().schema("n_samples int, trace_id string").load(str(folder / "t*.ab1"))
    assert sorted(map(tuple, few.collect())) == [(30, f"t{k}") for k in range(5)]
    os.chmod(folder / "t0.ab1", 0)
    (folder / "t1.ab1").write_bytes(b"")
    assert read().schema("trace_id string, format string").load(str(folder)).count() == 7
    assert [r[0] for r in read(format="csv").schema("trace_id string").load(str(folder / "sub" / "a.csv")).collect()] == ["a"]
    sizes = [g.paths for g in trace_source.grouped([(0, "a", 5), (0, "b", 5), (0, "c", 50), (0, "d", 1), (0, "e", 1)], 10)]
    assert sizes == [["a", "b"], ["c"], ["d", "e"]]


def test_stream_reads_each_file_once(spark, folder, tmp_path_factory):
    trace_source.register(spark)
    out = tmp_path_factory.mktemp("out")

    def run():
        stream = spark.readStream.format("traces").schema("trace_id string, n_samples int").load(str(folder))
        stream.writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "log")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(str(out / "rows")).collect())

    assert run() == ["a", "broken", "t0", "t1", "t2", "t3", "t4"]
    (folder / "new.csv").write_text("1;2;3;4\n")
    assert run() == ["a", "broken", "new", "t0", "t1", "t2", "t3", "t4"]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f"/x/{k}.csv", f"{k};1;1;1\n".encode()) for k in range(9)], "path string, content binary").repartition(3)
    assert write_files(df, str(tmp_path / "f")) == 9
    assert sorted(os.listdir(tmp_path / "f")) == [f"{k}.csv" for k in range(9)]


def lines(folder):
    return [x for f in sorted(os.listdir(folder)) if f.startswith("part-") for x in (folder / f).read_text().splitlines()]


def test_ordered_records(spark, tmp_path):
    small = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")
    try:
        ordered(spark, tmp_path)
    finally:
        spark.conf.unset(small)


def ordered(spark, tmp_path):
    rows = [(int(k), f">r{k}\nACGT\n" if k % 7 else "") for k in RNG.permutation(500)]
    df = spark.createDataFrame(rows, "k long, record string").repartition(5)
    record_sink.write_ordered(df, str(tmp_path / "o"), "k", header="#h")
    names = sorted(os.listdir(tmp_path / "o"))
    assert "_SUCCESS" in names and not [n for n in names if n.startswith("_job")]
    parts = [n for n in names if n.startswith("part-")]
    assert len(parts) > 1 and parts == [f"part-{k:05d}.fasta" for k in range(len(parts))]
    assert [x for x in lines(tmp_path / "o") if x.startswith(">")] == [f">r{k}" for k in range(500) if k % 7]
    assert lines(tmp_path / "o").count("#h") == len(parts)
    with pytest.raises(Exception, match="holds records already"):
        record_sink.write_ordered(df, str(tmp_path / "o"), "k")
    record_sink.write_ordered(df.limit(0), str(tmp_path / "o"), "k", overwrite=True)
    assert os.listdir(tmp_path / "o") == ["_SUCCESS"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    record_sink.register(spark)
    df = spark.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("record"))
    with pytest.raises(Exception, match="broken"):
        df.write.format("records").mode("append").save(str(tmp_path / "o"))
    assert not (tmp_path / "o").exists() or os.listdir(tmp_path / "o") == []


def test_table_functions(spark):
    tables.register(spark)
    rows = [(t, i, int(q)) for t, n in enumerate((1, 19, 20, 60)) for i, q in enumerate(RNG.integers(15, 26, n))]
    calls = spark.createDataFrame(rows, "trace_id int, ordinal long, phred int")
    calls.createOrReplaceTempView("calls_x")
    got = spark.sql("SELECT * FROM trim_reads(TABLE(calls_x) PARTITION BY trace_id ORDER BY (ordinal), 20.0D, 20)")
    assert dict(got.dtypes) == {"trace_id": "int", "start": "bigint", "end": "bigint"}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, C.window_trim(calls).collect()))
    found = spark.createDataFrame([("t", p, c, float(a)) for p, c, a in [(0, 0, 5), (2, 1, 5), (4, 0, 1), (6, 0, 9), (30, 2, 3)]], "trace_id string, pos long, ch int, amp double")
    found.createOrReplaceTempView("found_x")
    merged = spark.sql("SELECT * FROM merge_clusters(TABLE(found_x) PARTITION BY trace_id ORDER BY (pos, ch), 3)")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, C.resolve(C.clusters(found, 3)).select(*merged.columns).collect())) == [("t", 0, 0, 0, 5.0), ("t", 1, 6, 0, 9.0), ("t", 2, 30, 2, 3.0)]
    with pytest.raises(Exception, match="no column ordinal, phred"):
        spark.sql("SELECT * FROM trim_reads(TABLE(found_x) PARTITION BY trace_id ORDER BY (pos), 20.0D, 20)").collect()
