"""Operators on base calls: one row a call, with trace_id and ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.arrays import let, percentile, scan
from ..functions.scalars import one_decimal, quality_letters, readiness, reverse_complement

#: Thresholds of the search window, in the order in which they are tried, and the length that settles it.
LADDER, ENOUGH, READY = (30.0, 25.0, 20.0, 15.0, 10.0), 150, 100


def _read() -> WindowSpec:
    return Window.partitionBy("trace_id").orderBy("ordinal")


def _so_far() -> WindowSpec:
    return _read().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def best_segments(calls: DataFrame, thresholds: tuple[float, ...], window: int = 20, *extra: Column, cost: Column | None = None) -> DataFrame:
    """Per trace the segment of largest summed (phred - threshold), for each threshold: start_k and end_k (exclusive).

    One fold over a trace's calls serves all thresholds: a sum that isn't positive starts anew at the next call, so the
    first end of the largest sum and, for it, the latest start win. Reads shorter than `window` are kept whole if their
    mean reaches the threshold. One shuffle by trace. With `cost` also cost_k, its sum over the segment, and cost_all."""
    call = F.struct("ordinal", F.col("phred").cast("double").alias("phred"), (F.lit(0.0) if cost is None else cost).alias("cost"))
    rows = calls.groupBy("trace_id").agg(F.count("*").alias("n"), F.avg("phred").alias("_mean"), F.sort_array(F.collect_list(call)).alias("_calls"), *extra)
    return _segments(rows, thresholds, window, cost is not None)


def _segments(rows: DataFrame, thresholds: tuple[float, ...], window: int, costs: bool) -> DataFrame:
    """rows (n, _mean, _calls in order, and others) with the segments in place of _mean and _calls."""
    kind = "struct<spent:double,segments:array<struct<q:double,now:double,since:bigint,before:double,best:double,start:bigint,last:bigint,cost:double>>>"
    none = F.struct(F.lit(0.0).alias("spent"), F.array(*[F.struct(F.lit(float(q)), F.lit(0.0), F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(0), F.lit(-1), F.lit(0.0)) for q in thresholds]).alias("segments")).cast(kind)

    def step(acc: Column, x: Column) -> Column:
        def grown(s: Column) -> Column:
            new = s["now"] <= 0
            now = F.when(new, F.lit(0.0)).otherwise(s["now"]) + (x["phred"] - s["q"])
            since, before = F.when(new, x["ordinal"]).otherwise(s["since"]), F.when(new, acc["spent"]).otherwise(s["before"])
            better = now > s["best"]
            kept = {"best": now, "start": since, "last": x["ordinal"], "cost": acc["spent"] + x["cost"] - before}
            return F.struct(s["q"].alias("q"), now.alias("now"), since.alias("since"), before.alias("before"), *[F.when(better, v).otherwise(s[k]).alias(k) for k, v in kept.items()])

        return F.struct((acc["spent"] + x["cost"]).alias("spent"), F.transform(acc["segments"], grown).alias("segments")).cast(kind)

    # a generator's output is worked out once, whatever reads it
    out = rows.select("*", F.inline(F.array(F.struct(F.aggregate("_calls", none, step).alias("_fold")))))
    for k, q in enumerate(thresholds):
        best = F.get("_fold.segments", F.lit(k))
        short, some = F.col("n") < window, best["best"] > 0
        whole = F.when(F.col("_mean") >= q, F.col("n")).otherwise(F.lit(0))
        out = out.withColumn(f"start_{k}", F.when(short | ~some, F.lit(0)).otherwise(best["start"]).cast("bigint"))
        if costs:
            out = out.withColumn(f"cost_{k}", F.when(short, F.when(F.col("_mean") >= q, F.col("_fold.spent")).otherwise(0.0)).when(some, best["cost"]).otherwise(0.0))
        out = out.withColumn(f"end_{k}", F.when(short, whole).when(some, best["last"] + 1).otherwise(F.lit(0)).cast("bigint"))
    if costs:
        out = out.withColumn("cost_all", F.col("_fold.spent"))
    return out.drop("_mean", "_calls", "_fold")


def window_trim(calls: DataFrame, min_q: float = 20.0, window: int = 20) -> DataFrame:
    """trace_id, start, end of the trimmed read."""
    return best_segments(calls, (min_q,), window).select("trace_id", F.col("start_0").alias("start"), F.col("end_0").alias("end"))


def _search_window(segments: DataFrame, first: int = 0) -> DataFrame:
    """start, end of the first threshold whose segment is long enough; else the whole read."""
    costs = "cost_all" in segments.columns
    start, end, cost = F.lit(0).cast("bigint"), F.col("n").cast("bigint"), F.col("cost_all") if costs else None
    for k in reversed(range(len(LADDER))):
        enough = F.col(f"end_{first + k}") - F.col(f"start_{first + k}") >= ENOUGH
        start = F.when(enough, F.col(f"start_{first + k}")).otherwise(start)
        end = F.when(enough, F.col(f"end_{first + k}")).otherwise(end)
        cost = F.when(enough, F.col(f"cost_{first + k}")).otherwise(cost) if costs else None
    return segments.withColumns({"blast_start": start, "blast_end": end} | ({"blast_cost": cost} if costs else {}))


def search_window(calls: DataFrame) -> DataFrame:
    """trace_id, blast_start, blast_end."""
    return _search_window(best_segments(calls, LADDER)).select("trace_id", "blast_start", "blast_end")


def end_trim(calls: DataFrame, min_phred: int = 15) -> DataFrame:
    """trace_id, start, end between the first and last call of enough quality."""
    good = F.when(F.col("phred") >= min_phred, F.col("ordinal"))
    out = calls.groupBy("trace_id").agg(F.min(good).alias("lo"), F.max(good).alias("hi"))
    return out.select("trace_id", F.coalesce("lo", F.lit(0)).cast("bigint").alias("start"), F.coalesce(F.col("hi") + 1, F.lit(0)).cast("bigint").alias("end"))


def quality_stats(calls: DataFrame, min_q: float = 20.0, window: int = 20) -> DataFrame:
    """The statistics of each read: counts over all calls, means over confirmed ones, trimmed and search windows. The calls
    are read and shuffled once; the search window's expected errors are a difference of prefix sums."""
    sure = ~F.col("tail_rescued") & ~F.col("imputed")
    of = lambda c: F.when(sure, F.col(c))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    counts = [
        F.count("*").alias("total_bases"),
        F.count_if(sure).alias("confirmed_bases"),
        F.count_if(F.col("tail_rescued") & ~F.col("imputed")).alias("tail_rescued"),
        F.count_if("imputed").alias("imputed_bases"),
        F.count_if("heterozygote").alias("heterozygote_bases"),
        zero(F.avg(of("phred"))).alias("mean_phred"),
        zero(F.median(of("phred"))).alias("median_phred"),
        F.coalesce(F.min(of("phred")), F.lit(0)).alias("min_phred"),
        F.coalesce(F.max(of("phred")), F.lit(0)).alias("max_phred"),
        *[F.count_if(sure & (F.col("phred") >= q)).alias(f"q{q}_count") for q in (20, 30, 35)],
        zero(F.avg(of("snr"))).alias("mean_snr"),
        zero(F.avg(of("isolation"))).alias("mean_isolation"),
        zero(F.avg(of("shape_score"))).alias("mean_shape_score"),
    ]
    wrong = F.pow(F.lit(10.0), -F.col("phred") / 10.0)
    return _statistics(_search_window(best_segments(calls, (min_q, *LADDER), window, *counts, cost=wrong), 1))


def row_statistics(reads: DataFrame, min_q: float = 20.0, window: int = 20) -> DataFrame:
    """quality_stats() of rows (trace_id, calls), a read's calls as an array in their order, with start and end of the trimmed
    window and the other columns of the rows: nothing is shuffled. A read without calls has zeros and no estimate."""
    sure = lambda c: ~c["tail_rescued"] & ~c["imputed"]
    count = lambda test: F.size(F.filter("calls", test)).cast("bigint")
    mean = lambda v: let(v, lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda s, y: s + y) / F.size(x)).otherwise(0.0))
    of = lambda field: F.transform(F.col("_sure"), lambda c: c[field].cast("double"))
    others = [F.col(c) for c in reads.columns if c not in ("trace_id", "calls")]
    rows = reads.withColumn("_sure", F.filter("calls", sure))
    phreds = F.transform("_sure", lambda c: c["phred"])
    counts = {
        "n": F.size("calls").cast("bigint"), "total_bases": F.size("calls").cast("bigint"), "confirmed_bases": F.size("_sure").cast("bigint"), "tail_rescued": count(lambda c: c["tail_rescued"] & ~c["imputed"]),
        "imputed_bases": count(lambda c: c["imputed"]), "heterozygote_bases": count(lambda c: c["heterozygote"]), "mean_phred": mean(of("phred")), "median_phred": F.coalesce(percentile(F.sort_array(of("phred")), 0.5), F.lit(0.0)),
        "min_phred": F.coalesce(F.array_min(phreds), F.lit(0)), "max_phred": F.coalesce(F.array_max(phreds), F.lit(0)),
        "mean_snr": mean(of("snr")), "mean_isolation": mean(of("isolation")), "mean_shape_score": mean(of("shape_score")),
        "_mean": mean(F.transform("calls", lambda c: c["phred"].cast("double"))),
        "_calls": F.transform("calls", lambda c: F.struct(c["ordinal"].cast("bigint").alias("ordinal"), c["phred"].cast("double").alias("phred"), F.pow(F.lit(10.0), -c["phred"] / 10.0).alias("cost"))),
    }
    for q in (20, 30, 35):
        counts[f"q{q}_count"] = _at_least(q)
    rows = rows.withColumns(counts).drop("calls", "_sure")
    counted = _search_window(_segments(rows, (min_q, *LADDER), window, True), 1)
    return _statistics(counted, F.col("start_0").alias("start"), F.col("end_0").alias("end"), *others)


def _at_least(q: int) -> Column:
    return F.size(F.filter("_sure", lambda c: c["phred"] >= q)).cast("bigint")


def _statistics(counted: DataFrame, *more: Column) -> DataFrame:
    """Lengths and shares from counts, segments and the search window."""
    length = F.col("blast_end") - F.col("blast_start")
    shares = [F.when(F.col("confirmed_bases") > 0, 100.0 * F.col(f"q{q}_count") / F.col("confirmed_bases")).otherwise(0.0).alias(f"pct_q{q}") for q in (20, 30, 35)]
    return counted.withColumn("blast_est_identity", 100.0 * (1.0 - F.col("blast_cost") / F.nullif(length, F.lit(0)))).select(
        "trace_id", "total_bases", "confirmed_bases", "tail_rescued", "imputed_bases", "heterozygote_bases",
        (F.col("end_0") - F.col("start_0")).alias("window_trimmed_len"), length.alias("blast_window_len"), "blast_start", "blast_end",
        "blast_est_identity", (length >= READY).alias("blast_ready"), "mean_phred", "median_phred", "min_phred", "max_phred",
        "q20_count", "q30_count", "q35_count", *shares, "mean_snr", "mean_isolation", "mean_shape_score", *more,
    )


def readiness_of(stats: DataFrame) -> DataFrame:
    return stats.select("trace_id", "blast_est_identity", "blast_window_len", readiness(F.col("blast_est_identity"), F.col("blast_window_len")).alias("readiness"))


def _ordered(column: str) -> Column:
    """An array of the column in the order of the calls."""
    return F.transform(F.sort_array(F.collect_list(F.struct("ordinal", column))), lambda x: x[column])


def assemble(calls: DataFrame) -> DataFrame:
    """trace_id, sequence, its reverse complement and the quality string."""
    out = calls.groupBy("trace_id").agg(F.array_join(_ordered("letter"), "").alias("sequence"), _ordered("phred").alias("q"))
    return out.select("trace_id", "sequence", reverse_complement(F.col("sequence")).alias("sequence_rc"), quality_letters(F.col("q")).alias("quality"))


def average_quality(calls: DataFrame) -> DataFrame:
    """Mean quality of confirmed calls."""
    sure = F.when(~F.col("tail_rescued") & ~F.col("imputed"), F.col("phred"))
    return calls.groupBy("trace_id").agg(F.coalesce(F.avg(sure), F.lit(0.0)).alias("avg_quality"))


def orientation(calls: DataFrame) -> DataFrame:
    """Lengths and mean qualities of both strands; the reverse strand's are the forward one's, and forward is advised."""
    bounds = search_window(calls)
    inside = calls.join(bounds, "trace_id").filter("ordinal >= blast_start and ordinal < blast_end")
    means = inside.groupBy("trace_id").agg(F.avg("phred").alias("forward_mean_q"), F.count("*").alias("forward_blast_window_len"))
    both = assemble(calls).join(means, "trace_id")
    return both.select(
        "trace_id", F.col("sequence").alias("forward"), F.length("sequence").alias("forward_len"), "forward_blast_window_len", "forward_mean_q",
        F.col("sequence_rc").alias("rc"), F.length("sequence_rc").alias("rc_len"), F.col("forward_blast_window_len").alias("rc_blast_window_len"),
        F.col("forward_mean_q").alias("rc_mean_q"), F.lit("forward").alias("recommended"),
    )


def vendor_identity(ours: DataFrame, vendor: DataFrame) -> DataFrame:
    """Positional agreement of two sequences a trace: compared, matches and percent. Nothing is aligned."""
    both = ours.select("trace_id", F.col("sequence").alias("a")).join(vendor.select("trace_id", F.col("sequence").alias("b")), "trace_id")
    n = F.least(F.length("a"), F.length("b"))
    letters = lambda c: F.split(F.substr(c, F.lit(1), n), "")
    same = F.size(F.filter(F.arrays_zip(letters(F.col("a")).alias("x"), letters(F.col("b")).alias("y")), lambda z: (z["x"] == z["y"]) & (z["x"] != "")))
    matches = F.when(n > 0, same).otherwise(0)
    return both.select("trace_id", n.cast("bigint").alias("compared"), matches.cast("bigint").alias("matches"), F.when(n > 0, 100.0 * matches / n).otherwise(0.0).alias("percent"))


def vendor_summary(traces: DataFrame) -> DataFrame:
    """Mean and counts of the vendor's qualities, least and largest spacing of its peaks."""
    q, at = F.col("kb_quality"), F.col("peak_locs")
    gaps = F.transform(F.slice(at, F.lit(2), F.greatest(F.size(at) - 1, F.lit(0))), lambda x, i: x - F.get(at, i))
    mean = F.when(F.size(q) > 0, F.aggregate(q, F.lit(0.0), lambda s, x: s + x) / F.size(q))
    return traces.select(
        "trace_id", F.size(q).alias("n"), mean.alias("mean_quality"), F.size(F.filter(q, lambda x: x >= 20)).alias("q20"), F.size(F.filter(q, lambda x: x >= 30)).alias("q30"),
        F.array_min(gaps).alias("min_spacing"), F.array_max(gaps).alias("max_spacing"),
    )


def clusters(candidates: DataFrame, tolerance: int) -> DataFrame:
    """Number the clusters of candidates (trace_id, pos, ch, amp): a cluster takes all places within `tolerance` of its
    first one. The fold is sequential, so it runs over one array a trace."""
    listed = candidates.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("pos", "ch", "amp"))).alias("all"))
    zero = F.struct(F.lit(-1).alias("id"), F.lit(None).cast("bigint").alias("start"))

    def step(acc: Column, x: Column) -> tuple[Column, Column]:
        new = acc["start"].isNull() | (x["pos"] - acc["start"] > tolerance)
        one = F.when(new, acc["id"] + 1).otherwise(acc["id"])
        return F.struct(one.alias("id"), F.when(new, x["pos"]).otherwise(acc["start"]).cast("bigint").alias("start")), one

    ids = scan(F.col("all"), "struct<id:int,start:bigint>", zero, step, "int")
    return listed.select("trace_id", F.explode(F.arrays_zip("all", ids.alias("cluster"))).alias("x")).select("trace_id", "x.all.*", "x.cluster")


def resolve(clustered: DataFrame) -> DataFrame:
    """Of each cluster the candidate of largest amplitude; of equals the first place, then the first channel."""
    best = F.min(F.struct((-F.col("amp")).alias("m"), "pos", "ch")).alias("b")
    return clustered.groupBy("trace_id", "cluster").agg(best).select("trace_id", "cluster", "b.pos", "b.ch", (-F.col("b.m")).alias("amp"))


def spacing_fold(calls: DataFrame, model: Column, ok: Column, tolerance: float = 0.35) -> DataFrame:
    """Spacing score of each call against the last confirmed one before it. `model` maps a place to the spacing expected
    there (an array); a call joins the confirmed ones if `ok` holds and its score is at least 0.25."""
    listed = calls.withColumn("_ok", ok).groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "pos", "_ok"))).alias("all")).withColumn("_model", model)
    zero = F.struct(F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("last"))

    def step(acc: Column, x: Column) -> tuple[Column, Column]:
        due = F.get(F.col("_model"), acc["last"].cast("int"))
        score = F.when((acc["n"] < 2) | due.isNull() | (due <= 0), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs((x["pos"] - acc["last"]) - due) / due / tolerance))
        joins = x["_ok"] & (score >= 0.25)
        return F.struct((acc["n"] + joins.cast("int")).alias("n"), F.when(joins, x["pos"]).otherwise(acc["last"]).alias("last")), score

    scores = scan(F.col("all"), "struct<n:int,last:bigint>", zero, step, "double")
    return listed.select("trace_id", F.explode(F.arrays_zip("all", scores.alias("spacing"))).alias("x")).select("trace_id", "x.all.ordinal", "x.all.pos", F.col("x.spacing").alias("spacing_score"))


def fastq(calls: DataFrame, header: Column, min_q: float = 20.0, window: int = 20, use_window: bool = True) -> DataFrame:
    """trace_id and the four lines of a FASTQ record: the trimmed window, or where that is empty the trimmed ends."""
    ends = end_trim(calls)
    bounds = ends if not use_window else window_trim(calls, min_q, window).join(ends.toDF("trace_id", "e0", "e1"), "trace_id").select("trace_id", F.when(F.col("end") > F.col("start"), F.col("start")).otherwise(F.col("e0")).alias("start"), F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(F.col("e1")).alias("end"))
    listed = calls.groupBy("trace_id").agg(_ordered("letter").alias("l"), _ordered("phred").alias("q")).join(bounds, "trace_id")
    cut = lambda c: F.slice(c, (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    return listed.select("trace_id", F.concat(F.lit("@"), header, F.lit("\n"), F.array_join(cut("l"), ""), F.lit("\n+\n"), quality_letters(cut("q")), F.lit("\n")).alias("record"))


def batch_summary(results: DataFrame) -> DataFrame:
    """Files that gave a result, of all files."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("n_ok"), F.count("*").alias("n_files"))


def header_numbers(stats: DataFrame) -> Column:
    return F.concat(F.lit(" mean_Q="), one_decimal(F.col("mean_phred")), F.lit(" pct_Q20="), one_decimal(F.col("pct_q20")))
