import datetime as dt

from cohortlake.operators.stats import group_basic_stats
from cohortlake.session import scratch_path
from cohortlake.streaming.sessions import stream_sessions
from cohortlake.streaming.stats import read_stream, run_to_table, stream_basic_stats

START = dt.datetime(2024, 1, 1)


def minutes(k):
    return START + dt.timedelta(minutes=k)


def test_stats_over_several_batches(spark):
    path = scratch_path(spark, "stream-in")
    rows = spark.range(300).selectExpr("concat('g', id % 3) AS g", "IF(id % 7 = 0, NULL, CAST(id AS DOUBLE)) AS v")
    rows.repartition(4).write.parquet(path)
    got = run_to_table(stream_basic_stats(read_stream(spark, path, max_files=1), "g", "v"), "stats", "complete")
    want = group_basic_stats(rows, "g", "v")
    tidy = lambda d: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in d.collect())
    assert tidy(got) == tidy(want)


def test_a_stopped_query_goes_on(spark):
    path, folder = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-table")
    rows = spark.range(200).selectExpr("concat('g', id % 3) AS g", "CAST(id AS DOUBLE) AS v")
    run = lambda: run_to_table(stream_basic_stats(read_stream(spark, path), "g", "v"), "stats", "complete", folder)
    counts = lambda d: {r["g"]: r["defined"] for r in d.collect()}
    rows.where("v < 90").write.parquet(path)
    assert counts(run()) == {"g0": 30, "g1": 30, "g2": 30}
    rows.where("v >= 90").write.mode("append").parquet(path)
    assert counts(run()) == {"g0": 67, "g1": 67, "g2": 66}
    assert counts(run()) == {"g0": 67, "g1": 67, "g2": 66}  # nothing new


def test_sessions_close_behind_the_watermark(spark):
    path = scratch_path(spark, "stream-in")
    rows = [("a", minutes(k)) for k in (0, 5, 15, 26, 200)] + [("b", minutes(3)), ("b", minutes(190))]
    spark.createDataFrame(rows, "user string, ts timestamp").coalesce(1).write.parquet(path)
    out = run_to_table(stream_sessions(read_stream(spark, path), ["user"], "ts", "10 minutes", "5 minutes"), "sessions")
    # a gap of exactly ten minutes stays in the session; sessions that may still grow are not emitted
    assert {(r["user"], r["rows"], r["first"], r["last"]) for r in out.collect()} == {
        ("a", 3, minutes(0), minutes(15)),
        ("a", 1, minutes(26), minutes(26)),
        ("b", 1, minutes(3), minutes(3)),
    }


def test_update_mode_writes_only_what_changed(spark):
    path, folder = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-table")
    rows = spark.range(20_000).selectExpr("concat('g', id % 10000) AS g", "CAST(id AS DOUBLE) AS v")
    run = lambda: run_to_table(stream_basic_stats(read_stream(spark, path), "g", "v"), "stats", "update", folder, ["g"])
    rows.write.parquet(path)
    assert run().count() == 10_000
    spark.createDataFrame([("g7", 1e6), ("new", 1.0), (None, 2.0), (None, 3.0)], "g string, v double").coalesce(1).write.mode("append").parquet(path)
    out = run()
    last = spark.read.parquet(f"{folder}/table")
    assert last.where("version = 1").count() == 3  # g7, new and null
    got = {r["g"]: (r["defined"], r["max"]) for r in out.where("g IN ('g7', 'g8', 'new') OR g IS NULL").collect()}
    assert out.count() == 10_002 and got == {"g7": (3, 1e6), "g8": (2, 10008.0), "new": (1, 1.0), None: (2, 3.0)}
    assert run().count() == 10_002  # nothing new
