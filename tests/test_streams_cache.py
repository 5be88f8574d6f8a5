"""Streams over several batches and restarts, running totals by ranges, and the read-through cache."""

import random

import pytest
from pyspark.sql import functions as F

from kinelake.functions.ranges import running
from kinelake.operators import curation
from kinelake.sources import cache
from kinelake.streaming import events

EVENT = "key string, ts timestamp, event_id long, failed boolean"


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "s string, n int, i int")
    order = [F.col("s").isNull(), F.col("s"), F.col("n"), F.col("i")]
    for parts in (1, 7):
        got = {r.i: (r.at, r.total) for r in running(df, order, {"at": F.lit(1), "total": F.col("n")}, parts).collect()}
        total, want = 0, {}
        for at, (_, n, i) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1], r[2]))):
            want[i] = (at, total)
            total += n
        assert got == want
    assert running(df.limit(0), order, {"at": F.lit(1)}).count() == 0


def _batches(spark, folder, rows, schema):
    for batch in rows:
        spark.createDataFrame(batch, schema).selectExpr("key", "timestamp_seconds(us + 1000) AS ts", "event_id", "failed").coalesce(1).write.mode("append").parquet(folder)
        yield


def test_limits_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted((1_700_000_000 + rng.randrange(5 * 86_400), i, rng.choice(["u", "v", "w"]), rng.random() < 0.4) for i in range(200))
    batches = [[(k, us, i, f) for us, i, k, f in rows[at : at + 50]] for at in range(0, 200, 50)]
    folder, schema = f"{tmp_path}/in", "key string, us long, event_id long, failed boolean"
    for _ in _batches(spark, folder, batches, schema):  # a new query on the old checkpoint each time
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
        got = events.drain(events.limits(stream, 3, [5.0, 9.0]), f"{tmp_path}/out", f"{tmp_path}/state")
    whole = spark.read.parquet(folder)
    want = {r.event_id: (r.n, r.wait_us) for r in curation.rolling_cap_wait(whole.select("key", "ts", "event_id"), 3).select("event_id", "n", F.coalesce("wait_us", F.lit(0)).alias("wait_us")).collect()}
    held = {r.event_id: r for r in got.collect()}
    assert {i: (r.n, r.wait_us) for i, r in held.items()} == want and got.count() == 200
    for key in "uvw":
        row = 0
        for _, i, _, failed in (r for r in rows if r[2] == key):
            row = row + 1 if failed else 0
            assert (held[i].failures, held[i].backoff_s) == (row, [0.0, 5.0, 9.0][min(row, 2)])


def test_islands_close_by_spike_or_quiet(spark, tmp_path):
    schema = "key string, us long, event_id long, failed boolean"
    first = [("r", t, t, t == 4) for t in range(10)] + [("q", t, 100 + t, False) for t in range(5)]
    second = [("r", 10, 10, True), ("r", 11, 11, False)]
    third = [("z", 100_000, 500, False)]  # the watermark passes r and q
    fourth = [("q", 100_000, 600, False), ("q", 100_001, 601, True), ("z", 100_002, 602, True)]
    folder, seen = f"{tmp_path}/in", []
    for _ in _batches(spark, folder, [first, second, third, fourth], schema):
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder).select(F.col("key").alias("run"), "ts", "event_id", F.col("failed").alias("flag"))
        got = events.drain(events.islands(stream, 2, 3600), f"{tmp_path}/out", f"{tmp_path}/state")
        seen.append({(r.run, r.a, r.b) for r in got.collect()})
    assert seen[0] == {("r", 0, 4)} and seen[1] == seen[0] | {("r", 4, 10)}
    assert seen[2] == seen[1] | {("r", 10, 12), ("q", 0, 5)}
    assert seen[3] == seen[2]  # one event each since


def test_ledger_outlives_empty_batches_and_unknown_runs(spark, tmp_path):
    ledger, schema = f"{tmp_path}/ledger", "conductor string, run string, verdict string, at long"
    spark.createDataFrame([("c", "r", "", ""), ("c", "q", "", "")], "conductor string, run string, verdict string, judged_at string").write.parquet(ledger)
    for batch in ([("c", "r", "accept", 1)], [], [("c", "none", "accept", 1), ("c", "q", "hold", 3)], [], [("c", "r", "reject", 4)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/changes")
        events.keep_ledger(spark.readStream.schema(schema).parquet(f"{tmp_path}/changes"), ledger, f"{tmp_path}/state", "now")
    kept = {(r.run, r.verdict, r.judged_at) for r in spark.read.parquet(events.newest_ledger(spark, ledger)).collect()}
    assert kept == {("r", "reject", "now"), ("q", "hold", "now")}
    assert [r.run for r in spark.read.parquet(f"{ledger}_unknown").collect()] == ["none"]


def test_cache_extracts_misses_alone(spark, tmp_path):
    path, calls = f"{tmp_path}/cache", []

    def extract(rows):
        calls.append(sorted({r.k for r in rows.collect()}))
        return rows.where("k <> 5").groupBy("k").agg(F.sum("x").alias("total"))

    rows = spark.createDataFrame([(k, x) for k in range(6) for x in range(3)] + [(None, 1)], "k int, x int")
    got = [{(r.k, r.total, r.hit) for r in cache.read_through(part, ["k"], extract, path).collect()} for part in (rows.where("k < 2"), rows, rows, rows.limit(0))]
    assert got[0] == {(0, 3, False), (1, 3, False)}
    assert got[1] == {(0, 3, True), (1, 3, True), (2, 3, False), (3, 3, False), (4, 3, False)}
    assert got[2] == {(k, 3, True) for k in range(5)} and got[3] == set()
    assert calls == [[0, 1], [2, 3, 4, 5], [5]]
    # a commit that didn't end isn't read; of two commits of a key one counts
    spark.createDataFrame([(0, 99), (7, 7)], "k int, total long").write.parquet(f"{path}/commit=zz")
    (tmp_path / "cache" / "commit=zz" / "_SUCCESS").unlink()
    assert cache.committed(spark, path).where("k = 7").count() == 0
    spark.createDataFrame([(0, 3)], "k int, total long").write.parquet(f"{path}/commit=zy")
    assert cache.read_through(rows.where("k = 0"), ["k"], extract, path).count() == 1


def test_cache_before_the_first_commit(spark, tmp_path):
    rows = spark.createDataFrame([], "k int, x int")
    assert cache.read_through(rows, ["k"], lambda r: pytest.fail("nothing is missing"), f"{tmp_path}/none").count() == 0
