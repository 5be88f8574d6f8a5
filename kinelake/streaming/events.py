"""Structured streams over event time: counts, a ledger of verdicts, limits and back-off per key, islands between spikes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinelake.operators.curation import LEDGER_KEY, record_verdicts
from kinelake.runtime import names_in, remove, ship


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """(key, start, n, total) per event-time window of a stream or a table of events(ts, key, value); a window's state goes once events are later than ``late``."""
    per = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), key)
    return per.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(key, F.col("w.start").alias("start"), "n", "total")


def drain(stream: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None) -> DataFrame:
    """All that is available now through the stream into Parquet; returns what is in it.

    With keys the stream is in update mode: each batch writes the rows that changed to a folder of its own, by its number, so a
    batch that dies is written again whole, and of a key's rows the last batch's counts. Without keys rows are final and appended in the same way.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode("update" if keys else "append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    if not names_in(spark, path):
        return spark.createDataFrame([], stream.schema)
    held = spark.read.schema(stream.schema.add("batch", "long")).parquet(path)
    if not keys:
        return held.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    return held.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*").select(*stream.columns)


def newest_ledger(spark: SparkSession, ledger: str, before: int | None = None) -> str:
    """The path of the ledger as the last batch (before a number) left it, or the ledger itself."""
    folder, name = ledger.rsplit("/", 1)
    found = [int(n.rsplit("_", 1)[1]) for n in names_in(spark, folder) if n.rsplit("_", 1)[0] == name and n.rsplit("_", 1)[-1].isdigit() and "_SUCCESS" in names_in(spark, f"{folder}/{n}")]
    last = max((n for n in found if before is None or n < before), default=None)
    return ledger if last is None else f"{ledger}_{last}"


def keep_ledger(changes: DataFrame, ledger: str, checkpoint: str, now: str) -> None:
    """Each batch of a stream of changes(conductor, run, verdict, at) recorded in the Parquet ledger at path; a run's last change in a batch counts.

    A batch writes the ledger beside itself, under its number, from the newest one before it, so a batch that fails is done again
    from the same ledger; an empty one writes nothing. The one before is kept until the next batch, older ones go. Changes of runs that the ledger doesn't
    have go to <ledger>_unknown and stop nobody else's.
    """

    def record(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        if batch.isEmpty():
            return
        before = newest_ledger(spark, ledger, number)
        held = spark.read.parquet(before)
        last = batch.groupBy(*LEDGER_KEY).agg(F.max_by("verdict", F.struct("at", "verdict")).alias("verdict"))
        last.join(held, LEDGER_KEY, "left_anti").write.mode("overwrite").parquet(f"{ledger}_unknown/batch={number}")
        record_verdicts(held, last.join(held, LEDGER_KEY, "left_semi"), F.lit(now)).write.mode("overwrite").parquet(f"{ledger}_{number}")
        folder, name = ledger.rsplit("/", 1)
        for n in names_in(spark, folder):
            head, _, tail = n.rpartition("_")
            if head == name and tail.isdigit() and int(tail) < number and f"{folder}/{n}" != before:
                remove(spark, f"{folder}/{n}")

    changes.writeStream.foreachBatch(record).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def limits(events: DataFrame, cap: int, waits: list[float], window_s: int = 86_400, late: str = "1 day") -> DataFrame:
    """(key, event_id, n, wait_us, failures, backoff_s) of a stream of events(key, ts, event_id, failed).

    n: the key's events within the window that ends with this one; wait_us: how long from it until there are fewer than cap in
    the window; failures: failed ones in a row up to it; backoff_s: what waits gives for so many, its last for more, 0 for none. A key's events
    are taken in the order (ts, event_id) within a batch, batches as they come; its state is the times of one window and a counter, and goes once
    the watermark has passed the window's end and the longest back-off. An event before a key's newest one of earlier batches is counted in its place, and what was given out stays.
    """
    ship(events.sparkSession)
    window, longest = window_s * 1_000_000, int(max(waits, default=0))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(batches).sort_values(["us", "event_id"], kind="stable")
        held, failures = state.get if state.exists else ([], 0)
        us = rows.us.to_numpy()
        times = np.sort(np.concatenate([np.array(held, np.int64), us]), kind="stable")
        upto = np.searchsorted(times, us, "right")
        n = upto - np.searchsorted(times, us - window, "right")
        place = np.searchsorted(times, us, "left") + rows.groupby("us").cumcount().to_numpy()
        nth = place - (cap - 1)
        wait = np.where((n >= cap) & (nth >= 0), np.maximum(0, times[np.maximum(nth, 0)] + window - us), 0)
        row = []
        for failed in rows.failed:
            failures = failures + 1 if failed else 0
            row.append(failures)
        newest = int(times[-1])
        state.update(([int(t) for t in times[times > newest - window]], int(failures)))
        state.setTimeoutTimestamp(max(newest // 1000 + (window_s + longest) * 1000, state.getCurrentWatermarkMs() + 1))
        back = [0.0 if not f or not waits else float(waits[min(f, len(waits)) - 1]) for f in row]
        yield pd.DataFrame({"key": key[0], "event_id": rows.event_id.to_numpy(), "n": n, "wait_us": wait, "failures": row, "backoff_s": back})

    key_type = events.schema["key"].dataType.simpleString()
    id_type = events.schema["event_id"].dataType.simpleString()
    timed = events.dropna(subset=["key", "ts"]).withWatermark("ts", late).select("key", "ts", "event_id", F.coalesce("failed", F.lit(False)).alias("failed"), F.unix_micros("ts").alias("us"))
    return timed.groupBy("key").applyInPandasWithState(step, f"key {key_type}, event_id {id_type}, n long, wait_us long, failures long, backoff_s double", "times array<long>, failures long", "append", GroupStateTimeout.EventTimeTimeout)


def islands(signal: DataFrame, least: int, quiet_s: int, late: str = "10 minutes") -> DataFrame:
    """(run, a, b): stretches of at least `least` events of a run between spikes, as numbers of its events, of a stream of signal(run, ts, event_id, flag).

    An island begins with a spike (the first with the run) and ends before the next. It is given out when it ends: by the spike, or once the watermark is
    quiet_s past the run's last event; the run then starts over with its numbers going on. State is two numbers per run. Events later than the watermark are dropped, as are those before the run's
    newest one of earlier batches.
    """
    ship(signal.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, start, newest = state.get if state.exists else (0, 0, -(1 << 62))
        if state.hasTimedOut:
            if at - start >= least:
                yield pd.DataFrame({"run": [key[0]], "a": [start], "b": [at]})
            state.update((at, at, newest))
            return
        rows = pd.concat(batches).sort_values(["us", "event_id"], kind="stable")
        rows = rows[rows.us >= newest]
        cuts = at + np.flatnonzero(rows.flag.to_numpy(bool))
        bounds = np.concatenate([[start], cuts]).astype(np.int64)
        long_enough = np.diff(bounds) >= least
        yield pd.DataFrame({"run": key[0], "a": bounds[:-1][long_enough], "b": bounds[1:][long_enough]})
        newest = int(rows.us.iloc[-1]) if len(rows) else newest
        state.update((at + len(rows), int(bounds[-1]), newest))
        state.setTimeoutTimestamp(max(newest // 1000 + quiet_s * 1000, state.getCurrentWatermarkMs() + 1))

    run_type = signal.schema["run"].dataType.simpleString()
    timed = signal.dropna(subset=["run", "ts"]).withWatermark("ts", late).select("run", "ts", "event_id", F.coalesce("flag", F.lit(False)).alias("flag"), F.unix_micros("ts").alias("us"))
    return timed.groupBy("run").applyInPandasWithState(step, f"run {run_type}, a long, b long", "at long, start long, newest long", "append", GroupStateTimeout.EventTimeTimeout)
