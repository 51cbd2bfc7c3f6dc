"""Durable jobs, caches with a lifetime, bounded caches and isolated failures, as state of streams.

State lives in the stream's checkpoint (the RocksDB store), one value or map for each key, so a killed stream goes on where its last whole
batch ended, and a batch that runs again gives the same rows. Times are those of the events, in milliseconds; what a timer does is also
done by the next event that finds the time over, so results do not depend on how events fall into batches. Rows older than the watermark
are dropped as late; a key's rows of one batch are put in order in memory, so `maxFilesPerTrigger` bounds them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# How long a worker may be silent, and how long what was fetched, or a failure to fetch it, is believed (milliseconds).
LEASE_MS = 3_600_000
LIFETIME_MS, FAILURE_MS = 86_400_000, 60_000
ACTIVE = ("queued", "running")


@contextmanager
def rocks_state(spark: SparkSession):
    """The state store that processors need, for streams that are started meanwhile; the session's own is restored."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_processor(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, target: str, checkpoint: str, time: str | None = "ts", delay: str = "0 seconds") -> StreamingQuery:
    """Works off what has arrived; rows that the processor gives are appended to `target`, each once. Without `time` nothing is late."""
    timed = stream.withWatermark(time, delay) if time else stream
    rows = timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime" if time else "None")
    with rocks_state(stream.sparkSession):
        return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def table_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A table's files as a stream, `files` of them a batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    # a pattern, as a stream's plain path must be a folder and a table may be one file
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(f"{path[:-1]}[{path[-1]}]")


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(["at", "seq"], kind="stable")


class DurableJobs(StatefulProcessor):
    """A job of numbered steps for each key. Rows: job (the key), seq, at (ms), command, steps (how many it has).

    enqueue starts a job that is new, retry also one that has failed or was paused; claim makes a queued job run for lease_ms and starts its
    next step, and prolongs a running one; finish counts the step that was started, once, and starts the next; pause wins over a worker that
    finishes meanwhile: its step counts, the job stays paused; fail stops a running job. A lease that runs out queues the job again, and the
    step that was started does not count. Gives job, at_ms, what, status, done for whatever changes something."""

    SCHEMA = "job long, at_ms long, what string, status string, done long"

    def __init__(self, lease_ms: int = LEASE_MS):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("job", "status string, done long, started boolean, lease long, steps long")

    def _lost(self, job: list, now: int) -> tuple | None:
        """Queue a job again whose lease has run out."""
        status, done, _, lease, _ = job
        if status != "running" or now < lease:
            return None
        job[0], job[2], job[3] = "queued", False, 0
        return lease, "lost", "queued", done

    def apply(self, job: list, command: str, at: int) -> None:
        status, done, started, _, steps = job
        if command in ("enqueue", "retry"):
            if status not in ACTIVE and (command == "retry" or status not in ("failed", "paused")):
                job[0] = "completed" if done == steps else "queued"
        elif command == "claim" and status in ACTIVE:
            job[0], job[2], job[3] = "running", True, at + self.lease_ms
        elif command == "finish" and started:
            job[1], job[2] = done + 1, False
            if status == "running":
                job[0], job[2], job[3] = ("completed", False, 0) if done + 1 == steps else ("running", True, at + self.lease_ms)
        elif command == "pause" and status in ACTIVE:
            job[0], job[3] = "paused", 0
        elif command == "fail" and status == "running":
            job[0], job[2], job[3] = "failed", False, 0

    def _kept(self, job: list) -> None:
        self.held.update(tuple(job))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job[0] == "running":
            self.handle.registerTimer(job[3])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        job = list(self.held.get()) if self.held.exists() else ["", 0, False, 0, 0]
        out = []
        for r in _in_order(rows).itertuples():
            job[4] = int(r.steps)
            if (lost := self._lost(job, int(r.at))) is not None:
                out.append((key[0], *lost))
            before = job[:2]
            self.apply(job, r.command, int(r.at))
            if job[:2] != before:
                out.append((key[0], int(r.at), r.command, job[0], job[1]))
        self._kept(job)
        yield pd.DataFrame(out, columns=["job", "at_ms", "what", "status", "done"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = list(self.held.get())
        lost = self._lost(job, expiredTimerInfo.getExpiryTimeInMs())
        if lost is not None:
            self._kept(job)
            yield pd.DataFrame([(key[0], *lost)], columns=["job", "at_ms", "what", "status", "done"])

    def close(self) -> None:
        pass


class LifetimeCache(StatefulProcessor):
    """A cached record of each key, fetched when it is asked for and not known, or too old: LIFETIME_MS, FAILURE_MS if the fetch failed.

    Rows: key, seq, at (ms), ok (how a fetch would end now). Gives key, seq, hit. A timer takes what is too old out of the state."""

    SCHEMA = "key long, seq long, hit boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("record", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = until = self.held.get()[0] if self.held.exists() else 0
        out = []
        for r in _in_order(rows).itertuples():
            hit = r.at < until
            if not hit:
                until = int(r.at) + (LIFETIME_MS if r.ok else FAILURE_MS)
            out.append((key[0], int(r.seq), hit))
        if until != before:
            self.held.update((until,))
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=["key", "seq", "hit"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


class RecentlyUsed(StatefulProcessor):
    """A bounded cache in buckets; a bucket keeps its `capacity` last used entries. Rows: bucket (the key), digest, doc.

    A batch asks for each of its digests once, in order of its first doc; what the bucket holds is a hit, the rest is computed; then all that
    was asked for is the last used, in that order, and the longest unused goes. Gives bucket, digest, doc (the first), uses, computed, evicted
    (of what was asked for or, with no uses, of what lay there)."""

    SCHEMA = "bucket int, digest string, doc long, uses long, computed boolean, evicted boolean"

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("entries", "digest string", "turn long, doc long")
        self.turn = handle.getValueState("turn", "turn long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked: dict[str, tuple[int, int]] = {}  # distinct texts of a batch and bucket; copies only count
        for part in rows:
            for digest, doc, n in part.groupby("digest")["doc"].agg(["min", "size"]).itertuples():
                first, uses = asked.get(digest, (doc, 0))
                asked[digest] = min(first, int(doc)), uses + int(n)
        order = sorted(asked, key=lambda d: (asked[d][0], d))
        held = {k[0]: tuple(v) for k, v in self.held.iterator()} if self.turn.exists() else {}
        turn = self.turn.get()[0] if self.turn.exists() else 0
        known = set(held)
        for d in order:
            turn += 1
            held[d] = (turn, int(asked[d][0]))
        gone = sorted(held, key=lambda d: held[d][0])[: max(0, len(held) - self.capacity)]
        out = [(key[0], d, int(asked[d][0]), asked[d][1], d not in known, False) for d in order]
        at = {d: i for i, d in enumerate(order)}
        for d in gone:
            if d in at:
                out[at[d]] = (*out[at[d]][:5], True)
            else:
                out.append((key[0], d, held[d][1], 0, False, True))
            if d in known:
                self.held.removeKey((d,))
        left = set(gone)
        for d in order:
            if d not in left:
                self.held.updateValue((d,), held[d])
        self.turn.update((turn,))
        yield pd.DataFrame(out, columns=["bucket", "digest", "doc", "uses", "computed", "evicted"])

    def close(self) -> None:
        pass


def isolated(rows: DataFrame, work: Callable[[dict, int], str], attempts: int = 3) -> DataFrame:
    """rows with result, tried, error: `work` (of a row and the number of the attempt) is tried so often; what still fails bears its error."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.to_dict("records"):
                for attempt in range(1, attempts + 1):
                    try:
                        found.append((work(row, attempt), attempt, None))
                        break
                    except Exception as e:  # whatever one item does, the others go on
                        failed = (None, attempt, f"{type(e).__name__}: {e}")
                else:
                    found.append(failed)
            yield batch.assign(**{name: [f[i] for f in found] for i, name in enumerate(("result", "tried", "error"))})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(each, f"{fields}, result string, tried int, error string")


def run_isolated(stream: DataFrame, work: Callable[[dict, int], str], done: str, dead: str, checkpoint: str, attempts: int = 3) -> StreamingQuery:
    """Works items off; those that fail all attempts go to the table `dead`, the others to `done`. A batch has a folder of its own in both,
    so that one that runs again lands there once."""

    def batch(df: DataFrame, number: int) -> None:
        kept = f"{checkpoint}/worked/batch={number}"
        isolated(df, work, attempts).write.mode("overwrite").parquet(kept)  # worked once for both tables
        worked = df.sparkSession.read.parquet(kept)
        worked.where("error IS NULL").drop("error").write.mode("overwrite").parquet(f"{done}/batch={number}")
        worked.where("error IS NOT NULL").drop("result").write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def milliseconds(ts: str):
    """A time stamp without zone as milliseconds since 1970."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


class UploadItems(StatefulProcessor):
    """One file of an upload for each key; it is queued at first. Rows: item (the key), seq, at (ms), command, progress, retryable.

    claim takes a queued item; progress (0 to 99), complete and fail are for running ones; what is completed or failed already stays so
    without harm; retry queues a failed item again if its failure was marked as retryable. Anything else is refused and changes nothing.
    Gives item, seq, outcome (done, kept, refused), status, progress, retryable after it, attempts (how often it was claimed)."""

    SCHEMA = "item long, seq long, outcome string, status string, progress long, retryable boolean, attempts long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("item", "status string, progress long, retryable boolean, attempts long")

    @staticmethod
    def step(state: tuple, command: str, progress: int, retryable: bool) -> tuple[str, tuple]:
        status, reached, again, attempts = state
        if command == "claim" and status == "queued":
            return "done", ("running", reached, False, attempts + 1)
        if command == "progress" and status == "running" and 0 <= progress <= 99:
            return "done", (status, progress, again, attempts)
        if command == "complete" and status in ("running", "completed"):
            return ("kept", state) if status == "completed" else ("done", ("completed", 100, False, attempts))
        if command == "fail" and status in ("running", "failed"):
            return ("kept", state) if status == "failed" else ("done", ("failed", reached, retryable, attempts))
        if command == "retry" and status == "failed" and again:
            return "done", ("queued", 0, False, attempts)
        return "refused", state

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.held.get()) if self.held.exists() else ("queued", 0, False, 0)
        out = []
        for r in _in_order(rows).itertuples():
            outcome, state = self.step(state, r.command, int(r.progress), bool(r.retryable))
            out.append((key[0], int(r.seq), outcome, *state))
        self.held.update(state)
        yield pd.DataFrame(out, columns=["item", "seq", "outcome", "status", "progress", "retryable", "attempts"])

    def close(self) -> None:
        pass


def recovered_items(items: DataFrame, stored: DataFrame) -> DataFrame:
    """items (item, status, progress) after a restart: what was running is completed if its project (item) is stored, else queued anew."""
    known = items.join(stored.select("item").distinct().withColumn("known", F.lit(True)), "item", "left")
    running = F.col("status") == "running"
    status = F.when(running, F.when(F.col("known"), "completed").otherwise("queued")).otherwise(F.col("status"))
    progress = F.when(running, F.when(F.col("known"), 100).otherwise(0)).otherwise(F.col("progress"))
    return known.select("item", status.alias("status"), progress.cast("long").alias("progress"))


def upload_jobs(items: DataFrame) -> DataFrame:
    """job, completed, failed, finished, progress (the mean, rounded down) of items (job, status, progress); finished if none waits or runs."""
    active = F.count_if(F.col("status").isin(*ACTIVE))
    return items.groupBy("job").agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), (active == 0).alias("finished"), F.floor(F.avg("progress")).alias("progress"))
