"""Streams over the events and documents: durable jobs, caches, isolated failures; and guarded writes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.operators.guarded import accepted_writes
from lintel.plans.registry import query, table
from lintel.session import scratch
from lintel.streaming import stateful as S

COMMANDS = "CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'purchase' THEN 'retry' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'finish' ELSE CASE WHEN value < 40 THEN 'pause' ELSE 'fail' END END"
STEPS = "10 + user_id % 5"
#: Users act twice a day.
LEASE_MS = 129_600_000


def job_events(events: DataFrame) -> DataFrame:
    """Events as commands to a job for each user."""
    return events.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), S.milliseconds("ts").alias("at"), F.expr(COMMANDS).alias("command"), F.expr(STEPS).cast("long").alias("steps"), F.col("ts").cast("timestamp").alias("ts"))


def _worked(spark: SparkSession, rows: DataFrame, key: str, processor, name: str, time: str | None = "ts") -> DataFrame:
    base = scratch(spark, name)
    S.run_processor(rows, [key], processor, processor.SCHEMA, f"{base}/out", f"{base}/state", time).awaitTermination()
    return spark.read.schema(processor.SCHEMA).parquet(f"{base}/out")


SQL_JOBS = f"""WITH RECURSIVE e AS (SELECT user_id AS job, epoch_us(ts) // 1000 AS at_ms, {COMMANDS} AS cmd, CAST({STEPS} AS BIGINT) AS steps, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
r AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS n, '' AS s0, CAST(0 AS BIGINT) AS d0, '' AS status, CAST(0 AS BIGINT) AS done, false AS started, CAST(0 AS BIGINT) AS lease, false AS lost, CAST(0 AS BIGINT) AS lost_at, CAST(0 AS BIGINT) AS at_ms, '' AS cmd FROM e
 UNION ALL SELECT job, n, s0, d0, CASE WHEN cmd IN ('enqueue', 'retry') THEN CASE WHEN s0 NOT IN ('queued', 'running') AND (cmd = 'retry' OR s0 NOT IN ('failed', 'paused')) THEN CASE WHEN d0 = steps THEN 'completed' ELSE 'queued' END ELSE s0 END
   WHEN cmd = 'claim' AND s0 IN ('queued', 'running') THEN 'running' WHEN cmd = 'finish' AND b0 AND s0 = 'running' AND d0 + 1 = steps THEN 'completed' WHEN cmd = 'pause' AND s0 IN ('queued', 'running') THEN 'paused' WHEN cmd = 'fail' AND s0 = 'running' THEN 'failed' ELSE s0 END,
  d0 + CASE WHEN cmd = 'finish' AND b0 THEN 1 ELSE 0 END,
  CASE WHEN cmd = 'claim' AND s0 IN ('queued', 'running') THEN true WHEN cmd = 'finish' AND b0 THEN s0 = 'running' AND d0 + 1 <> steps WHEN cmd = 'fail' AND s0 = 'running' THEN false ELSE b0 END,
  CASE WHEN cmd = 'claim' OR cmd = 'finish' AND b0 AND s0 = 'running' THEN at_ms + {LEASE_MS} ELSE lease END, lost, lease, at_ms, cmd
 FROM (SELECT e.job, e.n, e.at_ms, e.cmd, e.steps, r.lease, r.status = 'running' AND e.at_ms >= r.lease AS lost, CASE WHEN r.status = 'running' AND e.at_ms >= r.lease THEN 'queued' ELSE r.status END AS s0, r.done AS d0, r.started AND NOT (r.status = 'running' AND e.at_ms >= r.lease) AS b0
  FROM r JOIN e ON e.job = r.job AND e.n = r.n + 1))
SELECT job, at_ms, cmd AS what, status, done FROM r WHERE n > 0 AND (status <> s0 OR done <> d0) UNION ALL SELECT job, lost_at, 'lost', 'queued', d0 FROM r WHERE lost
UNION ALL SELECT job, lease, 'lost', 'queued', done FROM r WHERE status = 'running' AND lease <= (SELECT max(at_ms) FROM e) QUALIFY n = max(n) OVER (PARTITION BY job)"""
# the last state of a job is taken before the filter on it
SQL_JOBS = SQL_JOBS.replace("FROM r WHERE status = 'running' AND lease <= (SELECT max(at_ms) FROM e) QUALIFY n = max(n) OVER (PARTITION BY job)", "FROM (SELECT * FROM r QUALIFY n = max(n) OVER (PARTITION BY job)) WHERE status = 'running' AND lease <= (SELECT max(at_ms) FROM e)")


@query("X03_durable_jobs", SQL_JOBS)
def durable_jobs(spark, sf_dir):
    """What happened to each user's job: every change of its status and every step that counts, leases that ran out included."""
    return _worked(spark, job_events(S.table_stream(spark, f"{sf_dir}/events.parquet")), "job", S.DurableJobs(LEASE_MS), "jobs")


def cache_events(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), S.milliseconds("ts").alias("at"), (F.col("event_type") != "error").alias("ok"), F.col("ts").cast("timestamp").alias("ts"))


@query("X05_lifetime_cache", f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) // 1000 AS at_ms, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
r AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, false AS hit, CAST(0 AS BIGINT) AS until FROM e
 UNION ALL SELECT e.key, e.n, e.seq, e.at_ms < r.until, CASE WHEN e.at_ms < r.until THEN r.until ELSE e.at_ms + CASE WHEN e.ok THEN {S.LIFETIME_MS} ELSE {S.FAILURE_MS} END END FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
SELECT key, seq, hit FROM r WHERE n > 0""")
def lifetime_cache(spark, sf_dir):
    """Each event asks for its user's record; one that ends in an error could not have fetched it."""
    return _worked(spark, cache_events(S.table_stream(spark, f"{sf_dir}/events.parquet")), "key", S.LifetimeCache(), "cache")


#: Entries of the cache of vectors, and the buckets that share them.
ENTRIES, BUCKETS = 8000, 64


def text_requests(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Texts to be embedded: bucket (of the digest), digest, doc."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    rows = docs.select(digest.alias("digest"), F.col("doc_id").alias("doc"))
    return rows.withColumn("bucket", (F.conv(F.substring("digest", 1, 4), 16, 10).cast("long") % buckets).cast("int"))


@query("R24_vector_cache", f"""WITH d AS (SELECT sha256(coalesce(text, '')) AS digest, min(doc_id) AS doc, count(*) AS uses FROM documents GROUP BY ALL),
b AS (SELECT *, CAST(CAST('0x' || substr(digest, 1, 4) AS BIGINT) % {BUCKETS} AS INT) AS bucket FROM d)
SELECT bucket, digest, doc, uses, true AS computed, row_number() OVER (PARTITION BY bucket ORDER BY doc DESC, digest DESC) > {ENTRIES // BUCKETS} AS evicted FROM b""")
def vector_cache(spark, sf_dir):
    """The texts of the documents ask a bounded cache for their vectors: each is computed once; the longest unused make room."""
    return _worked(spark, text_requests(S.table_stream(spark, f"{sf_dir}/documents.parquet")), "bucket", S.RecentlyUsed(ENTRIES // BUCKETS), "vectors", None)


def read_number(row: dict, attempt: int) -> str:
    """The work on an event: its number; those divisible by 10 cannot be read, those that end in 5 not at once."""
    k = json.loads(row["props"])["k"]
    if k % 10 == 0 or k % 10 == 5 and attempt == 1:
        raise ValueError(f"cannot read {k}")
    return str(k)


@query("X01_isolated_failures", """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, CASE WHEN k % 10 <> 0 THEN CAST(k AS VARCHAR) END AS result, CASE WHEN k % 10 = 0 THEN 3 WHEN k % 10 = 5 THEN 2 ELSE 1 END AS tried, CASE WHEN k % 10 = 0 THEN 'ValueError: cannot read ' || k END AS error FROM e""")
def isolated_failures(spark, sf_dir):
    """Events that are worked off one by one; those that fail three times are in the table of dead letters, the others go on."""
    base = scratch(spark, "isolated")
    S.run_isolated(S.table_stream(spark, f"{sf_dir}/events.parquet").select("event_id", "props"), read_number, f"{base}/done", f"{base}/dead", f"{base}/state").awaitTermination()
    rows = "event_id long, result string, tried int, error string"
    done, dead = (spark.read.schema(rows).parquet(f"{base}/{name}").select("event_id", "result", "tried", "error") for name in ("done", "dead"))
    return done.unionByName(dead)


STATES = 23


@query("I07_guarded_writes", f"""WITH RECURSIVE w AS (SELECT CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS entity, event_id AS seq, sha256('s' || CAST(floor(value) AS BIGINT) % {STATES}) AS expected, sha256('s' || event_id % {STATES}) AS state FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY seq) AS n FROM w),
r AS (SELECT DISTINCT entity, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS expected, sha256('s0') AS state, false AS accepted FROM w
 UNION ALL SELECT n.entity, n.n, n.seq, n.expected, CASE WHEN n.expected = r.state THEN n.state ELSE r.state END, n.expected = r.state FROM r JOIN n ON n.entity = r.entity AND n.n = r.n + 1)
SELECT entity, seq, accepted FROM r WHERE n > 0""")
def guarded_writes(spark, sf_dir):
    """Events as writes to entities, one of which has a third of them; a write counts if it names the hash of the state it meets."""
    events = table(spark, sf_dir, "events")
    digest = lambda n: F.sha2(F.concat(F.lit("s"), (n % STATES).cast("string")), 256)
    writes = events.select(
        F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id")).cast("long").alias("entity"), F.col("event_id").alias("seq"),
        digest(F.floor("value")).alias("expected"), digest(F.col("event_id")).alias("state"),
    )
    initial = events.sparkSession.range(1).select(digest(F.lit(0))).first()[0]
    return accepted_writes(writes, initial).select("entity", "seq", "accepted")


ITEM_COMMANDS = "CASE event_type WHEN 'signup' THEN 'claim' WHEN 'view' THEN 'progress' WHEN 'click' THEN CASE WHEN value > 120 THEN 'complete' ELSE 'progress' END WHEN 'purchase' THEN 'retry' ELSE 'fail' END"


def item_events(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("item"), F.col("event_id").alias("seq"), S.milliseconds("ts").alias("at"), F.expr(ITEM_COMMANDS).alias("command"), F.floor("value").alias("progress"), (F.col("event_id") % 3 != 0).alias("retryable"), F.col("ts").cast("timestamp").alias("ts"))


_RUN = "s.cmd = 'claim' AND r.status = 'queued'"
_STEP = "s.cmd = 'progress' AND r.status = 'running' AND s.p BETWEEN 0 AND 99"
_END, _LOSE, _AGAIN = "s.cmd = 'complete' AND r.status = 'running'", "s.cmd = 'fail' AND r.status = 'running'", "s.cmd = 'retry' AND r.status = 'failed' AND r.retryable"
SQL_ITEMS = f"""s AS (SELECT user_id AS item, event_id AS seq, {ITEM_COMMANDS} AS cmd, CAST(floor(value) AS BIGINT) AS p, event_id % 3 <> 0 AS again, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
r AS (SELECT DISTINCT item, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, '' AS outcome, 'queued' AS status, CAST(0 AS BIGINT) AS progress, false AS retryable, CAST(0 AS BIGINT) AS attempts FROM s
 UNION ALL SELECT s.item, s.n, s.seq, CASE WHEN {_RUN} OR {_STEP} OR {_END} OR {_LOSE} OR {_AGAIN} THEN 'done' WHEN s.cmd = 'complete' AND r.status = 'completed' OR s.cmd = 'fail' AND r.status = 'failed' THEN 'kept' ELSE 'refused' END,
  CASE WHEN {_RUN} THEN 'running' WHEN {_END} THEN 'completed' WHEN {_LOSE} THEN 'failed' WHEN {_AGAIN} THEN 'queued' ELSE r.status END, CASE WHEN {_STEP} THEN s.p WHEN {_END} THEN 100 WHEN {_AGAIN} THEN 0 ELSE r.progress END,
  CASE WHEN {_LOSE} THEN s.again WHEN {_RUN} OR {_END} OR {_AGAIN} THEN false ELSE r.retryable END, r.attempts + CASE WHEN {_RUN} THEN 1 ELSE 0 END FROM r JOIN s ON s.item = r.item AND s.n = r.n + 1)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _worked(spark, item_events(S.table_stream(spark, f"{sf_dir}/events.parquet")), "item", S.UploadItems(), "items")


def _last_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), S.milliseconds("ts").alias("at"))
    return _items(spark, sf_dir).join(order, "seq").groupBy("item").agg(F.max_by(F.struct("status", "progress"), F.struct("at", "seq")).alias("s")).select("item", "s.*")


@query("E17_upload_transitions", f"WITH RECURSIVE {SQL_ITEMS} SELECT item, seq, outcome, status, progress, retryable, attempts FROM r WHERE n > 0")
def upload_transitions(spark, sf_dir):
    """Events as commands to each user's upload: what was done, kept or refused, and the item after it."""
    return _items(spark, sf_dir)


@query("E17_upload_jobs", f"""WITH RECURSIVE {SQL_ITEMS}, l AS (SELECT * FROM r QUALIFY n = max(n) OVER (PARTITION BY item))
SELECT item % 10 AS job, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('queued', 'running')) = 0 AS finished, CAST(floor(avg(progress)) AS BIGINT) AS progress FROM l GROUP BY 1""")
def upload_jobs(spark, sf_dir):
    return S.upload_jobs(_last_states(spark, sf_dir).withColumn("job", F.col("item") % 10))


@query("X04_recovered_items", f"""WITH RECURSIVE {SQL_ITEMS}, l AS (SELECT * FROM r QUALIFY n = max(n) OVER (PARTITION BY item)), k AS (SELECT c_custkey AS item FROM customer WHERE c_acctbal > 3000)
SELECT item, CASE WHEN status = 'running' THEN CASE WHEN item IN (SELECT item FROM k) THEN 'completed' ELSE 'queued' END ELSE status END AS status, CASE WHEN status = 'running' THEN CASE WHEN item IN (SELECT item FROM k) THEN 100 ELSE 0 END ELSE progress END AS progress FROM l""")
def recovered_uploads(spark, sf_dir):
    """The uploads after a restart; projects of customers with a good balance had been stored."""
    stored = table(spark, sf_dir, "customer").where("c_acctbal > 3000").select(F.col("c_custkey").alias("item"))
    return S.recovered_items(_last_states(spark, sf_dir), stored)
