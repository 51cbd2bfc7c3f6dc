"""Processors of streams against plain replays, over the driver's events in several files, stopped and started again; guarded writes."""

import json
import os
import random
from collections import Counter, OrderedDict, defaultdict

import pytest

from lintel.operators.guarded import accepted_writes
from lintel.plans import streams
from lintel.streaming import stateful as S

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The events in six files, in order of time, each of which comes when `arrive` is called."""
    folder = tmp_path_factory.mktemp("events")
    events = spark.read.parquet(f"{SF}/events.parquet").where("user_id % 4 = 0 OR user_id % 7 = 0")
    rows = events.orderBy("ts").toPandas()
    size = -(-len(rows) // 6)
    for i in range(6):
        rows.iloc[i * size : (i + 1) * size].pipe(lambda d: spark.createDataFrame(d, events.schema)).coalesce(1).write.parquet(f"{folder}/{i}")
    return [f"{folder}/{i}" for i in range(6)], sorted((tuple(r) for r in events.select("user_id", S.milliseconds("ts"), "event_id", "event_type", "value").collect()), key=lambda r: (r[1], r[2]))


def fed(spark, parts, tmp_path, shape, key, processor):
    """Rows that come out if files arrive one by one, and the stream is started anew for each of them but the first two."""
    source, out, state = f"{tmp_path}/events.parquet", f"{tmp_path}/out", f"{tmp_path}/state"
    for i, part in enumerate(parts):
        spark.read.parquet(part).coalesce(1).write.mode("append").parquet(source)
        if i:
            rows = shape(S.table_stream(spark, source, files=1))
            S.run_processor(rows, [key], processor(), processor().SCHEMA, out, state).awaitTermination()
    return [tuple(r) for r in spark.read.schema(processor().SCHEMA).parquet(out).collect()]


def replayed_jobs(events, lease_ms):
    """Written from the rules of the queue: one dictionary a job."""
    jobs, log = {}, []
    for user, at, _, kind, value in events:
        j = jobs.setdefault(user, {"status": "", "done": 0, "started": False, "until": None})
        if j["status"] == "running" and at >= j["until"]:
            log.append((user, j["until"], "lost", "queued", j["done"]))
            j.update(status="queued", started=False)
        before = j["status"], j["done"]
        what = {"signup": "enqueue", "purchase": "retry", "view": "claim", "click": "finish"}.get(kind) or ("pause" if value < 40 else "fail")
        active = j["status"] in ("queued", "running")
        if what in ("enqueue", "retry"):
            if not active and (what == "retry" or j["status"] in ("", "completed")):
                j["status"] = "completed" if j["done"] == 10 + user % 5 else "queued"
        elif what == "claim":
            if active:
                j.update(status="running", started=True, until=at + lease_ms)
        elif what == "finish":
            if j["started"]:
                j["done"] += 1
                j["started"] = False
                if j["status"] == "running":
                    if j["done"] == 10 + user % 5:
                        j["status"] = "completed"
                    else:
                        j.update(started=True, until=at + lease_ms)
        elif what == "pause":
            if active:
                j["status"] = "paused"
        elif j["status"] == "running":
            j.update(status="failed", started=False)
        if (j["status"], j["done"]) != before:
            log.append((user, at, what, j["status"], j["done"]))
    last = max(e[1] for e in events)
    log += [(u, j["until"], "lost", "queued", j["done"]) for u, j in jobs.items() if j["status"] == "running" and j["until"] <= last]
    return log


def test_jobs_survive_restarts(spark, parts, tmp_path):
    files, events = parts
    got = fed(spark, files, tmp_path, streams.job_events, "job", lambda: S.DurableJobs(streams.LEASE_MS))
    assert sorted(got) == sorted(replayed_jobs(events, streams.LEASE_MS))
    steps = Counter((job, done) for job, _, what, _, done in got if what == "finish")
    assert max(steps.values()) == 1  # no step twice
    assert any(what == "finish" and status == "paused" for _, _, what, status, _ in got)  # pause wins over a worker that finishes
    assert any(what == "lost" for _, _, what, _, _ in got)


def test_cache_equals_a_replay(spark, parts, tmp_path):
    files, events = parts
    until, expected = {}, []
    for user, at, seq, kind, _ in events:
        hit = at < until.get(user, 0)
        expected.append((user, seq, hit))
        if not hit:
            until[user] = at + (60_000 if kind == "error" else 86_400_000)
    got = fed(spark, files, tmp_path, streams.cache_events, "key", S.LifetimeCache)
    assert sorted(got) == sorted(expected)
    assert {h for _, _, h in got} == {True, False}


def test_recently_used_entries_equal_an_ordered_map(spark, tmp_path):
    rng = random.Random(2)
    batches = [[(rng.randrange(3), f"d{rng.randrange(12)}", 100 * b + i) for i in range(30)] for b in range(5)]
    batches.append(list(batches[-1]))  # what is held is not computed again
    expected, held = [], defaultdict(OrderedDict)
    for batch in batches:
        for bucket in range(3):
            asked, first, uses = held[bucket], {}, Counter()
            for b, digest, doc in batch:
                if b == bucket:
                    first[digest] = min(doc, first.get(digest, doc))
                    uses[digest] += 1
            order = sorted(first, key=first.get)
            known = {d: doc for d, doc in asked.items()}
            for d in order:
                asked[d] = first[d]
                asked.move_to_end(d)
            gone = {}
            while len(asked) > 5:
                d, doc = asked.popitem(last=False)
                gone[d] = doc
            expected += [(bucket, d, first[d], uses[d], d not in known, d in gone) for d in order]
            expected += [(bucket, d, doc, 0, False, True) for d, doc in gone.items() if d not in first]
    source, out, state = f"{tmp_path}/asked", f"{tmp_path}/out", f"{tmp_path}/state"
    for batch in batches:
        rows = spark.createDataFrame(batch, "bucket int, digest string, doc long")
        rows.coalesce(1).write.mode("append").parquet(source)
        S.run_processor(S.table_stream(spark, source, files=1), ["bucket"], S.RecentlyUsed(5), S.RecentlyUsed.SCHEMA, out, state, None).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == sorted(expected)


def test_bad_items_land_once(spark, tmp_path):
    """A batch that died between its two tables runs again; nothing is lost or doubled."""
    source = f"{tmp_path}/items"
    done, dead, state = (f"{tmp_path}/{x}" for x in ("done", "dead", "state"))
    for b in range(3):
        spark.createDataFrame([(i, json.dumps({"k": i}) if i % 11 else "broken") for i in range(40 * b, 40 * b + 40)], "event_id long, props string").coalesce(1).write.mode("append").parquet(source)
    tries = {"n": 0}
    real = S.isolated

    def dies(rows, work, attempts):
        tries["n"] += 1
        if tries["n"] == 2:
            raise RuntimeError("killed")
        return real(rows, work, attempts)

    S.isolated = dies
    try:
        with pytest.raises(Exception, match="killed"):
            S.run_isolated(S.table_stream(spark, source, files=1), streams.read_number, done, dead, state).awaitTermination()
        S.run_isolated(S.table_stream(spark, source, files=1), streams.read_number, done, dead, state).awaitTermination()
    finally:
        S.isolated = real
    good = {r["event_id"]: (r["result"], r["tried"]) for r in spark.read.parquet(done).collect()}
    bad = [(r["event_id"], r["tried"]) for r in spark.read.parquet(dead).collect()]
    assert good == {i: (str(i), 2 if i % 10 == 5 else 1) for i in range(120) if i % 11 and i % 10}
    assert sorted(bad) == [(i, 3) for i in range(120) if not i % 11 or not i % 10]


def test_state_store_setting_is_restored(spark):
    before = spark.conf.get(S.PROVIDER, None)
    with S.rocks_state(spark):
        assert spark.conf.get(S.PROVIDER) == S.ROCKS
    assert spark.conf.get(S.PROVIDER, None) == before


@pytest.mark.parametrize("seed", range(3))
def test_guarded_writes_equal_a_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([0, 0, 1, 2]), i, rng.choice([f"s{rng.randrange(4)}", None]) if rng.random() < 0.9 else "zz", f"s{rng.randrange(4)}" if rng.random() < 0.95 else None) for i in range(300)]
    now, expected = defaultdict(lambda: "s0"), {}
    for entity, seq, wanted, state in rows:
        expected[seq] = wanted is not None and now[entity] is not None and wanted == now[entity]
        if expected[seq]:
            now[entity] = state
    df = spark.createDataFrame(rows, "entity int, seq long, expected string, state string").repartition(5)
    assert {r["seq"]: r["accepted"] for r in accepted_writes(df, "s0").collect()} == expected
    assert accepted_writes(df.where("false"), "s0").collect() == []


def test_uploads_equal_a_replay(spark, parts, tmp_path):
    files, events = parts
    items, expected = {}, []
    for user, _, seq, kind, value in events:
        x = items.setdefault(user, {"status": "queued", "progress": 0, "retryable": False, "attempts": 0})
        what = {"signup": "claim", "view": "progress", "purchase": "retry", "error": "fail"}.get(kind) or ("complete" if value > 120 else "progress")
        outcome = "refused"
        if what == "claim":
            if x["status"] == "queued":
                outcome = "done"
                x.update(status="running", retryable=False, attempts=x["attempts"] + 1)
        elif what == "progress":
            if x["status"] == "running" and value < 100:
                outcome = "done"
                x["progress"] = int(value)
        elif what == "retry":
            if x["status"] == "failed" and x["retryable"]:
                outcome = "done"
                x.update(status="queued", progress=0, retryable=False)
        else:
            end = "completed" if what == "complete" else "failed"
            if x["status"] == end:
                outcome = "kept"
            elif x["status"] == "running":
                outcome = "done"
                x.update(status=end, retryable=what == "fail" and seq % 3 != 0)
                if what == "complete":
                    x["progress"] = 100
        expected.append((user, seq, outcome, x["status"], x["progress"], x["retryable"], x["attempts"]))
    got = fed(spark, files, tmp_path, streams.item_events, "item", S.UploadItems)
    assert sorted(got) == sorted(expected)
    assert {r[2] for r in got} == {"done", "kept", "refused"}
