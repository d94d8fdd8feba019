"""Streams against the same rows as tables."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from attestor.operators.lifecycle import ACTORS, EDGES, REQUIRED, check_transitions
from attestor.streaming.events import transitions, windowed_counts

SCHEMA = "aggregate_id string, ord long, target string, actor string, key string, artifacts array<string>"


def drain(stream, path, mode="append"):
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert query.exception() is None


def test_state_goes_on_between_batches(spark, tmp_path):
    r = random.Random(4)
    events, artifacts = [], sorted(set(sum(REQUIRED.values(), [])))
    states = sorted({*EDGES, *sum(EDGES.values(), [])})
    for a in range(6):
        path = iter(["acquired", "claims_proposed", "reconciled", "contract_built", "validated", "approval_ready", "approved", "published"])
        for i in range(20):
            target = next(path, "revoked") if r.random() < 0.5 else r.choice(states)
            events.append((f"a{a}", i, target, r.choice(ACTORS.get(target, ["system"])), f"k{r.randrange(15)}", artifacts if r.random() < 0.8 else None))
    for part in range(2):  # two batches, the first half of every aggregate and the second
        spark.createDataFrame([e for e in events if e[1] // 10 == part], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = transitions(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
        drain(stream, tmp_path)
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("aggregate_id", "ord", "target", "state", "verdict").collect()))
    want = sorted((x.aggregate_id, x.ord, x.target, x.state, x.verdict) for x in check_transitions(spark.createDataFrame(events, SCHEMA)).collect())
    assert got == want and len({w[4] for w in want}) >= 3


def test_windows_close_and_late_events_are_left_out(spark, tmp_path):
    start = datetime(2024, 1, 1)
    batches = [[(0, "a"), (3, "a"), (7, "b"), (40, "a")], [(1, "a"), (41, "b")], [(90, "a")]]
    for rows in batches:
        spark.createDataFrame([(start + timedelta(minutes=m), k) for m, k in rows], "at timestamp, k string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        drain(windowed_counts(spark.readStream.schema("at timestamp, k string").parquet(f"{tmp_path}/in"), "at", ["k"], "10 minutes", "5 minutes"), tmp_path)
    got = sorted((int((r.start - start).total_seconds() // 60), r.k, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, "a", 2), (0, "b", 1), (40, "a", 1), (40, "b", 1)]
