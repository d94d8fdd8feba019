"""Event streams: the lifecycle machine with state per aggregate, and windowed counts with a bound on lateness."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attestor.operators.lifecycle import ACTORS, EDGES, REQUIRED

JUDGED = "aggregate_id string, ord long, target string, state string, verdict string"


def transitions(events: DataFrame, start: str = "registered") -> DataFrame:
    """(aggregate_id, ord, target, state, verdict) of a stream of events (aggregate_id, ord, target, actor, key, artifacts), as operators.lifecycle gives for a table.

    State, artifacts and processed keys of an aggregate are kept between micro-batches; the events of a batch are taken in order
    of ord, target, actor and key. An event that arrives after a later one was judged meets the state it then finds.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state, have, keys = json.loads(kept.get[0]) if kept.exists else (start, [], [])
        have, keys, out = set(have), set(keys), []
        for e in pd.concat(list(frames)).sort_values(["ord", "target", "actor", "key"]).itertuples():
            artifacts = have | set(e.artifacts if e.artifacts is not None else ())
            if e.key in keys and e.target == state:
                verdict = "replayed"
            elif e.target not in EDGES.get(state, ()):
                verdict = "illegal_edge"
            elif e.target in ACTORS and e.actor not in ACTORS[e.target]:
                verdict = "wrong_actor"
            elif not artifacts.issuperset(REQUIRED.get(e.target, ())):
                verdict = "missing_artifact"
            else:
                verdict = "accepted"
            out.append((str(key[0]), int(e.ord), e.target, state, verdict))
            if verdict == "accepted":
                state, have, keys = e.target, artifacts, keys | {e.key}
        kept.update((json.dumps([state, sorted(have), sorted(keys)]),))
        yield pd.DataFrame(out, columns=["aggregate_id", "ord", "target", "state", "verdict"])

    return events.groupBy("aggregate_id").applyInPandasWithState(fold, JUDGED, "kept string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str, late: str) -> DataFrame:
    """(start, end, *keys, n) of events by time window; windows close once events are ``late`` past their end, and later ones are left out."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select("w.start", "w.end", *keys, "n")
