"""Lifecycles against a machine that takes one event at a time."""

from __future__ import annotations

import random

from attestor.operators.lifecycle import ACTORS, EDGES, REQUIRED, check_transitions

SCHEMA = "aggregate_id long, ord int, target string, actor string, key string, artifacts array<string>, note string"


def machine(events):
    state, have, keys, out = "registered", set(), set(), []
    for aggregate, ord_, target, actor, key, artifacts, note in events:
        everything = have | set(artifacts or [])
        if key in keys and target == state:
            verdict = "replayed"
        elif target not in EDGES.get(state, []):
            verdict = "illegal_edge"
        elif target in ACTORS and actor not in ACTORS[target]:
            verdict = "wrong_actor"
        elif set(REQUIRED.get(target, [])) - everything:
            verdict = "missing_artifact"
        else:
            verdict = "accepted"
        out.append((aggregate, ord_, target, state, verdict, note))
        if verdict == "accepted":
            state, have, keys = target, everything, keys | {key}
    return out


def run(spark, events):
    return sorted((r.aggregate_id, r.ord, r.target, r.state, r.verdict, r.note) for r in check_transitions(spark.createDataFrame(events, SCHEMA)).collect())


def test_a_refused_event_moves_nothing(spark):
    events = [
        (1, 0, "published", "publisher", "a", ["projections"], "n"), (1, 1, "revoked", "system", "b", [], "n"), (1, 2, "acquired", "system", "c", [], "n"), (1, 3, "acquired", "system", "d", ["evidence_bundle"], "n"),
        (1, 4, "acquired", "system", "d", None, "n"), (1, 5, "claims_proposed", "approver", "e", ["runtime_result"], "n"), (1, 6, "claims_proposed", "runtime", "f", [], "n"), (1, 7, "claims_proposed", "runtime", "e", ["runtime_result"], "n"),
    ]
    verdicts = ["illegal_edge", "illegal_edge", "missing_artifact", "accepted", "replayed", "wrong_actor", "missing_artifact", "accepted"]
    assert [r[4] for r in run(spark, events)] == verdicts and run(spark, events) == machine(events)


def test_equals_the_machine(spark):
    r = random.Random(2)
    states = sorted({*EDGES, *sum(EDGES.values(), [])})
    artifacts = sorted(set(sum(REQUIRED.values(), [])))
    events, want = [], []
    for aggregate in range(40):
        at, mine = "registered", []
        for i in range(60):
            target = r.choice(EDGES.get(at, states)) if r.random() < 0.7 else r.choice(states)
            actor = r.choice(ACTORS.get(target, ["system"])) if r.random() < 0.8 else "stranger"
            mine.append((aggregate, i, target, actor, f"k{r.randrange(40)}", None if r.random() < 0.2 else artifacts if r.random() < 0.7 else r.sample(artifacts, 2), f"{i}"))
            at = machine(mine)[-1][2] if machine(mine)[-1][4] == "accepted" else machine(mine)[-1][3]
        events += mine
        want += machine(mine)
    r.shuffle(events)
    assert run(spark, events) == sorted(want)
    assert {w[4] for w in want} == {"accepted", "illegal_edge", "wrong_actor", "missing_artifact", "replayed"}
    assert run(spark, events[:0]) == []
