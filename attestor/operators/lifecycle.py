"""The lifecycle state machine over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Allowed edges.
EDGES = {"registered": ["acquired"], "acquired": ["claims_proposed"], "claims_proposed": ["reconciled"], "reconciled": ["contract_built"], "contract_built": ["validated"], "validated": ["review_required", "approval_ready"], "review_required": ["approved", "revoked"], "approval_ready": ["approved", "revoked"], "approved": ["published", "revoked"], "published": ["stale", "superseded", "revoked"], "stale": ["superseded", "revoked"]}
#: Who may bring about a state; any actor where a state is not listed.
ACTORS = {"claims_proposed": ["runtime", "system"], "validated": ["policy", "system"], "review_required": ["policy", "system"], "approval_ready": ["policy", "system"], "approved": ["approver"], "published": ["publisher", "system"]}
#: Artifacts that must be there.
REQUIRED = {"acquired": ["evidence_bundle"], "claims_proposed": ["runtime_result"], "reconciled": ["grounded_claims"], "contract_built": ["contract"], "validated": ["validation_decision"], "review_required": ["validation_decision", "candidate_release"], "approval_ready": ["validation_decision", "candidate_release"], "approved": ["candidate_release", "validation_decision"], "published": ["projections"]}


def edge_keys() -> list[str]:
    return [f"{a}>{b}" for a, bs in EDGES.items() for b in bs]


def _lookup(table: dict[str, list[str]], key: Column) -> Column:
    values = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.try_element_at(values, key)


def verdict(state: Column, have: Column, keys: Column, target: Column, actor: Column, key: Column, artifacts: Column) -> Column:
    """What becomes of an event that meets ``state``, the artifacts ``have`` and the idempotency ``keys`` processed so far: the first rule it breaks, if any."""
    none = F.array().cast("array<string>")
    actors = _lookup(ACTORS, target)
    missing = F.array_except(F.coalesce(_lookup(REQUIRED, target), none), F.concat(have, F.coalesce(artifacts, none)))
    return (
        F.when(F.array_contains(keys, key) & (target == state), "replayed")
        .when(~F.array_contains(F.coalesce(_lookup(EDGES, state), none), target), "illegal_edge")
        .when(actors.isNotNull() & ~F.array_contains(actors, actor), "wrong_actor")
        .when(F.size(missing) > 0, "missing_artifact")
        .otherwise("accepted")
    )


def check_transitions(events: DataFrame, start: str = "registered") -> DataFrame:
    """Each event (aggregate_id, ord, target, actor, key, artifacts) with the ``state`` before it and its ``verdict``.

    A refused event changes nothing: neither the state, nor the artifacts at hand, nor the keys processed; a replay of a
    processed key that asks for the present state is no error. One fold over the events of each aggregate in order
    (ties by target, actor, key) keeps only what was accepted, of which the graph, having no way back, allows
    few; every event is then judged against the acceptances before it. One shuffle, by aggregate.
    """
    others = [c for c in events.columns if c not in ("aggregate_id", "ord", "target", "actor", "key", "artifacts")]
    none = F.array().cast("array<string>")
    event = F.struct("ord", "target", "actor", "key", F.coalesce("artifacts", none).alias("artifacts"), *others)
    one = events.groupBy("aggregate_id").agg(F.sort_array(F.collect_list(event)).alias("events"))
    began = F.struct(F.lit(start).alias("state"), none.alias("have"), none.alias("keys"), F.lit(0).alias("at"), F.array(F.struct(F.lit(-1).alias("at"), F.lit(start).alias("state"), none.alias("have"), none.alias("keys"))).alias("past"))

    def step(acc: Column, e: Column) -> Column:
        took = verdict(acc.state, acc.have, acc["keys"], e.target, e.actor, e.key, e.artifacts) == "accepted"
        state = F.when(took, e.target).otherwise(acc.state)
        have = F.when(took, F.array_union(acc.have, e.artifacts)).otherwise(acc.have)
        keys = F.when(took, F.array_union(acc["keys"], F.array(e.key))).otherwise(acc["keys"])
        mark = F.struct(acc["at"].alias("at"), state.alias("state"), have.alias("have"), keys.alias("keys"))
        past = F.when(took, F.concat(acc.past, F.array(mark))).otherwise(acc.past)
        return F.struct(state.alias("state"), have.alias("have"), keys.alias("keys"), (acc["at"] + 1).alias("at"), past.alias("past"))

    folded = one.withColumn("past", F.aggregate("events", began, step, lambda acc: acc.past))
    each = folded.select("aggregate_id", "past", F.posexplode("events").alias("pos", "e"))
    each = each.withColumn("before", F.element_at(F.filter("past", lambda p: p["at"] < F.col("pos")), -1))
    said = verdict(F.col("before.state"), F.col("before.have"), F.col("before.keys"), F.col("e.target"), F.col("e.actor"), F.col("e.key"), F.col("e.artifacts"))
    return each.select("aggregate_id", "e.*", F.col("before.state").alias("state"), said.alias("verdict"))
