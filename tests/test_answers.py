"""Coercion of structured answers against a reader in plain Python, over random shapes."""

from __future__ import annotations

import json
import random

import pytest

from attestor.operators import answers
from attestor.operators.planning import STAGES


def fits(value, kind):
    if kind == "text":
        return value is None or isinstance(value, str)
    value = value or []
    if not isinstance(value, list):
        return False
    one = {
        "list": lambda x: True, "objects": lambda x: isinstance(x, dict), "texts": lambda x: isinstance(x, str),
        "operations": lambda x: isinstance(x, dict) and isinstance(x.get("operation"), str) and (x.get("field") is None or isinstance(x["field"], str)),
    }[kind]
    return all(map(one, value))


def told(x):
    return x if isinstance(x, str) else json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def reader(run, rows, names):
    """The items of one run's answers (stage, ord, query, answer object or None); ``names`` maps names to documents."""
    out, last = [], {}
    for stage, ord_, query, block in sorted(rows, key=lambda r: r[1]):
        last[stage] = (query, block)
    for stage, fields in answers.FIELDS.items():
        query, block = last.get(stage, (None, None))
        area = STAGES[stage]
        if block is None:
            out.append((run, stage, query, -1, "missing", None, None, "no structured answer", None))
            continue
        raw = block.get(area)
        if raw is not None and not isinstance(raw, list):
            out.append((run, stage, query, -1, "missing", None, None, f"malformed shape for {area}", None))
            raw = None
        for i, item in enumerate(raw or []):
            wrong = next((f for f, kind in fields.items() if not fits(item.get(f), kind)), None) if isinstance(item, dict) else ""
            if wrong is not None:
                out.append((run, stage, query, i, "missing", None, None, f"malformed item in {area}", wrong or None))
                continue
            source = item.get("source") if isinstance(item.get("source"), str) else None
            at = names.get(source.lower() if source else None) or (next(iter(names.values())) if len(set(names.values())) == 1 else None)
            label = next((item[x] for x in ("path", "name", "code") if isinstance(item.get(x), str) and item[x]), area)
            out.append((run, stage, query, i, "item", "supported" if at else "unverified", at, label, told(item)))
    for stage, (query, block) in last.items():
        for member, kind in (("missing", "missing"), ("conflicts", "conflict")):
            for i, x in enumerate(block[member] if block and isinstance(block.get(member), list) else []):
                out.append((run, stage, query, i, kind, None, None, told(x), None))
    return out


@pytest.fixture(scope="module")
def cases():
    r = random.Random(5)
    odd = [None, "", "x", 0, 1, 2.5, True, False, [], {}, ["a"], [1], [{}], [{"operation": "GET /a"}], [{"operation": "o", "field": None}], [{"operation": 1}], [{"operation": "o", "field": 3}], [None], {"a": 1}]
    rows, want, docs = [], [], []
    for run in range(60):
        names = {1: {"a.md": "d1"}, 2: {"a.md": "d1", "b.md": "d2"}, 0: {}}[run % 3]
        docs += [(run, d, n.upper()) for n, d in names.items()]
        mine = []
        for stage in [*answers.FIELDS, "10", "06"]:
            for n in range(r.choice([0, 1, 1, 2])):
                fields = answers.FIELDS.get(stage, {})
                make = lambda: {f: (r.choice(["t", "é~", None]) if k == "text" and r.random() < 0.8 else r.choice(odd)) for f, k in fields.items() if r.random() < 0.8} | ({"source": r.choice(["A.md", "b.MD", "z", 4, None])} if r.random() < 0.8 else {})  # noqa: E731, B023
                items = r.choice([r.choice(odd), [make() if r.random() < 0.9 else r.choice(odd) for _ in range(3)], [make()]])
                block = {"missing": r.choice([None, "m", ["gap", 3, {"b": 1, "a": None}]]), "conflicts": r.choice([["c"], [], 1])} | ({STAGES.get(stage, "x"): items} if r.random() < 0.9 else {})
                block = None if r.random() < 0.1 else block
                mine.append((stage, n, f"q{stage}-{n}", block))
        if mine:
            rows += [(run, s, n, q, "no answer here" if b is None else f"Here:\n```json\n{json.dumps(b, ensure_ascii=False)}\n```\ndone") for s, n, q, b in mine]
            want += reader(run, [m for m in mine if m[0] != "06"], names)
    return rows, docs, want


def test_equals_a_reader(spark, cases):
    rows, docs, want = cases
    got = answers.coerced_items(spark.createDataFrame(rows, "run int, stage string, ord int, query_id string, answer string"), spark.createDataFrame(docs, "run int, document string, name string"))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    assert {w[4] for w in want} == {"item", "missing", "conflict"} and {w[8] for w in want if w[7].startswith("malformed item")} >= {"fields", "applies_to", "applicable_to", None}


def test_nothing(spark):
    none = spark.createDataFrame([], "run int, stage string, ord int, query_id string, answer string")
    docs = spark.createDataFrame([], "run int, document string, name string")
    assert answers.coerced_items(none, docs).count() == 0
    one = spark.createDataFrame([(1, "05", 0, None, None)], none.schema)
    assert {(r.stage, r.detail) for r in answers.coerced_items(one, docs).collect()} == {(s, "no structured answer") for s in answers.FIELDS}
