"""Chains of parents that never end."""

from __future__ import annotations

from attestor.operators.claims import parent_cycles


def test_long_and_attached_cycles(spark):
    parent = {i: (i + 1) % 70 for i in range(70)} | {i: i - 1 for i in range(70, 300)} | {300: None, 301: 300, 302: 302, 303: 302, 304: 999, 305: 304}
    rows = parent_cycles(spark.createDataFrame(list(parent.items()), "id long, parent long")).collect()
    got = {r.id: (r.violation, r.on_cycle) for r in rows}
    assert len(rows) == len(got)
    want = {i: ("PARENT_CYCLE", i < 70) for i in range(300)} | {302: ("PARENT_CYCLE", True), 303: ("PARENT_CYCLE", False), 304: ("PARENT_MISSING", False)}
    assert got == want
