"""Numbers with more digits than their padding."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.operators.facts import scaffold
from attestor.operators.manifest import sequential_ids


def test_ids_beyond_the_padding_stay_apart(spark):
    rows = spark.range(1205, numPartitions=5).select((F.lit(1204) - F.col("id")).alias("k"), (F.col("id") % 3).alias("g"))
    assert {r.k: r.id for r in sequential_ids(rows, "SQ-", ["k"]).collect()} == {k: f"SQ-{k + 1:03d}" for k in range(1205)}
    got = sequential_ids(rows, "N%", ["k"], width=2, within=["g"]).collect()
    assert len(got) == 1205 and len({(r.g, r.id) for r in got}) == 1205 and max(len(r.id) for r in got) == 5


def test_every_draft_has_a_file_of_its_own(spark):
    drafts = [(f"s{n % 3}.md", n, "GET", "/same") for n in range(130)]
    got = scaffold(spark.createDataFrame(drafts, "source string, line int, method string, path string")).collect()
    assert {r.file: (r.source, r.line, r.method, r.path) for r in got} == {f"ep{n:02d}.json": d for n, d in enumerate(sorted(drafts))} and len(got) == 130
