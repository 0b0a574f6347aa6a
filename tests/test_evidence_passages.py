"""Evidence is looked for in every attribute and line of a source, however many and long they are."""

from __future__ import annotations

import pytest

from shelfmark.functions import specs
from shelfmark.operators import evidence_passages

RULES = {"C": (specs.Field("n", "integer", specs.Names("n"), specs.Text(r"wide: (\d+)")),)}
SOURCE = "record_id long, source_id long, category string, attributes array<struct<name:string,value:string>>, text string"
OTHER, FILL = [("o", "x")], "filler " * 300


@pytest.mark.parametrize(("attributes", "text", "passage", "pos"), [
    (OTHER * 260 + [("n", "7")], None, "n: 7", 260), ([], "\n".join(["x"] * 450 + ["wide: 7", "wide: 7"]), "wide: 7", 450), ([], f"{'x' * 41_000}\n\nwide: 7", "wide: 7", 1), ([], f"{FILL}wide: 7", f"{FILL}wide: 7", 0),
    ([("n", f"{FILL}7")], f"a\n{FILL}wide: 7", f"n: {FILL}7", 0), (OTHER * 300, "\n".join([FILL] * 401 + ["wide: 7"]), "wide: 7", 701),
])
def test_late_and_long_passages(spark, attributes, text, passage, pos):
    source = spark.createDataFrame([(1, 2, "C", attributes, text)], SOURCE)
    found = spark.createDataFrame([(1, 2, "n", "7")], "record_id long, source_id long, field string, value string")
    got = evidence_passages.evidence(source, found, RULES).collect()
    assert [(r.field, r.value, r.passage, r.pos) for r in got] == [("n", "7", passage, pos)]


def test_sources_without_passages(spark):
    rows = spark.createDataFrame([(1, 1, "C", None, None), (2, 1, "C", [], " \n\n"), (3, 1, None, None, "a")], SOURCE)
    assert [(r.record_id, r.pos, r.text) for r in evidence_passages.passages(rows).collect()] == [(3, 0, "a")]
