"""Lenient reading of model replies: aliases, types, fenced blocks, odd ones."""

import json

import pytest

from tidewell.operators import replies

FACT = {"subject": "s", "predicate": "p", "object": "o"}
READ = ("s", "p", "o", "literal")
CASES = [
    ({"content": " c ", "triples": [FACT]}, ("c", 0.6, [READ])),
    ({"content": "", "summary": "z", "confidence": 1, "triples": [FACT]}, ("z", 1.0, [READ])),
    ({"content": "c", "confidence": True, "triples": [FACT, {"subject": "s", "predicate": "p"}, None, [], "x"]}, ("c", 0.6, [READ])),
    ({"content": "c", "confidence": 1e300, "triples": [{**FACT, "subject_id": "i", "object_id": 5}, {**FACT, "object_kind": "ENTITY"}]}, ("c", 1.0, [("s", "p", "o", "entity")])),
    ({"content": "c", "triples": {"subject": "s"}}, None),
    ({"triples": [FACT]}, None),
    ({"content": "c"}, None),
    ({"project": " ", "tasks": ["a"], "triples": [FACT]}, ("Recent memories include work items: a.", 0.6, [READ])),
    ({"project": "My App", "tasks": [{"description": " ", "title": "no"}, {"title": "b"}, {"task": "É c"}, 1, "d", "e"]}, ("My App has recent work items: b; É c; d.", 0.6, [("my_app", "has_task", x, "literal") for x in ("b", "c", "d", "e")])),
    ({"project": "!", "tasks": ["?" * 300]}, ("! has recent work items: " + "?" * 300 + ".", 0.6, [("item", "has_task", "item", "literal")])),
    ({"content": "c", "project": "p" * 100, "tasks": [f"t{i}" for i in range(20)]}, ("c", 0.6, [("p" * 80, "has_task", f"t{i}", "literal") for i in range(12)])),
    ([{"content": "c", "triples": [FACT]}], None),
    ("text", None),
]
TOLD = '{"content": "c", "triples": [{"subject": "s", "predicate": "p", "object": "o"}]}'
RAW = [(None, None), ("", None), ("no", None), (TOLD[:-1], None), (f"a\n```json\n{TOLD}\n```\nb", ("c", 0.6, [READ])), (f"```\n{TOLD}", None), (f"```x\n1\n``` ```json\n{TOLD}\n```", ("c", 0.6, [READ])), (f"```\n[1]\n```\n```\n{TOLD}\n```", None)]


def plain(r):
    return r and (r["content"], r["confidence"], [tuple(t) for t in r["triples"]])


@pytest.mark.parametrize("wrap", [str, "```json\n{}\n```".format])
def test_coercion(spark, wrap):
    rows = spark.createDataFrame([(i, wrap(json.dumps(v))) for i, (v, _) in enumerate(CASES)], "id int, reply string")
    found = {r["id"]: plain(r["r"]) for r in replies.coerced(rows, "reply", "r").collect()}
    assert found == {i: want for i, (_, want) in enumerate(CASES)}


def test_fences_and_odd_replies(spark):
    rows = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(RAW)], "id int, reply string")
    found = {r["id"]: plain(r["r"]) for r in replies.coerced(rows, "reply", "r").collect()}
    assert found == {i: want for i, (_, want) in enumerate(RAW)}
