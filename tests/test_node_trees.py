"""Exports of nodes: order of the branch, odd nodes, and cost in proportion to the nodes."""

from __future__ import annotations

import json
import time

import pytest

from cairnlake.operators import transcripts
from cairnlake.operators.node_trees import branch_of


def _node(parent, children, role=None, parts=()):
    message = None if role is None else {"author": {"role": role}, "content": {"parts": list(parts)}}
    return {"parent": parent, "children": children, "message": message}


def _chain(n: int) -> str:
    nodes = {f"n{i}": _node(f"n{i - 1}" if i else "root", [f"n{i + 1}"], "user" if i % 2 == 0 else "assistant", [f"m{i}"]) for i in range(n)}
    # The root comes last, so the order of the file does not give the branch away.
    return json.dumps({"mapping": {**dict(reversed(nodes.items())), "root": _node(None, ["n0"])}})


def test_a_root_without_a_message_comes_first():
    tree = {"mapping": {"a": _node(None, [], "user", ["wrong"]), "r": _node(None, ["b"]), "b": _node("r", [], "user", ["right"])}}
    assert branch_of(json.dumps(tree)) == [{"role": "user", "text": "right"}]
    del tree["mapping"]["r"]
    assert branch_of(json.dumps(tree)) == [{"role": "user", "text": "wrong"}]


@pytest.mark.parametrize(
    "text",
    ["", "{", "[]", "null", '{"mapping":[]}', '{"mapping":{}}', '{"mapping":{"a":1}}', '{"mapping":{"a":{"parent":"b"}}}', "[" * 100_000],
)
def test_other_content_has_no_branch(text):
    assert branch_of(text) is None


def test_the_branch_ends_at_odd_nodes():
    said = _node(None, ["gone"], "user", ["x", None, " ", 3, "y"])
    for extra in ({}, {"gone": 5}, {"gone": _node("a", ["a"], "tool", ["t"])}, {"gone": _node("a", [["list"]])}):
        assert branch_of(json.dumps({"mapping": {"a": said, **extra}})) == [{"role": "user", "text": "x y"}]
    half = '{"mapping":{"a":{"message":{"author":{"role":"user"},"content":{"parts":["x\\ud800"]}}}}}'
    assert branch_of(half) == [{"role": "user", "text": "x?"}]


def test_a_long_branch_costs_linear_time(spark):
    files = [("short.json", _chain(4)), ("long.json", _chain(60_000)), ("none.json", None), ("empty.json", "")]
    df = spark.createDataFrame(files, "path string, content string")
    started = time.time()
    got = {r["path"]: r["transcript"] for r in transcripts.normalize(df).collect()}
    assert got["short.json"] == "> m0\nm1\n\n> m2\nm3\n"
    lines = [line for line in got["long.json"].split("\n") if line]
    assert lines == [f"> m{i}" if i % 2 == 0 else f"m{i}" for i in range(60_000)]
    assert got["none.json"] is None and got["empty.json"] == ""
    # A walk that looks through the nodes at each step would take 60,000 x 60,000 comparisons.
    assert time.time() - started < 120
