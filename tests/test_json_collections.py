"""Collection documents cut into blocks at every possible place, against a plain parse of the whole."""

from __future__ import annotations

import json
import random

import pytest

from cairnlake.schema import DRAWER_SCHEMA
from cairnlake.sources import json_collections
from cairnlake.sources.json_collections import block_states, read_collections
from cairnlake.sources.store import read_json_collection

TEXTS = ['say "hi"', "back\\slash\\\\", "{[}]", '\\"', "ünïcode 語 😀", "", "a\nb\t", '"Drawers":[{"Id":"fake"}]', "\\" * 9 + '"']


def _document(rng: random.Random, n: int) -> dict:
    drawers = [
        {"Id": f"id{i}", "Text": rng.choice(TEXTS) * rng.randint(1, 4), "Metadata": {"Wing": f"w{i % 3}", "Room": rng.choice(TEXTS) or "r", "ChunkIndex": i}}
        for i in range(n)
    ]
    return {"Other": [{"Id": "no"}, [{"Id": "no"}]], "Name": '"Drawers":[', "Deep": {"Drawers": [{"Id": "no"}]}, "Drawers": drawers, "After": [{"Id": "no"}]}


def _expected(document: dict) -> set[tuple]:
    return {(d["Id"], d["Text"], d["Metadata"]["Wing"], d["Metadata"]["Room"], d["Metadata"]["ChunkIndex"]) for d in document["Drawers"]}


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_any_cut_reads_the_same_drawers(spark, tmp_path, block):
    rng = random.Random(block)
    expected = set()
    for number, indent in enumerate((None, 2, None)):
        document = _document(rng, 5 * number)
        for drawer in document["Drawers"]:
            drawer["Id"] += f"-{number}"
        expected |= _expected(document)
        (tmp_path / f"c {number}.json").write_text(json.dumps(document, indent=indent, ensure_ascii=number == 2))
    got = read_collections(spark, str(tmp_path), block_bytes=block).collect()
    assert {r["status"] for r in got} == {"read"}
    assert sorted((r["id"], r["text"], r["wing"], r["room"], r["chunk_index"]) for r in got) == sorted(expected)


def test_many_tasks_read_one_document(spark, tmp_path):
    path = tmp_path / "big.json"
    document = _document(random.Random(1), 4_000)
    path.write_text(json.dumps(document))
    blocks = block_states(spark.read.format("binaryFile").load(str(path)).selectExpr("path", "length AS size"), 1 << 14)
    assert blocks.count() == -(-path.stat().st_size // (1 << 14)) > 20
    read = read_collections(spark, str(path), block_bytes=1 << 14)
    assert read.rdd.glom().filter(len).count() > 1
    assert read.count() == 4_000
    some = read_collections(spark, str(path), wing="w1", block_bytes=1 << 14)
    assert some.count() == sum(d["Metadata"]["Wing"] == "w1" for d in document["Drawers"])
    assert read_collections(spark, str(path), wing="w1", room="nowhere").count() == 0


def test_a_drawer_longer_than_many_blocks(spark, tmp_path):
    text = 'x"\\{' * 900_000
    (tmp_path / "long.json").write_text(json.dumps({"Drawers": [{"Id": "a", "Text": text}, {"Id": "b", "Text": "t"}]}))
    got = {r["id"]: r["text"] for r in read_collections(spark, str(tmp_path), block_bytes=1 << 20).collect()}
    assert got == {"a": text, "b": "t"}


def test_rejects_are_rows_with_a_reason(spark, tmp_path):
    good = '{"id":"a","TEXT":5,"metadata":{"wing":null,"SourceMtimeUtcMs":1e3,"ChunkIndex":99999999999,"Hall":""}}'
    files = {
        "cut": '{"Drawers":[' + good + ',{"Id":"b","Text":"never en',
        "open": '{"Drawers":[' + good + "]",
        "close": '{"Drawers":[' + good + "]}}",
        "empty": "",
        "odd": '{"drawers":[null,3,"x",[{"Id":"no"}],' + good + ',{"Text":"t"},{"Id":"c",}]}',
        "list": "[" + good + "]",
        "blank": "  \n",
    }
    for name, content in files.items():
        (tmp_path / f"{name}.json").write_text(content)
    got = read_collections(spark, str(tmp_path), block_bytes=16).collect()
    by_file = {name: sorted((r["status"], r["id"] or "", (r["reason"] or "").split(":")[0]) for r in got if r["path"].endswith(f"/{name}.json")) for name in files}
    read = ("read", "a", "")
    assert by_file == {
        "cut": [read, ("rejected", "", "ends inside a string")],
        "open": [read, ("rejected", "", "ends inside a bracket")],
        "close": [read, ("rejected", "", "closes more brackets than it opens")],
        "empty": [],
        "odd": [read, ("rejected", "", "no Id"), ("rejected", "", "no valid JSON")],
        "list": [],
        "blank": [],
    }
    row = next(r for r in got if r["id"] == "a")
    assert (row["text"], row["wing"], row["source_mtime"], row["chunk_index"], row["hall"]) == ("5", "", None, 0, None)
    plain = read_json_collection(spark, str(tmp_path / "odd.json"))
    assert plain.columns == DRAWER_SCHEMA.names and plain.count() == 1


def test_no_file_reads_as_no_rows(spark, tmp_path):
    assert read_collections(spark, str(tmp_path / "missing.json")).count() == 0


def test_documents_of_one_block_are_not_read_for_their_sections(spark, tmp_path, monkeypatch):
    def refuse(batches):
        for batch in batches:
            assert batch.num_rows == 0, "a file was read for its sections"
            yield batch

    for n in range(3):
        (tmp_path / f"{n}.json").write_text(json.dumps({"Drawers": [{"Id": str(n), "Text": "t"}]}))
    monkeypatch.setattr(json_collections, "_sections", refuse)
    got = json_collections.read_collections(spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["status"]) for r in got) == [(str(n), "read") for n in range(3)]
