from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairnlake.functions.params import CLEANUP_THRESHOLD
from cairnlake.operators import layers, migration, mutations, rooms, sessions
from cairnlake.plans import ingest
from cairnlake.schema import DRAWER_SCHEMA
from cairnlake.sources import config, files
from cairnlake.sources.store import Collections, read_json_collection
from cairnlake.streaming import incremental, journal, save_trigger

NOW = "2024-03-01T12:00:00"


def write(root: Path, tree: dict[str, str]) -> Path:
    for name, content in tree.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content, encoding="utf-8")
    return root


TREE = {
    ".gitignore": "# comment\n*.log\nbuild-out/\n!keep.log\n/docs/**/secret.md\ngenerated?.py\n\\#odd.txt\n",
    "backend/auth.py": "auth " * 20,
    "backend/debug.log": "x",
    "backend/generated1.py": "x",
    "docs/a/b/secret.md": "s",
    "docs/architecture.md": "d",
    "build-out/x.py": "x",
    "sub/.gitignore": "*.md\n!ok.md\n",
    "sub/no.md": "x",
    "sub/ok.md": "x",
    "sub/deep/no.md": "x",
    "node_modules/y.js": "x",
    "pkg.egg-info/z.txt": "x",
    "image.png": "x",
    "package-lock.json": "{}",
    "#odd.txt": "x",
}


def scanned(spark, root, **options):
    return sorted(r["path"] for r in files.scan_project(spark, str(root), **options).select("path").collect())


def test_project_scan_respects_ignore_files(spark, tmp_path):
    write(tmp_path, TREE)
    assert scanned(spark, tmp_path) == ["backend/auth.py", "docs/architecture.md", "sub/ok.md"]
    everything = scanned(spark, tmp_path, respect_ignore=False)
    assert "build-out/x.py" in everything and "sub/no.md" in everything and "node_modules/y.js" not in everything
    forced = scanned(spark, tmp_path, force_included=["sub/deep", "image.png", "node_modules/y.js"])
    assert {"sub/deep/no.md", "image.png", "node_modules/y.js"} <= set(forced) and "sub/no.md" not in forced


def test_conversation_files(spark):
    names = ["a.txt", "b.meta.json", "memory/c.md", "d.JSONL", "e.py", "tool-results/f.txt"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    assert sorted(r["path"] for r in files.conversation_files(df).collect()) == ["a.txt", "d.JSONL"]


CORPUS = {
    "backend/auth.py": "The auth module issues JWT tokens and checks them on every request.",
    "docs/architecture.md": "Architecture overview: services talk over queues and share one schema.",
    "frontend/app.tsx": "export function App renders the dashboard and loads state from the api.",
    "notes/roadmap.md": "Roadmap for the next sprint: passkeys, search ranking and billing pages.",
    "notes/tiny.md": "too short",
}
ROOMS = [
    rooms.Room("backend", ("api", "auth")),
    rooms.Room("frontend", ("ui", "app")),
    rooms.Room("planning", ("roadmap", "notes")),
    rooms.Room("documentation", ("docs",)),
]


def test_project_mining_is_incremental(spark, tmp_path):
    root = write(tmp_path / "corpus", CORPUS)

    def listing():
        listed = files.scan_project(spark, str(root))
        texts = files.read_contents(str(root), listed)
        return texts.select("path", F.col("absolute_path").alias("source_file"), F.col("mtime").alias("source_mtime"), "content")

    made = ingest.project_drawers(listing(), "product", ROOMS, "miner", NOW)
    assert {r["room"] for r in made.collect()} == {"backend", "documentation", "frontend", "planning"}
    totals = ingest.run_totals(listing(), made).first()
    assert (totals["files"], totals["processed"], totals["skipped"], totals["drawers"]) == (5, 4, 1, 4)
    store = Collections(spark)
    name = "mined_corpus"
    store.add(name, made)
    store.add(name, made)
    assert store.read(name).count() == 4
    pending = ingest.pending_files(store.read(name), listing())
    assert {(Path(r["source_file"]).name, r["state"]) for r in pending.collect()} == {("tiny.md", "new")}
    changed = root / "backend/auth.py"
    changed.write_text("Rewritten auth module with passkeys instead of JWT tokens, much longer now.")
    import os

    os.utime(changed, (2_000_000_000, 2_000_000_000))
    pending = ingest.pending_files(store.read(name), listing())
    stale = pending.where("state = 'stale'")
    assert [Path(r["source_file"]).name for r in stale.collect()] == ["auth.py"]
    after = ingest.refreshed(store.read(name), stale, ingest.project_drawers(stale, "product", ROOMS, "miner", NOW))
    texts = [r["text"] for r in after.collect()]
    assert len(texts) == 4 and any(t.startswith("Rewritten") for t in texts)


def test_store_changes(spark):
    store = Collections(spark)
    rows = [(f"id{i}", f"text {i}", "w" if i % 2 else "v", "r", f"s{i}.md", 0, "me") for i in range(6)]
    df = spark.createDataFrame(rows, "id string, text string, wing string, room string, source_file string, chunk_index int, added_by string")
    store.add("changes", df)
    assert store.exists("changes") and "changes" in store.list() and store.read("missing").count() == 0
    store.delete("changes", spark.createDataFrame([("id1",)], "id string"))
    store.delete_sources("changes", spark.createDataFrame([("S2.MD",)], "source_file string"))
    store.upsert("changes", df.where("id = 'id3'").withColumn("text", F.lit("new")))
    store.repair("changes")
    assert {r["id"]: r["text"] for r in store.read("changes").collect()} == {"id0": "text 0", "id3": "new", "id4": "text 4", "id5": "text 5"}
    assert store.read("changes").columns == DRAWER_SCHEMA.fieldNames()


def test_json_collection(spark, tmp_path):
    document = {
        "Name": "drawers",
        "Drawers": [
            {"Id": "a", "Text": "t", "Metadata": {"Wing": "w", "Room": "r", "SourceFile": "", "SourceMtimeUtcMs": 5, "ChunkIndex": 1, "AddedBy": "x", "Hall": "", "Importance": 2.5}},
        ],
    }
    path = tmp_path / "drawers.json"
    path.write_text(json.dumps(document, indent=2))
    row = read_json_collection(spark, str(path)).first()
    assert (row["id"], row["source_mtime"], row["hall"], row["importance"], row["source_file"]) == ("a", 5, None, 2.5, "")


def test_conversation_mining(spark):
    content = "\n".join(
        json.dumps({"type": k, "message": {"content": t}})
        for k, t in [("user", "How does the database deploy work?"), ("assistant", "The server runs a deploy script."), ("user", "And tests for the api?"), ("assistant", "They run on every git push."), ("user", "Why did we choose this?"), ("assistant", "We decided because of the approach.")]
    )
    df = spark.createDataFrame([("c.jsonl", "/c.jsonl", content)], "path string, source_file string, content string")
    made = ingest.conversation_drawers(df, "chat", "miner", NOW).orderBy("chunk_index").collect()
    assert [r["room"] for r in made] == ["technical"] * 3 and made[0]["text"].startswith("> How does")
    assert {r["extract_mode"] for r in made} == {"exchange"}
    general = ingest.conversation_drawers(df, "chat", "miner", NOW, "general").collect()
    assert {r["room"] for r in general} == {"decision"}
    assert {r["room"]: r["n"] for r in ingest.room_totals(ingest.conversation_drawers(df, "chat", "m", NOW)).collect()} == {"technical": 1}


def test_memory_mining_judges_the_mood_by_given_lists(spark):
    content = "\n".join(f"> We hit a kor again and again number {n}\nThe tal is over there, lum lum." for n in range(3))
    df = spark.createDataFrame([("c.txt", "/c.txt", content)], "path string, source_file string, content string")
    lists = {"markers": {"problem": ["kor", "lum"], "milestone": ["tal"], "emotional": ["zzz"]}, "positive": ["tal"], "negative": []}
    made = ingest.conversation_drawers(df, "chat", "miner", NOW, "general", **lists).collect()
    assert {r["room"] for r in made} == {"milestone"}


def story_table(spark, rows):
    return spark.createDataFrame(rows, "id string, wing string, room string, source_file string, text string, importance double, emotional_weight double, weight double")


def test_essential_story(spark):
    rows = [("hero", "p", "backend", "x/hero.txt", "hero\ntext", 100.0, None, None)]
    rows += [(f"e{i:02}", "p", "misc", f"e{i}.txt", f"extra snippet {i}", float(i), None, None) for i in range(20)]
    text = layers.render_story(story_table(spark, rows)).first()["rendered"]
    assert text.startswith("## L1 - ESSENTIAL STORY\n\n[backend]\n  - hero text  (hero.txt)")
    assert "extra snippet 0 " not in text and "extra snippet 19" in text
    fallback = [("a", "p", "r", "", "nine", 9.0, 1.0, 1.0), ("b", "p", "r", "", "seven", None, None, 7.0), ("c", "p", "r", "", "six", None, 6.0, 99.0), ("d", "p", "r", "", "three", None, None, None)]
    assert [r["score"] for r in layers.story_rows(story_table(spark, fallback)).orderBy("id").collect()] == [9.0, 7.0, 6.0, 3.0]


def test_story_stops_at_the_budget(spark):
    rows = [(f"i{i:02}", "p", f"room{i:02}", "s.md", "x" * 400, None, None, None) for i in range(15)]
    text = layers.render_story(story_table(spark, rows)).first()["rendered"]
    lines, used = ["## L1 - ESSENTIAL STORY"], 0
    for i in range(15):
        lines.append(f"\n[room{i:02}]")
        used += len(lines[-1])
        entry = "  - " + "x" * 197 + "...  (s.md)"
        if used + len(entry) > 3200:
            lines.append("  ... (more in L3 search)")
            break
        lines.append(entry)
        used += len(entry)
    assert text == "\n".join(lines)
    assert layers.render_story(story_table(spark, rows[:0])).first()["rendered"] == "## L1 - No memories yet."


def test_recall_and_diary(spark):
    rows = [(f"i{i}", "p", "r", "a/s.md", "t" * 400, None, None, None) for i in range(4)]
    got = layers.recall(story_table(spark, rows), "p", "r", 2).collect()
    assert [r["id"] for r in got] == ["i0", "i1"] and got[0]["total"] == 4
    assert got[0]["entry"] == "  [r] " + "t" * 297 + "...  (s.md)"
    requests = spark.createDataFrame([("Night Owl", None, "first entry"), ("Night Owl", "Bug Hunt", "second"), ("Other", None, "x")], "agent string, topic string, entry string")
    entries = mutations.diary_entries(requests, NOW)
    read = layers.diary_read(entries, "night owl").collect()
    assert {(r["topic"], r["content"], r["total"]) for r in read} == {("general", "first entry", 2), ("bug_hunt", "second", 2)}
    assert layers.identity(None).startswith("## L0") and layers.identity(" me ") == "me"


def test_migration(spark):
    embeddings = spark.createDataFrame([(1, "d1"), (2, "d2")], "id int, embedding_id string")
    cells = spark.createDataFrame(
        [
            (1, migration.DOCUMENT_KEY, "text", None, None, None),
            (1, "wing", "w", None, None, None),
            (1, "chunk_index", None, None, 3.9, None),
            (1, "source_mtime", "77", None, None, None),
            (1, "weight", "abc", None, None, None),
            (1, "importance", None, 4, None, None),
            (1, "topic", None, None, None, 1),
            (2, "wing", "w", None, None, None),
        ],
        "id int, key string, string_value string, int_value long, float_value double, bool_value int",
    )
    rows = migration.drawers_from_cells(embeddings, cells).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row["id"], row["chunk_index"], row["source_mtime"], row["weight"], row["importance"], row["topic"], row["room"]) == ("d1", 3, 77, None, 4.0, "True", "")
    assert migration.source_version(["id", "schema_str"], []) == "1.x"
    assert migration.source_version(["id"], ["embeddings_queue"]) == "0.6.x"
    assert migration.source_version(["id"], []) == "unknown"


def test_turn_pairs_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(sessions, "TURN_BLOCK", 2)
    turns = [("c", i, "user" if i % 3 else "assistant", f"t{i}") for i in range(9)]
    df = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string")
    got = {r["turn"]: r["answer"] for r in sessions.turn_pairs(df).collect()}
    assert got == {1: None, 2: "t3", 4: None, 5: "t6", 7: None, 8: None}


def test_save_trigger_stream_matches_batch(spark, tmp_path):
    source, checkpoint = tmp_path / "in", tmp_path / "cp"
    rows = [("a", i) for i in range(33)] + [("b", i) for i in range(14)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], "session string, n int").coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema("session string, n int").option("maxFilesPerTrigger", 1).json(str(source))
    query = (
        save_trigger.save_triggers(stream, 15)
        .writeStream.format("memory").queryName("due").outputMode("append").option("checkpointLocation", str(checkpoint)).start()
    )
    query.processAllAvailable()
    query.stop()
    got = sorted((r["session"], r["messages"]) for r in spark.table("due").collect())
    events = spark.createDataFrame(rows, "session string, n int")
    batch = sessions.save_triggers(events, ["session"], ["n"], F.floor(F.col("n") / 4))
    assert got == sorted((r["session"], r["messages"]) for r in batch.collect()) == [("a", 15), ("a", 30)]


def test_journal_stream(spark, tmp_path):
    entries = spark.createDataFrame([(NOW, "add", p, "d", "w", "r") for p in ("intent", "success", "intent")], journal.JOURNAL_SCHEMA)
    journal.append_journal(entries, str(tmp_path / "log"))
    query = (
        journal.phase_counts(journal.read_journal(spark, str(tmp_path / "log")))
        .writeStream.format("memory").queryName("phases").outputMode("complete").start()
    )
    query.processAllAvailable()
    query.stop()
    assert {r["phase"]: r["n"] for r in spark.table("phases").collect()} == {"intent": 2, "success": 1}


def test_streamed_files_are_mined_once(spark, tmp_path):
    source = tmp_path / "files"
    rows = [("notes/a.md", "/n/a.md", 1, "A note about the roadmap that is long enough to be kept as a drawer.")]
    schema = "path string, source_file string, source_mtime long, content string"
    spark.createDataFrame(rows, schema).write.json(str(source))
    store = Collections(spark)

    def mine(batch):
        return ingest.project_drawers(batch, "w", ROOMS, "miner", NOW)

    seen = []
    for i in range(2):
        stream = spark.readStream.schema(schema).json(str(source))
        query = incremental.follow(
            stream, store, "followed", mine, str(tmp_path / f"cp{i}"), report=lambda number, totals: seen.append((number, totals))
        )
        query.awaitTermination()
        assert store.read("followed").count() == 1
    assert seen == [(0, {"files": 1, "processed": 1, "skipped": 0, "drawers": 1}), (0, incremental.IDLE)]


def test_a_mining_run_is_counted_while_it_is_written(spark, tmp_path):
    long_note = "A paragraph of the plan that is repeated until it fills more than one drawer. " * 40
    rows = [("a.md", "/a.md", 1, long_note), ("b.md", "/b.md", 1, "too short"), ("c.md", "/c.md", 1, long_note[:200])]
    listed = spark.createDataFrame(rows, "path string, source_file string, source_mtime long, content string")
    counts = ingest.RunCounts()
    made = counts.drawers(ingest.project_drawers(counts.files(listed), "w", ROOMS, "miner", NOW))
    made.write.parquet(str(tmp_path / "made"))
    written = spark.read.parquet(str(tmp_path / "made"))
    exact = ingest.run_totals(listed, written).first().asDict()
    assert exact["drawers"] > 2
    assert counts.totals() == exact


def test_a_run_over_no_files_counts_nothing(spark, tmp_path):
    listed = spark.createDataFrame([], "path string, source_file string, source_mtime long, content string")
    counts = ingest.RunCounts()
    counts.drawers(ingest.project_drawers(counts.files(listed), "w", ROOMS, "miner", NOW)).write.parquet(str(tmp_path / "none"))
    assert counts.totals() == incremental.IDLE


def test_configuration(tmp_path):
    (tmp_path / "config.json").write_text('﻿{"store": "s", "unknown": 1, "respect_ignore": true}', encoding="utf-8")
    loaded = config.load_settings(tmp_path / "config.json", {"CAIRNLAKE_RESPECT_IGNORE": "off"})
    assert loaded.store == "s" and loaded.respect_ignore is False
    (tmp_path / "bad.json").write_text("{")
    assert config.load_settings(tmp_path / "bad.json", {}) == config.Settings()
    (tmp_path / "project.yaml").write_text("wing: product\nrooms:\n  - name: backend\n    keywords: [api, ' ']\n")
    assert config.load_project(tmp_path / "project.yaml") == ("product", [rooms.Room("backend", ("api",))])
    (tmp_path / "names.json").write_text('{"names": ["Riley", 3]}')
    assert config.load_known_names(tmp_path / "names.json") == ["riley"]
    assert CLEANUP_THRESHOLD == pytest.approx(0.85)
