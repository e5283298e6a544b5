from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairnlake.operators import duplicates, knowledge, mutations, roomgraph, search, taxonomy, vectors

DRAWERS = [
    ("drawer_proj_backend_aaa", "project", "backend", "auth.py", "The authentication module uses JWT tokens for session management."),
    ("drawer_proj_backend_bbb", "project", "backend", "db.py", "Database migrations are handled by Alembic with a ChromaDB cache."),
    ("drawer_proj_frontend_ccc", "project", "frontend", "App.tsx", "The React frontend uses TanStack Query for server state."),
    ("drawer_notes_planning_ddd", "notes", "planning", "sprint.md", "Sprint planning: migrate auth to passkeys, evaluate ChromaDB."),
]


@pytest.fixture(scope="module")
def drawers(spark):
    return spark.createDataFrame(DRAWERS, "id string, wing string, room string, source_file string, text string")


def test_search_goldens(drawers):
    def hits(query, **scope):
        rows = search.search_memories(drawers, query, **scope).collect()
        return [(r["source_file"], r["similarity"]) for r in rows]

    assert hits("JWT authentication")[0] == ("auth.py", 1.0)
    assert hits("ChromaDB", wing="notes") == [("sprint.md", 1.0)]
    assert hits("authentication database", room="backend") == [("auth.py", 0.5), ("db.py", 0.5)]
    assert len(hits("!!!")) == 4
    assert hits("nowhere") == []


def test_needle_is_found_first(spark):
    rows = [(f"id{i:02}", "w", "r", f"file-{i}", f"filler text number {i}" + (" quantum needle" if i == 42 else "")) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, wing string, room string, source_file string, text string")
    assert search.lexical_search(df, "quantum needle text", 5).first()["source_file"] == "file-42"


def test_status_goldens(drawers):
    rows = {(r["kind"], r["key"]): (r["n"], r["truncated"]) for r in taxonomy.status(drawers, limit=2).collect()}
    assert rows[("total", "all")] == (4, False)
    assert rows[("wing", "project")] == (3, False)
    assert rows[("room", "backend")] == (2, True)
    assert ("room", "planning") not in rows


def brute_pairs(queries, stored, threshold):
    out = set()
    for qid, q in queries:
        tokens = set(q.split())
        for did, text in stored:
            if tokens and len(tokens & set(text.split())) / len(tokens) >= threshold:
                out.add((qid, did))
    return out


@pytest.mark.parametrize("threshold", [0.05, 0.5, 0.67, 0.9, 1.0])
def test_containment_join_equals_brute_force(spark, threshold):
    rng = random.Random(7)
    words = ["the"] * 12 + [f"w{i}" for i in range(40)]
    stored = [(f"d{i}", " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(80)]
    queries = [(f"q{i}", " ".join(rng.choices(words, k=rng.randint(1, 9)))) for i in range(30)] + [("none", "")]
    got = search.containment_join(
        spark.createDataFrame(queries, "query_id string, query string"), spark.createDataFrame(stored, "id string, text string"), threshold, salts=3
    ).collect()
    assert {(r["query_id"], r["id"]) for r in got} == brute_pairs(queries, stored, threshold)
    assert len(got) == len({(r["query_id"], r["id"]) for r in got})


def greedy(rows, threshold, minimum):
    def cosine(a, b):
        a, b = Counter(a.lower().split()), Counter(b.lower().split())
        dot = sum(n * b[t] for t, n in a.items())
        norm = math.sqrt(sum(n * n for n in a.values())) * math.sqrt(sum(n * n for n in b.values()))
        return dot / norm if norm else 0.0

    kept_ids = set()
    for source in {r[2] for r in rows}:
        group = sorted((r for r in rows if r[2] == source), key=lambda r: (-len(r[1]), r[0]))
        if len(group) < minimum:
            continue
        kept = []
        for row in group:
            if len(row[1].strip()) < 20:
                continue
            if any(cosine(k[1], row[1]) >= threshold for k in kept[:5]):
                continue
            kept.append(row)
        kept_ids |= {r[0] for r in kept}
    return kept_ids


def test_greedy_cleanup_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(12)]
    rows = []
    for i in range(160):
        source = "hot" if i % 3 else f"s{i % 5}"
        text = " ".join(rng.choices(words, k=rng.randint(1, 14)))
        rows.append((f"id{i:03}", text, source))
    df = spark.createDataFrame(rows, "id string, text string, source_file string")
    for threshold in (0.5, 0.7, 0.95):
        decided = duplicates.greedy_cleanup(df, threshold, 5, salt_rows=3).collect()
        assert {r["id"] for r in decided if r["kept"]} == greedy(rows, threshold, 5)
        large = {s for s, n in Counter(r[2] for r in rows).items() if n >= 5}
        assert {r["id"] for r in decided} == {r[0] for r in rows if r[2] in large}


def test_near_identical_rows_are_reduced_to_one(spark):
    text = "the build pipeline uses cached layers and signed artifacts, run"
    rows = [(f"{w}{i}", f"{text} {i}", f"{w}.md", w) for w in ("alpha", "beta") for i in range(5)]
    df = spark.createDataFrame(rows, "id string, text string, source_file string, wing string")
    scope = duplicates.cleanup_scope(df, wing="alpha")
    result = duplicates.cleanup_result(duplicates.greedy_cleanup(scope)).collect()
    assert [(r["source_file"], r["kept"], r["deleted"]) for r in result] == [("alpha.md", 1, 4)]


def test_dedup_estimates_round_half_even(spark):
    rows = [(f"i{i}", "t", "big.md") for i in range(25)] + [(f"j{i}", "t", "small.md") for i in range(20)]
    df = spark.createDataFrame(rows, "id string, text string, source_file string")
    row = duplicates.cleanup_stats(df).first()
    assert (row["total_drawers"], row["source_groups"], row["drawers_in_groups"], row["estimated_duplicates"]) == (45, 2, 45, 10)


def test_room_graph_goldens(spark):
    rows = [
        ("1", "project", "backend", "hall_facts", "2024-01-01"),
        ("2", "notes", "backend", "hall_facts", "2024-01-03"),
        ("3", "project", "frontend", None, ""),
        ("4", "project", "general", "hall_facts", None),
    ]
    df = spark.createDataFrame(rows, "id string, wing string, room string, hall string, date string")
    nodes = roomgraph.room_nodes(df)
    got = {r["room"]: r for r in nodes.collect()}
    assert set(got) == {"backend", "frontend"}
    assert got["backend"]["wings"] == ["notes", "project"] and got["backend"]["dates"] == ["2024-01-01", "2024-01-03"]
    assert got["frontend"]["halls"] == [] and got["frontend"]["dates"] == []
    edges = roomgraph.room_edges(nodes).collect()
    assert [(e["room"], e["wing_a"], e["wing_b"], e["hall"], e["n"]) for e in edges] == [("backend", "notes", "project", "hall_facts", 2)]
    stats = roomgraph.graph_stats(nodes).first()
    assert (stats["total_rooms"], stats["tunnel_rooms"], stats["total_edges"]) == (2, 1, 1)
    assert {r["wing"]: r["rooms"] for r in roomgraph.rooms_per_wing(nodes).collect()} == {"project": 2, "notes": 1}
    assert roomgraph.find_tunnels(nodes, "notes").first()["recent"] == "2024-01-03"
    assert roomgraph.traverse(nodes, "missing").count() == 0
    assert [r["room"] for r in roomgraph.suggest_rooms(nodes, "back-office").collect()] == ["backend"]


def bfs(nodes, start, hops):
    order = sorted(nodes, key=lambda r: nodes[r]["first"])
    visited, queue, out = {start}, [(start, 0)], {start: (0, [])}
    while queue:
        room, depth = queue.pop(0)
        if depth >= hops:
            continue
        for other in order:
            shared = sorted(nodes[room]["wings"] & nodes[other]["wings"])
            if other not in visited and shared:
                visited.add(other)
                out[other] = (depth + 1, shared)
                queue.append((other, depth + 1))
    return out


def test_traverse_equals_queue_walk(spark):
    rng = random.Random(11)
    rows = [(f"id{i:03}", f"w{rng.randint(0, 14)}", f"room{rng.randint(0, 24)}", None, None) for i in range(45)]
    df = spark.createDataFrame(rows, "id string, wing string, room string, hall string, date string")
    nodes = {}
    for did, wing, room, *_ in rows:
        node = nodes.setdefault(room, {"wings": set(), "first": did})
        node["wings"].add(wing)
        node["first"] = min(node["first"], did)
    for start in ("room0", "room5"):
        got = roomgraph.traverse(roomgraph.room_nodes(df), start, 4).collect()
        want = bfs(nodes, start, 4)
        assert {r["room"]: (r["hop"], r["connected_via"] or []) for r in got} == want


KG = [
    ("Alice", "parent_of", "Max", "2015-04-01", None),
    ("Max", "does", "swimming", "2025-01-01", None),
    ("Max", "does", "chess", "2024-06-01", None),
    ("Alice", "works_at", "Acme Corp", "2020-01-01", "2024-12-31"),
    ("Alice", "works_at", "NewCo", "2025-01-01", None),
]


@pytest.fixture(scope="module")
def kg(spark):
    facts = spark.createDataFrame(
        [(s.lower(), p, o.lower().replace(" ", "_"), a, b, 1.0, s, o) for s, p, o, a, b in KG],
        "subject string, predicate string, object string, valid_from string, valid_to string, confidence double, subject_name string, object_name string",
    )
    empty = spark.createDataFrame([], "id string, name string, type string")
    return facts, knowledge.add_missing_endpoints(empty, facts)


def test_knowledge_graph_goldens(kg):
    assert knowledge.query_entity(*kg, "Alice").count() == 3
    at = lambda day: [r["object"] for r in knowledge.query_entity(*kg, "Alice", as_of=day).where("predicate = 'works_at'").collect()]
    assert at("2024-06-01") == ["Acme Corp"] and at("2025-06-01") == ["NewCo"]
    assert at("2024-12-31") == ["Acme Corp"]
    assert [r["predicate"] + ":" + r["object"] for r in knowledge.timeline(*kg, "Max").collect()] == ["parent_of:Max", "does:chess", "does:swimming"]
    row = knowledge.stats(*kg).first()
    assert (row["entities"], row["triples"], row["current_facts"], row["expired_facts"]) == (6, 5, 4, 1)
    assert row["relationship_types"] == ["does", "parent_of", "works_at"]
    assert knowledge.query_entity(*kg, "Max", direction="both").count() == 3
    assert knowledge.query_entity(*kg, "Max", direction="sideways").count() == 0
    assert knowledge.query_relationship(*kg, "Works At", "2021-01-01").first()["object"] == "Acme Corp"


def test_timeline_is_capped_at_a_hundred(spark, kg):
    facts = spark.createDataFrame(
        [("alice", f"p{i}", "max", f"2020-01-{i % 28 + 1:02}", None, 1.0, "Alice", "Max") for i in range(105)], kg[0].schema
    )
    assert knowledge.timeline(facts, kg[1]).count() == 100


def test_adding_and_closing_facts(spark, kg):
    facts = spark.createDataFrame(
        [("ALICE", "Works At", "newco", "2026-01-01", 1), ("Alice", "works at", "Acme Corp", "2026-02-01", 2), ("Alice", "works at", "Acme Corp", "2026-03-01", 3)],
        "subject_name string, predicate string, object_name string, valid_from string, ord int",
    )
    added = knowledge.add_triples(kg[0], facts).collect()
    assert [(r["object"], r["valid_from"]) for r in added] == [("acme_corp", "2026-02-01")]
    ended = spark.createDataFrame([("alice", "works_at", "NEWCO", "2025-12-31")], "subject_name string, predicate string, object_name string, ended string")
    closed = knowledge.invalidate(kg[0], ended).where("object = 'newco'").first()
    assert closed["valid_to"] == "2025-12-31"
    requests = spark.createDataFrame(
        [("kg_invalidate", "Alice", "works_at", "newco"), ("kg_add", "Alice", "works_at", "NewCo"), ("kg_invalidate", "Alice", "works_at", "Acme Corp")],
        "operation string, subject_name string, predicate string, object_name string",
    )
    loose = {(r["operation"], r["object_name"]): r["phase"] for r in knowledge.change_outcomes(*kg, requests).collect()}
    assert loose == {("kg_invalidate", "newco"): "success", ("kg_add", "NewCo"): "noop", ("kg_invalidate", "Acme Corp"): "noop"}
    strict = {(r["operation"], r["object_name"]): r["reason"] for r in knowledge.change_outcomes(*kg, requests, True).collect()}
    assert strict[("kg_invalidate", "newco")] == "already_invalidated"


def test_entity_upsert_replaces_the_row(spark, kg):
    incoming = spark.createDataFrame([("ALICE", "person", 1), ("Alice B", "person", 2), ("alice", "boss", 3)], "name string, type string, ord int")
    rows = {r["id"]: (r["name"], r["type"]) for r in knowledge.upsert_entities(kg[1], incoming).collect()}
    assert rows["alice"] == ("alice", "boss") and rows["alice_b"] == ("Alice B", "person") and len(rows) == 7


def test_vector_operators_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, f"w{i % 3}", [rng.uniform(-1, 1) for _ in range(8)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, wing string, embedding array<float>").repartition(5)
    stored = {r["id"]: r["embedding"] for r in df.collect()}

    def nearest(query, k, ids):
        return sorted(ids, key=lambda i: (sum((a - b) ** 2 for a, b in zip(query, stored[i])), i))[:k]

    query = [0.1] * 8
    assert [r["id"] for r in vectors.vector_search(df, query, 7).collect()] == nearest(query, 7, stored)
    only = [i for i, w, _ in rows if w == "w1"]
    assert [r["id"] for r in vectors.vector_search(df, query, 4, "w1").collect()] == nearest(query, 4, only)
    asked = df.select(F.col("id").alias("query_id"), "embedding")
    for block_rows in (17, 1000):
        got = vectors.knn_join(asked, df, 3, block_rows).orderBy("query_id", "place").collect()
        for qid in (0, 50, 119):
            assert [r["id"] for r in got if r["query_id"] == qid] == nearest(stored[qid], 3, stored)


def test_embedder_is_pluggable(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "")], "id long, text string")
    hashed = {r["id"]: r["embedding"] for r in vectors.embed(df, dimensions=16).collect()}
    assert sum(x * x for x in hashed[1]) == pytest.approx(1.0, abs=1e-5) and set(hashed[2]) == {0.0}
    lengths = vectors.embed(df, encoder=lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert {r["id"]: list(r["embedding"]) for r in lengths.collect()} == {1: [3.0, 1.0], 2: [0.0, 1.0]}


def test_drawer_changes(spark, drawers):
    incoming = spark.createDataFrame([("x", "new"), (DRAWERS[0][0], "again"), ("x", "new")], "id string, text string")
    assert [r["id"] for r in mutations.new_drawers(drawers, incoming).collect()] == ["x"]
    ids = spark.createDataFrame([(DRAWERS[0][0],), ("nope",)], "id string")
    assert mutations.delete_ids(drawers, ids).count() == 3
    assert {r["id"]: r["outcome"] for r in mutations.delete_outcomes(drawers, ids).collect()} == {DRAWERS[0][0]: "success", "nope": "not_found"}
    sources = spark.createDataFrame([("AUTH.PY",)], "source_file string")
    assert mutations.delete_sources(drawers, sources).count() == 3
    assert mutations.delete_sources(drawers, sources, ignore_case=False).count() == 4


def test_file_states(spark):
    stored = spark.createDataFrame(
        [("a1", "/P/a", 10, "s"), ("a0", "/p/A", 11, "s"), ("b", "/p/b", None, "s"), ("c", "/p/c", 5, "old")],
        "id string, source_file string, source_mtime long, embedding_signature string",
    )
    files = spark.createDataFrame([("/p/a", 11, "s"), ("/p/b", 5, "s"), ("/p/c", 5, "s"), ("/p/d", 1, "s")], "source_file string, source_mtime long, embedding_signature string")
    states = {r["source_file"]: r["state"] for r in mutations.file_states(stored, files).collect()}
    assert states == {"/p/a": "current", "/p/b": "stale", "/p/c": "stale", "/p/d": "new"}
    assert {r["source_file"]: r["state"] for r in mutations.file_states(stored, files, by_time=False).collect()}["/p/b"] == "current"


def test_add_outcomes(spark):
    base = mutations.drawer_requests(
        spark.createDataFrame([("W", "R", "alpha beta gamma delta", "f.md", None)], "wing string, room string, content string, source_file string, added_by string")
    )
    asked = mutations.drawer_requests(
        spark.createDataFrame(
            [("w", "r", "alpha beta gamma delta ", "f.md", None), ("w", "other", "beta alpha", None, None), ("w", "r", "something else", None, None)],
            "wing string, room string, content string, source_file string, added_by string",
        )
    )
    outcomes = mutations.add_outcomes(base, asked)
    assert {(r["room"], r["outcome"]) for r in outcomes.collect()} == {("r", "noop"), ("other", "duplicate"), ("r", "inserted")}
    phases = Counter(r["phase"] for r in mutations.journal_entries(outcomes, "add_drawer", "now").collect())
    assert phases == {"intent": 3, "noop": 1, "duplicate": 1, "success": 1}


def test_long_contents_are_cleaned_once_per_request(spark):
    rows = [("w", "r", "x" * 200_001, None, None), ("w", "r", "\x00 ", "s", "a"), (" * ", "r", "x", "s" * 1025, "a"), ("w", "r", " x" * 100_000 + " ", "s", "a")]
    asked = spark.createDataFrame(rows, "wing string, room string, content string, source_file string, added_by string")
    judged = mutations.judged_requests(asked)
    reasons = ["content has more than 200000 characters", "content is missing", "wing has no usable characters", None]
    assert [r["reason"] for r in judged.collect()] == reasons
    plan = asked.select(mutations.request_problem().alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(content") == 1
