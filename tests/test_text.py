from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from cairnlake.functions import lexicons as lex
from cairnlake.functions import text as text_functions
from cairnlake.operators import (
    chunking,
    entities,
    extraction,
    registry,
    rooms,
    shorthand,
    spelling,
    splitting,
    transcripts,
)
from cairnlake.plans import text_catalog
from cairnlake.sources import files as file_source

CHATS = {
    "session.jsonl": "\n".join(
        [
            json.dumps({"type": "human", "message": {"content": "How should we store memory?"}}),
            "{broken",
            json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": "Use structured local storage."}, {"type": "tool"}]}}),
        ]
    ),
    "events.jsonl": "\n".join(
        [
            json.dumps({"type": "session_meta"}),
            json.dumps({"type": "event_msg", "payload": {"type": "user_message", "message": "What did we decide about auth?"}}),
            json.dumps({"type": "event_msg", "payload": {"type": "agent_message", "message": "We chose JWT tokens with refresh cookies."}}),
        ]
    ),
    "flat.json": json.dumps([{"role": "user", "content": "Hi"}, {"role": "assistant", "content": {"text": " Hello "}}]),
    "privacy.json": json.dumps([{"chat_messages": [{"role": "human", "content": "Hi"}]}, {"chat_messages": [{"role": "ai", "content": "Hello"}]}]),
    "tree.json": json.dumps(
        {
            "mapping": {
                "z": {"parent": None, "children": ["a"], "message": None},
                "a": {"parent": "z", "children": ["b", "x"], "message": {"author": {"role": "user"}, "content": {"parts": ["Why did we switch", "to passkeys?"]}}},
                "x": {"parent": "a", "children": [], "message": {"author": {"role": "assistant"}, "content": {"parts": ["ignored branch"]}}},
                "b": {"parent": "a", "children": ["z"], "message": {"author": {"role": "assistant"}, "content": {"parts": ["We wanted phishing-resistant login."]}}},
            }
        }
    ),
    "channel.json": json.dumps(
        [
            {"type": "message", "user": "U1", "text": "We should migrate the auth flow."},
            {"type": "message", "user": "U2", "text": "Passkeys are a good candidate."},
            {"type": "join", "user": "U3", "text": "x"},
            {"type": "message", "username": "U3", "text": "Lets document the tradeoffs."},
        ]
    ),
    "plain.txt": "just text",
}
TRANSCRIPTS = {
    "session.jsonl": "> How should we store memory?\nUse structured local storage.\n",
    "events.jsonl": "> What did we decide about auth?\nWe chose JWT tokens with refresh cookies.\n",
    "flat.json": "> Hi\nHello\n",
    "privacy.json": "> Hi\nHello\n",
    "tree.json": "> Why did we switch to passkeys?\nWe wanted phishing-resistant login.\n",
    "channel.json": "> We should migrate the auth flow.\nPasskeys are a good candidate.\n\n> Lets document the tradeoffs.\n",
    "plain.txt": "just text",
}


def test_every_chat_format_normalises(spark):
    df = spark.createDataFrame(list(CHATS.items()), "path string, content string")
    got = {r["path"]: r["transcript"] for r in transcripts.normalize(df).collect()}
    assert got == TRANSCRIPTS


def test_quoted_text_is_only_spellchecked(spark):
    text = "> lsresdy knoe Riley befor\nlsresdy knoe\n> pleese, chekc!\n  > I knoe"
    df = spark.createDataFrame([("a.md", text)], "path string, content string")
    assert transcripts.normalize(df).first()["transcript"] == "> already know Riley before\nlsresdy knoe\n> please, check!\n  > I know"


@pytest.mark.parametrize(
    "text, expected",
    [
        ("lsresdy knoe Riley befor", "already know Riley before"),
        ("kno cant Befor knoe2 befor-x `befor` BEFOR", "kno can't Befor knoe2 befor-x `befor` BEFOR"),
        ("a  befor.\tmeny", "a  before.\tmany"),
    ],
)
def test_spelling(value, text, expected):
    assert value(spelling.correct_text, text) == expected
    assert value(lambda c: spelling.correct_text(c, ["BEFOR", "meny"]), "befor meny") == "befor meny"


def test_human_messages_are_counted(spark):
    lines = [
        {"message": {"role": "user", "content": "hi"}},
        {"message": {"role": "user", "content": "<command-message>x"}},
        {"message": {"role": "user", "content": [{"text": "<command-message>"}]}},
        {"type": "event_msg", "payload": {"type": "user_message", "message": "yes"}},
        {"message": {"role": "assistant", "content": "no"}},
        [1, 2],
    ]
    rows = [("s", json.dumps(line)) for line in lines] + [("s", "{bad"), ("empty", "{}")]
    got = transcripts.count_human_messages(spark.createDataFrame(rows, "session string, line string")).collect()
    assert {r["session"]: r["human_messages"] for r in got} == {"s": 2, "empty": 0}


def test_exchange_chunks(value):
    text = "intro\n> first question here, quite long\nline one\n\nline two\n---\nafter rule\n> second question, also long enough\n> q3"
    assert value(chunking.exchange_chunks, text) == [
        "> first question here, quite long\nline one line two",
        "> second question, also long enough",
    ]
    replies = "\n".join(f"reply {i}" for i in range(12))
    chunks = value(chunking.exchange_chunks, f"> a\n{replies}\n> b\n> c")
    assert chunks == ["> a\n" + " ".join(f"reply {i}" for i in range(8))]


def test_paragraph_chunks(value):
    long = "This paragraph is certainly longer than thirty characters."
    assert value(chunking.exchange_chunks, f"{long}\n\n\n{long}\n\nshort") == [long, long]
    lines = "\n".join(f"line number {i}" for i in range(30))
    chunks = value(chunking.exchange_chunks, lines)
    assert [len(c.split("\n")) for c in chunks] == [25, 5]
    assert value(chunking.exchange_chunks, "  \n ") == []


def test_text_chunks_cover_the_text(spark):
    paragraph = "Sentence about storage layers and their trade-offs, repeated."
    text = "\n\n".join(f"{paragraph} {i} {'x' * 15}" for i in range(4))
    df = spark.createDataFrame([(1, text), (2, "tiny"), (3, None)], "id int, text string")
    rows = chunking.chunk_text(df, size=120, overlap=20, minimum=20).orderBy("id", "chunk_index").collect()
    assert len(rows) >= 2 and [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert {r["id"] for r in rows} == {1}
    assert all(len(r["content"]) <= 120 for r in rows)
    plain = spark.createDataFrame([(1, "a" * 2000)], "id int, text string")
    assert [len(r["content"]) for r in chunking.chunk_text(plain).orderBy("chunk_index").collect()] == [800, 800, 600]


def memories(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return [(r["memory_type"], r["content"]) for r in extraction.extract_memories(df).orderBy("chunk_index").collect()]


def test_extraction_goldens(spark):
    def kinds(text):
        return [kind for kind, _ in memories(spark, text)]

    assert kinds("We decided to go with SQLite because the architecture is simple.") == ["decision"]
    assert kinds("The bug kept failing and we had an issue, but we fixed it and solved the crash. It works now.") == ["milestone"]
    code = "```python\nimport os\nwe decided because\n```\nI prefer functional style. Please always use snake_case."
    assert kinds(code) == ["preference"]
    assert kinds("I feel proud and grateful, this is beautiful and amazing.") == ["emotional"]
    assert kinds("The bug keeps failing with an error and the root cause is unknown.") == ["problem"]
    assert kinds("nothing of note in here at all") == []
    turns = "> should we use SQLite\nWe decided on SQLite because of the approach.\n> and the crash\nuser: x\nThere is a bug, the error keeps failing, not working."
    assert memories(spark, turns)[0][0] == "decision"
    assert [k for k, _ in memories(spark, turns)][-1] == "problem"


def test_prose_filter(value):
    text = "keep this line\n```\ncode()\n```\n$ ls\nimport os\n{\n12345678901234\nand this"
    assert value(extraction.prose, text) == "keep this line\nand this"
    assert value(extraction.prose, "```\nonly code") == "```\nonly code"


def test_conversation_rooms(value):
    assert value(rooms.conversation_room, "The roadmap and sprint backlog") == "planning"
    assert value(rooms.conversation_room, "A bug in the design") == "technical"
    assert value(rooms.conversation_room, "hello") == "general"


def test_project_rooms(spark):
    config = [rooms.Room("backend", ("api", "auth")), rooms.Room("frontend", ("ui",)), rooms.Room("planning", ("roadmap", "sprint"))]
    cases = {
        "src/api/main.py": "backend",
        "lib/planning.md": "planning",
        "misc/file.txt": "planning",
        "other/none.txt": "general",
        ".md": "backend",
    }
    contents = {"misc/file.txt": "sprint roadmap sprint auth"}
    df = spark.createDataFrame([(p, contents.get(p, "zzz")) for p in cases], "path string, content string")
    got = df.select("path", rooms.project_room(F.col("path"), F.col("content"), config).alias("room")).collect()
    assert {r["path"]: r["room"] for r in got} == cases


def test_room_proposals(spark):
    paths = ["api/x.py", "src/docs/y.md", "My-App/z.py", "node_modules/q/w.js", "ui/t.js", "top.md", "src/ab/c.md"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = [r["room"] for r in rooms.rooms_from_folders(df).collect()]
    assert got == ["src", "backend", "frontend", "documentation", "my_app"]
    names = spark.createDataFrame([("a/test-plan.md",), ("b/test_notes.md",), ("c/notes.md",)], "path string")
    # 'notes' is a key of documentation, 'test' of testing.
    assert [(r["room"], r["n"]) for r in rooms.rooms_from_file_names(names).collect()] == [("documentation", 2), ("testing", 2)]


def session(mark, extra=12):
    return [f"{lex.SESSION_MARK}{mark}"] + [f"line {i}" for i in range(extra)]


def test_session_split(spark):
    lines = session(1)[:8] + session(2) + ["8:30 AM Monday, March 30, 2026", "> git status", "> Fix the login flow, please!", "Ask RILEY", "/home/dev/x"]
    lines = ["before"] + session(1, 10) + session(2, 10) + lines[-5:] + session(3, 3) + ["ctrl+e to show"]
    df = spark.createDataFrame([("in/my log.txt", "\n".join(lines) + "\n"), ("one.txt", "\n".join(session(1)))], "path string, content string")
    rows = splitting.split_sessions(df, usernames={"dev": "Devon"}).orderBy("number").collect()
    assert [(r["path"], r["number"], r["sessions_found"]) for r in rows] == [("in/my log.txt", 1, 2), ("in/my log.txt", 2, 2)]
    assert rows[0]["file_name"] == "my_log_part01_unknown_session.txt"
    assert rows[1]["file_name"] == "my_log_2026-03-30_830AM_Devon-Riley_Fix-the-login-flow-please.txt"
    assert rows[0]["line_count"] == 11


def test_resumed_headers_do_not_open_sessions(spark):
    lines = session(1, 7) + [f"{lex.SESSION_MARK}2", "Previous messages"] + session(3, 6)
    df = spark.createDataFrame([(lines,)], "lines array<string>")
    assert df.select(splitting.session_starts(F.col("lines"))).first()[0] == [0, 10]


def test_shorthand(spark, value):
    text = "Riley chose the architecture because the GraphQL api felt wrong. We met Jordan."
    out = value(lambda c: shorthand.compress_text(c, entities={"Riley": "RIL"}), text)
    assert out.startswith("0:RIL|") and "DECISION+TECHNICAL" in out and "architecture" in out
    plain = value(shorthand.compress_text, "ok")
    assert plain == "0:???|misc"
    assert value(shorthand.entity_codes, "Met Jordan and Sam-uel there. The End") == ["JOR", "SAM", "END"]
    assert value(shorthand.topics, "alpha beta Beta gamma_x alpha") == ["beta", "gamma_x", "alpha"]
    assert value(shorthand.key_sentence, 'Short one here. We decided on "it" because of reasons!') == 'We decided on "it" because of reasons'
    assert shorthand.assign_codes(["Riley", "Rilke", "Ril", "Sam"]) == {"Riley": "RIL", "Rilke": "RILK", "Ril": "RIL3", "Sam": "SAM"}
    df = spark.createDataFrame([("i", "", "", "", None, "x")], "id string, wing string, room string, source_file string, date string, text string")
    assert shorthand.compress(df).first()["compressed"] == "0:???|misc"


STORY = """Riley said we should ship Riley-core. Then Riley asked her about it.
Hey Riley, thanks Riley! Riley decided.
> Riley: yes
Riley: I think they agree.
MemBank v2 is ready. We deployed MemBank. import MemBank
MemBank.py and MemBank-local exist, the MemBank pipeline works.
Ada Lovelace said hi Ada Lovelace. She wrote. Ada Lovelace told him.
Ada Lovelace asked. Berlin Berlin Berlin
Vivian vivianv2 Vivian-x Vivian
"""


def reference_scores(name, text):
    """The rule as written: every template with the name put in."""
    quoted = re.escape(name)

    def hits(template, flags=re.I | re.M):
        return len(re.findall(template.replace("{name}", quoted), text, flags))

    person = 3 * sum(map(hits, lex.DIALOGUE_SLOTS)) + 2 * sum(map(hits, lex.ACTION_SLOTS)) + 4 * sum(map(hits, lex.ADDRESS_SLOTS))
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if name.lower() in line.lower():
            frame = " ".join(lines[max(0, i - 2) : max(0, i - 2) + 5])
            person += 2 * bool(re.search(lex.PRONOUNS, frame, re.I))
    project = 2 * sum(map(hits, lex.PROJECT_SLOTS)) + 3 * hits(lex.VERSION_SLOTS[0]) + 3 * hits(lex.CODE_FILE_SLOTS[0])
    return person, project


def test_name_scores_equal_the_per_name_rule(spark):
    df = spark.createDataFrame([("a", STORY), ("b", "Nothing Here")], "id string, text string")
    rows = {r["name"]: r for r in entities.detect_names(df).collect()}
    assert {"Riley", "MemBank", "Ada Lovelace", "Berlin", "Vivian"} <= set(rows)
    for name, row in rows.items():
        assert (row["person_score"], row["project_score"]) == reference_scores(name, STORY), name
    assert rows["Riley"]["type"] == "person" and rows["Riley"]["signals"][0].startswith("dialogue marker")
    assert rows["MemBank"]["type"] == "project" and rows["MemBank"]["confidence"] > 0.7
    # Three action signals are one kind of evidence.
    assert rows["Ada Lovelace"]["type"] == "uncertain"
    plain = entities.detect_names(spark.createDataFrame([("c", "Zork Zork Zork")], "id string, text string")).first()
    assert (plain["type"], plain["confidence"]) == ("uncertain", 0.06)


def test_corpus_names_sum_over_texts(spark):
    texts = [f"note {i}: Quillon said he would come." for i in range(4)] + ["building Voxtar. Import Voxtar and install Voxtar"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r["name"]: r for r in entities.detect_corpus_names(df).collect()}
    assert (found["Quillon"]["frequency"], found["Quillon"]["type"]) == (4, "person")
    assert found["Voxtar"]["type"] == "project"
    single = entities.detect_names(df.selectExpr("uuid() AS id", "text"))
    assert "Quillon" not in {r["name"] for r in single.collect()}
    assert {r["name"] for r in entities.people_and_projects(entities.detect_corpus_names(df)).collect()} == {"Quillon", "Voxtar"}
    one = entities.detect_corpus_names(df, caps={"person": 0, "project": 1, "uncertain": 0}).collect()
    assert [r["name"] for r in one] == ["Voxtar"]


def test_long_runs_of_capitalised_words_are_one_name(spark):
    # A pattern that takes a stack frame per word ends the executor here.
    run = " ".join(f"Zor{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(20_000))
    rows = [(run + ".",), ("Ada Lovelace BarBaz. Foo BarBaz Qux",), ("Foo Bar\tBaz\u00e9 Qux_ FooBar\u00e9",)]
    texts = spark.createDataFrame(rows, "text string")
    found = {r["name"]: r["frequency"] for r in entities.detect_corpus_names(texts, minimum=1).collect()}
    assert found[run] == 1 and found["Zoraa"] == 30
    assert {name for name in found if "Zor" not in name} == {"Ada Lovelace", "Ada", "Lovelace", "BarBaz", "Foo", "Qux", "Foo Bar", "Bar"}


def test_letters_that_fold_to_plain_ones_count_for_phrases(spark):
    text = "Ada Lovelace ſaid. hİ Ada Lovelace. BUıLDING Ada Lovelace, WROTE"
    texts = spark.createDataFrame([("odd", text), ("none", "Ada Lovelace and Ada Lovelace")], "id string, text string")
    found = {(r["id"], r["name"]): r for r in entities.score_names(texts, minimum=2).collect()}
    assert (found["odd", "Ada Lovelace"]["person_score"], found["odd", "Ada Lovelace"]["project_score"]) == (8, 2)
    assert found["none", "Ada Lovelace"]["person_score"] == 0


def test_names_are_not_capped_by_default(spark):
    text = " ".join(f"Name{chr(97 + a)}{chr(97 + b)} " * 3 for a in range(4) for b in range(10))
    text = text.replace("Name", "Zor")
    df = spark.createDataFrame([("t", text)], "id string, text string")
    assert entities.detect_names(df).count() == 40


def test_stopwords_are_complete():
    assert len(lex.NAME_STOPWORDS) == len(set(lex.NAME_STOPWORDS)) > 260


def test_long_conversations_come_in_parts(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(25)] + [(2, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    parts = transcripts.conversation_messages(df, part_turns=10).orderBy("conv_id", "part").collect()
    assert [(r["conv_id"], r["part"], len(r["messages"])) for r in parts] == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 1)]
    assert [m["text"] for r in parts[:3] for m in r["messages"]] == [f"m{t}" for t in range(25)]


def test_long_conversations_are_mined_whole(spark, monkeypatch):
    turns = 10_001
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"message number {t} of {c}, long enough to be kept") for c in (0, 1, 2, 4) for t in range(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    gathered = transcripts.conversation_messages(df).collect()
    assert sorted((r["conv_id"], r["part"]) for r in gathered) == [(c, 0) for c in (0, 1, 2, 4)]
    assert all([m["text"] for m in r["messages"]] == [x[3] for x in rows if x[0] == r["conv_id"]] for r in gathered)
    monkeypatch.setattr(text_catalog.src, "messages", lambda *_: df)
    made = text_catalog.QUERIES["mine_conversations"](spark, "").collect()
    assert len({r["id"] for r in made}) == len(made) >= 4 * turns // 2
    assert len({(r["source_file"], r["room"]) for r in made}) == 4
    for path in {r["source_file"] for r in made}:
        assert sorted(r["chunk_index"] for r in made if r["source_file"] == path) == list(range(sum(r["source_file"] == path for r in made)))
    assert not any(r["text"].startswith(("{", "[")) for r in made)
    shown = text_catalog.QUERIES["transcript_render"](spark, "").collect()
    assert len(shown) == 4 and all(r["transcript"].count("\n> ") == turns // 2 for r in shown)


def test_oversized_files_are_reported(spark):
    df = spark.createDataFrame([("a.txt", "short"), ("b.txt", "long " * 100)], "path string, content string")
    rows = {r["path"]: r for r in transcripts.normalize(df, max_bytes=100).collect()}
    assert (rows["a.txt"]["status"], rows["a.txt"]["transcript"], rows["a.txt"]["reason"]) == ("read", "short", None)
    assert (rows["b.txt"]["status"], rows["b.txt"]["transcript"]) == ("rejected", None)
    assert "500 bytes" in rows["b.txt"]["reason"]
    listed = spark.createDataFrame([("x/a.md", 10), ("x/b.md", 11 << 20)], "path string, size long")
    assert [r["path"] for r in file_source.rejected_files(listed).collect()] == ["x/b.md"]
    assert [r["path"] for r in file_source.project_files(listed).collect()] == ["x/a.md"]


def test_candidates_skip_camel_case_on_request(spark):
    df = spark.createDataFrame([("MemBank MemBank MemBank",)], "text string")
    assert entities.candidate_counts(df, camel_case=False).count() == 0
    assert entities.candidate_counts(df).first()["frequency"] == 3


def test_files_for_detection(spark):
    paths = spark.createDataFrame([("README.md",), ("notes/a.md",), ("src/x.py",), ("obj/b.txt",)], "path string")
    got = [r["path"] for r in entities.files_for_detection(paths, prioritize=True).collect()]
    assert got == ["README.md", "notes/a.md", "obj/b.txt"]
    few = spark.createDataFrame([("b.py",), ("a.md",), ("c.bin",)], "path string")
    assert [r["path"] for r in entities.files_for_detection(few).collect()] == ["a.md", "b.py"]


@pytest.fixture(scope="module")
def people(spark):
    given = spark.createDataFrame([(0, "Riley", "daughter", "personal"), (1, "Max", "son", "personal"), (2, "Grace", "", "work"), (3, " ", "", "work")], "ord int, name string, relationship string, context string")
    aliases = spark.createDataFrame([("Ry", "riley")], "alias string, name string")
    return registry.seed_people(given, aliases)


def test_registry(spark, people):
    assert {(r["name"], r["canonical"]) for r in people.collect()} == {("Riley", None), ("Ry", "Riley"), ("Max", None), ("Grace", None)}
    ambiguous = registry.ambiguous_words(people)
    assert {r["word"] for r in ambiguous.collect()} == {"max", "grace"}
    projects = spark.createDataFrame([(0, "Atlas")], "ord int, name string")
    research = spark.createDataFrame([("Oslo", "place", 0.8, True), ("Hope", "person", 0.9, True), ("Zed", "concept", 0.6, False)], "word string, type string, confidence double, confirmed boolean")
    words = spark.createDataFrame(
        [("riley", 1), ("RY", 1), ("Max", 1), ("Grace", 2), ("atlas", 1), ("Oslo", 1), ("Hope", 3), ("Zed", 1), ("Max", 4)], "word string, context_id int"
    )
    contexts = spark.createDataFrame([(1, "Max said hello with Max"), (2, "have you grace of the day"), (3, "if you hope"), (4, " ")], "context_id int, context string")
    got = {(r["word"], r["context_id"]): (r["type"], round(r["confidence"], 2), r["source"], r["name"]) for r in registry.lookup(words, people, projects, research, ambiguous, contexts).collect()}
    assert got[("riley", 1)] == ("person", 1.0, "onboarding", "Riley")
    assert got[("RY", 1)] == ("person", 1.0, "onboarding", "Riley")
    assert got[("Max", 1)] == ("person", 0.95, "onboarding", "Max")
    assert got[("Max", 4)] == ("person", 1.0, "onboarding", "Max")
    assert got[("Grace", 2)][:3] == ("concept", 0.9, "context_disambiguated")
    assert got[("atlas", 1)] == ("project", 1.0, "onboarding", "Atlas")
    assert got[("Oslo", 1)][:3] == ("place", 0.8, "wiki")
    assert got[("Hope", 3)][0] == "concept"
    assert got[("Zed", 1)] == ("unknown", 0.0, "none", "Zed")
    queries = spark.createDataFrame([("q", "Did Max said to Ry that Grace of Oslo saw Zora and Atlas?")], "query_id string, query string")
    found = registry.people_in_queries(queries, people, ambiguous).orderBy("ord").collect()
    assert [r["name"] for r in found if r["name"] != "Ry"] == ["Riley", "Max"]
    unknown = {r["word"] for r in registry.unknown_words(queries, people, projects, research).collect()}
    assert unknown == {"Did", "Zora"}
    assert registry.summary(people, projects, ambiguous, research).first()["people"] == 4
    confirmed = registry.confirm_research(research, spark.createDataFrame([("zed", "person"), ("New", "place")], "word string, type string"))
    rows = {r["word"]: (r["type"], r["confidence"], r["confirmed"]) for r in confirmed.collect()}
    assert rows["Zed"] == ("person", 0.6, True) and rows["New"] == ("place", 0.8, True)
    assert {r["name"]: r["confidence"] for r in registry.confirmed_people(confirmed).collect()} == {"Hope": 0.9, "Zed": 0.9}


def test_payload_classes(spark):
    rows = [
        ("Qxz", 404, None, None, None, None, "person", 0.70),
        ("Err", 500, None, None, None, None, "unknown", 0.0),
        ("Rose", 200, "disambiguation", "Rose", "Rose may be", "given name", "person", 0.65),
        ("Bat", 200, "disambiguation", "", "Bat may be", "animals", "ambiguous", 0.40),
        ("Aoife", 200, "standard", "Aoife", "Aoife, an Irish name", "", "person", 0.80),
        ("Finn", 200, "standard", "Finn", "Finn is a masculine name", "", "person", 0.90),
        ("Oslo", 200, "standard", "Oslo", "Oslo is the capital of Norway", "", "place", 0.80),
        ("Monad", 200, "standard", "Monad", "A structure", "", "concept", 0.60),
    ]
    df = spark.createDataFrame(rows, "word string, status int, kind string, title string, extract string, description string, type string, confidence double")
    p = registry.classify_payload(*[F.col(c) for c in ("word", "status", "kind", "title", "extract", "description")])
    for r in df.select("*", p.alias("p")).collect():
        assert (r["p"]["type"], r["p"]["confidence"]) == (r["type"], r["confidence"]), r["word"]


def test_required_literals_hold_in_every_match():
    import random
    import re

    from cairnlake.functions.text import required_literals

    cases = [marker for markers in lex.MEMORY_MARKERS.values() for marker in markers]
    cases += ["ab?c", "ab+c", "a{2}b", "(a|b)?cd", "(a?|b)cd", "a|bc", "a|", "(a|)b", "[ab]c|[^c]d", r"a\.c", "(?i)Ab", "(?:ab)+c*", "ab{0,2}", "(ab|c(?=d))x", r"\x61b"]
    pick = random.Random(7)
    for pattern in cases:
        parts = required_literals(pattern)
        words = [text for texts in parts for text in texts] + ["it ", "the ", "1.5", "x ", "a", "b", "c", "d", "*", "ab", "s", "'", "to", "is", "was", "v2"]
        for _ in range(300):
            text = "".join(pick.choice(words) + pick.choice(["", "", " "]) for _ in range(pick.randint(1, 8)))
            if re.search(pattern, text):
                assert all(any(part in text for part in texts) for texts in parts), (pattern, text)
    assert required_literals(r"\bdon'?t (ever )?(use|do)\b") == [["don"], ["t "], ["use", "do"]]
    assert required_literals("(?i)foo") == [] == required_literals(r"\Qa\E")


def test_marker_scores_of_guarded_patterns(spark):
    rows = [("we decided: fixed, fixed v2.1 and 3x faster * * i'm sorry",), ("nothing",), (None,), ("wedecided unfixed",)]
    scores = spark.createDataFrame(rows, "t string").select(extraction.memory_scores(F.col("t")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in scores] == [(1, 0, 4, 0, 3), (0, 0, 0, 0, 0), (None,) * 5, (0, 0, 0, 0, 0)]


def test_names_leave_their_row_without_its_text(spark):
    found = entities.score_names(spark.range(1).select("id", F.lit("Ada said. Ada said. Ada said.").alias("text")).where("id > -1"))

    def generates(node):
        kept = [node.requiredChildOutput().mkString(",")] if node.nodeName() == "Generate" else []
        children = node.children()
        return kept + [k for n in range(children.size()) for k in generates(children.apply(n))]

    carried = generates(found._jdf.queryExecution().optimizedPlan())
    assert carried and all("_text" not in kept and "_slots" not in kept for kept in carried)


def test_context_patterns_are_compiled_only_near_their_spellings(spark):
    # The name ends its quotation and opens a group, so every pattern that is compiled fails.
    rows = spark.createDataFrame([(r"x\E(", "nothing of x here, said the lake")], "word string, context string")
    assert rows.select(registry.disambiguate(F.col("word"), F.col("context")).alias("v")).first()["v"] is None


def test_context_scores_equal_the_bare_patterns(spark):
    texts = [
        "max\tsaid", "Max  told it", "maxx said", "max saidx", "drop  off\nmax", "dropped max", "dropoff max", "max's", "maxs'", "max' s",
        "well\nmax: yes", "well max: yes", "my\n\ncolleague  max", "my cousin max", "the max of", "max of", "climax in", "max", "", "with max is",
    ]
    rows = spark.createDataFrame([(text.lower(),) for text in texts], "t string")
    flat = text_functions.flat_text(F.col("t"))
    scores = registry.context_scores(F.lit("max"), F.col("t"), flat)

    def bare(templates):
        return sum((F.rlike("t", F.lit("(?Umd)" + template.replace("{name}", r"\Qmax\E"))).cast("int") for template in templates), F.lit(0))

    got = rows.select("t", *[s.alias(n) for s, n in zip(scores, "pc")], bare(lex.PERSON_CONTEXTS).alias("bp"), bare(lex.CONCEPT_CONTEXTS).alias("bc")).collect()
    assert [(r["t"], r["p"], r["c"]) for r in got] == [(r["t"], r["bp"], r["bc"]) for r in got]
    assert sum(r["p"] for r in got) > 8 and sum(r["c"] for r in got) > 1
    spelled = [text_functions.spellings(side) for t in lex.PERSON_CONTEXTS + lex.CONCEPT_CONTEXTS for side in t.split("{name}")]
    assert None not in spelled and text_functions.spellings(r"a\w") is None


def test_words_of_a_lookup_are_made_once(spark, people):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    words = spark.createDataFrame([("Max", 1), ("Oslo", 1), ("Grace", 2)], "word string, context_id int")
    projects = spark.createDataFrame([], "ord int, name string")
    research = spark.createDataFrame([], "word string, type string, confidence double, confirmed boolean")
    contexts = spark.createDataFrame([(1, "Max said"), (2, "")], "context_id int, context string")
    counted = words.mapInArrow(count, words.schema)
    found = registry.lookup(counted, people, projects, research, registry.ambiguous_words(people), contexts)
    assert {(r["word"], r["type"]) for r in found.collect()} == {("Max", "person"), ("Oslo", "unknown"), ("Grace", "person")}
    assert made.value == 3


def test_words_that_are_no_names_are_not_shuffled(spark, people):
    queries = spark.createDataFrame([("q", "Max said so to Grace of York")], "query_id string, query string")
    met = []
    keep = registry.cut_lineage
    registry.cut_lineage = lambda df: met.append(df) or keep(df)
    try:
        found = registry.people_in_queries(queries, people, registry.ambiguous_words(people)).collect()
    finally:
        registry.cut_lineage = keep
    assert [r["name"] for r in found] == ["Max"]
    assert "BroadcastHashJoin" in met[0]._jdf.queryExecution().executedPlan().toString()


def test_closing_word_reads_as_its_pattern(spark):
    texts = ["One two.", "One two. \n", "a.b.", "été.", "two", "two. x", ".", "", "x_1 .", None, "tail. ", "end. "]
    rows = spark.createDataFrame([(text,) for text in texts], "text string")
    got = rows.select(text_catalog._closing_word(F.col("text")).alias("w"), F.regexp_extract("text", r"(?<!\w)(\w++)\.\s*$", 1).alias("p")).collect()
    assert [r["w"] or "" for r in got] == [r["p"] or "" for r in got]
