"""Named queries of the text operators, registered into the catalog.

The prose of the tables is synthetic, so where a lexicon decides the result a query passes
its own word lists; the ``*_default`` queries run the built-in lexicons over the same
texts with a phrase of the lexicons put behind each.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.functions import lexicons as lex
from cairnlake.functions import text as tx
from cairnlake.functions.partitions import explode_rows
from cairnlake.operators import (
    chunking,
    entities,
    extraction,
    layers,
    migration,
    mutations,
    registry,
    rooms,
    sessions,
    shorthand,
    spelling,
    splitting,
    taxonomy,
    transcripts,
)
from cairnlake.plans import ingest, migrate
from cairnlake.plans.catalog import QUERIES, WING, joined, query
from cairnlake.schema import DRAWER_SCHEMA
from cairnlake.session import shared_folder
from cairnlake.sources import files as file_source
from cairnlake.sources import json_collections
from cairnlake.sources import tables as src
from cairnlake.sources.versions import VersionedTable
from cairnlake.streaming.journal import phase_counts

NOW = "2024-03-01T12:00:00"
SMALL_FILE_BYTES = 2_000
MARKERS = {
    "decision": [r"\bthe\b", r"\band\b"],
    "preference": [r"\bla\b", r"\bde\b"],
    "milestone": [r"\bund\b", r"\bder\b", r"\bto\b"],
    "problem": [r"\bof\b", r"\ben\b"],
    "emotional": [r"\bthat\b", r"\ble\b"],
}
POSITIVE = ["the", "la", "und", "with", "para"]
NEGATIVE = ["of", "de", "der", "by", "en", "in"]
TOPICS = {
    "articles": ["the ", "la ", "der ", "los "],
    "particles": ["tion", "ing", "ción", "eau", "ung"],
    "links": [" and ", " et ", " und ", " y "],
}
CORRECTIONS = {"that": "which", "dans": "hors", "para": "por", "with": "without", "nicht": "nie", "ou": "or"}
KNOWN_NAMES = ["with"]
ROOMS = [
    rooms.Room("spanish", ("es", "ción")),
    rooms.Room("french", ("fr", "eau")),
    rooms.Room("numbers", ("src1", "0")),
    rooms.Room("joiners", ("and", "und")),
]
FOLDERS = {"en": "english", "fr": "french", "es": "spanish", "tag": "labels"}
SESSION_MARK = "Re"
COMMON = ["the", "that", "with", "this", "and"]
PLANTED = [
    "We decided to go with the new framework because the trade-off is better.",
    "I prefer tabs and never use spaces, please always use snake_case instead of camelCase.",
    "It works! We finally figured it out, fixed the build and shipped version 2.",
    "The bug is a crash: the root cause was a broken config and it keeps failing.",
    "I feel so happy and proud, I love you and I'm sorry, it was wonderful.",
    "The fix was simple, the problem is resolved and patched, what a relief.",
    "Terrible failure, I am angry, worried and sad about the awful mess.",
    "The database schema and the api endpoint need a test before the deploy.",
]
SPOKEN = [
    "Riley said hello. Riley asked him why. Riley told them so.",
    "> Ada: well\nAda wrote it. She thanks Ada, hey Ada.",
    "building Zetabase and launching Zetabase. import Zetabase, see Zetabase.py",
    "Ada Lovelace smiled. Ada Lovelace decided. Ada Lovelace wants more",
    "Nothing named here.",
    "the Orbital pipeline, Orbital v2, Orbital-core; Orbital laughed at her",
]


def _planted(phrases: list[str]) -> Column:
    """The text of a document with one of the phrases behind it."""
    chosen = F.element_at(F.array(*map(F.lit, phrases)), (F.col("doc_id") % len(phrases) + 1).cast("int"))
    return F.concat("text", F.lit("\n\n"), chosen)


# --- scalar rules -----------------------------------------------------------


@query
def slugs(spark: SparkSession, folder: str) -> DataFrame:
    return src.table(spark, folder, "pages").select("page_id", tx.slug(F.concat(F.lit(" --"), "url", F.lit("__ "))).alias("slug"))


@query
def content_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.table(spark, folder, "documents")
    args = [F.col("lang"), F.lit("notes"), F.col("source"), F.col("text")]
    return docs.select(
        "doc_id",
        tx.content_id(*args).alias("drawer_id"),
        tx.mined_id(F.col("lang"), F.lit("notes"), F.col("source"), F.lit(3)).alias("mined_id"),
        tx.diary_id(tx.agent_wing(F.lit("Night Owl")), F.col("source"), F.col("text")).alias("diary_id"),
    )


@query
def entity_ids(spark: SparkSession, folder: str) -> DataFrame:
    part = src.table(spark, folder, "part")
    name = F.concat("p_name", F.lit(" O'Neil "), "p_type")
    return part.select("p_partkey", tx.entity_id(name).alias("entity_id"), tx.predicate_id(name).alias("predicate_id"), tx.wing_name(F.concat("p_type", F.lit("-X"))).alias("wing"))


@query
def iso_dates(spark: SparkSession, folder: str) -> DataFrame:
    orders = src.table(spark, folder, "orders")
    shape = F.when(F.col("o_orderpriority").startswith("1"), "yyyy-M-d").otherwise("yyyy-MM-dd")
    loose = F.when(shape == "yyyy-M-d", F.date_format("o_orderdate", "yyyy-M-d")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return orders.select("o_orderkey", F.coalesce(tx.iso_date(loose), F.lit("invalid")).alias("day"))


@query
def token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents")
    return docs.select("doc_id", tx.estimated_tokens(F.col("text")).alias("tokens"), F.size(tx.token_set(F.col("text"))).alias("distinct_tokens"))


@query
def spellcheck_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents")
    return docs.select("doc_id", spelling.correct_text(F.col("text"), KNOWN_NAMES, CORRECTIONS).alias("text"))


@query
def spellcheck_lines(spark: SparkSession, folder: str) -> DataFrame:
    quoted = F.concat(F.lit("  > "), F.replace("text", F.lit("\n"), F.lit("\n>")), F.lit("\nthat stays"))
    return src.table(spark, folder, "conversations").select(
        "conv_id", "turn", spelling.correct_transcript(quoted, (), CORRECTIONS).alias("text")
    )


# --- transcripts ------------------------------------------------------------


def _raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation as an export file; the format follows from the conversation number."""
    gathered = transcripts.conversation_messages(src.messages(spark, folder))
    m = F.col("messages")

    def json_lines(build) -> Column:
        return F.array_join(F.transform(m, lambda x: F.to_json(build(x))), "\n")

    def typed(x: Column) -> Column:
        return F.struct(x["role"].alias("type"), F.struct(x["text"].alias("content")).alias("message"))

    def event(x: Column) -> Column:
        kind = F.when(x["role"] == "user", "user_message").otherwise("agent_message")
        payload = F.struct(kind.alias("type"), x["text"].alias("message"))
        return F.struct(F.lit("event_msg").alias("type"), payload.alias("payload"))

    def part_list(x: Column) -> Column:
        part = F.struct(F.lit("text").alias("type"), x["text"].alias("text"))
        return F.struct(x["role"].alias("role"), F.array(part).alias("content"))

    def node(x: Column, i: Column) -> Column:
        body = F.struct(
            F.struct(x["role"].alias("role")).alias("author"),
            F.struct(F.array(x["text"]).alias("parts")).alias("content"),
        )
        parent = F.when(i == 0, F.lit("root")).otherwise(F.concat(F.lit("n"), (i - 1).cast("string")))
        after = F.when(i + 1 < F.size(m), F.array(F.concat(F.lit("n"), (i + 1).cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct(
            F.concat(F.lit("n"), i.cast("string")).alias("key"),
            F.struct(parent.alias("parent"), after.alias("children"), body.alias("message")).alias("value"),
        )

    root = F.lit('{"mapping":{"root":{"parent":null,"children":["n0"],"message":null},')
    tree = F.concat(root, F.substr(F.to_json(F.map_from_entries(F.transform(m, node))), F.lit(2)), F.lit("}"))
    channel = F.to_json(
        F.transform(m, lambda x: F.struct(F.lit("message").alias("type"), x["role"].alias("user"), x["text"].alias("text")))
    )
    kind = F.col("conv_id") % 5
    content = (
        F.when(kind == 0, json_lines(typed))
        .when(kind == 1, F.concat(F.lit('{"type":"session_meta"}\nnot json\n'), json_lines(event)))
        .when(kind == 2, F.concat(F.lit('{"chat_messages":'), F.to_json(F.transform(m, part_list)), F.lit("}")))
        .when(kind == 3, tree)
        .otherwise(channel)
    )
    path = F.concat(F.lit("chats/c"), F.col("conv_id").cast("string"), F.lit(".json"))
    return gathered.select("conv_id", path.alias("path"), path.alias("source_file"), content.alias("content"))


@query
def transcript_render(spark: SparkSession, folder: str) -> DataFrame:
    gathered = transcripts.conversation_messages(src.messages(spark, folder))
    return gathered.select("conv_id", transcripts.messages_to_transcript(F.col("messages")).alias("transcript"))


@query
def transcript_lines(spark: SparkSession, folder: str) -> DataFrame:
    return transcripts.transcript_lines(src.messages(spark, folder))


@query
def transcript_normalize(spark: SparkSession, folder: str) -> DataFrame:
    normal = transcripts.normalize(_raw_files(spark, folder))
    # A file with a single message has no transcript and passes unchanged.
    same = F.col("transcript") == F.col("content")
    return normal.select("conv_id", "status", F.when(~same, F.col("transcript")).otherwise("").alias("transcript"))


def _node(m: Column, x: Column, i: Column) -> Column:
    """One message as a node; every node has an answer beside it that is not on the first branch."""
    name = lambda place: F.concat(F.lit("n"), place.cast("string"))
    aside = F.concat(F.lit("x"), i.cast("string"))
    after = F.filter(F.array(F.when(i + 1 < F.size(m), name(i + 1)), aside), lambda key: key.isNotNull())
    said = F.struct(
        F.struct(x["role"].alias("role")).alias("author"), F.struct(F.array(F.lit(" "), x["text"]).alias("parts")).alias("content")
    )
    here = F.struct(F.when(i > 0, name(i - 1)).otherwise("root").alias("parent"), after.alias("children"), said.alias("message"))
    beside = F.struct(name(i).alias("parent"), F.array().cast("array<string>").alias("children"), said.alias("message"))
    return F.array(F.struct(name(i).alias("key"), here.alias("value")), F.struct(aside.alias("key"), beside.alias("value")))


@query
def transcript_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation as an export of nodes, last one first, with a side branch at every node."""
    gathered = transcripts.conversation_messages(src.messages(spark, folder))
    m = F.col("messages")
    nodes = F.reverse(F.flatten(F.transform(m, lambda x, i: _node(m, x, i))))
    root = F.lit('"root":{"parent":null,"children":["n0","x0"],"message":null}}}')
    body = F.to_json(F.map_from_entries(nodes))
    tree = F.concat(F.lit('{"mapping":'), F.substr(body, F.lit(1), F.length(body) - 1), F.lit(","), root)
    files = gathered.select("conv_id", F.concat(F.lit("t/"), F.col("conv_id"), F.lit(".json")).alias("path"), tree.alias("content"))
    normal = transcripts.normalize(files)
    # The side answer of the last message is its first child, and so the end of the branch.
    return normal.select("conv_id", F.coalesce("transcript", F.lit("")).alias("transcript"))


@query
def transcript_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Wrapped message lists, privacy exports and quoted text, by conversation."""
    gathered = transcripts.conversation_messages(src.messages(spark, folder))
    m = F.col("messages")
    flat = F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    sides = F.transform(
        m,
        lambda x: F.struct(
            F.array(
                F.struct(F.when(x["role"] == "user", "human").otherwise("ai").alias("role"), x["text"].alias("content"))
            ).alias("chat_messages")
        ),
    )
    quoted = F.concat(transcripts.messages_to_transcript(m), F.lit("\n> I knoe\nI knoe\n> You knoe\n> We knoe"))
    kind = F.col("conv_id") % 3
    content = (
        F.when(kind == 0, F.concat(F.lit('{"title":"x","messages":'), F.to_json(flat), F.lit("}")))
        .when(kind == 1, F.to_json(sides))
        .otherwise(quoted)
    )
    suffix = F.when(kind == 2, F.lit(".md")).otherwise(".json")
    files = gathered.select("conv_id", F.concat(F.lit("e/"), F.col("conv_id"), suffix).alias("path"), content.alias("content"))
    normal = transcripts.normalize(files)
    # A file with a single message has no transcript and passes unchanged.
    same = (F.col("transcript") == F.col("content")) & (kind != 2)
    return normal.select("conv_id", F.when(~same, F.col("transcript")).otherwise("").alias("transcript"))


@query
def turn_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.turn_pairs(src.messages(spark, folder)).withColumn("answer", F.coalesce("answer", F.lit("")))


@query
def hook_user_counts(spark: SparkSession, folder: str) -> DataFrame:
    turns = src.table(spark, folder, "conversations")
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<command-message>"), "text")).otherwise(F.col("text"))
    line = F.when(
        F.col("conv_id") % 2 == 0,
        F.to_json(F.struct(F.struct("role", text.alias("content")).alias("message"))),
    ).otherwise(
        F.to_json(
            F.struct(
                F.lit("event_msg").alias("type"),
                F.struct(F.concat("role", F.lit("_message")).alias("type"), text.alias("message")).alias("payload"),
            )
        )
    )
    broken = F.when(F.col("turn") == 7, F.lit("{broken")).otherwise(line)
    lines = turns.select(F.col("conv_id").alias("session"), broken.alias("line"))
    return transcripts.count_human_messages(lines)


@query
def save_triggers(spark: SparkSession, folder: str) -> DataFrame:
    events = src.table(spark, folder, "events").select("user_id", "ts", "event_id")
    due = sessions.save_triggers(events, ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts"))
    return due.select("user_id", "event_id", "messages")


# --- chunks and sessions ----------------------------------------------------


@query
def text_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents").select("doc_id", "text")
    return chunking.chunk_text(docs)


@query
def exchange_chunks(spark: SparkSession, folder: str) -> DataFrame:
    gathered = transcripts.conversation_messages(src.messages(spark, folder))
    texts = gathered.select("conv_id", transcripts.messages_to_transcript(F.col("messages")).alias("content_text"))
    return chunking.explode_chunks(texts, chunking.exchange_chunks(F.col("content_text"))).drop("content_text")


@query
def paragraph_chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents").select("doc_id", "text")
    return chunking.explode_chunks(docs, chunking.exchange_chunks(F.col("text"))).drop("text")


@query
def session_split(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents")
    path = F.concat(F.lit("in/doc "), F.col("doc_id").cast("string"), F.lit(".txt"))
    found = splitting.split_sessions(docs.select(path.alias("path"), F.col("text").alias("content")), SESSION_MARK, min_lines=4, people=[])
    return found.select("path", "sessions_found", "number", "line_count", "file_name", F.md5("content").alias("digest"))


@query
def session_people(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents")
    owned = F.concat(F.lit("C:/Users/"), "source", F.lit("/notes\n"), _planted(SPOKEN))
    people = splitting.session_people(tx.lines_of(owned), ["Riley", "Ada", "Max"], {"src1": "Owner", "src7": "Guest"})
    return docs.select("doc_id", joined(people).alias("people"))


# --- rooms and memories -----------------------------------------------------


@query
def conversation_rooms(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents")
    return docs.select("doc_id", rooms.conversation_room(F.col("text"), TOPICS).alias("room"))


def _project_path() -> Column:
    kind = F.col("doc_id") % 4
    return (
        F.when(kind == 0, F.concat(F.lit("Texts/"), "lang", F.lit("/"), "source", F.lit(".md")))
        .when(kind == 1, F.concat(F.lit("misc/"), "source", F.lit(".md")))
        .when(kind == 2, F.concat(F.lit("misc/joiners_"), "source", F.lit(".txt")))
        .otherwise(F.concat("source", F.lit(".txt")))
    )


@query
def project_rooms(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents")
    return docs.select("doc_id", rooms.project_room(_project_path(), F.col("text"), ROOMS).alias("room"))


@query
def memory_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents")
    return docs.select("doc_id", extraction.memory_scores(F.lower("text"), MARKERS).alias("score")).select("doc_id", "score.*")


@query
def memory_types(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents").select("doc_id", "text")
    return extraction.extract_memories(docs, markers=MARKERS, positive=POSITIVE, negative=NEGATIVE)


@query
def memory_scores_default(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents")
    return docs.select("doc_id", extraction.memory_scores(F.lower(_planted(PLANTED))).alias("score")).select("doc_id", "score.*")


@query
def memory_types_default(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents").select("doc_id", _planted(PLANTED).alias("text"))
    return extraction.extract_memories(docs)


@query
def sentiment_default(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents")
    return docs.select("doc_id", extraction.sentiment(_planted(PLANTED)).alias("sentiment"))


@query
def conversation_rooms_default(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents")
    return docs.select("doc_id", rooms.conversation_room(_planted(PLANTED)).alias("room"))


@query
def code_line_filter(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents")
    lines = tx.lines_of(F.col("text"))
    return docs.select("doc_id", F.size(F.filter(lines, extraction.is_code_line)).alias("code_lines"), F.length(extraction.prose(F.col("text"))).alias("prose_chars"))


@query
def sentiment(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents")
    return docs.select("doc_id", extraction.sentiment(F.col("text"), POSITIVE, NEGATIVE).alias("sentiment"))


def _url_paths(spark: SparkSession, folder: str) -> DataFrame:
    path = F.regexp_replace("url", r"^https?://[^/]*/|[?#].*$", "")
    return src.table(spark, folder, "pages").select(F.concat(F.regexp_extract("url", r"^https?://([a-z]+)", 1), F.lit("/"), path).alias("path"))


@query
def rooms_from_folders(spark: SparkSession, folder: str) -> DataFrame:
    return rooms.rooms_from_folders(_url_paths(spark, folder), FOLDERS)


@query
def rooms_from_folders_default(spark: SparkSession, folder: str) -> DataFrame:
    """Pages below the folders that the built-in table knows, one folder per page in turn."""
    names = sorted(lex.FOLDER_ROOMS)
    folder_of = F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % len(names) + 1).cast("int"))
    pages = src.table(spark, folder, "pages").select(F.concat(folder_of, F.lit("/page"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"))
    return rooms.rooms_from_folders(pages)


@query
def rooms_from_file_names(spark: SparkSession, folder: str) -> DataFrame:
    names = src.table(spark, folder, "documents").select(F.concat("lang", F.lit("-"), "source", F.lit(".md")).alias("path"))
    return rooms.rooms_from_file_names(names, {**FOLDERS, "src1": "ones", "src_": "never", "fr_src": "french"})


@query
def ignored_paths(spark: SparkSession, folder: str) -> DataFrame:
    paths = _url_paths(spark, folder).select(F.rtrim("path", F.lit("/")).alias("path")).distinct()
    text = "# drafts\nblog/\n!blog/en/\n*.html\n/m/**/4*\nfr/7?0\n"
    rules = paths.select(F.lit("").alias("folder"), F.lit(text).alias("content")).distinct().unionByName(
        paths.select(F.lit("m/en").alias("folder"), F.lit("!*.html\n").alias("content")).distinct()
    )
    return file_source.ignored_paths(paths, file_source.ignore_rules(rules))


# --- names and registry -----------------------------------------------------


@query
def entity_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return entities.candidate_counts(src.texts(spark, folder, "documents"))


@query
def pronoun_lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents")
    return docs.select("doc_id", F.size(entities.near_pronoun(tx.lines_of(F.col("text")))).alias("lines"))


@query
def detected_names(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    found = entities.detect_names(docs)
    return found.select("id", "name", "frequency", "person_score", "project_score", "type", "confidence", joined("signals").alias("signals"))


@query
def spoken_names(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents").select(F.col("doc_id").alias("id"), _planted(SPOKEN).alias("text"))
    found = entities.detect_names(docs)
    return found.select("id", "name", "frequency", "person_score", "project_score", "type", "confidence", joined("signals").alias("signals"))


def _corpus_names(spark: SparkSession, folder: str) -> DataFrame:
    return entities.detect_corpus_names(src.texts(spark, folder, "documents").select(_planted(SPOKEN).alias("text")))


@query
def corpus_names(spark: SparkSession, folder: str) -> DataFrame:
    found = _corpus_names(spark, folder)
    return found.select("name", "frequency", "person_score", "project_score", "type", "confidence", joined("signals").alias("signals"))


@query
def people_and_projects(spark: SparkSession, folder: str) -> DataFrame:
    return entities.people_and_projects(_corpus_names(spark, folder))


@query
def learned_people(spark: SparkSession, folder: str) -> DataFrame:
    people, projects, _, _ = _registry(spark, folder)
    return registry.learn_people(_corpus_names(spark, folder), people, projects).select("name", "confidence", "frequency")


@query
def detection_scores(spark: SparkSession, folder: str) -> DataFrame:
    listed = src.table(spark, folder, "pages").select(
        F.concat(F.lit("notes/"), F.regexp_replace("url", r"^https?://|[?#].*$", ""), F.lit("/tool_readme.md")).alias("path")
    ).distinct()
    return entities.files_for_detection(listed, max_files=10, prioritize=True)


def _closing_word(text: Column) -> Column:
    """The word before a full stop that only white space follows, read from the end; blank without one."""
    tail = F.substring_index(text, ".", -1)
    head = F.left(text, F.length(text) - F.length(tail) - 1)
    closed = (F.length(tail) < F.length(text)) & F.rlike(tail, F.lit(r"^\s*$"))
    return F.when(closed, F.reverse(F.regexp_extract(F.reverse(head), r"^\w+", 0))).otherwise("")


def _registry(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """People named by the first words of benchmark texts, projects by market segments, research by part types."""
    first = F.initcap(F.regexp_extract("text", r"^([A-Za-z]+)", 1))
    people = (
        src.table(spark, folder, "benchmark")
        .select("item_id", first.alias("name"))
        .where(F.col("name") != "")
        .groupBy("name")
        .agg(F.min("item_id").alias("ord"))
        .select("ord", "name", F.lit("friend").alias("relationship"), F.lit("work").alias("context"))
    )
    aliases = people.where(F.length("name") == 2).select(F.concat("name", F.lit("eth")).alias("alias"), "name")
    seeded = registry.seed_people(people, aliases)
    documents = src.texts(spark, folder, "documents")
    projects = documents.select(F.initcap(_closing_word(F.col("text"))).alias("name")).where(
        F.col("name").rlike("^[A-Z][a-z]+$")
    ).groupBy("name").agg(F.count("*").alias("ord"))
    research = documents.select(F.initcap(F.regexp_extract("text", r"^\w+ (\w+)", 1)).alias("word")).where(
        F.col("word").rlike("^[A-Z][a-z]+$")
    ).distinct().select(
        "word",
        F.when(F.length("word") % 2 == 0, "place").otherwise("person").alias("type"),
        (F.least(F.length("word"), F.lit(9)) / 10.0).alias("confidence"),
        (F.length("word") > 3).alias("confirmed"),
    )
    return seeded, projects, research, registry.ambiguous_words(seeded, COMMON)


@query
def registry_people(spark: SparkSession, folder: str) -> DataFrame:
    people = _registry(spark, folder)[0]
    return people.select("ord", "name", joined("aliases").alias("aliases"), F.coalesce("canonical", F.lit("")).alias("canonical"), "source", "confidence")


@query
def registry_lookup(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents")
    capitalized = F.regexp_extract_all("text", F.lit(r"(?U)[A-Z](?<=\b.)[a-z]{1,19}\b"), F.lit(0))
    words = explode_rows(docs, F.array_distinct(capitalized), "word", F.col("doc_id").alias("context_id"))
    contexts = docs.select(F.col("doc_id").alias("context_id"), F.col("text").alias("context"))
    found = registry.lookup(words, *_registry(spark, folder), contexts=contexts, common_words=COMMON)
    return found.select(F.col("context_id").alias("doc_id"), "word", "type", F.round("confidence", 4).alias("confidence"), "source", "name")


@query
def people_in_queries(spark: SparkSession, folder: str) -> DataFrame:
    people, _, _, ambiguous = _registry(spark, folder)
    asked = src.texts(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return registry.people_in_queries(asked, people, ambiguous)


@query
def unknown_words(spark: SparkSession, folder: str) -> DataFrame:
    people, projects, research, _ = _registry(spark, folder)
    asked = src.texts(spark, folder, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return registry.unknown_words(asked, people, projects, research, COMMON)


@query
def registry_summary(spark: SparkSession, folder: str) -> DataFrame:
    people, projects, research, ambiguous = _registry(spark, folder)
    return registry.summary(people, projects, ambiguous, research)


@query
def research_confirmed(spark: SparkSession, folder: str) -> DataFrame:
    people, _, research, _ = _registry(spark, folder)
    asked = people.select(F.col("name").alias("word"), F.lit("person").alias("type"))
    return registry.confirm_research(research, asked)


@query
def payload_types(spark: SparkSession, folder: str) -> DataFrame:
    pages = src.table(spark, folder, "pages")
    lang = F.regexp_extract("url", r"/(en|fr|de|es)/", 1)
    extract = F.concat(
        lang,
        F.when(lang == "fr", " is a given name. ").when(lang == "de", ", a City in the north. ").when(lang == "es", ": old Norse Name ").otherwise(" "),
        "html",
    )
    status = F.when(F.col("page_id") % 7 == 3, 404).when(F.col("page_id") % 7 == 5, 500).otherwise(200)
    kind = F.when(F.col("page_id") % 5 == 1, "Disambiguation").otherwise("standard")
    described = F.when(F.col("page_id") % 2 == 0, "Surname list").otherwise("Topics")
    payload = registry.classify_payload(lang, status, kind, F.lit(""), extract, described)
    return pages.select("page_id", payload.alias("p")).select(
        "page_id", "p.type", "p.confidence", F.coalesce("p.summary", F.lit("")).alias("summary"), F.coalesce("p.title", F.lit("")).alias("title"), F.coalesce("p.note", F.lit("")).alias("note")
    )


# --- shorthand --------------------------------------------------------------


@query
def shorthand_entities(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents")
    configured = shorthand.entity_codes(F.col("text"), {"Therin": "THR", "There": "TRE", "ander": "AND"}, ("rein",))
    return docs.select("doc_id", joined(shorthand.entity_codes(F.col("text"))).alias("codes"), joined(configured).alias("configured"))


@query
def shorthand_topics(spark: SparkSession, folder: str) -> DataFrame:
    return src.texts(spark, folder, "documents").select("doc_id", joined(shorthand.topics(F.col("text"))).alias("topics"))


@query
def shorthand_signals(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents")
    table = {"the": "ART", "tion": "NOM", "la ": "ART", "ción": "NOM", "und": "CON", "eau": "ROOT", "en ": "PRE"}
    return docs.select("doc_id", joined(shorthand.signals(F.col("text"), table)).alias("signals"))


@query
def shorthand_key_sentence(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents")
    return docs.select("doc_id", shorthand.key_sentence(F.col("text"), ["the", "tion", "ción", "eau", "und"]).alias("sentence"))


@query
def shorthand_compress(spark: SparkSession, folder: str) -> DataFrame:
    return shorthand.compress(src.drawers(spark, folder, heavy=True))


@query
def compression_totals(spark: SparkSession, folder: str) -> DataFrame:
    return shorthand.compression_totals(shorthand.compress(src.drawers(spark, folder, heavy=True)))


# --- layers -----------------------------------------------------------------


@query
def l1_story_rows(spark: SparkSession, folder: str) -> DataFrame:
    return layers.story_rows(src.drawers(spark, folder, labelled=True))


@query
def l1_story_budget(spark: SparkSession, folder: str) -> DataFrame:
    long_rooms = layers.story_rows(src.drawers(spark, folder, labelled=True)).withColumn("line", F.rpad("line", 300, "."))
    return layers.story_budget(long_rooms).select("id", "place", F.col("used").cast("long").alias("used"), "fits")


@query
def l1_story(spark: SparkSession, folder: str) -> DataFrame:
    return layers.render_story(src.drawers(spark, folder, labelled=True), WING)


@query
def l2_recall(spark: SparkSession, folder: str) -> DataFrame:
    return layers.recall(src.drawers(spark, folder), WING, limit=10)


def _diary(spark: SparkSession, folder: str) -> DataFrame:
    """One diary entry per conversation turn, written by the side that speaks."""
    turns = src.table(spark, folder, "conversations")
    requests = turns.select(
        F.concat(F.lit("Agent  "), "role").alias("agent"), F.concat(F.lit("Topic "), F.col("turn").cast("string")).alias("topic"), F.col("text").alias("entry")
    )
    return mutations.diary_entries(requests, NOW)


@query
def diary_write(spark: SparkSession, folder: str) -> DataFrame:
    return mutations.new_drawers(src.drawers(spark, folder), _diary(spark, folder)).select("id", "wing", "room", "hall", "topic", "type", "agent", "date")


@query
def diary_recent(spark: SparkSession, folder: str) -> DataFrame:
    entries = _diary(spark, folder).dropDuplicates(["id"]).withColumn("filed_at", F.concat(F.lit("2024-01-0"), F.substring("topic", 7, 1)))
    return layers.diary_read(entries, "Agent user", last_n=20)


@query
def stack_status(spark: SparkSession, folder: str) -> DataFrame:
    return layers.stack_status(src.drawers(spark, folder))


# --- changes ----------------------------------------------------------------


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark passages as new drawers, next to exact repeats of stored documents."""
    asked = src.table(spark, folder, "benchmark").select(
        F.lit("New Wing").alias("wing"), F.lit("Inbox/Bench").alias("room"), F.col("text").alias("content"), F.lit("bench.txt").alias("source_file")
    )
    repeats = src.table(spark, folder, "documents").select(
        F.col("lang").alias("wing"), F.lit("stored").alias("room"), F.col("text").alias("content"), F.col("source").alias("source_file")
    )
    both = asked.unionByName(repeats).withColumn("added_by", F.lit(None).cast("string"))
    return mutations.drawer_requests(both)


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """All documents under their content id."""
    docs = src.table(spark, folder, "documents").select(
        F.col("lang").alias("wing"), F.lit("stored").alias("room"), F.col("text").alias("content"), F.col("source").alias("source_file"), F.lit("x").alias("added_by")
    )
    return mutations.drawer_requests(docs).dropDuplicates(["id"])


@query
def request_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as requests, some with unusable, missing or too long fields."""
    number = F.col("doc_id") % 6
    requests = src.table(spark, folder, "documents").select(
        "doc_id",
        F.when(number == 1, F.lit(" *** ")).when(number == 2, F.repeat("lang", F.lit(41))).otherwise(F.col("lang")).alias("wing"),
        F.when(number == 3, F.lit(" ")).otherwise("stored").alias("room"),
        F.when(number == 4, F.lit(None)).when(number == 5, F.repeat("text", F.lit(100))).otherwise(F.col("text")).alias("content"),
        F.col("source").alias("source_file"),
        F.lit(None).cast("string").alias("added_by"),
    )
    return mutations.judged_requests(requests).select("doc_id", "status", F.coalesce("reason", F.lit("")).alias("reason"))


@query
def add_drawer_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return mutations.add_outcomes(_stored(spark, folder), _requests(spark, folder))


@query
def journal_counts(spark: SparkSession, folder: str) -> DataFrame:
    outcomes = mutations.add_outcomes(_stored(spark, folder), _requests(spark, folder))
    return phase_counts(mutations.journal_entries(outcomes, "add_drawer", NOW))


@query
def new_drawers(spark: SparkSession, folder: str) -> DataFrame:
    return mutations.new_drawers(_stored(spark, folder), _requests(spark, folder)).select("id", "wing", "room", "source_file")


@query
def delete_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return mutations.delete_outcomes(_stored(spark, folder), _requests(spark, folder).select("id").distinct())


@query
def delete_by_source(spark: SparkSession, folder: str) -> DataFrame:
    sizes = src.table(spark, folder, "documents").groupBy(F.upper("source").alias("source_file")).agg(F.sum(F.length("text")).alias("chars"))
    return mutations.delete_sources(src.drawers(spark, folder), sizes.where(F.col("chars") % 2 == 0)).select("id", "source_file")


def _timed(spark: SparkSession, folder: str) -> DataFrame:
    stored = src.drawers(spark, folder)
    time = F.when(F.col("doc_id") % 11 != 0, F.col("doc_id") * 0 + 1000)
    return stored.select("id", F.concat("source_file", F.lit("/"), "wing").alias("source_file"), time.alias("source_mtime"), F.lit("sig").alias("embedding_signature"))


@query
def file_states(spark: SparkSession, folder: str) -> DataFrame:
    files = src.table(spark, folder, "documents").select(F.concat(F.upper("source"), F.lit("/"), "lang").alias("source_file")).distinct()
    more = files.unionByName(files.select(F.concat("source_file", F.lit("x")).alias("source_file")))
    asked = more.select("source_file", F.lit(1000).cast("long").alias("source_mtime"), F.lit("sig").alias("embedding_signature"))
    return mutations.file_states(_timed(spark, folder), asked).select("source_file", "state")


@query
def repair_order(spark: SparkSession, folder: str) -> DataFrame:
    return mutations.repair_order(src.drawers(spark, folder)).select("id", "wing", "room")


@query
def compressed_upsert(spark: SparkSession, folder: str) -> DataFrame:
    drawers = src.drawers(spark, folder)
    older = drawers.select("id", "wing", F.md5("text").alias("text"))
    newer = shorthand.compress(src.drawers(spark, folder, heavy=True), WING).select("id", "wing", F.col("compressed").alias("text"))
    return mutations.upsert(older, newer)


@query
def compressed_collection(spark: SparkSession, folder: str) -> DataFrame:
    """The compressed collection after all wings are compressed over an older state."""
    older = src.drawers(spark, folder).select("id", "wing", F.md5("text").alias("text"))
    newer = shorthand.compress(src.drawers(spark, folder, heavy=True)).select("id", "wing", F.col("compressed").alias("text"))
    return mutations.upsert(older, newer)


def _cells(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The drawers as legacy key-value rows of mixed types."""
    drawers = src.drawers(spark, folder, labelled=True)
    nothing = {"s": F.lit(None).cast("string"), "i": F.lit(None).cast("long"), "f": F.lit(None).cast("double"), "b": F.lit(None).cast("int")}

    def cell(key: str, **value: Column) -> Column:
        v = {**nothing, **value}
        return F.struct(
            F.lit(key).alias("key"), v["s"].alias("string_value"), v["i"].alias("int_value"), v["f"].alias("float_value"), v["b"].alias("bool_value")
        )

    cells = F.array(
        cell(migration.DOCUMENT_KEY, s=F.when(F.col("doc_id") % 10 != 0, F.col("text"))),
        cell("wing", s=F.when(F.col("doc_id") % 9 != 0, F.col("wing")).otherwise(" ")),
        cell("room", s=F.col("room")),
        cell("source_file", s=F.col("source_file")),
        cell("chunk_index", f=F.col("doc_id") + 0.75),
        cell("source_mtime", s=F.col("doc_id").cast("string")),
        cell("importance", i=F.col("importance").cast("long")),
        cell("weight", s=F.lit("n/a")),
        cell("original_tokens", i=F.col("doc_id") * 2),
        cell("topic", b=(F.col("doc_id") % 2).cast("int")),
        cell("chroma:other", s=F.lit("skip")),
    )
    embeddings = drawers.select("doc_id", F.col("id").alias("embedding_id")).withColumnRenamed("doc_id", "id")
    values = drawers.select(F.col("doc_id").alias("id"), F.explode(cells).alias("c")).select("id", "c.*")
    return embeddings, values


@query
def migrate_pivot(spark: SparkSession, folder: str) -> DataFrame:
    moved = migration.drawers_from_cells(*_cells(spark, folder))
    return moved.select(
        "id", "text", "wing", "room", "source_file", "chunk_index", "source_mtime", "original_tokens", "topic",
        F.coalesce("importance", F.lit(-1.0)).alias("importance"), F.coalesce("weight", F.lit(-1.0)).alias("weight"),
    )


@query
def migrate_summary(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.migration_summary(migration.drawers_from_cells(*_cells(spark, folder)))


@query
def migrate_written(spark: SparkSession, folder: str) -> DataFrame:
    """The drawers that a migration wrote into a table of its own, as the new version reads."""
    table = VersionedTable(spark, f"{shared_folder(spark)}/migrated-{uuid4().hex}", DRAWER_SCHEMA, ["id"], ["wing", "id"])
    migrate.migrate(table, migration.drawers_from_cells(*_cells(spark, folder)))
    return taxonomy.migration_summary(table.read())


@query
def metadata_projection(spark: SparkSession, folder: str) -> DataFrame:
    drawers = src.drawers(spark, folder, labelled=True)
    names = [n for n in DRAWER_SCHEMA.fieldNames() if n in drawers.columns and n not in ("id", "text")]
    return drawers.select("id", F.to_json(F.struct(*names)).alias("metadata"))


# --- ingestion --------------------------------------------------------------


def _project_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = src.texts(spark, folder, "documents")
    path = F.concat(_project_path(), F.lit("."), F.col("doc_id").cast("string"))
    return docs.select(
        path.alias("path"), F.concat(F.lit("/p/"), path).alias("source_file"), F.col("doc_id").alias("source_mtime"), F.col("text").alias("content")
    )


@query
def mine_project(spark: SparkSession, folder: str) -> DataFrame:
    made = ingest.project_drawers(_project_files(spark, folder), "proj", ROOMS, "miner", NOW)
    return made.select("id", "room", "source_file", "source_mtime", "chunk_index", F.md5("text").alias("digest"))


@query
def mine_project_totals(spark: SparkSession, folder: str) -> DataFrame:
    made = ingest.project_drawers(_project_files(spark, folder), "proj", ROOMS, "miner", NOW)
    return ingest.run_totals(_project_files(spark, folder), made)


@query
def mine_limited_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of a run that rejects files above 2,000 bytes."""
    listed = _project_files(spark, folder).withColumn("size", F.octet_length("content"))
    kept = listed.where(F.col("size") <= SMALL_FILE_BYTES)
    made = ingest.project_drawers(kept, "proj", ROOMS, "miner", NOW)
    return ingest.run_totals(kept, made, file_source.rejected_files(listed, SMALL_FILE_BYTES))


@query
def exported_collections(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written as collection documents of up to 64 drawers, and read back."""
    docs = src.texts(spark, folder, "documents")
    metadata = F.struct(
        F.col("lang").alias("Wing"), F.col("source").alias("Room"), F.lit("").alias("Hall"), F.col("doc_id").cast("int").alias("ChunkIndex")
    )
    drawer = F.struct(F.col("doc_id").cast("string").alias("Id"), F.col("text").alias("Text"), metadata.alias("Metadata"))
    groups = docs.groupBy(F.floor(F.col("doc_id") / 64).alias("_group")).agg(F.collect_list(drawer).alias("Drawers"))
    target = f"{shared_folder(spark)}/collections-{uuid4().hex}"
    document = F.to_json(F.struct(F.lit("drawers").alias("Name"), "Drawers"))
    # One document per file in one folder; tasks put their files there themselves (version 2), not the driver one by one.
    single = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": 2}
    groups.select(document.alias("value")).write.options(**single).text(target)
    read = json_collections.read_collections(spark, target)
    return read.select("id", "wing", "room", "chunk_index", "status", F.md5("text").alias("digest"))


@query
def mine_project_rooms(spark: SparkSession, folder: str) -> DataFrame:
    made = ingest.project_drawers(_project_files(spark, folder), "proj", ROOMS, "miner", NOW)
    return ingest.room_totals(made)


@query
def mine_conversations(spark: SparkSession, folder: str) -> DataFrame:
    made = ingest.conversation_drawers(_raw_files(spark, folder), "chats", "miner", NOW, topics=TOPICS)
    return made.select("id", "room", "source_file", "chunk_index", "text")


@query
def mine_conversation_memories(spark: SparkSession, folder: str) -> DataFrame:
    lists = {"markers": MARKERS, "positive": POSITIVE, "negative": NEGATIVE}
    made = ingest.conversation_drawers(_raw_files(spark, folder), "chats", "miner", NOW, "general", **lists)
    return made.select("id", "room", "source_file", "chunk_index", "text")


@query
def pending_files(spark: SparkSession, folder: str) -> DataFrame:
    files = _project_files(spark, folder)
    stored = files.where(F.col("source_mtime") % 3 != 0).select(
        F.md5("source_file").alias("id"),
        "source_file",
        F.when(F.col("source_mtime") % 3 == 1, F.col("source_mtime")).alias("source_mtime"),
        F.lit(ingest.EMBEDDING_SIGNATURE).alias("embedding_signature"),
    )
    return ingest.pending_files(stored, files).select("source_file", "state")


__all__ = ["QUERIES"]
