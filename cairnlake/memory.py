"""One object over the stored tables with a method per tool of the engine."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlake.functions.params import DUPLICATE_THRESHOLD, SEARCH_LIMIT, clamp_positive
from cairnlake.operators import knowledge, layers, mutations, roomgraph, search, shorthand, taxonomy
from cairnlake.operators.postings import StoredIndex
from cairnlake.plans import migrate, sql_api
from cairnlake.schema import COMPRESSED, DRAWERS
from cairnlake.session import cut_lineage
from cairnlake.sources.store import Collections
from cairnlake.sources.versions import VersionedTable
from cairnlake.streaming.journal import append_journal

FACT = ["subject", "predicate", "object"]
FACTS = T.StructType([T.StructField(name, T.StringType()) for name in (*FACT, "valid_from", "valid_to")]).add("confidence", T.DoubleType())
NODES = T.StructType([T.StructField(name, T.StringType()) for name in ("id", "name", "type")])
DIRECTIONS = ("outgoing", "incoming", "both")


class Memory:
    """Tools over the drawers and the knowledge graph of one catalog database.

    Reads return DataFrames; changes take DataFrames of requests, so a call handles one
    request or millions alike. With ``journal`` every change is logged there, its intent
    before anything happens and its result afterwards.
    """

    def __init__(self, spark: SparkSession, database: str = "default", journal: str | None = None) -> None:
        self.spark = spark
        self.store = Collections(spark, database)
        self.index = StoredIndex(spark, f"{self.store.folder}/_index")
        self.journal = journal

    def _now(self) -> str:
        return datetime.now(UTC).isoformat()

    def _log(self, rows: DataFrame, operation: str, phase: str | Column) -> None:
        if self.journal:
            told = F.lit(phase) if isinstance(phase, str) else phase
            append_journal(mutations.journal_phase(rows, operation, told, self._now()), self.journal)

    def _drawers(self) -> DataFrame:
        return self.store.read(DRAWERS)

    def _nodes(self) -> DataFrame:
        return roomgraph.room_nodes(self._drawers())

    def _facts(self) -> VersionedTable:
        return self.store.table("triples", FACTS, FACT)

    def _nodes_table(self) -> VersionedTable:
        return self.store.table("entities", NODES, ["id"])

    def _triples(self) -> DataFrame:
        return self._facts().read()

    def _entities(self) -> DataFrame:
        return self._nodes_table().read()

    # Reading

    def status(self) -> DataFrame:
        return taxonomy.status(self._drawers())

    def list_wings(self) -> DataFrame:
        return taxonomy.list_wings(self._drawers())

    def list_rooms(self, wing: str | None = None) -> DataFrame:
        return taxonomy.list_rooms(self._drawers(), wing)

    def get_taxonomy(self) -> DataFrame:
        return taxonomy.taxonomy(self._drawers())

    def get_notation(self) -> str:
        return shorthand.NOTATION

    def search(self, query: str, limit: int = SEARCH_LIMIT[0], wing: str | None = None, room: str | None = None) -> DataFrame:
        return search.search_memories(self._drawers(), query, limit, wing, room, self.index.open())

    def check_duplicate(self, content: str, threshold: float = DUPLICATE_THRESHOLD) -> DataFrame:
        asked = self.spark.createDataFrame([(0, content)], "query_id int, query string")
        return search.check_duplicate_batch(asked, self._drawers(), threshold, self.index.open()).orderBy("place").drop("query_id", "place")

    def diary_read(self, agent: str, last_n: int | None = None) -> DataFrame:
        return layers.diary_read(self._drawers(), agent, last_n)

    def traverse(self, start_room: str, max_hops: int | None = None) -> DataFrame:
        """The walk, or suggested rooms when the start is unknown."""
        nodes = self._nodes()
        if nodes.where(F.col("room") == start_room).isEmpty():
            return roomgraph.suggest_rooms(nodes, start_room)
        return roomgraph.traverse(nodes, start_room, max_hops)

    def find_tunnels(self, wing_a: str | None = None, wing_b: str | None = None) -> DataFrame:
        return roomgraph.find_tunnels(self._nodes(), wing_a, wing_b)

    def graph_stats(self) -> DataFrame:
        return roomgraph.graph_stats(self._nodes())

    def kg_query(self, entity: str, as_of: str | None = None, direction: str = "both") -> DataFrame:
        wanted = direction.strip().lower()
        if wanted not in DIRECTIONS:
            raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
        return knowledge.query_entity(self._triples(), self._entities(), entity, as_of, wanted)

    def kg_timeline(self, entity: str | None = None) -> DataFrame:
        return knowledge.timeline(self._triples(), self._entities(), entity)

    def kg_stats(self) -> DataFrame:
        return knowledge.stats(self._triples(), self._entities())

    def wake_up(self, identity: str | None = None, wing: str | None = None) -> str:
        """Identity followed by the essential story."""
        return layers.identity(identity) + "\n\n" + layers.render_story(self._drawers(), wing).first()["rendered"]

    def register_sql(self) -> None:
        """Views and table functions over the stored tables as they are now; call it again after changes."""
        sql_api.register_frames(self._drawers(), self._triples(), self._entities())
        sql_api.register_table_functions(self.spark)

    # Changing

    def add_drawer(self, requests: DataFrame) -> DataFrame:
        """Insert what is neither stored nor a duplicate; returns one outcome per request.

        Requests that break a rule are not changed to fit: their outcome is ``rejected``.
        """
        judged = mutations.judged_requests(requests)
        asked = mutations.drawer_requests(judged.where("status = 'accepted'"))
        self._log(asked.dropDuplicates(["id"]), "add_drawer", "intent")
        # The outcomes describe the table before the insert, so they are fixed first.
        outcomes = cut_lineage(mutations.add_outcomes(self._drawers(), asked, index=self.index.open()))
        accepted = asked.join(outcomes.where("outcome = 'inserted'").select("id"), "id", "left_semi").dropDuplicates(["id"])
        self._insert(accepted.select("*", F.lit(0).alias("chunk_index"), F.lit(self._now()).alias("filed_at")))
        result = F.when(F.col("outcome") == "inserted", "success").otherwise(F.col("outcome"))
        self._log(outcomes, "add_drawer", result)
        refused = judged.where("status = 'rejected'").select(
            F.lit(None).cast("string").alias("id"), "wing", "room", F.col("status").alias("outcome"), F.lit(0).cast("long").alias("matches"), "reason"
        )
        return outcomes.unionByName(refused, allowMissingColumns=True)

    def _insert(self, drawers: DataFrame) -> None:
        """Store drawers of new ids, then their postings; ``repair`` makes the index anew if this stops between."""
        fresh = cut_lineage(mutations.new_drawers(self._drawers(), drawers))
        self.store.add(DRAWERS, fresh)
        self.index.add(fresh)

    def migrate(self, drawers: DataFrame, dry_run: bool = False) -> DataFrame:
        """Replace all drawers by migrated ones; returns the summary, which is all that a dry run does."""
        self._log(drawers, "migrate", "intent")
        report = migrate.migrate(self.store.table(DRAWERS), drawers, dry_run)
        if report.version:
            self.index.rebuild(self._drawers())
        self._log(drawers, "migrate", "success" if report.version else "noop")
        return report.summary

    def delete_drawer(self, ids: DataFrame) -> DataFrame:
        outcomes = cut_lineage(mutations.delete_outcomes(self._drawers(), ids))
        self._log(outcomes, "delete_drawer", "intent")
        self.index.delete(ids)
        self.store.delete(DRAWERS, ids)
        self._log(outcomes, "delete_drawer", F.col("outcome"))
        return outcomes

    def diary_write(self, requests: DataFrame) -> None:
        entries = mutations.diary_entries(requests, self._now())
        self._log(entries, "diary_write", "intent")
        self._insert(entries)
        self._log(entries, "diary_write", "success")

    def kg_add(self, facts: DataFrame) -> None:
        """Add ``(subject_name, predicate, object_name, valid_from, ord)`` facts and their missing endpoints."""
        fresh = knowledge.add_triples(self._triples(), facts).withColumn("confidence", F.lit(1.0))
        named = facts.select(F.concat_ws("|", "subject_name", "predicate", "object_name").alias("id"))
        self._log(named, "kg_add", "intent")
        self._nodes_table().commit(knowledge.missing_endpoints(self._entities(), facts))
        self._facts().commit(fresh)
        self._log(named, "kg_add", "success")

    def kg_add_entity(self, entities: DataFrame) -> None:
        named = entities.select(F.col("name").alias("id"))
        self._log(named, "kg_add_entity", "intent")
        latest = knowledge.latest_entities(entities)
        self._nodes_table().commit(latest, gone=latest)
        self._log(named, "kg_add_entity", "success")

    def kg_invalidate(self, ended: DataFrame) -> None:
        named = ended.select(F.concat_ws("|", "subject_name", "predicate", "object_name").alias("id"))
        self._log(named, "kg_invalidate", "intent")
        # Only facts that are open under a named key change; all rows of their key are written anew.
        triples = self._triples()
        named_facts = knowledge.closings(ended).select(FACT)
        touched = triples.where("valid_to IS NULL").join(named_facts, FACT, "left_semi").select(FACT).distinct()
        changed = knowledge.invalidate(triples.join(touched, FACT, "left_semi"), ended)
        self._facts().commit(changed, gone=touched)
        self._log(named, "kg_invalidate", "success")

    def compress(self, wing: str | None = None) -> DataFrame:
        """Write the notation of all drawers to the compressed collection; returns the totals."""
        compressed = shorthand.compress(self._drawers(), wing)
        figures = compressed.select(
            "id", F.col("compressed").alias("text"), F.col("ratio").alias("compression_ratio"), "original_tokens", "compressed_tokens"
        )
        kept = self._drawers().drop("text", "compression_ratio", "original_tokens", "compressed_tokens")
        self._log(kept, "compress", "intent")
        self.store.upsert(COMPRESSED, kept.join(figures, "id"))
        self._log(kept, "compress", "success")
        return shorthand.compression_totals(compressed)

    def repair(self) -> None:
        for collection in (DRAWERS, COMPRESSED):
            if self.store.exists(collection):
                self.store.repair(collection)
        self.index.rebuild(self._drawers())
        for table in (self._facts(), self._nodes_table()):
            if table.exists():
                table.compact()
