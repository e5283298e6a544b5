"""Independent SQL statements (DuckDB dialect) that answer the catalog queries."""

from __future__ import annotations

from cairnlake.plans.catalog import (
    AS_OF,
    CUSTOMER,
    NATION,
    PROBE_VECTOR,
    REGION,
    SEARCH_TEXT,
    SHARED_ROOM,
    START_ROOM,
    WING,
)

ORACLES: dict[str, str] = {}

WORD_SPLIT = r"[^\p{L}\p{Mn}\p{Nd}\p{Pc}\x{200C}\x{200D}]+"
SPACE = r"[\s\p{Z}\x{85}\x{0B}]"


def tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '{WORD_SPLIT}'), lambda x: regexp_full_match(x, '[a-z0-9_]+'))"


def token_set(text: str) -> str:
    return f"list_distinct({tokens(text)})"


def trimmed(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def half_even(value: str, places: int) -> str:
    return f"round_even(({value}) * 1e{places}, 0) / 1e{places}"


def containment(query: str, text: str) -> str:
    return f"(CASE WHEN len({query}) > 0 THEN len(list_intersect({query}, {text})) / len({query})::DOUBLE ELSE 0.0 END)"


DRAWERS = """
docs AS (
  SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'general'
                 WHEN doc_id % 13 < 9 THEN 'room_' || lang || '_' || (doc_id % 13)
                 ELSE 'room_shared_' || (doc_id % 13) END AS room,
         strftime(DATE '2024-01-01' + (doc_id % 30)::INTEGER, '%Y-%m-%d') AS date
  FROM documents),
drawers AS (
  SELECT 'drawer_' || d.lang || '_' || room || '_' || substr(sha256(source || d.doc_id), 1, 24) AS id,
         text, d.lang AS wing, room, source AS source_file, date, date || 'T00:00:00' AS filed_at, d.doc_id,
         CASE WHEN toxic = 1 THEN 'hall_toxic' WHEN quality = 1 THEN 'hall_quality' WHEN quality = 0 THEN 'hall_noise' END AS hall,
         quality * 3.0 + toxic AS importance
  FROM docs d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def over_drawers(sql: str) -> str:
    return f"WITH {DRAWERS.strip()}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"


ORACLES["status_counts"] = over_drawers(
    """
+ w AS (SELECT wing AS key, count(*) AS n FROM drawers GROUP BY 1),
r AS (SELECT room AS key, count(*) AS n FROM drawers GROUP BY 1)
SELECT 'total' AS kind, 'all' AS key, count(*) AS n, false AS truncated FROM drawers
UNION ALL SELECT 'wing', key, n, t FROM (SELECT *, (SELECT count(*) FROM w) > 30 AS t FROM w ORDER BY n DESC, key LIMIT 30)
UNION ALL SELECT 'room', key, n, t FROM (SELECT *, (SELECT count(*) FROM r) > 30 AS t FROM r ORDER BY n DESC, key LIMIT 30)"""
)
ORACLES["list_wings"] = "SELECT lang AS wing, count(*) AS n FROM documents GROUP BY 1"
ORACLES["list_rooms"] = over_drawers("SELECT 'all' AS wing, room, count(*) AS n FROM drawers GROUP BY room")
ORACLES["list_rooms_wing"] = over_drawers(
    f"SELECT '{WING}' AS wing, room, count(*) AS n FROM drawers WHERE wing = '{WING}' GROUP BY room"
)


def _taxonomy(wing_limit: int, room_limit: int) -> str:
    return over_drawers(
        f"""
+ c AS (SELECT wing, room, count(*) AS n FROM drawers GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY wing ORDER BY n DESC, room) AS room_rank FROM c),
w AS (SELECT wing, sum(n)::BIGINT AS wing_total, count(*) AS rooms FROM c GROUP BY 1 ORDER BY wing_total DESC, wing LIMIT {wing_limit})
SELECT r.wing, wing_total, room, n, room_rank::INTEGER AS room_rank, greatest(rooms - {room_limit}, 0) AS omitted_rooms
FROM r JOIN w ON r.wing = w.wing WHERE room_rank <= {room_limit}"""
    )


ORACLES["taxonomy_full"] = _taxonomy(200, 200)
ORACLES["taxonomy_topn"] = _taxonomy(3, 4)
ORACLES["status_tree"] = over_drawers("SELECT wing, room, count(*) AS n FROM drawers GROUP BY ALL")

ORACLES["get_drawers"] = over_drawers(
    f"SELECT id, wing, room, source_file, date FROM drawers WHERE wing = '{WING}' AND room = '{SHARED_ROOM}'"
)


def _lexical(columns: str, limit: int, where: str = "true", source: str = "source_file") -> str:
    return over_drawers(
        f"""
+ q AS (SELECT {token_set(f"'{SEARCH_TEXT}'")} AS q),
s AS (SELECT id, text, wing, room, {source} AS source_file, {containment('q', token_set('text'))} AS similarity
      FROM drawers, q WHERE {where})
SELECT {columns} FROM s WHERE similarity > 0 ORDER BY similarity DESC, source_file, id LIMIT {limit}"""
    )


ORACLES["lexical_search"] = _lexical("id, wing, room, source_file, similarity", 25)
ORACLES["lexical_search_wing_room"] = _lexical(
    "id, wing, room, source_file, similarity", 25, f"wing = '{WING}' AND room = '{SHARED_ROOM}'"
)
ORACLES["search_memories"] = _lexical(
    f"id, text, wing, room, split_part(source_file, '/', -1) AS source_file, {half_even('similarity', 3)} AS similarity",
    10,
    source="'/data/notes/' || source_file || '.txt'",
)
ONE_LINE = f"replace({trimmed('text')}, chr(10), ' ')"
ORACLES["search_rendered"] = (
    "WITH hits AS ("
    + _lexical(f"id, {ONE_LINE} AS line, wing, room, source_file, {half_even('similarity', 3)} AS sim", 5)
    + f"""),
n AS (SELECT *, row_number() OVER (ORDER BY sim DESC, source_file, id) AS p FROM hits)
SELECT '## L3 - SEARCH RESULTS for "{SEARCH_TEXT}"' || chr(10) || string_agg(
  '  [' || p || '] ' || wing || '/' || room || ' (sim=' || sim || ')' || chr(10) || '      '
  || CASE WHEN len(line) > 300 THEN line[:297] || '...' ELSE line END || chr(10) || '      src: ' || source_file,
  chr(10) ORDER BY p) AS rendered FROM n"""
)
ORACLES["indexed_search"] = ORACLES["lexical_search"]
ORACLES["indexed_search_wing_room"] = ORACLES["lexical_search_wing_room"]
ORACLES["check_duplicate"] = over_drawers(
    f"""
+ q AS (SELECT {token_set("'The and of in on is that with'")} AS q),
s AS (SELECT id, wing, room, text, {containment('q', token_set('text'))} AS score FROM drawers, q)
SELECT id, wing, room, {half_even('score', 3)} AS similarity,
       CASE WHEN len(text) > 200 THEN text[:200] || '...' ELSE text END AS content
FROM s WHERE score >= 0.9 ORDER BY score DESC, id LIMIT 5"""
)
ORACLES["check_duplicate_batch"] = over_drawers(
    f"""
+ q AS (SELECT item_id AS query_id, {token_set('text')} AS q FROM benchmark),
t AS (SELECT id, wing, room, text, {token_set('text')} AS t FROM drawers),
s AS (SELECT query_id, id, wing, room, text, {containment('q', 't')} AS score FROM t, q WHERE len(q) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s WHERE score >= 0.9)
SELECT query_id, place::INTEGER AS place, id, wing, room, {half_even('score', 3)} AS similarity,
       CASE WHEN len(text) > 200 THEN text[:200] || '...' ELSE text END AS content FROM r WHERE place <= 5"""
)

PROBE = "[" + ",".join(repr(x) for x in PROBE_VECTOR) + "]::DOUBLE[]"


def distance(left: str, right: str) -> str:
    return f"list_sum(list_transform(list_zip({left}::DOUBLE[], {right}::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _vector(where: str) -> str:
    return f"""
WITH s AS (SELECT vec_id AS id, 'label_' || label AS wing, {distance('embedding', PROBE)} AS d FROM embeddings)
SELECT id, wing, {half_even('1 - d', 3)} AS similarity FROM s WHERE {where} ORDER BY d, id LIMIT 10"""


ORACLES["vector_search"] = _vector("true")
ORACLES["vector_search_wing"] = _vector("wing = 'label_3'")
ORACLES["vector_knn_batch"] = f"""
WITH e AS (SELECT 'label_' || label AS query_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS p FROM embeddings),
m AS (SELECT query_id, p, avg(v) AS v FROM e GROUP BY ALL),
q AS (SELECT query_id, list(v ORDER BY p) AS c FROM m GROUP BY 1),
s AS (SELECT query_id, vec_id AS id, {distance('embedding', 'c')} AS d FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS place FROM s)
SELECT query_id, place::INTEGER AS place, id, {half_even('1 - d', 3)} AS similarity FROM r WHERE place <= 5"""
ORACLES["vector_knn_self"] = f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {distance('e.embedding', 'q.embedding')} AS d FROM embeddings e, embeddings q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS place FROM s)
SELECT query_id, place::INTEGER AS place, id, {half_even('1 - d', 3)} AS similarity FROM r WHERE place <= 3"""
ORACLES["embedded_search"] = over_drawers(
    f"""
+ t AS (SELECT id, wing, unnest({tokens('text')}) AS tok FROM drawers),
h AS (SELECT id, wing, ('0x' || md5(tok)[:8])::BIGINT % 64 AS p, CASE WHEN md5(tok)[9] < '8' THEN 1 ELSE -1 END AS s FROM t),
v AS (SELECT id, wing, p, sum(s)::DOUBLE AS x FROM h GROUP BY ALL),
norms AS (SELECT id, sqrt(sum(x * x)) AS norm FROM v GROUP BY 1),
probe AS (SELECT unnest({PROBE}) AS b, unnest(range(64)) AS p),
d AS (SELECT drawers.id, drawers.wing, sum((coalesce(v.x / nullif(norm, 0), 0)::FLOAT - b) ^ 2) AS dist
      FROM drawers CROSS JOIN probe LEFT JOIN v ON v.id = drawers.id AND v.p = probe.p
      LEFT JOIN norms ON norms.id = drawers.id GROUP BY ALL)
SELECT id, wing, {half_even('1 - dist', 3)} AS similarity FROM d ORDER BY dist, id LIMIT 10"""
)

GROUPS = "SELECT source AS source_file, count(*) AS n FROM documents WHERE trim(source) <> '' GROUP BY 1 HAVING count(*) >= 5"
ORACLES["dedup_groups"] = GROUPS
ORACLES["dedup_largest_groups"] = f"SELECT * FROM ({GROUPS}) ORDER BY n DESC, source_file LIMIT 15"
ORACLES["dedup_stats"] = f"""
WITH g AS ({GROUPS})
SELECT (SELECT count(*) FROM documents) AS total_drawers, count(*) AS source_groups,
       coalesce(sum(n), 0)::BIGINT AS drawers_in_groups,
       coalesce(sum(CASE WHEN n > 20 THEN round_even(n * 0.4, 0) END), 0)::BIGINT AS estimated_duplicates FROM g"""
ORACLES["dedup_scope"] = over_drawers(
    f"SELECT id, source_file FROM drawers WHERE wing = '{WING}' AND contains(lower(source_file), 'rc1')"
)

BAGS = f"""
+ groups AS ({GROUPS}),
member AS MATERIALIZED (SELECT id, source_file, len(text) AS length, len({trimmed('text')}) AS trimmed, {tokens('text')} AS toks
           FROM drawers WHERE source_file IN (SELECT source_file FROM groups)),
tf AS MATERIALIZED (SELECT id, source_file, tok, count(*) AS n FROM (SELECT id, source_file, unnest(toks) AS tok FROM member) GROUP BY ALL),
norm AS MATERIALIZED (SELECT id, sqrt(sum(n * n)) AS norm FROM tf GROUP BY 1)"""


def _round(i: int, threshold: float) -> str:
    """Pivot ``i`` of every source and the candidates that survive it."""
    return f""",
p{i} AS MATERIALIZED (SELECT source_file, arg_min(id, (-length, id)) AS anchor FROM c{i - 1} GROUP BY 1),
dot{i} AS (SELECT a.id, sum(a.n * b.n) AS dot FROM tf a JOIN p{i} ON a.source_file = p{i}.source_file
          JOIN tf b ON b.id = p{i}.anchor AND b.tok = a.tok GROUP BY 1),
s{i} AS MATERIALIZED (SELECT c.id, c.source_file, c.length, anchor, coalesce(dot / (x.norm * y.norm), 0.0) AS similarity
         FROM c{i - 1} c JOIN p{i} ON c.source_file = p{i}.source_file LEFT JOIN dot{i} ON dot{i}.id = c.id
         LEFT JOIN norm x ON x.id = c.id LEFT JOIN norm y ON y.id = anchor),
c{i} AS MATERIALIZED (SELECT id, source_file, length FROM s{i} WHERE id <> anchor AND similarity < {threshold})"""


def _greedy(threshold: float, final: str) -> str:
    rounds = "".join(_round(i, threshold) for i in range(1, 6))
    kept = " UNION ALL ".join([f"SELECT anchor AS id FROM p{i}" for i in range(1, 6)] + ["SELECT id FROM c5"])
    return over_drawers(
        f"""{BAGS},
c0 AS (SELECT id, source_file, length FROM member WHERE trimmed >= 20){rounds},
kept AS ({kept}),
decided AS (SELECT source_file, id, id IN (SELECT id FROM kept) AS kept FROM member)
{final}"""
    )


ORACLES["dedup_pivot_cosine"] = over_drawers(
    f"""{BAGS},
c0 AS (SELECT id, source_file, length FROM member WHERE trimmed >= 20){_round(1, 0.85)}
SELECT source_file, id, anchor AS pivot_id, round(similarity, 6) AS similarity FROM s1 WHERE id <> anchor"""
)
ORACLES["dedup_greedy"] = _greedy(0.85, "SELECT source_file, id, kept FROM decided")
ORACLES["dedup_result"] = _greedy(
    0.75,
    """SELECT source_file, count(*) AS n, count_if(kept)::BIGINT AS kept, count_if(NOT kept)::BIGINT AS deleted
FROM decided GROUP BY 1""",
)

NODES = """
+ rows AS (SELECT * FROM drawers WHERE trim(room) <> '' AND room <> 'general' AND trim(wing) <> ''),
nodes AS MATERIALIZED (SELECT room, list_sort(list(DISTINCT wing)) AS wings, coalesce(list_sort(list(DISTINCT hall) FILTER (hall IS NOT NULL)), []) AS halls,
       count(*) AS n, min(id) AS first_id, list_sort(list(DISTINCT date)) AS all_dates FROM rows GROUP BY room)"""


def over_nodes(sql: str) -> str:
    return over_drawers(f"{NODES} {sql}")


def flat(array: str) -> str:
    return f"array_to_string({array}, ',')"


ORACLES["room_nodes"] = over_nodes(
    f"""SELECT room, {flat('wings')} AS wings, {flat('halls')} AS halls, n,
       {flat('all_dates[greatest(len(all_dates) - 4, 1):]')} AS dates FROM nodes"""
)
ORACLES["room_edges"] = over_nodes(
    """, w AS (SELECT DISTINCT room, wing FROM rows), h AS (SELECT DISTINCT room, hall FROM rows WHERE hall IS NOT NULL)
SELECT a.room, a.wing AS wing_a, b.wing AS wing_b, h.hall, n FROM w a JOIN w b ON a.room = b.room AND a.wing < b.wing
JOIN h ON h.room = a.room JOIN nodes ON nodes.room = a.room"""
)
ORACLES["rooms_per_wing"] = over_nodes("SELECT wing, count(DISTINCT room) AS rooms FROM rows GROUP BY 1")
ORACLES["graph_stats"] = over_nodes(
    """, w AS (SELECT DISTINCT room, wing FROM rows), h AS (SELECT DISTINCT room, hall FROM rows WHERE hall IS NOT NULL)
SELECT (SELECT count(*) FROM nodes) AS total_rooms, (SELECT count(*) FROM nodes WHERE len(wings) >= 2) AS tunnel_rooms,
(SELECT count(*) FROM w a JOIN w b ON a.room = b.room AND a.wing < b.wing JOIN h ON h.room = a.room) AS total_edges"""
)
ORACLES["find_tunnels"] = over_nodes(
    f"""SELECT room, {flat('wings')} AS wings, {flat('halls')} AS halls, n, coalesce(all_dates[-1], '') AS recent FROM nodes
WHERE len(wings) >= 2 AND list_contains(wings, 'en') AND list_contains(wings, 'fr') ORDER BY n DESC, first_id LIMIT 50"""
)
ORACLES["top_tunnels"] = over_nodes(
    f"SELECT room, {flat('wings')} AS wings, n FROM nodes WHERE len(wings) >= 2 ORDER BY len(wings) DESC, room LIMIT 10"
)


def _walk(hops: int) -> str:
    steps = ""
    for hop in range(1, hops + 1):
        steps += f"""
f{hop} AS MATERIALIZED (
  SELECT room, rank, wings, {hop} AS hop, via FROM (
    SELECT b.room, list_append(a.rank, b.first_id) AS rank, b.wings,
           list_sort(list_intersect(a.wings, b.wings)) AS via,
           row_number() OVER (PARTITION BY b.room ORDER BY a.rank) AS k
    FROM f{hop - 1} a JOIN nodes b ON len(list_intersect(a.wings, b.wings)) > 0
    WHERE b.room NOT IN ({' UNION ALL '.join(f'SELECT room FROM f{h}' for h in range(hop))})) WHERE k = 1),"""
    union = " UNION ALL ".join(f"SELECT * FROM f{h}" for h in range(hops + 1))
    return over_nodes(
        f""", f0 AS (SELECT room, [first_id] AS rank, wings, 0 AS hop, []::VARCHAR[] AS via FROM nodes WHERE room = '{START_ROOM}'),{steps}
found AS ({union})
SELECT found.room, {flat('found.wings')} AS wings, n, hop, {flat('via')} AS connected_via
FROM found JOIN nodes ON nodes.room = found.room ORDER BY hop, n DESC, rank LIMIT 50"""
    )


ORACLES["traverse_1hop"] = _walk(1)
ORACLES["traverse_2hop"] = _walk(2)
ORACLES["fuzzy_rooms"] = over_nodes(
    """SELECT room, CASE WHEN contains(room, 'shared-fr_') THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM nodes
WHERE contains(room, 'shared') OR contains(room, 'fr_') ORDER BY score DESC, room LIMIT 5"""
)

ID = "replace(replace(lower({0}), ' ', '_'), '''', '')"
KG = f"""WITH named AS (
  SELECT c_name AS subject_name, 'located_in' AS predicate, n_name AS object_name, NULL AS valid_from, NULL AS valid_to
    FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT s_name, 'located_in', n_name, NULL, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT n_name, 'part_of', r_name, NULL, NULL FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_name, 'placed', 'Order#' || o_orderkey, strftime(o_orderdate, '%Y-%m-%d'),
      CASE WHEN o_orderstatus <> 'O' THEN strftime(o_orderdate::DATE + 90, '%Y-%m-%d') END
    FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT * FROM (SELECT DISTINCT 'User#' || user_id, 'did', event_type, strftime(ts, '%Y-%m-%d'),
      CASE WHEN event_type = 'error' THEN strftime(ts, '%Y-%m-%d') END FROM events)),
triples AS (SELECT {ID.format('subject_name')} AS subject, predicate, {ID.format('object_name')} AS object,
            valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to, 1.0::DOUBLE AS confidence, subject_name, object_name FROM named),
entities AS (SELECT {ID.format('name')} AS id, name, type FROM (
  SELECT c_name AS name, 'customer' AS type FROM customer UNION ALL SELECT s_name, 'supplier' FROM supplier
  UNION ALL SELECT n_name, 'nation' FROM nation UNION ALL SELECT r_name, 'region' FROM region
  UNION ALL SELECT 'Order#' || o_orderkey, 'order' FROM orders
  UNION ALL SELECT DISTINCT 'User#' || user_id, 'user' FROM events UNION ALL SELECT DISTINCT event_type, 'event' FROM events))"""
FACT = "predicate, valid_from, valid_to, confidence, valid_to IS NULL AS current"
VALID = f"(valid_from IS NULL OR valid_from <= '{AS_OF}') AND (valid_to IS NULL OR valid_to >= '{AS_OF}')"


def _outgoing(name: str, extra: str = "true") -> str:
    return f"""SELECT 'outgoing' AS direction, '{name}' AS subject, o.name AS object, {FACT}
FROM triples t JOIN entities o ON t.object = o.id WHERE t.subject = '{name.lower()}' AND {extra}"""


def _incoming(name: str) -> str:
    return f"""SELECT 'incoming' AS direction, s.name AS subject, '{name}' AS object, {FACT}
FROM triples t JOIN entities s ON t.subject = s.id WHERE t.object = '{name.lower()}'"""


NAMED = f"SELECT s.name AS subject, o.name AS object, {FACT} FROM triples t JOIN entities s ON t.subject = s.id JOIN entities o ON t.object = o.id"
CHRONOLOGICAL = "ORDER BY valid_from ASC NULLS LAST, t.subject, predicate, t.object LIMIT 100"
ORACLES["kg_outgoing"] = f"{KG} {_outgoing(CUSTOMER)}"
ORACLES["kg_incoming"] = f"{KG} {_incoming(REGION)}"
ORACLES["kg_both"] = f"{KG} {_outgoing(NATION)} UNION ALL {_incoming(NATION)}"
ORACLES["kg_as_of"] = f"{KG} {_outgoing(CUSTOMER, VALID)}"
ORACLES["kg_as_of_batch"] = f"""{KG}, p AS (SELECT subject, max(valid_from) AS day FROM triples GROUP BY 1 HAVING max(valid_from) IS NOT NULL)
SELECT t.subject, day, count(*) AS facts FROM triples t JOIN p ON p.subject = t.subject
WHERE (valid_from IS NULL OR valid_from <= day) AND (valid_to IS NULL OR valid_to >= day) GROUP BY ALL"""
ORACLES["kg_relationship"] = f"{KG} {NAMED} WHERE predicate = 'placed' AND {VALID}"
ORACLES["kg_timeline"] = f"{KG} {NAMED} {CHRONOLOGICAL}"
ORACLES["kg_entity_timeline"] = f"{KG} {NAMED} WHERE t.subject = 'user#7' OR t.object = 'user#7' {CHRONOLOGICAL}"
ORACLES["kg_stats"] = f"""{KG} SELECT (SELECT count(*) FROM entities) AS entities, count(*) AS triples,
count_if(valid_to IS NULL)::BIGINT AS current_facts, count_if(valid_to IS NOT NULL)::BIGINT AS expired_facts,
string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS relationship_types FROM triples"""
ORACLES["kg_add_dedup"] = f"""{KG}, f AS (SELECT lower(c_name) AS subject, 'placed' AS predicate, 'order#' || o_orderkey AS object, '2000-01-01' AS valid_from
FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM triples t WHERE t.subject = f.subject AND t.predicate = f.predicate AND t.object = f.object AND valid_to IS NULL)"""
ORACLES["kg_invalidate"] = f"""{KG} SELECT subject, predicate, object, valid_from,
CASE WHEN valid_to IS NULL AND predicate = 'did' AND object = 'view' THEN '2024-06-01' ELSE valid_to END AS valid_to FROM triples"""
ORACLES["kg_upsert_entity"] = f"""{KG}, i AS (SELECT upper(s_name) AS name, 'vendor' AS type, 1 AS ord FROM supplier
UNION ALL SELECT p_name, 'part', p_partkey FROM part),
k AS (SELECT {ID.format('name')} AS id, name, type, row_number() OVER (PARTITION BY {ID.format('name')} ORDER BY ord DESC) AS r FROM i)
SELECT id, name, type FROM k WHERE r = 1 UNION ALL SELECT id, name, type FROM entities WHERE id NOT IN (SELECT id FROM k)"""
ORACLES["kg_endpoints"] = f"""{KG}, known AS (SELECT id, name, type FROM entities WHERE type <> 'order'),
e AS (SELECT subject AS id, subject_name AS name FROM triples UNION ALL SELECT object, object_name FROM triples)
SELECT * FROM known UNION ALL SELECT id, min(name), 'unknown' FROM e WHERE id NOT IN (SELECT id FROM known) GROUP BY id"""
ORACLES["kg_change_outcomes"] = f"""{KG}, r AS (
  SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'kg_add' ELSE 'kg_invalidate' END AS operation, c_name AS subject_name,
         'placed' AS predicate, 'ORDER#' || o_orderkey AS object_name, o_orderstatus = 'O' AS found
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT operation, subject_name, predicate, object_name,
  CASE WHEN operation = 'kg_add' AND found THEN 'already_exists' WHEN operation <> 'kg_add' AND NOT found THEN 'already_invalidated' ELSE '' END AS reason,
  CASE WHEN (operation = 'kg_add') = found THEN 'noop' ELSE 'success' END AS phase FROM r"""
ORACLES["kg_change_outcomes_strict"] = f"""{KG}, r AS (
  SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'kg_add' ELSE 'kg_invalidate' END AS operation, c_name AS subject_name, 'placed' AS predicate,
         CASE WHEN o_orderkey % 2 = 0 THEN 'Order#' ELSE 'ORDER#' END || o_orderkey AS object_name, o_orderstatus = 'O' AND o_orderkey % 2 = 0 AS found
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT operation, subject_name, predicate, object_name,
  CASE WHEN operation = 'kg_add' AND found THEN 'already_exists' WHEN operation <> 'kg_add' AND NOT found THEN 'already_invalidated' ELSE '' END AS reason,
  CASE WHEN (operation = 'kg_add') = found THEN 'noop' ELSE 'success' END AS phase FROM r"""
