"""SQL statements (DuckDB dialect) that answer the text queries of the catalog."""

from __future__ import annotations

from cairnlake.functions import lexicons as lex
from cairnlake.plans.oracles import DRAWERS, ORACLES, containment, half_even, over_drawers, token_set, tokens, trimmed
from cairnlake.plans.text_catalog import (
    COMMON,
    CORRECTIONS,
    FOLDERS,
    KNOWN_NAMES,
    MARKERS,
    NEGATIVE,
    NOW,
    PLANTED,
    POSITIVE,
    ROOMS,
    SESSION_MARK,
    SPOKEN,
    TOPICS,
)
from cairnlake.plans.catalog import WING

WORD = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(value) for value in values) + "]"


def plain(text: str) -> str:
    """ASCII stand-in with the same word boundaries: other word characters become ``_``, the rest blanks."""
    words_kept = rf"regexp_replace({text}, '[^\p{{L}}\p{{Mn}}\p{{Nd}}\p{{Pc}}\x00-\x7F]', ' ', 'g')"
    return rf"regexp_replace({words_kept}, '[^\x00-\x7F]', '_', 'g')"


def digest(*parts: str) -> str:
    return f"substr(sha256(concat_ws(chr(10), {', '.join(parts)})), 1, 24)"


def capitalized(word: str) -> str:
    return f"(upper(({word})[1]) || lower(({word})[2:]))"


ORACLES["slugs"] = r"""
WITH s AS (SELECT page_id, regexp_replace(regexp_replace(lower(trim(' --' || url || '__ ')), '[\s/\\]+', '_', 'g'), '[^a-z0-9._-]+', '_', 'g') AS v FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(v, '_+', '_', 'g'), '-+', '-', 'g'), '_-.') AS slug FROM s"""
ORACLES["content_ids"] = f"""
SELECT doc_id, 'drawer_' || lang || '_notes_' || {digest('lang', "'notes'", 'source', 'text')} AS drawer_id,
  'drawer_' || lang || '_notes_' || substr(sha256(source || '3'), 1, 24) AS mined_id,
  'diary_wing_night_owl_' || source || '_' || {digest("'wing_night_owl'", 'source', 'text')} AS diary_id FROM documents"""
ORACLES["entity_ids"] = """
WITH n AS (SELECT p_partkey, p_name || ' O''Neil ' || p_type AS name, p_type FROM part)
SELECT p_partkey, replace(replace(lower(name), ' ', '_'), '''', '') AS entity_id, replace(lower(name), ' ', '_') AS predicate_id,
  replace(replace(lower(p_type || '-X'), ' ', '_'), '-', '_') AS wing FROM n"""
ORACLES["iso_dates"] = r"""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate)
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)
SELECT o_orderkey, CASE WHEN regexp_full_match(d, '\d{4}-\d{2}-\d{2}') THEN d ELSE 'invalid' END AS day FROM o"""


def estimate(text: str) -> str:
    return rf"greatest(1, floor(len(regexp_extract_all({text}, '\S+')) * 1.3::DOUBLE))::INTEGER"


ORACLES["token_estimates"] = (
    f"SELECT doc_id, {estimate('text')} AS tokens, len({token_set('text')})::INTEGER AS distinct_tokens FROM documents"
)


def _spell(text: str, known: list[str]) -> str:
    word = r"regexp_replace(t, '[.,!?;:''"
    word += '")]+$' + "', '')"
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in CORRECTIONS.items())
    skip = [
        f"len({word}) < 4",
        rf"regexp_matches({word}, '\d')",
        f"regexp_matches({word}, '[A-Z][a-z]+[A-Z]')",
        f"regexp_matches({word}, '^[A-Z]')",
        rf"regexp_matches({word}, '^\p{{Lu}}|[-_`*#{{}}\[\]\\]')",
        f"list_contains({listed(known) if known else '[]::VARCHAR[]'}, lower({word}))",
        f"lower({word}) NOT IN ({', '.join(quoted(k) for k in CORRECTIONS)})",
    ]
    fixed = f"CASE WHEN {' OR '.join(skip)} THEN t ELSE CASE lower({word}) {cases} END || substr(t, len({word}) + 1) END"
    return rf"array_to_string(list_transform(regexp_extract_all({text}, '\s+|\S+'), lambda t: {fixed}), '')"


ORACLES["spellcheck_tokens"] = f"SELECT doc_id, {_spell('text', KNOWN_NAMES)} AS text FROM documents"
ORACLES["spellcheck_lines"] = f"""SELECT conv_id, turn, '  > ' || replace({_spell('text', [])}, chr(10), chr(10) || '>') || chr(10) || 'that stays' AS text
FROM conversations"""

MESSAGES = """
m AS (SELECT conv_id, turn, role, text, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
        lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text, count(*) OVER (PARTITION BY conv_id) AS n
      FROM conversations WHERE role IN ('user', 'assistant')),
rendered AS (SELECT conv_id, any_value(n) AS n, string_agg(CASE WHEN role = 'user' THEN '> ' || text ELSE text END ||
        CASE WHEN role = 'user' AND next_role = 'assistant' THEN chr(10) ELSE chr(10) || chr(10) END, '' ORDER BY turn) AS t FROM m GROUP BY 1),
transcripts AS (SELECT conv_id, n, t[:-2] AS transcript FROM rendered)"""
ORACLES["transcript_render"] = f"WITH {MESSAGES.strip()} SELECT conv_id, transcript FROM transcripts"
ORACLES["transcript_lines"] = f"""WITH {MESSAGES.strip()} SELECT conv_id, turn, CASE WHEN role = 'user' THEN '> ' || text ELSE text END ||
CASE WHEN role = 'user' AND next_role = 'assistant' THEN chr(10) ELSE chr(10) || chr(10) END AS line FROM m"""
ORACLES["transcript_normalize"] = f"""WITH {MESSAGES.strip()} SELECT conv_id, 'read' AS status, CASE WHEN n >= 2 THEN transcript ELSE '' END AS transcript
FROM transcripts"""
# The branch ends with the answer beside the last message, which repeats its text.
ORACLES["transcript_trees"] = f"""WITH {MESSAGES.strip()},
again AS (SELECT conv_id, turn, role, text FROM m UNION ALL SELECT conv_id, turn + 1, role, text FROM m WHERE next_role IS NULL),
followed AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM again)
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '> ' || text ELSE text END ||
  CASE WHEN role = 'user' AND after = 'assistant' THEN chr(10) ELSE chr(10) || chr(10) END, '' ORDER BY turn)[:-2] AS transcript
FROM followed GROUP BY 1"""
ORACLES["transcript_exports"] = f"""WITH {MESSAGES.strip()} SELECT conv_id, CASE
WHEN conv_id % 3 = 2 THEN transcript || chr(10) || '> I know' || chr(10) || 'I knoe' || chr(10) || '> You know' || chr(10) || '> We know'
WHEN n >= 2 THEN transcript ELSE '' END AS transcript FROM transcripts"""
ORACLES["turn_pairs"] = f"""WITH {MESSAGES.strip()} SELECT conv_id, turn, text AS question,
CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END AS answer FROM m WHERE role = 'user'"""
ORACLES["hook_user_counts"] = """SELECT conv_id AS session, count_if(role = 'user' AND turn % 3 <> 0 AND turn <> 7)::BIGINT AS human_messages
FROM conversations GROUP BY 1"""
ORACLES["save_triggers"] = """SELECT user_id, event_id, messages FROM (
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS messages FROM events) WHERE messages % 15 = 0"""


def _cut(start: str) -> str:
    """End of the window that begins at ``start`` of ``s``."""
    whole = f"least({start} + 800, len(s))"
    window = f"s[({start}) + 1 : {whole}]"
    two = f"({start}) + len({window}) - instr(reverse({window}), chr(10) || chr(10)) - 1"
    one = f"({start}) + len({window}) - instr(reverse({window}), chr(10))"
    return f"""CASE WHEN {whole} >= len(s) THEN len(s)
      WHEN contains({window}, chr(10) || chr(10)) AND {two} > ({start}) + 400 THEN {two}
      WHEN contains({window}, chr(10)) AND {one} > ({start}) + 400 THEN {one} ELSE {whole} END"""


def _chunks(key: str, source: str) -> str:
    """CTEs ending in ``pieces(key, chunk_index, content)``; must follow WITH RECURSIVE."""
    return f"""
txt AS (SELECT {key} AS k, {trimmed('body')} AS s FROM ({source})),
cuts AS (SELECT k, s, 0::BIGINT AS a, ({_cut('0')})::BIGINT AS b FROM txt WHERE len(s) > 0
  UNION ALL SELECT k, s, a, ({_cut('a')})::BIGINT FROM (SELECT k, s, greatest(b - 100, a + 1) AS a FROM cuts WHERE b < len(s))),
pieces AS (SELECT k, (row_number() OVER (PARTITION BY k ORDER BY a) - 1)::INTEGER AS chunk_index, content
  FROM (SELECT k, a, {trimmed('s[a + 1 : b]')} AS content FROM cuts) WHERE len(content) >= 50)"""


ORACLES["text_chunks"] = f"""WITH RECURSIVE {_chunks('doc_id', 'SELECT doc_id, text AS body FROM documents').strip()}
SELECT k AS doc_id, chunk_index, content FROM pieces"""


def _exchange(source: str) -> str:
    """CTEs ending in ``chunks(k, chunk_index, content)`` over ``(k, body)``."""
    return f"""
body AS (SELECT k, body, string_split(body, chr(10)) AS l FROM ({source})),
line AS (SELECT k, unnest(l) AS line, unnest(range(len(l))) AS i FROM body),
marked AS (SELECT *, starts_with(ltrim(line), '>') AS q, {trimmed('line')} AS tl FROM line),
numbered AS (SELECT *, sum(q::INT) OVER (PARTITION BY k ORDER BY i) AS e, sum(q::INT) OVER (PARTITION BY k) AS quotes,
  count(*) OVER (PARTITION BY k) AS lines FROM marked),
ruled AS (SELECT *, sum((starts_with(tl, '---'))::INT) OVER (PARTITION BY k, e ORDER BY i) AS rules FROM numbered),
replies AS (SELECT *, row_number() OVER (PARTITION BY k, e ORDER BY i) AS r FROM ruled WHERE NOT q AND rules = 0 AND tl <> '' AND e > 0),
exch AS (SELECT q.k, q.i AS ord, q.tl || coalesce(chr(10) || (SELECT string_agg(r.tl, ' ' ORDER BY r.i) FROM replies r WHERE r.k = q.k AND r.e = q.e AND r.r <= 8), '') AS content
  FROM ruled q WHERE q.q AND quotes >= 3),
para AS (SELECT k, list_filter(list_transform(string_split_regex(body, '\r\n\r\n|\n\n'), lambda p: {trimmed('p')}), lambda p: p <> '') AS ps, len(l) AS lines FROM body
  WHERE k IN (SELECT k FROM numbered WHERE quotes < 3)),
grouped AS (SELECT k, i // 25 AS ord, {trimmed("string_agg(line, chr(10) ORDER BY i)")} AS content FROM line
  WHERE k IN (SELECT k FROM para WHERE len(ps) <= 1 AND lines > 21) GROUP BY ALL),
every AS (SELECT k, ord, content FROM exch UNION ALL SELECT k, ord, content FROM grouped
  UNION ALL SELECT k, unnest(range(len(ps))), unnest(ps) FROM para WHERE NOT (len(ps) <= 1 AND lines > 21)),
chunks AS (SELECT k, (row_number() OVER (PARTITION BY k ORDER BY ord) - 1)::INTEGER AS chunk_index, content FROM every WHERE len({trimmed('content')}) > 30)"""


ORACLES["exchange_chunks"] = f"""WITH {MESSAGES.strip()},{_exchange('SELECT conv_id AS k, transcript AS body FROM transcripts')}
SELECT k AS conv_id, chunk_index, content FROM chunks"""
ORACLES["paragraph_chunks"] = f"""WITH {_exchange('SELECT doc_id AS k, text AS body FROM documents').strip()}
SELECT k AS doc_id, chunk_index, content FROM chunks"""
ORACLES["session_split"] = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line,
             unnest(range(len(string_split(regexp_replace(text, '\n$', ''), chr(10))))) AS i FROM documents),
near AS (SELECT *, lower(string_agg(line, '') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) AS near FROM l),
b AS (SELECT *, contains(line, '{SESSION_MARK}') AND NOT contains(near, 'ctrl+e') AND NOT contains(near, 'previous messages') AS b FROM near),
n AS (SELECT *, sum(b::INT) OVER (PARTITION BY doc_id ORDER BY i) AS number, sum(b::INT) OVER (PARTITION BY doc_id) AS found FROM b),
g AS (SELECT doc_id, number, any_value(found) AS found, count(*) AS line_count, string_agg(line, chr(10) ORDER BY i) AS content
  FROM n WHERE number > 0 AND found >= 2 GROUP BY ALL)
SELECT 'in/doc ' || doc_id || '.txt' AS path, found::INTEGER AS sessions_found, number::INTEGER AS number, line_count::INTEGER AS line_count,
  'doc_' || doc_id || '_part' || lpad(number::VARCHAR, 2, '0') || '_unknown_session.txt' AS file_name, md5(content) AS digest FROM g WHERE line_count >= 4"""


def planted(phrases: list[str]) -> str:
    """The text of a document with one of the phrases behind it."""
    return f"(text || chr(10) || chr(10) || {listed(phrases)}[doc_id % {len(phrases)} + 1])"


ORACLES["session_people"] = f"""
WITH t AS (SELECT doc_id, source, {plain(planted(SPOKEN))} AS t FROM documents)
SELECT doc_id, array_to_string(list_sort(list_filter([
  {', '.join(f"CASE WHEN regexp_matches(t, {quoted(f'(?i){chr(92)}b{person}{chr(92)}b')}) THEN {quoted(person)} END" for person in ('Riley', 'Ada', 'Max'))},
  CASE source WHEN 'src1' THEN 'Owner' WHEN 'src7' THEN 'Guest' END], lambda x: x IS NOT NULL)), ',') AS people FROM t"""


def _topic_room(text: str, topics: dict[str, list[str]] = TOPICS) -> str:
    head = f"lower({text})"
    scores = {name: " + ".join(f"contains({head}, {quoted(w)})::INT" for w in words) for name, words in topics.items()}
    best = f"greatest({', '.join(scores.values())})"
    cases = " ".join(f"WHEN {score} = {best} THEN {quoted(name)}" for name, score in scores.items())
    return f"CASE WHEN {best} = 0 THEN 'general' {cases} END"


ORACLES["conversation_rooms"] = f"SELECT doc_id, {_topic_room('text')} AS room FROM documents"
ORACLES["conversation_rooms_default"] = f"""WITH p AS (SELECT doc_id, {planted(PLANTED)} AS t FROM documents)
SELECT doc_id, {_topic_room('t', lex.TOPIC_KEYWORDS)} AS room FROM p"""

PATH = """CASE doc_id % 4 WHEN 0 THEN 'Texts/' || lang || '/' || source || '.md' WHEN 1 THEN 'misc/' || source || '.md'
  WHEN 2 THEN 'misc/joiners_' || source || '.txt' ELSE source || '.txt' END"""


def _project_room(text: str) -> str:
    """Room expression over ``path`` and a text."""

    def mutual(part: str, word: str) -> str:
        return f"contains({part}, {quoted(word)}) OR contains({quoted(word)}, {part})"

    def of(part: str) -> str:
        cases = " ".join(
            f"WHEN {' OR '.join(mutual(part, w.lower()) for w in (*room.keywords, room.name))} THEN {quoted(room.name)}" for room in ROOMS
        )
        return f"CASE {cases} END"

    folders = "string_split(lower(path), '/')[:-2]"
    by_folder = f"list_filter(list_transform({folders}, lambda part: {of('part')}), lambda r: r IS NOT NULL)[1]"
    stem = r"lower(regexp_replace(split_part(path, '/', -1), '\.[^.]*$', ''))"
    by_name = "CASE " + " ".join(f"WHEN {mutual(stem, room.name)} THEN {quoted(room.name)}" for room in ROOMS) + " END"
    head = f"lower({text})"

    def hits(word: str) -> str:
        return f"(len({head}) - len(replace({head}, {quoted(word)}, ''))) // {len(word)}"

    scores = {room.name: "(" + " + ".join(hits(w.lower()) for w in (*room.keywords, room.name)) + ")" for room in ROOMS}
    best = f"greatest({', '.join(scores.values())})"
    by_text = f"CASE WHEN {best} = 0 THEN NULL " + " ".join(f"WHEN {s} = {best} THEN {quoted(n)}" for n, s in scores.items()) + " END"
    return f"coalesce({by_folder}, {by_name}, {by_text}, 'general')"


ORACLES["project_rooms"] = f"WITH p AS (SELECT *, {PATH} AS path FROM documents) SELECT doc_id, {_project_room('text')} AS room FROM p"


def _score(toks: str, kind: str) -> str:
    words = listed(marker.strip("\\b").removesuffix("\\") for marker in MARKERS[kind])
    return f"len(list_filter({toks}, lambda x: list_contains({words}, x)))::INTEGER"


ORACLES["memory_scores"] = f"""WITH t AS (SELECT doc_id, {tokens('text')} AS toks FROM documents)
SELECT doc_id, {', '.join(f"{_score('toks', kind)} AS {kind}" for kind in MARKERS)} FROM t"""

CODE_ON_PLAIN = "|".join(f"(?:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in lex.CODE_LINES if "A-Z_" not in p)


def code_line(line: str) -> str:
    t = trimmed(line)
    return rf"""({t} <> '' AND (regexp_matches({plain(t)}, {quoted(CODE_ON_PLAIN)}) OR regexp_matches({t}, '^\s*[A-Z_]{{2,}}=')
      OR (len(regexp_replace({t}, '[^\p{{L}}]', '', 'g')) / greatest(len({t}), 1) < 0.4 AND len({t}) > 10)))"""


def prose(text: str) -> str:
    kept = trimmed(f"array_to_string(list_filter(string_split({text}, chr(10)), lambda x: NOT {code_line('x')}), chr(10))")
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {text} END"


def mood(text: str, positive: list[str] = POSITIVE, negative: list[str] = NEGATIVE) -> str:
    words = f"list_distinct(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{Mn}}\\p{{Nd}}\\p{{Pc}}]+'))"
    good, bad = (f"len(list_intersect({words}, {listed(v)}))" for v in (positive, negative))
    return f"CASE WHEN {good} > {bad} THEN 'positive' WHEN {bad} > {good} THEN 'negative' ELSE 'neutral' END"


def _default_score(text: str, kind: str) -> str:
    """Hits of the built-in patterns of a memory type in a text."""
    lowered = plain(f"lower({text})")
    return "(" + " + ".join(f"len(regexp_extract_all({lowered}, {quoted(marker)}))" for marker in lex.MEMORY_MARKERS[kind]) + ")::INTEGER"


def _memories(source: str, built_in: bool = False) -> str:
    """CTEs ending in ``memories(k, chunk_index, content, memory_type, confidence)`` over ``(k, body)``."""
    speaker = r"regexp_matches({0}, '^>\s|^(?i:human|user|q)\s*:|^(?i:assistant|ai|a|claude|chatgpt)\s*:')".format(trimmed("line"))
    best = "greatest(decision, preference, milestone, problem, emotional)"
    kind = "CASE " + " ".join(f"WHEN {k} = {best} THEN '{k}'" for k in MARKERS) + " END"
    resolved = "|".join(lex.RESOLUTION_PATTERNS)
    return f"""
mbody AS (SELECT k, body, string_split(body, chr(10)) AS l FROM ({source})),
mline AS (SELECT k, unnest(l) AS line, unnest(range(len(l))) AS i FROM mbody),
mturn AS (SELECT *, {speaker} AS q FROM mline),
mnum AS (SELECT *, sum(q::INT) OVER (PARTITION BY k ORDER BY i) AS e, sum(q::INT) OVER (PARTITION BY k) AS turns, count(*) OVER (PARTITION BY k) AS lines FROM mturn),
mpara AS (SELECT k, list_filter(list_transform(string_split_regex(body, '\\r\\n\\r\\n|\\n\\n'), lambda p: {trimmed('p')}), lambda p: p <> '') AS ps, len(l) AS lines
  FROM mbody WHERE k IN (SELECT k FROM mnum WHERE turns < 3)),
seg AS (SELECT k, e AS ord, string_agg(line, chr(10) ORDER BY i) AS s FROM mnum WHERE turns >= 3 GROUP BY ALL
  UNION ALL SELECT k, i // 25, {trimmed("string_agg(line, chr(10) ORDER BY i)")} FROM mnum WHERE k IN (SELECT k FROM mpara WHERE len(ps) <= 1 AND lines > 20) GROUP BY ALL
  UNION ALL SELECT k, unnest(range(len(ps))), unnest(ps) FROM mpara WHERE NOT (len(ps) <= 1 AND lines > 20)),
pr AS MATERIALIZED (SELECT k, ord, s, {prose('s')} AS p FROM seg WHERE len({trimmed('s')}) >= 20),
tk AS (SELECT *, {tokens('p')} AS toks FROM pr),
sc AS (SELECT k, ord, s, p, {', '.join(f"{_default_score('p', kind) if built_in else _score('toks', kind)} AS {kind}" for kind in MARKERS)} FROM tk),
bs AS (SELECT *, {best} AS best, {kind} AS kind, {mood('p', lex.POSITIVE_WORDS, lex.NEGATIVE_WORDS) if built_in else mood('p')} AS mood, regexp_matches({plain('lower(p)')}, {quoted(resolved)}) AS resolved FROM sc),
cf AS (SELECT *, least(1.0::DOUBLE, (best + CASE WHEN len(s) > 500 THEN 2 WHEN len(s) > 200 THEN 1 ELSE 0 END) / 5.0::DOUBLE) AS confidence,
  CASE WHEN kind = 'problem' AND resolved THEN CASE WHEN emotional > 0 AND mood = 'positive' THEN 'emotional' ELSE 'milestone' END
       WHEN kind = 'problem' AND mood = 'positive' AND milestone > 0 THEN 'milestone'
       WHEN kind = 'problem' AND mood = 'positive' AND emotional > 0 THEN 'emotional' ELSE kind END AS memory_type FROM bs WHERE best > 0),
memories AS (SELECT k, (row_number() OVER (PARTITION BY k ORDER BY ord) - 1)::INTEGER AS chunk_index, {trimmed('s')} AS content, memory_type, confidence
  FROM cf WHERE confidence >= 0.3)"""


ORACLES["memory_scores_default"] = f"""WITH t AS (SELECT doc_id, {planted(PLANTED)} AS t FROM documents)
SELECT doc_id, {', '.join(f"{_default_score('t', kind)} AS {kind}" for kind in lex.MEMORY_MARKERS)} FROM t"""
ORACLES["memory_types_default"] = f"""WITH {_memories(f'SELECT doc_id AS k, {planted(PLANTED)} AS body FROM documents', True).strip()}
SELECT k AS doc_id, chunk_index, content, memory_type, confidence FROM memories"""
ORACLES["sentiment_default"] = f"""WITH t AS (SELECT doc_id, {planted(PLANTED)} AS t FROM documents)
SELECT doc_id, {mood('t', lex.POSITIVE_WORDS, lex.NEGATIVE_WORDS)} AS sentiment FROM t"""
ORACLES["memory_types"] = f"""WITH {_memories('SELECT doc_id AS k, text AS body FROM documents').strip()}
SELECT k AS doc_id, chunk_index, content, memory_type, confidence FROM memories"""
ORACLES["code_line_filter"] = f"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: {code_line('x')}))::INTEGER AS code_lines,
len({prose('text')})::INTEGER AS prose_chars FROM documents"""
ORACLES["sentiment"] = f"SELECT doc_id, {mood('text')} AS sentiment FROM documents"

URL_PATHS = r"""SELECT regexp_extract(url, '^https?://([a-z]+)', 1) || '/' || regexp_replace(url, '^https?://[^/]*/|[?#].*$', '', 'g') AS path FROM pages"""
ORACLES["rooms_from_folders"] = rf"""
WITH p AS (SELECT string_split(path, '/') AS p FROM ({URL_PATHS})),
f AS (SELECT DISTINCT 1 AS level, p[1] AS folder FROM p WHERE len(p) >= 2 UNION SELECT DISTINCT 2, p[2] FROM p WHERE len(p) >= 3 AND NOT list_contains({listed(lex.SKIPPED_FOLDERS)}, p[1])),
r AS (SELECT level, folder, CASE {' '.join(f"WHEN replace(lower(folder), '-', '_') = {quoted(k)} THEN {quoted(v)}" for k, v in FOLDERS.items())}
   WHEN level = 1 AND len(folder) > 2 AND regexp_matches(folder, '^\p{{L}}') THEN replace(replace(lower(folder), '-', '_'), ' ', '_') END AS room FROM f
   WHERE NOT list_contains({listed(lex.SKIPPED_FOLDERS)}, folder))
SELECT room, arg_min(folder, (level, folder)) AS folder, coalesce(nullif(list_position({listed(lex.ROOM_ORDER)}, room), 0) - 1, 2147483647)::INTEGER AS rank,
  min(level)::INTEGER AS level FROM r WHERE room IS NOT NULL GROUP BY room"""
ORACLES["rooms_from_folders_default"] = f"""
WITH m(k, room) AS (VALUES {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in lex.FOLDER_ROOMS.items())}),
f AS (SELECT DISTINCT {listed(sorted(lex.FOLDER_ROOMS))}[page_id % {len(lex.FOLDER_ROOMS)} + 1] AS folder FROM pages),
r AS (SELECT folder, coalesce(room, CASE WHEN len(folder) > 2 AND regexp_matches(folder, '^\\p{{L}}') THEN replace(replace(lower(folder), '-', '_'), ' ', '_') END) AS room
   FROM f LEFT JOIN m ON k = replace(lower(folder), '-', '_') WHERE NOT list_contains({listed(lex.SKIPPED_FOLDERS)}, folder))
SELECT room, min(folder) AS folder, coalesce(nullif(list_position({listed(lex.ROOM_ORDER)}, room), 0) - 1, 2147483647)::INTEGER AS rank, 1 AS level
FROM r WHERE room IS NOT NULL GROUP BY room"""
FILE_ROOMS = {**FOLDERS, "src1": "ones", "src_": "never", "fr_src": "french"}
ORACLES["rooms_from_file_names"] = f"""
WITH m(k, room) AS (VALUES {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in FILE_ROOMS.items())})
SELECT room, count(*) AS n FROM documents JOIN m ON contains(replace(lower(lang || '-' || source || '.md'), '-', '_'), k)
GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, room LIMIT 6"""
ORACLES["ignored_paths"] = rf"""
WITH p AS (SELECT DISTINCT rtrim(path, '/') AS path FROM ({URL_PATHS})),
c AS (SELECT path, string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')) + 1)) AS d FROM p),
t AS (SELECT path, array_to_string(parts[:d], '/') || '/' AS c, CASE WHEN d < len(parts) THEN array_to_string(parts[:d], '/') ELSE array_to_string(parts[:d - 1], '/') END || '/' AS f FROM c),
v AS (SELECT path, CASE WHEN regexp_matches(c, '^m/en/(?:.*/)?[^/]*\.html/') THEN false
  WHEN regexp_matches(c, '^fr/7[^/]0/') THEN true
  WHEN regexp_matches(c, '^m/(?:[^/]+/)*4[^/]*/') THEN true
  WHEN regexp_matches(c, '(^|/)[^/]*\.html/') THEN true
  WHEN regexp_matches(f, '^blog/en/') THEN false
  WHEN regexp_matches(f, '(^|/)blog/') THEN true ELSE false END AS ignored FROM t)
SELECT DISTINCT path FROM v WHERE ignored"""

ORACLES["entity_candidates"] = rf"""
WITH a AS (SELECT {plain('text')} AS t FROM documents),
w AS (SELECT unnest(regexp_extract_all(t, '\b[A-Z][a-z]{{1,19}}\b')) AS name, 1 AS f FROM a
  UNION ALL SELECT unnest(regexp_extract_all(t, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b')), 2 FROM a
  UNION ALL SELECT unnest(regexp_extract_all(t, '\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b')), 3 FROM a)
SELECT name, count(*) AS frequency FROM w
WHERE len(list_intersect(CASE WHEN f = 2 THEN string_split_regex(lower(name), ' +') ELSE [lower(name)] END, {listed(lex.NAME_STOPWORDS)})) = 0
GROUP BY 1 HAVING count(*) >= 3"""
NAME_SIGNALS = [
    *[("spoken", "'dialogue marker (' || {n} || 'x)'", template, 3) for template in lex.DIALOGUE_SLOTS],
    *[("spoken", "chr(39) || name || ' ...' || chr(39) || ' action (' || {n} || 'x)'", template, 2) for template in lex.ACTION_SLOTS],
    *[("addressed", "'addressed directly (' || {n} || 'x)'", template, 4) for template in lex.ADDRESS_SLOTS],
    *[("project", "'project verb (' || {n} || 'x)'", template, 2) for template in lex.PROJECT_SLOTS],
    *[("project", "'versioned/hyphenated (' || {n} || 'x)'", template, 3) for template in lex.VERSION_SLOTS],
    *[("project", "'code file reference (' || {n} || 'x)'", template, 3) for template in lex.CODE_FILE_SLOTS],
]


def _name_scores(body: str, corpus: bool) -> str:
    """CTEs ending in ``named``: classified names per document, or over all of them."""
    hits = ", ".join(
        f"len(regexp_extract_all(t, replace({quoted('(?im)' + template)}, '{{name}}', name)))" for _, _, template, _ in NAME_SIGNALS
    )

    def total(*parts: str) -> str:
        return " + ".join(f"h[{i + 1}] * {weight}" for i, (part, _, _, weight) in enumerate(NAME_SIGNALS) if part in parts)

    def texts(part: str) -> list[str]:
        return [
            f"CASE WHEN h[{i + 1}] > 0 THEN {label.format(n=f'h[{i + 1}]')} END" for i, (kind, label, _, _) in enumerate(NAME_SIGNALS) if kind == part
        ]

    def first_three(items: list[str]) -> str:
        return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)[1:3]"

    person = [*texts("spoken"), "CASE WHEN pronouns > 0 THEN 'pronoun nearby (' || pronouns || 'x)' END", *texts("addressed")]
    sums = ", ".join(f"sum(h[{i + 1}])::BIGINT" for i in range(len(NAME_SIGNALS)))
    counted = (
        f"SELECT 0 AS id, name, sum(f)::BIGINT AS frequency, [{sums}] AS h, sum(pronouns)::BIGINT AS pronouns FROM hits GROUP BY name HAVING sum(f) >= 3"
        if corpus
        else "SELECT id, name, f AS frequency, h, pronouns FROM hits WHERE f >= 3"
    )
    kinds = " + ".join(f"(len(list_filter(ps, lambda x: contains(x, '{word}'))) > 0)::INT" for word in ("dialogue", "action", "pronoun", "addressed"))
    number = "BIGINT" if corpus else "INTEGER"
    return rf"""
body AS (SELECT doc_id AS id, {plain(body)} AS t, string_split({body}, chr(10)) AS l FROM documents),
w AS (SELECT id, unnest(regexp_extract_all(t, '\b[A-Z][a-z]{{1,19}}\b')) AS name, 1 AS f FROM body
  UNION ALL SELECT id, unnest(regexp_extract_all(t, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b')), 2 FROM body
  UNION ALL SELECT id, unnest(regexp_extract_all(t, '\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b')), 3 FROM body),
kept AS (SELECT id, name FROM w
  WHERE len(list_intersect(CASE WHEN f = 2 THEN string_split_regex(lower(name), ' +') ELSE [lower(name)] END, {listed(lex.NAME_STOPWORDS)})) = 0),
c AS (SELECT id, name, count(*) AS f FROM kept GROUP BY ALL {'' if corpus else 'HAVING count(*) >= 3'}),
frames AS (SELECT id, l, list_transform(l, lambda x: regexp_matches({plain('lower(x)')}, {quoted(lex.PRONOUNS)})) AS m FROM body),
framed AS (SELECT id, list_filter(list_transform(l, lambda x, i: CASE WHEN list_bool_or(m[greatest(i - 3, 0) + 1 : greatest(i - 3, 0) + 5]) THEN lower(x) END), lambda x: x IS NOT NULL) AS framed FROM frames),
hits AS (SELECT c.id, name, f, [{hits}] AS h, len(list_filter(framed, lambda x: contains(x, lower(name)))) AS pronouns
  FROM c JOIN body ON body.id = c.id JOIN framed ON framed.id = c.id),
counted AS ({counted}),
scored AS (SELECT id, name, frequency, ({total('spoken', 'addressed')} + pronouns * 2)::{number} AS person_score, ({total('project')})::{number} AS project_score,
  {first_three(person)} AS ps, {first_three(texts('project'))} AS js FROM counted),
ratioed AS (SELECT *, person_score + project_score AS total, person_score / (person_score + project_score)::DOUBLE AS ratio, {kinds} AS kinds FROM scored),
named AS (SELECT *, CASE WHEN total = 0 THEN 'uncertain' WHEN ratio >= 0.7 AND kinds >= 2 AND person_score >= 5 THEN 'person' WHEN ratio >= 0.7 THEN 'uncertain'
    WHEN ratio <= 0.3 THEN 'project' ELSE 'uncertain' END AS type,
  CASE WHEN total = 0 THEN {half_even('least(0.4::DOUBLE, frequency / 50.0::DOUBLE)', 2)} WHEN ratio >= 0.7 AND kinds >= 2 AND person_score >= 5 THEN {half_even('least(0.99::DOUBLE, 0.5 + ratio * 0.5)', 2)}
    WHEN ratio >= 0.7 THEN 0.4::DOUBLE WHEN ratio <= 0.3 THEN {half_even('least(0.99::DOUBLE, 0.5 + (1 - ratio) * 0.5)', 2)} ELSE 0.5::DOUBLE END AS confidence,
  CASE WHEN total = 0 THEN ['appears ' || frequency || 'x, no strong type signals'] WHEN ratio >= 0.7 AND kinds >= 2 AND person_score >= 5 THEN ps
    WHEN ratio >= 0.7 THEN list_append(ps, 'appears ' || frequency || 'x — pronoun-only match')
    WHEN ratio <= 0.3 THEN CASE WHEN len(js) > 0 THEN js ELSE ['appears ' || frequency || 'x'] END
    ELSE list_append(list_concat(ps, js)[1:3], 'mixed signals — needs review') END AS signals FROM ratioed)"""


NAMED_COLUMNS = "name, frequency, person_score, project_score, type, confidence, array_to_string(signals, ',') AS signals"
ORACLES["detected_names"] = f"WITH {_name_scores('text', False).strip()} SELECT id, {NAMED_COLUMNS} FROM named"
ORACLES["spoken_names"] = f"WITH {_name_scores(planted(SPOKEN), False).strip()} SELECT id, {NAMED_COLUMNS} FROM named"
CORPUS_NAMES = _name_scores(planted(SPOKEN), True).strip()
ORACLES["corpus_names"] = f"WITH {CORPUS_NAMES} SELECT {NAMED_COLUMNS} FROM named"
ORACLES["people_and_projects"] = f"WITH {CORPUS_NAMES} SELECT DISTINCT name FROM named WHERE type IN ('person', 'project')"
ORACLES["pronoun_lines"] = f"""
WITH m AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_matches({plain('lower(x)')}, {quoted(lex.PRONOUNS)})) AS m FROM documents)
SELECT doc_id, len(list_filter(m, lambda x, i: list_bool_or(m[greatest(i - 3, 0) + 1 : greatest(i - 3, 0) + 5])))::INTEGER AS lines FROM m"""
ORACLES["detection_scores"] = r"""
WITH p AS (SELECT DISTINCT 'notes/' || regexp_replace(url, '^https?://|[?#].*$', '', 'g') || '/tool_readme.md' AS path FROM pages)
SELECT path, (len(list_filter(string_split(path, '/'), lambda x: trim(x) <> '')) * -5 + 60 + 40)::INTEGER AS score FROM p ORDER BY score DESC, lower(path) LIMIT 10"""

REGISTRY = rf"""
first_words AS (SELECT min(item_id) AS ord, {capitalized("regexp_extract(text, '^([A-Za-z]+)', 1)")} AS name FROM benchmark
  WHERE regexp_extract(text, '^([A-Za-z]+)', 1) <> '' GROUP BY 2),
people AS (SELECT ord, name, CASE WHEN len(name) = 2 THEN name || 'eth' END AS alias, '' AS canonical FROM first_words
  UNION ALL SELECT ord, name || 'eth', name, name FROM first_words WHERE len(name) = 2),
projects AS (SELECT name, count(*) AS ord FROM (SELECT {capitalized(r"regexp_extract(text, '(\w+)\.\s*$', 1)")} AS name FROM documents)
  WHERE regexp_full_match(name, '[A-Z][a-z]+') GROUP BY 1),
research AS (SELECT DISTINCT word, CASE WHEN len(word) % 2 = 0 THEN 'place' ELSE 'person' END AS type, least(len(word), 9) / 10.0::DOUBLE AS confidence, len(word) > 3 AS confirmed
  FROM (SELECT {capitalized(r"regexp_extract(text, '^\w+ (\w+)', 1)")} AS word FROM documents) WHERE regexp_full_match(word, '[A-Z][a-z]+')),
spelled AS (SELECT lower(name) AS key, name, ord, canonical FROM people UNION ALL SELECT lower(alias), name, ord, canonical FROM people WHERE alias IS NOT NULL)"""
ORACLES["learned_people"] = f"""WITH {CORPUS_NAMES},{REGISTRY}
SELECT name, confidence, frequency FROM named WHERE type = 'person' AND confidence >= 0.75 AND name NOT IN (SELECT name FROM people)
  AND lower(name) NOT IN (SELECT lower(name) FROM projects)"""
ORACLES["registry_people"] = f"""WITH {REGISTRY.strip()} SELECT ord, name, coalesce(alias, '') AS aliases, canonical, 'onboarding' AS source, 1.0::DOUBLE AS confidence FROM people"""


def _context_hits(templates: list[str], word: str, context: str) -> str:
    parts = []
    for template in templates:
        head, tail = template.split("{name}")
        parts.append(f"regexp_matches({context}, '(?m)' || {quoted(head)} || {word} || {quoted(tail)})::INT")
    return "(" + " + ".join(parts) + ")"


JUDGED = f"""{_context_hits(lex.PERSON_CONTEXTS, 'key', 'context')} AS ps, {_context_hits(lex.CONCEPT_CONTEXTS, 'key', 'context')} AS cs"""
ORACLES["registry_lookup"] = rf"""WITH {REGISTRY.strip()},
words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all({plain('text')}, '\b[A-Z][a-z]{{1,19}}\b'))) AS word FROM documents),
pn AS (SELECT key, arg_min(name, (ord, canonical <> '', name)) AS person FROM spelled GROUP BY 1),
j AS (SELECT w.doc_id, w.word, lower(w.word) AS key, person, pr.name AS project, r.type AS rtype, r.confidence AS rconf
  FROM words w LEFT JOIN pn ON pn.key = lower(w.word) LEFT JOIN projects pr ON lower(pr.name) = lower(w.word)
  LEFT JOIN research r ON lower(r.word) = lower(w.word) AND r.confirmed),
todo AS (SELECT j.*, (person IS NOT NULL AND key IN (SELECT lower(name) FROM people) AND list_contains({listed(COMMON)}, key))
   OR (person IS NULL AND project IS NULL AND rtype = 'person' AND list_contains({listed(COMMON)}, key)) AS judge FROM j),
hits AS (SELECT doc_id, word, {JUDGED} FROM (SELECT t.doc_id, t.word, t.key, {plain('lower(d.text)')} AS context FROM todo t JOIN documents d USING (doc_id) WHERE judge)),
v AS (SELECT t.*, CASE WHEN ps > cs THEN 'person' WHEN cs > ps THEN 'concept' END AS verdict, ps, cs FROM todo t LEFT JOIN hits h ON h.doc_id = t.doc_id AND h.word = t.word)
SELECT doc_id, word, coalesce(verdict, CASE WHEN person IS NOT NULL THEN 'person' WHEN project IS NOT NULL THEN 'project' ELSE coalesce(rtype, 'unknown') END) AS type,
  round(CASE WHEN verdict = 'person' THEN least(0.95, 0.7 + ps * 0.1) WHEN verdict = 'concept' THEN least(0.9, 0.7 + cs * 0.1)
    WHEN person IS NOT NULL OR project IS NOT NULL THEN 1.0 ELSE coalesce(rconf, 0.0) END::DOUBLE, 4) AS confidence,
  CASE WHEN verdict = 'concept' THEN 'context_disambiguated' WHEN person IS NOT NULL OR project IS NOT NULL THEN 'onboarding' WHEN rtype IS NOT NULL THEN 'wiki' ELSE 'none' END AS source,
  CASE WHEN verdict IS NULL AND person IS NOT NULL THEN person WHEN verdict IS NULL AND project IS NOT NULL THEN project ELSE word END AS name FROM v"""
ORACLES["people_in_queries"] = rf"""WITH {REGISTRY.strip()},
d AS MATERIALIZED (SELECT doc_id AS query_id, {plain('lower(text)')} AS context FROM documents),
f AS (SELECT query_id, key, name, ord, context, key IN (SELECT lower(name) FROM people) AND list_contains({listed(COMMON)}, key) AS flag
  FROM d JOIN spelled ON regexp_matches(context, '\b' || key || '\b')),
h AS (SELECT *, CASE WHEN flag THEN {_context_hits(lex.PERSON_CONTEXTS, 'key', 'context')} > {_context_hits(lex.CONCEPT_CONTEXTS, 'key', 'context')} ELSE true END AS ok FROM f)
SELECT query_id, name, min(ord) AS ord FROM h WHERE ok GROUP BY ALL"""
ORACLES["unknown_words"] = rf"""WITH {REGISTRY.strip()},
words AS (SELECT doc_id AS query_id, unnest(list_distinct(regexp_extract_all({plain('text')}, '\b[A-Z][a-z]{{2,15}}\b'))) AS word FROM documents)
SELECT query_id, word FROM words WHERE NOT list_contains({listed(COMMON)}, lower(word)) AND lower(word) NOT IN (SELECT key FROM spelled)
AND lower(word) NOT IN (SELECT lower(name) FROM projects) AND lower(word) NOT IN (SELECT lower(word) FROM research WHERE confirmed)"""
ORACLES["registry_summary"] = f"""WITH {REGISTRY.strip()},
p AS (SELECT * FROM people ORDER BY ord, canonical <> '', name LIMIT 8)
SELECT (SELECT count(*) FROM people) AS people, (SELECT string_agg(name, ', ' ORDER BY ord, canonical <> '', name) FROM p) AS preview,
(SELECT count(*) FROM projects) AS projects, (SELECT count(DISTINCT lower(name)) FROM people WHERE list_contains({listed(COMMON)}, lower(name))) AS ambiguous,
(SELECT count(*) FROM research) AS researched"""
ORACLES["research_confirmed"] = f"""WITH {REGISTRY.strip()}
SELECT coalesce(word, name) AS word, CASE WHEN name IS NOT NULL THEN 'person' ELSE type END AS type, coalesce(research.confidence, 0.9)::DOUBLE AS confidence,
coalesce(confirmed, false) OR name IS NOT NULL AS confirmed FROM research FULL JOIN people ON lower(word) = lower(name)"""
ORACLES["payload_types"] = r"""
WITH p AS (SELECT page_id, regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang, page_id % 7 = 3 AS missing, page_id % 7 = 5 AS failed, page_id % 5 = 1 AS several, page_id % 2 = 0 AS listed FROM pages)
SELECT page_id,
 CASE WHEN missing THEN 'person' WHEN failed THEN 'unknown' WHEN several THEN CASE WHEN listed THEN 'person' ELSE 'ambiguous' END
      WHEN lang IN ('fr', 'es') THEN 'person' WHEN lang = 'de' THEN 'place' ELSE 'concept' END AS type,
 CASE WHEN missing THEN 0.7 WHEN failed THEN 0.0 WHEN several THEN CASE WHEN listed THEN 0.65 ELSE 0.4 END
      WHEN lang = 'fr' THEN 0.9 WHEN lang IN ('es', 'de') THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence,
 CASE WHEN missing OR failed THEN '' ELSE lang || CASE lang WHEN 'fr' THEN ' is a given name. ' WHEN 'de' THEN ', a city in the north. ' WHEN 'es' THEN ': old norse name ' ELSE ' ' END || lower((SELECT html FROM pages q WHERE q.page_id = p.page_id)) END[:200] AS summary,
 CASE WHEN missing OR failed THEN '' ELSE lang END AS title,
 CASE WHEN missing THEN 'not found - likely a proper noun or unusual name' WHEN NOT failed AND several AND listed THEN 'disambiguation page with name entries' ELSE '' END AS note FROM p"""


def _codes(source: str) -> str:
    """CTEs ending in ``codes(k, codes)`` over ``(k, body)``; comma-joined, first three."""
    return rf"""
cw AS (SELECT k, unnest(string_split_regex({trimmed('body')}, '\s+')) AS w, unnest(range(len(string_split_regex({trimmed('body')}, '\s+')))) AS i FROM ({source})),
cc AS (SELECT k, i, regexp_replace(w, '[^a-zA-Z]', '', 'g') AS c FROM cw WHERE i > 0),
cd AS (SELECT k, upper(c[:3]) AS code, min(i) AS i FROM cc WHERE regexp_full_match(c, '[A-Z][a-z]+') AND NOT list_contains({listed(lex.SHORTHAND_STOPWORDS)}, lower(c)) GROUP BY ALL),
cr AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS r FROM cd),
codes AS (SELECT k, string_agg(code, ',' ORDER BY r) AS codes FROM cr WHERE r <= 3 GROUP BY 1)"""


def _topics(source: str) -> str:
    return rf"""
tw AS (SELECT k, unnest(regexp_extract_all(body, '[a-zA-Z][a-zA-Z_-]{{2,}}')) AS w FROM ({source})),
tg AS (SELECT k, lower(w) AS w, sum(1 + CASE WHEN regexp_matches(w, '^[A-Z]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(w, '[_-]') OR regexp_matches(w[2:], '[A-Z]') THEN 2 ELSE 0 END) AS n
  FROM tw WHERE NOT list_contains({listed(lex.SHORTHAND_STOPWORDS)}, lower(w)) GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, w) AS r FROM tg),
topics AS (SELECT k, string_agg(w, ',' ORDER BY r) AS topics FROM tr WHERE r <= 3 GROUP BY 1)"""


def _signals(name: str, source: str, table: dict[str, str]) -> str:
    rows = ", ".join(f"({i}, {quoted(k)}, {quoted(v)})" for i, (k, v) in enumerate(table.items()))
    return f"""
{name}_v(o, n, c) AS (VALUES {rows}),
{name}_g AS (SELECT k, c, min(o) AS o FROM ({source}) JOIN {name}_v ON contains(lower(body), n) GROUP BY ALL),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) AS r FROM {name}_g),
{name} AS (SELECT k, string_agg(c, ',' ORDER BY r) AS codes FROM {name}_r WHERE r <= 3 GROUP BY 1)"""


def _sentence(source: str, words: list[str]) -> str:
    hits = " + ".join(f"contains(lower(s), {quoted(w)})::INT" for w in words)
    return f"""
sw AS (SELECT k, unnest(string_split_regex(body, '[.!?\\n]+')) AS raw, unnest(range(len(string_split_regex(body, '[.!?\\n]+')))) AS i FROM ({source})),
st AS (SELECT k, i, {trimmed('raw')} AS s FROM sw),
sx AS (SELECT *, ({hits}) * 2 + (len(s) < 80)::INT + (len(s) < 40)::INT - CASE WHEN len(s) > 150 THEN 2 ELSE 0 END AS score FROM st WHERE len(s) > 10),
sr AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, len(s), i) AS r FROM sx),
sentence AS (SELECT k, CASE WHEN len(s) > 55 THEN s[:52] || '...' ELSE s END AS sentence FROM sr WHERE r = 1)"""


DOCS = "SELECT doc_id AS k, text AS body FROM documents"
ORACLES["shorthand_entities"] = f"""WITH {_codes(DOCS).strip()},
n AS (SELECT doc_id, concat_ws(',', CASE WHEN contains(lower(text), 'therin') THEN 'THR' END, CASE WHEN contains(lower(text), 'there') THEN 'TRE' END) AS named FROM documents)
SELECT doc_id, coalesce(codes, '') AS codes, CASE WHEN named <> '' THEN named ELSE coalesce(codes, '') END AS configured FROM n LEFT JOIN codes ON k = doc_id"""
ORACLES["shorthand_topics"] = f"""WITH {_topics(DOCS).strip()} SELECT doc_id, coalesce(topics, '') AS topics FROM documents LEFT JOIN topics ON k = doc_id"""
SIGNAL_TABLE = {"the": "ART", "tion": "NOM", "la ": "ART", "ción": "NOM", "und": "CON", "eau": "ROOT", "en ": "PRE"}
ORACLES["shorthand_signals"] = f"""WITH {_signals('sig', DOCS, SIGNAL_TABLE).strip()}
SELECT doc_id, coalesce(codes, '') AS signals FROM documents LEFT JOIN sig ON k = doc_id"""
ORACLES["shorthand_key_sentence"] = f"""WITH {_sentence(DOCS, ['the', 'tion', 'ción', 'eau', 'und']).strip()}
SELECT doc_id, coalesce(sentence, '') AS sentence FROM documents LEFT JOIN sentence ON k = doc_id"""

DRAWER_TEXTS = "SELECT id AS k, text AS body FROM drawers"
COMPRESSED = f"""WITH {DRAWERS.strip()},{_codes(DRAWER_TEXTS)},{_topics(DRAWER_TEXTS)},{_sentence(DRAWER_TEXTS, lex.DECISION_WORDS)},
{_signals('emo', DRAWER_TEXTS, lex.EMOTION_SIGNALS).strip()},
{_signals('flag', DRAWER_TEXTS, lex.FLAG_SIGNALS).strip()},
notation AS (SELECT d.id, wing, room, source_file, text, wing || '|' || room || '|' || date || '|' || regexp_replace(source_file, '\\.[^.]*$', '') || chr(10) ||
  concat_ws('|', '0:' || coalesce(replace(codes.codes, ',', '+'), '???'), coalesce(replace(topics, ',', '_'), 'misc'),
    CASE WHEN coalesce(sentence, '') <> '' THEN '"' || replace(sentence, '"', '''') || '"' END, replace(emo.codes, ',', '+'), replace(flag.codes, ',', '+')) AS compressed
  FROM drawers d LEFT JOIN codes ON codes.k = d.id LEFT JOIN topics ON topics.k = d.id LEFT JOIN sentence ON sentence.k = d.id
  LEFT JOIN emo ON emo.k = d.id LEFT JOIN flag ON flag.k = d.id),
sized AS (SELECT id, wing, room, source_file, compressed, {estimate('text')} AS original_tokens, {estimate('compressed')} AS compressed_tokens,
  len(text)::INTEGER AS original_chars, len(compressed)::INTEGER AS compressed_chars FROM notation)"""
ORACLES["shorthand_compress"] = f"{COMPRESSED} SELECT *, {half_even('original_tokens / greatest(compressed_tokens, 1)', 1)} AS ratio FROM sized"
ORACLES["compression_totals"] = f"""{COMPRESSED} SELECT count(*) AS drawers, sum(original_chars)::BIGINT AS original_chars, sum(compressed_chars)::BIGINT AS compressed_chars,
sum(original_tokens)::BIGINT AS original_tokens, sum(compressed_tokens)::BIGINT AS compressed_tokens FROM sized"""

FLAT = f"replace({trimmed('text')}, chr(10), ' ')"


def _story(where: str) -> str:
    return f"""
+ top AS (SELECT id, room, coalesce(importance, 3.0)::DOUBLE AS score, source_file, {FLAT} AS t FROM drawers WHERE {where} ORDER BY score DESC, id LIMIT 15),
story AS (SELECT id, room, score, '  - ' || CASE WHEN len(t) > 200 THEN t[:197] || '...' ELSE t END || '  (' || source_file || ')' AS line FROM top)"""


PLACED = """placed AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY score DESC, id) = 1 AS opens, row_number() OVER (ORDER BY room, score DESC, id) AS place FROM lined),
used AS (SELECT *, sum(len(line) + CASE WHEN opens THEN len(room) + 3 ELSE 0 END) OVER (ORDER BY place)::BIGINT AS used FROM placed)"""
ORACLES["l1_story_rows"] = over_drawers(f"{_story('true')} SELECT id, room, score, line FROM story")
ORACLES["l1_story_budget"] = over_drawers(
    f"{_story('true')}, lined AS (SELECT id, room, score, rpad(line, 300, '.') AS line FROM story), {PLACED} SELECT id, place::INTEGER AS place, used, used <= 3200 AS fits FROM used"
)
ORACLES["l1_story"] = over_drawers(
    f"""{_story(f"wing = '{WING}'")}, lined AS (SELECT * FROM story), {PLACED},
cut AS (SELECT *, used <= 3200 AS fits, min(CASE WHEN used > 3200 THEN place END) OVER () AS over_at FROM used)
SELECT '## L1 - ESSENTIAL STORY' || chr(10) || string_agg(CASE WHEN opens THEN chr(10) || '[' || room || ']' || chr(10) ELSE '' END ||
  CASE WHEN fits THEN line ELSE '  ... (more in L3 search)' END, chr(10) ORDER BY place) AS rendered FROM cut WHERE over_at IS NULL OR place <= over_at"""
)
ORACLES["l2_recall"] = over_drawers(
    f"""+ w AS (SELECT id, room, source_file, {FLAT} AS t FROM drawers WHERE wing = '{WING}')
SELECT id, '  [' || room || '] ' || CASE WHEN len(t) > 300 THEN t[:297] || '...' ELSE t END || '  (' || source_file || ')' AS entry,
(SELECT count(*) FROM w) AS total FROM w ORDER BY id LIMIT 10"""
)
DIARY = f"""WITH e AS (SELECT DISTINCT 'wing_agent_' || role AS wing, 'topic_' || turn AS topic, 'Agent ' || role AS agent, {trimmed('text')} AS text FROM conversations),
diary AS (SELECT 'diary_' || wing || '_' || topic || '_' || {digest('wing', 'topic', 'text')} AS id, * FROM e)"""
ORACLES["diary_write"] = f"""{DIARY} SELECT id, wing, 'diary' AS room, 'hall_diary' AS hall, topic, 'diary_entry' AS type, agent, '{NOW[:10]}' AS date FROM diary"""
ORACLES["diary_recent"] = f"""{DIARY}, u AS (SELECT *, '2024-01-0' || topic[7] AS ts FROM diary WHERE wing = 'wing_agent_user')
SELECT id, '{NOW[:10]}' AS date, ts AS timestamp, topic, text AS content, (SELECT count(*) FROM u) AS total FROM u ORDER BY ts DESC, id LIMIT 20"""
ORACLES["stack_status"] = "SELECT count(*) AS total_drawers, 15 AS story_drawers, 3200 AS story_chars FROM documents"

CHANGES = f"""WITH RECURSIVE stored AS MATERIALIZED (SELECT DISTINCT 'drawer_' || lang || '_stored_' || {digest('lang', "'stored'", 'source', trimmed('text'))} AS id, {trimmed('text')} AS text FROM documents),
asked AS MATERIALIZED (SELECT DISTINCT 'drawer_new_wing_inbox_bench_' || {digest("'new_wing'", "'inbox_bench'", "'bench.txt'", trimmed('text'))} AS id, 'new_wing' AS wing, 'inbox_bench' AS room,
    'bench.txt' AS source_file, {trimmed('text')} AS text FROM benchmark
  UNION SELECT DISTINCT 'drawer_' || lang || '_stored_' || {digest('lang', "'stored'", 'source', trimmed('text'))}, lang, 'stored', source, {trimmed('text')} FROM documents),
q AS (SELECT id AS qid, {token_set('text')} AS q FROM asked WHERE id NOT IN (SELECT id FROM stored)),
t AS (SELECT id, {token_set('text')} AS t FROM stored),
hit AS (SELECT qid, least(count(*), 5) AS matches FROM q JOIN t ON {containment('q', 't')} >= 0.9 WHERE len(q) > 0 GROUP BY 1),
own AS MATERIALIZED (SELECT a.qid, list(b.qid) AS before FROM q a JOIN q b ON b.qid < a.qid AND {containment('a.q', 'b.q')} >= 0.9 WHERE len(a.q) > 0 GROUP BY 1),
line AS MATERIALIZED (SELECT qid, matches, before, row_number() OVER (ORDER BY qid) AS k FROM q LEFT JOIN hit USING (qid) LEFT JOIN own USING (qid)),
walk AS (SELECT 0 AS k, []::VARCHAR[] AS inserted UNION ALL
  SELECT line.k, CASE WHEN matches > 0 OR list_has_any(inserted, coalesce(before, [])) THEN inserted ELSE list_append(inserted, qid) END FROM walk JOIN line ON line.k = walk.k + 1),
inserted AS (SELECT unnest(inserted) AS id FROM (SELECT inserted FROM walk ORDER BY k DESC LIMIT 1)),
outcomes AS (SELECT asked.id, wing, room, CASE WHEN asked.id IN (SELECT id FROM stored) THEN 'noop' WHEN asked.id IN (SELECT id FROM inserted) THEN 'inserted' ELSE 'duplicate' END AS outcome,
  least(5, coalesce(matches, 0) + coalesce(len(list_intersect(before, (SELECT list(id) FROM inserted))), 0))::BIGINT AS matches FROM asked LEFT JOIN line ON line.qid = asked.id)"""
ORACLES["add_drawer_outcomes"] = f"{CHANGES} SELECT * FROM outcomes"
ORACLES["request_rules"] = f"""
WITH r AS (SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'wing has no usable characters' WHEN 2 THEN 'wing has more than 80 characters' WHEN 3 THEN 'room is missing'
  WHEN 4 THEN 'content is missing' WHEN 5 THEN CASE WHEN len({trimmed('repeat(text, 100)')}) > 200000 THEN 'content has more than 200000 characters' ELSE '' END
  ELSE '' END AS reason FROM documents)
SELECT doc_id, CASE reason WHEN '' THEN 'accepted' ELSE 'rejected' END AS status, reason FROM r"""
ORACLES["journal_counts"] = f"""{CHANGES} SELECT 'add_drawer' AS operation, phase, count(*) AS n FROM (SELECT 'intent' AS phase FROM outcomes
UNION ALL SELECT CASE outcome WHEN 'inserted' THEN 'success' ELSE outcome END FROM outcomes) GROUP BY ALL"""
ORACLES["new_drawers"] = f"{CHANGES} SELECT id, wing, room, source_file FROM asked WHERE id NOT IN (SELECT id FROM stored)"
ORACLES["delete_outcomes"] = f"{CHANGES} SELECT id, CASE WHEN id IN (SELECT id FROM stored) THEN 'success' ELSE 'not_found' END AS outcome FROM asked"
ORACLES["delete_by_source"] = over_drawers(
    """SELECT id, source_file FROM drawers WHERE upper(source_file) NOT IN (
SELECT upper(source) FROM documents GROUP BY 1 HAVING sum(len(text)) % 2 = 0)"""
)
ORACLES["file_states"] = over_drawers(
    """+ first AS (SELECT lower(source_file || '/' || wing) AS key, arg_min(doc_id % 11 <> 0, id) AS timed FROM drawers GROUP BY 1),
f AS (SELECT DISTINCT upper(source) || '/' || lang AS source_file FROM documents)
SELECT source_file, CASE WHEN timed THEN 'current' ELSE 'stale' END AS state FROM f JOIN first ON key = lower(source_file)
UNION ALL SELECT source_file || 'x', 'new' FROM f"""
)
ORACLES["repair_order"] = over_drawers("SELECT id, wing, room FROM drawers")
ORACLES["compressed_upsert"] = f"""{COMPRESSED} SELECT id, wing, CASE WHEN wing = '{WING}' THEN compressed ELSE md5(text) END AS text FROM notation"""
ORACLES["compressed_collection"] = f"{COMPRESSED} SELECT id, wing, compressed AS text FROM notation"
MOVED = """+ moved AS (SELECT id, text, CASE WHEN doc_id % 9 <> 0 THEN wing ELSE ' ' END AS wing, room, source_file, doc_id::INTEGER AS chunk_index, doc_id AS source_mtime,
  (doc_id * 2)::INTEGER AS original_tokens, CASE WHEN doc_id % 2 = 1 THEN 'True' ELSE 'False' END AS topic, coalesce(trunc(importance), -1.0)::DOUBLE AS importance, -1.0::DOUBLE AS weight
  FROM drawers WHERE doc_id % 10 <> 0 AND trim(text) <> '')"""
ORACLES["migrate_pivot"] = over_drawers(f"{MOVED} SELECT * FROM moved")
ORACLES["migrate_summary"] = over_drawers(f"{MOVED} SELECT CASE WHEN trim(wing) = '' THEN '?' ELSE wing END AS wing, room, count(*) AS n FROM moved GROUP BY ALL")
ORACLES["migrate_written"] = ORACLES["migrate_summary"]
ORACLES["metadata_projection"] = over_drawers(
    """SELECT id, '{"wing":"' || wing || '","room":"' || room || '","source_file":"' || source_file || '","chunk_index":0,"filed_at":"' || filed_at || '"'
|| coalesce(',"hall":"' || hall || '"', '') || ',"date":"' || date || '"' || coalesce(',"importance":' || importance::DOUBLE, '') || '}' AS metadata FROM drawers"""
)

MINED = f"""WITH RECURSIVE files AS (SELECT doc_id, lang, source, text, {PATH} || '.' || doc_id AS path FROM documents),
placed AS MATERIALIZED (SELECT doc_id, path, '/p/' || path AS source_file, {_project_room(trimmed('text'))} AS room FROM files),
{_chunks('doc_id', f"SELECT doc_id, {trimmed('text')} AS body FROM documents WHERE len({trimmed('text')}) >= 50").strip()},
mined AS (SELECT 'drawer_proj_' || room || '_' || substr(sha256(source_file || chunk_index), 1, 24) AS id, room, source_file, doc_id AS source_mtime, chunk_index, md5(content) AS digest
  FROM pieces JOIN placed ON k = doc_id)"""
ORACLES["mine_project"] = f"{MINED} SELECT * FROM mined"
ORACLES["mine_project_totals"] = f"""{MINED} SELECT (SELECT count(*) FROM documents) AS files, count(DISTINCT source_file) AS processed,
(SELECT count(*) FROM documents) - count(DISTINCT source_file) AS skipped, count(*) AS drawers FROM mined"""
ORACLES["mine_limited_totals"] = f"""{MINED}, small AS (SELECT doc_id FROM documents WHERE strlen(text) <= 2000),
kept AS (SELECT mined.* FROM mined JOIN small ON source_mtime = small.doc_id)
SELECT (SELECT count(*) FROM small) AS files, count(DISTINCT source_file) AS processed,
(SELECT count(*) FROM small) - count(DISTINCT source_file) AS skipped, count(*) AS drawers,
(SELECT count(*) FROM documents) - (SELECT count(*) FROM small) AS rejected FROM kept"""
ORACLES["exported_collections"] = """SELECT doc_id::VARCHAR AS id, lang AS wing, source AS room, doc_id::INTEGER AS chunk_index,
'read' AS status, md5(text) AS digest FROM documents"""
ORACLES["mine_project_rooms"] = f"{MINED} SELECT room, count(DISTINCT source_file) AS n, count(*) AS drawers FROM mined GROUP BY 1"

SINGLE = """CASE conv_id % 5
  WHEN 0 THEN to_json({'type': role, 'message': {'content': text}})::VARCHAR
  WHEN 1 THEN '{"type":"session_meta"}' || chr(10) || 'not json' || chr(10) ||
    to_json({'type': 'event_msg', 'payload': {'type': CASE role WHEN 'user' THEN 'user_message' ELSE 'agent_message' END, 'message': text}})::VARCHAR
  WHEN 2 THEN to_json({'chat_messages': [{'role': role, 'content': [{'type': 'text', 'text': text}]}]})::VARCHAR
  WHEN 3 THEN '{"mapping":{"root":{"parent":null,"children":["n0"],"message":null},"n0":' ||
    to_json({'parent': 'root', 'children': []::VARCHAR[], 'message': {'author': {'role': role}, 'content': {'parts': [text]}}})::VARCHAR || '}}'
  ELSE to_json([{'type': 'message', 'user': role, 'text': text}])::VARCHAR END"""
CHATS = f"""{MESSAGES.strip()},
chats AS MATERIALIZED (SELECT conv_id, transcript FROM transcripts WHERE n >= 2 UNION ALL SELECT conv_id, {SINGLE} FROM m WHERE n = 1),
usable AS (SELECT 'chats/c' || conv_id || '.json' AS k, transcript AS body FROM chats WHERE len({trimmed('transcript')}) >= 30)"""
MINED_ID = "'drawer_chats_' || room || '_' || substr(sha256(k || chunk_index), 1, 24) AS id"
ORACLES["mine_conversations"] = f"""WITH {CHATS},{_exchange('SELECT k, body FROM usable')},
placed AS (SELECT c.k, chunk_index, content, {_topic_room('u.body')} AS room FROM chunks c JOIN usable u ON u.k = c.k)
SELECT {MINED_ID}, room, k AS source_file, chunk_index, content AS text FROM placed"""
ORACLES["mine_conversation_memories"] = f"""WITH {CHATS},{_memories('SELECT k, body FROM usable')},
placed AS (SELECT k, chunk_index, content, memory_type AS room FROM memories)
SELECT {MINED_ID}, room, k AS source_file, chunk_index, content AS text FROM placed"""
ORACLES["pending_files"] = f"""WITH files AS (SELECT doc_id, '/p/' || {PATH} || '.' || doc_id AS source_file FROM documents)
SELECT source_file, CASE doc_id % 3 WHEN 0 THEN 'new' ELSE 'stale' END AS state FROM files WHERE doc_id % 3 <> 1"""

__all__ = ["ORACLES"]
