"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

import string

from cairnlake.llm import mixing

KEY = (
    "translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), "
    f"'{string.ascii_uppercase}', '{string.ascii_lowercase}')"
)

LINES = f"""
lines AS (
    SELECT doc_id, pos, line, {KEY} AS key
    FROM (
        SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM {{docs}})
    )
),
frequent AS (
    SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
),
marked AS (
    SELECT doc_id, pos, line, key IN (SELECT key FROM frequent) AS gone FROM lines
)"""

OP6 = f"""
WITH {LINES.format(docs="documents")}
SELECT doc_id,
       count(*) AS n_lines,
       CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

SIZE = f"len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}'))"

MIX = f"""
sized AS (SELECT *, {SIZE} AS size FROM {{docs}}),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM sized GROUP BY source
),
levels AS (
    SELECT *, 2 * source_size AS cap, 3 * sum(source_size) OVER () AS everything,
           sum(weight) OVER () AS weights,
           coalesce(sum(2 * source_size) OVER earlier, 0) AS cap_before,
           coalesce(sum(weight) OVER earlier, 0) AS weight_before
    FROM sources
    WINDOW earlier AS (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, source NULLS LAST
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
stopped AS (
    SELECT *, 2 * cap * (weights - weight_before) <= weight * (everything - 2 * cap_before) AS stops FROM levels
),
targets AS (
    SELECT source, source_size,
           CASE WHEN stops THEN CAST(cap AS DOUBLE)
                ELSE CAST(weight AS DOUBLE)
                     * CAST(everything - 2 * coalesce(sum(cap) FILTER (stops) OVER (), 0) AS DOUBLE)
                     / CAST(2 * sum(weight) FILTER (NOT stops) OVER () AS DOUBLE) END AS target
    FROM stopped
),
taken AS (
    SELECT sized.*, source_size, target,
           CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
           CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), '') || ':7'), 1, 13) AS BIGINT)
                AS DOUBLE) / 4503599627370496.0 AS chance
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
),
copied AS (
    SELECT *, CAST(floor(rate) AS INTEGER) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END AS copies
    FROM taken
)"""

OP8 = f"""
WITH {MIX.format(docs="documents")}
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken FROM copied
"""

REACH = """
reach AS (
    SELECT node, node AS other FROM nodes
    UNION
    SELECT reach.node, links.b AS other FROM reach JOIN links ON reach.other = links.a
),
parts AS (SELECT node, min(other) AS part FROM reach GROUP BY node)"""

OP9 = f"""
WITH RECURSIVE valid AS (
    SELECT vec_id AS node, label, CAST(embedding AS DOUBLE[]) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
nodes AS (SELECT node FROM valid),
links AS (
    SELECT l.node AS a, r.node AS b
    FROM valid l JOIN valid r ON l.label = r.label AND l.node <> r.node AND len(l.e) = len(r.e)
    WHERE list_cosine_similarity(l.e, r.e) >= 0.98
),{REACH},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(part, vec_id) AS component_id,
       coalesce(vec_id = coalesce(part, vec_id), false) AS kept
FROM embeddings LEFT JOIN parts ON vec_id = parts.node LEFT JOIN counts ON vec_id = counts.a
"""

OP10 = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\x09-\\x0D]+'), lambda w: w <> '') AS w
    FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
),
sequences AS (SELECT min(doc_id) AS node, w FROM words WHERE len(w) > 0 GROUP BY w),
nodes AS (SELECT node FROM sequences),
bags AS (
    SELECT node, shingle, count(*) AS n
    FROM (
        SELECT node, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: w[i : i + 4])) AS shingle FROM sequences
    )
    GROUP BY node, shingle
),
sizes AS (SELECT node, sum(n) AS size FROM bags GROUP BY node),
shared AS (
    SELECT l.node AS a, r.node AS b, sum(least(l.n, r.n)) AS common
    FROM bags l JOIN bags r ON l.shingle = r.shingle AND l.node <> r.node
    GROUP BY l.node, r.node
),
links AS (
    SELECT a, b FROM shared JOIN sizes sa ON sa.node = a JOIN sizes sb ON sb.node = b
    WHERE 5 * common >= 4 * (sa.size + sb.size - common)
),{REACH}
SELECT d.doc_id, coalesce(part, d.doc_id) AS group_id, coalesce(d.doc_id = coalesce(part, d.doc_id), true) AS kept
FROM documents d
LEFT JOIN words USING (doc_id)
LEFT JOIN sequences s ON s.w = words.w
LEFT JOIN parts ON parts.node = s.node
"""

OP11 = """
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
keys AS (
    SELECT doc_id, unnest(list_transform(range(1, len(words) - 18), lambda s: {'s': s, 'key': array_to_string(list_slice(words, s, s + 19), ' ')}), recursive := true)
    FROM docs
),
again AS (
    SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY key ORDER BY doc_id, s) AS place FROM keys) WHERE place > 1
),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS pos FROM again),
spread AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM docs),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
    FROM spread ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"

OP12 = f"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
    FROM documents
),
words AS (SELECT doc, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
vocabulary AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (
    SELECT g.lang, g.source, coalesce(sum(n), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source
    GROUP BY ALL
),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
           1 + 1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT // (g.total + v.terms)::HUGEINT AS p,
           1 + 1000000000 * (k.n + 1)::HUGEINT // (v.total + v.terms)::HUGEINT AS q
    FROM groups g JOIN kept k ON g.lang = k.lang JOIN vocabulary v ON g.lang = v.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""

RANKED_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), {LOWER}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP13 = f"""
WITH docs AS (SELECT doc_id, {RANKED_TERMS} AS terms FROM documents),
sums AS (SELECT count(*) AS documents, sum(len(terms))::BIGINT AS total FROM docs WHERE len(terms) > 0),
entries AS (
    SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM docs) GROUP BY ALL
),
wanted AS (SELECT DISTINCT item_id, unnest({RANKED_TERMS}) AS term FROM benchmark),
weights AS (
    SELECT item_id, term, floor(1000 * ln((2 * documents + 2) / (2 * coalesce(df, 0) + 1)))::BIGINT AS w
    FROM wanted LEFT JOIN (SELECT term, count(*) AS df FROM entries GROUP BY term) USING (term), sums
),
scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // total))))::BIGINT AS score
    FROM weights JOIN entries USING (term), sums GROUP BY item_id, doc_id
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES: dict[str, str] = {
    "op6_line_dedup": OP6,
    "op8_source_mix": OP8,
    "op9_near_vectors": OP9,
    "op10_near_texts": OP10,
    "op11_word_windows": OP11,
    "op12_divergence": OP12,
    "op13_lexical_ranking": OP13,
}
