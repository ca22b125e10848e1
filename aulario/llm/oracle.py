"""DuckDB SQL for the results of the corpus queries, where SQL can express them."""

from __future__ import annotations

OP1_EXACT_TOP_K = """
WITH vectors AS (
    SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored
QUALIFY rank <= 10
"""

OP2_SUBSTRING_DEDUP = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS w
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM texts)
), firsts AS (
    SELECT w, min(doc_id) AS first_doc FROM windows GROUP BY w
), covered AS (
    SELECT DISTINCT doc_id, i + j AS i
    FROM windows JOIN firsts USING (w), range(0, 13) AS steps(j)
    WHERE first_doc < doc_id
), kept AS (
    SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS text, count(*) AS n
    FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts) p
    ANTI JOIN covered c ON p.doc_id = c.doc_id AND p.i = c.i
    GROUP BY p.doc_id
)
SELECT t.doc_id, len(t.words)::BIGINT AS n_words, (len(t.words) - coalesce(k.n, 0))::BIGINT AS n_removed,
    sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""

OP4_CHAT_FORMATTING = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    WHERE conv_id IS NOT NULL
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), written AS (
    SELECT *, len(role) + len(text) + len(regexp_replace(role || text, '[^\\]', '', 'g'))
        + len(regexp_extract_all(role, '</?turn>|<\|')) + len(regexp_extract_all(text, '</?turn>|<\|')) + 22 AS chars
    FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
        AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""

OP7_BENCHMARK_DECONTAMINATION = r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), items AS (
    SELECT item_id, words, least(10, len(words)) AS n
    FROM (
        SELECT item_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
        FROM benchmark
    )
    WHERE len(words) > 0
), tests AS (
    SELECT DISTINCT item_id, n, array_to_string(words[i : i + n - 1], ' ') AS w
    FROM (SELECT item_id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM items)
), windows AS (
    SELECT doc_id, i, n, array_to_string(words[i : i + n - 1], ' ') AS w
    FROM (
        SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
        FROM texts, (SELECT DISTINCT n FROM tests)
    )
), found AS (
    SELECT doc_id, i, n, item_id FROM windows JOIN tests USING (n, w)
), hit AS (
    SELECT doc_id, count(DISTINCT i + j) AS n_hit
    FROM found, range(0, 10) AS steps(j) WHERE j < n GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT t.doc_id, len(t.words)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit,
    coalesce(x.n_items, 0)::BIGINT AS n_items, sha256(coalesce(x.items, '')) AS items_sha256,
    coalesce(h.n_hit, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hit h USING (doc_id) LEFT JOIN named x USING (doc_id)
"""

OP8_LINE_DEDUP = """
WITH lines AS (
    SELECT doc_id, source, pos, lines[pos] AS line, trim(lines[pos]) AS same
    FROM (
        SELECT doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS pos
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)
    )
), spread AS (
    SELECT same, min({'d': doc_id, 'p': pos}) AS first_place
    FROM lines WHERE same <> '' GROUP BY same HAVING count(DISTINCT source) >= 10
), judged AS (
    SELECT l.*, s.same IS NOT NULL AND first_place <> {'d': doc_id, 'p': pos} AS gone
    FROM lines l LEFT JOIN spread s USING (same)
), texts AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
        string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text
    FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(t.n_lines, 0)::BIGINT AS n_lines, coalesce(t.n_removed, 0)::BIGINT AS n_removed,
    sha256(coalesce(t.text, '')) AS kept_sha256
FROM documents d LEFT JOIN texts t USING (doc_id)
"""


OP11_PREFIX_TRIE = r"""
WITH crc_table AS (
    SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS entry
), own AS (
    SELECT conv_id, list({'k': sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')),
        'n': len(coalesce(text, ''))}
        ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), starts AS (
    SELECT conv_id, turns, xor(4294967295, list_reduce(
        list_prepend(4294967295, [ascii(c)::BIGINT FOR c IN string_split(conv_id::VARCHAR, '')]),
        lambda crc, b: xor(entry[(xor(crc, b) & 255) + 1], crc >> 8))) % 6 AS h
    FROM own, crc_table
), rebuilt AS (
    SELECT a.conv_id, list_concat(coalesce(b.turns[1 : a.h], []), a.turns[a.h + 1 :]) AS turns
    FROM starts a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100
), paths AS (
    SELECT conv_id, len(turns) AS n_turns, d AS depth, array_to_string([t.k FOR t IN turns[1 : d]], '') AS node,
        CASE WHEN d > 0 THEN array_to_string([t.k FOR t IN turns[1 : d - 1]], '') END AS parent,
        CASE WHEN d > 0 THEN turns[d].n ELSE 0 END AS chars
    FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id,
        count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved, max(n_turns) = any_value(depth) AS leaf,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n_turns = depth), '')) AS ends
    FROM paths GROUP BY node
), below AS (
    SELECT p.node, sum(u.saved) AS saved_tokens, count(*) FILTER (u.leaf) AS n_leaves
    FROM nodes u JOIN paths p ON p.conv_id = u.conv_id AND p.depth <= u.depth
    GROUP BY p.node
), children AS (
    SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
    coalesce(c.n_children, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
    b.saved_tokens::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN nodes p ON p.node = n.parent
LEFT JOIN children c ON c.node = n.node
"""

OP12_FILTER_AUDIT = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), flags AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), judged AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
        + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
    FROM texts LEFT JOIN flags USING (doc_id)
), cells AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL
), filters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), steps AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
        unnest([1, 2, 3, 4, 5]) AS step, unnest([a.bit, b.bit, c.bit, d.bit, e.bit]) AS bit,
        unnest([0, a.bit, a.bit + b.bit, a.bit + b.bit + c.bit, 31 - e.bit]) AS earlier
    FROM filters a, filters b, filters c, filters d, filters e
    WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), counted AS (
    SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER (mask & (earlier | bit) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & earlier > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (mask & earlier = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
    FROM steps, cells GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""


def corpus_sql() -> dict[str, str]:
    return {
        "op1_exact_top_k": OP1_EXACT_TOP_K,
        "op2_substring_dedup": OP2_SUBSTRING_DEDUP,
        "op4_chat_formatting": OP4_CHAT_FORMATTING,
        "op7_benchmark_decontamination": OP7_BENCHMARK_DECONTAMINATION,
        "op8_line_dedup": OP8_LINE_DEDUP,
        "op11_prefix_trie": OP11_PREFIX_TRIE,
        "op12_filter_audit": OP12_FILTER_AUDIT,
    }
