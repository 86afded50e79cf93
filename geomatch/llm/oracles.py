"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

QUALITY = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
    FROM documents
), windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)
), repeated AS (
    SELECT doc_id, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY doc_id
), counted AS (
    SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
           CAST(len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
           CAST(len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
           len(lines) AS n_lines, len(text) - len(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper
    FROM t LEFT JOIN repeated USING (doc_id)
), judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 3 * n_words <= word_chars AND word_chars <= 10 * n_words AND 10 * n_symbols <= n_words
       AND 2 * n_dup_lines <= n_lines AND 2 * n_upper <= word_chars AS kept
FROM judged
"""
#: The string itself follows from its turns: 8 code points for each mark, and one more for each "<" that is escaped.
CHAT = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS own(t, r)
), marked AS (
    SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) THEN 0 ELSE 1 END AS opens FROM rows
), joined AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
           coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
           sum(length(regexp_replace(text, '<([|0])', '<0\1', 'g')) + CASE opens WHEN 1 THEN length(regexp_replace(role, '<([|0])', '<0\1', 'g')) + 23 ELSE 8 END) AS chars
    FROM marked GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM joined
"""
WARC = """
WITH p AS (
    SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""

#: The damage needs crc32, here taken bit by bit. Then forward over the rows: the cheapest way into each state (0 nothing yet, 1 after a system,
#: 2 after a user, 3 after an assistant turn), the ASCII-least of equals, with what it has made. Turns are inserted before a row or at the end.
REPAIR = r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), kinds AS (
    SELECT * EXCLUDE (key), xor(list_reduce([CAST((ascii(key[k // 8 + 1]) >> CAST(k % 8 AS INTEGER)) & 1 AS BIGINT) FOR k IN range(8 * length(key))],
           lambda crc, bit: xor(crc // 2, 3988292384 * (xor(crc, bit) & 1)), CAST(4294967295 AS BIGINT)), 4294967295) % 20 AS kind FROM keyed
), damaged AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds) WHERE kind <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), judged AS (
    SELECT *, left(role, 1) AS initial, CASE
        WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault
    FROM placed
), facts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
           count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
           count(*) FILTER (WHERE fault = 'truncated') AS truncated,
           count(*) FILTER (WHERE i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM judged) GROUP BY conv_id
), inserts(q, mid, ins, ins_cost, ins_made) AS (
    VALUES (0, 0, '', 0, ''), (0, 2, 'I', 5, chr(10) || 'user:'), (0, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'),
           (1, 1, '', 0, ''), (1, 2, 'I', 5, chr(10) || 'user:'), (1, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'),
           (2, 2, '', 0, ''), (2, 3, 'I', 5, chr(10) || 'assistant:'), (3, 3, '', 0, ''), (3, 2, 'I', 5, chr(10) || 'user:')
), edits(mid, own, edit, edit_cost, target, given) AS (
    VALUES (0, NULL, 'D', 2, 0, NULL), (1, NULL, 'D', 2, 1, NULL), (2, NULL, 'D', 2, 2, NULL), (3, NULL, 'D', 2, 3, NULL),
           (0, 's', 'K', 0, 1, NULL), (0, 'u', 'K', 0, 2, NULL), (1, 'u', 'K', 0, 2, NULL), (2, 'a', 'K', 0, 3, NULL), (3, 'u', 'K', 0, 2, NULL),
           (0, NULL, 'R', 1, 2, 'user'), (1, NULL, 'R', 1, 2, 'user'), (2, NULL, 'R', 1, 3, 'assistant'), (3, NULL, 'R', 1, 2, 'user')
), walk AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS q, 0 AS cost, '' AS audit, '' AS made FROM facts
    UNION ALL
    SELECT w.conv_id, r.i, e.target AS q, w.cost + ins_cost + edit_cost + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost,
           w.audit || ins || edit AS audit, w.made || ins_made || CASE edit WHEN 'D' THEN '' ELSE chr(10) || coalesce(given, r.role) || ':' || r.text END AS made
    FROM walk w JOIN judged r ON r.conv_id = w.conv_id AND r.i = w.i + 1 JOIN inserts m ON m.q = w.q JOIN edits e ON e.mid = m.mid AND (own IS NULL OR own = initial)
    WHERE edit = 'D' OR fault IN ('', 'truncated')
    QUALIFY row_number() OVER (PARTITION BY w.conv_id, r.i, e.target ORDER BY w.cost + ins_cost + edit_cost + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END, w.audit || ins || edit) = 1
), ended AS (
    SELECT conv_id, cost + ins_cost AS cost, audit || ins AS audit, made || ins_made AS made
    FROM walk JOIN facts USING (conv_id) JOIN inserts USING (q) WHERE i = n AND mid IN (0, 3) AND (q <> 0 OR mid = 0)
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost + ins_cost, audit || ins) = 1
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(substr(made, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts USING (conv_id) LEFT JOIN ended USING (conv_id)
"""

#: w is floor(1000 ln((2N+2)/(2df+1))), m is 75 + 25 n N div L.
SEARCH = r"""
WITH terms AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), counted AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY ALL),
whole AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS total FROM lengths),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(documents) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM counted, whole GROUP BY term),
asked AS (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
    SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // total)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""

SUBSTRINGS = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS own FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t)),
firsts AS (SELECT own, min(doc_id) AS first_id FROM windows GROUP BY own),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN firsts USING (own), range(13) AS places(k) WHERE first_id < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""

ORACLES: dict[str, str] = {"op3_chat_formatting": CHAT, "op7_warc": WARC, "op8_quality_rules": QUALITY, "op11_ranked_search": SEARCH, "op12_substring_dedup": SUBSTRINGS, "op13_structure_repair": REPAIR}
