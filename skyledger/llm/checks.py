"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

CHECKS: dict[str, str] = {}

CHECKS["op1_embedding_near_dedup"] = """
WITH RECURSIVE links AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM embeddings a, embeddings b
    WHERE a.vec_id <> b.vec_id
      AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.95
),
reach(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
),
classes AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN classes ON classes.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""

_WORDS5 = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CHECKS["op5_benchmark_decontamination"] = f"""
WITH docs AS (SELECT doc_id, {_WORDS5} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, {_WORDS5} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item, least(len(w), 13) AS size, array_to_string(w[i + 1 : i + 13], ' ') AS words
    FROM (SELECT item, w, unnest(range(greatest(len(w) - 12, 1))) AS i FROM items WHERE len(w) > 0)
),
places AS (
    SELECT doc_id, i, size, array_to_string(w[i + 1 : i + size], ' ') AS words
    FROM (SELECT doc_id, w, size, unnest(range(greatest(len(w) - size + 1, 0))) AS i
          FROM docs, (SELECT DISTINCT size FROM windows))
),
hits AS (SELECT doc_id, i, size, item FROM places JOIN windows USING (size, words)),
covered AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT doc_id, i, size FROM hits))
    GROUP BY doc_id
),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(joined, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

CHECKS["op6_warc"] = """
WITH rows AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
digests AS (
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS sha, unhex(sha1(html))::BIT::VARCHAR AS bits FROM rows
),
owners AS (SELECT sha, min(page_id) AS first FROM digests GROUP BY sha)
SELECT page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + list_sum(list_transform(range(5), lambda j: substr(bits, (5 * i + j + 1)::INTEGER, 1)::INTEGER * (16 >> j)))::INTEGER, 1)), '')
        AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
FROM digests JOIN owners USING (sha)
"""

CHECKS["op7_substring_dedup"] = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(w[i + 1 : i + 35], ' ') AS words
    FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 34, 0))) AS i FROM docs)
),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY words) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS place FROM repeated),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place FROM docs),
kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS joined
    FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(joined, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

CHECKS["op9_preference_format"] = """
WITH turns AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations
),
replies AS (
    SELECT conv_id, place, row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1 AS number,
        count(*) OVER (PARTITION BY conv_id) AS n
    FROM turns WHERE role = 'assistant'
),
last AS (SELECT conv_id, place AS last FROM replies WHERE conv_id % n = number),
sides AS (
    SELECT 'chosen' AS side, conv_id, place, role, text FROM turns
    UNION ALL
    SELECT 'rejected', conv_id, place, role, CASE WHEN place = last THEN reverse(text) ELSE text END
    FROM turns LEFT JOIN last USING (conv_id) WHERE last IS NULL OR place <= last
),
splits AS (
    SELECT conv_id, coalesce(min(place) FILTER (differs), max(place) + 1) AS split
    FROM (SELECT conv_id, place, count(*) < 2 OR count(DISTINCT role || chr(0) || text) > 1 AS differs
          FROM sides GROUP BY conv_id, place)
    GROUP BY conv_id
),
rendered AS (
    SELECT *, place < split AS shared, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' || chr(10) AS body
    FROM sides JOIN splits USING (conv_id)
),
placed AS (
    SELECT *, coalesce(sum(length(head || body)) OVER (PARTITION BY conv_id, side, shared ORDER BY place
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS start
    FROM rendered
),
spans AS (SELECT *, start || ':' || (start + length(body) - 1) AS span FROM placed)
SELECT conv_id AS pair_id,
    coalesce(string_agg(head || body, '' ORDER BY place) FILTER (shared AND side = 'chosen'), '') AS prompt,
    count(*) FILTER (shared AND side = 'chosen') AS n_prompt_turns,
    coalesce(string_agg(head || body, '' ORDER BY place) FILTER (NOT shared AND side = 'chosen'), '') AS chosen,
    count(*) FILTER (NOT shared AND side = 'chosen') AS n_chosen_turns,
    coalesce(string_agg(span, ',' ORDER BY place) FILTER (NOT shared AND side = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg(head || body, '' ORDER BY place) FILTER (NOT shared AND side = 'rejected'), '') AS rejected,
    count(*) FILTER (NOT shared AND side = 'rejected') AS n_rejected_turns,
    coalesce(string_agg(span, ',' ORDER BY place) FILTER (NOT shared AND side = 'rejected' AND role = 'assistant'), '') AS rejected_mask
FROM spans GROUP BY conv_id
"""

_KEY10 = LOWER.format(f"trim(line, {BLANKS})")

CHECKS["op10_line_dedup"] = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
    FROM documents
),
keyed AS (SELECT *, {_KEY10} AS key FROM lines),
common AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT k.*, c.first IS NOT NULL AND c.first <> doc_id AS dropped FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_WORDS13 = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_TERMS12 = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CHECKS["op12_lexical_search"] = f"""
WITH docs AS (SELECT doc_id, {_TERMS12} AS w FROM documents),
sizes AS (SELECT doc_id, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
wanted AS (SELECT DISTINCT item_id, unnest({_TERMS12}) AS term FROM benchmark),
tfs AS (
    SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(w) AS term FROM docs)
    WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, term
),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
    FROM tfs, totals GROUP BY term
),
impacts AS (
    SELECT doc_id, term, weight * (1000000000 * tf // (1000 * tf + 20 * (100 - 50 + 50 * n * docs // terms))) AS impact
    FROM tfs JOIN weights USING (term) JOIN sizes USING (doc_id), totals
),
scores AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM wanted JOIN impacts USING (term) GROUP BY item_id, doc_id),
ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

# A step of CRC-32 looks up one byte in a table of 256 entries, which follow from the polynomial.
CHECKS["op13_importance_resampling"] = f"""
WITH steps AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i)) AS step
),
docs AS (SELECT doc_id, {_WORDS13} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word FROM docs),
targets AS (SELECT unnest({_WORDS13}) AS word FROM benchmark),
hashed AS (
    SELECT word, xor(list_reduce(
        list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INTEGER, 2))::BIGINT),
        lambda c, b: xor(c >> 8, step[1 + (xor(c, b) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket
    FROM (SELECT word FROM words UNION SELECT word FROM targets), steps
),
corpus AS (SELECT bucket, count(*)::DOUBLE AS s FROM words JOIN hashed USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*)::DOUBLE AS t FROM targets JOIN hashed USING (word) GROUP BY bucket),
gains AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM corpus) + 10000)
        / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM target) + 10000))))::BIGINT AS gain
    FROM corpus LEFT JOIN target USING (bucket)
),
summed AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
    SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE)
            / 4294967296::DOUBLE)))::BIGINT AS score
    FROM docs LEFT JOIN summed USING (doc_id)
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
        count(*) OVER (PARTITION BY n_features >= 20) AS n
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""
