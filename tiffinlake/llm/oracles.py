"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tiffinlake.llm import mixing, vectorcodes

_LINE_DEDUP = r"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
    SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY doc_id"""

_MIX = rf"""
WITH sized AS (
    SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS source_key,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), placed AS (
    SELECT *, CAST('0x' || substr(digits, 1, 7) AS BIGINT)
              % (SELECT greatest(1, (count(*) + {mixing.SHARD_DOCS - 1}) // {mixing.SHARD_DOCS}) FROM documents) AS shard
    FROM (SELECT *, md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || size) AS digits FROM sized)
), shards AS (
    SELECT source_key, any_value(source) AS source, shard, CAST(sum(size) AS BIGINT) AS shard_size,
           CAST(ceil(sum(size) / {mixing.BLOCK_WORDS}) AS BIGINT) AS blocks
    FROM placed GROUP BY source_key, shard
), sources AS (
    SELECT source_key, CAST(sum(shard_size) AS BIGINT) AS source_size, CAST(sum(blocks) AS BIGINT) AS source_blocks,
           [5, 2, 1][CAST((row_number() OVER (ORDER BY any_value(source) NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
    FROM shards GROUP BY source_key
), ordered AS (
    SELECT *, row_number() OVER (ORDER BY 3 * source_size / weight, source_key) AS i FROM sources
), levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
    FROM ordered WINDOW w AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aimed AS (
    SELECT *, least(weight * (SELECT arg_min(level, i) FROM levels WHERE level <= 3 * source_size / weight),
                    CAST(3 * source_size AS DOUBLE)) AS target FROM levels
), source_seats AS (
    SELECT source_key, unnest(range(1, 3 * source_blocks + 1)) AS seat, target FROM aimed
), source_quotas AS (
    SELECT source_key, count(*) AS quota FROM (
        SELECT *, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, source_key, seat) AS nth
        FROM source_seats WHERE target > 0)
    WHERE nth <= (SELECT round(sum(source_size) / {mixing.BLOCK_WORDS}) FROM sources) GROUP BY source_key
), shard_seats AS (
    SELECT s.source_key, shard, blocks, quota, unnest(range(1, 3 * blocks + 1)) AS seat
    FROM shards s JOIN source_quotas USING (source_key)
), shard_quotas AS (
    SELECT source_key, shard, count(*) AS q FROM (
        SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY blocks / (2 * seat - 1) DESC, shard, seat) AS nth
        FROM shard_seats) WHERE nth <= quota GROUP BY source_key, shard
), dealt AS (
    SELECT s.source_key, shard, blocks, coalesce(q, 0) // greatest(blocks, 1) AS rounds, coalesce(q, 0) % greatest(blocks, 1) AS extra,
           CAST('0x' || substr(md5('{mixing.SEED}:' || s.source_key || ':' || shard), 1, 7) AS BIGINT) % greatest(blocks, 1) AS start
    FROM shards s LEFT JOIN shard_quotas USING (source_key, shard)
), laid AS (
    SELECT *, sum(size) OVER (PARTITION BY source_key, shard ORDER BY digits, doc_id, size ROWS UNBOUNDED PRECEDING) AS fin FROM placed
)
SELECT doc_id, source, size, source_size, target,
       CAST(rounds * size
            + greatest(0, least(fin, (start + extra) * {mixing.BLOCK_WORDS}) - greatest(fin - size, start * {mixing.BLOCK_WORDS}))
            + greatest(0, least(fin, (start + extra - blocks) * {mixing.BLOCK_WORDS}) - (fin - size)) AS BIGINT) AS taken
FROM laid JOIN dealt USING (source_key, shard) JOIN aimed USING (source_key)"""

_SUBSTRINGS = r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS seq
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM split)
), repeated AS (
    SELECT doc_id, s FROM (
        SELECT *, row_number() OVER (PARTITION BY seq ORDER BY doc_id, s) AS nth FROM windows)
    WHERE nth > 1
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS pos FROM repeated
), placed AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM split
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE c.pos IS NULL) AS text, count(c.pos) AS n_removed
    FROM placed p LEFT JOIN covered c USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)"""

_WARC = """
WITH named AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), digests AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, max(page_id) OVER (PARTITION BY payload) AS last,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '')
           AS payload_digest
    FROM named
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM digests"""

_NGRAM_JOIN = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), grams AS (
    SELECT DISTINCT doc_id, gram FROM (
        SELECT doc_id, unnest(CASE WHEN len(words) >= 5
                                   THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
                                   WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS gram
        FROM split)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
    FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
    WHERE shared * 5 >= 4 * (s.n + t.n - shared)
), reached AS (
    SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
)
SELECT doc_id, least(doc_id, (SELECT min(y) FROM reached WHERE x = doc_id)) AS class_id,
       (SELECT count(*) FROM links WHERE x = doc_id) AS n_links
FROM documents"""

_FIM = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
    SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n,
           CAST('0x' || substr(h, 1, 8) AS BIGINT) % (length(t) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (length(t) + 1) AS y,
           t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
               OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 AS plain,
           CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 AS suffix_first
    FROM drawn
), cut AS (
    SELECT *, least(x, y) AS a, greatest(x, y) AS b, substr(t, 1, least(x, y)) AS p,
           substr(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS m, substr(t, greatest(x, y) + 1) AS s FROM numbers
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN suffix_first THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN a END AS prefix_chars, CASE WHEN NOT plain THEN b - a END AS middle_chars,
       sha256(CASE WHEN plain THEN t WHEN suffix_first THEN '<S>' || s || '<P>' || p || '<M>' || m
                   ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut"""

def _vector_codes(rounds: int = vectorcodes.ROUNDS) -> str:
    """Each round as tables of its own: distances of all parts to all entries, then the floors of means."""
    parts, entries, scale = vectorcodes.PARTS, vectorcodes.ENTRIES, vectorcodes.SCALE
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""far{n} AS (
    SELECT v.vec_id, v.part, e.entry, CAST(sum((v.x - e.x) * (v.x - e.x)) AS BIGINT) AS far
    FROM components v JOIN book{n} e ON v.part = e.part AND v.pos = e.pos GROUP BY ALL
), near{n} AS (
    SELECT vec_id, part, entry, far FROM far{n} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY far, entry) = 1
)""")
        if n < rounds:
            steps.append(f"""sums{n} AS (
    SELECT part, entry, pos, sum(x) AS s, count(*) AS c FROM components JOIN near{n} USING (vec_id, part) GROUP BY ALL
), book{n + 1} AS (
    SELECT b.part, b.entry, b.pos, coalesce(CAST((s - ((s % c) + c) % c) // c AS BIGINT), b.x) AS x
    FROM book{n} b LEFT JOIN sums{n} USING (part, entry, pos)
)""")
    return f"""
WITH kept AS (
    SELECT vec_id, embedding, label FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), placed AS (
    SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // {parts} AS width FROM kept
), components AS (
    SELECT vec_id, i // width AS part, i % width AS pos, CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT) AS x FROM placed
), first AS (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {entries}
), book0 AS (
    SELECT part, entry, pos, x FROM components JOIN first USING (vec_id)
), {", ".join(steps)}, coded AS (
    SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error
    FROM near{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


SQL: dict[str, str] = {
    "op4_line_dedup": _LINE_DEDUP,
    "op6_substring_dedup": _SUBSTRINGS,
    "op7_warc": _WARC,
    "op9_mix": _MIX,
    "op10_ngram_join": _NGRAM_JOIN,
    "op11_fim": _FIM,
    "op13_vector_codes": _vector_codes(),
}
