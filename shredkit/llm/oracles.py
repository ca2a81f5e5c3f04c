"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: All inner products of the scaled vectors, ranked.
OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: Poisson replication: the same MD5 uniforms against the closed form of the distribution.
OP6 = """
WITH sizes AS (
  SELECT source, sum(strlen(coalesce(text, ''))) AS bytes FROM documents GROUP BY source
), rates AS (
  SELECT source,
         CASE WHEN bytes = 0 THEN 1.0::DOUBLE
              ELSE (1.0::DOUBLE / (SELECT count(*) FROM sizes)) * (SELECT sum(bytes) FROM sizes)::DOUBLE / bytes
         END AS rate
  FROM sizes
), parts AS (
  SELECT source, rate, greatest(1, ceil(rate / 16.0))::INT AS parts FROM rates
), cdf AS (
  SELECT source, k,
         sum(exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1)))
           OVER (PARTITION BY source ORDER BY k) AS c
  FROM parts, range(0, 97) t(k)
), draws AS (
  SELECT d.doc_id, d.source, p.rate, i.i,
         (('0x' || substr(md5('17|' || coalesce(d.doc_id::VARCHAR, '#' || md5(coalesce(d.text, '')))
                              || '|' || i.i::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0 AS u
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.parts + 1)) AS i) i
), drawn AS (
  SELECT w.doc_id, w.i, count(c.k) AS n
  FROM draws w LEFT JOIN cdf c ON c.source IS NOT DISTINCT FROM w.source AND c.c < w.u
  GROUP BY w.doc_id, w.i
), counts AS (
  SELECT doc_id, sum(n)::INT AS copies FROM drawn GROUP BY doc_id
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, t.copy::INT AS copy, c.copies, round(p.rate, 9) AS rate,
       ('0x' || substr(md5('17:order|' || d.doc_id::VARCHAR || '|' || t.copy::VARCHAR), 1, 15))::BIGINT AS order_key
FROM documents d
JOIN counts c ON c.doc_id = d.doc_id
JOIN parts p ON p.source IS NOT DISTINCT FROM d.source,
     LATERAL (SELECT unnest(range(1, c.copies + 1)) AS copy) t
"""

#: Snapshot collapse by comparing turn lists directly.
OP7 = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, count(*) AS n_turns,
         list(coalesce(role, '<null>') || '|' || coalesce(text, '<null>')
              ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS said,
         string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '')
                    || '<|im_end|>' || chr(10), ''
                    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
  FROM turns GROUP BY conv_id
), prefixes AS (
  SELECT DISTINCT list_slice(said, 1, k) AS said FROM convs, LATERAL (SELECT unnest(range(1, n_turns)) AS k) t
), firsts AS (
  SELECT said, min(conv_id) AS conv_id FROM convs GROUP BY said
)
SELECT c.conv_id, 0::INT AS part, c.n_turns, c.text
FROM convs c JOIN firsts f ON f.conv_id = c.conv_id
WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.said = c.said)
"""

#: Windows of 50 words as text, the smallest document of each, words under repeated ones.
OP8 = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM docs WHERE len(w) >= 50
), windows AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS k FROM starts
), firsts AS (
  SELECT k, min(doc_id) AS first FROM windows GROUP BY k
), covered AS (
  SELECT DISTINCT x.doc_id, unnest(range(x.s, x.s + 50)) AS p
  FROM windows x JOIN firsts f ON f.k = x.k WHERE x.doc_id > f.first
), removed AS (
  SELECT doc_id, list(p) AS gone FROM covered GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs WHERE len(w) > 0
), kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS said
  FROM words x LEFT JOIN covered c ON c.doc_id = x.doc_id AND c.p = x.p
  WHERE c.p IS NULL GROUP BY x.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(len(r.gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(k.said, '')) AS kept_sha256
FROM docs d LEFT JOIN removed r ON r.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

#: Shards from cumulative bytes; CRC-32 as a fold of the bytes over its table.
OP10 = """
WITH docs AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, encode(coalesce(text, '')) AS raw,
         ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), groups AS (
  SELECT h, sum(size) AS bytes FROM docs GROUP BY h
), total AS (SELECT sum(size) AS total FROM docs
), keyed AS (
  SELECT d.*, CASE WHEN g.bytes > 0.01 * total / 8 THEN 1 ELSE 0 END AS heavy, total
  FROM docs d JOIN groups g ON g.h = d.h, total
), units AS (
  SELECT heavy, h, CASE WHEN heavy = 1 THEN doc_id END AS d, sum(size) AS bytes
  FROM keyed GROUP BY ALL
), summed AS (
  SELECT *, sum(bytes) OVER (ORDER BY heavy, h, d NULLS FIRST) - bytes AS before FROM units
), placed AS (
  SELECT k.doc_id, k.size, k.raw, k.heavy, k.h,
         (8 * (2 * u.before + u.bytes) // (2 * k.total))::INT AS shard
  FROM keyed k JOIN summed u ON u.heavy = k.heavy AND u.h = k.h
    AND u.d IS NOT DISTINCT FROM (CASE WHEN k.heavy = 1 THEN k.doc_id END)
), crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
              lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), bytes AS (
  SELECT raw, list_transform(regexp_extract_all(hex(raw), '..'), lambda x: ('0x' || x)::BIGINT) AS b
  FROM (SELECT DISTINCT raw FROM placed)
), crcs AS (
  SELECT raw, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
         lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc_table
)
SELECT p.doc_id, p.size::BIGINT AS size, c.text_crc32::BIGINT AS text_crc32, 'bytes' AS law, p.shard,
       row_number() OVER (PARTITION BY p.shard ORDER BY p.heavy, p.h, p.doc_id) - 1 AS slot,
       NULL::INT AS grown_shard
FROM placed p JOIN crcs c ON c.raw = p.raw
"""


#: Every order and step over the documents themselves.
OP11 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), firsts AS (
  SELECT text, min(doc_id) AS first FROM docs GROUP BY text
), known AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT d.part, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
         CASE WHEN len(d.w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(d.w)) < 50 * len(d.w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 2 * length(d.text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN d.doc_id > f.first THEN 'E' ELSE '' END AS fails
  FROM docs d JOIN firsts f ON f.text = d.text LEFT JOIN known k ON k.doc_id = d.doc_id
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS before
  FROM orders, range(1, 6) t(step)
), judged AS (
  SELECT x.part, x.good, x.toxic, s.filter_order, s.step, s.f, x.fails = s.f AS alone, contains(x.fails, s.f) AS own,
         len(translate(x.fails, s.before, '')) < len(x.fails) AS gone
  FROM failed x, steps s
), counted AS (
  SELECT part, filter_order, step, f,
         count(*) FILTER (NOT own AND NOT gone) AS kept, count(*) FILTER (own AND NOT gone) AS removed,
         count(*) FILTER (own AND gone) AS redundant, count(*) FILTER (alone) AS unique_fails,
         count(*) FILTER (own AND NOT gone AND good = 1) AS good_lost,
         count(*) FILTER (own AND NOT gone AND toxic = 1) AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""

#: Near words by wildcard patterns and deletions, roots by recursion.
OP12 = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
  FROM documents
), counted AS (
  SELECT d, run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL
), crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)),
              lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(regexp_extract_all(hex(encode(d || ':' || run)), '..'), lambda x: ('0x' || x)::BIGINT)),
         lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS h
  FROM counted, crc_table
), edited AS (
  SELECT c, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, (h % length(run) + 2)::BIGINT)
                 ELSE run END AS word
  FROM hashed
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM edited WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5
), places AS (
  SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words
), holes AS (
  SELECT word, i, left(word, i - 1) || '*' || substr(word, i + 1) AS hole,
         left(word, i - 1) || substr(word, i + 1) AS shorter
  FROM places
), dropped AS (
  SELECT DISTINCT h.word AS longer, w.word AS shorter FROM holes h JOIN words w ON w.word = h.shorter
), pairs AS (
  SELECT a.word, b.word AS near FROM holes a JOIN holes b ON b.hole = a.hole AND b.word <> a.word
  UNION SELECT longer, shorter FROM dropped
  UNION SELECT shorter, longer FROM dropped
), ranked AS (
  SELECT p.word, p.near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
         row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, p.near) AS r
  FROM pairs p JOIN words w ON w.word = p.near
), formed AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near,
         CASE WHEN r.near_n >= 5 * w.n THEN r.near END AS form, CASE WHEN r.near_n >= 5 * w.n THEN r.near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1
), chain AS (
  SELECT word, word AS root FROM formed
  UNION ALL
  SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.root AND e.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mtree_topk": OP4,
        "op6_mix_sources": OP6,
        "op7_chat_format": OP7,
        "op8_substring_dedup": OP8,
        "op10_shard_bytes": OP10,
        "op11_filter_audit": OP11,
        "op12_spelling_variants": OP12,
    }
