"""DuckDB SQL for the operators that SQL can express."""
from __future__ import annotations

ORACLES: dict[str, str] = {}


ORACLES["op9_chat_formatting"] = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(role) + length(text)
             + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) + length('<turn ></turn>') + 1 AS chars FROM m)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


ORACLES["op6_source_mixture"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', '17', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
      FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS clamp, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(clamp) OVER (ORDER BY clamp / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY clamp / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN clamp <= level * w THEN clamp
        ELSE w * first_value(level) OVER (ORDER BY clamp <= level * w, clamp / w, source NULLS LAST) END AS target FROM l),
g AS (SELECT *, round(target)::BIGINT // greatest(source_size, 1) AS whole,
             round(target)::BIGINT - (round(target)::BIGINT // greatest(source_size, 1)) * source_size AS rest FROM t),
k AS (SELECT d.source, d.hash, d.doc_id, d.size, count(*) AS n, g.source_size, g.target, g.whole, g.rest
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source GROUP BY ALL),
p AS (SELECT *, least(size, greatest(floor((rest - coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY hash, doc_id, size
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n), 0))::BIGINT AS part FROM k)
SELECT p.doc_id, p.source, p.size, p.source_size, p.target, (p.whole * p.size + p.part)::BIGINT AS taken
FROM p, range(p.n) AS again
"""

# Exact: all pairs of usable vectors, then the smallest id reachable.
ORACLES["op10_embedding_near_dedup"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
          ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, pairs.b FROM reach JOIN pairs ON reach.r = pairs.a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(max(l.n), 0)::BIGINT AS n_links, min(r.r) AS component_id, e.vec_id = min(r.r) AS kept
FROM embeddings e JOIN reach r ON r.id = e.vec_id LEFT JOIN links l ON l.a = e.vec_id GROUP BY e.vec_id
"""

# Exact: all pairs with a shingle in common, then the smallest id reachable.
ORACLES["op3_minhash_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (sh) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.r) AS component_id, d.doc_id = min(r.r) AS kept
FROM documents d JOIN reach r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

# Without trees: every record against its copy.
ORACLES["op1_warc_fixity"] = r"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS url, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id::VARCHAR
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::VARCHAR
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages),
c AS (SELECT page_id // 1000 AS archive, page_id, record,
  coalesce(sum(strlen(record)) OVER (PARTITION BY page_id // 1000 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  CASE WHEN page_id % 193 = 7 THEN NULL WHEN page_id % 97 = 5 THEN replace(record, '</p>', '</q>') WHEN page_id % 389 = 11 THEN substr(record, 1, 100) ELSE record END AS copy FROM r),
h AS (SELECT *, sha256(record) AS expected, CASE WHEN page_id % 577 = 13 THEN sha256('2:' || sha256(copy) || ':' || sha256(copy) || ':'
        || (2 * ('0x' || substr(sha256(copy), 1, 15))::HUGEINT)::VARCHAR || ':' || (2 * ('0x' || substr(sha256(copy), 16, 15))::HUGEINT)::VARCHAR)
      ELSE sha256(copy) END AS found FROM c)
SELECT archive, ("offset" // 65536) * 65536 AS range_start, "offset", CASE WHEN found IS NULL THEN 'missing' ELSE 'changed' END AS status, expected, found
FROM h WHERE expected IS DISTINCT FROM found
"""

# CRC-32 by its table; words and pairs hashed into the same buckets; the same sums and rounding.
ORACLES["op2_quality_rules"] = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
               lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT DISTINCT unnest(w) AS word FROM d),
b AS (SELECT word, list_transform(range(length(hex(word)) // 2), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT) AS bytes FROM v),
h AS (SELECT word, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, bytes),
        lambda c, x: xor(c >> 8, tab.t[(xor(c, x) & 255) + 1]))) AS crc FROM b, tab),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
q AS (SELECT p.doc_id, p.i, h.crc, lead(h.crc) OVER (PARTITION BY p.doc_id ORDER BY p.i) AS following FROM p JOIN h USING (word)),
g AS (SELECT doc_id, crc % 65536 AS bucket FROM q UNION ALL SELECT doc_id, (crc * 1000003 + following) % 65536 FROM q WHERE following IS NOT NULL),
c AS (SELECT bucket, count(*) AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good FROM g GROUP BY bucket),
z AS (SELECT bucket, raw, good, (sum(raw) OVER ())::BIGINT AS raw_all, (sum(good) OVER ())::BIGINT AS good_all FROM c),
k AS (SELECT bucket, round(ln((good + 10.0::DOUBLE) / ((good_all * raw)::DOUBLE / greatest(raw_all, 1) + 10.0::DOUBLE)), 9) AS weight FROM z),
s AS (SELECT doc_id, round(sum(weight) / count(*), 9) AS score FROM g JOIN k USING (bucket) GROUP BY doc_id),
f AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM (
        SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) AS five FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM f, range(5) AS x(j) WHERE f.n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(s.score, 0.0)::DOUBLE AS score
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id)),
-- the threshold: each trusted document that passes the base rules against the others' counts
own AS (SELECT doc_id, bucket, count(*) AS m FROM g WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL),
alone AS (SELECT own.doc_id, round(sum(ln((good - own.m + 10.0::DOUBLE) / (((good_all - n) * (raw - own.m))::DOUBLE / greatest(raw_all - n, 1) + 10.0::DOUBLE)) * own.m) / max(n), 9) AS score
          FROM own JOIN z USING (bucket) JOIN (SELECT doc_id, sum(m)::BIGINT AS n FROM own GROUP BY doc_id) s USING (doc_id) JOIN m ON m.doc_id = own.doc_id
          WHERE NOT (m.n_words < 10 OR 100 * m.n_repeat_words > 20 * m.n_words) GROUP BY own.doc_id),
steps AS (SELECT floor(score * 1000) AS step, sum(count(*)) OVER (ORDER BY floor(score * 1000)) AS upto, sum(count(*)) OVER () AS total FROM alone GROUP BY 1),
level AS (SELECT least(0.0::DOUBLE, coalesce(min(step) FILTER (upto > 0.001 * total), 0) / 1000.0::DOUBLE) AS threshold FROM steps)
SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND score >= threshold AS kept FROM m, level
"""

# Every document that shares a term with an item, scored in full.
ORACLES["op11_lexical_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS no, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT no, term, count(*) AS times FROM (SELECT no, unnest(w) AS term FROM i) GROUP BY no, term),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d) GROUP BY row, term),
s AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
f AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, s GROUP BY term, n),
m AS (SELECT row, doc_id, 25 + (75 * len(w) * n) // l AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT q.no, m.row, m.doc_id, sum(q.times * f.weight * ((1000000000 * t.tf) // (1000 * t.tf + 8 * m.m)))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN f USING (term) JOIN m USING (row) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0)
SELECT i.item_id, r.rank::INTEGER AS rank, r.doc_id, r.score FROM r JOIN i USING (no) WHERE r.rank <= 10
"""

# All anchors with all rows; windows by positives.
ORACLES["op13_hard_negatives"] = r"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT a.row, a.vec_id AS anchor_id, b.row AS other, b.vec_id AS id, a.label = b.label AS same,
             list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.row <> b.row AND len(a.e) = len(b.e)),
p AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, id NULLS LAST) AS place FROM x WHERE same),
n AS (SELECT p.anchor_id, p.id AS positive_id, x.id AS negative_id, p.score AS positive_score, x.score AS negative_score,
             row_number() OVER (PARTITION BY p.row, p.place ORDER BY x.score DESC, x.id NULLS LAST) AS rank
      FROM p JOIN x ON x.row = p.row AND NOT x.same AND 30 * p.score <= 100 * x.score AND 100 * x.score <= 90 * p.score WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
