"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
TEXTS = "t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents)"

SECRETS = rf"""
WITH {TEXTS},
rules(kind, ord, rx) AS (VALUES
    ('assign', 0, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
    ('access', 1, 'AKIA[A-Z0-9]+'),
    ('hex', 2, '[0-9a-f]{{32,}}'),
    ('pem', 3, '-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----'),
    ('jwt', 4, 'eyJ[A-Za-z0-9_-]{{8,}}\.eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{8,}}')),
cut AS (SELECT doc_id, kind, ord, rx, string_split_regex(text, rx) AS gaps, regexp_extract_all(text, rx) AS vals FROM t, rules WHERE regexp_matches(text, rx)),
placed AS (SELECT doc_id, kind, ord, rx, vals[i + 1] AS val,
    list_sum(list_transform(gaps[1:i + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(vals[1:i], lambda g: length(g))), 0) AS start
    FROM cut, unnest(range(len(vals))) r(i)),
kept AS (SELECT doc_id, kind, ord, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(val) AS BIGINT) AS span, start FROM placed
    WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(val, rx, 1)) >= 8 WHEN 'access' THEN length(val) >= 16 ELSE true END),
found AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY start, ord) FILTER (WHERE ord < 3) AS base, string_agg(span, ',' ORDER BY start, ord) AS spans FROM kept GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob
FROM t LEFT JOIN found USING (doc_id)
"""

RULES = rf"""
WITH {TEXTS},
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words, string_split(text, chr(10)) AS lines FROM t),
lines AS (SELECT doc_id, source, text, line, len(regexp_extract_all(line, '{WORD}')) AS n,
    translate(lower(array_to_string(regexp_extract_all(line, '{WORD}'), ' ')), '123456789', '000000000') AS norm
    FROM w, unnest(lines) u(line) WHERE regexp_matches(line, '{WORD}')),
limits AS (SELECT source, least(20, greatest(5, 0.01 * count(DISTINCT text))) AS most FROM t GROUP BY source),
frequent AS (SELECT source, norm FROM (SELECT source, norm, count(DISTINCT text) AS n FROM lines GROUP BY source, norm) JOIN limits USING (source) WHERE n > most),
gone AS (SELECT doc_id, sum(n) AS n FROM lines JOIN frequent USING (source, norm) GROUP BY doc_id),
repeats AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS window_words FROM w, unnest(range(1, len(words) - 3)) r(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, window_words) AS c FROM windows) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(5)) r(k) GROUP BY doc_id),
base AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(r.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    CAST(len(words) - coalesce(g.n, 0) AS BIGINT) AS words_left FROM w LEFT JOIN repeats r USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN gone g USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND words_left >= 0.3 * n_words AS kept FROM base
"""

REVISITS = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS keeper FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN keeper <> page_id THEN keeper END AS refers_to, CASE WHEN keeper <> page_id THEN NULL ELSE true END AS intact FROM k
"""

NEAR = rf"""
WITH RECURSIVE {TEXTS},
w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM t),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS shingle
    FROM w, unnest(range(1, greatest(len(words) - 3, 2))) r(i) WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, least(t.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = t.doc_id), t.doc_id)) AS component_id
FROM t LEFT JOIN n USING (doc_id)
"""

PRIVATE = rf"""
WITH {TEXTS},
rules(kind, ord, rx) AS (VALUES
    ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), ('ip', 1, '[0-9]+(?:\.[0-9]+){{3}}'),
    ('card', 2, '[0-9](?:[\x20-]?[0-9])+'), ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]')),
cut AS (SELECT doc_id, text, kind, ord, string_split_regex(text, rx) AS gaps, regexp_extract_all(text, rx) AS vals FROM t, rules WHERE regexp_matches(text, rx)),
placed AS (SELECT doc_id, text, kind, ord, vals[i + 1] AS val, regexp_replace(vals[i + 1], '[^0-9]', '', 'g') AS digits,
    CAST(list_sum(list_transform(gaps[1:i + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(vals[1:i], lambda g: length(g))), 0) AS BIGINT) AS s
    FROM cut, unnest(range(len(vals))) r(i)),
base AS (SELECT *, s + length(val) AS e, kind || ':' || CASE WHEN kind IN ('card', 'phone') THEN digits ELSE lower(val) END AS entity FROM placed WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(val, '.'), lambda p: CAST(('0' || right(ltrim(p, '0'), 6)) AS INTEGER) > 255)) = 0
    WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
        CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(digits), i, 1) AS INTEGER) WHEN 2 * CAST(substr(reverse(digits), i, 1) AS INTEGER) > 9 THEN 2 * CAST(substr(reverse(digits), i, 1) AS INTEGER) - 9
        ELSE 2 * CAST(substr(reverse(digits), i, 1) AS INTEGER) END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15 ELSE true END),
runs AS (SELECT doc_id, text, string_split_regex(text, '\p{{L}}+') AS gaps, regexp_extract_all(text, '\p{{L}}+') AS vals FROM t),
placed_terms AS (SELECT text, lower(vals[i + 1]) AS term, length(vals[i + 1]) AS n,
    CAST(list_sum(list_transform(gaps[1:i + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(vals[1:i], lambda g: length(g))), 0) AS BIGINT) AS a
    FROM (SELECT DISTINCT text, gaps, vals FROM runs WHERE text IN (SELECT text FROM base)), unnest(range(len(vals))) r(i) WHERE length(vals[i + 1]) BETWEEN 3 AND 40),
near AS (SELECT DISTINCT text, entity, term FROM (SELECT b.text, entity, term, row_number() OVER (PARTITION BY b.text, b.kind, b.s, a >= b.e ORDER BY CASE WHEN a >= b.e THEN a ELSE -a END) AS k
    FROM (SELECT DISTINCT text, kind, s, e, entity FROM base) b JOIN placed_terms p ON p.text = b.text AND (a + n <= b.s OR a >= b.e)) WHERE k <= 8),
copies AS (SELECT text, count(*) AS copies FROM t GROUP BY text),
pairs AS (SELECT entity, term, sum(copies) AS n_pair, count(*) AS texts FROM near JOIN copies USING (text) GROUP BY ALL),
entities AS (SELECT entity, sum(copies) AS n_entity FROM (SELECT DISTINCT entity, text FROM base) JOIN copies USING (text) GROUP BY entity),
terms AS (SELECT term, count(DISTINCT doc_id) AS n_term FROM (SELECT doc_id, lower(unnest(vals)) AS term FROM runs) JOIN (SELECT DISTINCT term FROM pairs) USING (term) GROUP BY term),
shares AS (SELECT entity, term, texts / (texts + 0.5) * n_pair / n_term AS certainty,
    CASE WHEN n_all > n_entity THEN log2(texts / (texts + 0.5) * n_pair * n_all / (n_entity * n_term)) / log2(n_all / n_entity) ELSE 0 END AS share
    FROM pairs JOIN entities USING (entity) JOIN terms USING (term), (SELECT CAST(count(*) AS DOUBLE) AS n_all FROM t)),
flagged AS (SELECT doc_id, term, max(share >= 0.95 OR certainty >= 0.9) AS removes FROM (SELECT DISTINCT doc_id, entity FROM base) JOIN shares USING (entity) WHERE share >= 0.8 OR certainty >= 0.6 GROUP BY ALL),
hits AS (SELECT r.doc_id, f.removes, CAST(list_sum(list_transform(gaps[1:i + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(vals[1:i], lambda g: length(g))), 0) AS BIGINT) AS s, length(vals[i + 1]) AS n
    FROM (SELECT * FROM runs WHERE doc_id IN (SELECT doc_id FROM flagged)) r, unnest(range(len(vals))) x(i) JOIN flagged f ON f.doc_id = r.doc_id AND f.term = lower(vals[i + 1])),
spans AS (SELECT doc_id, kind, ord, s, kind || ':' || s || ':' || e AS span FROM base
    UNION ALL SELECT doc_id, kind, ord, s, kind || ':' || s || ':' || (s + n) FROM (SELECT *, CASE WHEN removes THEN 'remove' ELSE 'general' END AS kind, CASE WHEN removes THEN 4 ELSE 5 END AS ord FROM hits h
        WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = h.doc_id AND b.s < h.s + h.n AND h.s < b.e))),
found AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card,
    count(*) FILTER (WHERE kind = 'phone') AS n_phone, string_agg(span, ',' ORDER BY s, ord) FILTER (WHERE ord < 4) AS b, string_agg(span, ',' ORDER BY s, ord) AS a FROM spans GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
    sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM t LEFT JOIN found USING (doc_id)
"""

MIX = rf"""
WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS mark FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank FROM t GROUP BY source),
w AS (SELECT *, [5, 2, 1][source_rank % 3 + 1] AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
    sum(weight) OVER (ORDER BY source_size / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
f AS (SELECT *, left_over * weight > 3 * source_size * weights AS is_full FROM o),
g AS (SELECT source, source_rank, source_size,
    CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE) ELSE max(CASE WHEN NOT is_full THEN CAST(left_over AS DOUBLE) / CAST(weights AS DOUBLE) END) OVER () * weight END AS target FROM f),
q AS (SELECT t.doc_id, t.size, t.source, source_rank, source_size, target, row_number() OVER () AS one,
    sum(size) OVER (PARTITION BY t.source ORDER BY mark, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source),
c AS (SELECT one, size, source_rank, CAST(place + e * source_size AS DOUBLE) / target AS finish FROM q, range(3) r(e) WHERE size > 0),
m AS (SELECT one, size, sum(size) OVER (ORDER BY finish, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM c),
k AS (SELECT one, sum(size) AS taken FROM m WHERE upto <= (SELECT sum(size) FROM t) GROUP BY one)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, source FROM q LEFT JOIN k USING (one)
"""

PHRASES = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(words[i + 1:i + k], ' ') AS phrase FROM w, range(1, 5) a(k), unnest(range(len(words) - k + 1)) b(i)) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT c.lang, c.phrase, c.k, a, j, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (l.f + r.f) AS BIGINT) AS score FROM c, range(1, 4) x(j), f l, f r
    WHERE j < c.k AND l.lang = c.lang AND r.lang = c.lang AND l.phrase = array_to_string(c.words[1:j], ' ') AND r.phrase = array_to_string(c.words[j + 1:c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_parts AS (SELECT lang, array_to_string(words[i:i + s - 1], ' ') AS phrase, max(a) AS longer FROM c, range(2, 4) y(s), range(1, 4) z(i) WHERE s < k AND i + s - 1 <= k GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_parts USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS ints FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id AS other, a.label = v.label AS same, CAST(list_inner_product(a.ints, v.ints) AS BIGINT) AS score FROM a JOIN v ON a.vec_id <> v.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
r AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS rank
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
"""
