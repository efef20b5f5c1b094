"""DuckDB SQL that gives the rows of the queries that SQL can express."""

#: Characters of ASCII white space, for trim.
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op3_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, {BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.keeper AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op6_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages
), shared AS (
  SELECT html, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY html
)
SELECT p.page_id, p.n AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN s.last <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN s.last <> p.page_id THEN s.last END AS refers_to, true AS sound
FROM p LEFT JOIN shared s ON p.html = s.html""",
    "op7_quality_rules": rf"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS words FROM documents
), windows AS (
  SELECT doc_id, i AS pos, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM base)
), twice AS (
  SELECT doc_id, win FROM windows GROUP BY ALL HAVING count(*) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT pos + k)::BIGINT AS n
  FROM windows JOIN twice USING (doc_id, win), (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT line) AS different
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM base) WHERE trim(line, {BLANK}) <> '' GROUP BY doc_id
), m AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(l.n - l.different, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0) AS n_lines
  FROM base LEFT JOIN covered c USING (doc_id) LEFT JOIN lines l USING (doc_id)
), failed AS (
  SELECT source, unnest(['short', 'repeats', 'symbols', 'dup_lines']) AS rule,
    unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 100 * n_symbols > 10 * n_words, 100 * n_dup_lines > 30 * n_lines])::INT AS bad
  FROM m
), hosts AS (
  SELECT source, rule, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS f FROM failed GROUP BY ALL
), moments AS (
  SELECT rule, sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)) AS var,
    count(*) / sum(n) AS per FROM hosts GROUP BY rule
), priors AS (
  SELECT rule, mean, CASE WHEN var - mean * (1 - mean) * per > 1e-12
    THEN least(greatest(mean * (1 - mean) / (var - mean * (1 - mean) * per) - 1, 1.0), 1e6)
    WHEN mean * (1 - mean) > 0 THEN 1e6 ELSE 1.0 END AS weight FROM moments
), bad AS (
  SELECT source, bool_or((f + mean * weight) / (n + weight) > 0.5) AS rejected FROM hosts JOIN priors USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT rejected AS kept
FROM m JOIN bad ON m.source IS NOT DISTINCT FROM bad.source""",
    "op9_decontamination": r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM item WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), dwin AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes)
), hits AS (
  SELECT doc_id, item_id, i, d.n FROM dwin d JOIN win USING (n, win)
), words AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*)::BIGINT AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_conversation_trie": """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS turns FROM t GROUP BY conv_id
), crc AS (
  SELECT conv_id, turns, conv_id - conv_id % 100 AS base, (xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
    lambda c, byte: list_reduce(list_prepend(xor(c, byte), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
      lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)), 4294967295::UBIGINT) % 6)::BIGINT AS h
  FROM own
), whole AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM crc c LEFT JOIN own b ON b.conv_id = c.base
), prefixes AS (
  SELECT conv_id, d AS depth, turns[1:d] AS prefix, d = len(turns) AS ends
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM whole)
), nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends
  FROM prefixes GROUP BY depth, prefix
), children AS (
  SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, CASE WHEN n.depth > 0 THEN length(n.prefix[n.depth].text) ELSE 0 END AS chars
  FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.prefix = n.prefix
), above AS (
  SELECT n_children, n_convs, chars, d AS depth, prefix[1:d] AS prefix
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM counted)
), subtree AS (
  SELECT depth, prefix, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved FROM above GROUP BY depth, prefix
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved AS saved_tokens, sha256(c.ends) AS ends_sha256
FROM counted c JOIN subtree s ON s.depth = c.depth AND s.prefix = c.prefix
LEFT JOIN nodes p ON p.depth = c.depth - 1 AND p.prefix = c.prefix[1:c.depth - 1]""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_dot_product(a.q, v.q)::BIGINT AS score
  FROM a JOIN v ON a.vec_id <> v.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n USING (anchor_id)
WHERE NOT n.same AND 80 * positive_score <= 100 * n.score AND 100 * n.score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 5""",
}
