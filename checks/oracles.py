"""DuckDB SQL that gives the same rows as the registered queries.

The texts restate the rules in SQL; they share only fixed values with the
library.
"""

from postmill.dims import CHANNELS, COLORS, GREENHOUSE_BOARDS, LEVER_BOARDS, README_REPOS, STATES, TAXONOMY
from postmill.functions.keys import LEGAL_SUFFIXES, TITLE_STOP_WORDS

from checks.words import DOCUMENT_WORDS


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def rows(*values) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(v) + ")" for v in values) + ")"


POSTINGS = """postings AS (
  SELECT ((l_orderkey * 8 + l_linenumber) * 256 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) - 1)::BIGINT AS seq,
    l_orderkey AS ord, l_linenumber AS line, l_suppkey AS supp,
    'HTTPS://WWW.Jobs.example.com/ad/' || l_partkey || '/?utm_source=feed&v=' || l_linenumber || '&se=' || l_orderkey AS url,
    CASE WHEN l_linenumber = 7 THEN 'Engineering Intern'
         ELSE p_name || CASE WHEN l_returnflag = 'N' THEN '' ELSE ' & ' || lower(p_type) END || ' Engineering ' ||
              CASE l_linenumber % 3 WHEN 0 THEN 'Internship (Summer 2026)' WHEN 1 THEN 'Co-Op [Remote]'
                   ELSE 'Intern - JR-' || (10000 + l_partkey) END END AS title,
    CASE l_linenumber % 4 WHEN 0 THEN s_name || ', Inc.' WHEN 1 THEN 'The ' || s_name || ' Company'
         WHEN 2 THEN s_name || ' Labs, LLC' ELSE 'Café ' || s_name END AS company,
    p_name || ' ' || p_brand || ' ' || l_returnflag || ' ' || TERM_LIST[(l_partkey + l_linenumber) % TERM_COUNT + 1] || repeat(' on site', l_quantity::INT) AS description,
    CASE l_linenumber % 4 WHEN 0 THEN 'Dallas, Texas' WHEN 1 THEN 'Dallas, TX' WHEN 2 THEN 'Remote - ' || n_name ELSE '' END AS location,
    CASE l_returnflag WHEN 'A' THEN 'Hybrid' WHEN 'R' THEN 'On Site' ELSE '' END AS work_model,
    '' AS posted_date,
    CASE l_linenumber % 3 WHEN 0 THEN 'Greenhouse/s' || l_suppkey WHEN 1 THEN 'org/repo' ELSE 'Adzuna' END AS source
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
TERMS = [keywords[1] for keywords in TAXONOMY.values()]
POSTINGS = POSTINGS.replace("TERM_LIST", words(TERMS)).replace("TERM_COUNT", str(len(TERMS)))


def ascii_of(col: str) -> str:
    return f"regexp_replace(strip_accents({col}), '[^\\x00-\\x7F]', '', 'g')"


def company_key(col: str) -> str:
    name = f"regexp_replace(trim(lower({ascii_of(col)})), '^the ', '')"
    spaced = f"trim(regexp_replace({name}, '[^a-z0-9]+', ' ', 'g'))"
    return f"replace(regexp_replace({spaced}, '( ({'|'.join(LEGAL_SUFFIXES)}))+$', ''), ' ', '')"


def title_key(col: str) -> str:
    t = f"regexp_replace(lower({ascii_of(col)}), '[()\\[\\]]', ' ', 'g')"
    t = f"regexp_replace({t}, '(^|[^a-z0-9_])(req|job|jr|r)?[-#_]?[0-9]{{4,}}($|[^a-z0-9_])', '\\1 \\3', 'g')"
    t = f"regexp_replace({t}, '(19|20)[0-9][0-9]', ' ', 'g')"
    t = f"regexp_replace({t}, '\\b(summer|fall|autumn|winter|spring)\\b', ' ', 'g')"
    t = f"regexp_replace({t}, '\\b(internship|intern)\\b', 'intern', 'g')"
    t = f"regexp_replace({t}, '\\b(co-op|coop|co op)\\b', 'intern', 'g')"
    t = f"replace({t}, '&', 'and')"
    parts = f"list_distinct(string_split_regex({t}, '[^a-z0-9]+'))"
    kept = f"list_filter({parts}, lambda w: NOT list_contains({words(['', *TITLE_STOP_WORDS])}, w))"
    return f"array_to_string(list_sort({kept}), '-')"


def location_key(col: str) -> str:
    low = f"lower({ascii_of(col)})"
    parts = (
        f"list_filter(list_transform(string_split(regexp_replace({low}, '[^a-z0-9,\\s]+', ' ', 'g'), ','),"
        " lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> '')"
    )
    states = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in STATES.items()) + "}"
    return (
        f"CASE WHEN contains({low}, 'remote') THEN 'remote' WHEN len({parts}) = 0 THEN '' ELSE "
        f"replace(array_to_string(list_append({parts}[:-2], coalesce({states}[{parts}[-1]], {parts}[-1])), '-'), ' ', '-') END"
    )


def url_key(col: str) -> str:
    query = f"regexp_extract({col}, '\\?([^#]*)', 1)"
    kept = (
        f"list_sort(list_filter(string_split({query}, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) <> 'se'"
        " AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_')))"
    )
    path = f"regexp_extract({col}, '^[^:]*://[^/?#]*([^?#]*)', 1)"
    return (
        f"lower(regexp_extract({col}, '^([A-Za-z]+):', 1)) || '://' || "
        f"regexp_replace(lower(regexp_extract({col}, '://([^/?#]*)', 1)), '^www\\.', '') || "
        f"CASE WHEN len({path}) > 1 AND ends_with({path}, '/') THEN {path}[:-2] ELSE {path} END || "
        f"CASE WHEN len({kept}) = 0 THEN '' ELSE '?' || array_to_string({kept}, '&') END"
    )


PRIORITY = (
    "CASE WHEN starts_with(lower(source), 'greenhouse') OR starts_with(lower(source), 'lever') THEN 0"
    " WHEN contains(lower(source), 'github') OR contains(source, '/') THEN 1"
    " WHEN starts_with(lower(source), 'adzuna') THEN 2 ELSE 1 END"
)

KEYED = f"""keyed AS MATERIALIZED (
  SELECT *, {company_key('company')} AS company_key, {title_key('title')} AS title_key,
    {location_key('location')} AS location_key, {url_key('url')} AS normalized_url
  FROM postings),
full_keyed AS (SELECT *, company_key || '|' || title_key || '|' || location_key AS fingerprint FROM keyed)"""

FOLDED = f"""sized AS (
  SELECT *, string_split(title_key, '-') AS tokens, length(description) * 3 + 2 - {PRIORITY} AS score FROM keyed),
steps AS (
  SELECT company_key, min(seq) AS company_first,
    list([struct_pack(first := seq, seq := seq, tokens := tokens, score := score)] ORDER BY seq) AS states
  FROM sized GROUP BY company_key),
folded AS MATERIALIZED (
  SELECT company_key, company_first, len(states) AS n_rows, list_reduce(states, lambda slots, x:
    list_transform(
      [coalesce(list_position(list_transform(slots, lambda s: least(len(s.tokens), len(x[1].tokens)) >= 3
         AND (list_has_all(s.tokens, x[1].tokens) OR list_has_all(x[1].tokens, s.tokens))), true), 0)],
      lambda p: CASE WHEN p = 0 THEN list_concat(slots, x)
        WHEN x[1].score <= slots[p].score THEN slots
        ELSE list_concat(slots[:p - 1],
          [struct_pack(first := slots[p].first, seq := x[1].seq, tokens := x[1].tokens, score := x[1].score)],
          slots[p + 1:]) END)[1]) AS slots
  FROM steps),
survivors AS MATERIALIZED (
  SELECT company_key, company_first, slot.first AS slot_first, slot.seq AS seq
  FROM (SELECT company_key, company_first, unnest(slots) AS slot FROM folded))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


HISTORY = (
    "history AS (SELECT * FROM full_keyed WHERE ord % 20 = 0)",
    "batch AS (SELECT * FROM full_keyed WHERE ord % 20 <> 0)",
)


def keyword_score(text: str, keyword: str) -> str:
    escaped = "".join("\\" + c if not c.isalnum() and c != " " else c for c in keyword.lower())
    return f"regexp_matches({text}, {quote('(^|[^\\pL\\pN_])' + escaped + '($|[^\\pL\\pN_])')})::INT"


def scored(source: str, key: str, text: str, taxonomy) -> str:
    """CTEs: one row (key, ord, major, score) per label with a score."""
    per_label = [
        f"struct_pack(ord := {i}, major := {quote(m)}, score := {' + '.join(keyword_score('t', k) for k in ks)})"
        for i, (m, ks) in enumerate(taxonomy.items())
    ]
    return f"""texts AS (SELECT {key}, lower({text}) AS t FROM {source}),
scores AS (SELECT {key}, unnest([{', '.join(per_label)}], recursive := true) FROM texts),
labels AS (SELECT {key}, ord, major, score FROM scores WHERE score > 0)"""


def labelled(source: str, key: str, text: str, taxonomy) -> str:
    return (
        scored(source, key, text, taxonomy)
        + f""",
ranked AS (SELECT {key}, string_agg(major || ':' || score, ',' ORDER BY score DESC, ord) AS majors FROM labels GROUP BY {key})"""
    )


POSTING_LABELS = scored("postings", "seq", "title || ' ' || description", TAXONOMY)
CHANNEL_CTE = "channels AS (SELECT * FROM " + rows(
    *[(quote(m), str(c), quote(COLORS[m]), str(i)) for i, (m, c) in enumerate(CHANNELS.items())]
) + " v(major, channel_id, color, rank))"

CHANNEL_OF_ORDER = "'1002'"
JOBS = f"""jobs AS (
  SELECT o_orderkey AS id, 'https://jobs.example.com/o/' || o_orderkey AS job_url, 'Role ' || o_orderpriority AS title,
    'Customer ' || o_custkey AS company,
    CASE o_orderkey % 4 WHEN 0 THEN 'mechanical,civil' WHEN 1 THEN ' MIS , computer science,' WHEN 2 THEN ''
         ELSE 'mechanical,unknown,CIS' END AS majors,
    o_orderdate AS date_found,
    CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS posted_to_discord,
    CASE WHEN o_orderkey % 3 = 0 THEN {CHANNEL_OF_ORDER} ELSE '' END AS discord_channel_ids,
    CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Adzuna' WHEN 3 THEN 'org/repo' ELSE 'Lever/acme' END AS source,
    CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'Reno, NV' END AS location, '' AS work_model, '3d' AS posted_date,
    (o_custkey % 7)::INT AS post_attempts
  FROM orders)"""
RUNS = """runs AS (
  SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS id, min(ts) AS started_at,
    CASE WHEN date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) % 5 = 0 THEN NULL ELSE max(ts) END AS finished_at,
    count(*) FILTER (event_type = 'view') AS fetched, count(*) FILTER (event_type = 'click') AS deduped,
    count(*) FILTER (event_type = 'signup') AS new_jobs, count(*) FILTER (event_type = 'purchase') AS posted,
    count(*) FILTER (event_type = 'error') AS errors,
    CASE WHEN date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) % 5 = 0 THEN 'running'
         WHEN date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) % 7 = 3 THEN 'error' ELSE 'ok' END AS status
  FROM events GROUP BY CAST(ts AS DATE))"""
ATTEMPTS = """attempts AS (
  SELECT 'https://jobs.example.com/o/' || user_id AS job_url, CASE event_type WHEN 'view' THEN 'mechanical' WHEN 'click' THEN 'civil'
    WHEN 'signup' THEN 'MIS' WHEN 'purchase' THEN 'CIS' ELSE 'computer science' END AS major, min(value) >= 0.5 AS ok
  FROM events GROUP BY 1, 2),
wanted AS (
  SELECT job_url, m.rank, c.major, c.channel_id, list_contains(string_split(discord_channel_ids, ','), c.channel_id::VARCHAR) AS sent
  FROM jobs j, unnest(string_split(j.majors, ',')) WITH ORDINALITY AS m(label, rank) JOIN channels c ON c.major = m.label),
tries AS (SELECT w.*, coalesce(ok, false) AS ok FROM wanted w LEFT JOIN attempts USING (job_url, major))"""


def outcomes(which: str) -> str:
    return f"""outcomes AS (
  SELECT job_url, count(*) AS tried, count(*) FILTER (ok) AS delivered,
    coalesce(list(channel_id::VARCHAR ORDER BY rank) FILTER (ok), []) AS ids
  FROM tries WHERE {which} GROUP BY job_url)"""


FIRST, AGAIN = outcomes("true"), outcomes("NOT sent")
PAGE = """page AS (SELECT * FROM jobs WHERE posted_to_discord = 0 AND post_attempts < 5),
targets AS (
  SELECT p.*, m.rank - 1 AS label_rank, c.major AS label, c.channel_id
  FROM page p, unnest(string_split(p.majors, ',')) WITH ORDINALITY AS m(label, rank) JOIN channels c ON c.major = m.label
  WHERE NOT list_contains(string_split(p.discord_channel_ids, ','), c.channel_id::VARCHAR))"""
STAMP = "'%Y-%m-%d %H:%M:%S'"
KNOWN = f"list_filter(string_split(majors, ','), lambda m: list_contains({words(CHANNELS)}, m))"
OLD_IDS = "list_filter([discord_channel_ids], lambda i: i <> '')"
RETRIED = f"""retried AS (
  SELECT jobs.*, tried, delivered, list_concat({OLD_IDS}, ids) AS sent,
    delivered = tried AND len(list_concat({OLD_IDS}, ids)) = len({KNOWN}) AS complete
  FROM jobs LEFT JOIN outcomes USING (job_url)),
after AS (
  SELECT job_url,
    CASE WHEN tried IS NULL THEN posted_to_discord WHEN complete THEN 1 WHEN post_attempts + 1 >= 5 THEN 2 ELSE 0 END AS posted_to_discord,
    CASE WHEN tried IS NULL THEN discord_channel_ids ELSE array_to_string(sent, ',') END AS discord_channel_ids,
    CASE WHEN tried IS NULL OR complete THEN post_attempts ELSE post_attempts + 1 END AS post_attempts,
    CASE WHEN tried IS NULL OR complete THEN NULL ELSE 'retry: one or more channel sends failed' END AS last_error
  FROM retried)"""
SLOTS = "slots AS (SELECT p_partkey // 15 AS chunk_id, (p_partkey % 15)::INT AS index, * FROM part)"
ALIGNED = """answers AS (
  SELECT chunk_id, CASE WHEN p_size % 10 = 1 THEN index + 100 ELSE index END AS index, 0 AS n, p_size % 7 AS third, p_type
  FROM slots WHERE p_size % 10 <> 0 AND NOT (chunk_id % 7 = 0 AND index % 3 <> 0)),
lists AS (
  SELECT chunk_id, index, list_filter(['civil:3', CASE WHEN p_type = 'PROMO' THEN 'MIS:' ELSE 'mechanical:' END || third],
    lambda m: split_part(m, ':', 2)::INT BETWEEN 1 AND 5) AS kept FROM answers),
aligned AS (
  SELECT s.chunk_id, s.index, CASE WHEN kept IS NULL THEN NULL
    WHEN len(kept) = 2 AND split_part(kept[2], ':', 2)::INT > 3 THEN kept[2] || ',' || kept[1] ELSE array_to_string(kept, ',') END AS majors
  FROM slots s LEFT JOIN lists USING (chunk_id, index))"""


def strip_tags(col: str) -> str:
    plain = f"regexp_replace({col}, '<[^>]+>', ' ', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&nbsp;", " "), ("&#39;", "''"), ("&amp;", "&")):
        plain = f"replace({plain}, '{entity}', '{char}')"
    return f"trim({plain}, E' \\t\\n\\r ')"


BOARDS = [f"Greenhouse/{s}" for group in GREENHOUSE_BOARDS.values() for s in group]
SOURCES = rows(
    ("'Adzuna'", "'Adzuna'"),
    *[("'GitHub'", quote(name)) for name, _, _ in README_REPOS],
    *[("'Greenhouse'", quote(s)) for s in BOARDS],
    *[("'Lever'", quote(f"Lever/{s}")) for s in LEVER_BOARDS],
)
INTERN = "regexp_matches(lower({0}), '(^|[^\\pL\\pN_])(intern(ship)?|co-?op)($|[^\\pL\\pN_])')"
LEVER_TEXT = "regexp_replace(title, 'Co-Op|Intern', 'Analyst', 'g')"
KEYS = with_(POSTINGS, KEYED)
FIRST_SEEN_BATCH = """flagged AS (
  SELECT seq, normalized_url, fingerprint, ord % 3 AS batch FROM full_keyed),
n0 AS (SELECT * FROM flagged WHERE batch = 0 QUALIFY row_number() OVER (PARTITION BY normalized_url ORDER BY seq) = 1),
n1 AS (SELECT * FROM flagged f WHERE batch = 1 AND normalized_url NOT IN (SELECT normalized_url FROM n0)
       AND fingerprint NOT IN (SELECT fingerprint FROM n0)
       QUALIFY row_number() OVER (PARTITION BY normalized_url ORDER BY seq) = 1),
s1 AS (SELECT * FROM n0 UNION ALL SELECT * FROM n1),
n2 AS (SELECT * FROM flagged f WHERE batch = 2 AND normalized_url NOT IN (SELECT normalized_url FROM s1)
       AND fingerprint NOT IN (SELECT fingerprint FROM s1)
       QUALIFY row_number() OVER (PARTITION BY normalized_url ORDER BY seq) = 1)"""

PART_ROWS = """SELECT 'https://jobs.example.com/p/' || p_partkey AS url, p_type || ' Intern' AS title, {company} AS company,
  '' AS description, {location} AS location, {model} AS work_model, p_size || 'd' AS posted_date,
  p_brand || '/' || (p_partkey // 500) AS source FROM part"""

MARKDOWN_HTML = (
    ("p_name", "'Reno, NV'", "'Hybrid'"), ("p_name || ' & Sons'", "'Reno,' || chr(160) || 'NV'", "''"),
)
#: The document of each posting and its place in it, if all land in documents of one kind.
PLACED = """placed AS (SELECT *, supp * 8 + ord // 500 % 8 AS body,
  row_number() OVER (PARTITION BY supp, ord // 500 % 8 ORDER BY seq) - 1 AS pos FROM postings)"""


def packed_seq(rank: int) -> str:
    return f"({rank << 60} + body * 16777216 + pos)::BIGINT AS seq"


GREENHOUSE_ROWS = """SELECT {seq}, url, title, CASE WHEN line = 3 THEN 'S' || supp ELSE company END AS company,
  description || ' & more' AS description, location, '' AS work_model, '' AS posted_date, 'Greenhouse/s' || supp AS source
FROM placed WHERE {where}"""
LEVER_ROWS = (
    "SELECT {seq}, url, " + LEVER_TEXT + """ AS title, 'S' || supp || '-Labs' AS company, description, location, work_model,
  '' AS posted_date, 'Lever/s' || supp || '-labs' AS source FROM placed
WHERE {where} AND (""" + INTERN.format(LEVER_TEXT).replace("{", "{{").replace("}", "}}") + " OR work_model <> '')"
)
ADZUNA_ROWS = """SELECT {seq}, url, title, company, description,
  CASE line WHEN 2 THEN 'Dallas, TX' WHEN 5 THEN 'Brooklyn, NY' ELSE 'United States' END AS location,
  '' AS work_model, '' AS posted_date, 'Adzuna' AS source FROM placed WHERE {where}"""

LANDED = f"""lever AS (SELECT *, ((supp * 8 + ord // 500 % 8) % 10 = 3) AS broken FROM postings WHERE line % 3 = 1),
landed AS (
  SELECT 'Greenhouse' AS kind, count(*) AS n FROM postings WHERE line % 3 = 0
  UNION ALL SELECT 'Lever', count(*) FROM lever WHERE NOT broken AND ({INTERN.format(LEVER_TEXT)} OR work_model <> '')
  UNION ALL SELECT 'Adzuna', count(*) FROM postings WHERE line % 3 = 2
  UNION ALL SELECT p_brand, 2 * count(*) FROM part GROUP BY p_brand)"""

ORACLES = {
    "normalize_page_url": f"SELECT page_id, {url_key('url')} AS normalized_url FROM pages",
    "normalize_posting_url": with_(POSTINGS) + f"SELECT seq, {url_key('url')} AS normalized_url FROM postings",
    "page_text": f"SELECT page_id, {strip_tags('html')} AS text FROM pages",
    "page_links": f"""WITH items AS (SELECT page_id, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS l FROM pages),
one AS (SELECT page_id, (u.pos - 1)::INT AS pos, u.item FROM items, unnest(l) WITH ORDINALITY AS u(item, pos))
SELECT page_id, pos, regexp_extract(item, 'href="([^"]+)"', 1) AS href, {strip_tags('item')} AS label FROM one""",
    "fold_documents": f"SELECT doc_id, {ascii_of('text')} AS folded FROM documents",
    "company_keys": with_(POSTINGS) + f"SELECT seq, {company_key('company')} AS company_key FROM postings",
    "title_keys": with_(POSTINGS) + f"SELECT seq, {title_key('title')} AS title_key FROM postings",
    "location_keys": with_(POSTINGS) + f"SELECT seq, {location_key('location')} AS location_key FROM postings",
    "fingerprints": KEYS + "SELECT seq, fingerprint FROM full_keyed",
    "source_priorities": with_(POSTINGS) + f"SELECT seq, ({PRIORITY})::INT AS priority FROM postings",
    "intern_filter": with_(
        POSTINGS,
        "changed AS (SELECT seq, CASE WHEN work_model = '' THEN replace(title, 'Intern', 'International') ELSE title END AS title FROM postings)",
    ) + f"SELECT seq, title FROM changed WHERE {INTERN.format('title')}",
    "dedupe_batch": with_(POSTINGS, KEYED, FOLDED)
    + "SELECT seq, s.company_key, company_first, slot_first, title, source FROM survivors s JOIN keyed USING (seq)",
    "dedupe_dropped": with_(POSTINGS, KEYED, FOLDED)
    + "SELECT company_key, n_rows, len(slots) AS n_kept, n_rows - len(slots) AS n_dropped FROM folded",
    "containment_pairs": with_(
        POSTINGS, KEYED,
        "sets AS (SELECT DISTINCT company_key, title_key, string_split(title_key, '-') AS tokens FROM keyed)",
    ) + """SELECT a.company_key, a.title_key AS title_small, b.title_key AS title_large FROM sets a JOIN sets b USING (company_key)
WHERE len(a.tokens) >= 3 AND len(a.tokens) < len(b.tokens) AND len(list_intersect(a.tokens, b.tokens)) = len(a.tokens)""",
    "best_per_key": KEYS + f"""SELECT company_key, title_key, arg_max(seq, (length(description) * 3 + 2 - {PRIORITY}, -seq)) AS seq,
count(*) AS n_rows FROM keyed GROUP BY company_key, title_key""",
    "existing_urls": with_(POSTINGS, KEYED, *HISTORY)
    + "SELECT DISTINCT normalized_url FROM history WHERE normalized_url <> '' AND normalized_url IN (SELECT normalized_url FROM batch)",
    "existing_fingerprints": with_(POSTINGS, KEYED, *HISTORY)
    + "SELECT DISTINCT fingerprint FROM history WHERE fingerprint IN (SELECT fingerprint FROM batch)",
    "exists_by_url": with_(POSTINGS, KEYED, *HISTORY)
    + """SELECT seq, job_url FROM (SELECT seq, regexp_replace(url, '&se=.*', '&se=' || (ord // 20 * 20)) AS job_url FROM batch)
WHERE job_url IN (SELECT url FROM history)""",
    "select_new": with_(POSTINGS, KEYED, *HISTORY)
    + """SELECT seq, normalized_url, fingerprint FROM batch b
WHERE NOT EXISTS (SELECT 1 FROM history h WHERE h.normalized_url = b.normalized_url)
  AND NOT EXISTS (SELECT 1 FROM history h WHERE h.fingerprint = b.fingerprint)
QUALIFY row_number() OVER (PARTITION BY normalized_url ORDER BY seq) = 1""",
    "insert_ignore": with_(POSTINGS, KEYED, *HISTORY)
    + f"""SELECT job_url, seq, title, '' AS source, 0 AS posted_to_discord, '' AS discord_channel_ids, 0 AS post_attempts,
  {url_key('job_url')} AS normalized_url
FROM (SELECT seq, title, regexp_replace(url, '&se=.*', '') AS job_url FROM batch)
WHERE job_url NOT IN (SELECT regexp_replace(url, '&se=.*', '') FROM history)
QUALIFY row_number() OVER (PARTITION BY job_url ORDER BY seq) = 1""",
    "classify_keywords": with_(POSTINGS, labelled("postings", "seq", "title || ' ' || description", TAXONOMY))
    + "SELECT seq, coalesce(majors, '') AS majors FROM postings LEFT JOIN ranked USING (seq)",
    "classify_documents": with_(labelled("documents", "doc_id", "' ' || text", DOCUMENT_WORDS))
    + "SELECT doc_id, coalesce(majors, '') AS majors FROM documents LEFT JOIN ranked USING (doc_id)",
    "label_counts": with_(POSTINGS, POSTING_LABELS, CHANNEL_CTE)
    + """SELECT l.major, channel_id, count(*) AS n, sum(score)::BIGINT AS total_score
FROM labels l JOIN channels c USING (major) GROUP BY l.major, channel_id""",
    "classify_scored": with_(POSTINGS, labelled("postings", "seq", "title || ' ' || description", TAXONOMY))
    + """SELECT seq, CASE WHEN contains(title, 'bolt') OR contains(title, 'gear') THEN coalesce(majors, '')
  WHEN contains(title, 'ring') THEN 'mechanical:5,civil:2' ELSE 'civil:2,mechanical:2' END AS majors
FROM postings LEFT JOIN ranked USING (seq)""",
    "classify_chunked": with_(
        POSTINGS, labelled("postings", "seq", "title || ' ' || description", TAXONOMY),
        """numbered AS (SELECT seq, title, row_number() OVER (ORDER BY seq) - 1 AS n FROM postings)""",
        """chunked AS (SELECT seq, n % 15 AS i, first_value(title) OVER (PARTITION BY n // 15 ORDER BY n) AS first, count(*) OVER (PARTITION BY n // 15) AS size
  FROM numbered)""",
        """answered AS (SELECT seq, i, ['civil', 'mechanical', 'MIS'][length(first) % 3 + 1] || ':' || (i % 5 + 1) AS answer,
  contains(first, 'bolt') AS few, size FROM chunked)""",
    )
    + """SELECT a.seq, CASE WHEN few AND (size - 7 > size / 2.0 OR i >= 7) THEN coalesce(majors, '') ELSE answer END AS majors
FROM answered a LEFT JOIN ranked USING (seq)""",
    "align_scores": with_(SLOTS, ALIGNED) + "SELECT chunk_id, index, coalesce(majors, 'missing') AS majors FROM aligned",
    "chunk_gate": with_(SLOTS, ALIGNED)
    + """SELECT chunk_id, count(*) AS slots, count(*) FILTER (majors IS NULL) AS missing,
  count(*) FILTER (majors IS NULL) > count(*) / 2.0 AS discarded FROM aligned GROUP BY chunk_id""",
    "chunk_text": with_(SLOTS)
    + """SELECT chunk_id, string_agg('[' || index || ']' || chr(10) || 'Title: ' || p_name || chr(10) || 'Description: ' || left(repeat(p_type || ' ', 3 * p_size), 600),
  chr(10) || chr(10) ORDER BY index) AS text FROM slots GROUP BY chunk_id""",
    "route_cards": with_(POSTINGS, POSTING_LABELS, CHANNEL_CTE)
    + """SELECT seq, (row_number() OVER (PARTITION BY seq ORDER BY score DESC, ord) - 1)::INT AS rank, l.major, channel_id, title, url, color,
  company, coalesce(nullif(location, ''), 'N/A') AS location, nullif(work_model, '') AS work_model,
  CASE WHEN score > 1 THEN score::VARCHAR END AS match_score, 'Source: ' || source AS footer
FROM (SELECT labels.seq, labels.ord, labels.major, labels.score, title, url, company, location, work_model, source
      FROM labels JOIN postings USING (seq)) l JOIN channels USING (major)""",
    "route_overridden": with_(POSTINGS, POSTING_LABELS, CHANNEL_CTE)
    + """SELECT CASE l.major WHEN 'civil' THEN 111 WHEN 'MIS' THEN 222 ELSE channel_id END AS channel_id, count(*) AS n
FROM labels l JOIN channels USING (major) GROUP BY 1""",
    "unknown_overrides": with_(JOBS, CHANNEL_CTE)
    + """SELECT DISTINCT trim(m) AS major FROM (SELECT unnest(string_split(majors, ',')) AS m FROM jobs)
WHERE trim(m) <> '' AND trim(m) NOT IN (SELECT major FROM channels)""",
    "storage_rows": with_(POSTINGS, KEYED, POSTING_LABELS)
    + """SELECT seq, any_value(url) AS job_url, string_agg(major, ',' ORDER BY score DESC, labels.ord) AS majors,
  0 AS posted_to_discord, '' AS discord_channel_ids, any_value(fingerprint) AS fingerprint
FROM labels JOIN full_keyed USING (seq) WHERE major IN ('industrial', 'computer science') GROUP BY seq""",
    "stored_postings": with_(JOBS)
    + """SELECT job_url AS url, title, company, '' AS description, coalesce(location, '') AS location, work_model, posted_date,
  coalesce(source, '') AS source FROM jobs""",
    "source_counts": with_(JOBS)
    + "SELECT coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS n FROM jobs GROUP BY 1 ORDER BY n DESC, 1",
    "major_counts": with_(JOBS)
    + """SELECT trim(m) AS major, count(*) AS n FROM (SELECT unnest(string_split(majors, ',')) AS m FROM jobs)
WHERE trim(m) <> '' GROUP BY 1""",
    "status_counts": with_(JOBS)
    + """SELECT status, count(j.id) AS n FROM (VALUES (0), (1), (2)) v(status) LEFT JOIN jobs j ON posted_to_discord = status
GROUP BY status""",
    "recent_jobs": with_(JOBS)
    + f"SELECT id, job_url, strftime(date_found, {STAMP}) AS date_found FROM jobs ORDER BY jobs.date_found DESC NULLS LAST, id DESC LIMIT 50",
    "failed_jobs": with_(JOBS)
    + f"""SELECT id, posted_to_discord, post_attempts, strftime(date_found, {STAMP}) AS date_found FROM jobs
WHERE posted_to_discord IN (0, 2) ORDER BY post_attempts DESC, jobs.date_found DESC, id""",
    "unposted_jobs": with_(JOBS, CHANNEL_CTE, PAGE)
    + f"SELECT id, post_attempts, strftime(date_found, {STAMP}) AS date_found FROM page ORDER BY page.date_found NULLS FIRST, id LIMIT 200",
    "last_run": with_(RUNS)
    + f"""SELECT id, strftime(started_at, {STAMP}) AS started_at, strftime(finished_at, {STAMP}) AS finished_at, fetched, deduped,
  new_jobs, posted, errors, status FROM runs ORDER BY id DESC LIMIT 1""",
    "pass_status": with_(JOBS)
    + """SELECT count(*) FILTER (posted_to_discord = 1) AS posted, count(*) FILTER (posted_to_discord = 0 AND post_attempts > 0) AS retrying,
  count(*) FILTER (posted_to_discord = 2) AS abandoned FROM jobs""",
    "stats_json": with_(JOBS, RUNS)
    + """SELECT 'source_counts' AS part, coalesce(nullif(source, ''), 'unknown') AS name, count(*) AS n FROM jobs GROUP BY 2
UNION ALL SELECT 'major_counts', trim(m), count(*) FROM (SELECT unnest(string_split(majors, ',')) AS m FROM jobs) WHERE trim(m) <> '' GROUP BY 2
UNION ALL SELECT 'status_counts', status::VARCHAR, count(j.id) FROM (VALUES (0), (1), (2)) v(status)
  LEFT JOIN jobs j ON posted_to_discord = status GROUP BY 2
UNION ALL SELECT 'last_run', arg_max(status, id), max(id) FROM runs
UNION ALL SELECT 'recent_job_count', '', count(*) FROM jobs WHERE date_found >= TIMESTAMP '1998-01-01 00:00:00'""",
    "fetch_counts": with_(POSTINGS)
    + "SELECT coalesce(source, '(all)') AS source, count(*) AS n FROM postings GROUP BY ROLLUP (postings.source)",
    "source_health": with_(POSTINGS)
    + f"""SELECT c.platform, c.source, count(p.seq) AS n, count(p.seq) = 0 AS silent
FROM {SOURCES} c(platform, source) LEFT JOIN postings p ON p.source = c.source GROUP BY 1, 2""",
    "catalog_check": """WITH boards AS (
  SELECT 'Lever' AS platform, s_name AS key FROM supplier UNION ALL SELECT 'Greenhouse', p_type FROM part
  UNION ALL SELECT 'Lever', 'p-' || p_partkey FROM part)
SELECT * FROM (SELECT platform, key, array_to_string(list_filter([CASE WHEN count(*) > 1 THEN 'repeated' END,
  CASE WHEN key <> lower(key) THEN 'not lower case' END,
  CASE WHEN NOT regexp_matches(key, '^[a-z0-9][a-z0-9-]*[a-z0-9]$|^[a-z0-9]$') THEN 'not a slug' END], lambda x: x IS NOT NULL), ',') AS problems
FROM boards GROUP BY platform, key) WHERE problems <> ''""",
    "apply_results": with_(JOBS, CHANNEL_CTE, ATTEMPTS, FIRST)
    + """SELECT job_url,
  CASE WHEN tried IS NULL THEN posted_to_discord WHEN tried = delivered THEN 1 ELSE 0 END AS posted_to_discord,
  CASE WHEN tried IS NULL THEN discord_channel_ids ELSE array_to_string(ids, ',') END AS discord_channel_ids,
  CASE WHEN tried <> delivered THEN post_attempts + 1 ELSE post_attempts END AS post_attempts,
  CASE WHEN tried <> delivered THEN 'one or more channel sends failed' END AS last_error
FROM jobs LEFT JOIN outcomes USING (job_url)""",
    "apply_retry": with_(JOBS, CHANNEL_CTE, ATTEMPTS, AGAIN, RETRIED) + "SELECT * FROM after",
    "stored_jobs": with_(JOBS, CHANNEL_CTE, ATTEMPTS, AGAIN, RETRIED) + "SELECT * FROM after",
    "plan_retry": with_(JOBS, CHANNEL_CTE, PAGE)
    + "SELECT job_url, label_rank::INT AS rank, label AS major, channel_id, 1 AS score FROM targets",
    "retry_closed": with_(JOBS, CHANNEL_CTE, PAGE)
    + "SELECT job_url, 1 AS posted_to_discord, discord_channel_ids FROM page WHERE job_url NOT IN (SELECT job_url FROM targets)",
    "pass_counts": with_(JOBS, CHANNEL_CTE, ATTEMPTS, AGAIN, RETRIED)
    + """SELECT count(*) FILTER (j.posted_to_discord <> 1 AND a.posted_to_discord = 1) AS posted,
  count(*) FILTER (a.post_attempts > j.post_attempts) AS failed,
  count(*) FILTER (j.posted_to_discord <> 2 AND a.posted_to_discord = 2) AS abandoned
FROM jobs j JOIN after a USING (job_url)""",
    "stream_delivery": """WITH RECURSIVE passes AS (
  SELECT user_id::VARCHAR AS job_url, (day(ts) - 1)::INT AS pass_no, count(*) AS labels,
    count(*) FILTER (event_type <> 'error') AS good, row_number() OVER (PARTITION BY user_id ORDER BY day(ts)) AS step
  FROM events GROUP BY user_id, day(ts)),
walk AS (
  SELECT DISTINCT job_url, 0 AS pass_no, 0::BIGINT AS step, 0 AS status, 0 AS attempts, []::BIGINT[] AS ids FROM passes
  UNION ALL
  SELECT job_url, pass_no, step, CASE WHEN len(sent) = labels THEN 1 WHEN pass_no > 0 AND attempts + 1 >= 5 THEN 2 ELSE 0 END,
    CASE WHEN len(sent) = labels THEN attempts ELSE attempts + 1 END, sent
  FROM (SELECT p.*, w.attempts,
          list_concat(CASE WHEN p.pass_no > 0 THEN list_sort(list_distinct(w.ids)) ELSE [] END, range(1, p.good + 1)) AS sent
        FROM walk w JOIN passes p ON p.job_url = w.job_url AND p.step = w.step + 1 WHERE w.status = 0))
SELECT job_url, pass_no, status, attempts, array_to_string(ids, ',') AS ids FROM walk WHERE step > 0""",
    "close_runs": with_(RUNS)
    + f"""SELECT id, CASE WHEN status = 'running' THEN 'interrupted' ELSE status END AS status,
  CASE WHEN status = 'running' THEN '2024-03-01 00:00:00' ELSE strftime(finished_at, {STAMP}) END AS finished_at FROM runs""",
    "run_ledger": with_(RUNS)
    + "SELECT id, status, "
    + ", ".join(
        f"CASE WHEN status <> 'running' THEN {c} END AS {c}" for c in ("fetched", "deduped", "new_jobs", "posted", "errors")
    )
    + " FROM runs",
    "evolve_backfill": with_(JOBS)
    + f"""SELECT id, {company_key('company')} || '|' || {title_key('title')} || '|' || {location_key("coalesce(location, '')")} AS fingerprint,
  job_url AS normalized_url, 0 AS post_attempts, NULL::VARCHAR AS source, 3 AS version FROM jobs""",
    "read_versions": with_(JOBS)
    + f"""SELECT id, job_url,
  CASE id % 3 WHEN 0 THEN {company_key('company')} || '|' || {title_key('title')} || '|'
    WHEN 1 THEN {company_key('company')} || '|' || {title_key('title')} || '|' || {location_key("coalesce(location, '')")}
    ELSE 'kept|print|' END AS fingerprint,
  CASE id % 3 WHEN 2 THEN 'https://kept.example.com/' || id ELSE job_url END AS normalized_url,
  CASE id % 3 WHEN 2 THEN 3 ELSE 0 END AS post_attempts,
  CASE id % 3 WHEN 2 THEN source END AS source, CASE WHEN id % 3 > 0 THEN location END AS location FROM jobs""",
    "read_greenhouse": with_(POSTINGS, PLACED) + GREENHOUSE_ROWS.format(seq=packed_seq(3), where="true"),
    "read_lever": with_(POSTINGS, PLACED) + LEVER_ROWS.format(seq=packed_seq(4), where="true"),
    "read_adzuna": with_(POSTINGS, PLACED) + ADZUNA_ROWS.format(seq=packed_seq(0), where="true"),
    "stream_payloads": with_(POSTINGS, PLACED)
    + "\nUNION ALL ".join(
        f"SELECT * FROM ({rows}) x"
        for rows in (
            GREENHOUSE_ROWS.format(seq="body % 3 AS batch", where="line % 3 = 0"),
            LEVER_ROWS.format(seq="body % 3 AS batch", where="line % 3 = 1"),
            ADZUNA_ROWS.format(seq="body % 3 AS batch", where="line % 3 = 2"),
            *[
                "SELECT (replace(p_brand, 'Brand#', '')::BIGINT * 134217728 + p_partkey // 500) % 3 AS batch, "
                + PART_ROWS.format(company=company, location=location, model=model).removeprefix("SELECT ")
                for company, location, model in MARKDOWN_HTML
            ],
        )
    ),
    "read_markdown": PART_ROWS.format(company="p_name", location="'Reno, NV'", model="'Hybrid'"),
    "read_html": PART_ROWS.format(company="p_name || ' & Sons'", location="'Reno,' || chr(160) || 'NV'", model="''"),
    "read_readmes": "SELECT * FROM ("
    + PART_ROWS.format(company="p_name", location="'Reno, NV'", model="'Hybrid'")
    + ") WHERE source LIKE '%0' UNION ALL SELECT * FROM ("
    + PART_ROWS.format(company="p_name || ' & Sons'", location="'Reno,' || chr(160) || 'NV'", model="''")
    + ") WHERE source NOT LIKE '%0'",
    "read_landed": with_(POSTINGS, LANDED)
    + """SELECT * FROM landed
UNION ALL SELECT 'rejected lever', count(DISTINCT (supp, ord // 500 % 8)) FROM lever WHERE broken HAVING count(*) > 0
UNION ALL SELECT 'different seq', sum(n)::BIGINT FROM landed""",
    "read_damaged": with_(POSTINGS, LANDED)
    + "SELECT * FROM landed UNION ALL SELECT 'lost ' || unnest(['adzuna', 'greenhouse', 'lever']), 1",
    "daily_run_landed": with_(POSTINGS, LANDED)
    + "SELECT 'ok' AS status, sum(n)::BIGINT AS fetched, 0::BIGINT AS errors, true AS consistent FROM landed",
    "stream_first_within": with_(
        POSTINGS, KEYED,
        "dated AS MATERIALIZED (SELECT DISTINCT normalized_url, [1, 2, 9, 10][ord % 4 + 1]::INT AS day FROM keyed)",
        "early AS (SELECT normalized_url, min(day) AS day FROM dated WHERE day < 10 GROUP BY normalized_url)",
    )
    + """SELECT * FROM early
UNION ALL SELECT * FROM dated WHERE day = 10 AND normalized_url NOT IN (SELECT normalized_url FROM early WHERE day = 9)""",
    "stream_first_seen": with_(POSTINGS, KEYED, FIRST_SEEN_BATCH)
    + "SELECT * FROM s1 UNION ALL SELECT * FROM n2",
    "daily_run": with_(
        POSTINGS, KEYED, FOLDED,
        """fresh AS MATERIALIZED (SELECT k.* FROM survivors s JOIN keyed k USING (seq)
  QUALIFY row_number() OVER (PARTITION BY normalized_url ORDER BY company_first, slot_first) = 1)""",
        scored("fresh", "seq", "title || ' ' || description", TAXONOMY),
    )
    + """SELECT 1::BIGINT AS id, 'ok' AS status, (SELECT count(*) FROM postings) AS fetched,
  (SELECT count(*) FROM postings) - (SELECT count(*) FROM survivors) AS deduped, (SELECT count(*) FROM fresh) AS new_jobs,
  (SELECT count(DISTINCT seq) FROM labels) AS posted, 0::BIGINT AS errors""",
}
