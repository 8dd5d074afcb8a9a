"""DuckDB SQL that gives the same rows as the queries."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, t.pos, t.line,
         translate(trim(t.line, {_BLANKS}), '{_UPPER}', '{_LOWER}') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS pos) t
), hot AS (
  SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT l.doc_id, l.pos, l.line, h.key IS NOT NULL AND l.doc_id <> h.last_doc AS gone
  FROM lines l LEFT JOIN hot h ON l.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_URL = "'(?s)^.*?://([^/?#]*)([^?#]*)'"


def _host(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), {_URL}, 1), '{_UPPER}', '{_LOWER}')"


def _path(url: str) -> str:
    return f"regexp_extract(coalesce({url}, ''), {_URL}, 2)"


def _node(url: str) -> str:
    query = f"regexp_extract({url}, '(?s)^[^?#]*(\\?[^#]*)', 1)"
    return f"CASE WHEN contains({url}, '://') THEN {_host(url)} || {_path(url)} || {query} END"


def _rule(host: str, path: str, kind: str) -> str:
    def fits(domain: str, start: str) -> str:
        return f"({host} = '{domain}' OR ends_with({host}, '.{domain}')) AND starts_with({path}, '{start}')"

    chosen = [("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block")]
    cases = " ".join(f"WHEN {fits(d, s)} THEN '{d + s if kind == 'rule' else v}'" for d, s, v in chosen)
    return f"CASE {cases} END"


def _attribute(name: str) -> str:
    parts = [rf"\s*=\s*\"([^\"]*)\"", r"\s*=\s*''([^'']*)''", r"\s*=\s*([^\s\"''>]+)"]
    return "(" + " || ".join(f"regexp_extract(tag, '(?is)\\s{name}{p}', 1)" for p in parts) + ")"


URL_SQL = f"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(
    regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>', '', 'g'),
    '(?is)<(?:link|meta)\\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag
  FROM pages WHERE contains(url, '://')
), targets AS (
  SELECT url, trim(replace(CASE
    WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(lower({_attribute('rel')}), '(^|\\s)canonical(\\s|$)')
      THEN {_attribute('href')}
    WHEN regexp_matches(tag, '(?i)^<meta') AND lower(trim({_attribute('http-equiv')})) = 'refresh'
      THEN regexp_extract({_attribute('content')}, '(?is)url\\s*=\\s*[''"]?([^''"]*)', 1)
    END, '&amp;', '&')) AS target
  FROM tags
), resolved AS (
  SELECT url, CASE
    WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN starts_with(target, '//') THEN 'http:' || target
    WHEN starts_with(target, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || target
    ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1)
      || coalesce(nullif(regexp_replace({_path('url')}, '[^/]*$', ''), ''), '/') || target END AS target
  FROM targets WHERE target <> ''
), links AS (
  SELECT {_node('url')} AS a, {_node('target')} AS b FROM resolved
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a, a AS b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), tainted AS (
  SELECT DISTINCT a FROM reach WHERE {_rule("regexp_extract(b, '(?s)^([^/?#]*)', 1)", "regexp_extract(b, '(?s)^[^/?#]*([^?#]*)', 1)", 'verdict')} = 'block'
), rows AS (
  SELECT page_id, {_host('url')} AS host, {_path('url')} AS path, {_node('url')} AS node FROM pages
)
SELECT page_id, host, path, {_rule('host', 'path', 'rule')} AS rule,
       coalesce({_rule('host', 'path', 'verdict')}, CASE WHEN t.a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM rows LEFT JOIN tainted t ON t.a = rows.node
"""

QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM d
), keyed AS (
  SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS w FROM windows
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM keyed) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n
  FROM repeated, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines,
         length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclaims,
         len(list_filter(words, lambda w: NOT regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]'))) AS n_bare
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id
), bits AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 3 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars > 12 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN n_words > 100000 THEN 64 ELSE 0 END)
    + (CASE WHEN 100 * n_exclaims > 30 * n_words THEN 128 ELSE 0 END)
    + (CASE WHEN 100 * n_bare > 20 * n_words THEN 256 ELSE 0 END) AS failure_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failure_bits & 3 <> 0 AS base_failed, failure_bits = 0 AS kept, failure_bits::BIGINT AS failure_bits
FROM bits
"""

DECONTAMINATE_SQL = rf"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, w FROM (
    SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark) WHERE len(w) > 0
), phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS phrase
  FROM items, LATERAL (SELECT unnest(range(1, greatest(len(w) - 8, 2))) AS i)
), docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), sizes AS (
  SELECT DISTINCT size FROM phrases
), places AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size
), hits AS (
  SELECT p.doc_id, p.i, p.size, f.item_id
  FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM places) p
  JOIN phrases f ON f.size = p.size AND f.phrase = p.phrase
), covered AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS spot FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS list
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(f.n_items, 0) AS n_items,
       sha256(coalesce(f.list, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""

SUFFIX_SQL = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM docs)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first_id FROM windows)
  WHERE doc_id > first_id
), covered AS (
  SELECT DISTINCT doc_id, i + o AS i FROM repeated, (SELECT unnest(range(0, 50)) AS o)
), bytes AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM docs)
), kept AS (
  SELECT b.doc_id, string_agg(b.b, '' ORDER BY b.i) AS h
  FROM bytes b LEFT JOIN covered c ON c.doc_id = b.doc_id AND c.i = b.i WHERE c.i IS NULL GROUP BY b.doc_id
), gone AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (before IS NULL OR before < i - 1) AS n_spans
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM covered) GROUP BY doc_id
)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, coalesce(g.n_removed, 0) AS n_removed,
       coalesce(g.n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.h, ''))) AS kept_sha256
FROM docs d LEFT JOIN gone g ON g.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id
"""


def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Nearest entries and moved codebooks, round by round. An entry's distance and number travel as
    one whole number, so that the least one has the least distance and of equal ones the first."""

    def near(turn: int) -> str:
        return f"""near{turn} AS MATERIALIZED (
  SELECT a.vec_id, a.p, a.x,
         min(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * {entries} + b.e) AS m
  FROM parts a JOIN books{turn} b ON b.p = a.p GROUP BY a.vec_id, a.p, a.x
)"""

    def moved(turn: int) -> str:
        return f"""means{turn} AS MATERIALIZED (
  SELECT p, e, list(mean ORDER BY i) AS x FROM (
    SELECT p, m % {entries} AS e, i, floor(sum(x[i]) / count(*))::BIGINT AS mean
    FROM near{turn - 1}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, m % {entries}, i)
  GROUP BY p, e
), books{turn} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM books{turn - 1} b LEFT JOIN means{turn} n ON n.p = b.p AND n.e = b.e
)"""

    steps = [near(0)]
    for turn in range(1, rounds + 1):
        steps += [moved(turn), near(turn)]
    chain = ", ".join(steps)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x
  FROM kept, (SELECT unnest(range(0, {parts})) AS p)
), books0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})
), {chain}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', (m % {entries})::INT), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error
  FROM near{rounds} GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS d FROM books{rounds}
)
SELECT c.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error,
       (SELECT d FROM digest) AS codebooks_sha256
FROM coded c JOIN kept k ON k.vec_id = c.vec_id
"""


VECTOR_CODES_SQL = _vector_codes()

FILTER_AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), masks AS (
  SELECT d.doc_id, part,
    (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > first_id THEN 16 ELSE 0 END) AS mask
  FROM d
), said AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id
), counted AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS n_good, sum(coalesce(bad, 0)) AS n_toxic
  FROM masks LEFT JOIN said ON said.doc_id = masks.doc_id GROUP BY part, mask
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, instr('ABCDE', filter_order[step]) - 1 AS i,
         list_sum(list_transform(range(1, step + 1), lambda j: 1 << (instr('ABCDE', filter_order[j]) - 1)))::BIGINT AS done
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), found AS (
  SELECT part, filter_order, step, i,
    sum(CASE WHEN mask & done = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & done = 1 << i THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & (1 << i) <> 0 AND mask & done <> 1 << i THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = 1 << i THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & done = 1 << i THEN n_good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & done = 1 << i THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, i
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley
FROM found
"""

TILE_SEARCH_SQL = """
WITH fit AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM fit q JOIN fit c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""
