"""SQL that DuckDB runs on the same tables, for the queries that SQL can express."""

from __future__ import annotations

from dossier.llm import collocations, licenses, line_rules


def url_filters(rules: tuple[tuple[str, str], ...]) -> str:
    """Rules by subdomain and prefix, then blocks carried along canonical links and redirects."""
    values = ", ".join(f"('{verdict}', '{rule}')" for verdict, rule in rules)
    attribute = (
        "regexp_replace(regexp_extract(tag, '(?is)\\b{0}\\s*=\\s*(\"[^\"]*\"|''[^'']*''|[^\"''\\s>]+)', 1), '^[\"'']|[\"'']$', '', 'g')"
    )
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH RECURSIVE rules(verdict, rule) AS (VALUES {values}),
tags AS (
  SELECT url AS from_url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\\b(?:[^>=]|=\\s*(?:"[^"]*"|''[^'']*'')?)*>')) AS tag
  FROM pages WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
attrs AS (
  SELECT from_url, {attribute.format("rel")} AS rel, {attribute.format("href")} AS href,
         {attribute.format("http-equiv")} AS http, {attribute.format("content")} AS cont FROM tags),
hrefs AS (
  SELECT from_url, trim(replace(CASE
    WHEN regexp_matches(lower(rel), '(^|\\s)canonical(\\s|$)') THEN href
    WHEN lower(http) = 'refresh' THEN regexp_extract(cont, '(?is)url\\s*=\\s*["'']?([^"''\\s]+)', 1) END, '&amp;', '&')) AS href
  FROM attrs),
based AS (
  SELECT from_url, href, regexp_extract(from_url, '(?s)^(.*?)://', 1) AS scheme, translate(regexp_extract(rest, '^([^/?#]*)', 1), {upper}) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT from_url, href, {rest.replace("url", "from_url")} AS rest FROM hrefs WHERE href IS NOT NULL AND from_url IS NOT NULL)),
joined AS (
  SELECT * FROM (
    SELECT from_url, CASE
      WHEN href = '' THEN NULL
      WHEN starts_with(href, '//') THEN scheme || ':' || href
      WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
      WHEN starts_with(href, '/') THEN scheme || '://' || host || href
      WHEN regexp_matches(href, '^[?#]') THEN scheme || '://' || host || path || href
      WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
      ELSE scheme || '://' || host || coalesce(nullif(regexp_extract(path, '(?s)^(.*/)', 1), ''), '/') || href END AS to_url
    FROM based) WHERE to_url IS NOT NULL),
cut AS (
  SELECT from_url, to_url, regexp_extract(to_url, '(?s)^(.*?://[^/?#]*)', 1) AS place, regexp_extract(to_url, '(?s)://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(to_url, '(?s)://[^?#]*(.*)$', 1) AS rest FROM joined),
segments AS (SELECT *, string_split(substr(path, 2), '/') AS s FROM cut),
-- A segment stays unless, up to some later one, the steps up outnumber the names since it.
links AS (
  SELECT from_url, CASE WHEN regexp_matches(path, '/\\.\\.?(/|$)') THEN place || '/' || array_to_string(
    [s[i] FOR i IN range(1, len(s) + 1) IF s[i] NOT IN ('.', '..') AND
      NOT coalesce(list_bool_or([list_sum([CASE x WHEN '..' THEN 1 WHEN '.' THEN 0 ELSE -1 END FOR x IN s[i + 1:j]]) > 0 FOR j IN range(i + 1, len(s) + 1)]), false)]
    || CASE WHEN s[-1] IN ('.', '..') THEN [''] ELSE [] END, '/') || rest ELSE to_url END AS to_url
  FROM segments),
places AS (
  SELECT url, translate(regexp_extract(rest, '^([^/?#]*)', 1), {upper}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         CASE WHEN instr(url, '://') > 0 THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), {upper}) || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) END AS node
  FROM (SELECT url, {rest} AS rest FROM (SELECT url FROM pages UNION SELECT from_url FROM links UNION SELECT to_url FROM links))),
judged AS (
  SELECT url, rule, verdict FROM (
    SELECT p.url, r.rule, r.verdict, row_number() OVER (PARTITION BY p.url ORDER BY length(r.rule) DESC, instr(r.rule, '/') DESC) AS n
    FROM places p JOIN rules r
      ON (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
     AND starts_with(p.path, substr(r.rule, instr(r.rule, '/')))) WHERE n = 1),
pairs AS (
  SELECT DISTINCT f.node AS a, t.node AS b FROM links l JOIN places f ON f.url = l.from_url JOIN places t ON t.url = l.to_url WHERE f.node <> t.node),
sides AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a, b FROM sides UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a),
classes AS (SELECT a AS node, min(least(a, b)) AS alias_of FROM reach GROUP BY a),
blocked AS (
  SELECT DISTINCT c.alias_of FROM classes c JOIN places p USING (node) JOIN judged j USING (url)
  WHERE j.verdict = 'block' AND (p.url IN (SELECT from_url FROM links) OR p.url IN (SELECT to_url FROM links)))
SELECT g.page_id, p.host, p.path, j.rule, coalesce(j.verdict, CASE WHEN b.alias_of IS NOT NULL THEN 'block' END, 'allow') AS verdict,
       CASE WHEN j.rule IS NOT NULL THEN 'rule' WHEN b.alias_of IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by, c.alias_of
FROM pages g LEFT JOIN places p ON p.url IS NOT DISTINCT FROM g.url LEFT JOIN judged j ON j.url = g.url
LEFT JOIN classes c ON c.node = p.node LEFT JOIN blocked b ON b.alias_of = c.alias_of"""


def license_scan(templates: tuple[tuple[str, str], ...] = licenses.TEMPLATES, alike: float = licenses.ALIKE) -> str:
    """Every unit of every document against every template by Dice over distinct word bigrams."""
    known = [(name, licenses.plain_bigrams(text)) for name, text in templates]
    values = ", ".join(f"('{name}', [{', '.join(repr(b) for b in grams)}])" for name, grams in known if grams)
    return f"""
WITH templates(license, grams) AS (VALUES {values}),
units AS (
  SELECT doc_id, unnest(list_distinct(list_concat(
    string_split_regex(body, '\\r?\\n|\\r'), string_split_regex(body, '(?:\\r?\\n|\\r)[ \\t]*(?:\\r?\\n|\\r)[ \\t\\r\\n]*'), [body]))) AS unit
  FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents)),
words AS (SELECT doc_id, unit, string_split(trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units),
grams AS (SELECT doc_id, unit, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS grams FROM words),
scored AS (
  SELECT g.doc_id, g.unit, t.license, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
  FROM grams g JOIN templates t ON len(g.grams) BETWEEN {alike / (2 - alike) - 1e-9} * len(t.grams) AND len(t.grams) / {alike / (2 - alike) - 1e-9}),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) AS n FROM scored WHERE dice >= {alike}) WHERE n = 1),
found AS (
  SELECT doc_id, max(dice) AS dice, CAST(count(*) AS INTEGER) AS n_matches,
         list_sort(list(DISTINCT license)) AS licenses FROM best GROUP BY doc_id),
named AS (SELECT b.doc_id, min(b.license) AS license FROM best b JOIN found f ON f.doc_id = b.doc_id AND f.dice = b.dice GROUP BY b.doc_id)
SELECT d.doc_id, n.license, f.dice, coalesce(f.n_matches, 0) AS n_matches, coalesce(f.licenses, []) AS licenses
FROM documents d LEFT JOIN found f USING (doc_id) LEFT JOIN named n USING (doc_id)"""


def line_rules_sql() -> str:
    """Lines, words and windows as rows; repeated windows by a count over the document."""
    quoted = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    boiler = " OR ".join(f"contains(lower(line), '{p}')" for p in line_rules.BOILERPLATE)
    word, symbols = "'[^\\x20\\x09-\\x0D]+'", "'[#*$%&|<>]'"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, regexp_extract_all(text, {word}) AS ws FROM docs),
starts AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM words),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS n FROM starts),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM windows, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY rid),
lines AS (SELECT rid, line, regexp_extract_all(line, {word}) AS ws FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs)),
tried AS (
  SELECT rid, line, len(ws) AS n,
    (right(ws[-1], 1) NOT IN ({quoted(line_rules.END_MARKS)})
     AND {line_rules.PROSE_WORDS} * len(list_filter(ws, lambda w: right(w, 1) IN ({quoted(line_rules.END_MARKS)}))) < len(ws))
    OR {line_rules.NAV_SHARE} * len(list_filter(ws, lambda w: w IN ({quoted(line_rules.NAV_MARKS)}))) >= len(ws)
    OR 100 * len(regexp_extract_all(line, {symbols})) > {line_rules.SYMBOL_SHARE} * len(ws)
    OR 100 * len(list_filter(ws, lambda w: right(w, 2) IN ({quoted(line_rules.SHOUTS)}))) >= {line_rules.SHOUT_SHARE} * len(ws)
    OR (len(ws) <= {line_rules.BOILER_WORDS} AND ({boiler})) AS failed
  FROM lines WHERE len(ws) > 0),
by_doc AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup, count(*) FILTER (WHERE failed) AS n_failed,
         coalesce(sum(n) FILTER (WHERE failed), 0) AS n_lost
  FROM tried GROUP BY rid),
measured AS (
  SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, {symbols})) AS BIGINT) AS n_symbols, coalesce(n_dup, 0) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_failed, 0) AS n_failed_lines,
         CAST(coalesce(n_lost, 0) AS BIGINT) AS n_lost_words
  FROM docs JOIN words USING (rid) LEFT JOIN covered c USING (rid) LEFT JOIN by_doc USING (rid))
SELECT *, n_words < {line_rules.LEAST_WORDS} OR 100 * n_repeat_words > {line_rules.REPEAT_SHARE} * n_words AS base_failed,
       NOT (n_words < {line_rules.LEAST_WORDS} OR 100 * n_repeat_words > {line_rules.REPEAT_SHARE} * n_words)
       AND 100 * n_lost_words <= {line_rules.LOST_SHARE} * n_words AS kept
FROM measured"""


def collocations_sql() -> str:
    """All phrases of up to three words counted and scored, without bounds."""
    upper = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, '{collocations.UNKNOWN}') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), {upper}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
one AS (SELECT lang, ws[i] AS x, count(*) AS f FROM places GROUP BY ALL),
two AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, count(*) AS f FROM places WHERE i + 1 <= len(ws) GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
three AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z, count(*) AS f FROM places WHERE i + 2 <= len(ws) GROUP BY ALL HAVING count(*) >= {collocations.LEAST}),
longer AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL),
cuts AS (
  SELECT t.lang, t.x || ' ' || t.y AS phrase, 1 AS k, t.f AS a, p.f AS l, q.f AS r
  FROM two t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN one q ON q.lang = t.lang AND q.x = t.y
  LEFT JOIN longer g ON g.lang = t.lang AND g.x = t.x AND g.y = t.y
  WHERE g.f IS NULL OR 100 * g.f < {collocations.SHARE} * t.f
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, 1, t.f, p.f, q.f
  FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, 2, t.f, p.f, q.f
  FROM three t JOIN two p ON p.lang = t.lang AND p.x = t.x AND p.y = t.y JOIN one q ON q.lang = t.lang AND q.x = t.z),
scored AS (SELECT *, (a::HUGEINT * a * {collocations.SCALE}) // (l::HUGEINT * r) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {collocations.LIMIT}"""
