"""DuckDB equivalents of the queries that SQL can express. The others are tested against plain Python in tests/llm.

No form in SQL: op2 and op9 (trained models), op5 (tokenizer and packing), op6 (64-bit hashes of n-grams), op8
(alignments of templates by corpus frequency).
"""

from __future__ import annotations

from . import sharding

_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def op1(shards: list[str]) -> str:
    table = ",".join(map(str, sharding.lookup_table(shards)))
    return f"""
    WITH t AS (SELECT string_split('{table}', ',') AS slots),
    d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
      CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE} AS slot FROM documents)
    SELECT doc_id, slot, CAST(slots[slot + 1] AS INTEGER) AS shard, n_bytes FROM d, t"""


def op3(rules: list[tuple[str, str, str]]) -> str:
    """The tables' pages declare no canonical or refresh links (SQL's patterns couldn't find them as well), so only rules decide here."""
    values = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in rules)
    return rf"""
    WITH r AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, {_LOW.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM r),
    rules(action, rh, rp) AS (VALUES {values}),
    best AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(action, length(rh || rp)) AS action
      FROM h, rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
    SELECT h.page_id, host, path, rule, coalesce(action, 'allow') AS verdict, CASE WHEN rule IS NULL THEN 'default' ELSE 'rule' END AS via
    FROM h LEFT JOIN best USING (page_id)"""


OP4 = rf"""
WITH a AS (SELECT doc_id, text, string_split(text, chr(10)) AS al FROM documents),
u AS (SELECT doc_id, unnest(al) AS line, generate_subscripts(al, 1) AS i FROM a),
n AS (SELECT doc_id, i, line, len({_SPACED.format("line")}) AS words FROM u),
k AS (SELECT *, sum(CASE WHEN words > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS li FROM n),
l AS (SELECT doc_id, li, line, words, sum(words) OVER (PARTITION BY doc_id ORDER BY li) AS cum FROM k WHERE words > 0),
f AS (SELECT x.doc_id, x.li AS b, min(y.li) AS e FROM l x JOIN l y ON x.doc_id = y.doc_id AND y.li >= x.li AND y.li < x.li + 50 AND y.cum - x.cum + x.words >= 50 GROUP BY 1, 2),
g AS (SELECT x.doc_id, max(y.li) AS b, x.li AS e FROM l x JOIN l y ON x.doc_id = y.doc_id AND y.li <= x.li AND y.li > x.li - 50 AND x.cum - y.cum + y.words >= 50 GROUP BY 1, 3),
blocks AS (SELECT * FROM f UNION SELECT * FROM g),
named AS (SELECT s.doc_id, s.b, s.e, string_agg(l.line, chr(10) ORDER BY l.li) AS body FROM blocks s JOIN l ON l.doc_id = s.doc_id AND l.li BETWEEN s.b AND s.e GROUP BY 1, 2, 3),
firsts AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, b) AS rn FROM named),
gone AS (SELECT DISTINCT s.doc_id, l.li FROM firsts s JOIN l ON l.doc_id = s.doc_id AND l.li BETWEEN s.b AND s.e WHERE rn > 1),
marked AS (SELECT k.*, gone.li IS NOT NULL AS cut FROM k LEFT JOIN gone ON k.doc_id = gone.doc_id AND k.li = gone.li)
SELECT a.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, CASE WHEN coalesce(n_deleted, 0) = 0 THEN a.text ELSE coalesce(left_text, '') END AS text
FROM a LEFT JOIN (SELECT doc_id, sum(CASE WHEN words > 0 THEN 1 ELSE 0 END)::BIGINT AS n_lines, sum(CASE WHEN words > 0 AND cut THEN 1 ELSE 0 END)::BIGINT AS n_deleted,
  string_agg(line, chr(10) ORDER BY i) FILTER (NOT cut) AS left_text FROM marked GROUP BY 1) m ON a.doc_id = m.doc_id"""

OP7 = rf"""
WITH d AS (SELECT doc_id, coalesce({_PLAIN.format(_LOW.format("text"))}, []) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_PLAIN.format(_LOW.format("text"))} AS w FROM benchmark),
bw AS (SELECT item, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS body FROM bw),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n),
hits AS (SELECT doc_id, s, dw.n, item FROM dw JOIN win ON win.n = dw.n AND win.body = array_to_string(w[s:s + dw.n - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hits) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)"""

OP10 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, coalesce({_SPACED.format(_LOW.format("text"))}, []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, r) AS (SELECT a, a FROM edges UNION SELECT reach.doc_id, b FROM reach JOIN edges ON reach.r = edges.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY 1) m USING (doc_id)"""
