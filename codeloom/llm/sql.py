"""DuckDB SQL for the queries that SQL can express over whole tables.

SimHash and mixing need XXH64, language ID, quality and masked likelihood train models,
HTML is parsed and suffix dedup works on bytes; tests hold those against brute force.
"""

from __future__ import annotations

_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW.format("text") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATE = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (n, t)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_CHAT = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS rn FROM t),
k AS (SELECT conv_id, count(*) AS turns, max(rn) FILTER (role = 'assistant') AS l, min(rn) FILTER (role = 'assistant') AS f FROM n GROUP BY 1),
x AS (SELECT k.conv_id, k.l, k.f, a.text AS last_text, b.text AS first_text, CASE WHEN l IS NULL THEN turns WHEN f < l AND a.text = b.text THEN l ELSE l - 1 END AS p
  FROM k LEFT JOIN n a ON a.conv_id = k.conv_id AND a.rn = k.l LEFT JOIN n b ON b.conv_id = k.conv_id AND b.rn = k.f),
pr AS (SELECT x.conv_id, string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY rn) AS prompt
  FROM x JOIN n ON n.conv_id = x.conv_id AND rn <= p GROUP BY 1)
SELECT x.conv_id, CAST(p AS INTEGER) AS prompt_turns, coalesce(prompt, '') AS prompt,
 CASE WHEN l IS NULL OR p = l THEN '' ELSE '<|assistant|>' || chr(10) || last_text || '<|end|>' || chr(10) END AS chosen,
 CASE WHEN l IS NULL OR p = l OR f = l THEN '' ELSE '<|assistant|>' || chr(10) || first_text || '<|end|>' || chr(10) END AS rejected,
 CASE WHEN l IS NULL OR p = l THEN '' ELSE '14-' || (22 + length(last_text)) END AS chosen_spans,
 CASE WHEN l IS NULL OR p = l OR f = l THEN '' ELSE '14-' || (22 + length(first_text)) END AS rejected_spans
FROM x LEFT JOIN pr USING (conv_id)
"""


def _strength(level: str, parent: str) -> str:
    """Pseudo-count of a beta prior by the method of moments, between 1 and 1000."""
    pq = f"{parent} * (1 - {parent})"
    return f"""(SELECT coalesce(CASE WHEN npq <= pq OR s <= pq THEN 1000 ELSE least(1000, greatest(1, (npq - pq) / (s - pq) - 1)) END, 1000.0) AS k
 FROM (SELECT sum(n * power(bad / n - {parent}, 2)) AS s, sum({pq}) AS pq, sum({pq} * n) AS npq FROM {level} WHERE n > 0))"""


_HOST = "coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_TWO = "('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.cn', 'gov.uk', 'org.uk')"
_LAST = "array_to_string(list_reverse(list_reverse(string_split(host, '.'))[1:{0}]), '.')"

_URLS = f"""
WITH lab AS (SELECT doc_id, max(CASE WHEN quality = 0 OR coalesce(toxic, 0) = 1 THEN 1 WHEN quality IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY 1),
own AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
  try_cast(regexp_extract(url, '://[^/?#]*/(?:[^?#]*/)?([0-9]{{1,18}})(?:[/.?#]|$)', 1) AS BIGINT) AS number FROM pages),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM own LEFT JOIN lab ON number = doc_id GROUP BY 1),
h1 AS (SELECT *, {_LAST.format(2)} AS two FROM h0),
h2 AS (SELECT host, n, bad, CASE WHEN two IN {_TWO} THEN {_LAST.format(3)} ELSE two END AS domain, CASE WHEN two IN {_TWO} THEN two ELSE {_LAST.format(1)} END AS suffix FROM h1),
overall AS (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1.0::DOUBLE) AS rate FROM h2),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT rate FROM overall) AS parent FROM h2 GROUP BY 1),
s2 AS (SELECT suffix, (bad + k * parent) / (n + k) AS suffix_rate FROM s, {_strength("s", "parent")}),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, any_value(suffix_rate) AS suffix_rate FROM h2 JOIN s2 USING (suffix) GROUP BY 1, 2),
d2 AS (SELECT domain, (bad + k * suffix_rate) / (n + k) AS domain_rate FROM d, {_strength("d", "suffix_rate")}),
h3 AS (SELECT host, n, bad, domain_rate FROM h2 JOIN d2 USING (domain)),
h4 AS (SELECT host, bad + k * domain_rate AS a, n - bad + k * (1 - domain_rate) AS b FROM h3, {_strength("h3", "domain_rate")}),
h5 AS (SELECT host, round(a / (a + b), 6) AS rate, round(greatest(0, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))), 6) AS bound FROM h4),
cut AS (SELECT min(bound) AS bound FROM (SELECT bound, sum(count(*)) OVER (ORDER BY bound) AS upto, (SELECT count(*) FROM h5) AS whole FROM h5 GROUP BY 1) WHERE upto >= whole * 0.9),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(v, rh, rp)),
fit AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM own JOIN rules
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN bound > (SELECT least(0.5, bound) FROM cut) THEN 'block' ELSE 'allow' END) AS verdict,
 rate AS bad_rate, bound AS bad_bound
FROM own JOIN h5 USING (host) LEFT JOIN fit USING (page_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_decontaminate": _DECONTAMINATE, "op4_chat_pairs": _CHAT, "op9_url_reputation": _URLS}
