"""SQL of the corpus queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from tallyforge.llm.centroids import ORACLE as CENTROIDS
from tallyforge.llm.chat import ORACLE as CHAT
from tallyforge.llm.merkle import ORACLE as MERKLE
from tallyforge.llm.shared import LOWER, UPPER
from tallyforge.llm.url_filter import ORDER, REACH, STEPS, SYMBOLS

WORD = r"[^\x20\x09-\x0D]+"


def _level(k: int) -> str:
    """Smoothed probabilities of order k from those of order k - 1."""
    below = f"JOIN p{k - 1} ON p{k - 1}.gram = substr(c.gram, 2)" if k else ""
    prior = "p{0}.{{0}}p".format(k - 1) if k else f"{1 / SYMBOLS}::DOUBLE"
    p = ", ".join(f"CASE WHEN s.{x}all = 0 THEN {prior.format(x)} ELSE (c.{x} + s.{x}kinds * {prior.format(x)}) / (s.{x}all + s.{x}kinds) END AS {x}p" for x in "ar")
    return f"""
c{k} AS (SELECT substr(gram, {ORDER - k + 1}) AS gram, sum(a)::BIGINT AS a, sum(r)::BIGINT AS r FROM grams GROUP BY 1),
s{k} AS (SELECT substr(gram, 1, {k}) AS ctx, sum(a)::BIGINT AS aall, sum(r)::BIGINT AS rall, count(*) FILTER (a > 0) AS akinds, count(*) FILTER (r > 0) AS rkinds FROM c{k} GROUP BY 1),
p{k} AS (SELECT c.gram, {p} FROM c{k} c JOIN s{k} s ON s.ctx = substr(c.gram, 1, {k}) {below})"""


URLS = rf"""
WITH cut AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
         regexp_replace(translate(coalesce(url, ''), '{UPPER}', '{LOWER}'), '(?s)^.*?://', '') AS plain
  FROM pages
), ruled AS (
  SELECT *,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
         '{"^" * ORDER}' || regexp_replace(regexp_replace(plain, '[0-9]', '0', 'g'), '[^a-z0./_%?=&:#\-]', '*', 'g') || '$' AS symbols
  FROM cut
), marked AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS says, rule IS NOT NULL AND substr(md5(coalesce(url, '')), 1, 1) IN ('0', '1', '2') AS held FROM ruled
), grams AS (
  SELECT symbols, substr(symbols, i, {ORDER + 1}) AS gram, coalesce(says = 'allow' AND NOT held, false)::INT AS a, coalesce(says = 'block' AND NOT held, false)::INT AS r
  FROM (SELECT *, unnest(range(1, length(symbols) - {ORDER} + 1)) AS i FROM marked)
), {",".join(_level(k) for k in range(ORDER + 1))},
scores AS (SELECT symbols, round(avg(ln(ap) - ln(rp)), 9) AS score FROM grams JOIN p{ORDER} USING (gram) GROUP BY 1),
scored AS (SELECT m.*, score FROM marked m JOIN scores USING (symbols)),
bins AS (SELECT least(greatest(floor(score * {STEPS}), {-REACH * STEPS}), {REACH * STEPS})::INT AS step, count(*) FILTER (says = 'allow') AS good, count(*) FILTER (says = 'block') AS bad FROM scored WHERE held GROUP BY 1),
steps AS (SELECT x::INT AS step, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM range({-REACH * STEPS}, {REACH * STEPS} + 1) t(x) LEFT JOIN bins ON step = x),
tried AS (SELECT step, sum(good) OVER () AS goods, sum(bad) OVER () AS bads, coalesce(sum(good) OVER w, 0) AS lost, coalesce(sum(bad) OVER w, 0) AS caught FROM steps WINDOW w AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT step FROM tried WHERE goods > 0 AND bads > 0 ORDER BY (goods - lost) * bads + caught * goods DESC, abs(step), step LIMIT 1)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN score >= coalesce((SELECT step FROM best), 0) / {float(STEPS)} THEN 'allow' ELSE 'block' END) AS verdict FROM scored
"""

MIX = rf"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5(coalesce(CAST(doc_id AS STRING), '')) AS key FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY 1),
ranked AS (SELECT *, 3 * source_size AS "full", (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS ix FROM sizes),
levels AS (SELECT *, sum(source_size) OVER () - coalesce(sum("full") OVER (ORDER BY "full" / weight, ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(weight) OVER (ORDER BY "full" / weight, ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM ranked),
opened AS (SELECT *, "full" * weights > rest * weight AS is_open FROM levels),
lowest AS (SELECT rest, weights FROM opened WHERE is_open ORDER BY "full" / weight, ix LIMIT 1),
targets AS (SELECT o.source, o.source_size, CASE WHEN is_open THEN (lowest.rest * weight)::DOUBLE / lowest.weights::DOUBLE ELSE "full"::DOUBLE END AS target FROM opened o LEFT JOIN lowest ON true),
placed AS (SELECT doc_id, size, source_size, target, round(target)::BIGINT AS quota, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (greatest(0, least(start + size, quota) - start) + greatest(0, least(start + source_size + size, quota) - start - source_size) + greatest(0, least(start + 2 * source_size + size, quota) - start - 2 * source_size))::BIGINT AS taken FROM placed
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, i * 5 + j + 1, 1) AS INT) * (1 << (4 - j))))::BIGINT, 1)), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to, CAST(NULL AS STRING) AS problem
FROM d
"""

ORACLES = {"op1_url_filter": URLS, "op4_warc": WARC, "op6_chat": CHAT, "op9_mixing": MIX, "op11_merkle": MERKLE, "op13_centroids": CENTROIDS}
