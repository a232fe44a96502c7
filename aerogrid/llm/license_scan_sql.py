"""DuckDB SQL for the rows of the licence scan on ``pages``."""

from __future__ import annotations

import math

from aerogrid.llm.common import UPPER
from aerogrid.llm.license_scan import FILE_NAME, TEMPLATES, terms, weigh


def _number(x: float) -> str:
    return repr(x) if "e" in repr(x) else f"{x!r}e0"


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> str:
    weights, other = weigh(templates)
    squares = ", ".join(f"('{t}', {_number(w * w)})" for t, w in sorted(weights.items()))
    norms = [math.sqrt(sum(weights[t] ** 2 for t in terms(text))) for _, text in templates]
    dots = ", ".join(f"({i}, '{lic}', '{t}', {_number(weights[t] ** 2 / norms[i])})"
                     for i, (lic, text) in enumerate(templates) for t in sorted(terms(text)))
    lower = f"translate(line, '{UPPER}', '{UPPER.lower()}')"
    return rf"""
WITH w(term, sq) AS (VALUES {squares}),
t(template, license, term, dot) AS (VALUES {dots}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest,
             regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
               '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', chr(10), 'g'),
               '(?i)</?(?:b|i|em|strong|span|a|u|small)(?:\s[^>]*)?>', '', 'g'), '<[^>]*>', chr(10), 'g') AS text FROM pages),
h AS (SELECT page_id, text, regexp_extract(rest, '^[^/?#]*') AS host, rest FROM u),
f AS (SELECT page_id, rtrim(translate(host, '{UPPER}', '{UPPER.lower()}') || regexp_extract(substr(rest, length(host) + 1), '^[^?#]*'), '/') AS path,
             [x FOR x IN regexp_split_to_array(text, '[\r\n]+') IF trim(x) <> ''] AS lines FROM h),
l AS (SELECT row_number() OVER () AS lid, path, i = 1 AS is_title, lines[i] AS line
      FROM (SELECT path, lines, unnest(range(1, len(lines) + 1)) AS i FROM f) x),
tw AS (SELECT lid, unnest(list_distinct(regexp_extract_all({lower}, '[a-z0-9]+'))) AS term FROM l),
n AS (SELECT lid, sum(sq) AS own, sum(sq) + (count(*) - count(sq)) * {_number(other * other)} AS norm2
      FROM tw LEFT JOIN w USING (term) GROUP BY lid HAVING count(sq) > 0),
m AS (SELECT lid, norm2 FROM n WHERE own >= norm2 * {_number(threshold * threshold)} - 1e-9),
s AS (SELECT lid, license, round(sum(dot) / sqrt(norm2), 6) AS score
      FROM m JOIN tw USING (lid) JOIN t USING (term) GROUP BY lid, template, license, norm2),
best AS (SELECT path, is_title, license, score FROM s JOIN l USING (lid) WHERE score >= {threshold}
         QUALIFY row_number() OVER (PARTITION BY lid ORDER BY score DESC, license) = 1),
own AS (SELECT path, license, score, bool_or(is_title) OVER (PARTITION BY path)
               OR regexp_matches(split_part(path, '/', -1), '{FILE_NAME}') AS speaks
        FROM best QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
declared AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS up, license AS up_license, score AS up_score FROM own WHERE speaks
             QUALIFY row_number() OVER (PARTITION BY up ORDER BY score DESC, license) = 1),
dirs AS (SELECT DISTINCT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM f),
nearest AS (SELECT dir, up, up_license, up_score
            FROM (SELECT dir, unnest([array_to_string(names[1:k], '/') FOR k IN range(1, len(names) + 1)]) AS up
                  FROM (SELECT dir, string_split(dir, '/') AS names FROM dirs) x) y JOIN declared USING (up)
            QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(up) DESC) = 1)
SELECT f.page_id, f.path, coalesce(license, up_license) AS license,
       CASE WHEN license IS NOT NULL THEN score ELSE up_score END AS score,
       CASE WHEN license IS NOT NULL THEN CASE WHEN speaks THEN 'file' ELSE 'header' END
            WHEN up_license IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN license IS NULL THEN up END AS from_dir
FROM f LEFT JOIN own USING (path) LEFT JOIN nearest ON dir = regexp_extract(f.path, '^(.*)/[^/]*$', 1)
"""
