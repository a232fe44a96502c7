"""DuckDB SQL for the rows of ``url_filter.filter_urls`` on ``pages``."""

from __future__ import annotations

from aerogrid.llm.common import UPPER
from aerogrid.llm.url_filter import ALPHABET, START, A, Rule


def _lower(expr: str) -> str:
    return f"translate({expr}, '{UPPER}', '{UPPER.lower()}')"


def _model(n: str) -> str:
    """Log probability of every trigram that occurs, from the counts ``n``."""
    return f"""
SELECT k.p2, k.p1, k.c, ln(CASE WHEN coalesce(a2.n, 0) > 0 THEN (coalesce(g.{n}, 0) + a2.kinds * k.prob1) / (a2.n + a2.kinds) ELSE k.prob1 END) AS logp
FROM (SELECT DISTINCT k.p2, k.p1, k.c, CASE WHEN coalesce(a1.n, 0) > 0 THEN (coalesce(n1.n, 0) + a1.kinds * p0) / (a1.n + a1.kinds) ELSE p0 END AS prob1
      FROM (SELECT DISTINCT c.p2, c.p1, c.c, (coalesce(n0.n, 0) + 1.0) / (coalesce((SELECT sum({n}) FROM g), 0) + {A}) AS p0
            FROM c LEFT JOIN (SELECT c, sum({n}) AS n FROM g GROUP BY c) n0 ON n0.c = c.c) k
      LEFT JOIN (SELECT p1, c, sum({n}) AS n FROM g GROUP BY p1, c) n1 ON n1.p1 = k.p1 AND n1.c = k.c
      LEFT JOIN (SELECT p1, sum({n}) AS n, count(DISTINCT CASE WHEN {n} > 0 THEN c END) AS kinds FROM g GROUP BY p1) a1 ON a1.p1 = k.p1) k
LEFT JOIN g ON g.p2 = k.p2 AND g.p1 = k.p1 AND g.c = k.c
LEFT JOIN (SELECT p2, p1, sum({n}) AS n, count_if({n} > 0) AS kinds FROM g GROUP BY p2, p1) a2 ON a2.p2 = k.p2 AND a2.p1 = k.p1
"""


def oracle(rules: list[Rule]) -> str:
    listed = ", ".join(f"('{r.name}', '{r.action}', '{r.host}', '{r.path}')" for r in rules)
    return f"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, {_lower("coalesce(url, '')")} AS t,
                  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT rid, page_id, t, {_lower("regexp_extract(rest, '^[^/?#]*')")} AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r AS (SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
      FROM h JOIN (VALUES {listed}) AS v(rule, action, rhost, rpath)
      ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid),
j AS (SELECT h.*, r.rule, r.action FROM h LEFT JOIN r ON h.rid = r.rid),
s AS (SELECT rid, action, [instr('{ALPHABET}', x) FOR x IN regexp_extract_all(t, '(?s).')] AS s FROM j),
c AS (SELECT rid, action, s[i] AS c, CASE WHEN i > 1 THEN s[i - 1] ELSE {START} END AS p1,
             CASE WHEN i > 2 THEN s[i - 2] ELSE {START} END AS p2
      FROM (SELECT rid, action, s, unnest(range(1, len(s) + 1)) AS i FROM s) x),
g AS (SELECT p2, p1, c, count_if(action = 'allow') AS good, count_if(action = 'block') AS bad
      FROM c WHERE action IS NOT NULL GROUP BY p2, p1, c),
m AS (SELECT a.p2, a.p1, a.c, a.logp - b.logp AS delta FROM ({_model("good")}) a
      JOIN ({_model("bad")}) b ON a.p2 = b.p2 AND a.p1 = b.p1 AND a.c = b.c),
e AS (SELECT c.rid, round(sum(delta) / count(*), 9) AS score
      FROM c JOIN m ON c.p2 = m.p2 AND c.p1 = m.p1 AND c.c = m.c GROUP BY c.rid),
o AS (SELECT j.*, coalesce(e.score, 0.0) AS score FROM j LEFT JOIN e ON j.rid = e.rid),
k AS (SELECT avg(score) FILTER (action = 'allow') AS am, stddev_pop(score) FILTER (action = 'allow') AS asd,
             avg(score) FILTER (action = 'block') AS bm, stddev_pop(score) FILTER (action = 'block') AS bsd FROM o),
t AS (SELECT CASE WHEN am IS NULL OR bm IS NULL THEN NULL WHEN asd + bsd = 0 THEN (am + bm) / 2
                  ELSE (am * bsd + bm * asd) / (asd + bsd) END AS threshold FROM k)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN threshold IS NULL OR score >= threshold THEN 'allow' ELSE 'block' END) AS verdict, score
FROM o, t
"""
