"""DuckDB SQL for the rows of those operator queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"


def _water(name: str, source: str, group: str, order: str) -> str:
    """Common table `name`: `source` (weight, cap, total) with share, as mixing.water_fill."""
    part = f"PARTITION BY {group} " if group else ""
    ratio = "CASE WHEN weight > 0 THEN cap::DOUBLE / weight ELSE 0 END"
    return f"""{name}_r AS (SELECT *, {ratio} AS ratio FROM {source}),
{name}_l AS (SELECT *, coalesce(sum(cap) OVER ({part}ORDER BY ratio, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
sum(weight) OVER ({part}ORDER BY ratio, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}_r),
{name}_f AS (SELECT *, CASE WHEN rest > 0 THEN (total - used)::DOUBLE / rest END AS level FROM {name}_l),
{name} AS (SELECT *, CASE WHEN NOT (ratio <= level) THEN weight * max(CASE WHEN NOT (ratio <= level) THEN level END) OVER ({part or ''}) ELSE cap::DOUBLE END AS share FROM {name}_f)"""


MIX = f"""WITH d AS (SELECT doc_id, source, len({WORDS.format('text')}) AS size,
(('0x' || substr(md5('20260911:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656 AS u FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
ranked AS (SELECT source, source_size, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM by_source),
{_water('w', 'ranked', '', 'source')},
sizes AS (SELECT d.source, d.size, w.source_size, w.share AS target, count(*) AS n FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source GROUP BY ALL),
parts AS (SELECT source, size, source_size, target, n, CASE WHEN size > 0 THEN n * pow(size::DOUBLE, 0.75::DOUBLE) ELSE 0 END AS weight, n * size * 3 AS cap, target AS total FROM sizes),
{_water('x', 'parts', 'source', 'size')},
e AS (SELECT source, size, source_size, target, round(least(CASE WHEN size > 0 THEN share / (n * size) ELSE 0 END, 3.0::DOUBLE), 9) AS expected FROM x),
k AS (SELECT d.doc_id, d.source, d.size, e.source_size, e.target, floor(e.expected) AS whole, e.expected - floor(e.expected) AS part, d.u FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.size = e.size),
r AS (SELECT *, CASE WHEN part > 0 THEN (u / (1 - u)) * ((1 - part) / part) END AS rank_key, target - sum(size * whole) OVER (PARTITION BY source) AS need FROM k),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, rank_key IS NULL ORDER BY rank_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (whole + CASE WHEN rank_key IS NOT NULL AND before + size / 2.0::DOUBLE <= need THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c"""

LM = f"""WITH t AS (SELECT doc_id, row_number() OVER () AS doc, crc, list_append({WORDS.format(f"translate(text, '{UPPER}', '{LOWER}')")}, '') AS w FROM
(SELECT doc_id, text, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
lambda a, b: xor(a >> 8, list_reduce(list_prepend(xor(a, b) & 255, list_transform(range(8), lambda i: i::BIGINT)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END))) AS crc FROM documents)),
d AS (SELECT doc_id, doc, w, xor(crc, 4294967295::BIGINT) % 5 = 1 AS held_out FROM t),
tok AS (SELECT doc_id, doc, held_out, unnest(w) AS v, unnest(list_prepend('', w[1:len(w) - 1])) AS u FROM d),
uni AS (SELECT v, count(*) AS c FROM tok WHERE NOT held_out GROUP BY v),
bi AS (SELECT u, v, count(*) AS c FROM tok WHERE NOT held_out GROUP BY u, v),
n AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM uni),
s AS (SELECT tok.doc_id, doc, held_out, coalesce(uni.c, 0) AS c, coalesce(bi.c, 0) AS cuv, coalesce(ctx.c, 0) AS cu, n.n, (coalesce(uni.c, 0) + 0.5::DOUBLE) / (n.n + 0.5::DOUBLE * (n.v + 1)) AS p
FROM tok LEFT JOIN uni ON tok.v = uni.v LEFT JOIN bi ON tok.u = bi.u AND tok.v = bi.v LEFT JOIN uni ctx ON tok.u = ctx.v, n)
SELECT doc_id, held_out, count(*) AS n_tokens, CAST(sum(CASE WHEN c > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_known, any_value(n) AS train_tokens, round(sum(log10(p)), 6) AS base_score,
round(sum(log10((cuv + 100.0::DOUBLE * p) / (cu + 100.0::DOUBLE))), 6) AS score FROM s GROUP BY doc_id, doc, held_out"""

ANN = """WITH e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64
AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, 65), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i]))), lambda a, x: a + x)) AS score
FROM e q JOIN e c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM n WHERE rank <= 10"""


def _shrunk(name: str, groups: str, above: str, keys: str) -> str:
    on = " AND ".join(f"g.{k} = p.{k}" for k in keys.split()) if keys else "true"
    return f"""{name}_k AS (SELECT g.*, p.a / (p.a + p.b) AS prior FROM {groups} g JOIN {above} p ON {on}),
{name}_s AS (SELECT coalesce(least(greatest(1 / greatest((sum(n * pow(bad / n - prior, 2)) - sum(prior * (1 - prior))) / nullif(sum(prior * (1 - prior) * (n - 1)), 0), 1e-9::DOUBLE) - 1, 1.0::DOUBLE), 1000.0::DOUBLE), 1000.0::DOUBLE) AS strength FROM {name}_k),
{name} AS (SELECT k.* EXCLUDE (bad, n, prior), prior * strength + bad AS a, (1 - prior) * strength + n - bad AS b FROM {name}_k k, {name}_s)"""


def urls(rules) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    case = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in ordered)
    block = ", ".join(f"'{h}{p}'" for v, h, p in rules if v == "block")
    return f"""WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT *, CASE {case} END AS rule FROM h),
m AS (SELECT *, CASE WHEN rule IN ({block}) THEN 1 WHEN rule IS NOT NULL THEN 0 END AS bad, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', '') AS name FROM r),
l AS (SELECT *, string_split(name, '.') AS labs FROM m),
s AS (SELECT *, CASE WHEN len(labs) < 2 OR regexp_matches(name, '^[0-9.]+$|^\\[') THEN '' WHEN length(labs[len(labs)]) = 2 AND len(labs) > 2 AND labs[len(labs) - 1] IN ('ac', 'co', 'com', 'edu', 'gov', 'go', 'mil', 'ne', 'net', 'or', 'org')
THEN labs[len(labs) - 1] || '.' || labs[len(labs)] ELSE labs[len(labs)] END AS suffix FROM l),
d AS (SELECT *, CASE WHEN suffix = '' THEN name ELSE array_to_string(labs[len(labs) - least(len(string_split(suffix, '.')) + 1, len(labs)) + 1:len(labs)], '.') END AS domain FROM s),
hosts AS (SELECT suffix, domain, name, sum(bad)::DOUBLE AS bad, count(*)::DOUBLE AS n FROM d WHERE bad IS NOT NULL AND name <> '' GROUP BY ALL),
domains AS (SELECT suffix, domain, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY ALL), suffixes AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM domains GROUP BY ALL),
ev AS (SELECT coalesce(sum(bad), 0) + 0.5::DOUBLE AS a, coalesce(sum(n), 0) - coalesce(sum(bad), 0) + 0.5::DOUBLE AS b FROM suffixes),
{_shrunk('bs', 'suffixes', 'ev', '')}, {_shrunk('bd', 'domains', 'bs', 'suffix')}, {_shrunk('bh', 'hosts', 'bd', 'suffix domain')},
j AS (SELECT d.page_id, d.host, d.path, d.rule, coalesce(bh.a, bd.a, bs.a, ev.a) AS a, coalesce(bh.b, bd.b, bs.b, ev.b) AS b FROM d LEFT JOIN bh ON d.suffix = bh.suffix AND d.domain = bh.domain AND d.name = bh.name
LEFT JOIN bd ON d.suffix = bd.suffix AND d.domain = bd.domain LEFT JOIN bs ON d.suffix = bs.suffix, ev)
SELECT page_id, host, path, rule, CASE WHEN rule IN ({block}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN a / (a + b) - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM j"""


JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(text, '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-6),
reach AS (SELECT a, b FROM p UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a),
c AS (SELECT a, least(min(b), a) AS class_id FROM reach GROUP BY a), k AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(k.n, 0) AS n_links FROM documents d LEFT JOIN c ON d.doc_id = c.a LEFT JOIN k ON d.doc_id = k.a"""

# The article of pages as these tables have them: headings and paragraphs, with bold text and line breaks.
PAGES = r"""WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(a, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(
regexp_replace(replace(x, '<br>', ' '), '</?b>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS b FROM a),
t AS (SELECT page_id, url, regexp_replace(array_to_string(list_filter(b, lambda x: x <> ''), chr(10)), '&amp\b', '&', 'g') AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM t"""

TERMS = r"regexp_extract_all(translate(coalesce({0}, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')" % (UPPER, LOWER)

SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS.format('text')} AS w FROM documents),
s AS (SELECT r, doc_id, len(w)::BIGINT AS n, w FROM d WHERE len(w) > 0),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM s),
i AS (SELECT DISTINCT item_id, unnest({TERMS.format('text')}) AS t FROM benchmark),
p AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(w) AS t FROM s) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
f AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY t, docs),
c AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score FROM i JOIN p USING (t) JOIN f USING (t), g GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0)
SELECT * FROM k WHERE rank <= 50"""


def _rounds(n: int, dims: int = 64) -> str:
    """Assignments a0 to a{n} of vectors v to centroids c0 to c{n}, each moved by the assignment before."""
    out = []
    for i in range(n + 1):
        square = f"list_reduce(list_prepend(0::BIGINT, list_transform(range(1, {dims + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))), lambda a, y: a + y)"
        out.append(f"a{i} AS (SELECT r, min(struct_pack(d := d, k := k)) AS b FROM (SELECT r, k, {square} AS d FROM v, c{i} c) GROUP BY r)")
        if i < n:
            out.append(f"m{i} AS (SELECT b.k AS k, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM (SELECT b, x, unnest(range(1, {dims + 1})) AS j FROM a{i} JOIN v USING (r)) GROUP BY ALL)")
            out.append(f"c{i + 1} AS (SELECT o.k, coalesce(l, o.x) AS x FROM c{i} o LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS l FROM m{i} GROUP BY k) q ON o.k = q.k)")
    return ",\n".join(out)


CENTROIDS = f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT k, x FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS k, x FROM v) WHERE k < 16),
{_rounds(3)},
j AS (SELECT vec_id, b.k AS k, b.d AS d FROM a3 JOIN v USING (r)), s AS (SELECT k, sum(d)::BIGINT AS d FROM j GROUP BY k)
SELECT vec_id, CAST(j.k AS INTEGER) AS cluster, j.d::BIGINT AS distance, s.d AS cluster_inertia, (SELECT sum(d)::BIGINT FROM j) AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM j JOIN s ON j.k = s.k JOIN c3 ON j.k = c3.k"""
