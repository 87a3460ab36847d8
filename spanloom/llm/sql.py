"""Queries of this subpackage as SQL for DuckDB, by the definitions alone: all pairs through all
common runs, all windows, no sketches, samples or hashes."""

from __future__ import annotations

_PLAIN = r"""
w AS (SELECT doc_id, lower(trim(split, E' \t\r\n')) AS s, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL)"""

_PAIRS = _PLAIN + """,
runs AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w WHERE len(ws) >= 20),
n AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM runs a JOIN runs b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 6 * (x.n + y.n - c))"""

SQL = {
    "p2_found": f"""WITH {_PAIRS},
held AS (SELECT DISTINCT lower(trim(split, E' \\t\\r\\n')) AS s FROM heldout_config)
SELECT a AS doc_a, b AS doc_b FROM pairs JOIN w x ON x.doc_id = a JOIN w y ON y.doc_id = b
WHERE (x.s = 'train' AND y.s IN (FROM held)) OR (y.s = 'train' AND x.s IN (FROM held))""",
    "p3_found": f"""WITH RECURSIVE {_PAIRS},
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT a AS x, a AS y FROM links UNION SELECT x, b FROM reach JOIN links ON a = y)
SELECT min(y) AS group_id, x AS doc_id FROM reach GROUP BY x""",
    "p4_found": rf"""WITH {_PLAIN},
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM heldout_items
    WHERE lower(trim(split, E' \t\r\n')) IN (SELECT lower(trim(split, E' \t\r\n')) FROM heldout_config)),
iw AS (SELECT item_id, least(12, len(ws)) AS k, unnest(list_transform(range(1, len(ws) - least(12, len(ws)) + 2), lambda p: array_to_string(ws[p:p + least(12, len(ws)) - 1], ' '))) AS g FROM i WHERE len(ws) > 0),
dw AS (SELECT doc_id, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda p: array_to_string(ws[p:p + k - 1], ' '))) AS g FROM w, (SELECT DISTINCT k FROM iw) WHERE s = 'train' AND len(ws) >= k)
SELECT DISTINCT item_id, doc_id FROM iw JOIN dw USING (k, g)""",
    "p5_found": r"""WITH
p AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, unnest(range(0, len(ws) - 39)) AS pos, unnest(list_transform(range(1, len(ws) - 38), lambda i: md5(array_to_string(ws[i:i + 39], ' ')))) AS g FROM p WHERE len(ws) >= 40),
shared AS (SELECT doc_id, pos FROM r JOIN (SELECT g FROM r GROUP BY g HAVING count(DISTINCT doc_id) > 1) USING (g)),
marked AS (SELECT doc_id, pos, CASE WHEN pos - lag(pos) OVER o <= 40 THEN 0 ELSE 1 END AS new FROM shared WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
islands AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM marked)
SELECT doc_id, min(pos)::BIGINT AS first_word, (max(pos) - min(pos) + 40)::BIGINT AS n_words FROM islands GROUP BY doc_id, k""",
}
SQL["p4_clean_sources"] = SQL["p4_found"].replace("SELECT DISTINCT item_id, doc_id FROM iw JOIN dw USING (k, g)", r"""
SELECT source, count(*) AS kept FROM documents WHERE lower(trim(split, E' \t\r\n')) = 'train' AND doc_id NOT IN (SELECT doc_id FROM iw JOIN dw USING (k, g)) GROUP BY source""")
SQL["p5_share"] = f"""WITH found AS ({SQL['p5_found']}),
sizes AS (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> ''))::BIGINT AS n FROM documents),
sums AS (SELECT doc_id, sum(n_words)::BIGINT AS c FROM found GROUP BY doc_id)
SELECT doc_id, n AS n_pieces, coalesce(c, 0) AS shared_pieces, CASE WHEN n > 0 THEN coalesce(c, 0) / n ELSE 0 END AS share FROM sizes LEFT JOIN sums USING (doc_id)"""
SQL["p2_report"] = f"""WITH found AS ({SQL['p2_found']}),
sides AS (SELECT doc_a AS d, doc_b AS o FROM found UNION ALL SELECT doc_b, doc_a FROM found),
plain AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents WHERE doc_id IN (SELECT d FROM sides)),
eights AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) - 6)) AS p, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS g FROM plain),
cover AS (SELECT d, o, count(DISTINCT x.p + k) / any_value(x.n) AS cover FROM sides JOIN eights x ON x.doc_id = d SEMI JOIN eights y ON y.doc_id = o AND y.g = x.g, range(8) r(k) GROUP BY d, o),
docs AS (SELECT d, count(*) AS pairs, max(coalesce(cover, 0)) AS cover FROM sides LEFT JOIN cover USING (d, o) GROUP BY d)
SELECT lower(trim(split, E' \\t\\r\\n')) AS split, lower(source) AS source, count(*) AS documents, sum(pairs)::BIGINT AS pairs, round(avg(cover), 6) AS mean_cover
FROM documents JOIN docs ON d = doc_id GROUP BY 1, 2"""
SQL["p4_spans"] = SQL["p4_found"].replace("unnest(list_transform(range(1, len(ws) - least", "unnest(range(0, len(ws) - least(12, len(ws)) + 1)) AS p, unnest(list_transform(range(1, len(ws) - least").replace("SELECT doc_id, k, unnest(", "SELECT doc_id, k, unnest(range(0, len(ws) - k + 1)) AS q, unnest(").replace("SELECT DISTINCT item_id, doc_id FROM iw JOIN dw USING (k, g)", """,
met AS (SELECT item_id, doc_id, k, p, q FROM iw JOIN dw USING (k, g)),
parts AS (SELECT *, p - row_number() OVER (PARTITION BY item_id, doc_id, q - p ORDER BY p) AS part FROM met)
SELECT item_id, doc_id, min(p)::BIGINT AS item_word, min(q)::BIGINT AS doc_word, (count(*) - 1 + any_value(k))::BIGINT AS n_words FROM parts GROUP BY item_id, doc_id, q - p, part""")
