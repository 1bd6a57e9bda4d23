"""DuckDB SQL for the operators that SQL can express."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACE = r"regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM.format("coalesce(text, '')")} AS w FROM benchmark),
bs AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM bs, unnest(generate_series(1, len(w) - k + 1)) AS g(i)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT r, ks.k, i, array_to_string(w[i:i + ks.k - 1], ' ') AS win FROM d, ks, unnest(generate_series(1, len(w) - ks.k + 1)) AS g(i)),
hit AS (SELECT r, dw.k, i, item_id FROM dw JOIN win ON dw.win = win.win AND dw.k = win.k),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + k - 1)) AS j FROM (SELECT DISTINCT r, k, i FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (d)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACE.format("coalesce(text, '')")} AS w FROM documents),
n AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d),
u AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM n GROUP BY s),
e AS (SELECT rep, n, unnest(s) AS g FROM u),
p AS (SELECT a.rep AS x, b.rep AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep
      WHERE a.n * 4 >= b.n * 3 AND b.n * 4 >= a.n * 3 GROUP BY ALL),
l AS (SELECT x, y FROM p WHERE 100 * c >= 75 * (nx + ny - c)),
both_ways AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(x, y) AS (SELECT rep, rep FROM u WHERE n > 0 UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
c AS (SELECT x, min(y) AS component FROM reach GROUP BY x)
SELECT n.doc_id, CAST(len(n.s) AS BIGINT) AS n_shingles, coalesce(c.component, n.doc_id) AS component_id
FROM n LEFT JOIN u ON n.s = u.s AND u.n > 0 LEFT JOIN c ON u.rep = c.x
"""

RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM.format("coalesce(text, '')")} AS w FROM documents),
e AS (SELECT r, unnest(w) AS term FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM e GROUP BY ALL),
dn AS (SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0),
t AS (SELECT count(*) AS big_n, sum(n) AS big_l FROM dn),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
it AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest({_ALNUM.format("coalesce(text, '')")}) AS term FROM i) GROUP BY ALL),
w AS (SELECT item_id, term, q, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM it JOIN df USING (term), t),
m AS (SELECT r, doc_id, CAST(25 + (75 * n * big_n) // big_l AS BIGINT) AS m FROM dn, t),
s AS (SELECT item_id, r, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM w JOIN tf USING (term) JOIN m USING (r) GROUP BY item_id, r),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s JOIN m USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""
