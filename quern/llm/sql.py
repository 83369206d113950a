"""SQL of the operators whose results it can state."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(""" + LOWER.format("text") + r""", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n) FILTER (WHERE k.term IS NOT NULL), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source
 LEFT JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.n + 2 * v.v) AS p,
 1 + (1000000000::HUGEINT * (k.total + 2)) // (v.n + 2 * v.v) AS q
 FROM s JOIN k ON k.lang = s.lang JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
 UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM found) WHERE part = 'pair' OR rank <= 10"""

COLLOCATIONS = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, """ + LOWER.format("coalesce(text, '')") + r""" AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM w) WHERE len(w) >= k),
f AS (SELECT lang, list_slice(w, i, i + k - 1) AS x, k, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY ALL),
c AS (SELECT * FROM f WHERE k > 1 AND f >= 30),
u AS (SELECT lang, x, f, k, unnest(range(1, k)) AS j FROM c),
s AS (SELECT u.lang, u.x, u.f AS a, j, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * u.f) // (l.f + r.f) AS BIGINT) AS score
 FROM u JOIN f l ON l.lang = u.lang AND l.x = list_slice(u.x, 1, j) JOIN f r ON r.lang = u.lang AND r.x = list_slice(u.x, j + 1, u.k)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, x ORDER BY score, j) AS o FROM s) WHERE o = 1),
i AS (SELECT lang, list_slice(x, y, y + m - 1) AS x, max(f) AS most FROM (SELECT lang, x, f, m, unnest(range(1, k - m + 2)) AS y
 FROM (SELECT lang, x, f, k, unnest(range(2, k)) AS m FROM c WHERE k > 2)) GROUP BY ALL),
z AS (SELECT b.lang, array_to_string(b.x, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.x = b.x WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT * FROM (SELECT z.lang, CAST(row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, phrase) AS INT) AS rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang) WHERE rank <= 2000"""
