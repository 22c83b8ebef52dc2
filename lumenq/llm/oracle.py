"""DuckDB SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations

from .line_dedup import LOWER, UPPER
from .line_dedup import SQL as LINE_DEDUP

_WORDS = r"'[^\x20\x09-\x0D]+'"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
win AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 12], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM d WHERE len(ws) >= 13)),
earliest AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM win JOIN earliest USING (h) WHERE f < doc_id),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d),
kept AS (SELECT word.doc_id, count(g.p) AS n_removed, string_agg(w, ' ' ORDER BY word.p) FILTER (WHERE g.p IS NULL) AS t FROM word LEFT JOIN gone g ON g.doc_id = word.doc_id AND g.p = word.p GROUP BY word.doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), {_WORDS}) AS ws FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS p FROM d WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.b, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, p, md5(b[p:p + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS p FROM d WHERE octet_length(b) >= 400)),
hit AS (SELECT doc_id, p, true AS starts FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
byte AS (SELECT doc_id, unnest(range(1, len(cs) + 1)) AS p, unnest(cs) AS c FROM (SELECT doc_id, regexp_extract_all(x, '..') AS cs FROM d)),
marked AS (
  SELECT doc_id, p, c, coalesce(max(CASE WHEN starts THEN p END) OVER (PARTITION BY doc_id ORDER BY p) > p - 400, false) AS gone FROM byte LEFT JOIN hit USING (doc_id, p)
), edged AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS edge FROM marked),
summed AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE edge) AS n_spans, string_agg(c, '' ORDER BY p) FILTER (WHERE NOT gone) AS t FROM edged GROUP BY doc_id)
SELECT d.doc_id, strlen(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256 FROM d LEFT JOIN summed USING (doc_id)
"""

ORACLE = {
    "op2_near_dedup": NEAR_DEDUP,
    "op3_substring_dedup": SUBSTRING_DEDUP,
    "op5_suffix_dedup": SUFFIX_DEDUP,
    "op7_line_dedup": LINE_DEDUP,
}
