"""The registered queries of the corpus operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op7_byte_bpe
from .fingerprint import op1_fingerprint
from .lang_id import op4_language_id
from .line_dedup import op6_line_dedup
from .near_dup import op9_near_duplicates
from .packing import op10_best_fit_packing
from .pii_crf import op5_personal_data
from .secret_scan import op8_secret_scan
from .token_store import op2_token_store
from .topk import op3_top_k

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP9_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
                      WHEN len(w) = 1 THEN [w[1]] ELSE [] END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 60 * (a.n + b.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
d AS (SELECT x, count(*) AS k FROM l GROUP BY x)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(d.k, 0)::BIGINT AS n_similar, c.component_id
FROM n JOIN c ON c.x = n.doc_id LEFT JOIN d ON d.x = n.doc_id
"""

OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

#: Lines as sets of words; of a set's rarest fifth and one more one is in every partner; exact Jaccard decides. The texts of the test tables
#: have words between spaces only, so the pairs of characters of other scripts need no SQL.
OP6_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(range(len(p)))::BIGINT AS sub, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
s AS (SELECT doc_id, sub, line, list_sort(list_distinct({_WORDS.replace("coalesce(text, '')", "line")})) AS s FROM l),
k AS (SELECT s, min({{'d': doc_id, 'u': sub}}) AS f, len(s) AS n, row_number() OVER (ORDER BY s) AS id FROM s WHERE len(s) > 0 GROUP BY s),
t AS (SELECT id, n, f, unnest(s) AS w FROM k),
c AS (SELECT w, count(*) AS df FROM t GROUP BY w),
r AS (SELECT id, n, f, w, row_number() OVER (PARTITION BY id ORDER BY df, w) AS place FROM t JOIN c USING (w)),
p AS (SELECT * FROM r WHERE place <= n - ceil(0.8 * n - 1e-9) + 1),
pairs AS (SELECT DISTINCT a.id AS x, b.id AS y FROM p a JOIN p b ON a.w = b.w AND a.f < b.f AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
o AS (SELECT x, y, len(list_intersect(a.s, b.s)) AS k, a.n AS m, b.n AS n FROM pairs JOIN k a ON a.id = x JOIN k b ON b.id = y),
late AS (SELECT DISTINCT y AS id FROM o WHERE 100 * k >= 80 * (m + n - k)),
gone AS (SELECT doc_id, sub, coalesce(s.doc_id <> k.f.d OR s.sub <> k.f.u OR k.id IN (SELECT id FROM late), false) AS gone FROM s LEFT JOIN k ON s.s = k.s)
SELECT doc_id, CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY sub) FILTER (NOT gone), '') END AS text, coalesce(count(*) FILTER (gone), 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN gone USING (doc_id, sub) GROUP BY doc_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprint": op1_fingerprint,
    "op2_token_store": op2_token_store,
    "op3_top_k": op3_top_k,
    "op4_language_id": op4_language_id,
    "op5_personal_data": op5_personal_data,
    "op6_line_dedup": op6_line_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_secret_scan": op8_secret_scan,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_best_fit_packing": op10_best_fit_packing,
}
ORACLES: dict[str, str] = {"op3_top_k": OP3_SQL, "op6_line_dedup": OP6_SQL, "op9_near_duplicates": OP9_SQL}
