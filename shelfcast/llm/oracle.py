"""DuckDB SQL with the results of those operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP4 = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_BLANK}), []) AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest([array_to_string(w[k:k + least(len(w), 3) - 1], ' ') FOR k IN range(1, greatest(len(w) - 2, 1) + 1)]) AS g
    FROM d WHERE len(w) > 0
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
    SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

OP6 = f"""
WITH d AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, {_BLANK}), []) AS w FROM documents
), s AS (
    SELECT doc_id, k, array_to_string(w[k:k + 49], ' ') AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)
), m AS (
    SELECT h, min(doc_id) AS lo FROM s GROUP BY h
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM s JOIN m USING (h) WHERE doc_id > lo
), words AS (
    SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
    SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP8 = f"""
WITH d AS (
    SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, {_ALNUM}), []) AS w FROM documents
), i AS (
    SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark WHERE text IS NOT NULL
), win AS (
    SELECT DISTINCT item_id, unnest([w[k:k + least(len(w), 10) - 1] FOR k IN range(1, greatest(len(w) - 9, 1) + 1)]) AS g FROM i WHERE len(w) > 0
), lens AS (
    SELECT DISTINCT len(g) AS n FROM win
), dw AS (
    SELECT doc_id, n, k, w[k:k + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n)
), hit AS (
    SELECT doc_id, k, n, item_id FROM dw JOIN win USING (g)
), cov AS (
    SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id
), its AS (
    SELECT doc_id, count(*) AS c, sha256(string_agg(x, ',' ORDER BY x)) AS h
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(cov.c, 0) AS n_hit, coalesce(its.c, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, cov.c IS NOT NULL AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


OP3 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS t FROM pages
), h AS (
    SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS hex FROM p
), f AS (
    SELECT hex, min(page_id) AS lo FROM h GROUP BY hex
), digits AS (
    SELECT page_id, payload_bytes, hex, lo, [CAST('0x' || hex[5 * i + 1:5 * i + 5] AS BIGINT) FOR i IN range(0, 8)] AS groups
    FROM h JOIN f USING (hex)
)
SELECT page_id, payload_bytes,
       array_to_string(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((g >> s) & 31 AS INTEGER) + 1, 1) FOR s IN [15, 10, 5, 0]] FOR g IN groups]), '') AS payload_digest,
       CASE WHEN page_id = lo THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> lo THEN lo END AS refers_to
FROM digits
"""

OP9 = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
    SELECT vec_id, label, e, sqrt(list_sum([x * x FOR x IN e])) AS norm FROM v
    WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), edge AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM v
    UNION
    SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b
), c AS (
    SELECT a, min(b) AS component_id FROM reach GROUP BY a
), n AS (
    SELECT a, count(*) AS n FROM edge GROUP BY a
)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP11 = f"""
WITH d AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_BLANK})), 0) AS size, md5(concat_ws(':', 'mix-1', CAST(doc_id AS VARCHAR), text)) AS k
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source
), w AS (
    SELECT source, n, r, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][r % 3 + 1] AS w, 2.0::DOUBLE * n AS cap FROM s
), f AS (
    SELECT *, sum(n) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open
    FROM w WINDOW before AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (
    SELECT rest, open FROM f WHERE w * rest < cap * open ORDER BY cap / w, r LIMIT 1
), t AS (
    SELECT f.source, n, CASE WHEN w * f.rest >= cap * f.open THEN cap ELSE w * o.rest / o.open END AS target FROM f LEFT JOIN o ON true
), c AS (
    SELECT *, CASE WHEN n > 0 THEN CAST(floor(floor(target + 0.5) / n) AS BIGINT) ELSE 0 END AS rounds FROM t
), p AS (
    SELECT doc_id, size, n, target, rounds, CAST(floor(target + 0.5) AS BIGINT) - rounds * n AS rest,
           coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target,
       CAST(rounds * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_dictionary": OP3, "op9_flat_graph": OP9, "op4_jaccard_join": OP4, "op6_substring_dedup": OP6, "op8_decontamination": OP8, "op11_source_mix": OP11}
