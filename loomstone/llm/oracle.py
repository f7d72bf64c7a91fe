"""DuckDB SQL for the operators that SQL can express, written over exploded strings, without hashes or prefixes."""

from __future__ import annotations

from .decontamination import CLOSE, NEAR, REACH, SHARE, SPAN

OP1 = r"""WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT id, min(c) AS least_id FROM reach GROUP BY 1) ON id = d.doc_id"""


#: Every alignment of a document and an item that has two equal tokens side by side (or one, for items below five) is
#: tested at every window; a stretch that passes always has such a pair, so this knows nothing of masks.
OP2 = f"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM benchmark WHERE item_id IS NOT NULL),
dw AS (SELECT doc_id, t, unnest(generate_series(1, len(t))) AS i FROM d),
bw AS (SELECT item_id, t, unnest(generate_series(1, len(t))) AS i FROM b),
dg AS (SELECT doc_id, i, t[i] || ' ' || t[i + 1] AS g FROM dw WHERE i < len(t)),
bg AS (SELECT item_id, i, t[i] || ' ' || t[i + 1] AS g FROM bw WHERE i < len(t) AND len(t) >= 5),
lone AS (SELECT item_id, i, t[i] AS g FROM bw WHERE len(t) < 5),
laid AS (SELECT DISTINCT doc_id, item_id, dg.i - bg.i AS shift FROM dg JOIN bg USING (g) UNION SELECT DISTINCT doc_id, item_id, dw.i - lone.i FROM dw JOIN lone ON dw.t[dw.i] = lone.g),
same AS (SELECT doc_id, item_id, least({SPAN}, len(b.t)) AS k, list_transform(generate_series(greatest(1, 1 - shift), least(len(b.t), len(d.t) - shift)), lambda p: CASE WHEN b.t[p] = d.t[p + shift] THEN 1 ELSE 0 END) AS e
    FROM laid JOIN d USING (doc_id) JOIN b USING (item_id)),
good AS (SELECT DISTINCT doc_id, item_id FROM same WHERE list_sum(e) >= {SHARE} * k AND len(list_filter(generate_series(1, len(e) - k + 1), lambda r:
    list_sum(e[greatest(1, r - {REACH}):least(len(e), r + k - 1 + {REACH})]) >= {SHARE} * (least(len(e), r + k - 1 + {REACH}) - greatest(1, r - {REACH}) + 1)
    OR list_sum(e[greatest(1, r - {NEAR}):least(len(e), r + k - 1 + {NEAR})]) >= {CLOSE} * (least(len(e), r + k - 1 + {NEAR}) - greatest(1, r - {NEAR}) + 1))) > 0)
SELECT documents.doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(ids, '') AS item_ids
FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS ids FROM good GROUP BY 1) g ON g.doc_id = documents.doc_id"""

#: Windows of 100 bytes as 200 hex digits; touching windows join to runs, what lies between is kept.
OP10 = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS m FROM (SELECT doc_id, x, unnest(generate_series(0, len(x) // 2 - 100)) AS p FROM h WHERE len(x) >= 200)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY m ORDER BY doc_id, p) AS place FROM w) WHERE place > 1),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM again),
runs AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked) GROUP BY doc_id, k),
gone AS (SELECT doc_id, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1),
gaps AS (SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS a, s AS b FROM runs UNION ALL SELECT doc_id, max(e), NULL FROM runs GROUP BY 1),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(b, len(x) // 2) - a)), '' ORDER BY a) AS kx FROM gaps JOIN h USING (doc_id) GROUP BY 1)
SELECT h.doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kx, x))) AS kept_sha256
FROM h LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLE_SQL = {"op1_ngram_jaccard": OP1, "op2_decontamination": OP2, "op10_suffix_dedup": OP10}
