"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_REACH = """reach AS (SELECT id AS x, id AS y FROM ids UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x),
 comp AS (SELECT x AS id, min(y) AS component_id FROM reach GROUP BY x)"""

ORACLE_SQL = {
    "op1_minhash": rf"""WITH RECURSIVE w AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) = 1 THEN [ws[1]]
  ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS s FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
 near AS (SELECT p.x, p.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.x JOIN n nb ON nb.doc_id = p.y WHERE 100 * c >= 80 * (na.n + nb.n - c)),
 edge AS (SELECT x, y FROM near UNION SELECT y, x FROM near), ids AS (SELECT DISTINCT doc_id AS id FROM documents), {_REACH}
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN comp ON comp.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op9_vector_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
 edge AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
 ids AS (SELECT vec_id AS id FROM embeddings), {_REACH}
 SELECT id AS vec_id, (SELECT count(*) FROM edge WHERE x = id) AS n_links, component_id, id = component_id AS kept FROM comp""",
}
