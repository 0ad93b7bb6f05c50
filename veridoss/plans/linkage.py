"""SQL twins of linkage: the closest pair of each entity's clusters merges, step by step, in a recursive query."""

from __future__ import annotations


def linkage_sql(rows: str, kind: str, threshold: float, name: str = "'%s:cluster_%05d', e") -> str:
    """SELECT e, i, low, cluster_id of rows (e, i, d, v): e and i text, rows of an entity in order of d and i.

    r holds the pairs of clusters that are left, by their first rows, with the greatest distance (complete) or the sum
    and number of distances (average); a pair without distance records a merge, by which rows find their cluster.
    """
    points = f"p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY e ORDER BY d, i) AS k FROM ({rows}))"
    pairs = "SELECT x.e, x.k AS a, y.k AS b, 1 - list_cosine_similarity(x.v, y.v) AS s, 1::DOUBLE AS n FROM p x JOIN p y ON x.e = y.e AND x.k < y.k"
    if kind == "single":
        steps = f"""t AS MATERIALIZED (SELECT e, a, b FROM ({pairs}) WHERE 1 - s >= {threshold}), u AS MATERIALIZED (FROM t UNION ALL SELECT e, b, a FROM t),
c AS (SELECT e, k, k AS root FROM p UNION SELECT u.e, u.b, c.root FROM c JOIN u ON u.e = c.e AND u.a = c.k WHERE c.root < u.b)"""
    else:
        far, gather = ("s", "max") if kind == "complete" else ("s / n", "sum")
        steps = f"""r AS ({pairs} UNION ALL SELECT e, least(a2, b2), greatest(a2, b2), {gather}(s2), sum(n) FROM (
SELECT e, n, CASE WHEN a = j THEN i ELSE a END AS a2, CASE WHEN b = j AND a <> i THEN i ELSE b END AS b2, CASE WHEN a <> i OR b <> j THEN s END AS s2 FROM (
SELECT *, first_value(a) OVER w AS i, first_value(b) OVER w AS j, first_value({far}) OVER w AS low FROM r WHERE s IS NOT NULL WINDOW w AS (PARTITION BY e ORDER BY {far}, a, b))
WHERE low < 1 - {threshold}::DOUBLE) GROUP BY 1, 2, 3), t AS MATERIALIZED (SELECT e, a, b FROM r WHERE s IS NULL),
c AS (SELECT e, k, k AS root FROM p UNION ALL SELECT c.e, c.k, t.a FROM c JOIN t ON t.e = c.e AND t.b = c.root)"""
    return f"""WITH RECURSIVE {points}, {steps}, l AS MATERIALIZED (SELECT e, k, min(root) AS root FROM c GROUP BY 1, 2)
SELECT e, i, low, printf({name}, dense_rank() OVER (PARTITION BY e ORDER BY low)) AS cluster_id FROM (SELECT p.e, p.i, min(p.i) OVER (PARTITION BY p.e, l.root) AS low FROM p JOIN l USING (e, k))"""


#: The embeddings table as rows of ``linkage_sql``.
VECTORS = "SELECT CAST(label AS VARCHAR) AS e, CAST(vec_id AS VARCHAR) AS i, 0 AS d, CAST(embedding AS DOUBLE[]) AS v FROM embeddings"


def clusters_sql(kind: str, threshold: float, name: str = "'%s:cluster_%05d', e") -> str:
    """(label, vec_id, cluster_id, error) of the embeddings table."""
    return f"SELECT e AS label, i AS vec_id, cluster_id, CAST(NULL AS VARCHAR) AS error FROM ({linkage_sql(VECTORS, kind, threshold, name)})"


def sizes_sql(kind: str, threshold: float) -> str:
    return f"SELECT label, cluster_id, count(*) AS n FROM ({clusters_sql(kind, threshold)}) GROUP BY 1, 2"
