"""Brute-force SQL for each registered query, runnable by DuckDB on the same
parquet tables (views ``embeddings``, ``part``, ...).

Distances are summed element by element in index order, after casting
``float`` to ``double``, the same order the Spark expressions use, so the
values agree bit for bit before rounding. Ties are broken by id everywhere.
"""

from __future__ import annotations

K = 5
K_SELF = 10
THRESHOLD = 3

E = "e AS (SELECT vec_id AS id, label::DOUBLE AS label, embedding::DOUBLE[] AS v FROM embeddings)"


def _d2(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a})+1), lambda i: ({a}[i]-{b}[i])*({a}[i]-{b}[i])))"


def _topk(where: str, k: int, src_q: str = "e", src_t: str = "e") -> str:
    return f"""j AS (SELECT q.id AS q_id, t.id AS t_id, t.label AS label, {_d2('q.v', 't.v')} AS d2
           FROM {src_q} q, {src_t} t WHERE {where}),
     nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, t_id) AS rank FROM j)
            WHERE rank <= {k})"""


SPLIT_NN = _topk("q.id % 5 = 0 AND t.id % 5 <> 0", K)
SPLIT_NN_ALL_TRAIN = _topk("q.id % 5 = 0", K)
SELF_NN = _topk("q.id <> t.id", K_SELF)


def _label_cells(src: str) -> str:
    """Mean vector per label over ``src``, rounded to 6, and each row's nearest centre."""
    return f"""xs AS (SELECT label, unnest(range(1, len(v)+1)) AS i, unnest(v) AS x FROM {src}),
     cen AS (SELECT label::INT AS cell, list(c ORDER BY i) AS center
             FROM (SELECT label, i, round(avg(x), 6) AS c FROM xs GROUP BY label, i) GROUP BY label),
     asg AS (SELECT * FROM (SELECT p.id, p.label, p.v, c.cell, sqrt({_d2('p.v', 'c.center')}) AS dist,
                                   row_number() OVER (PARTITION BY p.id ORDER BY {_d2('p.v', 'c.center')}, c.cell) AS r
                            FROM {src} p, cen c) WHERE r = 1),
     cst AS (SELECT cell, count(*) AS n, max(dist) AS radius FROM asg GROUP BY cell)"""


QRY = "qr AS (SELECT * FROM e WHERE id % 5 = 0)"

VOTES = "votes AS (SELECT q_id, label, count(*) AS votes FROM nn GROUP BY q_id, label)"

SQL: dict[str, str] = {
    "labeled_points": """SELECT vec_id AS id, label::DOUBLE AS label, len(embedding)::BIGINT AS dim,
        list_min(embedding::DOUBLE[]) AS f_min, list_max(embedding::DOUBLE[]) AS f_max,
        round(list_sum(list_transform(range(1, len(embedding)+1), lambda i: embedding[i]::DOUBLE * i)), 6) AS f_placed FROM embeddings""",
    "vector_norm": f"""WITH {E} SELECT id, round(sqrt(list_sum(list_transform(v, lambda x: x*x))), 6) AS norm FROM e""",
    "pairwise_sqdist": f"""WITH {E}, {_label_cells('e')}
        SELECT e.id, c.cell, round({_d2('e.v', 'c.center')}, 6) AS d2 FROM e JOIN cen c ON e.label::INT = c.cell""",
    "pairwise_distance": f"""WITH {E}, {_label_cells('e')}
        SELECT e.id, c.cell, round(sqrt({_d2('e.v', 'c.center')}), 6) AS dist FROM e JOIN cen c ON e.label::INT = c.cell""",
    "libsvm_scan": """SELECT label::DOUBLE AS label, len(embedding)::BIGINT AS dim,
        list_min(embedding::DOUBLE[]) AS f_min, list_max(embedding::DOUBLE[]) AS f_max,
        round(list_sum(list_transform(range(1, len(embedding)+1), lambda i: embedding[i]::DOUBLE * i)), 6) AS f_placed FROM embeddings""",
    "knn_join": f"""WITH {E}, {SPLIT_NN_ALL_TRAIN} SELECT q_id, t_id, label, round(d2, 6) AS d2, rank FROM nn""",
    "knn_join_pruned": f"""WITH {E}, {SPLIT_NN_ALL_TRAIN} SELECT q_id, t_id, label, round(d2, 6) AS d2, rank FROM nn""",
    "knn_join_single_cell": f"""WITH {E}, {QRY}, {_label_cells('e')},
        best AS (SELECT * FROM (SELECT q.id AS q_id, c.cell,
                       row_number() OVER (PARTITION BY q.id ORDER BY sqrt({_d2('q.v', 'cen.center')}) + c.radius, c.cell) AS r
                 FROM qr q, cst c JOIN cen ON cen.cell = c.cell) WHERE r = 1),
        j AS (SELECT b.q_id, a.id AS t_id, a.label, {_d2('q.v', 'a.v')} AS d2
              FROM best b JOIN qr q ON q.id = b.q_id JOIN asg a ON a.cell = b.cell),
        nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, t_id) AS rank FROM j)
               WHERE rank <= {K})
        SELECT q_id, t_id, label, round(d2, 6) AS d2, rank FROM nn""",
    "knn_self_join": f"""WITH {E}, {SELF_NN} SELECT q_id, t_id, round(d2, 6) AS d2, rank FROM nn""",
    "nearest_cell": f"""WITH {E}, {_label_cells('e')} SELECT id, cell, round(dist, 6) AS dist FROM asg""",
    "cell_stats": f"""WITH {E}, {_label_cells('e')} SELECT cell, n, round(radius, 6) AS radius FROM cst""",
    "candidate_cells": f"""WITH {E}, {QRY}, {_label_cells('e')},
        rho AS (SELECT cell, dist AS rho FROM (SELECT cell, dist,
                  row_number() OVER (PARTITION BY cell ORDER BY dist, id) AS r FROM asg) WHERE r = {K}),
        b AS (SELECT q.id AS q_id, c.cell, sqrt({_d2('q.v', 'cen.center')}) AS dc, c.radius, c.n, rho.rho
              FROM qr q, cst c JOIN cen ON cen.cell = c.cell LEFT JOIN rho ON rho.cell = c.cell),
        b2 AS (SELECT *, dc + radius AS ub, dc - radius AS lb,
                      sum(n) OVER (PARTITION BY q_id ORDER BY dc + radius, cell ROWS UNBOUNDED PRECEDING) AS cum FROM b),
        ua AS (SELECT q_id, min(ub) AS ua FROM b2 WHERE cum >= {K} GROUP BY q_id),
        ub AS (SELECT q_id, min(dc + rho) AS ub FROM b2 WHERE rho IS NOT NULL GROUP BY q_id),
        u AS (SELECT b.q_id, CASE WHEN ua.ua IS NULL THEN ub.ub WHEN ub.ub IS NULL THEN ua.ua
                                  ELSE least(ua.ua, ub.ub) END AS u
              FROM (SELECT DISTINCT q_id FROM b2) b LEFT JOIN ua ON ua.q_id = b.q_id LEFT JOIN ub ON ub.q_id = b.q_id)
        SELECT b2.q_id, b2.cell FROM b2 JOIN u ON b2.q_id = u.q_id
        WHERE u.u IS NULL OR b2.lb <= u.u + 1e-9 * (1 + u.u)""",
    "cell_count": """SELECT count(*) AS n, greatest(2, least(50, floor(sqrt(count(*) // 2))))::INT AS cells FROM embeddings""",
    "kmeans_cells": """SELECT count(*) AS points, greatest(2, least(50, floor(sqrt(count(*) // 2))))::BIGINT AS cells,
        count(*) AS members, 0::BIGINT AS misplaced, 0::BIGINT AS outside FROM embeddings""",
    "class_count_metadata": "SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS num_classes FROM customer",
    "class_count": """SELECT (max(label::DOUBLE)::INT + 1)::BIGINT AS num_classes FROM embeddings""",
    "vote_counts": f"""WITH {E}, {SPLIT_NN}, {VOTES} SELECT q_id, label, votes FROM votes""",
    "vote_share": f"""WITH {E}, {SPLIT_NN}, {VOTES}
        SELECT q_id, label, votes, round(votes / sum(votes) OVER (PARTITION BY q_id), 6) AS share FROM votes""",
    "knn_classify": f"""WITH {E}, {SPLIT_NN}, {VOTES},
        best AS (SELECT q_id, label AS prediction FROM
                 (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY votes DESC, label) AS x FROM votes) WHERE x = 1)
        SELECT e.id, e.label, best.prediction FROM e LEFT JOIN best ON e.id = best.q_id WHERE e.id % 5 = 0""",
    "knn_regress": f"""WITH {E}, {SPLIT_NN}
        SELECT e.id, round(p.prediction, 6) AS prediction FROM e LEFT JOIN
        (SELECT q_id, coalesce(avg(label) FILTER (WHERE d2 = 0),
                sum(label / nullif(d2, 0)) / sum(1 / nullif(d2, 0))) AS prediction FROM nn GROUP BY q_id) p
        ON e.id = p.q_id WHERE e.id % 5 = 0""",
    "knn_regress_exact_match": f"""WITH {E}, {SPLIT_NN_ALL_TRAIN}
        SELECT e.id, round(p.prediction, 6) AS prediction FROM e LEFT JOIN
        (SELECT q_id, coalesce(avg(label) FILTER (WHERE d2 = 0),
                sum(label / nullif(d2, 0)) / sum(1 / nullif(d2, 0))) AS prediction FROM nn GROUP BY q_id) p
        ON e.id = p.q_id WHERE e.id % 5 = 0""",
    "knn_regress_exact_sum": f"""WITH {E}, {SPLIT_NN_ALL_TRAIN}
        SELECT e.id, round(p.prediction, 6) AS prediction FROM e LEFT JOIN
        (SELECT q_id, coalesce(sum(label) FILTER (WHERE d2 = 0),
                sum(label / nullif(d2, 0)) / sum(1 / nullif(d2, 0))) AS prediction FROM nn GROUP BY q_id) p
        ON e.id = p.q_id WHERE e.id % 5 = 0""",
}

_DEG = f"""WITH {E}, {SELF_NN},
    deg AS (SELECT e.id, coalesce(c.n, 0)::BIGINT AS indegree FROM e
            LEFT JOIN (SELECT t_id, count(*) AS n FROM nn GROUP BY t_id) c ON e.id = c.t_id)"""

SQL.update({
    "knn_indegree": f"{_DEG} SELECT id, indegree FROM deg",
    "indegree_summary": f"{_DEG} SELECT sum(indegree)::BIGINT AS total, count(*) AS points, round(avg(indegree), 6) AS mean FROM deg",
    "knn_outliers": f"{_DEG} SELECT id, indegree FROM deg WHERE indegree <= {THRESHOLD}",
    "outlier_flags": f"{_DEG} SELECT id, indegree, CASE WHEN indegree <= {THRESHOLD} THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction FROM deg",
})

_VAL = f"""WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS a, length(p_type)::DOUBLE AS b FROM part),
    j AS (SELECT q.id AS q_id, t.id AS t_id, t.a, t.b, (q.a-t.a)*(q.a-t.a) + (q.b-t.b)*(q.b-t.b) AS d2
          FROM p q, p t WHERE q.id <> t.id),
    nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, t_id) AS r FROM j)
           WHERE r <= {K_SELF}),
    c AS (SELECT a, b, count(DISTINCT q_id) AS n FROM nn GROUP BY a, b),
    deg AS (SELECT v.a AS f0, v.b AS f1, coalesce(c.n, 0)::BIGINT AS indegree
            FROM (SELECT DISTINCT a, b FROM p) v LEFT JOIN c ON v.a = c.a AND v.b = c.b)"""

SQL.update({
    "knn_indegree_by_value": f"{_VAL} SELECT f0, f1, indegree FROM deg",
    "knn_outliers_by_value": f"{_VAL} SELECT f0, f1, indegree FROM deg WHERE indegree <= {THRESHOLD}",
})

_OFFSET = f"""WITH e AS (SELECT p_partkey AS id, 0::DOUBLE AS label, [p_size::DOUBLE, p_retailprice::DOUBLE + 1e9::DOUBLE] AS v FROM part), {SPLIT_NN_ALL_TRAIN}"""

# The estimators answer the questions of the functions that they stand on.
SQL.update({
    "knn_join_offset": f"{_OFFSET} SELECT q_id, t_id, round(d2, 3) AS d2, rank FROM nn",
    "knn_classifier_model": SQL["knn_classify"],
    "knn_regressor_model": SQL["knn_regress"],
    "outlier_model_detect": SQL["knn_outliers"],
    "outlier_model_transform": SQL["outlier_flags"],
})

_TERMS = r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM documents),
    c AS (SELECT doc_id, word, count(*)::DOUBLE AS n FROM w GROUP BY ALL),
    m AS (SELECT d.doc_id, coalesce(sum(n * n), 0) AS n2, count(word) AS stored FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id WHERE d.doc_id IS NOT NULL GROUP BY d.doc_id)"""

SQL.update({
    "sparse_vector_norm": f"{_TERMS} SELECT doc_id, stored, round(sqrt(n2), 6) AS norm FROM m",
    "sparse_sqdist": f"""{_TERMS}, p AS (SELECT doc_id, lag(doc_id) OVER (ORDER BY doc_id) AS before FROM m),
        s AS (SELECT p.doc_id, sum(a.n * b.n) AS dot FROM p JOIN c a ON a.doc_id = p.doc_id JOIN c b ON b.doc_id = p.before AND b.word = a.word GROUP BY p.doc_id)
        SELECT p.doc_id, before, round(x.n2 + y.n2 - 2 * coalesce(dot, 0), 6) AS d2 FROM p JOIN m x ON x.doc_id = p.doc_id JOIN m y ON y.doc_id = p.before LEFT JOIN s ON s.doc_id = p.doc_id""",
    "sparse_knn_join": f"""{_TERMS}, s AS (SELECT a.doc_id AS q_id, b.doc_id AS t_id, sum(a.n * b.n) AS dot FROM c a JOIN c b ON b.word = a.word WHERE a.doc_id % 50 = 0 GROUP BY ALL),
        j AS (SELECT q.doc_id AS q_id, t.doc_id AS t_id, q.n2 + t.n2 - 2 * coalesce(dot, 0) AS d2 FROM m q JOIN m t ON q.doc_id % 50 = 0 LEFT JOIN s ON s.q_id = q.doc_id AND s.t_id = t.doc_id)
        SELECT q_id, t_id, round(d2, 6) AS d2, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY d2, t_id) AS rank FROM j) WHERE rank <= 10""",
})

_LINEITEM = f"""WITH e AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS id, 0::DOUBLE AS label, [l_quantity::DOUBLE, l_extendedprice / 1000, l_discount * 100, l_tax * 100]::DOUBLE[] AS v FROM lineitem)"""

SQL.update({
    "fast_sqdist": SQL["pairwise_sqdist"],
    "knn_join_blocks": SQL["knn_join"],
    "tree_knn_join": f"""{_LINEITEM}, j AS (SELECT q.id AS q_id, t.id AS t_id, (q.v[1]-t.v[1])*(q.v[1]-t.v[1]) + (q.v[2]-t.v[2])*(q.v[2]-t.v[2]) + (q.v[3]-t.v[3])*(q.v[3]-t.v[3]) + (q.v[4]-t.v[4])*(q.v[4]-t.v[4]) AS d2
        FROM e q, e t WHERE q.id % 50 = 0), b AS (SELECT q_id, unnest(arg_min({{'d2': d2, 't_id': t_id}}, {{'d2': d2, 't_id': t_id}}, {K})) AS x FROM j GROUP BY q_id)
        SELECT q_id, x.t_id AS t_id, round(x.d2, 6) AS d2, row_number() OVER (PARTITION BY q_id ORDER BY x.d2, x.t_id) AS rank FROM b""",
    "tree_cells": "SELECT count(*) AS points, count(*) AS members, 0::BIGINT AS misplaced, true AS cells_grow FROM lineitem",
    "part_self_join": f"""WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS a, length(p_type)::DOUBLE AS b FROM part),
        j AS (SELECT q.id AS q_id, t.id AS t_id, (q.a-t.a)*(q.a-t.a) + (q.b-t.b)*(q.b-t.b) AS d2 FROM p q, p t WHERE q.id <> t.id)
        SELECT * FROM (SELECT q_id, t_id, round(d2, 6) AS d2, row_number() OVER (PARTITION BY q_id ORDER BY d2, t_id) AS rank FROM j) WHERE rank <= {K}""",
})
SQL["part_self_join_append"] = SQL["part_self_join"]
SQL["knn_indegree_append"] = SQL["knn_indegree"]
