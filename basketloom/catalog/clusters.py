"""Clustering and cluster metrics on vectors with labels and on baskets of items."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketloom.catalog import bindings as b
from basketloom.catalog.registry import register
from basketloom.operators import kmeans, medoids, metrics, synthetic
from basketloom.runtime import Scratch

_DIGITS = 6

# (row, dim, x) of the embeddings, their labels, centroids and sizes
_VECTORS = """cells AS (SELECT vec_id AS row_id, label, generate_subscripts(embedding, 1) - 1 AS dim,
        unnest(embedding)::DOUBLE AS x FROM embeddings),
    sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
    centres AS (SELECT label, dim, avg(x) AS c FROM cells GROUP BY label, dim),
    mean AS (SELECT dim, avg(x) AS m FROM cells GROUP BY dim)"""


def _embeddings(spark, sf):
    table = b.table(spark, sf, "embeddings")
    cells = metrics.array_cells(table, "vec_id", "embedding")
    labels = table.select(F.col("vec_id").alias("row_id"), "label")
    labelled = metrics.array_cells(table, "vec_id", "embedding", ("label",))
    return cells, labels, metrics.centroids(labelled, metrics.label_sizes(labels))


def _vector_labels(spark, sf, modulus=7):
    return b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), (F.col("vec_id") % modulus).cast("int").alias("label")
    )


def _rounded(df, *columns):
    return df.select(*[F.round(c, _DIGITS).alias(c) if c in columns else F.col(c) for c in df.columns])


@register(
    "s6_incidence_rows",
    "SELECT l_orderkey AS row_id, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY "
    "l_partkey::VARCHAR) AS dims, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_orderkey",
)
def _(spark, sf):
    rows = kmeans.incidence_rows(b.edges(spark, sf), "basket_id", "item_id")
    texts = F.array_sort(F.transform("dims", lambda d: d.cast("string")))
    return rows.select(
        "row_id", F.array_join(texts, ",").alias("dims"), F.size("dims").cast("long").alias("n")
    )


@register("s6_matrix_shape", "SELECT max(l_orderkey) + 1 AS n_rows, max(l_partkey) + 1 AS n_cols FROM lineitem")
def _(spark, sf):
    return b.edges(spark, sf).agg(
        (F.max("basket_id") + 1).alias("n_rows"), (F.max("item_id") + 1).alias("n_cols")
    )


@register(
    "c3_between_separation",
    b.with_ctes(
        f"SELECT round(sum(n * (c - m) * (c - m)) / ((SELECT count(*) FROM sizes) - 1), {_DIGITS}) "
        "AS separation FROM centres JOIN sizes USING (label) JOIN mean USING (dim)",
        _VECTORS,
    ),
)
def _(spark, sf):
    return _rounded(metrics.between_separation(*_embeddings(spark, sf)), "separation")


@register(
    "c4_calinski_harabasz",
    b.with_ctes(
        f"SELECT round(separation, {_DIGITS}) AS separation, round(cohesion, {_DIGITS}) AS cohesion,"
        f" round(separation / cohesion, {_DIGITS}) AS ch_score FROM "
        "(SELECT sum(n * (c - m) * (c - m)) / ((SELECT count(*) FROM sizes) - 1) AS separation "
        "FROM centres JOIN sizes USING (label) JOIN mean USING (dim)), "
        "(SELECT sum((x - c) * (x - c)) / ((SELECT sum(n) FROM sizes) - "
        "(SELECT count(*) FROM sizes)) AS cohesion FROM cells JOIN centres USING (label, dim))",
        _VECTORS,
    ),
)
def _(spark, sf):
    scores = metrics.calinski_harabasz(*_embeddings(spark, sf))
    return _rounded(scores, "separation", "cohesion", "ch_score")


# baskets labelled by key, as sparse 0/1 rows: absent cells count as zeros
_BASKETS = """ones AS (SELECT DISTINCT l_orderkey AS row_id, l_partkey AS dim FROM lineitem),
    bl AS (SELECT row_id, row_id % 5 AS label FROM (SELECT DISTINCT row_id FROM ones)),
    bn AS (SELECT label, count(*) AS n FROM bl GROUP BY label),
    bc AS (SELECT label, dim, count(*)::DOUBLE / any_value(n) AS c FROM ones JOIN bl USING (row_id)
        JOIN bn USING (label) GROUP BY label, dim),
    bm AS (SELECT dim, count(*)::DOUBLE / (SELECT count(*) FROM bl) AS m FROM ones GROUP BY dim),
    grid AS (SELECT label, n, dim, m, coalesce(c, 0) AS c FROM bn CROSS JOIN bm
        LEFT JOIN bc USING (label, dim)),
    within AS (SELECT label, sum(n * c * (1 - c) * (1 - c) + n * (1 - c) * c * c) AS squares
        FROM grid GROUP BY label)"""


def _basket_rows(spark, sf):
    cells = metrics.edge_cells(b.edges(spark, sf))
    labels = cells.select("row_id").distinct().withColumn("label", F.col("row_id") % 5)
    labelled = metrics.label_cells(cells, labels)
    return cells, labels, metrics.centroids(labelled, metrics.label_sizes(labels))


@register(
    "c4_calinski_harabasz_sparse",
    b.with_ctes(
        f"SELECT round(s, {_DIGITS}) AS separation, round(h, {_DIGITS}) AS cohesion, "
        f"round(s / h, {_DIGITS}) AS ch_score FROM "
        "(SELECT sum(n * (c - m) * (c - m)) / 4 AS s FROM grid), "
        "(SELECT sum(squares) / ((SELECT count(*) FROM bl) - 5) AS h FROM within)",
        _BASKETS,
    ),
)
def _(spark, sf):
    scores = metrics.calinski_harabasz(*_basket_rows(spark, sf))
    return _rounded(scores, "separation", "cohesion", "ch_score")


_SCATTER = """scatter AS (SELECT label, sqrt(sum((x - c) * (x - c)) / any_value(n)) AS scatter
    FROM cells JOIN centres USING (label, dim) JOIN sizes USING (label) GROUP BY label),
    apart AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS distance
        FROM centres a JOIN centres b USING (dim) WHERE a.label <> b.label GROUP BY 1, 2),
    worst AS (SELECT i AS label, max((s.scatter + t.scatter) / distance) AS worst FROM apart
        JOIN scatter s ON s.label = i JOIN scatter t ON t.label = j GROUP BY i)"""


@register(
    "c5_scatter",
    b.with_ctes(f"SELECT label, round(scatter, {_DIGITS}) AS scatter FROM scatter", _VECTORS, _SCATTER),
)
def _(spark, sf):
    cells, labels, centres = _embeddings(spark, sf)
    return _rounded(metrics.scatter(metrics.label_cells(cells, labels), labels, centres), "scatter")


@register(
    "c5_scatter_other_norms",
    b.with_ctes(
        f"SELECT label, round(avg(d ** 3) ** (1.0 / 3), {_DIGITS}) AS scatter FROM (SELECT row_id, "
        "label, sum(abs(x - c)) AS d FROM cells JOIN centres USING (label, dim) "
        "GROUP BY row_id, label) GROUP BY label",
        _VECTORS,
    ),
)
def _(spark, sf):
    cells, labels, centres = _embeddings(spark, sf)
    labelled = metrics.label_cells(cells, labels)
    return _rounded(metrics.scatter(labelled, labels, centres, p=1, q=3), "scatter")


@register(
    "c5_centroid_distances",
    b.with_ctes(f"SELECT i, j, round(distance, {_DIGITS}) AS distance FROM apart", _VECTORS, _SCATTER),
)
def _(spark, sf):
    _, labels, centres = _embeddings(spark, sf)
    return _rounded(
        metrics.centroid_distances(centres, metrics.label_sizes(labels)), "distance"
    )


@register(
    "c6_worst_similarity",
    b.with_ctes(f"SELECT label, round(worst, {_DIGITS}) AS worst FROM worst", _VECTORS, _SCATTER),
)
def _(spark, sf):
    cells, labels, centres = _embeddings(spark, sf)
    scatters = metrics.scatter(metrics.label_cells(cells, labels), labels, centres)
    apart = metrics.centroid_distances(centres, metrics.label_sizes(labels))
    return _rounded(metrics.worst_similarity(scatters, apart), "worst")


@register(
    "c6_davies_bouldin",
    b.with_ctes(f"SELECT round(avg(worst), {_DIGITS}) AS db_score FROM worst", _VECTORS, _SCATTER),
)
def _(spark, sf):
    return _rounded(metrics.davies_bouldin(*_embeddings(spark, sf)), "db_score")


# coordinates scaled to whole numbers, so that sums are exact and ties are decided alike
_WHOLE = """cells AS (SELECT row_id, dim, round(x * 1000)::DOUBLE AS x FROM (SELECT vec_id AS row_id,
    generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)),
    labels AS (SELECT vec_id AS row_id, (vec_id % 7)::INT AS label FROM embeddings)"""


def _whole(spark, sf):
    table = b.table(spark, sf, "embeddings")
    cells = metrics.array_cells(table, "vec_id", "embedding")
    return cells.withColumn("value", F.round(F.col("value") * 1000))


@register(
    "c8_medoid_assignment",
    b.with_ctes(
        f"SELECT row_id, label, round(distance, {_DIGITS}) AS distance FROM (SELECT a.row_id, "
        "(b.row_id // 10)::INT AS label, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS distance "
        "FROM cells a JOIN cells b USING (dim) WHERE b.row_id IN (0, 10, 20, 30, 40) GROUP BY 1, 2) "
        "QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, label) = 1",
        _WHOLE,
    ),
)
def _(spark, sf):
    assigned = medoids.assign_to_medoids(_whole(spark, sf), [0, 10, 20, 30, 40])
    return _rounded(assigned, "distance")


@register(
    "c8_medoid_assignment_other_metric",
    b.with_ctes(
        f"SELECT row_id, label, round(distance, {_DIGITS}) AS distance FROM (SELECT a.row_id, "
        "(b.row_id // 10)::INT AS label, sum(abs(a.x - b.x)) AS distance "
        "FROM cells a JOIN cells b USING (dim) WHERE b.row_id IN (0, 10, 20, 30, 40) GROUP BY 1, 2) "
        "QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, label) = 1",
        _WHOLE,
    ),
)
def _(spark, sf):
    rows = b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.transform("embedding", lambda x: F.round(x.cast("double") * 1000)).alias("vector"),
    )

    def city_block(x, y):
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: F.abs(p - q)), F.lit(0.0), lambda total, d: total + d
        )

    return _rounded(medoids.assign_dense(rows, [0, 10, 20, 30, 40], city_block), "distance")


@register(
    "c9_exact_medoids",
    b.with_ctes(
        f"SELECT label, medoid, round(loss, {_DIGITS}) AS loss FROM (SELECT label, medoid, "
        "sum(d) AS loss FROM (SELECT l.label, a.row_id AS medoid, b.row_id, "
        "sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM cells a JOIN labels l USING (row_id) "
        "JOIN labels m ON m.label = l.label JOIN cells b ON b.row_id = m.row_id AND b.dim = a.dim "
        "GROUP BY 1, 2, 3) GROUP BY 1, 2) "
        "QUALIFY row_number() OVER (PARTITION BY label ORDER BY loss, medoid) = 1",
        _WHOLE,
    ),
)
def _(spark, sf):
    found = medoids.exact_medoids(_whole(spark, sf), _vector_labels(spark, sf))
    return _rounded(found, "loss")


@register(
    "c10_medoids_near_mean",
    b.with_ctes(
        f"SELECT label, row_id AS medoid, round(d, {_DIGITS}) AS loss FROM (SELECT label, row_id, "
        "sqrt(sum((x - c) * (x - c))) AS d FROM cells JOIN labels USING (row_id) JOIN "
        "(SELECT label, dim, avg(x) AS c FROM cells JOIN labels USING (row_id) GROUP BY 1, 2) "
        "USING (label, dim) GROUP BY 1, 2) "
        "QUALIFY row_number() OVER (PARTITION BY label ORDER BY d, row_id) = 1",
        _WHOLE,
    ),
)
def _(spark, sf):
    found = medoids.medoids_near_mean(_whole(spark, sf), _vector_labels(spark, sf))
    return _rounded(found, "loss")


@register(
    "l4_nearest_row_to_zero",
    b.with_ctes(
        "SELECT label, min_by(row_id, (s, row_id)) AS row_id FROM (SELECT label, row_id, "
        "sum(x * x) AS s FROM cells JOIN labels USING (row_id) GROUP BY 1, 2) GROUP BY label",
        _WHOLE,
    ),
)
def _(spark, sf):
    sums = (
        metrics.label_cells(_whole(spark, sf), _vector_labels(spark, sf))
        .groupBy("label", "row_id")
        .agg(F.sum(F.col("value") * F.col("value")).alias("s"))
    )
    return sums.groupBy("label").agg(F.min_by("row_id", F.struct("s", "row_id")).alias("row_id"))


@register(
    "c12_adjusted_rand",
    """WITH t AS (SELECT label AS a, vec_id % 7 AS b, count(*) AS n FROM embeddings GROUP BY 1, 2),
    s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS nij,
        (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY a)) AS ai,
        (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY b)) AS bj,
        (SELECT sum(n) * (sum(n) - 1) / 2 FROM t) AS nn)
    SELECT round((nij - ai * bj / nn) / ((ai + bj) / 2 - ai * bj / nn), 6) AS ari FROM s""",
)
def _(spark, sf):
    _, labels, _ = _embeddings(spark, sf)
    return _rounded(metrics.adjusted_rand(labels, _vector_labels(spark, sf)), "ari")


@register(
    "c2_cluster_sizes",
    "SELECT label, count(*) AS n FROM embeddings GROUP BY label",
)
def _(spark, sf):
    return metrics.label_sizes(_embeddings(spark, sf)[1])


# the profile of the labels that the vectors come with
PROFILE_SQL = b.with_ctes(
    f"""SELECT (SELECT max(label) + 1 FROM sizes)::INT AS k,
        (SELECT string_agg(n::VARCHAR, ',' ORDER BY label) FROM sizes) AS cluster_counts,
        round(-inertia, {_DIGITS}) AS score, round(inertia, {_DIGITS}) AS inertia,
        round(separation / (inertia / ((SELECT sum(n) FROM sizes) - (SELECT count(*) FROM sizes))), {_DIGITS})
            AS ch_score, round((SELECT avg(worst) FROM worst), {_DIGITS}) AS db_score FROM
        (SELECT sum((x - c) * (x - c)) AS inertia FROM cells JOIN centres USING (label, dim)),
        (SELECT sum(n * (c - m) * (c - m)) / ((SELECT count(*) FROM sizes) - 1) AS separation
            FROM centres JOIN sizes USING (label) JOIN mean USING (dim))""",
    _VECTORS, _SCATTER,
)


def given_profile(spark, sf):
    return kmeans.profile_of_labels(*_embeddings(spark, sf))


def shown_profile(profile):
    counts = F.array_join(F.transform("cluster_counts", lambda n: n.cast("string")), ",")
    return _rounded(profile.withColumn("cluster_counts", counts), "score", "inertia", "ch_score", "db_score")


@register("c2_profile_of_labels", PROFILE_SQL)
def _(spark, sf):
    return shown_profile(given_profile(spark, sf))


@register("c1_kmeans_sweep_profiles")
def _(spark, sf):
    return kmeans.kmeans_sweep(metrics.edge_cells(b.edges(spark, sf)))


@register("c7_k_medoids_labels")
def _(spark, sf):
    cells = metrics.edge_cells(b.edges(spark, sf))
    found = medoids.k_medoids(Scratch(spark, "cells").keep(cells), k=5)
    return found.labels


@register("c7_k_medoids_exact_step")
def _(spark, sf):
    found = medoids.k_medoids(_whole(spark, sf), k=10, step="exact")
    return found.labels


@register("c11_mini_batch_kmeans")
def _(spark, sf):
    cells = _embeddings(spark, sf)[0]
    return kmeans.mini_batch_kmeans(cells, k=10).labels


def _made(body: str, block: str) -> str:
    source = f"given AS (SELECT o_orderkey AS row_id, {block} AS block FROM orders)"
    return f"WITH RECURSIVE {source}, {synthetic.sparse_rows_sql('given', 200, 0.02, 0.1, 3)} {body}"


@register("c13_synthetic_rows", _made("SELECT row_id, dim, 1.0::DOUBLE AS value FROM made", "0"))
def _(spark, sf):
    rows = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    return synthetic.sparse_rows(rows, 200, 0.02, 0.1, seed=3)


@register(
    "c14_synthetic_clusters",
    _made("SELECT row_id, dim, 1.0::DOUBLE AS value, block AS label FROM made", "o_orderpriority"),
)
def _(spark, sf):
    rows = b.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label")
    )
    cells, labels = synthetic.sparse_clusters(rows, 200, 0.02, 0.1, seed=3)
    return metrics.label_cells(cells, labels)
