"""Cluster metrics, medoids and K-means against numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketloom.operators import kmeans, medoids, metrics, synthetic
from basketloom.plans.clustering import cluster_pairs


def matrix(n=60, d=12, seed=0):
    rng = np.random.default_rng(seed)
    data = (rng.random((n, d)) < 0.3).astype(float) * rng.integers(1, 4, (n, d))
    data[3] = 0  # a row without cells
    return data


def frames(spark, data, labels):
    cells = [(i, int(j), float(data[i, j])) for i in range(len(data)) for j in np.flatnonzero(data[i])]
    return (
        spark.createDataFrame(cells, "row_id long, dim int, value double"),
        spark.createDataFrame([(i, int(k)) for i, k in enumerate(labels)], "row_id long, label int"),
    )


def centres_frame(spark, centres):
    rows = [(k, int(j), float(c[j])) for k, c in enumerate(centres) for j in np.flatnonzero(c)]
    return spark.createDataFrame(rows, "label int, dim int, value double")


@pytest.fixture(scope="module")
def case(spark):
    data = matrix()
    labels = np.arange(len(data)) % 4
    # centroids need not be the means of their clusters
    centres = np.array([data[labels == k].mean(axis=0) for k in range(4)])
    centres[1] += 0.25
    return data, labels, centres, *frames(spark, data, labels), centres_frame(spark, centres)


def test_calinski_harabasz(case):
    data, labels, centres, cells, frame, centre_cells = case
    n_k = np.bincount(labels)
    separation = (n_k * ((centres - data.mean(axis=0)) ** 2).sum(axis=1)).sum() / 3
    cohesion = ((data - centres[labels]) ** 2).sum() / (len(data) - 4)
    row = metrics.calinski_harabasz(cells, frame, centre_cells).first()
    assert row["separation"] == pytest.approx(separation)
    assert row["cohesion"] == pytest.approx(cohesion)
    assert row["ch_score"] == pytest.approx(separation / cohesion)


@pytest.mark.parametrize(("p", "q"), [(2, 2), (1, 1), (3, 2), (1, 3)])
def test_davies_bouldin(case, p, q):
    data, labels, centres, cells, frame, centre_cells = case
    norms = np.linalg.norm(data - centres[labels], p, axis=1) ** q
    s = np.array([norms[labels == k].mean() ** (1 / q) for k in range(4)])
    m = np.array([[np.linalg.norm(a - b, p) for b in centres] for a in centres])
    worst = [max((s[i] + s[j]) / m[i, j] for j in range(4) if j != i) for i in range(4)]
    row = metrics.davies_bouldin(cells, frame, centre_cells, p, q).first()
    assert row["db_score"] == pytest.approx(np.mean(worst))


def test_coincident_centroids_are_infinitely_similar(spark, case):
    _, _, centres, cells, frame, _ = case
    same = centres.copy()
    same[2] = same[0]
    row = metrics.davies_bouldin(cells, frame, centres_frame(spark, same)).first()
    assert row["db_score"] == math.inf


def test_adjusted_rand_of_equal_and_renamed_labels(spark):
    a = spark.createDataFrame([(i, i % 3) for i in range(30)], "row_id long, label int")
    b = a.withColumn("label", (F.col("label") + 1) % 3)
    one = a.withColumn("label", F.lit(0))
    assert metrics.adjusted_rand(a, b).first()["ari"] == pytest.approx(1.0)
    assert metrics.adjusted_rand(a, one).first()["ari"] == pytest.approx(0.0)
    assert metrics.adjusted_rand(one, one).first()["ari"] == 1.0


def test_assignment_covers_rows_without_cells(case):
    data, _, _, cells, frame, _ = case
    chosen = [5, 17, 40]
    distances = np.linalg.norm(data[:, None] - data[chosen][None], axis=2)
    found = {r["row_id"]: r for r in medoids.assign_to_medoids(cells, chosen, frame).collect()}
    assert len(found) == len(data)
    for i, row in enumerate(distances):
        assert found[i]["label"] == row.argmin()
        assert found[i]["distance"] == pytest.approx(row.min())


@pytest.mark.parametrize("batch", [3, 8, 32])
def test_exact_medoids_whatever_the_batch(spark, batch):
    data = np.random.default_rng(8).normal(size=(40, 3)).round(2)
    labels = np.array([0] * 25 + [1] * 14 + [2])
    cells, frame = frames(spark, data, labels)
    found = {r["label"]: r for r in medoids.exact_medoids(cells, frame, batch).collect()}
    for k in range(3):
        ids = np.flatnonzero(labels == k)
        sums = np.linalg.norm(data[ids][:, None] - data[ids][None], axis=2).sum(axis=1)
        assert found[k]["medoid"] == ids[sums.argmin()]
        assert found[k]["loss"] == pytest.approx(sums.min(), abs=1e-6)


def test_blocks_sum_all_pairs_of_a_label(spark):
    data = matrix(90, 9, seed=4)
    labels = np.array([0] * 50 + [1] * 39 + [2])
    cells, frame = frames(spark, data, labels)
    vectors = frame.join(medoids.row_vectors(cells), "row_id", "left")
    wanted = frame.where("row_id % 3 = 0")
    found = medoids.summed_distances(vectors, wanted, block_rows=7, block_cells=20)
    sums = {r["row_id"]: r["loss"] for r in found.collect()}
    assert sorted(sums) == [i for i in range(90) if i % 3 == 0]
    for i, loss in sums.items():
        mates = data[labels == labels[i]]
        assert loss == pytest.approx(np.linalg.norm(mates - data[i], axis=1).sum(), abs=1e-6)


@pytest.mark.parametrize("d", [2, 40])
def test_exact_medoids_need_few_passes_where_bounds_say_nothing(spark, monkeypatch, d):
    data = np.random.default_rng(d).normal(size=(150, d)).round(2)
    data[149] = data[0]  # equal rows tie, the smaller id wins
    labels = np.arange(150) % 2 * 0
    cells, frame = frames(spark, data, labels)
    passes, plain = [], medoids._summed_distances
    monkeypatch.setattr(
        medoids, "_summed_distances", lambda *given: passes.append(1) or plain(*given)
    )
    found = medoids.exact_medoids(cells, frame, 4, plain_pairs=0).first()
    sums = np.linalg.norm(data[:, None] - data[None], axis=2).sum(axis=1)
    assert found["medoid"] == sums.argmin()
    assert found["loss"] == pytest.approx(sums.min(), abs=1e-6)
    assert len(passes) <= 8  # 38 in batches of 4
    passes.clear()
    assert medoids.exact_medoids(cells, frame, 4).first()["medoid"] == sums.argmin()
    assert not passes


def test_medoids_near_mean(case):
    data, labels, _, cells, frame, _ = case
    found = {r["label"]: r for r in medoids.medoids_near_mean(cells, frame).collect()}
    for k in range(4):
        ids = np.flatnonzero(labels == k)
        distances = np.linalg.norm(data[ids] - data[ids].mean(axis=0), axis=1)
        assert found[k]["loss"] == pytest.approx(distances.min())


@pytest.mark.parametrize("seed", range(2))
def test_few_rows_are_joined_to_the_mean(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    data = (rng.random((300, 400)) < 0.01).astype(float)  # no column fills a cluster
    data[:, 0] = np.arange(300) % 50 == 0
    data[7] = -2 * data[8]
    labels = np.arange(300) % 3
    cells, frame = frames(spark, data, labels)
    joined, plain = [], medoids.join_counted
    monkeypatch.setattr(
        medoids, "join_counted", lambda rows, *rest: joined.append(rows.count()) or plain(rows, *rest)
    )
    found = {r["label"]: r for r in medoids.medoids_near_mean(cells, frame).collect()}
    for k in range(3):
        ids = np.flatnonzero(labels == k)
        distances = np.linalg.norm(data[ids] - data[ids].mean(axis=0), axis=1)
        assert found[k]["loss"] == pytest.approx(distances.min())
        assert distances[list(ids).index(found[k]["medoid"])] == pytest.approx(distances.min())
    assert sum(joined) < cells.count() / 4


def test_k_medoids_loss_does_not_grow(spark):
    rng = np.random.default_rng(2)
    data = np.concatenate([rng.normal(c, 0.4, size=(12, 2)) for c in (0, 5, 10)])
    cells, _ = frames(spark, data, np.zeros(len(data)))
    found = medoids.k_medoids(cells, 3, initial=[0, 1, 2], threshold=0, iterations=3, step="exact")
    assert all(a >= b - 1e-9 for a, b in zip(found.losses, found.losses[1:]))
    assert len(set(found.medoids)) == 3
    assert {r["label"] for r in found.labels.collect()} <= {0, 1, 2}


def blocks(spark, n=90):
    """Three kinds of rows with items of their own."""
    rows = spark.range(n).select(F.col("id").alias("rid"), (F.col("id") % 3).alias("kind"))
    pairs = rows.select("rid", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"), "kind")
    return pairs.select("rid", (F.col("kind") * 4 + F.col("j")).alias("iid"))


def test_kmeans_sweep_finds_blocks(spark, tmp_path):
    blocks(spark).coalesce(1).write.csv(f"{tmp_path}/pairs")
    path = cluster_pairs(spark, f"{tmp_path}/pairs", f"{tmp_path}/results", ks=(2, 3), seed=1)
    rows = {r["k"]: r for r in spark.read.parquet(path).collect()}
    assert sorted(rows[3]["cluster_counts"]) == [30, 30, 30]
    assert rows[3]["inertia"] == pytest.approx(0, abs=1e-9)
    assert rows[3]["score"] == -rows[3]["inertia"]
    assert sum(rows[2]["cluster_counts"]) == 90 and rows[2]["inertia"] > 1


def test_mini_batches_recover_blocks(spark):
    cells = metrics.edge_cells(blocks(spark), "rid", "iid")
    found = kmeans.mini_batch_kmeans(cells, 3, batch_size=20, max_iter=6, n_init=2, seed=3)
    labels = found.labels
    assert labels.count() == 90
    assert labels.select("label").distinct().count() <= 3
    # every block ends up in one cluster
    kinds = labels.withColumn("kind", F.col("row_id") % 3)
    assert kinds.select("kind", "label").distinct().count() == 3


def test_moments_take_one_scan_of_the_cells(spark, tmp_path):
    spark.range(2000).select(
        (F.col("id") % 100).alias("row_id"), (F.col("id") % 7).alias("dim"), F.rand(1).alias("value")
    ).write.parquet(f"{tmp_path}/cells")
    cells = spark.read.parquet(f"{tmp_path}/cells")
    labels = spark.range(90).select(F.col("id").alias("row_id"), (F.col("id") % 4).alias("label"))
    found = metrics.moments(cells, labels)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange ") + plan.count("BroadcastExchange") <= 4
    # rows without a label count for the columns, not for a cluster
    assert found.where("label IS NULL").count() > 0
    assert found.agg(F.sum("s")).first()[0] == pytest.approx(cells.agg(F.sum("value")).first()[0])


def test_candidates_are_limited_before_the_shuffle(spark):
    rows = spark.range(1000).select(
        F.col("id").alias("row_id"), (F.col("id") % 3).alias("label"), F.lit(1).alias("n"), F.rand(1).alias("bound")
    )
    found = medoids.most_promising(rows, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # a limit in the tasks that read the rows, and one after they have been dealt by label
    before, _, after = plan.partition("Exchange hashpartitioning(label")
    assert "WindowGroupLimit" in before and "WindowGroupLimit" in after
    assert found.groupBy("label").agg(F.max("slot"), F.count("*")).where("`max(slot)` <> 4 OR `count(1)` <> 5").isEmpty()


@pytest.mark.parametrize("batch_size", [16, 10_000])
def test_mini_batches_equal_numpy(spark, batch_size):
    rng = np.random.default_rng(5)
    data = np.concatenate([rng.normal(c, 0.3, (40, 5)) for c in (-4, 0, 4)])
    cells = spark.createDataFrame(
        [(int(r), int(d), float(x)) for r, row in enumerate(data) for d, x in enumerate(row)],
        "row_id long, dim long, value double",
    )
    found = kmeans.mini_batch_kmeans(cells, 3, batch_size=batch_size, max_iter=9, n_init=2, seed=1)
    rows = sorted(map(tuple, found.labels.collect()))
    centres = np.zeros((3, 5))
    for r in found.centres.collect():
        centres[r["label"], r["dim"]] = r["value"]
    apart = ((data[:, None] - centres[None]) ** 2).sum(2)
    assert [label for _, label, _ in rows] == apart.argmin(1).tolist()
    assert [d for _, _, d in rows] == pytest.approx(np.sqrt(apart.min(1)).tolist(), rel=1e-6, abs=1e-6)
    assert found.inertia == pytest.approx(apart.min(1).sum())


def test_batches_are_dealt_anew_every_pass(spark):
    rows = spark.range(1000).select(F.col("id").alias("row_id"), F.array(F.lit(0)).alias("dims"), F.array(F.lit(1.0)).alias("values"))
    drawn = kmeans.drawn_batches(rows, 1000, 100, 25, [0, 1]).collect()
    for start in (0, 1):
        batches = [{r["row_id"] for r in drawn if r["iteration"] == i and start in r["starts"]} for i in range(25)]
        assert all(60 < len(b) < 140 for b in batches)
        assert set().union(*batches[:10]) == set(range(1000)) and sum(map(len, batches[:10])) == 1000
        assert len(batches[0] & batches[10]) < 40


def test_too_few_rows_for_mini_batches(spark):
    cells = metrics.edge_cells(blocks(spark, 2), "rid", "iid")
    with pytest.raises(ValueError):
        kmeans.mini_batch_kmeans(cells, 5)


def test_synthetic_rows_have_the_wanted_density(spark):
    rows = synthetic.numbered_rows(spark, [300, 200])
    cells, labels = synthetic.sparse_clusters(rows, 100, 0.05, 0.2, seed=4)
    assert labels.groupBy("label").count().orderBy("label").collect()[0]["count"] == 300
    assert cells.count() == cells.select("row_id", "dim").distinct().count()
    assert cells.count() / (500 * 100) == pytest.approx(0.05, rel=0.15)
    labelled = metrics.label_cells(cells, labels)
    used = labelled.groupBy("label").agg(F.countDistinct("dim").alias("n")).collect()
    assert all(r["n"] <= 20 for r in used)
    again, _ = synthetic.sparse_clusters(rows, 100, 0.05, 0.2, seed=4)
    assert again.exceptAll(cells).isEmpty()
    with pytest.raises(ValueError):
        synthetic.sparse_rows(rows, 100, 0.5, 0.2)


@pytest.mark.parametrize("density,col_density", [(1.0, None), (0.5, 0.5), (0.0, 0.5), (0.9, None), (0.003, 0.01)])
def test_synthetic_rows_at_all_densities(spark, monkeypatch, density, col_density):
    rows = spark.range(400).select(F.col("id").alias("row_id"))
    found = sorted(map(tuple, synthetic.sparse_rows(rows, 300, density, col_density, seed=7).collect()))
    assert len(found) == len(set(found)) and all(0 <= d < 300 for _, d, _ in found)
    assert len(found) / (400 * 300) == pytest.approx(density, rel=0.1, abs=1e-9)
    if 0 < density < 1:
        # rows that need more draws than are taken at first come out the same
        monkeypatch.setattr(synthetic, "sqrt", lambda x: -x / 6)
        again = synthetic.sparse_rows(rows, 300, density, col_density, seed=7).collect()
        assert sorted(map(tuple, again)) == found


def test_binary_incidence(spark):
    pairs = spark.createDataFrame([(1, 5), (1, 5), (1, 2), (2, 0)], "rid long, iid long")
    rows = {r["row_id"]: r["dims"] for r in kmeans.incidence_rows(pairs).collect()}
    assert rows == {1: [2, 5], 2: [0]}
    assert kmeans.matrix_width(metrics.edge_cells(pairs, "rid", "iid")) == 6


def test_queries_keep_the_parameters_of_the_reference(monkeypatch):
    """cluster_metrics.py:121, cluster_scaling_MiniBatchKMeans.py:60 and scikit-learn's K-means."""
    import inspect

    import __spark_entry__ as entry
    from basketloom.catalog import clusters

    class Called(Exception):
        pass

    def caught(function, seen):
        def call(*args, **kwargs):
            given = inspect.signature(function).bind(*args, **kwargs)
            given.apply_defaults()
            seen.update(given.arguments)
            raise Called

        return call

    real = {
        "kmeans_sweep": kmeans.kmeans_sweep,
        "k_medoids": medoids.k_medoids,
        "mini_batch_kmeans": kmeans.mini_batch_kmeans,
    }
    monkeypatch.setattr(clusters, "_whole", lambda *a: None)
    monkeypatch.setattr(clusters, "_embeddings", lambda *a: (None, None, None))
    monkeypatch.setattr(clusters.b, "edges", lambda *a: None)
    monkeypatch.setattr(clusters.metrics, "edge_cells", lambda *a: None)
    monkeypatch.setattr(clusters, "Scratch", lambda *a: type("S", (), {"keep": lambda self, x: x})())
    for name, module, operator, wanted in [
        ("c1_kmeans_sweep_profiles", kmeans, "kmeans_sweep", {"max_iter": 300}),
        ("c7_k_medoids_labels", medoids, "k_medoids", {"iterations": 10}),
        ("c7_k_medoids_exact_step", medoids, "k_medoids", {"iterations": 10, "step": "exact"}),
        ("c11_mini_batch_kmeans", kmeans, "mini_batch_kmeans", {"batch_size": 1024, "max_iter": 100, "n_init": 3}),
    ]:
        seen = {}
        monkeypatch.setattr(module, operator, caught(real[operator], seen))
        with pytest.raises(Called):
            entry.queries()[name](None, "")
        assert wanted.items() <= seen.items(), name


@pytest.mark.parametrize("head", [1000, 3])
def test_sweep_agrees_with_spark_ml(spark, monkeypatch, head):
    """With few known entries of a centre, bounds and the join to all entries decide."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as T

    from basketloom.operators import lloyd
    from basketloom.runtime import Scratch

    monkeypatch.setattr(lloyd, "HEAD", head)
    rng = np.random.default_rng(7)
    rows = []
    for row in range(400):
        kind = row % 4
        own = rng.choice(12, rng.integers(3, 7), replace=False) + 12 * kind
        dims = {*map(int, own), *(48 + int(d) for d in rng.integers(0, 30, rng.integers(0, 3)))}
        rows += [(row, d, float(1 + (d + row) % 2)) for d in dims]
    cells = spark.createDataFrame(rows, "row_id long, dim long, value double")
    ks = (2, 3, 5, 9)
    scratch = Scratch(spark, "test")
    kmeans.vector_rows(scratch.keep(cells), kmeans.matrix_width(cells), scratch)
    schema = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("features", VectorUDT())])
    vectors = spark.read.schema(schema).parquet(f"{scratch.base}/0001")
    for found in kmeans.kmeans_sweep(cells, ks, seed=4).collect():
        model = KMeans(k=found["k"], seed=4, maxIter=300).fit(vectors)
        assert found["cluster_counts"] == model.summary.clusterSizes
        assert found["inertia"] == pytest.approx(model.summary.trainingCost, rel=1e-9)


def test_sweep_holds_no_vector_of_the_full_width(spark):
    """A single dense centre would take 16 GB."""
    wide = 2_000_000_000
    cells = spark.range(60).selectExpr(
        "id AS row_id", f"explode(array(id % 3 * 600000000 + 7, {wide} - id % 3, 100 + id)) AS dim", "1.0D AS value"
    )
    found = kmeans.kmeans_sweep(cells, (3,), seed=1).first()
    assert sum(found["cluster_counts"]) == 60 and len(found["cluster_counts"]) == 3
    assert 0 < found["inertia"] < 180


def test_draws_are_those_of_spark(spark):
    from basketloom.operators.lloyd import Draws

    for seed in (0, 7, -12345, 1 << 40):
        made, theirs = Draws(seed), spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed)
        assert [*made.doubles(3), *made.doubles(600)] == [theirs.nextDouble() for _ in range(603)]


def test_sweep_leaves_out_cells_without_a_column_but_not_their_rows(spark):
    def swept(more):
        rows = [(row, dim, 1.0) for row in range(8) for dim in (3 + row % 2, 9)] + more
        cells = spark.createDataFrame(rows, "row_id long, dim long, value double").coalesce(1)
        return kmeans.kmeans_sweep(cells, (2,), seed=1).first()

    one, both = swept([(20, 5, 1.0)]), swept([(20, None, 1.0), (20, 5, 1.0)])
    assert both == one
    assert sum(swept([(20, None, 1.0)])["cluster_counts"]) == 9
    with pytest.raises(ValueError, match="several cells"):
        swept([(20, 5, 1.0), (20, 5, 1.0)])
