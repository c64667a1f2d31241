import numpy as np
import pytest
from helpers import profile, when
from pyspark.sql import functions as F

from packetlens import schemas
from packetlens.functions.quantiles import exact_quantile
from packetlens.operators import registry
from packetlens.operators.neighbours import Cells, nearest, plan_cells, vector_id
from packetlens.plans import jobs, workspace
from packetlens.settings import AnalyzerSettings


def table(spark, vectors):
    rows = [(f"h{i}", when(60 * i), when(60 * i + 60), "tumbling", *[float(x) for x in v]) for i, v in enumerate(vectors)]
    names = ", ".join(f"{n} double" for n in schemas.FEATURES)
    return spark.createDataFrame(rows, f"host_id string, window_start timestamp, window_end timestamp, window_type string, {names}")


@pytest.fixture(scope="module")
def vectors():
    """Two clusters, many copies of one row, and a few far rows."""
    rng = np.random.default_rng(1)
    a = rng.normal(0, 1, (150, 11)) * np.array([1, 50, 1, 1000, 1, 1, 1, 1, 1, 5, 5])
    b = rng.normal(20, 2, (100, 11))
    far = rng.normal(5000, 500, (4, 11))
    return np.round(np.vstack([a, b, np.tile(b[:1], (120, 1)), far]), 3)


@pytest.mark.parametrize("q", [0.0, 0.02, 0.5, 0.99, 1.0])
def test_exact_quantile(spark, q):
    rng = np.random.default_rng(2)
    values = np.round(np.append(rng.normal(0, 10, 3000), np.full(1500, 1.25)), 2)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    for limit in (100_000, 50, 1):
        assert exact_quantile(df, "x", q, limit) == pytest.approx(np.quantile(values, q), abs=1e-12)
    assert exact_quantile(df.where("x > 1e9"), "x", q) is None


def brute_lof(train, test, k):
    """Factor of every test row, by comparing all pairs."""
    def neighbours(x, skip=None):
        d = np.sqrt(((train - x) ** 2).sum(axis=1))
        if skip is not None:
            d[skip] = np.inf
        order = np.argsort(d, kind="stable")[:k]
        return order, d[order]

    found = [neighbours(x, i) for i, x in enumerate(train)]
    reach = np.array([d[-1] for _, d in found])
    density = np.array([1 / (np.maximum(d, reach[o]).mean() + 1e-10) for o, d in found])
    out = []
    for x in test:
        o, d = neighbours(x)
        out.append(density[o].mean() * (np.maximum(d, reach[o]).mean() + 1e-10))
    return np.array(out)


@pytest.mark.parametrize("cell_rows", [10, 30, 2000])
def test_lof_equals_brute_force(spark, vectors, cell_rows):
    rng = np.random.default_rng(3)
    test = np.vstack([vectors[:60], rng.normal(10, 30, (40, 11)), vectors[-4:]])
    fitted = registry.detector("lof", cell_rows=cell_rows).fit(table(spark, vectors))
    got = {r.host_id: r.lof_factor for r in fitted._scored(table(spark, test)).collect()}
    want = brute_lof(vectors, test, 20)
    assert [got[f"h{i}"] for i in range(len(test))] == pytest.approx(want, rel=1e-6)


def test_nearest_blocks(spark, vectors, monkeypatch):
    """Groups of at most 15 rows on either side find the same neighbours."""
    from packetlens.operators import neighbours

    unique = np.unique(vectors, axis=0)
    points = table(spark, unique).withColumn("pid", vector_id()).withColumn("weight", F.lit(1).cast("long"))
    points = workspace.written(points.select("pid", "weight", *schemas.FEATURES), "points")
    queries = points.withColumnRenamed("pid", "qid")
    cells = plan_cells(points, 60)

    def found():
        return {(r.qid, r.pid, r.distance) for r in nearest(queries, points, cells, 5, True).collect()}

    whole = found()
    monkeypatch.setattr(neighbours, "BLOCK", 15)
    assert found() == whole and len(whole) == 5 * len(unique)


def test_cells_cover_space():
    x = np.round(np.random.default_rng(4).normal(0, 3, (500, 11)))
    cells = Cells.cut(x, 16)
    homes = cells.home(x)
    assert len(set(homes)) > 8
    row, cell = cells.within(x, np.full(500, 4.0))
    reachable = set(zip(row, cell))
    for i in range(500):
        close = np.sqrt(((x - x[i]) ** 2).sum(axis=1)) <= 4.0
        assert all((i, c) in reachable for c in homes[close])
    assert len(set(Cells.cut(np.ones((50, 11)), 8).home(np.ones((3, 11))))) == 1


@pytest.mark.parametrize("core, share", [("isoforest", 0.02), ("ocsvm", 0.02), ("kmeans", 0.01), ("mlp", 0.01)])
def test_trained_detectors(spark, vectors, core, share):
    profiles = workspace.written(table(spark, vectors), "profiles")
    params = {"mlp": {"iterations": 25}, "ocsvm": {"steps": 5}}.get(core, {})
    root = workspace.fresh(spark, "models")
    fitted = jobs.train(profiles, core, root, "v7", **params)
    found = fitted.score(profiles).collect()
    assert abs(len(found) - share * len(vectors)) <= 2
    assert all(0 <= r.risk_score <= 1 and r.severity in (2, 3, 4) and r.model_version == "v7" for r in found)
    far = {f"h{i}" for i in range(len(vectors) - 4, len(vectors))}
    if core in ("isoforest", "mlp"):  # far rows may form a cluster, or all saturate a kernel alike
        assert {r.host_id for r in found} & far
    loaded = registry.detector(core, model_version="v7").load(spark, root)
    assert sorted(loaded.score(profiles).collect()) == sorted(found)


def test_autoencoder_needs_few_passes_and_no_layout(spark, vectors):
    """The error is that of 300 full-batch steps, within a tenth, and the model that of any partitioning."""
    from packetlens.operators import autoencoder

    profiles = workspace.written(table(spark, vectors), "profiles")
    maker = registry.detector("mlp")
    assert maker.iterations <= 20
    model = maker.fit(profiles).model
    other = registry.detector("mlp").fit(profiles.repartition(7, "host_id")).model
    for part in ("weights", "mean", "scale", "threshold"):
        assert np.array(other[part]) == pytest.approx(np.array(model[part]), rel=1e-6, abs=1e-9)
    x = np.array([[float(r[f]) for f in schemas.FEATURES] for r in profiles.collect()])
    x = (x - model["mean"]) / model["scale"]

    def error(flat):
        layers = autoencoder.unpack(np.asarray(flat), model["sizes"])
        return ((autoencoder.forward(layers, x)[-1] - x) ** 2).mean()

    flat = registry.detector("mlp")._start()
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    for t in range(1, 301):
        g = autoencoder.gradient(flat, model["sizes"], x)[:-1] / len(x) + 1e-4 * flat / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - 0.01 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    assert error(model["weights"]) <= 1.1 * error(flat)


def test_forest_is_reproducible(spark, vectors):
    profiles = table(spark, vectors)
    a, b = (registry.detector("isoforest", n_trees=20).fit(profiles).model for _ in range(2))
    assert a == b


def test_kmeans_is_reproducible(spark, vectors):
    profiles = table(spark, vectors)
    a, b = (registry.detector("kmeans").fit(p).model for p in (profiles, profiles.repartition(7, "host_id")))
    assert a["threshold"] == pytest.approx(b["threshold"])
    assert np.array(a["centres"]) == pytest.approx(np.array(b["centres"]))


def test_forest_tree_samples_are_full(spark):
    """Every tree draws for itself, by one rule for any number of rows, and gets its sample."""
    from packetlens.operators.isoforest import SAMPLE

    rows = spark.range(12_000).select(
        F.col("id").cast("string").alias("host_id"), F.lit("tumbling").alias("window_type"),
        F.lit(when(0)).alias("window_start"), F.lit(when(60)).alias("window_end"))
    forest = registry.detector("isoforest", n_trees=10)
    sampled = forest._samples(rows, 12_000)
    sizes = [r["count"] for r in sampled.groupBy("tree").count().collect()]
    assert len(sizes) == 10 and min(sizes) >= SAMPLE
    drawn = sampled.groupBy("host_id").count().groupBy("count").count().collect()
    shared = sum(r[1] for r in drawn if r[0] > 1)
    assert 0 < shared < 0.1 * 12_000  # independent draws meet now and then
    few = forest._samples(rows.limit(100), 100)
    assert few.count() == 10 * 100  # fewer rows than a sample: all of them, for every tree


def test_few_or_no_rows(spark, vectors):
    empty = table(spark, vectors[:1]).limit(0)
    one = table(spark, vectors[:1])
    for core in ("isoforest", "lof", "kmeans"):
        assert registry.detector(core).fit(empty).score(one).isEmpty()
        assert registry.detector(core).fit(one).score(one).isEmpty()


def test_zero_threshold_gives_no_alert(spark, vectors):
    same = table(spark, np.tile(np.arange(11.0), (16, 1)))
    assert registry.detector("kmeans").fit(same).score(table(spark, vectors)).isEmpty()


def test_registry(spark):
    with pytest.raises(ValueError):
        registry.detector("oracle")
    built = registry.build_detectors(spark, AnalyzerSettings(model_root=workspace.fresh(spark, "none")))
    assert [d.name for d in built] == ["rule", "isoforest"] and not built[1].active
    noisy = profile(spark, uniq_dst_port=150)
    assert [r.detector for r in registry.score_all(noisy, built).collect()] == ["rule:port_scan"]
    assert registry.score_all(noisy, [built[1]]).isEmpty()


def test_one_failing_detector_does_not_stop_the_rest(spark):
    class Failing(registry.Rules):
        name = "failing"

        def _hits(self):
            raise RuntimeError("broken")

    noisy, found = profile(spark, uniq_dst_port=150), []
    detectors = [Failing(), registry.detector("rule")]
    assert registry.score_all(noisy, detectors).count() == 1
    assert registry.score_each(noisy, detectors, lambda df: found.extend(df.collect())) == ["failing"]
    assert len(found) == 1


def test_kmeans_does_not_depend_on_partitions(spark, vectors):
    """The same centres and threshold whatever the layout and the session's shuffle partitions."""
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (2, 4, 8, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            found.append(registry.detector("kmeans", k=4).fit(table(spark, vectors).repartition(parts)).model)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(m == found[0] for m in found) and len(found[0]["centres"]) == 4


def test_unusable_model_files_leave_a_detector_inactive(spark, vectors):
    root = workspace.fresh(spark, "models")
    for i, content in enumerate(["{not json", "[1, 2]", None]):
        name = registry.detector("kmeans", model_version=f"v{i}")
        rows = [(content,)] if content else []
        spark.createDataFrame(rows, "model string").write.parquet(f"{root}/kmeans/v{i}/model")
        assert not name.load(spark, root).active
    fitted = registry.detector("kmeans", k=2, model_version="cut").fit(table(spark, vectors))
    path = fitted.save(spark, root)
    import glob

    for file in glob.glob(f"{path}/model/*.parquet".removeprefix("file:")):
        with open(file, "r+b") as f:
            f.truncate(20)
    assert not registry.detector("kmeans", model_version="cut").load(spark, root).active


def test_svm_reports_its_gap(spark, vectors):
    model = registry.detector("ocsvm", n_features=16, tolerance=0.05).fit(table(spark, vectors)).model
    assert 0 <= model["gap"] <= 0.05


def test_neighbours_of_lonely_cells(spark, vectors):
    """Cells with fewer points than k: anchors bound the distance and the result stays exact."""
    points = table(spark, vectors).select(*schemas.FEATURES).distinct().withColumn("pid", vector_id()).withColumn("weight", F.lit(1).cast("long"))
    points = workspace.written(points, "points")
    queries = points.withColumnRenamed("pid", "qid").drop("weight")
    tiny = Cells.cut(np.array([r[:11] for r in points.select(*schemas.FEATURES).collect()], dtype=float), 30)
    found = nearest(queries, points, tiny, 40, exclude_self=True).groupBy("qid").agg(F.max("distance").alias("d"), F.sum("weight").alias("n"))
    x = {r["qid"]: np.array([r[f] for f in schemas.FEATURES]) for r in queries.collect()}
    everything = np.array(list(x.values()))
    for r in found.collect():
        d = np.sort(np.sqrt(((everything - x[r.qid]) ** 2).sum(axis=1)))
        assert r.n == 40 and r.d == pytest.approx(d[40])


def test_trees_inside_groups_change_nothing(spark):
    """One cell of many points: the tree inside the group gives what comparing all pairs gives."""
    from packetlens.operators import neighbours as N

    rng = np.random.default_rng(4)
    x = np.round(np.vstack([rng.normal(0, 1, (1500, 11)), rng.normal(30, 5, (600, 11)), np.repeat(rng.normal(0, 1, (5, 11)), 3, axis=0)]), 1)
    p = np.unique(x, axis=0)
    near = N._near_rows(p[::7], np.full(len(p[::7]), np.inf), p, 12)
    for q, rows in zip(p[::7], near):
        d = N._distances(q[None], p)[0]
        kth = np.sort(d)[12]
        assert set(np.flatnonzero(d <= kth)) <= set(rows.tolist()) and len(set(rows.tolist())) == len(rows)
    assert np.mean([len(r) for r in near]) < len(p)
