import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from iontide import catalog
from iontide.operators import bins, calibration, composition, deconvolution, mesh, ordered, ranging, reconstruction, spatial, spectrum, volume
from iontide.sources import mesh_files


def ranges(spark, rows):
    return spark.createDataFrame(rows, "rangeIdx int, rangeName string, mcbegin double, mcend double")


def ions_at(spark, *mc):
    return spark.createDataFrame(list(enumerate(map(float, mc), 1)), "ionIdx bigint, mc double")


def test_bounds_are_inside_and_the_last_range_wins(spark):
    table = ranges(spark, [(0, "a", 1.0, 2.0), (1, "b", 2.0, 3.0)])
    found = {r.ionIdx: r.rangeName for r in ranging.allocate(ions_at(spark, 1.0, 2.0, 3.0, 3.1), table).collect()}
    assert found == {1: "a", 2: "b", 3: "b", 4: None}
    assert [r.ionIdx for r in ranging.unranged(ions_at(spark, 0.5, 1.5), table).collect()] == [1]


def test_range_join_is_an_equi_join(spark):
    plan = ranging.allocate_disjoint(ions_at(spark, 1.0), ranges(spark, [(0, "a", 1.0, 2.0)]))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_clipping_new_ranges():
    assert ranging.clip_new_range(1.5, 4.0, [(1.0, 2.0)], 0.1) == (2.1, 4.0)
    with pytest.raises(ValueError):
        ranging.clip_new_range(0.5, 3.0, [(1.0, 2.0)], 0.1)


def test_decompose_round_trip(spark):
    rows = spark.createDataFrame([(1, [("Fe", 56), ("O", 16)]), (2, None)], "ionIdx long, ion array<struct<element:string,isotope:int>>")
    atoms = ranging.decompose(rows)
    assert atoms.count() == 3
    assert ranging.undecompose(atoms).orderBy("ionIdx").collect() == rows.orderBy("ionIdx").collect()


def test_composition_sums_to_one(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [(None,)], "ion string")
    out = {r.species: r for r in composition.composition(rows, "ion", 50, ["unranged"]).collect()}
    assert out["a"].concentration == pytest.approx(0.6) and out["unranged"].concentration == 0
    assert out["a"].variance == pytest.approx(0.6 * 0.4 / 3 * 0.5)


def test_bounded_bins(spark):
    rows = spark.createDataFrame([(0.0,), (0.99,), (2.0,), (2.4,), (-0.1,)], "x double").select(bins.bounded(F.col("x"), 0, 2.5, 1.0).alias("b")).collect()
    assert [r.b for r in rows] == [0, 0, 1, None, None]


def test_equal_count_and_prefix_sum_agree_with_one_sort(spark):
    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(100)], "i long, v double")
    out = ordered.prefix_sum(rows, F.col("v"), "i", 13).orderBy("i").collect()
    assert np.allclose([r.prefix for r in out], np.cumsum([i % 7 for i in range(100)]))
    slices = bins.equal_count(rows, 30, ["i"], F.floor(F.col("i") / 9)).groupBy("slice").count().orderBy("slice").collect()
    assert [r["count"] for r in slices] == [30, 30, 30, 10]


def test_equal_count_slices_of_tied_rows_follow_the_price(spark, tmp_path):
    """Two rows with the same date, order and line on both sides of a cut, in both orders of the file."""
    tied = [(499, 1, 10.0), (499, 1, 20.0)]
    found = []
    for name, pair in (("a", tied), ("b", tied[::-1])):
        rows = spark.createDataFrame([(k, 1, 1.0) for k in range(499)] + pair, "l_orderkey long, l_linenumber int, l_extendedprice double").coalesce(1)
        rows.withColumn("l_shipdate", F.lit("2000-01-01").cast("timestamp")).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        found.append([(r.n, r["mean"]) for r in catalog.equal_count_slices(spark, f"{tmp_path}/{name}").orderBy("slice").collect()])
    assert found[0] == found[1] == [(500, round((499 + 10) / 500, 4)), (1, 20.0)]


def test_filling_gaps(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (1.0, None), (3.0, 4.0)], "x double, v double")
    assert [r.v for r in ordered.fill_linear(rows, "v", "x").orderBy("x").collect()] == [1.0, 2.0, 4.0]


def gaussian():
    mc = np.arange(25, 30.005, 0.01)
    return mc, np.round(10 + 500 * np.exp(-((mc - 27) ** 2) / (2 * 0.15**2)))


@pytest.mark.parametrize("method", ["linear", "constant", "exponential"])
def test_peak_counts(method):
    mc, counts = gaussian()
    out = spectrum.peak_counts(mc, counts, (25.5, 26.5, 27.5, 28.5), method)
    true = 500 * 0.15 * math.sqrt(2 * math.pi) / 0.01
    assert abs(out["location"] - 27) < 0.1 and abs(out["corrected"] - true) < 0.1 * true
    assert 0 < out["background"] < out["raw"]


def test_find_peaks_and_equal_error_range():
    mc = np.arange(20, 40.005, 0.01)
    counts = np.round(5 + 300 * np.exp(-((mc - 25) ** 2) / 0.02) + 150 * np.exp(-((mc - 35) ** 2) / 0.02))
    peaks = spectrum.find_peaks(mc, counts)
    assert np.allclose(peaks.mc, [25, 35], atol=0.1) and peaks.height[0] > peaks.height[1]
    low, high = spectrum.equal_error_range(mc, counts, 25, np.full(len(mc), 5.0))
    assert 24.5 < low < 24.9 and 25.1 < high < 25.5


def test_isotopes_and_assignment():
    table = pd.DataFrame([("Cu", 63, 62.93, 0.69), ("Cu", 65, 64.93, 0.31)], columns=["element", "isotope", "weight", "abundance"])
    pair = spectrum.isotope_list([("Cu", None), ("Cu", None)], table)
    assert pair.abundance.sum() == pytest.approx(1) and len(pair) == 3
    peaks = pd.DataFrame({"mc": [62.93, 64.93], "area": [690.0, 310.0]})
    out = spectrum.assign(peaks, spectrum.complex_ions(["Cu"], 2, table), 0.05)
    assert set(out.ion) == {"Cu"} and set(out.charge) == {1} and out.score[0] > 0.99


def test_nnls_and_likelihood():
    a = np.array([[0.6, 0.0], [0.4, 0.7], [0.0, 0.3]])
    counts = a @ np.array([1000.0, 500.0])
    assert np.allclose(deconvolution.nnls(a, counts), [1000, 500])
    assert np.allclose(deconvolution.likelihood(a, counts), [1000, 500], rtol=1e-3)
    assert (deconvolution.nnls(a, np.array([100.0, 0.0, 0.0])) >= 0).all()


def test_deconvolution_by_component(spark):
    peaks = spark.createDataFrame([("a", 1.5, 0.6), ("a", 2.5, 0.4), ("b", 2.5, 0.7), ("b", 3.5, 0.3), ("c", 9.5, 1.0)], "ion string, mc double, abundance double")
    table = ranges(spark, [(0, "r0", 1.0, 2.0), (1, "r1", 2.1, 3.0), (2, "r2", 3.1, 4.0), (3, "r3", 9.0, 10.0)])
    fractions = deconvolution.overlap_components(deconvolution.fractions(peaks, table))
    counts = spark.createDataFrame([(0, 600), (1, 750), (2, 150), (3, 42)], "rangeIdx int, count long")
    out = {r.ion: r for r in deconvolution.deconvolve(fractions, counts).collect()}
    assert out["a"].amount == pytest.approx(1000, rel=1e-6) and out["c"].amount == pytest.approx(42)
    assert out["a"].component == out["b"].component != out["c"].component


def cloud(spark, n=120, seed=3):
    p = np.random.default_rng(seed).random((n, 3)) * 4
    return p, spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "ionIdx long, x double, y double, z double")


def test_neighbours_against_brute_force(spark):
    p, frame = cloud(spark)
    gap = np.sqrt(((p[:, None] - p) ** 2).sum(-1))
    pairs = {(r.ionIdx, r.other) for r in spatial.within(frame, frame, "ionIdx", ["x", "y", "z"], 0.8).collect()}
    assert pairs == {tuple(map(int, q)) for q in np.argwhere(gap <= 0.8)}
    np.fill_diagonal(gap, np.inf)
    near = spatial.nearest(frame, "ionIdx", ["x", "y", "z"], 2, 0.2)
    best = {(r.ionIdx, r.rank): r.other for r in near.collect()}
    assert best == {(i, k + 1): int(j) for i in range(len(p)) for k, j in enumerate(gap[i].argsort()[:2])}


def test_dbscan_finds_planted_clusters(spark):
    draw = np.random.default_rng(1)
    p = np.concatenate([draw.normal(c, 0.05, (30, 3)) for c in (0, 2)] + [np.array([[9.0, 9, 9]])])
    frame = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "ionIdx long, x double, y double, z double")
    out = {r.ionIdx: r.cluster for r in spatial.dbscan(frame, "ionIdx", ["x", "y", "z"], 0.2, 4).collect()}
    assert {out[i] for i in range(30)} == {1} and {out[i] for i in range(30, 60)} == {2} and out[60] == -1


def test_sphere_distance_and_areas(spark):
    v, f = mesh.icosphere(1.0, 3)
    faces = pd.DataFrame({"fid": range(len(f))} | {f"{n}{c}": v[f[:, k], i] for k, n in enumerate("abc") for i, c in enumerate("xyz")})
    p = np.random.default_rng(0).normal(size=(50, 3))
    p = p / np.linalg.norm(p, axis=1, keepdims=True) * 1.5
    points = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "ionIdx long, x double, y double, z double")
    out = mesh.point_to_mesh(points, faces).toPandas()
    assert np.allclose(out.distance, 0.5, atol=0.02) and (out.signed > 0).all()
    vertices, table = mesh_files.mesh_frames(spark, (v, f))
    assert mesh.vertex_areas(vertices, table).agg(F.sum("area")).first()[0] == pytest.approx(4 * math.pi, rel=0.01)
    normals = mesh.vertex_normals(vertices, table).join(vertices, "vid").toPandas()
    assert ((normals[["nx", "ny", "nz"]].to_numpy() * normals[["x", "y", "z"]].to_numpy()).sum(1) > 0.99).all()
    assert mesh.boundary_edges(table).count() == 0 and mesh.pieces(table).select("piece").distinct().count() == 1


def test_triangle_regions():
    a, b, c = (np.array([p], float) for p in ((0, 0, 0), (1, 0, 0), (0, 1, 0)))
    points = np.array([[1 / 3, 1 / 3, 1], [0.5, -1, 0], [-1, -1, 0], [2, -0.5, 0]])
    d, q, where = mesh.point_triangle(points, a, b, c)
    assert d[0, 0] == pytest.approx(1, abs=1e-10) and where[:, 0].tolist() == [0, 1, 4, 5]
    assert np.allclose(q[0, 0], [1 / 3, 1 / 3, 0])


def test_resampling_a_smooth_volume(spark):
    shape = (8, 9, 10)
    g = lambda i, j, k: np.sin(i / 3) * np.cos(j / 3) + np.sin(j / 3) * np.cos(k / 3) + np.sin(k / 3) * np.cos(i / 3)
    rows = [(i, j, k, float(g(i, j, k))) for i in range(8) for j in range(9) for k in range(10)]
    frame = spark.createDataFrame(rows, "i long, j long, k long, value double")
    same = volume.resample(frame, shape, (1, 1, 1)).toPandas()
    assert np.abs(same.value - g(same.i, same.j, same.k)).max() < 1e-10
    half = volume.resample(frame, (5, 5, 5), (1, 1, 1), (0.5, 0.5, 0.5)).toPandas()
    assert np.abs(half.value - g(half.i + 0.5, half.j + 0.5, half.k + 0.5)).max() < 0.1


def test_shank_recurrence_has_its_closed_form():
    steps = np.full(2000, 0.01)
    k = math.sin(math.radians(10)) / (1 - math.sin(math.radians(10)))
    r = [20.0]
    for s in steps:
        r.append(r[-1] + k * s / r[-1] ** 2)
    assert np.allclose(reconstruction.shank_radii(20.0, 10.0, steps), r[1:], rtol=1e-5)


def test_length_and_t0_are_recovered(spark):
    from iontide.functions import physics

    rows = spark.range(2000).select(F.col("id").alias("ionIdx"), (F.col("id") % 21 - 10.0).alias("detx"), (F.col("id") % 17 - 8.0).alias("dety"), (4000 + F.col("id")).cast("double").alias("VDC"), F.when(F.col("id") % 2 == 0, 27.0).otherwise(56.0).alias("mc"))
    tof = physics.mc_to_tof(F.col("mc"), F.col("VDC"), F.col("detx"), F.col("dety"), 110.0) + 12.5
    length, t0, r2 = calibration.length_and_t0(rows.withColumn("tof", tof), [(26, 28, 27.0), (55, 57, 56.0)], 110.0)
    assert length == pytest.approx(110, rel=1e-6) and t0 == pytest.approx(12.5, abs=1e-5) and r2 == pytest.approx(1)


def test_local_identities_follow_the_neighbourhood(spark):
    """Two ions share range 1; only the right half has range 0 ions, which mark ion a."""
    draw = np.random.default_rng(0)
    n = 400
    x = draw.random(n) * 2
    kind = draw.random(n)
    mc = np.where(x > 1, np.where(kind < 0.6, 1.5, 2.5), 2.5)
    rows = [(i, float(x[i]), float(draw.random()), float(draw.random()), float(mc[i])) for i in range(n)]
    pos = spark.createDataFrame(rows, "ionIdx long, x double, y double, z double, mc double")
    table = ranges(spark, [(0, "r0", 1.0, 2.0), (1, "r1", 2.1, 3.0)])
    fractions = spark.createDataFrame([("a", 0, 0.6), ("a", 1, 0.4), ("b", 1, 1.0)], "ion string, rangeIdx int, fraction double")
    out = {r.ionIdx: r.ion for r in deconvolution.local_identities(pos, table, fractions, 0.35, 1).collect()}
    left = [out[i] for i in range(n) if x[i] < 0.6]
    right = [out[i] for i in range(n) if x[i] > 1.4]
    assert len(out) == n and left.count("b") / len(left) > 0.95 and right.count("a") / len(right) > 0.85


def test_ranges_of_repeated_rows(spark):
    table = spark.createDataFrame([(0, "a", 1.0, 3.0), (1, "b", 2.0, 4.0)], "rangeIdx int, rangeName string, mcbegin double, mcend double")
    rows = spark.createDataFrame([(1, 2.5), (1, 2.5), (2, 1.5), (3, 9.0)], "ionIdx long, mc double")
    assert sorted((r.ionIdx, r.rangeName or "") for r in ranging.allocate(rows, table).collect()) == [(1, "b"), (1, "b"), (2, "a"), (3, "")]


def test_many_anchors_and_an_outlier(spark):
    import numpy as np

    draw = np.random.default_rng(5)
    anchors, places = draw.normal(size=(400, 3)), np.vstack((draw.normal(size=(60, 3)), [[500.0, 0, 0]]))
    frame = lambda p, key: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], f"{key} long, x double, y double, z double")
    found = spatial.nearest_anchor(frame(places, "ionIdx"), frame(anchors, "vid"), ["x", "y", "z"], "vid", "ionIdx").collect()
    gaps = np.linalg.norm(places[:, None] - anchors, axis=2)
    assert {r.ionIdx: r.closest for r in found} == dict(enumerate(gaps.argmin(1).tolist())) and len(found) == 61


def test_voltage_fit_uses_all_groups(spark):
    from pyspark.sql import functions as F

    rows = spark.range(6000).select(F.col("id").alias("ionIdx"), (3000 + F.col("id")).cast("double").alias("VDC"))
    rows = rows.withColumn("mc", 27 * (1 + 1e-5 * (F.col("VDC") - 6000)))
    a, b, c = calibration.voltage_factor(rows, (20.0, 40.0), 500)
    at = lambda v: a * v * v + b * v + c
    assert abs(at(3250) / at(8750) - (1 - 0.0275) / (1 + 0.0275)) < 1e-4


def test_a_mesh_in_parts(spark, monkeypatch):
    import pandas as pd

    v, f = mesh.icosphere(1.0, 1)
    faces = pd.DataFrame({"fid": range(len(f))} | {f"{n}{c}": v[f[:, k], i] for k, n in enumerate("abc") for i, c in enumerate("xyz")})
    rows = spark.createDataFrame([(i, 0.1 * i, 0.3, -0.2 * i) for i in range(20)], "ionIdx long, x double, y double, z double")
    whole = {r.ionIdx: (round(r.distance, 9), round(r.signed, 9)) for r in mesh.point_to_mesh(rows, faces).collect()}
    monkeypatch.setattr(mesh, "MESH_FACES", 30)
    assert {r.ionIdx: (round(r.distance, 9), round(r.signed, 9)) for r in mesh.point_to_mesh(rows, faces).collect()} == whole
