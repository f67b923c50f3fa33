import numpy as np
import pandas as pd
import pytest

from iontide.operators import tessellation as t


@pytest.mark.parametrize("d", [2, 3])
def test_delaunay_is_empty_inside_and_fills_the_hull(d):
    p = np.random.default_rng(d).random((60, d))
    simplices = t.delaunay(p)
    centre, radius = t.circumspheres(t.settled(p), simplices)
    gap = ((centre[:, None] - t.settled(p)) ** 2).sum(-1)
    assert (gap >= radius[:, None] - 1e-6).all()
    corners = np.array(np.meshgrid(*[[0.0, 1.0]] * d)).reshape(d, -1).T
    assert t.simplex_volumes(np.vstack((p, corners)), t.delaunay(np.vstack((p, corners)))).sum() == pytest.approx(1, rel=1e-3)


@pytest.mark.parametrize("d", [2, 3])
def test_cells_of_a_lattice_have_its_volume(d):
    p = np.array(np.meshgrid(*[np.arange(5.0)] * d)).reshape(d, -1).T
    volume = t.cell_volumes(p)
    inner = ((p > 0) & (p < 4)).all(1)
    assert np.allclose(volume[inner], 1, atol=1e-3) and np.isnan(volume[~inner]).all()


def test_alpha_shape_of_a_ring():
    a = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    ring = np.concatenate([r * np.stack((np.cos(a), np.sin(a)), 1) for r in (1.0, 1.1)])
    assert t.alpha_shape(ring, 0.12)[2] == pytest.approx(np.pi * (1.21 - 1), rel=0.02)


def test_blocks_agree_with_the_whole(spark):
    p = np.random.default_rng(5).random((250, 3)) * 6
    frame = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "ionIdx long, x double, y double, z double")
    volumes, edges = t.tessellate(frame, "ionIdx", ["x", "y", "z"], 3.0, 2.9)
    found, true = {r.ionIdx: r.volume for r in volumes.collect()}, t.cell_volumes(p)
    inner = [i for i in range(250) if (np.abs(p[i] - 3) < 1.2).all()]
    assert inner and all(found[i] == pytest.approx(true[i], rel=1e-3) for i in inner)
    assert edges.count() > 700


def test_clusters_of_small_cells(spark):
    draw = np.random.default_rng(1)
    p = np.vstack((draw.random((150, 3)) * 6, 3 + draw.normal(0, 0.15, (40, 3))))
    frame = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "ionIdx long, x double, y double, z double")
    random = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(draw.random((190, 3)) * 6)], frame.schema)
    whole = lambda f: t.tessellate(f, "ionIdx", ["x", "y", "z"], 100.0, 1.0)
    (volumes, edges), (other, _) = whole(frame), whole(random)
    cutoff, gap = t.volume_cutoff(volumes, other, 0.05)
    assert gap > t.significance_limit(190)
    rows = t.voronoi_clusters(volumes, edges, "ionIdx", cutoff, 10).collect()
    assert len({r.cluster for r in rows}) == 1 and sum(r.ionIdx >= 150 for r in rows) > 25


def test_noise_filter():
    p = np.random.default_rng(0).random((80, 2))
    kept = t.noise_filter(pd.DataFrame(p, columns=["x", "y"]))
    assert 40 < kept.sum() < 80
