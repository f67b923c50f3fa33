import numpy as np
import pytest

from iontide.functions import plane


def test_hull_area_and_moments():
    p = np.vstack(([[0, 0], [2, 0], [2, 1], [0, 1]], np.random.default_rng(0).random((30, 2)) * [2, 1]))
    h = plane.hull(p)
    assert len(h) == 4 and plane.area(h) == pytest.approx(2) and np.allclose(plane.centroid(h), (1, 0.5))
    assert np.allclose(plane.second_moments(h), (2 * 4 / 12, 2 * 1 / 12, 0))


def test_clipping_and_crossings():
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    assert plane.area(plane.clip_to_box(square, (1, 1), (9, 3))) == pytest.approx(6)
    assert np.allclose(plane.crossings(np.array([[0.0, 0], [2, 2]]), np.array([[0.0, 2], [2, 0]])), [[1, 1]])


def test_lines():
    line = np.stack((np.linspace(0, 1, 101), np.zeros(101)), 1)
    assert len(plane.simplify(line, 1e-6)) == 2
    bent = np.array([[0.0, 0], [1, 0.01], [2, 0], [2, 2]])
    assert len(plane.simplify(bent, 0.1)) == 3
    assert np.allclose(plane.resampled(np.array([[0.0, 0], [2, 0], [2, 2]]), 5), [[0, 0], [1, 0], [2, 0], [2, 1], [2, 2]])


def test_curves():
    circle = np.stack((np.cos(np.linspace(0, 1, 40)), np.sin(np.linspace(0, 1, 40))), 1)
    c = plane.Curve.fit(circle, 6)
    assert c.length() == pytest.approx(1, abs=1e-3) and c.curvature(0.5) == pytest.approx(1, abs=1e-2)
    assert np.allclose(c(c.nearest(np.array([2 * np.cos(0.4), 2 * np.sin(0.4)]))), (np.cos(0.4), np.sin(0.4)), atol=1e-3)
