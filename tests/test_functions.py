import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from iontide.config import Settings, preset
from iontide.functions import crystal, geometry, ions, physics, stats


def test_ion_grammar():
    assert ions.parse("56Fe2 16O3 ++") == ([("Fe", 56), ("Fe", 56), ("O", 16), ("O", 16), ("O", 16)], 2)
    assert ions.parse("AlO +")[0] == [("Al", None), ("O", None)]
    assert ions.compose(*ions.parse("16O3 56Fe2 ++")) == "56Fe2 16O3 ++"
    with pytest.raises(ValueError):
        ions.parse("Xx9")


@given(st.lists(st.tuples(st.sampled_from(["Al", "Fe", "O", "H"]), st.sampled_from([None, 16, 56])), min_size=1, max_size=6), st.integers(0, 3))
def test_ion_names_round_trip(atoms, charge):
    name = ions.compose(atoms, charge)
    assert ions.parse(name) == (ions.canonical(atoms), charge)


def test_names_as_columns(spark):
    row = spark.createDataFrame([("56Fe2 16O ++",)], "n string").select(
        ions.reduce_name(F.col("n"), "ionic").alias("ionic"), ions.reduce_name(F.col("n"), "atomic").alias("atomic"), ions.charge_of(F.col("n")).alias("c"), ions.atoms_of(F.col("n")).alias("a")
    ).first()
    assert (row.ionic, row.atomic, row.c) == ("Fe2 O", "Fe O", 2)
    assert [(a.element, a.isotope) for a in row.a] == [("Fe", 56), ("Fe", 56), ("O", 16)]


def test_elements_in_text():
    assert ions.elements_in("steel with Fe, C and 2 wt. Cr; Feat") == ["Fe", "C", "Cr"]


def test_flight_round_trip(spark):
    row = spark.createDataFrame([(500.0, 5000.0, 3.0, -4.0)], "tof double, v double, x double, y double")
    mc = physics.tof_to_mc(F.col("tof"), F.col("v"), F.col("x"), F.col("y"), 110.0)
    back = row.withColumn("mc", mc).select(physics.mc_to_tof(F.col("mc"), F.col("v"), F.col("x"), F.col("y"), 110.0)).first()[0]
    assert back == pytest.approx(500, abs=1e-9)


def test_rotation_about_axes(spark):
    turned = spark.range(1).select(*physics.rotate(F.lit(1.0), F.lit(0.0), F.lit(0.0), (0, 0, 1), math.pi / 2)).first()
    assert np.allclose(turned, (0, 1, 0), atol=1e-12)


def test_distributions():
    assert stats.beta_cdf(0.3, 2, 5) == pytest.approx(1 - sum(math.comb(6, k) * 0.3**k * 0.7 ** (6 - k) for k in range(2)), abs=1e-12)
    assert stats.chi2_cdf(3.841458820694124, 1) == pytest.approx(0.95, abs=1e-9)
    low, high = stats.clopper_pearson(0, 10)
    assert low == 0 and high == pytest.approx(1 - 0.025 ** (1 / 10), abs=1e-9)


def test_hull_and_plane_figures(spark):
    cube = np.array([[x, y, z] for x in (0, 1) for y in (0, 1) for z in (0, 1)], float)
    assert len(geometry.hull_planes(cube)) == 6
    square = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))))
    row = spark.range(1).select(
        geometry.in_hull(F.lit(0.5), F.lit(0.5), F.lit(1.0), cube).alias("on"), geometry.in_hull(F.lit(0.5), F.lit(0.5), F.lit(1.1), cube).alias("out"),
        geometry.polygon_area(square).alias("area"), geometry.polygon_perimeter(square).alias("perimeter"), geometry.polygon_centroid(square).alias("c"),
        geometry.edge_distance(F.lit(3.0), F.lit(1.0), (0, 0, 2, 0)).alias("edge"), geometry.line_distance(F.lit(3.0), F.lit(1.0), (0, 0, 2, 0)).alias("line"),
        geometry.circle_through((F.lit(1.0), F.lit(0.0)), (F.lit(0.0), F.lit(1.0)), (F.lit(-1.0), F.lit(0.0))).alias("circle"),
        geometry.horner(F.lit(2.0), [1, 0, -1]).alias("p"),
    ).first()
    assert row.on and not row.out and row.area == 4 and row.perimeter == 8 and tuple(row.c) == (1, 1)
    assert row.edge == pytest.approx(math.sqrt(2)) and row.line == 1 and row.p == 3
    assert np.allclose(tuple(row.circle), (0, 0, 1))


def test_orientations():
    m = crystal.from_euler(0.4, 0.7, 1.1)
    assert np.allclose(crystal.to_euler(m), (0.4, 0.7, 1.1))
    assert np.allclose(crystal.from_quaternion(crystal.to_quaternion(m)), m)
    assert len(crystal.cubic_symmetries()) == 24
    assert crystal.misorientation(m, crystal.cubic_symmetries()[7] @ m)[0] == pytest.approx(0, abs=1e-5)
    turn = crystal.from_quaternion([math.cos(math.pi / 6), *(math.sin(math.pi / 6) / math.sqrt(3) * np.ones(3))])
    angle, axis = crystal.misorientation(np.eye(3), turn)
    assert angle == pytest.approx(60, abs=1e-6)
    assert crystal.coincidence(angle, axis, pd.DataFrame([(3, 60.0, 1, 1, 1)], columns=["sigma", "angle", "h", "k", "l"])) == 3


def test_settings_round_trip():
    s = preset("Al")
    assert Settings.from_json(s.to_json()) == s == Settings.from_yaml(s.to_yaml())
    with pytest.raises(ValueError):
        Settings.from_dict({"instrument": {"nothing": 1}})
