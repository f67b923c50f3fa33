import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from iontide.operators import profiles, quality
from iontide.plans import pipelines
from iontide.sources import instrument, range_files
from iontide.streaming import spectra


def made_up_ions(n=4000, seed=0):
    """Aluminium with a tenth of copper: known masses, small noise, a box of positions."""
    draw = np.random.default_rng(seed)
    kind = draw.random(n)
    mc = np.where(kind < 0.9, 27.0, np.where(kind < 0.969, 62.93, 64.93)) + draw.normal(0, 0.03, n)
    return pd.DataFrame({"ionIdx": np.arange(1, n + 1), **{c: draw.random(n) * 10 for c in "xyz"}, "mc": mc})


def test_files_to_composition(spark, tmp_path):
    frame = spark.createDataFrame(made_up_ions())
    instrument.write_records(frame, str(tmp_path / "a.pos"))
    instrument.write_records(frame.filter("ionIdx <= 1000"), str(tmp_path / "b.pos"))
    ranges = range_files.ranges_frame(spark, range_files.parse_rrng("Range1=26.5 27.5 Vol:0 Al:1 Color:000000\nRange2=62.5 65.5 Vol:0 Cu:1 Color:000000\n"))
    out = pipelines.compositions_of_files(spark, str(tmp_path / "*.pos"), "pos", ranges).toPandas()
    assert len(out) == 4 and np.allclose(out.groupby("file").concentration.sum(), 1)
    assert np.allclose(out[out.species == "Al"].concentration, 0.9, atol=0.03)


def test_automatic_analysis(spark):
    isotopes = pd.DataFrame([("Al", 27, 27.0, 1.0), ("Cu", 63, 62.93, 0.69), ("Cu", 65, 64.93, 0.31)], columns=["element", "isotope", "weight", "abundance"])
    from iontide.operators import spectrum

    table, out = pipelines.automatic(spark.createDataFrame(made_up_ions()), spectrum.complex_ions(["Al", "Cu"], 1, isotopes, [1]), 0.02)
    assert set(table.ion) == {"Al", "Cu"}
    assert {r.species: r.concentration for r in out.collect()}["Al"] == pytest.approx(0.9, abs=0.03)


def test_batches_record_errors(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.pos").write_bytes(b"\0" * (16 * k or 3))

    def analysis(path, content):
        if len(content) < 16:
            raise ValueError("short")
        return pd.DataFrame({"n": [len(content) // 16]})

    rows = pipelines.each_file(spark, [str(tmp_path)], analysis, "n long").orderBy("file").collect()
    assert [(r.n, r.error) for r in rows] == [(None, "ValueError: short"), (1, None), (2, None)]


def test_profile_and_quality(spark):
    frame = spark.createDataFrame(made_up_ions()).withColumn("ion", F.when(F.col("mc") < 30, "Al").otherwise("Cu"))
    rows = pipelines.concentration_profile(frame, F.col("z"), 2.0).toPandas()
    assert np.allclose(rows.groupby("bin_distance").share.sum(), 1) and len(rows) == 10
    row = quality.density(frame, width=2.0).first()
    assert row.density == pytest.approx(4.0, rel=0.01) and 0 < row.variation < 0.5
    near = quality.overlap(frame.limit(300), "ionIdx", ["x", "y", "z"], 0.2).first()
    assert near.sampled == 300 and 0 <= near.overlapping < 0.2
    assert quality.rate(85) == "excellent" and quality.rate(10) == "poor"


def test_policies_and_tracers(spark):
    saved = spark.createDataFrame([("Al", 1), ("Fe", 2)], "ion string, size int")
    present = spark.createDataFrame([("Al",), ("Cu",)], "ion string")
    assert {(r.ion, r.status) for r in profiles.resolve(saved, present, "ion").collect()} == {("Al", "matched"), ("Fe", "missing"), ("Cu", "new")}
    assert profiles.resolve(saved, present, "ion", "intersection").count() == 1
    with pytest.raises(ValueError):
        profiles.resolve(saved, present, "ion", "strict")
    rows = profiles.tracer_abundances(spark.createDataFrame([("H", 99.0), ("H", 1.0), ("O", 0.5)], "element string, abundance double")).collect()
    assert sorted((r.element, round(r.abundance, 6)) for r in rows) == [("H", 0.01), ("H", 0.99), ("O", 1.0)]


def test_streams(spark, tmp_path):
    frame = spark.createDataFrame(made_up_ions(500)).withColumn("ts", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,ionIdx)"))
    frame.write.parquet(str(tmp_path / "hits.parquet"))
    out = spectra.drained_spectrum(spark, str(tmp_path / "hits.parquet"), "mc", 1.0)
    assert out.agg(F.sum("counts")).first()[0] == 500
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "hits.parquet"))
    for name, made in (("w", spectra.rate_windows(stream, "ts", "mc", 26, 28, "1 minute", "30 seconds", "1 minute")), ("b", spectra.bursts(stream.withColumn("k", F.lit(1)), "ts", "k", "5 seconds", "1 minute"))):
        q = made.writeStream.outputMode("append").format("memory").queryName(f"t_{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("t_w").filter("ions = 60").count() >= 5
