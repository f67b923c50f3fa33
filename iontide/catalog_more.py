"""More queries over the test tables: files and back, spectra, species tables, meshes, volumes, crystals.

Registered like those of ``catalog``, which imports this module."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from iontide.catalog import ANCHOR_SQL, ANCHORS, HITS, LAPPED, POINTS, PRICES, RANGES, RAW, _signed, hits, named, points, prices, query, range_sql, ranges, raw, table
from iontide.functions import crystal, geometry, ions, physics
from iontide.operators import bins, calibration, composition, mesh, ordered, profiles, quality, ranging, reconstruction, spatial, spectrum, volume
from iontide.sources import instrument, mesh_files, range_files, staged, text_files
from iontide.sources.ranges import local
from iontide.storage import shared_folder


def folder(spark, name: str) -> str:
    """A new folder that driver and executors share."""
    import os

    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if path.startswith("file:") or "://" not in path:
        os.makedirs(local(path), exist_ok=True)
    return path


def text_file(spark, name: str, content: str | bytes) -> str:
    path = f"{folder(spark, 'file')}/{name}"
    with open(local(path), "wb") as out:
        out.write(content.encode() if isinstance(content, str) else content)
    return path


def rounded(frame, digits: int, *names: str):
    return frame.withColumns({n: F.round(n, digits) for n in names})


# Files: written, read by byte ranges or lines, and compared


@query(f"""SELECT row_number() OVER (ORDER BY vec_id) AS "ionIdx", round(x::FLOAT::DOUBLE, 4) AS x, round(y::FLOAT::DOUBLE, 4) AS y, round(z::FLOAT::DOUBLE, 4) AS z, label::DOUBLE AS mc FROM {POINTS}""")
def pos_file(spark, sf_dir):
    path = f"{folder(spark, 'pos')}/a.pos"
    instrument.write_records(points(spark, sf_dir).select(F.col("vec_id").alias("ionIdx"), "x", "y", "z", F.col("label").cast("double").alias("mc")), path)
    return rounded(instrument.load(spark, path), 4, "x", "y", "z").select("ionIdx", "x", "y", "z", "mc")


@query(f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY "ionIdx") AS i FROM {RAW})
SELECT i // 100 AS block, count(*) AS n, round(avg(tof::FLOAT::DOUBLE), 3) AS tof, round(avg("VDC"::FLOAT::DOUBLE), 3) AS "VDC", sum(i % 7)::BIGINT AS pulses, sum(i % 3)::BIGINT AS multi FROM r GROUP BY 1""")
def epos_file(spark, sf_dir):
    path = f"{folder(spark, 'epos')}/a.epos"
    rows = instrument.renumbered(raw(spark, sf_dir))
    zeros = {c: F.lit(0.0) for c in ("x", "y", "z", "mc", "VP")}
    instrument.write_records(rows.withColumns(zeros | {"deltaP": F.col("ionIdx") % 7, "multi": F.col("ionIdx") % 3}), path, "epos")
    back = instrument.load(spark, path).groupBy(F.floor(F.col("ionIdx") / 100).alias("block"))
    return rounded(back.agg(F.count(F.lit(1)).alias("n"), F.avg("tof").alias("tof"), F.avg("VDC").alias("VDC"), F.sum("deltaP").alias("pulses"), F.sum("multi").alias("multi")), 3, "tof", "VDC")


def listed(frame):
    return frame.select("rangeIdx", "rangeName", F.round("mcbegin", 4).alias("mcbegin"), F.round("mcend", 4).alias("mcend"), F.size("ion").alias("atoms"), F.round(F.col("color")[0] * 256).cast("int").alias("red"))


RRNG = "[Ions]\nNumber=2\nIon1=Al\nIon2=O\n[Ranges]\nNumber=3\nRange1=42.9 43.1 Vol:0.04 Al:1 O:1 Color:0A0001\nRange2=26,9 27,1 Vol:0,016 Al:1 Color:33FF0A\nRange3=13.4 13.6 Vol:0.02 Al:2 Color:FF00CC\n"


@query("SELECT * FROM (VALUES (0, 'Al2', 13.4, 13.6, 2, 255), (1, 'Al', 26.9, 27.1, 1, 51), (2, 'Al O', 42.9, 43.1, 2, 10)) AS r(\"rangeIdx\", \"rangeName\", mcbegin, mcend, atoms, red)")
def rrng_file(spark, sf_dir):
    first = range_files.read_ranges(spark, text_file(spark, "a.rrng", RRNG))
    again = range_files.format_rrng([r.asDict(True) for r in first.orderBy("rangeIdx").collect()])
    return listed(range_files.read_ranges(spark, text_file(spark, "b.rrng", again)))


@query("SELECT * FROM (VALUES (0, 'Al', 26.9, 27.1, 1, 256), (1, 'Al O', 42.9, 43.1, 2, 256)) AS r(\"rangeIdx\", \"rangeName\", mcbegin, mcend, atoms, red)")
def rng_file(spark, sf_dir):
    return listed(range_files.read_ranges(spark, text_file(spark, "a.rng", "2 2\nAl\nAl 1.0 0.0 0.0\nO\nO 0.0 0.0 1.0\n------------------- Al O\n. 26.9 27.1 1 0\n. 42.9 43.1 1 1\n")))


@query("SELECT * FROM (VALUES (0, '27Al', 26.9, 27.1, 1, 0), (1, '27Al 16O2', 58.9, 59.2, 3, 0)) AS r(\"rangeIdx\", \"rangeName\", mcbegin, mcend, atoms, red)")
def xrng_file(spark, sf_dir):
    text = '<ranges note="a & b"><range mcbegin="58.9" mcend="59.2" ion="16O2 27Al" chargestate="1"/><range mcbegin="26.9" mcend="27.1" ion="27Al" chargestate="1"/></ranges>'
    return listed(range_files.read_ranges(spark, text_file(spark, "a.xrng", text)))


@query("SELECT 'A' || n_regionkey AS atom, n_nationkey::DOUBLE AS x, n_nationkey / 2.0 AS y, -n_regionkey::DOUBLE AS z FROM nation")
def xyz_file(spark, sf_dir):
    path = f"{folder(spark, 'xyz')}/rows"
    key, group = F.col("n_nationkey"), F.col("n_regionkey")
    table(spark, sf_dir, "nation").select(F.concat_ws("  ", F.concat(F.lit("A"), group.cast("string")), key.cast("string"), (key / 2).cast("string"), (-group).cast("string"))).write.text(path)
    return text_files.read_xyz(spark, path)


@query("""SELECT '/nation/' || n_nationkey AS path, 'float64' AS format, (n_regionkey / 4.0)::VARCHAR AS value, 'K' AS unit, n_regionkey / 4.0 AS number FROM nation
UNION ALL SELECT '/name/' || n_nationkey, 'string', n_name, NULL, NULL FROM nation""")
def metadata_file(spark, sf_dir):
    path, key = f"{folder(spark, 'metadata')}/rows", F.col("n_nationkey").cast("string")
    lines = F.array(F.concat(F.lit("/nation/"), key, F.lit(" [float64] = "), (F.col("n_regionkey") / 4.0).cast("string"), F.lit(" [K] % low")), F.concat(F.lit("/name/"), key, F.lit(" [string] = "), F.col("n_name")), F.lit("% a comment"))
    table(spark, sf_dir, "nation").select(F.explode(lines)).write.text(path)
    return text_files.typed(text_files.read_metadata(spark, path)).select("path", "format", "value", "unit", "number")


@query("""SELECT n_name AS file, r_name AS region, CASE WHEN n_nationkey % 2 = 0 THEN 'yes' END AS even FROM nation JOIN region ON n_regionkey = r_regionkey""")
def metadata_search(spark, sf_dir):
    return text_files.search(_nation_metadata(spark, sf_dir), "file", ["region", "even"])


def _nation_metadata(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return nation.select(F.col("n_name").alias("file"), F.lit("region").alias("path"), F.col("r_name").alias("value")).unionByName(nation.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("file"), F.lit("even").alias("path"), F.lit("yes").alias("value")))


@query("SELECT n_name AS file FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region)")
def files_by_attribute(spark, sf_dir):
    least = table(spark, sf_dir, "region").agg(F.min("r_name")).first()[0]
    return text_files.find_by_attribute(_nation_metadata(spark, sf_dir), "file", "region", least)


@query("""SELECT n_nationkey % 3 AS log, make_timestamp(2024, 1 + n_regionkey, 1 + n_nationkey, 13, n_nationkey, 5.0) AS timestamp, (n_nationkey / 2.0)::VARCHAR AS pressure FROM nation""")
def sensor_logs(spark, sf_dir):
    """Three logs, each written whole by one task (two lines of heading, then its rows in order)."""
    path, key = f"{folder(spark, 'logs')}/all", F.col("n_nationkey")
    line = F.concat_ws(",", F.concat_ws("/", (F.col("n_regionkey") + 1).cast("string"), (key + 1).cast("string"), F.lit("2024")), F.format_string("1:%02d:05 PM", key), (key % 3).cast("string"), (key / 2).cast("string"))
    nation = table(spark, sf_dir, "nation").select((key % 3).alias("log"), key.cast("long").alias("n"), line.alias("value"))
    heads = nation.select("log").distinct().select("log", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("n"), F.lit(v).alias("value")) for k, v in ((-2, "Logger 5"), (-1, "Date,Time,log,pressure"))))).alias("h")).select("log", "h.*")
    nation.unionByName(heads).repartition(3, "log").sortWithinPartitions("log", "n").select("log", "value").write.partitionBy("log").text(path)
    rows = text_files.read_sensor(spark, path, ["Date", "Time", "log", "pressure"])
    return rows.select(F.col("log").cast("int").alias("log"), "timestamp", "pressure")


CUBE_POINTS = [(x, y, z) for x in (-1.0, 1.0) for y in (-1.0, 1.0) for z in (-1.0, 1.0)]
#: Two triangles for each side of the cube, counter-clockwise seen from outside.
CUBE_FACES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]
CUBE_SQL = "(VALUES " + ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(CUBE_FACES)) + ") AS f(fid, v0, v1, v2)"
CUBE_VERTICES_SQL = "(VALUES " + ", ".join(f"({i}, {x}, {y}, {z})" for i, (x, y, z) in enumerate(CUBE_POINTS)) + ") AS v(vid, x, y, z)"


def cube(spark):
    return mesh_files.mesh_frames(spark, (np.array(CUBE_POINTS), np.array(CUBE_FACES)))


@query("SELECT 'obj' AS kind, 8 AS vertices, 12 AS faces, 24.0::DOUBLE AS area UNION ALL SELECT 'stl', 8, 12, 24.0::DOUBLE")
def mesh_file_round_trips(spark, sf_dir):
    corners, faces = np.array(CUBE_POINTS), np.array(CUBE_FACES)
    found = {"obj": mesh_files.parse_obj(mesh_files.format_obj(corners, faces)), "stl": mesh_files.parse_stl(mesh_files.format_stl(corners, faces))}
    out = None
    for kind, m in found.items():
        v, f = mesh_files.mesh_frames(spark, m)
        row = mesh.face_areas(v, f).agg(F.lit(kind).alias("kind"), F.lit(len(m[0])).alias("vertices"), F.count(F.lit(1)).cast("int").alias("faces"), F.round(F.sum("area"), 9).alias("area"))
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT * FROM (VALUES ('Al', 0.0, 0.5, 0.25), ('O', 0.125, 0.0, 0.0)) AS s(atom, x, y, z)")
def cif_sites(spark, sf_dir):
    text = "data_x\n_cell_length_a 4.05(1)\n_cell_length_b 4.05\n_cell_length_c 4.05\nloop_\n_atom_site_label\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\nAl1 Al 0.0 0.5 0.25(3)\nO1 O 0.125 0.0 0.0\n"
    return spark.createDataFrame(mesh_files.parse_cif(text)["sites"], "atom string, x double, y double, z double")


@query(f"""SELECT 'pos' AS part, count(*) AS n, round(sum(mc), 2) AS total FROM {HITS} WHERE "ionIdx" BETWEEN 100 AND 400 UNION ALL SELECT 'ranges', 4, round(sum(mcbegin), 2) FROM {range_sql(LAPPED)} UNION ALL SELECT 'metadata', 3, 12.5 UNION ALL SELECT 'image', 6, 15""")
def staged_dataset(spark, sf_dir):
    path = folder(spark, "dataset")
    meta = staged.metadata_rows(spark, {"run": {"temperature": (12.5, "K"), "user": "nobody", "ok": True}})
    staged.save(path, hits(spark, sf_dir), ranges(spark, LAPPED), meta)
    staged.save_image(spark, path, "map", np.arange(6).reshape(2, 3))
    part = lambda name, frame, value: frame.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 2).alias("total"))
    pos = staged.load(spark, path).filter(F.col("ionIdx").between(100, 400))
    out = part("pos", pos, F.col("mc")).unionByName(part("ranges", staged.load(spark, path, "ranges"), F.col("mcbegin")))
    out = out.unionByName(part("metadata", staged.load(spark, path, "metadata", True), F.expr("try_cast(value as double)")))
    return out.unionByName(part("image", staged.image_pixels(spark, path), F.col("value")))


@query("""SELECT o_orderkey, n.n_name AS name FROM orders o LEFT JOIN nation n ON n.n_nationkey = substr(lpad(o.o_orderkey::VARCHAR, 9, '0'), 8, 2)::INTEGER""")
def metadata_enrichment(spark, sf_dir):
    """A two-digit number within a name leads to the metadata."""
    files = table(spark, sf_dir, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("file"))
    info = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return text_files.enrich(files, info, F.substring("file", 8, 2).cast("int")).drop("file")


# Spectra


@query(f"SELECT floor(mc / 0.5)::BIGINT AS bin, round(count(*) / (0.5 * (SELECT count(*) FROM lineitem)), 9) AS normalised FROM {PRICES} GROUP BY 1")
def normalised_spectrum(spark, sf_dir):
    pos = prices(spark, sf_dir)
    return rounded(bins.normalised(bins.histogram(pos, "mc", 0.5), 0.5, pos.count()), 9, "normalised").select("bin", "normalised")


@query(f"""WITH b AS (SELECT floor(mc / 0.5)::BIGINT AS bin, count(*) AS counts FROM {HITS} GROUP BY 1) SELECT s.bin, round((s.bin + 0.5) * 0.5, 9) AS mc, coalesce(b.counts, 0) AS counts FROM (SELECT unnest(range((SELECT min(bin) FROM b), (SELECT max(bin) FROM b) + 1)) AS bin) s LEFT JOIN b USING (bin)""")
def filled_spectrum(spark, sf_dir):
    return rounded(bins.filled(bins.histogram(hits(spark, sf_dir), "mc", 0.5), 0.5), 9, "mc")


@query(f"""WITH t AS (SELECT sqrt(mc * 1.66053906660e-27 * power(sqrt(100 + 225 + 12100) * 1e-3, 2) / (4000.0 * 2 * 1.602176634e-19)) * 1e9 AS tof FROM {PRICES}) SELECT floor(tof / 20)::BIGINT AS bin, count(*) AS n FROM t GROUP BY 1""")
def times_of_flight(spark, sf_dir):
    tof = physics.mc_to_tof(F.col("mc"), F.lit(4000.0), F.lit(10.0), F.lit(15.0), 110.0)
    return prices(spark, sf_dir).groupBy(F.floor(tof / 20).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH m AS (SELECT ("VDC" + 0.7 * 500) * 1.015 * (2 * 1.602176634e-19 / 1.66053906660e-27) * power(tof * 1e-9 / (sqrt(detx*detx + dety*dety + 12100) * 1e-3), 2) AS mc FROM {RAW}) SELECT floor(mc / 10)::BIGINT AS bin, count(*) AS n FROM m GROUP BY 1""")
def mass_to_charge_by_voltage(spark, sf_dir):
    mc = physics.tof_to_mc(F.col("tof"), F.col("VDC"), F.col("detx"), F.col("dety"), 110.0, vp=F.lit(500.0), mode="voltage")
    return raw(spark, sf_dir).groupBy(F.floor(mc / 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH b AS (SELECT floor(mc / 0.5)::BIGINT AS bin, count(*) AS counts FROM {PRICES} GROUP BY 1), h AS (SELECT s.bin, (s.bin + 0.5) * 0.5 AS mc, coalesce(b.counts, 0) AS counts FROM (SELECT unnest(range((SELECT min(bin) FROM b), (SELECT max(bin) FROM b) + 1)) AS bin) s LEFT JOIN b USING (bin)),
m AS (SELECT r."rangeName", h.mc, h.counts, h.mc BETWEEN r.mcbegin AND r.mcend AS inside FROM h JOIN {range_sql(RANGES)} ON h.mc BETWEEN r.mcbegin - 3 AND r.mcend + 3),
s AS (SELECT "rangeName", coalesce(sum(counts) FILTER (WHERE inside), 0)::BIGINT AS raw, count(*) FILTER (WHERE inside) AS n, sum(mc) FILTER (WHERE inside) AS mc, regr_slope(counts, mc) FILTER (WHERE NOT inside) AS a, regr_intercept(counts, mc) FILTER (WHERE NOT inside) AS b FROM m GROUP BY 1),
c AS (SELECT "rangeName", raw, a * mc + b * n AS background, raw - (a * mc + b * n) AS corrected FROM s)
SELECT "rangeName", raw, round(background, 4) AS background, round(corrected, 4) AS corrected, round(corrected / (SELECT count(*) FROM lineitem) * 1e6, 2) AS ppm, round(corrected / sum(corrected) OVER (), 6) AS share FROM c""")
def corrected_counts(spark, sf_dir):
    pos = prices(spark, sf_dir)
    h = bins.filled(bins.histogram(pos, "mc", 0.5), 0.5)
    out = spectrum.range_counts_corrected(h, ranges(spark, RANGES), 3.0, pos.count())
    return rounded(rounded(rounded(out, 4, "background", "corrected"), 2, "ppm"), 6, "share")


@query(f"""WITH b AS (SELECT floor(mc / 0.5)::BIGINT AS bin, count(*) AS counts FROM {HITS} GROUP BY 1), h AS (SELECT (bin + 0.5) * 0.5 AS mc, counts FROM b), m AS (SELECT r."rangeName", h.* FROM h JOIN {range_sql(RANGES)} ON h.mc BETWEEN r.mcbegin AND r.mcend),
t AS (SELECT "rangeName", max(counts) AS height FROM m GROUP BY 1), p AS (SELECT t."rangeName", t.height, min(m.mc) AS place FROM t JOIN m ON m."rangeName" = t."rangeName" AND m.counts = t.height GROUP BY ALL),
w AS (SELECT p.*, max(m.mc) FILTER (WHERE m.mc < place) AS l, min(m.mc) FILTER (WHERE m.mc > place) AS r FROM p JOIN m ON m."rangeName" = p."rangeName" AND m.counts * 2 < p.height GROUP BY ALL)
SELECT "rangeName", place, height, round(r - l, 9) AS fwhm, round(place / (r - l), 6) AS resolution FROM w""")
def mass_resolution(spark, sf_dir):
    out = spectrum.resolution(bins.histogram(hits(spark, sf_dir), "mc", 0.5), ranges(spark, RANGES))
    return rounded(rounded(out, 9, "fwhm"), 6, "resolution")


@query("SELECT event_id, min(value) OVER (ORDER BY event_id) AS envelope FROM events")
def monotone_envelope(spark, sf_dir):
    return ordered.running_minimum(table(spark, sf_dir, "events"), "value", "event_id", 500).select("event_id", "envelope")


@query("""WITH b AS (SELECT floor(event_id / 200)::BIGINT AS block, count(*) FILTER (WHERE value BETWEEN 20 AND 60) / (count(*) * 40.0) AS rate FROM events GROUP BY 1) SELECT round(regr_slope(rate, block), 12) AS slope, round(regr_intercept(rate, block), 9) AS intercept, round(regr_r2(rate, block), 9) AS r2 FROM b""")
def background_trend(spark, sf_dir):
    blocks = ordered.background_blocks(table(spark, sf_dir, "events"), "value", "event_id", 20.0, 60.0, 200)
    return rounded(rounded(ordered.background_trend(blocks), 9, "intercept", "r2"), 12, "slope")


@query(f"""WITH h AS (SELECT sqrt(detx*detx + dety*dety + 12100) * 1e-3 / sqrt("VDC" * (2 * 1.602176634e-19) / (27.0 * 1.66053906660e-27)) * 1e9 AS x, tof AS y FROM {RAW}) SELECT round(110 * regr_slope(y, x), 6) AS length, round(regr_intercept(y, x), 6) AS t0, round(regr_r2(y, x), 9) AS r2 FROM h""")
def flight_length_fit(spark, sf_dir):
    rows = raw(spark, sf_dir).withColumn("mc", F.lit(27.0))
    found = calibration.length_and_t0(rows, [(26.0, 28.0, 27.0)], 110.0)
    return spark.createDataFrame([(round(found[0], 6), round(found[1], 6), round(found[2], 9))], "length double, t0 double, r2 double")


@query(f"""WITH r AS (SELECT "rangeIdx", count(DISTINCT p."ionIdx")::DOUBLE AS n FROM {range_sql(LAPPED)} JOIN {HITS} p ON p.mc BETWEEN r.mcbegin AND r.mcend GROUP BY 1),
n AS (SELECT max(n) FILTER (WHERE "rangeIdx" = 0) AS n0, max(n) FILTER (WHERE "rangeIdx" = 1) AS n1, max(n) FILTER (WHERE "rangeIdx" = 2) AS n2, max(n) FILTER (WHERE "rangeIdx" = 3) AS n3 FROM r),
s AS (SELECT *, 0.36 / n0 + 0.16 / n1 AS s11, 0.28 / n1 AS s12, 0.49 / n1 + 0.09 / n2 AS s22 FROM n), d AS (SELECT *, s11 * s22 - s12 * s12 AS det FROM s), x AS (SELECT *, (s22 - s12) / det AS a, (s11 - s12) / det AS b FROM d),
c AS (SELECT *, power(n0 - 0.6 * a, 2) / n0 + power(n1 - 0.4 * a - 0.7 * b, 2) / n1 + power(n2 - 0.3 * b, 2) / n2 AS chi2 FROM x)
SELECT 'a' AS ion, round(a, 4) AS amount, round(sqrt(s22 / det), 4) AS sigma, round(chi2, 4) AS chi2 FROM c UNION ALL SELECT 'b', round(b, 4), round(sqrt(s11 / det), 4), round(chi2, 4) FROM c UNION ALL SELECT 'c', round(n3, 4), round(sqrt(n3), 4), 0 FROM c""")
def overlap_solved(spark, sf_dir):
    from iontide import catalog

    return rounded(catalog.overlap_deconvolution(spark, sf_dir), 4, "amount", "sigma", "chi2").select("ion", "amount", "sigma", F.abs("chi2").alias("chi2"))


ISOTOPES = [("O", 16, 15.995, 0.9976), ("O", 18, 17.999, 0.0024), ("Fe", 54, 53.94, 0.06), ("Fe", 56, 55.935, 0.94)]
ISOTOPE_SQL = "(VALUES " + ", ".join(f"('{e}', {i}, {w}::DOUBLE, {a}::DOUBLE)" for e, i, w, a in ISOTOPES) + ") AS i(element, isotope, weight, abundance)"


def isotopes() -> pd.DataFrame:
    return pd.DataFrame(ISOTOPES, columns=["element", "isotope", "weight", "abundance"])


@query(f"""WITH c AS (SELECT a.weight + b.weight + o.weight AS weight, a.abundance * b.abundance * o.abundance AS abundance, list_sort([a.isotope, b.isotope])::VARCHAR || o.isotope AS k FROM {ISOTOPE_SQL.replace(' AS i(', ' AS a(')}, {ISOTOPE_SQL.replace(' AS i(', ' AS b(')}, {ISOTOPE_SQL.replace(' AS i(', ' AS o(')} WHERE a.element = 'Fe' AND b.element = 'Fe' AND o.element = 'O')
SELECT round(any_value(weight), 6) AS weight, round(sum(abundance), 9) AS abundance FROM c GROUP BY k""")
def isotope_pattern(spark, sf_dir):
    found = spectrum.isotope_list([("Fe", None), ("Fe", None), ("O", None)], isotopes())
    return rounded(rounded(spark.createDataFrame(found[["weight", "abundance"]]), 6, "weight"), 9, "abundance")


@query(f"""WITH e AS (SELECT element, 1 AS n FROM (VALUES ('Fe'), ('O')) AS e(element)), one AS (SELECT element AS ion, weight, abundance FROM {ISOTOPE_SQL}), two AS (SELECT a.element || ' ' || b.element AS ion, a.weight + b.weight AS weight, a.abundance * b.abundance AS abundance FROM {ISOTOPE_SQL.replace(' AS i(', ' AS a(')} JOIN {ISOTOPE_SQL.replace(' AS i(', ' AS b(')} ON a.element <= b.element),
a AS (SELECT * FROM one UNION ALL SELECT * FROM two) SELECT ion, c AS charge, round(weight / c, 6) AS mc, round(sum(abundance), 9) AS abundance FROM a, (VALUES (1), (2)) AS c(c) GROUP BY ion, c, round(weight, 9), round(weight / c, 6)""")
def complex_ions(spark, sf_dir):
    found = spectrum.complex_ions(["O", "Fe"], 2, isotopes())[["ion", "charge", "mc", "abundance"]]
    frame = rounded(spark.createDataFrame(found), 6, "mc")
    return rounded(frame.groupBy("ion", F.col("charge").cast("int").alias("charge"), "mc").agg(F.sum("abundance").alias("abundance")), 9, "abundance")


@query(f"""WITH s AS (SELECT s_suppkey, s_acctbal AS w, 1 + s_nationkey AS a FROM supplier), l AS (SELECT *, CASE WHEN w - lag(w) OVER (ORDER BY w, a) > 8 THEN 1 ELSE 0 END AS f FROM s), g AS (SELECT *, sum(f) OVER (ORDER BY w, a ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT round(sum(w * a) / sum(a), 6) AS weight, sum(a)::DOUBLE AS abundance FROM g GROUP BY g""")
def merged_peaks(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_acctbal", (F.col("s_nationkey") + 1).alias("a")).orderBy("s_acctbal", "a").toPandas()
    return rounded(spark.createDataFrame(spectrum.merge_peaks(rows["s_acctbal"].to_numpy(), rows["a"].to_numpy(float), 8.0)), 6, "weight")


@query("SELECT * FROM (VALUES (27.9675, 100.0, 56), (26.97, round(0.06 / 0.94 * 100, 6), 54)) AS s(mc, height, isotope)")
def isotope_stems(spark, sf_dir):
    found = profiles.stems("Fe ++", isotopes(), 100.0)
    return spark.createDataFrame([(round(r.mc, 6), round(r.height, 6), int(r.isotopes[0][1])) for r in found.itertuples()], "mc double, height double, isotope int")


# Species tables


@query(f"""WITH a AS (SELECT 'Fe' AS atom, CASE WHEN p_size % 2 = 0 THEN 56 END AS isotope FROM part) SELECT isotope, count(*) AS n, round(avg(CASE WHEN isotope = 56 THEN 55.935 ELSE (53.94 * 0.06 + 55.935 * 0.94) END), 6) AS weight FROM a GROUP BY 1""")
def atomic_weights(spark, sf_dir):
    atoms = table(spark, sf_dir, "part").select(F.lit("Fe").alias("atom"), F.when(F.col("p_size") % 2 == 0, 56).alias("isotope"))
    found = composition.with_weights(atoms, spark.createDataFrame(isotopes()).withColumn("isotope", F.col("isotope").cast("int")))
    return rounded(found.groupBy("isotope").agg(F.count(F.lit(1)).alias("n"), F.avg("weight").alias("weight")), 6, "weight")


ELEMENT_SQL = "[" + ", ".join(f"'{e}'" for e in ions.ELEMENTS) + "]"


@query(f"SELECT p_size AS number, ({ELEMENT_SQL})[p_size] AS symbol, count(*) AS n FROM part GROUP BY ALL")
def atomic_numbers(spark, sf_dir):
    """Symbols from numbers, and numbers back from the symbols."""
    symbol = F.element_at(F.array(*(F.lit(e) for e in ions.ELEMENTS)), F.col("p_size"))
    rows = table(spark, sf_dir, "part").select(symbol.alias("symbol"))
    return rows.groupBy(ions.sort_key(F.col("symbol")).alias("number"), "symbol").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT l_returnflag AS element, c.charge, count(*) FILTER (WHERE l_linestatus = CASE c.charge WHEN 1 THEN 'O' ELSE 'F' END)::DOUBLE / count(*) AS ratio FROM lineitem, (VALUES (1), (2)) AS c(charge) GROUP BY ALL)
SELECT element, charge, round(k.a * (1 - k.b / (power(ratio, 0.3) + k.b + 0.256)), 9) AS field FROM s JOIN (VALUES ('N', 1, 33.0, 0.5), ('N', 2, 35.0, 0.4), ('A', 2, 19.0, 0.6)) AS k(element, charge, a, b) USING (element, charge)""")
def fields_of_species(spark, sf_dir):
    shares = composition.charge_state_ratio(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"])
    ratios = shares.select(F.col("l_returnflag").alias("element"), F.explode(F.array(F.struct(F.lit(1).alias("charge"), F.col("ratio_O").alias("ratio")), F.struct(F.lit(2).alias("charge"), F.col("ratio_F").alias("ratio")))).alias("s")).select("element", "s.*")
    constants = spark.createDataFrame([("N", 1, 33.0, 0.5), ("N", 2, 35.0, 0.4), ("A", 2, 19.0, 0.6)], "element string, charge int, a double, b double")
    return rounded(composition.field_by_species(ratios, constants), 9, "field")


@query("""WITH t AS (SELECT *, sum(p_retailprice) OVER (PARTITION BY p_brand) AS total FROM part) SELECT p_partkey, p_brand AS element, round(p_retailprice / total, 12) AS abundance FROM t""")
def tracer_shares(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("element"), F.col("p_retailprice").alias("abundance"))
    return rounded(profiles.tracer_abundances(rows), 12, "abundance")


@query(f"""SELECT "rangeIdx", mcbegin, coalesce(lead(mcbegin) OVER (ORDER BY mcbegin) - 0.5, mcend) AS mcend FROM {range_sql(RANGES)}""")
def extended_ranges(spark, sf_dir):
    return profiles.extend_to_neighbour(ranges(spark, RANGES), gap=0.5).select("rangeIdx", "mcbegin", "mcend")


@query("""SELECT coalesce(s.k, p.k) AS species, CASE WHEN s.k IS NULL THEN 'new' WHEN p.k IS NULL THEN 'missing' ELSE 'matched' END AS status FROM (SELECT DISTINCT p_size AS k FROM part WHERE p_size < 40) s FULL JOIN (SELECT DISTINCT l_quantity::INTEGER AS k FROM lineitem WHERE l_quantity > 10) p ON s.k = p.k""")
def resolved_species(spark, sf_dir):
    saved = table(spark, sf_dir, "part").filter("p_size < 40").select(F.col("p_size").alias("species")).distinct()
    present = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").select(F.col("l_quantity").cast("int").alias("species"))
    return profiles.resolve(saved, present, "species")


@query("""SELECT o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS quarter, round(percent_rank() OVER w, 9) AS percent_rank, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS number FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus)""")
def rankings(spark, sf_dir):
    w, total = Window.partitionBy("o_custkey").orderBy("o_orderstatus"), Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"), F.ntile(4).over(total).alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("percent_rank"), F.row_number().over(total).alias("number"))


@query("""WITH n AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 > 0 THEN n_regionkey END AS r FROM nation) SELECT n_nationkey, row_number() OVER (ORDER BY r ASC NULLS LAST, n_nationkey DESC) AS last, row_number() OVER (ORDER BY r DESC NULLS FIRST, n_nationkey) AS first FROM n""")
def sorted_with_missing(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 > 0, F.col("n_regionkey")).alias("r"))
    place = lambda *order: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return rows.select("n_nationkey", place(F.asc_nulls_last("r"), F.desc("n_nationkey")).alias("last"), place(F.desc_nulls_first("r"), "n_nationkey").alias("first"))


@query(f"""SELECT "ionIdx", name FROM (SELECT p_partkey AS "ionIdx", 'first' AS name FROM part ORDER BY p_partkey LIMIT 100) UNION ALL SELECT s_suppkey, NULL FROM supplier""")
def stacked_tables(spark, sf_dir):
    """The first 100 rows of one list above all of another that lacks a column."""
    first = table(spark, sf_dir, "part").orderBy("p_partkey").limit(100).select(F.col("p_partkey").alias("ionIdx"), F.lit("first").alias("name"))
    return first.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ionIdx")), allowMissingColumns=True)


DRAW = "('0x' || substr(md5(\"ionIdx\"::VARCHAR || '|{seed}'), 1, 8))::UBIGINT / 4294967296.0"


@query(f"""SELECT "ionIdx", mc FROM {HITS} ORDER BY {DRAW.format(seed=3)}, "ionIdx" LIMIT 200""")
def sampled_ions(spark, sf_dir):
    return composition.sample(hits(spark, sf_dir), 200, "ionIdx", 3)


@query(f"""WITH n AS (SELECT ion, count(*) AS n FROM {PRICES} GROUP BY 1), s AS (SELECT p.*, CASE p.ion WHEN 'A' THEN 0.5 WHEN 'N' THEN least(1.0, 200.0 / n.n) ELSE 1.0 END AS share, {DRAW.format(seed=7)} AS draw FROM {PRICES} p JOIN n ON p.ion = n.ion) SELECT ion, count(*) AS n, sum("ionIdx")::BIGINT AS keys FROM s WHERE draw < share GROUP BY 1""")
def stratified_counts(spark, sf_dir):
    rows = composition.stratified_sample(prices(spark, sf_dir), "ion", {"A": 0.5, "N": 200, "R": 1.0}, "ionIdx", 7)
    return rows.groupBy("ion").agg(F.count(F.lit(1)).alias("n"), F.sum("ionIdx").alias("keys"))


@query("""SELECT 'hits' AS crop, count(*) AS n, sum(event_id)::BIGINT AS keys FROM events WHERE event_id BETWEEN 100 AND 900 UNION ALL SELECT 'time', count(*), sum(event_id)::BIGINT FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 10 DAY UNION ALL SELECT 'detector', count(*), sum(event_id)::BIGINT FROM events WHERE power(user_id % 41 - 20, 2) + power(event_id % 31 - 15, 2) <= 100""")
def crops(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    start = F.broadcast(rows.agg(F.min("ts").alias("start")))
    x, y = F.col("user_id") % 41 - 20, F.col("event_id") % 31 - 15
    count = lambda name, frame: frame.agg(F.lit(name).alias("crop"), F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("keys"))
    out = count("hits", rows.filter(F.col("event_id").between(100, 900))).unionByName(count("time", rows.join(start).filter(F.col("ts") >= F.col("start") + F.expr("INTERVAL 10 DAYS"))))
    return out.unionByName(count("detector", rows.filter(geometry.distance2((x, y), (0, 0)) <= 100)))


@query("""SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)""")
def customers_with_large_orders(spark, sf_dir):
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(large, "c_custkey", "left_semi")


@query(f"""SELECT name, count(*) AS n, p_size AS isotope, (p_partkey % 3 + 2)::BIGINT AS atoms FROM (SELECT p_size, p_partkey, p_size::VARCHAR || 'Fe' || (p_partkey % 3 + 1)::VARCHAR || ' 16O' || CASE WHEN p_partkey % 2 = 0 THEN ' ++' ELSE ' +' END AS name FROM part) GROUP BY ALL""")
def atoms_of_names(spark, sf_dir):
    """Arrays and maps: an ion's atoms, how many, and the isotope of its iron."""
    atoms = ions.atoms_of(F.col("name"))
    by_element = F.map_from_entries(F.array_distinct(F.transform(atoms, lambda a: F.struct(a["element"], a["isotope"]))))
    rows = named(spark, sf_dir).select("name", F.size(atoms).cast("long").alias("atoms"), F.element_at(by_element, "Fe").alias("isotope"))
    return rows.groupBy("name", "isotope", "atoms").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('16O 56Fe2 ++', '56Fe2 16O ++', 2), ('O2 H +', 'O2 H +', 1), ('Fe', 'Fe', 0)) AS n(given, name, charge)")
def formatted_names(spark, sf_dir):
    rows = []
    for given in ("16O 56Fe2 ++", "O2 H +", "Fe"):
        atoms, charge = ions.parse(given)
        rows.append((given, ions.compose(atoms, charge), charge))
    return spark.createDataFrame(rows, "given string, name string, charge int")


@query("""SELECT n_regionkey, (n_nationkey % 2)::INTEGER AS half, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey % 2)""")
def rolled_up(spark, sf_dir):
    return table(spark, sf_dir, "nation").rollup("n_regionkey", (F.col("n_nationkey") % 2).alias("half")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT least(greatest(floor((l_quantity - 5) / 40 * 64), 0), 63)::BIGINT AS colour, count(*) AS n FROM lineitem GROUP BY 1")
def colour_indices(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(physics.colour_index(F.col("l_quantity"), 5.0, 45.0, 64).alias("colour")).agg(F.count(F.lit(1)).alias("n"))


# Space


@query(f"""WITH d AS (SELECT a.vec_id, sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d, b.vec_id AS o FROM {POINTS} a JOIN {POINTS} b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, o) AS rank FROM d)
SELECT rank::INTEGER AS rank, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std, round(median(d), 6) AS median, round(min(d), 6) AS min, round(max(d), 6) AS max FROM r WHERE rank <= 2 GROUP BY 1""")
def neighbour_statistics(spark, sf_dir):
    near = spatial.nearest(points(spark, sf_dir), "vec_id", ["x", "y", "z"], 2, 0.5)
    return rounded(spatial.nearest_statistics(near), 6, "mean", "std", "median", "min", "max")


@query(f"""WITH d AS (SELECT a.vec_id, min(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)) AS d FROM {POINTS} a JOIN {POINTS} b ON a.vec_id <> b.vec_id GROUP BY 1) SELECT count(*) AS sampled, round(avg(CASE WHEN d < 0.3 THEN 1.0 ELSE 0 END), 9) AS overlapping, round(avg(d), 6) AS mean_distance FROM d""")
def close_pairs(spark, sf_dir):
    return rounded(rounded(quality.overlap(points(spark, sf_dir), "vec_id", ["x", "y", "z"], 0.3), 9, "overlapping"), 6, "mean_distance")


@query(f"""WITH c AS (SELECT * FROM {POINTS} WHERE x BETWEEN -1 AND 1 AND y BETWEEN -1 AND 1 AND z BETWEEN -1 AND 1), d AS (SELECT sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2) AS d FROM c a JOIN {POINTS} b ON a.vec_id <> b.vec_id), s AS (SELECT floor(d / 0.25)::BIGINT AS bin, count(*) AS pairs FROM d WHERE d < 1 GROUP BY 1)
SELECT bin, pairs, round(pairs / ((SELECT count(*) FROM c) * 0.5 * 4 / 3 * pi() * (((bin + 1) * 0.25)**3 - (bin * 0.25)**3)), 6) AS g FROM s""")
def inner_correlation(spark, sf_dir):
    p = points(spark, sf_dir)
    centres = spatial.inner(p, ["x", "y", "z"], (-2, -2, -2), (2, 2, 2), 1.0)
    return rounded(spatial.pair_correlation(centres, "vec_id", ["x", "y", "z"], 1.0, 0.25, 0.5, p), 6, "g").select("bin", "pairs", "g")


@query(f"""WITH a AS (SELECT vec_id, x + 0.37 AS x, y - 0.11 AS y, z AS z FROM {POINTS}) SELECT p.vec_id, arg_min(a.vec_id, sqrt((p.x-a.x)**2 + (p.y-a.y)**2 + (p.z-a.z)**2)) AS closest, round(min(sqrt((p.x-a.x)**2 + (p.y-a.y)**2 + (p.z-a.z)**2)), 9) AS distance FROM {POINTS} p, a GROUP BY 1""")
def nearest_of_many(spark, sf_dir):
    """More anchors than are compared with every point."""
    p = points(spark, sf_dir)
    anchors = p.select("vec_id", (F.col("x") + 0.37).alias("x"), (F.col("y") - 0.11).alias("y"), "z").withColumnRenamed("vec_id", "vid")
    return rounded(spatial.nearest_anchor(p, anchors, ["x", "y", "z"], "vid", "vec_id").select("vec_id", "closest", "distance"), 9, "distance")


@query(f"""WITH d AS (SELECT label, min(sqrt((p.x-v.x)**2 + (p.y-v.y)**2 + (p.z-v.z)**2)) AS d FROM {POINTS} p, {ANCHOR_SQL} GROUP BY p.vec_id, p.label), c AS (SELECT floor(d / 0.5)::BIGINT AS bin, label::VARCHAR AS species, count(*) AS n FROM d GROUP BY ALL) SELECT bin, species, n, (bin + 0.5) * 0.5 AS distance, n::DOUBLE / sum(n) OVER (PARTITION BY bin) AS share FROM c""")
def point_proxigram(spark, sf_dir):
    anchors = spark.createDataFrame(ANCHORS, "vid long, x double, y double, z double")
    near = spatial.nearest_anchor(points(spark, sf_dir), anchors, ["x", "y", "z"], "vid", "vec_id")
    return mesh.proxigram(near.withColumn("species", F.col("label").cast("string")), "species", 0.5, "distance")


@query(f"""WITH t AS (SELECT *, least(greatest(x + 1, 0), 2) AS t, least(greatest(y / 3, 0), 1) AS u FROM {POINTS}), d AS (SELECT label, least(sqrt((x + 1 - t)**2 + y**2 + z**2), sqrt((x - 1)**2 + (y - 3 * u)**2 + z**2)) AS d FROM t), c AS (SELECT floor(d / 0.5)::BIGINT AS bin, label::VARCHAR AS species, count(*) AS n FROM d GROUP BY ALL) SELECT bin, species, n, (bin + 0.5) * 0.5 AS distance, n::DOUBLE / sum(n) OVER (PARTITION BY bin) AS share FROM c""")
def line_proxigram(spark, sf_dir):
    rows = mesh.polyline_distance(points(spark, sf_dir), [(-1, 0, 0), (1, 0, 0), (1, 3, 0)])
    return mesh.proxigram(rows.withColumn("species", F.col("label").cast("string")), "species", 0.5, "distance")


@query(f"SELECT vec_id, round((x - 1 + y - 2) / sqrt(2), 9) AS u, round((y - 2 - x + 1) / sqrt(2), 9) AS v, round(z + 1, 9) AS w FROM {POINTS}")
def region_frame(spark, sf_dir):
    turned = physics.to_frame(F.col("x"), F.col("y"), F.col("z"), (1, 2, -1), ((1, 1, 0), (-1, 1, 0), (0, 0, 5)))
    return points(spark, sf_dir).select("vec_id", *(F.round(c, 9).alias(n) for c, n in zip(turned, "uvw")))


STRIP_SQL = "(SELECT vec_id AS fid, vec_id AS v0, vec_id + 1 AS v1, vec_id + 2 AS v2 FROM embeddings WHERE vec_id + 2 <= (SELECT max(vec_id) FROM embeddings))"
CORNERS_SQL = f"(SELECT f.*, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS ux, b.y - a.y AS uy, b.z - a.z AS uz, c.x - a.x AS wx, c.y - a.y AS wy, c.z - a.z AS wz FROM {STRIP_SQL} f JOIN {POINTS} a ON a.vec_id = f.v0 JOIN {POINTS} b ON b.vec_id = f.v1 JOIN {POINTS} c ON c.vec_id = f.v2)"
NORMAL_SQL = f"(SELECT *, uy*wz - uz*wy AS nx, uz*wx - ux*wz AS ny, ux*wy - uy*wx AS nz FROM {CORNERS_SQL})"


def strip(spark, sf_dir):
    """A strip of triangles through all points."""
    v = points(spark, sf_dir).select(F.col("vec_id").alias("vid"), "x", "y", "z")
    last = F.broadcast(v.agg(F.max("vid").alias("last")))
    f = v.join(last).filter(F.col("vid") + 2 <= F.col("last")).select(F.col("vid").alias("fid"), F.col("vid").alias("v0"), (F.col("vid") + 1).alias("v1"), (F.col("vid") + 2).alias("v2"))
    return v, f


@query(f"SELECT fid, round(sqrt(nx*nx + ny*ny + nz*nz) / 2, 6) AS area, round(nx / sqrt(nx*nx + ny*ny + nz*nz), 6) AS nx FROM {NORMAL_SQL}")
def face_areas(spark, sf_dir):
    return rounded(mesh.face_areas(*strip(spark, sf_dir)), 6, "area", "nx").select("fid", "area", "nx")


@query(f"WITH a AS (SELECT unnest([v0, v1, v2]) AS vid, sqrt(nx*nx + ny*ny + nz*nz) / 6 AS a FROM {NORMAL_SQL}) SELECT vid, round(sum(a), 6) AS area FROM a GROUP BY 1")
def vertex_areas(spark, sf_dir):
    return rounded(mesh.vertex_areas(*strip(spark, sf_dir)), 6, "area")


@query(f"""WITH t AS (SELECT *, sqrt(nx*nx + ny*ny + nz*nz) AS n, sqrt(ux*ux + uy*uy + uz*uz) AS lu, sqrt(wx*wx + wy*wy + wz*wz) AS lw, sqrt((wx-ux)**2 + (wy-uy)**2 + (wz-uz)**2) AS lv FROM {NORMAL_SQL}),
g AS (SELECT v0 AS vid, nx / n AS nx, ny / n AS ny, nz / n AS nz, acos(least(greatest((ux*wx + uy*wy + uz*wz) / (lu * lw), -1), 1)) AS w FROM t UNION ALL SELECT v1, nx / n, ny / n, nz / n, acos(least(greatest((-ux*(wx-ux) - uy*(wy-uy) - uz*(wz-uz)) / (lu * lv), -1), 1)) FROM t UNION ALL SELECT v2, nx / n, ny / n, nz / n, acos(least(greatest((wx*(wx-ux) + wy*(wy-uy) + wz*(wz-uz)) / (lw * lv), -1), 1)) FROM t),
s AS (SELECT vid, sum(nx * w) AS x, sum(ny * w) AS y, sum(nz * w) AS z FROM g GROUP BY 1) SELECT vid, round(x / sqrt(x*x + y*y + z*z), 5) AS nx, round(y / sqrt(x*x + y*y + z*z), 5) AS ny, round(z / sqrt(x*x + y*y + z*z), 5) AS nz FROM s""")
def vertex_normals(spark, sf_dir):
    return rounded(mesh.vertex_normals(*strip(spark, sf_dir)), 5, "nx", "ny", "nz")


@query(f"""WITH p AS (SELECT unnest([v0, v1, v2]) AS a, unnest([v1, v2, v0]) AS b FROM {STRIP_SQL}), e AS (SELECT DISTINCT least(a, b) AS s, greatest(a, b) AS d FROM p), n AS (SELECT s AS vid, d AS o FROM e UNION ALL SELECT d, s FROM e UNION ALL SELECT vec_id, vec_id FROM embeddings)
SELECT n.vid, round(avg(q.z), 6) AS z FROM n JOIN {POINTS} q ON q.vec_id = n.o GROUP BY 1""")
def delocalised(spark, sf_dir):
    v, f = strip(spark, sf_dir)
    return rounded(mesh.delocalise(v.select("vid", "z"), f, "z"), 6, "z")


@query(f"SELECT vec_id AS fid, (vec_id - vec_id % 20)::BIGINT AS piece FROM embeddings WHERE vec_id % 20 < 18 AND vec_id + 2 <= (SELECT max(vec_id) FROM embeddings)")
def mesh_pieces(spark, sf_dir):
    _, f = strip(spark, sf_dir)
    return mesh.pieces(f.filter("fid % 20 < 18")).select("fid", "piece")


@query(f"""WITH n AS (SELECT v.vid, avg(p.z - v.z) AS shift, count(*) AS n FROM {ANCHOR_SQL} JOIN {POINTS} p ON (p.x-v.x)**2 + (p.y-v.y)**2 + (p.z-v.z)**2 <= 2.25 GROUP BY 1) SELECT v.vid, v.x::DOUBLE AS x, round(v.z + coalesce(n.shift, 0), 6) AS z, coalesce(n.n, 0) AS n FROM {ANCHOR_SQL} LEFT JOIN n ON n.vid = v.vid""")
def snapped_vertices(spark, sf_dir):
    v = spark.createDataFrame(ANCHORS, "vid long, x double, y double, z double")
    normals = v.select("vid", F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    return rounded(mesh.snapped(v, normals, points(spark, sf_dir), 1.5), 6, "z").select("vid", "x", "z", "n")


@query(f"""WITH d AS (SELECT p.label, p.z - v.z AS signed, v.vid, row_number() OVER (PARTITION BY p.vec_id ORDER BY sqrt((p.x-v.x)**2 + (p.y-v.y)**2 + (p.z-v.z)**2), v.vid) AS k FROM {POINTS} p, {ANCHOR_SQL}), c AS (SELECT vid, count(*) AS n FROM d WHERE k = 1 AND label = 3 AND abs(signed) <= 1 GROUP BY 1)
SELECT v.vid::BIGINT AS vid, coalesce(c.n, 0) AS n, coalesce(c.n, 0) / (v.vid + 0.5) AS excess FROM {ANCHOR_SQL} LEFT JOIN c ON c.vid = v.vid""")
def surface_excess(spark, sf_dir):
    areas = spark.createDataFrame([(i, i + 0.5) for i, *_ in ANCHORS], "vid long, area double")
    return mesh.excess_map(_signed(spark, sf_dir), F.col("label") == 3, 1.0, areas)


@query(f"""WITH r AS (SELECT row_number() OVER (ORDER BY z, vec_id) AS k, label FROM {POINTS}), c AS (SELECT k, sum(CASE WHEN label = 3 THEN 1 ELSE 0 END) OVER (ORDER BY k) AS s, (SELECT count(*) FROM embeddings) AS n FROM r), f AS (SELECT regr_slope(s, k) FILTER (WHERE k <= n // 4) AS a, regr_intercept(s, k) FILTER (WHERE k <= n // 4) AS b, regr_slope(s, k) FILTER (WHERE k >= n - n // 4) AS c, regr_intercept(s, k) FILTER (WHERE k >= n - n // 4) AS d, any_value(n) AS n FROM c)
SELECT round(((c * (n // 2) + d) - (a * (n // 2) + b)) / 2.5, 6) AS excess FROM f""")
def excess_by_ladder(spark, sf_dir):
    p = points(spark, sf_dir)
    n = p.count()
    numbered = instrument.renumbered(p.withColumn("ionIdx", F.floor(F.col("z") * 1e9).cast("long") * 100_000 + F.col("vec_id")), 1_000_000_000_000)
    found = mesh.interfacial_excess(numbered, F.col("label") == 3, "ionIdx", (n // 4, n - n // 4), n // 2, 2.5, 500)
    return spark.createDataFrame([(round(found, 6),)], "excess double")


@query(f"""WITH g AS (SELECT vec_id, greatest(abs(x) - 1, 0) AS dx, greatest(abs(y) - 1, 0) AS dy, greatest(abs(z) - 1, 0) AS dz, greatest(abs(x), abs(y), abs(z)) AS m FROM {POINTS})
SELECT vec_id, round(CASE WHEN m > 1 THEN sqrt(dx*dx + dy*dy + dz*dz) ELSE 1 - m END, 9) AS distance, round(CASE WHEN m > 1 THEN sqrt(dx*dx + dy*dy + dz*dz) ELSE m - 1 END, 9) AS signed FROM g""")
def distance_to_cube(spark, sf_dir):
    corner = np.array(CUBE_POINTS)[np.array(CUBE_FACES)]
    faces = pd.DataFrame({"fid": range(12)} | {f"{n}{c}": corner[:, k, i] for k, n in enumerate("abc") for i, c in enumerate("xyz")})
    return rounded(mesh.point_to_mesh(points(spark, sf_dir), faces, "vec_id"), 9, "distance", "signed").select("vec_id", "distance", "signed")


@query(f"SELECT vec_id, round(CASE WHEN y <= x THEN x + y ELSE 2 * x END, 9) AS new_x, round(y, 9) AS new_y FROM {POINTS} WHERE x BETWEEN 0 AND 5 AND y BETWEEN 0 AND 5 AND abs(x - y) > 1e-9")
def mapped_by_triangles(spark, sf_dir):
    """A square in two triangles; the lower one is sheared, the upper one stretched."""
    t = pd.DataFrame([(0, 0, 5, 0, 5, 5, 0, 0, 5, 0, 10, 5), (0, 0, 5, 5, 0, 5, 0, 0, 10, 5, 0, 5)], columns=["ax", "ay", "bx", "by", "cx", "cy", "aX", "aY", "bX", "bY", "cX", "cY"]).astype(float)
    found = reconstruction.in_triangles(points(spark, sf_dir), t, "x", "y").filter((F.abs(F.col("x") - F.col("y")) > 1e-9) & F.col("new_x").isNotNull())
    return rounded(found.select("vec_id", "new_x", "new_y"), 9, "new_x", "new_y")


@query(f"""WITH s AS (SELECT "ionIdx", sum(0.25) OVER (ORDER BY "ionIdx") AS v FROM {RAW}) SELECT "ionIdx", round(cbrt(8000 + v * 3 * sin(radians(10)) / (1 - sin(radians(10)))), 9) AS radius FROM s""")
def shank_radii(spark, sf_dir):
    return rounded(reconstruction.shank_radius(raw(spark, sf_dir), 20.0, 10.0, F.lit(0.25), 500).select("ionIdx", "radius"), 9, "radius")


VOXELS = "(SELECT a AS i, b AS j, c AS k, (a * 7 + b * 3 + c * 11) % 13 AS value FROM range(0, 5) t(a), range(0, 4) u(b), range(0, 3) w(c))"


def block(spark):
    rows = [(a, b, c, float((a * 7 + b * 3 + c * 11) % 13)) for a in range(5) for b in range(4) for c in range(3)]
    return spark.createDataFrame(rows, "i long, j long, k long, value double")


@query(f"""WITH g AS (SELECT i, j, k, i * 0.5 + 0.25 AS x, j * 0.5 AS y, k * 0.75 AS z FROM range(0, 7) a(i), range(0, 6) b(j), range(0, 3) c(k)), m AS (SELECT g.i, g.j, g.k, (1 - abs(x - v.i)) * (1 - abs(y - v.j)) * (1 - abs(z - v.k)) AS w, v.value FROM g JOIN {VOXELS} v ON abs(x - v.i) < 1 AND abs(y - v.j) < 1 AND abs(z - v.k) < 1)
SELECT i, j, k, round(sum(w * value) / sum(w), 9) AS value FROM m GROUP BY ALL""")
def volume_resampled(spark, sf_dir):
    return rounded(volume.resample(block(spark), (7, 6, 3), (0.5, 0.5, 0.75), (0.25, 0, 0)), 9, "value")


@query("SELECT 4 - b AS i, a AS j, c AS k, ((a * 7 + b * 3 + c * 11) % 13)::DOUBLE AS value FROM range(0, 5) t(a), range(0, 5) u(b), range(0, 3) w(c)")
def volume_turned(spark, sf_dir):
    """A quarter turn about the third axis."""
    rows = [(a, b, c, float((a * 7 + b * 3 + c * 11) % 13)) for a in range(5) for b in range(5) for c in range(3)]
    return rounded(volume.rotated(spark.createDataFrame(rows, "i long, j long, k long, value double"), (5, 5, 3), (0, 0, 1), math.pi / 2), 9, "value")


# Crystals, quality


@query("SELECT p_partkey, round(least(p_size % 90, 90 - p_size % 90), 5)::DOUBLE AS angle FROM part")
def misorientations(spark, sf_dir):
    """From the cube's axes to a turn of p_size degrees about the third one."""
    t = F.radians(F.col("p_size").cast("double"))
    turn = F.array(F.cos(t), -F.sin(t), F.lit(0.0), F.sin(t), F.cos(t), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    same = F.array(*(F.lit(float(v)) for v in np.eye(3).ravel()))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(crystal.misorientation_column(same, turn), 5).alias("angle"))


FOLDED = "(SELECT list_sort([abs({x}), abs({y}), abs({z})]) AS s FROM " + POINTS + ")"
BINNED = "SELECT floor(degrees(atan2(sqrt(s[1]*s[1] + s[2]*s[2]), s[3])) / 5)::BIGINT AS theta_bin, floor(degrees(atan2(s[1], s[2])) / 5)::BIGINT AS phi_bin, count(*) AS n FROM {f} GROUP BY ALL"


@query(f"WITH b AS ({BINNED.format(f=FOLDED.format(x='x', y='y', z='z'))}) SELECT theta_bin, phi_bin, n, round(n / sum(n) OVER (), 9) AS share FROM b")
def pole_figure_bins(spark, sf_dir):
    return rounded(crystal.ipf_histogram(points(spark, sf_dir), F.col("x"), F.col("y"), F.col("z"), 5.0), 9, "share").select("theta_bin", "phi_bin", "n", "share")


@query("WITH " + ", ".join(f"{n} AS ({BINNED.format(f=FOLDED.format(x=x, y=y, z='z'))})" for n, x, y in (("a", "x", "y"), ("b", "(0.6 * x + 0.8 * y)", "(0.6 * y - 0.8 * x)"))) + " SELECT 'a' AS side, * FROM a UNION ALL SELECT 'b', * FROM b")
def boundary_normals(spark, sf_dir):
    """The normals of a boundary in the frames of the crystals on its two sides, by bins of the standard triangle."""
    p, out = points(spark, sf_dir), None
    for side, matrix in (("a", np.eye(3)), ("b", np.array([[0.6, 0.8, 0], [-0.8, 0.6, 0], [0, 0, 1]]))):
        rows = crystal.ipf_histogram(p, *crystal.turned(matrix, F.col("x"), F.col("y"), F.col("z")), 5.0).select(F.lit(side).alias("side"), "theta_bin", "phi_bin", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT o_orderpriority AS multi, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM orders GROUP BY 1")
def multiplicities(spark, sf_dir):
    return rounded(quality.multiplicity(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "multi")), 9, "share")


@query(f"""WITH b AS (SELECT min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS cy, min(z) AS az, max(z) AS bz, count(*) AS n FROM {POINTS}), c AS (SELECT floor((x - ax) / 2) AS i, floor((y - ay) / 2) AS j, floor((z - az) / 2) AS k, count(*) AS n FROM {POINTS}, b WHERE x < bx AND y < cy AND z < bz GROUP BY ALL)
SELECT b.n AS ions, round((bx - ax) * (cy - ay) * (bz - az), 4) AS volume, round(b.n / ((bx - ax) * (cy - ay) * (bz - az)), 6) AS density, round((SELECT stddev_samp(n) / avg(n) FROM c), 6) AS variation, (SELECT median(n) FROM c) AS voxel_median FROM b""")
def density_report(spark, sf_dir):
    return rounded(rounded(quality.density(points(spark, sf_dir)), 4, "volume"), 6, "density", "variation")


@query("""WITH h AS (SELECT event_id AS i, (user_id % 41 - 20)::DOUBLE AS x, (event_id % 31 - 15)::DOUBLE AS y FROM events), s AS (SELECT floor(i / 500) AS s, x, y FROM h WHERE abs(x) < 18 AND abs(y) < 18), e AS (SELECT s, x, y FROM s UNION ALL SELECT s - 1, x, y FROM s WHERE s > 0)
SELECT s::BIGINT AS slice, floor((x + 18) / 4)::INTEGER AS px, floor((y + 18) / 4)::INTEGER AS py, count(*) AS n FROM e GROUP BY ALL""")
def detector_counts(spark, sf_dir):
    return quality.detector_maps(raw(spark, sf_dir), 1000, 18.0, 9)


@query("""WITH h AS (SELECT floor((event_id - (SELECT min(event_id) FROM events)) / 1000)::BIGINT AS slice, (user_id % 41 - 20)::DOUBLE AS x, (event_id % 31 - 15)::DOUBLE AS y FROM events), p AS (SELECT slice, floor(degrees(CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END) / 30)::BIGINT AS sector, sqrt(x*x + y*y) AS r FROM h), m AS (SELECT slice, least(sector, 11) AS sector, max(r) AS r FROM p GROUP BY ALL)
SELECT slice, sector, round(r, 6) AS radius FROM m""")
def detector_outline(spark, sf_dir):
    rows = raw(spark, sf_dir)
    first = rows.agg(F.min("ionIdx")).first()[0]
    found = quality.outline(rows.withColumn("slice", F.floor((F.col("ionIdx") - first) / 1000)), 12)
    return rounded(found, 6, "radius")
