import numpy as np
import pytest

from iontide.sources import instrument, mesh_files, range_files, text_files


def test_ion_lists_round_trip(spark, tmp_path):
    rows = [(i, *(float(np.float32(i + k / 7)) for k in range(9)), i, 2) for i in range(1, 30)]
    names = ["ionIdx", *instrument.RECORDS["epos"].names]
    frame = spark.createDataFrame(rows, names)
    for kind, n in (("pos", 5), ("epos", 12)):
        path = str(tmp_path / f"a.{kind}")
        assert instrument.write_records(frame, path, kind) == 29
        back = instrument.load(spark, path).orderBy("ionIdx").collect()
        assert [tuple(r[c] for c in names[:n]) for r in back] == [r[:n] for r in rows]
    assert instrument.load(spark, str(tmp_path / "a.pos")).schema["mc"].metadata == {"unit": "Da"}


def test_broken_tail_is_left_out():
    assert len(instrument.decode("pos", b"\0" * 33)) == 2


def test_range_files():
    text = "[Ions]\nNumber=2\nIon1=Al\nIon2=O\n[Ranges]\nNumber=2\nRange1=26,9 27,1 Vol:0,016 Al:1 Color:33FF0A\nRange2=42.9 43.1 Vol:0.04 Al:1 O:1 Color:000001\n"
    found = range_files.parse_rrng(text)
    assert [(r["rangeName"], r["mcbegin"]) for r in found] == [("Al", 26.9), ("Al O", 42.9)]
    again = range_files.parse_rrng(range_files.format_rrng(found))
    assert [(r["rangeName"], r["mcbegin"], r["color"]) for r in again] == [(r["rangeName"], r["mcbegin"], r["color"]) for r in found]


def test_older_range_tables_and_xml():
    text = "2 2\nAl\nAl 1.0 0.0 0.0\nO\nO 0.0 0.0 1.0\n------------------- Al O\n. 26.9 27.1 1 0\n. 42.9 43.1 1 1\n"
    assert [r["rangeName"] for r in range_files.parse_rng(text)] == ["Al", "Al O"]
    xml = '<ranges note="a & b"><range mcbegin="26.9" mcend="27.1" ion="27Al" chargestate="1"/></ranges>'
    (only,) = range_files.parse_xrng(xml)
    assert only["rangeName"] == "27Al" and only["chargeState"] == 1


def test_ranges_as_a_table(spark, tmp_path):
    path = tmp_path / "a.rrng"
    path.write_text("Range1=1.0 2.0 Vol:0.1 H:1 Color:FFFFFF\n")
    row = range_files.read_ranges(spark, str(path)).first()
    assert row.rangeIdx == 0 and row.ion[0].element == "H"


def test_metadata(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_text("% list\n/a/temperature [float64] = 50 [K] % low\n/a/name [string] = NULL\n\n")
    rows = {r.path: r for r in text_files.typed(text_files.read_metadata(spark, str(path))).collect()}
    assert rows["/a/temperature"].number == 50 and rows["/a/temperature"].unit == "K" and rows["/a/name"].value is None


def test_sensor_logs_and_positions(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / "logs" / str(k)).mkdir(parents=True)
        (tmp_path / "logs" / str(k) / "p.csv").write_text(f"head\nDate,Time,p\n1/{k}/2024,1:02:03 PM,{k}.5\n")
    rows = text_files.read_sensor(spark, str(tmp_path / "logs"), ["Date", "Time", "p"]).orderBy("p").collect()
    assert [r.p for r in rows] == ["1.5", "2.5"] and rows[0].timestamp.hour == 13
    (tmp_path / "a.xyz").write_text("2\ncomment\nAl 0 0.5 1\nO 1 2 3\n")
    assert [tuple(r) for r in text_files.read_xyz(spark, str(tmp_path / "a.xyz")).collect()] == [("Al", 0, 0.5, 1), ("O", 1, 2, 3)]


def test_meshes_round_trip():
    v = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0]], float)
    f = np.array([[0, 1, 2], [0, 2, 3]])
    a, b = mesh_files.parse_obj(mesh_files.format_obj(v, f))
    assert np.array_equal(a, v) and np.array_equal(b, f)
    a, b = mesh_files.parse_stl(mesh_files.format_stl(v, f))
    assert np.allclose(a[b], v[f])
    assert mesh_files.format_ply(v, f).splitlines()[2] == "element vertex 4"
    assert mesh_files.parse_obj("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nf 1/1 2/2 3/3 4/4\n")[1].shape == (2, 3)


def test_crystal_file():
    text = "_cell_length_a 4.05(1)\n_cell_angle_alpha 90\nloop_\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\nAl 0 0.5 0.5\n"
    found = mesh_files.parse_cif(text)
    assert found["cell"]["length_a"] == 4.05 and found["sites"] == [("Al", 0, 0.5, 0.5)]


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        instrument.load(spark, "a.xyz9")


@pytest.mark.parametrize("bounds_in_header", [False, True])
def test_sectioned_files(spark, tmp_path, bounds_in_header):
    from iontide.sources import sections as x

    def text(value, n):
        return np.frombuffer(value.encode("utf-16-le").ljust(2 * n, b"\0"), "<u2")

    def section(name, rows):
        head = np.zeros(1, x.SECTION_HEADER)
        extra = x.BOUNDS_BYTES if name == x.POSITION else 0
        head["signature"], head["size"] = b"SEC", x.SECTION_HEADER.itemsize + extra * bounds_in_header
        head["type"], head["record_size"], head["bits"] = text(name, 32), rows[0].nbytes, 8 * rows.dtype.itemsize
        head["records"], head["bytes"] = len(rows), rows.nbytes
        return head.tobytes() + b"\0" * extra + rows.tobytes()

    head = np.zeros(1, x.FILE_HEADER)
    head["signature"], head["size"], head["ions"] = b"APT", x.FILE_HEADER.itemsize, 3
    place = np.arange(9, dtype="<f4").reshape(3, 3)
    mass = np.array([[27.0], [28.0], [29.0]], "<f4")
    content = head.tobytes() + section("Mass", mass) + section("tstage", np.ones((3, 1), "<u2")) + section("Position", place) + section("Voltage", mass * 100)
    (tmp_path / "a.apt").write_bytes(content)
    rows = instrument.load(spark, str(tmp_path / "a.apt")).orderBy("ionIdx").collect()
    assert [(r.ionIdx, r.x, r.z, r.mc, r.VDC, r.tof) for r in rows] == [(1, 0, 2, 27, 2700, 0), (2, 3, 5, 28, 2800, 0), (3, 6, 8, 29, 2900, 0)]


def test_ion_lists_by_byte_ranges(spark, tmp_path, monkeypatch):
    """One file in several ranges, rows in gaps of ionIdx, and a broken last record."""
    from iontide.sources import ranges

    rows = [(3 * i + 1, float(i), float(i % 7), 0.5, 1.0) for i in range(500)]
    path = str(tmp_path / "a.pos")
    monkeypatch.setattr(instrument, "CHUNK_RECORDS", 60)
    assert instrument.write_records(spark.createDataFrame(rows, "ionIdx long, x double, y double, z double, mc double").repartition(4), path) == 500
    with open(path, "ab") as out:
        out.write(b"\0" * 7)
    parts = ranges.byte_ranges(spark, path, 16, 16 * 64)
    assert parts.count() == 8 and parts.agg({"n": "sum"}).first()[0] == 500
    monkeypatch.setattr(ranges, "RANGE_BYTES", 16 * 64)
    monkeypatch.setattr(ranges.byte_ranges, "__defaults__", (16 * 64,))
    back = instrument.read_records(spark, path, "pos").orderBy("ionIdx").collect()
    assert [(r.ionIdx, r.x, r.y) for r in back] == [(i + 1, float(i), float(i % 7)) for i in range(500)]


def test_range_files_of_many_lines(spark, tmp_path):
    path = tmp_path / "b.rrng"
    path.write_text("[Ions]\nNumber=1\nIon1=H\n[Ranges]\nRange1=1.0 2.0 Vol:0.1 H:1 Color:FFFFFF\nRange2=3.0 4.0 Vol:0.1 H:2 Color:FFFFFF\n")
    assert [r.mcbegin for r in range_files.read_ranges(spark, str(path)).orderBy("rangeIdx").collect()] == [1.0, 3.0]
