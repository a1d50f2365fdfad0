"""Readers of files: what they do with the unusual, and that filters reach them."""

import io
from datetime import datetime

import numpy as np
import pytest

from tidewatch.operators import detection, signal
from tidewatch.sources import dat, delimited, npz, profiles, xlsx
from tidewatch.sources.files import data_dir, exists, listing, written


def put(spark, folder, files):
    return written(spark.createDataFrame(list(files.items()), "name string, content binary"), str(folder))


def test_recordings(spark, tmp_path):
    data = {n: np.round(np.random.default_rng(n).normal(0, 500, 2500)) for n in (3, 4, 10)}
    files = {f"m{n % 2}/{n:08d}.DAT": dat.encode(datetime(2019, 1, 10 + n, 4, 5, 6, 789000), x, instrument_id=f"H{n}", sample_rate=1000, daq_serial="q") for n, x in data.items()}
    assert put(spark, tmp_path, files | {"m1/00000009.DAT": b"short", "m1/note.txt": b"no"}) == sorted([*files, "m1/00000009.DAT", "m1/note.txt"])
    h = dat.headers(spark, str(tmp_path), sort_by="file_number").collect()
    assert [(r.file_number, r.instrument_id, r.daq_serial, r.timestamp) for r in h] == [(n, f"H{n}", "q", datetime(2019, 1, 10 + n, 4, 5, 6, 789000)) for n in (3, 4, 10)]
    for r in (dat.recordings(spark, str(tmp_path), piece=1000), dat.load(spark, str(tmp_path))):
        got = {}
        for x in r.select("file_number", "first_sample", "samples").orderBy("file_number", "first_sample").collect():
            assert x.first_sample == len(got.setdefault(x.file_number, []))
            got[x.file_number] += x.samples
        assert {n: x.tolist() for n, x in data.items()} == got
    assert dat.recordings(spark, str(tmp_path), piece=1000).count() == 9


def test_files_are_left_out_unopened(spark, tmp_path):
    put(spark, tmp_path, {f"{n:08d}.DAT": dat.encode(datetime(2019, 1, 1), np.arange(10.0), sample_rate=1000) for n in range(1, 6)})
    (tmp_path / "00000003.DAT").write_bytes(b"\xff" * 600)  # its header can't be read
    for read in (dat.load, dat.recordings, dat.headers):
        assert {x.file_number for x in read(spark, str(tmp_path), only="file_number IN (2, 4)").collect()} == {2, 4}
        assert read(spark, str(tmp_path), only="file_number = 77").collect() == []
    r = dat.load(spark, str(tmp_path), only="file_number != 3")
    assert (r.where("file_number = 2").count(), r.count()) == (1, 4)
    with pytest.raises(Exception):
        dat.load(spark, str(tmp_path)).collect()


def test_detection_reads_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(150_000) * 64
    t = np.arange(1500) / 1000
    x[90_000:91_500] += 64 * 60 * np.sin(2 * np.pi * 6 * t) * np.exp(-2 * t)
    content = dat.encode(datetime(2019, 1, 10), x, instrument_id="H1", sample_rate=signal.FS)
    put(spark, tmp_path, {"m3/00000001.DAT": content})
    got = detection.catalogue(listing(spark, str(tmp_path), "*.DAT")).toPandas()
    want = detection.of_file("m3", 1, "H1", round((datetime(2019, 1, 10) - datetime(1970, 1, 1)).total_seconds() * 1e6), dat.samples(content))
    assert len(got) == len(want) > 0 and set(got.mooring) == {"m3"}
    key = ["detection_band", "on_samp"]
    got, want = got.sort_values(key), want.sort_values(key)
    for c in want.columns:
        if want[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float))
        else:
            assert got[c].tolist() == want[c].tolist(), c


def test_folders(spark, tmp_path):
    assert not exists(spark, str(tmp_path / "full"))
    assert data_dir(spark, str(tmp_path / "full"), "part") == "part"
    (tmp_path / "full").mkdir()
    assert data_dir(spark, str(tmp_path / "full"), "part") == str(tmp_path / "full")


def test_profiles(spark, tmp_path):
    rows = "\n".join(f"{10 * i},{1450 + i}" for i in range(12))
    put(spark, tmp_path, {
        "a.asvp": f"\n Date,2019-01-01\nTime,10:00\nLatitude, -62.5\nLongitude,-59\ndepth,speed\n{rows}\nbad,row\n7".encode(),
        "b.asvp": ("[SVP_VERSION_2]\nname\nSection 2019-015 10:00:00 -62:30:00 -59:00:00\n" + rows.replace(",", "   ")).encode(),
        "c.asvp": ("( SoundVelocity 1.0 0 190115 -62.1 -59.2 0 )\r\n" + rows.replace(",", "\t").replace("\n", "\r\n")).encode(),
        "d.asvp": ("(short)\n" + "\n".join(f"{i} 1450" for i in range(30))).encode(),
        "e.asvp": b"  \n", "f.asvp": rows.encode(), "g.asvp": b"[SVP_VERSION_2]",
    })
    got = {r.source: r for r in profiles.read(spark, str(tmp_path)).collect()}
    assert set(got) == {f"{c}.asvp" for c in "abcdfg"}
    points = [(10.0 * i, 1450.0 + i) for i in range(12)]
    for c in "abcf":
        assert [tuple(p) for p in got[f"{c}.asvp"].points] == points and got[f"{c}.asvp"].accepted
    assert (got["a.asvp"].date, got["a.asvp"].lat, got["a.asvp"].lon) == ("2019-01-01", -62.5, -59.0)
    assert (got["b.asvp"].date, got["b.asvp"].time, got["b.asvp"].lat_dms, got["b.asvp"].lat) == ("2019-015", "10:00:00", "-62:30:00", None)
    assert (got["c.asvp"].lat, got["c.asvp"].lon, got["d.asvp"].lat) == (-62.1, -59.2, None)
    assert len(got["d.asvp"].points) == 30 and not got["d.asvp"].accepted and not got["g.asvp"].accepted and got["g.asvp"].points == []


def test_npz(spark, tmp_path):
    out = io.BytesIO()
    cube = np.array([[[0.1, 0.2, 2.5]], [[-1.0, np.nan, 1.0]]])
    np.savez(out, ice=cube, times=np.array(["2019-01", "2019-02"]), lat=np.array([[-62.0, -62.5, -63.0]]), lon=np.array([[-59.0, -58.0, -57.0]]), none=np.zeros((0, 3)), obj=np.array([{}], dtype=object))
    put(spark, tmp_path, {"a.npz": out.getvalue()})
    a = npz.read(spark, str(tmp_path))
    got = {r.name: r for r in a.collect()}
    assert set(got) == {"ice", "times", "lat", "lon", "none"}
    assert got["ice"].shape == [2, 1, 3] and got["none"].shape == [0, 3] and got["none"].number == [] and got["times"].text == ["2019-01", "2019-02"]
    assert sorted((r.time, r.lat, r.lon, r.value) for r in npz.gridded(a, "ice", "times", "lat", "lon").collect()) == [("2019-01", -62.5, -58.0, 0.2), ("2019-01", -62.0, -59.0, 0.1), ("2019-02", -63.0, -57.0, 1.0)]


def test_xlsx(spark, tmp_path):
    put(spark, tmp_path, {"a.xlsx": xlsx.book("S", [["h"], ["2019 010", None, "a <b> & é", "", *["1"] * 3], [], ["x"] * 26])})
    got = {r.row: r.cells for r in xlsx.read(spark, str(tmp_path), "S").collect()}
    assert got == {1: {"A": "h"}, 2: {"A": "2019 010", "C": "a <b> & é", "E": "1", "F": "1", "G": "1"}, 3: {}, 4: {chr(65 + i): "x" for i in range(26)}}
    r = xlsx.read(spark, str(tmp_path), None, 2, 4).select("row", xlsx.filled("cells", "E", "Z").alias("n")).collect()
    assert {x.row: x.n for x in r} == {2: 3, 3: 0, 4: 22}
    assert xlsx.read(spark, str(tmp_path), "other").collect() == []


def test_delimited(spark, tmp_path):
    lines = ["20190101203040 2 31 -62.1 -59 0.1 0.2 1.5 - - ship EQ iq", "2019010120304055 3 4 -62 -59 0 0 0 - - none at all", "20190101203040 2 31 -62.1 -59 0.1 0.2 1.5 - -", "2019010120304 2 31 -62.1 -59 0.1 0.2 1.5 - - EQ", "20190101203040 x 31 -62.1 -59 0.1 0.2 1.5 - - EQ", "", "20190101203040 2 31 -62.1 -59 0.1 oh 1.5 - - EQ"]
    got = sorted(delimited.analyst_events(spark.createDataFrame([(x,) for x in lines], "value string")).collect(), key=lambda r: r.onset_us)
    us = round((datetime(2019, 1, 10, 12, 3, 4) - datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert [(r.onset_us, r.analyst_class, r.first_mooring, r.notes) for r in got] == [(us, "EQ", "m3", "ship EQ iq"), (us + 550_000, "other", "m4", "none at all")]
    (tmp_path / "c.csv").write_text("date,lat,Unnamed: 11,\n737791.5,1.0,,\n")
    d = delimited.read_csv(spark, str(tmp_path / "c.csv"))
    assert d.columns == ["date", "lat"]
    assert delimited.observed(d).first().onset_us == round((datetime(2020, 1, 1, 12) - datetime(1970, 1, 1)).total_seconds() * 1e6)
