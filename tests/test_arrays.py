import datetime as dt
import struct

import numpy as np
import pytest

from gridspark.sources.arrays import Layout, NetcdfStore, ZarrStore, read_array, write_zarr

RNG = np.random.default_rng(1)
LAI = RNG.normal(0, 1, (7, 5, 6)).astype(np.float32)
LAI[2, 1, 3] = np.nan
FLAG = RNG.integers(0, 3, (7, 5, 6)).astype(np.int8)
ELEV = RNG.integers(0, 900, (5, 6)).astype(np.int16)
TIME = np.arange(7) * 4


@pytest.fixture
def zarr(tmp_path):
    path = str(tmp_path / "cube.zarr")
    write_zarr(path, {"time": (["time"], TIME, {"units": "days since 2020-01-01"}), "lat": (["lat"], np.arange(5) * 1000.0, {}), "LAI_norm": (["time", "lat", "lon"], LAI, {}),
                      "LAI_flag": (["time", "lat", "lon"], FLAG, {}), "elev": (["lat", "lon"], ELEV, {"scale_factor": 0.5, "_FillValue": int(ELEV[0, 0])})}, {"time": 3, "lat": 2, "lon": 4})
    return path


def test_zarr_as_long_table(spark, zarr):
    d = read_array(spark, zarr)
    assert {f.name: f.dataType.simpleString() for f in d.schema} == {"time": "timestamp_ntz", "lat": "double", "lon": "bigint", "LAI_flag": "tinyint", "LAI_norm": "float", "elev": "double"}
    assert d.rdd.getNumPartitions() == 3 * 3 * 2
    rows = {(r["time"], r["lat"], r["lon"]): r for r in d.collect()}
    assert len(rows) == LAI.size
    for t, y, x in np.ndindex(*LAI.shape):
        r = rows[dt.datetime(2020, 1, 1) + dt.timedelta(days=4 * t), y * 1000.0, x]
        assert r["LAI_norm"] == (None if np.isnan(LAI[t, y, x]) else LAI[t, y, x]) and r["LAI_flag"] == FLAG[t, y, x]
        assert r["elev"] == (None if ELEV[y, x] == ELEV[0, 0] else ELEV[y, x] * 0.5)
    assert read_array(spark, zarr, variables=["LAI_flag"]).columns == ["time", "lat", "lon", "LAI_flag"]
    with pytest.raises(Exception, match="missing variables: nope"):
        read_array(spark, zarr, variables=["nope"])


def test_zarr_chunks_that_are_not_stored(zarr):
    import json
    from pathlib import Path

    at = Path(zarr) / "LAI_norm"
    (at / "1.0.0").unlink()
    m = json.loads((at / ".zarray").read_text()) | {"fill_value": "NaN"}
    (at / ".zarray").write_text(json.dumps(m))
    a = ZarrStore(zarr).read("LAI_norm", [2, 0, 1], [7, 5, 6])
    assert np.isnan(a[1:4, :2, :3]).all() and np.array_equal(a[4:], LAI[6:, :, 1:], equal_nan=True)
    (at / ".zarray").write_text(json.dumps(m | {"compressor": {"id": "blosc"}}))
    with pytest.raises(ValueError, match="no decompressor for blosc"):
        ZarrStore(zarr).read("LAI_norm", [0, 0, 0], [1, 1, 1])


def netcdf(version: int, records: bool) -> bytes:
    """A small file written by the format's grammar: x (3), time (record or 2), v(time, x) int16, w(time, x) double, z(x) float."""
    wide = version == 5
    n = lambda v: struct.pack(">q" if wide else ">i", v)
    text = lambda s: n(len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    tag = lambda t, k: struct.pack(">i", t) + n(k)
    none = struct.pack(">i", 0) + n(0)
    units = tag(12, 1) + text("units") + struct.pack(">i", 2) + text("days since 2021-05-01")
    fill = tag(12, 1) + text("_FillValue") + struct.pack(">i", 3) + n(1) + struct.pack(">h", -1) + b"\0\0"
    v, w, z, t = [[1, -1, 3], [4, 5, 6]], [[.5, 1.5, 2.5], [3.5, 4.5, 5.5]], [10.0, 20.0, 30.0], [0, 9]
    specs = [("x", [1], none, 4, 12), ("z", [1], none, 5, 12), ("time", [0], units, 4, 4 if records else 8), ("v", [0, 1], fill, 3, 8 if records else 12), ("w", [0, 1], none, 6, 24 if records else 48)]
    body = [struct.pack(">3i", 7, 8, 9), struct.pack(">3f", *z)]
    fixed = [0, 12]
    if records:
        fixed += [24, 28, 36]
        for i in range(2):
            body += [struct.pack(">i", t[i]), struct.pack(">3h", *v[i]) + b"\0\0", struct.pack(">3d", *w[i])]
    else:
        fixed += [24, 32, 44]
        body += [struct.pack(">2i", *t), struct.pack(">6h", *v[0], *v[1]), struct.pack(">6d", *w[0], *w[1])]

    def header(start: int) -> bytes:
        out = b"CDF" + bytes([version]) + n(2 if records else 0) + tag(10, 2) + text("time") + n(0 if records else 2) + text("x") + n(3) + none + tag(11, len(specs))
        for (name, dims, attrs, kind, size), at in zip(specs, fixed):
            out += text(name) + n(len(dims)) + b"".join(n(d) for d in dims) + attrs + struct.pack(">i", kind) + n(size) + struct.pack(">i" if version == 1 else ">q", start + at)
        return out

    return header(len(header(0))) + b"".join(body)


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("records", [True, False])
def test_netcdf_classic(spark, tmp_path, version, records):
    path = tmp_path / "a.nc"
    path.write_bytes(netcdf(version, records))
    rows = {(r["time"].day, r["x"]): (r["v"], r["w"], r["z"]) for r in read_array(spark, str(path), "netcdf").collect()}
    assert rows == {(1, 7): (1, .5, 10), (1, 8): (None, 1.5, 20), (1, 9): (3, 2.5, 30), (10, 7): (4, 3.5, 10), (10, 8): (5, 4.5, 20), (10, 9): (6, 5.5, 30)}


def test_netcdf_blocks(tmp_path, monkeypatch):
    from gridspark.sources import arrays

    monkeypatch.setattr(arrays, "STRETCH", 3)
    path = tmp_path / "a.nc"
    path.write_bytes(netcdf(1, True))
    layout = Layout(NetcdfStore(str(path)))
    assert layout.blocks() == [((0, 0), (1, 3)), ((1, 0), (2, 3))]
    assert [b.num_rows for lo, hi in layout.blocks() for b in layout.batches(lo, hi)] == [3, 3]
    (tmp_path / "b.nc").write_bytes(b"\x89HDF")
    with pytest.raises(ValueError, match="no NetCDF classic"):
        NetcdfStore(str(tmp_path / "b.nc"))
