"""Array files: what is written comes back, packed and filled values, and how many bytes the filters leave to read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.sources import netcdf
from wayline.sources.netcdf import ArrayReader, array_bytes, byte_ranges, open_file, parse_header, read_arrays, read_header, runs

AXES = {"valid_time": np.array([0.0, 3600.0, 7200.0]), "level": np.array([300.0, 350.0]), "lat": np.arange(4.0), "lon": np.arange(5.0) / 2}
SHAPE = (3, 2, 4, 5)
U = np.arange(120.0).reshape(SHAPE)
PACKED = np.arange(120).reshape(SHAPE).astype("i2")
PACKED[0, 0, 0, 0] = -9
ATTRIBUTES = {"t": {"scale_factor": 0.5, "add_offset": 100.0, "_FillValue": -9.0}}


@pytest.fixture(params=[1, 2])
def path(request, tmp_path):
    p = tmp_path / "a.nc"
    p.write_bytes(array_bytes(AXES, {"u": U, "t": PACKED}, ATTRIBUTES, request.param))
    return str(p)


def want(keep=lambda *c: True):
    out = []
    for i in np.ndindex(SHAPE):
        c = tuple(float(a[k]) for a, k in zip(AXES.values(), i))
        if keep(*c):
            out.append((*c, float(U[i]), None if PACKED[i] == -9 else 100 + float(PACKED[i]) / 2))
    return sorted(out, key=str)


def got(df):
    return sorted(map(tuple, df.select(*AXES, "u", "t").collect()), key=str)


def test_all_cells(spark, path):
    df = read_arrays(spark, path)
    assert df.columns == [*AXES, "u", "t"] and got(df) == want()
    assert read_arrays(spark, path, "u").columns == [*AXES, "u"]


def test_filters_reach_the_file(spark, path):
    df = read_arrays(spark, path)
    assert got(df.where("valid_time = 3600 AND level IN (350, 999)")) == want(lambda v, p, a, o: v == 3600 and p == 350)
    assert got(df.where("lat >= 1 AND lat < 3 AND lon > 0.5 AND u < 90")) == [r for r in want(lambda v, p, a, o: 1 <= a < 3 and o > 0.5) if r[4] < 90]
    assert df.where("level = 1").count() == 0
    plan = df.where("valid_time = 3600 AND u < 50")._jdf.queryExecution().executedPlan().toString()
    assert "valid_time" in plan and "Filter" in plan


def planned(path, *tests):
    reader = ArrayReader([path], ["u", "t"])
    reader.tests = list(tests)
    return reader, reader.partitions()


def test_bytes_read_are_those_of_the_slice(path, monkeypatch):
    whole = sum(p.bytes for p in planned(path)[1])
    assert whole == 120 * 8 + 120 * 2
    _, slabs = planned(path, ("valid_time", "EqualTo", 7200.0))
    assert sum(p.bytes for p in slabs) == whole / 3
    reader, slabs = planned(path, ("valid_time", "EqualTo", 7200.0), ("level", "EqualTo", 350.0), ("lat", "GreaterThan", 1.0))
    assert sum(p.bytes for p in slabs) == 2 * 5 * 10
    read, plain = [0], netcdf.read_values

    def counted(f, header, v, chosen):
        if v.name in "ut":
            read[0] += sum(n for _, n in byte_ranges(header, v, chosen))
        return plain(f, header, v, chosen)

    monkeypatch.setattr(netcdf, "read_values", counted)
    assert sum(b.num_rows for p in slabs for b in reader.read(p)) == 10 and read[0] == 100
    monkeypatch.setattr(netcdf, "SLAB_BYTES", 1)
    assert len(planned(path)[1]) == 3
    monkeypatch.setattr(netcdf, "PLANNED_FILES", 0)  # so many files that tasks plan their own
    reader, slabs = planned(path, ("valid_time", "EqualTo", 7200.0))
    assert len(slabs) == 1 and sum(b.num_rows for b in reader.read(slabs[0])) == 40


def test_folders_single_record_variables_and_damage(spark, tmp_path):
    for k in range(2):
        axes = {"time": np.array([float(k)]), "x": np.arange(3.0)}
        (tmp_path / f"f{k}.nc").write_bytes(array_bytes(axes, {"v": np.array([[1, 2, 3]], "i2") + k}))
    assert sorted(map(tuple, read_arrays(spark, str(tmp_path)).collect())) == [(k, x, 1.0 + x + k) for k in (0.0, 1.0) for x in (0.0, 1.0, 2.0)]
    bad = tmp_path / "bad"
    bad.write_bytes(b"CDX\1")
    with open_file(str(bad)) as f, pytest.raises(ValueError, match="not a classic"):
        read_header(f)
    good = array_bytes(AXES, {"u": U})
    with pytest.raises(EOFError):
        parse_header(good[:60], len(good))
    cut = tmp_path / "cut"
    cut.write_bytes(good[:60])
    with open_file(str(cut)) as f, pytest.raises(ValueError, match="ends early"):
        read_header(f)
    uncounted = good[:4] + b"\xff\xff\xff\xff" + good[8:]
    assert parse_header(uncounted, len(uncounted)).dims[0] == ("valid_time", 3)
    assert runs(np.array([1, 2, 5, 7, 8])) == [(1, 2), (5, 1), (7, 2)] and runs(np.array([], int)) == []


def test_rows_written_as_files_come_back(spark, tmp_path):
    rows = [(float(t), float(x), float(y), float(t * 100 + x * 10 + y)) for t in range(2) for x in range(3) for y in range(7) if (x, y) != (1, 1)]
    df = spark.createDataFrame(rows, "t double, x double, y double, v double")
    assert netcdf.write_arrays(df, str(tmp_path / "out"), ["t", "x", "y"], "v", band=4) == 4
    back = read_arrays(spark, str(tmp_path / "out")).where(F.col("v").isNotNull())
    assert sorted(map(tuple, back.collect())) == sorted(rows)
