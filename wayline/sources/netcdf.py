"""Array files as a source: classic NetCDF, a partition per run of slabs, filters on coordinates turned into byte ranges.

``read_arrays(spark, path)`` gives a row per cell: a column per dimension, with its coordinate, and one per
variable, unpacked, null where the file has a fill value. Only the header and the coordinates are read to
plan; a task reads the byte ranges of the cells that the filters on dimensions leave.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bytes of a partition, as far as whole slabs allow; files whose slabs the driver plans, beyond that a file is a partition.
SLAB_BYTES, PLANNED_FILES = 16_000_000, 1_000

# Fixed values of the format: the tags of its lists and the types of its values.
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DEFAULT_FILL = {">f4": 9.969209968386869e36, ">f8": 9.969209968386869e36, ">i2": -32767, ">i4": -2147483647}


@dataclass
class Variable:
    name: str
    dims: list[int]
    attributes: dict
    dtype: str
    begin: int
    record_bytes: int  # of one record with its padding, 0 if it has no record dimension


@dataclass
class Header:
    dims: list[tuple[str, int]]
    variables: dict[str, Variable]
    stride: int  # bytes from one record to the next

    def shape(self, v: Variable) -> list[int]:
        return [self.dims[d][1] for d in v.dims]


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 4
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file")
        self.count, self.offset = (">q" if data[3] == 5 else ">i"), (">i" if data[3] == 1 else ">q")

    def number(self, code: str = ">i") -> int:
        size = struct.calcsize(code)
        if self.at + size > len(self.data):
            raise EOFError
        value = struct.unpack_from(code, self.data, self.at)[0]
        self.at += size
        return value

    def raw(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        out = self.data[self.at : self.at + n]
        self.at += n + -n % 4
        return out

    def text(self) -> str:
        return self.raw(self.number(self.count)).decode()

    def entries(self, tag: int) -> range:
        found, n = self.number(), self.number(self.count)
        if found not in (0, tag):
            raise ValueError("damaged NetCDF header")
        return range(n)


def parse_header(data: bytes, size: int) -> Header:
    """The header at the begin of a file of ``size`` bytes; EOFError if ``data`` ends before it."""
    c = _Cursor(data)
    records = c.number(c.count)
    dims = [(c.text(), c.number(c.count)) for _ in c.entries(DIMENSIONS)]

    def attributes() -> dict:
        out = {}
        for _ in c.entries(ATTRIBUTES):
            name, kind = c.text(), TYPES[c.number()]
            n = c.number(c.count)
            values = np.frombuffer(c.raw(n * np.dtype(kind).itemsize), kind)
            out[name] = values.tobytes().decode(errors="replace") if kind == "S1" else values.tolist()
        return out

    attributes()
    found = []
    for _ in c.entries(VARIABLES):
        name = c.text()
        ids = [c.number(c.count) for _ in range(c.number(c.count))]
        held, kind = attributes(), TYPES[c.number()]
        c.number(c.count)  # the stated size, which is too small a number for large variables
        found.append(Variable(name, ids, held, kind, c.number(c.offset), 0))
    for v in found:
        if v.dims and dims[v.dims[0]][1] == 0:
            bare = int(np.prod([dims[d][1] for d in v.dims[1:]], dtype=np.int64)) * np.dtype(v.dtype).itemsize
            v.record_bytes = bare + -bare % 4
    growing = [v for v in found if v.record_bytes]
    if len(growing) == 1:  # a lone record variable is not padded
        v = growing[0]
        v.record_bytes = int(np.prod([dims[d][1] for d in v.dims[1:]], dtype=np.int64)) * np.dtype(v.dtype).itemsize
    stride = sum(v.record_bytes for v in growing)
    if records < 0 and growing:  # a file whose writer did not count
        records = (size - min(v.begin for v in growing)) // stride
    return Header([(n, k or max(records, 0)) for n, k in dims], {v.name: v for v in found}, stride)


def runs(index: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of the runs of consecutive numbers."""
    cut = np.flatnonzero(np.diff(index) != 1) + 1
    starts = np.concatenate([[0], cut]) if len(index) else cut
    ends = np.append(cut, len(index)) if len(index) else cut
    return [(int(index[s]), int(e - s)) for s, e in zip(starts, ends)]


def byte_ranges(header: Header, v: Variable, chosen: list[np.ndarray]) -> list[tuple[int, int]]:
    """(offset, length) of the chosen indexes of every dimension, in order; whole inner dimensions and neighbours are one range."""
    shape, item = header.shape(v), np.dtype(v.dtype).itemsize
    steps = [item * int(np.prod(shape[k + 1 :], dtype=np.int64)) for k in range(len(shape))]
    if v.record_bytes:
        steps[0] = header.stride
    cut = max((k for k in range(len(shape)) if len(chosen[k]) != shape[k]), default=0)
    if v.record_bytes and cut == 0 and steps[0] != item * int(np.prod(shape[1:], dtype=np.int64)):
        cut = min(1, len(shape) - 1)  # records of other variables lie between
        if len(shape) == 1:
            return [(v.begin + int(i) * steps[0], item) for i in chosen[0]]
    out = [v.begin]
    for k in range(cut):
        out = [base + int(i) * steps[k] for base in out for i in chosen[k]]
    return [(base + first * steps[cut], n * steps[cut]) for base in out for first, n in runs(chosen[cut])] if shape else [(v.begin, item)]


def open_file(path: str):
    fs, place = FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (FileSystem.from_uri("file://" + path)[0], path)
    return fs.open_input_file(place)


def read_header(f) -> Header:
    size, n = f.size(), 65_536
    while True:
        try:
            return parse_header(f.read_at(min(n, size), 0), size)
        except EOFError:
            if n >= size:
                raise ValueError("NetCDF header ends early") from None
            n *= 4


def read_values(f, header: Header, v: Variable, chosen: list[np.ndarray]) -> np.ndarray:
    """The chosen cells, unpacked, NaN for fill values, as doubles of the chosen shape."""
    data = b"".join(f.read_at(n, at) for at, n in byte_ranges(header, v, chosen))
    raw = np.frombuffer(data, v.dtype)
    out = raw.astype(float)
    first = lambda key, default: v.attributes[key][0] if v.attributes.get(key) and not isinstance(v.attributes[key], str) else default
    for key in ("_FillValue", "missing_value"):
        fill = first(key, DEFAULT_FILL.get(v.dtype) if key == "_FillValue" else None)
        if fill is not None:
            out[raw == np.array(fill).astype(v.dtype)] = np.nan
    return (out * first("scale_factor", 1.0) + first("add_offset", 0.0)).reshape([len(c) for c in chosen])


def _fields(header: Header, wanted: list[str]) -> list[Variable]:
    """The asked variables, or all of the largest number of dimensions that are not coordinates; they share their dimensions."""
    names = {n for n, _ in header.dims}
    fields = [v for v in header.variables.values() if v.name not in names and v.dtype != "S1"]
    most = max((len(v.dims) for v in fields), default=0)
    out = [header.variables[n] for n in wanted] if wanted else [v for v in fields if len(v.dims) == most]
    if not out or any(v.dims != out[0].dims for v in out):
        raise ValueError("name variables that share their dimensions")
    return out


@dataclass
class Slab(InputPartition):
    path: str
    lead: tuple[int, int] | None = None  # places among the chosen indexes of the first dimension; None: all, planned in the task
    bytes: int = field(default=0, compare=False)

    def __post_init__(self):
        super().__init__(None)


class ArrayReader(DataSourceReader):
    def __init__(self, paths: list[str], wanted: list[str]):
        self.paths, self.wanted, self.tests = paths, wanted, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        with open_file(self.paths[0]) as f:
            header = read_header(f)
        dims = {header.dims[d][0] for d in _fields(header, self.wanted)[0].dims}
        for one in filters:
            name = ".".join(one.attribute)
            if name in dims and isinstance(one, IsNotNull):
                continue
            value = getattr(one, "value", None)
            if name in dims and isinstance(one, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.tests.append((name, type(one).__name__, [*value] if isinstance(one, In) else value))
            else:
                yield one

    def _chosen(self, f, header: Header, v: Variable) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each dimension the indexes that pass the filters, and their coordinates."""
        index, where = [], []
        for d in v.dims:
            name, n = header.dims[d]
            axis = header.variables.get(name)
            at = read_values(f, header, axis, [np.arange(n)]) if axis is not None and axis.dims == [d] else np.arange(n, dtype=float)
            keep = np.ones(n, bool)
            for column, kind, value in self.tests:
                if column == name:
                    keep &= {"EqualTo": lambda: at == value, "In": lambda: np.isin(at, value), "GreaterThan": lambda: at > value, "GreaterThanOrEqual": lambda: at >= value, "LessThan": lambda: at < value, "LessThanOrEqual": lambda: at <= value}[kind]()  # noqa: B023
            index.append(np.flatnonzero(keep))
            where.append(at[keep])
        return index, where

    def partitions(self) -> list[Slab]:
        if len(self.paths) > PLANNED_FILES:
            return [Slab(p) for p in self.paths]
        out = []
        for path in self.paths:
            with open_file(path) as f:
                header = read_header(f)
                fields = _fields(header, self.wanted)
                index, _ = self._chosen(f, header, fields[0])
                if not fields[0].dims:
                    out.append(Slab(path))
                    continue
                one = [index[0][:1], *index[1:]]
                size = sum(n for v in fields for _, n in byte_ranges(header, v, one)) if all(map(len, index)) else 0
                step = max(1, SLAB_BYTES // max(1, size))
                out += [Slab(path, (k, min(k + step, len(index[0]))), size * (min(k + step, len(index[0])) - k)) for k in range(0, len(index[0]), step)] if size else []
        return out

    def read(self, partition: Slab | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # the filters left none
            return
        with open_file(partition.path) as f:
            header = read_header(f)
            fields = _fields(header, self.wanted)
            index, where = self._chosen(f, header, fields[0])
            first, last = partition.lead or (0, len(index[0]) if index else 1)
            for k in range(first, last):
                at, places = ([index[0][k : k + 1], *index[1:]], [where[0][k : k + 1], *where[1:]]) if index else ([], [])
                grid = np.meshgrid(*places, indexing="ij") if places else []
                values = [read_values(f, header, v, at).ravel() for v in fields]
                yield pa.RecordBatch.from_arrays([pa.array(g.ravel()) for g in grid] + [pa.array(v, from_pandas=True) for v in values], names=[header.dims[d][0] for d in fields[0].dims] + [v.name for v in fields])


class ArraySource(DataSource):
    """Options: ``path`` (a file, or a folder of .nc files with the same dimensions and variables) and ``variables``, by commas."""

    @classmethod
    def name(cls) -> str:
        return "netcdf_classic"

    def _paths(self) -> list[str]:
        path = self.options["path"]
        fs, place = FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)
        info = fs.get_file_info(place)
        if info.type == FileType.File:
            return [path]
        found = sorted(i.path for i in fs.get_file_info(FileSelector(place, recursive=True)) if i.type == FileType.File and i.path.endswith(".nc"))
        if not found:
            raise ValueError(f"no .nc file in {path}")
        return [path.rstrip("/") + p[len(place.rstrip("/")) :] for p in found]

    def _wanted(self) -> list[str]:
        return [v.strip() for v in self.options.get("variables", "").split(",") if v.strip()]

    def schema(self) -> StructType:
        with open_file(self._paths()[0]) as f:
            header = read_header(f)
        fields = _fields(header, self._wanted())
        return StructType([StructField(n, DoubleType()) for n in [header.dims[d][0] for d in fields[0].dims] + [v.name for v in fields]])

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self._paths(), self._wanted())


def read_arrays(spark: SparkSession, path: str, variables: str = "") -> DataFrame:
    """The cells of the array files at ``path`` as rows; see :class:`ArraySource`."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArraySource)
    return spark.read.format("netcdf_classic").option("variables", variables).load(path)


def array_bytes(axes: dict[str, np.ndarray], fields: dict[str, np.ndarray], attributes: dict[str, dict[str, float]] | None = None, version: int = 2) -> bytes:
    """A classic file of double coordinates and double or short fields over all axes, whose first grows by records."""
    names, kinds = list(axes), {"f8": 6, "i2": 3}
    word = lambda x, code=">i": struct.pack(code, x)
    text = lambda s: word(len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)
    every = [(n, [k], np.asarray(a, ">f8")) for k, (n, a) in enumerate(axes.items())] + [(n, [*range(len(names))], np.asarray(a).astype(">i2" if np.asarray(a).dtype.kind == "i" else ">f8")) for n, a in fields.items()]
    record = {n: d[0] == 0 for n, d, _ in every}
    bare = {n: (a[0].nbytes if record[n] else a.nbytes) for n, d, a in every}
    lone = sum(record.values()) == 1
    size = {n: b if lone and record[n] else b + -b % 4 for n, b in bare.items()}

    def listed(attrs: dict[str, float], short: bool) -> bytes:
        if not attrs:
            return word(0) + word(0)
        as_own = lambda k: short and k == "_FillValue"
        return word(ATTRIBUTES) + word(len(attrs)) + b"".join(text(k) + word(3 if as_own(k) else 6) + word(1) + (struct.pack(">h", int(v)) + b"\0\0" if as_own(k) else struct.pack(">d", v)) for k, v in attrs.items())

    def head(begin: dict[str, int]) -> bytes:
        out = b"CDF" + bytes([version]) + word(len(axes[names[0]])) + word(DIMENSIONS) + word(len(names))
        out += b"".join(text(n) + word(0 if k == 0 else len(axes[n])) for k, n in enumerate(names)) + word(0) + word(0)
        out += word(VARIABLES) + word(len(every))
        for n, d, a in every:
            out += text(n) + word(len(d)) + b"".join(map(word, d)) + listed((attributes or {}).get(n, {}), a.dtype.itemsize == 2) + word(kinds[a.dtype.str[1:]]) + word(size[n] & 0x7FFFFFFF) + word(begin.get(n, 0), ">i" if version == 1 else ">q")
        return out

    at, begin = len(head({})), {}
    for n in sorted(size, key=lambda n: record[n]):
        begin[n] = at
        at += size[n]
    pad = lambda n, b: b + b"\0" * (size[n] - len(b))
    fixed = b"".join(pad(n, a.tobytes()) for n, d, a in every if not record[n])
    grown = b"".join(pad(n, a[k : k + 1].tobytes()) for k in range(len(axes[names[0]])) for n, d, a in every if record[n])
    return head(begin) + fixed + grown


def write_arrays(rows: DataFrame, folder: str, axes: list[str], value: str, band: int = 512) -> int:
    """Writes rows (axes, value) as files of at most ``band`` whole units of the last axis and one value of the first; their number.

    A file is one group, so its size is bounded by the axes between. Cells without a row are fill values.
    """
    from pyspark.sql import functions as F

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        at = [np.sort(pdf[a].unique()).astype(float) for a in axes]
        cells = np.full([len(a) for a in at], DEFAULT_FILL[">f8"])
        cells[tuple(np.searchsorted(a, pdf[n].to_numpy(float)) for a, n in zip(at, axes))] = pdf[value].to_numpy(float)
        name = f"{folder.rstrip('/')}/part-{at[0][0]:.0f}-{int(pdf['__band'].iloc[0])}.nc"
        fs, place = FileSystem.from_uri(name if "://" in name or name.startswith("file:") else "file://" + name)
        fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(place) as f:
            f.write(array_bytes(dict(zip(axes, at)), {value: cells}))
        return pd.DataFrame({"file": [name]})

    banded = rows.select(*axes, value).withColumn("__band", F.floor(F.col(axes[-1]) / band).cast("long"))
    return banded.groupBy(axes[0], "__band").applyInPandas(write, "file string").count()
