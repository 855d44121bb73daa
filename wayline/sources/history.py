"""Stored history of positions: files along a curve over time, place and plane, and a table of ranges that prunes them before a scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY, BITS = 86_400, 8


def _cell(value: Column, low: float, high: float) -> Column:
    """The cell of a value among 2^BITS equal ones; null and NaN go to the first, values outside to the ends."""
    cells = 1 << BITS
    scaled = (F.nanvl(value.cast("double"), F.lit(low)) - low) * (cells / (high - low))
    return F.coalesce(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(cells - 1.0)), F.lit(0.0)).cast("long")


def _mark(plane: Column) -> Column:
    """One of 64 bits, by the plane."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(plane), F.lit(64)).cast("int"))


def write_history(points: DataFrame, path: str, files: int, plane: str = "icao24", time: str = "state_time") -> None:
    """Writes ``points`` (``plane``, ``time`` in seconds, lat, lon, ...) to at most ``files`` files, and their ranges beside them.

    Rows are sorted by day, then along a curve that interleaves the bits of time of day, latitude, longitude and a hash of the
    plane, so a busy day or plane spreads over many files. Nulls and NaN are kept. ``path`` must be
    new; the ranges come last, so a crash leaves a folder that can't be read, not half a history.
    """
    t = F.nanvl(F.col(time).cast("double"), F.lit(0.0))
    cells = [F.pmod(F.xxhash64(plane), F.lit(1 << BITS)), _cell(F.col("lon"), -180, 180), _cell(F.col("lat"), -90, 90), _cell(F.pmod(t, F.lit(float(DAY))), 0, DAY)]  # the last cuts first
    bits = [F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)), len(cells) * b + k) for b in range(BITS) for k, c in enumerate(cells)]
    order = [F.coalesce(F.floor(t / DAY), F.lit(0)), reduce(lambda a, b: a.bitwiseOR(b), bits)]
    points.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{path}/rows")
    rows = points.sparkSession.read.schema(points.schema).parquet(f"{path}/rows")
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in (time, "lat", "lon") for f in (F.min, F.max)]
    ranges = rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(*ends, F.bit_or(_mark(F.col(plane))).alias("planes"))
    ranges.coalesce(1 + files // 100_000).write.parquet(f"{path}/ranges")


def history_files(spark: SparkSession, path: str, planes: list[str] | None = None, start: float | None = None, end: float | None = None, box: tuple[float, float, float, float] | None = None, time: str = "state_time") -> DataFrame:
    """(file): those that may hold rows of the scan."""
    keep = F.lit(True)
    if planes is not None:
        keep &= reduce(lambda a, b: a | b, [F.col("planes").bitwiseAND(_mark(F.lit(p))) != 0 for p in planes], F.lit(False))
    if start is not None:
        keep &= F.col(f"{time}_max") >= start
    if end is not None:
        keep &= F.col(f"{time}_min") <= end
    if box is not None:
        south, west, north, east = box
        keep &= (F.col("lat_max") >= south) & (F.col("lat_min") <= north)
        beyond, before = F.col("lon_max") >= west, F.col("lon_min") <= east
        keep &= (beyond & before) if west <= east else (beyond | before)
    return spark.read.parquet(f"{path}/ranges").where(keep).select("file")


def scan_history(spark: SparkSession, path: str, planes: list[str] | None = None, start: float | None = None, end: float | None = None, box: tuple[float, float, float, float] | None = None, plane: str = "icao24", time: str = "state_time") -> DataFrame:
    """The rows of the given planes, from ``start`` to ``end``, inside (south, west, north, east); ends belong to it.

    A box with west > east crosses the date line. A row with a null in a column asked for is not in
    the result. Only files whose ranges meet the scan are opened, and within them the filters reach
    the row groups. The driver takes the names of those files, as for any scan. No planes, no rows.
    """
    names = [r["file"] for r in history_files(spark, path, planes, start, end, box, time).collect()]
    rows = spark.read.parquet(f"{path}/rows")
    rows = spark.read.schema(rows.schema).parquet(*[f"{path}/rows/{n}" for n in names]) if names else rows.limit(0)
    if planes is not None:
        rows = rows.where(F.col(plane).isin(planes))
    if start is not None:
        rows = rows.where(F.col(time) >= start)
    if end is not None:
        rows = rows.where(F.col(time) <= end)
    if box is not None:
        south, west, north, east = box
        lon = F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east)
        rows = rows.where(F.col("lat").between(south, north) & lon)
    return rows
