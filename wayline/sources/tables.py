"""Sources: explicit schemas, column aliases, tolerant casts, file checks, and position views of the event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accepted names of the columns of position tables, in order of preference.
ALIASES = {
    "lat": ("lat", "latitude"),
    "lon": ("lon", "longitude"),
    "t": ("lastposupdate", "point_time_unix", "time", "state_time_unix"),
    "utc": ("utc", "time"),
    "firstseen": ("firstseen_utc", "firstseen"),
    "lastseen": ("lastseen_utc", "lastseen"),
}
POINTS = T.StructType([T.StructField(n, T.StringType() if n in ("flight_id", "icao24", "callsign", "time") else T.DoubleType()) for n in ("flight_id", "icao24", "callsign", "time", "lat", "lon", "lastposupdate", "lastcontact")])
POINTER = "version https://git-lfs.github.com/spec"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header, plain or gzip. Columns go by name and only those asked for are parsed.

    A gzip file is one task, so its rows are dealt out anew.
    """
    header = spark.read.option("header", True).csv(path).columns
    types = {f.name: f.dataType for f in schema}
    read = spark.read.option("header", True).schema(T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])).csv(path)
    out = read.select(*(columns or [f.name for f in schema]))
    return out.repartition(spark.sparkContext.defaultParallelism) if path.endswith(".gz") else out


def with_source_line(spark: SparkSession, path: str, schema: T.StructType, name: str = "source_csv_line") -> DataFrame:
    """The rows with the physical line of their file (the header is line 1); for files of a row per line.

    A line's number is its place within its part of the file, which one task reads in order, and the
    number of lines in the parts before; only those counts, one a part, are joined.
    """
    part = ["path", "start"]
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = lines.groupBy(*part).agg(F.min("at").alias("first"), F.count("*").alias("n")).select(*part, "first", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = lines.join(offsets, part).withColumn(name, F.col("before") + F.col("at") - F.col("first") + 1)
    header = [c.strip('"') for c in spark.read.text(path).first()[0].split(",")]
    types = {f.name: f.dataType.simpleString() for f in schema}
    parsed = F.from_csv("value", ", ".join(f"`{c}` {types.get(c, 'string')}" for c in header))
    return numbered.where(F.col(name) > 1).select(parsed.alias("r"), name).select("r.*", name).select(*types, name)


def latest_file_per_key(files: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Of files (path) whose name matches ``pattern`` the lexically last path of each key, its first group."""
    name = F.element_at(F.split(path, "/"), -1)
    keyed = files.select(F.regexp_extract(name, pattern, 1).alias("key"), F.col(path).alias("path"))
    return keyed.where("key <> ''").groupBy("key").agg(F.max("path").alias("path"), F.count("*").alias("files"))


def refuse_pointer(spark: SparkSession, path: str) -> None:
    """Raises if the file is only a pointer to a large object stored elsewhere."""
    first = spark.read.text(path).head(1)
    if first and first[0][0].startswith(POINTER):
        raise ValueError(f"{path} is a pointer to a large file, not the file")


def latest_rows(spark: SparkSession, glob: str, pattern: str, schema: T.StructType, columns: list[str]) -> DataFrame:
    """The rows of the lexically last file of each key among the CSV files of ``glob``, with ``key`` and ``source_file``.

    Only the chosen files are read. A key is the first group of ``pattern`` in the file's name; files
    that do not match are left out, and without any match there is no row.
    """
    files = spark.read.format("binaryFile").load(glob).select("path")
    chosen = [r["path"] for r in latest_file_per_key(files, pattern).select("path").collect()]  # a name per key, as in Spark's own listing
    kinds = {f.name: f.dataType for f in schema}
    empty = T.StructType([T.StructField("key", T.StringType()), T.StructField("source_file", T.StringType()), *(T.StructField(c, kinds[c]) for c in columns)])
    if not chosen:
        return spark.createDataFrame([], empty)
    header = spark.read.option("header", True).csv(chosen[0]).columns
    read = spark.read.option("header", True).schema(T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])).csv(chosen)
    name = F.col("_metadata.file_name")
    return read.select(F.regexp_extract(name, pattern, 1).alias("key"), name.alias("source_file"), *columns)


def read_json_report(spark: SparkSession, path: str) -> DataFrame:
    """The objects of JSON files, one a file or one a line."""
    return spark.read.option("multiLine", True).json(path)


def rows_of(df: DataFrame, ids: DataFrame, key: str = "flight_id") -> DataFrame:
    """The rows whose key is in ``ids``; Spark broadcasts the ids while they are few."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


#: Larger files are not held in a cell.
WHOLE_FILE_BYTES = 256_000_000


def file_digests(spark: SparkSession, path: str, whole_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """(path, sha256) of every file that ``path`` matches.

    Files of up to ``whole_bytes`` are hashed by the executors. A hash of a larger file cannot be
    made of parts, so the driver reads it as a stream, in constant memory.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= whole_bytes).select("path", F.sha2("content", 256).alias("sha256"))
    large = [r["path"] for r in files.where(F.col("length") > whole_bytes).select("path").collect()]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for name in large:
        place = jvm.org.apache.hadoop.fs.Path(name)
        stream = place.getFileSystem(conf).open(place)
        try:
            found.append((name, jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
        finally:
            stream.close()
    return small.unionByName(spark.createDataFrame(found, "path string, sha256 string"))


def resolve(df: DataFrame, **wanted: str) -> DataFrame:
    """Renames the first alias present of each wanted column; ``wanted`` maps new names to kinds of :data:`ALIASES`."""
    out = df
    for name, kind in wanted.items():
        found = [c for c in ALIASES[kind] if c in df.columns]
        if not found:
            raise ValueError(f"none of the columns {ALIASES[kind]} is there")
        if found[0] != name:
            out = out.withColumn(name, F.col(found[0]))
    return out


def as_seconds(df: DataFrame, column: str) -> Column:
    """Epoch seconds of a number, a timestamp or an ISO string; null where a string is not a time."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        return F.col(column).cast("double")
    stamp = F.try_to_timestamp(F.col(column)) if isinstance(kind, T.StringType) else F.col(column).cast("timestamp")
    return F.unix_micros(stamp) / 1e6


def strict_seconds(df: DataFrame, column: str) -> Column:
    """Epoch seconds as :func:`as_seconds`, but a string that is not a time stops the job; null stays null."""
    seconds = as_seconds(df, column)
    bad = F.raise_error(F.concat(F.lit(f"{column} is not a time: "), F.col(column).cast("string")))
    return F.when(F.col(column).isNotNull() & seconds.isNull(), bad.cast("double")).otherwise(seconds)


def utc_text(seconds: Column) -> Column:
    """Epoch seconds as ``2025-06-01 00:00:00+00:00``, with six digits of a second where there is a part of one."""
    text = (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.round(seconds.cast("decimal(18,6)"), 6))).cast("string")
    return F.concat(F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text), F.lit("+00:00"))


def normal_points(df: DataFrame) -> DataFrame:
    """(flight_id, t, lat, lon) with aliases resolved, bad values dropped, and one row of each repeated point."""
    named = resolve(df, lat="lat", lon="lon", t="t")
    out = named.select("flight_id", as_seconds(named, "t").alias("t"), *[F.expr(f"try_cast({c} AS DOUBLE)").alias(c) for c in ("lat", "lon")])
    return out.dropna().where("lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180").dropDuplicates()


def text_key(column: Column) -> Column:
    """Trimmed, upper-cased, null as empty."""
    return F.upper(F.trim(F.coalesce(column, F.lit(""))))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position table made of ``events``: one flight per user, with planted defects of every kind.

    The arithmetic is exact in doubles, so other engines get the same rows.
    """
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL").select(F.col("user_id").alias("flight_id"), "event_id", "ts")
    rn = (F.row_number().over(Window.partitionBy("flight_id").orderBy("ts", "event_id")) - 1).cast("double")
    n = F.count("*").over(Window.partitionBy("flight_id")).cast("double")
    i, k = F.col("event_id"), F.col("flight_id")
    planted = lambda step: i % step == 0
    noise = lambda prime: ((i * prime) % 1000 - 500).cast("double") / F.lit(100000.0)
    f = F.col("f")
    lat = F.when(planted(97), 20.0).otherwise(F.lit(51.4706) - F.lit(1.4326) * f + (k % 5 - 2).cast("double") * F.lit(0.6) * f * (1 - f) + noise(7919))
    lon = F.when(planted(97), 106.0).otherwise(F.lit(-0.4619) + F.lit(9.0241) * f + noise(104729))
    update = k.cast("double") * 100000.0 + F.lit(25.0) * F.col("rn") + F.when((k % 10 == 0) & (F.col("rn") * 2 > F.col("n")), 40.0).otherwise(0.0) - F.when(planted(83) & (F.col("rn") > 0), 25.0).otherwise(0.0)
    age = F.when(planted(89), 20.0).otherwise((i % 4).cast("double"))
    base = e.select("*", rn.alias("rn"), n.alias("n")).withColumn("f", F.coalesce(F.try_divide(F.col("rn"), F.col("n") - 1), F.lit(0.0)))
    base = base.select("flight_id", "event_id", F.when((i % 109 != 0) & (k % 50 != 13), lat).alias("lat"), lon.alias("lon"), update.alias("lastposupdate"), (update + age).alias("state_time"))
    contact = F.col("state_time") - F.when(planted(107), 20.0).otherwise((i % 3).cast("double"))
    plane = F.when(planted(103), F.lit(None)).when(planted(101), "zz").otherwise(F.concat(F.lit("a0000"), (k % 7).cast("string")))
    callsign = F.when(planted(11), F.lit(None)).otherwise(F.concat(F.lit(" cs"), (k % 7).cast("string")))
    return base.select("*", contact.alias("lastcontact"), plane.alias("icao24"), callsign.alias("callsign"))


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flight list that belongs to :func:`positions`: flight_id, icao24, start_unix, end_unix."""
    e = table(spark, sf_dir, "events").where("user_id IS NOT NULL").groupBy(F.col("user_id").alias("flight_id")).agg(F.count("*").alias("n"))
    start = F.col("flight_id").cast("double") * 100000.0
    return e.select("flight_id", F.concat(F.lit("a0000"), (F.col("flight_id") % 7).cast("string")).alias("icao24"), start.alias("start_unix"), (start + F.col("n").cast("double") * 25.0 + 10.0).alias("end_unix"))
