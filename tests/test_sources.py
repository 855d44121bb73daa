"""Branches of the readers: gzip files, and times of every type."""

import datetime
import gzip

from pyspark.sql import types as T

from wayline.sources.tables import as_seconds, read_csv


def test_gzip_csv_by_columns(spark, tmp_path):
    text = "flight_id,lat,lon,extra\n" + "".join(f"f{k},{k}.5,{-k},x\n" for k in range(50))
    with gzip.open(tmp_path / "p.csv.gz", "wt") as f:
        f.write(text)
    (tmp_path / "p.csv").write_text(text)
    schema = T.StructType([T.StructField("flight_id", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
    packed, plain = (read_csv(spark, str(tmp_path / n), schema, ["lat", "flight_id"]) for n in ("p.csv.gz", "p.csv"))
    assert packed.columns == ["lat", "flight_id"] and packed.count() == 50
    assert sorted(packed.collect()) == sorted(plain.collect())
    assert packed.repartition(1).rdd.getNumPartitions() == 1 < spark.sparkContext.defaultParallelism


def test_seconds_of_numbers_timestamps_and_text(spark):
    when = datetime.datetime(2025, 6, 1, 12, 0, 0, 250000)
    row = (1748779200, 1748779200.25, when, "2025-06-01T12:00:00.250Z", "never", None)
    schema = "whole long, part double, stamp timestamp_ntz, text string, bad string, none string"
    df = spark.createDataFrame([row], schema)
    got = df.select(*[as_seconds(df, c).alias(c) for c in df.columns]).first()
    assert tuple(got) == (1748779200.0, 1748779200.25, 1748779200.25, 1748779200.25, None, None)
