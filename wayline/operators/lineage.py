"""Whether stored results still belong to their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.common import ranked


def content_digest(df: DataFrame, columns: list[str]) -> str:
    """A digest of the rows as a multiset: it does not depend on files, line ends or the order of rows."""
    h = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    part = lambda k: F.sum(F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)"))
    row = df.agg(F.count("*"), *[part(k) for k in range(4)]).first()
    return "-".join(str(v if v is not None else 0) for v in row)


def manifest(points: DataFrame, matrix: DataFrame, ids: DataFrame) -> dict[str, str]:
    """The digests to store beside a matrix; ``ids`` is (matrix_index, flight_id)."""
    return {"points": content_digest(points, points.columns), "matrix": content_digest(matrix, matrix.columns), "ids": content_digest(ids, ["matrix_index", "flight_id"])}


def id_alignment(a: DataFrame, b: DataFrame, index: str = "matrix_index", key: str = "flight_id") -> DataFrame:
    """(index, left, right): positions at which two indexed id sequences differ."""
    one = lambda df, n: df.select(index, F.col(key).alias(n))
    return one(a, "left").join(one(b, "right"), index, "full").where(~F.col("left").eqNullSafe(F.col("right")))


def is_current(stored: dict[str, str] | None, points: DataFrame, matrix: DataFrame, ids: DataFrame, accepted: DataFrame) -> bool:
    """True if the stored manifest fits the points, the matrix and the ids, and the ids are the accepted ones, in order from 0."""
    n = ids.count()
    in_order = ids.agg(F.count_distinct("matrix_index"), F.min("matrix_index"), F.max("matrix_index")).first()
    if n and tuple(in_order) != (n, 0, n - 1):
        return False
    return stored == manifest(points, matrix, ids) and not id_alignment(ids, accepted).take(1)


def indexed_ids(ids: DataFrame, key: str = "flight_id") -> DataFrame:
    """(matrix_index, key) of the distinct ids, in their order, from 0."""
    return ranked(ids.select(key).distinct(), key, name="matrix_index").select("matrix_index", key)
