"""A distance matrix kept beside what it was made from: only pairs of sets that changed are compared again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wayline.operators.cluster import BROADCAST_IDS
from wayline.operators.common import ensure_checkpoint_dir, materialise
from wayline.operators.hausdorff import distance_matrix

#: The version of the distances; raise it when equal points may come out differently.
KERNEL = 2


class Files:
    """The few file operations a store needs, on whatever file system the folder is on."""

    def __init__(self, spark: SparkSession):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str) -> tuple:
        place = self.path(path)
        return place.getFileSystem(self.conf), place

    def names(self, path: str) -> list[tuple[str, int, int]]:
        """(name, length, time of change) of what lies in a folder, by name; none if there is no folder."""
        fs, place = self._at(path)
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(place)) if fs.exists(place) else []

    def rename(self, old: str, new: str) -> bool:
        fs, place = self._at(new)
        fs.mkdirs(place.getParent())
        return not fs.exists(place) and fs.rename(self.path(old), place)

    def delete(self, path: str) -> None:
        fs, place = self._at(path)
        fs.delete(place, True)


def set_digests(points: DataFrame) -> DataFrame:
    """(flight_id, digest, r): of each set's (lat, lon) rows as a multiset, and a number of 31 bits drawn by the id."""
    row = F.to_json(F.struct("lat", "lon"), {"ignoreNullFields": "false"})
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")).cast("string")
    whole = points.where("flight_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").groupBy("flight_id").agg(F.concat_ws("/", F.count("*").cast("string"), part(1), part(2)).alias("digest"))
    return whole.withColumn("r", drawn(F.col("flight_id")))


def drawn(c: Column) -> Column:
    return F.xxhash64(c).bitwiseAND(F.lit(2**31 - 1))


def matrix_metrics(matrix: DataFrame) -> dict[str, Column]:
    """What a pass over a matrix can tell of its soundness; ``drawn`` sums the products of the pairs' drawn numbers."""
    km = F.col("hausdorff_km")
    return {
        "pairs": F.count(F.lit(1)),
        "unordered": F.count_if(F.col("a") >= F.col("b")),
        "bad": F.count_if(km.isNull() | F.isnan(km) | (km < 0) | (km == F.lit(float("inf")))),
        "asymmetric": F.count_if(F.abs(km - F.greatest("directed_a_to_b_km", "directed_b_to_a_km")) > 1e-9),
        "drawn": F.sum((drawn(F.col("a")) * drawn(F.col("b"))).cast("decimal(38,0)")),
    }


def unsound(found: dict, sets: DataFrame) -> dict[str, int]:
    """What is wrong with a matrix of these sets by its metrics: ordered pairs of the right number whose products sum up to what all pairs give are all pairs, each once."""
    n, s, q = sets.agg(F.count("*"), F.sum(F.col("r").cast("decimal(38,0)")), F.sum((F.col("r") * F.col("r")).cast("decimal(38,0)"))).first()
    s, q = int(s or 0), int(q or 0)
    wrong = {k: found[k] for k in ("unordered", "bad", "asymmetric")} | {"missing": n * (n - 1) // 2 - found["pairs"], "other_pairs": (s * s - q) // 2 - int(found["drawn"] or 0)}
    return {k: v for k, v in wrong.items() if v}


class MatrixStore:
    """Versions of the matrix of one collection of sets, in the shared checkpoint folder.

    A version is a folder with the matrix, the digests of its sets and a manifest. It is written aside, checked by metrics of
    the same pass, and published by one rename, so readers see whole versions only; a crash leaves a folder that no
    reader looks at. The newest version and the one before stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.files = spark, Files(spark)
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/matrices/{name}"

    def latest(self) -> tuple[str, dict] | None:
        """The newest version's folder and manifest, if the matrix's files are still those that were written, by this kernel."""
        names = [n for n, _, _ in self.files.names(f"{self.root}/versions")]
        if not names:
            return None
        path = f"{self.root}/versions/{names[-1]}"
        held = json.loads("".join(r[0] for r in self.spark.read.text(f"{path}/manifest").collect()))
        return (path, held) if held["kernel"] == KERNEL and held["files"] == self._signature(path) else None

    def _signature(self, path: str) -> str:
        return json.dumps(self.files.names(f"{path}/matrix"))

    def update(self, points: DataFrame) -> tuple[DataFrame, dict]:
        """The matrix of ``points`` (flight_id, lat, lon, ...), and the manifest of its version.

        If the newest version has the same sets it is read. Else pairs of unchanged sets are taken from it and all pairs with
        a new or changed set are compared; without a usable version all are. ``compared`` in the manifest counts them.
        """
        sets = materialise(set_digests(points))
        held, kept, fresh = self.latest(), None, None
        if held:
            path, manifest = held
            old = self.spark.read.parquet(f"{path}/sets")
            both = sets.join(old.select("flight_id", F.col("digest").alias("before")), "flight_id", "full")
            moved = materialise(both.where(~F.col("digest").eqNullSafe(F.col("before"))).select("flight_id", F.col("digest").isNotNull().alias("fresh")))
            count = moved.count()
            matrix = self.spark.read.parquet(f"{path}/matrix")
            if not count:
                return matrix, manifest
            gone = F.broadcast(moved) if count <= BROADCAST_IDS else moved
            without = lambda df, c: df.join(gone.select(F.col("flight_id").alias(c)), c, "left_anti")
            kept, fresh = without(without(matrix, "a"), "b"), moved.where("fresh").select("flight_id")
        new = distance_matrix(points, fresh=fresh)
        compared = Observation()
        new = new.observe(compared, F.count(F.lit(1)).alias("compared"))
        return self._publish(new if kept is None else kept.select(*new.columns).unionByName(new), sets, compared)

    def _publish(self, matrix: DataFrame, sets: DataFrame, compared: Observation) -> tuple[DataFrame, dict]:
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        seen = Observation()
        matrix.observe(seen, *[c.alias(k) for k, c in matrix_metrics(matrix).items()]).write.parquet(f"{aside}/matrix")
        if wrong := unsound(seen.get, sets):
            self.files.delete(aside)
            raise ValueError(f"unsound distance matrix: {wrong}")
        sets.coalesce(1 + sets.count() // 1_000_000).write.parquet(f"{aside}/sets")
        manifest = {"kernel": KERNEL, "pairs": seen.get["pairs"], "compared": compared.get["compared"], "files": self._signature(aside)}
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{aside}/manifest")
        names = [n for n, _, _ in self.files.names(f"{self.root}/versions")]
        path = f"{self.root}/versions/{int(names[-1]) + 1 if names else 0:012d}"
        if not self.files.rename(aside, path):
            raise RuntimeError(f"another writer published {path}")
        for name in names[:-1]:
            self.files.delete(f"{self.root}/versions/{name}")
        return self.spark.read.parquet(f"{path}/matrix"), manifest


def stored_matrix(points: DataFrame, name: str = "points") -> DataFrame:
    """The checked distance matrix of ``points``, kept under ``name`` and brought up to date."""
    return MatrixStore(points.sparkSession, name).update(points)[0]
