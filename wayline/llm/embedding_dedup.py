"""Embedding near-dedup: a subspace pigeonhole join with exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop, read, stored
from .graph import connected_components, smallest_reachable

THRESHOLD = 0.98
BLOCKS = 8
#: A coordinate of a unit vector is rounded to this fraction, so that block distances are exact integers.
UNIT = 1 << 16
#: A cell with more vectors than this is compared in pairs of parts of about half as many.
CELL_ROWS = 32_768
#: A group of up to so many vectors is one task for all blocks; a larger one is cut into cells of about so many.
AIM_ROWS = 16_384
#: A task looks up pairs cell by cell in so many coordinates of a block, unless that gives more than so many pairs a vector.
LOOKUP, PAIRS_A_ROW = 6, 400
_CELL = ("grp", "dim", "block", "cell")


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, computed column by column: the same on every machine and for any batch."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * x[:, j]
    return x / np.sqrt(total)[:, None]


def _rotated(unit: np.ndarray) -> np.ndarray:
    """Integer coordinates after random signs and a Hadamard matrix, scaled by UNIT and the root of their number."""
    width = 1 << max(0, unit.shape[1] - 1).bit_length()
    y = np.zeros((len(unit), width))
    signs = np.random.default_rng(17).integers(0, 2, unit.shape[1]) * 2.0 - 1
    y[:, : unit.shape[1]] = np.rint(unit * UNIT) * signs
    h = np.ones((1, 1))
    while len(h) < width:
        h = np.block([[h, h], [h, -h]])
    return y @ h


class Geometry:
    """Blocks of rotated coordinates and the budget of squared distance that each has."""

    def __init__(self, dim: int, threshold: float, blocks: int):
        self.width = 1 << max(0, dim - 1).bit_length()
        self.blocks = min(blocks, self.width)
        self.size = self.width // self.blocks
        # rounding moves a vector by half a unit a coordinate at most
        far = math.sqrt(max(0.0, 2 * (1 - threshold))) + math.sqrt(dim) / UNIT + 1e-9
        self.budget = far * far * self.width * UNIT * UNIT / self.blocks
        self.radius = math.sqrt(self.budget)
        self.step = max(2.0001 * self.radius, UNIT * math.sqrt(self.width) / 60)

    def cells(self, y: np.ndarray, block: int, grid: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows, cell numbers, whether it is the home cell): the home of each row and the later cells its ball reaches.

        A pair within the radius in this block meets in the later of their home cells.
        """
        at = y[:, block * self.size : block * self.size + min(grid, self.size)] / self.step
        home = np.floor(at)
        inside = at - home
        reach = self.radius / self.step * (1 + 1e-9)
        shift = np.where(inside <= reach, -1, np.where(inside >= 1 - reach, 1, 0))
        code = lambda c: sum(((c[:, k].astype(np.int64) + 62) << 7 * k for k in range(c.shape[1])), np.zeros(len(c), np.int64))
        own = code(home)
        yield np.arange(len(y)), own, True
        for mask in range(1, 1 << at.shape[1]):
            moved = np.array([mask >> j & 1 for j in range(at.shape[1])], bool)
            other = code(home + np.where(moved, shift, 0))
            rows = np.flatnonzero((shift[:, moved] != 0).all(axis=1) & (other > own))
            yield rows, other[rows], False


def _vectors(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Views of the usable vectors of a column in one array of doubles."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(float)
    return [flat[i:j] for i, j in zip([0, *ends.tolist()], ends.tolist())]


def _by_dim(vectors: list[np.ndarray]) -> dict[int, np.ndarray]:
    dims = np.array([len(v) for v in vectors])
    return {int(d): np.flatnonzero(dims == d) for d in np.unique(dims)}


def usable(vector: Column) -> Column:
    """Not null or empty, without null or non-finite components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _looked_up(geometry: Geometry, y: np.ndarray, block: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]] | None:
    """The pairs of rows whose cells in the block touch, each once, some 100,000 at a time; None if there are more than ``limit``."""
    probes = []
    for rows, cells, home in geometry.cells(y, block, LOOKUP):
        if home:
            order = np.argsort(cells, kind="stable")
            held = cells[order]
            last = np.searchsorted(held, held, side="right")
            probes.append((order, np.arange(1, len(held) + 1), last))
        elif len(rows):
            probes.append((rows, np.searchsorted(held, cells), np.searchsorted(held, cells, side="right")))
    if sum(int((high - low).sum()) for _, low, high in probes) > limit:
        return None

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for rows, low, high in probes:
            n = high - low
            ends = np.cumsum(n)
            start = 0
            while start < len(rows):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 100_000, side="right")))
                k = n[start:stop]
                at = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[start:stop], k)
                if len(at):
                    i, j = np.repeat(rows[start:stop], k), order[at]
                    yield np.minimum(i, j), np.maximum(i, j)
                start = stop

    return pairs()


def _tile_links(mask: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few links that join the same points as the marks of ``mask``: of the points ``rows`` with the points 0, 1, ..."""
    row, column = rows.copy(), np.arange(mask.shape[1])
    far = mask.shape[1]
    while True:
        new = np.minimum(row, np.where(mask, column[None, :], far).min(axis=1))
        column2 = np.minimum(column, np.where(mask, new[:, None], far).min(axis=0))
        if (new == row).all() and (column2 == column).all():
            break
        row, column = new, column2
    moved = np.flatnonzero(column != np.arange(far))
    return np.concatenate([rows, moved]), np.concatenate([row, column[moved]])


def similar_vectors(vectors: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, cell_rows: int = CELL_ROWS, aim_rows: int = AIM_ROWS, pairs_a_row: int = PAIRS_A_ROW) -> DataFrame:
    """(id, links, peer) partial results over distinct vectors (id, weight, grp, vec): add ``links`` by id; peers are linked.

    Two vectors with cosine >= ``threshold`` are at a squared distance of at most 2 (1 - threshold)
    on the unit sphere. Rotated and cut into ``blocks``, some block holds at most its share of it,
    and each block is range-joined. A small group is one task for all blocks, so its vectors move
    once. A larger one is spread on a grid over as many first coordinates of each block as its size
    asks for; a cell that stays crowded is compared in pairs of parts. Within a task, pairs come from
    a finer grid, or from matrix products where vectors crowd. A pair found in several blocks belongs
    to the first one whose share it keeps, which every task decides alike on integers, so no pair is
    counted twice and none needs to be emitted. Vectors of other dimensions do not meet.
    """
    counts = stored(vectors.groupBy("grp").agg(F.count("*").alias("of_grp")))
    sized = vectors.select("id", "weight", "grp", "vec").join(broadcast_if_small(counts, counts.count()), "grp")
    cell_type = vectors.schema["grp"].dataType.simpleString()
    vec_type = vectors.schema["vec"].dataType.simpleString()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, of_grp = _vectors(batch.column("vec")), batch.column("of_grp").to_numpy()
            batch = batch.select(["id", "weight", "grp", "vec"])
            # a coordinate tells about three cells apart
            grids = np.ceil(np.log(np.maximum(1, of_grp / aim_rows)) / np.log(3) - 1e-9).astype(np.int64)
            for dim, of in _by_dim(vecs).items():
                geometry = Geometry(dim, threshold, blocks)
                y = _rotated(_unit(np.stack([vecs[i] for i in of])))
                grid_of = np.minimum(grids[of], geometry.size)
                for grid in np.unique(grid_of):
                    mine = np.flatnonzero(grid_of == grid)
                    for block in range(geometry.blocks) if grid else (-1,):
                        for rows, cells, home in geometry.cells(y[mine], block, int(grid)) if grid else ((np.arange(len(mine)), np.zeros(len(mine), np.int64), True),):
                            if len(rows):
                                out = batch.take(pa.array(of[mine[rows]]))
                                same = lambda v, t, n=len(rows): pa.array(np.full(n, v), t)
                                yield pa.RecordBatch.from_arrays([*out.columns, same(dim, pa.int32()), same(block, pa.int32()), pa.array(cells), same(home, pa.bool_())], names=[*out.schema.names, "dim", "block", "cell", "home"])

    tail = "dim int, block int, cell long, home boolean"
    placed = sized.mapInArrow(spread, f"id long, weight long, grp {cell_type}, vec {vec_type}, {tail}")
    crowded = stored(placed.groupBy(*_CELL).count().where(F.col("count") > cell_rows).select(*_CELL, F.ceil(F.col("count") * 2 / cell_rows).cast("int").alias("parts")))
    split = placed.join(broadcast_if_small(crowded, crowded.count()), list(_CELL), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    split = split.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    split = split.withColumns({"low": F.least("part", "with"), "high": F.greatest("part", "with")}).drop("with", "parts")

    def compare(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        block = table.column("block")[0].as_py()
        order = np.lexsort((table.column("id").to_numpy(), ~table.column("home").to_numpy()))
        table = table.take(pa.array(order))
        ids, weight, home, part = (table.column(c).to_numpy() for c in ("id", "weight", "home", "part"))
        x = _unit(np.stack(_vectors(table.column("vec"))))
        geometry = Geometry(x.shape[1], threshold, blocks)
        y = _rotated(x)
        n, n_home = len(ids), int(home.sum())
        links, touched = np.zeros(n, np.int64), np.zeros(n, bool)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        cut = [y[:, b * geometry.size : (b + 1) * geometry.size] for b in range(geometry.blocks)]
        norms = [(c * c).sum(axis=1) for c in cut]
        cosine = lambda i, j: np.einsum("ij,ij->i", x[i], x[j])

        def pairs(of: Iterator[tuple[np.ndarray, np.ndarray]], block: int) -> None:
            apart = lambda b, i, j: ((cut[b][i] - cut[b][j]) ** 2).sum(axis=1) > geometry.budget
            for i, j in of:
                keep = (i < n_home) & (part[i] != part[j] if low != high else True)
                i, j = i[keep], j[keep]
                near = ~apart(block, i, j)
                i, j = i[near], j[near]
                for b in range(block):
                    far = apart(b, i, j)
                    i, j = i[far], j[far]
                linked = cosine(i, j) >= threshold
                i, j = i[linked], j[linked]
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                touched[i] = touched[j] = True
                found.append((i, j))

        def tiles(block: int) -> None:
            for start in range(0, n_home, 512):
                rows = np.arange(start, min(start + 512, n_home))
                near = lambda b, rows=rows: norms[b][rows, None] + norms[b][None, :] - 2 * (cut[b][rows] @ cut[b].T) <= geometry.budget
                mask = near(block)
                mask &= np.arange(n)[None, :] > rows[:, None]
                if low != high:
                    mask &= part[rows, None] != part[None, :]
                if not mask.any():
                    continue
                for b in range(block):
                    mask &= ~near(b)
                cos = x[rows] @ x.T
                close = np.nonzero(mask & (np.abs(cos - threshold) < 1e-9))
                mask &= cos >= threshold
                mask[close] = cosine(rows[close[0]], close[1]) >= threshold
                links[rows] += mask @ weight
                links[:] += weight[rows] @ mask
                touched[rows] |= mask.any(axis=1)
                touched[:] |= mask.any(axis=0)
                found.append(_tile_links(mask, rows))

        for b in range(geometry.blocks) if block < 0 else (block,):
            some = _looked_up(geometry, y, b, pairs_a_row * n)
            tiles(b) if some is None else pairs(some, b)
        root = smallest_reachable(n, found)
        return pa.table({"id": pa.array(ids[touched]), "links": pa.array(links[touched]), "peer": pa.array(ids[root[touched]])})

    return split.groupBy(*_CELL, "low", "high").applyInArrow(compare, "id long, links long, peer long")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label", threshold: float = THRESHOLD, **sizes: int) -> DataFrame:
    """All rows of ``vectors`` with ``n_links``, ``component_id`` and ``kept``.

    Rows of equal, non-null ``group_col`` with cosine >= ``threshold`` in double precision are
    linked; ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id
    reachable and ``kept`` marks its row. Rows with a null id, a null group or an unusable vector
    (null, empty, zero, or with null or non-finite components) link with nothing and are kept.
    Repeated rows are vectors of their own and link with each other. Ids are integers. An empty
    table gives no rows. Columns of the three added names in ``vectors`` are replaced.

    Equal vectors are compared once, with their number as weight. See :func:`similar_vectors`.
    """
    names = [c for c in vectors.columns if c.lower() not in ("n_links", "component_id", "kept")]
    good = usable(F.col(vec_col)) & F.col(group_col).isNotNull() & F.col(id_col).isNotNull()
    base = vectors.select(*names, good.alias("__good")).withColumns({
        # rows that link with nothing have a null second key, and a first key that spreads them
        "__k1": F.when(F.col("__good"), F.xxhash64(F.col(group_col), F.col(vec_col))).otherwise(F.xxhash64(F.col(id_col))),
        "__k2": F.when(F.col("__good"), F.xxhash64(F.lit(7), F.col(vec_col), F.col(group_col))),
    })
    distinct = stored(base.where("__good").groupBy("__k1", "__k2").agg(F.min(F.col(id_col).cast("long")).alias("id"), F.count("*").alias("weight"), F.min(group_col).alias("grp"), F.min_by(vec_col, id_col).alias("vec")))
    partial = stored(similar_vectors(distinct, threshold, **sizes))
    links = partial.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(partial.select("id", "peer"), "id", "peer")
    known = distinct.select("__k1", "__k2", "id", "weight").join(links, "id", "left").join(components.withColumnRenamed("node", "id"), "id", "left")
    known = stored(known.select("__k1", "__k2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("__links"), F.coalesce("component", "id").alias("__component")))
    drop(partial, components, distinct)
    component = F.coalesce("__component", F.col(id_col))
    return base.join(known, ["__k1", "__k2"], "left").select(*names, F.coalesce("__links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col(id_col).eqNullSafe(component).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embedding_dedup(read(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", "kept")


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e, len(embedding) AS dim,
         coalesce(len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), FALSE)))
                  AND list_bool_or(list_transform(embedding, lambda x: x <> 0)), FALSE) AND label IS NOT NULL AND vec_id IS NOT NULL AS usable
  FROM embeddings
), links AS (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.dim = b.dim AND a.r <> b.r AND a.usable AND b.usable
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(a, b) AS (
  SELECT r, r FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), component AS (SELECT reach.a AS r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN component USING (r) LEFT JOIN counts USING (r)
"""
