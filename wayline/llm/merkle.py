"""Merkle manifest of a dataset: blocks of leaves in order, collapsed by SQL array functions, recursed over block roots.

A tree joins every ``ARITY`` consecutive nodes of a level. A block holds ``ARITY ** LEVELS`` consecutive
nodes as one array; higher-order functions collapse its levels, and the block roots are the next nodes.
So each task holds a block, whatever share of all rows a source has. Proofs come back the same way: the
siblings inside a block are joined with those of its root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, drop, read, stored

ARITY, LEVELS = 3, 5

#: The columns that make a leaf, in this order.
CONTENT = ["doc_id", "source", "lang", "n_chars", "text"]

#: Bytes of the sources' names up to which their table may be broadcast.
MAX_SOURCE_BYTES = 8_000_000

_PROOF = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other, in UTF-8."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_hash(values: dict[str, Column]) -> Column:
    """The digest of the columns: ``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = [v.cast("string") for v in values.values()]
    return digest(*[F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in text])


def _levels(leaves: Column, times: Column) -> Column:
    """The levels of a block: its leaves and, ``times`` over, the digests of every ``ARITY`` nodes."""
    count = lambda nodes: F.ceil(F.size(nodes) / ARITY).cast("int")
    joined = lambda nodes, i: digest(F.array_join(F.slice(nodes, ARITY * i + 1, ARITY), ""))
    above = lambda nodes: F.transform(F.sequence(F.lit(0), count(nodes) - 1), lambda i: joined(nodes, i))
    return F.aggregate(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")), F.array(leaves), lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))


def _siblings(levels: Column, place: Column) -> Column:
    """For each level of a block below its root: what stands left and right of the node above ``place`` in its run."""

    def step(k: Column) -> Column:
        nodes, width = F.element_at(levels, k), F.pow(F.lit(ARITY), k - 1).cast("int")
        own = F.floor(place / width).cast("int")
        first = own - own % ARITY
        return F.struct(F.array_join(F.slice(nodes, first + 1, own - first), "").alias("left"), F.array_join(F.slice(nodes, own + 2, first + ARITY - 1 - own), "").alias("right"))

    depth = F.size(levels) - 1
    return F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), step)).otherwise(F.array().cast(_PROOF))


def in_order(rows: DataFrame, tree: list[str], order: list[Column | str]) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` with the ``tree`` number, ``place`` and ``size`` of each in the group of the columns ``tree``, which ``order`` begins with.

    The rows are sorted by ranges and written; a place is the place in the written partition and the number of rows of
    the group in those before. The join of these counts is by partition and group, so no group is hot.
    """
    at = stored(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    pieces = at.groupBy(part, *tree).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    group = Window.partitionBy(*tree)
    before = F.sum("__n").over(group.orderBy("__part")) - F.col("__n")
    pieces = stored(pieces.select("__part", "__first", *[F.col(c).alias(f"__{c}") for c in tree], before.alias("__before"), F.sum("__n").over(group).alias("size"), F.min("__first").over(group).alias("tree")))
    count = pieces.agg(F.count("*"), *[F.sum(F.octet_length(f"__{c}")) for c in tree]).first()
    held = pieces if sum(n or 0 for n in count[1:]) > MAX_SOURCE_BYTES else broadcast_if_small(pieces, count[0])
    same = [at[c].eqNullSafe(held[f"__{c}"]) for c in tree]
    on = F.shiftright(at["__at"], 33) == held["__part"]
    for condition in same:
        on &= condition
    out = at.join(held, on).withColumn("place", F.col("__before") + F.col("__at") - F.col("__first"))
    return out.drop("__at", "__part", "__first", "__before", *[f"__{c}" for c in tree]), [at, pieces]


def merkle_proofs(nodes: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Root and proof of every node of many trees.

    ``nodes`` has ``tree``, ``place`` (from 0 in each tree), ``size`` (of the tree), ``hash`` and the columns
    ``carried``. Returned are the rows (tree, hash, the carried columns, ``root`` and ``proof``, level by level what
    stands left and right in the run), the roots (tree, hash), and the stored tables that both rest on. A tree of one
    node is its own root.
    """
    block = ARITY**LEVELS
    times = sum((F.col("size") > ARITY**k).cast("int") for k in range(LEVELS))
    blocks = stored(
        nodes.groupBy("tree", "size", F.floor(F.col("place") / block).cast("long").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "hash", *[c for c in carried if c != "place"]))).alias("leaves"))
        .withColumn("levels", _levels(F.col("leaves.hash"), times))
    )
    tables = [blocks]
    above = blocks.select("tree", F.col("block").alias("place"), F.ceil(F.col("size") / block).cast("long").alias("size"), F.element_at(F.element_at("levels", -1), 1).alias("hash"))
    if blocks.where(F.col("size") > block).take(1):
        upper, roots, more = merkle_proofs(above, ["place"])
        tables += more
    else:
        upper, roots = above.withColumn("root", F.col("hash")).withColumn("proof", F.array().cast(_PROOF)), above.select("tree", "hash")
    # one row a block on either side, so no key is hot
    up = upper.select(F.col("tree").alias("__tree"), F.col("place").alias("__block"), "root", F.col("proof").alias("__above"))
    whole = blocks.join(up, (blocks["tree"] == up["__tree"]) & (blocks["block"] == up["__block"]))
    rows = whole.select("tree", "levels", "root", "__above", F.posexplode("leaves").alias("__at", "__leaf"))
    leaf = [F.col("__leaf")[c].alias(c) for c in ("hash", *carried)]
    return rows.select("tree", *leaf, "root", F.concat(_siblings(F.col("levels"), F.col("__at")), F.col("__above")).alias("proof")), roots, tables


def fold(proof: Column, leaf: Column) -> Column:
    """The root that a proof gives for a leaf."""
    return F.aggregate(proof, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def merkle_manifest(docs: DataFrame, content: list[str] = CONTENT, id_col: str = "doc_id", source_col: str = "source", check: Column | None = None) -> DataFrame:
    """``id_col``, ``leaf``, ``checked``, ``subroot``, ``root`` and ``proof`` of every row.

    A source's leaves ascend by id (null first, repeated ids by their leaf) and make a tree; the subroots, by source (null
    first, by bytes), make the last one. ``proof`` has, level by level up to the root, what stands left and right of the
    node in its run; :func:`fold` folds it. ``check`` is another leaf beside each row's own (``checked``), such as one of a
    copy under test. Any column may be null, which differs from empty; repeated rows are leaves of their own; extra
    columns are ignored; an empty table gives no rows. Texts are read once and only digests are shuffled.
    """
    leaf = leaf_hash({c: docs[f"`{c}`"] for c in content})
    leaves = stored(docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{source_col}`"].cast("string").alias("source"), leaf.alias("hash"), (leaf if check is None else check).alias("checked")))
    nodes, sorting = in_order(leaves, ["source"], [F.asc_nulls_first("source"), F.asc_nulls_first("id"), F.col("hash")])
    inside, subroots, tables = merkle_proofs(nodes, ["id", "checked"])
    drop(leaves, *sorting)
    # a tree's number is where its first leaf stood, so it ascends with the sources
    tops, more = in_order(subroots.select(F.col("tree").alias("source_tree"), "hash", F.lit(0).alias("all")), ["all"], ["all", "source_tree"])
    across, _, most = merkle_proofs(tops, ["source_tree"])
    across = stored(across.select(F.col("source_tree"), F.col("root").alias("__root"), F.col("proof").alias("__outer")))
    drop(*more, *most)
    joined = inside.join(broadcast_if_small(across, across.count(), 20_000), F.col("tree") == F.col("source_tree"))
    return joined.select(F.col("id").alias(id_col), F.col("hash").alias("leaf"), "checked", F.col("root").alias("subroot"), F.col("__root").alias("root"), F.concat("proof", "__outer").alias("proof"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    tampered = leaf_hash({c: docs[c] for c in CONTENT} | {"text": F.replace(docs["text"], F.lit("\n"), F.lit(""))})
    chosen = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    out = merkle_manifest(docs, check=F.when(chosen, tampered))
    out = out.withColumn("folded_root", fold(F.col("proof"), F.coalesce("checked", "leaf")))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return out.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc
  FROM range(256) t(i)
), d AS (
  SELECT doc_id, source,
         concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END, CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
                CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END) AS head,
         text, replace(text, chr(10), '') AS cut,
         doc_id IS NOT NULL AND coalesce(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 2 = 0, FALSE) AS chosen
  FROM documents, crc_table
), leaves AS (
  SELECT doc_id, source, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
         CASE WHEN chosen THEN sha256(concat(head, CASE WHEN cut IS NULL THEN '-' ELSE concat(strlen(cut), ':', cut) END)) END AS checked
  FROM d
), placed AS (
  SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY source) AS size, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree
  FROM leaves WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)
), inner_nodes AS (
  SELECT 0 AS level, tree, place, size, leaf AS hash FROM placed
  UNION ALL
  SELECT level + 1, tree, place // 3, CAST(ceil(size / 3) AS BIGINT), sha256(string_agg(hash, '' ORDER BY place)) FROM inner_nodes WHERE size > 1 GROUP BY level, tree, place // 3, size
), subroots AS (
  SELECT tree, hash, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM inner_nodes WHERE size = 1
), outer_nodes AS (
  SELECT 0 AS level, place, size, hash FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, CAST(ceil(size / 3) AS BIGINT), sha256(string_agg(hash, '' ORDER BY place)) FROM outer_nodes WHERE size > 1 GROUP BY level, place // 3, size
), runs AS (
  SELECT level, tree, place // 3 AS run, list(hash ORDER BY place) AS hashes FROM inner_nodes WHERE size > 1 GROUP BY ALL
), outer_runs AS (
  SELECT level, place // 3 AS run, list(hash ORDER BY place) AS hashes FROM outer_nodes WHERE size > 1 GROUP BY ALL
), steps AS (
  SELECT p.tree, p.place, r.level, {'h': '', 'l': array_to_string(r.hashes[:own], ''), 'r': array_to_string(r.hashes[own + 2:], '')} AS step
  FROM (SELECT tree, place, level, place // CAST(pow(3, level) AS BIGINT) % 3 AS own, place // CAST(pow(3, level + 1) AS BIGINT) AS run FROM placed, range(38) l(level)) p JOIN runs r USING (tree, level, run)
  UNION ALL
  SELECT p.tree, p.place, 100 + r.level, {'h': '', 'l': array_to_string(r.hashes[:own], ''), 'r': array_to_string(r.hashes[own + 2:], '')}
  FROM (SELECT x.tree, x.place, level, s.place // CAST(pow(3, level) AS BIGINT) % 3 AS own, s.place // CAST(pow(3, level + 1) AS BIGINT) AS run FROM placed x JOIN subroots s USING (tree), range(38) l(level)) p JOIN outer_runs r USING (level, run)
), proofs AS (
  SELECT tree, place, list(step ORDER BY level) AS proof FROM steps GROUP BY ALL
), folded AS (
  SELECT p.*, coalesce(proof, []) AS proof, list_reduce(list_prepend({'h': coalesce(checked, leaf), 'l': '', 'r': ''}, coalesce(proof, [])), lambda a, b: {'h': sha256(concat(b.l, a.h, b.r)), 'l': '', 'r': ''}).h AS folded_root
  FROM placed p LEFT JOIN proofs USING (tree, place)
)
SELECT f.doc_id, f.leaf, s.hash AS subroot, o.hash AS root, sha256(array_to_string(list_transform(f.proof, lambda s: concat(s.l, s.r)), '')) AS proof_sha256, f.folded_root, f.folded_root = o.hash AS verified
FROM folded f JOIN subroots s USING (tree), (SELECT hash FROM outer_nodes WHERE size = 1) o
"""
