"""Merkle manifest of a dataset: a tree of ARITY children a node per source, and one over the sources.

Trees are cut into aligned subtrees of BLOCK_HEIGHT levels. A subtree is one row of a table whose
digests stand in van Emde Boas order: the upper half of the levels first, then the lower subtrees
from left to right, each laid out in the same way, so a path from a leaf to the root stays within
few neighbouring stretches at any page size. Roots of subtrees are the leaves of the next table,
until one is left. Digests, positions and paths to the root are found by address arithmetic alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize, small, table
from quillspark.llm.spelling import CRC_TABLE_SQL, crc32_sql
from quillspark.operators.ordinals import ordinals

ARITY = 3
#: Levels of edges in a stored subtree: 3 ** 6 = 729 leaves, 1093 digests of 32 bytes.
BLOCK_HEIGHT = 6
DIGEST = 32


def tree_size(height: int, arity: int = ARITY) -> int:
    """Nodes of a full tree with that many levels of edges."""
    return (arity ** (height + 1) - 1) // (arity - 1)


@cache
def addresses(height: int, arity: int = ARITY) -> list[np.ndarray]:
    """For each depth (0 is the root) the van Emde Boas places of its nodes from left to right."""
    places = [np.zeros(arity**d, np.int64) for d in range(height + 1)]

    def lay(depth: int, index: int, levels: int, start: int) -> int:
        """Lay out the subtree of that many levels of nodes under (depth, index); the place after it."""
        if levels == 1:
            places[depth][index] = start
            return start + 1
        upper = levels // 2
        start = lay(depth, index, upper, start)
        for child in range(index * arity**upper, (index + 1) * arity**upper):
            start = lay(depth + upper, child, levels - upper, start)
        return start

    lay(0, 0, height + 1, 0)
    return places


def address(depth: int, index: int, height: int, arity: int = ARITY) -> int:
    """The same place by arithmetic: halve the levels, skip whole subtrees, go on inside the one that holds the node."""
    place, levels = 0, height + 1
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        below = depth - upper
        subtree, index = divmod(index, arity**below)
        place += tree_size(upper - 1, arity) + subtree * tree_size(levels - upper - 1, arity)
        depth, levels = below, levels - upper
    return place


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height_of(n: int, arity: int = ARITY) -> int:
    """Levels of edges over n leaves: runs are folded while more than one node is left."""
    height = 0
    while n > 1:
        n, height = -(-n // arity), height + 1
    return height


def build_block(leaves: list[str], height: int, arity: int = ARITY) -> bytes:
    """The laid out subtree over at most arity ** height hex digests; places without a node stay zero."""
    places = addresses(height, arity)
    out = np.zeros((tree_size(height, arity), DIGEST), np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        out[places[depth][: len(level)]] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, DIGEST)
        level = [digest_of(level[i : i + arity]) for i in range(0, len(level), arity)]
    return out.tobytes()


def sibling_path(nodes: np.ndarray, index: int, n: int, height: int, arity: int = ARITY) -> list[list[str]]:
    """For each level of a subtree with n leaves, from the leaf up, the run of the path's node as hex digests, '' at its own place."""
    path = []
    for depth in range(height, 0, -1):
        first = index - index % arity
        run = [nodes[address(depth, i, height, arity)].tobytes().hex() if i != index else "" for i in range(first, min(first + arity, n))]
        path.append(run)
        index, n = index // arity, -(-n // arity)
    return path


def fold_path(leaf: str, path: list[list[str]]) -> str:
    for run in path:
        leaf = digest_of([x or leaf for x in run])
    return leaf


BLOCK = "tree long, block long, n_tree long, height int, positions array<long>, nodes binary"


def build_blocks(leaves: DataFrame, block_height: int = BLOCK_HEIGHT, arity: int = ARITY) -> list[DataFrame]:
    """(tree, position from 0, n_tree, digest) to written tables of subtrees, one table per level of subtrees.

    A tree whose level has more than one subtree goes on with their roots; subtrees of such a level
    have block_height levels even if their last runs are short. A group is at most arity ** block_height
    digests, whatever the size of the tree.
    """
    width = arity**block_height

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position")
        n = int(frame["n_tree"].iloc[0])
        height = block_height if n > width else height_of(n, arity)
        nodes = build_block(frame["digest"].tolist(), height, arity)
        return pd.DataFrame([(frame["tree"].iloc[0], frame["block"].iloc[0], n, height, frame["position"].tolist(), nodes)], columns=["tree", "block", "n_tree", "height", "positions", "nodes"])

    levels, rows = [], leaves
    while True:
        keyed = rows.select("tree", "position", "n_tree", "digest", F.floor(F.col("position") / width).alias("block"))
        blocks = materialize(keyed.groupBy("tree", "block").applyInPandas(build, BLOCK), f"merkle-{len(levels)}")
        levels.append(blocks)
        above = blocks.where(F.col("n_tree") > width)
        if above.isEmpty():
            return levels
        rows = above.select("tree", F.col("block").alias("position"), F.ceil(F.col("n_tree") / width).alias("n_tree"), F.lower(F.hex(F.substring("nodes", 1, DIGEST))).alias("digest"))


def roots(levels: list[DataFrame], block_height: int = BLOCK_HEIGHT, arity: int = ARITY) -> DataFrame:
    """(tree, digest) of every tree: the root of its last subtree, which stands first in its row."""
    last = [b.where(F.col("n_tree") <= arity**block_height).select("tree", F.lower(F.hex(F.substring("nodes", 1, DIGEST))).alias("digest")) for b in levels]
    out = last[0]
    for rows in last[1:]:
        out = out.unionByName(rows)
    return out


PATH = "array<array<string>>"


def paths_to_root(levels: list[DataFrame], block_height: int = BLOCK_HEIGHT, arity: int = ARITY) -> DataFrame | None:
    """(tree, block, path) for each lowest subtree that has others above it: the runs from its root up; None if there are none."""
    width, found = arity**block_height, None
    for blocks in reversed(levels[1:]):
        if found is None:
            rows = blocks.withColumn("path", F.lit(None).cast(PATH))
        else:
            above = found.withColumnRenamed("tree", "t").withColumnRenamed("block", "b")
            rows = blocks.join(small(above), (F.col("tree") == F.col("t")) & (F.col("block") == F.col("b")), "left").drop("t", "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    nodes = np.frombuffer(row["nodes"], np.uint8).reshape(-1, DIGEST)
                    n = len(row["positions"])
                    path = [sibling_path(nodes, p - row["block"] * width, n, row["height"], arity) + (row["path"] or []) for p in row["positions"]]
                    yield pa.RecordBatch.from_arrays([pa.array([row["tree"]] * n, pa.int64()), pa.array(row["positions"], pa.int64()), pa.array(path, pa.list_(pa.list_(pa.string())))], ["tree", "block", "path"])

        found = materialize(rows.select("tree", "block", "height", "positions", "nodes", "path").mapInArrow(run, f"tree long, block long, path {PATH}"), "merkle-paths")
    return found


def _field(value: Column) -> Column:
    """A value with its UTF-8 byte count before it, '-' for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


class Manifest:
    """The written manifest of a dataset: subtrees of each tree, the tree over them, and the leaves with their positions."""

    def __init__(self, rows: DataFrame, group: str = "source", order: str = "doc_id", block_height: int = BLOCK_HEIGHT):
        """rows: (group, order, leaf, claimed): claimed is the digest that verify() folds in place of leaf.

        Null groups are one group, first in order; null ids come first; rows with equal ids stand by
        their digests. No rows make an empty manifest whose root is null.
        """
        self.block_height, self.width = block_height, ARITY**block_height
        # written first: dealing by ranges reads its rows twice, and digests of whole texts are made once
        rows = materialize(rows.select(F.col(group).alias("g"), F.col(order).alias("id"), "leaf", "claimed"), "merkle-rows")
        leaves = ordinals(rows, ["g"], [F.col("id").asc_nulls_first(), F.col("leaf"), F.col("claimed")], "place", "n_tree")
        leaves = materialize(leaves, "merkle-leaves")
        names = leaves.where("place = 1").select("g", F.col("n_tree").alias("n_docs"))
        self.trees = materialize(ordinals(names, [], [F.col("g").asc_nulls_first()], "tree", "n_trees"), "merkle-trees")
        named = self.trees.select(F.col("g").alias("g2"), "tree")
        numbered = leaves.join(small(named), leaves["g"].eqNullSafe(F.col("g2")))
        self.leaves = materialize(numbered.select("tree", (F.col("place") - 1).alias("position"), "n_tree", "id", "leaf", "claimed"), "merkle-numbered")
        discard(rows, leaves)
        self.levels = build_blocks(self.leaves.select("tree", "position", "n_tree", F.col("leaf").alias("digest")), block_height)
        self.subroots = materialize(roots(self.levels, block_height).join(self.trees.select("tree", "n_trees"), "tree"), "merkle-subroots")
        tops = self.subroots.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("position"), F.col("n_trees").alias("n_tree"), "digest")
        self.top_levels = build_blocks(tops, block_height)
        first = roots(self.top_levels, block_height).first()
        self.root = first["digest"] if first else None

    def verify(self) -> DataFrame:
        """id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

        The siblings come from the stored subtrees by address, up to the root over the sources; the
        claimed digest is folded with them and compared with the root.
        """
        root, height, width = self.root, self.block_height, self.width
        # above a source's lowest subtrees: the rest of its tree, then the path of its subroot
        tops = self.top_levels[0].withColumn("path", F.lit(None).cast(PATH))
        over = paths_to_root(self.top_levels, height)
        if over is not None:
            over = over.withColumnRenamed("tree", "t").withColumnRenamed("block", "b")
            tops = self.top_levels[0].join(small(over), F.col("block") == F.col("b"), "left").drop("t", "b")

        def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    nodes = np.frombuffer(row["nodes"], np.uint8).reshape(-1, DIGEST)
                    n = len(row["positions"])
                    path = [sibling_path(nodes, p - row["block"] * width, n, row["height"]) + (row["path"] or []) for p in row["positions"]]
                    yield pa.RecordBatch.from_arrays([pa.array([p + 1 for p in row["positions"]], pa.int64()), pa.array(path, pa.list_(pa.list_(pa.string())))], ["tree", "top"])

        of_source = tops.select("block", "height", "positions", "nodes", "path").mapInArrow(top, f"tree long, top {PATH}")
        of_source = materialize(of_source.join(self.subroots.select("tree", F.col("digest").alias("subroot")), "tree"), "merkle-tops")
        inner = paths_to_root(self.levels, height)
        blocks = self.levels[0].select("tree", "block", "height", "nodes").join(small(of_source.withColumnRenamed("tree", "t")), F.col("tree") == F.col("t")).drop("t")
        if inner is None:
            blocks = blocks.withColumn("path", F.lit(None).cast(PATH))
        else:
            inner = inner.withColumnRenamed("tree", "t").withColumnRenamed("block", "b")
            blocks = blocks.join(small(inner), (F.col("tree") == F.col("t")) & (F.col("block") == F.col("b")), "left").drop("t", "b")
        out = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

        def check(mine: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            row = block.iloc[0]
            nodes = np.frombuffer(row["nodes"], np.uint8).reshape(-1, DIGEST)
            above = [list(run) for part in (row["path"], row["top"]) if part is not None for run in part]
            rest = "".join(x for run in above for x in run)
            found, n = [], len(mine)
            for position, claimed in zip(mine["position"], mine["claimed"], strict=True):
                path = sibling_path(nodes, int(position) - int(row["block"]) * width, n, int(row["height"]))
                proof = digest_of([x for run in path for x in run] + [rest])
                folded = fold_path(fold_path(claimed, path), above)
                found.append((proof, folded))
            proofs, folds = zip(*found, strict=True)
            return pd.DataFrame({"id": mine["id"], "leaf": mine["leaf"], "subroot": row["subroot"], "root": root, "proof_sha256": proofs, "folded_root": folds, "verified": [x == root for x in folds]})

        # ids travel as strings: pandas would turn a group of integers with a null into floats
        keyed = self.leaves.select("tree", F.floor(F.col("position") / width).alias("block"), "position", F.col("id").cast("string").alias("id"), "leaf", "claimed")
        found = keyed.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInPandas(check, out)
        return found.withColumn("id", F.col("id").cast(self.leaves.schema["id"].dataType))


def tampered(text: Column, id_col: Column) -> Column:
    """The text without line feeds where 2 divides the crc32 of the decimal id; other texts as they are."""
    return F.when(F.crc32(id_col.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def document_manifest(docs: DataFrame, block_height: int = BLOCK_HEIGHT) -> Manifest:
    """The manifest of (doc_id, source, lang, n_chars, text); other columns are ignored. A row of a null doc_id is never tampered with."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    values = [doc_id, F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]
    rows = docs.select(F.col("source").cast("string").alias("source"), doc_id.alias("doc_id"), leaf_digest(*values, text).alias("leaf"), leaf_digest(*values, tampered(text, doc_id)).alias("claimed"))
    return Manifest(rows, block_height=block_height)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and verification of every document.

    Null values are hashed as '-'; null sources are a source of their own, first in order; null ids
    come first in their source and rows with equal ids stand by their digests, each with its own
    proof. An empty table gives no rows.
    """
    return document_manifest(table(spark, sf_dir, "documents")).verify().withColumnRenamed("id", "doc_id")


def manifest_sql(levels: int = 14) -> str:
    """DuckDB for op13_merkle_manifest: each level of edges written out, for trees of up to 3 ** levels leaves."""
    field = lambda x: f"coalesce(octet_length(encode({x}::varchar))::varchar || ':' || {x}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    ctes = [
        f"t AS (SELECT {CRC_TABLE_SQL} AS t)",
        f"raw AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc32_sql('doc_id::varchar')} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS claimed FROM documents, t)",
        "sources AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) AS s FROM (SELECT DISTINCT source FROM raw))",
        "d0 AS MATERIALIZED (SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS i, count(*) OVER (PARTITION BY s) AS n, leaf, claimed AS fold, '' AS proof FROM raw JOIN sources ON raw.source IS NOT DISTINCT FROM sources.source)",
        "l0 AS MATERIALIZED (SELECT s, i, n, leaf AS h FROM d0)",
    ]

    def climb(k: int, name: str, into: str, tree: str, keep: str) -> None:
        """One level: nodes l{k} to l{k+1}, and the paths in name{k} to name{k+1}."""
        ctes.append(f"{into}{k + 1} AS MATERIALIZED (SELECT {tree}, i // 3 AS i, (n + 2) // 3 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {into}{k} WHERE n > 1 GROUP BY {tree}, i // 3, n UNION ALL SELECT {tree}, i, n, h FROM {into}{k} WHERE n = 1)")
        ctes.append(f"{into}r{k} AS MATERIALIZED (SELECT {tree}, i // 3 AS r, list(h ORDER BY i) AS run FROM {into}{k} WHERE n > 1 GROUP BY {tree}, i // 3)")
        at = "(d.i % 3)::bigint"
        ctes.append(
            f"{name}{k + 1} AS MATERIALIZED (SELECT {keep}, CASE WHEN d.n > 1 THEN d.i // 3 ELSE d.i END AS i, CASE WHEN d.n > 1 THEN (d.n + 2) // 3 ELSE d.n END AS n, "
            f"CASE WHEN d.n > 1 THEN sha256(array_to_string(list_concat(run[1:{at}], [fold], run[{at} + 2:]), '')) ELSE fold END AS fold, "
            f"CASE WHEN d.n > 1 THEN proof || array_to_string(list_concat(run[1:{at}], run[{at} + 2:]), '') ELSE proof END AS proof "
            f"FROM {name}{k} d LEFT JOIN {into}r{k} r ON r.{tree} = d.{tree} AND r.r = d.i // 3 AND d.n > 1)"
        )

    for k in range(levels):
        climb(k, "d", "l", "s", "doc_id, d.s, leaf")
    ctes += [
        f"m0 AS MATERIALIZED (SELECT 0 AS z, s - 1 AS i, count(*) OVER () AS n, h FROM l{levels})",
        f"e0 AS MATERIALIZED (SELECT doc_id, 0 AS z, d.leaf, l.h AS subroot, d.s - 1 AS i, (SELECT count(*) FROM m0) AS n, fold, proof FROM d{levels} d JOIN l{levels} l USING (s))",
    ]
    for k in range(levels):
        climb(k, "e", "m", "z", "doc_id, d.z, leaf, subroot")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, m.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = m.h AS verified FROM e{levels}, m{levels} m"


OP13_SQL = manifest_sql()
