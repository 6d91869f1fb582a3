"""A hash tree over a table: a leaf for each row, a subtree for each source, one root, and a proof for each row.

Three nodes become one. Nodes are numbered along their tree without sorting a tree in one task, and cut into
superblocks of ``3 ** levels`` consecutive nodes. Going up, each superblock is reduced to its top; tops are the
nodes of the next round, until one is left for each source. The sources' tops are the nodes of a last tree, in
order of source, which goes up the same way. Going down, the nodes of a round and the outer nodes that their
superblock needs (its siblings in all higher rounds) are cogrouped by superblock: one function reduces
the superblock again, joins its own siblings with the outer ones, and hands them to the round below; for the
leaves it makes the proofs and folds them. So a task holds one superblock and one path, whatever the size of a source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opsreview.functions.ordered import BLOCK, earlier_blocks, in_blocks, within_block
from opsreview.llm.tables import DOCUMENT_COLUMNS
from opsreview.session import write_through

#: Columns of a leaf, in this order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TREE = ("known", "tree")


@dataclass(frozen=True)
class MerkleSettings:
    """``levels``: a superblock holds ``3 ** levels`` nodes."""

    levels: int = 6


def leaf_digest(columns: dict[str, Column] | None = None) -> Column:
    """Lowercase hex SHA-256 of a row: ``-`` for a null, else byte count, colon, value."""
    parts = []
    for name in LEAF_COLUMNS:
        value = (columns or {}).get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def without_line_breaks(text: Column, doc_id: Column) -> Column:
    """The text that a tampered copy has: where 2 divides the CRC-32 of the id, line feeds are gone."""
    return F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def _numbered(nodes: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Add ``pos``, from 0 along ``order`` within ``keys``, and ``n``, the nodes of the tree. ``order`` is unique in a tree."""
    blocks = in_blocks(nodes, keys, order, label)
    sizes = blocks.groupBy(*keys, BLOCK).agg(F.count("*").alias("size"))  # a row per tree and partition
    every = W.partitionBy(*keys)
    before = sizes.select(*keys, BLOCK, F.coalesce(F.sum("size").over(earlier_blocks(keys)), F.lit(0)).alias("before"), F.sum("size").over(every).alias("n"))
    inside = F.row_number().over(within_block(keys, order)) - 1
    return blocks.withColumn("inside", inside).join(before, [*keys, BLOCK]).withColumn("pos", F.col("inside") + F.col("before")).drop("inside", "before", BLOCK)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _reduced(digests: list[str], n: int, levels: int) -> list[list[str]]:
    """All levels of a superblock: ``levels`` of them above its nodes, or as many as leave one node of a tree of ``n``."""
    rows = [digests]
    while n > 1 and len(rows) <= levels:
        last = rows[-1]
        rows.append([_hash("".join(last[i : i + 3])) for i in range(0, len(last), 3)])
        n = -(-n // 3)
    return rows


def _path(rows: list[list[str]], i: int) -> list[tuple[str, str]]:
    """Siblings before and after node ``i`` on each level below the top."""
    out = []
    for row in rows[:-1]:
        start = i // 3 * 3
        out.append(("".join(row[start:i]), "".join(row[i + 1 : start + 3])))
        i //= 3
    return out


def _blocked(nodes: DataFrame, settings: MerkleSettings) -> DataFrame:
    return nodes.withColumn("superblock", F.floor(F.col("pos") / F.lit(3**settings.levels)).cast("long"))


def _tops(nodes: DataFrame, settings: MerkleSettings) -> DataFrame:
    """The next round: ``known, tree, pos, n, digest``, one node for each superblock of ``nodes``."""
    levels = settings.levels

    def reduce(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        n = int(own["n"].iloc[0])
        top = _reduced(own["digest"].tolist(), n, levels)[-1]
        return pd.DataFrame({"known": own["known"].iloc[:1], "tree": own["tree"].iloc[:1], "pos": own["superblock"].iloc[:1], "n": -(-n // 3**levels), "digest": top})

    rows = _blocked(nodes, settings).select(*TREE, "superblock", "pos", "n", "digest")
    return rows.groupBy(*TREE, "superblock").applyInPandas(reduce, "known boolean, tree string, pos long, n long, digest string")


def _outer_of(own: pd.DataFrame, outer: pd.DataFrame) -> tuple[str, str, list[tuple[str, str]]]:
    outer = outer.sort_values("level")
    head = outer.iloc[0]
    return head["before"], head["after"], list(zip(outer["before"].iloc[1:], outer["after"].iloc[1:], strict=True))


#: Level -1 holds the subroot and the root; the others the siblings before and after, upwards.
_OUTER = "known boolean, tree string, superblock long, level int, before string, after string"


def _down(nodes: DataFrame, outer: DataFrame, settings: MerkleSettings) -> DataFrame:
    """Outer nodes of the superblocks of the round below, which the ``nodes`` of this round stand for."""
    levels = settings.levels

    def extend(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        subroot, root, path = _outer_of(own, above)
        rows = _reduced(own["digest"].tolist(), int(own["n"].iloc[0]), levels)
        out = []
        for i, pos in enumerate(own["pos"].tolist()):
            steps = [(subroot, root), *_path(rows, i), *path]
            out += [(own["known"].iloc[0], own["tree"].iloc[0], pos, k - 1, before, after) for k, (before, after) in enumerate(steps)]
        return pd.DataFrame(out, columns=["known", "tree", "superblock", "level", "before", "after"])

    rows = _blocked(nodes, settings).select(*TREE, "superblock", "pos", "n", "digest")
    return rows.groupBy(*TREE, "superblock").cogroup(outer.groupBy(*TREE, "superblock")).applyInPandas(extend, _OUTER)


def _proofs(leaves: DataFrame, outer: DataFrame, settings: MerkleSettings) -> DataFrame:
    levels = settings.levels

    def prove(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pos")
        subroot, root, path = _outer_of(own, above)
        rows = _reduced(own["digest"].tolist(), int(own["n"].iloc[0]), levels)
        outside = "".join(before + after for before, after in path)
        proofs, folded = [], []
        for i, claimed in enumerate(own["claimed"].tolist()):
            inner = _path(rows, i)
            proofs.append(_hash("".join(before + after for before, after in inner) + outside))
            for before, after in (*inner, *path):
                claimed = _hash(before + claimed + after)
            folded.append(claimed)
        return pd.DataFrame({"doc_id": own["doc_id"], "leaf": own["digest"], "subroot": subroot, "root": root, "proof_sha256": proofs, "folded_root": folded})

    rows = _blocked(leaves, settings).select(*TREE, "superblock", "pos", "n", "digest", "claimed", "doc_id")
    found = rows.groupBy(*TREE, "superblock").cogroup(outer.groupBy(*TREE, "superblock"))
    return found.applyInPandas(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def _risen(nodes: DataFrame, most: int, settings: MerkleSettings, label: str) -> tuple[list[DataFrame], DataFrame]:
    """All rounds from ``nodes`` upwards, and the tops of the last. ``most``: nodes of the largest tree."""
    rounds = [nodes]
    tops = write_through(_tops(nodes, settings), label)
    while (most := -(-most // 3**settings.levels)) > 1:
        rounds.append(tops)
        tops = write_through(_tops(tops, settings), label)
    return rounds, tops


def manifest(documents: DataFrame, claimed: Column | None = None, settings: MerkleSettings | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: one row for each row of ``documents``.

    ``claimed`` is the text that is held against the tree (null: the text itself): ``folded_root`` is
    what the proof's siblings make of its leaf, ``verified`` whether that is the root. Siblings, roots and
    proofs are always those of ``documents``.

    Leaves of a source go in order of doc_id, null ids first, equal ids in order of their leaf; rows alike in all
    columns are leaves of their own. A null source is a source, and the first. An empty table gives no rows.
    Columns beyond those of ``documents`` are left out.
    """
    settings = settings or MerkleSettings()
    rows = documents.select(*DOCUMENT_COLUMNS)
    changed = F.col("text") if claimed is None else claimed
    digest = leaf_digest()
    leaves = rows.select(
        F.col("source").isNotNull().alias("known"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        digest.alias("digest"),
        F.when(~changed.eqNullSafe(F.col("text")), leaf_digest({"text": changed})).otherwise(digest).alias("claimed"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Written once: texts are hashed once, and the row numbers that part equal rows stay as they are.
    leaves = write_through(leaves, "merkle-leaves")
    leaves = write_through(_numbered(leaves, TREE, ["doc_id", "digest", "row"], "merkle-order"), "merkle-numbers")
    most = leaves.agg(F.max("n")).first()[0]
    if most is None:
        empty = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return documents.sparkSession.createDataFrame([], empty)
    rounds, subroots = _risen(leaves, most, settings, "merkle-tops")

    # The last tree: the sources' tops in order of source.
    nodes = subroots.select("known", "tree", F.col("digest"), F.lit(0).alias("all"))
    nodes = _numbered(nodes, ["all"], [*TREE], "merkle-sources")
    nodes = write_through(nodes.select(F.lit(True).alias("known"), F.lit("").alias("tree"), "pos", "n", "digest", F.col("known").alias("of_known"), F.col("tree").alias("of_tree")), "merkle-sources")
    sources, root = _risen(nodes, nodes.agg(F.max("n")).first()[0], settings, "merkle-tops")
    outer = root.select(*TREE, F.lit(0).cast("long").alias("superblock"), F.lit(-1).alias("level"), F.lit("").alias("before"), F.col("digest").alias("after"))
    for own in reversed(sources):
        outer = write_through(_down(own, outer, settings), "merkle-outer")
    own = nodes.select(F.col("of_known"), F.col("of_tree"), F.col("pos").alias("superblock"), F.col("digest").alias("subroot"))
    outer = outer.drop("known", "tree").join(own, "superblock").select(
        F.col("of_known").alias("known"),
        F.col("of_tree").alias("tree"),
        F.lit(0).cast("long").alias("superblock"),
        "level",
        F.when(F.col("level") == -1, F.col("subroot")).otherwise(F.col("before")).alias("before"),
        "after",
    )
    for own in reversed(rounds[1:]):
        outer = write_through(_down(own, outer, settings), "merkle-outer")
    found = _proofs(leaves, outer, settings)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered_sql() -> str:
    """DuckDB SQL for the manifest held against texts without line breaks where 2 divides the CRC-32 of the id."""

    def leaf(text: str) -> str:
        def part(value: str) -> str:
            return f"coalesce(strlen(CAST({value} AS VARCHAR))::VARCHAR || ':' || CAST({value} AS VARCHAR), '-')"

        return "sha256(" + " || ".join(part(text if name == "text" else name) for name in LEAF_COLUMNS) + ")"

    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""
    return f"""
WITH RECURSIVE
c AS (SELECT *, coalesce('s' || source, '') AS tree, {crc} % 2 = 0 AS changes FROM documents),
l AS (
  SELECT doc_id, tree, {leaf("text")} AS leaf,
         {leaf("CASE WHEN coalesce(changes, false) THEN replace(text, chr(10), '') ELSE text END")} AS claimed
  FROM c),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
up(tree, level, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, level, pos // 3),
subroots AS (
  SELECT tree, level AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS trees FROM up WHERE n = 1),
top(level, pos, n, h) AS (
  SELECT 0, place, trees, subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 3),
inner_steps AS (
  SELECT u.tree, u.level AS step, u.pos,
         coalesce(string_agg(u.h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(u.h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after,
         CASE WHEN u.level + 1 = s.height THEN s.place ELSE u.pos // 3 END AS next
  FROM up u JOIN subroots s USING (tree) WHERE u.n > 1 WINDOW w AS (PARTITION BY u.tree, u.level, u.pos // 3 ORDER BY u.pos)),
top_steps AS (
  SELECT level, pos,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM top WHERE n > 1 WINDOW w AS (PARTITION BY level, pos // 3 ORDER BY pos)),
steps AS (
  SELECT * FROM inner_steps
  UNION ALL
  SELECT s.tree, s.height + t.level, t.pos, t.before, t.after, t.pos // 3
  FROM subroots s JOIN top_steps t ON t.pos = s.place // (3 ** t.level)::BIGINT),
numbered AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY l.tree, l.pos) AS id, l.*, s.height, s.place, s.subroot FROM leaves l JOIN subroots s USING (tree)),
walk(id, tree, step, pos, proof, folded) AS (
  SELECT id, tree, 0, CASE WHEN height = 0 THEN place ELSE pos END, '', claimed FROM numbered
  UNION ALL
  SELECT w.id, w.tree, w.step + 1, s.next, w.proof || s.before || s.after, sha256(s.before || w.folded || s.after)
  FROM walk w JOIN steps s ON s.tree = w.tree AND s.step = w.step AND s.pos = w.pos),
ends AS (SELECT id, arg_max(proof, step) AS proof, arg_max(folded, step) AS folded FROM walk GROUP BY id)
SELECT d.doc_id, d.leaf, d.subroot, r.h AS root, sha256(e.proof) AS proof_sha256, e.folded AS folded_root, e.folded = r.h AS verified
FROM numbered d JOIN ends e USING (id) CROSS JOIN (SELECT h FROM top WHERE n = 1) r"""
