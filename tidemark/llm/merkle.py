"""Merkle manifest of a dataset: digests, proofs and their folding, by cogrouped superblocks.

Every row is a leaf. The leaves of a tree (a language) ascend by id and are reduced eight by
eight; the trees' roots, in the order of their keys, are reduced likewise to one root. Aligned
runs of ``BLOCK`` nodes are superblocks: each is reduced by itself to one node, and these nodes
are the leaves of a tree that is ``BLOCK`` times smaller, and so on, so a task only ever holds
one superblock.

Proofs go the other way. A superblock needs, besides its own nodes, only the path above it: the
siblings of its root, level by level. Nodes and paths are cogrouped by superblock, and one
``applyInPandas`` finishes the local reduction, joins each node's own siblings to the path
above, and hands the longer path down to the next superblocks; at the leaves it folds what is
claimed of a row up to the root instead.

Texts are read once: a leaf and the digest of what is claimed are column expressions, and only
ids and digests are shuffled. Leaves are numbered by range partitions that are written out
with their number, so a lost executor repeats the same numbers.

Defined results: a null is ``-`` in a leaf, so null and empty differ; null ids come first, and
equal ids follow each other by their digests; repeated rows are leaves of their own; the null
language is a tree of its own, the first; a null id is never tampered with; an empty table
gives no row; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, ascii_lower, read_table
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

FAN = 8
#: Levels of a superblock, and its nodes.
LEVELS = 4
BLOCK = FAN**LEVELS
_HEX = 64
_PATH = "pos array<int>, others array<string>, subroot string, root string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def height(nodes: int) -> int:
    """Levels that bring so many nodes down to one."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


def leaf(*values: Column) -> Column:
    """Digest of a row: each value after its UTF-8 length, so that no two rows spell alike."""
    spelt = [F.coalesce(F.concat(F.octet_length(v), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*spelt), 256)


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a superblock at each of its levels."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([digest("".join(last[j : j + FAN])) for j in range(0, len(last), FAN)])
    return out


def paths(levels: list[list[str]], above: list[tuple[int, str]]) -> list[list[tuple[int, str]]]:
    """Of each node of the lowest level its place in its run and the run's others, level by level."""
    known = [above]
    for level in reversed(levels[:-1]):
        out = []
        for j, parent in enumerate(known):
            run = level[j * FAN : (j + 1) * FAN]
            out += [[(p, "".join(run[:p] + run[p + 1 :])), *parent] for p in range(len(run))]
        known = out
    return known


def fold(node: str, path: list[tuple[int, str]]) -> str:
    """The root that a node and the siblings of its path give."""
    for place, others in path:
        node = digest(others[: place * _HEX] + node + others[place * _HEX :])
    return node


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """The nodes with their number ``i`` in their tree and the tree's size ``n``."""
    keyed = nodes.withColumn("_tie", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange("tree", *order, "_tie").withColumn("_part", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    sizes = dealt.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("tree", "_part", before.alias("_before"), F.sum("_n").over(tree).alias("n"))
    place = F.row_number().over(Window.partitionBy("tree", "_part").orderBy(*order, "_tie"))
    placed = dealt.withColumn("_place", place).join(sizes, ["tree", "_part"])
    return placed.withColumn("i", F.col("_before") + F.col("_place") - 1).drop("_tie", "_part", "_place", "_before")


def blocked(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"i div {BLOCK}"))


def reduce_blocks(nodes: DataFrame) -> DataFrame:
    """(tree, i, n, node): the root of every superblock, as the nodes of a smaller tree."""

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        n = int(block["n"].iloc[0])
        top = reduced(block.sort_values("i")["node"].tolist(), min(LEVELS, height(n)))[-1][0]
        return pd.DataFrame({"tree": [key[0]], "i": [key[1]], "n": [-(-n // BLOCK)], "node": [top]})

    return blocked(nodes).groupBy("tree", "block").applyInPandas(run, "tree string, i long, n long, node string")


def forest(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, their superblocks' roots, the roots of those, up to one node a tree."""
    most = nodes.agg(F.max("n").alias("n")).first().n or 0
    levels = [nodes]
    while most > 1 or len(levels) == 1:
        levels.append(cut_lineage(reduce_blocks(levels[-1].select("tree", "i", "n", "node"))))
        most = -(-most // BLOCK)
    return levels


def _members(block: pd.DataFrame, outer: pd.DataFrame) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """(row, path) of the nodes of a superblock in their order."""
    block.sort_values("i", inplace=True, ignore_index=True)
    above = list(zip(outer["pos"].iloc[0], outer["others"].iloc[0], strict=True))
    levels = reduced(block["node"].tolist(), min(LEVELS, height(int(block["n"].iloc[0]))))
    return enumerate(paths(levels, above))


def hand_down(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """The paths of all nodes, each for the superblock (``tree``, ``block``) below it."""

    def run(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        found = [path for _, path in _members(block, outer)]
        return pd.DataFrame(
            {
                "tree": block["tree"], "block": block["i"], "pos": [[p for p, _ in path] for path in found],
                "others": [[o for _, o in path] for path in found], "subroot": outer["subroot"].iloc[0], "root": outer["root"].iloc[0],
            }
        )

    both = blocked(nodes).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    return cut_lineage(both.applyInPandas(run, f"tree string, block long, {_PATH}"))


def prove(leaves: DataFrame) -> DataFrame:
    """``doc_id``, digests, proof and fold of numbered leaves (``tree``, ``i``, ``n``, ``node``, ``claimed``)."""
    trees = forest(leaves)
    # The roots of the trees, in the order of their keys, are the leaves of the tree above.
    subroots = numbered(trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("key"), "node"), ["key"])
    subroots = cut_lineage(subroots)
    above = forest(subroots)
    root = F.col("node").alias("root")
    no_path = [F.array().cast("array<int>").alias("pos"), F.array().cast("array<string>").alias("others")]
    outer = above[-1].select("tree", F.col("i").alias("block"), *no_path, F.lit(None).cast("string").alias("subroot"), root)
    for nodes in reversed(above[:-1]):
        outer = hand_down(nodes.select("tree", "i", "n", "node"), outer)
    named = subroots.select(F.col("i").alias("block"), F.col("key").alias("tree"), F.col("node").alias("top"))
    outer = named.join(outer.drop("tree", "subroot"), "block").select(
        "tree", F.lit(0).cast("long").alias("block"), "pos", "others", F.col("top").alias("subroot"), "root"
    )
    for nodes in reversed(trees[1:-1]):
        outer = hand_down(nodes, outer)

    def run(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        proofs, folded = [], []
        found = _members(block, outer)
        claims = block["claimed"].tolist()
        for row, path in found:
            proofs.append(digest("".join(o for _, o in path)))
            folded.append(fold(claims[row], path))
        out = pd.DataFrame({"doc_id": block["doc_id"], "leaf": block["node"], "proof_sha256": proofs, "folded_root": folded})
        out["subroot"], out["root"] = outer["subroot"].iloc[0], outer["root"].iloc[0]
        out["verified"] = out["folded_root"] == out["root"]
        return out

    both = blocked(leaves).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    schema = "doc_id string, leaf string, proof_sha256 string, folded_root string, subroot string, root string, verified boolean"
    # Ids travel as text: a column of numbers and nulls would become one of floating point.
    return both.applyInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def manifest(docs: DataFrame, claimed_text: Column | None = None) -> DataFrame:
    """Leaf, roots, proof and the root folded from ``claimed_text`` (the text itself if None) of every row."""
    ids, source, lang, n_chars, text = (F.col(c).cast(t) for c, t in (("doc_id", "long"), ("source", "string"), ("lang", "string"), ("n_chars", "long"), ("text", "string")))
    claim = text if claimed_text is None else claimed_text.cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), lang), F.lit("-")).alias("tree"),
        ids.alias("id"), ids.cast("string").alias("doc_id"),
        leaf(ids, source, lang, n_chars, text).alias("node"),
        leaf(ids, source, lang, n_chars, claim).alias("claimed"),
    )
    leaves = numbered(cut_lineage(rows), ["id", "node"]).drop("id")
    return prove(cut_lineage(leaves))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text with A-Z in lower case where 3 divides the crc32 of the id."""
    return F.when(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 0, ascii_lower(text)).otherwise(text)


def _sql() -> str:
    def spelt(text: str) -> str:
        return " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))

    parts = [
        "crc AS (SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),"
        " lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS c FROM documents)",
        f"claims AS (SELECT *, CASE WHEN xor(c, 4294967295) % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS claim FROM crc)",
        f"leaves AS (SELECT row_number() OVER () AS r, doc_id, lang, sha256({spelt('text')}) AS leaf, sha256({spelt('claim')}) AS claimed FROM claims)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves)",
        "n0 AS (SELECT lang, i, leaf AS node FROM placed)",
        "f0 AS (SELECT r, doc_id, lang, leaf, i, claimed AS folded, '' AS proof FROM placed)",
    ]
    # A tree of up to 8^6 leaves, then one of up to 8^3 trees; finished ones are passed on.
    grouped, carried = "lang", "lang"
    for k in range(9):
        if k == 6:
            parts += [
                "tops AS (SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM n6)",
                "m6 AS (SELECT 0 AS g, i, node FROM tops)",
                "g6 AS (SELECT f.r, f.doc_id, 0 AS g, f.leaf, t.i, f.folded, f.proof, t.node AS subroot FROM f6 f JOIN tops t ON f.lang IS NOT DISTINCT FROM t.lang)",
            ]
            grouped = "g"
        nodes, folds = ("m", "g") if k >= 6 else ("n", "f")
        carried = "f.r, f.doc_id, f.leaf, f.g, f.subroot" if k >= 6 else "f.r, f.doc_id, f.leaf, f.lang"
        others = "array_to_string(x.run[1:f.i % 8], '')", "array_to_string(x.run[f.i % 8 + 2:], '')"
        parts += [
            f"r{k} AS (SELECT {grouped}, i // 8 AS i, list(node ORDER BY i) AS run, max(c) AS c FROM (SELECT *, count(*) OVER (PARTITION BY {grouped}) AS c FROM {nodes}{k}) GROUP BY {grouped}, i // 8)",
            f"{nodes}{k + 1} AS (SELECT {grouped}, i, CASE WHEN c = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS node FROM r{k})",
            f"{folds}{k + 1} AS (SELECT {carried}, f.i // 8 AS i, CASE WHEN c = 1 THEN folded ELSE sha256({others[0]} || folded || {others[1]}) END AS folded,"
            f" CASE WHEN c = 1 THEN proof ELSE proof || {others[0]} || {others[1]} END AS proof FROM {folds}{k} f JOIN r{k} x ON f.{grouped} IS NOT DISTINCT FROM x.{grouped} AND f.i // 8 = x.i)",
        ]
    return "WITH " + ",\n".join(parts) + (
        "\nSELECT doc_id, leaf, subroot, m9.node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = m9.node AS verified FROM g9, m9"
    )


@query("op11_merkle", _sql())
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return manifest(docs, tampered(F.col("doc_id"), F.col("text"))).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
