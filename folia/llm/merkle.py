"""A Merkle manifest of a dataset: one leaf a row, a tree of eighths a language, a root over all languages.

H is the lowercase hex SHA-256 of its inputs joined, digests as hex text. Leaves of a language ascend by
doc_id (null first, rows of one doc_id by their leaf); while several nodes remain, every eight in a row
become one. The languages' roots, null first and then by their bytes, are leaves of a last tree.

Trees are built in superblocks of 8^4 nodes (four levels) that stand side by side: each is reduced in one group to one
node, and those nodes are dealt into superblocks again, so a group holds 4,096 nodes whatever a language's
size. On the way down the nodes of a superblock are cogrouped with what they need from outside, the
siblings of their superblock's own path, and a leaf's proof is its siblings inside joined with these.

Nulls are fields of their own (`-`), empty texts are `0:`. Equal rows have equal leaves, which place of
theirs each takes doesn't matter. An empty table has no rows and no root. Extra columns are passed over.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folia.llm.shared import written
from folia.operators.numbering import number

#: LEVELS are those of a superblock.
ARITY, LEVELS = 8, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODES = "tree string, pos long, node string, rest int"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column) -> Column:
    """The leaf of a row of documents whose text is `text`."""
    return F.sha2(F.concat(_field(F.col("doc_id")), _field(F.col("source")), _field(F.col("lang")), _field(F.col("n_chars")), _field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, tree, leaf, changed): each row's leaf and, where its id is drawn, that of its text in lower case."""
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))  # '-' comes before '='
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf(F.col("text")).alias("leaf"), F.when(drawn, leaf(F.translate("text", _UPPER, _LOWER))).alias("changed"))


def _height(n: Column) -> Column:
    """Levels above n nodes: the octal digits of n - 1."""
    return F.when(n > 1, F.length(F.conv((n - 1).cast("string"), 10, 8))).otherwise(0)


def _with_height(nodes: DataFrame) -> DataFrame:
    heights = nodes.groupBy("tree").agg(_height(F.count("*")).cast("int").alias("rest"))
    return nodes.join(heights, "tree")


def _runs(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level, from the given ones up to `levels` above them."""
    out = [nodes]
    for _ in range(levels):
        nodes = [_hash("".join(nodes[i : i + ARITY])) for i in range(0, len(nodes), ARITY)]
        out.append(nodes)
    return out


def _reduce(part: pd.DataFrame, levels: int) -> pd.DataFrame:
    part = part.sort_values("pos")
    up = min(levels, int(part["rest"].iloc[0]))
    top = _runs(part["node"].tolist(), up)[-1]
    return pd.DataFrame({"tree": part["tree"].iloc[:1], "pos": part["pos"].iloc[:1] // ARITY**levels, "node": top, "rest": part["rest"].iloc[:1] - up})


def _block(levels: int) -> Column:
    return F.expr(f"pos DIV {ARITY**levels}").alias("block")


def climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (tree, pos, node, rest) of the given level and every `levels` above, up to one root a tree."""
    out = [nodes]
    most = nodes.agg(F.max("rest").alias("most")).first()["most"] or 0
    for _ in range(0, most, levels):
        out.append(written(out[-1].groupBy("tree", _block(levels)).applyInPandas(lambda p: _reduce(p, levels), _NODES), "merkle-nodes"))
    return out


def _siblings(part: pd.DataFrame, levels: int) -> tuple[list[list[str]], list[list[str]]]:
    """For each node of a superblock, in order: what stands before and behind it in its run, level by level."""
    below = _runs(part["node"].tolist(), min(levels, int(part["rest"].iloc[0])))[:-1]
    before, after = [], []
    for i in range(len(part)):
        left, right = [], []
        for nodes in below:
            first = i - i % ARITY
            left.append("".join(nodes[first:i]))
            right.append("".join(nodes[i + 1 : first + ARITY]))
            i //= ARITY
        before.append(left)
        after.append(right)
    return before, after


def _descend(part: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    part, o = part.sort_values("pos"), outer.iloc[0]
    before, after = _siblings(part, levels)
    rows = {"tree": part["tree"], "block": part["pos"], "before": [[*b, *o["before"]] for b in before], "after": [[*a, *o["after"]] for a in after]}
    return pd.DataFrame(rows | {"subroot": o["subroot"], "root": o["root"]})


_OUTER = "tree string, block long, before array<string>, after array<string>, subroot string, root string"


def descend(stages: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """`outer`, one row for each tree's root, carried down through `stages` to each of the first one's nodes."""
    for nodes in reversed(stages):
        outer = nodes.groupBy("tree", _block(levels)).cogroup(outer.groupBy("tree", "block")).applyInPandas(lambda p, o: _descend(p, o, levels), _OUTER)
    return outer


def _prove(part: pd.DataFrame, outer: pd.DataFrame, levels: int) -> pd.DataFrame:
    part, o = part.sort_values("pos"), outer.iloc[0]
    proofs, folded = [], []
    for start, before, after in zip(part["changed"].fillna(part["node"]), *_siblings(part, levels)):
        proof = hashlib.sha256()
        for b, a in zip([*before, *o["before"]], [*after, *o["after"]]):
            proof.update(b.encode() + a.encode())
            start = _hash(b + start + a)
        proofs.append(proof.hexdigest())
        folded.append(start)
    rows = {"doc_id": part["doc_id"], "leaf": part["node"], "subroot": o["subroot"], "root": o["root"], "proof_sha256": proofs, "folded_root": folded}
    return pd.DataFrame(rows | {"verified": [f == o["root"] for f in folded]})


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document; superblocks have `levels` levels."""
    # the texts are read once: dealing leaves into ranges looks at them twice
    placed = number(written(leaves(docs), "merkle-hashes"), "tree", [F.asc_nulls_first("doc_id"), F.col("leaf")], "pos", "long")
    # ids go to pandas as text, which has nulls
    rows = written(_with_height(placed.select(F.col("doc_id").cast("string").alias("doc_id"), "tree", "pos", F.col("leaf").alias("node"), "changed")), "merkle-leaves")
    stages = climb(rows.select("tree", "pos", "node", "rest"), levels)

    subroots = stages[-1].select(F.col("tree").alias("own"), "node", F.lit("").alias("tree"))
    tops = written(_with_height(number(subroots, "tree", ["own"], "pos", "long")), "merkle-subroots")
    above = climb(tops.select("tree", "pos", "node", "rest"), levels)
    root = above[-1].select("tree", "pos", F.col("node").alias("root"))
    nothing = F.array().cast("array<string>")
    paths = descend(above[:-1], root.select("tree", F.col("pos").alias("block"), nothing.alias("before"), nothing.alias("after"), F.lit("").alias("subroot"), "root"), levels)
    # every subroot, with its siblings up to the root, is what its tree needs from outside
    outer = tops.join(paths.select("tree", F.col("block").alias("pos"), "before", "after", "root"), ["tree", "pos"]).select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("block"), "before", "after", F.col("node").alias("subroot"), "root")

    outer = descend(stages[1:-1], outer, levels)
    out = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    proved = rows.groupBy("tree", _block(levels)).cogroup(outer.groupBy("tree", "block")).applyInPandas(lambda p, o: _prove(p, o, levels), out)
    return proved.withColumn("doc_id", F.col("doc_id").cast("long"))
