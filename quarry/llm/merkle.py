"""Merkle manifest of a table as a midstate tree.

Rows are hashed to leaves by Spark; every group's leaves ascend by a key, ``fanout``
consecutive nodes are hashed to their parent until one subroot is left, and the
groups' subroots give the root the same way. The tree is cut into blocks of at most
BLOCK nodes by position: each block is one small task group that yields one node of
the next tier, so a group of any size is spread over all tasks, and there are as many
rounds as tiers (one for each factor of BLOCK in the row count).

A parent keeps copies of its hash state before each child slot. To fold a changed child
to the root, the state in front of its slot is resumed with the replacement and the
siblings to the right only; siblings to the left are never hashed again. The states of
the parents above a block are built once for the block and resumed by all its leaves.

Defined results: a missing field counts as ``-``, empty texts have a length of 0; rows
without a key come first, rows of one key ascend by their leaf, repeated rows are leaves
of their own; a group of one row is its leaf, one group's subroot is the root; an empty
table gives no rows; other columns are ignored. Very long texts only meet the JVM's hash.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small
from quarry.operators.ids import dense_index
from quarry.session import stage_table

BLOCK = 1024
NODE_SCHEMA = "grp bigint, pos bigint, n bigint, digest string"
PATH_SCHEMA = ("grp bigint, pos bigint, n bigint, digest string, tops array<string>, "
               "path array<struct<left:array<string>,right:array<string>>>")
PROOF_SCHEMA = ("key bigint, leaf string, subroot string, root string, siblings array<string>, folded string")


def field_text(value: Column) -> Column:
    """A field in the leaf's text: ``-`` if missing, else its UTF-8 length, ``:`` and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field_text(f) for f in fields]), 256)


def _depth(n: int, fanout: int) -> int:
    """Levels until n nodes are one."""
    depth, reach = 0, 1
    while reach < n:
        depth, reach = depth + 1, reach * fanout
    return depth


class Shape(NamedTuple):
    """Children of a parent, levels of a block, nodes of a block (a power of the fanout)."""

    fanout: int
    levels: int
    size: int


def shape(fanout: int, block: int = BLOCK) -> Shape:
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    levels = 1
    while fanout ** (levels + 1) <= block:
        levels += 1
    return Shape(fanout, levels, fanout ** levels)


class Subtree:
    """The levels above consecutive nodes; ``states[level][parent][slot]`` is the copied
    hash state before the slot (the last one: after all children)."""

    def __init__(self, nodes: list[bytes], levels: int, fanout: int):
        self.fanout, self.nodes, self.states = fanout, [nodes], []
        for _ in range(levels):
            below, parents, digests = self.nodes[-1], [], []
            for at in range(0, len(below), fanout):
                state, kept = hashlib.sha256(), []
                for child in below[at:at + fanout]:
                    kept.append(state.copy())
                    state.update(child)
                parents.append(kept)
                digests.append(state.hexdigest().encode())
            self.states.append(parents)
            self.nodes.append(digests)

    def step(self, level: int, at: int) -> tuple:
        """What folding node ``at`` of ``level`` needs: the state before its slot and
        the siblings to its right; and those to its left, for the proof."""
        parent, slot = divmod(at, self.fanout)
        children = self.nodes[level][parent * self.fanout:(parent + 1) * self.fanout]
        return self.states[level][parent][slot], children[slot + 1:], children[:slot]

    def steps(self, at: int) -> list[tuple]:
        out = []
        for level in range(len(self.states)):
            out.append(self.step(level, at))
            at //= self.fanout
        return out


def fold(digest: bytes, steps: list[tuple]) -> bytes:
    """Root of the steps with ``digest`` in the child's place."""
    for state, right, *_ in steps:
        state = state.copy()
        state.update(digest)
        for sibling in right:
            state.update(sibling)
        digest = state.hexdigest().encode()
    return digest


def _block_tree(rows: pa.Table, by: Shape) -> tuple[pa.Table, Subtree]:
    rows = rows.sort_by("pos")
    nodes = [d.encode() for d in rows["digest"].to_pylist()]
    return rows, Subtree(nodes, min(by.levels, _depth(rows["n"][0].as_py(), by.fanout)), by.fanout)


def _with_block(nodes: DataFrame, by: Shape) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {by.size}"))


def tiers(nodes: DataFrame, by: Shape) -> list[DataFrame]:
    """``nodes``: ``grp, pos, n, digest`` (n: nodes of the group). The given tier and those above it, up
    to the one with a single node a group."""
    size = by.size

    def up(rows: pa.Table) -> pa.Table:
        rows, tree = _block_tree(rows, by)
        n = rows["n"][0].as_py()
        return pa.table({"grp": rows["grp"][:1], "pos": rows["block"][:1], "n": pa.array([-(-n // size)]),
                         "digest": pa.array([tree.nodes[-1][0].decode()])})

    out = [nodes.select("grp", "pos", "n", "digest")]
    while True:
        above = stage_table(_with_block(out[-1], by).groupBy("grp", "block").applyInArrow(up, NODE_SCHEMA), "merkle-tier")
        out.append(above)
        if above.filter(F.col("n") > 1).isEmpty():
            return out


def _own_steps(steps: list[tuple]) -> list[dict]:
    say = lambda xs: [x.decode() for x in xs]
    return [{"left": say(left), "right": say(right)} for _, right, left in steps]


def _resumable(path: list[dict]) -> list[tuple]:
    """Steps from a written path: the state before the slot is made once and copied by every fold."""
    out = []
    for step in path:
        state = hashlib.sha256()
        left = [x.encode() for x in step["left"]]
        for sibling in left:
            state.update(sibling)
        out.append((state, [x.encode() for x in step["right"]], left))
    return out


def paths(levels: list[DataFrame], top: DataFrame, by: Shape) -> DataFrame:
    """``top``: ``grp, tops, path`` of the single node of each group (``tops``: digests that
    hold for all its nodes). Those of every node of the lowest of ``levels``: ``grp, pos, n,
    digest, tops, path``."""
    def down(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, tree = _block_tree(rows, by)
        upper = above["path"][0].as_py()
        path = [_own_steps(tree.steps(i)) + upper for i in range(len(rows))]
        return pa.table([rows["grp"], rows["pos"], rows["n"], rows["digest"],
                         pa.array([above["tops"][0].as_py()] * len(rows), pa.list_(pa.string())),
                         pa.array(path, pa.list_(pa.struct([("left", pa.list_(pa.string())),
                                                            ("right", pa.list_(pa.string()))])))],
                        names=["grp", "pos", "n", "digest", "tops", "path"])

    above = levels[-1].join(small(top), "grp").select("grp", "pos", "n", "digest", "tops", "path")
    for tier in reversed(levels[:-1]):
        above = stage_table(_with_block(tier, by).groupBy("grp", "block").cogroup(
            above.select("grp", F.col("pos").alias("block"), "tops", "path").groupBy("grp", "block"))
            .applyInArrow(down, PATH_SCHEMA), "merkle-paths")
    return above


def proofs(rows: DataFrame, fanout: int = 2, block: int = BLOCK) -> DataFrame:
    """``rows``: ``key bigint, grp`` (any type that sorts), ``leaf`` and ``changed`` (the leaf
    after a change, null: none). Returns per row ``key, leaf, subroot, root, siblings, folded``:
    the siblings on the way to the root, level by level, left to right, and the root
    folded from the changed (else the own) leaf."""
    by = shape(fanout, block)
    rows = stage_table(rows.select("key", "grp", "leaf", "changed"), "merkle-leaves")
    # a row's own number keeps a third of equal rows from falling into one range
    ordered, total = dense_index(rows.withColumn("_tie", F.monotonically_increasing_id()),
                                 ["grp", "key", "leaf", "_tie"], out="at", with_total=True)
    groups = stage_table(ordered.groupBy("grp").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-groups")
    groups, n_groups = dense_index(groups, ["grp"], out="gid", with_total=True)
    groups = stage_table(groups, "merkle-groups")
    g = groups.select(F.col("grp").alias("g"), "first", "n", "gid")
    leaves = (ordered.join(small(g), F.col("grp").eqNullSafe(F.col("g")))
              .select("key", F.col("gid").alias("grp"), (F.col("at") - F.col("first")).alias("pos"), "n",
                      F.col("leaf").alias("digest"), "changed"))
    if total == 0:
        return leaves.sparkSession.createDataFrame([], PROOF_SCHEMA)
    own = tiers(leaves, by)
    over = tiers(own[-1].select(F.lit(0).cast("bigint").alias("grp"), F.col("grp").alias("pos"),
                                F.lit(n_groups).cast("bigint").alias("n"), "digest"), by)
    nothing = F.array().cast("array<struct<left:array<string>,right:array<string>>>")
    root = over[-1].select("grp", F.array("digest").alias("tops"), nothing.alias("path"))
    subroots = paths(over, root, by).select(F.col("pos").alias("grp"), F.concat(F.array("digest"), "tops").alias("tops"),
                                                "path")
    blocks = paths(own[1:], subroots, by).select("grp", F.col("pos").alias("block"), "tops", "path")

    def prove(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, tree = _block_tree(rows, by)
        upper = _resumable(above["path"][0].as_py())
        upper_siblings = [x.decode() for _, right, left in upper for x in left + right]
        siblings, folded = [], []
        for i, (leaf, changed) in enumerate(zip(rows["digest"].to_pylist(), rows["changed"].to_pylist(), strict=True)):
            steps = tree.steps(i)
            siblings.append([x.decode() for _, right, left in steps for x in left + right] + upper_siblings)
            folded.append(fold(fold((changed or leaf).encode(), steps), upper).decode())
        subroot, root = (pa.array([top] * len(rows), pa.string()) for top in above["tops"][0].as_py())
        return pa.table([rows["key"], rows["digest"], subroot, root,
                         pa.array(siblings, pa.list_(pa.string())), pa.array(folded, pa.string())],
                        names=["key", "leaf", "subroot", "root", "siblings", "folded"])

    return (_with_block(leaves, by).groupBy("grp", "block")
            .cogroup(blocks.groupBy("grp", "block")).applyInArrow(prove, PROOF_SCHEMA))
