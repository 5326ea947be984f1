"""Sharding by a K-d tree over document metadata.

The tree starts with all rows and splits a node at the weighted median (by
bytes) of its widest metadata dimension, until every leaf has its target
size. Medians come from distributed histogram refinement (``cuts``); the driver
sees one row per tree node, whose number is bounded by the shard count. Rows
are routed by a join with the node table, never moved.

Rows with equal texts share all coordinates and the text hash, so they are one
point of the tree and stay in one shard unless they outgrow one. If the point
at a median is so heavy that the cut would miss its goal, it is divided by row
key (a written hash of doc_id and row) if it outgrows a shard; else the node's heavy points are dealt to the
sides whole, so that the rest can meet the goal, and the median is taken again
without them. Only where no choice of whole points meets the goal, the nearest
one is taken.

Defined results: a null text has size 1 (no bytes plus 1), checksum 0; null
metadata counts as the smallest value; repeated rows, rows of one doc_id and rows
without one are separate rows of one point and are divided like others; no rows give
no rows; extra input columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.cuts import weighted_cuts
from quarry.operators.ids import dense_index
from quarry.session import stage_table

COORD_BITS = 22
TIE_BITS = 38
TOLERANCE = 1 / 1000          # of a node's bytes: a cut this near its goal is taken
STEPS = 4000                  # of a node's bytes: resolution in which sums of whole points are searched


def log_coord(x: Column) -> Column:
    """Order-preserving coordinate of a count, log scale (null: 0)."""
    return F.floor(F.log2(F.coalesce(x, F.lit(0)).cast("double") + 1) * (1 << 16)).cast("bigint")


def text_coord(x: Column) -> Column:
    """Order-preserving coordinate of a short string: its first two bytes."""
    return F.coalesce(F.conv(F.rpad(F.substring(F.hex(x.cast("binary")), 1, 4), 4, "0"), 16, 10).cast("bigint"), F.lit(0))


def row_key(doc_id: Column) -> Column:
    """60 bits by which a point's rows are divided: 40 of the doc_id, then 20 of the row's
    own number, so that rows of one doc_id or none can be divided too. To be written
    before it is used."""
    by_id = F.shiftrightunsigned(F.xxhash64(F.lit("row"), doc_id), 24)
    return F.shiftleft(by_id, 20).bitwiseOR(F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 44))


def kd_leaves(points: DataFrame, dims: list[str], leaves: int) -> tuple[DataFrame, int]:
    """``points``: coordinates ``dims`` (22 bits), ``p_tie`` (38 bits), ``p_row`` (60
    bits) and ``p_size``. Returns ``(points + p_leaf, leaves)``; leaf numbers follow the
    tree from left to right."""
    points = stage_table(points.withColumn("p_node", F.lit(0)).withColumn("p_divided", F.lit(False)), "kd")
    span = points.agg(F.sum("p_size").alias("w"), *[F.min(d).alias(f"a{i}") for i, d in enumerate(dims)],
                      *[F.max(d).alias(f"b{i}") for i, d in enumerate(dims)]).first()
    if span["a0"] is None:
        return points.drop("p_divided").withColumnRenamed("p_node", "p_leaf"), leaves
    share = span["w"] / leaves               # a point beyond it outgrows a shard
    full = [max(1, span[f"b{i}"] - span[f"a{i}"]) for i in range(len(dims))]
    nodes = {0: leaves}                      # first leaf number -> leaves below
    while any(n > 1 for n in nodes.values()):
        live = [k for k, n in nodes.items() if n > 1]
        stats = points.filter(F.col("p_node").isin(live)).groupBy("p_node").agg(
            F.sum("p_size").alias("w"),
            *[(F.max(d) - F.min(d)).alias(f"s{i}") for i, d in enumerate(dims)]).collect()
        splits = {}
        for r in stats:
            widest = max(range(len(dims)), key=lambda i: (r[f"s{i}"] / full[i], -i))
            left = nodes[r["p_node"]] // 2
            splits[r["p_node"]] = {"dim": widest, "left": left, "w": r["w"],
                                   "goal": r["w"] * left / nodes[r["p_node"]],
                                   "cut": None, "l": [], "r": [], "part": None, "part_cut": -1}
        _find_cuts(points, dims, splits, share)
        points = stage_table(_routed(points, dims, splits), "kd")
        for k in live:
            n = nodes[k]
            nodes[k] = n // 2
            nodes[k + n // 2] = n - n // 2
    return points.drop("p_divided").withColumnRenamed("p_node", "p_leaf"), leaves


def _keyed(points: DataFrame, dims: list[str], splits: dict) -> DataFrame:
    """Rows of the split nodes with the node's plan and ``p_key`` in its dimension."""
    spark = points.sparkSession
    plan = spark.createDataFrame(
        [(k, s["dim"], s["left"], s["cut"], s["l"], s["r"], s["part"], s["part_cut"]) for k, s in splits.items()],
        "q_node int, q_dim int, q_left int, q_cut bigint, q_l array<bigint>, q_r array<bigint>, "
        "q_part bigint, q_part_cut bigint")
    coord = F.element_at(F.array(*dims), F.col("q_dim") + 1)
    # one row per tree node: bounded by the shard count
    return (points.join(F.broadcast(plan), F.col("p_node") == F.col("q_node"), "left")
            .withColumn("p_key", F.shiftleft(coord, TIE_BITS).bitwiseOR(F.col("p_tie"))))


def _cuts(rows: DataFrame, key: str, goals: dict[int, float]) -> list:
    spark = rows.sparkSession
    goals = spark.createDataFrame([(k, float(g)) for k, g in goals.items()], "grp int, target double")
    return weighted_cuts(rows.select(F.col("p_node").alias("grp"), F.col(key).alias("key"),
                                     F.col("p_size").alias("weight")), goals).collect()


def _find_cuts(points: DataFrame, dims: list[str], splits: dict, share: float) -> None:
    """Fill ``cut`` (rows with key <= cut go left), the points kept whole on the
    left (``l``) or right (``r``) though the cut says otherwise and a point that is
    divided (``part``)."""
    divide, hard = {}, {}

    def settle(s: dict, c, outgrown: set, node: int) -> bool:
        """Take the cut, exactly by dividing its point if that outgrows a shard; false if it misses."""
        over = c["below"] + c["atom"] - s["goal"]              # what too much goes left with the point
        under = s["goal"] - c["below"]                         # what is missing without it
        if c["atom"] and min(over, under) > s["w"] * TOLERANCE and (c["atom"] > share or c["cut"] in outgrown):
            s["cut"], s["part"], s["need"] = c["cut"] - 1, c["cut"], under
            divide[node] = s
            return True
        s["cut"] = c["cut"] if over <= under else c["cut"] - 1
        return not c["atom"] or min(over, under) <= s["w"] * TOLERANCE

    rows = _keyed(points, dims, splits).filter(F.col("q_node").isNotNull())
    for c in _cuts(rows, "p_key", {k: s["goal"] for k, s in splits.items()}):
        if not settle(splits[c["grp"]], c, set(), c["grp"]):
            hard[c["grp"]] = splits[c["grp"]]
    if hard:
        spark = points.sparkSession
        least = spark.createDataFrame([(k, 2 * TOLERANCE * s["w"]) for k, s in hard.items()], "h_node int, h_least double")
        rows = _keyed(points, dims, hard).filter(F.col("q_node").isNotNull())
        # at most 1 / (2 * TOLERANCE) points per node
        heavy = (rows.groupBy("p_node", "p_key").agg(F.sum("p_size").alias("atom"), F.max("p_divided").alias("cut"))
                 .join(F.broadcast(least), F.col("p_node") == F.col("h_node")).filter("atom > h_least")
                 .orderBy("p_node", "p_key").collect())
        outgrown: dict[int, set] = {k: set() for k in hard}
        whole: dict[int, list] = {k: [] for k in hard}
        for r in heavy:
            if r["atom"] > share or r["cut"]:
                outgrown[r["p_node"]].add(r["p_key"])
            else:
                whole[r["p_node"]].append((r["p_key"], r["atom"]))
        goals = {}
        for k, s in hard.items():
            s["l"] = _left_whole(whole[k], s["cut"], s["goal"], s["w"])
            s["r"] = [key for key, _ in whole[k] if key not in set(s["l"])]
            s["goal"] -= sum(a for key, a in whole[k] if key in set(s["l"]))
            goals[k] = s["goal"]
        rows = _keyed(points, dims, hard).filter(
            F.col("q_node").isNotNull()
            & ~F.array_contains("q_l", F.col("p_key")) & ~F.array_contains("q_r", F.col("p_key")))
        for c in _cuts(rows, "p_key", goals):
            s = hard[c["grp"]]
            if c["atom"]:
                settle(s, c, outgrown[c["grp"]], c["grp"])
            else:                                              # none or all of the rest
                s["cut"] = -1 if s["goal"] <= 0 else c["cut"]
            s["l"] = [key for key in s["l"] if key > s["cut"]]
            s["r"] = [key for key in s["r"] if key <= s["cut"]]
    if divide:
        rows = _keyed(points, dims, divide).filter(F.col("q_part") == F.col("p_key"))
        for c in _cuts(rows, "p_row", {k: s["need"] for k, s in divide.items()}):
            divide[c["grp"]]["part_cut"] = c["cut"]


def _left_whole(whole: list[tuple[int, int]], cut: int, goal: float, w: int) -> list[int]:
    """Which of a node's heavy points ``key, atom`` go left, so that the rest of the node
    can fill what is missing to ``goal``: those up to the cut if that will do, else a
    sum in that range, else the nearest sum."""
    rest = w - sum(a for _, a in whole)
    miss = lambda left: max(0.0, left - goal, goal - rest - left)
    mine = [key for key, _ in whole if key <= cut]
    if not miss(sum(a for key, a in whole if key <= cut)):
        return mine
    # subset sums: per step of the node's bytes the first set found, by exact sum
    sums: dict[int, tuple[int, tuple | None]] = {0: (0, None)}
    for key, a in sorted(whole, key=lambda x: -x[1]):
        for left, chain in list(sums.values()):
            place = (left + a) * STEPS // w
            if place not in sums:
                sums[place] = (left + a, (key, chain))
    _, chain = min(sums.values(), key=lambda x: (miss(x[0]), x[0]))
    out = []
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return sorted(out)


def _routed(points: DataFrame, dims: list[str], splits: dict) -> DataFrame:
    key = F.col("p_key")
    left = (F.when(F.array_contains("q_l", key), True).when(F.array_contains("q_r", key), False)
            .when(key == F.coalesce("q_part", F.lit(-1)), F.col("p_row") <= F.col("q_part_cut"))
            .otherwise(key <= F.col("q_cut")))
    node = F.when(F.col("q_node").isNull() | left, F.col("p_node")).otherwise(F.col("p_node") + F.col("q_left"))
    divided = F.col("p_divided") | F.coalesce(key == F.col("q_part"), F.lit(False))
    return _keyed(points, dims, splits).select(*[c for c in points.columns if c not in ("p_node", "p_divided")],
                                               node.alias("p_node"), divided.alias("p_divided"))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """Shard ``docs`` (``doc_id, text, lang``) into ``shards`` leaves, or into leaves of
    about ``target_bytes``: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.
    Dimensions: text length, line count (log scales) and language."""
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1
    lines = F.coalesce(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0))
    tie = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - TIE_BITS)
    points = docs.select(
        F.col("doc_id"), size.alias("p_size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("p_crc"),
        log_coord(F.char_length(text)).alias("c_chars"), log_coord(lines).alias("c_lines"),
        text_coord(F.col("lang")).alias("c_lang"), tie.alias("p_tie"), row_key(F.col("doc_id")).alias("p_row"))
    if shards is None:
        points = stage_table(points, "kd")
        total = points.agg(F.sum("p_size")).first()[0] or 1
        shards = max(1, math.ceil(total / (target_bytes or 1 << 30)))
    points, _ = kd_leaves(points, ["c_chars", "c_lines", "c_lang"], shards)
    rows = points.select("doc_id", F.col("p_size").alias("size"), F.col("p_crc").alias("text_crc32"),
                         F.col("p_leaf").cast("int").alias("shard"), "p_row")
    numbered = dense_index(rows, ["shard", "p_row", "doc_id", "text_crc32"], out="idx")
    numbered = stage_table(numbered, "kd-rows")
    first = numbered.groupBy("shard").agg(F.min("idx").alias("first_idx"))
    return numbered.join(F.broadcast(first), "shard").select(      # one row per shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("idx") - F.col("first_idx")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
