"""Document fingerprints by SimHash (native expressions only).

Terms are the 3-word shingles of a text (all its words together if it has
fewer), weighted by how often they occur. Every occurrence votes on 128 bits
of its term's hash; a bit is set if more than half of the votes set it. Votes
are counted two bits to a long (32-bit counters), in one aggregate per
document that never leaves the document's task.

``near_fingerprints`` finds all fingerprints within a Hamming radius r < 4:
four tables, each led by another 32-bit block of the fingerprint; two
fingerprints at most three bits apart agree in one block (pigeonhole), so an
equality join per table finds every candidate, verified by the distance.
Equal fingerprints are one row before the join.

Defined results: null, empty and blank texts have no terms and fingerprint 0;
equal texts have equal fingerprints; the order of documents is descending
doc_id (ties by text hash, rows without doc_id last); identical rows are one
document in that order and each gets its result; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD
from quarry.operators.ids import dense_index
from quarry.session import stage_table

GRAM = 3
BITS = 128
BLOCKS = 4
_LANES = 32
_PAIR = (1 << 32) | 1


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, f1, f2`` (two longs, 128 bits), one row per distinct ``keys``. The
    votes of a document stay in its task if ``rows`` is partitioned by ``keys``."""
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    terms = (rows.select(*keys, words.alias("w"))
             .select(*keys, "w", F.posexplode_outer("w").alias("i", "_word"))
             .filter(F.col("i").isNull() | (F.col("i") == 0) | (F.col("i") <= F.size("w") - GRAM)))
    gram = [F.get("w", F.col("i") + j) for j in range(GRAM)]
    hashed = terms.select(*keys, F.col("i").isNotNull().alias("t"), F.xxhash64(*gram).alias("h0"),
                          F.xxhash64(F.lit(7), *gram).alias("h1"))
    lanes = [F.sum(F.when(F.col("t"), F.shiftrightunsigned(h, lane).bitwiseAND(F.lit(_PAIR)))).alias(f"{h}_{lane}")
             for h in ("h0", "h1") for lane in range(_LANES)]
    votes = hashed.groupBy(*keys).agg(F.sum(F.col("t").cast("bigint")).alias("total"), *lanes)

    def bits(h: str) -> Column:
        out = []
        for lane in range(_LANES):
            c = F.coalesce(F.col(f"{h}_{lane}"), F.lit(0))
            low, high = c.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(c, 32)
            out.append(F.when(low * 2 > F.col("total"), F.lit(1 << lane)).otherwise(F.lit(0)).cast("bigint"))
            set_high = (1 << (lane + 32)) - (1 << 64 if lane == 31 else 0)
            out.append(F.when(high * 2 > F.col("total"), F.lit(set_high)).otherwise(F.lit(0)).cast("bigint"))
        return reduce(lambda a, b: a.bitwiseOR(b), out)
    return votes.select(*keys, bits("h0").alias("f1"), bits("h1").alias("f2"))


def distance(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def as_text(f1: Column, f2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def near_fingerprints(queries: DataFrame, index: DataFrame, radius: int = 3) -> DataFrame:
    """All pairs of distinct fingerprints within ``radius``: ``f1, f2, g1, g2,
    distance``, for ``queries`` and ``index`` with columns ``f1, f2``."""
    if not 0 <= radius < BLOCKS:
        raise ValueError("radius must be below the number of block tables")

    def tables(df: DataFrame, a: str, b: str) -> DataFrame:
        block = [F.shiftrightunsigned("f1", 32), F.col("f1").bitwiseAND(F.lit(0xFFFFFFFF)),
                 F.shiftrightunsigned("f2", 32), F.col("f2").bitwiseAND(F.lit(0xFFFFFFFF))]
        rows = df.select("f1", "f2").distinct()
        return rows.select(F.col("f1").alias(a), F.col("f2").alias(b),
                           F.posexplode(F.array(*block)).alias("tab", "block"))
    left, right = tables(queries, "a1", "a2"), tables(index, "b1", "b2")
    d = distance(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2"))
    apart = (F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2"))
    return (left.join(right, ["tab", "block"]).filter(apart & (d <= radius))
            .select(F.col("a1").alias("f1"), F.col("a2").alias("f2"), F.col("b1").alias("g1"),
                    F.col("b2").alias("g2"), d.alias("distance")).distinct())


def _match(names: list[str], left: DataFrame, right: DataFrame, right_names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in zip(names, right_names, strict=True)])


def edited_pairs(documents: DataFrame) -> DataFrame:
    """Every row with the text that ends in the start of the next document's:
    ``doc_id, k1, k2, text, edited, copies, n1, n2, n3`` (``copies``: identical rows;
    ``n1..n3``: the next document's keys)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("k1"),
                            F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))
    narrow = (docs.groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("copies"),
                                                     F.max(F.char_length("text")).alias("n")))
    placed, total = dense_index(narrow.withColumn("down", F.bitwise_not("doc_id")).withColumn("none", F.col("doc_id").isNull()),
                                ["none", "down", "k1", "k2"], out="idx", with_total=True)
    placed = stage_table(placed.select("doc_id", "k1", "k2", "copies", "n", "idx"), "sh-order")
    following = placed.select(F.pmod(F.col("idx") - 1, F.lit(max(1, total))).alias("at"), F.col("doc_id").alias("n1"),
                              F.col("k1").alias("n2"), F.col("k2").alias("n3"))
    links = stage_table(placed.join(following, F.col("idx") == F.col("at"))
                        .select(F.col("doc_id").alias("o1"), F.col("k1").alias("o2"), F.col("k2").alias("o3"),
                                F.floor(F.col("n") / 3).cast("int").alias("need"), "copies", "n1", "n2", "n3"), "sh-links")
    own = ["doc_id", "k1", "k2"]
    heads = (docs.join(links, _match(own, docs, links, ["n1", "n2", "n3"]))
             .select("o1", "o2", "o3", F.substr("text", F.lit(1), F.col("need")).alias("head"), "need", "copies", "n1", "n2", "n3"))
    if placed.filter("copies > 1").limit(1).count():
        heads = heads.dropDuplicates(["o1", "o2", "o3"])      # a next document with identical rows counts once
    edited = F.concat(F.substr("text", F.lit(1), (F.char_length("text") - F.col("need")).cast("int")), F.col("head"))
    return (docs.join(heads, _match(own, docs, heads, ["o1", "o2", "o3"]))
            .select(*own, "text", edited.alias("edited"), "copies", "n1", "n2", "n3"))


def fingerprint_documents(documents: DataFrame, query_every: int = 20, radius: int = 3) -> DataFrame:
    """Fingerprints of every text and its edited text, their likeness (share of
    equal bits), that of the next document's, and, for the query set of doc_ids
    divisible by ``query_every``, the number of other fingerprints within ``radius``."""
    own = ["doc_id", "k1", "k2"]
    pairs = edited_pairs(documents)
    both = pairs.select(*own, "copies", "n1", "n2", "n3", F.char_length("text").cast("bigint").alias("n_chars"),
                        F.sha2("edited", 256).alias("edited_sha256"),
                        F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("body")),
                                          F.struct(F.lit(1).alias("v"), F.col("edited").alias("body")))).alias("x"))
    keys = [*own, "copies", "n1", "n2", "n3", "n_chars", "edited_sha256", "v"]
    # identical rows vote together: every vote counts as often, so no bit changes
    flat = fingerprints(both.select(*own, "copies", "n1", "n2", "n3", "n_chars", "edited_sha256", F.col("x.v").alias("v"),
                                    F.col("x.body").alias("body")), keys, "body")
    fps = stage_table(flat, "sh-fps")
    text, edited = fps.filter("v = 0"), fps.filter("v = 1").select(
        *[F.col(c).alias("e" + c) for c in own], F.col("f1").alias("e1"), F.col("f2").alias("e2"))
    after = fps.filter("v = 0").select(*[F.col(c).alias("a" + c) for c in own], F.col("f1").alias("a1"), F.col("f2").alias("a2"))
    near = (near_fingerprints(text.filter(F.col("doc_id") % query_every == 0), text, radius)
            .groupBy(F.col("f1").alias("q1"), F.col("f2").alias("q2")).agg(F.count(F.lit(1)).alias("found")))
    like = lambda a, b: (1 - distance(F.col("f1"), F.col("f2"), F.col(a), F.col(b)) / F.lit(BITS)).cast("double")
    asked = F.when(F.col("doc_id") % query_every == 0, F.coalesce("found", F.lit(0)).cast("bigint"))
    rows = (text.join(edited, _match(own, text, edited, ["e" + c for c in own]))
            .join(after, _match(["n1", "n2", "n3"], text, after, ["a" + c for c in own]))
            .join(near, (F.col("f1") == F.col("q1")) & (F.col("f2") == F.col("q2")), "left")
            .select("doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"),
                    "n_chars", "edited_sha256", as_text(F.col("f1"), F.col("f2")).alias("fingerprint"),
                    as_text(F.col("e1"), F.col("e2")).alias("edited_fingerprint"), like("e1", "e2").alias("near_edited"),
                    like("a1", "a2").alias("near_next"), asked.alias("near_fingerprints")))
    return rows.drop("copy")
