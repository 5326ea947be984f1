"""The operators' queries over the given tables, with DuckDB SQL where SQL can
say the same. Every query reads its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import (chat_format, decontaminate, importance, line_dedup, merkle, mixing, ngram_join, piece_bpe, pii,
                        sharding, simhash, substring_dedup, toxicity)
from quarry.llm.common import read_table, word_count

QueryFn = Callable[[SparkSession, str], DataFrame]
MIX_WEIGHTS, MIX_BUDGET, MIX_EPOCHS = [3, 1, 2], 1.5, 2
SHARDS = 8


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(read_table(spark, sf_dir, "documents"), shards=SHARDS)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    plan = mixing.mixture(docs, MIX_WEIGHTS, MIX_BUDGET, MIX_EPOCHS)
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mixing.with_repeats(rows, plan).select(
        "doc_id", "size", F.col("m_size").alias("source_size"), F.col("m_target").alias("target"),
        (F.col("size") * F.col("m_repeats")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || doc_id), 1, 15))::BIGINT AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, 2 * source_size AS cap, (SELECT 1.5 * sum(source_size) FROM s) AS budget,
         row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS pos FROM s),
l AS (
  SELECT *, (budget::DOUBLE - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(w) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv FROM o),
v AS (SELECT min_by(lv, pos) AS lv FROM l WHERE lv * w <= cap),
t AS (SELECT source, source_size, least(cap::DOUBLE, lv * w) AS target FROM o, v),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key) AS through
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
c AS (
  SELECT *, rest > 0 AND (through <= rest OR (through - size < rest AND through - rest <= rest - (through - size))) AS more
  FROM r)
SELECT doc_id, size, source_size, target, size * (whole + more::BIGINT) AS taken FROM c
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(read_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM s),
m AS (SELECT win, min(doc_id) AS least FROM g GROUP BY win),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM g JOIN m USING (win) WHERE least < doc_id),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT p.doc_id, string_agg(p.w[p.pos], ' ' ORDER BY p.pos) AS kept, count(*) AS n_kept
      FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.pos = r.pos WHERE r.pos IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, NULL::BIGINT AS item_id, text FROM documents
  UNION ALL SELECT NULL, item_id, text FROM benchmark),
t AS (
  SELECT doc_id, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM d),
s AS (
  SELECT doc_id, item_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' ;short'] ELSE [] END) AS sh FROM t),
n AS (SELECT item_id, count(*) AS n_item FROM s WHERE item_id IS NOT NULL GROUP BY item_id),
h AS (
  SELECT a.doc_id, b.item_id, count(*) AS n_shared FROM s a JOIN s b ON a.sh = b.sh
  WHERE a.doc_id IS NOT NULL AND b.item_id IS NOT NULL GROUP BY ALL)
SELECT doc_id, item_id, n_item::BIGINT AS n_item, n_shared::BIGINT AS n_shared
FROM h JOIN n USING (item_id) WHERE 100 * n_shared >= 75 * n_item
"""

LINE_DOCS = 10


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.drop_common_lines(read_table(spark, sf_dir, "documents"), LINE_DOCS)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
f AS (SELECT k.*, k.key IN (SELECT key FROM c) AS gone FROM k)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(pii.listed({k: F.col(k) for k in pii.KINDS}), 256).alias("base_sha256"),
                        pii.listed(pii.all_spans()).alias("spans"))


PROBE = "</s>[INST] ok [/INST]"
EVENTS = 4                       # sequence numbers of a turn


def turn_events(rows: DataFrame) -> DataFrame:
    """The log of a table of turns: each row is a message of its own (an id for every row),
    begun empty and streamed in two deltas."""
    text = F.coalesce("text", F.lit(""))
    half = (F.char_length(text) / 2).cast("int")
    event = lambda i, op, said: F.struct(F.lit(i).alias("part"), F.lit(op).alias("op"), said.alias("said"))
    parts = F.array(event(0, "message", F.lit("")), event(1, "delta", F.substr(text, F.lit(1), half)),
                    event(2, "delta", F.substr(text, half + 1)))
    turn = F.coalesce("turn", F.lit(-(1 << 60)))           # rows without a turn come first
    numbered = rows.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().cast("string").alias("msg_id"))
    return (numbered.select("conv_id", turn.alias("turn"), "role", "msg_id", F.inline(parts))
            .select("conv_id", (F.col("turn") * EVENTS + F.col("part")).alias("seq"), "op", "msg_id", "role",
                    F.col("said").alias("text")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(PROBE).alias("text"))
    events = turn_events(rows.unionByName(probe))
    back = chat_format.read_back(chat_format.render(chat_format.messages(events)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.char_length("loss_text").cast("bigint").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("bigint").alias("formatted_chars"))


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS body,
         replace(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'),
                         '|', '&#124;'), chr(10), '&#10;') AS head FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(body) + length(head) + 13)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def sql_crc32(codes: str) -> str:
    """CRC-32 of a list of byte values as DuckDB SQL."""
    bit = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    step = f"list_reduce(range(8), lambda a, i: {bit}, xor(acc, b::BIGINT))"
    return f"xor(list_reduce({codes}, lambda acc, b: {step}, 4294967295::BIGINT), 4294967295)"


MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in MANIFEST_FIELDS]
    harmed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in MANIFEST_FIELDS]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    rows = docs.select(F.col("doc_id").cast("bigint").alias("key"), F.col("lang").alias("grp"),
                       merkle.leaf_hash(*fields).alias("leaf"), F.when(tampered, merkle.leaf_hash(*harmed)).alias("changed"))
    return merkle.proofs(rows).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _sql_field(expr: str) -> str:
    return f"coalesce(octet_length(encode(({expr})::VARCHAR))::VARCHAR || ':' || ({expr})::VARCHAR, '-')"


_LEAF, _HARMED = (" || ".join(_sql_field(f"{c} + 1" if harm and c == "n_chars" else c) for c in MANIFEST_FIELDS)
                  for harm in (False, True))
_DECIMAL = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c))"
OP11_SQL = f"""
WITH RECURSIVE
l AS (SELECT doc_id, lang, sha256({_LEAF}) AS leaf,
             CASE WHEN {sql_crc32(_DECIMAL)} % 7 = 0 THEN sha256({_HARMED}) END AS changed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (
  SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM p
  UNION ALL
  SELECT a.lang, a.lvl + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, ''))
  FROM t a LEFT JOIN t b ON a.lang IS NOT DISTINCT FROM b.lang AND b.pos = a.pos + 1 WHERE a.n > 1 AND a.pos % 2 = 0),
s AS (SELECT lang, lvl, h, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
      FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, pos, n, h FROM s
  UNION ALL
  SELECT a.lvl + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, ''))
  FROM u a LEFT JOIN u b ON b.pos = a.pos + 1 WHERE a.n > 1 AND a.pos % 2 = 0),
steps AS (
  SELECT p.lang, p.pos, w.lvl, (p.pos >> w.lvl) % 2 AS slot, x.h AS sib
  FROM p JOIN (SELECT DISTINCT lang, lvl FROM t WHERE n > 1) w ON p.lang IS NOT DISTINCT FROM w.lang
  LEFT JOIN t x ON x.lang IS NOT DISTINCT FROM p.lang AND x.lvl = w.lvl AND x.pos = xor(p.pos >> w.lvl, 1)
  UNION ALL
  SELECT p.lang, p.pos, s.lvl + w.lvl, (s.pos >> w.lvl) % 2, x.h
  FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT DISTINCT lvl FROM u WHERE n > 1) w
  LEFT JOIN u x ON x.lvl = w.lvl AND x.pos = xor(s.pos >> w.lvl, 1)),
f AS (
  SELECT lang, pos, 0 AS lvl, coalesce(changed, leaf) AS h FROM p
  UNION ALL
  SELECT f.lang, f.pos, f.lvl + 1, sha256(CASE WHEN slot = 0 THEN f.h || coalesce(sib, '') ELSE sib || f.h END)
  FROM f JOIN steps ON f.lang IS NOT DISTINCT FROM steps.lang AND f.pos = steps.pos AND f.lvl = steps.lvl),
e AS (SELECT lang, pos, arg_max(h, lvl) AS folded FROM f GROUP BY lang, pos),
q AS (SELECT lang, pos, sha256(coalesce(string_agg(sib, '' ORDER BY lvl), '')) AS proof FROM steps GROUP BY lang, pos)
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, coalesce(q.proof, sha256('')) AS proof_sha256, e.folded AS folded_root,
       e.folded = r.h AS verified
FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT h FROM u WHERE n = 1) r
JOIN e ON p.lang IS NOT DISTINCT FROM e.lang AND p.pos = e.pos
LEFT JOIN q ON p.lang IS NOT DISTINCT FROM q.lang AND p.pos = q.pos
"""

def vocabulary_path() -> str:
    """The tokenizer's file; tasks get its tables, not the path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    rows = piece_bpe.decode(piece_bpe.encode(read_table(spark, sf_dir, "documents"), path), path)
    return rows.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_CODES = "list_transform(range(0, length(hex(w)), 2), lambda i: ('0x' || substr(hex(w), i + 1, 2))::BIGINT)"
OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text, 0 AS side FROM documents
  UNION ALL SELECT NULL, NULL, text, 1 FROM benchmark),
x AS (
  SELECT r, doc_id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d),
o AS (SELECT r, side, w, count(*) AS k FROM (SELECT r, side, unnest(ws) AS w FROM x) GROUP BY ALL),
b AS (SELECT w, {sql_crc32(_CODES)} % 10000 AS bucket FROM (SELECT DISTINCT w FROM o)),
n AS (SELECT bucket, coalesce(sum(k) FILTER (WHERE side = 0), 0)::DOUBLE AS s,
             coalesce(sum(k) FILTER (WHERE side = 1), 0)::DOUBLE AS t FROM o JOIN b USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + 10000)
             / ((s + 1) * ((SELECT sum(t) FROM n) + 10000))))::BIGINT AS gain FROM n),
m AS (SELECT r, floor(sum(k * gain)::DOUBLE / sum(k)::DOUBLE)::BIGINT AS weight
      FROM o JOIN b USING (w) JOIN g USING (bucket) WHERE side = 0 GROUP BY r),
c AS (
  SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                   / 4294967296::DOUBLE)))::BIGINT AS score
  FROM x LEFT JOIN m USING (r) WHERE side = 0),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM c WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM c LEFT JOIN k USING (r)
"""

_QUERIES: dict[str, QueryFn] = {
    "op1_kd_sharding": op1_kd_sharding,
    "op2_mixing": op2_mixing,
    "op3_ngram_join": op3_ngram_join,
    "op4_simhash": op4_simhash,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op9_pii": op9_pii,
    "op10_chat_format": op10_chat_format,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_importance_resampling": op13_importance_resampling,
}
_SQL: dict[str, str] = {"op2_mixing": OP2_SQL, "op5_substring_dedup": OP5_SQL, "op7_decontamination": OP7_SQL,
                        "op8_line_dedup": OP8_SQL, "op10_chat_format": OP10_SQL, "op11_merkle_manifest": OP11_SQL,
                        "op13_importance_resampling": OP13_SQL}


def _prepared(fn: QueryFn) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quarry.session import ensure_checkpoint_dir, ship_package
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return fn(spark, sf_dir)
    return run


def llm_queries() -> dict[str, QueryFn]:
    import corpus_pipeline
    return {name: _prepared(fn) for name, fn in (_QUERIES | {"pipeline": corpus_pipeline.run}).items()}


def llm_sql() -> dict[str, str]:
    return dict(_SQL)
