"""Shared SQL fragments for the DuckDB oracles (same semantics as the engine)."""

from __future__ import annotations

import hashlib

from quarry.config import DEFAULT_CONFIG
from quarry.functions.text import WHITESPACE, WS_CLASS

SEED = DEFAULT_CONFIG.seed
# whitelist used with the test tables: the first five sources act as genres
TEST_GENRES = ("src0", "src1", "src2", "src3", "src4")

WS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"
WS_RE = WS_CLASS + "+"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


GENRES_SQL = sql_list(TEST_GENRES)


def strip(expr: str) -> str:
    return f"trim({expr}, {WS_SQL})"


def h(parts: list[str], digits: int = 8) -> str:
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', {joined})), 1, {digits}))::BIGINT"


def hkey(parts: list[str]) -> str:
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"md5(concat_ws('|', {joined}))"


def kw_cands(body: str) -> str:
    return (f"list_filter(regexp_split_to_array({body}, '{WS_RE}'), "
            r"lambda w: length(w) >= 5 AND regexp_full_match(w, '\p{L}+'))")


def ring_offsets_sql(n: str, pool: str, key: str, tag: str = "neg") -> str:
    """Same draws as quarry.functions.rand.ring_offsets."""
    step = (f"list_reduce(list_sort(acc), lambda x, s: CASE WHEN x >= s THEN x + 1 ELSE x END, "
            f"{h([str(SEED), repr(tag), key, 'j'], 15)} % ({pool} - j))")
    return f"list_reduce(range({n}), lambda acc, j: list_append(acc, {step}), []::BIGINT[])"


def kw_sample(cands: str, key: str, tag: str) -> str:
    n = f"least(len({cands}), 1 + {h([str(SEED), repr(tag + '#n'), key])} % 3)"
    offs = ring_offsets_sql(n, f"len({cands})", key, tag)
    return f"list_transform({offs}, lambda o: {cands}[o + 1])"


TAGGED = """tagged AS (
  SELECT doc_id AS entry_id,
         '<' || source || '> </' || source || '> <' || lang || '> </' || lang || '> prompt ' || text AS text
  FROM documents)"""


def parsed_cte(src: str = "tagged", text: str = "text", key: str = "entry_id",
               dedup: bool = False, name: str = "parsed") -> str:
    tags = r"list_filter(regexp_extract_all(" + text + r", '<([^>]+)>', 1), lambda t: NOT starts_with(t, '/'))"
    if dedup:
        tags = f"list_filter({tags}, lambda t, i: list_position({tags}, t) = i)"
    return f"""{name}_0 AS (
  SELECT *, {tags} AS tags,
         {strip(f"string_split({text}, 'prompt ')[-1]")} AS body
  FROM {src}),
{name}_1 AS (
  SELECT *, list_filter(tags, lambda t: list_contains({GENRES_SQL}, t)) AS genres FROM {name}_0),
{name} AS (
  SELECT *, list_filter(tags, lambda t: NOT list_contains(genres, t) AND t <> 'prompt') AS themes,
         list_filter({GENRES_SQL}, lambda g: NOT list_contains(genres, g)) AS opposite
  FROM {name}_1)"""


def eval_rows_cte(parsed: str = "parsed", name: str = "eval_rows") -> str:
    kws = kw_sample(kw_cands("body"), "entry_id", "kw")
    return f"""{name}_q AS (
  SELECT entry_id, text AS context, genres[1] AS g0, themes[1] AS t0, opposite[1] AS og,
         {kws} AS kws
  FROM {parsed}),
{name} AS (
  SELECT entry_id, entry_id * 4 + 0 AS row_id, 'genre' AS kind,
         'Find a ' || g0 || ' writing prompt' AS query, context, 1.0::DOUBLE AS relevance
  FROM {name}_q WHERE g0 IS NOT NULL
  UNION ALL
  SELECT entry_id, entry_id * 4 + 1, 'theme', 'Find a ' || g0 || ' prompt about ' || lower(t0),
         context, 1.0::DOUBLE
  FROM {name}_q WHERE g0 IS NOT NULL AND t0 IS NOT NULL
  UNION ALL
  SELECT entry_id, entry_id * 4 + 2, 'keyword',
         'Find a writing prompt about ' || lower(array_to_string(kws, ' and ')), context, 1.0::DOUBLE
  FROM {name}_q WHERE len(kws) > 0
  UNION ALL
  SELECT entry_id, entry_id * 4 + 3, 'negative', 'Find a ' || og || ' writing prompt',
         context, 0.0::DOUBLE
  FROM {name}_q WHERE og IS NOT NULL)"""


EVAL_SET_CTES = f"{TAGGED},\n{parsed_cte()},\n{eval_rows_cte()}"


def alt_rows_cte(parsed: str, key: str, name: str = "alt_rows") -> str:
    """Alternative queries (genre, genre+theme 'story', keywords) per parsed row."""
    return f"""{name}_q AS (
  SELECT {key} AS akey, genres[1] AS g0, themes[1] AS t0,
         {kw_sample(kw_cands('body'), key, 'altkw')} AS kws
  FROM {parsed}),
{name}_u AS (
  SELECT akey, 0 AS kind_pos, 'Find a ' || g0 || ' writing prompt' AS query FROM {name}_q
  WHERE g0 IS NOT NULL
  UNION ALL
  SELECT akey, 1, 'Find a ' || g0 || ' story about ' || lower(t0) FROM {name}_q
  WHERE g0 IS NOT NULL AND t0 IS NOT NULL
  UNION ALL
  SELECT akey, 2, 'Find a writing prompt about ' || lower(array_to_string(kws, ' and '))
  FROM {name}_q WHERE len(kws) > 0),
{name} AS (
  SELECT akey, (row_number() OVER (PARTITION BY akey ORDER BY kind_pos))::INTEGER AS aug_pos, query
  FROM {name}_u)"""


def contexts_cte(src: str, order: str, name: str = "ctx") -> str:
    """Distinct contexts of ``src`` with dense first-seen ids, plus their count."""
    firsts = ", ".join(f"{c.strip()} AS first_{c.strip()}" for c in order.split(","))
    return f"""{name}_first AS (
  SELECT context, {order}, row_number() OVER (PARTITION BY context ORDER BY {order}) AS rn,
         count(*) OVER (PARTITION BY context) AS n_rows
  FROM {src}),
{name} AS (
  SELECT context, n_rows, {firsts}, row_number() OVER (ORDER BY {order}) - 1 AS ctx_id
  FROM {name}_first WHERE rn = 1),
{name}_n AS (SELECT count(*) AS c FROM {name})"""


STARTERS_SQL = sql_list(s.lower() for s in DEFAULT_CONFIG.starters)


def clean_query_sql(q: str) -> str:
    stripped = (f"list_reduce({STARTERS_SQL}, lambda acc, s: CASE WHEN starts_with(lower(acc), s) "
                f"THEN {strip('substr(acc, length(s) + 1)')} ELSE acc END, {q})")
    return f"(lower(substr({stripped}, 1, 1)) || substr({stripped}, 2))"


TEST_SET_CTES = f"""{TAGGED},
{parsed_cte()},
resp AS (SELECT conv_id AS entry_id, turn AS resp_id, text AS response
         FROM conversations WHERE role = 'assistant'),
rlines AS (
  SELECT entry_id, resp_id, line_no, {strip('raw')} AS q FROM (
    SELECT entry_id, resp_id, unnest(parts) AS raw, unnest(range(len(parts))) AS line_no
    FROM (SELECT entry_id, resp_id, string_split(response, chr(10)) AS parts
          FROM resp WHERE response IS NOT NULL))),
test_set AS (
  SELECT l.entry_id, l.resp_id, l.line_no, {clean_query_sql('l.q')} AS query,
         coalesce(p.body, '') AS context
  FROM rlines l JOIN parsed p USING (entry_id) WHERE l.q <> '')"""


def cos_sql(a: str, b: str) -> str:
    na, nb = f"list_dot_product({a}, {a})", f"list_dot_product({b}, {b})"
    return (f"(CASE WHEN {na} = 0 OR {nb} = 0 THEN 0.0 "
            f"ELSE list_dot_product({a}, {b}) / (sqrt({na}) * sqrt({nb})) END)")


def dot_sql(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


VECTOR_DIMS = 64


def fold_sign(j: int) -> float:
    """Seeded sign of dimension ``j`` in the folded test vectors (model B)."""
    return -1.0 if int(hashlib.md5(f"{SEED}|fold|{j}".encode()).hexdigest()[:8], 16) & 1 else 1.0


def _model_vector_sql(dims: int) -> str:
    if dims == VECTOR_DIMS:
        return "embedding::DOUBLE[]"
    return "[" + ", ".join(
        " + ".join(f"embedding[{j + 1}]::DOUBLE * {fold_sign(j)}::DOUBLE" for j in range(i, VECTOR_DIMS, dims))
        for i in range(dims)) + "]"


def emb_ctes(dims: int = 64, outer: bool = False, sim: str = "cos", p: str = "") -> str:
    """Embedding eval rows (see plans.common.emb_rows), vectors and all
    query x corpus scores with their rank (oracle only: all pairs)."""
    join = "LEFT JOIN" if outer else "JOIN"
    simf = cos_sql if sim == "cos" else dot_sql
    return f"""{p}e AS (SELECT vec_id, {_model_vector_sql(dims)} AS v, label FROM embeddings),
{p}rows AS (
  SELECT q.vec_id * 3 + o.off - 1 AS row_id, q.vec_id AS query_id, q.vec_id + o.off AS ctx_id,
         CASE WHEN q.label = c.label THEN 1.0 ELSE 0.0 END::DOUBLE AS relevance,
         c.vec_id IS NULL AS context_empty
  FROM {p}e q CROSS JOIN (SELECT unnest([1, 2, 3]) AS off) o {join} {p}e c ON c.vec_id = q.vec_id + o.off),
{p}qs AS (SELECT DISTINCT query_id FROM {p}rows WHERE NOT context_empty),
{p}cs AS (SELECT DISTINCT ctx_id FROM {p}rows WHERE NOT context_empty),
{p}pairs AS (
  SELECT qs.query_id, cs.ctx_id, {simf('q.v', 'c.v')} AS score
  FROM {p}qs qs JOIN {p}e q ON q.vec_id = qs.query_id CROSS JOIN {p}cs cs JOIN {p}e c ON c.vec_id = cs.ctx_id),
{p}ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ctx_id) AS rank FROM {p}pairs)"""


def hash_vec_cte(name: str, src: str, id_col: str, text_col: str, dim: int, seed: int) -> str:
    """Vectors of the default hash encoder (see quarry.operators.encode):
    ``<name>(vid, v)`` with signed bucket counts over lower-cased
    letter/digit tokens."""
    return f"""{name}_tok AS (
  SELECT {id_col} AS vid, unnest(regexp_split_to_array(lower({text_col}), '[^\\p{{L}}\\p{{N}}]+')) AS t
  FROM {src}),
{name}_h AS (SELECT vid, {h([str(seed), 't'], 15)} AS hv FROM {name}_tok WHERE t <> ''),
{name}_b AS (
  SELECT vid, hv % {dim} AS b, sum(CASE WHEN (hv >> 40) & 1 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v
  FROM {name}_h GROUP BY ALL),
{name} AS (
  SELECT i.vid, list(coalesce(c.v, 0.0) ORDER BY r.b) AS v
  FROM (SELECT DISTINCT {id_col} AS vid FROM {src}) i CROSS JOIN range({dim}) r(b)
  LEFT JOIN {name}_b c ON c.vid = i.vid AND c.b = r.b
  GROUP BY i.vid)"""


def text_index_ctes(ev: str = "ev") -> str:
    """First-seen ids of distinct query / context texts and the id rows."""
    return f"""qi AS (SELECT query AS text, min(row_id) AS query_id FROM {ev} GROUP BY query),
ci AS (SELECT context AS text, min(row_id) AS ctx_id FROM {ev} GROUP BY context),
trows AS (
  SELECT e.row_id, qi.query_id, ci.ctx_id, e.relevance
  FROM {ev} e JOIN qi ON qi.text = e.query JOIN ci ON ci.text = e.context)"""


def text_model_ctes(p: str, dim: int, seed: int, sim: str = "cos") -> str:
    """Vectors, all query x context scores and ranks of one hash model."""
    simf = cos_sql if sim == "cos" else dot_sql
    return f"""{hash_vec_cte(p + 'qv', 'qi', 'query_id', 'text', dim, seed)},
{hash_vec_cte(p + 'cv', 'ci', 'ctx_id', 'text', dim, seed)},
{p}rows AS (SELECT * FROM trows),
{p}pairs AS (
  SELECT q.vid AS query_id, c.vid AS ctx_id, {simf('q.v', 'c.v')} AS score
  FROM {p}qv q CROSS JOIN {p}cv c),
{p}ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ctx_id) AS rank FROM {p}pairs)"""
