"""Catalogue: scans, parsing and template query generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import keyword_candidates, ustrip
from quarry.operators.parse import parse_entries, to_documents
from quarry.operators.querygen import add_alternative_queries
from quarry.plans.common import TEST_CFG, eval_set, joined, tagged
from quarry.plans.registry import query
from quarry.plans.sqlfrag import (EVAL_SET_CTES, TAGGED, kw_cands, kw_sample, parsed_cte,
                                  strip)
from quarry.sources.corpus import table_lines
from quarry.sources.tables import table

LINES_SQL = """
SELECT rec_id, line_no, {strip_line} AS line
FROM (SELECT rec_id, unnest(parts) AS raw, unnest(range(len(parts))) AS line_no
      FROM (SELECT {key} AS rec_id, regexp_split_to_array({col}, '\\r\\n|\\r|\\n') AS parts FROM {table}))
WHERE {strip_line} <> ''"""


def _lines_sql(table_name, key, col):
    return LINES_SQL.format(key=key, col=col, table=table_name, strip_line=strip("raw"))


@query("scan_nonblank", sql=_lines_sql("documents", "doc_id", "text"))
def scan_nonblank(spark, sf):
    return table_lines(table(spark, sf, "documents", spread_rows=True), "doc_id", "text")


@query("corpus_union", sql=f"""
SELECT 'documents' AS source_file, 0 AS file_pos, * FROM ({_lines_sql("documents", "doc_id::VARCHAR", "text")})
UNION ALL
SELECT 'conversations', 1, * FROM ({_lines_sql("conversations", "conv_id || '|' || turn", "text")})""")
def corpus_union(spark, sf):
    docs = table_lines(table(spark, sf, "documents", spread_rows=True).withColumn(
        "rec_id", F.col("doc_id").cast("string")), "rec_id", "text")
    conv = table(spark, sf, "conversations", spread_rows=True).withColumn(
        "rec_id", F.concat_ws("|", "conv_id", "turn"))
    conv = table_lines(conv, "rec_id", "text")
    return (docs.select(F.lit("documents").alias("source_file"), F.lit(0).alias("file_pos"), "*")
            .unionByName(conv.select(F.lit("conversations").alias("source_file"),
                                     F.lit(1).alias("file_pos"), "*")))


@query("extract_tags", sql=f"""
WITH {TAGGED}, {parsed_cte()}, {parsed_cte(dedup=True, name="parsed_d")}
SELECT p.entry_id, len(p.tags) AS n_tags, array_to_string(p.tags, '|') AS tags,
       array_to_string(d.tags, '|') AS tags_dedup
FROM parsed p JOIN parsed_d d USING (entry_id)""")
def extract_tags_q(spark, sf):
    p = parse_entries(tagged(spark, sf), cfg=TEST_CFG)
    from quarry.operators.parse import tags_col
    return p.select("entry_id", F.size("tags").cast("bigint").alias("n_tags"), joined(F.col("tags")).alias("tags"),
                    joined(tags_col(F.col("text"), dedup=True)).alias("tags_dedup"))


@query("extract_tags_html", sql="""
SELECT page_id, pos, tag FROM (
  SELECT page_id, unnest(t) AS tag, unnest(range(len(t))) AS pos
  FROM (SELECT page_id, list_filter(regexp_extract_all(html, '<([^>]+)>', 1),
                                    lambda x: NOT starts_with(x, '/')) AS t FROM pages))""")
def extract_tags_html(spark, sf):
    from quarry.operators.parse import tags_col
    pages = table(spark, sf, "pages", spread_rows=True)
    return (pages.select("page_id", F.posexplode(tags_col(F.col("html"))).alias("pos", "tag"))
            .select("page_id", F.col("pos").cast("bigint").alias("pos"), "tag"))


@query("extract_body", sql=f"""
WITH {TAGGED}, {parsed_cte()} SELECT entry_id, body FROM parsed""")
def extract_body_q(spark, sf):
    return parse_entries(tagged(spark, sf), cfg=TEST_CFG).select("entry_id", "body")


@query("genres_themes", sql=f"""
WITH {TAGGED}, {parsed_cte()}
SELECT entry_id, array_to_string(genres, '|') AS genres, array_to_string(themes, '|') AS themes,
       genres[1] AS first_genre, themes[1] AS first_theme FROM parsed""")
def genres_themes(spark, sf):
    p = parse_entries(tagged(spark, sf), cfg=TEST_CFG)
    return p.select("entry_id", joined(F.col("genres")).alias("genres"),
                    joined(F.col("themes")).alias("themes"),
                    F.get("genres", 0).alias("first_genre"), F.get("themes", 0).alias("first_theme"))


@query("opposite_genre", sql=f"""
WITH {TAGGED}, {parsed_cte()}
SELECT entry_id, array_to_string(opposite, '|') AS opposite, opposite[1] AS negative_genre
FROM parsed""")
def opposite_genre(spark, sf):
    p = parse_entries(tagged(spark, sf), cfg=TEST_CFG)
    return p.select("entry_id", joined(F.col("opposite")).alias("opposite"),
                    F.get("opposite", 0).alias("negative_genre"))


@query("documents_struct", sql=f"""
WITH {TAGGED}, {parsed_cte()}
SELECT entry_id, body AS page_content, array_to_string(genres, '|') AS genres,
       array_to_string(themes, '|') AS themes, array_to_string(tags, '|') AS tags,
       text AS original_text
FROM parsed""")
def documents_struct(spark, sf):
    d = to_documents(tagged(spark, sf), cfg=TEST_CFG)
    m = F.col("metadata")
    return d.select("entry_id", "page_content", joined(m["genres"]).alias("genres"),
                    joined(m["themes"]).alias("themes"), joined(m["tags"]).alias("tags"),
                    m["original_text"].alias("original_text"))


@query("keyword_candidates", sql=f"""
SELECT doc_id, len(c) AS n_candidates, array_to_string(c, ' ') AS candidates
FROM (SELECT doc_id, {kw_cands(strip('text'))} AS c FROM documents)""")
def keyword_candidates_q(spark, sf):
    d = table(spark, sf, "documents", spread_rows=True).withColumn("c", keyword_candidates(ustrip(F.col("text"))))
    return d.select("doc_id", F.size("c").cast("bigint").alias("n_candidates"), F.array_join("c", " ").alias("candidates"))


@query("keyword_sample", sql=f"""
SELECT doc_id, len(k) AS n_keywords, array_to_string(k, ' and ') AS keywords
FROM (SELECT doc_id, {kw_sample(kw_cands(strip('text')), 'doc_id', 'kw')} AS k FROM documents)""")
def keyword_sample(spark, sf):
    from quarry.operators.querygen import add_keywords
    d = table(spark, sf, "documents", spread_rows=True).withColumn("body", ustrip(F.col("text")))
    k = add_keywords(d, "body", "doc_id", TEST_CFG)
    return k.select("doc_id", F.size("keywords").cast("bigint").alias("n_keywords"),
                    F.array_join("keywords", " and ").alias("keywords"))


def _kind_query(kind):
    @query(f"{kind}_queries", sql=f"""
WITH {EVAL_SET_CTES}
SELECT entry_id, row_id, query, relevance FROM eval_rows WHERE kind = '{kind}'""")
    def fn(spark, sf):
        return (eval_set(spark, sf).filter(F.col("kind") == kind)
                .select("entry_id", "row_id", "query", "relevance"))
    return fn


for _k in ("genre", "theme", "keyword", "negative"):
    _kind_query(_k)


@query("eval_set", sql=f"""
WITH {EVAL_SET_CTES}
SELECT entry_id, row_id, kind, query, context, relevance FROM eval_rows""")
def eval_set_q(spark, sf):
    return eval_set(spark, sf)


ALT_SQL = f"""
WITH {TAGGED}, {parsed_cte(dedup=True)},
alt AS (
  SELECT entry_id, genres[1] AS g0, themes[1] AS t0,
         {kw_sample(kw_cands('body'), 'entry_id', 'altkw')} AS kws
  FROM parsed),
alt_rows AS (
  SELECT entry_id, 0 AS kind_pos, 'Find a ' || g0 || ' writing prompt' AS query FROM alt WHERE g0 IS NOT NULL
  UNION ALL
  SELECT entry_id, 1, 'Find a ' || g0 || ' story about ' || lower(t0) FROM alt
  WHERE g0 IS NOT NULL AND t0 IS NOT NULL
  UNION ALL
  SELECT entry_id, 2, 'Find a writing prompt about ' || lower(array_to_string(kws, ' and '))
  FROM alt WHERE len(kws) > 0)
SELECT entry_id, (row_number() OVER (PARTITION BY entry_id ORDER BY kind_pos) - 1)::INTEGER AS alt_pos, query
FROM alt_rows"""


@query("alt_queries", sql=ALT_SQL)
def alt_queries(spark, sf):
    t = add_alternative_queries(tagged(spark, sf), "text", "entry_id", TEST_CFG)
    return t.select("entry_id", F.posexplode("alt_queries").alias("alt_pos", "query"))
