"""Template query generation.

Per entry an array of up to four candidate queries is built with
expressions and flattened with ``inline``; there is no shuffle, so the step
is a single narrow stage that scales with the number of entries.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import DEFAULT_CONFIG, EvalConfig
from quarry.functions.text import keyword_candidates, sample_keywords
from quarry.operators.parse import parse_entries

KINDS = ("genre", "theme", "keyword", "negative")
QUERY_STRUCT = "struct<kind_pos:int,kind:string,query:string,relevance:double>"


def render(template: str, **values: Column) -> Column:
    """Fill ``{name}`` placeholders of a fixed template with Columns."""
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(values[field])
    return F.concat(*parts)


def _cand(pos: int, query: Column, relevance: float) -> Column:
    return F.struct(F.lit(pos).alias("kind_pos"), F.lit(KINDS[pos]).alias("kind"),
                    query.alias("query"), F.lit(relevance).alias("relevance"))


def add_keywords(df: DataFrame, body_col: str, key_col: str, cfg: EvalConfig = DEFAULT_CONFIG,
                 tag: str = "kw", out: str = "keywords") -> DataFrame:
    """Candidates and the seeded sample as separate columns, so the (costly)
    candidate array is computed once per row."""
    return (df.withColumn("_kwc", keyword_candidates(F.col(body_col), cfg.keyword_min_len))
              .withColumn(out, sample_keywords(F.col("_kwc"), F.col(key_col), cfg.seed, tag,
                                               cfg.max_keywords))
              .drop("_kwc"))


def query_candidates(genres: Column, themes: Column, opposite: Column | None, kws: Column,
                     cfg: EvalConfig = DEFAULT_CONFIG, alt: bool = False) -> Column:
    """Array of up to four query structs; all inputs should be plain columns."""
    g0 = F.get(genres, 0)
    t0 = F.get(themes, 0)
    theme_tpl = cfg.theme_template_alt if alt else cfg.theme_template
    cands = [
        F.when(g0.isNotNull(), _cand(0, render(cfg.genre_template, genre=g0), 1.0)),
        F.when(g0.isNotNull() & t0.isNotNull(),
               _cand(1, render(theme_tpl, genre=g0, theme=F.lower(t0)), 1.0)),
        F.when(F.size(kws) > 0,
               _cand(2, render(cfg.keyword_template,
                               keywords=F.lower(F.array_join(kws, " and "))), 1.0)),
    ]
    if opposite is not None:
        og = F.get(opposite, 0)
        cands.append(F.when(og.isNotNull(), _cand(3, render(cfg.negative_template, genre=og), 0.0)))
    return F.filter(F.array(*cands), lambda c: c.isNotNull())


def generate_queries(entries: DataFrame, cfg: EvalConfig = DEFAULT_CONFIG,
                     text_col: str = "text", id_col: str = "entry_id",
                     context: str = "line") -> DataFrame:
    """Eval rows ``entry_id, row_id, kind, query, context, relevance``.

    ``context='line'`` keeps the whole tagged line (template path),
    ``'body'`` the text after 'prompt '. ``row_id = entry_id*4 + kind_pos``
    preserves the generation order (entries, then kinds). ``inline_outer``
    plus a null filter keeps Catalyst from inferring a size filter that would
    be pushed below (and re-evaluate) the parsing projections."""
    p = add_keywords(parse_entries(entries, text_col, cfg), "body", id_col, cfg)
    cands = query_candidates(F.col("genres"), F.col("themes"), F.col("opposite"),
                             F.col("keywords"), cfg)
    ctx = F.col(text_col) if context == "line" else F.col("body")
    return (p.withColumn("_cands", cands)
             .select(F.col(id_col).alias("entry_id"), ctx.alias("context"),
                     F.inline_outer("_cands"))
             .filter(F.col("kind_pos").isNotNull())
             .select("entry_id",
                     (F.col("entry_id") * 4 + F.col("kind_pos")).alias("row_id"),
                     "kind", "query", "context", "relevance"))


def add_alternative_queries(df: DataFrame, text_col: str, key_col: str,
                            cfg: EvalConfig = DEFAULT_CONFIG, out: str = "alt_queries") -> DataFrame:
    """Genre, genre+theme ("story") and keyword queries of each entry text,
    parsed with de-duplicated tags, as an array<string> column ``out``."""
    from quarry.functions.text import extract_body, genres_of, themes_of
    from quarry.operators.parse import tags_col
    d = (df.withColumn("_atags", tags_col(F.col(text_col), dedup=True))
           .withColumn("_abody", extract_body(F.col(text_col)))
           .withColumn("_agenres", genres_of(F.col("_atags"), cfg.genres)))
    d = d.withColumn("_athemes", themes_of(F.col("_atags"), F.col("_agenres")))
    d = add_keywords(d, "_abody", key_col, cfg, tag="altkw", out="_akw")
    cands = query_candidates(F.col("_agenres"), F.col("_athemes"), None, F.col("_akw"), cfg, alt=True)
    return (d.withColumn(out, F.transform(cands, lambda c: c["query"]))
             .drop("_atags", "_abody", "_agenres", "_athemes", "_akw"))
