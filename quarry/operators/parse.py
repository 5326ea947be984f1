"""Parse tagged one-line entries into tags, body, genres and themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.config import DEFAULT_CONFIG, EvalConfig
from quarry.functions.text import (drop_closing_tags, extract_body, extract_tags,
                                   genres_of, opposite_genres, themes_of)


def tags_col(text: Column, dedup: bool = False) -> Column:
    return drop_closing_tags(extract_tags(text), dedup=dedup)


def parse_entries(df: DataFrame, text_col: str = "text", cfg: EvalConfig = DEFAULT_CONFIG,
                  dedup_tags: bool = False) -> DataFrame:
    """Add ``tags``, ``body``, ``genres``, ``themes`` and ``opposite``.

    Narrow: no shuffle, runs per row inside one codegen stage (the array
    lambdas are interpreted, which is still JVM-side)."""
    text = F.col(text_col)
    out = (df.withColumn("tags", tags_col(text, dedup_tags))
             .withColumn("body", extract_body(text))
             .withColumn("genres", genres_of(F.col("tags"), cfg.genres)))
    return (out.withColumn("themes", themes_of(F.col("tags"), F.col("genres")))
               .withColumn("opposite", opposite_genres(F.col("genres"), cfg.genres)))


def to_documents(df: DataFrame, text_col: str = "text", cfg: EvalConfig = DEFAULT_CONFIG,
                 keep: tuple[str, ...] = ("entry_id",)) -> DataFrame:
    """Document shape: page_content = body, metadata = genres/themes/tags/original text."""
    p = parse_entries(df, text_col, cfg)
    return p.select(*keep, F.col("body").alias("page_content"),
                    F.struct(F.col("genres"), F.col("themes"), F.col("tags"),
                             F.col(text_col).alias("original_text")).alias("metadata"))
