"""128-bit keys of texts.

Rows carry the key of a text instead of the text; joins, distinct counts and
id look-ups move keys, and each distinct text is written once. Keys are cut from SHA-256,
so no two texts can be made to share one; by chance 10 billion texts do with a
probability below 10^-18, and no job is spent on checking it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import stage_counted


def text_key(text: Column) -> Column:
    """The first 32 hex digits of the text's SHA-256; a missing text has a key of its own
    (the empty string)."""
    return F.coalesce(F.substring(F.sha2(text, 256), 1, 32), F.lit(""))


def distinct_texts(rows: DataFrame, text: Column, *aggs: Column, with_total: bool = False):
    """Written table of the distinct texts: ``text_key, text`` and ``aggs``; with
    ``with_total`` also their number, counted by the write itself.

    Texts are combined map-side, so a text that fills a third of the rows moves
    once per map task."""
    others = [c for c in rows.columns if c not in ("text_key", "text")]
    texts = rows.select(text_key(text).alias("text_key"), text.alias("text"), *others).groupBy("text_key", "text")
    out, total = stage_counted(texts.agg(*aggs) if aggs else texts.agg(F.lit(0).alias("_")).drop("_"), "texts")
    return (out, total) if with_total else out
