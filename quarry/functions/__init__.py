"""Column-level building blocks. Every function maps Columns to a Column and
stays inside Spark's built-in expressions unless noted."""

from quarry.functions.rand import hash_int, hash_uniform, hash_order  # noqa: F401
from quarry.functions.text import (  # noqa: F401
    WHITESPACE, WS_CLASS, ustrip, split_ws, extract_tags, drop_closing_tags,
    extract_body, genres_of, themes_of, opposite_genres, keyword_candidates,
    sample_keywords, strip_starters, lower_first, normalise_context, lit_array,
    split_lines,
)
