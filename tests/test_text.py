"""Parsing and string semantics (S1-S12, B1-B14) on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from quarry.config import DEFAULT_CONFIG
from quarry.functions.text import (extract_body, keyword_candidates, lower_first,
                                   normalise_context, split_ws, strip_starters, ustrip)
from quarry.operators.parse import parse_entries

NBSP = " "


def _one(spark, col, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]


@pytest.mark.parametrize("value", [" \tabc  ", "\r\nabc\r\n", "　abc ", "abc", "", "\x1cabc\x1f"])
def test_ustrip_matches_python(spark, value):
    assert _one(spark, ustrip(F.col("t")), value) == value.strip()


@pytest.mark.parametrize("value", ["a  b\tc d\ne", "  lead", "one", "x y\x1cz"])
def test_split_ws_matches_python(spark, value):
    assert _one(spark, split_ws(ustrip(F.col("t"))), value) == value.split()


LINES = [
    "<Fantasy> </Fantasy> <Magic> </Magic> <The Title> </The Title> prompt A baker finds magic.",
    "<The Potluck </The Potluck> <Horror> </Horror> prompt Something eats the soup.",   # unclosed tag
    "<Courage> </Adventure> <Mystery> </Mystery> prompt Who did it?",                    # mismatched close
    "<Romance> </Romance> <Romance> </Romance> prompt twice",                            # duplicate tag
    "<Fantasy> </Fantasy> <Science Fiction> </Science Fiction> prompt two genres",
    "<Historical Fiction> </Historical Fiction> prompt theme looks like a genre",
    "no tags at all prompt body only",
    "<Only> </Only> <Tags> </Tags>",
    "first prompt second prompt third",
    "<A&B \"q\"> </A&B \"q\"> prompt quotes and ampersand",
    f"{NBSP}<Horror> </Horror> prompt   spaced out\t",
]


def _py_parse(text, dedup=False):
    import re
    tags = [t for t in re.findall(r"<([^>]+)>", text) if not t.startswith("/")]
    if dedup:
        tags = list(dict.fromkeys(tags))
    body = text.split("prompt ")[-1].strip()
    genres = [t for t in tags if t in DEFAULT_CONFIG.genres]
    themes = [t for t in tags if t not in genres and t != "prompt"]
    opposite = [g for g in DEFAULT_CONFIG.genres if g not in genres]
    return tags, body, genres, themes, opposite


def test_parse_entries_matches_python_model(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(LINES)], "entry_id long, text string")
    got = {r.entry_id: r for r in parse_entries(df).collect()}
    for i, t in enumerate(LINES):
        tags, body, genres, themes, opposite = _py_parse(t)
        r = got[i]
        assert r.tags == tags and r.body == body, t
        assert r.genres == genres and r.themes == themes and r.opposite == opposite, t


def test_unclosed_tag_glues(spark):
    df = spark.createDataFrame([(0, LINES[1])], "entry_id long, text string")
    assert parse_entries(df).first().tags[0] == "The Potluck </The Potluck"


def test_dedup_tags_keeps_first(spark):
    df = spark.createDataFrame([(0, "<B> </B> <A> </A> <B> </B> prompt x")], "entry_id long, text string")
    assert parse_entries(df, dedup_tags=True).first().tags == ["B", "A"]


def test_body_without_prompt_is_whole_line(spark):
    assert _one(spark, extract_body(F.col("t")), " <X> </X> nothing here ") == "<X> </X> nothing here"


@pytest.mark.parametrize("body", [
    "abilities, magical potion cafe naïve résumé x-ray Straße 12345 hello!",
    "short tiny words only",
    "",
])
def test_keyword_candidates_match_python(spark, body):
    expected = [w for w in body.split() if len(w) > 4 and w.isalpha()]
    assert _one(spark, keyword_candidates(F.col("t")), body) == expected


def _py_strip(q, starters):
    for s in starters:
        if q.lower().startswith(s.lower()):
            q = q[len(s):].strip()
    return q


@pytest.mark.parametrize("q", [
    "Can you show me x", "show me can you x", "generated story", "Generate", "", "  tell me about   dragons",
    "I'm looking for Find me a book", "Recommend suggest provide things", "what is what are", "plain query",
])
def test_strip_starters_sequential(spark, q):
    starters = DEFAULT_CONFIG.starters
    got = _one(spark, strip_starters(F.col("t"), starters), q)
    assert got == _py_strip(q, starters)
    first = _one(spark, lower_first(strip_starters(F.col("t"), starters)), q)
    exp = _py_strip(q, starters)
    assert first == (exp[0].lower() + exp[1:] if exp else exp)


def test_normalise_context_null(spark):
    assert _one(spark, normalise_context(F.col("t")), None) == ""


def test_keyword_candidates_are_long_words_of_letters_alone(spark):
    from quarry.functions.text import WHITESPACE, keyword_candidates
    words = ["dragon", "four", "l'été", "étéété", "a1bcdef", "\U00010400\U00010401\U00010402\U00010403\U00010404", "étages",
             "storm,", "abcde", "​hidden", "castle"]
    text = "".join(w + WHITESPACE[i % len(WHITESPACE)] * (1 + i % 3) for i, w in enumerate(words * len(WHITESPACE)))
    texts = [text, "castle", " castle", "", None, "x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.k for r in rows.select("i", keyword_candidates(F.col("t")).alias("k")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else [w for w in t.split() if len(w) >= 5 and w.isalpha()])


def test_keyword_candidates_build_no_array_of_all_words(spark):
    from quarry.functions.text import keyword_candidates
    plan = spark.range(1).select(keyword_candidates(F.col("id").cast("string")).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "rlike" not in plan.lower()
