"""An invented corpus of the documented shape gives the derived counts: 216 entries -> 532 eval rows -> 932 tuples."""

from collections import Counter

import pytest

from quarry.config import DEFAULT_CONFIG, GENRES
from quarry.operators.training import mini_batches, training_keys, training_refs
from quarry.plans.pipelines import build_eval_set
from quarry.sources.corpus import corpus_entries

PER_GENRE = {"Fantasy": 8, "Science Fiction": 11, "Mystery": 11, "Horror": 10, "Romance": 10}


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """Two files of 108 entries; whitelisted genres in the first one only."""
    folder = tmp_path_factory.mktemp("corpus")
    tag = lambda *names: " ".join(f"<{n}> </{n}>" for n in names)
    genres = [g for g, n in PER_GENRE.items() for _ in range(n)]
    genres += ["Historical Fiction"] * (216 - len(genres))
    lines = [f"{tag(g, f'Theme {i}', f'Title {i}')} prompt Somebody finds number {i} behind the garden wall, and keeps quiet."
             for i, g in enumerate(genres)]
    paths = []
    for k in range(2):
        path = folder / f"part{k}.txt"
        path.write_text("\n\n".join(lines[k * 108:(k + 1) * 108]) + "\n", encoding="utf-8")
        paths.append(str(path))
    return build_eval_set(corpus_entries(spark, paths)).checkpoint()


def test_entries_and_eval_rows(rows):
    got = rows.collect()
    assert len({r.entry_id for r in got}) == 216 and len({r.row_id for r in got}) == len(got) == 532
    assert Counter(r.kind for r in got) == {"genre": 50, "theme": 50, "keyword": 216, "negative": 216}
    assert Counter(r.relevance for r in got) == {1.0: 316, 0.0: 216}
    assert Counter(r["query"] for r in got if r.relevance == 0) == {
        "Find a Fantasy writing prompt": 208, "Find a Science Fiction writing prompt": 8}
    genre = Counter(r["query"] for r in got if r.kind == "genre")
    assert genre == {f"Find a {g} writing prompt": PER_GENRE[g] for g in GENRES}


def test_training_tuples_and_batches(rows):
    keys = training_keys(rows, DEFAULT_CONFIG).checkpoint()
    assert keys.count() == 932 and keys.filter("aug_pos > 0").count() == 616
    tuples, texts = training_refs(rows, 3, DEFAULT_CONFIG)
    assert tuples.count() == 932 and texts.count() == 216
    batches = mini_batches(keys, ["row_id", "aug_pos"], 16).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in batches) == [4] + [16] * 58
