"""Planted toxic, copied and contaminated documents followed through every stage of the pipeline."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = np.random.default_rng(31)
    vocab, foul = [f"word{i}" for i in range(600)], [f"foul{i}" for i in range(12)]
    say = lambda n, words=vocab: " ".join(rng.choice(words, n))
    docs, toxic, groups, leaked = {}, set(), [], set()
    items = [(i, say(25)) for i in range(6)]
    for d in range(400):
        docs[d] = say(int(rng.integers(30, 90)))
    for d in range(400, 460):                       # a third of the words of a toxic text are foul
        toxic.add(d)
        docs[d] = " ".join(rng.permutation([*say(30).split(), *say(15, foul).split()]))
    at = 460
    for _ in range(8):                              # groups of exact and near copies
        base = say(100).split()
        group = []
        for k in range(4):
            text = list(base)
            if k:
                text[int(rng.integers(0, 100))] = f"changed{at}"
            docs[at] = " ".join(text if k % 2 else base)
            group.append(at)
            at += 1
        groups.append(group)
    for _, item in items:                           # whole items and most of one inside longer texts
        for cut in (25, 22):
            docs[at] = f"{say(20)} {' '.join(item.split()[:cut])} {say(20)}"
            leaked.add(at)
            at += 1
    docs[at], docs[at + 1], docs[at + 2] = None, "", "short"
    rows = [(d, t, ["en", "de", None][d % 3], f"s{d % 4}", None if t is None else len(t)) for d, t in docs.items()]
    labels = [(d, int(d % 2), int(d in toxic)) for d in range(460) if d % 3]
    folder = str(tmp_path_factory.mktemp("planted"))
    for name, data, schema in (("documents", rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"),
                               ("labels", labels, "doc_id bigint, quality int, toxic int"),
                               ("benchmark", items, "item_id bigint, text string")):
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return folder, docs, toxic, groups, leaked


def _shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _linked(texts):
    """Least id of each document's component by whole sets."""
    sets, root = {d: _shingles(t) for d, t in texts.items()}, {d: d for d in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    return root


def test_planted_rows_leave_at_their_stage_and_clean_ones_stay(spark, planted):
    folder, docs, toxic, groups, leaked = planted
    at = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, folder).checkpoint()
        assert at.columns == COLS
        kept[name] = Counter(r["doc_id"] for r in at.select("doc_id").collect())
    clean = set(docs) - toxic
    first = set(kept["toxicity"])
    assert not first & toxic and len(clean - first) <= 0.02 * len(clean)
    root = _linked({d: docs[d] for d in first})
    second = set(kept["ngram_jaccard_join"])
    assert second == {d for d in first if root[d] == d}
    assert all(len(second & set(g)) == 1 for g in groups if set(g) <= first)
    items = [_shingles(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    third = set(kept["benchmark_decontamination"])
    assert third == {d for d in second if not any(i and 100 * len(i & _shingles(docs[d])) >= 75 * len(i) for i in items)}
    assert not third & leaked
    assert set(kept["mixing"]) <= third and max(kept["mixing"].values()) <= 2


def test_run_gives_every_mixed_row_a_slot(spark, planted):
    folder, docs, toxic, groups, leaked = planted
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in rows}
    assert ids <= set(docs) - toxic - leaked and all(len(ids & set(g)) <= 1 for g in groups)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    weight = {s: sum(r["size"] for r in rows if r["shard"] == s) for s in slots}
    assert len(weight) == 8 and max(weight.values()) <= 1.1 * min(weight.values())


def test_a_missing_item_id_is_not_minus_one(spark):
    from quarry.llm import decontaminate
    one, two = (" ".join(f"{c}{i}" for i in range(20)) for c in "xy")
    items = spark.createDataFrame([(None, one), (-1, two)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, one), (2, f"a b {two} c"), (3, f"{one} {two}")], "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contained_items(docs, items).collect()}
    assert got == {(1, None), (2, -1), (3, None), (3, -1)}
