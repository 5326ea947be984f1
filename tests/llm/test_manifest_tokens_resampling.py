"""Operators 11 to 13 against hashlib, the sentencepiece library and plain Python: random
inputs, nulls, empty and very long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.llm import importance, merkle, piece_bpe
from quarry.llm.catalogue import llm_queries, vocabulary_path
from quarry.llm.common import text_slices

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# -- Merkle manifest ------------------------------------------------------------------------

def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i:i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def _walk(levels, at, digest, fanout):
    """Siblings from a node up, and the root with ``digest`` in its place."""
    siblings = []
    for level in levels[:-1]:
        run = level[at // fanout * fanout:][:fanout]
        slot = at % fanout
        siblings += run[:slot] + run[slot + 1:]
        digest = _h(*run[:slot], digest, *run[slot + 1:])
        at //= fanout
    return siblings, digest


def _expected(rows, fanout):
    groups = {}
    for key, grp, leaf, changed in rows:
        groups.setdefault(grp, []).append((key is not None, key or 0, leaf, changed))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: r[:3])
        trees[g] = _levels([r[2] for r in groups[g]], fanout)
    top = _levels([trees[g][-1][0] for g in order], fanout)
    out = []
    for gi, g in enumerate(order):
        for i, (has, key, leaf, changed) in enumerate(groups[g]):
            low, mid = _walk(trees[g], i, changed or leaf, fanout)
            high, root = _walk(top, gi, mid, fanout)
            out.append((key if has else None, leaf, trees[g][-1][0], top[-1][0], tuple(low + high), root))
    return sorted(out, key=str)


def _proofs(spark, rows, fanout, block=merkle.BLOCK):
    df = spark.createDataFrame(rows, "key bigint, grp string, leaf string, changed string").repartition(3)
    return sorted(((r["key"], r["leaf"], r["subroot"], r["root"], tuple(r["siblings"]), r["folded"])
                   for r in merkle.proofs(df, fanout, block).collect()), key=str)


@pytest.mark.parametrize("fanout,block", [(2, 1024), (2, 4), (3, 9)])
def test_proofs_match_plain_trees(spark, fanout, block):
    rng = random.Random(fanout)
    rows = [(k, g, _h("leaf", str(k), str(g)), _h("new", str(k)) if k % 3 == 0 else None)
            for g, n in (("en", 43), (None, 9), ("é", 1), ("Z", 2), ("", 17)) for k in range(n)]
    rows += [(None, "en", _h("x"), None), (None, "en", _h("y"), _h("z"))] + [(5, "", _h("again"), None)]
    rng.shuffle(rows)
    assert _proofs(spark, rows, fanout, block) == _expected(rows, fanout)


def test_one_leaf_and_no_leaf(spark):
    assert _proofs(spark, [(1, "a", _h("a"), None)], 2) == [(1, _h("a"), _h("a"), _h("a"), (), _h("a"))]
    assert _proofs(spark, [], 2) == []


def test_repeated_rows_are_leaves_of_their_own(spark):
    rows = [(7, "a", _h("same"), None)] * 5
    got = _proofs(spark, rows, 2)
    assert len(got) == 5 and {r[2] for r in got} == {_levels([_h("same")] * 5, 2)[-1][0]}
    assert all(r[5] == r[3] for r in got)


def test_leaf_text(spark):
    df = spark.createDataFrame([(1, None, "é", "")], "a bigint, b string, c string, d string")
    got = df.select(merkle.leaf_hash(*[F.col(c) for c in "abcd"]).alias("h")).first()["h"]
    assert got == _h("1:1", "-", "2:é", "0:")


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_op11_finds_every_tampered_row(spark):
    got = llm_queries()["op11_merkle_manifest"](spark, SF).collect()
    docs = {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        harmed = zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and docs[r["doc_id"]]["n_chars"] is not None
        assert r["verified"] == (not harmed) and r["verified"] == (r["folded_root"] == r["root"])


# -- SentencePiece --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path())


@pytest.fixture(scope="module")
def vocabulary():
    return piece_bpe.read_vocabulary(vocabulary_path())


def _same_as_library(library, v, texts):
    for _, part in text_slices(pa.array(texts, pa.string()), piece_bpe.BATCH_BYTES):
        ids, first = piece_bpe.encode_texts(v, part)
        back = piece_bpe.decode_ids(v, ids, first)
        for i, t in enumerate(part.to_pylist()):
            want = library.encode(t, add_bos=True, add_eos=True)
            assert ids[first[i]:first[i + 1]].tolist() == want, t[:100]
            assert back[i] == library.decode(want)


def test_awkward_texts_as_the_library(library, vocabulary):
    texts = ["", None, " ", "  a b", "a\n\tb\r\n", "▁x ▁ y", "▁", "é日本\x00z", "😀😀 𝔘", "</s> <s> <0x41>", "ﬁ① é", "=" * 1000,
             "a" * 3000, "ab" * 500, "x" + " " * 40 + "y", "thequickbrownfox" * 300]
    texts += [" " * m + x for m in range(70) for x in ("", "a", " b", "\n", "é", "the")]
    _same_as_library(library, vocabulary, texts)


def test_random_texts_as_the_library(library, vocabulary):
    rng = random.Random(1)
    parts = [" ", "  ", "a", "e", "th", "the", "ing", "é", "日", "\n", "==", "23", "▁", "😀", "Я", "про", "st", "er"]
    pieces = [library.id_to_piece(i) for i in range(259, library.vocab_size())]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))) * rng.randint(1, 3) for _ in range(6000)]
    _same_as_library(library, vocabulary, texts)


def test_slices_change_nothing(library, vocabulary, monkeypatch):
    monkeypatch.setattr(piece_bpe, "BATCH_BYTES", 50)
    rng = random.Random(2)
    _same_as_library(library, vocabulary, [None] + ["é the " * rng.randint(0, 30) for _ in range(60)])


def test_decoding_of_any_ids(library, vocabulary):
    rng = random.Random(4)
    lists = [[rng.randrange(library.vocab_size()) if rng.random() < 0.6 else rng.randrange(3, 259)
              for _ in range(rng.randint(0, 9))] for _ in range(5000)]
    flat = np.array([i for x in lists for i in x], dtype=np.int32)
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    assert piece_bpe.decode_ids(vocabulary, flat, first) == [library.decode(x) for x in lists]


def test_encode_and_decode_tables(spark, library):
    long = "once upon a time " * 30_000
    rows = [(1, "Hello  world", 1, "x"), (1, "Hello  world", 1, "x"), (None, "é", 2, "y"), (3, None, 3, None), (4, long, 4, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, packed bigint, decoded string").repartition(2)
    back = piece_bpe.decode(piece_bpe.encode(df, vocabulary_path()), vocabulary_path())
    got = back.select("doc_id", piece_bpe.unpack(F.col("packed")).alias("ids"), "decoded").collect()
    assert all(r["n_tokens"] * 4 == len(r["packed"]) for r in back.collect())
    want = [(d, library.encode(t or "", add_bos=True, add_eos=True), t or "") for d, t, _, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert piece_bpe.encode(df.limit(0), vocabulary_path()).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_op12_matches_the_library(spark, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in llm_queries()["op12_sentencepiece"](spark, SF).collect()}
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert got[r["doc_id"]] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                                    hashlib.sha256(library.decode(ids).encode()).hexdigest())


# -- importance resampling -------------------------------------------------------------------

def _features(text, max_n):
    words = TOKEN.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i:i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def _resampled(docs, target, percent, min_words, max_n, buckets, seed):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in _features(text, max_n)[1]:
                counts[at(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets))))
            for b in range(buckets)]
    rows = []
    for d, text in docs:
        words, feats = _features(text, max_n)
        weight = sum(gain[at(f)] for f in feats) // len(feats) if feats else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((d, len(feats), weight, score, len(words)))
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    drawn = len(able) * percent // 100
    out = [r[:4] + (i + 1 if i < drawn else None,) for i, r in enumerate(able)]
    return sorted(out + [r[:4] + (None,) for r in rows if r[4] < min_words], key=str)


def test_features_of_small_slices():
    texts = ["One two, three", None, "", "é 日本\x00z 4", "one TWO three one"] * 7
    col = pa.array(texts, pa.string())
    for most in (1, 20, 1 << 20):
        got = [[] for _ in texts]
        for row, part in text_slices(col, most):
            doc, bucket, n_words = importance.gram_buckets(part, 3, 1000)
            for d, b in zip(doc.tolist(), bucket.tolist(), strict=True):
                got[row + d].append(b)
            assert n_words.tolist() == [len(_features(t, 1)[0]) for t in texts[row:row + len(part)]]
        assert [sorted(g) for g in got] == [sorted(zlib.crc32(f.encode()) % 1000 for f in _features(t, 3)[1]) for t in texts]


@pytest.mark.parametrize("max_n", [1, 3])
def test_resampling_matches_brute_force(spark, max_n):
    rng = random.Random(9)
    vocab = ["a", "B", "c3", "é", "日本", "x-y", "the", "Q"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    docs += [(None, "a b c d e f"), (3, None), (4, ""), (5, "!!! ,,"), (7, docs[7][1]), (7, docs[7][1]), (900, "A\x00b\x7fc " * 5000)]
    target = [" ".join(rng.choice(vocab[:20]) for _ in range(30)) for _ in range(4)] + [None]
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id bigint, text string, rank int, score string").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    args = {"percent": 30, "min_words": 5, "max_n": max_n, "buckets": 97, "seed": 3}
    got = importance.resample(df, goal, **args).collect()
    assert sorted((tuple(r) for r in got), key=str) == _resampled(docs, target, **args)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    assert importance.resample(none, one).count() == 0
    assert importance.resample(one, none, min_words=1).first()["n_features"] == 3
