"""The registered queries without SQL against brute force over the whole sf0.001 tables."""

import hashlib
import os
import re
import zlib

import pyarrow.parquet as pq
import pytest

from quarry.llm import pii
from quarry.llm.catalogue import llm_queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def texts():
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def _rows(spark, name):
    return {r["doc_id"]: r for r in llm_queries()[name](spark, SF).collect()}


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _base_spans(text):
    out = {}
    for kind, pattern in KINDS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (
                    kind == "card" and not (16 <= len(digits) <= 19 and _luhn(digits))) or (
                    kind == "phone" and not 8 <= len(digits) <= 15):
                continue
            out[kind].append(m.span())
    return out


def _listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def test_op1_puts_all_rows_into_even_shards(spark, texts):
    got = _rows(spark, "op1_kd_sharding")
    assert set(got) == set(texts)
    raw = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    slots, weight, home = {}, {}, {}
    for d, r in got.items():
        size = len((raw[d] or "").encode()) + 1
        assert (r["size"], r["text_crc32"]) == (size, zlib.crc32((raw[d] or "").encode()))
        assert r["law"] == "bytes" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
        weight[r["shard"]] = weight.get(r["shard"], 0) + size
        home.setdefault(raw[d], set()).add(r["shard"])
    assert sorted(slots) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in home.values())
    mean = sum(weight.values()) / 8
    assert max(abs(w - mean) for w in weight.values()) < 0.1 * mean


def test_op3_links_by_whole_sets(spark, texts):
    got = _rows(spark, "op3_ngram_join")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, at = {}, {}
    for d, t in texts.items():
        w = WORD.findall(t.translate(low))
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for s in sets[d]:
            at.setdefault(s, []).append(d)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in {b for s in sets[a] for b in at[s] if b > a}:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == {
        d: (len(sets[d]), find(d)) for d in sets}


def test_op4_edits_and_fingerprints(spark, texts):
    got = _rows(spark, "op4_simhash")
    order = sorted(texts, reverse=True)
    same = {}
    for i, d in enumerate(order):
        text, after = texts[d], texts[order[(i + 1) % len(order)]]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        same.setdefault(text, set()).add(r["fingerprint"])
        same.setdefault(edited, set()).add(r["edited_fingerprint"])
        nxt = got[order[(i + 1) % len(order)]]["fingerprint"]
        apart = bin(int(r["fingerprint"], 16) ^ int(nxt, 16)).count("1")
        assert abs(r["near_next"] - (1 - apart / 128)) < 1e-9
    assert all(len(f) == 1 for f in same.values())


def test_op9_base_spans(spark, texts):
    got = _rows(spark, "op9_pii")
    assert set(got) == set(texts)
    for d, text in texts.items():
        spans = _base_spans(text)
        assert tuple(got[d][f"n_{k}"] for k in KINDS) == tuple(len(spans[k]) for k in KINDS)
        assert got[d]["base_sha256"] == hashlib.sha256(_listed(spans).encode()).hexdigest()
        assert {x for x in _listed(spans).split(",") if x} <= set(got[d]["spans"].split(","))


def test_base_spans_of_awkward_texts(spark):
    cases = ["a@b@c.com x@y.com_foo@bar.com", "1.2.3.4.5.6.7.8 999.1.1.1.1.1", "+1 (555) 555-0123+44 20 7946 0958 +1 2",
             "4111 1111 1111 1111-4111", "4111-1111-1111-1111  5500 0000 0000 0004", "é 日本 a.b@c.d 10.0.0.1", "", None,
             "x@" + "ab." * 50_000 + "c", "a" * 100_000 + "@b", "1 " * 50_000, "+" * 1000 + "12 34 56 78 9"]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in pii.detect(df, models={}).collect()}
    for i, text in enumerate(cases):
        assert {k: [(s["start"], s["stop"]) for s in got[i][k]] for k in KINDS} == _base_spans(text or ""), i
