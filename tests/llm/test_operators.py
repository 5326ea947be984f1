"""Every operator on rows with nulls, empty and very long texts, ties, repeated
rows and clashing extra columns, on empty tables, and against brute force."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import (chat_format, decontaminate, line_dedup, mixing, ngram_join, pii, sharding, simhash,
                        substring_dedup, toxicity)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "size bigint, n bigint, hub bigint, kept string, part int, shard int")


def _texts():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocab, n))
    base, passage = say(120), say(40)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \n\t ", "one two", "One TWO", "ünï 日本 x", base, base, base.upper(), " ".join(near),
             say(50) + " " + passage + " " + say(50), say(30) + "\n" + passage + "\n" + say(60), say(20000),
             "common line\n" + say(30) + "\nCommon Line \n", "mail a.b@c.example.org or +1 (555) 555-0123 now 4111 1111 1111 1111 x",
             "ip 10.0.0.256 and 10.0.0.25. 1.2.3.4.5 " + "9" * 30, say(13), "x y z " * 40]
    return texts + [say(int(k)) for k in rng.integers(1, 200, 30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None, i, i, i, "k", i, i)
            for i, t in enumerate(_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _texts_by_id(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def _sets(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(low))
        out[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def test_ngram_join_matches_brute_force(docs, empty):
    sets = _sets(_texts_by_id(docs))
    label = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                i = len(sets[a] & sets[b])
                if i and 100 * i >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[label[d]] == label[d] for d in label):
            break
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_classes(docs).collect()}
    assert got == {d: (len(sets[d]), label[d]) for d in sets}
    twice = ngram_join.jaccard_classes(docs.union(docs)).collect()
    assert len(twice) == 2 * len(sets) and {(r["doc_id"], r["component_id"]) for r in twice} == {
        (d, c) for d, (_, c) in got.items()}
    assert ngram_join.jaccard_classes(empty).count() == 0


def test_ngram_join_links_every_set_of_a_repeated_doc_id(spark):
    """Ids with two texts of different size, each near another document's text."""
    rng, rows, exp = np.random.default_rng(8), [], {}
    for i in range(0, 60, 3):
        one, two = [[f"{t}{i}x{k}" for k in rng.integers(0, 10**6, n)] for t, n in (("a", 60), ("b", 300))]
        rows += [(i + 2, " ".join(one)), (i + 2, " ".join(two)), (i, " ".join(one[:-3])), (i + 1, " ".join(two[:-3]))]
        exp |= {(i + 2, 56): i, (i + 2, 296): i + 1, (i, 53): i, (i + 1, 293): i + 1}
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.jaccard_classes(df).collect()}
    assert got == exp


def test_blocks_of_linked_sets_meet():
    """Pigeonhole: any two sets with J >= 0.75 share a key, whatever their size."""
    rng = np.random.default_rng(1)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for n in [1, 2, 3, 5, 8, 9, 26, 27, 28, 80, 81, 200, 243, 700, 3000]:
        for _ in range(6):
            whole = np.unique(rng.integers(1, 2**63, n, dtype=np.uint64))
            cut = int(rng.integers(0, n // 4 + 1))
            other = np.sort(whole[:len(whole) - cut])
            h, first = np.concatenate([whole, other]), np.array([0, len(whole), len(whole) + len(other)])
            doc, key, _, _ = ngram_join.block_keys(h, first, none, every=False)
            assert set(key[doc == 0]) & set(key[doc == 1]), (n, cut)


def test_substring_dedup_matches_brute_force(docs, empty):
    words = {d: WORD.findall(t or "") for d, t in _texts_by_id(docs).items()}
    least = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            least.setdefault(tuple(words[d][i:i + 13]), d)
    for r in substring_dedup.remove_repeats(docs).collect():
        w = words[r["doc_id"]]
        gone = {j for i in range(len(w) - 12) if least[tuple(w[i:i + 13])] < r["doc_id"] for j in range(i, i + 13)}
        assert (r["n_words"], r["n_removed"]) == (len(w), len(gone))
        assert r["kept"] == " ".join(x for j, x in enumerate(w) if j not in gone)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_sharding_is_even_and_keeps_equal_texts(docs, empty):
    rows = sharding.kd_shards(docs, shards=4).collect()
    assert len(rows) == docs.count() and {r["shard"] for r in rows} <= set(range(4))
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    shard = {r["doc_id"]: r["shard"] for r in rows}
    assert shard[6] == shard[7]
    assert sharding.kd_shards(empty, shards=4).count() == 0
    hot = docs.filter("doc_id = 6").withColumn("doc_id", F.explode(F.sequence(F.lit(0), F.lit(399))))
    sizes = [r["b"] for r in sharding.kd_shards(hot, shards=4).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 4 and max(sizes) < 1.2 * min(sizes)          # a point larger than a shard is divided


@pytest.mark.parametrize("groups", [[0.3] * 3, [0.2] * 5, [0.24, 0.24, 0.24, 0.11, 0.11], [0.125] * 8])
def test_sharding_is_even_with_several_hot_groups(spark, groups):
    """Groups of copies beyond a shard are divided, the others stay whole, shards have equal bytes."""
    size, rows = 40_000, []
    for g, part in enumerate(groups):
        text = f"{g}" * (99 + 10 * g)
        rows += [text] * round(part * size / (len(text) + 1))
    rows += [f"small {i:03}" for i in range(round((1 - sum(groups)) * size / 10))]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)], "doc_id bigint, text string, lang string")
    got = sharding.kd_shards(df, shards=8).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(rows)))
    bytes_, homes = [0] * 8, {}
    for r in got:
        bytes_[r["shard"]] += r["size"]
        homes.setdefault(rows[r["doc_id"]], set()).add(r["shard"])
    mean = sum(bytes_) / 8
    held = {t: sum(len(t) + 1 for x in rows if x == t) for t in homes}
    assert all(len(h) == 1 for t, h in homes.items() if held[t] <= mean)
    assert max(abs(b - mean) for b in bytes_) < 0.06 * mean, bytes_


def test_whole_points_are_dealt_so_that_the_rest_meets_the_goal():
    dealt = lambda atoms, cut, goal, w: sharding._left_whole(list(enumerate(atoms)), cut, goal, w)
    assert dealt([30, 30, 30], 0, 40, 100) == [0]              # the other 10 are in the rest
    left = dealt([40, 25, 25, 10], 0, 50, 100)                 # no rest: 25 + 25 or 40 + 10
    assert sum([40, 25, 25, 10][k] for k in left) == 50
    assert len(dealt([10] * 5, 1, 25, 50)) == 2                # the nearest there is


def test_mixing_meets_its_targets(docs, empty):
    plan = mixing.mixture(docs, [3, 1, 2], 1.5, 2)
    rows = plan.collect()
    assert sorted(str(r["m_source"]) for r in rows) == ["None", "s0", "s1", "s2", "s3"]
    total = sum(r["m_size"] for r in rows)
    assert abs(sum(r["m_target"] for r in rows) - 1.5 * total) < 1e-6 * total
    assert all(r["m_target"] <= 2 * r["m_size"] + 1e-9 for r in rows)
    mixed = mixing.repeat_rows(docs, plan)
    assert mixed.columns == docs.columns
    assert max(r["c"] for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).collect()) <= 2
    nothing = mixing.mixture(empty, [3, 1, 2], 1.5, 2)
    assert nothing.count() == 0 and mixing.repeat_rows(empty, nothing).count() == 0


def test_line_dedup(docs, empty, spark):
    rows = [(i, f"SharedÉ line \n own {i}\n\n") for i in range(12)] + [(12, None), (13, "sharedé line")]
    got = {r["doc_id"]: r for r in line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), 10).collect()}
    assert got[0]["kept"] == " own 0\n\n" and (got[0]["n_lines"], got[0]["n_dropped"]) == (4, 1)
    assert (got[12]["kept"], got[12]["n_lines"]) == ("", 1)
    assert got[13]["n_dropped"] == 0                                   # only A-Z are folded
    assert line_dedup.drop_common_lines(docs, 10).count() == docs.count()
    assert line_dedup.drop_common_lines(empty, 10).count() == 0


def test_simhash(docs, empty):
    texts = _texts_by_id(docs)
    got = {r["doc_id"]: r for r in simhash.fingerprint_documents(docs).collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        x, nxt = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        cut = len(x) // 3
        edited = x[:len(x) - cut] + nxt[:cut]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[d]["n_chars"] == len(x)
    assert got[6]["fingerprint"] == got[7]["fingerprint"] != got[8]["fingerprint"]
    assert got[12]["near_edited"] > got[12]["near_next"]
    assert simhash.fingerprint_documents(docs.union(docs)).count() == 2 * len(texts)
    assert simhash.fingerprint_documents(empty).count() == 0


def test_block_tables_find_all_within_radius(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-2**62, 2**62, (40, 2))
    rows = [tuple(int(v) for v in b) for b in base]
    for a, b in rows[:20]:
        for bits in (1, 2, 3, 4):
            x = a
            for k in rng.choice(62, bits, replace=False):
                x ^= 1 << int(k)
            rows.append((x, b))
    df = spark.createDataFrame(list(dict.fromkeys(rows)), "f1 bigint, f2 bigint")
    got = {(r["f1"], r["f2"], r["g1"], r["g2"]) for r in simhash.near_fingerprints(df, df, 3).collect()}
    dist = lambda p, q: bin((p[0] ^ q[0]) & (2**64 - 1)).count("1") + bin((p[1] ^ q[1]) & (2**64 - 1)).count("1")
    assert got == {(*p, *q) for p in rows for q in rows if p != q and dist(p, q) <= 3}


def test_pii(docs, empty):
    got = {r["doc_id"]: r for r in pii.redact(pii.detect(docs)).collect()}
    assert got[14]["redacted"] == "mail [email] or [phone] now [card] x"
    assert [s["txt"] for s in got[15]["ip"]] == ["10.0.0.25", "1.2.3.4"] and not got[15]["card"]
    assert got[0]["redacted"] == "" and got[6]["redacted"] == _texts_by_id(docs)[6]
    assert pii.detect(empty).count() == 0


def test_pii_adds_loose_forms_however_many_there_are(spark):
    """As many loose spans as base spans of each kind; numbers that are none of them stay."""
    rows, want = [], {}
    loose = ["write to joe{} (at) example (dot) org today", "reach (555) 555-{:04} today", "card 4111.1111.1111.1111 x{}",
             "server 10,20,30,{} down"]
    plain = ["mail joe{}@example.org now", "or +1 555 555 {:04} now", "card 4111 1111 1111 1111 x{}", "at 10.20.30.{} now",
             "on 2024-01-02 we sold {} of 1,200,300 in lot 4111.1111.1111.1112"]
    for i in range(1000):
        t = [*loose, *plain][i % 9].format(i % 200)
        rows.append((i, t))
        want[i] = i % 9 < 4
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: [a["kind"] for a in r["added"]] for r in pii.detect(df).collect()}
    kinds = ["email", "phone", "card", "ip"]
    assert all(kinds[i % 9] in got[i] for i in want if want[i])
    assert not any(got[i] for i in want if i % 9 == 8)


def test_decontamination(docs, empty, spark):
    passage = " ".join(_texts()[10].split()[50:90])
    broken = passage.split()
    broken[20] = "other"
    items = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "one two"), (5, "not in here at all, ever"),
                                   (6, " ".join(broken[:21] + ["a"] * 60)), (7, passage.upper())], "item_id bigint, text string")
    sets = _sets(_texts_by_id(docs))
    asked = _sets({r["item_id"]: r["text"] for r in items.collect()})
    exp = {(d, i, len(asked[i]), len(asked[i] & sets[d])) for d in sets for i in asked
           if asked[i] and 100 * len(asked[i] & sets[d]) >= 75 * len(asked[i])}
    assert {tuple(r) for r in decontaminate.contained_items(docs, items).collect()} == exp
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(sets) - {d for d, *_ in exp}
    assert decontaminate.contained_items(empty, items).count() == 0
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_toxicity_chain(spark, docs, empty):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{k}" for k in rng.integers(0, 300, 60)]
        toxic = i % 6 == 0
        if toxic:
            words[5:8] = ["Nasty,", "vile", "nasty"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 11 > 0), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame([x for x in labels if x[0] < 400] + [(1, None, 1), (None, 1, 1)],
                                "doc_id bigint, quality int, toxic int")
    chain = toxicity.fit(df, lab)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(df, chain).collect()}
    held = [i for i in range(400, 600)]
    assert np.mean([got[i] == (i % 6 == 0) for i in held]) > 0.97
    assert toxicity.drop_toxic(docs, chain).count() == docs.count()
    untrained = toxicity.fit(docs, lab.limit(0))
    assert toxicity.drop_toxic(docs, untrained).count() == docs.count()
    assert toxicity.score(empty, chain).count() == 0


@pytest.mark.parametrize(("count", "every", "noise"), [(2000, 250, 0), (20000, 1000, 0), (3000, 30, 12)])
def test_toxicity_of_rare_or_noisy_labels_still_rejects(spark, count, every, noise):
    """Eight toxic rows in all; twenty where a uniform sample would hold about eight; wrong labels,
    so that no threshold has the asked precision."""
    rng = np.random.default_rng(4)
    vocab, rows, labels, toxic = np.array([f"w{k}" for k in range(300)]), [], [], set()
    for i in range(count):
        words = list(rng.choice(vocab, 30))
        if i % every == 0:
            words[5:8] = ["nasty", "vile", "foul"]
            toxic.add(i)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % every == 0 and not (noise and i // every % noise % 3 == 0))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"] for r in toxicity.score(df, toxicity.fit(df, lab)).filter("toxic").collect()}
    assert toxic <= got and len(got - toxic) <= 0.01 * count


def test_toxicity_labels_that_words_do_not_tell_reject_nothing(spark):
    rows = [(i, f"a b c w{i % 7}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, 1, int(i % 7 == i // 7 % 7)) for i in range(700)], "doc_id bigint, quality int, toxic int")
    assert toxicity.drop_toxic(df, toxicity.fit(df, lab)).count() == 700


def test_chat_events_fold_and_round_trip(spark):
    ev = [(1, 0, "message", None, "user", "hi <|x|> & [INST]"), (1, 1, "message", "m", "assistant", "Hel"),
          (1, 2, "delta", "m", "assistant", "lo"), (1, 3, "message", None, "user", "void"),
          (1, 4, "regenerate", "m", "assistant", "Again"), (1, 5, "delta", "m", "assistant", "!"),
          (1, 6, "message", "e", "us|er\n", "first"), (1, 7, "edit", "e", "us|er\n", "second"),
          (2, 0, "message", None, None, None), (2, 0, "message", None, None, None)]
    df = spark.createDataFrame(ev, "conv_id bigint, seq bigint, op string, msg_id string, role string, text string")
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.render(chat_format.messages(df))).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("user", "hi <|x|> & [INST]"), ("assistant", "Again!"), ("us|er\n", "second")]
    assert back[1]["loss_text"] == "Again!" and back[1]["formatted"].count("<|end|>") == 3
    assert [tuple(t) for t in back[2]["turns"]] == [("", ""), ("", "")]
    assert chat_format.read_back(chat_format.render(chat_format.messages(df.limit(0)))).count() == 0


def test_pipeline_stages_keep_columns_and_clean_rows(spark, docs, empty):
    sf = "/root/testdata/sf0.001"
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in (docs, empty):
        at = table.select(*cols)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = at.count()
            at = stage(spark, at, sf)
            assert at.columns == cols, name
            if name != "mixing":
                assert at.count() <= before
        assert corpus_pipeline.STAGES[-1][1](spark, at, sf).count() == at.count()


def test_pipeline_dedup_stage_matches_brute_force(spark, docs):
    classes = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_classes(docs).collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, "").select("doc_id").collect()}
    assert kept == {d for d, c in classes.items() if d == c}


def test_pipeline_dedup_stage_keeps_one_row_of_each_group(spark):
    """Repeated rows, repeated doc_ids with different texts, rows without doc_id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (9, c), (None, c), (None, a + " z"), (None, "only here"), (None, "only here"),
            (11, None), (11, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.one_of_each_group(spark, df, "").collect())
    assert got == sorted([(3, a), (5, b), (9, c), (0, "only here"), (11, ""), (11, "")])


@pytest.mark.parametrize("ids", ["one", "none", "own"])
def test_sharding_divides_repeated_rows(spark, ids):
    """A group of equal rows with three quarters of all bytes, with one doc_id, none or their own."""
    same = "the same words again " * 40
    rows = [({"one": 7, "none": None, "own": i}[ids], same, "en") for i in range(600)]
    rows += [(1000 + i, f"small text {i} " * 19, "en") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    got = sharding.kd_shards(df, shards=8).collect()
    assert len(got) == len(rows)
    weight, slots = [0] * 8, {}
    for r in got:
        weight[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    mean = sum(weight) / 8
    assert max(abs(w - mean) for w in weight) <= 0.011 * mean, weight
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def _replayed(log):
    """The log played event by event: final (seq, role, text) of the live messages."""
    made = {}
    for seq, op, msg, role, text in sorted(log):
        m = made.setdefault(msg, {"seq": seq, "role": role, "text": "", "live": True})
        if op == "regenerate" and m["live"]:
            for other in made.values():
                if m["seq"] < other["seq"] <= seq:
                    other["live"] = False
        m["text"] = m["text"] + text if op == "delta" else text
    return sorted((m["seq"], m["role"], m["text"]) for m in made.values() if m["live"])


def test_messages_match_a_replay_of_random_logs(spark):
    rng = np.random.default_rng(12)
    logs = {}
    for conv in range(60):
        log, known, seq = [], [], 0
        for _ in range(int(rng.integers(1, 25))):
            seq += int(rng.integers(1, 3))
            kind = rng.random()
            if not known or kind < 0.4:
                known.append(f"m{len(known)}")
                log.append((seq, "message", known[-1], str(rng.choice(["user", "assistant"])), f"a{seq}"))
            else:
                op = "delta" if kind < 0.65 else "edit" if kind < 0.8 else "regenerate"
                log.append((seq, op, str(rng.choice(known)), "", f"{op[0]}{seq}"))
        logs[conv] = log
    # a void message's late regeneration leaves the later turns alone
    logs[99] = [(1, "message", "a", "user", "A"), (2, "message", "b", "assistant", "B"), (3, "regenerate", "a", "", "A2"),
                (4, "message", "c", "assistant", "C"), (5, "regenerate", "b", "", "B2"), (6, "message", "d", "user", "D")]
    df = spark.createDataFrame([(c, s, o, m, r, t) for c, log in logs.items() for s, o, m, r, t in log],
                               "conv_id bigint, seq bigint, op string, msg_id string, role string, text string").repartition(5)
    got = {}
    for r in chat_format.messages(df).collect():
        got.setdefault(r["conv_id"], []).append((r["seq"], r["role"], r["text"]))
    assert _replayed(logs[99]) == [(1, "user", "A2"), (4, "assistant", "C"), (6, "user", "D")]
    assert {c: sorted(v) for c, v in got.items()} == {c: _replayed(log) for c, log in logs.items()}


def test_turn_events_restore_every_row(spark):
    from quarry.llm.catalogue import turn_events
    rows = [(1, 0, "user", "héllo"), (1, 0, "user", "héllo"), (1, 1, "assistant", None), (1, None, "user", "x"), (None, 2, None, "y z"),
            (2, 5, "assistant", "w " * 100_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat_format.messages(turn_events(df)).collect()
    assert sorted(((r["conv_id"], r["role"], r["text"]) for r in got), key=str) == sorted(
        ((c, r or "", t or "") for c, _, r, t in rows), key=str)


def _line_brute(rows, min_docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    seen = {}
    for i, (d, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if key(line):
                seen.setdefault(key(line), set()).add(("row", i) if d is None else d)
    gone = {k for k, docs in seen.items() if len(docs) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_counts_documents_not_rows(spark):
    """Ten copies of one row and one other are two documents; rows without doc_id are one each."""
    rows = [(1, "shared\nmine")] * 10 + [(2, "shared")] + [(None, "lone\nx")] * 10 + [(None, None)] * 12
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sorted((tuple(r) for r in line_dedup.drop_common_lines(df, 10).collect()), key=str)
    assert got == _line_brute(rows, 10)
    assert {r[3] for r in got if r[0] is None} == {""} and {r[3] for r in got if r[0] == 1} == {"shared\nmine"}


def test_line_dedup_over_many_batches_matches_brute_force(spark):
    rng = np.random.default_rng(21)
    rows = []
    for i in range(300):
        lines = [rng.choice(["A", " a\t", "b", "c", "", "É", f"d{rng.integers(0, 40)}", f"e{rng.integers(0, 400)}"]) for _ in range(rng.integers(0, 9))]
        d = None if i % 17 == 0 else int(rng.integers(0, 150)) if i % 3 == 0 else 1000 + i
        rows.append((d, "\n".join(map(str, lines)) if i % 29 else None))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for batches in (1, 5):
        drop = line_dedup.common_lines(df, 10, batches)
        assert drop.count() == drop.distinct().count() > 0
    got = sorted((tuple(r) for r in line_dedup.drop_common_lines(df, 10).collect()), key=str)
    assert got == _line_brute(rows, 10)


def test_runs_meet_batches_and_each_other_without_an_exchange(spark):
    import contextlib
    import io
    one, two = (line_dedup.Run(spark.range(k, 500 + k).selectExpr("xxhash64(id) AS h1", "xxhash64(1, id) AS h2", "id % 20 AS n"))
                for k in (0, 100))
    trees = []
    for df in (line_dedup._merged([one, two]), one.rows().join(two.rows().select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain(mode="formatted")
        assert "Bucketed: true" in buf.getvalue()
        trees.append(buf.getvalue().split("\n\n\n")[0])
    assert all("Exchange" not in t and "SortMergeJoin" in t for t in trees)
    assert line_dedup._merged([one, two]).count() == 600
    one.drop(), two.drop()


def test_substring_dedup_keeps_texts_of_one_doc_id_apart(spark):
    """1,500 texts under one id, half of them with a passage of a smaller id: no other word goes."""
    rng = np.random.default_rng(3)
    vocab = [f"v{i}" for i in range(5000)]
    say = lambda n: " ".join(rng.choice(vocab, n))
    passage = say(20)
    rows = [(1, passage)] + [(9, f"{say(15)} {passage} {say(15)}" if i % 2 else say(40)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = substring_dedup.remove_repeats(df).collect()
    assert len(got) == 1501
    removed = sorted(r["n_removed"] for r in got)
    assert removed == [0] * 751 + [20] * 750


def test_pii_model_adds_what_no_check_proves(spark):
    """Half of the loosely written phone numbers are named by a word before them. The model learns how they are written and adds
    the other half; other numbers of any length are left alone. Held against the planted spans."""
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], n))
    digits = lambda n: "".join(map(str, rng.integers(1, 9, n)))
    rows, planted, named = [], {}, {}
    for i in range(240):
        phone, lead = f"{digits(3)}-{digits(3)}-{digits(4)}", "call " if i % 2 else "reach "
        rows.append((i, f"{say(5)} {lead}{phone} {say(3)}"))
        (named if i % 2 else planted)[i] = ("phone", len(rows[-1][1].split(phone)[0]), phone)
    for i in range(240, 700):
        other = [f"{digits(2)} {digits(7)}", digits(9), f"{digits(3)}.{digits(2)}.{digits(3)}.{digits(3)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)} 0{digits(1)}"][i % 4]
        rows.append((i, f"{say(4)} ref {other} {say(4)}"))
    for i in range(700, 740):
        mail = f"jane{i} (at) host{i} (dot) org"
        rows.append((i, f"{say(3)} {mail} {say(3)}"))
        named[i] = ("email", len(rows[-1][1].split(mail)[0]), mail)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: [(a["kind"], a["start"], r["text"][a["start"]:a["stop"]]) for a in r["added"]] for r in pii.detect(df).collect()}
    added = {(d, *a) for d, spans in got.items() for a in spans}
    want = {(d, *a) for d, a in (planted | named).items()}
    unproven = {(d, *a) for d, a in planted.items()}
    precision, recall = len(added & want) / len(added), len(added & unproven) / len(unproven)
    assert precision >= 0.97 and recall >= 0.97, (precision, recall)


def test_pii_trees_as_expressions_score_like_the_fitted_model(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 4, (300, len(pii.FEATURES)))
    n = rng.integers(1, 9, 300).astype(float)
    pos = np.where((x[:, 0] > 1) & (x[:, 3] < 2), n, 0.0)
    model = pii._boost(x, pos, n)
    df = spark.createDataFrame([(i, tuple(map(int, v))) for i, v in enumerate(x)],
                               "i int, c struct<" + ",".join(f"{f}:int" for f in pii.FEATURES) + ">")
    score = F.lit(model["bias"])
    for t in model["trees"]:
        score = score + pii._tree_column(t, F.col("c"))
    got = {r["i"]: r["s"] for r in df.select("i", score.alias("s")).collect()}
    want = pii._scores(model, x)
    assert all(abs(got[i] - want[i]) < 1e-9 for i in range(300))
    assert want[pos > 0].min() > want[pos == 0].max()          # an interaction of two features


def test_pii_without_labelled_candidates_adds_nothing(spark):
    df = spark.createDataFrame([(i, f"number 12 345678{i} here") for i in range(20)], "doc_id bigint, text string")
    assert pii.fit(df) == {} and all(r["added"] == [] for r in pii.detect(df).collect())


def test_components_of_hubs_chains_and_single_links(spark):
    from quarry.llm.components import components
    links = [(0, i) for i in range(1, 400)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5001), (7000, 7000)]
    links += [(399, 2000), (2000, 2001)]
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(4)
    got = {r["node"]: r["component"] for r in components(df).collect()}
    want = {i: 0 for i in [*range(400), 2000, 2001]} | {i: 1000 for i in range(1000, 1101)} | {5000: 5000, 5001: 5000}
    assert got == want
    assert components(df.limit(0)).count() == 0


def test_toxicity_training_sample_is_bounded(spark):
    """A labelled doc_id on many rows gives one text; a very long text gives TRAIN_WORDS words."""
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join(f"w{i}" for i in range(9000))])], names=["doc_id", "text"])
    assert len(next(toxicity._bag_rows(iter([batch])))["bag"][0]) == toxicity.TRAIN_WORDS
    rows = [(i, f"good word{i % 7} text") for i in range(60)] + [(i, "vile foul words here") for i in range(60, 120)]
    rows += [(5, f"other text {i}") for i in range(300)] + [(5, None)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    lab = spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(120)], "doc_id bigint, quality int, toxic int")
    got = [r["doc_id"] for r in toxicity.score(df, toxicity.fit(df, lab)).filter("toxic").collect()]
    assert sorted(got) == list(range(60, 120))


def test_toxicity_training_holds_few_copies_of_its_words():
    import tracemalloc
    n = 1000
    h = np.sort(np.random.default_rng(0).integers(0, 200_000, (n, 500)), axis=1).ravel().astype(np.uint64)
    h[::500][np.arange(n) % 5 == 0] = 7                # a word of the toxic rows
    labels = np.stack([np.arange(n) % 4 == 0, np.arange(n) % 5 == 0], axis=1).astype(np.int64)
    tracemalloc.start()
    try:
        models, _ = toxicity.train(h, np.arange(n + 1) * 500, labels, np.arange(n) % 3, np.ones(n))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 5.8 * h.nbytes and 7 in models[1].words.tolist()
