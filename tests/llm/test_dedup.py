import hashlib
import pickle
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest

from credalis.llm import decontaminate, exact_dedup, near_dedup, skew
from credalis.llm import kernel as K

WORDS = [f"w{i}" for i in range(4000)]


def clean(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def shingles(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(rows, k, percent=80):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed=0):
    """Clean texts, exact copies, chains of near copies, borderline pairs, short, blank and null texts."""
    rng = random.Random(seed)
    rows = [(i, clean(rng, rng.randint(1, 150))) for i in range(60)]
    for group in range(12):
        words = clean(rng, rng.randint(20, 90)).split()
        for c in range(rng.randint(2, 9)):
            edited = list(words)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                words = edited
            rows.append((1000 + 20 * group + c, " ".join(edited).upper() if rng.random() < 0.2 else " \n".join(edited)))
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, None), (2004, "one two"), (2005, "One  two"), (2006, "one"), (2007, "héé ßa 日本 ok"), (2008, "héé ßa 日本 ok"), (2009, clean(rng, 9000))]
    rows.append((2010, rows[-1][1] + " tail"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_match_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(skew, "HOT", {4: 10_000, 5: 4}[k])  # nearly all keys hot, or none
    rows = corpus(k)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k=k).collect()
    want = brute_components(rows, k)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_dense_group_is_searched_fully(spark, monkeypatch):
    """Many copies around the threshold: links beyond the star, keys over SMALL, several blocks."""
    rng = random.Random(5)
    base = clean(rng, 60).split()
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = rng.choice(WORDS)
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 20)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4)


def test_large_keys_compare_all_texts_of_a_repeated_doc_id(spark):
    x, y = (np.arange(a, a + 20).astype("<u8").tobytes() for a in (0, 100))
    rows = spark.createDataFrame([(7, n, n, 20, 4, 80) for n in (1, 2, 5)], "key long, node long, root long, n long, c long, s long")
    sets = spark.createDataFrame([(5, x), (1, x), (5, y), (2, y), (5, y)], "node long, set binary")
    got = near_dedup._in_blocks(rows, sets, 80).collect()
    assert sorted(sorted((r.a, r.b)) for r in got) == [[1, 5], [2, 5]]


def test_joins_with_hot_keys(spark, monkeypatch):
    left = spark.createDataFrame([(i, 7 if i % 3 else i % 10, f"v{i}") for i in range(300)], "id long, k long, v string")
    right = spark.createDataFrame([(k, f"r{k}", 200 if k == 7 else 10) for k in (0, 3, 7, 8)], "k long, r string, n long")
    for hot in (1, 4, 10_000):
        monkeypatch.setattr(skew, "HOT", hot)
        for how in ("inner", "left"):
            want = left.join(right.drop("n"), "k", how).select("id", "k", "v", "r")
            got = skew.joined(left, right, ["k"], "n", ["id"], how)
            assert got.columns == ["id", "k", "v", "r"] and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_near_dedup_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == 0
    rows = [(1, "a b c d e f", "x", 1), (1, "a b c d e f", "y", 2), (2, "a b c d e f", "z", 3), (None, "q r s t u v", "n", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, _maybe int")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(-1, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert sorted(r.node for r in near_dedup.drop_near_copies(docs).collect()) == ["n", "x", "y"]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r.node: r.root for r in near_dedup.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_hashes_tell_words_apart():
    texts = ["ab c", "a bc", "abc", "cab", "c ab", "ab C", "", "é e", "e é"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    starts, ends, first = K.word_spans(data, offsets, K.NON_SPACE)
    got = [[data[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first, first[1:])]
    assert got == [t.split() for t in texts]
    sets = K.shingle_sets(data, offsets, 2)
    keys = [s.tobytes() for s in sets]
    assert keys[0] == keys[5] and len(set(keys)) == len(texts) - 1


# --- exact copies ---


def test_exact_dedup_matches_groups(spark, monkeypatch):
    rows = corpus(3) + [(5000, "Same"), (5001, "same"), (5002, "Same"), (5002, "Same"), (None, "Same"), (None, "alone")]
    docs = spark.createDataFrame([(i, t, f"s{n}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, digest string").repartition(6)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for keep, best, hot in (("max", max, 10_000), ("min", min, 2)):
        monkeypatch.setattr(skew, "HOT", hot)  # both ways to join
        got = [tuple(r) for r in exact_dedup.exact_groups(docs, keep=keep).collect()]
        want = [(i, best((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
        assert sorted(got, key=str) == sorted(want, key=str)
        kept = exact_dedup.drop_exact_copies(docs, keep)
        assert kept.columns == docs.columns and sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in kept.collect()) == sorted((best((x for x in g if x is not None), default=-1), t) for t, g in groups.items())
    assert exact_dedup.exact_groups(docs.limit(0)).count() == exact_dedup.drop_exact_copies(docs.limit(0)).count() == 0


def test_equal_digests_of_different_texts(spark):
    """One byte of digest: bytes decide."""
    rows = [(i, f"text {i % 300}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, keep="min", width=1, memtable_rows=50).collect()}
    assert got == {i: (i % 300, 3) for i in range(900)}
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(docs, width=1).collect()) == list(range(300))


@pytest.mark.parametrize("held", [40, 10_000])
def test_merge_index_flushes_and_merges_runs(held):
    rng = random.Random(1)
    keys = np.array([hashlib.sha256(str(rng.randrange(200)).encode()).hexdigest() for _ in range(2000)], "S")
    known = np.arange(2000) % 7 > 0
    index = exact_dedup.MergeIndex("min", memtable_rows=16, held_rows=held)
    out, most = [], 0
    for k in range(0, 2000, 25):
        out += index.put(keys[k : k + 25], np.arange(k, k + 25), known[k : k + 25])
        most = max(most, len(index.runs))
        assert sum(len(r.digests) for r in index.runs) <= held + 25
    out += index.compacted()
    assert (most > 1 or held == 40) and (len(out) > 3) == (held == 40)
    found = defaultdict(list)
    for run in out:
        assert run.digests.tolist() == sorted(set(run.digests.tolist()))
        for d, i, k, n in zip(run.digests.tolist(), run.ids.tolist(), run.known.tolist(), run.counts.tolist()):
            found[d].append((i if k else None, n))
    assert set(found) == set(keys.tolist())
    for d, parts in found.items():
        own = np.flatnonzero(keys == d)
        assert sum(n for _, n in parts) == len(own)
        assert min((i for i, _ in parts if i is not None), default=None) == min((j for j in own.tolist() if j % 7), default=None)


# --- benchmark passages ---


def brute_contamination(text, items):
    words = decontaminate.normal_words(text)
    hit, found = set(), set()
    for item, body in items:
        w = decontaminate.normal_words(body)
        n = min(10, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def bench_tables(spark):
    rng = random.Random(2)
    items = [(1, clean(rng, 12)), (2, clean(rng, 30)), (3, "Kurz und-gut"), (4, None), (5, "..."), (10, "É日 x"), (2, clean(rng, 11)), (11, clean(rng, 10))]
    docs = [(0, None), (1, ""), (2, clean(rng, 50))]
    for i in range(3, 30):
        item = rng.choice(items)[1] or ""
        cut = item.split()[rng.randrange(3) :] if item else []
        docs.append((i, clean(rng, rng.randint(0, 20)) + " , " + " -- ".join(cut).upper().replace("É", "é") + "! " + clean(rng, 5)))
    docs.append((3, "kurz, und gut; KURZ UND gut"))
    return docs, items


def test_contamination_matches_brute_force(spark):
    docs, items = bench_tables(spark)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, *brute_contamination(t, items)) for i, t in docs)
    assert sorted(map(tuple, decontaminate.contamination(d, b).collect())) == want
    assert sorted(map(tuple, decontaminate.contamination(d, b, block_bytes=100).collect())) == want
    assert any(w[-1] for w in want) and not all(w[-1] for w in want)
    left = decontaminate.decontaminate(d, b)
    assert sorted(r.doc_id for r in left.collect()) == sorted(w[0] for w in want if not w[-1])
    cut = decontaminate.decontaminate(d, b, remove="spans")
    assert cut.count() == len(docs) and not any(brute_contamination(r.text, items)[-1] for r in cut.collect())
    assert {r.n_hit for r in decontaminate.contamination(d, b.limit(0)).collect()} == {0}
    assert decontaminate.contamination(d.limit(0), b).count() == 0
    for block_bytes in (100, 1 << 20):
        left = decontaminate.decontaminate(d, b, block_bytes=block_bytes)
        assert sorted(r.doc_id for r in left.collect()) == sorted(w[0] for w in want if not w[-1])
        cut = decontaminate.decontaminate(d.withColumnRenamed("doc_id", "_row"), b, remove="spans", block_bytes=block_bytes)
        assert cut.columns == ["_row", "text"] and sum(len((r.text or "").split()) for r in cut.collect()) < sum(len((t or "").split()) for _, t in docs)
    assert decontaminate.decontaminate(d, b.limit(0)).count() == len(docs) and decontaminate.decontaminate(d.limit(0), b).count() == 0


def test_gram_set_is_small_and_long_items_are_cut(spark):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(180_000))
    tracemalloc.start()
    grams = decontaminate.GramSet([(1, text)])
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 8 * len(text) + (30 << 20) and len(pickle.dumps(grams)) < 8 * len(text)  # the kernels keep tables of their own
    short = " ".join(text.split()[:300])
    parts = list(decontaminate.blocks(spark.createDataFrame([(7, short), (8, "x y")], "item_id long, text string"), 200))
    assert all(sum(len(t) for _, t in p) <= 200 + 60 for p in parts) and len(parts) > 5
    windows = lambda t: {tuple(t.split()[i : i + 10]) for i in range(len(t.split()) - 9)}
    assert set().union(*(windows(t) for p in parts for i, t in p if i == 7)) == windows(short)
