"""The n-gram join and the search for benchmark passages against brute force."""

import hashlib
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyfold.llm import decontaminate, jaccard, tokens
from tallyfold.llm.graph import components
from tallyfold.session import interim, shared_dir

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def grams(text):
    w = WORD.findall(text.lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute_force(rows, threshold=0.8):
    """md5 of a text -> (class id, links, class md5)."""
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    texts = {}
    for i, t in rows:
        if t is not None:
            texts.setdefault(t, []).append(i)
    keys = list(texts)
    sets = [grams(k) for k in keys]
    links, parent = [0] * len(keys), list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    members = {}
    for a, k in enumerate(keys):
        members.setdefault(root(a), []).extend((i is None, i or 0, md5(k), i) for i in texts[k])
    names = {r: min(m) for r, m in members.items()}
    return {md5(k): (names[root(a)][3], links[a], names[root(a)][2]) for a, k in enumerate(keys)}


def corpus(n=120):
    rng = random.Random(6)
    voc = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        w = [rng.choice(voc) for _ in range(rng.randint(1, 120))]
        rows.append((i, " ".join(w)))
        for _ in range(rng.choice([0, 0, 1, 4])):
            v = list(w)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = rng.choice(voc)
            rows.append((1000 + len(rows), " ".join(v)))
    # a group of near copies, larger than a block below
    w = [rng.choice(voc) for _ in range(90)]
    for k in range(150):
        v = list(w)
        for _ in range(rng.randint(0, 2)):
            v[rng.randrange(90)] = rng.choice(voc)
        rows.append((5000 + k, " ".join(v)))
    rows += [(9000, None), (None, None), (9001, ""), (9002, ""), (9003, "a b"), (9004, "A, b!"), (None, rows[0][1]), (9005, "..."), (9006, "x " * 30000)]
    return rows + rows[:5]


def compare(spark, rows, threshold=0.8):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int").repartition(3)
    out = jaccard.jaccard_links(df, threshold=threshold).collect()
    assert len(out) == len(rows)
    want = brute_force(rows, threshold)
    for r in out:
        if r["text_md5"] is None:
            assert (r["class_id"], r["class_md5"], r["links"]) == (None, None, 0)
        else:
            assert (r["class_id"], r["links"], r["class_md5"]) == want[r["text_md5"]]


def test_links_and_classes_equal_brute_force(spark):
    compare(spark, corpus())


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.9, 1.0])
def test_other_thresholds(spark, threshold):
    compare(spark, corpus(60), threshold)


def test_bands_follow_from_the_threshold():
    assert [jaccard.band_rows(t) for t in (0.3, 0.5, 0.8, 0.9, 1.0)] == [1, 2, 5, 7, 125]
    with pytest.raises(ValueError):
        jaccard.band_rows(0.05)


def test_interim_tables_go(spark):
    before = set(os.listdir(shared_dir(spark)))
    with interim(spark):
        assert jaccard.jaccard_links(spark.createDataFrame(corpus(5), "doc_id long, text string")).count() > 5
        assert set(os.listdir(shared_dir(spark))) > before
    assert set(os.listdir(shared_dir(spark))) == before


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 40)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 20_000)
    compare(spark, corpus(30))


def test_no_texts(spark):
    assert jaccard.jaccard_links(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    """Of pairs with a similarity of 0.8, hardly any is dropped; of those with 0.4, all are."""
    rng = np.random.default_rng(0)
    least = jaccard.least_matches()
    for similarity, low, high in ((0.8, 0.998, 1.0), (0.4, 0.0, 0.001)):
        n = 4000
        a = rng.integers(0, 1 << 32, (n, jaccard.HASHES), dtype=np.uint32)
        b = np.where(rng.random(a.shape) < similarity, a, a + np.uint32(1))
        kept = jaccard._alike(np.concatenate([a, b]), np.arange(n), np.arange(n) + n, least)
        assert low <= len(kept) / n <= high


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(50)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(60)] + [(300, 301)] * 3
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seen = {}
    for start in sorted(near):
        stack = [start]
        while stack:
            x = stack.pop()
            if x not in seen:
                seen[x] = start
                stack += near[x]
    assert out == seen


def distance(item, words):
    """Least edit distance of ``item`` to any run of ``words``."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        last, row = row, [i]
        for j, y in enumerate(words, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return min(row)


def edited(rng, words, edits, voc):
    w = list(words)
    for _ in range(edits):
        p, kind = rng.randrange(len(w)), rng.random()
        if kind < 0.34:
            w[p] = rng.choice(voc)
        elif kind < 0.67:
            w.insert(p, rng.choice(voc))
        elif len(w) > 1:
            w.pop(p)
    return w


def planted(items_count=25, docs=150):
    rng = random.Random(12)
    voc = [f"w{i}" for i in range(300)]
    items = [(k, [rng.choice(voc) for _ in range(rng.choice([1, 2, 3, 5, 9, 14, 25, 40, 59]))]) for k in range(items_count)]
    out = []
    for d in range(docs):
        words = [rng.choice(voc) for _ in range(rng.randint(0, 150))]
        if d % 2:
            item = rng.choice(items)[1]
            at = rng.randrange(len(words) + 1)
            words[at:at] = edited(rng, item, rng.randint(0, int(0.25 * len(item))), voc)
        out.append((d, words))
    return items, out


def test_leaks_equal_brute_force(spark):
    items, docs = planted()
    bench = spark.createDataFrame([(f"i{k}", " ".join(w).upper()) for k, w in items] + [(None, None), ("e", ""), ("p", "...")], "item_id string, text string")
    rows = [(d, " ,".join(w), "x") for d, w in docs] + [(900, None, "x"), (None, "", "x"), (901, "z " * 50000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    for block in (decontaminate.BLOCK_BYTES, 900):
        out = decontaminate.leaks(df, bench, block_bytes=block).collect()
        got = {(r["doc_id"], r["item_id"]): r["distance"] for r in out}
        want = {}
        for d, w in docs:
            for k, item in items:
                n = distance(item, w)
                if n <= int(0.2 * len(item)):
                    want[d, f"i{k}"] = n
        assert got.items() <= want.items()
        exact = {k for k, n in want.items() if n == 0}
        assert exact <= got.keys()
        assert len(got) >= 0.97 * len(want)
    clean = {r["doc_id"] for r in decontaminate.clean(df, bench).collect()}
    assert clean == {r[0] for r in rows} - {d for d, _ in got}


def test_recall_at_the_largest_distance():
    rng = random.Random(3)
    voc = [f"w{i}" for i in range(5000)]
    items = [[rng.choice(voc) for _ in range(rng.randint(14, 60))] for _ in range(60)]
    index = decontaminate.Index(list(range(60)), [" ".join(w) for w in items], 0.2, 0.99)
    docs = [" ".join([rng.choice(voc) for _ in range(30)] + edited(rng, items[k % 60], int(0.2 * len(items[k % 60])), voc)) for k in range(300)]
    found = {(row, item) for row, item, *_ in decontaminate.find(index, pa.array(docs))}
    assert sum((k, k % 60) in found for k in range(300)) >= 0.98 * 300


def test_no_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, none).count() == 0
    assert decontaminate.leaks(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0
    assert decontaminate.clean(docs, none).count() == 1


def test_words_equal_a_regular_expression():
    texts = ["Hello, world hello", "", None, "a b", "über Über x1-2", " lead", "trail ", "\u2026 dots", "a" * 50]
    for array in (pa.array(texts), pa.array(["x", *texts]).slice(1), pa.array(texts, pa.large_string())):
        hashes, starts = tokens.words(array)
        names = {}
        for k, text in enumerate(texts):
            want = WORD.findall((text or "").lower())
            got = hashes[starts[k] : starts[k + 1]].tolist()
            assert len(got) == len(want)
            assert all(names.setdefault(h, w) == w for h, w in zip(got, want))
        assert len(set(names.values())) == len(names)
    assert [len(x) for x in tokens.words(pa.array([], pa.string()))] == [0, 1]


EDITS = {
    "head cut": lambda rng, w, k, new: w[k:],
    "tail cut": lambda rng, w, k, new: w[:-k],
    "head replaced": lambda rng, w, k, new: new(k) + w[k:],
    "tail replaced": lambda rng, w, k, new: w[:-k] + new(k),
    "block cut": lambda rng, w, k, new: w[: (at := rng.randrange(len(w) - k + 1))] + w[at + k :],
    "block inserted": lambda rng, w, k, new: w[: (at := rng.randrange(1, len(w)))] + new(k) + w[at:],
    "words deleted": lambda rng, w, k, new: [w[i] for i in sorted(rng.sample(range(len(w)), len(w) - k))],
    "words replaced": lambda rng, w, k, new: [new(1)[0] if i in spoiled else x for spoiled in [set(rng.sample(range(len(w)), k))] for i, x in enumerate(w)],
    "words inserted": lambda rng, w, k, new: [y for i, x in enumerate(w) for y in ([x, *new(1)] if i in spoiled else [x])] if (spoiled := set(rng.sample(range(len(w) - 1), k))) else w,
}


def lost_passages(trials, search):
    """(kind of edit, words of the item) -> passages at the largest distance that are not found, of ``trials``."""
    rng = random.Random(8)
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    lost = {}
    for n in (5, 9, 14, 22, 26, 59, 120, 300):
        items = [new(n) for _ in range(trials)]
        index = decontaminate.Index(list(range(trials)), [" ".join(w) for w in items], 0.2, 0.99, search)
        for kind, edit in EDITS.items():
            docs = [" ".join([*new(30), *edit(rng, w, int(0.2 * n), new), *new(30)]) for w in items]
            found = {(row, item) for row, item, *_ in decontaminate.find(index, pa.array(docs))}
            lost[kind, n] = sum((k, k) not in found for k in range(trials))
    return lost


def test_walks_meet_passages_whatever_the_edit_and_the_length():
    trials = 20
    lost = lost_passages(trials, "walks")
    # every kind at every length, and all together near the wanted recall
    assert {k: n for k, n in lost.items() if n > 0.1 * trials} == {}
    assert sum(lost.values()) <= 0.02 * trials * len(lost)


def test_pieces_lose_no_passage():
    assert {k: n for k, n in lost_passages(12, "pieces").items() if n} == {}


def test_recall_decides_the_number_of_walks():
    assert decontaminate.repeats(20, 0.5) < decontaminate.repeats(20, 0.99) < decontaminate.repeats(20, 0.99999)
    walks = [decontaminate.Walks(30, 0.99), decontaminate.Walks(30, 0.99)]
    flat = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = np.arange(100)
    keys = [w.keys(flat, at, np.full(100, 199)) for w in walks]
    assert (keys[0] == keys[1]).all()  # seeded
    assert len(np.unique(keys[0])) == sum(len(np.unique(k)) for k in keys[0])  # no walk repeats another
