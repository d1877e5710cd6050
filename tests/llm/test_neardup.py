import re
from collections import Counter

import numpy as np
import pytest

from tabulon.llm import neardup, queries
from tabulon.llm import textkernel as tk

SF = "/root/testdata/sf0.001"


def shingle_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if words and len(words) < 5:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_classes(rows, similar=0.8):
    """doc_id -> class_id by comparing all pairs, with the frequencies counted in the operator's buckets."""
    sets = {}
    frequency, n = np.zeros(neardup.BUCKETS, int), 0
    for d, text in rows:
        h, _, c = neardup.counted(tk.Texts([text or ""]))
        assert len(h) == len(shingle_counts(text)) and sorted(c) == sorted(shingle_counts(text).values())
        sets[d] = dict(zip(h.tolist(), c.tolist(), strict=True))
        frequency[np.unique(neardup.bucket_of(h))] += 1
        n += bool(len(h))
    w = neardup.weights(n, frequency)
    weight = lambda x: float(w[x >> 46])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = sum(min(c, sets[b][x]) * weight(x) for x, c in sets[a].items() if x in sets[b])
            union = sum(c * weight(x) for s in (sets[a], sets[b]) for x, c in s.items()) - both
            if both >= similar * union:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def test_documents(spark, docs):
    got = {r["doc_id"]: r["class_id"] for r in queries.op2_neardup(spark, SF).collect()}
    assert got == brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])


def variants(spark, meet, monkeypatch):
    monkeypatch.setattr(neardup, "MEET", meet)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    rows, d = [], 0
    for _ in range(6):
        base = rng.choice(words, 150).tolist()
        for _ in range(25):
            t = list(base)
            for at in rng.integers(0, 150, rng.integers(0, 9)):
                t[at] = str(rng.integers(1 << 40))
            rows.append((d, " ".join(t)))
            d += 1
    rows += [(d + i, " ".join(rng.choice(words, 80))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return rows, {r["doc_id"]: r["class_id"] for r in neardup.classes(df).collect()}


@pytest.mark.parametrize("meet", [512, 8])
def test_groups_in_one_block_and_in_many(spark, meet, monkeypatch):
    rows, got = variants(spark, meet, monkeypatch)
    want = brute_classes(rows)
    assert got == want and len(set(want.values())) < 150


def test_unlike_texts_of_one_large_bucket(spark, monkeypatch):
    """Texts that only share a common phrase: rows grow with the texts, and what is alike is still found."""
    monkeypatch.setattr(neardup, "MEET", 16)
    rng = np.random.default_rng(6)
    text = lambda i: " ".join(["for the terms see below"] * 5 + [f"u{i}x{j}" for j in range(30)])
    rows = [(i, text(i)) for i in range(900)]
    rows += [(1000 + j, " ".join(w if w != "u7x3" else f"z{j}" for w in text(7).split())) for j in range(3)]
    rng.shuffle(rows)
    rows = [(int(d), str(t)) for d, t in rows]
    seen = []
    real = neardup.second_groups
    monkeypatch.setattr(neardup, "second_groups", lambda again: seen.append((again.count(), real(again).count())) or real(again))
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_classes(rows)
    assert seen and all(after < 12 * before for before, after in seen)


def test_samples_estimate_similarity():
    rng = np.random.default_rng(2)
    words = [f"x{i}" for i in range(5000)]
    idf = np.full(neardup.BUCKETS, 2, np.float32)
    errors = []
    for _ in range(60):
        a = rng.choice(words, 400).tolist()
        b = list(a)
        for at in rng.integers(0, 400, rng.integers(0, 40)):
            b[at] = "y"
        h, who, n = neardup.counted(tk.Texts([" ".join(a), " ".join(b)]))
        s = neardup.samples(h, who, n, idf, 2)
        exact = neardup.weighted_jaccard((h[who == 0], n[who == 0]), (h[who == 1], n[who == 1]), idf)
        errors.append((s[0] == s[1]).mean() - exact)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.12


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000 + i, 2001 + i) for i in range(60)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    neardup.ensure_checkpoint_dir(spark)
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_odd(spark, odd_docs, no_docs):
    rows = neardup.classes(odd_docs).collect()
    assert len(rows) == 9 and {(r["doc_id"], r["class_id"]) for r in rows} == {(d, d) for d in (1, 2, 3, None, 4, 5, 6, 7)}
    assert neardup.classes(no_docs).count() == 0
    kept = neardup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and neardup.drop_near_duplicates(no_docs).count() == 0
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, (1, 2, 3, None, 4, 5, 6, 7)))


@pytest.mark.parametrize("parts", [1, 4])
def test_tied_and_null_ids(spark, parts):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(3000)]

    def copies(n):
        base = rng.choice(words, 120).tolist()
        return [" ".join(base[:-1] + [f"v{i}"]) for i in range(n)]

    tied, none, other, mixed, same = copies(4), copies(3), copies(3), copies(3), copies(1)
    rows = [(7, t) for t in tied] + [(None, t) for t in (*none, *other, *same * 2)] + [(None, mixed[0]), (9, mixed[1]), (9, mixed[2])] + [(None, "alone without an id here"), (7, "another text of the tied id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    kept = [(r["doc_id"], r["text"]) for r in neardup.drop_near_duplicates(df).collect()]
    for group, d in ((tied, 7), (none, None), (other, None), (mixed, 9), (same, None)):
        assert [k for k, t in kept if t in group] == [d]
    assert len(kept) == 7
    ids = {}
    named = neardup.classes(df)
    texts = {r["th"]: r["text"] for r in df.selectExpr("unhex(md5(text)) as th", "text").collect()}
    for r in named.collect():
        ids.setdefault(texts[r["th"]], set()).add(r["class_id"])
    of = lambda group: set().union(*[ids[t] for t in group])
    assert of(tied) == {7} and of(mixed) == {9} and ids["alone without an id here"] == {None}
    assert all(len(of(g)) == 1 and min(of(g)) < 0 for g in (none, other, same))
    assert len(of(none) | of(other) | of(same)) == 3
