import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import quality, queries
from tabulon.llm import textkernel as tk

SF = "/root/testdata/sf0.001"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            cover |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)]


def check(rows, docs):
    want = sorted(str((r["doc_id"], brute(r["text"] or ""))) for r in docs.collect())
    assert sorted(str((r["doc_id"], [r[c] for c in quality.COUNTS])) for r in rows) == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["p_quality"] >= quality.KEEP_FROM)


def test_base_counts(spark, docs):
    check(queries.op1_quality(spark, SF).collect(), docs)


def test_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None), (99, 1)], "doc_id long, quality int")
    check(quality.score(odd_docs, labels).collect(), odd_docs)
    assert quality.score(no_docs, labels).count() == 0
    assert quality.score(odd_docs, labels.limit(0)).where("not base_failed and not kept").count() == 0


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_equal_hashes_of_different_lines_and_windows(n):
    x, y = thue_morse(n), thue_morse(n, "b", "a")
    t = tk.Texts([x + y])
    h = t.hashes(np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] == h[1]  # the case is one
    rest = " c d e f g h i"
    texts = [f"{x}\n{y}", f"{x}\n{x}\n{y}\n{y}", f"{x}{rest} {y}{rest} z", f"{x}{rest} {x}{rest} {y}{rest}", "plain text"]
    counts = quality.base_counts(tk.Texts(texts))
    for i, text in enumerate(texts):
        assert [counts[c][i] for c in quality.COUNTS] == brute(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab \n#é", max_size=120), min_size=1, max_size=5))
def test_base_counts_of_any_text(texts):
    counts = quality.base_counts(tk.Texts(texts))
    for i, text in enumerate(texts):
        assert [counts[c][i] for c in quality.COUNTS] == brute(text) and quality._repeats(text) == tuple(brute(text)[3:])


def test_clashing_columns_and_odd_field_names(spark, odd_docs):
    clash = odd_docs.selectExpr("*", "'x' as n_words", "'y' as kept", "'z' as P_Quality", "named_struct('a b', 1) as s")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    rows = quality.score(clash, labels)
    check(rows.collect(), odd_docs)
    assert rows.columns == [*odd_docs.columns, "s", *quality.COUNTS, "p_quality", "base_failed", "kept"] and rows.first()["s"][0] == 1


W = (1 << 64) - 1


def mixed(h):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> shift)) * factor & W
    return h ^ (h >> 31)


def brute_margin(text, weights):
    """Sum over the four families of n-grams of the mean weight of a text's, by plain integers."""
    base = 0x9E3779B97F4A7C15

    def word_hash(w):
        total = 0
        for i, c in enumerate(w):
            x = (ord(c) + 1) * 0xD6E8FEB86659FD93 & W
            total += (x ^ (x >> 29)) * pow(base, i, 1 << 64)
        return mixed((total + len(w)) & W)

    def grams(items, k):
        return [mixed(sum(x * pow(base, k - 1 - j, 1 << 64) for j, x in enumerate(items[i : i + k])) & W) for i in range(len(items) - k + 1)]

    words = [word_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    chars = [(ord(c) + 1) * 0xD6E8FEB86659FD93 & W for c in text]
    chars = [x ^ (x >> 32) for x in chars]
    pairs = [0x1B873593CC9E2D51 if a == b else h for h, a, b in zip(grams(words, 2), words, words[1:])]
    total = 0.0
    for family, hashes in enumerate((grams(words, 1), pairs, grams(chars, 3), grams(chars, 4))):
        found = [weights[family * 65536 + (h >> 48)] for h in hashes]
        total += sum(found) / len(found) if found else 0.0
    return total


def test_scores_against_plain_arithmetic(spark, docs):
    rng = np.random.default_rng(3)
    texts = [r["text"] or "" for r in docs.limit(60).collect()] + ["", "a", "a a a b", "é | ü 😀", " \n"]
    good = np.arange(len(texts)) % 3 > 0
    model = quality.fit(texts, good)
    model[: quality.N_FAMILIES * quality.BUCKETS] += rng.normal(size=quality.N_FAMILIES * quality.BUCKETS)
    got = quality.probabilities(tk.Texts(texts), model)
    b, slope, shift = model[-3:]
    for t, p in zip(texts, got, strict=True):
        assert abs(p - 1 / (1 + np.exp(-(slope * (brute_margin(t, model) + b) + shift)))) < 1e-9


def test_the_fit_is_at_its_minimum():
    rng = np.random.default_rng(8)
    r, c, x = rng.integers(0, 80, 900), rng.integers(0, 12, 900), rng.random(900)
    y = (rng.random(80) < 0.4).astype(float)
    w = quality._regress(r, c, x, y, 12)
    dense = np.zeros((80, 12))
    np.add.at(dense, (r, c), x)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    slope = lambda w: np.append(dense.T @ (weight * (1 / (1 + np.exp(-(dense @ w[:-1] + w[-1]))) - y)) + quality.L2 * w[:-1], (weight * (1 / (1 + np.exp(-(dense @ w[:-1] + w[-1]))) - y)).sum())
    assert np.abs(slope(w)).max() < 1e-3 < np.abs(slope(np.zeros(13))).max()


def test_the_fit_holds_its_rows_once():
    rng = np.random.default_rng(9)
    words = ["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(3000)]
    texts = [" ".join(words[i] for i in rng.integers(0, 3000, 600)) for _ in range(200)]
    tracemalloc.start()
    quality.fit(texts, np.arange(200) % 3 % 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * sum(map(len, texts))


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, None), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    seen = []
    real, quality.fit = quality.fit, lambda texts, good: seen.append((texts, good.tolist())) or np.full(3, len(texts))
    try:
        assert quality.train(docs, labels).tolist() == [2.0] * 3
    finally:
        quality.fit = real


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality").orderBy("doc_id").collect()
    fold = np.arange(len(rows)) % 2 == 0
    model = quality.fit([r["text"] for r, f in zip(rows, fold) if f][:1500], np.array([r["quality"] for r, f in zip(rows, fold) if f][:1500]))
    rest = [r for r, f in zip(rows, fold) if not f]
    p = np.concatenate([quality.probabilities(tk.Texts(run), model) for _, run in tk.grouped([r["text"] for r in rest])])
    fails = np.array([b[0] < 20 or 100 * b[4] > 30 * b[0] for b in (brute(r["text"]) for r in rest)])
    kept, good = ~fails & (p >= quality.KEEP_FROM), np.array([r["quality"] for r in rest]) == 1
    assert (kept | fails)[good].mean() > 0.99 and kept[~good].mean() < 0.05
    for a, b in ((0.05, 0.3), (0.7, 0.95)):  # calibration: labels in a band are about as probable as it says
        band = (p >= a) & (p < b) & ~fails
        assert band.sum() < 20 or a - 0.25 < good[band].mean() < b + 0.25
