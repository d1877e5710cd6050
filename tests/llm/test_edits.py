"""Fingerprints: trees, edits and likeness against a plain second implementation."""

import base64
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import fingerprint as fp
from tabulon.llm import queries

SF = "/root/testdata/sf0.001"
blake = lambda b: hashlib.blake2b(b, digest_size=16).digest()


def brute_leaves(text):
    """Character by character: a leaf ends where stops end, a long one also by its last eight characters."""
    out, leaf = [], ""
    for i, c in enumerate(text):
        leaf += c
        if i + 1 == len(text) or (c in ".!?\n" and text[i + 1] not in ".!?\n"):
            out.append(leaf)
            leaf = ""
    cut = []
    for s in out:
        if len(s) <= 160:
            cut.append(s)
            continue
        piece = ""
        for i, c in enumerate(s):
            piece += c
            h = 0
            for d in s[i - 7 : i + 1] if i >= 7 else "":
                h = (h ^ ord(d)) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 29
            if (i >= 7 and h % 64 == 0) or len(piece) == 256:
                cut.append(piece)
                piece = ""
        if piece:
            cut.append(piece)
    return cut


def brute_tree(text):
    """Nested (digest, text, children) of sections over paragraphs over leaves, and the root's digest."""
    sections, paragraphs, kids = [], [], []

    def close(level, prefix, children):
        level.append((blake(prefix + b"".join(k[0] for k in children)), "".join(k[1] for k in children), children))

    for leaf in brute_leaves(text):
        kids.append((blake(leaf.encode()), leaf, []))
        if leaf.endswith("\n"):
            close(paragraphs, b"p", kids)
            kids = []
            if paragraphs[-1][0][-1] % 8 == 0 or leaf.endswith("\n\n"):
                close(sections, b"s", paragraphs)
                paragraphs = []
    if kids:
        close(paragraphs, b"p", kids)
    if paragraphs:
        close(sections, b"s", paragraphs)
    return blake(b"r" + b"".join(s[0] for s in sections)).hex(), sections


def check_tree(text):
    root, sections = brute_tree(text)
    got_root, got = fp.tree(text)
    short = lambda nodes: [(d[:6], len(t), short(k)) for d, t, k in nodes]
    assert got_root == root and got == short(sections)
    assert fp.decode(fp.fingerprint(text)) == (got_root, got)
    assert len(base64.b64decode(fp.fingerprint(text)[33:])) % 9 == 0


def check_edits(a, b):
    """What lies between the edits is equal; equal texts, and only they, have none."""
    found = fp.locate_edits(fp.fingerprint(a), fp.fingerprint(b))
    at = bt = same = 0
    for s, e, t, f in found:
        assert s >= at and t >= bt and a[at:s] == b[bt:t] and (e > s or f > t)
        same += s - at
        at, bt = e, f
    assert a[at:] == b[bt:]
    same += len(a) - at
    assert bool(found) == (a != b)
    n = len(a) + len(b)
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) == pytest.approx(2 * same / n if n else 1.0)
    return found


TEXT = st.text(st.sampled_from("ab .\n!é"), max_size=80) | st.lists(st.sampled_from(["One is here. ", "Two? ", "three\n", "\n", "x" * 50, "... ", "é" * 170]), max_size=14).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXT, TEXT, st.integers(0, 200), st.integers(0, 200))
def test_trees_and_edits(a, b, i, j):
    check_tree(a)
    check_edits(a, b)
    check_edits(a, a[:i] + b + a[j:])


def test_aligned_is_a_longest_rising_chain():
    rng = random.Random(2)
    for _ in range(200):
        x, y = ([(rng.choice("abcd"), 1, []) for _ in range(rng.randint(0, 9))] for _ in range(2))
        got = fp._aligned(x, y)
        assert all(p < q and r < s for (p, r), (q, s) in zip(got, got[1:])) and all(x[p][0] == y[r][0] for p, r in got)
        rank = lambda z, i: (z[i][0], sum(k[0] == z[i][0] for k in z[:i]))
        where = {rank(y, j): j for j in range(len(y))}
        chain = [where[rank(x, i)] for i in range(len(x)) if rank(x, i) in where]
        best = [0] * len(chain)
        for i, j in enumerate(chain):
            best[i] = 1 + max((best[m] for m in range(i) if chain[m] < j), default=0)
        assert len(got) == max(best, default=0)


def test_an_insertion_without_stops_is_found():
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(1500))
    for at in (0, 17, 4000, len(text)):
        new = text[:at] + "X" + text[at:]
        check_edits(text, new)
        assert fp.likeness(fp.fingerprint(text), fp.fingerprint(new)) > 0.9
    sentences = [f"Sentence {i} says what it says. " for i in range(40)]
    assert fp.likeness(fp.fingerprint("".join(sentences)), fp.fingerprint("".join(sentences[::-1]))) < 0.2


def test_distant_edits_are_located_apart():
    leaves = [f"Sentence {i} of the text.{[' ', chr(10), chr(10) * 2][(i % 3 == 0) + (i % 12 == 0)]}" for i in range(200)]
    new = list(leaves)
    new[5], new[90], new[150] = "Changed here. ", "", leaves[150] + "Added after it. "
    found = check_edits("".join(leaves), "".join(new))
    assert len(found) >= 3 and sum(e - s for s, e, _, _ in found) < 300


def test_edits_are_located():
    text = "".join(f"Sentence {i} says a little. It goes on, {i * 7}.\n" + "\n" * (i % 5 == 0) for i in range(60))
    at = text.index("Sentence 31")
    ((a0, a1, _, _),) = check_edits(text, text[:at] + "Something else" + text[at + 11 :])
    assert a0 <= at < a1 and a1 - a0 < 200
    assert fp.fingerprint(None) == fp.fingerprint("") != fp.fingerprint("\n")


def test_a_long_text_of_one_line_repeated():
    a, b = "the same line\n" * 20_000, "the same line\n" * 10_000 + "another\n" + "the same line\n" * 15_000
    check_edits(a, b)


def check_next(rows, docs):
    order = sorted(docs, key=lambda r: -r["doc_id"])
    rows = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(order)
    for i, r in enumerate(order):
        t, n = r["text"] or "", order[(i + 1) % len(order)]["text"] or ""
        h = len(t) // 2
        new = t[: len(t) - h] + n[:h]
        got = rows[r["doc_id"]]
        assert got["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest() and got["n_chars"] == len(t)
        for mark, text in ((got["fingerprint"], t), (got["edited_fingerprint"], new)):
            assert mark[:32] == brute_tree(text)[0]
            check_tree(text)
        check_edits(t, new)
        assert got["near_next"] == fp.likeness(got["fingerprint"], fp.fingerprint(n)) and got["near_edited"] == fp.likeness(got["fingerprint"], got["edited_fingerprint"])


def test_fingerprints_of_neighbours(spark, docs):
    rows = queries.op4_fingerprint(spark, SF).collect()
    check_next(rows, docs.collect())
    long = [r for r in rows if r["n_chars"] > 600]
    assert 0.35 < sum(r["near_edited"] for r in long) / len(long) < 0.65


def test_fingerprints_odd(odd_docs, no_docs, docs):
    assert fp.compare_with_next(odd_docs).count() == 9 and fp.compare_with_next(no_docs).count() == 0
    one = fp.compare_with_next(docs.where("doc_id = 7")).collect()
    check_next(one, docs.where("doc_id = 7").collect())
    assert one[0]["near_next"] == 1.0
    marked = fp.with_fingerprint(odd_docs.selectExpr("*", "1 as Fingerprint"))
    assert marked.columns == [*odd_docs.columns, "fingerprint"] and all(r["fingerprint"] == fp.fingerprint(r["text"]) for r in marked.collect())
    assert fp.with_fingerprint(no_docs).count() == 0


@pytest.mark.parametrize("ids", [[None] * 300, [5] * 300, [*range(40), *[None] * 100, *[7] * 100, *[9] * 60]])
def test_null_and_equal_ids_are_dealt_out(spark, ids):
    rows = [(d, f"Text {i}. It has words.") for i, d in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    hashes = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) as h").collect()}
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 62)), hashes[r[1]]))
    want = sorted(str((d, fp.fingerprint(t), fp.fingerprint(fp.edited(t, order[(i + 1) % len(order)][1])))) for i, (d, t) in enumerate(order))
    out = fp.compare_with_next(df)
    assert sorted(str((r["doc_id"], r["fingerprint"], r["edited_fingerprint"])) for r in out.collect()) == want
    assert len({r["p"] for r in out.selectExpr("spark_partition_id() as p").distinct().collect()}) >= 3


def test_ranges_are_numbered_in_falling_order():
    cuts = np.array([3, 3, 3, 8, 9, 9])
    k = np.array([20, 10, 9, 9, 8, 5, 4, 3, 3, 3, 2, -5])
    t = np.array([0, 0, -(1 << 62), 1 << 62, 0, 0, 0, -(1 << 62), 0, 1 << 62, 0, 0])
    part = fp._part(cuts).func(__import__("pandas").Series(k), __import__("pandas").Series(t)).tolist()
    assert part == [0, 0, 1, 2, 4, 4, 4, 5, 6, 7, 8, 8]
