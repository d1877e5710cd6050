import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulon.llm import queries, substrings

SF = "/root/testdata/sf0.001"


def brute(rows):
    """(doc_id or None, text) -> sorted results, by a table of every 50-byte string's smallest doc_id."""
    key = lambda d: float("inf") if d is None else d
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            least[w] = min(least.get(w, key(d)), key(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < key(d):
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(d), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


def test_documents(spark, docs):
    assert result(queries.op3_substrings(spark, SF)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd(odd_docs, no_docs):
    assert result(substrings.remove_repeats(odd_docs)) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert result(substrings.remove_repeats(no_docs)) == []


def test_planted(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, run = text(60), "ab" * 300
    rows = []
    for i in range(60):
        t = text(rng.randint(0, 120))
        at = rng.randint(0, len(t))
        cut = rng.randint(0, len(passage))
        t = t[:at] + rng.choice(["", passage, passage[cut:], passage[:cut], run[: rng.randint(1, 600)], "z" * rng.randint(1, 300)]) + t[at:]
        rows.append((rng.randint(0, 40), t))
    rows += [(None, rows[0][1]), (50, rows[1][1]), (51, rows[1][1]), (51, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(substrings.remove_repeats(df)) == brute(rows)
    kept = {(r["doc_id"], r["n_removed"]): r["kept"] for r in substrings.remove_repeats(df, with_bytes=True).collect()}
    assert all(hashlib.sha256(v).hexdigest() for v in kept.values())
    for g in substrings.repeats(df).collect():
        assert len(g["bytes"]) >= 50
        for o in g["occurrences"]:
            assert any((d if d is not None else (1 << 63) - 1) == o["doc_id"] and t.encode()[o["start"] : o["start"] + len(g["bytes"])] == g["bytes"] for d, t in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=30), min_size=1, max_size=6))
def test_groups_are_all_maximal_repeats(texts):
    pieces = sorted({t.encode() for t in texts if t})
    least = 3
    if not pieces:
        return
    piece, offset, common, left = substrings.suffix_array(pieces, least)
    got = set()
    for n, a, b in zip(*substrings.repeat_groups(common, left, least), strict=True):
        occ = frozenset(zip(piece[a : b + 1].tolist(), offset[a : b + 1].tolist(), strict=True))
        assert len({pieces[p][o : o + n] for p, o in occ}) == 1
        got.add((int(n), occ))
    want = set()
    for s in {p[i:j] for p in pieces for i in range(len(p)) for j in range(i + least, len(p) + 1)}:
        occ = [(i, o) for i, p in enumerate(pieces) for o in range(len(p) - len(s) + 1) if p[o : o + len(s)] == s]
        lefts = {pieces[i][o - 1] if o else ("start", i) for i, o in occ}
        rights = {pieces[i][o + len(s)] if o + len(s) < len(pieces[i]) else ("end", i, o) for i, o in occ}
        if len(occ) > 1 and len(lefts) > 1 and len(rights) > 1:
            want.add((len(s), frozenset(occ)))
    assert got == want


def test_windows_are_covered_once():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (0, 49, 50, 51, 500, 3000)] + [b"a" * 1000]
    _, doc, start, n = substrings.anchor_runs(texts)
    for i, t in enumerate(texts):
        seen = sorted(w for s, m in zip(start[doc == i], n[doc == i], strict=True) for w in range(s, s + m))
        assert seen == list(range(max(0, len(t) - 49)))
    assert n.max() <= substrings.SPREAD


@pytest.mark.parametrize("spans,want", [([], []), ([[3, 5], [1, 3], [9, 10]], [[1, 5], [9, 10]]), ([[1, 9], [2, 3], [4, 5]], [[1, 9]])])
def test_union(spans, want):
    assert substrings.union(np.array(spans, np.int64).reshape(-1, 2)).tolist() == want


def brute_groups(rows):
    """(bytes, places) of every string of windows with one leftmost anchor that is in two places or more, of
    which neither the bytes before nor those after are all the same (the ends of such windows differ)."""
    seen = {}
    for r, (d, t) in enumerate(rows):
        b = (t or "").encode()
        if len(b) < 50:
            continue
        grams = [substrings._minima(np.frombuffer(b[i : i + 16] * 4, np.uint8))[0][0] for i in range(len(b) - 15)]
        anchor = [min(range(i, i + 35), key=lambda j: (grams[j], j)) for i in range(len(b) - 49)]
        for i, a in enumerate(anchor):
            for j in range(i, len(anchor)):
                if anchor[j] != a:
                    break
                before = b[i - 1] if i and anchor[i - 1] == a else ("start", r, i)
                after = b[j + 50] if j + 1 < len(anchor) and anchor[j + 1] == a else ("end", r, j)
                seen.setdefault(b[i : j + 50], []).append(((1 << 63) - 1 if d is None else d, i, before, after))
    return sorted((s, sorted(o[:2] for o in occ)) for s, occ in seen.items() if len({o[2] for o in occ}) > 1 and len({o[3] for o in occ}) > 1)


@pytest.mark.parametrize("batch,stretch,parts", [(4 << 20, 1 << 18, 1), (4 << 20, 1 << 18, 5), (700, 64, 3)])
def test_groups_are_whole(spark, monkeypatch, batch, stretch, parts):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(200)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, twice, copied = text(30), text(15), text(40)
    rows = [(i, f"{text(rng.randint(0, 15))}{passage[rng.choice([0, 0, 20]) :]}{text(rng.randint(0, 15))}") for i in range(8)]
    rows += [(20, f"{twice} {text(9)} {twice}"), (21, copied), (22, copied), (22, copied), (None, copied[:70]), (None, passage), (23, "z" * 180), (24, "ab" * 70), (25, None), (26, "short")]
    monkeypatch.setattr(substrings, "BATCH_BYTES", batch)
    monkeypatch.setattr(substrings, "_STRETCH", stretch)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    # in a process of the test's own, where the sizes hold
    rows_, texts = substrings._texts(df, every=True)
    monkeypatch.setattr(substrings, "ANCHORS_AT_A_TIME", batch // 100)
    run = lambda f, d: [r for b in f(iter(d.toArrow().to_batches())) for r in b.to_pylist()]
    told = run(substrings._tell_anchors(4, True), texts.select("th", "copies", "text"))
    back = {}
    for b in range(4):
        for m in substrings._share_anchors(iter([substrings._told([tuple(r.values()) for r in told if r["bucket"] == b])])):
            for r in m.to_pylist():
                back.setdefault(r["batch"], []).append((r["kind"], r["data"]))
    columns = [[[k for k, _ in x] for x in back.values()], [[d for _, d in x] for x in back.values()]]
    keys = {r["th"]: r["keys"] for m in substrings._deliver(iter([pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.list_(pa.binary()))], names=["kind", "data"])])) for r in m.to_pylist()}
    cut = spark.createDataFrame([(r["k"], r["th"], keys[r["th"]], r["text"]) for r in rows_.collect() if r["th"] in keys], "k long, th binary, keys binary, text string")
    pieces = sorted((tuple(r.values()) for r in run(substrings._cut_pieces(8, True), cut)), key=lambda r: r[0])
    local = [g for b in substrings._find_groups(iter([substrings._rows(pieces)])) for g in b.to_pylist()]
    want = brute_groups(rows)
    for found in (local, substrings.repeats(df).collect()):
        assert sorted((bytes(g["bytes"]), [(o["doc_id"], o["start"]) for o in g["occurrences"]]) for g in found) == want
    places, windows = {}, set()
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b)):
            for n in {len(g) for g, _ in want}:
                if i + n <= len(b):
                    places.setdefault(b[i : i + n], []).append(((1 << 63) - 1 if d is None else d, i))
            if i + 50 <= len(b):
                windows.add(b[i : i + 50])
    assert all(sorted(places[g]) == occ for g, occ in want)
    held = {g[i : i + 50] for g, _ in want for i in range(len(g) - 49)}
    assert held == {w for w in windows if len(places[w]) > 1}


@pytest.mark.parametrize("buckets", [51, 200, 816])
def test_anchors_are_dealt_evenly(spark, buckets):
    texts = [(r["text"] or "").encode() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").distinct().limit(400).collect()]
    value = np.unique(substrings.anchor_runs(texts)[0])
    sizes = np.bincount(substrings._bucket(value, buckets), minlength=buckets)
    assert sizes.max() < 2 * sizes.mean() and sizes.min() > 0


def test_buckets_split_beyond_sixteen_bits():
    value = substrings.mix(np.arange(1, 400_000, dtype=np.uint64))
    assert len(np.unique(substrings._bucket(value, 1 << 20))) > 300_000


def test_a_text_of_many_copies_tells_its_anchors_once(spark):
    rng = random.Random(1)
    copied = " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(30))
    rows = [(i, copied) for i in range(3000)] + [(5000 + i, f"{i} {copied[:90]}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    _, texts = substrings._texts(df)
    told = texts.select("th", "k", "text").mapInArrow(substrings._tell_anchors(4), substrings._TOLD_DDL)
    assert texts.count() == 6 and told.count() <= 6 * 6
    assert result(substrings.remove_repeats(df)) == brute(rows)


def test_entries_of_many_keys():
    owner = np.repeat([0, 3, 65534], [2, 200_000, 70_000])
    keys = substrings.mix(np.arange(len(owner), dtype=np.uint64)) >> np.uint64(16)
    o, k = substrings._unpack_entries(substrings._pack_entries(owner, keys) + substrings._pack48(keys[:3]))
    assert (o == np.r_[owner, [-1] * 3]).all() and (k == np.r_[keys, keys[:3]]).all()
