"""Removal of repeated byte strings through maximal repeat groups of an enhanced suffix array.

A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id.  No suffix array of
all documents is built.  Every window of 50 bytes belongs to the least hash among its 16-byte grams, its
anchor, which follows from the window alone, so equal windows meet under equal anchors:

1. batches of documents tell which anchors they have, and learn which of them others have too; anchors of a
   single text are done with;
2. runs of windows under a shared anchor are cut out (84 bytes at most) and dealt out by it;
3. each task builds the suffix array of the different pieces it got, with common-prefix lengths, scans the
   tree of common-prefix intervals with a stack, and outputs those whose left neighbours differ: the maximal
   repeat groups, each with all its occurrences and the smallest doc_id among them;
4. occurrences in later documents are the removed spans, joined to the texts again.

Equal texts are handled once (told apart by a 128-bit digest), and a task tells another about an anchor or a
piece once for each batch of 4 MB, so no anchor, passage or group of copies, however common, gathers in one
task with a row for each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import digest, shuffle_width
from tabulon.llm.textkernel import mix

LENGTH, GRAM = 50, 16
SPREAD = LENGTH - GRAM + 1  # grams in a window, and windows in a piece at most
BATCH_BYTES = 4 << 20
#: Suffix arrays that a task builds, one after the other; anchors that it looks through at a time, or so.
ARRAYS_PER_TASK, ANCHORS_AT_A_TIME = 32, 2_000_000
_STRETCH = 1 << 18  # windows hashed at a time
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_LOW48 = np.uint64((1 << 48) - 1)


def _minima(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window's start, the hash of its first gram and the least hash of its grams."""
    n = len(data)
    words = np.ndarray((n - 7,), "<u8", buffer=data, strides=(1,))
    h = words[: n - 15] * _C1
    h ^= h >> np.uint64(32)
    h += words[8:] * _C2
    h ^= h >> np.uint64(29)
    h *= _C3
    h ^= h >> np.uint64(32)
    grams, have = h, 1
    while have * 2 <= SPREAD:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    rest = SPREAD - have
    m = np.minimum(h[:-rest], h[rest:]) if rest else h
    return grams[: len(m)], m


def anchor_runs(texts: list[bytes], apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, text index, first window, number of windows) of the runs of windows of one anchor, at most
    ``SPREAD`` windows long; every window of every text is in exactly one.

    With ``apart``, a run is of the windows whose leftmost anchor is the same place, which follows from the
    windows alone: wherever windows of one run occur in a row, they are in one run."""
    parts: list[tuple[np.ndarray, ...]] = []
    group: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        if not group:
            return
        data = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
        ends = np.cumsum([len(g[2]) for g in group])
        starts = ends - [len(g[2]) for g in group]
        grams, m = _minima(data)
        new = np.ones(len(m) + 1, bool)
        new[1:-1] = m[1:] != m[:-1]
        if apart:
            new[1:-1] |= grams[:-1] == m[:-1]
        new[starts] = True
        new[np.minimum(ends - LENGTH + 1, len(m))] = True
        at = np.flatnonzero(new)
        n = np.diff(at)
        at = at[:-1]
        which = np.searchsorted(starts, at, side="right") - 1
        valid = at < ends[which] - LENGTH + 1
        at, n, which = at[valid], n[valid], which[valid]
        pieces = -(-n // SPREAD)
        first = np.repeat(at, pieces)
        step = (np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SPREAD
        which, total = np.repeat(which, pieces), np.repeat(n, pieces)
        doc, base = np.array([g[0] for g in group], np.int64), np.array([g[1] for g in group], np.int64)
        parts.append((m[first], doc[which], first + step - starts[which] + base[which], np.minimum(SPREAD, total - step)))
        if apart:  # whether the run may go on in the next stretch
            last = first + parts[-1][3] - 1
            parts[-1] += (grams[last] != m[last],)
        group.clear()

    for i, t in enumerate(texts):
        for base in range(0, len(t) - LENGTH + 1, _STRETCH):
            piece = t[base : base + _STRETCH + LENGTH - 1]
            group.append((i, base, piece))
            size += len(piece)
            if size >= _STRETCH:
                flush()
                size = 0
    flush()
    if not parts:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    value, doc, start, n, *more = (np.concatenate(c) for c in zip(*parts, strict=True))
    if apart:
        on = np.flatnonzero(more[0][:-1] & (start[1:] % _STRETCH == 0) & (start[1:] > 0) & (doc[1:] == doc[:-1]) & (value[1:] == value[:-1]))
        n[on] += n[on + 1]
        value, doc, start, n = (np.delete(c, on + 1) for c in (value, doc, start, n))
    return mix(value), doc, start, n  # the least of many hashes is small; mixed, it is dealt out evenly


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pack48(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack48(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _batches(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[list[list]]:
    """Columns of the rows of about ``BATCH_BYTES`` of text each; texts as bytes, null as none."""
    held: list[list] = []
    size = 0
    for b in batches:
        columns = [c.cast(pa.binary()).to_pylist() if i == text_at else c.to_pylist() for i, c in enumerate(b.columns)]
        for row in zip(*columns, strict=True):
            row = list(row)
            row[text_at] = row[text_at] or b""
            held.append(row)
            size += len(row[text_at])
            if size >= BATCH_BYTES or len(held) == _MOST:
                yield [list(c) for c in zip(*held, strict=True)]
                held, size = [], 0
    if held:
        yield [list(c) for c in zip(*held, strict=True)]


_ROWS = pa.schema([("bucket", pa.int32()), ("th", pa.binary()), ("data", pa.binary())])
_ROWS_DDL = "bucket int, th binary, data binary"
#: A text's digest, in an array; the most texts of a batch, and the most anchors of an entry for a text.
_NAME = np.dtype("V16")
_MOST = (1 << 16) - 1


def _names(ths: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(ths), _NAME)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)], schema=_ROWS)


def _by_owner(owner: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(owner, kind="stable")
    o, v = owner[order], values[order]
    cuts = np.flatnonzero(np.diff(o)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(o)], strict=True):
        if b > a:
            yield int(o[a]), v[a:b]


#: What batches tell buckets (anchors), and what comes back to them: which anchors are shared, and their texts' names.
_ANCHORS, _REPLY, _TEXTS = range(3)
_TOLD = pa.schema([("bucket", pa.int32()), ("batch", pa.binary()), ("kind", pa.int32()), ("data", pa.binary())])
_TOLD_DDL = "bucket int, batch binary, kind int, data binary"


def _told(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TOLD, strict=True)], schema=_TOLD)


def _pack_entries(owner: np.ndarray, keys: np.ndarray) -> bytes:
    """Keys by their owner, the place of a text in its batch; owners are in order."""
    who, counts = np.unique(owner, return_counts=True)
    fits = -(-counts // _MOST)  # an owner of more keys has several entries
    who, left = np.repeat(who, fits), np.full(fits.sum(), _MOST)
    left[np.cumsum(fits) - 1] = counts - (fits - 1) * _MOST
    return np.array([len(who)], "<u4").tobytes() + who.astype("<u2").tobytes() + left.astype("<u2").tobytes() + _pack48(keys)


def _unpack_entries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(owner of each key, keys); further keys have none (-1)."""
    n = int(np.frombuffer(data, "<u4", 1)[0])
    owner = np.repeat(np.frombuffer(data, "<u2", n, 4).astype(np.int64), np.frombuffer(data, "<u2", n, 4 + 2 * n))
    keys = _unpack48(data[4 + 4 * n :])
    return np.r_[owner, np.full(len(keys) - len(owner), -1)], keys


def _tell_anchors(buckets: int, every: bool = False):
    """(th, k, text), a th once -> for each bucket, which texts of the batch have which anchors; anchors that texts
    of the batch share come back to it at once, and go to the bucket without an owner.

    A batch's name is a digest of its texts' names.  With ``every``, rows are (th, copies, text), and anchors that
    a text has twice, or that a text of several copies has, are shared too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ths, copies, texts in _batches(batches, 2):
            value, doc, _, _ = anchor_runs(texts, every)
            order = np.lexsort((doc, value))
            value, doc = value[order], doc[order]
            first = np.ones(len(value), bool)
            first[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
            times = np.diff(np.r_[np.flatnonzero(first), len(value)])
            value, doc = value[first], doc[first]
            if not len(value):
                continue
            starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
            n = np.diff(np.r_[starts, len(value)])
            common = n > 1
            if every:
                common |= np.add.reduceat(times * np.array(copies, np.int64)[doc], starts) > 1
            many = np.repeat(common, n)
            names = b"".join(ths)
            batch = hashlib.blake2b(names, digest_size=16).digest()
            home = int.from_bytes(batch[:8], "little") % buckets
            rows = [(home, batch, _TEXTS, names)]
            back = np.argsort(doc[many], kind="stable")
            rows.append((home, batch, _REPLY, _pack_entries(doc[many][back], value[many][back])))
            one, one_doc, shared = value[~many], doc[~many], value[starts[common]]
            to, to_shared = _bucket(one, buckets), _bucket(shared, buckets)
            order = np.lexsort((one_doc, to))
            one, one_doc, to = one[order], one_doc[order], to[order]
            for b in np.unique(np.r_[to, to_shared]):
                lo, hi = np.searchsorted(to, b), np.searchsorted(to, b, side="right")
                rows.append((int(b), batch, _ANCHORS, _pack_entries(one_doc[lo:hi], one[lo:hi]) + _pack48(shared[to_shared == b])))
            yield _told(rows)

    return run


def _share_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tells each batch which of its texts' anchors other texts have.

    A task holds its anchors as they came, six bytes each, and looks through a range of them at a time.
    """
    sent: list[tuple[bytes, bytes]] = []
    total = 0
    for b in batches:
        passed = []
        for bucket, batch, kind, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if kind == _ANCHORS:
                sent.append((batch, data))
                total += len(data) // 6
            else:
                passed.append((bucket, batch, kind, data))
        if passed:
            yield _told(passed)
    slices = -(-total // ANCHORS_AT_A_TIME)
    for part in range(slices):
        lo, hi = (np.uint64((i << 48) // slices) for i in (part, part + 1))
        keys, owners = [], []
        for i, (_, data) in enumerate(sent):
            o, k = _unpack_entries(data)
            here = (k >= lo) & (k < hi)
            keys.append(k[here])
            owners.append(np.where(o >= 0, o + (i << 16), -1)[here])
        key, owner = np.concatenate(keys), np.concatenate(owners)
        del keys, owners
        if not len(key):
            continue
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        differ = np.r_[False, (key[1:] == key[:-1]) & (owner[1:] != owner[:-1])] | (owner < 0)
        hit = np.repeat(np.logical_or.reduceat(differ, starts), np.diff(np.r_[starts, len(key)])) & (owner >= 0)
        if not hit.any():
            continue
        key, owner = key[hit], owner[hit]
        order = np.argsort(owner, kind="stable")
        key, owner = key[order], owner[order]
        cuts = np.flatnonzero(np.r_[True, owner[1:] >> 16 != owner[:-1] >> 16])
        rows = [(0, sent[owner[a] >> 16][0], _REPLY, _pack_entries(owner[a:e] & 0xFFFF, key[a:e])) for a, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(owner)], strict=True)]
        yield _told(rows)


def _deliver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kinds, data) of all that came back to a batch -> (th, keys) of its texts with shared anchors."""
    for b in batches:
        for kinds, datas in zip(*(c.to_pylist() for c in b.columns), strict=True):
            names = datas[kinds.index(_TEXTS)]
            owner, keys = (np.concatenate(x) for x in zip(*[_unpack_entries(d) for k, d in zip(kinds, datas, strict=True) if k == _REPLY], strict=True))
            found = [(names[16 * i : 16 * i + 16], _pack48(np.unique(k))) for i, k in _by_owner(owner, keys)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found, strict=True)], names=["th", "keys"])


def _cut_pieces(buckets: int, every: bool = False):
    """(k, th, keys, text) -> pieces under shared anchors, dealt out by anchor; a piece that an earlier
    document of the batch holds too is a removed span already (th set), unless ``every`` one is to be sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ks, ths, keys, texts in _batches(batches, 3):
            names = _names(ths)
            value, doc, start, n = anchor_runs(texts, every)
            mark = lambda d, k: k ^ ((d.astype(np.uint64) + np.uint64(1)) * _C1)
            known = [_unpack48(x) for x in keys]
            table = np.sort(mark(np.repeat(np.arange(len(known)), [len(x) for x in known]), np.concatenate(known)))
            want = mark(doc, value & _LOW48)
            at = np.minimum(np.searchsorted(table, want), len(table) - 1)
            hit = table[at] == want if len(table) else np.zeros(len(want), bool)
            value, doc, start, n = value[hit], doc[hit], start[hit], n[hit]
            bucket = _bucket(value, buckets)
            pieces = [texts[d][s : s + m + LENGTH - 1] for d, s, m in zip(doc.tolist(), start.tolist(), n.tolist(), strict=True)]
            first: dict[bytes, int] = {}
            k_of = np.array(ks, np.int64)[doc] if len(doc) else np.zeros(0, np.int64)
            later = np.zeros(len(pieces), bool)
            if not every:
                for i, (p, k) in enumerate(zip(pieces, k_of.tolist(), strict=True)):
                    j = first.setdefault(p, i)
                    if k < k_of[j]:
                        first[p] = i
                later = np.array([k > k_of[first[p]] for p, k in zip(pieces, k_of.tolist(), strict=True)], bool)
            rows = []
            spans = np.stack([start, start + n + LENGTH - 1], 1)
            for d, s in _by_owner(doc[later], np.flatnonzero(later)):
                rows.append((d % buckets, ths[d], union(spans[s]).astype("<i8").tobytes()))
            for b, i in _by_owner(bucket[~later], np.flatnonzero(~later)):
                mine = [pieces[j] for j in i.tolist()]
                head = np.array([len(i)], "<u4").tobytes() + np.array([len(p) for p in mine], np.uint8).tobytes()
                rows.append((b, None, head + k_of[i].astype("<i8").tobytes() + names[doc[i]].tobytes() + start[i].astype("<u4").tobytes() + b"".join(mine)))
            if rows:
                yield _rows(rows)

    return run


def union(spans: np.ndarray) -> np.ndarray:
    """The spans (start, end), sorted, with those that touch or overlap joined."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > reach[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]
    return np.stack([spans[new, 0], reach[last]], 1)


def suffix_array(pieces: list[bytes], least: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, common, left): the suffixes of at least ``least`` bytes that have their first ``least``
    bytes in common with another, in order; ``common[i]`` is what i shares with i - 1; ``left`` is the byte
    before, or a value of its own at a piece's start."""
    lens = np.array([len(p) for p in pieces], np.int64)
    starts = np.cumsum(lens) - lens
    counts = np.maximum(lens - least + 1, 0)
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), counts)
    offset = (np.arange(len(piece), dtype=np.int32) - np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)).astype(np.int32)
    longest = int(lens.max(initial=0))
    data = np.frombuffer(b"".join(pieces) + bytes(longest + 16), np.uint8)
    words = np.ndarray((len(data) - 7,), ">u8", buffer=data, strides=(1,))

    def word(at: np.ndarray, rest: np.ndarray, i: int) -> np.ndarray:
        valid = np.clip(rest - 8 * i, 0, 8)
        w = words[np.minimum(at + 8 * i, len(words) - 1)].astype(np.uint64)
        shift = (8 * (8 - valid)).astype(np.uint64)
        return np.where(valid > 0, w >> np.minimum(shift, np.uint64(63)) << np.minimum(shift, np.uint64(63)), np.uint64(0))

    at = starts[piece] + offset
    key = np.zeros(len(at), np.uint64)  # of the first bytes; suffixes alone with theirs are left out
    full = np.full(len(at), least, np.int16)
    for i in range(-(-least // 8)):
        key = (key ^ word(at, full, i)) * _C2
        key ^= key >> np.uint64(31)
    s = np.sort(key)
    again = np.unique(s[1:][s[1:] == s[:-1]])
    keep = np.flatnonzero(np.isin(key, again, kind="sort")) if len(again) else np.zeros(0, np.int64)
    del key, s, again, full
    piece, offset, at = piece[keep].astype(np.int64), offset[keep].astype(np.int64), at[keep]
    rest = lens[piece] - offset
    n_words = -(-longest // 8)
    columns = [word(at, rest, i) for i in range(n_words)]
    order = np.lexsort([rest, *columns[::-1]])
    piece, offset, at, rest = piece[order], offset[order], at[order], rest[order]
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        same = np.ones(len(order) - 1, bool)
        for c in columns:
            c = c[order]
            x = c[1:] ^ c[:-1]
            add = np.where(x == 0, 8, 0)
            odd = np.flatnonzero(same & (x != 0))
            lead = np.zeros(len(odd), np.int64)
            for byte in range(7):
                lead += (x[odd] >> np.uint64(8 * (7 - byte))) == 0
            add[odd] = lead
            common[1:] += np.where(same, add, 0)
            same &= x == 0
        common[1:] = np.minimum(common[1:], np.minimum(rest[1:], rest[:-1]))
    left = np.where(offset > 0, data[np.maximum(at - 1, 0)].astype(np.int64), -1 - np.arange(len(at)))
    return piece, offset, common, left


def repeat_groups(common: np.ndarray, left: np.ndarray, least: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, first, last): the intervals of the array that share ``length`` bytes, ``least`` or more, and no
    more, and whose left neighbours are not all the same: the maximal repeats with all their occurrences.

    A scan with a stack of open intervals; each closes where the common length falls below its own.
    """
    lengths, firsts, lasts = [], [], []
    stack: list[tuple[int, int]] = []
    for i, c in enumerate([*common.tolist()[1:], 0], 1):
        first = i - 1
        while stack and stack[-1][0] > c:
            length, first = stack.pop()
            lengths.append(length)
            firsts.append(first)
            lasts.append(i - 1)
        if c >= least and (not stack or stack[-1][0] < c):
            stack.append((c, first))
    length, lo, hi = (np.array(x, np.int64) for x in (lengths, firsts, lasts))
    changes = np.cumsum(np.r_[0, left[1:] != left[:-1]])
    diverse = changes[hi] > changes[lo] if len(lo) else np.zeros(0, bool)
    return length[diverse], lo[diverse], hi[diverse]


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """Rows sorted by bucket -> (rows with a th, which pass by; the piece data of one bucket)."""
    current, held = None, []
    for b in batches:
        passed = []
        for bucket, th, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if th is not None:
                passed.append((bucket, th, data))
                continue
            if bucket != current and held:
                yield [], held
                held = []
            current = bucket
            held.append(data)
        if passed:
            yield passed, []
    if held:
        yield [], held


def _gather(blobs: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different pieces, and of each occurrence its piece, k, th and start."""
    index: dict[bytes, int] = {}
    ids, ks, ths, starts = [], [], [], []
    for data in blobs:
        n = int(np.frombuffer(data, "<u4", 1)[0])
        ends = np.cumsum(np.frombuffer(data, np.uint8, n, 4), dtype=np.int64) + 4 + 29 * n
        ks.append(np.frombuffer(data, "<i8", n, 4 + n))
        ths.append(np.frombuffer(data, _NAME, n, 4 + 9 * n))
        starts.append(np.frombuffer(data, "<u4", n, 4 + 25 * n).astype(np.int64))
        at = 4 + 29 * n
        for e in ends.tolist():
            ids.append(index.setdefault(data[at:e], len(index)))
            at = e
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return list(index), np.array(ids, np.int64), join(ks), join(ths), join(starts)


def _find_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces -> (th, removed spans), by the repeat groups of each bucket's suffix array."""
    for passed, blobs in _by_bucket(batches):
        if passed:
            yield _rows(passed)
        if blobs:
            yield from _spans_of(blobs)


def _spans_of(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    pieces, ids, ks, ths, starts = _gather(blobs)
    lens = np.array([len(p) for p in pieces], np.int64)
    least_k = np.full(len(pieces), np.iinfo(np.int64).max)
    np.minimum.at(least_k, ids, ks)
    # a piece is a repeat group of its own occurrences: those in later documents go whole
    later = ks > least_k[ids]
    found_th, found = [ths[later]], [np.stack([starts[later], starts[later] + lens[ids[later]]], 1)]
    piece, offset, common, left = suffix_array(pieces)
    length, lo, hi = repeat_groups(common, left)
    if len(length):
        leaf_k = least_k[piece]
        low = np.minimum.reduceat(np.r_[leaf_k, 0], np.stack([lo, hi + 1], 1).ravel())[::2]
        size = hi - lo + 1
        leaf = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        gone = leaf_k[leaf] > np.repeat(low, size)
        of, a, b = piece[leaf[gone]], offset[leaf[gone]], (offset[leaf] + np.repeat(length, size))[gone]
        order = np.argsort(of, kind="stable")
        of, a, b = of[order], a[order], b[order]
        # their occurrences in the piece's first document (later ones are gone whole)
        occ = np.flatnonzero(~later)
        occ = occ[np.argsort(ids[occ], kind="stable")]
        s, e = np.searchsorted(of, ids[occ]), np.searchsorted(of, ids[occ], side="right")
        n = e - s
        span = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        o = np.repeat(occ, n)
        found_th.append(ths[o])
        found.append(np.stack([starts[o] + a[span], starts[o] + b[span]], 1))
    spans = np.concatenate(found)
    which: dict[bytes, int] = {}
    data = np.concatenate(found_th).tobytes()
    owner = np.array([which.setdefault(data[i : i + 16], len(which)) for i in range(0, len(data), 16)], np.int64)
    names, rows = list(which), []
    for t, i in _by_owner(owner, np.arange(len(owner))):
        rows.append((0, names[t], union(spans[i]).astype("<i8").tobytes()))
        if len(rows) >= 5000:
            yield _rows(rows)
            rows = []
    if rows:
        yield _rows(rows)


def _find_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, blobs in _by_bucket(batches):
        if blobs:
            yield from _groups_of(blobs)


def _groups_of(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    pieces, ids, ks, _, starts = _gather(blobs)
    order = np.argsort(ids, kind="stable")
    ids, ks, starts = ids[order], ks[order], starts[order]
    at = np.searchsorted(ids, np.arange(len(pieces) + 1))
    piece, offset, common, left = suffix_array(pieces)
    intervals = [(n, piece[a : b + 1], offset[a : b + 1]) for n, a, b in zip(*(x.tolist() for x in repeat_groups(common, left)), strict=True)]
    # a piece is a group of its own occurrences, unless an interval holds it with those inside other pieces
    lens = np.array([len(p) for p in pieces], np.int64)
    alone = np.diff(at) > 1
    for n, p, o in intervals:
        alone[p[(o == 0) & (lens[p] == n)]] = False
    zero = np.zeros(1, np.int64)
    intervals += [(int(lens[p]), np.array([p]), zero) for p in np.flatnonzero(alone).tolist()]
    texts, sizes, doc, start, held = [], [], [], [], 0
    for n, p, o in intervals:
        size = at[p + 1] - at[p]
        i = np.repeat(at[p], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        k, s = ks[i], starts[i] + np.repeat(o, size)
        order = np.lexsort((s, k))
        texts.append(pieces[p[0]][o[0] : o[0] + n])
        sizes.append(len(i))
        doc.append(k[order])
        start.append(s[order])
        held += len(i)
        if held >= 1 << 16:
            yield _group_rows(texts, sizes, doc, start)
            texts, sizes, doc, start, held = [], [], [], [], 0
    if texts:
        yield _group_rows(texts, sizes, doc, start)


def _group_rows(texts: list[bytes], sizes: list[int], doc: list[np.ndarray], start: list[np.ndarray]) -> pa.RecordBatch:
    places = pa.StructArray.from_arrays([pa.array(np.concatenate(doc), pa.int64()), pa.array(np.concatenate(start), pa.int64())], names=["doc_id", "start"])
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), places)], names=["bytes", "occurrences"])


def _texts(docs: DataFrame, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (k, th, text): a null doc_id comes after all others, null text is empty; and the different texts
    with their first k and, with ``every``, their number of rows."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("k"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", digest(F.col("text")))
    counts = [F.count(F.lit(1)).alias("copies")] if every else []
    return rows, rows.groupBy("th").agg(F.min("k").alias("k"), F.first("text").alias("text"), *counts)


def _pieces(rows: DataFrame, texts: DataFrame, every: bool = False) -> DataFrame:
    """Pieces by bucket, with what is removed already; with ``every``, the pieces of all rows and no more."""
    width = shuffle_width(rows.sparkSession)
    told = texts.select("th", "copies" if every else "k", "text").mapInArrow(_tell_anchors(width, every), _TOLD_DDL)
    back = told.repartitionById(width, F.col("bucket")).mapInArrow(_share_anchors, _TOLD_DDL)
    gathered = back.groupBy("batch").agg(F.collect_list(F.struct("kind", "data")).alias("x")).select("x.kind", "x.data")
    shared = gathered.mapInArrow(_deliver, "th binary, keys binary")
    cut = (rows if every else texts).join(shared, "th").select("k", "th", "keys", "text").mapInArrow(_cut_pieces(width * ARRAYS_PER_TASK, every), _ROWS_DDL)
    return cut.repartitionById(width, F.pmod("bucket", F.lit(width))).sortWithinPartitions("bucket")


def repeats(docs: DataFrame) -> DataFrame:
    """The maximal repeat groups: ``bytes`` and ``occurrences``, (doc_id, start) of all places in all rows
    where these bytes are, two at least, those within one document and in equal texts and rows included; a
    null doc_id is 2^63 - 1.

    Groups are of 50 to 84 bytes, maximal among those whose windows have one place as their anchor: a longer
    repeat comes as a row of overlapping groups, which hold each of its 50-byte strings.  How rows are batched
    and dealt out makes no difference.  A row holds a group's occurrences, which one task gathers.
    """
    rows, texts = _texts(docs, every=True)
    return _pieces(rows, texts, every=True).mapInArrow(_find_groups, "bytes binary, occurrences array<struct<doc_id:bigint,start:bigint>>")


_CLEAN = "th binary, k0 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _apply(keep_bytes: bool):
    names = [f.split()[0] for f in _CLEAN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for th, k, spans, texts in _batches(batches, 3):
            out: list[list] = [[], [], [], [], []]
            for s, t in zip(spans, texts, strict=True):
                gone = union(np.frombuffer(b"".join(s or []), "<i8").reshape(-1, 2))
                kept, at = [], 0
                for a, b in gone.tolist():
                    kept.append(t[at:a])
                    at = b
                kept = b"".join([*kept, t[at:]]) if len(gone) else t
                for c, v in zip(out, (len(t), len(t) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None), strict=True):
                    c.append(v)
            kinds = [pa.binary(), *[pa.int64()] * 4, pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([th, k, *out], kinds, strict=True)], names=names)

    return run


def remove_repeats(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept`` (binary).

    Repeated rows have the same result, for equal doc_ids are not smaller than each other; a null doc_id is
    larger than any other.  Null text is empty.  Texts shorter than 50 bytes stay whole.
    """
    rows, texts = _texts(docs)
    spans = _pieces(rows, texts).mapInArrow(_find_spans, _ROWS_DDL).groupBy("th").agg(F.collect_list("data").alias("spans"))
    clean = texts.join(spans, "th", "left").select("th", "k", "spans", "text").mapInArrow(_apply(with_bytes), _CLEAN)
    own = rows.select(F.col("k"), F.col("th").alias("t"))
    joined = own.join(clean, F.col("t") == F.col("th"))
    copy = (F.col("k") > F.col("k0")) & (F.col("n_bytes") >= LENGTH)
    out = joined.select(
        F.nullif("k", F.lit((1 << 63) - 1)).alias("doc_id"), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )
    return out if with_bytes else out.drop("kept")
