"""Merkle fingerprints of documents.

A text is cut, without loss, into sentences (the leaves), paragraphs (up to a newline) and sections (up to a
blank line, or after a paragraph whose digest ends in three zero bits, so that sections stay short).  A long
stretch without a stop is cut where a hash of the last characters says so.  All cuts follow from the text around
them, so they move with it.  Digests go up from leaves to paragraphs, sections and the root; roots are equal for
equal texts only.  The fingerprint carries the root, every section's, paragraph's and leaf's digest, cut to six
bytes, and the leaves' lengths.  Two trees are compared from the root down: children are aligned by their digests,
equal branches are passed over, and only branches that face each other are descended into.  That names the
stretches that differ, and the share of the text outside them is the likeness.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import shuffle_width, without

_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
#: A longer sentence is cut by its content, at one character in 64 or so, of those at the latest.
LONG, FORCED = 160, 256
_REACH = 8  # characters that a cut depends on
_RECORD = struct.Struct("<6sHB")
LEAF, PARAGRAPH, SECTION = 0, 1, 2
_SHORT = 6  # bytes of a digest that are kept

#: A node is (short digest, code points, children); a leaf has no children.
Node = tuple[bytes, int, list]


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _content_cuts(sentence: str) -> list[str]:
    """A long sentence in parts that end where a hash of their last characters, and nothing else, says so."""
    x = np.frombuffer(sentence.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(x) - _REACH + 1, np.uint64)
    for i in range(_REACH):
        h = (h ^ x[i : len(x) - _REACH + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    ends = [*(np.flatnonzero(h & np.uint64(63) == 0) + _REACH).tolist(), len(sentence)]
    out, at = [], 0
    for e in ends:
        while e - at > FORCED:
            out.append(sentence[at : at + FORCED])
            at += FORCED
        if e > at:
            out.append(sentence[at:e])
            at = e
    return out


def leaves(text: str) -> list[str]:
    """The text's leaves in order; end to end they are the text."""
    out: list[str] = []
    for s in _SENTENCE.findall(text):
        if len(s) <= LONG:
            out.append(s)
        else:
            out += _content_cuts(s)
    return out


def tree(text: str | None) -> tuple[str, list[Node]]:
    """The root's digest (32 hex digits) and the sections; null text is empty and has none."""
    new = hashlib.blake2b
    sections, paragraphs, kids = [], [], []
    section_hash, paragraph_hash, root = new(b"s", digest_size=16), new(b"p", digest_size=16), new(b"r", digest_size=16)
    size = 0

    def end_section() -> None:
        nonlocal paragraphs, section_hash
        d = section_hash.digest()
        root.update(d)
        sections.append((d[:_SHORT], sum(p[1] for p in paragraphs), paragraphs))
        paragraphs, section_hash = [], new(b"s", digest_size=16)

    def end_paragraph() -> bytes:
        nonlocal kids, paragraph_hash, size
        d = paragraph_hash.digest()
        section_hash.update(d)
        paragraphs.append((d[:_SHORT], size, kids))
        kids, paragraph_hash, size = [], new(b"p", digest_size=16), 0
        return d

    for leaf in leaves(text or ""):
        d = new(leaf.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        paragraph_hash.update(d)
        kids.append((d[:_SHORT], len(leaf), []))
        size += len(leaf)
        if leaf[-1] == "\n" and (end_paragraph()[-1] & 7 == 0 or leaf.endswith("\n\n")):
            end_section()
    if kids:
        end_paragraph()
    if paragraphs:
        end_section()
    return root.hexdigest(), sections


def encode(root: str, sections: list[Node]) -> str:
    """``root:records``: the leaves' records, each paragraph's and section's after those of its children, in base64."""
    records = []
    for s, _, paragraphs in sections:
        for p, _, kids in paragraphs:
            records += [_RECORD.pack(d, n, LEAF) for d, n, _ in kids]
            records.append(_RECORD.pack(p, 0, PARAGRAPH))
        records.append(_RECORD.pack(s, 0, SECTION))
    return f"{root}:{base64.b64encode(b''.join(records)).decode()}"


def decode(mark: str) -> tuple[str, list[Node]]:
    """What :func:`encode` was given."""
    sections, paragraphs, kids = [], [], []
    root, _, records = mark.partition(":")
    for d, n, kind in _RECORD.iter_unpack(base64.b64decode(records)):
        if kind == LEAF:
            kids.append((d, n, []))
        elif kind == PARAGRAPH:
            paragraphs.append((d, sum(k[1] for k in kids), kids))
            kids = []
        else:
            sections.append((d, sum(p[1] for p in paragraphs), paragraphs))
            paragraphs = []
    return root, sections


def fingerprint(text: str | None) -> str:
    """The text's tree as a string, equal for equal texts; null text has that of the empty one."""
    return encode(*tree(text))


def _aligned(x: list[Node], y: list[Node]) -> list[tuple[int, int]]:
    """Places of equal branches in both lists, rising in both.

    The n-th branch of a digest faces the n-th of the same digest, and of these pairs the longest rising chain
    stays: it takes n log n steps however often a branch repeats.
    """
    places: dict[bytes, list[int]] = {}
    for j in range(len(y) - 1, -1, -1):
        places.setdefault(y[j][0], []).append(j)
    pairs = [(i, places[n[0]].pop()) for i, n in enumerate(x) if places.get(n[0])]
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for p, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        before[p] = at[k - 1] if k else -1
        if k == len(tails):
            tails.append(j)
            at.append(p)
        else:
            tails[k], at[k] = j, p
    out, p = [], at[-1] if at else -1
    while p >= 0:
        out.append(pairs[p])
        p = before[p]
    return out[::-1]


def _differences(x: list[Node], y: list[Node], at: int, bt: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, start, end) of the stretches of two lists of branches, which begin at ``at`` and ``bt``, that differ."""
    n = min(len(x), len(y))
    i = 0
    while i < n and x[i][0] == y[i][0]:
        at += x[i][1]
        bt += y[i][1]
        i += 1
    e = 0
    while e < n - i and x[-1 - e][0] == y[-1 - e][0]:
        e += 1
    x, y = x[i : len(x) - e], y[i : len(y) - e]
    i = j = 0
    for p, q in [*_aligned(x, y), (len(x), len(y))]:
        s, t = x[i:p], y[j:q]
        a, b = at + sum(k[1] for k in s), bt + sum(k[1] for k in t)
        if s and t and s[0][2]:
            yield from _differences([c for k in s for c in k[2]], [c for k in t for c in k[2]], at, bt)
        elif s or t:
            yield at, a, bt, b
        if p < len(x):
            a, b = a + x[p][1], b + y[q][1]
        at, bt, i, j = a, b, p + 1, q + 1


def edits_between(a: tuple[str, list[Node]], b: tuple[str, list[Node]]) -> list[tuple[int, int, int, int]]:
    return [] if a[0] == b[0] else list(_differences(a[1], b[1], 0, 0))


def likeness_between(a: tuple[str, list[Node]], b: tuple[str, list[Node]]) -> float:
    if a[0] == b[0]:
        return 1.0
    n = sum(s[1] for s in a[1]) + sum(s[1] for s in b[1])
    return 1.0 - sum(e - s + f - t for s, e, t, f in _differences(a[1], b[1], 0, 0)) / n


def locate_edits(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """(start, end, start, end) of the stretches of a and of b that differ, in code points, in order; what is
    between them is equal.  Equal roots end the search; else each level aligns the branches by their digests and
    descends into those that face each other between equal ones."""
    return edits_between(decode(a), decode(b))


def likeness(a: str, b: str) -> float:
    """Share of the code points of both texts that :func:`locate_edits` finds outside the stretches that differ:
    1 for equal texts, 0 where no leaf of one is in the other.  What is in another order is not alike."""
    return likeness_between(decode(a), decode(b))


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """Adds ``fingerprint`` to the documents, in place of a column of that name; null text has that of the empty
    one, repeated rows have equal ones, an empty table stays empty."""

    @F.pandas_udf("string")
    def mark(text):
        return text.map(fingerprint)

    return without(docs, ["fingerprint"]).withColumn("fingerprint", mark("text"))


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_NEXT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, halo, doc_id, text), in order within each part; a halo row is the next part's first."""
    held = None  # the row that waits for its next: (part, doc_id, text, tree)
    names = [f.split()[0] for f in _NEXT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        rows: list[tuple] = []
        for part, halo, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            if halo and (held is None or held[0] != part):
                continue
            mark = tree(text)
            if held is not None and held[0] == part:
                _, d, t, m = held
                new = edited(t, text)
                new_mark = tree(new)
                rows.append((d, len(t), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), encode(*m), encode(*new_mark), likeness_between(m, new_mark), likeness_between(m, mark)))
            held = None if halo else (part, doc, text, mark)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document (falling doc_id, the
    first after the last): ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Documents are dealt into ranges of doc_id, those of a doc_id that fills several ranges by the hash of their
    text, and each range is sorted on its own; the first document of a range also goes to the range before it.  So
    nothing is sorted whole, and the text is shuffled once.  Null text counts as empty; null doc_ids come last;
    equal doc_ids follow each other by the hash of their text; a single document is its own next; an empty table
    gives none; further columns are ignored.
    """
    spark = docs.sparkSession
    n_parts = shuffle_width(spark)
    low = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("__k", F.coalesce("doc_id", F.lit(low))).withColumn("__t", F.xxhash64(F.coalesce("text", F.lit(""))))
    cuts = rows.agg(F.percentile_approx("__k", [i / n_parts for i in range(1, n_parts)] or [0.5], max(10_000, 10 * n_parts))).first()[0]
    part = _part(np.array(sorted(cuts or [0]), dtype=np.int64))

    rows = rows.withColumn("part", part("__k", "__t"))
    firsts = sorted(rows.groupBy("part").agg(F.min(F.struct(F.bitwise_not("__k").alias("k"), F.col("__t").alias("t"))).alias("first")).collect())
    halo = [(~r["first"]["k"], r["first"]["t"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]  # the first range's goes to the last
    to = spark.createDataFrame(halo, "__hk long, __ht long, __to int")
    dealt = rows.join(F.broadcast(to), (F.col("__k") == F.col("__hk")) & (F.col("__t") == F.col("__ht")), "left")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("halo"))
    also = F.struct(F.col("__to").alias("part"), F.lit(True).alias("halo"))
    dealt = dealt.withColumn("at", F.explode(F.when(F.col("__to").isNull(), F.array(own)).otherwise(F.array(own, also))))
    dealt = dealt.select("at.part", "at.halo", "doc_id", "text", "__k", "__t").repartitionById(2 * n_parts, F.col("part"))
    ordered = dealt.sortWithinPartitions("part", "halo", F.desc("__k"), "__t")
    return ordered.select("part", "halo", "doc_id", "text").mapInArrow(_compare, _NEXT)


def _part(cuts: np.ndarray):
    """Ranges are numbered in falling order of their ids, then rising order of the hash.

    ``cuts`` are quantiles, rising.  A range reaches from one up to the next; an id that is several of them has as
    many ranges of the hash for itself.  There are less than two ranges a cut, and one.
    """
    bounds, times = np.unique(cuts, return_counts=True)
    ranges = np.where(times > 1, times + 1, 1)
    above = 1 + np.r_[np.cumsum(ranges[::-1])[::-1][1:], 0, -1]  # ranges above those of each bound; none above ids beyond all

    @F.pandas_udf("int")
    def part(k, t):
        import pandas as pd

        k, t = k.to_numpy(), t.to_numpy()
        i = np.searchsorted(bounds, k)
        n = np.r_[times, 1][i]
        own = np.r_[bounds, 0][i] == k
        sub = np.minimum(((t.astype(np.float64) + 2.0**63) / 2.0**64 * n).astype(np.int64), n - 1)
        return pd.Series(above[i] + np.where(n == 1, 0, np.where(own, sub, n)), dtype="int32")

    return part
