"""Quality rules: base counts, and logistic regression over hashed word and character n-grams.

The model is trained on labelled rows (quality 0 or 1) and calibrated on a part of them kept apart; documents
are then scored in Arrow batches and kept from a fixed probability on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm import textkernel as tk
from tabulon.llm.common import give_back, without

#: Bound on the labelled rows that are fitted on; which ones follows from a hash of doc_id.
TRAIN_ROWS = 2000
#: Part of them that only calibrates.
HELD_OUT = 4  # one in four
BUCKETS = 1 << 16
WORD_GRAMS, CHAR_GRAMS = (1, 2), (3, 4)
#: Least calibrated probability of good quality for a document to stay.
KEEP_FROM = 0.5
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
#: N-grams of fewer training texts get no weight; the ridge; steps of the optimizer at most.
LEAST_TEXTS, L2, STEPS = 3, 1e-3, 60

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Hash of every pair of a word and the same word again: which word it is says less than that it is.
_TWICE = np.uint64(0x1B873593CC9E2D51)
_SYMBOLS = np.zeros(128, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _repeats(text: str) -> tuple[int, int]:
    """n_dup_lines and n_repeat_words of one text, by comparing the lines and windows themselves."""
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            dup += line in seen
            seen.add(line)
    words = _WORD.findall(text)
    number: dict[str, int] = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    first: dict[tuple, int] = {}
    cover = bytearray(len(ids))
    for i in range(len(ids) - REPEAT_WINDOW + 1):
        j = first.setdefault(tuple(ids[i : i + REPEAT_WINDOW]), i)
        if j != i:
            cover[i : i + REPEAT_WINDOW] = cover[j : j + REPEAT_WINDOW] = b"\1" * REPEAT_WINDOW
    return dup, sum(cover)


def base_counts(t: tk.Texts, words=None) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text.

    Lines and windows of equal hash are compared code point by code point; a text in which two differ after all
    is counted again without hashes.
    """
    blank = t.blank()
    starts, ends, owner = words or t.words()
    n = t.n
    symbol = (t.data < 128) & _SYMBOLS[np.minimum(t.data, 127)]
    # lines with a word: maximal runs between newlines, whose first differs from no earlier one
    ls, le, lo = t.runs(t.data != 10)
    c = np.zeros(len(blank) + 1, np.int64)
    np.cumsum(~blank, out=c[1:])
    worded = c[le] > c[ls]
    ls, le, lo = ls[worded], le[worded], lo[worded]
    keys = tk.owned(t.hashes(ls, le), lo)
    model = tk.first_equal(keys)
    dup = model < np.arange(len(keys))
    wrong = lo[dup][~t.same(ls[dup], le[dup], ls[model[dup]], le[model[dup]])]
    hashes = t.hashes(starts, ends)
    wh, at = tk.windows(hashes, owner, REPEAT_WINDOW)
    keys = tk.owned(wh, owner[at])
    again = tk.twice(keys)
    at, keys = at[again], keys[again]
    pairs = np.stack([at, at[tk.first_equal(keys)]]) if len(at) else np.zeros((2, 0), np.int64)
    pairs = (pairs[:, pairs[0] != pairs[1], None] + np.arange(REPEAT_WINDOW)).reshape(2, -1)
    pairs = np.unique(pairs[0] * (len(starts) + 1) + pairs[1])
    a, b = pairs // (len(starts) + 1), pairs % (len(starts) + 1)
    wrong = np.union1d(wrong, owner[a[~t.same(starts[a], ends[a], starts[b], ends[b])]])
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + REPEAT_WINDOW, -1)
    repeated = np.cumsum(cover)[:-1] > 0
    n_dup, n_repeat = np.bincount(lo[dup], minlength=n), np.bincount(owner[repeated], minlength=n)
    for i in wrong.tolist():
        n_dup[i], n_repeat[i] = _repeats(t.text(i))
    return {
        "n_words": np.bincount(owner, minlength=n), "word_chars": t.per_text(~blank), "n_symbols": t.per_text(symbol),
        "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
    }


def features(t: tk.Texts, words=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text index) of the n-grams, one family at a time; families have buckets of their own."""
    starts, ends, owner = words or t.words()
    hashes = t.hashes(starts, ends)
    shift = np.uint64(64 - 16)
    family = 0
    for k in WORD_GRAMS:
        h, at = tk.windows(hashes, owner, k)
        if k == 2:
            h = np.where(hashes[at] == hashes[at + 1], _TWICE, h)
        yield (h >> shift).astype(np.int32) + family * BUCKETS, owner[at]
        family += 1
    chars = t.data.astype(np.uint64) + np.uint64(1)
    chars *= np.uint64(0xD6E8FEB86659FD93)
    chars ^= chars >> np.uint64(32)
    who = np.repeat(np.arange(t.n, dtype=np.int32), np.diff(t.offsets))
    for k in CHAR_GRAMS:
        h, at = tk.windows(chars, who, k)
        yield (h >> shift).astype(np.int32) + family * BUCKETS, who[at]
        family += 1


N_FAMILIES = len(WORD_GRAMS) + len(CHAR_GRAMS)


def margins(t: tk.Texts, weights: np.ndarray, words=None) -> np.ndarray:
    """The sum over families of the mean weight of a text's n-grams (without the intercept)."""
    out = np.zeros(t.n)
    for bucket, owner in features(t, words):
        total = np.bincount(owner, weights[bucket], minlength=t.n)
        out += total / np.maximum(np.bincount(owner, minlength=t.n), 1)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(texts: list[str], good: np.ndarray) -> np.ndarray:
    """The model: weights of all buckets, then intercept, slope and shift of the calibration.

    Every fourth text calibrates (by Platt's method), the others train.  Where either part lacks a class the
    model is constant: the smoothed share of good rows.
    """
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # text, bucket and weight of the n-grams, never put together: what is worked out of them is of a part's size
    for at, run in tk.grouped(texts):
        t = tk.Texts(run)
        for bucket, owner in features(t):
            key, n = np.unique(owner.astype(np.int64) * (N_FAMILIES * BUCKETS) + bucket, return_counts=True)
            who = key // (N_FAMILIES * BUCKETS)
            share = n / np.maximum(np.bincount(owner, minlength=t.n), 1)[who]
            parts.append(((who + at).astype(np.int32), (key % (N_FAMILIES * BUCKETS)).astype(np.int32), share.astype(np.float32)))
    y = np.asarray(good, float)
    held = np.arange(len(y)) % HELD_OUT == HELD_OUT - 1
    size = N_FAMILIES * BUCKETS
    flat = np.zeros(size + 3, np.float64)
    flat[size + 1] = 1.0
    if not len(y) or any(len(set(y[part])) < 2 for part in (held, ~held)):
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.999
        flat[size] = np.log(p / (1 - p)) if not len(y) or 0 < y.mean() < 1 else (6.9 if y.mean() else -6.9)
        return flat
    texts_of = np.zeros(size, np.int64)
    for r, c, _ in parts:
        texts_of += np.bincount(c[~held[r]], minlength=size)
    often = texts_of >= LEAST_TEXTS
    used = np.flatnonzero(often)
    if len(used):
        place = np.zeros(size, np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        n, among = int((~held).sum()), (np.cumsum(~held) - 1).astype(np.int32)
        learning = [(among[r[m]], place[c[m]], v[m]) for r, c, v in parts if (m := ~held[r] & often[c]).any()]
        squares = np.zeros(len(used))
        for _, c, v in learning:
            squares += np.bincount(c, v.astype(float) ** 2, minlength=len(used))
        scale = (squares / n) ** -0.25  # rare n-grams are raised, to half of what would even them out
        scale /= np.sqrt((squares * scale**2).sum() / n)
        w = _ridge(learning, scale, y[~held])
        flat[used], flat[size] = w[:-1] * scale, w[-1]
    z = sum(np.bincount(r, v * flat[c], minlength=len(y)) for r, c, v in parts) + flat[size]
    flat[size + 1 :] = _platt(z[held], y[held])
    return flat


def _regress(r: np.ndarray, c: np.ndarray, x: np.ndarray, y: np.ndarray, n_columns: int) -> np.ndarray:
    return _ridge([(r, c, x)], np.ones(n_columns), y)


def _ridge(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], scale: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept of ridge logistic regression on the sparse rows (r, c, x * scale[c]), given in parts,
    either class weighing half; by limited-memory quasi-Newton steps with halving."""
    n_columns = len(scale)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        scaled, z, g = w[:-1] * scale, np.full(len(y), w[-1]), np.zeros(n_columns)
        for r, c, x in parts:
            z += np.bincount(r, x * scaled[c], minlength=len(y))
        d = weight * (_sigmoid(z) - y)
        for r, c, x in parts:
            g += np.bincount(c, x * d[r], minlength=n_columns)
        value = float((weight * (np.logaddexp(0, z) - y * z)).sum() + L2 / 2 * (w[:-1] @ w[:-1]))
        return value, np.append(g * scale + L2 * w[:-1], d.sum())

    w = np.zeros(n_columns + 1)
    value, g = loss(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        d, back = -g, []
        for s, t in reversed(moves):
            back.append((s @ d) / (s @ t))
            d = d - back[-1] * t
        if moves:
            s, t = moves[-1]
            d = d * ((s @ t) / (t @ t))
        for (s, t), a in zip(moves, reversed(back), strict=True):
            d = d + s * (a - (t @ d) / (s @ t))
        step, slope = 1.0, float(g @ d)
        while step > 1e-9 and (new := loss(w + step * d))[0] > value + 1e-4 * step * slope:
            step /= 2
        if step <= 1e-9:
            break
        s, t = step * d, new[1] - g
        if s @ t > 1e-12:
            moves = [*moves[-7:], (s, t)]
        gain, w, (value, g) = value - new[0], w + s, new
        if gain < 1e-7 * value:
            break
    return w


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, label), by Newton steps on smoothed targets."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ beta)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-3 * (beta - [1.0, 0.0]))
        beta = beta - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return float(max(beta[0], 1e-3)), float(beta[1])


def probabilities(t: tk.Texts, model: np.ndarray, words=None) -> np.ndarray:
    size = N_FAMILIES * BUCKETS
    b, slope, shift = model[size:]
    return _sigmoid(slope * (margins(t, model[:size], words) + b) + shift)


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> np.ndarray:
    """Fits on at most ``limit`` labelled documents, in one task; null text counts as empty.

    A document labelled more than once counts with its least quality, and a doc_id of several texts with the
    least of them, so ``limit`` bounds the rows that the task gets; labels that are null or of no document count
    for nothing.
    """
    one = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = one.orderBy(F.xxhash64("doc_id", F.lit("train")), "doc_id").limit(limit)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).withColumn("h", F.xxhash64("doc_id", F.lit("train")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        model = fit([t for t, _ in got], np.array([q for _, q in got]))
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model.astype("<f8").tobytes()], pa.binary())], names=["model"])

    fitted = rows.repartition(1).sortWithinPartitions("h", "doc_id").select("text", "quality").mapInArrow(run, "model binary")
    got = fitted.collect()
    return np.frombuffer(got[0]["model"], "<f8") if got else fit([], np.zeros(0))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def score(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents with their base counts (long), ``base_failed``, ``p_quality`` and ``kept``.

    Null text has no words, so it fails the base rules, as does any text of fewer than 20.  Rows are judged one
    by one: repeated rows alike, other columns pass through, but for those that have a result's name: the
    result takes their place.
    """
    spark = docs.sparkSession
    docs = without(docs, [*COUNTS, "p_quality", "base_failed", "kept"])
    model = spark.sparkContext.broadcast(train(docs, labels).astype(np.float32))
    fields = docs.schema.fields
    text_at = [f.name for f in fields].index("text")
    names = [f.name for f in fields] + [*COUNTS, "p_quality"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for batch in batches:
            parts: dict[str, list] = {k: [] for k in [*COUNTS, "p_quality"]}
            for _, texts in tk.grouped(batch.column(text_at).to_pylist()):
                t = tk.Texts(texts)
                words = t.words()
                for k, v in base_counts(t, words).items():
                    parts[k].append(v)
                parts["p_quality"].append(probabilities(t, weights, words))
            made = [pa.array(np.concatenate(parts[k]) if parts[k] else [], pa.float64() if k == "p_quality" else pa.int64()) for k in parts]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)
        give_back()

    schema = T.StructType([*fields, *[T.StructField(k, T.LongType()) for k in COUNTS], T.StructField("p_quality", T.DoubleType())])
    out = docs.mapInArrow(run, schema)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("p_quality") >= keep_from))
