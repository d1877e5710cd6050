"""Near-duplicate documents by improved consistent weighted sampling.

A text is the weighted set of its five-word shingles, a shingle's weight being its count times a smoothed
and saturated inverse document frequency.  Frequencies are counted over all documents in 2**18 hashed buckets, so their table has
a fixed size.  Each of 36 samples picks one (shingle, quantum) with probabilities such that two texts agree
on it as often as their weighted Jaccard similarity says; three samples make a band, texts that share a band
are candidates, and candidates are verified by their exact weighted Jaccard similarity.

Buckets are compared in blocks of at most 512 texts: a task holds one block and the bucket's first text,
compares what no link connects yet, and sends on only links that connect.  Components of the links are then
labelled.  Texts of buckets of several blocks that are still apart are dealt out a second time, by 36 further
samples: unlike texts that share a common shingle part here, and like ones meet again.  Should a bucket of that
deal be of several blocks and components too, all outside its largest component meet all its blocks.  So two texts that
share a band of the first deal and, if that bucket is large, one of the second are compared or connected, no
pairs are listed, and no bucket, however large, is held by one task.

Texts are told apart by a 128-bit digest; between the steps they go by a number given once and written down.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm import textkernel as tk
from tabulon.llm.common import digest, ensure_checkpoint_dir, shuffle_width

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
BUCKETS = 1 << 18
_BLOCK = 4096
#: Texts of a bucket that meet in one task.
MEET = 512
_TOP = (1 << 63) - 1


def shingles(t: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every shingle; a text of fewer than five words has one, of all its words."""
    starts, ends, owner = t.words()
    hashes = t.hashes(starts, ends)
    h, at = tk.windows(hashes, owner, SHINGLE)
    who = owner[at]
    n = np.bincount(owner, minlength=t.n)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if not len(short):
        return h, who
    first = np.searchsorted(owner, short)
    extra = np.array([int(tk.mix(np.array([sum((int(hashes[i + j]) * pow(int(tk._BASE), 7 - j, 1 << 64)) for j in range(n[s])) % (1 << 64)], np.uint64) + np.uint64(n[s]))[0]) for s, i in zip(short, first, strict=True)], np.uint64)
    h, who = np.r_[h, extra], np.r_[who, short]
    order = np.argsort(who, kind="stable")
    return h[order], who[order]


def counted(t: tk.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, count) of each text's different shingles, by text, then hash."""
    h, who = shingles(t)
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    at = np.flatnonzero(new)
    return h[at], who[at], np.diff(np.r_[at, len(h)])


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for _, texts in tk.grouped(batch.column(0).to_pylist()):
            h, who, _ = counted(tk.Texts(texts))
            pair = np.unique(who.astype(np.int64) * BUCKETS + bucket_of(h))
            total += np.bincount(pair % BUCKETS, minlength=BUCKETS)
            docs += len(np.unique(who))
    if docs:
        n = BUCKETS // _BLOCK
        data = [total[i * _BLOCK : (i + 1) * _BLOCK].astype("<i8").tobytes() for i in range(n)] + [np.array([docs], "<i8").tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array(range(n + 1), pa.int32()), pa.array(data, pa.binary())], names=["block", "data"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(data, "<i8")
            sums[block] = sums[block] + x if block in sums else x
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "data"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each of the 2**18 buckets, over all documents with words.

    Tasks send a vector of fixed size each; blocks of it are added up in streams, so a sum's task holds one
    block at a time whatever the number of documents, and the driver gets the 2 MB of sums.
    """
    sent = docs.select("text").mapInArrow(_frequencies, "block int, data binary")
    rows = sent.repartition(min(BUCKETS // _BLOCK, shuffle_width(docs.sparkSession)), "block").mapInArrow(_add, "block int, data binary").collect()
    total, n = np.zeros(BUCKETS, np.int64), 0
    for block, data in rows:
        x = np.frombuffer(data, "<i8")
        if block == BUCKETS // _BLOCK:
            n = int(x[0])
        else:
            total[block * _BLOCK : (block + 1) * _BLOCK] = x
    return weights(n, total)


def weights(n: int, frequency: np.ndarray) -> np.ndarray:
    """1 + ln(1 + n / frequency) / ln 11, at most 2: what fewer than a tenth of n documents have weighs 2, what
    all have 1.29.  A group of copies would sink under a steeper law: what they share is common through them."""
    return (1 + np.minimum(1.0, np.log1p((n + 1) / (frequency + 1.0)) / np.log(11))).astype(np.float32)


def _random_tables() -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(20)
    r = rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32) + np.float32(1e-6)
    log_c = np.log(rng.gamma(2.0, 1.0, 1 << 16) + 1e-12).astype(np.float32)
    beta = rng.random(1 << 16, dtype=np.float32)
    return r, log_c, beta, (rng.integers(1 << 63, size=2 * SAMPLES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def samples(h: np.ndarray, who: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int, deal: int = 0) -> np.ndarray:
    """(n, 36) of unsigned 32-bit sample ids; rows of texts without shingles are 0.  Each ``deal`` (0 or 1) has
    samples of its own.

    Of a shingle x of weight S and for each sample, r and c are gamma(2, 1) and beta is uniform, drawn from
    tables at an index hashed from x: t = floor(ln S / r + beta), ln y = r (t - beta), ln a = ln c - ln y - r;
    the sample is (x, t) of the smallest a.
    """
    r, log_c, beta, factors = _TABLES
    out = np.zeros((n, SAMPLES), np.uint32)
    if not len(h):
        return out
    starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    rows = who[starts]
    sizes = np.diff(np.r_[starts, len(h)])
    log_s = np.log(count.astype(np.float32) * idf[bucket_of(h)])
    mixed = tk.mix(h)
    for k in range(SAMPLES):
        i = ((mixed * factors[deal * SAMPLES + k]) >> np.uint64(48)).astype(np.int64)
        rk = r[i]
        b = beta[i]
        t = np.floor(log_s / rk + b)
        log_a = log_c[i] - rk * (t - b + np.float32(1))
        least = np.minimum.reduceat(log_a, starts)
        at = np.flatnonzero(log_a == np.repeat(least, sizes))
        at = at[np.searchsorted(at, starts)]
        out[rows, k] = (tk.mix(h[at] ^ (t[at].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(32)).astype(np.uint32)
    return out


_TABLES = _random_tables()


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """(n, 12) of 64-bit keys, different for different bands."""
    x = sketch.astype(np.uint64).reshape(len(sketch), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(sketch), 0)
    for i in range(ROWS):
        key = tk.mix(key * np.uint64(0xD6E8FEB86659FD93) + x[:, :, i])
    return key.view(np.int64)


def _bands(texts: list[str], idf: np.ndarray, deal: int) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(indices of texts with words, their band keys), a run of texts at a time."""
    for at, run in tk.grouped(texts):
        t = tk.Texts(run)
        h, who, n = counted(t)
        some = np.unique(who)
        if len(some):
            keys = band_keys(samples(h, who, n, idf, t.n, deal)[some])
            yield some + at, pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * BANDS, pa.int32()), pa.array(keys.ravel(), pa.int64()))


_SIGNED = "th binary, k long, n long, bands array<bigint>"


def _sign(idf):
    """Rows (k, th, text) -> for each different text of a batch its first k, its number of rows and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[bytes, tuple[int, str]] = {}
            rows = Counter(batch.column(1).to_pylist())
            for k, th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if th not in first or k < first[th][0]:
                    first[th] = (k, text)
            ths, ks, texts = list(first), [k for k, _ in first.values()], [t for _, t in first.values()]
            for some, bands in _bands(texts, idf.value, 0):
                columns = [pa.array([ths[i] for i in some], pa.binary()), pa.array([ks[i] for i in some], pa.int64()), pa.array([rows[ths[i]] for i in some], pa.int64()), bands]
                yield pa.RecordBatch.from_arrays(columns, names=["th", "k", "n", "bands"])

    return run


def _sign_again(idf):
    """Rows (id, k, root, text) -> (id, k, root, bands) of the second deal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, bands in _bands(batch.column(3).to_pylist(), idf.value, 1):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(some)) for c in range(3)), bands], names=["id", "k", "root", "bands"])

    return run


def weighted_jaccard(a: tuple, b: tuple, idf: np.ndarray) -> float:
    """Of two texts' (hashes, counts), hashes sorted."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float((np.minimum(a[1][i], b[1][j]) * idf[bucket_of(common)]).sum(dtype=np.float64))
    total = sum(float((n * idf[bucket_of(h)]).sum(dtype=np.float64)) for h, n in (a, b))
    return both / (total - both) if total > both else 1.0 if total else 0.0


def link(sets: list[tuple[np.ndarray, np.ndarray]], roots: list[int], idf: np.ndarray, similar: float) -> list[tuple[int, int]]:
    """Links (i, j) of similarity ``similar`` or more that connect the texts' components; ``roots`` names those
    known already.  Texts of one component aren't compared; any others are."""
    n = len(sets)
    parent = list(range(n))
    seen: dict[int, int] = {}
    size = [1] * n

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def unite(i: int, j: int) -> bool:
        i, j = find(i), find(j)
        if i == j:
            return False
        if size[i] < size[j]:
            i, j = j, i
        parent[j] = i
        size[i] += size[j]
        return True

    for i, r in enumerate(roots):
        unite(i, seen.setdefault(r, i))
    out: list[tuple[int, int]] = []
    if n == 2:
        return [(0, 1)] if find(0) != find(1) and weighted_jaccard(*sets, idf) >= similar else []
    owner = np.repeat(np.arange(n), [len(h) for h, _ in sets])
    starts = np.searchsorted(owner, np.arange(n))
    kinds, at = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
    counts = np.concatenate([c for _, c in sets]).astype(np.float64)
    each = idf[bucket_of(kinds)].astype(np.float64)[at]
    total = np.add.reduceat(counts * each, starts)
    mine = np.zeros(len(kinds))
    done = np.zeros(n, bool)
    while True:
        comp = np.array([find(i) for i in range(n)])
        big = np.bincount(comp, minlength=n).argmax()
        todo = np.flatnonzero((comp != big) & ~done)
        if not len(todo) or (comp == big).all():
            return out
        i = int(todo[0]) if done.any() else 0  # the first text of a bucket is the likeliest to be near the others
        done[i] = True
        own = slice(starts[i], starts[i] + len(sets[i][0]))
        mine[at[own]] = counts[own]
        both = np.add.reduceat(np.minimum(mine[at], counts) * each, starts)
        mine[at[own]] = 0
        near = both >= similar * (total + total[i] - both)
        for j in np.flatnonzero(near & (comp != comp[i])).tolist():
            if unite(i, j):
                out.append((i, j))


def _compare(idf, similar: float):
    """Rows (group, id, root, text), each group together -> links (a, b); a repeated text adds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, roots, sets = None, [], [], []

        def links() -> list[tuple[int, int]]:
            return [(names[i], names[j]) for i, j in link(sets, roots, idf.value, similar)] if len(names) > 1 else []

        for batch in batches:
            group, th, root, texts = (c.to_pylist() for c in batch.columns)
            found: list[tuple[int, int]] = []
            for at, part in tk.grouped(texts):
                h, who, n = counted(tk.Texts(part))
                cuts = np.searchsorted(who, np.arange(len(part) + 1))
                for i in range(len(part)):
                    if group[at + i] != key:
                        found += links()
                        key, names, roots, sets = group[at + i], [], [], []
                    if names and names[-1] == th[at + i]:
                        continue
                    names.append(th[at + i])
                    roots.append(root[at + i])
                    sets.append((h[cuts[i] : cuts[i + 1]], n[cuts[i] : cuts[i + 1]]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
        found = links()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for all nodes of the edges (a, b).

    Large stars and small stars in turn: every node tells its larger neighbours, then its smaller ones, the
    smallest it knows.  Both are a minimum by key and a join, so a node's neighbours need not fit a task.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = small.checkpoint()
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark is not None and tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _blocks(column: str) -> Column:
    return F.ceil(F.col(column) / MEET).cast("int")


def _dealt(key: str, salt: str, into: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.col(into)).cast("int")


def _same_once(buckets: DataFrame) -> DataFrame:
    """Of the buckets that hold the same texts, by number, first text and sum of marks, one."""
    rest = [c for c in buckets.columns if c not in ("n", "c", "set", "band")]
    return buckets.groupBy("n", "c", "set").agg(F.min("band").alias("band"), *[F.min(c).alias(c) for c in rest])


def _set() -> Column:
    return F.sum(F.xxhash64("id", F.lit("set")).cast("decimal(20,0)")).alias("set")


def second_groups(again: DataFrame) -> DataFrame:
    """(group, first, k, id, root): who meets whom after the second deal, of ``again`` (id, k, root, bands).

    A bucket of one block is a group.  In a larger one, those outside its largest component are dealt into turns,
    and each turn meets all blocks: a text comes once for each turn or block, so the rows are the bucket's texts
    times what is apart in it over 512.
    """
    member = again.select(F.explode("bands").alias("band"), "id", "k", "root")
    buckets = member.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "id")).alias("c"), _set(), F.min("root").alias("r0"), F.max("root").alias("r1"))
    buckets = _same_once(buckets.where("n > 1 and r0 <> r1")).select("band", _blocks("n").alias("blocks"))
    member = member.join(buckets, "band").checkpoint()
    small = member.where("blocks = 1").select(F.xxhash64("band").alias("group"), F.lit(False).alias("first"), "k", "id", "root")
    large = member.where("blocks > 1")
    of_root = large.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    main = of_root.groupBy("band").agg(F.max(F.struct("n", "root"))["root"].alias("main"), (F.sum("n") - F.max("n")).alias("n_apart")).select("band", "main", _blocks("n_apart").alias("turns"))
    placed = large.join(main, "band").withColumn("apart", F.col("root") != F.col("main"))
    placed = placed.withColumn("block", _dealt("id", "block", "blocks")).withColumn("turn", _dealt("id", "turn", "turns"))
    asks = placed.where("apart").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("first", F.lit(True)).withColumnRenamed("turn", "t2")
    told = placed.withColumn("t2", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).withColumn("b", F.col("block")).withColumn("first", F.lit(False))
    told = told.where("not (apart and turn = t2)")
    crossed = [x.select(F.xxhash64("band", "b", "t2").alias("group"), "first", "k", "id", "root") for x in (asks, told)]
    return small.unionByName(crossed[0]).unionByName(crossed[1])


def _text_classes(docs: DataFrame, similar: float) -> DataFrame:
    """(t, k, class_k, class_t, class_n) of every different text with words: its digest, its first document, the
    first document of its class, the least digest of that document's texts in the class, and the class's rows."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs))
    top = F.lit(_TOP)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), top).alias("k"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", digest(F.col("text")))
    signed = rows.select("k", "th", "text").mapInArrow(_sign(idf), _SIGNED)
    texts = signed.groupBy("th").agg(F.min("k").alias("k"), F.sum("n").alias("n"), F.first("bands").alias("bands"))
    texts = texts.withColumn("id", F.monotonically_increasing_id()).checkpoint()  # numbers hold from here on, for what is written is read
    member = texts.select(F.explode("bands").alias("band"), "id", "k")
    buckets = member.groupBy("band").agg(F.min(F.struct("k", "id")).alias("c"), F.count(F.lit(1)).alias("n"), _set()).where("n > 1")
    buckets = _same_once(buckets).select("band", F.col("c.id").alias("cid"), _blocks("n").alias("blocks"))
    member = member.join(buckets, "band").withColumn("block", _dealt("id", "block", "blocks")).checkpoint()

    asked = member.select("id").distinct().join(texts.select("id", F.col("th").alias("t"), F.col("k").alias("k1")), "id")
    candidates = rows.join(asked, (F.col("th") == F.col("t")) & (F.col("k") == F.col("k1"))).select("id", "text").checkpoint()

    def met(groups: DataFrame) -> DataFrame:
        """Links within the groups of (group, first, id, k, root)."""
        dealt = groups.join(candidates, "id").select("group", "first", "k", "id", "root", "text")
        dealt = dealt.repartition(shuffle_width(spark), "group").sortWithinPartitions("group", F.desc("first"), "k", "id")
        return dealt.select("group", "id", "root", "text").mapInArrow(_compare(idf, similar), "a long, b long")

    is_first = F.col("id") == F.col("cid")
    here = F.when(is_first, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    once = member.withColumn("b", F.explode(here)).select(F.xxhash64("band", "b").alias("group"), is_first.alias("first"), "id", "k", F.col("id").alias("root"))
    links = met(once).distinct().checkpoint()
    root = components(links)
    large = member.where("blocks > 1")
    if not large.isEmpty():
        placed = large.join(root.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        apart = placed.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("band")
        open_ = placed.join(apart, "band", "left_semi").select("id", "k", "root").distinct()
        signed = open_.join(candidates, "id").select("id", "k", "root", "text").mapInArrow(_sign_again(idf), "id long, k long, root long, bands array<bigint>")
        again = met(second_groups(signed.dropDuplicates(["id"]).checkpoint()))
        root = components(links.unionByName(again))
    of_class = texts.join(root.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = of_class.groupBy("root").agg(F.min(F.struct("k", "th")).alias("c"), F.sum("n").alias("class_n"))
    return of_class.join(first, "root").select(F.col("th").alias("t"), "k", F.col("c.k").alias("class_k"), F.col("c.th").alias("class_t"), "class_n")


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``doc_id, th, class_id``: a row for each document, ``th`` being its text's digest; ``class_id`` is the smallest doc_id of its class.

    Equal texts are in one class, and so are texts linked by a chain of pairs of ``similar`` or more that
    share a band (at 0.8 one in 5,000 pairs shares none; twice that for pairs that share large buckets only).  Documents without words (null, empty, blank) are in
    no class with others: their class_id is their own doc_id.  Null doc_ids count as larger than any other.
    Repeated rows share a class.  Where several documents of a class all have no doc_id, its class_id is a
    negative number from a hash of its own; a document alone without one has null.
    """
    own_id = F.when(F.col("class_n") > 1, -F.shiftrightunsigned(F.xxhash64("class_t"), 1) - 1)
    named = _text_classes(docs, similar).select("t", F.when(F.col("class_k") < _TOP, F.col("class_k")).otherwise(own_id).alias("named"))
    own = docs.select("doc_id", digest(F.coalesce("text", F.lit(""))).alias("th"))
    return own.join(named, F.col("th") == F.col("t"), "left").select("doc_id", "th", F.when(F.col("t").isNull(), F.col("doc_id")).otherwise(F.col("named")).alias("class_id"))


def drop_near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The documents with one of each class left: that of the smallest doc_id (of repeated rows, one; of several
    texts with that doc_id, or of a class without any, that of the least digest)."""
    first = _text_classes(docs, similar).where("k = class_k and t = class_t").select(F.col("k").alias("__k"), F.col("t").alias("__th"), F.lit(True).alias("__first"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = docs.withColumn("__k", F.coalesce(F.col("doc_id").cast("long"), F.lit(_TOP))).withColumn("__th", digest(F.coalesce("text", F.lit(""))))
    kept = kept.join(first, ["__k", "__th"], "left").where(F.col("__first") | ~worded)
    return kept.dropDuplicates(["__k", "__th"]).drop("__k", "__th", "__first")
