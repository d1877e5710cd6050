"""Packing by power-of-two decomposition.

A document's tokens are cut into pieces of 4096 and then into one piece for each binary digit of the rest,
longest first, so every piece is a power of two long, fills a sequence of its own without padding, and no
sequence crosses documents.  Pieces of equal length share a bucket, numbered in cells.

Tokenizing is most of the work.  Texts are cut into words, signs and digits as arrays of bytes, equal ones of a
batch are found by Arrow, and only the different ones meet Python, through a cache that lives as long as the worker.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.common import give_back, shuffle_width

MAX_LENGTH = 4096
END_ID = 2
#: Entries of each generation of a worker's cache, and the longest word (bytes) that is kept: a bound in bytes.
CACHE_WORDS, LONGEST_KEPT = 400_000, 64
#: Bytes tokenized at a time; a longer text is a group of its own.
GROUP_BYTES = 8_000_000

#: The steps before the model for which cutting at white space, and the shorter way for simple cuts, are right.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}

#: The printable code point that stands for each byte: itself, or the next free one from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = {b: b for b in _PRINTABLE} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(_PRINTABLE))}

_SPACE, _LETTER, _SIGN, _DIGIT, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[[9, 10, 13, 32]] = _SPACE
_KIND[[c for c in range(33, 127) if c != 39]] = _SIGN  # an apostrophe may begin a part of its own
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
#: What the splitter makes of plain text, in lower case: letters, signs, or a digit.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[!-&(-/:-@\[-`{-~]+|[0-9]")


def _cuts_at_spaces(spec: dict) -> bool:
    """Whether the tokenizer drops white space before anything else could see it."""
    apart = not any(c in t["content"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []) for c in " \n")
    plain = spec.get("truncation") is None and spec.get("padding") is None and spec.get("post_processor") is None
    return plain and apart and spec.get("normalizer") == _NORMALIZER and spec.get("pre_tokenizer") == _SPLITTER and spec["model"]["type"] == "BPE" and spec["model"].get("dropout") is None


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of the words of texts laid end to end, the texts' own bounds among them.

    White space separates.  What is between is cut into runs of Latin letters, which are lowered, runs of signs
    and single digits, unless it has any other character or a special token's beginning: then it stays whole.
    A word may be white space, which has no tokens.
    """
    kind = _KIND[data]
    two = np.flatnonzero(data[:-1] == 0xC3)
    two = two[(data[two + 1] != 0x97) & (data[two + 1] != 0xB7)]
    kind[two] = kind[two + 1] = _LETTER
    odd = kind == _ODD
    odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    if odd.any():
        cut = np.ones(len(data) + 1, bool)
        space = kind == _SPACE
        cut[1:-1] = space[1:] != space[:-1]
        cut[ends] = True
        at = np.flatnonzero(cut)
        strange = np.add.reduceat(odd, at[:-1]) > 0
        kind[np.repeat(strange, np.diff(at))] = _ODD
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    new[ends] = True
    low = data.copy()
    low[(data >= 65) & (data <= 90) & (kind == _LETTER)] += 32
    after = two[(kind[two] == _LETTER)] + 1
    after = after[low[after] < 0x9F]
    low[after] += 32
    low[kind == _SPACE] = 32
    return low, np.flatnonzero(new)


class WordEncoder:
    """Token ids of texts.  A tokenizer that drops white space works through a cache of the texts' words; any
    other one encodes whole texts."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.by_words = _cuts_at_spaces(json.loads(tokenizer_json))
        self.old: dict[bytes, bytes] = {}
        self.known: dict[bytes, bytes] = {}

    def _tokens(self, word: bytes) -> bytes:
        """Ids of one word: a plain one goes straight to the model, any other takes all steps."""
        if _PLAIN.fullmatch(word) and b"<|" not in word:
            text = word.decode("latin-1")
            ids = [t.id for t in self.tokenizer.model.tokenize(text if text.isascii() else text.translate(_BYTE_LEVEL))]
        else:
            ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word.  A full cache becomes the old generation, from which what is asked for moves back."""
        if len(self.known) > CACHE_WORDS:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        found = list(map(known.get, words))
        for i in [i for i, x in enumerate(found) if x is None]:
            w = words[i]
            ids = found[i] = old.get(w) or self._tokens(w)
            if len(w) <= LONGEST_KEPT:
                known[w] = ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each text); null text is empty."""
        if not self.by_words:
            each = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
            return np.array([x for ids in each for x in ids], np.uint32), np.fromiter(map(len, each), np.int64, len(each))
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if ends[-1] == ends[0]:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        data, bounds = words_of(data, ends)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        found = self._learn(coded.dictionary.to_pylist())
        ids, counts = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) >> 2
        row = coded.indices.to_numpy()
        n = counts[row]
        reach = np.r_[0, np.cumsum(n)]
        at = np.arange(reach[-1]) + np.repeat((np.cumsum(counts) - counts)[row] - reach[:-1], n)
        return ids[at], np.diff(reach[np.searchsorted(bounds, ends)])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(tokenizer_json: str) -> WordEncoder:
    """The worker's encoder for this tokenizer, built once and kept with its caches; one tokenizer at a time."""
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(tokenizer_json)
    return _ENCODERS[key]


def groups(lengths: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive runs of texts of about ``limit`` in all, one text at least."""
    at, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if len(lengths) > at:
        yield at, len(lengths)


def pieces(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths of the pieces of n tokens: whole ``longest`` ones, then the rest's binary digits, falling."""
    out = [longest] * (n // longest)
    rest = n % longest
    out += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return out


def piece_table(counts: np.ndarray, longest: int = MAX_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(document index, length) of the pieces of documents of so many tokens, as :func:`pieces` gives them."""
    whole, rest = counts // longest, counts % longest
    digits = (rest[:, None] >> np.arange(longest.bit_length() - 2, -1, -1)) & 1 if longest > 1 else np.zeros((len(counts), 0), np.int64)
    n = np.concatenate([whole[:, None], digits], 1)
    lengths = np.concatenate([[longest], 1 << np.arange(longest.bit_length() - 2, -1, -1)]) if longest > 1 else np.array([1])
    doc, kind = np.nonzero(n)
    times = n[doc, kind]
    return np.repeat(doc, times), np.repeat(lengths[kind], times)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])


def _pieces(tokenizer, end_id: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer.value)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in groups(sizes):
                ids, n = encoder.encode(batch.column(1).slice(a, b - a))
                n = n + 1
                last = np.cumsum(n) - 1
                tokens = np.full(len(ids) + len(n), end_id, "<u4")
                inside = np.ones(len(tokens), bool)
                inside[last] = False
                tokens[inside] = ids
                doc, length = piece_table(n, longest)
                reach = np.cumsum(length)
                start = reach - length - (last - n + 1)[doc]
                for i in range(0, len(doc), 1 << 14):  # rows of bounded size go on
                    part = slice(i, min(i + (1 << 14), len(doc)))
                    ends = np.r_[reach[part][0] - length[part][0], reach[part]]
                    held = pa.py_buffer(tokens[ends[0] : ends[-1]])
                    binary = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * (ends - ends[0])).astype(np.int32)), held])
                    ids_of = batch.column(0).slice(a, b - a).take(pa.array(doc[part]))
                    yield pa.RecordBatch.from_arrays([ids_of, pa.array(start[part]), pa.array(length[part]), binary, pa.array(n[doc[part]])], schema=_SCHEMA)
        give_back()

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, longest: int = MAX_LENGTH) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset``.

    ``ids`` holds little-endian unsigned 32-bit token ids, those of the document followed by ``end_id``.  Null
    or empty text is the end id alone.  Each piece is a sequence (offset 0) of its own; repeated rows give
    pieces and sequences of their own; pieces of one doc_id and start are numbered in the order of a hash of
    their ids, so a recomputed task numbers alike.  ``longest`` is a power of two.  Other columns are ignored.
    """
    if longest < 1 or longest & longest - 1:
        raise ValueError("longest must be a power of two")
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(tokenizer, end_id, longest), "doc_id long, start long, length long, ids binary, doc_tokens long")
    cells, kinds = shuffle_width(spark), longest.bit_length()
    rows = rows.withColumn("ids_crc32", F.crc32("ids")).withColumn("__h", F.xxhash64("ids"))
    rows = rows.withColumn("__cell", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", "__h"), F.lit(cells)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("length", "__cell").orderBy("doc_id", "start", "doc_tokens", "__h")).cast("long") - 1
    level = F.log2(F.col("length").cast("double")).cast("int")
    return rows.withColumn("sequence_id", (rank * cells + F.col("__cell")) * kinds + level).withColumn("offset", F.lit(0).cast("long")).drop("__cell", "__h")
