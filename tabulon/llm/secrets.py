"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import without

#: Fixed patterns, with what a match must have to count.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Parts of ten or more characters joined by dots, as signed tokens have them.
DOTTED = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]{10,})+(?![A-Za-z0-9_-])")
#: Class of a candidate's characters: (window, least entropy in bits a character).
CLASSES = {"hex": (20, 3.0), "letters": (20, 3.4), "alnum": (20, 3.4), "base64": (20, 3.4), "dotted": (20, 3.4)}
#: Words of a name in mixed case; letters in whose case no words of this mean length show are a key.
_HUMP, WORD_LENGTH = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]"), 3.7
#: Candidates that are known to be none: plain words and compounds of them, numbers, UUIDs, dates and paths of words.
ALLOW = [re.compile(p) for p in (r"[A-Za-z]+([-_/+=][A-Za-z]*)*", r"[0-9+/_=-]+", r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"[A-Za-z]+[-_/]*[0-9]{1,8}", r"(.)\1*", r"([A-Za-z]+[-_/]|[0-9]{1,8}[-_/])+([A-Za-z]*|[0-9]{1,8})")]
_HEX_CHARS, _LETTERS, _ALNUM = re.compile(r"[0-9a-fA-F]+"), re.compile(r"[A-Za-z]+"), re.compile(r"[A-Za-z0-9]+")
#: What a dotted candidate may have for parts without being a secret: letters, then digits, joined by signs.
_PLAIN_PART = re.compile(r"([A-Za-z]*[0-9]{0,8}[-_])*[A-Za-z]*[0-9]{0,8}")


def _class(word: str) -> str:
    return "dotted" if "." in word else "hex" if _HEX_CHARS.fullmatch(word) else "letters" if _LETTERS.fullmatch(word) else "alnum" if _ALNUM.fullmatch(word) else "base64"


def _wild_case(part: str) -> bool:
    """Whether the letters' case changes as it does in no name: one in lower case has one hump, so it is none."""
    humps = _HUMP.findall(part)
    return len(humps) > 3 and sum(map(len, humps)) / len(humps) < WORD_LENGTH


def _allowed(word: str) -> bool:
    if "." in word:
        return all(_PLAIN_PART.fullmatch(p) and not _wild_case(p) for p in word.split("."))
    if _LETTERS.fullmatch(word):
        return not _wild_case(word)
    return any(p.fullmatch(word) for p in ALLOW)


def entropy_spans(word: str, window: int, least: float) -> list[tuple[int, int]]:
    """Maximal runs covered by windows whose Shannon entropy is ``least`` bits or more.

    One pass: a window's counts follow from the last one's, and with them the sum of c log c.
    """
    if len(word) < window:
        return []
    log = [0.0, 0.0] + [c * math.log2(c) for c in range(2, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    spans: list[tuple[int, int]] = []
    for i, ch in enumerate(word):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += log[c + 1] - log[c]
        if i >= window:
            old = word[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += log[c - 1] - log[c]
        if i >= window - 1 and math.log2(window) - total / window >= least - 1e-9:
            start = i - window + 1
            if spans and spans[-1][1] >= start:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets in code points, by start, then kind as in ``KINDS``."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base = list(out)
    dotted = DOTTED.finditer(text) if "." in text else ()
    for m in [*(d for d in dotted if not _allowed(d[0])), *CANDIDATE.finditer(text)]:
        word = m[0]
        if _allowed(word):
            continue
        for a, b in entropy_spans(word, *CLASSES[_class(word)]):
            a, b = m.start() + a, m.start() + b
            part = text[a:b]
            mixed = any(c.isdigit() for c in part) and any(c.isalpha() for c in part)
            if (mixed or _wild_case(part)) and not any(s <= a and b <= e for _, s, e in base):
                out.append(("entropy", a, b))
                if "." in word:
                    base.append(("entropy", a, b))  # its parts are no secrets of their own
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each maximal covered run replaced by ``mark``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for _, a, b in spans:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, redacted: bool = False) -> DataFrame:
    """The documents with ``spans``: array of (kind, start, end), code points, end exclusive.

    ``redacted``: the text comes back with its secrets replaced.  Null text has no spans and stays null.  Rows
    are handled one by one, so repeated rows, other columns and empty tables pass through, but for a column called
    ``spans``: the result takes its place.
    """
    docs = without(docs, ["spans"])
    fields = docs.schema.fields
    names = [f.name for f in fields]
    text_at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            found = [find(t or "") for t in texts]
            columns = list(batch.columns)
            if redacted:
                columns[text_at] = pa.array([redact(t, s) if s else t for t, s in zip(texts, found, strict=True)], pa.string())
            spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], _SPANS)
            yield pa.RecordBatch.from_arrays([*columns, spans], names=[*names, "spans"])

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("spans", T.ArrayType(span))]))


def digest(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
