"""Secret scans: three base patterns and sliding-window entropy over candidate strings of each character class."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenweir.llm.common import chunked, documents, texts_of, whole_texts

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # shorter runs fail anyhow
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Candidate strings of the entropy method: runs of these characters of this length or more.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits per character at which a window is random, by the class of its candidate (checked in this order).
CLASSES = (
    ("hex", re.compile(r"[0-9a-fA-F]+"), 3.0),
    ("upper", re.compile(r"[A-Z0-9]+"), 3.4),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.7),
)
#: Strings that look random and are no secrets: alphabets and digits in order, ids of nothing, digests of the empty text.
ALLOWED = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "00000000-0000-0000-0000-000000000000",
    "d41d8cd98f00b204e9800998ecf8427e",
    "da39a3ee5e6b4b0d3255bfef95601890afd80709",
    "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
)

_CLASS = np.zeros(256, np.uint8)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-":
    _CLASS[_c] = 1
_TERM = [0.0, *(n * math.log2(n) for n in range(1, WINDOW + 2))]


def explained(text: str, allowed: tuple[str, ...]) -> list[int]:
    """For each place of text, how many characters before it lie in an allow-listed string; a text inside such a string is all explained."""
    inside = [any(text in a for a in allowed)] * len(text)
    for a in allowed:
        at = text.find(a)
        while at >= 0:
            inside[at : at + len(a)] = [True] * len(a)
            at = text.find(a, at + 1)
    return [0, *accumulate(inside)]


def random_windows(text: str, bits: float, known: list[int] | None = None) -> Iterator[tuple[int, int]]:
    """Merged spans of the windows of WINDOW characters whose Shannon entropy reaches `bits`, but for those that allow-listed
    strings make up by half or more (known: see explained()); counts slide by one character."""
    counts: dict[str, int] = {}
    total, begin, end = 0.0, -1, -1
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        if i >= WINDOW:
            old = text[i - WINDOW]
            n = counts[old]
            total -= _TERM[n] - _TERM[n - 1]
            counts[old] = n - 1
        if i >= WINDOW - 1 and math.log2(WINDOW) - total / WINDOW >= bits - 1e-9 and not (known and 2 * (known[i + 1] - known[i - WINDOW + 1]) >= WINDOW):
            at = i - WINDOW + 1
            if at > end:
                if begin >= 0:
                    yield begin, end
                begin = at
            end = i + 1
    if begin >= 0:
        yield begin, end


def entropy_spans(text: str, allowed: tuple[str, ...] = ALLOWED) -> list[tuple[int, int]]:
    """Spans of high-entropy windows in candidates that mix letters and digits, but for windows that the allow-list explains."""
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)):
            continue
        bits = next(limit for _, kind, limit in CLASSES if kind.fullmatch(s))
        out += [(m.start() + a, m.start() + b) for a, b in random_windows(s, bits, explained(s, allowed) if any(a in s or s in a for a in allowed) else None)]
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, leftmost and without overlap within a kind."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def suspects(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts hold a run of candidate characters of WINDOW or more; others have neither entropy nor hex spans."""
    kind = np.empty(len(buf) + 2, np.uint8)
    kind[0] = kind[-1] = 0
    kind[1:-1] = _CLASS[buf]
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    begins, ends = edge[0::2], edge[1::2]
    long = ends - begins >= WINDOW
    out = np.zeros(len(offs) - 1, bool)
    first, last = (np.searchsorted(offs, x, "right") - 1 for x in (begins[long], ends[long] - 1))
    for a, z in zip(first, last, strict=True):  # a run over a text boundary only adds a suspect
        out[a : z + 1] = True
    return out


def secret_spans(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id and spans array<struct<start, kind, end>> (code points, end exclusive) of every row and whole text.

    One pass without a shuffle. Null text: empty, no spans. Null doc_ids stay; repeated rows each give a row; spans with
    the same start are ordered by kind as listed in KINDS; an empty table gives an empty result; other columns are not read.
    """
    whole_texts(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])
        for b in batches:
            text, rows = b.column("text"), []
            for at, end, buf, offs in chunked(text):
                long = suspects(buf, offs)
                raw = buf.tobytes().lower()
                for i in range(at, end):
                    a, z = int(offs[i - at]), int(offs[i - at + 1])
                    found: list[tuple[int, str, int]] = []
                    keyed = (raw.find(b":", a, z) >= 0 or raw.find(b"=", a, z) >= 0) and any(raw.find(k, a, z) >= 0 for k in KEYWORDS)
                    if long[i - at] or keyed or raw.find(b"akia", a, z) >= 0:
                        t = text[i].as_py()
                        found = base_spans(t)
                        if long[i - at]:
                            found += [(x, "entropy", y) for x, y in entropy_spans(t, allowed)]
                        found.sort(key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
                    rows.append([{"start": x, "kind": k, "end": y} for x, k, y in found])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(kind))], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts_of(docs).mapInArrow(scan, f"doc_id {kind}, spans array<struct<start: bigint, kind: string, end: bigint>>")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return secret_spans(documents(spark, sf_dir)).select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(text(F.filter("spans", lambda s: s["kind"] != "entropy")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


QUERIES = {"op5_secret_scan": op5_secret_scan}
SQL: dict[str, str] = {}
