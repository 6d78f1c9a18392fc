"""Tokens by vocabulary file: whole-token shortcuts, memoised merges, and documents cut into pieces."""

from __future__ import annotations

import functools
import hashlib
import json
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweir.llm.common import documents, texts_of, whole_texts

# The pre-token patterns that the two public vocabulary files name.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pre-tokens whose result a worker remembers. Beyond that many it forgets them all and starts anew; counts don't change.
REMEMBERED = 250_000
#: Longer strings are made anew each time, so that a memo's size has a bound.
LONGEST = 64


@functools.cache
def _unassigned() -> np.ndarray:
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


def odd(text: str) -> bool:
    """Whether a text holds characters that Python's Unicode tables don't know. The library's tables may be newer, so such
    a text goes to the library as a whole."""
    return not text.isascii() and bool(_unassigned()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = str.maketrans({chr(b): c for b, c in byte_letters().items()})


def spelled(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(LETTERS)


def read_vocabulary(path: str) -> str:
    """The vocabulary file, read on the driver and shipped to workers (a few MB, whatever the corpus)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Memo(dict):
    """Results by string, made on first sight, of strings up to LONGEST characters. At REMEMBERED of them it forgets all but
    its seed; results don't change."""

    def __init__(self, make, seed: dict | None = None) -> None:
        super().__init__(seed or {})
        self.make, self.seed = make, seed or {}

    def __missing__(self, key: str):
        if len(self) > REMEMBERED:
            self.clear()
            self.update(self.seed)
        got = self.make(key)
        if len(key) <= LONGEST:
            self[key] = got
        return got


#: What a Python worker keeps from task to task, by vocabulary.
_OWN: dict[tuple[str, str], object] = {}


def kept(kind: str, vocabulary: str, make):
    key = (kind, hashlib.sha256(vocabulary.encode()).hexdigest())
    if key not in _OWN:
        _OWN[key] = make()
    return _OWN[key]


def whole_tokens(vocabulary: str) -> dict[str, int]:
    """Prove which vocabulary strings encode alone as one token: strings that are one pre-token and that the merges,
    run on their bytes, join into the very token. Done once on the driver; bounded by the vocabulary."""
    from tokenizers import Tokenizer

    tok, split = Tokenizer.from_str(vocabulary), regex.compile(BYTE_LEVEL)
    special = {t.content for t in tok.get_added_tokens_decoder().values()}
    back = {c: b for b, c in byte_letters().items()}
    proven = {}
    for spelling, at in tok.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(back[c] for c in spelling).decode()
        except (UnicodeDecodeError, KeyError):
            continue
        if text in special or split.findall(text) != [text]:
            continue
        ids = tok.encode(text, add_special_tokens=False).ids
        if ids == [at]:
            proven[text] = 1
    return proven


def special_strings(vocabulary: str) -> list[str]:
    return [t["content"] for t in json.loads(vocabulary)["added_tokens"]]


def text_counter(vocabulary: str, proven: dict[str, int]):
    """A function from a text to its number of tokens under a byte-level vocabulary, equal to the library's encode."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(vocabulary)
    special = special_strings(vocabulary)
    cut = regex.compile("|".join(map(regex.escape, special))) if special else None
    split, merge = regex.compile(BYTE_LEVEL).findall, tok.model.tokenize
    tokens_of = Memo(lambda piece: len(merge(spelled(piece))), proven).__getitem__
    never = -(1 << 40)

    def chunk(c: str) -> int:
        """Tokens of a space and c; far below 0 where the text can't be cut at that space."""
        return never if not c or c[0].isspace() or c[-1].isspace() else sum(map(tokens_of, split(" " + c)))

    chunks = Memo(chunk).__getitem__

    def plain(text: str) -> int:
        # A space between two characters that aren't white space always begins a pre-token, so the text can be cut there.
        first, *rest = text.split(" ")
        if not rest or first and not first[-1].isspace():
            n = sum(map(chunks, rest), sum(map(tokens_of, split(first))))
            if n >= 0:
                return n
        return sum(map(tokens_of, split(text)))

    def count(text: str) -> int:
        if odd(text):
            return len(tok.encode(text, add_special_tokens=False).ids)
        if cut and any(s in text for s in special):
            parts = cut.split(text)
            return len(parts) - 1 + sum(map(plain, parts))
        return plain(text)

    return count


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row and whole text.

    One pass without a shuffle. The pre-token pattern cuts a text, a table of proven whole tokens gives 1 for most
    pre-tokens, and only the others are merged (and remembered). Special strings inside a text count as one token, as the
    library's default has it. Null text: empty, 0 bytes and 0 tokens. A null doc_id stays null; repeated rows each give a
    row; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    whole_texts(spark)
    vocabulary = read_vocabulary(vocabulary_path)
    shipped = spark.sparkContext.broadcast((vocabulary, whole_tokens(vocabulary)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, proven = shipped.value
        count = kept("count", vocabulary, lambda: text_counter(vocabulary, proven))
        for b in batches:
            text = b.column("text")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pc.cast(pc.binary_length(text), pa.int64()), pa.array([count(t.as_py()) for t in text], pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = texts_of(docs).mapInArrow(scan, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


def word_ids(vocabulary: str):
    """A function from a text to the bytes of its ids (little-endian, 32 bits) under a lower-cased word-end vocabulary,
    equal to the library's encode without added special tokens."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(vocabulary)
    special = {s: packed([tok.token_to_id(s)]) for s in special_strings(vocabulary)}
    cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
    split, merge = regex.compile(WORD_LEVEL).findall, tok.model.tokenize
    controls = regex.compile("[\x1c-\x1f]").search
    pieces = Memo(lambda piece: packed([t.id for t in merge(spelled(piece))])).__getitem__
    chunks = Memo(lambda c: b"".join(map(pieces, split(c)))).__getitem__

    def plain(text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # No pre-token holds white space, so the text can be cut there; Python also cuts at four controls that are none.
        return b"".join(map(pieces, split(text)) if controls(text) else map(chunks, text.split()))

    def ids(text: str) -> bytes:
        if odd(text):
            return packed(tok.encode(text, add_special_tokens=False).ids)
        if cut and any(s in text for s in special):
            return b"".join(special[p] if p in special else plain(p) for p in cut.split(text))
        return plain(text)

    return ids


def token_pieces(docs: DataFrame, vocabulary_path: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids followed by id 0, cut into pieces of at most `capacity`.

    One pass without a shuffle. Null text: empty, one piece that holds id 0. Repeated rows each give their pieces; an empty
    table gives no pieces; other columns are not read.
    """
    spark = docs.sparkSession
    whole_texts(spark)
    shipped = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, step = kept("ids", shipped.value, lambda: word_ids(shipped.value)), 4 * capacity
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column("text")):
                data = ids(text.as_py()) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts_of(docs).mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


QUERIES = {"op3_token_counts": op3_token_counts}
SQL: dict[str, str] = {}
