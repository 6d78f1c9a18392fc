import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lumenweir.llm import tokens as T

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def strange(n):
    rnd = random.Random(3)
    parts = list("aAbß éΣσİıſḰ\x1c\x1d\x85\xa0  \n\t'sd9٣½漢😀ﬁÅ") + ["<|endoftext|>", "<|startoftext|>", "'LL", "'ll", "  ", "...", "͸", " the", "Ᲊ", "é"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


def test_counts_equal_the_library(spark, make_docs, odd_texts):
    texts = odd_texts + strange(1500)
    got = T.token_counts(make_docs(texts), BYTE, limit=20).collect()
    tok = Tokenizer.from_file(BYTE)
    want = [(i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 20) for i, t in enumerate(texts)]
    assert sorted(tuple(r) for r in got) == want


def test_whole_tokens_are_proven():
    proven = T.whole_tokens(T.read_vocabulary(BYTE))
    assert len(proven) > 45_000 and " the" in proven and "<|endoftext|>" not in proven
    tok = Tokenizer.from_file(BYTE)
    assert all(len(tok.encode(t, add_special_tokens=False).ids) == 1 for t in random.Random(1).sample(sorted(proven), 500))


def test_memo_forgets_without_changing_counts(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 5)
    v = T.read_vocabulary(BYTE)
    count, tok = T.text_counter(v, {}), Tokenizer.from_str(v)
    assert all(count(t) == len(tok.encode(t, add_special_tokens=False).ids) for t in strange(100))


@pytest.mark.parametrize("capacity", [7, 2048])
def test_pieces_rejoin_to_the_library_ids(spark, make_docs, odd_texts, capacity):
    import zlib

    texts = odd_texts + strange(400)
    got = T.token_pieces(make_docs(texts), WORD, capacity).collect()
    tok = Tokenizer.from_file(WORD)
    by = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        by.setdefault(r.doc_id, []).append(r)
    assert sorted(by) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in by[i]] == [(k, at, len(ids[at : at + capacity]), zlib.crc32(T.packed(ids[at : at + capacity]))) for k, at in enumerate(range(0, len(ids), capacity))]


def test_empty_table(spark, make_docs):
    none = make_docs(["a"]).limit(0)
    assert T.token_counts(none, BYTE).count() == 0 and T.token_pieces(none, WORD).count() == 0
    assert T.token_counts(make_docs([(None, "a b"), (None, "a b")]), BYTE).count() == 2
