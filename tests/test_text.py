import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenweir.functions import text as T
from lumenweir.functions.strict_json import parsed


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).collect()[0].y


@pytest.mark.parametrize(
    ("code", "want"),
    [('a="//x";//y', 'a="//x";   '), ("/*a\nb*/c", "   \n   c"), ("/* x", None), ("/*/", None), ('"abc', '"abc'), ("'\\'//'//z", "'\\'//'   "), ("", "")],
)
def test_strip_comments(spark, code, want):
    assert one(spark, T.strip_comments, code) == want


def scan(code):
    """Blanking by a plain scanner, None for an open block."""
    out, i = [], 0
    while i < len(code):
        c = code[i]
        if c in "\"'":
            j = i + 1
            while j < len(code) and code[j] != c:
                j += 2 if code[j] == "\\" else 1
            j = min(j + 1, len(code))
            out.append(code[i:j])
        elif code.startswith("//", i):
            j = i
            while j < len(code) and code[j] not in "\r\n":
                j += 1
            out.append(" " * (j - i))
        elif code.startswith("/*", i):
            end = code.find("*/", i + 2)
            if end < 0:
                return None
            j = end + 2
            out.append(re.sub(r"[^\r\n]", " ", code[i:j]))
        else:
            j = i + 1
            out.append(c)
        i = j
    return "".join(out)


def test_strip_comments_equals_a_scanner(spark):
    rnd = random.Random(1)
    codes = ["".join(rnd.choice("\"'/*\\\r\nab é") for _ in range(rnd.randint(0, 25))) for _ in range(3000)]
    got = [r.y for r in spark.createDataFrame(list(enumerate(codes)), "i int, x string").orderBy("i").select(T.strip_comments(F.col("x")).alias("y")).collect()]
    assert got == [scan(c) for c in codes]


def test_tokens_and_skeletons(spark):
    t = lambda code: one(spark, T.code_tokens, code)
    assert t("a+ +b") == ["a", "+", "+", "b"] and t("a++ +b") == ["a", "++", "+", "b"]
    assert t('x="a//b";//c') == ["x", "=", '"a//b"', ";"] and t('"abc') is None and t("") == []
    assert t("0x1F 1.5e3 .5 é$1 >>>=") == ["0x1F", "1.5e3", ".5", "é$1", ">>>="]
    s = lambda code: one(spark, lambda c: T.skeleton(T.code_tokens(c)), code)
    assert s("pragma solidity ^0.8.1; uint256 a = b + a + 1; 'x'") == ["uint256", "IDENT_0", "=", "IDENT_1", "+", "IDENT_0", "+", "LITERAL_NUMBER", ";", "LITERAL_STRING"]
    assert s("function f(é x)") == ["function", "IDENT_0", "(", "é", "IDENT_1", ")"] and s("pragma x;") == [] and s("/*") is None


@pytest.mark.parametrize("text", ["x\n\ny\n", "", "a\r\nb\rc", "\n", "no end", "a | b\n|"])
def test_line_numbers_and_back(spark, text):
    lines = re.split(r"\r\n|\r|\n", text)
    lines = lines[:-1] if lines[-1] == "" else lines
    assert one(spark, T.source_lines, text) == lines
    numbered = one(spark, T.numbered, text)
    assert numbered == "\n".join(f"{i:04d} |" + (f" {x}" if x else "") for i, x in enumerate(lines, 1))
    if lines:
        assert one(spark, T.unnumbered, numbered) == "\n".join(lines)


def test_wide_line_numbers(spark):
    assert one(spark, T.numbered, "x\n" * 10_001).split("\n")[-1] == "10001 | x"


def test_citations_and_sentences(spark):
    assert one(spark, T.citations, "see lines 4-7, 9 and 12; line 3") == [4, 7, 9, 12, 3]
    assert one(spark, T.citations, "deadline 3") == []
    assert one(spark, T.last_sentence, " One. Two!  It is absent. ") == "It is absent."
    assert one(spark, T.last_sentence, "") == ""
    assert one(spark, T.stripped, "\u2003 PRESENT\n") == "PRESENT"


def test_strict_json(spark):
    ok = lambda raw: one(spark, lambda c: F.to_json(parsed(c)), raw)
    assert ok('{"b":1,"a":[2]}') == '{"a":[2],"b":1}'
    for bad in ('{"a":1}}', '{"a":1} {"b":2}', '{"a":1}] [2', '1} {"x":2', "1,2", '{"a":1,"a":2}', "", "nope", '{"x":{"a":1,"a":2}}'):
        assert ok(bad) is None, bad


def test_near_clone_pairs_equal_brute_force(spark):
    from lumenweir.operators.similarity import near_clone_pairs, shingles

    rnd = random.Random(3)
    docs = []
    for i in range(60):
        w = [f"w{rnd.randint(0, 30)}" for _ in range(rnd.randint(3, 40))] if i % 3 == 0 or not docs else [x if rnd.random() > 0.03 else "q" for x in docs[-1][1]]
        docs.append((i, w))
    df = spark.createDataFrame(docs, "key bigint, tokens array<string>")
    got = {(r.left, r.right): (r.shared, r.score) for r in near_clone_pairs(df.select("key", F.size("tokens").alias("n"), shingles(F.col("tokens")).alias("grams"))).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, w in docs]
    want = {}
    for a in range(60):
        for b in range(a + 1, 60):
            u = len(sets[a] | sets[b])
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / u >= 0.85 and min(len(docs[a][1]), len(docs[b][1])) >= 0.8 * max(len(docs[a][1]), len(docs[b][1])):
                want[a, b] = (len(sets[a] & sets[b]), round(len(sets[a] & sets[b]) / u, 4))
    assert got.keys() == want.keys() and all(got[k][0] == v[0] and abs(got[k][1] - v[1]) < 2e-4 for k, v in want.items())
    assert got


def test_memory_of_skeletons_does_not_grow_with_the_batch():
    """Many lists in one batch are renamed a run at a time, each by itself."""
    rows = [[f"n{(i * 7 + k) % 50}" if k % 3 else "pragma" if k == 60 else ";" for k in range(150)] if i % 10 else None for i in range(4000)]
    rows[5], rows[6] = [], [f"m{k % 9}" for k in range(70_000)]
    column = pa.array(rows, pa.list_(pa.string()))
    tracemalloc.start()
    out = T.renamed(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 << 20
    assert len(out) == 4000 and out[10].as_py() is None and out[5].as_py() == [] and len(out[6]) == 70_000
    some = [1, 5, 6, 10, 437, 438, 3999]
    assert [out[i].as_py() for i in some] == [T.renamed(pa.array([rows[i]], column.type))[0].as_py() for i in some]
    assert T.renamed(column.slice(0, 0)).to_pylist() == [] and T.renamed(column.slice(3, 9)).to_pylist() == out.slice(3, 9).to_pylist()
