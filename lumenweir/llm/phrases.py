"""Phrase collocation mining over vertical positional inverted lists.

The corpus is cut into blocks of documents, and a block holds, for each word or phrase in it, the sorted list of the positions
at which it starts. A phrase grows by one word where its list meets the posting of an adjacent word, a merge on positions that
never leaves its block; the lengths of a phrase's lists, summed over all blocks, are its exact frequency. Only what is frequent
is extended. Blocks learn what that is from a bitmap of bounded size, which lets some more through and never less, so that
counts don't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweir.llm import words
from lumenweir.llm.bitmap import Bitmap, bitmap_of
from lumenweir.llm.common import BATCH_ROWS, batches_of, chunked, documents, dropped, stored

LONGEST = 4
LEAST = 30
TOP = 2000
#: A phrase goes if a longer one that holds it has this share of its occurrences, in percent.
HELD = 80
#: Text bytes of a block, and blocks that a Python worker takes at once and a row group of their table holds.
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 8
#: Hash parts in which the first rows of a language are sought before they meet.
PARTS = 64

_SPACE, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
_SPACE[[9, 32]] = True
_SPACE |= _BREAK

COUNTS = "id bigint, head bigint, tail bigint, n bigint"
LISTS = "words array<bigint>, word_n array<int>, word_at array<int>, ids array<bigint>, heads array<bigint>, tails array<bigint>, n array<int>, at array<int>"


def of_lang(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")


def phrase_id(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The identifier of a phrase by those of its first words (all but the last) and its last words (all but the first)."""
    return words.mixed(words.mixed(head) * words.U(3) + tail)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class Tokens:
    """The words of a run of texts: bytes, ids (by language and word), and positions, which are consecutive within a piece only."""

    def __init__(self, lang: list[str], buf: np.ndarray, offs: np.ndarray) -> None:
        self.buf = words.LOWER[buf]
        self.starts, self.ends, first = words.spans(self.buf, offs, _SPACE)
        self.lang = np.repeat(np.arange(len(lang)), np.diff(first))
        salt = {x: of_lang(x) for x in set(lang)}
        salts = np.array([salt[x] for x in lang], words.U)
        self.ids = words.mixed(words.hashes(self.buf, self.starts, self.ends) ^ salts[self.lang])
        gap = np.zeros(len(self.ids), np.int64)
        if len(gap):
            breaks = np.concatenate([[0], np.cumsum(_BREAK[self.buf])])
            gap[1:] = (breaks[self.starts[1:]] != breaks[self.ends[:-1]]) | (self.lang[1:] != self.lang[:-1])
        self.at = np.arange(len(gap)) + np.cumsum(gap)

    def words_at(self, i: np.ndarray) -> pa.Array:
        """The words of these indices as strings."""
        sizes = (self.ends - self.starts)[i]
        offs = np.concatenate([[0], np.cumsum(sizes)])
        inside = np.arange(offs[-1]) + np.repeat(self.starts[i] - offs[:-1], sizes)
        return pa.StringArray.from_buffers(len(i), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(self.buf[inside]))


def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Tokens]]:
    for b in batches:
        lang = b.column("lang").to_pylist()
        for at, end, buf, offs in chunked(b.column("text"), BLOCK_BYTES):
            yield lang[at:end], Tokens(lang[at:end], buf, offs)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, id, n of all words; the row of a null word has the number of all words of its language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, t in tokens_of(batches):
            _, first, n = np.unique(t.ids, return_index=True, return_counts=True)
            totals = np.bincount(t.lang, minlength=len(lang))
            langs = pa.array(lang, pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([langs.take(pa.array(t.lang[first])), langs]), pa.concat_arrays([t.words_at(first), pa.nulls(len(lang), pa.string())]), pa.concat_arrays([signed(t.ids[first]), pa.array(np.zeros(len(lang), np.int64))]), pa.array(np.concatenate([n, totals]))],
                ["lang", "word", "id", "n"],
            )

    return docs.mapInArrow(count, "lang string, word string, id bigint, n bigint").groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


class Lists:
    """The lists of a block: ids of phrases with the numbers and the places of their occurrences, in order within a phrase."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, at: np.ndarray) -> None:
        self.ids, self.n, self.at = ids, n, at

    @classmethod
    def of(cls, ids: np.ndarray, at: np.ndarray) -> Lists:
        """From an id for each place; places ascend."""
        order = np.argsort(ids, kind="stable")
        have, n = np.unique(ids, return_counts=True)
        return cls(have, n, at[order])

    def which(self, size: int) -> np.ndarray:
        """For each position up to size the number of the list that has it, or -1."""
        out = np.full(size, -1, np.int64)
        out[self.at] = np.repeat(np.arange(len(self.ids)), self.n)
        return out

    def kept(self, keep: np.ndarray) -> Lists:
        return Lists(self.ids[keep], self.n[keep], self.at[np.repeat(keep, self.n)])


def extended(phrases: Lists, postings: Lists, length: int) -> tuple[Lists, np.ndarray, np.ndarray]:
    """Lists of the phrases of length + 1 words, with their heads and tails: where a posting of a word meets the end of a phrase,
    and the words from the phrase's second to that one are themselves a phrase of the lists."""
    size = int(max(phrases.at.max(initial=-1), postings.at.max(initial=-1))) + length + 2
    word, phrase = postings.which(size), phrases.which(size)
    at = np.flatnonzero(phrase[: size - length] >= 0)
    at = at[word[at + length] >= 0]
    at = at[phrase[at + 1] >= 0]
    pair = phrase[at] * max(len(phrases.ids), 1) + phrase[at + 1]
    out = Lists.of(pair, at)
    head, tail = np.divmod(out.ids, max(len(phrases.ids), 1))
    head, tail = phrases.ids[head], phrases.ids[tail]
    out.ids = phrase_id(head, tail)
    return out, head, tail


def adjacent(phrases: Lists, postings: Lists, length: int) -> Lists:
    """The postings at the ends of the phrases' occurrences: all that can still extend one."""
    size = int(max(phrases.at.max(initial=-1), postings.at.max(initial=-1))) + length + 2
    reach = np.zeros(size, bool)
    reach[phrases.at + length] = True
    hit = reach[postings.at]
    n = np.add.reduceat(np.append(hit, 0), np.concatenate([[0], np.cumsum(postings.n)[:-1]]).astype(np.int64)) if len(postings.ids) else postings.n
    return Lists(postings.ids[n > 0], n[n > 0], postings.at[hit])


def block_row(postings: Lists, phrases: Lists, head: np.ndarray, tail: np.ndarray) -> pa.RecordBatch:
    columns = [signed(postings.ids), postings.n, postings.at, signed(phrases.ids), signed(head), signed(tail), phrases.n, phrases.at]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    names = [c.split()[0] for c in LISTS.split(", ")]
    arrays = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c, k)) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Lists, Lists, np.ndarray, np.ndarray]]:
    """(postings, phrases, heads, tails) of each row of a table of blocks."""
    for b in batches:
        for i in range(b.num_rows):
            c = [b.column(k)[i].values.to_numpy() for k in range(8)]
            yield Lists(c[0].view(words.U), c[1], c[2]), Lists(c[3].view(words.U), c[6], c[7]), c[4].view(words.U), c[5].view(words.U)


def count_rows(phrases: Lists, head: np.ndarray, tail: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([signed(phrases.ids), signed(head), signed(tail), pa.array(phrases.n, pa.int64())], ["id", "head", "tail", "n"])


def summed(counts: DataFrame, least: int, name: str) -> DataFrame:
    return stored(counts.groupBy("id", "head", "tail").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), name)


def sieve(spark, table: DataFrame):
    """A broadcast bitmap of at most 16 MB of a table's ids, which are 64-bit hashes."""
    return spark.sparkContext.broadcast(bitmap_of(table.select("id"), F.col("id"), table.count()))


def phrase_tables(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, list[DataFrame]]:
    """Stored tables: words (lang, word, id, n), and for each length from 2 the frequent phrases (id, head, tail, n)."""
    spark = docs.sparkSession

    def frequent(t: Tokens, sieve: Bitmap) -> Lists:
        hit = sieve.has(t.ids)
        return Lists.of(t.ids[hit], t.at[hit])

    with batches_of(spark, BATCH_ROWS):
        counted = stored(word_counts(docs).filter((F.col("n") >= least) | F.col("word").isNull()), "words")
        one = sieve(spark, counted.filter(F.col("word").isNotNull()))

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, t in tokens_of(batches):
                postings = frequent(t, one.value)
                yield count_rows(*extended(postings, postings, 1))

        tables = [summed(docs.mapInArrow(pairs, COUNTS), least, "pairs")]
        if longest == 2:
            return counted, tables
        two = sieve(spark, tables[0])

        def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, t in tokens_of(batches):
                postings = frequent(t, one.value)
                phrases, head, tail = extended(postings, postings, 1)
                keep = two.value.has(phrases.ids)
                phrases = phrases.kept(keep)
                yield block_row(adjacent(phrases, postings, 2), phrases, head[keep], tail[keep])

        blocks = stored(docs.mapInArrow(lists, LISTS), "lists", BLOCK_ROWS)
    with batches_of(spark, BLOCK_ROWS):
        for length in range(2, longest):
            blocks = longer(blocks, tables[-1] if length > 2 else None, length)
            each = blocks.select(F.explode(F.arrays_zip("ids", "heads", "tails", "n")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.heads").alias("head"), F.col("x.tails").alias("tail"), F.col("x.n").alias("n"))
            tables.append(summed(each, least, f"phrases_{length + 1}"))
        dropped(blocks)
    return counted, tables


def longer(blocks: DataFrame, frequent: DataFrame | None, length: int) -> DataFrame:
    """The blocks' lists of length + 1 words, from those of `length` words that are frequent (None: all that blocks have)."""
    known = sieve(blocks.sparkSession, frequent) if frequent is not None else None

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for postings, phrases, _, _ in blocks_of(batches):
            if known:
                phrases = phrases.kept(known.value.has(phrases.ids))
            more, head, tail = extended(phrases, postings, length)
            yield block_row(adjacent(more, postings, length + 1), more, head, tail)

    out = stored(blocks.mapInArrow(extend, LISTS), "lists", BLOCK_ROWS)
    dropped(blocks)
    return out


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """lang, phrase (words joined by one space), length, a (its occurrences), firsts and rests (those of its first 1, 2, ... words
    and of what is left after them), longer (the most occurrences of a phrase of one word more that holds it, or 0), n (all
    words of the language) of every phrase of 2 to `longest` words that occurs `least` times or more.

    A-Z are lower-cased; texts are cut at `[.,;:!?]` and line ends into pieces, those at spaces and tabs into words; a phrase
    lies within one piece, and overlaps count. Null text: empty; null lang: `und`. Repeated rows count each. No documents
    or nothing frequent: no rows. Other columns are not read.
    """
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    counted, tables = phrase_tables(docs, longest, least)
    none = F.array().cast("array<bigint>")
    below = counted.filter(F.col("word").isNotNull()).select("id", "lang", F.col("word").alias("phrase"), F.col("n").alias("a"), none.alias("firsts"), none.alias("rests"))
    levels = []
    for k, table in enumerate(tables, 2):
        h = below.select(F.col("id").alias("head"), "lang", F.col("phrase").alias("first"), F.concat("firsts", F.array("a")).alias("firsts"))
        t = below.select(F.col("id").alias("tail"), F.substring_index("phrase", " ", -1).alias("last"), F.concat(F.array("a"), "rests").alias("rests"))
        joined = table.join(h, "head").join(t, "tail")
        below = stored(joined.select("id", "lang", F.concat_ws(" ", "first", "last").alias("phrase"), F.col("n").alias("a"), "firsts", "rests"), f"named_{k}")
        above = tables[k - 1] if k - 1 < len(tables) else None
        if above is None:
            own = below.withColumn("longer", F.lit(0).cast("bigint"))
        else:
            best = above.select("n", F.explode(F.array("head", "tail")).alias("id")).groupBy("id").agg(F.max("n").alias("longer"))
            own = below.join(best, "id", "left").withColumn("longer", F.coalesce("longer", F.lit(0)))
        levels.append(own.select("lang", "phrase", F.lit(k).alias("length"), "a", "firsts", "rests", "longer"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    totals = counted.filter(F.col("word").isNull()).select("lang", "n")
    return out.join(totals, "lang")


def score() -> Column:
    """score, k, l, r of the cut of a phrase that scores lowest, the first one on ties; in decimals of 38 digits."""

    def cut(length: Column, first: Column, rest: Column) -> Column:
        wide = F.lit(2_000_000).cast("decimal(20,0)") * F.col("a").cast("decimal(18,0)")
        return F.struct(F.call_function("div", wide, first + rest).alias("score"), length.alias("k"), first.alias("l"), rest.alias("r"))

    cuts = F.transform(F.arrays_zip("firsts", "rests"), lambda x, i: cut(i + 1, x["firsts"], x["rests"]))
    return F.array_min(cuts)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, held: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases by score, then a, both descending, then phrase.

    score is floor(2000000 * a / (l + r)), a, l and r the occurrences of the phrase and of the two parts of its lowest-scoring
    cut. Phrases that a longer one holds go if it has `held` percent of their occurrences. See phrases() for what counts;
    fewer phrases than `top` are all returned. Of a language, the scores' histogram, which has a million values at most,
    tells the lowest score that can be among the first, so that no task sorts all phrases of one.
    """
    every = phrases(docs, longest, least).filter(F.lit(100).cast("bigint") * F.col("longer") < F.lit(held).cast("bigint") * F.col("a"))
    scored = stored(every.withColumn("s", score()).select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score"), "scored")
    above = F.sum("rows").over(Window.partitionBy("lang").orderBy(F.desc("score"))) - F.col("rows")
    cut = scored.groupBy("lang", "score").agg(F.count("*").alias("rows")).withColumn("above", above).filter(F.col("above") < top).groupBy("lang").agg(F.min("score").alias("cut"))
    few = scored.join(cut, "lang").filter(F.col("score") >= F.col("cut")).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    last = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return last.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


QUERIES = {"op11_phrase_collocations": op11_phrase_collocations}
SQL = {
    "op11_phrase_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        g AS (SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) AS t(k) WHERE len(w) >= k)),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
        totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
        c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS v FROM f WHERE k > 1),
        cuts AS (SELECT c.lang, c.phrase, c.a, c.j, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.a + y.a) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
          JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.v[1:j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.v[j+1:], ' ')),
        low AS (SELECT lang, phrase, a, arg_min(l, score * 10 + j) AS l, arg_min(r, score * 10 + j) AS r, min(score) AS score FROM cuts GROUP BY lang, phrase, a),
        parts AS (SELECT lang, a, s, unnest(range(1, k - s + 2)) AS i, v FROM (SELECT *, unnest(range(2, k)) AS s FROM c WHERE k > 2)),
        held AS (SELECT lang, array_to_string(v[i:i+s-1], ' ') AS phrase, max(a) AS longer FROM parts GROUP BY 1, 2),
        kept AS (SELECT low.* FROM low LEFT JOIN held USING (lang, phrase) WHERE 100 * coalesce(longer, 0) < 80 * low.a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000
    """
}
