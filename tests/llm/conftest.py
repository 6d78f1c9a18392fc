import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from texts, or (doc_id, text) or (doc_id, text, source) rows, with extra columns that clash with operators' own names."""

    def make(rows, clash=True):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            full.append((r[0], r[1], "en", r[2] if len(r) > 2 else f"src{i % 3}", len(r[1]) if r[1] else None))
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            for name in ("length", "piece", "key", "kept", "n", "h", "fp", "component_id", "position", "sequence_id", "p", "k1"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, tiny, repeated, wide and very long texts."""
    rnd = random.Random(5)
    words = ["the", "of", "Éleè", "ñandu", "x", "***", "ing", "ßtraße", "😀", "and,", "漢字"]
    long = " ".join(rnd.choice(words) for _ in range(60_000))
    return [None, "", " ", "\n\t ", "a", "a b", "a b", "one two three four", long, long, "x" * 300_000, "é b c \x1c d", "a\n\nb\nb\n a"]
