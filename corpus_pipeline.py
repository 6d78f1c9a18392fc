"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Quality rules reject documents, exact and near copies go down to one, all that is left is written in the order
of the mix of the sources to their target weights, and packed into sequences that are numbered in that order. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import re
from itertools import accumulate

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweir.llm.common import documents, stored
from lumenweir.llm.exact import without_copies
from lumenweir.llm.mixing import mixed
from lumenweir.llm.near import without_near_copies
from lumenweir.llm.packing import packed_documents
from lumenweir.llm.quality import quality_rules


#: Similarity of near copies, in percent of five-word shingles.
NEAR_PERCENT = 80
#: More pieces than a document has, in the numbers of sequences.
MOST_PIECES = 1 << 22


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the target is fitted on the labels of sf_dir, the raw side on docs.

    Null and empty texts have no words and go. Equal rows share their fate; null doc_ids are judged like others, but are
    never trusted. An empty table gives an empty one; all columns pass through, whatever their names.
    """
    verdict = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(every, verdict.alias("verdict")).filter("verdict.kept").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, that of the largest doc_id.

    A null text counts as empty; null doc_ids are smaller than all others; of rows that repeat doc_id and text one stays.
    An empty table gives an empty one; all columns pass through.
    """
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that of the smallest doc_id; links begin at 0.8.

    Texts without words are linked with nothing and stay. Rows that share a doc_id, or have none, are told apart by their
    texts; equal rows share their fate. An empty table gives an empty one; all columns pass through.
    """
    return without_near_copies(docs, NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, those beyond the slot at which a source runs out too.

    Null sources are a source of their own; repeated rows take places of their own; an empty table gives an empty one. All columns pass through, but a column named mix.
    """
    rows = mixed(docs)
    return rows.repartitionByRange("mix.slot", "mix.place").sortWithinPartitions("mix.slot", "mix.place").select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != "mix"))


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the position of each row: its place in docs as the files hold it. What is not read from files is stored first."""
    try:
        rows = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:
        return in_order(stored(docs.select("doc_id", "text"), "ordered"))
    files = rows.groupBy("file").agg(F.max("at").alias("last")).collect()  # one row for each file
    number = lambda path: int((re.search(r"/part-(\d+)[^/]*$", path) or [0, 0])[1])
    files = sorted(files, key=lambda r: (number(r.file), r.file))
    begins = accumulate((r.last + 1 for r in files), initial=0)
    before = docs.sparkSession.createDataFrame([(r.file, b) for r, b in zip(files, begins, strict=False)], "file string, before bigint")
    return rows.join(F.broadcast(before), "file").select("doc_id", "text", (F.col("before") + F.col("at")).alias("position"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every document and their places in sequences of at most 2048 tokens, numbered in the order of docs.

    A sequence stands where the first of its pieces does: read by sequence_id, the sequences follow the mix. Its number is that
    piece's position in docs and its own number. A null or empty text is one piece of its end mark. Null doc_ids and repeated
    rows are packed like others; an empty table gives an empty result; other columns are not read.
    """
    docs = in_order(docs)
    packed = packed_documents(docs.select(F.col("position").alias("doc_id"), "text"), public_tokenizers.path("word_bpe_49k.json"))
    packed = stored(packed.withColumnRenamed("doc_id", "position"), "packed")
    names = packed.groupBy("sequence_id").agg(F.min(F.struct("position", "piece")).alias("first"))
    names = names.select("sequence_id", (F.col("first.position") * MOST_PIECES + F.col("first.piece")).alias("name"))
    out = packed.join(names, "sequence_id").join(docs.select("doc_id", "position"), "position")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("name").alias("sequence_id"), "offset")


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("source_mix", mix), ("best_fit_packing", pack)]

#: SQL can't express the n-gram scores or the configurations; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
