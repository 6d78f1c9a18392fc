"""Answers of a model to prompts: batches of like length within a token budget, and the predictions made of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def budgeted(sizes: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of prompts in order of size whose padded tokens (rows times the longest) stay within the budget."""
    first = 0
    for i in range(1, len(sizes) + 1):
        if i == len(sizes) or (i + 1 - first) * sizes[i] > budget:
            yield first, i
            first = i


def generated(records: DataFrame, model: Callable[[list[str]], list[str]], budget: int, parts: int | None = None) -> DataFrame:
    """records (id, prompt, tokens, ...) with raw, the model's answer, and batch_tokens, the padded tokens of the batch it came in.

    Rows are dealt by ranges of tokens and sorted, so that a batch has prompts of like length and little padding; parts is how
    many ranges (None: as many as shuffle partitions). Each row is answered once, whatever the order and the batches; a prompt
    over the budget is an error, a null prompt counts as empty. The model runs in the tasks and is called with each batch's
    prompts.
    """
    schema = records.schema
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", raw string, batch_tokens bigint"
    names = [f.name for f in schema.fields]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("tokens").to_pylist()
            prompts = [x or "" for x in b.column("prompt").to_pylist()]
            raw: list[str] = []
            padded: list[int] = []
            for first, end in budgeted(sizes, budget):
                if sizes[end - 1] > budget:
                    raise ValueError(f"a prompt of {sizes[end - 1]} tokens is over the budget of {budget}")
                said = model(prompts[first:end])
                if len(said) != end - first:
                    raise ValueError(f"{len(said)} answers to {end - first} prompts")
                raw += said
                padded += [(end - first) * sizes[end - 1]] * (end - first)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(raw, pa.string()), pa.array(padded, pa.int64())], [*names, "raw", "batch_tokens"])

    by = ["tokens", "id"]
    dealt = records.repartitionByRange(parts, *by) if parts else records.repartitionByRange(*by)
    return dealt.sortWithinPartitions(*by).mapInArrow(answer, kind)


def predictions(answers: DataFrame, predicted: Column) -> DataFrame:
    """id, gold, predicted, raw, collection, group_id, pragma_minor, line_count of generated() rows that carry the others; predicted is a
    verdict column over raw (see functions.reports), INVALID where it is neither label."""
    verdict = F.when(predicted.isin("PRESENT", "ABSENT"), predicted).otherwise("INVALID")
    return answers.select("id", "gold", verdict.alias("predicted"), "raw", "collection", "group_id", "pragma_minor", F.col("line_count").cast("bigint").alias("line_count"))
