import random

import pytest
from pyspark.sql import functions as F

from lumenweir.operators import generation as G


def echo(prompts):
    return [p[::-1] for p in prompts]


def records(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = [(i, "x" * k if k else None, k) for i in range(n) for k in [rnd.choice([0, 1, 5, 40, rnd.randint(1, 90)])]]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "id bigint, prompt string, tokens bigint")


@pytest.mark.parametrize("budget", [90, 400, 100_000])
def test_each_row_once_and_no_batch_over_budget(spark, budget):
    got = G.generated(records(spark), echo, budget, 5).collect()
    assert sorted(r.id for r in got) == list(range(300))
    assert all(r.raw == (r.prompt or "")[::-1] and r.batch_tokens <= budget and r.batch_tokens >= r.tokens for r in got)


def test_answers_do_not_depend_on_order_or_parts(spark):
    answer = lambda df, parts: sorted((r.id, r.raw) for r in G.generated(df, echo, 200, parts).collect())
    assert answer(records(spark), 1) == answer(records(spark).orderBy(F.desc("id")), 7)


def test_batches_have_prompts_of_like_length(spark):
    sizes = sorted([3] * 50 + [40] * 20 + [90])
    runs = list(G.budgeted(sizes, 120))
    assert [z for _, z in runs][:-1] == [a for a, _ in runs][1:] and runs[0][0] == 0 and runs[-1][1] == 71
    assert all((z - a) * sizes[z - 1] <= 120 for a, z in runs) and list(G.budgeted([], 5)) == []


def test_prompt_over_budget_and_missing_answers_are_errors(spark):
    with pytest.raises(Exception, match="over the budget of 60"):
        G.generated(records(spark), echo, 60).collect()
    with pytest.raises(Exception, match="answers to"):
        G.generated(records(spark), lambda p: p[1:], 1000).collect()


def test_empty_table(spark):
    assert G.generated(records(spark).limit(0), echo, 10).count() == 0
