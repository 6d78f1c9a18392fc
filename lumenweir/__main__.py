"""Run a registered query, or one of the commands, over Parquet tables.

    python -m lumenweir NAME --data DIR [--out DIR]             a registered query (--list names them)
    python -m lumenweir build_release --data CORPUS --out DIR [--config JSON]
    python -m lumenweir schemas --out DIR                       the JSON Schemas of reports and answers
    python -m lumenweir prompts --data ROWS --out DIR --split S [--pilot N] [--ceiling] [--log LOG] [--max-invocations N] [--schema FILE]
    python -m lumenweir build_records --data ROWS --log LOG --out DIR [--most-tokens N]
    python -m lumenweir evaluate --data GOLD --predictions PREDICTIONS --out DIR
"""

from __future__ import annotations

import argparse
import json
import sys

from lumenweir.plans import catalogue

SYSTEMS = {"label": "Answer with one word.", "report": "Explain, then answer.", "report_vf": "Answer, then explain."}


def build_release(spark, o) -> None:
    from lumenweir.plans import release as L

    given = json.loads(open(o.config, encoding="utf-8").read()) if o.config else {}
    config = L.ReleaseConfig(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})  # unknown keys are errors
    out = L.build_release(spark.read.parquet(o.data), config)
    for name in out.names:
        df = getattr(out, name)
        (df.write.partitionBy("partition") if name == "rows" else df.write).mode("overwrite").parquet(f"{o.out}/{name}")


def schemas(spark, o) -> None:
    from pathlib import Path

    from lumenweir.functions import json_schema as S
    from lumenweir.functions import reports as R

    Path(o.out).mkdir(parents=True, exist_ok=True)
    for name, schema in {"answer": R.answer_schema(), **{f"report_{k}": R.report_schema(k) for k in R.ORDERS}}.items():
        Path(o.out, f"{name}.json").write_text(S.schema_text(schema), encoding="utf-8")


def prompts(spark, o) -> None:
    """The rows whose answers a session still needs. The test split needs --ceiling, which excludes --pilot; a pilot is of train.
    A --schema file that isn't the schema of answers any more is an error: the session would ask for another form."""
    from pyspark.sql import functions as F

    from lumenweir.functions import json_schema as S
    from lumenweir.functions.reports import answer_schema
    from lumenweir.operators import attempts as A
    from lumenweir.operators import curation as C
    from lumenweir.sources.readers import whole_text

    if o.schema and S.stale(whole_text(spark, o.schema), answer_schema()):
        raise ValueError(f"stale schema: {o.schema}")
    if (o.split == "test") != o.ceiling:
        raise ValueError("the test split and --ceiling go together")
    if o.pilot and (o.ceiling or o.split != "train"):
        raise ValueError("a pilot is of the train split")
    rows = spark.read.parquet(o.data).filter(F.col("partition") == o.split)
    if o.pilot:
        rows = rows.join(C.pilot_sample(rows, o.pilot, 42).select("query_id"), "query_id", "left_semi")
    if o.log:
        rows = A.pending(rows, spark.read.parquet(o.log), "query_id", "seq", o.max_attempts)
    if o.max_invocations:
        rows = A.capped(rows, o.max_invocations, "query_id")
    rows.write.mode("overwrite").parquet(o.out)


def build_records(spark, o) -> None:
    from lumenweir.plans import release as L

    records, gone = L.build_training_records(spark.read.parquet(o.data), spark.read.parquet(o.log), SYSTEMS, o.most_tokens)
    records.write.partitionBy("condition").mode("overwrite").json(f"{o.out}/records")
    gone.write.mode("overwrite").json(f"{o.out}/exclusions")


def evaluate(spark, o) -> None:
    from lumenweir.plans import release as L

    for name, df in L.evaluate(spark.read.parquet(o.predictions), spark.read.parquet(o.data)).items():
        df.write.mode("overwrite").json(f"{o.out}/{name}")


COMMANDS = {f.__name__: (f, needs) for f, needs in ((build_release, ("out",)), (schemas, ("out",)), (prompts, ("out", "split")), (build_records, ("out", "log")), (evaluate, ("out", "predictions")))}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lumenweir", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("name", nargs="?")
    p.add_argument("--data", default="/root/testdata/sf0.001")
    p.add_argument("--out", help="write here instead of showing rows")
    p.add_argument("--list", action="store_true")
    for name in ("--config", "--log", "--predictions", "--schema"):
        p.add_argument(name)
    p.add_argument("--split", choices=("train", "validation", "test"))
    p.add_argument("--ceiling", action="store_true")
    for name, default in (("--pilot", 0), ("--max-invocations", 0), ("--max-attempts", 3), ("--most-tokens", 4096)):
        p.add_argument(name, type=int, default=default)
    o = p.parse_args(args)
    if o.list or not o.name:
        print("\n".join([*sorted(COMMANDS), *sorted(catalogue.QUERIES)]))
        return 0
    run, needs = COMMANDS.get(o.name, (None, ()))
    if run is None and o.name not in catalogue.QUERIES:
        print(f"no query or command {o.name}", file=sys.stderr)
        return 1
    if missing := [f"--{x}" for x in needs if not getattr(o, x)]:
        print(f"{o.name} needs {' '.join(missing)}", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lumenweir").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if run is not None:
        run(spark, o)
        return 0
    df = catalogue.QUERIES[o.name](spark, o.data)
    if o.out:
        df.write.mode("overwrite").parquet(o.out)
    else:
        df.show(20, 80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
