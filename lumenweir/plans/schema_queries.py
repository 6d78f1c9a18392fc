"""Queries over JSON texts checked against JSON Schema documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweir.functions import json_schema as S
from lumenweir.functions import reports as R
from lumenweir.functions.strict_json import parsed
from lumenweir.plans.report_queries import LINES, RAW, raw_rows
from lumenweir.sources.tables import table

ITEM = {
    "type": "object",
    "properties": {
        "line": {"type": "integer", "minimum": 1},
        "part": {"type": "integer", "exclusiveMinimum": 0},
        "quantity": {"type": "number", "exclusiveMinimum": 0, "maximum": 49},
        "flag": {"$ref": "#/$defs/flag"},
        "discount": {"anyOf": [{"type": "number", "minimum": 0, "maximum": 0.1}, {"type": "null"}]},
    },
    "required": ["line", "part", "quantity", "flag"],
    "additionalProperties": False,
}
#: An order with its items: nested objects in an array, references, and a rule on whether the order is open.
ORDER = {
    "$defs": {"flag": {"enum": ["A", "N", "R"]}, "item": ITEM},
    "type": "object",
    "properties": {
        "order": {"type": "integer"},
        "status": {"enum": ["F", "O", "P"]},
        "priority": {"type": "string", "pattern": "^[1-4]-"},
        "items": {"type": "array", "minItems": 1, "maxItems": 6, "items": {"$ref": "#/$defs/item"}},
    },
    "required": ["order", "status", "items"],
    "additionalProperties": False,
    "if": {"properties": {"status": {"const": "O"}}},
    "then": {"properties": {"items": {"items": {"properties": {"flag": {"not": {"const": "R"}}}}}}},
}


def order_texts(spark, d) -> DataFrame:
    """order, raw: each order as a JSON text with its items, a few by their nature."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("discount"))).alias("items")
    )
    orders = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    kind = items.schema["items"].dataType.simpleString()
    return orders.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.coalesce("items", F.array().cast(kind)).alias("items"))).alias("raw"))


def order_documents_conform(spark, d) -> DataFrame:
    return order_texts(spark, d).select("o_orderkey", S.valid_json(F.col("raw"), ORDER, ordered=True).alias("valid"))


def verdict_by_schema(raw: Column, lines: Column, order: str) -> Column:
    """The verdict of a report that its schema admits; what the schema can't say is that the lines lie within the source."""
    tree = parsed(raw)
    start, end = (F.try_variant_get(tree, f"$.location.{k}_line", "bigint") for k in ("start", "end"))
    inside = F.coalesce((start <= end) & (end <= lines), F.lit(True))
    return F.when(S.valid_json(raw, R.report_schema(order), ordered=True) & inside, F.try_variant_get(tree, "$.verdict", "string")).otherwise("INVALID")


def report_schema_verdicts(spark, d) -> DataFrame:
    r = raw_rows(spark, d)
    return r.select("query_id", *(verdict_by_schema(F.col("raw"), F.lit(LINES), o).alias(o) for o in R.ORDERS))


_F = (order_documents_conform, report_schema_verdicts)
QUERIES = {f.__name__: f for f in _F}
SQL = {
    "order_documents_conform": """WITH i AS (SELECT l_orderkey, count(*) AS n, bool_and(l_linenumber >= 1 AND l_partkey > 0 AND l_quantity > 0 AND l_quantity <= 49 AND l_returnflag IN ('A', 'N', 'R') AND coalesce(l_discount BETWEEN 0 AND 0.1, TRUE)) AS fine,
          bool_or(l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1)
        SELECT o_orderkey, coalesce(n BETWEEN 1 AND 6 AND fine AND o_orderstatus IN ('F', 'O', 'P') AND o_orderpriority ~ '^[1-4]-.*' AND NOT (o_orderstatus = 'O' AND returned), FALSE) AS valid FROM orders LEFT JOIN i ON l_orderkey = o_orderkey""",
    "report_schema_verdicts": RAW + " SELECT i AS query_id, CASE WHEN body AND keys = ['analysis', 'verdict', 'location'] THEN verdict ELSE 'INVALID' END AS analysis_first, CASE WHEN body AND keys = ['verdict', 'analysis', 'location'] THEN verdict ELSE 'INVALID' END AS verdict_first FROM b",
}
