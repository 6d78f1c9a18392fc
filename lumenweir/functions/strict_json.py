"""Strict JSON parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(raw: Column) -> Column:
    """The variant of a JSON text; null if it isn't JSON as a whole or repeats a key at any depth.

    The parser stops after the first value, so what follows it would be ignored; a text that is one value also parses
    inside an array and inside an object, and no other text does both.
    """
    alone = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), raw, F.lit("}"))).isNotNull()
    return F.when(alone, F.try_parse_json(raw))
