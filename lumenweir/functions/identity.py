"""Hashes that name things by their content, and orders that a seed fixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha(text: Column) -> Column:
    return F.sha2(text, 256)


def list_digest(values: Column) -> Column:
    """SHA-256 of a string array's compact JSON."""
    return sha(F.to_json(values))


def code_identity(tokens: Column) -> Column:
    """Name of a token list; null for an empty list."""
    return F.when(F.size(tokens) > 0, list_digest(tokens))


def seeded(seed: int, key: Column) -> Column:
    """A fixed pseudo-random order: the SHA-256 of the JSON array of seed and key."""
    return sha(F.concat(F.lit(f'[{seed},"'), key.cast("string"), F.lit('"]')))


def drawn(key: Column, n: int | Column) -> Column:
    """A number below n from the first 32 bits of the key's SHA-256."""
    return F.pmod(F.conv(F.substring(sha(key), 1, 8), 16, 10).cast("bigint"), n if isinstance(n, Column) else F.lit(n))


def group_id(members: Column) -> Column:
    """Name of a group: digest of its members in order of their text."""
    return list_digest(F.array_sort(members))


def rounded(x: Column, digits: int) -> Column:
    """Half-even on the decimal value, as closest to rounding a binary value."""
    return F.bround(x, digits)
