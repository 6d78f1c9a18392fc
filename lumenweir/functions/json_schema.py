"""JSON Schema documents compiled into Columns, so that values are checked where they lie, without Python workers.

Supported: type, enum, const; minLength, maxLength, pattern; minimum, maximum and their exclusive forms; properties, required,
additionalProperties, minProperties, maxProperties; items, prefixItems, minItems, maxItems, uniqueItems; allOf, anyOf, oneOf,
not; if, then, else; $ref into the same document. Any other keyword that would restrict a value is an error, so that no part
of a schema is passed over in silence; so is a recursive $ref, as a Column has a fixed depth.

Strict where the standard is lenient: an integer is a whole number within 64 bits written without fraction or exponent. Patterns
are Java's, with Unicode classes. Other numbers are compared as doubles.

Every value is bound to a name before its rules are applied, so a text is parsed once and a member taken once: all members that
a schema names are taken out of an object by one cast, all elements out of an array by another.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenweir.functions.strict_json import parsed

#: Keywords that say something about a schema, not about a value.
ANNOTATIONS = frozenset({"$schema", "$id", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "format"})
WHOLE = r"^(?:TINYINT|SMALLINT|INT|BIGINT)$"
NUMBER = r"^(?:TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\(.*\))$"

Check = Callable[[Column], Column]


def _all(checks: list[Column]) -> Column:
    return reduce(Column.__and__, checks, F.lit(True))


def _any(checks: list[Column]) -> Column:
    return reduce(Column.__or__, checks, F.lit(False))


def _bound_once(value: Column, body: Check) -> Column:
    """body of a value that is computed once, however often body names it: a Column that is merely named twice may be computed
    twice within conditions and lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kind(value: Column) -> Column:
    """object, array, or the type of a scalar. Casts to nothing tell containers apart; naming their types would walk all of
    what they hold."""
    return F.when(_as(value, "struct<>").isNotNull(), "object").when(_as(value, "array<struct<>>").isNotNull(), "array").otherwise(F.schema_of_variant(value))


#: Keywords whose schemas say something about the same value.
SAME = ("allOf", "anyOf", "oneOf", "not", "if", "then", "else")
#: Keywords that concern objects and arrays only.
OF_OBJECTS = ("properties", "required", "additionalProperties", "minProperties", "maxProperties")
OF_ARRAYS = ("items", "prefixItems", "uniqueItems", "minItems", "maxItems")


def _parts(schema, root, seen: tuple[str, ...] = ()) -> list[dict]:
    """The schema and all others that are applied to the same value."""
    if not isinstance(schema, dict):
        return []
    below = [s for k in SAME if k in schema for s in (schema[k] if isinstance(schema[k], list) else [schema[k]])]
    ref = schema.get("$ref")
    out = [] if ref is None or ref in seen else _parts(_target(root, ref), root, (*seen, ref))
    return [schema, *out, *(x for s in below for x in _parts(s, root, seen))]


class _Bound:
    """A value that is bound to a name, with its kind, the members that its schema names, and its elements."""

    def __init__(self, bound: Column, names: list[str], listed: bool):
        self.value, self.kind, self.names = bound["v"], bound["k"], names
        self.fields = bound["f"] if names else None
        self.elements = bound["i"] if listed else None

    def member(self, name: str) -> Column:
        return self.fields.getField(name) if name in self.names else _member(self.value, name)

    def items(self) -> Column:
        return _items(self.value) if self.elements is None else self.elements


def _with_bound(value: Column, schema, root, body: Callable[[_Bound], Column]) -> Column:
    """body of a value, bound once with what its schema asks of it."""
    parts = _parts(schema, root)
    names = sorted({k for s in parts for k in (*s.get("properties", {}), *s.get("required", []))})
    if len({k.lower() for k in names}) < len(names):  # a struct's fields are found whatever their case
        names = []
    types = {k for s in parts for k in ([s["type"]] if isinstance(s.get("type"), str) else s.get("type", []))}
    objects = "object" in types or any(k in s for s in parts for k in OF_OBJECTS)
    listed = any(k in s for s in parts for k in OF_ARRAYS)
    taken = [value.alias("v")]
    if names:
        taken.append(_as(value, f"struct<{','.join('`' + k.replace('`', '``') + '`:variant' for k in names)}>").alias("f"))
    if listed:
        taken.append(_items(value).alias("i"))

    def told(v: Column, b: Column | None = None) -> Column:
        kind = F.schema_of_variant(v)  # of a container that no keyword concerns, all of it is named
        if listed or "array" in types:
            kind = F.when((b["i"] if listed else _as(v, "array<struct<>>")).isNotNull(), "array").otherwise(kind)
        if objects:
            kind = F.when((b["f"] if names else _as(v, "struct<>")).isNotNull(), "object").otherwise(kind)
        return F.struct(v.alias("v"), kind.alias("k"), *(b[c].alias(c) for c, has in (("f", names), ("i", listed)) if has))

    holds = lambda c: body(_Bound(c, names, listed))
    if not names and not listed:
        return _bound_once(told(value), holds)
    return _bound_once(F.struct(*taken), lambda b: _bound_once(told(b["v"], b), holds))


def _is(value: Column, kind: str, got: Column | None = None) -> Column:
    """Whether a value is of this JSON type; `got` is its _kind(), where that is known."""
    got = _kind(value) if got is None else got
    if kind in ("integer", "number"):
        return got.rlike(WHOLE if kind == "integer" else NUMBER)
    names = {"object": "object", "array": "array", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}
    if kind not in names:
        raise ValueError(f"no JSON type {kind!r}")
    return got == names[kind]


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def _members(value: Column) -> Column:
    return _as(value, "map<string,variant>")


def _items(value: Column) -> Column:
    return _as(value, "array<variant>")


def _member(value: Column, name: str) -> Column:
    """A member by its name, null if there is none (a JSON null is a variant, not null)."""
    return F.try_variant_get(value, f"$.{name}", "variant") if re.fullmatch(r"[A-Za-z_]\w*", name) else F.try_element_at(_members(value), F.lit(name))


def _same(value: Column, want, got: Column | None = None) -> Column:
    """Whether value is this JSON value; 1 and 1.0 are the same number. `got` is its kind, if it is a scalar."""
    if want is None:
        return _is(value, "null", got)
    if isinstance(want, bool):
        return _is(value, "boolean", got) & (_as(value, "boolean") == F.lit(want))
    if isinstance(want, (int, float)):
        whole = F.lit(str(int(want))).cast("decimal(38,0)") == _as(value, "bigint") if want == int(want) else F.lit(False)
        return _is(value, "number", got) & F.when(_is(value, "integer", got), whole).otherwise(_as(value, "double") == F.lit(float(want)))
    if isinstance(want, str):
        return _is(value, "string", got) & (_as(value, "string") == F.lit(want))
    if isinstance(want, list):
        each = [F.coalesce(_same(F.get(_items(value), F.lit(i)), x), F.lit(False)) for i, x in enumerate(want)]
        return _is(value, "array") & (F.size(_items(value)) == len(want)) & _all(each)
    each = [F.coalesce(_same(_member(value, k), x), F.lit(False)) for k, x in want.items()]
    return _is(value, "object") & (F.size(_members(value)) == len(want)) & _all(each)


def _bound(value: Column, got: Column, limit: float, lower: bool, open_: bool) -> Column:
    # the nearest whole number inside the limit, for whole values; the limit itself for others
    edge = (floor(limit) + 1 if open_ else ceil(limit)) if lower else (ceil(limit) - 1 if open_ else floor(limit))
    whole, edge = _as(value, "bigint"), F.lit(str(edge)).cast("decimal(38,0)")
    other, limit = _as(value, "double"), F.lit(float(limit))
    near = (other > limit if open_ else other >= limit) if lower else (other < limit if open_ else other <= limit)
    return F.when(_is(value, "integer", got), whole >= edge if lower else whole <= edge).otherwise(near)


def _target(root, ref: str):
    if not ref.startswith("#"):
        raise ValueError(f"$ref outside the document: {ref}")
    at = root
    for step in ref[1:].split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        at = at[int(step)] if isinstance(at, list) else at[step]
    return at


def _check(value: Column, schema, root, within: tuple[str, ...], missing: bool = True) -> Column:
    """Whether a value conforms; one that isn't there conforms if `missing` says so. `within` are the references that led here."""
    holds = lambda b: _rules(b, schema, root, within)
    return _with_bound(value, schema, root, lambda b: b.value.isNull() | holds(b) if missing else b.value.isNotNull() & holds(b))


def _rules(bound: _Bound, schema, root, within: tuple[str, ...]) -> Column:
    """Whether a value that is there conforms."""
    if isinstance(schema, bool):
        return F.lit(schema)
    below = lambda v, s: _check(v, s, root, within)
    same = lambda s: _rules(bound, s, root, within)
    value, got = bound.value, bound.kind
    told: set[str] = set()
    out: list[Column] = []

    def on(kind: str | None, keyword: str, test: Callable[[object], Column]) -> None:
        """A keyword's test; it only concerns values of its kind."""
        if keyword in schema:
            told.add(keyword)
            out.append(test(schema[keyword]) if kind is None else ~_is(value, kind, got) | test(schema[keyword]))

    text, members, items = _as(value, "string"), _members(value), bound.items()
    keys, length = F.map_keys(_as(value, "map<string,struct<>>")), F.size(items)
    known, first = list(schema.get("properties", {})), schema.get("prefixItems", [])
    on(None, "type", lambda x: _any([_is(value, k, got) for k in ([x] if isinstance(x, str) else x)]))
    on(None, "const", lambda x: _same(value, x, got))
    on(None, "enum", lambda x: _is(value, "string", got) & text.isin(*x) if x and all(isinstance(v, str) for v in x) else _any([_same(value, v, got) for v in x]))
    on("string", "minLength", lambda x: F.length(text) >= x)
    on("string", "maxLength", lambda x: F.length(text) <= x)
    on("string", "pattern", lambda x: text.rlike(f"(?U){x}"))
    for keyword, lower, open_ in (("minimum", True, False), ("exclusiveMinimum", True, True), ("maximum", False, False), ("exclusiveMaximum", False, True)):
        on("number", keyword, lambda x, lower=lower, open_=open_: _bound(value, got, x, lower, open_))
    on("object", "properties", lambda x: _all([below(bound.member(k), s) for k, s in x.items()]))
    on("object", "required", lambda x: _all([bound.member(k).isNotNull() for k in x]))
    on("object", "minProperties", lambda x: F.size(keys) >= x)
    on("object", "maxProperties", lambda x: F.size(keys) <= x)

    def others(x) -> Column:
        if x is False and all(k in bound.names for k in known):
            return F.size(keys) == reduce(Column.__add__, [bound.member(k).isNotNull().cast("int") for k in known], F.lit(0))
        if x is False:
            return F.size(F.array_except(keys, F.array(*map(F.lit, known)).cast("array<string>"))) == 0
        mine = F.map_filter(members, lambda k, _: ~k.isin(*known)) if known else members
        return F.forall(F.map_values(mine), lambda v: below(v, x))

    on("object", "additionalProperties", others)
    on("array", "prefixItems", lambda x: _all([below(F.get(items, F.lit(i)), s) for i, s in enumerate(x)]))
    rest = F.slice(items, len(first) + 1, F.greatest(F.size(items) - len(first), F.lit(0))) if first else items
    on("array", "items", lambda x: F.forall(rest, lambda v: below(v, x)))
    on("array", "minItems", lambda x: length >= x)
    on("array", "maxItems", lambda x: length <= x)
    on("array", "uniqueItems", lambda x: F.size(F.array_distinct(F.transform(items, lambda v: F.to_json(F.struct(v.alias("v")))))) == F.size(items) if x else F.lit(True))
    on(None, "allOf", lambda x: _all([same(s) for s in x]))
    on(None, "anyOf", lambda x: _any([same(s) for s in x]))
    on(None, "oneOf", lambda x: reduce(Column.__add__, [same(s).cast("int") for s in x]) == 1)
    on(None, "not", lambda x: ~same(x))
    on(None, "if", lambda x: F.when(same(x), same(schema.get("then", True))).otherwise(same(schema.get("else", True))))
    told |= {"then", "else"}

    def referred(x: str) -> Column:
        if x in within:
            raise ValueError(f"recursive $ref: {x}")
        return _rules(bound, _target(root, x), root, (*within, x))

    on(None, "$ref", referred)
    if left := set(schema) - told - ANNOTATIONS:
        raise ValueError(f"unsupported keywords: {sorted(left)}")
    return _all(out)


def conforms(value: Column, schema: dict | bool) -> Column:
    """Whether a variant conforms to a JSON Schema document; false where it is null, that is, where nothing was parsed."""
    return F.coalesce(_bound_once(value, lambda v: _check(v, schema, schema, (), missing=False)), F.lit(False))


def valid_json(raw: Column, schema: dict, ordered: bool = False) -> Column:
    """Whether raw is one JSON text, without repeated keys, that conforms. `ordered` also wants its own keys to be those of
    the schema's properties that it has, in their order, which no schema can say."""
    good = conforms(parsed(raw), schema)
    if not ordered:
        return good
    order, got = F.array(*map(F.lit, schema.get("properties", {}))), F.json_object_keys(raw)
    return good & F.coalesce(got == F.filter(order, lambda k: F.array_contains(got, k)), F.lit(False))


def schema_text(schema: dict) -> str:
    """The document as it is published: the order of keys is part of it, as answers are written in that order."""
    return json.dumps(schema, indent=2, ensure_ascii=False) + "\n"


def stale(published: str | None, schema: dict) -> bool:
    """Whether a published document is missing, is no JSON, or says another thing than schema: other values or another
    order of properties. White space doesn't count."""
    try:
        return published is None or json.dumps(json.loads(published)) != json.dumps(schema)
    except ValueError:
        return True
