"""Strict validation of JSON reports: key order, types without coercion, bounds, cross-field rules; verdicts and statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenweir.functions.strict_json import parsed

ORDERS = {"analysis_first": ("analysis", "verdict", "location"), "verdict_first": ("verdict", "analysis", "location")}
LABELS = ("PRESENT", "ABSENT")
WHOLE = r"^(?:TINYINT|SMALLINT|INT|BIGINT)$"
MOST_ANALYSIS = 1200


def report_schema(order: str = "analysis_first") -> dict:
    """The JSON Schema of a report, its fields in the given order: a location where and only where the verdict is PRESENT."""
    line = {"type": "integer", "minimum": 1}
    place = {"type": "object", "properties": {"start_line": line, "end_line": line, "function": {"type": ["string", "null"]}}, "required": ["start_line", "end_line", "function"], "additionalProperties": False}
    fields = {
        "analysis": {"type": "string", "minLength": 1, "maxLength": MOST_ANALYSIS, "pattern": r"\S"},
        "verdict": {"enum": list(LABELS)},
        "location": {"anyOf": [place, {"type": "null"}]},
    }
    rule = {"if": {"properties": {"verdict": {"const": "PRESENT"}}}, "then": {"properties": {"location": place}}, "else": {"properties": {"location": {"type": "null"}}}}
    return {"type": "object", "properties": {k: fields[k] for k in ORDERS[order]}, "required": list(ORDERS[order]), "additionalProperties": False} | rule


def answer_schema() -> dict:
    """The JSON Schema of an answer: a report, or a reason why there is none."""
    reasons = {"enum": ["INSUFFICIENT_CONTEXT", "UNRESOLVED_ASSUMPTIONS"]}
    fields = {"status": {"enum": ["OK", "UNSUPPORTED"]}, "report": {"anyOf": [report_schema(), {"type": "null"}]}, "reason_code": {"anyOf": [reasons, {"type": "null"}]}}
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


def _part(parsed: Column, path: str) -> Column:
    return F.try_variant_get(parsed, path, "variant")


def _kind(parsed: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(_part(parsed, path)), F.lit("MISSING"))


def _same_keys(raw: Column, keys: list[str], ordered: bool) -> Column:
    got = F.json_object_keys(raw)
    want = F.array(*map(F.lit, keys))
    return F.coalesce(got == want if ordered else F.array_sort(got) == F.array_sort(want), F.lit(False))


def _valid_body(parsed: Column, raw: Column, line_count: Column) -> Column:
    analysis = F.try_variant_get(parsed, "$.analysis", "string")
    verdict = F.try_variant_get(parsed, "$.verdict", "string")
    place = F.to_json(_part(parsed, "$.location"))
    start, end = (F.try_variant_get(parsed, f"$.location.{k}_line", "bigint") for k in ("start", "end"))
    located = (
        _same_keys(place, ["start_line", "end_line", "function"], False)
        & _kind(parsed, "$.location.start_line").rlike(WHOLE)
        & _kind(parsed, "$.location.end_line").rlike(WHOLE)
        & _kind(parsed, "$.location.function").isin("STRING", "VOID")
        & (start >= 1)
        & (end >= start)
        & (end <= line_count)
    )
    texts = (
        (_kind(parsed, "$.analysis") == "STRING")
        & F.length(analysis).between(1, MOST_ANALYSIS)
        & analysis.rlike(r"(?U)\S")
        & (_kind(parsed, "$.verdict") == "STRING")
        & verdict.isin(*LABELS)
    )
    fits = F.when(verdict == "PRESENT", located).otherwise(_kind(parsed, "$.location") == "VOID")
    return F.coalesce(texts & fits, F.lit(False))


def valid_report(raw: Column, line_count: Column, order: str = "analysis_first") -> Column:
    """Whether raw is a report: JSON without repeated keys, exactly these keys in this order, strict types, bounds, and a
    location where and only where the verdict is PRESENT."""
    tree = parsed(raw)
    return tree.isNotNull() & _same_keys(raw, list(ORDERS[order]), True) & _valid_body(tree, raw, line_count)


def canonical_report(raw: Column, order: str = "analysis_first") -> Column:
    """Compact JSON of a valid report with its keys in the given order."""
    tree = parsed(raw)
    text = lambda k: F.regexp_replace(F.to_json(F.array(F.try_variant_get(tree, f"$.{k}", "string"))), r"(?s)^\[|\]$", "")
    whole = lambda k: F.try_variant_get(tree, f"$.location.{k}_line", "bigint").cast("string")
    name = F.coalesce(F.regexp_replace(F.to_json(F.array(F.try_variant_get(tree, "$.location.function", "string")), {"ignoreNullFields": "false"}), r"(?s)^\[|\]$", ""), F.lit("null"))
    place = F.when(_kind(tree, "$.location") == "VOID", F.lit("null")).otherwise(F.concat(F.lit('{"start_line":'), whole("start"), F.lit(',"end_line":'), whole("end"), F.lit(',"function":'), name, F.lit("}")))
    value = {"analysis": text("analysis"), "verdict": text("verdict"), "location": place}
    return F.concat(F.lit("{"), *(x for i, k in enumerate(ORDERS[order]) for x in (F.lit(("," if i else "") + f'"{k}":'), value[k])), F.lit("}"))


def verdict_of(raw: Column, line_count: Column, order: str = "analysis_first") -> Column:
    """PRESENT, ABSENT, or INVALID; an output is never repaired."""
    return F.when(valid_report(raw, line_count, order), F.try_variant_get(parsed(raw), "$.verdict", "string")).otherwise("INVALID")


def label_verdict(raw: Column) -> Column:
    from lumenweir.functions.text import stripped

    answer = stripped(raw)
    return F.when(answer.isin(*LABELS), answer).otherwise("INVALID")


def forced_verdict(raw: Column) -> Column:
    return F.when(raw.startswith("PRESENT"), "PRESENT").when(raw.startswith("ABSENT"), "ABSENT").otherwise("INVALID")


def answer_status(raw: Column, line_count: Column, label: Column, tokens: Column, most_tokens: int) -> Column:
    """accepted, disagreed, unsupported or invalid: form first, without the label; then the verdict against it.

    tokens: the number of tokens of the answer's report.
    """
    tree = parsed(raw)
    report = F.to_json(_part(tree, "$.report"))
    status = F.try_variant_get(tree, "$.status", "string")
    reason = F.try_variant_get(tree, "$.reason_code", "string")
    shape = tree.isNotNull() & _same_keys(raw, ["status", "report", "reason_code"], False)
    bare = (_kind(tree, "$.report") == "VOID") & reason.isin("INSUFFICIENT_CONTEXT", "UNRESOLVED_ASSUMPTIONS")
    body = _part(tree, "$.report")
    good = (_kind(tree, "$.reason_code") == "VOID") & _same_keys(report, ["analysis", "verdict", "location"], False) & _valid_body(body, report, line_count) & (tokens <= most_tokens)
    agrees = F.try_variant_get(tree, "$.report.verdict", "string") == label
    return (
        F.when(shape & (status == "UNSUPPORTED") & bare, "unsupported")
        .when(shape & (status == "OK") & good & agrees, "accepted")
        .when(shape & (status == "OK") & good, "disagreed")
        .otherwise("invalid")
    )
