"""Chat formatting with tool-call linking, in DataFrame functions alone.

Calls and results are joined by (conversation, identifier), ordered so that each comes after what it needs, validated
against the tools' schemas, and written as canonical JSON: keys sorted, no white space, one spelling of each value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenweir.functions.strict_json import parsed
from lumenweir.llm.common import stored

#: A string argument "$ref:ID" stands for the result of call ID.
REF = r'"\$ref:([^"\\]+)"'
KINDS = {
    "string": "STRING$",
    "integer": r"(?:TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(\d+,0\))$",
    "number": "(?:TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)",
    "boolean": "BOOLEAN$",
    "object": "OBJECT<",
    "array": "ARRAY<",
    "null": "VOID$",
}


def canonical(json: Column) -> Column:
    """Canonical form of a JSON text; null if it isn't JSON or repeats a key."""
    return F.to_json(parsed(json))


def quoted(text: Column) -> Column:
    """A string as canonical JSON; null as null."""
    return F.coalesce(F.regexp_replace(F.to_json(F.array(text), {"ignoreNullFields": "false"}), r"(?s)^\[|\]$", ""), F.lit("null"))


def problems(name: Column, arguments: Column, tools: dict[str, dict]) -> Column:
    """array<string> of what is wrong with a call: unknown tool, no JSON object, and per argument missing, unknown or of another kind.

    tools: name -> {"properties": {argument: kind}, "required": [argument]}; kinds are the keys of KINDS.
    """
    tree = parsed(arguments)
    keys = F.json_object_keys(arguments)
    wrong = F.array(F.lit("unknown tool"))
    for tool, schema in sorted(tools.items()):
        known = schema.get("properties", {})
        checks = [F.when(~F.array_contains(keys, a), F.lit(f"missing {a}")) for a in sorted(schema.get("required", []))]
        for a, kind in sorted(known.items()):
            of = F.schema_of_variant(F.try_variant_get(tree, f"$['{a}']", "variant"))
            checks.append(F.when(F.array_contains(keys, a) & ~of.rlike("^" + KINDS[kind]), F.lit(f"{a} is no {kind}")))
        extra = F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, known)) if known else F.array().cast("array<string>"))), lambda k: F.concat(F.lit("unknown "), k))
        found = F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), extra)
        wrong = F.when(name == tool, F.when(tree.isNull() | keys.isNull(), F.array(F.lit("no JSON object"))).otherwise(found)).otherwise(wrong)
    return wrong


def levels(calls: DataFrame) -> DataFrame:
    """calls (conv_id, id, turn, result_turn, needs array<string>) with level and ready: calls whose needs are all met, by rounds.

    A call without needs has level 0; others come two levels after the deepest call they need, to leave room for its
    result. ready is the first turn at which a call may stand: its own, or the latest result that it needs. A need that is
    unknown, unanswered or part of a cycle is never met: level and ready are null. One round for each link of the longest
    chain in the table; without needs there is none.
    """
    plain = calls.filter(F.size("needs") == 0).withColumn("level", F.lit(0).cast("bigint")).withColumn("ready", F.col("turn"))
    waiting = calls.filter(F.size("needs") > 0)
    if waiting.isEmpty():
        return plain
    # the rounds carry keys and turns alone; the other columns join the levels once at the end
    narrow = ["conv_id", "id", "turn", "result_turn"]
    pending = stored(waiting.select(*narrow, F.array_distinct("needs").alias("needs")), "pending")
    fresh = plain.filter("result_turn IS NOT NULL").select(*narrow, "level", "ready")
    met, placed = None, []
    while True:  # each round places a call at least
        found = fresh.select(F.col("conv_id").alias("c"), F.col("id").alias("need"), F.col("level").alias("l"), F.greatest("ready", "result_turn").alias("r"))
        need = pending.select("conv_id", "id", F.explode("needs").alias("need"))
        hits = need.join(found, need["conv_id"].eqNullSafe(found["c"]) & (need["need"] == found["need"])).groupBy("conv_id", "id").agg(F.count("*").alias("have"), F.max("l").alias("l"), F.max("r").alias("r"))
        # what earlier rounds met of a call's needs counts on
        hits = hits if met is None else met.unionByName(hits).groupBy("conv_id", "id").agg(F.sum("have").alias("have"), F.max("l").alias("l"), F.max("r").alias("r"))
        hits = hits.select(F.col("conv_id").alias("hc"), F.col("id").alias("hid"), "have", "l", "r")
        both = stored(pending.join(hits, pending["conv_id"].eqNullSafe(F.col("hc")) & (pending["id"] == F.col("hid")), "left").withColumn("now", F.coalesce(F.col("have") == F.size("needs"), F.lit(False))), "round")
        fresh = both.filter("now").select(*narrow, (F.col("l") + 2).alias("level"), F.greatest("turn", "r").alias("ready"))
        if fresh.isEmpty():
            break
        placed.append(fresh)
        pending = both.filter("NOT now").select(*narrow, "needs")
        met = both.filter("NOT now AND have IS NOT NULL").select("conv_id", "id", "have", "l", "r")
        if pending.isEmpty():
            break
        fresh = fresh.filter("result_turn IS NOT NULL")
    if not placed:
        return plain.unionByName(waiting.withColumn("level", F.lit(None).cast("bigint")).withColumn("ready", F.lit(None).cast("bigint")))
    of = reduce(DataFrame.unionByName, placed).select(F.col("conv_id").alias("pc"), F.col("id").alias("pid"), "level", "ready")
    return plain.unionByName(waiting.join(of, waiting["conv_id"].eqNullSafe(F.col("pc")) & (waiting["id"] == F.col("pid")), "left").drop("pc", "pid"))


def linked(messages: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """One row for each plain message, call and result of messages, with its links, place and canonical JSON line.

    messages: conv_id, turn, role, text, calls array<struct<id, name, arguments>> (null or empty: none), answers (the id of
    the call whose result the message is, else null). A message with calls gives a row for each of them.

    Columns: conv_id, turn, role, kind (call, result, plain), call_id, linked (both sides are there), peer_turn (the other
    side's turn), level and ready (see levels(); a result stands one level under its call and not before it; sorted by
    (conv_id, ready, level, turn) the rows are in topological order), problems array<string> (of a call), line.

    Of calls that share an identifier within a conversation the first by turn, name and arguments is linked, of results the
    first by turn and text; the others say so in problems or are not linked. Null identifiers link nothing. Null texts are
    JSON null, unparsable arguments stay a JSON string. Repeated rows give repeated rows; an empty table gives an empty
    result; other columns are not read. Joins are by (conv_id, identifier), so a long conversation is no hot key.
    """
    m = messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "calls", "answers")
    each = m.filter(F.size(F.coalesce("calls", F.array())) > 0).select("conv_id", "turn", "role", "text", F.explode("calls").alias("c")).select("conv_id", "turn", "role", "text", "c.id", "c.name", "c.arguments")
    first = each.filter("id IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "name", "arguments")).alias("f")).select("conv_id", "id", "f.*")
    result = m.filter("answers IS NOT NULL").groupBy("conv_id", F.col("answers").alias("id")).agg(F.min(F.struct("turn", "text")).alias("r")).select(F.col("conv_id").alias("rc"), F.col("id").alias("rid"), F.col("r.turn").alias("result_turn"), F.col("r.text").alias("result_text"))
    calls = first.join(result.hint("shuffle_hash"), first["conv_id"].eqNullSafe(result["rc"]) & (first["id"] == result["rid"]), "left").drop("rc", "rid")
    calls = stored(calls.withColumn("needs", F.regexp_extract_all("arguments", F.lit(REF), F.lit(1))).withColumn("needs", F.coalesce("needs", F.array().cast("array<string>"))), "calls")
    known = stored(levels(calls).select(F.col("conv_id").alias("kc"), F.col("id").alias("kid"), F.col("turn").alias("kturn"), F.struct("turn", "name", "arguments").alias("kcall"), "result_turn", "result_text", "level", "ready"), "known")
    same = lambda df, name: df["conv_id"].eqNullSafe(known["kc"]) & (df[name] == known["kid"])

    own = each.join(known.hint("shuffle_hash"), same(each, "id"), "left")
    chosen = F.coalesce(F.struct("turn", "name", "arguments").eqNullSafe(F.col("kcall")), F.lit(False))
    bad = F.concat(problems(F.col("name"), F.col("arguments"), tools), F.when(F.col("id").isNull(), F.array(F.lit("no identifier"))).when(~chosen, F.array(F.lit("identifier already used"))).otherwise(F.array().cast("array<string>")))
    arguments = F.coalesce(canonical(F.col("arguments")), quoted(F.col("arguments")))
    a_call = own.select(
        "conv_id",
        "turn",
        "role",
        F.lit("call").alias("kind"),
        F.col("id").alias("call_id"),
        (chosen & F.col("result_turn").isNotNull()).alias("linked"),
        F.when(chosen, F.col("result_turn")).alias("peer_turn"),
        F.when(chosen, F.col("level")).alias("level"),
        F.when(chosen, F.col("ready")).alias("ready"),
        bad.alias("problems"),
        F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"tool_call":{"arguments":'), arguments, F.lit(',"id":'), quoted(F.col("id")), F.lit(',"name":'), quoted(F.col("name")), F.lit("}}")).alias("line"),
    )
    results = m.filter("answers IS NOT NULL")
    back = results.join(known.hint("shuffle_hash"), same(results, "answers"), "left")
    taken = F.coalesce((F.col("turn") == F.col("result_turn")) & F.col("text").eqNullSafe(F.col("result_text")), F.lit(False))
    a_result = back.select(
        "conv_id",
        "turn",
        "role",
        F.lit("result").alias("kind"),
        F.col("answers").alias("call_id"),
        taken.alias("linked"),
        F.when(taken, F.col("kturn")).alias("peer_turn"),
        F.when(taken, F.col("level") + 1).alias("level"),
        F.when(taken, F.greatest("ready", "turn")).alias("ready"),
        F.array().cast("array<string>").alias("problems"),
        F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"tool_call_id":'), quoted(F.col("answers")), F.lit("}")).alias("line"),
    )
    plain = m.filter("answers IS NULL").filter(F.size(F.coalesce("calls", F.array())) == 0).select(
        "conv_id",
        "turn",
        "role",
        F.lit("plain").alias("kind"),
        F.lit(None).cast("string").alias("call_id"),
        F.lit(False).alias("linked"),
        F.lit(None).cast("bigint").alias("peer_turn"),
        F.lit(0).cast("bigint").alias("level"),
        F.col("turn").alias("ready"),
        F.array().cast("array<string>").alias("problems"),
        F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}")).alias("line"),
    )
    return a_call.unionByName(a_result).unionByName(plain)


#: The conversations table has no tool messages, so the query reads a user's turn as a call of `reply` and the assistant's
#: next turn as its result. Calls of turns 4k + 2 and 4k + 3 need the result of the user's turn before, conversations 7k + 3
#: leave out the text and conversations 11k + 5 spell the turn as a string, so that order and validation have work to do.
TOOLS = {"reply": {"properties": {"after": "string", "chars": "integer", "text": "string", "turn": "integer"}, "required": ["text", "turn"]}}


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    id_of = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    t = F.col("turn").cast("bigint")
    after = F.when(F.pmod(t, F.lit(4)) >= 2, F.concat(F.lit("$ref:"), id_of(t - 2))).alias("after")
    text = F.when(~F.coalesce(F.pmod("conv_id", F.lit(7)) == 3, F.lit(False)), F.col("text")).alias("text")
    arguments = lambda turn: F.to_json(F.struct(turn.alias("turn"), text, F.length("text").alias("chars"), after))
    spelled = F.when(F.pmod("conv_id", F.lit(11)) == 5, arguments(t.cast("string"))).otherwise(arguments(t))
    call = F.array(F.struct(id_of(t).alias("id"), F.lit("reply").alias("name"), spelled.alias("arguments")))
    return conversations.select("conv_id", "turn", "role", "text", F.when(F.col("role") == "user", call).alias("calls"), F.when(F.col("role") == "assistant", id_of(t - 1)).alias("answers"))


def op8_tool_linking(spark, sf_dir: str) -> DataFrame:
    out = linked(as_tool_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")), TOOLS)
    return out.withColumn("problems", F.array_join("problems", ";"))


QUERIES = {"op8_tool_linking": op8_tool_linking}
SQL = {
    "op8_tool_linking": """
        WITH m AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text, CAST(to_json(text) AS VARCHAR) AS q FROM conversations),
        u AS (SELECT *, 'c' || conv_id || '-' || turn AS id FROM m WHERE role = 'user'),
        a AS (SELECT *, 'c' || conv_id || '-' || (turn - 1) AS id FROM m WHERE role = 'assistant'),
        fc AS (SELECT conv_id, id, min(turn) AS turn, min(text) AS text FROM u GROUP BY ALL),
        fr AS (SELECT conv_id, id, min(turn) AS turn, min(text) AS text FROM a GROUP BY ALL),
        known AS (SELECT fc.conv_id, fc.id, fc.turn, fr.turn AS result_turn, fr.text AS result_text, fc.turn % 4 >= 2 AS needs, 'c' || fc.conv_id || '-' || (fc.turn - 2) AS need FROM fc LEFT JOIN fr ON fc.conv_id = fr.conv_id AND fc.id = fr.id),
        placed AS (SELECT k.*, CASE WHEN NOT k.needs THEN 0 WHEN n.result_turn IS NOT NULL AND NOT n.needs THEN 2 END AS level,
            CASE WHEN NOT k.needs THEN k.turn WHEN n.result_turn IS NOT NULL AND NOT n.needs THEN greatest(k.turn, n.turn, n.result_turn) END AS ready
          FROM known k LEFT JOIN known n ON k.needs AND n.conv_id = k.conv_id AND n.id = k.need)
        SELECT u.conv_id, u.turn, u.role, 'call' AS kind, u.id AS call_id, p.result_turn IS NOT NULL AS linked, p.result_turn AS peer_turn,
               CAST(p.level AS BIGINT) AS level, p.ready, concat_ws(';', CASE WHEN u.conv_id % 7 = 3 THEN 'missing text' END, CASE WHEN u.conv_id % 11 = 5 THEN 'turn is no integer' END) AS problems,
               '{"content":' || q || ',"role":"user","tool_call":{"arguments":{' || CASE WHEN u.turn % 4 >= 2 THEN '"after":"$ref:c' || u.conv_id || '-' || (u.turn - 2) || '",' ELSE '' END
                 || '"chars":' || length(u.text) || CASE WHEN u.conv_id % 7 = 3 THEN '' ELSE ',"text":' || q END || ',"turn":' || CASE WHEN u.conv_id % 11 = 5 THEN '"' || u.turn || '"' ELSE CAST(u.turn AS VARCHAR) END
                 || '},"id":"' || u.id || '","name":"reply"}}' AS line
        FROM u JOIN placed p ON u.conv_id = p.conv_id AND u.id = p.id
        UNION ALL
        SELECT a.conv_id, a.turn, a.role, 'result', a.id, p.id IS NOT NULL AND a.text = fr.text, CASE WHEN a.text = fr.text THEN p.turn END,
               CASE WHEN p.id IS NOT NULL AND a.text = fr.text THEN p.level + 1 END, CASE WHEN p.id IS NOT NULL AND a.text = fr.text THEN greatest(p.ready, a.turn) END, '',
               '{"content":' || q || ',"role":"assistant","tool_call_id":"' || a.id || '"}'
        FROM a JOIN fr ON a.conv_id = fr.conv_id AND a.id = fr.id LEFT JOIN placed p ON a.conv_id = p.conv_id AND a.id = p.id
        UNION ALL
        SELECT conv_id, turn, role, 'plain', NULL, FALSE, NULL, 0, turn, '', '{"content":' || q || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}'
        FROM m WHERE role NOT IN ('user', 'assistant')
    """
}
