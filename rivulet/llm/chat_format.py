"""Tool-call linking for chat data, with DataFrame functions only.

Events are messages, calls and results. Results are hash-joined to calls by conversation and identifier, arguments are checked against the
schema of their tool, events get a topological order (a result after its call, a call after the results that its arguments name as
``$result:<id>``, everything else in turn order), and each event is serialised as canonical JSON: keys sorted, no white space.

Columns of events: conv, turn, seq (place within the turn), kind (message, call, result), role, call_id, name, payload (a text for
messages and results, JSON for calls).

Defined results: of calls with one identifier the first counts, the others are ``duplicate``; a result without a call is ``orphan``, a
call without a result ``unanswered``; a call without an identifier is ``invalid``; arguments that are no JSON object or break the schema make a call ``invalid``; calls that wait
for each other, and those that wait for such calls, are ``cycle``; null texts are JSON null; rows with a null conversation are
one conversation together;
repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

CALL = r"(?s)<tool_call>(.*?)</tool_call>"
COLUMNS = ("conv", "turn", "seq", "kind", "role", "call_id", "name", "payload")

# JSON types of a schema and the types that Spark gives to parsed values.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}


def events(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Events of raw messages: ``<tool_call>{"id", "name", "arguments"}</tool_call>`` blocks of assistants, results of role ``tool`` as {"tool_call_id", "content"}."""
    own = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    blocks = F.when(F.col("role") == "assistant", F.regexp_extract_all("text", F.lit(CALL), F.lit(1))).otherwise(F.array().cast("array<string>"))
    calls = own.select("conv", "turn", "role", F.posexplode(blocks).alias("seq", "json"))
    field = lambda name, src="json": F.get_json_object(src, f"$.{name}")
    calls = calls.select("conv", "turn", (F.col("seq") + 1).alias("seq"), F.lit("call").alias("kind"), "role", field("id").alias("call_id"), field("name").alias("name"), field("arguments").alias("payload"))
    null = F.lit(None).cast("string")
    results = own.where("role = 'tool'").select("conv", "turn", F.lit(0).alias("seq"), F.lit("result").alias("kind"), "role", field("tool_call_id", "text").alias("call_id"), null.alias("name"), field("content", "text").alias("payload"))
    plain = own.where("role is null or role <> 'tool'").select("conv", "turn", F.lit(0).alias("seq"), F.lit("message").alias("kind"), "role", null.alias("call_id"), null.alias("name"), F.regexp_replace("text", CALL, "").alias("payload"))
    return plain.unionByName(calls).unionByName(results)


def quoted(col: Column) -> Column:
    """A JSON string of a text, or null."""
    json = F.to_json(F.array(col))
    return F.when(col.isNull(), "null").otherwise(F.substring(json, F.lit(2), F.length(json) - 2))


def errors(name: Column, arguments: Column, schemas: dict[str, dict[str, str]]) -> Column:
    """Errors of a call's arguments: ``schemas`` gives each tool's arguments and JSON types; a type that ends in ``?`` is optional."""
    parsed = F.try_parse_json(arguments)
    kind = F.coalesce(F.schema_of_variant(parsed), F.lit(""))
    found = F.array(F.lit("unknown tool"))
    for tool, fields in sorted(schemas.items()):
        checks = []
        for field, want in sorted(fields.items()):
            is_a = F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant")), F.lit("VOID"))
            fits = F.lit(False)
            for prefix in TYPES[want.rstrip("?")]:
                fits = fits | F.startswith(is_a, F.lit(prefix))
            missing = F.lit(None).cast("string") if want.endswith("?") else F.lit(f"missing {field}")
            checks.append(F.when(is_a == "VOID", missing).when(~fits, F.lit(f"type of {field}")))
        extra = F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*map(F.lit, sorted(fields))) if fields else F.array().cast("array<string>"))
        checks.append(F.when(F.size(extra) > 0, F.concat(F.lit("unknown "), F.array_join(F.array_sort(extra), ","))))
        found = F.when(name == tool, F.array_compact(F.array(*checks))).otherwise(found)
    return F.when(~F.startswith(kind, F.lit("OBJECT")), F.array(F.lit("not an object"))).otherwise(found)


def link(evs: DataFrame, schemas: dict[str, dict[str, str]]) -> DataFrame:
    """(conv, turn, seq, kind, role, call_id, name, status, errors, order_turn, order_depth, json) of every event."""
    calls, results = evs.where("kind = 'call'"), evs.where("kind = 'result'")
    first = calls.where("call_id is not null").groupBy("conv", "call_id").agg(F.min(F.struct("turn", "seq")).alias("at"))
    answer = results.where("call_id is not null").groupBy("conv", "call_id").agg(F.min(F.struct("turn", "seq")).alias("answer"))
    same = lambda a, b: a["conv"].eqNullSafe(b["conv"]) & (a["call_id"] == b["call_id"])
    linked = first.join(answer, same(first, answer), "left").select(first["conv"], first["call_id"], "at", "answer", F.col("at.turn").alias("t"), F.lit(0).alias("d"))

    # A call that names results waits for them: each round places the calls whose last open result was placed in the round before,
    # until none is; what is then open waits for itself. There are as many rounds as calls in the longest chain.
    named = calls.select("conv", "call_id", F.explode(F.regexp_extract_all("payload", F.lit(r'"\$result:([^"]+)"'), F.lit(1))).alias("needs")).distinct()
    stuck = None
    if named.limit(1).count():
        asked = linked.select(F.col("conv").alias("c"), F.col("call_id").alias("i"))
        named = written(named.join(asked, named["conv"].eqNullSafe(asked["c"]) & (named["needs"] == asked["i"]), "left_semi"))

        def step(state: DataFrame, rest: DataFrame, floor: DataFrame) -> DataFrame:
            """The next state: places raised to the floor; open are the calls that the rest still names, fresh those that no longer are."""
            waits = rest.select(F.col("conv").alias("wc"), F.col("call_id").alias("wi"), F.lit(True).alias("waits")).distinct()
            floor = floor.withColumnsRenamed({"conv": "fc", "call_id": "fi"})
            out = state.join(waits, F.col("conv").eqNullSafe(F.col("wc")) & (F.col("call_id") == F.col("wi")), "left").join(floor, F.col("conv").eqNullSafe(F.col("fc")) & (F.col("call_id") == F.col("fi")), "left")
            place, left = F.greatest(F.struct("t", "d"), "end"), F.coalesce("waits", F.lit(False))
            return written(out.select("conv", "call_id", "at", "answer", place["t"].alias("t"), place["d"].alias("d"), left.alias("open"), (F.col("open") & ~left).alias("fresh")))

        end = F.greatest(F.struct("t", (F.col("d") + 2).alias("d")), F.struct(F.coalesce("answer.turn", "t").alias("t"), F.lit(1).alias("d")))
        meets = lambda df: named["conv"].eqNullSafe(df["c"]) & (named["needs"] == df["i"])
        none = linked.select("conv", "call_id", F.struct("t", "d").alias("end")).limit(0)
        linked = step(linked.withColumn("open", F.lit(True)), named, none)
        while linked.where("fresh").limit(1).count():
            done, shut = (linked.where(x).select(F.col("conv").alias("c"), F.col("call_id").alias("i"), end.alias("end")) for x in ("fresh", "not open"))
            floor = named.join(done, meets(done)).groupBy("conv", "call_id").agg(F.max("end").alias("end"))
            linked = step(linked.drop("fresh"), named.join(shut, meets(shut), "left_anti"), floor)
        stuck = linked.where("open").select(F.col("conv").alias("sc"), F.col("call_id").alias("si"))
        linked = linked.drop("open", "fresh")
    known = linked.withColumnsRenamed({"conv": "kc", "call_id": "ki"})
    if stuck is not None:
        known = known.join(stuck.withColumn("stuck", F.lit(True)), F.col("kc").eqNullSafe(F.col("sc")) & (F.col("ki") == F.col("si")), "left").drop("sc", "si")
    else:
        known = known.withColumn("stuck", F.lit(None).cast("boolean"))
    out = evs.join(known, F.col("conv").eqNullSafe(F.col("kc")) & (F.col("call_id") == F.col("ki")), "left")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    bad = F.when(is_call, errors(F.col("name"), F.col("payload"), schemas)).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("errors", bad)
    status = (
        F.when(is_call & F.col("call_id").isNull(), "invalid")
        .when(is_call & (F.struct("turn", "seq") != F.col("at")), "duplicate")
        .when(is_call & F.coalesce("stuck", F.lit(False)), "cycle")
        .when(is_call & (F.size("errors") > 0), "invalid")
        .when(is_call & F.col("answer").isNull(), "unanswered")
        .when(is_result & F.col("at").isNull(), "orphan")
        .otherwise("ok")
    )
    # Struct comparison orders (turn, depth): a result stands at its own turn, or just behind its call if that comes later.
    own = F.struct(F.col("turn").alias("t"), F.lit(0).alias("d"))
    behind = F.struct(F.col("t"), (F.col("d") + 1).alias("d"))
    place = F.when(is_result & F.col("at").isNotNull(), F.greatest(own, behind)).when(is_call & (F.struct("turn", "seq") == F.col("at")), F.struct("t", "d")).otherwise(own)
    canonical = F.coalesce(F.to_json(F.try_parse_json("payload")), F.lit("null"))
    json = (
        F.when(is_call, F.concat(F.lit('{"arguments":'), canonical, F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")), F.lit(',"type":"call"}')))
        .when(is_result, F.concat(F.lit('{"content":'), quoted(F.col("payload")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"type":"result"}')))
        .otherwise(F.concat(F.lit('{"content":'), quoted(F.col("payload")), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"type":"message"}')))
    )
    return out.withColumns({"status": status, "place": place, "json": json}).select("conv", "turn", "seq", "kind", "role", "call_id", "name", "status", "errors", F.col("place.t").alias("order_turn"), F.col("place.d").alias("order_depth"), "json")


# The schema of the tool that user turns call in op9's reading of the conversations.
REPLY = {"reply": {"prompt": "string", "turn": "integer", "after": "string?"}}


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    """The table has no tool calls, so its turns are read as ones: a user's turn calls ``reply``, the assistant's next turn is the result.

    By conversation and turn, some calls name another tool, repeat an identifier, lack an argument, have one of a wrong type or one too many, or wait for a later result.
    """
    turns = table(spark, "conversations", sf_dir)
    text = lambda c: c.cast("string")
    call_id = lambda t: F.concat(F.lit("c"), text(F.col("conv_id")), F.lit("-"), text(t))
    user, answer, k, turn = F.col("role") == "user", F.col("role") == "assistant", F.col("conv_id") + F.col("turn"), F.col("turn")
    number = F.concat(F.lit('{"turn":'), F.when(k % 7 == 1, F.concat(F.lit('"'), text(turn), F.lit('"'))).otherwise(text(turn)))
    prompt = F.when(k % 7 == 2, "").otherwise(F.concat(F.lit(',"prompt":'), quoted(F.col("text"))))
    more = F.when(k % 7 == 3, ',"mood":"x"}').when(k % 7 == 4, F.concat(F.lit(',"after":"$result:'), call_id(turn + 2), F.lit('"}'))).otherwise("}")
    evs = turns.select(
        F.col("conv_id").alias("conv"),
        "turn",
        F.lit(0).alias("seq"),
        F.when(user, "call").when(answer, "result").otherwise("message").alias("kind"),
        "role",
        F.when(user, call_id(F.when((k % 13 == 12) & (turn >= 2), turn - 2).otherwise(turn))).when(answer, call_id(turn - 1)).alias("call_id"),
        F.when(user, F.when(k % 11 == 10, "nope").otherwise("reply")).alias("name"),
        F.when(user, F.concat(number, prompt, more)).otherwise(F.col("text")).alias("payload"),
    )
    out = link(evs, REPLY)
    return out.select(F.col("conv").alias("conv_id"), "turn", "kind", "call_id", "status", F.array_join("errors", ";").alias("problems"), "order_turn", "order_depth", "json")


# A place is turn * 1000 + depth. No call that another one waits for waits itself here, so one round of waiting is enough.
SQL = """
WITH e AS (
  SELECT conv_id, turn, role, text, (conv_id + turn) % 7 AS k, CAST(to_json(text) AS VARCHAR) AS quoted,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE role WHEN 'user' THEN 'c' || conv_id || '-' || CASE WHEN (conv_id + turn) % 13 = 12 AND turn >= 2 THEN turn - 2 ELSE turn END
                   WHEN 'assistant' THEN 'c' || conv_id || '-' || (turn - 1) END AS call_id,
         CASE WHEN role = 'user' THEN CASE WHEN (conv_id + turn) % 11 = 10 THEN 'nope' ELSE 'reply' END END AS name
  FROM conversations),
l AS (
  SELECT conv_id, call_id, min(turn) FILTER (kind = 'call') AS first, min(turn) FILTER (kind = 'result') AS answer FROM e WHERE kind <> 'message' GROUP BY 1, 2),
n AS (SELECT DISTINCT conv_id, call_id, 'c' || conv_id || '-' || (turn + 2) AS need FROM e WHERE kind = 'call' AND k = 4),
p AS (
  SELECT l.conv_id, l.call_id, l.first, l.answer, greatest(l.first * 1000, coalesce(max(greatest(o.first * 1000 + 2, coalesce(o.answer, o.first) * 1000 + 1)), 0)) AS place
  FROM l LEFT JOIN n USING (conv_id, call_id) LEFT JOIN l o ON o.conv_id = n.conv_id AND o.call_id = n.need AND o.first IS NOT NULL
  WHERE l.first IS NOT NULL GROUP BY 1, 2, 3, 4),
x AS (
  SELECT e.*, p.first, p.answer, CASE WHEN kind = 'call' AND turn = p.first THEN p.place WHEN kind = 'result' AND p.first IS NOT NULL THEN greatest(turn * 1000, p.place + 1) ELSE turn * 1000 END AS place,
         CASE WHEN kind <> 'call' THEN '' WHEN name = 'nope' THEN 'unknown tool' WHEN k = 1 THEN 'type of turn' WHEN k = 2 THEN 'missing prompt' WHEN k = 3 THEN 'unknown mood' ELSE '' END AS problems
  FROM e LEFT JOIN p USING (conv_id, call_id))
SELECT conv_id, turn, kind, call_id,
       CASE WHEN kind = 'call' AND turn <> first THEN 'duplicate' WHEN problems <> '' THEN 'invalid' WHEN kind = 'call' AND answer IS NULL THEN 'unanswered' WHEN kind = 'result' AND first IS NULL THEN 'orphan' ELSE 'ok' END AS status,
       problems, place // 1000 AS order_turn, CAST(place % 1000 AS INTEGER) AS order_depth,
       CASE kind WHEN 'call' THEN '{"arguments":{' || CASE k WHEN 3 THEN '"mood":"x",' WHEN 4 THEN '"after":"$result:c' || conv_id || '-' || (turn + 2) || '",' ELSE '' END
                                  || CASE k WHEN 2 THEN '' ELSE '"prompt":' || quoted || ',' END || '"turn":' || CASE k WHEN 1 THEN '"' || turn || '"' ELSE CAST(turn AS VARCHAR) END
                                  || '},"id":"' || call_id || '","name":"' || name || '","type":"call"}'
                 WHEN 'result' THEN '{"content":' || quoted || ',"id":"' || call_id || '","type":"result"}'
                 ELSE '{"content":' || quoted || ',"role":"' || role || '","type":"message"}' END AS json
FROM x"""
