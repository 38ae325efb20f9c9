"""Tool-call linking in chats (DataFrame functions only).

Calls and results are hash-joined by conversation and identifier, calls are put in topological order by what they wait
for, arguments are validated against the tools' schemas, and each link is serialised as canonical JSON (sorted keys,
no white space, at every depth).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialise

CALLS = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"
SCHEMA_TABLE = "name string, required array<string>, types map<string,string>"
KEY = ["conv_id", "call_id"]


def kind_of(v):
    """JSON type of a variant column: string, integer, number, boolean, null, array or object."""
    t = F.schema_of_variant(v)
    return (
        F.when(t == "STRING", "string").when(t == "BIGINT", "integer").when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "number")
        .when(t == "BOOLEAN", "boolean").when(t == "VOID", "null").when(t.startswith("ARRAY"), "array").otherwise("object")
    )


def canonical(json):
    """Canonical text of a JSON text column; null where it doesn't parse (repeated keys included)."""
    return F.to_json(F.try_parse_json(json))


def levels(calls: DataFrame, waits: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """calls(conv_id, call_id, turn, pos), waits(conv_id, call_id, after) -> KEY and level; null level for cycles and what waits on them.

    The level is the longest chain of waits. Waits that others imply are left out, then chains of calls with one wait
    each are jumped over by pointer doubling; only calls that still have several waits are levelled round by round, and
    ``max_rounds`` of these are an error.
    """
    known = calls.select("conv_id", F.col("call_id").alias("after"), F.struct("turn", "pos").alias("after_at"))
    edges = waits.distinct().join(calls.select(*KEY, F.struct("turn", "pos").alias("at")), KEY).join(known, ["conv_id", "after"])
    edges = materialise(edges.select(*KEY, "after", (F.col("after_at") < F.col("at")).alias("back")), "calls-waits")
    # v > w > u in the calls' own order: the wait of v for u adds nothing (few waits a call, so that this stays linear)
    few = edges.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n <= 8").select(*KEY)
    back = edges.filter("back").join(few, KEY, "left_semi").select(*KEY, "after")
    implied = back.join(back.select("conv_id", F.col("call_id").alias("after"), F.col("after").alias("far")), ["conv_id", "after"]).select(*KEY, F.col("far").alias("after")).distinct()
    edges = materialise(edges.select(*KEY, "after").join(implied, [*KEY, "after"], "left_anti"), "calls-waits")

    one = edges.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("after").alias("to")).filter("n = 1")
    jumps = materialise(one.select(*KEY, "to", F.lit(1).cast("bigint").alias("far")), "calls-jumps")
    longest = calls.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    ends, reach = None, 1
    while not jumps.isEmpty():  # what has reached a call with no wait or several leaves; what never does is on a cycle
        onto = jumps.select("conv_id", F.col("call_id").alias("to"))
        out = jumps.join(onto, ["conv_id", "to"], "left_anti")
        if ends is not None:
            past = ends.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("end"), F.col("far").alias("more"))
            out = out.join(past, ["conv_id", "to"], "left").select(*KEY, F.coalesce("end", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
        out = materialise(out.select(*KEY, "to", "far"), "calls-out")
        ends = out if ends is None else materialise(ends.unionByName(out), "calls-ends")
        if reach > longest:
            break
        rest = jumps.join(out.select(*KEY), KEY, "left_anti")
        nxt = jumps.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        jumps = materialise(rest.join(nxt, ["conv_id", "to"]).select(*KEY, F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far")), "calls-jumps")
        reach *= 2
    if ends is None:
        ends = jumps
    stuck = jumps.select(*KEY).join(ends.select(*KEY), KEY, "left_anti")  # on a cycle of single waits, or waiting for one

    single = materialise(one.select(*KEY), "calls-single")
    hubs = calls.select(*KEY).join(single, KEY, "left_anti")
    over = ends.select("conv_id", F.col("call_id").alias("after"), "to", "far")
    lost = stuck.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("lost"))
    open_waits = edges.join(single, KEY, "left_anti").join(over, ["conv_id", "after"], "left").join(lost, ["conv_id", "after"], "left")
    to = F.when(F.col("lost"), F.col("call_id")).otherwise(F.coalesce("to", "after"))  # a wait for itself is never over
    open_waits = materialise(open_waits.select(*KEY, to.alias("after"), (F.coalesce("far", F.lit(0)) + 1).alias("far")).groupBy(*KEY, "after").agg(F.max("far").alias("far")), "calls-waits")
    rest = materialise(hubs.withColumn("level", F.lit(0).cast("bigint")), "calls-rest")
    done = []
    while True:
        ready = materialise(rest.join(open_waits.select(*KEY).distinct(), KEY, "left_anti"), "calls-ready")
        if ready.isEmpty():
            break
        if len(done) >= max_rounds:
            raise ValueError(f"more than {max_rounds} rounds of calls with several waits: raise max_rounds")
        done.append(ready)
        met = open_waits.join(ready.select("conv_id", F.col("call_id").alias("after"), "level"), ["conv_id", "after"]).groupBy(*KEY).agg(F.max(F.col("level") + F.col("far")).alias("least"))
        rest = materialise(rest.join(ready.select(*KEY), KEY, "left_anti").join(met, KEY, "left").select(*KEY, F.greatest("level", "least").alias("level")), "calls-rest")
        open_waits = materialise(open_waits.join(ready.select("conv_id", F.col("call_id").alias("after")), ["conv_id", "after"], "left_anti"), "calls-waits")
    placed = rest.withColumn("level", F.lit(None).cast("bigint"))
    for d in done:
        placed = placed.unionByName(d)
    placed = materialise(placed, "calls-placed")
    after = placed.select("conv_id", F.col("call_id").alias("to"), "level")
    chained = single.join(ends, KEY, "left").join(after, ["conv_id", "to"], "left").select(*KEY, (F.col("level") + F.col("far")).alias("level"))
    return placed.unionByName(chained).withColumn("level", F.col("level").cast("int"))


def link_tool_calls(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row a call, and one a result without a call.

    messages: conv_id, turn, role, text, tool_calls (JSON array of {id, name, arguments, after}), tool_call_id.
    schemas: ``SCHEMA_TABLE``; types are JSON types, ``number`` takes integers too; other properties are refused.

    Columns: conv_id, call_id, turn, pos, name, level, result_turn, status, errors (sorted array), canonical. A
    conversation's calls by (level, turn, pos) are in topological order; the level is null for cycles and what waits on them.
    status: ``linked``, ``no_result``, ``early_result`` (not after the call), ``cycle``, ``orphan_result``. Of calls or
    results that repeat an identifier in a conversation the first by turn and place counts; null conversations
    or identifiers link nothing (such calls are left out, such results are orphans). Tool calls that aren't a JSON array give no
    calls. Texts of any length are carried whole, null ones leave the result out of the JSON. Empty tables give no rows;
    other columns don't matter.
    """
    calls = messages.filter(F.col("tool_calls").isNotNull()).select("conv_id", "turn", F.posexplode(F.from_json("tool_calls", CALLS)).alias("pos", "c"))
    calls = calls.select("conv_id", F.col("c.id").alias("call_id"), F.struct("turn", "pos", "c.name", "c.arguments", "c.after").alias("call")).filter(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    calls = materialise(calls.groupBy(*KEY).agg(F.min("call").alias("call")).select(*KEY, "call.*"), "calls")
    results = messages.filter(F.col("role") == "tool").select("conv_id", F.col("tool_call_id").alias("call_id"), F.struct(F.col("turn").alias("result_turn"), F.col("text").alias("result")).alias("r"))
    results = results.groupBy(*KEY).agg(F.min("r").alias("r")).select(*KEY, "r.*")

    placed = levels(calls, calls.select(*KEY, F.explode("after").alias("after")))
    s = schemas.select("name", F.coalesce("required", F.array().cast("array<string>")).alias("required"), F.coalesce("types", F.create_map().cast("map<string,string>")).alias("types"), F.lit(True).alias("known"))
    joined = calls.join(placed, KEY).join(s, "name", "left").join(results.hint("shuffle_hash"), KEY, "full")

    given = F.from_json(F.col("arguments"), "map<string,variant>")
    parsed = F.try_parse_json("arguments")
    is_object = parsed.isNotNull() & F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT"))
    given = F.when(is_object, given)
    missing = F.transform(F.filter("required", lambda k: ~F.map_contains_key(given, k)), lambda k: F.concat(F.lit("missing:"), k))
    unknown = F.transform(F.filter(F.map_keys(given), lambda k: ~F.map_contains_key("types", k)), lambda k: F.concat(F.lit("unknown:"), k))

    def wrong(k):
        want, has = F.element_at("types", k), kind_of(F.element_at(given, k))
        return F.map_contains_key("types", k) & ~((want == has) | ((want == "number") & (has == "integer")))

    mistyped = F.transform(F.filter(F.map_keys(given), wrong), lambda k: F.concat(F.lit("type:"), k))
    errors = F.when(F.col("turn").isNull(), F.array().cast("array<string>")).when(F.col("known").isNull(), F.array(F.lit("unknown_tool"))).when(~is_object, F.array(F.lit("not_an_object"))).otherwise(F.array_sort(F.concat(missing, unknown, mistyped)))
    status = F.when(F.col("turn").isNull(), "orphan_result").when(F.col("level").isNull(), "cycle").when(F.col("result_turn").isNull(), "no_result").when(F.col("result_turn") <= F.col("turn"), "early_result").otherwise("linked")
    out = joined.withColumns({"errors": errors, "status": status})
    # the variant of the whole link, so that one writer sorts and escapes everything
    whole = F.to_json(F.struct("call_id", "level", "name", "result", "turn"))
    args = F.coalesce(canonical("arguments"), F.to_json(F.struct(F.col("arguments").alias("raw"))))
    line = F.concat(F.lit('{"arguments":'), args, F.lit(","), F.substr(canonical(whole), F.lit(2)))
    return out.select(*KEY, "turn", "pos", "name", "level", "result_turn", "status", "errors", F.when(F.col("turn").isNotNull(), line).alias("canonical"))


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Tool calls for chats that hold none: every assistant turn makes one call out of its text, the next user turn brings its result.

    A call waits for the call before and, every third turn, for the one before that. One call in six waits for the
    next one instead, which then waits for the call before both: such chats must be reordered, and two in a row make
    a cycle. One call in sixty waits for nothing. Every 5th to 7th call is flawed: by a property of a wrong type, a
    missing one, or an unknown one. Null texts of assistants are empty.
    """
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    mark = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    place = lambda t: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))), 1, 8), 16, 10).cast("bigint") % 60
    ident = lambda t: F.concat(F.lit("c"), t.cast("string"))
    limit = F.coalesce(F.regexp_count(text, F.lit(WORD)) % 50, F.lit(0)).alias("limit")
    args = F.when(mark % 5 == 0, F.to_json(F.struct(F.lit("many").alias("limit"), text.alias("query"))))
    args = args.when(mark % 6 == 0, F.to_json(F.struct(limit)))
    args = args.when(mark % 7 == 0, F.to_json(F.struct(text.alias("query"), F.lit(True).alias("deep"))))
    args = args.otherwise(F.to_json(F.struct(text.alias("query"), limit)))
    tool = F.element_at(F.array(*[F.lit(n) for n in TOOLS]), (mark % len(TOOLS) + 1).cast("int"))
    before = F.array(ident(turn - F.when(place(turn - 2) < 10, 4).otherwise(2)))
    after = F.when(place(turn) < 10, F.array(ident(turn + 2))).when(place(turn) == 10, F.array().cast("array<string>"))
    after = after.otherwise(F.when(turn % 3 == 0, F.array_union(before, F.array(ident(turn - 4)))).otherwise(before))
    call = F.to_json(F.array(F.struct(ident(turn).alias("id"), tool.alias("name"), F.parse_json(args).alias("arguments"), after.alias("after"))))
    base = conversations.select("conv_id", "turn", "role", "text")
    none = F.lit(None).cast("string")
    asks = base.filter("role = 'assistant'").select("conv_id", "turn", "role", "text", call.alias("tool_calls"), none.alias("tool_call_id"))
    answers = base.filter("role = 'user' AND turn > 0").select("conv_id", "turn", F.lit("tool").alias("role"), "text", none.alias("tool_calls"), ident(turn - 1).alias("tool_call_id"))
    return asks.unionByName(answers)


#: The tools of query op7 and what they take.
TOOLS = ["search", "translate", "summarise"]
REQUIRED = ["query"]
TYPES = {"query": "string", "limit": "integer"}


def tool_schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, REQUIRED, TYPES) for n in TOOLS], SCHEMA_TABLE)


def op7_tool_calls(spark, sf_dir):
    linked = link_tool_calls(tool_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")), tool_schemas(spark))
    return linked.withColumn("errors", F.array_join("errors", ",")).drop("pos")


OP7_SQL = r"""
WITH RECURSIVE a AS (
  SELECT conv_id, turn, 'c' || turn AS call_id, coalesce(text, '') AS t, CAST('0x' || substr(md5(coalesce(text, '')), 1, 8) AS BIGINT) AS k,
    CAST('0x' || substr(md5(conv_id || ':' || turn), 1, 8) AS BIGINT) % 60 AS here, CAST('0x' || substr(md5(conv_id || ':' || (turn - 2)), 1, 8) AS BIGINT) % 60 AS past
  FROM conversations WHERE role = 'assistant'),
b AS (
  SELECT conv_id, turn, call_id, ['search', 'translate', 'summarise'][k % 3 + 1] AS name,
    CAST(to_json(t) AS VARCHAR) AS q, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) % 50 AS lim,
    CASE WHEN k % 5 = 0 THEN 'type:limit' WHEN k % 6 = 0 THEN 'missing:query' WHEN k % 7 = 0 THEN 'unknown:deep' ELSE '' END AS errors FROM a),
w AS (
  SELECT conv_id, call_id, turn + 2 AS t FROM a WHERE here < 10
  UNION SELECT conv_id, call_id, turn - CASE WHEN past < 10 THEN 4 ELSE 2 END FROM a WHERE here > 10
  UNION SELECT conv_id, call_id, turn - 4 FROM a WHERE here > 10 AND turn % 3 = 0),
e AS (SELECT w.conv_id, w.call_id, a.call_id AS after FROM w JOIN a ON w.conv_id = a.conv_id AND w.t = a.turn),
n AS (SELECT conv_id, count(*) AS calls FROM a GROUP BY conv_id),
d AS (  -- how long chains of waits get; as many as there are calls means a cycle
  SELECT conv_id, call_id, 0 AS far FROM a
  UNION SELECT e.conv_id, e.call_id, d.far + 1 FROM d JOIN e ON d.conv_id = e.conv_id AND d.call_id = e.after JOIN n ON n.conv_id = d.conv_id WHERE d.far < n.calls),
l AS (SELECT d.conv_id, d.call_id, CASE WHEN max(far) < any_value(calls) THEN CAST(max(far) AS INTEGER) END AS level FROM d JOIN n ON n.conv_id = d.conv_id GROUP BY d.conv_id, d.call_id),
r AS (SELECT conv_id, turn AS result_turn, 'c' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'user' AND turn > 0),
c AS (SELECT b.*, l.level FROM b LEFT JOIN l ON b.conv_id = l.conv_id AND b.call_id = l.call_id),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, c.name, c.level, r.result_turn, c.errors, c.q, c.lim, r.text
      FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT conv_id, call_id, turn, name, level, result_turn,
  CASE WHEN turn IS NULL THEN 'orphan_result' WHEN level IS NULL THEN 'cycle' WHEN result_turn IS NULL THEN 'no_result' ELSE 'linked' END AS status, coalesce(errors, '') AS errors,
  CASE WHEN turn IS NOT NULL THEN '{"arguments":' || CASE errors
      WHEN 'type:limit' THEN '{"limit":"many","query":' || q || '}' WHEN 'missing:query' THEN '{"limit":' || lim || '}'
      WHEN 'unknown:deep' THEN '{"deep":true,"query":' || q || '}' ELSE '{"limit":' || lim || ',"query":' || q || '}' END
    || ',"call_id":"' || call_id || '",' || CASE WHEN level IS NULL THEN '' ELSE '"level":' || level || ',' END || '"name":"' || name || '"' || CASE WHEN result_turn IS NULL OR text IS NULL THEN '' ELSE ',"result":' || CAST(to_json(text) AS VARCHAR) END || ',"turn":' || turn || '}' END AS canonical
FROM j
"""
