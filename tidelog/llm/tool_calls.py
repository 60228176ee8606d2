"""Operator 2, chat formatting: tool calls are linked, ordered, validated and serialised.

Native: DataFrame functions only.

* Calls and results are joined by identifier (and conversation). Of several calls of an identifier
  the earliest turn's counts, and of several results the earliest after that call, or else the
  earliest; all others are rows of their own, as is a result without a call.
* Calls are ordered topologically by what they depend on: ``level`` is the longest way down to a
  call that depends on nothing. Calls with one dependency form trees, which pointer doubling
  folds in a logarithm of their depth, so a conversation that is one long chain takes few rounds.
  Calls with several are sorted by turn and dealt into blocks of ``BLOCK``; a round settles, in all
  blocks at once, whatever a fold over the block's calls can reach, so a ladder takes a round for
  each block that it goes through and not for each step. Dependencies on later turns take a round
  each. A cycle has no level.
* Arguments are parsed as variants and each field is looked up in the schema of its tool.
* The canonical JSON of a call has sorted keys and no white space.

``(conv_id, level, turn, call_id)`` sorts a conversation topologically; no conversation is
gathered in one task, and rows of an identifier only meet in joins that Spark may split and in
aggregates combined on the map side.

Defined cases: a null or blank identifier is never linked (``unidentified``, calls and results);
later calls of an identifier are ``duplicate_call`` and have no level or result, but are validated;
results beside the one that counts are ``duplicate_result``; a null turn comes after all others,
and a result of a null turn, or of a call of a null turn, is after its call; of rows of the same
turn the least in the order of their other columns counts (calls by name, arguments and
dependencies, results by content); unknown and null dependencies are reported and don't order; arguments that are null, not JSON or not an object are an error of their own; a tool
without a schema is ``unknown_tool``; empty tables give an empty result; other columns are not
read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import checkpointed

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = "name string, field string, type string, required boolean, maximum double"
#: Calls of a block, as a power of two.
BLOCK_BITS = 10
#: Fields of all schemas that are broadcast, at most; beyond that schemas are joined by name.
FIELDS = 100_000


def _known(call_id: Column) -> Column:
    return call_id.isNotNull() & (F.trim(call_id) != "")


def _least(*columns: str) -> Column:
    """Of an aggregate's rows, the one of the earliest turn (null is last); ties go by the columns."""
    return F.min(F.struct(F.col("turn").isNull().alias("no_turn"), "turn", *columns))


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level) of all nodes (node, and turn or any order); edges are (node, needs). Null on
    cycles and what needs them."""
    nodes = checkpointed(nodes.groupBy("node").agg(F.min("turn").alias("turn")))
    n = nodes.count()
    edges = checkpointed(
        edges.join(nodes.select(F.col("node").alias("needs")), "needs", "left_semi").join(nodes, "node", "left_semi").select("node", "needs").distinct()
    )
    degree = edges.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.min("needs").alias("needs"))
    # A node with one dependency points to it; all others stay where they are.
    up = checkpointed(
        nodes.join(degree, "node", "left").select("node", F.when(F.col("degree") == 1, F.col("needs")).otherwise(F.col("node")).alias("to"), (F.coalesce(F.col("degree"), F.lit(0)) == 1).cast("long").alias("steps"))
    )
    for _ in range(max(1, n).bit_length() + 1):
        if not up.where("node <> to AND steps > 0").join(up.where("steps > 0").select(F.col("node").alias("to")), "to", "left_semi").take(1):
            break
        ahead = up.select(F.col("node").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"))
        up = checkpointed(up.join(ahead, "to").select("node", F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps")))
    # What still points into a tree is on a cycle, or leads to one.
    ends = nodes.join(degree.where("degree = 1").select("node"), "node", "left_anti")
    up = checkpointed(up.join(ends.select(F.col("node").alias("to")), "to", "left_semi").select("node", "to", "steps"))
    several = degree.where("degree > 1").select("node")
    levels = checkpointed(ends.join(several, "node", "left_anti").select("node", F.lit(0).cast("long").alias("level")))
    folded = checkpointed(edges.join(several, "node", "left_semi").join(up.select(F.col("node").alias("needs"), "to", "steps"), "needs", "left").select("node", "to", "steps"))
    if folded.take(1):
        levels = _settle(nodes.join(several, "node", "left_semi"), folded, levels)
    found = up.join(levels.select(F.col("node").alias("to"), "level"), "to").select("node", (F.col("level") + F.col("steps")).alias("level"))
    return nodes.select("node").join(found, "node", "left")


def _settle(nodes: DataFrame, folded: DataFrame, levels: DataFrame) -> DataFrame:
    """Adds the levels of nodes with several dependencies; folded is (node, to, steps), where ``to``
    is one of them or has a level, or is null for one that never gets any."""
    in_order = nodes.repartitionByRange(F.asc_nulls_last("turn"), "node").sortWithinPartitions(F.asc_nulls_last("turn"), "node")
    at = checkpointed(in_order.select("node", F.monotonically_increasing_id().alias("at")))
    there = at.select(F.col("node").alias("to"), F.col("at").alias("to_at"))
    open_ = checkpointed(folded.join(at, "node").join(there, "to", "left").select("node", "at", "to", "to_at", "steps"))
    block = lambda c: F.shiftright(c, BLOCK_BITS)
    while True:
        known = open_.join(levels.select(F.col("node").alias("to"), "level"), "to", "left")
        inside = F.col("level").isNull() & (block(F.col("to_at")) == block(F.col("at"))) & (F.col("to_at") < F.col("at"))
        gathered = known.groupBy("node", "at").agg(
            F.max(F.col("level") + F.col("steps") + 1).alias("base"),
            F.min(F.coalesce(F.col("level").isNotNull() | inside, F.lit(False))).alias("reachable"),
            F.collect_list(F.when(inside, F.struct("to_at", "steps"))).alias("needs"),
        )
        # Levels of a block by its calls' places: the fold adds one entry to a map for each call.
        calls = gathered.groupBy(block(F.col("at")).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "node", "base", "reachable", "needs"))).alias("calls"))
        empty = F.array().cast("array<struct<at:bigint,level:bigint>>")

        def step(found, call):
            own = F.filter(F.transform(call["needs"], lambda e: F.get(F.filter(found, lambda x: x["at"] == e["to_at"]), F.lit(0))["level"] + e["steps"] + 1), lambda x: x.isNotNull())
            level = F.when(call["reachable"] & (F.size(own) == F.size(call["needs"])), F.greatest(call["base"], F.array_max(own)))
            return F.concat(found, F.array(F.struct(call["at"].alias("at"), level.alias("level")))).cast("array<struct<at:bigint,level:bigint>>")

        settled = calls.select(F.explode(F.arrays_zip(F.col("calls.node").alias("node"), F.aggregate("calls", empty, step)["level"].alias("level"))).alias("x")).select("x.node", "x.level")
        ready = checkpointed(settled.where("level IS NOT NULL"))
        if not ready.take(1):
            return levels
        levels = checkpointed(levels.unionByName(ready))
        open_ = checkpointed(open_.join(ready.select("node"), "node", "left_anti"))


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(k, error) for everything in the arguments that the tool's schema forbids; k identifies a call."""
    parsed = calls.select("k", "name", F.try_parse_json("arguments").alias("value"))
    is_object = F.coalesce(F.schema_of_variant("value").startswith("OBJECT"), F.lit(False))
    described = schemas.select(F.col("name").alias("tool"), "field", F.lower("type").alias("type"), "required", "maximum").dropDuplicates(["tool", "field"])
    few = described.limit(FIELDS + 1).count() <= FIELDS
    side = F.broadcast if few else lambda df: df
    tools = described.select(F.col("tool").alias("has_schema")).distinct()
    with_tool = parsed.join(side(tools), parsed["name"] == tools["has_schema"], "left")
    whole = with_tool.select("k", F.when(F.col("has_schema").isNull(), "unknown_tool").when(~is_object, "not_an_object").alias("error")).where("error IS NOT NULL")
    objects = with_tool.where(F.col("has_schema").isNotNull() & is_object).select("k", "name", "value")
    entries = objects.select("k", "name", F.explode(F.from_json(F.to_json("value"), "map<string,variant>")).alias("key", "got"))
    given = entries.join(side(described), (entries["name"] == described["tool"]) & (entries["key"] == described["field"]), "left")
    kind = F.schema_of_variant("got")
    fits = (
        F.when(F.col("type") == "string", kind == "STRING")
        .when(F.col("type") == "integer", kind == "BIGINT")
        .when(F.col("type") == "number", (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"))
        .when(F.col("type") == "boolean", kind == "BOOLEAN")
        .when(F.col("type") == "object", kind.startswith("OBJECT"))
        .when(F.col("type") == "array", kind.startswith("ARRAY"))
        .otherwise(F.lit(False))
    )
    size = F.when(kind == "STRING", F.char_length(F.try_variant_get("got", "$", "string")).cast("double")).otherwise(F.try_variant_get("got", "$", "double"))
    bad = given.select(
        "k",
        F.when(F.col("field").isNull(), F.concat(F.lit("unexpected:"), "key"))
        .when(~F.coalesce(fits, F.lit(False)), F.concat(F.lit("type:"), "key"))
        .when(F.col("maximum").isNotNull() & (size > F.col("maximum")), F.concat(F.lit("maximum:"), "key"))
        .alias("error"),
    ).where("error IS NOT NULL")
    needed = described.where("required").select(F.col("tool").alias("name"), F.col("field").alias("key"))
    missing = objects.select("k", "name").join(side(needed), "name").join(entries.select("k", "key"), ["k", "key"], "left_anti")
    return whole.unionByName(bad).unionByName(missing.select("k", F.concat(F.lit("missing:"), "key").alias("error")))


def canonical(call_id: Column, name: Column, arguments: Column, result: Column) -> Column:
    """One JSON object with sorted keys; arguments that aren't JSON stay as text."""
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1), F.lit(""))
    text = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(quoted(c))
    args = F.coalesce(F.to_json(F.try_parse_json(arguments)), text(arguments))
    return F.concat(F.lit('{"arguments":'), args, F.lit(',"id":'), text(call_id), F.lit(',"name":'), text(name), F.lit(',"result":'), text(result), F.lit("}"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and one per result that isn't the one of a call: conv_id, call_id, turn,
    status, level, valid, errors (sorted), message (canonical JSON; null without a call)."""
    # Checkpoints keep the numbers of rows as they are.
    calls = checkpointed(calls.select("conv_id", "call_id", "turn", "name", "arguments", "depends_on").withColumn("k", F.monotonically_increasing_id()))
    results = checkpointed(results.select("conv_id", "call_id", "turn", "content").withColumn("r", F.monotonically_increasing_id()))
    known, ident = _known(F.col("call_id")), F.struct("conv_id", "call_id").alias("id")
    named, answers = calls.where(known).select("*", ident), results.where(known).select("*", ident)
    own = checkpointed(named.groupBy("id").agg(_least("name", "arguments", "depends_on", "k").alias("first")).select("id", "id.*", "first.*"))

    wants = named.select("k", "conv_id", F.explode("depends_on").alias("needs")).select("k", F.struct("conv_id", F.col("needs").alias("call_id")).alias("needs")).distinct()
    unknown = wants.join(own.select(F.col("id").alias("needs")), "needs", "left_anti").select("k", F.concat(F.lit("unknown_dependency:"), F.coalesce("needs.call_id", F.lit("null"))).alias("error"))
    errors = checkpointed(argument_errors(named, schemas).unionByName(unknown).groupBy("k").agg(F.collect_set("error").alias("found")))
    edges = own.select(F.col("id").alias("node"), "conv_id", F.explode("depends_on").alias("needs")).select("node", F.struct("conv_id", F.col("needs").alias("call_id")).alias("needs")).distinct()
    levels = topological_levels(own.select(F.col("id").alias("node"), "turn"), edges).select(F.col("node").alias("id"), "level")

    early = F.coalesce(F.col("turn") <= F.col("asked"), F.lit(False)).alias("early")
    told = answers.join(own.select("id", F.col("turn").alias("asked")), "id").select("id", early, "turn", "content", "r")
    # Dealt out again, so that the join may be split and the aggregate starts on the map side.
    told = told.repartition(int(told.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    taken = told.groupBy("id").agg(F.min(F.struct("early", F.col("turn").isNull().alias("no_turn"), "turn", "content", "r")).alias("t"))
    taken = checkpointed(taken.select("id", "t.early", "t.content", "t.r"))

    errs = lambda *more: F.array_sort(F.concat(F.coalesce("found", F.array().cast("array<string>")), F.array(*map(F.lit, more)).cast("array<string>")))

    def rows(of: DataFrame, status: Column, level: Column, found: Column, message: Column) -> DataFrame:
        return of.select("conv_id", "call_id", "turn", status.alias("status"), level.cast("long").alias("level"), (F.size(found) == 0).alias("valid"), found.alias("errors"), message.alias("message"))

    none = F.lit(None).cast("string")
    message = lambda result: canonical(F.col("call_id"), F.col("name"), F.col("arguments"), result)
    status = F.when(F.col("level").isNull(), "cyclic").when(F.col("r").isNull(), "no_result").when(F.col("early"), "result_before_call").otherwise("linked")
    counted = own.join(levels, "id", "left").join(taken, "id", "left").join(errors, "k", "left")
    again = named.join(own.select("k"), "k", "left_anti").join(errors, "k", "left")
    spare = answers.join(taken.select("r"), "r", "left_anti").join(own.select("id", F.lit(True).alias("called")), "id", "left")
    unlinked = F.when(F.col("called"), "duplicate_result").otherwise("orphan_result")
    no_id = F.array(F.lit("no_identifier"))
    parts = [
        rows(calls.where(~known), F.lit("unidentified"), none, no_id, message(none)),
        rows(results.where(~known), F.lit("unidentified"), none, no_id, none),
        rows(spare, unlinked, none, F.array(F.when(F.col("called"), "duplicate_result").otherwise("no_call")), none),
        rows(again, F.lit("duplicate_call"), none, errs("duplicate_call"), message(none)),
        rows(counted, status, F.col("level"), errs(), message(F.col("content"))),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Tools that the turns of ``conversations`` are read as calls of, and what their arguments may be.
TURN_TOOLS = [
    ("ask", "n_chars", "integer", True, None),
    ("ask", "text", "string", True, 300.0),
    ("ask", "turn", "integer", True, None),
    ("configure", "text", "string", True, 200.0),
    ("configure", "language", "string", True, None),
]


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as (calls, results): a user's turn asks, depending on what was asked two turns
    before (or on a system turn just before), a system turn configures and has no result, and an
    assistant's turn is the result of the turn before it. Other turns are neither."""
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    name = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    text = F.coalesce("text", F.lit(""))
    asked = F.to_json(F.struct(text.alias("text"), F.col("turn"), F.char_length(text).alias("n_chars")))
    before = F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).when(F.col("turn") == 1, F.array(name(F.col("turn") - 1)))
    is_user = F.col("role") == "user"
    calls = turns.where(F.col("role").isin("user", "system")).select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", F.when(is_user, "ask").otherwise("configure").alias("name"),
        F.when(is_user, asked).otherwise(F.to_json(F.struct(text.alias("text")))).alias("arguments"),
        F.coalesce(F.when(is_user, before), F.array().cast("array<string>")).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def digest(turns: DataFrame) -> DataFrame:
    """``link_calls`` of a table of turns; turns of null or another role are rows of their own
    (``unknown_role``, without an identifier)."""
    calls, results = calls_of_turns(turns)
    schemas = turns.sparkSession.createDataFrame(TURN_TOOLS, SCHEMAS)
    linked = link_calls(calls, results, schemas).withColumn("errors", F.array_join("errors", ","))
    none, unknown = F.lit(None).cast("string"), F.lit("unknown_role")
    others = turns.where(~F.coalesce(F.col("role").cast("string").isin("user", "system", "assistant"), F.lit(False))).select(
        F.col("conv_id").cast("long").alias("conv_id"), none.alias("call_id"), F.col("turn").cast("long").alias("turn"), unknown.alias("status"),
        none.cast("long").alias("level"), F.lit(False).alias("valid"), unknown.alias("errors"), none.alias("message"),
    )
    return linked.unionByName(others)


SQL = r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, conv_id, turn, role, text, coalesce(text, '') AS x FROM conversations),
asked AS (SELECT r, conv_id, 'c' || turn AS call_id, turn, role, x, text, CASE WHEN role = 'user' THEN 'ask' ELSE 'configure' END AS name,
                 '{"text":' || to_json(x) || CASE WHEN role = 'user' THEN ',"turn":' || coalesce(CAST(turn AS VARCHAR), '') || ',"n_chars":' || length(x) ELSE '' END || '}' AS raw,
                 CASE WHEN role = 'user' AND turn >= 2 THEN 'c' || (turn - 2) WHEN role = 'user' AND turn = 1 THEN 'c0' END AS needs
          FROM t WHERE role IN ('user', 'system')),
ranked AS (SELECT *, call_id IS NOT NULL AND row_number() OVER (PARTITION BY conv_id, call_id ORDER BY name, raw, r) = 1 AS own FROM asked),
calls AS (SELECT * FROM ranked WHERE own),
told AS (SELECT r, conv_id, 'c' || (turn - 1) AS call_id, turn, text FROM t WHERE role = 'assistant'),
told2 AS (SELECT o.*, c.r IS NOT NULL AS called,
                 row_number() OVER (PARTITION BY o.conv_id, o.call_id ORDER BY o.text NULLS FIRST, o.r) AS k
          FROM told o LEFT JOIN calls c ON c.conv_id IS NOT DISTINCT FROM o.conv_id AND c.call_id = o.call_id),
levels AS (SELECT c.conv_id, c.call_id, CAST(0 AS BIGINT) AS level FROM calls c LEFT JOIN calls p ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.call_id = c.needs WHERE p.call_id IS NULL
           UNION ALL SELECT c.conv_id, c.call_id, l.level + 1 FROM calls c JOIN levels l ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.call_id = c.needs),
e AS (SELECT c.*, CASE WHEN call_id IS NULL THEN 'no_identifier' ELSE concat_ws(',',
             CASE WHEN NOT own THEN 'duplicate_call' END,
             CASE WHEN role = 'user' AND length(x) > 300 THEN 'maximum:text' END,
             CASE WHEN role = 'system' AND length(x) > 200 THEN 'maximum:text' END,
             CASE WHEN role = 'system' THEN 'missing:language' END,
             CASE WHEN needs IS NOT NULL AND NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.call_id = c.needs) THEN 'unknown_dependency:' || needs END) END AS errors
      FROM ranked c)
SELECT e.conv_id, e.call_id, e.turn,
       CASE WHEN e.call_id IS NULL THEN 'unidentified' WHEN NOT own THEN 'duplicate_call' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
       l.level, errors = '' AS valid, errors,
       '{"arguments":{' || CASE WHEN role = 'user' THEN '"n_chars":' || length(x) || ',"text":' || to_json(x) || coalesce(',"turn":' || e.turn, '') ELSE '"text":' || to_json(x) END ||
       '},"id":' || coalesce('"' || e.call_id || '"', 'null') || ',"name":"' || name || '","result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}' AS message
FROM e LEFT JOIN (SELECT * FROM told2 WHERE called AND k = 1) r ON own AND e.conv_id IS NOT DISTINCT FROM r.conv_id AND e.call_id = r.call_id
LEFT JOIN levels l ON own AND l.conv_id IS NOT DISTINCT FROM e.conv_id AND l.call_id = e.call_id
UNION ALL
SELECT conv_id, call_id, turn, CASE WHEN call_id IS NULL THEN 'unidentified' WHEN called THEN 'duplicate_result' ELSE 'orphan_result' END, NULL, FALSE,
       CASE WHEN call_id IS NULL THEN 'no_identifier' WHEN called THEN 'duplicate_result' ELSE 'no_call' END, NULL
FROM told2 WHERE NOT (called AND k = 1)
UNION ALL
SELECT conv_id, NULL, turn, 'unknown_role', NULL, FALSE, 'unknown_role', NULL FROM t WHERE role IS NULL OR role NOT IN ('user', 'system', 'assistant')
"""
