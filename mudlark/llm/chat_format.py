"""Chat formatting: tool calls linked to their results, put in order, checked and written as canonical JSON.

Calls and results are hash-joined by identifier. Calls name the calls they depend on; a call's level is the length of its
longest chain of dependencies, and (level, turn, id) is a topological order. Where every call has one dependency
at most, levels come from pointer doubling, in as many joins as the logarithm of the longest chain; else calls are
peeled off level by level. Arguments are parsed as variants and held against the schema of the call's tool. Canonical
JSON has its keys sorted at every depth and no spaces; strings escape only what JSON must.

Edge cases: a call with a null id is kept, links to nothing and has level 0; of several results with one
identifier the earliest counts (then the smallest text); repeated calls link alike; dependencies on ids that no
call has are dropped and counted; calls on a cycle, or behind one, have a null level; arguments that aren't a JSON object
are kept as a JSON string and break the schema; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mudlark.llm.common import cut

#: tool -> field -> rule: type, and optionally required, minimum, maximum, min_length, one_of.
SCHEMAS = {
    "reply": {
        "prompt": {"type": "string", "required": True, "min_length": 1},
        "turn": {"type": "integer", "required": True, "minimum": 0},
        "style": {"type": "string", "one_of": ["plain", "long"]},
    },
}
#: The columns that :func:`link` adds.
ADDED = ("level", "deps", "missing", "problems", "valid", "message", "result_turn", "n_results", "_found", "_found_id")
#: What a variant calls its types.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL.*)", "boolean": "BOOLEAN", "object": "OBJECT<.*", "array": "ARRAY<.*"}


def problems(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """What is wrong with the arguments (a variant, null if they aren't JSON), as a sorted array of texts."""
    known = F.coalesce(name.isin(*schemas), F.lit(False)) if schemas else F.lit(False)
    is_object = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT"), F.lit(False))
    found = [F.when(~known, F.lit("unknown tool")), F.when(~is_object, F.lit("arguments: not an object"))]
    for tool, fields in schemas.items():
        mine = (name == tool) & is_object
        for field, rule in fields.items():
            at = f"$['{field}']"
            value = F.try_variant_get(arguments, at, "variant")
            kind = F.schema_of_variant(value)
            there = value.isNotNull() & (kind != "VOID")
            typed = F.coalesce(kind.rlike(f"^{TYPES[rule['type']]}$"), F.lit(False))
            if rule.get("required"):
                found.append(F.when(mine & ~F.coalesce(there, F.lit(False)), F.lit(f"{field}: missing")))
            found.append(F.when(mine & there & ~typed, F.lit(f"{field}: not {rule['type']}")))
            ok = mine & there & typed
            if "min_length" in rule:
                found.append(F.when(ok & (F.length(F.try_variant_get(arguments, at, "string")) < rule["min_length"]), F.lit(f"{field}: too short")))
            if "one_of" in rule:
                found.append(F.when(ok & ~F.try_variant_get(arguments, at, "string").isin(rule["one_of"]), F.lit(f"{field}: not allowed")))
            for bound, wrong in (("minimum", lambda v, b: v < b), ("maximum", lambda v, b: v > b)):
                if bound in rule:
                    found.append(F.when(ok & wrong(F.try_variant_get(arguments, at, "double"), rule[bound]), F.lit(f"{field}: beyond {bound}")))
    return F.sort_array(F.array_compact(F.array(*found)))


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    out = text
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        out = F.replace(out, F.lit(a), F.lit(b))
    rare = out
    for code in [c for c in range(32) if chr(c) not in "\n\r\t\b\f"]:
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(out.rlike(r"[\x00-\x1F]"), rare).otherwise(out), F.lit('"'))


def levels(edges: DataFrame) -> DataFrame:
    """(id, dep) without repeats -> id, level of every id that depends on something; a null level is a cycle or behind one."""
    edges = cut(edges, "chat-edges")
    if edges.isEmpty():
        return edges.select("id", F.lit(0).cast("long").alias("level"))
    if edges.groupBy("id").count().filter("count > 1").isEmpty():
        state = edges.select("id", F.col("dep").alias("up"), F.lit(1).cast("long").alias("level"))
        open_ = None
        while True:
            above = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("level").alias("more"))
            state = cut(state.join(above, "up", "left").select("id", F.col("up2").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "chat-levels")
            # A round ends the chains of up to twice the length. Chains have parts of every length, so once a round ends
            # none, all that is left goes round in cycles; a level is below four times the number of ids until then.
            before, open_ = open_, state.filter("up is not null").count()
            if open_ in (0, before):
                return state.select("id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))
    # Peeling: an id is ready once all it depends on have levels.
    done = None
    left = edges
    roots = edges.select(F.col("dep").alias("id")).distinct().join(edges.select("id").distinct(), "id", "left_anti")
    fresh, level = roots, 0
    while True:
        level += 1
        after = cut(left.join(fresh.select(F.col("id").alias("dep")), "dep", "left_anti"), "chat-left")
        ready = cut(left.select("id").distinct().join(after.select("id").distinct(), "id", "left_anti").withColumn("level", F.lit(level).cast("long")), "chat-ready")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        fresh, left = ready, after
    rest = left.select("id").distinct().withColumn("level", F.lit(None).cast("long"))
    return rest if done is None else done.unionByName(rest)


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """Calls (id, name, arguments, depends_on, turn and any others) with results (id, content, turn).

    Adds ``ADDED``: level, deps (dependencies that are calls), missing (how many aren't), problems, valid, message,
    result_turn and n_results. A call's own column of such a name is dropped, whatever its letters' case.
    """
    calls = calls.select(*[c for c in calls.columns if c.lower() not in ADDED])
    first = results.filter("id is not null").groupBy("id").agg(F.min(F.struct("turn", "content")).alias("_result"), F.count("*").alias("n_results"))
    ids = calls.filter("id is not null").select("id").distinct()
    asked = calls.filter("id is not null").select("id", F.explode("depends_on").alias("dep")).distinct()
    edges = asked.join(ids.select(F.col("id").alias("dep")), "dep").select("id", "dep")
    ranks = levels(edges).withColumn("_ranked", F.lit(True))
    kept = edges.groupBy("id").agg(F.sort_array(F.collect_set("dep")).alias("deps"))
    found = calls.select("id").distinct().join(first, "id", "left").join(ranks, "id", "left").join(kept, "id", "left").filter("id is not null")
    found = found.select(F.struct(*found.columns).alias("_found"), F.col("id").alias("_found_id"))
    of = lambda c: F.col(f"_found.{c}")
    out = calls.join(found, calls["id"] == found["_found_id"], "left").drop("_found_id")
    out = out.withColumn("level", F.when(of("_ranked"), of("level")).otherwise(F.lit(0).cast("long")))
    out = out.withColumn("deps", F.coalesce(of("deps"), F.array().cast("array<string>")))
    out = out.withColumn("missing", (F.size(F.array_distinct(F.coalesce("depends_on", F.array().cast("array<string>")))) - F.size("deps")).cast("long"))
    parsed = F.try_parse_json("arguments")
    out = out.withColumn("problems", problems(F.col("name"), parsed, schemas)).withColumn("valid", F.size("problems") == 0)
    text = lambda c: F.coalesce(quoted(c), F.lit("null"))
    arguments = F.when(parsed.isNotNull(), F.to_json(parsed)).otherwise(text(F.col("arguments")))
    said = of("_result")
    result = F.when(said.isNull(), F.lit("null")).otherwise(F.concat(F.lit('{"content":'), text(said["content"]), F.lit(',"turn":'), F.coalesce(said["turn"].cast("string"), F.lit("null")), F.lit("}")))
    deps = F.concat(F.lit("["), F.array_join(F.transform("deps", quoted), ","), F.lit("]"))
    message = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"depends_on":'), deps, F.lit(',"id":'), text(F.col("id")), F.lit(',"name":'), text(F.col("name")), F.lit(',"result":'), result, F.lit(',"type":"tool_call"}'))
    return out.withColumn("message", message).withColumn("result_turn", said["turn"]).withColumn("n_results", F.coalesce(of("n_results"), F.lit(0).cast("long"))).drop("_found")


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, text) read as calls and results.

    A user turn calls ``reply`` with its text; the assistant turn after it is the result. A call depends on the call
    two turns before it, if the turn between them is an assistant's.
    """
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))
    answered = turns.filter(F.col("role") == "assistant").filter(whole).select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("_answered")).distinct()
    calls = turns.filter(F.col("role") == "user").join(answered, ["conv_id", "turn"], "left")
    calls = calls.select("conv_id", "turn", F.when(whole, name(F.col("turn"))).alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"), F.when(F.col("_answered"), F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = turns.filter(F.col("role") == "assistant").select(F.when(whole, name(F.col("turn") - 1)).alias("id"), F.col("text").alias("content"), "turn")
    return calls, results


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = link(*from_turns(turns))
    return out.select("conv_id", "turn", F.col("id").alias("call_id"), "result_turn", "n_results", "level", "missing", "valid", F.array_join("problems", "; ").alias("problems"), "message")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, text, conv_id || ':' || turn AS call_id FROM conversations WHERE role = 'user'
), a AS (
  SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'
), d AS (
  SELECT c.*, b.turn IS NOT NULL AS answered, p.turn IS NOT NULL AS there, r.turn AS result_turn, r.text AS content
  FROM c LEFT JOIN a b ON b.conv_id = c.conv_id AND b.turn = c.turn - 1
         LEFT JOIN c p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2
         LEFT JOIN a r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1
), l AS (
  SELECT *, answered AND there AS dep,
         sum(CASE WHEN answered AND there THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island
  FROM d
), j AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level,
         '"' || replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '"' AS prompt,
         '"' || replace(replace(replace(replace(replace(content, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || '"' AS answer
  FROM l
)
SELECT conv_id, turn, call_id, result_turn, CAST(CASE WHEN result_turn IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_results,
       CAST(level AS BIGINT) AS level, CAST(CASE WHEN answered AND NOT there THEN 1 ELSE 0 END AS BIGINT) AS missing,
       text <> '' AS valid, CASE WHEN text = '' THEN 'prompt: too short' ELSE '' END AS problems,
       '{"arguments":{"prompt":' || prompt || ',"turn":' || turn || '},"depends_on":[' ||
       CASE WHEN dep THEN '"' || conv_id || ':' || (turn - 2) || '"' ELSE '' END || '],"id":"' || call_id || '","name":"reply","result":' ||
       CASE WHEN result_turn IS NULL THEN 'null' ELSE '{"content":' || answer || ',"turn":' || result_turn || '}' END || ',"type":"tool_call"}' AS message
FROM j
"""
