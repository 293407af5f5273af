"""Tool calls of conversations: linked to results, ordered, validated, serialised.

Calls and results meet in a hash join on conversation and call identifier. Order comes
from dependencies: a call's level is the longest chain of calls it waits for, and (level,
position) orders a conversation topologically. Conversations of bounded size are ordered
inside tasks by peeling the calls whose dependencies are all done. Larger ones are ordered
by rounds of joins over all of them, in which chains are contracted by doubling; so no
conversation, however long, is in one task. Arguments are parsed and validated against the
tool's schema, and each call is written as canonical JSON (sorted keys, no white space,
shortest numbers).

Defined cases: of calls that repeat an identifier in a conversation the one with the
smallest (position, name, arguments) counts and the number is given; of repeated results
the smallest text; a result without a call is a row of status ``orphan``; a call without
a result is ``unanswered``; dependencies on calls that do not exist are counted and
ignored; calls on a cycle, or waiting for one, have a null level; null or broken
arguments are invalid and written as null; null identifiers are identifiers; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stored, word_count
from tablewright.session import new_path

KEYS = ["conv_id", "call_id"]
#: Calls and dependencies of a conversation that one task may order.
IN_ONE_TASK = 20_000
KINDS = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None),
}


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return False
        return kind == "number" or float(value).is_integer()
    return isinstance(value, KINDS[kind])


def errors(value, schema: dict, at: str = "$") -> list[str]:
    """Where ``value`` does not fit the schema: the usual keywords of JSON Schema."""
    found: list[str] = []
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not {kinds}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            found.append(f"{at}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at}: pattern")
    elif _is(value, "number"):
        if not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
            found.append(f"{at}: range")
    elif isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            found.append(f"{at}: items")
        for i, x in enumerate(value):
            found += errors(x, schema.get("items", {}), f"{at}[{i}]")
    elif isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, x in value.items():
            if k in known:
                found += errors(x, known[k], f"{at}.{k}")
            elif more is False:
                found.append(f"{at}.{k}: unexpected")
            elif isinstance(more, dict):
                found += errors(x, more, f"{at}.{k}")
    return found


def _number(x: float) -> str:
    """The shortest form: integral values without fraction, others as ECMAScript writes them."""
    if x.is_integer() and abs(x) < 1e21:
        return str(int(x))
    mantissa, e, power = repr(x).partition("e")
    if not e:
        return mantissa
    p = int(power)
    if -7 < p < 0:
        digits = mantissa.replace(".", "").lstrip("-")
        return ("-" if x < 0 else "") + "0." + "0" * (-p - 1) + digits
    return f"{mantissa.removesuffix('.0')}e{'+' if p > 0 else '-'}{abs(p)}"


def canonical(value) -> str:
    if isinstance(value, dict):
        items = sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(v)}" for k, v in items) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def _refused(text: str):
    raise ValueError(f"{text} is no JSON number")


def parsed(arguments: str | None):
    """(value, errors)."""
    if arguments is None:
        return None, ["$: missing"]
    try:
        value = json.loads(arguments, parse_constant=_refused)
        # a lone surrogate or a number beyond doubles cannot be written
        canonical(value).encode("utf-8")
        return value, []
    except (ValueError, RecursionError, OverflowError):
        return None, ["$: not JSON"]


def _written(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wrong, texts = [], []
            for row in batch.select(["call_id", "name", "arguments", "content", "status"]).to_pylist():
                if row["status"] == "orphan":
                    wrong.append([])
                    value = None
                else:
                    value, found = parsed(row["arguments"])
                    schema = schemas.get(row["name"])
                    if not found:
                        found = ["$: unknown tool"] if schema is None else errors(value, schema)
                    wrong.append(found)
                texts.append(
                    canonical(
                        {"arguments": value, "id": row["call_id"], "name": row["name"], "result": row["content"]}
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(wrong, pa.list_(pa.string())), pa.array(texts, pa.string())],
                names=[*batch.schema.names, "errors", "json"],
            )

    return run


def _keyed(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{prefix}{k}" for k in KEYS})


def _match(prefix: str, call: str = "call_id") -> Column:
    return F.col("conv_id").eqNullSafe(F.col(f"{prefix}conv_id")) & F.col(call).eqNullSafe(F.col(f"{prefix}call_id"))


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls with their results: n_calls, n_results, content and status."""
    one = F.min(F.struct("position", "name", "arguments", "depends_on")).alias("c")
    own = calls.groupBy(*KEYS).agg(one, F.count(F.lit(1)).alias("n_calls"))
    answers = results.groupBy(*KEYS).agg(F.min("content").alias("content"), F.count(F.lit(1)).alias("n_results"))
    met = own.join(_keyed(answers, "r_"), _match("r_"), "full")
    here = F.col("n_calls").isNotNull()
    return met.select(
        *[F.when(here, F.col(k)).otherwise(F.col(f"r_{k}")).alias(k) for k in KEYS],
        "c.position",
        "c.name",
        "c.arguments",
        "c.depends_on",
        F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"),
        "content",
        F.when(~here, "orphan").when(F.col("n_results").isNull(), "unanswered").otherwise("linked").alias("status"),
    )


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, call_id, level, missing) from rows sorted by conversation, one conversation at a time."""
    held: list[tuple] = []

    def done() -> pa.RecordBatch:
        found = {call: deps for _, call, deps in held}
        waits = {call: [d for d in set(deps or ()) if d in found] for call, deps in found.items()}
        later: dict = {call: [] for call in found}
        for call, deps in waits.items():
            for d in deps:
                later[d].append(call)
        open_ = {call: len(deps) for call, deps in waits.items()}
        level = {call: 0 for call, n in open_.items() if not n}
        ready = list(level)
        for call in ready:  # grows while it is walked
            for other in later[call]:
                open_[other] -= 1
                level[other] = max(level.get(other, 0), level[call] + 1)
                if not open_[other]:
                    ready.append(other)
        solved = set(ready)
        missing = [len(set(deps or ())) - len(waits[call]) for _, call, deps in held]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([c for c, _, _ in held], pa.int64()),
                pa.array([c for _, c, _ in held], pa.string()),
                pa.array([level[c] if c in solved else None for _, c, _ in held], pa.int32()),
                pa.array(missing, pa.int64()),
            ],
            names=["conv_id", "call_id", "level", "missing"],
        )

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "call_id", "depends_on")), strict=True):
            if held and row[0] != held[0][0]:
                yield done()
                held = []
            held.append(row)
    if held:
        yield done()


LEVELS = "conv_id long, call_id string, level int, missing long"


def _contracted(calls: DataFrame) -> DataFrame:
    """The levels of calls of large conversations, by rounds over all of them at once.

    A call is the largest of its base and of level + length over its edges. In a round, an
    edge to a call that is done goes into the base, and an edge to a call with a single edge
    of its own is replaced by one to where that leads, with the lengths added. So a chain
    halves in every round; the rounds grow with the logarithm of the longest run of calls
    that wait for one other, and with the number of calls on a path that wait for several.
    What is left when a round finishes nothing is on a cycle or waits for one.
    """
    spark = calls.sparkSession
    node = F.to_json(F.struct(*KEYS))
    ids = stored(calls.select(node.alias("node"), *KEYS), "calls")
    waits = calls.select(node.alias("node"), F.explode(F.array_distinct("depends_on")).alias("call_id"), "conv_id")
    waits = waits.select("node", node.alias("dep"))
    here = ids.select(F.col("node").alias("here"))
    checked = stored(waits.join(here, F.col("dep") == F.col("here"), "left"), "waits")
    missing = checked.where("here IS NULL").groupBy("node").agg(F.count(F.lit(1)).alias("missing"))
    left = ids.select("node", F.lit(0).cast("long").alias("base"))
    edges = checked.where("here IS NOT NULL").select("node", "dep", F.lit(1).cast("long").alias("length"))
    folder = new_path(spark, "levels")
    while True:
        waiting = edges.select(F.col("node").alias("w")).distinct()
        ready = stored(left.join(waiting, F.col("node") == F.col("w"), "left_anti"), "ready")
        if ready.isEmpty():
            break
        ready.select("node", F.col("base").cast("int").alias("level")).write.mode("append").parquet(folder)
        left = stored(left.join(waiting, F.col("node") == F.col("w"), "left_semi"), "left")
        if left.isEmpty():
            break
        one = edges.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("far"), F.min("length").alias("more"))
        known = ready.select(F.col("node").alias("r"), F.col("base").alias("level"))
        # a call that waits for itself leads nowhere; one that waits for a call that is done has its level
        one = (
            one.where("n = 1 AND far <> node")
            .join(left, "node")
            .join(known.toDF("x", "far_level"), F.col("far") == F.col("x"), "left")
            .select(
                F.col("node").alias("via"),
                F.when(F.col("x").isNull(), F.col("far")).alias("far"),
                "more",
                F.greatest("base", F.col("far_level") + F.col("more")).alias("low"),
            )
        )
        met = edges.join(known, F.col("dep") == F.col("r"), "left").join(one, F.col("dep") == F.col("via"), "left")
        # lengths on a cycle grow without end
        total = F.least(F.col("length") + F.col("more"), F.lit(1 << 40))
        met = stored(
            met.select(
                "node",
                F.when(F.col("r").isNull(), F.when(F.col("via").isNull(), F.col("dep")).otherwise(F.col("far"))).alias("dep"),
                F.when(F.col("via").isNull(), F.col("length")).otherwise(total).alias("length"),
                F.when(F.col("r").isNotNull(), F.col("level") + F.col("length"))
                .when(F.col("via").isNotNull(), F.col("low") + F.col("length"))
                .alias("raised"),
            ),
            "met",
        )
        raised = met.where("raised IS NOT NULL").groupBy(F.col("node").alias("n")).agg(F.max("raised").alias("raised"))
        left = stored(
            left.join(raised, F.col("node") == F.col("n"), "left").select("node", F.greatest("base", "raised").alias("base")), "left"
        )
        edges = stored(met.where("dep IS NOT NULL").groupBy("node", "dep").agg(F.max("length").alias("length")), "edges")
    schema = "node string, level int"
    found = spark.createDataFrame([], schema) if ids.isEmpty() else _read_rounds(spark, folder, schema)
    found = found.withColumnRenamed("node", "f")
    counted = missing.withColumnRenamed("node", "m")
    out = ids.join(found, F.col("node") == F.col("f"), "left").join(counted, F.col("node") == F.col("m"), "left")
    return out.select(*KEYS, "level", F.coalesce("missing", F.lit(0)).alias("missing"))


def _read_rounds(spark, folder: str, schema: str) -> DataFrame:
    """What the rounds wrote; nothing if no round finished a call."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def levels(calls: DataFrame, most: int = IN_ONE_TASK) -> DataFrame:
    """(conv_id, call_id, level, missing) of distinct calls with depends_on.

    Conversations of at most ``most`` calls and dependencies are ordered one by one inside
    tasks, larger ones by rounds over all tasks.
    """
    size = F.sum(1 + F.greatest(F.size("depends_on"), F.lit(0)))
    # at most one row per ``most`` rows
    large = stored(
        calls.groupBy(F.col("conv_id").alias("l")).agg(size.alias("n")).where(F.col("n") > most).select("l"), "large-conversations"
    )
    match = F.col("conv_id").eqNullSafe(F.col("l"))
    small = calls.select(*KEYS, "depends_on").join(large, match, "left_anti")
    parts = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    solved = small.repartition(parts, "conv_id").sortWithinPartitions("conv_id").mapInArrow(_solved, LEVELS)
    if large.isEmpty():
        return solved
    return solved.unionByName(_contracted(stored(calls.select(*KEYS, "depends_on").join(large, match, "left_semi"), "large-calls")))


def transcript(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call or orphan result, with level, errors and canonical JSON.

    ``calls``: conv_id, call_id, position, name, arguments (JSON text), depends_on (ids);
    ``results``: conv_id, call_id, content.
    """
    met = stored(linked(calls, results), "linked")
    order = levels(met.where("status != 'orphan'").select(*KEYS, "depends_on"))
    placed = met.join(_keyed(order, "o_"), _match("o_"), "left").drop("o_conv_id", "o_call_id", "depends_on")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema.fields)
    return placed.mapInArrow(_written(schemas), f"{kinds}, errors array<string>, json string")


#: The tools that turns of a conversation are read as, with their arguments' schemas.
TURN_TOOLS = {
    "ask": {
        "type": "object",
        "required": ["text", "words"],
        "additionalProperties": False,
        "properties": {"text": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 3}},
    },
    "brief": {
        "type": "object",
        "required": ["text"],
        "properties": {"text": {"type": "string", "maxLength": 400}, "words": {"type": "integer", "minimum": 1}},
    },
}


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from plain conversations: a user's turn asks, the next turn answers.

    A call waits for the call two turns before it.
    """
    turn = F.col("turn").cast("long")
    text = F.col("text")
    calls = turns.where("role = 'user'").select(
        F.col("conv_id").cast("long"),
        F.concat(F.lit("c"), turn.cast("string")).alias("call_id"),
        turn.alias("position"),
        F.when(turn % 4 < 2, "ask").otherwise("brief").alias("name"),
        F.to_json(F.struct(word_count(text).alias("words"), text.alias("text"))).alias("arguments"),
        F.when(turn >= 2, F.array(F.concat(F.lit("c"), (turn - 2).cast("string"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select(
        F.col("conv_id").cast("long"),
        F.concat(F.lit("c"), (turn - 1).cast("string")).alias("call_id"),
        text.alias("content"),
    )
    return calls, results
