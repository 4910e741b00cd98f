"""Chat formatting with tool-call linking, in DataFrame operations only.

A message is (conv_id, turn, role, text).  A text that is a JSON object with
``tool_calls`` (a list of id, name, arguments) makes calls, beside its
``content``; one with ``tool_call_id`` is the result of the call of that id.
Results are hash-joined to calls by (conv_id, id).  The join key has the call's
id, so one conversation may hold any share of the rows.

Order: a result belongs behind its call whatever its turn says.  Each message
gets a place (``after``, ``step``, ``turn``): a message that links to nothing
has its own turn and step 0, a result its own turn and step 1 if that is later
than ``after`` of its call, or else its call's ``after`` and the next step.  A
result that makes calls hands its place on to their results; what a run of such
links does to a place is three numbers, so chains are followed by pointer
doubling, a round for each doubling of the longest, over the chained calls
alone (and a round more for each call along a chain that several messages make
at one turn).  Sorting
a conversation by place is a topological order of calls and results that keeps
the turns' order otherwise; no task needs to hold a conversation for it.
Messages that are results of each other's calls have no such order: they are
marked (``cycle``), and each stands behind the turn of its call.

Arguments are checked against the tools' schemas: required ones present, none
unknown, types as declared.  ``problems`` lists what is wrong.

The JSON of a message is canonical: keys in order, no blanks, null fields left
out, nested values with sorted keys.  Further keys of a call or result message
stay; ``role`` and ``turn`` are the row's.  Arguments that are a string with a
JSON object, as some formats write them, are that object.

Defined results: null and empty texts are messages without content; texts that
are not such objects are content as they are; broken JSON is content.  Where an
id is called several times in a conversation, results link to its first call
and the calls are marked; a result without call is marked.  Repeated rows are
formatted each, equal ones alike.  A null conversation holds no calls to link
with; a null turn stands at its call's place, or nowhere.  Without schemas
arguments are not checked.  An empty table gives an empty one; texts of any
length are read whole; columns other than the four are not read, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

SCHEMA_COLUMNS = "tool string, param string, type string, required boolean"
_KINDS = {"string": "^STRING", "number": "^(BIGINT|DOUBLE|DECIMAL|FLOAT)", "integer": "^BIGINT", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY", "null": "^VOID"}


def _parsed(text: Column) -> Column:
    """Calls and result id of a text, null where it is none."""
    object_ = F.when(text.rlike(r"^[ \t\n\r]*\{"), F.try_parse_json(text))
    return object_


def messages(conversations: DataFrame) -> DataFrame:
    """message (a hash of the whole one), conv_id, turn, role, content, calls (array of id, name, arguments), result_of."""
    own = F.xxhash64("conv_id", "turn", "role", "text")
    rows = conversations.select(own.alias("message"), "conv_id", F.col("turn").cast("long"), "role", "text", _parsed(F.col("text")).alias("v"))
    rows = rows.withColumns(
        {
            "calls": F.transform(F.try_variant_get("v", "$.tool_calls", "array<struct<id string, name string, arguments variant>>"), _with_parsed_arguments),
            "result_of": F.try_variant_get("v", "$.tool_call_id", "string"),
            "inner": F.try_variant_get("v", "$.content", "string"),
        }
    )
    special = F.col("calls").isNotNull() | F.col("result_of").isNotNull()
    further = F.filter(F.map_entries(F.expr("try_cast(v AS map<string, variant>)")), lambda e: ~e["key"].isin("tool_calls", "tool_call_id", "content", "role", "turn"))
    further = F.transform(further, lambda e: F.struct(e["key"].alias("key"), _inside(F.to_json(F.map_from_arrays(F.array(e["key"]), F.array(e["value"])))).alias("json")))
    return rows.select("message", "conv_id", "turn", "role", F.when(special, F.col("inner")).otherwise(F.col("text")).alias("content"), "calls", "result_of", F.when(special & (F.size(further) > 0), further).alias("further"))


def _with_parsed_arguments(call: Column) -> Column:
    """A call whose arguments, if they are a string, are the object that it holds."""
    given = call["arguments"]
    read = F.try_parse_json(F.try_variant_get(given, "$", "string"))
    is_object = F.coalesce(F.schema_of_variant(given) == "STRING", F.lit(False)) & F.coalesce(F.schema_of_variant(read).startswith("OBJECT"), F.lit(False))
    return F.struct(call["id"].alias("id"), call["name"].alias("name"), F.when(is_object, read).otherwise(given).alias("arguments"))


def _inside(json: Column) -> Column:
    """The text between an object's braces."""
    return F.substring(json, F.lit(2), F.length(json) - 2)


def checked_calls(rows: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """One row per call: message, conv_id, turn, id, name, arguments, problem (null if none)."""
    calls = rows.filter("calls IS NOT NULL").select("message", "conv_id", "turn", F.posexplode("calls").alias("at", "call")).select("message", "conv_id", "turn", "at", "call.id", "call.name", "call.arguments")
    if schemas is None:
        return calls.withColumn("problem", F.lit(None).cast("string"))
    tools = schemas.groupBy(F.col("tool").alias("name")).agg(F.collect_list(F.struct("param", "type", "required")).alias("params"))
    calls = calls.join(tools, "name", "left")
    kinds = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    given = F.expr("try_cast(arguments AS map<string, variant>)")
    keys = F.coalesce(F.map_keys(given), F.array().cast("array<string>"))
    names = F.transform("params", lambda p: p["param"])
    missing = F.transform(F.filter("params", lambda p: p["required"] & ~F.array_contains(keys, p["param"])), lambda p: F.concat(F.lit("missing "), p["param"]))
    unknown = F.transform(F.array_except(keys, names), lambda x: F.concat(F.lit("unknown "), x))
    wrong = F.filter("params", lambda p: F.array_contains(keys, p["param"]) & ~F.coalesce(F.rlike(F.schema_of_variant(F.try_element_at(given, p["param"])), F.try_element_at(kinds, p["type"])), F.lit(False)))
    wrong = F.transform(wrong, lambda p: F.concat(F.lit("type of "), p["param"]))
    found = F.array_join(F.array_sort(F.concat(missing, unknown, wrong)), "; ")
    problem = F.when(F.col("params").isNull(), F.concat(F.lit("unknown tool "), F.coalesce("name", F.lit("")))).when(found != "", found)
    return calls.withColumn("problem", problem).drop("params")


#: Below every turn.
_LOW = -(1 << 63)


def _contracted(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with one parent, each moved up to where its chain ends, and those whose chain does not.

    From place (after, step) of what a call hangs on, its links lead to
    (top, last) if top is later than after, else to (after, step + links).
    """
    lone = links.withColumn("parents", F.count("*").over(Window.partitionBy("conv_id", "id"))).filter("parents = 1")
    chains = store.keep(lone.select("conv_id", "id", F.col("parent").alias("up"), F.coalesce("turn", F.lit(_LOW)).alias("top"), F.lit(1).alias("last"), F.lit(1).alias("links"), "place"), "chat-chains")
    rounds = max(1, chains.count()).bit_length() + 1
    for _ in range(rounds):
        above = chains.select("conv_id", F.col("id").alias("up"), *[F.col(c).alias(f"{c}_above") for c in ("up", "top", "last", "links", "place")])
        open_ = chains.filter("place IS NULL").join(above, ["conv_id", "up"], "left")
        moved = F.col("links_above").isNotNull()
        later = F.col("top") > F.col("top_above")
        step = open_.select(
            "conv_id", "id", F.coalesce("up_above", "up").alias("up"), F.greatest("top", "top_above").alias("top"), F.when(moved & ~later, F.col("last_above") + F.col("links")).otherwise(F.col("last")).alias("last"),
            (F.col("links") + F.coalesce("links_above", F.lit(0))).alias("links"), F.col("place_above").alias("place"), moved.alias("moved"),
        )
        spent = chains
        chains = store.keep(chains.filter("place IS NOT NULL").withColumn("moved", F.lit(False)).unionByName(step), "chat-chains")
        store.drop(spent)
        if chains.filter("moved").isEmpty():
            break
    return chains.drop("moved"), chains.filter("moved")


def chained_places(rows: DataFrame, by_id: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Places (conv_id, result_of, call_after, call_step) of the calls that results make, and messages in a cycle.

    None where no linked result makes calls; other calls have their own turn and step 0.
    Of several such messages that make one call at its first turn, the last place counts.
    """
    made = rows.filter("calls IS NOT NULL AND result_of IS NOT NULL").select("conv_id", "turn", F.col("result_of").alias("parent"), F.explode("calls.id").alias("id")).filter("id IS NOT NULL").distinct()
    at = by_id.select("conv_id", F.col("result_of").alias("id"), F.col("linked_turn").alias("turn"))
    links = made.join(at, ["conv_id", "id", "turn"]).join(at.select("conv_id", F.col("id").alias("parent"), F.col("turn").alias("parent_turn")), ["conv_id", "parent"])
    links = store.keep(links, "chat-links")
    if links.isEmpty():
        return None
    inner = links.select("conv_id", F.col("id").alias("parent"), F.lit(True).alias("inner")).distinct()
    first = F.when(F.col("inner").isNull(), F.struct(F.col("parent_turn").alias("after"), F.lit(0).alias("step")))
    links = store.keep(links.join(inner, ["conv_id", "parent"], "left").withColumn("place", first).drop("inner"), "chat-open")
    settled, cycles = [], []
    while not links.isEmpty():
        chains, ended = _contracted(links)
        own = F.when(F.col("top") > F.coalesce("place.after", F.lit(_LOW)), F.struct(F.col("top").alias("after"), F.col("last").alias("step"))).otherwise(F.struct(F.col("place.after").alias("after"), (F.col("place.step") + F.col("links")).alias("step")))
        ready = chains.filter("place IS NOT NULL").select("conv_id", "id", own.alias("own"))
        # calls that several messages make at one turn wait for all of them
        many = links.join(chains.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
        after, step = F.col("place.after"), F.col("place.step")
        each = F.struct(F.greatest("turn", after).alias("after"), F.when(F.col("turn") > after, 1).otherwise(step + 1).alias("step"))
        ready = ready.unionByName(many.withColumn("own", each).groupBy("conv_id", "id").agg(F.max("own").alias("own"), F.count_if(F.col("place").isNull()).alias("waiting")).filter("waiting = 0").select("conv_id", "id", "own"))
        ready = store.keep(ready, "chat-places")
        if ready.isEmpty():
            ring, n, before = store.keep(links.filter("place IS NULL"), "chat-cycle"), -1, -2
            if many.isEmpty():  # then pointers that never ended have come to the ring itself
                ring = store.keep(ring.join(ended.select("conv_id", F.col("up").alias("id")).distinct(), ["conv_id", "id"], "left_semi"), "chat-cycle")
            while n != before:
                ring = store.keep(ring.join(ring.select("conv_id", F.col("parent").alias("id")).distinct(), ["conv_id", "id"], "left_semi"), "chat-cycle")
                before, n = n, ring.count()
            cycles.append(ring.select("conv_id", "turn", F.col("parent").alias("result_of")))
            behind = F.struct(F.greatest("turn", "parent_turn").alias("after"), F.lit(1).alias("step"))
            ready = store.keep(ring.withColumn("own", behind).groupBy("conv_id", "id").agg(F.max("own").alias("own")), "chat-places")
        settled.append(ready)
        links = links.join(ready.select("conv_id", "id"), ["conv_id", "id"], "left_anti")
        links = links.join(ready.select("conv_id", F.col("id").alias("parent"), "own"), ["conv_id", "parent"], "left")
        links = store.keep(links.withColumn("place", F.coalesce("place", "own")).drop("own"), "chat-open")
    places, cycle = settled[0], links.select("conv_id", "turn", F.col("parent").alias("result_of"))
    for x in settled[1:]:
        places = places.unionByName(x)
    for x in cycles:
        cycle = cycle.unionByName(x)
    return places.select("conv_id", F.col("id").alias("result_of"), F.col("own.after").alias("call_after"), F.col("own.step").alias("call_step")), cycle.distinct().withColumn("cycle", F.lit(True))


def format_messages(conversations: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """Per message: conv_id, turn, role, after, step, linked_turn, n_calls, problems, json."""
    rows = messages(conversations)
    calls = checked_calls(rows, schemas)
    by_id = calls.filter("id IS NOT NULL").groupBy("conv_id", F.col("id").alias("result_of")).agg(F.min("turn").alias("linked_turn"), F.count("*").alias("times"))
    # per message: what its own calls' checks and ids say
    own = calls.join(by_id.select("conv_id", F.col("result_of").alias("id"), "times"), ["conv_id", "id"], "left")
    said = F.concat_ws("; ", F.when(F.col("id").isNull(), F.lit("no id")), F.when(F.col("times") > 1, F.concat(F.lit("repeated id "), F.col("id"))), "problem")
    own = own.groupBy("message").agg(F.array_join(F.array_sort(F.collect_set(F.when(said != "", said))), "; ").alias("call_problems"))

    none = {"call_after": F.lit(None).cast("long"), "call_step": F.lit(None).cast("int"), "cycle": F.lit(None).cast("boolean")}
    plain = rows.filter("result_of IS NULL AND calls IS NULL").withColumns({"linked_turn": F.lit(None).cast("long"), "call_problems": F.lit("")} | none)
    tool = rows.filter("result_of IS NOT NULL OR calls IS NOT NULL").join(by_id.drop("times"), ["conv_id", "result_of"], "left").join(own, "message", "left")
    chained = chained_places(rows, by_id)
    tool = tool.withColumns(none) if chained is None else tool.join(chained[0], ["conv_id", "result_of"], "left").join(chained[1], ["conv_id", "turn", "result_of"], "left")
    every = plain.unionByName(tool)
    orphan = F.when(F.col("result_of").isNotNull() & F.col("linked_turn").isNull(), F.lit("no call"))
    linked = F.col("linked_turn").isNotNull()
    in_cycle = F.col("cycle").isNotNull()
    call_after = F.when(in_cycle, F.col("linked_turn")).otherwise(F.coalesce("call_after", "linked_turn"))
    call_step = F.when(in_cycle | (F.col("turn") > call_after), 0).otherwise(F.coalesce("call_step", F.lit(0)))
    ready = F.struct(
        "content",
        "role",
        F.col("result_of").alias("tool_call_id"),
        F.transform("calls", lambda c: F.struct(c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name"))).alias("tool_calls"),
        "turn",
    )
    # with further keys the parts are put together by their names
    own_parts = [F.struct(F.lit(n).alias("key"), _inside(F.to_json(F.struct(F.col(f"ready.{n}")))).alias("json")) for n in ("content", "role", "tool_call_id", "tool_calls", "turn")]
    parts = F.array_sort(F.filter(F.concat(F.array(*own_parts), F.col("further")), lambda x: x["json"] != ""))
    whole = F.concat(F.lit("{"), F.array_join(F.transform(parts, lambda x: x["json"]), ","), F.lit("}"))
    every = every.withColumn("ready", ready)
    return every.select(
        "conv_id",
        "turn",
        "role",
        F.greatest("turn", call_after).alias("after"),
        F.when(linked, call_step + 1).otherwise(0).alias("step"),
        "linked_turn",
        F.coalesce(F.size("calls"), F.lit(0)).alias("n_calls"),
        F.concat_ws("; ", F.when(F.col("call_problems") != "", F.col("call_problems")), orphan, F.when(in_cycle, F.lit("cycle"))).alias("problems"),
        F.when(F.col("further").isNotNull(), whole).otherwise(F.to_json("ready")).alias("json"),
    )
