"""Chat formatting: tool-call linking.

Calls and results are hash-joined by conversation and identifier, calls are ordered so that each follows the calls it refers
to, arguments are validated against schemas, and each exchange is serialised as canonical JSON (keys sorted, no white space).
No conversation is gathered in one place: an exchange is one row, and its place is ``(level, turn, nth)``, which sorts
any conversation topologically. Everything is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import cut

#: How a tool call and a tool's result are written in a message.
CALL, RESULT = r"(?s)<tool_call>(.*?)</tool_call>", r"(?s)<tool_result>(.*?)</tool_result>"


@dataclass(frozen=True)
class Param:
    """What an argument must be: its kind (string, integer, number, boolean, object, array), whether it must be there, the values allowed (as
    canonical JSON; none: all), the kind of an array's items, and an object's own parameters."""

    kind: str
    required: bool = False
    values: tuple[str, ...] = ()
    items: str | None = None
    fields: Mapping[str, Param] | None = None


#: tool -> parameter -> what it must be.
Schemas = Mapping[str, Mapping[str, Param]]
# What the engine calls the types of a JSON value.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "(?:BIGINT|DECIMAL|DOUBLE|FLOAT).*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def canonical(json: Column) -> Column:
    """The JSON with sorted keys and no white space; null where it does not parse."""
    return F.to_json(F.try_parse_json(json))


def parse_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (``conv_id, call_id, name, arguments, turn, nth``) and results (``conv_id, call_id, content, turn, nth``) out of messages.

    Marked calls and results are read from the texts. A turn of a user or the system without a marked call asks for the turn after it: it is
    a call of ``reply`` with its role and text as arguments and ``turn`` as identifier; an assistant's turn without a
    marked result answers the identifier ``turn - 1``. A mark's place is ``(turn, nth)``, ``nth`` counted from 0 within the turn; a null turn stands before all others. Null
    texts count as empty, marks that are not JSON are calls without identifier and name; other columns are not read.
    """
    m = messages.select("conv_id", "turn", "role", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = m.withColumns({"calls": F.regexp_extract_all(text, F.lit(CALL), F.lit(1)), "results": F.regexp_extract_all(text, F.lit(RESULT), F.lit(1))})
    marked = rows.select("conv_id", "turn", F.posexplode("calls").alias("nth", "json")).select(
        "conv_id",
        F.get_json_object("json", "$.id").alias("call_id"),
        F.get_json_object("json", "$.name").alias("name"),
        F.coalesce(F.get_json_object("json", "$.arguments"), F.when(F.try_parse_json("json").isNull(), F.col("json"))).alias("arguments"),
        "turn",
        "nth",
    )
    asked = rows.where("role in ('user', 'system') and size(calls) = 0 and size(results) = 0").select(
        "conv_id",
        F.col("turn").cast("string").alias("call_id"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct("role", text.alias("text"))).alias("arguments"),
        "turn",
        F.lit(0).alias("nth"),
    )
    given = rows.select("conv_id", "turn", F.posexplode("results").alias("nth", "json")).select(
        "conv_id", F.get_json_object("json", "$.id").alias("call_id"), F.get_json_object("json", "$.content").alias("content"), "turn", "nth"
    )
    said = rows.where("role = 'assistant' and size(calls) = 0 and size(results) = 0").select(
        "conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), text.alias("content"), "turn", F.lit(0).alias("nth")
    )
    return marked.unionByName(asked), given.unionByName(said)


def _checks(there: Column, label: str, p: Param) -> list[Column]:
    """What is wrong with one argument (a variant); nulls if nothing is."""
    none = F.lit(None).cast("string")
    typed = F.schema_of_variant(there)
    absent = there.isNull() | (typed == "VOID")
    right = ~absent & typed.rlike(f"^{TYPES[p.kind]}$")
    out = [F.when(absent, F.lit(f"missing {label}") if p.required else none).when(~right, f"{label} is not {p.kind}")]
    if p.values:
        out.append(F.when(right & ~F.to_json(there).isin(*p.values), f"{label} is none of its values"))
    if p.items:
        held = F.try_variant_get(there, "$", "array<variant>")
        out.append(F.when(right & F.exists(held, lambda x: ~F.schema_of_variant(x).rlike(f"^{TYPES[p.items]}$")), f"{label} holds what is not {p.items}"))
    for name, field in (p.fields or {}).items():
        out += [F.when(right, c) for c in _checks(F.try_variant_get(there, f"$['{name}']", "variant"), f"{label}.{name}", field)]
    return out


def violations(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments, in a fixed order; empty if nothing is. Arguments that the tool does not have come last, by name."""
    value = F.try_parse_json(arguments)
    flat = F.when(value.isNotNull() & ~F.schema_of_variant(value).rlike(f"^{TYPES['object']}$"), "arguments are not an object")
    checks = [F.when(value.isNull(), "arguments are not JSON"), flat, F.when(name.isNull() | ~name.isin(*schemas), "unknown tool")]
    keys = F.array_sort(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))
    odd = F.array().cast("array<string>")
    for tool, parameters in schemas.items():
        for parameter, p in parameters.items():
            checks += [F.when((name == tool) & value.isNotNull(), c) for c in _checks(F.try_variant_get(value, f"$['{parameter}']", "variant"), parameter, p)]
        odd = F.when((name == tool) & keys.isNotNull(), F.filter(keys, lambda k: ~k.isin(*parameters))).otherwise(odd)  # noqa: B023
    return F.concat(F.filter(F.array(*checks), lambda x: x.isNotNull()), F.transform(odd, lambda k: F.concat(F.lit("unknown argument "), k)))


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of calls that refer to calls standing later; null where references run in a circle, or lead into one.

    A reference is ``{"$ref": "identifier"}`` anywhere in the arguments. Where references only look back, ``(turn, nth)`` is an order
    already, and level 0 serves. Else, in the conversations concerned only, a call's level is the length of the longest chain below it. Calls with one reference are followed
    by doubling, so a chain of any length takes as many rounds as its length has binary digits; what then remains, calls with several references, is peeled off: such a
    call is ready when all it refers to are.
    """
    refs = calls.select(
        "conv_id", "call_id", F.struct("turn", "nth").alias("seq"), F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r'"\$ref"\s*:\s*"([^"]*)"'), F.lit(1)))).alias("to")
    ).where("call_id is not null")
    seqs = calls.where("call_id is not null").groupBy(F.col("conv_id").alias("c"), F.col("call_id").alias("t")).agg(F.min(F.struct("turn", "nth")).alias("at"))
    edges = refs.join(seqs, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("to") == F.col("t"))).select("conv_id", "call_id", "to", (F.col("at") >= F.col("seq")).alias("ahead"))
    edges = cut(edges.distinct())
    if edges.where("ahead").isEmpty():
        return edges.limit(0).select("conv_id", "call_id", F.lit(0).alias("level"))
    convs = edges.where("ahead").select(F.col("conv_id").alias("c")).distinct()
    left = edges.join(convs, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    left = left.select(F.struct("conv_id").alias("c"), F.col("call_id").alias("n"), "to").distinct()  # a struct equals one with the same null
    heads = left.groupBy("c", "n").agg(F.count("to").alias("refs"), F.min("to").alias("end"))
    several = heads.where("refs > 1").select("c", "n")
    # Chains of calls with one reference: where they end, and how far that is.
    single = cut(heads.where("refs = 1").select("c", "n", "end", F.lit(1).alias("far"), F.lit(True).alias("moved")))
    longest = single.groupBy("c").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length() + 1):  # what still moves then goes round in a circle
        up = single.select("c", F.col("n").alias("end"), F.col("end").alias("next"), F.col("far").alias("more"))
        single = cut(single.join(up, ["c", "end"], "left").select("c", "n", F.coalesce("next", "end").alias("end"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("moved")))
        if single.where("moved").isEmpty():
            break
    # Edges of calls with several references, over the chains; base is the level at the other end, null as long as that is open.
    ends = single.select("c", F.col("n").alias("to"), "end", "far", "moved")
    names = several.select("c", F.col("n").alias("end"), F.lit(True).alias("several"))
    web = left.join(several, ["c", "n"]).join(ends, ["c", "to"], "left").select("c", "n", F.coalesce("end", "to").alias("end"), (F.coalesce("far", F.lit(0)) + 1).alias("far"), F.coalesce("moved", F.lit(False)).alias("lost"))
    web = cut(web.join(names, ["c", "end"], "left").select("c", "n", "end", "far", F.when(~F.col("lost") & F.col("several").isNull(), 0).alias("base")))
    every = web.select("c", "n").distinct()
    peeled = web.limit(0).select("c", "n", F.lit(0).alias("level"))
    while not web.isEmpty():
        ready = cut(web.groupBy("c", "n").agg(F.max(F.col("far") + F.col("base")).alias("level"), F.count_if(F.col("base").isNull()).alias("open")).where("open = 0").select("c", "n", "level"))
        if ready.isEmpty():
            break
        peeled = peeled.unionByName(ready)
        found = ready.select("c", F.col("n").alias("end"), "level")
        web = cut(web.join(ready, ["c", "n"], "left_anti").join(found, ["c", "end"], "left").select("c", "n", "end", "far", F.coalesce("base", "level").alias("base")))
    of_several = every.join(peeled, ["c", "n"], "left")
    below = of_several.select("c", F.col("n").alias("end"), "level", F.lit(True).alias("several"))
    of_single = single.join(below, ["c", "end"], "left").select("c", "n", F.when(~F.col("moved") & (F.col("several").isNull() | F.col("level").isNotNull()), F.col("far") + F.coalesce("level", F.lit(0))).alias("level"))
    return of_several.select("c", "n", "level").unionByName(of_single).select("c.conv_id", F.col("n").alias("call_id"), F.col("level").cast("int").alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """``conv_id, call_id, status, level, turn, nth, name, valid, problems, json``: a row for each call and each orphan result.

    A result belongs to the call of its conversation with its identifier; where several do, the earliest is taken, and
    a call repeated under one identifier is answered each time. ``status`` is linked, no_result, early_result (the result stands before
    the call) or orphan_result; ``level`` is null for calls that refer to each other in a circle. Null identifiers
    link with nothing; a null conversation is a conversation like any other. ``json`` is canonical; arguments that are not JSON stand in it
    as a string. Empty tables give an empty result.
    """
    first = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct(F.struct("turn", "nth").alias("seq"), F.col("content"))).alias("r"))
    first = first.select(F.col("conv_id").alias("rc"), F.col("call_id").alias("ri"), F.col("r.seq").alias("result_seq"), F.col("r.content").alias("content"))
    level = levels(calls).select(F.col("conv_id").alias("lc"), F.col("call_id").alias("li"), "level", F.lit(True).alias("leveled"))
    linked = (
        calls.join(first, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("call_id") == F.col("ri")), "left")
        .join(level, F.col("conv_id").eqNullSafe(F.col("lc")) & (F.col("call_id") == F.col("li")), "left")
        .withColumn("level", F.when(F.col("leveled"), F.col("level")).otherwise(F.lit(0)))
        .withColumn("problems", violations(F.col("name"), F.col("arguments"), schemas))
        .withColumn("status", F.when(F.col("result_seq").isNull(), "no_result").when(F.col("result_seq") < F.struct("turn", "nth"), "early_result").otherwise("linked"))
    )
    known = calls.where("call_id is not null").select(F.col("conv_id").alias("kc"), F.col("call_id").alias("ki")).distinct()
    orphans = results.join(known, F.col("conv_id").eqNullSafe(F.col("kc")) & (F.col("call_id") == F.col("ki")), "left_anti").select(
        "conv_id", "call_id", F.lit("orphan_result").alias("status"), F.lit(0).alias("level"), "turn", "nth", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), "content",
        F.array().cast("array<string>").alias("problems"),
    )
    rows = linked.select("conv_id", "call_id", "status", "level", "turn", "nth", "name", "arguments", "content", "problems").unionByName(orphans)
    text = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.expr(f"substr(to_json(struct({c} as v)), 6, length(to_json(struct({c} as v))) - 6)"))
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(F.col("arguments")), text("arguments")),
        F.lit(',"id":'), text("call_id"),
        F.lit(',"name":'), text("name"),
        F.lit(',"result":'), text("content"),
        F.lit("}"),
    )
    return rows.select("conv_id", "call_id", "status", "level", "turn", "nth", "name", (F.size("problems") == 0).alias("valid"), F.array_join("problems", "; ").alias("problems"), json.alias("json"))
