"""Chat formatting with tool-call linking.

Calls and results are joined by identifier, records are put in topological order of what
they reply to, arguments are validated against schemas, and every record becomes one line
of canonical JSON: keys sorted, no blanks, numbers in one form. Everything is a DataFrame
expression or join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.numbering import number_rows
from shelfmark.functions.skew import attach_groups
from shelfmark.session import materialize

# JSON types a schema may name, by how variants describe their values.
TYPES = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "BIGINT|DOUBLE|FLOAT|DECIMAL.*",
    "boolean": "BOOLEAN",
    "null": "VOID",
    "array": "ARRAY.*",
    "object": "OBJECT.*",
}
# Rounds of doubling reach 2 ** ROUNDS replies; what then has no end goes in circles.
ROUNDS = 40


def topological(records: DataFrame) -> DataFrame:
    """``root`` and ``depth`` (replies since the root, -1 in or behind a circle) of each id.

    ``records`` has id (unique, not null) and parent (an id, or null or unknown for roots).
    Sorted by depth, every record comes after what it replies to. Each round doubles how far
    a record looks back, so a chain of n replies takes log n rounds, each written.
    """
    known = records.select(F.col("id").alias("_known"))
    state = records.join(known, F.col("parent") == F.col("_known"), "left").select(
        "id",
        F.col("_known").alias("ahead"),
        F.when(F.col("_known").isNull(), 0).otherwise(1).cast("long").alias("depth"),
    )
    state = materialize(state.withColumn("root", F.coalesce("ahead", "id")), "replies")
    total = state.count()
    for done in range(ROUNDS):
        open_ = state.filter(F.col("ahead").isNotNull())
        if 2**done > total or open_.isEmpty():  # no chain is longer than the table
            break
        further = state.select(
            F.col("id").alias("_at"),
            F.col("ahead").alias("_ahead"),
            F.col("depth").alias("_depth"),
            F.col("root").alias("_root"),
        )
        moved = open_.join(further, F.col("ahead") == F.col("_at")).select(
            "id",
            F.col("_ahead").alias("ahead"),
            (F.col("depth") + F.col("_depth")).alias("depth"),
            F.col("_root").alias("root"),
        )
        state = materialize(state.filter(F.col("ahead").isNull()).unionByName(moved), "replies")
    return state.select(
        "id",
        F.when(F.col("ahead").isNull(), F.col("root")).alias("root"),
        F.when(F.col("ahead").isNull(), F.col("depth")).otherwise(-1).alias("depth"),
    )


def canonical(json: Column) -> Column:
    """Canonical text of a JSON text; null if it is not JSON or repeats a key."""
    return F.to_json(F.try_parse_json(json))


def _fits(kind: Column, wanted: Column) -> Column:
    fits = F.lit(False)
    for name, pattern in TYPES.items():
        fits = fits | ((wanted == name) & F.coalesce(kind.rlike(f"^({pattern})$"), F.lit(False)))
    return fits


def _field_errors(entries: Column, fields: Column, of: T.StructType, prefix: Column) -> Column:
    """What is wrong with the values of an object (a map of variants), fields within fields included."""
    has = set(of.names)
    keys = F.map_keys(entries)
    as_type = lambda value, kind: F.try_variant_get(value, F.lit("$"), kind)

    def wrong(f: Column) -> Column:
        value, name = F.element_at(entries, f["name"]), F.concat(prefix, f["name"])
        kind = F.schema_of_variant(value)
        told = lambda what, when: F.when(when, F.concat(F.lit(what + ": "), name))
        found = [told("length", (kind == "STRING") & (F.char_length(as_type(value, "string")) > f["max_length"]))]
        if "minimum" in has:
            found.append(told("below", as_type(value, "double") < f["minimum"]))
        if "maximum" in has:
            found.append(told("above", as_type(value, "double") > f["maximum"]))
        if "enum" in has:
            found.append(told("not one of", ~F.array_contains(f["enum"], as_type(value, "string"))))
        if "items" in has:
            other = F.exists(as_type(value, "array<variant>"), lambda x: ~_fits(F.schema_of_variant(x), f["items"]))
            found.append(told("items", f["items"].isNotNull() & other))
        deeper = F.array().cast("array<string>")
        if "fields" in has:
            inner = _field_errors(as_type(value, "map<string,variant>"), f["fields"], of["fields"].dataType.elementType, F.concat(name, F.lit(".")))
            deeper = F.when(f["fields"].isNotNull() & (f["type"] == "object"), inner).otherwise(deeper)
        return (
            F.when(~F.array_contains(keys, f["name"]), F.array(told("missing", f["required"])))
            .when(~_fits(kind, f["type"]), F.array(told("type", F.lit(True))))
            .otherwise(F.concat(F.array(*found), deeper))
        )

    unknown = F.transform(
        F.array_except(keys, F.transform(fields, lambda f: f["name"])), lambda k: F.concat(F.lit("unknown: "), prefix, k)
    )
    return F.concat(F.flatten(F.transform(fields, wrong)), unknown)


def argument_errors(arguments: Column, fields: Column, of: T.StructType) -> Column:
    """What is wrong with the arguments, sorted; ``fields`` is an array of structs ``of``.

    A struct has name, type, required, max_length, and may have minimum and maximum (of
    numbers), enum (array of strings), items (type of an array's elements) and fields (of an
    object, again such an array). Null means no limit. Values are only checked further if
    their type fits.
    """
    entries = F.from_json(arguments, "map<string,variant>")
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(arguments)).startswith("OBJECT"), F.lit(False))
    found = _field_errors(entries, fields, of, F.lit(""))
    return (
        F.when(fields.isNull(), F.array(F.lit("tool")))
        .when(~is_object, F.array(F.lit("not an object")))
        .otherwise(F.array_sort(F.filter(found, lambda e: e.isNotNull())))
    )


def _numbered(records: DataFrame, values: list[str]) -> DataFrame:
    """Records numbered from 1 among those of their id, by a hash of their values; none is left out."""
    rows = records.select("id", *values, F.xxhash64(*values).alias("_tie"))
    return materialize(number_rows(rows, ["_tie"], group_by=["id"], name="number"), "records").drop("_tie")


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Linked, ordered, validated and serialised calls and results; every record is in one row.

    ``calls``: id, parent, tool, arguments (JSON text). ``results``: id (of the call they
    answer), content. ``schemas``: tool, fields (see ``argument_errors``), one row for each
    tool. Other columns are not read. Returns id, status, number, root, depth, errors, json.
    An id normally has one call and one result; if it has more, they are numbered in a fixed
    order (equal ones in any), and the n-th result belongs to the n-th call. status is
    ``linked`` for a call with its result, ``no result`` for a call and ``no call`` for a
    result that is left over, ``no id`` for records without id, which are linked with
    nothing. root and depth say where the id is in the topological order of its first call
    (null without call or id); errors are sorted, null without call. A tool without schema
    gives the error ``tool``, null or malformed arguments ``not an object``, and malformed
    arguments are null in the JSON. Empty tables are fine.
    """
    every_call = _numbered(calls, ["parent", "tool", "arguments"])
    every_result = _numbered(results, ["content"])
    order = topological(every_call.filter("id is not null and number = 1").select("id", "parent"))
    counts = every_call.filter("id is not null").groupBy("id").agg(F.count("*").alias("n_files"))
    placed = attach_groups(every_call, materialize(order.join(counts, "id"), "order"), ["id"], spread_by="number").drop("n_files")
    per_tool = every_call.groupBy("tool").agg(F.count("*").alias("n_files")).join(schemas.select("tool", "fields"), "tool")
    checked = attach_groups(placed, materialize(per_tool, "tools"), ["tool"], spread_by=F.struct("id", "number"))
    of = schemas.schema["fields"].dataType.elementType
    checked = checked.withColumn("errors", argument_errors(F.col("arguments"), F.col("fields"), of)).drop("n_files", "fields")

    answers = every_result.select(F.col("id").alias("_id"), F.col("number").alias("_number"), "content")
    # An id and a number are one call and one result at most, so no key is hot. Null ids meet nothing.
    same = (F.col("id") == F.col("_id")) & (F.col("number") == F.col("_number"))
    both = checked.join(answers, same, "full")
    has_call, has_result = F.col("number").isNotNull(), F.col("_number").isNotNull()
    status = (
        F.when(F.coalesce("id", "_id").isNull(), "no id")
        .when(has_call & has_result, "linked")
        .when(has_call, "no result")
        .otherwise("no call")
    )
    record = F.to_json(
        F.struct(  # fields in the order of their names; null ones are left out
            F.try_parse_json("arguments").alias("arguments"),
            F.col("content"),
            F.col("depth"),
            F.col("errors"),
            F.coalesce("id", "_id").alias("id"),
            F.col("root"),
            F.col("tool"),
        )
    )
    return both.select(
        F.coalesce("id", "_id").alias("id"),
        status.alias("status"),
        F.coalesce("number", "_number").alias("number"),
        "root",
        "depth",
        "errors",
        record.alias("json"),
    )


def conversation_records(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as calls and results: what is said to the model calls it.

    ``turns`` has conv_id, turn, role, text. A user or system turn is a call of the tool
    named like its role, with the id ``conv_id:turn``, replying to the turn before; an
    assistant turn is the result of the turn before it. Turns of other or no roles are
    calls of a tool that has no schema. Turns without conv_id or turn have no id.
    """
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    name = lambda back: F.when(whole, F.concat_ws(":", F.col("conv_id"), F.col("turn") - back))
    is_result = F.coalesce(F.col("role") == "assistant", F.lit(False))
    calls = turns.filter(~is_result).select(
        name(0).alias("id"),
        # The turn before is the answer to the one before that, or a system turn.
        F.when(F.col("turn") > 1, name(2)).when(F.col("turn") == 1, name(1)).alias("parent"),
        F.coalesce("role", F.lit("")).alias("tool"),
        F.to_json(F.struct(F.col("text").alias("content"), F.col("turn").alias("turn"))).alias("arguments"),
    )
    results = turns.filter(is_result).select(name(1).alias("id"), F.col("text").alias("content"))
    return calls, results
