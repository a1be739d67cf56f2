"""Deeply nested JSON records turned into flat, linked tables.

Payloads are parsed to VARIANT, a merged schema of all files is inferred from the data, and each
array level is exploded into a child table that carries its parent's key and its own ordinal.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partwright.session import cut


def parsed(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``_key`` and ``doc`` VARIANT for each payload that is one whole JSON object or array.

    The parser stops at the end of the first value; a sentinel placed behind the text shows whether
    anything else follows.  A leading byte order mark is no part of the text.
    """
    text = F.regexp_replace(F.col(payload), "^﻿", "")
    rows = df.select(F.col(key).alias("_key"), F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"~end~"]'))).alias("_w"))
    whole = (F.try_variant_get("_w", "$[1]", "string") == "~end~") & F.try_variant_get("_w", "$[2]", "string").isNull()
    return rows.filter(whole).select("_key", F.try_variant_get("_w", "$[0]", "variant").alias("doc")).filter(
        F.schema_of_variant("doc").rlike("^(OBJECT|ARRAY)")
    )


def merged_schema(docs: DataFrame, column: str = "doc") -> str:
    """The schema that all documents share, in Spark's notation for VARIANT; '' for a table without any."""
    row = docs.agg(F.schema_of_variant_agg(column).alias("s")).first()
    return (row["s"] if row else None) or ""


# Most places a table of payloads may have; more mean that keys are data, which no schema can be inferred from.
MAX_PLACES = 20_000


def places_in(schema: str, above: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """The places of a schema as (JSON array of steps, kind): names, and "[]" for each step into an array; kind is ARRAY, OBJECT, VARIANT (types differ) or VALUE."""
    found: list[tuple[str, str]] = []

    def walk(at: int, path: tuple[str, ...]) -> int:
        kind = "OBJECT" if schema.startswith("OBJECT<", at) else "ARRAY" if schema.startswith("ARRAY<", at) else "VARIANT" if schema.startswith("VARIANT", at) else "VALUE"
        if path:
            found.append((json.dumps(path), kind))
        if kind == "OBJECT":
            at += 7
            while schema[at] != ">":
                if schema[at] == "`":
                    end = schema.index("`: ", at + 1)
                    label, at = schema[at + 1 : end].replace("``", "`"), end + 3
                else:
                    end = schema.index(": ", at)
                    label, at = schema[at:end], end + 2
                at = walk(at, (*path, label))
                if schema.startswith(", ", at):
                    at += 2
            return at + 1
        if kind == "ARRAY":
            return walk(at + 6, (*path, "[]")) + 1
        while at < len(schema) and schema[at] not in ",>":
            if schema[at] == "(":
                at = schema.index(")", at)
            at += 1
        return at

    if schema:
        walk(0, above)
    return found


def _places_of(nodes: DataFrame, above: list[tuple[str, ...]]) -> set[tuple[str, str]]:
    """The distinct (steps, kind) over the own schemas of ``node``, which lies at the place ``above[at]``."""

    def run(batches):
        import pandas as pd

        sent: set[tuple[str, str]] = set()
        for pdf in batches:
            new = {x for at, schema in set(zip(pdf["at"], pdf["s"])) for x in places_in(schema, above[at])} - sent
            if len(sent) <= MAX_PLACES:
                sent |= new
            yield pd.DataFrame(sorted(new), columns=["steps", "kind"], dtype="object")

    found = cut(nodes.select("at", F.schema_of_variant("node").alias("s")).mapInPandas(run, "steps string, kind string").distinct())
    n = found.count()
    if n > MAX_PLACES:
        raise ValueError(f"{n} places in the payloads: keys are data")
    return {(r["steps"], r["kind"]) for r in found.collect()}


def places(docs: DataFrame, record: str, asked: dict[str, Table] | None = None, column: str = "doc") -> list[tuple[tuple[str, ...], str]]:
    """The merged schema of all documents as the distinct (steps, kind), shallowest first.

    Every document's own schema is read and the places are merged, so that files that differ in shape still
    show theirs.  Where the elements of one document differ (VARIANT) each element's own schema is read, in
    one more pass for all such places, if some table can lie below.  Places are as many as the format has
    fields; beyond MAX_PLACES keys are data and an error says so.
    """
    found = _places_of(docs.select(F.lit(0).alias("at"), F.col(column).alias("node")), [()])
    wanted = [tuple(k.split(".")) for k in asked] if asked else None
    done: set[tuple[str, ...]] = set()
    while True:
        todo = []
        for at, kind in sorted(found):
            steps = tuple(json.loads(at))
            below = _names(steps[steps.index(record) + 1 :]) if record in steps else ()
            if kind == "VARIANT" and steps not in done and (wanted is None or any(len(w) > len(below) and w[: len(below)] == below for w in wanted)):
                todo.append(steps)
        if not todo:
            return sorted(((tuple(json.loads(at)), kind) for at, kind in found), key=lambda p: (len(p[0]), p))
        done.update(todo)
        each = [docs.select(F.lit(i).alias("at"), F.explode(nodes_at(F.col(column), steps)).alias("node")) for i, steps in enumerate(todo)]
        found |= _places_of(reduce(DataFrame.unionByName, each), todo)


def record_places(found: list[tuple[tuple[str, ...], str]], record: str) -> list[tuple[str, ...]]:
    """The steps that lead to fields called ``record`` outside other records, shallowest first, arrays above them included."""
    out = [steps for steps, _ in found if steps[-1] == record and record not in steps[:-1]]
    return list(dict.fromkeys(out))


def _names(steps: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(s for s in steps if s != "[]")


def list_places(found: list[tuple[tuple[str, ...], str]], record: str, asked: dict[str, Table] | None = None) -> list[tuple[str, ...]]:
    """The names that lead from a record to each of its lists: places that are an array in at least one document, and asked places that occur."""
    out = set()
    for steps, kind in found:
        below = _names(steps[steps.index(record) + 1 :]) if record in steps else ()
        if below and (kind == "ARRAY" or (asked and ".".join(below) in asked)):
            out.add(below)
    return sorted(out)


def _path(names: tuple[str, ...]) -> str:
    return "$" + "".join(f".{n}" if n.isidentifier() else "['" + n.replace("'", "\\'") + "']" for n in names)


def nodes_at(node: Column, steps: tuple[str, ...]) -> Column:
    """The nodes that the steps lead to, through the elements of every array on the way."""
    if "[]" not in steps:
        return F.array_compact(F.array(F.try_variant_get(node, _path(steps), "variant") if steps else node))
    at = steps.index("[]")
    above = F.try_variant_get(node, _path(steps[:at]), "variant") if at else node
    return F.flatten(F.transform(elements(above), lambda x: nodes_at(x, steps[at + 1 :])))


def gathered(node: Column, steps: tuple[str, ...]) -> Column:
    """All elements of the lists that the steps lead to."""
    return F.flatten(F.transform(nodes_at(node, steps), elements))


def text_of(node: Column) -> Column:
    """The text of a scalar node as stored; null for a missing or JSON null one."""
    return F.try_variant_get(node, "$", "string")


def unwrapped(node: Column) -> Column:
    """The node, or what it holds where it is a string that is itself a JSON object or array."""
    inner = text_of(node)
    return F.when(F.schema_of_variant(node).eqNullSafe("STRING") & inner.rlike("^\\s*[\\[{]"), F.coalesce(F.try_parse_json(inner), node)).otherwise(node)


def elements(node: Column) -> Column:
    """The node's elements as an array: a list's own, a single object or scalar as one, none for null."""
    n = unwrapped(node)
    return F.coalesce(
        F.try_variant_get(n, "$", "array<variant>"),
        F.when(n.isNotNull() & ~F.is_variant_null(n), F.array(n)),
        F.array().cast("array<variant>"),
    )


def single(node: Column) -> Column:
    """A part that should be one object: the object itself, unwrapped from text or from a list."""
    return F.try_element_at(elements(node), F.lit(1))


def named_value(node: Column, name: str) -> Column:
    """Field ``name`` of an object, also where the object is text or a list of name-value pairs."""
    items = elements(node)
    pairs = F.filter(items, lambda x: F.try_variant_get(x, "$.name", "string") == name)
    by_pair = F.try_variant_get(F.try_element_at(pairs, F.lit(1)), "$.value", "string")
    by_field = F.try_element_at(F.filter(F.transform(items, lambda x: F.try_variant_get(x, f"$.{name}", "string")), lambda x: x.isNotNull()), F.lit(1))
    return F.coalesce(by_field, by_pair)


@dataclass(frozen=True)
class Table:
    """What is asked of one place below a record: the table's name and the field its value is taken from.

    ``single`` tables hold one row per parent; ``pairs`` also reads the value from a list of name-value pairs.
    """

    name: str
    value: str
    single: bool = False
    pairs: bool = False


@dataclass(frozen=True)
class Level:
    """One child table as inferred: the names from the parent's element to its list, and the levels below."""

    steps: tuple[str, ...]
    below: tuple[str, ...]
    table: Table | None
    children: tuple[Level, ...] = field(default_factory=tuple)


def levels_of(lists: list[tuple[str, ...]], asked: dict[str, Table] | None) -> tuple[Level, ...]:
    """The tree of levels: every list hangs from the longest list above it.  With ``asked`` only those and what leads to them are kept."""
    every = sorted(set(lists))
    above = {p: max((q for q in every if q != p and p[: len(q)] == q), key=len, default=()) for p in every}

    def build(parent: tuple[str, ...]) -> tuple[Level, ...]:
        out = []
        for p in every:
            if above[p] == parent:
                table = asked.get(".".join(p)) if asked else Table(".".join(p), "")
                children = build(p)
                if table or children:
                    out.append(Level(p, p[len(parent) :], table, children))
        return tuple(out)

    return build(())


def _value(table: Table, node: Column) -> Column:
    if not table.value:
        return F.when(~F.is_variant_null(node), F.coalesce(F.when(~F.schema_of_variant(node).rlike("^(OBJECT|ARRAY)"), text_of(node)), F.to_json(node)))
    return F.coalesce(F.try_variant_get(node, _path((table.value,)), "string"), F.when(F.schema_of_variant(node).eqNullSafe("STRING"), text_of(node)))


def _rows(level: Level, node: Column, way: Column) -> Column:
    """All rows of a level below a node, as an array of structs, its children's after each element; ``way`` holds the ordinals above."""
    place = F.try_variant_get(node, _path(level.below), "variant")
    empty = F.array().cast("array<struct<child_table:string,ordinals:array<int>,child_value:string>>")

    def one(value: Column, no: Column) -> Column:
        return F.array(F.struct(F.lit(level.table.name).alias("child_table"), F.concat(way, F.array(no)).alias("ordinals"), value.alias("child_value")))

    if level.table and level.table.single:
        value = named_value(place, level.table.value) if level.table.pairs else F.try_variant_get(single(place), _path((level.table.value,)), "string")
        return one(value, F.lit(1))

    def each(x: Column, i: Column) -> Column:
        no = (i + 1).cast("int")
        own = one(_value(level.table, x), no) if level.table else empty
        return F.concat(own, *[_rows(c, x, F.concat(way, F.array(no))) for c in level.children]) if level.children else own

    return F.flatten(F.transform(elements(place), each))


def flatten_records(df: DataFrame, key: str, payload: str, record: str, asked: dict[str, Table] | None = None) -> DataFrame:
    """The child tables of all ``record`` elements of all payloads, stacked: key, ``record_no``, ``child_table``, ``ordinals``, ``child_value``.

    The schema is merged from all documents: it gives the places of the records, below objects and arrays
    alike, and every list below a record with the list it hangs from.  ``asked`` (place below the record,
    names joined by points -> Table) picks and names tables; without it each list is a table under its
    place, elements that are objects as JSON.  ``ordinals`` is the full path of positions from 1, so
    (key, record_no, ordinals) identifies a row and without its last member the parent.  Null, broken or
    incomplete payloads and null or missing values give no row, repeated payloads give their rows under
    each key, extra columns are ignored, and a table without any whole payload gives an empty result.
    """
    docs = parsed(df, key, payload)
    found = places(docs, record, asked)
    at = record_places(found, record) or [(record,)]
    tries = [gathered(F.col("doc"), steps) for steps in at]
    records = F.coalesce(*[F.when(F.size(t) > 0, t) for t in tries])
    rows = docs.select("_key", F.posexplode(records).alias("_at", "rec"))
    levels = levels_of(list_places(found, record, asked), asked)
    if not levels:
        return rows.select(F.col("_key").alias(key), F.lit(1).alias("record_no"), F.lit("").alias("child_table"), F.array().cast("array<int>").alias("ordinals"), F.lit("").alias("child_value")).filter("false")
    kept = F.filter(F.concat(*[_rows(level, F.col("rec"), F.array().cast("array<int>")) for level in levels]), lambda r: r["child_value"].isNotNull())
    return rows.select(F.col("_key").alias(key), (F.col("_at") + 1).cast("int").alias("record_no"), F.inline(kept))


def child_table(flat: DataFrame, key: str, table: str) -> DataFrame:
    """One flat table of the stack with surrogate keys: ``row_key`` for the row, ``parent_key`` for its parent."""
    return linked(flat.filter(F.col("child_table") == table), key).select(key, "record_no", "row_key", "parent_key", "child_no", F.col("child_value").alias("value"))


def linked(flat: DataFrame, key: str) -> DataFrame:
    """The stack with ``row_key`` and ``parent_key`` of every row, made of the key, the record and all ordinals on the way."""
    way = lambda ordinals: F.concat_ws("/", F.col(key), F.col("record_no"), F.array_join(F.transform(ordinals, lambda x: x.cast("string")), "/"))
    o = F.col("ordinals")
    above = F.slice(o, F.lit(1), F.size(o) - 1)
    parent = F.when(F.size(o) > 1, way(above)).otherwise(F.concat_ws("/", F.col(key), F.col("record_no")))
    return flat.select(key, "record_no", "child_table", way(o).alias("row_key"), parent.alias("parent_key"), F.element_at(o, -1).alias("child_no"), "child_value")


# The tables of an execution trace: where they lie, what they are called, and the field their value is taken from.
TRACE_TABLES = {
    "phase4": Table("phase4", "status", single=True), "input_brand_fields": Table("brand", "Unilog_Brand", single=True, pairs=True),
    "phase5.domain_candidates": Table("domain_candidate", "domain"), "phase5.documents": Table("document", "document_id"), "phase5.documents.chunks": Table("chunk", "chunk_id"),
}


def flatten_traces(df: DataFrame) -> DataFrame:
    """The trace tables of ``trace_runs`` with ``trace_no`` as the record's position and ``parent_no`` of a chunk's document, else 0."""
    flat = flatten_records(df, "run_id", "payload", "traces", TRACE_TABLES).withColumnRenamed("record_no", "trace_no")
    o = F.col("ordinals")
    return flat.withColumn("child_no", F.element_at(o, -1)).withColumn("parent_no", F.when(F.size(o) > 1, F.try_element_at(o, F.lit(-2))).otherwise(0))
