"""Nested JSON documents to related flat tables by shared inlining.

The schema graph has one node per element name; an edge runs from the enclosing object's element to the
element of an object below it and is starred where the object stands in a list. Elements that repeat, are
shared by several parents or recursive (which makes them shared) get a table of their own, all other
objects are inlined as dotted columns of the nearest enclosing table. Every row knows its own path and
that of its parent row, which is the foreign key. The elements with a table are sent to the tasks while the
schema graph is small; of a graph that isn't, each document is joined with the ones of its own elements.

Names stand in paths, columns and table names as they are, in double quotes as in JSON if they hold a sign of the notation
(``.``, ``[``, ``]``, ``"``) or nothing, so ``{"a.b": 1, "a": {"b": 2}}`` has the columns ``"a.b"`` and ``a.b``.

Defined results: a document that is null, unreadable, not strict JSON (NaN, trailing text) or no object
gives no row; a JSON string that holds such an object is read as that object; with a repeated key the last
one counts; empty lists and objects stay visible as ``[]`` and ``{}`` in the parent's columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veinstone.session import cut


#: Above so many different edges the elements with a table aren't sent to the tasks whole, but to each document its own.
MAX_EDGES = 200_000

_SALTS = 32
NODE_SCHEMA = "doc_id string, table_name string, node_path string, parent_path string, in_list boolean, kind string, fields map<string,string>"


class Number(str):
    """A number as it is spelled in the document."""


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not strict JSON")


_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?", re.ASCII)
_SIGNS = re.compile(r'[.\[\]"]')
_SPACE = re.compile(r"[ \t\n\r]*")


def _parse_deep(text: str) -> object:
    """Strict JSON of any depth with a stack of our own, for documents that are too deep for the standard parser."""
    root: list = []
    stack: list[tuple[object, str | None]] = [(root, None)]
    at = _SPACE.match(text, 0).end()
    expect_value, after_comma = True, False

    def put(value: object) -> None:
        into, key = stack[-1]
        if isinstance(into, list):
            into.append(value)
        else:
            into[key] = value

    def read_key(i: int) -> int:
        if text[i : i + 1] != '"':
            raise ValueError("key expected")
        key, i = scanstring(text, i + 1, True)
        i = _SPACE.match(text, i).end()
        if text[i : i + 1] != ":":
            raise ValueError("colon expected")
        stack[-1] = (stack[-1][0], key)
        return _SPACE.match(text, i + 1).end()

    while True:
        mark = text[at : at + 1]
        if expect_value:
            if mark in ("{", "["):
                value: object = {} if mark == "{" else []
                put(value)
                stack.append((value, None))
                at = _SPACE.match(text, at + 1).end()
                if text[at : at + 1] == ("}" if mark == "{" else "]"):
                    expect_value, after_comma = False, False
                    continue
                if mark == "{":
                    at = read_key(at)
                continue
            if mark == '"':
                value, at = scanstring(text, at + 1, True)
            elif found := _NUMBER.match(text, at):
                value, at = Number(found.group()), found.end()
            else:
                for word, value in (("true", True), ("false", False), ("null", None)):
                    if text.startswith(word, at):
                        at += len(word)
                        break
                else:
                    raise ValueError("value expected")
            put(value)
            at = _SPACE.match(text, at).end()
            expect_value = False
            continue
        if len(stack) == 1:
            if at != len(text):
                raise ValueError("text after the document")
            return root[0]
        inside_list = isinstance(stack[-1][0], list)
        if mark == ("]" if inside_list else "}"):
            stack.pop()
            at = _SPACE.match(text, at + 1).end()
        elif mark == ",":
            at = _SPACE.match(text, at + 1).end()
            if not inside_list:
                at = read_key(at)
            expect_value = True
        else:
            raise ValueError("comma or end expected")


def _parse(text: str) -> object:
    try:
        return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=_no_constant)
    except RecursionError:
        return _parse_deep(text)


def parse_document(text: str | None) -> dict | None:
    """The object in text, or in the JSON string that text is; None if there is none."""
    if text is None:
        return None
    try:
        value = _parse(text)
        if isinstance(value, str) and not isinstance(value, Number):
            value = _parse(value)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _scalar(value: object) -> str:
    return value if isinstance(value, Number) else json.dumps(value, ensure_ascii=False)


def _top(doc: dict, single_as_list: Iterable[str]) -> dict:
    fixed = {k: [doc[k]] for k in single_as_list if isinstance(doc.get(k), dict)}
    return {**doc, **fixed} if fixed else doc


def schema_edges(doc: dict, root: str) -> set[tuple[str, str, bool]]:
    """(parent element, element, in a list) of every object and list that isn't empty below the document."""
    edges: set[tuple[str, str, bool]] = set()
    todo: list[tuple[object, str, str, bool]] = [(doc, root, root, False)]
    while todo:
        value, owner, label, starred = todo.pop()
        if isinstance(value, dict):
            if value is not doc:
                edges.add((owner, label, starred))
            todo.extend((v, label, k, False) for k, v in value.items() if isinstance(v, (dict, list)))
        else:
            if value:
                edges.add((owner, label, True))
            todo.extend((v, owner, label, True) for v in value if isinstance(v, (dict, list)))
    return edges


def relations(edges: Iterable[tuple[str, str, bool]], root: str) -> set[str]:
    """Elements with a table of their own: the root, repeated ones and those with several parents."""
    own, parents = {root}, {}
    for parent, child, starred in edges:
        parents.setdefault(child, set()).add(parent)
        if starred:
            own.add(child)
    return own | {child for child, above in parents.items() if len(above) > 1 or child in above}


@lru_cache(maxsize=65_536)
def step_name(name: str) -> str:
    """A name as a step of a path or column; a closing bracket in it is spelled \\u005d, so that one in a path ends an index."""
    return name if name and not _SIGNS.search(name) else json.dumps(name, ensure_ascii=False).replace("]", "\\u005d")


def shred_document(doc: dict, root: str, own: Container[str], with_fields: bool = True) -> Iterator[tuple]:
    """Rows of one document as in NODE_SCHEMA without doc_id: one for every object whose element is in own.

    kind is ``object`` or, for what isn't an object in a list, ``value`` (its text is the field ``value``).
    Objects in lists of an element that isn't in own are inlined under their index, like any other.
    """
    root_fields: dict[str, str] = {}
    rows: list[tuple] = [(root, "$", None, False, "object", root_fields)]
    looked_at = lambda v: with_fields or isinstance(v, (dict, list))
    # todo: value, label, path, path of the row that it belongs to, in a list, fields to fill, column
    todo: list[tuple] = [(v, k, f"$.{step_name(k)}", "$", False, root_fields, step_name(k)) for k, v in doc.items() if looked_at(v)]
    while todo:
        value, label, path, row, in_list, fields, column = todo.pop()
        table = label in own
        if isinstance(value, dict):
            if with_fields and not (in_list and table):
                fields[column] = "{}"
            if table:
                fields, column = {}, ""
                rows.append((step_name(label), path, row, in_list, "object", fields))
                row = path
            todo.extend((v, k, f"{path}.{step_name(k)}", row, False, fields, f"{column}.{step_name(k)}" if column else step_name(k)) for k, v in value.items() if looked_at(v))
        elif isinstance(value, list):
            if with_fields and not (in_list and table):
                fields[column] = "[]"
            elif with_fields:
                rows.append((step_name(label), path, row, True, "value", {"value": "[]"}))
            todo.extend((v, label, f"{path}[{i}]", row, True, fields, f"{column}[{i}]") for i, v in enumerate(value) if looked_at(v))
        elif with_fields:
            if in_list and table:
                rows.append((step_name(label), path, row, True, "value", {"value": _scalar(value)}))
            else:
                fields[column] = _scalar(value)
    yield from rows


def _clean(text: str | None) -> str | None:
    """Text that Arrow takes: lone surrogates become the replacement character."""
    if text is None or text.isascii():
        return text
    return text.encode("utf-8", "surrogatepass").decode("utf-8", "replace")


@dataclass(frozen=True)
class Shredded:
    """nodes: a row per table row of any element (NODE_SCHEMA). own: elements with a table, None if they are too many to list."""

    nodes: DataFrame
    own: frozenset[str] | None
    root: str

    def table(self, name: str, columns: Iterable[str]) -> DataFrame:
        """The flat table of one element with the given columns (dotted names of inlined fields) and its links."""
        return self.nodes.filter(F.col("table_name") == name).select(
            "doc_id", "node_path", "parent_path", *[F.col("fields").getItem(c).alias(c) for c in columns]
        )

    def write(self, path: str) -> DataFrame:
        """nodes written once, a folder for each table, and read back; a table is then a read of its own folder."""
        self.nodes.write.mode("overwrite").partitionBy("table_name").parquet(path)
        return self.nodes.sparkSession.read.schema(NODE_SCHEMA).parquet(path)

    def links(self) -> DataFrame:
        """doc_id, parent_path, node_path of every row that is an item of a list; the parent is the nearest enclosing item, else ``$``.

        The foreign key leads to the row above; where that is no item itself, its path down to its last index names the item.
        """
        items = self.nodes.filter("in_list and kind = 'object'")
        below = F.length(F.substring_index("parent_path", "]", -1))
        above = F.when(F.contains("parent_path", F.lit("]")), F.left("parent_path", F.length("parent_path") - below)).otherwise("$")
        return items.select("doc_id", above.alias("parent_path"), "node_path")

    def columns_of(self) -> DataFrame:
        """table_name, column_name of every flat column seen."""
        return self.nodes.select("table_name", F.explode(F.map_keys("fields")).alias("column_name")).distinct()


def shred(
    df: DataFrame,
    doc_id: Column | str,
    document: Column | str,
    root: str = "document",
    single_as_list: tuple[str, ...] = (),
    with_fields: bool = True,
    max_edges: int = MAX_EDGES,
) -> Shredded:
    """Shared inlining of the documents of df, in two passes: the schema graph, then the rows.

    single_as_list: keys of the document under which a single object stands for a list of one.
    with_fields False gives the links alone (fields stay empty, values in lists have no row).
    The edges of the schema graph are counted before they are sent to the tasks; beyond max_edges the elements with
    a table are found by an aggregation, and each document is joined with the ones among its own elements.
    """
    source = df.select(
        (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").alias("doc_id"),
        (F.col(document) if isinstance(document, str) else document).cast("string").alias("document"),
    ).filter(F.col("doc_id").isNotNull() & F.col("document").isNotNull())

    def edges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[str, str, bool]] = set()
            for text in batch.column("document").to_pylist():
                if (doc := parse_document(text)) is not None:
                    seen |= schema_edges(_top(doc, single_as_list), root)
            ordered = sorted(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_clean(e[0]) for e in ordered], pa.string()), pa.array([_clean(e[1]) for e in ordered], pa.string()), pa.array([e[2] for e in ordered], pa.bool_())],
                names=["parent", "child", "starred"],
            )

    edges = source.select("document").mapInArrow(edges_of, "parent string, child string, starred boolean").distinct()
    kept = edges.limit(max_edges + 1).collect()
    own = frozenset(relations([(e.parent, e.child, e.starred) for e in kept], root)) if len(kept) <= max_edges else None
    if own is None:
        source = _with_own_elements(source, cut(edges), root, single_as_list)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "table_name", "node_path", "parent_path", "in_list", "kind", "fields"]
        types = [*[pa.string()] * 4, pa.bool_(), pa.string(), pa.map_(pa.string(), pa.string())]
        for batch in batches:
            columns: list[list] = [[] for _ in names]

            def flush() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
                for c in columns:
                    c.clear()
                return out

            listed = batch.column("own").to_pylist() if own is None else None
            for i, (key, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("document").to_pylist())):
                if (doc := parse_document(text)) is None:
                    continue
                tables = own if listed is None else frozenset(listed[i] or ())
                for label, path, parent, in_list, kind, fields in shred_document(_top(doc, single_as_list), root, tables, with_fields):
                    for c, v in zip(columns, (key, _clean(label), _clean(path), _clean(parent), in_list, kind, [(_clean(k), _clean(v)) for k, v in fields.items()])):
                        c.append(v)
                if len(columns[0]) >= 20_000:
                    yield flush()
            if columns[0]:
                yield flush()

    return Shredded(source.mapInArrow(rows_of, NODE_SCHEMA), own, root)


def _with_own_elements(source: DataFrame, edges: DataFrame, root: str, single_as_list: tuple[str, ...]) -> DataFrame:
    """source with own: the elements of each document that have a table, for schema graphs of any size."""
    several = F.bool_or("starred") | (F.min("parent") != F.max("parent")) | F.bool_or(F.col("parent") == F.col("child"))
    tables = edges.groupBy("child").agg(several.alias("own")).filter("own").select("child")

    def names_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names = [], []
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("document").to_pylist()):
                if (doc := parse_document(text)) is not None:
                    mine = {_clean(child) for _, child, _ in schema_edges(_top(doc, single_as_list), root)}
                    ids += [key] * len(mine)
                    names += sorted(mine)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(names, pa.string())], names=["doc_id", "child"])

    # a hot element is in many documents: salted by the document
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))
    held = source.mapInArrow(names_of, "doc_id string, child string").withColumn("salt", salt)
    spread = tables.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))))
    mine = held.join(spread, ["child", "salt"], "left_semi").groupBy("doc_id").agg(F.collect_set("child").alias("own"))
    return source.join(mine, "doc_id", "left")


__all__ = ["Shredded", "parse_document", "relations", "schema_edges", "shred", "shred_document"]
