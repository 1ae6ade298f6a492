import json
import re

from hypothesis import given, settings, strategies as st

from veinstone.operators.nested import parse_document, relations, schema_edges, shred, shred_document
from veinstone.operators import nested


def test_strict_documents():
    assert parse_document('{"a": 1}') == {"a": "1"}
    assert parse_document(json.dumps('{"a": []}')) == {"a": []}
    for bad in (None, "", " ", "[1]", "1", '"x"', '{"a": NaN}', '{"a": 1} x', '{"a": 1,}', "{'a': 1}", "﻿{}", '{"a": "\t"}'):
        assert parse_document(bad) is None, bad
    assert parse_document('{"a": 1, "a": {"b": 2}}') == {"a": {"b": "2"}}
    assert parse_document('{"n": ' + "9" * 6000 + "}")["n"] == "9" * 6000


def test_very_deep_documents():
    deep = '{"a":' * 30_000 + "[1, -2.5e3, true, null, \"x\\u0041\"]" + "}" * 30_000
    value = parse_document(deep)
    for _ in range(30_000):
        value = value["a"]
    assert value == ["1", "-2.5e3", True, None, "xA"]
    for text in ('{"a": [1, 2], "b": {"c": []}, "d": ""}', "[]", '[{"x": 1}, {}]', '{"a": 1,}', '{"a" 1}', "[1 2]", "[1,]", "{", '{"a":1}}'):
        try:
            expected = nested._parse(text)
        except ValueError:
            expected = "bad"
        try:
            got = nested._parse_deep(text)
        except ValueError:
            got = "bad"
        assert got == expected, text


def test_relations_share_repeat_recur():
    doc = {"one": {"x": 1, "shared": {"k": 1}}, "two": {"shared": {"k": 2}}, "many": [{"one": {"x": 2}}], "node": {"node": {"v": 1}}}
    own = relations(schema_edges(doc, "root"), "root")
    assert own == {"root", "shared", "many", "one", "node"}
    assert "only" not in relations(schema_edges({"only": {"x": {"y": 1}}}, "root"), "root")


def brute(doc, single=()):
    out = []

    def walk(value, path, item):
        if isinstance(value, dict):
            for k, v in value.items():
                walk(v, f"{path}.{k}", item)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                there = f"{path}[{i}]"
                if isinstance(v, dict):
                    out.append((item, there))
                    walk(v, there, there)
                else:
                    walk(v, there, item)

    walk({k: [v] if k in single and isinstance(v, dict) else v for k, v in doc.items()}, "$", "$")
    return sorted(out)


def rebuild(rows):
    """The document from its rows, fields and links alone."""
    kids = {}
    for label, path, parent, in_list, kind, fields in rows:
        if parent is not None:
            kids.setdefault(parent, []).append((label, path, in_list, kind, fields))

    def fill(path, fields):
        out = {}
        for name, text in fields.items():
            at = out
            *outer, last = name.split(".")
            for o in outer:
                at = at[o]
            at[last] = {} if text == "{}" else [] if text == "[]" else json.loads(text)
        for label, child, in_list, kind, mine in kids.get(path, []):
            value = fill(child, mine) if kind == "object" else [] if mine["value"] == "[]" else json.loads(mine["value"])
            at = out
            steps = re.findall(r"\.([^.\[]+)|\[(\d+)\]", child[len(path) :])
            for (key, index), (_, after) in zip(steps, [*steps[1:], ("", None)]):
                if after is None:
                    if key:
                        at[key] = value
                    else:
                        at.extend([None] * (int(index) + 1 - len(at)))
                        at[int(index)] = value if at[int(index)] is None else at[int(index)]
                elif key:
                    at = at[key]
                else:
                    at.extend([None] * (int(index) + 1 - len(at)))
                    if at[int(index)] is None:
                        at[int(index)] = []
                    at = at[int(index)]
        return out

    return fill("$", next(f for *_, path, parent, _l, _k, f in rows if parent is None and path == "$"))


KEYS = st.sampled_from(["a", "b", "c", "lines", "é"])
VALUES = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("xyü", max_size=3), lambda v: st.lists(v, max_size=3) | st.dictionaries(KEYS, v, max_size=3), max_leaves=14)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(KEYS, VALUES, max_size=4))
def test_round_trip(doc):
    parsed = parse_document(json.dumps(doc))
    own = relations(schema_edges(parsed, "root"), "root")
    for tables in (own, own | {"a", "b", "c", "lines", "é"}):
        rows = list(shred_document(parsed, "root", tables))
        assert rebuild(rows) == doc
        assert sorted(r[1] for r in rows if r[3] and r[4] == "object") == sorted(path for _, path in brute(doc))
    assert nested._parse_deep(json.dumps(doc)) == nested._parse(json.dumps(doc))


def test_rows_links_and_fields(spark):
    doc = {
        "invariants": {"name": "n", "logic": "l"}, "io_examples": [{"input": {"rows": {"v": 1, "lines": [{"a": None}, 7, [{"b": [[{"c": "x"}]]}]]}}, "output": []}, "s"],
        "empty": {}, "word": "é",
    }
    df = spark.createDataFrame([("d", json.dumps(doc), 1), (None, "{}", 1), ("bad", "{", 1), ("e", None, 1)], "id string, body string, node_path int")
    made = shred(df, "id", "body", "docs", ("invariants",))
    rows = made.nodes.collect()
    assert {r.doc_id for r in rows} == {"d"}
    assert sorted((r.parent_path, r.node_path) for r in made.links().collect()) == brute(doc, ("invariants",))
    paths = {r.node_path for r in rows}
    assert all(r.parent_path in paths for r in rows if r.parent_path)
    top = next(r for r in rows if r.node_path == "$").fields
    assert top["word"] == '"é"' and top["empty"] == "{}" and top["io_examples"] == "[]"
    example = next(r for r in rows if r.node_path == "$.io_examples[0]").fields
    assert example["input.rows.v"] == "1" and example["output"] == "[]" and example["input.rows.lines"] == "[]"
    assert next(r for r in rows if r.node_path == "$.io_examples[1]").fields == {"value": '"s"'}
    flat = made.table("invariants", ["name", "logic"]).collect()
    assert [(r.parent_path, r.name) for r in flat] == [("$", '"n"')]


def test_beyond_the_bound_the_tables_are_the_same(spark):
    docs = [("d", '{"a": {"b": {"c": [{"x": 1}]}}, "t": [1, [2]]}'), ("e", '{"b": {"y": 2}, "one": {"z": {"k": "v"}}}'), ("f", '{"a": {"w": 3}}'), ("g", "{}"), ("h", "no")]
    df = spark.createDataFrame(docs, "id string, body string")
    plain = lambda made: sorted((r.doc_id, r.table_name, r.node_path, str(r.parent_path), r.kind, sorted(r.fields.items())) for r in made.nodes.collect())
    made, beyond = shred(df, "id", "body"), shred(df, "id", "body", max_edges=1)
    assert made.own == {"document", "b", "c", "t"} and beyond.own is None
    assert plain(made) == plain(beyond)


def test_rows_come_from_the_tables_and_their_foreign_keys():
    doc = parse_document('{"a": [{"b": {"c": [{"x": 1}]}}], "d": {"c": [2]}}')
    own = relations(schema_edges(doc, "root"), "root")
    assert own == {"root", "a", "c"}
    rows = {r[1]: r for r in shred_document(doc, "root", own)}
    assert rows["$.a[0].b.c[0]"][2] == "$.a[0]" and "$.a[0].b" not in rows
    shared = {r[1]: r for r in shred_document(doc, "root", own | {"b"})}
    assert shared["$.a[0].b.c[0]"][2] == "$.a[0].b" and shared["$.a[0].b"][2] == "$.a[0]"
    inlined = {r[1]: r for r in shred_document(doc, "root", own - {"c"})}
    assert set(inlined) == {"$", "$.a[0]"} and inlined["$.a[0]"][5]["b.c[0].x"] == "1"


def test_names_with_signs_of_the_notation(spark, tmp_path):
    doc = {"a.b": 1, "a": {"b": 2}, "x[0]": {"v": 1}, "x": [{"v": 2}], 'q"]': [{"w": {"": [{"u": 1}]}}], "": {"z": 3}}
    df = spark.createDataFrame([("d", json.dumps(doc))], "id string, body string")
    made = shred(df, "id", "body", "docs")
    rows = made.nodes.collect()
    top = next(r for r in rows if r.node_path == "$").fields
    assert top['"a.b"'] == "1" and top["a.b"] == "2" and top['"x[0\\u005d".v'] == "1"
    assert next(r for r in rows if r.node_path == '$.""').table_name == '""'
    assert len({r.node_path for r in rows}) == len(rows)
    links = {r.node_path: r.parent_path for r in made.links().collect()}
    item = '$."q\\"\\u005d"[0]'
    assert links == {"$.x[0]": "$", item: "$", f'{item}.w.""[0]': item}
    again = made.write(str(tmp_path / "tables"))
    assert {(r.table_name, r.node_path) for r in again.collect()} == {(r.table_name, r.node_path) for r in rows}


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, body string")
    assert shred(df, "id", "body").nodes.count() == 0
