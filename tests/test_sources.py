import json
import subprocess

import pytest
from pyspark.sql import functions as F

from veinstone.operators import orphans
from veinstone.sources import code_tree, sinks
from veinstone.sources.commits import commits
from veinstone.sources.store import StaleVersion, Store, config_value, opened
from veinstone.sources.tables import current_rows
from veinstone.streaming.orphans import EVENTS, StreamState, activity, track


def test_store_versions_and_conflicts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert not store.initialised() and store.tables() == []
    assert store.init() == 1 and store.init() == 1 and store.read("queue").count() == 0
    rows = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string").withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    assert store.commit({"config": rows}) == 2
    assert config_value(store, "b") == "2" and config_value(store, "x", "d") == "d"
    with pytest.raises(StaleVersion):
        store.commit({"config": rows.limit(1)}, base=1)
    changed = store.read("config").filter("key = 'a'")
    assert store.commit({"config": changed}) == 3
    assert store.read("config").count() == 1 and store.read("config", 2).count() == 2
    assert store.vacuum() > 0 and store.read("config").count() == 1
    assert store.init(rebuild=True) == 4 and store.read("config").count() == 0
    with opened(spark, str(tmp_path / "s")) as same:
        assert same.version() == 4
    with pytest.raises(FileNotFoundError), opened(spark, str(tmp_path / "none")):
        pass
    with pytest.raises(FileNotFoundError):
        store.read("nothing")


def test_code_tree(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "main.py").write_text("class A:\n    @staticmethod\n    def f(x):\n        def g():\n            pass\n        return 'é'\n    def f(x):\n        return 2\nasync def h(): pass\n", encoding="utf-8")
    (tmp_path / "lib" / "app.js").write_text("export function go(a) {\n  return a;\n}\nclass B {\n  get x() { return 1; }\n}\n")
    (tmp_path / "lib" / "u v.cpp").write_text("namespace n {\nint A::m(int x) {\n  return x;\n}\n}\n")
    (tmp_path / "bad.py").write_text("def ok():\n    return 1\n\ndef broken(:\n    pass\n")
    (tmp_path / "node_modules" / "x.js").write_text("function no() {}\n")
    (tmp_path / "notes.txt").write_text("def no(): pass\n")
    got = {r.function_id: r for r in code_tree.scan_directory(spark, str(tmp_path)).collect()}
    assert set(got) == {"main.py::A.f", "main.py::A.f.g", "main.py::h", "lib/app.js::go", "lib/app.js::B.x", "lib/u v.cpp::n.A.m", "bad.py::ok"}
    assert got["main.py::A.f"].start_line == 7 and got["main.py::A.f"].is_method and got["main.py::h"].is_async
    assert got["lib/app.js::go"].decorators == ["export"] and got["lib/app.js::go"].end_line == 3
    assert [(r.file_path, r.line) for r in code_tree.syntax_errors(spark, str(tmp_path)).collect()] == [("bad.py", 4)]
    one = code_tree.scan_directory(spark, str(tmp_path / "main.py")).collect()
    assert {r.file_path for r in one} == {"main.py"}


def test_commits(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    for i, message in enumerate(["first", "fix: bug in rows #12"]):
        (tmp_path / "a.py").write_text(f"x = {i}\n")
        run("add", "-A")
        run("commit", "-qm", message)
    rows = commits(spark, str(tmp_path)).orderBy("message").collect()
    assert [r.message for r in rows] == ["first", "fix: bug in rows #12"] and "+x = 1" in rows[1].diff
    assert commits(spark, str(tmp_path), bug_fixes_only=True).count() == 1


def test_current_rows(spark):
    df = spark.createDataFrame([("a", 1, "2024-01-01"), ("a", 2, "2024-02-01"), ("a", 2, "2024-02-01"), ("b", 3, None), (None, 4, "2024-01-01")], "k string, v int, updated_at string")
    assert sorted((r.k, r.v) for r in current_rows(df, "k").collect()) == [("a", 2), ("b", 3)]
    assert current_rows(df.limit(0), "k").count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "a|b"), (1, None)], "x int, y string")
    assert json.loads(sinks.envelope(df.orderBy("x").collect())) == {"success": True, "data": [{"x": 1, "y": None}, {"x": 2, "y": "a|b"}], "error": None}
    assert json.loads(sinks.envelope(error=("NOT_FOUND", "no")))["error"]["code"] == "NOT_FOUND"
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert "a\\|b" in sinks.markdown(df, "T") and sinks.series(df, "x", "y") == {"x": [1, 2], "y": [None, "a|b"]}
    assert [sinks.plot_kind(d) for d in ({"categories": [1]}, {"x": [1, 2], "y": [3, 4]}, {"x": [1, 5] * 15, "y": [0] * 30}, {})] == ["bar", "line", "scatter", "bar"]


def test_stream_equals_batch(spark, tmp_path):
    events = [("reference", "calls", "callee", "a", "2024-01-05"), ("reference", "calls", "callee", "b", "2024-01-05"), ("parent", None, None, "a", "2024-01-20"), ("deletion", None, None, "a", "2024-02-01")]
    source = tmp_path / "in"
    for i, e in enumerate(events):
        spark.createDataFrame([e], "kind string, src_table string, src_field string, key string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(source / f"d={i}"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(source) + "/*")
    seen = []
    track(spark, stream, str(tmp_path / "state"), str(tmp_path / "cp"), lambda df, n: seen.append((n, {(r.orphan_kind, r.n_keys) for r in df.collect()}))).awaitTermination(120)
    state = StreamState(spark, str(tmp_path / "state"))
    assert {(r.key, r.orphan_kind) for r in orphans.report(state.read()).collect()} == {("a", "deleted"), ("b", "missing")}
    assert len(seen) == 4
    before = state.last()
    state.advance(spark.createDataFrame([], EVENTS), before)
    assert state.last() == before
    assert activity(stream, "at").isStreaming
