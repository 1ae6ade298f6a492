import random

import pytest
from pyspark.sql import functions as F

from veinstone.functions.code_text import code_hash, normalised, without_comments
from veinstone.functions.ids import canonical_id, id_name, id_path, valid_id
from veinstone.operators import catalog, contracts, graph, intervals, merge, mining, stats, verify


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_ids(spark):
    df = spark.createDataFrame([(" ./a\\b.py::F.g\t",), ("././x::y",), ("::y",), ("x::",), ("plain",), (None,), ("a::b::c",)], "k string")
    got = df.select(canonical_id("k").alias("k")).select("k", id_path("k").alias("p"), id_name("k").alias("n"), valid_id("k").alias("v")).collect()
    assert [(r.k, r.p, r.n, r.v) for r in got] == [
        ("a/b.py::F.g", "a/b.py", "F.g", True), ("x::y", "x", "y", True), ("::y", "", "y", False), ("x::", "x", "", False), ("plain", "plain", None, False), (None, None, None, None), ("a::b::c", "a", "b::c", True),
    ]


@pytest.fixture(scope="module")
def table(spark):
    rows = [("a_x", "a/x.py", 0.7, 1), ("aXx", "a/x.py", 0.95, 2), ("b", "b/y.py", None, 3), ("merge", "c/z.py", 0.5, 4), ("merge_all", None, 0.2, 5), (None, "a", 0.9, 6)]
    return spark.createDataFrame(rows, "k string, path string, score float, n int")


def test_lookups_and_pages(spark, table):
    assert catalog.lookup(table, "k", "b").count() == 1 and catalog.lookup(table, "k", None).count() == 0
    assert values(catalog.lookup_many(table, "k", ["b", "none"]), "k") == [("b",)] and catalog.lookup_many(table, "k", []).count() == 0
    assert values(catalog.lookup_many(table, "k", spark.createDataFrame([("b",), (None,)], "k string")), "k") == [("b",)]
    assert values(catalog.where_all(table, {"path": "a/x.py", "n": None}, {"k": "a_x"}), "k") == [("aXx",), ("a_x",)]  # _ stands for any character
    assert [r.n for r in catalog.page(table, [("score", "desc"), ("n", "asc")], 2, 1).collect()] == [6, 1]
    assert [r.n for r in catalog.page(table, [("score", "asc"), ("n", "asc")], 10).collect()][-1] == 3
    paged = catalog.page_with_total(table, [("n", "asc")], 4, 4).collect()
    assert [(r.n, r.total, r.has_more) for r in paged] == [(5, 6, False), (6, 6, False)]
    assert [r.k for r in catalog.search(table, "merge", "k", "path", 5).collect()] == ["merge", "merge_all"] and catalog.search(table, "", "k", "path", 5).count() == 0
    assert [r.tier for r in catalog.similar(table, "MERGE", "b/", "k", "path", "k", 5).collect()] == [0, 0, 1]
    assert catalog.similar(table, "xx_merge_all_xx", "zz", "k", "path", "k", 5, either_way=True).count() == 2
    assert values(catalog.with_existence(table, table.filter("n < 3"), "k", "has").filter("has"), "k") == [("aXx",), ("a_x",)]
    assert catalog.limit_then_filter(table, [("n", "asc")], 2, F.col("n") > 1).count() == 1


def test_float_thresholds(spark, table):
    assert values(stats.buckets(table, "score", [0.5, 0.7, 0.9], list("abcd")), *"abcd") == [(1, 1, 1, 2)]
    assert dict(values(stats.levels(table, "score", [("high", 0.9), ("good", 0.7), ("moderate", 0.5)], "low"), "level", "n")) == {"high": 2, "good": 1, "moderate": 1, "low": 1}
    assert catalog.where_all(table, at_least={"score": F.lit(0.7)}).count() == 2  # 0.7 as float lies below 0.7 as double
    empty = table.limit(0)
    assert stats.buckets(empty, "score", [0.5], ["a", "b"]).head().asDict() == {"total": 0, "average": None, "a": 0, "b": 0}


@pytest.mark.parametrize("scores,expected", [([], 70), ([40], 41), ([100], 100), ([90, 80, 70, 60, 50, 40, 30, 20, 10, 0], 30), ([50, 50, 50, 10], 50)])
def test_kth_largest(spark, scores, expected):
    df = spark.createDataFrame([(s,) for s in scores], "s int")
    assert stats.kth_largest(df, F.col("s"), 0.7, 70).head().threshold == expected


def test_rollups(spark, table):
    assert [tuple(r) for r in stats.top_k(table, ["path"], 2).collect()] == [("a/x.py", 2), ("a", 1)]
    assert stats.pivot_counts(table, "k", ["b"]).head().asDict() == {"total": 6, "n_b": 1}
    assert values(stats.newest_per_key(table, "path", "n", "k", 1), "n") == [(2,), (3,), (4,), (6,)]
    assert stats.penalised(table.filter("n < 3"), "path", F.lit(60), 100).head().remaining == 0


def test_merges(spark):
    old = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", None, 1)], "k string, h string, born int")
    new = spark.createDataFrame([("a", "9", 2), ("a", "9", 2), ("b", "2", 2), ("c", None, 2), ("d", "4", 2), (None, "5", 2)], "k string, h string, born int")
    assert values(merge.upsert(old, new, ["k"], ["born"], "born"), "k", "born") == [("a", 1), ("b", 1), ("c", 1), ("d", 2)]
    assert values(merge.classify(old, new, ["k"], "h"), "k", "outcome") == [("a", "changed"), ("b", "unchanged"), ("c", "unchanged"), ("d", "new")]
    assert values(merge.classify(old, new.limit(0), ["k"], "h"), "outcome") == [("absent",)] * 3
    assert {(r.k, r.h, r.born) for r in merge.merge_changed(old, new, ["k"], "h", ["born"]).collect()} == {("a", "9", 1), ("b", "2", 1), ("c", None, 1), ("d", "4", 2)}
    assert merge.insert_ignore(old, new, ["k"]).count() == 4
    assert values(merge.update_where(old, F.col("h") == "1", {"born": F.lit(7)}), "k", "born") == [("a", 7), ("b", 1), ("c", 1)]
    assert values(merge.delete_where(old, F.col("h") == "1"), "k") == [("b",), ("c",)]
    done = merge.claim_first(old, F.col("born") == 1, [F.col("k").desc()], "k", {"born": F.col("born") + 1})
    assert values(done.filter("claimed"), "k", "born") == [("c", 2)] and done.count() == 3
    ids = [r.born for r in merge.with_ids(old.withColumn("born", F.lit(41)), new.filter("k is not null").repartition(3), "born").collect()]
    assert sorted(ids) == [42, 43, 44, 45, 46]
    assert merge.with_ids(old, new.limit(0), "born").count() == 0


def test_overlaps_against_brute_force(spark):
    rng = random.Random(8)
    left = [(rng.choice("ab"), i, a := rng.randrange(500), a + rng.randrange(-3, 200)) for i in range(80)] + [(None, 99, 1, 2), ("a", 98, None, 5)]
    right = [(rng.choice("ab"), i, a := rng.randrange(500), a + rng.randrange(0, 90)) for i in range(80)]
    expected = sorted((l[1], r[1]) for l in left for r in right if l[0] == r[0] and None not in l and l[2] <= l[3] and l[2] <= r[3] and l[3] >= r[2])
    got = intervals.overlap_join(spark.createDataFrame(left, "k string, i int, s int, e int"), spark.createDataFrame(right, "k string, j int, s2 int, e2 int"), "k", ("s", "e"), ("s2", "e2"))
    assert values(got, "i", "j") == expected


def test_graph(spark):
    edges = spark.createDataFrame([("main", "helper"), ("main", "logger"), ("helper", "utils"), ("helper", "formatter"), ("formatter", "logger"), ("main", "helper"), (None, "x")], "caller string, callee string")
    plain = graph.distinct_edges(edges)
    start = spark.createDataFrame([("helper",), (None,)], "node string")
    assert plain.count() == 5
    assert values(graph.neighbours(plain, "logger", "in"), "node") == [("formatter",), ("main",)]
    assert values(graph.walk(plain, start, 1), "node", "depth") == [("formatter", 1), ("helper", 0), ("utils", 1)]
    assert values(graph.walk(plain, start, 9), "node")[-1] == ("utils",) and graph.walk(plain, start, 9).count() == 4
    assert dict(values(graph.dependency_graph(plain, start, 2), "node", "relationship")) == {"helper": "root", "utils": "callee", "formatter": "callee", "logger": "callee", "main": "caller"}
    assert graph.cyclic_core(plain).count() == 0
    ring = plain.unionByName(spark.createDataFrame([("logger", "main"), ("self", "self")], "caller string, callee string"))
    assert {(r.caller, r.callee) for r in graph.cyclic_core(ring).collect()} == {("main", "helper"), ("main", "logger"), ("helper", "formatter"), ("formatter", "logger"), ("logger", "main"), ("self", "self")}
    have = spark.createDataFrame([("helper",), ("utils",), ("formatter",)], "node string")
    got = graph.missing_records(plain, start, have, spark.createDataFrame([("utils",)], "node string"), 2)
    assert values(got, "node", "relationship") == [("formatter", "callee"), ("helper", "direct")]
    assert values(graph.degrees(plain).filter("node = 'main'"), "n_out", "n_in") == [(2, 0)]
    assert graph.walk(plain.limit(0), start, 3).count() == 1


def test_code_text(spark):
    assert without_comments("a = '# no' # yes\n\"\"\"doc\nstring\"\"\"\nb = \"\"\"x\"\"\"\n", "python") == "a = '# no' \n\nb = \n"
    assert without_comments("a('//x'); // y\n/* z\n*/ b(`/* ${c} */`);/* open", "cpp") == "a('//x'); \n b(`/* ${c} */`);"
    assert without_comments("a # b // c", "cobol") == "a # b // c"
    df = spark.createDataFrame([("x  =  1 # c\r\n\r\n  y\n", "Python"), ("x = 1\ny", "py"), (None, "py"), ("", None)], "body string, lang string")
    got = df.select(normalised(F.col("body"), F.col("lang")).alias("n"), code_hash(F.col("body"), F.col("lang")).alias("h")).collect()
    assert [r.n for r in got] == ["x = 1\ny", "x = 1\ny", None, ""] and got[0].h == got[1].h and got[2].h is None


DIFF = """diff --git a/old.py b/new.py
--- a/old.py
+++ b/new.py
@@ -1,3 +1,3 @@ def f(x):
 a
--- removed
+if x is None:
 b
@@ -9 +9 @@
-c
+d
diff --git a/n.py b/n.py
--- /dev/null
+++ b/n.py
@@ -0,0 +1 @@
+new
diff --git a/g.py b/g.py
--- a/g.py
+++ /dev/null
@@ -1 +0,0 @@
-gone
"""


def test_diffs_and_patterns(spark):
    df = spark.createDataFrame([(1, DIFF), (2, None), (3, ""), (4, "no diff\n@@ nonsense")], "id long, diff string")
    hunks = mining.hunk_sides(mining.diff_hunks(df, "id", "diff")).orderBy("hunk").collect()
    assert [(h.new_path, h.is_new, h.is_deleted, h.is_renamed, h.new_start, h.new_count) for h in hunks] == [
        ("new.py", False, False, True, 1, 3), ("new.py", False, False, True, 9, 1), ("n.py", True, False, False, 1, 1), ("g.py", False, True, False, 0, 0),
    ]
    assert hunks[0].removed == "-- removed" and hunks[0].added == "if x is None:" and hunks[0].header == "def f(x):"
    texts = spark.createDataFrame([("if x is None:", ""), ("if x is None:", "if y is None:"), ("nothing", ""), (None, None)], "a string, r string")
    best = texts.select(mining.best_pattern(mining.pattern_scores(F.col("a"), F.col("r"))).alias("b")).collect()
    assert [(r.b.pattern, round(r.b.confidence, 3)) for r in best] == [("null_check", 0.5), ("null_check", 0.333), ("unknown", 0.0), ("unknown", 0.0)]
    scored = spark.createDataFrame([("fix: bug in rows #12",), ("neutral words",), ("PROJ-1 closes it",)], "m string").select(mining.bug_fix_score(F.col("m")).alias("s"))
    assert [r.s for r in scored.collect()] == [1.0, 0.0, 0.5]
    found = spark.createDataFrame([("null_check", "Output is not None", "n"), ("null_check", "sorted", "order"), (None, "none", "x")], "p string, logic string, name string")
    assert mining.invariants_about(found, "p", "logic", "name").count() == 1
    boosts = mining.strengthening(spark.createDataFrame([("f", f"i{i % 6}") for i in range(20)], "f string, i string"), "f", "i")
    assert values(boosts, "n_validated", "boost") == [(6, 0.25)]


def test_hints_and_lines(spark):
    body = "# @invariant: x > 0\n/* @pre y */ code\n * @post: z\n# @invariant: x > 0\nmail@post.org"
    df = spark.createDataFrame([("f", body, 10), ("g", None, 1), ("h", "", None)], "k string, body string, start int")
    found = {(r.line, r.hint_type) for r in mining.hints(df, "k", "body", "start").collect()}
    assert {(10, "invariant"), (12, "post"), (13, "invariant")} <= found and not any(line == 14 for line, _ in found)
    code = "def f(rows):\n    out = []\n    out.append(1)\n    result = 2\n    if rows:\n        x = 1\n    else:\n        y = 2\n    return out"
    lines = mining.suspicious_lines(spark.createDataFrame([("f", code), ("g", None)], "k string, body string"), "k", "body", ["duplicate", "append"])
    assert values(lines, "line", "score") == [(3, 0.7)]


def test_verification(spark):
    df = spark.createDataFrame([(1, 5.0, 2.0), (2, -1.0, 3.0), (3, None, 1.0)], "id int, out double, x double")
    rules = [verify.Invariant("pos", "Output is positive", "LOW"), verify.Invariant("le", "output is less than or equal to the input sum", "HIGH"), verify.Invariant("odd", "the moon is blue"), verify.Invariant("set", "output is not None", "MEDIUM")]
    checked = verify.check_rows(df, "out", ["x"], rules)
    assert [(r.passed, r.failed) for r in checked.orderBy("id").collect()] == [(False, ["le"]), (False, ["pos"]), (False, ["pos", "le", "set"])]
    assert values(verify.summary(checked), "name", "n_failed") == [("le", 2), ("odd", 0), ("pos", 2), ("set", 1)]
    ranked = [r.name for r in verify.violations(checked, ["id"]).filter("id = 3").orderBy("rank").collect()]
    assert ranked == ["le", "set", "pos"]
    assert verify.check_rows(df, "out", [], []).filter("passed").count() == 3
    typed = lambda kind: verify.Typed(F.col("o"), kind, {"values": F.col("v"), "n": F.col("n")})
    lists = spark.createDataFrame([([1, 2, 2], [1.0, 2.0, 2.0], 4)], "o array<int>, v array<double>, n int")
    test = lambda words, t: lists.select(verify.compile_logic(words, t).alias("x")).head().x
    assert test("no duplicates in output", typed("array<int>")) is False and test("same length", typed("array<int>")) is True
    assert test("all of output are positive", typed("array<int>")) is True and test("returns a list", typed("array<int>")) is True and test("is a string", typed("array<int>")) is False
    words = spark.createDataFrame([("ab@c",)], "o string")
    for logic, expected in (("output contains @ for an email", True), ("starts with 'ab'", True), ("ends with 'x'", False), ("output is not empty", True)):
        assert words.select(verify.compile_logic(logic, verify.Typed(F.col("o"), "string", {})).alias("x")).head().x is expected
    number = spark.createDataFrame([(8, 4)], "o int, n int")
    t = verify.Typed(F.col("o"), "int", {"n": F.col("n")})
    assert [number.select(verify.compile_logic(w, t).alias("x")).head().x for w in ("output is twice n", "output lies between 1 and 7", "output is not negative")] == [True, False, True]
    assert verify.compile_logic("unique output", t) is None


def test_contract_problems(spark):
    good = '{"function_signature": "f()", "intent_summary": "long enough text", "invariants": [{"name": "n", "logic": "x > 0 always", "criticality": "HIGH", "on_fail": "warn"}]}'
    assert contracts.problems(good) == []
    assert contracts.problems("{")[0][0] == "INVALID_JSON" and contracts.problems(None)[0][0] == "INVALID_JSON" and contracts.problems("[]")[0][2] == "not an object"
    places = {p for _, p, _ in contracts.problems('{"intent_summary": " short ", "invariants": [{"name": " ", "logic": "abc", "criticality": "X"}, 7], "io_examples": [{"input": 1}, 2]}')}
    assert places == {"function_signature", "intent_summary", "invariants.0.name", "invariants.0.logic", "invariants.0.criticality", "invariants.0.on_fail", "invariants.1", "io_examples.0.input", "io_examples.0.output", "io_examples.1"}
    df = spark.createDataFrame([("a", good), ("b", "{"), (None, None)], "k string, j string")
    assert values(contracts.validate(df, F.col("k"), F.col("j")).filter("key = 'b'"), "code") == [("INVALID_JSON",)]


def test_ranges_of_any_length_cost_a_few_rows(spark):
    left = spark.createDataFrame([("k", 1, 0, 2_000_000_000), ("k", 2, 70, 80), ("k", 3, 5, 4), (None, 4, 1, 9), ("k", 5, None, 9)], "k string, i int, s int, e int")
    right = spark.createDataFrame([("k", 1, 80, 900), ("k", 2, 1_999_999_999, 2_000_000_000), ("k", 3, 81, 82)], "k string, j int, s2 int, e2 int")
    got = sorted((r.i, r.j) for r in intervals.overlap_join(left, right, "k", ("s", "e"), ("s2", "e2")).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert intervals.overlap_join(left.limit(0), right, "k", ("s", "e"), ("s2", "e2")).count() == 0


def test_adjusted_scores_and_rates(spark):
    scores = spark.createDataFrame([("a", 90), ("b", 10), ("c", 50)], "k string, base int")
    findings = spark.createDataFrame([("a", 15, True), ("a", 8, True), ("a", 3, False), ("b", 15, True), (None, 3, True)], "k string, w int, o boolean")
    got = {r.k: (r.penalty, r.adjusted, r.n_open) for r in stats.adjusted(scores, findings, "k", "base", F.col("w"), F.col("o")).collect()}
    assert got == {"a": (23, 67, 2), "b": (10, 0, 1), "c": (0, 50, 0)}
    none = spark.createDataFrame([(0, 0, 0, 0, 0, 0)], "total long, n_verified long, n_needs_review long, n_pending long, n_stale long, n_broken long")
    row = stats.rates(none).first()
    assert (row.completion_rate, row.success_rate, row.actionable) == (0.0, 0.0, 0)
    assert [round(r.s, 2) for r in spark.createDataFrame([(0.5,), (85.0,), (None,)], "v float").select(stats.unit_score("v").alias("s")).collect() if r.s is not None] == [0.5, 0.85]
