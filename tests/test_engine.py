import pytest
from pyspark.sql import functions as F

from veinstone.engine import Engine, InvalidContract

DOC = '{"function_signature": "f(x)", "intent_summary": "Doubles what it is given.", "invariants": [{"name": "pos", "logic": "output is positive", "criticality": "HIGH", "on_fail": "warn"}]}'


def test_life_of_a_catalogue(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("def f(x):\n    return g(x) * 2\n\ndef g(x):\n    return x\n")
    engine = Engine(spark, str(tmp_path / "store"), F.lit("2024-06-01 00:00:00"))
    engine.store.init()
    assert engine.scan(str(src), "PENDING", "STALE") == {"new": 2}
    assert engine.scan(str(src), "PENDING", "STALE") == {"unchanged": 2}
    (src / "a.py").write_text("def f(x):\n    return g(x) * 3\n\ndef g(x):\n    # same code\n    return x\n")
    assert engine.scan(str(src), "PENDING", "STALE") == {"changed": 1, "unchanged": 1}
    assert {r.status: r.n for r in engine.status().collect()} == {"STALE": 1, "PENDING": 1}
    assert engine.store.read("queue").count() == 2
    assert engine.save_contract("a.py::f", DOC, 0.8, "VERIFIED") > 0
    with pytest.raises(InvalidContract):
        engine.save_contract("a.py::f", "{", 0.8, "VERIFIED")
    with pytest.raises(KeyError):
        engine.save_contract("a.py::none", DOC, 0.8, "VERIFIED")
    assert [r.status for r in engine.contract("a.py::f").collect()] == ["VERIFIED"]
    page = engine.contract_page(0.5, "VERIFIED", "a").collect()
    assert [(r.function_id, r.total, r.has_more, r.n_invariants, r.summary) for r in page] == [("a.py::f", 1, False, 1, "Doubles what it is given.")]
    engine.add_edges(spark.createDataFrame([("a.py::f", "a.py::g"), ("a.py::f", "a.py::g"), ("a.py::g", "lib::h")], "caller string, callee string"))
    found = {r.function_id: (r.relationship, r.has_artifact, r.has_contract) for r in engine.dependencies("a.py::f").collect()}
    assert found == {"a.py::f": ("root", True, True), "a.py::g": ("callee", True, False), "lib::h": ("callee", False, False)}
    assert [r.node for r in engine.missing_contracts("a.py::f").collect()] == ["a.py::g"]
    pairs = spark.createDataFrame([(1, 2.0), (2, -1.0)], "x int, y double")
    assert [r.passed for r in engine.verify("a.py::f", pairs, "y", ["x"]).orderBy("x").collect()] == [True, False]
    assert engine.search("f").count() == 1 and engine.suggestions("a.py::F").head().function_id == "a.py::f" and engine.contracts(["a.py::f"]).count() == 1
    assert engine.confidence().head().good == 1 and engine.scan_errors(str(src)).count() == 0
    event = spark.createDataFrame([("sha", "m", "a.py::f", "null_check", None, False, 0.1, 0, 0)], "commit_sha string, commit_message string, function_id string, pattern_type string, pattern_description string, contract_modified boolean, confidence_boost float, new_invariants_added int, invariants_validated int").withColumn("created_at", engine.now)
    engine.append("learning_history", event)
    engine.append("learning_history", event)
    assert sorted(r.id for r in engine.history("a.py::f", "s", "null_check").collect()) == [1, 2]
