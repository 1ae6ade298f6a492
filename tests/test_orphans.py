from pyspark.sql import functions as F

from veinstone.operators import orphans


def ref(spark, rows):
    df = spark.createDataFrame(rows, "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    return [orphans.Reference(df, "calls", "callee", F.col("k"), F.col("t"))]


def times(spark, rows):
    df = spark.createDataFrame(rows, "k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    return df, F.col("k"), F.col("t")


def kinds(state):
    return {(r.ref_month, r.key): r.orphan_kind for r in orphans.report(state).collect()}


REFS = [("a", "2024-01-05"), ("a", "2024-02-05"), ("b", "2024-01-01"), ("c", None), (None, "2024-01-01"), ("d", "2024-03-01")]


def test_one_step(spark):
    listed = spark.createDataFrame([("b",), (None,)], "k string")
    state = orphans.step(None, ref(spark, REFS), times(spark, [("a", "2024-01-20"), ("d", "2024-02-01"), (None, "2024-01-01")]), (listed, F.col("k")))
    assert kinds(state) == {("2024-01", "a"): "late", ("2024-01", "b"): "deleted", ("unknown", "c"): "missing"}


def test_steps_equal_the_whole(spark):
    whole = orphans.step(None, ref(spark, REFS), times(spark, [("a", "2024-01-20"), ("d", "2024-02-01")]))
    state = orphans.step(orphans.empty_state(spark), ref(spark, REFS[:1]))
    assert kinds(state) == {("2024-01", "a"): "missing"}
    state = orphans.step(state, parents=times(spark, [("a", "2024-01-20")]))
    assert kinds(state) == {("2024-01", "a"): "late"}
    state = orphans.step(state, ref(spark, REFS[1:]), parents=times(spark, [("d", "2024-02-01")]))
    assert kinds(state) == kinds(whole)


def test_deletion_reopens_and_return_resolves(spark):
    state = orphans.step(None, ref(spark, [("a", "2024-03-01")]), parents=times(spark, [("a", "2024-01-01")]))
    assert kinds(state) == {}
    state = orphans.step(state, deletions=times(spark, [("a", "2024-04-01")]))
    assert kinds(state) == {("2024-03", "a"): "deleted"}
    state = orphans.step(state, parents=times(spark, [("a", "2024-05-01")]))
    assert kinds(state) == {("2024-03", "a"): "late"}
    assert orphans.counts(state).collect()[0].n_keys == 1


def test_empty_inputs(spark):
    assert orphans.report(orphans.step(orphans.empty_state(spark), ref(spark, []))).count() == 0


def test_history_fed_in_order_equals_the_whole(spark):
    scans = {1: "ab", 2: "b", 4: "abd", 5: "d"}
    day = lambda n: f"2024-0{n}-10"
    rows = [(n, k, day(n)) for n, keys in scans.items() for k in keys] + [(3, None, day(3)), (None, "z", None), (5, "d", None)]
    listing = spark.createDataFrame(rows, "n int, k string, t string").withColumn("t", F.col("t").cast("timestamp"))
    now = times(spark, [("d", "2024-03-01"), ("e", "2024-02-01"), ("e", None), ("f", None)])
    refs = [(k, f"2024-0{m}-15") for k in "abdefq" for m in range(1, 7)] + [("a", None), ("d", None), (None, "2024-01-01")]
    df = spark.createDataFrame(refs, "k string, t string").withColumn("t", F.col("t").cast("timestamp"))

    def references(after, until):
        t = F.col("t")
        low = df if after is None else df.filter(t > after)
        part = low if until is None else low.filter((t <= until) if after is not None else t.isNull() | (t <= until))
        return [orphans.Reference(part, "calls", "callee", F.col("k"), t)]

    expected = {(f"2024-0{m}", k): "deleted" for k in "ab" for m in range(1, 7)} | {(f"2024-0{m}", "q"): "missing" for m in range(1, 7)}
    expected |= {("2024-01", "d"): "late", ("2024-02", "d"): "late", ("2024-01", "e"): "late", ("unknown", "a"): "deleted"}
    for periods in (1, 2, 9):
        steps = []
        state = orphans.track(references, (listing, F.col("k"), "n", "t"), now, periods, lambda s, at: steps.append((str(at)[:10], kinds(s))))
        assert kinds(state) == expected
        assert len(steps) == min(periods, 5)
        if periods == 9:
            # after the first listing a and b are there; the second lacks a, the fourth has it again, the fifth lacks a and b
            assert steps[0][0] == "2024-01-10" and steps[0][1] == {("unknown", "d"): "missing"}
            assert steps[1][1][("2024-01", "a")] == "deleted" and ("2024-01", "b") not in steps[1][1]
            assert steps[3][1][("2024-01", "a")] == "late" and steps[4][1][("2024-01", "b")] == "deleted"
    gone = listing.limit(0)
    assert {k for _, k in kinds(orphans.track(references, (gone, F.col("k"), "n", "t"), now))} == set("abdeq")
