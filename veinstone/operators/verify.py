"""Verification of (input, output) rows against invariants written in plain words.

The words are compiled to Column expressions over typed columns, so a table of pairs is checked in one scan
with generated code; texts are never evaluated as programs. What the rules can't read is held for true, as
is a rule that doesn't suit the type of the output. Defined results: a check that is null (a null output)
has not passed; checks go in the given order; no invariants: passed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Invariant:
    name: str
    logic: str
    criticality: str = "MEDIUM"


@dataclass(frozen=True)
class Typed:
    """The output column, its Spark type, and the input columns by name."""

    output: Column
    kind: str
    inputs: dict[str, Column]

    @property
    def number(self) -> bool:
        return self.kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or self.kind.startswith("decimal")

    @property
    def sized(self) -> bool:
        return self.kind == "string" or self.kind.startswith(("array", "map"))

    def size(self) -> Column:
        return F.length(self.output) if self.kind == "string" else F.size(self.output)

    def total(self) -> Column:
        return sum(self.inputs.values(), F.lit(0))

    def each(self, test: Callable[[Column], Column]) -> Column | None:
        if self.kind.startswith("array"):
            return F.forall(self.output, test)
        return test(self.output) if self.number else None


def _any(words: str, *parts: str) -> bool:
    return any(p in words for p in parts)


def _type_rule(words: str, t: Typed) -> Column | None:
    kinds = {"list": ("array",), "dict": ("map", "struct"), "string": ("string",), "int": ("tinyint", "smallint", "int", "bigint"), "bool": ("boolean",)}
    for name, starts in kinds.items():
        if re.search(rf"\b(?:is|returns) an? {name}", words):
            return F.lit(t.kind.startswith(starts))
    return None


def compile_logic(logic: str, t: Typed) -> Column | None:
    """The check that the words mean for this type, by the first rule that fits; None if there is none."""
    words = logic.lower().strip()
    about_output = _any(words, "output", "result")
    if _any(words, "not empty", "non-empty", "non empty", "nonempty") and "output" in words:
        return t.size() > 0 if t.sized else t.output.isNotNull()
    if _any(words, "not none", "returns something"):
        return t.output.isNotNull()
    if _any(words, "positive", "greater than zero", "> 0", ">0") and about_output:
        return t.each(lambda x: x > 0)
    if _any(words, "non-negative", "non negative", "nonnegative", "not negative", ">= 0", ">=0") and about_output:
        return t.each(lambda x: x >= 0)
    if _any(words, "no duplicate", "unique", "distinct") and "output" in words:
        return F.size(F.array_distinct(t.output)) == F.size(t.output) if t.kind.startswith("array") else None
    if _any(words, "sum preserved", "sum is preserved", "total preserved", "total is preserved"):
        return F.aggregate(t.output, F.lit(0.0), lambda a, x: a + x) == t.total() if t.kind.startswith("array") else None
    if _any(words, "length preserved", "count preserved", "same length", "same size"):
        lists = [c for n, c in t.inputs.items() if n in ("items", "values")]
        return F.size(lists[0]) == F.size(t.output) if lists and t.kind.startswith("array") else None
    if _any(words, "contains", "includes") and "@" in words and "email" in words:
        return F.contains(t.output.cast("string"), F.lit("@"))
    for verb in ("starts with", "ends with"):
        if found := re.search(rf"{verb} ['\"]?([^'\"]+)['\"]?", words):
            text = t.output.cast("string")
            return text.startswith(found.group(1).strip()) if verb[0] == "s" else text.endswith(found.group(1).strip())
    if (checked := _type_rule(words, t)) is not None:
        return checked
    if _any(words, "double", "twice"):
        named = [c for n, c in t.inputs.items() if re.search(rf"\b{re.escape(n)}\b", words)]
        return t.output == named[0] * 2 if named and t.number else None
    if "input" in words and "output" in words and t.number:
        if _any(words, "less than or equal", "<=", "never exceeds", "at most"):
            return t.output <= t.total()
        if _any(words, "greater than or equal", ">=", "at least"):
            return t.output >= t.total()
    if (found := re.search(r"between\s+(\d+)\s+and\s+(\d+)", words)) and t.number:
        return t.output.between(int(found.group(1)), int(found.group(2)))
    return None


def check_rows(df: DataFrame, output: str, inputs: Sequence[str], invariants: Sequence[Invariant]) -> DataFrame:
    """df with checks (array of name, criticality, passed; every check runs), passed, and failed (names in order)."""
    t = Typed(F.col(output), dict(df.dtypes)[output], {c: F.col(c) for c in inputs})
    rows = []
    for i in invariants:
        test = compile_logic(i.logic, t)
        passed = F.lit(True) if test is None else F.coalesce(test, F.lit(False))
        rows.append(F.struct(F.lit(i.name).alias("name"), F.lit(i.criticality).alias("criticality"), passed.alias("passed")))
    empty = F.lit(None).cast("array<struct<name:string,criticality:string,passed:boolean>>")
    checks = F.array(*rows) if rows else F.coalesce(empty, F.array().cast("array<struct<name:string,criticality:string,passed:boolean>>"))
    return df.withColumn("checks", checks).withColumns({
        "passed": F.forall("checks", lambda c: c["passed"]),
        "failed": F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["name"]),
    })


def violations(checked: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, name, criticality, rank: one row per failed check, HIGH before MEDIUM before LOW, then in order."""
    order = F.when(F.col("c.criticality") == "HIGH", 0).when(F.col("c.criticality") == "MEDIUM", 1).when(F.col("c.criticality") == "LOW", 2).otherwise(99)
    return checked.select(*key, F.posexplode("checks").alias("pos", "c")).filter(~F.col("c.passed")).select(*key, F.col("c.name").alias("name"), F.col("c.criticality").alias("criticality"), (order * 1000 + F.col("pos")).alias("rank"))


def summary(checked: DataFrame) -> DataFrame:
    """name, n_passed, n_failed over all rows."""
    each = checked.select(F.explode("checks").alias("c"))
    return each.groupBy(F.col("c.name").alias("name")).agg(F.count_if(F.col("c.passed")).alias("n_passed"), F.count_if(~F.col("c.passed")).alias("n_failed"))
