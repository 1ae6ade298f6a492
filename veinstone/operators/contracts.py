"""Validation of contract documents: every rule that a document breaks, one row each.

Defined results: a null document has no row of its own kind but INVALID_JSON; texts are judged without outer
blanks; a document that is valid has no row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veinstone.functions.schema import CRITICALITIES, ON_FAIL

_PROBLEMS = "key string, code string, location string, message string"


def _text(value: object, place: str, least: int, out: list[tuple[str, str, str]]) -> None:
    if not isinstance(value, str):
        out.append(("INVALID_SCHEMA", place, "missing" if value is None else "not a text"))
    elif len(value.strip()) < least:
        out.append(("INVALID_SCHEMA", place, f"shorter than {least}" if value.strip() else "blank"))


def problems(document: str | None) -> list[tuple[str, str, str]]:
    """(code, location, message) of everything wrong with a document."""
    try:
        doc = json.loads(document or "")
    except (ValueError, RecursionError) as e:
        where = f"{e.lineno}:{e.colno}" if isinstance(e, json.JSONDecodeError) else ""
        return [("INVALID_JSON", where, getattr(e, "msg", str(e)))]
    if not isinstance(doc, dict):
        return [("INVALID_SCHEMA", "", "not an object")]
    out: list[tuple[str, str, str]] = []
    _text(doc.get("function_signature"), "function_signature", 1, out)
    _text(doc.get("intent_summary"), "intent_summary", 10, out)
    invariants = doc.get("invariants")
    if not isinstance(invariants, list) or not invariants:
        out.append(("INVALID_SCHEMA", "invariants", "not a list with an item"))
    for i, item in enumerate(invariants if isinstance(invariants, list) else []):
        if not isinstance(item, dict):
            out.append(("INVALID_SCHEMA", f"invariants.{i}", "not an object"))
            continue
        _text(item.get("name"), f"invariants.{i}.name", 1, out)
        _text(item.get("logic"), f"invariants.{i}.logic", 5, out)
        for field, allowed in (("criticality", CRITICALITIES), ("on_fail", ON_FAIL)):
            if item.get(field) not in allowed:
                out.append(("INVALID_SCHEMA", f"invariants.{i}.{field}", "not one of " + ", ".join(allowed)))
    examples = doc.get("io_examples", [])
    if not isinstance(examples, list):
        out.append(("INVALID_SCHEMA", "io_examples", "not a list"))
    for i, item in enumerate(examples if isinstance(examples, list) else []):
        if not isinstance(item, dict):
            out.append(("INVALID_SCHEMA", f"io_examples.{i}", "not an object"))
            continue
        if not isinstance(item.get("input"), dict):
            out.append(("INVALID_SCHEMA", f"io_examples.{i}.input", "not an object"))
        if "output" not in item:
            out.append(("INVALID_SCHEMA", f"io_examples.{i}.output", "missing"))
        if item.get("description") is not None and not isinstance(item["description"], str):
            out.append(("INVALID_SCHEMA", f"io_examples.{i}.description", "not a text"))
    return out


def validate(df: DataFrame, key: Column, document: Column) -> DataFrame:
    """key, code, location, message."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *p) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in problems(text)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 4)], names=["key", "code", "location", "message"])

    return df.select(key.cast("string").alias("key"), document.cast("string").alias("document")).mapInArrow(run, _PROBLEMS)
