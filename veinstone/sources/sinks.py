"""Sinks: response envelopes, reports and arrays for plots; results are written by the executors where they may be large."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, functions as F

#: Rows that a report lists.
REPORT_ROWS = 1000


def _plain(value: object) -> object:
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return value


def envelope(data: object = None, error: tuple[str, str] | None = None, pretty: bool = False) -> str:
    """{"success", "data", "error"} as JSON text for a small result."""
    body = {"success": error is None, "data": _plain(data) if error is None else None, "error": {"code": error[0], "message": error[1]} if error else None}
    return json.dumps(body, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"))


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row, written by the executors."""
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")).write.text(path)


def markdown(df: DataFrame, title: str, rows: int = REPORT_ROWS) -> str:
    """A report of the first rows of df as a Markdown table."""
    cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in df.limit(rows).collect()]
    return "\n".join(lines) + "\n"


def series(df: DataFrame, x: str, y: str, points: int = REPORT_ROWS) -> dict[str, list]:
    """x and y of the first points by x, for a plot."""
    rows = df.filter(F.col(x).isNotNull()).orderBy(x, y).limit(points).select(x, y).collect()
    return {"x": [r[0] for r in rows], "y": [r[1] for r in rows]}


def plot_kind(data: dict[str, Sequence]) -> str:
    """bar for categories or where x or y lacks; line for consecutive integers or up to 20 points, else scatter."""
    if "categories" in data or not data.get("x") or not data.get("y"):
        return "bar"
    x = list(data["x"])
    if len(x) != len(data["y"]):
        raise ValueError("x and y differ in length")
    if all(isinstance(v, int) for v in x) and x == list(range(x[0], x[0] + len(x))):
        return "line"
    return "scatter" if len(x) > 20 else "line"
