"""Source trees as tables: one row per function, read and parsed in the executors.

Files come from Spark's binaryFile source; names are matched against ignore globs before their content is
read. Ids are relative to the scanned root. Python is parsed with its own grammar where it is valid and with
the island grammar where not; other languages with the island grammars. Defined results: of definitions with
one qualified name in a file the last counts, in C and C++ the first; files of other suffixes are skipped;
bytes that aren't UTF-8 are replaced.
"""

from __future__ import annotations

import ast
import fnmatch
import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veinstone.functions.islands import GRAMMARS, grammar_of, members_of

# Files and folders that are no sources of a project.
IGNORED = (
    "__pycache__", "*.pyc", ".git", ".svn", ".hg", "node_modules", "venv", ".venv", "env", ".env", "dist", "build", "*.egg-info", ".tox", ".pytest_cache",
)
# The language of each grammar's files.
LANGUAGES = {"python": "python", "script": "javascript", "c": "cpp"}

_ROWS = (
    "function_id string, file_path string, function_name string, qualified_name string, signature string, body string, code_hash string,"
    " language string, start_line int, end_line int, parent string, decorators array<string>, is_method boolean, is_async boolean"
)
_ERRORS = "file_path string, line int, column int, message string"


def _glob_regex(globs: Sequence[str]) -> str:
    return "|".join("(?:^|/)" + fnmatch.translate(g).removeprefix("(?s:").removesuffix(")\\Z").removesuffix(")\\z").replace(".*", "[^/]*") + "(?:/|$)" for g in globs)


def _python_functions(text: str) -> list[dict]:
    lines = text.split("\n")
    out: list[dict] = []

    def visit(node: ast.AST, around: list[str], in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                head_end = child.body[0].lineno - 1 if child.body and child.body[0].lineno > child.lineno else child.lineno
                head = "\n".join(lines[child.lineno - 1 : max(head_end, child.lineno)]).strip()
                out.append({
                    "name": child.name, "qualified": ".".join([*around, child.name]), "signature": head.split(":\n")[0] + (":" if ":\n" in head else ""), "body": "\n".join(lines[first - 1 : child.end_lineno]), "start": first,
                    "end": child.end_lineno, "parent": ".".join(around) or None, "decorators": [ast.unparse(d) for d in child.decorator_list], "method": in_class, "is_async": isinstance(child, ast.AsyncFunctionDef),
                })
                visit(child, [*around, child.name], False)
            elif isinstance(child, ast.ClassDef):
                visit(child, [*around, child.name], True)
            else:
                visit(child, around, in_class)

    visit(ast.parse(text), [], False)
    return out


def _island_functions(text: str, grammar: str) -> list[dict]:
    lines = text.split("\n")
    out = []
    for m in members_of(text, grammar):
        parent = m.qualified.rpartition(".")[0]
        out.append({
            "name": m.name.rpartition(".")[2], "qualified": m.qualified, "signature": m.signature, "body": "\n".join(lines[m.line - 1 : m.end_line]), "start": m.line, "end": m.end_line, "parent": parent or None,
            "decorators": ["export"] if m.signature.startswith("export") else [], "method": bool(parent) and m.name.count(".") < m.qualified.count("."), "is_async": "async" in m.signature.split("(")[0].split(),
        })
    return out


def functions_of(text: str, grammar: str) -> tuple[list[dict], list[tuple[int, int, str]]]:
    """(functions, syntax errors as line, column, message) of one source."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    errors: list[tuple[int, int, str]] = []
    found: list[dict] | None = None
    if grammar == "python":
        try:
            found = _python_functions(text)
        except SyntaxError as e:
            errors.append((e.lineno or 0, e.offset or 0, e.msg or "syntax error"))
        except (ValueError, RecursionError, MemoryError) as e:
            errors.append((0, 0, str(e) or type(e).__name__))
    if found is None:
        found = _island_functions(text, grammar)
    by_name: dict[str, dict] = {}
    for f in found:
        if grammar == "c":
            by_name.setdefault(f["qualified"], f)
        else:
            by_name[f["qualified"]] = f
    return list(by_name.values()), errors


def _files(spark: SparkSession, root: str, ignored: Sequence[str], recursive: bool) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base)
    whole = full.toString().rstrip("/")
    whole = whole.replace("file:///", "file:/") if whole.startswith("file:///") else whole
    path = F.regexp_replace("path", "^file:/+", "file:/")
    relative = F.when(path.startswith(whole + "/"), F.substring(path, F.lit(len(whole) + 2), F.length(path))).otherwise(F.element_at(F.split(path, "/"), -1))
    suffix = F.lower(F.element_at(F.split(relative, r"\."), -1))
    known = raw.withColumn("file_path", F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B")))).filter(suffix.isin(*[k for k in GRAMMARS if len(k) < 4 or k in ("python",)]))
    return known.filter(~F.col("file_path").rlike(_glob_regex(ignored))).select("file_path", "content")


def scan_directory(spark: SparkSession, root: str, ignored: Sequence[str] = IGNORED, recursive: bool = True) -> DataFrame:
    """The functions of all sources below root (or of one file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _ROWS.split(", ")]
        types = [*[pa.string()] * 8, pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_()]
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grammar = grammar_of(path, None)
                if grammar is None:
                    continue
                for f in functions_of(content.decode("utf-8", "replace"), grammar)[0]:
                    digest = hashlib.sha256(f["body"].encode("utf-8", "replace")).hexdigest()
                    rows.append((f"{path}::{f['qualified']}", path, f["name"], f["qualified"], f["signature"], f["body"], digest, LANGUAGES[grammar], f["start"], f["end"], f["parent"], f["decorators"], f["method"], f["is_async"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names=names)

    return _files(spark, root, ignored, recursive).mapInArrow(run, _ROWS)


def syntax_errors(spark: SparkSession, root: str, ignored: Sequence[str] = IGNORED, recursive: bool = True) -> DataFrame:
    """file_path, line, column, message of the sources that their grammar rejects; their functions are scanned all the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (path, *error) for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (grammar := grammar_of(path, None))
                for error in functions_of(content.decode("utf-8", "replace"), grammar)[1]
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, (pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["file_path", "line", "column", "message"])

    return _files(spark, root, ignored, recursive).mapInArrow(run, _ERRORS)
