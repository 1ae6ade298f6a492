"""Normalised code and its hash.

Comments go (for Python also every triple-quoted literal), blanks at line ends and runs of blanks shrink to
one, empty lines go; the hash is SHA-256 of what is left. Strings keep their comment signs. Defined results:
null stays null; an unknown language keeps its comments; a block comment without end takes the rest.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_PYTHON = re.compile(r'("""|\'\'\')(?:\\.|.)*?(?:\1|\Z)|"(?:[^"\\\n]|\\.)*"?|\'(?:[^\'\\\n]|\\.)*\'?|#[^\n]*', re.S)
_BRACES = re.compile(r'/\*.*?(?:\*/|\Z)|//[^\n]*|"(?:[^"\\\n]|\\.)*"?|\'(?:[^\'\\\n]|\\.)*\'?|`(?:[^`\\]|\\.)*(?:`|\Z)', re.S)
# Names of languages by the way their comments are written.
_HASH_LANGUAGES = frozenset({"python", "py"})
_SLASH_LANGUAGES = frozenset({"javascript", "js", "typescript", "ts", "cpp", "c++", "c", "java", "go", "rust"})


def without_comments(code: str, language: str | None) -> str:
    name = (language or "").strip().lower()
    if name in _HASH_LANGUAGES:
        return _PYTHON.sub(lambda m: "" if m.group()[0] == "#" or m.group(1) else m.group(), code)
    if name in _SLASH_LANGUAGES:
        return _BRACES.sub(lambda m: "" if m.group()[:2] in ("//", "/*") else m.group(), code)
    return code


@pandas_udf(StringType())
def _strip(code: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else without_comments(c, n) for c, n in zip(code, language)], dtype=object)


def collapsed(text: Column) -> Column:
    """Lines without outer blanks, runs of blanks as one, empty lines gone; in the JVM."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def normalised(code: Column, language: Column) -> Column:
    return collapsed(_strip(code, language))


def code_hash(code: Column, language: Column) -> Column:
    """SHA-256 in hex of the normalised code."""
    return F.sha2(normalised(code, language), 256)
