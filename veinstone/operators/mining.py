"""Mining of commits, diffs and code lines: bug-fix scores, hunks, fix patterns, hints and suspicious lines.

Rules are small fixed tables folded into one expression per type, so a text is scanned in the JVM once per
rule and nothing is joined. Defined results: null texts score nothing; ties between types go by their order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

# Words and references of bug-fix messages.
BUG_WORDS = (
    "fix", "fixed", "fixes", "fixing", "bug", "bugfix", "hotfix", "patch", "patched", "repair", "repaired",
    "resolve", "resolved", "resolves", "issue", "closes", "closed", "error", "crash", "failure", "broken", "broke",
)
ISSUE_PATTERNS = (r"#\d+", r"GH-\d+", r"[A-Z]{2,}-\d+", r"fixes?\s+#\d+", r"closes?\s+#\d+", r"resolves?\s+#\d+")

# Patterns of each type of fix.
PATTERN_RULES = {
    "null_check": [r"if\s+\w+\s+is\s+None", r"if\s+\w+\s+is\s+not\s+None", r"if\s+not\s+\w+:", r"if\s+\w+:", r"\w+\s+!=\s+None", r"\w+\s+==\s+None", r"\.get\(", r"or\s+\[\]", r"or\s+\{\}", r"or\s+\"\""],
    "bounds_check": [r"if\s+len\(", r"if\s+\w+\s*<\s*len\(", r"if\s+\w+\s*>=\s*0", r"if\s+\w+\s*>\s*0", r"\[\d+:\d+\]", r"min\(", r"max\("],
    "type_check": [r"isinstance\(", r"type\(\w+\)\s*==", r"type\(\w+\)\s*is", r"hasattr\("],
    "empty_check": [r"if\s+not\s+\w+:", r"if\s+len\(\w+\)\s*==\s*0", r"if\s+len\(\w+\)\s*>\s*0", r"if\s+\w+\s*==\s*\[\]", r"if\s+\w+\s*==\s*\{\}", r"if\s+\w+\s*==\s*\"\""],
    "duplicate_check": [r"set\(", r"if\s+\w+\s+in\s+", r"if\s+\w+\s+not\s+in\s+", r"\.add\(", r"dedupe", r"unique"],
    "range_check": [r"\d+\s*<=\s*\w+\s*<=\s*\d+", r"\w+\s*>=\s*\d+", r"\w+\s*<=\s*\d+", r"clamp\(", r"between"],
    "format_check": [r"re\.(match|search|findall)", r"\.strip\(", r"\.lower\(", r"\.upper\(", r"validate", r"parse"],
    "exception_handling": [r"try:", r"except\s+\w+:", r"finally:", r"raise\s+\w+", r"\.catch\("],
    "off_by_one": [r"range\(\s*\d+\s*,\s*len\(", r"range\(\s*len\(", r"\[\s*:\s*-\s*1\s*\]", r"\+\s*1\s*\]", r"-\s*1\s*\]"],
    "initialization": [r"=\s*None", r"=\s*\[\]", r"=\s*\{\}", r"=\s*0", r"=\s*\"\"", r"default", r"init"],
    "resource_management": [r"with\s+open\(", r"\.close\(", r"finally:", r"__enter__", r"__exit__"],
    "concurrency": [r"lock", r"mutex", r"async\s+def", r"await\s+", r"\.acquire\(", r"\.release\(", r"thread"],
}
# Words by which an invariant is about a type of fix.
PATTERN_WORDS = {
    "null_check": ["none", "null", "not none", "is not none"], "bounds_check": ["bounds", "length", "size", "index", "within"],
    "type_check": ["type", "isinstance", "is a", "must be"], "empty_check": ["empty", "not empty", "non-empty", "length"],
    "duplicate_check": ["duplicate", "unique", "distinct", "no duplicates"], "range_check": ["range", "between", "minimum", "maximum", "positive", "negative"],
    "format_check": ["format", "pattern", "valid", "match"], "exception_handling": ["error", "exception", "raise", "throw"],
    "off_by_one": ["all", "every", "each", "count"], "initialization": ["default", "initial", "set", "defined"],
    "resource_management": ["close", "cleanup", "release", "dispose"], "concurrency": ["thread", "safe", "lock", "concurrent"],
}


_LITERAL = re.compile(r'(?:[A-Za-z0-9_ "=]|\\[^\w\s])+')


def _matches(text: Column, pattern: str) -> Column:
    """Whether a pattern matches without regard to case; one without classes is a plain search in the lower-case text."""
    if _LITERAL.fullmatch(pattern):
        return F.coalesce(F.contains(F.lower(text), F.lit(re.sub(r"\\(.)", r"\1", pattern).lower())), F.lit(False))
    return F.coalesce(text.rlike(f"(?iU){pattern}"), F.lit(False))


def _sought(pattern: str) -> tuple[str, str]:
    """(the longest text that every match holds, an equal pattern for a search): repeats at its ends need only one."""
    at, run, texts = 0, "", []
    while at < len(pattern) and pattern[at] not in "([|":
        part = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        at += len(part)
        plain = "" if len(part) == 2 and part[1].isalnum() or part in "+*?." else part[-1]
        optional = pattern[at : at + 1] in ("*", "?")
        if plain and not optional:
            run += plain
        if not plain or optional or pattern[at : at + 1] == "+":
            texts.append(run)
            run = ""
    leaner = re.sub(r"(?<!\\)(\\[wds])\+$", r"\1", re.sub(r"^(\\[wds])\+", r"\1", pattern))
    return max([*texts, run], key=len), leaner


def _in_lower(lower: Column, pattern: str) -> Column:
    """Whether a pattern without capital classes matches a text in lower case; the pattern is tried only where its text stands."""
    if _LITERAL.fullmatch(pattern):
        return F.coalesce(F.contains(lower, F.lit(re.sub(r"\\(.)", r"\1", pattern).lower())), F.lit(False))
    text, leaner = _sought(pattern.lower())
    found = lower.rlike(f"(?U){leaner}")
    return F.coalesce(F.contains(lower, F.lit(text)) & found if text else found, F.lit(False))


def bug_fix_score(message: Column) -> Column:
    """0..1: words, references to issues, a message that starts with fix, and the words bug or error."""
    lower = F.lower(message)
    n = sum((F.when(F.contains(lower, F.lit(w)), 1).otherwise(0) for w in BUG_WORDS), F.lit(0))
    refers = _matches(message, "|".join(f"(?:{p})" for p in ISSUE_PATTERNS))
    explicit = F.contains(lower, F.lit("bug")) | F.contains(lower, F.lit("error"))
    points = F.least(F.lit(50), n * 20) + F.when(refers, 30).otherwise(0) + F.when(lower.startswith("fix"), 20).otherwise(0) + F.when(explicit, 15).otherwise(0)
    return F.least(F.lit(100), points) / F.lit(100)


def pattern_scores(added: Column, removed: Column | None = None) -> dict[str, Column]:
    """Score per type: 1 for each rule in the added text, and 0.5 more if the removed text lacks it."""
    out = {}
    added, removed = F.lower(added), None if removed is None else F.lower(removed)
    for kind, rules in PATTERN_RULES.items():
        score = F.lit(0.0)
        for rule in rules:
            was = _in_lower(removed, rule) if removed is not None else F.lit(False)
            score = score + F.when(_in_lower(added, rule), F.when(was, 1.0).otherwise(1.5)).otherwise(0.0)
        out[kind] = score
    return out


def best_pattern(scores: dict[str, Column]) -> Column:
    """struct(pattern, confidence): the first type with the greatest score; unknown with 0 if none scores."""
    pairs = F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("rank"), F.lit(k).alias("pattern")) for i, (k, s) in enumerate(scores.items())])
    # as a lambda, so that the greatest score is computed once
    named = F.transform(F.array(F.array_max(pairs)), lambda best: F.struct(
        F.when(best["score"] <= 0, "unknown").otherwise(best["pattern"]).alias("pattern"),
        F.when(best["score"] <= 0, 0.0).otherwise(F.least(F.lit(1.0), best["score"] / 3)).alias("confidence"),
    ))
    return F.get(named, F.lit(0))


def invariants_about(invariants: DataFrame, pattern_column: str, logic: str, name: str) -> DataFrame:
    """Rows of invariants whose logic or name has a word of their pattern's type; a fixed table in one expression."""
    words = F.create_map(*[x for k, v in PATTERN_WORDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    text = F.concat_ws("\n", F.lower(logic), F.lower(name))
    return invariants.filter(F.coalesce(F.exists(words[F.col(pattern_column)], lambda w: F.contains(text, w)), F.lit(False)))


_HINT = r"(?i)(?:#|//|/\*|\*|^|\s)\s*@(invariant|pre|post|requires)[:\s]+(.+)$"


def hints(df: DataFrame, key: str, body: str, start_line: str) -> DataFrame:
    """key, line, hint_type, hint: annotations @invariant, @pre, @post, @requires of the lines of a body, each once per line."""
    lines = df.filter(F.col(body).contains("@")).select(F.col(key), F.coalesce(F.col(start_line), F.lit(1)).alias("__start"), F.posexplode(F.split(body, r"\r\n|\r|\n")).alias("__pos", "text"))
    found = lines.filter(F.col("text").rlike(_HINT))
    clean = F.regexp_replace(F.regexp_extract("text", _HINT, 2), r"\s*(?:\*+/?)?\s*$", "")
    return found.select(key, (F.col("__start") + F.col("__pos")).alias("line"), F.lower(F.regexp_extract("text", _HINT, 1)).alias("hint_type"), clean.alias("hint")).distinct()


def parse_diff(text: str) -> list[dict]:
    """Hunks of a unified diff: paths, flags, ranges, header and lines.

    Within a hunk its counts tell how many lines are its own, so a removed line that looks like a file header is none.
    """
    hunks: list[dict] = []
    old = new = ""
    is_new = is_deleted = is_renamed = False
    left_old = left_new = 0
    for line in text.replace("\r\n", "\n").split("\n"):
        if hunks and (left_old > 0 or left_new > 0) and (line[:1] in ("+", "-", " ") or line == ""):
            if line[:1] != "+":
                left_old -= 1
            if line[:1] != "-":
                left_new -= 1
            hunks[-1]["lines"].append(line)
        elif line.startswith("diff --git "):
            parts = re.match(r"diff --git a/(.*) b/(.*)$", line)
            old, new = parts.groups() if parts else ("", "")
            is_new = is_deleted = False
            is_renamed = old != new
        elif line.startswith("--- "):
            is_new = line[4:].strip() == "/dev/null"
            old = old if is_new else re.sub(r"^a/", "", line[4:].split("\t")[0].strip())
        elif line.startswith("+++ "):
            is_deleted = line[4:].strip() == "/dev/null"
            new = new if is_deleted else re.sub(r"^b/", "", line[4:].split("\t")[0].strip())
        elif found := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?(.*)$", line):
            a, b, c, d, header = found.groups()
            left_old, left_new = int(b) if b else 1, int(d) if d else 1
            hunks.append({
                "old_path": old, "new_path": new, "is_new": is_new, "is_deleted": is_deleted, "is_renamed": is_renamed and not (is_new or is_deleted),
                "old_start": int(a), "old_count": left_old, "new_start": int(c), "new_count": left_new, "header": header, "lines": [],
            })
    return hunks


_HUNK = "hunk int, old_path string, new_path string, is_new boolean, is_deleted boolean, is_renamed boolean, old_start int, old_count int, new_start int, new_count int, header string, lines array<string>"


def diff_hunks(df: DataFrame, key: str, diff: str) -> DataFrame:
    """key and one row per hunk of each diff text."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _HUNK.split(", ")]
        types = [pa.int32(), pa.string(), pa.string(), *[pa.bool_()] * 3, *[pa.int32()] * 4, pa.string(), pa.list_(pa.string())]
        for batch in batches:
            keys = batch.column(0)
            rows, at = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for n, h in enumerate(parse_diff(text)):
                    at.append(i)
                    rows.append((n, *[h[c] for c in names[1:]]))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]], names=[key, *names])

    return df.select(key, diff).filter(F.col(diff).isNotNull()).mapInArrow(run, f"`{key}` {kind}, {_HUNK}")


def hunk_sides(hunks: DataFrame) -> DataFrame:
    """hunks with added and removed: the texts of their changed lines."""
    side = lambda sign: F.array_join(F.transform(F.filter("lines", lambda x: x.startswith(sign)), lambda x: F.substring(x, F.lit(2), F.length(x))), "\n")
    return hunks.withColumns({"added": side("+"), "removed": side("-")})


def strengthening(matches: DataFrame, key: str, invariant: str) -> DataFrame:
    """key, n_validated, boost: 0.05 for each different validated invariant, at most 0.25."""
    counted = matches.groupBy(key).agg(F.countDistinct(invariant).alias("n_validated"))
    return counted.withColumn("boost", F.least(F.lit(25), F.col("n_validated") * 5) / F.lit(100))


# Marks of suspicious lines, and names of variables that hold results.
_ADDS = (".append(", ".extend(", ".add(", ".insert(", ".update(", "+=")
_RESULTS = ("result", "output", "ret", "response", "data", "value")


def suspicious_lines(df: DataFrame, key: str, body: str, words: list[str]) -> DataFrame:
    """key, line, score of lines scored at least 0.25 for an invariant with the given words (0.3 if the line has one).

    0.4 for adding to a collection without a check in the three lines before (if a word is about duplicates),
    0.15 for a return, 0.2 for assigning a result, 0.1 for an if that no else follows within five lines.
    """
    lines = df.filter(F.col(body).isNotNull()).select(key, F.posexplode(F.split(body, r"\r\n|\r|\n")).alias("pos", "text"))
    order = Window.partitionBy(key).orderBy("pos")
    lower = F.lower("text")
    has = lambda c, parts: F.coalesce(F.greatest(*[F.contains(c, F.lit(p)).cast("int") for p in [*parts, parts[0]]]), F.lit(0)) == 1
    checks = F.max(F.when(has(lower, ["not in", "if", "check"]), 1).otherwise(0)).over(order.rowsBetween(-3, -1))
    indent = F.length("text") - F.length(F.ltrim("text"))
    ahead = F.collect_list(F.struct(F.trim("text").alias("t"), indent.alias("i"))).over(order.rowsBetween(1, 5))
    stop = lambda x: F.when(x["t"].startswith("else:") | x["t"].startswith("elif "), 1).when(x["t"].startswith("if ") & (x["i"] == F.col("indent")), 2).otherwise(0)
    seen = lines.withColumns({"checked": F.coalesce(checks, F.lit(0)), "ahead": ahead, "indent": indent})
    else_follows = F.coalesce(F.get(F.filter(F.transform("ahead", stop), lambda x: x > 0), F.lit(0)), F.lit(0)) == 1
    points = (
        F.when(has(lower, words), 30).otherwise(0)
        + (F.when(has(F.col("text"), list(_ADDS)) & (F.col("checked") == 0), 40).otherwise(0) if any(w in ("duplicate", "unique") for w in words) else F.lit(0))
        + F.when(F.contains(lower, F.lit("return")), 15).otherwise(0)
        + F.when(has(lower, [f"{v} =" for v in _RESULTS] + [f"{v}=" for v in _RESULTS]), 20).otherwise(0)
        + F.when(F.ltrim("text").startswith("if ") & ~else_follows, 10).otherwise(0)
    )
    return seen.withColumn("points", points).filter("points >= 25").select(key, (F.col("pos") + 1).alias("line"), (F.least(F.lit(100), F.col("points")) / F.lit(100)).alias("score"))
