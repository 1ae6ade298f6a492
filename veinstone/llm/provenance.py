"""Which source files were not written by hand for the code base.

Each body becomes tokens without comments; a Re-Pair grammar is inferred over them with names freed of
their digits, numbers, strings and one- or two-letter names as classes. Rules with words that are used again
and again over much of the body mean generated code; terminals of short names alone mean minified code; a long
run of literals whose own grammar saves hardly anything is data saved as code. A run of SHARED_TOKENS tokens,
with the names as written, that stands in two repositories (first folder of the path) means a copy, as it is a
rule that both can use, whether or not Re-Pair would cut it elsewhere: fingerprints chosen by their content
(winnowing) tell which runs may be shared, and the repositories of these are counted over all rows. Notices in
comments and the names of folders and files are further signs of the same table. One sign in any row is enough
for its file.

Grammars are inferred only where a window of RULE_LENGTH tokens occurs RULE_USES times, without which no rule
can be a sign. Bodies longer than a block are cut where their content says, and all blocks count together.

Defined results: rows without path have no file and give nothing; null bodies leave the path alone to tell;
what stands in strings is no notice; a notice that names an owner of the code base is none.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veinstone.session import cut, join_spread

#: Least and most tokens that one grammar covers; in between a block ends at a token whose hash is 0 modulo BLOCK_EVERY.
BLOCK, BLOCK_MOST, BLOCK_EVERY = 10_000, 40_000, 128
#: Uses and expanded length of a rule with words, and the share of the body's tokens in such rules, that mean generated code.
RULE_USES, RULE_LENGTH, RULE_SHARE = 6, 8, 0.2
#: Share of names with at most two letters, and least tokens, that mean minified code.
SHORT_SHARE, SHORT_TOKENS = 0.62, 20
#: Characters of a run of literals, its share of the code, and bits of its grammar per bit of its alphabet that mean data.
RUN_CHARS, RUN_SHARE, RUN_BITS = 180, 0.5, 0.5
#: Tokens of a run in two repositories that shows copying.
SHARED_TOKENS = 40
#: Tokens of a fingerprint and windows of which the least is kept: every common run of GRAM + WINDOW - 1 = SHARED_TOKENS tokens has one in common.
GRAM, WINDOW = 30, 11

_LITERALS = r"""
      | (?P<text>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z))
      | (?P<string>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*(?:`|\Z))
      | (?P<number>0[xX][0-9a-fA-F]+|\d[\w.]*) | (?P<word>[^\W\d]\w*) | (?P<sign>[^\s\w])"""
_HASH_TOKEN = re.compile(r"(?P<comment>\#[^\n]*)" + _LITERALS, re.X | re.S)
_SLASH_TOKEN = re.compile(r"(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)" + _LITERALS, re.X | re.S)
_C_LIKE = re.compile(r"\.(?:c|cc|cpp|cxx|h|hh|hpp|hxx|js|jsx|mjs|cjs|ts|tsx|java|go|rs|cs|kt|swift|scala|dart)$", re.I)

# Names of folders and files that tools and package managers use (a name like x_codegen is a generator, not its output).
PATH_SIGN = re.compile(
    r"""(?:^|/)(?:_?vendor(?:ed)?|third[_-]?party|3rd[_-]?party|node_modules|bower_components|site-packages|\.?venv|externals?|extern|deps|contrib
        |dist|build|_?gen|_?generated|autogen|codegen_out|__generated__|generated-sources)/
      | [.-]min\.\w+$ | \.(?:bundle|chunk)(?:\.[0-9a-f]+)?\.\w+$ | [._](?:generated|gen|autogen)\.\w+$ | \.g\.\w+$ | \.pb\.\w+$ | _pb2?(?:_grpc)?\.\w+$ | \.tab\.\w+$ | \.designer\.\w+$
      | (?:^|/)(?:moc|qrc)_[^/]+\.(?:cpp|cc|cxx|h)$ | (?:^|/)ui_[^/]+\.(?:py|h|hpp)$""",
    re.X | re.I,
)
# How tools and third parties mark a file in its comments.
NOTICE = re.compile(
    r"""@generated\b | <auto-?generated\b | \bmode:\s*generated\b | \b(?:machine|tool)[ -](?:written|made|generated)\b
      | \bauto(?:matically)?[ -]?generated\s+(?:file|code|source|by|from|at|with|using|on|do\ not)\b | ^[^\w\n]*auto-?generated[^\w\n]*$
      | \b(?:generated|produced|emitted|compiled)\s+(?:automatically\s+)?(?:by|from|with)\s+\S+ | \b(?:created|written)\s+automatically\s+(?:by|from|with)\b
      | \bdo\ not\ (?:edit|modify|change|touch)\b(?:\s+(?:this\ file|by\ hand|manually|directly))?[^\w\n]*(?:$|[.!;,\n]) | \bedit\s+\S+\.\w+\s+instead\b
      | \bchanges\s+(?:made\s+)?(?:here|to\ this\ file)?\s*(?:are|will\ be)\s+(?:lost|overwritten)\b | \brun\s+.{1,60}\s+to\s+(?:refresh|regenerate)\b
      | @licen[sc]e\b | \bspdx-license-identifier\b | \b(?:released|licen[sc]ed|distributed|available)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?(?:mit|bsd|apache|gnu|gpl|lgpl|mpl|isc|\w+\s+licen[sc]e)
      | \bpermission\s+is\s+hereby\s+granted\b | \b(?:copied|imported|vendored|taken|adapted)\s+(?:\w+\s+){0,2}from\s+(?:the\s+)?[\w.-]+\s+(?:project|library|package|v?\d) | \bbundled\s+copy\s+of\b
      | ^[^\w\n]*upstream:\s | ^[^\w\n]*local\s+patches:\s | \bsourcemappingurl= | ^/\*!\s*[\w.-]+\s+v?\d+(?:\.\d+)+ | \bfootprint\ edition\b""",
    re.X | re.I | re.M,
)
_HOLDER = re.compile(r"(?:copyright|\(c\)|©)[^\n]*", re.I)


def repair(sequence: list[int]) -> tuple[list[tuple[int, int]], list[int], int]:
    """(rules, rewritten sequence, first rule's symbol): the most frequent pair becomes a rule until none repeats.

    Pairs of symbols that stand side by side once never come to stand so again, so only repeated ones are kept.
    """
    n = len(sequence)
    symbol, after, before = list(sequence), list(range(1, n + 1)), list(range(-1, n - 1))
    first = fresh = max(symbol, default=-1) + 1
    pairs = list(zip(sequence, sequence[1:]))
    places: dict[tuple[int, int], set[int]] = {p: set() for p, c in Counter(pairs).items() if c > 1}
    if not places:
        return [], symbol, first
    for i, pair in enumerate(pairs):
        if pair in places:
            places[pair].add(i)
    heap = [(-len(at), pair) for pair, at in places.items()]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heapq.heappop(heap)
        at = places.get(pair)
        if at is None or len(at) < 2:
            continue
        if len(at) != -count:
            heapq.heappush(heap, (-len(at), pair))
            continue
        apart, last = [], -1  # occurrences that don't overlap
        for i in sorted(at):
            if i != last:
                apart.append(i)
                last = after[i]
        if len(apart) < 2:
            continue
        made: dict[tuple[int, int], set[int]] = {}
        for i in apart:
            j = after[i]
            left, right = before[i], after[j]
            if left >= 0:
                old = symbol[left], symbol[i]
                if (known := made.get(old) or places.get(old)) is not None:
                    known.discard(left)
            if right < n:
                old = symbol[j], symbol[right]
                if (known := places.get(old)) is not None:
                    known.discard(j)
                before[right] = i
                made.setdefault((fresh, symbol[right]), set()).add(i)
            symbol[i], after[i] = fresh, right
            if left >= 0:
                made.setdefault((symbol[left], fresh), set()).add(left)
        places.pop(pair, None)
        rules.append(pair)
        fresh += 1
        for new, where in made.items():
            if len(where) > 1:
                places[new] = where
                heapq.heappush(heap, (-len(where), new))
    rest, i = [], 0
    while i < n:
        rest.append(symbol[i])
        i = after[i]
    return rules, rest, first


def rule_uses(rules: list[tuple[int, int]], rest: list[int], first: int) -> tuple[list[int], list[int]]:
    """(uses in the whole text, expanded length) of every symbol."""
    length = [1] * first + [0] * len(rules)
    for r, (a, b) in enumerate(rules):
        length[first + r] = length[a] + length[b]
    uses = [0] * len(length)
    for s in rest:
        uses[s] += 1
    for r in range(len(rules) - 1, -1, -1):
        a, b = rules[r]
        uses[a] += uses[first + r]
        uses[b] += uses[first + r]
    return uses, length


@lru_cache(maxsize=65_536)
def _class(kind: str, token: str) -> str:
    if kind == "word":
        return "v" if len(token) <= 2 else re.sub(r"\d+", "#", token)
    return {"number": "N", "string": "S", "text": "S"}.get(kind, token)


def _hash(tokens: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(tokens).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_BETWEEN = frozenset(",[](){}-+;:=")
_VALUE_AFTER = frozenset(["=", ",", "(", "[", "{", "+", ":"])
_PREFIX = re.compile(r"[rbu]|br|rb|l|u8", re.I)
# Constants of JSON and of the languages read.
_CONSTANTS = frozenset(["null", "true", "false", "None", "True", "False", "NaN", "undefined", "nullptr", "NULL"])


def _is_prose(text: str) -> bool:
    words = text.split()
    return sum(w.strip(".,;:!?()'\"").isalpha() and len(w) <= 20 for w in words) > 0.3 * len(words)


def _literal_run(code: list[tuple[str, str]]) -> str:
    """The longest text of literals with only list signs, keys and constants between them; a text over lines counts where it is a value."""
    best, run, size = "", [], 0
    before = ""
    for i, (kind, token) in enumerate(code):
        after = code[i + 1] if i + 1 < len(code) else ("", "")
        if kind in ("number", "string"):
            run.append(token.strip("\"'`"))
            size += len(run[-1])
        elif kind == "text" and ((before in _VALUE_AFTER and before != ":") or before == "return" or _PREFIX.fullmatch(before) or before == ":" and run) and not _is_prose(token.strip("\"'")):
            run.append(" ".join(token.strip("\"'").split()))
            size += len(run[-1])
        elif kind == "word" and (
            (_PREFIX.fullmatch(token) and after[0] in ("string", "text"))
            or (run and token in _CONSTANTS and before in _VALUE_AFTER)
            or (before in ("{", ",") and after[1] in (":", "="))
        ):
            pass
        elif token not in _BETWEEN or (token == "=" and not run):
            if size > len(best):
                best = " ".join(run)
            run, size = [], 0
        if not (kind == "word" and token in _CONSTANTS):
            before = token
        else:
            before = "0"
    return max(best, " ".join(run), key=len)


def blocks(tokens: list[str]) -> list[list[str]]:
    """Tokens cut at places that their content names, so that a shift moves no other cut."""
    out, start = [], 0
    while len(tokens) - start > BLOCK_MOST:
        end = next((i for i in range(start + BLOCK, start + BLOCK_MOST) if _token_hash(tokens[i]) % BLOCK_EVERY == 0), start + BLOCK_MOST)
        out.append(tokens[start:end])
        start = end
    return [*out, tokens[start:]]


def grammar_bits(text: str) -> float:
    """Bits of the text's grammar per bit of the text in its alphabet: about 1 or more where nothing repeats, near 0 where all does."""
    bits = plain = 0.0
    for block in blocks(list(text)):
        alphabet: dict[str, int] = {}
        rules, rest, first = repair([alphabet.setdefault(c, len(alphabet)) for c in block])
        bits += (len(rest) + 2 * len(rules)) * math.log2(max(2, first + len(rules)))
        plain += len(block) * math.log2(max(2, len(alphabet)))
    return bits / plain if plain else 0.0


def is_data(code: list[tuple[str, str]]) -> bool:
    """True if most of the code is one run of literals whose grammar saves hardly anything."""
    run = _literal_run(code)
    if len(run) < RUN_CHARS or len(run) < RUN_SHARE * sum(len(t) for _, t in code):
        return False
    return grammar_bits(run) >= RUN_BITS


@lru_cache(maxsize=65_536)
def _token_hash(token: str) -> int:
    return _hash([token])


def _grams(numbers: list[int], length: int) -> Iterator[int]:
    """A hash of every window of so many numbers."""
    return map(hash, zip(*[numbers[i:] for i in range(length)]))


def _spans(values: np.ndarray, length: int) -> np.ndarray:
    """A hash of every window of so many values, from two narrower windows that overlap."""
    reach = 1
    while reach < length:
        step = min(reach, length - reach)
        values = values[:-step] * np.uint64(0x9E3779B97F4A7C15) + values[step:]
        values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(29)
        reach += step
    return values


def runs_of(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, hash) of every run of SHARED_TOKENS tokens; the fingerprint is the least hash of its WINDOW windows of GRAM."""
    if len(tokens) < SHARED_TOKENS:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    values = np.fromiter(map(_token_hash, tokens), np.int64, len(tokens)).view(np.uint64)
    least, reach = _spans(values, GRAM), 1
    while reach < WINDOW:
        step = min(reach, WINDOW - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return least.view(np.int64), _spans(values, SHARED_TOKENS).view(np.int64)


def fingerprints(tokens: list[str]) -> list[int]:
    """The fingerprints of all runs, each once."""
    return np.unique(runs_of(tokens)[0]).tolist()


def _rule_tokens(block: list[str]) -> int:
    """Tokens of a block of classes in the worded rule that is used often and covers most; 0 if none is used often."""
    if len(block) < RULE_USES * RULE_LENGTH:
        return 0
    classes: dict[str, int] = {}
    sequence = [classes.setdefault(c, len(classes)) for c in block]
    if max(Counter(_grams(sequence, RULE_LENGTH)).values()) < RULE_USES:
        return 0
    rules, rest, first = repair(sequence)
    uses, length = rule_uses(rules, rest, first)
    worded = [c not in ("v", "N", "S") and (c[0].isalpha() or c[0] == "_") for c in classes] + [False] * len(rules)
    most = 0
    for r, (a, b) in enumerate(rules):
        s = first + r
        worded[s] = worded[a] or worded[b]
        if uses[s] >= RULE_USES and length[s] >= RULE_LENGTH and worded[s]:
            most = max(most, uses[s] * length[s])
    return most


def shared_tokens(one: list[str], other: list[str]) -> int:
    """Tokens of the first text that stand in runs of at least SHARED_TOKENS tokens which the other has too."""
    there = set(zip(*[other[k:] for k in range(SHARED_TOKENS)]))
    total = end = 0
    for i, run in enumerate(zip(*[one[k:] for k in range(SHARED_TOKENS)])):
        if run in there:
            total += i + SHARED_TOKENS - max(end, i)
            end = i + SHARED_TOKENS
    return total


def tokenise(body: str, c_like: bool) -> tuple[list[tuple[str, str]], list[str]]:
    """(kind, token) of the code, and the comments."""
    code: list[tuple[str, str]] = []
    comments: list[str] = []
    for found in (_SLASH_TOKEN if c_like else _HASH_TOKEN).finditer(body.replace("\r\n", "\n").replace("\r", "\n")):
        if found.lastgroup == "comment":
            comments.append(found.group())
        else:
            code.append((found.lastgroup, found.group()))
    return code, comments


def examine(body: str, c_like: bool, own: tuple[str, ...] = ()) -> tuple[set[str], list[int]]:
    """(signs, fingerprints) of one body."""
    code, comments = tokenise(body, c_like)
    signs: set[str] = set()
    for comment in comments:
        plain = "\n".join(x for x in comment.split("\n") if not any(o.lower() in x.lower() for o in own))
        if NOTICE.search(plain) or _HOLDER.search(plain):
            signs.add("notice")
    classes = [_class(k, t) for k, t in code]
    n_words, n_short = sum(k == "word" for k, _ in code), sum(k == "word" and c == "v" for (k, _), c in zip(code, classes))
    if len(code) >= SHORT_TOKENS and n_words and n_short >= SHORT_SHARE * n_words:
        signs.add("minified")
    if is_data(code):
        signs.add("data")
    if code and sum(map(_rule_tokens, blocks(classes))) >= RULE_SHARE * len(code):
        signs.add("generated")
    return signs, fingerprints([t for _, t in code])


def _expand(rules: list[tuple[int, int]], first: int, symbol: int, spelled: list[str]) -> list[str]:
    out, todo = [], [symbol]
    while todo:
        s = todo.pop()
        if s < first:
            out.append(spelled[s])
        else:
            todo.extend(reversed(rules[s - first]))
    return out


_EVIDENCE = "file_path string, repo string, row long, signs array<string>, prints array<long>, whole binary"


def file_signs(df: DataFrame, file_path: str = "file_path", body: str = "body", own: tuple[str, ...] = ()) -> DataFrame:
    """file_path, sign (``path``, ``notice``, ``generated``, ``minified``, ``data``, ``shared``), each once per file.

    own: names of the code base's owners as its copyright notices give them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
        names = [x.split()[0] for x in _EVIDENCE.split(", ")]
        for batch in batches:
            rows = []
            for path, code, row in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                c_like = _C_LIKE.search(path) is not None
                signs, prints = examine(code, c_like, own) if code else (set(), [])
                if PATH_SIGN.search(path):
                    signs.add("path")
                if signs or prints:
                    rows.append((path, path.split("/", 1)[0], row, sorted(signs), prints, hashlib.blake2b(f"{c_like}{code}".encode("utf-8", "surrogatepass"), digest_size=16).digest() if prints else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names=names)

    source = df.select(F.col(file_path).alias("file_path"), F.col(body).alias("body")).filter(F.col("file_path").isNotNull())
    source = source.withColumn("row", F.xxhash64("file_path", "body"))
    seen = cut(source.select("file_path", "body", "row").mapInArrow(run, _EVIDENCE))
    single = seen.select("file_path", F.explode("signs").alias("sign"))
    shared = seen.select("row", "file_path").join(_copied(source, seen), "row").select("file_path", F.lit("shared").alias("sign"))
    return single.unionByName(shared).distinct()


def _in_two(df: DataFrame, key: str) -> DataFrame:
    """Keys that stand in two repositories; combined in the tasks, so a hot one stays small."""
    return df.groupBy(key).agg(F.min("repo").alias("low"), F.max("repo").alias("high")).filter("low <> high").select(key)


def _copied(source: DataFrame, seen: DataFrame) -> DataFrame:
    """row of the bodies that have a run of SHARED_TOKENS tokens in common with any of another repository.

    Bodies that stand whole in two repositories are told by that; of all bodies only those runs are counted that may be shared by the others.
    """
    held = seen.filter(F.size("prints") > 0)
    whole = held.select("repo", "row", "whole")
    copies = cut(join_spread(whole, _in_two(whole, "whole"), "whole", "row").select("row").distinct())
    prints = held.select("repo", "row", F.explode("prints").alias("print"))
    others = prints.join(copies, "row", "left_anti").select("print").distinct()
    needed = cut(_in_two(prints, "print").join(others, "print", "left_semi"))
    if needed.isEmpty():
        return copies
    wanted = cut(join_spread(prints, needed, "print", "row").groupBy("row").agg(F.collect_set("print").alias("prints")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = pa.list_(pa.int64())
        for batch in batches:
            found = []
            for row, path, code, some in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                least, runs = runs_of([t for _, t in tokenise(code, _C_LIKE.search(path) is not None)[0]])
                may = np.isin(least, np.array(some, np.int64))
                runs, at = np.unique(runs[may], return_index=True)
                found.append((row, path.split("/", 1)[0], least[may][at], runs))
            columns = [pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 4, (pa.int64(), pa.string(), numbers, numbers))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "repo", "print", "run"])

    # a run is told by both numbers, so two that differ would have to agree in their fingerprint as well
    found = cut(source.join(wanted, "row").select("row", "file_path", "body", "prints").mapInArrow(run, "row long, repo string, print array<long>, run array<long>"))
    runs = found.select("repo", "row", F.explode(F.arrays_zip("print", "run")).alias("run"))
    shared = join_spread(runs.join(copies, "row", "left_anti").select("row", "run"), _in_two(runs, "run"), "run", "row")
    return copies.union(shared.select("row")).distinct()


def hand_written(df: DataFrame, file_path: str = "file_path", body: str = "body", own: tuple[str, ...] = ()) -> DataFrame:
    """The rows of df whose file has no sign."""
    marked = file_signs(df, file_path, body, own).select("file_path").distinct().withColumnRenamed("file_path", file_path)
    return df.join(marked, file_path, "left_anti")
