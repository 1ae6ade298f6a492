"""Island grammars: definitions of Python, JavaScript, TypeScript, C and C++ sources.

One scanner per family parses documentation, annotations, signatures and balanced bodies; all other code is
water and skipped. What stands in comments or strings is no code. Python members nest by indentation; in
brace languages a member ends with its body or, where a brace is missing, before the next definition that
isn't indented deeper.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass


@dataclass
class Member:
    """A definition: its name with outer functions, documentation as written, and its lines (from 1).

    qualified also has the classes and namespaces around it.
    """

    name: str
    doc: str
    signature: str
    line: int
    qualified: str = ""
    end_line: int = 0


# Suffixes and language names to the island grammar that reads them.
GRAMMARS = {
    "py": "python", "pyi": "python", "python": "python",
    "js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "ts": "script", "tsx": "script", "javascript": "script", "typescript": "script",
    "c": "c", "cc": "c", "cpp": "c", "cxx": "c", "h": "c", "hh": "c", "hpp": "c", "hxx": "c", "c++": "c",
}


def grammar_of(file_path: str | None, language: str | None) -> str | None:
    """The grammar of a file, by suffix, else by language; None if neither is known."""
    suffix = (file_path or "").rpartition("/")[2].rpartition(".")[2].lower()
    return GRAMMARS.get(suffix) or GRAMMARS.get((language or "").strip().lower())


_PY_TOKEN = re.compile(
    r"""(?P<comment>\#[^\n]*)
      | (?P<prefix>\b[rRuUbBfFtT]{1,2}(?=['"]))?(?P<quote>\"\"\"|'''|"|')
      | (?P<word>[^\W\d]\w*)
      | (?P<open>[(\[{]) | (?P<close>[)\]}])
      | (?P<line>\n) | (?P<join>\\\n) | (?P<colon>:) | (?P<other>[^\s])""",
    re.X,
)


def _py_string_end(text: str, at: int, quote: str) -> int:
    """Where the string that opened before at ends; one that never ends ends with its line."""
    if len(quote) == 3:
        found = re.compile(r"(?:[^\\]|\\.)*?" + quote, re.S).match(text, at)
        if found:
            return found.end()
    else:
        found = re.compile(rf"(?:[^\\\n{quote}]|\\.)*{quote}", re.S).match(text, at)
        if found:
            return found.end()
    stop = text.find("\n", at)
    return len(text) if stop < 0 else stop


def _width(indent: str) -> int:
    return len(indent.expandtabs(8))


def python_members(text: str) -> list[Member]:
    """Definitions of a Python source with docstrings and comments directly above."""
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    # tokens by kind; the first token of each physical line tells what the line is
    tokens: list[tuple[str, str, int, int, str]] = []
    at, depth, row = 0, 0, 0
    kind_of: dict[int, str] = {}
    while at < len(text):
        found = _PY_TOKEN.search(text, at)
        if not found:
            break
        begin, at = found.start(), found.end()
        kind = found.lastgroup or "other"
        while row + 1 < len(starts) and starts[row + 1] <= begin:
            row += 1
        prefix = ""
        if found.group("quote"):
            kind, prefix = "string", (found.group("prefix") or "").lower()
            at = _py_string_end(text, at, found.group("quote"))
        elif kind == "open":
            depth += 1
        elif kind == "close":
            depth = max(0, depth - 1)
        if kind == "word" and found.group() in ("def", "async") and not text[starts[row] : begin].strip():
            depth = 0  # a definition starts a line: what was left open before it was cut
        if kind not in ("line", "join"):
            kind_of.setdefault(row, "comment" if kind == "comment" and not depth else "decorator" if found.group() == "@" and not depth else "code")
            if kind == "string":
                last = row + text.count("\n", begin, at)
                for r in range(row + 1, last + 1):
                    kind_of.setdefault(r, "text")
        tokens.append((kind, found.group(), begin, at, prefix))
    row_of = lambda pos: _bisect(starts, pos)
    members: list[Member] = []
    stack: list[tuple[int, str, bool]] = []
    i = 0
    while i < len(tokens):
        kind, word, begin, end, _ = tokens[i]
        row = row_of(begin)
        lead = text[starts[row] : begin]
        if kind == "word" and word in ("def", "class", "async") and not lead.strip():
            j = i + 1
            if word == "async":
                if j >= len(tokens) or tokens[j][1] != "def":
                    i += 1
                    continue
                j += 1
            if j >= len(tokens) or tokens[j][0] != "word":
                i += 1
                continue
            name, is_def = tokens[j][1], word != "class"
            j += 1
            depth, whole = 0, False
            while j < len(tokens):
                k, w = tokens[j][0], tokens[j][1]
                if k == "open":
                    depth += 1
                elif k == "close":
                    depth -= 1
                elif k == "colon" and depth <= 0:
                    whole = True
                    break
                elif k == "line" and depth <= 0:
                    break
                elif k == "word" and w == "def" and not text[starts[row_of(tokens[j][2])] : tokens[j][2]].strip():
                    break
                j += 1
            if not whole:
                i += 1
                continue
            indent = _width(lead)
            while stack and stack[-1][0] >= indent:
                stack.pop()
            outer = [n for _, n, function in stack if function]
            around = [n for _, n, _ in stack]
            stack.append((indent, name, is_def))
            if is_def:
                doc = _docstring(text, tokens, j + 1)
                above = _py_above(lines, kind_of, row)
                end = _py_end(lines, kind_of, row_of(tokens[j][2]), indent)
                members.append(Member(".".join([*outer, name]), "\n".join(x for x in (doc, above) if x), text[begin : tokens[j][2]], row + 1, ".".join([*around, name]), end + 1))
            i = j + 1
            continue
        i += 1
    return members


def _bisect(starts: list[int], pos: int) -> int:
    return bisect_right(starts, pos) - 1


def _py_end(lines: list[str], kind_of: dict[int, str], row: int, indent: int) -> int:
    """Last row with code that is indented deeper than the definition."""
    last = row
    for r in range(row + 1, len(lines)):
        kind = kind_of.get(r)
        if kind == "text":
            last = r
        elif kind in ("code", "decorator"):
            if _width(lines[r][: len(lines[r]) - len(lines[r].lstrip())]) <= indent and not lines[r].lstrip().startswith((")", "]", "}")):
                break
            last = r
    return last


def _docstring(text: str, tokens: list[tuple[str, str, int, int, str]], i: int) -> str:
    wrapped = 0
    while i < len(tokens) and (tokens[i][0] in ("line", "comment", "join") or tokens[i][1] == "("):
        wrapped += tokens[i][1] == "("
        i += 1
    parts = []
    while i < len(tokens) and (tokens[i][0] in ("string", "join") or wrapped and (tokens[i][0] in ("line", "comment") or tokens[i][1] == ")")):
        kind, _, begin, end, prefix = tokens[i]
        wrapped -= tokens[i][1] == ")"
        if kind == "string":
            if "b" in prefix or "f" in prefix or "t" in prefix:
                return ""
            raw = text[begin + len(prefix) : end]
            size = 3 if raw[:3] in ('"""', "'''") else 1
            parts.append(raw[size : -size if len(raw) >= 2 * size and raw.endswith(raw[:size]) else None])
        i += 1
    if wrapped or i < len(tokens) and tokens[i][0] in ("other", "word", "open", "colon") and tokens[i][1] != ";":
        return ""  # part of an expression
    return "\n".join(parts)


def _py_above(lines: list[str], kind_of: dict[int, str], row: int) -> str:
    found: list[str] = []
    r = row - 1
    while r >= 0 and lines[r].strip():
        if kind_of.get(r) == "comment":
            found.append(lines[r].strip().lstrip("#!").strip())
        elif kind_of.get(r) == "decorator":
            pass
        else:
            # the rest of a decorator that spans lines
            top = r
            deep = 0  # brackets that close below top; blank lines may stand within
            while top >= 0 and (lines[top].strip() or deep > 0) and kind_of.get(top) not in ("decorator", "comment"):
                deep += sum(lines[top].count(x) for x in ")]") - sum(lines[top].count(x) for x in "([")
                top -= 1
            piece = "\n".join(lines[max(top, 0) : r + 1])
            if top < 0 or kind_of.get(top) != "decorator" or piece.count("(") + piece.count("[") != piece.count(")") + piece.count("]") or "(" not in lines[top]:
                break
            r = top
        r -= 1
    return "\n".join(reversed(found))


_C_TOKEN = re.compile(
    r"""(?P<block>/\*.*?(?:\*/|\Z)) | (?P<slash>//[^\n]*)
      | (?P<raw>\bR"(?P<mark>[^\s()\\]{0,16})\(.*?\)(?P=mark)")
      | (?P<quote>"(?:[^"\\\n]|\\.)*"? | '(?:[^'\\\n]|\\.)*'?)
      | (?P<template>`(?:[^`\\]|\\.)*(?:`|\Z))
      | (?P<word>[^\W\d][\w$]*|\$[\w$]*|\#[A-Za-z_]\w*)
      | (?P<arrow>=>|->) | (?P<scope>::)
      | (?P<line>\n) | (?P<number>\d[\w.']*) | (?P<other>[^\s])""",
    re.X | re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
# Words before a parenthesis that start no definition, and words that may stand before a name.
_CONTROL = frozenset("if for while switch catch return throw new delete typeof sizeof await yield else do case with super this import in of instanceof static_assert alignof decltype function assert".split())
# Words of C and C++ whose parenthesis belongs to a declaration but starts no parameters.
_SPECIFIERS = frozenset("__attribute__ __declspec decltype alignas noexcept explicit requires".split())
_ACCESS = frozenset("public private protected signals".split())
_SCRIPT_LEAD = frozenset("export default async static public private protected readonly override abstract declare get set function const let var".split())


def _skip_group(tokens: list, i: int) -> int:
    """Index after the group that opens at i (round, square, brace), or -1 if it never closes."""
    pairs = {"(": ")", "[": "]", "{": "}"}
    stack = []
    while i < len(tokens):
        w = tokens[i][1]
        if tokens[i][0] == "other" and w in pairs:
            stack.append(pairs[w])
        elif tokens[i][0] == "other" and w in ")]}":
            if not stack or stack[-1] != w:
                return -1
            stack.pop()
            if not stack:
                return i + 1
        i += 1
    return -1


def brace_members(text: str, script: bool) -> list[Member]:
    """Definitions of a JavaScript or TypeScript (script) or C or C++ source with the comments directly above."""
    tokens: list[tuple[str, str, int]] = []  # without comments and lines
    comments: dict[int, tuple[int, str, bool]] = {}  # last row of a comment -> first row, text, stands alone
    lines = text.split("\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    at = 0
    while at < len(text):
        found = _C_TOKEN.search(text, at)
        if not found:
            break
        begin, at, kind = found.start(), found.end(), found.lastgroup
        if kind == "mark":
            kind = "raw"
        if kind in ("block", "slash"):
            first, last = _bisect(starts, begin), _bisect(starts, max(begin, at - 1))
            alone = not text[starts[first] : begin].strip() and not text[at : starts[last + 1] - 1 if last + 1 < len(starts) else len(text)].strip()
            comments[last] = (first, found.group(), alone)
            continue
        if kind == "line":
            continue
        if script and found.group() == "/" and (not tokens or tokens[-1][1] in ("(", ",", "=", ":", "[", "!", "&", "|", "?", "{", "}", ";", "return", "=>")):
            if regex := _REGEX.match(text, begin):
                tokens.append(("quote", "/re/", begin))
                at = regex.end()
                continue
        if not script and found.group() == "#" and not text[starts[_bisect(starts, begin)] : begin].strip() or (not script and kind == "word" and found.group()[0] == "#"):
            stop = text.find("\n", begin)
            while stop > 0 and text[stop - 1] == "\\":
                stop = text.find("\n", stop + 1)
            row = _bisect(starts, begin)
            comments.setdefault(row, (row, "", True))
            at = len(text) if stop < 0 else stop
            continue
        tokens.append((kind, found.group(), begin))
    members: list[Member] = []
    stack: list[tuple[int, str, int, int]] = []  # brace depth inside, name, indent, index of the member or -1 for a class
    depth, i, begin_statement = 0, 0, 0
    barred = -1  # the statement whose start lets no definition follow, so that a long one is looked at once
    while i < len(tokens):
        kind, word, pos = tokens[i]
        if kind == "other" and word == "{":
            depth += 1
            if scope := _scope_name(tokens, begin_statement, i):
                row = _bisect(starts, tokens[begin_statement][2])
                stack.append((depth, scope, _width(lines[row][: len(lines[row]) - len(lines[row].lstrip())]), -1))
            i += 1
            begin_statement = i
            continue
        if kind == "other" and word == "}":
            depth -= 1
            while stack and depth < stack[-1][0]:
                _close(members, stack.pop(), _bisect(starts, pos))
            i += 1
            begin_statement = i
            continue
        if kind == "other" and word in ";,":
            i += 1
            if word == ";" or script:
                begin_statement = i
            continue
        if not script and i == begin_statement and word in _ACCESS and i + 1 < len(tokens) and tokens[i + 1][1] == ":":
            i += 2
            begin_statement = i
            continue
        if not script and i == begin_statement and word == "template" and i + 1 < len(tokens) and tokens[i + 1][1] == "<" and (after := _after_angles(tokens, i + 1)) < len(tokens):
            i = after  # no name stands in the parameters
            continue
        row = _bisect(starts, pos)
        fresh = i > 0 and begin_statement < i and script and row > _bisect(starts, tokens[i - 1][2]) and tokens[i - 1][1] not in ("=", "(", "=>", "default", "async", "export", "function")
        if fresh:
            begin_statement = i  # a line without semicolon ended
        found = None
        if kind == "word" and barred != begin_statement:
            owner = stack[-1][1] if stack and stack[-1][3] < 0 and stack[-1][0] == depth else None
            found = _definition(tokens, begin_statement, i, script, owner)
            if found is False:
                barred = begin_statement
        if found:
            name, brace = found
            first = tokens[begin_statement][2]
            row = _bisect(starts, first)
            indent = _width(lines[row][: len(lines[row]) - len(lines[row].lstrip())])
            while stack and indent <= stack[-1][2] and stack[-1][3] >= 0:
                depth = min(depth, stack[-1][0] - 1)
                _close(members, stack.pop(), row - 1)
            rows = [row, *sorted({_bisect(starts, t[2]) for t in tokens[begin_statement : i + 1]} - {row}, reverse=True)]  # a macro or decorator over lines may stand before
            doc = next((d for r in rows if (d := _brace_above(lines, comments, r))), "")
            end = tokens[brace][2] if brace < len(tokens) else len(text)
            outer = [n for _, n, _, member in stack if member >= 0]
            around = [n for _, n, _, _ in stack] + _owners(tokens, begin_statement, i)
            members.append(Member(".".join([*outer, name]), doc, text[first:end].strip(), row + 1, ".".join([*around, name]), len(lines)))
            stack.append((depth + 1, name, indent, len(members) - 1))
            i = brace
            continue
        i += 1
    return members


def _close(members: list[Member], entry: tuple[int, str, int, int], row: int) -> None:
    if entry[3] >= 0:
        members[entry[3]].end_line = row + 1


def _scope_name(tokens: list, begin: int, brace: int) -> str | None:
    """The name of the class, struct or namespace whose body opens at brace."""
    for j in range(begin, min(brace, begin + 8)):
        if tokens[j][1] in ("class", "struct", "namespace", "interface"):
            if any(t[1] in ("(", "=") for t in tokens[j:brace]):
                return None
            return tokens[j + 1][1] if j + 1 < brace and tokens[j + 1][0] == "word" else None
        if tokens[j][1] not in ("export", "default", "abstract", "template", "<", ">", "typename", "inline", "public", "private", "declare", "const") and tokens[j][0] != "word":
            return None
    return None


def _owners(tokens: list, begin: int, i: int) -> list[str]:
    """A, B of a name that is spelled A::B::name."""
    out: list[str] = []
    while i - 2 >= begin and tokens[i - 1][1] == "::" and tokens[i - 2][0] == "word":
        out.insert(0, tokens[i - 2][1])
        i -= 2
    return out


def _definition(tokens: list, begin: int, i: int, script: bool, owner: str | None = None) -> tuple[str, int] | bool | None:
    """(name, index of the body's brace) if token i is the name of a function definition of the statement at begin; False if no later token can be.

    owner: the class whose body the statement stands in, after which constructors are named.
    """
    kind, word, _ = tokens[i]
    if kind != "word" or word in _CONTROL or i + 1 >= len(tokens):
        return None
    nxt = tokens[i + 1][1]
    if script:
        starts = nxt in ("=", ":", "<", "(")
    else:
        starts = nxt == "(" or word == "operator" or nxt == "<" and [t[1] for t in tokens[begin : begin + 3]] == ["template", "<", ">"] or nxt == "=" and i + 2 < len(tokens) and tokens[i + 2][1] == "["
    if not starts:
        return None
    lead = tokens[begin:i]
    if script:
        while lead and lead[0][1] == "@":  # decorators
            skip = 2
            while skip < len(lead) and lead[skip][1] == ".":
                skip += 2
            if skip < len(lead) and lead[skip][1] == "(":
                after = _skip_group(lead, skip)
                if after < 0:
                    return None
                skip = after
            lead = lead[skip:]
        words = [t[1] for t in lead]
        member = nxt == "=" and len(lead) > 1 and all(t[1] == "." if k % 2 else t[0] == "word" for k, t in enumerate(lead)) and len(lead) % 2 == 0  # a.b.name = ...
        if not member and any(w not in _SCRIPT_LEAD and w not in ("*", "#") for w in words):
            return False
        if nxt in ("=", ":"):
            if "function" in words:
                return None
            if member and word == "exports":  # module.exports = function name
                k = i + 3 if i + 2 < len(tokens) and tokens[i + 2][1] == "async" else i + 2
                named = k + 2 < len(tokens) and tokens[k][1] == "function" and tokens[k + 1][0] == "word"
                return _script_body(tokens, k + 2, tokens[k + 1][1], arrow=False) if named else None
            j = i + 2
            if nxt == ":" and words and words[-1] in ("const", "let", "var"):  # a type before the value
                while j < len(tokens) and tokens[j][1] not in ("=", ";", "{"):
                    j += 1
                if j >= len(tokens) or tokens[j][1] != "=":
                    return None
                j += 1
            if j < len(tokens) and tokens[j][1] == "async":
                j += 1
            if j < len(tokens) and tokens[j][1] == "function":
                j += 1
                if j < len(tokens) and tokens[j][1] == "*":
                    j += 1
                if j < len(tokens) and tokens[j][0] == "word":
                    j += 1
                return _script_body(tokens, j, word, arrow=False)
            if j < len(tokens) and tokens[j][1] == "<":  # type parameters
                j = _after_angles(tokens, j)
            return _script_body(tokens, j, word, arrow=True)
        if nxt == "<":
            j = i + 1
            while j < len(tokens) and tokens[j][1] not in ("(", "{", ";"):
                j += 1
            return _script_body(tokens, j, word, arrow=False) if j < len(tokens) and tokens[j][1] == "(" else None
        if nxt == "(" and not (words and words[-1] in ("const", "let", "var")):
            return _script_body(tokens, i + 1, word, arrow=False)
        return None
    # C and C++
    if nxt == "=" and i + 2 < len(tokens) and tokens[i + 2][1] == "[" and lead and (lead[-1][1] in ("auto", "&", "const") or lead[-1][1] == ">" and any(t[1] == "function" for t in lead)):
        j = _skip_group(tokens, i + 2)
        if j > 0 and j < len(tokens) and tokens[j][1] == "(":
            j = _skip_group(tokens, j)
        while 0 < j < len(tokens) and tokens[j][1] not in ("{", ";"):
            j += 1
        return (word, j) if 0 < j < len(tokens) and tokens[j][1] == "{" else None
    lead = _without_template(lead)
    if any(t[1] in ("=", "(", "return", "<<", "throw", "new", "else", ".", "?", "operator") or t[0] in ("quote", "raw", "number", "arrow") for t in lead):
        return False
    opens = i + 1
    if word == "operator":
        opens += 2 if [t[1] for t in tokens[i + 1 : i + 4]] == ["(", ")", "("] else 0
        while opens < min(len(tokens), i + 12) and (tokens[opens][1] != "(" or opens == i + 1):
            opens += 1
        word += (" " if tokens[i + 1][0] == "word" else "") + "".join(t[1] for t in tokens[i + 1 : opens])
    elif nxt == "<":  # a specialisation
        opens = _after_angles(tokens, i + 1)
    if opens >= len(tokens) or tokens[opens][1] != "(" or word in _SPECIFIERS:
        return None
    plain = [t for t in lead if t[1] not in ("::", "~", "inline", "static", "virtual", "explicit", "constexpr")]
    if word == owner or word.startswith("operator") and word != "operator":
        plain = plain or [tokens[i]]
    if not plain and not any(t[1] == "::" for t in lead) and depth_of_statement_is_call(tokens, i):
        return None
    if lead and lead[-1][1] == "~":
        word = "~" + word
    j = _skip_group(tokens, opens)
    if j < 0:
        return None
    while j < len(tokens) and tokens[j][1] not in ("{", ";", "=", "}", ")"):
        if tokens[j][1] == "(":
            j = _skip_group(tokens, j)
            if j < 0:
                return None
            continue
        if tokens[j][1] == ":":  # constructor's initialisers
            while j < len(tokens) and tokens[j][1] not in ("{", ";"):
                if tokens[j][1] == "(":
                    j = _skip_group(tokens, j)
                    if j < 0:
                        return None
                    continue
                j += 1
            break
        j += 1
    if j >= len(tokens):
        return word, j  # cut off behind the signature
    return (word, j) if tokens[j][1] == "{" and plain or tokens[j][1] == "{" and any(t[1] == "::" for t in lead) else None


def depth_of_statement_is_call(tokens: list, i: int) -> bool:
    """True if name ( ... ) at i isn't followed by a body, as in a call."""
    j = _skip_group(tokens, i + 1)
    return j < 0 or j >= len(tokens) or tokens[j][1] != "{"


def _after_angles(tokens: list, i: int) -> int:
    """Index after the angle brackets that open at i; the number of tokens if they never close."""
    level = 0
    while i < len(tokens) and tokens[i][1] not in (";", "{"):
        level += (tokens[i][1] == "<") - (tokens[i][1] == ">")
        i += 1
        if level == 0:
            return i
    return len(tokens)


def _without_template(lead: list) -> list:
    """The tokens before a name without template parameter lists, attributes and language of linkage."""
    out, i = [], 0
    while i < len(lead):
        if lead[i][1] in _SPECIFIERS and i + 1 < len(lead) and lead[i + 1][1] == "(" and (after := _skip_group(lead, i + 1)) > 0:
            out += [lead[i]] * (lead[i][1] == "decltype")
            i = after
            continue
        if lead[i][1] == "extern" and i + 1 < len(lead) and lead[i + 1][0] == "quote":
            i += 2
            continue
        if lead[i][1] == "template" and i + 1 < len(lead) and lead[i + 1][1] == "<":
            level, i = 0, i + 1
            while i < len(lead):
                level += (lead[i][1] == "<") - (lead[i][1] == ">")
                i += 1
                if level == 0:
                    break
            continue
        out.append(lead[i])
        i += 1
    return out


def _script_body(tokens: list, j: int, name: str, arrow: bool) -> tuple[str, int] | None:
    if j < len(tokens) and tokens[j][0] == "word" and arrow:  # one bare parameter
        j += 1
    elif j < len(tokens) and tokens[j][1] == "(":
        j = _skip_group(tokens, j)
        if j < 0:
            return None
    else:
        return None
    if j < len(tokens) and tokens[j][1] == ":":  # the type of the result
        j += 1
        level = 0
        while j < len(tokens) and not (level == 0 and tokens[j][1] in ("{", "=>", ";", ",")):
            level += (tokens[j][1] in "(<[") - (tokens[j][1] in ")>]") if tokens[j][0] == "other" else 0
            j += 1
    if arrow:
        if j >= len(tokens) or tokens[j][1] != "=>":
            return None
        return name, j + 1
    if j >= len(tokens):
        return name, j
    return (name, j) if tokens[j][1] == "{" else None


def _plain_comment(comment: str) -> str:
    if comment.startswith("//"):
        return comment.lstrip("/!").strip()
    body = re.sub(r"^/\*+!?|\*+/$", "", comment, flags=re.S)
    return "\n".join(re.sub(r"^\s*\*+(?=\s|$|@|\\)", "", x).rstrip() for x in body.split("\n")).strip("\n")


def _brace_above(lines: list[str], comments: dict[int, tuple[int, str, bool]], row: int) -> str:
    """Comments on the lines directly above row, through template lines, attributes and decorators."""
    found: list[str] = []
    r = row - 1
    while r >= 0:
        if r in comments and comments[r][2]:
            first, text, _ = comments[r]
            found.append(_plain_comment(text))
            r = first - 1
        elif re.match(r"\s*(?:template\s*<.*>|\[\[.*\]\]|@[\w.]+(?:\(.*\))?|#\w.*|export|static|inline|extern \"C\")\s*$", lines[r]):
            r -= 1
        else:
            break
    return "\n".join(reversed(found))


def members_of(body: str, grammar: str) -> list[Member]:
    """Definitions of a source in order; line ends of any kind count as one."""
    text = body.replace("\r\n", "\n").replace("\r", "\n")
    return python_members(text) if grammar == "python" else brace_members(text, grammar == "script")
