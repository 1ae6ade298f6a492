"""Functions paired with their documentation, by island grammars.

Per language one scanner parses documentation, annotations, signatures and balanced bodies; all other code
is water and skipped. What stands in comments or strings is no code. Python members nest by indentation;
in brace languages a member ends with its body or, where a brace is missing, before the next definition
that isn't indented deeper.

Defined results: null or empty bodies give no pair; several members of one name in a body give one pair per
place; a body that is cut off keeps the members whose signature is whole; a string that never ends ends
with its line; documentation is returned without comment signs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veinstone.functions.islands import Member, grammar_of, members_of


# Tool directives, notices of files, stock words and pointers that are no description.
_DIRECTIVE = re.compile(
    r"^[@\s*]*(?:noqa\b|type:\s*ignore|pylint:|flake8:|mypy:|ruff:|pyright:|fmt:|yapf:|isort:|pragma\b|nosec\b|eslint|jshint|jslint|tslint:|prettier-|@?ts-(?:ignore|nocheck|expect-error|check)|istanbul\b|c8\s+ignore|v8\s+ignore|webpack|@flow\b|"
    r"clang-(?:format|tidy)|nolint\w*|cppcheck-|coverity|lcov_|gcov|iwyu|-\*-|vim?:|coding[:=]|!/|#?region\b|#?endregion\b|sourcemappingurl|biome-|deno-lint|noinspection|codespell|spell-?checker|cspell)",
    re.I,
)
_NOTICE = re.compile(
    r"""all\ rights\ reserved | spdx-license | @licen[sc]e | permission\ is\ hereby | \(c\)\ \d{4} | copyright\W+(?:\(c\)|©|\d{4}) | do\ not\ edit\b | do\ not\ modify\ by\ hand | mode:\ generated | changes\ made\ here\ are\ lost
  | ^\W*(?:(?:this|the)\ (?:\w+\ )?(?:file|code|module|source|header|script|function|class)\ (?:is|was|has\ been)\ |(?:for\ |code\ |file\ )|[\w.-]+\.\w+\W+)?
    (?:copyright\b(?!\ (?:line|notice|header|year|text|check|holder)s?\b)|internal\ use\ only|licen[sc]ed?\ under|released\ under\ the|auto-?generated\b(?!\ (?:key|id|name|column|row|value|field|code|part|test|number|label|token)s?\b)
      |code\ generated\ by|generated\ by|machine-written\ by|created\ automatically\ from|(?:a\ )?bundled\ copy\ of|copied\ without\ changes|imported\ from\ the|local\ patches:|small\ footprint\ edition)
  | ^upstream: | ^source:\ \w+\.\w+$ | ^author:""",
    re.I | re.X,
)
_TODO = re.compile(r"^\W*(?:(?:to-?do(?!\s+(?:items?|lists?|entry|entries|rows?|notes?)\b)|fixme|xxx+|tbd|tba|wip)\b|(?:hack|bug)\b(?=\s*(?:[^\w\s]|\d|$)))", re.I)
#: What may follow a to-do and still belongs to it.
_TODO_MORE = re.compile(r"^\W*(?:add|fix|write|describe|document|update|improve|clean|refactor|ask|needs?|should|must|maybe|please|pending|later|soon|not|to be)\b", re.I)
_STOCK = re.compile(
    r"""^\W*(?:
    (?:a\ |an\ |the\ |this\ |some\ |internal\ |private\ |simple\ |small\ |just\ (?:a\ )?|utility\ |generic\ )*(?:helper|internal|docs?|documentation|doc\ ?string|description|summary|comment|function|method|utility|placeholder|stub|wrapper|private|public|untitled|unknown|none|null|nil|nothing|empty|text|header|util|main|default|misc|self[- ]explanatory|obvious)s?(?:\ (?:function|method|routine|only|use|here|text|comment|string|goes\ here))*
  | (?:add|write|insert|enter|put|your|fill\ in|needs?|missing)\ (?:a\ |an\ |the\ |some\ |your\ |proper\ |more\ )*(?:docs?|documentation|description|doc\ ?string|comments?|text|summary)(?:\ (?:here|later|soon|please|this))*
  | no\ (?:\w+\ )?(?:description|documentation|docs?|comment|summary)(?:\ (?:available|given|provided|yet|needed|required|found))*
  | (?:description|documentation|docs?|summary)\ (?:is\ |are\ )?(?:missing|pending|to\ follow|follows|needed|unavailable|goes\ here|coming\ soon|not\ available|to\ be\ added)\b.*
  | (?:to\ be|not\ yet|yet\ to\ be|still\ to\ be)\ (?:\w+\ )?(?:documented|described|written|done|defined|added|completed)(?:\ later|\ soon)?
  | undocumented | n/?a | not\ applicable | see\ (?:code|source|below|above|elsewhere|name|title) | does\ (?:stuff|things|something|it) | magic | deprecated | foo | bar | test | lorem\ ipsum.* | wip | (?:i\ )?don'?t\ know
    )\W*$""",
    re.X | re.I,
)
# What a pointer names: a bare name or path, a place in the text, another document or the class above.
_PLACE = (
    r"(?:(?:the|its|a|our)\ )?(?:above|below|here|there|elsewhere|(?:(?:base|parent|super|sub|child|derived)[\ -]?)?class(?:es)?|base|parent|super|interface|docs?|documentation|wiki|manual|readme|spec(?:ification)?|source|code"
    r"|`[^`]+`|[\w-]+\(\)|\w+(?:(?:\.|::|/|\#)\w+)+(?:\(\))?|[^\W_]+(?:_\w+)+(?:\(\))?|(?-i:[A-Za-z]+[a-z0-9][A-Z]\w*)(?:\(\))?)"
)
_POINTER = re.compile(
    r"""^\W*(?:(?:please\ )?(?:see(?!\ (?:whether|if|that)\b)|refer\ to|cf\.?)(?:\ also)?\b(?:\W+[\w.#:/()`'-]+){0,6}|(?:please\ )?(?:compare|consult|check|overrid(?:es?|den))(?:\ (?:also|with|by|in|from|to))?"""
    rf"""(?:\ {_PLACE}(?:\ (?:and|or|in|of|for)\ {_PLACE})*)?"""
    r"""|(?:same|as|like|similar)\ (?:as|to|in|the)?\b(?:\W+[\w.#:/()`'-]+){0,4}|ditto|idem|(?:\{?@?)inherit(?:ed|s)?(?:-?doc)?\}?(?:\ (?:from|docs?)\b.*)?|(?:@|\\)(?:copydoc|see|link|inheritdoc|override|overrides)\b.*)\W*$""",
    re.I | re.X,
)
_TAG = re.compile(r"^\W*?(?:[@\\](?:param|arg|tparam|return|returns|throws?|exception|raises?|type|rtype|brief|details|note|since|author|version|private|public|async|override|internal|protected|static|function|method|class|memberof|name|template|export|constructor|deprecated|see|file|ingroup|pre|post|retval|yields?)\b|:(?:param|type|returns?|rtype|raises?|raise|arg|keyword|yields?|var|ivar)\b(?:\s+[\w.\[\], |]+?)?:)", re.I)
_TAG_NAME = re.compile(r"^[@\\](?:param|arg|tparam|throws?|exception|type|raises?|retval|name|template)\b(?:\s*\[[^\]]*\])?(?:\s*\{[^}]*\})?\s*\[?[\w.$*]*\]?(?:=[^\s\]]*\])?\s*[-:–]?\s*", re.I)
_SECTION = re.compile(r"^\W*(?:args?|arguments?|parameters?|params?|returns?|raises?|throws?|yields?|examples?|usage|notes?|see also|attributes?)\s*:?\s*[-=]*$", re.I)
_EXAMPLE = re.compile(r"^(\s*)\W*(?:@?examples?|usage|e\.g\.)\s*:?\s*$|^(\s*)(?:@example|\\code|```)", re.I)
_CODE = re.compile(
    r"""^\s*(?:
    (?:if|while|for|elif|switch|with|catch)\b.*[:{]\s*$ | (?:else|try|finally|do)\s*[:{]\s*$ | (?:return|throw|raise|yield|await|delete|break|continue|pass|del|goto)\b(?:\ .*[\[\](){}=;'"]+.*|\ ?\w*;?)$
  | (?:var|let|const|auto|int|double|float|bool|char|void|static|std::\w+|unsigned|long|string|size_t|public|private)\b[^.]*[=;({]\s*.*[;{)\],]$
  | [\w.\[\]'"->]+(?:\[[^\]]*\])?\s*(?:=|\+=|-=|\*=|/=|\|=|&=|:=|<<=|>>=)\s*\S.*
  | [\w.:>-]+\([^()]*(?:\([^()]*\)[^()]*)*\)\s*[;{]$ | [\w]+(?:(?:\.|->|::)\w+)+\(.*\)\s*;?$ | \w+\((?:[^()\s]|,\s)*\)$
  | [{}()\[\];]+ | .*[;{]\s*$ | \}.* | (?:import|from|using|include|require|export|def|class|function|async)\b.*[:;{)'">]$ | @\w+(?:\(.*\))?$ | <\/?\w+.*>$ | \#\s*\w+.*
    )\s*$""",
    re.X,
)
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
# Words that add nothing to the name of a function.
_EMPTY_WORDS = frozenset(
    "a an the this that these those is are was be will shall does do did to for of in on at by with from and or it its used use uses using function functions method methods"
    " routine procedure helper which we here simply just performs perform performing executes execute implements implement implementation handles handle called call calls given"
    " der die das ein eine einen funktion methode la le les un une el los las una funcion función fonction méthode metodo método que pour para".split()
)


def _stem(word: str) -> str:
    word = word.lower()
    for suffix in ("ing", "ies", "es", "ed", "er", "s", "e", "y"):
        if word.endswith(suffix) and len(word) - len(suffix) >= 2:
            return word[: -len(suffix)]
    return word


def name_words(name: str) -> set[str]:
    """Stems of the words of a snake or camel case name, and of the whole."""
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+", name)
    pieces = [p for x in name.split("_") for p in re.split(r"(?<=[a-z])(?=[A-Z])", x) if p]
    return {s for w in [*parts, *pieces, name, name.replace("_", "")] for s in (w.lower(), _stem(w))}


def described(doc: str, name: str) -> str:
    """What doc says beyond the name, bare tags, directives, to-dos, stock words, pointers and code; '' if trivial."""
    known = name_words(name)
    kept: list[str] = []
    example: int | None = None
    fenced = False
    for line in doc.split("\n"):
        text = line.strip()
        if fenced:
            fenced = not text.startswith("```")
            continue
        if not text:
            continue
        indent = len(line) - len(line.lstrip())
        if example is not None and (indent > example or text.startswith((">>>", "..."))):
            continue
        example = None
        if found := _EXAMPLE.match(line):
            example = indent
            fenced = text.startswith("```")
            continue
        if _DIRECTIVE.match(text) or _NOTICE.search(text) or _SECTION.match(text) or text.startswith(">>>"):
            continue
        if _TODO.match(text):  # only its own clause goes
            text = re.split(r"[.;!?]\s+(?=\w)", text, maxsplit=1)[1:]
            text = text[0] if text else ""
            if not text or _TODO.match(text) or _TODO_MORE.match(text):
                continue
        if tag := _TAG.match(text):
            text = _TAG_NAME.sub("", text.lstrip(" *"), count=1) if text.lstrip(" *")[:1] in "@\\" else text[tag.end() :]
            text = re.sub(r"^[@\\:]\w+:?\s*", "", text).strip()
            if not text:
                continue
        bare = re.sub(r"^[\s#*/!<>|=~_.-]+|[\s#*/|=~_-]+$", "", text)
        if not bare or _STOCK.match(bare) or _POINTER.match(bare) or _CODE.match(text):
            continue
        words = [w for w in _WORD.findall(bare) if not w.isdigit()]
        if any(w.lower() not in _EMPTY_WORDS and w.lower() not in known and _stem(w) not in known for w in words):
            kept.append(text)
    return "\n".join(kept)


def member_code(body: str, member: Member) -> str:
    """The lines of a member, from its signature to its end; line ends of any kind count as one."""
    lines = body.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return "\n".join(lines[member.line - 1 : max(member.end_line, member.line + member.signature.count("\n"))])


def documented_members(body: str | None, file_path: str | None, language: str | None) -> list[tuple[Member, str]]:
    """(member, description) of every member of a body whose documentation isn't trivial."""
    grammar = grammar_of(file_path, language)
    if not body or grammar is None:
        return []
    pairs = ((m, described(m.doc, m.name.rpartition(".")[2])) for m in members_of(body, grammar) if m.doc)
    return [(m, text) for m, text in pairs if text]


_PAIRS = "function_id string, member_name string, signature string, line int, doc string, description string, code string"


def doc_pairs(df: DataFrame, function_id: str = "function_id", body: str = "body", file_path: str = "file_path", language: str = "language") -> DataFrame:
    """One row per documented member: function_id, member_name, its signature, line, documentation, description and code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PAIRS.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        for batch in batches:
            rows = [
                (key, m.name, m.signature, m.line, m.doc, text, member_code(code, m))
                for key, code, path, lang in zip(*(batch.column(i).to_pylist() for i in range(4)))
                for m, text in documented_members(code, path, lang)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, types)], names=names)

    source = df.select(F.col(function_id).alias("function_id"), *[F.col(c) for c in (body, file_path, language)]).filter(F.col(body).isNotNull())
    return source.mapInArrow(run, _PAIRS)
