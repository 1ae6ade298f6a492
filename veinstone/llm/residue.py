"""Template residue, filler and error pages in a corpus of texts.

Slots are induced by alignment. One pass over the texts masks code and quoted words, cuts sentences and finds
what may stand in a slot: expressions in delimiters, default values, and blanks where a value should be. Each
has a frame: the words beside it up to the next such place. Over the corpus, the records of a frame are
aligned: a frame that holds different expressions in different records has a slot, one that always holds the
same (``from <stdin> if``) hasn't. Frames that expressions alone don't decide are looked up in all texts once
more (a string automaton over their left words, in blocks of bounded size), which gives the values that other
records hold there. From the slots come the names of variables and the styles of delimiters, which decide
frames that stand alone. A slot counts where it keeps a variable, a default where other records keep a variable
too, a blank where others have different values and never none.

Pages are reduced to the sentences that a reader sees. Sentences that repeat on pages with a notice, and hardly
elsewhere, are templates of error pages; a page made of them, or of a notice and mostly of them, is one. What
repeats nowhere is decided by the fixed patterns alone and named so (``slot_pattern``, ``page_pattern``).
Filler is found by paragraph.

Defined results: null or blank texts are no cases; texts that repeat get the same verdict; a text of any
length is read whole.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veinstone.session import broadcast_if_small, cut

#: Most words of a page (without tags, menus and titles) that a notice makes an error page by itself; of longer ones the corpus decides.
PAGE_WORDS = 60
#: Pages with a notice on which a sentence must stand to be part of a template.
PAGE_REPEATS = 2
#: Share of a sentence's pages that must have a notice, and of a page's sentences that must be part of templates.
TEMPLATE_SHARE = 0.8
#: Words on each side that make a frame; most characters of a value that other records hold in it.
FRAME_WORDS, VALUE_CHARS = 2, 60
#: Different values that other records must hold where a blank counts.
BLANK_VALUES = 3
#: Share of a style's expressions, among those in frames with several, that must stand in slots for it to decide frames that stand alone.
STYLE_SHARE = 0.8
#: Frames that one pass looks up; more are looked up in blocks of so many.
FRAME_BLOCK = 200_000

_FENCE = re.compile(r"^[ \t]*(```+|~~~+).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
_TICKS = re.compile(r"(`+)(?!`)((?:(?!\n\s*\n).)+?)(?<!`)\1(?!`)", re.S)
_QUOTED = re.compile(r'"[^"\n]*"|“[^”\n]*”|„[^“”\n]*[“”]|«\s[^»\n]*»|«[^»\n]*\s[^»\n]*»|(?<![\w\'])\'[^\'\n]*\'(?!\w)|‘[^’\n]*’(?!\w)')

# Template syntax that is nothing else outside of code; group name, if any, is the variable.
CERTAIN = re.compile(
    r"""
    \{\{\{?\s*(?P<a>[\w.-]{0,60})[^{}\n]{0,120}\}\}\}?
  | \{%-?\s*(?:\w+\s+)?(?P<b>[\w.-]{0,60})[^%\n]{0,120}%\}
  | <%[=-]?\s*(?P<c>[\w.-]{0,60})[^%\n]{0,120}%>
  | \$\{\s*(?P<d>[\w.-]{1,60})[^}\n]{0,120}\}
  | \#\{\s*(?P<e>[\w.-]{1,60})[^}\n]{0,120}\}
  | %\((?P<f>\w+)\)[sdrf]
  | %(?<![\w%]%)[sd](?!\w)
  | %(?<![\w%]%)(?P<g>[A-Z][A-Z_]{2,})%(?!\w)
  | @@\s*(?P<h>\w[\w -]{0,60})@@
  | <<\s*(?P<i>[A-Za-z][\w -]{0,60}?)\s*>>
  | <\s*(?:insert|enter|add)\s+(?P<j>[\w -]{1,60}?)(?:\s+here)?\s*>
  | <\s*your[ _-](?P<k>[\w -]{1,60}?)\s*>
  | \[\s*(?:tbd|todo|insert|enter|add|fill\ in|your)\b[\s:_-]*(?P<l>[\w -]{0,60}?)(?:\s+here)?\s*\]
  | \[\s*(?P<m>[\w -]{1,60}?)\s+goes\s+here\s*\]
  | \*\*\*\s*(?P<n>[\w -]{1,60}?)\s*\*\*\*\s*\(fill\ in\)
  | \[object\ Object\]
  | \{\d\}
    """,
    re.X | re.I,
)
# Syntax that may mean something else; only slots over the corpus make it count.
DOUBTFUL = re.compile(
    r"""
    \$(?P<a>[A-Za-z]\w*)\$
  | __(?<!\w__)(?P<b>[A-Za-z]\w*?)__(?!\w)
  | «(?P<c>[\w -]{1,60})»
  | &lt;\s*(?:your[ _-])?(?P<d>[\w -]{1,60}?)\s*&gt;
  | \[\[\s*(?P<e>[\w -]{1,60}?)\s*\]\]
  | \{(?P<f>[A-Za-z][\w -]{0,60})\}
  | \((?:enter|insert|fill\ in)\s+(?P<g>[\w -]{1,60}?)\)
  | <(?<![\w<]<)(?P<h>[A-Za-z][\w -]{0,60})>
  | \*\*\*(?<!\*\*\*\*)(?P<i>[\w -]{1,60}?)\*\*\*(?!\*)
    """,
    re.X,
)
_BLANK = re.compile(r"(?<=[A-Za-z])  +(?=[a-z(])|(?<=[A-Za-z]) (?=[,.;](?:\s|$))|\(\s*\)")

# Values that stand for none.
_DEFAULT = re.compile(r"(?<![\w./-])(?:undefined|null|NaN|N/A|n/a|TBD|TBA|XXX+|\?\?\?+|YYYY-MM-DD|MM/DD/YYYY|DD\.MM\.YYYY)(?![\w/-])")

# The vocabulary of Latin filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore"
    " magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute"
    " irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident"
    " sunt culpa qui officia deserunt mollit anim id est laborum massa nunc arcu ligula leo odio porta nibh mauris urna justo"
    " turpis felis augue erat vel vestibulum pellentesque tortor orci eros vitae mattis ac at nec a cras donec".split()
)
_LATIN_MARKS = frozenset(w for w in LATIN if len(w) > 3)
# Sentences that are filler as a whole.
FILLER = re.compile(
    r"""^(?:
    (?:(?:your|some|the|enter|insert|add|put)\s+)*(?:text|content|description|title|summary|details?|body|copy|value|name|note)s?\s+(?:goes\ |go\ )?here
  | (?:this\ is\ )?(?:a\ |an\ |the\ |only\ |just\ )*(?:dummy|placeholder|filler|sample|example)[ -](?:\w+\ )?(?:text|content|copy|paragraph|sentence|description|note|entry|summary|title)s?(?:\ (?:used|only|for|to|until|that|which|in|of)\b.*)?
  | (?:type|write|say|enter)\ (?:something|anything|here)(?:\ here)?
  | (?:delete|remove|overwrite)\ this\ (?:line|text|paragraph|section|note)\b.*
  | replace\ (?:it|this|me|the\ text|this\ (?:text|paragraph))\ (?:with|by)\ .*
  | (?:hier\ steht|dies\ ist|das\ ist)\ (?:ein\ |nur\ ein\ )*(?:blindtext|platzhalter(?:text)?|beispieltext|fülltext).*
  | (?:blindtext|platzhalter(?:text)?|fülltext)\b.*
  | (?:este?\ es\ (?:un\ )?)?texto\ (?:de\ )?(?:relleno|ejemplo|prueba|provisional|simulado)\b.*
  | (?:ceci\ est\ (?:un\ )?)?(?:faux[ -]texte|texte\ (?:de\ remplissage|factice|provisoire|d['’]exemple|temporaire|à\ remplacer))\b.*
  | describe\ the\ \w+\ in\ this\ (?:box|field|section|space)
  | \(default\ text\)
  | description\ of\ item\ \d+
  | (?:content|text|description|documentation|details)\ (?:is\ )?(?:coming\ soon|to\ be\ (?:added|written|supplied|filled\ in|done|defined)(?:\ later)?|will\ (?:be\ added|follow)(?:\ (?:soon|later|here))?)
  | coming\ soon | to\ be\ (?:written|added|filled\ in|completed|supplied)(?:\ later)? | under\ construction
  | (?:tbd|tba|todo|tbc|xxx+|n/?a|\?\?+)
    )[.!…]*$""",
    re.X | re.I,
)
# A text without any of these holds no sentence of FILLER.
_FILLER_MARKS = (
    "here", "dummy", "placeholder", "filler", "sample", "example", "replace", "blindtext", "platzhalter", "fülltext", "beispieltext", "texto", "texte", "faux", "describe the", "default text",
    "description of", "coming soon", "to be ", "will be", "will follow", "under construction", "tbd", "tba", "todo", "tbc", "xxx", "n/a", "na", "??", "something", "anything", "delete this", "remove this", "overwrite this",
)
_NUMBERED = re.compile(r"^(?:heading|title|section|item|subheading|paragraph)\s+\d+\s*$", re.I)

_SCRIPT = r"(?:java\s?scripts?|js|scripts?|scripting)"
# How pages demand scripts or report errors, in the languages of the corpus.
NOTICE = re.compile(
    rf"""
    \b(?:enable|activate|allow|turn\ on|switch\ on|unblock|permit)\b[^.]{{0,25}}\b{_SCRIPT}\b
  | \b{_SCRIPT}\b(?:\ and\ \w+)?\ (?:is|are|must\ be|has\ been|have\ been|needs\ to\ be|seems?\ to\ be|appears?\ to\ be)\ (?:currently\ |not\ )?(?:required|disabled|blocked|off|switched\ off|turned\ off|allowed|enabled|needed|supported|available)\b
  | \b(?:requires?|needs?|without|works?\ only\ with|runs?\ only\ with)\b[^.]{{0,20}}\b{_SCRIPT}\b
  | \bdoes\ not\ (?:support|allow|run)\ {_SCRIPT}\b
  | \b{_SCRIPT}\b[^.]{{0,30}}\b(?:deaktiviert|erforderlich|benötigt|einschalten|aktivieren|désactivé|requis|nécessaire|desactivado|necesario|requerido)\b
  | \b(?:aktivieren|einschalten|erlauben|activer|activez|autoriser|autorisez|active|activar|habilite|habilitar|permita)\b[^.]{{0,25}}\b{_SCRIPT}\b
  | \bchecking\ your\ browser\b | \b(?:confirm|verify|prove|make\ sure)\ (?:that\ )?you\ are\ (?:not\ a\ robot|a?\ ?human)
  | \bno\ se\ ha\ (?:encontrado|podido\ encontrar)\ la\ página | \bpage\ (?:demandée\ )?(?:est\ )?introuvable
    """,
    re.X | re.I,
)
# A sentence without any of these holds nothing of NOTICE.
_NOTICE_MARKS = ("script", "js", "browser", "you are", "no se ha", "introuvable")
# How a sentence that is such a message begins.
NOTICE_START = re.compile(
    r"""
    ^(?:http\ ?)?(?:error\ |status:?\ |code:?\ )?[45]\d\d\b[\ :–-]+(?:page\ |the\ )?(?:not\ found|forbidden|unauthori[sz]ed|bad\ (?:request|gateway)|internal\ server\ error|service\ unavailable|gateway\ time-?out|too\ many\ requests|gone|request\ timeout)
  | ^(?:error\ |fehler\ |erreur\ )[45]\d\d\b
  | ^(?:the\ )?(?:page|file|document|resource)\ not\ found\b | ^(?:seite|dokument|datei)\ nicht\ gefunden | ^página\ no\ encontrada
  | ^access\ denied | ^zugriff\ verweigert | ^accès\ refusé | ^acceso\ denegado
  | ^(?:service|site|server|page)\ (?:temporarily\ )?unavailable | ^(?:bad\ )?gateway\ (?:error|time-?out) | ^bad\ gateway | ^internal\ server\ error | ^too\ many\ requests
  | ^(?:link|session)\ (?:has\ )?expired | ^your\ session\ (?:has\ )?(?:expired|timed\ out) | ^(?:this|the)\ link\ (?:is\ no\ longer\ valid|has\ expired)
  | ^(?:an\ )?(?:unexpected|unknown|internal)\ error\b | ^something\ went\ wrong\b | ^(?:oops|whoops|uh[ -]oh)\b | ^sorry[,!.]
  | ^(?:unable|failed)\ to\ (?:load|open|fetch|display|show|render|connect|reach)\b | ^could\ not\ (?:load|open|connect|reach|display)\b
  | ^the\ (?:\w+\ )?(?:host|server|gateway|service)\ did\ not\ (?:answer|respond)\b | ^connection\ (?:timed\ out|refused|reset|lost)
  | ^(?:not\ authori[sz]ed|unauthori[sz]ed|forbidden|not\ found|timed?\ ?out|request\ (?:timed\ out|blocked))[.!]?$
  | ^we\ are\ (?:currently\ )?down\ for\ maintenance | ^(?:the\ )?site\ is\ (?:under|down\ for)\ maintenance
  | ^you\ (?:are\ not\ allowed|do\ not\ have\ permission|are\ not\ authori[sz]ed)\ to\ (?:see|view|access|open)\b
  | ^this\ (?:document|page|content|file)\ (?:has\ been\ (?:removed|deleted)|is\ no\ longer\ (?:shared|available)|does\ not\ exist)
  | ^error\ establishing\ a\b | ^the\ page\ you\ (?:asked\ for|requested|are\ looking\ for)\b | ^the\ requested\ (?:file|page|url|document)\ (?:was|could|has|does)\b
  | ^we\ could\ not\ find\ what\ you\ | ^the\ server\ is\ (?:overloaded|not\ responding|temporarily) | ^(?:please\ )?(?:sign|log)\ in\ (?:again\ )?to\ (?:see|view|continue|access)\b
    """,
    re.X | re.I,
)
#: Prose about such pages: reasons and conditions that a notice doesn't give.
_TALK = re.compile(r"\b(?:because|when|whenever|although|unless|instead\ of|still\ works?)\b", re.I | re.X)
_MENU_CUT = re.compile(r"\s{2,}|\s*[|›»·]\s*")
_CHROME = re.compile(r"^(?:skip to (?:main )?content|back to top|powered by .{1,40}|print this page|return to .{1,30}|all rights reserved\.?|share|menu|home|search|sign in|log in|help|(?:status|code|incident|reference|error code|request id)[: ]+[0-9a-f-]+\.?)$", re.I)
_TITLE = re.compile(r"^(?:#+\s*)?\S+ - [\w ]{1,30}$")
_UNSEEN = re.compile(r"<(script|style|svg|template)\b[^<>]*>.*?</\1\s*>|<!--.*?-->", re.S | re.I)
_TAGS = re.compile(r"</?[A-Za-z!][^<>]*>")
_WORD = re.compile(r"[^\W\d_]+")
_RULE = re.compile(r"^[-=*_~#\s]*$")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\s+[-–—•]\s+")


def mask(text: str) -> str:
    """text with fenced code, backticked words and quoted words taken out."""
    if "`" in text or "~~~" in text:
        text = _TICKS.sub(" § ", _FENCE.sub(" § ", text))
    return _QUOTED.sub(" § ", text)


def _name(found: re.Match) -> str:
    value = next((v for v in found.groups() if v), "")
    return re.sub(r"[\s-]+", "_", value.strip().lower())


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_DIGITS = str.maketrans({d: "0" for d in "123456789"})


def _style(found: re.Match) -> str:
    """The expression without its name."""
    name = next((i for i, v in enumerate(found.groups(), 1) if v), None)
    text = found.group() if name is None else found.string[found.start() : found.start(name)] + "\0" + found.string[found.end(name) : found.end()]
    return " ".join(text.lower().translate(_DIGITS).split())


def _spans(sentence: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, name, style) of what may stand in a slot, in order; kind is ``certain``, ``doubtful``, ``default`` or ``blank``."""
    found: list[tuple[int, int, str, str, str]] = []
    free = lambda m: all(m.end() <= f[0] or m.start() >= f[1] for f in found)
    for kind, pattern in (("certain", CERTAIN), ("doubtful", DOUBTFUL)) if _ODD.search(sentence) else ():
        found += [(m.start(), m.end(), kind, _name(m), _style(m)) for m in pattern.finditer(sentence) if free(m)]
    if any(x in sentence for x in _DEFAULT_MARKS):
        found += [(m.start(), m.end(), "default", "", "") for m in _DEFAULT.finditer(sentence) if free(m)]
    found += [(m.start(), m.end(), "blank", "", "") for m in _BLANK.finditer(sentence) if free(m)]
    return sorted(found)


# Every expression of CERTAIN and DOUBTFUL starts so; and texts without any of these hold no default or blank.
_ODD = re.compile(r"[{<$%@«\[&]|#\{|__|\*\*\*|\((?:enter|insert|fill)")
_DEFAULT_MARKS = ("undefined", "null", "NaN", "N/A", "n/a", "TBD", "TBA", "XXX", "???", "YYYY", "MM/DD", "DD.MM")
_BLANK_MARKS = ("  ", " .", " ,", " ;", "()", "( ")


def slots(masked: str) -> list[tuple[str, str, str, str, str, int]]:
    """(left, right, kind, name, style, value) of each place that may be a slot; left and right are the words of its frame."""
    out: list[tuple[str, str, str, str, str, int]] = []
    starts = [m.start() for m in _ODD.finditer(masked)]
    for marks, pattern in ((_DEFAULT_MARKS, _DEFAULT), (_BLANK_MARKS, _BLANK)):
        if any(x in masked for x in marks):
            starts += [m.start() for m in pattern.finditer(masked)]
    done = -1
    for at in sorted(starts):
        if at < done:
            continue
        first = masked.rfind("\n", 0, at) + 1
        done = masked.find("\n", at)
        done = len(masked) if done < 0 else done
        for sentence in _SENTENCE.split(masked[first:done]):
            spans = _spans(sentence) if len(sentence) > 2 else []
            for i, (start, end, kind, name, style) in enumerate(spans):
                left = sentence[spans[i - 1][1] if i else 0 : start].lower().translate(_DIGITS).split()[-FRAME_WORDS:]
                right = sentence[end : spans[i + 1][0] if i + 1 < len(spans) else len(sentence)].lower().translate(_DIGITS).split()[:FRAME_WORDS]
                if kind == "blank" and (not left or not right or "§" in left or "§" in right):
                    continue
                out.append((" ".join(left), " ".join(right), kind, name, style, _hash(sentence[start:end].lower()) if kind != "blank" else 0))
    return out


def _plain(text: str) -> str:
    return f" {' '.join(text.lower().translate(_DIGITS).split())} "


def anchor(left: str, right: str) -> tuple[str, bool]:
    """The longer side of a frame as it stands in a plain text, and whether it is the left one."""
    if len(left) >= len(right):
        return f" {left} ", True
    return (f" {right} " if right[0].isalnum() else f"{right} "), False


def fillings(text: str, anchors, frames: dict[str, list[tuple[str, str, bool]]]) -> set[tuple[str, str, int]]:
    """(left, right, value) of what stands in frames: anchors is an automaton of the keys of frames; the value is 0 where nothing stands between."""
    out: set[tuple[str, str, int]] = set()
    if next(anchors.iter(_plain(text)), None) is None:
        return out
    masked = mask(text.replace("\r\n", "\n").replace("\r", "\n"))
    text = _plain(_BLANK.sub(" \1 ", masked) if any(x in masked for x in _BLANK_MARKS) else masked)
    for end, key in anchors.iter(text):
        after, before = text[end + 1 : end + VALUE_CHARS + 3], None
        for left, right, is_left in frames[key]:
            if is_left:
                reach = 0 if after.startswith(right) else after.find(f" {right}" if right[0].isalnum() else right)
                value = after[:reach].strip() if reach >= 0 else ""
            else:
                if before is None:
                    start = end + 1 - len(key)
                    before = text[max(0, start - VALUE_CHARS - len(left) - 3) : start] + " "
                reach = before.rfind(f" {left} ")
                value = before[reach + len(left) + 2 :].strip() if reach >= 0 else ""
                reach = 0 if reach >= 0 and not value else reach
            if reach == 0 and not value:
                out.add((left, right, 0))
            elif 0 < len(value) <= VALUE_CHARS and "\1" not in value and ". " not in value and not CERTAIN.search(value) and not DOUBTFUL.search(value):
                out.add((left, right, _hash(value) or 1))
    return out


def is_filler(masked: str) -> bool:
    """True if a paragraph stands for content that was never written."""
    small = masked.lower()
    latin = not _LATIN_MARKS.isdisjoint(_WORD.findall(small))
    marked = any(x in small for x in _FILLER_MARKS)
    for paragraph in re.split(r"\n[ \t]*\n", masked):
        lines = [x.strip().strip("*#_> \t").rstrip(":") for x in paragraph.split("\n")]
        lines = [x for x in lines if x]
        if not lines:
            continue
        low = paragraph.lower()
        first = _WORD.search(low)
        if latin or (first is not None and low.count(first.group()) > 2):
            words = _WORD.findall(low)
            if len(words) >= 6 and sum(w in LATIN for w in words) >= 0.75 * len(words):
                return True
            if len(words) >= 3 and len(set(words)) == 1 and len(words[0]) > 1:
                return True
        if not marked and paragraph.count(_SENTENCE.split(lines[0], maxsplit=1)[0].strip()) < 2 and (len(lines) == 1 or not _NUMBERED.match(lines[0])):
            continue
        sentences = [s.strip() for x in lines for s in _SENTENCE.split(x) if s.strip()]
        if len(sentences) >= 3 and len(set(sentences[:-1])) == 1:
            return True
        if len(lines) > 1 and sum(bool(_NUMBERED.match(x)) for x in lines) >= 2 and all(_NUMBERED.match(x) or FILLER.match(x) for x in lines):
            return True
        if any(FILLER.match(s) and not _TALK.search(s) for s in sentences):
            return True
    return False


def is_menu(line: str) -> bool:
    """True for two or more entries of one or two words with bars or wide gaps between."""
    entries = _MENU_CUT.split(line)
    return len(entries) > 1 and all(1 <= len(e.split()) <= 2 for e in entries)


def page_sentences(text: str) -> list[str]:
    """Sentences that a reader of the page sees, without menus and titles."""
    body = text
    if "<" in body:
        body = html.unescape(_TAGS.sub("\n", _UNSEEN.sub("\n", body)))
    lines = [x.strip() for x in body.split("\n") if x.strip()]
    kept = [x for x in lines if not (_CHROME.match(x) or is_menu(x) or _RULE.match(x))]
    if len(kept) > 1 and _TITLE.match(kept[0]):
        kept = kept[1:]
    joined = "\n".join(kept)
    if joined.startswith("{") and joined.endswith("}"):
        try:
            answer = json.loads(joined)
        except (ValueError, RecursionError):
            answer = None
        if isinstance(answer, dict) and any(k.lower() in ("error", "errors", "error_code", "fault") for k in answer):
            return ["internal error"]
    sentences = [s.strip(" \t-*•·>#_:") for x in mask(joined).split("\n") for s in _SENTENCE.split(x.strip())]
    return [s for s in sentences if s and not _CHROME.match(s)]


def is_notice(sentence: str) -> bool:
    if NOTICE_START.match(sentence) is None:
        small = sentence.lower()
        if not any(x in small for x in _NOTICE_MARKS) or NOTICE.search(sentence) is None:
            return False
    return _TALK.search(sentence) is None


def examine(text: str) -> tuple[bool, bool, bool, list[int], list[int], list[tuple]]:
    """filler, notice on a short page, notice at all, page sentences and those that are notices (hashes), places of slots."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    masked = mask(text)
    sentences = page_sentences(text)
    key = lambda s: _hash(re.sub(r"\d+|[0-9a-f]{8,}", "0", s.lower()))
    notices = sorted({key(s) for s in sentences if is_notice(s)})
    short = bool(notices) and sum(len(s.split()) for s in sentences) <= PAGE_WORDS
    return is_filler(masked), short, bool(notices), sorted({key(s) for s in sentences}), notices, slots(masked)


_PLACE = "left string, right string, kind string, name string, style string, value long"
_EVIDENCE = f"id long, filler boolean, short boolean, told boolean, page array<long>, notices array<long>, places array<struct<{_PLACE.replace(' ', ':').replace(',:', ',')}>>"


def _looked_up(texts: DataFrame, frames: DataFrame) -> DataFrame:
    """left, right, n_values, n_empty: how many different values the texts hold in each frame, and how many texts nothing."""
    n = frames.count()
    blocks = max(1, -(-n // FRAME_BLOCK))
    parts = []
    for block in range(blocks):
        mine = frames if blocks == 1 else frames.filter(F.pmod(F.xxhash64("left"), F.lit(blocks)) == block)
        keyed: dict[str, list[tuple[str, str, bool]]] = {}
        for r in mine.toLocalIterator():  # about FRAME_BLOCK frames of a few words
            key, is_left = anchor(r.left, r.right)
            keyed.setdefault(key, []).append((r.left, r.right, is_left))

        def run(batches: Iterator[pa.RecordBatch], keyed: dict[str, list[tuple[str, str, bool]]] = keyed) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            anchors = ahocorasick.Automaton()
            for key in keyed:
                anchors.add_word(key, key)
            anchors.make_automaton()
            for batch in batches:
                rows: list[tuple[str, str, int]] = []
                empty: dict[tuple[str, str], int] = {}
                seen: set[tuple[str, str, int]] = set()
                for value in batch.column(0).to_pylist() if keyed else ():
                    for left, right, held in fillings(value, anchors, keyed):
                        if held:
                            seen.add((left, right, held))
                        else:
                            empty[left, right] = empty.get((left, right), 0) + 1
                rows = [(*s, 0) for s in seen] + [(*k, 0, n) for k, n in empty.items()]
                columns = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["left", "right", "value", "n"])

        parts.append(texts.select("body").mapInArrow(run, "left string, right string, value long, n long"))
    every = reduce(DataFrame.unionByName, parts).groupBy("left", "right", "value").agg(F.sum("n").alias("n"))
    return every.groupBy("left", "right").agg(F.count_if(F.col("value") != 0).alias("n_values"), F.sum("n").alias("n_empty"))


def residue(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, reason: each text that holds residue, once per reason.

    ``slot`` and ``page`` come from alignment over the corpus, ``filler`` from paragraphs, and ``slot_pattern``
    and ``page_pattern`` from fixed patterns alone, where nothing in the corpus is like the record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.string()) for c in _PLACE.split(", ")])
        types = [pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(place)]
        names = ["id", "filler", "short", "told", "page", "notices", "places"]
        keys = [c.split()[0] for c in _PLACE.split(", ")]
        for batch in batches:
            rows = [(key, *examine(value)) for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            columns[-1] = [[dict(zip(keys, p)) for p in places] for places in columns[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    texts = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("body")).filter(F.col("id").isNotNull() & (F.trim("body") != ""))
    seen = cut(texts.mapInArrow(run, _EVIDENCE))
    found = [seen.filter("filler").select("id", F.lit("filler").alias("reason")), *_slot_rows(texts, seen), *_page_rows(seen)]
    return reduce(DataFrame.unionByName, found).distinct().select(F.col("id").alias(doc_id), "reason")


def _slot_rows(texts: DataFrame, seen: DataFrame) -> list[DataFrame]:
    """id, reason of the places that are slots which keep a variable, a default or a blank."""
    places = seen.select("id", F.explode("places").alias("p")).select("id", "p.*")
    marked = F.col("kind").isin("certain", "doubtful")
    frames = cut(places.groupBy("left", "right").agg(
        F.min(F.when(marked, F.col("value"))).alias("low"), F.max(F.when(marked, F.col("value"))).alias("high"), F.count_if(~marked).alias("n_other"),
        F.count_if(F.col("kind") == "certain").alias("n_certain"), F.count_if(marked).alias("n"),
    ))
    varied = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    framed = (F.col("left") != "") & (F.col("right") != "")
    # frames that the expressions alone don't decide
    values = _looked_up(texts, frames.filter(framed & ((F.col("n_other") > 0) | (~varied & (F.col("n_certain") > 0)))).select("left", "right"))
    known = cut(frames.join(values, ["left", "right"], "left").select(
        "left", "right", (varied & ((F.col("left") != "") | (F.col("right") != ""))).alias("varied"), F.col("low").isNotNull().alias("kept"), (F.col("n") > 1).alias("several"),
        F.coalesce("n_values", F.lit(0)).alias("n_values"), F.coalesce("n_empty", F.lit(0)).alias("n_empty"),
    ))
    # a hot frame is in a third of all records: its row goes to every salt
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    judged = cut(places.withColumn("salt", F.pmod("id", F.lit(16))).join(broadcast_if_small(salted), ["left", "right", "salt"]).drop("salt"))
    slot = F.col("varied") | (F.col("n_values") > 0)
    # styles and names that stand in slots
    by_style = judged.filter(marked & F.col("several")).groupBy("style").agg(F.avg(F.col("varied").cast("double")).alias("share"), F.count_distinct("name").alias("n_names"))
    styles = by_style.filter((F.col("share") >= STYLE_SHARE) & (F.col("n_names") > 1)).select("style")
    names = judged.filter((F.col("kind") == "certain") & (F.col("name") != "")).select("name").distinct()
    certain, doubtful = judged.filter("kind = 'certain'"), judged.filter("kind = 'doubtful'").join(broadcast_if_small(names), "name", "left_semi")
    alone = certain.filter(~slot)
    aligned = [
        certain.filter(slot), alone.join(broadcast_if_small(styles), "style", "left_semi"), doubtful.filter("varied"), doubtful.filter("not varied").join(broadcast_if_small(styles), "style", "left_semi"),
        judged.filter("kind = 'default' and kept and n_values > 0"),
        judged.filter(f"kind = 'blank' and n_empty = 0 and (n_values >= {BLANK_VALUES} or kept)"),
    ]
    sure = reduce(DataFrame.unionByName, [a.select("id") for a in aligned]).withColumn("reason", F.lit("slot"))
    return [sure, alone.join(broadcast_if_small(styles), "style", "left_anti").select("id", F.lit("slot_pattern").alias("reason"))]


def _page_rows(seen: DataFrame) -> list[DataFrame]:
    """id, reason of the pages that are made of what repeats on pages with a notice, and of those with a notice alone."""
    pages = seen.select("id", "short", "told", F.size("page").alias("of"), "page", "notices")
    parts = pages.select("id", "short", "told", "of", F.explode("page").alias("part"))
    # only sentences that stand on a page with a notice can be part of a template; combined in the tasks before the shuffle
    told = broadcast_if_small(parts.filter("told").select("part").distinct())
    share = parts.join(told, "part", "left_semi").groupBy("part").agg(
        F.avg(F.col("short").cast("double")).alias("share"), F.avg(F.col("told").cast("double")).alias("told_share"), F.count("*").alias("n"), F.count_if("told").alias("n_told")
    )
    short_part, any_part = (F.col("share") >= TEMPLATE_SHARE) & (F.col("n") >= PAGE_REPEATS), (F.col("told_share") >= TEMPLATE_SHARE) & (F.col("n_told") > PAGE_REPEATS)
    known = cut(share.select("part", short_part.alias("of_short"), any_part.alias("of_any"), ((F.col("share") < 1 - TEMPLATE_SHARE) & (F.col("n") > PAGE_REPEATS)).alias("talk")))
    held = parts.join(broadcast_if_small(known), "part").groupBy("id", "short", "told", "of").agg(F.count_if("of_short").alias("n_short"), F.count_if(F.col("of_short") | F.col("of_any")).alias("n_any"))
    template = held.filter((F.col("n_short") == F.col("of")) | (F.col("told") & (F.col("n_any") >= TEMPLATE_SHARE * F.col("of")))).select("id", F.lit("page").alias("reason"))
    # a notice that mostly stands in longer texts without being their page is talk about such pages
    lone = pages.filter("short").select("id", F.explode("notices").alias("part")).join(broadcast_if_small(known.filter("talk")), "part", "left_anti")
    return [template, lone.select("id").distinct().join(template.select("id"), "id", "left_anti").select("id", F.lit("page_pattern").alias("reason"))]


def without_residue(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows that residue() names."""
    bad = residue(df, doc_id, text).select(doc_id).distinct()
    return df.join(bad, doc_id, "left_anti")
