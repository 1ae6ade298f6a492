import pytest

from veinstone.llm.residue import examine, is_filler, mask, residue, without_residue

RESIDUE = [
    "Dear {{ owner }}, the scan has finished.", "Reviewed by ${NAME} on April.", "The maximum was set by %(who)s.", "Release <%= version %> is out.", "See #{ticket} first.",
    "Written by @@AUTHOR@@ today.", "Please contact <<owner>> about it.", "Contract for [TBD: summary] is ready.", "The [status goes here] is unknown.", "Use <your-module> for it.",
    "Owner: <INSERT NAME HERE>", "It was [object Object] again.", "Hello {0}, welcome.", "{% block date %}{% endblock %} needs attention", "Confidence %s for it.", "***DATE*** (fill in) is late",
    "Lorem ipsum dolor sit amet velit massa nunc arcu.", "Your text here. Your text here.", "Real words first.\n\nxxx xxx xxx xxx", "Item 1\nDescription of item 1\nItem 2\nDescription of item 2",
    "Placeholder content for the summary section.", "Hier steht ein Blindtext, der später ersetzt wird.", "Texto de relleno, pendiente de sustituir.",
    "Please enable JavaScript to view this page.", "Menu  Search  Sign in\nJS is off. Turn it on to read on.\nPowered by X", "find_x - Notes\n\n404 Not Found", "<html><head><title>404 Not Found</title></head><body><h1>404 Not Found</h1></body></html>",
    '{"error": "not_found", "message": "gone"}', "Access denied\nYou do not have permission to view this document.", "Veuillez activer JavaScript pour afficher ce contenu.", "Seite nicht gefunden. Die Adresse existiert nicht mehr.",
]
CLEAN = [
    "The renderer replaces `{{ owner }}` with a value.", "```html\n<p>{{ owner }}</p>\n```\nThis is the template.", 'We show the text "Please enable JavaScript" only in the old viewer.', "The CLI reads from <stdin>.",
    "The set {35, 2760} is accepted, {7, 9} is not, and the range [0, 28) too.", "The fee is $5 per row and never more than $90.", "It is built in __init__ and sealed in __exit__.", "Callers that pass *args lose **options.",
    "The former client typed it as Map<String, Row>, which hides it.", "Coverage rose by 8% since May.", "The fixture uses lorem ipsum words as payload.", "The page still works when JavaScript is switched off, because it is rendered on the server.",
    "A call to the missing endpoint now answers with 404 Not Found instead of an empty list.", "When the session has expired, the worker signs in again.", "Access is denied to callers without a lease; the contract lists this.", "A TODO in the body lowers the score.",
    "Add description fields to the export, as agreed.", "Raises NotFound (404) if it has none.", "**Summary**\nReturns the row.", "See [62] and [721] for more.",
]


def verdict(text):
    filler, short, *_, places = examine(text)
    return filler or short or any(p[2] == "certain" for p in places)


@pytest.mark.parametrize("text", RESIDUE)
def test_residue(text):
    assert verdict(text)


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    assert not verdict(text)


def test_mask_keeps_words_around_code():
    assert "{{" not in mask("a `x {{y}}` b ``{{`` c\n~~~\n{{z}}\n") and mask("it's {{x}} isn't it").count("{{") == 1
    assert not is_filler("") and not is_filler("one two three")


@pytest.mark.parametrize("text", ["blah, blah, blah", "text; text; text", "blah blah blah…", "(xx) xx – xx!", "Go on. Go on. Go on.", "lorem; ipsum; dolor; sit; amet; elit"])
def test_repeated_words_and_sentences_with_any_signs(text):
    assert is_filler(text)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "'x' as reason")


def found(df):
    return {(r.doc_id, r.reason) for r in residue(df).collect()}


def test_frames_that_vary_are_slots_and_constant_ones_are_not(spark):
    rows = [(1, "Written by $owner$ in April."), (2, "Written by __OWNER__ in April."), (3, "It was written by {{ owner }} in April."), (4, "Built in __init__ here."), (5, "Built in __init__ here. Well built in __init__ here.")]
    rows += [(6, "The CLI reads rows from <stdin> if no path is given."), (7, "It reads lines from <stdin> if no path is given."), (8, "Lists of List<Owner> are kept."), (9, "It was written by Anna in April."), (10, None), (11, "  ")]
    rows += [(12, "plain words " * 20_000 + "and written by @@OWNER@@ in April."), (13, "Set to {{ mode }} once."), (14, "All was set to high once."), (15, "We use {{ kind }} alone."), (None, "{{ owner }}")]
    df = frame(spark, rows)
    assert found(df) == {(1, "slot"), (2, "slot"), (3, "slot"), (12, "slot"), (13, "slot"), (15, "slot_pattern")}
    assert {r.doc_id for r in without_residue(df).collect() if r.doc_id is not None} == {4, 5, 6, 7, 8, 9, 10, 11, 14}
    assert residue(df.limit(0)).count() == 0


def test_styles_learned_from_slots_decide_frames_that_stand_alone(spark):
    rows = [(i, f"Owner is «{n}» today.") for i, n in enumerate(["owner", "date", "path"])] + [(10, "Ask «owner» first."), (11, "She said «hello» again."), (20, "Set to {{ owner }} and {{ date }} then."), (21, "Or {{ path }}.")]
    got = {i for i, _ in found(frame(spark, rows))}
    assert {0, 1, 2, 10, 20, 21} <= got and 11 not in got


def test_blanks_and_defaults_count_where_other_records_have_values(spark):
    rows = [(i, f"Dear {n}, your scan of {p} has finished.") for i, (n, p) in enumerate(zip(["Anna", "Bo", "Cy Doe", "Di"], ["a.py", "b.py", "c.py", "d.py"]))]
    rows += [(10, "Dear , your scan of  has finished."), (11, "Some other words , with  gaps in them."), (12, "The third  word of a text"), (13, "The third word of a page"), (14, "The third odd word of"), (15, "the third big word of"), (16, "the third new word of")]
    rows += [(20, "State set to {{ state }} by hand."), (21, "State set to N/A by hand."), (22, "State set to done by hand."), (23, "It returns null by name.")]
    assert found(frame(spark, rows)) == {(10, "slot"), (20, "slot"), (21, "slot")}


def test_template_pages(spark):
    rows = [(9, "Link expired\nAsk the host for more.\nIncident 12"), (10, "Link expired\nAsk the host for more."), (11, "Ask the host for more."), *((i, f"Page not found\nAsk the host for more.\nCode {i}") for i in (20, 21, 22)), (30, "Access denied.")]
    assert found(frame(spark, rows)) == {(i, "page") for i in (9, 10, 11, 20, 21, 22)} | {(30, "page_pattern")}


def test_many_frames_are_looked_up_in_blocks(spark, monkeypatch):
    rows = [(i, f"Word{chr(97 + i)} was set to {{{{ x }}}} by hand{chr(97 + i)}.") for i in range(8)] + [(20 + i, f"Word{chr(97 + i)} was set to ten by hand{chr(97 + i)}.") for i in range(4)]
    whole = found(frame(spark, rows))
    monkeypatch.setattr("veinstone.llm.residue.FRAME_BLOCK", 2)
    assert found(frame(spark, rows)) == whole and {r for r in whole if r[1] == "slot"} == {(i, "slot") for i in range(4)}


def test_error_pages_of_any_length_and_order(spark):
    head = "<html><head><style>p { color: red }</style><script>" + "var a = 1 < 2; f(a);\n" * 200 + "</script></head><body>"
    verbose = "Halden store\n" + "\n".join(f"Line {w} of the long apology of the operators of this store to all its readers, who wait." for w in "abcdefghijkl") + "\nService unavailable.\nRequest {}"
    rows = [(1, head + "<h1>404 Not Found</h1></body></html>"), (2, "The valve list\nAn overview of this month.\nPlease enable JavaScript to read on."), *((i, verbose.format(i)) for i in range(10, 14))]
    rows += [(20, verbose.format(1).replace("Service unavailable.", "It worked.") * 2), (21, "Rows come first.\n" + "\n".join(f"Word {w} of a guide about valves and their many owners." for w in "abcdefghijkl") + "\nAccess denied.")]
    assert found(frame(spark, rows)) == {(1, "page_pattern"), (2, "page_pattern"), *((i, "page") for i in range(10, 14))}
