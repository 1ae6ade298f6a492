import random

from hypothesis import given, settings, strategies as st

from veinstone.llm.provenance import BLOCK_MOST, PATH_SIGN, blocks, examine, file_signs, fingerprints, grammar_bits, repair, rule_uses, shared_tokens, tokenise

HAND = '''def load_rows(path):
    """Reads every row."""
    banner = "Code generated, do not edit"
    # auto-generated keys are compared as text
    # ids are generated once at start and never edited
    days = [23, 15, 31, 30, 3, 25, 10, 17, 24, 24, 5, 14]
    for row in path:
        if row["depth"] > 376:
            days.append(row)
    return sorted(days, key=lambda r: (r.margin, r.owner))
'''


def expand(rules, first, symbol):
    return [symbol] if symbol < first else [x for part in rules[symbol - first] for x in expand(rules, first, part)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=120))
def test_grammar_is_exact(sequence):
    rules, rest, first = repair(sequence)
    back = [x for s in rest for x in expand(rules, first, s)]
    assert back == sequence
    uses, length = rule_uses(rules, rest, first)
    assert all(uses[first + r] >= 2 for r in range(len(rules)))
    assert sum(uses[s] for s in range(first)) == len(sequence)
    pairs = list(zip(rest, rest[1:]))
    assert all(not (pairs.count(p) > 1 and p[0] != p[1]) for p in pairs)


def signs(body, c_like=False):
    return examine(body, c_like, ("Own Works",))[0]


def test_signs_of_bodies():
    rng = random.Random(1)
    assert signs(HAND) == set()
    assert signs("\n".join(f"    self_w{i} = make(widget{i - 1}, 'obj_{i}', {i * 7}, {i})" for i in range(12))) == {"generated"}
    assert "minified" in signs("function e(y,m){var b=f||{};for(w=0;w<t.length;w++)y[w]=o(t[w]);q=p?h.r(4):void 0;return q}", True)
    table = ", ".join(str(rng.randrange(-30000, 30000)) for _ in range(80))
    assert signs(f"def words(x):\n    return [{table}]") == {"data"}
    assert signs(f"x = '{'ab' * 400}'") == set()
    assert signs("# Code generated by tool 3. DO NOT EDIT.\n" + HAND) == {"notice"}
    assert signs("/*\n * (c) 2011-2019 Other Code\n */\nint f() { return 1; }", True) == {"notice"}
    assert signs("# Copyright 2023 Own Works. All rights reserved.\n" + HAND) == set()
    assert signs("") == set() and signs("\n" * 1000) == set()


def test_data_in_texts_prefixed_strings_and_tables_with_keys():
    rng = random.Random(2)
    blob = "\n".join("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=76)) for _ in range(8))
    assert signs(f'ICON = """\n{blob}\n"""\n') == {"data"}
    resource = "\n".join('    b"' + "".join(f"\\x{rng.randrange(256):02x}" for _ in range(16)) + '"' for _ in range(8))
    assert "data" in signs(f"image = (\n{resource}\n)\n")
    keyed = ", ".join(f'"{rng.randrange(16**6):06x}": {rng.choice(["null", "true", str(rng.randrange(10**6))])}' for _ in range(40))
    assert "data" in signs(f"table = {{{keyed}}}")
    bare = ", ".join(f"{rng.choice('abcdefgh')}{i}x: {rng.randrange(10**9)}" for i in range(40))
    assert "data" in signs(f"var t = {{{bare}}};", True)
    prose = " ".join(rng.choice("the rows of a valve are read once and then kept in order until their owner asks for them".split()) for _ in range(120))
    assert "data" not in signs(f'def f(x):\n    """{prose}"""\n    return x\n') and "data" not in signs(f'HELP = """{prose}"""\n')
    assert "data" not in signs(f'def f(x):\n    """{blob}"""\n    return x\n')


def test_paths():
    for path in ("a/vendor/x/y.py", "a/node_modules/b.js", "a/x.min.js", "a/x-min.js", "a/b.bundle.ab12.js", "a/x_pb2.py", "a/ui_x.py", "a/moc_x.cpp", "a/x.tab.cc", "a/dist/b.js", "a/_gen/b.py", "a/x_generated.py"):
        assert PATH_SIGN.search(path), path
    for path in ("a/distance/b.js", "a/vendor_payments/x.py", "a/generated_reports/x.py", "a/third_party_risk/x.ts", "a/external_api_x.py", "a/minify_x.py", "a/buildings/x.py", "a/x_codegen.py", "a/uid.py"):
        assert not PATH_SIGN.search(path), path


def code_of(words, name="f"):
    return f"def {name}(rows, sizes):\n" + "".join(f"    total_{w} = rows.{w}(sizes, limit_{w}) + offset_{w}\n" for w in words)


WORDS = ("age", "size", "cost", "rank", "tone", "mass", "heat", "flow")


def tokens(body):
    return [t for _, t in tokenise(body, False)[0]]


def test_a_tail_of_repeats_doesnt_mark_a_long_hand_written_body():
    rng = random.Random(3)
    lines = "".join(f"{rng.choice('abcdefgh')}{''.join(rng.choices('klmnopqrst', k=9))}{rng.choice(' +-*/=')}{''.join(rng.choices('uvwxyz', k=9))}\n" for _ in range(24_000))
    log = "".join(f"    logger.info('step {i}', rows, sizes, limits, owner, seen)\n" for i in range(6))
    assert "generated" not in signs(lines + log)
    assert "generated" in signs("x = 1\n" + log * 3)
    many = tokens(lines)
    cut_up = blocks(many)
    assert [t for b in cut_up for t in b] == many and all(len(b) <= BLOCK_MOST for b in cut_up) and len(cut_up) > 1
    shifted = blocks(["new", *many])
    assert {tuple(b) for b in shifted[1:]} == {tuple(b) for b in cut_up[1:]}


def test_bits_of_grammars():
    rng = random.Random(4)
    assert grammar_bits("".join(rng.choices("abcdefghijklmnop", k=3000))) > 0.9 and grammar_bits("ab" * 1500) < 0.1 and grammar_bits("") == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 60), st.integers(0, 60))
def test_every_common_run_has_a_common_fingerprint_and_shared_rules(seed, before, after):
    rng = random.Random(seed)
    common = [f"w{rng.randrange(10**6)}" for _ in range(40)]
    one = [f"a{i}" for i in range(before)] + common + [f"b{i}" for i in range(after)]
    two = [f"c{i}" for i in range(after)] + common + [f"d{i}" for i in range(before)]
    assert set(fingerprints(one)) & set(fingerprints(two))
    assert shared_tokens(one, two) == shared_tokens(two, one) == 40
    assert shared_tokens(one, [f"e{i}" for i in range(50)]) == 0


def test_copies_in_two_repositories_and_odd_rows(spark):
    copied = code_of(WORDS)
    rows = [("one/a.py", copied), ("two/b.py", "import moved\n" + copied + "\ndone = True\n"), ("two/c.py", HAND), ("one/d.py", None), ("one/vendor/e.py", None), (None, copied), ("one/f.py", "")]
    rows += [("three/part.py", code_of(("other", "code")) + code_of(WORDS[2:6], "g")), ("four/renamed.py", code_of(WORDS).replace("def f", "def h")), ("one/own.py", code_of(("red", "green", "blue", "pink")))]
    rows += [("one/again.py", code_of(("red", "green", "blue", "pink"))), ("one/long.py", "x = 1\n" + "".join(f"rows_{chr(97 + i % 26)}{i} = {i}\n" for i in range(20_000)))]
    df = spark.createDataFrame(rows, "file_path string, body string").selectExpr("*", "'r' as repo", "1 as sign", "2 as row")
    got = {(r.file_path, r.sign) for r in file_signs(df).collect()}
    shared = {(f, "shared") for f in ("one/a.py", "two/b.py", "three/part.py", "four/renamed.py")}
    assert {x for x in got if x[0] != "one/long.py" and x[1] != "generated"} == shared | {("one/vendor/e.py", "path")}
    assert file_signs(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(36, 60), st.integers(2, 40))
def test_runs_are_shared_whatever_repeats_beside_them(seed, size, names):
    rng = random.Random(seed)
    common = [f"w{rng.randrange(names)}" for _ in range(size)]
    one = [*rng.choices(common, k=12), "a", *common, "x", *[common[-1], "x"] * 9]  # its last token makes a pair with x more often
    two = [*rng.choices(common, k=12), "b", *common, "y", *rng.choices(common, k=12)]
    in_two = {tuple(two[i : i + 40]) for i in range(len(two) - 39)}
    held = {k for i in range(len(one) - 39) if tuple(one[i : i + 40]) in in_two for k in range(i, i + 40)}
    assert shared_tokens(one, two) == len(held) and bool(held) == (size >= 40)
    assert not held or set(fingerprints(one)) & set(fingerprints(two))


def test_partners_in_third_repositories_arent_hidden_by_others_with_the_same_fingerprint(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(60)]
    text = lambda side, some: " ".join([f"{side}first", *some, f"{side}last"])
    # the first and the last repository have 35 of the tokens, which is no copy; of those in between two have 40 or more
    rows = [(f"{repo}/x.py", text(repo, words[10:45])) for repo in ("aa", "ab", "zy", "zz")]
    rows += [("mm/x.py", text("mm", words)), ("nn/x.py", text("nn", words[8:48])), ("oo/x.py", text("oo", words[9:48]))]
    df = spark.createDataFrame(rows, "file_path string, body string")
    assert {r.file_path for r in file_signs(df).collect() if r.sign == "shared"} == {"mm/x.py", "nn/x.py"}
