import pytest

from veinstone.llm.docpairs import described, doc_pairs, documented_members

PY = '''# Copyright 2023 Somebody.

# Reads every row and drops the stale ones.
@retry(3)
def load_rows(
    self,
    path: dict,
) -> str:
    sample = "def not_me(x): return x"
    query = """
def nor_me():
    'Reads things.'
"""

    def inner(x):
        r\'\'\'
        Sorts by weight, newest first.
        \'\'\'
        return x

    # type: ignore
    def bare(y):
        return y
    return path

# Adds things.

def apart():
    x = 1
    """Not a docstring of anything at all."""

async def two(a): "Two words about ties."
'''
JS = '''/**
 * Merges two lists so that no row counts twice.
 * @param a the first
 */
// eslint-disable-next-line no-shadow
export async function mergeLists(a, b = {}) {
  const text = "function fake() { return 1; }"; // /* not a comment
  const re = /[{/]\\/\\*/g;
  /* guard */ a.x = 1;
  if (a) {
    // Not a doc of a call.
    call(a);
  }

  /** Picks the wide one. */
  const pickWide = (x) => {
    return `${x} } {`;
  };
}

/** TODO: document */
const later = async (q) => q + 1;

/** Newest first, ties by weight. */
sortRows(rows) {
  return rows;
}

/** Apart from it. */

function apart() {}
'''
CPP = '''/// Rounds half up, per valve.
/// \\param v the valve
template <typename T>
std::vector<int> Row::round_up(const T& v, int n) const {
  for (const auto& x : v) { use(x); }
  auto s = "void fake() {";
  // Splits at the boundary, later ones last.
  auto split = [&](int k) { return k; };
  return split(n);
}
/* n/a */
bool Row::is_bare(int n) {
  if (n) { return true; }
  return check(n);
'''


def names(body, path):
    return [m.name for m, _ in documented_members(body, path, None)]


def test_python():
    assert names(PY, "a.py") == ["load_rows", "load_rows.inner", "two"]
    assert names(PY.replace("\n", "\r\n"), "a.py") == ["load_rows", "load_rows.inner", "two"]
    assert names(PY.replace("    ", "\t"), "a.py") == ["load_rows", "load_rows.inner", "two"]


def test_script():
    assert names(JS, "a.ts") == ["mergeLists", "mergeLists.pickWide", "sortRows"]


def test_c():
    assert names(CPP, "a.hpp") == ["round_up", "round_up.split"]


@pytest.mark.parametrize("doc", [
    "", "  \n *** \n", "load_rows", "load_rows()", "Load rows.", "Loads the rows", "This function will load rows.", "A function that is used to load rows", "Method to load rows.", "load_rows: load rows", "TODO", "FIXME: description is missing, add one",
    "TODO(abc): write the description", "n/a", "...", "-----", "Helper.", "Internal.", "doc string here", "No description.", "(no documentation available)", "To be documented.", "Add description here", "See base class.", "See parent.", "Same as above.",
    ":param x:\n:return:", "@param voucher\n@return", "noqa: C901", "type: ignore", "@ts-ignore", "clang-format off", "NOLINTNEXTLINE", "if x is None:\n    return y[0]", "return sum(r['a'] for r in rows)", "auto parcel = load(status);", "row.push_back(x);",
    "const a = load(b);", "Copyright 2023 the authors.", "{@inheritDoc}",
])
def test_trivial(doc):
    assert described(doc, "load_rows") == ""


@pytest.mark.parametrize("doc", [
    "Newest first, ties by weight.", "Devuelve los datos cuyo campo supera el límite.", "Liest jeden Eintrag und verwirft ihn.", "TODO: faster\nDrops stale rows.", "True if none is larger.", ":param x: the parcel to use, never null", "Loads rows before the depot is stored.",
])
def test_described(doc):
    assert described(doc, "load_rows")


@pytest.mark.parametrize("doc", [
    "Check whether the queue is empty.", "Compare two contract versions by hash.", "Overrides the default retry limit.", "Consult the cache before the store.", "See whether the lease is free.", "Bug reports grouped by owner.",
    "TODO: speed up. Returns the sum of the open lines.", "Todo items of an owner.", "Tables imported from the old store.", "Skips keys that are auto-generated.", "Adds the copyright line to each page.",
])
def test_short_descriptions_that_look_like_pointers_or_notices(doc):
    assert described(doc, "load_rows") == (doc if "TODO" not in doc else "Returns the sum of the open lines.")


@pytest.mark.parametrize("doc", [
    "Check base_rows.", "Compare Row.merge()", "Overrides Base.load", "Overrides the base class.", "Overridden in subclasses.", "Check the docs.", "BUG: fails", "Bug 1234", "HACK", "TODO: description is missing. Add one.", "This file was auto-generated.", "Imported from the x library.",
])
def test_pointers_notices_and_to_dos_stay_trivial(doc):
    assert described(doc, "load_rows") == ""


def test_frame(spark):
    rows = [("a::f", "def f():\n  'Sorts by age.'", "a.py", "python"), ("b::f", None, "a.py", None), ("c::f", "", None, None), ("d::f", "x", "a.unknown", "cobol"), ("e::f", "def f():\n  'Sorts by age.'", None, "Python"), (None, "def g():\n  'Sorts by age.'", "g.py", None)]
    rows.append(("long::f", "def f():\n  'Sorts by age.'\n" + "  x = 1\n" * 100_000 + "def g():\n  'Sorts by size.'\n", "l.py", None))
    df = spark.createDataFrame(rows, "function_id string, body string, file_path string, language string").selectExpr("*", "1 as line", "'x' as doc")
    got = sorted((r.function_id or "", r.member_name) for r in doc_pairs(df).collect())
    assert got == [("", "g"), ("a::f", "f"), ("e::f", "f"), ("long::f", "f"), ("long::f", "g")]
    assert doc_pairs(df.limit(0)).count() == 0


def test_further_forms_of_definitions():
    doc = "Newest first, ties by weight."
    script = {
        f"/** {doc} */\nRow.prototype.sortRows = function (a) {{\n return a;\n}};\n": "sortRows", f"/** {doc} */\nexports.sortRows = async (a) => {{\n return a;\n}};\n": "sortRows",
        f"/** {doc} */\nmodule.exports = function sortRows(a) {{\n return a;\n}};\n": "sortRows", f"/** {doc} */\nconst sortRows = <T,>(a: T) => {{ return a; }};\n": "sortRows",
    }
    c = {
        f"class A {{\n public:\n  /// {doc}\n  explicit A(int n) : n_(n) {{ x(); }}\n}};\n": "A", f"class A {{\n  /// {doc}\n  ~A() {{ x(); }}\n}};\n": "~A", f"class A {{\n public:\n  /// {doc}\n  int f(int n) {{ return n; }}\n}};\n": "f",
        f"/// {doc}\nbool operator==(const A& a, const A& b) {{ return true; }}\n": "operator==", f"struct A {{\n  /// {doc}\n  int operator()(int a) const {{ return a; }}\n}};\n": "operator()",
        f"/// {doc}\ndecltype(auto) f(int a) {{ return a; }}\n": "f", f"/// {doc}\nint __attribute__((noinline)) f(int a) {{ return a; }}\n": "f", f'/// {doc}\nextern "C" int f(int a) {{ return a; }}\n': "f",
        f"/// {doc}\ntemplate <>\nint f<int>(int a) {{ return a; }}\n": "f", f"/// {doc}\nstd::function<int(int)> f = [](int a) {{ return a; }};\n": "f", f"class A {{\n  Q_OBJECT\n  /// {doc}\n  int f(int n) {{ return n; }}\n}};\n": "f",
        f"/// {doc}\n{' '.join(f'MACRO{i}' for i in range(600))} int f(int n) {{ return n; }}\n": "f",
    }
    python = {f"def f(a):\n    (\n     '{doc}'\n    )\n    return a\n": "f", f"# {doc}\n@a.b(\n  1,\n\n  2,\n)\ndef f(x): pass\n": "f"}
    for forms, path in ((script, "a.ts"), (c, "a.hpp"), (python, "a.py")):
        for body, name in forms.items():
            assert names(body, path) == [name], body
    for body in (f"/** {doc} */\nrow.total = size(a);\n", f"/** {doc} */\nmodule.exports = {{ a }};\n"):
        assert names(body, "a.js") == []
    assert names(f"/// {doc}\nint x = f(a) + g(b);\n", "a.cpp") == [] and names(f"def f(a):\n    ('{doc}', a)\n", "a.py") == [] and names(f"def f(a):\n    ('{doc}').strip()\n", "a.py") == []


def test_code_comes_with_the_pair(spark):
    body = "# Head.\r\n\r\ndef f(\r\n  a,\r\n):\r\n  'Sorts by age.'\r\n  return a\r\n\r\nx = 1\r\n"
    df = spark.createDataFrame([("a::f", body, "a.py", "python")], "function_id string, body string, file_path string, language string")
    assert doc_pairs(df).first().code == "def f(\n  a,\n):\n  'Sorts by age.'\n  return a"
