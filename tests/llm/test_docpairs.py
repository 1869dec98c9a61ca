import pytest

from lakeloom.llm import docpairs as D

GOOD = "Maps every archive to the dial that last touched it."


@pytest.mark.parametrize("doc,name,ok", [
    (f"/** {GOOD} */", "f", True), ("/// Returns nothing once the dune lapsed.", "x", True), ("// TODO: cover the empty case later please", "f", False), ('"""noqa: E501"""', "f", False), ("/** Annotate verge firepa. */", "annotateVergeFirepa", False),
    ("/// The merge levy makemu function.", "MergeLevyMakemu", False), ("/**\n * @param graph\n * @return\n */", "f", False), ("/** {@inheritDoc} */", "f", False), ("// ==================== f ====================", "f", False),
    ("// Licensed under the Bucket terms; see the file LICENCE for the full text.", "f", False), ("/// let edge = oldAcc(edge);\n/// return edge + 64;", "f", False), ("/// See above.", "f", False), ("# Liefert die Anzahl der Zeilen, die keinem urn gehören.", "f", True), ("", "f", False),
])
def test_telling(doc, name, ok):
    assert (D.said(doc, name) >= D.LEAST_WORDS) is ok


PY = f'''import os

# {GOOD}
def first(a, b=(1, 2)):
    return {{"x": "def no():"}}


class K:
    """A class that is not a function at all."""

    async def second(self, *,
                     rows=None) -> dict:
        r"""{GOOD}
        More of it.
        """
        def inner(x):
            \'\'\'Tries each sensor in turn and gives up.\'\'\'
            return x
        return inner

    def third(self):
        # {GOOD}
        return 1
'''
JS = f"""/* header comment of the whole file here */

const x = "function no() {{ // {GOOD}";

/**
 * {GOOD}
 */
@Deco()
export async function alpha(a, b = {{}}) {{
  // {GOOD}
  if (a) {{ beta(); }}
}}

class C {{
  // {GOOD}
  method(a: number[], b: string): Promise<void>
  {{
    for (;;) {{ }}
  }}
  plain() {{ return `}}`; }}
}}
// {GOOD}

function detached() {{}}
"""


def test_functions_in_files(spark):
    rows = [("p", "file", "a.py", "a.py", "python", PY, None), ("j", "file", "b.ts", "b.ts", None, JS, None), ("j", "file", "b.ts", "b.ts", None, JS, None), ("f", "function", "run", "x.go", "go", f"// {GOOD}\nfunc run() {{}}\n", " "),
            ("g", "method", "go", "x.rs", "rust", "fn go() {}", f"/// {GOOD}"), ("n", "function", None, "x.rs", "rust", f"/// {GOOD}\nfn z() {{}}", None), ("e", "function", "e", "x.rs", "rust", None, None), ("m", "file", "m.md", "m.md", "markdown", PY, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, chunk_type string, name string, module_path string, language string, content string, doc string, pos int")
    assert {tuple(r) for r in D.found(df).collect()} == {("p", "first"), ("p", "second"), ("p", "inner"), ("j", "alpha"), ("j", "method"), ("f", "run"), ("g", "go")}
    code = {(r["id"], r["name"]): r["code"] for r in D.pairs(df).collect()}
    assert code[("j", "alpha")].rstrip().endswith("if (a) { beta(); }\n}") and code[("p", "first")].strip().endswith('"def no():"}')
    assert "class C" not in code[("j", "alpha")] and code[("p", "inner")].strip().endswith("return x")
    assert D.found(df.limit(0)).count() == 0


PROBES = {
    "lines.ts": f"/** {GOOD} */\nexport function many(\n  a: number,\n  b: string,\n  c: Map<string, number>,\n  d = {{}},\n  e = {{ x: 1 }},\n  f = {{}},\n  g = [1],\n): void {{\n  run();\n}}\n",
    "Sign.java": f"class A {{\n  /**\n   * {GOOD}\n   */\n  @GetMapping(\"/x\")\n  @Deprecated\n  public List<String> load(\n      final int a,\n      final String b) throws IOException {{\n    return run(a);\n  }}\n}}\n",
    "Iface.java": f"interface B {{\n  /** {GOOD} */\n  int size(int a);\n  // {GOOD}\n  abstract String name();\n}}\n",
    "life.rs": f"/// {GOOD}\n#[inline]\npub fn pick<'a, 'b>(x: &'a str, y: &'b str) -> &'a str\nwhere\n    'b: 'a,\n{{\n    x\n}}\n",
    "three.go": f"// {GOOD}\nfunc three(a int, /* one */ b int, /* two */ c int) /* three */ error {{\n\treturn nil\n}}\n",
    "quoted.js": f"// {GOOD}\nfunction quoted(a = \"x\", b = '{{') {{ return a; }}\n// {GOOD}\nconst arrow = (x, y) => x + 1;\n// {GOOD}\nconst block = async (x) => {{ return x; }};\n",
    "Expr.kt": f"/** {GOOD} */\nfun twice(x: Int): Int = x * 2\n",
    "Expr.cs": f"class C {{\n    /// {GOOD}\n    [HttpGet(\"/x\")]\n    public int Twice(int x) => x * 2;\n}}\n",
    "mod.lua": f"-- {GOOD}\nlocal function lua_one(a, b)\n  return a\nend\n",
    "part.vue": f"<script>\nexport default {{\n  methods: {{\n    // {GOOD}\n    toggle(a) {{\n      this.x = a;\n    }},\n  }},\n}};\n</script>\n",
    "wrap.py": f"def wide(\n    a: dict[str, int],\n    b={{\"x\": 1}},\n) -> None:\n    \"\"\"{GOOD}\"\"\"\n    return None\n",
    "unknown.zzz": f"// {GOOD}\nint odd(int a) {{\n  return a;\n}}\n",
    "no.js": f"// {GOOD}\nfoo(bar);\n// {GOOD}\nreturn foo(x);\n// {GOOD}\nif (a) {{ b(); }}\nfoo(); // {GOOD}\nfunction plain() {{}}\n// {GOOD}\nclass K extends L(M) {{ }}\nx = new Y() {{ }};\n",
    "hash.sh": f"# {GOOD}\nrun_it() {{\n  echo \"${{1}}\"\n}}\n",
}
WANT = {"many", "load", "size", "name", "pick", "three", "quoted", "arrow", "block", "twice", "Twice", "lua_one", "toggle", "wide", "odd", "run_it"}


def test_headers_of_any_length_and_kind(spark):
    rows = [(p, "file", p, p, None, t, None) for p, t in PROBES.items()]
    df = spark.createDataFrame(rows, "id string, chunk_type string, name string, module_path string, language string, content string, doc string")
    got = {r["name"]: r for r in D.pairs(df).collect()}
    assert set(got) == WANT and {r["name"] for r in D.found(df).collect()} == WANT
    assert got["many"]["code"].startswith("export function many(") and got["many"]["code"].endswith("run();\n}")
    assert got["load"]["code"].endswith("return run(a);\n  }") and got["pick"]["code"].endswith("x\n}") and got["wide"]["code"].strip().endswith("return None")
    assert got["arrow"]["code"] == "const arrow = (x, y) => x + 1;" and got["twice"]["code"].strip() == "fun twice(x: Int): Int = x * 2"
    assert got["lua_one"]["code"].startswith("local function") and "return a" in got["lua_one"]["code"]


def test_null_and_very_long_texts(spark):
    long = "".join(f"// {GOOD}\nfunction f{i}() {{ return {i}; }}\n\n" for i in range(3000)) + "/* " + "word " * 50_000
    rows = [("a", "file", None, "a.js", None, None, None), ("b", "function", "g", None, None, None, GOOD), ("c", "file", "c", "c.js", None, "", None), ("d", "file", "d", "d.js", None, long, None), (None, "file", "e", "e.js", None, long, None)]
    df = spark.createDataFrame(rows, "id string, chunk_type string, name string, module_path string, language string, content string, doc string")
    out = D.pairs(df).collect()
    assert len(out) == 3001 and [r["code"] for r in out if r["id"] == "b"] == [None]
