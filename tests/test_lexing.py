"""The lexer and the scanners over nested scopes."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engram.operators import lexing as L
from engram.operators import symbols as SY

CASES = [
    ("script", 'const s = "}"; // {\nx = /[/}]{2}/g.test(a) / b / c;', 'const s = "~";     \nx = /~~~~~~~~g.test(a) / b / c;'),
    ("script", "y = `a ${f(`{${\"}\"}`)} }` + 'q\\'}'", "y = `~~~~~~~~~~~~~~~~~~~` + '~~~~'"),
    ("script", "<p>don't</p> <br /> {a}\n/* {\n} */ b", "<p>don't</p> <br /> {a}\n    \n     b"),
    ("script", "a = `${ {a: {b: '}'}} }{`; c", "a = `~~~~~~~~~~~~~~~~~~~`; c"),
    ("go", "s := \"}\" + `{\n` + '{' // {", "s := \"~\" + `~~` + '~'     "),
    ("rust", "fn f<'a>(x: &'a str) { let c = '{'; r#\"}\"{\"#; /* a /* { */ } */ \"{\n}\" }", "fn f<'a>(x: &'a str) { let c = '~'; r~~~~~~#;                   \"~~~\" }"),
    ("rust", "b'\\'' '\\u{7d}' 'static", "b'~~' '~~~~~~' 'static"),
    ("python", 'x = """ { \n""" # {\ny = \'it\' "a"', 'x = "~~~~~~~~"    \ny = \'~~\' "~"'),
    ("script", "a `never closed {", "a `~~~~~~~~~~~~~~"),
    ("go", "", ""),
]


@pytest.mark.parametrize("language,text,want", CASES)
def test_masked(language, text, want):
    assert L.masked(text, language).replace(L.FILL, "~") == want


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="{}()[]'\"`/*\\\n #$r=a;", max_size=60), st.sampled_from(["script", "go", "rust", "python"]))
def test_masked_keeps_every_place(text, language):
    got = L.masked(text, language)
    assert len(got) == len(text)
    assert all(g == t or g in (L.FILL, " ") or t in "\"'`/#" for g, t in zip(got, text, strict=True))
    for p, q in L.brackets(got).items():
        assert L.OPENS[got[p]] == got[q] and q > p
    for name in {"script": ("a.ts",), "go": ("a.go",), "rust": ("a.rs",), "python": ("a.py",)}[language]:
        for r in SY.parse_symbols(name, text):
            assert 1 <= r[3] <= r[4] <= text.count("\n") + 1


def names(path, text):
    return [(r[1], r[2], r[3], r[4]) for r in SY.parse_symbols(path, text)]


def test_braces_that_are_no_code():
    assert names("a.ts", 'function f() {\n  const s = "}";\n  late();\n  return s;\n}\nclass A {\n  x = "{";\n}\nfunction g() {}\n') == [("f", "function", 1, 5), ("A", "class", 6, 8), ("g", "function", 9, 9)]
    assert names("a.go", 'func F() string {\n\ts := "}"\n\treturn s\n}\n// {\nfunc G() {\n}\nfunc H() {}\n') == [("F", "function", 1, 4), ("G", "function", 6, 7), ("H", "function", 8, 8)]
    assert names("a.js", "function a() {}\nfunction b() {\n  /* { */\n}\nfunction c() { return 3; }") == [("a", "function", 1, 1), ("b", "function", 2, 4), ("c", "function", 5, 5)]


def test_scopes():
    text = "namespace N {\n  export namespace M { export const C = 1; export class K { a() { return one(); } } }\n  function f() { function not_listed() {} }\n}\n"
    assert names("a.ts", text) == [("C", "constant", 2, 2), ("K", "class", 2, 2), ("K.a", "method", 2, 2), ("f", "function", 3, 3)]
    text = "mod a {\n    #[test]\n    fn b() {}\n    impl C for D<E> { #[inline] pub fn e(&self) { if x { f(); } } }\n}\n"
    assert names("a.rs", text) == [("b", "function", 3, 3), ("D.e", "method", 4, 4)]


def test_heads():
    rows = {r[1]: r for r in SY.parse_symbols("a.ts", "class A {\n  @Dec({ a: '}' }) private async b(x: number,\n    y = '(') : Promise<{ z: T }> {\n    return 1;\n  }\n  get c(): string { return `${this.d}`; }\n  d = () => { no(); };\n  constructor() {}\n  if(x) { }\n}\n")}
    assert set(rows) == {"A", "A.b", "A.c"} and rows["A.b"][3:5] == (2, 5)
    meta = json.loads(rows["A.b"][8])
    assert meta["isAsync"] and meta["visibility"] == "private" and [d["name"] for d in meta["decorators"]] == ["Dec"] and [p["name"] for p in meta["parameters"]] == ["x", "y"]
    arrows = "const a = (\n  x: number,\n  y: string\n): number => x +\n  y;\nconst b = 1;\nexport const c: Map<string, () => void> = f(\n  2);\nconst d: (n: number) => void = (n) => {};\nconst e = memo(() => null);\nlet g = async n => n;\n"
    assert names("a.ts", arrows) == [("a", "function", 1, 5), ("c", "constant", 7, 8), ("d", "function", 9, 9), ("e", "component", 10, 10), ("g", "function", 11, 11)]
    assert names("a.go", "type (\n\tS struct {\n\t\ta int `json:\"{\"`\n\t}\n\tN = string\n)\nfunc G() interface{} { return 1 }\nvar x = map[string]int{\n\t\"}\": 1,\n}\n") == [
        ("S", "class", 2, 4), ("N", "type", 5, 5), ("G", "function", 7, 7), ("x", "variable", 8, 10)
    ]
    assert json.loads(SY.parse_symbols("a.go", "func G() interface{} { return 1 }")[0][8])["returnType"] == "interface{}"


def test_calls_are_code(spark):
    files = [("a.ts", 'function f() { // lost(1)\n  return real("fake(2)", `${more}`, /re(3)/);\n}'), ("a.py", 'def f():\n    """doc(1)"""\n    return real("fake(2)")  # lost(3)\n'), ("a.rs", 'fn f() { real(r"fake(1)"); }'), ("b.txt", "x"), ("c.ts", None)]
    got = {r.path: r.calls for r in SY.symbols_of(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"a.ts": "real", "a.py": "real", "a.rs": "real"}
