from lodestone.extract import extract


def names(found):
    return [(s["name"], s["kind"], s["is_exported"]) for s in found["symbols"]]


def test_typescript():
    got = extract("tsx", "import d, { a as b } from 'x'\nimport * as ns from './n'\nexport const C = (p: P) => <div>{p.t}</div>\nexport default C\nexport class K { m() { go() } }\nexport type T = { a: string }\n")
    assert [(i["symbol"], i["from_path"]) for i in got["imports"]] == [("d", "x"), ("a", "x"), ("* as ns", "./n")]
    assert names(got) == [("C", "function", True), ("K", "class", True), ("T", "type", True)]
    assert {"callee_name": "go", "line": 5, "parent_symbol": "m"} in got["calls"]
    assert ("C", "default") in [(e["symbol"], e["kind"]) for e in got["exports"]]
    inner = extract("typescript", "export async function f(a: number): Promise<{ b: string }> {\n  return g(a)\n}\n")
    assert inner["symbols"][0]["end_line"] == 3 and inner["calls"][0]["parent_symbol"] == "f"


def test_python():
    got = extract("python", "from . import a as b\nX = 1\nasync def f(x):\n    return g(x)\nclass K:\n    def m(self): f(1)\ndef _p(): pass\n")
    assert names(got) == [("X", "variable", True), ("f", "function", True), ("K", "class", True), ("_p", "function", False)]
    assert got["symbols"][1]["signature"].startswith("async ")
    assert [(c["callee_name"], c["parent_symbol"]) for c in got["calls"]] == [("g", "f"), ("f", "m")]
    assert "broken" in extract("python", "def broken(:\n")["refs"]


def test_go():
    got = extract("go", 'package p\nimport (\n "fmt"\n x "a/b"\n)\nfunc (r *R) Do(a int) (int, error) {\n fmt.Print(a)\n}\ntype R struct{}\ntype I interface{ M() }\nconst (\n A = 1\n b = 2\n)\n')
    assert names(got) == [("R.Do", "function", True), ("R", "class", True), ("I", "interface", True), ("A", "variable", True), ("b", "variable", False)]
    assert [(i["symbol"], i["from_path"]) for i in got["imports"]] == [("fmt", "fmt"), ("x", "a/b")]
    assert ("fmt.Print", "R.Do") in [(c["callee_name"], c["parent_symbol"]) for c in got["calls"]]


def test_rust():
    got = extract("rust", "use std::a::{B, C as D};\npub use self::x::Y;\n/// one\n/// two\npub struct S<'a> { v: &'a str }\nimpl<'a> S<'a> {\n    pub fn new() -> Self { make!(1) }\n}\npub trait T { fn t(&self); }\nfn main() { let c = 'x'; S::new(); }\n")
    assert names(got) == [("S", "class", True), ("S.new", "function", True), ("T", "interface", True), ("main", "function", False)]
    assert got["symbols"][0]["doc"] == "/// one\n/// two"
    assert [(i["symbol"], i["from_path"]) for i in got["imports"]] == [("B", "std::a"), ("C", "std::a"), ("Y", "self::x")]
    assert [c["callee_name"] for c in got["calls"]] == ["make!", "S::new"]


def test_java():
    got = extract("java", "import a.b.C;\nimport a.d.*;\n/** Doc */\npublic class K {\n  public static final int MAX = 1;\n  int other;\n  public K(int a) {}\n  @Override public String m(List<String> x) { return x.get(0).trim(); }\n}\npublic interface I { void f(); }\n")
    assert names(got) == [("K", "class", True), ("K.MAX", "variable", True), ("K.K", "function", True), ("K.m", "function", True), ("I", "interface", True), ("I.f", "function", True)]
    assert [(i["symbol"], i["from_path"]) for i in got["imports"]] == [("C", "a.b.C"), ("*", "a.d")]


def test_csharp():
    got = extract("c_sharp", "using System.Text;\nnamespace N {\n  /// <summary>s</summary>\n  public class K {\n    public string P { get; set; } = \"\";\n    private int f = 1;\n    public K() { Run(new A()); }\n  }\n  public delegate void H(int a);\n  public struct V { }\n}\n")
    assert names(got) == [("K", "class", True), ("K.P", "variable", True), ("K.f", "variable", False), ("K.K", "function", True), ("H", "type", True), ("V", "class", True)]
    assert [(c["callee_name"], c["parent_symbol"]) for c in got["calls"]] == [("Run", "K.K"), ("A", "K.K")]


def test_unknown_language():
    assert extract("cobol", "x")["symbols"] == []
