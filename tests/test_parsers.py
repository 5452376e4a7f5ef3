"""Parsers: names, types, returns and bases of each language; complexity; hostile files in linear time."""

import time

import pytest

from lexarray.operators.chunking import chunks_of, nested_chunks_of, parse_braces, parse_python


def walk(nodes):
    for n in nodes:
        yield n
        yield from walk(n.children)


def declared(text, language):
    return [(n.kind[:6], n.meta.get("class_name") or n.meta.get("function_name"), n.first, n.last) for n in walk(parse_braces(text, language))]


def meta(text, language):
    return next(walk(parse_braces(text, language))).meta


JS = """import a from 'a'
// class Fake { }
const text = `class No { ${ [1, 2].map((x) => { return `}${x}` }) } function no() {`
const pattern = /function f\\(\\) {"/g
export default class Box extends React.Component {
  size = 1
  static async load(url, { retry = 2 } = {}) {
    if (url) { return "}" } else if (retry) { return null }
    for (const x of url) { use(x) }
    for (let i = 0; i < 3; i++) { do { i++ } while (i < 2) }
    switch (url) { case 1: case 2: break }
    try { go() } catch (e) { }
    return url && retry ? 1 : 2
  }
  get width() { return this.size }
}
export const add = async (a, b) => {
  return a + b
}
function* gen(x) { yield x }
setTimeout(function () { run() }, 5)
items.map((x) => { return x })
"""


def test_javascript():
    assert declared(JS, "javascript") == [("class_", "Box", 5, 16), ("method", "load", 7, 14), ("method", "width", 15, 15), ("functi", "add", 17, 19), ("functi", "gen", 20, 20)]
    nodes = {n.meta.get("function_name") or n.meta.get("class_name"): n.meta for n in walk(parse_braces(JS, "javascript"))}
    assert nodes["Box"]["inheritance_chain"] == ["React.Component"]
    assert nodes["load"]["complexity_score"] == 1 + 2 + 1 + 1 + 2  # two ifs, one for with semicolons, a switch, a try and its catch
    assert nodes["load"]["function_signature"] == "static async load(url, { retry = 2 } = {})"


def test_typescript():
    m = meta("export async function find<T extends Base>(a: Map<string, T[]>, b: (x: number) => void, c?: string, d: number = 2): Promise<Array<T>> {\n}\n", "typescript")
    assert (m["function_name"], m["parameter_types"], m["return_type"]) == ("find", ["Map<string, T[]>", "(x: number) => void", "number"], "Promise<Array<T>>")
    c = meta("abstract class Store<T extends Base> extends Model<T> implements A<T, U>, B {\n  get(id: number): T | null {\n  }\n}\n", "typescript")
    assert (c["class_name"], c["inheritance_chain"], c["interfaces"]) == ("Store", ["Model"], ["A<T, U>", "B"])
    arrow = meta("const load = async (x: number): Promise<void> => {\n}\n", "typescript")
    assert (arrow["function_name"], arrow["parameter_types"], arrow["return_type"]) == ("load", ["number"], "Promise<void>")
    assert meta("interface Shape extends A, B {\n}\n", "typescript")["inheritance_chain"] == ["A", "B"]


def test_java():
    text = 'package x;\n@Entity(name = "t{")\npublic final class Repo<T extends Item> extends Base<T> implements Closeable, Comparable<Repo<T>> {\n  private int[] sizes = {1, 2};\n  @Override\n  public Map<String, List<T>> load(final String name, List<Map<String, T>> rows, int... n) throws IOException {\n    if (name.isEmpty()) { return null; }\n    new Thread(new Runnable() { public void run() { go(); } });\n    String block = """\n      class Fake {\n      """;\n    return null;\n  }\n  Repo(int size) { }\n}\n'
    found = list(walk(parse_braces(text, "java")))
    assert [(n.meta.get("class_name") or n.meta.get("function_name"), n.first, n.last) for n in found] == [("Repo", 2, 15), ("load", 5, 13), ("run", 8, 8), ("Repo", 14, 14)]
    assert (found[0].meta["inheritance_chain"], found[0].meta["interfaces"]) == (["Base"], ["Closeable", "Comparable<Repo<T>>"])
    assert (found[1].meta["parameter_types"], found[1].meta["return_type"]) == (["String", "List<Map<String, T>>", "int..."], "Map<String, List<T>>") or found[1].meta["parameter_types"] == ["String", "List<Map<String, T>>", "int..."]
    assert found[1].meta["return_type"] == "Map<String, List<T>>" and found[3].meta["return_type"] is None


def test_go():
    text = "package x\n\ntype Server struct {\n\tname string\n}\n\ntype Doer interface {\n\tDo() error\n}\n\nfunc (s *Server) Get(ctx context.Context, a, b int, f func(int) error) (map[string]int, error) {\n\tx := `func No() {`\n\tif s.name == \"{\" {\n\t\treturn nil, nil\n\t}\n\treturn nil, nil\n}\n\nfunc Any[T any](v T) interface{} {\n\treturn v\n}\n"
    found = list(walk(parse_braces(text, "go")))
    assert [(n.meta.get("class_name") or n.meta.get("function_name"), n.first, n.last) for n in found] == [("Server", 3, 5), ("Doer", 7, 9), ("Get", 11, 17), ("Any", 19, 21)]
    assert (found[2].meta["parameter_types"], found[2].meta["return_type"]) == (["context.Context", "int", "func(int) error"], "(map[string]int, error)")
    assert found[3].meta["return_type"] == "interface{}"


def test_rust():
    text = "#[derive(Debug)]\npub struct Point<'a> {\n    name: &'a str,\n}\n\nimpl<'a, T: Show> Point<'a> {\n    pub(crate) fn near<F>(&self, other: &Point<'a>, f: F) -> Result<Vec<u8>, std::io::Error>\n    where\n        F: Fn(u8) -> bool,\n    {\n        let c = '{'; let r = r#\"fn no() {\"#;\n        match c { '{' => {} _ => {} }\n    }\n}\n\ntrait Show {\n    fn show(&self) -> String { String::new() }\n}\n"
    found = list(walk(parse_braces(text, "rust")))
    assert [(n.meta.get("class_name") or n.meta.get("function_name"), n.first, n.last) for n in found] == [("Point", 2, 4), ("Point", 6, 14), ("near", 7, 13), ("Show", 16, 18), ("show", 17, 17)]
    assert (found[2].meta["parameter_types"], found[2].meta["return_type"]) == (["&Point<'a>", "F"], "Result<Vec<u8>, std::io::Error>")


@pytest.mark.parametrize(("body", "score"), [
    ("    if a:\n        pass\n    elif b:\n        pass\n    elif c:\n        pass\n", 2),
    ("    if a:\n        pass\n    else:\n        if b:\n            pass\n", 3),
    ("    match a:\n        case 1:\n            pass\n        case _:\n            pass\n", 3),
    ("    try:\n        x = 1 if a and b else 2\n    except E:\n        pass\n", 3),
    ("    return [x for x in a if x or b]\n", 1),
])
def test_complexity_of_python(body, score):
    assert parse_python("def f(a, b, c):\n" + body)[0].meta["complexity_score"] == score


def test_docstrings_by_position():
    text = "# é\ndef f():\n    '''Één\n    line'''\n    é = 'x'; return é\n"
    assert parse_python(text)[0].meta["docstring"] == "Één\n    line"


HOSTILE = {
    "braces": ("javascript", lambda n: "function f(a) { return a }\n" * n),
    "python": ("python", lambda n: 'def f(a):\n    """Doc."""\n    return a\n' * n),
    "open strings": ("java", lambda n: '"' * n + "\n" + "'\n" * n + "/*" * n),
    "open brackets": ("go", lambda n: "func f(" * n),
    "nested": ("rust", lambda n: "fn f() {" * 500 + "}" * 500 + "let x = 1;\n" * n),
    "templates": ("typescript", lambda n: "`${" * n),
    "lines without an end": ("javascript", lambda n: "a b (c) [d] < " * n),
    "fors": ("javascript", lambda n: "for (" * n),
    "closing": ("javascript", lambda n: "}" * n + ")" * n + "({[" * n + ")" * n),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_grows_with_the_text(name):
    language, make = HOSTILE[name]
    took = []
    for n in (2500, 10_000):
        text, t = make(n), time.perf_counter()
        chunks_of(text, language)
        nested_chunks_of(text, language)
        took.append(time.perf_counter() - t)
    assert took[1] < 10 and took[1] < 10 * max(took[0], 0.3), took
