"""The grammars on small texts; Python against the interpreter's own parser."""

import ast
import random

import pytest

from codeloom.llm.syntax import failure

GOOD = {
    ".py": "@a\nasync def f(x: int, /, *, y=1) -> int:\n    async with a as b, c:\n        return [i async for i in x if i]\n    match x:\n        case {'a': 1} if y:\n            pass\n",
    ".ts": "export default class A<T extends B> implements C { private x?: number = 1; get y(): string { return `a${this.x}` } }\ntype D = { [k: string]: number } | null\nconst f = async <T,>(a: T): Promise<T> => a as T\n",
    ".tsx": "const a = (\n  <ul className=\"x\">\n    {xs.map((x) => <li key={x.k}>{x.v}</li>)}\n  </ul>\n)\n",
    ".js": "import a, { b as c } from './x'\nlabel: for (const x of y) { if (/[a-z(]+/.test(x)) continue label }\n",
    ".go": "package a\n\nimport (\n\t\"fmt\"\n)\n\nfunc (s *A) B(x ...int) (int, error) {\n\treturn 0, fmt.Errorf(\"x\")\n}\n",
    ".rs": "#[derive(Debug)]\npub struct A<'a> { b: &'a str }\nimpl<'a> A<'a> { fn c(&self) -> char { 'x' } }\n",
    ".java": "package a;\n\nimport java.util.List;\n\npublic class A { @Override public int b(List<String> c) { for (var d : c) { e(d); } return 1; } }\n",
    ".c": "#include <a.h>\nstatic int a[] = {1, 2};\nint b(const char *c) { if (!c) { return -1; } return 0; }\n",
    ".cpp": "class A { public: int b() { return 0; } };\n",
    ".rb": "class A\n  def b(c)\n    return nil if c.nil?\n    c.each do |d|\n      e(d)\n    end\n  end\nend\n",
}


@pytest.mark.parametrize("ext", sorted(GOOD))
def test_good_text_parses_and_damage_does_not(ext):
    text = GOOD[ext]
    assert failure(text, ext) is None
    assert failure("", ext) is None
    assert failure(text.replace("\n", "\r\n"), ext) is None
    assert failure("<<<<<<< a\n" + text + "=======\n" + text + ">>>>>>> b\n", ext) is not None
    assert failure(text + "\n(", ext) is not None


def test_typescript_is_no_javascript():
    assert failure("function f(a: number) { return a }\n", ".js") is not None
    assert failure("function f(a: number) { return a }\n", ".ts") is None


def test_python_agrees_with_the_interpreter():
    rng = random.Random(3)
    for _ in range(300):
        lines = GOOD[".py"].split("\n")
        i = rng.randrange(len(lines))
        lines[i] = rng.choice(["", lines[i][1:], lines[i] + ")", lines[i].replace(":", ""), "    " + lines[i]])
        text = "\n".join(lines)
        try:
            ast.parse(text)
            good = True
        except SyntaxError:
            good = False
        assert (failure(text, ".py") is None) == good, text
