"""Parsers, hand-written files, markup, splitting, tokens: functions that work on one text."""

import random

import pytest

from corpusloom.llm import bpe, handwritten, markup, splitting, syntax
from corpusloom.llm.parsing import examined, faults

SOUND = {
    "a.py": "import x\n\n@d\nasync def f(a, *b, c: int = 1, **k) -> int:\n    match a:\n        case {'k': [1, *_]} if b:\n            return [i async for i in z if i]\n    try:\n        x = lambda *a: (yield)\n    except* E as e:\n        raise\n    with (open(f'{a!r:>{w}}') as g, h):\n        del a[1:2, ...]\n    return not a in b is not c if d else e\n",
    "a.ts": "import type { A } from './a';\nexport default class B<T extends keyof A = {}> extends C<T>[0] implements D { private readonly x?: string[] = []; get y(): number { return this.x!.length } static { f() } }\nconst f = async <T,>(a: T, { b = 1, ...c }: any): Promise<T> => { for (const [k, v] of m) if (a < b) { x = y as unknown as Map<string, number[]> } return `a${b ? `${c}` : '}'}` }\ntype U = { [K in keyof T]?: T[K] } & (() => void) | 'a'\nlabel: while (true) break label\nx = a / b / c; y = /[/]/g.test(z)\n".replace("C<T>[0]", "C<T>"),
    "a.go": "package a\n\nimport f \"fmt\"\n\ntype T[K comparable] struct {\n\tA, B int `json:\"a\"`\n\t*C\n}\n\nfunc (t *T[K]) m(a ...int) (x int, err error) {\n\tif v, ok := t.x[\"a\"]; ok && v == (P{1}) {\n\t\tgo func() { <-c }()\n\t}\n\tfor i := range 10 {\n\t\tswitch y := x.(type) {\n\t\tcase int, []string:\n\t\t\tcontinue\n\t\t}\n\t}\n\tselect {\n\tcase c <- 1:\n\tdefault:\n\t}\n\treturn map[string][]int{\"a\": {1, 2}}[\"a\"][0], nil\n}\n",
    "a.rs": "#![allow(x)]\nuse a::{b, c as d, e::*};\npub(crate) async fn f<'a, T: Fn(&str) -> Option<T> + 'a>(x: &'a mut [u8; 4]) -> Result<(), Box<dyn E>> where T: Sized {\n    let Some(y) = x.get(0) else { return Err(\"a\".into()) };\n    let z = match y { 1..=3 | 5 if true => |a: i32| a + 1, Foo { a, .. } => { loop { break 'l 3 } } _ => unsafe { *p }, };\n    for i in (0..n).rev() { if i == S { a: 1 }.a {} }\n    vec![1, 2].iter().map(|&x| x as u64).collect::<Vec<_>>()?;\n    Ok(())\n}\nmacro_rules! m { ($x:expr) => { $x } }\n".replace("if i == S { a: 1 }.a {}", "if i == (S { a: 1 }).a {}").replace("{ loop { break 'l 3 } } _", "{ loop { break 3 } } _"),
    "a.java": "package a.b;\nimport static a.B.*;\n@X(y = {1, 2})\npublic sealed interface A<T extends B & C> permits D {\n  enum E { P(1) { int f() { return 2; } }, Q; }\n  record R(int a, String... b) { R { if (a > 0) throw new X(); } }\n  default <U> Map<String, List<U>> m(final int[] a) throws Y {\n    for (var x : xs) { int y = (int) z >>> 2; }\n    Runnable r = () -> { synchronized (this) { i++; } };\n    return switch (o) { case String s when s.isEmpty() -> null; case 1, 2 -> { yield a::b; } default -> (A & B) c; };\n  }\n}\n",
    "a.c": "#include <a.h>\n#define X(a) \\\n  a\ntypedef struct s { int a : 3; union { char b; } u; } S;\nstatic const char *const t[] = { [0] = \"a\" \"b\", };\nint (*f(void))(int);\nint g(int a, ...) { int (*p)[3] = (int (*)[3]) q; do { a = b ? c : -d; } while (a--); switch (a) { case 1 ... 2: goto x; default: ; } x: return sizeof(struct s) * (a); }\n",
    "a.cc": "#include <a>\nnamespace a::b { template <typename T, int N = (1 > 0)> class C : public D<T> { public: explicit C(int a) : x(a), y{1} {} ~C() = default; virtual int f() const override; operator bool() const { return true; } private: std::map<int, std::vector<T>> m; }; }\nauto g = [&](auto x) -> int { for (const auto& [k, v] : m) { delete[] p; } return static_cast<int>(x); };\n",
    "a.sh": "#!/bin/sh\nset -e\nf() { local a=\"${1:-$(echo \"x)\" | sed 's/(//')}\"; }\ncase $x in a|b) echo 1 ;; *) if [[ $a == b && -z $c ]]; then :; fi ;; esac\nfor ((i=0; i<3; i++)); do echo $((i + (1))); done\ncat <<-'E' > f\n\tif (\n\tE\narr=(a \"b c\" # x\n)\nwhile read -r l; do echo ${l//(/x}; done < <(cat f) || { exit 1; }\n",
    "a.css": "@charset \"a\";\n@media (min-width: 1px) and (a) { .a:not(.b)::after, #c > d[e=\"}\"] { color: rgb(1 2 3 / 50%) !important; --x: { a } ; } }\n/* } */\n.a { &:hover { b: url(data:a;b,c) } background: #fff }\n@import url(x.css);\n",
}
BROKEN = {
    "b.py": ["def f(:\n  pass\n", "x = (1\n", "<<<<<<< HEAD\na = 1\n=======\na = 2\n>>>>>>> b\n", "if a:\nb\n", "s = 'x\n", "x = 012\n", "a b\n", "import {a} from 'b'\n"],
    "b.ts": ["function f( {", "const x = ;", "=======\n", "def f(a):\n    return 1\n", "let a = `x${", "class A { x y }"],
    "b.go": ["", "// x\n", "package a\nfunc f() {", "package a\nx := 1\n", "package a\nfunc f() { a b }\n"],
    "b.rs": ["fn f( {}", "fn f() { let x = ; }", "pub fn f() -> { }", "x = 1;", "fn f() { \"a }"],
    "b.java": ["class A {", "class A { int f( { } }", "class A { void f() { a + b; } }", "int x = 1 2;", "class A { char c = 'ab'; }"],
    "b.c": ["int f( {", "int f() { return }", "int f() { if a { } }", "#if X\nint a;\n", "int a = 'x;", "# a note\nint a;\n", "#!/bin/sh\n"],
    "b.hpp": ["class A { int x }", "namespace a {", "int f() { x y z; }"],
    "b.bash": ["if a; then b\n", "f() { a\n", "echo $(a\n", "case x in a) b\n", "echo 'a\n", "a | | b\n", "for x in; echo\n"],
    "b.css": [".a { b: c;", ".a { b: c; }}", "a b", ".a { b }", "/* x", ".a { << }"],
}


#: Python that the language's own parser refuses, and takes.
REFUSED = [
    'f(a=1, 2)',
    'f(**k, *a)',
    'f(**k, 2)',
    'def f(a=1, b): pass',
    'def f(*a, *b): pass',
    "x=f'{a b}'",
    'x := 1',
    'del f()',
    'if x:\n        a\n\tb',
    "'\\N{bad'",
    'def f(*): pass',
    'def f(**k, a): pass',
    'f(x for x in y, 1)',
    'lambda a=1, b: 0',
    'y = x := 1',
    'f() = 1',
    'a + b = 1',
    '1 = x',
    'for f() in x: pass',
    'f() += 1',
    '(a, b) += 1',
    'a, b: int',
    'del a + b',
    "f'{x!z}'",
    "f'{}'",
    "'\\x1'",
    'None = 1',
    'x = (yield) = 1',
    'def f(/, a): pass',
    'def f(*, **k): pass',
    'return x := 1',
    "f'{a:{b c}}'",
    "f'{a'",
    '[x for x in y] = 1',
    "'a' = 1",
    'lambda *: 0',
    'with f() as g(): pass',
    "print 'a'",
    'del *a',
]
TAKEN = [
    'f(1, *a, b=2, *c, **d)',
    'f(a=1, *b)',
    'def f(a, b=1, *c, d, e=2, **g): pass',
    'def f(a, /, b, *, c): pass',
    'x=f\'{a}{b!r:>{w}}{c=}{d["k"]}{e.f()}{g+1:.2f}{h!s}\'',
    '(x := 1)',
    'if (y := f(x)) and z: pass',
    'del a, b[0], c.d, (e, f), [g]',
    'if x:\n\ta\n\tb\nc',
    "'\\N{EM DASH}'",
    "f'\\N{EM DASH} {x}'",
    'a, *b = c',
    '[a, b] = c',
    '(a) = 1',
    'a.b[c].d = e = f',
    'for a, (b, *c) in d: pass',
    'f(x for x in y)',
    'f(x for x in y)',
    'lambda: 0',
    'lambda a, *b, c=1, **d: 0',
    'lambda *, a: 0',
    'x: int = 3',
    'a.b: int',
    'a[1]: int = 2',
    'x = yield',
    "f'{x:%Y-%m}'",
    "f'{ {1:2}[1] }'",
    'f"{x[\'a\']}"',
    "f'''{\na\n}'''",
    "rf'\\d{x}'",
    "f'{x!r}'",
    "f'{(lambda y: y)(1)}'",
    "f'{a if b else c}'",
    "print(f'{x}', sep='')",
    "f'{{}}'",
    "b'\\N'",
    'async def f():\n    async for x in y: pass\n    return [z async for z in w]',
    'with (a as b, c as d): pass',
    'with open(a) as f.g, h() as (i, j): pass',
    "match x:\n    case {'a': 1, **r}: pass",
    'match (y := 1):\n    case _: pass',
    'def f(*args: *Ts): pass',
    'x[a:=1]',
    "{**a, 'b': 1}",
    '() = x',
    'a = b = c, d = e',
    '*a, = b',
    "f'{x}' f'{y}'",
    'assert (a, b)',
    "f'{x:{y}.{z}}'",
    "f'{x,}'",
    "f'{*a,}'",
    "f'{yield}' if 0 else 1",
    'x = a if b else c',
    'global x, y',
    'return',
    'x = *a, b',
    "print(*a, sep='')",
    'def f(a, b=1, *, c): pass',
    'f(a)(b)[c].d = 1',
    '(a).b = 1',
    "'a'.b = 1",
    "{}['a'] = 1",
    "f'{a!r:^{w}}'",
    'x = not a in b',
    "f'{x:\\n}'",
    "f'({', '.join(a)})'",
    "rf'(\\{{%)({x})'",
]
#: Constructs of other languages: sound ones, then faults.
OTHERS = [
    ('a.java', 'class T { void f(Object o) { int y = switch (o) { case A(int x) when x > 0 -> x; default -> 0; }; } }'),
    ('a.java', 'class T { void f(Object o) { switch (o) { case A a when x -> g(1); case B b when (y) -> g(2); case FOO -> g(3); case A(B(var q), int z) r when r.ok(k -> k > 1) -> g(4); default -> { } } } }'),
    ('a.java', 'class T { void f(Object o) { switch (o) { case 1: case 2: g(x -> x); break; default: } } }'),
    ('a.java', 'class T { void f(Object o) { Runnable r = () -> { }; F f = (a, b) -> a + b; g(x -> x); } }'),
    ('a.java', 'class T { void f(Object o) { switch (o) { case String s when s.length() > 2 && (s.isEmpty()) -> g(); default -> g(); } } }'),
    ('a.java', 'class T { void f(Object o) { int z = a ? (b) : c; switch (o) { case A when -> g(); default -> g(); } } }'),
    ('a.cc', 'template<class T> requires C<T> auto f(T t) { return t; }'),
    ('a.cc', 'template<class T> concept C = requires(T t) { t.f(); { t.g() } -> D; };'),
    ('a.cc', 'template<class T> concept C = A<T> && (B<T> || !D<T>);'),
    ('a.cc', 'template<class T> void f(T t) requires C<T> { }'),
    ('a.cc', 'auto f(C auto x) { return requires { x.f(); }; }'),
    ('a.cc', 'template<typename T> requires requires(T t) { t(); } struct S { };'),
    ('a.c', 'int f(a,b) int a; char b; { return a; }'),
    ('a.c', 'static char *g(s, n)\nconst char *s;\nunsigned n;\n{ return 0; }'),
    ('a.c', 'int f(int a);\nint g(void) { return 1; }'),
    ('a.c', 'int x = ((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((((1))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))))));'),
    ('a.ts', 'let x = a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : a ? b : c;'),
]
OTHER_FAULTS = [
    ('a.java', 'class T { void f(Object o) { switch (o) { case A a when -> g(); } } }'),
    ('a.c', 'int f(int a)\nint g(void) { return 1; }'),
    ('a.cc', 'template<class T> concept C = ;'),
    ('a.c', 'int f(a) int a {'),
    ('a.java', 'class T { void f(Object o) { int y = switch (o) { case A(int x when x -> 1; }; } }'),
]


@pytest.mark.parametrize("text", REFUSED + TAKEN)
def test_python_against_its_own_parser(text):
    try:
        compile(text, "x", "exec")
        sound = True
    except SyntaxError as e:
        sound = "outside" in str(e) or "await" in str(e)  # faults of names, not of grammar
    assert (not faults("a.py", text)) == sound == (text in TAKEN)


@pytest.mark.parametrize("path,text", OTHERS + OTHER_FAULTS)
def test_other_constructs(path, text):
    assert bool(faults(path, text)) == ((path, text) in OTHER_FAULTS)


@pytest.mark.parametrize("path", SOUND)
def test_sound(path):
    assert faults(path, SOUND[path]) == [] and faults(path, "﻿" + SOUND[path].replace("\n", "\r\n")) == []
    assert path == "a.go" or faults(path, "") == faults(path, None) == []


@pytest.mark.parametrize("path,text", [(p, t) for p, ts in BROKEN.items() for t in ts])
def test_broken(path, text):
    assert faults(path, text)


def test_parsers_survive_anything():
    rng = random.Random(3)
    for path, text in SOUND.items():
        for _ in range(150):
            i, j = sorted((rng.randrange(len(text)), rng.randrange(len(text))))
            faults(path, text[:i] + rng.choice(["", "{", "(", '"', "`", "<", "'", "\\", "case"]) + text[j:])
        for nest in ("(" * 3000, "{" * 3000, "[" * 500 + "]" * 500, "a(" * 400, "if (" * 400, "x = (a = " * 200):
            faults(path, nest)


def test_deep_files_are_sound():
    chain = lambda first, more, n=800: first + "".join(f" else if {m}" for m in [more] * n)
    texts = {
        "a.ts": chain("if (a) { b() }", "(a) { b() }"), "a.c": "int f(int a) {" + chain("if (a) { g(); }", "(a) { g(); }") + "}", "a.cc": "int f(int a) {" + chain("if (a) { g(); }", "(a) { g(); }") + "}",
        "a.java": "class A { void f() {" + chain("if (a) { g(); }", "(a) { g(); }") + "} }", "a.go": "package a\nfunc f() {\n" + chain("if a { g() }", "a { g() }") + "\n}\n", "a.rs": "fn f() { " + chain("if a { g() }", "a { g() }") + " }",
    }
    for path, text in texts.items():
        assert faults(path, text) == [], path
        assert faults(path, text.replace("else if", "else if if", 1)), path
    for nest in (150, 1500):
        for path, text in {"b.ts": "x = {}", "b.go": "package a\nvar x = {}\n", "b.java": "class A {{ int x = {}; }}", "b.c": "int x = {};", "b.rs": "const X: i32 = {};"}.items():
            assert examined(path, text.format("(" * nest + "1" + ")" * nest)) == ([], None), (path, nest)
            assert faults(path, text.format("(" * nest + "1" + ")" * (nest - 1))), (path, nest)
    for levels in (95, 99, 100):
        assert bool(faults("c.py", "".join(" " * i + "if a:\n" for i in range(levels)) + " " * levels + "x\n")) == (levels > 99)
    assert faults("c.py", "x = " + "(" * 200 + "1" + ")" * 200 + "\n") == [] and faults("c.py", "x = " + "(" * 201 + "1" + ")" * 201 + "\n")


def test_limits_leave_files_undecided():
    nest = 20_000
    found, limit = examined("a.java", "class A { int x = " + "(" * nest + "1" + ")" * nest + "; }")
    assert found == [] and limit == "nesting too deep"
    found, limit = examined("a.java", "class A { int x = " + "(" * nest + "1; }")
    assert found and limit


def test_causes():
    cause = lambda p, t: syntax.first_cause(t, faults(p, t))
    assert cause("a.py", "x = 1\n<<<<<<< HEAD\n") == "conflict" and cause("a.c", "int f() {\n  a();\n") == "cut off"
    assert len(faults("a.c", "int f() { return }\nint g() { if ; }\n")) == 2  # all faults, not the first only
    assert faults("a.js", "x") is None


def test_late_header_lines():
    licence = "".join(f"// Licence, clause {i}.\n" for i in range(90))
    kind = lambda head: (handwritten.layout_kind("r/src/a.go", licence + head + "\npackage a\n\nfunc f() {}\n") or (None,))[0]
    assert kind("// Code generated by tool. DO NOT EDIT.\n") == "generated" and kind("// vendored from x\n") == "vendored"
    assert kind("// Once made by a tool: do not edit the table. Maintained by hand.\n") is None and kind("") is None


def test_layout_kinds():
    kind = lambda p, c: (handwritten.layout_kind(p, c) or (None,))[0]
    code = "def walk(tree):\n    for node in tree:\n        yield node.name\n\n\nclass Queue:\n    def push(self, item):\n        self.items.append(item)\n"
    assert kind("r/src/a.py", code) is None and kind("r/src/a.py", None) is None and kind("r/a", "") is None
    assert kind("r/src/a.py", "# Code generated by x v1. DO NOT EDIT.\n" + code) == "generated"
    assert kind("r/src/a.py", "# Was generated once by x, maintained by hand since.\n" + code) is None
    assert kind("r/src/a.py", code + 'H = "// @generated by x, do not edit"\n') is None
    assert kind("r/src/a.py", "# Copyright the other authors.\n" + code) is None
    assert kind("r/vendor/lib/a.py", code) == "vendored" and kind("r/vendors/a.py", code) is None
    assert kind("r/src/a.py", "# This file is part of libx, release 1.2.3.\n" + code) == "vendored"
    assert kind("r/src/a.js", "var a=1;" + "function f(x,n){return x&&n.p(x)||!1}" * 40) == "minified"
    assert kind("r/src/a.go", "package x\n\nvar d = []byte{\n" + "    0x96, 0x43, 0x04, 0xff,\n" * 40 + "}\n") == "data"
    assert kind("r/src/a.py", "".join(f"def get_{k}(m):\n    return m[{k}]\n\n" for k in range(9))) == "generated"
    assert kind("r/src/a.py", 'Q = "' + "select a from b where c " * 40 + '"\n' + code) is None
    # names of directories alone say nothing, unless they hold packages
    assert [kind(p, code) for p in ("r/deps/a.py", "r/gen/a.py", "r/static/js/app.js", "r/deps/lib/a.py")] == [None, None, None, "vendored"]
    assert kind("r/src/a.py", "# built by make\n" + code) is None and kind("r/src/a.py", "# built by make tables, see tables.in\n" + code) == "generated"
    assert kind("r/src/a.sh", "#!/bin/sh\nset -eu\n\n# Code generated by x. DO NOT EDIT.\necho\n") == "generated"
    # data of any size
    assert [kind("r/a.py", t) for t in ('[{"a": 1}]', '{"a": [1, 2', "[]", "[x]", "x = [1, 2]", "{ int a; }", "")] == ["data", "data", "data", None, None, None, None]
    assert kind("r/a.sh", "cat <<'E'\n" + ("QUJD" * 18 + "\n") * 9 + "E\n") == "data"


MARKUP = [
    ("**kwargs and *args, 2 * 3 * 4, \\d+\\s*\\w, a < b && c > d, List<String>, std::vector<int>, <file> <port>, $5 and $7, $HOME and $X, C:\\temp\\new\\title, x[0][i], see [2], __init__, a == b", []),
    ("text\n\nint f(int *a) {\n    a[0] = 1; /* ** */\n}", []),
    ("a&nbsp;b", ["html"]), ("<!-- x -->a", ["html"]), ("a<br/>b", ["html"]), ("<A HREF=x>y</A>", ["html"]),
    ("# Title", ["markdown"]), ("Title\n=====", ["markdown"]), ("a `b` c", ["markdown"]), ("**b** and *c*", ["markdown"]), ("[a](b.md)", ["markdown"]), ("```\n<b>\n```", ["markdown"]), ("|a|b|\n|-|-|\n|1|2|".replace("|-|-|", "|---|:--|"), ["markdown"]), ("> q", ["markdown"]),
    ("== A ==\nb", ["wiki"]), ("'''a''' is", ["wiki"]), ("[[ab|b]]", ["wiki"]), ("{{Note|x}}", ["wiki"]), ("{| class=x\n|-\n| 1 || 2\n|}", ["wiki"]),
    ("\\section{A}", ["latex"]), ("costs $O(n^2)$", ["latex"]), ("\\[ \\frac{a}{b} \\]", ["latex"]), ("\\begin{verbatim}\n<b>\n\\end{verbatim}", ["latex"]), ("see~\\ref{x}", ["latex"]),
    ("<b>a</b> and '''b'''", ["html", "wiki"]), ("", []), (None, []),
]


@pytest.mark.parametrize("text,kinds", MARKUP)
def test_markup_kinds(text, kinds):
    assert sorted(markup.Document(text).kinds) == kinds
    assert sorted(markup.Document(f"Docset: X <y> (x)\r\nPage: `p`\r\nPath: a\r\n\r\n{text or ''}").kinds) == kinds


def test_markup_text():
    d = markup.Document("# T *x*\n\n- a\n- b\n\n```py\nx  = `1`\n```\n\n<ul><li>c</li><li>d</li></ul>\n\n$$a_1 \\le b$$\n\nSee [l](u) &amp; \\emph{e}.")
    assert [(n[3], n[4], n[5], n[6]) for n in d.nodes if n[4]] == [
        ("/section1/heading1", "heading1", "T x", "markdown"), ("/section1/list/item", "list", "- a", "text"), ("/section1/list/item", "list", "- b", "text"), ("/section1/code", "code", "x  = `1`", "markdown"),
        ("/section1/list/ul/li/item", "list", "- c", "html"), ("/section1/list/ul/li/item", "list", "- d", "html"), ("/section1/formula", "formula", "a_1 \\le b", "latex"), ("/section1/paragraph", "paragraph", "See l & e.", "html+latex+markdown"),
    ]


@pytest.mark.parametrize("limit,overlap", [(100, 0), (100, 20), (37, 36), (1, 0), (50, 49), (10, 500)])
def test_cut_points(limit, overlap):
    rng = random.Random(limit)
    for n in (0, 1, 99, 100, 101, 1000, 3000):
        body = "".join(rng.choice(["word ", "a", "\n\n", ". ", "漢", "\n"]) for _ in range(n))[:n]
        for t in (body, "x" * n):
            spans = splitting.cut_points(t, limit, overlap)
            assert spans[0][0] == 0 and spans[-1][1] == len(t) and all(e - s <= limit for s, e in spans)
            assert all(a[1] >= b[0] > a[0] and b[1] > a[1] and a[1] - b[0] <= overlap for a, b in zip(spans, spans[1:]))


def test_overlap_is_exact():
    rng = random.Random(5)
    for words in (["word ", "longer, ", "end. ", "\n\n"], ["漢字", "。", "かな"], ["https://example.org/" + "x" * 300 + " ", "a "]):
        body = "".join(rng.choice(words) for _ in range(4000)).strip()
        for limit, overlap in ((2400, 200), (500, 100), (300, 0)):
            spans = splitting.cut_points(body, limit, overlap)
            assert len(spans) > 2 and all(a[1] - b[0] == overlap for a, b in zip(spans, spans[1:])) and all(e - s <= limit for s, e in spans)


def test_fewest_pieces():
    assert [e - s for s, e in splitting.cut_points("x" * 10_000, 2400, 200)] == [2160] * 5
    for n in (2401, 4599, 4600, 4601, 9999):
        assert len(splitting.cut_points("x" * n, 2400, 200)) == -(-(n - 200) // 2200)
    # a piece more where that finds boundaries for all cuts
    body = "word " * 459 + "x" * 300
    assert all(body[e - 1] == " " for _, e in splitting.cut_points(body, 1300, 0)[:-1])


def test_cuts_prefer_strong_boundaries():
    body = "\n\n".join(" ".join(f"word{i}" for i in range(12)) for _ in range(6))
    spans = splitting.cut_points(body, 200, 0)
    assert all(body[: e].endswith("\n\n") for _, e in spans[:-1])


def test_tokens():
    machine = bpe.transducer()
    tiktoken = pytest.importorskip("tiktoken")
    peer = tiktoken.Encoding("peer", pat_str=bpe.SPLIT_PATTERN, mergeable_ranks=machine.ranks, special_tokens={})
    rng = random.Random(1)
    alphabet = ["a", "b", "the", " ", "e", "in", "zz", "\n", "é", "漢", "1", "==", "\U0001f600", "th", "'s", "<|endoftext|>", "\x1c", "\u3000", "ſ", "²", "\t"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([3, 30, 200]))) for _ in range(400)]
    texts += ["a" * 3000, " " * 2000, "-" * 1500, "abc" * 1000, "漢字" * 500, "<|endoftext|>"]
    for t in texts:
        ids = machine.encode(t)
        assert ids == peer.encode_ordinary(t) and machine.decode(ids) == t
    assert machine.encode("") == machine.encode(None) == []


def test_utf8_machine():
    for data in (b"a\xc3\xa9\xe6\xbc\xa2\xf0\x9f\x98\x80", b"\xc3", b"\xed\xa0\x80", b"\xe2\x28\xa1", b"\xff\xfea", b"\xf4\x90\x80\x80", b"\xe6\xbc"):
        machine = bpe.Utf8Machine()
        made = "".join(machine.feed(data[i : i + 1]) for i in range(len(data))) + machine.close()
        want = data.decode("utf-8", "replace")
        assert made.replace("�", "") == want.replace("�", "") and ("�" in made) == ("�" in want)
