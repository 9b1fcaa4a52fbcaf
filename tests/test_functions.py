import pytest
from pyspark.sql import functions as F

from corpusloom.functions import chunking, codeunits, html, paths, terms, text
from corpusloom.functions.declarations import declarations
from corpusloom.functions.excerpt import Excerpt, line_score


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


def test_terms():
    assert terms.docs_terms("how do I add items to a list") == ["add", "items", "list"]
    assert terms.docs_terms("c++ arrays") == ["c", "arrays"]
    assert terms.expanded_terms(["target", "triples", "arrays"]) == ["target", "triples", "triple", "arrays", "array"]
    assert terms.variants("queries") == ["queries", "query", "querie"]
    assert terms.match_string(terms.code_tokens("Find config loader, config loader!")) == "find* OR config* OR loader*"
    assert terms.match_string(terms.code_tokens("! ? a")) is None


def test_term_columns_agree(spark):
    queries = ["how do I add items to a list", "Größe der_Liste x", "", "a b c d e f g h i j k l m n o p", "snake_case words WORDS words"]
    rows = spark.createDataFrame([(q,) for q in queries], "q string").select("q", terms.docs_terms_column(F.col("q")), terms.code_tokens_column(F.col("q"))).collect()
    for q, docs, code in rows:
        assert docs == terms.docs_terms(q) and code == terms.code_tokens(q)


def test_tokens_fold(spark):
    assert one(spark, terms.index_tokens(F.col("t")), t="Café_naïve 漢字, x-1") == ["cafe", "naive", "漢字", "x", "1"]
    assert one(spark, terms.index_tokens(F.col("t")), t=None) == []


def test_text_columns(spark):
    c = F.col
    assert one(spark, text.normalize(c("t")), t=" a\r\nb\rc \x1f") == "a\nb\nc"
    assert [one(spark, text.token_estimate(c("t")), t=t) for t in ("", " ", "a", "abcde")] == [0, 0, 1, 2]
    page = "# T\n\n> DevDocs path: p\n\nPara1\n\nPara2"
    assert one(spark, text.strip_page_header(c("t")), t=page) == "Para2"
    assert one(spark, text.strip_page_header(c("t"), "exact"), t=page) == "Para1\n\nPara2"
    assert one(spark, text.camel_case(c("t")), t="page_count_max") == "pageCountMax"
    assert one(spark, text.line_slice(c("t"), 2, 3), t="a\nb\nc\nd") == "b\nc"
    assert one(spark, text.line_slice(c("t"), 3, 2), t="a\nb\nc") == ""
    assert one(spark, text.line_slice(c("t"), 0, 99), t="a\nb") == "a\nb"
    assert one(spark, text.shell_quoted(c("t")), t="it's") == "'it'\"'\"'s'"
    assert [one(spark, text.safe_segment(c("t")), t=t) for t in ("react~18", "..", "a/b")] == [True, False, False]
    assert [one(spark, text.metadata_map(c("t")), t=t) for t in ("[1]", "nonsense", None)] == [{}] * 3
    assert one(spark, text.page_id(c("p"), c("n")), p="a/B", n="Ä").startswith("a-b-")


def test_paths(spark):
    c = F.col("p")
    assert [one(spark, paths.under_prefix(c, "apps/api_v1"), p=p) for p in ("apps/api_v1/x", "apps/apiXv1/x", "apps/api_v1", "apps/api_v12")] == [True, False, True, False]
    assert one(spark, paths.has_component(c, "__pycache__"), p="a/__pycache__/b")
    assert [one(spark, paths.is_excluded(c), p=p) for p in ("a/node_modules/b", "a/x.egg-info/b", "uv.lock", "a/builds/b")] == [True, True, True, False]
    assert paths.under_any(c, ["a", ""]) is None and paths.under_any(c, None) is None
    assert paths.scope_of("src", "app") == "app/src" and paths.scope_of("app/x", "app") == "app/x" and paths.scope_of(None, None) is None
    with pytest.raises(ValueError):
        paths.scope_of("../x", None)
    assert paths.resolve_link("#part", "guide/start") == "guide/start#part"
    assert paths.resolve_link("../other", "guide/start") == "other"
    assert paths.resolve_link("https://en.cppreference.com/w/cpp/io#x", "a") == "io#x"
    assert paths.resolve_link("container/vector", "a/b") == "container/vector"
    assert paths.resolve_link("mailto:x@y", "a") == "mailto:x@y"
    assert one(spark, paths.anchor(c), p="a#b#c") == "b#c" and one(spark, paths.anchor(c), p="a#") is None


def test_html():
    page = '<nav>x</nav><h2 id="one">One</h2><p>first <a href="#z">l <code>k</code></a></p><h2 id="two">Two</h2><p>second</p>'
    part = html.to_markdown("One", "g/s#one", page)
    assert "second" not in part and part.startswith("# One\n\n> DevDocs path: g/s#one\n\n") and "## One" not in part
    whole = html.to_markdown("T", "g/s", page + '<pre data-language="py">a  b</pre><ul><li>i</li></ul><table><tr><td>c</td></tr></table>&amp;lt;')
    assert "[l k](g/s#z)" in whole and "```py\na  b\n```" in whole and "- i" in whole and "| c" in whole
    assert html.section('<div id="d">in</div>out', "p#d") == '<div id="d">in</div>'
    assert html.section('<h1 id="a">A</h1>x<h2>B</h2>y<h1>C</h1>z', "p#a") == '<h1 id="a">A</h1>x<h2>B</h2>y' and html.section("<p>x", "p#none") == "<p>x"


def test_html_that_is_not_well_formed():
    body = lambda page: html.to_markdown("T", "p", page).split("\n\n", 2)[2]
    assert body("<ul><li>a<li>b</ul></div>c") == "- a\n\n- b\n\nc\n"
    assert body('<a href="x">never closed <b>t') == "never closed t\n"
    assert body("<nav>menu") == "\n" and body("") == "\n" and body("<br/>a<img src='x'>b") == "ab\n"
    assert body('<a href="x">out <a href="y">in</a></a>') == "[in](y)[out](x)\n"
    assert len(body("<div>" * 20_000 + "deep")) == 5


def test_chunking():
    sentences = " ".join(f"Sentence number {i} is here." for i in range(80))
    chunks = chunking.split(sentences, 400, 40, 100)
    assert all(0 < len(c) <= 400 for c in chunks) and len(chunks) > 5
    assert chunking.split("") == [] and chunking.split(" \n ") == []
    assert chunking.split("x" * 1000, 100, 0, 1) == ["x" * 100] * 10
    assert len(chunking.split("word " * 100, 40, 10, 10)) > 10
    with pytest.raises(ValueError):
        chunking.options(100, 100)
    with pytest.raises(ValueError):
        chunking.options(100, 0, 200)
    assert chunking.options(100, 10) == (100, 10, 100, 512)


def test_excerpt():
    assert line_score("appending to arrays", ["append", "array"]) == 11
    made = Excerpt("Docset: X (x)\nPage: p\n\n" + "filler text " * 60 + "append here " + "more words " * 60, ["append"], max_chars=120).text()
    assert "append" in made and len(made) <= 120
    assert Excerpt("a b\n\nfirst\nhit\nlast", ["hit"], max_lines=1).text().endswith("...\nhit\n...")
    assert Excerpt("word " * 100, ["none"], max_chars=20).text() == "word word word wo..." and Excerpt("word " * 100, ["word"], max_chars=2).text() == ".."
    assert Excerpt("", ["a"]).text() == "" and Excerpt("Docset: a\n\n# Title\n\nbody text", ["title"]).text() == "# Title\n\nbody text"


def test_code_units():
    rows = codeunits.units_of("a.py", "class Greeter:\n    def hello(self):\n        pass\n")
    assert [r[7] for r in rows] == ["Greeter", "hello"] and rows[1][5] == len("class Greeter:\n    def hello(self):\n        pass\n")
    assert [r[6] for r in codeunits.units_of("a.py", "def (")] == ["file"]
    assert codeunits.units_of("a.txt", "")[0][2:4] == (1, 1) and codeunits.language_of("x/y.mts") == "typescript"


#: Text, and its declarations in order: kind, name, first characters.
DECLARED = {
    'typescript': (
        "export async function f(a: {x: number}, b = '}'): Promise<void> { if (a) { g() } }\nexport default abstract class B<T> extends C { private readonly x = 1; static async m<T>(a: T): Promise<{y: T}> { return () => { } } get z() { return 1 } constructor() { super() } }\ninterface I { a(): void }\nexport type U = { a: 1 } | 'x;';\nfunction* gen() { yield 1 }\n// function no() { }\nconst h = () => { };",
        [('function_declaration', 'f', 'async fu'), ('class_declaration', 'B', 'abstract'), ('method_definition', 'm', 'static a'), ('method_definition', 'z', 'get z() '), ('method_definition', 'constructor', 'construc'), ('interface_declaration', 'I', 'interfac'), ('type_alias_declaration', 'U', 'type U ='), ('generator_function_declaration', 'gen', 'function')],
    ),
    'go': (
        'package a\n\nimport (\n\t"fmt"\n)\n\ntype T struct {\n\tA int\n}\n\nfunc (t *T) M(a int,\n\tb string) error {\n\tif x := f(); x {\n\t}\n\treturn func() error { return nil }()\n}\n\nfunc F[K any](k K) map[string]int {\n\treturn map[string]int{"a}": 1}\n}\n',
        [('type_declaration', 'T', 'type T s'), ('method_declaration', 'M', 'func (t '), ('function_declaration', 'F', 'func F[K')],
    ),
    'rust': (
        "#[derive(Debug)]\npub struct A<'a> { x: &'a str }\nstruct U;\nimpl<'a> fmt::Display for A<'a> { fn fmt(&self) -> R { match c { '{' => 1, _ => 2 } } }\npub(crate) async unsafe fn g<T: Fn()>(t: T) where T: X { }\nenum E { V { a: u8 } }\ntrait Tr { fn d(&self); fn e(&self) { } }\nmod m { fn inner() {} }\n",
        [('struct_item', 'A', 'pub stru'), ('struct_item', 'U', 'struct U'), ('impl_item', 'A', "impl<'a>"), ('function_item', 'fmt', 'fn fmt(&'), ('function_item', 'g', 'pub(crat'), ('enum_item', 'E', 'enum E {'), ('trait_item', 'Tr', 'trait Tr'), ('function_item', 'e', 'fn e(&se'), ('mod_item', 'm', 'mod m { '), ('function_item', 'inner', 'fn inner')],
    ),
    'java': (
        'package a;\nimport b.C;\n@X(1) public final class A<T> extends B implements C {\n  private int[] v = {1, 2};\n  public A(int a) throws E { super(a); }\n  @Override protected <U> List<U> m(final int a, String... s) throws E { for (;;) { new Runnable() { public void run() { } }; } }\n  abstract void n();\n  enum K { P { int q() { return 1; } } }\n  static class In { In() { } }\n}\ninterface I { int z(int a); default void w() { } }\n',
        [('class_declaration', 'A', '@X(1) pu'), ('constructor_declaration', 'A', 'public A'), ('method_declaration', 'm', '@Overrid'), ('method_declaration', 'n', 'abstract'), ('enum_declaration', 'K', 'enum K {'), ('class_declaration', 'In', 'static c'), ('constructor_declaration', 'In', 'In() { }'), ('interface_declaration', 'I', 'interfac'), ('method_declaration', 'z', 'int z(in'), ('method_declaration', 'w', 'default ')],
    ),
    'c': (
        '#include <a.h>\n#define X {\ntypedef struct s { int a; } S;\nstatic const char *f(int a, char *b[])\n{\n  if (a) { g("}"); }\n  int t[] = { 1 };\n  return 0;\n}\nenum e { A, B };\nint v = 3;\n',
        [('struct_specifier', 's', 'struct s'), ('function_definition', 'f', 'static c'), ('enum_specifier', 'e', 'enum e {')],
    ),
    'cpp': (
        'namespace a::b {\ntemplate <typename T> class C : public D<T> {\npublic:\n  explicit C(int a) : x(a), y{1} { }\n  ~C() { }\n  int f() const override { return [&](int q) { return q; }(1); }\n  bool operator==(const C& o) const { return true; }\n};\nauto g(int a) -> int { switch (a) { case 1: { } } }\n}\nextern "C" { int h(void) { return 1; } }\n',
        [('namespace_definition', 'a::b', 'namespac'), ('class_specifier', 'C', 'class C '), ('function_definition', 'C', 'explicit'), ('function_definition', '~C', '~C() { }'), ('function_definition', 'f', 'int f() '), ('function_definition', 'operator==', 'bool ope'), ('function_definition', 'g', 'auto g(i'), ('function_definition', 'h', 'int h(vo')],
    ),
    'css': (
        '@media (min-width: 1px) { .a, .b > c { color: red } }\n/* .x { } */\n.d:hover { e: url("}") }\n@font-face { src: x }',
        [('media_statement', '@media (min-width: 1px)', '@media ('), ('rule_set', '.a, .b > c', '.a, .b >'), ('rule_set', '.d:hover', '.d:hover')],
    ),
    'bash': (
        '#!/bin/sh\nf() {\n  echo "${x}" \'}\'\n}\nfunction g {\n  if a; then { b; }; fi\n}\nh () { :; }\n',
        [('function_definition', 'f', 'f() {\n  '), ('function_definition', 'g', 'function'), ('function_definition', 'h', 'h () { :')],
    ),
    'csharp': (
        'namespace N { public sealed class A : B { public A(int x) { } [T] public async Task<int> M(string s) { return 1; } int P { get { return 1; } } } public struct S { } public record R(int a) { } }',
        [('class_declaration', 'A', 'public s'), ('constructor_declaration', 'A', 'public A'), ('method_declaration', 'M', '[T] publ'), ('struct_declaration', 'S', 'public s'), ('record_declaration', 'R', 'public r')],
    ),
    'ruby': (
        'module M\n  class A < B\n    def f(x)\n      if x\n      end\n    end\n    def self.g; end\n    def self.k\n    end\n  end\nend\n',
        [('module', 'M', 'module M'), ('class', 'A', 'class A '), ('method', 'f', 'def f(x)'), ('singleton_method', 'g', 'def self'), ('singleton_method', 'k', 'def self')],
    ),
}


@pytest.mark.parametrize("language", DECLARED)
def test_declarations(language):
    source, want = DECLARED[language]
    found = declarations(language, source)
    assert [(kind, name, source[a:b][:8]) for a, b, kind, name in found] == want
    assert all(source[b - 1] in "};d" for _, b, _, _ in found)


def test_declarations_of_anything():
    import random

    rng = random.Random(4)
    for language, (source, _) in DECLARED.items():
        for _ in range(60):
            i, j = sorted((rng.randrange(len(source)), rng.randrange(len(source))))
            declarations(language, source[:i] + rng.choice(["", "{", "}", "(", ")", '"', "'", "/*", "`"]) + source[j:])
        assert declarations(language, "") == []
    assert declarations("text", "class A {}") == [] and len(declarations("c", "{" * 20_000 + "}" * 20_000)) == 0


def test_declared_units():
    source = "// ä\nclass A {\n  int f() {\n    return 1;\n  }\n}\n"
    rows = codeunits.units_of("p/A.java", source)
    assert [(r[6], r[7], r[2], r[3]) for r in rows] == [("class_declaration", "A", 2, 6), ("method_declaration", "f", 3, 5)]
    assert [source.encode()[r[4] : r[5]].decode() for r in rows] == [r[8] for r in rows] and [r[6] for r in codeunits.units_of("p/A.java", "class")] == ["file"]
