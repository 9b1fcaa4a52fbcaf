"""C and C++."""

from __future__ import annotations

import re

from .core import BAD, EOF, NUM, STR, Lexed, Parser, lex

PATTERN = re.compile(
    r"(?P<skip>(?:[ \t\n\f\v\r]|\\\r?\n|//(?:[^\n\\]|\\[\s\S])*|/\*[\s\S]*?\*/)+)"
    r"|(?P<directive>\#(?:[^\n\\/]|\\[\s\S]|/(?!\*)|/\*[\s\S]*?\*/)*)"
    r'|(?P<str>(?:u8|[uUL])?(?:R"(?P<delim>[^()\\\s]{0,16})\([\s\S]*?\)(?P=delim)"|"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])+\'))'
    r"|(?P<name>[A-Za-z_$\u0080-￿][\w$]*)"
    r"|(?P<num>\.?\d(?:[eEpP][+-]|'?[\w.])*)"
    r"|(?P<op><<=|>>=|\.\.\.|->\*|<=>|::|->|\+\+|--|<<|&&|\|\||[-+*/%&|^=!<>]=|[-+*/%&|^~!=<>?:;,.(){}\[\]])"
    r"|(?P<comment>/\*)|(?P<text_literal>[\"'])"
)
NUMBER = re.compile(r"(?:0[xX][\da-fA-F']+(?:\.[\da-fA-F']*)?(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*)?\.?\d[\d']*\.?(?:[eE][+-]?\d+)?)[uUlLfFzZ]*$")
DIRECTIVES = frozenset("include include_next import embed define undef if ifdef ifndef elif elifdef elifndef else endif error warning pragma line ident".split())
TYPE_WORDS = frozenset("void char short int long float double signed unsigned _Bool bool wchar_t auto const volatile static extern inline register restrict typedef struct union enum class constexpr virtual explicit friend mutable typename thread_local _Thread_local".split())
WORDS = frozenset("if else for while do switch case default break continue return goto sizeof struct union enum typedef static extern const volatile void char short int long float double signed unsigned".split())
CPP_WORDS = WORDS | frozenset("class namespace template using public private protected new delete try catch throw this operator virtual".split())


class CParser(Parser):
    keywords = WORDS
    binary = {",": 1, "=": 2, "+=": 2, "-=": 2, "*=": 2, "/=": 2, "%=": 2, "&=": 2, "|=": 2, "^=": 2, "<<=": 2, ">>=": 2, "?": 3, "||": 4, "&&": 5, "|": 6, "^": 7, "&": 8, "==": 9, "!=": 9, "<": 10, ">": 10, "<=": 10, ">=": 10, "<=>": 10, "<<": 11, ">>": 11, "+": 12, "-": 12, "*": 13, "/": 13, "%": 13}
    right = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="])
    cpp = False

    def lexed(self, text: str) -> Lexed:
        def directive(text, i, j, out, fresh):
            line = text[text.rfind("\n", 0, i) + 1 : i]
            if line.strip():
                out.faults.append((i, "stray '#'"))
                out.add(BAD, False, i)
                return i + 1
            word = re.match(r"#\s*(\w*)", text[i:j])[1]
            if word not in DIRECTIVES and text[i + 1 : j].strip() and not word.isdigit():
                out.faults.append((i, "unknown directive"))
            if word in ("if", "ifdef", "ifndef"):
                self.open_ifs.append(i)
            elif word == "endif":
                if not self.open_ifs:
                    out.faults.append((i, "#endif without #if"))
                else:
                    self.open_ifs.pop()
            return j

        def number(text, i, j, out, fresh):
            if not NUMBER.match(text[i:j]):
                out.faults.append((i, "bad number"))
            out.add(NUM, False, i, fresh)
            return j

        self.open_ifs: list[int] = []
        out = lex(text, PATTERN, {"directive": directive, "num": number})
        out.faults += [(i, "#if without #endif") for i in self.open_ifs]
        return out

    def top(self) -> None:
        while not self.at(EOF):
            self.guarded(self.external, close="")

    # declarations
    def external(self) -> None:
        if self.take(";"):
            return
        if self.cpp and self.cpp_external():
            return
        self.declaration(True)

    def cpp_external(self) -> bool:
        if self.at("namespace") or self.at("inline") and self.peek(1) == "namespace":
            self.take("inline")
            self.need("namespace")
            while self.is_name() or self.at("::", "inline"):
                self.i += 1
            if self.take("="):
                self.climb(2)
                self.need(";")
                return True
            self.block_of(self.external)
            return True
        if self.at("using"):
            while not self.at(";", EOF):
                self.i += 1
            self.need(";")
            return True
        if self.at("template"):
            self.i += 1
            self.angles()
            if self.take("requires"):
                self.constraint()
            if self.at("concept") and self.is_name(1):
                self.i += 2
                self.need("=")
                self.constraint()
                self.need(";")
                return True
            self.external()
            return True
        if self.at("extern") and self.peek(1) == STR:
            self.i += 2
            if self.at("{"):
                self.block_of(self.external)
            else:
                self.external()
            return True
        return False

    def constraint(self) -> None:
        """What a template demands: names of concepts and demands in brackets, joined by && and ||."""
        while True:
            self.take("!")
            if self.at("("):
                self.balanced()
            elif self.at("requires"):
                self.demands()
            else:
                self.qualified()
            if not self.take("&&") and not self.take("||"):
                return

    def demands(self) -> None:
        self.need("requires")
        if self.at("("):
            self.balanced()
        if not self.at("{"):
            self.fail("'{' expected")
        self.balanced()

    def block_of(self, rule) -> None:
        self.need("{")
        while not self.at("}", EOF):
            self.guarded(rule)
        self.need("}")

    def angles(self) -> None:
        self.need("<")
        level = 1
        while level:
            v = self.v[self.i]
            if v in (";", "{", "}", EOF):
                self.fail("'>' expected")
            if v in ("(", "["):
                self.balanced()
                continue
            level += {"<": 1, ">": -1, ">>": -2}.get(v, 0)
            self.i += 1

    def specifiers(self) -> bool:
        """Type and storage words; whether there was a type."""
        typed = False
        while True:
            v = self.v[self.i]
            if v in ("struct", "union", "enum", "class"):
                self.i += 1
                if v == "enum" and self.cpp:
                    self.take("class")
                while self.at("__attribute__", "alignas"):
                    self.i += 1
                    self.balanced()
                named = self.is_name()
                if named:
                    self.qualified()
                if self.cpp and self.at("final"):
                    self.i += 1
                if self.at(":") and self.cpp or self.at(":") and v == "enum":
                    while not self.at("{", ";", EOF):
                        self.i += 1
                if self.at("{"):
                    if v == "enum":
                        self.i += 1
                        self.listed(self.enumerator, "}")
                    else:
                        self.block_of(self.member)
                elif not named:
                    self.fail("name or '{' expected")
                typed = True
            elif v in ("__attribute__", "__declspec", "alignas", "_Alignas", "decltype", "typeof"):
                self.i += 1
                self.balanced()
                typed = typed or v in ("decltype", "typeof")
            elif v in TYPE_WORDS:
                self.i += 1
                typed = typed or v not in ("static", "extern", "inline", "typedef", "register", "const", "volatile", "restrict", "virtual", "explicit", "friend", "constexpr", "mutable")
            elif not typed and (self.is_name() or self.cpp and v == "::"):
                self.qualified()
                typed = True
            else:
                return typed

    def qualified(self) -> None:
        self.take("::")
        while True:
            self.name()
            if self.cpp and self.at("<"):
                self.attempt(self.angles)
            if not (self.cpp and self.at("::") and (self.is_name(1) or self.peek(1) in ("~", "operator"))):
                return
            if self.peek(1) in ("~", "operator"):
                return
            self.i += 1

    def enumerator(self) -> None:
        self.name()
        if self.take("="):
            self.climb(2)

    def member(self) -> None:
        if self.take(";"):
            return
        if self.cpp:
            if self.at("public", "private", "protected") and self.peek(1) == ":":
                self.i += 2
                return
            if self.at("using", "template") and self.cpp_external():
                return
            if self.at("~") or self.at("virtual") and self.peek(1) == "~" or self.is_name() and self.peek(1) == "(" or self.at("explicit", "operator"):
                while self.at("virtual", "explicit", "~"):
                    self.i += 1
                if self.take("operator"):
                    self.operator_name()
                else:
                    self.name()
                self.balanced()
                self.function_rest()
                return
        self.declaration(self.cpp)

    def declaration(self, body: bool) -> None:
        if self.at("_Static_assert", "static_assert"):
            self.i += 1
            self.balanced()
            self.need(";")
            return
        if not self.specifiers():
            self.fail("declaration expected")
        if self.take(";"):
            return
        while True:
            called = self.declarator()
            if self.take(":"):
                self.climb(2)
            if called and (self.at("{") or self.cpp and self.at("const", "noexcept", "override", "->", ":", "final", "requires")):
                if not body:
                    self.fail("';' expected")
                self.function_rest()
                return
            while self.at("__attribute__", "__asm__", "asm"):
                self.i += 1
                self.balanced()
            if called and body and not self.cpp and (self.is_name() or self.v[self.i] in TYPE_WORDS or self.at("struct", "union", "enum")):
                while not self.at("{", EOF):  # the old style: parameters are declared behind the brackets
                    self.declaration(False)
                return self.compound()
            if self.take("="):
                if self.cpp and self.at("default", "delete"):
                    self.i += 1
                else:
                    self.initializer()
            elif self.cpp and self.at("{"):
                self.braces()
            if self.take(";"):
                return
            self.need(",")

    def function_rest(self) -> None:
        while self.at("const", "noexcept", "override", "final", "&", "&&"):
            self.i += 1
            if self.at("("):
                self.balanced()
        if self.take("->"):
            self.specifiers()
            while self.at("*", "&", "&&"):
                self.i += 1
        if self.cpp and self.take("requires"):
            self.constraint()
        if self.take(":"):
            while not self.at("{", ";", EOF):
                self.qualified()
                self.balanced()
                self.take(",")
        if self.take("="):
            self.i += 1
            self.need(";")
        elif not self.take(";"):
            self.compound()

    def declarator(self, abstract: bool = False) -> bool:
        """Whether it declares a function."""
        while self.at("*", "const", "volatile", "restrict", "&", "&&", "...", "__restrict"):
            if self.at("&", "&&") and not self.cpp:
                self.fail("declarator expected")
            self.i += 1
        if self.at("(") and (self.peek(1) in ("*", "&", "(", "^") or not abstract and self.is_name(1) and self.peek(2) == ")"):
            self.i += 1
            self.declarator(abstract)
            self.need(")")
        elif self.is_name():
            self.qualified()
            if self.cpp and self.take("::"):
                self.take("~")
                if self.take("operator"):
                    self.operator_name()
                else:
                    self.name()
        elif self.cpp and self.take("operator"):
            self.operator_name()
        elif self.cpp and self.at("[") and self.is_name(1) and self.peek(2) in (",", "]"):
            self.balanced()  # names bound to the parts of a value
        elif not abstract:
            self.fail("name expected")
        called = False
        while True:
            if self.take("["):
                if not self.take("]"):
                    while self.at("static", "const"):
                        self.i += 1
                    self.climb(2)
                    self.need("]")
            elif self.at("("):
                if self.cpp and not abstract and not self.attempt(self.parameters):
                    self.i += 1
                    self.listed(self.initializer, ")")
                    return False
                elif not self.cpp or abstract:
                    self.parameters()
                called = True
            else:
                return called

    def operator_name(self) -> None:
        if self.at("(") and self.peek(1) == ")":
            self.i += 2
        while not self.at("(", ";", EOF):
            self.i += 1

    def parameters(self) -> None:
        self.need("(")
        self.listed(self.parameter, ")", trailing=False)

    def parameter(self) -> None:
        if self.take("..."):
            return
        if not self.specifiers():
            self.fail("parameter expected")
        self.declarator(True)
        if self.cpp and self.take("="):
            self.climb(2)

    def initializer(self) -> None:
        if self.at("{"):
            self.braces()
        else:
            self.climb(2)

    def braces(self) -> None:
        self.need("{")
        self.listed(self.designated, "}")

    def designated(self) -> None:
        marked = False
        while self.at("[", "."):
            if self.take("["):
                self.climb(3)
                self.need("]")
            else:
                self.i += 1
                self.name()
            marked = True
        if marked:
            self.need("=")
        self.initializer()

    # statements
    def compound(self) -> None:
        self.need("{")
        while not self.at("}", EOF):
            self.guarded(self.statement)
        self.need("}")

    def condition(self) -> None:
        self.need("(")
        self.declared_or_expression()
        self.need(")")

    def declared_or_expression(self) -> None:
        if not (self.declares() and self.attempt(self.inline_declaration)):
            self.climb()

    def inline_declaration(self) -> None:
        self.specifiers()
        self.declarator()
        if self.take("="):
            self.initializer()
        elif self.at(")", ";", ":"):
            pass
        else:
            self.fail("'=' expected")

    def declares(self) -> bool:
        v = self.v[self.i]
        if v in TYPE_WORDS:
            return True
        if not self.is_name():
            return False
        k = 1
        if self.cpp:
            while self.peek(k) == "::" and self.is_name(k + 1):
                k += 2
            if self.peek(k) == "<":
                return True
        if self.is_name(k):
            return True
        while self.peek(k) in ("*", "&", "const"):
            k += 1
        return k > 1 and self.is_name(k) and self.peek(k + 1) in ("=", ";", ",", "[")

    def statement(self) -> None:
        v = self.v[self.i]
        if v == "{":
            self.compound()
        elif v == "if":
            while self.take("if"):
                if self.cpp:
                    self.take("constexpr")
                self.condition()
                self.statement()
                if not self.take("else"):
                    return
                if not self.at("if"):
                    return self.statement()
        elif v == "for":
            self.i += 1
            self.need("(")
            if not self.take(";"):
                if self.declares() and self.attempt(self.range_head):
                    self.need(")")
                    return self.statement()
                if not (self.declares() and self.attempt(lambda: self.declaration(False))):
                    self.climb()
                    self.need(";")
            if not self.at(";"):
                self.climb()
            self.need(";")
            if not self.at(")"):
                self.climb()
            self.need(")")
            self.statement()
        elif v in ("while", "switch"):
            self.i += 1
            self.condition()
            self.statement()
        elif v == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.condition()
            self.need(";")
        elif v == "case":
            self.i += 1
            self.climb(3)
            if self.take("..."):
                self.climb(3)
            self.need(":")
            if not self.at("}"):
                self.statement()
        elif v == "default":
            self.i += 1
            self.need(":")
            if not self.at("}"):
                self.statement()
        elif v in ("break", "continue"):
            self.i += 1
            self.need(";")
        elif v == "return":
            self.i += 1
            if not self.at(";"):
                self.initializer() if self.at("{") and self.cpp else self.climb()
            self.need(";")
        elif v == "goto":
            self.i += 1
            self.name()
            self.need(";")
        elif v == ";":
            self.i += 1
        elif v == "try" and self.cpp:
            self.i += 1
            self.compound()
            while self.take("catch"):
                self.balanced()
                self.compound()
        elif v == "using" and self.cpp:
            self.cpp_external()
        elif self.is_name() and self.peek(1) == ":" and self.peek(2) != ":":
            self.i += 2
            if not self.at("}"):
                self.statement()
        elif not (self.declares() and self.attempt(lambda: self.declaration(False))):
            self.climb()
            self.need(";")

    def range_head(self) -> None:
        self.specifiers()
        self.declarator()
        self.need(":")
        self.climb()

    # expressions
    def joins(self, op: str) -> bool | None:
        if op == "?":
            self.i += 1
            if not self.at(":"):
                self.climb()
            self.need(":")
            self.climb(2)
            return None
        return True

    def unary(self) -> None:
        v = self.v[self.i]
        if v in ("+", "-", "!", "~", "*", "&", "++", "--", "&&"):
            self.i += 1
            return self.unary()
        if v in ("sizeof", "_Alignof", "alignof"):
            self.i += 1
            if self.at("(") and self.attempt(self.cast_type):
                return None
            return self.unary()
        if self.cpp and v == "requires" and self.peek(1) in ("(", "{"):
            return self.demands()
        if self.cpp and v in ("new", "delete", "throw", "co_await"):
            self.i += 1
            if v == "new":
                self.specifiers()
                while self.at("*"):
                    self.i += 1
                return self.postfix()
            if v == "delete" and self.take("["):
                self.need("]")
            if v == "throw" and self.at(";"):
                return None
            return self.unary()
        if v == "(" and self.attempt(self.cast):
            return None
        self.primary()
        return self.postfix()

    def cast_type(self) -> None:
        self.need("(")
        if not self.specifiers():
            self.fail("type expected")
        self.declarator(True)
        self.need(")")

    def cast(self) -> None:
        self.cast_type()
        if self.at("{"):
            self.braces()
            self.postfix()
        elif self.is_name() or self.at(STR, NUM, "(", "!", "~", "sizeof", "this") or self.at("-", "+", "*", "&", "++", "--") and self.v[self.i - 2] in (*TYPE_WORDS, "*"):
            self.unary()
        else:
            self.fail("operand expected")

    def primary(self) -> None:
        v = self.v[self.i]
        if v == STR:
            while self.at(STR) or self.is_name() and self.peek(1) == STR:
                self.i += 1
        elif v == NUM or self.cpp and v in ("this", "nullptr", "true", "false"):
            self.i += 1
        elif v == "(":
            self.i += 1
            if self.at("{"):
                self.compound()
            else:
                self.climb()
            self.need(")")
        elif self.cpp and v == "[":
            self.balanced()
            if self.at("("):
                self.balanced()
            while not self.at("{", ";", EOF):
                self.i += 1
            self.compound()
        elif self.is_name() or self.cpp and v in ("::", "operator", *TYPE_WORDS):
            if v in TYPE_WORDS:
                self.specifiers()
            elif v == "operator":
                self.i += 1
                self.operator_name()
            else:
                self.qualified()
                if self.at(STR):
                    self.primary()
        else:
            self.fail("expression expected")

    def postfix(self) -> None:
        while True:
            v = self.v[self.i]
            if v == "[":
                self.i += 1
                self.climb()
                self.need("]")
            elif v == "(":
                self.i += 1
                self.listed(self.argument, ")", trailing=False)
            elif v in (".", "->"):
                self.i += 1
                self.take("~")
                self.take("template")
                self.qualified()
            elif v in ("++", "--"):
                self.i += 1
            elif v == "{" and self.cpp and self.v[self.i - 1] == ">":
                self.braces()
            else:
                return

    def argument(self) -> None:
        if self.cpp and self.at("{"):
            return self.braces()
        if self.v[self.i] in TYPE_WORDS and self.attempt(self.type_argument):
            return None
        return self.climb(2)

    def type_argument(self) -> None:
        self.specifiers()
        self.declarator(True)
        if not self.at(",", ")"):
            self.fail("')' expected")


class CppParser(CParser):
    keywords = CPP_WORDS
    cpp = True
