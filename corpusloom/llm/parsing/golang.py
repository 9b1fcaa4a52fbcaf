"""Go."""

from __future__ import annotations

import re

from .core import EOF, NUM, STR, Fault, Lexed, Parser, lex

PATTERN = re.compile(
    r"(?P<skip>(?:[ \t\r\n]|//[^\n]*|/\*[\s\S]*?\*/)+)"
    r"|(?P<str>\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\(?:[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[abfnrtv\\'\"]))')"
    r"|(?P<name>[A-Za-z_ª-\U0010ffff]\w*)"
    r"|(?P<num>(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w))"
    r"|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!~()\[\]{},;.:])"
    r"|(?P<comment>/\*)|(?P<text_literal>[\"'`])"
)
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
ENDS = frozenset([STR, NUM, ")", "]", "}", "++", "--", "break", "continue", "fallthrough", "return"])
ASSIGNS = ("=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^=")


class GoParser(Parser):
    """``flag``: in the head of a statement, where a brace opens its block."""

    keywords = KEYWORDS
    binary = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}

    def lexed(self, text: str) -> Lexed:
        raw, out = lex(text, PATTERN), Lexed()
        out.faults = raw.faults
        last, named = None, False
        for token in zip(raw.value, raw.name, raw.at, raw.newline):
            value, is_name, at, newline = token
            if newline and last is not None and (last in ENDS or named and last not in KEYWORDS):
                out.add(";", False, at, True)
            out.value.append(value)
            out.name.append(is_name)
            out.at.append(at)
            out.newline.append(newline)
            last, named = value, is_name
        return out

    def top(self) -> None:
        try:
            while self.take(";"):
                pass
            self.need("package")
            self.name()
            self.end()
        except Fault as e:
            self.note(e)
        while self.at("import"):
            self.guarded(self.imports, close="")
        while not self.at(EOF):
            self.guarded(self.declaration, close="")

    def end(self) -> None:
        if not self.take(";") and not self.at(")", "}", EOF):
            self.fail("newline or ';' expected")

    def grouped(self, item) -> None:
        if self.take("("):
            while not self.at(")", EOF):
                item()
                self.end()
            self.need(")")
        else:
            item()

    def imports(self) -> None:
        self.need("import")
        self.grouped(self.import_spec)
        self.end()

    def import_spec(self) -> None:
        if self.is_name() or self.at("."):
            self.i += 1
        self.need(STR)

    def declaration(self) -> None:
        if self.take(";"):
            return
        if self.at("func"):
            self.i += 1
            if self.at("("):
                self.parameters()
            self.name()
            if self.at("["):
                self.balanced()
            self.signature()
            if self.at("{"):
                self.block()
        elif self.at("var", "const", "type"):
            self.general()
        else:
            self.fail("non-declaration statement outside function body")
        self.end()

    def general(self) -> None:
        kind = self.v[self.i]
        self.i += 1
        self.grouped(self.type_spec if kind == "type" else self.value_spec)

    def type_spec(self) -> None:
        self.name()
        if self.at("[") and self.is_name(1) and (self.is_name(2) or self.peek(2) in (",", "interface", "~", "*", "[", "map")):
            self.balanced()
        self.take("=")
        self.type_()

    def value_spec(self) -> None:
        self.names()
        if not self.at("=", ";", ")", EOF):
            self.type_()
        if self.take("="):
            self.expressions()

    def names(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def signature(self) -> None:
        self.parameters()
        if self.at("("):
            self.parameters()
        else:
            self.attempt(self.type_)

    def parameters(self) -> None:
        self.need("(")
        self.listed(self.parameter, ")")

    def parameter(self) -> None:
        if self.is_name() and self.peek(1) not in (",", ")", ".", "["):
            self.i += 1
            self.take("...")
            return self.type_()
        self.take("...")
        if self.is_name() and self.peek(1) == "[" and self.attempt(lambda: (self.name(), self.type_())):
            if self.at(",", ")"):
                return None
            self.fail("')' expected")
        return self.type_()

    def type_(self) -> None:
        v = self.v[self.i]
        if self.is_name():
            self.i += 1
            if self.at(".") and self.is_name(1):
                self.i += 2
            if self.at("[") and self.peek(1) != "]":
                self.attempt(self.type_arguments)
        elif v in ("*", "~"):
            self.i += 1
            self.type_()
        elif v == "(":
            self.i += 1
            self.type_()
            self.need(")")
        elif v == "[":
            self.i += 1
            if not self.take("..."):
                if not self.at("]"):
                    self.climb()
            self.need("]")
            self.type_()
        elif v == "map":
            self.i += 1
            self.need("[")
            self.type_()
            self.need("]")
            self.type_()
        elif v == "chan" or v == "<-":
            self.i += 1
            if v == "<-":
                self.need("chan")
            else:
                self.take("<-")
            self.type_()
        elif v == "func":
            self.i += 1
            self.signature()
        elif v == "struct":
            self.i += 1
            self.need("{")
            while not self.at("}", EOF):
                self.guarded(self.field)
            self.need("}")
        elif v == "interface":
            self.i += 1
            self.need("{")
            while not self.at("}", EOF):
                self.guarded(self.method)
            self.need("}")
        else:
            self.fail("type expected")

    def type_arguments(self) -> None:
        self.need("[")
        self.listed(self.type_, "]", empty=False)

    def field(self) -> None:
        if self.take(";"):
            return
        if self.at("*") or self.is_name() and self.peek(1) in (";", ".", "}", STR):
            self.type_()
        else:
            self.names()
            self.type_()
        self.take(STR)
        self.end()

    def method(self) -> None:
        if self.take(";"):
            return
        if self.is_name() and self.peek(1) == "(":
            self.i += 1
            self.signature()
        else:
            self.type_()
            while self.take("|"):
                self.type_()
        self.end()

    def block(self) -> None:
        held, self.flag = self.flag, False
        self.need("{")
        while not self.at("}", EOF):
            self.guarded(self.statement_line)
        self.need("}")
        self.flag = held

    def statement_line(self) -> None:
        self.statement()
        self.end()

    def statement(self) -> None:
        v = self.v[self.i]
        if v in (";", "}"):
            return None
        if v in ("var", "const", "type"):
            return self.general()
        if v == "{":
            return self.block()
        if v in ("go", "defer"):
            self.i += 1
            start = self.i
            self.climb()
            if self.v[self.i - 1] != ")":
                self.i = start
                self.fail("function call expected")
            return None
        if v == "return":
            self.i += 1
            if not self.at(";", "}"):
                self.expressions()
            return None
        if v in ("break", "continue", "goto"):
            self.i += 1
            if self.is_name():
                self.i += 1
            return None
        if v == "fallthrough":
            self.i += 1
            return None
        if v == "if":
            return self.s_if()
        if v == "for":
            return self.s_for()
        if v == "switch":
            return self.s_switch()
        if v == "select":
            self.i += 1
            return self.cases()
        if self.is_name() and self.peek(1) == ":":
            self.i += 2
            if not self.at("}"):
                self.statement()
            return None
        return self.simple()

    def head(self, rule) -> None:
        held, self.flag = self.flag, True
        try:
            rule()
        finally:
            self.flag = held

    def s_if(self) -> None:
        def rule():
            if not self.at(";"):
                self.simple()
            if self.take(";"):
                self.simple()

        self.need("if")
        while True:
            self.head(rule)
            self.block()
            if not self.take("else"):
                return
            if not self.take("if"):
                return self.block()

    def s_for(self) -> None:
        self.need("for")

        def rule():
            if self.at("{"):
                return
            if self.take("range"):
                return self.climb()
            if not self.at(";"):
                self.simple(True)
            if self.take(";"):
                if not self.at(";"):
                    self.climb()
                self.need(";")
                if not self.at("{"):
                    self.simple()
            return None

        self.head(rule)
        self.block()

    def s_switch(self) -> None:
        self.need("switch")

        def rule():
            if self.at("{"):
                return
            if not self.at(";"):
                self.simple()
            if self.take(";") and not self.at("{"):
                self.simple()

        self.head(rule)
        self.cases()

    def cases(self) -> None:
        held, self.flag = self.flag, False
        self.need("{")
        while not self.at("}", EOF):
            if self.take("default"):
                self.need(":")
            else:
                self.need("case")
                self.case_item()
                while self.take(","):
                    self.case_item()
                if self.at("=", ":=", "<-"):
                    self.i += 1
                    self.climb()
                self.need(":")
            while not self.at("case", "default", "}", EOF):
                self.guarded(self.statement_line)
        self.need("}")
        self.flag = held

    def case_item(self) -> None:
        start = self.i
        if not (self.attempt(self.climb) and self.at(",", ":", "=", ":=", "<-")):
            self.i = start
            self.type_()

    def simple(self, ranged: bool = False) -> None:
        start = self.i
        self.expressions()
        v = self.v[self.i]
        if v in ("++", "--"):
            self.i += 1
        elif v == "<-":
            self.i += 1
            self.climb()
        elif v in ASSIGNS:
            self.i += 1
            if ranged and self.take("range"):
                return self.climb()
            self.expressions()
        elif not self.flag and not any(x in ("(", "<-") for x in self.v[start : self.i]):
            self.i = start
            self.fail("expression is not used")
        return None

    def expressions(self) -> None:
        self.climb()
        while self.take(","):
            self.climb()

    # expressions
    def unary(self) -> None:
        while self.at("+", "-", "!", "^", "*", "&", "<-", "~"):
            self.i += 1
        self.operand()
        self.postfix()

    def operand(self) -> None:
        v = self.v[self.i]
        if v in (STR, NUM) or self.is_name():
            self.i += 1
        elif v == "(":
            self.i += 1
            held, self.flag = self.flag, False
            start = self.i
            if not (self.attempt(self.climb) and self.at(")")):
                self.i = start
                self.type_()
            self.flag = held
            self.need(")")
        elif v == "func":
            self.i += 1
            self.signature()
            if self.at("{"):
                self.block()
        elif v in ("[", "map", "struct", "chan", "interface"):
            self.type_()
            if self.at("{"):
                self.literal()
        else:
            self.fail("expression expected")

    def literal(self) -> None:
        held, self.flag = self.flag, False
        self.need("{")
        self.listed(self.element, "}")
        self.flag = held

    def element(self) -> None:
        self.element_value()
        if self.take(":"):
            self.element_value()

    def element_value(self) -> None:
        if self.at("{"):
            self.literal()
        else:
            self.climb()

    def postfix(self) -> None:
        while True:
            v = self.v[self.i]
            if v == ".":
                self.i += 1
                if self.take("("):
                    if not self.take("type"):
                        self.type_()
                    self.need(")")
                else:
                    self.name()
            elif v == "(":
                self.i += 1
                held, self.flag = self.flag, False
                self.listed(self.argument, ")")
                self.flag = held
            elif v == "[":
                held, self.flag = self.flag, False
                if not self.attempt(self.index):
                    self.type_arguments()
                self.flag = held
            elif v == "{" and not self.flag and (self.n[self.i - 1] or self.v[self.i - 1] == "]"):
                self.literal()
            else:
                return

    def index(self) -> None:
        self.need("[")
        if not self.at(":"):
            self.climb()
        while self.take(":"):
            if not self.at("]", ":"):
                self.climb()
        self.need("]")

    def argument(self) -> None:
        start = self.i
        if not (self.attempt(self.climb) and self.at(",", ")", "...")):
            self.i = start
            self.type_()
        self.take("...")
