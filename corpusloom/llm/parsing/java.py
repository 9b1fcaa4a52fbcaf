"""Java."""

from __future__ import annotations

import re

from .core import EOF, NUM, STR, Lexed, Parser, lex

PATTERN = re.compile(
    r"(?P<skip>(?:\s|//[^\n\r]*|/\*[\s\S]*?\*/)+)"
    r'|(?P<str>"""[ \t\f]*\r?\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""|"(?:[^"\\\n\r]|\\.)*"(?!")|""(?!")|\'(?:[^\'\\\n\r]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)\')'
    r"|(?P<name>[A-Za-z_$ª-\U0010ffff][\w$]*)"
    r"|(?P<num>0[xX][\da-fA-F_]*\.?[\da-fA-F_]*(?:[pP][+-]?\d+)?[lLfFdD]?(?!\w)|0[bB][01_]+[lL]?(?!\w)|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?(?!\w))"
    r"|(?P<op>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||<<|[-+*/%&|^=!<>]=|[-+*/%&|^~!=<>?:;,.(){}\[\]@])"
    r"|(?P<comment>/\*)|(?P<text_literal>[\"'])"
)
MODIFIERS = frozenset("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
PRIMITIVES = frozenset("int long short byte char boolean float double void".split())
KEYWORDS = MODIFIERS - {"sealed"} | PRIMITIVES | frozenset("assert break case catch class const continue do else enum extends finally for goto if implements import instanceof interface new package return super switch this throw throws try while true false null".split())
ASSIGNS = ["=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="]


class JavaParser(Parser):
    """``flag``: in a label or its guard, where an arrow begins what the case does, and not the body of a lambda."""

    keywords = KEYWORDS
    binary = dict.fromkeys(ASSIGNS, 1) | {"?": 2, "||": 3, "&&": 4, "|": 5, "^": 6, "&": 7, "==": 8, "!=": 8, "<": 9, ">": 9, "<=": 9, ">=": 9, "instanceof": 9, "<<": 10, "+": 11, "-": 11, "*": 12, "/": 12, "%": 12}
    right = frozenset(ASSIGNS)

    def lexed(self, text: str) -> Lexed:
        return lex(text, PATTERN)

    def top(self) -> None:
        while not self.at(EOF):
            self.guarded(self.unit, close="")

    def unit(self) -> None:
        if self.take(";"):
            return
        start = self.i
        while self.at("@") and self.peek(1) != "interface":
            self.annotation()
        if self.take("package"):
            self.dotted()
            return self.need(";")
        if self.at("import") and self.i == start:
            self.i += 1
            self.take("static")
            self.dotted()
            if self.take("."):
                self.need("*")
            return self.need(";")
        self.i = start
        self.modifiers()
        if not self.type_declaration():
            self.fail("class, interface, enum or record expected")
        return None

    def dotted(self) -> None:
        self.name()
        while self.at(".") and self.is_name(1):
            self.i += 2

    def annotation(self) -> None:
        self.need("@")
        self.dotted()
        if self.at("("):
            self.balanced()

    def modifiers(self) -> None:
        while True:
            if self.at("@") and self.peek(1) != "interface":
                self.annotation()
            elif self.v[self.i] in MODIFIERS and not (self.at("default") and self.peek(1) in (":", "->")):
                self.i += 1
            elif self.at("non") and self.peek(1) == "-":
                self.i += 3
            else:
                return

    def type_declaration(self) -> bool:
        v = self.v[self.i]
        if v == "@" and self.peek(1) == "interface":
            self.i += 1
        elif not (v in ("class", "interface", "enum") or v == "record" and self.is_name(1) and self.peek(2) in ("(", "<")):
            return False
        kind = self.v[self.i]
        self.i += 1
        self.name()
        if self.at("<"):
            self.type_parameters()
        if kind == "record":
            self.need("(")
            self.listed(self.parameter, ")", trailing=False)
        while self.at("extends", "implements", "permits"):
            self.i += 1
            self.type_()
            while self.take(","):
                self.type_()
        self.need("{")
        if kind == "enum":
            while self.is_name() or self.at("@"):
                while self.at("@"):
                    self.annotation()
                self.name()
                if self.at("("):
                    self.arguments()
                if self.at("{"):
                    self.class_body()
                if not self.take(","):
                    break
            if not self.take(";") and not self.at("}"):
                self.fail("';' or '}' expected")
        self.members()
        return True

    def type_parameters(self) -> None:
        self.need("<")
        self.listed(self.type_parameter, ">", empty=False, trailing=False)

    def type_parameter(self) -> None:
        while self.at("@"):
            self.annotation()
        self.name()
        if self.take("extends"):
            self.type_()
            while self.take("&"):
                self.type_()

    def class_body(self) -> None:
        self.need("{")
        self.members()

    def members(self) -> None:
        while not self.at("}", EOF):
            self.guarded(self.member)
        self.need("}")

    def member(self) -> None:
        if self.take(";"):
            return
        if self.at("{") or self.at("static") and self.peek(1) == "{":
            self.take("static")
            return self.block()
        self.modifiers()
        if self.type_declaration():
            return None
        if self.at("<"):
            self.type_parameters()
        if self.is_name() and self.peek(1) in ("(", "{"):
            self.i += 1
            if self.at("{"):
                return self.block()
            return self.method()
        self.type_()
        self.name()
        if self.at("("):
            return self.method()
        return self.variables()

    def method(self) -> None:
        self.need("(")
        self.listed(self.parameter, ")", trailing=False)
        self.brackets()
        if self.take("throws"):
            self.type_()
            while self.take(","):
                self.type_()
        if self.take("default"):
            self.initializer()
        if not self.take(";"):
            self.block()

    def parameter(self) -> None:
        self.modifiers()
        self.type_()
        self.take("...")
        if self.take("this"):
            return
        self.name()
        self.brackets()

    def brackets(self) -> None:
        while self.at("[") and self.peek(1) == "]":
            self.i += 2

    def variables(self) -> None:
        """After the first name."""
        while True:
            self.brackets()
            if self.take("="):
                self.initializer()
            if not self.take(","):
                break
            self.name()
        self.need(";")

    def initializer(self) -> None:
        if self.take("{"):
            self.listed(self.initializer, "}")
        elif self.at("@"):
            self.annotation()
        else:
            self.climb()

    def type_(self) -> None:
        while self.at("@"):
            self.annotation()
        if self.v[self.i] in PRIMITIVES:
            self.i += 1
        elif self.take("?"):
            if self.at("extends", "super"):
                self.i += 1
                self.type_()
            return
        else:
            while True:
                self.name()
                if self.at("<"):
                    self.type_arguments()
                if not (self.at(".") and self.is_name(1)):
                    break
                self.i += 1
        self.brackets()

    def type_arguments(self) -> None:
        self.need("<")
        if self.take(">"):
            return
        self.listed(self.type_, ">", trailing=False)

    def block(self) -> None:
        self.need("{")
        while not self.at("}", EOF):
            self.guarded(self.statement)
        self.need("}")

    def parens(self) -> None:
        held, self.flag = self.flag, False
        self.need("(")
        self.climb()
        self.need(")")
        self.flag = held

    def local(self) -> None:
        self.modifiers()
        self.type_()
        self.name()
        if not self.at("=", ";", ",", "[", ":"):
            self.fail("';' expected")

    def statement(self) -> None:
        v = self.v[self.i]
        rule = getattr(self, "s_" + v, None) if v.isalpha() else None
        if v == "{":
            self.block()
        elif v == ";":
            self.i += 1
        elif rule is not None and not (v == "yield" and self.peek(1) in ("=", ".", "(")):
            self.i += 1
            rule()
        elif v in ("final", "@", "abstract", "static") or v in ("class", "interface", "enum", "record", "sealed"):
            start = self.i
            self.modifiers()
            if not self.type_declaration():
                self.i = start
                self.local()
                self.variables()
        elif self.is_name() and self.peek(1) == ":" and self.peek(2) != ":":
            self.i += 2
            self.statement()
        elif (v in PRIMITIVES or self.is_name()) and self.attempt(self.local):
            self.variables()
        else:
            start = self.i
            self.climb()
            self.effect(start)
            self.need(";")

    def effect(self, start: int) -> None:
        """An expression that stands as a statement must do something."""
        values = self.v[start : self.i]
        if not any(x in ("(", "++", "--", "new") or x in ASSIGNS for x in values):
            self.i = start
            self.fail("not a statement")

    def s_if(self) -> None:
        while True:
            self.parens()
            self.statement()
            if not self.take("else"):
                return
            if not self.take("if"):
                return self.statement()

    def s_while(self) -> None:
        self.parens()
        self.statement()

    def s_do(self) -> None:
        self.statement()
        self.need("while")
        self.parens()
        self.need(";")

    def s_for(self) -> None:
        self.need("(")
        if not self.take(";"):
            if self.attempt(self.local):
                if self.take(":"):
                    self.climb()
                    self.need(")")
                    return self.statement()
                self.variables()
            else:
                self.climb()
                while self.take(","):
                    self.climb()
                self.need(";")
        if not self.at(";"):
            self.climb()
        self.need(";")
        if not self.at(")"):
            self.climb()
            while self.take(","):
                self.climb()
        self.need(")")
        return self.statement()

    def s_switch(self) -> None:
        self.parens()
        self.cases()

    def cases(self) -> None:
        self.need("{")
        while not self.at("}", EOF):
            if self.take("default"):
                pass
            else:
                self.need("case")
                held, self.flag = self.flag, True
                self.pattern()
                while self.take(","):
                    self.pattern()
                if self.take("when"):
                    self.climb(2)
                self.flag = held
            if self.take("->"):
                if self.at("{", "throw"):
                    self.statement()
                else:
                    self.climb()
                    self.need(";")
            else:
                self.need(":")
                while not self.at("case", "default", "}", EOF):
                    self.guarded(self.statement)
        self.need("}")

    def pattern(self) -> None:
        if self.take("default"):
            return
        if not self.attempt(self.type_pattern):
            self.climb(2)

    def type_pattern(self) -> None:
        self.modifiers()
        self.type_()
        if self.take("("):
            self.listed(self.type_pattern, ")", trailing=False)
            if self.is_name() and not (self.at("when") and self.peek(1) not in ("->", ":", ",", ")", "when", "&&")):
                self.i += 1
        else:
            self.name()

    def s_return(self) -> None:
        if not self.at(";"):
            self.climb()
        self.need(";")

    def s_throw(self) -> None:
        self.climb()
        self.need(";")

    s_yield = s_throw

    def s_break(self) -> None:
        if self.is_name():
            self.i += 1
        self.need(";")

    s_continue = s_break

    def s_assert(self) -> None:
        self.climb()
        if self.take(":"):
            self.climb()
        self.need(";")

    def s_synchronized(self) -> None:
        self.parens()
        self.block()

    def s_try(self) -> None:
        managed = self.take("(")
        if managed:
            while not self.take(")"):
                if not (self.attempt(self.local) and (self.need("=") or True)):
                    pass
                self.climb()
                if not self.take(";"):
                    self.need(")")
                    break
        self.block()
        caught = managed
        while self.take("catch"):
            self.need("(")
            self.modifiers()
            self.type_()
            while self.take("|"):
                self.type_()
            self.name()
            self.need(")")
            self.block()
            caught = True
        if self.take("finally"):
            self.block()
        elif not caught:
            self.fail("'catch' or 'finally' expected")

    # expressions
    def joins(self, op: str) -> bool | None:
        if op == "?":
            self.i += 1
            self.climb(1)
            self.need(":")
            self.climb(2)
            return None
        if op == "instanceof":
            self.i += 1
            self.take("final")
            if not self.attempt(self.type_pattern):
                self.type_()
            return None
        if op == ">":
            # shifts: > > and > > > without white space between
            at = self.t.at
            while self.peek(1) in (">", ">=") and at[self.i + 1] == at[self.i] + 1:
                self.i += 1
        return True

    def unary(self) -> None:
        v = self.v[self.i]
        if v in ("+", "-", "!", "~", "++", "--"):
            self.i += 1
            return self.unary()
        if v == "switch":
            self.i += 1
            self.parens()
            self.cases()
            return self.postfix()
        if v == "(":
            if not self.flag and self.attempt(self.lambda_head) or self.attempt(self.cast):
                return None
        if not self.flag and self.is_name() and self.peek(1) == "->":
            self.i += 2
            return self.lambda_body()
        self.primary()
        return self.postfix()

    def listed(self, item, close: str, separator: str = ",", empty: bool = True, trailing: bool = True) -> None:
        held, self.flag = self.flag, False
        super().listed(item, close, separator, empty, trailing)
        self.flag = held

    def lambda_head(self) -> None:
        self.need("(")
        if self.is_name() and self.peek(1) in (",", ")"):
            self.listed(self.name, ")", trailing=False)
        else:
            self.listed(self.parameter, ")", trailing=False)
        self.need("->")
        self.lambda_body()

    def lambda_body(self) -> None:
        if self.at("{"):
            self.block()
        else:
            self.climb()

    def cast(self) -> None:
        self.need("(")
        primitive = self.v[self.i] in PRIMITIVES
        self.type_()
        while self.take("&"):
            self.type_()
        self.need(")")
        if primitive or self.is_name() or self.at(STR, NUM, "(", "!", "~", "this", "super", "new", "true", "false", "null", "switch") or self.v[self.i] in PRIMITIVES:
            self.unary()
        else:
            self.fail("operand expected")

    def arguments(self) -> None:
        self.need("(")
        self.listed(self.climb, ")", trailing=False)

    def primary(self) -> None:
        v = self.v[self.i]
        if v in (STR, NUM, "this", "super", "true", "false", "null"):
            self.i += 1
            if self.at("(") and v in ("this", "super"):
                self.arguments()
        elif v == "(":
            self.parens()
        elif v == "new":
            self.i += 1
            if self.v[self.i] in PRIMITIVES:
                self.i += 1
            else:
                while True:
                    self.name()
                    if self.at("<"):
                        self.type_arguments()
                    if not self.take("."):
                        break
            if self.at("["):
                while self.take("["):
                    if not self.at("]"):
                        self.climb()
                    self.need("]")
                if self.at("{"):
                    self.initializer()
            else:
                self.arguments()
                if self.at("{"):
                    self.class_body()
        elif v in PRIMITIVES:
            self.type_()
            if not self.at("::", "."):
                self.fail("expression expected")
        elif self.is_name():
            self.i += 1
            if self.at("<") and self.attempt(self.generic_reference) or self.at("[") and self.peek(1) == "]" and self.attempt(self.array_reference):
                pass
            elif self.at("("):
                self.arguments()
        else:
            self.fail("illegal start of expression")

    def generic_reference(self) -> None:
        self.type_arguments()
        self.brackets()
        if not self.at("::"):
            self.fail("'::' expected")

    def array_reference(self) -> None:
        self.brackets()
        if not self.at("::", "."):
            self.fail("'::' expected")

    def postfix(self) -> None:
        while True:
            v = self.v[self.i]
            if v == ".":
                self.i += 1
                if self.at("<"):
                    self.type_arguments()
                if self.at("new"):
                    self.primary()
                    continue
                if not self.take("class") and not self.take("this") and not self.take("super"):
                    self.name()
                if self.at("("):
                    self.arguments()
            elif v == "[":
                self.i += 1
                self.climb()
                self.need("]")
            elif v == "::":
                self.i += 1
                if not self.take("new"):
                    self.name()
            elif v in ("++", "--"):
                self.i += 1
            else:
                return
