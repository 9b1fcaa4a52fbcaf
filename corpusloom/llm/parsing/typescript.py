"""TypeScript."""

from __future__ import annotations

import re

from .core import BAD, EOF, NUM, STR, Fault, Lexed, Parser, lex

SKIP = r"(?:\s|//[^\n\r  ]*|/\*[\s\S]*?\*/)+"
PATTERN = re.compile(
    rf"(?P<skip>{SKIP}|(?<![\s\S])\#![^\n]*)"
    r'|(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|\'(?:[^\'\\\n\r]|\\(?:\r\n|[\s\S]))*\')'
    r"|(?P<template>`)"
    r"|(?P<name>\#?[A-Za-z_$ª-\U0010ffff][\w$‌‍]*)"
    r"|(?P<num>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$]))"
    r"|(?P<slash>/(?![/*]))"
    r"|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|\+\+|--|<<|&&|\|\||\?\?|\?\.(?!\d)|\*\*|[-+*%&|^]=|[-+*%&|^~!=<>?:;,.(){}\[\]@])"
    r"|(?P<comment>/\*)|(?P<text_literal>[\"'])"
)
REGEX = re.compile(r"/(?:[^\n\r/\\\[]|\\.|\[(?:[^\]\n\r\\]|\\.)*\])+/[A-Za-z]*")
KEYWORDS = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
ASSIGNS = ["=", "+=", "-=", "*=", "/=", "%=", "**=", "&=", "|=", "^=", "<<=", ">>=", ">>>=", "&&=", "||=", "??="]
BEFORE_VALUE = frozenset("return typeof case do else in of instanceof new delete void throw await yield".split())
MODIFIERS = ("public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "accessor")


class TypeScriptParser(Parser):
    """``flag``: in the head of a for statement, where ``in`` is no operator."""

    keywords = KEYWORDS
    binary = {",": 0} | dict.fromkeys(ASSIGNS, 1) | {"?": 2, "??": 3, "||": 3, "&&": 4, "|": 5, "^": 6, "&": 7, "==": 8, "!=": 8, "===": 8, "!==": 8, "<": 9, ">": 9, "<=": 9, ">=": 9, "instanceof": 9, "in": 9, "as": 9, "satisfies": 9, "<<": 10, "+": 11, "-": 11, "*": 12, "/": 12, "%": 12, "**": 13}
    right = frozenset([*ASSIGNS, "**"])

    def lexed(self, text: str) -> Lexed:
        def template(text, i, j, out, fresh):
            while True:
                m = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*").match(text, j)
                j = m.end()
                if j >= len(text):
                    out.faults.append((i, "unterminated template"))
                    out.add(BAD, False, i, fresh)
                    return j
                if text[j] == "`":
                    out.add(STR, False, i, fresh)
                    return j + 1
                start = j + 2
                end = closing(text, start)
                if end < 0:
                    out.faults.append((i, "unterminated template"))
                    out.add(BAD, False, i, fresh)
                    return len(text)
                inner = TypeScriptParser(text[start:end])
                try:
                    inner.climb()
                    if not inner.at(EOF):
                        inner.fail("'}' expected")
                except Fault as e:
                    inner.note(e)
                out.faults += [(start + at, message) for at, message in inner.faults]
                j = end + 1

        def slash(text, i, j, out, fresh):
            last = out.value[-1] if out.value else ";"
            value = last in (STR, NUM, ")", "]", "}") or out.name[-1] and last not in BEFORE_VALUE if out.value else False
            m = None if value else REGEX.match(text, i)
            if m:
                out.add(STR, False, i, fresh)
                return m.end()
            if text.startswith("/=", i):
                out.add("/=", False, i, fresh)
                return i + 2
            out.add("/", False, i, fresh)
            return i + 1

        return lex(text, PATTERN, {"template": template, "slash": slash})

    def top(self) -> None:
        while not self.at(EOF):
            self.guarded(self.statement, close="")

    def end(self) -> None:
        """A semicolon, written or inserted."""
        if self.take(";") or self.at("}", EOF) or self.t.newline[self.i]:
            return
        self.fail("';' expected")

    def property_name(self) -> None:
        if self.n[self.i] or self.at(STR, NUM):
            self.i += 1
        elif self.take("["):
            self.climb(1)
            self.need("]")
        else:
            self.fail("property name expected")

    def block(self) -> None:
        self.need("{")
        while not self.at("}", EOF):
            self.guarded(self.statement)
        self.need("}")

    def parens(self) -> None:
        self.need("(")
        self.climb()
        self.need(")")

    def statement(self) -> None:
        v = self.v[self.i]
        if v == "{":
            return self.block()
        if v == ";":
            self.i += 1
            return None
        if v == "@":
            while self.take("@"):
                self.unary()
            return self.statement()
        if self.n[self.i]:
            nxt = self.peek(1)
            if v in ("type", "interface", "enum", "namespace", "module", "abstract", "declare", "async", "let", "global") and not self.t.newline[self.i + 1] and (self.n[self.i + 1] or v == "let" and nxt in ("[", "{") or v in ("module", "global", "declare") and nxt in (STR, "{")):
                if v == "async" and nxt != "function":
                    return self.expression_statement()
                return getattr(self, "s_" + v)()
            if v in KEYWORDS:
                rule = getattr(self, "s_" + v, None)
                if rule is not None and not (v == "import" and nxt in ("(", ".")):
                    return rule()
            elif nxt == ":":
                self.i += 2
                return self.statement()
        return self.expression_statement()

    def expression_statement(self) -> None:
        self.climb()
        self.end()

    # declarations
    def s_var(self) -> None:
        self.i += 1
        if self.at("enum"):
            return self.s_enum()
        self.bindings()
        return self.end()

    s_const = s_let = s_var

    def bindings(self) -> None:
        while True:
            self.target()
            self.take("!")
            if self.take(":"):
                self.type_()
            if self.take("="):
                self.climb(1)
            if not self.take(","):
                return

    def target(self) -> None:
        if self.take("{"):
            self.listed(self.target_property, "}")
        elif self.take("["):
            self.listed(self.target_element, "]")
        else:
            self.name()

    def target_property(self) -> None:
        if self.take("..."):
            return self.target()
        self.property_name()
        if self.take(":"):
            self.target()
        if self.take("="):
            self.climb(1)
        return None

    def target_element(self) -> None:
        if self.at(",", "]"):
            return
        self.take("...")
        self.target()
        if self.take("="):
            self.climb(1)

    def s_async(self) -> None:
        self.i += 1
        self.s_function()

    def s_function(self) -> None:
        self.need("function")
        self.take("*")
        if self.is_name():
            self.i += 1
        self.signature()
        if self.at("{"):
            self.block()
        else:
            self.end()

    def signature(self) -> None:
        if self.at("<"):
            self.type_parameters()
        self.need("(")
        self.listed(self.parameter, ")")
        if self.take(":"):
            self.return_type()

    def return_type(self) -> None:
        if self.at("asserts") and self.n[self.i + 1] and not self.t.newline[self.i + 1]:
            self.i += 1
        if (self.is_name() or self.at("this")) and self.peek(1) == "is":
            self.i += 2
        self.type_()

    def parameter(self) -> None:
        while self.take("@"):
            self.unary()
        while self.v[self.i] in MODIFIERS and (self.n[self.i + 1] or self.peek(1) in ("{", "[")):
            self.i += 1
        self.take("...")
        if not self.take("this"):
            self.target()
        self.take("?")
        if self.take(":"):
            self.type_()
        if self.take("="):
            self.climb(1)

    def s_class(self) -> None:
        self.need("class")
        if self.is_name() and not (self.at("implements") and self.n[self.i + 1]):
            self.i += 1
        if self.at("<"):
            self.type_parameters()
        if self.take("extends"):
            self.unary()
            if self.at("<"):
                self.type_arguments()
        if self.take("implements"):
            self.type_()
            while self.take(","):
                self.type_()
        self.need("{")
        while not self.at("}", EOF):
            self.guarded(self.class_member)
        self.need("}")

    def class_member(self) -> None:
        if self.take(";"):
            return
        while self.take("@"):
            self.unary()
        if self.at("static") and self.peek(1) == "{":
            self.i += 1
            return self.block()
        while self.v[self.i] in (*MODIFIERS, "async", "get", "set") and self.peek(1) not in ("(", "=", ";", ":", "?", "!", "}", "<", EOF):
            self.i += 1
        self.take("*")
        if self.at("[") and self.is_name(1) and self.peek(2) == ":":
            self.index_signature()
            return self.end()
        self.property_name()
        self.take("?") or self.take("!")
        if self.at("(", "<"):
            self.signature()
            if self.at("{"):
                return self.block()
            return self.end()
        if self.take(":"):
            self.type_()
        if self.take("="):
            self.climb(1)
        return self.end()

    def index_signature(self) -> None:
        self.need("[")
        self.name()
        self.need(":")
        self.type_()
        self.need("]")
        if self.take(":"):
            self.type_()

    def s_interface(self) -> None:
        self.i += 1
        self.name()
        if self.at("<"):
            self.type_parameters()
        if self.take("extends"):
            self.type_()
            while self.take(","):
                self.type_()
        self.type_members()

    def s_type(self) -> None:
        self.i += 1
        self.name()
        if self.at("<"):
            self.type_parameters()
        self.need("=")
        self.type_()
        self.end()

    def s_enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")
        self.listed(self.enumerator, "}")

    def enumerator(self) -> None:
        self.property_name()
        if self.take("="):
            self.climb(1)

    def s_namespace(self) -> None:
        self.i += 1
        if not self.take(STR):
            self.name()
            while self.take("."):
                self.name()
        if self.at("{"):
            self.block()
        else:
            self.end()

    s_module = s_namespace

    def s_global(self) -> None:
        self.i += 1
        self.block()

    def s_declare(self) -> None:
        self.i += 1
        self.statement()

    s_abstract = s_declare

    def s_import(self) -> None:
        self.i += 1
        if self.take(STR):
            return self.end()
        if self.at("type") and (self.n[self.i + 1] and self.peek(1) != "from" or self.peek(1) in ("{", "*")):
            self.i += 1
        if self.is_name():
            self.i += 1
            if self.take("="):
                self.climb(1)
                return self.end()
            if not self.at("from"):
                self.need(",")
        if self.take("*"):
            self.need("as")
            self.name()
        elif self.take("{"):
            self.listed(self.specifier, "}")
        self.need("from")
        self.need(STR)
        if self.at("with", "assert") and not self.t.newline[self.i]:
            self.i += 1
            self.balanced()
        return self.end()

    def specifier(self) -> None:
        for _ in range(4):
            if self.n[self.i] or self.at(STR):
                self.i += 1
        if self.v[self.i - 1] in (",", "{"):
            self.fail("name expected")

    def s_export(self) -> None:
        self.i += 1
        if self.take("default"):
            if self.at("function", "class", "abstract", "interface") or self.at("async") and self.peek(1) == "function":
                return self.statement()
            self.climb(1)
            return self.end()
        if self.take("="):
            self.climb(1)
            return self.end()
        if self.at("as") and self.peek(1) == "namespace":
            self.i += 2
            self.name()
            return self.end()
        if self.at("type") and self.peek(1) in ("{", "*"):
            self.i += 1
        if self.take("*"):
            if self.take("as"):
                self.i += 1
            self.need("from")
            self.need(STR)
            return self.end()
        if self.take("{"):
            self.listed(self.specifier, "}")
            if self.take("from"):
                self.need(STR)
            return self.end()
        if not (self.at("var", "const", "function", "class", "enum", "import", "@") or self.v[self.i] in ("let", "type", "interface", "namespace", "module", "abstract", "declare", "async")):
            self.fail("declaration expected")
        return self.statement()

    # statements
    def s_if(self) -> None:
        while True:
            self.i += 1
            self.parens()
            self.statement()
            if not self.take("else"):
                return
            if not self.at("if"):
                return self.statement()

    def s_while(self) -> None:
        self.i += 1
        self.parens()
        self.statement()

    s_with = s_while

    def s_do(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.parens()
        self.take(";")

    def s_for(self) -> None:
        self.i += 1
        self.take("await")
        self.need("(")
        if not self.take(";"):
            self.flag = True
            if self.at("var", "const") or self.at("let") and (self.n[self.i + 1] or self.peek(1) in ("{", "[")):
                self.i += 1
                self.bindings()
            elif self.is_name() and self.peek(1) == "of":
                self.i += 1
            else:
                self.climb()
            self.flag = False
            if self.at("of", "in"):
                self.i += 1
                self.climb()
                self.need(")")
                return self.statement()
            self.need(";")
        if not self.at(";"):
            self.climb()
        self.need(";")
        if not self.at(")"):
            self.climb()
        self.need(")")
        return self.statement()

    def s_switch(self) -> None:
        self.i += 1
        self.parens()
        self.need("{")
        while not self.at("}", EOF):
            if not self.take("default"):
                self.need("case")
                self.climb()
            self.need(":")
            while not self.at("case", "default", "}", EOF):
                self.guarded(self.statement)
        self.need("}")

    def s_try(self) -> None:
        self.i += 1
        self.block()
        caught = self.take("catch")
        if caught:
            if self.take("("):
                self.target()
                if self.take(":"):
                    self.type_()
                self.need(")")
            self.block()
        if self.take("finally"):
            self.block()
        elif not caught:
            self.fail("'catch' or 'finally' expected")

    def s_return(self) -> None:
        self.i += 1
        if not (self.at(";", "}", EOF) or self.t.newline[self.i]):
            self.climb()
        self.end()

    def s_throw(self) -> None:
        self.i += 1
        self.climb()
        self.end()

    def s_break(self) -> None:
        self.i += 1
        if self.is_name() and not self.t.newline[self.i]:
            self.i += 1
        self.end()

    s_continue = s_debugger = s_break

    # types
    def type_parameters(self) -> None:
        self.need("<")
        self.listed(self.type_parameter, ">", empty=False)

    def type_parameter(self) -> None:
        while self.at("const", "in", "out") and self.n[self.i + 1]:
            self.i += 1
        self.name()
        if self.take("extends"):
            self.type_()
        if self.take("="):
            self.type_()

    def type_arguments(self) -> None:
        self.need("<")
        self.listed(self.type_, ">", empty=False, trailing=False)

    def type_(self) -> None:
        self.deeper()
        if self.at("(", "<", "new", "abstract") and self.attempt(self.function_type):
            self.depth -= 1
            return
        self.take("|") or self.take("&")
        self.type_operand()
        while self.at("|", "&"):
            self.i += 1
            self.type_operand()
        if self.at("extends") and not self.t.newline[self.i]:
            self.i += 1
            self.type_()
            self.need("?")
            self.type_()
            self.need(":")
            self.type_()
        self.depth -= 1

    def function_type(self) -> None:
        self.take("abstract")
        self.take("new")
        if self.at("<"):
            self.type_parameters()
        self.need("(")
        self.listed(self.parameter, ")")
        self.need("=>")
        self.return_type()

    def type_operand(self) -> None:
        v = self.v[self.i]
        if v in ("keyof", "unique", "readonly", "infer") and (self.n[self.i + 1] or self.peek(1) in ("(", "{", "[", STR)):
            self.i += 1
            return self.type_operand()
        if v == "typeof":
            self.i += 1
            while self.n[self.i]:
                self.i += 1
                if not self.take("."):
                    break
            if self.at("<"):
                self.type_arguments()
        elif v in (STR, NUM, "null", "this", "void", "true", "false"):
            self.i += 1
        elif v == "-" and self.peek(1) == NUM:
            self.i += 2
        elif v == "import":
            self.i += 1
            self.balanced()
            while self.take("."):
                self.name()
        elif v == "(":
            self.i += 1
            self.type_()
            self.need(")")
        elif v == "[":
            self.i += 1
            self.listed(self.tuple_item, "]")
        elif v == "{":
            self.type_members()
        elif self.is_name():
            self.i += 1
            while self.take("."):
                self.name()
            if self.at("<") and not self.t.newline[self.i]:
                self.type_arguments()
        else:
            self.fail("type expected")
        while self.at("[") and not self.t.newline[self.i]:
            self.i += 1
            if not self.at("]"):
                self.type_()
            self.need("]")
        return None

    def tuple_item(self) -> None:
        self.take("...")
        if self.is_name() and (self.peek(1) == ":" or self.peek(1) == "?" and self.peek(2) == ":"):
            self.i += 1
            self.take("?")
            self.need(":")
        self.type_()
        self.take("?")

    def type_members(self) -> None:
        self.need("{")
        while not self.at("}", EOF):
            self.guarded(self.type_member, stops=(";", ","))
        self.need("}")

    def type_member(self) -> None:
        if self.at("+", "-"):
            self.i += 1
        while self.at("readonly", "get", "set") and (self.n[self.i + 1] or self.peek(1) in ("[", STR)):
            self.i += 1
        if self.at("(", "<") or self.at("new") and self.peek(1) in ("(", "<"):
            self.take("new")
            self.signature()
        elif self.at("[") and self.is_name(1) and self.peek(2) in (":", "in"):
            self.i += 2
            self.i += 1
            self.type_()
            if self.take("as"):
                self.type_()
            self.need("]")
            if self.at("+", "-"):
                self.i += 1
            self.take("?")
            if self.take(":"):
                self.type_()
        else:
            self.property_name()
            self.take("?")
            if self.at("(", "<"):
                self.signature()
            elif self.take(":"):
                self.type_()
        if not self.take(","):
            self.end()

    # expressions
    def joins(self, op: str) -> bool | None:
        if op == "in" and self.flag:
            return False
        if op in ("as", "satisfies"):
            if self.t.newline[self.i]:
                return False
            self.i += 1
            if not self.take("const"):
                self.type_()
            return None
        if op == "?":
            self.i += 1
            self.climb(1)
            self.need(":")
            self.climb(1)
            return None
        if op == ">":
            at = self.t.at
            while self.peek(1) in (">", ">=", "=") and at[self.i + 1] == at[self.i] + 1:
                self.i += 1
        return True

    def unary(self) -> None:
        v = self.v[self.i]
        if v in ("+", "-", "!", "~", "++", "--", "typeof", "void", "delete") or v == "await" and (self.n[self.i + 1] or self.peek(1) in ("(", "[", "{", STR)):
            self.i += 1
            return self.unary()
        if v == "yield":
            self.i += 1
            self.take("*")
            if not (self.t.newline[self.i] or self.at(")", "]", "}", ",", ";", ":", EOF)):
                self.climb(1)
            return None
        if v == "async" and not self.t.newline[self.i + 1]:
            if self.peek(1) == "function":
                self.i += 1
                self.s_function()
                return self.postfix()
            if self.is_name(1) and self.peek(2) == "=>":
                self.i += 3
                return self.arrow_body()
            if self.peek(1) in ("(", "<") and self.attempt(lambda: (self.need("async"), self.arrow())):
                return None
        if v in ("(", "<"):
            if self.attempt(self.arrow):
                return None
            if v == "<":
                self.i += 1
                self.type_()
                self.need(">")
                return self.unary()
        if self.is_name() and self.peek(1) == "=>":
            self.i += 2
            return self.arrow_body()
        self.primary()
        return self.postfix()

    def arrow(self) -> None:
        self.signature()
        if self.t.newline[self.i]:
            self.fail("'=>' expected")
        self.need("=>")
        self.arrow_body()

    def arrow_body(self) -> None:
        held, self.flag = self.flag, False
        if self.at("{"):
            self.block()
        else:
            self.climb(1)
        self.flag = held

    def primary(self) -> None:
        v = self.v[self.i]
        if v in (STR, NUM, "this", "super", "null", "true", "false"):
            self.i += 1
        elif v == "(":
            held, self.flag = self.flag, False
            self.parens()
            self.flag = held
        elif v == "[":
            self.i += 1
            self.listed(self.element, "]")
        elif v == "{":
            self.i += 1
            self.listed(self.entry, "}")
        elif v == "function":
            self.s_function()
        elif v == "class":
            self.s_class()
        elif v == "new":
            self.i += 1
            if self.take("."):
                self.name()
                return
            self.primary()
            while True:
                if self.take("."):
                    self.i += 1
                elif self.at("["):
                    self.i += 1
                    self.climb()
                    self.need("]")
                else:
                    break
            if self.at("<"):
                self.attempt(self.type_arguments)
            if self.at("("):
                self.arguments()
        elif v == "import":
            self.i += 1
            if self.take("."):
                self.name()
            else:
                self.arguments()
        elif self.is_name():
            self.i += 1
        else:
            self.fail("expression expected")

    def element(self) -> None:
        if self.at(",", "]"):
            return
        self.take("...")
        self.climb(1)

    def entry(self) -> None:
        if self.take("..."):
            return self.climb(1)
        while self.at("get", "set", "async") and self.peek(1) not in ("(", ":", ",", "}", "=", "<"):
            self.i += 1
        self.take("*")
        plain = self.is_name()
        self.property_name()
        if self.at("(", "<"):
            self.signature()
            return self.block()
        if self.take(":"):
            return self.climb(1)
        if not plain:
            self.fail("':' expected")
        if self.take("="):
            self.climb(1)
        return None

    def arguments(self) -> None:
        self.need("(")
        held, self.flag = self.flag, False
        self.listed(self.element, ")")
        self.flag = held

    def generic_call(self) -> None:
        self.type_arguments()
        if not self.at("(", STR, ")", "]", ",", ";", ".", "?.", "}", EOF):
            self.fail("'(' expected")

    def postfix(self) -> None:
        while True:
            v = self.v[self.i]
            if v == ".":
                self.i += 1
                if not self.n[self.i]:
                    self.fail("property expected")
                self.i += 1
            elif v == "?.":
                self.i += 1
                if self.n[self.i]:
                    self.i += 1
                elif not self.at("(", "["):
                    self.fail("property expected")
            elif v == "[":
                self.i += 1
                self.climb()
                self.need("]")
            elif v == "(":
                self.arguments()
            elif v == STR and self.text[self.t.at[self.i]] == "`":
                self.i += 1
            elif v == "<" and self.attempt(self.generic_call):
                pass
            elif v in ("++", "--") and not self.t.newline[self.i]:
                self.i += 1
            elif v == "!" and not self.t.newline[self.i]:
                self.i += 1
            else:
                return


TEXT = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|//[^\n]*|/\*[\s\S]*?\*/|`|[{}]")


def closing(text: str, i: int) -> int:
    """Where the brace is closed that was opened just before ``i``; -1 if nowhere."""
    level = 1
    while m := TEXT.search(text, i):
        v, i = m[0], m.end()
        if v == "{":
            level += 1
        elif v == "}":
            level -= 1
            if level == 0:
                return m.start()
        elif v == "`":
            skip = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
            while True:
                i = skip.match(text, i).end()
                if i >= len(text):
                    return -1
                if text[i] == "`":
                    i += 1
                    break
                inner = closing(text, i + 2)
                if inner < 0:
                    return -1
                i = inner + 1
    return -1
