"""Rust."""

from __future__ import annotations

import re

from .core import EOF, NUM, STR, Lexed, Parser, lex

PATTERN = re.compile(
    r"(?P<skip>(?:\s|//[^\n]*)+|(?<![\s\S])\#!(?!\s*\[)[^\n]*)"
    r"|(?P<long_comment>/\*)"
    r"|(?P<str>(?:b|c)?\"(?:[^\"\\]|\\[\s\S])*\"|(?:b|c)?r(?P<hash>\#*)\"[\s\S]*?\"(?P=hash)|b?'(?:[^'\\\n\t]|\\(?:x[\da-fA-F]{2}|u\{[\da-fA-F_]+\}|[nrt0\\'\"]))')"
    r"|(?P<name>(?:r\#)?[A-Za-z_ª-\U0010ffff]\w*|'[A-Za-z_]\w*(?!'))"
    r"|(?P<num>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.A-Za-z_])[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:(?<=[\d_a-fA-F.])(?:[iuf](?:8|16|32|64|128|size)))?(?!\w))"
    r"|(?P<op><<=|\.\.\.|\.\.=|\.\.|::|->|=>|&&|\|\||==|!=|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^<>=!~()\[\]{},;.:@#$?])"
    r"|(?P<text_literal>[\"'])"
)
KEYWORDS = frozenset("as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn".split())
ITEMS = frozenset("fn struct enum impl trait mod use const static type extern pub unsafe async macro_rules union".split())
ASSIGNS = ["=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>="]


class RustParser(Parser):
    """``flag``: where a brace after a path opens a block, not a struct."""

    keywords = KEYWORDS
    binary = dict.fromkeys(ASSIGNS, 1) | {"..": 2, "..=": 2, "||": 3, "&&": 4, "==": 5, "!=": 5, "<": 5, ">": 5, "<=": 5, ">=": 5, "|": 6, "^": 7, "&": 8, "<<": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "as": 12}
    right = frozenset(ASSIGNS)

    def lexed(self, text: str) -> Lexed:
        def comment(text, i, j, out, fresh):
            level = 1
            for m in re.compile(r"/\*|\*/").finditer(text, j):
                level += 1 if m[0] == "/*" else -1
                if level == 0:
                    return m.end()
            out.faults.append((i, "unterminated comment"))
            return len(text)

        return lex(text, PATTERN, {"long_comment": comment})

    def top(self) -> None:
        while not self.at(EOF):
            self.guarded(self.item, close="")

    def attributes(self) -> None:
        while self.at("#"):
            self.i += 1
            self.take("!")
            if not self.at("["):
                self.fail("'[' expected")
            self.balanced()

    def visibility(self) -> None:
        if self.take("pub") and self.at("(") and self.peek(1) in ("crate", "self", "super", "in"):
            self.balanced()

    # items
    def item(self) -> None:
        self.attributes()
        if self.at("}", EOF) and self.v[self.i - 1] == "]":
            return
        self.visibility()
        v = self.v[self.i]
        if v == "use":
            self.i += 1
            self.use_tree()
            return self.need(";")
        if v == "mod":
            self.i += 1
            self.name()
            if self.take(";"):
                return None
            return self.items()
        if v == "type":
            self.i += 1
            self.name()
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            if self.take("="):
                self.type_()
            self.where()
            return self.need(";")
        if v in ("const", "static") and not self.at_function():
            self.i += 1
            self.take("mut")
            if not self.take("_"):
                self.name()
            self.need(":")
            self.type_()
            if self.take("="):
                self.climb()
            return self.need(";")
        if v == "struct" or v == "union" and self.is_name(1):
            self.i += 1
            self.name()
            self.generics()
            self.where()
            if self.at("("):
                self.i += 1
                self.listed(self.tuple_field, ")")
                self.where()
                return self.need(";")
            if self.take(";"):
                return None
            self.need("{")
            return self.listed(self.field, "}")
        if v == "enum":
            self.i += 1
            self.name()
            self.generics()
            self.where()
            self.need("{")
            return self.listed(self.variant, "}")
        if v == "trait" or v in ("unsafe", "auto") and self.peek(1) == "trait":
            while not self.take("trait"):
                self.i += 1
            self.name()
            self.generics()
            if self.take(":"):
                self.bounds()
            self.where()
            return self.items()
        if v == "impl" or v == "unsafe" and self.peek(1) == "impl":
            self.take("unsafe")
            self.need("impl")
            if self.at("<"):
                self.generics()
            self.take("!")
            self.type_()
            if self.take("for"):
                self.type_()
            self.where()
            return self.items()
        if v == "extern" and self.peek(1) == "crate":
            while not self.at(";", EOF):
                self.i += 1
            return self.need(";")
        if v == "extern" and self.peek(1 + (self.peek(1) == STR)) == "{":
            self.i += 1 + (self.peek(1) == STR)
            return self.items()
        if self.at_function():
            return self.function()
        if self.is_name() and (self.peek(1) == "!" or self.peek(1) == "::"):
            self.path(False)
            self.need("!")
            if self.is_name():
                self.i += 1
            brace = self.at("{")
            if not self.at("(", "[", "{"):
                self.fail("macro arguments expected")
            self.balanced()
            if not brace:
                self.need(";")
            return None
        return self.fail("item expected")

    def at_function(self) -> bool:
        k = 0
        while self.peek(k) in ("const", "async", "unsafe", "extern", STR):
            k += 1
        return self.peek(k) == "fn"

    def items(self) -> None:
        self.need("{")
        while not self.at("}", EOF):
            self.guarded(self.item)
        self.need("}")

    def use_tree(self) -> None:
        self.take("::")
        while True:
            if self.take("*"):
                return
            if self.take("{"):
                return self.listed(self.use_tree, "}")
            if not self.n[self.i]:
                self.fail("name expected")
            self.i += 1
            if not self.take("::"):
                break
        if self.take("as"):
            if not self.take("_"):
                self.name()
        return None

    def generics(self) -> None:
        if not self.take("<"):
            return
        self.listed(self.generic, ">")

    def generic(self) -> None:
        self.attributes()
        if self.take("const"):
            self.name()
            self.need(":")
            self.type_()
            if self.take("="):
                self.unary()
            return
        self.name()
        if self.take(":"):
            self.bounds()
        if self.take("="):
            self.type_()

    def bounds(self) -> None:
        while True:
            if self.at(",", ">", "{", "=", ";", ")", "where", EOF):
                return
            self.take("?")
            paren = self.take("(")
            if self.take("for"):
                self.generics()
            self.type_()
            if paren:
                self.need(")")
            if not self.take("+"):
                return

    def where(self) -> None:
        if self.take("where"):
            while not self.at("{", ";", "=", EOF):
                if self.take("for"):
                    self.generics()
                self.type_()
                self.need(":")
                self.bounds()
                if not self.take(","):
                    break

    def function(self) -> None:
        while not self.take("fn"):
            self.i += 1
        self.name()
        self.generics()
        self.need("(")
        self.listed(self.parameter, ")")
        if self.take("->"):
            self.type_()
        self.where()
        if not self.take(";"):
            self.block()

    def parameter(self) -> None:
        self.attributes()
        start = self.i
        while self.at("&", "mut") or self.v[self.i].startswith("'"):
            self.i += 1
        if self.take("self"):
            if self.take(":"):
                self.type_()
            return
        self.i = start
        if self.take("..."):
            return
        self.pattern()
        self.need(":")
        self.type_()

    def tuple_field(self) -> None:
        self.attributes()
        self.visibility()
        self.type_()

    def field(self) -> None:
        self.attributes()
        self.visibility()
        self.name()
        self.need(":")
        self.type_()

    def variant(self) -> None:
        self.attributes()
        self.name()
        if self.take("("):
            self.listed(self.tuple_field, ")")
        elif self.take("{"):
            self.listed(self.field, "}")
        if self.take("="):
            self.climb()

    # types and patterns
    def type_(self) -> None:
        self.deeper()
        v = self.v[self.i]
        if v in ("&", "&&"):
            self.i += 1
            if self.v[self.i].startswith("'"):
                self.i += 1
            self.take("mut")
            self.type_()
        elif v == "*":
            self.i += 1
            if not self.take("const"):
                self.need("mut")
            self.type_()
        elif v == "(":
            self.i += 1
            self.listed(self.type_, ")")
        elif v == "[":
            self.i += 1
            self.type_()
            if self.take(";"):
                self.climb()
            self.need("]")
        elif v in ("!", "_"):
            self.i += 1
        elif v in ("dyn", "impl"):
            self.i += 1
            self.bounds()
        elif v in ("fn", "unsafe", "extern") or v == "for":
            if self.take("for"):
                self.generics()
            while self.at("unsafe", "extern", STR):
                self.i += 1
            if self.take("fn"):
                self.need("(")
                self.listed(self.fn_argument, ")")
                if self.take("->"):
                    self.type_()
            else:
                self.type_()
        elif v == "<":
            self.qualified()
        elif v.startswith("'"):
            self.i += 1
        else:
            self.path(False)
            if self.at("!") and self.peek(1) in ("(", "[", "{"):
                self.i += 1
                self.balanced()
        self.depth -= 1

    def fn_argument(self) -> None:
        if self.is_name() and self.peek(1) == ":" or self.at("_") and self.peek(1) == ":":
            self.i += 2
        if not self.take("..."):
            self.type_()

    def qualified(self) -> None:
        self.need("<")
        self.type_()
        if self.take("as"):
            self.type_()
        self.need(">")
        while self.take("::"):
            self.segment(True)

    def path(self, turbo: bool) -> None:
        self.take("::")
        self.segment(turbo)
        while self.at("::"):
            if self.peek(1) in ("{", "*"):
                return
            self.i += 1
            if self.at("<"):
                self.generic_arguments()
            else:
                self.segment(turbo)

    def segment(self, turbo: bool) -> None:
        v = self.v[self.i]
        if not (self.is_name() and not v.startswith("'") or v in ("self", "Self", "super", "crate", "$")):
            self.fail("path expected")
        self.i += 1
        if turbo:
            return
        if self.at("<"):
            self.generic_arguments()
        elif self.at("(") and v in ("Fn", "FnMut", "FnOnce"):
            self.i += 1
            self.listed(self.type_, ")")
            if self.take("->"):
                self.type_()

    def generic_arguments(self) -> None:
        self.need("<")
        self.listed(self.generic_argument, ">")

    def generic_argument(self) -> None:
        if self.at(NUM, STR, "{", "-", "true", "false"):
            return self.unary()
        if self.is_name() and self.peek(1) in ("=", ":"):
            self.i += 2
            if self.v[self.i - 1] == ":":
                return self.bounds()
        return self.type_()

    def pattern(self) -> None:
        self.take("|")
        self.pattern_one()
        while self.take("|"):
            self.pattern_one()

    def pattern_one(self) -> None:
        v = self.v[self.i]
        if v in ("&", "&&"):
            self.i += 1
            self.take("mut")
            return self.pattern_one()
        if v in ("ref", "mut"):
            self.i += 1
            self.take("mut")
            self.name()
            if self.take("@"):
                self.pattern_one()
            return None
        if v == "(":
            self.i += 1
            return self.listed(self.pattern, ")")
        if v == "[":
            self.i += 1
            return self.listed(self.pattern, "]")
        if v == "_":
            self.i += 1
            return None
        if v in ("..", "..="):
            self.i += 1
            if self.at(NUM, STR, "-"):
                self.unary()
            return None
        if v in (STR, NUM, "-", "true", "false"):
            self.take("-")
            self.i += 1
        else:
            if v == "<":
                self.qualified()
            else:
                self.path(True)
            if self.at("::") and self.peek(1) == "<":
                self.i += 1
                self.generic_arguments()
            if self.take("("):
                return self.listed(self.pattern, ")")
            if self.at("{"):
                self.i += 1
                return self.listed(self.pattern_field, "}")
            if self.at("!") and self.peek(1) in ("(", "[", "{"):
                self.i += 1
                return self.balanced()
            if self.take("@"):
                return self.pattern_one()
        if self.at("..", "..=", "..."):
            self.i += 1
            if self.at(NUM, STR, "-") or self.is_name():
                self.take("-")
                if not (self.take(NUM) or self.take(STR)):
                    self.path(True)
        return None

    def pattern_field(self) -> None:
        self.attributes()
        if self.take(".."):
            return
        while self.at("ref", "mut"):
            self.i += 1
        if not self.take(NUM):
            self.name()
        if self.take(":"):
            self.pattern()

    # statements
    def block(self) -> None:
        held, self.flag = self.flag, False
        self.need("{")
        while not self.at("}", EOF):
            self.guarded(self.statement)
        self.need("}")
        self.flag = held

    def statement(self) -> None:
        if self.take(";"):
            return
        self.attributes()
        if self.at("}"):
            return
        v = self.v[self.i]
        if v == "let":
            self.i += 1
            self.pattern()
            if self.take(":"):
                self.type_()
            if self.take("="):
                self.climb()
                if self.take("else"):
                    self.block()
            return self.need(";")
        if v in ITEMS and not (v in ("unsafe", "async") and self.peek(1) in ("{", "move")) and not (v in ("macro_rules", "union") and self.peek(1) != "!" and not self.is_name(1)) and not (v == "const" and self.peek(1) == "{"):
            return self.item()
        blockish = v in ("if", "match", "while", "loop", "for", "unsafe", "{") or v.startswith("'")
        if blockish:
            self.block_like()
            if self.at(".", "?"):
                self.postfix()
                self.rest()
            elif self.take(";") or True:
                return None
        else:
            macro = self.is_name() and self.peek(1) == "!" and self.peek(2) == "{"
            self.climb()
            if macro and self.v[self.i - 1] == "}":
                self.take(";")
                return None
        if not self.take(";") and not self.at("}"):
            self.fail("';' or '}' expected")
        return None

    def rest(self) -> None:
        """Operators after an operand that has been read."""
        while (bind := self.binary.get(self.v[self.i])) is not None:
            if self.joins(self.v[self.i]) is not None:
                self.i += 1
                self.climb(bind + 1)

    def without_struct(self, rule) -> None:
        held, self.flag = self.flag, True
        rule()
        self.flag = held

    def condition(self) -> None:
        self.climb()

    def block_like(self) -> None:
        if self.v[self.i].startswith("'") and self.peek(1) == ":":
            self.i += 2
        v = self.v[self.i]
        if v == "{":
            return self.block()
        self.i += 1
        if v in ("unsafe", "loop", "const", "async"):
            self.take("move")
            return self.block()
        if v == "if":
            self.without_struct(self.condition)
            self.block()
            while self.take("else"):
                if not self.take("if"):
                    return self.block()
                self.without_struct(self.condition)
                self.block()
            return None
        if v == "while":
            self.without_struct(self.condition)
            return self.block()
        if v == "for":
            self.pattern()
            self.need("in")
            self.without_struct(self.climb)
            return self.block()
        if v == "match":
            self.without_struct(self.climb)
            self.need("{")
            held, self.flag = self.flag, False
            while not self.at("}", EOF):
                self.guarded(self.arm, stops=(",",))
            self.need("}")
            self.flag = held
            return None
        return self.fail("expression expected")

    def arm(self) -> None:
        self.attributes()
        self.pattern()
        if self.take("if"):
            self.climb()
        self.need("=>")
        braced = self.at("{")
        self.climb()
        if not self.take(",") and not self.at("}") and not (braced and self.v[self.i - 1] == "}"):
            self.fail("',' or '}' expected")

    # expressions
    def joins(self, op: str) -> bool | None:
        if op == "as":
            self.i += 1
            self.type_()
            return None
        if op in ("..", "..="):
            self.i += 1
            if self.operand_ahead():
                self.climb(3)
            return None
        if op == ">" and self.peek(1) in (">", ">=") and self.t.at[self.i + 1] == self.t.at[self.i] + 1:
            self.i += 1
        elif op == ">" and self.peek(1) == "=" and self.t.at[self.i + 1] == self.t.at[self.i] + 1:
            self.i += 1
        return True

    def operand_ahead(self) -> bool:
        return not self.at(")", "]", "}", ",", ";", "=>", EOF) and not (self.at("{") and self.flag)

    def unary(self) -> None:
        v = self.v[self.i]
        if v in ("-", "!", "*"):
            self.i += 1
            return self.unary()
        if v in ("&", "&&"):
            self.i += 1
            if self.at("raw") and self.peek(1) in ("const", "mut"):
                self.i += 1
            self.take("mut")
            return self.unary()
        if v in ("..", "..="):
            self.i += 1
            if self.operand_ahead():
                self.climb(3)
            return None
        if v in ("|", "||") or v == "move" or v in ("async", "static") and self.peek(1) in ("move", "|", "||"):
            return self.closure()
        if v in ("return", "break"):
            self.i += 1
            if v == "break" and self.v[self.i].startswith("'"):
                self.i += 1
            if self.operand_ahead():
                self.climb()
            return None
        if v == "continue":
            self.i += 1
            if self.v[self.i].startswith("'"):
                self.i += 1
            return None
        if v == "let":
            self.i += 1
            self.pattern()
            self.need("=")
            return self.climb(4)
        self.primary()
        return self.postfix()

    def closure(self) -> None:
        while self.at("async", "static", "move"):
            self.i += 1
        if not self.take("||"):
            self.need("|")
            self.listed(self.closure_parameter, "|")
        if self.take("->"):
            self.type_()
            return self.block()
        return self.climb()

    def closure_parameter(self) -> None:
        self.pattern_one()
        if self.take(":"):
            self.type_()

    def primary(self) -> None:
        v = self.v[self.i]
        if v in (STR, NUM, "true", "false"):
            self.i += 1
        elif v == "(":
            self.i += 1
            held, self.flag = self.flag, False
            self.listed(self.climb, ")")
            self.flag = held
        elif v == "[":
            self.i += 1
            held, self.flag = self.flag, False
            if not self.take("]"):
                self.climb()
                if self.take(";"):
                    self.climb()
                    self.need("]")
                elif not self.take("]"):
                    self.need(",")
                    self.listed(self.climb, "]")
            self.flag = held
        elif v in ("if", "match", "while", "loop", "for", "unsafe", "{") or v == "async" or v == "const" and self.peek(1) == "{" or v.startswith("'"):
            self.block_like()
        elif v == "<":
            self.qualified()
        elif self.is_name() or v in ("self", "Self", "super", "crate", "::", "$"):
            self.path(True)
            if self.at("::") and self.peek(1) == "<":
                self.i += 1
                self.generic_arguments()
            if self.at("!") and self.peek(1) in ("(", "[", "{"):
                self.i += 1
                self.balanced()
            elif self.at("{") and not self.flag and self.structured():
                self.i += 1
                self.listed(self.struct_field, "}")
        else:
            self.fail("expression expected")

    def structured(self) -> bool:
        k = self.peek(1)
        return k in ("}", "..", "#") or (self.is_name(1) or k == NUM) and self.peek(2) in (":", ",", "}")

    def struct_field(self) -> None:
        self.attributes()
        if self.take(".."):
            if not self.at("}"):
                self.climb()
            return
        if not self.take(NUM):
            self.name()
        if self.take(":"):
            self.climb()

    def postfix(self) -> None:
        while True:
            v = self.v[self.i]
            if v == "?":
                self.i += 1
            elif v == ".":
                self.i += 1
                if self.take("await") or self.take(NUM):
                    continue
                self.name()
                if self.at("::"):
                    self.i += 1
                    self.generic_arguments()
            elif v == "(":
                self.i += 1
                held, self.flag = self.flag, False
                self.listed(self.climb, ")")
                self.flag = held
            elif v == "[":
                self.i += 1
                held, self.flag = self.flag, False
                self.climb()
                self.need("]")
                self.flag = held
            else:
                return
