"""CSS. Blocks left open are faults, as are unclosed strings and comments, and what is no rule or declaration."""

from __future__ import annotations

import re

from .core import EOF, NUM, STR, Lexed, Parser, lex

PATTERN = re.compile(
    r"(?P<skip>(?:\s|/\*[\s\S]*?\*/|<!--|-->)+)"
    r'|(?P<str>"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\'|(?i:url)\(\s*(?:[^\s"\'()\\]|\\.)*\s*\))'
    r"|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?:%|[A-Za-z]+)?|\#[\w-]+)"
    r"|(?P<name>[@]?-{0,2}(?:[A-Za-z_\u0080-\U0010ffff]|\\[^\n])(?:[\w\u0080-\U0010ffff-]|\\[^\n])*|--)"
    r"|(?P<op>::|[~|^$*]=|[{}()\[\];:,.>+~*/=!&%|-])"
    r"|(?P<comment>/\*)|(?P<text_literal>[\"'])"
)
#: At-rules whose block holds rules; those without are followed by declarations.
RULES_WITHIN = frozenset("@media @supports @document @layer @container @scope @keyframes @-webkit-keyframes @-moz-keyframes @starting-style @font-feature-values".split())


class CssParser(Parser):
    def lexed(self, text: str) -> Lexed:
        return lex(text, PATTERN)

    def top(self) -> None:
        while not self.at(EOF):
            self.guarded(self.rule, close="")

    def rule(self) -> None:
        v = self.v[self.i]
        if v.startswith("@"):
            return self.at_rule(v)
        if v in ("}", ";"):
            self.fail("rule expected")
        self.selectors()
        return self.body()

    def at_rule(self, v: str) -> None:
        self.i += 1
        while not self.at("{", ";", "}", EOF):
            if self.at("(", "["):
                self.balanced()
            else:
                self.i += 1
        if self.take(";"):
            return
        if not self.at("{"):
            self.fail("';' or '{' expected")
        if v.lower() in RULES_WITHIN:
            self.need("{")
            while not self.at("}", EOF):
                self.guarded(self.rule)
            self.need("}")
        else:
            self.body()

    def selectors(self) -> None:
        self.selector()
        while self.take(","):
            self.selector()

    def selector(self) -> None:
        some = False
        while True:
            v = self.v[self.i]
            if self.n[self.i] and not v.startswith("@") or v in ("*", NUM, "&"):
                self.i += 1
            elif v == ".":
                self.i += 1
                if not self.n[self.i]:
                    self.fail("class expected")
                self.i += 1
            elif v in (":", "::"):
                self.i += 1
                if not self.n[self.i]:
                    self.fail("pseudo class expected")
                self.i += 1
                if self.at("("):
                    self.balanced()
            elif v == "[":
                self.balanced()
            elif v in (">", "+", "~", "|"):
                self.i += 1
                if self.at("{", ",", ">", "+", "~", EOF):
                    self.fail("selector expected")
                continue
            else:
                break
            some = True
        if not some:
            self.fail("selector expected")

    def body(self) -> None:
        self.need("{")
        while not self.at("}", EOF):
            if self.take(";"):
                continue
            self.guarded(self.declaration_or_rule)
        self.need("}")

    def declaration_or_rule(self) -> None:
        v = self.v[self.i]
        if v.startswith("@"):
            return self.at_rule(v)
        if not self.attempt(self.declaration):
            start = self.i
            self.selectors()
            if not self.at("{"):
                self.i = start
                self.declaration()
            self.body()
        return None

    def declaration(self) -> None:
        self.take("*")
        if not self.n[self.i]:
            self.fail("property expected")
        custom = self.v[self.i].startswith("--")
        self.i += 1
        self.need(":")
        start = self.i
        while not self.at(";", "}", EOF):
            v = self.v[self.i]
            if v in ("(", "["):
                self.balanced()
            elif v == "{" and custom:
                self.balanced()
            elif v in (STR, NUM, ",", "/", "+", "-", "*", "!", ".", "%", "=", ":") or self.n[self.i] and not v.startswith("@"):
                self.i += 1
            else:
                self.fail("value expected")
        if self.i == start and not custom:
            self.fail("value expected")
        if not self.take(";") and not self.at("}"):
            self.fail("';' or '}' expected")
