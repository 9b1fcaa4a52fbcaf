"""Python 3."""

from __future__ import annotations

import re
from functools import lru_cache

from .core import BAD, EOF, NUM, STR, Fault, Lexed, Parser

NEWLINE, INDENT, DEDENT = "<newline>", "<indent>", "<dedent>"
#: Levels of indentation, and of brackets, that CPython takes.
MAX_INDENTS, MAX_BRACKETS = 99, 200
PATTERN = re.compile(
    r"(?P<skip>(?:[ \t\f]|\\\r?\n)+|\#[^\n\r]*)"
    r"|(?P<line>\r?\n|\r)"
    r"|(?P<quote>(?P<prefix>(?i:[rbuft]|rb|br|fr|rf|tr|rt)?)(?P<mark>\"\"\"|'''|\"|'))"
    r"|(?P<num>(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w))"
    r"|(?P<name>[A-Za-z_ª-\U0010ffff]\w*)"
    r"|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|:=|->|\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%@&|^]=|[-+*/%@&|^~<>=()\[\]{},:;.])"
)
ZEROS = re.compile(r"0[\d_]*[1-9][\d_]*$")
KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
AUGMENTED = frozenset(["+=", "-=", "*=", "/=", "//=", "%=", "@=", "&=", "|=", "^=", ">>=", "<<=", "**="])
CLOSES = {"(": ")", "[": "]", "{": "}"}
CLOSING = frozenset(CLOSES.values())
#: What a string without fields holds up to its end or a backslash, by its mark.
INNER = {mark: re.compile(f"(?:[^{mark[0]}\\\\{end}]+{tail})+") for mark, end, tail in (("'", r"\r\n", ""), ('"', r"\r\n", ""), ("\'\'\'", "", "|'(?!'')"), ('"""', "", '|"(?!"")'))}
#: Escapes that strings refuse, by kind.
BAD_ESCAPE = re.compile(r"x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})|N(?!\{[A-Za-z][^{}\n]*\})")
BAD_BYTE = re.compile(r"x(?![0-9a-fA-F]{2})")


#: The prefix of a formatted string, just before its mark; conversions; expressions that need no parser.
FORMATTED = re.compile(r"(?<![\w])(?i:[ft]r?|r[ft])\Z")
CONVERSION = re.compile(r"[sra]\s*[:}]")
SIMPLE = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*|\[[A-Za-z_\d]\w*\]|\([A-Za-z_]?\w*\))*")
#: What may follow an operand that is a whole expression.
STOPS = frozenset([",", ")", "]", "}", NEWLINE, ":", "=", ";"])


@lru_cache(4096)
def _is_expression(text: str) -> bool:
    """Whether ``text`` is an expression, or several, that can stand in brackets."""
    inner = PythonParser(f"({text}\n)")
    return not inner.run() and inner.v[1] != ")"


class PythonParser(Parser):
    """``flag``: within an expression that may not hold a bare comparison with in (the target of for)."""

    keywords = KEYWORDS
    binary = {"or": 3, "and": 4, "in": 6, "not": 6, "is": 6, "<": 6, ">": 6, "<=": 6, ">=": 6, "==": 6, "!=": 6, "|": 7, "^": 8, "&": 9, "<<": 10, ">>": 10, "+": 11, "-": 11, "*": 12, "/": 12, "//": 12, "%": 12, "@": 12, "**": 14}
    right = frozenset(["**"])

    def lexed(self, text: str) -> Lexed:
        out, i, n = Lexed(), 0, len(text)
        indents, opened, line_start = [(0, 0)], [], True
        match = PATTERN.match
        value, name, at, newline = out.value.append, out.name.append, out.at.append, out.newline.append
        while i < n:
            if line_start and not opened:
                j, width, plain = i, 0, 0  # with tabs to columns of eight, and with tabs as one
                while j < n and text[j] in " \t\f":
                    c = text[j]
                    width = width + 1 if c == " " else 0 if c == "\f" else (width // 8 + 1) * 8
                    plain = 0 if c == "\f" else plain + 1
                    j += 1
                if j < n and text[j] not in "\r\n#":
                    if width > indents[-1][0]:
                        if plain <= indents[-1][1]:
                            out.faults.append((j, "tabs and blanks are mixed in indentation"))
                        indents.append((width, plain))
                        if len(indents) == MAX_INDENTS + 2:  # a limit of the language
                            out.faults.append((j, "too many levels of indentation"))
                        out.add(INDENT, False, j)
                    else:
                        while width < indents[-1][0]:
                            indents.pop()
                            out.add(DEDENT, False, j)
                        if width != indents[-1][0]:
                            out.faults.append((j, "unindent matches no outer indentation"))
                            indents.append((width, plain))
                        elif plain != indents[-1][1]:
                            out.faults.append((j, "tabs and blanks are mixed in indentation"))
                i, line_start = j, False
                if i >= n:
                    break
            if text[i] == " ":  # the most frequent skip of all
                i += 1
                if i == n:
                    break
            m = match(text, i)
            if m is None:
                out.faults.append((i, f"stray character {text[i]!r}"))
                out.add(BAD, False, i)
                i += 1
                continue
            kind, j = m.lastgroup, m.end()
            if kind == "name":
                value(m[0])
                name(True)
            elif kind == "op":
                v = m[0]
                if v in CLOSES:
                    opened.append((CLOSES[v], i))
                    if len(opened) == MAX_BRACKETS + 1:
                        out.faults.append((i, "too many nested brackets"))
                elif v in CLOSING:
                    if not opened or opened.pop()[0] != v:
                        out.faults.append((i, f"{v!r} closes nothing"))
                        opened = []
                value(v)
                name(False)
            elif kind == "skip":
                i = j
                continue
            elif kind == "line":
                if not opened:
                    if out.value and out.value[-1] not in (NEWLINE, INDENT, DEDENT):
                        out.add(NEWLINE, False, i)
                    line_start = True
                i = j
                continue
            elif kind == "quote":
                prefix = m["prefix"].lower()
                j = self.string(text, j, m["mark"], "f" in prefix or "t" in prefix, "r" in prefix, out.faults, i, "b" in prefix)
                value(STR)
                name(False)
            else:
                if ZEROS.match(m[0]):
                    out.faults.append((i, "leading zeros in a decimal number"))
                value(NUM)
                name(False)
            at(i)
            newline(False)
            i = j
        if opened:
            out.faults.append((opened[-1][1], "bracket never closed"))
        if out.value and out.value[-1] not in (NEWLINE, INDENT, DEDENT):
            out.add(NEWLINE, False, n)
        for _ in indents[1:]:
            out.add(DEDENT, False, n)
        out.add(EOF, False, n)
        return out

    def string(self, text: str, i: int, mark: str, formatted: bool, raw: bool, faults: list, start: int, of_bytes: bool = False) -> int:
        n, inner, bad = len(text), INNER[mark], None if raw else BAD_BYTE if of_bytes else BAD_ESCAPE
        while i < n:
            c = text[i]
            if c == "\\":
                if bad is not None and bad.match(text, i + 1):
                    faults.append((i, "broken escape in a string"))
                if formatted and not raw and text.startswith("N{", i + 1):
                    i = (text.find("}", i) + 1) or n
                    continue
                i += 3 if text.startswith("\r\n", i + 1) else 1 if formatted and text[i + 1 : i + 2] in ("{", "}") else 2
            elif text.startswith(mark, i):
                return i + len(mark)
            elif c in "\r\n" and len(mark) == 1:
                break
            elif not formatted:
                m = inner.match(text, i)
                i = m.end() if m else i + 1
            elif c == "{":
                if text.startswith("{{", i):
                    i += 2
                    continue
                i = self.field(text, i + 1, mark, faults)
            else:
                i += 1
        faults.append((start, "unterminated string"))
        return min(i, n)

    def field(self, text: str, i: int, mark: str, faults: list) -> int:
        """A replacement field of a formatted string: an expression, perhaps a conversion and a format; where it ends."""
        n, level, start = len(text), 0, i
        while i < n:
            c = text[i]
            if c in "([{":
                level += 1
            elif level and c in ")]}":
                level -= 1
            elif c in "\"'":
                if level == 0 and len(mark) == 1 and c == mark and not text[start:i].strip() and "}" not in text[i : text.find("\n", i) if "\n" in text[i:] else n]:
                    break
                k = 3 if text[i : i + 3] in ('"""', "\'\'\'") else 1
                prefix = FORMATTED.search(text, max(start, i - 2), i)
                i = self.string(text, i + k, text[i : i + k], prefix is not None, prefix is not None and "r" in prefix[0].lower(), faults, i)
                continue
            elif c == "\n" and len(mark) == 1:
                break
            elif level == 0 and (c in ":}" or c == "!" and not text.startswith("=", i + 1)):
                self.value(text[start:i], start, faults)
                if c == "!":
                    i += 1
                    if not CONVERSION.match(text, i):
                        faults.append((i, "unknown conversion in a formatted string"))
                    while i < n and text[i] not in ":}" and not text.startswith(mark, i) and text[i] != "\n":
                        i += 1
                if text.startswith(":", i):  # a format, with fields of its own
                    i += 1
                    while i < n and text[i] != "}":
                        if text.startswith(mark, i) or text[i] == "\n" and len(mark) == 1:
                            break
                        i = self.field(text, i + 1, mark, faults) if text[i] == "{" else i + 1
                if text.startswith("}", i):
                    return i + 1
                break
            i += 1
        faults.append((start, "unterminated field in a formatted string"))
        return i

    def value(self, text: str, start: int, faults: list) -> None:
        """The expression of a field, perhaps with = for its own text."""
        bare = text.strip()
        if bare.endswith("=") and bare[-2:-1] not in ("=", "!", "<", ">"):
            bare = bare[:-1].rstrip()
        if not bare:
            faults.append((start, "empty field in a formatted string"))
        elif not (SIMPLE.fullmatch(bare) and bare.partition(".")[0] not in KEYWORDS) and not _is_expression(bare):
            faults.append((start, "broken expression in a formatted string"))

    def top(self) -> None:
        while not self.at(EOF):
            self.line_of(self.statement)

    def line_of(self, rule) -> None:
        """``rule``, or in panic mode what is left of its line, and the block that hangs on it."""
        start = self.i
        self.deeper()
        try:
            rule()
        except Fault as e:
            self.note(e)
            while not self.at(NEWLINE, EOF):
                if self.at(INDENT):
                    break
                self.i += 1
            self.take(NEWLINE)
            if self.take(INDENT):
                while not self.at(DEDENT, EOF):
                    self.line_of(self.statement)
                self.take(DEDENT)
        self.depth -= 1
        if self.i == start and not self.at(EOF):
            self.i += 1

    def statement(self) -> None:
        v = self.v[self.i]
        if v == NEWLINE:
            self.i += 1
            return
        if v == INDENT:
            self.fail("unexpected indent")
        rule = getattr(self, "s_" + v, None) if self.n[self.i] and v in KEYWORDS else None
        if rule is not None:
            rule()
        elif v == "@":
            while self.take("@"):
                self.named()
                self.need(NEWLINE)
            if not self.at("def", "class", "async"):
                self.fail("'def' or 'class' expected")
            self.statement()
        elif v == "match" and self.attempt(self.s_match):
            pass
        else:
            self.simple_line()

    def simple_line(self) -> None:
        self.simple()
        while self.take(";"):
            if self.at(NEWLINE, EOF):
                break
            self.simple()
        if not self.take(NEWLINE) and not self.at(EOF):
            self.fail("end of line expected")

    def block(self) -> None:
        self.need(":")
        if not self.take(NEWLINE):
            return self.simple_line()
        if not self.take(INDENT):
            self.fail("an indented block expected")
        while not self.at(DEDENT, EOF):
            self.line_of(self.statement)
        self.take(DEDENT)
        return None

    # compound statements
    def s_if(self) -> None:
        self.i += 1
        self.named()
        self.block()
        while self.take("elif"):
            self.named()
            self.block()
        if self.take("else"):
            self.block()

    def s_while(self) -> None:
        self.i += 1
        self.named()
        self.block()
        if self.take("else"):
            self.block()

    def s_for(self) -> None:
        self.i += 1
        self.targets()
        self.need("in")
        self.stars()
        self.block()
        if self.take("else"):
            self.block()

    def targets(self) -> None:
        held, self.flag = self.flag, True
        while True:
            self.take("*")
            start = self.i
            self.climb(7)
            self.assignable(start, self.i)
            if not self.take(",") or self.at("in"):
                break
        self.flag = held

    def s_try(self) -> None:
        self.i += 1
        self.block()
        some = False
        while self.take("except"):
            some = True
            self.take("*")
            if not self.at(":"):
                self.expression()
                while self.take(","):
                    self.expression()
                if self.take("as"):
                    self.name()
            self.block()
        if some and self.take("else"):
            self.block()
        if self.take("finally"):
            self.block()
        elif not some:
            self.fail("'except' or 'finally' expected")

    def s_with(self) -> None:
        self.i += 1
        if not (self.at("(") and self.attempt(self.grouped_items)):
            self.with_item()
            while self.take(","):
                self.with_item()
        self.block()

    def grouped_items(self) -> None:
        self.need("(")
        self.listed(self.with_item, ")", empty=False)
        if not self.at(":"):
            self.fail("':' expected")

    def with_item(self) -> None:
        self.expression()
        if self.take("as"):
            start = self.i
            self.take("*")
            self.climb(7)
            self.assignable(start, self.i)

    def s_async(self) -> None:
        self.i += 1
        if not self.at("def", "with", "for"):
            self.fail("'def', 'with' or 'for' expected")
        self.statement()

    def s_def(self) -> None:
        self.i += 1
        self.name()
        self.type_parameters()
        self.need("(")
        self.parameters(")")
        if self.take("->"):
            self.expression()
        self.block()

    def type_parameters(self) -> None:
        if self.at("["):
            self.balanced()

    def parameters(self, close: str) -> None:
        """Parameters up to ``close``, which is read; only those of a function, which end with a bracket, are annotated."""
        default = star = bare = slash = last = False
        first = self.i
        while not self.take(close):
            if last:
                self.fail("parameters end with **")
            if self.take("/"):
                if slash or star or self.i == first + 1:
                    self.fail("'/' can't stand here")
                slash = True
            elif self.take("*"):
                if star:
                    self.fail("a second '*'")
                star = True
                bare = self.at(",", close)
                if not bare:
                    self.name()
                    if close == ")" and self.take(":"):
                        self.take("*")
                        self.expression()
            else:
                last = self.take("**")
                if last and bare:
                    self.fail("a name must follow '*'")
                bare = False
                self.name()
                if close == ")" and self.take(":"):
                    self.expression()
                if not last and self.take("="):
                    self.expression()
                    default = True
                elif not last and default and not star:
                    self.fail("a parameter without a default follows one that has one")
            if not self.take(","):
                self.need(close)
                break
        if bare:
            self.i -= 1
            self.fail("a name must follow '*'")

    def s_class(self) -> None:
        self.i += 1
        self.name()
        self.type_parameters()
        if self.take("("):
            self.arguments()
        self.block()

    def s_match(self) -> None:
        self.need("match")
        if self.at("=", ".", ",", ":", NEWLINE, ")") or self.v[self.i] in AUGMENTED:
            self.fail("subject expected")
        self.stars(named=True)
        self.need(":")
        self.need(NEWLINE)
        self.need(INDENT)
        if not self.at("case"):
            self.fail("'case' expected")
        while not self.at(DEDENT, EOF):
            self.case()
        self.take(DEDENT)

    def case(self) -> None:
        self.need("case")
        self.pattern()
        if self.take(","):
            while not self.at("if", ":"):
                self.pattern()
                if not self.take(","):
                    break
        if self.take("if"):
            self.named()
        self.block()

    def pattern(self) -> None:
        if self.take("*"):
            self.name()
            return
        self.pattern_one()
        while self.take("|"):
            self.pattern_one()
        if self.take("as"):
            self.name()

    def pattern_one(self) -> None:
        v = self.v[self.i]
        if v in ("(", "["):
            self.i += 1
            self.listed(self.pattern, CLOSES[v])
        elif v == "{":
            self.i += 1
            self.listed(self.pattern_entry, "}")
        elif v in (STR, NUM, "-"):
            self.climb(7)
        elif v in ("None", "True", "False"):
            self.i += 1
        else:
            self.name()
            while self.take("."):
                self.name()
            if self.take("("):
                self.listed(self.pattern_argument, ")")

    def pattern_entry(self) -> None:
        if self.take("**"):
            self.name()
            return
        self.climb(7)
        self.need(":")
        self.pattern()

    def pattern_argument(self) -> None:
        if self.is_name() and self.peek(1) == "=":
            self.i += 2
        self.pattern()

    # simple statements
    def simple(self) -> None:
        v = self.v[self.i]
        rule = getattr(self, "p_" + v, None) if self.n[self.i] and v in KEYWORDS else None
        if rule is not None:
            self.i += 1
            return rule()
        if v == "type" and self.is_name(1):
            self.i += 2
            self.type_parameters()
            self.need("=")
            return self.expression()
        start = self.i
        self.stars(True)
        if self.take(":"):
            self.assignable(start, self.i - 1, False)
            self.expression()
            if self.take("="):
                self.stars(True)
            return None
        if self.v[self.i] in AUGMENTED:
            self.assignable(start, self.i, False)
            self.i += 1
            return self.stars(True)
        while self.at("="):
            self.assignable(start, self.i)
            self.i += 1
            start = self.i
            self.stars(True)
        return None

    def assignable(self, start: int, end: int, several: bool = True) -> None:
        """Fails unless the tokens from ``start`` to before ``end``, an expression, can be assigned to: a name, an attribute, an item, or ``several`` of them."""
        v, n = self.v, self.n
        if end == start + 1 and n[start] and v[start] not in KEYWORDS:
            return
        level, parts, last, simple = 0, [start], start, True
        for i in range(start, end):
            w = v[i]
            if w in (")", "]", "}"):
                level -= 1
            elif level == 0 and w == ",":
                parts.append(i + 1)
            elif level == 0 and not (n[i] and (w not in KEYWORDS or i == start) or w in (".", "(", "[", "{", STR, NUM) or w == "*" and i in parts):
                simple = False
            if w in ("(", "[", "{"):
                if level == 0:
                    last = i
                level += 1
        if len(parts) > 1 or v[start] == "*":
            if several:
                for a, b in zip(parts, [*(p - 1 for p in parts[1:]), end]):
                    if a < b:
                        self.assignable(a + (v[a] == "*"), b)
                return
        elif last == start and v[start] in ("(", "[") and v[end - 1] == (")" if v[start] == "(" else "]"):  # brackets around it all
            if end == start + 2 and several:
                return
            if not any(w in ("for", "yield", ":=") for w in v[start:end]):
                return self.assignable(start + 1, end - 1, several)
        elif simple and end > start + 1 and (n[end - 1] and v[end - 2] == "." or v[end - 1] == "]" and v[last] == "[" and last > start):
            return
        self.i = start
        self.fail("cannot assign to this")

    def p_pass(self) -> None:
        pass

    p_break = p_continue = p_pass

    def p_return(self) -> None:
        if not self.at(NEWLINE, ";", EOF):
            self.stars()

    def p_raise(self) -> None:
        if not self.at(NEWLINE, ";", EOF):
            self.expression()
            if self.take("from"):
                self.expression()

    def p_del(self) -> None:
        start = self.i
        self.stars()
        end = self.i
        self.assignable(start, end)
        if "*" in (self.v[start], self.v[start + 1]):
            self.fail("cannot delete this")
        self.i = end

    def p_assert(self) -> None:
        self.expression()
        if self.take(","):
            self.expression()

    def p_global(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    p_nonlocal = p_global

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def p_import(self) -> None:
        while True:
            self.dotted()
            if self.take("as"):
                self.name()
            if not self.take(","):
                return

    def p_from(self) -> None:
        dots = False
        while self.at(".", "..."):
            self.i += 1
            dots = True
        if not (dots and self.at("import")):
            self.dotted()
        self.need("import")
        if self.take("*"):
            return
        if self.take("("):
            return self.listed(self.imported, ")", empty=False)
        self.imported()
        while self.take(","):
            self.imported()

    def imported(self) -> None:
        self.name()
        if self.take("as"):
            self.name()

    # expressions
    def stars(self, yields: bool = False, named: bool = False) -> None:
        """Expressions separated by commas, some starred, or ``named``."""
        if yields and self.at("yield"):
            return self.yielded()
        while True:
            if self.take("*"):
                self.climb(7)
            elif named:
                self.named()
            else:
                self.expression()
            if not self.take(","):
                return None
            if self.at(NEWLINE, "=", ")", "]", "}", ":", ";", EOF, "in") or self.v[self.i] in AUGMENTED:
                return None

    def yielded(self) -> None:
        self.need("yield")
        if self.take("from"):
            return self.expression()
        if not self.at(NEWLINE, ")", ";", "=", EOF):
            self.stars()
        return None

    def named(self) -> None:
        if self.is_name() and self.peek(1) == ":=":
            self.i += 2
        self.expression()

    def expression(self) -> None:
        i = self.i
        if self.v[i + 1] in STOPS and (self.v[i] == NUM or self.n[i] and self.v[i] not in KEYWORDS):  # a lone operand
            self.i = i + 1
            return None
        if self.v[i] == "lambda":
            self.i += 1
            self.parameters(":")
            return self.expression()
        self.climb(3)
        if self.take("if"):
            self.climb(3)
            self.need("else")
            self.expression()
        return None

    def joins(self, op: str) -> bool | None:
        if op == "not":
            if self.peek(1) != "in":
                return False
            self.i += 1
        elif op == "in" and self.flag:
            return False
        elif op == "is" and self.peek(1) == "not":
            self.i += 1
        return True

    def unary(self) -> None:
        v = self.v[self.i]
        if v == "not":
            self.i += 1
            return self.climb(6)
        if v in ("-", "+", "~"):
            self.i += 1
            self.unary()
            if self.take("**"):
                self.unary()
            return None
        if v == "await":
            self.i += 1
        self.atom()
        return self.trailers()

    def atom(self) -> None:
        v = self.v[self.i]
        if v == STR:
            while self.take(STR):
                pass
        elif v in (NUM, "...", "None", "True", "False") or self.is_name():
            self.i += 1
        elif v == "(":
            held, self.flag = self.flag, False
            self.i += 1
            if self.at("yield"):
                self.yielded()
                self.need(")")
            else:
                self.sequence(")")
            self.flag = held
        elif v == "[":
            held, self.flag = self.flag, False
            self.i += 1
            self.sequence("]")
            self.flag = held
        elif v == "{":
            held, self.flag = self.flag, False
            self.i += 1
            self.entries()
            self.flag = held
        else:
            self.fail("expression expected")

    def item(self) -> None:
        if self.take("*"):
            self.climb(7)
        else:
            self.named()

    def sequence(self, close: str) -> None:
        if self.take(close):
            return
        self.item()
        if self.at("for", "async"):
            self.comprehension()
            return self.need(close)
        if self.take(close):
            return None
        self.need(",")
        return self.listed(self.item, close)

    def comprehension(self) -> None:
        while self.at("for", "async"):
            self.take("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.climb(3)
            while self.take("if"):
                if self.is_name() and self.peek(1) == ":=":
                    self.i += 2
                self.climb(3)

    def entry(self) -> None:
        if self.take("**"):
            return self.climb(7)
        if self.take("*"):
            return self.climb(7)
        self.named()
        if self.take(":"):
            self.expression()
        return None

    def entries(self) -> None:
        if self.take("}"):
            return
        self.entry()
        if self.at("for", "async"):
            self.comprehension()
            return self.need("}")
        if self.take("}"):
            return None
        self.need(",")
        return self.listed(self.entry, "}")

    def trailers(self) -> None:
        while True:
            v = self.v[self.i]
            if v == ".":
                self.i += 1
                self.name()
            elif v == "(":
                held, self.flag = self.flag, False
                self.i += 1
                self.arguments()
                self.flag = held
            elif v == "[":
                held, self.flag = self.flag, False
                self.i += 1
                self.listed(self.subscript, "]", empty=False)
                self.flag = held
            else:
                return

    def arguments(self) -> None:
        """What stands between the brackets of a call; the closing one is read."""
        keyword = unpacked = False
        first = self.i
        while not self.take(")"):
            start = self.i
            if self.take("**"):
                unpacked = keyword = True
                self.expression()
            elif self.take("*"):
                if unpacked:
                    self.fail("'*' after '**'")
                self.expression()
            elif self.v[start + 1] == "=" and self.is_name():
                self.i += 2
                keyword = True
                self.expression()
            else:
                self.named()
                if self.at("for", "async"):
                    self.comprehension()
                    if start != first or not self.at(")"):
                        self.fail("brackets needed around a generator")
                elif keyword:
                    self.i = start
                    self.fail("an argument without a name follows one with a name")
            if not self.take(","):
                return self.need(")")
        return None

    def subscript(self) -> None:
        if self.take("*"):
            return self.expression()
        if not self.at(":"):
            self.named()
        for _ in range(2):
            if self.take(":") and not self.at(":", ",", "]"):
                self.expression()
        return None
