"""What the parsers share: tokens, recursive descent with panic-mode recovery, precedence climbing."""

from __future__ import annotations

import re
from collections.abc import Callable

STR, NUM, EOF, BAD = "<str>", "<num>", "<eof>", "<bad>"
#: Depth of nesting beyond which a file is left undecided instead of exhausting memory.
MAX_DEPTH = 5_000
#: Tokens that may be read in vain, for each token of a file, before it is left undecided.
MAX_REREAD = 1_000


class Fault(Exception):
    """A syntax error at a token."""


class Undecided(Exception):
    """A limit of the parser was met, which says nothing about the file."""


class Lexed:
    """Parallel lists: value (operators and names as they are, literals by kind), whether it is a name, offset."""

    __slots__ = ("value", "name", "at", "faults", "newline")

    def __init__(self) -> None:
        self.value: list[str] = []
        self.name: list[bool] = []
        self.at: list[int] = []
        self.newline: list[bool] = []  # a line break comes before the token
        self.faults: list[tuple[int, str]] = []

    def add(self, value: str, name: bool, at: int, newline: bool = False) -> None:
        self.value.append(value)
        self.name.append(name)
        self.at.append(at)
        self.newline.append(newline)


def lex(text: str, pattern: re.Pattern, special: dict[str, Callable] | None = None) -> Lexed:
    """Tokens of ``text``: ``pattern`` has the groups skip, name, num, str, op and, for faults, open; others are in ``special``."""
    out, i, n, fresh = Lexed(), 0, len(text), False
    match, special = pattern.match, special or {}
    value, name, at, newline = out.value.append, out.name.append, out.at.append, out.newline.append
    while i < n:
        if text[i] == " ":  # the most frequent skip of all
            i += 1
            if i == n:
                break
        m = match(text, i)
        if m is None:
            out.faults.append((i, f"stray character {text[i]!r}"))
            out.add(BAD, False, i, fresh)
            i += 1
            continue
        kind = m.lastgroup
        if kind == "name":
            value(m[0])
            name(True)
        elif kind == "op":
            value(m[0])
            name(False)
        elif kind == "skip":
            fresh = fresh or "\n" in m[0]
            i = m.end()
            continue
        elif kind in special:
            i, fresh = special[kind](text, i, m.end(), out, fresh), False
            continue
        else:
            if kind != "num" and kind != "str":  # a literal or comment that is never closed
                out.faults.append((i, "unterminated " + kind.replace("_", " ")))
            value(NUM if kind == "num" else STR if kind == "str" else BAD)
            name(False)
        at(i)
        newline(fresh)
        i, fresh = m.end(), False
    out.add(EOF, False, n, True)
    return out


class Parser:
    """Recursive descent over tokens. A fault within a statement is noted, and parsing goes on after it."""

    keywords: frozenset[str] = frozenset()
    #: Binary operators and their binding powers, and those that group to the right.
    binary: dict[str, int] = {}
    right: frozenset[str] = frozenset()
    #: Set in places where some expressions can't stand; what it means depends on the language.
    flag = False

    def __init__(self, text: str):
        self.text = text
        self.t = self.lexed(text)
        for _ in range(3):  # a rule may step over the end once or twice before it looks
            self.t.add(EOF, False, len(text), True)
        self.v, self.n, self.i, self.depth, self.wasted = self.t.value, self.t.name, 0, 0, 0
        self.failed: set[tuple] = set()
        self.faults: list[tuple[int, str]] = list(self.t.faults)

    def lexed(self, text: str) -> Lexed:
        raise NotImplementedError

    def top(self) -> None:
        raise NotImplementedError

    def run(self) -> list[tuple[int, str]]:
        """All faults as (offset, message), in the order of offsets. Undecided, with the faults so far, if a limit is met."""
        try:
            self.top()
        except Fault as e:
            self.note(e)
        except Undecided as e:
            raise Undecided(e.args[0], sorted(set(self.faults))) from None
        except IndexError:
            self.faults.append((len(self.text), "unexpected end of file"))
        return sorted(set(self.faults))

    # tokens
    def peek(self, k: int = 0) -> str:
        i = self.i + k
        return self.v[i] if i < len(self.v) else EOF

    def at(self, *values: str) -> bool:
        return self.v[self.i] in values

    def take(self, value: str) -> bool:
        if self.v[self.i] == value:
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if self.v[self.i] != value:
            self.fail(f"{value!r} expected")
        self.i += 1

    def fail(self, message: str) -> None:
        raise Fault(self.t.at[self.i], f"{message}, found {self.v[self.i]!r}")

    def is_name(self, k: int = 0) -> bool:
        i = self.i + k
        return i < len(self.v) and self.n[i] and self.v[i] not in self.keywords

    def name(self) -> str:
        if not self.is_name():
            self.fail("name expected")
        self.i += 1
        return self.v[self.i - 1]

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise Undecided("nesting too deep")

    def note(self, e: Fault) -> None:
        self.faults.append((e.args[0], e.args[1]))

    def attempt(self, rule: Callable[[], object]) -> bool:
        """Whether ``rule`` applies here; if not, nothing has been read. What failed once isn't tried again at the same place."""
        start, faults, depth, flag = self.i, len(self.faults), self.depth, self.flag
        key = (getattr(rule, "__func__", rule).__code__, start, flag)
        if key in self.failed:
            return False
        try:
            rule()
            if len(self.faults) == faults:
                return True
        except Fault:
            pass
        except Undecided:
            del self.faults[faults:]
            raise
        self.wasted += self.i - start
        if self.wasted > MAX_REREAD * len(self.v):
            del self.faults[faults:]
            raise Undecided("too deeply ambiguous")
        self.failed.add(key)
        self.i, self.depth, self.flag = start, depth, flag
        del self.faults[faults:]
        return False

    def guarded(self, rule: Callable[[], None], stops: tuple[str, ...] = (";",), close: str = "}") -> None:
        """``rule``, or after a fault within it panic mode: skip behind the next stop or up to the closing bracket."""
        start, depth, flag = self.i, self.depth, self.flag
        try:
            self.deeper()
            rule()
        except Fault as e:
            self.note(e)
            level = 0
            while not self.at(EOF):
                v = self.v[self.i]
                if level == 0 and v == close and close:
                    break
                self.i += 1
                if v in ("(", "[", "{"):
                    level += 1
                elif v in (")", "]", "}"):
                    level = max(0, level - 1)
                    if level == 0 and v == "}":
                        break
                elif level == 0 and v in stops:
                    break
            self.flag = flag
        finally:
            self.depth = depth
        if self.i == start and not self.at(EOF):
            self.i += 1

    def listed(self, item: Callable[[], object], close: str, separator: str = ",", empty: bool = True, trailing: bool = True) -> None:
        """Items up to ``close``, which is read."""
        if self.take(close):
            if not empty:
                self.i -= 1
                self.fail("an item expected")
            return
        while True:
            item()
            if self.take(close):
                return
            self.need(separator)
            if trailing and self.take(close):
                return

    # expressions
    def unary(self) -> None:
        raise NotImplementedError

    def climb(self, power: int = 0) -> None:
        """Precedence climbing: operands joined by operators that bind at least as strongly as ``power``."""
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise Undecided("nesting too deep")
        self.unary()
        powers, values = self.binary, self.v
        while True:
            op = values[self.i]
            if op not in powers:
                break
            bind = powers[op]
            if bind < power:
                break
            joined = self.joins(op)
            if joined is None:
                continue
            if not joined:
                break
            self.i += 1
            self.climb(bind if op in self.right else bind + 1)
        self.depth -= 1

    def joins(self, op: str) -> bool | None:
        """Whether ``op`` joins operands here; None if it and what follows it have been read."""
        return True

    def balanced(self) -> None:
        """A bracketed run of any tokens."""
        pairs = {"(": ")", "[": "]", "{": "}"}
        if self.v[self.i] not in pairs:
            self.fail("opening bracket expected")
        want = [pairs[self.v[self.i]]]
        start = self.i
        self.i += 1
        while want:
            v = self.v[self.i]
            if v == EOF:
                self.i = start
                self.fail("bracket never closed")
            if v in pairs:
                want.append(pairs[v])
            elif v in (")", "]", "}"):
                if v != want.pop():
                    self.fail("closing bracket doesn't match")
            self.i += 1
