"""Shell scripts of the Bourne family."""

from __future__ import annotations

import re

from .core import EOF, Lexed, Parser

WORD = "<word>"
RESERVED = frozenset("if then elif else fi for in while until do done case esac function select { } ! [[ time".split())
OPERATOR = re.compile(r"&>>|<<<|<<-|;;&|&&|\|\||;;|;&|<<|>>|<&|>&|<>|>\||&>|\|&|[;&|<>()]")
SPACE = re.compile(r"(?:[ \t\r]|\\\r?\n)+")
REDIRECTS = frozenset(["<", ">", ">>", "<<", "<<-", "<<<", "<&", ">&", "<>", ">|", "&>", "&>>"])
ASSIGNMENT = re.compile(r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=")


class Broken(Exception):
    pass


class Scan:
    """Words with their quotes and expansions; commands within expansions are parsed as well."""

    def __init__(self, text: str, faults: list[tuple[int, str]], base: int = 0):
        self.text, self.faults, self.base = text, faults, base

    def word(self, i: int, stops: str = " \t\r\n;&|<>()") -> int:
        text, n = self.text, len(self.text)
        while i < n:
            c = text[i]
            if c == "\\":
                i += 2
            elif c == "'":
                j = text.find("'", i + 1)
                if j < 0:
                    raise Broken(i, "unterminated quote")
                i = j + 1
            elif c == '"':
                i = self.double(i + 1, i)
            elif c == "`":
                j = i + 1
                while j < n and text[j] != "`":
                    j += 2 if text[j] == "\\" else 1
                if j >= n:
                    raise Broken(i, "unterminated command substitution")
                i = j + 1
            elif c == "$":
                i = self.dollar(i)
            elif c in "<>" and text.startswith("(", i + 1) and c in stops:
                i = self.command(i + 2, i)
            elif c in stops:
                return i
            else:
                i += 1
        return min(i, n)

    def double(self, i: int, start: int) -> int:
        text, n = self.text, len(self.text)
        while i < n:
            c = text[i]
            if c == "\\":
                i += 2
            elif c == '"':
                return i + 1
            elif c == "$":
                i = self.dollar(i)
            elif c == "`":
                j = text.find("`", i + 1)
                if j < 0:
                    raise Broken(i, "unterminated command substitution")
                i = j + 1
            else:
                i += 1
        raise Broken(start, "unterminated quote")

    def dollar(self, i: int) -> int:
        text = self.text
        if text.startswith("$((", i):
            level, j = 0, i + 1
            while j < len(text):
                if text[j] == "(":
                    level += 1
                elif text[j] == ")":
                    level -= 1
                    if level == 0:
                        return j + 1
                j += 1
            raise Broken(i, "unterminated arithmetic")
        if text.startswith("$(", i):
            return self.command(i + 2, i)
        if text.startswith("${", i):
            j = i + 2
            while j < len(text):
                c = text[j]
                if c == "}":
                    return j + 1
                if c == "\\":
                    j += 2
                elif c == "'" and text[i - 1 : i] != '"':
                    k = text.find("'", j + 1)
                    j = k + 1 if k >= 0 else j + 1
                elif c == '"':
                    j = self.double(j + 1, j)
                elif c == "$":
                    j = self.dollar(j)
                else:
                    j += 1
            raise Broken(i, "unterminated expansion")
        if text.startswith("$'", i):
            j = i + 2
            while j < len(text) and text[j] != "'":
                j += 2 if text[j] == "\\" else 1
            if j >= len(text):
                raise Broken(i, "unterminated quote")
            return j + 1
        return i + 1

    def command(self, i: int, start: int) -> int:
        """The end of a command substitution that begins at ``i``; its commands are parsed."""
        inner = ShellParser(self.text, i, True)
        self.faults += inner.run()
        if inner.end < 0:
            raise Broken(start, "unterminated command substitution")
        return inner.end


class ShellParser(Parser):
    def __init__(self, text: str, start: int = 0, nested: bool = False):
        self.start, self.nested, self.end = start, nested, -1
        super().__init__(text)

    def lexed(self, text: str) -> Lexed:
        out, i, n, waiting = Lexed(), self.start, len(text), []
        scan = Scan(text, out.faults)
        level, tests, cases = 0, 0, 0
        fresh = True
        try:
            while i < n:
                m = SPACE.match(text, i)
                if m:
                    i = m.end()
                    continue
                c = text[i]
                if c == "#":
                    j = text.find("\n", i)
                    i = n if j < 0 else j
                    continue
                if c == "\n":
                    out.add("\n", False, i)
                    i += 1
                    for word, strip in waiting:
                        i = self.here(text, i, word, strip, out)
                    waiting = []
                    fresh = True
                    continue
                m = OPERATOR.match(text, i)
                if m and not (m[0] in ("<", ">") and text.startswith("(", m.end())) and not (tests and m[0] in "<>()&&||"):
                    v = m[0]
                    if v == "(":
                        if text.startswith("((", i) and (fresh or out.value[-1:] == ["for"]):
                            j = text.find("))", i)
                            if j < 0:
                                raise Broken(i, "unterminated arithmetic")
                            out.add(WORD, False, i)
                            i, fresh = j + 2, False
                            continue
                        level += 1
                    elif v == ")":
                        if level == 0 and self.nested and not cases:
                            self.end = i + 1
                            break
                        level = max(0, level - 1)
                    out.add(v, False, i)
                    i = m.end()
                    if v in ("<<", "<<-"):
                        i = SPACE.match(text, i).end() if SPACE.match(text, i) else i
                        j = scan.word(i)
                        if j == i:
                            raise Broken(i, "here-document without a word")
                        waiting.append((re.sub(r"[\\'\"]", "", text[i:j]), v == "<<-"))
                        out.add(WORD, False, i)
                        i = j
                    fresh = v not in REDIRECTS
                    continue
                j = i + 2 if tests and re.match(r"\]\](?=[\s;&|)]|$)", text[i : i + 3]) else scan.word(i, " \t\r\n" if tests else " \t\r\n;&|<>()")
                if j == i:
                    j = i + 1
                w = text[i:j]
                m = ASSIGNMENT.fullmatch(w)
                if m and text.startswith("(", j):
                    j = self.array(text, j, scan)
                    w = WORD
                tests += (w == "[[" and fresh) - (w == "]]" and tests > 0)
                if fresh and w == "case":
                    cases += 1
                elif w == "esac":
                    cases = max(0, cases - 1)
                plain = w in RESERVED or w == "]]"
                out.add(w if plain else WORD, not plain, i)
                out.newline[-1] = bool(re.fullmatch(r"[A-Za-z_][\w.:+-]*", w))
                fresh = w in ("if", "then", "elif", "else", "while", "until", "do", "{", "!", "time") or bool(ASSIGNMENT.match(w)) and w is not WORD
                if re.fullmatch(r"\d+", w) and text[j : j + 1] in ("<", ">"):
                    out.value.pop(), out.name.pop(), out.at.pop(), out.newline.pop()
                i = j
        except Broken as e:
            out.faults.append((e.args[0], e.args[1]))
            i = n
        if waiting and not self.nested and any(True for _ in waiting):
            pass  # an end of file ends a here-document
        out.add(EOF, False, i)
        return out

    def here(self, text: str, i: int, word: str, strip: bool, out: Lexed) -> int:
        while i < len(text):
            j = text.find("\n", i)
            j = len(text) if j < 0 else j
            line = text[i:j].rstrip("\r")
            if (line.lstrip("\t") if strip else line) == word:
                return j
            i = j + 1
        return len(text)

    def array(self, text: str, i: int, scan: Scan) -> int:
        j = i + 1
        while True:
            while j < len(text) and text[j] in " \t\r\n":
                j += 1
            if j >= len(text):
                raise Broken(i, "unterminated array")
            if text[j] == ")":
                return j + 1
            if text[j] == "#":
                k = text.find("\n", j)
                j = len(text) if k < 0 else k
                continue
            k = scan.word(j)
            if k == j:
                raise Broken(j, "unexpected operator in array")
            j = k

    def top(self) -> None:
        while not self.at(EOF):
            self.guarded(self.line, stops=("\n", ";"), close="")

    def newlines(self) -> None:
        while self.at("\n"):
            self.i += 1

    def line(self) -> None:
        if self.at("\n"):
            self.i += 1
            return
        self.chain()
        if not (self.take("\n") or self.take(";") or self.take("&") or self.at(EOF)):
            self.fail("end of command expected")

    def commands(self, *stops: str) -> None:
        """Commands up to a reserved word; at least one."""
        self.newlines()
        some = False
        while not self.at(*stops):
            if self.at(EOF):
                self.fail(f"{stops[0]!r} expected")
            self.chain()
            some = True
            if self.at("\n", ";", "&"):
                self.i += 1
                self.newlines()
            elif not self.at(*stops):
                self.fail("end of command expected")
        if not some:
            self.fail("command expected")

    def chain(self) -> None:
        self.pipeline()
        while self.at("&&", "||"):
            self.i += 1
            self.newlines()
            self.pipeline()

    def pipeline(self) -> None:
        while self.at("!", "time"):
            self.i += 1
        self.command()
        while self.at("|", "|&"):
            self.i += 1
            self.newlines()
            self.command()

    def redirects(self) -> None:
        while self.v[self.i] in REDIRECTS:
            self.i += 1
            if not self.at(WORD) and self.v[self.i] not in RESERVED:
                self.fail("word expected")
            self.i += 1

    def command(self) -> None:
        self.deeper()
        v = self.v[self.i]
        if v == "if":
            self.i += 1
            self.commands("then")
            self.i += 1
            self.commands("elif", "else", "fi")
            while self.take("elif"):
                self.commands("then")
                self.i += 1
                self.commands("elif", "else", "fi")
            if self.take("else"):
                self.commands("fi")
            self.need("fi")
        elif v in ("while", "until"):
            self.i += 1
            self.commands("do")
            self.i += 1
            self.commands("done")
            self.i += 1
        elif v in ("for", "select"):
            self.i += 1
            if not self.at(WORD):
                self.fail("name expected")
            self.i += 1
            self.newlines()
            if self.take("in"):
                while not self.at("\n", ";", EOF):
                    if not self.at(WORD) and self.v[self.i] not in RESERVED:
                        self.fail("word expected")
                    self.i += 1
            self.take(";")
            self.newlines()
            closing = "}" if self.at("{") else "done"
            if not self.take("do") and not self.take("{"):
                self.fail("'do' expected")
            self.commands(closing)
            self.i += 1
        elif v == "case":
            self.i += 1
            self.i += 1
            self.newlines()
            self.need("in")
            self.newlines()
            while not self.take("esac"):
                self.take("(")
                while True:
                    if not self.at(WORD) and self.v[self.i] not in RESERVED:
                        self.fail("pattern expected")
                    self.i += 1
                    if not self.take("|"):
                        break
                self.need(")")
                self.newlines()
                while not self.at(";;", ";&", ";;&", "esac"):
                    self.chain()
                    while self.at("\n", ";", "&"):
                        self.i += 1
                if self.at(";;", ";&", ";;&"):
                    self.i += 1
                self.newlines()
        elif v == "{":
            self.i += 1
            self.commands("}")
            self.i += 1
        elif v == "(":
            self.i += 1
            self.commands(")")
            self.i += 1
        elif v == "[[":
            while not self.take("]]"):
                if self.at(EOF):
                    self.fail("']]' expected")
                self.i += 1
        elif v == "function":
            self.i += 1
            self.need(WORD)
            if self.take("("):
                self.need(")")
            self.newlines()
            return self.compound()
        elif v == WORD and self.peek(1) == "(":
            if self.peek(2) != ")" or not self.t.newline[self.i]:
                self.i += 1
                self.fail("end of command expected")
            self.i += 3
            self.newlines()
            return self.compound()
        elif v == WORD or v in REDIRECTS:
            while True:
                if v in REDIRECTS:
                    self.redirects()
                elif v == WORD or v in RESERVED or v == "]]":
                    self.i += 1
                else:
                    break
                v = self.v[self.i]
        else:
            self.fail("command expected")
        self.redirects()
        self.depth -= 1
        return None

    def compound(self) -> None:
        if not self.at("{", "(", "if", "for", "while", "until", "case", "[[", "select"):
            self.fail("function body expected")
        self.depth -= 1
        self.command()
