"""Syntax checks of source files by recursive descent, one parser a language."""

from __future__ import annotations

import re
import sys
import threading
from collections.abc import Callable

from .ccpp import CParser, CppParser
from .core import Parser, Undecided
from .css import CssParser
from .golang import GoParser
from .java import JavaParser
from .python import PythonParser
from .rust import RustParser
from .shell import ShellParser
from .typescript import TypeScriptParser

#: Language and parser by the ending of a path.
LANGUAGES: dict[str, tuple[str, type[Parser]]] = {
    "py": ("python", PythonParser),
    "ts": ("typescript", TypeScriptParser),
    "mts": ("typescript", TypeScriptParser),
    "go": ("go", GoParser),
    "rs": ("rust", RustParser),
    "java": ("java", JavaParser),
    "c": ("c", CParser),
    "h": ("c", CParser),
    "cc": ("cpp", CppParser),
    "hpp": ("cpp", CppParser),
    "sh": ("bash", ShellParser),
    "bash": ("bash", ShellParser),
    "css": ("css", CssParser),
}
#: Languages in which an empty file is a fault.
NEVER_EMPTY = frozenset(["go"])
#: Frames and bytes of stack for files that nest too deeply for the usual ones.
DEEP_FRAMES, DEEP_STACK = 250_000, 256 << 20
#: Languages whose brackets pair up whatever stands between, so that a lone one is a fault even in an undecided file.
PAIRED = frozenset(["python", "typescript", "go", "rust", "java", "css"])
CLOSES = {"(": ")", "[": "]", "{": "}"}


def language_of(path: str) -> str | None:
    return LANGUAGES.get(path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "", (None,))[0]


def faults(path: str, contents: str | None) -> list[tuple[int, str]] | None:
    """(offset, message) of all syntax errors of a file, the first cause first; None if its language has no parser.

    A leading byte order mark, and CR and CRLF for line ends, are no faults. Null counts as empty.
    """
    found = examined(path, contents)
    return None if found is None else found[0]


def examined(path: str, contents: str | None) -> tuple[list[tuple[int, str]], str | None] | None:
    """As :func:`faults`, and the limit that left the file undecided beyond these faults, or None."""
    known = LANGUAGES.get(path.rsplit(".", 1)[-1].lower())
    if known is None:
        return None
    language, parser = known
    text = re.sub(r"\r\n?", "\n", (contents or "").removeprefix("﻿"))
    if not text.strip() and language not in NEVER_EMPTY:
        return [], None
    try:
        try:
            return parser(text).run(), None
        except RecursionError:
            return _deep(lambda: parser(text).run()), None
    except (Undecided, RecursionError, MemoryError) as e:
        limit, found = (e.args[0], e.args[1] if len(e.args) > 1 else []) if isinstance(e, Undecided) else ("nesting too deep", [])
    if not found and language in PAIRED:
        found = _unpaired(parser, text)
    return found, limit


def _deep(run: Callable[[], list]) -> list:
    """``run`` in a thread of its own, with a larger stack and more frames."""
    done: list = []

    def work() -> None:
        try:
            done.append(run())
        except BaseException as e:  # raised again by the caller
            done.append(e.with_traceback(None))

    frames, stack = sys.getrecursionlimit(), threading.stack_size(DEEP_STACK)
    sys.setrecursionlimit(DEEP_FRAMES)
    try:
        thread = threading.Thread(target=work)
        thread.start()
        thread.join()
    finally:
        sys.setrecursionlimit(frames)
        threading.stack_size(stack)
    if isinstance(done[0], BaseException):
        raise done[0]
    return done[0]


def _unpaired(parser: type[Parser], text: str) -> list[tuple[int, str]]:
    """The first bracket that doesn't pair up; none if the tokens can't be told either."""
    try:
        tokens = parser.lexed(parser.__new__(parser), text)
    except (Undecided, RecursionError):
        return []
    open_: list[tuple[str, int]] = []
    for v, at in zip(tokens.value, tokens.at):
        if v in CLOSES:
            open_.append((CLOSES[v], at))
        elif v in CLOSES.values():
            if not open_ or open_[-1][0] != v:
                return [(at, "closing bracket doesn't match")]
            open_.pop()
    return [(open_[-1][1], "bracket never closed")] if open_ else []
