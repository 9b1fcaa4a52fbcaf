"""Code units of source files: functions and classes, and the whole file where there are none."""

from __future__ import annotations

import ast
import hashlib
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

from .declarations import declarations

#: Language by ending of a path, and the version of its parser.
LANGUAGES = {
    "python": ("py",), "typescript": ("ts", "mts", "cts"), "tsx": ("tsx",), "rust": ("rs",), "cpp": ("cpp", "cxx", "cc", "c++", "hpp", "hxx", "hh", "h++"), "c": ("c", "h"),
    "csharp": ("cs",), "go": ("go",), "bash": ("sh", "bash", "zsh"), "css": ("css",), "java": ("java",), "ruby": ("rb",),
}
BY_ENDING = {e: language for language, endings in LANGUAGES.items() for e in endings}
PYTHON_KEY = "python-ast:v1"
#: Unit types that count as functions and as classes where duplicates are sought.
FUNCTION_TYPES = [
    "arrow_function", "compact_constructor_declaration", "constructor_declaration", "function", "function_declaration", "function_definition", "function_expression", "function_item",
    "generator_function_declaration", "method", "method_declaration", "method_definition", "rule_set", "singleton_method",
]
CLASS_TYPES = [
    "class", "class_declaration", "class_definition", "class_specifier", "enum_declaration", "enum_item", "enum_specifier", "impl_item", "interface_declaration", "module", "mod_item",
    "namespace_definition", "record_declaration", "struct_declaration", "struct_item", "struct_specifier", "trait_item", "type_alias_declaration", "type_declaration",
]
SCHEMA = "id string, file_path string, start_line int, end_line int, start_byte int, end_byte int, unit_type string, name string, source string, source_hash string, language string, parser_key string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def language_of(path: str) -> str:
    """The language by the ending of a path, else text."""
    name = path.rsplit("/", 1)[-1]
    return BY_ENDING.get(name.rsplit(".", 1)[-1].lower() if "." in name else "", "text")


def unit(path: str, source: str, lines: tuple[int, int], span: tuple[int, int], kind: str, name: str | None, language: str, key: str) -> tuple:
    """A row of SCHEMA; its id comes from the path, the bytes it spans, its type and the hash of its source."""
    digest = hashlib.sha256(source.encode()).hexdigest()
    id_ = hashlib.sha256(f"{path}:{span[0]}:{span[1]}:{kind}:{digest}".encode()).hexdigest()
    return (id_, path, *lines, *span, kind, name, source, digest, language, key)


def python_units(path: str, source: str) -> list[tuple]:
    """Functions and classes, level by level, as whole lines and without decorators; none if the file doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = source.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line.encode()))
    out, waiting = [], deque([tree])
    while waiting:
        node = waiting.popleft()
        waiting.extend(ast.iter_child_nodes(node))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
            first, last = node.lineno, min(node.end_lineno or node.lineno, len(lines))
            span = (starts[first - 1] + node.col_offset, starts[last])
            out.append(unit(path, "".join(lines[first - 1 : last]), (first, last), span, kind, node.name, "python", PYTHON_KEY))
    return out


def file_unit(path: str, source: str, for_comparison: bool = False) -> tuple:
    """The whole file as one unit, of at least one line; units for comparison bear the path as their name."""
    language = language_of(path)
    key = "fallback-text:v1" if language == "text" else f"{language}:fallback:v1"
    lines, span = (1, max(1, len(source.splitlines()))), (0, len(source.encode()))
    if for_comparison:
        return unit(path, source, lines, span, "file", path, language, f"{PYTHON_KEY if language == 'python' else key}|file:v1")
    return unit(path, source, lines, span, "file", None, language, key)


def declared_units(path: str, source: str) -> list[tuple]:
    """Declarations of the other languages, outer ones before inner ones."""
    language = language_of(path)
    found = declarations(language, source)
    if not found:
        return []
    plain = source.isascii()
    at = (lambda i: i) if plain else list(accumulate((len(c.encode("utf-8", "surrogatepass")) for c in source), initial=0)).__getitem__
    breaks = [m.start() for m in re.finditer("\n", source)]
    line = lambda i: bisect_left(breaks, i) + 1
    return [unit(path, source[a:b], (line(a), line(b - 1)), (at(a), at(b)), kind, name, language, f"{language}-declarations:v1") for a, b, kind, name in found]


def units_of(path: str, source: str) -> list[tuple]:
    """The units of a file; the file itself if there are none."""
    found = python_units(path, source) if language_of(path) == "python" else declared_units(path, source)
    return found or [file_unit(path, source)]


def parse_files(files: DataFrame) -> DataFrame:
    """Units of (path, contents); null contents are dropped. One partition at a time, nothing shuffled."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([u for p, c in zip(b["path"], b["contents"]) for u in units_of(p, c)], columns=COLUMNS)

    return files.where("path is not null and contents is not null").select("path", "contents").mapInPandas(parse, SCHEMA)
