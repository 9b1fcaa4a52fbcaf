"""Predicates and projections on paths and links."""

from __future__ import annotations

import posixpath
import re
from functools import reduce
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a scan leaves out, by name of any component of a path; .corpusloom holds the engine's own state.
EXCLUDED_DIRS = [".git", ".mypy_cache", ".next", ".nox", ".pytest_cache", ".ruff_cache", ".corpusloom", ".tox", ".turbo", ".venv", "__pycache__", "build", "dist", "env", "node_modules", "target", "venv"]
EXCLUDED_SUFFIXES = [".egg-info", ".dist-info"]
EXCLUDED_FILES = [
    ".gitignore", ".ignore", ".gitattributes", ".gitmodules", "bun.lock", "bun.lockb", "Cargo.lock", "composer.lock", "Gemfile.lock", "npm-shrinkwrap.json", "package-lock.json",
    "Pipfile.lock", "pnpm-lock.yaml", "poetry.lock", "uv.lock", "yarn.lock",
]
MAX_FILE_BYTES = 512 * 1024
#: First segments of links that count from the root in the C++ reference.
CPP_ROOTS = frozenset([
    "algorithm", "atomic", "chrono", "concept", "container", "coroutine", "error", "experimental", "filesystem", "header", "io", "iterator", "keyword", "language",
    "locale", "memory", "meta", "named_req", "numeric", "preprocessor", "regex", "string", "symbol_index", "thread", "types", "utility",
])


def under_prefix(path: Column, prefix: str) -> Column:
    """The path is the prefix or lies below it; wildcards are literal."""
    prefix = prefix.rstrip("/")
    return (path == prefix) | path.startswith(prefix + "/")


def under_any(path: Column, prefixes: list[str | None] | None) -> Column | None:
    """Below any of the prefixes. Empty ones stand for the root; then, and without prefixes, there is no filter (None)."""
    named = [p for p in prefixes or [] if p]
    if not named or len(named) < len(prefixes or []):
        return None
    return reduce(lambda a, b: a | b, [under_prefix(path, p) for p in named])


def has_component(path: Column, part: str) -> Column:
    return F.array_contains(F.split(path, "/"), part)


def terminal(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def ends_in(path: Column, part: str) -> Column:
    return terminal(path) == part


def is_excluded(path: Column) -> Column:
    """Whether any component is an excluded directory or has an excluded suffix, or the file is an excluded one."""
    named = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED_DIRS + EXCLUDED_FILES)))
    suffixed = F.exists(F.split(path, "/"), lambda p: reduce(lambda a, b: a | b, [p.endswith(s) for s in EXCLUDED_SUFFIXES]))
    return named | suffixed


def source_key(path: Column) -> Column:
    """The part before the anchor; ``index`` if that is empty."""
    key = F.substring_index(path, "#", 1)
    return F.when(key == "", "index").otherwise(key)


def anchor(path: Column) -> Column:
    """The part after the first #; null without one, or if it is empty."""
    part = F.regexp_extract(path, "^[^#]*#(.*)$", 1)
    return F.when(path.contains("#") & ~path.endswith("#"), part)


def scope_of(requested: str | None, runtime: str | None) -> str | None:
    """A requested scope within that of the session; absolute paths and parent steps are refused."""
    requested, runtime = (requested or "").strip().strip("/") if not (requested or "").startswith("/") else requested, (runtime or "").strip("/")
    if requested and (requested.startswith("/") or ".." in requested.split("/")):
        raise ValueError(f"scope must be a relative path without parent steps: {requested}")
    if not requested or requested == ".":
        return runtime or None
    if not runtime or requested == runtime or requested.startswith(runtime + "/"):
        return requested
    return f"{runtime}/{requested}"


def resolve_link(href: str, current: str) -> str:
    """Where a link of page ``current`` leads, as a page path with its query and anchor; other schemes stay as they are."""
    if not href or href.startswith("//") or re.match(r"(?:data|javascript|mailto):", href, re.I):
        return href
    parsed = urlparse(href)
    if (parsed.hostname or "").endswith("cppreference.com"):
        m = re.fullmatch(r"/w/cpp/?(.*)", parsed.path)
        if m:
            return (m[1] or "index") + (f"#{parsed.fragment}" if parsed.fragment else "")
    if parsed.scheme:
        return href
    cut = min([i for i in (href.find("?"), href.find("#")) if i >= 0], default=len(href))
    target, rest = href[:cut], href[cut:]
    page = current.split("#", 1)[0] or "index"
    if not target:
        return page + rest
    bare = target.lstrip("/").removeprefix("cpp/")
    rooted = "/" in bare and bare.split("/", 1)[0] in CPP_ROOTS and not target.startswith("/") and not bare.startswith(("./", "../"))
    return posixpath.normpath(bare if rooted else posixpath.join(posixpath.dirname(page), bare)) + rest


@F.pandas_udf(T.StringType())
def resolve_link_udf(href: pd.Series, current: pd.Series) -> pd.Series:
    """:func:`resolve_link`; null if either is."""
    return pd.Series([None if h is None or c is None else resolve_link(h, c) for h, c in zip(href, current)], dtype=object)


def escapes(path: Column) -> Column:
    """Whether a relative path leads out of its folder, or is none: absolute, with a drive or a backslash, or more steps up than down."""
    steps = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, x: F.struct((a["at"] + F.when(x == "..", -1).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(x == "..", -1).otherwise(1)).alias("low")))
    return F.coalesce(path.startswith("/") | path.contains("\\") | path.rlike("^[A-Za-z]:") | (depth["low"] < 0) | (depth["at"] <= 0), F.lit(True))


def ignore_rules(text: str, folder: str = "") -> list[tuple[str, bool]]:
    """(pattern over paths, whether it ignores) for the lines of an ignore file in ``folder``, in order; the last rule that fits decides."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
        below, bare = line.endswith("/"), line.strip("/")
        pattern, k = "", 0
        while k < len(bare):
            if bare.startswith("**/", k):
                pattern, k = pattern + "(?:.*/)?", k + 3
            elif bare.startswith("**", k):
                pattern, k = pattern + ".*", k + 2
            else:
                c = bare[k]
                end = bare.find("]", k + 2) if c == "[" else -1
                if end > 0:
                    pattern, k = pattern + "[" + bare[k + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end
                else:
                    pattern += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
                k += 1
        top = re.escape(folder + "/") if folder else ""
        anywhere = "" if "/" in line.rstrip("/") else "(?:.*/)?"
        rules.append((f"^{top}{anywhere}{pattern}" + ("/.*$" if below else "(?:/.*)?$"), not keep))
    return rules


def is_ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last of ``rules`` that fits a path ignores it."""
    out = F.lit(False)
    for pattern, ignores in rules:
        out = F.when(path.rlike(pattern), F.lit(ignores)).otherwise(out)
    return out
