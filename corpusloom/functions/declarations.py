"""Declarations of languages whose blocks stand in braces: what the head of a block, the text between the last boundary and
its brace, says about it. Comments and strings are blanked first; blocks are paired in one pass. Ruby goes by its keywords."""

from __future__ import annotations

import re
from collections.abc import Iterator

Found = tuple[int, int, str, str | None]

C_COMMENT, QUOTED = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
#: What is blanked, by language; the default is that of C.
BLANKED = {
    "rust": C_COMMENT + r"|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:\\[^\n']+|[^'\\\n])'",
    "go": C_COMMENT + r"|`[^`]*`|" + QUOTED,
    "typescript": C_COMMENT + r"|`(?:[^`\\]|\\[\s\S])*`|" + QUOTED,
    "java": C_COMMENT + r'|"""[\s\S]*?(?:"""|\Z)|' + QUOTED,
    "csharp": C_COMMENT + r'|@"(?:[^"]|"")*"|' + QUOTED,
    "css": r"/\*[\s\S]*?(?:\*/|\Z)|" + QUOTED,
    "bash": r"(?<![\w$\{])#[^\n]*|'[^']*'|\"(?:[^\"\\]|\\[\s\S])*\"|\$\{[^}\n]*\}",
    "c": C_COMMENT + r"|^[ \t]*#(?:[^\n\\]|\\[\s\S])*|" + QUOTED,
}
#: Languages in which the end of a line bounds a head.
BY_LINE = frozenset(["go", "bash"])
CONTROL = r"(?!(?:if|else|for|while|do|switch|catch|try|return|new|throw|synchronized|using|lock|finally|sizeof|static_assert|case)\b)"
MODIFIERS = r"(?:(?:@[\w.]+(?:\([^()]*\))?|\[[^\[\]]*\]|public|private|protected|internal|static|final|abstract|sealed|non-sealed|default|synchronized|native|strictfp|virtual|override|async|readonly|partial|extern|unsafe|new)\s+)*"
TYPED = ("class_declaration", "interface_declaration", "enum_declaration", "record_declaration", "struct_declaration")
SCOPES = (None, "namespace_definition", "class_specifier", "struct_specifier", "linkage")
#: What stands before a declaration without being part of it.
BEFORE = {
    "typescript": r"(?:(?:export|default|declare)\s+)+", "rust": r"(?:#!?\[[^\]]*\]\s*)+", "c": r"(?:(?:public|private|protected)\s*:|template\s*<[^{};]*?>(?!\s*>)|typedef\b)\s*",
}
#: Kind of unit, head, kinds of the block around it (any if there are none given), and whether it may end with ; instead of a block.
Rule = tuple[str, str, tuple | None, bool]
RULES: dict[str, list[Rule]] = {
    "typescript": [
        ("generator_function_declaration", r"(?:async\s+)?function\s*\*\s*(?P<name>[\w$]+)", None, False),
        ("function_declaration", r"(?:async\s+)?function\s+(?P<name>[\w$]+)", None, False),
        ("class_declaration", r"(?:abstract\s+)?class\s+(?P<name>[\w$]+)", None, False),
        ("interface_declaration", r"interface\s+(?P<name>[\w$]+)", None, False),
        ("type_alias_declaration", r"type\s+(?P<name>[\w$]+)[^=]*=", None, True),
        ("method_definition", CONTROL + r"(?:(?:public|private|protected|static|override|readonly|async|get|set)\s+)*\*?\s*(?P<name>[#\w$]+)\s*(?:<[^{}]*>)?\s*\([\s\S]*\)\s*(?::[\s\S]+)?$", ("class_declaration",), False),
    ],
    "rust": [
        ("function_item", r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern)\s+)*fn\s+(?P<name>\w+)", None, False),
        ("impl_item", r"(?:unsafe\s+)?impl\b\s*(?:<[^{]*?>\s*)?(?:[^{]*\sfor\s+)?(?P<name>[\w:]+)", None, False),
        *[(f"{word}_item", rf"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?{word}\s+(?P<name>\w+)", None, word in ("struct", "mod")) for word in ("struct", "enum", "trait", "mod")],
    ],
    "go": [
        ("method_declaration", r"func\s*\([^)]*\)\s*(?P<name>\w+)", None, False),
        ("function_declaration", r"func\s+(?P<name>\w+)", None, False),
        ("type_declaration", r"type\s+(?P<name>\w+)\b", None, False),
    ],
    "java": [
        *[(f"{word}_declaration", MODIFIERS + rf"{word}\s+(?P<name>\w+)", None, False) for word in ("class", "interface", "enum", "record")],
        ("constructor_declaration", MODIFIERS + r"(?P<name>\w+)\s*\([\s\S]*\)\s*(?:throws\s[\s\S]*)?$", TYPED, False),
        ("method_declaration", CONTROL + MODIFIERS + r"(?:<[^{}]*>\s*)?" + CONTROL + r"[\w.$]+(?:\s*<[\s\S]*?>)?(?:\s*\[\s*\])*\s+(?P<name>\w+)\s*\([\s\S]*\)\s*(?:throws\s[\s\S]*)?$", TYPED, True),
    ],
    "css": [("media_statement", r"(?P<name>@media\b[^{]*)", None, False), ("rule_set", r"(?P<name>[^@\s][^{]*)", None, False)],
    "bash": [("function_definition", r"(?:function\s+(?P<name>[\w:.-]+)\s*(?:\(\s*\))?|(?P<other>[\w:.-]+)\s*\(\s*\))\s*$", None, False)],
    "c": [
        *[(kind, rf"{word}\b(?:\s+(?:class|struct))?\s*(?P<name>[\w:]+)?", None, False) for kind, word in (("namespace_definition", "(?:inline\\s+)?namespace"), ("class_specifier", "class"), ("struct_specifier", "struct"), ("enum_specifier", "enum"))],
        ("linkage", r"extern\s*$", None, False),
        ("function_definition", CONTROL + r"(?:[\w:<>,*&~\[\]\s]+?[\s*&])??(?P<name>~?[A-Za-z_][\w:~]*|[\w:]*operator\s*[^\s(]+)\s*\([\s\S]*\)(?:\s*(?:const|noexcept|override|final|&&?|->[\s\S]*|:[\s\S]*))*\s*$", SCOPES, False),
    ],
}
RULES["tsx"], RULES["cpp"] = RULES["typescript"], RULES["c"]
RULES["csharp"] = [*[(f"{word}_declaration", MODIFIERS + rf"{word}\s+(?P<name>\w+)", None, False) for word in ("class", "struct", "record", "interface", "enum")], *[r for r in RULES["java"] if "method" in r[0] or "constructor" in r[0]]]
#: Blocks that count only as surroundings: they are no units of the language.
NO_UNITS = {"java": ("record_declaration",), "csharp": ("interface_declaration", "enum_declaration"), "c": ("linkage",), "cpp": ("linkage",)}
RUBY = re.compile(r"^([ \t]*)(def|class|module)\s+(self\.)?([\w:?!=]+)", re.M)

#: Ends of heads after which a brace is no block.
TYPE_OR_VALUE = re.compile(r"[<|&:,=?]\s*\Z")

_COMPILED = {language: [(kind, re.compile(head), around, bare) for kind, head, around, bare in rules] for language, rules in RULES.items()}
_BLANKED = {language: re.compile(pattern, re.M) for language, pattern in BLANKED.items()}
_BEFORE = {language: re.compile(pattern) for language, pattern in BEFORE.items()}
SIMILAR = {"tsx": "typescript", "cpp": "c"}


def blanked(language: str, source: str) -> str:
    """``source`` with blanks for comments and strings, of the same length and lines."""
    pattern = _BLANKED.get(SIMILAR.get(language, language), _BLANKED["c"])
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _classified(language: str, head: str, start: int, around: tuple[str, str | None], bare: bool) -> tuple[int, str, str | None] | None:
    """(start, kind, name) of the declaration that a head, which begins at ``start``, is for."""
    before = _BEFORE.get(SIMILAR.get(language, language))
    at = len(head) - len(head.lstrip())
    while before and (m := before.match(head, at)) and m.end() > at:
        at = m.end()
    text = head[at:]
    for kind, pattern, parents, may_be_bare in _COMPILED[language]:
        if bare and not may_be_bare or parents is not None and around[0] not in parents:
            continue
        m = pattern.match(text)
        if m:
            named = m.groupdict()
            name = (named.get("name") or named.get("other") or "").strip() or None
            if kind == "constructor_declaration" and name != around[1]:
                continue
            return start + at, kind, name
    return None


def declarations(language: str, source: str) -> list[Found]:
    """(start, end, kind, name) in characters, in the order of starts; none for a language without rules. Blocks that don't close are none."""
    if language == "ruby":
        return sorted(_ruby(source))
    if language not in RULES:
        return []
    return sorted(_in_braces(language, source), key=lambda f: (f[0], -f[1]))


def _in_braces(language: str, source: str) -> Iterator[Found]:
    text = blanked(language, source)
    literal = TYPE_OR_VALUE if SIMILAR.get(language, language) == "typescript" else None
    by_line, skipped = language in BY_LINE, NO_UNITS.get(language, ())
    boundary = 0
    # open brackets: sign, and for braces the declaration and where the head of what comes inside began
    open_: list[tuple[str, tuple[int, str, str | None] | None]] = []
    around: list[tuple[str | None, str | None]] = [(None, None)]
    for m in re.finditer(r"[(){}\[\];\n]", text):
        sign, i = m[0], m.start()
        if sign == "\n":
            if by_line and not (open_ and open_[-1][0] in "([="):
                boundary = i + 1
        elif sign in "([":
            open_.append((sign, None))
        elif sign in ")]":
            if open_ and open_[-1][0] in "([":
                open_.pop()
        elif sign == "{":
            within = bool(open_) and open_[-1][0] in "([=" or bool(literal and literal.search(text[boundary:i]))
            if within:  # in brackets, or part of a type or a value
                open_.append(("=", None))
                continue
            found = _classified(language, text[boundary:i], boundary, around[-1], False)
            open_.append(("{", found))
            around.append((found[1], found[2]) if found else ("block", None))
            boundary = i + 1
        elif sign == "}":
            while open_ and open_[-1][0] in "([":
                open_.pop()
            if open_ and open_[-1][0] == "=":
                open_.pop()
                continue
            if open_:
                found = open_.pop()[1]
                around.pop()
                if found and found[1] not in skipped:
                    yield found[0], i + 1, found[1], found[2]
            boundary = i + 1
        elif not (open_ and open_[-1][0] in "([="):
            found = _classified(language, text[boundary:i], boundary, around[-1], True)
            if found and found[1] not in skipped:
                yield found[0], i + 1, found[1], found[2]
            boundary = i + 1


def _ruby(source: str) -> Iterator[Found]:
    for m in RUBY.finditer(source):
        end = re.compile(rf"^{m[1]}end\b", re.M).search(source, m.end())
        if end:
            kind = {"def": "singleton_method" if m[3] else "method"}.get(m[2], m[2])
            yield m.start(2), end.end(), kind, m[4]
