"""Clean text from chunks of documentation that hold HTML, Markdown, wiki or LaTeX markup.

Each chunk is parsed to a tree: HTML elements, sections under their headings, lists, tables and quotes are inner nodes,
and their leaves hold text without markup, with its kind. A node's label is its presentation (element and class, or kind),
its path the labels from the root. The trees of one host, a docset, are merged into a site style tree by these paths:
an element node of the merged tree has as styles the sequences of labels that its children form on the host's pages.

The importance of an inner node comes from the entropy of its styles (many different presentations: content) and, through
them, from its children; that of a leaf from the entropy of its contents over the pages (the same text everywhere:
noise). Elements of low importance that nearly all pages have, such as navigation, are removed as whole branches;
contents that nearly all pages with their style share, such as notices, are removed from paragraphs, tables and
quotes. What remains is joined to clean text, with plain signs for headings, lists and code.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: What lies below this importance is removed, if the lower bound (95 %) of the share of pages that have it is at least SHARE;
#: the bound takes the place of a least number of pages.
IMPORTANT, SHARE = 0.3, 0.5
#: How much a node's own presentation counts, beside its children: 1 - DAMPING to the number of its styles.
DAMPING = 0.9
#: Levels of the tree; what is nested deeper hangs on the last of them.
DEPTH = 8
#: Kinds of leaves that are never removed because their own text recurs.
KEPT_KINDS = ("heading", "code", "list", "formula")
KINDS = ("html", "markdown", "wiki", "latex")

#: Names of HTML elements. Those that are also common words count only with attributes or an end tag.
TAGS = frozenset("a abbr b big blockquote body br button caption center cite code col colgroup dd del dfn dl dt em fieldset font form h1 h2 h3 h4 h5 h6 head hr html i iframe img input ins kbd li nav ol optgroup p pre s samp script small span strike strong style sub sup table tbody td textarea tfoot th thead tr tt u ul var div svg video audio".split())
WORD_TAGS = frozenset("address article aside canvas data details dialog figure footer header label legend link main map mark menu meta meter object option output param picture progress q section select source summary template time title track base area embed".split())
BLOCK_TAGS = "p|div|h[1-6]|ul|ol|li|pre|table|tr|br|hr|blockquote|section|article|nav|header|footer|aside|main"
#: LaTeX commands, with and without arguments.
LATEX_WITH = "part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|textbf|textit|texttt|textsc|textrm|textsf|emph|underline|ref|eqref|pageref|cite[pt]?|label|footnote|url|href|caption|includegraphics|frac|sqrt|mathbb|mathbf|mathcal|mathrm|text|operatorname|usepackage|documentclass|title|author|input|bibliography|vspace|hspace|mbox|verb|begin|end"
LATEX_BARE = "item|maketitle|tableofcontents|newline|newpage|noindent|centering|cdot|cdots|ldots|times|sum|prod|int|le|leq|ge|geq|neq|approx|infty|alpha|beta|gamma|delta|epsilon|lambda|mu|sigma|theta|pi|omega|log|ln|sin|cos|max|min|in|to|rightarrow|leftarrow|left|right|quad|par"

HEADER_LINE = re.compile(r"(?:Docset|Page|Path|Type):[^\n]*(?:\n|\Z)")
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[\w:@.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>`=]+))?)*)\s*(/?)>")
COMMENT = re.compile(r"<!--[\s\S]*?(?:-->|\Z)")
DOCTYPE = re.compile(r"<!doctype[^>]*>|<\?xml[^>]*\?>", re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
PRE = re.compile(r"<pre\b[^>]*>([\s\S]*?)</pre\s*>", re.I)
FENCE = re.compile(r"^[ ]{0,3}(`{3,}|~{3,})([^\n`]*)$")
MD_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*$")
SETEXT = re.compile(r"^ {0,3}(?:=+|-{3,})[ \t]*$")
MD_RULE = re.compile(r"^ {0,3}\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$")
MD_ROW = re.compile(r"^ {0,3}\|.*\|[ \t]*$")
MD_QUOTE = re.compile(r"^ {0,3}>[ ]?(?=\S)(.*)$")
MD_DEFINITION = re.compile(r"^ {0,3}\[[^\]\n]+\]:[ \t]+\S+(?:[ \t]+[\"'(][^\n]*[\"')])?[ \t]*$")
MD_ITEM = re.compile(r"^ {0,8}(?:[-*+]|\d{1,3}[.)])[ \t]+(\S.*)$")
MD_IMAGE = re.compile(r"!\[([^\]\n]*)\](?:\([^()\s]*(?:[ \t]+\"[^\"\n]*\")?\)|\[[^\]\n]*\])")
MD_LINK = re.compile(r"(?<![\w\]!])\[([^\[\]\n]+)\](?:\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)|\[[^\[\]\n]+\](?!\())")
MD_CODE = re.compile(r"(?<![`\\])(`{1,2})(?!`)([^\n]*?[^`\n])\1(?!`)")
MD_STRONG = re.compile(r"(?<![\w\\*])\*\*(?=[^\s*])((?:[^*\n]|\*(?!\*))*?[^\s*\\])\*\*(?![\w\\*])")
MD_EM = re.compile(r"(?<![\w\\*])\*(?=[^\s*])([^*\n]{0,200}?[^\s*\\])\*(?![\w\\*])")
MD_UNDER = re.compile(r"(?<!\w)__(?=\S)([^_\n]*\s[^_\n]*\S)__(?!\w)")
WIKI_HEADING = re.compile(r"^(={2,6})[ \t]*([^=\s][^=\n]*?)[ \t]*\1[ \t]*$")
WIKI_STRONG = re.compile(r"'''(?=\S)(.+?)'''")
WIKI_EM = re.compile(r"(?<!')''(?!')(?=\S)(.+?)(?<!')''(?!')")
WIKI_CATEGORY = re.compile(r"\[\[(?:Category|File|Image):[^\[\]\n]*\]\]")
WIKI_LINK = re.compile(r"\[\[([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]")
WIKI_TEMPLATE = re.compile(r"\{\{(?=[A-Za-z#])([^{}\n]+)\}\}")
LATEX_DISPLAY = re.compile(r"\$\$(?=[^$])([\s\S]+?)\$\$|(?<!\\)\\\[([\s\S]+?)\\\]|(?<!\\)\\\(([^\n]+?)\\\)")
LATEX_MATH = re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?![\w$])")
LATEX_SIGN = re.compile(r"[\\^_{}=+]|^[A-Za-z]$")
LATEX_COMMAND = re.compile(rf"(?<![\w\\:])\\(?:({LATEX_WITH})\*?(?:\[[^\]\n]*\])?\{{|({LATEX_BARE})(?![A-Za-z\\]))|(?<=~)\\(ref|cite)\{{")
LATEX_ARGUMENT = re.compile(r"(~?)\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
ENVIRONMENT = re.compile(r"^\s*\\begin\{([A-Za-z]+\*?)\}(.*)$")
CODE_LINE = re.compile(r"(?:[;{}]|\)\s*\{|=>|->)\s*(?://.*|/\*.*)?$|^\s*(?:def|class|func|fn|pub|import|from|package|public|private|protected|static|return|export|const|let|var|use|struct|enum|interface|impl|async|await|elif|else|try|except|switch|case|for|while|if|#include|#define|@\w+|local|done|fi|esac)\b.*[:;{}()\]\"'>,]\s*$|^\s*(?:/\*|\*/|//|\* )|^#include\b|^\s*[)\]}]+[;,]?\s*$")
TABLE_LINE = re.compile(r"^[^\t\n]+\t[^\n]*$")


CONTROL = re.compile("[\x00-\x03]")
#: Attributes that tell how an element looks; marks that stand for block elements within a text.
LOOKS = re.compile(r"\s(class|style|role|align|bgcolor|width|color)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>`=]+))", re.I)
MARK = re.compile("\x02(/?)([^\x02\x03]*)\x03")
TEXT_ELEMENT, HEADING_ELEMENT = re.compile("h[1-6]|p"), re.compile("h[1-6]")
#: Elements that end where one of their own name begins, and elements without contents.
SIBLINGS, VOID = frozenset(["p", "li", "tr"]), frozenset(["br", "hr"])


def _is_code_line(line: str) -> bool:
    return bool(CODE_LINE.search(line)) and not (WIKI_TEMPLATE.search(line) or LATEX_COMMAND.search(line))


def _lone_code(line: str) -> bool:
    """Whether a line of code that stands alone isn't rather a sentence or an element."""
    return not re.match(r"^[A-Z][a-z]+ .*\w\.$", line) and not line.lstrip().startswith("<")


class Document:
    """The tree of one chunk. ``nodes`` in the order of the text: [parent, above, label, path, kind, text, syntax], with an empty kind for inner nodes."""

    def __init__(self, text: str | None):
        self.kinds: set[str] = set()
        self.nodes: list[list] = []
        #: Open inner nodes, the section of each heading level among them, as (name, node).
        self.open: list[tuple[str, int]] = []
        body = re.sub(r"\r\n?", "\n", text or "").strip("\n")
        at = 0
        while m := HEADER_LINE.match(body, at):
            at = m.end()
        self.head = body[:at].rstrip("\n")
        self.lines = body[at:].split("\n")
        blank = [not x.strip() for x in self.lines]
        #: The next blank line from each line on; sums of lines that aren't blank, and of those that look like code or rows.
        self.ends = list(accumulate(range(len(blank) - 1, -1, -1), lambda end, i: i if blank[i] else end, initial=len(blank)))[::-1]
        self.filled = [0, *accumulate(not x for x in blank)]
        self.coded: list[int] | None = None
        self.tabbed = [0, *accumulate(bool(TABLE_LINE.match(x)) for x in self.lines)] if "\t" in body else None
        self.i = 0
        self.parse()

    def inner(self, name: str, label: str) -> int:
        """A new inner node below the open ones, which stays open; one that is nested too deeply is only marked as open."""
        if len(self.open) >= DEPTH:
            self.open.append((name, self.open[DEPTH - 1][1]))
        else:
            self.open.append((name, self.node(label, "", "", "")))
        return len(self.open)

    def node(self, label: str, kind: str, text: str, syntax: str) -> int:
        above = [k for _, k in self.open[:DEPTH]]
        parent = above[-1] if above else -1
        path = (self.nodes[parent][3] if above else "") + "/" + label
        self.nodes.append([parent, above, label, path, kind, text, syntax])
        return len(self.nodes) - 1

    def add(self, syntax: str, kind: str, text: str) -> None:
        """Leaves of ``text``, of which marks of elements open and close inner nodes. What markup left no text has an empty leaf."""
        base = kind.rstrip("123456")
        pieces = MARK.split(text) if "\x02" in text else [text]
        if base == "heading" and len(pieces) == 1:
            self.section(int(kind[7:] or 1))
        depth = None
        if base in ("list", "table", "quote"):
            depth = len(self.open)
            self.inner(base, base)
        some = False
        for k, piece in enumerate(pieces):
            if k % 3 == 0:
                piece = piece.strip("\n")
                if piece.strip():
                    self.leaf(syntax, kind, base, piece, len(pieces) > 1)
                    some = True
            elif k % 3 == 2:
                self.element(piece, closing)
            else:
                closing = piece == "/"
        if depth is not None:
            del self.open[depth:]
        while self.open and TEXT_ELEMENT.fullmatch(self.open[-1][0]):  # no more than a block
            self.open.pop()
        if not some and syntax != "text":
            self.node("mark", "mark", "", syntax)

    def section(self, level: int) -> None:
        """Opens the section of a heading, which ends those of its level and below in the same element."""
        while self.open and self.open[-1][0][0] == "#" and int(self.open[-1][0][1:]) >= level:
            self.open.pop()
        self.inner(f"#{level}", f"section{level}")

    def leaf(self, syntax: str, kind: str, base: str, text: str, marked: bool) -> None:
        if marked:  # the elements around it tell what it is
            names = [name for name, _ in self.open]
            heading = next((name for name in names if HEADING_ELEMENT.fullmatch(name)), None)
            if heading:
                kind = "heading" + heading[1]
            elif "li" in names or base == "list":
                kind = "list"
            elif base == "heading":
                kind = "paragraph"
        if kind == "list":
            for item in re.split(r"\n(?=- |[-*+] |\d{1,3}[.)] )", text):
                self.node("item", kind, item, syntax)
        else:
            self.node(kind, kind, text, syntax)

    def element(self, label: str, closing: bool) -> None:
        name = label.split(".", 1)[0]
        if name in VOID:
            return
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == name), None)
        if closing:
            if at is not None:
                del self.open[at:]
        else:
            if name in SIBLINGS and at == len(self.open) - 1:
                del self.open[at:]
            if HEADING_ELEMENT.fullmatch(name):
                self.section(int(name[1]))
            self.inner(name, label)

    def is_code(self, start: int, end: int) -> bool:
        """Whether the lines of a paragraph are bare code of a program."""
        if self.coded is None:
            self.coded = [0, *accumulate(map(_is_code_line, self.lines))]
        n, hits = self.filled[end] - self.filled[start], self.coded[end] - self.coded[start]
        return n > 0 and hits * 2 >= n and (n > 1 or _lone_code(next(x for x in self.lines[start:end] if x.strip())))

    def parse(self) -> None:
        lines, n = self.lines, len(self.lines)
        while self.i < n:
            line = lines[self.i]
            if not line.strip():
                self.i += 1
            elif not self.block(line):
                self.paragraph()

    def until(self, closed, start: int) -> int:
        """The first line from ``start`` on that closes a block, or the end."""
        i = start
        while i < len(self.lines) and not closed(self.lines[i]):
            i += 1
        return i

    def block(self, line: str) -> bool:
        lines = self.lines
        if m := FENCE.match(line):
            fence = m[1]
            end = self.until(lambda x: x.strip().startswith(fence) and not x.strip().strip(fence[0]), self.i + 1)
            self.kinds.add("markdown")
            self.add("markdown", "code", "\n".join(lines[self.i + 1 : end]))
            self.i = end + 1
            return True
        if m := ENVIRONMENT.match(line):
            return self.environment(m[1])
        if re.match(r"\s*<pre\b", line, re.I):
            end = self.until(lambda x: "</pre" in x.lower(), self.i)
            whole = "\n".join(lines[self.i : end + 1])
            m = PRE.search(whole)
            inner = TAG.sub("", m[1] if m else re.sub(r"^\s*<pre\b[^>]*>", "", whole))
            self.kinds.add("html")
            self.add("html", "code", html.unescape(inner))
            rest = whole[m.end() :] if m else ""
            self.i = end + 1
            if rest.strip():
                self.add("html", "paragraph", self.inline(rest))
            return True
        if line.startswith("{|"):
            end = self.until(lambda x: x.startswith("|}"), self.i + 1)
            self.kinds.add("wiki")
            rows: list[list[str]] = [[]]
            for x in lines[self.i + 1 : end]:
                if x.startswith("|-"):
                    rows.append([])
                elif x[:1] in "|!":
                    cells = re.split(r"\|\||!!", x[2 if x.startswith("|+") else 1 :])
                    rows[-1] += [self.inline(c.strip()) for c in cells]
            self.add("wiki", "table", "\n".join("\t".join(r) for r in rows if r))
            self.i = end + 1
            return True
        if m := WIKI_HEADING.match(line):
            self.kinds.add("wiki")
            self.add("wiki", f"heading{len(m[1])}", self.inline(m[2]))
            self.i += 1
            return True
        m = MD_HEADING.match(line)
        if m and not m[2].rstrip().endswith((".", ";", "{", ":")) and (self.i + 1 >= len(lines) or not CODE_LINE.search(lines[self.i + 1])):
            self.kinds.add("markdown")
            self.add("markdown", f"heading{len(m[1])}", self.inline(m[2]))
            self.i += 1
            return True
        if MD_DEFINITION.match(line):
            self.add("markdown", "definition", "")
            self.i += 1
            return True
        following = lines[self.i + 1] if self.i + 1 < len(lines) else ""
        if SETEXT.match(following) and not SETEXT.match(line) and "\t" not in line and not self.is_code(self.i, self.i + 1) and re.search(r"\w", line) and not re.match(r"^\s*[|{#>]", line):
            self.kinds.add("markdown")
            self.add("markdown", "heading1" if "=" in following else "heading2", self.inline(line))
            self.i += 2
            return True
        if MD_RULE.match(following) and "|" in line or MD_ROW.match(line) and (MD_ROW.match(following) or MD_RULE.match(line)):
            end = self.until(lambda x: "|" not in x, self.i)
            self.kinds.add("markdown")
            rows = [x for x in lines[self.i : end] if not MD_RULE.match(x)]
            self.add("markdown", "table", "\n".join("\t".join(self.inline(c.strip()) for c in x.strip().strip("|").split("|")) for x in rows))
            self.i = end
            return True
        if MD_QUOTE.match(line):
            end = self.until(lambda x: not MD_QUOTE.match(x), self.i)
            self.kinds.add("markdown")
            self.add("markdown", "quote", self.inline("\n".join(MD_QUOTE.match(x)[1] for x in lines[self.i : end])))
            self.i = end
            return True
        return False

    def environment(self, name: str) -> bool:
        lines = self.lines
        close = f"\\end{{{name}}}"
        end = self.until(lambda x: close in x, self.i + 1)
        inner = lines[self.i + 1 : end]
        self.kinds.add("latex")
        if name.rstrip("*") in ("verbatim", "lstlisting", "minted", "Verbatim"):
            self.add("latex", "code", "\n".join(inner))
        elif name.rstrip("*") in ("equation", "align", "gather", "math", "displaymath", "eqnarray", "multline"):
            self.add("latex", "formula", "\n".join(inner))
        elif name.rstrip("*") in ("itemize", "enumerate", "description"):
            items = re.split(r"^\s*\\item\b(?:\[[^\]\n]*\])?[ \t]*", "\n".join(inner), flags=re.M)
            self.add("latex", "list", "\n".join("- " + self.inline(x.strip()) for x in items if x.strip()))
        else:
            self.add("latex", "paragraph", self.inline("\n".join(inner)))
        self.i = end + 1
        return True

    def paragraph(self) -> None:
        lines, start = self.lines, self.i
        end = self.ends[start]
        code = self.is_code(start, end)
        if code:
            self.i = end
            return self.add("text", "code", "\n".join(lines[start:end]))
        if self.tabbed and self.tabbed[end] - self.tabbed[start] == end - start:
            self.i = end
            return self.add("text", "table", "\n".join(lines[start:end]))
        # a paragraph ends where another block begins
        stop = start + 1
        while stop < end:
            x = lines[stop]
            if FENCE.match(x) or ENVIRONMENT.match(x) or x.startswith("{|") or WIKI_HEADING.match(x) or re.match(r"\s*<pre\b", x, re.I) or MD_DEFINITION.match(x) or MD_QUOTE.match(x) or MD_HEADING.match(x):
                break
            stop += 1
        self.i = stop
        part = lines[start:stop]
        before = set(self.kinds)
        self.kinds = set()
        items = [MD_ITEM.match(x) for x in part]
        listed = re.match(r"^\s*<(?:ul|ol|li)\b", part[0], re.I)
        text = self.inline("\n".join(part))
        kind = "list" if listed or all(items) and len(items) > 1 else "formula" if LATEX_DISPLAY.fullmatch("\n".join(part).strip()) else "paragraph"
        if re.match(r"^\s*<h([1-6])\b", part[0], re.I):
            kind = "heading" + re.match(r"^\s*<h([1-6])", part[0], re.I)[1]
        m = re.match(r"^\s*\\((?:sub){0,2}section|chapter)\b", part[0])
        if m:
            kind = f"heading{1 + m[1].count('sub') if 'section' in m[1] else 1}"
        syntax = "+".join(sorted(self.kinds)) or "text"
        self.kinds |= before
        return self.add(syntax, "mark" if syntax != "text" and not MARK.sub("", text).strip() else kind, text)

    def inline(self, text: str) -> str:
        """``text`` without inline markup."""
        kept: list[str] = []

        def keep(value: str) -> str:
            kept.append(value)
            return f"\x00{len(kept) - 1}\x01"

        def put(kind: str, value) -> object:
            def done(m: re.Match) -> str:
                self.kinds.add(kind)
                return value(m) if callable(value) else m.expand(value)

            return done

        if CONTROL.search(text):
            text = CONTROL.sub("", text)
        if "`" in text:
            text = MD_CODE.sub(put("markdown", lambda m: keep(m[2].strip())), text)
        if "$" in text or "\\" in text:
            text = LATEX_DISPLAY.sub(put("latex", lambda m: keep((m[1] or m[2] or m[3]).strip())), text)
            text = LATEX_MATH.sub(lambda m: put("latex", lambda k: keep(k[1]))(m) if LATEX_SIGN.search(m[1]) else m[0], text)
        if "<" in text:
            text = COMMENT.sub(put("html", ""), text)
            text = DOCTYPE.sub(put("html", ""), text)
            ends = {m[1].lower() for m in re.finditer(r"</([A-Za-z][A-Za-z0-9]*)\s*>", text)}

            def tag(m: re.Match) -> str:
                name = m[2].lower()
                if name not in TAGS and not (name in WORD_TAGS and (m[3] or name in ends and m[2] == name)):
                    return m[0]
                if name in ("b", "i", "s", "u", "a", "p", "q", "code", "var", "col", "input", "button", "form", "font", "small", "table", "style", "script", "caption", "label") and not m[1] and not m[3] and not m[4] and name not in ends and name != "p" and (m[2] != name or name in ("b", "i", "s", "u", "a", "q")):
                    return m[0]  # a type parameter or placeholder
                if name in ("code", "var", "input", "form", "style", "table", "button", "font", "caption") and not (m[1] or m[3] or m[4]) and name not in ends:
                    return m[0]
                self.kinds.add("html")
                if re.fullmatch(BLOCK_TAGS, name):
                    looks = ".".join(sorted(f"{a.lower()}={b or c or d}" for a, b, c, d in LOOKS.findall(m[3]))) if m[3] else ""
                    mark = f"\x02{m[1]}{name}{'.' + looks if looks and not m[1] else ''}\x03"
                    if m[4] and not m[1]:
                        mark += f"\x02/{name}\x03"
                    return mark + ("\n- " if name == "li" and not m[1] else "\n")
                return "\t" if name in ("td", "th") else ""

            text = TAG.sub(tag, text)
        if "&" in text:

            def entity(m: re.Match) -> str:
                value = html.unescape(m[0])
                if value == m[0]:
                    return value
                self.kinds.add("html")
                return keep(html.unescape(value)) if m[0].lower() == "&amp;" else keep(value.replace("\xa0", " "))

            text = re.sub(r"&amp;((?:lt|gt|amp|quot|#\d+);)", lambda m: self.kinds.add("html") or keep(html.unescape("&" + m[1])), text)
            text = ENTITY.sub(entity, text)
        if "[" in text:
            text = WIKI_CATEGORY.sub(put("wiki", ""), text)
            text = WIKI_LINK.sub(lambda m: put("wiki", lambda k: k[2] or k[1])(m) if re.search(r"[A-Za-z]{2}", m[1]) else m[0], text)
            text = MD_IMAGE.sub(put("markdown", r"\1"), text)
            text = MD_LINK.sub(lambda m: put("markdown", r"\1")(m) if not re.fullmatch(r"[\d\w]{1,2}|\d+", m[1]) or "(" in m[0] else m[0], text)
        if "{{" in text:
            text = WIKI_TEMPLATE.sub(put("wiki", lambda m: m[1].split("|")[-1]), text)
        if "''" in text:
            text = WIKI_STRONG.sub(put("wiki", r"\1"), text)
            text = WIKI_EM.sub(put("wiki", r"\1"), text)
        if "*" in text:
            text = MD_STRONG.sub(put("markdown", r"\1"), text)
            text = MD_EM.sub(put("markdown", r"\1"), text)
        if "__" in text:
            text = MD_UNDER.sub(put("markdown", r"\1"), text)
        if "\\" in text and LATEX_COMMAND.search(text):
            self.kinds.add("latex")
            for _ in range(3):
                text = LATEX_ARGUMENT.sub(lambda m: (" " if m[1] else "") + ("" if m[2] in ("begin", "end", "label", "vspace", "hspace") else m[3]), text)
            text = re.sub(r"(?<![\w\\:])\\item\b[ \t]*", "- ", text)
            text = re.sub(rf"(?<![\w\\:])\\(?:{LATEX_BARE})(?![A-Za-z\\])", "", text)
        text = re.sub(r"\x00(\d+)\x01", lambda m: kept[int(m[1])], text)
        if "\x00" in text:  # kept within kept
            text = re.sub(r"\x00(\d+)\x01", lambda m: kept[int(m[1])], text)
        return re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{2,}", "\n", text)).strip()


NODE = "parent int, above array<int>, label string, path string, kind string, text string, syntax string"
NODES = [pa.field("parent", pa.int32()), pa.field("above", pa.list_(pa.int32())), *[pa.field(name, pa.string()) for name in ("label", "path", "kind", "text", "syntax")]]


def parse_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, host, page_id, ordinal, head, nodes) of each chunk; rows that repeat an id count once.

    ``nodes`` is the tree, in the order of the text: the parent and all nodes above as positions, the label, the path of
    labels, and of leaves the kind, the text and the syntaxes of its markup. An empty or null text has no nodes.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [Document(t) for t in b.column(4).to_pylist()]
            flat = [n for d in made for n in d.nodes]
            columns = list(zip(*flat)) or [[]] * len(NODES)
            offsets = pa.array([0, *accumulate(len(d.nodes) for d in made)], pa.int32())
            nodes = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODES)], fields=NODES))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([d.head for d in made], pa.string()), nodes], ["chunk_id", "host", "page_id", "ordinal", "head", "nodes"])

    one = chunks.where("id is not null").groupBy("id").agg(F.min(F.struct("text", "docset_slug", "page_id", "ordinal")).alias("s")).select("id", "s.*")
    rows = one.select(F.col("id").cast("long"), F.coalesce("docset_slug", F.lit("")).alias("docset_slug"), F.coalesce("page_id", F.lit("")).alias("page_id"), F.col("ordinal").cast("int"), "text")
    return rows.mapInArrow(parse, f"chunk_id long, host string, page_id string, ordinal int, head string, nodes array<struct<{', '.join(f.replace(' ', ':') for f in NODE.split(', '))}>>")


def share_bound(some: Column, of: Column) -> Column:
    """The lower bound of the share that ``some`` are ``of`` all, at 95 % (Wilson's interval)."""
    n, z = of.cast("double"), 1.96
    p = F.least(some / n, F.lit(1.0))
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _entropy(total: Column, nlogn: Column, base: Column) -> Column:
    """-sum p log p over parts n of ``total``, p = n / total, to the base given, which counts as 2 at least."""
    return (F.log(total) - nlogn / total) / F.log(F.greatest(base, F.lit(2)))


def style_tree(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The merged tree of each host: (host, path, depth, pages, presentation, importance) of inner nodes, and (host, path, feature, pages,
    style_pages, importance) of the contents of leaves.

    Presentation: with m pages that have the node, the entropy to the base m of its styles, which are the sequences of
    labels of its children without repetitions in a row; 1 if only one page has it. Importance of a node with l styles:
    (1 - DAMPING^l) of its presentation and DAMPING^l of the mean over styles, and over the children in each, of their
    importance. Importance of a content: 1 minus the entropy of its occurrences over the pages that have its path;
    that of a leaf is the mean over the contents it has.
    """
    flat = parsed.select("host", "page_id", "chunk_id", F.posexplode("nodes").alias("at", "n")).select("host", "page_id", "chunk_id", "at", "n.parent", "n.label", "n.path", "n.kind", F.xxhash64("n.text").alias("feature"))
    leaves = flat.where("kind <> ''")
    per_page = leaves.groupBy("host", "path", "feature", "page_id").agg(F.count("*").alias("n"))
    contents = per_page.groupBy("host", "path", "feature").agg(F.count("*").alias("pages"), F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    held = flat.groupBy("host", "path", "page_id").agg(F.max("kind").alias("kind")).groupBy("host", "path").agg(F.count("*").alias("style_pages"))
    held = materialize(held, "held")
    contents = contents.join(held, ["host", "path"]).select("host", "path", "feature", "pages", "style_pages", "total", F.when(F.col("style_pages") < 2, 1.0).otherwise(1 - _entropy(F.col("total"), F.col("nlogn"), F.col("style_pages"))).alias("importance"))
    contents = materialize(contents, "contents")
    # inner nodes: the labels of children in order; leaves come with their kind as label
    depth = F.size(F.split("path", "/")) - 1
    rows = parsed.select("host", "page_id", F.posexplode("nodes").alias("at", "n"), F.col("nodes").alias("every")).where("n.kind = ''")
    labels = F.transform(F.filter("every", lambda c: c["parent"] == F.col("at")), lambda c: c["label"])
    changes = F.filter(F.arrays_zip(labels.alias("a"), F.concat(F.array(F.lit("")), labels).alias("b")), lambda z: z["a"].isNotNull() & (z["a"] != z["b"]))
    styled = rows.select("host", "page_id", F.col("n.path").alias("path"), F.transform(changes, lambda z: z["a"]).alias("style")).distinct()
    styles = styled.groupBy("host", "path", "style").agg(F.count("*").alias("n"))
    nodes = styles.groupBy("host", "path").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.count("*").alias("styles")).join(held, ["host", "path"])
    shown = F.when(F.col("style_pages") < 2, 1.0).otherwise(F.least(F.lit(1.0), _entropy(F.col("total"), F.col("nlogn"), F.col("style_pages"))))
    nodes = materialize(nodes.select("host", "path", depth.alias("depth"), F.col("style_pages").alias("pages"), "styles", "total", shown.alias("presentation")), "nodes")
    share = F.col("n") / F.col("total") / F.greatest(F.size(F.array_distinct("style")), F.lit(1))
    edges = styles.join(nodes.select("host", "path", "depth", "total"), ["host", "path"]).select("host", "path", "depth", F.explode(F.array_distinct("style")).alias("label"), share.alias("w"))
    edges = edges.groupBy("host", "path", "depth", "label").agg(F.sum("w").alias("w")).select("host", "path", "depth", F.concat("path", F.lit("/"), "label").alias("child"), "w")
    edges = materialize(edges, "edges")
    known = contents.groupBy("host", "path").agg((F.sum(F.col("importance") * F.col("total")) / F.sum("total")).alias("importance"))
    made = []
    deepest = nodes.agg(F.max("depth")).first()[0] or 0  # DEPTH at most
    for level in range(deepest, 0, -1):
        below = edges.where(F.col("depth") == level).join(known.withColumnRenamed("path", "child"), ["host", "child"]).groupBy("host", "path").agg(F.sum(F.col("w") * F.col("importance")).alias("of_children"))
        damped = F.pow(F.lit(DAMPING), "styles")
        here = nodes.where(F.col("depth") == level).join(below, ["host", "path"], "left")
        here = here.withColumn("importance", (1 - damped) * F.col("presentation") + damped * F.coalesce("of_children", F.lit(1.0))).select("host", "path", "depth", "pages", "presentation", "importance")
        if level % 3 == 0:
            here = materialize(here, "level")
        made.append(here)
        known = known.unionByName(here.select("host", "path", "importance"))
    every = nodes.limit(0).select("host", "path", "depth", "pages", "presentation", F.lit(0.0).alias("importance"))
    for here in made:
        every = every.unionByName(here)
    return every, contents.drop("total")


def _signed(node: Column) -> Column:
    """A leaf's text with a sign of its kind: # for headings by level, four blanks before lines of code."""
    kind = node["kind"]
    heading = F.concat(F.repeat(F.lit("#"), F.coalesce(F.try_to_number(F.substr(kind, F.lit(8), F.lit(1)), F.lit("9")).cast("int"), F.lit(1))), F.lit(" "), node["text"])
    item = F.when(node["text"].rlike(r"^(?:[-*+]|\d{1,3}[.)]) "), node["text"]).otherwise(F.concat(F.lit("- "), node["text"]))
    code = F.concat(F.lit("    "), F.regexp_replace(node["text"], "\n", "\n    "))
    return F.when(kind.startswith("heading"), heading).when(kind == "code", code).when(kind == "list", item).otherwise(node["text"])


def clean_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, host, page_id, kinds, text, blocks, removed) of each chunk of (id, docset_slug, page_id, ordinal, text).

    ``kinds``: the markup of the nodes of the chunk's tree; ``text``: header lines and the leaves that are left, without
    markup; ``blocks``: those leaves with their kind; ``removed``: how many leaves went, with a branch or by themselves.
    """
    parsed = materialize(parse_chunks(chunks), "parsed")
    tree, contents = style_tree(parsed)
    hosts = parsed.groupBy("host", "page_id").count().groupBy("host").agg(F.count("*").alias("host_pages"))
    element = ~F.substring_index("path", "/", -1).rlike(r"^(?:section\d|list|table|quote)$")
    branches = tree.where((F.col("importance") < IMPORTANT) & element).join(hosts, "host").where(share_bound(F.col("pages"), F.col("host_pages")) >= SHARE).select("host", "path")
    low = contents.where((F.col("importance") < IMPORTANT) & (share_bound(F.col("pages"), F.col("style_pages")) >= SHARE)).select("host", "path", "feature")
    flat = parsed.select("chunk_id", "host", F.posexplode("nodes").alias("at", "n")).select("chunk_id", "host", "at", "n.path", "n.kind", F.xxhash64("n.text").alias("feature"))
    kind = F.regexp_replace("kind", r"\d+$", "")
    alone = flat.where(F.col("kind").isin("") == F.lit(False)).where(~kind.isin(*KEPT_KINDS)).join(low, ["host", "path", "feature"], "left_semi").select("chunk_id", "at")
    gone = flat.where("kind = ''").join(branches, ["host", "path"], "left_semi").select("chunk_id", "at").unionByName(alone)
    dropped = gone.groupBy("chunk_id").agg(F.collect_set("at").alias("dropped"))
    both = parsed.join(dropped, "chunk_id", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    both = both.withColumn("gone", F.expr("filter(nodes, (n, i) -> n.kind <> '' and n.text <> '' and (array_contains(dropped, i) or arrays_overlap(n.above, dropped)))"))
    both = both.withColumn("kept", F.expr("filter(nodes, (n, i) -> n.kind <> '' and n.text <> '' and not (array_contains(dropped, i) or arrays_overlap(n.above, dropped)))"))
    syntaxes = F.flatten(F.transform("nodes", lambda n: F.split(n["syntax"], r"\+")))
    kinds = F.array_intersect(F.array(*map(F.lit, KINDS)), syntaxes)
    # items of a list follow each other, other leaves stand apart
    signed = F.transform("kept", lambda n: F.struct(_signed(n).alias("text"), (n["kind"] == "list").alias("item")))
    joined = F.aggregate(signed, F.struct(F.lit("").alias("text"), F.lit(False).alias("item")), lambda a, b: F.struct(F.concat(a["text"], F.when(a["text"] == "", "").when(a["item"] & b["item"], "\n").otherwise("\n\n"), b["text"]).alias("text"), b["item"].alias("item")))
    text = F.concat_ws("\n\n", F.when(F.col("head") != "", F.col("head")), F.when(F.size("kept") > 0, joined["text"]))
    return both.select("chunk_id", "host", "page_id", kinds.alias("kinds"), text.alias("text"), F.expr("transform(kept, n -> struct(n.kind as kind, n.text as text))").alias("blocks"), F.size("gone").alias("removed"))
