"""Source files that nobody wrote by hand for their repository: generated, minified, vendored, or data stored as code.

Two kinds of evidence. Across repositories, Merkle hashes: a file's node is the hash of its contents, without what
copying changes (line ends, byte order mark, blanks at line ends and outside), a directory's node an order-independent
hash over the names and nodes of its children, made bottom-up. Subtrees that unrelated repositories share are vendored,
and so is a directory of which nearly all files lie in such subtrees. Within a file, header and layout rules: what the
comments before the code say, how lines, literals and numbered blocks look, and names that tools give to files. The
name of a directory counts only if it holds packages of other projects, and these have directories of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Directories that hold packages of other projects, and names that tools give to files.
VENDOR_DIRS = ["vendor", "_vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "deps", "node_modules", "bower_components", "Pods", "site-packages"]
GENERATED_NAMES = re.compile(r"_pb2(?:_grpc)?\.py$|\.pb\.(?:go|cc|h)$|^zz_generated|[._-](?:generated|gen|autogen|g)\.\w+$|\.designer\.\w+$", re.I)
MINIFIED_NAMES = re.compile(r"[.-](?:min|bundle|chunk)\.(?:js|css|mjs)$|^[0-9a-f]{5,}\.[\w.-]+\.(?:js|css)$", re.I)
#: What leading comments of generated and of copied files say, and what speaks against it.
GENERATED_HEADER = re.compile(
    r"code generated|@generated\b|auto-?generated|(?:automatically|machine)[ -](?:created|generated|made|produced|written|built)|\bdo not (?:edit|modify)\b"
    r"|\bgenerated (?:from|by|with|using)\b|\b(?:built|made|produced|created|written|emitted) by (?:make \S+?,? (?:see|from)\b|the \S+ (?:compiler|generator|tool)|a (?:program|script|tool)|\S*(?:gen|codegen|compiler|generator)\b)|changes will be lost",
    re.I,
)
BY_HAND = re.compile(r"(?:maintained|edited|written|kept|changed) by hand|hand-?(?:written|maintained|edited)|generated once|was (?:once|originally) generated|generated from this file|no longer generated", re.I)
COPIED_HEADER = re.compile(
    r"\bthis file is part of \S+,? (?:release|version)\b|\bv?\d+(?:\.\d+)+ - released under\b|\bimported unchanged from\b|\bupstream copy\b|\([cC]\) \S+ contributors\b|\bvendored from\b|\bcopied from the \S+ (?:project|source|repository)",
    re.I,
)
VERSION_LINE = re.compile(r"^[\W_]*[A-Za-z][\w.-]* v?\d+(?:\.\d+)+\W*$")
BANNER = re.compile(r"^/\*!\s*[A-Za-z][\w.-]* v?\d+(?:\.\d+)+", re.M)

TOKEN = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`|[A-Za-z_$][\w$]*|-?\d[\w.]*|[^\w\s$"\'`-]+|\S')
NUMBERS = re.compile(r"(?<=[A-Za-z_-])\d+")
NUMBERED = re.compile(r"[A-Za-z]*?[A-Za-z_-](\d+)")
#: JSON, whole or cut off anywhere; lines of encoded bytes.
JSON_TEXT = re.compile(r'\s*[\[{](?:\s+|[\[\]{}:,]|"(?:[^"\\\n]|\\.)*"|-?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|true|false|null)*(?:"[^"\n]*)?\s*')
JSON_START = re.compile(r'\s*(?:\[\s*(?:[{\[\d"-]|\])|\{\s*"[^"\n]*"\s*:)')
ENCODED_LINE = re.compile(r"^[A-Za-z0-9+/]{40,}={0,2}$|^(?:[0-9a-fA-F]{2}[ ,:]?){20,}$", re.M)
#: Blocks that every file may have once: names of packages, what is imported, comments.
PREAMBLE = re.compile(r"\s*(?:package\b|import\b|from\b|use\b|using\b|#\s*(?:include|pragma)\b|const \w+ = require\(|#!|set -|(?://|#|/\*|\*)[^\n]*(?:\n\s*(?://|#|\*)[^\n]*)*\Z)")
#: Lines that may come before the header comment.
FIRST_LINES = re.compile(r"#!|set [-+]\w|['\"]use \w+['\"];?$|package [\w.]+;?$|#\s*pragma once|<\?php$|# -\*-")
#: Layout limits: share of characters on lines over LONG, blanks among all characters, literals among non-blank ones and how
#: many there must be, repeated blocks and their share of all blocks, share of characters in encoded lines.
LONG, LONG_SHARE, FEW_BLANKS, DATA_SHARE, DATA_LITERALS, REPEATS, REPEAT_SHARE, ENCODED_SHARE = 200, 0.5, 0.1, 0.82, 16, 3, 0.6, 0.6
#: Levels of directories that one job makes.
LEVELS = 4
#: Bytes that a shared subtree must hold to count; share of the files of a directory that makes it a near copy.
SHARED_BYTES, NEAR_SHARE = 200, 0.8


def leading_comment(text: str) -> str:
    """The comments before the first line of code, whatever directives such as a shebang or a package name stand among them."""
    out, within = [], ""
    for line in text.split("\n"):
        s = line.strip()
        if within:
            out.append(s)
            if within in s:
                within = ""
        elif s.startswith("/*"):
            out.append(s)
            within = "" if "*/" in s[2:] else "*/"
        elif not s or s.startswith("//") or (s.startswith("#") and not re.match(r"#\s*(?:include|define|if|ifndef|ifdef|pragma|\[)", s)):
            out.append(s)
        elif not FIRST_LINES.match(s):
            break
    return "\n".join(out)


def _shape(block: str) -> str:
    return " ".join("S" if t[0] in "\"'`" else "N" if t[0].isdigit() or t[0] == "-" and len(t) > 1 else "I" if t[0].isalpha() or t[0] in "_$" else t for t in TOKEN.findall(block))


def _repeated(text: str) -> bool:
    """Whether most blocks have one shape and count up by a number in their names."""
    seen = set(map(int, NUMBERS.findall(text)))
    if not any(n + 1 in seen and n + 2 in seen for n in seen):
        return False
    blocks = [b for b in re.split(r"\n[ \t]*\n", text) if b.strip() and not PREAMBLE.match(b)]
    if len(blocks) < REPEATS:
        return False
    shapes = [_shape(b) for b in blocks]
    top, times = Counter(shapes).most_common(1)[0]
    paired = [b for s, b in zip(shapes, blocks) if s == top]
    numbers = [int(m[1]) for b in paired if (m := NUMBERED.search(b))]
    steps = sum(b == a + 1 for a, b in zip(numbers, numbers[1:]))
    kinds = len({s for s, n in Counter(shapes).items() if n > 1})
    return times >= REPEATS and times * max(1, min(kinds, 2)) >= REPEAT_SHARE * len(blocks) and steps >= 0.8 * (times - 1)


def plain(contents: str | None) -> str:
    """``contents`` with LF for line ends and without a byte order mark."""
    return (contents or "").removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


def layout_kind(path: str, contents: str | None) -> tuple[str, str] | None:
    """(kind, reason) of a file by header, name and layout, or None: generated, minified, data or vendored."""
    text = plain(contents)
    parts = path.split("/")
    name, dirs = parts[-1], parts[1:-1]
    head = leading_comment(text)
    if GENERATED_HEADER.search(head) and not BY_HAND.search(head):
        return "generated", "header"
    if GENERATED_NAMES.search(name):
        return "generated", "name"
    if any(d in VENDOR_DIRS for d in dirs[:-1]):
        return "vendored", "path"
    if COPIED_HEADER.search(head) or VERSION_LINE.match(next((x for x in head.split("\n") if re.search(r"\w", x) and not x.startswith("#!")), "")):
        return "vendored", "header"
    if MINIFIED_NAMES.search(name):
        return "minified", "name"
    n = len(text)
    if JSON_START.match(text) and JSON_TEXT.fullmatch(text):
        return "data", "layout"
    far = 0 if n <= LONG else sum(len(x) for x in text.split("\n") if len(x) > LONG)
    if far >= LONG_SHARE * n > 0 and (BANNER.match(text) or sum(map(text.count, " \t")) <= FEW_BLANKS * n):
        return "minified", "layout"
    tokens = TOKEN.findall(text)
    dense = sum(map(len, tokens))
    # names, and strings that are prose or statements, are no data
    words = sum(len(t) for t in tokens if t[0].isalpha() or t[0] in "_$" or t[0] in "\"'`" and t.count(" ") > len(t) / 25)
    if dense - words >= (0.7 if far >= LONG_SHARE * n else DATA_SHARE) * dense and sum(t[0] in "\"'`-" or t[0].isdigit() for t in tokens) >= DATA_LITERALS:
        return "data", "layout"
    if sum(map(len, ENCODED_LINE.findall(text))) >= ENCODED_SHARE * n > 0:
        return "data", "layout"
    if _repeated(text):
        return "generated", "layout"
    return None


def _mix(*columns: Column | str) -> list[Column]:
    """Two 32-bit halves of a 64-bit hash, to be summed: the sum over a set doesn't depend on order."""
    h = F.xxhash64(*columns)
    return [h.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), F.shiftrightunsigned(h, 32).alias("high")]


def merkle_nodes(files: DataFrame) -> DataFrame:
    """(repo, node_path, depth, digest, bytes, files) of every file and directory, from (repo, path, hash, bytes), one row a path.

    Levels are made from the deepest up. A few of them make one job, in which each level's exchange is made once and
    used for the level and for the one above.
    """
    parts = F.split("path", "/")
    nodes = files.select("repo", F.col("path").alias("node_path"), F.size(parts).alias("depth"), F.col("hash").alias("digest"), F.col("bytes").cast("long").alias("bytes"), F.lit(1).cast("long").alias("files"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0

    def above(level: DataFrame) -> DataFrame:
        up, leaf = F.regexp_replace("node_path", "/[^/]*$", ""), F.substring_index("node_path", "/", -1)
        low, high = _mix(leaf, "digest", F.lit("tree"))
        sums = level.select("repo", up.alias("node_path"), F.col("depth") - 1, low, high, "bytes", "files").toDF("repo", "node_path", "depth", "low", "high", "bytes", "files")
        sums = sums.groupBy("repo", "node_path", "depth").agg(*[F.sum(c).alias(c) for c in ("low", "high", "bytes", "files")])
        return sums.select("repo", "node_path", "depth", F.sha2(F.concat_ws(":", "low", "high", "files"), 256).alias("digest"), "bytes", "files")

    done, carried = [], None
    for top in range(deepest, 0, -LEVELS):
        made = []
        for depth in range(top, max(0, top - LEVELS), -1):
            level = nodes.where(F.col("depth") == depth)
            if carried is not None:
                level = level.unionByName(above(carried))
            made.append(level)
            carried = level
        block = materialize(reduce(DataFrame.unionByName, made), "levels")
        done.append(block)
        carried = block.where(F.col("depth") == max(1, top - LEVELS + 1))
    return reduce(DataFrame.unionByName, done) if done else nodes


def shared_files(files: DataFrame) -> DataFrame:
    """Paths below subtrees that unrelated repositories share: (path). Repositories are related if their names begin with the same word.

    Nodes are those of the files that hold something; a shared directory marks all files below it, small and empty ones
    too, and only the weight of the subtree counts. A directory of which at least NEAR_SHARE of the files are marked is
    a near copy, with a few files changed or added, and is marked as a whole. A subtree that is the whole of a
    repository is where the others come from, and is no copy there.
    """
    nodes = materialize(merkle_nodes(files.where("bytes > 0")), "nodes")
    family = F.regexp_extract("repo", "^[^-_./]+", 0)
    heavy = nodes.where(F.col("bytes") >= SHARED_BYTES)
    shared = heavy.groupBy("digest").agg(F.min(family).alias("a"), F.max(family).alias("b")).where("a <> b").select("digest")
    found = heavy.join(shared, "digest", "left_semi")
    whole = found.where("depth = 1").select("repo")
    marked = materialize(found.join(whole, "repo", "left_anti").select("repo", "node_path"), "shared")
    # only files of repositories that share anything are spread over the nodes above them
    some = files.select("repo", "path").join(marked.select("repo").distinct(), "repo", "left_semi")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    below = some.select("repo", "path", F.explode(above).alias("node_path"))
    copies = materialize(below.join(marked, ["repo", "node_path"], "left_semi").select("repo", "path").distinct(), "copies")
    # directories of two levels or more below the repository, of which nearly all files are copies
    inner = below.where((F.col("path") != F.col("node_path")) & F.contains("node_path", F.lit("/"))).join(copies.withColumn("copied", F.lit(True)), ["repo", "path"], "left")
    near = inner.groupBy("repo", "node_path").agg(F.count("copied").alias("copied"), F.count("*").alias("files")).where((F.col("copied") >= NEAR_SHARE * F.col("files")) & (F.col("copied") < F.col("files")))
    return copies.select("path").unionByName(below.join(near, ["repo", "node_path"], "left_semi").select("path")).distinct()


def _hash(contents: str | None) -> str:
    lines = [line.rstrip() for line in plain(contents).strip().split("\n")]
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


def not_by_hand(files: DataFrame) -> DataFrame:
    """(path, repo, hash, bytes, kind, reason) of the files of ``files`` (path, repo, contents), with nulls where neither header nor layout tells.

    ``hash`` is of the contents without what copying changes. Rows of a path count once (any of them); null paths are
    dropped, null and empty contents are judged by path only. A null repo is the first part of the path.
    """
    out = "path string, repo string, hash string, bytes long, kind string, reason string"

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [layout_kind(p, c) or (None, None) for p, c in zip(b["path"], b["contents"])]
            yield pd.DataFrame({"path": b["path"], "repo": b["repo"], "hash": [_hash(c) for c in b["contents"]], "bytes": b["contents"].map(lambda c: len(c.encode("utf-8", "surrogatepass")) if c else 0), "kind": [k for k, _ in found], "reason": [r for _, r in found]})

    rows = files.where("path is not null").select("path", F.coalesce("repo", F.substring_index("path", "/", 1)).alias("repo"), "contents")
    return rows.mapInPandas(judge, out).groupBy("path").agg(*[F.min(c).alias(c) for c in ("repo", "hash", "bytes", "kind", "reason")])


def found_files(seen: DataFrame) -> DataFrame:
    """The judged files of :func:`not_by_hand` joined with the shared subtrees: (path, repo, kind, reason)."""
    copies = shared_files(seen.select("repo", "path", "hash", "bytes")).withColumn("shared", F.lit(True))
    both = seen.join(copies, "path", "left").where("kind is not null or shared")
    return both.select("path", "repo", F.coalesce("kind", F.lit("vendored")).alias("kind"), F.coalesce("reason", F.lit("shared tree")).alias("reason"))
