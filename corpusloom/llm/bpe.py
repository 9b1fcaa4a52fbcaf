"""Byte-level BPE as a finite-state transducer that is determinised while it runs.

Merges of a BPE vocabulary are compiled into two tables: the tokens by their bytes, and, filled on demand, the pairs of
tokens that may stand side by side (the encoding of their joined bytes is that pair). The encoding of every prefix of a
text ends in one token, which these tables give from the prefixes before. A state of the transducer is therefore the
string of bytes whose tokens may still change, and a step reads one byte. A boundary between tokens is final as soon as
the encodings of the last ``longest token`` prefixes all pass through it, as each later one must pass through one of
them: the tokens before it are emitted and the state forgets them, so that lookahead is bounded.

States and steps come into being when a text first needs them and are kept up to a number, then dropped and built anew.
Paths through the transducer from the start of a piece of text (a match of the vocabulary's splitting pattern) to its
end are kept whole in the same way.
"""

from __future__ import annotations

import base64
import os
import re
import sys
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the public pattern that splits a text before the merges of this vocabulary are applied.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZER_DIR = "/opt/tokenizers"
RANK_FILE = "byte_bpe_50k.tiktoken"
#: Bounds of what a process keeps; beyond them states or paths are dropped and built anew.
MAX_STATES, MAX_PATHS, MAX_PATH_BYTES = 200_000, 400_000, 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Tokens and their ids, which are also the ranks of merges, from the lines ``base64 id`` of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def _run_of(name: str) -> str:
    """A run of characters of a Unicode property for the standard library's ``re``, whose classes are fast up to U+FFFF only."""
    runs = regex.findall(rf"[{name}]+", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)])))
    high = regex.findall(rf"[{name}]+", "".join(map(chr, range(0x10000, sys.maxunicode + 1))))
    classes = ["".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for r in part) for part in (runs, high)]
    return "(?:" + "|".join(f"[{c}]++" for c in classes if c) + ")++"


def split_pattern() -> re.Pattern:
    """SPLIT_PATTERN for ``re``. Runs of ASCII that nothing else continues come first, as they are found fastest."""
    letters, numbers, blanks, others = (_run_of(c) for c in (r"\p{L}", r"\p{N}", r"\s", r"^\s\p{L}\p{N}"))
    alone = r"(?![^\x00-\x7f])"
    blank = regex.sub(r"\+\+", "", blanks)
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]++{alone}| ?[0-9]++{alone}| ?[!-/:-@\[-`{{-~]++(?![\x00-\x08\x0e-\x1f\x7f-\U0010ffff])"
        rf"| ?{letters}| ?{numbers}| ?{others}|{blank}+(?!(?!{blank})[\s\S])|{blanks}"
    )


class _Paths(dict):
    """Piece of text to the bytes of its ids; a piece not met before goes through the transducer."""

    def __init__(self, path):
        self.path = path

    def __missing__(self, piece: str) -> bytes:
        return self.path(piece)


class _State:
    """Bytes not yet emitted; ends[i]: length of the last token of the encoding of the first i bytes."""

    __slots__ = ("pending", "ends", "steps")

    def __init__(self, pending: bytes, ends: list[int]):
        self.pending, self.ends, self.steps = pending, ends, {}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pieces = split_pattern().findall
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._paths = _Paths(self._path)
        self._start = _State(b"", [0])
        self._states: dict[bytes, _State] = {b"": self._start}

    def _merged(self, data: bytes) -> list[bytes]:
        """The encoding by definition: merge the pair of lowest rank, leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _may_follow(self, left: bytes, right: bytes) -> bool:
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > 4 * MAX_PATHS:
                self._pairs.clear()
            known = self._pairs[left, right] = self._merged(left + right) == ([left, right] if left else [right])
        return known

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        """The next state, and the ids that are final now."""
        pending = state.pending + bytes((byte,))
        n, ends, ranks = len(pending), state.ends, self.ranks
        for size in range(min(n, self.longest), 0, -1):
            token = pending[n - size :]
            if token in ranks:
                at = n - size
                if self._may_follow(pending[at - ends[at] : at], token):
                    break
        else:
            raise ValueError("the vocabulary lacks a byte")
        ends = ends + [size]
        emitted: tuple[int, ...] = ()
        if n >= 3 * self.longest:
            cut = self._final(ends, n)
            if cut:
                emitted = self._walk(pending, ends, cut)
                pending, ends = pending[cut:], [0] + ends[cut + 1 :]
        known = self._states.get(pending)
        if known is None:
            if len(self._states) > MAX_STATES:
                self._states = {b"": self._start}
                self._start.steps.clear()
            known = _State(pending, ends)
            if n <= MAX_PATH_BYTES:
                self._states[pending] = known
        if n <= MAX_PATH_BYTES:
            state.steps[byte] = known, emitted
        return known, emitted

    def _final(self, ends: list[int], n: int) -> int:
        """The last boundary that the encodings of all of the last ``longest`` prefixes share."""
        heads = set(range(n - self.longest + 1, n + 1))
        while len(heads) > 1:
            top = max(heads)
            heads.discard(top)
            heads.add(top - ends[top])
        return heads.pop()

    def _walk(self, pending: bytes, ends: list[int], at: int) -> tuple[int, ...]:
        out = []
        while at:
            out.append(self.ranks[pending[at - ends[at] : at]])
            at -= ends[at]
        return tuple(reversed(out))

    def encode_bytes(self, data: bytes) -> array:
        out, state = array("i"), self._start
        for byte in data:
            state, emitted = state.steps.get(byte) or self._step(state, byte)
            if emitted:
                out.extend(emitted)
        out.extend(self._walk(state.pending, state.ends, len(state.pending)))
        return out

    def _path(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        known = self.ranks.get(data)
        ids = (array("i", (known,)) if known is not None else self.encode_bytes(data)).tobytes()
        if len(data) <= MAX_PATH_BYTES:
            if len(self._paths) > MAX_PATHS:
                self._paths.clear()
            self._paths[piece] = ids
        return ids

    def encode_raw(self, text: str) -> bytes:
        """The ids of ``text`` as the bytes of 32-bit integers."""
        return b"".join(map(self._paths.__getitem__, self.pieces(text)))

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text`` without special tokens; an empty or null text has none."""
        return array("i", self.encode_raw(text)).tolist() if text else []

    def decode(self, ids: list[int]) -> str:
        decoder = Utf8Machine()
        return "".join([decoder.feed(self.tokens[i]) for i in ids]) + decoder.close()


def _utf8_steps() -> dict[str, dict[int, str]]:
    """Steps of the machine that accepts well-formed UTF-8: state to byte to state."""
    any_tail = range(0x80, 0xC0)
    steps: dict[str, dict[int, str]] = {"start": dict.fromkeys(range(0x80), "start"), "one": dict.fromkeys(any_tail, "start"), "two": dict.fromkeys(any_tail, "one"), "three": dict.fromkeys(any_tail, "two")}
    steps["start"] |= dict.fromkeys(range(0xC2, 0xE0), "one") | dict.fromkeys(range(0xE1, 0xF0), "two") | dict.fromkeys(range(0xF1, 0xF4), "three")
    steps["start"] |= {0xE0: "e0", 0xED: "ed", 0xF0: "f0", 0xF4: "f4"}
    steps["e0"], steps["ed"] = dict.fromkeys(range(0xA0, 0xC0), "one"), dict.fromkeys(range(0x80, 0xA0), "one")
    steps["f0"], steps["f4"] = dict.fromkeys(range(0x90, 0xC0), "two"), dict.fromkeys(range(0x80, 0x90), "two")
    return steps


class Utf8Machine:
    """Incremental UTF-8 decoding of tokens that may end within a character; bad bytes become U+FFFD."""

    STEPS = _utf8_steps()

    def __init__(self) -> None:
        self.state, self.held = "start", bytearray()

    def feed(self, data: bytes) -> str:
        out = []
        for byte in data:
            to = self.STEPS[self.state].get(byte)
            if to is None and self.held:
                out.append("�")
                self.state = "start"
                self.held.clear()
                to = self.STEPS["start"].get(byte)
            if to is None:
                out.append("�")
                continue
            self.state = to
            self.held.append(byte)
            if to == "start":
                out.append(self.held.decode())
                self.held.clear()
        return "".join(out)

    def close(self) -> str:
        left, self.state = bool(self.held), "start"
        self.held.clear()
        return "�" * left


_LOADED: dict[str, Transducer] = {}


def transducer(path: str | None = None) -> Transducer:
    """The transducer of a rank file, one a process."""
    path = path or os.path.join(TOKENIZER_DIR, RANK_FILE)
    if path not in _LOADED:
        with open(path, "rb") as f:
            _LOADED[path] = Transducer(read_ranks(f.read()))
    return _LOADED[path]


def _local_copy(path: str) -> str:
    """Where this process has the file that the driver sent along, or else the path itself."""
    sent = SparkFiles.get(os.path.basename(path))
    return sent if os.path.exists(sent) else path


def _encode_batches(batches: Iterator[pa.RecordBatch], path: str, lengths_only: bool) -> Iterator[pa.RecordBatch]:
    machine = transducer(_local_copy(path))
    for whole in batches:
        for k in range(0, whole.num_rows, 2000):
            batch = whole.slice(k, 2000)
            ids = [machine.encode_raw(text) if text else b"" for text in batch.column(1).to_pylist()]
            sizes = pa.array([len(x) // 4 for x in ids], pa.int32())
            if lengths_only:
                made = sizes
            else:
                joined = b"".join(ids)
                ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes)])
                made = pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), len(joined) // 4, [None, pa.py_buffer(joined)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["key", "made"])


def encode_texts(df: DataFrame, key: str, text: str, ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, ids): the ids of each text, one row for each row of ``df``, nothing shuffled.

    Text that looks like a special token is ordinary text. Null, like empty, gives an empty list.
    """
    return _mapped(df, key, text, T.ArrayType(T.IntegerType()), path, False).toDF(key, ids)


def token_counts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, n_tokens) for each row of ``df``; 0 for null."""
    return _mapped(df, key, text, T.IntegerType(), path, True).toDF(key, "n_tokens")


def _mapped(df: DataFrame, key: str, text: str, made: T.DataType, path: str | None, lengths_only: bool) -> DataFrame:
    """The rank file at ``path``, which only the driver must have, is sent along to the executors."""
    path = path or os.path.join(TOKENIZER_DIR, RANK_FILE)
    try:
        df.sparkSession.sparkContext.addFile(path)
    except Exception:  # another file of that name was sent before: executors read the path
        pass
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("made", made)])
    return df.select(key, text).mapInArrow(lambda batches: _encode_batches(batches, path, lengths_only), schema)
