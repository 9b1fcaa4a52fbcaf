"""Markdown pages to overlapping chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS, OVERLAP_CHARS, MIN_CHARS, MAX_CHUNKS = 2400, 200, 200, 512
SENTENCE_END = re.compile(r"[.!?][)\]\"'`]*\s+")


def options(max_chars: int | None = None, overlap: int | None = None, min_chars: int | None = None, max_chunks: int | None = None) -> tuple[int, int, int, int]:
    """Checked options, null being the default; a default minimum is lowered to the maximum."""
    most = MAX_CHARS if max_chars is None else int(max_chars)
    least = min(MIN_CHARS, most) if min_chars is None else int(min_chars)
    shared = OVERLAP_CHARS if overlap is None else int(overlap)
    cap = MAX_CHUNKS if max_chunks is None else int(max_chunks)
    for value, name in ((most, "maximum size"), (least, "minimum size"), (cap, "chunks per page")):
        if value <= 0:
            raise ValueError(f"the {name} must be a positive integer")
    if shared < 0 or shared >= most:
        raise ValueError("the overlap must be at least 0 and below the maximum size")
    if least > most:
        raise ValueError("the minimum size must not exceed the maximum size")
    return most, shared, least, cap


def cut_after(text: str, start: int, size: int) -> int:
    """Where a chunk from ``start`` ends: at the last strong boundary of its second half, or at its full size."""
    limit, half = min(len(text), start + size), start + size // 2
    sentence = max((start + m.end() for m in SENTENCE_END.finditer(text[start:limit])), default=-1)
    for at, end in ((text.rfind("\n\n", start, limit), 2), (text.rfind("\n#", start, limit), 0), (sentence, 0), (text.rfind("\n", start, limit), 1), (text.rfind(" ", start, limit), 1)):
        if at >= half:
            return at + end
    return limit


def split(markdown: str, max_chars: int | None = None, overlap: int | None = None, min_chars: int | None = None) -> list[str]:
    """Chunks of at most ``max_chars`` characters; short ones join their neighbours where there is room."""
    most, shared, least, _ = options(max_chars, overlap, min_chars)
    text = re.sub(r"\r\n?", "\n", markdown).strip()
    pieces, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        end = len(text) if len(text) - at <= most else cut_after(text, at, most)
        piece = text[at:end].strip()
        if piece:
            pieces.append(piece)
        if end == len(text):
            break
        back = max(at + 1, end - shared)
        at = back if shared and back > at else end
    joined: list[str] = []
    for piece in pieces:
        if joined and len(piece) < least and len(joined[-1]) + 2 + len(piece) <= most:
            joined[-1] += "\n\n" + piece
        else:
            joined.append(piece)
    if len(joined) > 1 and len(joined[0]) < least and len(joined[0]) + 2 + len(joined[1]) <= most:
        joined[:2] = [joined[0] + "\n\n" + joined[1]]
    return joined


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_udf(text: pd.Series, max_chars: pd.Series, overlap: pd.Series, min_chars: pd.Series) -> pd.Series:
    """:func:`split` of each row with its own options; null text gives null."""
    whole = lambda v: None if v is None or v != v else int(v)
    return pd.Series([None if t is None else split(t, whole(a), whole(b), whole(c)) for t, a, b, c in zip(text, max_chars, overlap, min_chars)], dtype=object)
