"""Cutting texts that exceed a limit into overlapping pieces at natural boundaries, by balanced targets.

A text of n characters needs at least ``ceil((n - overlap) / (limit - overlap))`` pieces. That many equally long
targets are laid over it, and each cut moves to the strongest boundary near its target: the end of a block before that
of a line, of a sentence, of a word. Cuts stay where this and all later pieces keep within the limit. If a cut finds no
boundary there, up to MORE pieces are added and the targets are laid anew; if some cut still falls within a word, the
plan with the fewest such cuts is taken, and among those the one with the fewest pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

DEFAULTS = {"max_chunk_chars": 2400, "overlap_chars": 200, "min_chunk_chars": 200, "max_chunks_per_page": 512}
#: Pieces that are added at most to find boundaries for all cuts.
MORE = 3
#: Boundaries, strongest first; a cut comes after the match.
BOUNDARIES = [re.compile(p) for p in (r"\n{2,}(?=#{1,6} )", r"\n{2,}", r"\n", r"[.!?;:…。！？]['\")\]]*\s+|[。！？]", r"\s+")]


def normalized(body: Column) -> Column:
    """CRLF and CR turned into LF, outer white space removed; null as empty text."""
    return text.normalize(F.coalesce(body, F.lit("")))


def cut_points(body: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``body``, each of at most ``limit`` characters, in order and without gaps.

    Neighbours share ``overlap`` characters.
    """
    n = len(body)
    if n <= limit:
        return [(0, n)]
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    marks: list[list[int]] = []
    for k, boundary in enumerate(BOUNDARIES):
        marks.append([m.end() for m in boundary.finditer(body)])
    least = -(-(n - overlap) // (limit - overlap))
    best: tuple[int, list[int]] | None = None
    for pieces in range(least, least + MORE + 1):
        found = _laid(marks, n, pieces, limit - overlap, overlap)
        if best is None or found[0] < best[0]:
            best = found
        if not best[0]:
            break
    cuts = best[1]
    return list(zip([0, *(end - overlap for end in cuts)], [*cuts, n]))


def _laid(marks: list[list[int]], n: int, pieces: int, stride: int, overlap: int) -> tuple[int, list[int]]:
    """Cuts for that many pieces, each of which adds at most ``stride`` characters, and how many of the cuts are at no boundary."""
    hard, cuts, last = 0, [], overlap
    new = (n - overlap) / pieces
    near = max(1, int(new) // 2)
    for i in range(1, pieces):
        target = int(overlap + new * i)
        low = max(last + 1, n - (pieces - i) * stride)
        high = max(low, min(n - 1, last + stride))
        at = _strongest(marks, max(low, target - near), min(high, target + near), target)
        if at is None:
            hard += 1
            at = min(max(target, low), high)
        cuts.append(at)
        last = at
    return hard, cuts


def _strongest(marks: list[list[int]], low: int, high: int, target: int) -> int | None:
    for ends in marks:
        i, j = bisect_left(ends, low), bisect_right(ends, high)
        if i < j:
            k = bisect_left(ends, target, i, j)
            return min(ends[max(i, k - 1) : min(j, k + 1)], key=lambda e: (abs(e - target), e))
    return None


def split_chunks(chunks: DataFrame, config: DataFrame) -> DataFrame:
    """(chunk_id, docset_slug, page_id, ordinal, max_chunks_per_page, n_chars, oversized, piece, n_pieces, start, text).

    ``chunks`` has id, docset_slug, page_id, ordinal, text; ``config`` one row a docset. Texts are normalised first. A
    chunk within its limit is one piece; an empty or null text is one empty piece. Docsets without a row, and nulls,
    have the defaults. Repeated rows of an id count once, rows without an id not at all.
    """
    limits = config.groupBy("docset_slug").agg(*[F.greatest(F.coalesce(F.max(c), F.lit(d)), F.lit(1 if c.startswith("max") else 0)).alias(c) for c, d in DEFAULTS.items()])
    one = F.min(F.struct(F.coalesce("ordinal", F.lit(0)).alias("first"), "text", "docset_slug", "page_id", "ordinal"))
    rows = chunks.where("id is not null").groupBy("id").agg(one.alias("s")).select("id", "s.docset_slug", "s.page_id", "s.ordinal", "s.text")
    rows = rows.join(limits, "docset_slug", "left").fillna(DEFAULTS)
    rows = rows.withColumn("body", normalized(F.col("text"))).drop("text").withColumn("n_chars", F.char_length("body"))
    out = "id long, docset_slug string, page_id string, ordinal int, max_chunks_per_page int, n_chars int, oversized boolean, piece int, n_pieces int, start int, text string"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for r in b.itertuples(index=False):
                spans = cut_points(r.body, r.max_chunk_chars, r.overlap_chars)
                for k, (start, end) in enumerate(spans):
                    made.append((r.id, r.docset_slug, r.page_id, r.ordinal, r.max_chunks_per_page, r.n_chars, r.n_chars > r.max_chunk_chars, k, len(spans), start, r.body[start:end]))
            yield pd.DataFrame(made, columns=[c.split()[0] for c in out.split(", ")])

    return rows.mapInPandas(cut, out).withColumnRenamed("id", "chunk_id")


def cap_pages(pieces: DataFrame, most: int) -> DataFrame:
    """Of each page the first ``max_chunks_per_page`` pieces, in the order of chunks, numbered by ``page_piece`` from 1.

    ``most`` is the largest cap that occurs; ranking stops there within each task, before pages are brought together.
    """
    place = pieces.withColumn("page_piece", F.expr("row_number() over (partition by docset_slug, page_id order by ordinal nulls last, chunk_id, piece)"))
    kept = place.where(F.col("page_piece") <= most).where(F.col("page_piece") <= F.col("max_chunks_per_page"))
    return kept.drop("ordinal", "max_chunks_per_page")


def largest_cap(config: DataFrame) -> int:
    return max([DEFAULTS["max_chunks_per_page"], *[r[0] or 0 for r in config.agg(F.max("max_chunks_per_page")).collect()]])
