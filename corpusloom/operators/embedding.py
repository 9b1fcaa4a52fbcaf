"""Embedding texts with a caller's function, in batches, with checked answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (inputs, size, whether the size counts UTF-8 bytes) of one request in the code and in the documentation engine.
CODE_REQUEST, DOCS_REQUEST = (128, 262_144, False), (64, 262_144, True)


def request_ranges(texts: list[str], most_inputs: int, most_size: int, in_bytes: bool = False) -> list[tuple[int, int]]:
    """Ranges of texts for one request each, greedy and in order; a text that exceeds the size goes alone."""
    out, start, total = [], 0, 0
    for i, text in enumerate(texts):
        n = len(text.encode()) if in_bytes else len(text)
        if i > start and (i - start >= most_inputs or total + n > most_size):
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(texts):
        out.append((start, len(texts)))
    return out


def checked_vectors(answer: list[dict], count: int) -> list[list[float]]:
    """Vectors of an answer [{index, embedding}] in the order of the inputs.

    Raises unless there is one for each input, with its index once, all of the same length and of numbers only.
    """
    if not isinstance(answer, list) or len(answer) != count:
        raise ValueError(f"{count} vectors expected")
    out: list[list[float] | None] = [None] * count
    for item in answer:
        index, vector = item.get("index"), item.get("embedding")
        if not isinstance(index, int) or not 0 <= index < count or out[index] is not None:
            raise ValueError("indexes must be those of the inputs, each once")
        if not isinstance(vector, list) or not vector or not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in vector):
            raise ValueError("a vector must be a list of numbers")
        out[index] = [float(x) for x in vector]
    if len({len(v) for v in out if v is not None}) > 1:
        raise ValueError("vectors must have one length")
    return [v for v in out if v is not None]


def embedded(df: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], request: tuple[int, int, bool] = DOCS_REQUEST) -> DataFrame:
    """``df`` with ``vector``, ``dimensions`` and ``norm``: the answer of ``embedder`` for each text; null texts have nulls.

    Requests are as many at once as there are tasks. Order and rows stay as they are.
    """
    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + ", vector array<double>, dimensions int, norm double"

    def embed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            known = [i for i, t in enumerate(part[text]) if t is not None]
            texts = [part[text].iloc[i] for i in known]
            vectors: list[list[float]] = []
            for a, b in request_ranges(texts, *request):
                got = embedder(texts[a:b])
                vectors += checked_vectors([{"index": i, "embedding": list(v)} for i, v in enumerate(got)], b - a)
            by_row: list[list[float] | None] = [None] * len(part)
            for i, v in zip(known, vectors):
                by_row[i] = v
            part = part.copy()
            part["vector"] = by_row
            part["dimensions"] = pd.array([len(v) if v else None for v in by_row], dtype="Int32")
            part["norm"] = [sum(x * x for x in v) ** 0.5 if v else None for v in by_row]
            yield part

    return df.mapInPandas(embed, schema)


def refreshed(wanted: DataFrame, stored: DataFrame, keys: list[str], text: str, embedder: Callable, request: tuple[int, int, bool] = DOCS_REQUEST) -> DataFrame:
    """The vectors after a refresh: those stored for the same keys stay, only the rest is embedded, others are dropped."""
    kept = stored.join(wanted.select(*keys).distinct(), keys, "left_semi")
    new = embedded(wanted.join(stored.select(*keys).distinct(), keys, "left_anti"), text, embedder, request)
    return kept.unionByName(new.select(*kept.columns))


def same_dimensions(df: DataFrame, dimensions: str = "dimensions") -> int | None:
    """The one number of dimensions of a table's vectors; raises if there are several, None without vectors."""
    low, high = df.where(F.col(dimensions).isNotNull()).agg(F.min(dimensions), F.max(dimensions)).first()
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} dimensions in one index")
    return low
