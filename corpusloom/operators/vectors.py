"""Vectors: norms, the two cosines, top-k for a query, and all pairs above a threshold by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of a cell in the search for pairs; most cells (their centroids are sent to all tasks), and sample rows for each.
BLOCK_ROWS, MAX_CELLS, SAMPLE_PER_CELL = 4096, 4096, 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """The Euclidean length in double precision."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_or_null(a: Column, b: Column) -> Column:
    """The cosine; null for null or empty vectors, other lengths, no length or one that is no number: such rows drop out of code search."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (lengths > 0) & ~F.isnan(lengths) & (lengths < float("inf")), dot(a, b) / lengths)


def cosine_or_zero(a: Column, b: Column) -> Column:
    """The cosine; 0 where :func:`cosine_or_null` has none: such rows stay in documentation search."""
    return F.coalesce(cosine_or_null(a, b), F.lit(0.0))


def usable(df: DataFrame, owner: str, vector: str, order: str, model: str | None = None, dims: int | None = None) -> DataFrame:
    """(owner, vector): of each owner the first vector, by ``order``, of ``model`` (null: of any) that can be compared.

    Such a vector has ``dims`` entries (null: any number), all of them finite numbers and not all 0.
    """
    v = F.col(vector)
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    if dims is not None:
        sound = (F.size(v) == dims) & sound
    if model is not None:
        sound = (F.col("model") == model) & sound
    return df.where(F.col(owner).isNotNull() & sound).groupBy(owner).agg(F.min_by(vector, order).alias(vector))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top_k(df: DataFrame, key: str, vector: str, query: list[float], k: int, scope: Column | None = None, keep_invalid: bool = False) -> DataFrame:
    """(key, cosine) of the ``k`` rows most similar to ``query``, ties by key; the scope is applied before, so that k rows are found in it."""
    rows = df if scope is None else df.where(scope)
    score = (cosine_or_zero if keep_invalid else cosine_or_null)(F.col(vector), literal(query))
    return rows.select(key, score.alias("cosine")).where("cosine is not null").orderBy(F.round("cosine", 9).desc(), key).limit(k)


def semantic_fetch(limit: int, required: int = 0) -> int:
    return max(50, min(5000, 50 * limit + required))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([np.zeros(0, np.int64)] + [(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)])


def _centres(sample: np.ndarray, cells: int, rounds: int = 6) -> np.ndarray:
    """Centroids of ``sample`` by k-means."""
    centres = sample[np.random.default_rng(5).choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        home = _nearest(sample, centres)
        held = np.bincount(home, minlength=len(centres))[:, None]
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        centres = np.where(held > 0, sums / np.maximum(held, 1), centres)
    return centres


def _units(keys: pa.Array, lists: pa.ListArray) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
    """(keys, unit vectors, length) for each length of vectors among the rows; those that can't be compared are left out."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    for size in np.unique(sizes[sizes > 0]):
        at = pa.array(np.flatnonzero(sizes == size))
        x = np.asarray(pc.list_flatten(lists.take(at)), dtype=np.float64).reshape(-1, size)
        with np.errstate(over="ignore", invalid="ignore"):
            length = np.sqrt((x * x).sum(axis=1))
        good = np.isfinite(length) & (length > 0)
        yield keys.take(at).filter(pa.array(good)), x[good] / length[good][:, None], int(size)


def _rows(raw: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), np.float64).reshape(-1, size)


def _raw(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def near_pairs(home: DataFrame, key: str, vector: str, threshold: float, visitors: DataFrame | None = None, cell_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, cosine) of all pairs with a cosine of at least ``threshold``, exact: within ``home``, the smaller key first, or
    of each of ``visitors`` (a) with each of ``home`` (b).

    Rows live in the cell of their nearest centroid, which come from a bounded sample, and cells are cut into blocks. Two
    unit vectors at most r apart lie at most r from the plane that parts their cells, so a row visits just those cells
    whose plane is no further; within ``home`` only cells before its own, and blocks before its own. Each block is held
    by one task, its visitors stream by. Low thresholds make every row visit every block, which is all pairs.

    Null, empty and zero vectors, and those with an entry that is no number, have no pairs; only vectors of one length
    are compared. Rows that repeat a key count once. Empty tables give no rows.
    """
    spark, kind = home.sparkSession, dict(home.dtypes)[key]

    def one(df: DataFrame) -> DataFrame:
        return df.where(F.col(key).isNotNull() & (F.size(vector) > 0)).groupBy(F.col(key).alias("key")).agg(F.min(F.col(vector).cast("array<double>")).alias("v"))

    rows = materialize(one(home), "vectors")
    n = rows.count()
    cells = int(min(MAX_CELLS, n // cell_rows))
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    dims, centres = 0, np.zeros((0, 0))
    if cells > 1:
        share = min(1.0, 2.0 * SAMPLE_PER_CELL * cells / n)
        picked = rows.sample(share, 5).limit(4 * SAMPLE_PER_CELL * cells).select("key", "v").toArrow()  # a bounded sample
        found = sorted(_units(picked["key"].combine_chunks(), picked["v"].combine_chunks()), key=lambda f: len(f[1])) if picked.num_rows else []
        if found:
            dims, centres = found[-1][2], _centres(found[-1][1], cells)

    def placing(visiting: bool, only_before: bool):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            squares = (centres * centres).sum(axis=1)
            for batch in batches:
                for keys, x, size in _units(batch.column(0), batch.column(1)):
                    cell = _nearest(x, centres) if size == dims else np.full(len(x), -size)
                    who, where = np.arange(len(x)), cell
                    if visiting and size == dims:
                        near = [np.zeros((0, 2), np.int64)]
                        for lo in range(0, len(x), 1024):
                            d = squares - 2 * (x[lo : lo + 1024] @ centres.T)
                            own = cell[lo : lo + 1024]
                            gap = np.sqrt(np.maximum(1e-12, squares[own][:, None] + squares[None] - 2 * (centres[own] @ centres.T)))
                            plane = (d - d[np.arange(len(own)), own][:, None]) / (2 * gap)
                            ok = plane <= radius
                            ok[np.arange(len(own)), own] = False
                            if only_before:
                                ok &= np.arange(len(centres))[None] < own[:, None]
                            near.append(np.argwhere(ok) + [lo, 0])
                        near = np.concatenate(near)
                        who, where = np.r_[who, near[:, 0]], np.r_[cell, near[:, 1]]
                    if len(who):
                        raw = _raw(x)
                        at = pa.array(who)
                        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(cell[who], pa.int32()), keys.take(at), raw.take(at)], ["cell", "own", "key", "raw"])

        return place

    def placed(df: DataFrame, visiting: bool, only_before: bool) -> DataFrame:
        return df.select("key", "v").mapInArrow(placing(visiting, only_before), f"cell int, own int, key {kind}, raw binary")

    living = placed(rows, False, False).drop("own")
    # a row for each cell, and for each length that isn't the usual one
    sizes = materialize(living.groupBy("cell").count().select("cell", F.ceil(F.col("count") / (2 * cell_rows)).cast("int").alias("parts")), "cells")
    sizes = F.broadcast(sizes)
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    held = living.join(sizes, "cell").select("cell", part.alias("part"), F.lit(0).alias("role"), "key", "raw")
    guests = placed(rows if visitors is None else one(visitors), True, visitors is None).join(sizes, "cell")
    stops = F.sequence(F.lit(0), F.col("parts") - 1)
    if visitors is None:
        stops = F.when(F.col("cell") != F.col("own"), stops).otherwise(F.filter(stops, lambda k: k < part))
    calls = guests.select("cell", F.explode(stops).alias("part"), F.lit(1).alias("role"), "key", "raw")
    within = visitors is None

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, raws, x = None, [], [], None

        def pairs(ka: np.ndarray, kb: np.ndarray, scores: np.ndarray, ok: np.ndarray) -> pa.RecordBatch:
            p, q = np.nonzero(ok)
            a, b = ka[p], kb[q]
            if within:
                swap = a > b
                a, b = np.where(swap, b, a), np.where(swap, a, b)
            return pa.RecordBatch.from_pandas(pd.DataFrame({"a": a, "b": b, "cosine": scores[p, q]}), schema=result, preserve_index=False)

        def settle() -> Iterator[pa.RecordBatch]:
            """The rows of the block are all there."""
            nonlocal keys, x
            if x is None:
                keys = np.array(keys, object)
                x = np.frombuffer(b"".join(raws), np.float64).reshape(len(keys), -1) if len(keys) else np.zeros((0, 0))
                for lo in range(0, len(keys) if within else 0, 1024):
                    scores = x[lo : lo + 1024] @ x.T
                    later = np.arange(lo, min(lo + 1024, len(keys)))[:, None] < np.arange(len(keys))[None]
                    yield pairs(keys[lo : lo + 1024], keys, scores, later & (scores >= threshold))

        for batch in batches:
            cell, part_, role = (batch.column(k).to_numpy() for k in range(3))
            if not len(cell):
                continue
            cuts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part_[1:] != part_[:-1]) | (role[1:] != role[:-1]), True])
            for lo, hi in zip(cuts, cuts[1:]):
                if (cell[lo], part_[lo]) != at:
                    if at is not None:
                        yield from settle()
                    at, keys, raws, x = (cell[lo], part_[lo]), [], [], None
                some, raw = batch.column(3).slice(lo, hi - lo).to_pylist(), batch.column(4).slice(lo, hi - lo)
                if role[lo] == 0:
                    keys += some
                    raws += raw.to_pylist()
                    continue
                yield from settle()
                if len(keys):
                    some = np.array(some, object)
                    guests_ = _rows(raw, x.shape[1])
                    for k in range(0, len(some), 1024):
                        scores = guests_[k : k + 1024] @ x.T
                        yield pairs(some[k : k + 1024], keys, scores, scores >= threshold)
        if at is not None:
            yield from settle()

    result = pa.schema([("a", _arrow(kind)), ("b", _arrow(kind)), ("cosine", pa.float64())])
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // cell_rows))
    met = held.unionByName(calls).repartition(tasks, "cell", "part").sortWithinPartitions("cell", "part", "role")
    return met.mapInArrow(compare, f"a {kind}, b {kind}, cosine double")


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]


def pairs_above(df: DataFrame, key: str, vector: str, threshold: float, cell_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, cosine) of all pairs of keys, the smaller first, with a cosine of at least ``threshold``. See :func:`near_pairs`."""
    return near_pairs(df, key, vector, threshold, None, cell_rows)
