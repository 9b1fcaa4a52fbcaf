"""The most similar vectors of every vector: inverted lists scanned by adaptive sampling of dimensions.

Vectors are scaled to length 1 and rotated at random, so that any leading block of columns is a sample of the
distance. Coarse cells come from k-means over a bounded sample; within a cell, lists of about ``LIST_ROWS`` vectors are
made by k-means again. A query first scans its own list, which gives a radius, then every list of the cell whose
bisecting plane is nearer than ``REACH`` radii, and last, in a second pass, other cells by the same rule. Within a list
distances grow by blocks of columns; after each block a candidate is abandoned as soon as its partial distance rules it
out, by a test of the hypothesis that the whole distance lies within the radius. Where the first block rules out too
little, all columns are compared at once. Those that remain are compared in double precision.

Vectors without others near them would visit nearly all cells. They meet the leaders of all lists instead, which are rows
that cover the others of their list: first for a radius over all cells, then for the parts in which something lies within.

Identical vectors form one class that is searched once, so that any number of copies costs one search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_materialized, materialize

#: Members of a coarse cell and of a list, on average; rows above which a cell is divided.
CELL_ROWS, LIST_ROWS, PART_ROWS = 4096, 160, 20_000
#: Most coarse cells before any is divided (4 MB of centroids are broadcast), and sample rows for each cell.
MAX_CELLS, SAMPLE_PER_CELL, MIN_SAMPLE = 16_384, 24, 4_096
#: Times that cells are divided, and most cells after that.
DIVISIONS, MOST_CELLS = 4, 65_536
#: Copies of a vector are many above this number and this share of all vectors, so that there are few such classes.
MANY_COPIES, MANY_SHARE = 100_000, 0.001
#: Share of the radius within which a bisecting plane lets a list be probed; 1 would be exact.
REACH = 0.45
#: Column blocks, and the tolerance of the test (larger abandons later); share of a block above which no others are gathered.
BLOCKS, EPSILON, DENSE = (16, 32, 64), 2.1, 0.05
#: Parts of other cells that a row visits without regard to leaders, and the distance that a leader covers.
MANY_VISITS, COVER = 16, 0.3
#: Leaders, and rows that meet them, of one task; pairs for which more tasks are made.
TILE_LEADERS, TILE_ROWS, TILE_PAIRS = 131_072, 131_072, 400_000_000
#: Cosines that differ by less are equal.
TIE = 1e-9


def usable_vectors(df: DataFrame, key: str, vector: str, dims: int = 64) -> DataFrame:
    """(key, raw): each usable vector, with exactly ``dims`` numbers, all finite and not all 0, as bytes of its own type.

    Rows with a null key take no part; a repeated key stands for one row, see :func:`distinct_vectors`.
    """
    kind = np.float32 if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else np.float64
    width = dims * np.dtype(kind).itemsize

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            right = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False)) & np.asarray(batch.column(0).is_valid())
            rows = batch.filter(pa.array(right))
            flat = pc.list_flatten(rows.column(1)).to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dims)
            good = np.isfinite(flat).all(axis=1) & (flat != 0).any(axis=1)
            flat = np.ascontiguousarray(flat[good])
            raw = pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(np.arange(0, (len(flat) + 1) * width, width, dtype=np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([rows.column(0).filter(pa.array(good)), raw], ["key", "raw"])

    return df.select(F.col(key).cast("long"), vector).mapInArrow(clean, "key long, raw binary")


def distinct_vectors(vectors: DataFrame, with_raw: bool) -> DataFrame:
    """One row a key, with the 128-bit hash (h1, h2) of its vector; of different vectors of a key that of the least hash."""
    hashed = vectors.withColumn("h", F.struct(F.xxhash64("raw").alias("h1"), F.xxhash64("raw", F.lit(1)).alias("h2")))
    out = hashed.groupBy("key").agg(F.min("h").alias("h"), *([F.min_by("raw", "h").alias("raw")] if with_raw else []))
    return out.select("key", "h.h1", "h.h2", *(["raw"] if with_raw else []))


def _unit(raw, dims: int) -> np.ndarray:
    data = b"".join(raw)
    kind = np.float32 if len(raw) and len(data) == 4 * dims * len(raw) else np.float64
    x = np.frombuffer(data, kind).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        a = _nearest(x, c)
        order = np.argsort(a, kind="stable")
        heads = np.searchsorted(a[order], np.arange(k))
        sums = np.add.reduceat(x[order], np.minimum(heads, len(x) - 1), axis=0)
        held = np.bincount(a, minlength=k)
        c = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], c).astype(x.dtype)
    return c


def _coarse(sample: np.ndarray, k: int) -> np.ndarray:
    """About k centroids of ``sample`` in two levels, so that the work grows with k's square root."""
    if k <= 512:
        return _kmeans(sample, min(k, len(sample)), 8)
    first = _kmeans(sample, int(k**0.5), 8)
    home = _nearest(sample, first)
    out = []
    for j in range(len(first)):
        mine = sample[home == j]
        if len(mine):
            out.append(_kmeans(mine, int(min(len(mine), max(1, round(k * len(mine) / len(sample))))), 8))
    return np.concatenate(out)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(axis=1)
    return np.concatenate([np.zeros(0, int)] + [(x[i : i + 4096] @ c.T - half).argmax(axis=1) for i in range(0, len(x), 4096)])


def _planes(x: np.ndarray, home: np.ndarray, c: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Distance of each x from the plane between its own centroid and each other one; infinite for its own."""
    d = (c * c).sum(axis=1) - 2 * (x @ c.T)
    out = (d - d[np.arange(len(x)), home][:, None]) / (2 * gaps[home])
    out[np.arange(len(x)), home] = np.inf
    return out


def _gaps(c: np.ndarray) -> np.ndarray:
    sq = (c * c).sum(axis=1)
    return np.sqrt(np.maximum(1e-12, sq[:, None] + sq[None] - 2 * c @ c.T))


class Scanner:
    """The lists of one cell part, and searches over them. ``x``: rotated unit vectors, ``ids`` theirs."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int):
        self.x, self.ids, self.k = x, ids, k
        self.f = x.astype(np.float32)
        lists = max(1, len(x) // LIST_ROWS)
        self.c = _kmeans(self.f, lists, 4) if lists > 1 else self.f.mean(axis=0, keepdims=True)
        self.gaps = _gaps(self.c)
        self.home = _nearest(self.f, self.c)
        order = np.argsort(self.home, kind="stable")
        cuts = np.searchsorted(self.home[order], np.arange(lists + 1))
        self.members = [order[cuts[j] : cuts[j + 1]] for j in range(lists)]

    def search(self, q: np.ndarray, q_ids: np.ndarray, radius: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, member row, cosine) of candidates, of which the best k of each query are among them."""
        f = q.astype(np.float32)
        home = _nearest(f, self.c)
        first = radius is None
        limit = np.full(len(q), 4.0, np.float32) if first else np.square(radius.astype(np.float32))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(len(self.members) + 1))
        for j, members in enumerate(self.members):  # own lists
            rows = order[cuts[j] : cuts[j + 1]]
            if len(rows) and len(members):
                self._list(f, q_ids, rows, members, limit, found, first)
        if len(self.members) > 1:
            for lo in range(0, len(q), 4096):
                part = np.arange(lo, min(lo + 4096, len(q)))
                near = _planes(f[part], home[part], self.c, self.gaps) < REACH * np.sqrt(limit[part])[:, None]
                for j in np.flatnonzero(near.any(axis=0)):
                    rows = part[near[:, j]]
                    if len(self.members[j]):
                        self._list(f, q_ids, rows, self.members[j], limit, found, False)
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0)
        qi, mi = (np.concatenate(t) for t in zip(*found))
        keep = q_ids[qi] != self.ids[mi]
        qi, mi = qi[keep], mi[keep]
        cos = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", q[qi[i : i + 65536]], self.x[mi[i : i + 65536]]) for i in range(0, len(qi), 65536)])
        return qi, mi, cos

    def _list(self, f: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, members: np.ndarray, limit: np.ndarray, found: list, whole: bool) -> None:
        for lo in range(0, len(rows), 2048):
            r = rows[lo : lo + 2048]
            if whole:  # no radius yet: all columns of the list at once, the k-th distance becomes the radius
                d = 2 - 2 * (f[r] @ self.f[members].T)
                d[q_ids[r][:, None] == self.ids[members][None]] = 8
                if d.shape[1] > self.k:
                    limit[r] = np.minimum(limit[r], np.maximum(np.partition(d, self.k - 1, axis=1)[:, self.k - 1], 0) + 4e-6)
                a, b = np.nonzero(d <= limit[r][:, None])
                found.append((r[a], members[b]))
                continue
            bound = limit[r]
            start = BLOCKS[0]
            dims = f.shape[1]
            qb, xb = f[r][:, :start], self.f[members][:, :start]
            part = (qb * qb).sum(axis=1)[:, None] + (xb * xb).sum(axis=1)[None] - 2 * (qb @ xb.T)
            near = part <= (bound * (start / dims) * (1 + EPSILON / start**0.5) ** 2)[:, None]
            if np.count_nonzero(near) > DENSE * near.size:
                whole_d = 2 - 2 * (f[r] @ self.f[members].T)
                a, b = np.nonzero(whole_d <= bound[:, None] + 4e-6)
                d, start = whole_d[a, b], dims
            else:
                a, b = np.nonzero(near)
                d = part[a, b]
            for end in BLOCKS[1:]:
                if not len(a) or start == dims:
                    break
                gap = f[r[a], start:end] - self.f[members[b], start:end]
                d = d + np.einsum("ij,ij->i", gap, gap)
                ok = d <= bound[a] * (end / dims) * (1 + EPSILON / end**0.5) ** 2 if end < dims else d <= bound[a] + 4e-6
                a, b, d, start = a[ok], b[ok], d[ok], end
            if len(a):
                found.append((r[a], members[b]))
                self._tighten(limit, r[a], d)

    def leaders(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, reach, held): members that each cover others of their list, how far and how many with themselves. Each row is covered once."""
        rows, reach, held = [], [], []
        for left in self.members:
            while len(left):
                d = np.maximum(0, 2 - 2 * (self.f[left[1:]] @ self.f[left[0]]))
                covered = d <= COVER * COVER
                rows.append(left[0])
                reach.append((float(d[covered].max()) + 4e-6) ** 0.5 if covered.any() else 0.0)
                held.append(1 + np.count_nonzero(covered))
                left = left[1:][~covered]
        return np.array(rows, np.int64), np.array(reach, float), np.array(held, np.int64)

    def _tighten(self, limit: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
        order = np.lexsort((d, rows))
        rows, d = rows[order], d[order]
        heads = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        sizes = np.diff(np.r_[heads, len(rows)])
        full = sizes >= self.k
        at = heads[full] + self.k - 1
        limit[rows[at]] = np.minimum(limit[rows[at]], np.maximum(d[at], 0) + 4e-6)


def _tiles(q: np.ndarray, leaders: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first q, first leader, products) by blocks that stay in the cache; all blocks of some q follow each other."""
    for i in range(0, len(q), 256):
        for j in range(0, len(leaders), 4096):
            yield i, j, q[i : i + 256] @ leaders[j : j + 4096].T


def highest(q: np.ndarray, leaders: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest cosines of each q with ``leaders``, and the leaders; -1 and ``least`` stand for what is lower."""
    top, at = np.repeat(least.astype(np.float32)[:, None], k, axis=1), np.full((len(q), k), -1)
    for i, j, cos in _tiles(q, leaders):
        above = cos > top[i : i + 256].min(axis=1)[:, None]
        held = np.count_nonzero(above, axis=1)
        for few in (True, False):  # rows with few candidates are packed, so that only those are compared
            rows = np.flatnonzero((held > 0) & ((held <= DENSE * cos.shape[1]) == few))
            if not len(rows):
                continue
            if few:
                a, b = np.nonzero(above[rows])
                place = np.arange(len(a)) - np.repeat(np.cumsum(held[rows]) - held[rows], held[rows])
                found, of = np.full((len(rows), held[rows].max()), -9, np.float32), np.full((len(rows), held[rows].max()), -1)
                found[a, place], of[a, place] = cos[rows[a], b], b + j
            else:
                found, of = cos[rows], np.broadcast_to(np.arange(j, j + cos.shape[1]), (len(rows), cos.shape[1]))
            both = np.concatenate([top[i + rows], found], axis=1)
            kept = np.argpartition(-both, k - 1, axis=1)[:, :k]
            top[i + rows] = np.take_along_axis(both, kept, axis=1)
            at[i + rows] = np.take_along_axis(np.concatenate([at[i + rows], of], axis=1), kept, axis=1)
    return top, at


def ranked_bounds(radius: np.ndarray, cos: np.ndarray, at: np.ndarray, reach: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
    """For each row k distances upwards: within the i-th there are i rows, with itself, by ``radius`` and by its leaders ``at``."""
    far = np.where(at >= 0, np.sqrt(np.maximum(0, 2 - 2 * cos.astype(np.float64)) + 4e-6) + reach[at], np.inf)
    far, count = np.c_[far, radius], np.c_[np.where(at >= 0, held[at], 0), np.full(len(radius), k)]
    order = np.argsort(far, axis=1, kind="stable")
    far, total = np.take_along_axis(far, order, axis=1), np.cumsum(np.take_along_axis(count, order, axis=1), axis=1)
    return np.stack([far[np.arange(len(far)), (total >= i).argmax(axis=1)] for i in range(1, k + 1)], axis=1)


def reached(q: np.ndarray, radius: np.ndarray, leaders: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(q row, leader row) where a leader is within the radius and ``REACH`` of what it covers."""
    slack = REACH * reach
    # |q - l| <= r + s as a product: q l + r s + s s / 2 >= 1 - r r / 2
    f = np.concatenate([q, radius[:, None], np.ones((len(q), 1))], axis=1).astype(np.float32)
    g = np.concatenate([leaders, slack[:, None], (0.5 * slack * slack)[:, None]], axis=1).astype(np.float32)
    enough = (1 - 0.5 * radius * radius - 2e-6).astype(np.float32)[:, None]
    found = [(a + i, b + j) for i, j, product in _tiles(f, g) for a, b in [np.nonzero(product >= enough[i : i + 256])] if len(a)]
    a, b = zip(*found) if found else ((), ())
    return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])


def best(qi: np.ndarray, ids: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Positions of the best k of each query: cosine down, those less than TIE apart by id up."""
    order = np.lexsort((ids, -cos, qi))
    q, c = qi[order], cos[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (c[:-1] - c[1:] >= TIE)] if len(q) else np.zeros(0, bool)
    order = order[np.lexsort((ids[order], np.cumsum(new), q))]
    q = qi[order]
    heads = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(heads, np.diff(np.r_[heads, len(q)]))
    return order[rank < k]


def nearest_neighbours(vectors: DataFrame, k: int = 5, dims: int = 64, seed: int = 11) -> DataFrame:
    """(vec_id, neighbour_id, cosine): about the k most similar others of every row of ``vectors`` (key, raw).

    Fewer than k others give what there is. An empty table or a single vector gives no rows.
    """
    spark = vectors.sparkSession
    classes = distinct_vectors(vectors, True).groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.count("*").alias("copies"), F.any_value("raw").alias("raw"))
    classes = materialize(classes, "vectors")
    n = classes.count()
    if n == 0:
        return spark.createDataFrame([], "vec_id long, neighbour_id long, cosine double")
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    cells = int(min(MAX_CELLS, max(1, n // CELL_ROWS)))
    want = max(MIN_SAMPLE, SAMPLE_PER_CELL * cells)
    # the sample for centroids is bounded by a rank of hashed keys; all rows are indexed
    picked = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(min(1 << 20, -(-want * (1 << 20)) // n))).select("raw").limit(2 * want).collect() if cells > 1 else []
    if picked:
        sample = (_unit([r[0] for r in picked], dims) @ turn).astype(np.float32)
        centres = _coarse(sample, cells)
    else:
        sample, centres = np.zeros((0, dims), np.float32), np.zeros((1, dims), np.float32)

    def placed_by(centres: np.ndarray, divided: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
        """(cell, rep, raw, part) of all classes; ``divided`` has the first part and the number of parts of each cell."""

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = (_unit(batch.column(0).to_pylist(), dims) @ turn) if batch.num_rows else np.zeros((0, dims))
                cell = part = _nearest(x.astype(np.float32), centres)
                if divided is not None:
                    rep = batch.column(1).to_numpy().astype(np.uint64)
                    mixed = ((rep ^ (rep >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    part = divided[0][cell] + (mixed % divided[1][cell].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(1), batch.column(0), pa.array(part, pa.int32())], ["cell", "rep", "raw", "part"])

        return classes.select("raw", "rep").mapInArrow(assign, "cell int, rep long, raw binary, part int")

    # cells that are too large are divided by more centroids, from their own part of the sample
    for division in range(DIVISIONS + 1):
        placed = materialize(placed_by(centres), "placed")
        sizes = dict(placed.groupBy("cell").count().collect())  # at most MOST_CELLS rows
        large = {c: size for c, size in sizes.items() if size > PART_ROWS}
        if not large or division == DIVISIONS or not len(sample) or len(centres) >= MOST_CELLS:
            break
        home, added = _nearest(sample, centres), []
        for c, size in large.items():
            mine = sample[home == c]
            more = int(min(len(mine) // 4, -(-size // CELL_ROWS), MOST_CELLS - len(centres)))
            if more > 1:
                made = _kmeans(mine, more, 8)
                centres[c] = made[0]
                added.append(made[1:])
        if not added:
            break
        centres = np.concatenate([centres, *added])
        drop_materialized(placed)
    gaps = _gaps(centres) if len(centres) <= 2048 else None
    # what can't be divided, as it lies in one place, is cut by a hash
    parts = np.ones(len(centres), np.int64)
    for cell, size in sizes.items():
        parts[cell] = -(-size // PART_ROWS)
    first_part = np.r_[0, np.cumsum(parts)]
    home = placed if parts.max() == 1 else materialize(placed_by(centres, (first_part, parts)), "home")
    result = "q long, n long, cos double, radius double, raw binary, part int, kind int"
    # every task gets a few parts, however many there are
    tasks = max(3 * spark.sparkContext.defaultParallelism, 2 * int(first_part[-1]))

    def own(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        """Neighbours within the part (kind 0), queries to other parts (1), rows for the leaders of all parts (2), leaders with what they cover: how far, and in ``cos`` how many (3)."""
        x = _unit(members["raw"], dims) @ turn
        ids = members["rep"].to_numpy(np.int64)
        cell = int(members["cell"].iloc[0])
        scan = Scanner(x, ids, k)
        qi, mi, cos = scan.search(x, ids, None)
        keep = best(qi, ids[mi], cos, k)
        qi, mi, cos = qi[keep], mi[keep], cos[keep]
        held = np.bincount(qi, minlength=len(x))
        worst = np.full(len(x), 1.0)
        np.minimum.at(worst, qi, cos)
        radius = np.where(held >= k, np.sqrt(np.maximum(0, 2 - 2 * worst)), 2.0)
        f = x.astype(np.float32)
        targets: list[tuple[np.ndarray, np.ndarray]] = []
        wide: list[np.ndarray] = []
        if len(centres) > 1:
            for lo in range(0, len(x), 2048):
                g = gaps[cell][None] if gaps is not None else np.sqrt(np.maximum(1e-12, ((centres - centres[cell]) ** 2).sum(axis=1)))[None]
                d = (centres * centres).sum(axis=1) - 2 * (f[lo : lo + 2048] @ centres.T)
                plane = (d - d[:, cell][:, None]) / (2 * g)
                plane[:, cell] = np.inf
                near = plane < REACH * radius[lo : lo + 2048][:, None]
                many = near @ parts > MANY_VISITS if parts.max() > 1 else np.count_nonzero(near, axis=1) > MANY_VISITS
                wide.append(np.flatnonzero(many) + lo)
                near[many] = False
                a, b = np.nonzero(near)
                for t in range(int(parts.max())):
                    ok = parts[b] > t
                    targets.append((a[ok] + lo, first_part[b[ok]] + t))
        mine = int(key[0])
        for other in range(int(first_part[cell]), int(first_part[cell + 1])):
            if other != mine:
                targets.append((np.arange(len(x)), np.full(len(x), other)))
        a, p = (np.concatenate([np.zeros(0, np.int64), *t]) for t in (zip(*targets) if targets else ((), ())))
        w = np.concatenate([np.zeros(0, np.int64), *wide])
        led, reach, covered = scan.leaders() if first_part[-1] > MANY_VISITS + 1 else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        m, rows = len(qi), np.r_[a, w, led]
        return pd.DataFrame({
            "q": np.r_[ids[qi], ids[rows]], "n": np.r_[ids[mi], np.full(len(rows), -1)], "cos": np.r_[cos, np.full(len(a) + len(w), np.nan), covered], "radius": np.r_[np.full(m, np.nan), radius[a], radius[w], reach],
            "raw": np.r_[np.full(m, None, object), members["raw"].to_numpy(object)[rows]], "part": np.r_[np.full(m, -1), p, np.full(len(w) + len(led), mine)].astype(np.int32), "kind": np.repeat(np.arange(4, dtype=np.int32), [m, len(a), len(w), len(led)]),
        })

    one = materialize(home.repartition(tasks, "part").groupBy("part").applyInPandas(own, result), "own")
    near = one.where("kind = 0").select("q", "n", "cos")
    if len(centres) > 1 or parts.max() > 1:
        queries = one.where("kind = 1").select("part", F.col("q").alias("rep"), "raw", "radius")
        held = dict(one.groupBy("kind").count().collect())
        if held.get(2):
            queries = queries.unionByName(_by_leaders(one, held[2], held[3], first_part, dims, turn, k))

        def others(key: tuple, members: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if not len(members) or not len(asked):
                return pd.DataFrame({"q": [], "n": [], "cos": []})
            ids = members["rep"].to_numpy(np.int64)
            scan = Scanner(_unit(members["raw"], dims) @ turn, ids, k)
            q_ids = asked["rep"].to_numpy(np.int64)
            qi, mi, cos = scan.search(_unit(asked["raw"], dims) @ turn, q_ids, asked["radius"].to_numpy())
            keep = best(qi, ids[mi], cos, k)
            return pd.DataFrame({"q": q_ids[qi[keep]], "n": ids[mi[keep]], "cos": cos[keep]})

        far = home.repartition(tasks, "part").groupBy("part").cogroup(queries.repartition(tasks, "part").groupBy("part")).applyInPandas(others, "q long, n long, cos double")
        near = near.unionByName(far)
    return _expand(near, vectors, classes, k)


def _by_leaders(one: DataFrame, n_rows: int, n_leaders: int, first_part: np.ndarray, dims: int, turn: np.ndarray, k: int) -> DataFrame:
    """(part, rep, raw, radius): queries to the parts of other cells in which a leader tells that something lies within the radius.

    Leaders are told apart by their part and rows by a hash; each set of leaders meets each set of rows in one task.
    """
    y = max(1, -(-n_rows // TILE_ROWS))
    x = max(1, -(-n_leaders // TILE_LEADERS), min(one.sparkSession.sparkContext.defaultParallelism, n_leaders * n_rows // (y * TILE_PAIRS)))
    tasks = 3 * x * y
    tile = (F.col("x") * y + F.col("y")).alias("tile")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    picked = one.where("kind = 3").select("q", "raw", "radius", "part", F.col("cos").cast("long").alias("held"), F.pmod(F.xxhash64("part"), F.lit(x)).alias("x"), every(y).alias("y"))
    leaders = picked.select(tile, "raw", "radius", "part", "held").repartition(tasks, "tile").groupBy("tile")
    alone = one.where("kind = 2").select("q", "raw", "radius", "part")

    def tiled(rows: DataFrame):
        spread = rows.withColumn("y", F.pmod(F.xxhash64("q"), F.lit(y))).withColumn("x", every(x))
        return spread.select(tile, "q", "raw", "radius", "part").repartition(tasks, "tile").groupBy("tile")

    def units(raw: pd.Series) -> np.ndarray:
        return np.concatenate([(_unit(raw.iloc[i : i + 8192], dims) @ turn).astype(np.float32) for i in range(0, len(raw), 8192)])

    def top(key: tuple, led: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(led) or not len(rows):
            return pd.DataFrame({"q": [], "top": []}, dtype=object)
        radius = rows["radius"].to_numpy()
        cos, at = highest(units(rows["raw"]), units(led["raw"]), 1 - 0.5 * radius * radius, k + 1)
        return pd.DataFrame({"q": rows["q"], "top": list(ranked_bounds(radius, cos, at, led["radius"].to_numpy(), led["held"].to_numpy(), k + 1))})

    def route(key: tuple, led: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(led) or not len(rows):
            return pd.DataFrame({"part": [], "rep": [], "raw": [], "radius": []}, dtype=object)
        radius = rows["radius"].to_numpy()
        a, b = reached(units(rows["raw"]), radius, units(led["raw"]), led["radius"].to_numpy())
        to = led["part"].to_numpy(np.int64)[b]
        cell = lambda part: np.searchsorted(first_part, part, "right")
        other = cell(to) != cell(rows["part"].to_numpy(np.int64))[a]
        a, to = np.unique(np.stack([a[other], to[other]]), axis=1)
        return pd.DataFrame({"part": to.astype(np.int32), "rep": rows["q"].to_numpy()[a], "raw": rows["raw"].to_numpy(object)[a], "radius": radius[a]})

    tops = leaders.cogroup(tiled(alone)).applyInPandas(top, "q long, top array<double>")
    # the k others are within the distance that has k + 1 rows
    nearest = tops.groupBy("q").agg(F.sort_array(F.flatten(F.collect_list("top")))[k].alias("bound"))
    within = alone.join(nearest, "q", "left").withColumn("radius", F.least("radius", "bound")).drop("bound")
    within = materialize(within, "within")
    return leaders.cogroup(tiled(within)).applyInPandas(route, "part int, rep long, raw binary, radius double")


def _ranked(rows: DataFrame, q: str, n: str, most: int) -> DataFrame:
    """The first ``most`` rows of each ``q``: cosine down, those less than TIE below the one before by ``n`` up. See :func:`best`."""
    order = f"partition by {q} order by cos desc, {n}"
    apart = rows.withColumn("apart", F.expr(f"coalesce(lag(cos) over ({order}) - cos >= {TIE}D, false)"))
    level = apart.withColumn("level", F.expr(f"sum(int(apart)) over ({order})"))
    return level.withColumn("rank", F.expr(f"row_number() over (partition by {q} order by level, {n})")).where(F.col("rank") <= most).drop("apart", "level", "rank")


def _expand(near: DataFrame, vectors: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """From neighbours of classes to neighbours of rows; a class stands for its k + 1 smallest ids, as more never count.

    Classes of very many copies, few by their share of all rows, are sent to all tasks instead of bringing their copies together.
    """
    several = materialize(classes.where("copies > 1").select("h1", "h2", "rep", "copies"), "several")
    limit = max(MANY_COPIES, int(MANY_SHARE * classes.count()))
    huge = F.broadcast(several.where(F.col("copies") > limit).drop("copies"))  # at most 1 / MANY_SHARE rows
    usual = several.where(F.col("copies") <= limit).drop("copies")
    hashed = materialize(distinct_vectors(vectors, False), "hashed")
    members = materialize(hashed.join(usual, ["h1", "h2"]).select("rep", "key", F.lit(False).alias("huge")).unionByName(hashed.join(huge, ["h1", "h2"]).select("rep", "key", F.lit(True).alias("huge"))), "members")
    top = f"row_number() over (partition by rep order by key) <= {k + 1}"
    first = members.withColumn("kept", F.expr(top)).where("kept").select(F.col("rep").alias("n"), F.col("key").alias("id"))
    ranked = near.join(first, "n", "left").select("q", F.coalesce("id", "n").alias("id"), "cos")
    own = first.select(F.col("n").alias("q"), "id", F.lit(1.0).alias("cos"))
    # a row of a class may itself be among the first k + 1
    listed = materialize(_ranked(ranked.unionByName(own), "q", "id", k + 1), "listed")
    copies = members.select(F.col("rep").alias("q"), F.col("key").alias("copy"), "huge")
    lists_of_huge = F.broadcast(listed.join(huge.select(F.col("rep").alias("q")), "q", "left_semi"))  # k + 1 rows each
    rows = listed.join(several.select(F.col("rep").alias("q")), "q", "left_anti").select(F.col("q").alias("vec_id"), "id", "cos")
    rows = rows.unionByName(listed.join(copies.where("not huge"), "q").select(F.col("copy").alias("vec_id"), "id", "cos"))
    rows = rows.unionByName(copies.where("huge").join(lists_of_huge, "q").select(F.col("copy").alias("vec_id"), "id", "cos"))
    rows = rows.select("vec_id", F.col("id").alias("neighbour_id"), "cos").where("vec_id <> neighbour_id")
    return _ranked(rows, "vec_id", "neighbour_id", k).select("vec_id", "neighbour_id", F.col("cos").alias("cosine"))


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """Distinct (vec_id_a, vec_id_b), smaller first, of which one is a neighbour of the other."""
    return neighbours.select(F.least("vec_id", "neighbour_id").alias("vec_id_a"), F.greatest("vec_id", "neighbour_id").alias("vec_id_b")).distinct()
