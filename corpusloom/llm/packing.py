"""Filling containers of fixed capacity by non-negative least squares over the histogram of lengths.

Combinations that fill a container are enumerated: one length repeated until it is full, two lengths with repetitions
that fill it exactly, and three different lengths that do. Non-negative least squares finds how often each combination
is repeated so that together they use the histogram up; rounded counts become containers, and what is left is packed
greedily, largest first, with the two items that fill a rest exactly wherever there are such. All of this works on the
histogram of exact lengths, whose size the capacity bounds. Items are then numbered within their length in parallel,
and the numbers tell their containers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Share of the capacity that a repeated length may leave empty, repetitions of the second of two lengths, and
#: combinations of three lengths at most (of more, evenly spaced ones are taken; what they miss is left to the greedy rest).
SPARE, SECOND, TRIPLES = 0.01, 8, 200_000
#: Rows that are numbered in one group.
GROUP_ROWS = 100_000

Combinations = tuple[np.ndarray, np.ndarray]


def combinations(capacity: int, present: np.ndarray) -> Combinations:
    """(lengths, times), three columns each: different lengths, or 0, and how often each is in the combination."""
    sizes = np.flatnonzero(present[: capacity + 1])
    sizes = sizes[sizes > 0]
    lengths, times = [np.zeros((0, 3), np.int64)], [np.zeros((0, 3), np.int64)]

    def put(*pairs: tuple[np.ndarray, np.ndarray]) -> None:
        n = len(pairs[0][0])
        columns = [*pairs, *[(np.zeros(n, np.int64), np.zeros(n, np.int64))] * (3 - len(pairs))]
        lengths.append(np.stack([np.broadcast_to(a, n) for a, _ in columns], axis=1))
        times.append(np.stack([np.broadcast_to(t, n) for _, t in columns], axis=1))

    most = capacity // sizes
    full = capacity - most * sizes <= max(1, SPARE * capacity)
    put((sizes[full], most[full]))
    a = np.repeat(sizes, most)
    i = np.arange(len(a)) - np.repeat(np.cumsum(most) - most, most) + 1
    rest = capacity - a * i
    for j in range(1, SECOND + 1):
        b = rest // j
        ok = (rest > 0) & (b * j == rest) & present[b] & (b != a) & ((i > SECOND) | (a > b))  # the other order is the same
        put((a[ok], i[ok]), (b[ok], np.full(ok.sum(), j)))
    step = max(1, -(-len(sizes) * len(sizes) // (2 * TRIPLES)))
    for at, first in enumerate(sizes):
        b = sizes[at % step : at : step]
        c = capacity - first - b
        ok = (c > 0) & (c < b)
        ok[ok] = present[c[ok]]
        put((np.full(ok.sum(), first), np.ones(ok.sum(), np.int64)), (b[ok], np.ones(ok.sum(), np.int64)), (c[ok], np.ones(ok.sum(), np.int64)))
    return np.concatenate(lengths), np.concatenate(times)


def nnls(combos: Combinations, target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repetitions x >= 0 of combinations whose sum comes closest to ``target`` by least squares: accelerated projected gradient."""
    lengths, times = combos
    scale = np.sqrt((times.astype(float) ** 2).sum(axis=1))
    weight = times / scale[:, None]
    flat, n = lengths.ravel(), len(target)
    used = lambda x: np.bincount(flat, weights=(weight * x[:, None]).ravel(), minlength=n)
    back = lambda r: (weight * r[lengths]).sum(axis=1)
    goal = target.astype(float).copy()
    goal[0] = 0
    v = np.ones(len(lengths))
    for _ in range(12):  # the largest eigenvalue bounds the step
        v = back(used(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = np.zeros(len(lengths))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - back(used(y) - goal) / (1.1 * norm))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        if np.dot(new - x, y - new) < 0:
            t_new, y = 1.0, new.copy()
        x, t = new, t_new
    return x / scale


def plan(histogram: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Containers for ``histogram[s]`` items of length s (0 to the capacity): (how many items of each length, how many such containers).

    Uses every item exactly once; items of length 0 are left to the caller.
    """
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[dict[int, int], int]] = []

    def take(need: dict[int, int], times: int) -> None:
        for s, n in need.items():
            left[s] -= n * times
        if times:
            out.append((need, int(times)))

    take({capacity: 1}, left[capacity])
    lengths, times = combinations(capacity, left > 0)
    if len(lengths):
        counts = np.rint(nnls((lengths, times), left)).astype(np.int64)
        for j in np.argsort(-counts, kind="stable"):
            if counts[j] <= 0:
                break
            need = {int(s): int(n) for s, n in zip(lengths[j], times[j]) if s}
            take(need, min(int(counts[j]), *(int(left[s]) // n for s, n in need.items())))
    while left.any():
        need: Counter = Counter()
        free, room = left.copy(), capacity
        while room:
            fit = np.flatnonzero(free[: room + 1])
            if not len(fit):
                break
            s = int(fit[-1])
            if need and s < room:  # two items that fill the room exactly are better than one that leaves a gap
                rest = room - fit
                exact = fit[(rest > 0) & (free[rest] > (rest == fit))]
                s = int(exact[-1]) if len(exact) else s
            n = 1 if s * 2 > room or len(fit) > 1 and s * 8 > room else min(int(free[s]), max(1, room // s - 1))
            need[s] += n
            free[s] -= n
            room -= n * s
        take(dict(need), min(int(left[s]) // n for s, n in need.items()))
    return out


def _slots(made: list[tuple[dict[int, int], int]], capacity: int) -> pd.DataFrame:
    """For each length, runs of item numbers: items from ``start`` on go ``per`` at a time to containers from ``base`` on."""
    used, base, rows = np.zeros(capacity + 1, np.int64), 0, []
    for need, times in made:
        for s, per in sorted(need.items()):
            rows.append((s, int(used[s]), base, per))
            used[s] += per * times
        base += times
    return pd.DataFrame(rows, columns=["s", "start", "base", "per"]).sort_values(["s", "start"])


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, n_pieces, first, tokens, container_id): the container of every item or piece of an item.

    An item of at most ``capacity`` stays whole. A larger one is divided into pieces of the full capacity and a rest;
    ``first`` is the offset of the piece. Sizes that are null or not positive count as 0; such items take no room and
    are spread over the containers there are. Repeated keys are items of their own. No items give no rows.
    """
    spark = items.sparkSession
    n = F.greatest(F.coalesce(F.col(size).cast("int"), F.lit(0)), F.lit(0))
    sized = items.select(F.col(key).alias("key"), n.alias("n"), F.monotonically_increasing_id().alias("row"))
    count = F.greatest(F.ceil(F.col("n") / capacity).cast("int"), F.lit(1))
    pieces = sized.withColumn("n_pieces", count).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
    pieces = pieces.withColumn("first", F.col("piece") * capacity).withColumn("tokens", F.least(F.col("n") - F.col("first"), F.lit(capacity)))
    pieces = materialize(pieces.withColumn("s", F.col("tokens").cast("int")).drop("n"), "pieces")
    total = pieces.count()
    salts = max(1, -(-total // GROUP_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("s", "salt").count()
    histogram = np.zeros(capacity + 1, np.int64)
    for s, c in counts.groupBy("s").agg(F.sum("count")).collect():  # at most capacity + 1 rows
        histogram[s] = c
    made = plan(histogram)
    containers = max(1, sum(times for _, times in made))
    slots = _slots(made, capacity)
    keys = slots["s"].to_numpy(np.int64) * (1 << 44) + slots["start"].to_numpy(np.int64)
    base, per, start = (slots[c].to_numpy(np.int64) for c in ("base", "per", "start"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s, number = b["s"].to_numpy(np.int64), b["number"].to_numpy(np.int64)
            at = np.clip(np.searchsorted(keys, s * (1 << 44) + number, side="right") - 1, 0, None)
            if len(keys):
                b["container_id"] = np.where(s > 0, base[at] + (number - start[at]) // per[at], number % containers)
            else:
                b["container_id"] = number % containers
            yield b.drop(columns=["s", "number"])

    before = "coalesce(sum(count) over (partition by s order by salt rows between unbounded preceding and 1 preceding), 0)"
    offsets = counts.withColumn("offset", F.expr(before)).drop("count")
    numbered = (
        salted.join(offsets, ["s", "salt"])
        .withColumn("number", F.expr("row_number() over (partition by s, salt order by row, piece) - 1") + F.col("offset"))
        .select("key", "piece", "n_pieces", "first", "tokens", "s", "number")
    )
    kind = dict(items.dtypes)[key]
    out = numbered.mapInPandas(place, f"key {kind}, piece int, n_pieces int, first int, tokens int, container_id long")
    return out.withColumnRenamed("key", key)
