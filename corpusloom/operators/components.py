"""Connected components over any number of links: local union-find in cells, and contraction to representatives.

Links are dealt to cells by a rule of the caller. A round runs union-find over the links of each cell, which leaves one
representative for each vertex of the cell; then the cells exchange representatives: all those of a vertex meet, the
first of them is its parent, and each other one is linked to that parent. These links between representatives are the
links of the next round, so that only what changed goes on and settled components drop out. When no vertex has two
representatives, parents are stable, and labels go back from round to round.

Representatives are first in the order of a hash, not of ids: of a chain of sorted ids each would represent the next
one, and nothing would be contracted, while a random order drops about a third of the vertices even there. Labels are
the smallest ids all the same; they are carried along as minima.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_materialized, materialize

#: Links a cell is meant to hold, and at least where there are more cores than cells.
CELL_LINKS, MIN_CELL_LINKS = 250_000, 20_000
#: Characters that a hash puts before an id, to order vertices.
PREFIX = 8
#: Shares of all rows above which a parent's rows are spread over several tasks, so that there are few such parents.
HOT_SHARE, HOT_PARTS = 0.002, 32
#: Rounds after which something must be wrong; each drops a third of the vertices of the longest chain.
MAX_ROUNDS = 200

Dealer = Callable[[DataFrame, int], DataFrame]


def by_hash(links: DataFrame, cells: int) -> DataFrame:
    """``links`` (a, b) with ``cell``: spread evenly."""
    return links.withColumn("cell", F.pmod(F.xxhash64("a", "b"), F.lit(cells)).cast("int"))


def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, rep) from the links (a, b) of a task: each vertex with the first of those it is linked to."""
    parent: dict[str, str] = {}

    def root(v: str) -> str:
        top = v
        while (p := parent[top]) != top:
            top = p
        while parent[v] != top:
            parent[v], v = top, parent[v]
        return top

    setdefault = parent.setdefault
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            setdefault(a, a)
            setdefault(b, b)
            a, b = root(a), root(b)
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
    vertices = list(parent)
    for k in range(0, len(vertices), 50_000):
        part = vertices[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([root(v) for v in part], pa.string())], ["v", "rep"])


def _round(links: DataFrame, total: int, deal: Dealer, cell_links: int) -> tuple[DataFrame, bool]:
    """(v, parent, others): each vertex of the links (a, b), its first representative, and the other ones; whether there can be others."""
    cores = links.sparkSession.sparkContext.defaultParallelism
    cells = max(1, min(cores, total // MIN_CELL_LINKS), -(-total // cell_links))
    dealt = deal(links, cells) if cells > 1 else links.withColumn("cell", F.lit(0))
    # a cell that is too large is cut: representatives of a vertex meet from wherever they come
    sizes = dict(dealt.groupBy("cell").count().collect()) if cells > 1 else {0: total}
    parts = {cell: -(-size // (2 * cell_links)) for cell, size in sizes.items()}
    first = dict(zip(parts, accumulate(parts.values(), initial=0)))
    tasks = sum(parts.values())
    cut = F.pmod(F.xxhash64("b", "a"), F.col("parts"))
    if len(parts) == 1:
        known = dealt.withColumn("first", F.lit(0)).withColumn("parts", F.lit(tasks))
    else:  # a row for each cell that holds links
        table = links.sparkSession.createDataFrame([(c, first[c], n) for c, n in parts.items()], "cell int, first int, parts int")
        known = dealt.join(F.broadcast(table), "cell")
    placed = known.select("a", "b", (F.col("first") + cut).cast("int").alias("task"))
    local = placed.repartitionById(tasks, "task").select("a", "b").mapInArrow(union_find, "v string, rep string")
    # at most one representative a task
    met = local.groupBy("v").agg(F.collect_set("rep").alias("reps")).select("v", F.array_min("reps").alias("parent"), "reps")
    return met.select("v", "parent", F.array_remove("reps", F.col("parent")).alias("others")), tasks > 1


def _follow(rows: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(v, label) of at most ``most`` rows (v, parent) by the labels (parent, label) of all parents; parents of many rows are spread over tasks."""
    limit = max(CELL_LINKS, int(HOT_SHARE * most))
    # there are at most 1 / HOT_SHARE such parents
    hot = [r[0] for r in rows.groupBy("parent").count().where(F.col("count") > limit).select("parent").collect()] if most > limit else []
    if not hot:
        return rows.join(labels, "parent").select("v", "label")
    many = F.col("parent").isin(hot)
    salted = rows.withColumn("salt", F.when(many, F.pmod(F.xxhash64("v"), F.lit(HOT_PARTS))).otherwise(0))
    spread = labels.withColumn("salt", F.explode(F.when(many, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(spread, ["parent", "salt"]).select("v", "label")


def components(links: DataFrame, deal: Dealer = by_hash, cell_links: int = CELL_LINKS) -> DataFrame:
    """(v, label): each vertex of the links (a, b) with the smallest vertex of its component, in the order of their type.

    Links with a null end or of a vertex to itself are ignored; either direction and repeated links count once. Without
    links there are no rows.
    """
    named = lambda c: F.concat(F.lpad(F.hex(F.pmod(F.xxhash64(c), F.lit(1 << 32))), PREFIX, "0"), c)
    kind = dict(links.dtypes)["a"]
    bare = lambda c: F.substr(c, F.lit(PREFIX + 1)).cast(kind)
    now = materialize(links.where("a is not null and b is not null and a <> b").select(named("a").alias("a"), named("b").alias("b")), "links")
    rounds: list[tuple[DataFrame, DataFrame, int]] = []
    lows = None
    for _ in range(MAX_ROUNDS):
        total = now.count()
        if not total:
            break
        met, several = _round(now, total, deal, cell_links)
        state = materialize(met, "round")
        drop_materialized(now)
        low = state.select("v", "parent", bare("v").alias("low")) if lows is None else state.select("v", "parent").join(lows.withColumnRenamed("parent", "v"), "v", "left")
        lows = materialize(low.groupBy("parent").agg(F.min("low").alias("low")), "lows")
        rounds.append((state, lows, 2 * total))
        if not several:
            break
        now = materialize(state.select(F.explode("others").alias("a"), F.col("parent").alias("b")).distinct(), "links")
    else:
        raise RuntimeError("components did not become stable")
    if not rounds:
        return now.select(bare("a").alias("v"), bare("b").alias("label"))
    found = None
    for k in range(len(rounds) - 1, -1, -1):
        state, lows, most = rounds[k]
        if found is None:
            labels = lows.withColumnRenamed("low", "label")
        else:  # a parent that went on has its label from there
            later = found.select(F.col("v").alias("parent"), F.col("label").alias("later"))
            labels = lows.join(later, "parent", "left").select("parent", F.coalesce("later", "low").alias("label"))
        found = _follow(state.select("v", "parent"), labels, most)
        if k:
            found = materialize(found, "labels")
    return found.select(bare("v").alias("v"), "label")
