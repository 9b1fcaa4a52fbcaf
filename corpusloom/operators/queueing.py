"""The work queue as batch operators: coalescing, claims, leases, and differences of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIGH, LOW = 100, 0
STALE_SECONDS, LEASE_SECONDS, BATCH_ITEMS = 30, 15, 128


def coalesced(requests: DataFrame, keys: list[str], priority: str, pos: str) -> DataFrame:
    """One pending item a key: its highest priority, its first position, and how often it was asked for."""
    return requests.groupBy(*keys).agg(F.max(priority).alias("priority"), F.min(pos).alias("first_pos"), F.count("*").alias("requests"))


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """``queue`` (path, delete, priority, status) with new requests (path, delete, priority): they join pending items of the
    same path and kind; an item in progress gets a second, pending one."""
    running = queue.where("status <> 'pending'")
    pending = queue.where("status = 'pending'").select("path", "delete", "priority").unionByName(new.select("path", "delete", "priority"))
    return running.unionByName(pending.groupBy("path", "delete").agg(F.max("priority").alias("priority")).withColumn("status", F.lit("pending")), allowMissingColumns=True)


def stale(status: Column, owner: Column, claimed_at: Column, me: str, now: Column, seconds: int = STALE_SECONDS) -> Column:
    """Whether another owner's claim is so old that it counts as given up."""
    return (status == "in_progress") & (owner != me) & (F.unix_timestamp(now) - F.unix_timestamp(claimed_at) >= seconds)


def reclaimed(queue: DataFrame, me: str, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """``queue`` with stale claims of other owners pending again; my own stay."""
    old = F.coalesce(stale(F.col("status"), F.col("owner"), F.col("claimed_at"), me, now, seconds), F.lit(False))
    return queue.withColumns({"status": F.when(old, "pending").otherwise(F.col("status")), "owner": F.when(old, None).otherwise(F.col("owner")), "claimed_at": F.when(old, None).otherwise(F.col("claimed_at"))})


def claimable(queue: DataFrame, limit: int = 1) -> DataFrame:
    """The next pending items: by priority, then id."""
    return queue.where("status = 'pending'").orderBy(F.col("priority").desc(), "id").limit(limit)


def claim(queue: DataFrame, me: str, now: Column, limit: int = 1) -> DataFrame:
    """``queue`` after ``me`` has taken the next items: in progress, one more attempt."""
    mine = claimable(queue, limit).select("id", F.lit(True).alias("mine"))
    taken = F.coalesce("mine", F.lit(False))
    after = queue.join(F.broadcast(mine) if limit <= 10_000 else mine, "id", "left")
    return after.withColumns({"status": F.when(taken, "in_progress").otherwise(F.col("status")), "owner": F.when(taken, me).otherwise(F.col("owner")), "claimed_at": F.when(taken, now).otherwise(F.col("claimed_at")), "attempts": F.col("attempts") + taken.cast("int")}).drop("mine")


def finished(queue: DataFrame, me: str, outcomes: DataFrame) -> DataFrame:
    """``queue`` after the ``outcomes`` (id, done) of items that ``me`` holds: those done are gone, failed ones are pending again.

    Outcomes of an id that differ count as failed; items of others are left alone.
    """
    known = outcomes.where("id is not null").groupBy("id").agg(F.min("done").alias("done"))
    after = queue.join(known, "id", "left")
    mine = F.col("owner").eqNullSafe(me) & F.col("done").isNotNull()
    again = mine & ~F.coalesce("done", F.lit(True))
    kept = after.where(~(mine & F.coalesce("done", F.lit(False))))
    return kept.withColumns({"status": F.when(again, "pending").otherwise(F.col("status")), "owner": F.when(again, None).otherwise(F.col("owner")), "claimed_at": F.when(again, None).otherwise(F.col("claimed_at"))}).drop("done") if "claimed_at" in queue.columns else kept.withColumns({"status": F.when(again, "pending").otherwise(F.col("status")), "owner": F.when(again, None).otherwise(F.col("owner"))}).drop("done")


def renewed(queue: DataFrame, me: str, held: DataFrame, now: Column) -> DataFrame:
    """``queue`` with the claims of ``held`` (id) that ``me`` still has counted from ``now``; lost ones stay lost."""
    asked = held.select("id").where("id is not null").distinct().withColumn("asked", F.lit(True))
    mine = F.col("owner").eqNullSafe(me) & (F.col("status") == "in_progress") & F.coalesce("asked", F.lit(False))
    return queue.join(asked, "id", "left").withColumn("claimed_at", F.when(mine, now).otherwise(F.col("claimed_at"))).drop("asked")


def lease(held: tuple[str, float] | None, me: str, now: float, seconds: int = LEASE_SECONDS) -> tuple[tuple[str, float] | None, bool]:
    """The lease (owner, expiry) after ``me`` asks for it, and whether ``me`` has it: free, own and expired leases are given."""
    if held is None or held[0] == me or held[1] <= now:
        return (me, now + seconds), True
    return held, False


def stats(queue: DataFrame) -> DataFrame:
    """One row: pending items of high and of low priority, and those in progress."""
    groups = queue.groupBy("status", "priority").count()
    part = lambda test: F.coalesce(F.sum(F.when(test, F.col("count"))), F.lit(0))
    pending = F.col("status") == "pending"
    return groups.agg(part(pending & (F.col("priority") >= HIGH)).alias("high"), part(pending & (F.col("priority") < HIGH)).alias("low"), part(F.col("status") == "in_progress").alias("in_progress"))


def snapshot_diff(before: DataFrame, now: DataFrame, key: str, signature: str) -> DataFrame:
    """(key, change): what was added, changed or removed between two snapshots."""
    a, b = before.select(F.col(key).alias("ka"), F.col(signature).alias("sa")), now.select(F.col(key).alias("kb"), F.col(signature).alias("sb"))
    both = a.join(b, F.col("ka") == F.col("kb"), "full_outer")
    change = F.when(F.col("ka").isNull(), "added").when(F.col("kb").isNull(), "removed").when(~F.col("sa").eqNullSafe(F.col("sb")), "changed")
    return both.select(F.coalesce("kb", "ka").alias(key), change.alias("change")).where("change is not null")


def work_of(changes: DataFrame, key: str) -> DataFrame:
    """Work items of a difference: what is there goes to the index first, what is gone is deleted."""
    return changes.select(F.col(key).alias("path"), (F.col("change") == "removed").alias("delete"), F.lit(HIGH).alias("priority"))


def reconcile(discovered: DataFrame, tracked: DataFrame, complete: DataFrame, prefix: Column) -> DataFrame:
    """(path, action) for a directory: ``index`` what isn't complete, ``delete`` what is tracked there and gone or unreadable."""
    missing = discovered.where("readable").select("path").join(complete.where("complete").select("path"), "path", "left_anti").withColumn("action", F.lit("index"))
    gone = tracked.where(prefix).select("path").join(discovered.where("readable").select("path"), "path", "left_anti").withColumn("action", F.lit("delete"))
    return missing.unionByName(gone)


def batches(items: DataFrame, order: str, size: str, most_items: int, most_size: int, lane: str) -> DataFrame:
    """``items`` with ``batch``: greedy batches, in order and within a lane, of at most so many items and so much size.

    A batch ends where the next item would exceed either bound; an item that alone exceeds the size is a batch. The
    fold runs over sorted lanes as a stream, so that a lane may be of any length.
    """
    kinds = dict(items.dtypes)
    schema = ", ".join(f"`{c}` {k}" for c, k in items.dtypes) + ", batch int"

    def fold(parts):
        at, number, count, total = None, 0, 0, 0
        for part in parts:
            made = []
            for where, n in zip(part[lane], part[size]):
                n = 0 if n is None or n != n else n
                if where != at:
                    at, number, count, total = where, 0, 0, 0
                elif count >= most_items or total + n > most_size:
                    number, count, total = number + 1, 0, 0
                count, total = count + 1, total + n
                made.append(number)
            part = part.copy()
            part["batch"] = made
            yield part

    assert lane in kinds
    return items.repartition(lane).sortWithinPartitions(lane, order).mapInPandas(fold, schema)


def file_batches(items: DataFrame, file: str, order: str, size: str, most_items: int, most_size: int, lane: str) -> DataFrame:
    """``items`` with ``batch`` as :func:`batches` makes them, but no file is split: files stay whole, in the order of their first item.

    A file that alone exceeds a bound is a batch.
    """
    files = items.groupBy(lane, file).agg(F.min(order).alias("first"), F.count("*").alias("count"), F.sum(F.coalesce(size, F.lit(0))).alias("size"))
    kinds = ", ".join(f"`{c}` {k}" for c, k in files.dtypes if c in (lane, file))

    def fold(parts):
        at, number, count, total = None, 0, 0, 0
        for part in parts:
            made = []
            for where, n, s in zip(part[lane], part["count"], part["size"]):
                if where != at:
                    at, number, count, total = where, 0, 0, 0
                elif count + n > most_items or total + s > most_size:
                    number, count, total = number + 1, 0, 0
                count, total = count + n, total + s
                made.append(number)
            yield part[[c for c in part.columns if c in (lane, file)]].assign(batch=made)

    numbered = files.repartition(lane).sortWithinPartitions(lane, "first", file).mapInPandas(fold, f"{kinds}, batch int")
    return items.join(numbered, [lane, file])
