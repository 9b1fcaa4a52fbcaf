"""Near-duplicate units: candidate strategies, exact scores, clusters and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codeunits import CLASS_TYPES, FUNCTION_TYPES
from ..session import materialize
from . import components, vectors

THRESHOLD, EXHAUSTIVE_LIMIT, MAX_CANDIDATES, DIMENSIONS, BAND, PRECISION = 0.92, 1024, 64, 12, 2, 1000
#: Entries a range of positions is meant to hold, most ranges, and rows from which their bounds are taken.
RANGE_ROWS, MAX_RANGES, RANGE_SAMPLE = 100_000, 200, 20_000
#: A bucket is crowded above this many rows and this share of all entries.
HOT_ROWS, HOT_SHARE = 100_000, 0.001
LEVELS = ("function", "class", "file")


def parse_threshold(value: str | float | None) -> float:
    """A finite number from 0 to 1; null is the default."""
    if value is None:
        return THRESHOLD
    try:
        number = float(value)
    except ValueError:
        raise ValueError("threshold must be a number") from None
    if not 0 <= number <= 1:
        raise ValueError("threshold must lie between 0 and 1")
    return number


def parse_levels(values: list[str] | None) -> tuple[str, ...]:
    """Levels from names that may be joined by commas, each once; without any, functions."""
    names = [n.strip().lower() for v in values or [] for n in v.split(",") if n.strip()]
    for name in names:
        if name not in LEVELS:
            raise ValueError(f"unknown level: {name}")
    return tuple(dict.fromkeys(names)) or LEVELS[:1]


def level_predicate(unit_type: Column, levels: tuple[str, ...]) -> Column:
    """Stored units of these levels; no stored unit is of the level file."""
    types = [t for level, known in (("function", FUNCTION_TYPES), ("class", CLASS_TYPES)) if level in levels for t in known]
    return unit_type.isin(types) if types else F.lit(False)


def signature_keys(v: Column, dimensions: int = DIMENSIONS, band: int = BAND) -> Column:
    """Keys that similar vectors are likely to share: from the largest dimensions in magnitude, ties by index.

    A fingerprint of their rounded (half to even) values, their signs, bands of signs, and each sign alone; a vector
    without any dimension other than 0 has the one key ``zero-vector``.
    """
    indexed = F.transform(v, lambda x, i: F.struct((-F.abs(x.cast("double"))).alias("m"), i.alias("i"), x.cast("double").alias("x")))
    top = F.slice(F.array_sort(F.filter(indexed, lambda s: s["m"] < 0)), 1, dimensions)
    length = vectors.norm(v)
    signed = F.transform(top, lambda s: F.concat(F.when(s["x"] < 0, "-").otherwise("+"), s["i"].cast("string")))
    print_ = F.concat(F.lit("fingerprint:"), F.array_join(F.transform(top, lambda s: F.concat(s["i"].cast("string"), F.lit(":"), F.bround(s["x"] / length * PRECISION, 0).cast("bigint").cast("string"))), "|"))
    bands = F.transform(F.sequence(F.lit(0), F.floor((F.size(signed) - 1) / band).cast("int")), lambda k: F.concat(F.lit("band:"), F.array_join(F.slice(signed, k * band + 1, band), "|")))
    keys = F.concat(F.array(print_, F.concat(F.lit("top:"), F.array_join(signed, "|"))), bands, F.transform(signed, lambda s: F.concat(F.lit("dim:"), s)))
    return F.when(F.size(top) == 0, F.array(F.lit("zero-vector"))).otherwise(F.array_distinct(keys))


def _numbered(rows: DataFrame, entries: int) -> DataFrame:
    """``rows`` (bucket, at, ...) with ``n``, their number within the bucket in the order of ``at``, from 1.

    Positions are cut into ranges; rows are numbered within bucket and range, and a range begins where those before it
    end, so that a bucket that holds a large share of all rows is numbered by many tasks.
    """
    ranges = max(1, min(MAX_RANGES, -(-entries // RANGE_ROWS)))
    if ranges == 1:
        return rows.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("at")))
    seen = sorted(r[0] for r in rows.select("at").sample(min(1.0, RANGE_SAMPLE / entries), 3).limit(4 * RANGE_SAMPLE).collect())
    bounds = sorted({seen[len(seen) * k // ranges] for k in range(1, ranges)}) if seen else []
    at = F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("at"))) if bounds else F.lit(0)
    parted = rows.withColumn("range", at)
    before = F.sum("count").over(Window.partitionBy("bucket").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parted.groupBy("bucket", "range").count().select("bucket", "range", F.coalesce(before, F.lit(0)).alias("offset"))
    local = parted.withColumn("n", F.row_number().over(Window.partitionBy("bucket", "range").orderBy("at")))
    return local.join(offsets, ["bucket", "range"]).withColumn("n", F.col("n") + F.col("offset")).drop("range", "offset")


def bounded_pairs(entries: DataFrame, key: str, pos: str, vector: str, threshold: float, most: int = MAX_CANDIDATES) -> DataFrame:
    """(a, b, cosine) of entries that share a signature bucket within bounds: a comes before b in the order of ``pos``.

    For each of its keys an entry looks at the k latest and then at the k first earlier entries of the bucket, with
    k = ceil(most / (2 keys)), keeps different ones, the latest of all keys first, and at most ``most`` of them.
    Neighbours in a bucket come from numbers within it, so that no bucket is multiplied with itself; the first entries
    of buckets that hold many rows, few by their share, are sent to all tasks. Vectors come in last.
    """
    keyed = entries.select(F.col(key).alias("id"), F.col(pos).alias("at"), signature_keys(F.col(vector)).alias("keys"))
    scan = F.greatest(F.lit(1), F.ceil(F.lit(most) / (2 * F.size("keys"))))
    rows = keyed.select("id", "at", scan.cast("int").alias("scan"), F.posexplode("keys").alias("k", "bucket"))
    total = entries.count()
    rows = materialize(_numbered(rows, total), "buckets")
    late = rows.where("n > 1").select("id", "bucket", F.explode(F.expr("sequence(greatest(1, n - scan), n - 1)")).alias("m"), F.lit(0).alias("phase"), "k", "n")
    late = late.select("id", "bucket", F.col("m").cast("long"), F.struct("phase", "k", (F.col("n") - F.col("m")).cast("long").alias("step")).alias("rank"))
    early = rows.where("n > 1").select("id", "bucket", F.explode(F.expr("sequence(1, least(scan, n - 1))")).alias("m"), F.lit(1).alias("phase"), "k")
    early = early.select("id", "bucket", F.col("m").cast("long"), F.struct("phase", "k", F.col("m").cast("long").alias("step")).alias("rank"))
    there = rows.select("bucket", F.col("n").cast("long").alias("m"), F.col("id").alias("a"))
    limit = max(HOT_ROWS, int(HOT_SHARE * total))
    # at most keys / HOT_SHARE buckets
    hot = [r[0] for r in rows.groupBy("bucket").count().where(F.col("count") > limit).select("bucket").collect()] if total > limit else []
    if hot:
        crowded = F.col("bucket").isin(hot)
        firsts = F.broadcast(there.where(crowded & (F.col("m") <= most)))
        found = late.unionByName(early.where(~crowded)).join(there, ["bucket", "m"]).unionByName(early.where(crowded).join(firsts, ["bucket", "m"]))
    else:
        found = late.unionByName(early).join(there, ["bucket", "m"])
    # a bounded list: at most 2 k entries a key
    lists = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "a"))).alias("found"))
    kept = lists.select(F.col("id").alias("b"), F.explode(F.slice(F.array_distinct(F.transform("found", lambda c: c["a"])), 1, most)).alias("a"))
    # lengths once an entry; entries without one have no pairs
    length = vectors.norm(F.col(vector))
    vs = entries.select(F.col(key).alias("id"), F.col(vector).alias("v"), length.alias("n")).where((F.col("n") > 0) & (F.col("n") < float("inf")))
    vs = materialize(vs, "lengths")
    scored = kept.join(vs.withColumnsRenamed({"id": "a", "v": "va", "n": "na"}), "a").join(vs.withColumnsRenamed({"id": "b", "v": "vb", "n": "nb"}), "b")
    cosine = vectors.dot(F.col("va"), F.col("vb")) / (F.col("na") * F.col("nb"))
    return scored.where(F.size("va") == F.size("vb")).select("a", "b", cosine.alias("cosine")).where(F.col("cosine") >= threshold)


def knn_pairs(pairs: DataFrame, k: int = MAX_CANDIDATES) -> DataFrame:
    """Of pairs (a, b, cosine) those in which one is among the k most similar of the other, ties by id."""
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "cosine").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "cosine"))
    ranked = both.withColumn("n", F.row_number().over(Window.partitionBy("x").orderBy(F.round("cosine", 9).desc(), "y"))).where(F.col("n") <= k)
    return ranked.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("cosine").alias("cosine"))


def find_pairs(entries: DataFrame, key: str, pos: str, vector: str, threshold: float, strategy: str = "auto") -> DataFrame:
    """Pairs by a strategy: ``exhaustive``, ``signatures``, or ``auto``, which is exhaustive up to EXHAUSTIVE_LIMIT entries and by blocks beyond."""
    if strategy == "signatures":
        return bounded_pairs(entries, key, pos, vector, threshold)
    every = vectors.pairs_above(entries, key, vector, threshold)
    return every if strategy == "exhaustive" or entries.count() <= EXHAUSTIVE_LIMIT else knn_pairs(every)


def transient_pairs(transient: DataFrame, stored: DataFrame, key: str, vector: str, path: str, threshold: float) -> DataFrame:
    """(a, b, cosine) of whole files given for one run against stored units of other files, and among themselves."""
    met = vectors.near_pairs(stored, key, vector, threshold, transient)
    at = lambda df, k, p: df.select(F.col(key).alias(k), F.col(path).alias(p)).distinct()
    outside = met.join(at(transient, "a", "pa"), "a").join(at(stored, "b", "pb"), "b").where(~F.col("pa").eqNullSafe(F.col("pb")))
    return outside.select("a", "b", "cosine").unionByName(vectors.near_pairs(transient, key, vector, threshold))


def clusters(pairs: DataFrame) -> DataFrame:
    """(id, cluster): connected units (a, b), strings, under their smallest id. See :mod:`.components`."""
    return components.components(pairs.select("a", "b")).withColumnsRenamed({"v": "id", "label": "cluster"})


def report(pairs: DataFrame, units: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row a unit of a cluster: (cluster, id, fields, links, most, first): how many links it has, the greatest similarity among
    them, and its first pair in the order of the pairs, by similarity down and ids. ``pairs`` has each pair (a, b, cosine) once."""
    pair = F.struct((-F.round("cosine", 9)).alias("down"), "a", "b")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"), "cosine", pair.alias("pair"))
    linked = ends.groupBy("id").agg(F.count("*").alias("links"), F.max("cosine").alias("most"), F.min("pair").alias("first"))
    return clusters(pairs).join(linked, "id").join(units.withColumnRenamed(key, "id").select("id", *fields), "id").select("cluster", "id", *fields, "links", "most", "first")


def summary(members: DataFrame) -> DataFrame:
    """One row a cluster of a report: (cluster, units, pairs, most, first_a, first_b); the first pair orders clusters."""
    made = members.groupBy("cluster").agg(F.count("*").alias("units"), (F.sum("links") / 2).cast("bigint").alias("pairs"), F.max("most").alias("most"), F.min("first").alias("first"))
    return made.select("cluster", "units", "pairs", "most", F.col("first.a").alias("first_a"), F.col("first.b").alias("first_b"))
