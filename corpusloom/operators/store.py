"""Maintenance of derived tables: replacing, deleting, upserts, listings, counts, completeness and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import has_component, terminal, under_prefix
from ..session import drop_path, new_path


def replace_partition(df: DataFrame, path: str, partition: str) -> None:
    """Write ``df`` to a table partitioned by ``partition``: the partitions it holds are replaced as wholes, others stay."""
    df.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def replace_rows(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``table`` without the rows of the keys in ``new``, and the rows of ``new``."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def checked_replace(table: DataFrame, new: DataFrame, key: str, vectors: DataFrame, unit: str) -> DataFrame:
    """:func:`replace_rows` for units and their vectors; raises if any unit lacks its vector or the other way round."""
    lost = new.select(unit).exceptAll(vectors.select(unit)).count() + vectors.select(unit).exceptAll(new.select(unit)).count()
    if lost:
        raise ValueError(f"{lost} units and vectors don't match")
    return replace_rows(table, new, key)


def remove(table: DataFrame, path: str, exact: str | None = None, prefix: str | None = None, component: str | None = None, name: str | None = None) -> DataFrame:
    """``table`` without the rows whose path equals, lies below, has as a component, or ends in what is given."""
    gone: Column = F.lit(False)
    for value, test in ((exact, lambda v: F.col(path) == v), (prefix, lambda v: under_prefix(F.col(path), v)), (component, lambda v: has_component(F.col(path), v)), (name, lambda v: terminal(F.col(path)) == v)):
        if value is not None:
            gone = gone | test(value)
    return table.where(~F.coalesce(gone, F.lit(False)))


def remove_partition(spark: SparkSession, path: str, partition: str, value: str) -> None:
    """Drop one partition of a written table, so that no search finds its rows any more."""
    drop_path(spark, f"{path}/{partition}={value}")


def upsert(table: DataFrame, new: DataFrame, key: str, exact: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``new`` win over those of the same key; their null columns keep what was there, but for those in ``exact``, whose nulls win too."""
    rest = [c for c in table.columns if c != key]
    a, b = table.alias("a"), new.withColumn("is_new", F.lit(True)).alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")

    def merged(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"a.{c}")
        if c in exact:
            return F.when(F.col("b.is_new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
        return F.coalesce(f"b.{c}", f"a.{c}").alias(c)

    return joined.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *map(merged, rest))


def rewrite(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replace a whole table: written beside it first, so that a failure leaves the old one, and swapped in by renaming."""
    staged = new_path(spark, "staged")
    df.write.parquet(staged)
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    old = jvm(path.rstrip("/") + ".old")
    fs.delete(old, True)
    if fs.exists(jvm(path)):
        fs.rename(jvm(path), old)
    if not fs.rename(jvm(staged), jvm(path)):
        fs.rename(old, jvm(path))
        raise OSError(f"could not replace {path}")
    fs.delete(old, True)


def needs_reset(columns: list[str], wanted: list[str], addable: list[str]) -> tuple[bool, list[str]]:
    """Whether a table must be made anew, and, if not, which of the ``addable`` columns it lacks."""
    lacking = [c for c in wanted if c not in columns]
    return bool(set(lacking) - set(addable)), [c for c in lacking if c in addable]


def listing(units: DataFrame, limit: int | None, offset: int | None = None, prefix: str | None = None, language: str | None = None, include_source: bool = False) -> DataFrame:
    """A page of units by path, line and id. 0 or no limit means 50, at most 200; sources come only with a limit up to 20."""
    limit = max(1, min(200, limit or 50))
    rows = units
    if prefix:
        rows = rows.where(under_prefix(F.col("file_path"), prefix))
    if language:
        rows = rows.where(F.col("language") == language)
    source = F.col("source") if include_source and limit <= 20 else F.lit(None).cast("string")
    return rows.withColumn("source", source).orderBy("file_path", "start_line", "id").offset(max(0, offset or 0)).limit(limit)


def page_listing(pages: DataFrame, text: str | None = None, kind: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Pages whose name or path holds ``text`` in any case, and of exactly this type; up to 500 from ``offset`` (not below 0)."""
    rows = pages
    if text:
        rows = rows.where(F.contains(F.lower("name"), F.lit(text.lower())) | F.contains(F.lower("path"), F.lit(text.lower())))
    if kind:
        rows = rows.where(F.col("type") == kind)
    return rows.orderBy("docset_slug", "name", "path", "id").offset(max(0, offset)).limit(max(1, min(500, limit)))


def counts(files: DataFrame, units: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: indexed files, files with errors, units, embedded units."""
    f = files.agg(F.count_if(F.col("status") == "indexed").alias("indexed_files"), F.count_if(F.col("status") == "error").alias("error_files"))
    u = units.agg(F.count_distinct("id").alias("units"))
    v = vectors.agg(F.count_distinct("unit_id").alias("embedded_units"))
    return f.join(F.broadcast(u)).join(F.broadcast(v))


def latest_errors(files: DataFrame, limit: int = 10) -> DataFrame:
    return files.where("error is not null").orderBy(F.col("updated_at").desc_nulls_last(), "path").limit(limit).select("path", "error", "updated_at")


def completeness(files: DataFrame, units: DataFrame, vectors: DataFrame) -> DataFrame:
    """(path, units, embedded, complete): a file is complete if it is indexed, has units, and each has a vector."""
    embedded = vectors.select("unit_id").distinct()
    u = units.select("id", "file_path").distinct()
    per_file = u.join(embedded, u["id"] == embedded["unit_id"], "left").groupBy(F.col("file_path").alias("path")).agg(F.count("id").alias("units"), F.count("unit_id").alias("embedded"))
    joined = files.join(per_file, "path", "left").fillna(0, ["units", "embedded"])
    complete = (F.coalesce(F.col("status"), F.lit("")) == "indexed") & (F.col("units") > 0) & (F.col("units") == F.col("embedded"))
    return joined.select("path", "units", "embedded", complete.alias("complete"))


def drift(expected: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): what is only expected (missing) and what is only stored (orphan)."""
    missing = expected.select(*keys).distinct().join(stored.select(*keys), keys, "left_anti").withColumn("side", F.lit("missing"))
    orphan = stored.select(*keys).distinct().join(expected.select(*keys), keys, "left_anti").withColumn("side", F.lit("orphan"))
    return missing.unionByName(orphan)


def same_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    return a.select(*keys).exceptAll(b.select(*keys)).isEmpty() and b.select(*keys).exceptAll(a.select(*keys)).isEmpty()


def index_version(rows: DataFrame, group: list[str], parts: list[str]) -> DataFrame:
    """(group, version): a SHA-256 of each group that changes with any of its rows and not with their order.

    Rows are hashed one by one; the version is the hash of their number and of sums over their hashes, so that no group
    is gathered in one place.
    """
    digest = F.sha2(F.concat_ws(":", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256)
    piece = lambda k: F.sum(F.conv(F.substring("digest", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)"))
    sums = rows.select(*group, digest.alias("digest")).groupBy(*group).agg(F.count("*").alias("n"), *[piece(k).alias(f"s{k}") for k in range(5)])
    return sums.select(*group, F.sha2(F.concat_ws(":", "n", *[F.col(f"s{k}").cast("string") for k in range(5)]), 256).alias("version"))


def deduplicated(pages: DataFrame, group: str, content: Column, order: str) -> DataFrame:
    """The first page, by ``order``, of each content within its group; copies are dropped before they are brought together."""
    row = F.struct(*pages.columns)
    return pages.withColumn("content_key", content).groupBy(group, "content_key").agg(F.min_by(row, order).alias("page")).select("page.*")


def vector_state(vectors: DataFrame, model: str | None = None, group: tuple[str, ...] = ()) -> DataFrame:
    """(group, vectors, updated_at, low, high): number of vectors of ``model``, the latest change as text ('' without any), and the range of dimensions."""
    rows = vectors if model is None else vectors.where(F.col("model") == model)
    latest = F.coalesce(F.date_format(F.max("updated_at"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(""))
    return rows.groupBy(*group).agg(F.count("*").alias("vectors"), latest.alias("updated_at"), F.min("dimensions").alias("low"), F.max("dimensions").alias("high"))


def freshness(now: DataFrame, noted: DataFrame, key: str) -> DataFrame:
    """(key, state) of each index: ``fresh`` if the noted state (vectors, updated_at) is that of the vectors, ``stale`` if not, ``missing``
    if none was noted, ``empty`` without vectors; ``mixed`` if vectors have several numbers of dimensions."""
    both = now.alias("a").join(noted.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    same = F.col("a.vectors").eqNullSafe(F.col("b.vectors")) & F.col("a.updated_at").eqNullSafe(F.col("b.updated_at"))
    state = F.when(F.coalesce("a.vectors", F.lit(0)) == 0, "empty").when(F.col("a.low") != F.col("a.high"), "mixed").when(F.col(f"b.{key}").isNull(), "missing").when(same, "fresh").otherwise("stale")
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), state.alias("state"))


def docset_counts(pages: DataFrame, chunks: DataFrame, vectors: DataFrame, model: str, slugs: list[str] | None = None) -> DataFrame:
    """(docset_slug, pages, chunks, vectors) of all docsets or those named: distinct pages, chunks, and chunks with a vector of ``model``."""
    named = lambda df: df if slugs is None else df.where(F.col("docset_slug").isin(slugs))
    p = named(pages).select("docset_slug", "id").distinct().groupBy("docset_slug").agg(F.count("*").alias("pages"))
    embedded = vectors.where(F.col("model") == model).select(F.col("chunk_id").alias("id"), F.lit(1).alias("one")).distinct()
    c = named(chunks).select("docset_slug", "id").distinct().join(embedded, "id", "left").groupBy("docset_slug").agg(F.count("*").alias("chunks"), F.count("one").alias("vectors"))
    return p.join(c, "docset_slug", "full_outer").fillna(0, ["pages", "chunks", "vectors"])


def to_refresh(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` that aren't stored under the same keys, content and model: what has to be embedded."""
    return wanted.join(stored.select(*keys).distinct(), keys, "left_anti")


def backfilled(table: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """``table`` with nulls in ``column`` filled from ``source``."""
    found = source.groupBy(key).agg(F.max(column).alias("found"))
    return table.join(found, key, "left").withColumn(column, F.coalesce(column, "found")).drop("found")
