"""Whole operations on written tables: the indexing loop over files, purges, leases, and docsets that come and go."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codeunits
from ..operators import catalog, embedding, queueing, store
from ..session import drop_materialized, drop_path, materialize
from ..sources import docsets

#: Buckets of files by a hash of their path; a commit rewrites the buckets of its files.
BUCKETS = 16


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def acquire(spark: SparkSession, path: str, me: str, now: float, seconds: int = queueing.LEASE_SECONDS) -> bool:
    """Whether ``me`` has the lease stored in the file ``path`` after asking at ``now``: free, own and expired ones are given.

    The file is made exclusively: of several that find it free or expired, one gets it.
    """
    fs, p = _fs(spark, path)
    held = None
    if fs.exists(p):
        stream = fs.open(p)
        try:
            held = tuple(json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()
    wanted, given = queueing.lease(held, me, now, seconds)
    if not given:
        return False
    if held is not None:
        fs.delete(p, False)
    try:
        out = fs.create(p, False)
    except Exception:  # another one was faster
        return False
    out.write(bytearray(json.dumps(wanted).encode()))
    out.close()
    return True


class _Tables:
    """Parquet tables under one folder, each in partitions that are replaced as wholes."""

    schemas: dict[str, str] = {}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        fs, p = _fs(self.spark, f"{self.path}/{name}")
        if not fs.exists(p):
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def replace(self, name: str, rows: DataFrame, partition: str, values: list) -> None:
        """The partitions ``values`` hold ``rows`` and nothing else; those without rows are dropped."""
        made = materialize(rows, name)
        store.replace_partition(made, f"{self.path}/{name}", partition)
        full = {r[0] for r in made.select(partition).distinct().collect()}
        for value in values:
            if value not in full:
                drop_path(self.spark, f"{self.path}/{name}/{partition}={value}")
        drop_materialized(made)


class Index(_Tables):
    """Files, code units and their vectors, kept up by batches of paths."""

    schemas = {
        "files": "path string, hash string, status string, error string, bucket int",
        "units": "id string, file_path string, start_line int, end_line int, start_byte int, end_byte int, unit_type string, name string, source string, source_hash string, language string, parser_key string, bucket int",
        "vectors": "unit_id string, file_path string, vector array<double>, dimensions int, norm double, bucket int",
    }

    def run(self, paths: list[str], read: Callable[[list[str]], DataFrame], embedder: Callable[[list[str]], list[list[float]]]) -> dict[str, str]:
        """One batch: prepare units of the files, embed them, look at the files again, and commit what is still the same.

        ``read`` gives (path, contents) of the paths that are there. Outcome of each path: ``indexed``; ``requeued`` if it
        changed meanwhile, which leaves its rows as they were; ``deleted`` if it is gone; ``error`` if a batch with it has no
        vectors and it alone hasn't either, which is noted. At most BATCH_ITEMS paths.
        """
        paths = list(dict.fromkeys(paths))[: queueing.BATCH_ITEMS]
        with_hash = lambda df: df.select("path", "contents", F.sha2("contents", 256).alias("hash"))
        before = materialize(with_hash(read(paths)), "prepared")
        found = {r["path"]: r["hash"] for r in before.select("path", "hash").collect()}
        units = materialize(codeunits.parse_files(before.select("path", "contents")), "units")
        errors: dict[str, str] = {}
        texts = [(r["id"], r["file_path"], r["source"]) for r in units.select("id", "file_path", "source").orderBy("file_path", "start_byte", "id").collect()]  # a bounded batch
        vectors = self._embed(texts, embedder, errors)
        now = {r["path"]: r["hash"] for r in with_hash(read(paths)).select("path", "hash").collect()}
        outcome = {p: "deleted" if p not in now else "error" if p in errors else "indexed" if found.get(p) == now[p] else "requeued" for p in paths}
        good, gone = [p for p in paths if outcome[p] == "indexed"], [p for p in paths if outcome[p] == "deleted"]
        bad = [p for p in paths if outcome[p] == "error"]
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int").alias("bucket")
        settled = good + gone + bad
        if settled:
            marks = self.spark.createDataFrame([(p, found.get(p), outcome[p], errors.get(p)) for p in settled], "path string, hash string, status string, error string").select("*", bucket("path"))
            touched = sorted(r[0] for r in marks.select("bucket").distinct().collect())
            old = lambda name, key: self.read(name).where(F.col("bucket").isin(touched)).join(marks.select(F.col("path").alias(key)), key, "left_anti")
            fresh = units.where(F.col("file_path").isin(good)).select("*", bucket("file_path"))
            made = self.spark.createDataFrame([(i, f, v, len(v), sum(x * x for x in v) ** 0.5) for i, f, v in vectors if f in set(good)], "unit_id string, file_path string, vector array<double>, dimensions int, norm double").select("*", bucket("file_path"))
            for name, rows in (("vectors", old("vectors", "file_path").unionByName(made)), ("units", old("units", "file_path").unionByName(fresh)), ("files", old("files", "path").unionByName(marks.where("status <> 'deleted'")))):
                self.replace(name, rows, "bucket", touched)
        for used in (before, units):
            drop_materialized(used)
        return outcome

    def _embed(self, texts: list[tuple[str, str, str]], embedder: Callable, errors: dict[str, str]) -> list[tuple[str, str, list[float]]]:
        """Vectors of (id, file, text); a request that fails is made again file by file, to find the files that can't be embedded."""
        out: list[tuple[str, str, list[float]]] = []

        def ask(part: list[tuple[str, str, str]]) -> list[tuple[str, str, list[float]]]:
            answer = [{"index": i, "embedding": list(v)} for i, v in enumerate(embedder([t for _, _, t in part]))]
            return [(i, f, v) for (i, f, _), v in zip(part, embedding.checked_vectors(answer, len(part)))]

        for a, b in embedding.request_ranges([t for _, _, t in texts], *embedding.CODE_REQUEST):
            part = texts[a:b]
            try:
                out += ask(part)
            except Exception:
                for file in dict.fromkeys(f for _, f, _ in part):
                    try:
                        out += ask([t for t in part if t[1] == file])
                    except Exception as e:
                        errors[file] = str(e)
        return [v for v in out if v[1] not in errors]

    def purge(self, skipped: Column) -> int:
        """Drop the files for which ``skipped``, a test of ``path``, holds, with their units and vectors; how many files."""
        gone = materialize(self.read("files").where(skipped).select("path", "bucket"), "gone")
        touched = sorted(r[0] for r in gone.select("bucket").distinct().collect())
        for name, key in (("vectors", "file_path"), ("units", "file_path"), ("files", "path")):
            if touched:
                self.replace(name, self.read(name).where(F.col("bucket").isin(touched)).join(gone.select(F.col("path").alias(key)), key, "left_anti"), "bucket", touched)
        n = gone.count()
        drop_materialized(gone)
        return n


class Shelf(_Tables):
    """Installed docsets and their pages."""

    schemas = {
        "docsets": "slug string, mtime bigint, release string, version string, page_count int, docset_slug string",
        "pages": "id string, name string, path string, type string, file string, source_key string, content_hash string, markdown string, docset_slug string",
    }

    def install(self, slug: str, known: DataFrame, payload: DataFrame, force: bool = False) -> bool:
        """Install a docset of the catalog ``known`` from its payload (slug, index, db); whether anything was done. A current one is left
        alone unless ``force``. Of pages with equal contents the first is kept. Pages come before the entry that names them."""
        entry = known.where(F.col("slug") == slug).select("slug", "mtime", "release", "version").first()
        if entry is None:
            raise KeyError(f"no docset {slug}")
        have = self.read("docsets").where(F.col("slug") == slug)
        if not force and catalog.is_current(have, known).where("current").count():
            return False
        pages = docsets.pages_of(payload.where(F.col("slug") == slug)).withColumn("content_hash", F.sha2("markdown", 256))
        first = store.deduplicated(pages, "slug", F.col("content_hash"), "pos")
        rows = materialize(first.select("id", "name", "path", "type", "file", "source_key", "content_hash", "markdown", F.lit(slug).alias("docset_slug")), "pages")
        n = rows.count()
        self.replace("pages", rows, "docset_slug", [slug])
        made = self.spark.createDataFrame([(*entry, n, slug)], self.schemas["docsets"])
        self.replace("docsets", made, "docset_slug", [slug])
        drop_materialized(rows)
        return True

    def update(self, known: DataFrame, load: Callable[[str], DataFrame]) -> list[str]:
        """Install anew what is installed and no longer current by the catalog; the slugs."""
        old = [r["slug"] for r in catalog.is_current(self.read("docsets"), known).where("not current").orderBy("slug").collect()]
        for slug in old:
            self.install(slug, known, load(slug), force=True)
        return old

    def remove(self, slug: str) -> int:
        """Drop a docset, its entry first; how many pages it had."""
        n = self.read("pages").where(F.col("docset_slug") == slug).count()
        for name in ("docsets", "pages"):
            store.remove_partition(self.spark, f"{self.path}/{name}", "docset_slug", slug)
        return n
