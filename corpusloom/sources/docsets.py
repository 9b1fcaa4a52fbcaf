"""Docset catalogs, payloads and manifests in JSON."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import to_markdown_udf
from ..functions.paths import source_key
from ..functions.text import page_id
from ..operators.catalog import aliases

SCHEMA_VERSION = 1
ENTRIES = "struct<entries:array<struct<name:string,path:string,type:string>>>"
MANIFEST = "schema_version int, schemaVersion int, updated_at string, updatedAt string, docs map<string,struct<source:string,slug:string,name:string,type:string,content_format:string,contentFormat:string,installed_at:string,installedAt:string,updated_at:string,updatedAt:string,page_count:int,pageCount:int>>"
#: Answers after which a request is tried again, and how often.
RETRIED, RETRIES = frozenset([408, 429]), 2


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Docsets (slug, name, type, version, release, mtime, db_size, aliases) of a JSON array, by slug; rows without name or slug are dropped.

    Aliases may be one string or an array, under ``alias`` or ``aliases``.
    """
    raw = spark.read.text(path, wholetext=True)
    item = "array<struct<name:string,slug:string,type:string,version:string,release:string,mtime:bigint,db_size:bigint,alias:string,aliases:string>>"
    rows = raw.select(F.explode(F.from_json("value", item)).alias("d")).select("d.*")
    text = F.coalesce("aliases", "alias")
    listed = F.coalesce(F.when(text.startswith("["), F.from_json(text, "array<string>")), F.when(text.isNotNull(), F.array(text)))
    kept = rows.where("name is not null and slug is not null and name <> '' and slug <> ''")
    return kept.select("slug", "name", "type", "version", "release", "mtime", "db_size", aliases(listed, True).alias("aliases")).orderBy("slug")


def fetch(url: str, opener: Callable = urllib.request.urlopen, wait: float = 0.5) -> bytes:
    """The body of an answer; tried again after time-outs, throttling, server and connection errors, each time later."""
    for attempt in range(RETRIES + 1):
        try:
            with opener(url) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            if attempt == RETRIES or not (e.code in RETRIED or e.code >= 500):
                raise
        except (urllib.error.URLError, TimeoutError):
            if attempt == RETRIES:
                raise
        time.sleep(wait * (attempt + 1))
    raise AssertionError


def download(url: str, target: str, sha256: str | None = None, opener: Callable = urllib.request.urlopen, wait: float = 0.5, piece: int = 1 << 20) -> str:
    """Stream an answer to the file ``target``; its SHA-256. The file appears at once, when all of it is there and has the digest asked for."""
    part = f"{target}.part-{os.getpid()}"
    for attempt in range(RETRIES + 1):
        try:
            digest = hashlib.sha256()
            with opener(url) as answer, open(part, "wb") as out:
                while data := answer.read(piece):
                    digest.update(data)
                    out.write(data)
            if sha256 is not None and digest.hexdigest() != sha256.lower():
                raise ValueError(f"{url} has the digest {digest.hexdigest()}")
            os.replace(part, target)
            return digest.hexdigest()
        except urllib.error.HTTPError as e:
            if attempt == RETRIES or not (e.code in RETRIED or e.code >= 500):
                raise
        except (urllib.error.URLError, TimeoutError):
            if attempt == RETRIES:
                raise
        finally:
            if os.path.exists(part):
                os.remove(part)
        time.sleep(wait * (attempt + 1))
    raise AssertionError


def catalog_or_copy(load: Callable[[], bytes], copy: Callable[[], bytes | None], offline: bool = False) -> tuple[list, str | None]:
    """The catalog, from its source or else from a kept copy with a warning; offline only the copy counts."""
    if not offline:
        try:
            return json.loads(load()), None
        except Exception as e:
            kept = copy()
            if kept is None:
                raise
            return json.loads(kept), f"the catalog could not be loaded, a copy is used: {e}"
    kept = copy()
    if kept is None:
        raise FileNotFoundError("offline, and there is no copy of the catalog")
    return json.loads(kept), None


def pages_of(payloads: DataFrame) -> DataFrame:
    """(slug, id, name, path, type, file, source_key, markdown) from payloads (slug, index, db): entries of an index with the
    HTML that the db maps their key, or else their path, to. Entries without path or HTML are left out."""
    entries = payloads.select("slug", F.posexplode(F.from_json("index", ENTRIES)["entries"]).alias("pos", "e")).select("slug", "pos", "e.*").where("path is not null")
    db = payloads.select("slug", F.explode(F.from_json("db", "map<string,string>")).alias("key", "html")).where("html <> ''")
    keyed = entries.withColumn("source_key", source_key(F.col("path"))).withColumn("name", F.coalesce("name", "path"))
    a = keyed.join(db.withColumnRenamed("key", "source_key"), ["slug", "source_key"], "left")
    both = a.join(db.withColumnsRenamed({"key": "path", "html": "by_path"}), ["slug", "path"], "left").withColumn("html", F.coalesce("html", "by_path")).where("html is not null")
    id_ = page_id(F.col("path"), F.col("name"))
    return both.select("slug", "pos", id_.alias("id"), "name", "path", "type", F.concat(F.lit("pages/"), id_, F.lit(".md")).alias("file"), "source_key", to_markdown_udf("name", "path", "html").alias("markdown"))


def manifest(text: Column) -> Column:
    """A cache manifest parsed, either spelling of its fields; null for text that is none or of another schema version."""
    parsed = F.from_json(text, f"struct<{', '.join(p.strip().replace(' ', ':', 1) for p in _fields(MANIFEST))}>")
    version = F.coalesce(parsed["schema_version"], parsed["schemaVersion"])
    return F.when(version == SCHEMA_VERSION, parsed)


def _fields(ddl: str) -> list[str]:
    out, level, start = [], 0, 0
    for i, c in enumerate(ddl):
        level += (c in "<(") - (c in ">)")
        if c == "," and level == 0:
            out.append(ddl[start:i])
            start = i + 1
    return [*out, ddl[start:]]


def manifest_docsets(rows: DataFrame, text: str) -> DataFrame:
    """(slug, source, name, type, content_format, installed_at, updated_at, page_count) of all docsets in cache manifests."""
    docs = rows.select(manifest(F.col(text)).alias("m")).where("m is not null").select(F.explode("m.docs").alias("slug", "d"))
    both = lambda a, b: F.coalesce(f"d.{a}", f"d.{b}").alias(a)
    return docs.select("slug", "d.source", "d.name", "d.type", both("content_format", "contentFormat"), both("installed_at", "installedAt"), both("updated_at", "updatedAt"), both("page_count", "pageCount"))
