"""Source trees: discovery, exclusion, size limit, decoding and hashing, as one scan of binary files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import MAX_FILE_BYTES, ignore_rules, is_excluded, is_ignored


def relative(path: str, root: str) -> Column:
    """The path in a column below ``root``, without scheme."""
    bare, top = F.regexp_replace(path, "^[a-z]+:/+", "/"), re.sub("^[a-z]+:/+", "/", root).rstrip("/") + "/"
    return F.when(bare.startswith(top), bare.substr(F.lit(len(top) + 1), F.char_length(bare))).otherwise(bare)


def scan_tree(spark: SparkSession, root: str, ignored: DataFrame | None = None, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, contents, hash, size_bytes, mtime) of the indexable files below ``root``; links to directories aren't followed.

    Left out: excluded names, files above ``max_bytes``, those that hold NUL or aren't UTF-8, and the paths in
    ``ignored`` (path), such as what version control ignores. Sizes and names are tested on the listing, before files
    are read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = listed.where(F.col("length") <= max_bytes).withColumn("rel", relative("path", root)).where(~is_excluded(F.col("rel")))
    if ignored is not None:
        rows = rows.join(ignored.select(F.col("path").alias("rel")).distinct(), "rel", "left_anti")
    return readable(rows.select(F.col("rel").alias("path"), "content", F.col("length").cast("int").alias("size_bytes"), F.col("modificationTime").alias("mtime")))


def ignored_paths(spark: SparkSession, root: str, name: str = ".gitignore") -> DataFrame:
    """(path) of the files below ``root`` that ignore files in their folders, or in those above, leave out; rules nearer to a file come last.

    Ignore files are few and small: one search a level of directories finds them, and their rules become one predicate over the listing.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(relative("path", root).alias("path"))
    depth = every.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 1
    jvm = spark._jvm.org.apache.hadoop
    fs = jvm.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    rules: list[tuple[str, bool]] = []
    top = re.sub("^[a-z]+:/+", "/", root).rstrip("/") + "/"
    for level in range(depth):
        for status in fs.globStatus(jvm.fs.Path("/".join([root.rstrip("/"), *["*"] * level, name]))) or []:
            stream = fs.open(status.getPath())
            try:
                text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
            finally:
                stream.close()
            path = re.sub("^[a-z]+:/+", "/", status.getPath().toString()).removeprefix(top)
            rules += ignore_rules(text, path.rpartition("/")[0])
    return every.where(is_ignored(F.col("path"), rules))


def readable(files: DataFrame) -> DataFrame:
    """Files (path, content, ...) whose bytes are text: decoded contents and the SHA-256 of the bytes."""
    text = F.expr("is_valid_utf8(content)") & ~F.expr("contains(content, X'00')")
    rest = [c for c in files.columns if c not in ("path", "content")]
    return files.where(F.coalesce(text, F.lit(False))).select("path", F.decode("content", "UTF-8").alias("contents"), F.sha2("content", 256).alias("hash"), *rest)


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """(path, signature) of all files below ``root`` for comparison with a later one; contents aren't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content")
    return listed.select(relative("path", root).alias("path"), F.concat_ws(":", F.unix_micros("modificationTime"), "length").alias("signature"))
