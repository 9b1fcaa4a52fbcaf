"""The catalog of docsets: aliases, versions and the scope of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: names that people use for docsets.
CURATED = {"node.js": "node", "nodejs": "node", "react-native": "react_native", "reactnative": "react_native", "reactjs": "react", "rn": "react_native"}


def identifier(value: Column) -> Column:
    return F.lower(F.trim(value))


def aliases(value: Column, is_array: bool) -> Column:
    """Normalised aliases from a string or an array of strings, without blank ones; null gives an empty array."""
    items = value if is_array else F.when(value.isNotNull(), F.array(value))
    items = F.filter(F.transform(items, identifier), lambda a: a != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def version_key(slug: Column, version: Column) -> Column:
    """Unversioned slugs first, then by the numbers of the version, compared one by one: greater is preferred."""
    text = F.coalesce(F.when(version != "", version), F.when(slug.contains("~"), F.regexp_extract(slug, "~(.*)$", 1)), F.lit(""))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda n: n.cast("bigint"))
    return F.struct((~slug.contains("~")).cast("int").alias("plain"), numbers.alias("numbers"))


def resolved(requests: DataFrame, docsets: DataFrame, request: str = "request") -> DataFrame:
    """(request, slug) of the docset each request means: by slug, else alias, else curated name, else name or type.

    ``docsets``: slug, name, type, version, aliases (array). Among docsets of one kind of match the preferred version
    wins. Requests that nothing matches are left out.
    """
    wanted = requests.select(request, identifier(F.col(request)).alias("want")).distinct()
    base = docsets.select("slug", version_key(F.col("slug"), F.col("version")).alias("rank"), "name", "type", aliases(F.col("aliases"), True).alias("aliases"))
    ways = [
        base.select("slug", "rank", identifier(F.col("slug")).alias("want"), F.lit(0).alias("way")),
        base.select("slug", "rank", F.explode("aliases").alias("want"), F.lit(1).alias("way")),
        base.select("slug", "rank", F.explode(F.filter(F.array(*[F.when(F.col("slug") == s, F.lit(a)) for a, s in CURATED.items()]), lambda a: a.isNotNull())).alias("want"), F.lit(2).alias("way")),
        base.select("slug", "rank", F.explode(F.array(identifier(F.col("name")), identifier(F.coalesce("type", "slug")))).alias("want"), F.lit(3).alias("way")),
    ]
    known = ways[0].unionByName(ways[1]).unionByName(ways[2]).unionByName(ways[3])
    hits = wanted.join(known, "want").groupBy(request, "way").agg(F.max(F.struct("rank", "slug")).alias("best"))
    return hits.groupBy(request).agg(F.min_by("best.slug", "way").alias("slug"))


def preferred(docsets: DataFrame, group: list[str]) -> DataFrame:
    """(group, slug): the preferred docset of each group."""
    return docsets.groupBy(*group).agg(F.max(F.struct(version_key(F.col("slug"), F.col("version")).alias("rank"), "slug")).alias("best")).select(*group, F.col("best.slug").alias("slug"))


def requested_names(value: str | list[str] | None) -> list[str]:
    """Names from filter values that may be joined by commas."""
    values = [value] if isinstance(value, str) else value or []
    return list(dict.fromkeys(p.strip() for v in values for p in v.split(",") if p.strip()))


def in_scope(rows: DataFrame, docsets: DataFrame, names: list[str], slug: str = "docset_slug") -> DataFrame:
    """Rows of the docsets that ``names`` mean. Without names all rows; names that nothing matches give no rows."""
    if not names:
        return rows
    spark = rows.sparkSession
    wanted = resolved(spark.createDataFrame([(n,) for n in names], "request string"), docsets)
    return rows.join(wanted.select(F.col("slug").alias(slug)).distinct(), slug, "left_semi")


def is_current(installed: DataFrame, catalog: DataFrame) -> DataFrame:
    """(slug, current): an installed docset is current if its time is not older, or, where one is unknown, release and version agree."""
    a, b = installed.alias("a"), catalog.alias("b")
    both = a.join(b, F.col("a.slug") == F.col("b.slug"))
    by_time = F.col("a.mtime") >= F.col("b.mtime")
    same = F.col("a.release").eqNullSafe(F.col("b.release")) & F.col("a.version").eqNullSafe(F.col("b.version"))
    return both.select(F.col("a.slug").alias("slug"), F.coalesce(by_time, same).alias("current"))
