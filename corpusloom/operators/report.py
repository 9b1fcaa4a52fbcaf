"""Results as JSON, text, XML and aligned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escaped(text: Column) -> Column:
    """With the five signs that HTML and XML give a meaning to written as entities; null as empty."""
    out = F.coalesce(text, F.lit(""))
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def as_json(columns: list[str], camel: dict[str, str] | None = None, drop_nulls: bool = True) -> Column:
    """One JSON object a row; ``camel`` renames fields, keys of maps stay as they are."""
    fields = [F.col(c).alias((camel or {}).get(c, c)) for c in columns]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true" if drop_nulls else "false"})


def as_xml(fields: dict[str, Column], text: Column, tag: str = "result") -> Column:
    """One element a row with attributes and a text; doubles with six digits are the caller's."""
    attributes = [F.concat(F.lit(f' {k}="'), escaped(c.cast("string")), F.lit('"')) for k, c in fields.items()]
    return F.concat(F.lit(f"<{tag}"), *attributes, F.lit(">"), escaped(text), F.lit(f"</{tag}>"))


def as_text(score: Column, title: Column, place: Column, excerpt: Column) -> Column:
    return F.concat(F.format_string("%.6f", score), F.lit("  "), title, F.lit("  "), place, F.lit("\n"), F.coalesce(excerpt, F.lit("")))


def joined(df: DataFrame, column: str, order: str, before: str = "", between: str = "\n", after: str = "") -> DataFrame:
    """One row: all values in order, for results of a bounded size."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda s: s[column])
    return df.agg(F.concat(F.lit(before), F.array_join(items, between), F.lit(after)).alias("output"))


def aligned(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``line``: columns padded to the widest value of each, headings included, two blanks apart."""
    widths = df.agg(*[F.greatest(F.coalesce(F.max(F.char_length(F.col(c).cast("string"))), F.lit(0)), F.lit(len(c))).alias(f"w_{c}") for c in columns])
    cells = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(f"w_{c}"), " ") for c in columns]
    return df.join(F.broadcast(widths)).withColumn("line", F.rtrim(F.concat_ws("  ", *cells))).drop(*[f"w_{c}" for c in columns])
