"""The two hybrid rankers, ordered merges and diversification by page. Order is always an explicit column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

SEMANTIC_SHARE, LEXICAL_SHARE, KEYWORD_ONLY, POOL = 0.7, 0.3, 0.85, 250


def match_kind(semantic: Column, lexical: Column) -> Column:
    return F.when(semantic.isNotNull() & lexical.isNotNull(), "hybrid").when(semantic.isNotNull(), "semantic").otherwise("keyword")


def code_score(semantic: Column, lexical: Column, mode: str = "hybrid") -> Column:
    """Semantic-only and keyword-only modes take that score, or 0; the hybrid blends the cosine, moved to 0..1, with the keyword score."""
    if mode == "semantic":
        return F.coalesce(semantic, F.lit(0.0))
    if mode == "keyword":
        return F.coalesce(lexical, F.lit(0.0))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (semantic + 1.0) / 2.0))
    both = F.lit(SEMANTIC_SHARE) * moved + F.lit(LEXICAL_SHARE) * lexical
    return F.when(semantic.isNotNull() & lexical.isNotNull(), both).when(semantic.isNotNull(), moved).otherwise(F.coalesce(lexical * KEYWORD_ONLY, F.lit(0.0)))


def hybrid_code(semantic: DataFrame, lexical: DataFrame, key: str, limit: int, mode: str = "hybrid") -> DataFrame:
    """(key, semantic, lexical, kind, score): union of (key, cosine) and (key, lexical), by score down and key, cut at ``limit`` (1 to 100)."""
    both = semantic.select(key, F.col("cosine").alias("semantic")).join(lexical.select(key, "lexical"), key, "full_outer")
    scored = both.withColumn("kind", match_kind(F.col("semantic"), F.col("lexical"))).withColumn("score", code_score(F.col("semantic"), F.col("lexical"), mode))
    return scored.orderBy(F.round("score", 9).desc(), key).limit(max(1, min(100, limit)))


def keyword_positions(ranked: DataFrame, key: str, pool: int = POOL) -> DataFrame:
    """The best ``pool`` of (key, rank), with ``pos`` from 0 and ``score`` falling from 1 by 1 / pool a place."""
    best = ranked.orderBy(F.round("rank", 9), key).limit(pool)
    pos = F.row_number().over(Window.orderBy(F.round("rank", 9), key)) - 1
    return best.withColumn("pos", pos).withColumn("score", F.greatest(F.lit(0.0), 1.0 - F.col("pos") / pool))


def diversified(hits: DataFrame, page: list[str], pos: str, limit: int) -> DataFrame:
    """The first hit of each page in the order of ``pos``, then the other hits, cut at ``limit`` and numbered anew from 0.

    ``pos`` is any sortable column without ties. Pages are reduced by an aggregate and only ``limit`` firsts and
    twice as many hits go on, so that neither many hits nor many on one page matter. Null pages are one page.
    """
    every = F.struct(F.col(pos).alias(pos), *[F.col(c) for c in hits.columns if c != pos])
    first = hits.groupBy(*page).agg(F.min_by(every, pos).alias("hit")).select("hit.*").orderBy(pos).limit(limit)
    # at most ``limit`` of the best 2 * limit are among these firsts
    best = hits.orderBy(pos).limit(2 * limit)
    both = first.withColumn("later", F.lit(0)).unionByName(best.withColumn("later", F.lit(1)))
    one = both.groupBy(pos).agg(F.min_by(F.struct("later", *[c for c in hits.columns if c != pos]), "later").alias("hit")).select(pos, "hit.*")
    ordered = one.orderBy("later", pos).limit(limit)
    place = F.row_number().over(Window.orderBy("later", pos)) - 1
    return ordered.withColumn("place", place).drop("later", pos).withColumnRenamed("place", pos)


def merged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both, each key once: those of ``left`` in their order, then those only in ``right``; ``pos`` is numbered anew."""
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    one = both.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("side", "pos"))).where("n = 1").drop("n")
    place = F.row_number().over(Window.orderBy("side", "pos")) - 1
    return one.withColumn("place", place).drop("pos", "side").withColumnRenamed("place", "pos")


def hybrid_docs(semantic: DataFrame, keyword: DataFrame, key: str, page: list[str], limit: int, pool: int = POOL) -> DataFrame:
    """Documentation search: semantic hits by cosine, diversified to the pool; keyword hits that aren't among them come after
    all of these; diversified to ``limit`` (1 to 50). A semantic hit that keywords found too is a hybrid hit.

    ``semantic`` has key, page and cosine of every row of the scope that has a vector, keyword hits included; ``keyword``
    has key, page, pos and score. Result: key, page, kind, score, pos.
    """
    limit = max(1, min(50, limit))
    order = F.struct((-F.round("cosine", 9)).alias("down"), F.col(key).alias("id"))
    scored = materialize(semantic.select(key, *page, F.col("cosine").alias("score"), order.alias("pos")), "scored")
    first = materialize(diversified(scored, page, "pos", pool), "pool")
    keyword = materialize(keyword, "keyword")
    found = keyword.select(key).distinct().withColumn("by_keyword", F.lit(True))
    first = first.join(found, key, "left").withColumn("kind", F.when(F.col("by_keyword"), "hybrid").otherwise("semantic")).drop("by_keyword")
    rest = keyword.select(key, *page, "score", "pos").withColumn("kind", F.lit("keyword"))
    return diversified(merged(first.select(key, *page, "score", "pos", "kind"), rest, key), page, "pos", limit)


def in_order(ids: list, df: DataFrame, key: str) -> DataFrame:
    """The rows of ``ids`` in the order of their first mention, which the new column ``mention`` numbers; ids without a row are
    left out. ``ids`` is a bounded list."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(k, i) for i, k in enumerate(dict.fromkeys(ids))], f"{key} {dict(df.dtypes)[key]}, mention int")
    return df.drop("mention").join(wanted, key).orderBy("mention")
