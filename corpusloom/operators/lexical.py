"""Keyword search: tokens, postings and BM25 over prefixes and phrases.

The score of a row is the sum over phrases of ``idf * f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avgdl))`` with
``idf = ln((N - n + 0.5) / (n + 0.5))``, or 1e-6 where that isn't positive; ranks are its negative, so that lower is
better. Counts are of the whole corpus, whatever filter applies to the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import fold, folded, index_tokens
from ..session import drop_materialized, materialize

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


LETTER = r"[\p{L}\p{N}]"


def phrases(terms: list[str]) -> list[list[str]]:
    """Each term folded and split as the index folds and splits text: one prefix, or words of which the last is a prefix."""
    split = [("".join(c if c.isalnum() else " " for c in fold(term))).split() for term in terms]
    return [words for words in split if words]


def occurrences(text: Column, words: list[str]) -> Column:
    """How often a phrase begins in a folded text; its last word is a prefix. Words of letters and digits need no quoting."""
    later = "".join(f"[^\\p{{L}}\\p{{N}}]+{w}" for w in words[1:])
    # the word itself comes first, as a literal is found fastest
    return F.regexp_count(text, F.lit(f"{words[0]}(?<!{LETTER}{words[0]})" + (f"(?={later})" if later else "")))


def bm25(df: DataFrame, key: str, columns: list[str], terms: list[str], scope: Column | None = None) -> DataFrame:
    """(key, rank) of the rows of ``df`` that hold any of the terms, and that ``scope`` admits.

    One scan counts phrases and tokens in each row; only these counts, a few numbers a row, are freed of repeated rows
    and written, and the corpus counts, one row, are made from them. Rows repeated unchanged count once, null columns
    are empty. Terms without letters or digits are left out; without terms there are no rows.
    """
    sought = phrases(terms)
    names = [f"f{i}" for i in range(len(sought))]
    kept = df.withColumn("in_scope", F.lit(True) if scope is None else F.coalesce(scope, F.lit(False)))
    if not sought:
        return kept.where("false").select(key, F.lit(0.0).alias("rank"))
    texts = [f"text{i}" for i in range(len(columns))]
    plain = kept.select(key, "in_scope", *[folded(F.col(c)).alias(t) for c, t in zip(columns, texts)])
    total = lambda count: reduce(lambda a, b: a + b, [count(F.col(t)) for t in texts])
    length = total(lambda t: F.regexp_count(t, F.lit(LETTER + "+")))
    rows = plain.select(key, "in_scope", length.alias("dl"), *[total(lambda t: occurrences(t, w)).alias(n) for w, n in zip(sought, names)])
    rows = materialize(rows.distinct(), "counts")
    corpus = rows.agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(n) > 0).alias(f"n_{n}") for n in names])
    hit = reduce(lambda a, b: a | b, [F.col(n) > 0 for n in names])
    score = reduce(lambda a, b: a + b, [_part(F.col(n), F.col(f"n_{n}")) for n in names])
    return rows.where(hit & F.col("in_scope")).join(F.broadcast(corpus)).select(key, (-score).alias("rank"))


def _part(f: Column, n: Column) -> Column:
    idf = F.log((F.col("n_rows") - n + 0.5) / (n + 0.5))
    idf = F.when(idf > 0, idf).otherwise(LEAST_IDF)
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def top(ranked: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` best rows by rank, ties by key."""
    return ranked.orderBy(F.round("rank", 9), key).limit(limit)


def code_fetch(limit: int) -> int:
    """How many rows a code query fetches by keyword."""
    return max(50, min(500, 20 * limit))


def tokens_of(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, tokens): an array of tokens for each column."""
    return df.select(key, F.array(*[index_tokens(F.col(c)) for c in columns]).alias("tokens"))


def postings(tokens: DataFrame, key: str) -> DataFrame:
    """(term, key, col, pos) of (key, tokens): one row an occurrence of a token."""
    placed = F.transform("tokens", lambda words, k: F.transform(words, lambda t, i: F.struct(k.alias("col"), i.alias("pos"), t.alias("term"))))
    return tokens.select(key, F.explode(F.flatten(placed)).alias("t")).select("t.term", key, "t.col", "t.pos")


def lengths(tokens: DataFrame, key: str) -> DataFrame:
    """(key, dl) of (key, tokens): how many tokens each row has."""
    return tokens.select(key, F.aggregate("tokens", F.lit(0), lambda n, words: n + F.size(words)).alias("dl"))


def write_index(df: DataFrame, key: str, columns: list[str], path: str) -> None:
    """Write the index of ``df``, which has each key once: ``terms``, sorted by term over all files, and ``rows`` with their lengths.

    Texts are split once, into a table of their own, which both are made from.
    """
    tokens = materialize(tokens_of(df, key, columns), "tokens")
    postings(tokens, key).repartitionByRange("term").sortWithinPartitions("term", key).write.mode("overwrite").parquet(f"{path}/terms")
    lengths(tokens, key).write.mode("overwrite").parquet(f"{path}/rows")
    drop_materialized(tokens)


def search_index(spark: SparkSession, path: str, key: str, terms: list[str]) -> DataFrame:
    """(key, rank) from a written index, as :func:`bm25` gives them for the whole table."""
    return bm25_of_postings(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/rows"), key, terms)


def bm25_of_postings(index: DataFrame, row_lengths: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key, rank) from postings and lengths. Terms are ranges of the index's sort order, so that files and row groups are pruned by them."""
    sought = phrases(terms)
    if not sought:
        return row_lengths.where("false").select(key, F.lit(0.0).alias("rank"))
    corpus = row_lengths.agg(F.count("*").alias("n_rows"), F.avg("dl").alias("avgdl"))
    parts = []
    for i, words in enumerate(sought):
        last = words[-1]
        below = F.col("term") < last[:-1] + chr(ord(last[-1]) + 1)
        found = index.where((F.col("term") >= last) & below).select(key, "col", F.col("pos").alias("p"))
        for back, word in enumerate(reversed(words[:-1]), start=1):
            earlier = index.where(F.col("term") == word).select(key, "col", (F.col("pos") + back).alias("p"))
            found = found.join(earlier, [key, "col", "p"])
        parts.append(found.select(key, F.lit(i).alias("phrase")))
    hits = reduce(DataFrame.unionByName, parts).groupBy(key).agg(*[F.count_if(F.col("phrase") == i).alias(f"f{i}") for i in range(len(sought))])
    hits = materialize(hits, "hits")
    seen = hits.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n_f{i}") for i in range(len(sought))])
    score = reduce(lambda a, b: a + b, [_part(F.col(f"f{i}"), F.col(f"n_f{i}")) for i in range(len(sought))])
    return hits.join(row_lengths, key).join(F.broadcast(seen)).join(F.broadcast(corpus)).select(key, (-score).alias("rank"))


def minmax(ranked: DataFrame, rank: str = "rank") -> DataFrame:
    """``ranked`` with ``lexical``: 1 for the best rank and 0 for the worst of the rows there are; 1 for all if they are equal."""
    ends = ranked.agg(F.min(rank).alias("low"), F.max(rank).alias("high"))
    spread = F.col("high") - F.col("low")
    score = F.when(spread == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (F.col(rank) - F.col("low")) / spread)))
    return ranked.join(F.broadcast(ends)).withColumn("lexical", score).drop("low", "high")
