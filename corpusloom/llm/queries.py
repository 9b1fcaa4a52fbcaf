"""Queries over the project's tables for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental
from ..session import materialize, spread
from ..tables import table
from . import bpe, components, handwritten, markup, neighbours, packing, reading, splitting, syntax

CONTAINER_TOKENS = 2048
LINK_SIMILARITY = 0.92


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.check_files(spread(table(spark, sf_dir, "source_files")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).where("not sound").select("path")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.rates(_checked(spark, sf_dir))


def p1_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = incremental.present_rows(table(spark, sf_dir, "files").withColumn("s", F.struct("status", "error")), ["path"], "s").select("path", "s.status", "s.error")
    return syntax.against_index(_checked(spark, sf_dir), present, table(spark, sf_dir, "code_units"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = []
    for name in ("unit_embeddings", "chunk_embeddings"):
        vectors = neighbours.usable_vectors(table(spark, sf_dir, name), "vec_id", "vector")
        pairs.append(neighbours.neighbour_pairs(neighbours.nearest_neighbours(vectors)))
    return pairs[0].unionByName(pairs[1])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "duplicate_pairs")
    return components.connected_components(components.links(pairs, "unit_id_a", "unit_id_b", "similarity", LINK_SIMILARITY))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_chunks(spread(table(spark, sf_dir, "search_chunks")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_clean(spark, sf_dir).select("chunk_id", F.explode("kinds").alias("markup"))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_chunks(spread(table(spark, sf_dir, "search_chunks")), table(spark, sf_dir, "embeddings_config"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).where("oversized and piece = 0").select("chunk_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.cap_pages(_split(spark, sf_dir), splitting.largest_cap(table(spark, sf_dir, "embeddings_config")))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = handwritten.not_by_hand(spread(table(spark, sf_dir, "source_files")))
    return handwritten.found_files(materialize(judged, "judged"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("path")


def p7_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of files that were not written by hand, with the kind of file."""
    units = table(spark, sf_dir, "code_units").select("id", F.col("file_path").alias("path")).distinct()
    return units.join(_judged(spark, sf_dir), "path").select("id", "path", "kind", "reason")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(spread(table(spark, sf_dir, "documents", ["doc_id", "text"])), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = bpe.token_counts(spread(table(spark, sf_dir, "documents", ["doc_id", "text"])), "doc_id", "text")
    return packing.pack(counts, "doc_id", "n_tokens", CONTAINER_TOKENS)


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.levels(spread(table(spark, sf_dir, "documents", ["doc_id", "text"])), table(spark, sf_dir, "reading_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_levels(spark, sf_dir).where("english and level >= 4").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in (p1_found, p1_rates, p1_index, p2_found, p3_found, p4_clean, p4_found, p5_found, p5_pieces, p7_found, p7_units, p8_ids, p9_containers, p10_levels, p10_found)}


#: White space that Python strips, for the SQL engine.
WS = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
USABLE_SQL = "len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"


def _neighbours_sql(table_name: str) -> str:
    return f"""SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM (
SELECT a, b FROM (SELECT *, sum(apart) OVER (PARTITION BY a ORDER BY c DESC, b) AS level FROM (
SELECT *, CASE WHEN lag(c) OVER (PARTITION BY a ORDER BY c DESC, b) - c >= 1e-9 THEN 1 ELSE 0 END AS apart FROM (
SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.v, y.v) AS c FROM {table_name}_v x JOIN {table_name}_v y ON x.vec_id <> y.vec_id)))
QUALIFY row_number() OVER (PARTITION BY a ORDER BY level, b) <= 5)"""


def _vectors_sql(table_name: str) -> str:
    return f"{table_name}_v AS (SELECT vec_id, any_value(vector)::DOUBLE[] AS v FROM {table_name} WHERE {USABLE_SQL} GROUP BY vec_id)"


P2_FOUND_SQL = f"WITH {_vectors_sql('unit_embeddings')}, {_vectors_sql('chunk_embeddings')} {_neighbours_sql('unit_embeddings')} UNION ALL {_neighbours_sql('chunk_embeddings')}"

P3_FOUND_SQL = f"""WITH RECURSIVE l AS (SELECT unit_id_a AS a, unit_id_b AS b FROM duplicate_pairs WHERE unit_id_a <> unit_id_b AND similarity IS NOT NULL AND NOT isnan(similarity) AND similarity >= {LINK_SIMILARITY}),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS unit_id, min(b) AS group_id FROM r GROUP BY a"""

P5_FOUND_SQL = f"""WITH c AS (SELECT DISTINCT id, docset_slug, text FROM search_chunks)
SELECT id AS chunk_id FROM c LEFT JOIN embeddings_config USING (docset_slug)
WHERE length(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g')) > coalesce(max_chunk_chars, 2400)"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND_SQL, "p3_found": P3_FOUND_SQL, "p5_found": P5_FOUND_SQL}
