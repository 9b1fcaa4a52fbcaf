"""Queries over the project's tables for the core operators, each with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, codeunits, html, paths, terms, text
from ..functions.excerpt import excerpt_column
from ..operators import catalog, duplicates, embedding, incremental, lexical, queueing, ranking, report, store, vectors
from ..session import materialize, new_path, spread
from ..tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


DOCS_QUERY = "How do I install the nested modules?"
CODE_QUERY = "total_item config loader"
PHRASE_TERMS = ["the_resp", "older_vers"]
ACCENTED_TERMS = ["Prüfe", "requête", "página"]
#: The prefixes and phrases of these queries, written out for the SQL engine.
DOCS_WORDS = [["install"], ["nested"], ["modules"], ["module"]]
CODE_WORDS = [["total"], ["item"], ["config"], ["loader"]]
PHRASE_WORDS = [["the", "resp"], ["older", "vers"]]
ACCENTED_WORDS = [["prufe"], ["requete"], ["pagina"]]
#: White space that Python strips, for the SQL engine.
WS = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_normal(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '\\r\\n?', chr(10), 'g'), '^{WS}+|{WS}+$', '', 'g')"


def sql_tokens(t: str) -> str:
    return f"list_filter(string_split_regex(strip_accents(lower(coalesce({t}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def sql_bm25(source: str, key: str, columns: list[str], sought: list[list[str]], scope: str = "TRUE") -> str:
    """CTEs up to ``ranked`` (key, rank): the same formula over the same corpus counts."""
    counts = []
    for i, words in enumerate(sought):
        parts = []
        for k in range(len(columns)):
            if len(words) == 1:
                parts.append(f"len(list_filter(t{k}, lambda t: starts_with(t, '{words[0]}')))")
            else:
                inner = " AND ".join([f"t{k}[i + {j}] = '{w}'" for j, w in enumerate(words[:-1])] + [f"starts_with(t{k}[i + {len(words) - 1}], '{words[-1]}')"])
                parts.append(f"len(list_filter(range(1, greatest(len(t{k}) - {len(words) - 2}, 1)), lambda i: {inner}))")
        counts.append(f"{' + '.join(parts)} AS f{i}")
    n = len(counts)
    part = lambda i: f"(CASE WHEN ln((n_rows - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n_rows - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))"
    return f"""
WITH src AS ({source}),
tok AS (SELECT *, {', '.join(f'{sql_tokens(c)} AS t{k}' for k, c in enumerate(columns))} FROM src),
cnt AS (SELECT *, {' + '.join(f'len(t{k})' for k in range(len(columns)))} AS dl, {', '.join(counts)} FROM tok),
corpus AS (SELECT count(*) AS n_rows, avg(dl) AS avgdl, {', '.join(f'count(*) FILTER (WHERE f{i} > 0) AS n{i}' for i in range(n))} FROM cnt),
ranked AS (SELECT {key}, -({' + '.join(part(i) for i in range(n))}) AS rank FROM cnt, corpus WHERE ({' OR '.join(f'f{i} > 0' for i in range(n))}) AND ({scope}))
"""


CHUNKS_SQL = "SELECT DISTINCT id, docset_slug, page_id, ordinal, text FROM search_chunks"
UNITS_SQL = "SELECT DISTINCT id, file_path, unit_type, name, source, language, start_line FROM code_units"
DOC_TERMS = terms.expanded_terms(terms.docs_terms(DOCS_QUERY))
CODE_TERMS = terms.code_tokens(CODE_QUERY)
DOCS_SCOPE = ["brackenlib", "quarry", "wicket"]
SCOPE_SQL = "docset_slug IN ('brackenlib', 'quarry', 'wicket')"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as delivered, repeated rows included."""
    return spread(table(spark, d, "search_chunks", ["id", "docset_slug", "page_id", "ordinal", "text"]))


def _chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "search_chunks", ["id", "docset_slug", "page_id"]).distinct()


def _units(spark: SparkSession, d: str) -> DataFrame:
    """Units as delivered, repeated rows included."""
    return spread(table(spark, d, "code_units", ["id", "file_path", "unit_type", "name", "source", "language", "start_line"]))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# keyword search
@query(sql_bm25(CHUNKS_SQL, "id", ["text"], DOCS_WORDS) + "SELECT id, round(rank, 6) AS rank FROM ranked ORDER BY round(rank, 9), id LIMIT 250")
def keyword_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(lexical.top(lexical.bm25(_chunks(spark, d), "id", ["text"], DOC_TERMS), "id", 250), "rank")


@query(sql_bm25(UNITS_SQL, "id", ["unit_type", "name", "source"], CODE_WORDS) + "SELECT id, round(rank, 6) AS rank FROM ranked ORDER BY round(rank, 9), id LIMIT 200")
def keyword_bm25_multicol(spark: SparkSession, d: str) -> DataFrame:
    ranked = lexical.bm25(_units(spark, d), "id", ["unit_type", "name", "source"], CODE_TERMS)
    return _rounded(lexical.top(ranked, "id", lexical.code_fetch(10)), "rank")


@query(sql_bm25(CHUNKS_SQL, "id", ["text"], DOCS_WORDS, SCOPE_SQL) + "SELECT id, round(rank, 6) AS rank FROM ranked")
def keyword_scoped(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(lexical.bm25(_chunks(spark, d), "id", ["text"], DOC_TERMS, F.col("docset_slug").isin(DOCS_SCOPE)).select("id", "rank"), "rank")


@query(sql_bm25(CHUNKS_SQL, "id", ["text"], PHRASE_WORDS) + "SELECT id, round(rank, 6) AS rank FROM ranked")
def keyword_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(lexical.bm25(_chunks(spark, d), "id", ["text"], PHRASE_TERMS), "rank")


@query(sql_bm25(CHUNKS_SQL, "id", ["text"], DOCS_WORDS) + "SELECT id, round(rank, 6) AS rank FROM ranked")
def keyword_postings(spark: SparkSession, d: str) -> DataFrame:
    """The same ranks from a written index."""
    path = new_path(spark, "index")
    chunks = _chunks(spark, d).groupBy("id").agg(F.min("text").alias("text"))
    lexical.write_index(chunks, "id", ["text"], path)
    return _rounded(lexical.search_index(spark, path, "id", DOC_TERMS), "rank")


@query(sql_bm25("SELECT doc_id, text FROM documents", "doc_id", ["text"], ACCENTED_WORDS) + "SELECT doc_id, round(rank, 6) AS rank FROM ranked")
def keyword_accented(spark: SparkSession, d: str) -> DataFrame:
    """Terms with diacritics find words with and without them."""
    return _rounded(lexical.bm25(spread(table(spark, d, "documents", ["doc_id", "text"])), "doc_id", ["text"], ACCENTED_TERMS), "rank")


@query(sql_bm25(CHUNKS_SQL, "id", ["text"], DOCS_WORDS) + """, best AS (SELECT * FROM ranked ORDER BY round(rank, 9), id LIMIT 250)
SELECT id, row_number() OVER (ORDER BY round(rank, 9), id) - 1 AS pos, round(greatest(0, 1 - (row_number() OVER (ORDER BY round(rank, 9), id) - 1) / 250.0), 6) AS score FROM best""")
def keyword_rank_score(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ranking.keyword_positions(lexical.bm25(_chunks(spark, d), "id", ["text"], DOC_TERMS), "id").select("id", F.col("pos").cast("bigint").alias("pos"), "score"), "score")


@query(sql_bm25(UNITS_SQL, "id", ["unit_type", "name", "source"], CODE_WORDS) + """, best AS (SELECT * FROM ranked ORDER BY round(rank, 9), id LIMIT 200), e AS (SELECT min(rank) AS lo, max(rank) AS hi FROM best)
SELECT id, round(CASE WHEN hi - lo = 0 THEN 1.0 ELSE greatest(0, least(1, 1 - (rank - lo) / (hi - lo))) END, 6) AS lexical FROM best, e""")
def lexical_minmax(spark: SparkSession, d: str) -> DataFrame:
    best = lexical.top(lexical.bm25(_units(spark, d), "id", ["unit_type", "name", "source"], CODE_TERMS), "id", 200)
    return _rounded(lexical.minmax(best).select("id", "lexical"), "lexical")


FIRST_SQL = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in terms.STOPWORDS) + "]"
TITLES_SQL = "SELECT DISTINCT title FROM documents WHERE title IS NOT NULL"


@query(f"""WITH q AS ({TITLES_SQL}), w AS (SELECT title, list_filter(regexp_extract_all(lower(title), '[a-z0-9_]+'), lambda x: NOT list_contains({STOP_SQL}, x)) AS w FROM q)
SELECT title, {FIRST_SQL.format('w')}[1:8] AS terms FROM w""")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "documents").where("title is not null").select("title").distinct()
    return titles.select("title", terms.docs_terms_column(F.col("title")).alias("terms"))


WORDS_SQL = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM search_chunks"


@query(f"""WITH t AS ({WORDS_SQL}), v AS (SELECT term, list_filter([term, CASE WHEN length(term) > 3 AND suffix(term, 'ies') THEN left(term, length(term) - 3) || 'y' END,
CASE WHEN length(term) > 3 AND suffix(term, 's') THEN left(term, length(term) - 1) END], lambda x: x IS NOT NULL) AS v FROM t) SELECT term, {FIRST_SQL.format('v')} AS variants FROM v""")
def term_variants(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "search_chunks").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9_]+)"), 1)).alias("term")).distinct()
    return words.select("term", terms.variants_column(F.col("term")).alias("variants"))


@query(f"""WITH q AS (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL), w AS (SELECT path, list_filter(list_transform(string_split_regex(lower(replace(path, '_', ' ')), '\\s+'),
lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda x: length(x) >= 2) AS w FROM q) SELECT path, {FIRST_SQL.format('w')}[1:12] AS tokens FROM w""")
def code_query_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("path is not null").select("path").distinct()
    return rows.select("path", terms.code_tokens_column(F.col("path")).alias("tokens"))


# vectors
QUERY_VECTOR_SQL = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def sql_cosine(a: str, b: str) -> str:
    square = lambda v: f"sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"
    return f"(list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE)) / ({square(a)} * {square(b)}))"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0])


@query(f"WITH {QUERY_VECTOR_SQL} SELECT vec_id, round({sql_cosine('embedding', 'q')}, 6) AS cosine FROM embeddings, q ORDER BY round({sql_cosine('embedding', 'q')}, 9) DESC, vec_id LIMIT 100")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vectors.top_k(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 100), "cosine")


@query(f"WITH {QUERY_VECTOR_SQL} SELECT vec_id, round({sql_cosine('embedding', 'q')}, 6) AS cosine FROM embeddings, q WHERE label IN (1, 3) ORDER BY round({sql_cosine('embedding', 'q')}, 9) DESC, vec_id LIMIT 50")
def vector_topk_scoped(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vectors.top_k(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 50, F.col("label").isin(1, 3)), "cosine")


SOUND_SQL = "len({0}) = 64 AND len(list_filter({0}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({0}, lambda x: x <> 0)) > 0"


@query(f"""WITH v AS (SELECT DISTINCT vec_id, vector FROM unit_embeddings), {QUERY_VECTOR_SQL}
SELECT vec_id, round(CASE WHEN {SOUND_SQL.format('vector')} THEN {sql_cosine('vector', 'q')} ELSE 0 END, 6) AS cosine FROM v, q""")
def vector_cosine_or_zero(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "unit_embeddings").select("vec_id", "vector").distinct()
    return _rounded(rows.select("vec_id", vectors.cosine_or_zero(F.col("vector"), vectors.literal(_query_vector(spark, d))).alias("cosine")), "cosine")


# hybrid ranking
#: The model whose vectors count in the embedding tables.
CODE_MODEL, DOCS_MODEL = "code-embed-2", "text-embed-2"
UNIT_QUERY_SQL = f"uv AS (SELECT unit_id AS id, vector FROM unit_embeddings WHERE model = '{CODE_MODEL}' AND {SOUND_SQL.format('vector')} QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY vec_id) = 1), {QUERY_VECTOR_SQL}, sem AS (SELECT id, {sql_cosine('vector', 'q')} AS semantic FROM uv, q ORDER BY round(semantic, 9) DESC, id LIMIT 250)"


def _unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors.usable(table(spark, d, "unit_embeddings"), "unit_id", "vector", "vec_id", CODE_MODEL, 64).withColumnRenamed("unit_id", "id")


@query(sql_bm25(UNITS_SQL, "id", ["unit_type", "name", "source"], CODE_WORDS) + f""", best AS (SELECT * FROM ranked ORDER BY round(rank, 9), id LIMIT 200), e AS (SELECT min(rank) AS lo, max(rank) AS hi FROM best),
lex AS (SELECT id, CASE WHEN hi - lo = 0 THEN 1.0 ELSE 1 - (rank - lo) / (hi - lo) END AS lexical FROM best, e), {UNIT_QUERY_SQL},
b AS (SELECT coalesce(sem.id, lex.id) AS id, semantic, lexical FROM sem FULL JOIN lex ON sem.id = lex.id),
s AS (SELECT *, CASE WHEN semantic IS NOT NULL AND lexical IS NOT NULL THEN 'hybrid' WHEN semantic IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS kind,
CASE WHEN semantic IS NOT NULL AND lexical IS NOT NULL THEN 0.7 * greatest(0, least(1, (semantic + 1) / 2)) + 0.3 * lexical WHEN semantic IS NOT NULL THEN greatest(0, least(1, (semantic + 1) / 2)) ELSE 0.85 * lexical END AS score FROM b)
SELECT id, kind, round(semantic, 6) AS semantic, round(lexical, 6) AS lexical, round(score, 6) AS score FROM s ORDER BY round(s.score, 9) DESC, id LIMIT 100""")
def hybrid_code_rank(spark: SparkSession, d: str) -> DataFrame:
    best = lexical.top(lexical.bm25(_units(spark, d), "id", ["unit_type", "name", "source"], CODE_TERMS), "id", 200)
    semantic = vectors.top_k(_unit_vectors(spark, d), "id", "vector", _query_vector(spark, d), 250)
    return _rounded(ranking.hybrid_code(semantic, lexical.minmax(best), "id", 100), "semantic", "lexical", "score")


CHUNK_SEM_SQL = f"""cv AS (SELECT chunk_id AS id, vector FROM chunk_embeddings WHERE model = '{DOCS_MODEL}' AND {SOUND_SQL.format('vector')} QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY vec_id) = 1), {QUERY_VECTOR_SQL},
cc AS (SELECT DISTINCT id, docset_slug, page_id FROM search_chunks), sem AS (SELECT cc.id, docset_slug, page_id, {sql_cosine('vector', 'q')} AS score FROM cv JOIN cc ON cc.id = cv.id, q)"""


def _chunk_semantic(spark: SparkSession, d: str) -> DataFrame:
    """(id, docset_slug, page_id, cosine) of every chunk that has a vector of the model."""
    best = vectors.usable(table(spark, d, "chunk_embeddings"), "chunk_id", "vector", "vec_id", DOCS_MODEL, 64).withColumnRenamed("chunk_id", "id")
    scored = best.select("id", vectors.cosine_or_zero(F.col("vector"), vectors.literal(_query_vector(spark, d))).alias("cosine"))
    return scored.join(_chunk_pages(spark, d), "id")


def sql_diversified(source: str, limit: int) -> str:
    return f"""SELECT * EXCLUDE (later, pos), row_number() OVER (ORDER BY later, pos) - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY docset_slug, page_id ORDER BY pos) > 1 AS later FROM {source} ORDER BY later, pos LIMIT {limit})"""


def sql_docs(scope: str) -> str:
    """Documentation search in a scope: every vector in it is scored."""
    return sql_bm25(CHUNKS_SQL, "id, docset_slug, page_id", ["text"], DOCS_WORDS, scope) + f""", kb AS (SELECT * FROM ranked ORDER BY round(rank, 9), id LIMIT 250),
kw AS (SELECT id, docset_slug, page_id, greatest(0, 1 - (row_number() OVER (ORDER BY round(rank, 9), id) - 1) / 250.0) AS score, row_number() OVER (ORDER BY round(rank, 9), id) - 1 AS pos FROM kb),
{CHUNK_SEM_SQL}, s0 AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS pos FROM sem WHERE {scope}), s1 AS ({sql_diversified('s0', 250)}),
u AS (SELECT id, docset_slug, page_id, score, pos, CASE WHEN id IN (SELECT id FROM kw) THEN 'hybrid' ELSE 'semantic' END AS kind, 0 AS side FROM s1 UNION ALL SELECT id, docset_slug, page_id, score, pos, 'keyword', 1 FROM kw WHERE id NOT IN (SELECT id FROM s1)),
m AS (SELECT * EXCLUDE (pos, side), row_number() OVER (ORDER BY side, pos) - 1 AS pos FROM u)
SELECT id, docset_slug, page_id, kind, round(score, 6) AS score, pos FROM ({sql_diversified('m', 50)})"""


def _docs_search(spark: SparkSession, d: str, scope: list[str] | None) -> DataFrame:
    inside = None if scope is None else F.col("docset_slug").isin(scope)
    found = ranking.keyword_positions(lexical.bm25(_chunks(spark, d), "id", ["text"], DOC_TERMS, inside), "id").join(_chunk_pages(spark, d), "id")
    semantic = _chunk_semantic(spark, d)
    out = ranking.hybrid_docs(semantic if inside is None else semantic.where(inside), found, "id", ["docset_slug", "page_id"], 50)
    return _rounded(out.withColumn("pos", F.col("pos").cast("bigint")), "score")


@query(sql_docs("TRUE"))
def hybrid_docs_rank(spark: SparkSession, d: str) -> DataFrame:
    return _docs_search(spark, d, None)


@query(sql_docs(SCOPE_SQL))
def hybrid_docs_scoped(spark: SparkSession, d: str) -> DataFrame:
    return _docs_search(spark, d, DOCS_SCOPE)


@query(f"""WITH {CHUNK_SEM_SQL}, s0 AS (SELECT id, docset_slug, page_id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS pos FROM sem) {sql_diversified('s0', 250)}""")
def diversify_pages(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct((-F.round("cosine", 9)).alias("down"), F.col("id").alias("key"))
    out = ranking.diversified(_chunk_semantic(spark, d).withColumn("pos", order).drop("cosine"), ["docset_slug", "page_id"], "pos", 250)
    return out.select("id", "docset_slug", "page_id", F.col("pos").cast("bigint").alias("pos"))


@query()
def search_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts, links and hints of the 50 best keyword hits."""
    best = lexical.top(lexical.bm25(_chunks(spark, d), "id", ["text"], DOC_TERMS), "id", 50)
    rows = best.join(_chunks(spark, d), "id").dropDuplicates(["id"])
    hint = F.concat(F.lit("docs page "), text.shell_quoted(F.col("docset_slug")), F.lit(" "), text.shell_quoted(F.col("page_id")))
    return rows.select("id", F.round("rank", 6).alias("rank"), excerpt_column(F.col("text"), terms.docs_terms(DOCS_QUERY)).alias("excerpt"), text.resource_uri(F.col("docset_slug"), F.col("page_id")).alias("resource_uri"), hint.alias("read_hint"))


# near duplicates
PAIRS_SQL = "p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id)"


@query(f"WITH {PAIRS_SQL} SELECT a, b, round(cosine, 6) AS cosine FROM p WHERE cosine >= 0.35")
def dup_pairs_exhaustive(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vectors.pairs_above(table(spark, d, "embeddings"), "vec_id", "embedding", 0.35), "cosine")


@query(f"""WITH {PAIRS_SQL}, t AS (SELECT * FROM p WHERE cosine >= 0.3), s AS (SELECT a AS x, b AS y, cosine FROM t UNION ALL SELECT b, a, cosine FROM t),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY round(cosine, 9) DESC, y) <= 3) SELECT least(x, y) AS a, greatest(x, y) AS b, round(max(cosine), 6) AS cosine FROM k GROUP BY 1, 2""")
def dup_pairs_knn(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(duplicates.knn_pairs(vectors.pairs_above(table(spark, d, "embeddings"), "vec_id", "embedding", 0.3), 3), "cosine")


KEYS_SQL = """t AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS m,
list_sort(list_filter(list_transform(range(1, len(embedding) + 1), lambda i: {'m': -abs(embedding[i]::DOUBLE), 'i': i - 1, 'x': embedding[i]::DOUBLE}), lambda s: s.m < 0))[1:12] AS top FROM embeddings),
g AS (SELECT *, list_transform(top, lambda s: (CASE WHEN s.x < 0 THEN '-' ELSE '+' END) || s.i) AS signed FROM t),
keyed AS (SELECT vec_id, embedding, CASE WHEN len(top) = 0 THEN ['zero-vector'] ELSE
['fingerprint:' || array_to_string(list_transform(top, lambda s: s.i || ':' || round_even(s.x / m * 1000, 0)::BIGINT), '|'), 'top:' || array_to_string(signed, '|')]
|| list_transform(range(0, (len(signed) - 1) // 2 + 1), lambda k: 'band:' || array_to_string(signed[k * 2 + 1:k * 2 + 2], '|')) || list_transform(signed, lambda s: 'dim:' || s) END AS keys FROM g)"""


@query(f"WITH {KEYS_SQL} SELECT vec_id, keys FROM keyed")
def dup_signature_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", duplicates.signature_keys(F.col("embedding")).alias("keys"))


@query(f"""WITH {KEYS_SQL}, r AS (SELECT vec_id, unnest(keys) AS bucket, generate_subscripts(keys, 1) AS k, greatest(1, ceil(64.0 / (2 * len(keys))))::INT AS scan FROM keyed),
n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY vec_id) AS n FROM r),
w AS (SELECT vec_id, bucket, k, 0 AS phase, n - m AS step, m FROM (SELECT *, unnest(range(greatest(1, n - scan), n)) AS m FROM n) UNION ALL SELECT vec_id, bucket, k, 1, m, m FROM (SELECT *, unnest(range(1, least(scan, n - 1) + 1)) AS m FROM n)),
f AS (SELECT n.vec_id AS a, w.vec_id AS b, min((phase, w.k, step)) AS rank FROM w JOIN n ON n.bucket = w.bucket AND n.n = w.m GROUP BY 1, 2),
c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY b ORDER BY rank) <= 64),
s AS (SELECT a, b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS cosine FROM c JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b)
SELECT a, b, round(cosine, 6) AS cosine FROM s WHERE cosine >= 0.2""")
def dup_pairs_bounded(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(duplicates.bounded_pairs(spread(table(spark, d, "embeddings", ["vec_id", "embedding"])), "vec_id", "vec_id", "embedding", 0.2), "cosine")


@query("""WITH t AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT * FROM embeddings WHERE vec_id % 100 <> 0),
o AS (SELECT t.vec_id AS a, s.vec_id AS b, list_cosine_similarity(t.embedding::DOUBLE[], s.embedding::DOUBLE[]) AS cosine FROM t JOIN s ON t.label <> s.label UNION ALL
SELECT x.vec_id, y.vec_id, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) FROM t x JOIN t y ON x.vec_id < y.vec_id) SELECT a, b, round(cosine, 6) AS cosine FROM o WHERE cosine >= 0.2""")
def dup_pairs_transient(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 100 as a file given for one run, against all others; the label stands for the file."""
    rows = table(spark, d, "embeddings").withColumn("file", F.col("label").cast("string"))
    given, stored = rows.where("vec_id % 100 = 0"), rows.where("vec_id % 100 <> 0")
    return _rounded(duplicates.transient_pairs(given, stored, "vec_id", "embedding", "file", 0.2), "cosine")


LINKS_SQL = "l AS (SELECT least(unit_id_a, unit_id_b) AS a, greatest(unit_id_a, unit_id_b) AS b, max(similarity) AS cosine FROM duplicate_pairs WHERE unit_id_a <> unit_id_b AND similarity IS NOT NULL AND NOT isnan(similarity) AND similarity >= 0.92 GROUP BY 1, 2)"
CLUSTER_SQL = f"WITH RECURSIVE {LINKS_SQL}, e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT x, x AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), k AS (SELECT x AS id, min(y) AS cluster FROM r GROUP BY x)"


def _link_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "duplicate_pairs", ["unit_id_a", "unit_id_b", "similarity"]).where("unit_id_a <> unit_id_b and similarity is not null and not isnan(similarity) and similarity >= 0.92")


def _links(spark: SparkSession, d: str) -> DataFrame:
    return _link_rows(spark, d).groupBy(F.least("unit_id_a", "unit_id_b").alias("a"), F.greatest("unit_id_a", "unit_id_b").alias("b")).agg(F.max("similarity").alias("cosine"))


@query(CLUSTER_SQL + " SELECT id, cluster FROM k")
def dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.clusters(_link_rows(spark, d).select(F.col("unit_id_a").alias("a"), F.col("unit_id_b").alias("b")))


MEMBERS_SQL = """, u AS (SELECT DISTINCT id, file_path, unit_type FROM code_units), e2 AS (SELECT a AS id, a, b, cosine FROM l UNION ALL SELECT b, a, b, cosine FROM l),
g AS (SELECT id, count(*) AS links, max(cosine) AS most, min((-round(cosine, 9), a, b)) AS first FROM e2 GROUP BY id), mm AS (SELECT * FROM k JOIN g USING (id) JOIN u USING (id))"""


def _report(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "code_units", ["id", "file_path", "unit_type"]).distinct()
    return duplicates.report(_links(spark, d), units, "id", ["file_path", "unit_type"])


@query(CLUSTER_SQL + MEMBERS_SQL + " SELECT cluster, id, file_path, unit_type, links, round(most, 6) AS most FROM mm")
def dup_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_report(spark, d).drop("first"), "most")


@query(CLUSTER_SQL + MEMBERS_SQL + " SELECT cluster, count(*) AS units, (sum(links) // 2)::BIGINT AS pairs, round(max(most), 6) AS most, min(first)[2] AS first_a, min(first)[3] AS first_b FROM mm GROUP BY cluster")
def dup_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(duplicates.summary(_report(spark, d)), "most")


@query("SELECT DISTINCT id, unit_type FROM code_units WHERE unit_type IN (" + ", ".join(f"'{t}'" for t in codeunits.FUNCTION_TYPES + codeunits.CLASS_TYPES) + ")")
def dup_levels(spark: SparkSession, d: str) -> DataFrame:
    levels = duplicates.parse_levels(["function,class", "file"])
    return table(spark, d, "code_units").where(duplicates.level_predicate(F.col("unit_type"), levels)).select("id", "unit_type").distinct()


# text
@query(f"SELECT doc_id, sha256({sql_normal('text')}) AS content_hash, CASE WHEN length({sql_normal('text')}) = 0 THEN 0 ELSE greatest(1, (length({sql_normal('text')}) + 3) // 4) END AS tokens FROM documents WHERE text IS NOT NULL")
def page_hashes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", text.content_hash(F.col("text")).alias("content_hash"), text.token_estimate(F.col("text")).cast("bigint").alias("tokens"))


@query(f"SELECT doc_id FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source, sha256({sql_normal('text')}) ORDER BY doc_id) = 1")
def page_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "source", "text")
    return store.deduplicated(rows, "source", text.content_hash(F.col("text")), "doc_id").select("doc_id")


SLUG_SQL = "regexp_replace(regexp_replace(lower(name || '-' || path), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:80]"


@query(f"SELECT DISTINCT name, path, (CASE WHEN {SLUG_SQL} = '' THEN 'page' ELSE {SLUG_SQL} END) || '-' || sha1(path)[1:10] AS id FROM pages WHERE name IS NOT NULL AND path IS NOT NULL")
def page_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").where("name is not null and path is not null").select("name", "path").distinct()
    return rows.withColumn("id", text.page_id(F.col("path"), F.col("name")))


HEADED_SQL = "'# ' || coalesce(title, '') || chr(10) || chr(10) || '> DevDocs path: ' || coalesce(path, '') || chr(10) || chr(10) || text"


@query(f"SELECT doc_id, sha256({sql_normal(f'''regexp_replace({sql_normal(HEADED_SQL)}, '(?s)^# .+{chr(92)}n{chr(92)}n> DevDocs path: .+{chr(92)}n{chr(92)}n', '')''')}) AS greedy, sha256({sql_normal(f'''regexp_replace({sql_normal(HEADED_SQL)}, '^# [^{chr(92)}n]+{chr(92)}n{chr(92)}n> DevDocs path: [^{chr(92)}n]+{chr(92)}n{chr(92)}n', '')''')}) AS exact FROM documents WHERE text IS NOT NULL")
def header_strip(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit("")
    headed = F.concat(F.lit("# "), F.coalesce("title", none), F.lit("\n\n> DevDocs path: "), F.coalesce("path", none), F.lit("\n\n"), F.col("text"))
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", F.sha2(text.strip_page_header(headed), 256).alias("greedy"), F.sha2(text.strip_page_header(headed, "exact"), 256).alias("exact"))


@query("SELECT DISTINCT id, json_object('docsetSlug', docset_slug, 'docsetName', upper(docset_slug), 'pageId', id, 'pageName', name, 'pagePath', path, 'pageType', type, 'pageFile', file_path, 'chunkOrdinal', 0)::VARCHAR AS metadata FROM pages")
def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = table(spark, d, "pages")
    return rows.select("id", text.chunk_metadata(c("docset_slug"), F.upper("docset_slug"), c("id"), c("name"), c("path"), c("type"), c("file_path"), F.lit(0)).alias("metadata")).distinct()


@query(f"SELECT doc_id, {sql_normal(f'''concat_ws(chr(10), 'Docset: ' || upper(source) || ' (' || source || ')', 'Page: ' || title, 'Path: ' || path, CASE WHEN coalesce(page_type, '') <> '' THEN 'Type: ' || page_type END) || chr(10) || chr(10) || regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')''')} AS chunk FROM documents WHERE text IS NOT NULL")
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    rows = table(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", text.chunk_text(F.upper("source"), c("source"), c("title"), c("path"), c("page_type"), c("text")).alias("chunk"))


def _split_documents(spark: SparkSession, d: str) -> DataFrame:
    limits = table(spark, d, "embeddings_config").withColumnRenamed("docset_slug", "source")
    rows = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "source", "text")).join(limits, "source", "left")
    return rows.withColumn("chunks", chunking.split_udf("text", "max_chunk_chars", "overlap_chars", "min_chunk_chars")).withColumn("cap", F.coalesce("max_chunks_per_page", F.lit(chunking.MAX_CHUNKS)))


@query()
def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents under the options of their docset, numbered from 0, up to the cap of a page."""
    rows = _split_documents(spark, d).select("doc_id", "source", F.posexplode(F.expr("slice(chunks, 1, cap)")).alias("ordinal", "chunk"))
    return rows.withColumns({"content_hash": text.content_hash(F.col("chunk")), "token_count": text.token_estimate(F.col("chunk"))})


@query()
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counters of chunking a docset: pages, repeated pages, cut pages and chunks, chunks below the minimum."""
    rows = _split_documents(spark, d)
    # numbers of each page; of pages with one text the first counts, which an aggregate finds before they are brought together
    over = F.greatest(F.size("chunks") - F.col("cap"), F.lit(0))
    small = F.size(F.filter(F.expr("slice(chunks, 1, cap)"), lambda c: F.char_length(c) < F.coalesce("min_chunk_chars", F.lit(chunking.MIN_CHARS))))
    pages = rows.select("source", text.content_hash(F.col("text")).alias("hash"), "doc_id", over.alias("over"), small.alias("small"))
    texts = pages.groupBy("source", "hash").agg(F.count("*").alias("pages"), F.min_by(F.struct("over", "small"), "doc_id").alias("first"))
    return texts.groupBy("source").agg(F.sum("pages").alias("pages"), (F.sum("pages") - F.count("*")).alias("duplicate_pages"), F.count_if(F.col("first.over") > 0).alias("truncated_pages"), F.sum("first.over").alias("truncated_chunks"), F.sum("first.small").alias("small_chunks"))


@query()
def html_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d).groupBy("id").agg(F.min(F.struct("page_id", "text")).alias("c")).select("id", "c.*")
    return chunks.select("id", html.to_markdown_udf("page_id", F.concat(F.lit("guide/"), "page_id"), "text").alias("markdown"))


@query()
def code_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of all source files."""
    files = spread(table(spark, d, "source_files")).groupBy("path").agg(F.min("contents").alias("contents"))
    return codeunits.parse_files(files)


# paths
@query("SELECT DISTINCT path, CASE WHEN split_part(path, '#', 1) = '' THEN 'index' ELSE split_part(path, '#', 1) END AS source_key, CASE WHEN contains(path, '#') AND NOT suffix(path, '#') THEN path[instr(path, '#') + 1:] END AS anchor FROM pages WHERE path IS NOT NULL")
def url_source_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").where("path is not null").select("path").distinct()
    return rows.select("path", paths.source_key(F.col("path")).alias("source_key"), paths.anchor(F.col("path")).alias("anchor"))


@query("SELECT path FROM source_files WHERE path = 'harbor-mono/src' OR starts_with(path, 'harbor-mono/src/') OR starts_with(path, 'tide-api/')")
def path_prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").where(paths.under_any(F.col("path"), ["harbor-mono/src", "tide-api"])).select("path")


@query("SELECT path FROM source_files WHERE list_contains(string_split(path, '/'), 'metrics')")
def path_component_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").where(paths.has_component(F.col("path"), "metrics")).select("path")


@query("SELECT path, string_split(path, '/')[-1] AS name FROM source_files WHERE suffix(string_split(path, '/')[-1], '.css')")
def terminal_component_filter(spark: SparkSession, d: str) -> DataFrame:
    name = paths.terminal(F.col("path"))
    return table(spark, d, "source_files").where(name.endswith(".css")).select("path", name.alias("name"))


EXCLUDED_SQL = "[" + ", ".join(f"'{x}'" for x in paths.EXCLUDED_DIRS + paths.EXCLUDED_FILES) + "]"


@query(f"WITH f AS (SELECT replace(replace(path, '/catalog/', '/build/'), '/store/', '/x.egg-info/') AS p FROM source_files) SELECT DISTINCT p AS path, list_has_any(string_split(p, '/'), {EXCLUDED_SQL}) OR len(list_filter(string_split(p, '/'), lambda x: suffix(x, '.egg-info') OR suffix(x, '.dist-info'))) > 0 AS excluded FROM f")
def scan_exclusion(spark: SparkSession, d: str) -> DataFrame:
    p = F.replace(F.replace("path", F.lit("/catalog/"), F.lit("/build/")), F.lit("/store/"), F.lit("/x.egg-info/"))
    return table(spark, d, "source_files").select(p.alias("path")).distinct().withColumn("excluded", paths.is_excluded(F.col("path")))


# listings
@query("WITH u AS (SELECT DISTINCT id, file_path, start_line, language FROM code_units WHERE language = 'python' AND starts_with(file_path, 'harbor-mono/')) SELECT id, file_path, start_line FROM u ORDER BY file_path, start_line, id LIMIT 50 OFFSET 20")
def list_units_page(spark: SparkSession, d: str) -> DataFrame:
    return store.listing(_units(spark, d).drop("source").distinct().withColumn("source", F.lit(None).cast("string")), 0, 20, "harbor-mono", "python").select("id", "file_path", "start_line")


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents WHERE text IS NOT NULL")
def line_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.line_slice(F.col("text"), 2, 4).alias("lines"))


PRESENT_PAGES_SQL = "pp AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY docset_slug, id ORDER BY updated_at DESC NULLS LAST, seq DESC) = 1)"


@query(f"WITH {PRESENT_PAGES_SQL} SELECT docset_slug, id, name, path FROM pp WHERE (contains(lower(name), 'cursor') OR contains(lower(path), 'cursor')) AND type = 'Reference' ORDER BY docset_slug, name, path, id LIMIT 100")
def page_list_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").withColumn("row", F.struct("name", "path", "type"))
    present = incremental.present_rows(rows, ["docset_slug", "id"], "row").select("docset_slug", "id", "row.*")
    return store.page_listing(present, "Cursor", "Reference", 100).select("docset_slug", "id", "name", "path")


# maintenance
PRESENT_FILES_SQL = "pf AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY path ORDER BY updated_at DESC NULLS LAST, seq DESC) = 1)"


def _present_files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "files").withColumn("row", F.struct("hash", "status", "error", "updated_at", "parser_key"))
    return incremental.present_rows(rows, ["path"], "row").select("path", "row.*")


@query(f"WITH {PRESENT_FILES_SQL} SELECT count(*) FILTER (WHERE status = 'indexed') AS indexed_files, count(*) FILTER (WHERE status = 'error') AS error_files, (SELECT count(DISTINCT id) FROM code_units) AS units, (SELECT count(DISTINCT unit_id) FROM unit_embeddings) AS embedded_units FROM pf")
def store_stats(spark: SparkSession, d: str) -> DataFrame:
    return store.counts(_present_files(spark, d), table(spark, d, "code_units"), table(spark, d, "unit_embeddings"))


@query(f"WITH {PRESENT_FILES_SQL} SELECT path, error, updated_at FROM pf WHERE error IS NOT NULL ORDER BY updated_at DESC NULLS LAST, path LIMIT 10")
def latest_errors(spark: SparkSession, d: str) -> DataFrame:
    return store.latest_errors(_present_files(spark, d))


@query(f"""WITH {PRESENT_FILES_SQL}, u AS (SELECT DISTINCT id, file_path FROM code_units), e AS (SELECT DISTINCT unit_id FROM unit_embeddings),
c AS (SELECT file_path AS path, count(id) AS units, count(unit_id) AS embedded FROM u LEFT JOIN e ON e.unit_id = u.id GROUP BY 1)
SELECT pf.path, coalesce(units, 0) AS units, coalesce(embedded, 0) AS embedded, coalesce(status, '') = 'indexed' AND coalesce(units, 0) > 0 AND units = embedded AS complete FROM pf LEFT JOIN c ON c.path = pf.path""")
def file_completeness(spark: SparkSession, d: str) -> DataFrame:
    return store.completeness(_present_files(spark, d), table(spark, d, "code_units"), table(spark, d, "unit_embeddings"))


@query("""WITH a AS (SELECT DISTINCT id AS unit_id FROM code_units), b AS (SELECT DISTINCT unit_id FROM unit_embeddings) SELECT unit_id, 'missing' AS side FROM a ANTI JOIN b USING (unit_id) UNION ALL SELECT unit_id, 'orphan' FROM b ANTI JOIN a USING (unit_id)""")
def index_drift(spark: SparkSession, d: str) -> DataFrame:
    return store.drift(table(spark, d, "code_units").select(F.col("id").alias("unit_id")), table(spark, d, "unit_embeddings").select("unit_id"), ["unit_id"])


VERSION_SQL = ", ".join(f"sum(('0x' || h[{1 + 12 * k}:{12 + 12 * k}])::BIGINT)::DECIMAL(38, 0)::VARCHAR" for k in range(5))


@query(f"WITH r AS (SELECT DISTINCT docset_slug, id, content_hash, token_count FROM search_chunks), g AS (SELECT docset_slug, sha256(concat_ws(':', id::VARCHAR, coalesce(content_hash, ''), coalesce(token_count::VARCHAR, ''))) AS h FROM r) SELECT docset_slug, sha256(concat_ws(':', count(*)::VARCHAR, {VERSION_SQL})) AS version FROM g GROUP BY docset_slug")
def index_version(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "search_chunks").select("docset_slug", "id", "content_hash", "token_count").distinct()
    return store.index_version(rows, ["docset_slug"], ["id", "content_hash", "token_count"])


@query("SELECT DISTINCT c.id, c.content_hash FROM search_chunks c WHERE NOT EXISTS (SELECT 1 FROM chunk_embeddings e WHERE e.chunk_id = c.id AND e.dimensions = 64)")
def embedding_delta(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "chunk_embeddings").where("dimensions = 64").select(F.col("chunk_id").alias("id"))
    return store.to_refresh(table(spark, d, "search_chunks").select("id", "content_hash").distinct(), stored, ["id"])


@query(f"WITH {PRESENT_FILES_SQL} SELECT coalesce(s.path, pf.path) AS path, coalesce(s.hash, pf.hash) AS hash FROM pf FULL JOIN (SELECT path, min(hash) AS hash FROM source_files GROUP BY path) s ON s.path = pf.path")
def upsert_files(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "source_files").groupBy("path").agg(F.min("hash").alias("hash"))
    return store.upsert(_present_files(spark, d).select("path", "hash"), new, "path")


@query("SELECT DISTINCT path FROM source_files WHERE NOT (starts_with(path, 'harbor-mono/') OR list_contains(string_split(path, '/'), 'billing') OR string_split(path, '/')[-1] = 'x.py')")
def delete_rows(spark: SparkSession, d: str) -> DataFrame:
    return store.remove(table(spark, d, "source_files").select("path").distinct(), "path", prefix="harbor-mono", component="billing", name="x.py")


@query("SELECT path, CASE WHEN b IS NULL THEN 'added' WHEN n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT coalesce(s.path, f.path) AS path, f.path AS b, s.path AS n, f.hash AS fh, s.hash AS sh FROM (SELECT path, min(hash) AS hash FROM files GROUP BY path) f FULL JOIN (SELECT path, min(hash) AS hash FROM source_files GROUP BY path) s ON s.path = f.path) WHERE b IS NULL OR n IS NULL OR fh IS DISTINCT FROM sh")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t: table(spark, d, t).groupBy("path").agg(F.min("hash").alias("hash"))
    return queueing.snapshot_diff(one("files"), one("source_files"), "path", "hash")


# the queue, with events as requests
@query("SELECT user_id, event_type, max(CASE WHEN value > 50 THEN 100 ELSE 0 END) AS priority, min(event_id) AS first_pos, count(*) AS requests FROM events GROUP BY 1, 2")
def queue_coalesce(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("p", F.when(F.col("value") > 50, queueing.HIGH).otherwise(queueing.LOW))
    return queueing.coalesced(rows, ["user_id", "event_type"], "p", "event_id")


QUEUE_SQL = "q AS (SELECT event_id AS id, CASE WHEN value > 50 THEN 100 ELSE 0 END AS priority, CASE WHEN event_id % 3 = 0 THEN 'in_progress' ELSE 'pending' END AS status, CASE WHEN event_id % 3 = 0 THEN 'w' || (user_id % 2) END AS owner, CASE WHEN event_id % 3 = 0 THEN ts END AS claimed_at FROM events), t AS (SELECT max(ts) AS now FROM events)"
RECLAIM_SQL = f"{QUEUE_SQL}, r AS (SELECT id, priority, CASE WHEN old THEN 'pending' ELSE status END AS status, CASE WHEN NOT old THEN owner END AS owner FROM (SELECT q.*, coalesce(status = 'in_progress' AND owner <> 'w1' AND floor(epoch(now)) - floor(epoch(claimed_at)) >= 30, FALSE) AS old FROM q, t))"


def _queue(spark: SparkSession, d: str) -> tuple[DataFrame, F.Column]:
    events = table(spark, d, "events")
    running = F.col("event_id") % 3 == 0
    rows = events.select(F.col("event_id").alias("id"), F.when(F.col("value") > 50, queueing.HIGH).otherwise(queueing.LOW).alias("priority"), F.when(running, "in_progress").otherwise("pending").alias("status"), F.when(running, F.concat(F.lit("w"), (F.col("user_id") % 2).cast("string"))).alias("owner"), F.when(running, F.col("ts").cast("timestamp")).alias("claimed_at"), F.lit(0).alias("attempts"))
    return rows, F.lit(events.agg(F.max(F.col("ts").cast("timestamp"))).first()[0])


@query(f"WITH {RECLAIM_SQL} SELECT id, status, owner FROM r")
def queue_stale_reclaim(spark: SparkSession, d: str) -> DataFrame:
    rows, now = _queue(spark, d)
    return queueing.reclaimed(rows, "w1", now).select("id", "status", "owner")


@query(f"WITH {RECLAIM_SQL} SELECT id, priority FROM r WHERE status = 'pending' ORDER BY priority DESC, id LIMIT 128")
def queue_claim(spark: SparkSession, d: str) -> DataFrame:
    rows, now = _queue(spark, d)
    return queueing.claim(queueing.reclaimed(rows, "w1", now), "w1", now, queueing.BATCH_ITEMS).where("attempts = 1").select("id", "priority")


@query(f"WITH {QUEUE_SQL} SELECT count(*) FILTER (WHERE status = 'pending' AND priority >= 100) AS high, count(*) FILTER (WHERE status = 'pending' AND priority < 100) AS low, count(*) FILTER (WHERE status = 'in_progress') AS in_progress FROM q")
def queue_stats(spark: SparkSession, d: str) -> DataFrame:
    return queueing.stats(_queue(spark, d)[0])


@query()
def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Requests for embeddings: chunks of a docset, in order, at most 64 and 262,144 bytes a request."""
    rows = _chunks(spark, d).select("id", "docset_slug", F.octet_length("text").alias("bytes")).distinct()
    most, size, _ = embedding.DOCS_REQUEST
    return queueing.batches(rows, "id", "bytes", most, size, "docset_slug")


# catalog and output
CATALOG_SQL = "c AS (SELECT DISTINCT docset_slug AS slug, split_part(docset_slug, '~', 1) AS name, CASE WHEN contains(docset_slug, '~') THEN split_part(docset_slug, '~', 2) END AS version FROM embeddings_config)"
KEY_SQL = "{'plain': (NOT contains(slug, '~'))::INT, 'numbers': list_transform(regexp_extract_all(coalesce(version, ''), '[0-9]+'), lambda n: n::BIGINT)}"


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    slug = F.col("docset_slug")
    rows = table(spark, d, "embeddings_config").select("docset_slug").distinct()
    name = F.substring_index(slug, "~", 1)
    return rows.select(slug.alias("slug"), name.alias("name"), name.alias("type"), F.when(slug.contains("~"), F.regexp_extract(slug, "~(.*)$", 1)).alias("version"), F.array(F.concat(F.substring(name, 1, 4), F.lit("-alias"))).alias("aliases"))


@query(f"WITH {CATALOG_SQL} SELECT name, max_by(slug, ({KEY_SQL}, slug)) AS slug FROM c GROUP BY name")
def preferred_version(spark: SparkSession, d: str) -> DataFrame:
    return catalog.preferred(_catalog(spark, d), ["name"])


@query(f"""WITH {CATALOG_SQL}, w AS (SELECT DISTINCT name AS request, lower(name) AS want FROM c UNION SELECT slug, lower(slug) FROM c UNION SELECT name[1:4] || '-ALIAS', lower(name[1:4] || '-alias') FROM c UNION SELECT 'nothing', 'nothing'),
k AS (SELECT slug, {KEY_SQL} AS rank, lower(slug) AS want, 0 AS way FROM c UNION ALL SELECT slug, {KEY_SQL}, lower(name[1:4] || '-alias'), 1 FROM c UNION ALL SELECT slug, {KEY_SQL}, lower(name), 3 FROM c),
h AS (SELECT request, way, max_by(slug, (rank, slug)) AS slug FROM w JOIN k USING (want) GROUP BY request, way) SELECT request, min_by(slug, way) AS slug FROM h GROUP BY request""")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    known = _catalog(spark, d)
    asked = known.select(F.col("name").alias("request")).union(known.select("slug")).union(known.select(F.concat(F.substring("name", 1, 4), F.lit("-ALIAS")))).union(known.select(F.lit("nothing"))).distinct()
    return catalog.resolved(asked, known)


@query("SELECT DISTINCT id FROM search_chunks WHERE docset_slug IN ('brackenlib', 'quarry')")
def docset_scope(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "search_chunks").select("id", "docset_slug").distinct()
    return catalog.in_scope(rows, _catalog(spark, d), catalog.requested_names("Brackenlib, quarry,unknown")).select("id")


@query("""WITH r AS (SELECT DISTINCT id, title, docset_slug FROM pages) SELECT id, '<result slug="' || docset_slug || '" page="' || replace(replace(replace(replace(replace(id, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '">' ||
replace(replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</result>' AS xml FROM r""")
def results_xml(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select("id", "title", "docset_slug").distinct()
    return rows.select("id", report.as_xml({"slug": F.col("docset_slug"), "page": F.col("id")}, F.col("title")).alias("xml"))


@query("SELECT DISTINCT path, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN printf('%.1f', size_bytes / 1024.0) || ' KB' WHEN size_bytes < 1073741824 THEN printf('%.1f', size_bytes / 1048576.0) || ' MB' ELSE printf('%.1f', size_bytes / 1073741824.0) || ' GB' END AS size FROM source_files")
def byte_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("path", text.byte_size(F.col("size_bytes")).alias("size")).distinct()


# new and changed records
def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a record with its present and its committed hash, in one pass over both feeds and the commits."""
    stamp = F.coalesce(F.col("updated_at").cast("timestamp"), F.timestamp_seconds(F.lit(-(10**11))))
    files = table(spark, sf_dir, "files").select(F.lit("file").alias("record_kind"), F.col("path").alias("record_key"), "hash", stamp.alias("at"), "seq")
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("record_kind"), F.concat("docset_slug", F.lit("/"), "id").alias("record_key"), F.col("content_hash").alias("hash"), stamp.alias("at"), "seq")
    present = files.unionByName(pages).select("record_kind", "record_key", F.struct("at", "seq", "hash").alias("p"), F.lit(None).cast("struct<run_id:int,at:timestamp,hash:string>").alias("c"))
    runs = table(spark, sf_dir, "index_runs").where("status = 'succeeded'").select("run_id").distinct()
    written = table(spark, sf_dir, "run_commits").join(runs, "run_id", "left_semi")
    committed = written.select("record_kind", "record_key", F.lit(None).cast("struct<at:timestamp,seq:bigint,hash:string>").alias("p"), F.struct("run_id", F.col("committed_at").cast("timestamp").alias("at"), F.col("content_hash").alias("hash")).alias("c"))
    both = present.unionByName(committed).where("record_kind is not null and record_key is not null").groupBy("record_kind", "record_key").agg(F.max("p").alias("p"), F.max("c").alias("c"))
    return both.select("record_kind", "record_key", F.col("p.hash").alias("now"), F.col("p").isNotNull().alias("is_now"), F.col("c.hash").alias("was"), F.col("c").isNotNull().alias("is_was"))


PRESENT_RECORDS_SQL = """present AS (
  SELECT 'file' AS record_kind, path AS record_key, hash AS h, updated_at, seq FROM files
  UNION ALL SELECT 'page', docset_slug || '/' || id, content_hash, updated_at, seq FROM pages
), p AS (
  SELECT record_kind, record_key, h FROM present WHERE record_key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY record_kind, record_key ORDER BY updated_at DESC NULLS LAST, seq DESC) = 1
)"""


@query(f"""WITH {PRESENT_RECORDS_SQL}, c AS (
  SELECT record_kind, record_key, content_hash AS h FROM run_commits WHERE run_id IN (SELECT run_id FROM index_runs WHERE status = 'succeeded')
  QUALIFY row_number() OVER (PARTITION BY record_kind, record_key ORDER BY run_id DESC, committed_at DESC, content_hash DESC) = 1
)
SELECT p.record_kind, p.record_key FROM p LEFT JOIN c ON c.record_kind = p.record_kind AND c.record_key = p.record_key WHERE p.h IS NULL OR c.record_key IS NULL OR c.h IS DISTINCT FROM p.h""")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and pages whose present hash is not what succeeded runs last committed."""
    return incremental.stale_of_aligned(_aligned(spark, sf_dir), ["record_kind", "record_key"])


@query()
def p6_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of present and committed records by repository or docset, and whether they agree."""
    both = _aligned(spark, sf_dir).withColumn("part", F.concat_ws(":", "record_kind", F.substring_index("record_key", "/", 1)))
    keys = ["record_kind", "record_key"]
    now = incremental.fingerprints(both.where("is_now").withColumn("v", F.col("now")), keys, ["v"])
    was = incremental.fingerprints(both.where("is_was").withColumn("v", F.col("was")), keys, ["v"])
    changed = incremental.changed_partitions(now, was).withColumn("changed", F.lit(True))
    return now.select("part", "records").join(changed, "part", "full_outer").withColumn("changed", F.coalesce("changed", F.lit(False)))


class _DiesBeforeState(incremental.IncrementalTable):
    """Writes data and dies before it writes fingerprints."""

    def _put(self, rows: DataFrame, changed: list[int], name: str) -> None:
        if name == "state":
            raise InterruptedError(name)
        super()._put(rows, changed, name)


@query(f"WITH {PRESENT_RECORDS_SQL} SELECT record_kind, record_key, upper(h) AS content FROM p WHERE h IS NOT NULL")
def p6_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table derived from records with a hash, refreshed three times: from what succeeded runs committed, from the present
    records by a run that dies between data and fingerprints, and again by one that ends."""
    both = materialize(_aligned(spark, sf_dir), "aligned")
    keys = ["record_kind", "record_key"]
    committed, present = both.where("is_was").select(*keys, F.col("was").alias("hash")), both.where("is_now").select(*keys, F.col("now").alias("hash"))
    derive = lambda records: records.where("hash is not null").select(*keys, F.upper("hash").alias("content"), "part")
    path = new_path(spark, "records")
    derived = incremental.IncrementalTable(spark, path, keys, ["hash"])
    derived.refresh(committed, derive)
    try:
        _DiesBeforeState(spark, path, keys, ["hash"]).refresh(present, derive)
    except InterruptedError:
        derived.refresh(present, derive)
    return derived.read().drop("part")


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_docs_rank(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
